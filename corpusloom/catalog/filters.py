"""Queries: the filter language, zones, layers, tags, degrees, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import sqlparts as S
from corpusloom.catalog.text import QUERY, _bm25_sql, _notes, _post
from corpusloom.operators import model as M
from corpusloom.operators import rank as R
from corpusloom.plans import query as Q
from corpusloom.sources import bindings as B

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _on_notes(name: str, text: str, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Q.apply(M.with_zone(B.notes(spark, sf_dir)), text).select("pos", "path", "klass", "kind", "status", "bytes")
    ORACLES[name] = f"WITH {B.NOTES_SQL}, {ZONED_SQL} SELECT pos, path, klass, kind, status, bytes FROM zoned WHERE {where}"


ZONED_SQL = """l2s AS (SELECT lang || '/' || source AS l2 FROM notes GROUP BY lang, source HAVING count(*) >= 8 AND lang IN (SELECT lang FROM notes GROUP BY 1 HAVING count(*) > 26)),
zoned AS (SELECT n.*, coalesce(l2, lang) AS zone FROM notes n LEFT JOIN l2s ON l2 = lang || '/' || source)"""

_on_notes("filter_tag", "tag:quality", "len(list_filter(tags, lambda t: t = 'quality' OR starts_with(t, 'quality/'))) > 0")
_on_notes("filter_class", "класс:Claim", "klass = 'claim'")
_on_notes("filter_kind", "вид:SRC3", "kind = 'src3'")
_on_notes("filter_type_status", "type:en status:active", "type = 'en' AND status = 'active'")
_on_notes("filter_zone_path", "zone:en/ path:src1", "contains(lower(zone), 'en/') AND contains(lower(path), 'src1')")
_on_notes("filter_size", "size:>3", "bytes / 1024.0 > 3")
_on_notes("filter_is", "is:untagged", "len(tags) = 0")
_on_notes("filter_negated", "-tag:toxic -type:en size:<=2.5", "NOT list_contains(tags, 'toxic') AND type <> 'en' AND bytes / 1024.0 <= 2.5")


@query
def filter_about(spark, sf_dir):
    return Q.apply(B.nodes(spark, sf_dir), "о:Customer#00000001", B.links(spark, sf_dir)).select("path", "title")


ORACLES["filter_about"] = f"""WITH {B.NODES_SQL}, {B.LINKS_SQL}, named AS (SELECT path FROM nodes WHERE contains(lower(title), 'customer#00000001'))
SELECT path, title FROM nodes WHERE path IN (SELECT src FROM links WHERE type = 'about' AND dst IN (SELECT path FROM named) UNION SELECT dst FROM links WHERE type = 'about' AND src IN (SELECT path FROM named))"""


@query
def filter_links(spark, sf_dir):
    n = B.nodes(spark, sf_dir)
    return Q.apply(M.degrees(n, B.links(spark, sf_dir)), "links:>=12 path:customer")


DEG_SQL = "deg AS (SELECT n.path, coalesce(d.deg, 0)::BIGINT AS deg FROM nodes n LEFT JOIN (SELECT path, count(*) AS deg FROM (SELECT src AS path FROM links WHERE src <> dst UNION ALL SELECT dst FROM links WHERE src <> dst) GROUP BY 1) d ON n.path = d.path)"
ORACLES["filter_links"] = f"WITH {B.NODES_SQL}, {B.LINKS_SQL}, {DEG_SQL} SELECT path, deg FROM deg WHERE deg >= 12 AND contains(path, 'customer')"


@query
def filter_after_before(spark, sf_dir):
    return Q.apply(B.nodes(spark, sf_dir).where("type = 'order'"), "after:1995-06 before:1996-02-15").select("path", "at")


ORACLES["filter_after_before"] = f"WITH {B.NODES_SQL} SELECT path, n.at FROM nodes n WHERE type = 'order' AND coalesce(n.at, TIMESTAMP '2000-01-01') >= TIMESTAMP '1995-06-01' AND coalesce(n.at, TIMESTAMP '2000-01-01') <= TIMESTAMP '1996-02-15'"


@query
def filter_phrase(spark, sf_dir):
    """A phrase is looked for in the text, upper and lower case alike, after the other filters."""
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text")
    return Q.apply(B.notes(spark, sf_dir).join(d, "pos"), 'tag:quality "of the"', text="text").select("pos")


ORACLES["filter_phrase"] = "SELECT doc_id AS pos FROM documents WHERE contains(lower(text), 'of the') AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)"


@query
def search_then_filter(spark, sf_dir):
    """The best sixty by words, of these what the filters leave, the first 25: the limit comes before the filter."""
    top = R.bm25(_post(spark, sf_dir, QUERY), _notes(spark, sf_dir), QUERY, 60)
    left = Q.apply(B.notes(spark, sf_dir), "класс:claim").select("path")
    return top.join(left, "path", "left_semi").orderBy(F.desc("rank"), "doc_id").limit(25).select("doc_id", "path", "rank")


ORACLES["search_then_filter"] = f"SELECT doc_id, path, rank FROM ({_bm25_sql(QUERY, 60)}) WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY rank DESC, doc_id LIMIT 25"


@query
def zones(spark, sf_dir):
    return M.zones(M.with_zone(B.notes(spark, sf_dir)))


_hexpart = lambda i: f"lpad(lower(to_hex(floor(c{i} + ((CASE WHEN k > 0 THEN 255 ELSE 0 END) - c{i}) * abs(k) + 0.5)::BIGINT)), 2, '0')"
ORACLES["zones"] = f"""WITH {B.NOTES_SQL}, {ZONED_SQL}, z AS (SELECT zone, split_part(zone, '/', 1) AS root, count(*) AS n FROM zoned GROUP BY 1),
r AS (SELECT *, {"[" + ", ".join(map(S.lit, M.PALETTE)) + "]"}[((dense_rank() OVER (ORDER BY root) - 1) % 8 + 1)::INT] AS c, contains(zone, '/') AS nested, row_number() OVER (PARTITION BY root, contains(zone, '/') ORDER BY zone) AS nth FROM z),
h AS (SELECT *, CASE WHEN nth % 2 = 1 THEN 0.22::DOUBLE ELSE -0.24::DOUBLE END AS k, ('0x' || substr(c, 2, 2))::INT AS c0, ('0x' || substr(c, 4, 2))::INT AS c1, ('0x' || substr(c, 6, 2))::INT AS c2 FROM r)
SELECT zone, root, CASE WHEN nested THEN '#' || {_hexpart(0)} || {_hexpart(1)} || {_hexpart(2)} ELSE c END AS colour, regexp_matches(zone, '(?i){"|".join(M.CHRONICLES)}') AS chronicle, n, zone NOT IN ('templates', 'Учёба/Карточки') AS shown FROM h"""


@query
def zone_of_path(spark, sf_dir):
    return M.with_zone(B.notes(spark, sf_dir)).select("path", "zone")


ORACLES["zone_of_path"] = f"WITH {B.NOTES_SQL}, {ZONED_SQL} SELECT path, zone FROM zoned"


@query
def layers(spark, sf_dir):
    return M.layers(B.notes(spark, sf_dir), hidden=("evidence",))


ORACLES["layers"] = f"WITH {B.NOTES_SQL} SELECT coalesce(nullif(klass, ''), nullif(type, ''), '—') AS layer, count(*) AS n, coalesce(nullif(klass, ''), nullif(type, ''), '—') <> 'evidence' AS shown FROM notes GROUP BY 1"


@query
def visibility(spark, sf_dir):
    n = M.with_zone(B.notes(spark, sf_dir))
    z = M.zones(n).withColumn("shown", ~F.col("zone").startswith("de"))
    return M.visible(n, z, M.layers(n, hidden=("evidence",))).select("pos", "zone", "klass")


ORACLES["visibility"] = f"WITH {B.NOTES_SQL}, {ZONED_SQL} SELECT pos, zone, klass FROM zoned WHERE NOT starts_with(zone, 'de') AND klass <> 'evidence'"


@query
def tag_counts(spark, sf_dir):
    return M.tag_counts(B.notes(spark, sf_dir))


ORACLES["tag_counts"] = f"WITH {B.NOTES_SQL} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY 1"


@query
def lonely_tags(spark, sf_dir):
    """Tags that one note alone has; parts stand for notes, brand and size for tags."""
    p = B.table(spark, sf_dir, "part").select(F.array(F.col("p_brand"), F.concat_ws("/", "p_brand", "p_size")).alias("tags"))
    return M.tag_counts(p).where("n = 1").select("tag")


ORACLES["lonely_tags"] = "SELECT tag FROM (SELECT unnest([p_brand, p_brand || '/' || p_size]) AS tag FROM part) GROUP BY 1 HAVING count(*) = 1"


@query
def degree(spark, sf_dir):
    return M.degrees(B.nodes(spark, sf_dir), B.links(spark, sf_dir))


ORACLES["degree"] = f"WITH {B.NODES_SQL}, {B.LINKS_SQL}, {DEG_SQL} SELECT path, deg FROM deg"


@query
def links_by_type(spark, sf_dir):
    return M.links_by_type(B.links(spark, sf_dir), "src")


@query
def backlinks_by_type(spark, sf_dir):
    return M.links_by_type(B.links(spark, sf_dir), "dst")


for _name, _end in (("links_by_type", "src"), ("backlinks_by_type", "dst")):
    ORACLES[_name] = f"WITH {B.LINKS_SQL} SELECT {_end} AS path, type, count(*) AS n FROM links WHERE src <> dst GROUP BY 1, 2"


def _hrefs(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return B.table(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target"))


def _page_notes(spark, sf_dir):
    path = F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1)
    base = F.element_at(F.split(F.regexp_replace(path, "/$", ""), "/"), -1)
    return B.table(spark, sf_dir, "pages").select(F.col("page_id").alias("pos"), path.alias("path"), base.alias("base"))


@query
def resolve_links(spark, sf_dir):
    r = M.resolve(_hrefs(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n")), _page_notes(spark, sf_dir))
    return r.select("target", "n", "found")


@query
def broken_links(spark, sf_dir):
    r = M.resolve(_hrefs(spark, sf_dir), _page_notes(spark, sf_dir)).where("found is null")
    return r.groupBy("page_id").agg(F.count("*").alias("n_broken"), F.count_distinct("target").alias("n_targets"))


_LINKED = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
p AS (SELECT page_id AS pos, regexp_extract(url, '://[^/]*(/[^?#]*)', 1) AS path FROM pages), b AS (SELECT pos, path, split_part(regexp_replace(path, '/$', ''), '/', -1) AS base FROM p),
f AS (SELECT lower(base) AS key, arg_min(path, pos) AS path FROM b GROUP BY 1),
r AS (SELECT h.*, coalesce(f.path, a.path, m.path) AS found FROM h LEFT JOIN f ON lower(target) = f.key LEFT JOIN (SELECT DISTINCT path FROM p) a ON a.path = target LEFT JOIN (SELECT DISTINCT path FROM p) m ON m.path = target || '.md')"""
ORACLES["resolve_links"] = f"WITH {_LINKED} SELECT target, count(*) AS n, any_value(found) AS found FROM r GROUP BY 1"
ORACLES["broken_links"] = f"WITH {_LINKED} SELECT page_id, count(*) AS n_broken, count(DISTINCT target) AS n_targets FROM r WHERE found IS NULL GROUP BY 1"
