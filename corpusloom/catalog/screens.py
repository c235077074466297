"""Queries: what screens show of notes, claims, tags and the graph; loading, dates and edits in bulk."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusloom.catalog import sqlparts as S
from corpusloom.catalog.corpus import REPORT_SQL, _report_notes
from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D
from corpusloom.functions import edits as T
from corpusloom.operators import entities as E
from corpusloom.operators import finders as N
from corpusloom.operators import graph as G
from corpusloom.operators import model as M
from corpusloom.operators import reports as P
from corpusloom.operators import versions as H
from corpusloom.plans import query as Q
from corpusloom.sources import bindings as B
from corpusloom.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def filter_newest(spark, sf_dir):
    """A search without words: the newest 200 that the filters leave."""
    return N.newest(Q.apply(_report_notes(spark, sf_dir).withColumn("pos", F.col("path")), "type:order -is:broken"), F.col("at")).select("path", "at")


ORACLES["filter_newest"] = f"WITH {REPORT_SQL} SELECT path, rn.at FROM rn WHERE type = 'order' AND n_broken = 0 ORDER BY rn.at DESC, path LIMIT 200"


@query
def filter_kinds_of_is(spark, sf_dir):
    """How many notes each of the filters of the key `is` leaves."""
    n = _report_notes(spark, sf_dir).withColumns({"tags": F.array_repeat(F.lit("t"), F.col("n_tags")), "status": F.col("type")})
    count = lambda v: Q.apply(n, f"is:{v}").agg(F.lit(v).alias("filter"), F.count("*").alias("n"))
    out = count("orphan")
    for v in ("broken", "tagged", "untagged", "chronicle", "order"):
        out = out.unionByName(count(v))
    return out


ORACLES["filter_kinds_of_is"] = f"""WITH {REPORT_SQL} SELECT f AS filter, count(*) FILTER (CASE f WHEN 'orphan' THEN n_backlinks = 0 WHEN 'broken' THEN n_broken > 0 WHEN 'tagged' THEN n_tags > 0 WHEN 'untagged' THEN n_tags = 0 WHEN 'chronicle' THEN chronicle ELSE type = 'order' END) AS n
FROM rn CROSS JOIN (SELECT unnest(['orphan', 'broken', 'tagged', 'untagged', 'chronicle', 'order']) AS f) GROUP BY 1"""


@query
def link_picker(spark, sf_dir):
    """Twelve notes to link with, by a part of their name."""
    return N.pick(B.entities(spark, sf_dir), "00012", N.LINKED).select("path", "title")


ORACLES["link_picker"] = "SELECT 'customer/' || c_custkey AS path, c_name AS title FROM customer WHERE contains(lower(c_name || ' ' || c_custkey || ' c' || c_custkey), '00012') ORDER BY c_custkey LIMIT 12"


@query
def claim_passports(spark, sf_dir):
    c = B.claims(spark, sf_dir).withColumn("confidence", F.when(F.col("status") == "current", "high"))
    return E.passport(c, ("obsolete",))


ORACLES["claim_passports"] = "SELECT 'order/' || o_orderkey AS path, upper(o_orderpriority) AS kind, strftime(o_orderdate, '%Y-%m-%d') AS \"at\", CASE WHEN o_orderstatus = 'F' THEN 'OBSOLETE' ELSE 'CURRENT' END AS status, CASE WHEN o_orderstatus = 'F' THEN '—' ELSE 'HIGH' END AS confidence, o_orderstatus = 'F' AS dead FROM orders"
_KINDS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")


@query
def claims_panel(spark, sf_dir):
    """Claims about each entity by kind in the order of priority, newest first."""
    return E.panel(B.links(spark, sf_dir), B.claims(spark, sf_dir), _KINDS)


ORACLES["claims_panel"] = """WITH c AS (SELECT 'customer/' || o_custkey AS entity, o_orderpriority AS kind, 'order/' || o_orderkey AS claim, strftime(o_orderdate, '%Y-%m-%d') AS "at" FROM orders)
SELECT entity, kind, coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], kind) - 1, 99)::BIGINT AS priority, claim, "at", row_number() OVER (PARTITION BY entity, kind ORDER BY "at" DESC, claim) AS place FROM c"""


@query
def digest_unsorted(spark, sf_dir):
    """What a digest lists as not sorted in yet."""
    return P.unsorted(_report_notes(spark, sf_dir).withColumn("pos", F.col("path"))).select("path", "type")


ORACLES["digest_unsorted"] = f"WITH {REPORT_SQL} SELECT path, type FROM rn WHERE shown AND NOT chronicle AND (n_tags = 0 OR n_links + n_backlinks = 0) ORDER BY path LIMIT 20"


@query
def top_tags(spark, sf_dir):
    """The forty most used tags, of which a short list shows twelve."""
    return M.top_tags(M.tag_counts(_part_tags(spark, sf_dir)))


def _part_tags(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select(F.array(F.col("p_brand"), F.concat_ws("/", "p_brand", "p_size")).alias("tags"))


ORACLES["top_tags"] = "SELECT tag, n, row_number() OVER (ORDER BY n DESC, tag) <= 12 AS short FROM (SELECT tag, count(*) AS n FROM (SELECT unnest([p_brand, p_brand || '/' || p_size]) AS tag FROM part) GROUP BY 1) ORDER BY n DESC, tag LIMIT 40"
_NOTE_RULES = [("^en/", "claim", "noted", True), ("^(de|fr)/", "evidence", "other")]


@query
def classification_stats(spark, sf_dir):
    """What classifying the notes by rules would change; the kind of the first rule is the note's own."""
    n = B.notes(spark, sf_dir).select("path", (F.col("status") != "").alias("front"), F.col("klass").alias("own_klass"), F.col("kind").alias("own_kind"))
    return P.classification(n, _NOTE_RULES)


ORACLES["classification_stats"] = f"""WITH {B.NOTES_SQL}, c AS (SELECT status, klass AS ok, kind AS own, CASE WHEN lang = 'en' THEN 'claim' WHEN lang IN ('de', 'fr') THEN 'evidence' END AS k, CASE WHEN lang = 'en' THEN coalesce(nullif(kind, ''), 'noted') WHEN lang IN ('de', 'fr') THEN 'other' END AS v FROM notes),
s AS (SELECT *, CASE WHEN k IS NULL THEN 'untouched' WHEN status = '' THEN 'no front matter' WHEN ok IS NOT DISTINCT FROM k AND own IS NOT DISTINCT FROM v THEN 'already' ELSE 'change' END AS state FROM c)
SELECT state, CASE WHEN state = 'change' THEN k END AS klass, CASE WHEN state = 'change' THEN v END AS kind, count(*) AS n FROM s GROUP BY 1, 2, 3"""


@query
def selection_neighbours(spark, sf_dir):
    """What is linked with the nations, in either direction."""
    chosen = B.nodes(spark, sf_dir).where("type = 'nation'").select("path")
    return G.around(B.links(spark, sf_dir), chosen)


ORACLES["selection_neighbours"] = f"WITH {B.LINKS_SQL} SELECT DISTINCT path FROM (SELECT dst AS path FROM links WHERE starts_with(src, 'nation/') UNION ALL SELECT src FROM links WHERE starts_with(dst, 'nation/')) WHERE NOT starts_with(path, 'nation/')"


def _placed_nodes(spark, sf_dir):
    n = B.nodes(spark, sf_dir)
    return n.select("path", F.col("type").alias("zone"), F.col("bytes").cast("double").alias("x"), F.length("path").cast("double").alias("y"), F.substring("title", 1, 1).alias("colour"), (F.col("type") != "region").alias("shown"))


@query
def collapsed_nodes(spark, sf_dir):
    """The graph collapsed by zone: its nodes."""
    return G.collapse(_placed_nodes(spark, sf_dir), B.links(spark, sf_dir), "zone")[0]


@query
def collapsed_links(spark, sf_dir):
    """The graph collapsed by zone: its links, without those of what is hidden."""
    return G.collapse(_placed_nodes(spark, sf_dir), B.links(spark, sf_dir), "zone")[1]


ORACLES["collapsed_nodes"] = f"""WITH {B.NODES_SQL}, p AS (SELECT type AS g, bytes::DOUBLE AS x, length(path)::DOUBLE AS y, left(title, 1) AS colour FROM nodes WHERE type <> 'region'),
c AS (SELECT g, colour, count(*) AS n FROM p GROUP BY 1, 2), m AS (SELECT g, colour FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, colour) AS r FROM c) WHERE r = 1)
SELECT p.g AS "group", round(sum(x) / count(*), 6) AS x, round(sum(y) / count(*), 6) AS y, count(*) AS members, round(9 + sqrt(count(*)) * 3.4, 6) AS radius, any_value(m.colour) AS colour FROM p JOIN m ON m.g = p.g GROUP BY 1"""
ORACLES["collapsed_links"] = f"WITH {B.LINKS_SQL}, l AS (SELECT split_part(src, '/', 1) AS a, split_part(dst, '/', 1) AS b FROM links) SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM l WHERE a <> b AND a <> 'region' AND b <> 'region' GROUP BY 1, 2"


@query
def node_style_degree(spark, sf_dir):
    """Sizes by degree; customers, suppliers and nations have no date."""
    n = B.nodes(spark, sf_dir)
    return G.style(n.join(M.degrees(n, B.links(spark, sf_dir)), "path"), F.lit("1998-12-31").cast("timestamp_ntz"), "deg").select("path", "radius")


ORACLES["node_style_degree"] = f"WITH {B.NODES_SQL}, {B.LINKS_SQL}, deg AS (SELECT n.path, coalesce(d.deg, 0)::BIGINT AS deg FROM nodes n LEFT JOIN (SELECT path, count(*) AS deg FROM (SELECT src AS path FROM links WHERE src <> dst UNION ALL SELECT dst FROM links WHERE src <> dst) GROUP BY 1) d ON n.path = d.path) SELECT path, round(3 + 7 * (deg / greatest((SELECT max(deg) FROM deg), 1)::DOUBLE), 6) AS radius FROM deg"


@query
def node_style_commits(spark, sf_dir):
    """Sizes by the number of changes; lines of an order stand for its commits."""
    n = B.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("commits"))
    n = n.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("path"), "commits", F.lit(None).cast("timestamp_ntz").alias("at"))
    return G.style(n, F.lit("1998-12-31").cast("timestamp_ntz"), "commits")


ORACLES["node_style_commits"] = f"WITH c AS (SELECT 'order/' || l_orderkey AS path, count(*) AS n FROM lineitem GROUP BY 1) SELECT path, round(3 + 7 * (n / (SELECT max(n) FROM c)::DOUBLE), 6) AS radius, round(1 - least(log10(100001) / {math.log10(9600)!r}::DOUBLE, 1.0), 6) AS warmth FROM c"


@query
def marked_lines(spark, sf_dir):
    """The lines with a query's words, these marked, and the same lines without marks of lists and links."""
    terms = A.query_terms("idiot clown")
    c = B.chunks(spark, sf_dir).where(F.lower("t").rlike("idio|clow"))
    return c.select("doc_id", "i", D.mark(F.col("t"), terms).alias("marked"), A.clean_fragment(F.col("t")).alias("plain"))


_met = " OR ".join(f"{S.match('k', S.lit(v))} > 0" for t in A.query_terms("idiot clown") for v in t)
ORACLES["marked_lines"] = f"""SELECT doc_id, i::BIGINT AS i, array_to_string(list_transform(regexp_extract_all(t, '[0-9a-zA-Zа-яёА-ЯЁ]+|[^0-9a-zA-Zа-яёА-ЯЁ]+'), lambda p: CASE WHEN length(p) >= 2 AND len(list_filter([{S.stem('p')}, {S.translit(S.stem('p'))}], lambda k: {_met})) > 0 THEN '<mark>' || p || '</mark>' ELSE p END), '') AS marked,
  regexp_replace(replace(regexp_replace(regexp_replace(t, '\\[\\[[^\\]|#]+(?:#[^\\]|]*)?\\|([^\\]]+)\\]\\]', '\\1', 'g'), '\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?\\|?\\]\\]', '\\1', 'g'), '**', ''), '^[-*>]\\s+', '') AS plain
FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(t) <> '' AND regexp_matches(lower(t), 'idio|clow')"""


@query
def dated_titles(spark, sf_dir):
    """Titles without their date, the date in them (else that of the note), and how long ago it was."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" - ", F.date_format(F.date_add("o_orderdate", 3650), "yyyy-MM-dd"), "o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp_ntz").alias("at"))
    now = F.lit("1998-08-02 06:00:00").cast("timestamp_ntz")
    day = A.note_date(F.lit("notes"), F.col("title"), F.col("at"))
    return o.select("o_orderkey", A.strip_date(F.col("title")).alias("title"), F.date_format(day, "yyyy-MM-dd").alias("day"), A.format_age(F.col("at"), now).alias("age"))


ORACLES["dated_titles"] = """SELECT o_orderkey, o_orderpriority AS title, CASE WHEN year(o_orderdate + INTERVAL 3650 DAY) >= 2000 THEN strftime(o_orderdate + INTERVAL 3650 DAY, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
  CASE WHEN s < 90 THEN 'только что' WHEN s < 3600 THEN floor(s / 60.0 + 0.5)::BIGINT || ' мин назад' WHEN s < 86400 THEN floor(s / 3600.0 + 0.5)::BIGINT || ' ч назад' WHEN s < 172800 THEN 'вчера' ELSE floor(s / 86400.0 + 0.5)::BIGINT || ' дн назад' END AS age
FROM (SELECT *, epoch(TIMESTAMP '1998-08-02 06:00:00') - epoch(o_orderdate::TIMESTAMP) AS s FROM orders)"""


@query
def chunked_notes(spark, sf_dir):
    """Texts cut at their headings; a part of a conversation begins with its role as a heading."""
    c = B.table(spark, sf_dir, "conversations")
    part = F.concat(F.when(F.col("turn") == 0, "# ").when(F.col("role") == "user", "## ").otherwise("### "), "role", F.lit("\n"), F.coalesce(F.regexp_replace("text", "(?m)^#", ""), F.lit("")))
    texts = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("t")))).alias("x")).select(F.col("conv_id").cast("string").alias("path"), F.array_join(F.transform("x", lambda e: e["t"]), "\n").alias("text"))
    return files.chunk_notes(texts).select("path", "i", F.concat_ws(" › ", "h").alias("chain"))


ORACLES["chunked_notes"] = """WITH c AS (SELECT conv_id::VARCHAR AS path, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, CASE WHEN turn = 0 THEN 1 WHEN role = 'user' THEN 2 ELSE 3 END AS level FROM conversations),
r AS (SELECT *, coalesce(last_value(CASE WHEN level = 2 THEN role END IGNORE NULLS) OVER w, first_value(role) OVER w) AS root FROM c WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT path, i, CASE WHEN level = 2 OR i = 0 THEN role ELSE root || ' › ' || role END AS chain FROM r"""


@query
def tagged_in_bulk(spark, sf_dir):
    """One tag more for every document; what cannot be edited is reported by row."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = T.in_bulk(d, "text", lambda t: D.add_tag(t, "Bulk"), missing=F.length("text") < 40)
    return done.groupBy("error").agg(F.count("*").alias("n"), F.count_if(F.col("text").startswith("---\ntags: [bulk]\n---")).alias("n_tagged"))


ORACLES["tagged_in_bulk"] = "SELECT CASE WHEN text IS NULL OR length(text) < 40 THEN 'missing' END AS error, count(*) AS n, count(*) FILTER (text IS NOT NULL AND length(text) >= 40) AS n_tagged FROM documents GROUP BY 1"


@query
def helper_packs(spark, sf_dir):
    """What a helper is asked for each note with tags: its text, the tags in use and notes near by."""
    n = B.notes(spark, sf_dir)
    tags = M.top_tags(M.tag_counts(n)).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "tag", "n"))).alias("x")).select(F.transform("x", lambda t: F.struct(t["tag"].alias("tag"), t["n"].alias("n"))).alias("in_use"))
    pack = T.helper_pack("Mark the note.", F.concat(F.lit("Note "), "title"), F.col("in_use"), F.array("base"))
    return n.where(F.size("tags") > 0).crossJoin(F.broadcast(tags)).select("path", pack.alias("pack"))  # one row


ORACLES["helper_packs"] = f"""WITH {B.NOTES_SQL}, t AS (SELECT string_agg('#' || tag || ' (' || n || ')', ', ' ORDER BY n DESC, tag) AS s FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM notes) GROUP BY 1 ORDER BY n DESC, tag LIMIT 40))
SELECT path, 'Mark the note.' || chr(10) || chr(10) || 'Note ' || title || chr(10) || chr(10) || s || chr(10) || chr(10) || '- ' || base AS pack FROM notes, t WHERE len(tags) > 0"""


@query
def write_receipts(spark, sf_dir):
    """Turns written to files: the clean path and the id of the version, or why not."""
    c = B.table(spark, sf_dir, "conversations")
    back, up = F.col("turn") % 3 == 1, F.col("conv_id") % 7 == 3
    path = F.concat(F.when(back, "\\notes\\").otherwise("/notes/"), F.when(up, "../").otherwise(""), F.col("role"), F.lit("/"), F.col("conv_id").cast("string"), F.lit(".md/"))
    return c.withColumn("r", T.receipt(path, F.col("text"))).select("conv_id", "turn", "r.path", "r.commit", "r.error")


ORACLES["write_receipts"] = """SELECT conv_id, turn, CASE WHEN conv_id % 7 <> 3 THEN 'notes/' || role || '/' || conv_id || '.md' END AS path,
  CASE WHEN conv_id % 7 <> 3 THEN left(sha1(text), 7) END AS commit, CASE WHEN conv_id % 7 = 3 THEN 'bad path' END AS error FROM conversations"""


@query
def overlaid_listing(spark, sf_dir):
    """What is in a folder, where the files of an overlay (all labelled documents, one larger) count first."""
    n = B.notes(spark, sf_dir)
    over = n.where("status <> ''").select("path", (F.col("bytes") + 1).cast("long").alias("size"))
    every = H.overlay(n.select("path", F.col("bytes").cast("long").alias("size")), over)
    folder = files.listing(every, "/en/").unionByName(files.listing(every)).unionByName(files.listing(every, "de/src1"))
    return folder.select("path", "is_folder", "size")


ORACLES["overlaid_listing"] = f"""WITH {B.NOTES_SQL}, f AS (SELECT path, lang, source, bytes + CASE WHEN status <> '' THEN 1 ELSE 0 END AS size FROM notes)
SELECT DISTINCT lang || '/' || source AS path, true AS is_folder, NULL::BIGINT AS size FROM f WHERE lang = 'en' UNION ALL SELECT DISTINCT lang, true, NULL FROM f UNION ALL SELECT path, false, size::BIGINT FROM f WHERE path LIKE 'de/src1/%'"""


@query
def notes_of_chunks(spark, sf_dir):
    """Notes put together again from their chunks."""
    n = files.notes_of_chunks(B.chunks(spark, sf_dir))
    return n.select("path", "base", "title", "bytes", F.md5(F.encode("text", "UTF-8")).alias("digest"))


ORACLES["notes_of_chunks"] = """WITH l AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.md' AS path, unnest(range(len(s))) AS i, unnest(s) AS t FROM (SELECT *, string_split(text, chr(10)) AS s FROM documents)),
n AS (SELECT doc_id, path, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM l WHERE trim(t, ' ') <> '' GROUP BY 1, 2)
SELECT path, doc_id::VARCHAR AS base, doc_id::VARCHAR AS title, len(text) AS bytes, md5(text) AS digest FROM n"""


def _linked(name: str, nation: int, status: str) -> str:
    field, to = D.field_of("depends"), f"nation/{nation}"
    text = D.set_field(D.add_link(D.add_link(name, field, f"{to}.md"), field, f"[[{to.upper()}|again]]"), "old", "1")
    text = D.set_field(D.set_field(text, "status", status), "old", "")
    return D.remove_link(text, field, to) if nation == 0 else text


@query
def typed_links(spark, sf_dir):
    """Links and fields put into, and taken out of, the front matter of a note for each supplier."""
    s = B.table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_acctbal") > 0, "active").otherwise("review")
    return s.select("s_suppkey", D.mapped(_linked, "string")("s_name", "s_nationkey", status).alias("text"))


ORACLES["typed_links"] = """SELECT s_suppkey, '---' || chr(10) || CASE WHEN s_nationkey = 0 THEN '' ELSE 'depends_on: ["[[nation/' || s_nationkey || ']]"]' || chr(10) END
  || 'status: ' || CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'review' END || chr(10) || '---' || chr(10) || chr(10) || s_name AS text FROM supplier"""
