"""Queries: reports and graph operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.catalog import sqlparts as S
from corpusloom.catalog.filters import DEG_SQL, ZONED_SQL
from corpusloom.operators import cycles as Y
from corpusloom.operators import graph as G
from corpusloom.operators import model as M
from corpusloom.operators import placing as L
from corpusloom.operators import reports as P
from corpusloom.sources import bindings as B

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


_PAGE_RULES = [("/en/", "claim", "english"), ("/(de|fr)/", "evidence", "other"), ("page=2", "derived", "paged")]


@query
def classify_paths(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return P.classify(p, _PAGE_RULES).groupBy("klass", "kind").agg(F.count("*").alias("n"))


ORACLES["classify_paths"] = "SELECT CASE WHEN url ~ '.*/en/.*' THEN 'claim' WHEN url ~ '.*/(de|fr)/.*' THEN 'evidence' WHEN url ~ '.*page=2.*' THEN 'derived' END AS klass, CASE WHEN url ~ '.*/en/.*' THEN 'english' WHEN url ~ '.*/(de|fr)/.*' THEN 'other' WHEN url ~ '.*page=2.*' THEN 'paged' END AS kind, count(*) AS n FROM pages GROUP BY 1, 2"


def _sources(spark, sf_dir):
    """Orders (claims) name their customer (evidence) as their source."""
    return B.table(spark, sf_dir, "orders").select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("path"))


@query
def archive_ready(spark, sf_dir):
    return P.archive_ready(_sources(spark, sf_dir), 10)


ORACLES["archive_ready"] = "SELECT 'customer/' || o_custkey AS path, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'ready' ELSE 'early' END AS state FROM orders GROUP BY 1"


@query
def archive_list(spark, sf_dir):
    last = B.table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("path")).agg(F.max("o_orderdate").alias("at"))
    return P.archive_list(B.entities(spark, sf_dir).select("path", "title").join(last, "path", "left"), _sources(spark, sf_dir)).drop("at")


ORACLES["archive_list"] = "SELECT 'customer/' || c_custkey AS path, c_name AS title, c_custkey IN (SELECT o_custkey FROM orders) AS parsed, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_parsed FROM customer"


def _report_notes(spark, sf_dir):
    """Nodes with what the reports ask for; the date of a customer is that of the last order."""
    links = B.links(spark, sf_dir).where("src <> dst")
    out = links.groupBy(F.col("src").alias("path")).agg(F.count("*").alias("n_links"))
    back = links.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n_backlinks"))
    n = B.nodes(spark, sf_dir).join(out, "path", "left").join(back, "path", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.select("path", F.crc32("path").alias("pos"), "type", zero("n_links"), zero("n_backlinks"), F.when(F.col("type") == "part", 0).otherwise(1).alias("n_tags"), F.when(F.col("bytes") > 400_000, 1).otherwise(0).alias("n_broken"), "bytes", "at", (F.col("type") == "supplier").alias("chronicle"), (F.col("type") != "region").alias("shown"))


REPORT_SQL = f"""{B.NODES_SQL}, {B.LINKS_SQL}, rn AS (SELECT n.path, n.type, coalesce(o.n, 0) AS n_links, coalesce(b.n, 0) AS n_backlinks, CASE WHEN n.type = 'part' THEN 0 ELSE 1 END AS n_tags,
CASE WHEN bytes > 400000 THEN 1 ELSE 0 END AS n_broken, bytes, n.at, n.type = 'supplier' AS chronicle, n.type <> 'region' AS shown
FROM nodes n LEFT JOIN (SELECT src, count(*) AS n FROM links GROUP BY 1) o ON o.src = n.path LEFT JOIN (SELECT dst, count(*) AS n FROM links GROUP BY 1) b ON b.dst = n.path)"""


@query
def health_report(spark, sf_dir):
    """How many notes have each problem, with 40 of them; the clock is the newest order's date."""
    n = _report_notes(spark, sf_dir).withColumn("pos", F.lit(0))
    return P.health(n, F.lit(n.agg(F.max("at").alias("now")).first()["now"]).cast("timestamp_ntz"))


ORACLES["health_report"] = f"""WITH {REPORT_SQL}, p AS (SELECT path, unnest(list_filter([CASE WHEN n_broken > 0 THEN 'broken' END, CASE WHEN n_backlinks = 0 AND NOT chronicle THEN 'orphan' END, CASE WHEN n_tags = 0 AND n_links = 0 THEN 'unsorted' END,
CASE WHEN rn.at < (SELECT max(rn.at) FROM rn) - INTERVAL 180 DAY AND NOT chronicle THEN 'stale' END, CASE WHEN bytes > 20000 THEN 'huge' END], lambda x: x IS NOT NULL)) AS problem FROM rn)
SELECT problem, path, n FROM (SELECT *, count(*) OVER (PARTITION BY problem) AS n, row_number() OVER (PARTITION BY problem ORDER BY path) AS r FROM p) WHERE r <= 40"""


@query
def timeline(spark, sf_dir):
    return P.timeline(B.table(spark, sf_dir, "events").select(F.col("ts").alias("at")))


@query
def timeline_adaptive(spark, sf_dir):
    return P.timeline(B.table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("at")))


for _name, _table, _col in (("timeline", "events", "ts"), ("timeline_adaptive", "orders", "o_orderdate")):
    ORACLES[_name] = f"""WITH s AS (SELECT CASE WHEN d <= 120 THEN 'day' WHEN d <= 1095 THEN 'month' ELSE 'year' END AS step FROM (SELECT datediff('day', min({_col}::DATE), max({_col}::DATE)) AS d FROM {_table})),
b AS (SELECT CASE step WHEN 'day' THEN strftime({_col}, '%Y-%m-%d') WHEN 'month' THEN strftime({_col}, '%Y-%m') ELSE strftime({_col}, '%Y') END AS bucket, step, count(*) AS n FROM {_table}, s GROUP BY 1, 2) SELECT bucket, step, n, round(n / max(n) OVER ()::DOUBLE, 6) AS share FROM b"""


@query
def people_mentions(spark, sf_dir):
    e = B.entities(spark, sf_dir).select("path", F.lit("1990-01-01").alias("own"))
    m = B.table(spark, sf_dir, "orders").select(F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return P.people(e, m)


ORACLES["people_mentions"] = "SELECT 'customer/' || c_custkey AS path, coalesce(n, 0) AS mentions, coalesce(l, '1990-01-01') AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(strftime(o_orderdate, '%Y-%m-%d')) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey"


@query
def triage_queue(spark, sf_dir):
    """Orders without lines and parts, but those of the skip list (orders that were urgent)."""
    skip = B.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"))
    return P.triage(_report_notes(spark, sf_dir), skip, 300).select("path", "type")


ORACLES["triage_queue"] = f"WITH {REPORT_SQL} SELECT path, type FROM rn WHERE shown AND NOT chronicle AND (n_tags = 0 OR n_links = 0) AND path NOT IN (SELECT 'order/' || o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') ORDER BY rn.at DESC NULLS LAST, path LIMIT 300"


@query
def digest(spark, sf_dir):
    n = _report_notes(spark, sf_dir)
    return P.digest(n, F.lit(n.agg(F.max("at").alias("now")).first()["now"]).cast("timestamp_ntz"), 7).select("path", "at")


ORACLES["digest"] = f"WITH {REPORT_SQL} SELECT path, rn.at FROM rn WHERE rn.at >= (SELECT max(rn.at) FROM rn) - INTERVAL 7 DAY ORDER BY rn.at DESC, path LIMIT 40"


@query
def totals(spark, sf_dir):
    n = M.with_zone(B.notes(spark, sf_dir))
    return n.agg(F.count("*").alias("n_notes"), F.count_if(F.col("klass") != "evidence").alias("n_shown"), F.count_distinct("zone").alias("n_zones"), F.sum("bytes").alias("bytes")).crossJoin(B.links(spark, sf_dir).where("src <> dst").agg(F.count("*").alias("n_links")))  # one row each


ORACLES["totals"] = f"WITH {B.NOTES_SQL}, {ZONED_SQL}, {B.LINKS_SQL} SELECT (SELECT count(*) FROM links WHERE src <> dst) AS n_links, count(*) AS n_notes, count(*) FILTER (klass <> 'evidence') AS n_shown, count(DISTINCT zone) AS n_zones, sum(bytes)::BIGINT AS bytes FROM zoned"


@query
def zone_rollup(spark, sf_dir):
    """An extension: counts by language, source and both, and in all."""
    d = B.table(spark, sf_dir, "documents")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("bytes"))


ORACLES["zone_rollup"] = "SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ROLLUP (lang, source)"


@query
def ego_graph(spark, sf_dir):
    """All within two steps of one region."""
    root = B.nodes(spark, sf_dir).where("path = 'region/1'").select("path")
    return G.ego(B.links(spark, sf_dir).where("type = 'part_of'"), root, 2)


ORACLES["ego_graph"] = f"""WITH {B.LINKS_SQL}, l AS (SELECT src, dst FROM links WHERE type = 'part_of'), n AS (SELECT src AS a, dst AS b FROM l UNION SELECT dst, src FROM l),
one AS (SELECT DISTINCT b FROM n WHERE a = 'region/1'), two AS (SELECT DISTINCT n.b FROM n JOIN one ON n.a = one.b WHERE n.b NOT IN (SELECT b FROM one) AND n.b <> 'region/1')
SELECT 'region/1' AS path, 0 AS steps UNION ALL SELECT b, 1 FROM one UNION ALL SELECT b, 2 FROM two"""


@query
def dependency_layers(spark, sf_dir):
    """Orders wait for the customer's order before: chains, so pointer doubling applies."""
    return G.chain_layers(B.links(spark, sf_dir))


ORACLES["dependency_layers"] = "SELECT 'order/' || o_orderkey AS path, (r - 1)::INTEGER AS level, false AS in_cycle FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n > 1"


@query
def dependency_layers_general(spark, sf_dir):
    """The general layering, on the parts of parts: customers and suppliers on nations, nations on regions."""
    l = B.links(spark, sf_dir).where("type = 'part_of'").withColumn("type", F.lit("depends"))
    return G.dependency_layers(l)


ORACLES["dependency_layers_general"] = f"WITH {B.LINKS_SQL} SELECT DISTINCT path, CASE split_part(path, '/', 1) WHEN 'region' THEN 0 WHEN 'nation' THEN 1 ELSE 2 END::INTEGER AS level, false AS in_cycle FROM (SELECT src AS path FROM links WHERE type = 'part_of' UNION SELECT dst FROM links WHERE type = 'part_of')"


@query
def cycle_layers(spark, sf_dir):
    """Orders of a customer and a year wait for the one before; where the first of them is finished (F) it waits for
    the one in the middle, which makes a cycle."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderdate", "o_orderstatus")
    group = Window.partitionBy("o_custkey", "y")
    own = group.orderBy("o_orderdate", "o_orderkey")
    o = o.withColumns({"src": F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")), "r": F.row_number().over(own), "n": F.count("*").over(group)})
    middle = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("src"))).over(group)
    o = o.select("src", F.lag("src").over(own).alias("before"), "r", "n", "o_orderstatus", middle.alias("middle"))
    back = o.where("r = 1 and n > 1 and o_orderstatus = 'F'").select("src", F.col("middle").alias("dst"))
    links = o.where("before is not null").select("src", F.col("before").alias("dst")).unionByName(back)
    return Y.cycle_layers(links.withColumn("type", F.lit("depends")))


ORACLES["cycle_layers"] = """WITH o AS (SELECT 'order/' || o_orderkey AS path, o_custkey AS c, year(o_orderdate) AS y, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_custkey, year(o_orderdate)) AS n, first_value(o_orderstatus) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)),
p AS (SELECT *, CASE WHEN s = 'F' THEN n // 2 + 1 ELSE 0 END AS m FROM o WHERE n > 1), q AS (SELECT *, min(path) FILTER (r <= m) OVER (PARTITION BY c, y) AS least FROM p)
SELECT path, (CASE WHEN m = 0 THEN r - 1 WHEN r <= m THEN 0 ELSE r - m END)::INTEGER AS level, CASE WHEN r <= m THEN least ELSE path END AS component, (CASE WHEN r <= m THEN m ELSE 1 END)::BIGINT AS members, CASE WHEN m = 0 THEN 'free' WHEN r <= m THEN 'cycle' ELSE 'above' END AS state FROM q"""


def _points(spark, sf_dir):
    e = B.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("group"), (F.get("embedding", F.lit(0)).cast("double") * 1000).alias("x"), (F.get("embedding", F.lit(1)).cast("double") * 1000).alias("y")).withColumns({"colour": F.when(F.col("x") > 0, "warm").otherwise("cold"), "shown": F.col("y") > -100})


@query
def super_nodes(spark, sf_dir):
    return G.super_nodes(_points(spark, sf_dir))


_POINTS = "p AS (SELECT vec_id AS id, label AS \"group\", embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings)"
ORACLES["super_nodes"] = f'WITH {_POINTS} SELECT "group", round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS members, round(9 + sqrt(count(*)) * 3.4, 6) AS radius, CASE WHEN count(*) FILTER (x > 0) > count(*) FILTER (x <= 0) THEN \'warm\' ELSE \'cold\' END AS colour FROM p WHERE y > -100 GROUP BY 1'


@query
def super_links(spark, sf_dir):
    """Links between kinds of nodes."""
    return G.super_links(B.links(spark, sf_dir), B.nodes(spark, sf_dir).select("path", F.col("type").alias("group")))


ORACLES["super_links"] = f"WITH {B.LINKS_SQL} SELECT least(split_part(src, '/', 1), split_part(dst, '/', 1)) AS a, greatest(split_part(src, '/', 1), split_part(dst, '/', 1)) AS b, count(*) AS n FROM links WHERE split_part(src, '/', 1) <> split_part(dst, '/', 1) GROUP BY 1, 2"


def _zone_counts(spark, sf_dir):
    return M.with_zone(B.notes(spark, sf_dir)).groupBy("zone").agg(F.count("*").alias("n"))


@query
def sectors(spark, sf_dir):
    return G.sectors(_zone_counts(spark, sf_dir))


_SECTORS = f"zc AS (SELECT zone, count(*) AS n, sqrt(count(*)) AS w FROM zoned GROUP BY 1), sec AS (SELECT zone, n, w / sum(w) OVER () * {2 * math.pi!r}::DOUBLE AS sp, coalesce(sum(w) OVER (ORDER BY zone ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () * {2 * math.pi!r}::DOUBLE AS before FROM zc), sectors AS (SELECT zone, n, round(before + sp / 2 - {math.pi / 2!r}::DOUBLE, 6) AS angle, round(sp, 6) AS span FROM sec)"
ORACLES["sectors"] = f"WITH {B.NOTES_SQL}, {ZONED_SQL}, {_SECTORS} SELECT zone, n, angle, span FROM sectors"


@query
def label_tiers(spark, sf_dir):
    return G.label_tiers(M.degrees(B.nodes(spark, sf_dir), B.links(spark, sf_dir)))


ORACLES["label_tiers"] = f"WITH {B.NODES_SQL}, {B.LINKS_SQL}, {DEG_SQL} SELECT path, deg, CASE WHEN r <= 10 THEN 1 WHEN r <= 30 THEN 2 ELSE 3 END AS tier FROM (SELECT *, row_number() OVER (ORDER BY deg DESC, path) AS r FROM deg)"


@query
def fresh_layout(spark, sf_dir):
    """Notes by zone, dated by their size so that the age varies."""
    n = M.with_zone(B.notes(spark, sf_dir))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' - make_dt_interval(0, cast(bytes as int))")
    zones = n.groupBy("zone").agg(F.count("*").alias("n"))
    return G.fresh_layout(n.withColumn("at", at), G.sectors(zones), F.lit("2024-01-01").cast("timestamp_ntz"))


_HASH = "(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(path, ''), lambda c: unicode(c)::HUGEINT)), lambda a, c: (a * 31 + c) % 4294967296) % 1000) / 1000.0::DOUBLE"
ORACLES["fresh_layout"] = f"""WITH {B.NOTES_SQL}, {ZONED_SQL}, {_SECTORS}, n AS (SELECT path, 60 + log10(least(bytes::DOUBLE + 1, 9600) + 1) / {math.log10(9600)!r}::DOUBLE * 380 AS r, angle + ({_HASH} - 0.5) * span * 0.8 AS a FROM zoned z JOIN sectors s ON z.zone = s.zone)
SELECT path, round(cos(a) * r, 4) AS x, round(sin(a) * r * 0.8, 4) AS y FROM n"""


@query
def node_style(spark, sf_dir):
    n = B.nodes(spark, sf_dir).where("type = 'order'")
    return G.style(n, F.lit("1998-12-31").cast("timestamp_ntz"))


ORACLES["node_style"] = f"WITH {B.NODES_SQL} SELECT path, round(3 + 7 * sqrt(bytes / greatest((SELECT max(bytes) FROM nodes WHERE type = 'order'), 1)::DOUBLE), 6) AS radius, round(1 - least(log10((epoch(TIMESTAMP '1998-12-31') - epoch(nodes.at)) / 3600 + 1) / {math.log10(9600)!r}::DOUBLE, 1.0), 6) AS warmth FROM nodes WHERE type = 'order'"


@query
def fit_bounds(spark, sf_dir):
    p = G.bounds(_points(spark, sf_dir), 1200, 800)
    return p.select(*(F.round(c, 4).alias(c) for c in ("x0", "x1", "y0", "y1", "scale")))


ORACLES["fit_bounds"] = f"WITH {_POINTS}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p) SELECT round(x0, 4) AS x0, round(x1, 4) AS x1, round(y0, 4) AS y0, round(y1, 4) AS y1, round(greatest(0.25, least(1.0, least(1200 / (x1 - x0 + 80), 800 / (y1 - y0 + 80)))), 4) AS scale FROM b"


@query
def nearest_node(spark, sf_dir):
    return G.nearest(_points(spark, sf_dir), 10.0, -20.0, 200.0)


ORACLES["nearest_node"] = f"WITH {_POINTS} SELECT id, round(sqrt((x - 10) * (x - 10) + (y + 20) * (y + 20)), 6) AS d FROM p WHERE sqrt((x - 10) * (x - 10) + (y + 20) * (y + 20)) <= 200 ORDER BY d, id LIMIT 1"


@query
def label_grid_overlap(spark, sf_dir):
    r = _points(spark, sf_dir).select("id", "x", "y", F.lit(24.0).alias("w"), F.lit(10.0).alias("h"))
    return G.overlaps(r)


ORACLES["label_grid_overlap"] = f"WITH {_POINTS} SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id < b.id AND a.x < b.x + 24 AND a.x + 24 > b.x AND a.y < b.y + 10 AND a.y + 10 > b.y"


@query
def placed_labels(spark, sf_dir):
    """Labels of all vectors as nodes of a map of 1,200 by 800: the first vector is chosen, those of its group are its neighbours."""
    p = _points(spark, sf_dir)
    box = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda c, size: (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * size
    first = F.when(F.col("id") == 0, 0).when((F.col("group") == 0) & (F.col("id") < 20), 1).otherwise(2)
    n = p.crossJoin(F.broadcast(box)).select("id", at("x", 1200).alias("x"), at("y", 800).alias("y"), (2 + F.col("id") % 5).alias("r"), (24 + 6 * F.length(F.col("id").cast("string"))).cast("double").alias("w"), (F.col("id") % 3).alias("tier"), first.alias("first"))  # one row
    out = L.placed_labels(n, n.select("id", "x", "y", (F.col("r") * 2.2 + 2).alias("half")), 1200, 800)
    return out.select("id", "spot", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
