"""Queries: hybrid search, answers, pickers, cards, layouts."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from corpusloom.catalog import corpus, relations, sqlparts as S, text
from corpusloom.catalog.filters import ZONED_SQL
from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D
from corpusloom.operators import finders as N
from corpusloom.operators import graph as G
from corpusloom.operators import model as M
from corpusloom.operators import rank as R
from corpusloom.operators import vectors as V
from corpusloom.sources import bindings as B
from corpusloom.sources import files

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def hybrid_search(spark, sf_dir):
    """Ranking by words and by vectors, fused; a vector belongs to the document of its number."""
    words = R.placed(R.bm25(text._post(spark, sf_dir, text.QUERY), text._notes(spark, sf_dir), text.QUERY, 25), F.desc("rank"), "doc_id")
    e = B.table(spark, sf_dir, "embeddings").join(text._notes(spark, sf_dir).select(F.col("doc_id").alias("vec_id"), "path"), "vec_id")
    asked = relations._one_vector(spark, sf_dir).first()["q"]
    near = lambda: R.placed(V.search(e, asked, 25).join(e.select("vec_id", "path"), "vec_id"), F.desc("score"), "vec_id")
    return R.hybrid(words, near)


ORACLES["hybrid_search"] = f"""WITH {relations._Q}, v AS (SELECT d.lang || '/' || d.source || '/' || d.doc_id || '.md' AS path, vec_id, round({relations._DOT}, 6) AS score FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id, q ORDER BY score DESC, vec_id LIMIT 25),
l AS (SELECT path, 0 AS l, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY rank DESC, doc_id)) AS w FROM ({text._bm25_sql(text.QUERY, 25)})
UNION ALL SELECT path, 1, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY score DESC, vec_id)) FROM v)
SELECT path, round(sum(w), 5) AS rrf, min(l) AS first_list FROM l GROUP BY 1 ORDER BY rrf DESC, path LIMIT 25"""


def _answer(spark, sf_dir):
    found = text._ranked(spark, sf_dir, text.QUERY, N.answer_limit(None))
    return N.answer(found.select("path", "more", "rank", D.excerpt(F.col("t"), A.query_terms(text.QUERY)).alias("frag")), F.lit(""), "Это фрагменты, а не ответ.")


@query
def search_answer(spark, sf_dir):
    """The best six files as the text of an answer."""
    return _answer(spark, sf_dir)


_MORE = "CASE WHEN more = 0 THEN '' ELSE '  (ещё ' || more || CASE WHEN more = 1 THEN ' фрагмент' ELSE ' фрагмента' END || ' в этом файле)' END"
ORACLES["search_answer"] = f"""SELECT string_agg('**' || r.path || '**' || {_MORE} || chr(10) || frag, chr(10) || chr(10) ORDER BY rank DESC, r.path) || chr(10) || chr(10) || 'Это фрагменты, а не ответ.' AS answer
FROM {text._found_sql(text.QUERY, 6)} r"""


@query
def search_answer_parsed(spark, sf_dir):
    """The rows of an answer's text, read back."""
    a = files.parse_answers(_answer(spark, sf_dir).withColumn("key", F.lit(0)))
    return a.select("place", "path", F.col("more").cast("long").alias("more"), "frag")


ORACLES["search_answer_parsed"] = f"SELECT row_number() OVER (ORDER BY rank DESC, path) - 1 AS place, path, more, regexp_replace(frag, '\\A\\s+|\\s+\\z', '', 'g') AS frag FROM {text._found_sql(text.QUERY, 6)}"


@query
def substring_fragments(spark, sf_dir):
    """Every document that holds a text, with what surrounds its first place."""
    return N.fragments(B.table(spark, sf_dir, "documents").select("doc_id", "text"), "Idiot").select("doc_id", "frag")


ORACLES["substring_fragments"] = r"""WITH f AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\n+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents), a AS (SELECT *, strpos(lower(t), 'idiot') AS k FROM f)
SELECT doc_id, CASE WHEN k > 61 THEN '…' ELSE '' END || substr(t, greatest(k - 1 - 60, 0) + 1, 160) || '…' AS frag FROM a WHERE k > 0 AND contains(lower(text), 'idiot')"""


@query
def palette_match(spark, sf_dir):
    return N.palette(B.nodes(spark, sf_dir).withColumn("pos", F.col("path")), "Customer#00000001", F.col("at")).select("path", "title")


ORACLES["palette_match"] = f"WITH {B.NODES_SQL} SELECT path, title FROM nodes WHERE contains(lower(title), 'customer#00000001') OR contains(lower(path), 'customer#00000001') ORDER BY path LIMIT 12"


@query
def palette_newest(spark, sf_dir):
    return N.palette(B.nodes(spark, sf_dir).withColumn("pos", F.col("path")), " ", F.col("at")).select("path", "at")


ORACLES["palette_newest"] = f"WITH {B.NODES_SQL} SELECT path, n.at FROM nodes n ORDER BY n.at DESC NULLS LAST, path LIMIT 12"


@query
def entity_picker(spark, sf_dir):
    return N.pick(B.entities(spark, sf_dir), " C12").select("path", "title")


ORACLES["entity_picker"] = "SELECT 'customer/' || c_custkey AS path, c_name AS title FROM customer WHERE contains(lower(c_name || ' ' || c_custkey || ' c' || c_custkey), 'c12') ORDER BY c_custkey LIMIT 6"


@query
def cards_by_tag(spark, sf_dir):
    """Notes under a tag with a text in title, path or tag."""
    return N.cards(B.notes(spark, sf_dir), "quality", "Src1").select("path", "title")


ORACLES["cards_by_tag"] = f"WITH {B.NOTES_SQL} SELECT path, title FROM notes WHERE len(list_filter(tags, lambda t: t = 'quality' OR starts_with(t, 'quality/'))) > 0 AND (contains(lower(title), 'src1') OR contains(lower(path), 'src1') OR len(list_filter(tags, lambda t: contains(t, 'src1'))) > 0)"


@query
def cards_page(spark, sf_dir):
    """The second screen of the cards, the largest first."""
    return N.page(B.notes(spark, sf_dir), [F.desc("bytes"), F.col("pos")], 40, 40).select("path", "bytes")


ORACLES["cards_page"] = f"WITH {B.NOTES_SQL} SELECT path, bytes FROM notes ORDER BY bytes DESC, pos LIMIT 40 OFFSET 40"


@query
def range_selection(spark, sf_dir):
    """All cards from one to another in the order of title and pos."""
    return N.between(B.notes(spark, sf_dir), ["title", "pos"], F.col("title") == "Document 17", F.col("title") == "Document 120").select("path")


ORACLES["range_selection"] = f"WITH {B.NOTES_SQL} SELECT path FROM notes WHERE title BETWEEN 'Document 120' AND 'Document 17'"


@query
def folders(spark, sf_dir):
    return N.folders(B.notes(spark, sf_dir), ["people", "projects"])


ORACLES["folders"] = "SELECT DISTINCT lang || '/' || source AS folder FROM documents UNION SELECT 'people' UNION SELECT 'projects'"


@query
def well_linked(spark, sf_dir):
    """The first customers with more than two links."""
    c = B.nodes(spark, sf_dir).where("type = 'customer'").select("path")
    d = M.degrees(c, B.links(spark, sf_dir)).withColumn("pos", F.col("path"))
    return N.well_linked(d).select("path", "deg")


ORACLES["well_linked"] = f"WITH {B.LINKS_SQL}, e AS (SELECT src AS path FROM links UNION ALL SELECT dst FROM links) SELECT path, count(*) AS deg FROM e WHERE starts_with(path, 'customer/') GROUP BY 1 HAVING count(*) > 2 ORDER BY path LIMIT 10"


@query
def dimmed_nodes(spark, sf_dir):
    """Notes that a filter by text and tag leaves bright; rejected ones are not visible."""
    n = B.notes(spark, sf_dir).withColumn("visible", F.col("status") != "rejected")
    return N.dimmed(n, "src2", "quality").select("path", "dim")


ORACLES["dimmed_nodes"] = f"WITH {B.NOTES_SQL} SELECT path, NOT (status <> 'rejected' AND (contains(lower(title), 'src2') OR contains(lower(path), 'src2') OR len(list_filter(tags, lambda t: contains(t, 'src2'))) > 0) AND len(list_filter(tags, lambda t: t = 'quality' OR starts_with(t, 'quality/'))) > 0) AS dim FROM notes"


@query
def node_toward(spark, sf_dir):
    """Where the right arrow key leads from a place."""
    return N.toward(corpus._points(spark, sf_dir), 10.0, -20.0, 1, 0)


ORACLES["node_toward"] = f"WITH {corpus._POINTS}, d AS (SELECT id, x - 10 AS a, y + 20 AS b FROM p), s AS (SELECT id, a, round((a * a + b * b) / (a * a / (a * a + b * b + 1e-6)), 6) AS score FROM d WHERE a > 0) SELECT id, score FROM s ORDER BY score, id LIMIT 1"


_H = lambda x: corpus._HASH.replace("(path,", f"({x},")


@query
def scatter(spark, sf_dir):
    """First places of nodes, around the middle."""
    return G.scattered(B.notes(spark, sf_dir).select("path", F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


_R = f"(12 + {_H(chr(40) + 'path || ' + S.lit('·') + chr(41))} * 46)"
_A = f"({corpus._HASH} * {2 * math.pi!r}::DOUBLE)"
ORACLES["scatter"] = f"WITH {B.NOTES_SQL} SELECT path, round(cos({_A}) * {_R}, 4) + 0.0::DOUBLE AS x, round(sin({_A}) * {_R}, 4) + 0.0::DOUBLE AS y FROM notes"


@query
def zone_layout(spark, sf_dir):
    n = M.with_zone(B.notes(spark, sf_dir)).withColumn("visible", F.col("status") != "rejected")
    return G.zone_layout(n, G.sectors(n.groupBy("zone").agg(F.count("*").alias("n"))))


ORACLES["zone_layout"] = f"""WITH {B.NOTES_SQL}, {ZONED_SQL}, {corpus._SECTORS}, r AS (SELECT 150 + count(*) * 1.35::DOUBLE AS r FROM notes WHERE status <> 'rejected')
SELECT path, round(cos(angle) * r, 4) AS x, round(sin(angle) * r * 0.72, 4) AS y FROM zoned z JOIN sectors s ON z.zone = s.zone, r"""


@query
def cluster_layout(spark, sf_dir):
    """Documents in discs by source."""
    return G.cluster_layout(B.notes(spark, sf_dir).select("path", F.col("kind").alias("cluster")))


ORACLES["cluster_layout"] = f"""WITH {B.NOTES_SQL}, n AS (SELECT kind, count(*) AS size, sqrt(count(*)) AS w FROM notes GROUP BY 1),
c AS (SELECT kind, 26 + w * 11 AS r, (coalesce(sum(w) OVER (ORDER BY size DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + w / 2) / sum(w) OVER () * {2 * math.pi!r}::DOUBLE - {math.pi / 2!r}::DOUBLE AS a, 170 + sum(size) OVER () * 1.25::DOUBLE AS far FROM n),
p AS (SELECT path, cos(a) * far AS cx, sin(a) * far * 0.72 AS cy, {_A} AS t, sqrt({_H(chr(40) + 'path || ' + S.lit('·') + chr(41))}) * r AS d FROM notes JOIN c ON c.kind = notes.kind)
SELECT path, round(cx + cos(t) * d, 4) AS x, round(cy + sin(t) * d, 4) AS y FROM p"""


@query
def layer_layout(spark, sf_dir):
    """Orders in columns by how many of the customer's orders they wait for."""
    layers = G.chain_layers(B.links(spark, sf_dir))
    return G.layer_layout(layers.select("path", F.when(~F.col("in_cycle"), F.col("level")).alias("level")))


ORACLES["layer_layout"] = f"WITH l AS ({corpus.ORACLES['dependency_layers']}) SELECT path, -420 + level * 190 AS x, -240 + (row_number() OVER (PARTITION BY level ORDER BY path) - 1)::INTEGER * 46 AS y FROM l"
