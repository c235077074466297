"""Queries: similar notes, entities and claims, vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import sqlparts as S
from corpusloom.functions import analyze as A
from corpusloom.operators import entities as E
from corpusloom.operators import model as M
from corpusloom.operators import rank as R
from corpusloom.operators import similar as G
from corpusloom.operators import vectors as V
from corpusloom.sources import bindings as B
from corpusloom.storage import scratch, stored

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _keywords(spark, sf_dir):
    """(doc_id, term): the keywords of the notes, a stored table."""

    def build():
        d = B.table(spark, sf_dir, "documents")
        total = d.agg(F.count("*").alias("total"))
        counts = scratch(R.term_counts(d, "doc_id", "text"))  # read for the frequencies and for the weights
        return G.keywords(counts.crossJoin(F.broadcast(total)), "doc_id", F.col("total"))  # one row

    return stored(spark, "keywords", f"{sf_dir}/documents.parquet", build)


def keywords_by_path(spark, sf_dir):
    """(path, term): the same under the notes' paths."""
    paths = B.table(spark, sf_dir, "documents").select("doc_id", B.path_column().alias("path"))
    return _keywords(spark, sf_dir).join(paths, "doc_id").select("path", "term")


KEYWORDS_SQL = f"""{S.POSTINGS}, paths AS (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
kw AS (SELECT path, term FROM (SELECT p.path, o.term, row_number() OVER (PARTITION BY p.path ORDER BY round(o.n * ln((SELECT count(*) FROM documents) / df::DOUBLE), 6) DESC, o.term) AS r FROM postings o JOIN dfs ON o.term = dfs.term JOIN paths p ON p.doc_id = o.doc_id) WHERE r <= 10)"""
_KW_PART = "kwdf AS (SELECT term, count(*) AS df FROM kw GROUP BY 1 HAVING count(*) <= (SELECT count(*) FROM documents) / 4.0), kpart AS (SELECT a.path, b.path AS other, sum(1 / log2(2 + df)) AS w FROM kw a JOIN kwdf ON a.term = kwdf.term JOIN kw b ON a.term = b.term AND a.path <> b.path GROUP BY 1, 2)"


@query
def stored_keywords(spark, sf_dir):
    """How many keywords and different ones the stored table has; the first query of a session makes it."""
    return _keywords(spark, sf_dir).agg(F.count("*").alias("n_keywords"), F.count_distinct("term").alias("n_terms"))


ORACLES["stored_keywords"] = f"WITH {KEYWORDS_SQL} SELECT count(*) AS n_keywords, count(DISTINCT term) AS n_terms FROM kw"


@query
def similar_keyword_part(spark, sf_dir):
    n = B.table(spark, sf_dir, "documents").count()
    return G.keyword_pairs(keywords_by_path(spark, sf_dir), n).select("path", "other", F.round("w", 6).alias("w"))


ORACLES["similar_keyword_part"] = f"WITH {KEYWORDS_SQL}, {_KW_PART} SELECT path, other, round(w, 6) AS w FROM kpart"


@query
def similar_graph_part(spark, sf_dir):
    """All nodes with a direct link to, or a common neighbour with, each node whose number is divisible by 20, over links of all types."""
    n = B.nodes(spark, sf_dir)
    return G.graph_part(n, B.links(spark, sf_dir), n.where(_TWENTIETH), 6)


_TWENTIETH = "cast(substring_index(path, '/', -1) AS bigint) % 20 = 0"
_GRAPH = lambda of: f"""WITH {B.LINKS_SQL}, l AS (SELECT src, dst FROM links WHERE src <> dst), near AS (SELECT path, x, count(*) AS c FROM (SELECT src AS path, dst AS x FROM l UNION ALL SELECT dst, src FROM l) GROUP BY 1, 2),
m AS (SELECT * FROM near{of}), deg AS (SELECT path, sum(c) AS deg FROM near GROUP BY 1), p AS (SELECT path, x AS other, 0.8::DOUBLE * c AS w FROM m UNION ALL SELECT m.path, n.x, sum(m.c * n.c * 1.1::DOUBLE / log2(2 + deg)) FROM m JOIN deg d ON d.path = m.x JOIN near n ON n.path = m.x WHERE n.x <> m.path GROUP BY 1, 2)
SELECT path, other, round(sum(w), 6) AS w FROM p GROUP BY 1, 2"""  # noqa: E731
ORACLES["similar_graph_part"] = _GRAPH(" WHERE split_part(path, '/', 2)::BIGINT % 20 = 0")


@query
def similar_graph_whole(spark, sf_dir):
    """All pairs of nodes with a direct link or a common neighbour, over links of all types."""
    n = B.nodes(spark, sf_dir)
    return G.graph_part(n, B.links(spark, sf_dir), n, 6)


ORACLES["similar_graph_whole"] = _GRAPH("")


def _part_notes(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("part/"), "p_partkey").alias("path"), F.array(F.concat_ws("/", "p_brand", "p_size"), F.concat_ws("/", "p_type", "p_size")).alias("tags"))


@query
def similar_tag_part(spark, sf_dir):
    n = _part_notes(spark, sf_dir)
    return G.tag_part(n, n, 6)


ORACLES["similar_tag_part"] = """WITH t AS (SELECT 'part/' || p_partkey AS path, unnest([p_brand || '/' || p_size, p_type || '/' || p_size]) AS tag FROM part), n AS (SELECT tag, count(*) AS h FROM t GROUP BY 1)
SELECT a.path, b.path AS other, round(sum(1.4::DOUBLE / log2(2 + h)), 6) AS w FROM t a JOIN n ON a.tag = n.tag JOIN t b ON a.tag = b.tag AND a.path <> b.path GROUP BY 1, 2"""


def _similar(spark, sf_dir, limit=8):
    n = B.table(spark, sf_dir, "documents").count()
    notes = B.notes(spark, sf_dir).select(F.col("pos").alias("path"), F.col("path").alias("name"), "tags", F.lit(0).alias("deg"), (F.col("lang") == "de").alias("chronicle"), (F.col("klass") != "evidence").alias("shown"))
    words = _keywords(spark, sf_dir).withColumnRenamed("doc_id", "path")  # pairs of numbers, not of names
    return G.similar_by_words(words, notes, n, limit)


@query
def similar_notes(spark, sf_dir):
    """Similar notes by shared keywords and shared tags; documents have no links, so no links or degrees."""
    return _similar(spark, sf_dir)


_SIM = f"""WITH {KEYWORDS_SQL}, {_KW_PART}, {B.NOTES_SQL}, t AS (SELECT path, unnest(tags) AS tag FROM notes), held AS (SELECT tag, count(*) AS h FROM t GROUP BY 1),
tpart AS (SELECT a.path, b.path AS other, sum(1.4::DOUBLE / log2(2 + h)) AS w FROM t a JOIN held ON a.tag = held.tag JOIN t b ON a.tag = b.tag AND a.path <> b.path GROUP BY 1, 2),
every AS (SELECT path, other, sum(w) AS w FROM (SELECT * FROM kpart UNION ALL SELECT * FROM tpart) GROUP BY 1, 2),
sim AS (SELECT path, other, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, other) AS r FROM
(SELECT k.path, other, round(w * (CASE WHEN lang = 'de' THEN 0.4::DOUBLE ELSE 1.0::DOUBLE END) / log2(2), 6) AS score FROM every k JOIN notes n ON n.path = other WHERE klass <> 'evidence')) WHERE r <= 8)"""
ORACLES["similar_notes"] = f"{_SIM} SELECT * FROM sim"


@query
def tag_suggestions(spark, sf_dir):
    """For each note the nine tags with the most similarity among its eight nearest."""
    from pyspark.sql.window import Window

    tags = B.notes(spark, sf_dir).select(F.col("path").alias("other"), F.explode("tags").alias("tag"))
    s = _similar(spark, sf_dir).join(tags, "other").groupBy("path", "tag").agg(F.round(F.sum("score"), 6).alias("score"))
    best = Window.partitionBy("path").orderBy(F.desc("score"), "tag")
    return s.withColumn("r", F.row_number().over(best)).where("r <= 9").drop("r")


ORACLES["tag_suggestions"] = f"{_SIM} SELECT path, tag, score FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, tag) AS r FROM (SELECT s.path, tag, round(sum(score), 6) AS score FROM sim s JOIN (SELECT path, unnest(tags) AS tag FROM notes) t ON t.path = s.other GROUP BY 1, 2)) WHERE r <= 9"


@query
def entity_index(spark, sf_dir):
    return E.name_index(B.entities(spark, sf_dir)).select("name", "path", "weight")


_INDEX = """ents AS (SELECT c_custkey AS pos, 'customer/' || c_custkey AS path, c_name AS title, c_custkey::VARCHAR AS base, c_mktsegment AS kind FROM customer),
names AS (SELECT path, pos, unnest(list_distinct([title, base, 'c' || base])) AS n, 3 AS weight FROM ents UNION ALL SELECT path, pos, w, 1 FROM (SELECT path, pos, title, unnest(string_split_regex(title, '[^0-9A-Za-zА-Яа-яЁё+-]+')) AS w FROM ents) WHERE length(w) >= 6 AND lower(w) <> lower(title)),
idx AS (SELECT name, path, pos, weight FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, pos) AS r FROM (SELECT trim(replace(lower(n), 'ё', 'е')) AS name, path, pos, weight FROM names) WHERE length(name) >= 3) WHERE r = 1)"""
ORACLES["entity_index"] = f"WITH {_INDEX} SELECT name, path, weight FROM idx"
QUESTION = "what about Customer#000000012 and c345 then"


@query
def find_entities(spark, sf_dir):
    return E.find(E.name_index(B.entities(spark, sf_dir)), QUESTION)


_STEMS = sorted({A.py_stem(w) for w in E._words(QUESTION.lower())})
_FOUND = f"""hits AS (SELECT path, pos, CASE WHEN contains({S.lit(QUESTION.lower())}, name) THEN length(name) * 2 + weight WHEN len(parts) > 0 AND len(list_filter(parts, lambda w: NOT list_contains({_STEMS!r}, {S.stem('w')}))) = 0 THEN length(name) + weight END AS score
FROM (SELECT *, list_filter(string_split_regex(name, '[^0-9a-zа-я]+'), lambda w: length(w) > 2) AS parts FROM idx)),
found AS (SELECT path, max(score)::BIGINT AS score, min(pos) AS pos FROM hits WHERE score IS NOT NULL GROUP BY 1 ORDER BY score DESC, pos LIMIT 3)"""
ORACLES["find_entities"] = f"WITH {_INDEX}, {_FOUND} SELECT path, score FROM found"

_CLAIMS = "cl AS (SELECT 'customer/' || o_custkey AS entity, 'order/' || o_orderkey AS claim, strftime(o_orderdate, '%Y-%m-%d') AS \"at\", CASE WHEN o_orderstatus = 'F' THEN 'obsolete' ELSE 'current' END AS status, o_orderpriority AS kind, o_orderkey AS pos FROM orders), placed AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY status = 'obsolete', \"at\" DESC, pos) AS place FROM cl)"


@query
def claims_of(spark, sf_dir):
    return E.claims_of(B.links(spark, sf_dir), B.claims(spark, sf_dir), ("obsolete",))


ORACLES["claims_of"] = f'WITH {_CLAIMS} SELECT entity, claim, "at", status, place FROM placed'


@query
def entity_answer(spark, sf_dir):
    """For the entities of a question the first twelve claims, how many there are, and entities near by."""
    links = B.links(spark, sf_dir)
    found = E.find(E.name_index(B.entities(spark, sf_dir)), QUESTION)
    claims = E.claims_of(links, B.claims(spark, sf_dir), ("obsolete",), of=found)
    # parts of an order count as what its claim mentions besides
    said = E.answers(found, claims, links.where("type in ('about', 'relates')").withColumn("type", F.lit("about")))
    return said.select("entity", "total", F.array_join("claims", ",").alias("claims"), F.array_join(F.transform("near", lambda x: F.concat_ws(":", x["other"], x["n"].cast("string"))), ",").alias("near"))


ORACLES["entity_answer"] = f"""WITH {_INDEX}, {_FOUND}, {_CLAIMS}, ab AS (SELECT DISTINCT 'customer/' || o_custkey AS entity, 'part/' || l_partkey AS other, l_orderkey AS o FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
nn AS (SELECT entity, other, count(*) AS n FROM ab WHERE entity IN (SELECT path FROM found) GROUP BY 1, 2), near AS (SELECT entity, string_agg(other || ':' || n, ',' ORDER BY n DESC, other) AS near FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, other) AS r FROM nn) WHERE r <= 6 GROUP BY 1)
SELECT p.entity, count(*) AS total, string_agg(claim, ',' ORDER BY place) FILTER (place <= 12) AS claims, coalesce(any_value(near), '') AS near FROM placed p LEFT JOIN near ON near.entity = p.entity WHERE p.entity IN (SELECT path FROM found) GROUP BY 1"""


@query
def co_mentioned(spark, sf_dir):
    """For every part the six that share the most orders with it."""
    of = B.table(spark, sf_dir, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("path"))
    return E.near(B.links(spark, sf_dir), of, kind="relates")


ORACLES["co_mentioned"] = """WITH l AS (SELECT DISTINCT l_orderkey AS o, 'part/' || l_partkey AS p FROM lineitem), n AS (SELECT m.p AS entity, l.p AS other, count(*) AS n FROM l AS m JOIN l ON l.o = m.o AND l.p <> m.p GROUP BY 1, 2)
SELECT entity, other, n FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, other) AS r FROM n) WHERE r <= 6"""


@query
def entity_stats(spark, sf_dir):
    return E.stats(B.entities(spark, sf_dir), B.links(spark, sf_dir))


ORACLES["entity_stats"] = "SELECT c_mktsegment AS kind, count(*) AS total, count(*) FILTER (n > 0) AS with_claims, sum(coalesce(n, 0))::BIGINT AS claims FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1"


@query
def claims_by_kind(spark, sf_dir):
    """Claims by kind in the order of priority, unknown kinds last: how many, how many dead, the newest."""
    kinds = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    order = F.coalesce(F.expr(f"nullif(array_position(array({', '.join(map(repr, kinds))}), kind), 0)"), F.lit(99)).cast("long")
    c = B.claims(spark, sf_dir)
    return c.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(E.dead(F.col("status"), ("obsolete",))).alias("n_dead"), F.max("at").alias("newest")).withColumn("place", order)


ORACLES["claims_by_kind"] = "SELECT o_orderpriority AS kind, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_dead, max(strftime(o_orderdate, '%Y-%m-%d')) AS newest, coalesce(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED'], o_orderpriority), 99)::BIGINT AS place FROM orders GROUP BY 1"


def _one_vector(spark, sf_dir):
    return B.table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))


@query
def vector_topk(spark, sf_dir):
    return V.top(B.table(spark, sf_dir, "embeddings"), _one_vector(spark, sf_dir), 20)


_DOT = "list_dot_product(e.embedding::DOUBLE[], q.q::DOUBLE[]) / sqrt(list_dot_product(q.q::DOUBLE[], q.q::DOUBLE[]))"
_Q = "q AS (SELECT embedding AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
ORACLES["vector_topk"] = f"WITH {_Q} SELECT vec_id, round({_DOT}, 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 20"


@query
def vector_int8_topk(spark, sf_dir):
    """Over vectors kept as whole numbers from -127 to 127."""
    e = B.table(spark, sf_dir, "embeddings").withColumn("embedding", V.quantise(F.col("embedding")))
    return V.top(e, _one_vector(spark, sf_dir), 20, scale=127.0)


_I8 = "list_dot_product(list_transform(e.embedding::DOUBLE[], lambda x: greatest(-127, least(127, floor(x * 127 + 0.5)))::DOUBLE), q.q::DOUBLE[]) / sqrt(list_dot_product(q.q::DOUBLE[], q.q::DOUBLE[])) / 127"
ORACLES["vector_int8_topk"] = f"WITH {_Q} SELECT vec_id, round({_I8}, 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 20"


@query
def vector_best_per_group(spark, sf_dir):
    """The best vector of each label (a path's chunks), the best eight labels."""
    return V.best_per_group(B.table(spark, sf_dir, "embeddings"), _one_vector(spark, sf_dir), "label", 8)


ORACLES["vector_best_per_group"] = f"WITH {_Q}, s AS (SELECT label, vec_id, round({_DOT}, 6) AS score FROM embeddings e, q), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM s) SELECT label, vec_id, score FROM r WHERE r = 1 ORDER BY score DESC, label LIMIT 8"


def _gold(spark, sf_dir, quantised=False):
    """For every twentieth vector as a query the place of the first other vector of its label."""
    e = B.table(spark, sf_dir, "embeddings").where("label is not null")
    return V.first_places(e, e.where("vec_id % 20 = 0"), quantised)


@query
def retrieval_metrics(spark, sf_dir):
    return R.metrics(_gold(spark, sf_dir))


_GOLD = lambda e: f"""s AS (SELECT a.vec_id AS query, a.label AS ql, b.label, b.vec_id, round(list_dot_product({e}, a.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
p AS (SELECT query, min(place) FILTER (label = ql) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS place FROM s) GROUP BY 1)"""  # noqa: E731
_METRICS = "SELECT count(*) AS n, count(*) FILTER (place = 1) AS hit1, count(*) FILTER (place <= 5) AS hit5, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM p"
_PLAIN, _QUANT = "b.embedding::DOUBLE[]", "list_transform(b.embedding::DOUBLE[], lambda x: greatest(-127, least(127, floor(x * 127 + 0.5)))::DOUBLE / 127)"
ORACLES["retrieval_metrics"] = f"WITH {_GOLD(_PLAIN)} {_METRICS}"


@query
def hybrid_verdict(spark, sf_dir):
    """Whether a second ranker wins: mean reciprocal rank better by more than 0.02 and hits in five not fewer."""
    a, b = R.metrics(_gold(spark, sf_dir)), R.metrics(_gold(spark, sf_dir, True))
    both = a.select(F.col("mrr").alias("base_mrr"), F.col("hit5").alias("base_hit5")).crossJoin(b.select("mrr", "hit5"))  # one row each
    return both.withColumn("wins", (F.col("mrr") > F.col("base_mrr") + 0.02) & (F.col("hit5") >= F.col("base_hit5")))


ORACLES["hybrid_verdict"] = f"SELECT a.mrr AS base_mrr, a.hit5 AS base_hit5, b.mrr, b.hit5, b.mrr > a.mrr + 0.02 AND b.hit5 >= a.hit5 AS wins FROM (WITH {_GOLD(_PLAIN)} {_METRICS}) a, (WITH {_GOLD(_QUANT)} {_METRICS}) b"
