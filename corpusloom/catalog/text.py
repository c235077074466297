"""Queries: analysis, ranking, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import sqlparts as S
from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D
from corpusloom.operators import finders as N
from corpusloom.operators import rank as R
from corpusloom.sources import bindings as B
from corpusloom.storage import stored

QUERIES: dict = {}
ORACLES: dict = {}
QUERY = "thereon eresinger tionhe idiot"
PREFIX_QUERY = "tionheqq eresinzz worthless"
SYNONYMS = A.parse_synonyms("- idiot, moron, clown\n- moron; scum\n- single\n")


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _docs(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").withColumn("path", B.path_column())


def _notes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", "path", F.col("n_chars").alias("bytes"))


def _all_post(spark, sf_dir):
    return stored(spark, "postings", f"{sf_dir}/documents.parquet", lambda: R.indexed(R.postings(_docs(spark, sf_dir))), "shard")


def _post(spark, sf_dir, text, synonyms=()):
    """The postings that a query can meet, of the stored index."""
    return R.lookup(_all_post(spark, sf_dir), A.query_terms(text, synonyms))


def _chunks(spark, sf_dir):
    return stored(spark, "chunks", f"{sf_dir}/documents.parquet", lambda: B.chunks(spark, sf_dir))


def _chunk_words(spark, sf_dir):
    return stored(spark, "chunk-words", f"{sf_dir}/documents.parquet", lambda: R.indexed(R.chunk_words(_chunks(spark, sf_dir)), term="key"), "shard")


def _ranked(spark, sf_dir, text, limit):
    """The chunk ranker over stored chunks and the stored index of their words."""
    return R.rank_chunks(_chunks(spark, sf_dir), text, limit, index=_chunk_words(spark, sf_dir))


@query
def stored_chunk_words(spark, sf_dir):
    """How many words of chunks the stored index has; the first query of a session makes it."""
    return _chunk_words(spark, sf_dir).agg(F.count_if(F.col("key") == F.col("s")).alias("n_words"))


@query
def stored_postings(spark, sf_dir):
    """How many postings and keys the stored index has; the first query of a session makes it."""
    return _all_post(spark, sf_dir).agg(F.count("*").alias("n_postings"), F.count_distinct("term").alias("n_terms"))


_META = f"SELECT doc_id, unnest({S.words('path')}) AS w FROM (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents)"
ORACLES["stored_postings"] = f"WITH {S.POSTINGS}, mk AS (SELECT doc_id, unnest(list_distinct([s, {S.translit('s')}])) AS term FROM (SELECT doc_id, {S.stem('w')} AS s FROM ({_META}))), p AS (SELECT doc_id, term FROM postings UNION SELECT doc_id, term FROM mk) SELECT count(*) AS n_postings, count(DISTINCT term) AS n_terms FROM p"


@query
def tokens_per_doc(spark, sf_dir):
    t = A.tokens(F.col("text"))
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


ORACLES["tokens_per_doc"] = f"SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)"


@query
def stem_df(spark, sf_dir):
    return R.term_counts(B.table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("n"))


ORACLES["stem_df"] = f"WITH {S.POSTINGS} SELECT term, count(*) AS df, sum(n)::BIGINT AS n FROM postings GROUP BY 1"


@query
def stop_word_share(spark, sf_dir):
    """Words are counted by language before they are told apart, so each different word is looked at once for a language."""
    d = B.table(spark, sf_dir, "documents").select("lang", F.explode_outer(F.split(F.lower("text"), A.SEPARATOR)).alias("w"))
    d = d.groupBy("lang", "w").agg(F.count("*").alias("n"))
    some = lambda c: F.sum(F.when(c, F.col("n")).when(F.col("w").isNotNull(), 0))
    d = d.groupBy("lang").agg(some(F.length("w") >= 2).alias("n_words"), some(A.is_token(F.col("w"))).alias("kept"))
    return d.select("lang", "n_words", F.round(1 - F.col("kept") / F.col("n_words"), 6).alias("stop_share"))


ORACLES["stop_word_share"] = f"""SELECT lang, sum(n)::BIGINT AS n_words, round(1 - sum(k) / sum(n)::DOUBLE, 6) AS stop_share FROM (
  SELECT lang, len(list_filter(string_split_regex(lower(text), '{A.SEPARATOR}'), lambda w: length(w) >= 2)) AS n, len({S.words('text')}) AS k FROM documents) GROUP BY 1"""


@query
def chunk_stems(spark, sf_dir):
    p = R.prepare_chunks(B.chunks(spark, sf_dir))
    return p.select("doc_id", "i", F.size("body").cast("long").alias("n_body"), F.size("meta").cast("long").alias("n_meta"))


_LINES = "lines AS (SELECT doc_id, lang, source, lang || '/' || source || '/' || doc_id || '.md' AS path, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents)), chunks AS (SELECT * FROM lines WHERE trim(t) <> '')"
ORACLES["stored_chunk_words"] = f"WITH {_LINES} SELECT count(*) AS n_words FROM (SELECT unnest(list_distinct(list_concat({S.words('t')}, {S.words("lang || ' ' || source || ' ' || path")}))) FROM chunks)"
_keys = lambda x: f"list_distinct(flatten(list_transform(list_distinct({S.words(x)}), lambda w: list_distinct([{S.stem('w')}, {S.translit(S.stem('w'))}]))))"
ORACLES["chunk_stems"] = f"WITH {_LINES} SELECT doc_id, i::BIGINT AS i, len({_keys('t')})::BIGINT AS n_body, len({_keys(chr(39) + chr(39) + ' || lang || chr(32) || source || chr(32) || path')})::BIGINT AS n_meta FROM chunks"


@query
def heading_chain(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    chain = F.concat_ws(" › ", F.concat(F.lit("conversation "), "conv_id"), "role")
    return c.select("conv_id", "turn", chain.alias("chain"))


ORACLES["heading_chain"] = "SELECT conv_id, turn, 'conversation ' || conv_id || ' › ' || role AS chain FROM conversations"


def _bm25_sql(text: str, limit: int, synonyms=(), fallback=True) -> str:
    terms = A.query_terms(text, synonyms)
    rows = S.values([(i, v) for i, t in enumerate(terms) for v in t], "term_no, variant")
    near = f"""UNION ALL SELECT p.*, q.term_no, {S.match('p.term', 'q.variant')} FROM post p JOIN q ON left(p.term, 4) = left(q.variant, 4) AND p.term <> q.variant
    WHERE {S.match('p.term', 'q.variant')} > 0 AND q.variant NOT IN (SELECT term FROM post)""" if fallback else ""
    meta = f"SELECT doc_id, unnest({S.words('path')}) AS w FROM (SELECT doc_id, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents)"
    return f"""WITH {S.POSTINGS}, mt AS ({meta}), mk AS (SELECT doc_id, unnest(list_distinct([s, {S.translit('s')}])) AS term FROM (SELECT doc_id, {S.stem('w')} AS s FROM mt)),
m AS (SELECT doc_id, term, least(count(*), 9) AS n FROM mk GROUP BY 1, 2),
post AS (SELECT coalesce(p.doc_id, m.doc_id) AS doc_id, coalesce(p.term, m.term) AS term, CASE WHEN p.n > 0 THEN pow(2.0, least(floor(log2(p.n)), 8)) ELSE 0 END AS tb, coalesce(m.n, 0) AS tm
  FROM postings p FULL JOIN m ON p.doc_id = m.doc_id AND p.term = m.term),
q AS (SELECT * FROM {rows}),
hit AS (SELECT p.*, q.term_no, 1.0::DOUBLE AS f FROM post p JOIN q ON p.term = q.variant {near}),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM hit GROUP BY 1),
n AS (SELECT count(*) AS N, avg(CASE WHEN n_chars > 0 THEN n_chars ELSE 1 END) AS a FROM documents),
w AS (SELECT h.doc_id, h.term_no, max(ln(1 + (N - df + 0.5) / (df + 0.5)) * (CASE WHEN tb > 0 THEN tb * 2.4 / (tb + 1.4 * (0.7 + 0.3 * (CASE WHEN n_chars > 0 THEN n_chars ELSE a END) / a)) ELSE 0 END + tm * 2.2) * f) AS w
  FROM hit h JOIN d ON h.term = d.term JOIN documents o ON o.doc_id = h.doc_id CROSS JOIN n GROUP BY 1, 2),
s AS (SELECT w.doc_id, o.lang || '/' || o.source || '/' || o.doc_id || '.md' AS path, sum(w) AS s, count(*) AS hits FROM w JOIN documents o ON o.doc_id = w.doc_id WHERE w > 0 GROUP BY 1, 2)
SELECT doc_id, path, hits, round(hits / {len(terms)}::DOUBLE, 6) AS coverage, round(s * (hits / {len(terms)}::DOUBLE) * (hits / {len(terms)}::DOUBLE) * {S.authority('path')}, 6) AS rank
FROM s ORDER BY rank DESC, doc_id LIMIT {limit}"""


@query
def bm25_search(spark, sf_dir):
    return R.bm25(_post(spark, sf_dir, QUERY), _notes(spark, sf_dir), QUERY, 20)


@query
def bm25_prefix_fallback(spark, sf_dir):
    return R.bm25(_post(spark, sf_dir, PREFIX_QUERY), _notes(spark, sf_dir), PREFIX_QUERY, 25)


@query
def synonym_expansion(spark, sf_dir):
    return R.bm25(_post(spark, sf_dir, "idiot threat", SYNONYMS), _notes(spark, sf_dir), "idiot threat", 25, synonyms=SYNONYMS, prefix_fallback=False)


ORACLES["bm25_search"] = _bm25_sql(QUERY, 20)
ORACLES["bm25_prefix_fallback"] = _bm25_sql(PREFIX_QUERY, 25)
ORACLES["synonym_expansion"] = _bm25_sql("idiot threat", 25, SYNONYMS, False)


@query
def rank_chunks(spark, sf_dir):
    return _ranked(spark, sf_dir, QUERY, 20).drop("chain", "t")


def _chunks_sql(text: str, limit: int) -> str:
    terms = A.query_terms(text)
    n = len(terms)
    best = lambda keys, t: "coalesce(list_max(list_transform(" + keys + ", lambda k: greatest(" + ", ".join(S.match("k", S.lit(v)) for v in t) + ", 0.0))), 0)"
    cols = ", ".join(f"greatest({best('meta', t)} * 1.35, {best('body', t)} * 1.0) AS c{k}" for k, t in enumerate(terms))
    return f"""WITH {_LINES}, p AS (SELECT path, i, {_keys('t')} AS body, {_keys("lang || ' ' || source || ' ' || path")} AS meta FROM chunks),
f AS (SELECT path, i, {cols} FROM p), d AS (SELECT count(*) AS N, {', '.join(f'count(*) FILTER (c{k} > 0) AS d{k}' for k in range(n))} FROM f),
s AS (SELECT path, i, {' + '.join(f'(c{k} > 0)::INT' for k in range(n))} AS hits, {' + '.join(f'c{k} * ln(1 + N / (1 + d{k})::DOUBLE)' for k in range(n))} AS s FROM f CROSS JOIN d WHERE {' OR '.join(f'c{k} > 0' for k in range(n))}),
t AS (SELECT path, i, hits, hits / {n}::DOUBLE AS coverage, round(s * (hits / {n}::DOUBLE) * (hits / {n}::DOUBLE), 9) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, i) AS place, count(*) OVER (PARTITION BY path) AS n FROM t)
SELECT path, i::BIGINT AS i, hits::BIGINT AS hits, round(coverage, 6) AS coverage, (n - 1)::BIGINT AS more, round((score + ln(n) * 0.35) * {S.authority('path')}, 6) AS rank
FROM r WHERE place = 1 ORDER BY rank DESC, path LIMIT {limit}"""


ORACLES["rank_chunks"] = _chunks_sql(QUERY, 20)


def _found_sql(text: str, limit: int, chain: str = "''") -> str:
    """The best files with the excerpt `frag` of their best chunk."""
    best = f"(SELECT r.*, c.t, c.chain FROM ({_chunks_sql(text, limit)}) r JOIN (WITH {_LINES} SELECT path, i, t, {chain} AS chain FROM chunks) c ON r.path = c.path AND r.i = c.i)"
    return S.excerpt(best, A.query_terms(text))


def _two_lists(spark, sf_dir):
    post, notes = _post(spark, sf_dir, QUERY + " worthless threat"), _notes(spark, sf_dir)
    # result lists of at most 25 rows
    one = R.placed(R.bm25(post, notes, QUERY, 25), F.desc("rank"), "doc_id")
    two = R.placed(R.bm25(post, notes, "worthless threat", 25), F.desc("rank"), "doc_id")
    return [one, two]


def _fuse_sql(weights: tuple[float, float]) -> str:
    part = lambda q, i, w: f"SELECT path, {i} AS l, {w}::DOUBLE / (60 + row_number() OVER (ORDER BY rank DESC, doc_id)) AS w FROM ({_bm25_sql(q, 25)})"
    return f"SELECT path, round(sum(w), 5) AS rrf, min(l) AS first_list FROM ({part(QUERY, 0, weights[0])} UNION ALL {part('worthless threat', 1, weights[1])}) GROUP BY 1 ORDER BY rrf DESC, path LIMIT 25"


@query
def rrf_fusion(spark, sf_dir):
    return R.fuse(_two_lists(spark, sf_dir))


@query
def rrf_weighted(spark, sf_dir):
    return R.fuse(_two_lists(spark, sf_dir), weights=[1.0, 0.5])


ORACLES["rrf_fusion"] = _fuse_sql((1.0, 1.0))
ORACLES["rrf_weighted"] = _fuse_sql((1.0, 0.5))


@query
def ranker_parity_diff(spark, sf_dir):
    """Top six of two settings of the ranker: what each has that the other has not."""
    post, notes = _post(spark, sf_dir, PREFIX_QUERY), _notes(spark, sf_dir)
    top = lambda **o: R.placed(R.bm25(post, notes, PREFIX_QUERY, 6, **o), F.desc("rank"), "doc_id")
    a, b = top(), top(prefix_fallback=False)
    return a.exceptAll(b).withColumn("side", F.lit("prefix")).unionByName(b.exceptAll(a).withColumn("side", F.lit("exact")))


_top = lambda fb: f"SELECT path, row_number() OVER (ORDER BY rank DESC, doc_id) - 1 AS place FROM ({_bm25_sql(PREFIX_QUERY, 6, fallback=fb)})"
ORACLES["ranker_parity_diff"] = f"WITH a AS ({_top(True)}), b AS ({_top(False)}) SELECT *, 'prefix' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'exact' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"


@query
def context_pack(spark, sf_dir):
    """The best eight files for a question, with their best chunks, as one text; a rough count of tokens."""
    r = _ranked(spark, sf_dir, QUERY, 8)
    r = r.select("path", "chain", "rank", D.excerpt(F.col("t"), A.query_terms(QUERY)).alias("frag"))
    return N.pack(r).select(F.lit(QUERY).alias("question"), "context", "tokens")


_CHAIN = "lang || chr(32) || chr(8250) || chr(32) || source"
ORACLES["context_pack"] = f"""SELECT question, context, round(length(context) / 3.0)::BIGINT AS tokens FROM (SELECT {S.lit(QUERY)} AS question,
  string_agg('--- ' || path || ' › ' || chain || ' ---' || chr(10) || frag, chr(10) || chr(10) ORDER BY rank DESC, path) AS context FROM {_found_sql(QUERY, 8, _CHAIN)})"""
SYSTEM = "Answer from the fragments only and name the files."


@query
def chat_prompt(spark, sf_dir):
    """A question and what was found for it, as one text for a chat."""
    return context_pack(spark, sf_dir).select(N.prompt(F.col("question"), F.col("context"), SYSTEM).alias("prompt"))


ORACLES["chat_prompt"] = f"SELECT {S.lit(SYSTEM)} || chr(10) || chr(10) || '=== ФРАГМЕНТЫ ИЗ ПАМЯТИ ===' || chr(10) || chr(10) || context || chr(10) || chr(10) || '=== ВОПРОС ===' || chr(10) || chr(10) || question AS prompt FROM ({ORACLES['context_pack']})"


@query
def search_chunks(spark, sf_dir):
    """The best files with the chain and an excerpt of their best chunk, and how many more they have."""
    found = _ranked(spark, sf_dir, QUERY, 20)
    return found.select("path", "i", "hits", "coverage", "more", "rank", "chain", D.excerpt(F.col("t"), A.query_terms(QUERY)).alias("frag"))


ORACLES["search_chunks"] = f"SELECT path, i, hits, coverage, more, rank, chain, frag FROM {_found_sql(QUERY, 20, _CHAIN)}"


@query
def search_with_snippets(spark, sf_dir):
    """Ranked documents, the first five with an excerpt of their text without the front matter; others have none."""
    found = bm25_search(spark, sf_dir)
    return R.with_snippets(found, _docs(spark, sf_dir).select("doc_id", "text"), "doc_id", QUERY)


ORACLES["search_with_snippets"] = f"""WITH f AS ({_bm25_sql(QUERY, 20)}), s AS (SELECT f.doc_id, regexp_replace(text, '\\A---\\n[\\s\\S]*?\\n---\\n?', '') AS t FROM (SELECT * FROM f ORDER BY rank DESC, doc_id LIMIT 5) f JOIN documents d ON d.doc_id = f.doc_id)
SELECT f.*, x.frag FROM f LEFT JOIN {S.excerpt('s', A.query_terms(QUERY))} x ON x.doc_id = f.doc_id"""
