"""Full-text ranking: postings, BM25 over notes, the chunk ranker, fusion of lists, retrieval metrics."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D

K1, B, META = 1.4, 0.3, 2.2
BODY_WEIGHT, META_WEIGHT, MORE_WEIGHT = 1.0, 1.35, 0.35
RRF_K = 60
#: Folders of a stored index; more for a larger corpus.
SHARDS = 32
#: Characters of the texts whose words one task counts.
TEXT_PART = 24 << 20


def _dealt(docs: DataFrame, key: str, *texts: str) -> DataFrame:
    """The texts of docs dealt by key, so that the words of a document are counted where its text is: a text is smaller
    than rows of its words. As many parts as keep the words of a part (TEXT_PART characters) in memory."""
    size = docs.agg(F.coalesce(F.sum(F.length(texts[0])), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select(key, *texts).repartition(max(least, size // TEXT_PART), key)


def _counts(docs: DataFrame, key: str, texts: dict[str, str], only: list[list[str]] | None) -> DataFrame:
    """(key, term, and how often it occurs in each of the texts: name -> column). Words are counted per document before they
    are stemmed, so a word of a document is stemmed once; neither count moves a row. only: leave out words that cannot
    match a query's terms (the lists of all that can are whole)."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("of"), F.col(c).alias("text")) for name, c in texts.items()))).alias("x")
    words = _dealt(docs, key, *texts.values()).select(key, each).select(key, F.col("x.of").alias("of"), F.explode(A.words(F.col("x.text"))).alias("w")).where(A.is_token(F.col("w")))
    words = words if only is None else words.where(A.may_match(F.col("w"), only))
    words = words.groupBy(key, "w").agg(*(F.count_if(F.col("of") == name).alias(name) for name in texts))
    return words.select(key, F.explode(A.keys_of(F.col("w"))).alias("term"), *texts).groupBy(key, "term").agg(*(F.sum(name).alias(name) for name in texts))


def term_counts(docs: DataFrame, key: str, text: str, only: list[list[str]] | None = None) -> DataFrame:
    """(key, term, n) of a text column."""
    return _counts(docs, key, {"n": text}, only)


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text", meta: str | None = "path", only: list[list[str]] | None = None) -> DataFrame:
    """(key, term, tf_body, tf_meta). Body counts are kept on a scale of powers of two, meta counts up to nine."""
    both = _counts(docs, key, {"body": text} if meta is None else {"body": text, "meta": meta}, only)
    body = F.when(F.col("body") > 0, F.pow(F.lit(2.0), F.least(F.floor(F.log2("body")), F.lit(8)))).otherwise(0.0)
    return both.select(key, "term", body.alias("tf_body"), (F.lit(0).cast("long") if meta is None else F.least("meta", F.lit(9))).alias("tf_meta"))


def _head(word: Column) -> Column:
    return F.substring(word, 1, 4)


def _shard(head: Column, shards: int) -> Column:
    return F.pmod(F.crc32(head), F.lit(shards)).cast("int")


def indexed(post: DataFrame, shards: int = SHARDS, term: str = "term") -> DataFrame:
    """Postings with head (the first letters of the key) and shard (by the head), dealt and sorted to be stored by shard.

    A query reads the shards of its heads, which hold its keys and all keys that begin like them. A hot shard is
    dealt to several tasks.
    """
    p = post.withColumn("head", _head(F.col(term))).withColumn("shard", _shard(F.col("head"), shards))
    return p.repartition("shard", F.pmod(F.xxhash64(term), F.lit(4))).sortWithinPartitions("shard", term)


def lookup(stored: DataFrame, terms: list[list[str]], shards: int = SHARDS) -> DataFrame:
    """The rows of a stored index that a query can meet; both filters are literals that reach the scan."""
    heads = sorted({v[:4] for t in terms for v in t})
    found = stored.where(F.col("shard").isin(sorted({zlib.crc32(h.encode()) % shards for h in heads})) & F.col("head").isin(heads))
    return found.drop("head", "shard")


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(path, i, w, weight, s, t, key): the words of chunks (path, i, h, t), each with its keys s and t, once for each key.
    A word of the headings or the path has their weight; the words of a chunk are told apart in its row."""
    of = lambda text: F.array_distinct(A.tokens(text))
    c = chunks.select("path", "i", of(F.col("t")).alias("body"), of(F.concat(F.concat_ws(" ", "h"), F.lit(" "), F.col("path"))).alias("meta"))
    weighed = lambda ws, weight: F.transform(ws, lambda w: F.struct(w.alias("w"), F.lit(weight).alias("weight")))
    words = c.select("path", "i", F.inline(F.concat(weighed(F.col("meta"), META_WEIGHT), weighed(F.array_except("body", "meta"), BODY_WEIGHT))))
    keyed = words.withColumn("s", A.stem(F.col("w"))).withColumn("t", A.translit(F.col("s")))
    return keyed.withColumn("key", F.explode(F.array_distinct(F.array("s", "t"))))


def terms_table(spark, terms: list[list[str]]) -> DataFrame:
    """(term_no, variant): a few rows of a query."""
    rows = [(i, v) for i, t in enumerate(terms) for v in t]
    return spark.createDataFrame(rows, "term_no int, variant string")


def matching_postings(post: DataFrame, terms: list[list[str]], prefix_fallback: bool = True, same_shard: int | None = None) -> DataFrame:
    """Postings of the query's variants with term_no and the factor of the match.

    A variant that is a key of the dictionary matches itself only; one that is not matches the keys with
    which it shares its first letters. The literal prefixes are a filter that reaches the scan, and the
    join with the variants is on the first four letters, never on all pairs.
    """
    spark = post.sparkSession
    variants = sorted({v for t in terms for v in t})
    near = F.col("term").isin(variants)
    if prefix_fallback:
        near = near | F.substring("term", 1, 4).isin(sorted({v[:4] for v in variants if len(v) >= 4}))
    cand = post.where(near)
    q = F.broadcast(terms_table(spark, terms).withColumn("head", F.substring("variant", 1, 4)))  # a query's words
    hit = cand.withColumn("head", F.substring("term", 1, 4)).join(q, "head").drop("head")
    exact = hit.where("term = variant").withColumn("factor", F.lit(1.0))
    if not prefix_fallback:
        return exact
    known = exact.select("variant").distinct()
    rest = hit.where("term <> variant").withColumn("factor", A.stems_match(F.col("term"), F.col("variant"))).where("factor > 0").join(known, "variant", "left_anti")
    if same_shard:
        rest = rest.where(F.pmod(A.fold_hash(F.col("term")), F.lit(same_shard)) == F.pmod(A.fold_hash(F.col("variant")), F.lit(same_shard)))
    return exact.unionByName(rest)


def bm25(post: DataFrame, notes: DataFrame, query: str, limit: int = 25, key: str = "doc_id", synonyms=(), **options) -> DataFrame:
    """The best notes for a query: key, path, hits, coverage, rank.

    post: (key, term, tf_body, tf_meta); notes: (key, path, bytes). df is of each key. The best variant
    counts for each word, words add up, the sum goes with the square of the share of words found and
    the path's authority. Ties go by key.
    """
    terms = A.query_terms(query, synonyms)
    n_terms = max(len(terms), 1)
    hit = matching_postings(post, terms, **options)
    df = hit.select("term", key).distinct().groupBy("term").agg(F.count("*").alias("df"))
    size = notes.agg(F.count("*").alias("N"), F.avg(F.when(F.col("bytes") > 0, F.col("bytes")).otherwise(1)).alias("avg_len"))
    scored = hit.join(df, "term").join(notes.select(key, "path", "bytes"), key).crossJoin(F.broadcast(size))  # one row
    length = F.when(F.col("bytes") > 0, F.col("bytes")).otherwise(F.col("avg_len"))
    tf = F.col("tf_body")
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(tf > 0, tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))).otherwise(0.0)
    scored = scored.withColumn("w", idf * (part + F.col("tf_meta") * META) * F.col("factor")).where("w > 0")
    best = scored.groupBy(key, "path", "term_no").agg(F.max("w").alias("w"))
    notes_ = best.groupBy(key, "path").agg(F.sum("w").alias("s"), F.count("*").alias("hits"))
    coverage = F.col("hits") / n_terms
    out = notes_.withColumn("coverage", coverage).withColumn("rank", F.round(F.col("s") * coverage * coverage * A.authority(F.col("path")), 6))
    return out.orderBy(F.desc("rank"), key).limit(limit).select(key, "path", "hits", F.round("coverage", 6).alias("coverage"), "rank")


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """Adds the keys of the text (body) and of headings and path (meta)."""
    return chunks.withColumns({"body": A.stems(F.col("t")), "meta": A.stems(F.concat(F.concat_ws(" ", "h"), F.lit(" "), F.col("path")))})


def _contribution(variants: list[str]) -> Column:
    """The best match of any variant with the keys s and t of a word."""
    one = lambda k: [A.stems_match(F.col(k), F.lit(v)) for v in variants]
    return F.greatest(*one("s"), *one("t"), F.lit(0.0))


def rank_chunks(chunks: DataFrame, query: str, limit: int = 20, synonyms=(), index: DataFrame | None = None) -> DataFrame:
    """The best files for a query by their best chunk: path, i, hits, coverage, more, rank, chain, t.

    chunks: (path, i, h, t). A word's weight is ln(1 + N / (1 + chunks that have it)). The first of equal
    chunks stands for its file; further chunks add the logarithm of their number. A stem keeps the first
    four letters of its word, so words that begin otherwise are dropped before they are stemmed, and only
    the rest is grouped by chunk. index: the stored `chunk_words` of these chunks, of which only the shards
    of the query's words are read; without it words are taken from the chunks.
    """
    terms = A.query_terms(query, synonyms)
    n = len(terms)
    cols = [f"c{k}" for k in range(n)]
    if index is not None:
        keyed = lookup(index, terms)
    else:
        word = lambda text, weight: chunks.select("path", "i", F.explode(A.words(text)).alias("w"), F.lit(weight).alias("weight")).where(A.is_token(F.col("w")))
        words = word(F.col("t"), BODY_WEIGHT).unionByName(word(F.concat(F.concat_ws(" ", "h"), F.lit(" "), F.col("path")), META_WEIGHT))
        words = words.where(A.may_match(F.col("w"), terms)).groupBy("path", "i", "w").agg(F.max("weight").alias("weight"))
        keyed = words.withColumn("s", A.stem(F.col("w"))).withColumn("t", A.translit(F.col("s")))
    each = keyed.select("path", "i", *((_contribution(t) * F.col("weight")).alias(c) for t, c in zip(terms, cols)))
    found = each.groupBy("path", "i").agg(*(F.max(c).alias(c) for c in cols)).where(" or ".join(f"{c} > 0" for c in cols))
    df = found.agg(*(F.count_if(F.col(c) > 0).alias(f"d{k}") for k, c in enumerate(cols))).crossJoin(chunks.agg(F.count("*").alias("N")))
    both = found.crossJoin(F.broadcast(df))  # one row
    idf = lambda k: F.log(1 + F.greatest(F.col("N"), F.lit(1)) / (1 + F.col(f"d{k}")))
    hits = sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in cols), F.lit(0))
    score = sum((F.col(c) * idf(k) for k, c in enumerate(cols)), F.lit(0.0))
    coverage = hits / n
    scored = both.select("path", "i", hits.cast("long").alias("hits"), coverage.alias("coverage"), F.round(score * coverage * coverage, 9).alias("score"))
    files = scored.groupBy("path").agg(F.max_by(F.struct("i", "hits", "coverage", "score"), F.struct(F.col("score"), -F.col("i"))).alias("best"), F.count("*").alias("n"))
    rank = (F.col("best.score") + F.log1p(F.col("n") - 1) * MORE_WEIGHT) * A.authority(F.col("path"))
    out = files.select("path", "best.i", "best.hits", F.round("best.coverage", 6).alias("coverage"), (F.col("n") - 1).alias("more"), F.round(rank, 6).alias("rank"))
    top = out.orderBy(F.desc("rank"), "path").limit(limit)
    # texts are fetched for the few that are shown
    return chunks.join(F.broadcast(top), ["path", "i"]).select(*top.columns, F.concat_ws(" › ", "h").alias("chain"), "t")


def with_snippets(found: DataFrame, texts: DataFrame, key: str, query: str, count: int = 5, synonyms=()) -> DataFrame:
    """Adds frag: for the `count` best rows (by rank, then key) an excerpt of their text without its front matter, else null.

    found is a bounded top list; only the chosen rows meet texts, which has (key, text).
    """
    chosen = found.orderBy(F.desc("rank"), key).limit(count).select(key)
    cut = D.excerpt(D.without_front_matter(F.col("text")), A.query_terms(query, synonyms))
    return found.join(F.broadcast(texts.join(F.broadcast(chosen), key).select(key, cut.alias("frag"))), key, "left")


def hybrid(words: DataFrame, near: Callable[[], DataFrame] | None) -> DataFrame:
    """Placed results by words and by vectors, fused. `near` makes the second; the words stand alone where there is
    none or where it raises ValueError, as it does for vectors of another length or model."""
    try:
        second = [] if near is None else [near()]
    except ValueError:
        second = []
    return fuse([words, *second])


def fuse(lists: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None, limit: int = 25) -> DataFrame:
    """Reciprocal rank fusion of lists of (path, place from 0): path, rrf, first_list."""
    parts = [df.select("path", F.lit(i).alias("list"), (F.lit(float(weights[i] if weights else 1.0)) / (k + F.col("place") + 1)).alias("w")) for i, df in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    out = every.groupBy("path").agg(F.round(F.sum("w"), 5).alias("rrf"), F.min("list").alias("first_list"))
    return out.orderBy(F.desc("rrf"), "path").limit(limit)


def placed(ranked: DataFrame, *order) -> DataFrame:
    """(path, place from 0) of a ranked list of bounded length."""
    return ranked.select("path", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("place"))


def metrics(places: DataFrame) -> DataFrame:
    """From (query, place of the first accepted result from 1, or null): n, hit1, hit5, mrr."""
    return places.agg(F.count("*").alias("n"), F.count_if(F.col("place") == 1).alias("hit1"), F.count_if(F.col("place") <= 5).alias("hit5"), F.round(F.avg(F.coalesce(1 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
