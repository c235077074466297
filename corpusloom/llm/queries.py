"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import alignment, decontaminate, embeddings, minhash, mixing, pii, quality, resample, substrings, tokenids, toxicity, urlfilter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.token_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with a span that an earlier document keeps; repeats within one document alone stay."""
    spans = substrings.repeated_spans(_table(spark, sf_dir, "documents"))
    return spans.where(F.exists("owners", lambda o: o != F.col("doc_id")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"), URL_RULES)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment.alignment(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_token_ids": op6_token_ids,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_personal_data": op11_personal_data,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op2_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS place FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight FROM d GROUP BY 1
), o AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
    sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS size_upto,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS weight_upto FROM s
), c AS (
  SELECT *, (total - 3 * (size_upto - source_size)) * weight >= 3 * source_size * (all_weight - weight_upto + weight) AS capped FROM o
), t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE weight *
    ((total - 3 * coalesce(sum(source_size) FILTER (capped) OVER (), 0))::DOUBLE / (all_weight - coalesce(sum(weight) FILTER (capped) OVER (), 0))) END AS target FROM c
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t
), m AS (
  SELECT d.*, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS mid
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM m
""",
    "op3_minhash_dedup": f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
rare AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2),
links AS (SELECT a, b FROM rare WHERE 100 * shared >= 85 * (na + nb - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, w.b FROM reach r JOIN ways w ON r.y = w.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON s.doc_id = c.x
""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (
  SELECT page_id, h, octet_length(payload)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
    array_to_string([['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', h[i])] FOR i IN range(1, 41)], '') AS bits FROM p
)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + 16 * bits[5*i+1]::INT + 8 * bits[5*i+2]::INT + 4 * bits[5*i+3]::INT + 2 * bits[5*i+4]::INT + bits[5*i+5]::INT)::INT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to FROM d
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
g AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.b FROM reach r JOIN links l ON r.y = l.a),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT x AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, x = component_id AS kept FROM c LEFT JOIN n ON n.a = c.x
""",
    "op12_importance_resampling": f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), tw AS (
  SELECT list_filter(string_split_regex(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), runs AS (
  SELECT doc_id, unnest(flatten([[array_to_string(w[i:i+k], ' ') FOR i IN range(1, len(w) - k + 1)] FOR k IN range(0, 3)])) AS f FROM w
), target_runs AS (
  SELECT unnest(flatten([[array_to_string(w[i:i+k], ' ') FOR i IN range(1, len(w) - k + 1)] FOR k IN range(0, 3)])) AS f FROM tw
), steps AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t
), hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM target_runs)),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(0, len(h) // 2)]),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS b FROM hexes, steps
), s AS (SELECT b, count(*) AS s FROM runs JOIN hashed USING (f) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM target_runs JOIN hashed USING (f) GROUP BY 1),
gains AS (
  SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM runs) + 10000)::DOUBLE
    / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target_runs) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (b)
), sums AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN hashed USING (f) JOIN gains USING (b) GROUP BY 1),
scored AS (
  SELECT w.doc_id, len(w.w) >= 20 AS fit, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN sums USING (doc_id)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY fit) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * n // 100 THEN place END AS rank FROM ranked
""",
}
