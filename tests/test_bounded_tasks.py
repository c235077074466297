"""What one task holds or does does not grow with the tables."""

import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.catalog import documents, text
from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D
from corpusloom.operators import communities as C
from corpusloom.operators import vectors as V
from corpusloom.sources import bindings as B


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_excerpts_cut_a_text_into_pieces_once(spark):
    d = spark.createDataFrame([("word " * 400 + "idiotic end", "x")], "t string, u string")
    cut = d.select(D.excerpt(F.col("t"), A.query_terms("idiot")).alias("f"))
    assert cut._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 1
    assert cut.first().f.endswith("idiotic end")


def test_vectors_meet_queries_in_parts(monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([0] * 10), pa.array([[1.0, 0.0]] * 10)], names=["vec_id", "label", "embedding"])
    monkeypatch.setattr(V, "PRODUCTS", 12)
    assert [p.num_rows for p in V._parts(batch, 4)] == [3, 3, 3, 1]


def test_places_do_not_depend_on_parts(spark, sf, monkeypatch):
    e = B.table(spark, sf, "embeddings").where("label is not null")
    rows = lambda: sorted(map(tuple, V.first_places(e, e.where("vec_id % 20 = 0")).collect()))
    want = rows()
    monkeypatch.setattr(V, "QUERY_BLOCK", 3)
    assert rows() == want and want


def test_links_of_lines_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(B, "LINK_PART", 500)
    n = B.table(spark, sf, "lineitem").count() // 500
    assert "hashpartitioning(l_orderkey" in _plan(B.links(spark, sf)) and f", {n}), REPARTITION_BY_NUM" in _plan(B.links(spark, sf))


def test_stop_words_are_looked_at_once_for_each_word(spark, tmp_path):
    rows = [("en", "The cat and the dog"), ("en", None), ("de", ""), ("fr", None)]
    spark.createDataFrame(rows[:2], "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text.stop_word_share(spark, str(tmp_path))
    assert "Generate explode" in _plan(got)
    kept = sum(w not in A.STOP_WORDS for w in "the cat and the dog".split())
    assert [tuple(r) for r in got.collect()] == [("en", 5, round(1 - kept / 5, 6))]


def test_only_front_matter_goes_to_python(spark, sf):
    got = documents.frontmatter_roundtrip(spark, sf)
    assert got.where("same_body and tags = 'one,two,three'").count() == got.count() > 0
    text_ = "---\r\na: 1\r\n---\r\nbody\n---\n"
    f = spark.createDataFrame([(text_,), ("no front",), (None,)], "t string").select(D.front(F.col("t")).alias("f")).collect()
    assert [r.f for r in f] == ["---\r\na: 1\r\n---\r\n", "", ""]


def test_small_components_are_taken_together(spark, monkeypatch):
    links = [(f"c{k}a{i}", f"c{k}a{j}", 1.0) for k in range(12) for i in range(4 + k % 3) for j in range(i)]
    l = spark.createDataFrame(links, "src string, dst string, w double")
    ends = l.select(F.col("src").alias("path")).union(l.select("dst")).distinct().withColumn("component", F.expr("substring_index(path, 'a', 1)"))
    def rows(df):
        return sorted(tuple(r) for r in df.collect())
    clusters, places = rows(C.modularity_clusters(l, ends)), rows(C.force_layout(l, ends))
    monkeypatch.setattr(C, "AT_ONCE", 1)
    assert rows(C.modularity_clusters(l, ends)) == clusters and rows(C.force_layout(l, ends)) == places
    assert len(clusters) == len(places) == 12 * 5 and "MapInArrow" in _plan(C.force_layout(l, ends))
