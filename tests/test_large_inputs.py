"""What larger tables or longer texts must not change."""

import random

from pyspark.sql import functions as F

from corpusloom.catalog import documents
from corpusloom.functions import docs as D
from corpusloom.operators import rank as R
from corpusloom.operators import similar as X


def _whole_table(a, b):
    """Steps of a difference by the whole table of longest common subsequences."""
    longest = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            longest[i][j] = longest[i + 1][j + 1] + 1 if a[i] == b[j] else max(longest[i + 1][j], longest[i][j + 1])
    steps, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append(("same", a[i]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and longest[i + 1][j] >= longest[i][j + 1]:
            steps.append(("del", a[i]))
            i += 1
        else:
            steps.append(("add", b[j]))
            j += 1
    return steps


def test_long_texts_are_compared_in_full():
    long = [f"line {i}" for i in range(900)]
    assert [k for k, _ in D.diff("\n".join(long), "\n".join(long[:1] + long[2:]))] == ["same", "del", "same"]
    r = random.Random(1)
    for _ in range(400):
        a, b = (r.choices("abcdef"[: r.randint(1, 6)], k=r.randint(1, 30)) for _ in range(2))
        assert list(D._edit_steps(a, b)) == _whole_table(a, b)


def test_line_diff_of_long_documents(spark, tmp_path):
    long = "\n".join(f"line {i % 7}" for i in range(900))
    rows = [(1, long), (2, "a\nb\nc\n\x0b\n"), (3, "a\nb\nc\n\u0085"), (4, "a\nb\nc\n \n"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in documents.line_diff(spark, str(tmp_path)).select("doc_id", "n_deleted", "n_added").collect()}
    assert got == {(1, 1, 0), (2, 1, 0), (3, 1, 0)}


def test_stream_of_changes_keeps_no_rows_in_the_driver(spark, tmp_path):
    e = spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 40_000).cast("timestamp_ntz").alias("ts"), (F.col("id") % 5).alias("user_id"))
    e.repartition(1).write.parquet(f"{tmp_path}/events.parquet")
    before = {t.name for t in spark.catalog.listTables()}
    got = documents.change_feed_stream(spark, str(tmp_path))
    assert {t.name for t in spark.catalog.listTables()} == before  # a table in memory is the driver's
    assert 1990 < got.count() < 2000 and got.where("n <> 1").count() == 0


def test_similar_by_words_has_the_rows_of_all_pairs(spark, monkeypatch):
    r = random.Random(4)
    words = spark.createDataFrame(sorted({(i, f"w{int(r.expovariate(0.12))}") for i in range(300) for _ in range(8)}), "path long, term string")
    tags = [None, [], ["a"], ["a", "b"], ["b", "c"]]
    rows = [(i, f"n{i * 7919 % 300:03d}", r.choice(tags), r.randint(0, 3), r.random() < 0.2, r.random() < 0.8) for i in range(300)]
    notes = spark.createDataFrame(rows, "path long, name string, tags array<string>, deg int, chronicle boolean, shown boolean")
    want = sorted(map(tuple, X.similar_with_tags([X.keyword_part(words, 300, others=notes.where("shown"))], notes, 5).collect()))
    for asking, found in ((65_536, 131_072), (100, 70)):  # one pair of blocks, and fifteen
        monkeypatch.setattr(X, "ASKING", asking)
        monkeypatch.setattr(X, "FOUND", found)
        got = X.similar_by_words(words, notes, 300, 5)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # pairs of notes with a common keyword are no rows


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_are_counted_where_their_text_is(spark):
    docs = spark.createDataFrame([(1, "a/one two.md", "Ones ones oning налоги two two two"), (2, "b.md", None), (3, "c/one.md", "x")], "doc_id long, path string, text string")
    got = {(r.doc_id, r.term): (r.tf_body, r.tf_meta) for r in R.postings(docs).collect()}
    assert got == {(1, "ones"): (2.0, 0), (1, "oning"): (1.0, 0), (1, "налог"): (1.0, 0), (1, "nalog"): (1.0, 0), (1, "two"): (2.0, 1), (1, "one"): (0.0, 1), (1, "md"): (0.0, 1), (2, "md"): (0.0, 1), (3, "one"): (0.0, 1), (3, "md"): (0.0, 1)}
    assert _exchanges(R.postings(docs)) == 1 and _exchanges(R.term_counts(docs, "doc_id", "text")) == 1  # the texts; no row of a word moves


def test_words_of_a_chunk_are_told_apart_in_its_row(spark):
    chunks = spark.createDataFrame([("a/two.md", 0, ["en", "two"], "two three three"), ("b.md", 1, [], None)], "path string, i long, h array<string>, t string")
    words = R.chunk_words(chunks)
    assert sorted((r.path, r.w, r.weight) for r in words.collect()) == [("a/two.md", "en", 1.35), ("a/two.md", "md", 1.35), ("a/two.md", "three", 1.0), ("a/two.md", "two", 1.35), ("b.md", "md", 1.35)]
    assert _exchanges(words) == 0
