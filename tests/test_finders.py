"""Pickers, selections, edits: edge cases on small tables."""

from pyspark.sql import functions as F

from corpusloom.functions import docs as D
from corpusloom.functions import edits as E
from corpusloom.operators import finders as N


def _notes(spark):
    rows = [(0, "a/Alpha.md", "Alpha", "alpha", ["x/y"], None), (1, "b/Beta.md", "Beta", "beta", ["x"], "2024-01-02"), (2, "Gamma.md", "Gamma", "gamma", [], "2024-01-01")]
    return spark.createDataFrame(rows, "pos long, path string, title string, base string, tags array<string>, at string").withColumn("aliases", F.array(F.lit("al")))


def test_palette_and_picker(spark):
    n = _notes(spark)
    assert [r.pos for r in N.palette(n, "BETA", F.col("at")).collect()] == [1]
    assert [r.pos for r in N.palette(n, "", F.col("at")).collect()] == [1, 2, 0]
    assert N.pick(n, "a").count() == 0 and N.pick(n, "AL").count() == 3


def test_cards_pages_and_ranges(spark):
    n = _notes(spark)
    assert {r.pos for r in N.cards(n, "x").collect()} == {0, 1}
    assert {r.pos for r in N.cards(n, "x", "beta").collect()} == {1}
    assert [r.pos for r in N.page(n, ["pos"], 1, 1).collect()] == [1]
    both = N.between(n, ["pos"], F.col("pos") == 2, F.col("pos") == 1)
    assert {r.pos for r in both.collect()} == {1, 2}
    assert N.between(n, ["pos"], F.col("pos") == 2, F.col("pos") == 9).count() == 0
    assert {r.folder for r in N.folders(n, ["a", "t"]).collect()} == {"a", "b", "t"}


def test_dimmed_keeps_a_set(spark):
    n = _notes(spark).withColumn("visible", F.when(F.col("pos") < 2, True))
    kept = spark.createDataFrame([("b/Beta.md",), ("Gamma.md",)], "path string")
    assert {r.pos: r.dim for r in N.dimmed(n, kept=kept).collect()} == {0: True, 1: False, 2: True}
    assert {r.pos: r.dim for r in N.dimmed(n, tag="x").collect()} == {0: False, 1: False, 2: True}


def test_fragments_begin_before_the_match(spark):
    d = spark.createDataFrame([(1, "w" * 100 + " Needle\nend"), (2, None), (3, "none")], "id int, text string")
    (row,) = N.fragments(d, "NEEDLE").collect()
    assert row.id == 1 and row.frag.startswith("…w") and row.frag.endswith("Needle end…")


def test_toward_prefers_the_line(spark):
    p = spark.createDataFrame([(1, 10.0, 0.0), (2, 6.0, 6.0), (3, -1.0, 0.0)], "id long, x double, y double")
    assert N.toward(p, 0.0, 0.0, 1, 0).collect()[0].id == 1
    assert N.toward(p, 0.0, 0.0, -1, 0).collect()[0].id == 3


def test_guarded_writes(spark):
    d = spark.createDataFrame([("append", None, "x "), ("append", "a\n\n", "x"), ("create", "a", "x"), ("write", None, "x"), ("write", "", "x"), (None, "a", "x")], "op string, now string, content string")
    got = [tuple(r.w) for r in d.select(E.guarded(F.col("op"), F.col("now"), F.col("content")).alias("w")).collect()]
    assert got == [("x\n", None), ("a\n\nx\n", None), ("a", "exists"), (None, "missing"), ("x", None), ("a", "unknown operation")]


def test_claims_need_text_and_entity(spark):
    d = spark.createDataFrame([("short", "E"), ("long enough  text.", None), ("long enough: a  text.", "E"), (None, None)], "t string, e string")
    got = [r.c for r in d.select(E.claim(F.col("t"), F.col("e"), F.lit("2024-01-01")).alias("c")).collect()]
    assert [c.error for c in got] == ["too short", "no entity", None, "too short"]
    assert got[2].path == "осколки/2024-01-01 long enough a text.md" and 'о: ["[[E]]"]' in got[2].content and got[0].path is None


def test_tags_uploads_hours_and_answers(spark):
    one = spark.range(1)
    r = one.select(
        E.renamed_tag(F.array(F.lit("a"), F.lit("b")), "a", "b").alias("t"), E.renamed_tag(F.array(F.lit("a")), "a", "c").alias("u"), E.renamed_tag(F.array(F.lit("a")), "a").alias("v"),
        E.upload(F.lit("data:x/y;base64,aGk=\n")).alias("b"), E.upload(F.lit(" ")).alias("n"), E.link_hours(F.lit(999)).alias("h"), E.link_hours(F.lit(None).cast("int")).alias("h0"),
        E.answer_list(F.lit("ТЕГИ: #a, b ,\nСВЯЗИ: Нет"), "ТЕГИ").alias("l"), E.answer_list(F.lit("СВЯЗИ: Нет"), "СВЯЗИ").alias("m"), E.answer_list(F.lit(""), "X").alias("e"),
    ).collect()[0]
    assert (r.t, r.u, r.v, bytes(r.b), r.n, r.h, r.h0, r.l, r.m, r.e) == (["b"], ["c"], [], b"hi", None, 168, 24, ["a", "b"], [], [])


def test_lines_under_a_heading_and_intros():
    assert D.under("# T\n\n## H\n\na\n\n## K\n", "h", "b") == "# T\n\n## H\n\na\n\nb\n\n## K\n"
    assert D.under("# T", "H", "b") == "# T\n\n## H\n\nb\n"
    assert D.with_intro("# T\n\n## H", "in ") == "# T\n\nin\n\n## H"
    assert D.with_intro("text", "in") == "in\n\ntext"
    assert D.capture(None, "H", "- b", "# T\n") == ("# T\n\n## H\n\n- b\n", "create")
    assert D.capture("# T\n\n## H\n\n- a\n", "H", "- b")[1] == "patch"
    assert D.capture("# T\n", "H", "- b") == ("# T\n\n## H\n\n- b\n", "append")
