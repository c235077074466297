"""Analysis, the filter language, documents: against rules written out by hand."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D
from corpusloom.plans import query as Q


def loop_stem(w):
    w = w.lower().replace("ё", "е")
    for _ in range(2):
        for s in A.SUFFIXES:
            if w.endswith(s) and len(w) - len(s) >= 4:
                w = w[: len(w) - len(s)]
                break
    return w


def test_stem_is_the_first_ending_that_fits(spark):
    r = random.Random(1)
    parts = [*A.SUFFIXES, "налог", "бег", "дом", "пере", "walk", "th", "ё", "о"]
    words = ["".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", A.stem(F.col("w")).alias("s"), A.translit(A.stem(F.col("w"))).alias("t"))
    for row in df.collect():
        assert row["s"] == loop_stem(row["w"]) == A.py_stem(row["w"]) and row["t"] == A.py_translit(row["s"])


def test_inflected_words_share_a_stem():
    for group in (["налоговый", "налоговая", "налогов"], ["переезда", "переезд", "переездами"], ["walking", "walked", "walks"]):
        assert len({A.py_stem(w) for w in group}) == 1


def test_stop_words_and_tokens(spark):
    got = spark.createDataFrame([("Это ещё еще the Налоги, и 7 x2!",), (None,), ("",)], "t string").select(A.tokens(F.col("t")).alias("t"), A.stems(F.col("t")).alias("k")).collect()
    assert [r["t"] for r in got] == [["ещё", "налоги", "x2"], [], []]
    assert "nalog" in got[0]["k"] and "налог" in got[0]["k"]


def test_match_and_synonyms():
    assert (A.py_match("abcd", "abcd"), A.py_match("abcdefg", "abcdefz"), A.py_match("abcdx", "abcd"), A.py_match("abc", "abcd"), A.py_match("abcdx", "abcyz")) == (1.0, 0.7, 0.7, 0.0, 0.0)
    groups = A.parse_synonyms("# head\n- дом, house; хата\n* house · home\n- alone\n")
    assert len(groups) == 2
    assert {"home", "dom", "hous"} & set(A.query_terms("хата", groups)[0]) >= {"dom"} and "hom" in "".join(A.query_terms("хата", groups)[0])
    assert A.query_terms("cats cats", ()) == [A.py_keys("cats")] * 2


def test_hashes_and_formats(spark):
    d = spark.createDataFrame([("дом", 1500), ("a", 999), ("", 5_000_000)], "s string, n long")
    got = d.select(A.fold_hash(F.col("s")).alias("h"), A.format_bytes(F.col("n")).alias("f"), A.slug(F.lit("word " * 30)).alias("g")).collect()

    def fold(s):
        h = 5381
        for c in s:
            h = ((h * 33) ^ ord(c)) & 0xFFFFFFFF
        return h

    assert [r["h"] for r in got] == [fold(s) for s in ("дом", "a", "")]
    assert [r["f"] for r in got] == ["1,5 КБ", "999 Б", "4,8 МБ"] and len(got[0]["g"]) <= 80


def test_authority(spark):
    d = spark.createDataFrame([("Brain/Log/x.md",), ("daily/1.md",), ("notes/daily/1.md",), ("ОСКОЛКИ/a.md",)], "p string")
    assert [r[0] for r in d.select(A.authority(F.col("p"))).collect()] == [0.4, 0.7, 1.0, 1.4]


def test_parse_query():
    q = Q.parse('tag:Home -is:orphan links:>=3 "exact Phrase" word foo:bar -x after:2026-06')
    assert [(f.key, f.value, f.negated) for f in q.filters] == [("tag", "Home", False), ("is", "orphan", True), ("links", ">=3", False), ("after", "2026-06", False)]
    assert q.phrases == ("exact phrase",) and q.text == "word foo:bar -x"
    assert "−is:orphan" in q.describe() and Q.parse("").filters == ()


def test_filters(spark):
    rows = [("a/x.md", ["home/garden"], "claim", 5, 3000, "2026-06-15", 0), ("b/y.md", ["homes"], "Event", 2, 100, None, 1), ("c/z.md", [], "claim", 3, 2048, "2025-01-01", 2)]
    d = spark.createDataFrame(rows, "path string, tags array<string>, klass string, deg long, bytes long, at string, n_backlinks long")
    run = lambda q: sorted(r["path"][0] for r in Q.apply(d, q).collect())
    assert run("tag:home") == ["a"] and run("-tag:home") == ["b", "c"] and run("класс:EVENT") == ["b"] and run("links:3") == ["c"] and run("links:>x") == []
    assert run("size:>=2") == ["a", "c"] and run("after:2026") == ["a"] and run("before:2001") == ["b"] and run("after:never") == [] and run("is:orphan") == ["a"] and run("is:untagged -links:5") == ["c"] and run("path:b/ words") == ["b"]


def test_front_matter():
    text = '---\r\ntitle: "A: b"\r\nтип: факт\r\ntags: [One, two]\r\nlinks:\r\n- "[[X]]"\r\n- y\r\nempty:\r\n---\r\n\r\nbody\n---\n'
    fields, body = D.parse_front(text)
    assert fields == {"title": "A: b", "тип": "факт", "tags": ["One", "two"], "links": ["[[X]]", "y"], "empty": []} and body == "\r\nbody\n---\n"
    added = D.add_tag(text, "#Three")
    assert D.parse_front(added)[1] == body and D.tags_of(D.parse_front(added)[0]) == ["one", "two", "three"]
    assert D.tags_of(D.parse_front(D.remove_tag(added, "one"))[0]) == ["two", "three"]
    linked = D.add_link(text, "links", "x")
    assert D.parse_front(linked)[0]["links"] == ["[[X]]", "y"] and '"[[Z]]"' in D.add_link(text, "links", "Z.md")
    assert D.parse_front("no front") == ({}, "no front") and D.with_front("body", {"a": "1"}) == "---\na: 1\n---\n\nbody"


def test_sections_and_patch():
    text = "intro\n# A\none\n## B\n- x\n- y\n\n# C\nend"
    assert [(l, h) for l, h, _ in D.sections(text)] == [(0, ""), (1, "A"), (2, "B"), (1, "C")]
    assert D.patch(text, "b", "- z", "append").split("\n")[4:7] == ["- x", "- y", "- z"]
    assert D.patch(text, "B", "- z", "prepend").split("\n")[4:7] == ["- z", "- x", "- y"]
    assert D.patch(text, "A", "new", "replace") == "intro\n# A\n\nnew\n\n# C\nend"
    assert D.headings(text) == ["# A", "  ## B", "# C"]
    assert D.patch("# A\n\n\nx\n\n# B", "A", "- new") == "# A\n\n\n- new\n\nx\n\n# B" and D.patch("# A", "a", "x", "append") == "# A\n\nx" and D.patch("# A", "a", "x") == "# A\nx\n"
    assert D.patch("# A\nx\n\n\n# B\ny", "A", "z", "append") == "# A\nx\n\nz\n\n\n# B\ny"
    with pytest.raises(ValueError, match="A .* B .* C"):
        D.patch(text, "missing", "x")


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=150, deadline=None)
def test_diff_gives_both_texts_back(a, b):
    parts = D.diff("\n".join(a), "\n".join(b))
    old = [x for k, t in parts if k != "add" for x in t.split("\n")]
    new = [x for k, t in parts if k != "del" for x in t.split("\n")]
    assert old == (a or [""]) and new == (b or [""])


def test_collapse_and_excerpt(spark):
    parts = D.diff("\n".join(map(str, range(40))), "\n".join("x" if i == 20 else str(i) for i in range(40)))
    assert [k for k, _ in D.collapse(parts)] == ["same", "skip", "same", "del", "add", "same", "skip", "same"]
    terms = A.query_terms("налоги")
    long = "слово " * 100 + "налоговый вопрос " + "конец " * 100
    texts = spark.createDataFrame([(1, long), (2, "a" * 400), (3, "Налог и дом"), (4, ""), (5, None), (6, "x " * 30 + "НАЛОГИ")], "i int, t string")
    rows = texts.select("i", D.excerpt(F.col("t"), terms).alias("e"), D.mark(F.col("t"), terms).alias("m")).orderBy("i").collect()
    got = rows[0]["e"]
    assert "налоговый" in got and got.startswith("…") and got.endswith("…") and len(got) < 360
    assert [r["e"] for r in rows[1:]] == ["a" * 320 + "…", "Налог и дом", "", None, "x " * 30 + "НАЛОГИ"] and rows[2]["m"] == "<mark>Налог</mark> и дом"


def test_wikilinks_and_markdown(spark):
    d = spark.createDataFrame([("see [[A b#H|Alias]] and [[c]] not [d]",)], "t string").select(D.wikilinks(F.col("t")).alias("l"), A.clean_fragment(F.lit("- **x** [[a|b]] [[c]]")).alias("c")).first()
    assert [tuple(x) for x in d["l"]] == [("A b", "H", "Alias"), ("c", "", "")] and d["c"] == "x b c"
    html = D.render("# T\n- [x] done\n1. one\n> q\n```\n<c>\n```\n**b** *i* `k` [[n|m]]\n---")
    for part in ('<div class="md-h1"><strong>T</strong></div>', "<li>☑ done</li>", "<ol><li>one</li></ol>", "<blockquote>q</blockquote>", "&lt;c&gt;", "<strong>b</strong> <em>i</em> <code>k</code>", 'data-wiki="n">m</a>', "<hr>"):
        assert part in html, part


def test_paths_receipts_and_fields(spark):
    from corpusloom.functions import edits as T

    d = spark.createDataFrame([("/a\\b.md/", "x"), ("a/../b", "x"), ("a..b", None), (None, "")], "p string, t string")
    got = [tuple(r) for r in d.select(T.receipt(F.col("p"), F.col("t")).alias("r")).select("r.*").collect()]
    assert got == [("a/b.md", "11f6ad8", None), (None, None, "bad path"), ("a..b", None, None), ("", "da39a3e", None)]
    assert D.field_of("depends") == "depends_on" and D.field_of("about") == "about"
    text = D.set_field("body", "status", "active")
    assert text == "---\nstatus: active\n---\n\nbody" and D.parse_front(D.set_field(text, "status", ""))[0] == {}
    plain = lambda t: spark.range(1).select(A.clean_fragment(F.lit(t))).first()[0]
    assert plain("[[a#H]] [[b#H|c]] [[d|]] **e**") == "a c d e" and plain("> q\n- l\n1. n") == "q\nl\n1. n"


def test_outline_as_a_table(spark):
    texts = ["# a\nx\n## b\n### c\n## d\n# e", "no heading", "", None, "####### seven\n#tag\n#\n# \n###### six\ty \n\n#\u00a0\u00a0nb\r\n## z", "x\n### deep\n# top\n\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "at int, text string")
    got = {}
    for r in D.outlines(docs.withColumnRenamed("at", "doc"), "doc").orderBy("doc", "place").collect():
        got.setdefault(r["doc"], []).append((r["level"], r["title"], r["at"], r["head"], r["end"]))
    want = {i: [(x.level, x.title, x.at, x.head, x.end) for x in D.outline(t or "")] for i, t in enumerate(texts)}
    assert got == {i: w for i, w in want.items() if w}
