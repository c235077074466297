"""WARC, embeddings, URLs and components against brute force, and their edge cases."""

import base64
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import components, embeddings, urlfilter, warc

PAGE = "page_id long, url string, html string, offset string, sha string, refers_to string"


def test_warc(spark):
    pages = [(1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, None, None), (4, "http://b.example/ü\r\nX: y", ""), (5, "", "ü" * 100_000), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "n", "<p>one</p>"), (0, "z", "<p>one</p>"), (7, "q", "same"), (7, "q", "same")]
    df = spark.createDataFrame([(*p, "o", "s", "r") for p in pages], PAGE)
    index = warc.write(df)
    got = warc.read(index, payload=True).collect()
    assert len(got) == len(pages)
    by = {}
    for p, _, h in pages:
        if p is not None:
            by.setdefault((h or ""), []).append(p)
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "response" and r["refers_to"] is None
            continue
        h = next(x[2] or "" for x in pages if x[0] == r["page_id"])
        first = min(by[h])
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == first else ("revisit", first))
        assert r["payload"] == (h.encode() if r["record_type"] == "response" else None)
    some = warc.read(index.where("page_id in (1, 5)"))
    assert sorted(r["page_id"] for r in some.collect()) == [1, 5]
    assert {r["record_type"] for r in warc.read(warc.write(df, min_bytes=1 << 30)).collect()} == {"response"}
    assert warc.read(warc.write(df.where("false"))).collect() == []


def test_ranges_join_neighbours():
    assert warc.ranges([0, 10, 500, 510], [10, 20, 10, 5], gap=50, most=1000) == [(0, 2, 0, 30), (2, 4, 500, 15)]
    assert warc.ranges([0, 10], [10, 20], gap=50, most=25) == [(0, 1, 0, 10), (1, 2, 10, 20)]


def brute_vectors(rows, least):
    unit = {}
    for i, (v, e, l) in enumerate(rows):
        if v is None or e is None or l is None or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        x = np.array(e, float)
        unit[i] = x / np.linalg.norm(x)
    up = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    n = [0] * len(rows)
    for i in unit:
        for j in unit:
            if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                n[i] += 1
                n[j] += 1
                a, b = root(rows[i][0]), root(rows[j][0])
                up[max(a, b)] = min(a, b)
    return sorted(((r[0], n[i], root(r[0]) if r[0] is not None else None) for i, r in enumerate(rows)), key=repr)


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows, k = [], 0
    for c in range(12):
        base = rng.normal(size=16)
        for m in range(1 + c):
            k += 1
            rows.append((k, [float(x) for x in np.float32(base + rng.normal(size=16) * 0.04 * (m % 4))], c % 3))
    e = rows[-1][1]
    rows += [(200, e, 9), (201, e, None), (202, None, 1), (203, [0.0] * 16, 1), (204, [float("nan")] + e[1:], 1), (205, [None] + e[1:], 1), (206, [float("inf")] + e[1:], 1), (207, [2 * x for x in e], rows[-1][2]), (208, e[:8], rows[-1][2]), (None, e, rows[-1][2]), (209, [], 1), (k, e, rows[-1][2])]
    df = spark.createDataFrame([(v, x, l, "x") for v, x, l in rows], "vec_id long, embedding array<float>, label int, cls string")
    f32 = [(v, None if x is None else [None if y is None else float(np.float32(y)) for y in x], l) for v, x, l in rows]
    for block in (1024, 3):
        monkeypatch.setattr(embeddings, "BLOCK", block)
        got = embeddings.near_vectors(df).collect()
        assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == brute_vectors(f32, 0.98)
    assert embeddings.near_vectors(df.where("false")).collect() == []


def test_components(spark):
    r = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randint(100, 400), r.randint(100, 400)) for _ in range(200)] + [(7, 7), (None, 3)] + [(1000, 1001 + i) for i in range(50)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "src long, dst long")).collect() == []


URLS = ["http://EXAMPLE.net/en/1", "https://a.example.net/fr/2?x=1", "http://x.org/fr/3", "http://x.org/de/3", "http://b.example.com/de/x#y", "http://notexample.com/de/x", "http://example.com", "http://net", "http://net/", "no scheme", "", None, "http://a.net?x=/en/", "x://y://z/w", "http://\nq.net/\n"]
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def brute_judge(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])]
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len) if fits else None


def test_judge(spark):
    pages = [(i, u) for i, u in enumerate(URLS)] + [(100 + i, f"http://site{i}.example.com/en/{i}") for i in range(80)] + [(300 + i, f"http://cheap-pills{i % 3}.spam.example.com/en/{i}?a=1&b=2") for i in range(20)] + [(None, None)]
    df = spark.createDataFrame([(p, u, "f", "s") for p, u in pages], "page_id long, url string, suffix string, score string")
    got = {r["page_id"]: r for r in urlfilter.judge(df, RULES).collect()}
    assert len(got) == len(pages)
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == brute_judge(u), u
        assert got[i]["verdict"] == RULES[got[i]["rule"]] if got[i]["rule"] else got[i]["verdict"] in ("allow", "block")
    got = {r["page_id"]: r for r in urlfilter.judge(df, RULES, urlfilter.weak_labels(df)).collect()}
    assert all(got[100 + i]["verdict"] == "allow" for i in range(80)) and all(got[300 + i]["verdict"] == "block" for i in range(20))
    assert urlfilter.judge(df.where("false"), RULES).collect() == []


def test_trees_learn_given_labels(spark):
    rows = [(f"http://h{i}.example.com/{'a' * (i % 30)}", int(i % 30 > 15)) for i in range(300)] + [(None, 1), ("x", None)]
    model = urlfilter.fit(spark.createDataFrame(rows, "url string, label int"))
    d = urlfilter._with_suffixes(urlfilter.lexical(spark.createDataFrame([(u, y) for u, y in rows if u and y is not None], "url string, y int")), model)
    right = d.withColumn("p", model.score()).where((F.col("p") >= 0.5) == (F.col("y") == 1)).count()
    assert right >= 295
    assert urlfilter.fit(spark.createDataFrame([("a://b", 1)], "url string, label int")).trees == []


def test_queries_are_registered():
    from corpusloom.llm import queries

    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_record_ids_are_unique(spark, tmp_path):
    import gzip
    import re

    from corpusloom.llm import warc

    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (None, "http://c/", "same"), (None, None, "x"), (3, "u", "y"), (3, "u", "y"), (3, "u", "z"), (4, "v", "y")]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"))
    raw = b"".join(gzip.decompress(open(f.removeprefix("file://"), "rb").read()) for f in {r["file"] for r in index.collect()})
    ids = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert len(ids) == len(set(ids)) == len(rows)
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", raw)) < set(ids)
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read(index).collect()} >= {(1, "response", None), (2, "revisit", 1), (4, "revisit", 3)}


def test_rules_are_the_labels(spark):
    """Without a table of labels the trees learn from the URLs that the rules decide."""
    urls = [f"http://shop{i}.example.net/buy?id={i}&x={i}" for i in range(60)] + [f"http://www.org/fr/page{i}" for i in range(60)] + [f"http://site{i}.test/buy?id={i}&x={i}" for i in range(20)] + [f"http://www.tst/fr/page{i}" for i in range(20)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(pages, RULES).collect()}
    assert all(got[i] == "block" for i in range(60)) and all(got[i] == "allow" for i in range(60, 120))
    assert sum(got[i] == "block" for i in range(120, 140)) > 15 and sum(got[i] == "allow" for i in range(140, 160)) > 15
    labelled = urlfilter.rule_labels(pages, RULES)
    assert labelled.count() == 120 and labelled.agg({"label": "sum"}).first()[0] == 60


def test_trees_are_those_of_brute_force(spark):
    """The first split is the one of the largest gain over all features and cuts, and its leaves are the Newton steps."""
    import math

    urls = [(f"http://h{i}.test/" + "a/" * (i % 7) + ("p?x=1&y=2" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(urls, "url string, label int")
    model = urlfilter.fit(df)
    root = model.trees[0]
    names = [f"f_{k}" for k in urlfilter.FEATURES]
    rows = urlfilter._with_suffixes(urlfilter.lexical(df), model).select("label", *names).collect()
    p = sum(r["label"] for r in rows) / len(rows)
    assert math.isclose(model.base, math.log(p / (1 - p)))
    g, h = [r["label"] - p for r in rows], p * (1 - p)

    def gain(feature, cut):
        left = [x for x, r in zip(g, rows) if r[feature] <= cut]
        n, m = len(left), len(rows) - len(left)
        return -1 if not n or not m else sum(left) ** 2 / (n * h + urlfilter.RIDGE) + (sum(g) - sum(left)) ** 2 / (m * h + urlfilter.RIDGE)

    best = max(gain(f, c) for f in names for c in {r[f] for r in rows})
    assert gain(root.feature, root.cut) >= best - 1e-6
