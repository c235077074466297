"""Operators on small tables, sources, streams; queries against their SQL."""

import base64
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import communities as C
from corpusloom.operators import entities as E
from corpusloom.operators import graph as G
from corpusloom.operators import model as M
from corpusloom.operators import rank as R
from corpusloom.operators import reports as P
from corpusloom.operators import versions as H
from corpusloom.sources import files as S
from corpusloom.streaming import feed


def test_fusion_does_not_depend_on_the_order_of_lists(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "path string, place long")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "path string, place long")
    one, two = ({r["path"]: r["rrf"] for r in R.fuse(p).collect()} for p in ([a, b], [b, a]))
    assert one == two and one["y"] == round(1 / 62 + 1 / 61, 5)


def test_prefix_matches_only_what_the_dictionary_lacks(spark):
    post = spark.createDataFrame([(1, "house", 1.0, 0), (2, "houses", 2.0, 0), (3, "hous", 1.0, 1)], "doc_id long, term string, tf_body double, tf_meta long")
    hit = lambda *t: sorted((r["doc_id"], r["factor"]) for r in R.matching_postings(post, [list(t)]).collect())
    assert hit("house") == [(1, 1.0)] and hit("housex") == [(1, 0.7), (3, 0.7)] and hit("hou") == []


def test_layers_of_dependencies(spark):
    l = spark.createDataFrame([("a", "b", "depends"), ("b", "c", "depends"), ("a", "c", "depends"), ("d", "a", "blocks"), ("x", "y", "depends"), ("y", "x", "depends"), ("z", "x", "depends"), ("p", "q", "link")], "src string, dst string, type string")
    got = {r["path"]: (r["level"], r["in_cycle"]) for r in G.dependency_layers(l).collect()}
    assert got == {"c": (0, False), "d": (0, False), "b": (1, False), "a": (2, False), "x": (None, True), "y": (None, True), "z": (None, True)}
    chain = spark.createDataFrame([(str(i), str(i + 1), "depends") for i in range(20)], "src string, dst string, type string")
    assert {r["path"]: r["level"] for r in G.chain_layers(chain).collect()} == {str(i): 20 - i for i in range(21)}


def test_ego(spark):
    l = spark.createDataFrame([("a", "b", "l"), ("c", "b", "l"), ("c", "d", "l"), ("d", "e", "l")], "src string, dst string, type string")
    assert {r["path"]: r["steps"] for r in G.ego(l, spark.createDataFrame([("a",)], "path string"), 2).collect()} == {"a": 0, "b": 1, "c": 2}


def test_zones_split_large_folders(spark):
    paths = [f"big/sub/{i}.md" for i in range(20)] + [f"big/few/{i}.md" for i in range(7)] + ["big/top.md", "root.md", "small/x/y.md"]
    z = {r["path"]: r["zone"] for r in M.with_zone(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert z["big/sub/1.md"] == "big/sub" and z["big/few/1.md"] == "big" and z["big/top.md"] == "big" and z["root.md"] == "корень" and z["small/x/y.md"] == "small"


def test_louvain_finds_two_cliques():
    edges = [(a, b, 1.0) for k in (0, 4) for a in range(k, k + 4) for b in range(a + 1, k + 4)] + [(3, 4, 1.0)]
    assert C.louvain(9, edges) == [0, 0, 0, 0, 1, 1, 1, 1, 2] and C.louvain(3, []) == [0, 1, 2]


def test_loose_notes_are_adopted(spark):
    clusters = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2"), ("e", "3")], "path string, cluster string")
    words = spark.createDataFrame([("a", "t"), ("b", "t"), ("c", "t"), ("d", "t"), ("e", "u")], "path string, term string")
    assert {r["path"]: r["cluster"] for r in C.adopt_loose(clusters, words).collect()} == {"a": "1", "b": "1", "c": "1", "d": "1", "e": None}
    assert {r["cluster"]: r["label"] for r in C.labels(clusters, words).collect()}["1"] == "T"


def test_entities(spark):
    e = spark.createDataFrame([(0, "p/a", "Anna Petrova", "a", ["Ann"], "person"), (1, "p/b", "Project Release", "b", [], "project")], "pos long, path string, title string, base string, aliases array<string>, kind string")
    index = E.name_index(e)
    find = lambda q: [r["path"] for r in E.find(index, q).collect()]
    assert find("what does anna petrova do") == ["p/a"] and find("the releases?") == ["p/b"] and find("nothing") == []


def test_claims_put_the_dead_last(spark):
    links = spark.createDataFrame([(c, "e", "about") for c in "abc"], "src string, dst string, type string")
    claims = spark.createDataFrame([("a", "2020", "отменено", 0), ("b", "2019", "", 1), ("c", "2021", "", 2)], "path string, at string, status string, pos long")
    assert [r["claim"] for r in E.claims_of(links, claims).orderBy("place").collect()] == ["c", "b", "a"]


def test_classify_takes_the_first_rule(spark):
    rules = [("^claims/", "claim", "fact", True), ("^log/.*(?iu:export)", "evidence", "export"), ("^log/", "evidence", "journal")]
    rows = [("claims/x.md", "rule"), ("claims/y.md", ""), ("claims/z.md", None), ("log/My EXPORT.md", "own"), ("log/1.md", None), ("other.md", "own")]
    d = P.classify(spark.createDataFrame(rows, "path string, own string"), rules, F.col("own"))
    assert [(r["klass"], r["kind"]) for r in d.collect()] == [("claim", "rule"), ("claim", "fact"), ("claim", "fact"), ("evidence", "export"), ("evidence", "journal"), (None, None)]


def test_versions(spark):
    v = spark.createDataFrame([(1, "a", "2020-01-01", "x"), (2, "a", "2020-01-02", "y"), (3, "b", "2020-01-01", "z")], "id long, path string, ts string, content string")
    assert {r["path"]: r["content"] for r in H.latest(v).collect()} == {"a": "y", "b": "z"}
    w = spark.createDataFrame([(1, "a", None), (2, "a", 1), (3, "a", 1)], "id long, path string, base_id long")
    assert [r["id"] for r in H.conflicts(w).collect()] == [3]
    o = H.overlay(spark.createDataFrame([("a", 1), ("b", 2)], "path string, size long"), spark.createDataFrame([("b", 9)], "path string, size long"))
    assert {r["path"]: r["size"] for r in o.collect()} == {"a": 1, "b": 9}


def test_debounce_as_batch_and_stream(spark, tmp_path):
    rows = [(0.0, "a"), (0.3, "b"), (0.7, "a"), (2.0, "c"), (7200.0, "z"), (90000.0, "end")]
    d = spark.createDataFrame(rows, "s double, path string").select(F.timestamp_seconds("s").alias("ts"), "path")
    d.write.parquet(f"{tmp_path}/in")
    batch = sorted((r["n"], r["paths"]) for r in feed.debounce(d).collect())
    assert batch == [(1, ["c"]), (1, ["end"]), (1, ["z"]), (3, ["a", "b"])]
    stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    got = sorted((r["n"], r["paths"]) for r in feed.run_once(feed.debounce(stream), "debounced").collect())
    assert got == [(1, ["c"]), (1, ["z"]), (3, ["a", "b"])]  # the last session is still open


def test_replay(spark):
    q = spark.createDataFrame([(1, "a", "write", True), (2, "a", "write", False), (3, "a", "network", True), (4, "a", "write", True), (5, "b", "write", True)], "id long, path string, kind string, ok boolean")
    left = lambda **o: {r["path"]: (r["applied"], r["dropped"], r["waiting"], r["last_id"]) for r in feed.replay(q, **o).collect()}
    assert left(queue_of="path") == {"a": (1, 1, 2, 1), "b": (1, 0, 0, 5)} and left() == {"a": (1, 1, 2, 1), "b": (0, 0, 1, None)}


def test_pushes_arrive_as_a_stream(spark, tmp_path):
    folder = f"{tmp_path}/in"
    os.makedirs(folder)
    lines = [{"ts": "2024-01-01T00:00:00", "kind": "push", "path": "a", "touched": True}, {"ts": "2024-01-01T00:00:01", "kind": "ping", "path": "b"}, {"kind": "push"}]
    open(f"{folder}/1.json", "w").write("\n".join(map(json.dumps, lines)) + "\nno json\n")
    got = feed.run_once(feed.pushes(spark, folder), "pushes_seen", checkpoint=f"{tmp_path}/cp")
    assert [(r["path"], r["touched"]) for r in got.collect()] == [("a", True)] and feed.backoff(0) == 1 and feed.backoff(9) == 30


def test_labels_drop_twins_and_write_words_out(spark):
    clusters = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "path string, cluster string")
    words = spark.createDataFrame([("a", "налог"), ("b", "налог"), ("a", "nalog"), ("b", "nalog"), ("a", "gard"), ("b", "gard"), ("c", "lone")], "path string, term string")
    titles = spark.createDataFrame([("a", "Garden plans"), ("b", "Gardening and налоги"), ("c", "Only one")], "path string, title string")
    got = {r["cluster"]: (r["size"], r["label"]) for r in C.labels(clusters, words, titles).collect()}
    assert got == {"x": (2, "GARDENING · НАЛОГИ"), "y": (1, "ONLY ONE")}


def test_loading_falls_back_to_the_chunks(spark, tmp_path):
    root = str(tmp_path)
    demo = S.demo(spark)
    chunks = S.chunk_notes(demo)
    assert [(r["h"], r["t"]) for r in chunks.where("path like '%Garden.md'").orderBy("i").collect()] == [(["Garden"], "Beds and paths, see [[Compost]]."), (["Beds"], "- beans\n- peas"), (["Beds", "Soil"], "heavy")]
    os.makedirs(f"{root}/{S.INDEX}")
    rows = [{"p": r["path"], "h": r["h"], "t": r["t"], "i": r["i"]} for r in chunks.collect()]
    open(f"{root}/{S.INDEX}/00.json", "w", encoding="utf-8").write(json.dumps(rows))
    first = S.load(spark, root)
    assert not first.from_map and first.notes.count() == 4 and ("people/Ada.md", "projects/Compost.md") in {(r["src"], r["dst"]) for r in first.links.collect()}
    os.makedirs(os.path.dirname(f"{root}/{S.MAP}"))
    open(f"{root}/{S.MAP}", "w", encoding="utf-8").write(json.dumps({"notes": [{"p": "a.md"}]}))
    second = S.load(spark, root)
    assert second.from_map and second.notes.count() == 1 and second.snapshot != first.snapshot


def test_file_formats(spark, tmp_path):
    root = str(tmp_path)
    put = lambda p, x: (os.makedirs(os.path.dirname(f"{root}/{p}"), exist_ok=True), open(f"{root}/{p}", "w", encoding="utf-8").write(x))
    put(S.MAP, "\ufeff" + json.dumps({"notes": [{"p": "a/X.md", "tg": ["t"], "b": 10, "ln": [[1, "about"], [0, "link"], [7, "link"]]}, {"p": "b.md", "t": "B"}]}))
    put(f"{S.DICTIONARY}/000.json", json.dumps({"term": "0:31,1:02"}))
    put(S.KEYWORDS, json.dumps([["k"], ["k", "m"]]))
    put(f"{S.INDEX}/00.json", json.dumps([{"p": "n/a.md", "h": ["H"], "t": "two [[b]]", "i": 1}, {"p": "n/a.md", "h": [], "t": "one [[missing]]", "i": 0}, {"p": "n/b.md", "t": "[[a|x]]", "i": 0}, {"p": "_машина/z.md", "t": "no", "i": 0}]))
    notes, links = S.read_map(spark, root)
    assert [(r["title"], r["tags"], r["bytes"]) for r in notes.orderBy("pos").collect()] == [("X", ["t"], 10), ("B", [], 0)]
    assert [tuple(r) for r in links.collect()] == [("a/X.md", "b.md", "about")]
    assert sorted(tuple(r) for r in S.read_postings(spark, root).collect()) == [(0, "term", 4.0, 1), (1, "term", 0.0, 2)]
    assert S.read_keywords(spark, root).count() == 3 and S.read_synonyms(spark, root) == []
    legacy = S.notes_of_chunks(S.read_chunks(spark, root))
    assert {r["path"]: r["text"] for r in legacy.collect()} == {"n/a.md": "one [[missing]]\n\ntwo [[b]]", "n/b.md": "[[a|x]]"}
    assert [(r["src"], r["dst"]) for r in S.links_of_notes(legacy).collect()] == [("n/a.md", "n/b.md")]
    vec = bytes([127, 129, 0, 5, 250, 1])
    put(f"{S.VECTORS}/000.json", json.dumps(base64.b64encode(vec).decode()))
    put(f"{S.VECTORS}/куски.json", json.dumps([{"p": "a", "h": "x"}, {"p": "b", "h": "y"}]))
    assert {r["path"]: r["embedding"] for r in S.read_vectors(spark, root, 3).collect()} == {"a": [127, -127, 0], "b": [5, -6, 1]}
    files = spark.createDataFrame([("a/b.md", 3), ("a/c/d.md", 4), (".git/x", 1), ("e.md", 5)], "path string, size long")
    assert sorted(tuple(r) for r in S.listing(files).collect()) == [("a", True, None), ("e.md", False, 5)]
    answer = "**a/b.md** › H › I  (ещё 2 фрагмента)\ntext\n\n**bold** goes on\n\n**c.md**\nlast\n\nЭто фрагменты, а не ответ."
    got = spark.createDataFrame([(answer,)], "t string").select(F.lit(1).alias("key"), F.col("t").alias("answer"))
    got = S.parse_answers(got).orderBy("place").drop("key", "place").collect()
    assert [tuple(x) for x in got] == [("a/b.md", "H › I", 2, "text\n\n**bold** goes on"), ("c.md", "", 0, "last")]


def test_queries_match_their_sql(spark, sf):
    """A few of the registered queries, whole results, and the same over another number of partitions."""
    duckdb = pytest.importorskip("duckdb")
    import glob

    import __spark_entry__

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    tidy = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    for name in ("bm25_search", "rank_chunks", "filter_tag", "zones", "entity_stats", "change_feed_debounce"):
        df, rel = queries[name](spark, sf), c.sql(oracles[name])
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns)
        want = tidy([[r[rel.columns.index(k)] for k in cols] for r in rel.fetchall()])
        assert tidy([[r[k] for k in cols] for r in df.collect()]) == want, name
    old = spark.conf.get("spark.sql.shuffle.partitions")
    one = tidy(queries["bm25_search"](spark, sf).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert tidy(queries["bm25_search"](spark, sf).collect()) == one
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert __spark_entry__.entry(spark).count() > 0


def test_whole_graph_similarity_has_every_node(spark, sf):
    """All nodes over all link types against brute force; repeated links count each."""
    import math
    from collections import Counter, defaultdict

    from corpusloom import catalog
    from corpusloom.sources import bindings as B

    near = defaultdict(Counter)
    for r in B.links(spark, sf).collect():
        if r.src != r.dst:
            near[r.src][r.dst] += 1
            near[r.dst][r.src] += 1
    want = Counter()
    for x, around in near.items():
        each = 1.1 / math.log2(2 + sum(around.values()))
        for a, m in around.items():
            want[x, a] += 0.8 * m
            for b, n in around.items():
                if a != b:
                    want[a, b] += m * n * each
    got = {(r.path, r.other): r.w for r in catalog.QUERIES["similar_graph_whole"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert {p.split("/")[0] for p, _ in got} == {"customer", "order", "part", "nation", "region", "supplier"}
    some = {(r.path, r.other): r.w for r in catalog.QUERIES["similar_graph_part"](spark, sf).collect()}
    assert some == {k: w for k, w in got.items() if int(k[0].split("/")[1]) % 20 == 0}


def test_co_mentions_of_every_part(spark, sf):
    from collections import Counter, defaultdict

    from corpusloom import catalog

    parts, count = defaultdict(set), defaultdict(Counter)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        parts[r[0]].add(f"part/{r[1]}")
    for here in parts.values():
        for a in here:
            count[a].update(here - {a})
    want = {(a, b, n) for a, c in count.items() for b, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:6]}
    assert {tuple(r) for r in catalog.QUERIES["co_mentioned"](spark, sf).select("entity", "other", "n").collect()} == want


def test_similar_notes_with_tags_are_those_of_all_pairs(spark, sf):
    """Keywords, links, degrees and tags together, by sets of tags as by pairs; pairs that share tags only are there."""
    from corpusloom import catalog
    from corpusloom.operators import similar as X

    paths = [f"n{i:03d}" for i in range(120)]
    tags = [[x for x, k in (("big", 1), ("even", 2), ("third", 3), ("rare", 37)) if i % k == 0 and i % 11] for i in range(120)]
    notes = spark.createDataFrame([(p, t, i % 4, i % 5 == 0, i % 7 > 0) for i, (p, t) in enumerate(zip(paths, tags))], "path string, tags array<string>, deg long, chronicle boolean, shown boolean")
    words = spark.createDataFrame([(p, f"w{i * 7 % k}") for i, p in enumerate(paths) for k in (31, 53)], "path string, term string").distinct()
    links = spark.createDataFrame([(paths[i], paths[i * 5 % 120]) for i in range(0, 120, 4)], "src string, dst string")
    parts = [X.keyword_part(words, 120), X.graph_part(notes, links, notes)]
    rows = lambda df: sorted(tuple(r) for r in df.select("path", "other", "score").collect())
    got, want = rows(X.similar_with_tags(parts, notes)), rows(X.similar([*parts, X.tag_part(notes, notes)], notes))
    assert got == want and got != rows(X.similar(parts, notes))
    assert set(catalog.QUERIES["similar_notes"](spark, sf).columns) == {"path", "other", "score"}
    from corpusloom.catalog import relations

    near = relations._similar(spark, sf, 3)
    ends = {r[0] for r in near.select("path").union(near.select("other")).collect()}
    assert {r.path for r in catalog.QUERIES["label_spreading"](spark, sf).collect()} == ends


def test_layout_of_a_large_component(spark):
    """Repulsion by squares is near that of all pairs; a component above the limit is laid out, not put on a circle."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 150, (1500, 2)), rng.normal(500, 20, (500, 2)), np.full((3, 2), 7.0)])
    d = x[:, None] - x[None]
    r = (d**2).sum(2) + 1.0
    exact = (d * (np.where(r < 160_000, 1800 / r, 0.0) / np.sqrt(r))[:, :, None]).sum(1)
    assert np.linalg.norm(C.repulsion(x) - exact) < 0.05 * np.linalg.norm(exact)
    assert np.linalg.norm(C.repulsion(x, theta=1e-9) - exact) < 1e-6 * np.linalg.norm(exact)
    names = [f"n{i}" for i in range(300)]
    links = spark.createDataFrame([(a, b) for a, b in zip(names, names[1:])], "src string, dst string")
    component = spark.createDataFrame([(a, "c") for a in names], "path string, component string")
    got = {r.path: np.array([r.x, r.y]) for r in C.force_layout(links, component, most=100).collect()}
    assert got.keys() == set(names) and np.ptp([np.hypot(*p) for p in got.values()]) > 50
    apart = lambda k: np.median([np.hypot(*(got[a] - got[b])) for a, b in zip(names, names[k:])])
    assert apart(1) < apart(100)


def test_modularity_of_a_component_of_many_links(spark):
    """One node with a chain around it, above 200,000 links, is clustered as the same shape is below."""
    n = 100_100
    name = "format_string('o%06d', id)"
    spokes = spark.range(n).selectExpr(f"{name} AS src", "'c' AS dst", "1.6D AS w")
    chain = spark.range(1, n).selectExpr(f"{name} AS src", "format_string('o%06d', id - 1) AS dst", "1.6D AS w")
    component = spark.range(n).selectExpr(f"{name} AS path", "'k' AS component")
    got = C.modularity_clusters(spokes.unionByName(chain), component)
    sizes = [r["count"] for r in got.groupBy("cluster").count().collect()]
    assert sum(sizes) == n + 1 and len(sizes) > 100 and max(sizes) < n / 4


def test_stored_tables_follow_their_source(spark, tmp_path):
    from corpusloom import storage

    source, made = f"{tmp_path}/t", []
    spark.range(3).write.parquet(source)
    build = lambda: made.append(1) or spark.read.parquet(source).withColumn("shard", F.col("id") % 2)
    ask = lambda: storage.stored(spark, "test", source, build, "shard")
    assert ask().count() == 3 and ask().where("shard = 0").count() == 2 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert ask().count() == 5 and len(made) == 2
    storage.forget(source)
    assert ask().count() == 5 and len(made) == 3


def test_an_index_gives_the_ranks_of_the_texts(spark, sf):
    from corpusloom.catalog import text as T
    from corpusloom.sources import bindings as B

    for query in ("idiot threat of the налог", "worthless"):
        chunks = B.chunks(spark, sf)
        plain = R.rank_chunks(chunks, query, 30).drop("t").collect()
        assert sorted(plain) == sorted(R.rank_chunks(chunks, query, 30, index=T._chunk_words(spark, sf)).drop("t").collect())


def test_loose_documents_join_the_cluster_whose_words_they_share(spark, sf):
    """The registered queries on clusters, worked out plainly from their clusters and keywords."""
    import math
    from collections import Counter

    from corpusloom import catalog
    from corpusloom.catalog import relations

    cluster = {r.path: r.cluster for r in catalog.QUERIES["label_spreading"](spark, sf).collect()}
    words: dict[str, set] = {}
    for r in relations.keywords_by_path(spark, sf).collect():
        words.setdefault(r.path, set()).add(r.term)
    df = Counter(t for w in words.values() for t in w)
    size = Counter(cluster.values())
    count = Counter((c, t) for p, c in cluster.items() for t in words.get(p, ()))
    want = {}
    for p, c in cluster.items():
        want[p] = c
        if size[c] < 3:
            s = {k: round(sum(count[k, t] / size[k] / math.log2(2 + df[t]) for t in words.get(p, ())), 6) for k in size if size[k] >= 3}
            best = min(((-v, k) for k, v in s.items() if v > 0.02), default=(0, None))
            want[p] = best[1]
    got = {r.path: r.cluster for r in catalog.QUERIES["adopt_loose"](spark, sf).collect()}
    assert got == want
    labels = {r.cluster: (r["size"], r.label) for r in catalog.QUERIES["cluster_labels"](spark, sf).collect()}
    assert {c: n for c, (n, _) in labels.items()} == dict(size) and all(t for _, t in labels.values())


def test_queries_without_sql_run(spark, sf):
    from corpusloom import catalog

    for name in sorted(set(catalog.QUERIES) - set(catalog.ORACLES)):
        assert catalog.QUERIES[name](spark, sf).count() > 0, name


def test_search_by_vectors_that_do_not_fit(spark):
    from corpusloom.operators import vectors as V

    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in V.search(v, [0.0, 2.0], 1, "m", "m").collect()] == [(2, 0.8)]
    assert V.search(v.where("vec_id = 3"), [1.0], 5).collect() == []
    for bad in (lambda: V.search(v, [1.0], 5), lambda: V.search(v, [1.0, 0.0], 5, "m", "n")):
        with pytest.raises(ValueError):
            bad()
    words = spark.createDataFrame([("x", 0), ("y", 1)], "path string, place long")
    alone = R.fuse([words]).collect()
    assert R.hybrid(words, None).collect() == alone == R.hybrid(words, lambda: V.search(v, [1.0], 5)).collect()
    both = R.hybrid(words, lambda: spark.createDataFrame([("y", 0)], "path string, place long"))
    assert both.orderBy(F.desc("rrf")).first()["path"] == "y"


def test_first_places_in_blocks(spark, sf, monkeypatch):
    from corpusloom.operators import vectors as V
    from corpusloom.sources import bindings as B

    e = B.table(spark, sf, "embeddings")
    ask = lambda: sorted(tuple(r) for r in V.first_places(e, e.where("vec_id % 20 = 0")).collect())
    whole = ask()
    monkeypatch.setattr(V, "QUERY_BLOCK", 7)
    assert len(whole) > 7 and ask() == whole
