"""Operators on documents against brute force, and their edge cases."""

import os
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, kernels, minhash, mixing, quality, substrings, tokenids, toxicity
from tests.llm.conftest import words

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, size=5):
    w = WORD.findall(lower(text or ""))
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


# ---------------------------------------------------------------- kernels


@given(st.lists(st.text(alphabet=st.sampled_from("aB é\n\t%x1."), max_size=30), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_and_shingles_are_those_of_the_pattern(texts):
    import pyarrow as pa

    for limit in (8, 1 << 20):
        got, counts = [], []
        for at, n, data, offsets in kernels.text_blocks(pa.array(texts, pa.string()), limit):
            starts, ends, places = kernels.word_spans(data, offsets)
            raw = data.tobytes()
            for i in range(n):
                got.append([raw[a:b].decode() for a, b in zip(starts[places[i] : places[i + 1]], ends[places[i] : places[i + 1]])])
            s, so = kernels.shingle_hashes(kernels.span_hashes(data, starts, ends), places)
            counts += [len(set(s[a:b].tolist())) for a, b in zip(so, so[1:])]
        assert got == [WORD.findall(t) for t in texts]
        assert counts == [len(shingles(t)) for t in texts]


# ---------------------------------------------------------------- near-duplicates


def brute_near(pairs, percent):
    sets = [(d, shingles(t)) for d, t, *_ in pairs]
    up = {d: d for d, _ in sets if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    return sorted(((d, len(s), root(d) if d is not None else None) for d, s in sets), key=repr)


@pytest.mark.parametrize("percent", [80, 95])
def test_near_duplicates(make_docs, messy, percent):
    pairs = messy + [(20 + i, words(9, 80) + " " + words(50 + i, i)) for i in range(12)]
    got = minhash.near_duplicates(make_docs(*pairs), percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(pairs, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_blocks(make_docs, monkeypatch):
    """A group that is split into block pairs has the same links."""
    base = words(77, 100).split(" ")
    pairs = []
    for i in range(40):
        w = base[:]
        w[(i * 7) % 100] = f"v{i % 13}"
        pairs.append((i + 1, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 5)
    got = minhash.near_duplicates(make_docs(*pairs), 85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(pairs, 85)


def test_near_duplicates_of_nothing(make_docs):
    assert minhash.near_duplicates(make_docs()).collect() == []
    one = minhash.keep_one(make_docs((1, "a b"), (2, "A b"), (2, "A b"), (None, "a b")))
    assert sorted((r["doc_id"] for r in one.collect()), key=repr) == [1, None]
    assert one.columns == make_docs().columns


# ---------------------------------------------------------------- mixing


def brute_targets(sizes, weights, cap):
    """Water-filling, step by step."""
    total, open_, out = sum(sizes.values()), dict(weights), {}
    while open_:
        left = total - sum(out.values())
        level = left / sum(open_.values())
        over = [s for s in open_ if open_[s] * level > cap * sizes[s]]
        if not over:
            return out | {s: w * level for s, w in open_.items()}
        for s in over:
            out[s] = cap * sizes[s]
            del open_[s]
    return out


def test_mix(make_docs, messy):
    pairs = [p for p in messy if p[0] != 12] + [(100 + i, words(i, 20 + i), f"s{i % 5}") for i in range(60)]
    got = mixing.mix(make_docs(*pairs)).collect()
    assert len(got) == len(pairs)
    sizes = {}
    for p in pairs:
        s = p[2] if len(p) > 2 else "s0"
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(p[1] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 3)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    largest = {s: max(r["size"] for r in got if r["source"] == s) for s in sizes}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    again = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mix(make_docs(*pairs).repartition(3)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["taken"] for r in got}
    copies = {}
    for r in mixing.expand(make_docs(*pairs)).collect():
        copies[r["doc_id"], r["text"]] = copies.get((r["doc_id"], r["text"]), 0) + 1
    assert sum(copies.values()) == sum(r["copies"] for r in got)


def test_one_row_of_a_repeated_id_stays_by_order(spark):
    long_ = words(1, 30)
    rows = [(1, "z " + long_, 9, None), (1, "a " + long_, 5, {"k": 1}), (1, "a " + long_, 4, {"k": 1}), (2, long_[::-1], 1, None), (None, long_, 0, None), (None, long_, 0, None)]
    schema = "doc_id long, text string, stay int, `rows` map<string,int>"
    for order in (rows, rows[::-1]):
        got = minhash.keep_one(spark.createDataFrame(order, schema).repartition(3))
        assert got.columns == ["doc_id", "text", "stay", "rows"]
        assert sorted((r.doc_id or 0, r.text, r.stay) for r in got.collect()) == sorted([(0, long_, 0), (0, long_, 0), (1, "a " + long_, 4), (2, long_[::-1], 1)])


def test_mix_of_nothing(make_docs):
    assert mixing.mix(make_docs()).collect() == []
    assert [r["taken"] for r in mixing.mix(make_docs((1, None), (2, ""))).collect()] == [0, 0]


# ---------------------------------------------------------------- toxicity


def test_automaton_is_edit_distance():
    terms = ["idiot", "scum", "worthless", "père", "crétin", "дурак", "a😀bcd"]
    a = toxicity.Automaton(terms)

    def distance(x, y):
        d = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            p, d[0] = d[0], i
            for j, e in enumerate(y, 1):
                p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (c != e))
        return d[-1]

    probes = ["idiot", "idlot", "idiots", "idot", "xidiot", "idit0", "scum", "scums", "worthless", "w0rthles", "wrthlss", "worthleess", "pere", "père", "", "zzz", "cretin", "crètin", "crtin", "idióta", "idiót", "дуракк", "дюрак", "дю", "a😀bd", "a😃bcd", "€"]
    raw = [p.encode() for p in probes]
    ends = np.cumsum([len(r) for r in raw])
    term, edits = a.match(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    for p, t, e in zip(probes, term, edits):
        near = [(distance(p, x), i) for i, x in enumerate(terms) if distance(p, x) <= toxicity.edits_for(x)]
        assert (t, e) == ((min(near)[1], min(near)[0]) if near else (-1, 0)), p


def test_code_points_of_spans():
    parts = ["aé€😀", "", "z", "дом", "😀"]
    raw = [p.encode() for p in parts]
    ends = np.cumsum([len(r) for r in raw])
    points, a, b = toxicity.code_points(np.frombuffer(b"".join(raw), np.uint8), ends - [len(r) for r in raw], ends)
    assert ["".join(map(chr, points[i:j])) for i, j in zip(a, b)] == parts
    none = np.empty(0, np.int64)
    assert [len(x) for x in toxicity.code_points(np.empty(0, np.uint8), none, none)] == [0, 0, 0]


def _labelled(spark, make_docs):
    texts = [(i, words(i, 40) + ((" worthless ", " idiot ", " you worthless idiot ")[i // 4 % 3] if i % 4 == 0 else " ") + words(900 + i, 20)) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0), "e") for i in range(400)] + [(None, 1, 1, "e"), (3, None, None, "e")], "doc_id long, quality int, toxic int, score string")
    return texts, labels


def test_toxicity(spark, make_docs, messy):
    texts, labels = _labelled(spark, make_docs)
    more = [(1500, words(5, 50) + " worthles idi0t " + words(6, 50)), (1501, words(7, 100)), (1502, 'she said "you worthless idiot" ' + words(8, 60)), (1503, words(5, 50) + " worthless idiot " + words(6, 50))]
    d = make_docs(*texts, *more, *[(2000 + i, p[1]) for i, p in enumerate(messy)], (None, "x"))
    got = {r["doc_id"]: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(got) == len(texts) + len(more) + len(messy) + 1
    for i, _ in texts:
        assert got[i]["predicted"] == int(i % 4 == 0) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert got[1500]["predicted"] == 1 and got[1501]["predicted"] == 0 and got[1502]["score"] < got[1503]["score"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not got[None]["held_out"]
    left = toxicity.keep_clean(d, labels)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} >= {1501, 2004, 2005, None} and left.where("doc_id in (0, 4, 1500)").count() == 0


def test_misspellings_by_spelling_and_with_few_labels(spark, make_docs):
    """An unseen misspelling counts less than the term but more than nothing; one that clean documents have does not count, alone."""
    texts = [(i, words(i, 40) + (" worthless " if i % 5 == 0 else " worthlens " if i % 5 == 1 else " ") + words(900 + i, 20)) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    probes = [(100, words(7, 50)), (101, words(7, 50) + " worthlexs"), (102, words(7, 50) + " worthlens"), (103, words(7, 50) + " worthless")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(make_docs(*probes), toxicity.fit(make_docs(*texts), labels)).collect()}
    assert got[100] == got[102] < got[101] < got[103]


def test_scores_without_labels(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = make_docs((1, "a b c"), (2, None))
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxicity(d, none).collect())
    assert all(0 <= r["score"] <= 1 for r in quality.quality(d, none).collect())
    assert toxicity.toxicity(make_docs(), none).collect() == [] and quality.quality(make_docs(), none).collect() == []


# ---------------------------------------------------------------- quality


def test_quality(spark, make_docs, messy):
    texts = [(i, words(i, 60) if i % 3 else " ".join(w + "%%%" for w in words(i, 60).split(" "))) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(make_docs(*texts, *[(1000 + i, p[1]) for i, p in enumerate(messy)], (None, None)), labels).collect()}
    assert len(got) == 200 + len(messy) + 1
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all(got[i]["held_out"] for i in held)
    assert np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())


def test_isotonic_never_falls():
    y = quality.isotonic(np.arange(6), np.array([1.0, 0, 2, 1, 3, 2]), np.array([2.0, 2, 2, 2, 3, 2]))
    assert (np.diff(y) >= 0).all() and abs((y * np.array([2, 2, 2, 2, 3, 2])).sum() - 9) < 1e-9


# ---------------------------------------------------------------- token ids


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        for top in (2, 50_000, 1 << 31):
            ids = rng.integers(0, top, n).astype(np.uint32)
            for planes in ("byte", "bit"):
                assert (tokenids.unpack_planes(tokenids.pack_planes(ids, planes), n, planes) == ids).all()


def test_token_ids(make_docs, messy, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    odd = ["Don't 'stop' it's=a≠b we'LL", "<|endoftext|> in <|startoftext|>the text", "É.à! ẞ 12ab3 “q”.a\u0301\u00a0x\u2003y", "a\u0338=\u0338 x.\u0301y", "日本語 текст שלום"]
    pairs = [*messy, *[(200 + i, x) for i, x in enumerate(odd)]]
    docs = make_docs(*pairs)
    for planes in ("byte", "bit"):
        shards = tokenids.write_token_ids(docs, P.path("word_bpe_49k.json"), planes=planes)
        got = sorted(tokenids.read_documents(shards).collect(), key=lambda r: r["start"])
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
        want, start = {}, 0
        for d, x, *_ in pairs:
            i = t.encode(x or "", add_special_tokens=False).ids + [1]
            want.setdefault(d, []).append((len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        seen = {}
        for r in got:
            assert r["start"] == start
            start += r["n_tokens"]
            seen.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
        assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
        # a ranged read of one document
        row = shards.orderBy("shard").collect()[-1]
        s = tokenids.Shard(row["path"])
        assert s.ids(int(s.counts[0]), int(s.counts[1] if len(s.counts) > 1 else 0)).tolist() == [x.tolist() for x in s.documents()][1] if len(s.counts) > 1 else True
    assert tokenids.token_ids(make_docs(), P.path("word_bpe_49k.json")).collect() == []


# ---------------------------------------------------------------- decontamination


def test_edited_passages(spark, make_docs):
    """Substitutions at the ends and in the middle, words put in or left out: found if any run of the document's words is near enough."""
    rng = np.random.default_rng(7)
    word = lambda n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(n)]
    items, docs = [], []
    for n in (15, 16, 23, 40, 57, 64, 100, 180):
        w = word(n)
        items.append((n, " ".join(w)))
        edits = [[0], [n - 1], [0, n - 1], [0, 1, n - 1], [n // 2], [n // 3], [n // 4, 3 * n // 4], [0, n // 2], [n // 5, n // 2, 4 * n // 5]]
        made = [[word(1)[0] if i in e else x for i, x in enumerate(w)] for e in edits]
        made += [w[:k] + word(1) + w[k:] for k in (1, n // 2, n - 1)] + [w[:k] + w[k + 1 :] for k in (0, n // 2, n - 1)] + [w[: n // 3] + w[n // 3 + 1 : 2 * n // 3] + word(1) + w[2 * n // 3 :]]
        docs += [(1000 * n + i, " ".join(word(37) + m + word(23))) for i, m in enumerate(made)]
    parsed = {i: decontaminate._words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for i, t in items + docs}
    want = set()
    for i, _ in items:
        own = decontaminate.weighted(*parsed[i][:2], 5)
        for d, _ in docs:
            h, letters, _ = parsed[d]
            near = (decontaminate.similarity(own, decontaminate.weighted(h[a : a + n], letters[a : a + n], 5)) for a in range(30, 45) for n in range(max(i - 1, 5), i + 2))
            if d // 1000 == i and any(x >= 0.8 for x in near):
                want.add((d, i))
    got = decontaminate.contaminated(make_docs(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in got}
    assert len(want) > 60 and got >= want and all(d // 1000 == i for d, i in got), want - got


def test_edits_in_the_overlap_of_windows_and_at_the_other_end(spark, make_docs):
    """For every length from 15 to 59 one word in the middle changed, put in or left out, and one at an end, against all runs."""
    rng = np.random.default_rng(11)
    word = lambda n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 10))) for _ in range(n)]
    items, docs = [], []
    for n in range(15, 60):
        w = word(n)
        items.append((n, " ".join(w)))
        made = [w[1:-1], w[2:], w[: n - n // 8]]
        for k, end in ((n // 4 + n // 8, n - 1), (5 * n // 8, 0), (n // 3, n - 1)):
            for middle in ([w[k] + "x"], [], [w[k], word(1)[0]]):
                made += [w[:k] + middle + w[k + 1 : -1] + word(1)] if end else [word(1) + w[1:k] + middle + w[k + 1 :]]
        docs += [(1000 * n + i, " ".join(word(37) + m + word(23))) for i, m in enumerate(made)]
    parsed = {i: decontaminate._words(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for i, t in items + docs}
    own = {i: decontaminate.weighted(*parsed[i][:2], 5) for i, _ in items}
    want = {}
    for d, _ in docs:
        n, (h, letters, _) = d // 1000, parsed[d]
        most = max(decontaminate.similarity(own[n], decontaminate.weighted(h[a : a + k], letters[a : a + k], 5)) for a in range(33, 45) for k in range(max(n - n // 4, 5), n + 3))
        if most >= 0.8:
            want[d, n] = most
    got = decontaminate.contaminated(make_docs(*docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert len(want) > 150 and got.keys() == want.keys(), want.keys() ^ got.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_passages_that_open_a_text_after_short_rows(make_docs, spark):
    """A passage that lost its first words is found whatever rows are before it, and in its own row only."""
    item = words(310, 72).split(" ")
    docs = [(1, words(5, 50)), (2, ""), (3, " ".join(item[3:])), (4, None), (5, "one two"), (6, " ".join(item[2:] + ["end"])), (7, "a"), (8, " ".join(["x", *item[1:]]))]
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for order in (docs, docs[::-1], [d for d in docs if d[0] in (3, 6, 8)]):
        got = decontaminate.contaminated(make_docs(*order).coalesce(1), benchmark).collect()
        assert {(r.doc_id, r.first_word) for r in got} == {(3, 0), (6, 0), (8, 1)} and len(got) == 3
    assert {r.doc_id for r in decontaminate.clean(make_docs(*docs).coalesce(1), benchmark).collect()} == {1, 2, 4, 5, 7}


def test_contaminated(spark, make_docs, messy):
    items = [(1, words(300, 40)), (2, words(301, 55)), (3, None), (4, ""), (5, "just three words"), (6, words(302, 17)), (7, words(300, 40))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    edited = words(301, 55).split(" ")
    edited[27] = "otherword"
    docs = [
        (1, words(1, 50) + " " + items[0][1] + " " + words(2, 50)), (2, items[1][1].upper()), (3, words(4, 30) + "\n" + " ".join(edited)), (4, items[0][1].replace(" ", " %%% ").replace("a", "a")),
        (5, words(5, 2000)), (6, "and just three words more"), (7, " ".join(items[0][1].split(" ")[:20])), (None, items[5][1]), (8, words(302, 17) + "."), (8, words(302, 17)),
    ]
    got = decontaminate.contaminated(make_docs(*docs, *[(1000 + i, p[1]) for i, p in enumerate(messy)]), benchmark).collect()
    assert sorted({(r["doc_id"], r["item_id"]) for r in got}, key=repr) == sorted({(1, 1), (1, 7), (2, 2), (3, 2), (4, 1), (4, 7), (6, 5), (8, 6), (None, 6)}, key=repr)
    assert len(got) == 10 and all(0.8 <= r["similarity"] <= 1 for r in got)
    left = decontaminate.clean(make_docs(*docs), benchmark)
    assert sorted(r["doc_id"] for r in left.collect()) == [5, 7] and left.columns == make_docs().columns
    assert decontaminate.contaminated(make_docs(), benchmark).collect() == [] and decontaminate.contaminated(make_docs(*docs), benchmark.where("false")).collect() == []


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(3)
    items = decontaminate.Items([1, 2], [words(1, 20), words(2, 20)])
    key = next(iter(items.groups))
    mine = items.groups[key][0]
    probes = np.concatenate([mine ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for k in range(1, 7)])
    places, rows_ = items.candidates(probes, key)
    want = {(i, j) for i, p in enumerate(probes) for j, m in enumerate(mine) if bin(int(p ^ m)).count("1") <= decontaminate.RADIUS}
    assert set(zip(places.tolist(), rows_.tolist())) == want


def test_simhash_is_the_majority():
    h = kernels.splitmix(9, 30)
    for k, got in decontaminate.simhashes(h, [1, 5, 12, 30]).items():
        for i in range(len(got)):
            part = [int(x) for x in h[i : i + k]]
            bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1).sum(0) > k // 2
            assert got[i] == np.packbits(bits).view(np.uint64)[0]


# ---------------------------------------------------------------- substrings


def test_cuts_do_not_depend_on_neighbours():
    a, b = words(1, 400).encode(), words(2, 300).encode()
    one = lambda *t: substrings.cuts(np.frombuffer(b"".join(t), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in t])]).astype(np.int64))
    both = one(a, b)
    assert both.tolist() == [*one(a).tolist(), *(len(a) + one(b)).tolist()]
    sizes = np.diff(np.concatenate([[0], one(a)]))
    assert sizes.max() <= substrings.LONGEST and sizes[:-1].min() > substrings.RADIUS
    # after an insertion the cuts fall into step again
    shifted = set((one(b"inserted text " + a) - 14).tolist())
    assert len(set(one(a).tolist()) & shifted) >= len(one(a)) - 3


def test_repeated_spans(make_docs, messy):
    passage = words(700, 60)
    pairs = [(1, words(1, 90) + " " + passage + " " + words(2, 80)), (2, words(3, 70) + "\n" + passage + " " + words(4, 90)), (3, words(5, 200)), (4, passage), (5, words(9, 40) * 1), (None, passage), (6, None), (7, ""), (8, "é" * 5000), (9, "x" * 9000), (9, "x" * 9000)]
    got = {r["doc_id"]: r for r in substrings.repeated_spans(make_docs(*pairs)).collect()}
    assert len(got) == len(pairs) - 1
    text = {p[0]: (p[1] or "").encode() for p in pairs}
    for d in (2, 4):
        r = got[d]
        assert r["removed_bytes"] > 0.4 * len(passage) and r["owners"] == [1]
        for a, b in zip(r["starts"], r["ends"]):
            assert text[d][a:b] in text[1]
    assert all(got[d]["removed_bytes"] == 0 for d in (1, 3, 5, 6, 7, None)) and got[6]["n_chunks"] == 0
    cut = {r["doc_id"]: r["text"] for r in substrings.deduplicate(make_docs(*pairs[:4])).collect()}
    assert cut[1] == pairs[0][1] and len(cut[2]) < len(pairs[1][1]) and cut[2].startswith(words(3, 70)[:200])
    assert substrings.repeated_spans(make_docs()).collect() == []
    assert len(substrings.repeated_spans(make_docs(*messy)).collect()) == len(messy)


def test_deduplicate_keeps_every_row(spark, make_docs):
    passage = words(700, 60)
    rows = [(1, words(1, 40) + " " + passage), (2, words(2, 40) + " " + passage), (2, words(2, 40) + " " + passage), (2, words(3, 40) + " " + passage), (None, passage), (3, None), (4, ""), (5, "é" * 9000)]
    docs = make_docs(*rows).withColumnsRenamed({"size": "starts", "place": "print", "keys": "of"})
    got = sorted(substrings.deduplicate(docs).collect(), key=repr)
    assert len(got) == len(rows) and got[0].__fields__ == docs.columns
    texts = sorted(r["text"] for r in got if r["doc_id"] == 2)
    assert texts[0] == texts[1] or texts[1] == texts[2]
    assert all(len(t) < len(rows[1][1]) - 200 for t in texts) and {r["text"] for r in got if r["doc_id"] in (1, None)} == {rows[0][1], passage}
    assert substrings.deduplicate(make_docs()).collect() == []


def test_how_much_of_a_passage_is_found(make_docs):
    """By brute force, which knows where the passages are: passages of 250 bytes or more are found, and most of their bytes."""
    pairs, want = [], {}
    for k, size in enumerate(s for s in (160, 200, 250, 300, 400, 600, 1000) for _ in range(20)):
        passage = words(10_000 + k, size)[:size]
        pairs += [(2 * k, words(20_000 + k, 60) + " " + passage + " " + words(30_000 + k, 60)), (2 * k + 1, words(40_000 + k, 50) + "\n" + passage + "\n" + words(50_000 + k, 60))]
        want[2 * k + 1] = passage
    got = {r["doc_id"]: r for r in substrings.repeated_spans(make_docs(*pairs)).collect()}
    text = {d: t.encode() for d, t in pairs}
    found, covered = {}, {}
    for d, passage in want.items():
        n, first = len(passage), text[d].index(passage.encode())
        inside = sum(max(0, min(b, first + n) - max(a, first)) for a, b in zip(got[d]["starts"], got[d]["ends"]))
        found.setdefault(n, []).append(inside > 0)
        covered.setdefault(n, []).append(inside / n)
        assert all(a >= first - 40 and b <= first + n + 40 for a, b in zip(got[d]["starts"], got[d]["ends"]))
    mean = lambda x: sum(x) / len(x)
    assert mean(found[200]) >= 0.85 and all(mean(found[n]) == 1 for n in (250, 300, 400, 600, 1000))
    assert mean(covered[250]) > 0.7 and mean(covered[400]) > 0.8 and mean(covered[1000]) > 0.9


def test_documents_that_only_share_a_passage_do_not_chain(make_docs, monkeypatch):
    """Boilerplate makes all documents candidates of one another by tables; signatures keep them apart, so no texts meet."""
    shared = words(60, 60)
    pairs = [(i, shared + " " + words(100 + i, 60)) for i in range(60)]
    met = []
    real = minhash._forest_of
    monkeypatch.setattr(minhash, "_forest_of", lambda members, *a: met.append((a[-1], members.count())) or real(members, *a))
    got = minhash.near_duplicates(make_docs(*pairs), 85).collect()
    assert all(r["component_id"] == r["doc_id"] for r in got)
    assert dict(met)["near"] > 60 and dict(met)["links"] == 0


@pytest.mark.parametrize("block", [4, 1024])
def test_large_groups_lose_no_link(make_docs, monkeypatch, block):
    """A core of near copies, pairs that are alike but not like the core, and all pairs compared by brute force."""
    base, pairs = words(77, 90).split(" "), []
    for i in range(30):
        w = base[:]
        w[(i * 7) % 90] = f"v{i}"
        if i % 5 == 0:  # farther from the core, like one another
            w[10:22] = [f"far{k}" for k in range(12)]
        pairs.append((i + 1, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", block)
    for deviations in (4.5, None):
        got = minhash.near_duplicates(make_docs(*pairs), 80, deviations=deviations).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_near(pairs, 80)


def test_ridge_is_that_of_all_rows_at_once(spark):
    """Sums by partition give the weights and bins of the normal equations over all rows."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, len(quality.STATISTICS))).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "stats array<float>, label int").repartition(5)
    model = quality.fit(rows)
    x = x.astype(float)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    f = quality.fourier(x, mean, spread)
    shrink = np.full(f.shape[1], quality.RIDGE)
    shrink[-1] = 1e-6
    assert np.allclose(model["mean"], mean) and np.allclose(model["weights"], np.linalg.solve(f.T @ f + np.diag(shrink), f.T @ y), atol=1e-4)
    p = quality.predict(x, model)
    assert ((p >= 0.5) == (y == 1)).mean() > 0.9 and quality.fit(rows.where("label = 1")) == {"constant": 1.0}


def test_quotation_marks_of_several_kinds():
    for text in ('he "x', "er „x", "il «x", "she “x"):
        raw = text.encode()
        data, at = np.frombuffer(raw, np.uint8), np.array([len(raw) - 1])
        assert toxicity.Scorer._quoted(data, np.array([0, len(raw)]), at, np.array([0])).tolist() == [True]
    raw = "«a» x".encode()
    assert toxicity.Scorer._quoted(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), np.array([len(raw) - 1]), np.array([0])).tolist() == [False]


def test_stages_take_any_rows(spark, tmp_path, make_docs, messy):
    """Null, empty and very long texts, repeated ids, clashing names and empty tables go through every filtering stage."""
    import corpus_pipeline

    spark.createDataFrame([(1, 1), (4, 0), (12, 0), (None, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(4, 30)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = make_docs(*messy).withColumnsRenamed({"place": "stay", "keys": "cls", "component": "one", "score": "label"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), str(tmp_path)).collect() == [], name
        docs = stage(spark, docs, str(tmp_path))
        rows = docs.collect()
        assert docs.columns[:2] == ["doc_id", "text"] and len(docs.columns) == 10, name
        assert any(r["doc_id"] == 6 for r in rows) or name == "mixing", name
    assert not any(r["doc_id"] == 12 for r in rows)


def test_pipeline_is_its_stages(spark, tmp_path, make_docs):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    texts, labels = _labelled(spark, make_docs)
    texts = texts[:120] + [(300, texts[1][1]), (301, words(800, 60) + " " + words(801, 30))]
    make_docs(*[(d, t, f"s{d % 3}") for d, t in texts]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, words(800, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in texts if not (i < 120 and i % 4 == 0) and i not in (300, 301)}
    assert {r["doc_id"] for r in got} <= set(kept)
    sizes = {s: sum(len(WORD.findall(t)) for i, t in kept.items() if i % 3 == s) for s in range(3)}
    want = brute_targets(sizes, {0: 5, 1: 2, 2: 1}, 3)
    taken = {s: sum(len(WORD.findall(kept[r["doc_id"]])) for r in got if r["doc_id"] % 3 == s) for s in range(3)}
    assert all(abs(taken[s] - want[s]) < 100 for s in range(3))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_ids"]
