"""Personal data, importance resampling and tokenizer alignment against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import alignment, pii, resample
from tests.llm.conftest import DOC, words

KINDS = ("email", "ip", "card", "phone")
PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def check_digit(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            v, d = m.group(), re.sub("[^0-9]", "", m.group())
            if k == 0 or k == 1 and all(int(x) <= 255 for x in v.split(".")) or k == 2 and 12 <= len(d) <= 19 and check_digit(d) or k == 3 and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def told(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def number(r, n=16):
    """n digits with a right check digit."""
    s = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(s + c for c in "0123456789" if check_digit(s + c))


def private_rows():
    r = random.Random(5)
    texts = [
        None, "", " ", "a@b.cd_x@e.f", "a@b", "x.y+z@mail.example.com.", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1", "ü😀 " + number(r) + " +1 (212) 555-0134", "4" * 40,
        number(r, 12) + " " + number(r, 19), "+12345678", "+1234567890123456", "++1 2 3 4 5 6 7 8 9", "1-2-3", "é" * 300 + "q@w.de" + "é" * 300, "a" * 100_000, "1" * 100_000, "1 " * 40_000, "a@" * 30_000, "1." * 30_000, "+1" * 20_000, ("u@v.w " * 3000),
    ]
    for _ in range(120):
        bits = [words(r.random(), 3), number(r), f"+{r.randint(1, 99)} ({r.randint(100, 999)}) {r.randint(100, 999)}-{r.randint(1000, 9999)}", ".".join(str(r.randint(0, 300)) for _ in range(4)), f"{words(r.random(), 1)}.{r.randint(0, 99)}@m.example.org", str(r.randint(0, 10**18)), "-", "é"]
        texts.append(r.choice(["", " ", "\n"]).join(r.choice(bits) for _ in range(r.randint(1, 9))))
    return texts


def test_personal_data_base(spark):
    texts = private_rows()
    df = spark.createDataFrame([(i, t, "en", "s", None, 7, "x", "k", "c", "s") for i, t in enumerate([*texts, texts[3], None])], DOC).unionByName(spark.createDataFrame([(None, texts[5], "en", "s", None, 7, "x", "k", "c", "s")], DOC))
    df = df.withColumns({c: F.lit("z") for c in ("row", "kind", "value", "start", "w", "instance", "pattern")})
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts) + 3
    for row in got:
        t = texts[5] if row["doc_id"] is None else [*texts, texts[3], None][row["doc_id"]]
        want = [] if t and set(t) == {"a"} else base_spans(t)
        assert tuple(row[f"n_{k}"] for k in KINDS) == tuple(sum(s[1] == k for s in want) for k in range(4)), t
        assert row["base_sha256"] == hashlib.sha256(told(want).encode()).hexdigest()
        assert set(told(want).split(",")) <= set(row["spans"].split(","))
    assert pii.personal_data(df.where("false")).collect() == []
    assert all(r["n_email"] == 0 for r in pii.personal_data(df.where("text is null")).collect())


def private_corpus():
    """Texts with identifiers at telling words, in strict and in looser spellings, and the same looser ones elsewhere."""
    r, texts, unseen = random.Random(9), [], {}
    for i in range(60):
        texts.append(f"{words(i, 20)} Reach me by phone: +1 (212) 555-{1000 + i} or later. {words(i + 100, 20)}")
        texts.append(f"{words(i + 200, 20)} my e-mail address is user{i}@mail.example.org thanks {words(i + 300, 20)}")
        texts.append(f"{words(i + 400, 20)} paid with card number {number(r)} today {words(i + 500, 20)}")
    for i in range(12):
        unseen[len(texts)] = ("phone", f"555-{2000 + i}-77")
        texts.append(f"{words(i + 600, 20)} Reach me by phone: 555-{2000 + i}-77 or later. {words(i + 700, 20)}")
        unseen[len(texts)] = ("email", f"user{i} (at) example (dot) org")
        texts.append(f"{words(i + 800, 20)} my e-mail address is user{i} (at) example (dot) org thanks {words(i + 900, 20)}")
    # known by its context once, met without it elsewhere
    unseen[len(texts)] = ("phone", "555-2003-77")
    texts.append(f"{words(1000, 20)} 555-2003-77 {words(1001, 20)}")
    clean = len(texts)
    for i in range(40):
        texts.append(f"{words(i + 1300, 20)} order phone: 777-{3000 + i}-88 {words(i + 1400, 20)}")
        texts.append(f"{words(i + 1100, 20)} order 555-{3000 + i}-88 shipped at 12:30:{10 + i % 50} in version 1.2.3 {words(i + 1200, 20)}")
    return texts, unseen, clean


def brute_found(texts):
    """The same method in plain Python: (document, start, kind, end) of what only contexts gave."""
    loose = re.compile(pii.LOOSE.replace("++", "+").replace("*+", "*"))
    split = lambda s: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", s.lower()) if w]
    hits, grams = [], Counter()
    for d, t in enumerate(texts):
        w = split(t)
        for n in range(1, 4):
            grams.update(" ".join(w[i : i + n]) for i in range(len(w) - n + 1))
        known = base_spans(t)
        for k, p in enumerate(PLAIN):
            ms, at = list(re.finditer(p, t)), 0
            for m, nxt in zip(ms, [*(x.start() for x in ms[1:]), len(t)]):
                if (m.start(), k, m.end()) in known:
                    hits.append((d, m.start(), m.end(), k, t[at : m.start()][-120:], t[m.end() : nxt][:120]))
                at = m.end()
        ms, at = list(loose.finditer(t)), 0
        for m, nxt in zip(ms, [*(x.start() for x in ms[1:]), len(t)]):
            if all(b <= m.start() or a >= m.end() for a, _, b in known):
                hits.append((d, m.start(), m.end(), 4, t[at : m.start()][-120:], t[m.end() : nxt][:120]))
            at = m.end()

    def shape(v):
        n = len(re.sub("[^0-9]", "", v))
        colons = re.fullmatch("[0-9A-Fa-f:]*", v) and ":" in v
        mail = not colons and re.search("[A-Za-z]", v)
        quad = re.fullmatch(r"[0-9]+(\.[0-9]+){3}", v)
        out = {0} if mail else set()
        out |= {1} if colons and v.count(":") >= 2 and len(v) >= 6 or quad else set()
        return out | ({2} if not mail and not colons and 12 <= n <= 19 else set()) | ({3} if not mail and not colons and not quad and 7 <= n <= 15 else set())

    edges, chosen, values = Counter(), set(), {}
    sides = []
    for d, a, b, k, before, after in hits:
        v = texts[d][a:b]
        if k == 4 and not shape(v):
            continue
        i = (k, re.sub(r"\s+", "", v.lower()))
        values[i] = v
        left, right = split(before), split(after)
        left = left[1:] if len(before) >= 120 else left
        right = right[:-1] if len(after) >= 120 else right
        ls = ["L " + " ".join(left[-n:]) for n in range(1, 4) if len(left) >= n]
        rs = ["R " + " ".join(right[:n]) for n in range(2, 4) if len(right) >= n]
        sides += [(i, ls), (i, rs)]
        for p in ls + rs:
            edges[p, i] += 1
    degree = Counter(p for p, _ in edges)
    met = Counter()
    for (p, _), n in edges.items():
        met[p] += n
    of = lambda i: {i[0]} if i[0] < 4 else shape(values[i])
    for i, ps in sides:
        ps = [p for p in ps if degree[p] >= pii.SUPPORT]
        if ps and i[0] == 4:
            chosen.add((ps[-1], i))
    accepted = {}
    for _ in range(pii.ROUNDS):
        known, shaped, good = Counter(), Counter(), {}
        for p, i in edges:
            for k in of(i):
                shaped[p, k] += 1
                known[p, k] += i[0] == k or accepted.get(i, (0, 9))[1] == k
        for (p, k), n in known.items():
            score = n / (n + 0.25 * (shaped[p, k] - n) + degree[p] - shaped[p, k] + max(grams[p[2:]] - met[p], 0)) if n else 0
            if degree[p] >= pii.SUPPORT and n >= pii.SUPPORT and score >= pii.CONFIDENCE:
                good[p, k] = score
        now = {}
        for p, i in chosen:
            for k in of(i):
                if (p, k) in good:
                    now[i] = max(now.get(i, (0, -9)), (good[p, k], -k))
        now = {i: (s, -k) for i, (s, k) in now.items()}
        if len(now) == len(accepted):
            accepted = now
            break
        accepted = now
    return {(d, a, accepted[i][1], b) for d, a, b, k, _, _ in hits for i in [(k, re.sub(r"\s+", "", texts[d][a:b].lower()))] if k == 4 and i in accepted}


def test_personal_data_by_context(spark):
    texts, unseen, clean = private_corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.personal_data(df).collect()}
    for i, (kind, value) in unseen.items():
        at = texts[i].index(value)
        assert f"{kind}:{at}:{at + len(value)}" in got[i]["spans"].split(","), texts[i]
    assert all(got[i]["spans"] == "" for i in range(clean, len(texts)))
    more = {(r["doc_id"], r["start"], r["kind"], r["end"]) for r in pii.spans(df).where("not base").collect()}
    assert more == brute_found(texts) and sum(r["n_more"] for r in got.values()) == len(more)
    hidden = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert hidden[0] == texts[0].replace("+1 (212) 555-1000", "[phone]") and hidden[clean] == texts[clean]


def test_personal_data_with_a_hot_identifier(spark):
    texts, unseen, clean = private_corpus()
    first = next(iter(unseen))
    rows = list(enumerate(texts)) + [(10_000 + i, texts[first]) for i in range(300)]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and {got[10_000 + i]["spans"] for i in range(300)} == {got[first]["spans"]} != {""}


# ---------------------------------------------------------------- resampling


def brute_resample(rows, target, percent=5, least=20):
    def runs(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    docs = [(d, *runs(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in docs for b in f), Counter(b for x in target for b in runs(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for d, n, f in docs:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = {id(x): i for i, x in enumerate(fit[: percent * len(fit) // 100], 1)}
    return sorted(((*x[:4], ranks.get(id(x))) for x in out), key=str)


def test_resample(spark, messy, make_docs):
    target = [words(2, 40).upper(), None, "", "Ünd ÄB\x80c x", words(50, 30)]
    rows = [(p[0], p[1]) for p in messy if p[0] is not None] + [(100 + i, words(60 + i, 15 + i)) for i in range(80)] + [(300, "İstanbul É " * 12), (301, "a"), (302, "a B"), (303, "0-9 zz")]
    t = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    for percent in (5, 60):
        got = resample.resample(make_docs(*rows), t, percent=percent).collect()
        want = brute_resample(rows, target, percent)
        # of rows that repeat a doc_id and a text either may have the rank
        assert sorted((tuple(r) for r in got), key=str) == want
    assert resample.resample(make_docs(*rows).where("false"), t).collect() == []
    assert len(resample.resample(make_docs(*messy), t.where("false")).collect()) == len(messy)
    drawn = resample.draw(make_docs(*rows), t, percent=60).collect()
    assert {r["doc_id"] for r in drawn} == {w[0] for w in brute_resample(rows, target, 60) if w[4]} and drawn[0]["size"] == 7


def test_numbered_over_ranges(spark):
    df = spark.range(5000).withColumn("x", F.when(F.col("id") < 3000, 1).otherwise(F.col("id") % 50))
    got = [(r["x"], r["id"], r["n"]) for r in resample.numbered(df, F.desc("x"), F.asc("id")).collect()]
    assert [g[:2] for g in sorted(got, key=lambda g: g[2])] == sorted((g[:2] for g in got), key=lambda g: (-g[0], g[1]))
    assert sorted(g[2] for g in got) == list(range(1, 5001))


# ---------------------------------------------------------------- alignment


def brute_alignment(rows, a_path, b_path):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)
    letters, names = alignment.byte_level(), {i: p for p, i in a.get_vocab().items()}
    docs, count = [], Counter()
    for d, t in rows:
        text = (" " + (t or "")).encode()
        xs, ys = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        wx = [bytes(letters[c] for c in names[i]) for i in xs]
        wy = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ys]
        if not t or b"".join(wx) != text or b"".join(wy) != text:
            docs.append((d, 0, 0, [], []))
            continue
        ex, ey = (np.cumsum([len(x) for x in w]).tolist() for w in (wx, wy))
        groups, i, j = [], 0, 0
        for c in sorted(set(ex) & set(ey)):
            i2, j2 = sum(e <= c for e in ex) if len(ex) < 500 else int(np.searchsorted(ex, c, "right")), int(np.searchsorted(ey, c, "right"))
            groups.append(",".join(map(str, xs[i:i2])) + "|" + ",".join(map(str, ys[j:j2])))
            i, j = i2, j2
        links, i, j = [], 0, 0
        while i < len(xs) and j < len(ys):
            links.append((xs[i], ys[j]))
            i, j = i + (ex[i] <= ey[j]), j + (ey[j] <= ex[i])
        count.update(set(links))
        docs.append((d, len(xs), len(ys), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    return sorted(((d, x, y, len(g), len(k), sum(count[p] == best[p[0]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, x, y, g, k in docs), key=str)


@pytest.fixture(scope="module")
def vocabularies():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


ODD = [
    "a", " ", "  ", "\n", " x", "x ", "hello  world\nfoo\tbar", "▁a", "a ▁ b", "a\x00b c", "<s>hi</s> <unk> <0x0A>", "x <|endoftext|> y", "don't we'll  they 've", "é é ﬁ　a\xa0b \xa0 c   d", "a \u0085b", "x  y z", "​ a ﻿ b",
    "日本語 テキスト 😀 👩‍👩‍👧 é ñ", "1234567 12.5 1,000", "tab\t\tx  \n\n  y \r\n z", "a\x1c b\x1f c", "   lead", "trail   ", "A" * 3000, "ab " * 3000, "'s 't", "x' s", "naïve—dash – x… “q” ", "\x7f a",
]


def test_alignment(spark, messy, make_docs, vocabularies, monkeypatch):
    rows = [(p[0], p[1]) for p in messy if p[0] is not None and len(p[1] or "") < 50_000] + [(100 + i, t) for i, t in enumerate(ODD)] + [(200 + i, words(i, 60).replace("ta", "\n", i)) for i in range(40)]
    df = make_docs(*rows).withColumns({c: F.lit("z") for c in ("block", "pair", "docs", "places", "links", "count", "best")})
    want = brute_alignment(rows, *vocabularies)
    got = sorted((tuple(r) for r in alignment.alignment(df.repartition(3), *vocabularies).collect()), key=str)
    assert got == want
    assert alignment.alignment(df.where("false"), *vocabularies).collect() == []
    assert [tuple(r) for r in alignment.alignment(df.where("text is null").limit(1), *vocabularies).collect()][0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_in_small_blocks_and_with_little_memory(spark, vocabularies, monkeypatch):
    """Stretches that are forgotten and learnt again give the same as whole texts."""
    import pyarrow as pa

    from corpusloom.llm import kernels as K

    monkeypatch.setattr(alignment, "REMEMBER", 30)
    pair, whole = alignment.Pair(*vocabularies), alignment.Pair(*vocabularies)
    assert pair.cuts
    whole.cuts = False
    texts = [*ODD, *(words(i, 50) for i in range(30)), None, ""]
    for p in (7, 200, 1 << 20):
        for (_, n, data, offsets) in K.text_blocks(alignment.spaced(pa.array(texts, pa.string())), p):
            x, y = alignment.align_block(pair, data, offsets), alignment.align_block(whole, data, offsets)
            for c in ("n_a", "n_b", "n_groups", "n_links", "pairs", "docs", "places", "links", "bounds"):
                assert x[c].tolist() == y[c].tolist(), c
            assert len(x["n_a"]) == n


def test_align_by_hand():
    groups, links, of_a, of_b, stops = alignment.align(10, np.array([2, 4, 6, 10]), np.array([1, 4, 7, 10]), np.array([0, 4, 4, 10]))
    assert groups.tolist() == [1, 0, 1] and links.tolist() == [3, 0, 3]
    assert list(zip(of_a.tolist(), of_b.tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (3, 3)] and stops.tolist() == [1, 2, 4, 6, 7, 10]


def test_mix_keeps_columns_of_any_name(spark):
    """Columns named like the plan's own come out as they went in."""
    from corpusloom.llm import mixing

    helpers = ["_m_copies", "_m_last", "_m_turn", "_m_p_source", "__m_whole", "_m_C_Bin"]
    df = spark.createDataFrame([(i, words(i, 10 + i), f"s{i % 3}") for i in range(30)], "doc_id long, text string, source string").withColumns({c: F.lit(7 + k) for k, c in enumerate(helpers)})
    got = mixing.expand(df)
    assert got.columns == df.columns
    taken = Counter(r["doc_id"] for r in got.collect())
    assert taken and {tuple(r[c] for c in helpers) for r in got.collect()} == {(7, 8, 9, 10, 11, 12)}
    assert taken == {r["doc_id"]: r["copies"] for r in mixing.mix(df.drop(*helpers)).collect() if r["copies"]}
