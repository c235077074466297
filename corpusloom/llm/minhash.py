"""MinHash near-duplicate detection with tensored banding.

Two collections A and B of `tables` short keys (each of `rows` MinHash values)
are formed; the table (i, j) has the key (A_i, B_j). So tables**2 tables of
2 * rows values come from 2 * tables * rows MinHash values, about the square
root of what separate tables would take. Documents that share a table key are
candidates; every link is confirmed on the full shingle sets.

Documents with equal shingle sets form one class first, and only one member of
a class is compared. Candidates are not expanded into pairs. Classes that share
a key A_i come together with their signatures; those that share a table and
whose signatures agree enough are near, and a kernel emits a spanning forest of
what is near. Only the components of these links are the candidate groups, so
texts that share a passage but are not alike do not chain into one group. The
texts of a group then come together, and a kernel emits a spanning forest of
the links confirmed on full sets.

A group of more than a block is worked through in two steps (`_forest_of`): each
block against the first one, which joins all of a group of near copies with
linear work, and then only what is not in the group's largest part against all
of the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.llm.common import join_hot, map_groups, materialise, tidy, unused
from corpusloom.llm.components import Forest, components

ROWS, TABLES, SIZE = 3, 12, 5
#: Words and texts that one block holds at most (unless a single text has more).
BLOCK_WORDS, BLOCK_TEXTS = 400_000, 1024
_HASHES = 2 * ROWS * TABLES
_A, _X = K.splitmix(5, _HASHES) | K.U64(1), K.splitmix(6, _HASHES)


def _signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash values of each text with at least one shingle."""
    has = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(has), _HASHES), K.U64)
    if len(has):
        for k in range(_HASHES):
            v = shingles ^ _X[k]
            v *= _A[k]
            out[:, k] = np.minimum.reduceat(v, offsets[has])
    return out


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, words = K.word_spans(data, offsets)
    return K.shingle_hashes(K.span_hashes(data, starts, ends), words, size)


def _sets(shingles: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [np.unique(shingles[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _print_of(shingle_set: np.ndarray) -> tuple[int, int]:
    """Two sums over a set, which name it."""
    one, two = int(K.mix(shingle_set + K.U64(1)).sum()), int(K.mix(shingle_set ^ K.U64(0xA5A5A5A5A5A5A5A5)).sum())
    return one - (one >> 63 << 64), two - (two >> 63 << 64)


def _keys(signatures: np.ndarray) -> np.ndarray:
    """The 2 * TABLES short keys: those of A, then those of B."""
    out = np.empty((len(signatures), 2 * TABLES), K.U64)
    for t in range(2 * TABLES):
        key = np.full(len(signatures), t + 1, K.U64)
        for r in range(ROWS):
            key = K.mix(key * K.U64(0x9E3779B97F4A7C15) ^ signatures[:, t * ROWS + r])
        out[:, t] = key
    return out


def _fixed(signs: np.ndarray) -> pa.Array:
    """Each row as binary."""
    n, width = signs.shape
    offsets = np.arange(0, (n + 1) * 2 * width, 2 * width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(signs))])


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in K.text_blocks(batch.column(1)):
                shingles, so = _shingles(data, offsets, size)
                sets = _sets(shingles, so)
                prints = np.array([_print_of(s) for s in sets], np.int64).reshape(-1, 2)
                signatures, filled = _signatures(shingles, so), np.diff(so) > 0
                keys, signs = _keys(signatures), np.zeros((n, _HASHES), np.uint16)
                signs[filled] = (signatures >> K.U64(48)).astype(np.uint16)
                ends = np.concatenate([[0], np.cumsum(np.where(filled, 2 * TABLES, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), _fixed(signs), pa.ListArray.from_arrays(pa.array(ends), pa.array(K.as_long(keys.reshape(-1))))],
                    names=["doc_id", "n_shingles", "one", "two", "signs", "keys"],
                )

    return run


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def agreeing(percent: int, deviations: float | None) -> int:
    """MinHash values that must agree: so many standard deviations below what is expected at the threshold; none if None."""
    s = percent / 100
    return 0 if deviations is None else int(np.floor(_HASHES * s - deviations * np.sqrt(_HASHES * s * (1 - s))))


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, Forest]:
    """(ids, rows of block i, rows of block j, forest that already joins what has one label)."""
    ids, labels = group["cls"].to_numpy(), group["label"].to_numpy()
    block, i, j = group["block"].to_numpy(), group["i"][0].as_py(), group["j"][0].as_py()
    forest, head = Forest(len(ids)), {}
    for x, label in enumerate(labels.tolist()):
        forest.join(head.setdefault(label, x), x)
    left = np.flatnonzero(block == i)
    return ids, left, left if i == j else np.flatnonzero(block == j), forest


def _links(ids: np.ndarray, links: list[tuple[int, int]]) -> list[pa.RecordBatch]:
    if not links:
        return []
    out = ids[np.array(links)]
    return [pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["src", "dst"])]


def _near(least: int):
    """Links of classes that share a table and have `least` MinHash values in common, as a spanning forest."""

    def run(group: pa.Table) -> list[pa.RecordBatch]:
        ids, left, right, forest = _sides(group)
        if len(ids) < 2:
            return []
        signs = np.frombuffer(b"".join(group["signs"].to_pylist()), np.uint16).reshape(len(ids), _HASHES)
        other, links, apart = np.ascontiguousarray(signs[right].T), [], len(ids) - 1
        for x in left.tolist():
            same = other == signs[x][:, None]
            table = same[ROWS * TABLES :].reshape(TABLES, ROWS, -1).all(1).any(0)
            for y in right[table & (same.sum(0) >= least)].tolist():
                if y != x and forest.join(x, y):
                    links.append((x, y))
                    apart -= 1
            if not apart:
                break
        return _links(ids, links)

    return run


def _compare(size: int, percent: int, least: int):
    """Confirmed links of one block pair, as a spanning forest; pairs of fewer common MinHash values are not confirmed."""

    def run(group: pa.Table) -> list[pa.RecordBatch]:
        group = group.combine_chunks()
        ids, left, right, forest = _sides(group)
        if len(ids) < 2:
            return []
        sets: list[np.ndarray] = []
        signs = np.zeros((len(ids), _HASHES), np.uint32)
        for at, n, data, offsets in K.text_blocks(group["text"]):
            shingles, so = _shingles(data, offsets, size)
            sets += _sets(shingles, so)
            signs[at : at + n][np.diff(so) > 0] = (_signatures(shingles, so) >> K.U64(32)).astype(np.uint32)
        lens, links, apart = np.array([len(x) for x in sets]), [], len(ids) - 1
        other = np.ascontiguousarray(signs[right].T)
        for x in left.tolist():
            same = (other == signs[x][:, None]).sum(0)
            hit = (same >= least) & (lens[right] * 100 >= percent * lens[x]) & (lens[x] * 100 >= percent * lens[right])
            for y in right[hit][np.argsort(-same[hit], kind="stable")].tolist():
                if y != x and forest.root(x) != forest.root(y) and _linked(sets[x], sets[y], percent):
                    forest.join(x, y)
                    links.append((x, y))
                    apart -= 1
            if not apart:
                break
        return _links(ids, links)

    return run


def _forest_of(members: DataFrame, payload: DataFrame, kernel, weight: int, name: str) -> DataFrame:
    """Links (src, dst) that the kernel finds among the members of each group, enough to join all that belongs together.

    members: (group, cls, weight); payload: (cls, what the kernel reads); `weight` and BLOCK_TEXTS bound a
    block. A group of one block is compared whole. Of a larger one every block is compared with the first;
    then the members outside its largest part are compared with all of it.
    """
    columns = [c for c in payload.columns if c != "cls"]

    def compared(placed: DataFrame, step: str) -> DataFrame:
        units = placed.join(payload, "cls").select(F.xxhash64("group", "i", "j").alias("unit"), "cls", "label", "block", "i", "j", *columns)
        return materialise(map_groups(units, "unit", kernel, "src long, dst long"), f"{name}-{step}")

    count = F.greatest(F.ceil(F.sum("weight") / weight), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("long")
    groups = materialise(members.groupBy("group").agg(F.count("*").alias("n"), count.alias("blocks")).where("n > 1"), f"{name}-groups")
    placed = join_hot(members, groups, ["group"], "n").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    zero = F.lit(0).cast("long")
    turns = F.explode(F.when(F.col("block") == 0, F.sequence(zero, F.col("blocks") - 1)).otherwise(F.array("block")))
    links = compared(placed.select("group", "cls", F.col("cls").alias("label"), "block", zero.alias("i"), turns.alias("j")), "first")
    if not groups.where("blocks > 1").limit(1).count():
        return links
    large = placed.where("blocks > 1").select("group", "cls", "weight").join(components(links).select(F.col("node").alias("cls"), F.col("component").alias("label")), "cls", "left")
    large = materialise(large.withColumn("label", F.coalesce("label", "cls")), f"{name}-large")
    parts = large.groupBy("group", "label").agg(F.count("*").alias("size")).groupBy("group").agg(F.max(F.struct("size", "label")).alias("most"), F.count("*").alias("parts"), F.sum("size").alias("n"))
    rest = join_hot(large, parts.where("parts > 1").select("group", F.col("most.label").alias("core"), "n"), ["group"], "n")
    rest = materialise(rest.withColumn("out", F.col("label") != F.col("core")).drop("core"), f"{name}-rest")
    sizes = rest.groupBy("group", "out").agg(F.count("*").alias("n"), count.alias("blocks")).groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("out"), F.col("blocks"))).alias("outer"), F.sum(F.when(~F.col("out"), F.col("blocks"))).alias("inner"))
    rest = join_hot(rest, sizes, ["group"], "n").withColumn("block", F.when(F.col("out"), F.pmod(F.xxhash64("cls"), F.col("outer"))).otherwise(F.col("outer") + F.pmod(F.xxhash64("cls"), F.col("inner"))))
    rest = rest.withColumn("k", F.explode(F.sequence(zero, F.col("outer") + F.when(F.col("out"), F.col("inner")).otherwise(0) - 1)))
    more = compared(rest.select("group", "cls", "label", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j")), "rest")
    return links.unionByName(more)


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = SIZE, text: str = "text", doc_id: str = "doc_id", deviations: float | None = 4.5) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets A and B of
    `size`-word shingles (A-Z lower-cased; a shorter text is one shingle). component_id is the
    smallest doc_id reachable over links, kept says that it is the document itself.

    Null, empty and all-white texts have no shingles and link with nothing. A null doc_id links
    with nothing, has a null component_id and is kept. Rows that repeat a doc_id count as that
    one document: each gets a row. An empty table gives an empty result. Other columns of docs
    are ignored. A table key meets a linked pair of similarity s with probability
    (1 - (1 - s**ROWS)**TABLES)**2: above 0.9996 at 0.8 and above 0.99997 at 0.85. Of those that meet, pairs
    whose MinHash values agree less than `deviations` standard deviations below the threshold are not
    confirmed (at 4.5 about three in a million linked pairs); None confirms all that meet.
    """
    bare = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketch = materialise(bare.mapInArrow(tidy(_sketch(size)), "doc_id long, n_shingles long, one long, two long, signs binary, keys array<long>"), "sketch")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    kind = ["one", "two", "n_shingles"]
    classes = materialise(some.groupBy(*kind).agg(F.min("doc_id").alias("cls"), F.count("*").alias("copies")), "classes")
    # one row for each class; a repeated doc_id may stand for several
    reps = some.join(classes.select(*kind, F.col("cls").alias("doc_id")), [*kind, "doc_id"], "left_semi").select(F.col("doc_id").alias("cls"), "signs", "keys")
    reps = materialise(reps, "reps")
    short = reps.select("cls", F.posexplode("keys").alias("t", "key"))
    met = short.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    alive = join_hot(short, met, ["key"], "n").groupBy("cls").agg(F.collect_set(F.when(F.col("t") < TABLES, F.col("key"))).alias("a"), F.max("t").alias("last"))
    alive = alive.where((F.size("a") > 0) & (F.col("last") >= TABLES))
    least = agreeing(percent, deviations)
    near = _forest_of(alive.select(F.explode("a").alias("group"), "cls", F.lit(1).alias("weight")), reps.select("cls", "signs"), _near(least), BLOCK_TEXTS, "near")
    groups = materialise(components(near), "groups")
    words = classes.groupBy("cls").agg(F.max("n_shingles").alias("weight"))
    texts = bare.where("doc_id is not null and text is not null").select(F.col("doc_id").alias("cls"), "text")
    links = _forest_of(groups.select(F.col("component").alias("group"), F.col("node").alias("cls")).join(words, "cls"), texts, _compare(size, percent, least), BLOCK_WORDS, "links")
    # rows that repeat a doc_id join its classes
    several = some.select("doc_id", *kind).distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    repeats = some.select("doc_id", *kind).join(several, "doc_id", "left_semi").join(classes, kind).select(F.col("doc_id").alias("src"), F.col("cls").alias("dst"))
    joined = components(links.unionByName(repeats))
    ends = classes.join(joined.select(F.col("node").alias("cls"), "component"), "cls", "left").select(*kind, "copies", F.coalesce("component", "cls").alias("component_id"))
    out = join_hot(sketch.select("doc_id", *kind), materialise(ends, "ends"), kind, "copies", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs of which one stays for each group of near-duplicates, with all their columns.

    Rows that repeat a doc_id are one document, and one of them stays: that with the smallest text, and of equal
    texts that whose row comes first as JSON, so reruns agree. Rows of a null doc_id stay, and so
    do documents without a text or words, each its own. An empty table stays empty; columns of any name go through.
    """
    found, key = near_duplicates(docs, percent), unused(docs, "stay")
    stay = found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("rows"))
    again, rows = materialise(stay, "stay"), docs.where("doc_id is not null")
    one = rows.join(again.where("rows = 1").select(key), rows["doc_id"].cast("long") == F.col(key), "left_semi")
    several = rows.join(again.where("rows > 1").select(key), rows["doc_id"].cast("long") == F.col(key), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    least = several.groupBy(F.col("doc_id").cast("long")).agg(F.min_by(whole, F.struct("text", F.to_json(whole))).alias("row"))
    return one.unionByName(least.select("row.*")).unionByName(docs.where("doc_id is null"))
