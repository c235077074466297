"""Importance resampling towards a target distribution, by hashed n-grams.

The words of each text become a table of positions (posexplode), and windows with
lead() over a document put the one and two following words beside each word, so
every run of one to three words is one expression of its row. Runs are hashed to
a fixed number of buckets, buckets are counted for the corpus and for the target,
and the gains of the buckets are joined back and summed by document.

Texts are dealt once, before their words are unfolded; the windows and the sums
by document keep that dealing, so no table of words is ever shuffled. Only the
table of gains is broadcast, which has at most BUCKETS rows whatever the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import materialise, shuffle_partitions

#: Buckets of n-grams; longest run of words.
BUCKETS, ORDER = 10_000, 3
#: Part of the documents that is drawn, in hundredths, and the words that a drawn one has at least.
PERCENT, LEAST_WORDS = 5, 20
# What parts words, all of ASCII but letters and digits.
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case, all else as it is; words of ASCII alone, the most, take the short way."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def positions(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, *keep, pos, word): the words of each row of docs, dealt by row; one row with null word for a text without words."""
    n = 2 * shuffle_partitions(docs.sparkSession)
    dealt = docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.col(text).cast("string").alias("text")).repartition(n, "row")
    words = F.filter(F.split(F.coalesce("text", F.lit("")), _SEPARATORS), lambda w: w != "")
    return dealt.select("row", *keep, F.posexplode_outer(words).alias("pos", "word")).withColumn("word", lower_ascii(F.col("word")))


def buckets(words: DataFrame, order: int = ORDER, count: int = BUCKETS) -> DataFrame:
    """The table of positions with b: the buckets of all runs of 1 to `order` words that begin there (null where a text ends)."""
    following = Window.partitionBy("row").orderBy("pos")
    ahead = words.withColumns({f"w{k}": F.lead("word", k).over(following) for k in range(1, order)})
    runs = [F.concat(*(x for k in range(n) for x in ([F.lit(" ")] if k else []) + [F.col(f"w{k}") if k else F.col("word")])) for n in range(1, order + 1)]
    others = [c for c in words.columns if c not in ("pos", "word")]
    return ahead.select(*others, F.explode(F.array(*(F.pmod(F.crc32(r.cast("binary")), F.lit(count)).cast("int") for r in runs))).alias("b"))


def bucket_counts(docs: DataFrame, text: str = "text", order: int = ORDER, count: int = BUCKETS) -> DataFrame:
    """(b, n): how many runs of all texts fall into each bucket."""
    return buckets(positions(docs, text), order, count).where("b is not null").groupBy("b").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", order: int = ORDER, count: int = BUCKETS) -> DataFrame:
    """(b, gain): thousandths of the logarithm of how much likelier a bucket is in the target than in the corpus, rounded down."""
    s = bucket_counts(docs, text, order, count).withColumnRenamed("n", "s")
    t = bucket_counts(target, target_text, order, count).withColumnRenamed("n", "t")
    both = materialise(s.join(t, "b", "full").select("b", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")), "buckets")
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    real = lambda c, more: (F.col(c) + more).cast("double")
    ratio = real("t", 1) * real("all_s", count) / (real("s", 1) * real("all_t", count))
    return both.crossJoin(F.broadcast(total)).select("b", F.floor(1000 * F.log(ratio)).alias("gain"))  # one row


def noise(doc_id: Column, seed: int | str = 42) -> Column:
    """Gumbel noise in thousandths, rounded down, from a hash of seed and doc_id (a null counts as '')."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with n = 1, 2, 3 ... in an order over all of them.

    The rows are dealt by ranges of the order and counted by range; a row's number is its place in its range
    after all ranges before. No task holds more than a range; the counts have one row for each.
    """
    spread = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).withColumn("part", F.spark_partition_id())
    spread = materialise(spread, "ranges")
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.groupBy("part").agg(F.count("*").alias("c")).select("part", F.coalesce(F.sum("c").over(upto), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return spread.withColumn("place", place).join(F.broadcast(before), "part").withColumn("n", F.col("place") + F.col("before")).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int | str = 42, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", order: int = ORDER, count: int = BUCKETS) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank (null for what is not drawn).

    Null, empty and wordless texts have no features and weight 0 and are never drawn. Rows that repeat a doc_id
    are documents of their own, with equal noise; ties go to the smaller doc_id, a null one last. An empty
    target gives gains against an empty distribution; an empty table gives no rows. Other columns of docs are
    not read.
    """
    gain = materialise(gains(docs, target, text, target_text, order, count), "gains")
    places = positions(docs.withColumnRenamed(doc_id, "doc_id") if doc_id != "doc_id" else docs, text, ("doc_id",))
    each = buckets(places, order, count).join(F.broadcast(gain), "b", "left")  # at most `count` rows
    sums = each.groupBy("row", "doc_id").agg(F.count("b").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    # w words have w + (w - 1) + ... runs of up to `order` words
    least = sum(max(least_words - k, 0) for k in range(order))
    scored = sums.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_features") >= max(least, 1))
    scored = materialise(scored, "scores")  # dealing by ranges reads its rows twice
    ranked = numbered(scored, F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row"))
    drawn = ranked.agg(F.floor(F.lit(percent) * F.count_if("fit") / 100).alias("drawn"))
    out = ranked.crossJoin(F.broadcast(drawn))  # one row
    return out.select("doc_id", "n_features", "weight", "score", F.when(F.col("n") <= F.col("drawn"), F.col("n").cast("long")).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of docs that are drawn, by distinct doc_id, with all their columns."""
    drawn = resample(docs, target, **options).where("rank is not null").select("doc_id").distinct()
    key = options.get("doc_id", "doc_id")
    return docs.join(drawn.withColumnRenamed("doc_id", key), key, "left_semi")

