"""Mixing sources to target weights by capped water-filling.

Each source gets a share of the whole in proportion to its weight, but at most
`max_epochs` times its own size; what the cap cuts off goes to the others by
weight until none is above its cap. The level is found in closed form from the
sources in the order of cap / weight, so one pass over a table with one row for
each source suffices.

A source's target is met by whole repetitions of all its documents and one
seeded fractional repetition. The fraction takes documents in the order of a
hash of doc_id up to the wanted number of words. The order is cut in two steps,
first by sums over hash bins, then within the one bin that the cut falls into,
so no task sees all rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import materialise

BINS = 4096


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and U+0009 to U+000D; 0 for null."""
    # one space per run, none at the ends: one more word than spaces
    squeezed = F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")
    trimmed = F.trim(squeezed)
    spaces = F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit("")))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(spaces + 1).cast("long")


def default_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights by turns over the sources by code point, null last; one row for each source."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds target to (source, source_size, weight); the targets sum to all sizes. One row for each source.

    Sources of size 0 or weight 0 get 0. If all weight lies on capped sources, the targets sum to less.
    """
    # cheapest cap for its weight first: cap_i / w_i ascending, compared exactly by cross products of decimals
    first = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    s = sources.where("weight > 0").withColumn("total", F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("size_upto", F.sum("source_size").over(upto)).withColumn("weight_upto", F.sum("weight").over(upto))
    # with this and all before it capped, is the level still at or above its cap? then it is capped
    left = F.col("total") - max_epochs * (F.col("size_upto") - F.col("source_size"))
    over = F.col("all_weight") - (F.col("weight_upto") - F.col("weight"))
    s = s.withColumn("capped", left * F.col("weight") >= max_epochs * F.col("source_size") * over)
    capped_size = F.coalesce(F.sum(F.when(F.col("capped"), F.col("source_size"))).over(everything), F.lit(0))
    capped_weight = F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), F.lit(0))
    level = (F.col("total") - max_epochs * capped_size).cast("double") / (F.col("all_weight") - capped_weight)
    s = s.withColumn("target", F.when(F.col("capped"), (max_epochs * F.col("source_size")).cast("double")).otherwise(F.col("weight") * level))
    none = sources.where("weight <= 0 or weight is null").withColumn("target", F.lit(0.0))
    return s.select("source", "source_size", "weight", "target").unionByName(none.select("source", "source_size", "weight", "target"))


def hash_place(doc_id: Column, seed: str = "") -> Column:
    """A seeded place of 0 to 2**32 - 1, of the digest of the id as text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")


def _sized(docs: DataFrame, seed: str, text: str, doc_id: str, source: str) -> DataFrame:
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    return d.withColumn("place", hash_place(F.col("doc_id"), seed))


def _bin(place: Column) -> Column:
    return F.shiftright(place, 20).cast("int")


def _order(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def plan_mix(d: DataFrame, weights: DataFrame | None, max_epochs: int) -> DataFrame:
    """From (doc_id, source, size, place): for each source its whole repetitions and the cut of the fraction."""
    bins = materialise(d.groupBy("source", _bin(F.col("place")).alias("bin")).agg(F.sum("size").alias("bin_size")), "bins")
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    if weights is None:
        sources = default_weights(sources)
    else:
        w = weights.select(F.col("source").alias("w_source"), "weight")
        sources = sources.join(w, sources["source"].eqNullSafe(w["w_source"]), "left").drop("w_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    p = water_fill(sources, max_epochs).withColumn("whole", F.least(whole, F.lit(max_epochs)).cast("long"))
    p = p.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    p = materialise(p.select(F.col("source").alias("p_source"), "rest", "whole", "source_size", "target"), "sources")
    # at most BINS rows for each source
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    begun = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0))).join(p, bins["source"].eqNullSafe(p["p_source"])).where("before < rest")
    cuts = begun.where("before + bin_size > rest").select(F.col("source").alias("c_source"), F.col("bin").alias("c_bin"), "before", "rest")
    # the rows of the one cut bin of each source, about one in BINS
    edge = d.join(cuts, d["source"].eqNullSafe(cuts["c_source"]) & (_bin(F.col("place")) == cuts["c_bin"]))
    edge = edge.groupBy("c_source", "c_bin", "place", "doc_id").agg(F.sum("size").alias("size"), F.min("before").alias("before"), F.min("rest").alias("rest"))
    upto = Window.partitionBy("c_source").orderBy("place", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("mid", F.col("before") + F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.col("size") / 2.0)
    # (place, doc_id) of the last one taken; below the bin all, above none
    last = edge.where("mid <= rest").groupBy(F.col("c_source").alias("l_source")).agg(F.max(F.struct("place", _order(F.col("doc_id")).alias("doc_id"))).alias("last"))
    c = cuts.join(last, F.col("c_source").eqNullSafe(F.col("l_source")), "left").select("c_source", "c_bin", "last")
    # without a cut bin the fraction ends between bins: with the last one begun
    ends = begun.groupBy(F.col("source").alias("e_source")).agg(F.max("bin").alias("end_bin"))
    p = p.join(c, p["p_source"].eqNullSafe(c["c_source"]), "left")
    p = p.join(ends, p["p_source"].eqNullSafe(ends["e_source"]), "left")
    return materialise(p.select("p_source", "whole", "source_size", "target", "c_bin", "last", "end_bin"), "plan")


def _copies(place: Column, prefix: str = "") -> Column:
    """How often a row with the plan of its source (columns with a prefix) is in the mix."""
    plan = lambda c: F.col(prefix + c)
    at, here = _bin(place), F.struct(place.alias("place"), _order(F.col("doc_id")).alias("doc_id"))
    taken = F.when(plan("c_bin").isNull(), at <= plan("end_bin")).otherwise((at < plan("c_bin")) | (at == plan("c_bin")) & (here <= plan("last")))
    return plan("whole") + F.coalesce(taken, F.lit(False)).cast("long")


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "", text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target, copies, taken (= copies * size).

    Sizes are words. weights: (source, weight) for every source, or None for 5, 2, 1 by turns. The null
    source is a source. Null or empty texts have size 0; they are in the mix as often as whole repetitions
    go, and with the fraction if it takes their place. Equal hashes are taken in the order of doc_id;
    rows that repeat a doc_id go together into or out of the fraction. A null doc_id is hashed as ''.
    The fraction ends with the document whose middle is nearest below its end, so a source misses its
    target by at most half of one document (or half of a doc_id's rows). An empty table gives an empty mix.
    """
    d = materialise(_sized(docs, seed, text, doc_id, source), "sizes")
    plan = plan_mix(d, weights, max_epochs)
    out = d.join(plan, d["source"].eqNullSafe(plan["p_source"])).withColumn("copies", _copies(F.col("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def expand(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "") -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns.

    Texts are joined with nothing but the plan, which has a row for each source. Null and empty texts have no
    words and are taken as `mix` says; the null source is a source; repeated rows are taken each for itself;
    an empty table gives none. Columns of any name stay as they are.
    """
    d = materialise(_sized(docs, seed, "text", "doc_id", "source"), "sizes")
    plan = plan_mix(d, weights, max_epochs)
    prefix = "_m_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    plan = plan.select(*(F.col(c).alias(f"{prefix}{c}") for c in plan.columns))
    out = docs.join(plan, docs["source"].cast("string").eqNullSafe(plan[f"{prefix}p_source"]))
    copies = _copies(hash_place(F.col("doc_id"), seed), prefix)
    out = out.withColumn(f"{prefix}copies", copies).where(F.col(f"{prefix}copies") > 0)
    out = out.withColumn(f"{prefix}turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"{prefix}copies"))))
    return out.select(*docs.columns)
