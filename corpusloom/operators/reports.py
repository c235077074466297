"""Reports over the corpus: health, timeline, people, archive, triage, digest, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The limits of the health report and of the archive, steps of the timeline.
STALE_DAYS, HUGE_BYTES, SHOWN, READY_CLAIMS = 180, 20_000, 40, 5
DAY_SPAN, MONTH_SPAN = 120, 1095


def health(notes: DataFrame, now: Column, shown: int = SHOWN) -> DataFrame:
    """problem, path, n: the first of the notes with each problem by pos, and how many have it.

    notes: path, pos, n_broken, n_backlinks, n_links, n_tags, bytes, at, chronicle. One pass gives all flags.
    """
    calm = ~F.col("chronicle")
    flags = {
        "broken": F.col("n_broken") > 0,
        "orphan": (F.col("n_backlinks") == 0) & calm,
        "unsorted": (F.col("n_tags") == 0) & (F.col("n_links") == 0),
        "stale": (F.col("at") < now - F.expr(f"interval {STALE_DAYS} days")) & calm,
        "huge": F.col("bytes") > HUGE_BYTES,
    }
    named = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in flags.items())), lambda x: x.isNotNull())
    rows = notes.select("path", "pos", F.explode(named).alias("problem"))
    # a first cut in each partition of the rows, then one over what is left
    spread = F.pmod(F.xxhash64("path"), F.lit(64))
    first = Window.partitionBy("problem", spread).orderBy("pos", "path")
    n = rows.groupBy("problem").agg(F.count("*").alias("n"))
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= shown)
    best = Window.partitionBy("problem").orderBy("pos", "path")
    return few.withColumn("r", F.row_number().over(best)).where(F.col("r") <= shown).join(F.broadcast(n), "problem").select("problem", "path", "n")  # five rows


def step(days: Column) -> Column:
    return F.when(days <= DAY_SPAN, F.lit("day")).when(days <= MONTH_SPAN, F.lit("month")).otherwise(F.lit("year"))


def timeline(events: DataFrame) -> DataFrame:
    """bucket, n, share of the peak, step: by day, month or year, as the span of `at` asks for."""
    span = events.agg(F.datediff(F.max("at"), F.min("at")).alias("days")).select(step(F.col("days")).alias("step"))
    day = events.groupBy(F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    form = F.when(F.col("step") == "day", F.date_format("day", "yyyy-MM-dd")).when(F.col("step") == "month", F.date_format("day", "yyyy-MM")).otherwise(F.date_format("day", "yyyy"))
    b = day.where("day is not null").crossJoin(F.broadcast(span)).groupBy(form.alias("bucket"), "step").agg(F.sum("n").alias("n"))  # one row
    # as many rows as days at most
    return b.withColumn("share", F.round(F.col("n") / F.max("n").over(Window.partitionBy()), 6))


def people(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """path, mentions, last: how often and when last a person is mentioned, else the person's own date."""
    m = mentions.groupBy("path").agg(F.count("*").alias("mentions"), F.max("at").alias("last"))
    return entities.join(m, "path", "left").select("path", F.coalesce("mentions", F.lit(0)).alias("mentions"), F.coalesce("last", "own").alias("last"))


def archive_ready(sources: DataFrame, least: int = READY_CLAIMS) -> DataFrame:
    """path, n, state: of evidence with claims that name it as their source, ready from five claims on."""
    n = sources.groupBy("path").agg(F.count("*").alias("n"))
    return n.withColumn("state", F.when(F.col("n") >= least, F.lit("ready")).otherwise(F.lit("early")))


def archive_list(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Evidence newest first, with parsed (whether any claim names it as its source) and n_parsed, of how many that holds.

    evidence: path, at and more.
    """
    named = sources.select("path").distinct().withColumn("parsed", F.lit(True))
    out = evidence.join(named, "path", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False)))
    return out.crossJoin(F.broadcast(out.agg(F.count_if("parsed").alias("n_parsed")))).orderBy(F.desc_nulls_last("at"), "path")  # one row


def triage(notes: DataFrame, skipped: DataFrame, limit: int) -> DataFrame:
    """Shown notes, no chronicles, without tags or links and not skipped, newest first."""
    open_ = notes.where(F.col("shown") & ~F.col("chronicle") & ((F.col("n_tags") == 0) | (F.col("n_links") == 0)))
    return open_.join(skipped, "path", "left_anti").orderBy(F.desc("at"), "path").limit(limit)


def digest(notes: DataFrame, now: Column, days: int, limit: int = SHOWN) -> DataFrame:
    """The newest of the notes changed within some days."""
    return notes.where(F.col("at") >= now - F.expr(f"interval {days} days")).orderBy(F.desc("at"), "path").limit(limit)


def unsorted(notes: DataFrame, limit: int = 20) -> DataFrame:
    """The first shown notes, no chronicles, without tags or without any links."""
    return notes.where(F.col("shown") & ~F.col("chronicle") & ((F.col("n_tags") == 0) | (F.col("n_links") + F.col("n_backlinks") == 0))).orderBy("pos", "path").limit(limit)


def classify(paths: DataFrame, rules: list[tuple], own: Column | None = None) -> DataFrame:
    """Adds klass and kind by the first rule (pattern, class, kind) that fits; null if none does.

    A rule with a fourth value, true, takes the note's own kind (from its front matter) before that of the rule.
    """
    klass = kind = F
    own = F.lit(None).cast("string") if own is None else F.nullif(own, F.lit(""))
    for pattern, k, v, *mine in rules:
        hit = F.col("path").rlike(pattern)
        klass, kind = klass.when(hit, F.lit(k)), kind.when(hit, F.coalesce(own, F.lit(v)) if mine and mine[0] else F.lit(v))
    return paths.withColumns({"klass": klass, "kind": kind})


def classification(notes: DataFrame, rules: list[tuple]) -> DataFrame:
    """state, klass, kind, n: what a classification by rules would do.

    notes: path, front (whether there is a front matter), own_klass, own_kind. state: change, already (class and
    kind are those of the rule), no front matter, or untouched (no rule fits).
    """
    c = classify(notes, rules, F.col("own_kind"))
    same = F.col("own_klass").eqNullSafe(F.col("klass")) & F.col("own_kind").eqNullSafe(F.col("kind"))
    state = F.when(F.col("klass").isNull(), "untouched").when(~F.col("front"), "no front matter").when(same, "already").otherwise("change")
    change = state == "change"
    return c.select(state.alias("state"), F.when(change, F.col("klass")).alias("klass"), F.when(change, F.col("kind")).alias("kind")).groupBy("state", "klass", "kind").agg(F.count("*").alias("n"))
