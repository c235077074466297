"""The corpus model: zones, layers, tags, degrees, links and their resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A

# When a folder is split, colours, what is hidden at first, which zones are chronicles.
SPLIT_MIN, SUBZONE_MIN = 26, 8
PALETTE = ("#57d9c9", "#a48cf0", "#e07a8a", "#7fc98f", "#5ba0e0", "#e8b84b", "#d8c060", "#8a97b8")
CHRONICLE_COLOUR = "#6f7d84"
CHRONICLES = ("^brain/log$", "^_tools/queue$", "^Учёба/Лог сессий$", "^archive$")
HIDDEN_LAYERS = ("выводимое", "улика", "card")
HIDDEN_ZONES = ("templates", "Учёба/Карточки")
ROOT = "корень"


def _level(n: int) -> Column:
    return F.when(F.size(F.split("path", "/")) > n, F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))


def split_zones(notes: DataFrame) -> DataFrame:
    """(l2): second-level folders that are zones of their own: of a folder of more than 26 notes, with 8 or more."""
    levels = notes.select(F.coalesce(_level(1), F.lit(ROOT)).alias("l1"), _level(2).alias("l2")).groupBy("l1", "l2").agg(F.count("*").alias("n"))
    big = levels.groupBy("l1").agg(F.sum("n").alias("total")).where(F.col("total") > SPLIT_MIN)
    return levels.where(F.col("l2").isNotNull() & (F.col("n") >= SUBZONE_MIN)).join(big, "l1", "left_semi").select("l2")


def with_zone(notes: DataFrame) -> DataFrame:
    """Adds zone. The table of split folders is an aggregate by folder."""
    split = split_zones(notes).withColumn("is_split", F.lit(True))
    d = notes.withColumns({"l1": F.coalesce(_level(1), F.lit(ROOT)), "l2": _level(2)})
    return d.join(split, "l2", "left").withColumn("zone", F.when(F.col("is_split"), F.col("l2")).otherwise(F.col("l1"))).drop("l1", "l2", "is_split")


def is_chronicle(zone: Column) -> Column:
    return F.coalesce(zone.rlike("(?iu)" + "|".join(CHRONICLES)), F.lit(False))


def _shade(hex_colour: Column, k: Column) -> Column:
    """Lighter for k > 0, darker for k < 0."""
    def part(i: int) -> Column:
        c = F.conv(F.substring(hex_colour, 2 + 2 * i, 2), 16, 10).cast("double")
        target = F.when(k > 0, F.lit(255.0)).otherwise(F.lit(0.0))
        return F.lpad(F.lower(F.hex(F.floor(c + (target - c) * F.abs(k) + 0.5).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), part(0), part(1), part(2))


def zones(zoned: DataFrame) -> DataFrame:
    """zone, root, colour, chronicle, n, shown. One row for each zone is ordered in one place."""
    z = zoned.groupBy("zone").agg(F.count("*").alias("n")).withColumn("root", F.element_at(F.split("zone", "/"), 1))
    z = z.withColumn("turn", F.dense_rank().over(Window.orderBy("root")) - 1)
    nested = F.col("zone").contains("/")
    nth = F.row_number().over(Window.partitionBy("root", nested).orderBy("zone"))
    colour = F.element_at(F.array(*map(F.lit, PALETTE)), (F.pmod("turn", F.lit(len(PALETTE))) + 1).cast("int"))
    shaded = F.when(nested, _shade(colour, F.when(nth % 2 == 1, F.lit(0.22)).otherwise(F.lit(-0.24)))).otherwise(colour)
    chronicle = is_chronicle(F.col("zone"))
    return z.select("zone", "root", F.when(chronicle, F.lit(CHRONICLE_COLOUR)).otherwise(shaded).alias("colour"), chronicle.alias("chronicle"), "n", (~F.col("zone").isin(*HIDDEN_ZONES)).alias("shown"))


def layers(notes: DataFrame, hidden: tuple[str, ...] = HIDDEN_LAYERS) -> DataFrame:
    name = F.coalesce(F.nullif("klass", F.lit("")), F.nullif("type", F.lit("")), F.lit("—"))
    return notes.groupBy(name.alias("layer")).agg(F.count("*").alias("n")).withColumn("shown", ~F.col("layer").isin(*hidden))


def visible(zoned: DataFrame, zone_table: DataFrame, layer_table: DataFrame) -> DataFrame:
    """Notes whose zone and layer are shown; both tables are aggregates with few rows."""
    name = F.coalesce(F.nullif("klass", F.lit("")), F.nullif("type", F.lit("")), F.lit("—"))
    z, l = zone_table.where("shown").select("zone"), layer_table.where("shown").select("layer")
    return zoned.join(z, "zone", "left_semi").withColumn("layer", name).join(l, "layer", "left_semi").drop("layer")


def tag_counts(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def top_tags(counts: DataFrame, limit: int = 40, short: int = 12) -> DataFrame:
    """tag, n, short: the most used tags (of tag, n), and whether a tag is among the first `short`."""
    top = counts.orderBy(F.desc("n"), "tag").limit(limit)
    # `limit` rows
    return top.select("tag", "n", (F.row_number().over(Window.orderBy(F.desc("n"), "tag")) <= short).alias("short"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """path, deg: every link counts at both its ends, repeated ones too; links to oneself do not."""
    ends = links.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("path")).groupBy("path").agg(F.count("*").alias("deg"))
    return nodes.select("path").join(ends, "path", "left").select("path", F.coalesce("deg", F.lit(0)).alias("deg"))


def links_by_type(links: DataFrame, end: str = "src") -> DataFrame:
    return links.where("src <> dst").groupBy(F.col(end).alias("path"), "type").agg(F.count("*").alias("n"))


def resolve(targets: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds `found` (a path or null) to (…, target): by lower-cased base, by path, by path with .md.

    Of notes with the same base the first (by pos) counts.
    """
    first = Window.partitionBy("key").orderBy("pos")
    base = notes.select(F.lower("base").alias("key"), F.col("path").alias("by_base"), "pos").withColumn("r", F.row_number().over(first)).where("r = 1").select("key", "by_base")
    paths = notes.select(F.col("path").alias("known")).distinct()
    t = targets.join(base, F.lower("target") == base["key"], "left").drop("key")
    t = t.join(paths.withColumnRenamed("known", "by_path"), F.col("target") == F.col("by_path"), "left")
    t = t.join(paths.withColumnRenamed("known", "by_md"), F.concat(F.col("target"), F.lit(".md")) == F.col("by_md"), "left")
    return t.withColumn("found", F.coalesce("by_base", "by_path", "by_md")).drop("by_base", "by_path", "by_md")
