"""Entities and the claims that hang on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A

NAME_WEIGHT, WORD_WEIGHT = 3, 1
_SPLIT = "[^0-9A-Za-zА-Яа-яЁё+-]+"


def name_index(entities: DataFrame) -> DataFrame:
    """(name, path, weight): titles, bases and aliases weigh 3, words of six letters of a title 1; of equal
    names the heavier counts, then the first entity by pos."""
    full = F.array_union(F.array("title", "base"), F.col("aliases"))
    words = F.filter(F.split("title", _SPLIT), lambda w: (F.length(w) >= 6) & (A.norm(w) != A.norm(F.col("title"))))
    take = lambda names, weight: entities.select("path", "pos", F.explode(names).alias("n"), F.lit(weight).alias("weight"))
    names = take(full, NAME_WEIGHT).unionByName(take(words, WORD_WEIGHT)).select(A.norm(F.col("n")).alias("name"), "path", "pos", "weight").where(F.length("name") >= 3)
    first = Window.partitionBy("name").orderBy(F.desc("weight"), "pos")
    return names.withColumn("r", F.row_number().over(first)).where("r = 1").select("name", "path", "pos", "weight")


def find(index: DataFrame, query: str, limit: int = 3) -> DataFrame:
    """(path, score): entities whose name is in the query, or all of whose name's words have their stem there.

    The query is a constant, so this is a map over the names.
    """
    q = query.lower().replace("ё", "е").strip()
    stems = sorted({A.py_stem(w) for w in _words(q)})
    whole = F.lit(q).contains(F.col("name"))
    parts = F.filter(F.split("name", "[^0-9a-zа-я]+"), lambda w: F.length(w) > 2)
    every = (F.size(parts) > 0) & F.forall(parts, lambda w: A.stem(w).isin(stems) if stems else F.lit(False))
    score = F.when(whole, F.length("name") * 2 + F.col("weight")).when(every, F.length("name") + F.col("weight"))
    hits = index.withColumn("score", score.cast("long")).where("score is not null")
    best = hits.groupBy("path").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return best.orderBy(F.desc("score"), "pos").limit(limit).select("path", "score")


def _words(q: str) -> list[str]:
    import re

    return [w for w in re.split("[^0-9a-zа-я]+", q) if len(w) > 2]


def dead(status: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(status.isin(*values), F.lit(False))


def claims_of(links: DataFrame, claims: DataFrame, dead_statuses=("отменено", "устарело"), of: DataFrame | None = None) -> DataFrame:
    """(entity, claim, at, status, place): claims about each entity, dead ones last, newest first."""
    l = links.where("type = 'about'").select(F.col("dst").alias("entity"), F.col("src").alias("claim"))
    if of is not None:
        l = l.join(of.select(F.col("path").alias("entity")), "entity", "left_semi")
    j = l.join(claims.select(F.col("path").alias("claim"), "at", "status", "pos"), "claim")
    order = Window.partitionBy("entity").orderBy(dead(F.col("status"), dead_statuses), F.desc("at"), "pos")
    return j.select("entity", "claim", "at", "status", F.row_number().over(order).cast("long").alias("place"))


def near(links: DataFrame, of: DataFrame, kind: str = "about", limit: int = 6) -> DataFrame:
    """(entity, other, n): entities that share claims with an entity, by number."""
    l = links.where(F.col("type") == kind).select("src", "dst")
    mine = l.join(of.select(F.col("path").alias("dst")), "dst", "left_semi").select(F.col("dst").alias("entity"), "src")
    n = mine.join(l.withColumnRenamed("dst", "other"), "src").where("other <> entity").groupBy("entity", "other").agg(F.count("*").alias("n"))
    best = Window.partitionBy("entity").orderBy(F.desc("n"), "other")
    return n.withColumn("r", F.row_number().over(best)).where(F.col("r") <= limit).drop("r")


def stats(entities: DataFrame, links: DataFrame) -> DataFrame:
    """kind, total, with_claims, claims."""
    n = links.where("type = 'about'").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))
    e = entities.join(n, "path", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return e.groupBy(F.coalesce(F.nullif("kind", F.lit("")), F.lit("прочее")).alias("kind")).agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("with_claims"), F.sum("n").alias("claims"))


def answers(found: DataFrame, placed: DataFrame, links: DataFrame, shown: int = 12, near_by: int = 6) -> DataFrame:
    """entity, total, claims (the first `shown` by place), near (the entities that share the most claims, with their number).

    found: (path), a bounded list; placed: (entity, claim, place) of these; links: the `about` links.
    """
    said = placed.groupBy("entity").agg(F.count("*").alias("total"), F.array_sort(F.collect_list(F.when(F.col("place") <= shown, F.struct("place", "claim")))).alias("c"))
    around = near(links, found, limit=near_by).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "other", "n"))).alias("o"))
    none = F.array().cast("array<struct<other:string,n:bigint>>")
    out = said.join(around, "entity", "left")
    return out.select("entity", "total", F.transform("c", lambda x: x["claim"]).alias("claims"), F.coalesce(F.transform("o", lambda x: F.struct(x["other"].alias("other"), x["n"].alias("n"))), none).alias("near"))


def passport(claims: DataFrame, dead_statuses=("отменено", "устарело")) -> DataFrame:
    """path, kind, at, status, confidence as they are shown ('—' for what is missing), and whether the claim is dead."""
    said = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("—"))
    return claims.select("path", F.upper(said("kind")).alias("kind"), said("at").alias("at"), F.upper(said("status")).alias("status"), F.upper(said("confidence")).alias("confidence"), dead(F.col("status"), tuple(dead_statuses)).alias("dead"))


def panel(links: DataFrame, claims: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """entity, kind, priority, claim, at, place: claims about each entity by kind in this order (others 99), newest first."""
    l = links.where("type = 'about'").select(F.col("dst").alias("entity"), F.col("src").alias("path"))
    kind = F.coalesce(F.nullif(F.col("kind"), F.lit("")), F.lit("прочее"))
    j = l.join(claims.select("path", kind.alias("kind"), "at"), "path")
    at = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    place = Window.partitionBy("entity", "kind").orderBy(F.desc_nulls_last("at"), "path")
    return j.select("entity", "kind", F.coalesce(F.nullif(at - 1, F.lit(-1)), F.lit(99)).cast("long").alias("priority"), F.col("path").alias("claim"), "at", F.row_number().over(place).cast("long").alias("place"))
