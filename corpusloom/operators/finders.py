"""Lists that a screen asks for: palette, pickers, cards, folders, suggestions, answers as text, substrings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PALETTE, PICKED, LINKED, NEAR, FRAGMENT, SCREEN = 12, 6, 12, 60, 160, 200


def _holds(q: str, *columns: str) -> Column:
    """Whether the lower-cased columns, parted by spaces, hold the text."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(q.strip().lower()))


def palette(notes: DataFrame, query: str, newest: Column, limit: int = PALETTE) -> DataFrame:
    """The first notes (by pos) whose title or path holds the query; without one, the newest."""
    q = query.strip()
    if not q:
        return notes.orderBy(F.desc(newest), "pos").limit(limit)
    return notes.where(_holds(q, "title") | _holds(q, "path")).orderBy("pos").limit(limit)


def pick(entities: DataFrame, query: str, limit: int = PICKED) -> DataFrame:
    """The first entities with the query in title, base or aliases; a query of one letter finds none."""
    if len(query.strip()) < 2:
        return entities.limit(0)
    return entities.where(_holds(query, "title", "base", "aliases")).orderBy("pos").limit(limit)


def newest(notes: DataFrame, at: Column, limit: int = SCREEN) -> DataFrame:
    """What a search without words shows: the newest of the notes that the filters leave."""
    return notes.orderBy(F.desc_nulls_last(at), "pos").limit(limit)


def pack(found: DataFrame) -> DataFrame:
    """One row: context, the rows of a bounded top list (path, chain, rank, frag) under their heads, and roughly how many tokens."""
    head = F.when(F.coalesce(F.col("chain"), F.lit("")) != "", F.concat_ws(" › ", "path", "chain")).otherwise(F.col("path"))
    block = F.concat(F.lit("--- "), head, F.lit(" ---\n"), F.col("frag"))
    rows = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "path", block.alias("t")))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: e["t"]), "\n\n")
    return rows.select(text.alias("context"), F.round(F.length(text) / 3).cast("long").alias("tokens"))


def prompt(question: Column, context: Column, system: str) -> Column:
    """What goes into a chat; the heads of its parts are fixed."""
    return F.concat(F.lit(system + "\n\n=== ФРАГМЕНТЫ ИЗ ПАМЯТИ ===\n\n"), context, F.lit("\n\n=== ВОПРОС ===\n\n"), question)


def under_tag(tags: Column | str, tag: str) -> Column:
    """Whether one of the tags is this one or below it."""
    return F.exists(tags, lambda t: (t == tag) | t.startswith(tag + "/"))


def cards(notes: DataFrame, tag: str = "", query: str = "") -> DataFrame:
    """Notes under a tag that hold the query in title, path or a tag."""
    out = notes.where(under_tag("tags", tag)) if tag else notes
    q = query.strip().lower()
    return out.where(_holds(q, "title") | _holds(q, "path") | F.exists("tags", lambda t: F.contains(t, F.lit(q)))) if q else out


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One screen of an ordered list: only offset + limit rows are ordered."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def between(rows: DataFrame, order: list[Column | str], first: Column, last: Column) -> DataFrame:
    """The rows from one anchor to the other in this order, whichever comes first; none if one is missing.

    The anchors' sort keys bound the rows, so the table is filtered rather than numbered.
    """
    key = F.struct(*order)
    ends = rows.where(first | last).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.max(first.cast("int")).alias("a"), F.max(last.cast("int")).alias("b"))
    return rows.crossJoin(F.broadcast(ends)).where((F.col("a") == 1) & (F.col("b") == 1) & (key >= F.col("lo")) & (key <= F.col("hi"))).drop("lo", "hi", "a", "b")  # one row


def folders(notes: DataFrame, more: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The distinct folders of the notes and of the templates."""
    own = notes.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder")).where("folder <> ''").distinct()
    if not more:
        return own
    return own.unionByName(notes.sparkSession.createDataFrame([(f,) for f in more], "folder string")).distinct()


def well_linked(degrees: DataFrame, least: int = 2, limit: int = 10) -> DataFrame:
    """The first notes (by pos) with more links than `least`."""
    return degrees.where(F.col("deg") > least).orderBy("pos").limit(limit)


def answer(found: DataFrame, head: Column, note: str) -> DataFrame:
    """One row with the text of a search answer; found: (path, more, rank, frag), a bounded top list."""
    more = F.when(F.col("more") > 0, F.format_string("  (ещё %d %s в этом файле)", "more", F.when(F.col("more") == 1, "фрагмент").otherwise("фрагмента"))).otherwise("")
    block = F.concat(F.lit("**"), "path", F.lit("**"), head, more, F.lit("\n"), F.col("frag"))
    rows = found.agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "path", block.alias("t")))).alias("x"))
    return rows.select(F.concat(F.array_join(F.transform("x", lambda e: e["t"]), "\n\n"), F.lit("\n\n" + note)).alias("answer"))


def answer_limit(asked: int | None) -> int:
    """Six files if nothing is asked for, one to twenty else."""
    return min(max(asked or 6, 1), 20)


def fragments(texts: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Texts that hold the query, with a fragment that begins 60 characters before it, line ends as spaces."""
    flat = F.trim(F.regexp_replace(text, "\n+", " "))
    at = F.locate(query.lower(), F.lower(flat))
    start = F.greatest(at - 1 - NEAR, F.lit(0))
    frag = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(flat, start + 1, F.lit(FRAGMENT)), F.lit("…"))
    return texts.where(F.contains(F.lower(F.col(text)), F.lit(query.lower())) & (at > 0)).withColumn("frag", frag)


def dimmed(nodes: DataFrame, query: str = "", tag: str = "", kept: DataFrame | None = None) -> DataFrame:
    """Adds dim: not visible, or not in the set kept, or without the text or the tag. nodes: (path, title, tags, visible)."""
    q = query.strip().lower()
    on = F.coalesce("visible", F.lit(False))
    if q:
        on &= _holds(q, "title") | _holds(q, "path") | F.exists("tags", lambda t: F.contains(t, F.lit(q)))
    if tag:
        on &= under_tag("tags", tag)
    if kept is None:
        return nodes.withColumn("dim", ~on)
    k = kept.select("path", F.lit(True).alias("_kept")).distinct()
    return nodes.join(k, "path", "left").withColumn("dim", ~(on & F.coalesce("_kept", F.lit(False)))).drop("_kept")


def toward(points: DataFrame, x: float, y: float, dx: int, dy: int) -> DataFrame:
    """The point that is best reached in a direction: near, and little off the line. points: (id, x, y)."""
    a, b = F.col("x") - x, F.col("y") - y
    along, far = a * dx + b * dy, a * a + b * b
    p = points.withColumn("score", F.round(far / (along * along / (far + 1e-6)), 6)).where(along > 0)
    return p.orderBy("score", "id").limit(1).select("id", "score")


def in_groups(nodes: DataFrame, group: str, top: int, step: int) -> DataFrame:
    """Adds y: rows of one group stand below each other, `step` apart, from `top`; bounded groups (a screen)."""
    row = F.row_number().over(Window.partitionBy(group).orderBy("path")) - 1
    return nodes.withColumn("y", F.lit(top) + row * step)
