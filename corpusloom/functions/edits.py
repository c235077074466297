"""Edits of notes as Columns: guarded writes, new claims, tags, attachments, answers of helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D

LEAST_CLAIM = 12


def _ended(text: Column) -> Column:
    return F.regexp_replace(text, "\\s+$", "")


def safe_path(path: Column) -> Column:
    """The path with / between its parts and none around it; null where a part is "..", which leads out of the root."""
    clean = F.regexp_replace(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), "^/+|/+$", "")
    return F.when(~F.array_contains(F.split(clean, "/"), ".."), clean)


def commit_id(content: Column) -> Column:
    """Seven hex digits that name a version of a file."""
    return F.substring(F.sha1(F.encode(content, "UTF-8")), 1, 7)


def receipt(path: Column, content: Column) -> Column:
    """struct(path, commit, error) of a write of a whole file; a path that leads out of the root is an error."""
    safe = safe_path(path)
    return F.struct(safe.alias("path"), F.when(safe.isNotNull(), commit_id(content)).alias("commit"), F.when(safe.isNull(), "bad path").alias("error"))


def guarded(operation: Column, now: Column, content: Column) -> Column:
    """struct(content, error) of a whole-file write: append makes or adds after a blank line, create needs that
    there is no file (now is null), write that there is one; anything else is an error."""
    added = F.concat(F.when(F.coalesce(F.length(now), F.lit(0)) > 0, F.concat(_ended(now), F.lit("\n\n"))).otherwise(""), _ended(content), F.lit("\n"))
    error = F.when((operation == "create") & now.isNotNull(), "exists").when((operation == "write") & now.isNull(), "missing").when(~F.coalesce(operation, F.lit("")).isin("append", "create", "write"), "unknown operation")
    return F.struct(F.when(error.isNotNull(), now).when(operation == "append", added).otherwise(content).alias("content"), error.alias("error"))


def claim(text: Column, about: Column, at: Column, kind: Column | None = None, confidence: Column | None = None) -> Column:
    """struct(path, content, error) of a new claim; it needs twelve characters and an entity."""
    kind = F.lit("факт") if kind is None else kind
    confidence = F.lit("высокая") if confidence is None else confidence
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", " "))
    about = F.coalesce(about, F.lit(""))
    error = F.when(F.length(body) < LEAST_CLAIM, "too short").when(about == "", "no entity")
    path = F.concat(F.lit("осколки/"), at, F.lit(" "), A.slug(A.safe_file_name(body)), F.lit(".md"))
    # the fields of a claim, in the order of the format
    content = F.format_string(
        '---\nкласс: утверждение\nтип: %s\nкогда: %s\nстатус: актуально\nо: ["[[%s]]"]\nисточник: "приложение %s"\nуверенность: %s\n---\n\n%s\n', kind, at, about, at, confidence, body
    )
    ok = error.isNull()
    return F.struct(F.when(ok, path).alias("path"), F.when(ok, content).alias("content"), error.alias("error"))


def renamed_tag(tags: Column, old: str, new: str = "") -> Column:
    """The tags without `old` and, unless it is empty, with `new` once, at the end if it is not there yet."""
    left = F.filter(tags, lambda t: t != old)
    return F.when(F.array_contains(left, new), left).otherwise(F.array_append(left, F.lit(new))) if new else left


def same_body(a: Column, b: Column) -> Column:
    """Whether texts are equal but for white space."""
    bare = lambda c: F.regexp_replace(c, "\\s+", "")
    return bare(a) == bare(b)


def template(text: Column, title: Column, date: Column) -> Column:
    return F.replace(F.replace(text, F.lit("{{date}}"), date), F.lit("{{title}}"), title)


def upload(base64: Column) -> Column:
    """The bytes of an attachment, sent as base64 with or without a data: head; null if there are none."""
    bare = F.regexp_replace(F.regexp_replace(base64, "^data:[^;]*;base64,", ""), "\\s", "")
    return F.unbase64(F.nullif(bare, F.lit("")))


def link_hours(asked: Column) -> Column:
    """How long a link lives: 1 to 168 hours, 24 if nothing (or none) is asked for."""
    return F.greatest(F.least(F.coalesce(F.nullif(asked, F.lit(0)), F.lit(24)), F.lit(168)), F.lit(1))


def answer_field(answer: Column, name: str) -> Column:
    """What follows 'NAME:' on its line; '' if there is no such line."""
    return F.trim(F.regexp_extract(answer, f"(?iu){name}:\\s*(.+)", 1))


def answer_list(answer: Column, name: str) -> Column:
    """The parts of such a line, parted by commas, without '#'; 'нет' is none."""
    parts = F.transform(F.split(answer_field(answer, name), ","), lambda p: F.regexp_replace(F.trim(p), "^#", ""))
    return F.filter(parts, lambda p: (p != "") & (F.lower(p) != "нет"))


def helper_pack(system: str, note: Column, tags: Column, near: Column) -> Column:
    """What a helper is asked: the instruction, the note, the tags in use (tag, n) and titles of notes near by."""
    used = F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t["tag"], F.lit(" ("), t["n"].cast("string"), F.lit(")"))), ", ")
    titles = F.array_join(F.transform(near, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.concat_ws("\n\n", F.lit(system), note, used, titles)


def in_bulk(notes: DataFrame, text: str, edit: Callable[[str], str], missing: Column | None = None) -> DataFrame:
    """An edit of the text of every note; adds error: 'missing' without a text, what the edit raised, else null.
    A failed row keeps its text and stops no other."""
    def one(t: str) -> list:
        try:
            return [edit(t), None]
        except ValueError as x:
            return [t, str(x)]

    gone = F.col(text).isNull() | (F.lit(False) if missing is None else missing)
    done = F.when(gone, F.array(F.col(text), F.lit("missing"))).otherwise(D.mapped(one, "array<string>")(F.col(text)))
    return notes.withColumn("done_", done).withColumns({text: F.get("done_", F.lit(0)), "error": F.get("done_", F.lit(1))}).drop("done_")
