"""The property-filter language: `tag:work -is:orphan after:2026-06 links:>3 "exact phrase" words`.

A query is parsed on the driver into a small value and compiled to one Column,
so the optimizer sees plain predicates and can push them to the scan. Filters
are joined by AND; a minus negates one. Unknown keys stay words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys of filters.
FIELDS = ("tag", "класс", "вид", "о", "type", "zone", "status", "path", "links", "size", "after", "before", "is")
#: A note without a date counts as of this time.
NO_DATE = "2000-01-01"


@dataclass(frozen=True)
class Filter:
    key: str
    value: str
    negated: bool = False


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter, ...]
    phrases: tuple[str, ...]
    text: str
    raw: str

    def describe(self) -> str:
        parts = [f"{'−' if f.negated else ''}{f.key}:{f.value}" for f in self.filters] + [f"«{p}»" for p in self.phrases]
        return " · ".join(parts + ([f"слова: {self.text}"] if self.text else []))


def parse(raw: str) -> Query:
    filters, phrases, words = [], [], []
    for m in re.finditer(r'"([^"]+)"|(-?)([a-zA-Zа-яА-ЯёЁ_]+):(\S+)|(\S+)', raw or ""):
        phrase, minus, key, value, word = m.groups()
        if phrase:
            phrases.append(phrase.lower())
        elif key and key.lower() in FIELDS:
            filters.append(Filter(key.lower(), value, minus == "-"))
        else:
            words.append(word or f"{key}:{value}")
    return Query(tuple(filters), tuple(phrases), " ".join(words), raw)


def compare(value: Column, raw: str) -> Column:
    """value against '>3', '<=2.5', '7' and so on; false for what is no number."""
    op, number = re.match(r"(>=|<=|>|<)?(.*)$", raw).groups()
    found = re.match(r"\s*[-+]?\d+(\.\d+)?", number)
    if not found:
        return F.lit(False)
    n = float(found[0])
    return {">": value > n, "<": value < n, ">=": value >= n, "<=": value <= n}.get(op, value == n)


def date_of(raw: str) -> datetime | None:
    """A year, a month or a day, at its beginning."""
    for form in ("%Y", "%Y-%m", "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S"):
        try:
            return datetime.strptime(raw, form)
        except ValueError:
            continue
    return None


def _tag(v: str) -> Column:
    return F.exists("tags", lambda t: (t == v) | t.startswith(f"{v}/"))


def predicate(f: Filter) -> Column:
    """A filter over the columns of notes: tags, klass, kind, type, zone, status, path, deg, bytes, at,
    n_backlinks, n_broken, chronicle; those that the query's keys need must be there."""
    v = f.value.lower()
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    at = lambda: F.coalesce(F.col("at").cast("timestamp_ntz"), F.lit(NO_DATE).cast("timestamp_ntz"))
    day = date_of(f.value) if f.key in ("after", "before") else None
    limit = F.lit(day.isoformat()).cast("timestamp_ntz") if day else None
    match f.key:
        case "tag":
            out = _tag(v)
        case "класс":
            out = low("klass") == v
        case "вид":
            out = low("kind") == v
        case "type" | "status":
            out = low(f.key) == v
        case "zone" | "path":
            out = low(f.key).contains(v)
        case "links":
            out = compare(F.col("deg"), f.value)
        case "size":
            out = compare(F.col("bytes") / 1024, f.value)
        case "after":
            out = at() >= limit if day else F.lit(False)
        case "before":
            out = at() <= limit if day else F.lit(False)
        case "is" if v == "orphan":
            out = F.col("n_backlinks") == 0
        case "is" if v == "broken":
            out = F.col("n_broken") > 0
        case "is" if v == "tagged":
            out = F.size("tags") > 0
        case "is" if v == "untagged":
            out = F.size("tags") == 0
        case "is" if v == "chronicle":
            out = F.col("chronicle")
        case "is":
            out = low("status") == v
        case _:
            raise ValueError(f.key)
    return ~out if f.negated else out


def about(links: DataFrame, titles: DataFrame, value: str) -> DataFrame:
    """(path) of both ends of `about` links one of whose ends has the value in its title: for each, the other end."""
    v = value.lower()
    named = titles.where(F.lower("title").contains(v)).select(F.col("path").alias("named"))
    l = links.where("type = 'about'").select("src", "dst")
    a = l.join(named, l["dst"] == named["named"], "left_semi").select(F.col("src").alias("path"))
    b = l.join(named, l["src"] == named["named"], "left_semi").select(F.col("dst").alias("path"))
    return a.unionByName(b).distinct()


def apply(notes: DataFrame, q: Query | str, links: DataFrame | None = None, text: str | None = None) -> DataFrame:
    """The notes that fit. Phrases are looked for in the column `text` (None: they are ignored), last."""
    q = parse(q) if isinstance(q, str) else q
    plain = [predicate(f) for f in q.filters if f.key != "о"]
    out = notes.where(reduce(lambda a, b: a & b, plain)) if plain else notes
    for f in q.filters:
        if f.key == "о":
            out = out.join(about(links, notes, f.value), "path", "left_anti" if f.negated else "left_semi")
    if text:
        for p in q.phrases:
            out = out.where(F.lower(F.col(text)).contains(p))
    return out
