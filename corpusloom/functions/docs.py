"""Documents: sections, links, front matter, patches, line differences, excerpts, Markdown.

What is a matter of patterns is a Column. What walks through lines is a plain
function over one text; `mapped` lifts such functions to Arrow batches.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A

# The kinds of typed links and the names of their fields.
LINK_TYPES = {"relates": "relates", "depends_on": "depends", "blocks": "blocks", "part_of": "part_of", "supersedes": "supersedes", "source": "source", "contradicts": "contradicts", "about": "about"}
EXCERPT, KEEP = 320, 2


def mapped(fn: Callable, returns: str):
    """A pandas UDF of a function over the values of its columns; a null text counts as ''."""

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([fn(*("" if v is None else v for v in row)) for row in zip(*columns)], dtype=object)

    def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            yield pd.Series([fn("" if v is None else v) for v in column], dtype=object)

    def apply(*columns: Column) -> Column:
        if len(columns) == 1:
            one.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
            return F.pandas_udf(one, returns)(*columns)
        run.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, returns)(*columns)

    return apply


# ---------------------------------------------------------------- patterns


def wikilinks(text: Column) -> Column:
    """array of (target, heading, alias) of [[target#heading|alias]]; absent parts are ''."""
    p = r"\[\[([^\]|#]+)(?:#([^\]|]*))?(?:\|([^\]]*))?\]\]"
    part = lambda i: F.regexp_extract_all(text, F.lit(p), i)
    return F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c")), lambda x: F.struct(F.trim(x["a"]).alias("target"), x["b"].alias("heading"), x["c"].alias("alias")))


def front_matter_field(text: Column, key: str) -> Column:
    """A scalar field of the front matter; null without it."""
    head = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---", 1)
    found = F.regexp_extract(head, rf"(?m)^{re.escape(key)}:[ \t]*(.*?)\s*$", 1)
    return F.nullif(F.regexp_replace(found, "^[\"']|[\"']$", ""), F.lit(""))


def front(text: Column) -> Column:
    """The front matter with its marks, '' without one; `parse_front` and `add_tag` need no more of a text. A null text counts as ''."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\A---\r?\n[\s\S]*?\r?\n---\r?\n?", 0)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, r"\A---\n[\s\S]*?\n---\n?", "")


# ---------------------------------------------------------------- front matter

# The shapes of a front matter, of its fields and items, and of values that need no quotes.
_FRONT = re.compile(r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n?")
_ENTRY = re.compile(r"(?P<key>[A-Za-zА-Яа-я_][\wЀ-ӿ-]*):\s*(?P<inline>.*)|\s*-\s+(?P<item>.*)")
_PLAIN = re.compile(r"[\wЀ-ӿ][\wЀ-ӿ \-./+()]*")
TAG_FIELDS = ("tags", "tag", "теги")


def _bare(value: str) -> str:
    return re.sub(r"^[\"']|[\"']$", "", value.strip()).strip()


def _value(inline: str, items: list[str]) -> str | list[str]:
    """Of what stands beside a key and the items below it: a scalar only where there is nothing but one inline."""
    listed = inline.startswith("[") and inline.endswith("]")
    beside = inline[1:-1].split(",") if listed else [inline]
    values = [x for x in map(_bare, beside) if x]
    if inline and not listed and not items:
        return _bare(inline)
    return values + [_bare(x) for x in items]


def parse_front(text: str) -> tuple[dict, str]:
    """(fields in their order, body). Lists are [a, b] or lines of '- a'; a later field of the same name counts."""
    m = _FRONT.match(text)
    if not m:
        return {}, text
    entries: list[tuple[str, str, list[str]]] = []
    for e in filter(None, map(_ENTRY.fullmatch, re.split(r"\r?\n", m[1]))):
        if e["key"] is not None:
            entries.append((e["key"], e["inline"].strip(), []))
        elif entries:
            entries[-1][2].append(e["item"])
    return {key: _value(inline, items) for key, inline, items in entries}, text[m.end() :]


def _quoted(value) -> str:
    s = str(value)
    if _PLAIN.fullmatch(s):
        return s
    return f'"{s}"' if s.startswith("[[") and s.endswith("]]") else '"' + s.replace('"', "'") + '"'


def write_front(fields: dict) -> str:
    line = lambda v: f"[{', '.join(map(_quoted, v))}]" if isinstance(v, list) else "" if v in (None, "") else _quoted(v)
    return "\n".join(f"{k}: {line(v)}" for k, v in fields.items())


def with_front(text: str, fields: dict) -> str:
    """The text with other fields; the body stays byte for byte."""
    m = _FRONT.match(text)
    body = text[m.end() :] if m else "\n" + text.lstrip()
    return f"---\n{write_front(fields)}\n---\n{body}"


def norm_tag(tag: str) -> str:
    return tag.strip().removeprefix("#").lower()


def tags_of(fields: dict) -> list[str]:
    found = next((fields[k] for k in TAG_FIELDS if k in fields), [])
    parts = found if isinstance(found, list) else re.split(r"[,\s]+", found)
    return [t for t in map(norm_tag, parts) if t]


def _set_tags(text: str, change: Callable[[list[str]], list[str]]) -> str:
    fields, _ = parse_front(text)
    fields = {k: v for k, v in fields.items() if k not in TAG_FIELDS[1:]} | {"tags": change(tags_of(fields))}
    return with_front(text, fields)


def add_tag(text: str, tag: str) -> str:
    t = norm_tag(tag)
    have = tags_of(parse_front(text)[0])
    return with_front(text, parse_front(text)[0]) if not t or t in have else _set_tags(text, lambda now: [*now, t])


def remove_tag(text: str, tag: str) -> str:
    return _set_tags(text, lambda now: [x for x in now if x != norm_tag(tag)])


def _link_name(link: str) -> str:
    return re.sub(r"\[\[|\]\]", "", link).split("|")[0].split("#")[0].strip().lower()


def add_link(text: str, name: str, target: str) -> str:
    fields, _ = parse_front(text)
    have = fields.get(name) or []
    have = have if isinstance(have, list) else [have]
    if _link_name(target) not in map(_link_name, have):
        fields[name] = [*have, f"[[{re.sub(r'(?i)[.]md$', '', target)}]]"]
    return with_front(text, fields)


def remove_link(text: str, name: str, target: str) -> str:
    fields, _ = parse_front(text)
    have = fields.get(name) or []
    left = [x for x in (have if isinstance(have, list) else [have]) if _link_name(x) != _link_name(target)]
    fields = {k: v for k, v in fields.items() if k != name or left} | ({name: left} if left else {})
    return with_front(text, fields)


def field_of(link_type: str) -> str:
    """The field of a note that holds the links of a type."""
    return next((field for field, known in LINK_TYPES.items() if known == link_type), link_type)


def set_field(text: str, name: str, value: str | list[str] | None) -> str:
    """The text with a field of its front matter set, or without it if the value is empty."""
    fields, _ = parse_front(text)
    if value in (None, ""):
        fields.pop(name, None)
    else:
        fields[name] = value
    return with_front(text, fields)


# ---------------------------------------------------------------- sections


def sections(body: str) -> list[tuple[int, str, str]]:
    """(level, heading, text): what stands before the first heading of level 1 to 4, then one for each."""
    out: list[tuple[int, str, list[str]]] = [(0, "", [])]
    for line in body.split("\n"):
        m = re.match(r"(#{1,4}) (.+)$", line)
        if m:
            out.append((len(m[1]), m[2].strip(), []))
        else:
            out[-1][2].append(line)
    parts = [(level, head, "\n".join(lines)) for level, head, lines in out]
    return [p for p in parts if p[1] or p[2].strip()]


_HEADING = re.compile(r"(?m)^(#{1,6})[^\S\n]+(.*)$")
_ITEM = re.compile(r"\s*(?:[-*+]\s|\d+[.)]\s)")
_BLANKS = re.compile(r"(?:\n[^\S\n]*)*\Z")


@dataclass(frozen=True)
class Section:
    """A heading and what belongs to it, as places in the text: the heading is text[at:head], all of it text[at:end]."""

    level: int
    title: str
    at: int
    head: int
    end: int


def _plain_title(title: str) -> str:
    return title.replace("\u00a0", " ").strip().lower()


def outline(text: str) -> list[Section]:
    """All headings; a section ends before the newline of the next heading of its level or above, or with the text."""
    found, open_ends = [], []  # levels and places of the headings to come, nearest last
    for m in reversed(list(_HEADING.finditer(text))):
        level = len(m[1])
        while open_ends and open_ends[-1][0] > level:
            open_ends.pop()
        found.append(Section(level, m[2], m.start(), m.end(), open_ends[-1][1] - 1 if open_ends else len(text)))
        open_ends.append((level, m.start()))
    return found[::-1]


def outlines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, place, level, title, at, head, end) of every heading of every document: `outline` as a table.

    Lines are rows with running offsets; a section ends before the nearest heading to come of its level or above,
    a window for each of the six levels over the headings of one document (one sort). Null texts and texts without
    headings give no rows; `key` tells documents apart. Lengths are in characters.
    """
    lines = docs.select(F.col(key).alias("key"), F.length(text).cast("long").alias("size"), F.posexplode(F.split(text, "\n")).alias("line", "t"))
    before = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("at", F.coalesce(F.sum(F.length("t") + 1).over(before), F.lit(0)).cast("long"))
    marks = F.regexp_extract("t", r"(?U)\A(#{1,6})\s", 1)
    h = lines.withColumn("level", F.length(marks)).where("level > 0")
    h = h.withColumn("title", F.regexp_replace(F.expr("substr(t, level + 1)"), r"(?U)\A\s+", ""))
    order = Window.partitionBy("key").orderBy("line")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("at"))).over(after) for k in range(1, 7)]
    end = F.coalesce(F.element_at(F.array(*ends), F.col("level")) - 1, F.col("size"))
    return h.select(F.col("key").alias(key), F.row_number().over(order).cast("long").alias("place"), "level", "title", "at", (F.col("at") + F.length("t")).alias("head"), end.alias("end"))


def headings(text: str, limit: int = 100) -> list[str]:
    """The headings as they are listed to a reader, indented by level."""
    return ["  " * (x.level - 1) + "#" * x.level + " " + x.title for x in outline(text)[:limit]]


def find_section(text: str, heading: str) -> Section | None:
    """The first section of this title."""
    return next((x for x in outline(text) if _plain_title(x.title) == _plain_title(heading)), None)


def _put(text: str, head: int, end: int, piece: str) -> str:
    """The piece after what is not blank in text[head:end], so that the blank lines there follow it."""
    gap = len(_BLANKS.search(text, head, end)[0])
    return f"{text[: end - gap]}\n{piece}{text[end - gap :]}"


def patch(text: str, heading: str, content: str, operation: str = "prepend") -> str:
    """Put content under a heading: replace, append, or (anything else) prepend. Items of one list are not parted."""
    text, block = text.replace("\r", ""), content.rstrip()
    s = find_section(text, heading)
    if s is None:
        raise ValueError(f"no heading {heading!r}; there are: {' | '.join(x.strip() for x in headings(text, 25)) or 'none'}")
    before, after = text[: s.head], text[s.end :]
    if operation == "replace":
        return f"{before}\n\n{block}\n{after}"
    if operation == "append":
        last = _BLANKS.sub("", text[s.at : s.end]).rpartition("\n")[2]
        return _put(text, s.head, s.end, block if _ITEM.match(last) and _ITEM.match(block) else f"\n{block}")
    blank = re.compile(r"(?:\n[^\S\n]*(?=\n|\Z))*").match(text, s.head).end()
    follows = text[blank + 1 :].partition("\n")[0]
    glue = "" if _ITEM.match(block.rpartition("\n")[2]) and _ITEM.match(follows) else "\n"
    return f"{text[:blank]}\n{block}{glue}{text[blank:]}"


def append(text: str | None, content: str) -> str:
    return (text.rstrip() + "\n\n" if text else "") + content.rstrip() + "\n"


# ---------------------------------------------------------------- differences


def _next(text: str, levels: str, at: int) -> int:
    """The place before the newline of the next heading of these levels, or the end."""
    m = re.compile(rf"(?m)^#{{{levels}}} ").search(text, at)
    return m.start() - 1 if m else len(text)


def under(text: str, heading: str, line: str) -> str:
    """A line at the end of the section of a level-two heading, which is made if it is not there."""
    spaces = re.escape(f"## {heading}".strip()).replace("\\ ", "[ \u00a0]")
    m = re.search(rf"(?mi)^[^\S\n]*{spaces}[^\S\n]*$", text)
    if m is None:
        return f"{text.rstrip()}\n\n## {heading}\n\n{line}\n"
    return _put(text, m.end(), _next(text, "1,6", m.end()), f"\n{line}").rstrip() + "\n"


def with_intro(text: str, intro: str) -> str:
    """A first text below the title and what follows it, before the first section; at the top without a title."""
    m = re.search(r"(?m)^# .*$", text)
    if m is None:
        return f"{intro.strip()}\n\n{text}"
    return _put(text, m.end(), _next(text, "2,6", m.end()), f"\n{intro.strip()}")


def capture(text: str | None, heading: str, line: str, template: str = "") -> tuple[str, str]:
    """(text, way) of a thought put into a note: under its heading, at the end with a heading, or into a new note."""
    if text is None:
        return under(template, heading, line), "create"
    if find_section(text, heading):
        return patch(text, heading, line, "append"), "patch"
    return append(text, f"## {heading}\n\n{line}"), "append"


def _band_row(a: list[str], b: list[str], i: int, low: int, width: int, below: list[int] | None) -> list[int]:
    """How many lines are deleted or added from line i of a and line i + low + k of b on, for each k of a band."""
    n, m, none = len(a), len(b), len(a) + len(b) + 1
    row = [none] * width
    for k in range(min(width - 1, m - i - low), max(-1, -i - low - 1), -1):
        j = i + low + k
        if j == m or i == n:
            row[k] = n - i + m - j
        elif a[i] == b[j]:
            row[k] = below[k]
        else:
            row[k] = 1 + min(below[k - 1] if k else none, row[k + 1] if k + 1 < width else none)
    return row


def _edit_steps(a: list[str], b: list[str]) -> Iterator[tuple[str, str]]:
    """(same | del | add, line), by a longest common subsequence; where both would do, a deletion comes first.

    Only a band around the diagonal is computed, which doubles until it is sure to hold all shortest ways; so the
    time goes with the lines times their differences. One row in the square root of all is kept, the others are made again.
    """
    n, m, more = len(a), len(b), 1
    while True:
        low, width = min(0, m - n) - more - 1, abs(m - n) + 2 * more + 3  # an edge that no shortest way touches
        every = int(n**0.5) + 1
        row, kept = None, {}
        for i in range(n, -1, -1):
            row = _band_row(a, b, i, low, width, row)
            if (n - i) % every == 0:
                kept[i] = row
        if row[-low] <= abs(m - n) + 2 * more:
            break
        more *= 2
    i = j = 0
    rows: dict[int, list[int]] = {}
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            yield "same", a[i]
            i, j = i + 1, j + 1
            continue
        if i < n and j < m and (i not in rows or i + 1 not in rows):
            end = n - (n - i - 1) // every * every
            rows = {end: kept[end]}
            for r in range(end - 1, i - 1, -1):
                rows[r] = _band_row(a, b, r, low, width, rows[r + 1])
        k = j - i - low
        if j == m or i < n and rows[i + 1][k - 1] <= rows[i][k + 1]:
            yield "del", a[i]
            i += 1
        else:
            yield "add", b[j]
            j += 1


def diff(old: str, new: str) -> list[tuple[str, str]]:
    """Runs of (same | del | add, lines), by a longest common subsequence of lines; where both would do, a
    deletion comes first. Texts of any size are compared in full."""
    a, b = (old or "").rstrip().split("\n"), (new or "").rstrip().split("\n")
    runs: list[tuple[str, list[str]]] = []
    for kind, line in _edit_steps(a, b):
        if not runs or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append(line)
    return [(kind, "\n".join(lines)) for kind, lines in runs]


def collapse(parts: list[tuple[str, str]], keep: int = KEEP) -> list[tuple[str, str]]:
    """Long runs of the same become their first and last lines and a count."""
    out = []
    for kind, text in parts:
        lines = text.split("\n")
        if kind != "same" or len(lines) <= 2 * keep + 1:
            out.append((kind, text))
        else:
            out += [("same", "\n".join(lines[:keep])), ("skip", str(len(lines) - 2 * keep)), ("same", "\n".join(lines[-keep:]))]
    return out


# ---------------------------------------------------------------- excerpts


def _met(word: Column, terms: list[list[str]]) -> Column:
    """Whether a word is one of the terms (each a list of variants of a key) or begins like it."""
    like = lambda k: reduce(lambda x, y: x | y, (A.stems_match(k, F.lit(v)) > 0 for t in terms for v in t), F.lit(False))
    return (F.length(word) >= 2) & F.exists(A.keys_of(word), like)


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def excerpt(text: Column, terms: list[list[str]], span: int = EXCERPT) -> Column:
    """About `span` characters around the first word that matches, cut between words; else the beginning.

    The cut begins at the last edge of a word that is more than half of `span` before the end of the match,
    and ends at the first edge that is `span` after.
    """
    bare = lambda w: F.regexp_replace(F.lower(w), "[^0-9a-zа-яё]", "")
    met = lambda w: F.when(A.may_match(w, terms), _met(w, terms)).otherwise(False)
    place = lambda pieces: F.array_position(F.transform(pieces, lambda p: _once(bare(p), met)), F.lit(True)).cast("int")
    ahead = lambda pieces, at: F.length(F.array_join(F.slice(pieces, F.lit(1), F.greatest(at, F.lit(1))), "")) - span // 2
    # up to the piece that the character after the edge is in
    edge = lambda t, half: F.when(half > 0, F.length(F.regexp_replace(F.substring(t, F.lit(1), F.greatest(half, F.lit(1))), r"(\s+|\S+)\z", ""))).otherwise(F.lit(0))

    def around(t: Column, start: Column) -> Column:
        body = F.substring(t, start + 1, F.lit(span))

        def cut(rest: Column) -> Column:
            tail = F.when(body.rlike(r"\s\z"), F.regexp_extract(rest, r"\A\s+", 0)).otherwise(F.regexp_extract(rest, r"\A\S+", 0))
            more = lambda x: F.when(F.length(rest) > F.length(x), "…").otherwise("")
            return _once(tail, lambda x: F.concat(F.when(start > 0, "…").otherwise(""), F.regexp_replace(F.concat(body, x), r"\A\s+|\s+\z", ""), more(x)))

        return _once(F.substring(t, start + 1 + span, F.length(t)), cut)

    first = lambda t: F.concat(F.regexp_replace(F.substring(t, 1, span), r"\A\s+|\s+\z", ""), F.when(F.length(t) > span, "…").otherwise(""))
    shown = lambda t, half, at: F.when(at > 0, _once(edge(t, half), lambda start: around(t, start))).otherwise(first(t))
    found = lambda t, pieces, at: _once(ahead(pieces, at), lambda half: shown(t, half, at))
    return _once(text, lambda t: _once(F.regexp_extract_all(t, F.lit(r"\s+|\S+"), F.lit(0)), lambda pieces: _once(place(pieces), lambda at: found(t, pieces, at))))


def mark(text: Column, terms: list[list[str]]) -> Column:
    """<mark> around the words that match."""
    letters = "0-9a-zA-Zа-яёА-ЯЁ"
    pieces = F.regexp_extract_all(text, F.lit(f"[{letters}]+|[^{letters}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(_met(F.lower(p), terms), F.concat(F.lit("<mark>"), p, F.lit("</mark>"))).otherwise(p)), "")


# ---------------------------------------------------------------- Markdown


def _wiki(m: re.Match) -> str:
    target, heading, alias = m["target"].strip(), m["heading"], m["alias"]
    return f'<a class="wiki" data-wiki="{target}"{f' data-heading="{heading}"' if heading else ""}>{alias or target}</a>'


#: Marks within a line: pattern, and what becomes of a match. Texts inside are read again but for code.
_INLINE = {
    "wiki": (r"!?\[\[(?P<target>[^\]|#]+)(?:#(?P<heading>[^\]|]*))?(?:\|(?P<alias>[^\]]*))?\]\]", _wiki),
    "code": (r"`(?P<code_text>[^`]+)`", lambda m: f"<code>{m['code_text']}</code>"),
    "strong": (r"\*\*(?P<strong_text>[^*]+)\*\*", lambda m: f"<strong>{_spans(m['strong_text'])}</strong>"),
    "em": (r"(?<!\*)\*(?P<em_text>[^*\n]+)\*", lambda m: f"<em>{_spans(m['em_text'])}</em>"),
    "link": (r"\[(?P<link_text>[^\]]+)\]\((?P<to>https?:[^)\s]+)\)", lambda m: f'<a href="{m["to"]}" target="_blank" rel="noopener">{_spans(m["link_text"])}</a>'),
}
_MARKS = re.compile("|".join(f"(?P<{name}>{pattern})" for name, (pattern, _) in _INLINE.items()))


def _spans(escaped: str) -> str:
    return _MARKS.sub(lambda m: _INLINE[next(k for k in _INLINE if m[k] is not None)][1](m), escaped)


def _inline(s: str) -> str:
    return _spans(html.escape(s, quote=False))


def _box(m: re.Match) -> str:
    return {None: "", "x": "☑ ", " ": "☐ "}[m[1]]


def _each(line: Callable[[re.Match], str], around: str = "{}") -> Callable[[list[re.Match]], str]:
    return lambda ms: around.format("".join(map(line, ms)))


#: Kinds of lines in the order in which they are tried, and what a run of lines of a kind becomes.
_BLOCKS = {
    "heading": (r"(#{1,4}) (.+)", _each(lambda m: f'<div class="md-h{len(m[1])}"><strong>{_inline(m[2])}</strong></div>')),
    "bullets": (r"\s*[-*] (?:\[([ x])\] )?(.+)", _each(lambda m: f"<li>{_box(m)}{_inline(m[2])}</li>", "<ul>{}</ul>")),
    "numbers": (r"\s*\d+\. (.+)", _each(lambda m: f"<li>{_inline(m[1])}</li>", "<ol>{}</ol>")),
    "quote": (r"> ?(.*)", _each(lambda m: f"<blockquote>{_inline(m[1])}</blockquote>")),
    "rule": (r"(?:---|\*\*\*)\s*$", _each(lambda m: "<hr>")),
    "blank": (r"\s*$", lambda ms: ""),
    "text": (r"(.*)", lambda ms: f"<p>{_inline(' '.join(m[1].strip() for m in ms))}</p>"),
}
_KINDS = {name: re.compile(pattern) for name, (pattern, _) in _BLOCKS.items()}


def render(source: str) -> str:
    """Markdown as HTML: headings, lists, quotes, rules, fenced code, paragraphs.

    Fences part the text into prose and code by turns; prose is runs of lines of one kind.
    """
    lines = source.split("\n")
    turns = accumulate(x.startswith("```") for x in lines)
    out: list[str] = []
    for turn, part in groupby(zip(turns, lines), key=itemgetter(0)):
        mine = [line for _, line in part][1 if turn else 0 :]  # without its fence
        if turn % 2:
            out.append(f"<pre><code>{html.escape(chr(10).join(mine), quote=False)}</code></pre>")
            continue
        typed = [next((k, m) for k, r in _KINDS.items() if (m := r.match(line))) for line in mine]
        out += [_BLOCKS[kind][1]([m for _, m in run]) for kind, run in groupby(typed, key=itemgetter(0))]
    return "".join(out)
