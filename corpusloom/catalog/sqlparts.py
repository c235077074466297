"""Pieces of DuckDB SQL that several checks share."""

from __future__ import annotations

from corpusloom.functions import analyze as A


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STOPS = "[" + ", ".join(map(lit, A.STOP_WORDS)) + "]"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{A.SEPARATOR}'), lambda w: length(w) >= 2 AND NOT list_contains({STOPS}, w))"


def stem(word: str) -> str:
    out = f"replace(lower({word}), 'ё', 'е')"
    for _ in range(2):
        out = f"regexp_replace({out}, '{A.ENDING}', '\\1')"
    return out


def translit(word: str) -> str:
    out = f"translate({word}, {lit(''.join(A._ONE))}, {lit(''.join(A._ONE.values()))})"
    for k, v in A._MANY.items():
        out = f"replace({out}, {lit(k)}, {lit(v)})"
    return out


def match(a: str, b: str) -> str:
    n = f"least(6, length({a}), length({b}))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {n} >= 4 AND left({a}, {n}) = left({b}, {n}) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END"


def authority(path: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({path}, {lit('(?i)' + p)}) THEN {w}::DOUBLE" for p, w in A.AUTHORITY) + " ELSE 1.0::DOUBLE END"


def excerpt(rows: str, terms: list[list[str]], span: int = 320) -> str:
    """The rows of a relation that has a text `t`, with `frag`, what surrounds the first match."""
    bare = "regexp_replace(lower(p), '[^0-9a-zа-яё]', '', 'g')"
    like = " OR ".join(f"{match('k', lit(v))} > 0" for t in terms for v in t)
    met = f"length({bare}) >= 2 AND len(list_filter([{stem(bare)}, {translit(stem(bare))}], lambda k: {like})) > 0"
    edge = "'\\A\\s+|\\s+\\z', '', 'g'"
    return f"""(SELECT *, CASE WHEN hit > 0 THEN CASE WHEN begin > 0 THEN '…' ELSE '' END || regexp_replace(body || tail, {edge}) || CASE WHEN length(rest) > length(tail) THEN '…' ELSE '' END
  ELSE regexp_replace(left(t, {span}), {edge}) || CASE WHEN length(t) > {span} THEN '…' ELSE '' END END AS frag
FROM (SELECT *, CASE WHEN regexp_matches(body, '\\s\\z') THEN regexp_extract(rest, '\\A\\s+') ELSE regexp_extract(rest, '\\A\\S+') END AS tail
FROM (SELECT *, substr(t, begin + 1, {span}) AS body, substr(t, begin + 1 + {span}) AS rest
FROM (SELECT *, CASE WHEN half > 0 THEN length(regexp_replace(left(t, half), '(\\s+|\\S+)\\z', '')) ELSE 0 END AS begin
FROM (SELECT *, length(array_to_string(pieces[1:greatest(hit, 1)], '')) - {span // 2} AS half
FROM (SELECT *, coalesce(list_position(list_transform(pieces, lambda p: {met}), true), 0) AS hit
FROM (SELECT *, regexp_extract_all(t, '\\s+|\\S+') AS pieces FROM {rows})))))))"""


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: lit(x) if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


#: (doc_id, term, n): how often each key occurs in each document's text.
POSTINGS = f"""tok AS (SELECT doc_id, unnest({words('text')}) AS w FROM documents),
uniq AS (SELECT doc_id, w, count(*) AS n FROM tok GROUP BY 1, 2),
keyed AS (SELECT doc_id, unnest(list_distinct([s, {translit('s')}])) AS term, n FROM (SELECT doc_id, {stem('w')} AS s, n FROM uniq)),
postings AS (SELECT doc_id, term, sum(n)::BIGINT AS n FROM keyed GROUP BY 1, 2)"""
