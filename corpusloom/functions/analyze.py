"""Text analysis as Columns: tokens, stems, transliteration, keys, authority, hashes, formats.

Everything here is a built-in expression, so it stays inside generated code and
can be pushed to a scan; the same rules exist once more as plain Python for the
few words of a query.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings in the order in which they are tried, stop words, transliteration, weights by path.
SUFFIXES = (
    "ившийся", "ывшийся", "авшийся", "ившись", "ывшись", "авшись", "нуться",
    "ующий", "ающий", "ившие", "ывать", "ивать", "овать", "ается", "яется",
    "ались", "ялись", "ились", "ешься", "ишься", "ческий", "ически",
    "ыми", "ими", "ого", "его", "ому", "ему", "ами", "ями", "ать", "ять",
    "ить", "еть", "уть", "ыть", "ется", "ются", "ится", "атся",
    "ете", "ите", "ая", "яя", "ое", "ее", "ые", "ие", "ой", "ей", "ом",
    "ем", "им", "ам", "ям", "ах", "ях", "ых", "их", "ов", "ев", "ью",
    "ья", "ье", "ий", "ый", "ла", "ло", "ли", "ет", "ит", "ут", "ют",
    "ат", "ят", "ing", "ed", "es",
    "а", "я", "о", "е", "ы", "и", "у", "ю", "ь", "л", "s",
)
STOP_WORDS = tuple(
    (
        "я ты он она оно мы вы они это этот эта эти тот та те что чего чем как какой какая какие "
        "где когда куда откуда зачем почему кто кого кому не ни да нет и а но или же ли бы был была "
        "было были быть есть еще уже вот там тут здесь очень вообще просто надо нужен нужно нужна "
        "нужны можно у в во на с со к ко по за из от до для о об про при над под без через между "
        "мой моя мои меня мне свой себя весь вся все так то ну вроде типа хочу хотел "
        "the a an of to in on for is are was were do does did i my me it this that"
    ).split()
)
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "yu", "я": "ya",
}
AUTHORITY = (
    ("^brain/log/", 0.4),
    ("^_tools/queue/", 0.4),
    ("^Учёба/Лог сессий/", 0.4),
    ("^daily/", 0.7),
    ("^resources/", 0.85),
    ("^осколки/", 1.4),
)

SEPARATOR = "[^0-9a-zа-яё]+"
#: A lazy head and an anchored tail pick the longest ending that leaves four letters; no ending is a
#: tail of a later, longer one, so that is the first of the list as well.
ENDING = "^(.{4,}?)(?:" + "|".join(SUFFIXES) + ")$"
LATIN_ENDING = "^(.{4,}?)(?:" + "|".join(s for s in SUFFIXES if s.isascii()) + ")$"
_ONE = {k: v for k, v in TRANSLIT.items() if len(v) == 1}
_MANY = {k: v for k, v in TRANSLIT.items() if len(v) != 1}


# ---------------------------------------------------------------- Columns


def tokens(text: Column) -> Column:
    """Words of two letters or more that are no stop words, in order, with repeats; null gives none."""
    return F.filter(words(text), is_token)


def words(text: Column) -> Column:
    """The pieces between separators; null gives one empty piece."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR)


def is_token(word: Column) -> Column:
    return (F.length(word) >= 2) & ~word.isin(*STOP_WORDS)


def _stripped(word: Column, ending: str) -> Column:
    return F.regexp_replace(F.regexp_replace(word, ending, "$1"), ending, "$1")


def _cyrillic(word: Column) -> Column:
    return word.rlike("[А-яёЁ]")


def stem(word: Column) -> Column:
    """A word without Cyrillic has Latin endings only, which are few."""
    full = _stripped(F.replace(F.lower(word), F.lit("ё"), F.lit("е")), ENDING)
    return F.when(_cyrillic(word), full).otherwise(_stripped(F.lower(word), LATIN_ENDING))


def translit(word: Column) -> Column:
    w = F.translate(word, "".join(_ONE), "".join(_ONE.values()))
    for k, v in _MANY.items():
        w = F.replace(w, F.lit(k), F.lit(v))
    return w


def keys_of(word: Column) -> Column:
    """The stem, and its transliteration if that is another string (which takes Cyrillic)."""
    s = _stripped(F.replace(F.lower(word), F.lit("ё"), F.lit("е")), ENDING)
    return F.when(_cyrillic(word), F.array_distinct(F.array(s, translit(s)))).otherwise(F.array(_stripped(F.lower(word), LATIN_ENDING)))


def stems(text: Column) -> Column:
    """The distinct keys of a text."""
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(tokens(text)), keys_of)))


def stems_match(a: Column, b: Column) -> Column:
    """1 for equal keys, 0.7 for keys that share their first letters (six, or all of the shorter, four at least), else 0."""
    n = F.least(F.lit(6), F.length(a), F.length(b))
    alike = (n >= 4) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.when(a == b, F.lit(1.0)).when(alike, F.lit(0.7)).otherwise(F.lit(0.0))


def may_match(word: Column, terms: list[list[str]]) -> Column:
    """Whether a word can have a key that matches: a stem keeps the first four letters of its word, and
    Cyrillic may match by its transliteration."""
    heads = sorted({v[:4] for t in terms for v in t})
    return F.substring(F.replace(word, F.lit("ё"), F.lit("е")), 1, 4).isin(heads) | word.rlike("[а-яё]")


def authority(path: Column) -> Column:
    """The weight of the first pattern that fits, else 1."""
    out = None
    for pattern, weight in AUTHORITY:
        hit = path.rlike(f"(?iu){pattern}")
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return out.otherwise(F.lit(1.0))


def norm(text: Column) -> Column:
    return F.trim(F.translate(F.lower(text), "ё", "е"))


def fold_hash(text: Column) -> Column:
    """h = (h * 33) ^ code over the characters, from 5381, as 32 unsigned bits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseXOR(c).bitwiseAND(F.lit(4294967295)))


def scatter_hash(text: Column) -> Column:
    """h = h * 31 + code in 32 bits; its thousandths, 0 to 0.999."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda a, c: (a * 31 + c).bitwiseAND(F.lit(4294967295)))
    return F.pmod(h, F.lit(1000)) / 1000


def base_of(path: Column) -> Column:
    """The last segment without .md."""
    return F.element_at(F.split(F.regexp_replace(path, "(?i)\\.md$", ""), "/"), -1)


def format_bytes(n: Column) -> Column:
    kb = F.replace(F.format_string("%.1f", n / 1024), F.lit("."), F.lit(","))
    mb = F.replace(F.format_string("%.1f", n / 1048576), F.lit("."), F.lit(","))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" Б"))).when(n < 1048576, F.concat(kb, F.lit(" КБ"))).otherwise(F.concat(mb, F.lit(" МБ")))


def age_hours(at: Column, now: Column) -> Column:
    """Hours from a time to now; 100000 without a time."""
    return F.coalesce((now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 3600, F.lit(1e5))


def format_age(at: Column, now: Column) -> Column:
    s = now.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")
    whole = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return (
        F.when(at.isNull(), F.lit("—")).when(s < 90, F.lit("только что")).when(s < 3600, F.concat(whole(s / 60), F.lit(" мин назад")))
        .when(s < 86400, F.concat(whole(s / 3600), F.lit(" ч назад"))).when(s < 172800, F.lit("вчера")).otherwise(F.concat(whole(s / 86400), F.lit(" дн назад")))
    )


def plural(n: Column, one: str, few: str, many: str) -> Column:
    a, b = F.pmod(n, F.lit(10)), F.pmod(n, F.lit(100))
    return F.when((a == 1) & (b != 11), F.lit(one)).when(a.between(2, 4) & ~b.between(12, 14), F.lit(few)).otherwise(F.lit(many))


def safe_file_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[\\\\/:*?\"<>|#^\\[\\]]", " "), "\\s+", " "))


def slug(text: Column, most: int = 80) -> Column:
    """At most `most` characters, cut between words, without marks at the end."""
    cut = F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), "\\s+\\S*$", "")).otherwise(text)
    return F.regexp_replace(cut, "[.,;:]+$", "")


def strip_date(title: Column) -> Column:
    return F.regexp_replace(title, "^\\d{4}-\\d{2}-\\d{2}[\\s—–-]*", "")


def date_in(path: Column, title: Column) -> Column:
    """The first date in the path and the title; null without a valid one."""
    found = F.regexp_extract(F.concat_ws(" ", path, title), "(20\\d{2}-\\d{2}-\\d{2})", 1)
    return F.try_to_date(F.nullif(found, F.lit("")), "yyyy-MM-dd")


def note_date(path: Column, title: Column, at: Column) -> Column:
    """The date in the path and the title, else that of the note."""
    return F.coalesce(date_in(path, title), at.cast("date"))


def clean_fragment(text: Column) -> Column:
    """Without the brackets of links (an alias stands for its link, else the target without its heading), bold
    marks, and marks of lists and quotes where a line begins with one."""
    t = F.regexp_replace(text, "\\[\\[[^\\]|#]+(?:#[^\\]|]*)?\\|([^\\]]+)\\]\\]", "$1")
    t = F.regexp_replace(t, "\\[\\[([^\\]|#]+)(?:#[^\\]|]*)?\\|?\\]\\]", "$1")
    t = F.replace(t, F.lit("**"), F.lit(""))
    return F.regexp_replace(t, "(?m)^[-*>]\\s+", "")


# ---------------------------------------------------------------- the same for the words of a query


def py_stem(word: str) -> str:
    w = word.lower().replace("ё", "е")
    for _ in range(2):
        w = re.sub(ENDING, r"\1", w)
    return w


def py_translit(word: str) -> str:
    return "".join(TRANSLIT.get(c, c) for c in word)


def py_keys(word: str) -> list[str]:
    s = py_stem(word)
    return list(dict.fromkeys([s, py_translit(s)]))


def py_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATOR, text.lower()) if len(w) >= 2 and w not in STOP_WORDS]


def py_match(a: str, b: str) -> float:
    n = min(6, len(a), len(b))
    return 1.0 if a == b else 0.7 if n >= 4 and a[:n] == b[:n] else 0.0


def parse_synonyms(text: str) -> list[list[str]]:
    """Each list line with two words or more, parted by , ; or ·, is a group of keys."""
    groups = []
    for line in (text or "").split("\n"):
        item = re.match(r"\s*[-*]\s+(.*)$", line)
        words = [w.strip() for w in re.split("[,;·]", item[1]) if w.strip()] if item else []
        if len(words) >= 2:
            groups.append(list(dict.fromkeys(k for w in words for k in py_keys(w))))
    return groups


def query_terms(text: str, synonyms: list[list[str]] | tuple = ()) -> list[list[str]]:
    """For each word of a query (repeats stay) its keys and those of every group that shares one.

    Groups apply in turn to the keys so far, so chains of groups expand."""
    terms = []
    for word in py_words(text):
        keys = dict.fromkeys(py_keys(word))
        for group in synonyms:
            if any(k in keys for k in group):
                keys |= dict.fromkeys(group)
        terms.append(list(keys))
    return terms
