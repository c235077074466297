"""URL filters: ordered rules, and gradient-boosted trees on lexical features, in DataFrame functions only.

Rules name a host with its subdomains and the beginning of a path; the longest
that fits decides. Where none fits, boosted trees do. They are grown level by
level from histograms: each level is one aggregation of gradients by leaf,
feature and bin over the labelled sample, and only the sums (leaves x features
x bins) come to the driver. The finished trees are one Column of nested CASE
expressions, so judging URLs is a map without a shuffle, except for the join
with the statistics of suffixes.

Labels: any table of (url, label) can be given. Without one the URLs that the
rules decide are the labelled ones, and the trees carry on to the others what
the rules say. Only where the rules give no URLs of both kinds does
`weak_labels` stand in, which marks hosts that hold a word from a short list.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialise

#: Labelled URLs that trees are grown from, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 8, 3, 16, 0.5, 1.0
#: Suffixes whose label statistics are kept, at most: the commonest of the sample.
SUFFIXES = 1000
# Words in host names that mark a URL as unwanted where no labels are given.
UNWANTED = ("spam", "pills", "casino", "bets", "adult", "ads", "track", "porn", "xxx", "viagra", "poker", "malware", "phish")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---------------------------------------------------------------- parts and rules


def host_of(url: Column) -> Column:
    """From after the first :// to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    got = F.regexp_extract(url, "(?s)\\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(got, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ?, # or the end; '' without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)\\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule ('host/path') that fits, or null. Its host fits itself and all subdomains."""
    fits = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        name, _, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}"), F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string")) if fits else F.lit(None).cast("string")


# ---------------------------------------------------------------- features


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _entropy(text: Column) -> Column:
    """Bits for each character, by the text's own frequencies."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    each = F.transform(chars, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / F.greatest(n, F.lit(1)))
    return F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))


FEATURES = ("length", "host_length", "depth", "digit_share", "host_digits", "entropy", "host_entropy", "parameters", "labels", "longest_label", "hyphens", "other_signs", "secure", "query_length", "suffix_rate", "suffix_share")


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path, suffix and the lexical features f_*; a null URL counts as ''."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    d = df.withColumns({"host": host_of(F.col(url).cast("string")), "path": path_of(F.col(url).cast("string")), "_url": u})
    h, p = F.col("host"), F.col("path")
    u = F.col("_url")
    query = F.regexp_extract(u, "(?s)\\?([^#]*)", 1)
    n = F.greatest(F.length(u), F.lit(1))
    values = {
        "length": F.length(u), "host_length": F.length(h), "depth": _count(p, "/"),
        "digit_share": _count(u, "[0-9]") / n, "host_digits": _count(h, "[0-9]"), "entropy": _entropy(u), "host_entropy": _entropy(h),
        "parameters": F.when(query == "", F.lit(0)).otherwise(_count(query, "&") + 1), "labels": _count(h, "[.]") + 1,
        "longest_label": F.array_max(F.transform(F.split(h, "[.]"), F.length)), "hyphens": _count(h, "-"), "other_signs": _count(p, "[^A-Za-z0-9/._-]"),
        "secure": F.when(u.startswith("https"), F.lit(1)).otherwise(F.lit(0)), "query_length": F.length(query),
    }
    return d.withColumn("suffix", suffix_of(h)).withColumns({f"f_{k}": v.cast("double") for k, v in values.items()}).drop("_url")


def rule_labels(pages: DataFrame, rules: dict[str, str], url: str = "url") -> DataFrame:
    """(url, label) of the URLs that a rule decides: 1 for block, 0 for allow."""
    u = F.col(url).cast("string")
    blocked = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(int(rules[r] == "block"))), rules, F.when(F.lit(False), F.lit(0)))
    return pages.select(u.alias("url"), rule_for(host_of(u), path_of(u), rules).alias("rule")).where("rule is not null").select("url", blocked.alias("label"))


def weak_labels(pages: DataFrame, url: str = "url", words: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(url, label): 1 if the host has one of the words between dots and hyphens, else 0."""
    hit = host_of(F.col(url).cast("string")).rlike("(^|[.-])(" + "|".join(words) + ")([.-]|$)")
    return pages.where(F.col(url).isNotNull()).select(F.col(url).cast("string").alias("url"), hit.cast("int").alias("label"))


# ---------------------------------------------------------------- boosting


@dataclass
class Node:
    """A split (goes left if feature <= cut) or, without a feature, a leaf."""

    value: float = 0.0
    feature: str | None = None
    cut: float = 0.0
    left: "Node | None" = None
    right: "Node | None" = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(self.feature) <= F.lit(self.cut), self.left.column()).otherwise(self.right.column())


@dataclass
class Model:
    base: float = 0.0
    trees: list[Node] = field(default_factory=list)
    suffixes: list[tuple[str, float, float]] = field(default_factory=list)
    rate: float = 0.0

    def score(self) -> Column:
        raw = reduce(lambda a, b: a + b, (t.column() for t in self.trees), F.lit(self.base))
        return 1 / (1 + F.exp(-raw))


def _with_suffixes(df: DataFrame, model: Model) -> DataFrame:
    """Adds the label rate and the share of each row's suffix; at most SUFFIXES rows are joined."""
    kinds = "array<struct<suffix string, f_suffix_rate double, f_suffix_share double>>"
    rows = json.dumps([dict(zip(("suffix", "f_suffix_rate", "f_suffix_share"), x)) for x in model.suffixes])
    table = df.sparkSession.range(1).select(F.inline(F.from_json(F.lit(rows), kinds)))
    out = df.join(F.broadcast(table), "suffix", "left")
    return out.withColumns({"f_suffix_rate": F.coalesce("f_suffix_rate", F.lit(model.rate)), "f_suffix_share": F.coalesce("f_suffix_share", F.lit(0.0))})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Grow trees from at most `sample` labelled URLs, the lowest by a hash of the URL.

    Null URLs and labels are left out; a repeated URL counts once, with its highest label. Without both
    labels the model is constant.
    """
    spark = labelled.sparkSession
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    # about half as many again as the sample needs pass the bound on the hash, so that only these are grouped; all if there are few
    many = known.agg(F.approx_count_distinct("url", 0.02).alias("n")).first()["n"]
    share = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int(min(1.0, 1.5 * sample / max(many, 1)) * (1 << 30))
    rows = known.where(share).groupBy("url").agg(F.max("label").cast("double").alias("y"))
    # the sample is bounded, so one partition holds it and its sums need no shuffle
    rows = lexical(rows.orderBy(F.pmod(F.xxhash64("url"), F.lit(1 << 30)), "url").limit(sample)).coalesce(1)
    rows = materialise(rows, "url-sample")
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    n, y = total["n"], total["y"] or 0.0
    if not n or y in (0, n):
        return Model(base=0.0 if not n else 10.0 if y else -10.0)
    model = Model(base=math.log(y / (n - y)), rate=y / n)
    # at most SUFFIXES rows; rates lean on the overall rate with the weight of ten URLs
    top = rows.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy(F.desc("n"), "suffix").limit(SUFFIXES).collect()
    model.suffixes = [(r["suffix"], (r["y"] + 10 * model.rate) / (r["n"] + 10), r["n"] / n) for r in top]
    names = [f"f_{k}" for k in FEATURES]
    rows = _with_suffixes(rows, model).select("y", *names)
    quantiles = rows.agg(*(F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 10_000).alias(k) for k in names)).first()
    cuts = {k: sorted(set(quantiles[k])) for k in names}
    # a value's bin is the number of cuts below it
    rows = materialise(rows.select("*", *(sum((F.when(F.col(k) > c, 1).otherwise(0) for c in cuts[k]), F.lit(0)).alias(f"b{i}") for i, k in enumerate(names))).coalesce(1), "url-bins")
    for _ in range(TREES):
        root = Node()
        leaves = [root]
        p = model.score()
        grown = rows.withColumns({"g": F.col("y") - p, "h": p * (1 - p)})
        for level in range(DEPTH):
            place = _leaf_number(root, leaves)
            bins = F.explode(F.array(*(F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(names)))))
            sums = grown.select(place.alias("leaf"), "g", "h", bins.alias("x")).where("leaf >= 0").groupBy("leaf", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            leaves = _split(leaves, sums.collect(), names, cuts)
            if not leaves:
                break
        model.trees.append(root)
    return model


def _leaf_number(root: Node, leaves: list[Node]) -> Column:
    """The number in leaves of the leaf that a row falls into, or -1."""

    def walk(node: Node) -> Column:
        if node.feature is None:
            return F.lit(next((i for i, x in enumerate(leaves) if x is node), -1))
        return F.when(F.col(node.feature) <= F.lit(node.cut), walk(node.left)).otherwise(walk(node.right))

    return walk(root)


def _split(leaves: list[Node], sums: list, names: list[str], cuts: dict[str, list[float]]) -> list[Node]:
    """Set each leaf's value from its sums, and split those that gain by it; returns the new leaves."""
    out: list[Node] = []
    for number, leaf in enumerate(leaves):
        mine: dict[int, dict[int, tuple[float, float]]] = {}
        for r in sums:
            if r["leaf"] == number:
                mine.setdefault(r["f"], {})[r["b"]] = (r["g"], r["h"])
        if not mine:
            continue
        g, h = (sum(v[k] for _, v in sorted(mine[min(mine)].items())) for k in (0, 1))
        leaf.value = RATE * g / (h + RIDGE)
        best = (1e-6, 0, 0, 0.0, 0.0)
        for f in sorted(mine):
            gl = hl = 0.0
            for b in range(len(cuts[names[f]])):
                dg, dh = mine[f].get(b, (0.0, 0.0))
                gl, hl = gl + dg, hl + dh
                if hl < 1e-3 or h - hl < 1e-3:
                    continue
                gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                if gain > best[0] + 1e-9:
                    best = (gain, f, b, gl, hl)
        if best[0] > 1e-6:
            _, f, b, gl, hl = best
            leaf.feature, leaf.cut = names[f], cuts[names[f]][b]
            leaf.left, leaf.right = Node(RATE * gl / (hl + RIDGE)), Node(RATE * (g - gl) / (h - hl + RIDGE))
            out += [leaf.left, leaf.right]
    return out


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, threshold: float = 0.5, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, score.

    rules: 'host/path' to 'allow' or 'block'. verdict: the rule's; without one, block if the trees' score
    is at the threshold or above. A null URL or one without :// has an empty host and path, fits no rule
    and is judged by its features. Repeated rows are judged alike. An empty table gives an empty result.
    """
    if labelled is None:
        ruled = rule_labels(pages, rules, url)
        both = ruled.agg(F.min("label").alias("low"), F.max("label").alias("high")).first()
        labelled = ruled if (both["low"], both["high"]) == (0, 1) else weak_labels(pages, url)
    model = fit(labelled)
    d = _with_suffixes(lexical(pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))), model)
    d = d.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules)).withColumn("score", model.score())
    said = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), rules, F.when(F.lit(False), F.lit("")))
    return d.select("page_id", "host", "path", "rule", F.coalesce(said, F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "score")
