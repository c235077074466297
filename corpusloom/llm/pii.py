"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are what strict patterns find (e-mail and IP addresses, card and phone numbers). The words
beside seeds are lexical patterns; a pattern is as good as the share of its occurrences in the whole
corpus that stand beside a known identifier. Looser candidates (numbers and addresses in other
spellings) that stand at a good pattern, and have the shape of its kind, become known identifiers
wherever they occur; they in turn support patterns, and so on for some rounds.

Patterns and instances are two sides of a graph whose edges are aggregated tables, and a round is
two joins and two aggregations. Occurrences of patterns are counted in one pass over the texts;
words that begin no pattern are left out there by a bitmap of fixed size. Nothing of the graph
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import drop, join_hot, materialise, shuffle_partitions

#: Rounds; distinct identifiers that a pattern needs; its score at least.
ROUNDS, SUPPORT, CONFIDENCE = 4, 3, 0.5
#: Weight of a candidate of the right shape that is not known, against a pattern.
UNKNOWN = 0.25
#: Words of a pattern at most, and the characters beside a candidate that are looked at.
WORDS, REACH = 3, 120
#: Bits of the bitmap of wanted words, a power of two.
BITS = 1 << 17

# The kinds in their order, and their strict patterns. Possessive loops and the look behind only keep
# the time linear: a run of a pattern's first characters is tried from its beginning or from the last match's end.
KINDS = ("email", "ip", "card", "phone")
STRICT = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# Looser spellings: addresses with at and dot in brackets or as words, numbers with any separators, IPv6.
_AT, _DOT = r"\x20?(?:@|\(at\)|\[at\]|\{at\})\x20?", r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)"
LOOSE = "(?i)" + "|".join(
    (
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+|\x20at\x20[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++)",
        r"(?<![A-Za-z0-9:.])[0-9a-f]{0,4}(?::[0-9a-f]{0,4}){2,7}(?![A-Za-z0-9:])",
        r"(?<![A-Za-z0-9])[+(]?[0-9][\x20().+/_0-9-]{4,40}[0-9](?![A-Za-z0-9])",
    )
)
_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ALL = len(KINDS)


# ---------------------------------------------------------------- candidates


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit at its end."""
    n = F.length(number)
    at = lambda i: F.substring(number, i, F.lit(1)).cast("int")
    one = lambda i: F.when((n - i) % 2 == 0, at(i)).otherwise(2 * at(i) - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + one(i)) % 10 == 0


def strict(kind: Column, value: Column) -> Column:
    """Whether a match of the strict pattern of a kind is an identifier of it."""
    number = digits(value)
    small = F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*[0-9]{1,3}$") & (F.substring(F.concat(F.lit("00"), p), -3, 3).cast("int") <= 255))
    card = F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, small).when(kind == 2, card).when(kind == 3, F.length(number).between(9, 15)).otherwise(False)


def shapes(value: Column) -> Column:
    """The kinds, as numbers, whose shape a loose candidate has; none for most numbers."""
    number = F.length(digits(value))
    colons = value.rlike("^[0-9A-Fa-f:]*$") & value.contains(":")
    mail = ~colons & value.rlike("[A-Za-z]")
    quad = value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    of = lambda test, kind: F.when(test, F.array(F.lit(kind))).otherwise(F.array().cast("array<int>"))
    plain = ~mail & ~colons
    return F.concat(of(mail, 0), of(colons & (F.length(F.regexp_replace(value, "[^:]", "")) >= 2) & (F.length(value) >= 6) | quad, 1), of(plain & number.between(12, 19), 2), of(plain & ~quad & number.between(7, 15), 3))


def found(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, kind, value, start, end, before, after, known): all matches of the strict patterns (kind 0 to 3; known
    if it is an identifier) and of the loose one (kind 4; only what no identifier overlaps). One row with null kind for
    each row of docs besides. start and end are in code points, end exclusive; before and after are the text beside it."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    patterns = [*STRICT, LOOSE]
    none = F.array().cast("array<string>")
    may = [F.col("text").contains("@"), F.col("text").rlike(r"[0-9]\.[0-9]"), F.col("text").rlike("[0-9]"), F.col("text").contains("+"), F.lit(True)]
    d = d.withColumns({f"m{k}": F.when(may[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none) for k, p in enumerate(patterns)})
    d = d.withColumns({f"s{k}": F.when(F.size(f"m{k}") > 0, F.split("text", p, -1)).otherwise(none) for k, p in enumerate(patterns)}).drop("text")

    def matches(k: int) -> Column:
        m, s = F.col(f"m{k}"), F.col(f"s{k}")
        # slices count from 1
        zipped = F.arrays_zip(F.slice(s, 1, F.size(m)).alias("a"), m.alias("m"), F.slice(s, 2, F.size(m)).alias("b"))
        one = lambda z, i: F.struct(F.lit(k).alias("kind"), i.alias("i"), F.length(z["a"]).alias("gap"), z["m"].alias("value"), F.right(z["a"], F.lit(REACH)).alias("before"), F.left(z["b"], F.lit(REACH)).alias("after"))
        return F.transform(zipped, one)

    marker = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"), *(F.lit(None).cast("string").alias(c) for c in ("value", "before", "after"))))
    each = d.select("row", "doc_id", F.explode(F.concat(marker, *(matches(k) for k in range(_ALL + 1)))).alias("x")).select("row", "doc_id", "x.*")
    each = each.repartition(shuffle_partitions(docs.sparkSession), "row")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(upto)).withColumn("start", F.col("end") - F.length("value"))
    each = each.withColumn("known", F.coalesce(strict(F.col("kind"), F.col("value")), F.lit(False)))
    # a loose candidate meets an identifier that begins before it and goes on, or begins within it
    order, back = Window.partitionBy("row").orderBy("start"), Window.partitionBy("row").orderBy(F.desc("start"))
    known = lambda c: F.when(F.col("known"), F.col(c))
    reach = F.max(known("end")).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    follows = F.min(known("start")).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumns({"reach": reach, "follows": follows})
    free = (F.coalesce("reach", F.lit(-1)) <= F.col("start")) & (F.coalesce("follows", F.col("end")) >= F.col("end"))
    useful = F.col("kind").isNull() | F.col("known") | (F.col("kind") == _ALL) & free & (F.size(shapes(F.col("value"))) > 0)
    return each.where(useful).select("row", "doc_id", "kind", "value", "start", "end", "before", "after", "known")


# ---------------------------------------------------------------- patterns


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SEPARATORS), lambda w: w != "")


def contexts(before: Column, after: Column) -> Column:
    """The patterns beside a candidate: 'L ' and its last one to WORDS words before, 'R ' and the first two to WORDS after.
    A word at the far edge may be cut off and is not used."""
    left, right = _words(before), _words(after)
    left = F.when(F.length(before) >= REACH, F.slice(left, 2, REACH)).otherwise(left)
    right = F.when(F.length(after) >= REACH, F.slice(right, 1, F.greatest(F.size(right) - 1, F.lit(0)))).otherwise(right)
    ls = [F.when(F.size(left) >= n, F.concat(F.lit("L "), F.array_join(F.slice(left, -n, n), " "))) for n in range(1, WORDS + 1)]
    rs = [F.when(F.size(right) >= n, F.concat(F.lit("R "), F.array_join(F.slice(right, 1, n), " "))) for n in range(2, WORDS + 1)]
    return F.array_compact(F.array(*ls, *rs))


def _bit(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BITS))


def bitmap(words: DataFrame) -> DataFrame:
    """One row: BITS bits as longs, set at the hashes of the words of a one-column table."""
    b = _bit(F.col(words.columns[0]))
    some = words.select(F.floor(b / 64).cast("long").alias("at"), F.expr("shiftleft(1L, cast(pmod(xxhash64(`{}`), 64) as int))".format(words.columns[0])).alias("bit"))
    some = some.groupBy("at").agg(F.bit_or("bit").alias("bits"))
    every = words.sparkSession.range(BITS // 64).select(F.col("id").alias("at")).join(some, "at", "left")
    row = F.sort_array(F.collect_list(F.struct("at", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))  # BITS / 64 entries
    return every.agg(F.transform(row, lambda x: x["bits"]).alias("bits"))


def occurrences(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(gram, count): how often each wanted run of up to WORDS words (column gram) occurs in all texts."""
    firsts = bitmap(wanted.select(F.substring_index("gram", " ", 1).alias("w")).distinct()).scalar()
    grams = bitmap(wanted.select("gram")).scalar()
    d = docs.select(_words(F.col(text).cast("string")).alias("w"), firsts.alias("firsts"), grams.alias("grams"))
    has = lambda bits, w: F.getbit(F.element_at(bits, (F.floor(_bit(w) / 64) + 1).cast("int")), F.pmod(F.xxhash64(w), F.lit(64)).cast("int")) == 1
    w = F.col("w")
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: has(F.col("firsts"), F.element_at(w, i)))
    runs = lambda i: F.filter(F.array(*(F.when(i + n - 1 <= F.size("w"), F.array_join(F.slice(w, i, n), " ")) for n in range(1, WORDS + 1))), lambda g: g.isNotNull() & has(F.col("grams"), g))
    each = d.where(F.size("w") > 0).select(F.explode(F.flatten(F.transform(starts, runs))).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("count"))
    return wanted.join(counts, "gram")


def instance(kind: Column, value: Column) -> Column:
    """What makes two matches the same identifier: kind and the text in lower case without white space."""
    return F.concat(kind.cast("string"), F.lit(" "), F.regexp_replace(F.lower(value), r"\s+", ""))


def _sided(hits: DataFrame) -> DataFrame:
    return hits.withColumn("instance", instance(F.col("kind"), F.col("value"))).withColumn("pattern", F.explode(contexts(F.col("before"), F.col("after"))))


def learn(hits: DataFrame, docs: DataFrame, text: str = "text", rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(instances, patterns): loose candidates that became identifiers (instance, kind, score), and the good patterns
    (pattern, kind, known, score) of the last round.

    All counts are of distinct instances, so copies of a text weigh once. A pattern's score for a kind is known /
    (known + UNKNOWN * open + others): open are candidates of the kind's shape that are not known, others the candidates
    of other shapes and the pattern's occurrences without any candidate. A candidate goes by the longest pattern on
    either side that has the support, so 'order number' counts against it where 'number' would speak for it.
    """
    # equal edges are one row with their number; patterns beside fewer distinct candidates can never be good
    edges = _sided(hits.where("kind is not null")).groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n"), F.min("value").alias("value"))
    edges = materialise(edges.withColumn("shapes", F.when(F.col("kind") < _ALL, F.array("kind")).otherwise(shapes(F.col("value")))).drop("value"), "edges")
    degree = edges.groupBy("pattern").agg(F.count("*").alias("degree"), F.sum("n").alias("met")).where(F.col("degree") >= support)
    degree = materialise(degree.withColumn("gram", F.substring(F.col("pattern"), 3, 1 << 20)), "degrees")
    counts = occurrences(docs, degree.select("gram").distinct(), text)
    degree = materialise(degree.join(counts, "gram").select("pattern", "degree", F.greatest(F.col("count") - F.col("met"), F.lit(0)).alias("empty")), "counts")
    graph = join_hot(edges, degree.select("pattern", "degree"), ["pattern"], "degree")
    graph = materialise(graph.select("pattern", "instance", "kind", F.explode("shapes").alias("to")), "graph")
    drop(edges)
    shaped = graph.groupBy("pattern", "to").agg(F.count_if(F.col("kind") < _ALL).alias("base"), F.count("*").alias("shaped"))
    stats = materialise(shaped.join(degree, "pattern").select("pattern", "to", "base", "shaped", (F.col("degree") - F.col("shaped") + F.col("empty")).alias("others")), "stats")
    # each loose occurrence by its longest supported pattern of either side
    loose = _sided(hits.where(F.col("kind") == _ALL)).select("row", "start", "instance", "value", "pattern")
    per = loose.groupBy("pattern").agg(F.count("*").alias("rows")).join(degree.select("pattern"), "pattern")
    side = F.substring("pattern", 1, 1).alias("side")
    length = F.size(F.split("pattern", " ")).alias("length")
    chosen = join_hot(loose, per, ["pattern"], "rows").groupBy("row", "start", side).agg(F.max(F.struct(length, "pattern", "instance", "value")).alias("x")).select("x.*")
    chosen = chosen.groupBy("pattern", "instance").agg(F.min("value").alias("value"))
    chosen = materialise(chosen.select("pattern", "instance", F.explode(shapes(F.col("value"))).alias("to")), "chosen")
    drop(degree)
    rows = chosen.groupBy("pattern", "to").agg(F.count("*").alias("rows"))
    own = graph.where(F.col("kind") == _ALL).select("pattern", "instance", "to")
    own_rows = own.groupBy("instance", "to").agg(F.count("*").alias("rows"))
    instances, before = None, -1
    for _ in range(rounds):
        scored = stats.withColumn("more", F.lit(0).cast("long"))
        if instances is not None:
            now_known = instances.select("instance", "to").join(own_rows, ["instance", "to"])
            more = join_hot(own, now_known, ["instance", "to"], "rows").groupBy("pattern", "to").agg(F.count("*").alias("more"))
            scored = stats.join(more, ["pattern", "to"], "left").withColumn("more", F.coalesce("more", F.lit(0)))
        known = F.col("base") + F.col("more")
        score = known / (known + UNKNOWN * (F.col("shaped") - known) + F.col("others"))
        good = materialise(scored.select("pattern", "to", known.alias("known"), score.alias("score")).where((F.col("known") >= support) & (F.col("score") >= confidence)), "good")
        met = join_hot(chosen, good.select("pattern", "to", "score").join(rows, ["pattern", "to"]), ["pattern", "to"], "rows")
        fresh = met.groupBy("instance").agg(F.max(F.struct("score", (-F.col("to")).alias("of"))).alias("best"))
        instances = materialise(fresh.select("instance", (-F.col("best.of")).alias("to"), "best.score"), "instances")
        now = instances.count()
        if now == before or not now:
            break
        before = now
    return instances.withColumnRenamed("to", "kind"), good.withColumnRenamed("to", "kind")


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(row, doc_id, kind, start, end, value, base): every identifier, those of the strict patterns with base = true; a row
    with null kind for each row of docs besides. kind is a number, the place in KINDS."""
    hits = materialise(found(docs, text, doc_id), "hits")
    instances, _ = learn(hits, docs, text, **options)
    loose = hits.where(F.col("kind") == _ALL).withColumn("instance", instance(F.col("kind"), F.col("value")))
    per = loose.groupBy("instance").agg(F.count("*").alias("rows"))
    more = join_hot(loose.drop("kind", "known"), instances.select("instance", "kind").join(per, "instance"), ["instance"], "rows")
    columns = ("row", "doc_id", "kind", "start", "end", "value")
    base = hits.where(F.col("kind").isNull() | (F.col("kind") < _ALL)).select(*columns, F.lit(True).alias("base"))
    return base.unionByName(more.select(*columns, F.lit(False).alias("base")))


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone (of the strict patterns), base_sha256, spans, n_more.

    spans lists all identifiers as kind:start:end, by start and kind; n_more is how many of them only their contexts
    gave. Null and empty texts have none (the digest is that of the empty string). Rows that repeat a doc_id stay
    rows of their own; equal texts get equal spans. An empty table gives no rows. Other columns of docs are not read.
    """
    each = spans(docs, text, doc_id, **options)
    here = F.col("kind").isNotNull()
    told = F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "start", "end")
    listed = F.sort_array(F.collect_list(F.when(here, F.struct("start", "kind", "end", "base", told.alias("told")))))  # those of one text
    out = each.groupBy("row", "doc_id").agg(*(F.count_if(F.col("base") & (F.col("kind") == k)).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.count_if(here & ~F.col("base")).alias("n_more"), listed.alias("x"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: s["told"]), ",")
    base = F.sha2(joined(F.filter("x", lambda s: s["base"])).cast("binary"), 256)
    return out.select("doc_id", *(f"n_{name}" for name in KINDS), base.alias("base_sha256"), joined(F.col("x")).alias("spans"), "n_more")


def masked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """(doc_id, text): texts with each identifier replaced by its kind in brackets. doc_ids should be distinct."""
    each = spans(docs, text, doc_id, **options).where("kind is not null")
    per = each.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("x"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(per, "doc_id", "left")
    name = lambda k: F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), k + 1), F.lit("]"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    step = lambda s, x: F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["parts"], F.array(F.substring("text", (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), name(x["kind"]))).alias("parts"))).otherwise(s)
    done = F.aggregate(F.coalesce("x", F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")), start, step, lambda s: F.concat(F.array_join(s["parts"], ""), F.substring("text", (s["at"] + 1).cast("int"), F.length("text"))))
    return d.select("doc_id", done.alias("text"))
