"""Readers and writers of the on-disk formats: map, dictionary, keywords, synonyms, vectors, chunks, Markdown."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D

# Where the parts of a corpus lie, and the root that holds machine-made files.
MAP, DICTIONARY, KEYWORDS = "_машина/карта/карта.json", "_машина/карта/словарь", "_машина/карта/ключи.json"
INDEX, SYNONYMS, VECTORS, MACHINE = "_машина/индекс", "_машина/синонимы.md", "_машина/векторы", "_машина"
SHARDS = 16

_NOTE = "struct<p:string,t:string,ty:string,kl:string,kt:string,wh:string,cf:string,al:array<string>,st:string,tg:array<string>,hd:array<string>,br:array<string>,u:string,h:string,c:bigint,b:bigint,ln:array<array<string>>>"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of whole files, without a byte order mark."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "\\A\ufeff", "").alias("value"))


def _optional(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        d = _text(spark, path)
        d.schema
        return d
    except AnalysisException:
        return None


def read_map(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(notes, links) of the map. Links name notes by their place in the list; those to nothing or oneself are dropped."""
    raw = _text(spark, f"{root}/{MAP}").select(F.from_json("value", f"notes array<{_NOTE}>").alias("m"))
    n = raw.select(F.posexplode("m.notes").alias("pos", "n"))
    s = lambda c: F.coalesce(F.col(f"n.{c}"), F.lit("")).alias
    many = lambda c, name: F.coalesce(F.col(f"n.{c}"), F.array().cast("array<string>")).alias(name)
    base = A.base_of(F.col("n.p"))
    notes = n.select(
        "pos", F.col("n.p").alias("path"), base.alias("base"), F.coalesce(F.nullif("n.t", F.lit("")), base).alias("title"), s("ty")("type"), s("kl")("klass"), s("kt")("kind"), s("wh")("at_text"), s("cf")("confidence"), s("st")("status"),
        many("al", "aliases"), many("tg", "tags"), many("hd", "headings"), many("br", "broken"), F.col("n.u").alias("updated_at"), F.col("n.h").alias("human_at"), F.coalesce("n.c", F.lit(0)).alias("commits"), F.coalesce("n.b", F.lit(0)).alias("bytes"),
    )
    l = n.select("pos", F.explode("n.ln").alias("l")).select("pos", F.get("l", F.lit(0)).cast("int").alias("to"), F.get("l", F.lit(1)).alias("type"))
    ends = notes.select("pos", "path")
    links = l.join(ends.withColumnRenamed("path", "src"), "pos").join(ends.select(F.col("pos").alias("to"), F.col("path").alias("dst")), "to").where("pos <> to").select("src", "dst", "type")
    return notes, links


def read_postings(spark: SparkSession, root: str) -> DataFrame:
    """(pos, term, tf_body, tf_meta) of all dictionary shards. A digit d of the body stands for 2 ** (d - 1)."""
    raw = _text(spark, f"{root}/{DICTIONARY}/*.json").select(F.explode(F.from_json("value", "map<string,string>")).alias("term", "list"))
    p = raw.select("term", F.explode(F.split("list", ",")).alias("x"))
    digit = lambda i: F.coalesce(F.substring(F.substring_index("x", ":", -1), i, 1).try_cast("int"), F.lit(0))
    return p.select(F.substring_index("x", ":", 1).try_cast("int").alias("pos"), "term", F.when(digit(1) > 0, F.pow(F.lit(2.0), digit(1) - 1)).otherwise(0.0).alias("tf_body"), digit(2).alias("tf_meta"))


def write_postings(postings: DataFrame, root: str, shards: int = SHARDS) -> None:
    """Postings as a table parted by the hash of the term, sorted by term: a query reads the shards of its terms."""
    p = postings.withColumn("shard", F.pmod(A.fold_hash(F.col("term")), F.lit(shards)).cast("int"))
    p.repartition("shard", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(root)


def read_keywords(spark: SparkSession, root: str) -> DataFrame:
    """(pos, term); lists are in the order of the notes."""
    raw = _text(spark, f"{root}/{KEYWORDS}").select(F.posexplode(F.from_json("value", "array<array<string>>")).alias("pos", "terms"))
    return raw.select("pos", F.explode("terms").alias("term"))


def read_synonyms(spark: SparkSession, root: str) -> list[list[str]]:
    """Groups of keys; none if the file is missing. The file is a short list that people keep by hand."""
    d = _optional(spark, f"{root}/{SYNONYMS}")
    return A.parse_synonyms("\n".join(r["value"] for r in d.collect())) if d is not None else []


def read_chunks(spark: SparkSession, root: str) -> DataFrame:
    """(path, i, h, t) of all index shards."""
    raw = _text(spark, f"{root}/{INDEX}/[0-9]*.json").select(F.explode(F.from_json("value", "array<struct<p:string,h:array<string>,t:string,i:bigint>>")).alias("c"))
    return raw.select(F.col("c.p").alias("path"), F.coalesce("c.i", F.lit(0)).alias("i"), F.coalesce("c.h", F.array().cast("array<string>")).alias("h"), F.col("c.t").alias("t"))


def chunk_notes(texts: DataFrame) -> DataFrame:
    """(path, i, h, t): texts (path, text) cut before each heading of level 1 to 4, blank parts left out.

    h is the chain of headings: a heading of level two begins it anew, any other follows its first one.
    """
    parts = texts.select("path", F.posexplode(F.split(D.without_front_matter(F.col("text")), r"(?m)(?=^#{1,4} )")).alias("at", "part")).where(F.trim(F.regexp_replace("part", r"\s+", " ")) != "")
    head = F.regexp_extract("part", r"\A(#{1,4}) (.+)", 1)
    parts = parts.withColumns({"level": F.length(head), "title": F.nullif(F.trim(F.regexp_extract("part", r"\A(#{1,4}) (.+)", 2)), F.lit(""))})
    order = Window.partitionBy("path").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.first("title", ignorenulls=True).over(so_far)
    root = F.coalesce(F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(so_far), first)
    before = F.count("title").over(order.rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast("array<string>")
    # a part without a heading can only be the first
    chain = F.when(F.col("title").isNull(), none).when((F.col("level") == 2) | (before == 0), F.array("title")).otherwise(F.array(root, "title"))
    body = F.regexp_replace(F.regexp_replace("part", r"\A#{1,4} .+\n?", ""), r"\A\s+|\s+\z", "")
    return parts.select("path", (F.row_number().over(order) - 1).cast("long").alias("i"), chain.alias("h"), body.alias("t"))


@dataclass
class Corpus:
    """A loaded corpus: its notes and links, whether they are of the map, and a number that changes with every load."""

    notes: DataFrame
    links: DataFrame
    from_map: bool
    snapshot: str


def model_of(spark: SparkSession, raw: tuple[DataFrame, DataFrame] | DataFrame) -> Corpus:
    """The model of a map (notes, links) or of chunks."""
    if isinstance(raw, tuple):
        return Corpus(*raw, True, uuid.uuid4().hex)
    notes = notes_of_chunks(raw)
    return Corpus(notes, links_of_notes(notes), False, uuid.uuid4().hex)


def load(spark: SparkSession, root: str) -> Corpus:
    """The map if it can be read, else the chunk index."""
    try:
        found = read_map(spark, root)
        if found[0].limit(1).count():
            return model_of(spark, found)
    except (AnalysisException, PySparkException):
        pass
    return model_of(spark, read_chunks(spark, root))


def demo(spark: SparkSession) -> DataFrame:
    """(path, text) of a few invented notes to try things on."""
    notes = {
        "projects/Garden.md": "---\nclass: entity\ntags: [garden]\n---\n# Garden\nBeds and paths, see [[Compost]].\n## Beds\n- beans\n- peas\n### Soil\nheavy",
        "projects/Compost.md": "# Compost\nTurned in spring; for the [[Garden|garden]].",
        "daily/2024-03-02.md": "---\ntags: [log]\n---\nSowed peas in [[Garden#Beds]].",
        "people/Ada.md": "Helps with the [[Compost]].",
    }
    return spark.createDataFrame(list(notes.items()), "path string, text string")


def notes_of_chunks(chunks: DataFrame) -> DataFrame:
    """(path, base, title, text, bytes): chunks in their order with blank lines between; machine-made paths are left out."""
    c = chunks.where(F.col("path").isNotNull() & (F.col("path") != "") & ~F.col("path").startswith(MACHINE))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n\n")
    n = c.groupBy("path").agg(text.alias("text"))
    return n.select("path", A.base_of(F.col("path")).alias("base"), A.base_of(F.col("path")).alias("title"), "text", F.length("text").cast("long").alias("bytes"))


def links_of_notes(notes: DataFrame) -> DataFrame:
    """(src, dst, type) by the links in texts, each pair of notes once, in the direction first seen by path and place."""
    from corpusloom.operators.model import resolve

    t = notes.select(F.col("path").alias("src"), F.posexplode(D.wikilinks(F.col("text"))).alias("at", "l")).select("src", "at", F.col("l.target").alias("target"))
    # of notes with one base the last counts here
    last = notes.select("path", "base", F.row_number().over(Window.partitionBy(F.lower("base")).orderBy(F.desc("path"))).alias("pos"))
    r = resolve(t, last).where("found is not null and found <> src")
    first = Window.partitionBy(F.least("src", "found"), F.greatest("src", "found")).orderBy("src", "at")
    return r.withColumn("r", F.row_number().over(first)).where("r = 1").select("src", F.col("found").alias("dst"), F.lit("link").alias("type"))


def read_vectors(spark: SparkSession, root: str, dim: int) -> DataFrame:
    """(vec_id, path, heading, embedding): whole numbers from -127 to 127, from shards of base64 rows."""
    lines = _text(spark, f"{root}/{VECTORS}/[0-9]*.json").select(F.regexp_extract("file", "([0-9]+)\\.json$", 1).cast("int").alias("shard"), F.regexp_replace("value", "^\"|\"\\s*$", "").alias("b"))
    rows = lines.select("shard", F.unbase64("b").alias("b")).withColumn("n", F.floor(F.octet_length("b") / dim).cast("int"))
    rows = rows.where("n > 0").select("shard", "b", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("row"))
    byte = lambda j: F.conv(F.hex(F.expr("substring(b, row * %d + 1, %d)" % (dim, dim)).substr(j + 1, F.lit(1))), 16, 10).cast("int")
    values = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.when(byte(j) > 127, byte(j) - 256).otherwise(byte(j)).cast("tinyint"))
    v = rows.select("shard", "row", values.alias("embedding"))
    chunk = _text(spark, f"{root}/{VECTORS}/куски.json").select(F.posexplode(F.from_json("value", "array<struct<p:string,h:string>>")).alias("vec_id", "c"))
    per = v.groupBy("shard").agg(F.max("row").alias("m")).agg(F.max("m").alias("m"))
    numbered = v.crossJoin(F.broadcast(per)).select((F.col("shard") * (F.col("m") + 1) + F.col("row")).alias("vec_id"), "embedding")  # one row
    return numbered.join(chunk.select("vec_id", F.col("c.p").alias("path"), F.col("c.h").alias("heading")), "vec_id")


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, text) of all Markdown files below a folder."""
    d = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    inside = F.regexp_replace(F.url_decode(F.regexp_replace("_metadata.file_path", "\\+", "%2B")), "^.*?" + root.rstrip("/").split("/")[-1] + "/", "")
    return d.select(inside.alias("path"), F.regexp_replace("value", "\\A\ufeff", "").alias("text"))


# Names that no listing shows.
HIDDEN = (".git", "node_modules", ".obsidian")


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """(path, is_folder, size) of what is right below a folder, HIDDEN names left out; files: (path, size)."""
    head = f"{folder.strip('/')}/" if folder.strip("/") else ""
    f = files.where(F.col("path").startswith(head)).withColumn("rest", F.substring(F.col("path"), F.lit(len(head) + 1), F.length("path")))
    name = F.substring_index("rest", "/", 1)
    d = f.where(~name.isin(*HIDDEN)).groupBy(F.concat(F.lit(head), name).alias("path"), F.col("rest").contains("/").alias("is_folder")).agg(F.sum("size").alias("size"))
    return d.select("path", "is_folder", F.when(~F.col("is_folder"), F.col("size")).alias("size"))


# How the closing note of a search answer begins.
CLOSING = ("Это фрагменты", "Дальше:", "показаны первые", "Нигде не встречается", "Точное совпадение", "По запросу", "Индекса нет", "Ничего не найдено")


def parse_answers(answers: DataFrame, key: str = "key", text: str = "answer") -> DataFrame:
    """(key, place, path, chain, more, frag) of the blocks of search answers, one answer for each key.

    A block begins at a line after a blank one (or the first) whose bold text is a path; the lines up to the
    next are its fragment. A closing note at the end of the last fragment is left out. Lines are numbered, and
    a running count of the beginnings tells the block.
    """
    lines = answers.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("at", "line"))
    order = Window.partitionBy("key").orderBy("at")
    head = r"^\*\*(.+?)\*\*(.*)$"
    name, rest = F.trim(F.regexp_extract("line", head, 1)), F.regexp_extract("line", head, 2)
    begins = (F.trim(F.lag("line", 1, "").over(order)) == "") & (F.lower(name).endswith(".md") | name.contains("/"))
    numbered = lines.withColumn("begins", begins).withColumn("place", F.sum(F.col("begins").cast("long")).over(order) - 1).where("place >= 0")
    more, chain = F.regexp_extract(rest, r"\(ещё (\d+)", 1), F.trim(F.regexp_extract(rest, r"›\s*([^(]+)", 1))
    first = F.struct(name.alias("path"), chain.alias("chain"), F.coalesce(F.nullif(more, F.lit("")).cast("int"), F.lit(0)).alias("more"))
    blocks = numbered.groupBy("key", "place").agg(F.max(F.when(F.col("begins"), first)).alias("x"), F.array_sort(F.collect_list(F.when(~F.col("begins"), F.struct("at", "line")))).alias("l"))
    edges = lambda c: F.regexp_replace(c, r"\A\s+|\s+\z", "")
    whole = edges(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    paras = F.split(whole, "\n{2,}")
    n, last = F.size(paras), F.col("place") == F.max("place").over(Window.partitionBy("key"))
    note = last & (n > 1) & F.element_at(paras, -1).rlike(r"(?iu)\A\s*(" + "|".join(CLOSING) + ")")
    frag = F.when(note, edges(F.array_join(F.slice(paras, F.lit(1), F.greatest(n - 1, F.lit(1))), "\n\n"))).otherwise(whole)
    return blocks.select("key", "place", "x.path", "x.chain", "x.more", frag.alias("frag"))


def snapshot(notes: DataFrame, path: str) -> None:
    """A copy for later use, replaced as a whole."""
    notes.write.mode("overwrite").parquet(path)
