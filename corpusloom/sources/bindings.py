"""The model's tables, built from the standard test tables.

notes    path, base, title, type, klass, kind, status, tags, bytes, pos - from documents and labels
chunks   path, i, h, t - the lines of the documents
links    src, dst, type - from the star schema; node ids are 'customer/1' and the like
nodes    path, title, type, klass, kind, at, status, pos - the ends of these links
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import analyze as A

#: Links of lines that one task tells apart.
LINK_PART = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_column():
    return F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a claim if its label says good quality, evidence if bad, derived if it has no label."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    l = table(spark, sf_dir, "labels")
    d = d.join(l, "doc_id", "left")
    tag = lambda c, name: F.when(c, F.lit(name))
    tags = F.filter(F.array(tag(F.col("quality") == 1, "quality/good"), tag(F.col("quality") == 0, "quality/bad"), tag(F.col("toxic") == 1, "toxic"), tag(F.col("quality").isNotNull(), F.concat(F.lit("lang/"), "lang"))), lambda x: x.isNotNull())
    return d.select(
        F.col("doc_id").alias("pos"), path_column().alias("path"), F.col("doc_id").cast("string").alias("base"), F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("lang").alias("type"),
        F.when(F.col("quality") == 1, "claim").when(F.col("quality") == 0, "evidence").otherwise("derived").alias("klass"),
        F.col("source").alias("kind"), F.when(F.col("toxic") == 1, "rejected").when(F.col("toxic") == 0, "active").otherwise("").alias("status"),
        tags.alias("tags"), F.col("n_chars").alias("bytes"), "lang", "source",
    )


NOTES_SQL = """notes AS (
  SELECT d.doc_id AS pos, d.lang || '/' || d.source || '/' || d.doc_id || '.md' AS path, d.doc_id::VARCHAR AS base, 'Document ' || d.doc_id AS title, d.lang AS type,
    CASE WHEN quality = 1 THEN 'claim' WHEN quality = 0 THEN 'evidence' ELSE 'derived' END AS klass, d.source AS kind,
    CASE WHEN toxic = 1 THEN 'rejected' WHEN toxic = 0 THEN 'active' ELSE '' END AS status,
    list_filter([CASE WHEN quality = 1 THEN 'quality/good' END, CASE WHEN quality = 0 THEN 'quality/bad' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NOT NULL THEN 'lang/' || d.lang END], lambda x: x IS NOT NULL) AS tags,
    d.n_chars AS bytes, d.lang, d.source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not blank; the heading chain is (lang, source)."""
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", path_column().alias("path"), F.array("lang", "source").alias("h"), F.posexplode(F.split("text", "\n")).alias("i", "t"))
    return lines.where(F.trim("t") != "").withColumn("i", F.col("i").cast("long"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed links: parts of, about, relates to, depends on (an order on the customer's one before)."""
    t = lambda n: table(spark, sf_dir, n)
    node = lambda kind, key: F.concat(F.lit(kind + "/"), F.col(key).cast("string"))
    link = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    orders = t("orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    chain = orders.select("o_orderkey", before.alias("previous")).where("previous is not null")
    # as many parts as keep what one task tells apart and counts in bounds
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), t("lineitem").count() // LINK_PART)
    has = t("lineitem").select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey").distinct()
    out = link(t("customer"), node("customer", "c_custkey"), node("nation", "c_nationkey"), "part_of")
    out = out.unionByName(link(t("nation"), node("nation", "n_nationkey"), node("region", "n_regionkey"), "part_of"))
    out = out.unionByName(link(t("supplier"), node("supplier", "s_suppkey"), node("nation", "s_nationkey"), "part_of"))
    out = out.unionByName(link(orders, node("order", "o_orderkey"), node("customer", "o_custkey"), "about"))
    out = out.unionByName(link(has, node("order", "l_orderkey"), node("part", "l_partkey"), "relates"))
    return out.unionByName(link(chain, node("order", "o_orderkey"), node("order", "previous"), "depends"))


LINKS_SQL = """links AS (
  SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst, 'part_of' AS type FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'part_of' FROM nation
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'part_of' FROM supplier
  UNION ALL SELECT 'order/' || o_orderkey, 'customer/' || o_custkey, 'about' FROM orders
  UNION ALL SELECT DISTINCT 'order/' || l_orderkey, 'part/' || l_partkey, 'relates' FROM lineitem
  UNION ALL SELECT 'order/' || o_orderkey, 'order/' || p, 'depends' FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p IS NOT NULL)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, as entities of their market segment."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("pos"), F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_name").alias("title"), F.col("c_custkey").cast("string").alias("base"), F.array(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("aliases"), F.col("c_mktsegment").alias("kind"))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, as claims of their priority; a finished one is dead."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "obsolete").otherwise("current")
    return o.select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"), status.alias("status"), F.col("o_orderpriority").alias("kind"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ends of the links: path, title, type, bytes (a stand-in for size), at (orders only)."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("timestamp_ntz")
    make = lambda df, kind, key, title, size, at=none: df.select(F.concat(F.lit(kind + "/"), F.col(key).cast("string")).alias("path"), title.alias("title"), F.lit(kind).alias("type"), size.cast("long").alias("bytes"), at.alias("at"))
    out = make(t("customer"), "customer", "c_custkey", F.col("c_name"), F.length("c_name"))
    out = out.unionByName(make(t("nation"), "nation", "n_nationkey", F.col("n_name"), F.length("n_name")))
    out = out.unionByName(make(t("region"), "region", "r_regionkey", F.col("r_name"), F.length("r_name")))
    out = out.unionByName(make(t("supplier"), "supplier", "s_suppkey", F.col("s_name"), F.length("s_name")))
    out = out.unionByName(make(t("part"), "part", "p_partkey", F.col("p_name"), F.length("p_name")))
    return out.unionByName(make(t("orders"), "order", "o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")), F.floor("o_totalprice"), F.col("o_orderdate").cast("timestamp_ntz")))


NODES_SQL = """nodes AS (
  SELECT 'customer/' || c_custkey AS path, c_name AS title, 'customer' AS type, length(c_name)::BIGINT AS bytes, NULL::TIMESTAMP AS at FROM customer
  UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'nation', length(n_name), NULL FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, r_name, 'region', length(r_name), NULL FROM region
  UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'supplier', length(s_name), NULL FROM supplier
  UNION ALL SELECT 'part/' || p_partkey, p_name, 'part', length(p_name), NULL FROM part
  UNION ALL SELECT 'order/' || o_orderkey, 'Order ' || o_orderkey, 'order', floor(o_totalprice)::BIGINT, o_orderdate::TIMESTAMP FROM orders)"""
