"""Queries: edits of notes as whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import docs as D
from corpusloom.functions import edits as E
from corpusloom.sources import bindings as B

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _writes(spark, sf_dir):
    """Turns as writes to the document of the conversation's number: create, write, append by role; system asks for what there is not."""
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))
    d = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("now"))
    op = F.when(F.col("role") == "user", "create").when(F.col("role") == "assistant", "append").otherwise("write")
    return c.join(d, "conv_id", "left").withColumn("op", op)


@query
def guarded_writes(spark, sf_dir):
    w = E.guarded(F.col("op"), F.col("now"), F.col("content"))
    return _writes(spark, sf_dir).withColumn("w", w).select("conv_id", "turn", "op", F.md5(F.encode("w.content", "UTF-8")).alias("digest"), "w.error")


ORACLES["guarded_writes"] = r"""WITH w AS (SELECT c.conv_id, c.turn, c.text AS content, d.text AS now, CASE role WHEN 'user' THEN 'create' WHEN 'assistant' THEN 'append' ELSE 'write' END AS op FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id),
e AS (SELECT *, CASE WHEN op = 'create' AND now IS NOT NULL THEN 'exists' WHEN op = 'write' AND now IS NULL THEN 'missing' END AS error FROM w)
SELECT conv_id, turn, op, md5(CASE WHEN error IS NOT NULL THEN now WHEN op = 'append' THEN (CASE WHEN length(coalesce(now, '')) > 0 THEN regexp_replace(now, '[\s\x0B]+$', '') || chr(10) || chr(10) ELSE '' END) || regexp_replace(content, '[\s\x0B]+$', '') || chr(10) ELSE content END) AS digest, error FROM e"""


@query
def new_claims(spark, sf_dir):
    """A claim of each order's priority and status, about its customer; short ones are refused."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("about"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at"))
    return o.withColumn("c", E.claim(F.col("text"), F.col("about"), F.col("at"))).select("o_orderkey", "c.path", "c.content", "c.error")


ORACLES["new_claims"] = """WITH o AS (SELECT o_orderkey, trim(o_orderpriority || ' ' || o_orderstatus) AS t, 'Customer ' || o_custkey AS about, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders), e AS (SELECT *, CASE WHEN length(t) < 12 THEN 'too short' END AS error FROM o)
SELECT o_orderkey, CASE WHEN error IS NULL THEN 'осколки/' || d || ' ' || t || '.md' END AS path, CASE WHEN error IS NULL THEN '---' || chr(10) || 'класс: утверждение' || chr(10) || 'тип: факт' || chr(10) || 'когда: ' || d || chr(10) || 'статус: актуально' || chr(10) || 'о: ["[[' || about || ']]"]' || chr(10) || 'источник: "приложение ' || d || '"' || chr(10) || 'уверенность: высокая' || chr(10) || '---' || chr(10) || chr(10) || t || chr(10) END AS content, error FROM e"""


@query
def rename_tag(spark, sf_dir):
    """A tag merged into another over all its holders."""
    n = B.notes(spark, sf_dir).where(F.array_contains("tags", "quality/bad"))
    return n.select("path", F.array_join(E.renamed_tag(F.col("tags"), "quality/bad", "toxic"), ",").alias("tags"))


ORACLES["rename_tag"] = f"WITH {B.NOTES_SQL}, l AS (SELECT path, list_filter(tags, lambda t: t <> 'quality/bad') AS t FROM notes WHERE list_contains(tags, 'quality/bad')) SELECT path, array_to_string(CASE WHEN list_contains(t, 'toxic') THEN t ELSE list_append(t, 'toxic') END, ',') AS tags FROM l"


@query
def same_body(spark, sf_dir):
    """Versions of a path that differ from the one before by white space at most."""
    from pyspark.sql.window import Window

    e = B.table(spark, sf_dir, "events").select("event_id", "user_id", "props")
    before = F.lag("props").over(Window.partitionBy("user_id").orderBy("event_id"))
    return e.withColumn("before", before).where(E.same_body(F.col("props"), F.col("before"))).select("event_id")


ORACLES["same_body"] = r"WITH e AS (SELECT event_id, props, lag(props) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT event_id FROM e WHERE regexp_replace(props, '\s', '', 'g') = regexp_replace(b, '\s', '', 'g')"


@query
def attachments(spark, sf_dir):
    """Pages sent as base64 with a head, stored, and how long their links live."""
    p = B.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("data:text/html;base64,"), F.base64(F.encode("html", "UTF-8"))).alias("sent"))
    return p.select("page_id", F.md5(E.upload(F.col("sent"))).alias("digest"), E.link_hours(F.col("page_id").cast("int")).cast("long").alias("hours"))


ORACLES["attachments"] = "SELECT page_id, md5(nullif(html, '')) AS digest, CASE WHEN page_id = 0 THEN 24 ELSE least(greatest(page_id, 1), 168) END::BIGINT AS hours FROM pages"


@query
def captured_thoughts(spark, sf_dir):
    """First turns as thoughts: by conversation into a note without, with, or lacking the heading."""
    put = D.mapped(lambda now, line: list(D.capture(now or None, "Thoughts", f"- {line}", "# Day\n")), "array<string>")
    c = B.table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", "role", F.regexp_replace("text", "\\s+", " ").alias("line"))
    now = F.when(F.length("line") < 60, "").when(F.length("line") < 120, "# Day\n\n## Thoughts\n\n- one\n\n## Links\n").otherwise("# Day\n\nNothing yet.\n")
    return c.withColumn("w", put(now, F.col("line"))).select("conv_id", F.col("w")[0].alias("content"), F.col("w")[1].alias("way"))


ORACLES["captured_thoughts"] = r"""WITH c AS (SELECT conv_id, regexp_replace(text, '[\s\x0B]+', ' ', 'g') AS l FROM conversations WHERE turn = 0), n AS (SELECT conv_id, l, rtrim(l) AS e FROM c)
SELECT conv_id, CASE WHEN length(l) < 60 THEN '# Day' || chr(10) || chr(10) || '## Thoughts' || chr(10) || chr(10) || '- ' || e || chr(10)
WHEN length(l) < 120 THEN '# Day' || chr(10) || chr(10) || '## Thoughts' || chr(10) || chr(10) || '- one' || chr(10) || '- ' || e || chr(10) || chr(10) || '## Links' || chr(10)
ELSE '# Day' || chr(10) || chr(10) || 'Nothing yet.' || chr(10) || chr(10) || '## Thoughts' || chr(10) || chr(10) || '- ' || e || chr(10) END AS content,
CASE WHEN length(l) < 60 THEN 'create' WHEN length(l) < 120 THEN 'patch' ELSE 'append' END AS way FROM n"""


@query
def helper_answers(spark, sf_dir):
    """Tags and links read from a helper's answer about each note."""
    n = B.notes(spark, sf_dir)
    a = F.concat(F.lit("ТЕГИ: #"), F.array_join("tags", ", #"), F.lit("\nсвязи: "), F.when(F.size("tags") == 0, "нет").otherwise(F.col("title")))
    return n.select("path", F.array_join(E.answer_list(a, "ТЕГИ"), ",").alias("tags"), F.array_join(E.answer_list(a, "СВЯЗИ"), ",").alias("links"))


ORACLES["helper_answers"] = f"WITH {B.NOTES_SQL} SELECT path, array_to_string(tags, ',') AS tags, CASE WHEN len(tags) = 0 THEN '' ELSE title END AS links FROM notes"


@query
def filled_templates(spark, sf_dir):
    """A new note of a template for each customer, with a first text."""
    c = B.table(spark, sf_dir, "customer")
    t = E.template(F.lit("# {{title}}\n\nsince {{date}}\n\n## Links\n"), F.col("c_name"), F.lit("2024-01-01"))
    return c.select("c_custkey", D.mapped(D.with_intro, "string")(t, F.col("c_mktsegment")).alias("content"))


ORACLES["filled_templates"] = "SELECT c_custkey, '# ' || c_name || chr(10) || chr(10) || 'since 2024-01-01' || chr(10) || chr(10) || c_mktsegment || chr(10) || chr(10) || '## Links' || chr(10) AS content FROM customer"
