"""Queries: documents, change feed, versions, communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import relations, sqlparts as S
from corpusloom.functions import analyze as A
from corpusloom.functions import docs as D
from corpusloom.operators import communities as C
from corpusloom.operators import modularity as Q
from corpusloom.operators import model as M
from corpusloom.operators import versions as H
from corpusloom.sources import bindings as B
from corpusloom.storage import shared_root
from corpusloom.streaming import feed

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def sections(spark, sf_dir):
    """Turns of a conversation as sections of one text: where each begins, in characters."""
    from pyspark.sql.window import Window

    c = B.table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit("## "), "role", F.lit("\n"))
    size = F.length(head) + F.length("text") + 1
    return c.select("conv_id", "turn", F.length("text").cast("long").alias("n"), F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long").alias("start"))


ORACLES["sections"] = "SELECT conv_id, turn, length(text)::BIGINT AS n, coalesce(sum(length(role) + 4 + length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations"


@query
def outlines(spark, sf_dir):
    """Conversations as notes: a turn is a section, of the first level for users, the second for assistants, else the third."""
    c = B.table(spark, sf_dir, "conversations")
    marks = F.when(F.col("role") == "user", "# ").when(F.col("role") == "assistant", "## ").otherwise("### ")
    turn = F.concat(marks, F.col("turn").cast("string"), F.lit("\n"), F.regexp_replace("text", "\n", " "))
    n = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    return D.outlines(n, "conv_id")


ORACLES["outlines"] = """WITH c AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2 ELSE 3 END AS level, length(text) AS n FROM conversations),
h AS (SELECT *, level + 1 + length(turn::VARCHAR) AS w FROM c), p AS (SELECT *, (sum(w + n + 2) OVER (PARTITION BY conv_id ORDER BY turn) - (w + n + 2))::BIGINT AS "at", (sum(w + n + 2) OVER (PARTITION BY conv_id) - 1)::BIGINT AS size FROM h)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, level::INTEGER AS level, turn::VARCHAR AS title, "at", "at" + w AS head, coalesce((SELECT min(x."at") FROM p x WHERE x.conv_id = p.conv_id AND x.turn > p.turn AND x.level <= p.level) - 1, size)::BIGINT AS "end" FROM p"""


@query
def wikilinks(spark, sf_dir):
    """References of pages as links: an anchor's target, heading and text."""
    t = F.regexp_replace("html", '<a href="([^"#]*)(?:#([^"]*))?"[^>]*>([^<]*)</a>', "[[$1#$2|$3]]")
    p = B.table(spark, sf_dir, "pages").select("page_id", F.explode(D.wikilinks(t)).alias("l"))
    return p.groupBy("page_id", "l.target").agg(F.count("*").alias("n"), F.max("l.alias").alias("alias"))


_ANCHORS = "regexp_replace(html, '<a href=\"([^\"#]*)(?:#([^\"]*))?\"[^>]*>([^<]*)</a>', '[[\\1#\\2|\\3]]', 'g')"
_WIKI = "\\[\\[([^\\]|#]+)(?:#([^\\]|]*))?(?:\\|([^\\]]*))?\\]\\]"
ORACLES["wikilinks"] = f"SELECT page_id, trim(t) AS target, count(*) AS n, max(a) AS alias FROM (SELECT page_id, unnest(regexp_extract_all(x, '{_WIKI}', 1)) AS t, unnest(regexp_extract_all(x, '{_WIKI}', 3)) AS a FROM (SELECT page_id, {_ANCHORS} AS x FROM pages)) GROUP BY 1, 2"


@query
def section_patch(spark, sf_dir):
    """A line put under the heading of the assistant's turn, before and after what is there."""
    c = B.table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("# talk\n\n## "), "role", F.lit("\n"), "text", F.lit("\n\n## end\n"))
    before = D.mapped(lambda t, h: D.patch(t, h, "- noted", "prepend"), "string")
    after = D.mapped(lambda t, h: D.patch(t, h, "- noted", "append"), "string")
    return c.select("conv_id", "turn", F.sha1(before(text, F.col("role")).cast("binary")).alias("prepended"), F.sha1(after(text, F.col("role")).cast("binary")).alias("appended"))


ORACLES["section_patch"] = """SELECT conv_id, turn, sha1('# talk' || chr(10) || chr(10) || '## ' || role || chr(10) || '- noted' || chr(10) || chr(10) || text || chr(10) || chr(10) || '## end' || chr(10)) AS prepended,
sha1('# talk' || chr(10) || chr(10) || '## ' || role || chr(10) || text || chr(10) || chr(10) || '- noted' || chr(10) || chr(10) || '## end' || chr(10)) AS appended FROM conversations"""


@query
def frontmatter_roundtrip(spark, sf_dir):
    """Documents with front matter, read by field, and whether adding a tag leaves the body as it was."""
    d = B.table(spark, sf_dir, "documents")
    text = F.concat(F.lit("---\ntitle: Document "), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\ntags: [one, two]\n---\n"), "text")
    d = d.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), D.front(text).alias("front"))
    d = d.withColumn("tagged", D.mapped(lambda f: D.add_tag(f, "#Three"), "string")("front"))  # bodies stay where they are
    body, then = F.substring("text", F.length("front") + 1, F.length("text")), F.concat("tagged", F.substring("text", F.length("front") + 1, F.length("text")))
    again = F.substring(then, F.length(D.front(then)) + 1, F.length(then))
    tags = D.mapped(lambda f: ",".join(D.tags_of(D.parse_front(f)[0])), "string")(D.front(then))
    return d.select("doc_id", D.front_matter_field(F.col("front"), "lang").alias("lang"), D.front_matter_field(F.col("front"), "title").alias("title"), (again == body).alias("same_body"), tags.alias("tags"))


ORACLES["frontmatter_roundtrip"] = "SELECT doc_id, lang, 'Document ' || doc_id AS title, true AS same_body, 'one,two,three' AS tags FROM documents"


@query
def line_diff(spark, sf_dir):
    """Runs of lines between a document and itself without its second line."""
    d = B.table(spark, sf_dir, "documents")
    lines = F.split(F.regexp_replace("text", "[\\t\\n\\f\\r ]+\\z", ""), "\n")
    fewer = F.array_join(F.concat(F.slice(lines, 1, 1), F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1)))), "\n")
    n = D.mapped(lambda a, b: [sum(k == w for k, _ in D.diff(a, b)) for w in ("same", "del", "add")], "array<long>")
    return d.where(F.size(lines) > 3).select("doc_id", n(F.col("text"), fewer).alias("n")).select("doc_id", F.get("n", F.lit(1)).alias("n_deleted"), F.get("n", F.lit(2)).alias("n_added"))


ORACLES["line_diff"] = "SELECT doc_id, 1::BIGINT AS n_deleted, 0::BIGINT AS n_added FROM documents WHERE len(string_split(regexp_replace(text, '\\s+$', ''), chr(10))) > 3"


@query
def excerpts(spark, sf_dir):
    """What surrounds the first match of a query in every document that has one of its words."""
    terms = A.query_terms("worthless idiot clown")
    d = B.table(spark, sf_dir, "documents").where(F.lower("text").rlike("wort|idio|clow"))
    return d.select("doc_id", D.excerpt(F.col("text"), terms).alias("frag"))


ORACLES["excerpts"] = "SELECT doc_id, frag FROM " + S.excerpt("(SELECT doc_id, text AS t FROM documents WHERE regexp_matches(lower(text), 'wort|idio|clow'))", A.query_terms("worthless idiot clown"))


@query
def export_links(spark, sf_dir):
    """The notes of each class as a list of links."""
    n = B.notes(spark, sf_dir).where("status = 'rejected'")
    return n.groupBy("klass").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda x: F.concat(F.lit("- [["), x["title"], F.lit("]]"))), "\n").alias("text"))


ORACLES["export_links"] = f"WITH {B.NOTES_SQL} SELECT klass, string_agg('- [[' || title || ']]', chr(10) ORDER BY pos) AS text FROM notes WHERE status = 'rejected' GROUP BY 1"


@query
def formats(spark, sf_dir):
    """Sizes in words, names for files, slugs, hashes."""
    d = B.table(spark, sf_dir, "documents").withColumn("path", B.path_column())
    return d.select("doc_id", A.format_bytes(F.col("n_chars")).alias("size"), A.plural(F.col("n_chars"), "a", "b", "c").alias("form"), A.safe_file_name(F.col("path")).alias("file"), A.fold_hash(F.col("path")).alias("hash"))


_FOLD = "list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(path, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: xor(h * 33, c) & 4294967295::BIGINT)"
ORACLES["formats"] = f"""SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' Б' WHEN n_chars < 1048576 THEN replace(printf('%.1f', floor(n_chars * 10 / 1024.0::DOUBLE + 0.5) / 10), '.', ',') || ' КБ' ELSE replace(printf('%.1f', floor(n_chars * 10 / 1048576.0::DOUBLE + 0.5) / 10), '.', ',') || ' МБ' END AS size,
CASE WHEN n_chars % 10 = 1 AND n_chars % 100 <> 11 THEN 'a' WHEN n_chars % 10 BETWEEN 2 AND 4 AND NOT n_chars % 100 BETWEEN 12 AND 14 THEN 'b' ELSE 'c' END AS form, replace(path, '/', ' ') AS file, {_FOLD} AS hash
FROM (SELECT *, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents)"""


def _changes(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("user"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.col("event_type").isin("purchase", "signup").alias("touched"))


@query
def change_feed_debounce(spark, sf_dir):
    """Bursts of each user's changes, parted by six hours."""
    s = feed.debounce(_changes(spark, sf_dir), "6 hours", key="user")
    return s.select("user", "start", "end", "n", F.size("paths").cast("long").alias("n_paths"))


ORACLES["change_feed_debounce"] = """WITH e AS (SELECT user_id AS u, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
g AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT u AS "user", min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, 1::BIGINT AS n_paths FROM g GROUP BY u, g"""


@query
def reload_debounce(spark, sf_dir):
    """Reloads of each user: pushes of two kinds wait for one hour or for four."""
    return feed.reloads(_changes(spark, sf_dir), "1 hour", "4 hours", key="user")


ORACLES["reload_debounce"] = """WITH e AS (SELECT user_id AS u, ts, event_type IN ('purchase', 'signup') AS t, ts + CASE WHEN event_type IN ('purchase', 'signup') THEN INTERVAL 1 HOUR ELSE INTERVAL 4 HOUR END AS till FROM events),
f AS (SELECT *, CASE WHEN ts < max(till) OVER (PARTITION BY u ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM e),
g AS (SELECT *, sum(f) OVER (PARTITION BY u ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT u AS "user", min(ts) AS start, max(till) AS "end", count(*) AS n, bool_or(t) AS touched FROM g GROUP BY u, g"""


@query
def change_feed_stream(spark, sf_dir):
    """The debounced feed as a stream over a folder of events, to its end; sessions still open are held back."""
    import uuid

    # a file source reads folders; a pattern stands for one file or a folder of that name
    schema = B.table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")
    c = e.select("ts", F.col("user_id").alias("user"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"))
    bursts = feed.debounce(c, "6 hours", key="user").select("user", "start", "end", "n")
    return feed.run_to_table(bursts, f"{shared_root(spark)}/feed-{uuid.uuid4().hex}")


@query
def write_queue_replay(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    q = e.select(F.col("event_id").alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("value") > 150, "network").otherwise("write").alias("kind"), (F.col("event_type") != "error").alias("ok"))
    return feed.replay(q)


@query
def write_queues_replay(spark, sf_dir):
    """A queue for each user: a network error stops its own only."""
    e = B.table(spark, sf_dir, "events")
    q = e.select(F.col("event_id").alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("value") > 150, "network").otherwise("write").alias("kind"), (F.col("event_type") != "error").alias("ok"))
    return feed.replay(q, queue_of="path")


@query
def write_queue_stream(spark, sf_dir):
    """The same queues as a stream of files whose rows come in no order, each item run once in its turn."""
    import uuid

    from pyspark.sql.window import Window

    e = B.table(spark, sf_dir, "events")
    q = e.select(F.col("event_id").alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), F.when(F.col("value") > 150, "network").otherwise("write").alias("kind"), (F.col("event_type") != "error").alias("ok"))
    q = q.withColumn("seq", F.row_number().over(Window.partitionBy("path").orderBy("id")).cast("long"))
    root = f"{shared_root(spark)}/queues-{uuid.uuid4().hex}"
    q.withColumn("queue", F.col("path")).repartition(F.xxhash64("id")).write.parquet(f"{root}/items")
    items = spark.readStream.schema(spark.read.parquet(f"{root}/items").schema).parquet(f"{root}/items")
    with feed.rocks(spark):
        run = feed.replay_stream(items).writeStream.format("parquet").option("path", f"{root}/ran").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    return feed.outcomes(spark.read.parquet(f"{root}/ran"))


ORACLES["write_queue_replay"] = """WITH q AS (SELECT event_id AS id, 'user/' || user_id AS path, value > 150 AS net, event_type <> 'error' AS ok FROM events), s AS (SELECT min(id) FILTER (net) AS stop FROM q),
j AS (SELECT q.*, stop IS NULL OR id < stop AS b FROM q, s) SELECT path, count(*) FILTER (b AND ok) AS applied, count(*) FILTER (b AND NOT ok) AS dropped, count(*) FILTER (NOT b) AS waiting, max(id) FILTER (b AND ok) AS last_id FROM j GROUP BY 1"""
ORACLES["write_queues_replay"] = """WITH q AS (SELECT event_id AS id, 'user/' || user_id AS path, value > 150 AS net, event_type <> 'error' AS ok FROM events), s AS (SELECT path, min(id) AS stop FROM q WHERE net GROUP BY 1),
j AS (SELECT q.*, stop IS NULL OR id < stop AS b FROM q LEFT JOIN s ON q.path = s.path) SELECT path, count(*) FILTER (b AND ok) AS applied, count(*) FILTER (b AND NOT ok) AS dropped, count(*) FILTER (NOT b) AS waiting, max(id) FILTER (b AND ok) AS last_id FROM j GROUP BY 1"""
ORACLES["write_queue_stream"] = ORACLES["write_queues_replay"]


def _versions(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), "ts", F.col("props").alias("content"))


@query
def latest_version(spark, sf_dir):
    return H.latest(_versions(spark, sf_dir))


ORACLES["latest_version"] = "SELECT 'user/' || user_id AS path, event_id AS id, ts, props AS content FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1"


@query
def version_history(spark, sf_dir):
    return H.history(_versions(spark, sf_dir), 5).select("path", "id", F.col("place").cast("long").alias("place"))


ORACLES["version_history"] = "SELECT 'user/' || user_id AS path, event_id AS id, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5"


@query
def version_at(spark, sf_dir):
    """The versions of a path whose content has a digest that begins so."""
    v = _versions(spark, sf_dir)
    return v.where(F.substring(F.sha1(F.col("content").cast("binary")), 1, 1) == "a").select("path", "id")


ORACLES["version_at"] = "SELECT 'user/' || user_id AS path, event_id AS id FROM events WHERE left(sha1(props), 1) = 'a'"


@query
def conflict_check(spark, sf_dir):
    """Every write; an error's was based on the version two before it, others on the one before."""
    from pyspark.sql.window import Window

    v = B.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("path"), "event_type")
    w = Window.partitionBy("path").orderBy("id")
    base = F.when(F.col("event_type") == "error", F.lag("id", 2).over(w)).otherwise(F.lag("id").over(w))
    return H.conflicts(v.select("id", "path", base.alias("base_id")))


ORACLES["conflict_check"] = """WITH w AS (SELECT event_id AS id, 'user/' || user_id AS path, CASE WHEN event_type = 'error' THEN lag(event_id, 2) OVER p ELSE lag(event_id) OVER p END AS base_id FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id)),
k AS (SELECT *, max(id) OVER (PARTITION BY path ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_id FROM w) SELECT id, path, base_id, last_id FROM k WHERE last_id > base_id"""


def _component_links(spark, sf_dir):
    """Orders with their customer and the order before; a component for each customer."""
    l = C.weighted(B.links(spark, sf_dir).where("type in ('about', 'depends')"))
    owner = B.table(spark, sf_dir, "orders").select(F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("path"), F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("component"))
    ends = owner.unionByName(owner.select(F.col("component").alias("path"), "component").distinct())
    return l, ends


@query
def modularity_communities(spark, sf_dir):
    """Communities of the whole graph over links of all types, distributed."""
    return Q.communities(C.weighted(B.links(spark, sf_dir)))


@query
def louvain_clusters(spark, sf_dir):
    """Communities among each customer's orders, by greedy modularity."""
    l, ends = _component_links(spark, sf_dir)
    return C.modularity_clusters(l, ends)


def _doc_clusters(spark, sf_dir):
    sim = relations._similar(spark, sf_dir, 3).select(F.col("path").alias("src"), F.col("other").alias("dst"), F.col("score").alias("w"))
    return C.spread_labels(sim)


@query
def label_spreading(spark, sf_dir):
    """Clusters of similar documents, distributed."""
    return _doc_clusters(spark, sf_dir)


@query
def cluster_labels(spark, sf_dir):
    return C.labels(_doc_clusters(spark, sf_dir), relations.keywords_by_path(spark, sf_dir), B.notes(spark, sf_dir).select("path", "title"))


@query
def cluster_profile(spark, sf_dir):
    """In how many documents of each source each keyword is."""
    d = B.table(spark, sf_dir, "documents").select(B.path_column().alias("path"), F.col("source").alias("cluster"))
    return C.profiles(d, relations.keywords_by_path(spark, sf_dir))


ORACLES["cluster_profile"] = f"WITH {relations.KEYWORDS_SQL} SELECT source AS cluster, term, count(*) AS n FROM kw JOIN (SELECT source, lang || '/' || source || '/' || doc_id || '.md' AS path FROM documents) d ON d.path = kw.path GROUP BY 1, 2"


@query
def adopt_loose(spark, sf_dir):
    return C.adopt_loose(_doc_clusters(spark, sf_dir), relations.keywords_by_path(spark, sf_dir))


@query
def force_layout(spark, sf_dir):
    l, ends = _component_links(spark, sf_dir)
    return C.force_layout(l, ends)
