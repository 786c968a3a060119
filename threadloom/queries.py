"""Registered queries: each operator bound to the test tables, with DuckDB SQL that gives the same rows.

Sessions are conversations (conv_id), entries their turns; events are captures (user_id is the session, event_id
the order of arrival, ts the capture time); nations are projects and regions organizations. Every query runs over
its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import digests, globs, references, text
from .functions.redaction import redacted
from .functions.shell import tool_access
from .operators import activity, chunks, claims, evidence, listing, store
from .plans import intervals, publish, queues, sync
from .sources import sessions, transcripts
from .sources.dialects import DIALECTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TERMS = "ver heit then aux"
NOW = 1_735_689_600_000
ROOTS = [("en", "/en"), ("fr", "/fr"), ("de", "/de"), ("en-6", "/en/6"), ("en", "/en/685"), ("es", "/es")]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as entries."""
    c = _t(spark, sf, "conversations")
    ids = F.concat(F.col("conv_id"), F.lit(":"), F.col("turn")).alias("id")
    return c.select("conv_id", F.col("turn").cast("int").alias("position"), ids, F.col("role").alias("kind"), "text", F.concat(F.lit("turn:"), "turn").alias("sourceRef"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("m"), F.length("text") % 3)).alias("model"), F.lit(None).cast("string").alias("effort"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as captures: session, order, milliseconds."""
    e = _t(spark, sf, "events")
    return e.select("event_id", "user_id", "event_type", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


def _line(**fields) -> F.Column:
    """A record of a transcript as JSON."""
    return F.to_json(F.struct(*[(v if isinstance(v, F.Column) else F.lit(v)).alias(k) for k, v in fields.items()])).alias("text")


def _answer(text) -> F.Column:
    block = F.struct(F.lit("output_text").alias("type"), text.cast("string").alias("text"))
    return _line(type="response_item", payload=F.struct(F.lit("message").alias("type"), F.lit("assistant").alias("role"), F.array(block).alias("content")))


def _begin(events: DataFrame, forked) -> DataFrame:
    """The first record of each user's transcript."""
    meta = F.struct(F.concat(F.lit("u"), "user_id").alias("id"), F.lit("codex_cli").alias("originator"), forked.cast("string").alias("forked_from_id"))
    return events.select("user_id").distinct().select("user_id", F.lit(1).alias("line"), _line(type="session_meta", payload=meta))


def _imported(spark: SparkSession, rows: DataFrame, key: str, dialect: str) -> sessions.Imported:
    """Rows (key, line, text) as files of a dialect, imported."""
    files = rows.select(F.concat(F.lit("/t/"), key, F.lit(".jsonl")).alias("file"), "line", "text")
    parsed, malformed = transcripts.records(files)
    found = sessions.assemble(DIALECTS[dialect](parsed), dialect, "0000", 1.0)
    return sessions.Imported(found.sessions, found.entries, found.rejected.unionByName(malformed))


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_TERMS_SQL = ", ".join(f"'{t}'" for t in text.terms_of(TERMS))
_SCORE_SQL = " + ".join(f"contains(lower(text), '{t}')::INT" for t in text.terms_of(TERMS))
_ENTRIES_SQL = "SELECT conv_id, turn AS position, conv_id || ':' || turn AS id, role AS kind, text, CASE WHEN turn % 2 = 1 THEN 'm' || (length(text) % 3) END AS model FROM conversations"
_EVENTS_SQL = "SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ms FROM events"


@query("term_search", f"SELECT doc_id, ({_SCORE_SQL})::INT AS score FROM documents WHERE ({_SCORE_SQL}) > 0")
def term_search(spark, sf):
    scored = _t(spark, sf, "documents").select("doc_id", text.score(F.col("text"), text.terms_of(TERMS)).cast("int").alias("score"))
    return scored.where("score > 0")


@query("query_terms", rf"""
    WITH c AS (SELECT row_number() OVER () AS rn, conv_id, turn, regexp_extract_all(lower(text), '{text.TERM}') AS found FROM conversations),
    placed AS (SELECT rn, unnest(found) AS term, unnest(range(len(found))) AS place FROM c),
    ranked AS (SELECT rn, term, row_number() OVER (PARTITION BY rn ORDER BY min(place)) AS rank FROM placed GROUP BY rn, term),
    joined AS (SELECT rn, array_to_string(list_sort(list(term)), ' ') AS terms FROM ranked WHERE rank <= {text.MAX_TERMS} GROUP BY rn)
    SELECT conv_id, turn, CASE WHEN found IS NOT NULL THEN coalesce(terms, '') END AS terms FROM c LEFT JOIN joined USING (rn)""")
def query_terms(spark, sf):
    """Every turn, with its first ``MAX_TERMS`` distinct terms in order of appearance."""
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.terms(F.col("text"))), " ").alias("terms"))


@query("chunk_rank_topk", f"SELECT conv_id, position::INT AS position, score::INT AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, position) AS rank FROM (SELECT *, ({_SCORE_SQL}) AS score FROM ({_ENTRIES_SQL})) WHERE score > 0) WHERE rank <= 3")
def chunk_rank_topk(spark, sf):
    return chunks.rank(_entries(spark, sf), TERMS, "conv_id").where("rank <= 3").select("conv_id", "position", "score", "rank")


@query("search_page", f"""
    WITH s AS (SELECT conv_id AS id, conv_id AS seq, min_by(text, turn) AS title FROM conversations GROUP BY conv_id),
    h AS (SELECT DISTINCT conv_id FROM conversations WHERE ({_SCORE_SQL}) > 0)
    SELECT id, title FROM s LEFT JOIN h ON h.conv_id = s.id WHERE h.conv_id IS NOT NULL OR contains(lower(title), '{TERMS}') ORDER BY seq DESC LIMIT 21""")
def search_page(spark, sf):
    c = _t(spark, sf, "conversations")
    sessions = c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("title")).withColumn("seq", F.col("id")).withColumn("tags", F.array().cast("array<string>"))
    return listing.search(sessions, c.select(F.col("conv_id").alias("id"), "text"), TERMS, 20).select("id", "title")


@query("page_cursor", "SELECT o_orderkey AS seq, o_orderstatus AS status FROM orders WHERE o_orderkey < 900 AND o_orderstatus = 'F' ORDER BY seq DESC LIMIT 101")
def page_cursor(spark, sf):
    orders = _t(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return listing.page(orders, 100, 900)


@query("model_counts", f"""
    SELECT conv_id, string_agg(model || '=' || n, ',' ORDER BY first) AS models FROM (SELECT conv_id, model, count(*) AS n, min(position) AS first FROM ({_ENTRIES_SQL}) WHERE model IS NOT NULL GROUP BY ALL) GROUP BY conv_id""")
def model_counts(spark, sf):
    counted = listing.model_counts(_entries(spark, sf), "conv_id")
    return counted.select("conv_id", F.array_join(F.transform("models", lambda m: F.concat(m["model"], F.lit("="), m["entries"])), ",").alias("models"))


@query("model_filter", f"SELECT DISTINCT conv_id FROM ({_ENTRIES_SQL}) WHERE model = 'm1'")
def model_filter(spark, sf):
    sessions = listing.model_counts(_entries(spark, sf), "conv_id")
    return listing.where(sessions, listing.Filter(model="m1", parts="include")).select("conv_id")


@query("role_counts_per_session", "SELECT conv_id, role, count(*) AS entries FROM conversations GROUP BY ALL")
def role_counts(spark, sf):
    counted = listing.model_counts(_entries(spark, sf).withColumn("model", F.col("kind")), "conv_id")
    return counted.select("conv_id", F.explode("models").alias("m")).select("conv_id", F.col("m.model").alias("role"), F.col("m.entries").cast("long").alias("entries"))


@query("session_digest", r"""
    WITH e AS (SELECT * FROM conversations),
    a AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user' AND trim(text) <> '') AS prompts, count(*) FILTER (WHERE role = 'assistant') AS replies,
                 min_by(text, turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS f, max_by(text, turn) FILTER (WHERE role = 'assistant' AND trim(text) <> '') AS l FROM e GROUP BY conv_id),
    c AS (SELECT *, trim(regexp_replace(f, '\s+', ' ', 'g')) AS ff, trim(regexp_replace(l, '\s+', ' ', 'g')) AS ll FROM a)
    SELECT conv_id, prompts, replies, CASE WHEN length(ff) > 400 THEN left(ff, 400) || '…' ELSE ff END AS first, CASE WHEN replies > 1 THEN CASE WHEN length(ll) > 400 THEN left(ll, 400) || '…' ELSE ll END END AS last FROM c""")
def session_digest(spark, sf):
    d = listing.session_digest(_entries(spark, sf), "conv_id")
    return d.select("conv_id", F.col("promptCount").alias("prompts"), F.col("assistantCount").alias("replies"), F.get("replies", F.lit(0)).alias("first"), F.get("replies", F.lit(1)).alias("last"))


@query("first_last_turn", "SELECT conv_id, min_by(text, turn) AS first, max_by(text, turn) AS last FROM conversations GROUP BY conv_id")
def first_last_turn(spark, sf):
    turns = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    last = store.latest(turns, "conv_id", "turn").select("conv_id", F.col("text").alias("last"))
    first = store.latest(turns.withColumn("turn", -F.col("turn")), "conv_id", "turn").select("conv_id", F.col("text").alias("first"))
    return first.join(last, "conv_id")


@query("clip_text", r"SELECT doc_id, CASE WHEN length(t) > 80 THEN left(t, 80) || '…' ELSE t END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def clip_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", text.clip(F.col("text"), 80).alias("clipped"))


@query("locf_last_event", "SELECT event_id, last_value(CASE WHEN event_type IN ('click', 'purchase') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def locf_last_event(spark, sf):
    """Events as transcripts: some set the model, and every event is an answer that carries the last model set."""
    e = _events(spark, sf).withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("ms", "event_id")) * 2)
    sets = e.where(F.col("event_type").isin("click", "purchase")).select("user_id", F.col("line").alias("line"), _line(type="turn_context", payload=F.struct(F.col("event_type").alias("model"))))
    answers = e.select("user_id", (F.col("line") + 1).alias("line"), _answer(F.col("event_id")))
    found = _imported(spark, _begin(e, F.lit(None)).unionByName(sets).unionByName(answers), "user_id", "codex").entries
    return found.select(F.col("text").cast("long").alias("event_id"), F.col("model").alias("carried"))


@query("gate_until", "SELECT event_id FROM (SELECT event_id, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS open FROM events) WHERE open = 1")
def gate_until(spark, sf):
    """Events as transcripts of forked sessions: what comes before the first turn of their own is a copied history."""
    e = _events(spark, sf).withColumn("line", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) * 2)
    own = e.where(F.col("event_type") == "purchase").select("user_id", "line", _line(type="turn_context", payload=F.struct(F.lit("z").alias("turn_id"))))
    answers = e.select("user_id", (F.col("line") + 1).alias("line"), _answer(F.col("event_id")))
    found = _imported(spark, _begin(e, F.lit("parent")).unionByName(own).unionByName(answers), "user_id", "codex").entries
    return found.select(F.col("text").cast("long").alias("event_id"))


_REV_SQL = f"SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id)::INT AS revision, sha256(event_id::VARCHAR) AS digest, ms FROM ({_EVENTS_SQL})"
_CUR_SQL = f"SELECT id, max(revision) AS current FROM ({_REV_SQL}) GROUP BY id"
_OUT_SQL = f"SELECT id, revision FROM ({_REV_SQL}) WHERE revision % 7 = 3"


def _revisions(spark, sf):
    e = _events(spark, sf)
    return e.select(F.col("user_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("revision"), F.sha2(F.col("event_id").cast("string"), 256).alias("digest"), "ms")


def _current(spark, sf):
    return _revisions(spark, sf).groupBy("id").agg(F.max("revision").alias("revision"))


@query("latest_revision", f"SELECT id, max(revision) AS revision, max_by(digest, revision) AS digest FROM ({_REV_SQL}) GROUP BY id")
def latest_revision(spark, sf):
    return store.latest(_revisions(spark, sf)).select("id", "revision", "digest")


@query("superseded_counts", f"SELECT count(*) FILTER (WHERE o.id IS NULL) AS compactable, count(*) FILTER (WHERE o.id IS NOT NULL) AS held FROM ({_REV_SQL}) r JOIN ({_CUR_SQL}) c USING (id) LEFT JOIN ({_OUT_SQL}) o ON o.id = r.id AND o.revision = r.revision WHERE r.revision < c.current")
def superseded_counts(spark, sf):
    revisions = _revisions(spark, sf)
    return store.superseded(revisions, _current(spark, sf), revisions.where("revision % 7 = 3"))


@query("compaction", f"SELECT r.id, r.revision FROM ({_REV_SQL}) r JOIN ({_CUR_SQL}) c USING (id) WHERE r.revision = c.current OR (r.id, r.revision) IN (SELECT (id, revision) FROM ({_OUT_SQL}))")
def compaction(spark, sf):
    revisions = _revisions(spark, sf)
    return store.compact(revisions, _current(spark, sf), revisions.where("revision % 7 = 3")).select("id", "revision")


@query("compactable_anti", "SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_id = o_orderkey)")
def compactable_anti(spark, sf):
    older = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"))
    queued = _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.lit(1).alias("revision"))
    kept = store.compact(older, older.select("id", F.lit(2).alias("revision")), queued)
    return older.join(kept.select("id"), "id", "left_anti").select("id")


@query("retention_expired", f"SELECT event_id AS id FROM ({_EVENTS_SQL}) WHERE user_id % 5 <> 0 AND ms < {NOW} - 360 * 86400000::BIGINT")
def retention_expired(spark, sf):
    e = _events(spark, sf).select(F.col("event_id").alias("id"), F.when(F.col("user_id") % 5 == 0, F.lit("whole")).alias("partOf"), F.col("ms").alias("capturedAt"))
    return store.expired(e, NOW, 360).select("id")


@query("head_lookup", "SELECT d.doc_id AS id, sha256(coalesce(d.text, '')) AS digest, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS revision, l.doc_id IS NULL AS deleted FROM documents d LEFT JOIN labels l USING (doc_id)")
def head_lookup(spark, sf):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    labels = _t(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    sessions = docs.join(labels, "id", "left_semi").select("id", "digest", F.col("digest").alias("storedDigest"), F.lit(1).alias("revision"))
    return store.head(docs, sessions, docs.join(labels, "id", "left_anti")).select("id", "digest", "revision", "deleted")


_TAGS_SQL = """
    d AS (SELECT doc_id AS id, [lang, source] || CASE WHEN doc_id % 11 = 0 THEN ['run:test'] ELSE [] END AS base, doc_id AS seq FROM documents),
    x AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN ['good'] ELSE [] END || CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END AS added, CASE WHEN toxic = 1 THEN ['en'] ELSE [] END AS removed FROM labels),
    o AS (SELECT d.id, d.seq, list_filter(list_distinct(base || coalesce(added, [])), lambda t: NOT list_contains(coalesce(removed, []), t)) AS tags, coalesce(removed, []) AS removed FROM d LEFT JOIN x USING (id))"""


def _overlaid(spark, sf, suggestions=None):
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), F.lit("now").alias("digest"), F.concat(F.array("lang", "source"), F.when(F.col("doc_id") % 11 == 0, F.array(F.lit("run:test"))).otherwise(F.array().cast("array<string>"))).alias("capturedTags"))
    labels = _t(spark, sf, "labels")
    edit = lambda when, tag, added, seq: labels.where(when).select(F.col("doc_id").alias("id"), F.lit(tag).alias("tag"), F.lit(added).alias("added"), F.lit(seq).alias("seq"))
    # The log has edits that later ones undo.
    log = edit("quality = 1", "good", False, 1).unionByName(edit("quality = 1", "good", True, 2)).unionByName(edit("toxic = 1", "toxic", True, 3)).unionByName(edit("toxic = 1", "en", False, 4))
    return listing.overlay(docs, log, suggestions)


@query("tag_overlay", f"WITH {_TAGS_SQL} SELECT id, array_to_string(list_sort(tags), ',') AS tags FROM o")
def tag_overlay(spark, sf):
    return _overlaid(spark, sf).select("id", F.array_join(F.array_sort("tags"), ",").alias("tags"))


@query("suggested_tags", f"""WITH {_TAGS_SQL}
    SELECT id, array_to_string(list_sort(CASE WHEN id % 3 = 0 THEN list_filter(['good', 'en', 'new'], lambda t: NOT list_contains(tags, t) AND NOT list_contains(removed, t)) ELSE [] END), ',') AS suggested FROM o""")
def suggested_tags(spark, sf):
    made = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, "now").otherwise("old").alias("digest"), F.array(*map(F.lit, ("good", "en", "new", "new"))).alias("tags"))
    return _overlaid(spark, sf, made).select("id", F.array_join(F.array_sort("suggestedTags"), ",").alias("suggested"))


@query("exempt_listing", f"WITH {_TAGS_SQL} SELECT id FROM o WHERE list_contains(tags, 'good') AND NOT list_contains(tags, 'run:test')")
def exempt_listing(spark, sf):
    return listing.where(_overlaid(spark, sf), listing.Filter(tag="good")).select("id")


@query("tag_usage", f"WITH {_TAGS_SQL}, u AS (SELECT unnest(tags) AS tag FROM o) SELECT tag, (SELECT count(*) FROM u WHERE u.tag = f.tag) AS sessions FROM (VALUES ('good'), ('toxic'), ('en'), ('none')) f(tag)")
def tag_usage(spark, sf):
    return listing.tag_usage(_overlaid(spark, sf), _rows(spark, [("good",), ("toxic",), ("en",), ("none",)], "tag string"))


@query("dedupe_last_wins", f"SELECT user_id, event_type, min(event_id) AS place, max_by(value, event_id) AS value FROM ({_EVENTS_SQL}) GROUP BY ALL")
def dedupe_last_wins(spark, sf):
    return store.last_wins(_events(spark, sf).select("user_id", "event_type", "event_id", "value"), "event_id", "user_id", "event_type")


@query("outbox_first_wins", f"WITH q AS (SELECT user_id AS id, min(event_id) AS revision FROM ({_EVENTS_SQL}) WHERE user_id % 2 = 0 GROUP BY 1) SELECT * FROM q UNION ALL SELECT user_id, min(event_id) FROM ({_EVENTS_SQL}) WHERE event_type = 'click' AND user_id NOT IN (SELECT id FROM q) GROUP BY 1")
def outbox_first_wins(spark, sf):
    e = _events(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("revision"), "event_type")
    queue = e.where("id % 2 = 0").groupBy("id").agg(F.min("revision").alias("revision"))
    return store.first_wins(queue, e.where("event_type = 'click'").select("id", "revision"), "id")


_ROOTS_SQL = "roots(project, root) AS (VALUES " + ", ".join(f"('{p}', '{r}')" for p, r in ROOTS) + ")"
_PATHS_SQL = r"paths AS (SELECT page_id, regexp_extract(url, '^[^/]*//[^/?#]*(/[^?#]*)', 1) AS path FROM pages)"


def _paths(spark, sf):
    return _t(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^[^/]*//[^/?#]*(/[^?#]*)", 1).alias("path"))


def _roots(spark):
    return _rows(spark, ROOTS, "projectId string, root string")


@query("longest_prefix_project", f"""WITH {_ROOTS_SQL}, {_PATHS_SQL},
    m AS (SELECT page_id, max_by(struct_pack(project := project, root := root), length(root)) AS o FROM paths JOIN roots ON rtrim(path, '/') = root OR starts_with(path, root || '/') GROUP BY page_id)
    SELECT page_id, path, o.project AS project, o.root AS root FROM paths LEFT JOIN m USING (page_id)""")
def longest_prefix_project(spark, sf):
    return evidence.to_project(_paths(spark, sf), _roots(spark)).select("page_id", "path", F.col("projectId").alias("project"), "root")


@query("container_roots", f"WITH {_ROOTS_SQL} SELECT DISTINCT a.root FROM roots a JOIN roots b ON b.project <> a.project AND starts_with(b.root, a.root || '/')")
def container_roots(spark, sf):
    return evidence.containers(_roots(spark))


@query("org_rollup", """
    SELECT c_custkey AS id, coalesce(CASE WHEN r_regionkey < 3 THEN r_name END, 'personal') AS organization, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS writes, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END)::BIGINT AS reads, 0::BIGINT AS "references"
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def org_rollup(spark, sf):
    orders = _t(spark, sf, "orders").join(_t(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = orders.groupBy(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("key"), F.when(F.col("o_orderstatus") == "F", "writes").otherwise("reads").alias("field")).agg(F.count(F.lit(1)).alias("n")).withColumn("anchor", F.lit("a"))
    organizations = _t(spark, sf, "nation").join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey < 3").select(F.col("n_nationkey").cast("string").alias("projectId"), F.col("r_name").alias("organization"))
    return evidence.by_organization(found, organizations, _rows(spark, [], "projectId string, repository string"), "id")


@query("evidenced_organizations", """
    SELECT c_custkey AS id, string_agg(DISTINCT r_name, ',' ORDER BY r_name) AS organizations FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_regionkey < 3 AND (c_custkey IN (SELECT o_custkey FROM orders) OR c_custkey % 4 = 0) GROUP BY 1""")
def evidenced_organizations(spark, sf):
    rolled = org_rollup(spark, sf)
    starts = _t(spark, sf, "customer").where("c_custkey % 4 = 0").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_regionkey < 3").select(F.col("c_custkey").alias("id"), F.col("r_name").alias("organization"))
    return evidence.evidenced(rolled, starts, "id").select("id", F.array_join("organizations", ",").alias("organizations"))


@query("project_tags", """
    WITH t AS (SELECT o_custkey AS id, l_returnflag || l_linestatus AS p, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL UNION ALL SELECT o_custkey, 'start', 1 FROM orders WHERE o_orderkey % 10 = 1),
    s AS (SELECT id, p, sum(n)::BIGINT AS n FROM t GROUP BY ALL)
    SELECT id, 'project:' || p AS tag, n, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, p) AS rank FROM s) WHERE rank <= 3""")
def project_tags(spark, sf):
    items = _t(spark, sf, "lineitem").join(_t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = items.groupBy(F.col("o_custkey").alias("id"), F.concat("l_returnflag", "l_linestatus").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("field", F.lit("writes"))
    starts = _t(spark, sf, "orders").where("o_orderkey % 10 = 1").select(F.col("o_custkey").alias("id"), F.lit("start").alias("projectId"))
    return evidence.project_tags(found, starts, "id", limit=3)


@query("asof_anchor", f"""
    SELECT id, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY position ROWS UNBOUNDED PRECEDING), first_value(k IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS anchor
    FROM (SELECT *, CASE WHEN (conv_id + position) % 3 = 1 THEN id END AS k FROM ({_ENTRIES_SQL}))""")
def asof_anchor(spark, sf):
    e = _entries(spark, sf)
    return evidence.anchors(e, e.where("(conv_id + position) % 3 = 1"), "conv_id").select("id", "anchor")


_PARTS_SQL = """parts AS (SELECT conv_id, 0 AS ordinal, conv_id || ':0' AS f, conv_id || ':' || least(2, max(turn)) AS l, 0 AS low, least(2, max(turn)) AS high FROM conversations GROUP BY conv_id
    UNION ALL SELECT conv_id, 1, conv_id || ':' || (conv_id % 3 + 1), conv_id || ':' || max(turn), conv_id % 3 + 1, max(turn) FROM conversations GROUP BY conv_id HAVING max(turn) >= conv_id % 3 + 1)"""


def _parts(spark, sf):
    ends = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    id = lambda k: F.concat(F.col("conv_id"), F.lit(":"), k)
    a = ends.select("conv_id", F.lit(0).alias("ordinal"), id(F.lit(0)).alias("firstEntryId"), id(F.least(F.lit(2), "last")).alias("lastEntryId"), F.array(F.lit("acme"), F.lit("personal")).alias("organizations"))
    b = ends.where("last >= conv_id % 3 + 1").select("conv_id", F.lit(1).alias("ordinal"), id(F.col("conv_id") % 3 + 1).alias("firstEntryId"), id(F.col("last")).alias("lastEntryId"), F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("acme"), F.lit("zeta"))).otherwise(F.array(F.lit("personal"))).alias("organizations"))
    return a.unionByName(b)


@query("interval_join_parts", f"WITH {_PARTS_SQL} SELECT e.id, p.ordinal FROM ({_ENTRIES_SQL}) e JOIN parts p ON e.conv_id = p.conv_id AND e.position BETWEEN p.low AND p.high")
def interval_join_parts(spark, sf):
    e = _entries(spark, sf)
    return intervals.covered(e, intervals.positions(_parts(spark, sf), e, "conv_id"), "conv_id").select("id", "ordinal")


@query("part_overlap", f"WITH {_PARTS_SQL} SELECT conv_id, ordinal, low <= coalesce(max(high) OVER (PARTITION BY conv_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS overlaps FROM parts")
def part_overlap(spark, sf):
    placed = intervals.positions(_parts(spark, sf), _entries(spark, sf), "conv_id")
    return intervals.overlapping(placed, "conv_id").select("conv_id", "ordinal", "overlaps")


@query("plan_reach", f"WITH {_PARTS_SQL}, o AS (SELECT conv_id, 'acme' AS o FROM parts WHERE ordinal = 0 UNION SELECT conv_id, unnest(['acme', 'zeta']) FROM parts WHERE ordinal = 1 AND conv_id % 2 = 0) SELECT conv_id, string_agg(DISTINCT o, ',' ORDER BY o) AS organizations FROM o GROUP BY conv_id")
def plan_reach(spark, sf):
    return intervals.reach(_parts(spark, sf), "conv_id").select("conv_id", F.array_join("organizations", ",").alias("organizations"))


@query("published_parts", f"""WITH {_PARTS_SQL},
    w AS (SELECT *, CASE WHEN ordinal = 0 THEN ['acme'] WHEN conv_id % 2 = 0 THEN ['acme', 'zeta'] ELSE [] END AS orgs FROM parts),
    e AS (SELECT *, position % 5 = 4 AS gone, position = 1 AS quotes, CASE WHEN conv_id % 4 = 0 THEN ['acme', 'zeta'] WHEN conv_id % 4 = 1 THEN ['acme'] END AS allowed FROM ({_ENTRIES_SQL}))
    SELECT w.conv_id, f AS first, array_to_string(orgs, ',') AS organizations, string_agg(e.id, ',' ORDER BY position) AS ids FROM w JOIN e ON e.conv_id = w.conv_id AND position BETWEEN low AND high
    WHERE len(orgs) > 0 AND NOT gone AND (NOT quotes OR coalesce(list_has_all(allowed, orgs), false)) GROUP BY w.conv_id, f, l, orgs""")
def published_parts(spark, sf):
    e = _entries(spark, sf)
    allowed = F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("acme"), F.lit("zeta"))).when(F.col("conv_id") % 4 == 1, F.array(F.lit("acme")))
    foreign = e.where("position = 1").select("conv_id", "id", allowed.alias("allowed"))
    out = publish.published(_parts(spark, sf), e, e.where("position % 5 = 4"), foreign, e.where("position > 1000"), "conv_id")
    return out.select("conv_id", F.col("firstEntryId").alias("first"), F.array_join("organizations", ",").alias("organizations"), F.array_join("entryIds", ",").alias("ids"))


@query("span_merge", f"""
    WITH s AS (SELECT user_id, ms AS low, ms + (value * 100000)::BIGINT AS high FROM ({_EVENTS_SQL})),
    m AS (SELECT *, max(high) OVER (PARTITION BY user_id ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN low <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY low, high) AS island FROM m)
    SELECT user_id, min(low) AS low, max(high) AS high, count(*) AS spans FROM i GROUP BY user_id, island""")
def span_merge(spark, sf):
    e = _events(spark, sf).select("user_id", F.col("ms").alias("low"), (F.col("ms") + F.round(F.col("value") * 100000).cast("long")).alias("high"))
    return intervals.merged(e, "user_id")


@query("window_by_chars", f"SELECT id, so_far::BIGINT AS so_far FROM (SELECT id, sum(length(text)) OVER w AS so_far, row_number() OVER w AS nth FROM ({_ENTRIES_SQL}) WINDOW w AS (PARTITION BY conv_id ORDER BY position)) WHERE so_far <= 600 OR nth = 1")
def window_by_chars(spark, sf):
    return intervals.window(_entries(spark, sf), F.length("text").cast("long"), "conv_id", limit=600).select("id", "so_far")


@query("reach_intersection", """
    WITH o AS (SELECT DISTINCT o_custkey AS id, o_orderkey % 7 AS origin FROM orders), r(origin, org) AS (VALUES (0, 'a'), (0, 'b'), (1, 'a'), (2, 'a'), (2, 'b'), (3, 'b'), (4, 'a'), (4, 'b'), (5, 'b')),
    n AS (SELECT id, count(*) AS n, bool_or(origin = 6) AS unknown FROM o GROUP BY id), m AS (SELECT id, org, count(*) AS m FROM o JOIN r USING (origin) GROUP BY ALL)
    SELECT n.id, CASE WHEN NOT any_value(unknown) THEN coalesce(string_agg(org, ',' ORDER BY org) FILTER (WHERE m = n), '') END AS allowed FROM n LEFT JOIN m USING (id) GROUP BY n.id""")
def reach_intersection(spark, sf):
    origins = _t(spark, sf, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 7).alias("origin"))
    reaches = _rows(spark, [(0, ["a", "b"]), (1, ["a"]), (2, ["a", "b"]), (3, ["b"]), (4, ["a", "b"]), (5, ["b"])], "origin long, organizations array<string>")
    return intervals.common(origins, reaches, "id").select("id", F.array_join("allowed", ",").alias("allowed"))


_SESS_SQL = "SELECT o_orderkey AS id, o_custkey AS whole, 'd' || (o_orderkey % 5) AS stored, CASE WHEN o_orderstatus = 'P' THEN 'x' END AS gone, CASE WHEN o_orderkey % 13 = 0 THEN 'muse' ELSE 'codex' END AS source, CASE WHEN o_orderkey % 3 = 0 THEN ['acme', 'zeta'] WHEN o_orderkey % 3 = 1 THEN ['acme'] ELSE [] END AS routed FROM orders"
_RCPT_SQL = "SELECT l_orderkey AS id, CASE WHEN l_linenumber = 1 THEN 'A' ELSE 'Z' END AS destination, 'd' || (l_orderkey % 4) AS digest FROM lineitem WHERE l_linenumber <= 2"
DESTINATIONS = [("A", "acme", "all"), ("Z", "zeta", "leaked"), ("Q", "zeta", "off")]


def _sessions(spark, sf):
    empty = F.array().cast("array<string>")
    routed = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("acme"), F.lit("zeta"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("acme"))).otherwise(empty)
    return _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("partOf"), F.concat(F.lit("d"), F.col("o_orderkey") % 5).alias("storedDigest"), F.lit(1).alias("revision"),
        F.when(F.col("o_orderstatus") == "P", "x").alias("supersededBy"), F.when(F.col("o_orderkey") % 13 == 0, "muse").otherwise("codex").alias("source"), F.lit(None).cast("string").alias("provider"), routed.alias("routedTo"),
    )


def _receipts(spark, sf):
    lines = _t(spark, sf, "lineitem").where("l_linenumber <= 2")
    return lines.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") == 1, "A").otherwise("Z").alias("destination"), F.concat(F.lit("d"), F.col("l_orderkey") % 4).alias("digest"))


def _destinations(spark):
    return _rows(spark, DESTINATIONS, "destination string, organization string, cleanup string")


_DEST_SQL = "dest(destination, organization, cleanup) AS (VALUES " + ", ".join(map(str, DESTINATIONS)) + ")"
_ROUTED_SQL = f"routed AS (SELECT DISTINCT id, destination, stored FROM (SELECT id, stored, unnest(routed) AS organization FROM s WHERE gone IS NULL AND source <> 'muse') JOIN dest USING (organization))"


@query("delivery_status", f"""WITH s AS ({_SESS_SQL}), {_DEST_SQL}, r AS ({_RCPT_SQL}), {_ROUTED_SQL}
    SELECT destination, count(*) FILTER (WHERE r.digest IS NOT DISTINCT FROM stored) AS delivered, count(*) FILTER (WHERE r.digest IS DISTINCT FROM stored) AS pending FROM routed LEFT JOIN r USING (id, destination) GROUP BY destination""")
def delivery_status(spark, sf):
    sessions = _sessions(spark, sf)
    return sync.delivery_counts(sessions, sync.routes(sessions, _destinations(spark)), _receipts(spark, sf))


@query("publish_queue", f"WITH s AS ({_SESS_SQL}), {_DEST_SQL}, r AS ({_RCPT_SQL}), {_ROUTED_SQL} SELECT id, destination FROM routed LEFT JOIN r USING (id, destination) WHERE r.digest IS DISTINCT FROM stored AND id % 50 <> 7 AND destination <> 'Q'")
def publish_queue(spark, sf):
    sessions = _sessions(spark, sf)
    waiting = sessions.where("id % 50 = 7").select(F.explode(F.array(F.concat_ws("|", "id", F.lit("A")), F.concat_ws("|", "id", F.lit("Z")))).alias("key")).unionByName(_rows(spark, [("Q",)], "key string")).withColumn("until", F.lit(NOW + 1))
    return sync.to_publish(sync.routes(sessions, _destinations(spark)), _receipts(spark, sf), NOW, waiting).select("id", "destination")


_GONE_SQL = f"""WITH s AS ({_SESS_SQL}), {_DEST_SQL}, c AS (SELECT DISTINCT id, destination FROM ({_RCPT_SQL})),
    k AS (SELECT id, destination FROM c JOIN dest USING (destination) JOIN s USING (id) WHERE gone IS NULL AND source <> 'muse' AND list_contains(routed, organization)),
    g AS (SELECT *, row_number() OVER (PARTITION BY destination ORDER BY id) AS place FROM (SELECT * FROM c EXCEPT SELECT * FROM k))"""


@query("sync_reconcile", f"{_GONE_SQL} SELECT id, destination FROM g WHERE place <= 100")
def sync_reconcile(spark, sf):
    receipts = _receipts(spark, sf)
    none = _rows(spark, [], "id long, wholeTo array<string>, wholeDigests array<string>")
    return sync.reconcile(_sessions(spark, sf), none, receipts, receipts.where("id % 100 = 1").select("id", "destination"), receipts.where("id % 2 = 1"), _destinations(spark))


@query("sync_dry_run", f"{_GONE_SQL} SELECT destination, count(*) AS count, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM g WHERE place <= 100 GROUP BY destination")
def sync_dry_run(spark, sf):
    return sync.dry_run(sync_reconcile(spark, sf)).select("destination", "count", F.array_join("ids", ",").alias("ids"))


@query("held_by", f"WITH s AS ({_SESS_SQL}), {_DEST_SQL}, r AS ({_RCPT_SQL}) SELECT whole AS id, string_agg(DISTINCT organization, ',' ORDER BY organization) AS organizations FROM s JOIN r USING (id) JOIN dest USING (destination) GROUP BY whole")
def held_by(spark, sf):
    sessions = _sessions(spark, sf).select(F.concat(F.lit("o"), "id").alias("id"), "partOf")
    receipts = _receipts(spark, sf).select(F.concat(F.lit("o"), "id").alias("id"), "destination")
    out = sync.held_by(sessions, receipts, _destinations(spark))
    return out.where("id not like 'o%'").select(F.col("id").cast("long").alias("id"), F.array_join("organizations", ",").alias("organizations"))


@query("backoff", f"SELECT user_id::VARCHAR AS key, n::INT AS failures, ({NOW} + least(30000 * pow(2, least(n, 20) - 1), 1800000))::BIGINT AS until FROM (SELECT user_id, count(*) + 1 AS n FROM ({_EVENTS_SQL}) GROUP BY 1) WHERE user_id % 3 <> 0 UNION ALL SELECT 'new', 1, {NOW} + 30000")
def backoff(spark, sf):
    failed = _events(spark, sf).groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("failures")).withColumn("until", F.lit(0).cast("long"))
    attempts = failed.select("key", (F.col("key").cast("long") % 3 == 0).alias("ok")).unionByName(_rows(spark, [("new", False)], "key string, ok boolean"))
    return sync.after_attempts(failed, attempts, NOW)


@query("route_moves", """
    WITH a AS (SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderpriority))) AS o FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS id, list_sort(list_distinct(list(o_orderpriority))) AS o FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
    SELECT coalesce(array_to_string(a.o, '+'), 'nowhere') || ' → ' || coalesce(array_to_string(b.o, '+'), 'nowhere') AS move, count(*) AS n FROM a FULL JOIN b USING (id) GROUP BY ALL""")
def route_moves(spark, sf):
    orders = _t(spark, sf, "orders")
    of = lambda df: df.groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set("o_orderpriority").alias("organizations"))
    return sync.moves(of(orders.where("o_orderkey % 2 = 0")), of(orders.where("o_orderkey % 3 = 0"))).groupBy("move").agg(F.count(F.lit(1)).alias("n"))


@query("digest_keys", """SELECT conv_id, sha256('["0000","codex","s' || conv_id || '"]') AS key, turn, sha256('["' || conv_id || ':' || turn || '",0,' || length(text) || ',' || to_json(text) || ']') AS chunk FROM conversations""")
def digest_keys(spark, sf):
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", digests.session_key(F.lit("0000"), F.lit("codex"), F.concat(F.lit("s"), "conv_id")).alias("key"), "turn", digests.chunk_id(F.concat("conv_id", F.lit(":"), "turn"), F.lit(0), F.length("text"), F.col("text")).alias("chunk"))


_LINKS = "https://github.com/Org{k}/Repo/pull/{n} see https://github.com/org{k}/repo/commit/0123456789abcdef and https://linear.app/team/issue/eng-{n}"


@query("link_refs", """
    WITH l AS (SELECT page_id, page_id % 5 AS k, page_id % 50 AS n FROM pages),
    r AS (SELECT page_id, unnest([{'integration': 'github', 'ref': 'org' || k || '/repo#' || n}, {'integration': 'github', 'ref': 'org' || k || '/repo@0123456'}, {'integration': 'linear', 'ref': 'ENG-' || n}]) AS r FROM l)
    SELECT r.integration AS integration, r.ref AS ref, count(*) AS mentions FROM r GROUP BY ALL""")
def link_refs(spark, sf):
    k, n = (F.col("page_id") % 5).cast("string"), (F.col("page_id") % 50).cast("string")
    linked = F.concat(F.lit("https://github.com/Org"), k, F.lit("/Repo/pull/"), n, F.lit(" see https://github.com/org"), k, F.lit("/repo/commit/0123456789abcdef and https://linear.app/team/issue/eng-"), n)
    each = _t(spark, sf, "pages").select(F.explode(references.references(linked)).alias("r")).select("r.*")
    return each.groupBy("integration", "ref").agg(F.count(F.lit(1)).alias("mentions"))


@query("reference_counts", """
    WITH e AS (SELECT conv_id, turn, conv_id % 4 AS a, turn % 2 AS b FROM conversations),
    m AS (SELECT conv_id, 'o/r#' || unnest([a, b]) AS ref FROM e), c AS (SELECT conv_id, ref, count(*) AS n FROM m GROUP BY ALL),
    g AS (SELECT DISTINCT conv_id, 'o/r#1' AS ref FROM e UNION ALL SELECT DISTINCT conv_id, 'o/r' FROM e)
    SELECT coalesce(c.conv_id, g.conv_id) AS conv_id, coalesce(c.ref, g.ref) AS ref, g.ref IS NOT NULL AS recorded, coalesce(n, 0)::BIGINT AS mentions FROM c FULL JOIN g ON c.conv_id = g.conv_id AND c.ref = g.ref""")
def reference_counts(spark, sf):
    e = _entries(spark, sf).withColumn("text", F.concat(F.lit("github.com/o/r/pull/"), F.col("conv_id") % 4, F.lit(" github.com/o/r/issues/"), F.col("position") % 2))
    recorded = e.select("conv_id").distinct().select("conv_id", F.posexplode(F.array(F.lit("o/r#1"), F.lit("o/r"))).alias("place", "ref")).withColumn("integration", F.lit("github"))
    return listing.reference_counts(e, recorded, "conv_id").select("conv_id", "ref", "recorded", "mentions")


@query("repository_slugs", r"""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'o' || page_id || '/r' WHEN 1 THEN 'o' || page_id || '/r' WHEN 2 THEN 'o' || page_id || '/r' WHEN 3 THEN 'o' || page_id || '/r' END AS slug FROM pages""")
def repository_slugs(spark, sf):
    o = F.concat(F.lit("O"), F.col("page_id"))
    value = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("https://github.com/"), o, F.lit("/r.git"))).when(F.col("page_id") % 5 == 1, F.concat(F.lit("git@github.com:"), o, F.lit("/R.git"))).when(F.col("page_id") % 5 == 2, F.concat(o, F.lit("/r#12"))).when(F.col("page_id") % 5 == 3, F.concat(o, F.lit("/r/tree/main"))).otherwise(F.lit("no slug"))
    return _t(spark, sf, "pages").select("page_id", references.repository_slug(value).alias("slug"))


@query("claims_state", f"""
    WITH c AS (SELECT user_id, max(ms) AS until, max(event_id) % 2 = 0 AS done, min(ms) AS fat FROM ({_EVENTS_SQL}) WHERE user_id % 4 <> 0 GROUP BY 1), q AS (SELECT DISTINCT user_id FROM events)
    SELECT user_id, CASE WHEN c.user_id IS NULL THEN 'none' WHEN until > {NOW} - 30 * 86400000::BIGINT THEN 'live' WHEN done AND user_id * 100000000 + 1700000000000 <= fat + 1000 THEN 'fulfilled' ELSE 'lapsed' END AS state FROM q LEFT JOIN c USING (user_id)""")
def claims_state(spark, sf):
    e = _events(spark, sf)
    held = e.where("user_id % 4 <> 0").groupBy("user_id").agg(F.max("ms").alias("expiresAt"), F.max("event_id").alias("m"), F.min("ms").alias("at"))
    held = held.select(F.lit("codex").alias("source"), F.col("user_id").cast("string").alias("sessionId"), "expiresAt", F.when(F.col("m") % 2 == 0, "x").alias("fulfilledBy"), F.when(F.col("m") % 2 == 0, F.col("at")).alias("fulfilledAt"))
    # Subagents ask, and follow their root's claim.
    asked = e.select("user_id").distinct().select(F.lit("codex").alias("source"), F.concat(F.col("user_id"), F.lit("/agent-1")).alias("sessionId"), (F.col("user_id") * 100000000 + 1700000000000).alias("modifiedAt"))
    return claims.states(asked, held, NOW - 30 * store.DAY).select(F.substring_index("sessionId", "/", 1).cast("long").alias("user_id"), "state")


@query("claims_hold", f"""
    WITH c AS (SELECT user_id, 'w' || (user_id % 2) AS claimant, max(ms) AS until FROM ({_EVENTS_SQL}) GROUP BY 1)
    SELECT user_id, CASE WHEN claimant <> 'w0' AND until > {NOW} - 30 * 86400000::BIGINT THEN claimant ELSE 'w0' END AS claimant, CASE WHEN claimant <> 'w0' AND until > {NOW} - 30 * 86400000::BIGINT THEN until ELSE {NOW} - 30 * 86400000::BIGINT + 60000 END AS expires FROM c""")
def claims_hold(spark, sf):
    e = _events(spark, sf)
    key = F.col("user_id").cast("string").alias("sessionId")
    held = e.groupBy("user_id").agg(F.max("ms").alias("expiresAt")).select(F.lit("codex").alias("source"), key, F.concat(F.lit("w"), F.col("user_id") % 2).alias("claimant"), "expiresAt", F.lit(None).cast("string").alias("fulfilledBy"), F.lit(None).cast("long").alias("fulfilledAt"))
    wanted = e.select("user_id").distinct().select(F.lit("codex").alias("source"), key, F.lit("w0").alias("claimant"))
    after, _ = claims.hold(held, wanted, NOW - 30 * store.DAY, 60_000)
    return after.select(F.col("sessionId").cast("long").alias("user_id"), "claimant", F.col("expiresAt").alias("expires"))


_DUE = "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'new entries' WHEN o_orderkey % 4 = 2 THEN 'evidence' END"


def _planned(spark, sf):
    orders = _t(spark, sf, "orders")
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    key = F.col("o_orderkey")
    sessions = orders.select(
        key.alias("id"), F.lit(None).cast("string").alias("partOf"), F.when(F.col("o_orderstatus") == "P", "x").alias("supersededBy"), F.when(key % 17 == 0, F.array(F.lit("run:test"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(key % 3 == 0, "subagent").alias("lineageKind"), F.lit(None).cast("int").alias("lineageDepth"), F.when(key % 3 == 0, key - 2).alias("parentId"), ms.alias("capturedAt"), F.lit("dig").alias("digest"), key.alias("seq"),
    )
    plans = orders.where("o_orderkey % 4 < 3").select(key.alias("id"), F.when(key % 4 == 1, "new entries").when(key % 4 == 2, "evidence").alias("due"), (ms + 1).alias("at"), F.when(key % 8 == 0, "old").otherwise("ctx").alias("contextKey"), F.lit("chr").alias("key"), F.when(key % 5 != 0, "{}").alias("plan"))
    return sessions, plans


@query("queue_due", """
    WITH s AS (SELECT o_orderkey AS id, epoch_us(o_orderdate) // 1000 AS cap, o_orderkey % 3 = 0 AS child, o_orderkey - 2 AS parent, o_orderkey % 4 < 3 AS planned FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 17 <> 0),
    p AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 < 3 AND o_orderkey % 5 <> 0),
    d AS (SELECT *, CASE WHEN NOT planned THEN 'unplanned' WHEN id % 4 = 1 THEN 'new entries, paused' WHEN id % 4 = 2 THEN 'evidence' WHEN id % 8 = 0 THEN 'context' END AS reason FROM s WHERE planned OR NOT child OR parent IN (SELECT id FROM p))
    SELECT id, reason, child::INT AS depth FROM d WHERE reason IS NOT NULL ORDER BY depth, cap, id LIMIT 500""")
def queue_due(spark, sf):
    sessions, plans = _planned(spark, sf)
    return queues.routing_due(sessions, plans, NOW + 10 * 365 * store.DAY, 500, context="ctx")


@query("mark_related", """
    WITH p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 1 THEN 'new entries' WHEN o_orderkey % 4 = 2 THEN 'evidence' END AS due FROM orders WHERE o_orderkey % 4 < 3),
    c AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 6 = 0), r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey - 2 IN (SELECT id FROM c) UNION SELECT id - 2 FROM c)
    SELECT id, coalesce(due, CASE WHEN id IN (SELECT id FROM r) THEN 'related' END) AS due FROM p""")
def mark_related(spark, sf):
    sessions, plans = _planned(spark, sf)
    return queues.mark_related(plans, sessions, sessions.where("id % 6 = 0").select("id")).select("id", "due")


@query("review_queue", """
    SELECT l_orderkey AS id, h AS held, c AS confidence, r AS redactions FROM (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS h, min(l_discount * 10) AS c, (count(*) FILTER (WHERE l_tax > 0.07))::INT AS r FROM lineitem GROUP BY 1) WHERE h OR r > 0 OR c < 0.6 ORDER BY h DESC, c, l_orderkey DESC LIMIT 200""")
def review_queue(spark, sf):
    lines = _t(spark, sf, "lineitem")
    plans = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.when(F.bool_or(F.col("l_returnflag") == "R"), "held").otherwise("valid").alias("status"), F.collect_list(F.struct((F.col("l_discount") * 10).alias("confidence"))).alias("parts"), F.collect_list(F.when(F.col("l_tax") > 0.07, 1)).alias("redactions"))
    plans = plans.select("*", F.col("id").alias("at"), F.lit(None).cast("long").alias("reviewedAt"), F.array().cast("array<string>").alias("heldForReview"))
    return queues.review_queue(plans, 200).drop("at")


@query("suggestion_queue", f"WITH {_TAGS_SQL} SELECT id FROM o WHERE NOT list_contains(tags, 'run:test') AND id % 5 <> 0 ORDER BY seq DESC LIMIT 50")
def suggestion_queue(spark, sf):
    made = _t(spark, sf, "documents").where("doc_id % 5 < 2").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, "now").otherwise("old").alias("digest"), F.lit("k").alias("key"))
    return queues.suggestion_queue(_overlaid(spark, sf), made, "k", 50).select("id")


@query("record_suggestions", "SELECT outcome, n::BIGINT AS n FROM (SELECT CASE WHEN d.doc_id IS NULL THEN 'refused' WHEN l.doc_id % 3 = 0 THEN 'stale' ELSE 'recorded' END AS outcome, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT -1) l LEFT JOIN documents d USING (doc_id) GROUP BY 1 UNION ALL SELECT 'dropped', count(*) FROM labels WHERE doc_id % 3 <> 0)")
def record_suggestions(spark, sf):
    ids = _t(spark, sf, "labels").select(F.col("doc_id").alias("id")).unionByName(_rows(spark, [(-1,)], "id long"))
    answers = ids.select("id", F.when(F.col("id") % 3 == 0, "old").otherwise("now").alias("digest"), F.lit("k").alias("key"), F.lit("m").alias("by"), F.array(F.lit("good"), F.lit("project:x"), F.lit("odd")).alias("tags"), F.lit(1).alias("at"), F.lit(1).alias("order"))
    sessions = _t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("now").alias("digest"))
    return queues.record_suggestions(answers, sessions, _rows(spark, [("good",), ("toxic",)], "tag string"))[1]


@query("apply_parts", """
    SELECT id, CASE WHEN k AND t AND NOT p THEN 'conflict' WHEN k AND NOT t AND id % 11 = 0 THEN 'skip' WHEN k THEN 'upsert' WHEN NOT p THEN NULL WHEN id % 2 = 0 THEN 'retire' ELSE 'delete' END AS action FROM
      (SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS k, o_orderkey % 5 <> 0 AS t, o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0 AS p FROM orders) WHERE (k OR t) AND action IS NOT NULL""")
def apply_parts(spark, sf):
    ids = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    existing = ids.where("id % 5 <> 0").select("id", F.when(F.col("id") % 7 != 0, "w").alias("partOf"))
    return store.apply_parts(ids.where("id % 3 = 0"), existing, ids.where("id % 11 = 0"), ids.where("id % 2 = 0"))


@query("pending_deletes", "SELECT DISTINCT l_orderkey AS id, l_shipmode AS destination FROM (SELECT l_orderkey, l_returnflag AS l_shipmode FROM lineitem) WHERE l_orderkey % 3 = 0 AND NOT (l_shipmode = 'N' AND l_orderkey % 2 = 0)")
def pending_deletes(spark, sf):
    sent = _t(spark, sf, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("destination"))
    sessions = sent.select("id").distinct().select("id", F.lit("d").alias("digest"), F.lit("t").alias("transcriptDigest"), F.lit(None).cast("long").alias("partOf"))
    none = _rows(spark, [], "id long, digest string, transcriptDigest string, pending array<string>")
    _, tombstones, _ = store.delete(sessions, none, sent, sessions.select("id"))
    done = sent.where("destination = 'N' and id % 2 = 0").distinct()
    return store.pending_deletes(store.forget(sent, tombstones, done)[1])


@query("run_classification", """
    SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'oracle' WHEN 1 THEN 'host' WHEN 2 THEN 'test' WHEN 3 THEN 'oracle' WHEN 4 THEN 'test' END AS run FROM pages""")
def run_classification(spark, sf):
    cwd = F.element_at(F.array(*map(F.lit, ("/w/.oracle/x", "/w/decision-receipts/primed-a/fixture", "/tmp/y", "/tmp/oracle-1/z", "/w/scratchpad", "/w/code"))), (F.col("page_id") % 6 + 1).cast("int"))
    return _t(spark, sf, "pages").select("page_id", listing.inferred_run(cwd).alias("run"))


@query("folder_filter", r"WITH p AS (SELECT page_id, '/home/u' || regexp_extract(url, '^[^/]*//[^/?#]*(/[^?#]*)', 1) AS cwd FROM pages) SELECT page_id FROM p WHERE NOT regexp_matches(cwd, '^(.*/)?9[^/]*(/.*)?$') AND (regexp_matches(cwd, '^/home/u/fr(/.*)?$') OR regexp_matches(cwd, '^(.*/)?(en|de)/[^/]*7(/.*)?$'))")
def folder_filter(spark, sf):
    cwd = F.concat(F.lit("/home/u"), F.regexp_extract("url", r"^[^/]*//[^/?#]*(/[^?#]*)", 1))
    home = "/home/u"
    include = [globs.folder_glob(g, home) for g in ("~/fr/**", "{en,de}/*7")]
    return _t(spark, sf, "pages").where(globs.allowed(cwd, include, [globs.exclude_glob("9*", home)])).select("page_id")


@query("stagger", "SELECT conv_id, (('0x' || left(sha256(conv_id::VARCHAR), 8))::BIGINT % 600001)::BIGINT AS put_off FROM (SELECT DISTINCT conv_id FROM conversations)")
def stagger(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id").distinct().select("conv_id", digests.stagger(F.col("conv_id").cast("string"), 600_000).alias("put_off"))


@query("part_ids", "SELECT doc_id, CASE WHEN length(p) <= 256 THEN p ELSE left(s, 180) || '#part-' || left(sha256(p), 32) END AS part FROM (SELECT doc_id, 's' || left(text, 250) AS s, 's' || left(text, 250) || '#part-' || doc_id AS p FROM documents)")
def part_ids(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", digests.part_session_id(F.concat(F.lit("s"), F.left("text", F.lit(250))), F.col("doc_id").cast("string")).alias("part"))


@query("quoted_origins", """
    SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'root/agent-a' || conv_id WHEN 1 THEN 'unknown' WHEN 2 THEN 'root/agent-t1,root/agent-t2' END AS origins FROM conversations""")
def quoted_origins(spark, sf):
    a = F.concat(F.lit('<agent-message from="a'), F.col("conv_id"), F.lit('">'), "text", F.lit("</agent-message>"))
    wrapped = F.when(F.col("turn") % 4 == 0, a).when(F.col("turn") % 4 == 1, F.concat(F.lit("<teammate-message x>"), "text")).when(F.col("turn") % 4 == 2, F.lit("<task-notification><task-id>t2</task-id><task-id>t1</task-id></task-notification>")).otherwise(F.col("text"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.quoted_origins(wrapped, F.lit("root")), ",").alias("origins"))


@query("person_results", """
    SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 4 = 1 THEN 'event' WHEN turn % 4 = 3 THEN 'user' ELSE 'tool-call' END AS kind,
           CASE WHEN turn % 4 = 1 THEN '{"rejected":"Bash","command":"rm ' || conv_id || '"}' WHEN turn % 4 = 3 THEN 'The user answered: ' || conv_id ELSE '{"name":"Bash","input":{"command":"rm ' || conv_id || '"}}' END AS text FROM conversations""")
def person_results(spark, sf):
    c, turn = F.col("conv_id"), F.col("position") % 4
    call = F.concat(F.lit('{"name":"Bash","input":{"command":"rm '), c, F.lit('"}}'))
    said = F.when(turn == 1, F.lit("The user doesn't want to proceed with this tool use. No.")).otherwise(F.concat(F.lit("The user answered: "), c))
    e = _entries(spark, sf).withColumn("kind", F.when(turn % 2 == 0, "tool-call").otherwise("tool-result")).withColumn("text", F.when(turn % 2 == 0, call).otherwise(said)).withColumn("callId", F.lit("call"))
    return activity.person_results(e, "conv_id").select("id", "kind", "text")


@query("tool_strip", """
    SELECT conv_id || ':' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'event' ELSE role END AS kind, CASE WHEN turn % 3 = 0 THEN '{"spawned":"Task","description":"d' || conv_id || '"}' ELSE text END AS text FROM conversations WHERE turn % 3 <> 1""")
def tool_strip(spark, sf):
    turn = F.col("position") % 3
    spawn = F.concat(F.lit('{"name":"Task","input":{"description":"d'), "conv_id", F.lit('"}}'))
    e = _entries(spark, sf).withColumn("callId", F.lit(None).cast("string")).withColumn("kind", F.when(turn == 0, "tool-call").when(turn == 1, "tool-result").otherwise(F.col("kind"))).withColumn("text", F.when(turn == 0, spawn).otherwise(F.col("text")))
    return activity.strip(e, "conv_id").select("id", "kind", "text")


@query("sweep_batch", "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F' AND (o_orderkey > 100 OR o_orderkey IN (3, 5, 6)) ORDER BY o_orderkey IN (3, 5, 6) DESC, o_orderkey LIMIT 50")
def sweep_batch(spark, sf):
    sessions = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("seq"), "o_orderstatus")
    return store.sweep(sessions, F.col("o_orderstatus") == "F", 100, 50, [3, 5, 6]).select("id")


@query("collector_routing", f"""WITH {_PATHS_SQL}, c(collector, declared, root) AS (VALUES ('b', 1, '/en'), ('a', 0, '/en'), ('c', 2, '/en/6'), ('d', 3, '/de')),
    m AS (SELECT page_id, min_by(collector, struct_pack(x := -length(root), y := declared)) AS own FROM paths JOIN c ON rtrim(path, '/') = root OR starts_with(path, root || '/') GROUP BY 1)
    SELECT page_id AS id, coalesce(own, 'rest') AS collector FROM paths LEFT JOIN m USING (page_id)""")
def collector_routing(spark, sf):
    declared = _rows(spark, [("b", 1, "/en"), ("a", 0, "/en"), ("c", 2, "/en/6"), ("d", 3, "/de"), ("rest", 4, None), ("late", 5, None)], "collector string, declared int, root string")
    return evidence.collector_of(_paths(spark, sf).select(F.col("page_id").alias("id"), F.col("path").alias("cwd")), declared).select("id", "collector")


@query("activity_bursts", """
    WITH g AS (SELECT user_id, ts, sum(CASE WHEN p IS NULL OR ts >= p + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events))
    SELECT user_id, epoch_us(min(ts)) // 1000 AS began, epoch_us(max(ts)) // 1000 + 1800000 AS ended, count(*) AS n FROM g GROUP BY user_id, b""")
def activity_bursts(spark, sf):
    from .streaming.ingest import activity as bursts

    out = bursts(_t(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select("user_id", F.unix_millis("began").alias("began"), F.unix_millis("ended").alias("ended"), "n")


# Operators that SQL can't express; tests hold them against their specifications.


@query("chunk_text")
def chunk_text(spark, sf):
    e = _t(spark, sf, "documents").select("doc_id", F.lit(0).alias("position"), F.col("doc_id").cast("string").alias("id"), F.lit("doc").alias("sourceRef"), F.lit("user").alias("kind"), "text")
    return chunks.chunk(e, "doc_id", budget=256).select("doc_id", F.col("position").alias("chunk"), "start", "end", "tokens", "id")


@query("budget_fill")
def budget_fill(spark, sf):
    e = _t(spark, sf, "documents").select("doc_id", F.lit(0).alias("position"), F.col("doc_id").cast("string").alias("id"), F.lit("doc").alias("sourceRef"), F.lit("user").alias("kind"), "text")
    ranked = chunks.rank(chunks.chunk(e, "doc_id", budget=128), TERMS, "doc_id")
    best = chunks.select(ranked, TERMS, "doc_id", budget=300)
    return best.select("doc_id", "used", "matching", F.size("chunks").alias("chunks"), F.array_join(F.transform("chunks", lambda c: F.concat(c["start"], F.lit("-"), c["end"])), " ").alias("places"))


@query("redact_text")
def redact_text(spark, sf):
    word = F.regexp_extract("text", r"(\S+\s+\S+)", 1)
    spans = F.array(F.struct(word.alias("text"), F.lit("secret").alias("reason"), F.lit(False).alias("echoOnly")))
    c = _t(spark, sf, "conversations")
    return c.select("conv_id", "turn", redacted(F.col("text"), spans, F.array().cast("array<string>")).alias("text"))


@query("tool_access", """
    SELECT conv_id, turn, '/w/' || conv_id || ',/w/' || conv_id || '/out' || turn || '.txt' AS paths, '/w/' || conv_id || '/out' || turn || '.txt' AS writes FROM conversations""")
def tool_access_query(spark, sf):
    script = F.concat(F.lit('{"name":"Bash","input":{"command":"cd /w/'), F.col("conv_id"), F.lit(' && echo x > out'), F.col("turn"), F.lit('.txt"}}'))
    found = _t(spark, sf, "conversations").select("conv_id", "turn", tool_access(script, F.lit("/w")).alias("a"))
    return found.select("conv_id", "turn", F.array_join("a.paths", ",").alias("paths"), F.array_join("a.writes", ",").alias("writes"))


@query("capture_fold", f"""
    WITH RECURSIVE c AS MATERIALIZED (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, sha256(CAST(trunc(value) AS INT)::VARCHAR) AS digest, event_type AS tr, ms::DOUBLE AS ms FROM ({_EVENTS_SQL})),
    f(user_id, k, arrival, outcome, rev, rd, rt, ra, td, tt) AS (
      SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0, NULL::VARCHAR, NULL::VARCHAR, NULL::DOUBLE, NULL::VARCHAR, NULL::VARCHAR FROM c
      UNION ALL
      SELECT user_id, k, event_id, o, CASE o WHEN 'dropped' THEN 0 WHEN 'stored' THEN rev + 1 ELSE rev END,
             CASE o WHEN 'dropped' THEN NULL WHEN 'stored' THEN digest ELSE rd END, CASE o WHEN 'dropped' THEN NULL WHEN 'stored' THEN tr ELSE rt END, CASE o WHEN 'dropped' THEN NULL WHEN 'stored' THEN ms ELSE ra END,
             CASE WHEN o = 'dropped' AND rd IS NOT NULL THEN rd WHEN o = 'deleted' THEN digest WHEN o = 'stored' THEN NULL ELSE td END,
             CASE WHEN o = 'dropped' AND rd IS NOT NULL THEN rt WHEN o = 'stored' THEN NULL ELSE tt END
      FROM (SELECT c.*, f.rev, f.rd, f.rt, f.ra, f.td, f.tt,
                   CASE WHEN c.tr = 'purchase' THEN 'dropped' WHEN f.rd = c.digest THEN 'unchanged' WHEN f.rd IS NULL AND f.td IS NOT NULL AND (f.td = c.digest OR f.tt = c.tr) THEN 'deleted' WHEN f.rd IS NOT NULL AND f.ra > c.ms THEN 'stale' ELSE 'stored' END AS o
            FROM f JOIN c ON c.user_id = f.user_id AND c.k = f.k + 1))
    SELECT user_id::VARCHAR AS id, arrival, outcome, rev AS revision FROM f WHERE k > 0""")
def capture_fold(spark, sf):
    e = _events(spark, sf)
    wanted = e.select(
        F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("arrival"), F.sha2(F.col("value").cast("int").cast("string"), 256).alias("digest"), F.lit(None).cast("string").alias("storedDigest"),
        F.col("event_type").alias("transcriptDigest"), F.col("ms").cast("double").alias("capturedAt"), F.lit(None).cast("string").alias("previousDigest"), F.lit(False).alias("checked"), F.lit(False).alias("restore"), (F.col("event_type") == "purchase").alias("drop"),
    )
    none = lambda ddl: _rows(spark, [], ddl)
    folded = store.capture(wanted, none(store.SESSION), none("id string, digest string, transcriptDigest string"))
    return folded.where("outcome <> 'state'").select("id", "arrival", "outcome", "revision")


# Parsers, over transcripts written from the test tables.

def _claude_lines(spark, sf) -> DataFrame:
    """Conversations as records: answers of every third turn call a tool, and what is asked next brings its result."""
    c = _t(spark, sf, "conversations").where("role <> 'system'")
    before = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    called = F.when(F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")) == "assistant", before)
    c = c.withColumn("call", F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), F.col("turn"))).withColumn("result", F.when((F.col("role") == "user") & (called % 3 == 0), called))
    said = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    use = F.to_json(F.struct(F.lit("tool_use").alias("type"), F.concat(F.lit("c"), "call").alias("id"), F.lit("Read").alias("name"), F.struct(F.concat(F.lit("/w/f"), "call").alias("file_path")).alias("input")))
    result = F.to_json(F.struct(F.lit("tool_result").alias("type"), F.concat(F.lit("c"), "result").alias("tool_use_id"), F.lit("read").alias("content")))
    content = F.concat(F.lit("["), F.concat_ws(",", F.when(F.col("result").isNotNull(), result), F.to_json(said), F.when(F.col("call").isNotNull(), use)), F.lit("]"))
    head = F.to_json(F.struct(F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat(F.lit("r"), "turn").alias("uuid"), F.col("role").alias("type"), F.struct(F.lit("human").alias("kind")).alias("origin")))
    model = F.when(F.col("role") == "assistant", F.concat(F.lit(',"model":"m'), F.col("turn") % 3, F.lit('"'))).otherwise(F.lit(""))
    text = F.concat(F.regexp_replace(head, r"\}\z", ""), F.lit(',"message":{"content":'), content, model, F.lit("}}"))
    return c.select("conv_id", (F.col("turn") + 1).alias("line"), text.alias("text"))


@query("parse_claude", r"""
    WITH c AS (SELECT *, lag(turn) OVER w AS pt, lag(role) OVER w AS pr FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    d AS (SELECT *, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN turn END AS call, CASE WHEN role = 'user' AND pr = 'assistant' AND pt % 3 = 0 THEN pt END AS res FROM c),
    i AS (SELECT conv_id, turn, 0 AS seq, 'tool-result' AS kind, 'read' AS text, ':result-0' AS suffix, 'c' || res AS callId, NULL AS model FROM d WHERE res IS NOT NULL
          UNION ALL SELECT conv_id, turn, 1, role, text, ':text-' || (CASE WHEN res IS NOT NULL THEN 1 ELSE 0 END), NULL, CASE WHEN role = 'assistant' THEN 'm' || (turn % 3) END FROM d WHERE text <> ''
          UNION ALL SELECT conv_id, turn, 2, 'tool-call', '{"name":"Read","input":{"file_path":"/w/f' || call || '"}}', ':call-1', 'c' || call, 'm' || (turn % 3) FROM d WHERE call IS NOT NULL)
    SELECT 's' || conv_id AS session, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, seq) - 1)::INT AS position, 'r' || turn || suffix AS id, kind, text, callId AS call, model FROM i""")
def parse_claude(spark, sf):
    found = _imported(spark, _claude_lines(spark, sf), "conv_id", "claude-code").entries
    return found.select(F.col("sessionId").alias("session"), "position", "id", "kind", "text", F.col("callId").alias("call"), "model")


@query("parse_codex", r"""
    WITH c AS (SELECT *, 'm' || last_value(CASE WHEN turn % 2 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS model FROM conversations WHERE role <> 'system')
    SELECT 's' || conv_id AS session, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, 'line-' || (turn * 2 + 3) || ':text-0' AS id, role AS kind, text, CASE WHEN role = 'assistant' THEN model END AS model FROM c WHERE text <> ''""")
def parse_codex(spark, sf):
    c = _t(spark, sf, "conversations").where("role <> 'system'")
    meta = F.struct(F.concat(F.lit("s"), "conv_id").alias("id"), F.lit("codex_cli").alias("originator"))
    first = c.select("conv_id").distinct().select("conv_id", F.lit(1).cast("long").alias("line"), _line(type="session_meta", payload=meta))
    turns = c.where("turn % 2 = 0").select("conv_id", (F.col("turn") * 2 + 2).alias("line"), _line(type="turn_context", payload=F.struct(F.concat(F.lit("m"), "turn").alias("model"))))
    block = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    said = c.select("conv_id", (F.col("turn") * 2 + 3).alias("line"), _line(type="response_item", payload=F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), F.array(block).alias("content"))))
    found = _imported(spark, first.unionByName(turns).unionByName(said), "conv_id", "codex").entries
    return found.select(F.col("sessionId").alias("session"), "position", "id", "kind", "text", "model")


@query("parse_muse", r"""
    SELECT 's' || conv_id AS session, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position, 'r' || turn || CASE WHEN role = 'user' THEN ':text-0' ELSE ':text' END AS id, role AS kind, text, (1700000000000 + turn)::DOUBLE AS timestamp
    FROM conversations WHERE role <> 'system' AND text <> ''""")
def parse_muse(spark, sf):
    c = _t(spark, sf, "conversations").where("role <> 'system'")
    stream = F.struct(F.lit("session").alias("kind"), F.concat(F.lit("s"), "conv_id").alias("id"))
    common = {"id": F.concat(F.lit("r"), "turn"), "stream": stream, "recorded_at": (F.lit(1700000000000) + F.col("turn")) * 1000 + 7}
    block = F.struct(F.lit("text").alias("kind"), F.col("text").alias("text"))
    asked = _line(**common, payload_type="runtime.user_intent.accepted", payload=F.struct(F.concat(F.lit("i"), "turn").alias("intent_id"), F.struct(F.lit("chat").alias("kind")).alias("semantic_kind"), F.array(block).alias("refill_blocks")))
    event = F.struct(F.lit("assistant_message_committed").alias("kind"), F.col("text").alias("text"))
    answered = _line(**common, payload_type="runtime.session", payload=F.struct(F.lit("run").alias("kind"), F.lit("x").alias("run_id"), event.alias("event")))
    rows = c.select("conv_id", (F.col("turn") + 1).alias("line"), F.when(F.col("role") == "user", asked).otherwise(answered).alias("text"))
    found = _imported(spark, rows, "conv_id", "muse").entries
    return found.select(F.col("sessionId").alias("session"), "position", "id", "kind", "text", "timestamp")


@query("import_preview", r"""
    WITH c AS (SELECT * FROM conversations WHERE role <> 'system'),
    d AS (SELECT conv_id, turn, role, text, lag(turn) OVER w AS pt, lag(role) OVER w AS pr, min(turn) OVER (PARTITION BY conv_id) AS first FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    e AS (SELECT conv_id, min(first) AS first, count(*) FILTER (WHERE text <> '') + count(*) FILTER (WHERE role = 'assistant' AND turn % 3 = 0) + count(*) FILTER (WHERE role = 'user' AND pr = 'assistant' AND pt % 3 = 0) AS entries,
                 sum(length(text)) + coalesce(sum(length('{"name":"Read","input":{"file_path":"/w/f' || turn || '"}}')) FILTER (WHERE role = 'assistant' AND turn % 3 = 0), 0) + 4 * count(*) FILTER (WHERE role = 'user' AND pr = 'assistant' AND pt % 3 = 0) AS characters
          FROM d GROUP BY conv_id)
    SELECT '/t/' || conv_id || '.jsonl' AS file, CASE WHEN conv_id % 5 = 0 THEN 'rejected' ELSE 'ready' END AS status, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE entries END::BIGINT AS entries,
           CASE WHEN conv_id % 5 = 0 THEN 0 ELSE characters END::BIGINT AS characters, CASE WHEN conv_id % 5 = 0 THEN 'Invalid transcript JSON at line ' || (first + 1) END AS error FROM e""")
def import_preview(spark, sf):
    """Every fifth transcript is cut off in each of its lines."""
    rows = _claude_lines(spark, sf).withColumn("text", F.when(F.col("conv_id") % 5 == 0, F.left("text", F.length("text") - 1)).otherwise(F.col("text")))
    return sessions.preview(_imported(spark, rows, "conv_id", "claude-code")).select("file", "status", "entries", "characters", "error")


@query("typed_prompts", r"""
    SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE trim(text) END AS typed FROM conversations""")
def typed_prompts(spark, sf):
    """Turns wrapped as harnesses do: a reminder before, an instructions line, a section of an envelope, or nothing but a block."""
    shape = F.col("turn") % 4
    wrapped = (
        F.when(shape == 0, F.concat(F.lit("<system-reminder>keep <b>calm</b></system-reminder>\n"), "text"))
        .when(shape == 1, F.concat(F.lit("# AGENTS.md instructions for /w/x\n"), "text"))
        .when(shape == 2, F.concat(F.lit("# System Context\nrules\n# User Message\n"), "text", F.lit("\n# Assistant Message\nno")))
        .otherwise(F.concat(F.lit("<some-tag a='b'>"), "text", F.lit("</some-tag> <other_tag></other_tag>")))
    )
    return _t(spark, sf, "conversations").select("conv_id", "turn", text.typed_prompt_udf(wrapped).alias("typed"))


@query("redact_marked", "SELECT conv_id, turn, text || ' [redacted: secret] and [redacted: secret, career]' AS text FROM conversations")
def redact_marked(spark, sf):
    mark = F.concat(F.lit("KEY"), "conv_id", F.lit("x"), "turn")
    span = lambda t, reason: F.struct(t.alias("text"), F.lit(reason).alias("reason"), F.lit(False).alias("echoOnly"))
    spans = F.array(span(mark, "secret"), span(F.concat(mark, F.lit("/job")), "career"))
    whole = F.concat("text", F.lit(" "), mark, F.lit(" and "), mark, F.lit("/job"))
    return _t(spark, sf, "conversations").select("conv_id", "turn", redacted(whole, spans, F.array().cast("array<string>")).alias("text"))


@query("distinct_projects", "SELECT DISTINCT n_name AS \"projectId\" FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_name NOT IN ('FRANCE', 'P')")
def distinct_projects(spark, sf):
    routed = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("projectId"))
    return listing.projects(routed, unrouted="FRANCE")


@query("tag_definitions", "SELECT CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'a' || (c_custkey % 3) END AS \"actorId\", c_mktsegment || c_custkey AS tag, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE 'old' END AS description FROM customer WHERE c_custkey % 7 <> 0")
def tag_definitions(spark, sf):
    c = _t(spark, sf, "customer")
    actor = F.when(F.col("c_custkey") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("a"), F.col("c_custkey") % 3))
    rows = c.select("c_custkey", actor.alias("actorId"), F.concat("c_mktsegment", "c_custkey").alias("tag"), F.lit("old").alias("description"))
    given = lambda df: df.select(F.when(F.col("actorId") != "", F.col("actorId")).alias("actorId"), "tag", F.lit("new").alias("description"))
    defined = listing.define_tag(rows.drop("c_custkey"), given(rows.where("c_custkey % 5 = 0")))
    return listing.undefine_tag(defined, given(rows.where("c_custkey % 7 = 0")))


@query("lifted_revisions", """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS revision, CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE 'run:test,x' END AS tags FROM orders""")
def lifted_revisions(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("revision"), F.col("o_orderstatus").alias("digest"), F.array(F.lit("run:test"), F.lit("x")).alias("tags"))
    edits = o.where("id % 3 = 0").select("id", F.lit("run:test").alias("tag"), F.lit(False).alias("added"))
    held, revisions, _ = store.store_lifted(o.select("id", "revision", F.col("digest").alias("storedDigest")), o, o.select("id", "revision"), edits)
    return revisions.join(held.select("id", "revision"), ["id", "revision"]).select("id", "revision", F.array_join("tags", ",").alias("tags"))


@query("scan_totals", "SELECT sum(o_custkey % 3)::BIGINT AS imported, count(*) FILTER (WHERE o_orderstatus = 'O') AS unchanged, count(*) FILTER (WHERE o_orderstatus = 'P') AS held, 0::BIGINT AS dropped, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders")
def scan_totals(spark, sf):
    is_ = lambda s: (F.col("o_orderstatus") == s).cast("int")
    return transcripts.scan_totals(_t(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("imported"), is_("O").alias("unchanged"), is_("P").alias("held"), F.lit(0).alias("dropped"), is_("F").alias("failed")))


@query("collector_cache", "SELECT event_id::VARCHAR AS file FROM events WHERE event_id % 4 = 0 OR event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 9 = 0")
def collector_cache(spark, sf):
    """Files as events: of some the size or the routing has changed, some aren't known yet, some are due again."""
    e = _t(spark, sf, "events").select(F.col("event_id").cast("string").alias("file"), F.col("event_id").alias("n"), F.lit(1).cast("long").alias("size"), F.col("user_id").alias("modified"))
    at = F.when(F.col("n") % 9 == 0, F.lit(NOW - 2 * transcripts.REVALIDATE)).otherwise(F.lit(NOW - 1))
    cache = e.where("n % 4 <> 0").select("file", F.when(F.col("n") % 5 == 0, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("size"), "modified", F.when(F.col("n") % 7 == 0, F.lit("old")).otherwise(F.lit("new")).alias("routing"), F.lit("imported").alias("outcome"), at.cast("long").alias("at"))
    return transcripts.cached(e.drop("n"), cache, F.lit("new"), NOW)[0].select("file")


@query("collection_groups", "SELECT c_mktsegment AS source, c_nationkey::VARCHAR AS directory, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS collectors FROM customer GROUP BY ALL")
def collection_groups(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("string").alias("directory"), F.col("c_custkey").alias("seq"))
    return transcripts.collection_groups(c).select("source", "directory", F.array_join("collectors", ",").alias("collectors"))


@query("project_map", """
    WITH s AS (SELECT s_suppkey, 'p' || s_nationkey AS p, '/r/' || s_suppkey AS root FROM supplier)
    SELECT p AS "projectId", string_agg(root, ',' ORDER BY root) AS roots, coalesce(string_agg('/w' || root, ',' ORDER BY root) FILTER (WHERE s_suppkey % 2 = 0), '') AS worktrees,
           coalesce(string_agg('o/n' || s_suppkey, ',' ORDER BY 'o/n' || s_suppkey) FILTER (WHERE s_suppkey % 3 = 0), '') AS repositories FROM s GROUP BY p""")
def project_map(spark, sf):
    s = _t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("p"), "s_nationkey").alias("projectId"), F.concat(F.lit("/r/"), "s_suppkey").alias("root"))
    roots = s.select("projectId", "root")
    worktrees = roots.unionByName(s.where("s_suppkey % 2 = 0").select("projectId", F.concat(F.lit("/w"), "root").alias("root")))
    host = F.when(F.col("s_suppkey") % 3 == 0, F.lit("git@github.com:O/n")).otherwise(F.lit("https://example.org/o/n"))
    found = transcripts.project_map(roots, worktrees, roots.limit(0), s.select("root", F.concat(host, "s_suppkey").alias("url")))
    return found.select("projectId", *[F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) for c in ("roots", "worktrees", "repositories")])


@query("sensitivity_checked", "SELECT l_orderkey * 10 + l_linenumber AS id, coalesce(o_orderkey % 3 <> 0 AND o_custkey % 2 = 0, false) AS checked FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def sensitivity_checked(spark, sf):
    parts = _t(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("partOf"))
    plans = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 2).alias("checked"), F.lit(0).alias("checkKey"))
    return queues.sensitivity_checked(parts, plans)


@query("destination_identities", r"""
    SELECT page_id, '["https://h' || page_id || '.test' || CASE WHEN page_id % 3 = 1 THEN ':8443' ELSE '' END || '","/' || CASE WHEN page_id % 2 = 0 THEN 'x' ELSE '' END || '",' || CASE WHEN page_id % 5 = 0 THEN '["hub","i' || page_id || '","r"]' ELSE '"standalone"' END || ']' AS identity FROM pages""")
def destination_identities(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", (F.col("page_id") % 3).alias("m"))
    port = F.when(F.col("m") == 1, F.lit(":8443")).when(F.col("m") == 2, F.lit(":443")).otherwise(F.lit(""))
    url = F.concat(F.lit("HTTPS://H"), "page_id", F.lit(".test"), port, F.when(F.col("page_id") % 2 == 0, F.lit("/x")).otherwise(F.lit("")))
    kind = F.when(F.col("page_id") % 5 == 0, F.lit("hub")).otherwise(F.lit("standalone"))
    return p.select("page_id", sync.destination_identity(url, kind, F.concat(F.lit("i"), "page_id"), F.lit("r")).alias("identity"))


@query("settings_defaults", "SELECT n_name AS key, CASE WHEN n_regionkey = 1 THEN 'own' ELSE 'default' END AS value FROM nation")
def settings_defaults(spark, sf):
    n = _t(spark, sf, "nation").select(F.col("n_name").alias("key"), "n_regionkey")
    return store.defaults(n.select("key", F.lit("default").alias("value")), n.where("n_regionkey = 1").select("key", F.lit("own").alias("value")))


@query("collided_sessions", "SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 = 0")
def collided_sessions(spark, sf):
    """Every fourth session comes in with other entry ids throughout."""
    entries = lambda id: _t(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(id.alias("id"))).alias("entries"))
    turn = F.col("turn").cast("string")
    return store.collided(entries(turn), entries(F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit("x"), turn)).otherwise(turn)), "conv_id")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions that mention any term, newest first, with their best chunks within a token budget."""
    e = _entries(spark, sf)
    sessions = e.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "position").alias("title")).withColumn("seq", F.col("id")).withColumn("tags", F.array().cast("array<string>"))
    page = listing.search(sessions, e.select(F.col("conv_id").alias("id"), "text"), TERMS, 20)
    ranked = chunks.rank(chunks.chunk(e, "conv_id"), TERMS, "conv_id")
    best = chunks.select(ranked, TERMS, "conv_id").withColumnRenamed("conv_id", "id")
    return page.join(best, "id", "left").select("id", "title", "used", "matching", "chunks")


QUERIES["flagship_search"] = flagship
