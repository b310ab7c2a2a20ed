"""Queries by name over the tables, and the SQL that checks them.

`events` is read as an operation log, `customer` as a catalogue of documents, `orders` as their log and
versions, `conversations` as text documents; see `sources.oplog`.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlog.functions import codec, scalars
from loomlog.operators import blocks, intervals, merge, metrics, rooms, store
from loomlog.sources.oplog import ops, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CUTOFF = "2024-01-15"
NOW = "2024-01-29"
LES = [1.0, 3.0, 9.0, 27.0, 81.0, 243.0]
SPACE = "6ba7b8109dad11d180b400c04fd430c8"

OPS = """ops AS (SELECT doc, client, seq, ts, k, value, len, CAST(sum(len) OVER (PARTITION BY doc, client ORDER BY ts, seq) AS BIGINT) - len AS clock FROM (
    SELECT event_type AS doc, user_id AS client, event_id AS seq, ts, CAST(props->>'$.k' AS BIGINT) AS k, value, 1 + CAST(props->>'$.k' AS BIGINT) % 5 AS len FROM events))"""
PEER = f"peer AS (SELECT doc, client, max(clock + len) - 1 AS state FROM ops WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY ALL)"
RANGES = """isl AS (SELECT doc, client, clock, clock + len AS stop, max(clock + len) OVER (PARTITION BY doc, client ORDER BY clock, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ops WHERE k % 3 <> 0),
    grp AS (SELECT *, sum(CASE WHEN seen IS NULL OR clock > seen THEN 1 ELSE 0 END) OVER (PARTITION BY doc, client ORDER BY clock, stop) AS island FROM isl),
    ranges AS (SELECT doc, client, min(clock) AS clock, max(stop) - min(clock) AS len FROM grp GROUP BY doc, client, island)"""
LOG = "log AS (SELECT o_custkey AS doc_id, o_orderkey AS seq, o_orderdate AS created_at, o_orderstatus AS state FROM orders)"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def with_ops(sql: str, *parts: str) -> str:
    return "WITH " + ", ".join([OPS, *parts]) + " " + sql


def peer(spark, d):
    return intervals.state_vector(ops(spark, d).where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz"))).withColumn("state", F.col("state") - 1)


def deletes(spark, d):
    return ops(spark, d).where("k % 3 <> 0").select("doc", "client", "clock", "len")


def log(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("state"))


def documents(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("owner_id"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a peer lacks of each document and client, with the merged ranges that it must delete."""
    lacks = intervals.diff_since(ops(spark, sf_dir), peer(spark, sf_dir)).groupBy("doc", "client").agg(F.count(F.lit(1)).alias("structs"), F.sum("len").alias("units"), F.min("clock").alias("since"))
    gone = intervals.merge_ranges(deletes(spark, sf_dir)).groupBy("doc", "client").agg(F.count(F.lit(1)).alias("delete_ranges"), F.sum("len").alias("deleted"))
    return lacks.join(gone, ["doc", "client"], "left").na.fill(0, ["delete_ranges", "deleted"])


query(with_ops("""SELECT l.doc, l.client, structs, units, since, coalesce(delete_ranges, 0) AS delete_ranges, coalesce(deleted, 0) AS deleted FROM
    (SELECT o.doc, o.client, count(*) AS structs, sum(clock + len - greatest(clock, coalesce(state, 0))) AS units, min(greatest(clock, coalesce(state, 0))) AS since FROM ops o LEFT JOIN peer p ON o.doc = p.doc AND o.client = p.client WHERE clock + len > coalesce(state, 0) GROUP BY ALL) l
    LEFT JOIN (SELECT doc, client, count(*) AS delete_ranges, sum(len) AS deleted FROM ranges GROUP BY ALL) g ON l.doc = g.doc AND l.client = g.client""", PEER, RANGES))(flagship)


# -- clocks and ranges -------------------------------------------------------------------------------


@query(with_ops("SELECT doc, client, max(clock + len) AS state FROM ops GROUP BY ALL"))
def state_vector(spark, d):
    return intervals.state_vector(ops(spark, d))


@query(with_ops("SELECT doc, string_agg(client || ':' || state, ',' ORDER BY client DESC) AS sv FROM (SELECT doc, client, max(clock + len) AS state FROM ops GROUP BY ALL) GROUP BY doc"))
def state_vector_text(spark, d):
    return intervals.state_text(intervals.state_vector(ops(spark, d)))


@query(with_ops("SELECT doc, client, seq, expected, clock FROM (SELECT *, coalesce(lag(clock + len) OVER (PARTITION BY doc, client ORDER BY clock, seq), 0) AS expected FROM ops WHERE k % 11 <> 0) WHERE clock > expected"))
def clock_gap_check(spark, d):
    return intervals.gaps(ops(spark, d).where("k % 11 <> 0"))


@query(with_ops("""SELECT o.doc, o.client, count(*) AS pending FROM held o JOIN (SELECT doc, client, min(clock) AS gap FROM
    (SELECT *, coalesce(lag(clock + len) OVER (PARTITION BY doc, client ORDER BY clock, seq), 0) AS expected FROM held) WHERE clock > expected GROUP BY ALL) g
    ON o.doc = g.doc AND o.client = g.client AND clock >= gap GROUP BY ALL""", "held AS (SELECT * FROM ops WHERE k % 11 <> 0)"))
def pending_gaps(spark, d):
    return intervals.pending(ops(spark, d).where("k % 11 <> 0")).groupBy("doc", "client").agg(F.count(F.lit(1)).alias("pending"))


@query(with_ops("""SELECT doc, client, seq, origin_client, origin_clock FROM linked l WHERE origin_client IS NOT NULL AND NOT EXISTS (SELECT 1 FROM
    (SELECT doc, client, max(clock + len) AS state FROM ops WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL) s WHERE s.doc = l.doc AND s.client = origin_client AND origin_clock < state)""",
    "linked AS (SELECT doc, client, seq, lag(client) OVER w AS origin_client, lag(clock) OVER w AS origin_clock FROM ops WINDOW w AS (PARTITION BY doc ORDER BY ts, seq))"))
def missing_deps(spark, d):
    day = F.unix_date(F.to_date("ts"))
    linked = blocks.lagged(ops(spark, d).select("doc", "client", "clock", "seq", "ts"), ("doc",), ("ts", "seq"), day, {"origin_client": "client", "origin_clock": "clock"})
    return intervals.missing_dependencies(linked.select("doc", "client", "seq", "origin_client", "origin_clock"), ops(spark, d).where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")))


@query(with_ops("SELECT doc, client, clock, len FROM ops"))
def dedupe_ops(spark, d):
    twice = ops(spark, d).unionByName(ops(spark, d))
    return intervals.dedupe(twice).select("doc", "client", "clock", "len")


@query(with_ops("SELECT p.doc, p.client, p.seq, p.pos AS \"at\", o.clock AS start, o.clock + o.len AS stop FROM (SELECT doc, client, seq, clock + len // 2 AS pos FROM ops) p JOIN ops o ON o.doc = p.doc AND o.client = p.client AND o.clock <= pos AND pos < o.clock + o.len"))
def point_in_interval(spark, d):
    points = ops(spark, d).select("doc", "client", "seq", F.expr("clock + len div 2").alias("at"))
    return intervals.covering(points, ops(spark, d).select("doc", "client", "clock", "len"))


@query(with_ops("""SELECT doc, client, seq, clock, len FROM ops WHERE len = 1
    UNION ALL SELECT doc, client, seq, clock + len // 2 * i, CASE i WHEN 0 THEN len // 2 ELSE len - len // 2 END FROM ops, (VALUES (0), (1)) t(i) WHERE len > 1"""))
def interval_split(spark, d):
    at = ops(spark, d).select("doc", "client", F.expr("clock + len div 2").alias("at"))
    return intervals.split_at(ops(spark, d).select("doc", "client", "seq", "clock", "len"), at)


@query(with_ops("SELECT * FROM ranges", RANGES))
def delete_ranges(spark, d):
    return intervals.merge_ranges(deletes(spark, d))


@query(with_ops("SELECT doc, client, seq FROM ops o WHERE EXISTS (SELECT 1 FROM ranges r WHERE r.doc = o.doc AND r.client = o.client AND r.clock <= o.clock AND o.clock < r.clock + r.len)", RANGES))
def is_deleted(spark, d):
    points = ops(spark, d).select("doc", "client", "seq", F.col("clock").alias("at"))
    return intervals.covering(points, intervals.merge_ranges(deletes(spark, d)), "left_semi").select("doc", "client", "seq")


@query(with_ops("SELECT r.doc, r.client, greatest(clock, coalesce(state, 0)) AS clock, clock + len - greatest(clock, coalesce(state, 0)) AS len FROM ranges r LEFT JOIN peer p ON r.doc = p.doc AND r.client = p.client WHERE clock + len > coalesce(state, 0)", PEER, RANGES))
def pending_deletes(spark, d):
    return intervals.pending_deletes(intervals.merge_ranges(deletes(spark, d)), peer(spark, d))


@query(with_ops("SELECT o.doc, o.client, seq, greatest(clock, coalesce(state, 0)) AS clock, clock + len - greatest(clock, coalesce(state, 0)) AS len FROM ops o LEFT JOIN peer p ON o.doc = p.doc AND o.client = p.client WHERE clock + len > coalesce(state, 0)", PEER))
def diff_since(spark, d):
    return intervals.diff_since(ops(spark, d), peer(spark, d))


@query(with_ops("SELECT o.doc, count(*) AS structs, sum(clock + len - greatest(clock, coalesce(state, 0))) AS units, count(DISTINCT o.client) AS clients FROM ops o LEFT JOIN peer p ON o.doc = p.doc AND o.client = p.client WHERE clock + len > coalesce(state, 0) GROUP BY ALL", PEER))
def anti_entropy(spark, d):
    return intervals.diff_since(ops(spark, d), peer(spark, d)).groupBy("doc").agg(F.count(F.lit(1)).alias("structs"), F.sum("len").alias("units"), F.count_distinct("client").alias("clients"))


@query(with_ops("SELECT DISTINCT doc FROM ops"))
def roots(spark, d):
    return ops(spark, d).select("doc").distinct()


@query(with_ops("SELECT doc, count(*) AS structs, count(DISTINCT client) AS clients, sum(96 + len) AS bytes FROM ops GROUP BY ALL"))
def usage_by_doc(spark, d):
    return intervals.usage(ops(spark, d))


@query(with_ops("SELECT doc, client, clock + len - 1 AS last_clock, row_number() OVER (PARTITION BY doc ORDER BY client DESC) AS place FROM (SELECT doc, client, arg_max(clock, clock) AS clock, arg_max(len, clock) AS len FROM ops GROUP BY ALL)"))
def clients_descending(spark, d):
    last = ops(spark, d).groupBy("doc", "client").agg(F.max(intervals.last_id()).alias("last_clock"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("client"))))


# -- documents ---------------------------------------------------------------------------------------


def map_writes(spark, d):
    """The current values of maps: each operation of a document sets one key of its map; a client's sets of one key follow one another."""
    rows = ops(spark, d).withColumn("sub", (F.col("k") % 20).cast("string"))
    rows = rows.withColumn("clock", F.row_number().over(Window.partitionBy("doc", "client").orderBy("ts", "seq")).cast("long") - 1)
    rows = rows.withColumn("prev", F.lag("clock").over(Window.partitionBy("doc", "client", "sub").orderBy("clock")))
    none = F.lit(None).cast("struct<client: long, clock: long>")
    content = F.to_json(F.struct(F.array(F.col("value").cast("string")).alias("values")))
    return merge.current_writes(rows.select(
        "doc", "seq", F.lit(None).cast("string").alias("error"), "client", "clock", F.lit(1).cast("long").alias("len"), F.lit("Item").alias("kind"),
        F.when(F.col("prev").isNotNull(), F.struct("client", F.col("prev").alias("clock"))).alias("origin"), none.alias("right_origin"), F.when(F.col("prev").isNull(), F.lit("map")).alias("parent_root"), none.alias("parent_item"),
        F.when(F.col("prev").isNull(), F.col("sub")).alias("parent_sub"), F.lit(8).alias("content_ref"), content.alias("content"),
    ))


@query(with_ops("SELECT doc, CAST(k % 20 AS VARCHAR) AS key, arg_max(value, (client, clock)) AS value FROM ops GROUP BY ALL"))
def map_lww(spark, d):
    """Concurrent writers of a key: the last write of the greatest client stays."""
    value = F.get(F.from_json(F.get_json_object("content", "$.values"), "array<string>"), 0).cast("double")
    return map_writes(spark, d).select("doc", "key", value.alias("value"))


@query(with_ops("SELECT doc, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT DISTINCT doc, CAST(k % 20 AS VARCHAR) AS key FROM ops) GROUP BY ALL"))
def map_keys(spark, d):
    return merge.keys_of(map_writes(spark, d)).select("doc", F.array_join("keys", ",").alias("keys"))


@query(with_ops("SELECT doc, count(DISTINCT k % 20) AS n FROM ops GROUP BY ALL"))
def map_len(spark, d):
    return merge.keys_of(map_writes(spark, d)).select("doc", "n")


@query("SELECT conv_id, string_agg(text, '' ORDER BY role, turn) AS text FROM conversations GROUP BY ALL")
def text_concurrent_runs(spark, d):
    runs = F.sort_array(F.collect_list(F.struct("role", "turn", "text")))
    return read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(runs, lambda r: r["text"]), "").alias("text"))


def conversation_structs(spark, d):
    """Each role types one run at the start of the conversation: its turns follow one another."""
    client = F.when(F.col("role") == "assistant", 1).when(F.col("role") == "system", 2).otherwise(3).cast("long")
    rows = read(spark, d, "conversations").where("text is not null and text <> ''").select(F.col("conv_id").cast("string").alias("doc"), "turn", client.alias("client"), "text", scalars.utf16_length(F.col("text")).alias("len"))
    before = Window.partitionBy("doc", "client").orderBy("turn")
    rows = rows.withColumn("clock", F.sum("len").over(before) - F.col("len"))
    first = F.col("clock") == 0
    none = F.lit(None).cast("struct<client: long, clock: long>")
    return rows.select(
        "doc", F.col("turn").alias("seq"), F.lit(None).cast("string").alias("error"), "client", "clock", "len", F.lit("Item").alias("kind"),
        F.when(~first, F.struct("client", (F.col("clock") - 1).alias("clock"))).alias("origin"), none.alias("right_origin"), F.when(first, F.lit("text")).alias("parent_root"), none.alias("parent_item"),
        F.lit(None).cast("string").alias("parent_sub"), F.lit(4).alias("content_ref"), F.to_json(F.struct(F.col("text").alias("str"))).alias("content"),
    )


@query("SELECT CAST(conv_id AS VARCHAR) AS doc, 'text' AS parent, string_agg(text, '' ORDER BY CASE role WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 ELSE 3 END, turn) AS text FROM conversations WHERE text <> '' GROUP BY conv_id")
def text_integrate(spark, d):
    return merge.texts(merge.integrate(conversation_structs(spark, d)))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc, sum(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) AS units FROM conversations WHERE text <> '' GROUP BY conv_id")
def text_units(spark, d):
    return merge.text_lengths(merge.integrate(conversation_structs(spark, d))).select("doc", "units")


@query()
def doc_describe(spark, d):
    return merge.describe(merge.integrate(conversation_structs(spark, d)))


@query()
def merge_fingerprint(spark, d):
    return merge.fingerprints(merge.integrate(conversation_structs(spark, d)))


@query("SELECT CAST(conv_id AS VARCHAR) AS doc, string_agg(g, ',' ORDER BY g) AS guids FROM (SELECT DISTINCT conv_id, conv_id || '-' || turn AS g FROM conversations) GROUP BY ALL")
def subdocs(spark, d):
    """Each turn embeds a document of its own in the list of its conversation."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("long").alias("turn")).distinct()
    place = F.row_number().over(Window.partitionBy("doc").orderBy("turn")).cast("long") - 1
    none = F.lit(None).cast("struct<client: long, clock: long>")
    rows = rows.withColumn("clock", place).select(
        "doc", F.col("turn").alias("seq"), F.lit(None).cast("string").alias("error"), F.lit(1).cast("long").alias("client"), "clock", F.lit(1).cast("long").alias("len"), F.lit("Item").alias("kind"),
        F.when(F.col("clock") > 0, F.struct(F.lit(1).cast("long").alias("client"), (F.col("clock") - 1).alias("clock"))).alias("origin"), none.alias("right_origin"), F.when(F.col("clock") == 0, F.lit("docs")).alias("parent_root"), none.alias("parent_item"),
        F.lit(None).cast("string").alias("parent_sub"), F.lit(9).alias("content_ref"), F.to_json(F.struct(F.concat_ws("-", "doc", "turn").alias("guid"))).alias("content"),
    )
    return merge.subdocuments(merge.integrate(rows), current=False).select("doc", F.array_join("guids", ",").alias("guids"))


@query(with_ops("""SELECT a.doc, md5(a.sv) AS etag, a.sv <> coalesce(b.sv, '') AS changed FROM (SELECT doc, string_agg(client || ':' || s, ',' ORDER BY client DESC) AS sv FROM (SELECT doc, client, max(clock + len) AS s FROM ops GROUP BY ALL) GROUP BY doc) a
    LEFT JOIN (SELECT doc, string_agg(client || ':' || s, ',' ORDER BY client DESC) AS sv FROM (SELECT doc, client, max(clock + len) AS s FROM ops WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL) GROUP BY doc) b ON a.doc = b.doc"""))
def etag_changed(spark, d):
    now = intervals.state_text(intervals.state_vector(ops(spark, d)))
    then = intervals.state_text(intervals.state_vector(ops(spark, d).where(F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")))).withColumnRenamed("sv", "had")
    return now.join(then, "doc", "left").select("doc", F.md5("sv").alias("etag"), (F.col("sv") != F.coalesce("had", F.lit(""))).alias("changed"))


@query(with_ops("""SELECT doc, md5(string_agg(client || ':' || digest, ',' ORDER BY client)) AS fingerprint FROM (SELECT doc, client, md5(string_agg(digest, ',' ORDER BY span)) AS digest FROM
    (SELECT doc, client, clock // 1024 AS span, md5(string_agg(clock || ':' || len, ',' ORDER BY clock)) AS digest FROM ops GROUP BY ALL) GROUP BY ALL) GROUP BY doc"""))
def doc_fingerprint(spark, d):
    return intervals.digests(ops(spark, d))


@query(with_ops("SELECT doc, seq, client, clock + len AS state FROM ops"))
def update_vector(spark, d):
    return intervals.update_vector(ops(spark, d))


@query(with_ops("""SELECT doc, client, odd, min(clock) AS clock, sum(len) AS len, count(*) AS parts FROM (SELECT *, sum(new) OVER (PARTITION BY doc, client ORDER BY clock) AS run FROM
    (SELECT *, k % 2 AS odd, CASE WHEN lag(k % 2) OVER (PARTITION BY doc, client ORDER BY clock) = k % 2 THEN 0 ELSE 1 END AS new FROM ops)) GROUP BY doc, client, odd, run"""))
def coalesced_runs(spark, d):
    return intervals.coalesced(ops(spark, d).withColumn("odd", F.col("k") % 2), "odd")


# -- the store ---------------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT c_custkey AS doc_id, count(seq) AS rows, coalesce(max(seq), 0) AS last_seq FROM customer LEFT JOIN log ON c_custkey = doc_id GROUP BY ALL")
def load_replay(spark, d):
    return store.load_log(documents(spark, d), log(spark, d)).groupBy("doc_id").agg(F.count("seq").alias("rows"), F.coalesce(F.max("seq"), F.lit(0)).alias("last_seq"))


@query("SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, l_partkey AS payload FROM lineitem")
def append_unnest(spark, d):
    packed = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"])
    return store.append_batch(read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(packed.alias("payloads")))


@query(f"WITH {LOG} SELECT state, batch, count(*) AS n FROM (SELECT state, (row_number() OVER (PARTITION BY state ORDER BY seq) - 1) // 256 AS batch FROM log) GROUP BY ALL")
def micro_batches(spark, d):
    return rooms.batches(log(spark, d), 256, ("state",), ("seq",), F.floor(F.col("seq") / 100_000)).groupBy("state", "batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT state, seq, n FROM (SELECT state, seq, row_number() OVER (PARTITION BY state ORDER BY seq) AS n FROM log) WHERE n % 500 = 0")
def compaction_points(spark, d):
    return rooms.trigger_points(log(spark, d), 500, ("state",), ("seq",), F.floor(F.col("seq") / 100_000)).select("state", "seq", "n")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT min(k), min(n) FROM (SELECT c_custkey AS k, c_name AS n FROM customer WHERE c_custkey % 3 = 0) GROUP BY k")
def upsert_ignore(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return store.insert_absent(rows.where("id % 3 <> 0"), rows.where("id % 2 = 0").unionByName(rows.where("id % 3 = 0")).where("id % 3 = 0 or id % 2 = 0"), "id")


@query(f"WITH {LOG} SELECT doc_id, seq FROM log WHERE NOT (state = 'F' AND doc_id % 2 = 1)")
def compact_log(spark, d):
    docs = documents(spark, d).withColumn("snapshot_seq", F.when(F.col("doc_id") % 2 == 0, F.lit(1 << 40)).otherwise(F.lit(0)).cast("long"))
    folded = log(spark, d).where("state = 'F'").select("doc_id", "seq")
    return store.compact(docs, log(spark, d).select("doc_id", "seq"), folded)[1]


@query(f"WITH {LOG} SELECT c_custkey AS doc_id, coalesce((SELECT max(seq) FROM log WHERE doc_id = c_custkey AND state = 'F'), 0) AS snapshot_seq FROM customer")
def compact_watermark(spark, d):
    docs = documents(spark, d).withColumn("snapshot_seq", F.lit(0).cast("long"))
    return store.compact(docs, log(spark, d).select("doc_id", "seq"), log(spark, d).where("state = 'F'").select("doc_id", "seq"))[0].select("doc_id", "snapshot_seq")


@query(f"WITH {LOG} SELECT doc_id, seq FROM log WHERE doc_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def delete_cascade(spark, d):
    return store.delete_documents(log(spark, d).select("doc_id", "seq"), documents(spark, d).where("owner_id = 3"))


@query(f"WITH {LOG} SELECT c_custkey AS doc_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM log WHERE doc_id = c_custkey AND created_at >= TIMESTAMP '2000-06-01')")
def retention_idle(spark, d):
    docs = documents(spark, d).withColumn("updated_at", F.lit("1995-01-01").cast("timestamp_ntz"))
    return store.idle_documents(docs, log(spark, d), F.lit("2000-06-01").cast("timestamp_ntz")).select("doc_id")


@query(f"WITH {LOG} SELECT doc_id, count(*) AS updates FROM log GROUP BY ALL")
def update_count(spark, d):
    return store.update_counts(log(spark, d))


@query(f"WITH {LOG} SELECT c_custkey AS doc_id, c_name AS name, (SELECT count(*) FROM log WHERE doc_id = c_custkey) AS updates FROM customer WHERE c_nationkey = 7 ORDER BY name, doc_id LIMIT 51")
def list_with_counts(spark, d):
    return store.list_page(documents(spark, d), log(spark, d), 50, owner=7).select("doc_id", "name", "updates")


@query("SELECT c_custkey AS doc_id, c_name AS name FROM customer WHERE (c_name, c_custkey) > ('Customer#000000100', 100) ORDER BY c_name, c_custkey LIMIT 101")
def keyset_page(spark, d):
    return store.list_page(documents(spark, d), log(spark, d), 100, after=("Customer#000000100", 100)).select("doc_id", "name")


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'untitled-' || c_custkey ELSE c_name END AS name FROM customer")
def backfill_name(spark, d):
    blank = documents(spark, d).withColumn("name", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("name")))
    return store.set_if_empty(blank, "name", F.concat(F.lit("untitled-"), F.col("doc_id"))).select("doc_id", "name")


@query(f"""WITH RECURSIVE {LOG}, o AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(created_at AS DATE)) AS day, row_number() OVER (PARTITION BY doc_id ORDER BY created_at, seq) AS rn FROM log),
    f AS (SELECT doc_id, rn, seq, day AS kept_day, state AS kept_state, true AS keep FROM o WHERE rn = 1
    UNION ALL SELECT o.doc_id, o.rn, o.seq, CASE WHEN o.day - kept_day >= 90 AND o.state <> kept_state THEN o.day ELSE kept_day END, CASE WHEN o.day - kept_day >= 90 AND o.state <> kept_state THEN o.state ELSE kept_state END, o.day - kept_day >= 90 AND o.state <> kept_state
    FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1) SELECT doc_id, seq FROM f WHERE keep""")
def version_gate(spark, d):
    return store.gate_versions(log(spark, d), 90, at="created_at")


@query(f"WITH {LOG} SELECT doc_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS rn FROM log) WHERE rn <= 5")
def prune_topk(spark, d):
    return store.prune(log(spark, d), 5, order="seq").select("doc_id", "seq")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders UNION ALL SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem")
def referenced_keys(spark, d):
    return store.referenced_keys((read(spark, d, "orders"), "o_orderkey"), (read(spark, d, "lineitem"), "l_orderkey"))


@query("""SELECT CAST(k AS VARCHAR) AS key, state FROM (SELECT k, 'orphan' AS state FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')
    UNION ALL SELECT k, 'dangling' FROM (SELECT o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) WHERE k % 10 <> 0)""")
def orphans_except(spark, d):
    named = store.referenced_keys((read(spark, d, "orders").where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")), "o_custkey"))
    there = read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"))
    return store.audit_keys(named, there)


@query(f"WITH {LOG} SELECT doc_id, count(*) AS versions FROM log GROUP BY ALL")
def version_counts(spark, d):
    return store.version_counts(log(spark, d))


@query(f"WITH {LOG} SELECT doc_id, 'versions/' || doc_id || '/' || seq AS blob_key FROM log WHERE state = 'O' AND doc_id IN (SELECT c_custkey FROM customer) AND doc_id NOT IN (SELECT doc_id FROM log WHERE created_at >= TIMESTAMP '1998-01-01')")
def idle_version_keys(spark, d):
    docs = documents(spark, d).withColumn("updated_at", F.lit("1995-01-01").cast("timestamp_ntz"))
    versions = log(spark, d).withColumn("blob_key", F.when(F.col("state") == "O", store.blob_key("versions", F.col("doc_id"), F.col("seq"))).otherwise(""))
    return store.idle_version_keys(versions, docs, log(spark, d), F.lit("1998-01-01").cast("timestamp_ntz"))


@query(f"WITH {LOG} SELECT c_custkey AS doc_id, 'snapshots/' || c_custkey || '/7' AS snapshot_key FROM customer WHERE c_custkey % 2 = 0 AND c_custkey IN (SELECT doc_id FROM log)")
def superseded_keys(spark, d):
    docs = documents(spark, d).withColumn("snapshot_key", F.when(F.col("doc_id") % 2 == 0, store.blob_key("snapshots", F.col("doc_id"), F.lit(7))).otherwise(""))
    return store.superseded_keys(docs, log(spark, d))


@query(f"WITH {LOG} SELECT doc_id, arg_min(state, (created_at, seq)) AS owner FROM log GROUP BY doc_id")
def first_owner(spark, d):
    return store.first_owners(log(spark, d), "doc_id", "state", "created_at", "seq")


@query(f"WITH {LOG} SELECT max(seq) AS max_seq, count(*) AS n, max(seq) >= count(*) AS sane FROM log")
def sequence_sanity(spark, d):
    return log(spark, d).agg(F.max("seq").alias("max_seq"), F.count(F.lit(1)).alias("n"), (F.max("seq") >= F.count(F.lit(1))).alias("sane"))


# -- rooms -------------------------------------------------------------------------------------------


@query(with_ops("SELECT o.doc, o.client, count(*) AS sent, any_value(m) - 1 AS receivers, count(*) * (any_value(m) - 1) AS deliveries FROM ops o JOIN (SELECT doc, count(DISTINCT client) AS m FROM ops GROUP BY ALL) s ON o.doc = s.doc GROUP BY ALL"))
def fanout_pairs(spark, d):
    return rooms.deliveries(ops(spark, d), ops(spark, d).select("doc", "client"))


@query(with_ops("SELECT doc, count(*) FILTER (client % 3 <> 1) AS applied, count(*) FILTER (client % 3 = 1) AS own FROM ops GROUP BY ALL"))
def self_filtered(spark, d):
    return ops(spark, d).groupBy("doc").agg(F.count_if(F.col("client") % 3 != 1).alias("applied"), F.count_if(F.col("client") % 3 == 1).alias("own"))


@query(with_ops("SELECT client % 3 AS node, count(*) FILTER (doc = 'click') AS click, count(*) FILTER (doc = 'view') AS view, count(*) FILTER (k % 2 = 0) AS published, sum(len) AS units FROM ops GROUP BY ALL"))
def cluster_counters(spark, d):
    return ops(spark, d).groupBy((F.col("client") % 3).alias("node")).agg(F.count_if(F.col("doc") == "click").alias("click"), F.count_if(F.col("doc") == "view").alias("view"), F.count_if(F.col("k") % 2 == 0).alias("published"), F.sum("len").alias("units"))


@query(with_ops("SELECT doc, client, arg_max(s, (clock, s IS NULL, 1)) FILTER (true) AS state, max(clock) AS clock, max(ts) AS seen FROM (SELECT *, CAST(k AS VARCHAR) AS s FROM ops WHERE clock > 0) GROUP BY ALL"))
def presence_latest(spark, d):
    return rooms.presence(ops(spark, d).withColumn("state", F.col("k").cast("string")))


@query(with_ops(f"SELECT doc, client, max(ts) AS seen FROM ops GROUP BY ALL HAVING max(ts) <= TIMESTAMP '{NOW}' - INTERVAL 2 DAY"))
def presence_expired(spark, d):
    seen = ops(spark, d).groupBy("doc", "client").agg(F.max("ts").alias("seen"))
    return rooms.expired(seen, F.lit(NOW).cast("timestamp_ntz"), "2 days")


def _sessions_sql(seconds: int, key: str) -> str:
    return with_ops(f"""SELECT {key}, session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (SELECT *, sum(CASE WHEN ts - prev >= to_seconds({seconds}) THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts, seq) AS session
        FROM (SELECT *, lag(ts) OVER (PARTITION BY {key} ORDER BY ts, seq) AS prev FROM ops)) GROUP BY ALL""")


@query(_sessions_sql(1800, "doc, client"))
def presence_sessions(spark, d):
    return rooms.sessions(ops(spark, d), 1800, ("doc", "client"))


@query(_sessions_sql(300, "doc"))
def idle_sessions(spark, d):
    return rooms.sessions(ops(spark, d), 300, ("doc",), block_seconds=86_400)


@query(with_ops("SELECT doc, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM ops GROUP BY ALL"))
def hook_tumbling(spark, d):
    return metrics.tumbling(ops(spark, d), "6 hours", ("doc",))


@query(with_ops("SELECT doc, seq, round(count(*) OVER (PARTITION BY doc ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) / 21600.0, 9) AS rate FROM ops"))
def rate_5m(spark, d):
    return metrics.windowed_rate(ops(spark, d), 21600, ("doc",)).select("doc", "seq", F.round("rate", 9).alias("rate"))


@query(with_ops("SELECT doc, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n, round(count(*) / 86400.0, 9) AS rate FROM ops GROUP BY ALL"))
def rate_by_type(spark, d):
    return metrics.tumbling(ops(spark, d), "1 day", ("doc",)).withColumn("rate", F.round(F.col("n") / 86400, 9))


@query(with_ops("SELECT doc, k % 4 AS result, count(*) AS n, sum(len) AS units FROM ops GROUP BY ALL"))
def counter_by_label(spark, d):
    return ops(spark, d).groupBy("doc", (F.col("k") % 4).alias("result")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("units"))


@query(f"""WITH RECURSIVE {OPS}, o AS (SELECT client, seq, len, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client ORDER BY ts, seq) AS rn FROM ops),
    f AS (SELECT client, rn, seq, t, CAST(8 - len AS DOUBLE) AS tokens FROM o WHERE rn = 1 UNION ALL SELECT o.client, o.rn, o.seq, o.t, least(8.0, f.tokens + (o.t - f.t) / 1e6 * 0.0001) - o.len FROM f JOIN o ON o.client = f.client AND o.rn = f.rn + 1)
    SELECT client, seq, round(tokens, 6) AS tokens, round(CASE WHEN tokens < 0 THEN least(-tokens / 0.0001, 80000.0) ELSE 0 END, 3) AS wait FROM f""")
def token_bucket(spark, d):
    out = rooms.token_bucket(ops(spark, d), 8, 0.0001)
    return out.select("client", "seq", F.round("tokens", 6).alias("tokens"), F.round("wait", 3).alias("wait"))


@query(with_ops("SELECT doc, client, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc, client ORDER BY ts, seq) AS n FROM ops) WHERE n <= 3"))
def per_key_cap(spark, d):
    return rooms.admitted(ops(spark, d), 3, ("doc", "client"), ("ts", "seq")).select("doc", "client", "seq")


@query(f"""WITH RECURSIVE {OPS}, o AS (SELECT doc, client, ts, row_number() OVER (PARTITION BY doc, client ORDER BY ts, seq) AS rn FROM ops),
    f AS (SELECT doc, client, rn, ts AS fetched, false AS hit FROM o WHERE rn = 1
    UNION ALL SELECT o.doc, o.client, o.rn, CASE WHEN o.ts - fetched < to_seconds(43200) THEN fetched ELSE o.ts END, o.ts - fetched < to_seconds(43200) FROM f JOIN o ON o.doc = f.doc AND o.client = f.client AND o.rn = f.rn + 1)
    SELECT doc, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses FROM f GROUP BY ALL""")
def cache_hits(spark, d):
    return rooms.cache_hits(ops(spark, d), 43200, ("doc", "client")).groupBy("doc").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


@query(with_ops(f"SELECT doc, client, CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) END AS state, seen FROM (SELECT doc, client, arg_max(k, (clock)) AS k, max(ts) AS seen FROM ops GROUP BY ALL) WHERE k % 2 = 0 OR seen > TIMESTAMP '{NOW}' - INTERVAL 2 DAY"))
def presence_forgotten(spark, d):
    last = ops(spark, d).groupBy("doc", "client").agg(F.max_by("k", "clock").alias("k"), F.max("ts").alias("seen"))
    states = last.select("doc", "client", F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).alias("state"), "seen")
    return rooms.forgotten(states, F.lit(NOW).cast("timestamp_ntz"), "2 days", 1 << 20)


@query(with_ops("SELECT doc, client, clock FROM (SELECT doc, client, max(clock) AS clock, arg_max(k, clock) AS k FROM ops GROUP BY ALL) WHERE k % 2 = 0 AND client % 3 = 0"))
def presence_disconnect(spark, d):
    last = ops(spark, d).groupBy("doc", "client").agg(F.max_by("k", "clock").alias("k"), F.max("clock").alias("clock"))
    states = last.withColumn("state", F.when(F.col("k") % 2 == 0, F.col("k").cast("string")))
    return rooms.disconnect(states, ops(spark, d).where("client % 3 = 0"))


@query(with_ops("""SELECT u.doc, u.client, u.clock, u.state, u.sender FROM (SELECT doc, client, max(clock) AS clock, CAST(arg_max(k, clock) AS VARCHAR) AS state, arg_max(seq, clock) AS sender FROM ops WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY ALL) u
    LEFT JOIN (SELECT doc, client, max(clock) AS held FROM ops WHERE ts < TIMESTAMP '2024-01-15' GROUP BY ALL) h ON u.doc = h.doc AND u.client = h.client WHERE u.clock > coalesce(held, 0)"""))
def presence_ingest(spark, d):
    early = F.col("ts") < F.lit(CUTOFF).cast("timestamp_ntz")
    rows = ops(spark, d).withColumns({"state": F.col("k").cast("string"), "sender": F.col("seq")})
    return rooms.ingest(rooms.presence(rows.where(early)), rows.where(~early))


@query(f"""WITH RECURSIVE {OPS}, o AS (SELECT doc, client, seq, epoch_us(ts) AS t, k % 7 = 0 AS durable, row_number() OVER (PARTITION BY doc, client ORDER BY ts, seq) AS rn FROM ops),
    f AS (SELECT doc, client, seq, rn, t AS first, CAST(0 AS BIGINT) AS batch, 1 AS n, durable AS shut FROM o WHERE rn = 1
    UNION ALL SELECT o.doc, o.client, o.seq, o.rn, CASE WHEN shut OR n >= 3 OR o.t - first >= 86400000000 THEN o.t ELSE first END, CASE WHEN shut OR n >= 3 OR o.t - first >= 86400000000 THEN batch + 1 ELSE batch END, CASE WHEN shut OR n >= 3 OR o.t - first >= 86400000000 THEN 1 ELSE n + 1 END, o.durable
    FROM f JOIN o ON o.doc = f.doc AND o.client = f.client AND o.rn = f.rn + 1) SELECT doc, client, seq, batch FROM f""")
def durable_flushes(spark, d):
    return rooms.flushes(ops(spark, d).withColumn("durable", F.col("k") % 7 == 0), 3, 86_400_000, ("doc", "client"))


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, sum(length(c_name) * 100) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey ROWS UNBOUNDED PRECEDING) AS running FROM customer) WHERE running > 20000")
def lru_budget(spark, d):
    sized = read(spark, d, "customer").withColumn("bytes", F.length("c_name") * 100)
    return rooms.evicted(sized, 20000, ("c_nationkey",), "c_acctbal", "bytes", "c_custkey").select("c_nationkey", "c_custkey")


# -- metrics -----------------------------------------------------------------------------------------

BUCKETS_SQL = "buckets AS (SELECT doc, le, count(*) FILTER (value <= le) AS n FROM ops, (VALUES (1.0::DOUBLE), (3.0), (9.0), (27.0), (81.0), (243.0), ('inf'::DOUBLE)) t(le) GROUP BY ALL)"


@query(with_ops("SELECT doc, CAST(le AS VARCHAR) AS le, n FROM buckets WHERE le < 1000", BUCKETS_SQL))
def histogram_buckets(spark, d):
    return metrics.histogram(ops(spark, d), "value", LES, ("doc",)).where("le < 1000").select("doc", F.col("le").cast("string").alias("le"), "n")


@query(with_ops("""SELECT doc, round(CASE WHEN le = 'inf'::DOUBLE THEN lower ELSE lower + (le - lower) * (0.99 * total - below) / (n - below) END, 6) AS value FROM
    (SELECT *, coalesce(lag(le) OVER (PARTITION BY doc ORDER BY le), 0) AS lower, coalesce(lag(n) OVER (PARTITION BY doc ORDER BY le), 0) AS below, max(n) OVER (PARTITION BY doc) AS total FROM buckets) WHERE n >= 0.99 * total AND below < 0.99 * total""", BUCKETS_SQL))
def histogram_quantile(spark, d):
    return metrics.histogram_quantile(0.99, metrics.histogram(ops(spark, d), "value", LES, ("doc",)), ("doc",)).select("doc", F.round("value", 6).alias("value"))


@query(with_ops("""SELECT doc, min(start) AS started, count(*) AS n FROM (SELECT *, epoch(start) // 21600 - row_number() OVER (PARTITION BY doc ORDER BY start) AS step FROM
    (SELECT doc, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM ops GROUP BY ALL) WHERE n >= 4) GROUP BY doc, step HAVING count(*) >= 3"""))
def alert_sustained(spark, d):
    return metrics.sustained(metrics.tumbling(ops(spark, d), "6 hours", ("doc",)), F.col("n") >= 4, 3, 21600, ("doc",))


@query(with_ops("""SELECT doc, count(*) AS n, max(value) FILTER (place = least(floor(0.5 * c), c - 1)) AS p50, max(value) FILTER (place = least(floor(0.95 * c), c - 1)) AS p95, max(value) FILTER (place = least(floor(0.99 * c), c - 1)) AS p99, max(value) AS max FROM
    (SELECT doc, value, row_number() OVER (PARTITION BY doc ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY doc) AS c FROM ops) GROUP BY doc"""))
def latency_percentiles(spark, d):
    return metrics.index_percentiles(ops(spark, d), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99, "max": 1.0}, ("doc",))


@query(with_ops("""SELECT r.seq, epoch_us(r.ts) - epoch_us(s.ts) AS micros FROM (SELECT * FROM ops WHERE k % 2 = 1) r LEFT JOIN (SELECT * FROM ops WHERE k % 2 = 0) s
    ON r.client = s.client AND r.ts >= s.ts AND r.ts <= s.ts + INTERVAL 12 HOUR"""))
def latency_match(spark, d):
    sent = ops(spark, d).where("k % 2 = 0").select(F.col("client").alias("key"), "ts")
    received = ops(spark, d).where("k % 2 = 1").select(F.col("client").alias("key"), "ts", "seq")
    return metrics.match_latency(sent, received, 43_200).select("seq", "micros")


@query(with_ops("SELECT doc, count(DISTINCT client) AS clients, count(*) AS sent, count(*) * (count(DISTINCT client) - 1) AS expected FROM ops GROUP BY ALL"))
def delivery_ratio(spark, d):
    return metrics.delivery(ops(spark, d))


SETS_SQL = " UNION ALL ".join(f"SELECT '{name}' AS name, doc, '{le}' AS le, count(*) FILTER (value * {scale} <= CAST('{le}' AS DOUBLE)) AS n FROM ops GROUP BY ALL" for name, (start, factor, n) in metrics.BUCKET_SETS.items() for scale in [start] for le in metrics.bounds(start, factor, n))


@query(with_ops(SETS_SQL))
def histogram_sets(spark, d):
    """The fixed bucket sets, each over values of its own scale."""
    out = None
    for name, (start, factor, n) in metrics.BUCKET_SETS.items():
        les = metrics.bounds(start, factor, n)
        each = metrics.histogram(ops(spark, d).withColumn("scaled", F.col("value") * float(start)), "scaled", les, ("doc",)).where(F.col("le") < float("inf"))
        names = F.create_map(*[F.lit(x) for le in les for x in (float(le), str(le))])
        rows = each.select(F.lit(name).alias("name"), "doc", F.element_at(names, F.col("le")).alias("le"), "n")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(with_ops("SELECT doc, round(sum(value) / sum(len), 9) AS ratio FROM ops GROUP BY ALL"))
def ratio_of_rates(spark, d):
    sums = lambda c: ops(spark, d).groupBy("doc").agg(F.sum(c).alias("value"))
    return metrics.ratio(sums("value"), sums("len"), ("doc",)).select("doc", F.round("ratio", 9).alias("ratio"))


@query(with_ops("SELECT client, count(*) AS n FROM ops GROUP BY client HAVING count(*) > 2 AND client IN (SELECT client FROM ops GROUP BY client HAVING sum(len) > 20)"))
def vector_and(spark, d):
    each = ops(spark, d).groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("units"))
    return metrics.both(each.where("n > 2").select("client", "n"), each.where("units > 20"), ("client",))


@query(with_ops("SELECT client, doc, sum(k % 3) AS value FROM ops WHERE regexp_full_match(doc, 'c.*|view') GROUP BY ALL HAVING sum(k % 3) = 0"))
def down_targets(spark, d):
    return metrics.at_zero(ops(spark, d).groupBy("client", "doc").agg(F.sum(F.col("k") % 3).alias("value")), "doc", "c.*|view")


@query(with_ops("SELECT sum(published) AS published, sum(received) AS received, sum(received) > sum(published) * 2 AS looped FROM (SELECT client % 3 AS node, count(*) FILTER (k % 2 = 0) AS published, count(*) FILTER (k % 2 = 1) AS received FROM ops GROUP BY ALL)"))
def replica_totals(spark, d):
    each = ops(spark, d).groupBy((F.col("client") % 3).alias("node")).agg(F.count_if(F.col("k") % 2 == 0).alias("published"), F.count_if(F.col("k") % 2 == 1).alias("received"))
    return metrics.replica_totals(each, 3)


@query(with_ops("SELECT doc, min(step) AS micros FROM (SELECT doc, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY doc ORDER BY ts, seq) AS step FROM ops) WHERE step > 0 GROUP BY ALL"))
def clock_resolution(spark, d):
    return metrics.clock_resolution(ops(spark, d), ("doc",))


STATUS_SQL = "CASE k % 6 WHEN 0 THEN 200 WHEN 1 THEN 204 WHEN 2 THEN 401 WHEN 3 THEN 404 WHEN 4 THEN 503 ELSE 409 END"


@query(with_ops(f"SELECT doc, CASE WHEN s < 400 THEN 'ok' WHEN s IN (401, 403) THEN 'denied' WHEN s >= 500 THEN 'failed' ELSE 'refused' END AS result, count(*) AS n FROM (SELECT doc, {STATUS_SQL} AS s FROM ops) GROUP BY ALL"))
def audit_results(spark, d):
    return ops(spark, d).groupBy("doc", scalars.result_class(F.expr(STATUS_SQL)).alias("result")).agg(F.count(F.lit(1)).alias("n"))


# -- functions ---------------------------------------------------------------------------------------


@query("SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS units FROM documents")
def utf16_len(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.utf16_length(F.col("text")).alias("units"))


@query(f"""SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT c_custkey, sha1(unhex('{SPACE}') || encode(c_name)) AS h FROM customer)""")
def uuid5_names(spark, d):
    return read(spark, d, "customer").select("c_custkey", scalars.document_id(F.col("c_name"), SPACE).alias("id"))


@query("SELECT doc_id, substr(sha256(text), 1, 8) AS fingerprint, substr(sha256(text), 1, 32) AS key FROM documents")
def fingerprint(spark, d):
    return read(spark, d, "documents").select("doc_id", scalars.fingerprint(F.col("text")).alias("fingerprint"), scalars.update_key(F.col("text")).alias("key"))


@query("SELECT c_custkey, c_custkey % 900 * CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END AS bytes FROM customer")
def parse_bytes(spark, d):
    unit = F.expr("element_at(array('', 'KB', 'MiB', 'G'), cast(c_custkey % 4 as int) + 1)")
    return read(spark, d, "customer").select("c_custkey", scalars.parse_bytes(F.concat((F.col("c_custkey") % 900).cast("string"), unit)).alias("bytes"))


@query(with_ops("SELECT seq, CASE WHEN x < 128 THEN 1 WHEN x < 16384 THEN 2 WHEN x < 2097152 THEN 3 WHEN x < 268435456 THEN 4 WHEN x < 34359738368 THEN 5 WHEN x < 4398046511104 THEN 6 ELSE 7 END AS size FROM (SELECT seq, k * k * k * k * (client + 1) AS x FROM ops)"))
def varuint_size(spark, d):
    return ops(spark, d).select("seq", scalars.varuint_size(F.expr("k * k * k * k * (client + 1)")).cast("int").alias("size"))


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("props").startswith("{").alias("is_object"))


@query(with_ops("SELECT seq, CASE WHEN client % 5 <> 0 AND k + 30 > 50 THEN CASE WHEN k % 2 = 0 THEN 'write' ELSE 'read' END END AS permission FROM ops"))
def grant_check(spark, d):
    token = F.when(F.col("client") % 5 != 0, F.col("doc"))
    return ops(spark, d).select("seq", scalars.grant(F.col("doc"), token, F.when(F.col("k") % 2 == 0, F.lit("write")), F.col("k"), F.lit(50)).alias("permission"))


@query("SELECT c_custkey, c_custkey || '/' || c_name || '/x' AS cursor, CAST(c_custkey AS VARCHAR) AS id, c_name || '/x' AS name FROM customer")
def cursors(spark, d):
    made = read(spark, d, "customer").select("c_custkey", scalars.format_cursor(F.concat(F.col("c_name"), F.lit("/x")), F.col("c_custkey").cast("string")).alias("cursor"))
    return made.withColumn("p", scalars.parse_cursor(F.col("cursor"))).select("c_custkey", "cursor", "p.id", "p.name")


@query(with_ops("SELECT seq, CASE WHEN k % 3 = 0 THEN '203.0.113.' || k ELSE '198.51.100.' || (client % 250) END AS ip FROM ops"))
def client_ips(spark, d):
    peer_ip = F.when(F.col("k") % 3 == 0, F.concat(F.lit("203.0.113."), F.col("k"))).otherwise(F.lit("10.0.0.9"))
    seen = F.concat(F.lit("192.0.2.1, 198.51.100."), (F.col("client") % 250).cast("string"), F.lit(", 10.1.2.3"))
    return ops(spark, d).select("seq", scalars.client_ip(seen, peer_ip, ["10.0.0.0/8"]).alias("ip"))


@query(with_ops("SELECT seq, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM ops"))
def event_times(spark, d):
    return ops(spark, d).select("seq", scalars.rfc3339(F.col("ts")).alias("at"))


@query(with_ops("SELECT seq, k % 4 <> 0 AND k % 3 <> 0 AS refused FROM ops"))
def read_only_refused(spark, d):
    payload = F.when(F.col("k") % 3 == 0, F.lit(b"\x00\x00")).otherwise(F.lit(b"\x01\x00"))
    return ops(spark, d).select("seq", scalars.write_refused(F.when(F.col("k") % 4 == 0, "write").otherwise("read"), payload).alias("refused"))


@query(with_ops(f"SELECT doc, CASE WHEN s < 300 THEN 'sent' ELSE 'failed' END AS outcome, CASE WHEN s < 300 THEN NULL WHEN s >= 500 THEN 'server_error' ELSE 'client_error' END AS reason, s >= 500 AS retryable, count(*) AS n FROM (SELECT doc, {STATUS_SQL} AS s FROM ops) GROUP BY ALL"))
def delivery_outcomes(spark, d):
    each = ops(spark, d).select("doc", scalars.delivery_outcome(F.expr(STATUS_SQL), F.lit(None).cast("string")).alias("x"))
    return each.groupBy("doc", "x.outcome", "x.reason", "x.retryable").agg(F.count(F.lit(1)).alias("n"))


@query(with_ops("SELECT seq, k % 3 <> 2 AS fresh FROM ops"))
def etag_headers(spark, d):
    header = F.expr("element_at(array('*', concat('\"x\", W/\"', client, '\"'), concat('\"', client, '0\"')), cast(k % 3 as int) + 1)")
    return ops(spark, d).select("seq", scalars.etag_matches(header, F.col("client").cast("string")).alias("fresh"))


# -- the wire ----------------------------------------------------------------------------------------


@query(with_ops("SELECT seq, true AS same FROM ops"))
def varuint_roundtrip(spark, d):
    numbers = ops(spark, d).select("seq", F.expr("k * k * k * k * (client + 1)").alias("x"))
    return numbers.select("seq", (codec.decode_varuint(codec.encode_varuint("x")) == F.col("x")).alias("same"))


def updates(spark, d):
    """Each operation as an update on the wire."""
    text = F.substring(F.lit("abcde"), F.lit(1), F.col("len").cast("int"))
    return ops(spark, d).select("doc", "seq", "client", "clock", "len", codec.synthetic_updates(F.col("client"), F.col("clock"), F.col("doc"), text).alias("payload"))


@query(with_ops("SELECT doc, seq, client, clock, len FROM ops"))
def wire_roundtrip(spark, d):
    return codec.decode_updates(updates(spark, d)).where("error is null").select("doc", "seq", "client", "clock", "len")


@query(with_ops("SELECT CASE k % 5 WHEN 0 THEN 'sync_step1' WHEN 1 THEN 'sync_step2' WHEN 2 THEN 'update' WHEN 3 THEN 'awareness' ELSE 'query_awareness' END AS kind, count(*) AS n FROM ops GROUP BY ALL"))
def frame_classify(spark, d):
    kind = F.expr("element_at(array('sync_step1', 'sync_step2', 'update', 'awareness', 'query_awareness'), cast(k % 5 as int) + 1)")
    frames = ops(spark, d).select(codec.encode_frame(kind, F.encode(F.col("seq").cast("string"), "UTF-8")).alias("frame"))
    return frames.select(codec.decode_frame("frame").alias("m")).groupBy("m.kind").agg(F.count(F.lit(1)).alias("n"))


@query(with_ops("SELECT client % 3 AS origin, k % 3 AS kind, count(*) AS n FROM ops GROUP BY ALL"))
def envelope_classify(spark, d):
    sealed = ops(spark, d).select(codec.encode_envelope(F.col("client") % 3, F.col("k") % 3, F.encode(F.col("seq").cast("string"), "UTF-8")).alias("e"))
    return sealed.select(codec.decode_envelope("e").alias("m")).groupBy("m.origin", F.col("m.kind").cast("long").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def pack_stats(spark, d):
    rows = codec.packed_sizes(read(spark, d, "documents").select(F.encode("text", "UTF-8").alias("raw")), "raw")
    return rows.groupBy("codec").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw_bytes"), F.sum("stored").alias("stored_bytes"))
