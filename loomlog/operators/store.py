"""Operators on the stored form: a catalogue of documents, an append-only log and versions.

Tables are values: what a statement would change in place is the table that it leaves behind.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators import blocks


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table with those rows whose key it does not have; a key that repeats in rows is inserted once."""
    fresh = rows.join(table.select(key), key, "left_anti").dropDuplicates([key])
    return table.unionByName(fresh.select(*table.columns))


def append_batch(batches: DataFrame, last_seq: int = 0) -> DataFrame:
    """(doc_id, payloads array) to (doc_id, seq, payload): one log row each, numbered for each document."""
    each = batches.select("doc_id", F.posexplode("payloads").alias("at", "payload"))
    return each.select("doc_id", (F.lit(last_seq) + F.col("at") + 1).alias("seq"), "payload")


def load_log(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Every document with every row of its log that is left, in the order of seq.

    Rows below the snapshot's own seq count too: identities are not committed in order.
    """
    return documents.join(log, "doc_id", "left")


def compact(documents: DataFrame, log: DataFrame, folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, log) after `folded` (doc_id, seq) went into the snapshots.

    A snapshot is only ever replaced by a later one. Exactly the folded rows go, not a range of seq.
    """
    upto = folded.groupBy("doc_id").agg(F.max("seq").alias("upto"))
    newer = documents.join(upto, "doc_id", "left").withColumn("snapshot_seq", F.when(F.col("upto") > F.col("snapshot_seq"), F.col("upto")).otherwise(F.col("snapshot_seq"))).drop("upto")
    fresh = upto.join(documents.select("doc_id", "snapshot_seq"), "doc_id").where("upto > snapshot_seq").select("doc_id")
    gone = folded.join(fresh, "doc_id", "left_semi").select("doc_id", "seq")
    return newer, log.join(gone, ["doc_id", "seq"], "left_anti")


def delete_documents(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("doc_id"), "doc_id", "left_anti")


def idle_documents(documents: DataFrame, log: DataFrame, before: Column) -> DataFrame:
    """Documents not updated since, neither themselves nor in their log."""
    recent = log.where(F.col("created_at") >= before).select("doc_id")
    return documents.where(F.col("updated_at") < before).join(recent, "doc_id", "left_anti")


def update_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id").agg(F.count(F.lit(1)).alias("updates"))


def list_page(documents: DataFrame, log: DataFrame, limit: int, owner=None, after: tuple | None = None) -> DataFrame:
    """Documents in the order of (name, id) after a cursor, with sizes and counts, `limit` and one more.

    The cursor is a (name, id) pair, as names repeat. Only the page's rows are joined to the log.
    """
    if not 0 < limit <= 1000:
        raise ValueError("limit is from 1 to 1000")
    rows = documents if owner is None else documents.where(F.col("owner_id") == owner)
    if after is not None:
        rows = rows.where(F.struct("name", "doc_id") > F.struct(F.lit(after[0]).alias("name"), F.lit(after[1]).alias("doc_id")))
    page = rows.orderBy("name", "doc_id").limit(limit + 1)
    counts = log.join(page.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count(F.lit(1)).alias("updates"))
    return page.join(counts, "doc_id", "left").na.fill(0, ["updates"])


def set_if_empty(table: DataFrame, column: str, value: Column) -> DataFrame:
    return table.withColumn(column, F.when(F.coalesce(column, F.lit("")) == "", value).otherwise(F.col(column)))


def gate_versions(offers: DataFrame, days: int, at: str = "at", key: str = "doc_id", order: str = "seq", same: str = "state") -> DataFrame:
    """Which offered versions are kept: the first, then each at least `days` after the last kept
    whose state differs from it."""

    def step(kept, r):
        keep = kept is None or r.day - kept[0] >= days and r.state != kept[1]
        return ((r.day, r.state) if keep else kept), ((r.key, r.o) if keep else None)

    rows = offers.select(F.col(key).cast("long").alias("key"), F.col(at).alias("t"), F.col(order).cast("long").alias("o"), F.unix_date(F.to_date(at)).alias("day"), F.col(same).cast("string").alias("state"))
    return blocks.fold(rows, ("key",), ("t", "o"), "key long, o long", None, step).select(F.col("key").alias(key), F.col("o").alias(order))


def version_counts(versions: DataFrame) -> DataFrame:
    """(doc_id, versions)."""
    return versions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("versions"))


def idle_version_keys(versions: DataFrame, documents: DataFrame, log: DataFrame, before: Column) -> DataFrame:
    """The blob keys of the versions of documents that are about to go as idle."""
    return versions.where("blob_key <> ''").join(idle_documents(documents, log, before).select("doc_id"), "doc_id", "left_semi").select("doc_id", "blob_key")


def superseded_keys(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The snapshot keys that a compaction of the documents leaves behind."""
    return documents.where("snapshot_key <> ''").join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "snapshot_key")


def blob_key(kind: str, doc_id: Column, of: Column) -> Column:
    """snapshots/<id>/<seq> or versions/<id>/<name>."""
    return F.concat_ws("/", F.lit(kind), doc_id.cast("string"), of.cast("string"))


def stored(payload: Column, key: Column, inline_most: int) -> Column:
    """(inline, key) of a payload: small ones stay in the row with an empty key, others go to the object of that key."""
    small = F.octet_length(payload) <= inline_most
    return F.struct(F.when(small, payload).alias("inline"), F.when(small, F.lit("")).otherwise(key).alias("key"))


def prune(versions: DataFrame, keep: int, key: str = "doc_id", order: str = "id") -> DataFrame:
    """The `keep` newest versions of each document; none are pruned if keep is 0."""
    if keep <= 0:
        return versions
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return versions.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= keep).drop("rn")


def referenced_keys(*tables: tuple[DataFrame, str]) -> DataFrame:
    """All blob keys that tables name."""
    out = None
    for table, column in tables:
        keys = table.where(F.coalesce(F.col(column).cast("string"), F.lit("")) != "").select(F.col(column).cast("string").alias("key"))
        out = keys if out is None else out.unionByName(keys)
    return out


def audit_keys(referenced: DataFrame, present: DataFrame) -> DataFrame:
    """(key, state): `orphan` keys that nothing names, and `dangling` ones that are named but not there."""
    orphan = present.select("key").subtract(referenced.select("key")).withColumn("state", F.lit("orphan"))
    return orphan.unionByName(referenced.select("key").subtract(present.select("key")).withColumn("state", F.lit("dangling")))


def first_owners(opens: DataFrame, key: str, owner: str, at: str, tie: str) -> DataFrame:
    """Who opened each document first, and so owns it."""
    return opens.groupBy(key).agg(F.min_by(owner, F.struct(at, tie)).alias("owner"))
