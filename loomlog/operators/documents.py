"""What an administrator asks of stored documents, as functions over the tables.

documents: doc_id, name, owner_id, snapshot, snapshot_seq, updated_at. log: doc_id, seq, payload, created_at.
versions: doc_id, id, created_at, state, payload, label.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.functions import codec
from loomlog.operators import merge, store

DEFAULT_LIMIT, MOST_LIMIT = 100, 1000
MOST_MERGE = 16 << 20
MOST_STATE, MOST_CLIENTS = 4096, 1024
NIL = "00000000-0000-0000-0000-000000000000"


def payloads(documents: DataFrame, log: DataFrame) -> DataFrame:
    """(doc, seq, payload) of snapshots and of every log row that is left."""
    snapshots = documents.where("snapshot is not null").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).cast("long").alias("seq"), F.col("snapshot").alias("payload"))
    return snapshots.unionByName(log.select(F.col("doc_id").cast("string").alias("doc"), "seq", "payload"))


def read_documents(documents: DataFrame, log: DataFrame, ids: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """(doc, payload, skipped): the state of documents, or what peers with the state vectors lack.

    Log rows that do not parse are counted; a snapshot that does not parse is an error.
    """
    wanted = payloads(documents, log).join(ids.select(F.col("doc_id").cast("string").alias("doc")), "doc", "left_semi")
    decoded = codec.decode_updates(wanted)
    broken = F.when((F.col("seq") == 0) & F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("the snapshot does not parse: "), F.col("doc")))).otherwise(F.lit(True))
    checked = decoded.where(broken)
    skipped = checked.groupBy("doc").agg(F.count_if(F.col("error").isNotNull()).alias("skipped"))
    return merge.encode(merge.integrate(checked), vectors).join(skipped, "doc", "left")


def list_documents(documents: DataFrame, log: DataFrame, owner: str | None = None, after: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A page of the catalogue; owner "" is the documents of nobody, None all; after is a cursor id/name."""
    if not 0 < limit <= MOST_LIMIT:
        raise ValueError(f"limit is from 1 to {MOST_LIMIT}")
    cursor = None
    if after is not None:
        doc_id, slash, name = after.partition("/")
        if not slash:
            raise ValueError("a cursor is an id, a slash and a name")
        cursor = (name, doc_id)
    sized = documents.withColumn("bytes", F.coalesce(F.octet_length("snapshot"), F.lit(0)))
    return store.list_page(sized.drop("snapshot"), log, limit, owner=NIL if owner == "" else owner, after=cursor)


def accept_merge(log: DataFrame, offered: DataFrame) -> DataFrame:
    """offered (doc_id, payload) with `verdict`: accepted, empty, oversized or malformed; log numbers go on from the last."""
    size = F.octet_length("payload")
    parsed = codec.decode_updates(offered.select(F.col("doc_id").cast("string").alias("doc"), F.monotonically_increasing_id().alias("seq"), "payload"))
    bad = parsed.where("error is not null").select(F.col("doc").alias("doc_id")).distinct().withColumn("bad", F.lit(True))
    last = log.groupBy("doc_id").agg(F.max("seq").alias("last"))
    keyed = offered.withColumn("doc_id", F.col("doc_id").cast("string")).join(bad, "doc_id", "left").join(last.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "left")
    verdict = F.when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MOST_MERGE, "oversized").when(F.col("bad"), "malformed").otherwise("accepted")
    order = Window.partitionBy("doc_id", "verdict").orderBy(F.md5("payload"))
    out = keyed.withColumn("verdict", verdict)
    return out.withColumn("seq", F.when(F.col("verdict") == "accepted", F.coalesce("last", F.lit(0)) + F.row_number().over(order))).drop("bad", "last")


def set_owner(documents: DataFrame, changes: DataFrame, resident: DataFrame) -> DataFrame:
    """documents with new owners (doc_id, owner_id, name); those that are open keep theirs."""
    new = changes.join(resident.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.col("owner_id").alias("new_owner"), F.col("name").alias("new_name"))
    joined = documents.join(new, "doc_id", "left")
    return joined.withColumn("owner_id", F.coalesce("new_owner", "owner_id")).withColumn("name", F.when(F.coalesce("name", F.lit("")) == "", F.col("new_name")).otherwise(F.col("name"))).drop("new_owner", "new_name")


def delete(documents: DataFrame, log: DataFrame, versions: DataFrame, ids: DataFrame, resident: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, log, versions) without the given documents, but for those that are open."""
    gone = ids.select("doc_id").join(resident.select("doc_id"), "doc_id", "left_anti")
    return store.delete_documents(documents, gone), store.delete_documents(log, gone), store.delete_documents(versions, gone)


def list_versions(versions: DataFrame, ids: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The newest versions of documents, sizes only."""
    sized = versions.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", "id", "created_at", "label", F.octet_length("payload").alias("bytes"))
    return store.prune(sized, limit)


def read_version(versions: DataFrame, doc_id, version_id: int) -> DataFrame:
    return versions.where((F.col("doc_id") == doc_id) & (F.col("id") == version_id))


def take_versions(versions: DataFrame, offered: DataFrame, at: Column, interval: str = "0 seconds", keep: int = 0) -> DataFrame:
    """versions after offers (doc_id, state, payload, label): one is refused if the last is younger than the
    interval or has the same state; where one was written only the `keep` newest stay (0: all)."""
    last = versions.groupBy("doc_id").agg(F.max("id").alias("last_id"), F.max_by("created_at", "id").alias("last_at"), F.max_by("state", "id").alias("last_state"))
    due = F.col("last_id").isNull() | ((F.col("last_at") + F.expr(f"interval {interval}") <= at) & ~F.col("state").eqNullSafe(F.col("last_state")))
    new = offered.join(last, "doc_id", "left").where(due).select("doc_id", (F.coalesce("last_id", F.lit(0)) + 1).cast("long").alias("id"), at.alias("created_at"), "state", "payload", "label")
    after = versions.select("doc_id", "id", "created_at", "state", "payload", "label").unionByName(new)
    if keep <= 0:
        return after
    written = new.select("doc_id").distinct()
    return store.prune(after.join(written, "doc_id", "left_semi"), keep).unionByName(after.join(written, "doc_id", "left_anti"))


def presence_within_limits(states: DataFrame, most_bytes: int = MOST_STATE, most_clients: int = MOST_CLIENTS) -> DataFrame:
    """Present clients whose state is small enough, and of those the first so many of each document."""
    small = states.where(F.col("state").isNotNull() & (F.octet_length("state") <= most_bytes))
    order = Window.partitionBy("doc").orderBy("seen", "client")
    return small.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_clients).drop("n")


def present_clients(states: DataFrame) -> DataFrame:
    """(doc, clients): who is there, in order."""
    return states.where("state is not null").groupBy("doc").agg(F.sort_array(F.collect_set("client")).alias("clients"))
