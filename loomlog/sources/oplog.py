"""The logical relations of an operation log, read from tables.

An operation is a struct of a document that a client made: it takes the clocks
[clock, clock + len) of that client. `events` is such a log: the document is the event type, the client the user,
and each operation starts where the client's last one ended.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = T.StructType([T.StructField("client", T.LongType()), T.StructField("clock", T.LongType())])
#: One struct of a decoded update.
STRUCTS = T.StructType(
    [
        T.StructField("doc", T.StringType()), T.StructField("client", T.LongType()), T.StructField("clock", T.LongType()), T.StructField("len", T.LongType()),
        T.StructField("kind", T.StringType()), T.StructField("origin", ID), T.StructField("right_origin", ID), T.StructField("parent_root", T.StringType()),
        T.StructField("parent_item", ID), T.StructField("parent_sub", T.StringType()), T.StructField("content_ref", T.ByteType()), T.StructField("content", T.StringType()),
    ]
)
#: One line of the audit log.
AUDIT = "time timestamp, action string, result string, status int, document string, credential string, ip string, method string, path string, bytes long, duration_ms double, error string"
DOCUMENTS = "id string, owner_id string, name string, snapshot binary, snapshot_codec short, snapshot_key string, snapshot_bytes long, snapshot_seq long, updated_at timestamp"
UPDATES = "doc_id string, seq long, payload binary, created_at timestamp"
VERSIONS = "doc_id string, id long, created_at timestamp, state_vector binary, payload binary, codec short, blob_key string, blob_bytes long, label string"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, client, seq, ts, k, value, len, clock) of every event."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("doc"), F.col("user_id").alias("client"), F.col("event_id").alias("seq"), "ts", k.alias("k"), "value", (1 + k % 5).alias("len"))
    before = Window.partitionBy("doc", "client").orderBy("ts", "seq")
    return rows.withColumn("clock", F.sum("len").over(before) - F.col("len"))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit events, one JSON object a line; a line that is not one becomes a row of nulls."""
    return spark.read.schema(AUDIT).json(path)


def write_audit(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_blobs(spark: SparkSession, root: str) -> DataFrame:
    """(key, bytes): the objects under root by their path below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.element_at(F.split("path", F.lit(root.rstrip("/").split(":")[-1] + "/")), -1)
    return files.select(below.alias("key"), F.col("content").alias("bytes"))


def resolve_blobs(rows: DataFrame, blobs: DataFrame, key: str = "snapshot_key", inline: str = "snapshot") -> DataFrame:
    """`payload`: the inline bytes where the key is empty, else the object of that key."""
    held = blobs.select(F.col("key").alias("__key"), F.col("bytes").alias("__bytes"))
    joined = rows.join(held, (F.col(key) == F.col("__key")) & (F.col(key) != ""), "left")
    return joined.withColumn("payload", F.when(F.col(key) == "", F.col(inline)).otherwise(F.col("__bytes"))).drop("__key", "__bytes")


def fixture_structs(spark: SparkSession, path: str) -> DataFrame:
    """Rows (scenario, n, doc, decoded) of files `updates.json`; decoded is kept as JSON text."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "updates.json").text(path).select("value", F.input_file_name().alias("file"))
    each = F.from_json("value", "array<struct<doc:string,local:boolean,decoded:string>>")
    scenario = F.element_at(F.split("file", "/"), -2)
    return files.select(scenario.alias("scenario"), F.posexplode(each).alias("n", "u")).select("scenario", "n", "u.doc", "u.local", "u.decoded")
