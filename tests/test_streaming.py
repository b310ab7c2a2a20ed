"""Streams over files against their batch twins."""

import time

import pytest
from pyspark.sql import functions as F

from loomlog.operators import intervals, merge, metrics, rooms
from loomlog.plans import catalogue
from loomlog.sources.oplog import ops
from loomlog.streaming import oplog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ops"))
    times = ops(spark, SF).select(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [0.33, 0.66]).alias("x")).first().x
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    for part in (at <= times[0], (at > times[0]) & (at <= times[1]), at > times[1]):  # files in the order of time
        ops(spark, SF).where(part).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def collected(spark, df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    oplog.run(df, str(tmp_path / "checkpoint"), oplog.append_to(out), mode)
    return spark.read.parquet(out)


def rows(df, *columns):
    return sorted(tuple(str(x) for x in r) for r in df.select(*columns).collect())


def test_dedupe(spark, folder, tmp_path):
    twice = oplog.read_ops(spark, folder)
    got = collected(spark, oplog.deduped(twice.unionByName(twice)), tmp_path)
    assert rows(got, "doc", "client", "clock") == rows(ops(spark, SF), "doc", "client", "clock")


def test_state_vectors(spark, folder, tmp_path):
    got = collected(spark, oplog.state_vectors(oplog.read_ops(spark, folder)), tmp_path, "update")
    latest = got.groupBy("doc", "client").agg(F.max_by("state", "batch").alias("state"))
    assert rows(latest, "doc", "client", "state") == rows(intervals.state_vector(ops(spark, SF)), "doc", "client", "state")


def test_tumbling(spark, folder, tmp_path):
    got = collected(spark, oplog.tumbling(oplog.read_ops(spark, folder), "6 hours", "1 day"), tmp_path)
    want = metrics.tumbling(ops(spark, SF), "6 hours", ("doc",))
    closed, every = set(rows(got, "doc", "start", "n")), set(rows(want, "doc", "start", "n"))
    assert closed <= every and len(closed) > len(every) // 2


def test_token_bucket(spark, folder, tmp_path):
    got = collected(spark, oplog.token_bucket(oplog.read_ops(spark, folder), 8.0, 0.0001), tmp_path)
    want = rooms.token_bucket(ops(spark, SF), 8, 0.0001)
    assert rows(got, "client", "seq", F.round("tokens", 4)) == rows(want, "client", "seq", F.round("tokens", 4))


def test_presence(spark, folder, tmp_path):
    stream = oplog.read_ops(spark, folder).select("doc", "client", "clock", F.col("k").cast("string").alias("state"))
    got = collected(spark, oplog.presence(stream), tmp_path, "update").groupBy("doc", "client").agg(F.max_by("state", "clock").alias("state"))
    want = rooms.presence(ops(spark, SF).withColumn("state", F.col("k").cast("string")))
    assert rows(got, "doc", "client", "state") == rows(want, "doc", "client", "state")


def test_compaction_due(spark, folder, tmp_path):
    got = collected(spark, oplog.compaction_due(oplog.read_ops(spark, folder), 50), tmp_path)
    counts = {r.doc: r["count"] for r in ops(spark, SF).groupBy("doc").count().collect()}
    assert {r.doc: r.n for r in got.groupBy("doc").agg(F.max("n").alias("n")).collect()} == {d: n // 50 * 50 for d, n in counts.items() if n >= 50}


def test_answers_and_fan_out(spark, folder, tmp_path):
    got = collected(spark, oplog.answers(oplog.read_ops(spark, folder), catalogue.peer(spark, SF)), tmp_path)
    assert rows(got, "doc", "client", "seq", "clock", "len") == rows(catalogue.diff_since(spark, SF), "doc", "client", "seq", "clock", "len")


def test_materialise(spark, tmp_path):
    structs = catalogue.conversation_structs(spark, SF).where("cast(doc as int) < 40")
    source, log, view = (str(tmp_path / x) for x in ("in", "log", "view"))
    structs.repartition(3, "seq").write.parquet(source)
    stream = spark.readStream.schema(structs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    oplog.run(stream, str(tmp_path / "checkpoint"), oplog.materialise(log, view))
    assert rows(oplog.latest_texts(spark, view), "doc", "text") == rows(merge.texts(merge.integrate(structs)), "doc", "text")


def test_deliver(spark, tmp_path):
    out = str(tmp_path)

    def send(held):
        import os

        if not os.path.exists(f"{out}/failed"):
            open(f"{out}/failed", "w").close()
            raise OSError("once")
        open(f"{out}/{held[0]['id']}", "w").close()

    oplog.deliver(send)(spark.range(1), 0)
    import os

    assert sorted(os.listdir(out)) == ["0", "failed"]
