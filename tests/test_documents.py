import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomlog.functions import codec
from loomlog.operators import documents as D

AT = dt.datetime(2024, 1, 1)
HELLO = bytes.fromhex("0101e907000401047465787405" + b"Hello".hex() + "00")
DOCS = "doc_id string, name string, owner_id string, snapshot binary, snapshot_seq long, updated_at timestamp"
LOG = "doc_id string, seq long, payload binary, created_at timestamp"
VERSIONS = "doc_id string, id long, created_at timestamp, state string, payload binary, label string"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([("a", "one", D.NIL, HELLO, 0, AT), ("b", "", "o", None, 0, AT)], DOCS)
    log = spark.createDataFrame([("b", 1, HELLO, AT), ("b", 2, b"\xff", AT)], LOG)
    versions = spark.createDataFrame([("a", 1, AT, "s1", b"x", ""), ("a", 2, AT, "s2", b"xy", "")], VERSIONS)
    return docs, log, versions


def ids(spark, *which):
    return spark.createDataFrame([(x,) for x in which], "doc_id string")


def test_read(spark, tables):
    docs, log, _ = tables
    got = {r.doc: (bytes(r.payload), r.skipped) for r in D.read_documents(docs, log, ids(spark, "a", "b")).collect()}
    assert got == {"a": (HELLO, 0), "b": (HELLO, 1)}
    peer = spark.createDataFrame([("a", 1001, 3)], "doc string, client long, state long")
    part = {r.doc: codec.read_update(bytes(r.payload))[0][0] for r in D.read_documents(docs, log, ids(spark, "a"), peer).collect()}
    assert part["a"]["content"] == {"str": "lo"} and part["a"]["origin"] == (1001, 2)
    broken = docs.withColumn("snapshot", F.lit(b"\xff"))
    with pytest.raises(Exception, match="does not parse"):
        D.read_documents(broken, log, ids(spark, "a")).collect()


def test_list(spark, tables):
    docs, log, versions = tables
    assert [r.doc_id for r in D.list_documents(docs, log, owner="").collect()] == ["a"]
    assert [r.doc_id for r in D.list_documents(docs, log, after="b/").collect()] == ["a"]
    with pytest.raises(ValueError):
        D.list_documents(docs, log, after="b")
    with pytest.raises(ValueError):
        D.list_documents(docs, log, limit=0)
    assert [(r.id, r.bytes) for r in D.list_versions(versions, ids(spark, "a"), 1).collect()] == [(2, 2)]
    assert bytes(D.read_version(versions, "a", 1).first().payload) == b"x"


def test_merge_verdicts(spark, tables):
    offered = spark.createDataFrame([("b", HELLO), ("c", b""), ("d", b"\xff"), ("e", None)], "doc_id string, payload binary")
    got = {r.doc_id: (r.verdict, r.seq) for r in D.accept_merge(tables[1], offered).collect()}
    assert got == {"b": ("accepted", 3), "c": ("empty", None), "d": ("malformed", None), "e": ("empty", None)}


def test_owner_and_delete(spark, tables):
    docs, log, versions = tables
    changes = spark.createDataFrame([("a", "x", "n"), ("b", "y", "m")], "doc_id string, owner_id string, name string")
    got = {r.doc_id: (r.owner_id, r.name) for r in D.set_owner(docs, changes, ids(spark, "a")).collect()}
    assert got == {"a": (D.NIL, "one"), "b": ("y", "m")}
    left = D.delete(docs, log, versions, ids(spark, "a", "b"), ids(spark, "a"))
    assert [t.count() for t in left] == [1, 0, 2]


def test_take_versions(spark, tables):
    offered = spark.createDataFrame([("a", "s2", b"n", ""), ("b", "s1", b"n", "")], "doc_id string, state string, payload binary, label string")
    at = F.lit(AT + dt.timedelta(hours=1))
    rows = lambda df: sorted((r.doc_id, r.id) for r in df.collect())
    assert rows(D.take_versions(tables[2], offered, at)) == [("a", 1), ("a", 2), ("b", 1)]
    other = offered.withColumn("state", F.lit("s3"))
    assert rows(D.take_versions(tables[2], other, at, "2 hours")) == [("a", 1), ("a", 2), ("b", 1)]
    assert rows(D.take_versions(tables[2], other, at, keep=2)) == [("a", 2), ("a", 3), ("b", 1)]


def test_presence_limits(spark):
    rows = spark.createDataFrame([("d", i, "x" * (5000 if i == 1 else 3) if i else None, AT) for i in range(5)], "doc string, client long, state string, seen timestamp")
    assert sorted(r.client for r in D.presence_within_limits(rows, most_clients=2).collect()) == [2, 3]
    assert D.present_clients(rows).first().clients == [1, 2, 3, 4]
