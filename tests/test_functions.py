"""Scalars, sources and store operators on hand-made cases."""

import base64
import datetime as dt
import json
import uuid

import pytest
from pyspark.sql import functions as F

from loomlog.functions import scalars as S
from loomlog.operators import intervals, metrics, rooms, store
from loomlog.sources import oplog


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_utf16(spark):
    texts = ["", "ab", "a🎉b", "é漢"]
    got = values(spark, [(t,) for t in texts], "t string", n=S.utf16_length(F.col("t")), mid=S.utf16_slice(F.col("t"), F.lit(1), F.lit(2)), cut=S.utf16_slice(F.col("t"), F.lit(0), F.lit(2)))
    assert [r["n"] for r in got] == [0, 2, 4, 2]
    assert got[2]["mid"] == "🎉" and got[2]["cut"] is None and got[1]["cut"] == "ab"


def test_ids(spark):
    space = uuid.NAMESPACE_DNS
    names = ["a", "Ü", str(uuid.UUID(int=5)).upper()]
    got = values(spark, [(n,) for n in names], "n string", id=S.document_id(F.col("n"), space.hex), owner=S.owner_id(F.lit(""), space.hex))
    assert [r["id"] for r in got] == [str(uuid.uuid5(space, "a")), str(uuid.uuid5(space, "Ü")), str(uuid.UUID(int=5))]
    assert got[0]["owner"] == str(uuid.UUID(int=0))


def test_sizes_and_reasons(spark):
    sizes = {"512MB": 512 << 20, "4GiB": 4 << 30, "1KB": 1024, "7": 7, "7b": 7, "x": None, "": None, "1.5MB": None}
    got = values(spark, [(s,) for s in sizes], "s string", n=S.parse_bytes(F.col("s")))
    assert [r["n"] for r in got] == list(sizes.values())
    assert values(spark, [("a\nb" + "x" * 200,)], "s string", r=S.clean_reason(F.col("s"), 5))[0]["r"] == "a bxx"


def test_client_ip(spark):
    cases = [(None, "10.0.0.1", "10.0.0.1"), ("1.2.3.4", "10.0.0.1", "1.2.3.4"), ("9.9.9.9, 1.2.3.4, 10.2.2.2", "10.0.0.1", "1.2.3.4"), ("1.2.3.4", "8.8.8.8", "8.8.8.8"), ("10.1.1.1", "10.0.0.1", "10.0.0.1")]
    got = values(spark, [c[:2] for c in cases], "f string, p string", ip=S.client_ip(F.col("f"), F.col("p"), ["10.0.0.0/8"]))
    assert [r["ip"] for r in got] == [c[2] for c in cases]


def test_client_ip_of_both_families(spark):
    trusted = ["loopback", "private", "2001:db8::/32"]
    cases = [("2001:db9::5, 2001:db8::1", "::1", "2001:db9::5"), ("fd00::1, 9.9.9.9", "fc00::2", "9.9.9.9"), ("1.1.1.1", "::ffff:10.0.0.1", "1.1.1.1"), ("1.1.1.1", "2001:db9::1", "2001:db9::1"), ("x, 172.16.0.9", "127.0.0.1", "x"), ("1.1.1.1", "172.32.0.1", "172.32.0.1")]
    got = values(spark, [c[:2] for c in cases], "f string, p string", ip=S.client_ip(F.col("f"), F.col("p"), trusted))
    assert [r["ip"] for r in got] == [c[2] for c in cases]


def test_reasons_are_cut_by_bytes(spark):
    texts = ["aé漢🎉b", "é" * 5, "abc", "", None]
    for most in range(1, 12):
        got = values(spark, [(t,) for t in texts], "t string", r=S.clean_reason(F.col("t"), most))
        assert [r["r"] for r in got] == [None if t is None else t.encode()[:most].decode(errors="ignore") for t in texts]


def test_grant_lifetimes(spark):
    args = (F.lit("d"), F.lit("d"), F.lit("write"), F.col("exp"), F.lit(100))
    got = values(spark, [(200, 90), (200, 140), (5000, 90), (60, 0)], "exp long, nbf long", g=S.grant(*args, not_before=F.col("nbf"), longest=3600))
    assert [r["g"] for r in got] == ["write", None, None, None]


def test_cache_expires_from_the_fetch(spark):
    rows = [("a", n, dt.datetime(2024, 1, 1, 0, 0, t)) for n, t in enumerate((0, 6, 9, 12, 13))]
    got = rooms.cache_hits(spark.createDataFrame(rows, "doc string, seq long, ts timestamp_ntz"), 10, ("doc",)).orderBy("seq").collect()
    assert [r.hit for r in got] == [False, True, True, False, True]


def test_token_expiry(spark):
    token = "h." + base64.urlsafe_b64encode(json.dumps({"exp": 1234}).encode() + b" " * 2).decode() + ".s"
    assert values(spark, [(token,)], "t string", e=S.token_expiry(F.col("t")))[0]["e"] == 1234


def test_audit_lines(spark, tmp_path):
    event = spark.createDataFrame([("read", 200)], "action string, status int")
    oplog.write_audit(event, str(tmp_path / "audit"))
    (tmp_path / "audit" / "more.json").write_text('{"action": "write", "status": 403}\nnot json\n')
    rows = oplog.read_audit(spark, str(tmp_path / "audit")).select("action", S.result_class(F.col("status")).alias("r")).collect()
    assert {(r.action, r.r) for r in rows if r.action} == {("read", "ok"), ("write", "denied")} and len(rows) == 3


def test_blobs(spark, tmp_path):
    (tmp_path / "snapshots").mkdir()
    (tmp_path / "snapshots" / "1").write_bytes(b"far")
    rows = spark.createDataFrame([(1, "snapshots/1", None), (2, "", bytearray(b"near")), (3, "gone", None)], "id int, snapshot_key string, snapshot binary")
    got = {r.id: r.payload for r in oplog.resolve_blobs(rows, oplog.read_blobs(spark, str(tmp_path))).collect()}
    assert got == {1: b"far", 2: b"near", 3: None}


def test_merge_ranges(spark):
    rows = [("d", 1, 0, 3), ("d", 1, 3, 2), ("d", 1, 4, 4), ("d", 1, 9, 1), ("d", 2, 0, 1), ("d", 1, 1, 1)]
    got = intervals.merge_ranges(spark.createDataFrame(rows, "doc string, client long, clock long, len long")).collect()
    assert {(r.client, r.clock, r.len) for r in got} == {(1, 0, 8), (1, 9, 1), (2, 0, 1)}


def test_long_ranges_are_found_in_every_bucket(spark):
    ranges = spark.createDataFrame([("d", 1, 10, 500)], "doc string, client long, clock long, len long")
    points = spark.createDataFrame([("d", 1, x) for x in (9, 10, 300, 509, 510)], "doc string, client long, at long")
    assert sorted(r["at"] for r in intervals.covering(points, ranges).collect()) == [10, 300, 509]


def test_compaction_keeps_what_was_not_folded(spark):
    docs = spark.createDataFrame([(1, 5), (2, 0)], "doc_id long, snapshot_seq long")
    log = spark.createDataFrame([(1, 3), (1, 4), (2, 1), (2, 2), (2, 3)], "doc_id long, seq long")
    folded = spark.createDataFrame([(1, 3), (2, 1), (2, 3)], "doc_id long, seq long")
    newer, left = store.compact(docs, log, folded)
    assert {(r.doc_id, r.snapshot_seq) for r in newer.collect()} == {(1, 5), (2, 3)}  # 3 is stale for document 1
    assert {(r.doc_id, r.seq) for r in left.collect()} == {(1, 3), (1, 4), (2, 2)}


def test_pages_and_pruning(spark):
    docs = spark.createDataFrame([(i, "same" if i < 3 else f"n{i}", 1) for i in range(6)], "doc_id long, name string, owner_id int")
    log = spark.createDataFrame([(1, 1), (1, 2)], "doc_id long, seq long")
    page = store.list_page(docs, log, 2, after=("same", 0)).orderBy("name", "doc_id").collect()
    assert [(r.name, r.doc_id, r.updates) for r in page] == [("same", 1, 2), ("same", 2, 0)]
    with pytest.raises(ValueError):
        store.list_page(docs, log, 0)
    assert store.prune(log, 0, order="seq").count() == 2 and store.prune(log, 1, order="seq").first().seq == 2


def test_sessions_split_at_the_gap(spark):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = spark.createDataFrame([("d", at(0), 1), ("d", at(4), 2), ("d", at(9), 3)], "doc string, ts timestamp_ntz, seq long")
    assert sorted(r.n for r in rooms.sessions(rows, 300).collect()) == [1, 2]


def test_presence_rules(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("d", 1, 0, "x", at), ("d", 2, 1, "a", at), ("d", 2, 1, None, at), ("d", 3, 2, "b", at), ("d", 3, 1, None, at)]
    got = {r.client: r.state for r in rooms.presence(spark.createDataFrame(rows, "doc string, client long, clock long, state string, ts timestamp_ntz")).collect()}
    assert got == {2: None, 3: "b"}


def test_percentile_rule(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4)], "k string, v double")
    assert metrics.index_percentiles(rows, "v", {"p50": 0.5, "max": 1.0}, ("k",)).first().asDict() == {"k": "a", "n": 4, "p50": 3.0, "max": 4.0}
