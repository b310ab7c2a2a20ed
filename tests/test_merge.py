"""Replay of recorded updates: every order, batching and repetition gives the recorded state.

RECORDED_SCENARIOS names a folder of scenarios, each with updates.json and expected.json; without it
only `test_merge_by_hand` tests the merge.
"""

import json
import os
import random
from pathlib import Path

import pytest

from loomlog.functions import codec
from loomlog.operators import merge

FIXTURES = Path(os.environ.get("RECORDED_SCENARIOS", "/nonexistent"))
SCENARIOS = sorted(p.parent.name for p in FIXTURES.glob("*/updates.json"))
SCHEMA = codec.DECODED


def content_of(c):
    if c is None:
        return None, None
    ref = c["ref"]
    value = {
        1: lambda: {"len": c.get("len", 0)}, 2: lambda: {"values": c["values"]}, 3: lambda: {"bytes": c.get("bytes")}, 4: lambda: {"str": c["str"]}, 5: lambda: {"json": json.dumps(c["embed"])},
        6: lambda: {"key": c["key"], "json": json.dumps(c["value"])}, 7: lambda: {"type": c["typeRef"], "name": c.get("nodeName")}, 8: lambda: {"values": c["values"]}, 9: lambda: {"guid": c["guid"]},
    }[ref]()
    return ref, json.dumps({k: v for k, v in value.items() if v is not None})


def rows_of(scenario):
    out = []
    for n, u in enumerate(json.loads((FIXTURES / scenario / "updates.json").read_text())):
        for s in u["decoded"]["structs"]:
            ref, content = content_of(s.get("content"))
            parent = s.get("parent") or {}
            pair = lambda x: None if x is None else (x["client"], x["clock"])
            out.append((scenario, n, None, s["id"]["client"], s["id"]["clock"], s["len"], s["kind"], pair(s.get("origin")), pair(s.get("rightOrigin")), parent.get("key"), pair(parent.get("id")), s.get("parentSub"), ref, content))
        for client, ranges in u["decoded"]["deleteSet"].items():
            out += [(scenario, n, None, int(client), at, size, "Delete", *[None] * 7) for at, size in ranges]
    return out


def expected(scenario):
    return json.loads((FIXTURES / scenario / "expected.json").read_text())["state"]


@pytest.fixture(scope="module")
def merged(spark):
    rows = [r for s in SCENARIOS for r in rows_of(s)]
    again = [(f"{r[0]}~{k}", *r[1:]) for k in range(3) for r in random.Random(k).sample(rows + rows[::2], len(rows) + len(rows[::2]))]
    items = merge.integrate(spark.createDataFrame(rows + again, SCHEMA)).cache()
    yield items
    items.unpersist()


pytestmark = pytest.mark.skipif(not SCENARIOS, reason="no recorded updates here")


def test_texts(merged):
    got = {(r.doc, r.parent): r.text for r in merge.texts(merged).collect()}
    for s in SCENARIOS:
        for name, t in expected(s)["types"].items():
            if t["kind"] == "text":
                for doc in (s, *(f"{s}~{k}" for k in range(3))):
                    assert got.get((doc, name), "") == t["string"], (doc, name)


def test_map_keys(merged):
    got = {(r.doc, r.parent): r["keys"] for r in merge.map_keys(merged).collect()}
    for s in SCENARIOS:
        for name, t in expected(s)["types"].items():
            if t["kind"] == "map":
                assert got.get((s, name), []) == sorted(t["json"]), s


def test_state_and_deletes(merged):
    from loomlog.operators.intervals import state_vector

    state, gone = {}, {}
    for r in state_vector(merge.placed(merged)).collect():
        state.setdefault(r.doc, {})[str(r.client)] = r.state
    for r in merge.deleted_ranges(merged).orderBy("clock").collect():
        gone.setdefault(r.doc, {}).setdefault(str(r.client), []).append([r.clock, r.len])
    for s in SCENARIOS:
        assert state.get(s, {}) == expected(s)["stateVector"], s
        assert gone.get(s, {}) == expected(s)["deleteSet"], s


def test_order_does_not_matter(merged):
    got = {r.doc: r.fingerprint for r in merge.fingerprints(merged).collect()}
    for s in SCENARIOS:
        assert len({got[s], *(got[f"{s}~{k}"] for k in range(3))}) == 1, s


def test_nothing_is_pending(merged):
    assert merged.where("pending").count() == 0


def test_missing_dependency_waits(spark):
    rows = [r for r in rows_of("text-three-client-interleaved") if not (r[3] == 1001 and r[4] == 0)]
    items = merge.integrate(spark.createDataFrame(rows, SCHEMA))
    assert items.where("pending").count() > 0


def test_json_views(merged):
    got = {(r.doc, r.root): json.loads(r.body) for r in merge.to_json(merged).collect()}
    for s in SCENARIOS:
        for name, t in expected(s)["types"].items():
            if t["kind"] in ("map", "array") and "json" in t:
                assert got.get((s, name), {}) == t["json"], (s, name)


def test_encoded_documents_load_again(spark, merged):
    from pyspark.sql import functions as F

    whole = merge.encode(merged).select("doc", F.lit(1).alias("seq"), "payload").cache()
    bad = whole.limit(1).select("doc", F.lit(2).alias("seq"), F.lit(b"\xff").alias("payload"))
    items, skipped = merge.load(whole.unionByName(bad))
    assert {r.doc: r.fingerprint for r in merge.fingerprints(items).collect()} == {r.doc: r.fingerprint for r in merge.fingerprints(merged).collect()}
    assert sum(r.skipped for r in skipped.collect()) == 1
    # a peer that has the first half of each client's clocks needs only the rest
    from loomlog.operators.intervals import state_vector

    half = state_vector(merge.placed(merged)).withColumn("state", F.floor(F.col("state") / 2))
    rest = codec.decode_updates(merge.encode(merged, half).select("doc", F.lit(1).alias("seq"), "payload"))
    starts = rest.where("kind in ('Item', 'GC')").groupBy("doc", "client").agg(F.min("clock").alias("first")).join(half, ["doc", "client"])
    assert starts.where("first <> state").count() == 0 and starts.count() > 10


def test_describe(merged):
    body = {r.doc: json.loads(r.body) for r in merge.describe(merged).collect()}
    assert body["text-insert-single"]["roots"] == [{"name": "text", "text": "Hello", "keys": []}]
    assert body["content-doc"]["subdocs"] == ["fixture-subdoc-0000"]
