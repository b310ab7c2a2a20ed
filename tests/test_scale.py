"""Steps whose time or memory must grow no faster than their rows."""

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomlog.functions import codec
from loomlog.operators import metrics

START = datetime(2024, 1, 1)


def test_windowed_rate_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, START + timedelta(seconds=rng.choice([rng.randint(0, 60), rng.random() * 60])), rng.choice([None, 1.5, 1e16, -2.0])) for i in range(300)] + [("a", 300, None, 1.0)]
    samples = spark.createDataFrame(rows, "doc string, seq long, ts timestamp_ntz, v double")
    near = {r[1]: [x[3] for x in rows if x[2] and r[2] and x[0] == r[0] and r[2] - timedelta(seconds=10) < x[2] <= r[2]] for r in rows if r[2]}
    assert {r.seq: r.rate for r in metrics.windowed_rate(samples, 10, ("doc",)).collect()} == {i: len(v) / 10 for i, v in near.items()}
    got = {r.seq: r.rate for r in metrics.windowed_rate(samples, 10, ("doc",), F.col("v")).collect()}
    for i, v in near.items():
        held = [x for x in v if x is not None]
        assert (got[i] is None) == (not held) and (not held or abs(got[i] - sum(held) / 10) <= 1e-15 * sum(map(abs, held)))


def test_windowed_rate_of_a_hot_block_takes_linear_time(spark):
    samples = spark.range(300_000).select(F.lit("d").alias("doc"), F.col("id").alias("seq"), (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 0.01)).alias("ts"))
    begin = time.time()
    rates = metrics.windowed_rate(samples, 3600, ("doc",))
    assert [r.n for r in rates.where("seq = 299999 or seq = 9").orderBy("seq").select((F.col("rate") * 3600).cast("long").alias("n")).collect()] == [10, 300_000]
    assert time.time() - begin < 30


def test_packed_payloads_stay_in_their_task(spark):
    rows = [(b"a" * 1000,), (b"short",), (b"",), (None,), (random.Random(1).randbytes(500),)]
    found = codec.packed_sizes(spark.createDataFrame(rows, "p binary"), "p")
    assert sorted(map(str, found.collect())) == sorted(f"Row(codec={c}, raw={None if p is None else len(p)}, stored={len(s)})" for (p,) in rows for c, s in [codec.pack(p or b"")])
    assert [t for _, t in found.dtypes] == ["int", "bigint", "bigint"]
