"""Histograms, quantiles, rates and reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators import blocks
from loomlog.operators.rooms import micros


def bounds(start: float, factor: float, n: int) -> list[float]:
    """Exponential bucket bounds."""
    return [round(start * factor**k, 12) for k in range(n)]


#: Start, factor and number of the bucket bounds of each measure.
BUCKET_SETS = {"apply_seconds": (2e-5, 3, 10), "update_bytes": (16, 4, 9), "store_seconds": (5e-4, 3, 10), "load_seconds": (1e-3, 3, 10), "hook_seconds": (1e-3, 3, 10), "auth_seconds": (1e-3, 3, 10)}


def histogram(samples: DataFrame, value: str, les: list[float], key: tuple = ()) -> DataFrame:
    """(key, le, n): how many samples are at or below each bound, and below infinity.

    One pass: a count a bound, then a row each.
    """
    counts = samples.groupBy(*key).agg(*[F.count_if(F.col(value) <= le).alias(f"b{k}") for k, le in enumerate(les)], F.count(value).alias("b_all"))
    rows = F.array(*[F.struct(F.lit(float(le)).alias("le"), F.col(f"b{k}").alias("n")) for k, le in enumerate(les)], F.struct(F.lit(float("inf")).alias("le"), F.col("b_all").alias("n")))
    return counts.select(*key, F.explode(rows).alias("x")).select(*key, "x.le", "x.n")


def histogram_quantile(q: float, buckets: DataFrame, key: tuple = ()) -> DataFrame:
    """(key, value): linear interpolation inside the first bucket that reaches the quantile.

    Beyond the last finite bound its value is that bound, as nothing above is known.
    """
    w = Window.partitionBy(*key, ).orderBy("le") if key else Window.partitionBy(F.lit(1)).orderBy("le")
    total = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(1))
    rows = buckets.select("*", F.coalesce(F.lag("le").over(w), F.lit(0.0)).alias("lower"), F.coalesce(F.lag("n").over(w), F.lit(0)).alias("below"), F.max("n").over(total).alias("total"))
    first = rows.where((F.col("n") >= q * F.col("total")) & (F.col("below") < q * F.col("total")))
    inside = F.col("lower") + (F.col("le") - F.col("lower")) * (q * F.col("total") - F.col("below")) / (F.col("n") - F.col("below"))
    return first.select(*key, F.when(F.col("le") == float("inf"), F.col("lower")).otherwise(inside).alias("value"))


def index_percentiles(samples: DataFrame, value: str, ps: dict[str, float], key: tuple, width: float = 1.0) -> DataFrame:
    """The value at place floor(p * n) of the sorted samples (counting from 0), the last at most.

    This is neither the discrete nor the continuous percentile: the median of 1, 2, 3, 4 is 3. Samples are counted in buckets of
    `width`; only buckets that hold a wanted place are sorted, each by itself.
    """
    held = samples.where(F.col(value).isNotNull()).select(*key, F.col(value).alias("__v"), F.floor(F.col(value) / width).alias("__b"))
    counts = held.groupBy(*key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*key)
    placed = counts.select(*key, "__b", "__n", F.sum("__n").over(w).alias("__all"), (F.sum("__n").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__from"))
    place = lambda p: F.least(F.floor(F.lit(p) * F.col("__all")), F.col("__all") - 1)
    wanted = placed.select(*key, "__b", "__all", "__from", "__n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(p).alias("at")) for name, p in ps.items()])).alias("w"))
    wanted = wanted.where((F.col("w.at") >= F.col("__from")) & (F.col("w.at") < F.col("__from") + F.col("__n"))).select(*key, "__b", "__all", "w.name", (F.col("w.at") - F.col("__from")).alias("__place"))
    some = held.join(wanted.select(*key, "__b").distinct(), [*key, "__b"]).withColumn("__place", F.row_number().over(Window.partitionBy(*key, "__b").orderBy("__v")) - 1)
    found = wanted.join(some, [*key, "__b", "__place"])
    return found.groupBy(*key).agg(F.max("__all").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("__v"))).alias(name) for name in ps])


def windowed_rate(samples: DataFrame, seconds: int, key: tuple, value: Column | None = None) -> DataFrame:
    """samples with `rate`: what came in the last so many seconds, each second.

    Time is cut into blocks of that width. A sample's window is its block up to it and the end of the block before, so it takes a running
    sum of the one and, at the time when it leaves the window, a running sum from behind of the other. Each row is added once, however
    many a block holds; a sliding frame would add up its window anew for each row. Samples without a time are left out.
    """
    width = seconds * 1_000_000
    amount = F.lit(1).cast("long") if value is None else value
    timed = samples.withColumns({"__at": micros("ts"), "__amount": amount}).where("__at is not null").withColumn("__block", F.floor(F.col("__at") / width))
    inside = Window.partitionBy(*key, "__block")
    upto, since = inside.orderBy("__at").rangeBetween(Window.unboundedPreceding, 0), inside.orderBy(F.desc("__at")).rangeBetween(Window.unboundedPreceding, 0)
    summed = timed.withColumns({"__upto": F.sum("__amount").over(upto), "__since": F.struct(F.sum("__amount").over(since).alias("sum"))})
    # each sample, and in the next block the time from which on it no longer counts
    own = F.struct("__block", "__at", F.lit(False).alias("leaves"))
    next_ = F.struct((F.col("__block") + 1).alias("__block"), (F.col("__at") + width).alias("__at"), F.lit(True).alias("leaves"))
    both = summed.withColumn("__x", F.explode(F.array(own, next_))).withColumns({"__block": F.col("__x.__block"), "__at": F.col("__x.__at"), "__leaves": F.col("__x.leaves")})
    later = Window.partitionBy(*key, "__block").orderBy(F.desc("__at"), "__leaves").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.col("__leaves"), F.col("__since")), ignorenulls=True).over(later)["sum"]
    found = both.withColumn("__carried", carried).where("not __leaves")
    total = F.when(F.col("__upto").isNull(), F.col("__carried")).otherwise(F.col("__upto") + F.coalesce("__carried", F.lit(0)))
    return found.withColumn("rate", total / seconds).select(*[F.col(f"`{c}`") for c in samples.columns if c != "rate"], "rate")


def ratio(above: DataFrame, below: DataFrame, key: tuple, name: str = "ratio") -> DataFrame:
    """(key, name): `value` of one table over that of the other where both have the key; null over zero."""
    b = below.select(*key, F.col("value").alias("__below"))
    return above.join(b, list(key)).select(*key, F.try_divide("value", "__below").alias(name))


def both(left: DataFrame, right: DataFrame, key: tuple) -> DataFrame:
    """The rows of left whose key right has too."""
    return left.join(right.select(*key).distinct(), list(key), "left_semi")


def at_zero(samples: DataFrame, label: str, pattern: str) -> DataFrame:
    """The samples whose label matches the whole pattern and whose value is zero."""
    return samples.where(F.col(label).rlike(f"^(?:{pattern})$") & (F.col("value") == 0))


def tumbling(events: DataFrame, width: str, key: tuple) -> DataFrame:
    """(key, start, n) of each window that has events."""
    at = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(*key, at.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sustained(windows: DataFrame, breach: Column, length: int, step_seconds: int, key: tuple) -> DataFrame:
    """(key, started, n): runs of at least `length` windows in a row that breach."""
    w = Window.partitionBy(*key).orderBy("start")
    bad = windows.where(breach).withColumn("step", F.floor(micros("start") / (step_seconds * 1_000_000)) - F.row_number().over(w))
    return bad.groupBy(*key, "step").agg(F.min("start").alias("started"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= length).drop("step")


def match_latency(sent: DataFrame, received: DataFrame, most_seconds: int) -> DataFrame:
    """received with the latency to what was sent under the same key, null if not sent within `most_seconds`.

    An equi-join on key and block of time: what was sent is filed in its block and the next, so that a busy key is spread.
    """
    width = most_seconds * 1_000_000
    own = F.floor(micros("ts") / width)
    s = sent.select(F.col("key").alias("k"), micros("ts").alias("sent_at"), F.explode(F.array(own, own + 1)).alias("b"))
    r = received.withColumn("__at", micros("ts")).withColumn("__block", own)
    near = (F.col("key") == F.col("k")) & (F.col("__block") == F.col("b")) & F.col("__at").between(F.col("sent_at"), F.col("sent_at") + width)
    return r.join(s, near, "left").withColumn("micros", F.col("__at") - F.col("sent_at")).drop("k", "b", "sent_at", "__at", "__block")


def delivery(sent: DataFrame, key: str = "doc", client: str = "client") -> DataFrame:
    """(key, clients, sent, expected): each update goes to everyone in the room but its sender."""
    return sent.groupBy(key).agg(F.count_distinct(client).alias("clients"), F.count(F.lit(1)).alias("sent")).withColumn("expected", F.col("sent") * (F.col("clients") - 1))


def delivery_report(sent: DataFrame, received: DataFrame, key: str = "doc") -> DataFrame:
    """(key, clients, sent, expected, received, untracked, errors, ratio): received has key, micros (null if nothing sent matches) and failed."""
    got = received.groupBy(key).agg(F.count_if(F.col("micros").isNotNull() & ~F.col("failed")).alias("received"), F.count_if(F.col("micros").isNull() & ~F.col("failed")).alias("untracked"), F.count_if("failed").alias("errors"))
    return delivery(sent, key).join(got, key, "left").na.fill(0, ["received", "untracked", "errors"]).withColumn("ratio", F.try_divide("received", "expected"))


def replica_totals(counters: DataFrame, replicas: int) -> DataFrame:
    """(published, received, looped): totals of counters (node, published, received) over replicas; more received than each publication can reach the others means a loop."""
    return counters.agg(F.sum("published").alias("published"), F.sum("received").alias("received")).withColumn("looped", F.col("received") > F.col("published") * (replicas - 1))


def clock_resolution(samples: DataFrame, key: tuple, block_seconds: int = 86_400) -> DataFrame:
    """(key, micros): the smallest positive step between samples."""
    timed = samples.select(*key, "seq", micros("ts").alias("__at"))
    before = blocks.lagged(timed, key, ("__at", "seq"), F.floor(F.col("__at") / (block_seconds * 1_000_000)), {"__prev": "__at"})
    return before.withColumn("step", F.col("__at") - F.col("__prev")).where("step > 0").groupBy(*key).agg(F.min("step").alias("micros"))
