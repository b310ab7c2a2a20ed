"""Operators on clocks and on ranges of clocks. Built-in functions only.

A struct takes the clocks [clock, clock + len) of a client; a state vector holds the next clock
expected of each client, and a client that is not in it counts as 0.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64


def clock_end() -> Column:
    return F.col("clock") + F.col("len")


def last_id() -> Column:
    """The clock of a struct's last unit."""
    return clock_end() - 1


def state_vector(structs: DataFrame) -> DataFrame:
    """(doc, client, state): one past the last clock of each client."""
    return structs.groupBy("doc", "client").agg(F.max(clock_end()).alias("state"))


def update_vector(structs: DataFrame) -> DataFrame:
    """(doc, seq, client, state): the state vector of each update by itself, its block's first clock plus all lengths."""
    return structs.groupBy("doc", "seq", "client").agg((F.min("clock") + F.sum("len")).alias("state"))


def coalesced(structs: DataFrame, same: str) -> DataFrame:
    """(doc, client, same, clock, len, parts): structs that follow one another and are of one kind, as one."""
    w = Window.partitionBy("doc", "client").orderBy("clock")
    follows = (F.lag(clock_end()).over(w) == F.col("clock")) & F.lag(same).over(w).eqNullSafe(F.col(same))
    runs = structs.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int")).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc", "client", "run").agg(F.first(same).alias(same), F.min("clock").alias("clock"), F.sum("len").alias("len"), F.count(F.lit(1)).alias("parts")).drop("run")


def digests(structs: DataFrame, span: int = 1024) -> DataFrame:
    """(doc, fingerprint): digests of spans of a client's clocks, of clients and of the document, so that no group holds a document."""
    line = F.concat_ws(":", "clock", "len")
    joined = lambda c, key: F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, c))), lambda x: x[c]), ","))
    parts = structs.withColumn("line", line).groupBy("doc", "client", F.floor(F.col("clock") / span).alias("span")).agg(joined("line", "clock").alias("digest"))
    clients = parts.groupBy("doc", "client").agg(joined("digest", "span").alias("digest"))
    lines = clients.select("doc", "client", F.concat_ws(":", "client", "digest").alias("line"))
    return lines.groupBy("doc").agg(joined("line", "client").alias("fingerprint"))


def state_text(vector: DataFrame) -> DataFrame:
    """(doc, sv): the state vector as text, clients in descending order."""
    entries = F.sort_array(F.collect_list(F.struct("client", "state")), asc=False)
    return vector.groupBy("doc").agg(F.array_join(F.transform(entries, lambda e: F.concat_ws(":", e["client"], e["state"])), ",").alias("sv"))


def gaps(structs: DataFrame) -> DataFrame:
    """(doc, client, seq, expected, clock): structs that do not start where the client's last one ended."""
    w = Window.partitionBy("doc", "client").orderBy("clock", "seq")
    expected = F.coalesce(F.lag(clock_end()).over(w), F.lit(0).cast("long"))
    return structs.select("doc", "client", "seq", expected.alias("expected"), "clock").where("clock > expected")


def pending(structs: DataFrame) -> DataFrame:
    """Structs that wait for an earlier one of their client: those at or after its first gap."""
    first = gaps(structs).groupBy("doc", "client").agg(F.min("clock").alias("gap"))
    return structs.join(first, ["doc", "client"]).where("clock >= gap")


def missing_dependencies(structs: DataFrame, known: DataFrame) -> DataFrame:
    """Structs whose origin (origin_client, origin_clock) no known struct covers.

    As clocks have no gaps, an id is covered if it lies below the state of its client.
    """
    state = state_vector(known).select(F.col("doc").alias("d"), F.col("client").alias("c"), "state")
    has = (F.col("doc") == F.col("d")) & (F.col("origin_client") == F.col("c")) & (F.col("origin_clock") < F.col("state"))
    return structs.where("origin_client is not null").join(state, has, "left_anti")


def dedupe(structs: DataFrame) -> DataFrame:
    """Each struct once, however often it was delivered."""
    return structs.dropDuplicates(["doc", "client", "clock"])


def merge_ranges(ranges: DataFrame, keys: tuple = ("doc", "client")) -> DataFrame:
    """(keys, clock, len): ranges sorted, with those that touch or overlap made one."""
    order = Window.partitionBy(*keys).orderBy("clock", "len")
    seen = F.max(clock_end()).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.withColumn("new", (seen.isNull() | (F.col("clock") > seen)).cast("int"))
    islands = starts.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy(*keys, "island").agg(F.min("clock").alias("clock"), F.max(clock_end()).alias("stop"))
    return merged.select(*keys, "clock", (F.col("stop") - F.col("clock")).alias("len"))


def _filed(ranges: DataFrame, bucket: int) -> DataFrame:
    """Each range once for each bucket of clocks that it meets."""
    last = F.greatest(F.col("clock"), clock_end() - 1)
    return ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("clock") / bucket), F.floor(last / bucket))))


def covering(points: DataFrame, ranges: DataFrame, how: str = "inner", bucket: int = BUCKET) -> DataFrame:
    """points (doc, client, at) joined to the range that holds them.

    An equi-join on (doc, client, bucket of clocks), so that a client with a long history is spread.
    """
    filed = _filed(ranges, bucket).select(F.col("doc").alias("d"), F.col("client").alias("c"), F.col("bucket").alias("b"), F.col("clock").alias("start"), clock_end().alias("stop"))
    p = points.withColumn("bucket", F.floor(F.col("at") / bucket))
    inside = (p["doc"] == filed["d"]) & (p["client"] == filed["c"]) & (p["bucket"] == filed["b"]) & (filed["start"] <= p["at"]) & (p["at"] < filed["stop"])
    return p.join(filed, inside, how).drop("d", "c", "b", "bucket")


def split_at(structs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Structs cut where an offset (doc, client, at) falls inside of them; both parts are kept."""
    cuts = covering(offsets.select("doc", "client", "at"), structs.select("doc", "client", "clock", "len")).where("at > start").groupBy("doc", "client", F.col("start").alias("clock")).agg(F.sort_array(F.collect_set("at")).alias("cuts"))
    edges = F.concat(F.array("clock"), F.coalesce("cuts", F.array().cast("array<bigint>")), F.array(clock_end()))
    parts = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.element_at("edges", i).alias("clock"), (F.element_at("edges", i + 1) - F.element_at("edges", i)).alias("len")))
    cut = structs.join(cuts, ["doc", "client", "clock"], "left").withColumn("edges", edges)
    return cut.withColumn("part", F.explode(parts)).withColumn("clock", F.col("part.clock")).withColumn("len", F.col("part.len")).drop("part", "edges", "cuts")


def pending_deletes(ranges: DataFrame, vector: DataFrame) -> DataFrame:
    """The parts of delete ranges that lie at or beyond the state of their client."""
    known = F.coalesce("state", F.lit(0).cast("long"))
    start = F.greatest(F.col("clock"), known)
    return ranges.join(vector, ["doc", "client"], "left").where(clock_end() > known).select("doc", "client", start.alias("clock"), (clock_end() - start).alias("len"))


def diff_since(structs: DataFrame, vector: DataFrame) -> DataFrame:
    """What a peer with the state vector lacks; the first struct of a client is sliced."""
    known = F.coalesce("state", F.lit(0).cast("long"))
    start = F.greatest(F.col("clock"), known)
    return structs.join(vector, ["doc", "client"], "left").where(clock_end() > known).select("doc", "client", "seq", start.alias("clock"), (clock_end() - start).alias("len"))


def usage(structs: DataFrame, fixed: int = 96) -> DataFrame:
    """(doc, structs, clients, bytes): an estimate of what a document takes in memory."""
    return structs.groupBy("doc").agg(F.count(F.lit(1)).alias("structs"), F.count_distinct("client").alias("clients"), F.sum(F.lit(fixed) + F.col("len")).alias("bytes"))
