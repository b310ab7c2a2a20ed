"""Operators on who is in which document when: presence, fan-out, sessions, limits and caches."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.operators import blocks


def seconds(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1_000_000)


def micros(ts) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def fan_out(ops: DataFrame, members: DataFrame) -> DataFrame:
    """An operation to every member of its document except its sender."""
    to = members.select(F.col("doc").alias("d"), F.col("client").alias("to"))
    return ops.join(to, (F.col("doc") == F.col("d")) & (F.col("client") != F.col("to"))).drop("d")


def deliveries(ops: DataFrame, members: DataFrame) -> DataFrame:
    """(doc, client, sent, receivers, deliveries) of each sender: what `fan_out` would make, counted without making it."""
    sent = ops.groupBy("doc", "client").agg(F.count(F.lit(1)).alias("sent"))
    sizes = members.groupBy("doc").agg(F.count_distinct("client").alias("all"))
    own = members.select("doc", "client").distinct().withColumn("own", F.lit(1))
    receivers = F.coalesce("all", F.lit(0)) - F.coalesce("own", F.lit(0))
    joined = sent.join(sizes, "doc", "left").join(own, ["doc", "client"], "left")
    return joined.select("doc", "client", "sent", receivers.alias("receivers"), (F.col("sent") * receivers).alias("deliveries"))


def presence(updates: DataFrame, key: tuple = ("doc", "client")) -> DataFrame:
    """The presence of each client: its highest clock counts, a removal wins a tie.

    A first update at clock 0 is not news, as an unknown client counts as being at 0.
    """
    news = updates.where((F.col("clock") > 0) | F.col("state").isNull())
    order = F.struct(F.col("clock"), F.col("state").isNull())
    return news.groupBy(*key).agg(F.max_by("state", order).alias("state"), F.max("clock").alias("clock"), F.max("ts").alias("seen"))


def expired(seen: DataFrame, now: Column, ttl: str) -> DataFrame:
    """Clients that have been silent for the ttl or longer."""
    return seen.where(F.col("seen") <= now - F.expr(f"interval {ttl}"))


def forgotten(states: DataFrame, now: Column, after: str = "10 minutes", cap: int = 1024) -> DataFrame:
    """states (doc, client, state, seen) without the removed clients that were seen last so long ago, nor, where a document has more than
    twice the cap of entries, the oldest removed ones above that. Clients that are there always stay."""
    fresh = states.where(F.col("state").isNotNull() | (F.col("seen") + F.expr(f"interval {after}") > now))
    w = Window.partitionBy("doc")
    placed = fresh.withColumns({"__all": F.count(F.lit(1)).over(w), "__place": F.row_number().over(w.orderBy(F.col("state").isNotNull(), "seen", "client"))})
    return placed.where(F.col("state").isNotNull() | (F.col("__place") > F.col("__all") - 2 * cap)).drop("__all", "__place")


def disconnect(states: DataFrame, clients: DataFrame) -> DataFrame:
    """(doc, client, clock): the removals that follow when connections end: of their clients (doc, client), those that are there."""
    return states.where("state is not null").join(clients.select("doc", "client").distinct(), ["doc", "client"], "left_semi").select("doc", "client", "clock")


def ingest(states: DataFrame, updates: DataFrame) -> DataFrame:
    """(doc, client, clock, state, sender): what updates (doc, client, clock, state, sender) change, which is what is relayed to all but its sender.

    An update counts if its clock is higher than the one held (0 for an unknown client), or the same with a removal of a client that is there.
    """
    newest = updates.groupBy("doc", "client").agg(F.max_by(F.struct("clock", "state", "sender"), F.struct("clock", F.col("state").isNull())).alias("u"))
    held = states.select("doc", "client", F.col("clock").alias("held"), F.col("state").isNotNull().alias("there"))
    joined = newest.join(held, ["doc", "client"], "left")
    news = (F.col("u.clock") > F.coalesce("held", F.lit(0))) | ((F.col("u.clock") == F.col("held")) & F.col("u.state").isNull() & F.col("there"))
    return joined.where(news).select("doc", "client", "u.clock", "u.state", "u.sender")


def sessions(events: DataFrame, gap_seconds: int, key: tuple = ("doc",), order: tuple = ("ts", "seq"), block_seconds: int | None = None) -> DataFrame:
    """(key, session, started, ended, n): a new session after a silence of the gap or longer.

    With `block_seconds` time is cut into blocks, for keys that are few and hot.
    """
    timed = events.select(*key, *order, micros("ts").alias("__at"))
    if block_seconds is None:
        w = Window.partitionBy(*key).orderBy(*order)
        quiet = F.col("__at") - F.lag("__at").over(w) >= gap_seconds * 1_000_000
        marked = timed.withColumn("session", F.sum(F.coalesce(quiet.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        block = F.floor(F.col("__at") / (block_seconds * 1_000_000))
        before = blocks.lagged(timed, key, order, block, {"__prev": "__at"})
        marked = blocks.running(before, key, order, block, F.coalesce((F.col("__at") - F.col("__prev") >= gap_seconds * 1_000_000).cast("int"), F.lit(0)), "session")
    return marked.groupBy(*key, "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))


def batches(rows: DataFrame, size: int, key: tuple, order: tuple, block: Column) -> DataFrame:
    """rows with the number of the batch of `size` that each falls into; block cuts the order, see `blocks`."""
    return blocks.numbered(rows, key, order, block, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size)).drop("__n")


def flushes(rows: DataFrame, size: int, wait_ms: int, key: tuple = ("doc",), order: str = "seq") -> DataFrame:
    """(key, order, batch): a batch is written once it holds `size` rows, when a row comes `wait_ms` after its first, or at once with a `durable` row."""

    def step(state, r):
        batch, first, n = state
        if n and (n >= size or r.at - first >= wait_ms * 1000):
            batch, n = batch + 1, 0
        first, n = (r.at if not n else first), n + 1
        made = (*(getattr(r, c) for c in key), getattr(r, order), batch)
        return ((batch + 1, 0, 0) if r.durable else (batch, first, n)), made

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for c in (*key, order) for f in rows.schema if f.name == c)
    timed = rows.select(*key, order, micros("ts").alias("at"), "durable")
    return blocks.fold(timed, key, ("at", order), f"{kinds}, batch long", (0, 0, 0), step)


def trigger_points(rows: DataFrame, every: int, key: tuple, order: tuple, block: Column) -> DataFrame:
    """Each `every`-th row of a key, at which a compaction is due."""
    return blocks.numbered(rows, key, order, block).where(F.col("n") % every == 0)


def token_bucket(events: DataFrame, capacity: float, rate: float, key: str = "client", cost: str = "len", order: str = "seq") -> DataFrame:
    """(key, order, tokens, wait): a bucket that refills at `rate` a second; it may go below zero, and the wait is what it then takes to get back."""

    def step(state, r):
        at, tokens = state
        left = (capacity if at is None else min(capacity, tokens + (r.at - at) / 1e6 * rate)) - r.cost
        return (r.at, left), (r.key, r.o, left, min(-left / rate, capacity / rate) if left < 0 else 0.0)

    timed = events.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("o"), micros("ts").alias("at"), F.col(cost).cast("double").alias("cost"))
    out = blocks.fold(timed, ("key",), ("at", "o"), "key long, o long, tokens double, wait double", (None, float(capacity)), step)
    return out.select(F.col("key").alias(key), F.col("o").alias(order), "tokens", "wait")


def admitted(rows: DataFrame, cap: int, key: tuple, order: tuple) -> DataFrame:
    """The first `cap` rows of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("n") <= cap)


def cache_hits(lookups: DataFrame, ttl_seconds: int, key: tuple, order: str = "seq") -> DataFrame:
    """(key, order, hit): an entry is fetched at a miss and expires the ttl after that, however often it is hit in between."""

    def step(fetched, r):
        hit = fetched is not None and r.at - fetched < ttl_seconds * 1_000_000
        return (fetched if hit else r.at), (*(getattr(r, c) for c in key), getattr(r, order), hit)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for c in (*key, order) for f in lookups.schema if f.name == c)
    return blocks.fold(lookups.select(*key, order, micros("ts").alias("at")), key, ("at", order), f"{kinds}, hit boolean", None, step)


def evicted(rooms: DataFrame, budget: int, key: tuple, recency: str, size: str, tie: str) -> DataFrame:
    """What must go, least recent first, until what stays fits the budget."""
    w = Window.partitionBy(*key).orderBy(F.desc(recency), tie).rowsBetween(Window.unboundedPreceding, 0)
    return rooms.withColumn("running", F.sum(size).over(w)).where(F.col("running") > budget)
