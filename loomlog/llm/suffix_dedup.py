"""Remove every byte covered by a string of `length` bytes that starts anywhere else as well.

Bucket-pointer refinement over sampled suffixes. A suffix is sampled where its q-gram has the least
hash of some window of q-grams that fits into `length` bytes, so that equal strings of that length
sample the same places and only about one suffix in eighty-five is sorted (q = 32).

1. The sampled suffixes fall into buckets by q-gram. A bucket of one is finished: none of the strings
   around it repeats.
2. Buckets are refined by all the bytes that a string around the place can cover. Suffixes that share them
   are finished: everything around them repeats.
3. What is left (the edges of repeats) is refined with its bytes at hand: buckets of 8-grams at every
   offset are refined by sorting on pairs (own bucket, bucket of a later offset), which doubles the
   length compared, 8, 16, 32 ... `length`; a place whose bucket holds one string drops out.
   A bucket with more than `group` suffixes is not gathered but parted, again and again: into the strings that
   start in the farther and in the nearer half of the places before the sampled one, each half bucketed by the
   bytes that all its strings share. A half that shares them with nobody drops out, halves that are equal in all
   their bytes are finished and one stands for all, one that fits is gathered, and after eight partings a half is
   one string.
4. Each place yields one span; spans of a document are united and cut out.

Steps 1 and 2 count hashes, not bucket identifiers: a q-gram's bucket is named by 64 bits, and with all that is around it by 128. Bucket
identifiers of later offsets refine what those leave open, inside a bucket (step 3).

All counts are pre-aggregated by task, joins back to the suffixes are plain equi-joins, which adaptive
execution splits where a bucket is hot, and whole texts (compressed) cross the network twice.

Defined cases: a null text counts as empty; texts shorter than `length` lose nothing; rows that repeat an id, with
equal or other texts, are documents of their own; a null id is kept; ids are cast to long; an empty table gives an empty
result; other columns are not read.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stage

LENGTH, Q, GROUP, CHUNK = 200, 32, 2048, 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse among 64-bit numbers


def powers(base: int = _BASE, n: int = CHUNK + 4096) -> tuple[np.ndarray, np.ndarray]:
    """base^-i and base^i for i < n, modulo 2^64."""

    def run(b: int) -> np.ndarray:
        out = np.full(n, np.uint64(b), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(pow(base, -1, 1 << 64)), run(base)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(data: np.ndarray, size: int, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A 64-bit hash of every string of `size` bytes in `data` (bytes); scale: `powers` of a base."""
    n = len(data)
    if n < size:
        return np.empty(0, np.uint64)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * scale[0][:n], out=sums[1:])
    return _mix((sums[size:] - sums[:-size]) * scale[1][: n - size + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours."""
    n = len(x)
    pad = -n % w
    rows = np.concatenate((x, np.full(pad, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def sampled(data: np.ndarray, length: int, q: int, scale: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places, q-gram hashes) such that each string of `length` bytes holds a sampled q-gram."""
    w, places, hashes = length - q + 1, [], []
    for at in range(0, max(len(data) - length + 1, 0), CHUNK):
        h = gram_hashes(data[at : at + CHUNK + length - 1], q, scale)
        # the place decides between equal hashes, the leftmost wins
        low = np.unique(_sliding_min((h & ~np.uint64(0x3FFFFF)) | np.arange(len(h), dtype=np.uint64), w))
        p = np.sort((low & np.uint64(0x3FFFFF)).astype(np.int64))
        places.append(p + at)
        hashes.append(h[p])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    p, first = np.unique(np.concatenate(places), return_index=True)
    return p, np.concatenate(hashes)[first]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, text, none): a row is named by its id and a hash of its text; rows without an id have 0 and hashes of their own."""
    text, given = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return docs.select(F.coalesce(given, F.lit(0)).alias("d"), F.xxhash64(text, given.isNull()).alias("t"), text.alias("text"), given.isNull().alias("none"))


def _suffixes(keyed: DataFrame, length: int, q: int) -> DataFrame:
    """(d, t, pos, q, c): the sampled suffixes, c a hash of all bytes that a string around can cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        scale = powers()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for d, t, text in zip(*(batch.column(i) for i in range(3))):
                raw = text.as_buffer()
                if raw is None or raw.size < length:
                    continue
                view = memoryview(raw)
                p, h = sampled(np.frombuffer(raw, np.uint8), length, q, scale)
                begin, n, reach = np.maximum(p - (length - q), 0), len(view), length
                seeds = (p - begin).tolist()
                c = np.fromiter((xxhash.xxh3_64_intdigest(view[b : e + reach], s) for b, e, s in zip(begin.tolist(), p.tolist(), seeds)), np.uint64, len(p))
                for column, x in zip(out, (np.full(len(p), d.as_py()), np.full(len(p), t.as_py()), p, h.view(np.int64), c.view(np.int64))):
                    column.append(x)
            arrays = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            for i in range(0, len(arrays[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], pa.int32() if k == 2 else pa.int64()) for k, x in enumerate(arrays)], ["d", "t", "pos", "q", "c"])

    return keyed.select("d", "t", "text").mapInArrow(work, "d long, t long, pos int, q long, c long")


def _packed(keyed: DataFrame) -> DataFrame:
    """Texts compressed for the network: (d, t, none, z)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([pack(memoryview(x.as_buffer())) for x in b.column(3)], pa.binary())], ["d", "t", "none", "z"])

    return keyed.select("d", "t", "none", "text").mapInArrow(work, "d long, t long, none boolean, z binary")


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z) if z else b""


CONTEXT = "q long, q2 long, e long, d long, t long, pos int, lead int, near int, far int, bytes binary"


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = (*[pa.int64()] * 5, *[pa.int32()] * 4, pa.binary())
    names = [x.split()[0] for x in CONTEXT.split(", ")]
    for i in range(0, len(rows), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 20_000]), kinds)], names)


def _contexts(joined: DataFrame, length: int, q: int) -> DataFrame:
    """CONTEXT rows: the bytes that the strings around each open suffix can cover.

    The strings of a row start from `near` to `far` bytes before the sampled place, which is `lead`
    bytes in.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, t, z, at in zip(*(b.column(i) for i in range(4))):
                raw = _unpack(z.as_py())
                for x in at.as_py():
                    p = x["pos"]
                    begin = max(p - (length - q), 0)
                    rows.append((x["q"], 0, 0, d.as_py(), t.as_py(), p, p - begin, 0, length - q, raw[begin : p + length]))
                    if len(rows) >= 20_000:
                        yield from _batches(rows)
                        rows = []
            yield from _batches(rows)

    return joined.mapInArrow(work, CONTEXT)


def _parted(contexts: DataFrame, length: int) -> DataFrame:
    """CONTEXT rows of both halves of each row, bucketed by 128 bits of what all strings of the half share.

    e: 64 bits more, of all the bytes of the half.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                middle = (r["near"] + r["far"]) // 2
                for near, far in ((r["near"], middle), (middle + 1, r["far"])):
                    # those of the half that the document has room for
                    n, f = max(near, r["lead"] + length - len(r["bytes"])), min(far, r["lead"])
                    if near > far or n > f:
                        continue
                    shared = r["bytes"][r["lead"] - near : r["lead"] - far + length]
                    h = np.array(divmod(xxhash.xxh3_128_intdigest(shared, far), 1 << 64), np.uint64).view(np.int64)
                    whole = r["bytes"][r["lead"] - f : r["lead"] - n + length]
                    e = int(np.uint64(xxhash.xxh3_64_intdigest(whole, f)).view(np.int64))
                    rows.append((int(h[0]), int(h[1]), e, r["d"], r["t"], r["pos"], f, near, far, whole))
                    if len(rows) >= 20_000:
                        yield from _batches(rows)
                        rows = []
            yield from _batches(rows)

    return contexts.select(*[x.split()[0] for x in CONTEXT.split(", ")]).mapInArrow(work, CONTEXT)


def _shared(parts: list[bytes], keys: list) -> np.ndarray:
    """The longest prefix that each part shares with another of the same key."""
    n = len(parts)
    order = sorted(range(n), key=lambda i: (keys[i], parts[i]))
    width = max(map(len, parts), default=0)
    rows = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in order), np.uint8).reshape(n, width)
    sizes = np.array([len(parts[i]) for i in order])
    differ = rows[1:] != rows[:-1]
    both = np.where(differ.any(1), differ.argmax(1), width) if width else np.zeros(max(n - 1, 0), np.int64)
    both = np.minimum(both, np.minimum(sizes[1:], sizes[:-1]))
    both[[keys[i] != keys[j] for i, j in zip(order, order[1:])]] = 0
    out = np.zeros(n, np.int64)
    out[order] = np.maximum(np.concatenate(([0], both)), np.concatenate((both, [0])))
    return out


def refine(contexts: list[bytes], leads: list[int], length: int, keys: list | None = None) -> list[np.ndarray]:
    """For each context, the offsets of the strings of `length` bytes that another context has too, as far
    from its sampled place (which is `leads` bytes in). keys: the buckets, where contexts are of several.

    Exact. Sorting a bucket by what follows the sampled place, and by what comes before it read
    backwards, shows how far each suffix agrees with any other either way; strings beyond that are unique.
    The rest is settled by buckets of 8 bytes that are refined by the buckets of later offsets until they stand
    for `length` bytes; only strings all of whose buckets hold two and more go on. Being as far from the sampled
    place keeps a string apart from itself where contexts of one document overlap.
    """
    if not contexts:
        return []
    keys = [0] * len(contexts) if keys is None else keys
    after = _shared([c[k:] for c, k in zip(contexts, leads)], keys)
    before = _shared([c[:k][::-1] for c, k in zip(contexts, leads)], keys)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    data = np.frombuffer(b"".join(contexts) + bytes(8), np.uint8)
    n = len(data)
    away = np.arange(n) - np.concatenate((np.repeat(begins + np.array(leads), sizes), np.zeros(8, np.int64)))
    at = begins + np.array(leads)
    first, last = np.maximum(begins, at - before), np.minimum(ends, at + after) - length
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(first.tolist(), last.tolist()) if a <= b] or [np.empty(0, np.int64)])
    bucket = np.zeros(n, np.uint64)
    for k in range(8):
        bucket[: n - 7] |= data[k : n - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    size = 8
    while size < length and len(starts):
        step = min(size, length - size)
        need = np.zeros(n + 1, np.int64)
        need[starts] += 1
        need[starts + length - size - step + 1] -= 1
        at = np.nonzero(np.cumsum(need[:-1]) > 0)[0]
        keys = (bucket[at + step], bucket[at]) + ((away[at],) if size == 8 else ())
        order = np.lexsort(keys)
        new = np.zeros(len(at), bool)
        for key in keys:
            s = key[order]
            new[1:] |= s[1:] != s[:-1]
        ids = np.cumsum(new)
        bucket = np.zeros(n, np.uint64)
        bucket[at[order]] = ids
        alone = np.zeros(n + 1, bool)
        alone[at[order] + 1] = np.bincount(ids)[ids] < 2
        size += step
        gone = np.cumsum(alone)
        starts = starts[gone[starts + length - size + 1] == gone[starts]]
    which = np.searchsorted(ends, starts, side="right")
    return np.split(starts - begins[which], np.searchsorted(which, np.arange(1, len(contexts))))


def _local_spans(contexts: DataFrame, length: int) -> DataFrame:
    """(d, t, start, stop) of the buckets that a task can hold; rows come dealt and sorted by bucket."""
    fields = ["q", "q2", "d", "t", "pos", "lead", "bytes"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush(rows: list[dict]) -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for r, offsets in zip(rows, refine([r["bytes"] for r in rows], [r["lead"] for r in rows], length, [(r["q"], r["q2"]) for r in rows])):
                if len(offsets):
                    begin = r["pos"] - r["lead"]
                    for column, x in zip(out, (r["d"], r["t"], begin + int(offsets.min()), begin + int(offsets.max()) + length)):
                        column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64()))], ["d", "t", "start", "stop"])

        for b in batches:
            for r in b.to_pylist():
                # whole buckets only; several small ones are refined together
                if len(held) >= GROUP and (held[-1]["q"], held[-1]["q2"]) != (r["q"], r["q2"]):
                    yield flush(held)
                    held = []
                held.append(r)
        if held:
            yield flush(held)

    return contexts.select(*fields).mapInArrow(work, "d long, t long, start long, stop long")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, group: int = GROUP) -> DataFrame:
    """(d, t, spans): for each document with repeats, the byte spans [start, stop) to remove."""
    keyed = _keyed(docs, id_col, text_col)
    suffixes = stage(_suffixes(keyed, length, q), "suffixes")
    # counts are written before they are joined: then both sides are plain exchanges, which can be split where a bucket is hot
    buckets = stage(suffixes.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("q"), "buckets")
    open_ = stage(suffixes.join(buckets, "q"), "open")
    # refined by everything around: (q, c) together are 128 bits
    whole = stage(open_.groupBy("q", "c").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("d", "t", "pos")).alias("first")).where("m > 1"), "whole")
    flagged = stage(open_.join(whole.select("q", "c", "m"), ["q", "c"], "left"), "flagged")
    done = flagged.where("m is not null").select("d", "t", F.greatest(F.col("pos") - (length - q), F.lit(0)).cast("long").alias("start"), (F.col("pos") + length).cast("long").alias("stop"))
    # the edges: suffixes that share their q-gram but not everything around; of those that do, one stands for all
    first = whole.select("q", F.col("first.d").alias("d"), F.col("first.t").alias("t"), F.col("first.pos").alias("pos"))
    edges = flagged.where("m is null").select("q", "d", "t", "pos").unionByName(first)
    sizes = stage(edges.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("q"), "sizes")
    wanted = edges.join(sizes, "q").groupBy("d", "t").agg(F.collect_list(F.struct("q", "pos")).alias("at"))
    contexts = _contexts(_packed(keyed).join(wanted, ["d", "t"]).select("d", "t", "z", "at"), length, q)
    found = done
    level = 0
    while True:
        contexts = stage(contexts, "contexts")
        if level:
            # halves that are equal throughout are finished; one of them stands for all
            equal = stage(contexts.groupBy("q", "q2", "e").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("d", "t", "pos")).alias("first")).where("m > 1").drop("m"), "equal")
            matched = contexts.join(equal, ["q", "q2", "e"], "left")
            begin = (F.col("pos") - F.col("lead")).cast("long")
            found = found.unionByName(matched.where("first is not null").select("d", "t", begin.alias("start"), (begin + F.octet_length("bytes")).alias("stop")))
            contexts = stage(matched.where(F.col("first").isNull() | (F.col("first") == F.struct("d", "t", "pos"))).drop("first"), "distinct-contexts")
        counts = stage(contexts.groupBy("q", "q2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
        held = contexts.join(counts, ["q", "q2"])
        single = F.col("near") == F.col("far")
        # all that such a row stands for is one string: distinct ones cannot share a bucket but by a clash of hashes
        fits = held.where(~single & (F.col("n") <= group))
        found = found.unionByName(_local_spans(fits.repartition("q", "q2").sortWithinPartitions("q", "q2"), length))
        large = held.where(~single & (F.col("n") > group))
        if large.isEmpty():
            break
        contexts, level = _parted(large, length), level + 1
    return found.groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def united(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Spans in order, cut to the text, with those that touch made one."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        stop = min(stop, size)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept): `kept` holds the remaining bytes of each document."""
    keyed = _keyed(docs, id_col, text_col)
    found = _packed(keyed).join(repeated_spans(docs, id_col, text_col, length, q, group), ["d", "t"], "left").select("d", "z", "spans", "none")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary())
        for b in batches:
            rows: list[tuple] = []
            for d, z, spans, none in zip(*(b.column(i) for i in range(4))):
                raw = _unpack(z.as_py())
                cut = united([(x["start"], x["stop"]) for x in spans.as_py() or ()], len(raw))
                edges = [0, *(x for span in cut for x in span), len(raw)]
                kept = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2]))
                rows.append((None if none.as_py() else d.as_py(), len(raw), len(raw) - len(kept), [{"start": i, "stop": j} for i, j in cut], kept))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 5, kinds)], ["d", "n_bytes", "n_removed", "spans", "kept"])

    out = found.mapInArrow(work, "d long, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>, kept binary")
    return out.select(F.col("d").alias(id_col), "n_bytes", "n_removed", "spans", "kept")


def brute_force(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """The spans of `repeated_spans` by counting every string; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    return [united([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1], len(t)) for t in texts]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
