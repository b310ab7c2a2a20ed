"""Near-duplicate groups from 64-bit SimHash fingerprints.

Fingerprints of whole texts are made in Arrow batches. Equal fingerprints collapse first. The rest
is a pigeonhole join: of six blocks of bits, fingerprints that differ in at most three bits agree on
three, so each fingerprint is filed under the twenty ways to choose them. A file of more than
`group` fingerprints is not compared all against all: its free bits are split into six blocks again, by
the same argument and with nothing lost. After three levels at most eight bits are free, so that
no file can hold more than 256 fingerprints, however many documents crowd around one point. Pairs are
verified by Hamming distance in the task that holds the file, which passes on a spanning star of
each piece, never all pairs. Components of these links give the groups.

`keep_one`, the stage of a pipeline, links rows whose sets of five-word shingles have a Jaccard similarity of at least 0.8. Such
pairs differ in ten bits or so, and blocks narrow enough for a pigeonhole would be three bits each, which tell nothing apart. The
blocks are those of another fingerprint: 32 of three minima each, under other orders of the shingles, of the rarer 60 % of a set, since passages
that many documents hold would file these together. Sets of similarity 0.8 whose differences all are rare
share none of them 3 times in a million, more similar ones less often. Pairs with a file's first row are sieved by a SimHash of the sets in
256 bits (39 differ on average at 0.8, 66 may), and verified exactly; files which that leaves open are compared whole and exactly in a task.

Defined cases: null and empty texts have the fingerprint zero and link like any other; shorter texts
than one shingle are hashed whole; a null id never becomes a component id unless its whole component
has none; repeated rows each get a row; an empty table gives an empty result.
"""

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from loomlog.llm.common import stage
from loomlog.llm.components import components

BLOCKS, RADIUS, LEVELS = 6, 3, 3
#: Of `keep_one`.
NEAR_WORDS, SIMILARITY, NEAR_RADIUS, KEYS, MINIMA, RARE = 5, 0.8, 66, 32, 3, 0.6


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included, as an unsigned number."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(words, len(tokens))
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[s:e], seed) for s, e in zip(starts[: len(tokens) - size + 1].tolist(), ends[size - 1 :].tolist())), np.uint64, len(tokens) - size + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * ones[i] > len(hashes)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", words, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(work, "id long, fp long")


def child_masks(mask: int) -> list[int]:
    """The masks that fix three of six blocks of the bits that `mask` leaves free."""
    free = [i for i in range(64) if not mask >> i & 1]
    blocks = [sum(1 << i for i in part) for part in np.array_split(np.array(free, dtype=object), BLOCKS)]
    return sorted({mask | sum(chosen) for chosen in combinations(blocks, BLOCKS - RADIUS)})


def _files(rows: DataFrame) -> DataFrame:
    """(mask, fp) -> (mask, value, fp): each fingerprint under the next finer masks."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            for mask, part in b.groupby("mask"):
                if mask not in known:
                    known[mask] = np.array(child_masks(int(np.uint64(np.int64(mask)))), dtype=np.uint64)
                fps, masks = part["fp"].to_numpy().view(np.uint64), known[mask]
                for i in range(0, len(fps), 50_000):
                    some = fps[i : i + 50_000]
                    yield pd.DataFrame({"mask": np.repeat(masks.view(np.int64), len(some)), "value": (masks[:, None] & some[None, :]).ravel().view(np.int64), "fp": np.tile(some.view(np.int64), len(masks))})

    return rows.mapInPandas(work, "mask long, value long, fp long")


def settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the first one of its piece, where links (a, b) go both ways."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def linked(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of a file's fingerprints, the place of the first one of its piece."""
    n = len(fps)
    near = [np.nonzero(np.bitwise_count(fps[i : i + 256, None] ^ fps[None, :]) <= radius) for i in range(0, n, 256)]
    return settled(n, np.concatenate([x + 256 * i for i, (x, _) in enumerate(near)]), np.concatenate([y for _, y in near]))


def _links(files: DataFrame, radius: int) -> DataFrame:
    """(a, b) from rows with an array `fps` of a bounded number of fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                values = np.unique(fps.values.to_numpy(zero_copy_only=False))
                root = linked(values.view(np.uint64), radius)
                other = root != np.arange(len(values))
                a.append(values[other])
                b.append(values[root[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, np.int64)) for x in (a, b)], ["a", "b"])

    return files.select("fps").mapInArrow(work, "a long, b long")


def hamming_links(fps: DataFrame, radius: int = RADIUS, group: int = 1024) -> DataFrame:
    """(a, b): links whose components are those of all pairs of `fp` within the radius.

    fps has one column fp of distinct longs.
    """
    if radius > RADIUS:
        raise ValueError(f"six blocks, of which three are fixed, hold for a radius of at most {RADIUS}")
    rows, out = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), None
    for level in range(LEVELS):
        files = _files(rows)
        if level:
            files = files.distinct()
        sizes = files.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        files = stage(files.join(sizes, ["mask", "value"]), f"files-{level}")
        small = files if level == LEVELS - 1 else files.where(F.col("n") <= group)
        found = stage(_links(small.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")), radius).distinct(), f"links-{level}")
        out = found if out is None else out.unionAll(found)
        if level == LEVELS - 1:
            break
        rows = files.where(F.col("n") > group).select("mask", "fp")
        if rows.isEmpty():
            break
    return out


def _least_of_group(made: DataFrame, value: Column, name: str, radius: int, group: int) -> DataFrame:
    """(fp, name): the least value among the rows of made that belong to the group of each fingerprint."""
    nodes = made.groupBy("fp").agg(F.min(value).alias("low"))
    roots = components(hamming_links(nodes.select("fp"), radius, group))
    root_of = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = root_of.groupBy("root").agg(F.min("low").alias(name))
    return root_of.join(lows, "root").select("fp", name)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, radius: int = RADIUS, group: int = 1024) -> DataFrame:
    """(id, fingerprint, component_id) of each document; component_id is the smallest id reachable."""
    made = stage(fingerprints(docs, id_col, text_col, words, seed), "fingerprints")
    named = _least_of_group(made, F.col("id"), "component_id", radius, group)
    return made.join(named, "fp", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is hashed whole, an empty one is {0}."""
    import xxhash

    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(1, np.uint64)
    return np.unique(shingle_hashes([xxhash.xxh3_64_intdigest(t) for t in tokens], min(words, len(tokens))))


def shingle_hashes(tokens: list[int], size: int) -> np.ndarray:
    """64-bit hashes of the runs of `size` hashed tokens."""
    each, n = np.array(tokens, np.uint64), len(tokens) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ each[k : n + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _set_fingerprint(hashes: np.ndarray) -> list[int]:
    """SimHash of a set of shingles in 256 bits, as four signed numbers."""
    ones = np.zeros((4, 64), np.int64)
    for i in range(0, len(hashes), 16384):
        part = hashes[i : i + 16384]
        for k in range(4):
            mixed = (part ^ np.uint64(k * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(33)
            ones[k] += np.unpackbits(np.ascontiguousarray(mixed.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=1, bitorder="little").view("<i8").ravel().tolist()


def _common(rows: DataFrame, words: int, share: int = 1024, least: int = 64, most: int = 1 << 17, buckets: int = 1 << 20) -> np.ndarray:
    """Shingles that at least `least` texts and one in `share` hold, the rarest first; of more than `most` the most frequent.

    Every text counts. Shingles are first counted in buckets, whose counts are at least theirs, so that the exact count need only look
    at full buckets; a task holds one number a bucket, and the driver one bit.
    """
    least, mask, size = max(least, rows.count() // share), np.uint64(buckets - 1), 4096

    def sets(b: pa.RecordBatch) -> Iterator[np.ndarray]:
        for i in range(0, b.num_rows, 500):
            yield np.concatenate([_shingle_set(t.as_py() or "", words) for t in b.column(0)[i : i + 500]])

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for b in batches:
            for s in sets(b):
                counts += np.bincount((s & mask).astype(np.int64), minlength=buckets)
        parts = counts.astype("<i4").reshape(-1, size)
        held = np.nonzero(parts.any(1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array([parts[k].tobytes() for k in held], pa.binary())], ["c", "counts"])

    def full(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in part.column("counts"))
        return pa.table({"c": part.column("c")[:1], "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    texts = rows.select("text")
    bits = np.zeros(buckets // 8, np.uint8)
    for r in texts.mapInArrow(bucketed, "c int, counts binary").groupBy("c").applyInArrow(full, "c int, bits binary").collect():
        bits[r.c * size // 8 : (r.c + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(sent.value).astype(bool)
        for b in batches:
            for s in sets(b):
                some, n = np.unique(s[wanted[(s & mask).astype(np.int64)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(some.view(np.int64)), pa.array(n, pa.int64())], ["s", "n"])

    found = texts.mapInArrow(counted, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "s").limit(most).collect()
    return np.array([r.s for r in reversed(found)], np.int64).view(np.uint64)


def rare_part(hashes: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The RARE share of a set, without its most frequent shingles; small sets stay whole."""
    if not len(known) or len(hashes) < 10:
        return hashes
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    order = np.argsort(np.where(known[at] == hashes, rank[at], -1), kind="stable")
    return hashes[order[: math.ceil(RARE * len(hashes))]]


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    """The fixed numbers of the orders by which minima are taken."""
    rng = np.random.default_rng(0)
    return rng.integers(0, 1 << 64, KEYS * MINIMA, np.uint64), rng.integers(0, 1 << 64, KEYS * MINIMA, np.uint64) | np.uint64(1)


def set_keys(hashes: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The KEYS blocks under which a set is filed, each of MINIMA minima of the set's hashes."""
    low = np.full(KEYS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        mixed = (hashes[i : i + 2048, None] ^ orders[0]) * orders[1]
        np.minimum(low, (mixed ^ (mixed >> np.uint64(32))).min(0), out=low)
    low = low.reshape(KEYS, MINIMA)
    out = np.arange(KEYS, dtype=np.uint64)
    for k in range(MINIMA):
        out = (out ^ low[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of rows whose sets of shingles are that similar; texts has n and text."""
    ids = pairs.select(F.col("a").alias("n")).unionAll(pairs.select(F.col("b").alias("n"))).distinct()
    some = stage(texts.join(ids, "n", "left_semi"), "candidate-texts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            keep = []
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                if len(known) > 2000:
                    known.clear()
                for k, text in ((a, s), (b, t)):
                    if k not in known:
                        known[k] = _shingle_set(text or "", words)
                x, y = known[a], known[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(some.select(F.col("n").alias("a"), F.col("text").alias("s")), "a").join(some.select(F.col("n").alias("b"), F.col("text").alias("t")), "b")
    return joined.select("a", "b", "s", "t").mapInArrow(work, "a long, b long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of the sets share: frequent shingles by products of blocks, the others pair by pair."""
    n, size = len(sets), 4096
    shingles, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), [len(s) for s in sets])[np.argsort(place, kind="stable")]
    held = np.repeat(count, count)
    out = np.zeros(n * n)
    for k in range(2, 17):
        of = row[held == k].reshape(-1, k)
        for i in range(0, len(of), size):
            part = of[i : i + size]
            out += np.bincount((part[:, :, None] * n + part[:, None, :]).ravel(), minlength=n * n)
    out = out.reshape(n, n)
    row, column = row[held > 16], np.repeat(np.arange((count > 16).sum()), count[count > 16])
    for i in range(0, int((count > 16).sum()), size):
        to = slice(*np.searchsorted(column, [i, i + size]))
        part = np.zeros((n, size), np.float32)
        part[row[to], column[to] - i] = 1
        out += part @ part.T
    return out


def _links_of_files(files: DataFrame, similarity: float) -> DataFrame:
    """(a, b) from rows (s, i, j, n, root, hashes): links between the rows of a file (s, i, j) that are similar and of different pieces so far.

    A file is compared in the task that holds it, which passes on a link a row and never the pairs.
    """

    def work(file: pa.Table) -> pa.Table:
        n, root = (file.column(k).to_numpy() for k in ("n", "root"))
        order = np.argsort(n)
        n, root = n[order], root[order]
        sets = [file.column("hashes")[i].values.to_numpy(zero_copy_only=False) for i in order.tolist()]
        size, both = np.array([len(x) for x in sets]), overlaps(sets)
        a, b = np.nonzero(both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9)
        low = settled(len(n), a, b)
        new = root != root[low]
        return pa.table({"a": n[new], "b": n[low[new]]})

    return files.groupBy("s", "i", "j").applyInArrow(work, "a long, b long")


def _open(filed: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of files that are of several pieces by the links found, with their piece's root and the file's size.

    Of files that hold the same rows, which 128 bits of hash tell, one is enough.
    """
    roots = components(found).withColumnRenamed("node", "n")
    pieces = stage(filed.join(roots, "n", "left").select("s", "n", "fp", "size", F.coalesce("root", "n").alias("root")), "pieces")
    marks = [F.bit_xor(F.xxhash64("n")).alias("mark"), F.bit_xor(F.xxhash64(F.lit("n"), F.col("n"))).alias("other_mark")]
    several = pieces.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min(F.struct("n", "fp", "size", "root")).alias("low"), F.count(F.lit(1)).alias("m"), F.sum("size").alias("total"), *marks)
    once = several.where("x <> y").groupBy("mark", "other_mark", "m").agg(F.min("s").alias("s"), F.first("low").alias("low"), F.first("total").alias("total"))
    return pieces.join(stage(once.select("s", "low", "m", "total"), "open-files"), "s")


def similar_links(numbered: DataFrame, texts: DataFrame, words: int, similarity: float, radius: int, group: int = 1024, weight: int = 1 << 21) -> DataFrame:
    """(a, b): links whose components are those of all pairs of rows that are similar and share a file.

    numbered has n, fp, size and keys (the blocks by which a row is filed). First each row is compared with the smallest row of all
    its files, which settles a crowd of near copies by one comparison a row; then rows of files that are still of several
    pieces are compared with their files' first rows, and files that are open even then get their rows' sets of shingles, to be
    compared whole. A file of more than `group` rows or `weight` shingles is cut into parts, and each two parts go to a task of their own.
    """
    filed = numbered.select(F.explode("keys").alias("s"), "n", "fp", "size")
    several = filed.groupBy("s").agg(F.min("n").alias("n"), F.max("n").alias("high")).where("n <> high").select("s", "n")
    lows = stage(several.join(numbered.select("n", "fp", "size"), "n").select("s", F.struct("n", "fp", "size").alias("low")), "shared")
    shared = stage(filed.join(lows, "s"), "filed")
    apart = sum((F.bit_count(F.col(f"fp.f{k}").bitwiseXOR(F.col(f"low.fp.f{k}"))) for k in range(4)), F.lit(0))
    close = ((apart <= radius) | (F.least("size", "low.size") < 16)) & (F.least("size", "low.size") >= similarity * F.greatest("size", "low.size") - 1e-9)
    first = stage(shared.where((F.col("n") != F.col("low.n")) & close).groupBy(F.col("n").alias("a")).agg(F.min("low.n").alias("b")), "first-pairs")
    found = stage(_verified(first, texts, words, similarity), "first-links")
    open_ = _open(shared.select("s", "n", "fp", "size"), found)
    more = stage(open_.where((F.col("root") != F.col("low.root")) & close).select(F.col("n").alias("a"), F.col("low.n").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), "more-pairs")
    found = found.unionAll(stage(_verified(more, texts, words, similarity), "more-links"))
    # a pair of rows only is settled by now
    open_ = _open(open_.where("m > 2").select("s", "n", "fp", "size"), found)
    open_ = stage(open_.select("s", "n", "root", "m", "total"), "open-rows")
    some = texts.join(open_.select("n").distinct(), "n", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                b = batch.slice(i, 100)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_shingle_set(t.as_py() or "", words).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], ["n", "hashes"])

    held = stage(some.select("n", "text").mapInArrow(sets, "n long, hashes array<long>"), "open-sets")
    parts = F.greatest(F.ceil(F.col("m") / group), F.ceil(F.col("total") / weight)).cast("int")
    own = F.pmod(F.xxhash64("n"), parts).cast("int")
    others = F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")
    dealt = open_.select("s", "n", "root", own.alias("own"), others).select("s", "n", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return found.unionAll(stage(_links_of_files(dealt.join(held, "n"), similarity).distinct(), "other-links"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = NEAR_WORDS, similarity: float = SIMILARITY, radius: int = NEAR_RADIUS, group: int = 1024, weight: int = 1 << 21) -> DataFrame:
    """The rows of docs with one of each near-duplicate group: that with the smallest id, null ids last.

    Rows are near duplicates if the Jaccard similarity of their sets of word shingles is at least `similarity`; groups are the
    components of such pairs. Rows are told apart by a number of their own, written with them, so that rows which repeat an id are
    judged each; of rows that tie on the smallest id one stays. A task compares at most about 2 x `group` rows and 2 x `weight`
    shingles (or two rows, if these have more). Rows come back with the columns of docs.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("n"))
    made = [StructField("fp", StructType([StructField(f"f{k}", LongType()) for k in range(4)])), StructField("size", LongType()), StructField("keys", ArrayType(LongType()))]
    schema = StructType([f for f in rows.schema if f.name != "text"] + made)

    common = _common(rows, words)
    sent = docs.sparkSession.sparkContext.broadcast((np.sort(common), np.argsort(common)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, (known, rank) = _multipliers(), sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                fps, sizes, keys = [], [], []
                for t in b.column(2):
                    h = _shingle_set(t.as_py() or "", words)
                    fps.append(_set_fingerprint(h))
                    sizes.append(len(h))
                    keys.append(set_keys(rare_part(h, known, rank), orders).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(3), pa.StructArray.from_arrays([pa.array([f[k] for f in fps], pa.int64()) for k in range(4)], [f"f{k}" for k in range(4)]), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                    ["row", "id", "n", "fp", "size", "keys"],
                )

    numbered = stage(rows.mapInArrow(work, schema), "numbered")
    roots = components(similar_links(numbered, numbered.select("n", F.col("row").getField(text_col).cast("string").alias("text")), words, similarity, radius, group, weight))
    named = roots.select(F.col("node").alias("n"), "root").unionAll(roots.select(F.col("root").alias("n"), "root").distinct())
    held = stage(numbered.select("id", "n").join(named, "n").select("id", "n", "root"), "near-groups")
    first = held.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "n")).alias("first"))
    gone = held.join(first, "root").where("n <> first.n").select("n")
    return numbered.select("n", "row").join(gone, "n", "left_anti").select("row.*")
