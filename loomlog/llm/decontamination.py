"""Find documents that hold passages of a benchmark.

Windows of an item's size slide over the words of each whole document. Windows that can reach the similarity get a SimHash of their
weighted word shingles, and meet the items of their size whose fingerprints lie within `radius` bits. Candidates are
verified by exact weighted-shingle similarity.

1. A sieve, a bitmap of the items' shingles of at most SIEVE bits (16 MB), alone and with their item's size, goes to every task. A window
   of n shingles that is similar to an item of n shares 2 n s / (1 + s) of them with it (89 % at s = 0.8), so a window
   with fewer in the sieve is left out: nothing is lost, and a full sieve only lets more through.
2. Windows are told apart by their shingles: each content is kept once a task and joined once, so a passage that a third of all
   documents hold is judged a few times, and equal texts are judged once.
3. Contents and items are joined in Spark by size. The multi-index: a fingerprint is 32 blocks of two bits; two that differ in at most
   `radius` bits agree on at least 32 - radius of them, which is counted on all blocks of a pair at once. An index by single
   blocks does not tell apart at the radius that a similarity of 0.8 needs (a random lookup meets 99 of 100 items).

Items never pass through the driver, which holds the sieve and the list of the items' sizes, and the documents are read once however many items
there are.

Words are runs of letters, digits and underscores, in lower case. Defined cases: null and empty texts match nothing; items
with fewer words than a shingle (five) have none and match nothing; of equal items each matches; a document shorter than an
item is one window; repeated rows each match; null ids are kept; of windows that tie the first counts; an empty table on either side
gives an empty result; other columns are not read. Ids are cast to long.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import stage

WORD = re.compile(r"\w+")
SHINGLE, SIMILARITY, RADIUS, SIEVE = 5, 0.8, 20, 1 << 27
#: What a task remembers of words, texts and contents; what it forgets is only worked out or sent again.
REMEMBERED = 100_000
_BASE = 0x9E3779B97F4A7C15


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_hashes(tokens: list[str], size: int, known: dict[str, int] | None = None) -> np.ndarray:
    """64-bit hashes of the word shingles; known: remembers the hashes of words."""
    import xxhash

    if len(tokens) < size:
        return np.empty(0, np.uint64)
    h, known = xxhash.xxh3_64_intdigest, {} if known is None else known
    if len(known) > REMEMBERED:
        known.clear()
    for t in set(tokens).difference(known):
        known[t] = h(t.encode("utf-8", "surrogatepass"))
    each = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    out, n = np.zeros(len(tokens) - size + 1, np.uint64), len(tokens) - size + 1
    for k in range(size):
        out = (out ^ each[k : n + k]) * np.uint64(_BASE)
        out ^= out >> np.uint64(29)
    return out


def bits(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    as_bytes = np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(as_bytes, axis=1, bitorder="little").astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of 64 sums: a bit is 1 if its sum is positive."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


def needed(a: int, b: int, similarity: float) -> int:
    """How many shingles bags of a and b must share to be that similar."""
    return math.ceil(similarity * (a + b) / (1 + similarity) - 1e-9)


def sized(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hashes of shingles together with the size of an item."""
    out = (hashes ^ np.uint64((n * _BASE) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(_BASE)
    return out ^ (out >> np.uint64(31))


class Sieve:
    """A bitmap of hashes, which may say yes to others too."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(8 * len(bits) - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def windows(h: np.ndarray, sieve: Sieve, sizes: list[int], similarity: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(item size, window size, starts) of the windows that can be similar to an item of that size."""
    hit = np.nonzero(sieve.has(h))[0]
    for n in sizes:
        size = min(n, len(h))
        least = needed(n, size, similarity)
        if least > size or len(hit) < least:
            continue
        own = hit[sieve.has(sized(h[hit], n))]
        if len(own) < least:
            continue
        held = np.zeros(len(h) + 1, np.int64)
        held[own + 1] = 1
        np.cumsum(held, out=held)
        starts = np.nonzero(held[size:] - held[:-size] >= least)[0]
        if len(starts):
            yield n, size, starts


def _items(benchmark: DataFrame, item_col: str, item_text_col: str, shingle: int) -> DataFrame:
    """(item, n, fp, bag) of each item; bag holds its shingles in order of their hash, repeats included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, h) for i, t in zip(b.column(0).to_pylist(), b.column(1)) if len(h := shingle_hashes(words(t.as_py() or ""), shingle))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in found], pa.int64()), pa.array([len(h) for _, h in found], pa.int32()), pa.array([_fp(h) for _, h in found], pa.int64()), pa.array([np.sort(h).view(np.int64) for _, h in found], pa.list_(pa.int64()))],
                ["item", "n", "fp", "bag"],
            )

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    return stage(rows.mapInArrow(work, "item long, n int, fp long, bag array<long>"), "items")


def _fp(h: np.ndarray) -> int:
    """The SimHash of a window as a signed number."""
    sums = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        sums += bits(h[i : i + 65536]).sum(0)
    return int(packed(sums[None, :]).view(np.int64)[0])


def _sieve(items: DataFrame, most: int) -> np.ndarray:
    """The bitmap of the items' shingles, as bytes; at most `most` bits, 16 for each of two hashes a shingle."""
    each = items.select("n", F.explode("bag").alias("h"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            also = [sized(h[n == k], int(k)) for k in np.unique(n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h, *also]).view(np.int64))], ["h"])

    hashes = each.mapInArrow(both, "h long").distinct()
    count = each.count()
    size = min(max(1 << (32 * max(count, 1) - 1).bit_length(), 1 << 15), most)
    place = F.col("h").bitwiseAND(F.lit(size - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(size // 8, np.uint8)
    for r in rows:  # at most SIEVE / 32768 of them
        out[(r.b - 1) * 4096 : r.b * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def _matches(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, shingle: int, similarity: float, radius: int, sieve_bits: int) -> DataFrame:
    """(key, item, similarity, first_word, n_words): the best window of each item in each distinct text, named by its md5."""
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text_col, shingle)
    sizes = sorted(r.n for r in items.select("n").distinct().collect())  # one number for each length of item
    sent = spark.sparkContext.broadcast((_sieve(items, sieve_bits), sizes))
    names = ["key", "c", "n", "size", "at", "fp", "bag"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sieve, known, met, texts = Sieve(sent.value[0]), {}, set(), set()
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ((),) * 7, kinds)], names)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1)):
                if key in texts:
                    continue
                h = shingle_hashes(words(text.as_py()), shingle, known)
                first = True
                for n, size, starts in windows(h, sieve, sent.value[1], similarity) if len(h) else ():
                    if first and len(texts) < REMEMBERED:
                        texts.add(key)  # equal texts hold the same windows
                    first, seen = False, set()
                    for at in starts.tolist():
                        bag = np.sort(h[at : at + size])
                        c = int(np.uint64(xxhash.xxh3_64_intdigest(bag.tobytes(), n)).view(np.int64))
                        if c in seen:
                            continue
                        seen.add(c)
                        new = c not in met
                        if len(met) < REMEMBERED:
                            met.add(c)
                        rows.append((key, c, n, size, at, _fp(bag) if new else None, bag.view(np.int64) if new else None))
                        if len(rows) >= 2000:
                            yield made()
                            rows = []
        yield made()

    text = F.col(text_col).cast("string")
    rows = docs.where(text.isNotNull()).select(F.md5(text).alias("key"), text.alias("text"))
    found = stage(rows.mapInArrow(work, "key string, c long, n int, size int, at long, fp long, bag array<long>"), "windows")
    contents = found.where("bag is not null").groupBy("c", "n").agg(F.first(F.struct("fp", "bag")).alias("x")).select("c", "n", "x.fp", "x.bag")
    salts = 8  # items are few beside the windows of a size
    left = contents.withColumn("salt", F.pmod("c", F.lit(salts)))
    right = items.select("item", F.col("n").alias("m"), F.col("fp").alias("of"), F.col("bag").alias("its"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("on"))
    apart = F.col("fp").bitwiseXOR(F.col("of"))
    blocks = F.bit_count(apart.bitwiseOR(F.shiftrightunsigned(apart, 1)).bitwiseAND(F.lit(0x5555555555555555)))  # that differ
    near = left.join(right, (F.col("n") == F.col("m")) & (F.col("salt") == F.col("on")) & (blocks <= radius) & (F.bit_count(apart) <= radius))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, 500) for x in batches for i in range(0, x.num_rows, 500)):
            said = [weighted_similarity(Counter(x), Counter(y)) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(said, pa.float64())], ["c", "n", "item", "similarity"]).filter(pa.array([x >= similarity for x in said], pa.bool_()))

    same = stage(near.select("c", "n", "item", "bag", "its").mapInArrow(verify, "c long, n int, item long, similarity double"), "contents-found")
    best = F.max(F.struct("similarity", (-F.col("at")).alias("at"), "size")).alias("x")
    held = found.select("key", "c", "n", "size", "at").join(same, ["c", "n"]).groupBy("key", "item").agg(best)
    return held.select("key", "item", "x.similarity", (-F.col("x.at")).alias("first_word"), (F.col("x.size") + shingle - 1).cast("long").alias("n_words"))


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, sieve_bits: int = SIEVE) -> DataFrame:
    """(id, item id, similarity, first_word, n_words): the best window of each item in each document."""
    held = _matches(docs, benchmark, text_col, item_col, item_text_col, shingle, similarity, radius, sieve_bits)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.md5(F.col(text_col).cast("string")).alias("key"))
    return rows.join(stage(held, "matches"), "key").select(F.col("d").alias(id_col), F.col("item").alias(item_col), "similarity", "first_word", "n_words")


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, sieve_bits: int = SIEVE) -> DataFrame:
    """The documents that hold no item, with their columns; the texts that hold one are joined away by their md5."""
    held = _matches(docs, benchmark, text_col, item_col, item_text_col, shingle, similarity, radius, sieve_bits)
    own = "__key"
    while any(c.lower() == own for c in docs.columns):
        own = f"_{own}"
    gone = stage(held.select(F.col("key").alias(own)).distinct(), "held")
    return docs.withColumn(own, F.md5(F.col(text_col).cast("string"))).join(gone, own, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
