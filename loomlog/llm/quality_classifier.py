"""A quality classifier: a generalised additive model with pairwise interactions.

Features are simple measures of the whole text. Each is cut into quantile bins; cyclic boosting fits
small trees on the bins of one feature at a time, each adding to that feature's lookup table, then on
the two-way bins of the pairs that explain most of what is left. A document's score is the logistic of
the sum of its table entries, so scoring adds up array lookups.

The model is fitted on at most `max_labelled` labelled rows, those with the smallest hash of their
id; only their feature rows (some twenty numbers each) reach the driver. Labels, languages, sources and ids are never
inputs of a score.

Defined cases: null and empty texts are scored like any other (all their measures are zero); labels
that are null, or whose document is missing, are left out; repeated rows each count; with no usable
labels every score is 0.5, and with one class every score is that class's smoothed share; an empty
table gives an empty result; other columns are not read, and one named like the scores gives way to them
(`accept` adds none).
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper", "digit", "space", "newline", "non_ascii", "stop_mark", "other_mark",
    "symbol", "bar", "exclaim", "distinct_words", "distinct_lines", "repeated_trigrams", "deflated", "line_length", "ended_lines",
)
MAX_LABELLED = 20_000

_CLASS = np.zeros(256, np.int64)  # 0 other, then by kind of byte
for _kind, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", range(128, 256), b".,;:?'\"-()", b"$%&*#@~^_=+<>{}[]\\/", b"|", b"!"), 1):
    _CLASS[list(_bytes)] = _kind


def features(text: str) -> list[float]:
    """The measures named in FEATURES, of one whole text."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    if n == 0:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(data, np.uint8), minlength=256), minlength=11)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    nw, nl = max(len(words), 1), max(len(lines), 1)
    letters = max(kinds[1] + kinds[2] + kinds[6], 1)
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    trigrams = max(len(words) - 2, 1)
    repeated = 1 - len(set(zip(words, words[1:], words[2:]))) / trigrams if len(words) > 2 else 0.0
    deflater, packed = zlib.compressobj(1), 0
    for i in range(0, n, 1 << 20):
        packed += len(deflater.compress(data[i : i + (1 << 20)]))
    packed += len(deflater.flush())
    return [
        np.log1p(n), np.log1p(len(words)), sum(map(len, words)) / nw, np.log1p(max(map(len, words), default=0)), kinds[1] / letters, kinds[3] / n, kinds[4] / n, kinds[5] / n, kinds[6] / n, kinds[7] / n,
        kinds[0] / n, kinds[8] / n, kinds[9] / n, kinds[10] / n, len(set(words)) / nw, len(set(lines)) / nl, repeated, packed / n, np.log1p(n / nl), ended / nl,
    ]


@dataclass
class Additive:
    """Lookup tables over bins: `cuts` of each feature, a table a feature, and tables of pairs."""

    cuts: list = field(default_factory=list)
    base: float = 0.0
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # (i, j, table over coarse bins)
    coarse: int = 8

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), np.int64)

    def _coarse(self, b: np.ndarray, i: int) -> np.ndarray:
        return b[:, i] * self.coarse // (len(self.cuts[i]) + 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b, z = self.bins(x), np.full(len(x), self.base)
        for i, t in enumerate(self.tables):
            z += t[b[:, i]]
        for i, j, t in self.pairs:
            z += t[self._coarse(b, i), self._coarse(b, j)]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins with gradient sums g and weights h."""
    value, edges = lambda a, b: g[a:b].sum() / (h[a:b].sum() + ridge), [0, len(g)]
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + ridge)
    while len(edges) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gains = gl**2 / (hl + ridge) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + ridge) - gain(a, b)
                k = int(np.argmax(gains))
                best = max(best, (float(gains[k]), a + k + 1))
        if not best[1]:
            break
        edges = sorted([*edges, best[1]])
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = value(a, b)
    return out


def _square(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The best table of four leaves (one cut each way) over two-way bins, and its gain."""
    gc, hc = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = gc[:-1, :-1], hc[:-1, :-1]
    parts = ((a, b), (gc[:-1, -1:] - a, hc[:-1, -1:] - b), (gc[-1:, :-1] - a, hc[-1:, :-1] - b), (gc[-1, -1] - gc[:-1, -1:] - gc[-1:, :-1] + a, hc[-1, -1] - hc[:-1, -1:] - hc[-1:, :-1] + b))
    gains = sum(x**2 / (y + ridge) for x, y in parts)
    r, c = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.empty_like(g)
    for rows, cols, (x, y) in ((slice(None, r + 1), slice(None, c + 1), parts[0]), (slice(None, r + 1), slice(c + 1, None), parts[1]), (slice(r + 1, None), slice(None, c + 1), parts[2]), (slice(r + 1, None), slice(c + 1, None), parts[3])):
        out[rows, cols] = x[r, c] / (y[r, c] + ridge)
    return out, float(gains[r, c])


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 60, pairs: int = 6, rate: float = 0.15, leaves: int = 4, ridge: float = 5.0) -> Additive:
    """Fit the tables on the rows x with 0/1 labels y."""
    model = Additive()
    if len(y) == 0:
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    model.cuts = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    b, z = model.bins(x), np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for i, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, i], g, len(t)), np.bincount(b[:, i], h, len(t)), leaves, ridge)
            t += step
            z += step[b[:, i]]
    k = model.coarse
    cells = {(i, j): model._coarse(b, i) * k + model._coarse(b, j) for i, j in combinations(range(x.shape[1]), 2)}
    sums = lambda c, v: np.bincount(c, v, k * k).reshape(k, k)
    g, h = slopes()
    ranked = sorted(cells, key=lambda ij: -_square(sums(cells[ij], g), sums(cells[ij], h), ridge)[1])[:pairs]
    model.pairs = [(i, j, np.zeros((k, k))) for i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, t in model.pairs:
            g, h = slopes()
            step = rate * _square(sums(cells[i, j], g), sums(cells[i, j], h), ridge)[0]
            t += step
            z += step.ravel()[cells[i, j]]
    return model


def feature_rows(docs: DataFrame, text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """The columns `keep` of docs and the array `x` of each text's features."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep), "x array<double>"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[list(keep)].assign(x=[features(t or "") for t in b[text_col]])

    return docs.select(*keep, F.col(text_col).cast("string").alias(text_col)).mapInPandas(work, schema)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_labelled: int = MAX_LABELLED, exclude=None) -> Additive:
    """Fit on at most `max_labelled` of the labelled rows for which the condition `exclude` is not true."""
    named = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)")
    if exclude is not None:
        named = named.where(~exclude(F.col("i")))
    chosen = named.orderBy(F.xxhash64("i"), "i", "y").limit(max_labelled)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")  # at most max_labelled narrow rows
    found = feature_rows(rows, "t", ("i", "y")).orderBy(F.xxhash64("i"), "i", "x").limit(max_labelled).collect()
    return fit(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.y for r in found], dtype=float))


def _scores(texts: pa.Array, model: Additive) -> np.ndarray:
    return model.score(np.array([features(t.as_py() or "") for t in texts]).reshape(-1, len(FEATURES)))


def score(docs: DataFrame, model: Additive, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column `score_col` from 0 to 1, in place of one of that name; other columns pass through."""
    if score_col.lower() == text_col.lower():
        raise ValueError("the scores cannot take the place of the text")
    rest = docs.drop(score_col)
    schema = StructType([*rest.schema.fields, StructField(score_col, DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(_scores(b.column(b.schema.get_field_index(text_col)), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, found], [*b.schema.names, score_col])

    return rest.mapInArrow(work, schema)


def accept(docs: DataFrame, model: Additive, lowest: float, text_col: str = "text") -> DataFrame:
    """The rows of docs that score `lowest` or more, with no column added or changed."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(b.schema.get_field_index(text_col)), model) >= lowest, pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def feature_scores(docs: DataFrame, model: Additive, keep: tuple, text_col: str = "text") -> DataFrame:
    """The columns `keep` of docs and their scores, without carrying the texts back."""
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array(_scores(b.column(len(keep)), model), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], found], [*b.schema.names[: len(keep)], "score"])

    return rows.mapInArrow(work, schema)
