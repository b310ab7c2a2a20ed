"""Token totals, quantiles and truncated totals from an exact histogram of encoded lengths.

A tokenizer of the public vocabulary files encodes every whole text; documents are then aggregated
by encoded length, and suffix sums over the lengths answer every context limit at once: how many
documents and tokens are longer, and what is left of the corpus when each document is cut there.

Defined cases: null and empty texts have length 0 and are counted; an empty table gives an empty
histogram; repeated rows count each time; a run of white space of any length is encoded (see `encoder`); other columns are
not read. The vocabulary is a file that each executor has, or `vocabulary` names one that it has.
"""

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how that vocabulary cuts a text before its merges.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"


#: White space as the pattern means it, in runs that the pattern's own matcher cannot look through.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}+")


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> Callable[[str], list[int]]:
    """The tokens of a whole text.

    With PATTERN, a long run of white space is cut out before: all but its last character is one piece of its own there (all of it at
    the end of a text), and what is before and after it is cut the same alone, so the tokens are those of the whole text.
    """
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    coder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        out, at = [], 0
        for space in LONG_SPACE.finditer(text) if pattern == PATTERN else ():
            stop = space.end() - (space.end() < len(text))
            out += coder.encode_ordinary(text[at : space.start()])
            out += coder._core_bpe.encode_single_piece(text[space.start() : stop].encode())
            at = stop
        return out + coder.encode_ordinary(text[at:]) if out else coder.encode_ordinary(text[at:])

    return encode


def encoded_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(id, n_tokens) of each document; every text is encoded whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern)
        for batch in batches:
            lengths = [len(encode(text.as_py() or "")) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64())], ["id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "id long, n_tokens long").withColumnRenamed("id", id_col)


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """(n_tokens, docs): how many documents have each encoded length."""
    return lengths.groupBy(F.col(column).alias("n_tokens")).agg(F.count(F.lit(1)).alias("docs"))


def suffix_sums(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """For each length L that occurs: docs and tokens at or above L, and totals cut at L.

    Columns: n_tokens, docs, tokens, docs_at_least, tokens_at_least, docs_up_to, tokens_if_cut
    (the corpus total when every document is cut to L tokens) and quantile (the share of documents
    of at most L tokens). Sums run inside blocks of lengths, and over one row a block, so that no
    task holds all lengths.
    """
    h = histogram.select("n_tokens", "docs", (F.col("n_tokens") * F.col("docs")).alias("tokens"), F.floor(F.col("n_tokens") / block).alias("b"))
    blocks = h.groupBy("b").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    later = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    blocks = blocks.select(
        "b",
        F.coalesce(F.sum("bd").over(later), zero).alias("later_docs"),
        F.coalesce(F.sum("bt").over(later), zero).alias("later_tokens"),
        F.sum("bd").over(every).alias("all_docs"),
        F.sum("bt").over(every).alias("all_tokens"),
    )
    inside = Window.partitionBy("b").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.select("*", F.sum("docs").over(inside).alias("in_docs"), F.sum("tokens").over(inside).alias("in_tokens")).join(blocks, "b")
    at_docs, at_tokens = F.col("in_docs") + F.col("later_docs"), F.col("in_tokens") + F.col("later_tokens")
    up_to = F.col("all_docs") - at_docs + F.col("docs")
    return out.select(
        "n_tokens",
        "docs",
        "tokens",
        at_docs.alias("docs_at_least"),
        at_tokens.alias("tokens_at_least"),
        up_to.alias("docs_up_to"),
        (F.col("all_tokens") - at_tokens + F.col("n_tokens") * at_docs).alias("tokens_if_cut"),
        F.round(up_to / F.col("all_docs"), 9).alias("quantile"),
    )


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The histogram of `docs` with its suffix sums, see `suffix_sums`."""
    from loomlog.llm.common import stage

    return suffix_sums(stage(length_histogram(encoded_lengths(docs, id_col, text_col, vocabulary, pattern)), "token-lengths"))


def answer(sums: DataFrame, limits: list[int], quantiles: list[float]) -> DataFrame:
    """(kind, at, value) for context limits (`cut`: total of texts cut there) and quantiles (`length`).

    A limit between two lengths is answered from the next longer length that occurs: below it, the
    total falls by one token for each document that is at least that long.
    """
    spark = sums.sparkSession
    cut = None
    for limit in limits:
        above = sums.where(F.col("n_tokens") >= limit).agg(F.min_by(F.struct("n_tokens", "docs_at_least", "tokens_if_cut"), "n_tokens").alias("x"), F.lit(1).alias("one"))
        total = sums.agg(F.sum("tokens").alias("all"), F.lit(1).alias("one"))
        row = total.join(above, "one").select(
            F.lit("cut").alias("kind"), F.lit(float(limit)).alias("at"),
            F.when(F.col("x").isNull(), F.coalesce("all", F.lit(0)))
            .otherwise(F.col("x.tokens_if_cut") - (F.col("x.n_tokens") - limit) * F.col("x.docs_at_least")).cast("long").alias("value"),
        )
        cut = row if cut is None else cut.unionAll(row)
    for q in quantiles:
        row = sums.where(F.col("quantile") >= q - 1e-9).agg(F.min("n_tokens").alias("value")).select(F.lit("length").alias("kind"), F.lit(float(q)).alias("at"), F.col("value").cast("long"))
        cut = row if cut is None else cut.unionAll(row)
    return cut if cut is not None else spark.createDataFrame([], "kind string, at double, value long")
