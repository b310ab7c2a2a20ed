"""Exact deduplication by a 128-bit content hash, with the bytes compared inside each hash group.

Built-in functions only. Hashes are counted first, without texts; only rows whose hash may repeat send their text on. Which those
are is said by a bitmap of SIEVE bits of the repeated hashes, 16 MB at most, so a text that occurs once is not shuffled (but for
chance hits, which cost a little and change nothing). The comparison is done by the aggregate itself: rows are grouped by
(hash, text), so two different texts that share a hash stay apart. Copies collapse on the map side
before anything is shuffled, so a group that holds a third of all rows costs one row a task.

Defined cases: a null text counts as empty; a null id is kept apart from no copy (it only wins a
group in which every id is null); rows that repeat an id and a text belong to the same group: `assign_groups` marks each of them
kept if theirs is the id that stays, and `keep_rows` returns one of them; an empty table gives an empty result; columns beyond the id
and the text ride along, whatever their names and types (maps included).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from loomlog.llm.common import stage

SIEVE = 1 << 27
_PREFIX = "__exact_"
_HASH, _SHA, _TEXT, _ID, _N, _KEEP, _BITS, _AT = (_PREFIX + x for x in ("hash", "sha", "text", "id", "n", "keep", "bits", "at"))


def _chosen(keep: str, column: Column) -> Column:
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.min(column) if keep == "smallest" else F.max(column)


def _place(text: Column) -> Column:
    """Where a text's hash falls among SIEVE bits."""
    return F.pmod(F.xxhash64(text), F.lit(SIEVE))


def _sieve(texts: DataFrame) -> DataFrame:
    """(at, bits): the bitmap of the places of 128-bit hashes that occur more than once, in at most SIEVE / 32768 rows.

    texts has the columns of a hash (_HASH) and its place (_AT).
    """
    repeated = texts.groupBy(_HASH, _AT).agg(F.count(F.lit(1)).alias(_N)).where(F.col(_N) > 1)
    return stage(repeated.groupBy(F.bitmap_bucket_number(_AT).alias(_AT)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(_AT)).alias(_BITS)), "repeated-hashes")


def _may_repeat(rows: DataFrame, sieve: DataFrame) -> DataFrame:
    """rows with the column _N: whether their place (_AT) is set in the bitmap. The bitmap is bounded, so it is broadcast."""
    held = sieve.select(F.col(_AT).alias(_PREFIX + "bucket"), _BITS)
    bit = F.bitmap_bit_position(F.col(_AT))
    byte = F.conv(F.hex(F.substring(F.col(_BITS), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(held), F.bitmap_bucket_number(F.col(_AT)) == F.col(_PREFIX + "bucket"), "left")
    return found.withColumn(_N, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop(_PREFIX + "bucket", _BITS, _AT)


def assign_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row a document: the id, keep_id, group_size, kept and text_sha256.

    Texts whose hash repeats cross the network once, collapsed by task; the way back to the documents is a join of
    narrow rows on the hashes, which adaptive execution splits where one hash is hot.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.md5(text).alias(_HASH), _place(text).alias(_AT))
    base = docs.select(F.col(id_col).alias(_ID), F.md5(text).alias(_HASH), F.sha2(text, 256).alias(_SHA), text.alias(_TEXT), _place(text).alias(_AT))
    sieve = _sieve(hashed)
    groups = (
        _may_repeat(base, sieve).where(_N).groupBy(_HASH, _SHA, _TEXT)
        .agg(_chosen(keep, F.col(_ID)).alias(_KEEP), F.count(F.lit(1)).alias(_N))
        .where((F.col(_N) > 1) | F.col(_KEEP).isNull())
        .select(_HASH, _SHA, _KEEP, _N)
    )
    # The second, 256-bit hash names the text within its 128-bit group on the way back.
    back = base.select(_ID, _HASH, _SHA).join(stage(groups, "groups"), [_HASH, _SHA], "left")
    keep_id = F.coalesce(F.col(_KEEP), F.col(_ID))
    return back.select(
        F.col(_ID).alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce(F.col(_N), F.lit(1)).cast("long").alias("group_size"),
        F.col(_ID).eqNullSafe(keep_id).alias("kept"),
        F.col(_SHA).alias("text_sha256"),
    )


def _unordered(kind: DataType) -> bool:
    """Whether values of the type have no order."""
    if isinstance(kind, ArrayType):
        return _unordered(kind.elementType)
    return isinstance(kind, (MapType, VariantType)) or isinstance(kind, StructType) and any(_unordered(f.dataType) for f in kind)


def keep_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The documents with one whole row a text: that with the smallest or largest id, null ids last.

    Rows that tie on the id are ordered by their other columns (maps and variants by their JSON). Rows whose text cannot
    repeat pass without a shuffle; the rest are aggregated once.
    """
    pick = F.min_by if keep == "smallest" else F.max_by
    _chosen(keep, F.lit(0))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sieve = _sieve(docs.select(F.md5(text).alias(_HASH), _place(text).alias(_AT)))
    names = docs.columns
    flagged = _may_repeat(docs.withColumn(_AT, _place(text)), sieve)
    others = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if _unordered(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema if f.name not in (id_col, text_col)]
    there = F.col(id_col).isNull() if keep == "smallest" else F.col(id_col).isNotNull()
    order = F.struct(*[x.alias(f"c{i}") for i, x in enumerate((there, F.col(id_col), *others, F.col(text_col).isNull()))])
    rest = F.struct(*[F.col(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(docs.schema) if f.name != text_col], F.col(text_col).isNull().alias("was_null"))
    picked = flagged.where(_N).select(F.md5(text).alias(_HASH), text.alias(_TEXT), rest.alias("r"), order.alias("o")).groupBy(_HASH, _TEXT).agg(pick("r", "o").alias("r"))
    kept_text = F.when(~F.col("r.was_null"), F.col(_TEXT)).cast(docs.schema[text_col].dataType)
    some = picked.select(*[(kept_text if c == text_col else F.col(f"r.c{i}")).alias(c) for i, c in enumerate(names)])
    return flagged.where(~F.col(_N)).select(*[F.col(f"`{c}`") for c in names]).unionAll(some)
