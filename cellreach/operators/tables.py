"""Relational helpers: conforming schemas, first and last of duplicates, unions by preference, ids, pivots, grouping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conform(df: DataFrame, schema: T.StructType, renamed: dict[str, str] | None = None) -> DataFrame:
    """df with exactly the columns of schema: old names renamed, missing ones null, types cast, others dropped."""
    for old, new in (renamed or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    )


_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
_REAL = [T.FloatType(), T.DoubleType()]


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrower of the types that hold the values of both: whole numbers, reals (double beside long or int), timestamps over dates, text over all plain ones."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _WHOLE and b in _WHOLE:
        return max(a, b, key=_WHOLE.index)
    if a in _REAL + _WHOLE and b in _REAL + _WHOLE:
        small = [T.FloatType(), T.ByteType(), T.ShortType()]
        return T.FloatType() if a in small and b in small else T.DoubleType()
    if {type(a), type(b)} == {T.DateType, T.TimestampType}:
        return T.TimestampType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(wider(a.elementType, b.elementType))
    if any(isinstance(t, T.ArrayType | T.MapType | T.StructType | T.BinaryType) for t in (a, b)):
        raise TypeError(f"no type holds {a.simpleString()} and {b.simpleString()}")
    return T.StringType()


def union_widened(*tables: DataFrame) -> DataFrame:
    """All rows by column names, each column in the widest type that any table gives it; columns that a table lacks are null."""
    kinds: dict[str, T.DataType] = {}
    for df in tables:
        for f in df.schema:
            kinds[f.name] = wider(kinds[f.name], f.dataType) if f.name in kinds else f.dataType
    schema = T.StructType([T.StructField(n, k) for n, k in kinds.items()])
    return reduce(DataFrame.unionByName, [conform(df, schema) for df in tables])


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def page(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first `limit` rows in an order, with has_more: whether there are others."""
    top = df.orderBy(*order).limit(limit + 1)  # so few rows go to one task
    every = Window.partitionBy()
    ranked = top.withColumns({"_rank": F.row_number().over(every.orderBy(*order)), "has_more": F.count(F.lit(1)).over(every) > limit})
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def prefer(*tables: DataFrame) -> DataFrame:
    """The first of the tables that has rows; the last one if none has."""
    for df in tables[:-1]:
        if df.head(1):
            return df
    return tables[-1]


def prefer_by_key(keys: list[str], *tables: DataFrame) -> DataFrame:
    """The rows of all tables, those of a key (null counts as one) from the first table that has it alone."""
    marked = [df.withColumn("_from", F.lit(k)) for k, df in enumerate(tables)]
    every = marked[0]
    for df in marked[1:]:
        every = every.unionByName(df)
    first = F.min("_from").over(Window.partitionBy(*keys))
    return every.withColumn("_first", first).where("_from = _first").drop("_from", "_first")


def join_on_shared(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("cell", "res")) -> DataFrame:
    """Left join on those keys that both have; other columns of right that left has already are left out."""
    on = [k for k in keys if k in left.columns and k in right.columns]
    return left.join(right.select(*on, *[c for c in right.columns if c not in left.columns]), on, "left")


def overlay(base: DataFrame, *overlays: DataFrame) -> DataFrame:
    for other in overlays:
        base = join_on_shared(base, other)
    return base


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the 0-based rank of each distinct key.

    Keys are range-partitioned and sorted; each partition's start comes from the partitions' counts, so no task sees all keys.
    """
    from cellreach.plans.cuts import cut

    keys = df.select(key).distinct()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(keys.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("_at", F.monotonically_increasing_id()))
    ordered = ordered.select(key, F.shiftright("_at", 33).alias("_p"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at"))
    counts = ordered.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.withColumn("_from", F.sum("c").over(Window.orderBy("_p")) - F.col("c")).drop("c")  # a row a partition
    return ordered.join(F.broadcast(starts), "_p").select(key, (F.col("_from") + F.col("_at")).alias(name))


def share_pivot(votes: DataFrame, key: str, parties: dict[str, str], total: str = "total") -> DataFrame:
    """A row per key: summed votes of each party (party -> column name), their total, zero where absent."""
    pivoted = votes.groupBy(key).pivot("party", list(parties)).agg(F.sum("votes"))
    filled = pivoted.select(key, *[F.coalesce(F.col(f"`{p}`"), F.lit(0)).cast("long").alias(n) for p, n in parties.items()])
    return filled.withColumn(total, sum((F.col(n) for n in parties.values()), F.lit(0).cast("long")))


def mode_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, n): the most frequent label of each key, ties to the least."""
    counts = df.where(F.col(label).isNotNull()).groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(label).alias("x"), F.col("n").alias("n"))).alias("m")).select(
        key, F.col("m.x").alias(label), F.col("m.n").alias("n")
    )


def numbered(df: DataFrame, order: list[str], name: str = "_n") -> DataFrame:
    """df with the 0-based place of each row in an order, without a task that sees all rows: as in dense_ids."""
    from cellreach.plans.cuts import cut

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    split = placed.withColumns({"_p": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = split.groupBy("_p").agg(F.count(F.lit(1)).alias("c"))
    starts = counts.withColumn("_from", F.sum("c").over(Window.orderBy("_p")) - F.col("c")).drop("c")  # a row a partition
    return split.join(F.broadcast(starts), "_p").withColumn(name, F.col("_from") + F.col("_at")).drop("_p", "_from", "_at")


def ordered_fingerprint(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """(n, digest) of a table's columns in the order of its rows by `order`, which should be unique: other orders have other digests."""
    return fingerprint(numbered(df, order), ["_n", *columns])


def fingerprint(df: DataFrame, order: list[str]) -> DataFrame:
    """(n, digest) of a table whatever its row order: row digests summed as two 64-bit numbers, then hashed.

    A sum needs no global sort and no task that sees all rows.
    """
    from cellreach.functions.ids import row_digest

    row = row_digest(*[F.col(c) for c in order])
    part = lambda at: F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")
    sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(part(at)).alias(f"s{at}") for at in (1, 9, 17, 25)])
    return sums.select("n", F.sha2(F.concat_ws("|", "n", "s1", "s9", "s17", "s25"), 256).alias("digest"))
