"""Operators over ordered rows of a key: ordinals, stop at the first failure, carry forward, prefixes, ordered collections.

Order columns have to be given in full where they are not unique; what has the same order is in no defined order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

Names = Sequence[str]


def ordered(keys: Names, order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


#: About so many rows of a key's order a task sorts.
ROWS_OF_A_TASK = 500_000


def parts_for(spark: SparkSession, rows: int, most: int | None = None) -> int:
    """Into how many partitions so many rows are dealt: the session's number, more where that would give a task over ``most`` (ROWS_OF_A_TASK) rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (most or ROWS_OF_A_TASK)))


def dealt(df: DataFrame, keys: Names, rows: int, most: int | None = None) -> DataFrame:
    """df, which has so many rows, dealt by its keys over parts_for() them: what a task then sorts does not grow with the input. A
    frame for which the session's number is enough is left to the shuffle of the window or join that follows."""
    spark = df.sparkSession
    parts = parts_for(spark, rows, most)
    return df.repartition(parts, *keys) if parts > parts_for(spark, 0) else df


def with_ordinal(df: DataFrame, keys: Names, order: Sequence[str | Column], name: str = "ord", start: int = 1) -> DataFrame:
    """Number the rows of each key, from ``start``."""
    return df.withColumn(name, F.row_number().over(ordered(keys, order)).cast("long") + (start - 1))


def with_rank(df: DataFrame, order: Sequence[str | Column], name: str = "rank") -> DataFrame:
    """Number all rows in one order, from 1, without one task for all: ranges of the order are numbered apart and moved on by the
    sizes of those before. Only one row for each range meets in a task."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that adaptive execution leaves the ranges as they are
    ranged = df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_range", before.alias("_before"))
    placed = with_ordinal(ranged, ["_range"], order, "_place").join(F.broadcast(starts), "_range")
    return placed.withColumn(name, F.col("_before") + F.col("_place")).drop("_range", "_before", "_place")


def until_first_failure(df: DataFrame, keys: Names, order: Sequence[str | Column], success: Column) -> DataFrame:
    """The rows of each key up to and with the first one that fails; a null success is a failure."""
    before = ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    failed = F.sum(F.when(F.coalesce(success, F.lit(False)), 0).otherwise(1)).over(before)
    return df.withColumn("_failed_before", F.coalesce(failed, F.lit(0))).filter("_failed_before = 0").drop("_failed_before")


def carry_forward(value: Column, keys: Names, order: Sequence[str | Column]) -> Column:
    """The last value that is not null, up to this row."""
    return F.last(value, ignorenulls=True).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0))


def previous(value: Column, keys: Names, order: Sequence[str | Column], seed: Column) -> Column:
    """The value of the row before; the seed for a key's first row."""
    w = ordered(keys, order)
    return F.when(F.row_number().over(w) == 1, seed).otherwise(F.lag(value).over(w))


def first_rows(df: DataFrame, keys: Names, order: Sequence[str | Column], k: int) -> DataFrame:
    """At most k rows of each key. Spark cuts to k rows before the shuffle already (window group limit)."""
    return df.withColumn("_rank", F.row_number().over(ordered(keys, order))).filter(F.col("_rank") <= k).drop("_rank")


def is_first(keys: Names, order: Sequence[str | Column]) -> Column:
    return F.row_number().over(ordered(keys, order)) == 1


def last_value_by(value: str, order: str) -> Column:
    """Aggregate: the value of the greatest order, null values passed over; null for no rows."""
    return F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order)))


def collect_in_order(order: str | Column, *values: str) -> Column:
    """Aggregate: array of structs (order, values...) in order. A key's rows meet in one row of the result."""
    first = (F.col(order) if isinstance(order, str) else order).alias("ord")
    return F.sort_array(F.collect_list(F.struct(first, *[F.col(v) for v in values])))


def joined_in_order(order: str | Column, value: str, separator: str) -> Column:
    return F.array_join(F.transform(collect_in_order(order, value), lambda s: s[value]), separator)


def distinct_first_seen(df: DataFrame, keys: Names, value: str, order: Column, name: str) -> DataFrame:
    """For each key its distinct values in the order of their first rows, as an array; combined before the shuffle."""
    seen = df.groupBy(*keys, value).agg(F.min(order).alias("_first"))
    return seen.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_first", value))), lambda s: s[value]).alias(name))


def insert_if_absent(df: DataFrame, keys: Names, order: str) -> DataFrame:
    """Of rows with equal keys the one of least order: a group's later inserts find the first one there."""
    others = [c for c in df.columns if c not in keys]
    kept = df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_row"))
    return kept.select(*keys, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """A keyed map built by appending: the last row of a key gives its values, the first its place (``order``)."""
    others = [c for c in df.columns if c not in (key, order)]
    kept = df.groupBy(key).agg(F.min(order).alias(order), F.max_by(F.struct(*others), order).alias("_row"))
    return kept.select(key, order, "_row.*").select(*df.columns)


def elapsed_seconds(at: str) -> Column:
    """Aggregate: seconds from the first to the last timestamp, as double."""
    micros = (F.unix_micros(F.max(F.col(at).cast("timestamp"))) - F.unix_micros(F.min(F.col(at).cast("timestamp")))).cast("double")
    return micros / 1e6


def all_true(flag: str) -> Column:
    """Aggregate: true for no rows."""
    return F.coalesce(F.every(flag), F.lit(True))


def tally(flag: str) -> tuple[Column, Column]:
    """Aggregates: (passed, total)."""
    return F.count_if(flag), F.count(F.lit(1))


def head_and_more(df: DataFrame, order: Sequence[str], k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(the first k rows, one row with the number of the others)."""
    return df.orderBy(*order).limit(k), df.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("more"))


def clear(df: DataFrame, gone: DataFrame, keys: Names) -> DataFrame:
    """Delete the rows of the given keys."""
    return df.join(gone, list(keys), "left_anti")


def heartbeats(df: DataFrame, keys: Names, at: str, tie: str, every: int = 30) -> DataFrame:
    """df with ``beats``: how many idle signals fall between a row and the next of its key, one for each ``every`` seconds."""
    nxt = F.lead(F.unix_micros(F.col(at).cast("timestamp"))).over(ordered(keys, [at, tie]))
    gap = nxt - F.unix_micros(F.col(at).cast("timestamp"))
    return df.withColumn("beats", F.coalesce(F.floor(gap / (every * 1_000_000)).cast("long"), F.lit(0).cast("long")))
