"""Exact distinct counts that merge.

A dictionary gives every value of a group a number from 1 without gaps; the values seen
in a part of the data are then a few bitmaps per group, and parts merge by a bitwise or. So a day's
commits are counted once and added to the totals without reading the older ones again. A bitmap holds
its words of 64 numbers that aren't zero, so groups of a few values stay small in memory too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 4096        # slices of a group's values that are numbered apart


def _same(left: str, right: str, cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])


def distinct_values(df: DataFrame, key: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """``(*key, kind, value)`` once each: ``columns`` names the kinds and their columns.

    All kinds share one scan and one shuffle, equal values meet before it. Nulls are no value;
    values are compared as text."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
                      for k, c in columns.items()])
    return (df.select(*key, F.explode(pairs).alias("__p")).select(*key, "__p.kind", "__p.value")
            .where("value is not null").distinct())


def distinct_counts(df: DataFrame, key: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Exact number of distinct values per group, one column per kind: two hash aggregations, no ``Expand``.

    A group without any value has no row."""
    return distinct_values(df, key, columns).groupBy(*key).agg(
        *[F.count_if(F.col("kind") == k).cast("bigint").alias(k) for k in columns])


def dictionary(values: DataFrame, key: Sequence[str], known: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """Numbers for the values that ``known`` doesn't hold: ``(*key, kind, value, id)``.

    ``values``: rows of ``distinct_values``. Numbers follow the greatest known one without gaps and depend on
    the values alone, not on files or partitions. They are dealt inside slices of a group (by hash), and the
    slices' sizes are summed up: no task holds a whole group. Store the result next to ``known``."""
    group = [*key, "kind"]
    new = values
    if known is not None:
        new = values.alias("a").join(known.alias("b"), _same("a", "b", [*group, "value"]), "left_anti")
    new = new.withColumn("__part", F.pmod(F.xxhash64("value"), F.lit(parts)))
    ranked = new.withColumn("__rank", F.row_number().over(Window.partitionBy(*group, "__part").orderBy("value")))
    sizes = new.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if known is not None:
        last = known.groupBy(*group).agg(F.max("id").alias("__last"))
        sizes = (sizes.alias("a").join(last.alias("b"), _same("a", "b", group), "left")
                 .select("a.*", F.coalesce("b.__last", F.lit(0)).alias("__last"))
                 .withColumn("__before", F.col("__before") + F.col("__last")))
    return (ranked.alias("a").join(sizes.alias("b"), _same("a", "b", [*group, "__part"]))
            .select(*[F.col(f"a.{c}").alias(c) for c in [*group, "value"]],
                    (F.col("a.__rank") + F.col("b.__before")).cast("bigint").alias("id")))


def _bitmaps(words: DataFrame, key: Sequence[str]) -> DataFrame:
    """``(*key, kind, bucket, no, word)`` -> a row per bucket, the words with equal ``no`` put together."""
    group = [*key, "kind", "bucket"]
    return (words.repartition(*group).groupBy(*group, "no").agg(F.bit_or("word").alias("word"))
            .groupBy(*group).agg(F.sort_array(F.collect_list(F.struct("no", "word"))).alias("bits")))


def distinct_state(values: DataFrame, numbers: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bitmaps of the values seen: ``(*key, kind, bucket, bits)``, 32,768 numbers a bucket, ``bits`` its words
    of 64 numbers (``no``, ``word``) that hold any, 512 at most.

    Every value must stand in the dictionary ``numbers`` (``dictionary`` of all parts so far)."""
    group = [*key, "kind"]
    at = F.bitmap_bit_position("id").alias("at")
    ids = (values.alias("a").join(numbers.alias("b"), _same("a", "b", [*group, "value"]))
           .select(*[F.col(f"a.{c}").alias(c) for c in group], F.bitmap_bucket_number("id").alias("bucket"), at))
    return _bitmaps(ids.select(*group, "bucket", F.shiftright("at", 6).cast("int").alias("no"),
                               F.expr("shiftleft(1L, cast(at % 64 as int))").alias("word")), key)


def merge_states(first: DataFrame, *others: DataFrame, key: Sequence[str]) -> DataFrame:
    """One state that has seen what any of the given states has; all must use one dictionary."""
    union = reduce(DataFrame.unionByName, others, first)
    return _bitmaps(union.select(*key, "kind", "bucket", F.inline("bits")), key)


def state_counts(state: DataFrame, key: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Exact distinct counts of a (merged) state, one column per kind, 0 where a group has none of it.

    States that were not merged yet may repeat a bucket; merge them first."""
    bits = F.aggregate("bits", F.lit(0), lambda n, w: n + F.bit_count(w["word"]))
    return state.groupBy(*key).agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == k, bits)), F.lit(0)).cast("bigint").alias(k) for k in kinds])
