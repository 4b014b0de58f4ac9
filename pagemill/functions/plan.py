"""Control over what the optimizer copies."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import ParamSpec, TypeVar

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = ParamSpec("P")
T = TypeVar("T")


def kept(build: Callable[P, T]) -> Callable[P, T]:
    """Keep what ``build`` makes for its arguments, which must be plain values.

    An expression over columns by name holds for every table, and each of its nodes is a call into the JVM: a page's
    structure takes ten thousand of them, more time than Spark needs to plan a query of it.  Kept per
    context; callers must not change what they get.
    """
    made: dict = {}

    @wraps(build)
    def cached(*args: P.args, **kwargs: P.kwargs) -> T:
        key = (SparkContext._active_spark_context, args, tuple(sorted(kwargs.items())))
        if key not in made:
            made[key] = build(*args, **kwargs)
        return made[key]

    return cached


def pinned(c: Column) -> Column:
    """``c``, computed once where it is defined.

    A filter or a join key on a computed column is pushed below the projection by copying the whole
    expression, and inferred null checks copy it again; for long expressions over a page that
    costs more than it saves.  A condition the optimizer cannot decide keeps the column where it is.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def with_settled(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keep`` and ``columns``, the latter computed once where they are defined.

    Unlike :func:`pinned`, filters on the kept columns go through to the scan: a generator of one row holds the
    computed columns, and conditions on what it doesn't make pass below it.
    """
    row = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_settled")
    return df.select(*keep, row).select(*keep, *[F.col(f"_settled.{n}").alias(n) for n in columns])
