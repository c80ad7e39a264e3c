"""Ranks and order statistics over a whole table, without a task that holds all of its rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stationlens.session import written


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its place, from 1, in a total order.

    The rows are dealt by ranges of the order, sorted there and written once; a row's place is its turn in its range after
    the rows of the ranges before, of which there is one count a range.
    """
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    own = F.shiftright("_place", 33)
    sizes = placed.groupBy(own.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    turn = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_range", own).join(F.broadcast(before), "_range").withColumn(name, turn).select(*df.columns, name)


def quantiles(df: DataFrame, column: str, shares: dict[str, float], digits: int = 3) -> DataFrame:
    """One row: exact quantiles, interpolated between neighbours, by name; nulls don't count."""
    values = ranked(df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), [F.col("v")])
    n = values.count()
    places = {name: share * (n - 1) for name, share in shares.items()}
    wanted = sorted({f(p) + 1 for p in places.values() for f in (math.floor, math.ceil)}) if n else []
    few = values.filter(F.col("rank").isin(wanted)) if wanted else values.limit(0)
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("v")))
    between = {name: at(math.floor(p) + 1) + (at(math.ceil(p) + 1) - at(math.floor(p) + 1)) * (p - math.floor(p)) for name, p in places.items()}
    return few.agg(*(F.round(c, digits).alias(name) for name, c in between.items()))
