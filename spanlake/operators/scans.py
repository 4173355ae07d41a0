"""Scans over the rows of a recording in their order, cut into pieces.

A window keyed by the recording alone puts a long one into one task. Here each
piece (a span of time, or of numbers) is a group of its own; what a piece hands
on to those after it is one small row, and only these rows meet in a window per
recording. Results don't depend on where the cuts are, as long as `order` tells
rows apart and a cut never parts rows that are equal in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a piece, and rows of one that is counted by index.
SECONDS, ROWS = 3600.0, 8192

_PIECE, _CARRY, _INNER, _NEW, _BEFORE = "_piece", "_carry", "_inner", "_new", "_before"


def cut(at: Column, width: float) -> Column:
    """The number of the piece of `width` that a time or index falls into."""
    return F.floor(at / width).cast("long")


def running(rows: DataFrame, name: str, amount: Column, order: list[str], piece: Column, keys: list[str]) -> DataFrame:
    """rows with `name`: the sum of amount over the rows up to each one, itself included."""
    inner = rows.withColumn(_PIECE, piece).withColumn(_NEW, amount)
    sums = inner.groupBy(*keys, _PIECE).agg(F.sum(_NEW).alias(_CARRY))
    before = F.sum(_CARRY).over(Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum(_NEW).over(Window.partitionBy(*keys, _PIECE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = inner.withColumn(_INNER, own).join(sums.withColumn(_CARRY, F.coalesce(before, F.lit(0))), [*keys, _PIECE])
    return both.withColumn(name, F.col(_INNER) + F.col(_CARRY)).drop(_PIECE, _NEW, _INNER, _CARRY)


def filled(rows: DataFrame, last: dict[str, Column], first: dict[str, Column], order: list[str], piece: Column, keys: list[str]) -> DataFrame:
    """rows with a column for each name of `last`: the last value that is not null up to each row, itself included; and of `first`: the first from it on."""
    values = {**last, **first}
    inner = rows.withColumn(_PIECE, piece).withColumns({f"{_NEW}_{c}": x for c, x in values.items()})
    new = lambda c: F.col(f"{_NEW}_{c}")
    at = lambda c: F.when(new(c).isNotNull(), F.struct(*order))
    ends = inner.groupBy(*keys, _PIECE).agg(*[(F.max_by if c in last else F.min_by)(new(c), at(c)).alias(f"{_CARRY}_{c}") for c in values])
    by_key, own = Window.partitionBy(*keys).orderBy(_PIECE), Window.partitionBy(*keys, _PIECE).orderBy(*order)

    def near(c: str, x: Column, w: Window, inside: bool) -> Column:
        if c in last:
            return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0 if inside else -1))
        return F.first(x, ignorenulls=True).over(w.rowsBetween(0 if inside else 1, Window.unboundedFollowing))

    carried = ends.select(*keys, _PIECE, *[near(c, F.col(f"{_CARRY}_{c}"), by_key, False).alias(f"{_CARRY}_{c}") for c in values])
    both = inner.withColumns({f"{_NEW}_{c}": near(c, new(c), own, True) for c in values}).join(carried, [*keys, _PIECE])
    return both.withColumns({c: F.coalesce(new(c), F.col(f"{_CARRY}_{c}")) for c in values}).drop(_PIECE, *[f"{x}_{c}" for c in values for x in (_NEW, _CARRY)])


def before(rows: DataFrame, name: str, value: Column, order: list[str], piece: Column, keys: list[str]) -> DataFrame:
    """rows with `name`: the value of the row before, null for the first."""
    inner = rows.withColumn(_PIECE, piece).withColumn(_NEW, F.struct(value.alias("v")))
    ends = inner.groupBy(*keys, _PIECE).agg(F.max_by(_NEW, F.struct(*order)).alias(_CARRY))
    carried = F.lag(_CARRY).over(Window.partitionBy(*keys).orderBy(_PIECE))
    inside = F.lag(_NEW).over(Window.partitionBy(*keys, _PIECE).orderBy(*order))
    both = inner.withColumn(_INNER, inside).join(ends.withColumn(_CARRY, carried), [*keys, _PIECE])
    return both.withColumn(name, F.coalesce(_INNER, _CARRY)["v"]).drop(_PIECE, _NEW, _INNER, _CARRY)


def runs(rows: DataFrame, values: list[str], changed: Callable[[Column, Column], Column], order: list[str], piece: Column, keys: list[str]) -> DataFrame:
    """rows with `run`, from 1: changed(before, now), on structs of `values`, tells whether a row begins a new one."""
    new = lambda a, b: F.coalesce(changed(a, b), F.lit(True)).cast("int")
    now, own = F.struct(*values), Window.partitionBy(*keys, _PIECE).orderBy(*order)
    inner = rows.withColumn(_PIECE, piece).withColumn(_BEFORE, F.lag(now).over(own))
    inner = inner.withColumn(_NEW, F.when(F.col(_BEFORE).isNull(), 0).otherwise(new(F.col(_BEFORE), now)))
    inner = inner.withColumn(_INNER, F.sum(_NEW).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inner.groupBy(*keys, _PIECE).agg(F.sum(_NEW).alias("n"), F.min_by(now, F.struct(*order)).alias("first"), F.max_by(now, F.struct(*order)).alias("last"))
    by_key = Window.partitionBy(*keys).orderBy(_PIECE)
    opened = ends.withColumn("held", F.lag("last").over(by_key)).withColumn("opens", F.when(F.col("held").isNull(), 1).otherwise(new(F.col("held"), F.col("first"))))
    start = F.coalesce(F.sum(F.col("n") + F.col("opens")).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("opens")
    both = inner.join(opened.select(*keys, _PIECE, start.alias(_CARRY)), [*keys, _PIECE])
    return both.withColumn("run", F.col(_INNER) + F.col(_CARRY)).drop(_PIECE, _BEFORE, _NEW, _INNER, _CARRY)
