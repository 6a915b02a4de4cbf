"""Running aggregates over ordered groups of any size, in one plan.

A window over a key alone puts the whole key into one task. Here a group is cut into sub-blocks that follow from the
data. A row's cell is its key and the order column cut to a coarse unit (the hour of an instant). A cell that holds more
rows than one in SHARE of the table, and more than LEAST, is hot, which one count of cells tells; inside it the unit is
finer (the second). Cells of that unit that are still hot are cut by the order column itself and the ids' cells. So no
block is larger than the limit, unless more than a cell of ids share an instant; a key whose rows all lie in one hour,
at one instant or have no time spreads like any other. Each block runs its own window; the totals of the blocks before it
(one row per key and block) are added to it. Counts are exact, so the cut is the same wherever and whenever it is
computed, and nothing has to be written down or sampled first. At most SHARE cells can be hot: their list is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

BLOCK = "_block"
#: A cell is hot beyond LEAST rows and one in SHARE of all.
LEAST, SHARE = 1 << 16, 10_000


@dataclass(frozen=True)
class OrderedGroups:
    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def group(self) -> tuple[str, ...]:
        return self.keys + (BLOCK,)

    def result(self) -> DataFrame:
        return self.rows.drop(BLOCK)


def cells_of(df: DataFrame, column: str) -> tuple[Column, Column]:
    """The order column cut to a coarse and to a finer unit; both rise with it and are null with it."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", column), F.date_trunc("second", column)
    if isinstance(kind, T.DateType):
        return F.trunc(column, "month"), value
    if isinstance(kind, T.IntegralType):
        return F.shiftright(value.cast("long"), 16), F.shiftright(value.cast("long"), 8)
    raise TypeError(f"{column}: give `block` for an order column of type {kind.simpleString()}")


def _id_cell(df: DataFrame, column: str) -> Column:
    """Runs of ids: 4,096 numbers, or a common beginning."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.substring(column, 1, 4)
    return F.shiftright(F.col(column).cast("long"), 12) if isinstance(df.schema[column].dataType, T.IntegralType) else F.col(column)


def _with_hot(df: DataFrame, cells: DataFrame, keys, cell: Column, flag: str, least: int, total: Column) -> DataFrame:
    """`df` with `flag`: whether the cell of a row holds more rows of `cells` than the limit."""
    most = F.greatest(F.lit(least).cast("double"), total / SHARE)
    hot = cells.groupBy(*(F.col(k).alias("_r_" + k) for k in keys), cell.alias("_r_cell")).agg(F.count("*").alias("_n"))
    hot = hot.filter(F.col("_n") > most).drop("_n").withColumn(flag, F.lit(True))
    same = cell.eqNullSafe(F.col("_r_cell"))
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col("_r_" + key))
    return df.join(F.broadcast(hot), same, "left").drop("_r_cell", *("_r_" + k for k in keys))


def ordered_groups(df: DataFrame, keys, order, block: Column | None = None, least: int = LEAST) -> OrderedGroups:
    """`block`: sub-block of a row, which must rise with the order columns; by default from the counts of cells."""
    keys, order = tuple(keys), tuple(order)
    if block is not None:
        return OrderedGroups(df.withColumn(BLOCK, block), keys, order)
    coarse, mid = cells_of(df, order[0])
    total = df.agg(F.count("*").cast("double")).scalar()
    narrow = df.select(*dict.fromkeys((*keys, order[0])))
    once = _with_hot(df, narrow, keys, coarse, "_hot", least, total)
    inner = _with_hot(narrow, narrow, keys, coarse, "_hot", least, total).filter("_hot")
    twice = _with_hot(once, inner, keys, mid, "_hotter", least, total)
    fine = F.struct(*order[:-1], _id_cell(df, order[-1]).alias("_ids")) if len(order) > 1 else F.struct(*order)
    cut = F.struct(coarse.alias("a"), F.when(F.col("_hot"), mid).alias("b"), F.when(F.col("_hotter"), fine).alias("c"))
    return OrderedGroups(twice.withColumn(BLOCK, cut).drop("_hot", "_hotter"), keys, order)


def _same_group(left: DataFrame, right: DataFrame, keys) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right["_r_" + key])
    return condition


# kind: (aggregate over rows, how a block's value joins what came before it)
_MERGE = {
    "sum": lambda before, own: F.coalesce(before, F.lit(0)) + F.coalesce(own, F.lit(0)),
    "max": lambda before, own: F.greatest(before, own),
    "last": lambda before, own: F.coalesce(own, before),
}


def _over(kind: str, value: Column, window) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True).over(window)
    return {"sum": F.sum, "max": F.max}[kind](value).over(window)


def running(
    groups: OrderedGroups, outs: dict[str, tuple[str, Column]], inclusive: bool = True
) -> OrderedGroups:
    """Adds running aggregates: {name: ("sum" | "max" | "last", value)}.

    "last" skips nulls. With inclusive=False the current row is left out; "sum" is then 0 on the
    first row and the others are null.
    """
    window = Window.partitionBy(*groups.group).orderBy(*groups.order)
    window = window.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = groups.rows.withColumns({n: _over(kind, v, window) for n, (kind, v) in outs.items()})
    position = F.struct(*groups.order)
    totals = {
        n: {
            "sum": F.sum(v),
            "max": F.max(v),
            "last": F.max_by(v, F.when(v.isNotNull(), position)),
        }[kind].alias(n)
        for n, (kind, v) in outs.items()
    }
    earlier = Window.partitionBy(*groups.keys).orderBy(BLOCK)
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    carried = groups.rows.groupBy(*groups.group).agg(*totals.values()).select(
        *(F.col(k).alias("_r_" + k) for k in groups.group),
        *(_over(kind, F.col(n), earlier).alias("_before_" + n) for n, (kind, _) in outs.items()),
    )
    merged = rows.join(carried, _same_group(rows, carried, groups.group), "left").withColumns(
        {n: _MERGE[kind](F.col("_before_" + n), F.col(n)) for n, (kind, _) in outs.items()}
    )
    return replace(groups, rows=merged.select(*rows.columns))


def previous(groups: OrderedGroups, name: str, fields) -> OrderedGroups:
    """Adds the previous row of the group as a struct; null on the first row."""
    return running(groups, {name: ("last", F.struct(*fields))}, inclusive=False)


def since_reset(groups: OrderedGroups, name: str, value: Column, reset: Column) -> OrderedGroups:
    """Adds the running sum of `value` since the last row where `reset` holds; that row starts anew with its own value.

    In one pass: a block's rows know their sum since the last reset of the block. A block hands on whether it has a
    reset and the sum at its end; rows before its first reset add what the blocks before it hand on.
    """
    window = Window.partitionBy(*groups.group).orderBy(*groups.order).rowsBetween(Window.unboundedPreceding, 0)
    rows = groups.rows.withColumn("_resets", F.sum(F.when(reset, 1).otherwise(0)).over(window))
    island = Window.partitionBy(*groups.group, "_resets").orderBy(*groups.order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum(value).over(island))
    last = F.max_by(F.struct(F.col("_resets").alias("resets"), F.col(name).alias("open")), F.struct(*groups.order))
    ends = rows.groupBy(*groups.group).agg(last.alias("_last")).select(*groups.group, "_last.*")
    blocks = Window.partitionBy(*groups.keys).orderBy(BLOCK)
    ends = ends.withColumn("_span", F.sum(F.when(F.col("resets") > 0, 1).otherwise(0)).over(blocks.rowsBetween(Window.unboundedPreceding, 0)))
    span = Window.partitionBy(*groups.keys, "_span").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_open", F.sum("open").over(span)).withColumn("_before", F.lag("_open").over(blocks))
    carried = ends.select(*(F.col(k).alias("_r_" + k) for k in groups.group), "_before")
    joined = rows.join(carried, _same_group(rows, carried, groups.group), "left")
    whole = F.col(name) + F.when(F.col("_resets") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    return replace(groups, rows=joined.withColumn(name, whole).select(*groups.rows.columns, name))
