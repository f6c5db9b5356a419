"""Exact running sums over ordered groups of any size.

One task sorts at most ``cell_rows`` rows. A tree says where larger groups are cut: its root is
the whole table, below it are the groups, then the values of the order's first and second
column, then prefixes of the row key, each one character or more beyond what the keys of its
node share. A node with more than ``cell_rows`` rows is refined, whatever its rows look
like, so an outlier or an uneven key only makes the tree deeper. Its leaves are the *parts*.
Which part a row belongs to is a function of the row, looked up in the list of refined nodes; these are
at most ``MOST_NODES``, as each holds more than its share of the rows, so they can be broadcast.

A row's running sum is the sum of the parts before its own and of the rows before it in its
part. What comes before a part travels as one row more, which stands first in it. So rows are
shuffled once, to their part, and nothing is joined there. A tree without refined nodes needs no
such rows: each group is one part.

Sums are of integers, so the result does not depend on the parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveplan.session import cleaned, materialize

#: Rows that one task sorts without being cut further.
CELL_ROWS = 1_000_000
#: Refined nodes of a tree at most; ``cell_rows`` grows with the table beyond that.
MOST_NODES = 100_000
#: Parts from which on rows are counted by all values of the order at once.
MANY_PARTS = 10_000

#: What tells the parts of a group apart: the values and the prefix of the key, where refined.
PLACE = ["_cell", "_within", "_prefix"]
#: What comes before a part, and up to its end.
BEFORE, UPTO = "_before", "_upto"
#: Set in the row that brings what comes before its part.
CARRY = "_carry"


@dataclass(frozen=True)
class Order:
    """The order inside a group: ``cell``, then ``within``, then ``key``, then ``ties``.

    ``cell`` and ``within`` are columns that are told apart by value; ``key`` is a string
    column, which with ``ties`` makes the order total.
    """

    cell: str | None
    within: str | None
    key: str
    ties: tuple[str, ...] = ()
    descending: tuple[str, ...] = ()
    nulls_first: tuple[str, ...] = ()

    def by(self, name: str) -> Column:
        column = F.col(name)
        if name in self.descending:
            return column.desc_nulls_last()
        return column.asc_nulls_first() if name in self.nulls_first else column.asc_nulls_last()

    @property
    def values(self) -> list[str]:
        return [n for n in (self.cell, self.within) if n]

    def columns(self) -> list[Column]:
        return [self.by(n) for n in [*self.values, self.key, *self.ties]]


def same_join(rows: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets itself; the keys come from ``rows``."""
    renamed = other.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return rows.join(renamed, same, how).drop(*[f"_same_{k}" for k in keys])


def shared_length(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1)))
    return F.size(F.filter(places, lambda n: (F.left(a, n) == F.left(b, n)) & (n <= F.length(a)) & (n <= F.length(b))))


@dataclass
class Parts:
    """The refined nodes of a tree, level by level; see the module.

    The first level names nodes by the keys, the others by their parent's ``_id`` and the ``_value`` below it.
    From the level of the key on, ``_length`` is how many characters tell the children apart.
    """

    keys: list[str]
    order: Order
    levels: list[DataFrame] = field(default_factory=list)

    @property
    def place(self) -> list[str]:
        """The columns that name a part inside its group."""
        depth, values = len(self.levels), self.order.values
        return [*PLACE[: min(depth, len(values))], *([PLACE[2]] if depth > len(values) else [])]

    def label(self, rows: DataFrame, inside: bool = False) -> DataFrame:
        """``rows`` with the columns of ``place``; ``inside`` keeps those of the last level's nodes only, with its ``_node``."""
        out, values = rows, self.order.values
        for depth, nodes in enumerate(self.levels):
            last = inside and depth == len(self.levels) - 1
            how = "inner" if last else "left"
            if depth == 0:
                # at most MOST_NODES, here and below
                out = same_join(out, F.broadcast(nodes), self.keys, how)
            else:
                above = F.col(values[depth - 1]) if depth <= len(values) else F.col(PLACE[2])
                meet = (F.col("_node") == F.col("_parent")) & above.eqNullSafe(F.col("_value"))
                out = out.join(F.broadcast(nodes), meet, how).drop("_parent", "_value", "_node")
            out = out.withColumnRenamed("_id", "_node")
            refined = F.col("_node").isNotNull()
            if depth < len(values):
                out = out.withColumn(PLACE[depth], F.when(refined, F.col(values[depth])))
            else:
                same = F.col(PLACE[2]) if depth > len(values) else F.lit(None)
                out = out.withColumn(PLACE[2], F.when(refined, F.left(F.col(self.order.key), F.col("_length"))).otherwise(same))
            out = out.drop("_length")
        return out if inside else out.drop("_node")

    def deal(self, rows: DataFrame) -> DataFrame:
        """``rows`` moved to their part, before they are multiplied: ``running_sum`` then moves them no more."""
        return self.label(rows).repartition(*self.keys, *self.place)


def split(
    rows: DataFrame, keys: list[str], order: Order, cell_rows: int = CELL_ROWS, paths: list[str] | None = None, total: int | None = None
) -> Parts:
    """The tree of ``rows``; ``total`` is their number or more, counted if not given.

    A root small enough ends it. Else one pass counts the rows by group and values, and a job per level
    finds the nodes to refine in these counts; only cells that are still too large are read again, by key.
    If parts are large, that pass counts by the first value only, and rows of nodes refined beyond it are read again.
    """
    parts, values, key = Parts(keys, order), order.values, F.col(order.key)
    narrow = rows.select(*keys, *values, order.key)
    if total is None:
        with cleaned(rows.sparkSession):
            total = narrow.count()
    most = total
    limit = max(cell_rows, most // MOST_NODES)
    if most <= limit:
        return parts

    def refine(nodes: DataFrame) -> bool:
        written = materialize(nodes.withColumn("_id", F.monotonically_increasing_id()), "nodes", paths)
        if written.isEmpty():
            return False
        parts.levels.append(written)
        return True

    def ends(inside: DataFrame, *by: Column) -> DataFrame:
        """Nodes by ``by`` that are too large and hold more than one key, which they can be cut by."""
        counted = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.min(key).alias("_low"), F.max(key).alias("_high"))
        digits = F.greatest(F.ceil(F.log10(F.col("_rows") / limit)), F.lit(1)).cast("int")
        length = (shared_length(F.col("_low"), F.col("_high")) + digits).alias("_length")
        return counted.filter((F.col("_rows") > limit) & (F.col("_low") != F.col("_high"))).select(*counted.columns[: len(by)], length)

    told = values[: 1 if most // limit < MANY_PARTS else None]
    cells = materialize(narrow.groupBy(*keys, *told).agg(F.count(F.lit(1)).alias("_rows")), "cells", paths)
    for depth in range(len(values) + 1):
        names = [F.col("_node").alias("_parent"), F.col(values[depth - 1]).alias("_value")] if depth else keys
        held = cells if depth <= len(told) else narrow.withColumn("_rows", F.lit(1).cast("bigint"))
        counted = parts.label(held, inside=True).groupBy(*names).agg(F.sum("_rows").alias("_rows"))
        if not refine(counted.filter(F.col("_rows") > limit).drop("_rows")):
            return parts
    # these have their ids already; what is missing is how to cut them
    found = parts.levels[-1]
    parts.levels[-1] = found.withColumn("_length", F.lit(0))
    cut = ends(parts.label(narrow, inside=True), F.col("_node").alias("_id"))
    parts.levels[-1] = materialize(found.join(F.broadcast(cut), "_id"), "nodes", paths)
    while refine(ends(parts.label(narrow, inside=True), F.col("_node").alias("_parent"), F.col(PLACE[2]).alias("_value"))):
        pass
    return parts


def running_sum(
    rows: DataFrame,
    keys: list[str],
    order: Order,
    value: str | list[str],
    into: str | list[str],
    cell_rows: int = CELL_ROWS,
    total: str | dict[str, str] | None = None,
    paths: list[str] | None = None,
    parts: Parts | None = None,
    before: tuple[str, ...] = (),
    bounds: bool = False,
    dealt: bool = False,
) -> DataFrame:
    """``rows`` with the running sum of each ``value``.

    ``total`` names the group's sum: of ``value``, or of any column as a dict. ``parts`` is a tree of rows that
    include these, for keys that are among these; without it, one is built. ``before``: columns whose value in the
    row before is added as ``_last_<column>`` (null in the first row of a part). ``bounds`` adds, where groups are
    cut, the part's place (``parts.place``) and for each value its sum before the part and up to its end (``BEFORE`` and ``UPTO`` + value).
    ``dealt``: the rows come from ``parts.deal``.
    """
    values, names = ([value], [into]) if isinstance(value, str) else (value, into)
    totals = {values[0]: total} if isinstance(total, str) else total or {}
    parts = split(rows, keys, order, cell_rows, paths) if parts is None else parts
    cut = bool(parts.levels)
    columns = [c for c in rows.columns if not (dealt and c in parts.place)]
    if cut:
        rows = (rows if dealt else parts.label(rows)).withColumn(CARRY, F.lit(0))
        carried = _carried(rows, keys, order, parts.place, values, totals)
        # both are dealt by part, and the union keeps that
        by = [*(parts.keys if dealt else keys), *parts.place]
        rows, carried = rows if dealt else rows.repartition(*by), carried.repartition(*by)
        rows = rows.unionByName(carried, allowMissingColumns=True)
    group = Window.partitionBy(*keys, *(parts.place if cut else []))
    own = group.orderBy(*([F.col(CARRY).desc()] if cut else []), *order.columns())
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the row that comes first in a part brings the sum of what is before it
    new = {name: F.coalesce(F.sum(v).over(upto), F.lit(0)) for v, name in zip(values, names)}
    new |= {f"_last_{c}": F.lag(c).over(own) for c in before}
    if not cut:
        new |= {name: F.sum(v).over(group) for v, name in totals.items()}
        return rows.withColumns(new)
    brought = [*totals.values(), *([side + v for v in values for side in (BEFORE, UPTO)] if bounds else [])]
    new |= {name: F.first(name).over(upto) for name in brought}
    out = rows.withColumns(new).filter(F.col(CARRY) == 0)
    return out.select(*columns, *[n for n in new if n not in columns], *(parts.place if bounds else []))


def _carried(
    rows: DataFrame, keys: list[str], order: Order, place: list[str], values: list[str], totals: dict[str, str]
) -> DataFrame:
    """A row for each part: as each value the sum of what comes before it, its bounds, and the totals of its group."""
    sums = list(dict.fromkeys([*values, *totals]))
    held = rows.groupBy(*keys, *place).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_sum_{v}") for v in sums])
    # where two parts differ first, both have a value or a prefix, and no prefix continues another
    named = dict(zip([order.cell, order.within, order.key], PLACE)) if order.within else {order.cell: PLACE[0], order.key: PLACE[2]}
    here = [
        Order(None, None, c, descending=(c,) if n in order.descending else (), nulls_first=(c,) if n in order.nulls_first else ()).by(c)
        for n, c in named.items()
        if c in place
    ]
    group = Window.partitionBy(*keys)
    upto = group.orderBy(*here).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = {v: F.sum(f"_sum_{v}").over(upto) for v in values}
    return held.select(
        *keys,
        *place,
        F.lit(1).alias(CARRY),
        *[(end[v] - F.col(f"_sum_{v}")).alias(name + v) for v in values for name in ("", BEFORE)],
        *[end[v].alias(UPTO + v) for v in values],
        *[F.sum(f"_sum_{v}").over(group).alias(name) for v, name in totals.items()],
    )
