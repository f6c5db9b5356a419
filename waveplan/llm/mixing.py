"""Mixing sources to target weights by the cube method (balanced sampling).

Each document of a source gets the same expected number of copies, target over source size.
The whole part is given to all; the fraction is the probability of one more copy. Fractions
are moved along the null space of the balancing equations (number of documents, number of
words), so that both totals of a source stay as they are while one fraction after the other
reaches 0 or 1. Documents of a source are dealt to cells by a hash; a cell settles all but
two of its documents, and those left over meet in the next round's cells, until a source has
one cell. There a dozen documents of all sizes wait for the landing: with the two that the
flight leaves, they are rounded so that the words come nearest to the target.

Defined results: a null text has size 0; a null source is a source of its own; rows of one
id are documents of their own; a source of size 0 has target 0 and takes nothing; an empty
table gives an empty table; ties in size are ordered by a hash of the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveplan.llm.store import Run, read

WEIGHTS = (1.0, 2.0, 3.0)
MOST_COPIES = 3.0
CELL = 4096
SEED = 7
_EPS = 1e-9
#: Documents of a source that are rounded together in the end.
_WAIT = 12
_UNIT = "number int, cells long, cell long, id long, size long, whole long, p double, done boolean"
_UNIT_COLUMNS = [part.split()[0] for part in _UNIT.split(", ")]


def flight(size: np.ndarray, p: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Move all probabilities but two to 0 or 1; their sum and the expected words stay."""
    p, size = p.copy(), size.astype(float)
    held: list[int] = []
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        held.append(k)
        if len(held) < 3:
            continue
        a, b, c = size[held]
        step = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = min([(1 - p[k]) / u if u > 0 else p[k] / -u for k, u in zip(held, step) if u])
        down = min([p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in zip(held, step) if u])
        by = up if random.random() * (up + down) < down else -down
        for k, u in zip(held, step):
            p[k] = min(1.0, max(0.0, p[k] + by * u))
            if p[k] < _EPS or p[k] > 1 - _EPS:
                p[k] = round(p[k])
        held = [k for k in held if 0 < p[k] < 1]
    return p


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Round the few probabilities left so that the words, then the documents, come out best."""
    left = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off = ways - p[left]
        own = size[left].astype(float)
        out[left] = ways[np.argmin(np.abs(off @ own) + 0.02 * max(own.mean(), 1) * np.abs(off.sum(1)))]
    return out


def settle(size: np.ndarray, p: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Flight, then landing: of the last documents of a source some of every size wait for it."""
    moving = np.flatnonzero((p > 0) & (p < 1))
    waits = np.unique(moving[np.linspace(0, len(moving) - 1, min(len(moving), _WAIT)).astype(int)]) if len(moving) else moving
    flies = np.setdiff1d(moving, waits)
    out = p.copy()
    out[flies] = flight(size[flies], p[flies], random)
    return land(size, out)


def targets(sized: DataFrame, weights: tuple = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """One row for each source: number (code point order, null last), documents, size, target.

    Handing on what is above ``most`` times a source's size, by weight, again and again, ends
    at min(most * size, level * weight) with one level for all; sources are capped in order of
    size over weight, and the level follows from the sums before and behind each of them.
    """
    table = sized.groupBy("source").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size")
    )
    # one row a source: the only window here that has no key
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    table = table.withColumn("number", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") - 1) % len(weights) + 1)
    table = table.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    rise = Window.orderBy(F.col("most") / F.col("weight"), "number")
    before, behind = rise.rowsBetween(Window.unboundedPreceding, -1), rise.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    table = table.withColumn("total", F.sum("source_size").over(whole))
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(behind)
    table = table.withColumn("level", level)
    table = table.withColumn("capped", F.col("most") / F.col("weight") <= F.col("level"))
    first = F.min_by("level", F.when(~F.col("capped"), F.struct(F.col("most") / F.col("weight"), "number"))).over(whole)
    target = F.when(F.col("capped"), F.col("most")).otherwise(first * F.col("weight"))
    return table.select("source", "number", "documents", "source_size", target.alias("target"))


def _settle(seed: int):
    def settled(key: tuple, table: pa.Table) -> pa.Table:
        number, cells, cell = (k.as_py() for k in key)
        size, ids = table["size"].to_numpy(), table["id"].fill_null(-1).to_numpy()
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        p = table["p"].to_numpy()
        order = np.lexsort((p, ids, spread, -size))
        random = np.random.default_rng([seed, number, cells, cell])
        moved = np.empty(len(p))
        moved[order] = (settle if cells == 1 else flight)(size[order], p[order], random)
        done = pa.array((moved == 0) | (moved == 1))
        place = table.schema.get_field_index
        return table.set_column(place("p"), "p", pa.array(moved)).set_column(place("done"), "done", done)

    return settled


def words() -> Column:
    """Words of the column text."""
    return F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    most: float = MOST_COPIES,
    cell: int = CELL,
    seed: int = SEED,
    run: Run | None = None,
) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies."""
    run = run or Run(docs.sparkSession, "mixing")
    sized = run.keep(
        docs.select(
            F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), words().alias("size")
        ),
        "sized",
    )
    sources = run.keep(targets(sized, weights, most), "sources")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    left = sized.join(sources, sized["source"].eqNullSafe(sources["source"])).select(
        "number", "id", "size", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("p"), F.lit(False).alias("done")
    )
    settled, step = [], 0
    while True:
        # written first, so that its size is known when the join is planned
        cells = run.keep(left.groupBy("number").agg(F.ceil(F.count("*") / cell).alias("cells")), f"cells{step}")
        where = F.coalesce(F.pmod(F.xxhash64("id", "size", F.lit(seed + step)), F.col("cells")), F.lit(0))
        dealt = left.drop("cells", "cell").join(cells, "number").withColumn("cell", where).select(*_UNIT_COLUMNS)
        dealt = dealt.repartition("number", "cell")  # or all cells of a source share a task
        moved = run.keep(dealt.groupBy("number", "cells", "cell").applyInArrow(_settle(seed + step), _UNIT), f"units{step}")
        settled.append(moved.filter("done"))
        left, step = moved.filter("NOT done"), step + 1
        if left.isEmpty():
            break
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.join(sources, "number").select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target",
        (F.col("whole") + F.col("p").cast("long")).alias("copies"),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as the mix takes it.

    Rows alike in id, source and size get the numbers of copies of that kind in order.
    """
    run = Run(docs.sparkSession, "mixed")
    key = ["_id", "_source", "_size"]
    taken = mix_sources(docs, run=run).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("copies").alias("_copies")
    )
    taken = taken.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy("_copies")))
    taken = run.keep(taken.filter("_copies > 0"), "taken")
    run.drop("sized", "sources", *[f"{kind}{k}" for kind in ("units", "cells") for k in range(100)])
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"), F.col("source").cast("string").alias("_source"), words().alias("_size"),
        F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in ("text", "lang") if c in docs.columns]).alias("_order"),
    )
    own = own.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy("_order")))
    same = F.lit(True)
    for c in (*key, "_place"):
        same = same & own[c].eqNullSafe(taken[c])
    # texts are joined in one way at every size
    met = own.join(taken.hint("merge"), same).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    return met.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix_sources(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
