import math
import random

import duckdb
from compare import connect, same
from pyspark.sql import functions as F

from waveplan.llm.topk import OP2_SQL, op2_topk, top_k


def plain(rows, k, every):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(64 * x) for x in v]))
    out = []
    for n, (q, a) in enumerate(kept):
        if q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(kept) if m != n and len(a) == len(b))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def check(spark, rows, k=20, every=5, **blocks):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, query string")
    got = top_k(table, F.col("vec_id") % every == 0, k, **blocks).collect()
    assert sorted(map(tuple, got)) == plain(rows, k, every)


def test_random_vectors_in_several_blocks(spark):
    make = random.Random(2)
    rows = [(i, [make.gauss(0, 1) for _ in range(24)]) for i in range(300)]
    check(spark, rows, query_block=20, row_block=50)


def test_ties_odd_vectors_and_lengths(spark):
    make = random.Random(3)
    rows = [(i, [float(make.randrange(2)) for _ in range(3)]) for i in range(120)]
    rows += [(500, None), (505, [1.0, None, 2.0]), (510, [float("nan"), 1.0, 1.0]), (515, [float("inf"), 0.0, 0.0])]
    rows += [(520, [1.0]), (525, [2.0]), (530, []), (535, []), (None, [1.0, 1.0, 1.0])]
    rows += [(540, [1.0, 2.0, 3.0]), (540, [1.0, 2.0, 3.0]), (540, [0.0, 2.0, 3.0])]
    rows += [(600, [1e6, -1e6, 3e5]), (605, [1e6, 1e6, -2e5])]
    check(spark, rows)
    check(spark, rows, k=3, row_block=30)


def test_fewer_rows_than_asked_for_and_none(spark):
    check(spark, [(0, [1.0, 2.0]), (1, [0.5, -1.0])])
    check(spark, [])


def test_query_equals_sql(spark, small):
    same(op2_topk(spark, small), connect(small), OP2_SQL)


def test_rows_that_repeat_an_id_are_all_seen(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (1, [9.0, 0.0]), (20, [64.0, 0.0]), (20, [0.0, 1.0]), (3, [0.0, 2.0])]
    check(spark, rows, every=20)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    table.coalesce(1).write.parquet(str(tmp_path / "out"))
    (file,) = (tmp_path / "out").glob("part-*")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{file}')")
    same(top_k(table, F.col("vec_id") % 20 == 0), con, OP2_SQL)
