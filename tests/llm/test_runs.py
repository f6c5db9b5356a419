import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from llm.cases import ODD_TEXTS, documents, prose, words

from waveplan.llm.runs import find_runs, looped, op13_runs, runs, stretches
from waveplan.llm.suffix import Extensions, build, tour


def plain_runs(s, least, times):
    """Every stretch with a period, longest on both sides, that no smaller period has."""
    n, found = len(s), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= 2 * q and (i, j + q) not in found:
                found[i, j + q] = q
            i = j + 1
    return sorted(((a, b - a, q) for (a, b), q in found.items() if b - a >= max(least, times * q)), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text, least=24, times=3, alter=True):
    own = words(text)
    n = len(own)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if alter and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    found = plain_runs(own, least, times)
    kept = [w for i, w in enumerate(own) if not any(s + q <= i < s + size for s, size, q in found)]
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(kept)))


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_extensions_and_ranks_are_those_of_the_suffixes(letters):
    make = random.Random(letters)
    for n in [1, 2, 3, 8, 40, 90]:
        s = [make.randrange(letters) for _ in range(n)]
        ahead = Extensions(s)
        suffixes = [s[i:] for i in range(n + 1)]
        assert sorted(range(n + 1), key=lambda i: suffixes[i]) == np.argsort(ahead.rank).tolist()
        fall = [[-x for x in t] for t in suffixes]
        assert sorted(range(n + 1), key=lambda i: fall[i]) == np.argsort(ahead.falling_rank()).tolist()
        a, b = map(np.array, zip(*[(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]))
        same = [next((k for k, (x, y) in enumerate(zip(suffixes[i], suffixes[j])) if x != y), n - max(i, j)) for i, j in zip(a, b)]
        assert ahead.common(a, b).tolist() == same


def test_tree_has_a_leaf_for_each_suffix():
    s = [*b"abracadabra", -1]
    assert sorted(tour(build(s))[0]) == list(range(len(s)))


@pytest.mark.parametrize("seed", range(30))
def test_runs_equal_plain_ones(seed):
    make = random.Random(seed)
    letters = make.choice([1, 2, 2, 3, 4])
    s = [make.randrange(letters) for _ in range(make.randrange(1, 120))]
    if seed % 3:
        s = s + s[-make.randrange(1, 9) :] * make.randrange(1, 6) + s[:20]
    for least, times in [(2, 2), (4, 2), (6, 3), (24, 3)]:
        assert runs(s, least, times) == plain_runs(s, least, times)


@pytest.mark.parametrize("seed", range(20))
def test_no_run_lies_outside_of_the_stretches(seed):
    make = random.Random(seed)
    texts = [[make.randrange(3) for _ in range(make.randrange(60))] * make.randrange(1, 4) + [make.randrange(2)] * make.randrange(40) for _ in range(5)]
    names = np.array([make.randrange(3) + 0 * x for t in texts for x in t], np.uint64)
    doc = np.repeat(np.arange(5), [len(t) for t in texts])
    for least, times in [(24, 3), (10, 2), (7, 3)]:
        parts = stretches(names, doc, least, times)
        got = sorted((s + a, size, q) for s, e in parts for a, size, q in runs(names[s:e].tolist(), least, times))
        expected = []
        for d in range(5):
            at = np.flatnonzero(doc == d)
            if len(at):
                expected += [(int(at[0]) + a, size, q) for a, size, q in plain_runs(names[at].tolist(), least, times)]
        assert got == sorted(expected)


def texts():
    make = random.Random(9)
    out = list(ODD_TEXTS)
    out += [prose(n, n, 40) for n in (5, 24, 30, 90, 200, 400)]
    out += ["x " * 24, "x " * 23, "a b " * 12, "a b " * 11 + "a", "a b c d e f g h i " * 3, "a b c d e f g h i " * 2 + "a b c d e f g h"]
    out += [" ".join(make.choice("ab") for _ in range(150)) for _ in range(12)]
    out += [prose(10, 1) + " " + (prose(13, 2) + "\n") * 4 + prose(20, 3) + "\n" + (prose(9, 2) + " \t") * 3]
    return out


def test_operator_equals_plain_runs(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "u v w " * 30), (3, "u v w " * 30), (3, "u v w " * 30)]
    got = find_runs(documents(spark, rows)).collect()
    kept = [(r.doc_id, hashlib.sha256((r.collapsed or "").encode()).hexdigest(), len(r.runs)) for r in got]
    expected = [plain_row(*r, alter=False) for r in rows]
    assert sorted(kept, key=str) == sorted([(e[0], e[-1], e[1]) for e in expected], key=str)


def test_query_equals_plain_rows(spark, tmp_path):
    rows = [(i, t) for k, t in enumerate(texts()) for i in range(k, 400, 40)]
    rows += [(None, "u v w " * 30), (7, prose(4000, 5)), (10**12, "a b c d " * 3000)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, op13_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([plain_row(*r) for r in rows], key=str)
    assert any(looped(i, 50) is not None for i in range(40))


def test_empty_table(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    out = op13_runs(spark, str(tmp_path))
    assert not out.count() and out.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert [f.dataType.typeName() for f in out.schema] == ["long"] * 6 + ["string"] * 2


def test_query_on_given_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = sorted(map(tuple, op13_runs(spark, small).collect()), key=str)
    short = {d.doc_id for d in docs if len(words(d.text)) <= 800}
    expected = sorted([plain_row(d.doc_id, d.text) for d in docs if d.doc_id in short], key=str)
    assert [g for g in got if g[0] in short] == expected and len(got) == len(docs)
