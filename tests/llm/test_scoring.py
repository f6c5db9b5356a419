import math
import zlib

import numpy as np
from llm.cases import ODD_TEXTS, documents, prose, words

from waveplan.llm import scoring
from waveplan.llm.scoring import CLASSES, RATE, START, adapt, along, classes, code, in_context, op10_scoring, score_texts, tables, train


def lowered(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words(text)] + ["\n"]


def plain(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = {}
    for i, text in rows:
        if not held(i):
            for w in lowered(text):
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        own = lowered(text)
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        out.append((i, held(i), len(own), sum(w in counts for w in own), total, round(base, 6)))
    return sorted(out, key=str)


def check(spark, rows):
    got = score_texts(documents(spark, rows)).collect()
    mine = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got]
    assert sorted(mine, key=str) == plain(rows)
    for r in got:
        assert math.isfinite(r["score"]) and r["score"] < 0 and r["bits_per_byte"] > 0
    return got


def test_counts_and_base_scores(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(20 + i, prose(80, i)) for i in range(40)] + [(None, "The THE the É é"), (7, "x"), (7, "x")]
    rows += [(90, prose(20_000, 1, 5000)), (91, "y" * 50_000)]
    check(spark, rows)


def test_no_training_rows_and_empty_table(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = check(spark, [(i, "some words") for i in held])
    assert {r["train_tokens"] for r in got} == {0}
    # every bit has probability 1/2: 4 + 5 letters, two stop bytes, the end and its stop byte
    assert abs(got[0]["score"] + 8 * (9 + 2 + 2) * math.log10(2)) < 1e-6
    assert score_texts(documents(spark, [])).collect() == []


def test_probabilities_of_tokens_add_up_to_less_than_one():
    known = [b"the", b"then", b"th", b"a", b"\n"]
    lengths, body = np.array([len(w) for w in known]), np.frombuffer(b"".join(known), np.uint8)
    counts = np.array([50, 9, 1, 30, 10])
    mixer = train(tables(lengths, body, counts), [(w, int(c)) for w, c in zip(known, counts) for _ in range(c)], 100)
    one = [bytes([c]) for c in range(1, 256)]
    two = [bytes([a, b]) for a in range(1, 256) for b in range(1, 256)]
    every = one + two
    bits = mixer.log2_of_bits(np.array([len(w) for w in every]), np.frombuffer(b"".join(every), np.uint8))
    assert 0 < (2.0**bits).sum() <= 1.0 + 1e-6
    totals = np.array([100.0])
    assert abs(mixer.known(counts[:, None], totals).sum() - 1) < 1e-6


def test_held_out_texts_of_the_tables_are_predicted(spark, medium):
    got = op10_scoring(spark, medium).filter("held_out").collect()
    # the base gives all unknown tokens together one share, so only known ones compare
    known = [r for r in got if r["n_known"] == r["n_tokens"]]
    assert len(known) > 20 and sum(r["score"] for r in known) > sum(r["base_score"] for r in known)
    # all letters and stop bytes alike would need 8 bits a byte
    assert sum(r["bits_per_byte"] for r in got) / len(got) < 3


def test_contexts_end_at_the_token():
    lengths = np.array([2, 3])
    data, context, token = code(lengths, np.frombuffer(b"abcab", np.uint8))
    assert data.tolist() == [97, 98, 0, 99, 97, 98, 0] and token.tolist() == [0, 0, 0, 1, 1, 1, 1]
    alone = code(np.array([3]), np.frombuffer(b"cab", np.uint8))[1]
    assert (context[:, 3:] == alone).all()
    assert (context[:, 0] == context[:, 3]).all() and (context[4, 2] != context[4, 6])


def test_classes_part_languages_and_belief_adapts():
    texts = [prose(60, i, 50) for i in range(30)] + [prose(60, i, 50).replace("w", "v") for i in range(30)]
    logs = classes(texts, 2)
    assert logs.shape[1] == 2 and classes(texts[:1], CLASSES).shape[1] == 1
    log_known = np.log(np.array([[0.9, 0.1]] * 6 + [[0.1, 0.9]] * 3))
    belief = adapt(log_known, np.array([0, 6, 6, 9]), np.log([0.5, 0.5]))
    assert np.allclose(belief[[0, 6]], 0.5) and belief[5, 0] > 0.999 and belief[8, 1] > 0.98


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 1


def test_shuffled_words_score_worse(spark):
    import random

    make = random.Random(5)
    follow = {w: [make.randrange(300) for _ in range(4)] for w in range(300)}

    def chain(n):
        w, out = make.randrange(300), []
        for _ in range(n):
            out.append(f"w{w}")
            w = make.choice(follow[w])
        return out

    rows, twins, i = [(i, " ".join(chain(120))) for i in range(300)], [], 1000
    while len(twins) < 15:
        if held(i) and held(i + 100_000):
            text = chain(120)
            rows += [(i, " ".join(text)), (i + 100_000, " ".join(make.sample(text, len(text))))]
            twins.append((i, i + 100_000))
        i += 1
    score = {r["doc_id"]: r["score"] for r in score_texts(documents(spark, rows)).collect()}
    # 120 tokens, each one of 4 successors instead of one of 300 words
    assert all(score[a] > score[b] + 30 for a, b in twins)


def plain_contexts(texts, learns, train):
    """Gates and the probabilities of every token in its context, by dictionaries."""
    pair_count, count = {}, {}
    for t, learn in zip(texts, train):
        for a, b in zip(["\n", *t], t):
            if learn:
                pair_count[a, b] = pair_count.get((a, b), 0) + 1
                count[a] = count.get(a, 0) + 1
    rows = []
    for t, learn in zip(texts, learns):
        pairs = list(zip(["\n", *t], t))
        for k, (a, b) in enumerate(pairs):
            seen = count.get(a, 0) - (sum(x == a for x, _ in pairs) if learn else 0)
            both = pair_count.get((a, b), 0) - (pairs.count((a, b)) if learn else 0)
            here = sum(x == a for x, _ in pairs[:k])
            p = [both / seen if seen else 0, t[:k].count(b) / k if k else 0, pairs[:k].count((a, b)) / here if here else 0]
            gate = sum(seen >= x for x in (1, 4, 32, 1024)) * 3 + sum(k >= x for x in (64, 1024))
            rows.append((p, [seen > 0, k > 0, here > 0], gate, pair_count.get((a, b), 0), count.get(a, 0)))
    return rows


def plain_along(logs, speaks, gate, first):
    out = []
    for a, b in zip(first, first[1:]):
        weights, step = START.copy(), np.zeros_like(START)
        for k in range(a, b):
            if (k - a) % scoring.BLOCK == 0:
                weights, step = weights + step, np.zeros_like(START)
            z = [math.exp(w) if s else 0 for w, s in zip(weights[gate[k]], speaks[k])]
            share = [x / sum(z) for x in z]
            joint = [x * math.exp(p) for x, p in zip(share, logs[k])]
            out.append(math.log(sum(joint)))
            step[gate[k]] += [RATE * (j / sum(joint) - x) for j, x in zip(joint, share)]
    return out


def test_contexts_and_mixing_equal_a_plain_version():
    import random

    make = random.Random(2)
    texts = [[*(f"w{make.randrange(12)}" for _ in range(n)), "\n"] for n in (0, 1, 70, 5, 200, 0, 131)]
    learns = np.array([True, False, True, True, False, True, True])
    rows = plain_contexts(texts, learns, learns)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    token = np.array([vocabulary[w] for t in texts for w in t])
    pair = np.array([100 * vocabulary[a] + vocabulary[b] for t in texts for a, b in zip(["\n", *t], t)])
    p, speaks, gate = in_context(token, pair, first, learns, np.array([r[3] for r in rows], float), np.array([r[4] for r in rows]))
    assert np.allclose(p, [r[0] for r in rows]) and speaks.tolist() == [r[1] for r in rows] and gate.tolist() == [r[2] for r in rows]
    with np.errstate(divide="ignore"):
        logs = np.concatenate([np.log(np.random.default_rng(1).random((len(p), 1))), np.log(p)], 1)
    every = np.concatenate([np.ones((len(p), 1), bool), speaks], 1)
    assert np.allclose(along(logs, every, gate, first), plain_along(logs, every, gate, first))


def test_pairs_of_all_training_documents_are_counted():
    import pyarrow as pa

    texts = ["a b a b", "b a", "", None, "a b"]
    sent = []
    for chunk, rows in enumerate((slice(0, 2), slice(2, 5))):
        own = pa.table({"text": pa.array(texts[rows], pa.string()), "held_out": pa.array([False, False, False, False, True][rows])})
        sent.append(scoring._send_pairs(3)((pa.scalar(chunk),), own))
    table, got = pa.concat_tables(sent), {0: {}, 1: {}}
    for bucket in set(table["bucket"].to_pylist()):
        own = table.filter(pa.compute.equal(table["bucket"], bucket))
        for row in scoring._count_pairs((pa.scalar(bucket),), own).to_pylist():
            got[row["chunk"]][bucket] = np.frombuffer(row["body"][0], np.float32).tolist()
    counts = {}
    for t in texts[:4]:
        w = lowered(t)
        for x in zip(["\n", *w], w):
            counts[x] = counts.get(x, 0) + 1
    for chunk, rows in enumerate((texts[:2], texts[2:])):
        kinds = {x for t in rows for x in zip(["\n", *lowered(t)], lowered(t))}
        flat = [c for b in sorted(got[chunk]) for c in got[chunk][b]]
        assert sorted(flat) == sorted(counts.get(x, 0) for x in kinds)


def test_every_training_text_and_token_teaches(spark, monkeypatch):
    # 2,200 texts and some 60,000 tokens; a sample of either would be smaller
    rows = [(i, " ".join(f"w{i % 2}{(i * k) % 97}" for k in range(1, 30))) for i in range(2200)] + [(5000, ""), (5001, None)]
    texts, tokens = [], []
    fit, taught = scoring.fit_classes, scoring.taught

    def fitted(add_up, kinds):
        texts.append(int(add_up(scoring.moments, scoring._GROUPS**2 + scoring._GROUPS + 1)[-1]))
        return fit(add_up, kinds)

    def mixer(table, sums, total):
        tokens.append(int(sums[-scoring._PARTS[-1] :].sum()))
        return taught(table, sums, total)

    monkeypatch.setattr(scoring, "fit_classes", fitted)
    monkeypatch.setattr(scoring, "taught", mixer)
    got = score_texts(documents(spark, rows)).collect()
    assert texts == [sum(not held(i) for i, t in rows if t)]
    assert tokens == [got[0]["train_tokens"]] == [sum(len(lowered(t)) for i, t in rows if not held(i))]


def test_the_model_does_not_depend_on_how_rows_are_dealt():
    import pyarrow as pa

    texts = [prose(60, i, 50).replace("w", "wvx"[i % 3]) for i in range(90)]
    alone = [own for t in texts for own in scoring.profiles(pa.array([t], pa.string()))]
    add = lambda function, size: sum(function(own).astype(np.int64) for own in alone)
    assert np.array_equal(scoring.fit_classes(add, 3), classes(texts, 3))
    known = [b"the", b"then", b"th", b"a", b"other", b"\n"]
    counts, size = np.array([50, 9, 1, 30, 2, 10]), np.array([len(w) for w in known])
    table = tables(size, np.frombuffer(b"".join(known), np.uint8), counts)
    one = lambda at: scoring.learn(
        table, size[at], np.frombuffer(b"".join(known[i] for i in at), np.uint8), counts[at], counts[at], 102
    )
    a, b = one([0, 1, 2]), one([3, 4, 5])
    mixer, plain = scoring.taught(table, a + b, 102), scoring.taught(table, np.zeros(len(a)), 102)
    assert (mixer.weights != plain.weights).any() and (mixer.refine != plain.refine).any() and mixer.share != plain.share


def test_one_pass_sends_tokens_and_pairs(spark, monkeypatch):
    # the texts are cut into tokens twice: once to send tokens and pairs, once to score; profiles cut the training texts
    import pyarrow as pa

    texts = pa.array(["B a b", None, "", "c " * 50], pa.string())
    cuts, split = [], scoring.split
    monkeypatch.setattr(scoring, "split", lambda *a, **k: cuts.append(1) or split(*a, **k))
    own = pa.table({"text": texts, "held_out": [False, False, True, True]})
    table = scoring._send(2, 3, np.zeros((1 << scoring.CLASS_BITS, 2), np.float32))((pa.scalar(7),), own)
    assert len(cuts) == 1
    pairs = table.filter(pa.compute.equal(table["kind"], 1)).drop_columns("kind")
    assert pairs.equals(scoring._send_pairs(3)((pa.scalar(7),), own))
    assert set(table["chunk"].to_pylist()) == {7} and sum(table.filter(pa.compute.equal(table["kind"], 0))["n"].to_pylist()) == 4


def test_mixing_holds_where_a_token_has_next_to_no_probability():
    logs, speaks = np.full((70, 4), -np.inf), np.zeros((70, 4), bool)
    speaks[:, 0] = True
    logs[:, 0] = np.linspace(-1, -4000, 70)
    gate, first = np.zeros(70, np.int64), np.array([0, 0, 70, 70])
    assert np.allclose(along(logs, speaks, gate, first), logs[:, 0])
    speaks[::3, 1:], logs[::6, 2] = True, -1.0
    logs[:, 0] = np.linspace(-1, -700, 70)
    assert np.allclose(along(logs, speaks, gate, first), plain_along(logs, speaks, gate, first))


def test_answers_in_few_bytes_are_read_like_long_ones():
    import pyarrow as pa

    small, large = np.array([[3, 1 << 30]], np.int32), np.array([[1 << 40, 2], [5, 6]], np.int64)
    rows = {"bucket": [1, 0], "kind": [0, 0], "n": [2, 1], "body": [[b"", large.tobytes()], [b"", small.tobytes()]]}
    _, count = scoring._replies(pa.table(rows), 0, [np.float32, (np.int32, np.int64)], 2)
    assert count.dtype == np.int64 and count.reshape(-1, 2).tolist() == [[3, 1 << 30], [1 << 40, 2], [5, 6]]
