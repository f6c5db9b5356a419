"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five words in a row (a text of fewer words is one shingle); its weight is how
often it stands in the text times the mean inverse document frequency of its words, so one
changed word weighs about as much as the word it replaces. Document frequencies are counted
over all documents in a hashed table of fixed size. Two texts are linked if the weighted
Jaccard similarity of their shingles, sum of minima over sum of maxima, is 0.8 or more.

1. Texts with the same words form one node with a number of its own; only nodes go on.
2. Each node draws ``BANDS * ROWS`` consistent weighted samples; ROWS of them make a band's
   key, and nodes that share a band's key are candidates. At similarity 0.8, one in 1,200
   pairs shares none of the keys.
3. In each bucket (band, key) the node that meets most others in all its buckets is the
   centre that they are compared with: as many comparisons as members, not pairs of members.
   Nodes that share two buckets, each still with members of several classes, are compared
   around new centres of other classes, until a round finds no link. Pairs whose samples
   hardly agree are left to the next step.
4. Pairs of a bucket that are in two classes still are compared, all of them, but for those
   that exact bounds exclude: texts this similar share one of their heads, the rarest
   shingles with more than a fifth of the text's weight, and at the first one that they
   share, both have enough weight left. Rarest are those that only one class has, then those of
   few texts, by exact counts over the texts that are left. Large classes first meet the others by a few members.
5. Classes are the connected components of the links; a class is named by its smallest id.

Defined results: texts without words (null, empty, blank) are classes of their own, as are
rows with a null id (class null); rows of one id with different texts are documents of their own, each row
is returned; an empty table gives an empty table. Bucket minima are aggregated before the shuffle and
joins split skewed keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waveplan.llm import chunks
from waveplan.llm.recompress import stretch_names
from waveplan.llm.store import Run, read
from waveplan.llm.words import Words, mix, slices, split

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 3
IDF_BITS = 18
#: Centres that a bucket of several classes gets in a round.
CENTRES = 2
#: Samples, of BANDS * ROWS, that are equal where texts are compared around centres.
AGREE = 17
_BLOCK = 1 << 14
_SIGNED = "id long, mark long, words long, mark1 long, mark2 long, total double, bands array<long>, samples array<int>"


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) in the middle of n equal parts, by bisection of its distribution."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return ((low + high) / 2).astype(np.float32)


_GAMMA = _gamma_quantiles(1 << 16)
_LOG_GAMMA = np.log(_GAMMA)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def slot(name: np.ndarray) -> np.ndarray:
    return (name >> np.uint64(64 - IDF_BITS)).astype(np.int64)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts a slot's words stand; the number of texts with words is put last."""
    total = np.zeros((1 << IDF_BITS) + 1)
    for batch in batches:
        for i, j in slices(batch["text"]):
            words = split(batch["text"].slice(i, j - i))
            one = np.unique((words.doc << IDF_BITS) | slot(words.name))
            total[:-1] += np.bincount(one & ((1 << IDF_BITS) - 1), minlength=1 << IDF_BITS)
            total[-1] += (np.diff(words.first) > 0).sum()
    yield chunks.sliced(total)


def inverse_frequencies(frequencies: np.ndarray) -> np.ndarray:
    """1 for a word in every text to 2 for a word in none, by the logarithm of its frequency.

    Scaled, as in a large group of copies shared words are frequent by the group itself and
    a rare word put in would otherwise outweigh them.
    """
    n = frequencies[-1]
    return (2 - np.log(np.minimum(frequencies[:-1], n) + 1) / np.log(max(n, 1) + 1)).astype(np.float32)


def shingles(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text (by text, then name), their weights, where texts begin."""
    n = np.diff(words.first)
    width = np.minimum(n, SHINGLE)
    count = np.where(n > 0, n - width + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + words.first[text]
    name = stretch_names(words.name, SHINGLE)(start, start + width[text] - 1)
    order = np.lexsort((name, text))
    name, text = name[order], text[order]
    at = chunks.heads(text, name)
    times = np.diff(np.append(at, len(name)))
    first = order[at]
    size, own = width[text[at]], idf[slot(words.name)].astype(float)
    mean = np.zeros(len(at))
    for k in range(SHINGLE):
        mean += np.where(k < size, own[np.minimum(start[first] + k, len(own) - 1)], 0) if len(at) else 0
    mean /= size
    return name[at], (times * mean).astype(np.float32), np.searchsorted(text[at], np.arange(len(n) + 1))


def sample_bands(name: np.ndarray, weight: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all bands, and 32 bits of each sample, of every text that has shingles.

    Sample k of a text is its shingle with the least ln(a) = ln(c) - r * (t - beta) - r where
    t = floor(ln(weight) / r + beta), together with t; r and c are Gamma(2, 1), beta is
    uniform, all three drawn from a hash of the shingle and k.
    """
    full = np.flatnonzero(np.diff(first) > 0)
    starts = first[full]
    keys, samples = np.zeros((len(full), BANDS), np.uint64), np.zeros((len(full), BANDS * ROWS), np.uint32)
    if not len(full):
        return keys, samples
    counts = np.diff(np.append(starts, len(name)))
    log_weight = np.log(weight)
    cost, step = np.empty(len(name), np.float32), np.empty(len(name), np.float32)
    for k in range(BANDS * ROWS):
        for a in range(0, len(name), _BLOCK):
            b = min(a + _BLOCK, len(name))
            h = name[a:b] * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
            r = _GAMMA[(h >> np.uint64(48)).astype(np.int64)]
            beta = ((h >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2**-16)
            log_c = _LOG_GAMMA[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)]
            t = np.floor(log_weight[a:b] / r + beta)
            cost[a:b] = log_c - r * (t - beta + 1)
            step[a:b] = t
        least = np.repeat(np.minimum.reduceat(cost, starts), counts)
        best = np.flatnonzero(cost == least)
        best = best[np.searchsorted(best, starts)]  # shingles are sorted, so ties agree
        drawn = mix(name[best] + step[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        band = k // ROWS
        keys[:, band] = mix(keys[:, band] * np.uint64(31) + drawn + np.uint64(band))
        samples[:, k] = (drawn >> np.uint64(32)).astype(np.uint32)
    return keys, samples


def _sign(idf: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks of the whole word sequence and keys of the bands."""
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                words = split(part["text"])
                n = np.diff(words.first)
                full = np.flatnonzero(n > 0)
                name, weight, first = shingles(words, idf)
                keys, samples = sample_bands(name, weight, first)
                low, high = words.first[:-1][full], words.first[1:][full] - 1
                marks = [
                    stretch_names(names, 1)(low, high).view(np.int64) if len(full) else np.zeros(0, np.int64)
                    for names in (words.name, mix(words.name ^ np.uint64(0x5851F42D4C957F2D)))
                ]
                wide = [np.zeros(j - i, np.int64) for _ in marks]
                for x, own in zip(wide, marks):
                    x[full] = own
                bands: list = [None] * (j - i)
                drawn: list = [None] * (j - i)
                for row, d in enumerate(full.tolist()):
                    bands[d], drawn[d] = keys[row].view(np.int64), samples[row].view(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part["id"],
                        "mark": part["mark"],
                        "words": pa.array(n),
                        "mark1": pa.array(wide[0]),
                        "mark2": pa.array(wide[1]),
                        "total": pa.array(np.diff(np.concatenate([[0.0], np.cumsum(weight, dtype=float)])[first])),
                        "bands": pa.array(bands, pa.list_(pa.int64())),
                        "samples": pa.array(drawn, pa.list_(pa.int32())),
                    }
                )

    return sign


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two lists of sorted names and weights."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][at], b[1][bt]).sum(dtype=float))
    total = float(a[1].sum(dtype=float) + b[1].sum(dtype=float))
    return least / (total - least) if total else 0.0


def _verify(idf: np.ndarray, least: float):
    def weigh(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for i, j in slices(texts):
            name, weight, first = shingles(split(texts.slice(i, j - i)), idf)
            out += [(name[a:b], weight[a:b]) for a, b in zip(first, first[1:])]
        return out

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, text_b = batch["b"].to_pylist(), batch["text_b"]
            # a centre's rows stand together after the join: weigh it once for each run of them
            heads = [i for i in range(len(b)) if i == 0 or b[i] != b[i - 1] or text_b[i] != text_b[i - 1]]
            centres = weigh(text_b.take(pa.array(heads, pa.int64())))
            where = np.searchsorted(heads, np.arange(len(b)), "right") - 1
            own = weigh(batch["text_a"])
            linked = [similarity(x, centres[w]) >= least for x, w in zip(own, where)]
            yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["b"], "linked": pa.array(linked, pa.bool_())})

    return verify


def _weighed(idf: np.ndarray):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shingles of each text with their weights."""
        for batch in batches:
            for i, j in slices(batch["text"]):
                part = batch.slice(i, j - i)
                name, weight, first = shingles(split(part["text"]), idf)
                row = pa.array(np.repeat(np.arange(j - i), np.diff(first)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": part["id"].take(row),
                        "label": part["label"].take(row),
                        "shingle": name.view(np.int64),
                        "weight": weight.astype(float),
                    }
                )

    return weigh


def heads(weighed: DataFrame, least: float) -> DataFrame:
    """The shingles that two texts of different classes, similar by ``least``, must share one of.

    ``weighed`` are shingles (id, label, shingle, weight) with the total weight of their text. Those of one class
    only come first, then the others by the number of texts they stand in, then by name; ``rest`` is the weight
    of a shingle and all behind it. What two texts share begins at the first shared shingle in this
    order, so in both at least ``least`` of the weight is left there.
    """
    counted = weighed.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = weighed.join(counted.filter("low < high").drop("low", "high").hint("merge"), "shingle")
    behind = Window.partitionBy("id").orderBy(F.desc("texts"), F.desc("shingle")).rowsBetween(Window.unboundedPreceding, 0)
    rest = shared.withColumn("rest", F.sum("weight").over(behind))
    return rest.filter(F.col("rest") >= (least - 1e-6) * F.col("total")).drop("weight", "texts")


def components(run: Run, links: DataFrame, name: str) -> DataFrame:
    """id and label (smallest id of its component) of every node of the links (a, b).

    Each round a node takes the smallest label among its own, its neighbours' and its label's
    label. Every round is written down; they end when no label falls.
    """
    both = run.keep(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    labels = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label"))
    labels, step = run.keep(labels, f"{name}-0"), 0
    while True:
        step += 1
        of = labels.select(F.col("id").alias("b"), "label")
        beside = both.join(of, "b").groupBy("a").agg(F.min("label").alias("low"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        after = labels.join(up, "label").join(beside, F.col("id") == F.col("a"))
        after = after.select("id", F.col("label").alias("was"), F.least("next", "low").alias("label"))
        after = run.keep(after, f"{name}-{step}")
        run.drop(f"{name}-{step - 1}")
        labels = after.select("id", "label")
        if after.filter("label < was").isEmpty():
            run.drop(f"{name}-links")
            return labels


def _equal(own: Column, other: Column) -> Column:
    """How many places of two arrays are equal."""
    return F.size(F.filter(F.zip_with(own, other, lambda x, y: x == y), lambda x: x))


def _twos(held: str) -> Column:
    """A key for every two of the buckets (band, key) in an array."""
    key = lambda x, y: F.xxhash64(x["band"], x["key"], y["band"], y["key"])
    return F.flatten(F.transform(held, lambda x, i: F.transform(F.slice(held, i + 2, F.lit(BANDS)), lambda y: key(x, y))))


def _possible(own: Column, other: Column, least: float) -> Column:
    """Similarity is at most the smaller total weight over the larger."""
    return F.least(own, other) >= (least - 1e-6) * F.greatest(own, other)


def _likely(own: Column, other: Column, least: float) -> Column:
    """False where two nodes (total, samples) can't, or all but can't, reach the similarity.

    Samples are equal as often as nodes are similar: at 0.8 fewer than AGREE of 30 are in one
    of 1,100 pairs.
    """
    return _possible(own["total"], other["total"], least) & (_equal(own["samples"], other["samples"]) >= AGREE)


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and node_id (smallest id with the same words) of every row."""
    return _classes(docs, least).select("doc_id", "class_id", "node_id")


def _classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The same with ``mark``, a hash that tells the texts of one id apart, and ``class``, the number of the class;
    null for rows that are classes of their own."""
    spark = docs.sparkSession
    run = Run(spark, "neardup")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    counted = own.select("text").mapInArrow(_document_frequencies, chunks.SLICED)
    idf = inverse_frequencies(chunks.summed(counted, (1 << IDF_BITS) + 1))
    signed = run.keep(own.mapInArrow(_sign(idf), _SIGNED), "signed")
    some = signed.filter("id IS NOT NULL AND words > 0")
    nodes = some.groupBy("mark1", "mark2").agg(F.min(F.struct("id", "mark", "total", "bands", "samples")).alias("one"))
    nodes = nodes.select("mark1", "mark2", F.col("one.id").alias("first_id"), "one.mark", "one.total", "one.bands", "one.samples")
    # a node's number is fixed by being written
    nodes = run.keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    drawn = nodes.select(F.col("node").alias("id"), "total", "samples")
    # members of buckets with two nodes or more; a node's weight: whom it meets in all its buckets
    sizes = buckets.groupBy("band", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = run.keep(buckets.join(sizes, ["band", "key"]), "met")
    weights = met.groupBy("node").agg(F.sum("size").alias("weight"))
    members = met.drop("size").join(weights, "node")
    pick = F.max(F.struct("weight", F.xxhash64("node").alias("h"), "node"))
    centres = members.groupBy("band", "key").agg(pick.getField("node").alias("centre"))
    members = members.join(centres, ["band", "key"])
    members = run.keep(members, "members")
    run.drop("met")
    # texts are joined in one way at every size: shuffled, never with a broadcast side
    chosen = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    chosen = chosen.select(F.col("first_id").alias("id"), "mark", "node").hint("merge")
    texts = run.keep(own.join(chosen, ["id", "mark"]).select(F.col("node").alias("id"), "text"), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
        right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        met = pairs.select("a", "b").join(left.hint("merge"), "a").join(right.hint("merge"), "b")
        met = met.select("a", "b", "text_a", "text_b")
        linked = met.mapInArrow(_verify(idf, least), "a long, b long, linked boolean")
        return run.keep(linked.filter("linked").select("a", "b").distinct(), name)

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs whose ends are not in one class yet, as pairs with their labels la and lb."""
        a = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
        b = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        joined = pairs.join(a, "a", "left").join(b, "b", "left").withColumn("la", F.coalesce("la", "a"))
        return joined.withColumn("lb", F.coalesce("lb", "b")).filter("la != lb").select("a", "b", "la", "lb")

    def joined(labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Labels after the classes at the ends of the links have become one."""
        classes = apart(links, labels).select(F.col("la").alias("a"), F.col("lb").alias("b"))
        merged = components(run, classes, name).select(F.col("id").alias("label"), F.col("label").alias("new"))
        after = labels.join(merged, "label", "left").select("id", F.coalesce("new", "label").alias("label"))
        after = run.keep(after, f"labels-{name}")
        run.drop(*[f"{name}-{k}" for k in range(100)])
        return after

    pairs = members.filter("node != centre").groupBy(F.col("node").alias("a"), F.col("centre").alias("b")).count()
    mine = drawn.select(F.col("id").alias("a"), F.struct("total", "samples").alias("own"))
    theirs = drawn.select(F.col("id").alias("b"), F.struct("total", "samples").alias("other"))
    pairs = pairs.join(mine, "a").join(theirs, "b").filter(_likely(F.col("own"), F.col("other"), least)).drop("own", "other")
    pairs = run.keep(pairs, "pairs")
    links = verified(pairs, "links1")
    alone = members.select(F.col("node").alias("id")).distinct().withColumn("label", F.col("id"))
    labels = joined(run.keep(alone, "alone"), links, "classes1")
    run.drop("alone", "pairs", "links1")
    # what is left are buckets that hold several classes, by a passage that many texts share, say:
    # nodes that share two such buckets are compared once more, around new centres
    several = members.select("band", "key", "weight", F.col("node").alias("id")).join(labels, "id")
    mixed = several.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    held = several.join(mixed.select("band", "key"), ["band", "key"]).groupBy("id", "weight")
    held = held.agg(F.array_sort(F.collect_list(F.struct("band", "key"))).alias("held"))  # at most BANDS of them
    twos = held.select("id", "weight", "held", F.explode(_twos("held")).alias("key"))
    own = F.struct("total", "samples").alias("own")
    open_buckets = run.keep(twos.join(drawn.select("id", own), "id"), "twos")
    tried, step = open_buckets.select("key", "id").limit(0), 1
    while True:
        # the next centres of a bucket are of classes that have had none
        step += 1
        had = tried.join(labels, "id").select("key", "label").distinct()
        now = run.keep(open_buckets.join(labels, "id").join(had, ["key", "label"], "left_anti"), f"open{step}")
        pick = F.max(F.struct("weight", F.xxhash64("id").alias("h"), "id", "own"))
        fresh = now.groupBy("key", "label").agg(pick.alias("c"))
        place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c.weight"), "c.h", "c.id"))
        fresh = fresh.withColumn("place", place).filter(F.col("place") <= CENTRES)
        fresh = fresh.select("key", F.col("label").alias("la"), F.col("c.id").alias("centre"), F.col("c.own").alias("other"))
        once = F.lit(True)
        if "held" in now.columns:
            # a centre of many such buckets meets a node in one of them; later, nodes have left some of theirs
            fresh = fresh.join(fresh.groupBy("centre").agg(F.collect_set("key").alias("of_centre")), "centre")
            once = F.col("key") == F.array_min(F.array_intersect(_twos("held"), F.col("of_centre")))
        new = now.join(fresh, "key").filter("label != la").filter(_likely(F.col("own"), F.col("other"), least) & once)
        new = new.select(F.greatest("id", "centre").alias("a"), F.least("id", "centre").alias("b")).distinct()
        found = verified(run.keep(new, f"new{step}"), f"links{step}")
        run.drop(f"new{step}", f"open{step - 1}", "twos")
        if found.isEmpty():
            break
        tried = run.keep(tried.union(fresh.select("key", F.col("centre").alias("id"))), f"tried{step}")
        labels = joined(labels, found, f"classes{step}")
        run.drop(f"links{step}", f"tried{step - 1}", f"labels-classes{step - 1}")
        open_buckets = now.drop("label", "held")
    run.drop(f"links{step}", f"open{step}", f"tried{step - 1}")
    # all pairs of a bucket that are in two classes still, without those that can't be similar:
    # they share a shingle of their heads, with enough weight from there on in both
    several = members.select("band", "key", F.col("node").alias("id")).join(labels, "id")
    mixed = several.groupBy("band", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    left = several.join(mixed.select("band", "key"), ["band", "key"]).select("id", "label").distinct()
    left = run.keep(left.join(nodes.select(F.col("node").alias("id"), "total", "bands"), "id"), "left")
    rest = texts.join(left.select("id", "label").hint("merge"), "id")
    weighed = run.keep(rest.mapInArrow(_weighed(idf), "id long, label long, shingle long, weight double"), "weighed")
    cut = heads(weighed.join(left.select("id", "total").hint("merge"), "id"), least)
    cut = run.keep(cut.join(left.select("id", "bands").hint("merge"), "id"), "heads")
    run.drop("weighed")
    def candidates(cut: DataFrame, name: str) -> DataFrame:
        """Pairs of two classes that share a shingle of their heads with enough weight behind it, and a bucket."""
        side = lambda n: cut.select("shingle", *[F.col(x).alias(f"{x}_{n}") for x in ("id", "label", "total", "rest", "bands")])
        enough = F.least("rest_a", "rest_b") * (1 + least) >= (least - 1e-6) * (F.col("total_a") + F.col("total_b"))
        meet = (F.col("label_a") < F.col("label_b")) & _possible(F.col("total_a"), F.col("total_b"), least) & enough
        new = side("a").join(side("b").hint("merge"), "shingle").filter(meet & (_equal(F.col("bands_a"), F.col("bands_b")) > 0))
        return run.keep(new.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), name)

    # a large class first meets the others by two of its members for each shingle, other ones for
    # other shingles: most of what belongs to it is found so, and then needs no pairs with the rest of it
    member = F.struct(F.xxhash64("id", "shingle"), "id", "total", "rest", "bands")
    some = cut.groupBy("shingle", "label").agg(F.array_distinct(F.array(F.min(member), F.max(member))).alias("some"))
    some = some.select("shingle", "label", F.explode("some").alias("one")).select("shingle", "label", "one.id", "one.total", "one.rest", "one.bands")
    few = candidates(some, "few")
    found = verified(few, "links-few")
    labels = joined(labels, found, "classes-few")
    now = cut.drop("label").join(labels, "id")
    shared = now.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high")
    now = run.keep(now.join(shared.select("shingle").hint("merge"), "shingle"), "heads-now")
    both = F.struct(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).alias("pair")
    new = candidates(now, "rest").select("a", "b", both).join(few.select(both).hint("merge"), "pair", "left_anti")
    found = verified(run.keep(new.select("a", "b"), "new-rest"), "links-rest")
    labels = joined(labels, found, "classes-rest")
    run.drop("texts", "members", "left", "heads", "heads-now", "few", "rest", "new-rest", "links-few", "links-rest")
    known = nodes.select("mark1", "mark2", "first_id", "node").join(labels, F.col("node") == F.col("id"), "left")
    known = known.select("mark1", "mark2", "first_id", F.coalesce("label", "node").alias("class"))
    known = known.join(known.groupBy("class").agg(F.min("first_id").alias("class_id")), "class")
    out = signed.join(known, ["mark1", "mark2"], "left")
    alone = F.col("id").isNull() | (F.col("words") == 0)
    return out.select(
        F.col("id").alias("doc_id"),
        F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("node_id"),
        "mark",
        F.when(~alone, F.col("class")).alias("class"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class, that of its smallest id; of rows that repeat id and text one stays, rows
    of one id with different texts are in the classes of their texts, and rows with a null id all stay."""
    found = _classes(docs).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "class")
    first = found.filter("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("_id", "_mark")).alias("one")).select("one.*")
    kept = first.union(found.filter("class IS NULL").select("_id", "_mark")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col("text").cast("string")
    own = docs.select(row.alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_mark"))
    order = [F.col(f"_row.`{c}`").cast("string") for c in docs.columns if c not in ("doc_id", "text")]
    place = F.row_number().over(Window.partitionBy("_id", "_mark").orderBy(*order))
    own = own.filter("_id IS NULL").unionByName(
        own.join(kept, ["_id", "_mark"], "left_semi").withColumn("_place", place).filter("_place = 1").drop("_place")
    )
    return own.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def op5_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
