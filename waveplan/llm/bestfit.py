"""Packing token sequences: Martello-Toth dominance reduction, then best fit.

Documents are tokenized with a public tokenizer and end with one id; longer ones than a
sequence are cut, with the shorter piece first. What decides about the packing is how many pieces have
each length, a histogram of at most ``capacity`` entries whatever the input. On it, lengths from
long to short:

- Reduction. Take a piece, and let k be how many of the smallest others fit beside it at once. A set
  with this piece dominates all others if k is 0 (the piece alone), if the longest piece that fits
  fills the sequence or k is 1 (these two), or if k is 2 and that piece is at least as long as the
  two longest that fit, or is one of these two and no two others fit that both are longer than the
  second (Martello and Toth, 1990). Some best packing holds a dominating set, so it is fixed and the instance shrinks.
- Best fit. Each remaining piece, long to short, goes to the fullest open sequence that takes it.

Pieces of one length are alike, so a step handles as many copies at once as its argument
holds for, and yields one *placement*: which ranks of a length go to which sequences, and where.
Placements are a few thousand, whatever the input. Spark numbers the pieces of each length: ranks inside cells of bounded
size, plus what the cells before hold. A task looks placements up by length and rank.

Defined results: a null or empty text is one piece with the end id alone; rows that repeat an id are documents of
their own; a null id is kept; an empty table gives an empty table. Reruns agree up to equal rows.
"""

from __future__ import annotations

import bisect
import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waveplan.llm.store import Run, read

CAPACITY = 2048
END_ID = 0
VOCABULARY = "byte_bpe_50k.json"
#: Pieces that one task numbers.
CELL = 2_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks from ``rank`` on: ``each`` go to each of ``bins`` sequences,
    numbered from ``first``, one behind the other from ``offset`` on."""

    length: int
    rank: int
    bins: int
    each: int
    first: int
    offset: int


class _Instance:
    """What is left to pack, and the placements made."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.lengths = sorted(self.left)
        self.taken = dict.fromkeys(self.left, 0)
        self.bins = 0
        self.placements: list[Placement] = []

    def put(self, length: int, bins: int, each: int, first: int, offset: int) -> None:
        self.placements.append(Placement(length, self.taken[length], bins, each, first, offset))
        self.taken[length] += bins * each
        self.left[length] -= bins * each
        if not self.left[length]:
            del self.left[length]
            self.lengths.remove(length)

    def open(self, bins: int) -> int:
        self.bins += bins
        return self.bins - bins

    def fix(self, lengths: list[int], copies: int) -> None:
        """``copies`` sequences that hold just these pieces."""
        first, offset = self.open(copies), 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            self.put(length, copies, each, first, offset)
            offset += each * length

    def beside(self, length: int) -> int:
        """How many of the smallest others fit at once beside a piece; 3 stands for more."""
        room, found = self.capacity - length, 0
        for n in self.lengths:
            count = min(self.left[n] - (n == length), 3 - found, room // n)
            found += count
            room -= count * n
            if found == 3 or count < self.left[n] - (n == length):
                break
        return found

    def longest(self, room: int, used: list[int]) -> int | None:
        """The longest piece that fits into ``room`` beside those in ``used``."""
        at = bisect.bisect_right(self.lengths, room) - 1
        while at >= 0:
            n = self.lengths[at]
            if self.left[n] > used.count(n):
                return n
            at -= 1
        return None

    def pair(self, length: int) -> tuple[int, int] | None:
        """The two pieces of most length in total that fit beside one of ``length``."""
        room, best = self.capacity - length, None
        for a in reversed(self.lengths):
            if a >= room or self.left[a] <= (a == length):
                continue
            if best and 2 * a < sum(best):
                break
            b = self.longest(min(room - a, a), [length, a])
            if b is not None and (best is None or a + b > sum(best)):
                best = (a, b)
        return best

    def between(self, length: int, a: int, b: int) -> bool:
        """Do two pieces fit beside ``length`` that both are longer than b, next to one a that is used?"""
        found = []
        for n in self.lengths[bisect.bisect_right(self.lengths, b) : bisect.bisect_right(self.lengths, a)]:
            found += [n] * min(2, self.left[n] - (n == length) - (n == a))
            if len(found) >= 2:
                return length + found[0] + found[1] <= self.capacity
        return False

    def copies(self, lengths: list[int]) -> int:
        return min(self.left[n] // lengths.count(n) for n in set(lengths))


def reduce(instance: _Instance) -> None:
    """Fix dominating sets, lengths from long to short; a fixed set only shrinks what else fits,
    so its argument holds for further copies as long as its pieces last."""
    for length in sorted(instance.left, reverse=True):
        while instance.left.get(length):
            room = instance.capacity - length
            k = instance.beside(length)
            if k == 0:
                instance.fix([length], instance.left[length])
                continue
            near = instance.longest(room, [length])
            if length + near == instance.capacity or k == 1:
                chosen = [length, near]
            elif k == 2 and near >= sum(best := instance.pair(length)):
                chosen = [length, near]
            elif k == 2 and near == best[0] and not instance.between(length, *best):
                chosen = [length, *best]
            else:
                break
            instance.fix(chosen, instance.copies(chosen))


def best_fit(instance: _Instance) -> None:
    """Remaining pieces, long to short, each to the fullest sequence that takes it."""
    groups: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
    rooms: list[int] = []

    def add(room: int, first: int, bins: int) -> None:
        if not room or not bins:
            return
        if room not in groups:
            bisect.insort(rooms, room)
            groups[room] = []
        groups[room].append((first, bins))

    for length in sorted(instance.left, reverse=True):
        while count := instance.left.get(length, 0):
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = instance.capacity // length
                bins = max(1, count // each)
                each = min(each, count)
                first = instance.open(bins)
                instance.put(length, bins, each, first, 0)
                add(instance.capacity - each * length, first, bins)
                continue
            room = rooms[at]
            first, bins = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            # the same sequence stays the fullest until it takes no more
            each = min(room // length, count)
            full = min(bins, count // each)
            instance.put(length, full, each, first, instance.capacity - room)
            add(room - each * length, first, full)
            add(room, first + full, bins - full)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int, int]:
    """Placements of all pieces, the number of sequences, and how many of these the reduction fixed."""
    instance = _Instance(histogram, capacity)
    reduce(instance)
    fixed = instance.bins
    best_fit(instance)
    return instance.placements, instance.bins, fixed


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


#: The pattern that byte-level tokenizers cut a text with before merging (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of whole texts by the tokenizer in a file.

    If that is a plain byte-level one whose merges are numbered in their order, tiktoken gives the same
    ids from the same merges in a fraction of the time. It is asked for characters up to U+024F, whose classes all
    versions of Unicode share. Such a tokenizer cuts a text before each space that an ASCII letter, digit or
    sign follows, so texts with other characters are cut there, and the tokenizer itself encodes the
    stretches that hold them, equal ones once. A text with a special token of the file is encoded by it whole.
    """

    #: Stretches kept, and characters of the longest of them.
    KEPT, LONGEST = 1 << 17, 64

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast(json.loads(self.tokenizer.to_str()))
        self.other = re.compile("[^\x00-\u024f]").search
        self.cut = re.compile("(?= [!-~])").split
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _fast(file: dict):
        """The same merges for tiktoken, or None if the file is not as described."""
        import tiktoken

        model, before = file["model"], file["pre_tokenizer"] or {}
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback") if model.get(k)]
        if model.get("type") != "BPE" or file["normalizer"] or odd or {k: before.get(k) for k in plain} != plain:
            return None
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        vocab = model["vocab"]
        if len(vocab) != 256 + len(merged) or any(vocab.get(m) != 256 + i for i, m in enumerate(merged)):
            return None
        # the file writes bytes as characters: visible ones as themselves, the others from U+0100 on
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
        ranks = {bytes(byte[c] for c in token): n for token, n in vocab.items()}
        return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def fresh(self, parts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if self.fast is None or any(token in text for token in self.special):
            return self.fresh([text])[0]
        if not self.other(text):
            return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
        out = []
        for odd, group in itertools.groupby(self.cut(text), lambda part: bool(self.other(part))):
            if not odd:
                out.append(self.fast.encode_to_numpy("".join(group)).astype("<u4", copy=False).tobytes())
                continue
            parts = list(group)
            if len(self.known) > self.KEPT:
                self.known.clear()
            new = list({p for p in parts if p not in self.known})
            own = dict(zip(new, self.fresh(new)))
            self.known.update((p, ids) for p, ids in own.items() if len(p) <= self.LONGEST)
            out += [own[p] if p in own else self.known[p] for p in parts]
        return b"".join(out)


def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, kept at the tokenizers' module, as this one travels with each task."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_waveplan_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _pieces(path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                tokens = encode(text.as_py() or "") + end
                n = len(tokens) // 4
                edges = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    for column, value in zip(out, (doc_id, piece, a, b - a, zlib.crc32(tokens[4 * a : 4 * b]))):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document; ``tokenizer`` is the path of a file of the tokenizers library."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_pieces(tokenizer or vocabulary(), capacity, end_id), _PIECE)


def _place(placements: list[Placement]):
    """Sequence and offset of pieces by length and rank."""
    order = sorted(placements, key=lambda p: (p.length, p.rank))
    length, rank, bins, each, first, offset = (np.array([getattr(p, c) for p in order], np.int64) for c in Placement.__dataclass_fields__)

    def find(own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.searchsorted(length, own, "left")
        high = np.searchsorted(length, own, "right")
        # last placement of the length that starts at the rank or before
        at = np.empty(len(own), np.int64)
        for n in np.unique(own):
            mine = np.flatnonzero(own == n)
            a, b = low[mine[0]], high[mine[0]]
            at[mine] = a + np.searchsorted(rank[a:b], place[mine], "right") - 1
        number, behind = np.divmod(place - rank[at], each[at])
        return first[at] + number, offset[at] + behind * own

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, where = find(batch["length"].to_numpy(), batch["rank"].to_numpy())
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(where)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return placed


def ranked(found: DataFrame, cell: int = CELL) -> DataFrame:
    """Pieces with their rank among those of their length. A length that holds a third of all
    pieces is dealt to cells of about ``cell`` pieces; cells are numbered, then pieces in cells."""
    # a row a length, ``capacity`` at most: a table, as an expression with a branch for each outgrows the driver's stack
    cells = found.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / cell).alias("cells"))
    dealt = found.join(F.broadcast(cells), "length")
    dealt = dealt.select(*found.columns, F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "cells").alias("cell"))
    sizes = dealt.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("length", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "start", "ids_crc32"))
    return dealt.join(offsets, ["length", "cell"]).withColumn("rank", F.col("before") + inside - 1)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, cell: int = CELL) -> DataFrame:
    """Every piece with its sequence and its place there."""
    run = Run(docs.sparkSession, "bestfit")
    found = run.keep(pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most ``capacity`` rows
    placements, _, _ = plan(histogram, capacity)
    schema = f"{_PIECE}, sequence_id long, offset long"
    if not placements:
        return found.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    rows = ranked(found, cell).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return rows.mapInArrow(_place(placements), schema)


def op12_bestfit(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
