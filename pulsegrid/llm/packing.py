"""Best-fit decreasing of documents into sequences of a fixed number of tokens.

Pieces of equal length are interchangeable, so best fit needs no more than how many there are of each length: a histogram of at
most `capacity` rows. A segment tree over the capacities that open bins have left finds the tightest one that a length fits in
logarithmic time; all pieces of the length that go to bins of that capacity are placed at once, just as they would be one by one
(`best_fit`). What comes out are steps: the pieces of a length from this rank on go to the bins from that number on. Pieces get
exact ranks within their length without a shuffle (a count in their own task, after those of the tasks before), and look up
their step.
"""

from __future__ import annotations

from array import array
from collections import defaultdict, deque
from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle, slices
from pulsegrid.llm.token_files import END, Encoder

CAPACITY = 2048
#: Characters up to here (Latin letters) that are lower-case stay what they are when a text is normalised.
LATIN = 0x250
#: Characters and documents that a task encodes together.
CHARS, DOCS = 3_000_000, 2048
#: Fixed value: how the word vocabulary cuts a normalised text; white space is in no part.
WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder(Encoder):
    """Ids of texts by the tokenizers library, remembered for each run between blanks, newlines and the stops and commas after words.

    The vocabulary normalises character by character but for white space and for marks that join the character before (none
    joins a blank, stop or comma), no part holds white space, and a word ends before a stop or comma, so the runs can be encoded
    apart. It lower-cases, so A-Z are lower-cased first, but for texts in which that would make an added token. Words of lower-case
    Latin letters are parts as they stand and go to the library's merges at once, other words many at a time. A file made otherwise
    is left to the library as a whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        import json

        super().__init__(path, most)
        spec = json.loads(self.library.to_str())
        normal, split, model = spec["normalizer"] or {}, (spec["pre_tokenizer"] or {}).get("pretokenizers", []), spec["model"]
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in normal.get("normalizers", [])]
        self.plain = (
            steps != [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            or [(s["type"], s.get("pattern"), s.get("behavior"), s.get("invert"), s.get("add_prefix_space"), s.get("use_regex")) for s in split]
            != [("Split", {"Regex": WORD_PARTS}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]
            or model["type"] != "BPE"
            or model.get("end_of_word_suffix") != "</w>"
            or bool(model.get("dropout") or model.get("continuing_subword_prefix"))
            or any(t.lstrip or t.rstrip or t.single_word or t.normalized or any(map(str.isspace, t.content)) for t in self.library.get_added_tokens_decoder().values())
        )
        if not self.plain:
            self.library.model._resize_cache(0)  # the memo is the cache
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the vocabulary; others follow from 256 on
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.spelled = {i: "".join(letters[b] for b in chr(i).encode()) for i in range(LATIN)}

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        made, words, rest, tokenize = {}, [], [], self.library.model.tokenize
        for w in new:
            if not w.isalpha():
                rest.append(w)
            elif w.islower() and max(w) < chr(LATIN):
                made[w] = array("I", [t.id for t in tokenize(w if w.isascii() else w.translate(self.spelled))]).tobytes()
            else:
                words.append(w)
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            data = np.array(self.library.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[data]) + 1
            if len(stops) != len(some):  # a letter to Python but not to the vocabulary's pattern
                rest += some
                continue
            own, at = data.tobytes(), [0, *(4 * stops).tolist()]
            made.update((w, own[a:b]) for w, a, b in zip(some, at, at[1:], strict=False))
        made.update(zip(rest, self._library(rest), strict=True))
        return made

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        own = pa.array(texts, pa.large_string())
        lower = pc.ascii_lower(own)
        for name in self.names:
            if name == name.lower():
                lower = pc.if_else(pc.match_substring(lower, name), own, lower)
        cut = pc.replace_substring_regex(pc.replace_substring(lower, "\n", " "), r"([\pL\pN])([.,])", r"\1 \2")
        split = pc.split_pattern(cut, " ")
        return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)


@cache
def encoder(path: str) -> WordEncoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return WordEncoder(path)


class Capacities:
    """A segment tree over capacities 0 to `most`: how many bins of each are open, and of each half, quarter and so on."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, bins: int) -> None:
        i = capacity + self.size
        while i:
            self.open[i] += bins
            i >>= 1

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of `least` or more that an open bin has."""
        i = least + self.size
        if self.open[i]:
            return least
        while i > 1 and (i % 2 or not self.open[i + 1]):  # up, until something to the right is open
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.size:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first, pieces, each, bin, offset) of best-fit decreasing over `counts` pieces of each length.

    Of the length's pieces, `pieces` from rank `first` on go to bins numbered from `bin` on, `each` into one, from `offset` on.
    A bin that has just taken a piece is the tightest for the next of that length if that still fits, so a bin takes all that fit.
    """
    tree, bins, used, steps = Capacities(capacity), defaultdict(deque), 0, []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            bins[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, bin_ = capacity, used
                n = -(-left // (room // length))
                used += n
            else:
                bin_, n = bins[room].popleft()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                steps.append((length, rank, full * each, each, bin_, capacity - room))
                put(room - each * length, bin_, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than a bin takes
                steps.append((length, rank, left, left, bin_ + full, capacity - room))
                put(room - left * length, bin_ + full, 1)
                full, left = full + 1, 0
            put(room, bin_ + full, n - full)
    return steps


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(part, rank, key, piece, start, length, ids_crc32, with `ids` also ids) of every document: its ids and an end id, cut every `capacity`.

    A null text is an empty one and has the end id only. Repeated and null keys stay as they are. `rank` counts the pieces of
    equal length before this one in its task, whose number is `part`. There is no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for cols, texts in slices(batches, "text", CHARS, DOCS):
            flat, sizes = own.ids(texts)
            flat, sizes = np.insert(flat, np.cumsum(sizes), END).astype("<u4"), sizes + 1
            cuts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), cuts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            start = piece * capacity
            length = np.minimum(sizes[doc] - start, capacity)
            begin = (np.cumsum(sizes) - sizes)[doc] + start
            order = np.argsort(length, kind="stable")
            among = length[order]
            heads = np.flatnonzero(np.append(True, among[1:] != among[:-1])) if len(among) else np.empty(0, np.int64)
            rank = np.empty(len(doc), np.int64)
            rank[order] = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(among)))) + seen[among]
            np.add.at(seen, length, 1)
            view = memoryview(np.ascontiguousarray(flat)).cast("B")
            ends = begin + length
            out = {
                "part": pa.array(np.full(len(doc), part), pa.int32()),
                "rank": pa.array(rank),
                "key": cols["key"].take(pa.array(doc)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start),
                "length": pa.array(length),
                "ids_crc32": pa.array([crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.int64()),
            }
            if ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.append(begin, ends[-1:] if len(ends) else 0), pa.int32()), pa.array(flat.astype(np.int64)))
            yield pa.RecordBatch.from_pydict(out)

    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(run, f"part int, rank long, key {kind}, piece int, start long, length long, ids_crc32 long{', ids array<long>' if ids else ''}").withColumnRenamed("key", key)


def plan(lengths: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The steps of best_fit over rows (length, n), at most one a length, worked out by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        for b in batches:
            counts |= zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        steps = best_fit(counts, capacity)
        for i in range(0, len(steps), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*steps[i : i + 10_000], strict=True)], ["length", "first", "pieces", "each", "bin", "at"])

    return lengths.select("length", "n").coalesce(1).mapInArrow(run, "length long, first long, pieces long, each long, bin long, at long")


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32, with `ids` also ids, sequence_id, offset): every piece with its place in a sequence.

    Sequences are numbered from 0 and have no gaps; the numbers depend on how the input is split into tasks, the number of
    sequences does not. A length that a third of all pieces have is placed like any other: ranks are counted in each task, and
    a task's pieces of one length are what meets in the join. Null and empty texts are pieces of one id; repeated rows are
    packed as often as they occur; other columns of docs are left out; an empty table gives an empty result.
    """
    cut = settle(pieces(docs, tokenizer, key=key, text=text, capacity=capacity, ids=ids), "pieces")
    own = settle(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    based = own.withColumn("base", before)
    steps = settle(plan(own.groupBy("length").agg(F.sum("n").alias("n")), capacity), "steps").withColumnRenamed("length", "_length")
    met = based.join(steps, (F.col("length") == F.col("_length")) & (F.col("first") < F.col("base") + F.col("n")) & (F.col("first") + F.col("pieces") > F.col("base")))
    places = met.groupBy(F.col("part").alias("_part"), "_length").agg(F.first("base").alias("base"), F.sort_array(F.collect_list(F.struct("first", "pieces", "each", "bin", "at"))).alias("steps"))
    rank = F.col("base") + F.col("rank")
    found = cut.join(places, (F.col("part") == F.col("_part")) & (F.col("length") == F.col("_length"))).withColumn("_rank", rank)
    found = found.withColumn("_step", F.get(F.filter("steps", lambda s: (s.first <= F.col("_rank")) & (F.col("_rank") < s.first + s.pieces)), 0))
    nth = F.col("_rank") - F.col("_step.first")
    whole = [key, "piece", "start", "length", "ids_crc32", *["ids"] * ids]
    return found.select(*whole, (F.col("_step.bin") + F.floor(nth / F.col("_step.each"))).alias("sequence_id"), (F.col("_step.at") + nth % F.col("_step.each") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of what pack() with ids returns: each sequence's ids in order, at most `capacity` of them."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_parts"))
    return rows.select("sequence_id", F.flatten(F.transform("_parts", lambda p: p.ids)).alias("ids"))
