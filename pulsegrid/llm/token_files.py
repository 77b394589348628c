"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of a run of documents in blocks of 256: the block's minimum is subtracted, the differences are packed
at the width that at least nine tenths of them fit in, and those that don't are in the block's exception list. After the
blocks come the offset of each block, so that any id is found by one seek, and the documents' keys and first ids.

File: blocks, then the footer (block offsets: u64, keys: i64, key-is-null: u8, starts: u64), then at the end u64 ids, u64
blocks, u64 documents and the mark. Block: u32 minimum, u8 width, u8 exceptions, u16 ids, 4 * width words of 64 bits (id j of
each 64 at bit j * width of its group's words), positions of the exceptions (u8), their differences (u32). Little-endian.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import Recent, by_ranges, scratch, settle, slices

BLOCK, SHARE, MARK = 256, 0.9, b"PFORIDS1"
#: A file is closed once it has this many ids, so that a reader's memory is bounded (one long document may exceed it).
FILE_IDS = 4_000_000
END = 0


#: Fixed value: how a byte-level vocabulary cuts a text into parts that it encodes apart.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts with one of these are cut by PARTS: two white spaces in a row, a stop or comma that doesn't follow a letter or digit,
#: and any control character or white space but the blank and the newline.
ODD = r"[ \n][ \n]|[^\p{L}\p{N}][.,]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}]|[\p{Zl}\p{Zp}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]"
GATHER = 500_000


class Encoder:
    """Ids of texts by the tokenizers library, remembered for each piece of a text: of those met once and of those met again a bounded number each.

    A text that is not ODD is cut before each blank, stop and comma and around each newline, since a part always begins there;
    an odd one into its parts. Arrow cuts the texts of a slice together and tells pieces that are equal. A piece is encoded as a
    text for itself, parts that are words many at a time. The vocabulary's added tokens are taken out of a text before that:
    each is a piece of its own. A file with another normaliser, splitting or model is used as it is, text by text.
    """

    def __init__(self, path: str, most: int = 500_000):
        import regex
        from tokenizers import Tokenizer

        self.library, self.parts, self.memo = Tokenizer.from_file(path), regex.compile(PARTS).findall, Recent(most)
        spec = json.loads(self.library.to_str())
        split, model = spec["pre_tokenizer"] or {}, spec["model"]
        added = self.library.get_added_tokens_decoder().values()
        self.plain = (
            spec["normalizer"] is not None
            or (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) != ("ByteLevel", False, True)
            or model["type"] != "BPE"
            or bool(model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"))
            or any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added)
        )
        if not self.plain:
            self.library.model._resize_cache(0)  # the memo is the cache
        vocabulary = self.library.get_vocab()
        self.newline, self.begins = vocabulary.get("\u010a", -1), np.zeros(1 + max(vocabulary.values(), default=0), bool)  # newline and blank as letters
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        self.names = sorted((t.content for t in added), key=len, reverse=True)
        self.added = re.compile(f"({'|'.join(map(re.escape, self.names))})") if self.names else None

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        spaced, bare, odd = [], [], []
        for p in new:
            (odd if not p.removeprefix(" ").isalpha() else spaced if p[0] == " " else bare).append(p)
        split = {p: [p] if self.added and self.added.fullmatch(p) else self.parts(p) for p in odd}
        parts = {p: self.memo.find(p) for p in set(chain.from_iterable(split.values())).difference(bare, spaced)}
        made = {p: x for p, x in parts.items() if x is not None}
        rest = []
        for p in parts.keys() - made.keys():
            (rest if p in split or not p.removeprefix(" ").isalpha() else spaced if p[0] == " " else bare).append(p)
        for some, between in ((spaced, ""), (bare, "\n")):
            if not self._together(some, between, made):
                rest += some
        made.update(zip(rest, self._library(rest), strict=True))
        made.update([(p, b"".join(map(made.__getitem__, own))) for p, own in split.items()])
        return made

    def _together(self, words: list[str], between: str, made: dict[str, bytes]) -> bool:
        """Encode many words as a few texts, which costs less than each for itself. False if not every word is found again.

        Words without a blank are put on lines, and a newline is a token for itself; others begin at the tokens that begin with a blank.
        """
        runs = [words[i : i + 4096] for i in range(0, len(words), 4096)]
        for some, e in zip(runs, self.library.encode_batch_fast(list(map(between.join, runs)), add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            if between:
                gaps = np.flatnonzero(ids == self.newline)
                starts, ends = np.append(0, gaps + 1), np.append(gaps, len(ids))
            else:
                starts = np.flatnonzero(self.begins[ids])
                ends = np.append(starts[1:], len(ids))
            if len(starts) != len(some):
                return False
            data = ids.tobytes()
            made.update((w, data[a:b]) for w, a, b in zip(some, (starts * 4).tolist(), (ends * 4).tolist(), strict=True))
        return True

    def _odd_pieces(self, text: str) -> list[str]:
        apart = self.added.split(text) if self.added else [text]
        return self.parts(text) if len(apart) == 1 else [p for i, t in enumerate(apart) for p in ([t] if i % 2 else self.parts(t))]

    def _pieces(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pieces of the texts, one text after the other, and how many each text has."""
        own = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(own, ODD)
        for name in self.names:
            odd = pc.or_(odd, pc.match_substring(own, name))
        cut = own
        for mark, by in ((" ", "\0 "), (".", "\0."), (",", "\0,"), ("\n", "\0\n\0")):
            cut = pc.replace_substring(cut, mark, by)
        split = pc.split_pattern(cut, "\0")
        if not (at := np.flatnonzero(odd.to_numpy(zero_copy_only=False))).size:
            return split.flatten(), pc.list_value_length(split).to_numpy(zero_copy_only=False)
        runs: list[pa.Array] = []
        last = 0
        for i in at.tolist():
            runs += [split.slice(last, i - last), pa.array([self._odd_pieces(texts[i])], split.type)]
            last = i + 1
        whole = pa.concat_arrays([*runs, split.slice(last)])
        return whole.flatten(), pc.list_value_length(whole).to_numpy(zero_copy_only=False)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each text has."""
        if self.plain:
            made = self._library(texts)
            return np.frombuffer(b"".join(made), "<u4"), np.array([len(x) // 4 for x in made], np.int64)
        pieces, n = self._pieces(texts)
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        own = self.memo.seek(names, self._learn)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        flat, start = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        which, parts = coded.indices.to_numpy(zero_copy_only=False), []
        for i in range(0, len(which), GATHER):
            some = which[i : i + GATHER]
            s = size[some]
            parts.append(flat[np.repeat(start[some] - (np.cumsum(s) - s), s) + np.arange(s.sum())])
        upto = np.append(0, np.cumsum(size[which]))
        ends = np.cumsum(n)
        return np.concatenate([np.empty(0, np.uint32), *parts]), upto[ends] - upto[ends - n]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        ids, sizes = self.ids(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(texts) else []


@cache
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


def packed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of ids (uint32), one after the other (uint8), and where each begins and the last ends; all but the last are full."""
    n = len(ids)
    full = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    padded = np.full(full * BLOCK, ids[-1], np.uint32)
    padded[:n] = ids
    values = padded.reshape(full, BLOCK)
    least = values.min(axis=1)
    diff = values - least[:, None]
    lengths = np.zeros(diff.shape, np.uint8)
    for bit in range(int(diff.max()).bit_length()):
        lengths += diff >= np.uint32(1 << bit)
    at = int(np.ceil(SHARE * BLOCK)) - 1
    width = np.partition(lengths, at, axis=1)[:, at].astype(int)
    width = np.maximum(width, np.where((lengths > width[:, None]).sum(axis=1) > 255, 32, 0))
    block, place = np.nonzero(lengths > width[:, None])
    odd = np.bincount(block, minlength=full)
    starts = np.append(0, np.cumsum(8 + 32 * width + 5 * odd))
    head = np.zeros((full, 8), np.uint8)
    head[:, :4] = least.astype("<u4").view(np.uint8).reshape(full, 4)
    head[:, 4], head[:, 5] = width, odd
    head[:, 6:] = np.where(np.arange(full) < full - 1, BLOCK, n - BLOCK * (full - 1)).astype("<u2").view(np.uint8).reshape(full, 2)
    out = np.empty(starts[-1], np.uint8)
    out[starts[:-1, None] + np.arange(8)] = head
    low = diff.copy()
    low[block, place] = 0
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        groups = low[own].reshape(-1, 64).T.astype(np.uint64)  # id j of each group of 64 in row j
        words = np.zeros((w, groups.shape[1]), np.uint64)
        for j in range(64):
            at, shift = divmod(j * w, 64)
            words[at] |= groups[j] << np.uint64(shift)
            if shift + w > 64:
                words[at + 1] |= groups[j] >> np.uint64(64 - shift)
        out[(starts[own] + 8)[:, None] + np.arange(32 * w)] = np.ascontiguousarray(words.T, "<u8").view(np.uint8).reshape(len(own), 32 * w)
    begin = (starts[:-1] + 8 + 32 * width)[block]
    nth = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
    out[begin + nth] = place
    out[(begin + odd[block] + 4 * nth)[:, None] + np.arange(4)] = diff[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, starts


def pack(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids (uint32); all but the last are full."""
    data, starts = packed(ids)
    return [data[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


def unpack(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at `starts` of data (uint8)."""
    if not len(starts):
        return np.empty(0, np.uint32)
    head = data[starts[:, None] + np.arange(8)]
    least, width, odd = head[:, :4].copy().view("<u4")[:, 0], head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    count = head[:, 6:8].copy().view("<u2")[:, 0].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint32)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        if w:
            words = data[(starts[own] + 8)[:, None] + np.arange(32 * w)].copy().view("<u8").reshape(len(own), 4, w)
            mask, groups = np.uint64((1 << int(w)) - 1), np.empty((len(own), 4, 64), np.uint32)
            for j in range(64):
                at, shift = divmod(j * int(w), 64)
                x = words[:, :, at] >> np.uint64(shift)
                if shift + w > 64:
                    x = x | (words[:, :, at + 1] << np.uint64(64 - shift))
                groups[:, :, j] = x & mask
            out[own] = groups.reshape(len(own), BLOCK)
    if odd.any():
        block = np.repeat(np.arange(len(starts)), odd)
        nth = np.arange(len(block)) - np.repeat(np.cumsum(odd) - odd, odd)
        begin = starts + 8 + 32 * width
        place = data[begin[block] + nth]
        out[block, place] = data[(begin[block] + odd[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    out += least[:, None]
    return out[np.arange(BLOCK) < count[:, None]]


class Writer:
    """One file. Keys are integers or None."""

    def __init__(self, path: str):
        fs, name = FileSystem.from_uri(path)
        self.file, self.at, self.rest = fs.open_output_stream(name), 0, np.empty(0, np.uint32)
        self.offsets: list[int] = []
        self.keys: list[int | None] = []
        self.starts: list[int] = []
        self.ids = 0

    def add(self, keys: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Documents of these keys and sizes, whose ids follow one another."""
        self.keys += keys
        self.starts += (self.ids + np.cumsum(sizes) - sizes).tolist()
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        self._put(ids[:whole])
        self.rest = ids[whole:]

    def _put(self, ids: np.ndarray) -> None:
        for i in range(0, len(ids), BLOCK * 2048):
            data, starts = packed(ids[i : i + BLOCK * 2048])
            self.offsets += (self.at + starts[:-1]).tolist()
            self.file.write(data)
            self.at += len(data)

    def close(self) -> None:
        self._put(self.rest)
        null = np.array([k is None for k in self.keys], np.uint8)
        parts = (np.array(self.offsets, "<u8"), np.array([k or 0 for k in self.keys], "<i8"), null, np.array(self.starts, "<u8"), np.array([self.ids, len(self.offsets), len(self.keys)], "<u8"))
        for p in parts:
            self.file.write(p.tobytes())
        self.file.write(MARK)
        self.file.close()


def read_file(path: str) -> tuple[list, np.ndarray, np.ndarray]:
    """(keys, starts, ids) of a file; starts has the number of ids after the last."""
    fs, name = FileSystem.from_uri(path)
    with fs.open_input_file(name) as f:
        data = np.frombuffer(f.read(), np.uint8)
    if data[-8:].tobytes() != MARK:
        raise ValueError(f"{path} is not whole")
    n, blocks, docs = (int(x) for x in data[-32:-8].copy().view("<u8"))
    at = len(data) - 32 - 17 * docs - 8 * blocks
    offsets, at = data[at : at + 8 * blocks].copy().view("<i8"), at + 8 * blocks
    keys, at = data[at : at + 8 * docs].copy().view("<i8").tolist(), at + 8 * docs
    null, at = data[at : at + docs], at + docs
    starts = np.append(data[at : at + 8 * docs].copy().view("<i8"), n)
    return [None if z else k for k, z in zip(keys, null, strict=True)], starts, unpack(data, offsets)


def write(docs: DataFrame, folder: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, with id 0 after each, into files of `folder` in ascending key order; the manifest (pid, seq, file, docs, ids).

    `folder` is a URI that driver and executors share. Documents are dealt by ranges of the key and sorted by key, hash of the
    text, text (a null key first, a null text as an empty one); a key of very many rows has several ranges. A task that is run
    again writes files of other names; only files of the manifest, which Spark commits, count. An empty table has no files.
    """
    own = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows, n = by_ranges(own, "key", "hash")
    dealt = rows.repartitionById(n, F.col("_pid")).sortWithinPartitions("_pid", F.asc_nulls_first("key"), "hash", "text").drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        out, seq, at, pid = None, 0, "", 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [at], "docs": pa.array([len(out.keys)], pa.int64()), "ids": pa.array([out.ids], pa.int64())})

        for cols, texts in slices(batches, "text", together=512):
            if out is not None and out.ids >= file_ids:
                yield done()
                out, seq = None, seq + 1
            if out is None:
                pid = cols["_pid"][0].as_py()
                at = f"{folder}/ids-{pid:05d}-{seq:05d}-{uuid.uuid4().hex}.pfor"
                out = Writer(at)
            ids, sizes = own.ids(texts)
            out.add(cols["key"].to_pylist(), np.insert(ids, np.cumsum(sizes), END), sizes + 1)
        if out is not None:
            yield done()

    return settle(dealt.mapInArrow(run, "pid int, seq int, file string, docs long, ids long"), "manifest")


def read(manifest: DataFrame, *, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32), with `ids` also the ids, of every document, read from the files of the manifest.

    `start` counts the ids of all documents before: those of the ranges before, summed by range first, and of the range's files before.
    """
    ranges = manifest.groupBy("pid").agg(F.sum("ids").alias("_n"))  # a row for each range
    before = ranges.select(F.col("pid").alias("_pid"), (F.sum("_n").over(Window.orderBy("pid")) - F.col("_n")).alias("_before"))
    upto = F.sum("ids").over(Window.partitionBy("pid").orderBy("seq"))
    numbered = manifest.withColumn("_upto", upto).join(before, F.col("pid") == F.col("_pid"))
    files = numbered.select("file", (F.col("_before") + F.col("_upto") - F.col("ids")).alias("base"))
    listed = files.repartition(max(1, min(manifest.count(), 4096)), "file")
    more = ", ids array<long>" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, starts, all_ids = read_file(file)
                view = memoryview(np.ascontiguousarray(all_ids, "<u4")).cast("B")
                for i in range(0, len(keys), 2048):
                    s = starts[i : i + 2049]
                    out = {key: pa.array(keys[i : i + 2048], pa.int64()), "start": pa.array(s[:-1] + first, pa.int64()), "n_tokens": pa.array(np.diff(s), pa.int64()), "ids_crc32": pa.array([crc32(view[4 * a : 4 * b]) for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)], pa.int64())}
                    if ids:
                        out["ids"] = pa.array([all_ids[a:b].astype(np.int64) for a, b in zip(s[:-1], s[1:], strict=True)], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(out)

    return listed.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long{more}")


def folder(spark: SparkSession) -> str:
    """A new folder for files, beside the session's checkpoints, as a URI."""
    path = scratch(spark, "token-files")
    uri = path if "://" in path or path.startswith("file:") else f"file://{path}"
    if uri.startswith("file:"):
        fs, name = FileSystem.from_uri(uri)
        fs.create_dir(name, recursive=True)
    return uri
