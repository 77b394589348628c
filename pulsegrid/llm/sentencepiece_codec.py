"""SentencePiece encoding and decoding of whole texts.

A merge-type vocabulary is applied with an agenda of adjacent symbol pairs: the pair whose merged
piece scores highest (the leftmost among equals) is merged first, until no adjacent pair is a piece.
No piece of such a vocabulary has a word mark after another character, so a text may be cut before
each word mark and around characters that are in no piece; the parts are encoded apart and memoised.
Each part that is new is also encoded by the sentencepiece library; of a document with
a part where the two differ the library's ids are used and the document's `agrees` is false.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import Recent, slices

MARK = "▁"
MEMO = 400_000
SHORT, NEVER = 48, float("inf")


class MergeCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.library.serialized_model_proto())
        rules, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != 2 or rules.precompiled_charsmap or not rules.add_dummy_prefix or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback, a leading mark and no other normalisation are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.order = {p: -model.pieces[i].score for p, i in self.ids.items()}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        cuts = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.parts = re.compile(f"{MARK}+[^{MARK}]*" if cuts else "(?s:.+)")
        #: White space that is in no piece of two characters or more can't be merged with anything.
        self.lone_newline = cuts and not any("\n" in p and len(p) > 1 for p in self.ids)
        #: Two characters that follow one another in some piece; no merge crosses other places.
        self.joints = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.memo = Recent(MEMO)
        #: Words with a part of which the library has other ids.
        self.differ: set[str] = set()

    def merge(self, part: str) -> list[int]:
        """The ids of `part`, in which spaces are marks already, by the agenda alone."""
        out: list[int] = []
        for s in self._short(part) if len(part) <= SHORT else self._long(part):
            i = self.ids.get(s)
            out += [i] if i is not None else [self.bytes[b] for b in s.encode()]
        return out

    def _short(self, part: str) -> list[str]:
        """The agenda as a plain list with an entry for each adjacent pair: for short parts faster than a heap."""
        order, symbols = self.order.get, list(part)
        agenda = [order(a + b, NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) != NEVER:
            i = agenda.index(best)
            symbols[i] = merged = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = order(symbols[i - 1] + merged, NEVER)
            if i < len(agenda):
                agenda[i] = order(merged + symbols[i + 1], NEVER)
        return symbols

    def _long(self, part: str) -> list[str]:
        order, n = self.order, len(part)
        symbols, after, before = list(part), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(order[pair], i, i + 1, pair) for i in range(n - 1) if (pair := part[i : i + 2]) in order]
        heapify(agenda)
        while agenda:
            _, left, right, merged = heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != merged:
                continue  # one of the two has been merged meanwhile
            symbols[left], symbols[right] = merged, ""
            after[left] = following = after[right]
            if following < n:
                before[following] = left
                if (pair := merged + symbols[following]) in order:
                    heappush(agenda, (order[pair], left, following, pair))
            if (previous := before[left]) >= 0 and (pair := symbols[previous] + merged) in order:
                heappush(agenda, (order[pair], previous, left, pair))
        return [s for s in symbols if s]

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of new words. A word's last character stands alone if no piece has it after the character before."""
        split, parts = {}, {}
        for w in words:
            whole = w if w[:1] in ("\n", MARK) and w else MARK + w
            lone = len(whole) > 2 and whole[-2:] not in self.joints
            split[w] = whole[:-1] if lone else whole, whole[-1] if lone else ""
        for w, (part, lone) in split.items():
            if part not in parts and (not lone or (known := self.memo.find(w[:-1])) is None):
                parts[part] = None
            elif part not in parts:
                parts[part] = known
        new = [p for p, x in parts.items() if x is None]
        for p in new:
            parts[p] = array("I", self.merge(p)).tobytes()
        odd = self._differing({p: parts[p] for p in new if p != MARK})  # the library leaves out a mark that stands alone
        self.differ.update(w for w, (part, lone) in split.items() if part in odd or lone and w[:-1] in self.differ)
        return {w: parts[part] + array("I", self.merge(lone)).tobytes() for w, (part, lone) in split.items()}

    def _differing(self, merged: dict[str, bytes]) -> set[str]:
        """The parts of which the library has other ids."""
        found = self.library.encode([p[1:] if p[0] == MARK else p for p in merged], num_threads=1)
        return {p for (p, own), ids in zip(merged.items(), found, strict=True) if own != array("I", ids[1:] if p[0] == "\n" else ids).tobytes()}  # a mark before the newline is not merged with it

    def words(self, text: str) -> list[str]:
        """text cut into parts: words (their mark left out), parts that begin with marks, and such that begin with a newline."""
        if MARK in text or "  " in text or text[0] == " " or text[-1] == " " or "\n " in text or " \n" in text or not self.lone_newline:
            return self.parts.findall(MARK + text.replace(" ", MARK))
        if text[0] == "\n":
            return [MARK, *text.replace("\n", " \n")[1:].split(" ")]
        return text.replace("\n", " \n").split(" ")

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Of each text its ids as little-endian 32-bit integers, with begin and end, and whether the library agrees."""
        first, last = array("I", [self.begin]).tobytes(), array("I", [self.end]).tobytes()
        if len(self.differ) > MEMO:  # kept as long as the words
            self.differ.clear(), self.memo.forget()
        cut = [self.words(t) if t else () for t in texts]
        names = list(set().union(*cut))
        get = dict(zip(names, self.memo.seek(names, self._learn), strict=True)).__getitem__
        out = [b"".join(chain((first,), map(get, words), (last,))) for words in cut]
        if not self.differ:
            return [(x, True) for x in out]
        differ = [not self.differ.isdisjoint(words) for words in cut]
        return [(array("I", self.library.encode(t, add_bos=True, add_eos=True)).tobytes() if d else x, not d) for t, x, d in zip(texts, out, differ, strict=True)]

    def decode(self, encoded: list[bytes]) -> list[str]:
        """The library's decode(ids) of each; begin and end leave nothing."""
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in encoded], num_threads=1)


@cache
def codec(path: str) -> MergeCodec:
    """One for each Python worker, whose memo outlasts a task."""
    return MergeCodec(path)


def encode(docs: DataFrame, model: str, *, ids: bool = True, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, n_tokens, ids_sha256, decoded_sha256, agrees; with `ids`, also ids (array) and decoded.

    A null or empty text has the begin and end ids only and decodes to an empty text. A null key stays null; repeated
    rows give repeated results; other columns are left out. An empty table gives an empty result. There is no shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<int>, decoded string" if ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for rows, texts in slices(batches, "text"):
            encoded, agrees = zip(*own.encode(texts), strict=True)
            decoded = own.decode(list(encoded))
            out = {
                key: rows["key"],
                "n_tokens": pa.array([len(x) // 4 for x in encoded], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                "agrees": pa.array(agrees, pa.bool_()),
            }
            if ids:
                out |= {"ids": pa.array([np.frombuffer(x, "<i4") for x in encoded], pa.list_(pa.int32())), "decoded": pa.array(decoded)}
            yield pa.RecordBatch.from_pydict(out)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean{more}")
