"""Secret scans by grammar inference.

Base patterns find labelled credentials. The values of each kind are written as symbols, and from these a prefix tree with
counts is built, whose states are merged where their outgoing frequencies, and those of all states below, are statistically
compatible (Hoeffding bounds), as in the ALERGIA algorithm; the result is a probabilistic automaton of that kind's format.
Every other run of credential characters is then scored: the log-likelihood of its symbols and characters in the best
automaton against that of its characters in running text, by the pairs of characters of all documents.

Symbols: `_`, `-`, `.` and `=` stand for themselves and cut a value into fields. All characters of a field have one symbol, for
the smallest set of characters that holds the field, so that a random value follows few paths of the tree and its length, its
separators and the sets of its fields are learned. Which characters of a set a state has seen is counted besides.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log, sqrt
from string import ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Credentials have so many characters at least.
LEAST = 12
#: An automaton learns from at most this many values of a kind, those of the smallest hashes, of values of at most this length.
MOST_VALUES, LONGEST = 500, 1024
CONFIDENCE, MARGIN, RUN = 0.05, 0.5, 16
#: Strength of the prior of pairs of characters, and of characters in a state.
PRIOR, CHAR_PRIOR = 50.0, 0.2
LETTERS = ascii_lowercase + ascii_uppercase + digits + "+/_.=-"
#: Symbols of fields and their characters, the smaller sets first.
SETS = {"0": digits, "x": digits + "abcdef", "X": digits + "ABCDEF", "a": ascii_lowercase, "A": ascii_uppercase, "l": ascii_lowercase + digits, "U": ascii_uppercase + digits, "w": ascii_lowercase + ascii_uppercase + digits, "b": ascii_lowercase + ascii_uppercase + digits + "+/"}
_SETS = {c: frozenset(x) for c, x in SETS.items()}
_FIELD = re.compile(r"[^_.=-]+")
_HEX = bytes(1 if chr(i) in digits + "abcdef" else 0 for i in range(256))
_PLACE = bytes(1 + LETTERS.index(chr(i)) if chr(i) in LETTERS else 0 for i in range(256))


def symbols(value: str) -> str:
    """One symbol a character."""

    def one(m: re.Match) -> str:
        own = set(m[0])
        return next(c for c, x in _SETS.items() if own <= x) * len(m[0])

    return _FIELD.sub(one, value)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, in order."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"\1" * RUN in text.encode("latin-1", "replace").translate(_HEX):
        spans += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(spans)


def places(text: str, spans: list[tuple[int, int, int, str]]) -> np.ndarray:
    """Each character's place in LETTERS, from 1; 0 for others and inside base spans."""
    out = np.frombuffer(text.encode("latin-1", "replace").translate(_PLACE), np.uint8).copy()
    for start, _, end, _ in spans:
        out[start:end] = 0
    return out


def candidates(text: str, own: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, value) of all runs of LEAST characters or more that have a place; stops around a run are not part of it."""
    edges = np.flatnonzero(np.diff((own > 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    out, far = [], ends - starts >= LEAST
    for a, b in zip(starts[far].tolist(), ends[far].tolist(), strict=True):
        value = text[a:b].rstrip(".")
        start = b - len(text[a:b].lstrip("."))
        value = value.lstrip(".")
        if len(value) >= LEAST:
            out.append((start, start + len(value), value))
    return out


@dataclass
class State:
    total: int = 0
    ends: int = 0
    counts: dict[str, int] = field(default_factory=dict)
    to: dict[str, int] = field(default_factory=dict)
    chars: dict[str, int] = field(default_factory=dict)


def prefix_tree(values: Iterable[str]) -> list[State]:
    states = [State()]
    for value in values:
        at = 0
        for c, own in zip(symbols(value), value, strict=True):
            s = states[at]
            s.total += 1
            s.counts[c] = s.counts.get(c, 0) + 1
            s.chars[c + own] = s.chars.get(c + own, 0) + 1
            if c not in s.to:
                s.to[c] = len(states)
                states.append(State())
            at = s.to[c]
        states[at].total += 1
        states[at].ends += 1
    return states


def infer(values: Iterable[str], confidence: float = CONFIDENCE) -> list[State]:
    """The automaton of the values: states of the prefix tree merged, red-blue order, where they are compatible."""
    s = prefix_tree(values)
    bound = sqrt(0.5 * log(2 / confidence))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (1 / sqrt(n1) + 1 / sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            x, y = (s[i] for i in waiting.pop())
            if differ(x.ends, x.total, y.ends, y.total):
                return False
            for c in x.counts.keys() | y.counts.keys():
                if differ(x.counts.get(c, 0), x.total, y.counts.get(c, 0), y.total):
                    return False
                if c in x.to and c in y.to:
                    waiting.append((x.to[c], y.to[c]))
        return True

    def fold_in(a: int, b: int) -> None:
        waiting = [(a, b)]
        while waiting:
            i, j = waiting.pop()
            x, y = s[i], s[j]
            x.total, x.ends = x.total + y.total, x.ends + y.ends
            for own, more in ((x.counts, y.counts), (x.chars, y.chars)):
                for c, n in more.items():
                    own[c] = own.get(c, 0) + n
            for c, k in y.to.items():
                if c in x.to:
                    waiting.append((x.to[c], k))
                else:
                    x.to[c] = k

    red = [0]
    while blue := sorted((s[r].to[c], r, c) for r in red for c in s[r].to if s[r].to[c] not in red):  # any red state may have new children after a merge
        b, parent, c = blue[0]
        for r in red:
            if compatible(r, b):
                s[parent].to[c] = r
                fold_in(r, b)
                break
        else:
            red.append(b)
    return s


def log_likelihood(states: list[State], value: str) -> float:
    """ln of the value's probability; unseen symbols have a small one."""
    at, sum_ = 0, 0.0
    for c, own in zip(symbols(value), value, strict=True):
        s = states[at]
        n = s.counts.get(c, 0)
        sum_ += log((n + 0.01) / (s.total + 1))
        if c in SETS:
            sum_ += log((s.chars.get(c + own, 0) + CHAR_PRIOR) / (n + CHAR_PRIOR * len(SETS[c])))
        at = s.to.get(c, 0)
    s = states[at]
    return sum_ + log((s.ends + 0.01) / (s.total + 1))


def pairs_of(own: list[np.ndarray]) -> np.ndarray:
    """How often each place follows each, in a table as one row."""
    n, end = len(LETTERS) + 1, np.zeros(1, np.uint8)
    x = np.concatenate([end, *(y for o in own for y in (o, end))]).astype(np.int32)
    return np.bincount(x[:-1] * n + x[1:], minlength=n * n)


def background(counts: np.ndarray) -> np.ndarray:
    """ln of the probability of each character after each, from counts of pairs and a uniform prior."""
    n = len(LETTERS) + 1
    table = counts.reshape(n, n).astype(float)
    return np.log((table + PRIOR / n) / (table.sum(1, keepdims=True) + PRIOR))


def format_score(automata: dict[int, list[State]], pairs: np.ndarray, value: str) -> float:
    """How much likelier, per character, the value is in the best automaton than in running text."""
    x = np.frombuffer(b"\0" + value.encode("latin-1").translate(_PLACE) + b"\0", np.uint8)
    return (max((log_likelihood(a, value) for a in automata.values()), default=-1e9) - float(pairs[x[:-1], x[1:]].sum())) / (len(value) + 1)


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans array<struct<start, stop, kind, value>>, tokens: all other candidates in the same form, pairs) of every row.

    `pairs` (array<struct<cell, n>>) has the pairs of characters of a run of rows at the first of them; it is null at the others. Whole texts are scanned; a null text is empty. Null and repeated keys stay; other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    item = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.int32()), ("value", pa.string())]))
    pair = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, "text", together=512):
            found = [base_spans(t) for t in texts]
            own = [places(t, f) for t, f in zip(texts, found, strict=True)]
            n = pairs_of(own)
            cells = [[{"cell": c, "n": x} for c, x in zip(np.flatnonzero(n).tolist(), n[n > 0].tolist(), strict=True)], *[None] * (len(texts) - 1)]
            spans = [[{"start": a, "stop": b, "kind": k, "value": v} for a, k, b, v in f] for f in found]
            tokens = [[{"start": a, "stop": b, "kind": len(KINDS), "value": v} for a, b, v in candidates(t, o)] for t, o in zip(texts, own, strict=True)]
            yield pa.RecordBatch.from_pydict({key: rows["key"], "spans": pa.array(spans, item), "tokens": pa.array(tokens, item), "pairs": pa.array(cells, pair)})

    entry = "array<struct<start:long,stop:long,kind:int,value:string>>"
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, spans {entry}, tokens {entry}, pairs array<struct<cell:int,n:long>>")


def learn(scanned: DataFrame, most: int = MOST_VALUES) -> dict[int, list[State]]:
    """An automaton for each kind, from a bounded number of distinct labelled values."""
    values = scanned.select(F.explode("spans").alias("s")).select("s.kind", "s.value").where(F.length("value") <= LONGEST).distinct()
    place = F.shiftrightunsigned(F.xxhash64("value"), 1)
    share = {r["kind"]: r["count"] for r in values.groupBy("kind").count().collect()}  # a row for each of the three kinds
    few = F.lit(False)
    for kind, n in share.items():  # of n values about twice as many as are needed
        few = few | ((F.col("kind") == kind) & (place < min(2**63 - 1, 2**63 * (2 * most + 50) // n)))
    rows = sorted((r["kind"], r["place"], r["value"]) for r in values.where(few).select("kind", place.alias("place"), "value").collect())
    return {k: infer(sorted([v for kind, _, v in rows if kind == k][:most])) for k in sorted(share)}


def text_pairs(scanned: DataFrame) -> np.ndarray:
    """ln of the probability of each character after each, over all texts."""
    found = scanned.select(F.inline("pairs")).groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row for each pair of characters
    out = np.zeros((len(LETTERS) + 1) ** 2)
    for r in found:
        out[r["cell"]] = r["n"]
    return background(out)


def find_secrets(docs: DataFrame, *, key: str = "doc_id", text: str = "text", margin: float = MARGIN) -> DataFrame:
    """(key, spans) of every row: the base spans, and as kind 3 (`format`) all candidates whose score exceeds `margin`, by start, then kind.

    With no labelled credential in docs there is no automaton and only base spans are returned; an empty table gives an empty result.
    """
    scanned = settle(scan(docs, key=key, text=text), "scanned")
    automata = learn(scanned)
    pairs = text_pairs(scanned) if automata else None

    @F.pandas_udf("array<double>")
    def scores(values: pd.Series) -> pd.Series:
        return values.map(lambda own: [format_score(automata, pairs, v) for v in own])

    none = F.array().cast("array<struct<start:long,stop:long,kind:int,value:string>>")
    more = none
    if automata:
        likely = F.filter(F.arrays_zip(F.col("tokens").alias("t"), scores("tokens.value").alias("s")), lambda x: x.s > margin)
        more = F.transform(likely, lambda x: x.t)
    by_start = lambda a, b: F.when((a.start < b.start) | ((a.start == b.start) & (a.kind < b.kind)), -1).when((a.start == b.start) & (a.kind == b.kind), 0).otherwise(1)
    return scanned.select(key, F.array_sort(F.concat("spans", more), by_start).alias("spans"))
