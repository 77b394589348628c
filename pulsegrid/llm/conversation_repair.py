"""Repair of the structure of conversations by the cheapest edits.

A conversation is an acceptor of its rows; an edit transducer keeps a row (K), gives it another role (R), deletes it (D) or
inserts an empty row (I); a grammar acceptor takes sequences of roles. The three are composed lazily: a state of the composition is
a row's place and a state of the grammar, and what a row does to the weights of all grammar states is worked out when it is first
met and remembered (`Composition`). Weights are pairs (cost, label string), compared in that order; the shortest path is found in
topological order, from the last row back. All arcs of a state have different labels, so equal costs are decided by the first label.

Conversations are dealt by id and sorted; a task streams through one after the other. Of the turns' texts the search needs nothing
but a code of a byte, made in Spark beforehand; it keeps three bytes a turn, as the audit itself has at least one. A second stream
applies the audit to the texts, row by row. A conversation of any length is thus read in one task, as the digest of a whole
conversation has to be, but never held there.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import settle

SPACE = " \t\n\x0b\x0c\r"
#: Costs: another role, deletion, insertion, and an undeleted truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: The grammar `(s?(ua)+)?` over role initials: states before anything, after s, after u, after a; the first and last accept.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL, STATES = (0, 3), range(4)
INITIALS = "sua?"
SOUND, BLANK, DUPLICATE, CUT = range(4)
LEGAL = {"su", "ua", "au"}


class Composition:
    """Weights of all grammar states before a row, from those after it: worked out once for each vector of weights and kind of row."""

    def __init__(self):
        costs, ways = self._inserted([(0, "", q) if q in FINAL else None for q in STATES])
        self.vectors, self.numbers, self.known = [tuple(costs)], {tuple(costs): 0}, {}
        self.ends = [labels for labels, _ in ways]

    @staticmethod
    def _inserted(best: list[tuple[int, str, int] | None]) -> tuple[list[int], list[tuple[str, int]]]:
        """Of the best (cost, label, next state) of each state without insertions (None: no way), the best costs with them, and ways: all labels, next state."""
        found = [b and (b[0], b[1], b[1], b[2]) for b in best]  # cost, first label, all labels, next state
        for _ in STATES:  # insertions cost, so no chain of them is longer
            more = [[found[then] for r in ROLES if (then := GRAMMAR.get((q, r))) is not None and found[then]] for q in STATES]
            found = [min([*([(b[0], b[1], b[1], b[2])] if b else []), *((f[0] + INSERT, "I", "I" + f[2], f[3]) for f in fs)], default=None) for b, fs in zip(best, more, strict=True)]
        return [f[0] for f in found], [(f[2], f[3]) for f in found]

    def before(self, number: int, code: int) -> tuple[int, int, list[tuple[str, int]]]:
        """(vector before the row, what was taken off all its costs, the way of each state) for a row of this code before vector `number`."""
        if (number, code) not in self.known:
            after, (fault, kind) = self.vectors[number], divmod(code, 4)
            extra = TRUNCATED if fault == CUT else 0
            best = []
            for q in STATES:
                arcs = [(after[q] + DELETE, "D", q)]
                if fault in (SOUND, CUT):
                    if (then := GRAMMAR.get((q, INITIALS[kind]))) is not None:
                        arcs.append((after[then] + extra, "K", then))
                    arcs += [(after[then] + REROLE + extra, "R", then) for r in ROLES if (then := GRAMMAR.get((q, r))) is not None]
                best.append(min(arcs))
            costs, ways = self._inserted(best)
            vector = tuple(c - min(costs) for c in costs)
            if vector not in self.numbers:
                self.numbers[vector] = len(self.vectors)
                self.vectors.append(vector)
            self.known[number, code] = self.numbers[vector], min(costs), ways
        return self.known[number, code]

    def cheapest(self, codes: bytes) -> tuple[int, str]:
        """(cost, labels) of the shortest path; of equal costs the least string."""
        numbers, number, cost = array("H", [0]), 0, 0
        for code in reversed(codes):
            number, off, _ = self.before(number, code)
            numbers.append(number)
            cost += off
        labels, state = [], 0
        for code, after in zip(codes, reversed(numbers[:-1]), strict=True):
            way, state = self.known[after, code][2][state]
            labels.append(way)
        return cost + self.vectors[number][0], "".join(labels) + self.ends[state]


def damage(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, turn, role, text, copies): planted damage, by the crc32 of `key:turn` modulo 20 (a null is one blank, there and in role and text).

    0 drops a row, 1 empties its text, 2 takes its stops, exclamation and question marks, 3 repeats it, 4 makes its role `user`.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat_ws(":", of(key), of(turn))) % 20
    own = F.when(lot == 1, "").when(lot == 2, F.translate(of(text), ".!?", "")).otherwise(of(text))
    rows = conversations.where(lot != 0)
    return rows.select(key, turn, F.when(lot == 4, "user").otherwise(of(role)).alias(role), own.alias(text), F.when(lot == 3, 2).otherwise(1).cast("long").alias("copies"))


def _rows(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """Different rows (conv, turn, role, text, copies, h1, h2); h1 and h2 hash the text."""
    n = F.col("copies") if "copies" in turns.columns else F.lit(1).cast("long")
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = turns.select(F.col(key).alias("conv"), F.col(turn).cast("long").alias("turn"), of(role).alias("role"), of(text).alias("text"), n.alias("copies"))
    return own.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _coded(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h1, h2, copies, code) without texts; code is 4 * fault of the first copy + the role's place in INITIALS."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1).isin(".", "!", "?")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = rows.select("conv", "turn", "role", "h1", "h2", "copies", blank.alias("blank"), cut.alias("cut"), kind.alias("kind"))
    said = narrow.where(~F.col("blank")).groupBy("conv", "role", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("turn")).alias("first")).where("n > 1")
    said = said.select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    both = narrow.join(said, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    again = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), CUT).otherwise(SOUND)
    return both.select("conv", "turn", "role", "h1", "h2", "copies", (fault * 4 + F.col("kind")).alias("code"))


def _dealt(rows: DataFrame, *first: str) -> DataFrame:
    """By conversation; its rows by turn (null first), role and hash of the text."""
    return rows.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), *first, F.asc_nulls_first("turn"), "role", "h1", "h2")


def repair(turns: DataFrame, *, every: DataFrame | None = None, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: key, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Rows go by turn (null first), rows of one turn by role and then by a hash of the text. A column `copies` says how often a row stands
    there; repeated rows are neighbours. A null role or text is one blank. A row's first fault counts: blank, duplicate of a row
    with the same role and text, truncated. `gaps` are turns missing between the least and the greatest; `illegal` counts
    neighbours of wrong role initials. `audit` has the initials of the cheapest edits, of these the least string. Conversations
    of `every` (a column key) that have no row get zeros and an empty audit. A null key is one conversation.
    """
    coded = _coded(_rows(turns, key, turn, role, text))
    if every is not None:
        coded = coded.unionByName(every.select(F.col(key).alias("conv")).distinct().withColumn("copies", F.lit(0).cast("long")), allowMissingColumns=True)
    kind = turns.schema[key].dataType.simpleString()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Composition()
        now, codes, seen, out, schema = None, bytearray(), [None, None, 0], [], None

        def done() -> None:
            faults = [codes.count(bytes([4 * f + k])) for f in range(4) for k in range(4)]
            roles = codes.translate(bytes(ord(INITIALS[c % 4]) for c in range(256))).decode()
            pairs = max(0, len(roles) - 1)
            legal = sum(1 for a, b in zip(roles, roles[1:], strict=False) if a + b in LEGAL)
            gaps = seen[1] - seen[0] + 1 - seen[2] if seen[2] else 0
            cost, audit = machine.cheapest(bytes(codes))
            out.append((now[0], gaps, *(sum(faults[4 * f : 4 * f + 4]) for f in (BLANK, DUPLICATE, CUT)), pairs - legal, cost, audit))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], schema), *(pa.array(c, pa.int64()) for c in cols[1:7]), pa.array(cols[7], pa.string())], [key, *names])

        for batch in batches:
            schema = batch.schema.field("conv").type
            for conv, at, n, code in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "copies", "code")), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done()
                    now, codes, seen = (conv,), bytearray(), [None, None, 0]
                if not n:
                    continue
                if at is not None and at != seen[1]:
                    seen = [at if seen[0] is None else seen[0], at, seen[2] + 1]
                codes.append(code)
                codes += bytes([4 * BLANK + code % 4 if code // 4 == BLANK else 4 * DUPLICATE + code % 4]) * (n - 1)
            if len(out) >= 1000:
                yield flush()
                out = []
        if now is not None:
            done()
        if out:
            yield flush()

    found = _dealt(coded).select("conv", "turn", "copies", "code")
    return found.mapInArrow(run, f"`{key}` {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, edit, role, text) of every row that stays, and (conv, None, None, None) where a conversation ends; rows are sorted, an audit comes first."""
    now, audit, at, state = None, "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            initial = next(r for r in ROLES if (state, r) in GRAMMAR)
            state, at = GRAMMAR[state, initial], at + 1
            yield now[0], "I", ROLES[initial], ""

    for batch in batches:
        for conv, edits, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv", "audit", "role", "text", "copies")), strict=True):
            if edits is not None:
                if now is not None:
                    yield from inserted()
                    yield now[0], None, None, None
                now, audit, at, state = (conv,), edits, 0, 0
                continue
            for _ in range(n):
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                initial = role[:1] if edit == "K" else next(r for r in ROLES if (state, r) in GRAMMAR)
                state = GRAMMAR[state, initial]
                yield conv, edit, role if edit == "K" else ROLES[initial], text
    if now is not None:
        yield from inserted()
        yield now[0], None, None, None


def _joined(turns: DataFrame, repairs: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    rows = _rows(turns, key, turn, role, text).withColumn("audit", F.lit(None).cast("string"))
    audits = repairs.select(F.col(key).alias("conv"), "audit")
    both = rows.unionByName(audits, allowMissingColumns=True).withColumn("_row", F.col("audit").isNull())
    return _dealt(both, "_row").select("conv", "audit", "role", "text", "copies")


def repaired(turns: DataFrame, repairs: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, at, edit, role, text): the rows of every conversation after the edits of repair()'s audits, numbered from 0."""
    kind = turns.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at = [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, pa.schema([(key, key_type), ("at", pa.int64()), ("edit", pa.string()), (role, pa.string()), (text, pa.string())]))

        first = next(batches, None)
        if first is None:
            return
        key_type = first.schema.field("conv").type
        for conv, edit, who, said in _walk(chain([first], batches)):
            if edit is None:
                at = 0
                continue
            out.append({key: conv, "at": at, "edit": edit, role: who, text: said})
            at += 1
            if len(out) >= 1000:
                yield flush()
                out = []
        if out:
            yield flush()

    return _joined(turns, repairs, key, turn, role, text).mapInArrow(run, f"`{key}` {kind}, at long, edit string, `{role}` string, `{text}` string")


def digests(turns: DataFrame, repairs: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, repaired_sha256) of every conversation of repair(): of its repaired rows as `role:text`, joined by newlines."""
    kind = turns.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        key_type, out, sha, glue = first.schema.field("conv").type, [], hashlib.sha256(), ""
        for conv, edit, who, said in _walk(chain([first], batches)):
            if edit is not None:
                sha.update(f"{glue}{who}:{said}".encode())
                glue = "\n"
                continue
            out.append((conv, sha.hexdigest()))
            sha, glue = hashlib.sha256(), ""
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], key_type), pa.array([d for _, d in out])], [key, "repaired_sha256"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], key_type), pa.array([d for _, d in out])], [key, "repaired_sha256"])

    return _joined(turns, repairs, key, turn, role, text).mapInArrow(run, f"`{key}` {kind}, repaired_sha256 string")


def report(turns: DataFrame, *, every: DataFrame | None = None, key: str = "conv_id", **names: str) -> DataFrame:
    """repair() with the digest of each repaired conversation."""
    found = settle(repair(turns, every=every, key=key, **names), "repairs")
    own = digests(turns, found, key=key, **names).withColumnRenamed(key, "_key")
    return found.join(own, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")

