"""Merkle manifest, conversation repair and packing against plain versions, and on the awkward cases of fixtures."""

import hashlib
import random
from bisect import bisect_left, insort
from collections import defaultdict
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import conversation_repair, merkle, packing
from pulsegrid.llm.queries import QUERIES, tokenizer
from tests.llm import fixtures


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree_by_hand(leaves):
    """(root, the siblings of each leaf as lists of (left, right))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 8 * 8 : p // 8 * 8 + 8]
            paths[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level, at = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [p // 8 for p in at]
    return level[0], paths


def manifest_by_hand(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded) of rows (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for doc, source, lang, n, text in rows:
        leaf = h(*map(field, (doc, source, lang, n, text)))
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        other = h(*map(field, (doc, source, lang, n, lower))) if doc is not None and crc32(str(doc).encode()) % 3 == 0 else leaf
        groups[lang].append((doc is not None, doc or 0, leaf, doc, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree_by_hand([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = tree_by_hand([trees[g][0] for g in names]) if names else ("", [])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, doc, other), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            own = other
            for left, right in path + top:
                own = h(left, own, right)
            out.append((doc, leaf, trees[g][0], root, h("".join(a + b for a, b in path + top)), own, own == root))
    return sorted(out, key=str)


def manifest(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)
    monkeypatch.setattr("pulsegrid.llm.queries._read", lambda *_: frame)
    out = QUERIES["op11_merkle"](spark, "")
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_merkle_by_hand(spark, monkeypatch):
    rng = random.Random(4)
    many = [(rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(3000)]), "s", "en", 3, f"A text {i}") for i in range(700)]
    few = [(i, None, lang, None, "Tie") for lang in ("de", "é", "", "x" * 40) for i in range({"de": 9, "é": 1, "": 8, "x" * 40: 64}[lang])]
    rows = many + few + [(r[0], r[3], r[2], r[4], r[1]) for r in fixtures.rows()] + [(None, "a", None, 1, None), (None, "a", "en", 1, "B")] + [(5, "s", "en", 1, "Copy")] * 20
    assert manifest(spark, rows, monkeypatch) == manifest_by_hand(rows)
    for some in ([], rows[:1], rows[700:709]):
        assert manifest(spark, some, monkeypatch) == manifest_by_hand(some)


def test_merkle_long_prefixes(spark, monkeypatch):
    """Histograms go down into the leaves' digits where one id has many rows, and runs of copies are written in parts."""
    monkeypatch.setattr(merkle, "MOST", 3)
    monkeypatch.setattr(merkle, "RUN", 4)
    rows = [(i % 5, "s", ["en", "de", "fr", "xx", "xy"][i % 5], 1, f"t{i}") for i in range(200)] + [(7, "s", "en", 1, "same")] * 30
    assert manifest(spark, rows, monkeypatch) == manifest_by_hand(rows)


def test_merkle_other_columns_and_names(spark):
    docs = fixtures.docs(spark).withColumn("group", F.lit("g")).withColumn("rank", F.lit(1)).withColumn("digest", F.lit(2))
    out = merkle.manifest(docs, merkle.digest(merkle.field(F.col("text"))), group="source")
    assert out.count() == docs.count() and out.select("root").distinct().count() == 1
    assert out.where(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert {r.source for r in out.select("source").distinct().collect()} == {"a", "b", "é", "hot", None}


def damaged_by_hand(turns):
    out = []
    for conv, turn, role, text in turns:
        role, text = " " if role is None else role, " " if text is None else text
        lot = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if lot == 1:
            text = ""
        if lot == 2:
            text = "".join(c for c in text if c not in ".!?")
        if lot == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(lot, 1)
    return out


def cheapest_by_hand(rows):
    """(cost, audit, text) of rows (role, text, fault), by whole strings over all places and states."""
    n, grammar = len(rows), conversation_repair.GRAMMAR
    best = {}
    for i in range(n, -1, -1):
        for _ in range(5):
            for q in range(4):
                ways = [(0, "", ())] if i == n and q in (0, 3) else []
                for r, name in (("u", "user"), ("a", "assistant")):
                    if (t := grammar.get((q, r))) is not None and (i, t) in best:
                        c, s, x = best[i, t]
                        ways.append((c + 2, "I" + s, (f"{name}:", *x)))
                if i < n:
                    role, text, fault = rows[i]
                    if (i + 1, q) in best:
                        c, s, x = best[i + 1, q]
                        ways.append((c + 3, "D" + s, x))
                    if fault not in ("blank", "duplicate"):
                        more = fault == "truncated"
                        for t, cost, label, name in [(grammar.get((q, role[:1])), 0, "K", role), *((grammar.get((q, r)), 2, "R", m) for r, m in (("u", "user"), ("a", "assistant")))]:
                            if t is not None and (i + 1, t) in best:
                                c, s, x = best[i + 1, t]
                                ways.append((c + cost + more, label + s, (f"{name}:{text}", *x)))
                if ways:
                    best[i, q] = min(ways)
    cost, audit, x = best[0, 0]
    return cost, audit, "\n".join(x)


def repairs_by_hand(turns):
    space, convs = " \t\n\x0b\x0c\r", defaultdict(list)
    for t in turns:
        convs[t[0]]
    for conv, turn, role, text in damaged_by_hand(turns):
        convs[conv].append((turn is not None, turn or 0, role, text, turn))
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: r[:4])
        seen, told = set(), []
        for _, _, role, text, _ in rows:
            body = text.rstrip(space)
            told.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""))
            seen.add((role, text))
        known = [r[4] for r in rows if r[4] is not None]
        count = [sum(x[2] == f for x in told) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:], strict=False))
        cost, audit, whole = cheapest_by_hand(told)
        out.append((conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, *count, illegal, cost, audit, h(whole)))
    return sorted(out, key=str)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"at": F.lit(1), "copies_": F.lit(2), "code": F.lit(3)}).repartition(3)


def test_repair_by_hand(spark, monkeypatch):
    rng = random.Random(11)
    said = ["Fine.", "Yes!", "no end", "", " \t", None, "Why?", "Über. ", "a.b"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "server"]), rng.choice(said)) for c in range(150) for t in sorted(rng.sample(range(12), rng.randrange(1, 9)))]
    turns += [(None, t, "user", f"{t}.") for t in range(4)] + [(900, None, "system", "x."), (900, None, "system", "x."), (900, 2, "user", "x.")] + [(901, 1, "user", "copy.")] * 25
    turns += [(902, t, "tool", f"{t}.") for t in range(600)]
    frame = conversations(spark, turns)
    monkeypatch.setattr("pulsegrid.llm.queries._read", lambda *_: frame)
    got = QUERIES["op12_conversations"](spark, "").select(*NAMES)
    assert sorted(map(tuple, got.collect()), key=str) == repairs_by_hand(turns)
    assert QUERIES["op12_conversations"](spark, "").where(F.col("audit") == "").count() > 0
    monkeypatch.setattr("pulsegrid.llm.queries._read", lambda *_: frame.limit(0))
    assert QUERIES["op12_conversations"](spark, "").count() == 0


def test_repaired_rows(spark):
    turns = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "user", "More?"), ("b", 0, "assistant", "Oh."), ("c", 0, "user", ""), ("d", 0, "system", "s." * 3000), ("d", 1, "user", "q?"), ("d", 2, "assistant", "r.")]
    frame = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    fixes = conversation_repair.repair(frame)
    got = conversation_repair.repaired(frame, fixes).orderBy("conv_id", "at").collect()
    assert [(r.conv_id, r.at, r.edit, r.role, r.text[:5]) for r in got] == [
        ("a", 0, "K", "user", "Hi."), ("a", 1, "R", "assistant", "More?"),
        ("b", 0, "I", "user", ""), ("b", 1, "K", "assistant", "Oh."),
        ("d", 0, "K", "system", "s.s.s"), ("d", 1, "K", "user", "q?"), ("d", 2, "K", "assistant", "r."),
    ]
    assert {r.conv_id: r.audit for r in fixes.collect()} == {"a": "KDR", "b": "IK", "c": "D", "d": "KKK"}


def test_composition_stays_small():
    """However long a conversation is, few vectors of weights occur."""
    machine, rng = conversation_repair.Composition(), random.Random(0)
    for _ in range(300):
        machine.cheapest(bytes(rng.choice([0, 1, 2, 3, 5, 9, 10, 13, 14, 15]) for _ in range(200)))
    assert len(machine.vectors) < 200 and machine.cheapest(b"") == (0, "")


def bins_by_hand(lengths, capacity):
    """How many bins best-fit decreasing opens, document by document."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect_left(rooms, x)
        if i == len(rooms):
            n, room = n + 1, capacity
        else:
            room = rooms.pop(i)
        insort(rooms, room - x)
    return n


def test_best_fit_by_hand():
    rng = random.Random(5)
    for capacity, n in ((10, 40), (64, 300), (2048, 2000), (7, 1), (1, 5)):
        for _ in range(30):
            lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randrange(1, n + 1))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            bins, rank = defaultdict(list), defaultdict(int)
            for length, first, number, each, bin_, at in packing.best_fit(counts, capacity):
                assert first == rank[length]
                rank[length] += number
                for k in range(number):
                    bins[bin_ + k // each].append((at + k % each * length, length))
            assert rank == counts
            for parts in bins.values():
                end = 0
                for at, length in sorted(parts):
                    assert at == end
                    end += length
                assert end <= capacity
            assert len(bins) == bins_by_hand(lengths, capacity) == max(bins) + 1


def test_packing_by_hand(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    rows = fixtures.with_nulls(spark)
    for capacity in (2048, 16):
        packed = packing.pack(rows, tokenizer("word_bpe_49k.json"), capacity=capacity, ids=True)
        got = packed.collect()
        want = []
        for r in rows.collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
            for p, start in enumerate(range(0, len(ids), capacity)):
                cut = ids[start : start + capacity]
                want.append((r.doc_id, p, start, len(cut), crc32(b"".join(i.to_bytes(4, "little") for i in cut)), tuple(cut)))
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got), key=str) == sorted(want, key=str)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.ids))
        for parts in bins.values():
            assert [at for at, _ in sorted(parts)] == [sum(len(x) for _, x in sorted(parts)[:i]) for i in range(len(parts))]
            assert sum(len(x) for _, x in parts) <= capacity
        assert len(bins) == bins_by_hand([w[3] for w in want], capacity)
        made = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
        assert made == {s: [i for _, x in sorted(parts) for i in x] for s, parts in bins.items()}
    assert packing.pack(fixtures.empty(spark), tokenizer("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("table", ["documents", "pages"])
def test_word_ids_equal_the_library(spark, sf_dir, table):
    from tokenizers import Tokenizer

    own, library = packing.WordEncoder(tokenizer("word_bpe_49k.json"), most=500), Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    texts = [r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select("text" if table == "documents" else "html").collect()]
    texts += [t or "" for t in fixtures.TEXTS] + ["a<|endoftext|>b <|startoftext|>", "é ́e", "it's I'LL don't", "ΑΣ ΟΔΟΣ.", "İstanbul ǅ", "a b c　d\x85e\r\nf", "١٢٣ 12,3", "ﬁ ﬁ K Å", "👩‍👩‍👧 x‍y"]
    assert not own.plain
    for _ in range(2):
        got = own.encode(texts)
        assert [list(memoryview(x).cast("I")) for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
