import hashlib
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from pulsegrid.llm import components as component_search
from pulsegrid.llm import language_id, line_dedup, mixing, quality, queries, sentencepiece_codec, simhash_dedup
from pulsegrid.llm.common import settle
from pulsegrid.llm.components import components
from tests.llm.fixtures import docs, empty, rows, with_nulls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(spark, sf_dir):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def test_sentencepiece_equals_library(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, sf_dir).collect()}
    for d, t in texts(spark, sf_dir):
        ids = p.encode(t, add_bos=True, add_eos=True)
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (len(ids), sha(array("I", ids).tobytes()), sha(p.decode(ids).encode())), d
    assert all(r.agrees for r in got.values())


def test_sentencepiece_odd_texts(spark):
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer("piece_bpe_32k.model")
    p = SentencePieceProcessor(model_file=path)
    got = sentencepiece_codec.encode(with_nulls(spark), path).collect()
    want = Counter((r[0], tuple(p.encode(r[1] or "", add_bos=True, add_eos=True))) for r in [*rows(), (None, "text of no id"), (None, None)])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert sentencepiece_codec.encode(empty(spark), path).count() == 0


def lines_by_hand(docs):
    """docs: (id, text), ids all different."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    where = defaultdict(set)
    for d, t in docs:
        for x in (t or "").split("\n"):
            where[key(x)].add(d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if len(key(x)) < 10 or min(where[key(x)]) == d]
        out[d] = (len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept).encode()))
    return out


def test_line_dedup(spark, sf_dir):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in queries.op9_line_dedup(spark, sf_dir).collect()}
    assert got == lines_by_hand(texts(spark, sf_dir))
    assert sum(x[1] for x in got.values())


@pytest.mark.parametrize("salts", [1, 3, 256])
def test_line_dedup_odd_texts(spark, salts):
    own = docs(spark).dropDuplicates(["doc_id"])
    got = line_dedup.keep_bitmaps(own, salts=salts).select("*", line_dedup.kept_text().alias("kept")).collect()
    want = lines_by_hand([(r.doc_id, r.text) for r in own.collect()])
    assert {r.doc_id: (r.dedup.n_lines, r.dedup.n_dropped, sha(r.kept.encode())) for r in got} == want
    assert line_dedup.keep_bitmaps(empty(spark)).count() == 0


def test_line_dedup_repeated_rows_and_null_ids(spark):
    got = line_dedup.keep_bitmaps(with_nulls(spark)).collect()
    assert len(got) == len(rows()) + 2
    assert [r.dedup.n_dropped for r in got if r.doc_id == 100] == [0, 0]  # rows of one id are one document
    assert all(r.dedup.n_dropped == 0 for r in got if r.doc_id is None)


def fingerprint(t):
    from xxhash import xxh64_intdigest

    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(fp: dict, radius=4):
    ids, root = sorted(fp), {d: d for d in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fp[a] ^ fp[b]).bit_count() <= radius:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    return {d: find(d) for d in ids}


def test_simhash_groups(spark, sf_dir):
    fp = {d: fingerprint(t) for d, t in texts(spark, sf_dir)}
    want = groups_by_hand(fp)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op10_simhash_dedup(spark, sf_dir).collect()}
    assert got == {d: (fp[d], want[d]) for d in fp}
    assert len(set(want.values())) < len(want)


def test_simhash_odd_texts(spark):
    own = [r for i, r in enumerate(rows()) if i < len(rows()) - 1]
    fp = {r[0]: fingerprint(r[1]) for r in own}
    got = simhash_dedup.near_groups(with_nulls(spark)).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == groups_by_hand(fp) and len(got) == len(rows()) + 2
    assert simhash_dedup.near_groups(empty(spark)).count() == 0
    kept = simhash_dedup.keep_one(with_nulls(spark))
    assert kept.columns == with_nulls(spark).columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({*groups_by_hand(fp).values()} | {100}) + [100]


@pytest.mark.parametrize(("rows_", "radius"), [(30, 4), (3_000, 4), (60_000, 4), (2**30, 4), (2**20, 3), (10, 0), (2**34, 6)])
def test_links_find_all_pairs(spark, rows_, radius):
    """Whatever number of segments the number of rows leads to, no pair within the radius is missed and no other is found."""
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(8))) for b in base for _ in range(6)]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in base + near})
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= radius}
    got = {(r.a, r.b) for r in simhash_dedup.links(spark.createDataFrame([(x,) for x in fps], "fp long"), rows_, radius).collect()}
    assert got == want


@pytest.mark.parametrize(("radius", "hot"), [(4, 2), (3, 0)])
def test_linked_components(spark, radius, hot):
    """Chains, a dense cluster of fingerprints and lone ones: the same components as from all links."""
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(6)]
    dense = [base[0] ^ sum(1 << i for i in rng.sample(range(12), rng.randrange(5))) for _ in range(300)]
    fps = sorted({x - 2**64 if x >= 2**63 else x for x in base + near + dense})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {r.node: r.root for r in components(simhash_dedup.links(frame, 2**18, radius)).collect()}
    assert {r.node: r.root for r in simhash_dedup.linked(frame, 2**18, radius, hot).collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2050)] + [(5, 5), (None, 7)]
    root = {}
    for a, b in pairs:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    for _ in root:
        for a, b in pairs:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()} == root


def test_stars_cost_no_round(spark, monkeypatch):
    """Links that are stars are written once and no more; new links go on from the roots that are known."""
    written = []
    monkeypatch.setattr(component_search, "settle", lambda df, name: written.append(name) or settle(df, name))
    frame = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    roots = components(frame([(1, i) for i in range(2, 40)] + [(50, 51), (51, 50)]))
    want = {i: 1 for i in range(1, 40)} | {50: 50, 51: 50}
    assert {r.node: r.root for r in roots.collect()} == want and len(written) == 1
    assert component_search.joined(roots, frame([])) is roots and len(written) == 1
    got = component_search.joined(roots, frame([(39, 51), (60, 61), (61, 62)]))
    assert {r.node: r.root for r in got.collect()} == {x: 1 for x in want} | {60: 60, 61: 60, 62: 60}


def targets_by_hand(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, rest = {}, list(order), 1.5 * sum(sizes.values())
    while free:
        each = rest / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * each > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * each for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def test_targets(spark):
    rng = random.Random(4)
    many = {f"{rng.choice('abé漢🎉')}{i}": int(rng.paretovariate(0.7) * 10) for i in range(300)} | {None: 5000, "": 0}
    for sizes in ({}, {"a": 100}, {"a": 0}, {"b": 100, "a": 100, None: 1000, "c": 0}, many):
        frame = spark.createDataFrame(list(sizes.items()), "source string, words long").repartition(3)
        got = {r.source: r.target for r in mixing.targets(frame).collect()}
        want = targets_by_hand(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mixing_tells_nulls_from_values(spark):
    docs_ = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, "x", "x y"), (None, "x", "1")], "doc_id long, source string, text string")
    got = mixing.mix(docs_).collect()
    assert len(got) == 4 and len({r.unit for r in got}) == 4 and all(r.rows == 1 for r in got)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size, p = rng.integers(0, 500, 400).astype(float), rng.random(400)
    out = mixing.flight(size, p, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    landed = mixing.landing(size, out)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) <= 500


def test_flight_has_the_right_expectation():
    size, p = np.array([5, 3, 3, 8, 1.0]), np.array([0.3, 0.6, 0.5, 0.2, 0.7])
    mean = np.mean([mixing.flight(size, p, np.random.default_rng(i)) for i in range(4000)], axis=0)
    assert np.allclose(mean, p, atol=0.03)


def test_mixing(spark, sf_dir):
    got = queries.op2_mixing(spark, sf_dir).collect()
    size = {d: len(WORD.findall(t)) for d, t in texts(spark, sf_dir)}
    assert {r.doc_id: r["size"] for r in got} == size and len(got) == len(size)
    per = defaultdict(lambda: [0, 0, 0, 0])
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        x = per[r.source]
        x[0], x[1], x[2], x[3] = x[0] + r["size"], x[1] + r.taken, r.target, max(x[3], r["size"])
        assert r.target <= 2 * r.source_size
    want = targets_by_hand({s: x[0] for s, x in per.items()})
    for s, x in per.items():
        assert x[2] == pytest.approx(want[s]) and abs(x[1] - x[2]) <= max(x[3] / 2, 0.02 * x[2]) + 1, s
    again = {r.doc_id: r.taken for r in mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(7)).selectExpr("doc_id", "size * copies as taken").collect()}
    assert again == {r.doc_id: r.taken for r in got}


@pytest.mark.parametrize("block", [4, 2048])
def test_mixing_odd_texts(spark, block):
    got = mixing.mix(with_nulls(spark), block=block).collect()
    assert sum(r.rows for r in got) == len(rows()) + 2 and all(r.copies in (0, 1, 2) for r in got)
    taken = mixing.take(with_nulls(spark), block=block)
    assert taken.columns == with_nulls(spark).columns
    assert taken.count() == sum(r.rows * r.copies for r in got)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.take(empty(spark)).count() == 0


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op3_quality(spark, sf).collect()
    held = [(labels[r.doc_id], r.predicted, r.score) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got)
    assert sum(y == p for y, p, _ in held) / len(held) > 0.95
    good, bad = [s for y, _, s in held if y], [s for y, _, s in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_odd_texts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (5, 1, 0), (None, 1, 0), (6, None, 0), (10, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(with_nulls(spark), labels)
    got = quality.score(with_nulls(spark), model).collect()
    assert len(got) == len(rows()) + 2 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (0, 1, 2, 3)}) == 1  # no words: the bias only
    rest = quality.score(with_nulls(spark), model, rest=True)
    assert rest.columns == [*with_nulls(spark).columns, "score"] and rest.count() == len(got)
    none = quality.fit(empty(spark), labels.limit(0))
    assert not none.any() and quality.score(empty(spark), none).count() == 0


def test_quality_reads_whole_words_and_one_text_of_an_id(spark):
    long = "x" * 1000
    assert all(not np.array_equal(quality.features(long)[0], quality.features(long[:900] + change)[0]) for change in ("1" * 100, "X" * 100, "-" * 100))
    assert sum(quality.features(long)[1] ** 2) > 0 and len(quality.split(long + " ab")) == 43
    models = set()
    for parts in (1, 2, 5):
        rows_ = [(i, f"{'good words here' if i % 2 else 'BAD!!! ###'} {i} {k}", i % 2) for i in range(60) for k in range(4)]
        frame = spark.createDataFrame(random.Random(parts).sample(rows_, len(rows_)), "doc_id long, text string, quality int").repartition(parts)
        models.add(quality.fit(frame.select("doc_id", "text"), frame.select("doc_id", "quality")).tobytes())
    assert len(models) == 1


def test_ftrl_learns_a_separable_rule():
    rng = random.Random(3)
    data = [(*quality.features(" ".join(rng.choice(("good", "fine") if y else ("bad", "poor")) + str(rng.randrange(9)) for _ in range(12))), y) for y in [0, 1] * 200]
    w, b = quality.train(data[:300])
    assert np.mean([(w[at] @ x + b > 0) == bool(y) for at, x, y in data[300:]]) > 0.95


def test_long_words_are_merged_once_and_not_kept(monkeypatch):
    """Words over 64 characters leave nothing behind, and a slice merges each but once."""
    own = sentencepiece_codec.MergeCodec(queries.tokenizer("piece_bpe_32k.model"))
    merged = []
    merge = own.merge
    monkeypatch.setattr(own, "merge", lambda part: merged.append(part) or merge(part))
    rng = random.Random(1)
    held = []
    for _ in range(20):
        texts_ = ["".join(rng.choice("abcdefghij") for _ in range(100)) for _ in range(500)]
        out = own.encode(texts_ + texts_)
        assert all(agrees for _, agrees in out) and out[:500] == out[500:]
        held.append(len(own.memo.kept) + len(own.memo.once))
    assert held == [0] * 20 and len([m for m in merged if len(m) > 64]) == 10_000


def test_recent_values_are_bounded():
    from pulsegrid.llm.common import Recent

    memo, learned = Recent(100), []
    learn = lambda names: learned.extend(names) or {n: n.encode() for n in names}
    for i in range(200):
        names = ["often", *(f"{i}-{k}" for k in range(30))]
        assert memo.seek(names, learn) == [n.encode() for n in names]
        assert len(memo.kept) <= 100 and len(memo.once) <= 80
    assert learned.count("often") == 1


def test_no_language_is_lost_to_a_repeated_row(spark):
    """Thresholds follow different ids, not rows: 40 documents of a language stay in the model beside a row of it that occurs 20,000 times."""
    rng = random.Random(2)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(30))
    rows = [(i, text("abcde"), "aa") for i in range(300)] + [(1000 + i, text("vwxyz"), "bb") for i in range(40)]
    often = spark.range(20_000).selectExpr("5001L AS doc_id", "'vwxyz zyxwv vvvvv' AS text", "'bb' AS lang")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").unionByName(often)
    model = language_id.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language_id.predict(docs.where("doc_id < 5000"), model, reject=False).collect()}
    assert model.languages == 2 and all(got[i] == lang for i, _, lang in rows)


def test_mix_meets_targets_with_repeated_rows(spark):
    """A row that makes up most of its source is taken as exactly as many different ones would be."""
    words = lambda n: "w " * n
    rows = [(i, words(50), "a") for i in range(10)] + [(99, words(50), "a")] * 40 + [(7, words(30), None)] * 9 + [(8, words(40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.monotonically_increasing_id()).repartition(3)
    got = mixing.mix(docs).collect()
    for source in ("a", None):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.size * r.copies * r.rows for r in own) - own[0].target) <= 50
        assert sum(r.rows for r in own) == sum(1 for x in rows if x[2] == source) and all(0 <= r.copies <= 2 for r in own)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.rows * r.copies for r in got)
    assert max(r["count"] for r in taken.groupBy("n").count().collect()) <= 2
    by_id = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert by_id[99] == sum(r.rows * r.copies for r in got if r.doc_id == 99)
