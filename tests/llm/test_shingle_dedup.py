import os
import random
import time

import pytest

import corpus_pipeline
from pulsegrid.llm import common, shingle_dedup
from tests.llm.fixtures import SCHEMA, empty, rows, with_nulls
from tests.llm.test_text_operators import LOWER, WORD


def shingles(t):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_by_hand(docs):
    sets, root = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {d: lo if r == hi else r for d, r in root.items()}
    return root


def pairs_around_the_bound(seed, n):
    """Documents and copies of them in which the last words are others: 4/5 of the shingles shared, or one less."""
    rng, out = random.Random(seed), []
    for i in range(n):
        w = [f"w{rng.randrange(10**9)}" for _ in range(9 * (i % 7 + 2) + 4)]  # 9k shingles
        gone = len(w[4:]) // 9 + (i % 2)  # k others of 9k: 8k / 10k
        out += [(10 * i, " ".join(w)), (10 * i + 1, " ".join([*w[: len(w) - gone], *(f"x{rng.randrange(10**9)}" for _ in range(gone))]))]
    return out


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "en", "a", len(t or ""), None, None, None, None, None) for d, t in docs], SCHEMA).repartition(3)


def test_pipeline_stage_just_above_and_below(spark, sf_dir):
    docs = pairs_around_the_bound(1, 40)
    got = sorted(r.doc_id for r in corpus_pipeline.dedup_documents(spark, frame(spark, docs), sf_dir).collect())
    assert got == sorted([10 * i for i in range(40)] + [10 * i + 1 for i in range(1, 40, 2)])


@pytest.mark.parametrize(("turns", "common"), [(2, 50_000), (0, 0)])
def test_groups_of_chains_and_common_passages(spark, monkeypatch, turns, common):
    monkeypatch.setattr(shingle_dedup, "TURNS", turns)
    monkeypatch.setattr(shingle_dedup, "COMMON", common)
    rng = random.Random(2)
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage, docs, w = new(30), [], new(120)
    for i in range(25):  # each a few words from the one before
        docs.append((i, " ".join(w)))
        at = rng.randrange(110)
        w = [*w[:at], *new(rng.randrange(1, 12)), *w[at + rng.randrange(10) :]]
    docs += [(100 + i, " ".join([*new(rng.randrange(10, 60)), *passage])) for i in range(30)]
    docs += [(1000 + d, t) for d, t in pairs_around_the_bound(3, 20)]
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_groups(frame(spark, docs)).collect()}
    assert got == groups_by_hand(docs) and 1 < len({got[i] for i in range(25)}) < 25


def test_odd_texts(spark):
    want = groups_by_hand(list({r[0]: r[1] for r in rows()}.items()))
    got = shingle_dedup.near_groups(with_nulls(spark)).collect()
    assert len(got) == len(rows()) and {r.doc_id: r.component_id for r in got} == want
    kept = shingle_dedup.keep_one(with_nulls(spark))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted([*set(want.values()), 100]) and kept.where("doc_id IS NULL").count() == 2
    assert shingle_dedup.near_groups(empty(spark)).count() == 0


def tables(spark):
    return set(os.listdir(spark.conf.get("spark.checkpoint.dir")))


def test_chance_meetings_of_long_documents_move_no_sets(spark, monkeypatch):
    """Documents of 5,000 words with a passage in common meet, but share almost nothing; a near copy of one is found as before."""
    rng, made = random.Random(4), []
    new = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = new(400)
    docs = [(i, [*new(5_000 + 40 * i), *passage]) for i in range(6)]
    docs.append((7, [*docs[2][1][:4_700], *new(300)]))
    docs = [(d, " ".join(w)) for d, w in docs]
    kept = shingle_dedup.settle
    monkeypatch.setattr(shingle_dedup, "settle", lambda df, name: (made.append((name, out := kept(df, name), out.count())), out)[1])
    monkeypatch.setattr(shingle_dedup, "COMMON", 0)
    got = {r.doc_id: r.component_id for r in shingle_dedup.near_groups(frame(spark, docs)).collect()}
    assert got == groups_by_hand(docs) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 7: 2}
    assert max(n for name, _, n in made if name == "pairs") > 1 and max(n for name, _, n in made if name == "sets") == 2


def test_counts_in_cells_keep_what_is_similar():
    """Sets just similar enough, and cells of two sizes or that were not counted."""
    rng = random.Random(5)
    for n, m in ((4_095, 4_096), (1_023, 1_200), (4_000, 5_000), (9_000, 9_000)):
        both = -(-4 * (n + m) // 9)
        every = [rng.randrange(2**64) for _ in range(n + m - both)]
        x, y, z = (shingle_dedup.np.array(sorted(s), "uint64") for s in (every[:n], every[n - both :], [rng.randrange(2**64) for _ in range(m)]))
        assert len(set(map(int, x)) & set(map(int, y))) == both
        assert shingle_dedup._alike(shingle_dedup._fine(x), shingle_dedup._fine(y))
        assert n < 1_024 or not shingle_dedup._alike(shingle_dedup._fine(x), shingle_dedup._fine(z))
    assert shingle_dedup._fine(shingle_dedup.np.arange(5_000, dtype="uint64")) is None  # all in one cell


def test_only_the_result_stays_on_disk(spark, monkeypatch):
    before, kept = tables(spark), spark.conf.get(common.SWEEP)
    docs = pairs_around_the_bound(6, 10)
    assert shingle_dedup.keep_one(frame(spark, docs)).count() == 15
    assert [t.partition("-")[0] for t in tables(spark) - before] == ["others"]
    before = tables(spark)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, lambda s, d, _: common.settle(d, "own").limit(50)) for name in ("one", "two")])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == 50
    assert [t.partition("-")[0] for t in tables(spark) - before] == ["two"] and spark.conf.get(common.SWEEP) == kept


def test_shuffle_files_go_with_their_job(spark):
    """Not when the driver happens to collect its garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def names() -> set[str]:
        files = disk.getAllFiles()
        return {n for i in range(files.size()) if (n := files.apply(i).getName()).startswith("shuffle_")}

    before = names()
    for _ in range(4):
        common.settle(spark.range(20_000).selectExpr("id % 1000 AS k").groupBy("k").count(), "counts")
    for _ in range(10):
        if not (left := names() - before):
            break
        time.sleep(0.1)
    assert not left
