from array import array
from collections import Counter

import corpus_pipeline
from pulsegrid.llm import queries
from pulsegrid.llm.common import settle
from tests.llm.test_shingle_dedup import groups_by_hand
from tests.llm.test_text_operators import WORD, lines_by_hand, sha, targets_by_hand


def test_each_stage_by_hand(spark, sf_dir):
    from sentencepiece import SentencePieceProcessor

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    first = settle(stages["quality_filter"](spark, docs, sf_dir), "t")
    assert {r.doc_id for r in first.collect()} == {r.doc_id for r in queries.op3_quality(spark, sf_dir).where("predicted = 1").collect()}
    second = settle(stages["line_dedup"](spark, first, sf_dir), "t")
    by_hand = lines_by_hand([(r.doc_id, r.text) for r in first.collect()])
    assert {r.doc_id: sha(r.text.encode()) for r in second.collect()} == {d: x[2] for d, x in by_hand.items()}
    assert all(r.n_chars == len(r.text) for r in second.collect())
    third = settle(stages["simhash_near_dedup"](spark, second, sf_dir), "t")
    groups = groups_by_hand([(r.doc_id, r.text) for r in second.collect()])
    assert sorted(r.doc_id for r in third.collect()) == sorted(set(groups.values()))
    fourth = settle(stages["mixing"](spark, third, sf_dir), "t")
    assert first.columns == second.columns == third.columns == fourth.columns == columns
    rows, taken = third.collect(), Counter(r.doc_id for r in fourth.collect())
    size = {r.doc_id: len(WORD.findall(r.text)) for r in rows}
    sources = {s: sum(size[r.doc_id] for r in rows if r.source == s) for s in {r.source for r in rows}}
    for s, goal in targets_by_hand(sources).items():
        own = [r.doc_id for r in rows if r.source == s]
        assert abs(sum(size[d] * taken[d] for d in own) - goal) <= max(size[d] for d in own) and max(taken[d] for d in own) <= 2
    last = stages["sentencepiece"](spark, fourth, sf_dir).collect()
    p = SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))
    text = {r.doc_id: r.text for r in rows}
    want = Counter((d, sha(array("I", p.encode(text[d], add_bos=True, add_eos=True)).tobytes())) for d, n in taken.items() for _ in range(n))
    assert Counter((r.doc_id, r.ids_sha256) for r in last) == want
