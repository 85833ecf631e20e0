"""The pipeline stage by stage against brute force."""

import hashlib
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from flowwarden.llm import catalog, lines
from flowwarden.llm.text import materialize
from tests.llm.data import component_of, corpus, difficult, frame, words
from tests.llm.test_operators import lines_by_hand


def test_pipeline(spark, tmp_path):
    rows = corpus(150) + [(5000, "$$ 12", "en", "src1", 5), (5001, None, "en", "src1", 0)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, str(tmp_path)), name)
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == corpus_pipeline.COLUMNS

    stay = [r for r in rows if r[0] < 5000]
    assert sorted(r.doc_id for r in seen["language_id"]) == sorted(r[0] for r in stay)
    cut = lines_by_hand(stay, lines.RATIO, lines.MIN_PAGES)
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == {r[0]: t for r, t in zip(stay, cut)}
    parts = component_of([(r[0], t) for r, t in zip(stay, cut)])
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(set(parts.values()))
    left = {r.doc_id: r.text for r in seen["near_duplicates"]}
    used = Counter(r.doc_id for r in seen["mix_sources"])
    total = sum(len(words(t)) for t in left.values())
    want = total * catalog.MIX_FRACTION[0] // catalog.MIX_FRACTION[1]
    taken = sum(len(words(left[i])) * n for i, n in used.items())
    assert set(used) <= set(left) and max(used.values()) <= catalog.MIX_EPOCHS and want <= taken
    ranks = __import__("flowwarden.llm.bpe", fromlist=["bpe"]).read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")).ids
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in seen["byte_bpe"]:
        ids = own.encode_ordinary(left[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert Counter(r.doc_id for r in seen["byte_bpe"]) == used

    run = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(run) == Counter(seen["byte_bpe"])


def test_pipeline_on_difficult_rows(spark):
    """Nulls in every column, repeated rows, one id with several texts, clashing extra columns."""
    rows = corpus(60) + [r for r in difficult() if r[0] != 7 and r[0] != 8]
    docs = frame(spark, rows + rows[:5], clash=True)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    ids = Counter(r.doc_id for r in kept if r.doc_id is not None)
    assert max(ids.values()) == 1 and sum(r.doc_id is None for r in kept) == sum(r[0] is None for r in rows)
    nine = [r.text for r in kept if r.doc_id == 9]
    assert nine == [min(r[1] for r in rows if r[0] == 9)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        assert name == "byte_bpe" or docs.columns == corpus_pipeline.COLUMNS
    assert docs.count() > 30


def test_pipeline_on_an_empty_table(spark):
    docs = frame(spark, [], clash=True)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, ""), name)
        assert docs.count() == 0
