"""Every stage of the pipeline against a brute-force version, on the smallest tables with hard rows added."""

from collections import Counter

import corpus_pipeline
import pytest
import sentencepiece
from llm_cases import EDGES, prose, table
from test_curriculum_mix import water
from test_ngram_join import brute as brute_classes
from test_ngram_join import sets_of

from ticketlens.llm import quality_gam
from ticketlens.llm.queries import PIECE_MODEL

FOLDER = "/root/testdata/sf0.001"


def run_stage(spark, tmp_path, name, docs):
    stage = dict(corpus_pipeline.STAGES)[name]
    stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
    return spark.read.parquet(str(tmp_path / name))


@pytest.fixture(scope="module")
def documents(spark):
    own = spark.read.parquet(f"{FOLDER}/documents.parquet")
    return own.unionByName(table(spark, [(i and i + 10 ** 6, t) for i, t in EDGES]))


def test_stages_in_order(spark, tmp_path, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_duplicates", "mixing", "tokens"]
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    model = quality_gam.train(documents, spark.read.parquet(f"{FOLDER}/labels.parquet"), learn_from=~quality_gam.held_out("id"))
    scores = model.score(quality_gam.measure_all([r[1] for r in rows]))
    good = [r for r, s in zip(rows, scores) if s >= quality_gam.THRESHOLD]
    got = run_stage(spark, tmp_path, "quality", documents)
    assert got.columns == documents.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(r[:2] for r in good)

    best = {}
    for r in good:
        best[r[1] or ""] = max(best.get(r[1] or "", r), r, key=lambda x: -1 if x[0] is None else x[0])
    got = run_stage(spark, tmp_path, "exact_dedup", got)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in best.values())

    rows = [(r.doc_id, r.text) for r in got.collect()]
    smallest = {(c, n > 0) for _, n, c in brute_classes(rows)}
    got = run_stage(spark, tmp_path, "near_duplicates", got)
    assert Counter(r.doc_id for r in got.collect()) == Counter(c for c, _ in smallest)

    kept = {r.doc_id: r for r in got.collect()}
    sizes = Counter()
    for r in kept.values():
        sizes[r.source] += len((r.text or "").split())
    mixed = run_stage(spark, tmp_path, "mixing", got)
    assert mixed.columns == documents.columns
    taken, want = Counter(), water(sizes)
    copies = Counter(r.doc_id for r in mixed.collect())
    for doc_id, n in copies.items():
        assert n <= 3
        taken[kept[doc_id].source] += n * len(kept[doc_id].text.split())
    most = max(len((r.text or "").split()) for r in kept.values())
    assert all(abs(taken[s] - want[s]) <= most / 2 + 1 for s in sizes)

    coded = run_stage(spark, tmp_path, "tokens", mixed).collect()
    original = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert Counter(r.doc_id for r in coded) == copies
    assert all(r.parity and list(r.token_ids) == original.encode(kept[r.doc_id].text or "") for r in coded)


def test_empty_table_stays_empty(spark, tmp_path, documents):
    docs = documents.limit(0)
    for name, _ in corpus_pipeline.STAGES:
        docs = run_stage(spark, tmp_path, name, docs)
    assert docs.count() == 0


def test_near_copies_by_five_words(spark, tmp_path, monkeypatch):
    """The stage against brute force at five words and 0.8, with pairs that four words and 0.85 leave apart."""
    rows = []
    for k, size in enumerate((48, 49, 50, 52, 53, 96, 99, 100, 104)):
        words = prose(40 + k, size, 10 ** 6).split()
        rows.append((10 * k, " ".join(words)))
        for place in (size // 3, 2 * size // 3)[:1 + size // 90]:
            words[place] = "edited"
        rows.append((10 * k + 1, " ".join(words)))
    apart = {c for _, _, c in brute_classes(rows)}
    monkeypatch.setattr("test_ngram_join.sets_of", lambda text: sets_of(text, 5))
    want = {c for _, _, c in brute_classes(rows, 80)}
    assert len(want) < len(apart)
    assert {r.doc_id for r in run_stage(spark, tmp_path, "near_duplicates", table(spark, rows)).collect()} == want
