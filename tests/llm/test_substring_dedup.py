import random

from llm_cases import EDGES, prose, table

from ticketlens.llm import substring_dedup as S


def brute(rows, window):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    cut = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for doc_id, words in cut:
        gone = set()
        for i in range(len(words) - window + 1):
            key = tuple(words[i:i + window])
            if key in seen:
                gone.update(range(i, i + window))
            seen.add(key)
        kept = [w.decode() for k, w in enumerate(words) if k not in gone]
        out.append((doc_id, len(words), len(gone), " ".join(kept)))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_text").collect()), key=str)


def rows_with_passages(seed):
    maker = random.Random(seed)
    passages = [prose(50 + k, 30) for k in range(4)]
    rows = []
    for i in range(80):
        parts = [prose(1000 + i, maker.randrange(0, 40))]
        for _ in range(maker.randrange(3)):
            parts += [maker.choice(passages), prose(2000 + i, maker.randrange(0, 9))]
        rows.append((maker.randrange(10 ** 6), " ".join(parts)))
    return rows + [(5, "x y " * 30), (6, "x " * 45)]


def test_many_chunks_match_brute_force(spark):
    rows = rows_with_passages(4)
    assert found(S.remove_repeats(table(spark, rows), window=7, chunk_bytes=900)) == brute(rows, 7)


def test_full_sketch_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_COUNTERS", 64)
    monkeypatch.setattr(S, "COUNTERS_PER_BYTE", 1)
    rows = rows_with_passages(5)[:30]
    assert found(S.remove_repeats(table(spark, rows), window=5, rows=1, chunk_bytes=2000)) == brute(rows, 5)


def test_edges_with_the_production_window(spark):
    assert found(S.remove_repeats(table(spark, EDGES, clashing=True))) == brute(EDGES, 20)
    assert S.remove_repeats(table(spark, [])).count() == 0
