import hashlib
from collections import defaultdict

from llm_cases import EDGES, table

from ticketlens.llm.exact_dedup import content_sort, without_copies


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        first = True
        for doc_id in ids:
            out.append((doc_id, keep, len(ids), doc_id == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and doc_id != keep
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_edges_match_brute_force(spark):
    assert found(content_sort(table(spark, EDGES))) == brute(EDGES)


def test_large_group_of_copies_over_lanes(spark):
    rows = [(i, "same text") for i in range(500)] + [(i, f"text {i % 40}") for i in range(500, 700)]
    assert found(content_sort(table(spark, rows))) == brute(rows)


def test_empty_table(spark):
    assert content_sort(table(spark, [])).count() == 0
    assert without_copies(table(spark, [])).count() == 0


def test_kept_rows_have_all_their_columns(spark):
    docs = table(spark, EDGES, clashing=True)
    kept = without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r[0] or -1 for r in brute(EDGES) if r[3])
