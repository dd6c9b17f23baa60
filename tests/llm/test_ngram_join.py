import random

import numpy as np
import pytest
from llm_cases import EDGES, prose, table

from ticketlens.llm import ngram_join as N


def sets_of(text, size=4):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    size = min(size, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)}


def brute(rows, percent=85):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), smallest.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed, base, count, most_edits):
    maker = random.Random(seed)
    for _ in range(count):
        words = base.split()
        for _ in range(maker.randrange(most_edits + 1)):
            words[maker.randrange(len(words))] = f"edit{maker.randrange(10 ** 6)}"
        yield " ".join(words)


@pytest.fixture(scope="module")
def mixed_rows():
    texts = [*near_copies(1, prose(1, 120), 40, 3), *near_copies(2, prose(2, 60), 40, 4), *near_copies(3, prose(3, 30), 20, 2)]
    texts += [f"{prose(9, 25)} {prose(100 + k, 12)}" for k in range(30)] + [prose(200 + k, 40) for k in range(20)]
    texts += ["short text", "Short TEXT", "short text here now", "one"] * 3
    return [(1000 - k, t) for k, t in enumerate(texts)]


def test_components_match_brute_force(spark, mixed_rows):
    assert found(N.jaccard_classes(table(spark, mixed_rows))) == brute(mixed_rows)


def test_few_first_places_and_split_homes(spark, mixed_rows, monkeypatch):
    monkeypatch.setattr(N, "HOME_PAIRS", 4)
    monkeypatch.setattr(N, "FIRST_PLACES", 1)
    assert found(N.jaccard_classes(table(spark, mixed_rows), fragments=3)) == brute(mixed_rows)


def test_edges(spark):
    docs = table(spark, EDGES, clashing=True)
    classes = N.jaccard_classes(docs)
    assert found(classes) == brute(EDGES)
    assert classes.filter("kept and component_id is not null").select("component_id").distinct().count() == len(
        {c for _, _, c in brute(EDGES) if c is not None})
    stays = N.one_of_each_class(docs)
    assert stays.columns == docs.columns
    assert N.jaccard_classes(table(spark, [])).count() == 0


def test_lists_cut_into_parts_and_short_runs(spark, mixed_rows, monkeypatch):
    monkeypatch.setattr(N, "PART", 5)
    monkeypatch.setattr(N, "RUN_PAIRS", 7)
    monkeypatch.setattr(N, "FIRST_PLACES", 1)
    assert found(N.jaccard_classes(table(spark, mixed_rows))) == brute(mixed_rows)


def test_similar_sets_share_a_cell():
    maker = np.random.default_rng(6)
    for percent in (60, 80, 85):
        for size in [*range(1, 60), 300, 2000]:
            for _ in range(6):
                one = np.unique(maker.integers(0, 2 ** 63, size).astype(np.uint64) * np.uint64(2))
                # As different as similar sets can be, by words left out, put in or replaced.
                out = int(maker.integers(0, size * (100 - percent) // 100 + 1))
                two = np.unique(np.r_[one[out:], maker.integers(0, 2 ** 63, int(maker.integers(0, out + 2))).astype(np.uint64) * np.uint64(2)])
                if 100 * len(np.intersect1d(one, two)) >= percent * len(np.union1d(one, two)):
                    assert len(np.intersect1d(N.cells(one, percent), N.cells(two, percent))), (percent, size)


def test_family_around_the_threshold(spark):
    base = prose(7, 90)
    rows = list(enumerate([*near_copies(11, base, 60, 6), *near_copies(12, base + " " + prose(8, 20), 30, 8)]))
    assert len({c for _, _, c in brute(rows)}) > 10
    assert found(N.jaccard_classes(table(spark, rows))) == brute(rows)


def test_bitmaps_bound_the_difference():
    maker = np.random.default_rng(5)
    for size in (1, 40, 64, 65, 700, 1500):
        one = np.unique(maker.integers(0, 2 ** 63, size).astype(np.uint64))
        two = np.unique(np.r_[one[size // 5:], maker.integers(0, 2 ** 63, size // 9).astype(np.uint64)])
        bits = [N._bitmap(s).view(np.uint64) for s in (one, two)]
        while len(bits[0]) != len(bits[1]):
            wide = int(len(bits[1]) > len(bits[0]))
            half = len(bits[wide]) // 2
            bits[wide] = bits[wide][:half] ^ bits[wide][half:]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(one, two))
    assert N._bitmap(np.arange(20_000, dtype=np.uint64)) is None


def test_members_of_a_large_group_do_not_all_hand_on_one_outsider(spark):
    bits = [int(b) for b in N._bitmap(N.shingles(prose(5, 60)), N.SPREAD).view(np.int64)]
    rows = [(1, -1, 0, uid, 57, min(uid, 300), bits, None) for uid in range(302)]
    frame = spark.createDataFrame([(t, b, p, u, n, 0 if u < 300 else u, x, y) for t, b, p, u, n, _, x, y in rows],
                                  "token long, block long, part long, uid long, n long, component long, bits array<long>, tried array<long>")
    got = N._partners(frame.coalesce(1), 85, 1).collect()
    assert [(r.uid, r.other) for r in got] == [(300, 0), (301, 0)]


def test_bound_of_a_pair_is_close():
    maker = np.random.default_rng(4)
    one = np.unique(maker.integers(0, 2 ** 63, 400).astype(np.uint64))
    two = np.unique(np.r_[one[44:], maker.integers(0, 2 ** 63, 44).astype(np.uint64)])
    assert np.bitwise_count(N._bitmap(one, N.SPREAD) ^ N._bitmap(two, N.SPREAD)).sum() >= 84
