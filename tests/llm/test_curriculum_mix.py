import hashlib
import random

import pytest
from llm_cases import EDGES, table

from ticketlens.llm.curriculum_mix import by_first_position, in_training_order, mix


def water(sizes):
    """Targets by sharing, capping and sharing again."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = total - sum(fixed.values())
        open_weight = sum(w for s, w in weights.items() if s not in fixed)
        shares = {s: left * w / open_weight for s, w in weights.items() if s not in fixed} if open_weight else {}
        over = [s for s in shares if shares[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | shares
        fixed |= {s: 3.0 * sizes[s] for s in over}


def rows_of(seed=1):
    maker = random.Random(seed)
    return [(i, " ".join(["w"] * maker.randrange(0, 60)), maker.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(600)]


def test_targets_and_taken_words(spark):
    rows = rows_of()
    got = mix(table(spark, rows)).collect()
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    want = water(sizes)
    source_of = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(want[source_of[r.doc_id]])
        assert r.source_size == sizes[source_of[r.doc_id]]
        assert r.taken == r.size * r.copies and r.copies <= 3 and len(r.positions) == r.copies
        assert all(0 <= p <= 1 for p in r.positions)
        taken[source_of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 30 for s in sizes)


def test_order_of_taking_is_brute_force_order(spark):
    rows = rows_of(2)
    got = {r.doc_id: r for r in mix(table(spark, rows)).collect()}
    for source in {r[2] for r in rows}:
        before = 0
        for i, text, _ in sorted((r for r in rows if r[2] == source), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
            r = got[i]
            size = len(text.split())
            passes = int(r.target // r.source_size)
            more = before + size / 2 <= r.target - passes * r.source_size
            assert r.copies == (min(passes + more, 3) if size else 0)
            before += size


def test_reruns_agree_and_edges(spark):
    docs = table(spark, EDGES, clashing=True)
    one, two = (sorted(map(str, mix(docs).collect())) for _ in range(2))
    assert one == two and len(one) == len(EDGES)
    assert mix(table(spark, [])).count() == 0
    ordered = in_training_order(docs)
    assert ordered.columns == docs.columns
    assert all(r.text and r.text.split() for r in ordered.collect())


def test_rising_and_falling_schedules(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("abc" * 100)]
    got = mix(table(spark, rows)).collect()
    mean = {}
    for r in got:
        mean.setdefault(rows[r.doc_id][2], []).extend(r.positions)
    mean = {s: sum(p) / len(p) for s, p in mean.items()}
    assert mean["a"] < mean["b"] < mean["c"]


def test_rows_in_order_of_their_first_position(spark):
    rows = [(i, "w " * 10, s) for i, s in enumerate("abc" * 50)]
    mixed = mix(table(spark, rows))
    ordered = by_first_position(mixed).collect()
    first = [r.positions[0] if r.positions else -1.0 for r in ordered]
    assert first == sorted(first) and len(set(first)) > 50
    assert sorted(map(str, ordered)) == sorted(map(str, mixed.collect()))
