import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ticketlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, comp long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA)


def brute_force(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append(((turn is not None, turn or 0), role, digest, text))
    for turns in own.values():
        turns.sort()
    rebuilt = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rebuilt[conv] = [(t[1], t[3]) for t in own.get(conv - conv % 20, [])[:h] + turns[h:]]
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(rebuilt):
        for d in range(len(rebuilt[conv]) + 1):
            members[tuple(rebuilt[conv][:d])].append(conv)
        ends[tuple(rebuilt[conv])].append(conv)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, convs in members.items():
        words = len(node[-1][1].encode().split()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * words
    return sorted(((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), children[node], leaves[node], saved[node],
                    hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()) for node, convs in members.items()), key=str)


def conversations(seed=1, n=120, most=7, choices=3):
    maker = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(maker.randrange(1, most)):
            rows.append((conv, turn, maker.choice(["user", "assistant"]), " ".join(["word"] * maker.randrange(choices)) + maker.choice("ab")))
    return rows


def run(spark, rows, **options):
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows), **options).collect()), key=str)


@pytest.mark.parametrize("local_nodes", [1, 40, 20_000])
def test_matches_brute_force(spark, local_nodes):
    rows = conversations()
    assert run(spark, rows, local_nodes=local_nodes) == brute_force(rows)


def test_long_and_equal_conversations(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(1500)] + [(c, t, "user", f"turn {t}") for c in (9, 11, 45, 20_000) for t in range(c % 7 + 3)]
    rows += [(c, t, "user", "the same") for c in range(60, 100) for t in range(3)]
    assert run(spark, rows, local_nodes=300) == brute_force(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", None), (1, 0, "user", None), (1, 0, None, "x"), (2, 1, "a", "b"), (2, 1, "a", "c"), (2, None, "a", ""),
            (None, 1, "user", "no conversation"), (40, 0, "user", "hello  there\n"), (41, 0, "user", "hello"), (43, 5, "", ""), (43, 5, "", ""),
            (4, 0, "us", "erx"), (5, 0, "user", "x"), (6, 0, "user", "日本 ünï"), (20_000, 1, "z", "y" * 50_000)]
    assert run(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "x")]) == []


@pytest.mark.parametrize("parents", [[-1], [-1, 0, 1, 2, 3, 4, 5], [-1, 0, 0, 0, 1, 1, 5, -1, 7], [-1, *range(400)]])
def test_decomposition_adds_up(parents):
    import numpy as np

    values = np.stack([np.arange(len(parents)) + 1, np.ones(len(parents), np.int64)], axis=1)
    expected = values.copy()
    for node in reversed(range(len(parents))):
        if parents[node] >= 0:
            expected[parents[node]] += expected[node]
    tops = [i for i, p in enumerate(parents) if p < 0]
    assert prefix_trie._Forest(parents, values).decompose(tops).tolist() == expected.tolist()
