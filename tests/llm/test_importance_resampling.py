import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import EDGES, prose, table

from ticketlens.llm import importance_resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TARGET = [prose(90, 50), prose(91, 30, 100), None, "", "Ünïcode Wörds"]


def buckets(text):
    words = WORD.findall((text or "").translate(FOLD))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute_force(rows, target, percent=25):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(buckets(text)[1])
    for text in target:
        t.update(buckets(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    scored = []
    for i, text in rows:
        n, found = buckets(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in found]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    ranks = Counter()
    out = [(*x[:4], n + 1) for n, x in enumerate(able[:percent * len(able) // 100])]
    ranks.update(x[:4] for x in out)
    for x in scored:
        if ranks[x[:4]] and x[4]:
            ranks[x[:4]] -= 1
        else:
            out.append((*x[:4], None))
    return sorted(out, key=str)


def run(spark, rows, target=TARGET, clashing=True, **options):
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in importance_resampling.resample(table(spark, rows, clashing), wanted, **options).collect()), key=str)


def test_matches_brute_force(spark):
    rows = [(i, prose(i, 5 + i)) for i in range(60)] + EDGES + [(70, "A.b-C1 " * 30), (71, "x\x7fy{z" * 9)]
    assert run(spark, rows) == brute_force(rows, TARGET)


def test_repeated_rows_and_ids(spark):
    rows = [(5, prose(1, 40))] * 40 + [(6, prose(2, 40))] * 3 + [(5, prose(3, 25))] * 20
    assert run(spark, rows) == brute_force(rows, TARGET)


def test_empty_tables(spark):
    assert run(spark, []) == []
    rows = [(i, prose(i, 30)) for i in range(8)]
    assert run(spark, rows, []) == brute_force(rows, [])
    assert all(r[4] is None for r in run(spark, [(1, "few words"), (2, None)]))


@pytest.mark.parametrize("pivots", [1, 2, 24])
def test_quickselect_finds_every_rank(spark, pivots):
    maker = random.Random(pivots)
    rows = [(maker.randrange(6), maker.choice([None, 1, 2]), maker.choice(["a", "b", None])) for _ in range(40)]
    frame = spark.createDataFrame(rows, "x int, y int, z string").coalesce(2)
    ordered = sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))
    for k in (1, 2, 17, 39, 40):
        assert importance_resampling.quickselect(frame, ["x", "y", "z"], k, pivots) == ordered[k - 1]
    assert importance_resampling.quickselect(frame, ["x", "y", "z"], 41, pivots) is None
    assert importance_resampling.quickselect(frame, ["x", "y", "z"], 0, pivots) is None


def test_pair_checksums_follow_from_words():
    texts = ["one two", "a" * 3000 + " b", "", None, "ß 日本 x9"]
    n_words, found, owner = importance_resampling.features(texts)
    for place, text in enumerate(texts):
        n, expected = buckets(text)
        assert n_words[place] == n and sorted(found[owner == place].tolist()) == sorted(expected)
