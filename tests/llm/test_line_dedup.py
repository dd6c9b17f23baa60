import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import EDGES, table

from ticketlens.llm import line_dedup

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COMMON = "This very common line is in many documents"


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def brute_force(rows, least_chars=20, least=3):
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < least or i == max(holders[key(x)], key=lambda v: (v is not None, v or 0))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def documents():
    rows = [(i, f"own line number {i} of the document\n  {COMMON.upper()}\t\nshort\n{COMMON}\n") for i in range(1, 40)]
    rows += [(100 + i, f"ünïcode line ÀÉ {i % 2} of its own\n\n{'é' * 19}\n{'é' * 20}\r") for i in range(6)]
    rows += [(200, "twice only, in two documents\n" * 3), (201, "twice only, in two documents"), (202, "x"), (203, "\n\n"), (7, COMMON)]
    rows += [(None, COMMON), (300, COMMON + "\n" + COMMON), (300, COMMON + "\n" + COMMON)]
    return rows + [(i, t) for i, t in EDGES]


def test_matches_brute_force(spark):
    rows = documents()
    got = line_dedup.without_common_lines(table(spark, rows, clashing=True)).drop("keep").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_force(rows)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("cuts", [1, 2, 3, 5])
def test_ranges_and_batches_cut_anywhere(size, cuts):
    """A sorted table cut into ranges and batches gives the same lines, wherever a key is cut."""
    rng = np.random.default_rng(size * 10 + cuts)
    rows = sorted(((int(k), 0, int(d), 0, int(p), 9) for k, d, p in zip(rng.integers(0, 6, 120), rng.integers(0, 5, 120), rng.permutation(120))),
                  key=lambda r: (r[0], r[1], -r[2], r[4]))
    names = ("h1", "h2", "id", "digest", "at", "n")
    bounds = sorted({0, len(rows), *rng.integers(0, len(rows), cuts - 1).tolist()})
    goes, opened, holders = set(), [], defaultdict(set)
    for start, end in zip(bounds, bounds[1:]):
        part = pa.table({name: [r[i] for r in rows[start:end]] for i, name in enumerate(names)})
        for batch in line_dedup._stream(iter(part.to_batches(max_chunksize=size)), 3):
            for row in batch.to_pylist():
                if row["kind"] == line_dedup._GOES:
                    goes.add((row["h1"], row["id"], row["at"]))
                elif row["kind"] == line_dedup._OPEN:
                    opened.append(row)
                else:
                    holders[row["h1"]].add(row["id"])
    goes |= {(r["h1"], r["id"], r["at"]) for r in opened if len(holders[r["h1"]]) >= 3 and r["id"] != max(holders[r["h1"]])}
    has = defaultdict(set)
    for r in rows:
        has[r[0]].add(r[2])
    assert goes == {(r[0], r[2], r[4]) for r in rows if len(has[r[0]]) >= 3 and r[2] != max(has[r[0]])}


def test_bitmap_has_a_bit_per_line(spark):
    rows = [(i, f"{COMMON}\nline of document {i} alone, no other\n{COMMON}") for i in range(4)]
    found = {r["id"]: r for r in line_dedup.keep_bitmaps(table(spark, rows)).collect()}
    assert set(found) == {0, 1, 2}
    for row in found.values():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(row["keep"]), np.uint8), count=row["n_lines"])
        assert bits.tolist() == [0, 1, 0] and row["n_dropped"] == 2


def test_empty_table_and_text_ids(spark):
    assert line_dedup.without_common_lines(table(spark, [])).count() == 0
    named = spark.createDataFrame([(name, COMMON) for name in "abcd"], "doc_id string, text string")
    assert {r["doc_id"] for r in line_dedup.without_common_lines(named).filter("n_dropped = 0").collect()} == {"d"}
