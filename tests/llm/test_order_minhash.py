import hashlib
import re
import struct
from collections import Counter

import xxhash
from llm_cases import EDGES, prose, table

from ticketlens.llm.order_minhash import BIN_BITS, K, PIECE, fingerprints


def chain(*parts):
    value = 42
    for part in parts:
        data = part.encode() if isinstance(part, str) else struct.pack("<q", part) if isinstance(part, int) else part
        value = xxhash.xxh64_intdigest(data, value)
    return value - (1 << 64) if value >= 1 << 63 else value


def brute_fingerprint(text):
    pieces = re.findall(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}", text)
    kmers = [chain(*pieces[i:i + K]) for i in range(max(len(pieces) - K + 1, min(len(pieces), 1)))]
    seen, bins = Counter(), {}
    for at, kmer in enumerate(kmers):
        v = chain(kmer, struct.pack("<i", seen[kmer]))
        seen[kmer] += 1
        bins.setdefault((v & (1 << 64) - 1) >> 64 - BIN_BITS, []).append((v, at))
    codes = []
    for number in sorted(bins, key=lambda b: min(bins[b])):
        least = sorted(bins[number])[:2]
        code = chain(*[v for v, _ in sorted(least, key=lambda e: e[1])])
        codes.append(f"{number:02X}{(code & (1 << 64) - 1) >> 48:04X}")
    return " ".join(codes)


def likeness(a, b):
    a, b = set(a.split()), set(b.split())
    bins = {c[:2] for c in a | b}
    return len(a & b) / len(bins) if bins else 1.0


ROWS = [(1, prose(1, 80)), (2, prose(2, 30)), (3, "same same same same other same same"), (4, ""), (5, None), (6, "ä😀 " * 9),
        (9, prose(1, 80)), (12, "x" * 500), (13, "one"), (14, prose(5, 5000, 60))]


def test_every_value_matches_brute_force(spark):
    got = {r.doc_id: r for r in fingerprints(table(spark, ROWS)).collect()}
    order = sorted(ROWS, reverse=True, key=lambda r: r[0])
    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 2
        edited = text[:len(text) - cut] + after[:cut]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == brute_fingerprint(text) and r.edited_fingerprint == brute_fingerprint(edited)
        assert r.near_edited == likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == likeness(r.fingerprint, brute_fingerprint(after))


def test_edges(spark):
    got = fingerprints(table(spark, EDGES, clashing=True)).collect()
    assert len(got) == len(EDGES)
    by_text = {}
    for r in got:
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert by_text[0] == {""} and len(by_text[len("one")]) == 1
    assert fingerprints(table(spark, [])).count() == 0
    alone = fingerprints(table(spark, [(1, "alone here and now")])).collect()[0]
    assert alone.near_next == 1.0


def test_order_matters(spark):
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:290] + ["x"] * 10), " ".join(words[150:] + words[:150]), " ".join(words[::-1])]
    prints = {r.doc_id: r.fingerprint for r in fingerprints(table(spark, list(enumerate(texts)))).collect()}
    assert likeness(prints[0], prints[1]) > likeness(prints[0], prints[2]) > likeness(prints[0], prints[3])
