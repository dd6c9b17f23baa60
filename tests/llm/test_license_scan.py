import random
from functools import lru_cache

from llm_cases import EDGES, prose, table

from ticketlens.llm import license_scan as L


def brute_align(a, b):
    """Patience alignment by trying every chain of anchors."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(0, 0)] + [(i + 1, j + 1) for i, j in brute_align(a[1:], b[1:])]
    if a[-1] == b[-1]:
        return brute_align(a[:-1], b[:-1]) + [(len(a) - 1, len(b) - 1)]
    anchors = [(i, b.index(w)) for i, w in enumerate(a) if a.count(w) == 1 and b.count(w) == 1]

    @lru_cache(None)
    def longest(k, floor):
        if k == len(anchors):
            return 0
        skip = longest(k + 1, floor)
        return max(skip, 1 + longest(k + 1, anchors[k][1])) if anchors[k][1] > floor else skip

    return len(anchors) and longest(0, -1)


def test_alignment_is_a_common_subsequence_with_the_longest_chain():
    maker = random.Random(1)
    for _ in range(400):
        a, b = ([maker.choice("abcdefgh") for _ in range(maker.randrange(10))] for _ in range(2))
        pairs = L.patience_align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        if a and b and a[0] != b[0] and a[-1] != b[-1]:
            assert len(pairs) >= brute_align(a, b)
        assert L.patience_align(a, a) == [(i, i) for i in range(len(a))]


def test_findings_with_places(spark):
    mit = L.TEMPLATES["mit-terms"]
    changed = mit.replace("without restriction", "with no restriction").replace("free of charge", "gratis")
    rows = [(1, f"{prose(1, 50)}\n{mit}\n{prose(2, 50)}"), (2, f"{prose(3, 200)} {changed}"), (3, "Released under the MIT License."),
            (4, prose(4, 300) + " license version software the")]
    got = {r.doc_id: r.licenses for r in L.scan_licenses(table(spark, rows)).collect()}
    assert [(x.template, x.coverage) for x in got[1]] == [("mit-terms", 1.0)]
    text = rows[0][1]
    assert text[got[1][0].start:got[1][0].end] == mit.rstrip(".")
    assert [x.template for x in got[2]] == ["mit-terms"] and 0.9 < got[2][0].coverage < 1
    assert [x.template for x in got[3]] == ["mit-line"] and not got[4]


def test_edges(spark):
    got = L.scan_licenses(table(spark, EDGES, clashing=True)).collect()
    assert len(got) == len(EDGES) and not any(r.licenses for r in got)
    assert L.scan_licenses(table(spark, [])).count() == 0


def altered(name, places, word="altered"):
    words = L.TEMPLATES[name].split()
    return " ".join(f"{word}{k}" if k in places else w for k, w in enumerate(words))


def test_altered_rare_words_are_no_loss():
    """Every tenth place changed, at each of ten shifts, so that each word of a template is changed at some shift; and all rare words at once."""
    scanner = L.Scanner(L.TEMPLATES)
    spread = L.Counter(w for words in scanner.templates.values() for w in set(words))
    for name in ("apache-2.0-notice", "bsd-2-clause-terms", "gpl-3.0-notice", "mit-terms"):
        words = scanner.templates[name]
        rare = sorted(set(words), key=lambda w: (spread[w], words.count(w), -len(w), w))[:8]
        changed = " ".join(f"changed{k}" if w in rare else w for k, w in enumerate(words))
        for text in [changed, *(altered(name, range(shift, 200, 10)) for shift in range(10))]:
            got = [(n, c) for _, _, n, c in scanner.scan(f"{prose(1, 80)} {text} {prose(2, 80)}")]
            assert name in [n for n, _ in got] and all(c >= 0.8 for _, c in got), (name, text)


def test_long_insertion_in_the_middle():
    scanner = L.Scanner(L.TEMPLATES)
    for name in ("apache-2.0-notice", "bsd-2-clause-terms", "gpl-3.0-notice", "mit-terms"):
        words = L.TEMPLATES[name].split()
        for share in (0.3, 0.5, 0.7, 0.9):
            half = len(words) // 2
            text = " ".join([*words[:half], prose(3, int(share * len(words))), *words[half:]])
            assert [(n, c) for _, _, n, c in scanner.scan(f"{prose(4, 60)} {text} {prose(5, 60)}")] == [(name, 1.0)], (name, share)


def test_passages_are_all_that_share_enough_words():
    maker = random.Random(2)
    scanner = L.Scanner({"t": "a b c a d e"})
    for _ in range(500):
        words = [maker.choice("abcdexyz") for _ in range(25)]
        spans = scanner.passages("t", words)
        for low in range(25):
            for high in range(low + 1, min(25, low + 12) + 1):
                if sum((L.Counter(words[low:high]) & scanner.counts["t"]).values()) >= 5 and words[high - 1] in scanner.counts["t"]:
                    assert any(x <= low and y == high or x <= min(k for k in range(low, high) if words[k] in "abcde") and y == high for x, y in spans)


def test_altered_copies_side_by_side():
    text = f"{altered('gpl-3.0-notice', (20,))} {altered('gpl-3.0-notice', (40,))} {altered('gpl-3.0-notice', (60,))}"
    got = L.Scanner(L.TEMPLATES).scan(text)
    assert [n for _, _, n, _ in got] == ["gpl-3.0-notice"] * 3 and all(c > 0.97 for *_, c in got)
