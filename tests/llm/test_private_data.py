import random
import re

from llm_cases import EDGES, table

from ticketlens.llm import private_data as P


def plain(text):
    """The rules as they are written, with the plainest means."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def test_rules_match_plain_search():
    maker = random.Random(3)
    pieces = ["a@b.co", "x.y+z@mail-1.example.com", "@", ".", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "300.1.1.1",
              "12", "0", " ", "-", "é", "a", "@c.d", "_", "1.2.3.4.5.6.7.8", "+", "0012.1.1.1", "()", "\n", "79927398713", "4242-4242-4242-4242"]
    for _ in range(4000):
        text = "".join(maker.choice(pieces) for _ in range(maker.randrange(12)))
        assert P.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 300_000, "1" * 300_000, "a." * 150_000 + "@", "1 " * 150_000, "+1" * 150_000):
        P.occurrences(run)


def test_trusted_context_discovers_unseen_identifiers(spark):
    rows = [(i, f"please call +1 555 010 {1000 + i} today or write") for i in range(8)]
    rows += [(50, "please call ext-99887 today or write"), (51, "the order ext-99887 was late"), (52, "plain words only"), (53, None)]
    got = {r.doc_id: r for r in P.extract(table(spark, rows)).collect()}
    text = rows[8][1]
    start = text.index("ext-99887")
    assert [(s.start, s.kind, s.end) for s in got[50].discovered] == [(start, 3, start + 9)]
    assert all(not got[i].discovered for i in (51, 52, 53)) and all(len(got[i].base) == 1 for i in range(8))


def test_pattern_with_mixed_instances_is_not_trusted(spark):
    rows = [(i, f"see item +1 555 010 {1000 + i} for more") for i in range(6)] + [(20 + i, f"see item part{i}-771 for more") for i in range(6)]
    assert all(not r.discovered for r in P.extract(table(spark, rows)).collect())


def test_edges(spark):
    got = P.extract(table(spark, EDGES + [(70, "mail a@b.co"), (70, "mail a@b.co")], clashing=True)).collect()
    assert len(got) == len(EDGES) + 2 and sum(len(r.base) for r in got) == 2
    assert P.extract(table(spark, [])).count() == 0
    written = P.extract(table(spark, [(1, "é a@b.co +1 555 010 1000")])).select(P.written("base").alias("w"), P.count_of("base", "phone").alias("n")).first()
    assert (written.w, written.n) == ("email:2:8,phone:9:24", 1)


def test_identifiers_of_any_shape_are_discovered(spark):
    rows = [(i, f"please write mail{i}@example.org for details") for i in range(40)] + [(100 + i, f"please call +1 555 010 {1000 + i} today") for i in range(40)]
    unseen = {200: "jane.doe(at)mail.org", 201: "user@localhost", 202: "@jane", 203: "jane at mail dot org"}
    numbers = {300: "4711", 301: "555 010 99", 302: "0049 30 123"}
    rows += [(i, f"please write {v} for details") for i, v in unseen.items()] + [(i, f"please call {v} today") for i, v in numbers.items()]
    rows += [(400, "please write something for details"), (401, "please call later today")]
    got = {r.doc_id: r for r in P.extract(table(spark, rows)).collect()}
    for kind, values in ((0, unseen), (3, numbers)):
        for i, value in values.items():
            start = dict(rows)[i].index(value)
            assert [(s.start, s.kind, s.end) for s in got[i].discovered] == [(start, kind, start + len(value))], value
    assert not got[400].discovered and not got[401].discovered


def test_ordinary_words_count_against_a_pattern(spark):
    rows = [(i, f"so call +1 555 010 {1000 + i} now") for i in range(8)] + [(20 + i, f"so call {w} now") for i, w in enumerate(["him", "her", "them", "us"])]
    rows += [(50, "so call ext-99887 now")]
    assert all(not r.discovered for r in P.extract(table(spark, rows)).collect())


def test_discovered_instances_support_further_patterns(spark):
    rows = [(i, f"please call +1 555 010 {1000 + i} today") for i in range(40)] + [(100 + i, f"please call ext-9988{i} today") for i in range(6)]
    rows += [(200 + i, f"my desk ext-9988{i} rings") for i in range(6)] + [(300, "my desk ext-77001 rings")]
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.discovered] for r in P.extract(table(spark, rows)).collect()}
    assert got[300] == [(8, 3, 17)] and got[203] == [(8, 3, 17)]


def test_shapes_take_linear_time():
    every = P.Marks(P.np.full(P._FILTER_BITS // 8, 255, P.np.uint8))
    for run in ("a" * 300_000, "a." * 150_000 + "!", ":" * 300_000 + "!", "1 " * 50_000, "x at " * 50_000, "@" * 300_000):
        P.occurrences(f"to {run}", every, every, every)


def test_ordinary_words_of_a_hopeless_pattern_are_not_all_listed(spark, monkeypatch):
    calls = [f"so call +1 555 010 {1000 + i} now" for i in range(8)] + [f"so call word{chr(97 + i % 26)}{chr(97 + i // 26)} now" for i in range(400)]
    rows = [(i, "\n".join(calls[i::4])) for i in range(4)]
    sizes, whole = [], P._graph

    def seen(*parts):
        graph = whole(*parts)
        sizes.append(graph.count())
        return graph

    monkeypatch.setattr(P, "_graph", seen)
    assert all(not r.discovered for r in P.extract(table(spark, rows)).collect()) and sizes == [0]


def test_pattern_with_more_words_than_listed_is_read_in_full(spark, monkeypatch):
    monkeypatch.setattr(P, "PLAIN_VALUES", 1)
    rows = [(0, "\n".join([f"please call +1 555 010 {1000 + i} today" for i in range(60)] + [f"please call {w} today" for w in ("him", "her", "them", "us")]))]
    rows += [(50, "please call ext-99887 today")]
    got = {r.doc_id: r for r in P.extract(table(spark, rows)).collect()}
    assert [(s.start, s.kind, s.end) for s in got[50].discovered] == [(12, 3, 21)]
    rows[0] = (0, rows[0][1] + "".join(f"\nplease call {chr(97 + i)} today" for i in range(20)))
    assert all(not r.discovered for r in P.extract(table(spark, rows)).collect())
