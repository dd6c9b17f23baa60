"""Personal data by bootstrapped contextual extraction: seeds induce patterns, scored patterns discover what no rule describes."""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern is trusted if so many different seeds induced it and its instances reach this mean score.
LEAST_SEEDS = 5
CONFIDENCE = 0.8

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A match that could start inside a run of digits could start at its beginning, so other starts need not be tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A token with a digit and so many characters may be data of any kind; others need the shape of the kind.
_LEAST_SIZE = 6
_OUTER = "\"'()[]{}<>,;:.!?"
#: Parts of numbers that are written in groups (or masked), and addresses that are spelled out.
_GROUP = re.compile(r"[+(]*(?:[0-9]|[Xx*]{2})[0-9Xx*()./+-]*")
_AT, _DOT = frozenset(("at", "(at)", "[at]", "{at}", "@")), frozenset(("dot", "(dot)", "[dot]", "{dot}"))
_MOST_TOKENS = 8
_ADDRESS = re.compile(r"@[^@]|[^\W_][(\[{](?:at|AT|At)[)\]}][^\W_]|[^\W_][._+]++[^\W_]")
_LETTER = re.compile(r"[^\W\d_]")
_HOST = re.compile(r"[0-9A-Fa-fXx*.:]++")
#: Bits of the filters that tell a scan which places to hand on: their size is fixed, and joins drop what passes by chance.
_FILTER_BITS = 1 << 25
#: Values without the shape of any kind that a task lists for a pattern before it only notes that there are more.
PLAIN_VALUES = 16
#: Edges that a task remembers, so as not to list them again.
_MOST_KNOWN = 500_000


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        total += digit if place % 2 == 0 else (2 * digit - 9 if digit > 4 else 2 * digit)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rule-described data of a whole text in code points, by start and kind.

    Each kind's matches are leftmost and do not overlap; those that fail the
    kind's test are dropped without another try.
    """
    text = text or ""
    spans = [(start, 0, end) for start, end in _emails(text)]
    for found in _IP.finditer(text):
        if all(len(part := p.lstrip("0")) <= 3 and int(part or 0) <= 255 for p in found.group().split(".")):
            spans.append((found.start(), 1, found.end()))
    for found in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(found.group())) if found.end() - found.start() < 40 else ""
        if 14 <= len(digits) <= 19 and _luhn(digits):
            spans.append((found.start(), 2, found.end()))
    for found in _PHONE.finditer(text):
        if 10 <= len(_DIGITS.findall(found.group())) <= 15:
            spans.append((found.start(), 3, found.end()))
    return sorted(spans)


def _contexts(before: list[str], after: list[str]) -> list[str]:
    """Lexical patterns around a place: the two words before it, and the word before it with the word after it."""
    left, right = [w.lower() for w in before[-2:]], [w.lower() for w in after[:1]]
    patterns = []
    if len(left) == 2:
        patterns.append(f"{left[0]} {left[1]} _")
    if left and right:
        patterns.append(f"{left[-1]} _ {right[0]}")
    return patterns


def shapes(value: str) -> int:
    """Kinds that a value may be by its looks, as a sum of 1 << kind."""
    digits = len(_DIGITS.findall(value))
    if digits and len(value) >= _LEAST_SIZE:
        return (1 << len(KINDS)) - 1
    words = value.lower().split()
    spelled = len(words) > 1 and words[1] in _AT
    address = spelled or bool(_ADDRESS.search(value)) or (digits > 0 and bool(_LETTER.search(value)))
    host = bool(_HOST.fullmatch(value)) and value.count(".") + value.count(":") >= 2
    return address | host << 1 | (digits >= 4) << 2 | (digits >= 3) << 3


def _filled(words: list[str], i: int) -> int:
    """Number of tokens that stand together at place ``i``: groups of a number, an address that is spelled out, or one."""
    end = i
    while end < min(len(words), i + _MOST_TOKENS) and _GROUP.fullmatch(words[end].rstrip(_OUTER) if words[end][-1] != ")" else words[end]):
        end += 1
        if words[end - 1][-1] in ",;:.!?":
            break
    if end > i + 1:
        return end - i
    if i + 2 < len(words) and words[i + 1].lower() in _AT:
        end = i + 3
        while end + 1 < min(len(words), i + _MOST_TOKENS) and words[end].lower() in _DOT:
            end += 2
        if end > i + 3 or words[i + 1].lower() != "at" or "." in words[i + 2].rstrip(_OUTER):
            return end - i
    return 1


class Marks:
    """Filter of strings with a fixed size: says yes to all that it holds, and to few others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits.tobytes()

    @classmethod
    def of(cls, rows: DataFrame, column: str) -> Marks:
        bits = np.zeros(_FILTER_BITS // 8, np.uint8)
        for row in rows.select((F.crc32(F.col(column).cast("binary")) % _FILTER_BITS).alias("bit")).distinct().toLocalIterator():
            bits[row.bit >> 3] |= 1 << (row.bit & 7)
        return cls(bits)

    def __contains__(self, value: str) -> bool:
        bit = zlib.crc32(value.encode("utf-8", "replace")) % _FILTER_BITS
        return bool(self.bits[bit >> 3] >> (bit & 7) & 1)


def occurrences(text: str | None, patterns: Marks | None = None, lefts: Marks | None = None, values: Marks | None = None,
                seeds: bool = True) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, str, int, list[str]]]]:
    """Base spans, and (start, kind or -1, end, value, shapes, patterns) of every seed, and of every place outside of them that the filters hold.

    A place counts if one of its patterns is in ``patterns`` (``lefts`` has
    the words that these have just before the place), or its value is in
    ``values``. Every token is a place, whatever it looks like.
    """
    text = text or ""
    spans = base_spans(text)
    wanted = patterns is not None or values is not None
    if not spans and not wanted:
        return [], []
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    words = [text[s:e] for s, e in tokens]
    found: list[tuple[int, int, int, str, int, list[str]]] = []
    starts = [s for s, _ in tokens]
    taken: set[int] = set()
    for start, kind, end in spans:
        first, last = _before(starts, start), _before(starts, end - 1)
        taken.update(range(first, last + 1))
        if seeds:
            found.append((start, kind, end, text[start:end], 0, _contexts(words[max(0, first - 2):first], words[last + 1:last + 2])))
    known: dict[str, bool] = {}
    for i in range(len(words) if wanted else 0):
        if i in taken:
            continue
        near = False
        if lefts is not None and i:
            left = words[i - 1]
            near = known.get(left)
            if near is None:
                near = known[left] = left.lower() in lefts
        if not near and values is None:
            continue
        count = _filled(words, i)
        while count > 1 and any(k in taken for k in range(i, i + count)):
            count -= 1
        begin, end = tokens[i][0], tokens[i + count - 1][1]
        full = text[begin:end]
        inner = full.strip(_OUTER)
        if inner:
            begin += len(full) - len(full.lstrip(_OUTER))
            end = begin + len(inner)
        else:
            inner = full
        around = _contexts(words[max(0, i - 2):i], words[i + count:i + count + 1])
        if near and patterns is not None:
            held = [p for p in around if p in patterns]
            if values is None or inner not in values:
                around = held
        elif inner not in values:
            continue
        if around:
            found.append((begin, -1, end, inner, shapes(inner), around))
    return spans, found


def _before(starts: list[int], place: int) -> int:
    """Index of the last token that starts at or before a place."""
    return bisect.bisect_right(starts, place) - 1


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([*_SPAN.fields, T.StructField("value", T.StringType()), T.StructField("shapes", T.IntegerType()),
                       T.StructField("patterns", T.ArrayType(T.StringType()))])


def _read(texts: DataFrame, **filters: object) -> DataFrame:
    """id, base spans and ``occurrences`` of each text; ``filters`` are sent to every executor once."""
    schema = T.StructType([texts.schema["id"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("found", T.ArrayType(_FOUND))])
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    full = pa.struct([*span, ("value", pa.string()), ("shapes", pa.int32()), ("patterns", pa.list_(pa.string()))])
    sent = texts.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [occurrences(t.as_py(), **sent.value) for t in batch.column(1)]
            base = [[dict(zip(("start", "kind", "end"), s)) for s in spans] for spans, _ in rows]
            found = [[dict(zip(("start", "kind", "end", "value", "shapes", "patterns"), f)) for f in some] for _, some in rows]
            yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(full))], names=["id", "base", "found"])

    return texts.mapInArrow(run, schema)


def _edges(texts: DataFrame, **filters: object) -> DataFrame:
    """(pattern, value, kind, shapes), each pattern and value once."""
    return _read(texts, **filters).select(F.explode("found").alias("f")).select(
        F.explode("f.patterns").alias("pattern"), "f.value", "f.kind", "f.shapes").groupBy("pattern", "value").agg(
        F.max("kind").alias("kind"), F.max("shapes").alias("shapes"))


def _opened(texts: DataFrame, patterns: DataFrame, most_plain: int | None = None) -> DataFrame:
    """(pattern, value, kind, shapes) of what stands in the patterns outside of base spans, about once a task.

    Of values without any shape, a task lists ``most_plain`` for a pattern; a
    row of kind -2 without a value says that there are more.
    """
    sent = texts.sparkSession.sparkContext.broadcast(_filters(patterns))
    schema = pa.schema([("pattern", pa.string()), ("value", pa.string()), ("kind", pa.int32()), ("shapes", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        plain: dict[str, int] = {}
        for batch in batches:
            rows = []
            for text in batch.column(1):
                for _, kind, _, value, looks, around in occurrences(text.as_py(), seeds=False, **sent.value)[1]:
                    for pattern in around:
                        listed = plain.get(pattern, 0)
                        if (pattern, value) in seen or not looks and most_plain is not None and listed > most_plain:
                            continue
                        if not looks:
                            plain[pattern] = listed + 1
                        if not looks and listed == most_plain:
                            rows.append((pattern, "", -2, 0))
                        else:
                            seen.add((pattern, value))
                            rows.append((pattern, value, kind, looks))
            if len(seen) + len(plain) > _MOST_KNOWN:
                seen.clear()
                plain.clear()
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, schema)], schema=schema)

    return texts.mapInArrow(run, "pattern string, value string, kind int, shapes int")


def _graph(texts: DataFrame, new: DataFrame, links: DataFrame, confidence: float, label: str) -> DataFrame:
    """(pattern, value, kind, shapes), each edge of the new patterns once, without patterns that can never be trusted.

    Only instances that are seeds or have a shape can ever earn points, at most
    one each. A pattern whose other values, as far as they are listed, are too
    many for that is left out; of the rest those with more values than were
    listed are read again, in full.
    """
    def graph(opened: DataFrame, patterns: DataFrame) -> DataFrame:
        return opened.unionByName(links).join(patterns, "pattern", "left_semi").groupBy("pattern", "value").agg(
            F.max("kind").alias("kind"), F.max("shapes").alias("shapes"))

    listed = materialize(graph(_opened(texts, new, PLAIN_VALUES), new), f"{label}_listed")
    earns = (F.col("kind") >= 0) | (F.col("shapes") != 0)
    cut = listed.groupBy("pattern").agg(F.min("kind").alias("least"), F.count_if(earns).alias("able"), F.count_if(~earns & (F.col("kind") == -1)).alias("plain")).filter(
        "least = -2").select("pattern", (F.col("able") >= (confidence - 1e-9) * (F.col("able") + F.col("plain"))).alias("open"))
    cut = materialize(cut, f"{label}_cut")
    whole = listed.join(cut, "pattern", "left_anti")
    again = cut.filter("open").select("pattern")
    return whole if again.isEmpty() else whole.unionByName(graph(_opened(texts, again), again))


def _filters(patterns: DataFrame) -> dict[str, Marks]:
    # A pattern has three parts; the word just before the place is the one in front of the mark. Words may be "_" themselves.
    part = F.split("pattern", " ")
    lefts = patterns.select(F.explode(F.array(*[F.when(part[k + 1] == "_", part[k]) for k in (0, 1)])).alias("left")).filter("left is not null")
    return {"patterns": Marks.of(patterns, "pattern"), "lefts": Marks.of(lefts, "left")}


def _scored_patterns(texts: DataFrame, rounds: int, least_seeds: int, confidence: float) -> DataFrame:
    """(pattern, kind, score, seeds) of the trusted patterns, from the graph of patterns and instances.

    Patterns with enough supporters of a kind are able: seeds at first, and
    from the second round also what trusted patterns discovered, wherever it
    stands. Everything that stands in an able pattern is its instance. Seeds
    count 1 for their kind. The score of a pattern is the mean over its
    instances. Another instance counts once trusted patterns hold it and it
    has a shape of the kind: with 1 - the product of (1 - score) over them,
    otherwise 0. The graph holds each edge once, however often a text repeats
    it, and no edges of patterns that can never be trusted (``_graph``).
    """
    links = materialize(_edges(texts), "pattern_seeds")
    supporters = links.select("pattern", F.col("kind").alias("of"), "value")
    edges = opened = held = scores = None
    for turn in range(rounds):
        if turn:
            names = held.select("value").distinct()
            places = _edges(texts, values=Marks.of(names, "value"), seeds=False)
            supporters = links.select("pattern", F.col("kind").alias("of"), "value").unionByName(
                places.join(held, "value").filter(_looks("of")).select("pattern", "of", "value"))
        able = materialize(supporters.distinct().groupBy("pattern", "of").agg(F.count(F.lit(1)).alias("seeds")).filter(
            F.col("seeds") >= least_seeds), f"pattern_able_{turn}")
        patterns = able.select("pattern").distinct()
        new = patterns if opened is None else patterns.join(opened, "pattern", "left_anti")
        if not new.isEmpty():
            new = materialize(new, f"pattern_new_{turn}")
            opened = new if opened is None else opened.unionByName(new)
            found = _graph(texts, new, links, confidence, f"pattern_{turn}")
            edges = materialize(found if edges is None else edges.unionByName(found), f"pattern_graph_{turn}")
        elif edges is None:
            return able.select("pattern", F.col("of").alias("kind"), F.lit(0.0).alias("score"), "seeds")
        points = edges.filter("kind >= 0").select("pattern", F.col("kind").alias("of"), F.lit(1.0).alias("points"))
        if held is not None:
            points = points.unionByName(edges.filter("kind < 0").join(held, "value").filter(_looks("of")).select(
                "pattern", "of", F.col("held").alias("points")))
        sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
        scores = materialize(able.join(sizes, "pattern").join(points.groupBy("pattern", "of").agg(F.sum("points").alias("points")), ["pattern", "of"]).select(
            "pattern", "of", "seeds", (F.col("points") / F.col("size")).alias("score")), f"pattern_scores_{turn}").filter(F.col("score") >= confidence)
        held = materialize(edges.filter("kind < 0").join(scores, "pattern").filter(_looks("of")).groupBy("value", "of").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.99)))))).alias("held")), f"pattern_held_{turn}")
        if held.isEmpty():
            break
    return scores.select("pattern", F.col("of").alias("kind"), "score", "seeds")


def _looks(kind: str) -> Column:
    """Whether a kind is among the shapes of an instance."""
    return F.expr(f"shiftright(shapes, {kind}) & 1 = 1")


def extract(docs: DataFrame, id_column: str = "doc_id", text: str = "text", rounds: int = ROUNDS, least_seeds: int = LEAST_SEEDS,
            confidence: float = CONFIDENCE) -> DataFrame:
    """One row per input row: id, ``base`` and ``discovered``, arrays of (start, kind, end) in code points.

    ``base`` holds what the rules of the kinds describe. These spans are the
    seeds: the words around them form patterns. A pattern that at least
    ``least_seeds`` different supporters of one kind stand in is scored with
    all that stands in it, ordinary words too, over ``rounds`` rounds; it is
    trusted if its score reaches ``confidence``. What stands in a trusted
    pattern, has a shape of its kind and touches no base span is
    ``discovered``, under the pattern's best kind, and supports other patterns
    in the next round. A place holds one token, or a number in groups or an
    address spelled out over at most eight tokens.

    Null and empty texts have no spans. Rows repeated under one id are read
    one by one; the graph counts a value once per pattern, so that copies do
    not make a pattern look better.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    trusted = materialize(_scored_patterns(texts, rounds, least_seeds, confidence), "private_trusted")
    filters = {} if trusted.isEmpty() else _filters(trusted)
    read = materialize(_read(texts, seeds=False, **filters).withColumn("row", F.monotonically_increasing_id()), "private_occurrences")
    found = read.select("row", F.explode("found").alias("f")).select("row", "f.*")
    unseen = found.select("row", "start", "end", "shapes", F.explode("patterns").alias("pattern"))
    best = unseen.join(trusted, "pattern").filter(_looks("kind")).groupBy("row", "start", "end").agg(
        F.max(F.struct("score", (-F.col("kind")).alias("kind"))).alias("best"))
    discovered = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", (-F.col("best.kind")).alias("kind"), "end"))).alias("discovered"))
    return read.select("id", "row", "base").join(discovered, "row", "left").select(
        F.col("id").alias(id_column), "base", F.coalesce("discovered", F.array().cast(T.ArrayType(_SPAN))).alias("discovered"))


def written(spans: Column) -> Column:
    """kind:start:end of each span by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
