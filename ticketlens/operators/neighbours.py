"""Near-duplicate texts: token sets, similar pairs, connected components, duplicate groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions.fragments import cells, different_bits, parity_bitmap
from ticketlens.functions.text import normalize_casefold, token_set
from ticketlens.operators.scaling import attach_by_key, perhaps_in
from ticketlens.session import materialize

THRESHOLD = 0.85
_SLACK = 1e-9
#: Rows of one token that are chained in one task; a longer list is cut into lanes.
CHAIN_ROWS = 8_192
#: Edges of a graph whose components one task finds.
SMALL_EDGES = 10_000


@dataclass(frozen=True)
class TokenSets:
    """Rows reduced to their distinct token sets.

    ``rows``: id, normalised text and ``set_key``. ``sets``: one row per
    distinct non-empty set with its key, sorted tokens, the smallest id that
    has it (``rep``) and the number of rows that have it (``copies``).
    """

    rows: DataFrame
    sets: DataFrame


def _keyed(texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, normal, _tokens, set_key): each text with the key of its token set, null without tokens."""
    normal = texts.select(F.col(id_column).alias("id"), normalize_casefold(F.col(text)).alias("normal"))
    tokens = normal.withColumn("_tokens", F.array_join(token_set("normal"), " "))
    return tokens.withColumn("set_key", F.when(F.col("_tokens") != "", F.sha2("_tokens", 256)))


def token_sets(texts: DataFrame, id_column: str, text: str) -> TokenSets:
    """Collapse rows with equal token sets, so that copies never meet each other in a join."""
    rows = materialize(_keyed(texts, id_column, text).select("id", "normal", "set_key", "_tokens"), "token_rows")
    sets = (
        rows.filter(F.col("set_key").isNotNull()).groupBy("set_key")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("_tokens").alias("_tokens"))
        .select("set_key", "rep", "copies", F.split("_tokens", " ").alias("tokens"))
        .withColumn("size", F.size("tokens"))
    )
    return TokenSets(rows.drop("_tokens"), materialize(sets, "token_sets"))


def _required_overlap(a: Column, b: Column, threshold: float) -> Column:
    return F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - _SLACK)


def _sketched(sets: DataFrame, schema: str, sketch) -> DataFrame:
    """Rows that ``sketch`` makes of (reps, sizes, hashes of each set in ascending order), one Arrow batch at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, at = lists.flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            hashed = [np.unique(values[start:end]) for start, end in zip(at, at[1:])]
            yield sketch(batch.column(0), batch.column(1), hashed)

    hashes = F.transform("tokens", lambda token: F.xxhash64(token))
    return sets.select("rep", "size", hashes.alias("hashes")).mapInArrow(run, f"rep {sets.schema['rep'].dataType.simpleString()}, {schema}")


def shared_fragments(sets: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rep, size, token) of the fragments that a set shares with any other set, and (rep, bits), the bitmaps of these sets.

    A fragment is a part of the set in the order of the hashes of its tokens;
    two sets with a similarity of at least ``threshold`` agree in a whole one
    (``fragments.cells``), named by ``token``. It holds several tokens, so that
    unrelated texts seldom share one, however frequent their words are.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    percent = max(1, math.floor(threshold * 100 + _SLACK))  # a lower one finds more

    def cut(reps: pa.Array, sizes: pa.Array, hashed: list[np.ndarray]) -> pa.RecordBatch:
        keys = [np.unique(cells(tokens, percent)) for tokens in hashed]
        row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        tokens = np.concatenate(keys or [np.empty(0, np.uint64)]).view(np.int64)
        return pa.record_batch([reps.take(pa.array(row)), sizes.take(pa.array(row)), pa.array(tokens)], names=["rep", "size", "token"])

    def sign(reps: pa.Array, sizes: pa.Array, hashed: list[np.ndarray]) -> pa.RecordBatch:
        return pa.record_batch([reps, pa.array([parity_bitmap(tokens) for tokens in hashed], pa.list_(pa.int64()))], names=["rep", "bits"])

    met = F.count(F.lit(1)).over(Window.partitionBy("token"))
    cut_sets = _sketched(sets, "size int, token bigint", cut).withColumn("_sets", met).filter("_sets > 1")
    shared = materialize(cut_sets.select("rep", "size", "token"), "fragments")
    rep = F.xxhash64("rep")
    signed = _sketched(perhaps_in(sets, rep, shared, rep), "bits array<bigint>", sign)
    return shared, materialize(signed, "bitmaps")


def prefixes(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, size, token, bits): :func:`shared_fragments` with the bitmap of their set."""
    shared, signed = shared_fragments(sets, threshold)
    return materialize(shared.join(signed, "rep"), "prefixes")


def _sizes_fit(threshold: float) -> Column:
    size_a, size_b = F.col("size_a"), F.col("size_b")
    return (size_a >= size_b * F.lit(threshold) - _SLACK) & (size_b >= size_a * F.lit(threshold) - _SLACK)


def _may_be_similar(threshold: float) -> Column:
    """Bounds on two rows of one fragment, named _a and _b, that no similar pair misses.

    They are those of the sizes and of the bitmaps, which count the tokens that must differ.
    """
    size_a, size_b = F.col("size_a"), F.col("size_b")
    return (
        _sizes_fit(threshold)
        & (size_a + size_b - different_bits(F.col("bits_a"), F.col("bits_b")) >= _required_overlap(size_a, size_b, threshold) * 2)
    )


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "ab")


def _scored(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (rep_a, rep_b) of ``candidates`` that are similar, by their whole sets; only sets of candidates are moved."""
    candidates = materialize(candidates, "candidates")
    rep = F.xxhash64("rep")
    reps = candidates.select(F.explode(F.array("rep_a", "rep_b")).alias("rep"))
    one, two = _sides(perhaps_in(sets.select("rep", "tokens", "copies", "size"), rep, reps, rep))
    met = candidates.join(one, "rep_a").join(two, "rep_b")
    # A generated column is computed once; a plain one would be repeated in the filter below.
    counted = met.select("rep_a", "rep_b", "copies_a", "copies_b", "size_a", "size_b",
                         F.explode(F.array(F.size(F.array_intersect("tokens_a", "tokens_b")))).alias("_overlap"))
    scored = counted.withColumn("_score", F.col("_overlap") / (F.col("size_a") + F.col("size_b") - F.col("_overlap")))
    return scored.filter(F.col("_score") >= threshold).select(
        "rep_a", "rep_b", "copies_a", "copies_b", F.round("_score", 6).alias("jaccard"))


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of distinct token sets with Jaccard similarity of at least ``threshold``.

    Only fragments are joined; a pair also has to pass the bounds of its sizes
    and bitmaps before it leaves the join and its sets are intersected.
    The result is exact. Where only groups are wanted, :func:`spanning_links`
    gives them without all pairs.
    """
    left, right = _sides(prefixes(sets, threshold))
    meet = (F.col("token_a") == F.col("token_b")) & (F.col("rep_a") < F.col("rep_b"))
    candidates = left.join(right, meet & _may_be_similar(threshold)).select("rep_a", "rep_b").distinct()
    return _scored(candidates, sets, threshold)


def _bounded(pairs: DataFrame, bitmaps: DataFrame, threshold: float) -> DataFrame:
    """Those of the distinct pairs (rep_a, size_a, rep_b, size_b) that may be similar."""
    one, two = _sides(bitmaps)
    return pairs.join(one, "rep_a").join(two, "rep_b").filter(_may_be_similar(threshold)).select("rep_a", "rep_b")


def chained(rows: DataFrame, threshold: float, bitmaps: DataFrame | None = None) -> DataFrame:
    """(rep_a, rep_b): every row of :func:`prefixes` next to the row before it and to the first one of its token, if the pair may be similar.

    Rows of a token lie by size. A list of more than CHAIN_ROWS rows is chained in lanes. Of all that a
    set meets, its smallest and its largest smaller partner stay: at most two pairs for each set. ``bitmaps`` (rep, bits) may stand beside the rows; pairs are
    made distinct before they meet them.
    """
    if bitmaps is None:
        bitmaps = rows.select("rep", "bits").distinct()
    rows = rows.select("rep", "size", "token")
    lanes = rows.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CHAIN_ROWS).alias("_lanes"))
    laned = attach_by_key(rows, lanes, "token", ["rep", "token"]).withColumn("_lane", F.pmod(F.xxhash64("rep"), F.col("_lanes")))
    together = Window.partitionBy("token", "_lane").orderBy("size", "rep")
    item = F.struct("rep", "size")
    beside = laned.withColumns({"_own": item, "_before": F.lag(item).over(together), "_first": F.first(item).over(together)})
    pairs = beside.filter(F.col("_before").isNotNull()).select("_own", F.explode(F.array("_before", "_first")).alias("_other")).select(
        *[F.when(F.col("_own.rep") < F.col("_other.rep"), F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}")).alias(f"{c}_{side}")
          for side, x, y in (("a", "_own", "_other"), ("b", "_other", "_own")) for c in ("rep", "size")])
    near = _bounded(pairs.filter(_sizes_fit(threshold)).distinct(), bitmaps, threshold)
    ends = near.groupBy("rep_b").agg(F.min("rep_a").alias("_low"), F.max("rep_a").alias("_high"))
    return ends.select(F.explode(F.array_distinct(F.array("_low", "_high"))).alias("rep_a"), "rep_b")


def between_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep_a, rep_b) of all rows (with their ``component``) of one token and different groups that may be similar."""
    left, right = _sides(rows)
    meet = (F.col("token_a") == F.col("token_b")) & (F.col("rep_a") < F.col("rep_b")) & (F.col("component_a") != F.col("component_b"))
    return left.join(right, meet & _may_be_similar(threshold)).select("rep_a", "rep_b").distinct()


def spanning_links(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(rep_a, rep_b): similar pairs that connect the same groups of sets as all similar pairs do.

    In rounds, neighbours in the list of each token are compared, at most two
    pairs for a set; then one row of each group stays in each list, and lists of
    one group alone are left out, until no round links anything. At last all rows of different groups that share a
    token meet, and bounds drop nearly all of those pairs inside the join. Pairs inside
    a group are never formed, so a group of many near copies costs as many
    pairs as it has rows. The groups are exact.
    """
    shared, signed = shared_fragments(sets, threshold)
    vertices = sets.select("rep")
    links = materialize(vertices.select(F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).limit(0), "links")
    rows, placed = shared, shared.withColumn("component", F.col("rep"))
    while True:
        new = materialize(_scored(chained(rows, threshold, signed), sets, threshold).select("rep_a", "rep_b"), "links")
        if new.isEmpty():
            break
        links = links.unionByName(new)
        groups = materialize(connected_components(links, "rep_a", "rep_b").withColumnRenamed("vertex", "rep"), "groups")
        named = placed.drop("component").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        list_of = Window.partitionBy("token")
        ends = named.withColumns({"_low": F.min("component").over(list_of), "_high": F.max("component").over(list_of)})
        placed = materialize(ends.filter("_low < _high").select("rep", "size", "token", "component"), "placed")
        rows = placed.groupBy("token", "component").agg(F.min(F.struct("rep", "size")).alias("_lead")).select("_lead.*", "token")
    last = _scored(between_groups(placed.join(signed, "rep"), threshold), sets, threshold).select("rep_a", "rep_b")
    return links.unionByName(last)


def copies_of(prepared: TokenSets) -> DataFrame:
    """Every row that repeats the token set of an earlier row, next to that row."""
    facts = prepared.sets.filter("copies > 1").select("set_key", "rep", "copies")
    return _beside(prepared.rows.filter(F.col("set_key").isNotNull()).select("id", "set_key"), facts)


def text_copies(texts: DataFrame, id_column: str, text: str) -> DataFrame:
    """:func:`copies_of` where nothing else is asked for: keys alone are written and grouped, neither texts nor tokens."""
    # The filter stays behind the written keys, else it would be pushed below and cut every text again.
    rows = materialize(_keyed(texts, id_column, text).select("id", "set_key"), "set_keys").filter(F.col("set_key").isNotNull())
    facts = rows.groupBy("set_key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return _beside(rows, facts)


def _beside(rows: DataFrame, facts: DataFrame) -> DataFrame:
    return attach_by_key(rows, facts, "set_key", ["id"]).filter("id <> rep").select(F.col("rep").alias("rep"), "id")


def near_pair_totals(prepared: TokenSets, pairs: DataFrame, labels: DataFrame, id_column: str, label: str) -> DataFrame:
    """Number of similar row pairs and of those with different labels, without listing them.

    Rows are counted per (token set, label). Pairs inside a set and across
    similar sets follow from these counts; pairs of equal label are subtracted.
    """
    named = prepared.rows.filter(F.col("set_key").isNotNull()).select("id", "set_key").join(
        labels.select(F.col(id_column).alias("id"), F.col(label).alias("_label")), "id")
    counts = materialize(
        named.groupBy("set_key", "_label").agg(F.count(F.lit(1)).alias("n"))
        .join(prepared.sets.select("set_key", "rep", "copies"), "set_key").select("rep", "copies", "_label", "n"), "set_labels")

    def pairs_in(n: Column) -> Column:
        return (n * (n - 1) / 2).cast("bigint")

    within = prepared.sets.agg(F.coalesce(F.sum(pairs_in(F.col("copies"))), F.lit(0)).alias("n"))
    within_same = counts.agg(F.coalesce(F.sum(pairs_in(F.col("n"))), F.lit(0)).alias("n"))
    across = pairs.agg(F.coalesce(F.sum(F.col("copies_a") * F.col("copies_b")), F.lit(0)).alias("n"))
    one = counts.select(F.col("rep").alias("rep_a"), F.col("_label").alias("_label_a"), F.col("n").alias("_n_a"))
    two = counts.select(F.col("rep").alias("rep_b"), F.col("_label").alias("_label_b"), F.col("n").alias("_n_b"))
    across_same = (pairs.join(one, "rep_a").join(two, "rep_b").filter(F.col("_label_a").eqNullSafe(F.col("_label_b")))
                   .agg(F.coalesce(F.sum(F.col("_n_a") * F.col("_n_b")), F.lit(0)).alias("n")))
    totals = within.select((F.col("n") + across.scalar()).alias("near_pairs"),
                           (within_same.scalar() + across_same.scalar()).alias("_same"))
    return totals.select("near_pairs", (F.col("near_pairs") - F.col("_same")).alias("conflicting_pairs"))


def _joined_up(edges: DataFrame) -> DataFrame:
    """(vertex, component) of a small graph of edges (u, v), by union and find."""
    vertex = edges.schema["u"].dataType

    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent, kind = {}, None

        def root(x: object) -> object:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                low, high = sorted((root(u), root(v)))
                parent[high] = low
        if parent:
            yield pa.record_batch([pa.array(list(parent), kind), pa.array([root(x) for x in parent], kind)], names=["vertex", "component"])

    return edges.coalesce(1).mapInArrow(connect, T.StructType([T.StructField("vertex", vertex), T.StructField("component", vertex)]))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(vertex, component) for every vertex with an edge; a component is named by its smallest vertex.

    Alternates large-star and small-star steps (Kiveris et al. 2014), which
    need a logarithmic number of rounds in practice. Each round writes the edge
    set to the shared scratch folder, so that a lost executor costs one round.
    Hubs meet their minimum through a skew-safe join. The rounds end as soon as
    every component is a star around its smallest vertex. A graph of at most
    SMALL_EDGES edges is finished in one task, as each round costs several jobs.
    """
    current = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
        lowest = both.groupBy("u").agg(F.min("v").alias("_low")).withColumn("_low", F.least("u", "_low"))
        met = attach_by_key(both, lowest, "u", ["u", "v"])
        if large:
            moved = met.filter("v > u").select(F.col("v").alias("u"), F.col("_low").alias("v"))
        else:
            moved = met.select(F.col("v").alias("u"), F.col("_low").alias("v")).unionByName(
                lowest.select("u", F.col("_low").alias("v")))
        return moved.filter("u <> v").distinct()

    def settled(links: DataFrame) -> bool:
        """Whether all links are stars: every vertex has one parent or is one, never both."""
        roles = links.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(
            links.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        seen = roles.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
        return seen.agg(F.coalesce(F.max(F.col("child") + F.col("parent")), F.lit(0))).first()[0] <= 1

    if current.count() <= SMALL_EDGES:
        return _joined_up(current)
    while not settled(current):  # every round of a graph that is no set of stars yet moves links to smaller vertices
        current = materialize(star(star(current, True), False), "edges")
    members = current.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return members.unionByName(members.select(F.col("component").alias("vertex"), "component").distinct())


def duplicate_groups(prepared: TokenSets, pairs: DataFrame) -> DataFrame:
    """(id, normal, duplicate_group): a digest of the smallest normalised text of the component.

    ``pairs`` are all similar pairs or, with the same result, the spanning links.
    Rows without any word have no token set; equal texts among them still share
    a group, because the digest is taken of the text. A row alone in its
    component has the digest of its own text, so only texts of larger
    components are moved.
    """
    components = connected_components(pairs, "rep_a", "rep_b")
    sets = prepared.sets.select("set_key", "rep", "copies").join(components, F.col("rep") == F.col("vertex"), "left")
    several = materialize(sets.filter((F.col("copies") > 1) | F.col("component").isNotNull()).select(
        "set_key", "copies", F.coalesce("component", "rep").alias("component")), "several")
    key = F.xxhash64("set_key")
    known = perhaps_in(prepared.rows.filter(F.col("set_key").isNotNull()).select("set_key", "normal"), key, several, key)
    smallest = known.groupBy("set_key").agg(F.min("normal").alias("_text"))
    names = several.join(smallest, "set_key").groupBy("component").agg(F.sha2(F.min("_text"), 256).alias("duplicate_group"))
    named = attach_by_key(several, names, "component", ["set_key"])
    facts = materialize(named.select("set_key", "duplicate_group"), "set_groups")
    rows = prepared.rows.withColumn("_own", F.sha2("normal", 256))
    joined = attach_by_key(rows, facts, "set_key", ["id"])
    return joined.select("id", "normal", F.coalesce("duplicate_group", "_own").alias("duplicate_group"))
