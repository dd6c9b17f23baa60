"""Prefix trie of conversations, rolled up by centroid decomposition of the forest of its parent edges."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import attach
from ticketlens.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
FAMILY = 20
HEADS = 4
#: Turns of one conversation that are numbered and summed together.
BLOCK = 512
#: Conversation ids of one piece of a list of ids.
ID_RANGE = 8192
#: Nodes of a component that one task decomposes on its own; larger ones are split by Spark first.
LOCAL_NODES = 20_000
ROOT = "0" * 32


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its family: the checksum of its decimal id modulo ``HEADS``."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEADS).cast("int")


def _numbered(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, words): the turns in order, numbered from 1; equal turn numbers are ordered by role, then digest.

    Turns are range-partitioned by conversation and turn, so that a
    conversation of any length is spread, and numbered inside a range; the
    sizes of its parts in the ranges before are added. There is at most one
    such part for each conversation and range.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn"), role.alias("role"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("words"))
    order = [F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    ranged = materialize(turns.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    sizes = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order))
    return ranged.withColumn("inside", inside).join(starts, ["conv", "part"]).select(
        "conv", (F.col("start") + F.col("inside")).alias("pos"), "digest", "words")


def _rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, depth, digest, words): first turns from the head of the family, then the own turns after as many."""
    convs = turns.select("conv").distinct().withColumn("head", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", head_turns(F.col("conv")))
    heads = turns.filter((F.col("pos") < HEADS) & (F.col("conv") % FAMILY == 0)).select(F.col("conv").alias("head"), "pos", "digest", "words")
    taken = heads.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    facts = convs.join(taken, "head", "left").select("conv", F.least("h", F.coalesce("n", F.lit(0))).alias("shared"))
    own = turns.withColumn("h", head_turns(F.col("conv"))).filter(F.col("pos") > F.col("h"))
    after = attach(own, facts, "conv", F.col("pos")).select(
        "conv", (F.col("shared") + F.col("pos") - F.col("h")).cast("bigint").alias("depth"), "digest", "words")
    return convs.join(heads, "head").filter(F.col("pos") <= F.col("h")).select(
        "conv", F.col("pos").cast("bigint").alias("depth"), "digest", "words").unionByName(after)


def _name(a: Column, b: Column) -> Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def _paths(rebuilt: DataFrame) -> DataFrame:
    """(conv, depth, node, parent, words): the nodes that each rebuilt conversation passes, without the root.

    A node is named by 128 bits: each turn is hashed with its depth, and the
    running exclusive or over a conversation names the sequence so far. It is
    taken inside blocks of turns, with the blocks before added.
    """
    coded = rebuilt.select("conv", "depth", "words", F.floor(F.col("depth") / BLOCK).alias("block"),
                           F.xxhash64("depth", "digest").alias("a"), F.xxhash64("digest", "depth").alias("b"))
    sums = coded.groupBy("conv", "block").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    starts = sums.select("conv", "block", *[F.coalesce(F.bit_xor(c).over(earlier), zero).alias(f"{c}0") for c in "ab"])
    upto = Window.partitionBy("conv", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = coded.select("conv", "depth", "words", "block", "a", "b", *[F.bit_xor(c).over(upto).alias(f"{c}1") for c in "ab"]).join(starts, ["conv", "block"])
    here = [F.col(f"{c}0").bitwiseXOR(F.col(f"{c}1")) for c in "ab"]
    return run.select("conv", "depth", "words", _name(*here).alias("node"),
                      _name(*[x.bitwiseXOR(F.col(c)) for x, c in zip(here, "ab")]).alias("parent"))


class _Forest:
    """Components of nodes small enough for one task, decomposed at their centroids until single nodes are left."""

    def __init__(self, parents: list[int], values: np.ndarray):
        self.parents, self.values = parents, values
        self.children: list[list[int]] = [[] for _ in parents]
        self.sums = np.zeros_like(values)
        self.cut = [False] * len(parents)
        for node, parent in enumerate(parents):
            if parent >= 0:
                self.children[parent].append(node)

    def _component(self, top: int) -> list[int]:
        """Nodes below ``top`` that no cut node separates from it, parents first."""
        found = [top]
        for node in found:
            found.extend(c for c in self.children[node] if not self.cut[c])
        return found

    def decompose(self, tops: list[int]) -> np.ndarray:
        """Sums over the subtree of every node, within the components of ``tops``."""
        waiting = [(top, self._component(top)) for top in tops]
        while waiting:
            top, nodes = waiting.pop()
            size = dict.fromkeys(nodes, 1)
            for node in reversed(nodes[1:]):
                size[self.parents[node]] += size[node]
            centroid, half = top, len(nodes) / 2
            # The deepest node that has more than half of the component below or at it.
            for node in nodes:
                if size[node] > half:
                    centroid = node
            self.cut[centroid] = True
            below = [c for c in self.children[centroid] if not self.cut[c]]
            parts = [(c, self._component(c)) for c in below]
            total = self.values[centroid] + sum((self.values[part].sum(axis=0) for _, part in parts), np.zeros(self.values.shape[1], np.int64))
            node = centroid
            while True:
                self.sums[node] += total
                if node == top:
                    break
                node = self.parents[node]
            waiting.extend(parts)
            if centroid != top:
                waiting.append((top, self._component(top)))
        return self.sums


def _decompose_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by component: each whole component is decomposed; one component is held at a time."""
    held: list[pa.Table] = []

    def solved(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(tables)
        names = table.column("node").to_pylist()
        known = {name: place for place, name in enumerate(names)}
        component = table.column("comp").to_pylist()
        parents = []
        for parent, comp in zip(table.column("parent").to_pylist(), component):
            place = known.get(parent, -1)
            parents.append(place if place >= 0 and component[place] == comp else -1)
        values = np.stack([table.column(c).to_numpy() for c in ("leaf", "tokens")], axis=1).astype(np.int64)
        sums = _Forest(parents, values).decompose([i for i, p in enumerate(parents) if p < 0])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy())], names=["node", "leaves", "saved"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        comps = table.column("comp").to_pylist()
        # The last component of the batch may go on; all before it are whole.
        start = len(comps) - 1
        while start and comps[start - 1] == comps[-1]:
            start -= 1
        if start:
            yield from solved([*held, table.slice(0, start)])
            held = []
        elif held and held[-1].column("comp")[-1].as_py() != comps[0]:
            yield from solved(held)
            held = []
        held.append(table.slice(start))
    if held:
        yield from solved(held)


def _sizes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, size): nodes in the subtree of each node, itself included.

    Every node is owned by the smallest conversation that passes it; what a
    conversation owns is the lower end of its path. All that the members of a
    node own lies in its subtree, but for the nodes above it that its own
    owner has.
    """
    owned = nodes.groupBy("owner").agg(F.count(F.lit(1)).alias("owned"), F.min("depth").alias("from")).withColumnRenamed("owner", "conv")
    sums = attach(paths.select("conv", "node"), owned.select("conv", "owned"), "conv", F.col("node")).groupBy("node").agg(
        F.sum(F.coalesce("owned", F.lit(0))).alias("all"))
    first = owned.select(F.col("conv").alias("owner"), "from")
    above = attach(nodes.select("node", "owner", "depth"), first, "owner", F.col("node")).select("node", (F.col("depth") - F.col("from")).alias("above"))
    return sums.join(above, "node").select("node", (F.col("all") - F.col("above")).alias("size"))


def _split(big: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One level of the decomposition of components too large for a task: (what is left of them, additions to nodes).

    The centroid is the deepest node with more than half of its component. It
    leaves the component; each child becomes the top of one of its own, and
    the nodes between centroid and top lose the size and gain the total of
    the centroid's subtree. The path up from a centroid is a prefix of any
    conversation that passes it, so it is found by one join.
    """
    whole = big.groupBy("comp").agg(F.max("size").alias("nodes"), F.min("depth").alias("top_depth"))
    over = attach(big, whole, "comp", F.col("node")).filter(2 * F.col("size") > F.col("nodes"))
    centroids = materialize(over.groupBy("comp").agg(
        F.max(F.struct("depth", "node", "owner", "size")).alias("c"), F.first("top_depth").alias("top_depth")).select(
        "comp", F.col("c.node").alias("centroid"), F.col("c.depth").alias("at"), F.col("c.owner").alias("through"), F.col("c.size").alias("lost"),
        "top_depth"), "centroids")
    met = attach(big, centroids.select("comp", "centroid", "at"), "comp", F.col("node"))
    # The node's own path says whether it passes the centroid, and by which child it goes on.
    asked = met.filter(F.col("depth") > F.col("at")).select("owner", "comp", "at", "centroid").distinct()
    steps = paths.select(F.col("conv").alias("owner"), (F.col("depth") - 1).alias("at"), F.col("parent").alias("centroid"), F.col("node").alias("branch"))
    branches = asked.join(steps, ["owner", "at", "centroid"]).select(_pair("owner", "comp").alias("walk"), "branch")
    placed = attach(met.withColumn("walk", _pair("owner", "comp")), branches, "walk", F.col("node")).withColumn(
        "branch", F.when(F.col("depth") > F.col("at"), F.col("branch")))
    placed = materialize(placed.drop("walk"), "branches")
    totals = placed.filter((F.col("node") == F.col("centroid")) | F.col("branch").isNotNull()).groupBy("comp").agg(
        F.sum("leaf").alias("leaves"), F.sum("tokens").alias("saved"))
    weights = materialize(centroids.join(totals, "comp"), "centroid_totals")
    walks = paths.select("conv", "depth", "node").unionByName(
        weights.filter("top_depth = 0").select(F.col("through").alias("conv"), F.lit(0).cast("bigint").alias("depth"), F.lit(ROOT).alias("node")).distinct())
    upward = walks.join(weights, F.col("conv") == F.col("through")).filter(
        F.col("depth").between(F.col("top_depth"), F.col("at"))).select("node", "comp", "leaves", "saved", "lost")
    added = materialize(upward, "path_additions")
    left = placed.filter(F.col("node") != F.col("centroid")).withColumn("comp", F.coalesce("branch", "comp"))
    shrunk = left.join(added.select("node", "lost"), "node", "left").select(
        "node", "parent", "owner", "depth", "leaf", "tokens", "comp", (F.col("size") - F.coalesce("lost", F.lit(0))).alias("size"))
    return materialize(shrunk, "components"), added.select("node", "leaves", "saved")


def _pair(a: str, b: str) -> Column:
    return F.concat(F.col(a).cast("string"), F.lit(":"), F.col(b))


def rollup(nodes: DataFrame, paths: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """(node, leaves, saved): sums of ``leaf`` and ``tokens`` over the subtree of every node, by centroid decomposition.

    A component is split at its centroid; every centroid adds the total of
    its subtree within the component to itself and to the nodes on the path
    up to the component's top. A component halves each time, so a node gets
    at most one addition per halving, however deep the trie is. Components of
    more than ``local_nodes`` nodes are split by joins, all of one level at a
    time; smaller ones are grouped and decomposed to the end in a task each.
    """
    state = materialize(nodes.select("node", "parent", "owner", "depth", "leaf", "tokens", "size", F.lit(ROOT).alias("comp")), "components")
    small, added = [], []
    while True:
        totals = state.groupBy("comp").agg(F.max("size").alias("nodes"))
        large = materialize(totals.filter(F.col("nodes") > local_nodes).select("comp", F.lit(True).alias("large")), "large_components")
        if large.isEmpty():
            small.append(state)
            break
        marked = attach(state, large, "comp", F.col("node"))
        small.append(marked.filter(F.col("large").isNull()).drop("large"))
        state, more = _split(marked.filter(F.col("large")).drop("large"), paths)
        added.append(more)
    parts = small[0]
    for part in small[1:]:
        parts = parts.unionByName(part)
    solved = parts.select("comp", "node", "parent", "leaf", "tokens", "depth").repartition("comp").sortWithinPartitions("comp", "depth").mapInArrow(
        _decompose_parts, "node string, leaves long, saved long")
    for more in added:
        solved = solved.unionByName(more)
    return solved.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node's list, which come in order; a list is read piece by piece and never held."""
    node, state = None, None
    names, digests = [], []
    for batch in batches:
        for name, piece in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name != node:
                if node is not None:
                    names.append(node)
                    digests.append(state.hexdigest())
                node, state = name, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(digests)], names=["node", "ends_sha256"])
            names, digests = [], []
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])


def _ends(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(node, ends_sha256): hash of the ascending ids of the conversations that end at a node.

    Ids are distinct numbers, so a range of ``ID_RANGE`` of them is a bounded
    piece of the list; pieces are written in parallel and hashed in order.
    """
    last = paths.groupBy("conv").agg(F.max(F.struct("depth", "node"))["node"].alias("node"))
    ending = convs.join(last, "conv", "left").select("conv", F.coalesce("node", F.lit(ROOT)).alias("node"))
    pieces = ending.groupBy("node", F.floor(F.col("conv") / ID_RANGE).alias("piece")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").select("node", "ids").mapInArrow(
        _hash_lists, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, local_nodes: int = LOCAL_NODES) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text. Turns are ordered by
    turn, null first; null roles and texts are empty. Conversation c is
    rebuilt from the first h turns of conversation c - c % 20 (h is the CRC-32
    of the decimal id modulo 4) and its own turns after its first h. A node is
    a distinct sequence of first turns, from the root without any.

    Returned per node: ``conv_id``, the smallest member; ``depth``;
    ``parent_conv_id``, that of the parent, null for the root; ``n_convs``,
    members; ``n_children``; ``n_leaves``, childless nodes of the subtree;
    ``saved_tokens``, the sum over the subtree of (n_convs - 1) times the words
    of the last text; ``ends_sha256``, the hash of the ascending ids of the
    members that end there.

    Rows without conv_id belong to no conversation. Rows of one conversation
    with equal turn numbers all count, in order of role and then of the MD5 of
    role and text. Ids are whole numbers. An empty table has no conversations
    and no nodes. Sequences are told apart by 128 bits.
    """
    turns = materialize(_numbered(conversations), "numbered_turns")
    convs = turns.select("conv").distinct()
    paths = materialize(_paths(_rebuilt(turns)), "paths")
    below = paths.groupBy("node").agg(F.min("conv").alias("owner"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
                                      F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    top = convs.agg(F.min("conv").alias("owner"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("node"), "owner", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "n_convs",
        F.lit(0).cast("bigint").alias("words"))
    facts = materialize(below.unionByName(top), "nodes")
    children = facts.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    # The root's subtree is the whole trie.
    everything = facts.agg(F.count(F.lit(1)).alias("size")).select(F.lit(ROOT).alias("node"), "size")
    sizes = _sizes(facts.filter(F.col("depth") > 0), paths).unionByName(everything)
    nodes = materialize(facts.join(children, "node", "left").join(sizes, "node").select(
        "node", "parent", "owner", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "size",
        F.col("n_children").isNull().cast("bigint").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("tokens")), "trie")
    sums = rollup(nodes, paths, local_nodes)
    above = facts.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"))
    placed = attach(nodes, above, "parent", F.col("node"))
    return placed.join(sums, "node").join(_ends(convs, paths), "node", "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
