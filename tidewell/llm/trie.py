"""A prefix trie over rebuilt conversations, as succinct level-order tries of prefix shards.

A conversation's turns are numbered by ranges of (conv_id, turn), and the key of a prefix is a sum of hashes of (turn, place), taken by blocks
of turns; so neither a long conversation nor a prefix that many share is one task's. A node is what shares a key: one aggregate counts its
members and the turns at or below it. Nodes fall into tiers by that number, in powers of SHARD_TURNS. A shard is the nodes of one tier
below a top node whose parent is of a higher one: light subtrees are the lowest tier, and the heavy upper levels merge after them, tier by
tier, from what their shards' tops have summed up. A task lays its shards out in level order, as a LOUDS bit vector with arrays of labels,
and adds up rollups in reverse of that order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.places import placed
from tidewell.session import written

#: Turns at or below a shard's top, for the lowest tier; each tier above takes so many times more.
SHARD_TURNS = 4096
#: Conversations are rebuilt from the first ones of their family of so many ids, and from up to HEADS - 1 of its turns.
FAMILY, HEADS = 20, 4
#: Turns whose hashes are summed at once.
BLOCK_TURNS = 1024
#: Nodes that a task lays out at once; a larger shard goes alone.
SLICE_NODES = 1 << 16
#: Ids of one node that go to its hash as one row: those that share all but so many bits.
ID_BITS = 12

_SUMS = ("_s0", "_s1", "_s2", "_s3")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, length, label, n_words: a row for each rebuilt turn, and one of depth 0 for each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    label = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", label.alias("label"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_words"))
    turns = placed(own.filter("conv_id IS NOT NULL"), [F.col("turn").asc_nulls_first(), F.col("label")], ["conv_id"], "nth")
    turns = written(turns.drop("turn"), "turns")

    first = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("nth") < HEADS - 1))
    first = first.groupBy(F.col("conv_id").alias("family")).agg(F.sort_array(F.collect_list(F.struct("nth", "label", "n_words"))).alias("first"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"heads": heads.cast("int"), "family": F.col("conv_id") - F.col("conv_id") % FAMILY})
    taken = F.expr("coalesce(slice(first, 1, heads), slice(array(named_struct('nth', 0L, 'label', '', 'n_words', 0L)), 1, 0))")
    convs = convs.join(first, "family", "left").withColumn("taken", taken)
    convs = written(convs.withColumn("length", F.size("taken") + F.greatest(F.col("n") - F.col("heads"), F.lit(0))).drop("family", "first", "n"), "rebuilt")

    rest = turns.join(convs.select("conv_id", "heads", "length", F.size("taken").alias("n_taken")), "conv_id").filter("nth >= heads")
    rest = rest.select("conv_id", (F.col("n_taken") + F.col("nth") - F.col("heads") + 1).alias("depth"), "length", "label", "n_words")
    before = convs.select("conv_id", F.explode("taken").alias("t"), "length").select("conv_id", (F.col("t.nth") + 1).alias("depth"), "length", "t.label", "t.n_words")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", F.lit(None).cast("string").alias("label"), F.lit(0).cast("long").alias("n_words"))
    return rest.union(before).union(tops)


def _key(sums: list[Column], depth: Column) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]).cast("binary"))


def prefixes(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, depth, length, n_words, node, parent: the keys of each prefix and of the one before it.

    Four sums of 31-bit hashes of a turn and its place tell prefixes apart; two that differ agree with a probability below 1e-36.
    """
    one, two = F.xxhash64("label", "depth"), F.xxhash64("depth", F.lit("2"), "label")
    halves = [f(h) for h in (one, two) for f in (lambda h: h.bitwiseAND(F.lit(2**31 - 1)), lambda h: F.shiftrightunsigned(h, 33))]
    parts = {f"_h{k}": F.when(F.col("label").isNull(), F.lit(0)).otherwise(h).cast("long") for k, h in enumerate(halves)}
    rows = turns.withColumns(parts).withColumn("_block", F.expr(f"depth DIV {block_turns}"))
    totals = rows.groupBy("conv_id", "_block").agg(*[F.sum(f"_h{k}").alias(s) for k, s in enumerate(_SUMS)])
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "_block", *[F.sum(s).over(earlier).alias(f"_c{k}") for k, s in enumerate(_SUMS)]).filter("_block > 0")
    so_far = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({s: F.sum(f"_h{k}").over(so_far) for k, s in enumerate(_SUMS)}).join(carried, ["conv_id", "_block"], "left")
    sums = [F.col(s) + F.coalesce(F.col(f"_c{k}"), F.lit(0)) for k, s in enumerate(_SUMS)]
    above = [s - F.col(f"_h{k}") for k, s in enumerate(sums)]
    parent = F.when(F.col("depth") > 0, _key(above, F.col("depth") - 1))
    return rows.select("conv_id", "depth", "length", "n_words", _key(sums, F.col("depth")).alias("node"), parent.alias("parent"))


def sharded(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row for each node with its tier and shard, which is named by the key of its top."""
    below = F.sum(F.col("length") - F.col("depth") + 1)
    same = [F.max(c).alias(c) for c in ("depth", "parent", "n_words")]
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), below.alias("below"), *same)
    tier, bound = F.lit(0), shard_turns
    while bound < 2**60:
        tier, bound = tier + (F.col("below") > bound).cast("int"), bound * shard_turns
    nodes = written(nodes.withColumn("tier", tier), "nodes")
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("tier").alias("above"))
    nodes = written(nodes.join(above, "parent", "left"), "tiers")
    tops = nodes.filter("above IS NULL OR above <> tier").select("node", "tier")
    shards = rows.select("conv_id", "node").join(tops, "node").select("conv_id", "tier", F.col("node").alias("shard"))
    return nodes.join(shards, ["conv_id", "tier"])


class Louds:
    """A forest in level order: below a top of all, bits of each node's degree in unary, and where each given node went."""

    def __init__(self, node: np.ndarray, parent: np.ndarray):
        by_key = np.argsort(node, kind="stable")
        at = np.minimum(np.searchsorted(node[by_key], parent), len(node) - 1)
        inside = node[by_key][at] == parent
        above = np.where(inside, by_key[at], -1)
        tops = np.flatnonzero(~inside)
        level, self.levels, order, placed_at = tops, [], [], np.full(len(node), -1)
        children = np.argsort(above, kind="stable")
        starts = np.searchsorted(above[children], np.arange(len(node) + 1))
        n = 0
        while len(level):
            placed_at[level] = np.arange(n, n + len(level))
            self.levels.append((n, n + len(level)))
            order.append(level)
            n += len(level)
            counts = starts[level + 1] - starts[level]
            ends = np.cumsum(counts)
            level = children[np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(starts[level], counts)]
        self.order = np.concatenate(order)
        degree = np.append(len(tops), (starts[self.order + 1] - starts[self.order]))
        self.bits = np.ones(int(degree.sum()) + len(degree), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def degrees(self) -> np.ndarray:
        """Children of each node, in level order: the run of ones between two zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def parents(self) -> np.ndarray:
        """The place of each node's parent, -1 for tops: the zeros before its one, less that of the top of all."""
        return np.cumsum(~self.bits)[self.bits] - 1

    def rolled(self, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` over subtrees, from the last level to the first."""
        sums, parents = values.copy(), self.parents()
        for a, b in reversed(self.levels[1:]):
            np.add.at(sums, parents[a:b], sums[a:b])
        return sums


_ROLLED = "node string, shard string, parent string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def _whole_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole shards; rows come sorted by shard."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= SLICE_NODES:
            table = pa.Table.from_batches(held)
            shard = table.column("shard").combine_chunks()
            last = shard[len(shard) - 1]
            cut = pc.index(shard, last).as_py()
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _whole_shards(batches):
        keys = [np.array(pc.fill_null(table.column(c), "").to_numpy(), "S32") for c in ("node", "parent")]
        trie = Louds(*keys)
        table = table.take(pa.array(trie.order))
        number = {c: table.column(c).to_numpy() for c in ("n_convs", "n_words", "more_children", "more_leaves", "more_saved")}
        children = trie.degrees() + number["more_children"]
        leaves = trie.rolled(number["more_leaves"] + (children == 0))
        saved = trie.rolled(number["more_saved"] + (number["n_convs"] - 1) * number["n_words"])
        out = table.select(["node", "shard", "parent", "conv_id", "depth", "parent_conv_id", "n_convs"])
        for name, values in (("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved)):
            out = out.append_column(name, pa.array(values.astype(np.int64)))
        yield from out.to_batches()


def rollups(shards: DataFrame) -> DataFrame:
    """n_children, n_leaves and saved_tokens of every node: the lowest tier first, each next one with what hangs below it."""
    done: list[DataFrame] = []
    more = {"more_children": F.count("*"), "more_leaves": F.sum("n_leaves"), "more_saved": F.sum("saved_tokens")}
    for tier in sorted(r[0] for r in shards.select("tier").distinct().collect()):
        rows = shards.filter(F.col("tier") == tier).drop("above", "below")
        if done:
            tops = [d.filter("node = shard").select(F.col("parent").alias("_of"), "n_leaves", "saved_tokens") for d in done]
            below = tops[0]
            for t in tops[1:]:
                below = below.union(t)
            below = below.groupBy("_of").agg(*[v.alias(c) for c, v in more.items()])
            rows = rows.join(below, F.col("node") == F.col("_of"), "left").drop("_of")
            rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in more})
        else:
            rows = rows.withColumns({c: F.lit(0).cast("long") for c in more})
        rows = rows.repartition("shard").sortWithinPartitions("shard")
        done.append(written(rows.mapInArrow(_roll, _ROLLED), "rolled"))
    found = done[0] if done else shards.sparkSession.createDataFrame([], _ROLLED)
    for d in done[1:]:
        found = found.union(d)
    return found


def end_digests(rows: DataFrame) -> DataFrame:
    """node, ends_sha256: SHA-256 of the ids that end at a node, ascending. A task hashes a node's ids as they come by, in blocks."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["node", "ends_sha256"])
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["node", "ends_sha256"])

    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    ends = rows.filter("depth = length").groupBy("node", F.shiftright("conv_id", ID_BITS).alias("block")).agg(ids.alias("ids"))
    return ends.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(digest, "node string, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, nulls first; of one number, by the MD5 of role and text, and repeated rows are turns of their own. Null roles and
    texts are empty. Rows without a conv_id belong to no conversation. Conversations and texts have any length. An empty table has no node, not even
    a root. Other columns, of whatever name, are not looked at.
    """
    rows = written(prefixes(rebuilt(conversations), block_turns), "prefixes")
    found = rollups(written(sharded(rows, shard_turns), "shards"))
    ends = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    found = found.join(end_digests(rows), "node", "left").withColumn("ends_sha256", ends)
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
