"""The trie of conversation prefixes, with subtree totals by time-forward processing.

* Turns are hashed, then sorted in ranges of (conversation, turn), so that a long conversation spreads over
  tasks.  Each task numbers its turns and chains their hashes; what a task needs from those before it is a count and
  a hash for the one conversation that crosses its lower edge, two rows a task at most.
* The hash of a prefix is a polynomial modulo the prime 2^127 - 1 in the turns' SHA-256 digests, so that
  prefixes can be joined and cut without their texts.  Sequences with equal hashes and lengths count as equal;
  texts are never compared (two of n sequences agree by chance with probability n^2 / 2^127).
* Nodes come from one aggregation of (depth, hash), combined in each task first.
* ``forward`` sums subtrees: nodes sorted by reverse level order send their totals to their parents through a priority
  queue that spills.  It runs within shards, whole subtrees with at most ``LEAST`` turns or the square
  root of all turns; then over the nodes above them, which are cut into stretches of one conversation: stretches form
  a small tree of their own, whose totals are found first and then handed to the nodes within.

Order of turns: by turn, null first, then role, then digest of the text.  Null roles and texts are empty.  Rows whose
conversation id is null belong to no conversation and take no part.  Repeated rows are turns of their own.  Ids are integers.
An empty table has no conversations and gives no rows, not even a root.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_or_empty

MOD = (1 << 127) - 1
BASE = 0x5DEECE66D1B54A32D192ED03A5C7F19B % MOD
ROOT = bytes(16)
#: A conversation takes over fewer than MOST turns of the first in its hundred.
HUNDRED, MOST = 100, 6
#: Turns of a shard, at least; messages in memory; ids in one piece of a list of ends.
LEAST, MESSAGES, ENDS = 100_000, 1 << 18, 1 << 16

_POWERS = [1]


def _power(n: int) -> int:
    if n >= 1 << 14:
        return pow(BASE, n, MOD)
    while len(_POWERS) <= n:
        _POWERS.append(_POWERS[-1] * BASE % MOD)
    return _POWERS[n]


def _int(cell: bytes) -> int:
    return int.from_bytes(cell, "big")


def _cell(value: int) -> bytes:
    return value.to_bytes(16, "big")


def _batch(rows: list, names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _streamed(step, names: list[str], types: list, size: int = 20_000):
    """A function for mapInArrow from one over rows: ``step`` takes an iterator of tuples and gives tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in step(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            out.append(row)
            if len(out) >= size:
                yield _batch(out, names, types)
                out = []
        if out:
            yield _batch(out, names, types)

    return run


_KINDS = {"bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}


def _map(df: DataFrame, step, schema: str) -> DataFrame:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return df.mapInArrow(_streamed(step, list(names), [_KINDS[k] for k in kinds]), schema)


# ---- prefixes


def _number(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Of sorted (conv, digest, chars): rank and prefix hashes within the task, and a row for the first and last conversation."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    conv, rank, prefix, edges = None, 0, 0, []
    for c, digest, chars in rows:
        if c != conv:
            if conv is not None and not edges:
                edges.append((part, conv, rank, _cell(prefix), ROOT, 0, True))
            conv, rank, prefix = c, 0, 0
        before, rank = prefix, rank + 1
        prefix = (prefix * BASE + _int(digest)) % MOD
        yield part, c, rank, _cell(prefix), _cell(before), chars, False
    if conv is not None:
        edges.append((part, conv, rank, _cell(prefix), ROOT, 0, True))
    yield from edges


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv, rank (from 1), prefix and before (hashes with and without it), chars."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(digest, 1, 16).alias("digest"), F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("copy")
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "chars")
    schema = "part int, conv bigint, rank bigint, prefix binary, before binary, chars bigint, edge boolean"
    numbered = stored(_map(dealt, _number, schema))
    # two rows a task at most
    ahead, offsets = (None, 0, 0), {}
    for r in sorted(numbered.where("edge").select("part", "conv", "rank", "prefix").collect()):
        same = r.conv == ahead[0]
        count, value = (ahead[1], ahead[2]) if same else (0, 0)
        if same and count:
            offsets[r.part, r.conv] = (count, value)
        ahead = (r.conv, count + r.rank, (value * _power(r.rank) + _int(r.prefix)) % MOD)
    rows = numbered.where("not edge").drop("edge")
    if not offsets:
        return rows.drop("part")

    def shift(rows: Iterator[tuple]) -> Iterator[tuple]:
        for part, conv, rank, prefix, before, chars in rows:
            if found := offsets.get((part, conv)):
                count, value = found
                prefix = _cell((value * _power(rank) + _int(prefix)) % MOD)
                before = _cell((value * _power(rank - 1) + _int(before)) % MOD)
                rank += count
            yield conv, rank, prefix, before, chars

    return _map(rows, shift, "conv bigint, rank bigint, prefix binary, before binary, chars bigint")


def members(rows: DataFrame, rebuild: bool = False) -> DataFrame:
    """(conv, len, depth, key, parent, chars): each conversation at each of its nodes, the root included.

    With ``rebuild`` a conversation's first turns are those of the first conversation in its hundred.
    """
    head = F.when(F.col("rank") < MOST, F.struct("rank", "prefix", "before", "chars"))
    convs = rows.groupBy("conv").agg(F.max("rank").alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))
    if not rebuild:
        plan = convs.select("conv", F.col("n").alias("len"))
        own = rows.join(plan, "conv").select("conv", "len", F.col("rank").alias("depth"), F.col("prefix").alias("key"), F.col("before").alias("parent"), "chars")
        return plan.select("conv", "len", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars")).unionByName(own)
    convs = stored(convs.withColumn("h", (F.crc32(F.col("conv").cast("string").cast("binary")) % MOST).cast("int")).withColumn("base", F.col("conv") - F.col("conv") % HUNDRED))
    bases = convs.where("conv = base").select("base", F.col("n").alias("base_n"), F.col("heads").alias("base_heads"))
    at = lambda heads, k: F.when(F.col(k) > 0, F.get(heads, F.col(k) - 1)["prefix"]).otherwise(F.lit(ROOT))
    plan = (
        convs.join(bases, "base", "left")
        .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
        .select("conv", "h", "m", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), at("base_heads", "m").alias("under"), at("heads", "h").alias("cut"), F.slice("base_heads", 1, F.col("m")).alias("taken"))
    )
    plan = stored(plan)
    root = plan.select("conv", "len", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    taken = plan.select("conv", "len", F.inline("taken")).toDF("conv", "len", "depth", "key", "parent", "chars")

    def moved(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, rank, prefix, before, chars, h, m, length, under, cut in rows:
            k = rank - h
            if under != cut:
                off = (_int(under) - _int(cut)) % MOD
                prefix = _cell((_int(prefix) + off * _power(k)) % MOD)
                before = _cell((_int(before) + off * _power(k - 1)) % MOD)
            yield conv, length, m + k, prefix, before, chars

    own = rows.join(plan.select("conv", "h", "m", "len", "under", "cut"), "conv").where("rank > h")
    own = _map(own.select("conv", "rank", "prefix", "before", "chars", "h", "m", "len", "under", "cut"), moved, "conv bigint, len bigint, depth bigint, key binary, parent binary, chars bigint")
    return root.unionByName(taken).unionByName(own)


# ---- time-forward processing


class Messages:
    """A priority queue of (level, key, ...) tuples that keeps ``limit`` in memory and sorted runs in scratch files of the task.

    The files have no name and go with the task; nothing else reads them.
    """

    def __init__(self, limit: int = MESSAGES):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            run = tempfile.TemporaryFile()
            for m in sorted(self.heap):
                pickle.dump(m, run)
            run.seek(0)
            heapq.heappush(self.runs, (pickle.load(run), len(self.runs), run, len(self.heap) - 1))
            self.heap = []

    def take(self, place: tuple) -> Iterator[tuple]:
        """All messages to ``place``; earlier places must have been served."""
        while True:
            least = self.heap[0] if self.heap else None
            if self.runs and (least is None or self.runs[0][0] < least):
                message, number, run, rest = self.runs[0]
                if message[:2] != place:
                    return
                if rest:
                    heapq.heapreplace(self.runs, (pickle.load(run), number, run, rest - 1))
                else:
                    heapq.heappop(self.runs)
                    run.close()
                yield message
            elif least is not None and least[:2] == place:
                yield heapq.heappop(self.heap)
            else:
                return


_SUMS = "shard binary, level bigint, key binary, up_level bigint, up binary, children bigint, leaves bigint, saved bigint"


def forward(nodes: DataFrame) -> DataFrame:
    """Adds the totals of all nodes below it, within its shard, to each node.

    Takes and gives the columns of ``_SUMS``; others are lost.  A node's ``children``, ``leaves`` and ``saved`` may hold what
    came from other shards.  A node without children counts as one leaf.
    """

    def step(rows: Iterator[tuple]) -> Iterator[tuple]:
        shard, queue = None, Messages()
        for s, level, key, up_level, up, children, leaves, saved in rows:
            if s != shard:
                # what is left goes to nodes of other shards, which get it from the shard's root
                shard, queue = s, Messages()
            for _, _, more_leaves, more_saved in queue.take((-level, key)):
                children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
            leaves = leaves if children else 1
            if up is not None:
                queue.push((-up_level, up, leaves, saved))
            yield s, level, key, up_level, up, children, leaves, saved

    names = [c.split()[0] for c in _SUMS.split(", ")]
    order = [F.col("shard"), F.col("level").desc(), F.col("key")]
    return _map(nodes.select(*names).repartition("shard").sortWithinPartitions(*order), step, _SUMS)


def _given(sums: DataFrame) -> DataFrame:
    """What shards' roots send to nodes of other shards."""
    return sums.where("up IS NOT NULL").groupBy(F.col("up_level").alias("level"), F.col("up").alias("key")).agg(F.count("*").alias("g_children"), F.sum("leaves").alias("g_leaves"), F.sum("saved").alias("g_saved"))


def _with(nodes: DataFrame, given: DataFrame) -> DataFrame:
    add = lambda c: (F.col(c) + F.coalesce(F.col(f"g_{c}"), F.lit(0))).alias(c)
    got = nodes.join(given, ["level", "key"], "left")
    return got.withColumns({c: add(c) for c in ("children", "leaves", "saved")}).drop("g_children", "g_leaves", "g_saved")


def subtree_sums(nodes: DataFrame, paths: DataFrame, least: int = LEAST) -> DataFrame:
    """level, key, children, leaves, saved of each node's subtree.

    ``nodes``: level, key, up, conv (its smallest member), weight (turns of its members below it), saved (its own);
    ``paths``: conv, level, key of all members.
    """
    top = nodes.agg(F.max("weight")).first()[0]
    if top is None:
        return nodes.select("level", "key", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
    most = max(least, math.isqrt(top))
    zero = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves")]
    base = nodes.select("level", "key", (F.col("level") - 1).alias("up_level"), "up", "conv", "weight", *zero, "saved")
    if top <= most:
        return forward(base.withColumn("shard", F.lit(ROOT))).select("level", "key", "children", "leaves", "saved")
    heavy = base.where(F.col("weight") > most)
    # the shard of a light node: the highest light node over it, found on the path of its smallest member
    highest = paths.join(heavy.select("level", "key"), ["level", "key"], "left_semi").groupBy("conv").agg((F.max("level") + 1).alias("level"))
    shards = paths.join(highest, ["conv", "level"]).select("conv", F.col("key").alias("shard"), F.col("level").alias("shard_level"))
    light = base.where(F.col("weight") <= most).join(shards, "conv")
    inner = light.withColumn("up", F.when(F.col("level") > F.col("shard_level"), F.col("up")))
    low = stored(forward(inner))
    roots = light.where("level = shard_level").select("shard", "level", F.col("up").alias("root_up"))
    sent = low.join(roots, ["shard", "level"]).withColumn("up", F.col("root_up"))
    # above the shards: stretches of one conversation, their tree, then the nodes within
    name = F.unhex(F.sha2(F.concat_ws(":", "conv", F.floor(F.col("level") / most)), 256))
    high = stored(_with(heavy, _given(sent)).withColumn("shard", name))
    stretch = high.groupBy("shard").agg(F.min("level").alias("level"), F.min_by("up", "level").alias("up"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    parents = high.select((F.col("level") + 1).alias("level"), F.col("key").alias("up"), F.col("shard").alias("parent"))
    tree = stretch.join(parents, ["level", "up"], "left").join(stretch.select(F.col("shard").alias("parent"), F.col("level").alias("parent_level")), "parent", "left")
    # every stretch has nodes below it, so none is a leaf: one child stands for those that other shards sent
    tree = tree.select(F.lit(ROOT).alias("shard"), "level", F.col("shard").alias("key"), F.col("parent_level").alias("up_level"), F.col("parent").alias("up"), F.lit(1).cast("long").alias("children"), "leaves", "saved")
    totals = forward(tree).select(F.col("key").alias("shard"), "leaves", "saved")
    given = _given(stretch.select("shard", "level", "up").join(totals, "shard").select((F.col("level") - 1).alias("up_level"), "up", "leaves", "saved"))
    first = stretch.select("shard", F.col("level").alias("top_level"))
    within = _with(high, given).join(first, "shard").withColumn("up", F.when(F.col("level") > F.col("top_level"), F.col("up")))
    return low.select("level", "key", "children", "leaves", "saved").unionByName(forward(within).select("level", "key", "children", "leaves", "saved"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(level, key, conv) to (level, key, ends_sha256): SHA-256 of the ids, ascending, joined by commas.

    Ids are sorted in ranges and joined to pieces, so that only pieces of a node's list meet, as a stream.
    """
    order = ["level", "key", "conv"]

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        place, first, ids = None, 0, []
        for level, key, conv in rows:
            if (level, key) != place or len(ids) >= ENDS:
                if ids:
                    yield *place, first, ",".join(ids)
                place, first, ids = (level, key), conv, []
            ids.append(str(conv))
        if ids:
            yield *place, first, ",".join(ids)

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        place, sha = None, None
        for level, key, _, ids in rows:
            if (level, key) != place:
                if place:
                    yield *place, sha.hexdigest()
                place, sha = (level, key), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if place:
            yield *place, sha.hexdigest()

    listed = _map(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), pieces, "level bigint, key binary, first bigint, ids string")
    return _map(listed.repartition("level", "key").sortWithinPartitions("level", "key", "first"), digests, "level bigint, key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, rebuild: bool = False, least: int = LEAST, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = stored(members(prefixes(turns, **columns), rebuild).withColumnRenamed("depth", "level"))
    nodes = stored(
        paths.groupBy("level", "key").agg(
            F.min("conv").alias("conv"), F.count("*").alias("n"), F.sum(F.col("len") - F.col("level")).alias("weight"), F.max("chars").alias("chars"), F.max("parent").alias("up")
        ).withColumn("saved", (F.col("n") - 1) * F.col("chars"))
    )
    sums = subtree_sums(nodes, paths.select("conv", "level", "key"), least)
    ends = end_digests(paths.where("level = len"))
    parents = nodes.select((F.col("level") + 1).alias("level"), F.col("key").alias("up"), F.col("conv").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (
        nodes.select("level", "key", "conv", "n", "up")
        .join(sums, ["level", "key"])
        .join(ends, ["level", "key"], "left")
        .join(parents, ["level", "up"], "left")
        .select(
            F.col("conv").alias("conv_id"), F.col("level").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
        )
    )
