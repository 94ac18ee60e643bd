"""Prefix trie of conversations, with subtree totals by time-forward processing.

Every prefix of a rebuilt conversation is a node.  Its key is a pair of polynomial hashes modulo
2^61 - 1 over the SHA-256 marks of its turns.  Such hashes can be put together: a conversation that the
sort by ranges cut into pieces is summed piece by piece, and the first turns of another conversation are
put in front of its own by one product.  Texts never move; a turn is a mark and a length.

Nodes with many members, and all nodes above them, are the top of the trie; there are at most as many as
paths have rows divided by that limit.  What hangs below falls into shards: a shard root and its
descendants in one block of depths.  Within a shard nodes come sorted by reverse level order, and each
passes its totals to its parent through a priority queue that spills.  The blocks follow one another from
the deepest up (eight at most, as the height of a block grows with the depth of the trie), the totals of
shard roots are summed by parent, and the top takes them up in a last pass of the same kind.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import pickle
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.llm.common import parts
from civictopics.storage import cut

MODULUS = (1 << 61) - 1
BASES = (1_493_116_093_547_872_183, 2_014_753_988_617_309_427)
GROUP = 100
HEAD_TURNS = 6
# A node with more members than this, and than the square root of all path rows, is at the top.
TOP_MEMBERS = 64
BLOCK_DEPTH = 256
BLOCKS = 8
# Messages of a queue that are held in memory.
HELD = 1 << 17
# Ids that a task joins before they are hashed.
JOINED = 4096
ROOT = "0" * 32
_INVERSES = [[pow(base, -k, MODULUS) for k in range(HEAD_TURNS)] for base in BASES]


class SpillingQueue:
    """Messages, smallest first; sorted runs go to unnamed files of the task when there are many."""

    def __init__(self, held: int = HELD):
        self.held, self.heap, self.runs, self.spills = held, [], [], 0

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        self.heap.sort()
        for at in range(0, len(self.heap), 1024):
            pickle.dump(self.heap[at : at + 1024], file)
        file.seek(0)
        self.heap = []
        self.spills += 1
        self._next(self._run(file), self.spills)

    @staticmethod
    def _run(file) -> Iterator[tuple]:
        with file:
            while True:
                try:
                    yield from pickle.load(file)
                except EOFError:
                    return

    def _next(self, run: Iterator[tuple], number: int) -> None:
        message = next(run, None)
        if message is not None:
            heapq.heappush(self.runs, (message, number, run))

    def head(self) -> tuple | None:
        """The smallest message, which stays; ``None`` when there is none."""
        first = self.heap[0] if self.heap else None
        spilled = self.runs[0][0] if self.runs else None
        return min(first, spilled) if first and spilled else first or spilled

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            message, number, run = heapq.heappop(self.runs)
            self._next(run, number)
            return message
        return heapq.heappop(self.heap)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in parts(batches, 1 << 14):
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: str, size: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    names = [field.split()[0] for field in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.split()[1]] for f in schema.split(", ")]
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield made()
            held = []
    if held:
        yield made()


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: _batches(function(_rows(batches)), schema), schema)


# ------------------------------------------------------------------------------ prefixes

PIECES = "conv_id long, part long, place long, one long, two long, before_one long, before_two long, chars long"


def _summed(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Prefix hashes of sorted turns, counted from where the conversation begins in this range."""
    part, conv, place, sums, powers = TaskContext.get().partitionId(), None, 0, (0, 0), (1, 1)
    for this, one, two, chars in rows:
        if this != conv:
            conv, place, sums, powers = this, 0, (0, 0), (1, 1)
        place += 1
        powers = tuple(p * b % MODULUS for p, b in zip(powers, BASES))
        before, sums = sums, tuple((s + m * p) % MODULUS for s, m, p in zip(sums, (one, two), powers))
        yield conv, part, place, *sums, *before, chars


def prefixes(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``PIECES`` without ``part``: the place of each turn in its whole conversation and its prefix hashes."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    role = F.coalesce(df[role_col].cast("string"), F.lit(""))
    mark = F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)
    halves = [F.conv(F.substring(mark, at, 15), 16, 10).cast("long").alias(n) for at, n in ((1, "one"), (16, "two"))]
    marked = df.filter(df[conv_col].isNotNull()).select(
        df[conv_col].cast("long").alias("conv_id"), df[turn_col].alias("turn"), *halves, F.char_length(text).cast("long").alias("chars")
    )
    order = ["conv_id", F.asc_nulls_first("turn"), "one", "two"]
    turns = cut(marked, "trie-turns").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = cut(_mapped(turns.select("conv_id", "one", "two", "chars"), _summed, PIECES), "trie-pieces")
    # Only a conversation at the edge of a range has two pieces or more, so there are as many as ranges.
    ends = pieces.groupBy("conv_id", "part").agg(F.max(F.struct("place", "one", "two")).alias("end"))
    split = ends.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "end"))).alias("ends"))
    offsets: dict[tuple[int, int], tuple[int, int, int]] = {}
    for conv, found in split.filter(F.size("ends") > 1).collect():
        place, one, two = 0, 0, 0
        for part, end in found:
            offsets[conv, part] = place, one, two
            one = (one + pow(BASES[0], place, MODULUS) * end["one"]) % MODULUS
            two = (two + pow(BASES[1], place, MODULUS) * end["two"]) % MODULUS
            place += end["place"]

    def moved(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, part, place, one, two, before_one, before_two, chars in rows:
            if (conv, part) in offsets:
                begun, *sums = offsets[conv, part]
                up = [pow(base, begun, MODULUS) for base in BASES]
                one, two, before_one, before_two = (
                    (sums[k % 2] + up[k % 2] * value) % MODULUS for k, value in enumerate((one, two, before_one, before_two))
                )
                place += begun
            yield conv, part, place, one, two, before_one, before_two, chars

    return (cut(_mapped(pieces, moved, PIECES), "trie-prefixes") if offsets else pieces).drop("part")


PATHS = "conv_id long, depth long, key string, parent string, chars long, last boolean"


def _keyed(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, depth, last, chars, one, two, before_one, before_two, cut_one, cut_two, head_one, head_two, back in rows:
        up = [inverse[back] for inverse in _INVERSES]
        key, parent = (
            "".join(f"{(head + u * (value - off)) % MODULUS:016x}" for head, u, value, off in zip((head_one, head_two), up, values, (cut_one, cut_two)))
            for values in ((one, two), (before_one, before_two))
        )
        yield conv, depth, key, parent, chars, last


def head_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from the first one of its group."""
    return (F.crc32(conv.cast("string").cast("binary")) % HEAD_TURNS).cast("long")


def paths(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``PATHS`` of all rebuilt conversations, and ``(conv_id, length)`` of each of them."""
    h = head_turns(F.col("conv_id"))
    sizes = known.groupBy("conv_id").agg(F.max("place").alias("n"))
    heads = (
        known.filter((F.col("place") < HEAD_TURNS) & (F.pmod("conv_id", F.lit(GROUP)) == 0)).groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "chars", "one", "two", "before_one", "before_two"))).alias("heads"))
    )
    stems = known.filter(F.col("place") == h).select("conv_id", F.col("one").alias("cut_one"), F.col("two").alias("cut_two"))
    based = sizes.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))).alias("base"))
    joined = based.join(heads, "base", "left").join(stems, "conv_id", "left")
    none = F.lit(0).cast("long")
    joined = joined.withColumn("k", F.least("h", F.coalesce(F.size("heads"), F.lit(0))).cast("long"))
    top = F.get("heads", (F.col("k") - 1).cast("int"))
    plan = cut(
        joined.select(
            "conv_id", "h", "k", "heads", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"),
            F.coalesce("cut_one", none).alias("cut_one"), F.coalesce("cut_two", none).alias("cut_two"),
            F.when(F.col("k") > 0, top["one"]).otherwise(0).alias("head_one"), F.when(F.col("k") > 0, top["two"]).otherwise(0).alias("head_two"),
        ),
        "trie-plan",
    )
    columns = ["conv_id", "depth", (F.col("depth") == F.col("length")).alias("last"), "chars", "one", "two", "before_one", "before_two",
               "cut_one", "cut_two", "head_one", "head_two", "back"]
    zero = {name: none for name in ("cut_one", "cut_two", "head_one", "head_two", "back")}
    front = (
        plan.filter("k > 0").select("conv_id", "length", F.inline(F.slice("heads", F.lit(1), F.col("k").cast("int"))))
        .withColumn("depth", F.col("place").cast("long")).withColumns(zero).select(columns)
    )
    own = known.join(plan.drop("heads"), "conv_id").filter("place > h").withColumns(
        {"depth": F.col("place") - F.col("h") + F.col("k"), "back": F.col("h") - F.col("k")}
    )
    every = cut(_mapped(front.unionByName(own.select(columns)), _keyed, PATHS), "trie-paths")
    return every, plan.select("conv_id", "length")


# ------------------------------------------------------------------------------ totals

TAKEN = ("shard", "depth", "key", "parent", "conv_id", "n_convs", "chars", "in_children", "in_leaves", "in_saved")
TOTALS = ("key string, parent string, conv_id long, depth long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, is_root boolean")


def time_forward(rows: Iterator[tuple], held: int = HELD) -> Iterator[tuple]:
    """Totals of nodes sorted by shard and reverse level order; a shard root sends nothing inside its shard."""
    queue = SpillingQueue(held)
    for shard, depth, key, parent, conv, n_convs, chars, children, leaves, saved in rows:
        while (message := queue.head()) is not None and message[:2] == (-depth, key):
            _, _, more_leaves, more_saved = queue.pop()
            children, leaves, saved = children + 1, leaves + more_leaves, saved + more_saved
        leaves = leaves if children else 1
        saved += (n_convs - 1) * chars
        yield key, parent, conv, depth, n_convs, children, leaves, saved, key == shard
        if key != shard:
            queue.push((1 - depth, parent, leaves, saved))


def _taken_up(nodes: DataFrame, below: DataFrame | None, held: int, whole: bool = False) -> DataFrame:
    """One pass over ``nodes``, which take the totals of the shard roots ``below`` them from outside."""
    if below is None:
        sums = {name: F.lit(0).cast("long") for name in TAKEN[-3:]}
        taken = nodes.withColumns(sums)
    else:
        sent = below.groupBy(F.col("parent").alias("key")).agg(
            F.count("*").alias("in_children"), F.sum("n_leaves").alias("in_leaves"), F.sum("saved_tokens").alias("in_saved")
        )
        taken = nodes.join(sent, "key", "left").fillna(0, list(TAKEN[-3:]))
    dealt = taken.select(*TAKEN).repartition(1) if whole else taken.select(*TAKEN).repartition("shard")
    ordered = dealt.sortWithinPartitions("shard", F.desc("depth"), "key")
    return cut(_mapped(ordered, lambda rows: time_forward(rows, held), TOTALS), "trie-totals")


def _ids_joined(rows: Iterator[tuple]) -> Iterator[tuple]:
    last, ids = None, []
    for key, conv in rows:
        if ids and (key != last or len(ids) >= JOINED):
            yield last, ids[0], ",".join(map(str, ids))
            ids = []
        last = key
        ids.append(conv)
    if ids:
        yield last, ids[0], ",".join(map(str, ids))


def _ids_hashed(rows: Iterator[tuple]) -> Iterator[tuple]:
    last, digest = None, None
    for key, _, ids in rows:
        if key != last:
            if digest:
                yield last, digest.hexdigest()
            last, digest = key, hashlib.sha256()
        else:
            digest.update(b",")
        digest.update(ids.encode())
    if digest:
        yield last, digest.hexdigest()


def end_digests(every: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the nodes where conversations end; their ids meet in joined pieces."""
    ends = every.filter("last").select("key", "conv_id").unionByName(
        lengths.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv_id")
    )
    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = _mapped(dealt, _ids_joined, "key string, low long, ids string")
    return _mapped(joined.repartition("key").sortWithinPartitions("key", "low"), _ids_hashed, "key string, ends_sha256 string")


def prefix_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    top_members: int = TOP_MEMBERS,
    block_depth: int = BLOCK_DEPTH,
    held: int = HELD,
) -> DataFrame:
    """One row for each node: ``key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``.

    Turns come in the order of ``turn_col``, null first; turns of one number in the order of a digest of
    role and text, so repeated turns all count.  A null role or text is empty.  A conversation starts with
    the first turns (up to five, by the CRC of its id) of the conversation whose id is the next lower
    multiple of 100, if there is one, and goes on with its own turns after as many.  Rows without a
    conversation id belong to none and are left out.  Without conversations there is no node, not even the
    root.  Texts of any length and conversations of any number of turns count whole; other columns are
    not read.
    """
    known = prefixes(df, conv_col, turn_col, role_col, text_col)
    every, lengths = paths(known)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("chars"), "n_convs",
    )
    nodes = cut(
        every.groupBy("key").agg(
            F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
            F.min("chars").alias("chars"), F.count("*").alias("n_convs"),
        ).unionByName(root),
        "trie-nodes",
    )
    n_rows, deepest = nodes.agg(F.sum(F.when(F.col("depth") > 0, F.col("n_convs"))), F.max("depth")).first()
    at_top = (F.col("depth") == 0) | (F.col("n_convs") > max(top_members, math.isqrt(n_rows or 0)))
    height = max(block_depth, -(-(deepest or 0) // BLOCKS))
    top = cut(nodes.filter(at_top), "trie-top")
    # The shallowest node below the top on the way to a node, and where the block of depths begins.
    below_top = every.join(top.select("key"), "key").groupBy("conv_id").agg((F.max("depth") + 1).alias("first"))
    block = F.floor((F.col("depth") - 1) / height)
    light = (
        nodes.filter(~at_top).join(below_top, "conv_id", "left").withColumn("block", block)
        .withColumn("root_depth", F.greatest(F.coalesce("first", F.lit(1)), F.col("block") * height + 1))
    )
    roots = every.select("conv_id", F.col("depth").alias("root_depth"), F.col("key").alias("shard"))
    sharded = cut(light.join(roots, ["conv_id", "root_depth"]), "trie-shards")
    done: list[DataFrame] = []
    for number in reversed(range(-(-(deepest or 0) // height))):
        below = done[-1].filter("is_root") if done else None
        done.append(_taken_up(sharded.filter(F.col("block") == number), below, held))
    all_roots = reduce(DataFrame.unionByName, [t.filter("is_root") for t in done]) if done else None
    done.append(_taken_up(top.withColumn("shard", F.lit(ROOT)), all_roots, held, whole=True))
    totals = cut(reduce(DataFrame.unionByName, done).drop("is_root"), "trie-nodes")
    ends = cut(end_digests(every, lengths), "trie-ends")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    return totals.join(ends, "key", "left").join(parents, "parent", "left").select(
        "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )
