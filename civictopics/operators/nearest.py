"""The nearest of many target vectors, with targets that stay in Spark.

A bounded number of targets are pivots.  Every target belongs to its nearest pivot, and the widest angle in
a group is its radius.  By the triangle inequality of angles no target of a group is nearer to a row than
the angle to the pivot less the radius, so a row only meets the groups that may beat its nearest pivot.
Rows lie in packs and targets in blocks, both written once, so that one joined row is one matrix product, of
the rows of the pack that may find their target in the block.  Vectors are not copied for each group
that they meet: packs and blocks meet without a shuffle.  The best of all blocks wins by one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civictopics.storage import cut

MOST_PIVOTS = 1024
# A group has about so many targets, so that blocks are large.
GROUP_TARGETS = 2048
BLOCK_TARGETS = 4096
PACK_ROWS = 4096
# Vectors that a task holds, over all groups, before it hands out what it has, and packs whose best it holds.
HELD, HELD_PACKS = 1 << 15, 64
# Similarities in memory at once, and exact ones for a row after the first sight.
MOST_SIMS, MOST_EXACT = 1 << 21, 8
# Angles that similarities rounded to nine digits cannot tell apart.
SLACK = 1e-4


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of a batch as rows of length 1, zero vectors as they are."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))


def _batch(schema: str, *columns) -> pa.RecordBatch:
    """One row of ``columns``, whose names and kinds ``schema`` has."""
    kinds = {"int": pa.int32(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([c], kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


BLOCKS = "pivot int, ids array<long>, vectors binary, angle double"
PACKS = "ids array<long>, vectors binary, nearest array<double>, meets array<int>"


def _packed(df: DataFrame, id_col: str, pivots, radii, rows: int) -> DataFrame:
    """Without ``radii`` blocks of targets ``(pivot, ids, vectors, angle)`` by their nearest pivot, ``angle`` being the widest.

    With them packs of rows ``(ids, vectors, nearest, meets)``: ``meets`` are the groups that may hold the nearest
    target of a row of the pack, ``nearest`` the angles of its rows to their nearest pivot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        sizes: dict[int, int] = {}

        def block(pivot: int) -> pa.RecordBatch:
            ids, vectors, angles, _ = zip(*held.pop(pivot))
            del sizes[pivot]
            return _batch(BLOCKS, pivot, np.concatenate(ids), np.concatenate(vectors).tobytes(), max(a.max() for a in angles))

        def packs() -> Iterator[pa.RecordBatch]:
            """Rows of one pivot lie together, and a pack may have those of several."""
            parts = zip(*(part for pivot in sorted(held) for part in held[pivot]))
            ids, vectors, nearest, chosen = map(np.concatenate, parts)
            held.clear()
            sizes.clear()
            for lo in range(0, len(ids), rows):
                some = slice(lo, lo + rows)
                yield _batch(PACKS, ids[some], vectors[some].tobytes(), nearest[some], np.flatnonzero(chosen[some].any(axis=0)))

        for whole in batches:
            for at in range(0, whole.num_rows, PACK_ROWS):
                batch = whole.slice(at, PACK_ROWS)
                ids, x = batch.column(0).to_numpy(zero_copy_only=False), _matrix(batch.column(1))
                angles = _angles(x, pivots.value)
                own, nearest = angles.argmin(axis=1), angles.min(axis=1)
                chosen = np.zeros((len(x), 0), dtype=bool) if radii is None else angles - radii.value[None, :] <= nearest[:, None] + SLACK
                for pivot in np.unique(own).tolist():
                    member = np.flatnonzero(own == pivot)
                    for lo in range(0, len(member), rows):
                        some = member[lo : lo + rows]
                        if radii is None and sizes.get(pivot, 0) + len(some) > rows:
                            yield block(pivot)
                        held.setdefault(pivot, []).append((ids[some], x[some], nearest[some], chosen[some]))
                        sizes[pivot] = sizes.get(pivot, 0) + len(some)
                if sum(sizes.values()) > HELD:
                    yield from packs() if radii is not None else map(block, list(held))
        if held:
            yield from packs() if radii is not None else map(block, list(held))

    return df.mapInArrow(run, BLOCKS if radii is None else PACKS)


def _whole_blocks(blocks: DataFrame) -> DataFrame:
    """Small ``blocks`` of one group, which many tasks have left, in blocks of up to ``BLOCK_TARGETS``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held, size = None, [], 0

        def give() -> pa.RecordBatch:
            ids, vectors, angles = zip(*held)
            return _batch(BLOCKS, pivot, np.concatenate(ids), b"".join(vectors), max(angles))

        for batch in batches:
            for next_pivot, ids, vectors, angle in zip(*(batch.column(k) for k in range(4))):
                ids = ids.values.to_numpy()
                if held and (next_pivot.as_py() != pivot or size + len(ids) > BLOCK_TARGETS):
                    yield give()
                    held, size = [], 0
                pivot = next_pivot.as_py()
                held.append((ids, vectors.as_py(), angle.as_py()))
                size += len(ids)
        if held:
            yield give()

    is_small = F.size("ids") < BLOCK_TARGETS // 2
    merged = blocks.filter(is_small).repartition("pivot").sortWithinPartitions("pivot").mapInArrow(run, BLOCKS)
    return blocks.filter(~is_small).unionByName(merged)


def _best(x: np.ndarray, y: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, sim)``: the most similar row of ``y`` for rows of ``x``, the first of equal ones.

    Only rows for which it reaches ``least`` need be in the result.  Single precision tells which similarities
    may be the highest, by what it may be off for vectors of length 1; those are taken in double precision.
    """
    off = (x.shape[1] + 4) * 2.0**-24
    sims = x.astype(np.float32) @ y.astype(np.float32).T
    floor = np.maximum(sims.max(axis=1) - 2 * off, least - off) - 1.1e-9
    likely = sims >= np.nextafter(floor.astype(np.float32), np.float32(-np.inf))[:, None]
    if np.count_nonzero(likely) > MOST_EXACT * len(x):
        sims = np.round(x @ y.T, 9)
        place = sims.argmax(axis=1)
        return np.arange(len(x)), place, sims[np.arange(len(x)), place]
    row, place = np.nonzero(likely)
    sim = np.round(np.einsum("ij,ij->i", x[row], y[place]), 9)
    order = np.lexsort((place, -sim, row))
    order = order[np.unique(row[order], return_index=True)[1]]
    return row[order], place[order], sim[order]


def nearest_of_many(
    df: DataFrame, targets: DataFrame, id_col: str = "row_id", vector_col: str = "embedding", most_pivots: int = MOST_PIVOTS
) -> DataFrame:
    """``(id, topic, sim)``: the target of highest cosine for each row of ``df``.

    ``targets (topic, embedding)`` may be any number.  Similarities are rounded to nine digits before they
    are compared; ties go to the smallest topic.  The cosine with a zero vector is 0.  ``id_col`` must
    be a key; equal topics count as one.  At most ``most_pivots`` vectors go to the tasks.
    """
    spark = df.sparkSession
    vector = F.col("embedding").cast("array<double>")
    known = cut(targets.select(F.col("topic").cast("long").alias("id"), vector.alias("embedding")), "targets")
    is_zero = F.forall("embedding", lambda x: x == 0)
    zero = known.filter(is_zero).agg(F.min("id")).first()[0]
    real = known.filter(~is_zero)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    lowest, n_real = known.agg(F.min("id")).first()[0], real.count()
    # Rows without a direction are equally far from everything.
    flat = rows.filter(is_zero).select("id", F.lit(lowest).cast("long").alias("topic"), F.lit(0.0).alias("sim"))
    pointed = rows.filter(~is_zero)
    if n_real == 0:
        return flat.unionByName(pointed.select("id", F.lit(lowest).cast("long").alias("topic"), F.lit(0.0).alias("sim")))
    n_pivots = min(most_pivots, max(1, math.isqrt(n_real)), -(-n_real // GROUP_TARGETS))
    first = real.orderBy(F.xxhash64("id"), "id").limit(n_pivots).select("embedding").collect()
    found = np.array([r["embedding"] for r in first], dtype=np.float64)
    pivots = spark.sparkContext.broadcast(found / np.sqrt((found * found).sum(axis=1, keepdims=True)))
    width = found.shape[1]
    blocks = cut(_whole_blocks(cut(_packed(real, "id", pivots, None, BLOCK_TARGETS), "target-parts")), "target-blocks")
    radius = np.full(n_pivots, -np.inf)
    for pivot, angle in blocks.groupBy("pivot").agg(F.max("angle")).collect():
        radius[pivot] = angle
    radii = spark.sparkContext.broadcast(radius)
    packs = _packed(pointed, "id", pivots, radii, PACK_ROWS).withColumn("pack", F.monotonically_increasing_id())
    packs = cut(packs, "row-packs")
    blocks = blocks.select("pivot", F.col("ids").alias("topics"), F.col("vectors").alias("targets"))
    joined = packs.join(blocks, F.array_contains("meets", F.col("pivot")))
    joined = joined.select("pack", "ids", "vectors", "nearest", "pivot", "topics", "targets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks come one after another for a pack, so a task hands out a row once and not for each block.
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

        def give() -> Iterator[pa.RecordBatch]:
            for ids, topic, sim in held.values():
                met = np.flatnonzero(sim > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(a[met]) for a in (ids, topic, sim)], names=["id", "topic", "sim"])
            held.clear()

        for batch in batches:
            for pack, ids, vectors, nearest, pivot, topics, block in zip(*(batch.column(k) for k in range(7))):
                pivot = pivot.as_py()
                topic = topics.values.to_numpy()
                order = np.argsort(topic, kind="stable")
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.float64).reshape(-1, width) for v in (vectors, block))
                topic, y = topic[order], y[order]
                if pack.as_py() not in held:
                    if len(held) >= HELD_PACKS:
                        yield from give()
                    held[pack.as_py()] = (ids.values.to_numpy(), np.zeros(len(x), dtype=np.int64), np.full(len(x), -np.inf))
                _, best, best_sim = held[pack.as_py()]
                angle = _angles(x, pivots.value[pivot : pivot + 1])[:, 0]
                rows = np.flatnonzero(angle - radii.value[pivot] <= nearest.values.to_numpy() + SLACK)
                step = max(1, MOST_SIMS // len(topic))
                for lo in range(0, len(rows), step):
                    some = rows[lo : lo + step]
                    row, place, sim = _best(x[some], y, best_sim[some])
                    row, found = some[row], topic[place]
                    better = (sim > best_sim[row]) | ((sim == best_sim[row]) & (found < best[row]))
                    best[row[better]], best_sim[row[better]] = found[better], sim[better]
        yield from give()

    scored = joined.mapInArrow(run, "id long, topic long, sim double")
    if zero is not None:
        scored = scored.unionByName(pointed.select("id", F.lit(zero).cast("long").alias("topic"), F.lit(0.0).alias("sim")))
    best = scored.groupBy("id").agg(F.max(F.struct("sim", (-F.col("topic")).alias("low"))).alias("best"))
    return flat.unionByName(best.select("id", (-F.col("best.low")).alias("topic"), F.col("best.sim").alias("sim")))
