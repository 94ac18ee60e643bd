"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, its expected number of copies.  Among all rates between 0 and 3 that
give every source its target of words, the ones closest to 1 in relative entropy are
``min(3, exp(lambda * size / scale))``, with one ``lambda`` for each source: the documents are
tilted exponentially.  The dual problem is convex and falls apart by source, so each Newton
iteration is one aggregation over the table of sizes, for all sources at once.  A step that leaves
the interval known to hold the solution is replaced by its middle.

Rates become whole copies by counting up the fractions from the longest document of a source to
the shortest, from one half on, and taking one more copy at each whole number.  What the words taken
then miss is settled from the longest documents that fit to the shortest ones, with one copy more
or one fewer, so that at most about the shortest document of the source is missing in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civictopics.llm.common import n_words, parts, without
from civictopics.storage import cut, settled

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
MAX_STEPS = 80
TOLERANCE = 1e-7
# Documents of one source and size are dealt into parts of about so many rows.
PART_ROWS = 256
SLOTS = 1 << 20
UNIT = 10**9

ADDED = ("size", "source_size", "target", "rate", "copies", "taken")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = MAX_COPIES) -> DataFrame:
    """``(key, source_size, target)`` for each source of ``sizes (key, source, source_size)``.

    Sources in code point order, null last, have the weights in turn and share all words by them.
    A target stops at ``limit`` times its source's size and the excess goes to the others by
    weight until none is above.  Sources that stop are those of the smallest limit for their
    weight, so sums along that order find where the sharing ends.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    most = F.col("source_size") * float(limit)
    placed = sizes.select("key", "source_size", most.alias("most"), weight.alias("weight"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "key")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # What a unit of weight gets when this source and all after it share what those before leave.
    share = (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    shared = placed.withColumn("share", share)
    level = F.max(F.when(F.col("share") * F.col("weight") <= F.col("most"), F.col("share"))).over(everything)
    return shared.withColumn("level", level).select(
        "key", "source_size",
        F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target"),
    )


def _rate(size: Column, limit: int) -> Column:
    """Rate at the multiplier at hand; sources at their limit have it for every document."""
    return F.when(F.col("full"), F.lit(float(limit))).otherwise(
        F.least(F.lit(float(limit)), F.exp(F.least(F.col("at") * size / F.col("scale"), F.lit(50.0))))
    )


def balance(sizes: DataFrame, goals: DataFrame, limit: int = MAX_COPIES) -> DataFrame:
    """``(key, at, scale, full)``: the multiplier of each source.

    ``sizes (key, size, docs)`` counts documents.  Sources without words keep rate 1.
    """
    size, docs = F.col("size"), F.col("docs")
    scales = sizes.groupBy("key").agg(F.try_divide(F.sum(docs * size * size), F.sum(docs * size)).alias("scale"))
    ratio = F.try_divide("target", "source_size")
    state = cut(
        goals.join(scales, "key").select(
            "key", "target", F.coalesce("scale", F.lit(1.0)).alias("scale"),
            F.coalesce(ratio >= limit * (1 - 1e-12), F.lit(False)).alias("full"),
            F.lit(0.0).alias("at"),
            # All documents have a size of 1 or more here, so these two are beyond the solution.
            F.coalesce(F.least(F.lit(0.0), F.log(ratio)) * F.col("scale"), F.lit(0.0)).alias("low"),
            F.coalesce(F.when(ratio > 1, F.log(F.lit(float(limit))) * F.col("scale")), F.lit(0.0)).alias("high"),
            (F.col("source_size") == 0).alias("done"),
        ).withColumn("done", F.col("done") | F.col("full")),
        "mix-state",
    )
    rate = _rate(size, limit)
    words = docs * size * rate
    slope = F.when(rate < limit, docs * size * size * rate / F.col("scale")).otherwise(0.0)
    for _ in range(MAX_STEPS):
        if state.filter("not done").isEmpty():
            break
        sums = sizes.join(state.filter("not done").select("key", "at", "scale", "full"), "key").groupBy("key").agg(
            F.sum(words).alias("words"), F.sum(slope).alias("slope")
        )
        low = F.when(F.col("words") < F.col("target"), F.col("at")).otherwise(F.col("low"))
        high = F.when(F.col("words") > F.col("target"), F.col("at")).otherwise(F.col("high"))
        # Newton's step for the logarithm of the words, which is nearly straight.
        off = F.log(F.try_divide("words", "target"))
        newton = F.col("at") - off * F.try_divide("words", "slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        near = F.abs(F.col("words") - F.col("target")) <= TOLERANCE * F.col("target")
        state = cut(
            state.join(sums, "key", "left")
            .withColumns({"low": F.when(F.col("done"), F.col("low")).otherwise(low),
                          "high": F.when(F.col("done"), F.col("high")).otherwise(high)})
            .withColumn("over", F.col("done") | F.coalesce(near, F.lit(False)))
            .select(
                "key", "target", "scale", "full",
                F.when(F.col("over"), F.col("at")).when(inside, newton)
                .otherwise((F.col("low") + F.col("high")) / 2).alias("at"),
                "low", "high", F.col("over").alias("done"),
            ),
            "mix-state",
        )
    return state.select("key", "at", "scale", "full")


def settlement(classes: DataFrame) -> DataFrame:
    """``(key, size, change)``: how many documents of a size get one more copy, or one fewer if negative.

    ``classes (key, size, docs, base, more, missing)``: of ``docs`` documents ``more`` have ``base + 1``
    copies and the others ``base``; ``missing`` are the words the whole source lacks.  Each source is
    gone through once from its longest size down, with what is still missing carried along.
    """
    schema = "key string, size long, change long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, 0.0
        for batch in parts(batches, 1 << 16):
            key, size, room_up, room_down, missing = (c.to_pylist() for c in batch.columns)
            changes = []
            for k, s, up, down, m in zip(key, size, room_up, room_down, missing):
                if k != last:
                    last, left = k, m
                change = min(up, int(left // s)) if left > 0 else -min(down, int(-left // s))
                left -= change * s
                changes.append(change)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(changes, pa.int64())], names=["key", "size", "change"])

    base, docs, more = F.col("base"), F.col("docs"), F.col("more")
    limit = F.col("most")
    up = F.when(base + 1 < limit, docs).when(base + 1 == limit, docs - more).otherwise(0).cast("long")
    down = F.when(base >= 1, docs).otherwise(more).cast("long")
    rows = classes.filter("size > 0").select("key", "size", up.alias("up"), down.alias("down"), F.col("missing").cast("double"))
    return rows.repartition("key").sortWithinPartitions("key", F.desc("size")).mapInArrow(run, schema)


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    limit: int = MAX_COPIES,
    keep: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``copies`` is how often the mix takes the document, from 0 to ``limit``, and ``taken`` the
    words this makes.  ``keep`` names the columns that stay (default: all); those named like an
    added one are replaced.  A null source is a source of its own, a null text has size 0; a
    document of size 0 has rate 1.  Which documents of one source and size get one copy more
    follows hashes of id and text, so reruns agree; rows that are the same in both may swap.  A
    source of nothing but empty texts has target 0.  An empty table gives an empty result.
    """
    source = df[source_col].cast("string")
    kept = without(df.select(*[df[c] for c in (df.columns if keep is None else keep)]), ADDED).columns
    key = F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key")
    size = n_words(df[text_col].cast("string")).alias("size")
    mark = F.xxhash64(df[id_col], df[text_col])
    slot = F.pmod(F.shiftright(mark, 20), F.lit(SLOTS)).alias("slot")
    counted = cut(
        df.select(source.alias("source"), key, size, slot).groupBy("source", "key", "size", "slot")
        .agg(F.count("*").alias("docs")),
        "mix-slots",
    )
    n_rows = counted.agg(F.sum("docs")).first()[0] or 0
    dealt = min(SLOTS, 1 + n_rows // PART_ROWS)
    part = F.col("slot") % dealt
    docs, begun, extra, base = F.col("docs"), F.col("begun"), F.col("extra"), F.col("base")

    def plan() -> DataFrame:
        by_size = cut(counted.groupBy("key", "size").agg(F.sum("docs").alias("docs")), "mix-sizes")
        per_source = counted.groupBy("key", "source").agg(F.sum(F.col("size") * docs).alias("source_size"))
        goals = cut(targets(per_source, weights, limit), "mix-targets")
        solved = balance(by_size, goals, limit).join(goals, "key")
        # Fractions of copies counted up from the longest document, then part by part.
        rated = by_size.join(solved, "key").withColumn("rate", F.when(F.col("size") > 0, _rate(F.col("size"), limit)).otherwise(1.0))
        # As whole billionths, so that sums do not depend on their order.
        fraction = F.round((F.col("rate") - F.floor("rate")) * UNIT).cast("long")
        ahead = Window.partitionBy("key").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        rated = cut(
            rated.withColumns({"extra": fraction, "base": F.floor("rate")}).select(
                "key", "size", "source_size", "target", "rate", "extra", "base", "docs",
                (F.coalesce(F.sum(extra * docs).over(ahead), F.lit(0)) + UNIT // 2).alias("begun"),
            ),
            "mix-rates",
        )
        # A class of documents with copies at their limit has no fraction.
        more = _whole(begun + extra * docs) - _whole(begun)
        classes = rated.withColumns({"more": more, "most": F.lit(limit)})
        taken = classes.groupBy("key").agg(
            (F.max("target") - F.sum(F.col("size") * (base * docs + F.col("more")))).alias("missing")
        )
        changes = settlement(classes.join(taken, "key"))
        rated = cut(rated.drop("docs").join(changes, ["key", "size"], "left").fillna(0, ["change"]), "mix-changes")
        earlier = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        offsets = counted.groupBy("key", "size", part.alias("part")).agg(F.sum("docs").alias("docs")).select(
            "key", "size", "part", F.coalesce(F.sum("docs").over(earlier), F.lit(0)).alias("offset")
        )
        return offsets.join(rated, ["key", "size"])

    planned = settled(df.sparkSession, "mix-plan", plan)
    within = Window.partitionBy("key", "size", "part").orderBy("mark")
    every = df.select(F.struct(*[df[c] for c in kept]).alias("row"), key, size, mark.alias("mark"), (slot % dealt).alias("part"))
    place = F.col("offset") + F.col("rank")
    upto = _whole(begun + extra * place) - _whole(begun)
    one_more = upto - _whole(begun + extra * (place - 1)) + _whole(begun)
    # The first documents of a size that can take a change have it.
    change = F.col("change")
    rising = F.when(base + 1 < limit, place <= change).otherwise((one_more == 0) & (place - upto <= change))
    falling = F.when(base >= 1, place <= -change).otherwise((one_more == 1) & (upto <= -change))
    copies = (base + one_more + F.when((change > 0) & rising, 1).when((change < 0) & falling, -1).otherwise(0)).cast("long")
    return (
        every.withColumn("rank", F.row_number().over(within))
        .join(planned, ["key", "size", "part"])
        .withColumn("copies", copies)
        .select("row.*", "size", "source_size", "target", "rate", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def _whole(billionths: Column) -> Column:
    """Whole units; the division is of a multiple, so it is exact."""
    return ((billionths - F.pmod(billionths, F.lit(UNIT))) / UNIT).cast("long")
