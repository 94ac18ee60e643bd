"""Merging topics step by step: a tree of average linkage, from which any number of topics is read.

Topics of many runs are merged at once.  In each round every group finds its most similar other group, and
all pairs that choose each other are joined.  Average linkage is reducible: a merge never brings two groups
closer to a third than the nearer of them was, so pairs that choose each other in one round are also merged
by the plain procedure of one pair at a time, and ordering the merges by similarity gives its steps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from civictopics.storage import cut


def _both_ways(links: DataFrame, by: list[str]) -> DataFrame:
    turned = links.select(*by, F.col("other").alias("topic"), F.col("topic").alias("other"), *links.columns[len(by) + 2:])
    return links.unionByName(turned)


def merge_tree(sizes: DataFrame, similar: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., kept, gone, sim, step)``: the merges of ``sizes (by..., topic, cnt)``, step 1 first.

    ``similar (by..., topic, other, sim)`` lists similarities of topics; pairs that it leaves out, and null
    ones, have similarity 0, and pairs given twice or in both directions count once, by the highest value.
    Topic -1, the outliers, is never merged, nor are null topics.  The similarity of two groups is the mean
    over their pairs of topics, weighted by ``cnt`` and rounded to nine digits.  A merged group has the
    smaller of the two topic numbers.  Ties go to the pair with the smaller numbers, and at the end groups
    without any similarity are joined to the smallest number.  Similarities must not be negative.

    Only pairs with a similarity are kept, so the work grows with the given links.  Each round is one
    grouping over the links left; the number of rounds grows about with the logarithm of the topics of
    a run, and with their number where every merge waits for the one before.
    """
    by = list(by)
    keys = [*by, "topic"]
    groups = cut(
        sizes.filter("topic is not null and topic <> -1").groupBy(*keys).agg(F.sum("cnt").cast("double").alias("cnt")), "groups"
    )
    inside = groups.select(*keys)
    pairs = similar.filter("sim > 0 and topic <> other").select(
        *by, F.least("topic", "other").alias("topic"), F.greatest("topic", "other").alias("other"), "sim"
    ).groupBy(*keys, "other").agg(F.max("sim").alias("sim"))
    pairs = pairs.join(inside, keys, "left_semi").join(inside.withColumnRenamed("topic", "other"), [*by, "other"], "left_semi")
    weighed = pairs.join(groups, keys).join(
        groups.select(*by, F.col("topic").alias("other"), F.col("cnt").alias("other_cnt")), [*by, "other"]
    )
    # total: the sum of similarity times both sizes over the pairs of topics of two groups.
    total = F.col("sim") * F.col("cnt") * F.col("other_cnt")
    links = cut(weighed.select(*keys, "other", "cnt", "other_cnt", total.alias("total")), "links")
    done = []
    while True:
        rated = links.select(
            *keys, "other", F.round(F.col("total") / (F.col("cnt") * F.col("other_cnt")), 9).alias("sim"),
            (F.col("cnt") + F.col("other_cnt")).alias("both"),
        )
        # The order of pairs is the same for all groups, so the best pair of a run always chooses itself.
        order = F.struct(F.col("sim"), -F.least("topic", "other"), -F.greatest("topic", "other"))
        best = _both_ways(rated, by).groupBy(*keys).agg(F.max_by(F.struct("other", "sim", "both"), order).alias("best"))
        chosen = best.select(*keys, "best.*")
        # A pair that chose each other stands here twice.
        pair = [F.least("topic", "other").alias("kept"), F.greatest("topic", "other").alias("gone")]
        merges = cut(
            chosen.select(*by, *pair, "sim", "both").groupBy(*by, "kept", "gone")
            .agg(F.max("sim").alias("sim"), F.max("both").alias("both"), F.count("*").alias("n")).filter("n = 2").drop("n"),
            "merges",
        )
        if merges.isEmpty():
            break
        done.append(merges.drop("both"))
        into = merges.select(*by, F.explode(F.array("kept", "gone")).alias("topic"), F.col("kept").alias("into"), "both")
        moved = links.join(into, keys, "left").join(
            into.select(*by, F.col("topic").alias("other"), F.col("into").alias("other_into"), F.col("both").alias("other_both")),
            [*by, "other"], "left",
        )
        mine = F.struct(F.coalesce("into", "topic").alias("topic"), F.coalesce("both", "cnt").alias("cnt"))
        theirs = F.struct(F.coalesce("other_into", "other").alias("topic"), F.coalesce("other_both", "other_cnt").alias("cnt"))
        ends = moved.select(*by, F.least(mine, theirs).alias("a"), F.greatest(mine, theirs).alias("b"), "total")
        joined = ends.filter("a.topic <> b.topic").groupBy(*by, "a", "b").agg(F.sum("total").alias("total"))
        links = cut(
            joined.select(*by, "a.topic", F.col("b.topic").alias("other"), "a.cnt", F.col("b.cnt").alias("other_cnt"), "total"),
            "links",
        )
    # What is left has no similarity to anything else of its run.
    run = Window.partitionBy(*by)
    for merges in done:
        groups = groups.join(merges.select(*by, F.col("gone").alias("topic")), keys, "left_anti")
    rest = groups.withColumn("kept", F.min("topic").over(run)).filter("topic <> kept")
    tree = rest.select(*by, "kept", F.col("topic").alias("gone"), F.lit(0.0).alias("sim"))
    for merges in done:
        tree = tree.unionByName(merges)
    steps = run.orderBy(F.desc("sim"), "kept", "gone")
    return tree.withColumn("step", F.row_number().over(steps).cast("long"))


def cut_tree(topics: DataFrame, tree: DataFrame, target: int | DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., topic, into)``: the group of each of ``topics (by..., topic)`` when ``target`` are left.

    ``target`` counts the topics without the outliers; a table ``(by..., target)`` sets it per run.  Targets
    below 1 leave one group, those above the number of topics merge nothing.  Groups follow their merges by
    pointer jumping, so a chain of n merges takes log n rounds.
    """
    by = list(by)
    keys = [*by, "topic"]
    wanted = topics.select(*keys).distinct()
    number = tree.groupBy(*by).agg((F.max("step") + 1).alias("n"))
    if by:
        given = target.select(*by, "target") if isinstance(target, DataFrame) else number.select(*by, F.lit(target).alias("target"))
        merged = tree.join(number, by).join(given, by)
    else:
        given = target.select("target").scalar() if isinstance(target, DataFrame) else F.lit(target)
        merged = tree.withColumns({"n": number.select("n").scalar(), "target": given})
    used = merged.filter(F.col("step") <= F.col("n") - F.greatest("target", F.lit(1)))
    into = cut(used.select(*by, F.col("gone").alias("topic"), F.col("kept").alias("into")), "pointers")
    while True:
        after = into.select(*by, F.col("topic").alias("into"), F.col("into").alias("further"))
        followed = cut(
            into.join(after, [*by, "into"], "left")
            .select(*keys, F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved")),
            "pointers",
        )
        into = followed.select(*keys, "into")
        if followed.filter("moved").isEmpty():
            break
    return wanted.join(into, keys, "left").select(*keys, F.coalesce("into", "topic").alias("into"))
