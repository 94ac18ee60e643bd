"""Near-duplicates by SimHash fingerprints.

Linking takes each different fingerprint once.  Its 64 bits are cut into 16 segments of 4, and the
bit counts of the segments are a point of a grid.  Each differing bit changes one count by one, so
the Manhattan distance of two points is at most the number of differing bits.  Points enter their
own grid cell and those one step away; two points at a distance of 2 or less then share a cell,
and whoever shares a cell is compared bit by bit.

A cell with very many fingerprints is not expanded into pairs.  Its members are linked through the
fingerprints one bit away from them: two fingerprints differ in at most 2 bits exactly when they
share one, and a chain through its smallest member links all that share it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.llm.common import add_columns
from civictopics.storage import cut, settled

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENTS = 16
CELL_ROWS = 64
# How many shingles of a long text are held at a time.
SLICE = 1 << 16

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = 256 * np.arange(8)


def _bit_counts(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    seen = np.bincount((octets + _PLACES).ravel(), minlength=2048).reshape(8, 256)
    return (seen @ _BITS).ravel()


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum([len(word) + 1 for word in words])
    first = np.concatenate([[0], ends[: n - 1]])
    last = ends[-n:] - 1
    counts, take = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, SLICE):
        spans = zip(first[at : at + SLICE].tolist(), last[at : at + SLICE].tolist())
        counts += _bit_counts([take(joined[a:b], seed) for a, b in spans])
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, text_col: str = "text", size: int = SHINGLE, seed: int = SEED,
                      keep: list[str] | None = None) -> DataFrame:
    """Adds ``bits``, the fingerprint as a signed long.  Null texts count as empty."""

    def compute(texts):
        values = np.array([fingerprint(t, size, seed) for t in texts], dtype=np.uint64)
        return [values.view(np.int64)]

    return add_columns(df, text_col, [("bits", T.LongType())], compute, keep)


def _points(fingerprints: DataFrame) -> DataFrame:
    """Adds ``point``: sixteen bit counts of 0 to 4 in the sixteen hex digits of a long."""
    ones = [f"(shiftrightunsigned(bits, {k}) & 1229782938247303441L)" for k in range(4)]
    return fingerprints.select("bits", F.expr(" + ".join(ones)).alias("point"))


def _cells(fingerprints: DataFrame) -> DataFrame:
    """``(cell, bits)``: each point's own cell and those one step away."""
    near = [F.col("point")]
    for segment in range(SEGMENTS):
        count, step = F.expr(f"shiftright(point, {4 * segment}) & 15L"), F.lit(1 << 4 * segment)
        near += [F.when(count < 4, F.col("point") + step), F.when(count > 0, F.col("point") - step)]
    cells = _points(fingerprints).select("bits", F.explode(F.array_compact(F.array(*near))).alias("cell"))
    return cells.select("cell", "bits")


def similar_fingerprints(fingerprints: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(node, other)`` in both directions for different ``bits`` at most ``MAX_BITS`` bits apart.

    In cells of more than ``cell_rows`` members only a chain of links is given, which connects the
    same fingerprints.
    """
    cells = cut(_cells(fingerprints), "simhash-cells")
    crowded = cut(
        cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows).select("cell"),
        "simhash-crowded",
    )
    left = cells.join(crowded, "cell", "left_anti").withColumnRenamed("bits", "node")
    right = cells.withColumnRenamed("bits", "other")
    apart = F.bit_count(F.col("node").bitwiseXOR(F.col("other")))
    pairs = left.join(right, "cell").filter((F.col("node") < F.col("other")) & (apart <= MAX_BITS))
    flips = F.array(F.col("bits"), *[F.col("bits").bitwiseXOR(F.lit(np.int64(np.uint64(1 << b)).item())) for b in range(64)])
    members = cells.join(crowded, "cell", "left_semi").select("bits").distinct()
    shared = members.select(F.col("bits").alias("other"), F.explode(flips).alias("one_away"))
    heads = shared.groupBy("one_away").agg(F.min("other").alias("node"))
    chains = shared.join(heads, "one_away").filter("node <> other")
    links = cut(pairs.select("node", "other").unionByName(chains.select("node", "other")).distinct(), "simhash-links")
    return links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other")))


def components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``links (node, other)``; ``label`` is the smallest one it reaches.

    Rounds of large and small stars: first the larger neighbours of each node move to its smallest
    neighbour, then the smaller ones and itself, until every component is a star around its smallest
    node.  The joins carry no hint and have one row for a node on one side, so Spark can split a hot one.
    """

    def lowest(edges: DataFrame) -> DataFrame:
        return edges.groupBy("node").agg(F.least("node", F.min("other")).alias("low"))

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "other"))).first())

    def turned(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("other").alias("node"), F.col("node").alias("other"))

    edges = cut(links.select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct(), "stars")
    before = mark(edges)
    while True:
        both = edges.unionByName(turned(edges))
        large = cut(
            both.join(lowest(both), "node").filter("other > node").select(F.col("other").alias("node"), F.col("low").alias("other")).distinct(),
            "stars",
        )
        low = lowest(large)
        smaller = large.join(low, "node").filter("other <> low").select(F.col("other").alias("node"), F.col("low").alias("other"))
        edges = cut(smaller.unionByName(low.withColumnRenamed("low", "other")).distinct(), "stars")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("other").alias("node"), F.col("other").alias("label")).distinct()
    return edges.withColumnRenamed("other", "label").unionByName(roots)


def _rows_and_components(source: DataFrame, size: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, mark, bits)`` of the rows of ``source (doc_id, mark, text)``, and ``(bits, component_id)``."""
    rows = cut(with_fingerprints(source, "text", size, seed, keep=["doc_id", "mark"]), "simhash-rows")

    def linked() -> DataFrame:
        known = cut(rows.groupBy("bits").agg(F.min("doc_id").alias("first")), "simhash-known")
        labels = components(cut(similar_fingerprints(known.select("bits")), "simhash-links"))
        members = labels.select(F.col("node").alias("bits"), "label").join(known, "bits")
        lowest = members.groupBy("label").agg(F.min("first").alias("lowest"))
        found = members.join(lowest, "label").select("bits", "lowest")
        return known.join(found, "bits", "left").select("bits", F.coalesce("lowest", "first").alias("component_id"))

    return rows, settled(source.sparkSession, "simhash-components", linked)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = df[text_col].cast("string")
    return df.select(df[id_col].alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def near_duplicate_groups(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``df``.

    Fingerprints of at most 2 differing bits are linked, and ``component_id`` is the smallest id
    that links reach, the row's own included; null ids are passed over.  Texts that are null,
    empty or without words have fingerprint 0, which is linked like any other.  Texts of any length
    count whole.  Repeated rows have the same result.  Extra columns are not read.
    """
    rows, found = _rows_and_components(_source(df, id_col, text_col), size, seed)
    # One row for each fingerprint on this side, so Spark can split a frequent one's rows among tasks.
    return rows.join(found, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """The rows of ``df`` whose id is that of their group, with all their columns.

    Rows without an id stay where no row of their group has one.  Different texts of one id are told
    apart by a hash of the text; rows equal in both share their fate.  An empty table stays empty.
    """
    rows, found = _rows_and_components(_source(df, id_col, text_col), size, seed)
    kept = settled(
        df.sparkSession, "simhash-kept",
        lambda: rows.join(found, "bits").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias("kept id"), F.col("mark").alias("kept mark")).distinct(),
    )
    same = df[id_col].eqNullSafe(kept["kept id"]) & (F.xxhash64(df[text_col].cast("string")) == kept["kept mark"])
    return df.join(kept, same, "left_semi")
