"""Line de-duplication by an exact set-similarity join.

A line is the set of its words (A-Z lower-cased).  A line is removed when a line before it, by
document id and place, has a Jaccard similarity of 0.8 or more with it; lines without words stay.

The join orders the words of a line from rare to frequent.  Two similar lines share a word among
the first ``n - ceil(0.8 n) + 1`` of either, so only these are posted, and words that occur once
are left out.  Lines that share a posted word are compared by length, by the place of the word,
and by a 128-bit parity sketch whose differing bits are at most the words the sets do not share.
What passes all three is verified on the words themselves, unless the two lines are equal: that is
decided by their sketch, which comes from one 64-bit hash of the words, and the sum of another one.

1. The best earlier candidate of each line is verified.  Most lines that have a similar one are
   settled here, so a large group of near copies never becomes all its pairs.
2. Of lines not settled, up to eight candidates by each posted word are verified.
3. Lines still not settled meet all postings of those words that gave them more than these, under
   sketches of 512 bits, which hardly let a pair below the threshold pass, however many there are in
   one family.  These pairs, few by then, are verified in the same way.

A task posts a set once; lines equal to one that the task has posted are settled at once.  A frequent
word is posted in pages of bounded size, dealt by the set, so that equal sets share a page; lines of
four words or more that their own page does not settle take part in step 3, whose join Spark can
split (sets of fewer words are similar to equal sets only).  Rarity comes from counts in a fixed number
of buckets; any order of words gives the same result, a good one posts fewer common words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civictopics.llm.common import parts, pieces
from civictopics.storage import cut, settled

RARITY_BUCKETS = 1 << 22
# Words with more occurrences are posted in pages of about so many.
PAGE_ROWS = 1 << 17
# Lines to verify are marked in so many bits; lines marked by chance are read in vain.
MARKS = 1 << 27
# Sets that a task remembers to have posted; when there are more, it may post some again.
REMEMBERED = 200_000
# Candidates of a posting that are named; step 3 takes all when there are more.
NAMED = 8
SLICE = 1 << 20
LINES = 4096
HASH_BITS = 46
# Longer words are hashed one by one.
SHORT_WORD = 64
CHUNK = 1 << 16

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """Well-spread 64 bits of each value."""
    out = values + np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def hashed_words(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word, mixed eight bytes at a time; ``data`` goes on for 8 bytes after the last."""
    eights = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))
    one, two = mixed(size.astype(np.uint64), 0x9E3779B9), mixed(size.astype(np.uint64), 0x85EBCA6B)
    left, at = np.flatnonzero(size <= SHORT_WORD), 0
    while len(left):
        some = eights[first[left] + at] & _TAILS[np.minimum(size[left] - at, 8)]
        one[left] = mixed(one[left] ^ some, 0x632BE5AB)
        two[left] = mixed(two[left] + some * np.uint64(0xD6E8FEB86659FD93), 0x1B873593)
        at += 8
        left = left[size[left] > at]
    for k in np.flatnonzero(size > SHORT_WORD).tolist():
        word = data[first[k] : first[k] + size[k]].tobytes()
        one[k], two[k] = (xxhash.xxh64_intdigest(word, seed) for seed in (7, 11))
    return one, two


@dataclass
class Words:
    """Hashed words of some texts, in order; ``row`` and ``line`` say where each one stands."""

    row: np.ndarray
    line: np.ndarray
    hashed: np.ndarray
    second: np.ndarray
    first: np.ndarray
    last: np.ndarray
    data: bytes


def _line_slices(data: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in slices of whole lines, with the number of the first; a line that is longer than a
    slice is given as its different words."""
    at = line = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.rfind(b"\n", at, at + SLICE)
        if end >= 0:
            part = data[at:end]
        else:
            end = data.find(b"\n", at + SLICE)
            end = len(data) if end < 0 else end
            different: set[bytes] = set()
            for piece in pieces(data[at:end]):
                different.update(piece.split())
            part = b" ".join(sorted(different))
        yield part, line
        line += part.count(b"\n") + 1
        at = end + 1


def words(texts: list[str | None]) -> Iterator[Words]:
    """The words of whole texts, of about ``SLICE`` bytes at a time."""
    held, size = [], 0
    for row, text in enumerate(texts):
        data = text.encode().lower() if text else b""
        for part, line in _line_slices(data) if len(data) > SLICE else [(data, 0)] if data else []:
            held.append((part, row, line))
            size += len(part) + 1
            if size >= SLICE:
                yield _words_of(held)
                held, size = [], 0
    if held:
        yield _words_of(held)


def _words_of(held: list[tuple[bytes, int, int]]) -> Words:
    whole = b"\n".join([*(part for part, _, _ in held), bytes(8)])
    data = np.frombuffer(whole, dtype=np.uint8)
    space = _SPACE[data]
    space[-8:] = True
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    last = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    hashed, second = hashed_words(data, first, last - first)
    begin = np.cumsum([0, *(len(part) + 1 for part, _, _ in held[:-1])])
    breaks = np.flatnonzero(data == 10)
    place = np.searchsorted(begin, first, side="right") - 1
    rows, lines = (np.array([h[k] for h in held], dtype=np.int64) for k in (1, 2))
    line = np.searchsorted(breaks, first) - np.searchsorted(breaks, begin)[place] + lines[place]
    return Words(rows[place], line, hashed, second, first, last, whole)


@dataclass
class Sets:
    """Word sets of lines, each from its rarest word on: one row per line, words end to end.

    ``whole`` is the sum of the second hashes of all words of a line, repeats included.
    """

    row: np.ndarray
    line: np.ndarray
    size: np.ndarray
    start: np.ndarray
    words: np.ndarray
    whole: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    data: bytes

    def said(self, at: int) -> str:
        """The different words of a line in one fixed order."""
        return b" ".join(sorted(set(self.data[self.begin[at] : self.end[at]].split()))).decode()


def sets(texts: list[str | None], rarity: np.ndarray) -> Iterator[Sets]:
    """Word sets of all lines that have words.  A word is its rarity class, then its hash."""
    for found in words(texts):
        if not len(found.hashed):
            continue
        new = np.concatenate([[True], (found.row[1:] != found.row[:-1]) | (found.line[1:] != found.line[:-1])])
        number = np.cumsum(new) - 1
        heads = np.append(np.flatnonzero(new), len(new))
        classes = rarity[found.hashed & np.uint64(RARITY_BUCKETS - 1)].astype(np.uint64)
        ranked = classes << np.uint64(HASH_BITS) | found.hashed >> np.uint64(64 - HASH_BITS)
        for at in range(0, len(heads) - 1, LINES):
            chosen = heads[at : at + LINES + 1]
            lo, hi = chosen[0], chosen[-1]
            keys = np.unique((number[lo:hi] - at).astype(np.uint64) << np.uint64(52) | ranked[lo:hi])
            size = np.bincount((keys >> np.uint64(52)).astype(np.int64))
            yield Sets(found.row[chosen[:-1]], found.line[chosen[:-1]], size, np.cumsum(size) - size,
                       keys & np.uint64((1 << 52) - 1), np.add.reduceat(found.second[lo:hi], chosen[:-1] - lo), found.first[chosen[:-1]], found.last[chosen[1:] - 1], found.data)


def rarity_class(counts: np.ndarray) -> np.ndarray:
    """Six bits for a count: 0 for one occurrence, else twice its binary logarithm."""
    return np.minimum(63, (2 * np.log2(np.maximum(counts, 1))).astype(np.int64)).astype(np.uint8)


def pages_of(classes: np.ndarray, page_rows: int) -> np.ndarray:
    """Into how many pages the postings of words of these classes are dealt."""
    most = np.exp2((np.arange(64) + 1) / 2)
    return np.maximum(1, np.ceil(most / page_rows)).astype(np.int64)[classes]


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Words of which similar lines share one: size - ceil(0.8 size) + 1."""
    return size - (4 * size + 4) // 5 + 1


# ------------------------------------------------------------------------------ passes

KEY = ["doc", "mark", "line"]


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, hashes of texts and texts; a null id comes before all others."""
    text = df[text_col].cast("string")
    return df.select(F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    doc, mark = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    return doc, mark, batch.column(2).to_pylist()


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, dtype=np.uint64).view(np.int64)


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def packed(values: DataFrame, size: int) -> np.ndarray:
    """A table of ``size`` small numbers from rows ``(place int, value int)``, packed into chunks on Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, np.zeros(CHUNK, dtype=np.uint8)
        for batch in parts(batches, 1 << 20):
            place, value = (batch.column(k).to_numpy() for k in (0, 1))
            edges = np.flatnonzero(np.concatenate([[True], place[1:] // CHUNK != place[:-1] // CHUNK, [True]]))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if place[lo] // CHUNK != chunk:
                    if chunk is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([held.tobytes()])], names=["chunk", "held"])
                    chunk, held = int(place[lo] // CHUNK), np.zeros(CHUNK, dtype=np.uint8)
                held[place[lo:hi] % CHUNK] = value[lo:hi]
        if chunk is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([held.tobytes()])], names=["chunk", "held"])

    dealt = values.repartition(F.expr(f"place div {CHUNK}")).sortWithinPartitions("place")
    out = np.zeros(-(-size // CHUNK) * CHUNK, dtype=np.uint8)
    for chunk, held in dealt.mapInArrow(run, "chunk int, held binary").collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(held, dtype=np.uint8)
    return out


def rarity(source: DataFrame) -> np.ndarray:
    """Class of each bucket of words, from the words of all texts; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(RARITY_BUCKETS, dtype=np.int64)
        for batch in parts(batches):
            for found in words(_texts(batch)[2]):
                at, number = np.unique(found.hashed & np.uint64(RARITY_BUCKETS - 1), return_counts=True)
                total[at.astype(np.int64)] += number
        used = np.flatnonzero(total)
        for at in range(0, len(used), 1 << 18):
            part = used[at : at + (1 << 18)]
            yield _batch("place int, n long", [part, total[part]])

    counts = source.mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    # The class as rarity_class has it; the logarithm never meets a whole number from below.
    value = F.least(F.lit(63), F.floor(2 * F.log2(F.col("n").cast("double")) + 1e-9)).cast("int")
    return packed(counts.select("place", value.alias("value")), RARITY_BUCKETS)


POSTING = "word long, page int, doc long, mark long, line int, size int, place int, whole long, sketch long, sketch_too long"
# The page of rows that say that a line equals one its task has posted.
EQUAL = -2


class _Poster:
    """What a task posts of its lines."""

    def __init__(self, page_rows: int):
        self.page_rows = page_rows
        self.seen: dict[tuple[int, int, int], tuple[int, int, int]] = {}

    def post(self, found: Sets, doc: np.ndarray, mark: np.ndarray) -> tuple[list[np.ndarray], list[tuple], np.ndarray]:
        """Columns of ``POSTING``, lines equal to an earlier one, and the line of each posting."""
        n = len(found.row)
        spot = mixed(found.words, 3)
        sketches = parity(found, spot, 2)
        fresh, equal = np.zeros(n, dtype=bool), []
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        order = np.lexsort((found.line, mark, doc))
        for i, *key, a, b, c in zip(order.tolist(), *(x[order].tolist() for x in (found.whole, *sketches, doc, mark, found.line))):
            key, at = tuple(key), (a, b, c)
            known = self.seen.get(key)
            if known is None or at < known:
                self.seen[key] = at
                fresh[i] = True
            elif at > known:
                equal.append((at, known))
        length = np.where(fresh, prefix_length(found.size), 0)
        owner = np.repeat(np.arange(n), length)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length)
        word = found.words[found.start[owner] + place]
        chosen = word >> np.uint64(HASH_BITS) > 0
        owner, place, word = owner[chosen], place[chosen], word[chosen]
        pages = pages_of((word >> np.uint64(HASH_BITS)).astype(np.int64), self.page_rows)
        # Words in one page only have page -1.
        page = np.where(pages > 1, (sketches[0][owner] % pages.astype(np.uint64)).astype(np.int64), -1)
        columns = [_signed(word), page, doc[owner], mark[owner], found.line[owner], found.size[owner], place, _signed(found.whole[owner]), *(_signed(k[owner]) for k in sketches)]
        return columns, equal, owner


def parity(found: Sets, spot: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each line ``n`` times 64 bits, flipped once by each of its words."""
    part = spot >> np.uint64(52) & np.uint64(n - 1)
    bit = np.uint64(1) << (spot >> np.uint64(58))
    return [np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), found.start) for k in range(n)]


def _postings(table, page_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of the first line of each set in this task, by id and place.

    Lines equal to one of these come with the place of that one where others have their sketch.
    """
    poster = _Poster(page_rows)
    for batch in parts(batches):
        docs, marks, texts = _texts(batch)
        for found in sets(texts, table.value):
            columns, equal, _ = poster.post(found, docs[found.row], marks[found.row])
            yield _batch(POSTING, columns)
            if equal:
                doc, mark, line = (np.array(x, dtype=np.int64) for x in zip(*(at for at, _ in equal)))
                to_doc, to_mark, to_line = (np.array(x, dtype=np.int64) for x in zip(*(to for _, to in equal)))
                dealt = mixed(doc.view(np.uint64) ^ mixed(line.view(np.uint64)))
                none = np.zeros(len(doc), dtype=np.int64)
                yield _batch(POSTING, [_signed(dealt), none + EQUAL, doc, mark, line, none, to_line, to_doc, to_mark, none])


PAIR = ("doc long, mark long, line int, other_doc long, other_mark long, other_line int, apart int, more boolean, word long, page int")


def _best_earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The closest earlier candidate of each posting, from postings sorted by word, page and line."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        word, page = columns[0], columns[1]
        # The last group may go on in the next batch.
        last = (word == word[-1]) & (page == page[-1])
        end = 0 if last.all() else len(word) - int(last[::-1].argmin())
        held = [c[end:] for c in columns]
        if end:
            yield _compared([c[:end] for c in columns])
    if held is not None and len(held[0]):
        yield _compared(held)


def _compared(columns: list[np.ndarray]) -> pa.RecordBatch:
    known = columns[1] == EQUAL
    _, _, *equal = [c[known] for c in columns]
    word, page, doc, mark, line, size, place, whole, *sketches = [c[~known] for c in columns]
    size, place = size.astype(np.int64), place.astype(np.int64)
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (page[1:] != page[:-1])])[: len(word)]
    rank = np.arange(len(word)) - np.maximum.accumulate(np.where(new, np.arange(len(word)), 0))
    best, found = np.full(len(word), 1 << 20, dtype=np.int64), np.full(len(word), -1)
    passing = np.zeros(len(word), dtype=np.int64)
    later = np.flatnonzero(rank)
    named: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lag = 1
    while len(later):
        earlier = later - lag
        a, b = size[later], size[earlier]
        need = (4 * (a + b) + 8) // 9
        reach = np.minimum(place[later], place[earlier]) + np.minimum(a - place[later], b - place[earlier])
        apart = sum(np.bitwise_count((k[later] ^ k[earlier]).view(np.uint64)).astype(np.int64) for k in sketches)
        ok = (5 * np.minimum(a, b) >= 4 * np.maximum(a, b)) & (reach >= need) & (apart <= a + b - 2 * need)
        # Equal rows post the same line twice.
        ok &= (doc[later] != doc[earlier]) | (mark[later] != mark[earlier]) | (line[later] != line[earlier])
        same = (apart == 0) & (a == b) & (whole[later] == whole[earlier])
        hit, near = later[ok], np.where(same, -1, apart)[ok]
        first = passing[hit] < NAMED
        named.append((hit[first], hit[first] - lag, near[first]))
        passing[hit] += 1
        closer = near < best[hit]
        best[hit[closer]], found[hit[closer]] = near[closer], hit[closer] - lag
        lag += 1
        later = later[rank[later] >= lag]
    # A posting in a page goes on even without a candidate, unless only equal sets are similar to it.
    at = np.flatnonzero((found >= 0) | (page >= 0) & (size > 3))
    to = np.where(found[at] >= 0, found[at], at)
    more = ((passing[at] > NAMED) | (page[at] >= 0) & (size[at] > 3)) & (best[at] >= 0)
    # An equal line needs no other candidate.
    others = [np.concatenate(c) for c in zip(*named)] if named else [at[:0]] * 3
    other = (best[others[0]] >= 0) & (found[others[0]] != others[1])
    at, to, near = (np.concatenate(c) for c in zip((at, to, best[at]), (x[other] for x in others)))
    more = np.concatenate([more, np.zeros(other.sum(), dtype=bool)])
    columns = [doc[at], mark[at], line[at], doc[to], mark[to], line[to], near, more, word[at], page[at]]
    doc, mark, line, _, to_line, to_doc, to_mark, _ = equal
    none = np.zeros(len(doc), dtype=np.int64)
    columns = [np.concatenate(c) for c in zip(columns, [doc, mark, line, to_doc, to_mark, to_line, none - 1, none > 0, none, none])]
    return _batch(PAIR, columns)


def _spots(doc: np.ndarray, mark: np.ndarray, line: np.ndarray) -> np.ndarray:
    spread = mixed(mixed(doc.astype(np.int64).view(np.uint64), 5) ^ mark.astype(np.int64).view(np.uint64), 6) + line.astype(np.uint64)
    return (mixed(spread, 7) % np.uint64(MARKS)).astype(np.int64)


def _is_marked(table: np.ndarray, spot: np.ndarray) -> np.ndarray:
    return (table[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)


def _marked(rows: DataFrame) -> np.ndarray:
    """Bits for ``rows (doc, mark, line)`` in a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _spots(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            yield _batch("place int, bit int", [spot >> 3, 1 << (spot & 7)])

    bits = rows.mapInArrow(run, "place int, bit int").groupBy("place").agg(F.bit_or("bit").alias("value"))
    return packed(bits, MARKS // 8)


def _similar(said: Column, other: Column) -> Column:
    """Whether two sets, as joined words, have a Jaccard similarity of 0.8 or more."""
    mine, theirs = F.split(said, " "), F.split(other, " ")
    shared = F.size(F.array_intersect(mine, theirs))
    return 5 * shared >= 4 * (F.size(mine) + F.size(theirs) - shared)


SAID = "doc long, mark long, line int, said string"


def verified(source: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines of ``pairs`` whose words are similar enough to those of the other line.

    The words are read again from the texts, for the lines of the pairs only.
    """
    lines = pairs.select(*KEY).unionByName(pairs.select(*[F.col(f"other_{k}").alias(k) for k in KEY]))
    wanted = source.sparkSession.sparkContext.broadcast(_marked(lines))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = np.zeros(RARITY_BUCKETS, dtype=np.uint8)
        for batch in parts(batches):
            docs, marks, texts = _texts(batch)
            for found in sets(texts, plain):
                doc, mark = docs[found.row], marks[found.row]
                at = np.flatnonzero(_is_marked(wanted.value, _spots(doc, mark, found.line)))
                yield _batch(SAID, [doc[at], mark[at], found.line[at], [found.said(k) for k in at.tolist()]])

    known = cut(source.mapInArrow(run, SAID), "line-words")
    # Equal rows have their lines twice.  These shuffles are the ones that the joins need.
    mine = known.groupBy(*KEY).agg(F.min("said").alias("said"))
    others = known.select(*[F.col(c).alias(f"other_{c}") for c in known.columns])
    others = others.groupBy(*[f"other_{k}" for k in KEY]).agg(F.min("other_said").alias("other_said"))
    joined = pairs.join(mine, KEY).join(others, [f"other_{k}" for k in KEY])
    return joined.filter(_similar(F.col("said"), F.col("other_said"))).select(*KEY)


# 512 bits of a line in one binary value cannot be compared in Spark, so they are eight numbers.
WIDE = [f"wide{k}" for k in range(8)]
FURTHER = "word long, doc long, mark long, line int, size int, place int, " + ", ".join(f"{w} long" for w in WIDE) + ", probing boolean"


def _further(source: DataFrame, table, page_rows: int, probes: DataFrame) -> DataFrame:
    """Lines of ``probes (doc, mark, line, word)`` that are similar to any earlier line posted under that word."""
    none, context = F.lit(0), source.sparkSession.sparkContext
    posted = context.broadcast(
        _marked(probes.select(F.col("word").alias("doc"), none.cast("long").alias("mark"), none.alias("line")).distinct())
    )
    asking = context.broadcast(_marked(probes.select(*KEY).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        poster = _Poster(page_rows)
        for batch in parts(batches):
            docs, marks, texts = _texts(batch)
            for found in sets(texts, table.value):
                (word, _, doc, mark, line, size, place, *_), _, owner = poster.post(found, docs[found.row], marks[found.row])
                zero = np.zeros(len(owner), dtype=np.int64)
                at = np.flatnonzero(_is_marked(posted.value, _spots(word, zero, zero)))
                if len(at):
                    wide = parity(found, mixed(found.words, 4), len(WIDE))
                    probing = _is_marked(asking.value, _spots(doc[at], mark[at], line[at]))
                    yield _batch(FURTHER, [*(c[at] for c in (word, doc, mark, line, size, place)), *(_signed(w[owner[at]]) for w in wide), probing])

    postings = cut(source.mapInArrow(run, FURTHER), "line-postings")
    # Marks let some lines through by chance; the join has the last word.
    mine = postings.filter("probing").drop("probing").join(probes, ["word", *KEY], "left_semi")
    others = postings.select("word", *[F.col(c).alias(f"other_{c}") for c in postings.columns if c not in ("word", "probing")])
    need = F.expr("(4 * (size + other_size) + 8) div 9")
    reach = F.least("place", "other_place") + F.least(F.expr("size - place"), F.expr("other_size - other_place"))
    apart = sum(F.bit_count(F.col(k).bitwiseXOR(F.col(f"other_{k}"))) for k in WIDE)
    alike = 5 * F.least("size", "other_size") >= 4 * F.greatest("size", "other_size")
    close = (reach >= need) & (apart <= F.expr("size + other_size") - 2 * need)
    other = [f"other_{k}" for k in KEY]
    later = F.struct(*KEY) > F.struct(*[F.col(c).alias(k) for c, k in zip(other, KEY)])
    pairs = cut(mine.join(others, "word").filter(later & alike & close).select(*KEY, *other).distinct(), "line-pairs")
    return pairs.select(*KEY) if pairs.isEmpty() else verified(source, pairs)


def removed_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_rows: int = PAGE_ROWS) -> DataFrame:
    """``(doc, mark, line)`` of the lines to remove, numbered from 0.

    ``doc`` is the id, the least long for null, and ``mark`` a hash of the text, which tells apart
    different texts of one id and orders them.
    """
    source, context = _source(df, id_col, text_col), df.sparkSession.sparkContext
    table = context.broadcast(rarity(source))
    postings = source.mapInArrow(lambda batches: _postings(table, page_rows, batches), POSTING)
    dealt = postings.repartition("word", "page").sortWithinPartitions("word", "page", *KEY)
    best = cut(dealt.mapInArrow(_best_earlier, PAIR), "line-best")
    other = [f"other_{k}" for k in KEY]
    chosen = cut(
        best.filter(F.col("apart") < 1 << 20).groupBy(*KEY).agg(F.min(F.struct("apart", *other)).alias("best"))
        .select(*KEY, "best.*"),
        "line-chosen",
    )
    equal = chosen.filter("apart = -1").select(*KEY)
    settled = cut(verified(source, chosen.filter("apart >= 0").drop("apart")).unionByName(equal).distinct(), "line-settled")
    left = cut(best.filter("apart >= 0").join(settled, KEY, "left_anti"), "line-left")
    named = left.filter(F.col("apart") < 1 << 20).select(*KEY, *other).distinct().join(chosen.drop("apart"), [*KEY, *other], "left_anti")
    named = cut(named, "line-named")
    if not named.isEmpty():
        settled = cut(settled.unionByName(verified(source, named)).distinct(), "line-settled")
    # Words that gave a line more candidates than are named.
    probes = cut(left.filter("more").select(*KEY, "word").distinct().join(settled, KEY, "left_anti"), "line-probes")
    if probes.isEmpty():
        return settled
    return settled.unionByName(_further(source, table, page_rows, probes)).distinct()


def line_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", page_rows: int = PAGE_ROWS) -> DataFrame:
    """``(doc_id, n_lines, n_removed, removed)`` for every row; ``removed`` lists lines from 0 in order.

    Lines end at a line feed.  A null text has no line, an empty one has one, which stays.  Null
    ids come before all others.  Different texts of one id, null included, keep their own lines and come in
    the order of a hash of the text; rows equal in id and text are one document, with the same result.
    Texts of any length and number of lines count whole.  Other columns are not read.
    """
    removed = settled(
        df.sparkSession, "line-removed",
        lambda: removed_lines(df, id_col, text_col, page_rows).groupBy("doc", "mark")
        .agg(F.sort_array(F.collect_set("line")).alias("removed")),
    )
    source = _source(df, id_col, text_col)
    lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    counted = source.select("doc", "mark", F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return counted.join(removed, ["doc", "mark"], "left").select(
        F.nullif("doc", F.lit(-(1 << 63))).alias("doc_id"), "n_lines",
        F.size(F.coalesce("removed", none)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"),
    )


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the removed lines taken out of its texts; no row is dropped.

    Texts meet their lists of removed lines by id and hash; a text without any stays as it is.  Null ids,
    repeated ids and rows are treated as by ``line_report``.
    """
    removed = settled(
        df.sparkSession, "line-removed",
        lambda: removed_lines(df, id_col, text_col).groupBy("doc", "mark").agg(F.collect_set("line").alias("removed lines")),
    )
    key = F.coalesce(df[id_col].cast("long"), F.lit(-(1 << 63)))
    mark = F.xxhash64(df[text_col].cast("string"))
    joined = df.join(removed, (key == removed["doc"]) & (mark == removed["mark"]), "left")
    kept = F.filter(F.split(df[text_col], "\n", -1), lambda _, place: ~F.array_contains("removed lines", place))
    text = F.when(F.col("removed lines").isNull(), df[text_col]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias(c) if c == text_col else df[c] for c in df.columns])
