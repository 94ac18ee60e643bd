"""Byte-level BPE, encoding and decoding, from a public tokenizer file.

A word's parts lie in one contiguous list with the merge ranks of neighbouring parts beside it.
The smallest rank is looked up, the boundary below it deleted, and the two ranks around it taken
anew.  Words are short, so scanning the list beats a tree; the few long ones use a heap over the
same ranks, with the same result.  The new words of many texts are merged together: those of one
length are the rows of one array, and each step merges one pair of every row that still has one.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from civictopics.llm.common import add_columns

NO_RANK = 1 << 60
NO_PAIR = (1 << 31) - 1
SHORT_WORD = 96
# Words of one length that are worth an array.
FEW_WORDS = 16
# Pieces remembered by a Python worker, and as many words; when there are more, it starts anew.
REMEMBERED = 100_000
# A text is cut after so many characters, and so many pieces are held at a time.
CHARS_AT_A_TIME = 1 << 19
PIECES_AT_A_TIME = 1 << 17

# Unicode white space, and the pattern that splits text before the merges.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+"
    r"|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+"
)
# A space between other white space and more of it: only there can a match run across a space.
RUN = re.compile(r"\s (?:\s|\Z)|\A (?:\s|\Z)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level files: itself where it is printable."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Ranks:
    """Merge ranks of pairs of ids, in an open hash table."""

    BITS = 18

    def __init__(self, pairs: dict[tuple[int, int], int]) -> None:
        size = 1 << max(self.BITS, (2 * len(pairs)).bit_length())
        self.mask = np.int64(size - 1)
        self.keys, self.ranks = np.full(size, -1, dtype=np.int64), np.full(size, NO_PAIR, dtype=np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], dtype=np.int64)
        for key, slot, rank in zip(keys.tolist(), self._slots(keys).tolist(), pairs.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & int(self.mask)
            self.keys[slot], self.ranks[slot] = key, rank

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> 17)) * np.int64(0x1E3779B97F4A7C15)
        return (mixed >> 32) & self.mask

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NO_PAIR`` where it never merges."""
        keys = left << 32 | right
        slots = self._slots(keys)
        found, ranks = self.keys[slots], self.ranks[slots]
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        ranks[found != keys] = NO_PAIR
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            right_one = found == keys[open_]
            ranks[open_[right_one]] = self.ranks[slots[open_[right_one]]]
            open_ = open_[~right_one & (found >= 0)]
        return ranks


class ByteBpe:
    """Encoder and decoder of one file.  Ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                   "end_of_word_suffix", "byte_fallback", "ignore_merges")
        )
        if not plain or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in letters.items()}
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.byte_ids = [vocab[letters[b]] for b in range(256)]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.added = {}
        for token in spec["added_tokens"]:
            if token["lstrip"] or token["rstrip"] or token["single_word"] or token["normalized"]:
                raise ValueError(f"{path} has an added token of an unknown kind")
            self.added[token["content"]] = np.array([token["id"]], "<u4").tobytes()
            self.bytes_of[token["id"]] = token["content"].encode()
        longest = sorted(self.added, key=len, reverse=True)
        self.cut_added = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.split = regex.compile(SPLIT)
        self.byte_id, self.merged_id = np.array(self.byte_ids, dtype=np.int64), np.array(self.merged, dtype=np.int64)
        self.pair_ranks = _Ranks(self.ranks)
        # Packed ids of words, and of pieces of text that follow a space.
        self.words: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: merge the pair of lowest rank, the leftmost of equals, until none is left."""
        parts = [self.byte_ids[b] for b in word]
        if len(parts) > SHORT_WORD:
            return self._merge_long(parts)
        known = self.ranks.get
        ranks = [known(pair, NO_RANK) for pair in pairwise(parts)]
        while ranks:
            low = min(ranks)
            if low == NO_RANK:
                break
            at = ranks.index(low)
            parts[at] = self.merged[low]
            del parts[at + 1], ranks[at]
            if at:
                ranks[at - 1] = known((parts[at - 1], parts[at]), NO_RANK)
            if at < len(ranks):
                ranks[at] = known((parts[at], parts[at + 1]), NO_RANK)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        known, n = self.ranks.get, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(pairwise(parts)) if (r := known(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            if parts[at] < 0 or right >= n or known((parts[at], parts[right])) != rank:
                continue
            parts[at], parts[right] = self.merged[rank], -1
            after[at] = after[right]
            if after[at] < n:
                before[after[at]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] < n:
                    new = known((parts[left], parts[after[left]]))
                    if new is not None:
                        heapq.heappush(heap, (new, left))
        return [p for p in parts if p >= 0]

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of each of many words."""
        out, by_length = [b""] * len(words), {}
        for place, word in enumerate(words):
            by_length.setdefault(len(word), []).append(place)
        for length, places in by_length.items():
            if length > SHORT_WORD or len(places) < FEW_WORDS:
                for place in places:
                    out[place] = np.array(self.merge(words[place]), "<u4").tobytes()
            else:
                self._merge_rows(words, places, length, out)
        return out

    def _merge_rows(self, words: list[bytes], places: list[int], length: int, out: list[bytes]) -> None:
        """``merge`` for words of one length: after each step all rows are one part shorter."""
        joined = np.frombuffer(b"".join([words[p] for p in places]), "u1")
        parts, rows = self.byte_id[joined].reshape(-1, length), np.array(places)

        def finish(ended: np.ndarray, at: np.ndarray) -> None:
            packed, size = ended.astype("<u4").tobytes(), 4 * ended.shape[1]
            for i, place in enumerate(at.tolist()):
                out[place] = packed[i * size : (i + 1) * size]

        ranks = self.pair_ranks.of(parts[:, :-1].ravel(), parts[:, 1:].ravel()).reshape(len(rows), -1)
        while ranks.shape[1]:
            every = np.arange(len(rows))
            at = ranks.argmin(axis=1)
            low = ranks[every, at]
            going = low < NO_PAIR
            if not going.all():
                finish(parts[~going], rows[~going])
                parts, ranks, rows, at, low = parts[going], ranks[going], rows[going], at[going], low[going]
                every = np.arange(len(rows))
            if not len(rows):
                return
            n, left = parts.shape[1], at[:, None]
            parts[every, at] = self.merged_id[low]
            parts = parts[np.arange(n) != left + 1].reshape(len(rows), n - 1)
            ranks = ranks[np.arange(n - 1) != left].reshape(len(rows), n - 2)
            some = np.flatnonzero(at > 0)
            to = at[some]
            ranks[some, to - 1] = self.pair_ranks.of(parts[some, to - 1], parts[some, to])
            some = np.flatnonzero(at < n - 2)
            to = at[some]
            ranks[some, to] = self.pair_ranks.of(parts[some, to], parts[some, to + 1])
        finish(parts, rows)

    def _learn(self, words: set[str], pieces: set[str]) -> tuple[list[str], list[str]]:
        """Remember all of ``words`` and ``pieces``; the new ones that are too long to be kept."""
        new = list(pieces.difference(self.spaced))
        if len(self.spaced) + len(new) > REMEMBERED:
            self.spaced.clear()
            new = list(pieces)
        # Letters of ASCII are one word; the pattern cuts what else there is.
        plain = [p for p in new if p.isascii() and p.isalpha()]
        others = list(set(new).difference(plain))
        spaced = [" " + p for p in plain]
        cut = [self.split.findall(" " + p) for p in others]
        every = words.union(spaced, *cut)
        unknown = list(every.difference(self.words))
        if len(self.words) + len(unknown) > REMEMBERED:
            self.words.clear()
            unknown = list(every)
        self.words.update(zip(unknown, self.merge_many([w.encode() for w in unknown])))
        known = self.words.__getitem__
        self.spaced.update(zip(plain, map(known, spaced)))
        self.spaced.update(zip(others, [b"".join(map(known, found)) for found in cut]))
        return [w for w in unknown if len(w) > SHORT_WORD], [p for p in new if len(p) > SHORT_WORD]

    def _slices(self, text: str) -> Iterator[tuple[list[str], list[str]]]:
        """Words and then pieces after a space of a text without added tokens, some at a time.

        It may be cut before a single space, as no match crosses one.
        """
        if RUN.search(text):
            yield self.split.findall(text), []
            return
        end = text.find(" ")
        yield self.split.findall(text if end < 0 else text[:end]), []
        while end >= 0:
            at, end = end + 1, text.find(" ", end + CHARS_AT_A_TIME)
            yield [], text[at : None if end < 0 else end].split(" ")

    def _parts(self, texts: Iterable[str]) -> Iterator[tuple[int, bytes, list[str], list[str]]]:
        """Slices of all texts, or the packed id of an added token, with the number of the text."""
        for number, text in enumerate(texts):
            if self.cut_added is None or not any(token in text for token in self.added):
                segments = [text]
            else:
                segments = self.cut_added.split(text)
            for segment in filter(None, segments):
                if segment in self.added:
                    yield number, self.added[segment], [], []
                else:
                    for words, spaced in self._slices(segment):
                        yield number, b"", words, spaced

    def encode_many(self, texts: Sequence[str]) -> list[bytes]:
        """Packed ids of each text.  New words of neighbouring texts are merged together."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0

        def flush() -> None:
            words, pieces = set().union(*[p[2] for p in held]), set().union(*[p[3] for p in held])
            long_words, long_pieces = self._learn(words, pieces)
            for number, packed, first, spaced in held:
                out[number].append(packed)
                out[number].append(b"".join(map(self.words.__getitem__, first)))
                out[number].append(b"".join(map(self.spaced.__getitem__, spaced)))
            for word in long_words:
                del self.words[word]
            for piece in long_pieces:
                del self.spaced[piece]
            held.clear()

        for part in self._parts(texts):
            held.append(part)
            size += len(part[2]) + len(part[3])
            if size >= PIECES_AT_A_TIME:
                flush()
                size = 0
        flush()
        return list(map(b"".join, out))

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """One encoder for each file and Python worker."""
    return ByteBpe(path)


def unload() -> None:
    """Let go of the encoders of this Python worker, which outlives its task."""
    load.cache_clear()


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``array<int>``; a null text has none, ``[]``."""

    def compute(texts):
        bpe = load(path)
        packed = bpe.encode_many([t or "" for t in texts])
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype="int32")
        ids = np.frombuffer(b"".join(packed), "<u4").astype("int32")
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]

    return add_columns(df, text_col, [(ids_col, T.ArrayType(T.IntegerType()))], compute, done=unload)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the text of each list of ids; a null list becomes an empty text.

    Bytes that are no UTF-8, which lists of foreign origin can hold, become U+FFFD.
    """
    others = [c for c in df.columns if c.lower() != text_col.lower()]
    schema = T.StructType([df.schema[c] for c in others] + [T.StructField(text_col, T.StringType())])

    def run(batches):
        bpe, place = load(path), others.index(ids_col)
        for batch in batches:
            texts = [
                bpe.decode(np.asarray(ids or [], dtype="<u4").tobytes())
                for ids in batch.column(place).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return df.select(*[df[c] for c in others]).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None,
               with_ids: bool = False) -> DataFrame:
    """Encode each whole text, decode its ids, and add digests of both.

    Adds ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (text decoded from the ids, in UTF-8), and with ``with_ids`` the packed
    ``ids`` themselves.  Null texts count as empty; equal texts get equal rows; rows are neither
    dropped nor moved, so no size or repetition of a text matters to others.
    """
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    fields += [("ids", T.BinaryType())] * with_ids

    def compute(texts):
        bpe, rows = load(path), []
        for ids in bpe.encode_many([t or "" for t in texts]):
            decoded = bpe.decode(ids).encode()
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids))
        return list(zip(*rows))[: len(fields)] if rows else [[]] * len(fields)

    return add_columns(df, text_col, fields, compute, keep, unload)
