"""Token ids of documents in compressed binary files, in ascending order of document.

A file holds coded blocks of ids and, at its end, an index.  Blocks hold the same number of ids
each, whatever documents they come from, start with empty models and carry the crc32 of their
coded form and of their ids, so any block can be read and checked without the others.

    file     magic, blocks, index, length of the index (8 bytes), magic
    block    ids, coded bytes, crc32 of the coded bytes, crc32 of the ids (4 bytes each), coded bytes
    index    hex digits of an id (1 byte), number of blocks and of documents (8 bytes each),
             ids of each document with a byte for a null doc_id, all of fixed size

Texts move once, into ranges of ids, and become ids and files where they land.  Every attempt of a
task writes a file of its own name; the table of finished files names the ones that count.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from civictopics.llm import idcoder
from civictopics.storage import cut, new_path

MAGIC = b"TOKIDS01"
END_ID = 2
# Pieces of text remembered by a Python worker; when there are more, it starts anew.
REMEMBERED = 300_000
LONGEST_REMEMBERED = 64
# Python's split also cuts at these four, which are no white space to the tokenizer.
ODD_SPACE = re.compile("[\x1c-\x1f]")
# Unicode white space.
SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class WordTokenizer:
    """A tokenizer of the library whose tokens never span white space, asked once for each piece."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[str, bytes] = {}
        self.digits = max(1, (max(END_ID, self.library.get_vocab_size() - 1).bit_length() + 3) // 4)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text."""
        pieces = [SPACE.split(t) if ODD_SPACE.search(t) else t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*pieces).difference(self.known))
        found = self.library.encode_batch(new, add_special_tokens=False)
        fresh = {p: np.array(f.ids, dtype="<u4").tobytes() for p, f in zip(new, found)}
        self.known.update(fresh)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, words)), "<u4") for words in pieces]
        for piece in new:
            if len(piece) > LONGEST_REMEMBERED:
                del self.known[piece]
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# -------------------------------------------------------------------------------- files


class FileWriter:
    """Writes ids document by document; holds two groups of blocks at most."""

    def __init__(self, stream, digits: int, block: int = idcoder.BLOCK) -> None:
        self.stream, self.digits, self.block = stream, digits, block
        self.held: list[np.ndarray] = []
        self.size = self.n_blocks = self.n_ids = 0
        self.docs: list[tuple[int, int, int]] = []
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.held.append(ids)
        self.size += len(ids)
        # What is left in the end is cut into groups of equal size, so one group always waits.
        if self.size >= 2 * self.block * idcoder.GROUP:
            self._write(self.block * idcoder.GROUP)

    def _write(self, number: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, dtype="<u4")
        blocks = [ids[at : min(at + self.block, number)] for at in range(0, number, self.block)]
        for part, coded in zip(blocks, idcoder.encode(blocks, self.digits)):
            self.stream.write(struct.pack("<IIII", len(part), len(coded), zlib.crc32(coded), idcoder.checksum(part)))
            self.stream.write(coded)
        self.n_blocks += len(blocks)
        self.n_ids += number
        self.held, self.size = [ids[number:].copy()], self.size - number

    def close(self) -> None:
        self._write(self.size)
        index = struct.pack("<BQQ", self.digits, self.n_blocks, len(self.docs))
        index += np.array([d[0] for d in self.docs], dtype="<i8").tobytes()
        index += np.array([d[1] for d in self.docs], dtype="u1").tobytes()
        index += np.array([d[2] for d in self.docs], dtype="<u4").tobytes()
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)


class FileReader:
    """Reads a file back; raises ``ValueError`` where a checksum or length is wrong."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        file.seek(max(0, size - 16))
        tail = file.read(16)
        if size < 24 or tail[8:] != MAGIC:
            raise ValueError("not a token file, or one that was cut off")
        length = struct.unpack("<Q", tail[:8])[0]
        file.seek(size - 16 - length)
        index = file.read(length)
        self.digits, self.n_blocks, n = struct.unpack_from("<BQQ", index)
        self.doc_ids = np.frombuffer(index, "<i8", n, 17)
        self.nulls = np.frombuffer(index, "u1", n, 17 + 8 * n).astype(bool)
        self.lengths = np.frombuffer(index, "<u4", n, 17 + 9 * n).astype(np.int64)

    def groups(self) -> Iterator[np.ndarray]:
        """All ids in order, some blocks at a time."""
        self.file.seek(len(MAGIC))
        step = idcoder.group_size(self.n_blocks)
        for at in range(0, self.n_blocks, step or 1):
            lengths, coded, sums = [], [], []
            for _ in range(min(step, self.n_blocks - at)):
                number, size, packed, plain = struct.unpack("<IIII", self.file.read(16))
                data = self.file.read(size)
                if len(data) != size or zlib.crc32(data) != packed:
                    raise ValueError("a block is damaged")
                lengths.append(number)
                coded.append(data)
                sums.append(plain)
            ids = idcoder.decode(coded, lengths, self.digits)
            if any(idcoder.checksum(i) != s for i, s in zip(ids, sums)):
                raise ValueError("a block does not decode to its ids")
            yield np.concatenate(ids)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """``(doc_id, ids of this file before it, ids)`` for each document, in order."""
        groups, held, start = self.groups(), np.zeros(0, dtype=np.uint32), 0
        for doc_id, null, length in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            parts, got = [held], len(held)
            while got < length:
                parts.append(next(groups))
                got += len(parts[-1])
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc_id, start, held[:length]
            held, start = held[length:], start + length


# ------------------------------------------------------------------------------- tables

FILES = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()),
])
DOCS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()),
])


def _columns(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    fields = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def write_files(df: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                block: int = idcoder.BLOCK) -> DataFrame:
    """Write the ids of all documents below ``path``; ``(part, file, n_docs, n_ids)`` of each file.

    Each document is its text's ids and the end id.  Files in ``part`` order, and documents in
    them, ascend by id; null ids come first, rows of one id follow a hash of their texts.  A null
    text is empty.
    """
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    ordered = docs.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        encoder, writer, name = load(tokenizer), None, ""
        for batch in batches:
            if writer is None and batch.num_rows:
                store.create_dir(root, recursive=True)
                name = f"part-{uuid.uuid4().hex}.tok"
                stream = store.open_output_stream(f"{root}/{name}", compression=None)
                writer = FileWriter(stream, encoder.digits, block)
            ids = encoder.encode(batch.column(1).to_pylist())
            for doc_id, found in zip(batch.column(0).to_pylist(), ids):
                writer.add(doc_id, np.append(found, np.uint32(END_ID)))
        if writer is not None:
            writer.close()
            stream.close()
            yield _columns([(TaskContext.get().partitionId(), name, len(writer.docs), writer.n_ids)], FILES)

    return cut(ordered.mapInArrow(run, FILES), "token-files")


def read_files(files: DataFrame, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files alone.

    ``start`` counts the ids of all documents before it.  One task reads a file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("begun"))
    placed = cut(starts, "token-starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for part, name, begun in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with store.open_input_file(f"{root}/{name}") as file:
                    rows = [
                        (part, doc_id, begun + start, len(ids), idcoder.checksum(ids))
                        for doc_id, start, ids in FileReader(file).documents()
                    ]
                for at in range(0, len(rows), 50_000):
                    yield _columns(rows[at : at + 50_000], DOCS)

    spread = placed.repartitionByRange(max(1, placed.count()), "part")
    return spread.mapInArrow(run, DOCS).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents to files in the shared folder and give what is read back from them."""
    path = new_path(df.sparkSession, "tokens")
    return read_files(write_files(df, tokenizer, path, id_col, text_col), path)
