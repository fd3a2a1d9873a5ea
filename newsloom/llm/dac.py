"""Token ids in directly addressable codes.

An id is cut into chunks of `bits` bits, lowest first. Level k holds chunk k of all ids that have
one, a bitmap which marks those that continue on level k + 1, and a directory with the number of set
bits before every 512th bit. So id i is read by one rank per level, without decoding its neighbours.

A file (`.dac`, little-endian): magic `DAC1`, u32 levels, u32 bits, u64 ids, u64 documents, u64 documents without
doc_id, which come first; then doc_ids (i64, 0 for none) and first ids (u64, one more than documents); then for each level u64 entries, its chunks (u8),
its bitmap (u8, lowest bit first) and its directory (u64).

Nulls: a null text is empty; it has only the end id. Documents are in ascending order of doc_id, null first,
and of text among equal doc_ids. An empty table gives an empty manifest. Other columns are ignored. File names
carry the task attempt, and only files of committed attempts are in the manifest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PIECE_BYTES, Vocabulary, byte_letters, read_vocabulary, worker_encoder
from .common import bounded_batches, new_path, slices, text_of, written

MAGIC = b"DAC1"
#: Ids of a file, but that a document is never cut.
FILE_IDS = 4_000_000
_BLOCK = 512


class Codes:
    """The levels of one sequence: (chunks, bitmap, directory) each."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], bits: int, n: int):
        self.levels, self.bits, self.n = levels, bits, n

    @classmethod
    def build(cls, ids: np.ndarray, bits: int = 8) -> Codes:
        left, levels = ids.astype(np.uint64), []
        while True:
            more = left >> np.uint64(bits)
            on = more > 0
            bitmap = np.packbits(on, bitorder="little")
            bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (_BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(bitmap.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(1, dtype=np.uint64) if len(bitmap) else np.zeros(0, np.uint64)
            directory = np.cumsum(ones, dtype=np.uint64) - ones
            levels.append(((left & np.uint64((1 << bits) - 1)).astype(np.uint8), bitmap, directory))
            left = more[on]
            if not len(left):
                return cls(levels, bits, len(ids))

    def rank(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits before bit i of a level's bitmap."""
        _, bitmap, directory = self.levels[level]
        words = bitmap.view(np.uint64)
        word = i >> 6
        block = i // _BLOCK
        out = directory[block].astype(np.int64)
        for k in range(_BLOCK // 64 - 1):  # whole words of the block before this one
            w = block * (_BLOCK // 64) + k
            out += np.where(w < word, np.bitwise_count(words[w]), 0)
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(words[word] & mask)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The ids at any positions."""
        out, at, who, shift = np.zeros(len(i), np.uint64), i.astype(np.int64), slice(None), 0
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[who] |= chunks[at].astype(np.uint64) << np.uint64(shift)
            on = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if not len(on):
                break
            who = on if isinstance(who, slice) else who[on]
            at = self.rank(k, at[on])
            shift += self.bits
        return out

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<Q", len(c)) + c.tobytes() + b.tobytes() + d.tobytes() for c, b, d in self.levels)

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int, levels: int, bits: int, n: int) -> Codes:
        out = []
        for _ in range(levels):
            (m,) = struct.unpack_from("<Q", raw, at)
            blocks = -(-m // _BLOCK)
            parts, at = [], at + 8
            for kind, size in ((np.uint8, m), (np.uint8, blocks * _BLOCK // 8), (np.uint64, blocks * 8)):
                parts.append(np.frombuffer(raw[at : at + size].tobytes(), kind))
                at += size
            out.append(tuple(parts))
        return cls(out, bits, n)


def pack_file(doc_ids: np.ndarray, first: np.ndarray, ids: np.ndarray, bits: int = 8, nameless: int = 0) -> bytes:
    codes = Codes.build(ids, bits)
    head = MAGIC + struct.pack("<IIQQQ", len(codes.levels), bits, len(ids), len(doc_ids), nameless)
    return head + doc_ids.astype("<i8").tobytes() + first.astype("<u8").tobytes() + codes.to_bytes()


def open_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, Codes, int]:
    """doc_ids, the first id of each document and the end, the codes, and how many documents have no doc_id."""
    if raw[:4] != MAGIC:
        raise ValueError("no DAC1 file")
    levels, bits, n, docs, nameless = struct.unpack_from("<IIQQQ", raw, 4)
    at = 36
    doc_ids = np.frombuffer(raw, "<i8", docs, at)
    first = np.frombuffer(raw, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
    return doc_ids, first, Codes.from_bytes(memoryview(raw), at + 16 * docs + 8, levels, bits, n), nameless


def library_words(text: str):
    """Encodes words by the BPE model of the tokenizers library; a word is what its byte-level pre-tokenizer would pass on."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(text).model
    letters = dict(enumerate(byte_letters()))

    def encode_new(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = data.tobytes().decode("latin-1").translate(letters)  # one character a byte
        ids, lens = [], []
        for a, b in zip(s.tolist(), e.tolist()):
            found = model.tokenize(whole[a:b])
            ids += [t.id for t in found]
            lens.append(len(found))
        return np.array(ids, np.int64), np.array(lens, np.int64)

    return encode_new


def write_ids(docs: DataFrame, path: str, end_id: int = 0, bits: int = 8) -> DataFrame:
    """Encodes the texts by the tokenizers library, appends end_id to each and writes .dac files in order of doc_id.

    Returns the manifest: path, first_doc, n_docs, n_ids, file_start (ids in all files before). Texts are
    sorted before they are encoded, so that finding the ranges encodes nothing.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    text = read_vocabulary(path)
    shared = spark.sparkContext.broadcast(text)
    kind = "<u2" if Vocabulary(text).size <= 1 << 16 else "<u4"
    where = new_path(spark, "dac")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        encoder = worker_encoder(shared.value, library_words)
        for piece in slices(batches, most=PIECE_BYTES):
            ids, off = encoder(text_of(piece))
            yield piece.column("doc_id").to_pylist(), np.insert(ids, off[1:], end_id).astype(kind), off + np.arange(len(off))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        task = TaskContext.get()
        fs, root = FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        rows, held, lens, parts = [], [], [], []
        total = 0

        def close() -> None:
            ids = np.concatenate(parts) if parts else np.zeros(0, kind)
            name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(rows):04d}.dac"
            with fs.open_output_stream(name) as out:
                out.write(pack_file(np.array([x or 0 for x in held], np.int64), np.concatenate([[0], np.cumsum(lens)]), ids, bits, held.count(None)))
            rows.append({"path": name, "part": task.partitionId(), "number": len(rows), "first_doc": held[0], "n_docs": len(held), "n_ids": len(ids)})
            for x in (held, lens, parts):
                x.clear()

        for doc_ids, flat, off in encoded(batches):
            for k, doc_id in enumerate(doc_ids):
                ids = flat[off[k] : off[k + 1]]
                held.append(doc_id)
                lens.append(len(ids))
                parts.append(ids)
                total += len(ids)
                if total >= FILE_IDS:
                    close()
                    total = 0
        if held:
            close()
        schema = pa.schema([("path", pa.string()), *((k, pa.int64()) for k in ("part", "number", "first_doc", "n_docs", "n_ids"))])
        yield pa.RecordBatch.from_pylist(rows, schema)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    files = written(by.mapInArrow(write, "path string, part long, number long, first_doc long, n_docs long, n_ids long"), "dac-manifest")
    def before(window) -> Column:
        return F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row a partition
    parts = parts.select("part", before(Window.orderBy("part")).alias("part_start"))
    within = files.withColumn("within", before(Window.partitionBy("part").orderBy("number")))
    return within.join(F.broadcast(parts), "part").withColumn("file_start", F.col("part_start") + F.col("within")).drop("part_start", "within").withColumn("root", F.lit(where))


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens and ids_crc32, by access() to its ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = FileSystem.from_uri(row["root"])
                with fs.open_input_stream(row["path"]) as src:
                    doc_ids, first, codes, nameless = open_file(src.read())
                crc, at = np.zeros(len(doc_ids), np.int64), 0
                while at < len(doc_ids):  # documents of about half a million ids at a time
                    end = max(at + 1, int(np.searchsorted(first, first[at] + 500_000, "right")) - 1)
                    ids = codes.access(np.arange(first[at], first[end])).astype("<u4")
                    for k in range(at, end):
                        crc[k] = zlib.crc32(ids[first[k] - first[at] : first[k + 1] - first[at]])
                    at = end
                ids = pa.array(doc_ids.astype(np.int64), mask=np.arange(len(doc_ids)) < nameless)
                yield pa.RecordBatch.from_arrays([ids, pa.array(first[:-1] + row["file_start"]), pa.array(np.diff(first)), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, manifest.count())
    return manifest.repartition(min(n, 100_000)).mapInArrow(read, schema)
