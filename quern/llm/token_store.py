"""Token-id files: documents compressed one by one with a shared zstandard dictionary, found by an offset index.

A file holds documents in ascending id order. Layout, all numbers little-endian:

    8 bytes   QTOK0001
    u32       bytes of an id, 2 or 4
    32 bytes  SHA-256 of the dictionary, zeros if there is none
    frames    one zstandard frame for each document
    index     for each document: i64 id, u64 offset, u64 length of its frame, u64 ids
    u64 u64   offset of the index, documents
    8 bytes   QTOK0001

The dictionary lies beside the files under its hash. It is trained on serialized id arrays of at most ``sample`` documents, those
with the least hashes of id and text in the whole table, a run of at most SPAN ids of each from a place that the hash chooses;
so it doesn't depend on how the table is dealt. A table too small to train on gets no dictionary. Everything
else covers whole texts, and what is read back doesn't depend on the dictionary.

A task writes a file under a name of its own and moves it into place, and only files named by tasks that ended are
read, so a lost executor leaves nothing behind that counts. The only global step is a running sum over files.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, map_arrow, quoted, text_of
from quern.llm.tokens import encoder, public_vocabulary, vocabulary_size

MAGIC, HEAD, TAIL = b"QTOK0001", struct.Struct("<8sI32s"), struct.Struct("<QQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("ids", "<u8")])
#: The id that stands for a null one in a file.
NO_ID = -(1 << 63)


#: Most ids of a document that the dictionary is trained on.
SPAN = 4096
#: Units that a worker keeps the ids of; a store is written by jobs that have the executor for themselves.
UNITS = 800_000


def train_dictionary(samples: list[bytes], size: int = 1 << 16) -> bytes:
    """A zstandard dictionary, empty where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest() if data else bytes(32)


def _dictionary_file(folder: str, digest: bytes) -> str:
    return f"{folder}/{digest.hex()}.zdict"


def write_file(stream, documents: Iterator[tuple[int | None, np.ndarray]], width: int, dictionary: bytes) -> np.ndarray:
    """Write documents of (id, ids) and return the index."""
    packer = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
    index, at = [], HEAD.size
    stream.write(HEAD.pack(MAGIC, width, _digest(dictionary)))
    for doc_id, ids in documents:
        frame = packer.compress(ids.astype(f"<u{width}").tobytes())
        stream.write(frame)
        index.append((NO_ID if doc_id is None else doc_id, at, len(frame), len(ids)))
        at += len(frame)
    table = np.array(index, INDEX)
    stream.write(table.tobytes())
    stream.write(TAIL.pack(at, len(table), MAGIC))
    return table


class TokenFile:
    """A file opened for reading. ``ids(k)`` reads one document, whatever the size of the file."""

    def __init__(self, path: str) -> None:
        store, name = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(name)
        head, self.width, digest = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        at, count, tail = TAIL.unpack(self.file.read_at(TAIL.size, self.file.size() - TAIL.size))
        if head != MAGIC or tail != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.index = np.frombuffer(self.file.read_at(count * INDEX.itemsize, at), INDEX)
        data = b""
        if any(digest):
            with store.open_input_file(_dictionary_file(name.rpartition("/")[0], digest)) as f:
                data = f.read()
            if _digest(data) != digest:
                raise ValueError(f"the dictionary of {path} isn't the one it was written with")
        self.unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(data)) if data else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        entry = self.index[k]
        return self._open(self.file.read_at(int(entry["length"]), int(entry["offset"])), entry)

    def _open(self, frame: bytes, entry: np.void) -> np.ndarray:
        size = int(entry["ids"]) * self.width
        return np.frombuffer(self.unpacker.decompress(frame, max_output_size=size) if size else b"", f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        k = int(np.searchsorted(self.index["doc_id"], doc_id))
        return self.ids(k) if k < len(self.index) and self.index["doc_id"][k] == doc_id else None

    def documents(self, block: int = 1 << 22) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, read some megabytes at a time."""
        ends = self.index["offset"] + self.index["length"]
        k = 0
        while k < len(self.index):
            first = int(self.index["offset"][k])
            upto = max(k + 1, int(np.searchsorted(ends, first + block, "right")))
            data = self.file.read_at(int(ends[upto - 1]) - first, first)
            for entry in self.index[k:upto]:
                a = int(entry["offset"]) - first
                yield (None if entry["doc_id"] == NO_ID else int(entry["doc_id"])), self._open(data[a:a + int(entry["length"])], entry)
            k = upto


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, mode: str, end_id: int, width: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    while first is not None and not len(first):
        first = next(batches, None)
    if first is None:
        return
    store, root = fs.FileSystem.from_uri(folder)
    name = uuid.uuid4().hex

    def documents() -> Iterator[tuple[int | None, np.ndarray]]:
        for batch in itertools.chain([first], batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(path, mode, most_units=UNITS).encode(batch.column(1))):
                yield doc_id, np.append(ids, np.uint32(end_id))

    with store.open_output_stream(f"{root}/{name}.part") as stream:
        index = write_file(stream, documents(), width, dictionary)
    store.move(f"{root}/{name}.part", f"{root}/{name}.qtok")
    yield pa.RecordBatch.from_pydict({
        "path": [f"{folder}/{name}.qtok"], "first": [int(index["doc_id"][0])], "last": [int(index["doc_id"][-1])], "docs": [len(index)], "ids": [int(index["ids"].sum())],
    })


def _runs(batches: Iterator[pa.RecordBatch], path: str, mode: str, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = []
        for h, ids in zip(batch.column(0).to_pylist(), encoder(path, mode, most_units=UNITS).encode(batch.column(1))):
            at = h % max(1, len(ids) - SPAN + 1)
            runs.append(ids[at:at + SPAN].astype(f"<u{width}").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(runs, pa.binary())], names=["h", "run"])


def sample_runs(rows: DataFrame, path: str, mode: str, sample: int, width: int) -> list[bytes]:
    """Runs of at most SPAN ids of at most ``sample`` rows (doc_id, text), those of the least hashes, in that order. Only hashes and runs reach the driver."""
    hashed = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    least = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    chosen = hashed.where(F.col("h").isin(least)).dropDuplicates(["h"])
    return [bytes(r.run) for r in map_arrow(chosen, partial(_runs, path=path, mode=mode, width=width), "h long, run binary").orderBy("h").collect()]


def write_store(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, mode: str = "byte",
    end_id: int = 2, sample: int = 400,
) -> list[tuple[str, int, int]]:
    """Write the files and return (path, ids before it, ids in it) of each, in the order of document ids."""
    path = vocabulary or public_vocabulary("byte_bpe_50k.json")
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    width = 2 if vocabulary_size(path) <= 1 << 16 and end_id < 1 << 16 else 4
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    dictionary = train_dictionary(sample_runs(rows, path, mode, sample, width))
    if dictionary:
        with store.open_output_stream(_dictionary_file(root, _digest(dictionary))) as f:
            f.write(dictionary)
    # The hash deals out rows that share an id or have none.
    dealt = rows.withColumn("x", F.xxhash64("text")).repartitionByRange("doc_id", "x").sortWithinPartitions("doc_id", "x").select("doc_id", "text")
    work = partial(_write, folder=folder, path=path, mode=mode, end_id=end_id, width=width, dictionary=dictionary)
    files = map_arrow(dealt, work, "path string, first long, last long, docs long, ids long").collect()  # one row a file
    files.sort(key=lambda r: (r["first"], r["last"]))
    starts = itertools.accumulate([r["ids"] for r in files], initial=0)
    return [(r["path"], start, r["ids"]) for r, start in zip(files, starts)]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows: list[tuple] = []
            for doc_id, ids in TokenFile(path).documents():
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                start += len(ids)
                if len(rows) == 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def token_store(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Encode every text into files and read them back: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before, in ascending order of id (null first, then a hash of the text where
    row ids repeat). Null text counts as empty: a document of the end id alone. Repeated rows are documents of their own, an empty
    table gives no file and no rows. Other columns are ignored. ``folder`` must be shared by driver and executors
    and of a kind that pyarrow opens; it lies under the checkpoint folder unless given.
    """
    spark = docs.sparkSession
    files = write_store(docs, folder or fresh_path(spark, "tokens"), **options)
    table = spark.createDataFrame([f[:2] for f in files], "path string, start long")
    return map_arrow(table.repartition(max(1, len(files))), _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
