"""Token-id files: every document compressed by itself under one shared dictionary.

A dictionary for zstandard is trained on the serialized ids of a bounded sample of
short documents.  Each document's ids, with an end id, are one frame, so a short
document is read without its neighbours.  Documents are written in ascending order
of id, nulls first, then by digest of the text.

A folder holds ``dictionary`` (raw), the data files and ``manifest`` (Parquet: one
row per file with its documents, ids, first and last doc_id, and the ids of all files
before it).  A data file:

    8 bytes   magic ``SWTOKEN1``
    8 bytes   bytes per id, 2 or 4 (little-endian, as all numbers)
    32 bytes  SHA-256 of the dictionary; readers refuse another one
    frames    one per document
    index     one `INDEX` record per document: id, whether it has one, place and
              bytes of its frame, its ids, ids of the documents before it in the file
    24 bytes  place of the index, its records, magic

Tasks write under names of their own and the manifest names the files that count, so
a task that runs twice, or dies half-way, leaves nothing that is read.  The folder
must be one that executors reach: a path, or a URI that pyarrow's file systems know.

Defined results: a null or empty text has the end id only; null ids come first, ties
in id are ordered by the text's digest, and repeated rows are documents of their own;
a document of any length is one frame; with too few documents for a dictionary there
is none and its hash is that of no bytes; an empty table gives a folder with an empty
manifest.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfwise.llm import subwords
from shelfwise.llm.tables import Batches, as_bytes
from shelfwise.settings import cut_lineage, scratch_path

BYTE_BPE = "byte_bpe_50k.json"
END = 2
# The file format.
MAGIC = b"SWTOKEN1"
INDEX = np.dtype(
    [("doc_id", "<i8"), ("known", "<u8"), ("place", "<u8"), ("bytes", "<u8"), ("n", "<u8"), ("start", "<u8")]
)
HEAD, TAIL = 48, 24
SAMPLE = 2_000  # documents that train the dictionary
SAMPLE_CHARS = 8_192  # and the most characters that one of them has
DICTIONARY = 64 << 10
LEVEL = 3
FILE = 256 << 20  # bytes after which a task begins another file
TEXTS = 8 << 20  # bytes of text that are encoded together
BLOCK = 4 << 20  # bytes of frames that are read together


def opened(folder: str) -> tuple[files.FileSystem, str]:
    """The file system of a folder that Spark names, and the folder's path on it."""
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return files.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def with_end(ids: bytes, dtype: np.dtype, end: int) -> bytes:
    return ids + np.array([end], dtype).tobytes()


def id_type(size: int, end: int) -> np.dtype:
    return np.dtype("<u2") if max(size, end + 1) <= 1 << 16 else np.dtype("<u4")


class Encoder:
    """Serialized ids of whole texts, each with the end id."""

    def __init__(self, path: str, end: int):
        self.model = subwords.byte_level(path, special=True)
        self.dtype, self.end = id_type(self.model.size, end), end

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        found = self.model.ids(texts)
        if self.dtype != self.model.dtype:
            found = [np.frombuffer(x, self.model.dtype).astype(self.dtype).tobytes() for x in found]
        return [with_end(x, self.dtype, self.end) for x in found]


def _runs(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= TEXTS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def train_dictionary(docs: DataFrame, path: str = BYTE_BPE, end: int = END, sample: int = SAMPLE) -> bytes:
    """A dictionary from at most ``sample`` different texts of up to ``SAMPLE_CHARS`` characters; b'' if they are too few.

    The texts are the first by hash: hashes are found first, texts read after.
    """
    short = docs.select("text").where(F.length("text").between(1, SAMPLE_CHARS))
    hashed = short.withColumn("h", F.xxhash64("text"))
    limit = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if limit is None:
        return b""
    texts = hashed.where(F.col("h") <= limit).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()
    samples = Encoder(path, end)([r["text"].encode() for r in texts])
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few or too short
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


FRAMES = "doc_id long, tie long, salt long, n long, frame binary"


def _frames(docs: DataFrame, dictionary: bytes, path: str, end: int) -> DataFrame:
    """One compressed frame per document; ``salt`` tells equal rows apart once written."""

    def kernel(batches: Batches) -> Batches:
        encode = Encoder(path, end)
        packer = zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary))
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for first, last in _runs(texts):
                ids = encode(texts[first:last])
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(range(row, row + len(ids)), pa.int64()),
                        pa.array([len(x) // encode.dtype.itemsize for x in ids], pa.int64()),
                        pa.array([packer.compress(x) for x in ids], pa.binary()),
                    ],
                    names=[f.split()[0] for f in FRAMES.split(", ")],
                )
                row += len(ids)

    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), tie.alias("tie"), "text").mapInArrow(kernel, FRAMES)


MANIFEST = "part long, file string, docs long, ids long, bytes long, first_id long, last_id long"


class _File:
    """A data file in the making."""

    def __init__(self, store: files.FileSystem, folder: str, part: int, width: int, digest: bytes):
        self.part, self.name = part, f"part-{part:06d}-{uuid.uuid4().hex}.tok"
        self.out = store.open_output_stream(f"{folder}/{self.name}")
        self.out.write(MAGIC + width.to_bytes(8, "little") + digest)
        self.place, self.ids, self.index = HEAD, 0, []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.index.append((doc_id or 0, doc_id is not None, self.place, len(frame), n, self.ids))
        self.place += len(frame)
        self.ids += n

    def close(self) -> tuple:
        index = np.array(self.index, INDEX)
        self.out.write(index.tobytes())
        self.out.write(self.place.to_bytes(8, "little") + len(index).to_bytes(8, "little") + MAGIC)
        self.out.close()
        named = index["doc_id"][index["known"] == 1]
        ends = (int(named[0]), int(named[-1])) if len(named) else (None, None)
        size = self.place + index.nbytes + TAIL
        return (self.part, self.name, len(index), self.ids, size, *ends)


def write_tokens(
    docs: DataFrame, folder: str, path: str = BYTE_BPE, end: int = END, sample: int = SAMPLE, file_bytes: int = FILE
) -> DataFrame:
    """Write ``docs`` (doc_id, text) to a new ``folder``; returns its manifest."""
    spark = docs.sparkSession
    store, place = opened(folder)
    store.create_dir(place)
    dictionary = train_dictionary(docs, path, end, sample)
    digest = hashlib.sha256(dictionary).digest()
    with store.open_output_stream(f"{place}/dictionary") as out:
        out.write(dictionary)
    width = id_type(subwords.byte_level(path, special=True).size, end).itemsize

    def kernel(batches: Batches) -> Batches:
        own, _ = opened(folder)
        # A task's files are in the order of its rows.
        part, done, now = TaskContext.get().partitionId() << 20, [], None
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, count, frame in zip(ids, n, batch.column(2), strict=True):
                now = now or _File(own, place, part + len(done), width, digest)
                now.add(doc_id, count, frame.as_buffer().to_pybytes())
                if now.place >= file_bytes:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        columns = list(zip(*done, strict=True)) if done else [()] * 7
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=[f.split()[0] for f in MANIFEST.split(", ")],
        )

    line = ["doc_id", "tie", "salt"]
    frames = cut_lineage(_frames(docs, dictionary, path, end))
    ordered = frames.repartitionByRange(*line).sortWithinPartitions(*line)
    written = cut_lineage(ordered.select("doc_id", "n", "frame").mapInArrow(kernel, MANIFEST))
    # One row per file is sorted.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    listed = written.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    listed.write.parquet(f"{folder}/manifest")
    return spark.read.schema(listed.schema).parquet(f"{folder}/manifest")


class Reader:
    """One data file: its index, and the frames of chosen documents."""

    def __init__(self, folder: str, name: str, dictionary: bytes):
        store, place = opened(folder)
        self.file = store.open_input_file(f"{place}/{name}")
        head = self.file.read_at(HEAD, 0)
        size = self.file.size()
        tail = self.file.read_at(TAIL, size - TAIL)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{name} is no whole token file")
        if head[16:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.dtype = np.dtype(f"<u{int.from_bytes(head[8:16], 'little')}")
        at, records = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        self.index = np.frombuffer(self.file.read_at(records * INDEX.itemsize, at), INDEX)
        self.unpacker = zstandard.ZstdDecompressor(**_codec(dictionary))

    def ids(self, chosen: np.ndarray) -> Iterator[tuple[np.void, np.ndarray]]:
        """(index record, ids) of the chosen records, neighbours read together."""
        places, ends = chosen["place"].tolist(), (chosen["place"] + chosen["bytes"]).tolist()
        at = 0
        while at < len(chosen):
            end = at + 1
            first, last = places[at], ends[at]
            while end < len(chosen) and places[end] == last < first + BLOCK:
                last = ends[end]
                end += 1
            block = memoryview(self.file.read_at(last - first, first))
            for record in chosen[at:end]:
                own = int(record["place"]) - first
                frame = block[own : own + int(record["bytes"])]
                yield record, np.frombuffer(self.unpacker.decompress(frame), self.dtype)
            at = end


def _read(listed: DataFrame, folder: str, dictionary: bytes, wanted: list[int] | None, schema: str, values) -> DataFrame:
    """``values(record, start of the file, ids)`` of every document, or of the ids ``wanted``, in tasks of one file each."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]
    chosen = None if wanted is None else np.array(sorted(set(wanted)), np.int64)

    def returned(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], names=names)

    def kernel(batches: Batches) -> Batches:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(folder, name, dictionary)
                index = reader.index
                if chosen is not None:
                    index = index[(index["known"] == 1) & np.isin(index["doc_id"], chosen)]
                out, held = [], 0
                for record, ids in reader.ids(index):
                    out.append((int(record["doc_id"]) if record["known"] else None, *values(record, start, ids)))
                    held += len(ids)
                    if held >= BLOCK // 4:
                        yield returned(out)
                        out, held = [], 0
                if out:
                    yield returned(out)

    n = max(1, min(listed.count(), 10_000))
    return listed.select("file", "start", "part").repartition(n, "part").select("file", "start").mapInArrow(kernel, schema)


def _manifest(spark: SparkSession, folder: str) -> tuple[DataFrame, bytes]:
    store, place = opened(folder)
    with store.open_input_file(f"{place}/dictionary") as f:
        return spark.read.parquet(f"{folder}/manifest"), f.read()


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document."""
    listed, dictionary = _manifest(spark, folder)
    schema = "doc_id long, start long, n_tokens long, ids array<long>"
    return _read(listed, folder, dictionary, None, schema, lambda r, start, ids: (start + int(r["start"]), len(ids), ids))


def read_documents(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents asked for: only their files are opened, only their frames read."""
    listed, dictionary = _manifest(spark, folder)
    here = F.lit(False)
    for doc_id in sorted(set(doc_ids)):
        here = here | ((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    schema = "doc_id long, start long, n_tokens long, ids array<long>"
    values = lambda r, start, ids: (start + int(r["start"]), len(ids), ids)
    return _read(listed.where(here), folder, dictionary, doc_ids, schema, values)


def token_report(docs: DataFrame, path: str = BYTE_BPE, end: int = END) -> DataFrame:
    """Write the files, read them back: per document its first id's place, its ids and their checksum."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    write_tokens(docs, folder, path, end)
    listed, dictionary = _manifest(spark, folder)

    def values(record: np.void, start: int, ids: np.ndarray) -> tuple:
        return start + int(record["start"]), len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _read(listed, folder, dictionary, None, schema, values)
