"""Media columns: text payloads as 8-bit mono PCM, chunked, stored once, read back.

A payload is a text's UTF-8 bytes with blanks up to a positive multiple of 192.  It is
held as the samples of a WAVE file, whose header follows from the payload's length.
``chunks`` cuts the samples by content and stores each distinct chunk once; ordered
digest lists rebuild the samples, every chunk is checked, and features come from what
was read back.

Defined results: null text counts as empty (one block of 192 blanks).  Equal texts give
equal values.  Repeated rows and ids are documents of their own.  An empty table gives no
rows.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import chunks
from .common import bucketed, discarded, parts, read, shared_dir

BLOCK, RATE = 192, 8000


def payload(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text, and the padded payload."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(BLOCK, -(-len(data) // BLOCK) * BLOCK), b" ")


def header(size: int) -> bytes:
    """The 44 bytes before ``size`` 8-bit mono samples in a WAVE file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", size)


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square about the mid level, rate of mid-level crossings and a
    16-bin level histogram of the samples."""
    level = samples.astype(np.int16) - 128
    crossings = np.count_nonzero(np.diff(np.signbit(level))) / len(level)
    bins = np.bincount(samples >> 4, minlength=16) / len(level)
    head = f"mean={samples.mean():.4f};rms={np.sqrt(np.mean(np.square(level, dtype=np.float64))):.4f};zcr={crossings:.4f}"
    return head + ";hist=" + ",".join(f"{x:.4f}" for x in bins)


def _cut(texts: list[str | None]):
    made = [payload(t) for t in texts]
    return made, chunks.cuts([np.frombuffer(p, np.uint8) for _, p in made])


def _slices(batch: pa.RecordBatch, rows: int = 1000):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the chunk store and gives its table, a row for each document: recipe
    (``digests``, ``ends``, ``root``) and the ``body`` of the chunks that it owns.

    Every row has a key of its own (task and place), so rows of one id may differ and those
    that repeat each other share their chunks, too."""

    def cut(batches):
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in _slices(batch):
                made, ends = _cut(b.column(1).to_pylist())
                names = [chunks.digests(p, e, 1) for (_, p), e in zip(made, ends)]
                keys = range(n + (task << 40), n + (task << 40) + len(made))
                n += len(made)
                columns = (
                    (keys, pa.int64()), ([task] * len(made), pa.int32()), ([k for k, _ in made], pa.int64()), (names, pa.list_(pa.binary())), (ends, pa.list_(pa.int32())),
                    (map(chunks.root, names), pa.binary()), ([p for _, p in made], pa.binary()),
                )
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kind) for v, kind in columns)], ["doc_id", "key", "task", "n_bytes", "digests", "ends", "root", "body"])

    def strip(batches):
        for batch in batches:
            for b in _slices(batch):
                at = {name: b.column(b.schema.get_field_index(name)) for name in b.schema.names}
                bodies = [chunks.kept(d, e, 1, x) for d, e, x in zip(at["body"].to_pylist(), at["ends"].to_pylist(), at["borrowed"].to_pylist())]
                names = ["doc_id", "n_bytes", "digests", "ends", "root", "borrowed", "lent"]
                yield pa.RecordBatch.from_arrays([at["key"], *(at[x] for x in names), pa.array(bodies, pa.binary())], ["row", *names, "body"])

    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = docs.mapInArrow(cut, "doc_id long, key long, task int, n_bytes long, digests array<binary>, ends array<int>, root binary, body binary")
    schema = "row long, doc_id long, n_bytes long, digests array<binary>, ends array<int>, root binary, borrowed array<int>, lent array<struct<place:int,uses:long>>, body binary"
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    table = chunks.with_shares(bucketed(rows, "task", parts(spark), f"{path}/cut"), "task", strip, schema, f"{path}/media")
    discarded(spark, f"{path}/cut")
    return table


def features(media: DataFrame) -> DataFrame:
    """Rebuilds every stored row's media, checks it, and describes it."""

    def describe(batches):
        for batch in batches:
            for b in _slices(batch):
                out = [[] for _ in range(8)]
                for doc, n, names, ends, top, borrowed, data, extra in zip(*(c.to_pylist() for c in b.columns)):
                    found = chunks.joined(data, ends, 1, names, borrowed, {x["place"]: x["chunk"] for x in extra or ()})
                    if chunks.root(names) != top:
                        raise chunks.BrokenChunk("a recipe has another root")
                    whole = header(len(found)) + found
                    values = (doc, n, len(found), hashlib.sha256(found).hexdigest(), zlib.crc32(found[-16:]), len(whole), hashlib.sha256(whole).hexdigest(), feature(np.frombuffer(found, np.uint8)))
                    for column, v in zip(out, values):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    columns = ["doc_id", "n_bytes", "digests", "ends", "root", "borrowed", "body", "extra"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    whole, borrowing = (part.select(*columns).mapInArrow(describe, schema) for part in chunks.read_back(media, 1))
    return whole.union(borrowing)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(read(spark, sf_dir, "documents")))
