"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

A file set is a Parquet folder of segments in ascending doc_id order, so that any store Spark can write to will do.  A
segment's payload is self-contained:

    magic "QLT1", n_docs, n_tokens (unsigned 64-bit)      20 bytes
    doc_id of each document (signed 64-bit)                8 * n_docs
    tokens of each document (unsigned 32-bit)              4 * n_docs
    control bytes: two bits a token, bytes used less one   ceil(n_tokens / 4)
    data bytes: the ranks, little-endian                   1 to 4 a token

A rank is an id's place when ids are sorted by falling corpus frequency, then by id: the commonest 256 ids take one byte.
The table of ranks is at most the vocabulary, is written beside the segments and is broadcast.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm import runtime, tokens

MAGIC = b"QLT1"
END_ID = 2
SEGMENT_TOKENS = 1 << 19

SEGMENT = "part int, number int, start long, n_tokens long, payload binary"
RANK = "rank int, id long"

#: Bytes used by each of the four tokens of a control byte.
LENGTHS = np.array([[(c >> shift & 3) + 1 for shift in (0, 2, 4, 6)] for c in range(256)], np.uint8)


def pack_values(values: np.ndarray) -> bytes:
    """Control bytes, then data bytes, of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    used = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = used - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    every = values.view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes() + every[np.arange(4) < used[:, None]].tobytes()


def unpack_values(data: bytes, n: int) -> np.ndarray:
    n_control = -(-n // 4)
    used = LENGTHS[np.frombuffer(data, np.uint8, n_control)].reshape(-1)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < used[:, None]] = np.frombuffer(data, np.uint8, int(used.sum(dtype=np.int64)), n_control)
    return out.reshape(-1).view("<u4")


def pack_segment(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    head = MAGIC + struct.pack("<QQ", len(doc_ids), len(ranks))
    return head + doc_ids.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + pack_values(ranks)


def unpack_segment(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if payload[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_docs, n = struct.unpack_from("<QQ", payload, 4)
    doc_ids = np.frombuffer(payload, "<i8", n_docs, 20)
    sizes = np.frombuffer(payload, "<u4", n_docs, 20 + 8 * n_docs)
    return doc_ids, sizes, unpack_values(memoryview(payload)[20 + 12 * n_docs :], n)


def encoded(docs: DataFrame, tokenizer: str, end: int, kind: str) -> DataFrame:
    """doc_id and the ids of each whole text, as bytes of the numpy type ``kind``."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            ids, at = encoder.encode(batch.column(1), end)
            cells = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(at * width), pa.py_buffer(ids.astype(kind))])
            yield pa.RecordBatch.from_arrays([batch.column(0), cells.cast(pa.binary())], names=["doc_id", "ids"])

    return runtime.id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def frequencies(ids: DataFrame, kind: str) -> DataFrame:
    """How often each id occurs; every task counts its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END_ID) -> None:
    """Encode every whole text, append ``end``, and write the file set to the folder ``path``.

    A null text counts as empty and has the end id alone; null doc_ids come first (stored as the smallest long); repeated
    doc_ids keep all their rows, ordered by a hash of their ids.  An empty table gives a file set without documents.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    tokenizer = tokenizer or tokens.default_path()
    kind = tokens.id_type(tokenizer, end)
    raw = runtime.materialize(encoded(docs, tokenizer, end, kind), "ids")
    by_rank = np.array([r["id"] for r in frequencies(raw, kind).orderBy(F.desc("n"), "id").select("id").collect()], np.int64)
    rank_of = np.zeros(int(by_rank.max(initial=-1)) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    table = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank_of, part, start, number = table.value, TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(x) for _, x in held], np.int64)
            payload = pack_segment(np.array([d for d, _ in held], np.int64), sizes, rank_of[np.concatenate([x for _, x in held])])
            row = [[part], [number], [start], [int(sizes.sum())], [payload]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "number", "start", "n_tokens", "payload"])

        for batch in batches:
            for doc_id, cell in zip(batch.column(0), batch.column(1), strict=True):
                got = np.frombuffer(cell.as_buffer(), kind).copy()
                held.append((-(2**63) if doc_id.as_py() is None else doc_id.as_py(), got))
                size += len(got)
                if size >= SEGMENT_TOKENS:
                    yield flush()
                    start, number, held, size = start + size, number + 1, [], 0
        if held:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = raw.withColumn("tie", F.xxhash64("ids")).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = ranged.select("doc_id", "ids").mapInArrow(run, SEGMENT)
    segments.write.option("compression", "none").parquet(f"{path}/segments")
    spark.createDataFrame([(k, int(x)) for k, x in enumerate(by_rank)], RANK).coalesce(1).write.parquet(f"{path}/ranks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit) of each document of a file set."""
    segments = spark.read.schema(SEGMENT).parquet(f"{path}/segments")
    ranks = spark.read.schema(RANK).parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    table = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], "<u4"))
    # One row for each file part: as many as shuffle partitions, however large the corpus.
    before, base = 0, {}
    for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r["part"]] = before
        before += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(k) for k in range(3)), strict=True):
                doc_ids, sizes, values = unpack_segment(payload.as_buffer().to_pybytes())
                ids = np.ascontiguousarray(table.value[values])
                at = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(sizes, out=at[1:])
                cells = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at * 4), pa.py_buffer(ids)])
                starts = at[:-1] + base[part.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=doc_ids == -(2**63)), pa.array(starts), cells.cast(pa.binary())], names=["doc_id", "start", "ids"])

    return segments.select("part", "start", "payload").mapInArrow(run, "doc_id long, start long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids as they stand in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [x.as_buffer() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) // 4 for x in cells], pa.int64()), pa.array([zlib.crc32(x) for x in cells], pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return read_back.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = f"{runtime.shared_dir(spark)}/token-file-{uuid.uuid4().hex}"
    write(docs, path, tokenizer)
    return digest(read(spark, path))
