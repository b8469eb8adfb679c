"""Best-fit packing by minimum bin slack.

Only how many pieces there are of each length matters, so the plan is made from at most ``capacity`` counts, whatever the
corpus.  For each bin the longest piece left is set, and a bitset subset-sum dynamic program over the available lengths finds
the fullest combination that fits beside it.  The combination is applied as often as the counts allow, then removed; that
ends at least one length's supply of full combinations, so the number of steps follows the number of lengths.

Which piece goes where is a join by number: pieces of one length are numbered (salted, so that a length that a third of all
pieces have is numbered in many tasks), and number r of a length has its place in the plan.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.llm import runtime, tokens

CAPACITY = 4096
END_ID = 1
#: Pieces that one task numbers, about.
SALT_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """How many of each length give the largest total within ``room``; lengths are tried in the given order."""
    mask, bits, steps = (1 << room + 1) - 1, 1, []
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            grown = (bits | bits << length * take) & mask
            if grown != bits:
                steps.append((bits, length, take))
                bits = grown
            left, take = left - take, take * 2
        if bits >> room & 1:
            break
    at, chosen = bits.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + take
            at -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins hold it) for all pieces."""
    left, out = {k: v for k, v in counts.items() if v > 0}, []
    order = sorted(left, reverse=True)
    while order:
        longest = order[0]
        left[longest] -= 1
        chosen = fullest(left, order, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[k] // n for k, n in chosen.items())
        out.append((chosen, times))
        for k, n in chosen.items():
            left[k] -= n * times
        order = [k for k in order if left[k]]
    return out


def places(steps: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first number, pieces a bin, first bin, offset in the bin), sorted by length and first number."""
    rows, seen, bins = [], {}, 0
    for chosen, times in steps:
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, seen.get(length, 0), n, bins, offset))
            seen[length] = seen.get(length, 0) + n * times
            offset += n * length
        bins += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer)
        for batch in batches:
            ids, at = encoder.encode(batch.column(1), end)
            flat, rows = ids.astype("<u4"), []
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for k, x in enumerate(range(a, b, capacity)):
                    y = min(x + capacity, b)
                    rows.append((doc_id, k, x - a, y - x, zlib.crc32(flat[x:y])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return runtime.id_and_text(docs).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = END_ID) -> DataFrame:
    """One row per piece with its sequence and its gapless place there.

    A text's ids end with ``end``; a null text has that id alone.  Texts of more than ``capacity`` ids are cut into pieces of
    that many, the last as long as is left, whatever their length.  Repeated rows are packed as often as they occur, rows
    without a doc_id like others; which of equal pieces stands where is arbitrary.  Only doc_id and text are read, whatever
    other columns there are; an empty table gives no rows.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    cut = runtime.materialize(pieces(docs, tokenizer or tokens.default_path(), capacity, end), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    salts = max(1, -(-sum(counts.values()) // SALT_ROWS))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    by_salt = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = by_salt.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("own", F.row_number().over(own) - 1).join(before, ["length", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        key = rows[:, 0] << 40 | rows[:, 1]
        for batch in batches:
            length, number = (batch.column(k).to_numpy() for k in (3, 5))
            k = np.searchsorted(key, length << 40 | number, side="right") - 1
            _, first, each, bins, offset = rows[k].T
            sequence, within = np.divmod(number - first, each)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(bins + sequence), pa.array(offset + within * length)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    chosen = numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("own") + F.col("before")).cast("long").alias("number"))
    return chosen.mapInArrow(run, PIECES + ", sequence_id long, offset long")
