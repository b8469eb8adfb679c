"""Benchmark decontamination with a stored positional inverted index.

Index.  Documents are read once.  The words of a batch of them make a segment: its terms as hashes, how often each occurs, and
each term's ascending list of places, coded by differences.  Segments are rows of a table in the shared folder; documents
follow each other in a segment with empty places between them, so no match crosses them.  A term that a third of all words
are only has a longer list in each segment; nothing is shuffled.

Search.  Windows of the benchmark's items are the queries.  How often each of their terms occurs in the whole corpus is summed
over the segments, and each window is entered through its rarest term: a window whose rarest term a segment lacks costs
nothing there.  The list of the rarest term is intersected with the lists of the others, the rarer first: within ``SLOP``
places for a proximity match, and, of those, at exactly the place that the window asks for, the list being moved by the
term's place in the window, for a phrase.

The benchmark is taken in blocks of ``BLOCK_BYTES`` of text; a block is what is broadcast.  Each is searched by all segments,
which carry what they found from block to block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from quantlake.llm import runtime, textkit

WINDOW = 10
#: Places within which all the terms of a window count as a proximity match, in any order.
SLOP = 15
BLOCK_BYTES = 16 << 20
#: Candidate places that are intersected at a time.
CANDIDATES = 1 << 21
#: A segment is a row of some MB, and a reader holds a row group.  Groups are bounded in rows: Parquet looks at their bytes, as
#: compressed, after 100 rows only, when a group has all the segments of a task.
ROW_GROUPS = {"parquet.block.row.count.limit": "2"}

INDEX = "n_words binary, terms binary, counts binary, places binary, hits binary, found array<array<string>>, near binary"
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near long"
_INDEX_KINDS = [*[pa.binary()] * 5, pa.list_(pa.list_(pa.string())), pa.binary()]


def gap(size: int) -> int:
    """Empty places between documents, and the reach of a proximity match."""
    return max(size, SLOP) + 1


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term number of each word, the sorted distinct hashes, and the first word of each text (and the end)."""
    found = textkit.words(textkit.utf8(column), textkit.ALNUM, textkit.LOWER)
    ids, distinct = found.dictionary()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct)).view(np.int64)
    terms, number = np.unique(hashes, return_inverse=True)
    return number[ids], terms, found.first


def build_index(docs: DataFrame, carried: list[str], size: int) -> DataFrame:
    """Segments of ``docs``; ``own`` lists the ``carried`` columns of a segment's documents."""
    at = docs.columns.index("text")
    own = [docs.columns.index(c) for c in carried]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            term, terms, first = hashed_words(batch.column(at))
            n_words = np.diff(first)
            place = np.arange(len(term)) + np.repeat(np.arange(n), n_words) * gap(size)
            order = np.argsort(term, kind="stable")
            counts = np.bincount(term, minlength=len(terms))
            steps = np.diff(place[order], prepend=0)
            begin = (np.cumsum(counts) - counts)[counts > 0]
            steps[begin] = place[order[begin]]
            rows = pa.StructArray.from_arrays([batch.column(k) for k in own], names=carried)
            arrays = [x.tobytes() for x in (n_words.astype("<i4"), terms.astype("<i8"), counts.astype("<i4"), steps.astype("<i4"))]
            cells = [*arrays, b"", [[] for _ in range(n)], bytes(8 * n)]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), rows), *(pa.array([c], k) for c, k in zip(cells, _INDEX_KINDS, strict=True))],
                names=["own", *(x.split()[0] for x in INDEX.split(", "))],
            )

    schema = runtime.with_fields(StructType([StructField("own", ArrayType(StructType([docs.schema[c] for c in carried])))]), INDEX)
    return runtime.materialize(docs.mapInArrow(run, schema), "index", ROW_GROUPS)


class Segment:
    """Postings of one segment: the places of term t are ``places[first[t]:first[t + 1]]``."""

    def __init__(self, n_words: bytes, terms: bytes, counts: bytes, places: bytes, size: int) -> None:
        self.n_words = np.frombuffer(n_words, "<i4").astype(np.int64)
        self.terms = np.frombuffer(terms, "<i8").astype(np.int64)
        self.counts = np.frombuffer(counts, "<i4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        steps = np.frombuffer(places, "<i4").astype(np.int64)
        total = np.cumsum(steps)
        begin = self.first[:-1]
        self.places = total - np.repeat(total[begin] - steps[begin], self.counts) if len(steps) else steps
        self.opens = np.cumsum(self.n_words) - self.n_words + np.arange(len(self.n_words)) * gap(size)
        self.width = int(self.n_words.sum()) + len(self.n_words) * gap(size) + 2 * gap(size)
        #: One ascending list of all postings, so that many lists can be searched at once.
        self.keys = np.repeat(np.arange(len(self.terms)), self.counts) * self.width + self.places

    def next_place(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first posting of each term at or after a place, as a key; a key of another term where there is none."""
        at = np.searchsorted(self.keys, term * self.width + place)
        return np.append(self.keys, np.iinfo(np.int64).max)[at]

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.opens, place, side="right") - 1


@dataclass
class Block:
    """Windows of a block of items, in the order of their rarest term."""

    items: list[str]
    terms: np.ndarray  # distinct hashes, ascending
    words: np.ndarray  # term numbers of all items' words
    start: np.ndarray  # of each window in words
    length: np.ndarray
    item: np.ndarray
    order: np.ndarray  # places in the window, that of the rarest term first; an item shorter than a window repeats its last
    first: np.ndarray  # windows whose rarest term is t: first[t]:first[t + 1]

    def search(self, segment: Segment, slop: int) -> tuple[np.ndarray, ...]:
        """(window, place) of proximity matches, the place being that of the rarest term, and (window, start) of phrases."""
        at = np.searchsorted(segment.terms, self.terms)
        known = np.append(segment.terms, 0)[at] == self.terms
        known[at == len(segment.terms)] = False
        number = np.where(known, at, -1)
        entered = np.flatnonzero(known & (np.diff(self.first) > 0))
        window = textkit.ranges(self.first[entered], np.diff(self.first)[entered])
        here = number[self.words[self.start[window, None] + self.order[window]]]
        window, here = window[(here >= 0).all(axis=1)], here[(here >= 0).all(axis=1)]
        many = segment.counts[here[:, 0]]
        cuts = np.searchsorted(np.cumsum(many), np.arange(CANDIDATES, many.sum() + CANDIDATES, CANDIDATES), side="left") + 1 if len(many) else []
        near, phrase, begin = [], [], 0
        for end in cuts:
            own = slice(begin, int(end))
            begin = int(end)
            row = np.repeat(np.arange(len(window))[own], many[own])
            place = segment.places[textkit.ranges(segment.first[here[own, 0]], many[own])]
            for k in range(1, here.shape[1]):
                term = here[row, k]
                fits = segment.next_place(term, np.maximum(place - slop, 0)) <= term * segment.width + place + slop
                row, place = row[fits], place[fits]
            near.append((window[row], place))
            origin = place - self.order[window[row], 0]
            row, origin = row[origin >= 0], origin[origin >= 0]
            for k in range(1, here.shape[1]):
                term, want = here[row, k], origin + self.order[window[row], k]
                fits = segment.next_place(term, want) == term * segment.width + want
                row, origin = row[fits], origin[fits]
            phrase.append((window[row], origin))
        joined = lambda pairs: tuple(np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        return *joined(near), *joined(phrase)


def block_of(items: list[tuple[str, str]], index: DataFrame, size: int) -> Block:
    """The windows of a block, their terms in the order of how often the whole corpus has them, then of their places."""
    words, terms, first = hashed_words(pa.array([t for _, t in items], pa.large_string()))
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0), batch.column(1), strict=True):
                own, counts = np.frombuffer(own.as_buffer(), "<i8"), np.frombuffer(counts.as_buffer(), "<i4")
                at = np.searchsorted(shared.value, own)
                known = np.append(shared.value, 0)[at] == own
                known[at == len(shared.value)] = False
                total[at[known]] += counts[known]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "n"])

    n = np.zeros(len(terms), np.int64)
    for r in index.select("terms", "counts").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r["term"]] = r["n"]
    lengths = np.diff(first)
    each = np.where(lengths > 0, np.maximum(lengths - size + 1, 1), 0)
    item = np.repeat(np.arange(len(items)), each)
    start = textkit.ranges(first[:-1], each)
    length = np.minimum(lengths[item], size)
    inside = np.minimum(np.arange(size), length[:, None] - 1).astype(np.int32)
    order = np.take_along_axis(inside, np.argsort(n[words[start[:, None] + inside]], axis=1, kind="stable"), axis=1)
    rarest = words[start + order[:, 0]]
    by = np.argsort(rarest, kind="stable")
    return Block([x for x, _ in items], terms, words, start[by], length[by], item[by], order[by], np.searchsorted(rarest[by], np.arange(len(terms) + 1)))


def blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items in blocks of about ``BLOCK_BYTES`` of text; an empty benchmark is one empty block."""
    block, held, any_yet = [], 0, False
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))
    for item, text in rows.toLocalIterator():
        block.append((item, text))
        held += len(text)
        if held >= BLOCK_BYTES:
            yield block
            block, held, any_yet = [], 0, True
    if block or not any_yet:
        yield block


@dataclass
class Found:
    """What a segment holds: hit places, items of each document, and the number of windows with proximity matches."""

    segment: Segment
    hit: np.ndarray
    items: list[set[str]]
    near: np.ndarray

    def n_hit(self) -> np.ndarray:
        places = np.flatnonzero(self.hit)
        return np.bincount(self.segment.doc_of(places), minlength=len(self.items))


def searched(batch: pa.RecordBatch, block: Block, size: int) -> Iterator[tuple[pa.Array, list, Found]]:
    """Of each segment of a batch: its documents, its columns as they are, and what it has found so far with this block."""
    own = batch.column(0)
    for k in range(batch.num_rows):
        n_words, terms, counts, places, hits, found, near = (batch.column(c)[k].as_py() for c in range(1, 8))
        segment = Segment(n_words, terms, counts, places, size)
        hit = np.unpackbits(np.frombuffer(hits, np.uint8), count=segment.width).astype(bool) if hits else np.zeros(segment.width, bool)
        out = Found(segment, hit, [set(x) for x in found], np.frombuffer(near, "<i8").copy())
        near_window, near_place, window, start = block.search(segment, gap(size) - 1)
        for j in range(int(block.length.max(initial=0))):
            inside = block.length[window] > j
            out.hit[start[inside] + j] = True
        docs = segment.doc_of(start)
        for d, i in np.unique(np.stack([docs, block.item[window]], axis=1), axis=0).tolist():
            out.items[d].add(block.items[i])
        pairs = np.unique(np.stack([segment.doc_of(near_place), near_window], axis=1), axis=0)
        out.near += np.bincount(pairs[:, 0], minlength=len(out.items))
        yield own[k].values, [n_words, terms, counts, places], out


def search(docs: DataFrame, carried: list[str], benchmark: DataFrame, size: int, finish: Callable[[pa.Array, Found], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``finish`` of every segment of ``docs`` after all blocks of the benchmark."""
    runtime.small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    state = build_index(docs, carried, size)

    def step(shared) -> Callable:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, (_, cells, found) in enumerate(searched(batch, shared.value, size)):
                    cells = [*cells, np.packbits(found.hit).tobytes(), [sorted(x) for x in found.items], found.near.astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *(pa.array([c], t) for c, t in zip(cells, _INDEX_KINDS, strict=True))], names=batch.schema.names)

        return run

    def last(shared) -> Callable:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, _, found in searched(batch, shared.value, size):
                    yield finish(rows, found)

        return run

    before = None
    for items in blocks_of(benchmark):
        if before is not None:
            state = runtime.materialize(state.mapInArrow(step(before), state.schema), "index", ROW_GROUPS)
        before = context.broadcast(block_of(items, state, size))
    return state.mapInArrow(last(before), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document: its words, those inside any occurrence of a benchmark window, and the items concerned.

    Texts are lower-cased in A-Z and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A null or empty text has no
    words; an item without words has no windows; a null item_id stands as the text "null", and items with one id count as
    one.  Repeated rows give repeated results, rows with a null doc_id each their own; texts are read whole, a very long one
    as a segment of its own; other columns are not read.  An empty table gives no rows, an empty benchmark leaves every
    document clean.  ``n_near`` counts the items' windows (each place of an item one) that the document has as a proximity
    match: an occurrence of the window's rarest term of the corpus, the first in the window among equally rare ones, with all
    its other terms within ``SLOP`` places on either side (the window's size, if that is more).
    """

    def finish(rows: pa.Array, found: Found) -> pa.RecordBatch:
        n_hit = found.n_hit()
        columns = [
            rows.field(0),
            pa.array(found.segment.n_words),
            pa.array(n_hit, pa.int64()),
            pa.array([len(x) for x in found.items], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found.items], pa.string()),
            pa.array(n_hit > 0),
            pa.array(found.near, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return search(runtime.id_and_text(docs), ["doc_id"], benchmark, size, finish, SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no benchmark window occurs; rows are treated as by ``decontaminate``."""

    def finish(rows: pa.Array, found: Found) -> pa.RecordBatch:
        return pa.RecordBatch.from_struct_array(rows).filter(pa.array(found.n_hit() == 0))

    return search(docs, docs.columns, benchmark, size, finish, docs.schema)
