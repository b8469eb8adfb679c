"""Removal of repeated 100-byte strings by prefix-free parsing and suffix arrays.

Parsing.  A rolling hash of ``GRAM`` bytes is taken at every place.  The trigger of a 100-byte string is the place of its
least hash (the leftmost of equals), so it depends on the string alone.  Neighbouring strings with one trigger form a phrase:
all the bytes of the strings that share it.  A phrase holds at most 100 + STARTS - 1 bytes, and equal strings stand in phrases
with equal trigger grams, at equal distance from the trigger.

Dictionary and parse.  Equal phrases are one entry of the dictionary, found by a 64-bit hash of the phrase beside the 64-bit
hash of its trigger gram.  The parse is the list of phrase places, sorted by entry and then by corpus order: every place but
an entry's first is a repeat as a whole.  Equal places within a task are found there, before anything is shuffled.

Suffix arrays.  What remains is to compare an entry's first place with entries that have the same trigger gram but are not the
same phrase.  Only those entries get their bytes.  They are sorted twice, by what stands right of the trigger and, reversed,
by what stands left of it: these two suffix arrays with their common-prefix lengths say for each distance from the trigger
which entries share the 100 bytes there, byte by byte.  The earliest in corpus order stays.  A gram with more entries than
``GROUP`` is dealt out anew by a hash of each string instead, so no group has to fit into one task.

The repeat length is fixed, so a phrase with its overhang holds all that can be compared and a suffix of the parse never has
to be followed past its first entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.llm import runtime, textkit

LENGTH = 100
GRAM = 40
#: Grams in a string of LENGTH bytes.
STARTS = LENGTH - GRAM + 1
#: Entries of one trigger gram that a task sorts together; beyond it the strings themselves are dealt out.
GROUP = 20_000
#: Entries sorted at a time.
CHUNK = 50_000
#: Places that a parsing task holds before it hands them on.
HELD = 1_000_000

LAST_ID = 2**63 - 1
PLACE_BITS, SPAN_BITS, TAG_BITS = 31, 7, 24
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
VALUES = textkit.mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


class Rolling:
    """Polynomial hashes of any substring of a byte array, modulo 2**64 over mixed byte values."""

    _powers = np.ones(1, np.uint64)
    _inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        if len(Rolling._powers) <= n:
            size = max(n + 1, 1 << 22)
            for name, base in (("_powers", BASE), ("_inverses", INVERSE)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                setattr(Rolling, name, np.cumprod(table))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[data] * Rolling._powers[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return textkit.mixed((self.sums[ends] - self.sums[starts]) * Rolling._inverses[starts] + (ends - starts).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Hashes of all substrings of ``size`` bytes."""
        n = len(self.sums) - size
        return textkit.mixed((self.sums[size:] - self.sums[:n]) * Rolling._inverses[:n] + np.uint64(size))


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, trigger, gram hash, phrase hash) of each phrase; places are those in ``data``."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    rolling = Rolling(data)
    grams = rolling.every(GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = grams & ~low | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while width * 2 <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < STARTS:
        least = np.minimum(least[: len(least) - (STARTS - width)], least[STARTS - width :])
    trigger = (least & low).astype(np.int64)
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes >= LENGTH)
    valid = textkit.ranges(offsets[full], sizes[full] - LENGTH + 1)
    doc = np.repeat(full, sizes[full] - LENGTH + 1)
    at = trigger[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    first, last = valid[begin], valid[np.append(begin[1:], len(valid)) - 1]
    return doc[begin], first, last, at[begin], grams[at[begin]], rolling.of(first, last + LENGTH)


def pack_place(tag: np.ndarray, first: np.ndarray, span: np.ndarray) -> np.ndarray:
    return tag.astype(np.int64) << (PLACE_BITS + SPAN_BITS) | first << SPAN_BITS | span


def unpack_place(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> (PLACE_BITS + SPAN_BITS), packed >> SPAN_BITS & (1 << PLACE_BITS) - 1, packed & (1 << SPAN_BITS) - 1


def merged(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the union of intervals, apart from each other."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return np.stack([starts[begin], reach[np.append(begin[1:], len(starts)) - 1]], axis=1)


ROW = "gram long, phrase long, doc_id long, place long, marks binary"
FLAGGED = "gram long, doc_id long, place long, marks binary, whole boolean"
_ROW_KINDS = [pa.int64()] * 4 + [pa.binary()]


def _batch(columns: list, kinds: list, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])


def _mark_rows(doc_id: np.ndarray, tag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """(doc_id, tag, intervals as bytes) of each document."""
    order = np.lexsort((starts, tag, doc_id))
    doc_id, tag, starts, ends = doc_id[order], tag[order], starts[order], ends[order]
    cut = np.flatnonzero((np.diff(doc_id) != 0) | (np.diff(tag) != 0)) + 1
    edges = [0, *cut.tolist(), len(doc_id)] if len(doc_id) else []
    return [(int(doc_id[a]), int(tag[a]), merged(starts[a:b], ends[a:b]).astype("<i8").tobytes()) for a, b in zip(edges, edges[1:], strict=False)]


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrase places of texts: of places equal within what a task holds, the first, and marks for the rest."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        gram, phrase, doc_id, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, doc_id, phrase, gram))
        gram, phrase, doc_id, place = gram[order], phrase[order], doc_id[order], place[order]
        same = np.zeros(len(gram), bool)
        same[1:] = (gram[1:] == gram[:-1]) & (phrase[1:] == phrase[:-1])
        # A row that stands twice in the table has equal places, of which none is earlier.
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(gram))))
        again = same & ((doc_id != doc_id[lead]) | (place != place[lead]))
        one = ~same
        yield _batch([gram[one], phrase[one], doc_id[one], place[one], [None] * int(one.sum())], _ROW_KINDS, ROW)
        tag, first, span = unpack_place(place[again])
        rows = _mark_rows(doc_id[again], tag, first, first + span + LENGTH)
        spread = [d * 0x9E3779B1 % (1 << 61) for d, _, _ in rows]
        yield _batch([spread, [0] * len(rows), [d for d, _, _ in rows], [t << (PLACE_BITS + SPAN_BITS) for _, t, _ in rows], [m for _, _, m in rows]], _ROW_KINDS, ROW)

    for batch in batches:
        ids, tags = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        text = textkit.utf8(batch.column(1))
        doc, first, last, _, gram, phrase = phrases(text.data, text.offsets)
        held.append((gram.view(np.int64), phrase.view(np.int64), ids[doc], pack_place(tags[doc], first - text.offsets[doc], last - first)))
        size += len(doc)
        if size > HELD:
            yield from flush()
            held, size = [], 0
    if held:
        yield from flush()


def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of gram, phrase and place: repeats as marks (whole), and places to be compared further.

    A gram's first row waits until the next phrase shows whether the gram has others; nothing else is held.
    """
    kinds = [pa.int64()] * 3 + [pa.binary(), pa.bool_()]
    before, waiting = None, None  # (gram, phrase, doc_id, place) of the phrase's first row; the gram's first row if it still waits
    for batch in batches:
        gram, phrase, doc_id, place = (batch.column(k).to_numpy() for k in range(4))
        local = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        if local.any():
            part = batch.filter(pa.array(local))
            yield _batch([part.column(0), part.column(2), part.column(3), part.column(4), [True] * part.num_rows], kinds, FLAGGED)
            gram, phrase, doc_id, place = (x[~local] for x in (gram, phrase, doc_id, place))
        n = len(gram)
        if not n:
            continue
        head = np.array([0 if before is None else before[0]], np.int64), np.array([0 if before is None else before[1]], np.int64)
        g, p = np.concatenate([head[0], gram]), np.concatenate([head[1], phrase])
        same_gram = g[1:] == g[:-1]
        same = same_gram & (p[1:] == p[:-1])
        if before is None:
            same_gram[0] = same[0] = False
        lead = np.maximum.accumulate(np.where(same, -1, np.arange(n)))
        d0 = np.where(lead < 0, before[2] if before else 0, doc_id[lead])
        p0 = np.where(lead < 0, before[3] if before else 0, place[lead])
        again = same & ((doc_id != d0) | (place != p0))
        opens = np.flatnonzero(~same)  # first rows of phrases
        several = same_gram[opens]
        if waiting is not None and len(opens):
            if several[0]:
                yield _batch([[waiting[0]], [waiting[2]], [waiting[3]], [None], [False]], kinds, FLAGGED)
            waiting = None
        multi = several.copy()
        multi[:-1] |= several[1:]
        out = np.concatenate([opens[multi], np.flatnonzero(again)])
        whole = np.arange(len(out)) >= multi.sum()
        if len(out):
            yield _batch([gram[out], doc_id[out], place[out], [None] * len(out), whole], kinds, FLAGGED)
        if len(opens):
            k = int(opens[-1])
            before = (int(gram[k]), int(phrase[k]), int(doc_id[k]), int(place[k]))
            if not multi[-1]:
                waiting = before


ENTRY = "gram long, doc_id long, tag long, first long, least long, left binary, right binary"


def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with what stands left (reversed) and right of the trigger, from (text, list of places)."""
    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
    for batch in batches:
        rows: list[tuple] = []
        for text, doc_id, cells in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = text.as_buffer().to_pybytes()
            cells = cells.values
            grams, places = (x.to_numpy() for x in cells.flatten())
            tag, first, span = unpack_place(places)
            want = {int(f): (int(g), int(t), int(s)) for f, g, t, s in zip(first, grams, tag, span, strict=True)}
            _, begin, last, trigger, _, _ = phrases(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
            keep = np.isin(begin, first)
            for f, r, a in zip(begin[keep].tolist(), last[keep].tolist(), trigger[keep].tolist(), strict=True):
                gram, own, _ = want[f]
                rows.append((gram, doc_id, own, a, a - r, data[f:a][::-1], data[a : r + LENGTH]))
        yield _batch(list(zip(*rows, strict=True)) if rows else [[]] * 7, kinds, ENTRY)


def suffix_groups(gram: np.ndarray, cells: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of byte strings within their grams, and each one's common prefix with the one before it (-1: another gram)."""
    n = len(cells)
    table = np.zeros((n, 8 + width), np.uint8)
    table[:, :8] = gram.astype(">i8").view(np.uint8).reshape(n, 8)
    flat = np.frombuffer(b"".join(cells), np.uint8)
    size = np.array([len(x) for x in cells], np.int64)
    table[np.repeat(np.arange(n), size), 8 + textkit.ranges(np.zeros(n, np.int64), size)] = flat
    order = np.argsort(table.view(f"V{8 + width}").ravel(), kind="stable")
    ranked = table[order]
    differs = np.ones((n, 9 + width), bool)
    differs[1:, :-1] = ranked[1:] != ranked[:-1]
    common = differs.argmax(axis=1) - 8
    common[0] = -1
    return order, np.maximum(common, -1)


def compare(gram: np.ndarray, doc_id: np.ndarray, tag: np.ndarray, trigger: np.ndarray, least: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(entry, start in its document) of each 100-byte string that an earlier entry of the same gram has as well."""
    n = len(gram)
    sides = [suffix_groups(gram, cells, width) for cells, width in ((left, STARTS - 1), (right, LENGTH))]
    most = np.array([len(x) for x in left], np.int64)
    rank = np.empty(n, np.int64)  # in corpus order of the strings that stand at one distance from the trigger
    rank[np.lexsort((trigger, tag, doc_id))] = np.arange(n)
    entries, starts = [], []
    for distance in range(STARTS):
        live = np.flatnonzero((least <= distance) & (distance <= most))
        if len(live) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, common), depth in zip(sides, (distance, LENGTH - distance), strict=True):
            group = np.empty(n, np.int64)
            group[order] = np.cumsum(common < depth)
            key = key * (n + 1) + group
        by = live[np.lexsort((rank[live], key[live]))]
        opens = np.ones(len(by), bool)
        opens[1:] = key[by][1:] != key[by][:-1]
        earliest = by[np.maximum.accumulate(np.where(opens, np.arange(len(by)), 0))]
        # A row that stands twice in the table is no earlier than itself.
        later = by[(doc_id[by] != doc_id[earliest]) | (tag[by] != tag[earliest]) | (trigger[by] != trigger[earliest])]
        entries.append(later)
        starts.append(trigger[later] - distance)
    return (np.concatenate(entries), np.concatenate(starts)) if entries else (np.zeros(0, np.int64),) * 2


MARK = "doc_id long, tag long, marks binary"
HOT = "string_hi long, string_lo long, doc_id long, tag long, start long"


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks from entries in the order of gram, a chunk of whole grams at a time."""
    kinds = [pa.int64()] * 2 + [pa.binary()]
    held: pa.Table | None = None

    def marks(part: pa.Table) -> pa.RecordBatch:
        gram, doc_id, tag, trigger, least = (part.column(k).to_numpy() for k in range(5))
        entry, start = compare(gram, doc_id, tag, trigger, least, part.column(5).to_pylist(), part.column(6).to_pylist())
        rows = _mark_rows(doc_id[entry], tag[entry], start, start + LENGTH)
        return _batch(list(zip(*rows, strict=True)) if rows else [[]] * 3, kinds, MARK)

    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows >= CHUNK:
            gram = held.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))
            if cut:
                yield marks(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and held.num_rows:
        yield marks(held)


def strings_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each 100-byte string of entries by two hashes."""
    kinds = [pa.int64()] * 5
    for batch in batches:
        gram, doc_id, tag, trigger, least = (batch.column(k).to_numpy() for k in range(5))
        left, right = batch.column(5).to_pylist(), batch.column(6).to_pylist()
        data = np.frombuffer(b"".join(x[::-1] + y for x, y in zip(left, right, strict=True)), np.uint8)
        most = np.array([len(x) for x in left], np.int64)
        begin = np.concatenate([[0], np.cumsum(most + np.array([len(y) for y in right], np.int64))])[:-1]
        count = most - least + 1
        entry = np.repeat(np.arange(len(gram)), count)
        start = textkit.ranges(begin, count)
        inner = start - begin[entry]
        own = Rolling(data).of(start, start + LENGTH).view(np.int64)
        yield _batch([gram[entry], own, doc_id[entry], tag[entry], trigger[entry] - most[entry] + inner], kinds, HOT)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def intervals(docs: DataFrame) -> DataFrame:
    """key (doc_id, null as the largest long), tag, doc_id, text, and the byte intervals to remove.

    Intervals are two lists: ``marks`` of bytes (start and end as little-endian longs), ``spans`` of structs.  Both are null
    where nothing goes.
    """
    runtime.small_batches(docs.sparkSession)
    keyed = runtime.id_and_text(docs).withColumn("tag", F.xxhash64("text").bitwiseAND(F.lit((1 << TAG_BITS) - 1)))
    keyed = keyed.withColumn("key", F.coalesce("doc_id", F.lit(LAST_ID)))
    parsed = keyed.select("key", "text", "tag").mapInArrow(parse, ROW)
    ordered = parsed.repartition("gram").sortWithinPartitions("gram", "phrase", "doc_id", "place")
    flagged = runtime.materialize(ordered.mapInArrow(flag, FLAGGED), "phrases")

    tag = F.shiftright("place", PLACE_BITS + SPAN_BITS).alias("tag")
    start = F.shiftright("place", SPAN_BITS).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    span = F.col("place").bitwiseAND(F.lit((1 << SPAN_BITS) - 1))
    compared = flagged.filter(~F.col("whole")).groupBy("doc_id", tag).agg(F.collect_list(F.struct("gram", "place")).alias("places"))
    wanted = keyed.select("text", F.col("key").alias("doc_id"), "tag").join(compared.hint("shuffle_hash"), ["doc_id", "tag"])
    entries = runtime.materialize(wanted.select("text", "doc_id", "places").mapInArrow(bytes_of, ENTRY), "entries")

    hot = entries.groupBy("gram").count().filter(F.col("count") > GROUP).select("gram")
    settled = entries.join(hot, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram").mapInArrow(settle, MARK)
    strings = entries.join(hot, "gram", "left_semi").mapInArrow(strings_of, HOT)
    place = F.struct("doc_id", "tag", "start")
    firsts = strings.groupBy("string_hi", "string_lo").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter(F.col("n") > 1)
    later = strings.join(firsts, ["string_hi", "string_lo"]).filter(place != F.col("earliest"))

    no_marks, no_span = F.lit(None).cast("binary").alias("marks"), F.lit(None).cast("struct<start:long,end:long>").alias("span")
    own = F.when(F.col("marks").isNull(), F.struct(start.alias("start"), (start + span + LENGTH).alias("end"))).alias("span")
    every = (
        flagged.filter("whole").select("doc_id", tag, "marks", own)
        .unionByName(settled.select("doc_id", "tag", "marks", no_span))
        .unionByName(later.select("doc_id", "tag", no_marks, F.struct("start", (F.col("start") + LENGTH).alias("end")).alias("span")))
    )
    by_doc = every.groupBy(F.col("doc_id").alias("key"), "tag").agg(F.collect_list("marks").alias("marks"), F.collect_list("span").alias("spans"))
    return keyed.join(by_doc.hint("shuffle_hash"), ["key", "tag"], "left")


def kept_bytes(data: np.ndarray, marks: list[bytes] | None, spans: tuple[np.ndarray, np.ndarray] | None) -> tuple[bytes, np.ndarray]:
    """What stays of a document, and the maximal removed runs."""
    rows = [np.frombuffer(x, "<i8").reshape(-1, 2) for x in marks or ()]
    if spans is not None:
        rows.append(np.stack(spans, axis=1))
    if not rows:
        return data.tobytes(), np.zeros((0, 2), np.int64)
    both = np.concatenate(rows)
    gone = merged(both[:, 0], both[:, 1])
    parts, at = [], 0
    for a, b in gone.tolist():
        parts.append(data[at:a].tobytes())
        at = b
    parts.append(data[at:].tobytes())
    return b"".join(parts), gone


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list, list, list]]:
    for batch in batches:
        ids, texts, marks, spans = (batch.column(k) for k in range(4))
        rows: tuple[list, ...] = ([], [], [], [])
        for d in range(batch.num_rows):
            data = np.frombuffer(texts[d].as_buffer(), np.uint8)
            own = spans[d].values
            pair = tuple(x.to_numpy() for x in own.flatten()) if own is not None and len(own) else None
            kept, gone = kept_bytes(data, marks[d].as_py(), pair)
            for column, x in zip(rows, (len(data), int((gone[:, 1] - gone[:, 0]).sum()), len(gone), kept), strict=True):
                column.append(x)
        yield ids, *rows


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept (``kept``) of every document.

    Texts are UTF-8 bytes; a null text is empty.  Corpus order is doc_id, with null last, then place.  Rows with equal doc_id
    and text are one document that stands twice and have equal results; rows with equal doc_id and different texts are
    ordered by a hash of their texts.  An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, removed, spans, kept in _removed(batches):
            yield _batch([ids, n, removed, spans, kept], [pa.int64()] * 4 + [pa.binary()], KEPT)

    return intervals(docs).select("doc_id", "text", "marks", "spans").mapInArrow(run, KEPT)


def digest(docs: DataFrame) -> DataFrame:
    """As ``remove``, with the SHA-256 of the bytes kept in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, n, removed, spans, kept in _removed(batches):
            yield _batch([ids, n, removed, spans, [hashlib.sha256(x).hexdigest() for x in kept]], [pa.int64()] * 4 + [pa.string()], DIGEST)

    return intervals(docs).select("doc_id", "text", "marks", "spans").mapInArrow(run, DIGEST)
