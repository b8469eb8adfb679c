"""Token counts of sections by offset-mapped attribution.

Whole documents are encoded once.  Each token keeps the characters that it stands for, and a sorted interval join puts it
into the section that holds them: a line of the text, or a field of the document.  A token across a boundary goes, whole, to
one section by a rule, by default to that which has most of its characters; so sections add up to the document, and no section
is encoded apart from its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantlake.llm import runtime, textkit, tokens

#: Longer lines are cut into sections of this many characters.
SECTION_CHARS = 1000

SCHEMA = "doc_id long, section int, start long, end long, n_tokens long, n_crossing long"


def line_sections(data: np.ndarray, offsets: np.ndarray, most: int = SECTION_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of sections in characters of the batch: lines with their line feed, cut after ``most`` characters.

    An empty document has one empty section.
    """
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data & 0xC0 != 0x80, out=chars[1:])
    begin, n = chars[offsets], len(offsets) - 1
    after = chars[np.flatnonzero(data == 10) + 1]
    doc = np.concatenate([np.arange(n), np.searchsorted(begin, after, side="right") - 1])
    starts = np.concatenate([begin[:-1], after])
    # A line feed at the very end of a document opens no section.
    ends_there = np.concatenate([np.zeros(n, bool), np.isin(after, begin)])
    starts, doc = starts[~ends_there], doc[~ends_there]
    order = np.lexsort((starts, doc))
    starts, doc = starts[order], doc[order]
    ends = np.append(starts[1:], begin[-1])
    last = np.append(doc[1:] != doc[:-1], True)
    ends[last] = begin[1:][doc[last]]
    pieces = np.maximum(1, -(-(ends - starts) // most))
    k = textkit.ranges(np.zeros(len(pieces), np.int64), pieces)
    line = np.repeat(np.arange(len(pieces)), pieces)
    cut = starts[line] + k * most
    return doc[line], cut, np.minimum(cut + most, ends[line])


#: How a token across boundaries is allocated: to the section that has most of its characters, the earlier of equals; to that
#: of its first character; or to that of its last.
RULES = ("most", "first", "last")


def allocate(starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """The section of each token, and whether the token crosses a boundary; sections are sorted and lie side by side."""
    nonempty = np.flatnonzero(stop > begin)
    edge = begin[nonempty]
    low = np.searchsorted(edge, starts, side="right") - 1
    high = np.searchsorted(edge, np.maximum(ends - 1, starts), side="right") - 1
    crossing = high > low
    out = {"most": low, "first": low, "last": high}[rule].copy()
    if rule == "most" and crossing.any():
        token = np.flatnonzero(crossing)
        size = high[token] - low[token] + 1
        row = np.repeat(token, size)
        section = textkit.ranges(low[token], size)
        held = np.minimum(ends[row], stop[nonempty[section]]) - np.maximum(starts[row], edge[section])
        # Of each token's sections, in their order, the first that holds most.
        first = np.cumsum(size) - size
        best = np.lexsort((section, -held, row))
        out[token] = section[best[first]]
    return nonempty[out], crossing


def _counts(section: np.ndarray, crossing: np.ndarray, n: int) -> list[np.ndarray]:
    return [np.bincount(section[m], minlength=n) for m in (slice(None), crossing)]


def _check(rule: str) -> None:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")


def count_tokens(docs: DataFrame, tokenizer: str | None = None, most: int = SECTION_CHARS, rule: str = "most") -> DataFrame:
    """One row for each section of each document: its characters, the tokens allocated to it, and those of them that cross.

    Sections are the lines of the text, longer ones cut after ``most`` characters; a null or empty text has one empty
    section.  Texts are encoded whole, however long.  Repeated rows, and rows without a doc_id, each have their own results;
    of equally held tokens the earlier section has them; only doc_id and text are read, whatever other columns there are; an
    empty table gives no rows.
    """
    _check(rule)
    runtime.small_batches(docs.sparkSession)
    path = tokenizer or tokens.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, spans=True)
        for batch in batches:
            text = textkit.utf8(batch.column(1))
            doc, begin, stop = line_sections(text.data, text.offsets, most)
            starts, ends, base, _ = encoder.locate(batch.column(1))
            section, crossing = allocate(starts, ends, begin, stop, rule)
            first = np.searchsorted(doc, np.arange(batch.num_rows))
            columns = (np.arange(len(doc)) - first[doc], begin - base[doc], stop - base[doc], *_counts(section, crossing, len(begin)))
            kinds = (pa.int32(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return runtime.id_and_text(docs).mapInArrow(run, SCHEMA)


FIELD_SCHEMA = "doc_id long, field string, start long, end long, n_tokens long, n_crossing long"


def count_field_tokens(docs: DataFrame, fields: Sequence[str], separator: str = "\n", tokenizer: str | None = None, rule: str = "most") -> DataFrame:
    """One row for each field of each document: the document is its fields with ``separator`` between them, encoded as one text.

    A separator belongs to the field before it; a null field is empty.  Other cases are as for ``count_tokens``.
    """
    _check(rule)
    runtime.small_batches(docs.sparkSession)
    path, names, n = tokenizer or tokens.default_path(), list(fields), len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, spans=True)
        for batch in batches:
            parts = [pc.fill_null(batch.column(k + 1), "") for k in range(n)]
            whole = pc.binary_join_element_wise(*parts, pa.scalar(separator, parts[0].type))
            sizes = np.stack([pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in parts], axis=1)
            sizes[:, :-1] += len(separator)
            starts, ends, base, _ = encoder.locate(whole)
            stop = np.cumsum(sizes.ravel())
            begin = stop - sizes.ravel()
            section, crossing = allocate(starts, ends, begin, stop, rule)
            doc = np.repeat(np.arange(batch.num_rows), n)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(names * batch.num_rows, pa.string())]
            columns += [pa.array(x) for x in (begin - base[doc], stop - base[doc], *_counts(section, crossing, len(begin)))]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in FIELD_SCHEMA.split(", ")])

    own = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"f{k}") for k, c in enumerate(names)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own).mapInArrow(run, FIELD_SCHEMA)
