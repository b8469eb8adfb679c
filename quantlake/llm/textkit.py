"""Words of Arrow text columns, found with numpy over the UTF-8 bytes of a whole batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def _lower_ascii() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


IDENTITY = np.arange(256, dtype=np.uint8)
LOWER = _lower_ascii()

#: Bytes of words ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(9, 14)]] = False

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text whose A-Z are lower-cased (by LOWER).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


#: ASCII letters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


@dataclass
class Bytes:
    """Bytes of a text column: document d is ``data[offsets[d]:offsets[d + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


def utf8(column: pa.Array) -> Bytes:
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Bytes(data[offsets[0] : offsets[-1]], offsets - offsets[0])


@dataclass
class Words:
    """Words of a batch in order; those of document d are ``first[d]:first[d + 1]``; starts are byte places in the batch."""

    values: pa.Array
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.values)

    def dictionary(self) -> tuple[np.ndarray, pa.Array]:
        """An id for each word, and the distinct words; equal words have equal ids."""
        coded = self.values.dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def words(text: Bytes, inside: np.ndarray, to: np.ndarray = IDENTITY, apart: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that are ``inside`` after mapping by ``to``, never across documents.

    A run of one of the bytes ``apart`` at the end of a word, right after an ASCII letter, is a word of its own.
    """
    data = to[text.data]
    is_word = inside[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = is_word[1:]
    cuts = text.offsets[(text.offsets > 0) & (text.offsets < n)]
    before[cuts] = False
    after[cuts - 1] = False
    if apart is not None and n:
        tail = np.flatnonzero(apart[data] & before & ~after)
        tail = tail[LETTER[data[tail - 1]]]
        before[tail] = False
        after[tail - 1] = False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    values = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[is_word])])
    return Words(values, np.searchsorted(starts, text.offsets), starts, ends)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    return np.arange(total) + np.repeat(starts - at, lengths)
