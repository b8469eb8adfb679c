"""Exact, cached encoding of Arrow text columns with a public tokenizer.

The tokenizer drops white space, ignores case and never joins what it separates, so a text's ids are those of its white-space
separated pieces in order; a full stop or comma that ends a piece after a letter is a piece of its own.  Each distinct piece
is encoded once, by the tokenizers library, and the ids are gathered with numpy.  ``tests/llm`` holds the result against
encoding whole texts.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quantlake.llm import textkit

#: Distinct pieces that a Python worker remembers, across batches and tasks, before it starts anew.
CACHE_PIECES = 500_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


MARKS = np.zeros(256, bool)
MARKS[[44, 46]] = True


MARK_BYTE = b"\x01"
#: Pieces in one text.
JOINED = 200


class Encoder:
    """Ids of the pieces that it knows lie one after the other in ``flat``; piece k's are ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, path: str, spans: bool = False) -> None:
        """With ``spans``, the characters of its piece that each token stands for are kept as well."""
        self.spans = spans
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.mark = self.tokenizer.encode(MARK_BYTE.decode(), add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        self.places = np.zeros((0, 2), np.int64)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of pieces; those not known are encoded."""
        at = pc.index_in(distinct, value_set=self.known)
        if not at.null_count:
            return at.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(self.known) + at.null_count > CACHE_PIECES and len(self.known):
            self.forget()
            return self.numbers(distinct)
        new = distinct.filter(pc.is_null(at))
        ids, sizes, places = self.fresh(new.to_pylist())
        self.places = np.concatenate([self.places, places])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, ids])
        missing = at.is_null().to_numpy(zero_copy_only=False)
        out = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        out[missing] = len(self.known) + np.arange(len(new))
        self.known = pa.concat_arrays([self.known, new])
        return out

    def fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, how many each has, and their places in the piece (if kept).

        Many pieces are encoded as one text with a mark between them, whose own id shows where each ends.
        """
        encode = self.tokenizer.encode_batch if self.spans else self.tokenizer.encode_batch_fast
        joint = len(self.mark) == 1 and not any(MARK_BYTE in x for x in pieces)
        parts = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)] if joint else [[x] for x in pieces]
        after = b" \x01 " if joint else b""
        ids: list[int] = []
        places = [np.zeros((0, 2), np.int64)]
        ends = []
        for got in encode([b"".join([x + after for x in part]).decode() for part in parts], add_special_tokens=False):
            ids += got.ids
            ends.append(len(ids))
            if self.spans:
                places.append(np.array(got.offsets, np.int64).reshape(-1, 2))
        flat, at = np.array(ids, np.uint32), np.concatenate(places)
        if not joint:
            return flat, np.diff(np.array(ends, np.int64), prepend=0), at
        is_mark = flat == self.mark[0]
        sizes = np.diff(np.flatnonzero(is_mark), prepend=-1) - 1
        if len(sizes) != len(pieces):
            raise ValueError("a piece holds the mark's id")
        if self.spans:
            begin = np.concatenate([np.cumsum([0, *(len(x.decode()) + len(after) for x in part)])[:-1] for part in parts])
            at = at[~is_mark] - np.repeat(begin, sizes)[:, None]
        return flat[~is_mark], sizes, at

    def words(self, texts: pa.Array) -> tuple[textkit.Bytes, textkit.Words, np.ndarray, np.ndarray]:
        """Bytes and pieces of texts, the code of each piece, and the number that the encoder gives each code."""
        text = textkit.utf8(texts)
        body = text.data.tobytes()
        plain = not any(x in body for x in self.special)  # their spelling counts in the given case only
        found = textkit.words(text, textkit.NOT_SPACE, textkit.LOWER if plain else textkit.IDENTITY, MARKS if plain else None)
        codes, distinct = found.dictionary()
        return text, found, codes, self.numbers(distinct)

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by ``end``, and where each text's ids begin (one more place than texts)."""
        _, found, codes, number = self.words(texts)
        # The end id is one more piece, put behind the last one of each text.
        codes = np.insert(codes, found.first[1:], len(number))
        begin = np.append(self.first[number], len(self.flat))
        size = np.append(self.first[number + 1] - self.first[number], 1)
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size[codes], out=at[1:])
        flat = np.append(self.flat, np.uint32(end))
        return flat[textkit.ranges(begin[codes], size[codes])], at[found.first + np.arange(len(texts) + 1)]

    def locate(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all tokens and starts of all texts in characters of the batch, and each text's first token."""
        text, found, codes, number = self.words(texts)
        chars = np.zeros(len(text.data) + 1, np.int64)
        np.cumsum(text.data & 0xC0 != 0x80, out=chars[1:])
        size = (self.first[number + 1] - self.first[number])[codes]
        at = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        places = self.places[textkit.ranges(self.first[number][codes], size)] + np.repeat(chars[found.starts], size)[:, None]
        return places[:, 0], places[:, 1], chars[text.offsets], at[found.first]


@lru_cache(maxsize=1)
def encoder(path: str, spans: bool = False) -> Encoder:
    """The encoder of this Python worker: tasks that it runs one after the other share what is known."""
    return Encoder(path, spans)


def id_type(path: str, *more: int) -> str:
    """The numpy type, in little-endian bytes, that holds every id of a tokenizer and ``more``."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(path).get_vocab_size() - 1, *more) < 1 << 16 else "<u4"
