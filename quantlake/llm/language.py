"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams, of one to three letters in words padded by a space, in order of frequency.
A text's own most frequent n-grams are compared with each profile: an n-gram counts by how far its ranks are apart, one that
the profile lacks by the profile's length.  The language of the least total distance is predicted.

Profiles are learned from all training rows: tasks count n-grams by language before the shuffle, and only the profiles
(``PROFILE`` rows a language) reach the driver.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.llm import runtime

PROFILE = 400
UNKNOWN = "und"
#: N-grams that a training task holds before it hands on what it counted.
HELD = 2_000_000
SPACE = 32

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter (Unicode category L)."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _letters


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text with each run of other characters as one space, and a space at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    points = np.where(is_letter, points, SPACE)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    points = points[keep]
    if len(points) and points[0] != SPACE:
        points = np.insert(points, 0, SPACE)
    if len(points) and points[-1] != SPACE:
        points = np.append(points, SPACE)
    return points.astype(np.int64)


def grams(points: np.ndarray) -> np.ndarray:
    """Codes of all one-, two- and three-grams but those that begin and end inside white space; 21 bits a symbol."""
    one = points[points != SPACE]
    two = points[:-1] << 21 | points[1:]
    three = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[points[1:-1] != SPACE] if len(points) > 2 else points[:0]
    return np.concatenate([one, two, three])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def top(codes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` most frequent codes, the smaller code first among equals."""
    distinct, count = counted(codes)
    return distinct[np.argsort(-count, kind="stable")[:n]]


class Profiles:
    def __init__(self, ranked: dict[str, list[int]]) -> None:
        self.langs = sorted(ranked)
        self.codes = np.array(sorted({c for x in ranked.values() for c in x}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(ranked[lang], np.int64)), k] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None, n: int = PROFILE) -> tuple[str, float]:
        points = symbols(text or "")
        if not len(points) or not self.langs:
            return UNKNOWN, 0.0
        own = top(grams(points), n)
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (np.append(self.codes, -1)[at] != own)] = len(self.codes)
        ranks = self.ranks[at]
        far = np.where(ranks < 0, n, np.minimum(np.abs(ranks - np.arange(len(own))[:, None]), n)).sum(axis=0)
        best = int(far.argmin())
        return self.langs[best], 1.0 - float(far[best]) / (n * len(own))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(labelled: DataFrame, n: int = PROFILE) -> dict[str, list[int]]:
    """Profiles of a table (text, lang): of each language the ``n`` most frequent n-grams of all its texts.

    Rows without either are left out, repeated rows count as often as they occur, texts count whole; of equally frequent
    n-grams the smaller code comes first.  An empty table gives no profiles.  What reaches the driver and is broadcast later
    is ``n`` whole numbers a language; there are as many languages as ``lang`` has values, a few hundred at the most in what
    language codes can say, however large the corpus.
    """
    runtime.small_batches(labelled.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def merge(lang: str) -> None:
            codes, count = (np.concatenate(x) for x in zip(*held[lang], strict=True))
            distinct, at = np.unique(codes, return_inverse=True)
            held[lang] = [(distinct, np.bincount(at, count, len(distinct)).astype(np.int64))]

        def flush() -> Iterator[pa.RecordBatch]:
            for lang in held:
                merge(lang)
                codes, count = held[lang][0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(count)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            by_lang = defaultdict(list)
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(text)
            for lang, texts in by_lang.items():
                held[lang].append(counted(grams(symbols(" ".join(texts)))))
                merge(lang)
            if sum(len(x[0][0]) for x in held.values()) > HELD:
                yield from flush()
        yield from flush()

    rows = labelled.select(F.col("text"), F.col("lang")).dropna().mapInArrow(run, "lang string, gram long, n long")
    total = rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("rank") <= n)
    out: dict[str, list[int]] = {}
    for r in ranked.orderBy("lang", "rank").collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


def predict(docs: DataFrame, ranked: dict[str, list[int]], n: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score (1 less the share of the greatest distance possible) of every whole text.

    ``und`` with score 0 where the text is null, empty or has no letter, or where nothing was learned; of languages at one
    distance the alphabetically first.  Rows are judged one by one, so repeated rows have equal results and null ids need no
    care; only doc_id and text are read, whatever other columns there are.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    shared = spark.sparkContext.broadcast(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            got = [profiles.predict(x, n) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return runtime.id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, ranked: dict[str, list[int]], n: int = PROFILE, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text has a language (not ``und``) with a score above ``least``.

    A text at the greatest distance from every profile, as in a script that no training row has, scores 0 and goes; so does
    a null or empty one.  Rows are judged one by one: repeated rows stay or go together, an empty table stays empty, and with
    nothing learned every row goes.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    shared = spark.sparkContext.broadcast(ranked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shared.value)
        for batch in batches:
            got = [profiles.predict(x, n) for x in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([lang != UNKNOWN and score > least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """(text, lang) of the rows that are not held out; ``lang`` may be missing."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.filter(~held_out()).select("text", lang.alias("lang"))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out, and predict all rows.

    A row's fold is crc32(doc_id as text) mod 3: remainder 1 is held out, a null doc_id is not.  ``lang`` may be missing or
    null; then nothing is learned from the row.  Repeated rows count as often as they occur; otherwise rows are treated as by
    ``learn`` and ``predict``.
    """
    out = predict(docs, learn(training_rows(docs)))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
