"""N-gram Jaccard join by grouped prefixes.

Shingles.  A document is the set of hashes of its five-word shingles.  Documents with equal sets are one class.  Classes are
numbered in the order of their smallest doc_id, whatever ids the rows have: rows that share an id, or have none, are told
apart by where they were read, so they are documents of their own.

Prefixes.  Shingles are put into one order for all documents, rare ones first: by the logarithm of how often they occur, read
from a counting sketch over all documents, then by hash.  Sets that are alike enough share a shingle among the first
n - ceil(0.8 n) + 1 of each.  The sketch only decides the order, and any order gives the same result; of more than some
hundred million documents its bounded width tells apart only shingles that more than a millionth of them share.

Groups.  Classes with one prefix and one size are a group.  Groups meet by the shingles of their prefixes; a pair counts where
the two places and sizes leave room for enough common shingles.

Verification.  Pairs are verified on whole sets.  Only components are asked for, so what is already connected need not be
verified: first each group is held against the best of the leading groups of its shingles, the links found are contracted,
and then all pairs that remain between different components, of one group or of two, are expanded to members and verified.
A family of many near copies costs one pair for each member, and no link between components is lost.

Hot keys.  Shingles that the sketch shows to be in many documents are dealt out by group as well; joins on shingles, sets and
leaders split keys that hold more than one in ``skew.SHARE`` of the rows.  A leader is sent once to each part of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantlake.llm import components, runtime, skew, textkit

WORDS = 5
#: Similarity as a ratio of whole numbers: linked if DENOMINATOR * common >= NUMERATOR * united.
NUMERATOR, DENOMINATOR = 80, 100
#: Counters of the sketch for each document, within bounds; four bytes each in a task, one byte each in the broadcast.
SKETCH_PER_DOC, SKETCH_LEAST, SKETCH_MOST = 4, 1 << 16, 1 << 24
SKETCH_PART = 1 << 14

LAST_ID = 2**63 - 1

_ODD = textkit.mixed(np.arange(1, WORDS + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class Shingler:
    """Sorted distinct shingle hashes of each text of an Arrow column."""

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        found = textkit.words(textkit.utf8(column), textkit.NOT_SPACE, textkit.LOWER)
        ids, distinct = found.dictionary()
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in distinct.to_pylist()), np.uint64, len(distinct))[ids]
        n = len(of_word)
        full = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for k in range(WORDS):
            full += of_word[k : n - WORDS + 1 + k] * _ODD[k] if len(full) else 0
        full = textkit.mixed(full)
        out = []
        for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(full[a : b - WORDS + 1]))
            elif b > a:  # the whole sequence as one shingle, of its own length
                out.append(textkit.mixed((of_word[a:b] * _ODD[: b - a]).sum(keepdims=True) + _ODD[WORDS:] * np.array([b - a], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def sketch(rows: DataFrame, n_docs: int) -> np.ndarray:
    """Levels (quarters of a power of two) of how often the shingles of each counter occur, over all documents."""
    wanted = SKETCH_PER_DOC * n_docs
    width = min(SKETCH_MOST, max(SKETCH_LEAST, 1 << max(0, wanted - 1).bit_length()))
    parts = width // SKETCH_PART

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, total = Shingler(), np.zeros(width, np.uint32)
        for batch in batches:
            sets = shingler.sets(batch.column(0))
            total += np.bincount((np.concatenate([np.zeros(0, np.uint64), *sets]) & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint32)
        pack = zstandard.ZstdCompressor(level=1).compress
        cells = [pack(x.tobytes()) for x in total.reshape(parts, SKETCH_PART)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(cells, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), np.uint32).astype(np.uint64)
                total[part] = total[part] + got if part in total else got
        levels = [np.ceil(4 * np.log2(1.0 + x)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["part", "levels"])

    counted = rows.select("text").mapInArrow(count, "part int, counts binary")
    out = np.zeros((parts, SKETCH_PART), np.uint8)
    for r in counted.repartition("part").mapInArrow(add, "part int, levels binary").collect():
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.reshape(-1)


def prefix_length(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


ADDED = "n long, print binary, g long, prefix binary, parts binary"


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` with the set's size, a 128-bit hash of it, the group, the prefix in order (unsigned 64-bit) and parts.

    The group is a hash of size and prefix.  Should two meet in one hash, their members are candidates for nothing and fail
    verification; no pair is lost.  Of each shingle of the prefix, ``parts`` (unsigned 16-bit) says over how many tasks its
    postings are to be dealt.
    """
    spark = rows.sparkSession
    n_docs = rows.count()
    levels = spark.sparkContext.broadcast(sketch(rows, n_docs))
    of_level = np.clip(2.0 ** (np.arange(256) / 4) * skew.SHARE / max(1, n_docs), 1, 2 * skew.SHARE).astype("<u2")
    at = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level = Shingler(), levels.value
        low = np.uint64(len(level) - 1)
        for batch in batches:
            sets = shingler.sets(batch.column(at))
            cells, parts = [], []
            for x in sets:
                own = level[(x & low).astype(np.int64)]
                first = np.argsort(own, kind="stable")[: prefix_length(len(x)) if len(x) else 0]
                cells.append(x[first].tobytes())
                parts.append(of_level[own[first]].tobytes())
            added = [
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                pa.array([xxhash.xxh3_64_intdigest(c, seed=len(x)) - (1 << 63) for c, x in zip(cells, sets, strict=True)], pa.int64()),
                pa.array(cells, pa.binary()),
                pa.array(parts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *(x.split()[0] for x in ADDED.split(", "))])

    return rows.mapInArrow(run, runtime.with_fields(rows.schema, ADDED))


POSTING = "token long, part int, place int, g long, n int"
LED = "token long, place int, g long, n int, h long, m int, at int, part int"


def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of token, part, place and group, each once, with the first of its token and part, its leader.

    An undivided token of one group is left out: a leader waits for a second group.  Nothing but the leader is held.
    """
    key, lead, last, waits = None, None, None, False  # (token, part), (g, n, place), the last g, whether the leader has yet to go out
    for batch in batches:
        token, part, place, g, n = (batch.column(k).to_numpy() for k in range(5))
        if not len(token):
            continue
        if waits:
            token, part, place, g, n = (np.concatenate([np.array([x], c.dtype), c]) for x, c in zip((*key, lead[2], lead[0], lead[1]), (token, part, place, g, n), strict=True))
        opens = np.ones(len(token), bool)
        opens[1:] = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
        opens[0] = waits or key != (int(token[0]), int(part[0]))
        again = np.zeros(len(token), bool)
        again[1:] = ~opens[1:] & (g[1:] == g[:-1])
        again[0] = not opens[0] and int(g[0]) == last
        run = np.cumsum(opens)  # 0 for rows that go on with the key of the batch before
        heads = np.flatnonzero(opens)
        of_lead = [np.concatenate([[0 if lead is None else lead[k]], c[heads]])[run] for k, c in enumerate((g, n, place))]
        size = np.bincount(run[~again], minlength=len(heads) + 1)
        out = np.flatnonzero(~again & ((part > 0) | (size[run] > 1) | (run == 0)))
        columns = [x[out] for x in (token, place, g, n, *of_lead, part)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=[x.split()[0] for x in LED.split(", ")])
        waits = bool(run[-1] > 0 and size[run[-1]] == 1 and part[-1] == 0)
        key, lead, last = (int(token[-1]), int(part[-1])), tuple(int(x[-1]) for x in of_lead), int(g[-1])


def shared_postings(prefixed: DataFrame) -> DataFrame:
    """(token, place, g, n) of each shingle that the prefixes of two groups or more have, with its leader (h, m, at).

    The leader has the shingle at the first place, and the smallest g of those.  Each part of a divided token has its own.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            mine = []
            for k, g in enumerate(batch.column(0).to_pylist()):
                if g not in done:
                    done.add(g)
                    mine.append(k)
            if len(done) > 1_000_000:  # only saves rows
                done = set()
            batch = batch.take(pa.array(mine, pa.int64()))
            size = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)], np.int64)
            token = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            parts = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), size)
            g = batch.column(0).to_numpy()[row]
            part = np.where(parts > 1, 1 + g % parts, 0)
            place = textkit.ranges(np.zeros(len(size), np.int64), size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token), pa.array(part, pa.int32()), pa.array(place, pa.int32()), pa.array(g), batch.column(1).cast(pa.int32()).take(pa.array(row))], names=["token", "part", "place", "g", "n"]
            )

    rows = prefixed.filter("n > 0").select("g", "n", "prefix", "parts").mapInArrow(explode, POSTING)
    return rows.repartition("token", "part").sortWithinPartitions("token", "part", "place", "g").mapInArrow(led, LED)


def room(n1: str, place1: str, n2: str, place2: str) -> F.Column:
    """Whether two sets whose first common shingle stands at these places can be alike enough."""
    most = F.least(F.col(n1) - F.col(place1), F.col(n2) - F.col(place2))
    return most * (DENOMINATOR + NUMERATOR) >= NUMERATOR * (F.col(n1) + F.col(n2))


def verified(pairs: DataFrame, texts: DataFrame, classes: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """Those pairs (a, b) of classes whose whole sets are alike enough; ``texts`` has (row, text).

    Texts meet in one shuffle by ``a`` and part: first the text of ``a``, then those of its ``b``, of which none is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, lead, own = Shingler(), None, np.zeros(0, np.uint64)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for a, b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shingler.sets(batch.column(2)), strict=True):
                if b < 0:
                    lead, own = a, x
                    continue
                common = len(np.intersect1d(own, x, assume_unique=True)) if a == lead else 0
                if common and DENOMINATOR * common >= NUMERATOR * (len(own) + len(x) - common):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    dealt = pairs.withColumn("parts", skew.parts("a", skew.hot_keys(pairs, "a")))
    members = dealt.select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    leaders = dealt.select("a", "parts").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    roles = members.select(F.col("b").alias("node"), "a", "part", F.col("b").alias("other")).unionByName(leaders.select(F.col("a").alias("node"), "a", "part", F.lit(-1).cast("long").alias("other")))
    of_row = scratch.write(roles.join(classes.select("node", "row"), "node").drop("node"), "roles")
    met = texts.join(of_row, "row").repartition("a", "part").sortWithinPartitions("a", "part", "other")
    return scratch.write(met.select("a", "other", "text").mapInArrow(run, "a long, b long"), "links")


def _linked(prefixed: DataFrame, texts: DataFrame, classes: DataFrame, scratch: runtime.Scratch) -> DataFrame:
    """(node, root) of the classes that links connect."""
    members = classes.select("g", "n", "node")
    leaders = members.groupBy("g").agg(F.min("node").alias("leader"))
    shared = scratch.write(shared_postings(prefixed), "postings")

    # First, each group against the leaders of its shingles, those of a divided shingle's parts against the first of them, and
    # each group's members against its own leading member.
    tops = shared.filter("part > 0 and g = h").select("token", "g", "n", "place")
    top = tops.groupBy("token").agg(F.min(F.struct("place", "g", "n")).alias("top"))
    of_parts = tops.join(top, "token").select("g", "n", "place", F.col("top.g").alias("h"), F.col("top.n").alias("m"), F.col("top.place").alias("at"))
    near = shared.select("g", "n", "place", "h", "m", "at").unionByName(of_parts)
    near = scratch.write(near.filter((F.col("g") != F.col("h")) & room("n", "place", "m", "at")).select("g", "h").distinct(), "near")
    of_h = skew.lookup(near, leaders.select(F.col("g").alias("h"), F.col("leader").alias("a")), "h")
    across = of_h.join(leaders.select("g", F.col("leader").alias("b")), "g")
    within = skew.lookup(members.drop("n"), leaders, "g").filter("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    pairs = scratch.write(across.select("a", "b").union(within).distinct(), "pairs")
    # There are about as many roles as documents: of either table only a shuffle can be counted on.
    links = verified(pairs, texts.hint("shuffle_hash"), classes, scratch)
    roots = components.components(links)

    # Then all pairs that remain between different components: of different groups by the shingles that these share, of one
    # group by the group itself, as their common prefix need not be shared with another.  Of a shingle's rows, those of its
    # commonest component are met by the others only, never by each other.
    of_node = scratch.write(members.join(roots, "node", "left").select("g", "n", "node", F.coalesce("root", "node").alias("root")), "roots")
    of_group = of_node.groupBy("g", "root").agg(F.count("*").alias("k"))
    split = of_group.groupBy("g").agg(F.count("*").alias("roots")).filter("roots > 1").select("g")
    by_root = shared.select("token", "g").join(of_group, "g").groupBy("token", "root").agg(F.sum("k").alias("k"))
    by_root = by_root.unionByName(of_group.join(split, "g").select(F.col("g").alias("token"), "root", "k"))
    main = by_root.groupBy("token").agg(F.max(F.struct("k", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    main = scratch.write(main.select("token", F.col("main.root").alias("main")), "main")
    split_shared = shared.select("token", "place", "g").join(main, "token")
    rows = split_shared.join(of_node, "g").unionByName(of_node.join(split, "g").withColumn("token", F.col("g")).withColumn("place", F.lit(0)).join(main, "token"))
    mixed = scratch.write(rows.select("token", "place", "n", "node", "root", "main"), "mixed")
    few = mixed.filter("root != main").select("token", F.col("place").alias("at"), F.col("n").alias("m"), F.col("node").alias("other"), F.col("root").alias("other_root"))
    fits = (F.col("root") != F.col("other_root")) & room("n", "place", "m", "at") & ((F.col("root") == F.col("main")) | (F.col("node") < F.col("other")))
    rest = mixed.join(few, "token").filter(fits).select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()
    met = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = scratch.write(rest.join(met, ["a", "b"], "left_anti"), "rest")
    return components.components(links.union(verified(rest, texts, classes, scratch)))


def link_components(docs: DataFrame, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents and classes.

    Documents: row, doc (the doc_id, null as the largest), n, print and, if ``whole``, all columns of ``docs`` as ``own``.
    Classes, the sets that are not empty: print, node, doc and row (of the smallest doc_id), and root, the smallest node that
    links reach.  Nodes stand in the order of doc.
    """
    spark = docs.sparkSession
    runtime.small_batches(spark)
    own = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")] if whole else []
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc")
    keyed = prefixes(docs.select(F.monotonically_increasing_id().alias("row"), doc, F.coalesce("text", F.lit("")).alias("text"), *own))
    with runtime.Scratch(spark) as scratch:
        prefixed = runtime.materialize(keyed.drop("text") if whole else keyed, "prefixes")
        texts = prefixed.select("row", F.coalesce("own.text", F.lit("")).alias("text") if whole else "text")
        firsts = prefixed.filter("n > 0").groupBy("print").agg(F.min(F.struct("doc", "row")).alias("first"), F.min("g").alias("g"), F.min("n").alias("n"))
        ordered = firsts.select("print", "g", "n", "first.doc", "first.row").orderBy("doc", "print")
        classes = scratch.write(ordered.withColumn("node", F.monotonically_increasing_id()), "classes")
        roots = _linked(prefixed, texts, classes, scratch)
        found = classes.select("print", "node", "doc", "row").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        return prefixed.select("row", "doc", "n", "print", *(["own"] if whole else [])), runtime.materialize(found, "components")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document.

    Texts are lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+``.  Fewer than five words make one shingle; a text
    without words, or null, has none and is linked with nothing.  Documents with equal sets are linked, so repeated rows are,
    and get equal results, each its own row.  Rows that share a doc_id but not a text are documents of their own, and so are
    rows whose doc_id is null; null counts as the largest id, and a component of such rows alone has a null component_id.
    Texts are read whole, however long.  Only doc_id and text are read, whatever other columns there are.  An empty table
    gives no rows.
    """
    documents, classes = link_components(docs)
    of_root = classes.filter("node = root").select("root", F.col("doc").alias("component"))
    of_print = runtime.materialize(skew.lookup(classes.select("print", "root"), of_root, "root").select("print", "component"), "prints")
    some = skew.lookup(documents.filter("n > 0").select("doc", "n", "print"), of_print, "print").select("doc", "n", "component")
    both = some.union(documents.filter("n = 0").select("doc", "n", F.col("doc").alias("component")))
    known = lambda c: F.when(F.col(c) != LAST_ID, F.col(c))
    return both.select(known("doc").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, but of those that links connect only the one of the smallest doc_id.

    Each row is a document of its own, whatever ids others have; null counts as the largest id.  Of rows with equal sets and
    equal ids the first read stays.  Rows without words are linked with nothing and all stay.  Texts are read whole.
    """
    documents, classes = link_components(docs, whole=True)
    first = classes.filter("node = root").select("row")
    # Of documents and of those that stay only a shuffle can be counted on.
    kept = documents.filter("n > 0").join(first.hint("shuffle_hash"), "row", "left_semi").unionByName(documents.filter("n = 0"))
    return kept.select(*(F.col("own").getField(c).alias(c) for c in docs.columns))
