"""Secret scans by sliding-window Shannon entropy, in DataFrame functions only.

Base rules are three patterns.  The method adds candidate strings, runs of the characters that keys are written in, that are
random enough: over windows of a fixed length the entropy of the characters is followed by counts, from which the character
that leaves is taken and to which the one that enters is added, and the greatest is held against the threshold of the
string's character class.  Strings on the allow list do not count.

Places come from ``split``: between matches stand the pieces that the pattern leaves, so a match begins after the pieces and
matches before it, in running sums.  Each pattern passes over a text as a whole; nothing is exploded and nothing is shuffled,
and the work for m matches in one text grows as m log m.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantlake.llm import runtime

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs under 16 characters are dropped, so they need not be matched: a run of 16 begins where the whole run begins.
HEX = r"[0-9a-f]{16,}"
#: (kind, pattern, group that the least length is for, least length), in the order of the contract.
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))

#: What may follow the first word of a placeholder, in any case; longer words before their beginnings.
FILLER = "(?:placeholder|password|passwd|example|changeme|private|account|string|secret|public|sample|access|client|token|value|dummy|0123456789|1234567890|123456789|12345678|auth|here|test|user|your|goes|pass|key|api|aws|app|for|xx+|my|id)"
#: A part of a hyphenated word: of one case, or with a capital at its start.
PART = "(?:[A-Z]?[a-z]+|[A-Z]+)"


@dataclass(frozen=True)
class Rules:
    window: int = 20
    #: Bits a character, by class: hexadecimal digits; letters and digits; those with + / = _ -.
    hex_bits: float = 3.0
    alnum_bits: float = 3.9
    key_bits: float = 3.9
    #: A candidate needs characters of so many of: lower case, upper case, digits.
    kinds: int = 2
    #: Possessive repeats of groups keep the matcher's stack flat on very long strings.
    #: Candidates that fully match one of these are suppressed: one character over and over, counting rows, placeholders, hyphenated words.
    allow: tuple[str, ...] = (
        r"(.)\1*",
        rf"(?i)[x_-]+|(?:example|sample|dummy|test|placeholder|changeme|your)(?:[_-]|{FILLER})*+[0-9]{{0,4}}",
        r"(?i)(?:0123456789|abcdef|deadbeef)++[0-9a-f]*",
        rf"{PART}(?:[-_/]{PART})*+[0-9]{{0,4}}",
    )


def let(value: Column, body) -> Column:  # noqa: ANN001
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What ``combine``, an associative function, makes of the values up to each place; doubling steps, so n log n in all."""

    def step(state: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(state, lambda x, i: F.when(i >= back, combine(x, F.get(state, i - back))).otherwise(x))

    rounds = F.when(F.size(values) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, values, step)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, value, part) of the leftmost non-overlapping matches; places in code points; part is the group."""
    regex = F.lit(pattern)

    def located(parts: Column) -> Column:
        sizes = F.transform(parts["found"], lambda value, k: F.length(F.get(parts["pieces"], k)) + F.length(value))
        row = lambda ends: lambda value, k: F.struct((F.get(ends, k) - F.length(value)).alias("start"), value.alias("value"), F.get(parts["own"], k).alias("part"))
        return let(sizes, lambda x: let(running(x, lambda a, b: a + b), lambda ends: F.transform(parts["found"], row(ends))))

    found = F.regexp_extract_all(text, regex, F.lit(0)).alias("found")
    own = (F.regexp_extract_all(text, regex, F.lit(group)) if group else found).alias("own")
    none = F.array().cast("array<struct<start:int,value:string,part:string>>")
    return F.when(text.rlike(pattern), let(F.struct(F.split(text, pattern, -1).alias("pieces"), found, own), located)).otherwise(none)


#: Characters of candidates, and how their counts are kept: ``PER_WORD`` counts of ``COUNT_BITS`` bits in a long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
COUNT_BITS, PER_WORD = 6, 10


def windows_entropy(value: Column, window: int) -> Column:
    """The greatest Shannon entropy, in bits a character, over all windows of a string of ALPHABET (null if it is shorter).

    With counts c in a window of w characters the entropy is log2(w) - sum(c log2 c) / w; a step changes two counts.  All
    counts are seven longs, so a step's work depends neither on the window nor on the string.
    """
    if not 0 < window < 1 << COUNT_BITS:
        raise ValueError(f"a window must have 1 to {(1 << COUNT_BITS) - 1} characters")
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    words = -(-len(ALPHABET) // PER_WORD)
    bits = lambda c: (c % PER_WORD) * COUNT_BITS
    word = lambda c: F.floor(c / PER_WORD).cast("int")
    one = lambda c, i: F.when(i == word(c), F.call_function("shiftleft", F.lit(1).cast("bigint"), bits(c))).otherwise(F.lit(0).cast("bigint"))
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), bits(c)).bitwiseAND(F.lit((1 << COUNT_BITS) - 1)).cast("int")

    def over(chars: Column) -> Column:
        def enter(state: Column, c: Column) -> Column:
            n = count(state["counts"], c)
            return F.struct(F.transform(state["counts"], lambda x, i: x + one(c, i)).alias("counts"), (state["sum"] + F.get(terms, n + 1) - F.get(terms, n)).alias("sum"))

        nothing = F.struct(F.array_repeat(F.lit(0).cast("bigint"), words).alias("counts"), F.lit(0.0).alias("sum"))
        head = F.aggregate(F.slice(chars, 1, window), nothing, enter)
        start = let(head, lambda h: F.struct(h["counts"].alias("counts"), h["sum"].alias("sum"), h["sum"].alias("least")))

        def step(state: Column, k: Column) -> Column:
            def moved(p: Column) -> Column:
                out, into = p["out"], p["into"]
                old, new = count(state["counts"], out), count(state["counts"], into)
                change = F.get(terms, old - 1) - F.get(terms, old) + F.get(terms, new + 1) - F.get(terms, new)
                total = F.when(out == into, state["sum"]).otherwise(state["sum"] + change)
                counts = F.transform(state["counts"], lambda x, i: x - one(out, i) + one(into, i))
                return let(total, lambda t: F.struct(counts.alias("counts"), t.alias("sum"), F.least(state["least"], t).alias("least")))

            return let(F.struct(F.get(chars, k - window).alias("out"), F.get(chars, k).alias("into")), moved)

        moves = F.when(F.size(chars) > window, F.sequence(F.lit(window), F.size(chars) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(moves, start, step, lambda state: F.lit(math.log2(window)) - state["least"] / window)

    chars = F.transform(F.filter(F.split(value, "", -1), lambda c: c != ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    return F.when(F.length(value) >= window, let(chars, over))


def random_enough(value: Column, rules: Rules) -> Column:
    kinds = sum((value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]")), F.lit(0))
    bits = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), rules.hex_bits).when(value.rlike("^[A-Za-z0-9]+$"), rules.alnum_bits).otherwise(rules.key_bits)
    allowed = F.lit(False)
    for pattern in rules.allow:
        allowed = allowed | value.rlike(f"^(?:{pattern})$")
    return (kinds >= rules.kinds) & ~allowed & (F.coalesce(windows_entropy(value, rules.window), F.lit(0.0)) >= bits)


def spans_of(text: Column, rules: Rules = Rules()) -> Column:  # noqa: B008
    """Sorted array of (start, rank, kind, end) of every span of a text, base and added."""

    def labelled(rows: Column, rank: int, kind: str) -> Column:
        return F.transform(rows, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["value"])).alias("end")))

    def of_base(rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
        return labelled(F.filter(matches(text, pattern, group), lambda m: F.length(m["part"]) >= least), rank, kind)

    candidates = matches(text, rf"[A-Za-z0-9+/_=-]{{{rules.window},}}")
    added = F.filter(candidates, lambda m: random_enough(m["value"], rules))
    return F.array_sort(F.concat(*(of_base(rank, *rule) for rank, rule in enumerate(BASE)), labelled(added, len(BASE), "entropy")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document.

    A null or empty text has none.  Rows are scanned one by one, whole texts of any length: repeated rows have equal results,
    an empty table gives none.  Spans of one start stand in the order of the kinds; an added span may overlap others.  Only
    doc_id and text are read, whatever other columns there are.
    """
    scanned = runtime.id_and_text(docs).select("doc_id", spans_of(F.col("text"), rules).alias("found"))
    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    return scanned.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans")
    )


#: Code points of the chunks that texts are taken apart into, so that a cut does not search a text from its start.
CHUNK = 4096


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents, all other columns as they are, with every span (overlapping ones as one) replaced by ``mask``.

    A null text stays null, an empty one empty.  Rows are masked one by one, whole texts of any length: repeated rows and
    null ids need no care, an empty table gives none.
    """
    text = F.col("text")

    def between(chunks: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        part = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(part, a % CHUNK + 1, b - a)).otherwise("")

    def masked(found: Column) -> Column:
        def rebuilt(p: Column) -> Column:
            before = lambda k: F.when(k > 0, F.get(p["reach"], k - 1)).otherwise(0)
            piece = lambda s, k: F.when(s["start"] >= before(k), F.concat(between(p["chunks"], before(k), s["start"]), F.lit(mask))).otherwise("")
            return F.concat(F.array_join(F.transform(found, piece), ""), between(p["chunks"], before(F.size(found)), F.length(text)))

        reach = running(F.transform(found, lambda s: s["end"]), F.greatest)
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.when(F.size(found) > 0, let(F.struct(reach.alias("reach"), chunks.alias("chunks")), rebuilt)).otherwise(text)

    return docs.withColumn("text", F.when(text.isNotNull(), let(spans_of(text, rules), masked)))
