"""Quality rules, line first: rules judge each line, failing lines go, and a document that loses too much text goes with them.

All of a document's figures come from its own text, so a task needs nothing but its batch.  Lines and words of a batch are
Arrow columns and the rules are Arrow's built-in functions over them; words get exact ids from the batch's dictionary, and
repeated three-word windows are found by sorting each document's own windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quantlake.llm import runtime, textkit

SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Of a document's words, the most that may stand in lines that fail.
    max_lost: float = 0.5
    #: A line of fewer words than this must end in a mark, one of at least ``long_line`` words must end in a mark or hold one
    #: for each ``words_per_mark`` words; those between may be headings, list items need no marks.
    short_line: int = 3
    long_line: int = 9
    words_per_mark: int = 20
    #: So many separators for each word, standing alone, make a line navigation; so do two with items of so many words.
    separators_per_word: float = 0.3
    words_per_item: int = 3
    #: So many symbol characters for each word make a line junk.
    symbols_per_word: float = 1.0
    #: Longer lines are text, even if they name a phrase of boilerplate.
    boilerplate_words: int = 25


#: Patterns in the syntax of RE2, which Arrow and SQL engines share; a line holds no line feed.
SPACE = r"[\x20\x09-\x0D]"
SEPARATOR_WORD = r"^[|»›>•·/\\-]+$"
GLUE = r"[|»›•·→]"
#: Four words or more that all begin with a capital, and no marks.
MENU = rf"^{SPACE}*(?:\p{{Lu}}[^\x20\x09-\x0D.,;:!?]*{SPACE}+){{3,}}\p{{Lu}}[^\x20\x09-\x0D.,;:!?]*{SPACE}*$"
SYMBOL = r"[#*$%&<>{}]"
END_MARK = rf"[.!?…:;\"'”’»)\]。！？؟।]{SPACE}*$"
MARK = r"[.,;:!?…。！？؟।]"
LIST_ITEM = rf"^{SPACE}*(?:[-*•‣–]|[0-9A-Za-z]{{1,3}}[.)]){SPACE}"
#: In English, German, French and Spanish.
BOILERPLATE = (
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie(?:s| policy)|click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:this|on)|follow us|powered by|javascript|"
    r"skip to (?:content|main)|back to top|alle rechte vorbehalten|datenschutz|impressum|nutzungsbedingungen|hier klicken|mehr lesen|weiterlesen|anmelden|registrieren|nach oben|folgen sie uns|"
    r"tous droits réservés|politique de confidentialité|mentions légales|conditions d.utilisation|cliquez ici|lire la suite|se connecter|s.inscrire|haut de page|suivez-nous|"
    r"todos los derechos reservados|política de privacidad|aviso legal|términos de uso|haga clic aquí|leer más|iniciar sesión|regístrese|volver arriba|síguenos"
)
RULES = ("navigation", "symbols", "boilerplate", "punctuation")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_lines_removed long, words_removed long, " + ", ".join(f"n_lines_{r} long" for r in RULES) + ", cleaned string"
)


def failing(lines: pa.Array, n: np.ndarray, separators: np.ndarray, rules: Rules) -> np.ndarray:
    """Of each line the rule that it fails, 1 for the first of ``RULES``, or 0; ``n`` is its words (0: never fails)."""

    def has(pattern: str, ignore_case: bool = False) -> np.ndarray:
        return pc.match_substring_regex(lines, pattern, ignore_case=ignore_case).to_numpy(zero_copy_only=False)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(lines, pattern).to_numpy(zero_copy_only=False)

    glue = count(GLUE)
    navigation = (separators >= np.maximum(2, rules.separators_per_word * n)) | ((glue >= 2) & (n <= rules.words_per_item * (glue + 1))) | has(MENU)
    symbols = count(SYMBOL) > rules.symbols_per_word * n
    boilerplate = (n < rules.boilerplate_words) & has(BOILERPLATE, True)
    unmarked = (n < rules.short_line) | ((n >= rules.long_line) & (count(MARK) * rules.words_per_mark < n) & ~has(LIST_ITEM))
    out = np.zeros(len(n), np.int64)
    for k, fails in reversed(list(enumerate((navigation, symbols, boilerplate, unmarked & ~has(END_MARK)), 1))):
        out[fails] = k
    out[n == 0] = 0
    return out


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    _, own = np.unique(ids, return_inverse=True) if ids.max() >= 1 << 21 else (None, ids)
    width = int(own.max()) + 1
    if width >= 1 << 21:
        _, pairs = np.unique(own[:-1] * width + own[1:], return_inverse=True)
        codes = pairs[:-1] * width + own[2:]
    else:
        codes = own[:-2] << 42 | own[1:-1] << 21 | own[2:]
    order = np.argsort(codes)
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def assess(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row per document: counts, ``base_failed``, ``kept``, lines that each rule removes, and the text that they leave.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words and fails the base rules.  Rows are judged one by
    one, whole texts of any length, so repeated rows have equal results and null ids need no care; a line that fails several
    rules counts for the first of ``RULES``.  Only doc_id and text are read, whatever other columns there are; an empty table
    gives no rows.
    """
    runtime.small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = textkit.utf8(batch.column(1))
            found = textkit.words(text, textkit.NOT_SPACE)
            ids, distinct = found.dictionary()
            sums = np.zeros((2, len(text.data) + 1), np.int64)
            np.cumsum(textkit.NOT_SPACE[text.data] & (text.data & 0xC0 != 0x80), out=sums[0, 1:])
            np.cumsum(SYMBOLS[text.data], out=sums[1, 1:])
            chars, symbols = np.diff(sums[:, text.offsets])
            n_docs, n = batch.num_rows, np.diff(found.first)

            split = pc.split_pattern(batch.column(1).cast(pa.large_string()), "\n")
            lines, of_doc = split.flatten(), np.repeat(np.arange(n_docs), pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))
            sizes = pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
            # A line begins after the bytes and the line feeds before it; a document's last line has no line feed.
            begin = np.cumsum(sizes + 1) - (sizes + 1) - of_doc
            edges = np.searchsorted(found.starts, np.append(begin, len(text.data)))
            n_line = np.diff(edges)
            alone = pc.match_substring_regex(distinct.cast(pa.large_string()), SEPARATOR_WORD).to_numpy(zero_copy_only=False)
            separators = np.diff(np.concatenate([[0], np.cumsum(alone[ids])])[edges])
            fails = failing(lines, n_line, separators, rules)

            own = n_line > 0
            coded = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            n_lines = np.bincount(of_doc[own], minlength=n_docs)
            different = np.bincount(np.unique(of_doc[own] << 40 | coded[own]) >> 40, minlength=n_docs)
            removed = [np.bincount(of_doc[fails == k], minlength=n_docs) for k in range(1, len(RULES) + 1)]
            lost = np.bincount(of_doc, np.where(fails > 0, n_line, 0), minlength=n_docs).astype(np.int64)
            kept_lines = np.bincount(of_doc[fails == 0], minlength=n_docs)
            rest = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept_lines)]), pa.int32()), lines.filter(pa.array(fails == 0)).cast(pa.string()))

            again = np.array([repeated_words(ids[a:b]) for a, b in zip(found.first[:-1].tolist(), found.first[1:].tolist(), strict=True)], np.int64)
            failed = (n < rules.min_words) | (100 * again > rules.max_repeat_percent * n)
            kept = ~failed & (lost <= rules.max_lost * n)
            columns = [n, chars, symbols, n_lines - different, again, failed, kept, n_lines, sum(removed), lost, *removed]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in columns), pc.binary_join(rest, "\n")], names=names)

    return runtime.id_and_text(docs).mapInArrow(run, SCHEMA)
