"""Plain versions of the operators, one document at a time."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

ASCII_LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def quality(text: str | None) -> tuple:
    w, t = spaced(text), text or ""
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if spaced(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def sections(text: str | None, most: int, encode, rule: str = "most") -> list[tuple]:
    text, spans, at = text or "", [], 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        spans += [(at + k, at + min(k + most, len(line))) for k in range(0, len(line), most)]
        at += len(line)
    return attributed(spans or [(0, 0)], encode(text).offsets, rule)


def attributed(spans: list[tuple], offsets: list[tuple], rule: str = "most") -> list[tuple]:
    counts = [[0, 0] for _ in spans]
    for a, b in offsets:
        common = [max(0, min(b, y) - max(a, x)) for x, y in spans]
        held = [i for i, c in enumerate(common) if c]
        k = {"most": max(range(len(spans)), key=lambda i: (common[i], -i)), "first": held[0], "last": held[-1]}[rule]
        counts[k][0] += 1
        counts[k][1] += len(held) > 1
    return [(i, x, y, *c) for i, ((x, y), c) in enumerate(zip(spans, counts, strict=True))]


def repeats(texts: dict[int, str | None], length: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for d in sorted(texts):
        body = (texts[d] or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            part = body[i : i + length]
            if part in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(part)
        runs = sum(1 for i in range(len(body)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(body), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(body, gone, strict=True) if not y)).hexdigest())
    return out


def contamination(text: str | None, items: list[tuple], size: int = 10) -> tuple:
    windows = defaultdict(set)
    for item, body in items:
        w = alnum(body)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k : k + size])].add(str(item))
    w, hit, found = alnum(text), set(), set()
    for n in {len(x) for x in windows}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                found |= windows[tuple(w[k : k + n])]
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def nearness(texts: dict, items: list[tuple], size: int = 10, slop: int = 15) -> dict:
    """Of each text, how many places of items are windows with a proximity match."""
    words = {d: alnum(t) for d, t in texts.items()}
    often = Counter(w for x in words.values() for w in x)
    out = dict.fromkeys(texts, 0)
    for _, body in items:
        w = alnum(body)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            window = w[k : k + size]
            rare = min(window, key=lambda t: often[t])
            if not all(often[t] for t in window):
                continue
            for d, own in words.items():
                out[d] += any(x == rare and set(window) <= set(own[max(0, p - slop) : p + slop + 1]) for p, x in enumerate(own))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secrets(text: str | None) -> tuple:
    t = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    found.sort()
    return *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest()


def entropy_spans(text: str | None, rules) -> list[str]:
    out = []
    for m in re.finditer(rf"[A-Za-z0-9+/_=-]{{{rules.window},}}", text or ""):
        value, w = m[0], rules.window
        kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
        bits = rules.hex_bits if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) else rules.alnum_bits if re.fullmatch("[A-Za-z0-9]+", value) else rules.key_bits
        most = max(-sum(c / w * math.log2(c / w) for c in Counter(value[k : k + w]).values()) for k in range(len(value) - w + 1))
        if kinds >= rules.kinds and most >= bits - 1e-9 and not any(re.fullmatch(p, value) for p in rules.allow):
            out.append(f"entropy:{m.start()}:{m.end()}")
    return out


def licenses(text: str | None, phrases) -> tuple:
    w, at, labels = alnum(text), [], set()
    for phrase, label in phrases:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def components(texts: dict[int, str | None]) -> dict[int, tuple]:
    sets = {}
    for d, t in texts.items():
        w = spaced((t or "").translate(ASCII_LOWER))
        sets[d] = frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()
    root, index = {d: d for d in sets}, defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d in sorted(sets):
        common = Counter()
        for s in sets[d]:
            common.update(index[s])
            index[s].append(d)
        for e, k in common.items():
            if 100 * k >= 80 * (len(sets[d]) + len(sets[e]) - k):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def _profile(texts: list, n: int) -> list[int]:
    counts: Counter = Counter()
    for text in texts:
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
        for word in letters.split(" "):
            if word:
                padded = f" {word} "
                counts.update(word)
                counts.update(padded[i : i + 2] for i in range(len(padded) - 1))
                counts.update(padded[i : i + 3] for i in range(len(padded) - 2))
    code = lambda gram: sum(ord(c) << 21 * (len(gram) - 1 - k) for k, c in enumerate(gram))
    return sorted(map(code, counts), key=lambda c: (-named[c], c))[:n] if (named := {code(g): k for g, k in counts.items()}) else []


def languages(rows: list[tuple], n: int = 400) -> dict:
    """doc_id -> (held_out, lang_pred, score) by rank-order profiles, from rows (doc_id, text, lang)."""
    held = {d: zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in rows}
    langs = sorted({x for d, t, x in rows if x is not None and t is not None and not held[d]})
    profiles = {x: {c: k for k, c in enumerate(_profile([t for d, t, y in rows if y == x and not held[d]], n))} for x in langs}
    out = {}
    for d, text, _ in rows:
        own = _profile([text], n)
        far = {x: sum(min(abs(profiles[x][c] - k), n) if c in profiles[x] else n for k, c in enumerate(own)) for x in langs}
        best = min(langs, key=lambda x: far[x]) if own and langs else "und"
        out[d] = (held[d], best, 1 - far[best] / (n * len(own)) if best != "und" else 0.0)
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def groups_with_a_lone_leader(shingler, prefix_length, n: int = 12) -> list[tuple[int, str]]:
    """Threes of documents of one prefix in the order of hashes, of which the last two alone are linked; the last row shares the end of the last three's prefix."""
    rng = random.Random(7)
    rows: list[tuple[int, str]] = []
    while len(rows) < 3 * n:
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(18)]
        three = [" ".join(x) for x in (["other", *base[1:-1], "one"], [*base[:-1], "two"], [*base[:-1], "three"])]
        sets = shingler.sets(pa.array(three, pa.large_string()))
        prefixes = [x[: prefix_length(len(x))].tolist() for x in sets]
        if prefixes[0] == prefixes[1] == prefixes[2]:
            rows += [(len(rows) + k, x) for k, x in enumerate(three)]
            last = prefixes[0][-1]
    grams = (" ".join(base[i : i + 5]) for i in range(14))
    own = next(g for g in grams if shingler.sets(pa.array([g], pa.large_string()))[0][0] == np.uint64(last))
    return [*rows, (len(rows), own)]
