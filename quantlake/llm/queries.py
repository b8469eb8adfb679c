"""Queries opN_<name> over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.llm import decontaminate, jaccard, language, licenses, packing, quality, repeats, secrets, token_counts, token_file
from quantlake.llm.runtime import table


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).withColumn("cleaned_sha256", F.sha2(F.col("cleaned").cast("binary"), 256)).drop("cleaned")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.round_trip(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_quality, op2_token_counts, op3_token_file, op4_best_fit_packing, op5_license_scan, op6_repeated_spans, op7_decontamination, op8_secret_scan, op9_language_id, op10_ngram_jaccard)
}

#: Words of op7 and op10 in DuckDB: its regular expressions read bytes over 0x7F as the characters they are.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

_OP7 = f"""
with d as (select doc_id, {_ALNUM} as w from documents), b as (select item_id::varchar as item, {_ALNUM} as w from benchmark),
win as (select distinct item, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as gram from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
own as (select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as gram from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from d, (select distinct size from win) where len(w) >= size)),
hits as materialized (select distinct doc_id, i, o.size, item from own o join win using (size, gram)),
marked as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + size)) as p from (select distinct doc_id, i, size from hits)) group by 1),
pos as materialized (select doc_id, i as p, w[i] as w from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d)),
bw as (select *, row_number() over () as id from (select item, w[i:i + least(len(w), 10) - 1] as w from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0))),
wt as materialized (select id, t as w, k, coalesce(n, 0) as n from (select id, t, min(k) as k from (select id, unnest(w) as t, generate_subscripts(w, 1) as k from bw) group by 1, 2) x left join (select w as t, count(*) as n from pos group by 1) c using (t)),
rare as (select id, arg_min(w, n * 16 + k) as w, count(*) as terms from wt group by 1),
close as (select c.doc_id, c.id, c.p from (select doc_id, id, p, terms from rare join pos using (w)) c join wt on wt.id = c.id join pos q on q.doc_id = c.doc_id and q.w = wt.w and q.p between c.p - 15 and c.p + 15 group by c.doc_id, c.id, c.p, c.terms having count(distinct wt.w) = c.terms),
nears as (select doc_id, count(distinct id) as n from close group by 1),
items as (select doc_id, count(distinct item) as n, array_to_string(list_sort(list_distinct(list(item))), ',') as names from hits group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(m.n, 0)::bigint as n_hit, coalesce(x.n, 0)::bigint as n_items, sha256(coalesce(x.names, '')) as items_sha256, coalesce(m.n, 0) > 0 as contaminated, coalesce(y.n, 0)::bigint as n_near
from d left join marked m using (doc_id) left join items x using (doc_id) left join nears y using (doc_id)"""

_OP10 = f"""
with recursive d as (select doc_id, {_SPACED} as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as gram from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by 1),
links as materialized (select a.doc_id as x, b.doc_id as y from s a join s b using (gram) join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id where a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reach(x, y) as (select doc_id, doc_id from d union select r.x, l.y from reach r join links l on l.x = r.y)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id from d left join n using (doc_id) join (select x as doc_id, min(y) as component_id from reach group by 1) c using (doc_id)"""

_RULES = quality.Rules()
_WORD = r"'[^\x20\x09-\x0D]+'"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_OP1 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, {_WORD}) as w from d),
l as (select doc_id, i, line, regexp_extract_all(line, {_WORD}) as w, len(regexp_extract_all(line, {_quoted(quality.GLUE)})) as glue from (select doc_id, unnest(string_split(t, chr(10))) as line, unnest(range(len(string_split(t, chr(10))))) as i from d)),
judged as (select doc_id, i, line, len(w) as n, case when len(w) = 0 then 0
    when len(list_filter(w, lambda x: regexp_matches(x, {_quoted(quality.SEPARATOR_WORD)}))) >= greatest(2, {_RULES.separators_per_word} * len(w)) or (glue >= 2 and len(w) <= {_RULES.words_per_item} * (glue + 1)) or regexp_matches(line, {_quoted(quality.MENU)}) then 1
    when len(regexp_extract_all(line, {_quoted(quality.SYMBOL)})) > {_RULES.symbols_per_word} * len(w) then 2
    when len(w) < {_RULES.boilerplate_words} and regexp_matches(line, {_quoted("(?i)" + quality.BOILERPLATE)}) then 3
    when not regexp_matches(line, {_quoted(quality.END_MARK)}) and (len(w) < {_RULES.short_line} or (len(w) >= {_RULES.long_line} and len(regexp_extract_all(line, {_quoted(quality.MARK)})) * {_RULES.words_per_mark} < len(w) and not regexp_matches(line, {_quoted(quality.LIST_ITEM)}))) then 4 else 0 end as rule from l),
lines as (select doc_id, count(*) filter (where n > 0) as n_lines, count(*) filter (where n > 0) - count(distinct line) filter (where n > 0) as dup, coalesce(sum(n) filter (where rule > 0), 0) as lost,
    {", ".join(f"count(*) filter (where rule = {k}) as n_lines_{r}" for k, r in enumerate(quality.RULES, 1))}, coalesce(string_agg(line, chr(10) order by i) filter (where rule = 0), '') as cleaned from judged group by 1),
grams as (select doc_id, i, array_to_string(w[i:i + 2], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
again as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1) group by 1),
x as (select w.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols, dup::bigint as n_dup_lines,
    coalesce(again.n, 0)::bigint as n_repeat_words, n_lines::bigint as n_lines, ({" + ".join(f"n_lines_{r}" for r in quality.RULES)})::bigint as n_lines_removed, lost::bigint as words_removed,
    {", ".join(f"n_lines_{r}::bigint as n_lines_{r}" for r in quality.RULES)}, sha256(cleaned) as cleaned_sha256 from w left join lines using (doc_id) left join again using (doc_id))
select *, n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words as base_failed,
    not (n_words < {_RULES.min_words} or 100 * n_repeat_words > {_RULES.max_repeat_percent} * n_words) and words_removed <= {_RULES.max_lost} * n_words as kept from x"""

_TEMPLATES = ", ".join(f"({t}, '{label}', {k}, string_split('{text}', ' '))" for t, (text, label, k) in enumerate(licenses.TEMPLATES))

_OP5 = f"""
with d as (select doc_id, {_ALNUM} as w from documents), t as (select * from (values {_TEMPLATES}) v(template, label, k, w)),
tg as (select template, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select template, k, w, unnest(range(1, len(w) - k + 2)) as i from t)),
dg as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from t) where len(w) >= k)),
hits as materialized (select doc_id, template, dg.i - tg.i as diagonal, dg.i - 1 as place, tg.i as own from dg join tg using (k, g)),
votes as (select distinct doc_id, template, diagonal from hits),
marked as (select v.*, label, k, len(w) as size, len(w) - k + 1 as grams, case when k = {licenses.PHRASE_GRAM} or diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) <= {licenses.NEAR} is not true then 1 else 0 end as far from votes v join t using (template)),
islands as (select *, sum(far) over (partition by doc_id, template order by diagonal) as island from marked),
found as (select *, covered::double / grams as share, k = {licenses.PHRASE_GRAM} and covered = grams as base, k <> {licenses.PHRASE_GRAM} and covered::double / grams >= {licenses.COVERED} and last - first < {licenses.STRETCH} * size as likely
    from (select doc_id, template, label, k, size, grams, count(distinct own) as covered, min(place) as first, max(place) as last from islands join hits using (doc_id, template, diagonal) group by doc_id, template, label, k, size, grams, island)),
apart as (select *, case when first <= max(last) over (partition by doc_id, likely order by first, last, template rows between unbounded preceding and 1 preceding) then 0 else 1 end as apart from found),
placed as (select *, sum(apart) over (partition by doc_id, likely order by first, last, template rows between unbounded preceding and current row) as place from apart),
judged as (select *, likely and share = max(share) over (partition by doc_id, likely, place) as added from placed)
select d.doc_id, len(any_value(w))::bigint as n_words, count(*) filter (where base) as n_base, (min(first) filter (where base))::bigint as first_word, (max(first) filter (where base))::bigint as last_word,
    coalesce(array_to_string(list_sort(list_distinct(list(label) filter (where base))), ','), '') as base_labels, coalesce(array_to_string(list_sort(list_distinct(list(label) filter (where base or added))), ','), '') as labels,
    coalesce(max(share), 0) as score from d left join judged using (doc_id) group by d.doc_id"""

#: Each 100-byte string as ten whole numbers of ten bytes, so that strings are compared byte by byte.
_PACK = lambda n: " + ".join(f"(coalesce(lead(b, {k}) over w, 0)::hugeint << {8 * k})" for k in range(n))
_OP6 = f"""
with d as (select doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as h from documents),
byte as materialized (select doc_id, h, i, (strpos('0123456789ABCDEF', h[1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2]) - 1 as b from (select doc_id, unnest(h) as h, unnest(range(len(h))) as i from d)),
packed as (select doc_id, i, {_PACK(10)} as p, count(*) over (partition by doc_id) as size from byte window w as (partition by doc_id order by i)),
string as (select doc_id, i, size, {", ".join(f"lead(p, {10 * k}) over w as p{k}" for k in range(10))} from packed window w as (partition by doc_id order by i)),
placed as (select doc_id, i, row_number() over (partition by {", ".join(f"p{k}" for k in range(10))} order by doc_id, i) as k from string where i + {repeats.LENGTH} <= size),
edge as (select doc_id, i, sum(s) as s from (select doc_id, i, 1 as s from placed where k > 1 union all select doc_id, i + {repeats.LENGTH}, -1 from placed where k > 1) group by 1, 2),
state as (select b.doc_id, b.i, h, sum(coalesce(s, 0)) over (partition by b.doc_id order by b.i) > 0 as gone from byte b left join edge e on e.doc_id = b.doc_id and e.i = b.i),
runs as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) as opens from state),
total as (select doc_id, count(*) as n_bytes, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans, coalesce(string_agg(h, '' order by i) filter (where not gone), '') as kept from runs group by 1)
select d.doc_id, coalesce(n_bytes, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join total using (doc_id)"""

_N = language.PROFILE
_OP9 = rf"""
with crc as materialized (select list(c order by k) as t from (select k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as k))),
d as materialized (select doc_id, lang, text, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 1, false) as held_out from documents, crc),
w as materialized (select doc_id, word, count(*) as n from (select doc_id, unnest(string_split(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), ' ')) as word from d where text is not null) where word <> '' group by 1, 2),
u as (select word, list_transform(string_split(' ' || word || ' ', ''), lambda c: unicode(c)::bigint) as u from (select distinct word from w)),
g as materialized (select word, code, count(*) as m from (
    select word, unnest(u[2:-2]) as code from u union all select word, unnest(list_transform(range(1, len(u)), lambda i: (u[i] << 21) | u[i + 1])) from u
    union all select word, unnest(list_transform(range(1, len(u) - 1), lambda i: (u[i] << 42) | (u[i + 1] << 21) | u[i + 2])) from u) group by 1, 2),
own as materialized (select * from (select doc_id, code, row_number() over (partition by doc_id order by sum(n * m) desc, code) - 1 as rank from w join g using (word) group by doc_id, code) where rank < {_N}),
profile as materialized (select * from (select lang, code, row_number() over (partition by lang order by sum(n * m) desc, code) - 1 as rank from w join g using (word) join d using (doc_id) where lang is not null and not held_out group by lang, code) where rank < {_N}),
far as (select doc_id, l.lang, sum(coalesce(least(abs(own.rank - p.rank), {_N}), {_N})) as far, count(*) as n from own cross join (select distinct lang from profile) l left join profile p on p.lang = l.lang and p.code = own.code group by 1, 2),
best as (select doc_id, lang, 1 - far::double / ({_N} * n) as score from (select *, row_number() over (partition by doc_id order by far, lang) as k from far) where k = 1)
select d.doc_id, d.held_out, coalesce(b.lang, 'und') as lang_pred, coalesce(b.score, 0) as score from d left join best b using (doc_id)"""

_SECRETS = secrets.Rules()
_CANDIDATE = f"[A-Za-z0-9+/_=-]{{{_SECRETS.window},}}"


def _located(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = _quoted(pattern)
    return f"""select doc_id, {rank} as rank, '{kind}' as kind, start, start + length(v) as stop, v from (select doc_id, v, part, sum(length(piece) + length(v)) over (partition by doc_id order by k) - length(v) as start
        from (select doc_id, unnest(found) as v, unnest(own) as part, unnest(pieces[:len(found)]) as piece, unnest(range(len(found))) as k from (select doc_id, regexp_extract_all(t, {p}) as found, regexp_extract_all(t, {p}, {group}) as own, string_split_regex(t, {p}) as pieces
            from d where regexp_matches(t, {p})))) where length(part) >= {least}"""


def _plain(pattern: str) -> str:
    """Without possessive repeats, which a matcher that never backtracks does not need."""
    return pattern.replace("*+", "*").replace("++", "+")


#: The first entry of the allow list, one character over and over, needs no pattern.
_ALLOWED = " or ".join(["replace(v, v[1], '') = ''", *(f"regexp_full_match(v, {_quoted(_plain(x))})" for x in _SECRETS.allow[1:])])
_OP8 = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
base as materialized ({" union all ".join(_located(k, *rule) for k, rule in enumerate(secrets.BASE))}),
candidate as materialized (select *, case when regexp_full_match(v, '[0-9a-f]+|[0-9A-F]+') then {_SECRETS.hex_bits} when regexp_full_match(v, '[A-Za-z0-9]+') then {_SECRETS.alnum_bits} else {_SECRETS.key_bits} end as bits from ({_located(len(secrets.BASE), "entropy", _CANDIDATE, 0, 0)})
    where regexp_matches(v, '[a-z]')::int + regexp_matches(v, '[A-Z]')::int + regexp_matches(v, '[0-9]')::int >= {_SECRETS.kinds} and not ({_ALLOWED})),
char as (select doc_id, start, i, unnest(string_split(v[i + 1:i + {_SECRETS.window}], '')) as c from (select doc_id, start, v, unnest(range(length(v) - {_SECRETS.window - 1})) as i from candidate)),
entropy as (select doc_id, start, max(h) as h from (select doc_id, start, i, log2({_SECRETS.window}) - sum(n * log2(n)) / {_SECRETS.window} as h from (select doc_id, start, i, c, count(*) as n from char group by all) group by 1, 2, 3) group by 1, 2),
span as (select doc_id, rank, kind, start, stop from base union all select c.doc_id, rank, kind, c.start, stop from candidate c join entropy e on e.doc_id = c.doc_id and e.start = c.start where h >= bits),
found as (select doc_id, {", ".join(f"count(*) filter (where rank = {k}) as n_{rule[0]}" for k, rule in enumerate(secrets.BASE))}, coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (where rank < {len(secrets.BASE)}), '') as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans from span group by 1)
select d.doc_id, {", ".join(f"coalesce(n_{rule[0]}, 0) as n_{rule[0]}" for rule in secrets.BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join found using (doc_id)"""

#: Tokens and packing are tested against the tokenizer itself and brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op1_line_quality": _OP1, "op5_license_scan": _OP5, "op6_repeated_spans": _OP6, "op7_decontamination": _OP7, "op8_secret_scan": _OP8, "op9_language_id": _OP9, "op10_ngram_jaccard": _OP10
}
