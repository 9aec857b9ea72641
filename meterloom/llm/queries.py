"""The operators bound to the standard tables, with production parameters."""

from __future__ import annotations

from . import decontaminate, line_dedup, packing, quality, secret_scan, simhash_dedup, substring_dedup, token_files, url_filter, warc
from .common import table

SEQUENCE_TOKENS = 2048
#: Contracts fix these: shingles of four words and four bits for op2, windows of ten words for op9.
SHINGLE, BITS, WINDOW = 4, 4, 10


def tokenizer_path() -> str:
    """The tokenizer file, by the installed library's own lookup."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_simhash_components(spark, sf_dir):
    return simhash_dedup.digest(simhash_dedup.simhash_components(table(spark, sf_dir, "documents"), SHINGLE, BITS))


def op3_pack_sequences(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def op4_line_dedup(spark, sf_dir):
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark, sf_dir):
    return quality.digest(quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op6_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_secret_scan(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op8_warc_round_trip(spark, sf_dir):
    return warc.digest(warc.warc_round_trip(table(spark, sf_dir, "pages")))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.digest(decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW))


def op10_url_filter(spark, sf_dir):
    return url_filter.digest(url_filter.filter_urls(table(spark, sf_dir, "pages")))


def queries():
    return {f.__name__: f for f in (op1_substring_dedup, op2_simhash_components, op3_pack_sequences, op4_line_dedup, op5_quality_rules, op6_token_files, op7_secret_scan, op8_warc_round_trip, op9_decontaminate, op10_url_filter)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP1 = f"""
with a as (select doc_id, text, regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+') as raw from documents where text is not null),
b as (select doc_id, text, raw, list_transform(raw, lambda r: regexp_replace(translate(trim(r, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\\[-`{{-~]', '', 'g')) as w from a),
p as (select doc_id, k, array_to_string(w[k : k + {substring_dedup.LEAST_WORDS} - 1], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - {substring_dedup.LEAST_WORDS} + 2)) as k from b)),
r as (select doc_id, k, row_number() over (partition by g order by doc_id, k) as n from p),
gone as (select distinct doc_id, unnest(range(k, k + {substring_dedup.LEAST_WORDS})) as i from r where n > 1),
x as (select doc_id, raw[i] as piece, length(regexp_extract(raw[i], '^[\\x20\\x09-\\x0D]*')) as gap, i from (select doc_id, raw, unnest(range(1, len(raw) + 1)) as i from b)),
y as (select x.*, gone.i is not null as out, sum(length(piece)) over (partition by doc_id order by x.i) as stop from x left join gone using (doc_id, i)),
z as (select *, out and not coalesce(lag(out) over (partition by doc_id order by i), false) as opens, out and not coalesce(lead(out) over (partition by doc_id order by i), false) as closes from y),
s as (select *, sum(cast(opens as int)) over (partition by doc_id order by i) as run from z),
spans as (select doc_id, run, cast(min(stop - length(piece) + gap) as bigint) as a, cast(max(stop) as bigint) as b from s where out group by 1, 2),
t as (select doc_id, count(*) as n_removed, string_agg(a || ':' || b, ',' order by a) as removed from spans group by 1),
kept as (select doc_id, string_agg(case when not out then piece when opens then left(piece, gap) else '' end, '' order by i) as kept, max(stop) as stop from s group by 1)
select documents.doc_id, case when t.doc_id is null then text else kept || substr(text, cast(stop as bigint) + 1) end as text, coalesce(n_removed, 0) as n_removed, coalesce(removed, '') as removed
from documents left join t using (doc_id) left join kept using (doc_id)"""

_OP8 = f"""
with p as (select page_id, coalesce(html, '') as h from pages),
f as (select page_id, h, strlen(h) as n, min(page_id) over (partition by h) as least from p)
select page_id, cast(n as bigint) as payload_bytes, sha256(h) as payload_digest, case when n >= {warc.LEAST_REVISIT} and page_id > least then 'revisit' else 'response' end as record_type,
  case when n >= {warc.LEAST_REVISIT} and page_id > least then least end as refers_to from f"""

_OP9 = f"""
with i as (select item_id, {_WORDS} as w from benchmark),
v as (select distinct item_id, least({WINDOW}, len(w)) as n, array_to_string(w[k : k + least({WINDOW}, len(w)) - 1], ' ') as g from (select *, unnest(range(1, greatest(1, len(w) - {WINDOW} + 1) + 1)) as k from i where len(w) > 0)),
d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from v))),
h as (select doc_id, k, n, item_id from g join v using (n, g)),
words as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(k, k + n)) as x from h) group by 1),
items as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as s from (select distinct doc_id, cast(item_id as varchar) as x from h) group by 1)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)"""


def oracle_sql():
    """SQL of the operators that it can express."""
    return {"op1_substring_dedup": _OP1, "op8_warc_round_trip": _OP8, "op9_decontaminate": _OP9}
