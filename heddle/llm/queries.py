"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, fingerprint, langid, licenses, linededup, lm, packing, shards, simhash
from .common import LOWER, UPPER

QUERIES = {
    "op1_fingerprints": fingerprint.op1_fingerprints,
    "op2_simhash": simhash.op2_simhash,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_language_id": langid.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_lm_scores": lm.op8_lm_scores,
    "op9_sharding": shards.op9_sharding,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP3 = f"""
with d as (select doc_id, {_WORDS} as w from documents),
i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
win as (select distinct item, array_to_string(w[k:k + {decontaminate.WINDOW - 1}], ' ') as s, least(len(w), {decontaminate.WINDOW}) as size from i, range(1, greatest(len(w) - {decontaminate.WINDOW - 2}, 2)) as t(k) where len(w) > 0),
place as (select doc_id, k, size, array_to_string(w[k:k + size - 1], ' ') as s from d, (select distinct size from win), range(1, len(w) - size + 2) as t(k)),
hit as (select place.doc_id, place.k, place.size, win.item from place join win on place.s = win.s and place.size = win.size),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hit) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n on d.doc_id = n.doc_id left join it on d.doc_id = it.doc_id"""


def _op6() -> str:
    """Every vote's diagonal starts a band; the votes within the drift from it are counted by template position."""
    rows = []
    for tid, (text, label, base) in enumerate([(*p, "true") for p in licenses.PHRASES] + [(*t, "false") for t in licenses.TEMPLATES]):
        w = text.split()
        grams = [" ".join(w[i : i + licenses.K]) for i in range(len(w) - licenses.K + 1)]
        far = 0 if base == "true" else licenses.drift(len(w))
        rows += [f"('{g}', {i}, {tid}, '{label}', {base}, {len(grams)}, {far})" for i, g in enumerate(grams)]
    return f"""
with t(gram, tpos, tid, label, base, grams, drift) as (values {', '.join(rows)}),
d as (select doc_id, {_WORDS} as w from documents),
g as (select doc_id, k - 1 as pos, array_to_string(w[k:k + {licenses.K - 1}], ' ') as gram from d, range(1, len(w) - {licenses.K - 2}) as r(k)),
v as (select doc_id, tid, label, base, grams, drift, tpos, pos - tpos as diagonal from g join t on g.gram = t.gram),
s as (select doc_id, tid, label, base, grams, diagonal as start_, drift from v group by all),
h as (select s.doc_id, s.tid, s.label, s.base, s.start_, count(distinct v.tpos) / cast(s.grams as double) as hit from s join v on s.doc_id = v.doc_id and s.tid = v.tid and v.diagonal between s.start_ and s.start_ + s.drift group by s.doc_id, s.tid, s.label, s.base, s.start_, s.grams),
o as (select *, hit >= case when base then 1.0 else {licenses.SHARE} end as ok from h),
a as (select doc_id, count(*) filter (ok and base) as n_base, min(start_) filter (ok and base) as first_word, max(start_) filter (ok and base) as last_word,
  max(hit) filter (ok or not base) as score from o group by 1),
b as (select doc_id, string_agg(label, ',' order by label) as base_labels from (select distinct doc_id, label from o where ok and base) group by 1),
l as (select doc_id, string_agg(label, ',' order by label) as labels from (select distinct doc_id, label from o where ok) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from d left join a on d.doc_id = a.doc_id left join b on d.doc_id = b.doc_id left join l on d.doc_id = l.doc_id"""


_OP7 = f"""
with l as (select doc_id, k - 1 as pos, s[k] as line, len(regexp_extract_all(s[k], '[^\\x20\\x09-\\x0D]+')) as w from (select doc_id, string_split(text, chr(10)) as s from documents where text is not null), range(1, len(s) + 1) as t(k)),
c as (select *, sum(w) over (partition by doc_id order by pos) as c1 from l),
fore as (select a.doc_id, a.pos, min(b.pos) as e from c a join c b on a.doc_id = b.doc_id and b.pos >= a.pos and b.c1 >= a.c1 - a.w + {linededup.MIN_WORDS} group by 1, 2),
back as (select b.doc_id, max(a.pos) as pos, b.pos as e from c a join c b on a.doc_id = b.doc_id and a.pos <= b.pos and a.c1 - a.w <= b.c1 - {linededup.MIN_WORDS} group by b.doc_id, b.pos),
win as (select doc_id, pos, e from fore union select doc_id, pos, e from back),
body as (select win.doc_id, win.pos, win.e, string_agg(c.line, chr(10) order by c.pos) as lines from win join c on win.doc_id = c.doc_id and c.pos between win.pos and win.e group by 1, 2, 3),
ranked as (select *, row_number() over (partition by lines, e - pos order by doc_id, pos) as n from body),
gone as (select distinct doc_id, unnest(range(pos, e + 1)) as pos from ranked where n > 1),
runs as (select doc_id, min(pos) as a, max(pos) as b from (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as island from gone) group by doc_id, island),
told as (select doc_id, string_agg(a || '-' || b, ',' order by a) as deleted_runs from runs group by 1),
left_ as (select c.doc_id, count(*) as n_lines, count(gone.pos) as n_deleted, coalesce(any_value(told.deleted_runs), '') as deleted_runs, coalesce(string_agg(c.line, chr(10) order by c.pos) filter (gone.pos is null), '') as text
from c left join gone on c.doc_id = gone.doc_id and c.pos = gone.pos left join told on c.doc_id = told.doc_id group by c.doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted, coalesce(deleted_runs, '') as deleted_runs, left_.text as text from (select doc_id from documents) left join left_ using (doc_id)"""

ORACLE_SQL = {"op3_decontamination": _OP3, "op6_license_scan": _op6(), "op7_line_dedup": _OP7}
