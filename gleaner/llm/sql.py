"""DuckDB SQL for the training-data queries that SQL can express.

Look-alike text, shared spans, packing, replication and bisection have none; their tests compare them
with brute force, exact round trips or their definitions.
"""

from __future__ import annotations

from gleaner.functions.text import PLAIN, WIDE


def folded(name: str) -> str:
    """A name without regard to case, width or outer blanks."""
    plain = PLAIN.replace("'", "''")
    return f"lower(regexp_replace(nfc_normalize(translate({name}, '{WIDE}', '{plain}')), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'))"


MARKS = """m as (select id, snap, split, in_probe, in_greedy_subset from selection where keep union all select id, 3, split, in_probe, in_greedy_subset from utt_index),
 k as (select id, snap, split, 'probe' as kind, coalesce(in_probe, false) as marked from m union all select id, snap, split, 'greedy', coalesce(in_greedy_subset, false) from m)"""
SAMPLED = """s as (select * from k where (kind = 'probe' and split = 'train') or (kind = 'greedy' and split in ('dev', 'eval'))),
 a as (select id, kind, min(snap) as batch from s group by id, kind),
 r as (select *, row_number() over (partition by kind, batch order by sha256('frozen' || id), id) as rank, count(*) over (partition by kind, batch) as size from a),
 f as (select id, kind, batch from r where rank <= case kind when 'probe' then (size + 49) // 50 else (size + 9) // 10 end)"""
NAME = "case when contains(id, '/') then regexp_extract(id, '^[^/]*/(.*)$', 1) else id end"
RECORDING = f"""case when length(media_key) > 0 then media_key when regexp_matches({NAME}, '^JA_.*_W') then regexp_extract({NAME}, '^JA_(.*)_W', 1)
 when contains({NAME}, '/') then regexp_extract({NAME}, '^(.*)/', 1) when contains({NAME}, '_') then regexp_extract({NAME}, '^(.*)_', 1) else {NAME} end"""

SQL: dict[str, str] = {
    "p3_found": f"""with {MARKS}, g as (select id, kind, snap, bool_or(marked) as marked from k group by id, kind, snap)
 select a.id, a.kind, a.snap from g a where not a.marked and exists (select 1 from g b where b.id = a.id and b.kind = a.kind and b.snap < a.snap and b.marked)""",
    "p3_sample": f"with {MARKS}, {SAMPLED} select id, kind, batch from f",
    "p3_continued": f"""with {MARKS}, {SAMPLED} select id, kind, 'new' as origin from f where batch = 3
 union all select distinct id, kind, 'frozen' from s where snap = 3 and (id, kind) in (select (id, kind) from s where snap < 3 and marked)""",
    "p3_drift": f"""with {MARKS}, {SAMPLED}, d as (select distinct id, kind, true as is_marked from s where marked)
 select a.kind, a.batch, count(*) as n_members, count(f.id) as n_sample, count(is_marked) as n_marked, count(*) filter (f.id is not null and is_marked) as n_both
 from a left join f on f.id = a.id and f.kind = a.kind and f.batch = a.batch left join d on d.id = a.id and d.kind = a.kind group by a.kind, a.batch""",
    "p4_found": f"""with recursive u as (select distinct id, split, {RECORDING} as rec from utt_index where id is not null and split in ('train', 'dev', 'eval')),
 c as (select media_key as rec, {folded('channel')} as channel, reupload_of from recording where media_key is not null),
 e as (select rec, 'r:' || rec as entity from c union select rec, 'r:' || reupload_of from c where length(reupload_of) > 0 union select rec, 'c:' || channel from c where channel is not null and channel not in ('', '-', 'unknown', 'n/a', '不明')),
 t(rec) as (select distinct rec from u where split = 'train' union select e2.rec from t join e e1 on e1.rec = t.rec join e e2 on e2.entity = e1.entity)
 select id from u where split != 'train' and rec in (select rec from t)""",
    "p6_found": f"""with d as (select {folded('source')} as folded, sum(n_chars) as size from documents group by 1), m as (select mix_target.*, coalesce(size, 0) as size from mix_target left join d on d.folded = {folded('mix_target.source')})
 select source from m where max_repeats is not null and max_repeats * size < target_share * (select sum(size) from m)""",
    "p7_found": """select doc_id from documents where text is not null and list_max(list_transform(regexp_split_to_array(regexp_replace(text, '\\.([\\s\\x0b\\x{85}\\p{Z}]|$)', chr(10) || '\\1', 'g'), '[\\n\\x0b\\f\\r\\x{85}\\x{2028}\\x{2029}。！？｡!?]'), lambda x: length(x))) > 1200 group by doc_id""",
}
