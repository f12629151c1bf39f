"""Texts compared character by character: normal forms, edits by kind and style, error regions, resampled rates.

In the SQL the edit-distance table is a fold over the characters of one text, and walking back through
it is another; both follow the same preferences among equally cheap alignments as the operators.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from gleaner.functions import scoring
from gleaner.operators import statistics as st
from gleaner.plans.fragments import distance_sql
from gleaner.plans.registry import Registry
from gleaner.plans.selection import JUDGED, UTT, judged, utterances
from gleaner.session import materialise

query = Registry()


def _compatible() -> tuple[str, str]:
    """Every character with a compatibility mapping, and its full decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F260))]
    pairs = [(c, d) for c, d in pairs if d != unicodedata.normalize("NFD", c) and "'" not in d]
    return "\x01".join(c for c, _ in pairs), "\x01".join(d for _, d in pairs)


MAPPED, TO = _compatible()


def normal_sql(texts: str) -> str:
    """CTEs ending in ``nf(key, text)``: the normal form of each ``key, text`` of a relation."""
    return rf"""km as (select unnest(string_split('{MAPPED}', chr(1))) as c, unnest(string_split('{TO}', chr(1))) as d),
 tx as (select * from {texts}), ch as (select key, unnest(list_filter(string_split(text, ''), lambda c: c != '')) as c, generate_subscripts(list_filter(string_split(text, ''), lambda c: c != ''), 1) as pos from tx),
 cd as (select key, string_agg(coalesce(d, c), '' order by pos) as text from ch left join km using (c) group by key),
 nf as (select tx.key, regexp_replace(lower(nfc_normalize(coalesce(cd.text, ''))), '[^\p{{L}}\p{{N}}_]', '', 'g') as text from tx left join cd using (key))"""


def table_sql(r: str, h: str) -> str:
    """The edit-distance table of two texts, a row for each character of ``h`` and one before them."""
    inner = f"list_reduce(range(1, length({r}) + 1), lambda acc, j: list_append(acc, least(t[-1][j + 1] + 1, acc[-1] + 1, t[-1][j] + (substr({r}, j, 1) != c)::bigint)), [t[-1][1] + 1])"
    return f"list_reduce(list_filter(string_split({h}, ''), lambda c: c != ''), lambda t, c: list_append(t, {inner}), [range(0, length({r}) + 1)])"


PAIRED = f"""(select id || chr(1) || 'r' as key, coalesce(ref, '') as text from {UTT} union all select id || chr(1) || 'h', coalesce(hyp, '') from {UTT})"""
# r, h: normal forms of both texts of an utterance; e: the cheapest alignment's steps from the end, with places from 1.
SCORED_SQL = f"""with {normal_sql(PAIRED)}, rh as (select split_part(key, chr(1), 1) as id, max(text) filter (key like '%' || chr(1) || 'r') as r, max(text) filter (key like '%' || chr(1) || 'h') as h from nf group by 1)"""
BACK = """list_reduce(range(0, length(r) + length(h)), lambda s, x: case
 when s.i > 0 and s.j > 0 and t[s.j + 1][s.i + 1] > t[s.j + 1][s.i] then {'i': s.i - 1, 'j': s.j, 'steps': list_append(s.steps, {'k': 'd', 'i': s.i, 'j': s.j})}
 when s.i > 0 and s.j > 0 and t[s.j + 1][s.i + 1] > t[s.j][s.i + 1] then {'i': s.i, 'j': s.j - 1, 'steps': list_append(s.steps, {'k': 'i', 'i': s.i, 'j': s.j})}
 when s.i > 0 and s.j > 0 then {'i': s.i - 1, 'j': s.j - 1, 'steps': list_append(s.steps, {'k': case when substr(r, s.i, 1) = substr(h, s.j, 1) then '=' else 's' end, 'i': s.i, 'j': s.j})}
 when s.i > 0 then {'i': s.i - 1, 'j': s.j, 'steps': list_append(s.steps, {'k': 'd', 'i': s.i, 'j': s.j})}
 when s.j > 0 then {'i': s.i, 'j': s.j - 1, 'steps': list_append(s.steps, {'k': 'i', 'i': s.i, 'j': s.j})}
 else s end, {'i': length(r), 'j': length(h), 'steps': [{'k': '', 'i': 0::bigint, 'j': 0::bigint}]}).steps[2:]"""
STEPS_SQL = SCORED_SQL + f""", dt as (select id, r, h, {table_sql('r', 'h')} as t from rh where r != h), e as (select id, r, h, {BACK} as steps from dt),
 n as (select rh.id, length(rh.r) as ref_len, length(rh.h) as hyp_len, coalesce(len(list_filter(steps, lambda x: x.k = 's')), 0) as sub, coalesce(len(list_filter(steps, lambda x: x.k = 'd')), 0) as del, coalesce(len(list_filter(steps, lambda x: x.k = 'i')), 0) as ins from rh left join e using (id))"""
KATA = "".join(map(chr, range(0x30A1, 0x30F7)))
HIRA = "".join(map(chr, range(0x3041, 0x3097)))
HAN_SQL, KANA_SQL = "一-鿿㐀-䶿々〆〇豈-﫿\\x{20000}-\\x{10ffff}", "ぁ-ゟ゠-ヿㇰ-ㇿ"


def _only(text: str, chars: str) -> str:
    return f"regexp_matches({text}, '^[{chars}]+$')"


def _has(text: str, chars: str) -> str:
    return f"regexp_matches({text}, '[{chars}]')"


KIND_SQL = f"""case when a = '' then 'insertion' when b = '' then 'deletion' when {_has('a || b', '0-9')} then 'numeral'
 when ({_only('a', scoring.NUMERAL_KANJI)} or {_only('b', scoring.NUMERAL_KANJI)}) and ({_only('a', HAN_SQL)} or {_only('b', HAN_SQL)}) then 'numeral' when {_has('a || b', 'a-z')} then 'latin'
 when translate(a, '{KATA}', '{HIRA}') = translate(b, '{KATA}', '{HIRA}') then 'hira<->kata' when {_only('a', KANA_SQL)} and {_only('b', KANA_SQL)} and {_has('a', '゠-ヿㇰ-ㇿ')} != {_has('b', '゠-ヿㇰ-ㇿ')} then 'kana-other'
 when {_has('a', HAN_SQL)} and {_only('b', KANA_SQL)} then 'kanji->kana' when {_only('a', KANA_SQL)} and {_has('b', HAN_SQL)} then 'kana->kanji'
 when {_only('a', HAN_SQL)} and {_only('b', HAN_SQL)} then case when length(a) = length(b) then 'kanji->kanji' else 'kanji->kanji(len)' end
 when {_only('a || b', 'ぁ-ゟ')} then 'hira->hira' when {_only('a || b', '゠-ヿㇰ-ㇿ')} then 'kata->kata' when {_has('a', HAN_SQL)} and {_has('b', HAN_SQL)} then 'mixed-kanji' else 'other' end"""
REGIONS_SQL = STEPS_SQL + f""", st as (select id, r, h, unnest(steps) as x, generate_subscripts(steps, 1) as back from e where r != ''), mk as (select *, sum(case when x.k = '=' then 1 else 0 end) over (partition by id order by back desc) as g from st),
 rg as (select id, g, coalesce(string_agg(substr(r, x.i, 1), '' order by back desc) filter (x.k != 'i'), '') as a, coalesce(string_agg(substr(h, x.j, 1), '' order by back desc) filter (x.k != 'd'), '') as b, count(*) as edits from mk where x.k != '=' group by id, g),
 kd as (select id, edits, {KIND_SQL} as kind from rg),
 sy as (select id, sum(edits) filter (kind in ('numeral', 'hira<->kata', 'kanji->kana', 'kana->kanji', 'kana-other')) as edits_style from kd group by id)"""


def score_table(spark, sf, *columns):
    """One row for each utterance with its edits by kind and style, and its error regions."""
    return scoring.ensure_scores(utterances(spark, sf, "id", "ref", "hyp", *columns))


@query(f"with {normal_sql(f'(select id as key, ref as text from {UTT})')} select key as id, text from nf")
def e01_normal_form(spark, sf):
    """NFKC, lower case, word characters only."""
    return utterances(spark, sf, "id", "ref").select("id", scoring.normalised("ref").alias("text"))


@query(SCORED_SQL + f""", d as (select id, length(r) as ref_len, length(h) as hyp_len, {distance_sql('r', 'h')} as edits from rh)
 select id, cast(ref_len as integer) as ref_len, cast(hyp_len as integer) as hyp_len, cast(edits as integer) as edits, round(case when ref_len = 0 then case when hyp_len = 0 then 0.0 else 1.0 end when hyp_len = 0 then 1.0 else edits / ref_len end, 6) as rate from d""")
def e02_error_rates(spark, sf):
    """Error rate of each utterance, worked out from its texts as it has no scores yet."""
    s = score_table(spark, sf)
    rate = scoring.error_rate(F.col("edits"), F.col("ref_len"), F.col("hyp_len"))
    return s.select("id", "ref_len", "hyp_len", "edits", F.round(rate, 6).alias("rate"))


@query(STEPS_SQL + " select id, cast(sub as integer) as sub, cast(del as integer) as del, cast(ins as integer) as ins, cast(sub + del + ins as integer) as edits from n")
def e03_breakdown(spark, sf):
    """Substitutions, deletions and insertions of each utterance."""
    return score_table(spark, sf).select("id", "sub", "del", "ins", "edits")


@query(REGIONS_SQL + " select id, cast(coalesce(edits_style, 0) as integer) as edits_style, cast(sub + del + ins - coalesce(edits_style, 0) as integer) as edits_nostyle from n left join sy using (id)")
def e04_style_free(spark, sf):
    """Edits without those of regions that only change script or numerals."""
    return score_table(spark, sf).select("id", "edits_style", "edits_nostyle")


@query(REGIONS_SQL + f" select source, kind, count(*) as n, cast(sum(edits) as bigint) as edits from kd join {UTT} u using (id) group by 1, 2")
def e08_region_kinds(spark, sf):
    """Error regions by kind and source."""
    s = scoring.with_scores(utterances(spark, sf, "source", "ref", "hyp")).select("source", F.explode("regions").alias("r"))
    return s.groupBy("source", scoring.region_kind(F.col("r.ref"), F.col("r.hyp")).alias("kind")).agg(F.count("*").alias("n"), F.sum("r.edits").alias("edits"))


@query(REGIONS_SQL + f""", s as (select u.source, n.ref_len, sub + del + ins as edits, sub + del + ins - coalesce(edits_style, 0) as free from n left join sy using (id) join {UTT} u using (id))
 select coalesce(source, 'all') as source, count(*) as n, count(*) filter (ref_len = 0) as n_empty_ref, round(sum(edits) filter (ref_len > 0) / sum(ref_len) filter (ref_len > 0), 6) as rate, round(sum(free) filter (ref_len > 0) / sum(ref_len) filter (ref_len > 0), 6) as rate_nostyle from s group by rollup (source)""")
def a07_corpus_rate(spark, sf):
    """Ratio of sums per set and in all; empty references are counted apart."""
    s = score_table(spark, sf, "source")
    held = F.col("ref_len") > 0
    length = F.sum(F.when(held, F.col("ref_len")))
    out = s.rollup("source").agg(
        F.count("*").alias("n"), F.count_if(~held).alias("n_empty_ref"), st.ratio(F.sum(F.when(held, F.col("edits"))), length).alias("rate"), st.ratio(F.sum(F.when(held, F.col("edits_nostyle"))), length).alias("rate_nostyle")
    )
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


def two_systems(spark, sf):
    """``stratum, id, system, num, den``: edits and lengths of two hypotheses of an utterance, from one pass over both."""
    u = utterances(spark, sf, "id", "source", "ref", "hyp").join(judged(spark, sf, "id", "hyp2"), "id").filter("hyp2 is not null and length(ref) > 0")
    each = F.explode(F.array(F.struct(F.lit("first").alias("system"), F.col("hyp").alias("hyp")), F.struct(F.lit("second").alias("system"), F.col("hyp2").alias("hyp"))))
    s = scoring.with_scores(u.select("id", F.col("source").alias("stratum"), "ref", each.alias("e")).select("id", "stratum", "ref", "e.*"))
    return s.select("stratum", "id", "system", F.col("edits").cast("double").alias("num"), F.col("ref_len").cast("double").alias("den"))


TWO = f"""(select u.id || chr(1) || 'r' as key, ref as text from {UTT} u join {JUDGED} j using (id) where hyp2 is not null and length(ref) > 0 union all select u.id || chr(1) || 'first', coalesce(hyp, '') from {UTT} u join {JUDGED} j using (id) where hyp2 is not null and length(ref) > 0
 union all select u.id || chr(1) || 'second', hyp2 from {UTT} u join {JUDGED} j using (id) where hyp2 is not null and length(ref) > 0)"""


@query(f"""with {normal_sql(TWO)}, w as (select split_part(key, chr(1), 1) as id, split_part(key, chr(1), 2) as system, text from nf), p as (select a.id, a.system, b.text as r, a.text as h from w a join w b on a.id = b.id and b.system = 'r' where a.system != 'r')
 select source as stratum, system, cast(sum({distance_sql('r', 'h')}) as double) as num, cast(sum(length(r)) as double) as den from p join {UTT} u using (id) group by 1, 2""")
def a16_point_sums(spark, sf):
    """Sums of two systems over the rows both have."""
    return st.point_sums(two_systems(spark, sf))


@query()
def a15_bootstrap(spark, sf):
    """Stratified paired bootstrap of two systems, 200 replicates, with run noise for one trained system."""
    scores = materialise(two_systems(spark, sf), "scores")
    return st.compared(st.point_sums(scores), st.resampled_sums(scores, 200), "first", "second", noise=0.01, n_noisy=1)


@query(f"""with u as (select source as stratum, u.id, round(teacher_cer * length(ref)) as a, round(cer2 * length(ref)) as b, length(ref) as den from {UTT} u join {JUDGED} j using (id) where teacher_cer is not null and cer2 is not null and length(ref) > 0),
 k as (select *, row_number() over (partition by stratum order by id) as k from u), n as (select stratum, count(*) as size from u group by stratum),
 d as (select stratum, replicate, cast(('0x' || substr(sha256('draw|' || stratum || '|' || replicate || '|' || i), 1, 12)) as bigint) % size + 1 as k from n, range(0, 20) t(replicate), lateral (select unnest(range(0, size)) as i) r),
 s as (select stratum, replicate, sum(a) as a, sum(b) as b, cast(sum(den) as double) as den from d join k using (stratum, k) group by 1, 2)
 select stratum, cast(replicate as integer) as replicate, system, case system when 'first' then a else b end as num, den from s, (values ('first'), ('second')) v(system)""")
def a15_hashed_draws(spark, sf):
    """Paired draws with replacement within each stratum, as many as it has rows, by hashes alone, on stored rates."""
    u = utterances(spark, sf, "id", "source", "ref", "teacher_cer").join(judged(spark, sf, "id", "cer2"), "id").filter("teacher_cer is not null and cer2 is not null and length(ref) > 0")
    num = lambda c: F.round(F.col(c) * F.length("ref")).cast("double").alias("num")
    each = F.explode(F.array(F.struct(F.lit("first").alias("system"), num("teacher_cer")), F.struct(F.lit("second").alias("system"), num("cer2"))))
    s = u.select(F.col("source").alias("stratum"), "id", F.length("ref").cast("double").alias("den"), each.alias("x")).select("stratum", "id", "den", "x.*")
    return st.hashed_draws(materialise(s, "scores"), 20)


@query("""with d(stratum, replicate, na, nb, den) as (select 's' || (replicate % 3), replicate, 100 + 7 * replicate % 13, 90 + 5 * replicate % 17, 1000 from range(0, 60) t(replicate)),
 s as (select stratum, stddev_samp(ln(na::double / nb)) as sd, sum(na)::double / sum(nb) as ratio from d group by stratum), i as (select stratum, ratio, sqrt(sd * sd + 2 * 0.01 * 0.01) as se from s)
 select stratum, round(ratio, 6) as ratio, round(exp(ln(ratio) - 1.9599640 * se), 6) as low, round(exp(ln(ratio) + 1.9599640 * se), 6) as high, case when exp(ln(ratio) + 1.9599640 * se) < 1 then 'better' when exp(ln(ratio) - 1.9599640 * se) > 1 then 'worse' else 'within' end as verdict from i""")
def a17_ratio_interval(spark, sf):
    """Ratio, interval and verdict from given replicates, with the noise of two trained systems."""
    r = spark.range(60).select(F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("stratum"), F.col("id").cast("int").alias("replicate"), (100 + 7 * F.col("id") % 13).alias("a"), (90 + 5 * F.col("id") % 17).alias("b"))
    long = r.select("stratum", "replicate", F.explode(F.array(F.struct(F.lit("a").alias("system"), F.col("a").cast("double").alias("num")), F.struct(F.lit("b").alias("system"), F.col("b").cast("double").alias("num")))).alias("x")).select("stratum", "replicate", "x.*", F.lit(1000.0).alias("den"))
    return st.compared(st.point_sums(long), long, "a", "b", noise=0.01, n_noisy=2)


PIECES_SQL = f"(select id, ['▁' || substr(ref, 1, 3), '<0xE3>', '<unk>', substr(ref, 4)] as pieces from {UTT} where length(ref) > 3)"


@query(f"""with p as (select id, list_transform(pieces, lambda p: case when regexp_matches(p, '(?s)^<0x.*>$') then '�' when regexp_matches(p, '(?s)^<.*>$') then '' else replace(p, '▁', '') end) as t from {PIECES_SQL})
 select id, array_to_string(t, '') as text, cast(length(t[1]) as integer) as first_end, cast(length(t[1]) + 1 as integer) as byte_end, cast(length(t[1]) + length(t[2]) + length(t[3]) as integer) as last_start, cast(length(array_to_string(t, '')) as integer) as last_end from p""")
def e11_pieces(spark, sf):
    """The text of word pieces, and where each begins and ends in it."""
    u = utterances(spark, sf, "id", "ref").filter("length(ref) > 3").select("id", F.array(F.concat(F.lit("▁"), F.substring("ref", 1, 3)), F.lit("<0xE3>"), F.lit("<unk>"), F.expr("substring(ref, 4)")).alias("pieces"))
    u = u.select("id", F.array_join(F.transform("pieces", scoring.piece_text), "").alias("text"), scoring.piece_spans(F.col("pieces")).alias("s"))
    return u.select("id", "text", F.col("s")[0].end.alias("first_end"), F.col("s")[1].end.alias("byte_end"), F.col("s")[3].start.alias("last_start"), F.col("s")[3].end.alias("last_end"))


@query(f"""with c as (select id, list_filter(string_split(ref, ''), lambda c: c != '') as c from {UTT} where length(ref) > 0)
 select id, cast(len(p) as integer) as n_kept, array_to_string(p, ',') as places from (select id, list_filter(range(0, len(c)), lambda i: not regexp_matches(c[i + 1], '[\\p{{P}}\\p{{Z}}\\s]')) as p from c)""")
def e13_comparable_places(spark, sf):
    """Where the characters stand that aren't punctuation, separators or blanks."""
    u = utterances(spark, sf, "id", "ref").filter("length(ref) > 0").select("id", scoring.kept_places(F.col("ref")).alias("p"))
    return u.select("id", F.size("p").alias("n_kept"), F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("places"))


def kept_sql(text: str) -> str:
    return f"array_to_string(list_filter(string_split({text}, ''), lambda c: c != '' and not regexp_matches(c, '[\\p{{P}}\\p{{Z}}\\s]')), '')"


LCS = "list_reduce(list_filter(string_split(h, ''), lambda c: c != ''), lambda t, c: list_append(t, list_reduce(range(1, length(r) + 1), lambda acc, j: list_append(acc, case when substr(r, j, 1) = c then t[-1][j] + 1 else greatest(t[-1][j + 1], acc[-1]) end), [0::bigint])), [list_transform(range(0, length(r) + 1), lambda x: 0::bigint)])"
MATCH_BACK = """list_reduce(range(0, length(r) + length(h)), lambda s, x: case
 when s.i = 0 or s.j = 0 then s when t[s.j + 1][s.i + 1] = t[s.j + 1][s.i] then {'i': s.i - 1, 'j': s.j, 'm': s.m}
 when s.j > 1 and t[s.j][s.i + 1] > t[s.j][s.i] then {'i': s.i, 'j': s.j - 1, 'm': s.m}
 else {'i': s.i - 1, 'j': s.j - 1, 'm': list_append(s.m, {'a': s.i - 1, 'b': s.j - 1})} end, {'i': length(r), 'j': length(h), 'm': [{'a': -9::bigint, 'b': -9::bigint}]}).m[2:]"""
# Runs of the matches: the common start and end, and in between those of a longest common subsequence.
MATCHED_SQL = f"""tx as (select id, source, {kept_sql("ref")} as rr, {kept_sql("hyp")} as hh from {UTT} where length(ref) > 0 and length(hyp) > 0),
 ld as (select *, list_reduce(range(0, least(length(rr), length(hh))), lambda n, k: case when n = k and substr(rr, k + 1, 1) = substr(hh, k + 1, 1) then k + 1 else n end, 0::bigint) as lead from tx),
 tl as (select *, list_reduce(range(0, least(length(rr), length(hh)) - lead), lambda n, k: case when n = k and substr(rr, length(rr) - k, 1) = substr(hh, length(hh) - k, 1) then k + 1 else n end, 0::bigint) as tail from ld),
 md as (select id, source, rr, hh, lead, tail, substr(rr, lead + 1, length(rr) - lead - tail) as r, substr(hh, lead + 1, length(hh) - lead - tail) as h from tl),
 lc as (select *, {LCS} as t from md), mb as (select *, {MATCH_BACK} as m from lc),
 mt as (select id, source, unnest(list_concat(list_transform(range(0, lead), lambda k: {{'a': k, 'b': k}}), list_transform(m, lambda x: {{'a': x.a + lead, 'b': x.b + lead}}), list_transform(range(1, tail + 1), lambda k: {{'a': length(rr) - k, 'b': length(hh) - k}}))) as x from mb),
 rn as (select id, source, x.a as a, x.b as b, x.a - row_number() over (partition by id order by x.a) as ga, x.b - row_number() over (partition by id order by x.a) as gb from mt),
 runs as (select id, source, min(a) as at, min(b) as at_hyp, count(*) as n from rn group by id, source, ga, gb)"""


@query(f"""with {MATCHED_SQL} select id, cast("at" as integer) as "at", cast(at_hyp as integer) as at_hyp, cast(n as integer) as n from runs where n >= 4""")
def e14_matching_runs(spark, sf):
    """Equal runs of four or more compared characters in an alignment by insertions and deletions."""
    return scoring.matched_runs(utterances(spark, sf, "id", "source", "ref", "hyp").filter("length(ref) > 0 and length(hyp) > 0"), "ref", "hyp", 4).select("id", "at", "at_hyp", "n")


CUT_SQL = f"""with {MATCHED_SQL}, long as (select * from runs where n >= 8), cuts as (select l.id, l.source, c.pos as cut, l.at_hyp + c.pos - l.at as cut_hyp from long l, lateral (select unnest(range(l.at + 4, l.at + l.n - 3)) as pos) c where c.pos % 4 = 0)"""


@query(CUT_SQL + " select id, cast(cut as integer) as cut, cast(cut_hyp as integer) as cut_hyp from cuts")
def r08_cut_table(spark, sf):
    """Where a text may be cut at every fourth compared character, and the same place in the other: both in a run with four on each side."""
    return _cut_table(spark, sf).select("id", "cut", "cut_hyp")


@query(CUT_SQL + f""", k as (select id, source, length({kept_sql('ref')}) // 4 as places from {UTT} where length(ref) > 0 and length(hyp) > 0), n as (select id, count(*) as n from cuts group by id)
 select k.source, count(*) as n_rows, count(n.n) as n_cut, cast(coalesce(sum(n.n), 0) as bigint) as n_cuts, round(count(n.n) / count(*), 6) as share_rows, round(coalesce(sum(n.n), 0) / nullif(sum(places), 0), 6) as share_places from k left join n using (id) group by k.source""")
def r08_cut_shares(spark, sf):
    """Rows and places of each source that have a cut."""
    u = utterances(spark, sf, "id", "source", "ref", "hyp").filter("length(ref) > 0 and length(hyp) > 0").select("id", "source", (F.size(scoring.kept_places(F.col("ref"))) / 4).cast("bigint").alias("places"))
    n = _cut_table(spark, sf).groupBy("id").agg(F.count("*").alias("n"))
    cuts = F.coalesce(F.sum("n"), F.lit(0))
    return u.join(n, "id", "left").groupBy("source").agg(F.count("*").alias("n_rows"), F.count("n").alias("n_cut"), cuts.alias("n_cuts"), st.ratio(F.count("n"), F.count("*")).alias("share_rows"), st.ratio(cuts, F.sum("places")).alias("share_places"))


def _cut_table(spark, sf):
    long = scoring.matched_runs(utterances(spark, sf, "id", "source", "ref", "hyp").filter("length(ref) > 0 and length(hyp) > 0"), "ref", "hyp", 8)
    cuts = long.select("id", "source", "at", "at_hyp", F.explode(F.expr("filter(sequence(at + 4, at + n - 4), x -> x % 4 = 0)")).alias("cut"))
    return cuts.select("id", "source", "cut", (F.col("at_hyp") + F.col("cut") - F.col("at")).alias("cut_hyp"))


QUERIES, SQL = query.queries, query.sql
