"""Scoring one text against another: normal form, edit counts, error regions and their kinds."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import ship

# Fixed values.
NUMERAL_KANJI = "〇零一二三四五六七八九十百千万億兆"
STYLE_KINDS = ("numeral", "hira<->kata", "kanji->kana", "kana->kanji", "kana-other")
BRACKETED = r"（[^）]*）|\([^)]*\)|\[[^\]]*\]|【[^】]*】"
KANJI = r"[一-鿿㐀-䶿々〆]"

HIRAGANA = r"ぁ-ゟ"
KATAKANA = r"゠-ヿㇰ-ㇿ"
HAN = r"一-鿿㐀-䶿々〆〇豈-﫿\x{20000}-\x{10ffff}"
_NOT_WORD = re.compile(r"\W+")


def normal_form(text: str | None) -> str:
    """NFKC, lower case, nothing but word characters; null is the empty text."""
    return "" if text is None else _NOT_WORD.sub("", unicodedata.normalize("NFKC", text).lower())


@F.pandas_udf(T.StringType())
def _normalised(text: pd.Series) -> pd.Series:
    return text.map(normal_form, na_action=None) if len(text) else text


def normalised(text: str | Column) -> Column:
    ship(SparkSession.active())
    return _normalised(text)


def alignment(ref: str, hyp: str) -> list[tuple[str, int, int]]:
    """One cheapest alignment as steps ``(kind, place in ref, place in hyp)``, kinds =, s, d, i.

    Vertical and horizontal differences of the edit-distance table are kept as bit rows, one whole
    number for each column, so a table column costs a few word operations; walking back along them
    gives the steps.
    """
    m, n = len(ref), len(hyp)
    masks: dict[str, int] = {}
    for i, c in enumerate(ref):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << m) - 1
    rises, falls, columns = full, 0, []
    for c in hyp:
        same = masks.get(c, 0)
        zero = (((same & rises) + rises) ^ rises) | same | falls
        across_up = falls | ~(zero | rises)
        across_down = rises & zero
        shifted_up, shifted_down = (across_up << 1) | 1, across_down << 1
        rises, falls = (shifted_down | ~(zero | shifted_up)) & full, shifted_up & zero & full
        columns.append((rises, across_up & full))
    steps, i, j = [], m, n
    while i and j:
        up, across = columns[j - 1]
        bit = 1 << (i - 1)
        if up & bit:
            i -= 1
            steps.append(("d", i, j))
        elif across & bit:
            j -= 1
            steps.append(("i", i, j))
        else:
            i, j = i - 1, j - 1
            steps.append(("=" if ref[i] == hyp[j] else "s", i, j))
    steps += [("d", k, 0) for k in range(i - 1, -1, -1)] + [("i", 0, k) for k in range(j - 1, -1, -1)]
    return steps[::-1]


def matching_runs(ref: str, hyp: str) -> list[tuple[int, int, int]]:
    """Equal runs ``(place in ref, place in hyp, length)`` of one longest common subsequence.

    That is an alignment by insertions and deletions alone. A bit row for each character of hyp tells
    where the subsequence grows; walking back along them gives the matches.
    """
    lead = 0
    while lead < min(len(ref), len(hyp)) and ref[lead] == hyp[lead]:
        lead += 1
    tail = 0
    while tail < min(len(ref), len(hyp)) - lead and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    i, j = len(ref) - lead - tail, len(hyp) - lead - tail
    masks: dict[str, int] = {}
    for k in range(i):
        masks[ref[lead + k]] = masks.get(ref[lead + k], 0) | 1 << k
    full = (1 << i) - 1
    still, rows = full, []
    for c in hyp[lead : lead + j]:
        both = still & masks.get(c, 0)
        still = ((still + both) | (still - both)) & full
        rows.append(still)
    matches = [(len(ref) - k, len(hyp) - k) for k in range(1, tail + 1)]
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            matches.append((lead + i, lead + j))
    matches += [(k, k) for k in range(lead - 1, -1, -1)]
    out: list[tuple[int, int, int]] = []
    for a, b in reversed(matches):
        if out and (out[-1][0] + out[-1][2], out[-1][1] + out[-1][2]) == (a, b):
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((a, b, 1))
    return out


def regions(ref: str, hyp: str, steps: list[tuple[str, int, int]]) -> list[tuple[str, str, int]]:
    """Maximal runs of steps that don't match: what stands in ref, in hyp, and the edits."""
    out, run = [], []
    for step in [*steps, ("=", 0, 0)]:
        if step[0] != "=":
            run.append(step)
        elif run:
            out.append(("".join(ref[i] for k, i, _ in run if k != "i"), "".join(hyp[j] for k, _, j in run if k != "d"), len(run)))
            run = []
    return out


SCORES = "ref_len int, hyp_len int, sub int, del int, ins int, edits int, regions array<struct<ref:string,hyp:string,edits:int>>"


def _score(ref: str, hyp: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r, h in zip(b.column(ref).to_pylist(), b.column(hyp).to_pylist()):
                r, h = normal_form(r), normal_form(h)
                steps = alignment(r, h) if r != h else []
                counts = {k: sum(s[0] == k for s in steps) for k in "sdi"}
                found = [dict(zip(("ref", "hyp", "edits"), x)) for x in regions(r, h, steps)] if r else []
                out.append((len(r), len(h), counts["s"], counts["d"], counts["i"], sum(counts.values()), found))
            kinds = [pa.int32()] * 6 + [pa.list_(pa.struct([("ref", pa.string()), ("hyp", pa.string()), ("edits", pa.int32())]))]
            names = ["ref_len", "hyp_len", "sub", "del", "ins", "edits", "regions"]
            arrays = [pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]
            keep = [n for n in b.schema.names if n not in (ref, hyp)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), *arrays], [*keep, *names])

    return run


def with_scores(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Edits of ``hyp`` against ``ref`` on normal forms, by kind, and the error regions; the texts are dropped.

    Null counts as empty. An empty reference scores its hypothesis as insertions and has no regions.
    """
    ship(df.sparkSession)
    fields = [f for f in df.schema.fields if f.name not in (ref, hyp)]
    added = T._parse_datatype_string(SCORES).fields
    return df.mapInArrow(_score(ref, hyp), T.StructType([*fields, *added]))


def error_rate(edits: Column, ref_len: Column, hyp_len: Column) -> Column:
    """Edits over the reference's length; for an empty reference 0 with an empty hypothesis, else 1."""
    return F.when(ref_len == 0, F.when(hyp_len == 0, 0.0).otherwise(1.0)).when(hyp_len == 0, 1.0).otherwise(edits / ref_len)


def hiragana(text: Column) -> Column:
    """Katakana as hiragana."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    return F.translate(text, kata, "".join(chr(ord(c) - 0x60) for c in kata))


def char_class(char: Column) -> Column:
    """H, K, D, L, J or O: hiragana, katakana, ASCII digit, lower-case Latin, kanji, other."""
    return (
        F.when(char.rlike(f"^[{HIRAGANA}]$"), "H")
        .when(char.rlike(f"^[{KATAKANA}]$"), "K")
        .when(char.rlike("^[0-9]$"), "D")
        .when(char.rlike("^[a-z]$"), "L")
        .when(char.rlike(f"^[{HAN}]$"), "J")
        .otherwise("O")
    )


def region_kind(ref: Column, hyp: Column) -> Column:
    """The kind of an error region, first rule that holds."""
    both = F.concat(ref, hyp)
    only = lambda text, chars: text.rlike(f"^[{chars}]+$")
    has = lambda text, chars: text.rlike(f"[{chars}]")
    kana, han = HIRAGANA + KATAKANA, HAN
    return (
        F.when(ref == "", "insertion")
        .when(hyp == "", "deletion")
        .when(has(both, "0-9"), "numeral")
        .when((only(ref, NUMERAL_KANJI) | only(hyp, NUMERAL_KANJI)) & (only(ref, han) | only(hyp, han)), "numeral")
        .when(has(both, "a-z"), "latin")
        .when(hiragana(ref) == hiragana(hyp), "hira<->kata")
        .when(only(ref, kana) & only(hyp, kana) & (has(ref, KATAKANA) != has(hyp, KATAKANA)), "kana-other")
        .when(has(ref, han) & only(hyp, kana), "kanji->kana")
        .when(only(ref, kana) & has(hyp, han), "kana->kanji")
        .when(only(ref, han) & only(hyp, han), F.when(F.length(ref) == F.length(hyp), "kanji->kanji").otherwise("kanji->kanji(len)"))
        .when(only(both, HIRAGANA), "hira->hira")
        .when(only(both, KATAKANA), "kata->kata")
        .when(has(ref, han) & has(hyp, han), "mixed-kanji")
        .otherwise("other")
    )


def with_style(df: DataFrame) -> DataFrame:
    """``edits_style``: edits of regions that only change script or numerals, and ``edits_nostyle``."""
    style = F.filter("regions", lambda r: region_kind(r.ref, r.hyp).isin(*STYLE_KINDS))
    total = F.aggregate(style, F.lit(0), lambda acc, r: acc + r.edits)
    return df.withColumn("edits_style", total).withColumn("edits_nostyle", F.col("edits") - F.col("edits_style"))


def ensure_scores(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """``df`` with its scores, worked out from the texts only where it doesn't have them."""
    return df if {"edits", "ref_len", "hyp_len"} <= set(df.columns) else with_style(with_scores(df, ref, hyp))


def piece_text(piece: Column) -> Column:
    """The text of a word piece: without its word marker; a byte piece is a placeholder of one character, a special token nothing."""
    return F.when(piece.rlike("^<0x.*>$"), F.lit("�")).when(piece.rlike("^<.*>$"), F.lit("")).otherwise(F.replace(piece, F.lit("▁"), F.lit("")))


def kept_places(text: Column) -> Column:
    """Places, from 0, of the characters that are compared: no punctuation, no separators, no blanks."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    marked = F.transform(chars, lambda c, i: F.when(~c.rlike("[\\p{P}\\p{Z}\\s]"), i))
    return F.array_compact(marked)


def piece_spans(pieces: Column) -> Column:
    """``start, end`` of each piece in the joined text, from running lengths."""
    size = lambda upto: F.aggregate(F.slice(pieces, F.lit(1), upto), F.lit(0), lambda acc, p: acc + F.length(piece_text(p)))
    return F.transform(pieces, lambda p, i: F.struct(size(i).alias("start"), (size(i) + F.length(piece_text(p))).alias("end")))


KEPT = "filter(split({0}, ''), c -> c != '' and not c rlike '[\\\\p{{P}}\\\\p{{Z}}\\\\s]')"


def matched_runs(df: DataFrame, ref: str, hyp: str, least: int) -> DataFrame:
    """``at, at_hyp, n`` beside the other columns: the equal runs of ``least`` or more compared characters, one row each.

    Both texts are taken without punctuation, separators and blanks, and aligned by insertions and
    deletions alone; places count compared characters from 0. Null counts as empty.
    """
    ship(df.sparkSession)
    rest = [f for f in df.schema.fields if f.name not in (ref, hyp, "at", "at_hyp", "n")]
    plain = lambda c: F.array_join(F.expr(KEPT.format(f"coalesce({c}, '')")), "").alias(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, *m) for k, (r, h) in enumerate(zip(b.column(ref).to_pylist(), b.column(hyp).to_pylist())) for m in matching_runs(r, h) if m[2] >= least]
            of = pa.array([m[0] for m in found], pa.int64())
            kept = [b.column(f.name).take(of) for f in rest]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([m[i] for m in found], pa.int32()) for i in (1, 2, 3))], [*(f.name for f in rest), "at", "at_hyp", "n"])

    added = [T.StructField(n, T.IntegerType()) for n in ("at", "at_hyp", "n")]
    return df.select(*(f.name for f in rest), plain(ref), plain(hyp)).mapInArrow(run, T.StructType([*rest, *added]))
