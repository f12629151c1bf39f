import random

import pytest
from pyspark.sql import functions as F

from gleaner.functions import scoring as sc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_alignment_is_cheapest_and_whole():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(2))
        steps = sc.alignment(a, b)
        assert sum(k != "=" for k, _, _ in steps) == distance(a, b)
        assert [i for k, i, _ in steps if k != "i"] == list(range(len(a)))
        assert [j for k, _, j in steps if k != "d"] == list(range(len(b)))
        assert all((a[i] == b[j]) == (k == "=") for k, i, j in steps if k in "=s")


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def test_matching_runs_are_a_longest_common_subsequence():
    assert sc.matching_runs("12345abcd", "abcd67890") == [(5, 0, 4)]
    assert sc.matching_runs("", "a") == sc.matching_runs("a", "") == sc.matching_runs("ab", "cd") == []
    assert sc.matching_runs("aaaa", "aaaa") == [(0, 0, 4)]
    rng = random.Random(9)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 14))) for _ in range(2))
        runs = sc.matching_runs(a, b)
        assert sum(n for *_, n in runs) == longest_common(a, b)
        assert all(a[i : i + n] == b[j : j + n] for i, j, n in runs)
        assert all(i + n <= k and j + n <= m and (i + n, j + n) != (k, m) for (i, j, n), (k, m, _) in zip(runs, runs[1:]))


def test_matching_runs_query(spark, tmp_path):
    from gleaner.plans.texts import e14_matching_runs

    row = {"id": "s/1", "source": "s", "split": "train", "ref": "12345abcd", "hyp": "abcd67890", "row_no": 1}
    columns = spark.read.parquet("/root/testdata/sf0.001/utt_index.parquet").schema
    spark.createDataFrame([tuple(row.get(c) for c in columns.names)], columns).write.parquet(f"{tmp_path}/utt_index.parquet")
    assert [tuple(r) for r in e14_matching_runs(spark, str(tmp_path)).collect()] == [("s/1", 5, 0, 4)]


def test_regions():
    assert sc.regions("abcdef", "axcdeff", sc.alignment("abcdef", "axcdeff"))[0] == ("b", "x", 1)
    assert sc.regions("", "", []) == []


KINDS = [
    ("", "a", "insertion"), ("a", "", "deletion"), ("三", "3", "numeral"), ("二十", "弐", "numeral"), ("あ", "b", "latin"), ("カナ", "かな", "hira<->kata"), ("カナ", "かに", "kana-other"),
    ("漢字", "かんじ", "kanji->kana"), ("かんじ", "漢字", "kana->kanji"), ("漢", "感", "kanji->kanji"), ("漢字", "感", "kanji->kanji(len)"), ("あ", "い", "hira->hira"), ("ア", "イ", "kata->kata"),
    ("漢あ", "感い", "mixed-kanji"), ("é", "ü", "other"),
]


def test_kinds(spark):
    df = spark.createDataFrame([(r, h) for r, h, _ in KINDS], "r string, h string")
    got = {(x.r, x.h): x.k for x in df.select("r", "h", sc.region_kind(F.col("r"), F.col("h")).alias("k")).collect()}
    assert got == {(r, h): k for r, h, k in KINDS}


def test_scores(spark):
    rows = [(1, "今日は。", "きょうは", "x"), (2, None, "あ", "x"), (3, "", "", "x"), (4, "ＡＢ１", "ab1", "x"), (5, "abc", None, "x")]
    df = sc.with_style(sc.with_scores(spark.createDataFrame(rows, "id int, ref string, hyp string, extra string")))
    got = {r.id: r for r in df.collect()}
    assert (got[1].edits, got[1].edits_style, got[1].edits_nostyle) == (3, 3, 0)
    assert (got[2].ins, got[2].ref_len, got[2].regions) == (1, 0, [])
    assert got[3].edits == got[4].edits == 0 and got[5]["del"] == 3
    rate = {r.id: r.e for r in df.select("id", sc.error_rate(F.col("edits"), F.col("ref_len"), F.col("hyp_len")).alias("e")).collect()}
    assert rate == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0, 5: 1.0}


@pytest.mark.parametrize("text,want", [("Ａｂ、c_1！", "abc_1"), (None, ""), ("ｶﾞ ①", "ガ1")])
def test_normal_form(text, want):
    assert sc.normal_form(text) == want


def test_pieces_and_lazy_scores(spark):
    df = spark.createDataFrame([(["▁今日", "は", "<0xE3>", "▁", "<unk>", "a"],), ([],)], "p array<string>")
    got = df.select(F.transform("p", sc.piece_text).alias("t"), sc.piece_spans(F.col("p")).alias("s")).collect()
    assert got[0].t == ["今日", "は", "�", "", "", "a"] and [tuple(x) for x in got[0].s] == [(0, 2), (2, 3), (3, 4), (4, 4), (4, 4), (4, 5)] and got[1].s == []
    scored = sc.ensure_scores(spark.createDataFrame([("あ", "い")], "ref string, hyp string"))
    assert scored.first().edits == 1 and sc.ensure_scores(scored) is scored


def test_ticks():
    from gleaner.functions import ticks

    assert ticks.linear(0, 10) == [0, 2, 4, 6, 8, 10] and ticks.linear(0.13, 0.31)[0] == 0.15 and ticks.linear(3, 3) == [3]
    assert all(len(ticks.linear(0, x)) <= 8 for x in (0.7, 1, 3, 9, 99, 1234))
    assert ticks.logarithmic(1, 50) == [1, 2, 5, 10, 20, 50]
    with pytest.raises(ValueError):
        ticks.logarithmic(0, 1)
