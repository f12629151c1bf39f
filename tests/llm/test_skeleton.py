import unicodedata
from unittest.mock import Mock

import pytest

from gleaner.llm import skeleton as skeleton_module
from gleaner.llm.overlap import cross_split_pairs
from gleaner.llm.skeleton import LETTER_RANGES, consistent, look_alike_groups, look_alike_pairs, public_letters, skeleton, skeletons, with_skeleton

SAME = [
    ("Ａｂｃ　１", "Abc 1"), ("ｶﾞｷﾞ", "ガギ"), ("が", "が"), ("か゛", "が"), ("café", "café"), ("a​b﻿", "ab"), ("a b c", "a b c"),
    ("⼆⼈", "二人"), ("金車", "金車"), ("РСХ", "PCX"), ("Μο", "Mo"), ("エ", "工"), ("カ", "力"), ("へぺ", "ヘペ"), ("ー", "一"), ("—", "ー"), ("PC–3", "PC-3"),
    ("ア‧イ", "ア・イ"), ("〜", "～"), ("~", "〜"), ("葛\U000e0100", "葛"), ("ﬁ", "fi"), ("…", "..."), ("a­b", "ab"), ("᠎a", "a"), ("\tb", " b"),
]
DIFFERENT = [("a", "A"), ("ヨ", "ョ"), ("か", "が"), ("は", "ば"), ("1", "①"), ("3", "³"), ("a b", "ab"), ("はい。", "はい"), ("0", "O"), ("l", "I"), ("は", "ハ"), ("い", "イ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert skeleton(a) != skeleton(b)


def test_batches_equal_single_texts():
    texts = [None, "", "ｶﾞ￿", *(x for p in SAME for x in p)]
    assert skeletons(texts) == [skeleton(x) for x in texts]
    assert skeletons(texts[3:]) == [skeleton(x) for x in texts[3:]]
    assert skeletons(texts[3:], compose=True) == [consistent(x) for x in texts[3:]]
    assert skeletons([]) == [] and skeletons([None]) == [None] and consistent(None) is None


def test_skeleton_is_stable():
    for a, b in SAME + DIFFERENT:
        for x in (a, b):
            assert skeleton(skeleton(x)) == skeleton(x)


def test_pairs_and_groups(spark):
    rows = [("1", "カ", "力", 0), ("1", "カ", "力", 0), ("2", "x", "x", 1), ("3", None, "b", 2), ("4", "b", None, 3), (None, "Ａ", "A", 4), ("5", "", "​", 5), ("6", "あ" * 50_000, "ア" * 50_000, 6)]
    df = spark.createDataFrame(rows, "id string, ref string, hyp string, ref_skeleton int")
    assert {r.id for r in look_alike_pairs(df, "id", "ref", "hyp").collect()} == {"1", None, "5"}
    assert look_alike_pairs(df, "id", "ref", "hyp").count() == 3
    assert look_alike_pairs(df.limit(0), "id", "ref", "hyp").count() == 0
    assert with_skeleton(df, ["ref"]).schema["ref_skeleton"].dataType.simpleString() == "string"
    groups = look_alike_groups(df.selectExpr("explode(array(ref, hyp)) as text"), "text").collect()
    assert {(r.text, r.n_rows, r.n_forms) for r in groups} == {("カ", 2, 2), ("力", 2, 2), ("Ａ", 1, 2), ("A", 1, 2), ("", 1, 2), ("​", 1, 2)}


def test_recall_of_the_public_table(spark):
    # Letters that the public table draws as one Latin letter; it takes I, l and 1 as one.
    public, same = public_letters(spark), str.maketrans("I1", "ll")
    letters = [chr(c) for low, high in LETTER_RANGES for c in range(low, high) if unicodedata.category(chr(c)).startswith("L")]
    alike = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton(0, "\n".join(letters)).split("\n")
    wanted = [(c, x) for c, x in zip(letters, alike) if len(x) == 1 and x.isascii() and x.isalpha()]
    got = sum(skeleton(c, public).translate(same) == x.translate(same) for c, x in wanted)
    assert len(wanted) > 300 and got / len(wanted) >= 0.95
    for a, b in DIFFERENT:
        assert skeleton(a, public) != skeleton(b, public)
    for a, b in SAME:
        assert skeleton(a, public) == skeleton(b, public)
    df = spark.createDataFrame([("ⲘⲞᗞᴇ ᴏᴜt", "MODᴇ out"), ("Ꮤ", "W"), ("ᑭ", "P"), ("ⲘⲞ", "mo")], "a string, b string").selectExpr("*", "b as k")
    assert {r.k for r in look_alike_pairs(df, "k", "a", "b").collect()} == {"MODᴇ out", "W", "P"}


class Jvm:
    """The JVM of a session, with another thing in place of its ``com``."""

    def __init__(self, jvm, com):
        self.jvm, self.com = jvm, com

    def __getattr__(self, name):
        return getattr(self.jvm, name)


def icu(answer):
    com = Mock()
    com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton = lambda _, text: answer(text)
    return com


def test_missing_table_is_an_error(spark, monkeypatch):
    df = spark.createDataFrame([("ⲘⲞᗞᴇ", "MODᴇ"), ("РСХ", "PCX")], "a string, b string").selectExpr("*", "b as k")
    texts = df.selectExpr("explode(array(a, b)) as text")
    rows = df.selectExpr("k as id", "'train' as split", "a as ref", "b as hyp")
    real = spark._jvm
    # No such class, no such attribute, a table without letters, one that loses letters.
    for com in (real.nowhere, None, icu(lambda x: x), icu(lambda x: x.replace("\n", "", 1))):
        monkeypatch.setattr(skeleton_module, "_PUBLIC", {})
        monkeypatch.setattr(spark, "_jvm", Jvm(real, com))
        for query in (lambda: look_alike_pairs(df, "k", "a", "b"), lambda: look_alike_groups(texts, "text"), lambda: cross_split_pairs(rows)):
            with pytest.raises(RuntimeError, match="public table"):
                query()
        # What failed isn't kept: the next call with a table has all letters.
        monkeypatch.setattr(spark, "_jvm", real)
        assert {r.k for r in look_alike_pairs(df, "k", "a", "b").collect()} == {"MODᴇ", "PCX"}
