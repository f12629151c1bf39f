import re
import random

from gleaner.llm import splitting as s
from gleaner.llm.tokens import encoder, with_tokens

TEXT = "".join(random.Random(1).choice(["これは文です。", "A short sentence. ", "次の行\n", "段落\n\n", "それから、", "「本当？」", "🙂🙂", "x" * 30]) for _ in range(900))
LIMITS = [("small", 64, 8), ("large", 256, 32), ("plain", 128, 0)]


def test_boundaries():
    at, strength = s.boundaries("一。二！\n三\n\n四 3.5 end. 五「は。」六")
    assert strength == [1, 2, 3, 1, 1]
    assert s.edges("ab。cde. f") == [2, 3, 6, 7] and s.edges("") == [] and s.edges("a.b。") == [3, 4]
    for text, limit, longest in (("ab。cde. f", 2, 3), ("ab。cde. f", 3, 0), ("a.b", 1, 3), ("", 1, 0), ("\n\n\n", 1, 0), ("abcdefg。xy", 3, 7), ("x。abcdefg", 2, 7)):
        at = s.edges(text)
        assert s.longest_stretch(s.bisected(len(text), at, [1] * len(at), limit)) == longest


def test_bisection():
    done = s.bisected(100, [10, 48, 52, 90], [1, 1, 3, 1], 60)
    assert done == [(0, 52, "paragraph"), (52, 100, "end")]
    for limit in (1, 7, 30):
        got = s.bisected(200, [50, 120], [1, 2], limit)
        assert got[0][0] == 0 and got[-1][1] == 200 and all(0 < b - a <= limit for a, b, _ in got)
        assert all(x[1] == y[0] for x, y in zip(got, got[1:]))
        assert {50, 120} <= {b for _, b, _ in got}


def check(pieces, text, most, overlap):
    enc = encoder()
    assert [p.piece for p in pieces] == list(range(len(pieces)))
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert p.text == text[p.start : p.end]
        assert len(enc.encode_ordinary(p.text)) == p.n_tokens <= most
    for p, q in zip(pieces, pieces[1:]):
        shared = len(enc.encode_ordinary(text[q.start : p.end]))
        assert q.end > p.end and (q.start == p.end if not overlap else overlap - 6 <= shared <= overlap + 6), shared


def test_pieces(spark):
    long = "漢" * 40_000
    rows = [(1, TEXT, 0), (2, None, 0), (3, "", 0), (4, "short", 0), (5, long, 0), (None, TEXT[:2000], 0), (6, TEXT, 0)]
    df = spark.createDataFrame(rows, "doc long, text string, piece int")
    got = s.split_texts(df, "doc", "text", LIMITS).collect()
    for key, text in ((1, TEXT), (None, TEXT[:2000]), (5, long)):
        for name, most, overlap in LIMITS:
            mine = sorted((r for r in got if r.doc == key and r.limit_name == name), key=lambda r: r.piece)
            check(mine, text, most, overlap)
    assert {r.doc for r in got} == {1, 5, 6, None}
    natural = [r.cut for r in got if r.doc == 1]
    assert natural.count("hard") < len(natural) / 10
    assert s.split_texts(df.limit(0), "doc", "text", LIMITS).count() == 0
    assert "key" in s.split_texts(df, "piece", "text", LIMITS).columns


def stretch(text):
    return max(map(len, re.split("[\n\x0b\x0c\r\x85\u2028\u2029。！？｡!?]|\\.(?=\\s|\\Z)", text)))


def test_unbroken(spark):
    rng = random.Random(3)
    texts = []
    for n in (1199, 1200, 1201, 1300):
        texts += ["あ" * n, "文。" * 50 + "あ" * n + "。終", "あ" * n + "\n" + "い" * n, "い」" + "あ" * (n - 2), "a." * (n // 2) + "b" * (n % 2)]
    texts += ["".join(rng.choice("あいう。\n") for _ in range(5000)), "", None, "x" * 100_000, "\n" * 3000, "。" * 1300 + "あ" * 1201, "あ" * 1250 + "。" + "い" * 4000 + "。\n" + "う" * 1199]
    df = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    got = {r.doc: r.stretch for r in s.unbroken_texts(df, "doc", "text", 1200).collect()}
    assert got == {i: stretch(t) for i, t in enumerate(texts) if t and stretch(t) > 1200}
    assert s.unbroken_texts(df.limit(0), "doc", "text", 1200).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "日本語 text", 9), (2, None, 9), (3, "", 9), (4, "<|endoftext|>", 9)], "doc int, text string, n_tokens int")
    got = {r.doc: r.n_tokens for r in with_tokens(df).collect()}
    assert got[2] is None and got[3] == 0 and got[4] > 1 and got[1] == len(encoder().encode_ordinary("日本語 text"))
