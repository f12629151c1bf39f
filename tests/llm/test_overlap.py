import random
from fractions import Fraction

import numpy as np
import pyarrow as pa

from gleaner.llm import overlap as o

RATE = Fraction(15, 100)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, k, letters):
    for _ in range(k):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        text = text[:i] + (rng.choice(letters) if kind != 1 else "") + text[i + (kind != 0) :]
    return text


def corpus(seed, letters, ending, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        base = "".join(rng.choice(letters) for _ in range(rng.randrange(9, 60))) + ending
        rows.append((f"t{i}", "train", base, None))
        for j in range(rng.randrange(3)):
            rows.append((f"e{i}_{j}", rng.choice(["dev", "eval"]), edited(rng, base, rng.randrange(0, max(1, len(base) // 5)), letters), None))
    return rows


def brute(rows):
    texts = {i: o.comparable([r or h])[0] for i, s, r, h in rows if i and s}
    split = {i: s for i, s, _, _ in rows if i and s}
    ids = [i for i in texts if len(texts[i]) >= 15]
    out = set()
    for a in ids:
        for b in ids:
            if split[a] == "train" and split[b] in ("dev", "eval"):
                longer = max(len(texts[a]), len(texts[b]))
                if abs(len(texts[a]) - len(texts[b])) * 100 <= 15 * longer and distance(texts[a], texts[b]) * 100 <= 15 * longer:
                    out.add((b, a))
    return out


def found(spark, rows, **tuning):
    df = spark.createDataFrame(rows, "id string, split string, ref string, hyp string")
    return {(r.id_held, r.id_train) for r in o.cross_split_pairs(df, **tuning).collect()}


def test_equals_brute_force(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E40)]
    rows = corpus(1, letters, "")
    assert found(spark, rows) == brute(rows) != set()


def test_common_endings(spark):
    # Every text ends alike and few letters are used, so short texts can't avoid common spans.
    rows = corpus(2, list("abcdefghij"), "られたらしい", 120)
    assert found(spark, rows, cells=1 << 10, floor=1) == brute(rows) != set()


def test_two_letters(spark):
    rows = corpus(3, list("ab"), "", 40)
    assert found(spark, rows, cells=64, floor=1) == brute(rows) != set()


def test_odd_rows(spark):
    text = "これは十五文字より長い文章なのです"
    long = "".join(chr(0x4E00 + random.Random(4).randrange(3000)) for _ in range(20_000))
    rows = [
        ("a", "train", text, None), ("a", "train", text, None), ("b", "dev", "", text + "。"), ("c", "eval", None, text), ("d", None, text, None),
        ("e", "dev", None, None), (None, "dev", text, None), ("f", "train", "短い", None), ("g", "dev", "短い", None), ("h", "train", long, None), ("i", "dev", long[5:], None),
        ("j", "train", "あ" * 3000, None), ("k", "eval", "あ" * 2900, None), ("l", "other", text, None),
    ]
    assert found(spark, rows) == {("b", "a"), ("c", "a"), ("i", "h"), ("k", "j")}
    assert found(spark, []) == set()
    assert found(spark, rows[:2]) == set()


def test_starts_are_apart_and_cheapest():
    rng = np.random.default_rng(5)
    for width, spans, gram in ((14, 3, 4), (30, 5, 4), (9, 1, 4), (21, 6, 4)):
        cost = rng.integers(0, 9, (width, 20))
        got = o.cheapest_starts(cost, spans, gram)
        assert (np.diff(got, axis=0) >= gram).all() and got.max() < width
        for t in range(20):
            best = {(): 0}
            for s in range(width):
                for k, v in list(best.items()):
                    if len(k) < spans and (not k or s - k[-1] >= gram):
                        best[(*k, s)] = v + cost[s, t]
            assert min(v for k, v in best.items() if len(k) == spans) == cost[got[:, t], t].sum()


def test_enough_spans_for_every_length():
    for n in range(15, 2000):
        starts, lens = np.array(o.stretches(n)).T
        assert starts[0] == 0 and (starts[1:] == (starts + lens)[:-1]).all() and starts[-1] + lens[-1] == n
        spans = o.edits_allowed(lens, RATE) + 1
        assert spans.sum() >= o.edits_allowed(np.array([n]), RATE)[0] + 1
        assert (lens >= o.GRAM * spans).all()


def test_report(spark):
    rows = corpus(6, [chr(c) for c in range(0x4E00, 0x4E40)], "", 40)
    df = spark.createDataFrame([(*r, "s") for r in rows], "id string, split string, ref string, hyp string, source string")
    report = o.overlap_report(df).collect()
    assert sum(r.n_overlapping for r in report) == len({a for a, _ in brute(rows)})
    assert sum(r.n_records for r in report) == sum(r[1] != "train" for r in rows)


def brute_covered(text, partners):
    """Places of ``text`` in a run of four or more that a partner has, each run extended as far as it goes."""
    held = set()
    for partner in partners:
        for i in range(len(text)):
            for j in range(len(partner)):
                n = 0
                while i + n < len(text) and j + n < len(partner) and text[i + n] == partner[j + n]:
                    n += 1
                if n >= 4:
                    held.update(range(i, i + n))
    return len(held) / len(text)


def test_coverage_of_pairs_and_records(spark):
    letters = [chr(c) for c in range(0x4E00, 0x4E40)]
    for rows, tuning in ((corpus(7, letters, "", 40), {}), (corpus(8, list("abcdefghij"), "られたらしい", 40), {"cells": 1 << 10, "floor": 1})):
        texts = {i: o.comparable([r])[0] for i, _, r, _ in rows}
        df = spark.createDataFrame(rows, "id string, split string, ref string, hyp string")
        got, partners = o.cross_split_pairs(df, **tuning).collect(), {}
        assert got
        for r in got:
            partners.setdefault(r.id_held, []).append(texts[r.id_train])
            assert abs(r.covered - brute_covered(texts[r.id_held], [texts[r.id_train]])) < 1e-9
            assert r.edits or r.covered == 1.0
        records = {r.id: r.covered for r in o.covered_records(df, **tuning).collect()}
        assert records.keys() == partners.keys()
        assert all(abs(records[i] - brute_covered(texts[i], partners[i])) < 1e-9 for i in records)


def test_report_merges_the_runs_of_all_partners(spark):
    a, b, c = ("".join(chr(0x4E00 + 100 * k + i) for i in range(40)) for k in range(3))
    rows = [
        ("t1", "train", a), ("copy", "dev", a), ("t2", "train", "零一二三" + b[4:]), ("t3", "train", b[:36] + "零一二三"), ("both", "eval", b),
        ("t4", "train", c[:10] + "零" + c[11:13] + "一" + c[14:]), ("one", "dev", c), ("none", "dev", c[::-1]),
    ]
    df = spark.createDataFrame([(i, s, r, None, i) for i, s, r in rows], "id string, split string, ref string, hyp string, source string")
    pairs = o.cross_split_pairs(df)
    assert {(r.id_held, r.id_train): r.covered for r in pairs.collect()} == {("copy", "t1"): 1.0, ("both", "t2"): 0.9, ("both", "t3"): 0.9, ("one", "t4"): 0.9}
    assert {r.source: r.mean_covered for r in o.overlap_report(df).collect()} == {"copy": 1.0, "both": 1.0, "one": 0.9, "none": None}


def test_portions():
    texts = ["a" * 10, None, "b" * 2000, "", "c" * 5, "d" * 990]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    parts = list(o.portions(iter([batch, batch.slice(0, 0)]), 1000))
    assert [x for p in parts for x in p.column("text").to_pylist()] == texts and len(parts) > 1


def test_common_prefixes_and_classes():
    rng = random.Random(11)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(4, 40))) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"tid": range(60), "text": texts})
    c = o.Codes(batch)
    row, at = c.places()
    suffix = [texts[r][p : p + o.DEPTH] for r, p in zip(row, at - c.at[row])]
    need = np.array([rng.choice([0, 0, 4, 5, 7, 9]) for _ in row])
    need = np.where(need <= [len(x) for x in suffix], need, 0)
    whole = c.prefixes(at, np.where(need > 0, need, o.DEPTH))
    order = np.lexsort((need, *whole[::-1]))
    mine = [suffix[i][: need[i] or None] for i in order]
    assert mine == sorted(mine)
    common = o.common_prefixes(whole[:, order])
    for i in range(1, len(mine)):
        n = 0
        while n < min(len(mine[i]), len(mine[i - 1])) and mine[i][n] == mine[i - 1][n]:
            n += 1
        assert common[i] == (o.DEPTH if mine[i] == mine[i - 1] else n)
    got = {(int(a), int(b)) for x, y in o.met_in_classes(whole[:, order], need[order], need[order] == 0, 50) for a, b in zip(x, y)}
    assert got == {(i, j) for i in range(len(mine)) if need[order[i]] for j in range(len(mine)) if not need[order[j]] and mine[j].startswith(mine[i])} != set()


def test_runs_survive_packing():
    rng = np.random.default_rng(12)
    columns = [rng.integers(0, 1 << 63, 500).astype(k) for k in o.KINDS]
    assert all((a == b).all() for a, b in zip(columns, o._unpacked_run(o._packed_run(columns), o.KINDS)))


def test_ranges_bring_every_prefix_to_its_suffixes():
    rng = random.Random(13)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(8, 30))) for _ in range(80)]
    c = o.Codes(pa.RecordBatch.from_pydict({"tid": range(80), "text": texts}))
    row, at = c.places()
    prefix, need = c.prefixes(at), np.array([min(4 + i % 7, len(texts[r]) - p) for i, (r, p) in enumerate(zip(row, at - c.at[row]))])
    spans = c.prefixes(at, need)
    keys = o._bytes(prefix[0], prefix[1])
    for ranges in (o.Ranges.planned(keys, *o._bounds(spans, need), 9), o.Ranges.planned(keys, *(x[:40] for x in o._bounds(spans, need)), 300), o.Ranges(np.sort(keys)[::50], np.arange(1, len(keys[::50]) + 2))):
        held, training = {}, {}
        for out, (which, part) in ((held, ranges.of_held(keys, c.tid[row])), (training, ranges.of_training(*o._bounds(spans, need), c.tid[row]))):
            assert (part >= 0).all() and (part < ranges.total).all()
            for i, k in zip(which.tolist(), part.tolist()):
                out.setdefault(i, set()).add(k)
        assert len(held) == len(training) == len(row)
        for i in range(0, len(row), 41):
            for j in range(0, len(row), 3):
                if (c.prefixes(at[[j]], need[[i]]) == spans[:, [i]]).all():
                    # Exactly one task sees the two together.
                    assert len(training[i] & held[j]) == 1


def test_few_suffixes_in_a_range(spark):
    # Many ranges, hot prefixes that fill several, and a sample that misses most of the order.
    rows = corpus(14, list("abcdefghij"), "られたらしい", 80)
    assert found(spark, rows, per_range=60, sample=300, floor=20) == brute(rows) != set()


def test_template_does_not_pair_all(spark):
    rng = random.Random(15)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    frame = [rng.choice(letters) for _ in range(28)]
    rows = []
    for i in range(400):
        middle = [rng.choice(letters) for _ in range(16)]
        rows.append((f"t{i}", "train", "".join(frame[:14] + middle + frame[14:]), None))
        if i % 4 == 0:
            rows.append((f"e{i}", "dev", edited(rng, rows[-1][2], i % 7, letters), None))
    df = spark.createDataFrame(rows, "id string, split string, ref string, hyp string")
    texts = o.materialise(o.distinct_texts(o.held_out_records(df)), "texts")
    assert o.shared_spans(texts, floor=20).count() < 400
    assert found(spark, rows, floor=20) == brute(rows) != set()


def test_long_texts_with_hot_spans(spark):
    rng = random.Random(16)
    frame = "".join(rng.choice("abcde") for _ in range(120))
    rows = []
    for i in range(24):
        text = "".join(frame[:60] + "".join(rng.choice("abcdefgh") for _ in range(30)) + frame[60:] for _ in range(3))
        rows += [(f"t{i}", "train", text, None), (f"e{i}", "dev", edited(rng, text, 10 + 3 * i, "xyz"), None)]
    assert found(spark, rows, floor=5) == brute(rows) != set()
