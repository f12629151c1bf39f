import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from gleaner.llm import group_split as g


def components(links):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for record, entity in links:
        if record is not None and entity is not None:
            parent[root(("r", record))] = root(("e", entity))
    groups = defaultdict(set)
    for record, entity in links:
        if record is not None and entity is not None:
            groups[root(("r", record))].add(record)
    return {r: min(rs) for rs in groups.values() for r in rs}


def grouped(spark, links):
    df = spark.createDataFrame(links, "record string, entity string")
    return {r.record: r.group for r in g.connected_groups(df).collect()}


def test_random_graphs(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        links = [(f"r{rng.randrange(300):03}", f"e{rng.randrange(260)}") for _ in range(400)]
        assert grouped(spark, links) == components(links)


def test_long_chain_and_hub(spark, monkeypatch):
    chain = [(f"c{i:04}", f"k{j}") for i in range(300) for j in (i, i + 1)]
    random.Random(3).shuffle(chain)
    monkeypatch.setattr(g, "SPREAD", 50)
    hub = [(f"h{i}", "hub") for i in range(500)]
    assert grouped(spark, chain + hub) == components(chain + hub)


def test_odd_links(spark):
    links = [("a", "x"), ("a", "x"), ("b", None), (None, "x"), ("c", "y"), ("d", "x")]
    assert grouped(spark, links) == {"a": "a", "c": "c", "d": "a"}
    assert grouped(spark, []) == {}


def test_recording_names(spark):
    names = {"s/JA_x_W1_W00002": "x_W1", "s/JA_x": "JA", "s/a/b/c": "a/b", "s/a_b_c": "a_b", "s/plain": "plain", "s/JA_p/q_W3": "p/q", "bare_1": "bare"}
    df = spark.createDataFrame([(i, None) for i in names] + [("s/a_b", "key"), ("s/a_b", "")], "id string, media_key string")
    got = df.select("id", "media_key", g.recording_of(F.col("id"), F.col("media_key")).alias("r")).collect()
    assert {r.id: r.r for r in got if r.media_key is None} == names
    assert {r.r for r in got if r.media_key is not None} == {"key", "a"}


RECORDINGS = [
    ("r1", " Ｃｈａｎ A ", None), ("r2", "chan a", None), ("r3", "unknown", None), ("r4", "不明", None), ("r5", None, "lost"), ("r6", "", "lost"), ("R1", "N/A", None),
    ("r7", "-", "r8"), ("r8", None, None), ("r8", "solo", None), ("r9", "SOLO", None), (None, "chan a", None), ("r10", "ｶﾞ", None), ("r11", "ガ", None),
]


def test_leaks(spark):
    recordings = spark.createDataFrame(RECORDINGS, "media_key string, channel string, reupload_of string")
    rows = [(f"s/{r}_{n}", split, r) for n, (r, split) in enumerate([("r1", "train"), ("r2", "dev"), ("r3", "train"), ("r4", "eval"), ("r5", "train"), ("r6", "eval"), ("R1", "dev"), ("r7", "dev"), ("r9", "train"), ("r10", "train"), ("r11", "dev"), ("x", "train"), ("x", "eval"), ("r2", None)])]
    utterances = spark.createDataFrame(rows + rows[:3] + [(None, "dev", "r1")], "id string, split string, media_key string")
    assert {r.id.split("_")[0] for r in g.split_leaks(utterances, recordings).collect()} == {"s/r2", "s/r6", "s/r7", "s/r11", "s/x"}
    assert g.split_leaks(utterances.limit(0), recordings.limit(0)).count() == 0
    assert {r.id.split("_")[0] for r in g.split_leaks(utterances, recordings.limit(0)).collect()} == {"s/x"}


def test_assignment(spark):
    rng = random.Random(7)
    rows = [(f"g{i}", f"s{i % 3}") for i in range(3000) for _ in range(rng.choice([1, 1, 2, 9]))] + [("big", "s0")] * 900
    df = spark.createDataFrame(rows + [(None, "s0")], "group string, stratum string")
    targets = {"train": 0.8, "dev": 0.1, "eval": 0.1}
    got = g.assign_splits(df, targets).collect()
    split = {r.group: r.new_split for r in got}
    assert len(got) == len(split) == 3001 and split["big"] == "train"
    total = Counter(split[x] for x, _ in rows)
    for name, share in targets.items():
        assert abs(total[name] / len(rows) - share) < 0.01
    for stratum in ("s0", "s1", "s2"):
        by = Counter(split[x] for x, y in rows if y == stratum)
        assert abs(by["dev"] / sum(by.values()) - 0.1) < 0.03
    again = g.assign_splits(df.repartition(7).orderBy(F.rand()), targets).collect()
    assert {r.group: r.new_split for r in again} == split
    assert g.assign_splits(df.limit(0), targets).count() == 0


def test_parent_that_is_not_listed(spark):
    recordings = spark.createDataFrame([("child", None, "parent"), ("other", None, None), ("last", None, "")], "media_key string, channel string, reupload_of string")
    rows = [("s/1", "s", "train", "parent"), ("s/2", "s", "dev", "child"), ("s/3", "s", "eval", "other"), ("s/4", "s", "train", "last")]
    utterances = spark.createDataFrame(rows, "id string, source string, split string, media_key string")
    assert {r.id for r in g.split_leaks(utterances, recordings).collect()} == {"s/2"}
    groups = {r.id: r.group for r in g.utterance_groups(utterances, recordings).collect()}
    assert groups["s/1"] == groups["s/2"] and len(set(groups.values())) == 3
