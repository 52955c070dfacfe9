import random

from pyspark.sql import functions as F

from tesserae.llm import components as C
from tesserae.llm.components import components, split_report, split_together

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def groups_of(members):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e, i in members:
        if e is not None and i is not None:
            a, b = find(("e", e)), find(("i", i))
            parent[a] = b
    sets = {}
    for x in list(parent):
        if x[0] == "i":
            sets.setdefault(find(x), []).append(x[1])
    return {i: min(ids) for ids in sets.values() if len(ids) > 1 for i in ids}


def test_equals_union_find(spark):
    rnd = random.Random(5)
    members = [(f"f{rnd.randint(0, 150)}", rnd.randint(1, 250)) for _ in range(260)] + [("hot", i) for i in range(300, 400)]
    members += [(f"chain{i}", i) for i in range(500, 540)] + [(f"chain{i}", i + 1) for i in range(500, 540)] + [(None, 900), ("f1", None), ("alone", 901)]
    got = {r.id: r.component for r in components(spark.createDataFrame(members * 2, "entity string, id long")).collect()}
    assert got == groups_of(members)


def test_hot_nodes_are_spread(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 20)
    rnd = random.Random(7)
    members = [("hot", i) for i in range(0, 300, 2)] + [(f"f{rnd.randint(0, 60)}", rnd.randint(0, 300)) for _ in range(120)] + [("other", i) for i in range(400, 460)]
    got = {r.id: r.component for r in components(spark.createDataFrame(members, "entity string, id long")).collect()}
    assert got == groups_of(members)


def test_splits_hold_groups_together_and_follow_the_shares(spark):
    rows = [(i, f"f{i // 3}", None, "x", "y") for i in range(3000)]
    rows += [(None, "f1", "f2", "x", "y")]
    df = spark.createDataFrame(rows, "rid long, a string, b string, component string, entity string")
    got = split_together(df, "rid", [F.col("a"), F.col("b")], SHARES).collect()
    by = {}
    for r in got:
        by.setdefault(r.component, set()).add(r.split)
    assert len(got) == 3000 and len(by) == 1000 and all(len(s) == 1 for s in by.values())
    assert abs(sum(r.split == "train" for r in got) / 3000 - 0.8) < 0.05
    report = {r.split: r for r in split_report(split_together(df, "rid", [F.col("a"), F.col("b")], SHARES), SHARES).collect()}
    assert report["train"].n_records == sum(r.split == "train" for r in got) and report["test"].asked_share == 0.1
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and all(r.largest_component == 3 for r in report.values())


def test_empty(spark):
    assert components(spark.createDataFrame([], "entity string, id long")).count() == 0
