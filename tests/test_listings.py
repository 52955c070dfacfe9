import json

import pytest
from pyspark.sql import functions as F

from tesserae.operators import listings as L
from tesserae.sources import config, readers, sinks


def test_first_image_of_a_mask_or_an_error(spark):
    images = spark.createDataFrame([("c", "b/X1.png"), ("c", "a/x1.jpg"), ("c", "a/x2.png"), ("d", "a/x3.png"), ("c", None)], "c string, p string")
    masks = spark.createDataFrame([("c", "m/x1_mask.png"), ("c", "m/x2.png")], "c string, m string")
    got = {r.m: r.image for r in L.images_of_masks(masks, "m", images, "p", ["c"]).collect()}
    assert got == {"m/x1_mask.png": "a/x1.jpg", "m/x2.png": "a/x2.png"}
    alone = spark.createDataFrame([("c", "m/x3_mask.png")], "c string, m string")
    assert L.images_of_masks(alone, "m", images, "p", ["c"], strict=False).first().image is None
    with pytest.raises(Exception, match="no image"):
        L.images_of_masks(alone, "m", images, "p", ["c"]).collect()


def test_first_existing_filters_and_quotas(spark):
    df = spark.createDataFrame([(1, "x", "a"), (2, "y", "b"), (3, None, "a"), (4, None, None)], "id int, p string, q string")
    files = spark.createDataFrame([("a",), ("y",), ("a",), (None,)], "path string")
    assert {r.id: r.f for r in L.first_existing(df, ["p", "q"], files, "f").collect()} == {1: "a", 2: "y", 3: "a", 4: None}
    assert L.optional_filters(df, {"p": [], "q": []}).count() == 4 and L.optional_filters(df, {"p": [], "q": ["a"]}).count() == 2
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id int, label string")
    taken = L.quota_fill(rows, "label", "id", {"a": 3, "b": 1}, "s").collect()
    assert sorted(r.label for r in taken) == ["a", "a", "a", "b"]
    with pytest.raises(RuntimeError, match="'c': 2"):
        L.quota_fill(rows, "label", "id", {"a": 3, "c": 2}, "s")
    assert L.capped_jobs(rows, "id", "s", 5).count() == 5
    long = L.per_policy(df, {"one": "p", "two": "q"}, "policy", "path")
    assert long.count() == 8 and set(long.columns) == {"id", "policy", "path"}
    none = df.filter("id > 9").agg(L.mean_or_zero(F.col("id")).alias("m")).first().m
    assert none == 0.0


def test_boxes(spark):
    rows = [("Crack", 0.2, 0.02, True), ("Crack", 0.17, 0.1, False), ("resin", 0.06, 0.03, True), ("x", 0.1, 0.06, True), ("x", 0.05, 0.05, False), (None, 0.5, 0.5, True), ("x", None, 0.1, False)]
    df = spark.createDataFrame(rows, "l string, w double, h double, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", L.useful_box(F.col("l"), F.col("w"), F.col("h"))).collect())
    boxes = spark.createDataFrame([([[10, 10, 20, 30], [15, 5, 60, 25]],), ([],)], "b array<array<int>>").withColumn("u", L.united_box(F.col("b"), 100, 50, 0.1)).collect()
    assert boxes[0].u == [5, 3, 65, 32] or boxes[0].u == [5, 2, 65, 33] or boxes[0].u == [5, 3, 65, 33] and boxes[1].u is None
    assert spark.range(1).select(L.clearance(F.array(*[F.lit(x) for x in (5, 8, 80, 40)]), 100, 50)).first()[0] == 0.1


def test_profiles_and_morphology(spark):
    df = spark.createDataFrame([(None, "many marks", "x"), ("crack_band", "many", "x"), ("", "one long line", "x"), (None, None, "Crack"), (None, None, None)], "g string, t string, d string")
    df = df.withColumn("m", L.morphology([F.col("g")], F.col("t"), F.col("d"))).withColumn("p", L.profiles_for(F.col("m"), ["scratch_thin_detail"]))
    assert [(r.m, r.p) for r in df.collect()] == [
        ("multi_scuff", ["scuff_soft_low_strength"]), ("crack_band", ["scratch_thin_detail"]), ("single_stroke", ["scratch_thin_detail"]), ("crack_band", ["scratch_thin_detail"]), ("scratch_band", ["scratch_thin_detail"])
    ]
    with pytest.raises(ValueError):
        L.profiles_for(F.col("m"), ["unheard"])


def test_retries_go_by_steps_to_their_ends(spark):
    rows = [(0, ["low_mask_coverage"], "multi_scuff"), (1, ["low_mask_coverage"], "micro_chip"), (2, ["texture"], "multi_scuff"), (3, [], "x"), (9, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "n int, r array<string>, m string")
    s = L.retry_settings(F.col("n"), F.col("r"), F.col("m"), F.lit(0.55), F.lit(7.5), F.lit(20), F.lit(5), L.RetrySettings())
    got = [tuple(round(v, 6) if isinstance(v, float) else v for v in r.s) for r in df.select(s.alias("s")).collect()]
    assert got == [
        (0.55, 7.5, 20, 0.0, 0.0, 5, None), (0.63, 8.1, 24, 0.04375, 0.1, 97536, "low_mask_coverage"), (0.65, 8.3, 24, 0.0, 0.0, 195067, None),
        (0.73, 8.9, 28, 0.08, 0.16, 292598, "low_mask_coverage"), (0.85, 10.0, 40, 0.08, 0.16, 877784, "low_mask_coverage"), (0.55, 7.5, 20, 0.0, 0.0, 5, None),
    ]


def test_descriptions_in_order(spark):
    known = spark.createDataFrame([("a/1.png", "own"), ("c/d", "target"), ("c", "category"), ("e", ""), (None, "x")], "key string, text string")
    df = spark.createDataFrame([("a/1.png", "c", "d"), ("a/2.png", "c", "d"), ("a/3.png", "c", "z"), ("a/4.png", "e", "z")], "p string, c string, d string")
    got = L.described(df, known, [F.col("p"), F.concat("c", F.lit("/"), "d"), F.col("c")], F.lit("plain"))
    assert [r.description for r in got.orderBy("p").collect()] == ["own", "target", "category", "plain"]


def test_overlap_either_way(spark):
    rows = [("a/b", "a", True), ("a", "a/b", True), ("a\\b", "a/b/", True), ("ab", "a", False), ("a/b", "a/c", False)]
    assert all(r.got == r.w for r in spark.createDataFrame(rows, "a string, b string, w boolean").withColumn("got", L.overlapping(F.col("a"), F.col("b"))).collect())


def test_carried_left_out_and_computed(spark):
    wanted = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "id int, out string")
    stored = spark.createDataFrame([(1, 0.5), (3, 0.7)], "id int, v double")
    files = spark.createDataFrame([("x",), ("y",)], "path string")
    got = {r.id: (r.action, r.v) for r in L.carried_rows(wanted, stored, ["id"], "out", files).collect()}
    assert got == {1: ("carry", 0.5), 3: ("compute", None), 4: ("compute", None)}  # 2 is done but has no row
    assert {r.action for r in L.carried_rows(wanted, stored, ["id"], "out", files, overwrite=True).collect()} == {"compute"}


GOOD = {"project": {}, "dataset": {"targets": {"wood": ["scratch", "hole"]}, "root": "data/x"}, "generation": {}, "models": {"a": ["m/b.pt", {"c": "plain"}]}, "evaluation": {}, "governance": {"p": "z/q"}}


def test_configurations(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(GOOD))
    data = config.load_config(str(path))
    assert config.targets_of(data) == [("wood", "scratch"), ("wood", "hole")] and len(config.fingerprint(data)) == 64
    assert list(config.path_references(data)) == [("dataset.root", "data/x"), ("models.a[0]", "m/b.pt")]
    assert config.forbidden_references(data, ["data"]) == [("dataset.root", "data/x")] and config.forbidden_references(data, ["data/x/y", "m/b"]) == [("dataset.root", "data/x")]
    for bad in ({k: v for k, v in GOOD.items() if k != "models"}, {**GOOD, "dataset": {"targets": {}}}, {**GOOD, "dataset": {"targets": {"wood": []}}}, {}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            config.load_config(str(path))
    written = tmp_path / "c.yaml"
    pytest.importorskip("yaml")
    written.write_text("project: {}\ndataset:\n  targets:\n    wood: [scratch]\ngeneration: {}\nmodels: {}\nevaluation: {}\n")
    assert config.targets_of(config.load_config(str(written))) == [("wood", "scratch")]


def test_defect_images_and_reports(spark, tmp_path):
    for name in ("wood/test/scratch/b.PNG", "wood/test/scratch/a.png", "wood/test/scratch/sub/c.png", "wood/test/hole/x.jpg", "wood/train/good/n.png", "wood/test/hole/x.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    rows = readers.defect_images(spark, str(tmp_path), [("wood", "scratch"), ("wood", "hole")], most=2).collect()
    assert [(r.defect_type, r.path.rsplit("/", 1)[1]) for r in rows] == [("hole", "x.jpg"), ("scratch", "a.png"), ("scratch", "b.PNG")]
    with pytest.raises(FileNotFoundError, match="wood/none"):
        readers.defect_images(spark, str(tmp_path), [("wood", "none")])
    sinks.write_json(spark, str(tmp_path / "s.json"), {"b": 1, "a": [None]})
    assert (tmp_path / "s.json").read_text() == '{\n  "a": [\n    null\n  ],\n  "b": 1\n}\n'
    df = spark.createDataFrame([("x|y", 0.25), (None, None)], "k string, v double")
    sinks.write_report(spark, str(tmp_path / "r.md"), {"Scores": df, "Few": df.limit(1)})
    text = (tmp_path / "r.md").read_text()
    assert "## Scores" in text and "| x\\|y | 0.2500 |" in text and text.count("|---|---|") == 2
