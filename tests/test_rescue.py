import json

from tesserae.operators.rescue import ingest, promoted_names, schema_changes

LINES = "line_id long, feed_id long, record_type string, file_no int, line_no int, payload string, m string, inner string"


def _lines(spark, files, kind="generation"):
    rows, n = [], 0
    for (feed, no), payloads in files.items():
        for i, p in enumerate(payloads):
            n += 1
            rows.append((n, feed, kind, no, i, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y"))
    return spark.createDataFrame(rows, LINES)


def _path(i, kind):
    return f"outputs/{kind}/q{i}w7_{kind}.png"


def test_changes_between_files(spark):
    a = [{"seed": i, "eval_mask_path": _path(i, "eval"), "settings": {"guidance": 7.5, "lora": {"a": 1}}} for i in range(4)]
    b = [{"seed": str(i), "evalPath": [_path(i, "eval")], "overlay": _path(i, "over"), "settings": json.dumps({"guidance": None, "steps": 20})} for i in range(4)]
    c = [{"seed": None, "overlay": _path(i, "over"), "evalPath": [_path(i, "eval")], "settings": {"guidance": "7.5", "steps": 20}} for i in range(4)]
    broken = ["", None, "# note", "[]", '{"seed": 1', '{"seed": 1} trailing', '{"x": 1}{"y": 2}', '"text"', "17"]
    got = schema_changes(_lines(spark, {(1, 3): a + broken, (1, 5): b, (1, 9): c + broken, (2, 1): a, (None, 1): a})).collect()
    assert sorted((r.file_no, r.change_kind, r.field_name, r.old_name) for r in got) == sorted(
        [
            (5, "renamed", "evalPath", "eval_mask_path"), (5, "added", "overlay", ""), (5, "retyped", "seed", ""), (5, "retyped", "settings", ""),
            (5, "added", "settings.steps", ""), (5, "removed", "settings.lora", ""), (9, "retyped", "settings", ""), (9, "retyped", "settings.guidance", ""),
        ]
    )
    assert {r.feed_id for r in got} == {1}


def test_unlike_content_is_no_rename(spark):
    a = [{"confidence": i / 10, "eval_mask_path": _path(i, "eval")} for i in range(1, 6)]
    b = [{"seed": 1000 * i, "unc_mask_path": _path(i, "unc")} for i in range(1, 6)]
    got = schema_changes(_lines(spark, {(1, 1): a, (1, 2): b})).collect()
    assert sorted(r.change_kind for r in got) == ["added", "added", "removed", "removed"]


def test_few_values_of_a_kind_vary_by_chance(spark):
    def rows(name, values, path, kind):
        return [{name: v, path: f"outputs/{kind}/x{i}.png"} for i, v in enumerate(values)]

    files = {(1, 1): rows("mode", ["random", "random", "random", "surface"], "eval_path", "eval"), (1, 2): rows("placement", ["surface", "random", "surface", "random"], "unc_path", "unc")}
    got = {(r.change_kind, r.field_name, r.old_name) for r in schema_changes(_lines(spark, files)).collect()}
    assert got == {("renamed", "placement", "mode"), ("added", "unc_path", ""), ("removed", "eval_path", "")}


def test_rescued_and_replayed(spark):
    rows = [
        {"category": "c", "latency_sec": "2.5", "seed": 7, "elapsed": 9.5, "settings": {"steps": "20", "odd": [1, {"a": None}]}},
        {"category": None, "latency_sec": "slow", "seed": [3], "settings": "no json"},
        {"category": "d", "elapsed": {"value": 4.5}, "settings": json.dumps({"target_bbox_xyxy": [1, 2, 3, 4]})},
    ]
    table = ingest(_lines(spark, {(1, 1): [*rows, "{broken", ""]}), "generation", {"elapsed": "latency_sec", "settings.steps": "settings.num_inference_steps"})
    got = {r.line_no: r for r in table.collect()}
    assert len(got) == 3
    assert (got[0].latency_sec, got[0].seed, got[0].settings_num_inference_steps) == (2.5, 7, 20)
    assert set(json.loads(got[0]._rescued)) == {"elapsed", "settings.odd"}
    assert got[1].latency_sec is None and set(json.loads(got[1]._rescued)) == {"latency_sec", "settings"}
    assert got[1].seed == 3 and got[2].latency_sec == 4.5 and got[2].settings_target_bbox_xyxy == [1, 2, 3, 4] and got[2]._rescued is None


def test_boxes_with_a_unit_are_replayed(spark):
    rows = [{"settings": {"bbox": {"xyxy": [1, 2, 3, 4], "unit": "px"}}}, {"settings": {"target_bbox_xyxy": {"xyxy": [5, 6, 7, 8]}}}, {"settings": {"bbox": {"corners": [1], "unit": "px"}}}]
    got = {r.line_no: r for r in ingest(_lines(spark, {(1, 1): rows}), "generation", {"settings.bbox": "settings.target_bbox_xyxy"}).collect()}
    assert got[0].settings_target_bbox_xyxy == [1, 2, 3, 4] and json.loads(json.loads(got[0]._rescued)["settings.bbox"]) == {"unit": "px"}
    assert got[1].settings_target_bbox_xyxy == [5, 6, 7, 8] and got[1]._rescued is None
    assert got[2].settings_target_bbox_xyxy is None and json.loads(json.loads(got[2]._rescued)["settings.bbox"]) == {"corners": [1], "unit": "px"}
    region = ingest(_lines(spark, {(1, 1): [{"region_xyxy": {"xyxy": [1, 2, 3, 4], "unit": "px"}}]}, "auto_mask"), "auto_mask").first()
    assert region.region_xyxy == [1, 2, 3, 4] and json.loads(json.loads(region._rescued)["region_xyxy"]) == {"unit": "px"}


def test_what_a_cast_leaves_stays_rescued(spark):
    rows = [
        {"model": {"value": "m", "checked": False, "by": None}, "output_path": ["a", "b"], "seed": [3, 4], "category": ["c"]},
        {"model": {"value": "m"}, "seed": [], "output_path": [["a", "b"]], "settings": {"target_bbox_xyxy": [1, 2.5, 3, 4]}},
        {"settings": {"bbox": {"value": [1, 2, 3, 4], "checked": True}, "target_bbox_xyxy": [1, None]}},
    ]
    got = {r.line_no: r for r in ingest(_lines(spark, {(1, 1): rows}), "generation", {"settings.bbox": "settings.target_bbox_xyxy"}).collect()}
    kept = {n: {k: json.loads(v) for k, v in json.loads(r._rescued).items()} for n, r in got.items()}
    assert (got[0].model, got[0].output_path, got[0].seed, got[0].category) == ("m", None, None, "c")
    assert kept[0] == {"model": {"checked": False, "by": None}, "output_path": ["a", "b"], "seed": [3, 4]}
    assert got[1].model == "m" and got[1].settings_target_bbox_xyxy is None and kept[1] == {"seed": [], "output_path": [["a", "b"]], "settings.target_bbox_xyxy": [1, 2.5, 3, 4]}
    assert got[2].settings_target_bbox_xyxy == [1, None] and kept[2] == {"settings.bbox": {"value": [1, 2, 3, 4], "checked": True}}


def test_empty_table(spark):
    lines = _lines(spark, {(1, 1): []})
    assert schema_changes(lines).count() == 0 and ingest(lines, "auto_mask").count() == 0


def test_nothing_is_lost_in_a_cast(spark):
    rows = [
        {"confidence": [0.5, 0.9], "category": ["a", "b"]},
        {"confidence": {"value": 0.3, "unit": "pct"}, "region_xyxy": {"value": [1, 2], "frame": "px"}},
        {"category": {"a": 1, "b": 2}, "image_path": {"value": {"a": 1}}, "odd": None, "mask_path": None, "settings": None},
        {"category": [{"a": 1}], "image_path": "{}", "defect_type": True, "seed": [7]},
    ]
    got = {r.line_no: r for r in ingest(_lines(spark, {(1, 1): rows}, "auto_mask"), "auto_mask").collect()}
    kept = {n: {k: json.loads(v) for k, v in json.loads(r._rescued).items()} if r._rescued else None for n, r in got.items()}
    assert got[0].confidence is None and got[0].category is None and kept[0] == {"confidence": [0.5, 0.9], "category": ["a", "b"]}
    assert (got[1].confidence, got[1].region_xyxy) == (0.3, [1, 2]) and kept[1] == {"confidence": {"unit": "pct"}, "region_xyxy": {"frame": "px"}}
    assert got[2].category is None and kept[2] == {"category": {"a": 1, "b": 2}, "image_path": {"value": {"a": 1}}, "odd": None}
    assert (got[3].image_path, got[3].defect_type, got[3].seed) == ("{}", "true", 7) and kept[3] == {"category": [{"a": 1}]}


def test_names_are_promoted_by_the_renames_found(spark):
    def rows(name, n=4):
        return [{"seed": i, name: _path(i, "eval")} for i in range(n)]

    files = {(1, 1): rows("eval_mask_path"), (1, 2): rows("evalPath"), (1, 3): rows("ep"), (2, 1): rows("ep"), (2, 2): rows("other") + [{"junk": None}]}
    lines = _lines(spark, files, "auto_mask")
    names = promoted_names(lines, schema_changes(lines))
    assert names == {"auto_mask": {"ep": "eval_mask_path", "evalPath": "eval_mask_path", "other": "eval_mask_path"}, "generation": {}}
    table = ingest(lines, "auto_mask", names["auto_mask"])
    assert table.filter("eval_mask_path is not null and _rescued is null").count() == 20 and table.count() == 21
