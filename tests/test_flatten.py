import datetime as dt
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.operators.flatten import (
    AUTO_MASK_CHILDREN,
    candidate_table,
    component_table,
    linked_rows,
    prediction_table,
    reason_table,
    shred,
    sub_box_table,
    variant_table,
)
from tesserae.operators.json_index import JsonIndex

LEAF = st.none() | st.booleans() | st.integers(-99, 99) | st.text(alphabet='ab"\\{}[]:, \n\té', max_size=6)
VALUE = st.recursive(LEAF, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(alphabet='kq"\\:é', max_size=3), x, max_size=3), max_leaves=12)
DOCS = st.lists(st.dictionaries(st.text(alphabet="abc", max_size=2), VALUE, max_size=3) | st.lists(VALUE, max_size=3), max_size=4)


def walk(value, path=()):
    items = enumerate(value) if isinstance(value, list) else value.items() if isinstance(value, dict) else ()
    for k, v in items:
        yield (*path, str(k)), v
        yield from walk(v, (*path, str(k)))


@settings(max_examples=150, deadline=None)
@given(DOCS, st.booleans())
def test_index_finds_every_value(docs, spaced):
    index = JsonIndex([json.dumps(d, ensure_ascii=False, indent=1 if spaced else None) for d in docs])
    got = []
    for r in range(len(index.start)):
        path, up = [], r
        while up >= 0:
            path.append(index.label(up))
            up = index.parent[up]
        got.append((int(index.doc[r]), tuple(reversed(path)), json.loads(index.text(r))))
    want = [(i, p, v) for i, d in enumerate(docs) for p, v in walk(d)]
    key = lambda x: (x[0], x[1], json.dumps(x[2]))
    assert sorted(got, key=key) == sorted(want, key=key)


SCHEMA = """auto_mask_id long, id string, r string, settings struct<candidate_scores: map<string,double>, candidate_qc: map<string, struct<mask_area: int,
mask_to_qwen_box_fraction: double, component_count: int, reasons: array<string>>>, candidate_refined_paths: map<string,string>, candidate_heatmap_paths: map<string,string>,
candidate_predictions: array<struct<mode: string, components: array<struct<area: int, box_xyxy: array<int>>>>>, qwen_sub_boxes_xyxy: array<array<int>>>,
mask_variant_paths map<string,string>, mask_variant_overlay_paths map<string,string>, ingested_at timestamp"""


def test_children_keep_their_keys(spark):
    now = dt.datetime(2024, 1, 1)
    long = "x" * 200_000
    full = (
        {"a": 0.5, "b": None}, {"b": (3, 0.1, 1, ["low", None, long]), "c": None}, {'d"\\': "p"}, None,
        [("a", [(1, [0, 0, 1, 1]), None]), None, ("b", None), ("c", [])], [[1, 2], None, []],
    )
    rows = [
        (1, "x", "y", full, {"soft": None}, {"soft": "o", "hard": "h"}, now), (1, "x", "y", full, {"soft": None}, {"soft": "o", "hard": "h"}, now + dt.timedelta(1)),
        (2, None, None, None, None, {}, None), (None, "x", "y", full, None, None, now),
    ]
    parts = shred(spark.createDataFrame(rows, SCHEMA), "auto_mask_id", ["settings", "mask_variant_paths", "mask_variant_overlay_paths"], AUTO_MASK_CHILDREN)
    got = sorted(tuple(r) for r in linked_rows(parts).collect())
    assert got == sorted(
        [(1, "candidate", "", m) for m in ("a", "b", "c", 'd"\\')] + [(1, "reason", "b", "0"), (1, "reason", "b", "2")]
        + [(1, "prediction", "", i) for i in "023"] + [(1, "component", "0", "0")] + [(1, "sub_box", "", "0"), (1, "sub_box", "", "2")]
        + [(1, "variant", "", "soft"), (1, "variant", "", "hard")]
    )
    table = {r.mode: r for r in candidate_table(parts).collect()}
    assert table["a"].score == 0.5 and table["b"].mask_area == 3 and table["b"].score is None and table['d"\\'].refined_path == "p"


def test_children_keep_their_values(spark):
    schema = SCHEMA.replace("struct<mode: string, components", "struct<mode: string, expected_iou: double, disposition: string, components")
    full = (
        None, {"b": (3, 0.1, 1, ["low", None, 'say "x"\\é'])}, None, None,
        [("a", 0.25, "keep", [(7, [0, 1, 2, 3]), None, (None, None)]), None, (None, None, None, None)], [[1, 2, None, 4], None, []],
    )
    rows = [(1, "x", "y", full, {"soft": None, "hard": "m"}, {"soft": "o", "top": None}, dt.datetime(2024, 1, 1))]
    parts = shred(spark.createDataFrame(rows, schema), "auto_mask_id", ["settings", "mask_variant_paths", "mask_variant_overlay_paths"], AUTO_MASK_CHILDREN)
    of = lambda table: sorted((tuple(r) for r in table(parts).collect()), key=lambda r: r[:3])
    assert of(reason_table) == [(1, "b", 0, "low"), (1, "b", 2, 'say "x"\\é')]
    assert of(prediction_table) == [(1, 0, "a", 0.25, "keep"), (1, 2, None, None, None)]
    assert of(component_table) == [(1, 0, 0, 7, [0, 1, 2, 3]), (1, 0, 2, None, None)]
    assert of(sub_box_table) == [(1, 0, [1, 2, None, 4]), (1, 2, [])]
    assert sorted(tuple(r) for r in variant_table(parts).collect()) == [(1, "hard", "m", None), (1, "soft", None, "o"), (1, "top", None, None)]


def test_empty_table(spark):
    parts = shred(spark.createDataFrame([], SCHEMA), "auto_mask_id", ["settings", "mask_variant_paths"], AUTO_MASK_CHILDREN)
    assert linked_rows(parts).count() == 0
