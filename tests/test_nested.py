import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.operators import nested

PAGE = {"page_index": "7", "entries": [{"category": "Text", "text": "a", "bbox": [1, 2, 3, 4]}, None, {"category": "Image", "diagram_regions": [{"text": "r"}, None]}]}


def rows(text, doc_id=1):
    return list(nested.subtree_rows(doc_id, text))


def found(text):
    return [(r[3], r[4], r[5]) for r in rows(text) if r[1] in ("entry", "region") and r[8] is not None]


@pytest.mark.parametrize("text", [None, "", " ", "{", "[1,", "null", "3", '{"pages": 3}', '"[1,"', "[NaN]", '{"a": []}'])
def test_damaged_layouts_give_no_rows(text):
    assert rows(text) == []


def test_shapes_of_pages_and_regions():
    assert sorted(found(json.dumps([PAGE]))) == [(7, 0, -1), (7, 2, -1), (7, 2, 0)]
    assert found(json.dumps({"version": 1, "pages": [PAGE]})) == found(json.dumps([PAGE]))
    assert found(json.dumps(json.dumps([PAGE]))) == found(json.dumps([PAGE]))
    assert found(json.dumps([[{"text": "x"}, {"diagram_regions": {"text": "one"}}]])) == [(0, 0, -1), (0, 1, 0), (0, 1, -1)]
    assert found(json.dumps([None, {"layout_result": [{}]}])) == [(1, 0, -1)]
    assert found("[]") == []


def test_equal_objects_have_one_identity_and_every_place_a_row():
    box, other = {"text": "x", "bbox": [1, 2, 3, 4]}, {"bbox": {"x1": 1, "y1": 2, "x2": 3, "y2": 4}, "text": "x", "style": None}
    out = rows(json.dumps([{"entries": [box, other]}, {"entries": [box, box]}]))
    ids = [r[8] for r in out if r[1] == "entry"]
    assert len(ids) == 4 and len(set(ids)) == 1
    pages = [r[8] for r in out if r[1] == "page"]
    assert pages[0] == pages[1]
    assert {r[7] for r in out if r[1] == "entry"} == set(pages)
    assert [r for r in out if r[1] == "document"][0][8] in {r[7] for r in out if r[1] == "page"}


def test_order_of_children_counts():
    a, b = {"text": "a"}, {"text": "b"}
    ids = [r[8] for p in ([a, b], [b, a]) for r in rows(json.dumps([p])) if r[1] == "page"]
    assert ids[0] != ids[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.none(), st.fixed_dictionaries({}, optional={"text": st.text(max_size=5), "diagram_regions": st.one_of(st.none(), st.lists(st.one_of(st.none(), st.just({"text": "r"})), max_size=3))})), max_size=4)), max_size=4))
def test_counts_against_plain_walk(pages):
    want = [(p, i, k) for p, es in enumerate(pages) if es is not None for i, e in enumerate(es) if e is not None for k in [-1, *[j for j, r in enumerate(e.get("diagram_regions") or []) if r is not None]]]
    assert sorted(found(json.dumps(pages))) == sorted(want)


def test_tables_of_a_frame(spark):
    df = spark.createDataFrame([(1, json.dumps([PAGE]), "x"), (1, json.dumps([PAGE]), "y"), (2, None, None), (3, "{", None)], "doc_id long, layout string, object_id string")
    bridge = nested.occurrences(df)
    flat = nested.flat_tables(bridge)
    assert {k: v.count() for k, v in flat.items()} == {"documents": 2, "pages": 2, "entries": 4, "regions": 2, "parts": 0}
    assert flat["entries"].where("entry_idx = 0").first().x2 == 3
    assert {r.places for r in nested.objects(bridge).collect()} == {2}
    assert nested.found(df.where("false")).collect() == []
    assert nested.found(df).count() == 6


def test_very_long_layout(spark):
    long = json.dumps([{"entries": [{"text": "é" * 200_000}] * 3}])
    assert nested.found(spark.createDataFrame([(1, long)], "doc_id long, layout string")).count() == 3


def test_damaged_boxes():
    assert nested.bbox_of("1, 2,3 4") == [1, 2, 3, 4]
    assert nested.bbox_of([1.4, 2, 3, None]) is None
    assert nested.bbox_of({"x1": 1}) is None
    assert nested.bbox_of([]) is None and nested.bbox_of([1, 2, 3, float("inf")]) is None and nested.bbox_of("1,2,3,nan") is None


def test_boxes_keep_their_fractions():
    a, b, c = ({"bbox": box} for box in ([10.4, 1, 2, 3], [10.1, 1, 2, 3], "10.40 1.0 2 3"))
    ids = [r[8] for r in rows(json.dumps([[a, b, c]])) if r[1] == "entry"]
    assert ids[0] == ids[2] != ids[1]
    assert [json.loads(r[9])["bbox"] for r in rows(json.dumps([[a, b]])) if r[1] == "entry"] == [[10.4, 1, 2, 3], [10.1, 1, 2, 3]]


DEEP = {"text": "x", "style": {"font": "F", "size": 9.0}, "lines": [{"spans": [{"t": "a"}, None, {"t": "b", "more": {"0": {"k": 1}}}]}, None, 5, [{"q": 1}, []]], "list": [1, 2.5], "a/b~": {"c": None}}


def test_objects_at_any_depth_have_rows_and_identities():
    out = rows(json.dumps([[DEEP, {"diagram_regions": [DEEP]}]]))
    paths = {r[6]: r for r in out if r[1] == "part" and r[4] == 0}
    assert set(paths) == {"/style", "/lines/0", "/lines/0/spans/0", "/lines/0/spans/1", "/lines/0/spans/2", "/lines/0/spans/2/more", "/lines/0/spans/2/more/0", "/lines/1", "/lines/2", "/lines/3/0", "/lines/3/1", "/a~1b~0"}
    assert paths["/lines/0/spans/1"][8] is None and paths["/lines/0/spans/2"][7] == paths["/lines/0"][8]
    entry, region = (next(r for r in out if r[1] == kind) for kind in ("entry", "region"))
    assert paths["/style"][7] == entry[8] and json.loads(entry[9]) == {"text": "x", "list": [1, 2.5]}
    assert {r[8] for r in out if r[6] == "/style"} == {paths["/style"][8]} and len([r for r in out if r[6] == "/style"]) == 2
    assert any(r[7] == region[8] for r in out if r[6] == "/style")


VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.floats(allow_nan=False, allow_infinity=False, width=32), st.text(max_size=4)),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(st.sampled_from(["a", "0", "1", "x/y", "~", "bbox", "style", "diagram_regions"]), inner, max_size=3)), max_leaves=12,
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(VALUES, max_size=3), st.fixed_dictionaries({}, optional={"entries": st.lists(VALUES, max_size=3), "layout_result": st.lists(VALUES, max_size=2), "zoom": VALUES, "extra": VALUES})), max_size=3), st.dictionaries(st.sampled_from(["version", "0", "meta"]), VALUES, max_size=2))
def test_the_tables_give_the_layout_back(pages, other):
    text = json.dumps(other | {"pages": pages})
    out = [dict(zip(nested.OCCURRENCE.names, r)) for r in rows(text)]
    assert json.loads(nested._together(out)) == json.loads(nested.canonical_layout(text))


def test_rebuilt_from_objects_stored_once(spark):
    texts = [json.dumps([PAGE]), json.dumps({"version": 2, "pages": [[DEEP, DEEP], None, PAGE]}), "[]", json.dumps(json.dumps([PAGE])), None, "{"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, layout string")
    bridge = nested.occurrences(df)
    assert {r.doc_id: r.layout for r in nested.rebuilt(bridge, nested.objects(bridge)).collect()} == {k: nested.canonical_layout(t) for k, t in enumerate(texts) if t not in (None, "{")}
