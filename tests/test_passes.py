import pytest
from pyspark.sql import functions as F

from leafmill.functions import page_html
from leafmill.operators import measures, passes
from tests.test_layout import entry, frame

PAGES = [
    ('<div data-bbox="0 0 500 100" data-label="Title">A &amp; b</div>', [("Title", [0, 0, 100, 30], "A & b", None)]),
    ('<div data-bbox="0 0 500 100">no label<br>two</div>', [("Text", [0, 0, 100, 30], "no label\ntwo", None)]),
    ('<div data-label="Blank-Page" data-bbox="0 0 1 1"></div>', []),
    ('<div data-label="Text" data-bbox="0 0 x 1">a</div><div data-label="Text">b</div><div data-label="Text" data-bbox="1 2 3">c</div>', []),
    ('<div data-label="Text" data-bbox="-5 0 1200 1000">wide</div>', [("Text", [0, 0, 200, 300], "wide", None)]),
    ('<div data-label="Figure" data-bbox="0 0 10 10"><p>x</p><img alt="a &quot;b&quot;"/></div>', [("Figure", [0, 0, 2, 3], 'a "b"', None)]),
    ('<div data-label="Image" data-bbox="0 0 10 10">text</div>', [("Image", [0, 0, 2, 3], "", None)]),
    ('<div data-label="Diagram" data-bbox="0 0 10 10">graph</div>', [("Image", [0, 0, 2, 3], "graph", "diagram-recovered")]),
    ('<div data-label="Diagram" data-bbox="90 0 10 10">graph</div>', [("Diagram", [18, 0, 2, 3], "graph", None)]),
    ('<div data-label="Form" data-bbox="0 0 10 10"><table data-bbox="1 2 3 4"><tr><td class="x" data-bbox="0 0 1 1"><math>Q_1</math></td></tr></table></div>', [("Table", [0, 0, 2, 3], '<table><tr><td class="x">$Q_1$</td></tr></table>', None)]),
    ('<div data-label="Equation-Block" data-bbox="0 0 10 10"><math>a &lt; b</math> and <math> c </math></div>', [("Equation-Block", [0, 0, 2, 3], "a < b c", None)]),
    ('<div data-label="Equation-Block" data-bbox="0 0 10 10">$$x$$</div>', [("Equation-Block", [0, 0, 2, 3], "x", None)]),
    ('<div data-label="List-Group" data-bbox="0 0 10 10"><ol start="2"><li>a<li>b</ol></div>', [("List-Group", [0, 0, 2, 3], "2. a\n3. b", None)]),
    ('<div data-label="Text" data-bbox="0 0 10 10">in <math>x</math> line <div>inner</div> after</div>', [("Text", [0, 0, 2, 3], "in $x$ line \ninner\nafter".replace(" \n", "\n"), None)]),
    ('<html><body><div><div data-label="Text" data-bbox="0 0 10 10">held</div></div></body></html>', [("Text", [0, 0, 2, 3], "held", None)]),
    ('<div data-label="Text" data-bbox="0 0 10 10">never closed', [("Text", [0, 0, 2, 3], "never closed", None)]),
    ("plain words", []), ("", []), (None, []),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_pages_of_a_model(page, want):
    got = page_html.entries_of_page(page, 200, 300)
    assert [(c, b, t, s) for c, b, t, s in got] == [(c, b, t, s) for c, b, t, s in want]


def test_frames_of_pages(spark):
    rows = [(1, k, p, 200, 300, "clash") for k, (p, _) in enumerate(PAGES)] + [(2, 0, '<div data-bbox="0 0 1000 1000">' + "long " * 50_000 + "</div>", None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, html string, width_px int, height_px int, text string")
    got = passes.read_pages_html(df).collect()
    assert len(got) == 1 + sum(len(w) for _, w in PAGES) and all(r.x2 == 0 for r in got if r.doc_id == 2)
    assert passes.read_pages_html(df.where("false")).count() == 0


def test_labels_above_tables(spark):
    e = frame(spark, entry(0, [0, 100, 100, 200], "Table"), entry(1, [0, 150, 50, 160], "Caption"), entry(2, [0, 50, 50, 60], "Title"), entry(3, [0, 2, 50, 4], "Table"), entry(4, [0, 1, 50, 3], "Caption"), entry(5, None, "Caption"))
    got = {r.entry_idx: (r.y1, r.y2) for r in passes.lifted(e).collect()}
    zoom = e.first().zoom
    assert got == {1: (100 - 4 * zoom - 10, 100 - 4 * zoom), 4: (0.0, 2.0)}
    assert passes.lifted(e.where("false")).count() == 0


def test_pages_turned_back(spark):
    e = frame(spark, entry(0, [0, 0, 10, 100]), entry(1, [20, 0, 30, 100]), entry(2, [40, 10, 50, 60]), entry(3, [60, 500, 61, 501]))
    e = e.withColumn("rotation", F.when(F.col("entry_idx") < 2, 90.0).otherwise(0.0)).withColumn("zoom", F.lit(1.0))
    got = {r.entry_idx: r for r in passes.turned_back(e).collect()}
    h = e.first().page_height_pt
    assert len(got) == 4 and {r.angle for r in got.values()} == {90.0} and (got[0].x1, got[0].y1, got[0].x2, got[0].y2) == (h - 100, 0, h, 10)
    assert {r.rotation for r in got.values()} == {0.0} and got[0].page_width_pt == h
    # Two angles as frequent: the smaller; too little area: none.
    both = e.withColumn("rotation", F.when(F.col("entry_idx") == 0, 90.0).when(F.col("entry_idx") == 1, 270.0).otherwise(0.0))
    assert {r.angle for r in passes.page_angles(both).collect()} == {90.0}
    assert passes.page_angles(e.withColumn("rotation", F.when(F.col("entry_idx") == 3, 90.0).otherwise(0.0))).count() == 0
    assert passes.page_angles(e.withColumn("rotation", F.lit(0.0))).count() == 0


def test_pictures_and_styles(spark):
    e = frame(spark, entry(0, [0, 0, 9, 9], "Image"), entry(1, [0, 0, 9, 9], "Figure"), entry(2, [1, 0, 9, 9], "Diagram"), entry(3, None, "Image"), entry(4, None, "Title"), entry(5, None, None))
    names = {r.entry_idx: r.filename for r in passes.numbered_pictures(e).collect()}
    assert set(names) == {0, 2, 3} and names[0].startswith("page1_pic1_") and names[3].startswith("page1_pic3_")
    off = passes.without_pictures(e.withColumn("source", F.when(F.col("entry_idx") == 0, "diagram-recovered")))
    assert {r.entry_idx: r.category for r in off.collect()} == {0: "Diagram", 2: "Diagram", 4: "Title", 5: None}
    assert [(r.size, r.bold) for r in passes.base_styles(e).where("entry_idx > 3").orderBy("entry_idx").collect()] == [(14.0, True), (10.5, False)]


def test_second_readings_and_turned_tables(spark):
    e = frame(spark, entry(0, [0, 0, 100, 100], "Table", text="<td><IMG></td>"), entry(1, [1, 1, 5, 9]), entry(2, [6, 1, 10, 9]), entry(3, [300, 0, 310, 1]))
    got = passes.reread_candidates(e.where("entry_idx = 0"), e.where("entry_idx > 0")).collect()
    assert [(r.entry_idx, r.n_images, r.n_rasters) for r in got] == [(0, 1, 2)]
    cases = [(3, 3, 1, 2, 2, True), (3, 2, 1, 2, 2, False), (0, 0, 0, 1, 1, False), (3, 4, 1, 1, 2, False), (3, 4, 1, 3, 2, False)]
    df = spark.createDataFrame(cases, "a int, b int, c int, d int, e int, want boolean")
    assert df.where(passes.reread_taken(*(F.col(c) for c in "abcde")) != F.col("want")).count() == 0
    assert [(r.n_lines, r.tall_share, r.turned) for r in passes.turned_things(e.where("entry_idx = 0"), e.where("entry_idx in (1, 2)"), 2).collect()] == [(2, 1.0, True)]
    assert [tuple(r) for r in spark.range(1).select(passes.detector_scale(F.lit(3200), F.lit(10)), passes.detector_scale(F.lit(20), F.lit(10)), *passes.image_page(F.lit(96), F.lit(48))).collect()] == [(0.5, 1.0, 72.0, 36.0, 96 / 72)]


def test_measures(spark):
    df = spark.createDataFrame([(1, v, k) for k, v in enumerate([3, 1, 3, 1, 7, None, 2])] + [(2, None, 0)], "g int, v int, k int")
    assert [tuple(r) for r in measures.smallest_mode(df, ["g"], "v").collect()] == [(1, 1, 2)]
    assert [tuple(r) for r in measures.upper_median(df, ["g"], "v").collect()] == [(1, 3)]
    assert [tuple(r) for r in measures.top_share(df, ["g"], "v", 6, 0.3).collect()] == [(1, 6, 0.333333, True)]
    assert [(r.g, r.k, r["size"]) for r in measures.largest(df.where("v is not null"), ["g"], F.col("v") % 3, "k").collect()] == [(1, 6, 2)]
    assert [(r.k, r["rank"]) for r in measures.tallest(df.where("v is not null"), ["g"], F.col("v"), "k", 2).collect()] == [(4, 1), (0, 2)]
    spans = spark.createDataFrame([(1, 0, 10), (1, 2, 3), (1, 9, 12), (1, 20, 21), (1, None, 5)], "g int, a int, b int")
    assert [(r["from"], r["to"], r.n) for r in measures.bands(spans, ["g"], "a", "b").orderBy("from").collect()] == [(0, 12, 3), (20, 21, 1)]
    assert [(r["from"], r["to"]) for r in measures.bands(spans, ["g"], "a", "b", 8).collect()] == [(0, 21)]
    more = df.where("v is not null").unionByName(spark.createDataFrame([(1, 9, 0)], "g int, v int, k int"))
    assert [tuple(r) for r in measures.superset(df, more, ["g"], "v").collect()] == [(1, True, 0)]
    assert [tuple(r) for r in measures.superset(df, more.where("k > 0"), ["g"], "v").collect()] == [(1, False, 1)]
    assert all(m.count() == 0 for m in (measures.smallest_mode(df.where("false"), ["g"], "v"), measures.superset(df.where("false"), df, ["g"], "v"), measures.bands(spans.where("false"), ["g"], "a", "b")))


def test_ids_and_listings(spark):
    from leafmill.operators import records

    good = "0b0e7c1e-0000-4000-8000-00000000000A"
    df = spark.createDataFrame([(good, "o", "ok"), ("x", None, "error"), (None, "o", "error")], "id string, owner_id string, status string")
    assert [r.id for r in records.by_id_policy(df, "id", "drop").collect()] == [good]
    assert [r.error for r in records.by_id_policy(df, "id", "mark").collect()] == [None, "not an id: x", "not an id: null"]
    with pytest.raises(Exception, match="not an id"):
        records.by_id_policy(df, "id", "reject").collect()
    assert records.where_owned(df, None, "ok").count() == 3 and records.where_owned(df, "o", "ok").count() == 1
    changes = spark.createDataFrame([(good, None, "queued", ["owner_id"])], "id string, owner_id string, status string, fields array<string>")
    got = {r.id: (r.owner_id, r.status) for r in records.patched(df, changes, "id", ["owner_id", "status"], named="fields").collect()}
    assert got[good] == (None, "ok") and got["x"] == (None, "error")
