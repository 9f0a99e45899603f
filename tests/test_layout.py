from pyspark.sql import functions as F

from leafmill.functions import geometry as G
from leafmill.operators import layout

SCHEMA = "doc_id long, page_index int, entry_idx int, category string, text string, bbox array<int>, rotation double, source string, page_width_pt double, page_height_pt double, zoom double"


def entry(idx, box, category="Text", text="t", rotation=None, source=None, page=0, doc=1):
    return (doc, page, idx, category, text, box, rotation, source, 600.0, 800.0, 1.0)


def frame(spark, *rows):
    return layout.entries(spark.createDataFrame(list(rows), SCHEMA))


def test_entries_in_one_form(spark):
    e = frame(spark, entry(0, [9, 8, 1, 2], "page-header"), entry(0, [9, 8, 1, 2], "page-header"), entry(1, None, None, None, 88.0), entry(2, [1, 2], " ", "x", float("nan")), entry(3, []))
    got = {r.entry_idx: r for r in e.collect()}
    assert len(got) == e.count() == 4
    assert (got[0].x1, got[0].y1, got[0].x2, got[0].y2, got[0].category) == (1, 2, 9, 8, "Page-Header")
    assert got[1].rotation == 90.0 and got[1].x1 is None and got[2].rotation == 0.0 and got[2].category is None and got[3].x1 is None


def test_orders(spark):
    e = frame(spark, entry(0, [0, 50, 9, 60]), entry(1, [5, 10, 9, 20]), entry(2, [0, 10, 4, 20]), entry(3, None))
    assert [r.entry_idx for r in layout.reading_order(e).orderBy("place").collect()] == [3, 2, 1, 0]
    turned = frame(spark, *(entry(k, b, rotation=90.0) for k, b in enumerate([[50, 0, 60, 9], [10, 0, 20, 5], [10, 0, 20, 9]])))
    assert [r.entry_idx for r in layout.reading_order(turned, turned=True).orderBy("place").collect()] == [2, 1, 0]


def test_overlap_containment_and_room(spark):
    e = frame(spark, entry(0, [0, 0, 10, 10]), entry(1, [0, 0, 10, 10]), entry(2, [2, 20, 8, 30]), entry(3, [100, 0, 110, 10]), entry(4, None), entry(0, [0, 0, 10, 10], page=1))
    assert [(r.a_entry_idx, r.b_entry_idx, r.iou) for r in layout.overlapping(e).collect()] == [(0, 1, 1.0)]
    below = {(r.page_index, r.entry_idx): r.room for r in layout.room(e, "below").collect()}
    assert below[0, 0] == 10 and below[0, 2] is None and below[1, 0] is None and (0, 4) not in below
    assert {(r.page_index, r.entry_idx): r.room for r in layout.room(e, "right").collect()}[0, 0] == 90
    inner = frame(spark, entry(9, [1, 1, 2, 2]), entry(8, [500, 500, 501, 501]))
    assert [(r.entry_idx, r.owner_idx) for r in layout.owners(inner, e).collect()] == [(9, 0)]
    assert [r.entry_idx for r in layout.outside(inner, e).collect()] == [8]
    assert {r.entry_idx for r in layout.first_of_box(e.where("page_index = 0")).collect()} == {0, 2, 3, 4}
    places = {r.entry_idx: r.place for r in layout.insert_places(inner, e).collect()}
    assert places == {9: 2, 8: 5}
    assert layout.overlapping(e.where("false")).count() == 0


def test_styles_turns_and_clusters(spark):
    spans = spark.createDataFrame([(1, "A", 3, 0), (1, "B", 2, 1), (1, "B", 1, 2), (1, "C", 3, 3)], "g int, font string, n int, idx int")
    best = layout.dominant(spans, ["font"], ["g"], "idx", F.col("n")).first()
    assert (best.font, best.weight) == ("A", 3)
    tall = frame(spark, *(entry(k, [0, 100 * k, 5, 100 * k + 50], rotation=90.0) for k in range(4)))
    assert layout.tall_pages(tall).first().turned and layout.turned_area(tall).first().page_turned
    back = {r.entry_idx: r for r in layout.derotated(tall).collect()}[0]
    assert (back.x1, back.y1, back.x2, back.y2, back.page_width_px, back.page_height_px) == (750, 0, 800, 5, 800, 600)
    e = frame(spark, entry(0, [0, 0, 10, 10]), entry(1, [0, 12, 10, 22]), entry(2, [0, 24, 10, 34]), entry(3, [300, 300, 310, 310]), entry(4, None))
    clusters = layout.connected(e)
    assert {r.entry_idx: r.cluster for r in clusters.collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    boxes = {r.cluster: (r.x1, r.y1, r.x2, r.y2) for r in layout.cluster_boxes(e, clusters).collect()}
    assert boxes[0] == (0, 0, 10, 34)


def test_markdown_and_shares(spark):
    e = frame(spark, entry(0, [0, 9, 1, 10], "Section-Header", "T"), entry(1, [0, 20, 1, 30], "Text", " a "), entry(2, [0, 1, 1, 2], "Page-Header", "head"), entry(3, None, "Text", None), entry(4, [0, 30, 1, 40], "Equation-Block", "x"))
    assert layout.markdown(e).first().markdown == "\n".join(["## head\n", "## T\n", " a \n", "$$\nx\n$$\n"])
    kinds = ["Title", "Image", "Figure", "Table", "Table", "Code-Block", "Diagram", "Caption", "Page-Footer", "Unheard-Of", "List-Group", "Text"]
    texts = ["t", " alt ", None, "<table>", "x", "c", "g", "cap", "foot", "u", "- l", ""]
    every = frame(spark, *(entry(k, [0, 10 * k, 1, 10 * k + 5], c, x) for k, (c, x) in enumerate(zip(kinds, texts))))
    want = ["# t", "![alt](Image detected)", "![Image](Image detected)", "<table>", "**Table:** x", "```\nc\n```", "```mermaid\ng\n```", "*cap*", "^foot^", "u", "- l"]
    assert layout.markdown(every).first().markdown == "\n".join(x + "\n" for x in want)
    assert layout.markdown(every.withColumn("image_url", F.lit("u.png"))).first().markdown.split("\n")[2] == "![alt](u.png)"
    assert layout.empty_share(e, 2, 0.1).first().n_empty == 1
    assert layout.page_windows(e, 2).first().n_entries == 5


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 0.0, 10.0, 30.0, 4), (0.0, 0.0, 10.0, 5.0, 30.0, 10.0, 4), (0.0, 0.0, 10.0, 0.0, 30.0, 10.0, 1)], "a double, b double, c double, d double, w double, h double, n int")
    got = [round(r[0], 2) for r in df.select(G.line_rotation(*(F.col(c) for c in "abcdwhn"))).collect()]
    assert got == [90.0, 26.57, 0.0]
    angles = spark.createDataFrame([(-3.0,), (272.0,), (45.0,), (None,), (float("inf"),), (359.0,)], "a double")
    assert [r[0] for r in angles.select(G.quarter_turn(F.col("a"))).collect()] == [0.0, 270.0, 45.0, 0.0, 0.0, 0.0]
