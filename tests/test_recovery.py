import pytest
from pyspark.sql import functions as F

from leafmill.functions import blocks
from leafmill.operators import layout, recovery
from tests.test_layout import entry, frame


@pytest.mark.parametrize("text, want", [(None, None), ("", ""), ("<p>a  b</p><p>c<br>d</p>", "a b\nc\nd"), ("<input type=checkbox checked> x &amp; y", "☑ x & y"), ("a < b", "a < b")])
def test_block_text(text, want):
    assert blocks.block_text(text) == want


def test_lists_and_tables():
    assert blocks.list_text("<ol start=3 type=a><li>x<ul><li>y</ul><li>z</ol>") == "c. x\n  - y\nd. z"
    assert blocks.list_text("<ol type=i>" + "<li>x" * 16 + "</ol>").split("\n")[13:] == ["xiv. x", "xv. x", "16. x"]
    assert blocks.numeral(27, "A") == "A" and blocks.list_text(None) is None and blocks.list_text("") == ""
    assert blocks.outside_tables("a<table>b<table>c</table></table>d<table>e") == "ad"


def test_frames_and_span_styles(spark):
    df = spark.createDataFrame([("event: a\ndata: 1\ndata: 2\n\n\ndata: x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(blocks.frames(F.col("t"))).collect()] == [[("a", "1\n2"), ("", "x")], [], None]
    s = spark.createDataFrame([(16, "x", 0xFF8000), (2, "Arial-Black", 0)], "f int, n string, c int").select(*blocks.span_style(F.col("f"), F.col("n"), F.col("c"))).collect()
    assert [tuple(r) for r in s] == [(True, False, 255, 128, 0), (True, True, 0, 0, 0)]


def test_styles_captions_and_pictures(spark):
    e = frame(spark, entry(0, [0, 0, 100, 50], "Table"), entry(1, [0, 60, 100, 70], "Caption"), entry(2, [500, 600, 510, 610], "Caption"), entry(3, [0, 80, 100, 90]))
    assert [(r.entry_idx, r.owner_idx, r.gap) for r in recovery.captions(e).collect()] == [(1, 0, 10)]
    spans = spark.createDataFrame([(1, 0, 0, 0, 0, 10, 10, 5, "A"), (1, 0, 1, 20, 0, 30, 10, 9, "B"), (1, 0, 2, 40, 0, 50, 10, 5, "A")], "doc_id long, page_index int, span_idx int, x1 int, y1 int, x2 int, y2 int, n_chars int, font string")
    best = recovery.styled(e, spans, ["font"]).collect()
    assert [(r.entry_idx, r.font, r.weight) for r in best] == [(0, "A", 10)]
    rasters = frame(spark, entry(8, [0, 0, 100, 50]), entry(9, [200, 200, 260, 260]), entry(10, [300, 300, 305, 305]))
    assert [r.entry_idx for r in recovery.lost_pictures(rasters, e).collect()] == [9]


def test_boxes_turns_rules_and_readers(spark):
    e = frame(spark, entry(0, [0, 0, 10, 10], text="Accepted: yes no"), entry(1, [0, 0, 10, 10], text="Ok: ○ yes no"), entry(2, [0, 0, 10, 30], text="up"), entry(3, None, text=None), entry(4, None, "Table", text="x: yes no"), entry(5, None, text="no, the answer is no"), entry(6, None, "Form", text="结果：是 否"), entry(7, None, text="Yes and no"))
    cand = recovery.box_candidates(e)
    assert [r.entry_idx for r in cand.collect()] == [0, 6]
    cand = cand.where("entry_idx = 0")
    new = cand.select(*layout.ENTRY, F.lit("Accepted: ☑ yes ☐ no").alias("new_text"))
    assert recovery.taken_boxes(cand, new).count() == 1 and recovery.taken_boxes(cand, new.withColumn("new_text", F.lit("☑ no"))).count() == 0
    assert [r.entry_idx for r in recovery.turn_candidates(e).collect()] == [2]
    rules = spark.createDataFrame([(1, float(y)) for y in (0, 5, 12, 40, 47, 100)], "g int, y double")
    assert sorted((r.position, r.n_rules) for r in recovery.merged_rules(rules, ["g"], "y").collect()) == [(0.0, 3), (40.0, 2), (100.0, 1)]
    pages = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, page_index int")

    def reader(row):
        if row["page_index"]:
            raise ValueError("bad page")
        return "text"

    assert sorted(tuple(r) for r in recovery.read_pages(pages, reader).collect()) == [(1, 0, "text", None), (1, 1, None, "bad page")]
    heats = []
    assert [r.error for r in recovery.read_pages(pages.where("page_index = 0"), lambda row, heat: {}[heat], 3).collect()] == ["0.4"] and heats == []
    assert {r.scan_type for r in recovery.scan_types(e.where("entry_idx in (1, 2)")).collect()} == {"scanned"}
    lines = frame(spark, *(entry(k, None, text="ten chars ") for k in range(4)))
    assert {r.scan_type for r in recovery.scan_types(lines).collect()} == {"native"}


def test_markdown_rows_and_emphasis(spark):
    df = spark.createDataFrame([("| a | b |\n|---|---|\n| 1 | |\nplain\n| | |\nx | y",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(blocks.markdown_rows(F.col("t"))).collect()] == [[["a", "b"], ["1", ""], ["x", "y"]], [], None]
    assert blocks.emphasised("<b>bold</b> x") == (True, False) and blocks.emphasised("<i>a</i> long text") == (False, False) and blocks.emphasised(None) == (False, False)


def test_sizes(spark):
    from leafmill.functions import geometry as G

    df = spark.createDataFrame([("a" * 30, 70, 20.0, 1.0), ("a\nb\nc", 700, 30.0, 1.0), (None, 10, 500.0, 1.0), ("x", 0, 10.0, 1.0)], "t string, w int, h double, z double")
    lines = G.estimated_lines(F.col("t"), F.col("w"), F.col("z"), F.lit(0))
    assert [r[0] for r in df.select(lines).collect()] == [3, 3, 1, 7]
    assert [r[0] for r in df.select(G.estimated_size(F.col("h"), F.lit(1), F.col("z"))).collect()] == [14.0, 21.0, 11.0, 7.0]
    assert [tuple(r) for r in spark.range(1).select(*G.recentred(F.lit(10), F.lit(100), F.lit(40)), *G.recentred(F.lit(10), F.lit(30), F.lit(40))).collect()] == [(40, 40, 10, 30)]
