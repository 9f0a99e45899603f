import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.functions import grid as G
from leafmill.functions.markup_table import Cell, read_table
from leafmill.operators import tables


def html(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


@pytest.mark.parametrize("text", [None, "", "no table", "<table></table>", "<table><tr></tr></table>", "<table", "</table>"])
def test_nothing_to_read(text):
    assert read_table(text) == []
    assert not G.health(text)["healthy"]


def test_reader():
    rows = read_table("x<TABLE><thead><tr><th>A<th colspan=2>B</thead><tr><td>1<br>2<td rowspan='x'><p>a</p><p>b</p><td><img><input type=checkbox checked></table>")
    assert [h for _, h in rows] == [True, False]
    assert rows[0][0] == [Cell("A"), Cell("B", 2)]
    assert rows[1][0][0].text == "1\n2" and rows[1][0][1].blocks == (("text", "a"), ("text", "b")) and rows[1][0][2] == Cell("☑", 1, 1, 1)
    inner = read_table("<table><tr><td>o<table><tr><td>i</td></tr></table></td></tr></table>")
    assert inner[0][0][0].blocks[1][0] == "table" and inner[0][0][0].text == "o\ni"
    assert len(read_table(html([["same"]] * 5))) == 1
    assert len(read_table(html([[k] for k in range(500)]))) == 200


def test_health_of_good_and_bad_tables():
    good = G.health(html([[f"r{r}c{c}" for c in range(12)] for r in range(25)]))
    assert good["healthy"] and (good["cols"], good["n_rows"], good["full_rows"], good["placed"]) == (12, 25, 25, 300)
    run = G.health(html([[f"v{k}" for k in range(300)]]))
    assert not run["healthy"] and (run["cols"], run["placed"], run["widest_row"]) == (40, 40, 300)
    same = G.health(html([[f"{r}", *["ok"] * 6] for r in range(20)]))
    assert same["degenerate"] and not same["healthy"]
    assert G.health(html([["a", "b"], ["c", "d"]]), ruled=3)["missing_columns"]
    assert (lambda h: (h["cols"], h["n_rows"], h["full_rows"]))(G.health(html([["a", "b", "c"], ["d", "e"]]))) == (3, 2, 1)


def test_content_guard():
    old = html([["15.53", "ok"], ["16", "ok"]])
    assert not G.keeps_content(old, html([["15.58", "ok"], ["16", "ok"]]))
    assert G.keeps_content(old, html([["15.53", "ok"], ["16", "ok"], ["17", "new"]]))
    assert G.keeps_content(html([[k, "ok"] for k in range(20)]), html([[k, "ok" if k < 15 else "x"] for k in range(20)]))
    assert not G.keeps_content(html([[k, "ok"] for k in range(20)]), html([[k, "ok" if k < 14 else "x"] for k in range(20)]))


def test_pictures_columns_and_headers():
    grid = G.build(read_table("<table><tr><td><img></td><td>a</td></tr><tr><td></td><td><img></td></tr></table>"))
    assert G.pictures_to_cells(grid, [(25, 25), (75, 75), (25, 75)], 100, 100) == [(0, 0, 0), (1, 1, 1), (2, 1, 0)]
    assert G.dropped_column(grid, [1.0, 0.9]) == 0 and G.dropped_column(grid, [1.0, 0.2]) is None and G.dropped_column(grid, [1.0]) is None
    assert [[c.text for c in cells] for cells, _ in G.with_blank_column([([Cell("a"), Cell("b")], False)], 0)] == [["", "a", "b"]]
    head = G.build(read_table("<table><tr><td>A</td><td></td><td>B</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"))
    assert G.headers_over_groups(head) == [(0, 2), (2, 1)]
    assert G.column_weights(G.build(read_table(html([["a", "x" * 9], ["bb", "y y"], ["cccc", "z"]])))) == [4, 9]


def test_parallel_blocks_become_a_subtable():
    rows = read_table("<table><tr><td><p>a</p><p>b</p></td><td><p>1</p><p>2</p></td><td></td></tr></table>")
    cell = G.with_subtables(rows)[0][0][0]
    assert cell.colspan == 2 and [[c.text for c in r] for r, _ in cell.blocks[0][1]] == [["a", "1"], ["b", "2"]]
    full = read_table("<table><tr><td><p>a</p><p>b</p></td><td><p>1</p><p>2</p></td><td>x</td></tr></table>")
    assert G.with_subtables(full) == full


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["", "a", "b c"]), st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=5), min_size=1, max_size=6))
def test_cells_never_overlap_and_stay_inside(shape):
    grid = G.build([([Cell(*c) for c in row], False) for row in shape])
    seen = set()
    for p in grid.anchored():
        for r in range(p.row, p.row + p.rowspan):
            for c in range(p.col, p.col + p.colspan):
                assert (r, c) not in seen and 0 <= r < grid.rows and 0 <= c < grid.columns
                seen.add((r, c))
    assert seen == {(r, c) for r in range(grid.rows) for c in range(grid.columns) if grid.owner[r, c] != G.FREE}


def test_frames(spark):
    df = spark.createDataFrame([("t", html([["a", "b"], ["c", "d"]]), 1), ("n", None, 2), ("e", "", 3)], "table_id string, html string, cols int")
    assert tables.cells(df).count() == 4 and tables.raw_cells(df).count() == 4
    assert {r.table_id: r.healthy for r in tables.health(df).collect()} == {"t": True, "e": False}
    assert tables.weights(df).count() == 2
    assert tables.covered(tables.cells(df)).count() == 4
    assert tables.cells(df.where("false")).count() == 0
    chain = spark.createDataFrame([(1, "a", 0, 0, 5.0, 1.0, 3, False, None), (1, "b", 1, 0, 5.0, 1.0, 3, False, None), (1, "c", 2, 0, 5.0, 1.0, 4, False, None), (1, "d", 3, 0, 500.0, 1.0, 4, False, None), (1, "e", 4, 0, 5.0, 1.0, 4, True, None)],
                                  "doc_id long, table_id string, page_index int, entry_idx int, y1 double, zoom double, cols int, has_head boolean, header_y2 double")
    assert {r.table_id: r.chain_id for r in tables.chains(chain).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}


def test_widths_and_shares():
    assert G.display_width("ab中") == 4 and G.longest_word("ab 中文cdef") == 4 and G.least_width("x" * 16) == 8 and G.least_width("x" * 400) == 22 and G.least_width("") == 0
    assert G.row_shares(6, [10, 20, 30]) == [1, 2, 3] and G.row_shares(2, [1, 1, 1]) == [1, 1] and sum(G.row_shares(7, [100, 1, 1])) == 7
    assert G.natural_width_pt(G.build([]), 10) == 0.0 and G.natural_width_pt(G.build(read_table(html([["abc", "d"]]))), 10) == pytest.approx(61.6)


def test_rows_of_all_tables_of_a_text():
    text = html([["a", "b"], ["c", "d"]]) + "<p>between</p>" + html([["c", "d"], ["e", "f"]]) + "<table><tr><td>cut off"
    assert [[c.text for c in cells] for cells, _ in read_table(text)] == [["a", "b"], ["c", "d"], ["e", "f"], ["cut off"]]
    assert len(read_table(html([[k] for k in range(150)]) + html([[k] for k in range(150)]))) == 200
