"""Rows of cells placed on a grid, and the repairs that recognised tables need.

A grid is a matrix that names for every square the cell that covers it, so
each repair is a question to slices of the matrix: which squares are free,
where a column's last cell ends, which cell reaches into a row from above.
The order of the repairs matters: sub-tables first, then spans of rows, then
the placing, then labels and gaps at the bottom.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter

import numpy as np

from leafmill.functions.markup_table import MOST_COLUMNS, Cell, Row, read_table

FREE = -1


@dataclasses.dataclass
class Placed:
    row: int
    col: int
    cell: Cell
    colspan: int
    rowspan: int
    header: bool
    source: tuple[int, int]


@dataclasses.dataclass
class Grid:
    owner: np.ndarray
    cells: list[Placed]

    @property
    def columns(self) -> int:
        return self.owner.shape[1]

    @property
    def rows(self) -> int:
        return self.owner.shape[0]

    def anchored(self) -> list[Placed]:
        return [p for p in self.cells if p.rowspan > 0]

    def full_rows(self) -> int:
        return int((self.owner != FREE).all(1).sum()) if self.columns else 0


def width_of(cells: list[Cell]) -> int:
    return sum(c.colspan for c in cells)


def _plain(rows: list[Row]) -> bool:
    return all(c.colspan == c.rowspan == 1 for cells, _ in rows for c in cells)


def place(rows: list[Row], columns: int) -> Grid:
    """Every row's cells into its free squares from the left; what finds none is left out, spans are cut at the borders and at squares already taken."""
    grid = Grid(np.full((len(rows), columns), FREE, np.int32), [])
    plain = _plain(rows)
    for r, (cells, header) in enumerate(rows):
        at = 0
        if plain:
            n = min(len(cells), columns)
            grid.owner[r, :n] = range(len(grid.cells), len(grid.cells) + n)
            grid.cells += [Placed(r, k, c, 1, 1, header, (r, k)) for k, c in enumerate(cells[:n])]
            continue
        for k, cell in enumerate(cells):
            free = np.flatnonzero(grid.owner[r, at:] == FREE)
            if not len(free):
                break
            at += int(free[0])
            room = np.flatnonzero(grid.owner[r, at:] != FREE)
            wide, high = min(cell.colspan, int(room[0]) if len(room) else columns - at), min(cell.rowspan, len(rows) - r)
            grid.owner[r : r + high, at : at + wide] = len(grid.cells)
            grid.cells.append(Placed(r, at, cell, wide, high, header, (r, k)))
            at += wide
    return grid


# ---- repairs of rows


def on_body_columns(rows: list[Row]) -> list[Row]:
    """Short rows stretched over the columns that all full rows share, when they have exactly one filled cell for every free one of those."""
    widths = [width_of(cells) for cells, _ in rows]
    widest = max(widths, default=0)
    if all(c.colspan == 1 for cells, _ in rows for c in cells):
        return rows
    full = [set(np.cumsum([c.colspan for c in cells])) for (cells, _), w in zip(rows, widths) if w == widest]
    if len(full) < 2 or len(edges := sorted(set.intersection(*full) | {0})) == widest + 1:
        return rows
    out: list[Row] = []
    for r, (cells, header) in enumerate(rows):
        if widths[r] < widest:
            taken = place(out + [([], False)], widest).owner[r] != FREE
            parts = [taken[a:b] for a, b in zip(edges, edges[1:])]
            filled = [c for c in cells if c.text.strip()]
            free = [b - a for a, b, p in zip(edges, edges[1:], parts) if not p.any()]
            if filled and all(p.all() or not p.any() for p in parts) and len(filled) == len(free):
                cells = [c._replace(colspan=int(n)) for c, n in zip(filled, free)]
        out.append((cells, header))
    return out if out != rows else rows


def _reaching(rows: list[Row], upto: int, columns: int) -> Grid:
    return place(rows[: upto + 1] + [([], False)] * (len(rows) - upto - 1), columns)


def without_contradicted_spans(rows: list[Row]) -> list[Row]:
    """Spans of rows cut short where a row below leaves more than one square free because the span pushes its cells aside."""
    if all(c.rowspan == 1 for cells, _ in rows for c in cells):
        return rows
    columns = max((width_of(cells) for cells, _ in rows), default=0)
    cut: dict[tuple[int, int], int] = {}
    for r in range(1, len(rows)):
        grid = _reaching(rows, r, columns)
        line = grid.owner[r]
        if (line == FREE).sum() <= 1:
            continue
        above = [grid.cells[k] for k in line if k != FREE and grid.cells[k].row < r]
        if above and (span := above[-1]).cell.rowspan > r - span.row:
            cut[span.source] = r - span.row
    if not cut:
        return rows
    return [([c._replace(rowspan=cut.get((r, k), c.rowspan)) for k, c in enumerate(cells)], header) for r, (cells, header) in enumerate(rows)]


def with_blank_column(rows: list[Row], at: int) -> list[Row]:
    """An empty column put in before column ``at``; cells that span over it grow."""
    out: list[Row] = []
    for cells, header in rows:
        new, col, done = [], 0, False
        for c in cells:
            if not done and col >= at:
                new.append(Cell(""))
                done = True
            if not done and col < at < col + c.colspan:
                c, done = c._replace(colspan=c.colspan + 1), True
            new.append(c)
            col += c.colspan
        out.append((new if done else [*new, Cell("")], header))
    return out


def with_subtables(rows: list[Row], least: int = 2) -> list[Row]:
    """Sub-tables that were read as rows of the outer table put back into one cell.

    A run of rows is one if each row has a blank square of its own left of its
    filled ones, the run leaves a column free on both sides, and no row next
    to it begins in its first column. Neighbouring cells of one row with as
    many paragraphs are columns of a sub-table if another cell of the row is
    empty.
    """
    if any(k == "table" for cells, _ in rows for c in cells for k, _ in c.blocks):
        return rows
    if all(c.filled for cells, _ in rows for c in cells):
        return rows
    columns = max((width_of(cells) for cells, _ in rows), default=0)
    grid = place(rows, columns)
    extent: list[tuple[int, int] | None] = []
    inset: list[bool] = []
    for r in range(len(rows)):
        own = [p for p in grid.cells if p.row == r]
        filled = [p for p in own if p.cell.filled]
        extent.append((min(p.col for p in filled), max(p.col + p.colspan for p in filled)) if filled else None)
        inset.append(bool(filled) and any(not p.cell.filled and p.col < extent[-1][0] for p in own))
    out: list[Row] = []
    r = 0
    while r < len(rows):
        end = r
        while end < len(rows) and inset[end]:
            end += 1
        if end - r >= least:
            (low, high), n = Counter(extent[r:end]).most_common(1)[0]
            if 2 * n <= end - r:
                low, high = min(e[0] for e in extent[r:end]), max(e[1] for e in extent[r:end])
            beside = [extent[k] for k in (r - 1, end) if 0 <= k < len(rows)]
            if low > 0 and high < columns and all(e is None or e[0] != low for e in beside):
                inner: list[Row] = []
                for k in range(r, end):
                    kept = [p.cell._replace(colspan=min(p.colspan, high - p.col)) for p in grid.cells if p.row == k and low <= p.col < high and (p.cell.filled or p.col + p.colspan <= high)]
                    if kept:
                        inner.append((kept, rows[k][1]))
                text = "\n".join(c.text for cells, _ in inner for c in cells if c.text)
                out.append(([Cell("")] * low + [Cell(text, high - low, 1, 0, (("table", inner),))] + [Cell("")] * (columns - high), rows[r][1]))
                r = end
                continue
        out.append(rows[r])
        r += 1
    paired = [(_parallel(cells, least), header) for cells, header in out]
    return paired if paired != rows else rows


def _parallel(cells: list[Cell], least: int, longest: int = 120) -> list[Cell]:
    if all(c.filled for c in cells):
        return cells
    texts = [[v for k, v in c.blocks if k == "text"] if all(k == "text" and len(v) <= longest for k, v in c.blocks) else [] for c in cells]
    sizes = [len(t) if len(t) >= least else 0 for t in texts]
    best, at = (0, 0), 0
    while at < len(cells):
        end = at + 1
        while end < len(cells) and sizes[at] and sizes[end] == sizes[at]:
            end += 1
        if sizes[at] and end - at > max(1, best[1] - best[0]):
            best = (at, end)
        at = end
    a, b = best
    if b - a < 2:
        return cells
    inner = [([Cell(texts[c][k]) for c in range(a, b)], False) for k in range(sizes[a])]
    held = Cell("\n".join(c.text for row, _ in inner for c in row), width_of(cells[a:b]), cells[a].rowspan, cells[a].images, (("table", inner),))
    return [*cells[:a], held, *cells[b:]]


# ---- the grid and its repairs


def grid_width(rows: list[Row]) -> int:
    """The most frequent width that rows cover, first seen on ties, but never less than the last filled square, nor more than the widest row or MOST_COLUMNS."""
    widest = min(max((width_of(cells) for cells, _ in rows), default=1) or 1, MOST_COLUMNS)
    if _plain(rows):
        covered = Counter(min(len(cells), widest) for cells, _ in rows)
        last = max((k + 1 for cells, _ in rows for k, c in enumerate(cells[:widest]) if c.text.strip()), default=0)
        return max(1, min(widest, max(covered.most_common(1)[0][0] if covered else 1, last)))
    trial = place(rows, widest)
    covered = Counter((trial.owner != FREE).sum(1).tolist())
    last = max((p.col + p.colspan for p in trial.cells if p.cell.text.strip()), default=0)
    return max(1, min(widest, max(covered.most_common(1)[0][0] if covered else 1, last)))


def join_repeated_labels(grid: Grid) -> None:
    """A header's first cell and an equal one below it become one cell over both rows."""
    if not any(p.header and p.col == 0 for p in grid.cells):
        return
    by_place = {(p.row, p.col): p for p in grid.cells}
    for r in range(grid.rows - 1):
        top, low = by_place.get((r, 0)), by_place.get((r + 1, 0))
        if top and low and top.header and top.cell.text.strip() and top.cell.text.strip() == low.cell.text.strip() and {top.colspan, low.colspan, top.rowspan, low.rowspan} == {1}:
            grid.owner[r + 1, 0] = grid.owner[r, 0]
            top.rowspan, low.rowspan = 2, 0


def close_bottom_gaps(grid: Grid) -> None:
    """A cell over several rows that ends above the bottom, with nothing but free squares below, is stretched to the bottom."""
    if not any(p.rowspan > 1 for p in grid.cells):
        return
    for c in range(grid.columns):
        used = np.flatnonzero(grid.owner[:, c] != FREE)
        if not len(used) or used[-1] == grid.rows - 1:
            continue
        cell = grid.cells[grid.owner[used[-1], c]]
        if cell.col == c and cell.rowspan > 1:
            grid.owner[used[-1] + 1 :, c : c + cell.colspan] = grid.owner[used[-1], c]
            cell.rowspan = grid.rows - cell.row


def build(rows: list[Row], blank_column: int | None = None) -> Grid:
    """The grid of a table's rows, all repairs done."""
    rows = with_subtables(rows)
    if blank_column is not None:
        rows = with_blank_column(rows, blank_column)
    rows = without_contradicted_spans(on_body_columns(rows))
    grid = place(rows, grid_width(rows)) if rows else Grid(np.full((0, 0), FREE, np.int32), [])
    join_repeated_labels(grid)
    close_bottom_gaps(grid)
    return grid


# ---- measures


def widest_row(text: str | None) -> int:
    """Most cells of one row as written, before any repair."""
    return max((len(re.findall(r"<t[dh]\b", part, re.I)) for part in re.split(r"<tr\b", text or "", flags=re.I)[1:]), default=0)


def one_value_dominates(rows: list[Row], least: int = 60, share: float = 0.7) -> bool:
    """True if one text fills more than ``share`` of at least ``least`` filled cells."""
    texts = Counter(t for cells, _ in rows for c in cells if (t := c.text.strip()))
    return sum(texts.values()) >= least and max(texts.values(), default=0) > share * sum(texts.values())


def health(text: str | None, truncated: bool = False, ruled: int = 0, least_placed: float = 0.85, ratio: float = 1.5, read: tuple[list[Row], Grid] | None = None) -> dict:
    """Shape and defects of one table; ``ruled`` is the number of columns that ruled lines show, 0 if not measured; ``read`` are its rows and grid, if they are known."""
    rows, grid = read or (r := read_table(text), build(r))
    emitted, placed = sum(len(cells) for cells, _ in rows), len(grid.anchored())
    out = {
        "cols": grid.columns, "n_rows": grid.rows, "full_rows": grid.full_rows(), "emitted": emitted, "placed": placed, "widest_row": widest_row(text),
        "degenerate": one_value_dominates(rows), "truncated": truncated, "missing_columns": bool(ruled >= 3 and grid.columns and ruled >= ratio * grid.columns),
    }
    out["healthy"] = not (out["widest_row"] > MOST_COLUMNS or out["degenerate"] or truncated or out["missing_columns"] or emitted and placed < least_placed * emitted or not emitted)
    return out


_EAST_ASIAN = "ᄀ-ᅟ⺀-꓏가-힣豈-﫿︰-﹏＀-｠￠-￦"
_WIDE, _BREAKS = re.compile(f"[{_EAST_ASIAN}]"), re.compile(rf"[\s{_EAST_ASIAN}]+")


def display_width(text: str) -> int:
    """Columns of a terminal that a text takes; East Asian characters take two."""
    return len(text) + len(_WIDE.findall(text))


def longest_word(text: str) -> int:
    """Width of the longest run without a blank or an East Asian character, between which lines break."""
    return max((display_width(w) for w in _BREAKS.split(text)), default=0)


def least_width(text: str) -> int:
    """Width below which a text becomes a strip: labels to 16 columns take two lines at most, longer ones 16 lines, but never ask for more than 22 columns."""
    widths = [display_width(line.strip()) for line in text.split("\n")]
    return max((-(-w // 2) if w <= 16 else min(22, -(-w // 16)) for w in widths), default=0)


def column_weights(grid: Grid) -> list[int]:
    """For each column the upper quartile of its texts' widths above one, at least its longest word and its least width; texts over several columns are shared out."""
    parts: list[list[int]] = [[] for _ in range(grid.columns)]
    floor = [1] * grid.columns
    for p in grid.anchored():
        word, strip = longest_word(p.cell.text), least_width(p.cell.text)
        for c in range(p.col, p.col + p.colspan):
            parts[c].append(max(1 if p.colspan > 1 else 0, display_width(p.cell.text) // p.colspan))
            floor[c] = max(floor[c], word // p.colspan, strip // p.colspan)
    return [max(f, round(float(np.quantile([v for v in own if v > 1], 0.75))) if any(v > 1 for v in own) else 1) for own, f in zip(parts, floor)]


def signature(text: str) -> str:
    """Letters a to z, digits and Chinese characters of a text, lower case."""
    return re.sub("[^0-9a-z㐀-䶿一-鿿]", "", text.lower())


def signatures(grid: Grid) -> Counter:
    return Counter(s for p in grid.anchored() if (s := signature(p.cell.text)))


def keeps_content(old: str | None, new: str | None) -> bool:
    """keeps_values of the cells of two tables."""
    return keeps_values(signatures(build(read_table(old))), signatures(build(read_table(new))))


def keeps_values(before: Counter, after: Counter, floor: int = 3, share: float = 0.25) -> bool:
    """True if no value of the old table vanishes and none loses more than ``floor`` copies or a ``share`` of them."""
    return all(0 < after[s] and n - after[s] <= max(floor, int(n * share)) for s, n in before.items())


def pictures_to_cells(grid: Grid, pictures: list[tuple[float, float]], width: float, height: float) -> list[tuple[int, int, int]]:
    """(picture, row, column) for pictures by their centres within a table of that size: the nearest pairs first, each cell taking as many as it names images, cells without any taking one at most and only after the others."""
    rows, cols = max(1, grid.rows), max(1, grid.columns)
    centre = lambda p: ((p.col + p.colspan / 2) / cols * width, (p.row + p.rowspan / 2) / rows * height)
    room = {k: p.cell.images if p.cell.images else int(not p.cell.text.strip()) for k, p in enumerate(grid.anchored())}
    cells = grid.anchored()
    pairs = sorted(
        (not cells[k].cell.images, abs(centre(cells[k])[1] - y) + abs(centre(cells[k])[0] - x), i, k)
        for i, (x, y) in enumerate(pictures) for k, n in room.items() if n
    )
    out, done = [], set()
    for _, _, i, k in pairs:
        if i not in done and room[k]:
            room[k] -= 1
            done.add(i)
            out.append((i, cells[k].row, cells[k].col))
    return sorted(out)


def dropped_column(grid: Grid, shifts: list[float]) -> int | None:
    """0 if every picture of at least two stands one column right of the cell that names it: the table lost its first column."""
    moved = [s for s in shifts if s > 0.55]
    return 0 if len(shifts) >= 2 and len(moved) == len(shifts) and {round(s) for s in shifts} == {1} and grid.columns else None


def headers_over_groups(grid: Grid, row: int = 0) -> list[tuple[int, int]]:
    """(column, width) of a header row's filled cells stretched over the empty ones to their right, where the row below fills all of them."""
    line = [p for p in grid.anchored() if p.row == row]
    out = []
    for k, p in enumerate(line):
        if not p.cell.filled:
            continue
        end = p.col + p.colspan
        for q in line[k + 1 :]:
            below = grid.owner[row + 1, q.col : q.col + q.colspan] if row + 1 < grid.rows else np.array([FREE])
            if q.cell.filled or (below == FREE).any() or not all(grid.cells[b].cell.filled for b in below):
                break
            end = q.col + q.colspan
        out.append((p.col, end - p.col))
    return out


def row_shares(rows: int, heights: list[float]) -> list[int]:
    """Rows of a cell shared among the pictures it holds by their heights, one at least; with fewer rows than pictures the last row takes what is left."""
    if rows < len(heights):
        return [1] * rows
    total = sum(max(1.0, h) for h in heights)
    ideal = [rows * max(1.0, h) / total for h in heights]
    out = [max(1, int(x)) for x in ideal]
    while sum(out) != rows:
        step = 1 if sum(out) < rows else -1
        able = [k for k in range(len(out)) if out[k] + step >= 1]
        k = max(able, key=lambda k: step * (ideal[k] - out[k]))
        out[k] += step
    return out


def natural_width_pt(grid: Grid, size_pt: float, pad: int = 2, margin_pt: float = 5.4) -> float:
    """Width in points that a table's texts would take: columns by weight or longest word, half a font size for each, with margins."""
    if not grid.cells:
        return 0.0
    return sum((w + pad) * max(1.0, size_pt * 0.5) + 2 * margin_pt for w in column_weights(grid))
