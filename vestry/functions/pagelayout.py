"""What stands where on one page, in numpy: grids, cells, blocks, notes, stamps, numbers, signatures.

A page's pixels stay in one task; what leaves it are elements.  The tests that
they have to pass are those of :mod:`vestry.operators.layout`, here for single
values.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

from vestry.functions import pixels as P
from vestry.functions import vision as V

#: Hues of stamps (in half degrees) with their least saturation and value.
STAMP_HUES = {"red": ((0, 10), (170, 180)), "blue": ((100, 130),)}
STAMP_LEAST = 50
#: Pairs of edge thresholds that are tried in turn.
EDGE_TRIES = ((20, 80), (30, 100), (50, 150))
LINE = 50


@dataclass
class Element:
    """Something on a page; ``box`` is x1, y1, x2, y2, half-open."""

    type: str
    box: tuple[int, int, int, int]
    confidence: float
    source: str
    region_type: str | None = None
    properties: dict[str, str] = field(default_factory=dict)


@dataclass
class Grid:
    rows: list[tuple[int, int]]
    cols: list[tuple[int, int]]


# Profiles


def segments(profile: np.ndarray, threshold: float, min_length: int) -> list[tuple[int, int]]:
    """Runs of values over the threshold, longer than ``min_length``."""
    d = np.diff(np.pad((np.asarray(profile) > threshold).astype(np.int8), 1))
    return [(int(s), int(e)) for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)) if e - s > min_length]


def gaps(counts: np.ndarray, threshold: float, min_gap: int, size: int) -> list[tuple[int, int]]:
    """Segments between the middles of lines; a line at the very end of the profile doesn't count."""
    out, before = [], 0
    for start, end in segments(counts, threshold, 2):
        if end == len(counts):
            continue
        middle = (start + end) // 2
        if middle - before > min_gap:
            out.append((before, middle))
        before = middle
    return out + [(before, size)] if before < size else out


def _shares(counts: np.ndarray, by: float = 1.0) -> np.ndarray:
    x = counts / by
    return x / max(x.max(initial=0), 1)


def _line_grid(lines: np.ndarray, upright: np.ndarray, by: float, over: tuple[float, float], least: tuple[int, int], enough: tuple[int, int] | None) -> Grid:
    """Segments of the line counts' profiles; fewer than ``enough`` of a kind give way to those between lines."""
    h, w = lines.shape
    down, across = lines.sum(1), upright.sum(0)
    rows, cols = segments(_shares(down, by), over[0], least[0]), segments(_shares(across, by), over[1], least[1])
    if enough and len(rows) < enough[0]:
        rows = gaps(down, w * 0.25, least[0], h)
    if enough and len(cols) < enough[1]:
        cols = gaps(across, h * 0.25, least[1], w)
    return Grid(rows, cols)


def _lines(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return P.long_runs(mask, LINE), P.long_runs(mask.T, LINE).T


def raw_grid(raw: np.ndarray) -> Grid:
    """The grid from dark lines of a raw gray page."""
    return _line_grid(*_lines(raw <= P.otsu(raw)), 255.0, (0.08, 0.05), (15, 30), (3, 2))


def edge_grid(g: np.ndarray) -> Grid:
    """The grid from long edges."""
    return _line_grid(*_lines(V.canny(g, *EDGE_TRIES[0])), 1.0, (0.1, 0.05), (15, 30), (3, 2))


def any_grid(g: np.ndarray, raw: np.ndarray | None = None) -> Grid:
    """The first grid of two rows and columns: from dark lines, from edges of several strengths, else rows and columns of text."""
    if raw is not None and len((found := raw_grid(raw)).rows) >= 2 and len(found.cols) >= 2:
        return found
    for low, high in EDGE_TRIES:
        found = _line_grid(*_lines(V.canny(g, low, high)), 1.0, (0.05, 0.03), (10, 20), None)
        if len(found.rows) >= 2 and len(found.cols) >= 2:
            return found
    h, w = g.shape
    inverse = 255 - g
    ink = inverse > P.otsu(inverse)
    rows, cols = segments(_shares(ink.sum(1)), 0.005, 5), segments(_shares(ink.sum(0)), 0.003, 30)
    if len(rows) >= 3 and cols:
        return Grid(rows, cols if len(cols) >= 2 else [(0, w)])
    return Grid(rows if len(rows) >= 2 else [(0, h)], [(0, w)])


def box_grid(boxes, width: int) -> Grid:
    """The grid from a detector's boxes ``label, x1, y1, x2, y2, confidence``."""
    rows = sorted(((b[2], b[4]) for b in boxes if b[0] in ("table", "record_block", "header_row", "data_row")), key=lambda r: r[0])
    edges = sorted({x for b in boxes if b[0] == "data_cell" for x in (b[1], b[3])})
    cols = [(a, b) for a, b in zip(edges, edges[1:]) if b - a > 20]
    return Grid(rows, cols or [(0, width)])


# Tables


def is_table(grid: Grid, height: int) -> bool:
    return len(grid.rows) >= 2 and height > 0 and sum(e - s for s, e in grid.rows) / height >= 0.2


def table_confidence(rows: int, cols: int) -> float:
    for least_rows, least_cols, confidence in ((5, 3, 0.9), (3, 2, 0.7), (2, 2, 0.5)):
        if rows >= least_rows and cols >= least_cols:
            return confidence
    return 0.3


def region_class(g: np.ndarray) -> str:
    """``handwritten``, ``printed`` or ``empty``."""
    if g.size == 0 or g.mean() > 250:
        return "empty"
    variance = float(np.var(P.laplacian(g)))
    if variance > 300 and V.canny(g, 50, 150).mean() > 0.08:
        return "handwritten"
    return "printed" if variance > 50 else "empty"


def cells(g: np.ndarray, grid: Grid) -> list[Element]:
    out = []
    for r, (y1, y2) in enumerate(grid.rows):
        for c, (x1, x2) in enumerate(grid.cols):
            crop = g[y1:y2, x1:x2]
            if not crop.size:
                continue
            kind, empty = region_class(crop), bool(crop.mean() > 250)
            properties = {"row": str(r), "col": str(c), "is_header": str(r == 0 or c == 0).lower(), "is_empty": str(empty).lower()}
            out.append(Element("data_cell", (x1, y1, x2, y2), 0.0 if empty else 0.8 if kind != "empty" else 0.3, "table_grid", kind, properties))
    return out


def record_blocks(g: np.ndarray, grid: Grid, change: int = 15) -> list[Element]:
    """The header row, then blocks of rows of about one height, stamped with the page's record type."""
    if not grid.rows:
        return []
    h, w = g.shape
    kind = "birth" if P.ink_share(g[: int(h * 0.2)]) > 0.05 else "unknown"
    (top, bottom), *rest = grid.rows
    out = [Element("header_row", (0, top, w, bottom), 0.9, "position", None, {"row_index": "0", "is_header": "true"})]
    heights = np.array([e - s for s, e in grid.rows])
    breaks = [k for k in range(1, len(heights)) if k == 1 or (heights[k - 1] > 0 and abs(heights[k] - heights[k - 1]) > change)]
    for a, b in zip(breaks, [*breaks[1:], len(heights)]):
        rows = grid.rows[a:b]
        out.append(Element("record_block", (0, rows[0][0], w, rows[-1][1]), 0.8, "row_clustering", None, {"row_count": str(b - a), "record_type": kind}))
    return out


# Contours


def text_blocks(g: np.ndarray) -> list[Element]:
    """Paragraphs of a page without a table: dark parts that run together within some pixels."""
    dark = g <= P.otsu(g)
    out = []
    for c in V.contours(V.spread(dark, 6, 21)):
        aspect = c.w / c.h
        if c.area >= 500 and 0.5 < aspect < 10 and c.h > 15:
            properties = {"area": str(int(c.area)), "aspect_ratio": str(round(aspect, 2))}
            out.append(Element("text_block", (c.x, c.y, c.x + c.w, c.y + c.h), min(0.8, c.area / g.size * 10), "contour_analysis", None, properties))
    return out


def _vivid(img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and hues of the pixels that have a stamp's saturation and value."""
    b, g, r = (img[..., k] for k in range(3))
    most = np.maximum(np.maximum(b, g), r)
    span = most - np.minimum(np.minimum(b, g), r)
    # saturation is 255 * span / most, so a pixel with too small a span needn't be looked at in full
    y, x = np.nonzero((most >= STAMP_LEAST) & (span >= (STAMP_LEAST - 1) * STAMP_LEAST // 255))
    hsv = V.to_hsv(img[y, x])
    kept = (hsv[..., 1] >= STAMP_LEAST) & (hsv[..., 2] >= STAMP_LEAST)
    return y[kept], x[kept], hsv[kept, 0]


def _patches(y: np.ndarray, x: np.ndarray, h: int, w: int, disc: np.ndarray) -> list[V.Contour]:
    """Contours of some pixels of a page after specks and gaps are gone, worked out in the box around them."""
    if not len(y):
        return []
    room = 2 * max(disc.shape)
    top, left = max(0, int(y.min()) - room), max(0, int(x.min()) - room)
    mask = np.zeros((min(h, int(y.max()) + 1 + room) - top, min(w, int(x.max()) + 1 + room) - left), bool)
    mask[y - top, x - left] = True
    return [replace(c, x=left + c.x, y=top + c.y) for c in V.contours(V.closed(V.opened(mask, disc), disc))]


def stamps(img: np.ndarray) -> list[Element]:
    """Round or square patches of a stamp's colours; a gray page has none."""
    if img.ndim == 2:
        return []
    disc, (y, x, hue) = V.ellipse(5), _vivid(img)
    out = []
    for color, hues in STAMP_HUES.items():
        own = np.any([(hue >= lo) & (hue <= hi) for lo, hi in hues], axis=0)
        for c in _patches(y[own], x[own], *img.shape[:2], disc):
            if not 400 <= c.area <= img.shape[0] * img.shape[1] * 0.2:
                continue
            circular = 4 * np.pi * c.area / c.perimeter**2 if c.perimeter > 0 else 0.0
            if circular > 0.5 or (0.7 < c.w / c.h < 1.3 and c.w > 20):
                properties = {"color": color, "circularity": str(round(circular, 2)), "area": str(int(c.area))}
                out.append(Element("stamp", (c.x, c.y, c.x + c.w, c.y + c.h), round(min(0.9, 0.4 + circular / 2), 2), "color_detection", None, properties))
    return out


def marginal_notes(g: np.ndarray, strict: bool = True) -> list[Element]:
    """Writing in the outer 4 % of either side; ``strict`` divides the share of ink by 255 first, so that nothing passes."""
    h, w = g.shape
    wide = int(w * 0.04)
    out = []
    for region, x in (("left_margin", 0), ("right_margin", w - wide)):
        margin = g[:, x : x + wide]
        if not margin.size or margin.mean() > 250:
            continue
        ink = margin <= 128
        density = float(ink.mean()) / (255.0 if strict else 1.0)
        for c in V.contours(V.spread(ink, 2, 2)) if density >= 0.05 else ():
            if c.h > 40 and c.w > 20 and c.h * c.w > 800:
                properties = {"region": region, "height": str(c.h), "width": str(c.w)}
                out.append(Element("marginal_note", (x + c.x, c.y, x + c.x + c.w, c.y + c.h), round(min(0.8, 0.3 + density), 2), "heuristic", None, properties))
    return out


def page_numbers(g: np.ndarray) -> list[Element]:
    """Small marks in the top or bottom 8 % of the page, where these are neither empty nor full."""
    h = g.shape[0]
    out = []
    for region, y, strip in (("top_margin", 0, g[: int(h * 0.08)]), ("bottom_margin", int(h * 0.92), g[int(h * 0.92) :])):
        if 0.01 < P.ink_share(strip) < 0.1:
            for c in V.contours(strip <= 128):
                if 10 < c.w < 100 and 10 < c.h < 50:
                    out.append(Element("page_number", (c.x, y + c.y, c.x + c.w, y + c.y + c.h), 0.6, "heuristic", None, {"region": region}))
    return out


def signatures(g: np.ndarray) -> list[Element]:
    """Dense strokes in the right half of a strip near the bottom."""
    h, w = g.shape
    y, x = int(h * 0.85), int(w * 0.5)
    strip = g[y : int(h * 0.95), x:]
    if not strip.size or np.var(P.laplacian(strip)) <= 1000 or V.canny(strip, 50, 150).mean() <= 0.15:
        return []
    found = [c for c in V.contours(strip <= 128) if c.w > 50 and c.h > 15 and c.area > 300]
    return [Element("signature", (x + c.x, y + c.y, x + c.x + c.w, y + c.y + c.h), 0.5, "heuristic") for c in found]


# Pages


def analyze(img: np.ndarray, raw: np.ndarray | None = None, detector: Callable | None = None, strict_notes: bool = True) -> tuple[str, list[Element]]:
    """Kind of the page (``table`` or ``text``) and its elements in reading order.

    ``raw`` is the gray page before stage one, whose lines are unspoilt.
    ``detector`` returns boxes; if they make no two rows, the lines count.
    """
    g = P.gray(img)
    h, w = g.shape
    grid = box_grid(detector(img), w) if detector else Grid([], [])
    if len(grid.rows) < 2:
        grid = raw_grid(raw) if raw is not None else any_grid(g)
    if is_table(grid, h):
        kind, n = "table", (len(grid.rows), len(grid.cols))
        found = [Element("table", (0, 0, w, h), table_confidence(*n), "projection", None, {"num_rows": str(n[0]), "num_cols": str(n[1])})]
        found += cells(g, grid) + record_blocks(g, grid)
    else:
        kind, blocks = "text", text_blocks(g)
        found = [Element("text_block", (0, 0, w, h), 0.8, "page_classification", None, {"page_type": "text", "num_blocks": str(len(blocks))}), *blocks]
    found += stamps(img) + marginal_notes(g, strict_notes) + page_numbers(g) + signatures(g)
    return kind, sorted(found, key=lambda e: (e.box[1], e.box[0]))


#: Which preprocessor an element's crop goes through; cells that aren't handwritten have their own.
CROP_OF = {"text_block": "printed_text", "header_row": "printed_text", "record_block": "table_cell", "data_row": "table_cell", "data_cell": "data_cell"}


def crop_kind(e: Element) -> str:
    return "handwritten" if e.type == "data_cell" and e.region_type == "handwritten" else CROP_OF.get(e.type, "printed_text")
