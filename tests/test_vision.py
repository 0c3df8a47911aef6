"""Pixel operations against plain loops, and layout on drawn pages."""

import numpy as np
import pytest

from vestry.functions import pagelayout, pixels, vision
from vestry.operators import images, ocr


def disc(size, r, at=None):
    y, x = np.mgrid[:size, :size]
    cy, cx = at or (size // 2, size // 2)
    return (y - cy) ** 2 + (x - cx) ** 2 <= r * r


def traced(mask):
    """Area and perimeter of the one part of a mask by walking around it."""
    p = np.pad(mask, 1)
    start = tuple(np.argwhere(p)[0])
    around = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    at, d, path = start, 0, [start]
    while True:
        for k in range(8):
            e = (d + 6 + k) % 8
            new = (at[0] + around[e][0], at[1] + around[e][1])
            if p[new]:
                break
        else:
            return 0.0, 0.0
        if at == start and len(path) > 1 and new == path[1]:
            break
        at, d = new, e
        path.append(at)
    path = path[:-1] if path[-1] == start else path
    area = abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(path, [*path[1:], path[0]]))) / 2
    return area, sum(float(np.hypot(a[0] - b[0], a[1] - b[1])) for a, b in zip(path, [*path[1:], path[0]]))


def test_contours():
    ring = disc(40, 15) & ~disc(40, 8)
    masks = [disc(30, 11), np.ones((5, 9), bool), ring, np.eye(7, dtype=bool), np.zeros((6, 6), bool) | (np.arange(6) == 3)]
    masks[1] = np.pad(masks[1], 2)
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = vision.spread(rng.random((30, 30)) > 0.97, 1, 2)
        best = max(vision.contours(m), key=lambda c: c.area)
        alone = np.zeros_like(m)
        runs = vision._Runs(m, True)
        part = runs.image[best.y : best.y + best.h, best.x : best.x + best.w]
        for k in np.unique(part[part > 0]):
            ys, xs = np.nonzero(runs.image == k)
            if (xs.min(), ys.min(), xs.max() + 1 - xs.min(), ys.max() + 1 - ys.min()) == (best.x, best.y, best.w, best.h):
                alone |= runs.image == k
        masks.append(alone)
    for m in masks:
        (c,) = vision.contours(m)
        area, length = traced(m)
        assert c.area == pytest.approx(area) and c.perimeter == pytest.approx(length)
        ys, xs = np.nonzero(m)
        assert (c.x, c.y, c.w, c.h) == (xs.min(), ys.min(), xs.max() - xs.min() + 1, ys.max() - ys.min() + 1)
    inside = ring | disc(40, 3)
    assert len(vision.contours(inside)) == 1  # what lies in a hole has no outer contour
    assert vision.contours(np.zeros((4, 4), bool)) == []


def test_morphology_and_runs():
    rng = np.random.default_rng(1)
    m = rng.random((12, 40)) > 0.25
    for length in (4, 5, 8):
        line = np.ones((1, length), bool)
        assert (pixels.long_runs(m, length) == vision.opened(m, line)).all()
    box = np.ones((5, 7), bool)
    assert (vision.spread(m, 2, 3) == vision.dilate(m, box)).all()
    g = rng.integers(0, 256, (9, 9)).astype(np.uint8)
    k = vision.ellipse(2)
    assert k.tolist() == [[False, True], [True, True]] and vision.ellipse(5).sum() == 17
    naive = np.zeros_like(g)
    for y in range(9):
        for x in range(9):
            naive[y, x] = max(g[y + i - 1, x + j - 1] for i in range(2) for j in range(2) if k[i, j] and 0 <= y + i - 1 < 9 and 0 <= x + j - 1 < 9)
    assert (vision.dilate(g, k) == naive).all()


def test_canny():
    g = np.full((40, 40), 200, np.uint8)
    g[10:30, 10:30] = 50
    e = vision.canny(g, 50, 150)
    assert e.any() and not e[:8].any() and not e[13:27, 13:27].any()
    rows = np.flatnonzero(e[:, 20])
    assert len(rows) == 2 and abs(rows[0] - 10) <= 1 and abs(rows[1] - 30) <= 1
    faint = np.full((20, 40), 100, np.uint8)
    faint[:, 20:] = 120  # a gradient of 80: weak, and nothing strong hangs on it
    assert not vision.canny(faint, 50, 150).any() and vision.canny(faint, 20, 60).any()


@pytest.mark.parametrize("angle", [-4.0, 3.0])
def test_deskew(angle):
    page = np.full((400, 500), 240, np.uint8)
    for y in range(60, 360, 60):
        page[y : y + 4, 20:480] = 30
    turned = vision.rotate(page, angle)
    found = vision.skew(turned)
    assert found == pytest.approx(-angle, abs=1.01) or found == pytest.approx(angle, abs=1.01)
    straight = vision.deskew(turned)
    assert vision.skew(straight) is None or abs(vision.skew(straight)) < 1.5
    assert (vision.rotate(page, 0.0) == page).all()
    blank = np.full((200, 200, 3), 255, np.uint8)
    assert (vision.deskew(blank) == blank).all()


def test_denoise_equals_plain_loops():
    rng = np.random.default_rng(3)
    g = np.clip(rng.normal(120, 6, (9, 8)), 0, 255).astype(np.uint8)
    template, search, strength = 3, 5, 4
    edge = template // 2 + search // 2
    p = np.pad(g.astype(float), edge, mode="reflect")
    want = np.zeros(g.shape)
    for y in range(9):
        for x in range(8):
            total = weight = 0
            a = p[y + edge - 1 : y + edge + 2, x + edge - 1 : x + edge + 2]
            for dy in range(-2, 3):
                for dx in range(-2, 3):
                    b = p[y + edge + dy - 1 : y + edge + dy + 2, x + edge + dx - 1 : x + edge + dx + 2]
                    k = np.exp(-((a - b) ** 2).mean() / strength**2)
                    if k >= 0.001:
                        total, weight = total + k * p[y + edge + dy, x + edge + dx], weight + k
            want[y, x] = total / weight
    got = vision.denoise(g, strength, template, search, band=4)
    assert np.abs(got.astype(int) - np.rint(want)).max() <= 1 and (got != g).any()
    color = rng.integers(0, 256, (20, 20, 3)).astype(np.uint8)
    assert vision.denoise(color).shape == color.shape and vision.denoise(color).dtype == np.uint8


def test_clahe_equals_plain_loops():
    rng = np.random.default_rng(4)
    g = np.clip(rng.normal(120, 25, (32, 48)), 0, 255).astype(np.uint8)
    got = vision.clahe(g, 2.0, tiles=4)
    luts = np.zeros((4, 4, 256))
    for a in range(4):
        for b in range(4):
            hist = np.bincount(g[a * 8 : a * 8 + 8, b * 12 : b * 12 + 12].ravel(), minlength=256)
            limit = max(1, int(2.0 * 96 / 256))
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // 256
            left = over % 256
            at = 0
            while left and at < 256:
                hist[at] += 1
                at, left = at + max(256 // (over % 256), 1), left - 1
            luts[a, b] = np.rint(np.cumsum(hist) * 255 / 96)
    for y, x in ((0, 0), (5, 20), (17, 30), (31, 47)):
        ty, tx = y / 8 - 0.5, x / 12 - 0.5
        y0, x0 = int(np.floor(ty)), int(np.floor(tx))
        c = lambda v: min(max(v, 0), 3)
        fy, fx = ty - y0, tx - x0
        v = sum(luts[c(y0 + i), c(x0 + j), g[y, x]] * (fy if i else 1 - fy) * (fx if j else 1 - fx) for i in (0, 1) for j in (0, 1))
        assert abs(int(got[y, x]) - v) <= 0.51
    odd = rng.integers(0, 256, (13, 7)).astype(np.uint8)
    assert vision.clahe(odd, 2.0).shape == odd.shape


def test_colour_spaces():
    img = np.array([[[0, 0, 255], [255, 0, 0], [0, 255, 0], [255, 255, 255], [0, 0, 0], [10, 200, 90]]], np.uint8)
    assert vision.to_hsv(img)[0, :5].tolist() == [[0, 255, 255], [120, 255, 255], [60, 255, 255], [0, 0, 255], [0, 0, 0]]
    assert vision.to_lab(img)[0, 0].tolist() == [136, 208, 195] and vision.to_lab(img)[0, 3].tolist() == [255, 128, 128]
    for linear in (False, True):
        some = np.random.default_rng(5).integers(0, 256, (20, 20, 3)).astype(np.uint8)
        back = vision.from_lab(vision.to_lab(some, linear), linear)
        assert np.abs(back.astype(int) - some).mean() < 3
    assert vision.contrast(some).shape == some.shape


def test_sizes():
    img = np.random.default_rng(6).integers(0, 256, (30, 40, 3)).astype(np.uint8)
    assert images.fit(img).shape == (1125, 1500, 3)
    flat = np.full((30, 40), 77, np.uint8)
    assert (images.fit(flat) == 77).all() and (pixels.shrink(flat, 7, 9) == 77).all() and (pixels.bilinear(flat, 50, 13) == 77).all()
    assert pixels.shrink(np.array([[0, 100], [50, 250]], np.uint8), 1, 1).tolist() == [[100]]
    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[:, None], 4, 1)
    grown = vision.grow(ramp, 40, 4)[6:-6, 0].astype(int)
    assert (np.abs(grown - (np.arange(6, 34) * 5 - 2.5)) <= 0.51).all()  # a ramp stays one


def table_page():
    """Dark rows on light paper."""
    img = np.full((600, 800), 245, np.uint8)
    for y in (55, 155, 255):
        img[y : y + 91, 55:746] = 80
    img[145:156, 55:746] = 245
    img[245:256, 55:746] = 245
    return img


def text_page():
    img = np.full((600, 800), 255, np.uint8)
    for y1, y2, x1, x2 in ((50, 151, 100, 701), (200, 351, 50, 751), (400, 501, 150, 651)):
        img[y1:y2, x1:x2] = 200
    return img


def bgr(g):
    return np.repeat(g[..., None], 3, axis=2)


def test_table_page():
    g = table_page()
    grid = pagelayout.raw_grid(g)
    # the profile of the lines is spread by 255, so rows come from the lines' middles
    assert grid.rows and grid.cols and pagelayout.raw_grid(text_page()).rows
    kind, found = pagelayout.analyze(bgr(g))
    assert kind == "table" and found[0].type in ("table", "header_row", "data_cell")
    assert [e.box[1] for e in found] == sorted(e.box[1] for e in found)
    cells = pagelayout.cells(g, pagelayout.Grid([(0, 50), (50, 100), (100, 150)], [(0, 100), (100, 200)]))
    assert len(cells) == 6 and sum(c.properties["is_header"] == "true" for c in cells) == 4
    assert cells[0].region_type in ("empty", "printed", "handwritten") and cells[0].properties["is_empty"] == "false"
    assert pagelayout.is_table(pagelayout.Grid([(100, 200), (200, 300), (300, 400), (400, 500)], [(0, 400), (400, 800)]), 600)
    assert pagelayout.table_confidence(6, 4) == 0.9 and pagelayout.table_confidence(1, 1) == 0.3
    blocks = pagelayout.record_blocks(g, pagelayout.Grid([(0, 50), (50, 80), (80, 110), (110, 180)], [(0, 800)]))
    assert [(b.type, b.box[1], b.box[3]) for b in blocks] == [("header_row", 0, 50), ("record_block", 50, 110), ("record_block", 110, 180)]
    assert blocks[1].properties == {"row_count": "2", "record_type": "birth"}


def test_text_page():
    g = text_page()
    blocks = pagelayout.text_blocks(g)
    assert len(blocks) == 3 and blocks[0].box == (100 - 21, 50 - 6, 701 + 21, 151 + 6) and all(0 <= b.confidence <= 0.8 for b in blocks)
    kind, found = pagelayout.analyze(bgr(g), g)
    assert kind in ("table", "text") and found


def test_edge_and_fallback_grids():
    g = np.full((300, 400), 250, np.uint8)
    for y in (40, 120, 200, 280):
        g[y : y + 4] = 20
    for x in (50, 200, 350):
        g[:, x : x + 4] = 20
    # edges are thinner than a line has to be, so without long runs of them the page is one cell
    assert pagelayout.edge_grid(g) == pagelayout.Grid([(0, 300)], [(0, 400)])
    assert pagelayout.any_grid(g, g) == pagelayout.raw_grid(g) == pagelayout.Grid([(0, 42), (42, 122), (122, 202), (202, 282), (282, 300)], [(0, 52), (52, 202), (202, 352), (352, 400)])
    lines = np.full((300, 400), 255, np.uint8)
    for y in range(20, 280, 40):
        lines[y : y + 12, 30:370:3] = 0
    grid = pagelayout.any_grid(lines)
    assert len(grid.rows) == 7 and grid.cols == [(0, 400)]
    assert pagelayout.any_grid(np.full((50, 60), 255, np.uint8)) == pagelayout.Grid([(0, 50)], [(0, 60)])


def test_stamps_notes_numbers_signatures():
    img = np.full((400, 400, 3), 255, np.uint8)
    img[disc(400, 60)] = (0, 0, 200)
    (s,) = pagelayout.stamps(img)
    assert s.type == "stamp" and s.properties["color"] == "red" and abs(s.box[0] - 140) <= 1 and s.confidence > 0.7
    img[disc(400, 30, (60, 60))] = (220, 40, 20)
    assert {e.properties["color"] for e in pagelayout.stamps(img)} == {"red", "blue"} and pagelayout.stamps(img[..., 0]) == []
    g = np.full((600, 800), 255, np.uint8)
    g[200:300, 5:27] = 50
    assert pagelayout.marginal_notes(g) == []
    (n,) = pagelayout.marginal_notes(g, strict=False)
    assert n.box == (3, 198, 29, 302) and n.properties["region"] == "left_margin"
    g[10:30, 380:420] = 0
    assert [e.box for e in pagelayout.page_numbers(g)] == [(380, 10, 420, 30)]
    rng = np.random.default_rng(7)
    g[515:560, 500:700] = np.where(rng.random((45, 200)) > 0.5, 0, 255)
    found = pagelayout.signatures(g)
    assert all(e.type == "signature" and e.box[0] >= 400 for e in found)


def test_region_preprocessors():
    rng = np.random.default_rng(8)
    crop = rng.integers(0, 256, (24, 30, 3)).astype(np.uint8)
    for kind in images.REGION_STEPS:
        for img in (crop, crop[..., 0]):
            out = images.preprocess_region(img, kind, {})
            assert out.dtype == np.uint8 and out.ndim == (3 if kind == "stamp" else 2), kind
    assert images.preprocess_region(crop, "data_cell", {}).shape == (18, 24)
    assert set(np.unique(images.preprocess_region(crop, "header_row", {}))) <= {0, 255}
    assert (images.preprocess_region(crop, "unknown", {}) == images.preprocess_region(crop, "printed_text", {})).all()
    assert images.preprocess_region(crop, "stamp", {"region:stamp": lambda x: x[:1]}).shape[0] == 1


def test_cascade():
    say = lambda text, c: lambda crop: (text, c)
    fails = lambda crop: 1 / 0
    crop = np.zeros((4, 4), np.uint8)
    assert ocr.Cascade(say("a", 0.1), say("b", 0.9))(crop) == ("a", 0.1)
    assert ocr.Cascade(say("", 0.0), say("b", 0.1), say("ccc", 0.5))(crop) == ("b", 0.1)
    assert ocr.Cascade(None, say("b", 0.1), say("ccc", 0.5), voting=True)(crop) == ("ccc", 0.5)
    assert ocr.Cascade(fails, fails, say("ccc", 0.5))(crop) == ("ccc", 0.5)
    assert ocr.Cascade(None, None, say("ccc", 0.5))(crop) == ("ccc", 0.5) and ocr.registered({})(crop) == ("", 0.0)
    for engine in (ocr.TrOCR("no model"), ocr.EasyOCR(), ocr.Tesseract(program="no such program")):
        assert engine(crop) == ("", 0.0)


def test_stamps_look_in_full_at_vivid_pixels_only(monkeypatch):
    img = np.full((300, 400, 3), 240, np.uint8)
    img[100:140, 200:240] = (30, 30, 200)
    img[0:30, 0:30] = (200, 40, 20)  # at the page's corner
    img[200:220, 50:300] = 0
    whole, looked = vision.to_hsv, []
    monkeypatch.setattr(vision, "to_hsv", lambda x: looked.append(x.size // 3) or whole(x))
    found = [(e.box, e.properties["color"]) for e in pagelayout.stamps(img)]
    assert found == [((200, 100, 240, 140), "red"), ((0, 0, 30, 30), "blue")]
    assert sum(looked) == 40 * 40 + 30 * 30


def test_contours_look_at_the_box_around_the_parts(monkeypatch):
    mask = np.zeros((500, 600), bool)
    mask[400:420, 500:530] = True
    mask[405:410, 505:510] = False
    seen, runs = [], vision._Runs
    monkeypatch.setattr(vision, "_Runs", lambda m, diagonal: seen.append(m.size) or runs(m, diagonal))
    (c,) = vision.contours(mask)
    assert (c.x, c.y, c.w, c.h, c.area) == (500, 400, 30, 20, 29 * 19)
    assert max(seen) <= 22 * 32


def test_denoise_takes_many_neighbours_at_once(monkeypatch):
    g = np.random.default_rng(3).integers(0, 256, (30, 40)).astype(np.uint8)
    exp, calls = np.exp, []
    monkeypatch.setattr(vision.np, "exp", lambda *a, **k: calls.append(1) or exp(*a, **k))
    vision.denoise(g)
    assert len(calls) < 60  # there are 220 neighbours


def test_denoise_leaves_even_surroundings_out(monkeypatch):
    page = np.full((120, 300), 250, np.uint8)
    page[:, 100:104] = 0
    whole = vision._rounded(vision._means(np.pad(page, 13, mode="reflect")[..., None], 3, 7, 21))[..., 0]
    means, sizes = vision._means, []
    monkeypatch.setattr(vision, "_means", lambda x, *a: sizes.append((x.shape[0] - 26) * (x.shape[1] - 26)) or means(x, *a))
    assert (vision.denoise(page) == whole).all()
    assert sum(sizes) < 0.15 * page.size
    assert (vision.denoise(page[:, :60]) == 250).all() and len(sizes) == 2
