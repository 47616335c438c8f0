import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetdelta.operators import cells as R
from sheetdelta.operators import zones as Z
from sheetdelta.plans import compare

H, W = 40, 150


def draw(spark, images):
    rows = [
        ("d", s, rev, int(x), int(y)) for (s, rev), m in images.items() for y, x in zip(*np.nonzero(m))
    ]
    return spark.createDataFrame(rows, "doc_pair string, seq long, rev string, x long, y long")


def image(df, seq, rev=None, bits="bits", keep=("doc_pair", "seq", "rev")):
    out = np.zeros((H, W), bool)
    found = R.unpack(df, bits, keep).filter(F.col("seq") == seq)
    if rev:
        found = found.filter(F.col("rev") == rev)
    for r in found.select("x", "y").collect():
        out[r.y, r.x] = True
    return out


def grow(m, offsets):
    out = np.zeros_like(m)
    for dx, dy in offsets:
        ys, xs = np.nonzero(m)
        ys, xs = ys + dy, xs + dx
        ok = (ys >= 0) & (ys < H) & (xs >= 0) & (xs < W)
        out[ys[ok], xs[ok]] = True
    return out


def shrink(m, offsets):
    out = m.copy()
    for dx, dy in offsets:
        for y in range(H):
            for x in range(W):
                if 0 <= y + dy < H and 0 <= x + dx < W and not m[y + dy, x + dx]:
                    out[y, x] = False
    return out


def regions(m):
    seen, boxes = np.zeros_like(m), []
    for y, x in zip(*np.nonzero(m)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for p in range(max(0, a - 1), min(H, a + 2)):
                for q in range(max(0, b - 1), min(W, b + 2)):
                    if m[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        stack.append((p, q))
        ys, xs = zip(*cells)
        boxes.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    return sorted(boxes)


@pytest.fixture(scope="module")
def noise(spark):
    rng = np.random.default_rng(1)
    images = {(s, rev): rng.random((H, W)) < 0.35 for s in range(2) for rev in "AB"}
    dims = spark.createDataFrame([("d", s, W, H, 72.0) for s in range(2)], "doc_pair string, seq long, width long, height long, dpi double")
    return images, R.pack(draw(spark, images)).cache(), dims


def test_pack_round_trip(noise):
    images, words, _ = noise
    assert (image(words, 1, "B") == images[1, "B"]).all()


def test_disc_sizes():
    assert [len(R.disc(r)) for r in (1.3, 2.0, 3.2)] == [5, 13, 37]
    assert sorted(R.ellipse(1)) == sorted(R.CROSS)


def test_stencils(noise):
    images, words, dims = noise
    m = images[1, "B"]
    assert (image(R.clip(R.dilate(words, R.disc(3.2)), dims), 1, "B") == grow(m, R.disc(3.2))).all()
    for offsets in (R.CROSS, R.square(2)):
        assert (image(R.opening(words, offsets, dims), 1, "B") == grow(shrink(m, offsets), offsets)).all()
    ball = R.ellipse(4)
    assert (image(R.closing(words, ball, dims), 1, "B") == shrink(grow(m, ball), ball)).all()


def test_masks_zones_and_largest_region(noise):
    images, words, dims = noise
    masks = R.masks(R.side_by_side(words, R.KEYS, 1.0)).cache()
    near = R.disc(1.0)
    removed = images[0, "A"] & ~grow(images[0, "B"], near)
    added = images[0, "B"] & ~grow(images[0, "A"], near)
    changed = removed | added
    assert (image(masks, 0, None, "removed", R.KEYS) == removed).all()
    assert (image(masks, 0, None, "changed", R.KEYS) == changed).all()
    zones = Z.zone_boxes(Z.connected_zones(masks, "changed"))
    got = sorted((r.x, r.y, r.w, r.h, r.area) for r in zones.filter("seq = 0").collect())
    assert got == regions(changed)
    largest = max(changed[y:y + h, x:x + w].sum() for x, y, w, h, _ in got)
    assert Z.max_region(zones, masks).filter("seq = 0").first().max_region_changed_px == largest
    row = R.diff_metrics(masks, dims).filter("seq = 0").first()
    assert row.changed_px == changed.sum() and row.changed_px <= row.added_px + row.removed_px


def test_long_winding_stroke_is_one_zone(spark):
    m = np.zeros((H, W), bool)
    m[::4, :] = True
    for i, y in enumerate(range(0, H - 4, 4)):
        m[y:y + 4, W - 1 if i % 2 == 0 else 0] = True
    zones = Z.zone_boxes(Z.connected_zones(R.pack(draw(spark, {(0, "A"): m}))))
    assert [(r.w, r.h, r.area) for r in zones.collect()] == [(W, H - 3, int(m.sum()))]


def test_merge_joins_near_boxes_only(spark):
    m = np.zeros((H, W), bool)
    m[5:9, 5:9] = m[5:9, 11:15] = m[30:34, 100:104] = True
    words = R.pack(draw(spark, {(0, "A"): m}), R.KEYS, ()).withColumnRenamed("bits", "changed")
    dims = spark.createDataFrame([("d", 0, W, H)], "doc_pair string, seq long, width long, height long")
    zones = Z.zone_boxes(Z.connected_zones(words, "changed"))
    merged = sorted((r.x, r.y, r.w, r.h, r.merged) for r in Z.merge_zones(zones, words, dims, 2).collect())
    assert merged == [(5, 5, 10, 4, True), (100, 30, 4, 4, False)]
    apart = sorted(r.merged for r in Z.merge_zones(zones, words, dims, 0).collect())
    assert apart == [False, False, False]


@pytest.mark.parametrize("reach", [0, 3, 63])
def test_votes_of_all_shifts_across_tiles(spark, reach):
    rng = np.random.default_rng(reach)
    cells = {rev: {(int(x), int(y)) for x, y in zip(rng.integers(960, 1090, 60), rng.integers(230, 290, 60))} for rev in "AB"}
    rows = [("d", 1, rev, x, y) for rev, own in cells.items() for x, y in own] + [("d", 2, "A", 5, 5)]
    words = R.pack(spark.createDataFrame(rows, "doc_pair string, seq long, rev string, x long, y long"))
    want = {}
    for xa, ya in cells["A"]:
        for xb, yb in cells["B"]:
            if abs(xb - xa) <= reach and abs(yb - ya) <= reach:
                want[xb - xa, yb - ya] = want.get((xb - xa, yb - ya), 0) + 1
    votes = R.shift_votes(words, reach)
    assert {(r.dx, r.dy): r.votes for r in votes.collect()} == want
    # a word goes to the tiles next to it, not to every place that a shift can reach
    assert "Join" not in votes._jdf.queryExecution().toString()


def test_unpack_has_no_array_per_word(spark):
    words = spark.createDataFrame([("d", 1, "A", 3, 1, -(2**63) + 5)], "doc_pair string, seq long, rev string, y long, wx long, bits long")
    cells = R.unpack(words)
    assert [(r.x, r.y) for r in cells.orderBy("x").collect()] == [(64, 3), (66, 3), (127, 3)]
    assert "lambda" not in cells._jdf.queryExecution().toString()


def test_shift_is_found_and_undone(spark):
    rng = np.random.default_rng(4)
    a = rng.random((H, W)) < 0.2
    a[:4] = a[-4:] = a[:, :6] = a[:, -6:] = False
    b = np.roll(np.roll(a, 5, 1), -3, 0)
    words = R.pack(draw(spark, {(0, "A"): a, (0, "B"): b, (1, "A"): a, (1, "B"): a}))
    dims = spark.createDataFrame([("d", s, W, H) for s in (0, 1)], "doc_pair string, seq long, width long, height long")
    found = R.register_shift(words, dims, 6)
    rows = {r.seq: r for r in found.collect()}
    assert (rows[0].method, rows[0].shift_x, rows[0].shift_y, rows[0].residual_after) == ("SHIFT", 5, -3, 0)
    assert rows[1].method == "IDENTITY"
    assert (image(R.apply_shift(words, found), 0, "B") == a).all()


@pytest.mark.parametrize("dx, dy", [(42, -18), (36, 14), (12, 5), (-59, 31)])
def test_large_shifts_are_found_from_coarse_to_fine(spark, dx, dy):
    rng = np.random.default_rng(abs(dx))
    height, width = 400, 600
    a = np.zeros((height, width), bool)
    for _ in range(25):
        x, y, w, h = rng.integers(70, 480), rng.integers(60, 300), rng.integers(10, 50), rng.integers(10, 40)
        a[[y, y + h], x : x + w] = True
        a[y : y + h, [x, x + w]] = True
    b = np.roll(a, (dy, dx), (0, 1))
    noise = rng.random((height, width)) < 0.02
    images = {(0, "A"): a, (0, "B"): b, (1, "A"): noise, (1, "B"): rng.random((height, width)) < 0.02}
    words = R.pack(draw(spark, images))
    dims = spark.createDataFrame([("d", s, width, height) for s in (0, 1)], "doc_pair string, seq long, width long, height long")
    found = {r.seq: r for r in R.register_shift(words, dims).collect()}
    assert (found[0].method, found[0].shift_x, found[0].shift_y, found[0].residual_after) == ("SHIFT", dx, dy, 0)
    assert found[1].method in ("SHIFT_FAILED", "ALREADY_ALIGNED") and found[1].shift_x == 0


def test_halved_grid(spark):
    rng = np.random.default_rng(3)
    m = rng.random((H, W)) < 0.05
    found = R.unpack(R.halve(R.pack(draw(spark, {(0, "A"): m}))), "bits", ("doc_pair", "seq", "rev")).select("x", "y").collect()
    assert {(r.x, r.y) for r in found} == {(int(x) // 2, int(y) // 2) for y, x in zip(*np.nonzero(m))}


def test_line_weight_changes_are_ignored_but_new_lines_stay(spark):
    a, b = np.zeros((H, W), bool), np.zeros((H, W), bool)
    a[10:12, 10:120] = True
    b[9:13, 10:120] = True
    b[30, 10:120] = True
    words = R.pack(draw(spark, {(0, "A"): a, (0, "B"): b}))
    dims = spark.createDataFrame([("d", 0, W, H)], "doc_pair string, seq long, width long, height long")
    masks = R.masks(R.side_by_side(words))
    kept = Z.ignore_line_weight(masks, Z.line_weight_envelope(words, dims, 1.0, 72.0))
    left = image(kept, 0, None, "changed", R.KEYS)
    assert not left[:20].any() and left[30, 10:120].all()


def test_excluded_region_and_identical_sheet(spark):
    a = np.zeros((H, W), bool)
    a[5:15, 5:25] = True
    b = a.copy()
    b[20:32, 60:90] = True
    words = R.pack(draw(spark, {(0, "A"): a, (0, "B"): b, (1, "A"): a, (1, "B"): a}))
    sizes = spark.createDataFrame(
        [("d", s, W, H, W, H, 72.0) for s in (0, 1)],
        "doc_pair string, seq long, width_a long, height_a long, width_b long, height_b long, dpi double",
    )
    details, zones = compare.diff_sheets(words, sizes, compare.DiffSettings(dpi=72.0))
    rows = {r.seq: r for r in details.collect()}
    assert rows[0].bboxes_count == 1 and rows[0].removed_px == 0 and rows[0].change_level == "major"
    assert rows[1].change_level == "unchanged" and rows[1].diff_area_px == 0 and rows[1].alignment_method == "IDENTITY"
    box = zones.first()
    assert (box.x, box.y, box.w, box.h) == (60, 20, 30, 12)
    hidden = spark.createDataFrame([("d", 58.0, 18.0, 40.0, 20.0, "px", "top_left")], "doc_pair string, x double, y double, w double, h double, unit string, anchor string")
    masked, _ = compare.diff_sheets(words, sizes, compare.DiffSettings(dpi=72.0), hidden)
    assert {r.change_level for r in masked.collect()} == {"unchanged"}


@pytest.mark.parametrize("lines, words, share", [(4, 1, 0.3), (8, 2, 0.42), (512, 16, 0.42)])
def test_regions_over_many_tiles_equal_flood_fill(spark, monkeypatch, lines, words, share):
    monkeypatch.setattr(Z, "LABEL_ROWS", lines)
    monkeypatch.setattr(Z, "LABEL_WORDS", words)
    rng = np.random.default_rng(lines)
    mask = rng.random((70, 300)) < share
    mask[10:60:4, :] = True
    mask[:, 64:300:64] &= rng.random((70, 4)) < 0.9
    ys, xs = np.nonzero(mask)
    word = packed(spark, mask)
    want, seen = {}, set()
    for y, x in zip(ys.tolist(), xs.tolist()):
        if (y, x) in seen:
            continue
        seen.add((y, x))
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            want[a, b] = (y << 32) + x
            for c in range(max(0, a - 1), min(70, a + 2)):
                for d in range(max(0, b - 1), min(300, b + 2)):
                    if mask[c, d] and (c, d) not in seen:
                        seen.add((c, d))
                        stack.append((c, d))
    found = {(r.y, x): r.label for r in Z.connected_zones(word).collect() for x in range(r.x0, r.x1 + 1)}
    assert found == want and len(set(want.values())) > 3


def packed(spark, mask):
    ys, xs = np.nonzero(mask)
    cells = spark.createDataFrame([("d", 0, int(x), int(y)) for y, x in zip(ys, xs)], "doc_pair string, seq long, x long, y long")
    return cells.groupBy("doc_pair", "seq", "y", F.floor(F.col("x") / 64).alias("wx")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x % 64 as int))")).alias("bits"))


def flood(free, start, steps):
    seen, stack = np.zeros(free.shape, bool), [start]
    seen[start] = True
    while stack:
        y, x = stack.pop()
        for dy, dx in steps:
            a, b = y + dy, x + dx
            if 0 <= a < free.shape[0] and 0 <= b < free.shape[1] and free[a, b] and not seen[a, b]:
                seen[a, b] = True
                stack.append((a, b))
    return seen


def brute_outer(mask):
    """Filled regions by flood fill, the area by the corners of the traced squares."""
    sides = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    outside = flood(~np.pad(mask, 1), (0, 0), sides)[1:-1, 1:-1]
    whole, out = ~outside, []
    left = whole.copy()
    while left.any():
        y, x = (int(v[0]) for v in np.nonzero(left))
        own = flood(whole, (y, x), [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        left &= ~own
        ys, xs = np.nonzero(own)
        quad = own[:-1, :-1].astype(int) + own[1:, :-1] + own[:-1, 1:] + own[1:, 1:]
        out.append((int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1, float((quad == 4).sum() + (quad == 3).sum() / 2), int(own.sum())))
    return sorted(out)


def rings():
    mask = np.zeros((60, 200), bool)
    for k, (y, x, h, w) in enumerate([(2, 2, 50, 150), (6, 8, 40, 120), (10, 60, 30, 60), (14, 70, 20, 8)]):
        mask[y : y + h, x : x + w] = k % 2 == 3
        mask[[y, y + h - 1], x : x + w] = mask[y : y + h, x] = mask[y : y + h, x + w - 1] = True
    mask[55, 10:190] = True                                   # a line has no area
    mask[20:30, 170:190] = True
    mask[22:26, 172:180] = False
    mask[22, 171] = False                                      # open only over a corner
    mask[31, 191] = mask[30, 190] = True
    return mask


@pytest.mark.parametrize("seed", [None, 1, 2, 3])
def test_outer_zones_equal_flood_fill(spark, seed):
    mask = rings() if seed is None else np.random.default_rng(seed).random((50, 150)) < (0.3, 0.5, 0.62)[seed - 1]
    found = sorted((r.x, r.y, r.w, r.h, r.area, r.cells) for r in Z.outer_zones(packed(spark, mask)).collect())
    assert found == brute_outer(mask)


def test_blur_by_tiles_equals_the_stencil(spark):
    draw_ = np.random.default_rng(3)
    gray = np.where(draw_.random((9, 11)) < 0.4, draw_.integers(0, 256, (9, 11)), 255)
    rows = [("d", 1, "A", int(x), int(y), int(gray[y, x])) for y in range(9) for x in range(11)] + [("d", 1, "A", None, 2, 7)]
    cells = spark.createDataFrame(rows, "doc_pair string, seq long, rev string, x long, y long, v long")
    dims = spark.createDataFrame([("d", 1, 11, 9)], "doc_pair string, seq long, width long, height long")
    edged = np.pad(gray, 1, mode="reflect")
    total = sum((2 - abs(dx)) * (2 - abs(dy)) * edged[1 + dy : 10 + dy, 1 + dx : 12 + dx] for dx in (-1, 0, 1) for dy in (-1, 0, 1))
    want = (total + 8) // 16
    found = {(r.x, r.y): r.v for r in R.blur(cells, dims, tile=4).collect()}
    assert found == {(x, y): want[y, x] for y in range(9) for x in range(11) if want[y, x] != 255}


def test_stroke_runs_over_word_borders_with_cells_given_twice(spark):
    rows = [("d", 1, "A", x, 5) for x in [*range(60, 200), *range(0, 3), 63, 64, 64, 250, 255, 256, 319, 320]]
    rows += [("d", 1, "A", None, 5), ("d", 1, "B", 64, 5)]
    cells = spark.createDataFrame(rows, "doc_pair string, seq long, rev string, x long, y long")
    found = {(r.rev, r.line, r["first"], r["last"]) for r in Z.stroke_runs(cells).collect()}
    assert found == {("A", 5, 60, 199), ("A", 5, 0, 2), ("A", 5, 250, 250), ("A", 5, 255, 256), ("A", 5, 319, 320), ("A", 5, None, None), ("B", 5, 64, 64)}
    turned = cells.selectExpr("doc_pair", "seq", "rev", "x as y", "y as x")
    assert {(r.rev, r.line, r["first"], r["last"]) for r in Z.stroke_runs(turned, "y").collect()} == found


@pytest.mark.parametrize("tile", [(256, 16), (8, 1)])
def test_stencils_by_tiles_move_a_word_once(spark, noise, monkeypatch, tile):
    images, words, dims = noise
    monkeypatch.setattr(R, "STENCIL_ROWS", tile[0])
    monkeypatch.setattr(R, "STENCIL_WORDS", tile[1])
    m = images[0, "A"]
    words = spark.createDataFrame(words.collect(), words.schema)
    for offsets in (R.CROSS, R.square(2)):
        opened = R.opening(words, offsets, dims)
        assert (image(opened, 0, "A") == grow(shrink(m, offsets), offsets)).all()
        assert (image(R.erode(words, offsets, dims), 0, "A") == shrink(m, offsets)).all()
        # no array of moved words is exploded and aggregated again
        assert "bit_or" not in opened._jdf.queryExecution().optimizedPlan().toString()
    ball = R.ellipse(3)
    assert (image(R.closing(words, ball, dims), 0, "A") == shrink(grow(m, ball), ball)).all()


def test_runs_of_full_and_broken_words(spark):
    words = spark.createDataFrame([("d", 1, 0, 0, -1), ("d", 1, 1, 2, 0b1011), ("d", 1, 2, 1, -(1 << 63)), ("d", 1, 3, 0, 0), ("d", 1, 4, 0, (1 << 63) - 1), ("d", 1, 5, 0, -2)],
                                  "doc_pair string, seq long, y long, wx long, bits long")
    found = Z.word_runs(words)
    assert sorted((r.y, r.x0, r.x1) for r in found.collect()) == [(0, 0, 63), (1, 128, 129), (1, 131, 131), (2, 127, 127), (4, 0, 62), (5, 1, 63)]
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("reach", [0, 2, 8])
def test_many_tiles_are_voted_on_in_one_call(reach, monkeypatch):
    monkeypatch.setattr(R, "_STACK", 200)     # a few tiles at a time
    rng = np.random.default_rng(3)
    tiles = []
    for tile in range(12):
        own, y, wx = rng.integers(0, 2 if tile else 1, 40).astype(bool), rng.integers(-5, 30, 40), rng.integers(-1, 3, 40)
        _, at = np.unique(np.stack([own, y, wx]), axis=1, return_index=True)
        tiles.append((own[at], y[at], wx[at], rng.integers(1, 2**62, len(at)) * rng.choice([-1, 1], len(at))))
    first = np.cumsum([0, *[len(t[0]) for t in tiles]])[:-1]
    votes = R._tile_votes(first, *[np.concatenate(c) for c in zip(*tiles)], reach)

    def cells(tile, mine):
        return {(y, 64 * w + i) for own, y, w, b in zip(*(c.tolist() for c in tile)) if own == mine for i in range(64) if b >> i & 1}

    for tile, found in zip(tiles, votes):
        a, b = cells(tile, True), cells(tile, False)
        expected = [[len(a & {(y - dy, x - dx) for y, x in b}) for dx in range(-reach, reach + 1)] for dy in range(-reach, reach + 1)]
        assert found.tolist() == expected
