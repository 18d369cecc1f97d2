"""Whole-image operators in numpy, for one image at a time. Colours are BGR; nothing here changes its input."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..config import SETTINGS, Settings
from .pixels import BINOMIAL, ELLIPSE

#: Steps of the chamfer distance to side, corner and knight's-move neighbours.
SIDE, CORNER, KNIGHT = 1.0, 1.4, 2.1969
#: Shares of a blob's greatest depth at which its peaks are counted.
PEAK_SHARES = tuple(round(0.30 + 0.05 * i, 2) for i in range(13))
#: Levels of depth that flooding tells apart.
LEVELS = 256
#: How hard PNG data is packed: the pixels are the same at all levels, and higher ones take several times as long.
PNG_LEVEL = 1
#: Pixels of a turned image that are computed at once.
BLOCK = 1 << 15
AROUND = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def to_gray(image: np.ndarray) -> np.ndarray:
    c = image.astype(np.int32)
    return ((c[..., 0] * 1868 + c[..., 1] * 9617 + c[..., 2] * 4899 + 8192) >> 14).astype(np.uint8)


def blur(gray: np.ndarray) -> np.ndarray:
    """5 x 5 binomial blur with mirrored borders."""
    padded = np.pad(gray.astype(np.int32), 2, mode="reflect")
    h, w = gray.shape
    rows = sum(k * padded[i : i + h] for i, k in enumerate(BINOMIAL))
    return ((sum(k * rows[:, i : i + w] for i, k in enumerate(BINOMIAL)) + 128) >> 8).astype(np.uint8)


def otsu(gray: np.ndarray) -> int:
    """The level with the largest variance between the classes it parts."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    w, m = n.cumsum(), (n * np.arange(256)).cumsum()
    rest = w[-1] - w
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((w > 0) & (rest > 0), (m[-1] * w - w[-1] * m) ** 2 / (w * rest), 0)
    return int(score.argmax())


def _extreme(mask: np.ndarray, how, edge: int) -> np.ndarray:
    padded = np.pad(mask, 2, constant_values=edge)
    h, w = mask.shape
    return how.reduce([padded[j : j + h, i : i + w] for j, row in enumerate(ELLIPSE) for i, on in enumerate(row) if on])


def erode(mask: np.ndarray) -> np.ndarray:
    return _extreme(mask, np.minimum, 255)


def dilate(mask: np.ndarray) -> np.ndarray:
    return _extreme(mask, np.maximum, 0)


def build_mask(image: np.ndarray, settings: Settings = SETTINGS) -> np.ndarray:
    """255 where pieces are: blurred gray above the threshold, specks opened, pinholes closed."""
    smooth = blur(to_gray(image))
    level = otsu(smooth) if settings.threshold is None else settings.threshold
    mask = np.where(smooth > level, 255, 0).astype(np.uint8)
    return erode(dilate(dilate(erode(mask))))


def components(mask: np.ndarray) -> tuple[int, np.ndarray]:
    """(count, labels from 1 on) of 8-connected non-zero pixels, numbered by their first pixel in reading order.

    Runs of each row are united with those they touch in the row above, all rows at once.
    """
    h, w = mask.shape
    on = np.pad(mask > 0, ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(on, axis=1)
    y, begin = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    # Places in one line for all rows, so wide that runs of other rows lie apart.
    above = (y - 1) * (w + 2)
    first = np.searchsorted(y * (w + 2) + end, above + begin, "left")
    touched = np.searchsorted(y * (w + 2) + begin, above + end, "right") - first
    lower = np.repeat(np.arange(len(y)), touched)
    upper = np.arange(len(lower)) + np.repeat(first - (np.cumsum(touched) - touched), touched)
    root = np.arange(len(y))
    while len(lower):
        low, high = root[lower], root[upper]
        apart = low != high
        lower, upper, low, high = lower[apart], upper[apart], low[apart], high[apart]
        np.minimum.at(root, np.maximum(low, high), np.minimum(low, high))
        while not np.array_equal(root, ahead := root[root]):
            root = ahead
    firsts, number = np.unique(root, return_inverse=True)
    edges = np.zeros((h, w + 1), np.int32)
    edges[y, begin] = number + 1
    edges[y, end] = -(number + 1)
    return len(firsts), np.cumsum(edges, axis=1, dtype=np.int32)[:, :w]


def trace(region: np.ndarray) -> np.ndarray:
    """The outer border of a region's first component as points (x, y), clockwise, without points amid straight runs."""
    on = np.pad(region > 0, 1)
    ys, xs = np.nonzero(on)
    start = (int(ys[0]), int(xs[0]))
    border, at, back = [start], start, 4
    second = None
    while True:
        for k in range(1, 9):
            d = (back + k) % 8
            to = (at[0] + AROUND[d][0], at[1] + AROUND[d][1])
            if on[to]:
                break
        else:
            break  # a single pixel
        if at == start and second == to and len(border) > 1:
            border.pop()
            break
        second = second or to
        border.append(to)
        at, back = to, (d + 4) % 8
    points = np.array([(x - 1, y - 1) for y, x in border], np.int32)
    if len(points) < 3:
        return points
    before, after = points - np.roll(points, 1, 0), np.roll(points, -1, 0) - points
    return points[(before != after).any(1)]


def contour_area(points: np.ndarray) -> float:
    """The area the closed line of points encloses."""
    x, y = points[:, 0].astype(float), points[:, 1].astype(float)
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def contour_bbox(points: np.ndarray) -> tuple[int, int, int, int]:
    (x0, y0), (x1, y1) = points.min(0), points.max(0)
    return int(x0), int(y0), int(x1 - x0 + 1), int(y1 - y0 + 1)


def fill(shape: tuple[int, int], points: np.ndarray) -> np.ndarray:
    """A mask of the polygon, its border included."""
    h, w = shape
    out = np.zeros(shape, np.uint8)
    if not len(points):
        return out
    x0, y0, bw, bh = contour_bbox(points)
    ys = np.arange(max(0, y0), min(h, y0 + bh))
    xs = np.arange(max(0, x0), min(w, x0 + bw))
    # A side turns all pixels from where it crosses their row.
    (ax, ay), (bx, by) = points.T, np.roll(points, -1, 0).T
    low, high = (np.clip(f(ay, by), ys[0], ys[-1] + 1) if len(ys) else np.zeros_like(ay) for f in (np.minimum, np.maximum))
    side = np.repeat(np.arange(len(points)), high - low)
    rows = np.arange(len(side)) - np.repeat(np.cumsum(high - low) - high, high - low)
    cross = ax[side] + (rows - ay[side]) * (bx - ax)[side] / (by - ay)[side]
    turns = np.zeros((len(ys), len(xs) + 1), np.int32)
    np.add.at(turns, (rows - (ys[0] if len(ys) else 0), np.clip(np.ceil(cross).astype(np.int64) - (xs[0] if len(xs) else 0), 0, len(xs))), 1)
    inside = np.cumsum(turns, axis=1)[:, : len(xs)] % 2 > 0
    out[np.ix_(ys, xs)] = np.where(inside, 255, 0)
    return np.maximum(out, outline(shape, points, 1))


def outline(shape: tuple[int, int], points: np.ndarray, thickness: int) -> np.ndarray:
    """A mask of the closed line of points, of about the given width."""
    h, w = shape
    out = np.zeros(shape, np.uint8)
    reach = range(-((thickness - 1) // 2), thickness // 2 + 1)
    if not len(points):
        return out
    begin = points.astype(np.int64)
    way = np.roll(begin, -1, 0) - begin
    n = np.maximum(np.abs(way).max(1), 1)
    side = np.repeat(np.arange(len(points)), n + 1)
    i = np.arange(len(side)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
    n = n[side]
    xs, ys = ((2 * (begin[side, k] * n + i * way[side, k]) + n) // (2 * n) for k in (0, 1))
    for dy in reach:
        for dx in reach:
            ok = (ys + dy >= 0) & (ys + dy < h) & (xs + dx >= 0) & (xs + dx < w)
            out[ys[ok] + dy, xs[ok] + dx] = 255
    return out


def boxes_of(count: int, labels: np.ndarray) -> list[tuple[slice, slice]]:
    """The rows and columns that each label from 1 to count extends over, by one pass over the pixels."""
    y, x = np.nonzero(labels)
    own = labels[y, x] - 1
    low, high = np.full((2, count), max(labels.shape)), np.zeros((2, count), int)
    for k, v in enumerate((y, x)):
        np.minimum.at(low[k], own, v)
        np.maximum.at(high[k], own, v + 1)
    return [(slice(*r[:2]), slice(*r[2:])) for r in zip(low[0].tolist(), high[0].tolist(), low[1].tolist(), high[1].tolist(), strict=True)]


def find_blobs(mask: np.ndarray, settings: Settings = SETTINGS) -> list[np.ndarray]:
    """Contours of the mask's components, but those of less than a share of the median area (of all of them)."""
    n, labels = components(mask)
    found = [trace(labels[box] == i) + np.array([box[1].start, box[0].start], np.int32) for i, box in enumerate(boxes_of(n, labels), 1)]
    middle = median_area(found)
    return [c for c in found if contour_area(c) >= settings.least_area * middle]


def median_area(contours: list[np.ndarray]) -> float:
    return float(np.median([contour_area(c) for c in contours])) if contours else 0.0


def depth(mask: np.ndarray) -> np.ndarray:
    """Chamfer distance of each pixel to the nearest zero, by relaxing until nothing changes; beyond the image all is far."""
    steps = [((dy, dx), SIDE if abs(dy) + abs(dx) == 1 else CORNER if abs(dy) == abs(dx) else KNIGHT) for dy in range(-2, 3) for dx in range(-2, 3) if (dy, dx) != (0, 0) and max(abs(dy), abs(dx)) + min(abs(dy), abs(dx)) <= 3 and (abs(dy), abs(dx)) not in ((2, 0), (0, 2))]
    far = np.float64(1e9)
    out = np.where(mask > 0, far, 0.0)
    h, w = mask.shape
    while True:
        padded = np.pad(out, 2, constant_values=far)
        new = out
        for (dy, dx), cost in steps:
            new = np.minimum(new, padded[2 + dy : 2 + dy + h, 2 + dx : 2 + dx + w] + cost)
        if np.array_equal(new, out):
            return np.where(out >= far, 0.0, out)
        out = new


def _window(shape: tuple[int, int], points: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """A mask of the blob with a border of one, and the offset (x, y) of its corner."""
    x, y, w, h = contour_bbox(points)
    return fill((h + 2, w + 2), points - np.array([x - 1, y - 1])), (x - 1, y - 1)


def peak_count(shape: tuple[int, int], points: np.ndarray) -> int:
    """The most parts that a blob falls into when cut off at shares of its greatest depth, one at least."""
    mask, _ = _window(shape, points)
    deep = depth(mask)
    return max(1, *(components(deep > share * deep.max())[0] for share in PEAK_SHARES)) if deep.max() > 0 else 1


def unit_area(shape: tuple[int, int], contours: list[np.ndarray], settings: Settings = SETTINGS) -> float:
    """The area of one piece: the median of enough blobs, else that of areas shared among peaks."""
    if not contours:
        return 0.0
    if len(contours) >= settings.enough_blobs:
        return median_area(contours)
    return float(np.median([contour_area(c) / max(1, peak_count(shape, c)) for c in contours]))


def flood(deep: np.ndarray, markers: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Markers grown over the mask, deepest level first.

    Depths are told apart as LEVELS levels. Pixels wait in a bucket for each level; a level's
    pixels are taken as whole fronts, and one that several reach at once goes with the deepest of
    these, of equals with the marker of least number. What a front reaches that is deeper than the
    level belongs to its next front.
    """
    h, w = mask.shape
    labels, free_ = np.pad(markers, 1).ravel(), np.pad(mask > 0, 1).ravel()
    level = np.pad(np.minimum(deep / (deep.max() or 1) * LEVELS, LEVELS - 1).astype(np.int64), 1).ravel()
    shallow = -np.pad(np.rint(deep * 10_000).astype(np.int64), 1).ravel()
    steps = np.array([dy * (w + 2) + dx for dy, dx in AROUND])
    buckets: list[list[np.ndarray]] = [[] for _ in range(LEVELS)]

    def wait(at: np.ndarray, now: int) -> None:
        found = np.stack([(at[:, None] + steps).ravel(), *np.repeat([labels[at], shallow[at]], len(steps), 1)])
        found = found[:, free_[found[0]] & (labels[found[0]] == 0)]
        when = np.minimum(level[found[0]], now)
        order = np.argsort(when, kind="stable")
        levels, first = np.unique(when[order], return_index=True)
        for k, part in zip(levels.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ():
            buckets[k].append(found[:, part])

    wait(np.flatnonzero(labels), LEVELS - 1)
    for now in range(LEVELS - 1, -1, -1):
        while buckets[now]:
            found = np.concatenate(buckets[now], axis=1)
            buckets[now] = []
            to, label, _ = found[:, np.lexsort((found[1], found[2], found[0]))]
            fresh = np.concatenate([[True], to[1:] != to[:-1]]) & (labels[to] == 0)
            labels[to[fresh]] = label[fresh]
            wait(to[fresh], now)
    return labels.reshape(h + 2, w + 2)[1:-1, 1:-1]


def split_blob(shape: tuple[int, int], points: np.ndarray, expected: int, settings: Settings = SETTINGS) -> list[np.ndarray]:
    """A blob cut into as many pieces as expected, if some cut-off depth gives so many cores; else what it gives."""
    if expected <= 1:
        return [points]
    mask, (ox, oy) = _window(shape, points)
    deep = depth(mask)
    low, high = 0.05, 0.95
    n, cores = 0, None
    for _ in range(settings.split_steps):
        mid = (low + high) / 2
        n, cores = components(deep > mid * deep.max())
        if n == expected:
            break
        low, high = (low, mid) if n > expected else (mid, high)
    if not n:
        return [points]
    labels = flood(deep, cores, mask > 0)
    parts = []
    for i in range(1, n + 1):
        count, own = components(labels == i)
        if count:
            parts.append(max((trace(own == k) for k in range(1, count + 1)), key=contour_area) + np.array([ox, oy], np.int32))
    return parts or [points]


def extract_contours(image: np.ndarray, settings: Settings = SETTINGS) -> list[np.ndarray]:
    """The contours of the pieces of a photo, ordered by their top, then left."""
    return split_blobs(image.shape[:2], find_blobs(build_mask(image, settings), settings), settings)


def split_blobs(shape: tuple[int, int], blobs: list[np.ndarray], settings: Settings = SETTINGS) -> list[np.ndarray]:
    """The contours of the pieces that blobs consist of, ordered by their top, then left."""
    unit = unit_area(shape, blobs, settings)
    out: list[np.ndarray] = []
    for blob in blobs:
        size = contour_area(blob)
        expected = 1 if unit <= 0 or size < settings.split_from * unit else max(1, round(size / unit))
        out += split_blob(shape, blob, expected, settings)
    return sorted(out, key=lambda c: (int(c[:, 1].min()), int(c[:, 0].min())))


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """By area averages when it shrinks, by cubic interpolation when it grows."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image.copy()
    shrink = width * height < w * h
    across, down = _weights(w, width, shrink), _weights(h, height, shrink)
    wide = across @ image.astype(np.float64).reshape(h, w, -1)
    out = (down @ wide.reshape(h, -1)).reshape(height, *wide.shape[1:])
    return np.clip(np.rint(out, out=out), 0, 255, out=out).astype(np.uint8)


def _weights(old: int, new: int, area: bool) -> np.ndarray:
    """(new, old) weights along one axis."""
    scale = old / new
    out = np.zeros((new, old))
    if area:
        lo = np.arange(new) * scale
        for j in range(old):
            out[:, j] = np.clip(np.minimum(lo + scale, j + 1) - np.maximum(lo, j), 0, None)
        return out / out.sum(1, keepdims=True)
    at = (np.arange(new) + 0.5) * scale - 0.5
    base = np.floor(at).astype(int)
    a = -0.75
    for k in range(-1, 3):
        t = np.abs(at - (base + k))
        weight = np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a)
        np.add.at(out, (np.arange(new), np.clip(base + k, 0, old - 1)), weight)
    return out


def crop_piece(image: np.ndarray, points: np.ndarray, neighbours: list[np.ndarray] | tuple = (), settings: Settings = SETTINGS, edge: int | None = None) -> np.ndarray:
    """The piece's box with its margin, neighbours painted over (never the piece itself), its longer side scaled to the edge."""
    x, y, w, h = contour_bbox(points)
    x0, y0 = max(0, x - settings.pad), max(0, y - settings.pad)
    x1, y1 = min(image.shape[1], x + w + settings.pad), min(image.shape[0], y + h + settings.pad)
    crop = image[y0:y1, x0:x1].copy()
    if not crop.size:
        return crop
    corner, shape = np.array([x0, y0]), crop.shape[:2]
    other = np.zeros(shape, np.uint8)
    for c in neighbours:
        nx, ny, nw, nh = contour_bbox(c)
        if nx < x1 and ny < y1 and nx + nw > x0 and ny + nh > y0:
            other = np.maximum(other, fill(shape, c - corner))
    crop[(other > 0) & (fill(shape, points - corner) == 0)] = settings.fill
    scale = (edge or settings.crop_edge) / max(shape)
    return resize(crop, max(1, round(shape[1] * scale)), max(1, round(shape[0] * scale)))


def thumbnail(image: np.ndarray, points: np.ndarray, settings: Settings = SETTINGS, size: int | None = None) -> np.ndarray:
    """The piece with its margin at a small size."""
    return crop_piece(image, points, (), settings, size or settings.thumbnail)


class Sampler:
    """Bilinear samples of a BGR image; beyond the image the given gray, or the nearest pixel for None.

    Pixels are four bytes, the last of which tells whether the next ones to the right and below
    differ: where the four around a place are alike, the sample is what they are, and only the
    others are computed.
    """

    def __init__(self, image: np.ndarray, outside: int | None):
        self.h, self.w = image.shape[:2]
        around = {"mode": "edge"} if outside is None else {"constant_values": outside}
        wide = np.zeros((self.h + 4, self.w + 4, 4), np.uint8)
        wide[..., :3] = np.pad(image, ((2, 2), (2, 2), (0, 0)), **around)
        flat = wide.view(np.uint32)[..., 0]
        wide[:-1, :-1, 3] = (flat[:-1, :-1] != flat[:-1, 1:]) | (flat[:-1, :-1] != flat[1:, :-1]) | (flat[:-1, :-1] != flat[1:, 1:])
        self.bytes, self.whole, self.step = wide.reshape(-1, 4), flat.ravel(), self.w + 4

    def at(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The samples at places of any shape, with an axis for the colours."""
        x0, y0 = np.floor(x), np.floor(y)
        fx, fy = x - x0, y - y0
        # Two pixels out and beyond, all pixels are alike. A place's number is a whole one that doubles hold.
        spot = np.clip(y0, -2.0, float(self.h), out=y0)
        spot += 2
        spot *= self.step
        spot += np.clip(x0, -2.0, float(self.w), out=x0)
        spot = spot.astype(np.intp).ravel() + 2
        found = self.whole.take(spot, mode="clip")
        uneven = np.flatnonzero(found.view(np.uint8)[3::4] != 0)
        first, fx, fy = spot[uneven], fx.ravel()[uneven], fy.ravel()[uneven]
        a, b, c, d = (self.whole.take(first + s, mode="clip").view(np.uint8) for s in (0, 1, self.step, self.step + 1))
        left, top, out = 1 - fx, 1 - fy, np.empty((*x.shape, 3), np.uint8)
        for k in range(3):
            one = found.view(np.uint8)[k::4]
            one[uneven] = np.rint((a[k::4] * left + b[k::4] * fx) * top + (c[k::4] * left + d[k::4] * fx) * fy)
            out[..., k] = one.reshape(x.shape)
        return out


def rotate_expand(image: np.ndarray, angle: int, gray: int = SETTINGS.fill, sampler: Sampler | None = None) -> np.ndarray:
    """Turned counter-clockwise on a canvas that holds all of it; full turns give the image itself. ``sampler``, if it has been made, is the image's with that gray."""
    if angle % 360 == 0:
        return image
    h, w = image.shape[:2]
    s, c = np.sin(np.radians(angle)), np.cos(np.radians(angle))
    new_w, new_h = int(h * abs(s) + w * abs(c)), int(h * abs(c) + w * abs(s))
    dx, dy = np.arange(new_w) - new_w / 2, np.arange(new_h)[:, None] - new_h / 2
    own, out = sampler or Sampler(image, gray), np.full((new_h, new_w, 3), gray, np.uint8)
    place = lambda dx, dy: (c * dx - s * dy + w / 2, s * dx + c * dy + h / 2)
    # Some rows at a time, so that what is computed on the way stays in the processor's cache, and of them the columns that reach the image in the first or the last row or between.
    some = max(1, BLOCK // max(1, new_w))
    for i in range(0, new_h, some):
        part = dy[i : i + some]
        (ax, ay), (bx, by) = place(dx, part[0]), place(dx, part[-1])
        columns = np.flatnonzero((np.maximum(ax, bx) > -2) & (np.minimum(ax, bx) < w + 1) & (np.maximum(ay, by) > -2) & (np.minimum(ay, by) < h + 1))
        if len(columns):
            span = slice(columns[0], columns[-1] + 1)
            out[i : i + some, span] = own.at(*place(dx[span], part))
    return out


def deskew(image: np.ndarray, quad: list[list[int]], settings: Settings = SETTINGS) -> np.ndarray:
    """The quad (from top left, clockwise) as an upright rectangle, turned if it is much higher than wide."""
    q = np.array(quad, np.float64)
    side = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    w, h = max(1, int(max(side(0, 1), side(3, 2)))), max(1, int(max(side(0, 3), side(1, 2))))
    corners = np.array([[0, 0], [w, 0], [w, h], [0, h]], np.float64)
    rows = []
    for (u, v), (x, y) in zip(corners, q, strict=True):
        rows += [[u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y]]
    m = np.append(np.linalg.lstsq(np.array(rows), q.ravel(), rcond=None)[0], 1).reshape(3, 3)
    v, u = np.mgrid[:h, :w]
    x, y, z = (m[i, 0] * u + m[i, 1] * v + m[i, 2] for i in range(3))
    out = Sampler(image, None).at(x / z, y / z)
    return np.ascontiguousarray(np.rot90(out) if h / w >= settings.upright else out)


def highlight(image: np.ndarray, targets: list[np.ndarray], unknown: bool = False, settings: Settings = SETTINGS) -> np.ndarray:
    """The image dimmed but for the targets, which get an outline; without targets all of it is dim."""
    shape = image.shape[:2]
    out = (image * settings.dim).astype(np.uint8)
    width = max(2, round(max(shape) * settings.outline))
    for c in targets:
        inside = fill(shape, c) > 0
        out[inside] = image[inside]
    for c in targets:
        out[outline(shape, c, width) > 0] = settings.unknown_bgr if unknown else settings.known_bgr
    return out


def png(image: np.ndarray) -> bytes:
    """A BGR image as PNG bytes."""
    h, w = image.shape[:2]
    if not h or not w:
        raise ValueError("an image without pixels")
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image[..., ::-1].reshape(h, -1)], 1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, PNG_LEVEL)) + chunk(b"IEND", b"")
