"""Geometry of pieces: areas, boxes, crop windows, quads, zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from .columns import let


def area(points: Column) -> Column:
    """The area that a closed line of points [x, y] encloses."""
    n = F.size(points)

    def cross(p: Column, i: Column) -> Column:
        q = F.get(points, (i + 1) % n)
        return F.get(p, 0).cast("double") * F.get(q, 1) - F.get(q, 0).cast("double") * F.get(p, 1)

    return F.abs(F.aggregate(F.transform(points, cross), F.lit(0.0), lambda a, b: a + b)) / 2


def box(points: Column) -> Column:
    """struct(x, y, w, h) of the pixels that the points span, both ends included."""
    xs, ys = F.transform(points, lambda p: F.get(p, 0)), F.transform(points, lambda p: F.get(p, 1))
    x, y = F.array_min(xs), F.array_min(ys)
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(xs) - x + 1).alias("w"), (F.array_max(ys) - y + 1).alias("h"))


def crop_window(x, y, w, h, width, height, settings: Settings = SETTINGS, edge: int | None = None) -> Column:
    """struct(x0, y0, x1, y1, out_w, out_h): a box with its margin, within the image, and its size scaled to an edge."""
    pad = settings.pad
    x0, y0 = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    x1, y1 = F.least(width, x + w + pad), F.least(height, y + h + pad)
    scale = F.lit(float(edge or settings.crop_edge)) / F.greatest(x1 - x0, y1 - y0)
    size = lambda v: F.greatest(F.lit(1), F.rint(v * scale).cast("int"))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), size(x1 - x0).alias("out_w"), size(y1 - y0).alias("out_h"))


def overlaps(x, y, w, h, x0, y0, x1, y1) -> Column:
    """Whether a box shares more than an edge with a window."""
    return (x < x1) & (y < y1) & (x + w > x0) & (y + h > y0)


def expected_pieces(piece_area: Column, unit: Column) -> Column:
    """How many pieces of a unit area a blob is, rounded half to even, one at least."""
    return F.when(unit > 0, F.greatest(F.lit(1), F.rint(piece_area / unit).cast("int"))).otherwise(F.lit(1))


def outline_thickness(width: Column, height: Column, settings: Settings = SETTINGS) -> Column:
    """Line width for an image's size, two at least."""
    return F.greatest(F.lit(2), F.rint(F.greatest(width, height) * settings.outline).cast("int"))


def rotated_canvas(width: Column, height: Column, degrees: Column) -> Column:
    """struct(w, h) of the canvas that holds an image turned by an angle."""
    s, c = F.abs(F.sin(F.radians(degrees))), F.abs(F.cos(F.radians(degrees)))
    return F.struct((height * s + width * c).cast("int").alias("w"), (height * c + width * s).cast("int").alias("h"))


def quad_size(quad: Column, settings: Settings = SETTINGS) -> Column:
    """struct(w, h, turn): whole sizes of a quad's longer opposite sides, and whether its text stands upright."""
    side = lambda i, j: F.sqrt(F.pow(F.get(F.get(quad, i), 0) - F.get(F.get(quad, j), 0), 2) + F.pow(F.get(F.get(quad, i), 1) - F.get(F.get(quad, j), 1), 2))
    w = F.greatest(F.lit(1), F.greatest(side(0, 1), side(3, 2)).cast("int"))
    h = F.greatest(F.lit(1), F.greatest(side(0, 3), side(1, 2)).cast("int"))
    return F.struct(w.alias("w"), h.alias("h"), (h / F.greatest(F.lit(1), w) >= settings.upright).alias("turn"))


def zone(x, y, w, h, width, height) -> Column:
    """The ninth of the image that a box's centre is in, as its name for display."""
    third = lambda p, whole: F.least(F.lit(2), F.floor(p / whole * 3)).cast("int")
    col, row = third(x + w / 2, width), third(y + h / 2, height)
    name = F.concat(F.element_at(F.lit(["左", "中", "右"]), col + 1), F.element_at(F.lit(["上", "中", "下"]), row + 1), F.lit("区"))
    return F.when((col == 1) & (row == 1), F.lit("正中")).otherwise(name)


def homography(quad: Column, w: Column, h: Column) -> Column:
    """struct(a, b, c, d, e, f, g, h) of the perspective map from a w x h rectangle to a quad, whose points follow the rectangle's corners from the upper left on, clockwise.

    The eight equations in closed form. Null where they have no solution: for a null or short quad,
    one whose second, third and fourth points lie on a line, or a side of no length.
    """
    xs, ys = ([F.get(F.get(quad, i), k).cast("double") for i in range(4)] for k in (0, 1))

    def across(v: list[Column]) -> tuple[Column, Column, Column]:
        return v[1] - v[2], v[3] - v[2], v[0] - v[1] + v[2] - v[3]

    (x1, x2, sx), (y1, y2, sy) = across(xs), across(ys)
    area = F.nullif(x1 * y2 - x2 * y1, F.lit(0.0))
    solved = F.struct(((sx * y2 - x2 * sy) / area).alias("g"), ((x1 * sy - sx * y1) / area).alias("h"), F.nullif(w.cast("double"), F.lit(0.0)).alias("w"), F.nullif(h.cast("double"), F.lit(0.0)).alias("t"))

    def scaled(s: Column) -> Column:
        g, k = s["g"], s["h"]
        made = {"a": (xs[1] - xs[0] + g * xs[1]) / s["w"], "b": (xs[3] - xs[0] + k * xs[3]) / s["t"], "c": xs[0], "d": (ys[1] - ys[0] + g * ys[1]) / s["w"], "e": (ys[3] - ys[0] + k * ys[3]) / s["t"], "f": ys[0], "g": g / s["w"], "h": k / s["t"]}
        return F.when((g + k + s["w"] + s["t"]).isNotNull(), F.struct(*[v.alias(n) for n, v in made.items()]))

    return let(solved, scaled)


def mapped(by: Column, x: Column, y: Column) -> Column:
    """struct(x, y): where a homography takes a point; null on its horizon."""
    below = F.nullif(by["g"] * x + by["h"] * y + 1, F.lit(0.0))
    return F.struct(((by["a"] * x + by["b"] * y + by["c"]) / below).alias("x"), ((by["d"] * x + by["e"] * y + by["f"]) / below).alias("y"))


def _view(scale: Column, tx: Column, ty: Column) -> Column:
    return F.struct(scale.cast("double").alias("scale"), tx.cast("double").alias("tx"), ty.cast("double").alias("ty"))


def fitted(view_w, view_h, width, height) -> Column:
    """The view struct(scale, tx, ty), by which a point p of an image is shown at scale * p + (tx, ty): all of the image, in the middle. Null for an image without size."""
    within = F.least(view_w / F.nullif(width, F.lit(0)), view_h / F.nullif(height, F.lit(0)))
    whole = F.nullif(width, F.lit(0)) * F.nullif(height, F.lit(0))
    return F.when(whole.isNotNull(), let(within, lambda s: _view(s, (view_w - width * s) / 2, (view_h - height * s) / 2)))


def zoomed(view: Column, x, y, factor) -> Column:
    """A view enlarged by a factor about a point of the screen, which keeps showing the same place."""
    return F.when(view.isNotNull(), _view(view["scale"] * factor, x - (x - view["tx"]) * factor, y - (y - view["ty"]) * factor))


def centred(view: Column, x, y, w, h, view_w, view_h, largest: float = 6.0) -> Column:
    """A view moved so that a box's middle is in the screen's, and enlarged where the box takes less than a fifth of the screen's height; scales beyond the largest shrink to it."""
    scale = F.least(F.lit(largest), F.greatest(view["scale"], view_h / (F.nullif(h, F.lit(0)) * 5)))
    return F.when(view.isNotNull(), let(scale, lambda s: _view(s, view_w / 2 - (x + w / 2) * s, view_h / 2 - (y + h / 2) * s)))


def shown(view: Column, x, y) -> Column:
    """struct(x, y): where a view shows a point of the image."""
    return F.struct((view["scale"] * x + view["tx"]).alias("x"), (view["scale"] * y + view["ty"]).alias("y"))
