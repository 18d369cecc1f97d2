"""Polygons on pixel tables: what they cover as runs of pixels, pictures lit where they are, and crops.

A shape is a row with ``contour``, an array of points [x, y] that is closed from its last to its
first. Runs are rows (keys, y, x0, x1) of pixels x0 to x1; they are made from sides, never from
the pixels of a picture, and meet pixels by their row. A null or empty contour covers nothing, nor
does a side to a point without coordinates; what lies beyond the picture finds no pixel there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions import geometry
from .pixels import resampled


def sides(shapes: DataFrame, *keys: str) -> DataFrame:
    """(keys, ax, ay, bx, by): each side of each shape, from its first point to its second."""
    points = F.col("contour")
    pairs = F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % F.size(points)).alias("b")))
    ends = [F.get(f"s.{p}", F.lit(k)).cast("long").alias(f"{p}{c}") for p in "ab" for k, c in enumerate("xy")]
    return shapes.select(*keys, F.explode(pairs).alias("s")).select(*keys, *ends).where("ax + ay + bx + by IS NOT NULL")


def within(shapes: DataFrame, *keys: str) -> DataFrame:
    """Runs between a shape's crossings of a row's line, by turns inside and outside: a run begins at or right of the one and ends left of the next."""
    tall = sides(shapes, *keys).where("ay != by")
    y = F.explode(F.sequence(F.least("ay", "by"), F.greatest("ay", "by") - 1))
    met = tall.select("*", y.alias("y"))
    crossing = F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    along = W.partitionBy(*keys, "y").orderBy("x0")
    turns = met.select(*keys, "y", F.ceil(crossing).alias("x0")).select("*", (F.lead("x0").over(along) - 1).alias("x1"), F.row_number().over(along).alias("turn"))
    return turns.where("turn % 2 = 1 AND x1 >= x0").drop("turn")


def bordering(shapes: DataFrame, thickness: Column, *keys: str) -> DataFrame:
    """Runs along a shape's sides, of the given width, which is of whole pixels and may come from a column."""
    wide = sides(shapes.withColumn("_wide", thickness), *keys, "_wide")
    steps = wide.withColumn("n", F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay")), F.lit(1)))
    walked = steps.select("*", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("i"))

    def at(a: str, b: str) -> Column:
        """The nearest whole number, of two the larger: so a shifted shape has shifted runs."""
        return F.floor((2 * (F.col(a) * F.col("n") + F.col("i") * (F.col(b) - F.col(a))) + F.col("n")) / (2 * F.col("n")))

    before, after = F.floor((F.col("_wide") - 1) / 2), F.floor(F.col("_wide") / 2)
    spots = walked.select(*keys, at("ax", "bx").alias("x"), at("ay", "by").alias("y"), before.alias("before"), after.alias("after")).distinct()
    return spots.select(*keys, F.explode(F.sequence(F.col("y") - F.col("before"), F.col("y") + F.col("after"))).alias("y"), (F.col("x") - F.col("before")).alias("x0"), (F.col("x") + F.col("after")).alias("x1"))


def merged(runs: DataFrame, *keys: str) -> DataFrame:
    """Runs of the same pixels that neither overlap nor touch."""
    along = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    reached = F.max("x1").over(along.rowsBetween(W.unboundedPreceding, -1))
    begun = runs.select(*keys, "y", "x0", "x1", F.when(F.col("x0") <= reached + 1, 0).otherwise(1).alias("new"))
    numbered = begun.select(*keys, "y", "x0", "x1", F.sum("new").over(along).alias("run"))
    return numbered.groupBy(*keys, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def covered(shapes: DataFrame, *keys: str) -> DataFrame:
    """Runs of what each shape covers, its border included."""
    return merged(within(shapes, *keys).unionByName(bordering(shapes, F.lit(1), *keys)), *keys)


def _meets(runs: Column) -> Column:
    """Whether the pixel's x is in one of the runs."""
    return F.coalesce(F.exists(runs, lambda r: F.col("x").between(r["x0"], r["x1"])), F.lit(False))


def _same(left: DataFrame, right: DataFrame, how: str, *keys: str) -> DataFrame:
    """A join in which null keys are equal; the right side's keys are dropped."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_{k}" for k in keys])


def highlighted(pixels: DataFrame, targets: DataFrame, settings: Settings = SETTINGS, image: str = "image") -> DataFrame:
    """Pixels (image, y, x, b, g, r) dimmed but for the targets, which get a closed outline; pictures without targets are all dim.

    Targets are rows (image, piece_id, contour, thickness, unknown), ids being distinct within an
    image. The outline has the colour of unknown pieces or of known ones; where both meet, that of
    known ones. Further columns of pixels stay.
    """
    one = targets.select(image, "piece_id", "contour", "thickness", F.coalesce("unknown", F.lit(False)).alias("unknown"))
    inside = merged(covered(one, image, "piece_id"), image).select(image, "y", "x0", "x1", F.lit(0).alias("kind"))
    band = merged(bordering(one, F.col("thickness"), image, "unknown"), image, "unknown").select(image, "y", "x0", "x1", F.when(F.col("unknown"), 2).otherwise(1).alias("kind"))
    runs = F.struct("x0", "x1")
    lists = [F.collect_list(F.when(F.col("kind") == k, runs)).alias(name) for k, name in enumerate(("_in", "_known", "_unknown"))]
    lit = inside.unionByName(band).groupBy(image, "y").agg(*lists)
    met = _same(pixels, lit, "left", image, "y")

    def level(name: str, known: int, unknown: int) -> Column:
        dim = (F.col(name) * F.lit(settings.dim)).cast("int")
        return F.when(_meets(F.col("_known")), known).when(_meets(F.col("_unknown")), unknown).when(_meets(F.col("_in")), F.col(name)).otherwise(dim).cast("int")

    colours = zip("bgr", settings.known_bgr, settings.unknown_bgr, strict=True)
    return met.withColumns({name: level(name, a, b) for name, a, b in colours}).select(*pixels.columns)


def crops(pixels: DataFrame, pieces: DataFrame, settings: Settings = SETTINGS, edge: int | None = None, channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """(image, piece_id, y, x and channels): each piece's box with its margin, other pieces painted over (never the piece itself), its longer side scaled to the edge.

    Pixels are rows (image, y, x, channels), pieces rows (image, piece_id, contour, height, width),
    the latter two being the image's size. Neither pieces nor pixels are paired: a row of pixels
    meets the windows on it, and each window the runs of its row.
    """
    box = geometry.box(F.col("contour"))
    placed = pieces.where(F.size("contour") > 0).select("image", "piece_id", "height", "width", box.alias("b"))
    window = geometry.crop_window(*[F.col(f"b.{c}") for c in "xywh"], F.col("width"), F.col("height"), settings, edge)
    windows = placed.select("image", "piece_id", window.alias("c")).where("c.x1 > c.x0 AND c.y1 > c.y0")
    runs = F.struct("piece_id", "x0", "x1")
    taken = covered(pieces, "image", "piece_id").groupBy("image", "y").agg(F.collect_list(runs).alias("runs"))
    lines = windows.select("*", F.explode(F.sequence(F.col("c.y0"), F.col("c.y1") - 1)).alias("y"))
    met = _same(lines, taken, "left", "image", "y")
    reach = lambda r: (r["x1"] >= F.col("c.x0")) & (r["x0"] < F.col("c.x1"))
    own = F.filter("runs", lambda r: r["piece_id"].eqNullSafe(F.col("piece_id")) & reach(r))
    other = F.filter("runs", lambda r: ~r["piece_id"].eqNullSafe(F.col("piece_id")) & reach(r))
    asked = met.select("image", "piece_id", "c", "y", own.alias("own"), other.alias("other"))
    seen = _same(asked, pixels.select("image", "y", "x", *channels), "inner", "image", "y").where("x >= c.x0 AND x < c.x1")
    # Told before x is named anew: within a function of a list, x would be the new one.
    told = seen.select("image", "piece_id", "c", "y", "x", *channels, (_meets(F.col("other")) & ~_meets(F.col("own"))).alias("painted"))
    values = [F.when(F.col("painted"), settings.fill).otherwise(F.col(c)).alias(c) for c in channels]
    sizes = [(F.col("c.y1") - F.col("c.y0")).alias("height"), (F.col("c.x1") - F.col("c.x0")).alias("width"), F.col("c.out_h").alias("to_height"), F.col("c.out_w").alias("to_width")]
    cut = told.select("image", "piece_id", (F.col("y") - F.col("c.y0")).alias("y"), (F.col("x") - F.col("c.x0")).alias("x"), *sizes, *values)
    return resampled(cut, ("image", "piece_id"), channels)
