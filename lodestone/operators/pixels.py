"""Pixel operators on tables with a row for each pixel: (image keys, y, x, v). For small grids; kernels.py has whole images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The 5 x 5 elliptic element, and the binomial weights of the 5 x 5 blur.
ELLIPSE = ((0, 0, 1, 0, 0), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (1, 1, 1, 1, 1), (0, 0, 1, 0, 0))
BINOMIAL = (1, 4, 6, 4, 1)
#: Side of the squares in which neighbourhoods are looked at.
SIDE = 128
#: Pixels of equal squares that are looked at together.
HELD = 1 << 20


def gray(b: Column, g: Column, r: Column) -> Column:
    """Luminance in fixed point."""
    return F.shiftright(b * 1868 + g * 9617 + r * 4899 + 8192, 14)


def histogram(pixels: DataFrame, image: str = "image") -> DataFrame:
    """(image, v, n)."""
    return pixels.groupBy(image, "v").agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame, image: str = "image") -> DataFrame:
    """(image, threshold): the level that parts an image's pixels with the largest variance between, the least of equals."""
    up = W.partitionBy(image).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    all_ = W.partitionBy(image)
    runs = histogram(pixels, image).select(image, "v", F.sum("n").over(up).alias("w"), F.sum(F.col("v") * F.col("n")).over(up).alias("m"), F.sum("n").over(all_).alias("w_all"), F.sum(F.col("v") * F.col("n")).over(all_).alias("m_all"))
    # Times constants of the image, (m_all w - w_all m)^2 / (w (w_all - w)), whose numerator is an exact integer.
    gap = (F.col("m_all") * F.col("w") - F.col("w_all") * F.col("m")).cast("double")
    score = F.when(F.col("w") < F.col("w_all"), gap * gap / (F.col("w") * (F.col("w_all") - F.col("w"))).cast("double")).otherwise(F.lit(0.0))
    return runs.groupBy(image).agg(F.max_by("v", F.struct(score, -F.col("v"))).alias("threshold"))


def masked(pixels: DataFrame, thresholds: DataFrame, image: str = "image") -> DataFrame:
    """Pixels with v 255 above their image's threshold and 0 elsewhere. Thresholds are a row an image."""
    return pixels.join(thresholds, image).select(image, "y", "x", F.when(F.col("v") > F.col("threshold"), 255).otherwise(0).alias("v"))


def foreground(mask: DataFrame, image: str = "image") -> DataFrame:
    """(image, n, lit): how many pixels, and how many are not 0."""
    return mask.groupBy(image).agg(F.count("*").alias("n"), F.count_if(F.col("v") > 0).alias("lit"))


Look = Callable[[np.ndarray, np.ndarray, np.ndarray, int, int], tuple[np.ndarray, np.ndarray]]


def _looked(batch: pa.RecordBatch, look: Look, fractions: bool) -> pa.RecordBatch:
    """The squares' own pixels with what look(values, known, there, y, x) makes of them; ``batch`` has whole squares in order.

    Squares of one place and extent are stacked and looked at together. Repeated pixels are one.
    """
    starts, y, x, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "y", "x", "own"))
    level = batch.column("v")
    sure = level.is_valid().to_numpy(zero_copy_only=False)
    values = level.fill_null(0).to_numpy(zero_copy_only=False)
    begin = np.flatnonzero(starts)
    square = np.cumsum(starts) - 1
    box = [f.reduceat(c, begin) for c in (y, x) for f in (np.minimum, np.maximum)]
    kinds, kind = np.unique(np.stack(box, 1), axis=0, return_inverse=True)
    kind = kind.reshape(-1)
    made, known = np.zeros(len(y), np.float64 if fractions else np.int64), np.zeros(len(y), bool)
    for k, (y0, y1, x0, x1) in enumerate(kinds.tolist()):
        h, w = y1 - y0 + 1, x1 - x0 + 1
        squares = np.flatnonzero(kind == k)
        some = max(1, HELD // (h * w))
        place = np.full(len(begin), -1)
        for part in (squares[i : i + some] for i in range(0, len(squares), some)):
            place[part] = np.arange(len(part))
            at = np.flatnonzero(place[square] >= 0)
            spots = place[square[at]], y[at] - y0, x[at] - x0
            stack, valued, there = np.zeros((len(part), h, w), made.dtype), *np.zeros((2, len(part), h, w), bool)
            stack[spots], valued[spots], there[spots] = values[at], sure[at], True
            got, found = look(stack, valued, there, y0, x0)
            made[at], known[at] = got[spots], found[spots]
            place[part] = -1
    again = np.concatenate([[False], (y[1:] == y[:-1]) & (x[1:] == x[:-1])]) & ~starts
    kept = own & ~again
    columns = [batch.column(c).filter(pa.array(kept)) for c in (0, 1, 2)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(made[kept], mask=~known[kept])], [*batch.schema.names[:3], "v"])


def _in_squares(pixels: DataFrame, image: str, reach: int, look: Look, last: Column) -> DataFrame:
    """(image, y, x, v) with v from look(), which sees every pixel within ``reach`` of those that it judges.

    Pixels go to the squares of SIDE that need them, so that no image meets in one group; squares
    begin half a side before the origin, so that small images are one. A table dealt by image is
    not dealt again. Of repeated pixels the last by ``last`` counts.
    """
    fractions = pixels.schema["v"].dataType.typeName() in ("float", "double", "decimal")
    square = lambda c, d: F.floor((F.col(c) + (SIDE // 2 + d)) / SIDE).cast("long")
    needed = lambda c: F.explode(F.sequence(square(c, -reach), square(c, reach)))
    cast = pixels.select(F.col(image), F.col("y"), F.col("x"), F.col("v").cast("double" if fractions else "long").alias("v"))
    cast = cast.select("*", needed("y").alias("ty")).select("*", needed("x").alias("tx"))
    own = (square("y", 0) == F.col("ty")) & (square("x", 0) == F.col("tx"))
    first = F.row_number().over(W.partitionBy(image, "ty", "tx").orderBy("y", "x", last)) == 1
    told = cast.select(image, "y", "x", "v", own.alias("own"), first.alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = np.flatnonzero(batch.column("first").to_numpy(zero_copy_only=False))
            if len(starts):
                # Whole squares end where the last one of this batch begins.
                whole = [b for b in (*held, batch.slice(0, starts[-1])) if len(b)]
                held = [batch.slice(starts[-1])]
                if whole:
                    yield _looked(pa.concat_batches(whole), look, fractions)
            else:
                held.append(batch)
        if held:
            yield _looked(pa.concat_batches(held), look, fractions)

    kind = lambda c: pixels.schema[c].dataType.simpleString()
    found = told.mapInArrow(run, f"`{image}` {kind(image)}, y {kind('y')}, x {kind('x')}, v {'double' if fractions else 'long'}")
    return found.withColumn("v", F.col("v").cast(pixels.schema["v"].dataType))


def _under(stack: np.ndarray, known: np.ndarray, how: np.ufunc) -> tuple[np.ndarray, np.ndarray]:
    """how() of the known values under the element, and where there is one."""
    limits = np.iinfo(stack.dtype) if stack.dtype.kind == "i" else np.finfo(stack.dtype)
    edge = limits.max if how is np.minimum else limits.min
    h, w = stack.shape[1:]
    around = ((0, 0), (2, 2), (2, 2))
    wide = np.pad(np.where(known, stack, edge), around, constant_values=edge)
    there = np.pad(known, around)
    spots = [(j, i) for j, row in enumerate(ELLIPSE) for i, on in enumerate(row) if on]
    made, any_ = np.full(stack.shape, edge, stack.dtype), np.zeros(stack.shape, bool)
    for j, i in spots:
        how(made, wide[:, j : j + h, i : i + w], out=made)
        any_ |= there[:, j : j + h, i : i + w]
    return np.where(any_, made, 0), any_


def erode(pixels: DataFrame, image: str = "image") -> DataFrame:
    """Each pixel takes the least of the values under the element, those outside the image not counting."""
    return _in_squares(pixels, image, 2, lambda stack, known, there, y, x: _under(stack, known, np.minimum), F.desc_nulls_first("v"))


def dilate(pixels: DataFrame, image: str = "image") -> DataFrame:
    return _in_squares(pixels, image, 2, lambda stack, known, there, y, x: _under(stack, known, np.maximum), F.asc_nulls_first("v"))


def open_close(mask: DataFrame, image: str = "image") -> DataFrame:
    """Opening, which drops specks, and then closing, which fills pinholes: four passes in one look at what lies within their reach."""

    def look(stack: np.ndarray, known: np.ndarray, there: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray]:
        for how in (np.minimum, np.maximum, np.maximum, np.minimum):
            stack, found = _under(stack, known, how)
            known = found & there
        return stack, known

    return _in_squares(mask, image, 8, look, F.desc_nulls_first("v"))


def blur(pixels: DataFrame, height: int, width: int, image: str = "image") -> DataFrame:
    """5 x 5 binomial blur, rounded, with borders mirrored about their own pixels; sizes of 3 or more."""

    def along(values: np.ndarray, first: int, n: int) -> np.ndarray:
        """Weighted sums along the middle axis, whose places begin at ``first`` of ``n``."""
        total = np.zeros_like(values)
        for d, weight in enumerate(BINOMIAL, -2):
            p = np.arange(first, first + values.shape[1]) + d
            p = np.where(p < 0, -p, np.where(p >= n, 2 * (n - 1) - p, p)) - first
            in_ = (p >= 0) & (p < values.shape[1])
            total[:, in_] += weight * values[:, p[in_]]
        return total

    def look(stack: np.ndarray, known: np.ndarray, there: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray]:
        both = [along(along(a, y, height).swapaxes(1, 2), x, width).swapaxes(1, 2) for a in (stack, known.astype(stack.dtype))]
        return (both[0].astype(np.int64) + 128) >> 8, both[1] > 0

    return _in_squares(pixels, image, 2, look, F.asc_nulls_first("v")).withColumn("v", F.col("v").cast("int"))


def dimmed(pixels: DataFrame, inside: Column, dim: float) -> DataFrame:
    """Pixels outside the target darkened, cut off to whole levels."""
    return pixels.withColumn("v", F.when(inside, F.col("v")).otherwise((F.col("v") * F.lit(dim)).cast("int")))


#: Weights of cubic interpolation are whole parts of this.
UNIT = 1 << 20
#: Fixed value: the parameter of the cubic.
CUBIC = -0.75


def _cubic(t: Column) -> Column:
    """The weight at a distance of 0 to 2, in parts of UNIT."""
    near = ((CUBIC + 2) * t - (CUBIC + 3)) * t * t + 1
    far = ((CUBIC * t - 5 * CUBIC) * t + 8 * CUBIC) * t - 4 * CUBIC
    return F.rint(F.when(t <= 1, near).otherwise(far) * UNIT).cast("long")


def _along(pixels: DataFrame, keys: tuple[str, ...], at: str, old: Column, new: Column, channels: tuple[str, ...]) -> DataFrame:
    """One axis resampled: what each pixel gives to those that it reaches, added up in whole numbers. ``shrink`` says how."""
    p = F.col(at)
    first = lambda m: F.ceil(((2 * m + 1) * new - old) / (2 * old))  # noqa: E731  (the first whose base is m or more)
    low = F.when(F.col("shrink"), F.floor(p * new / old)).when(p == 0, 0).otherwise(F.greatest(F.lit(0), first(p - 2)))
    high = F.when(F.col("shrink"), F.floor(((p + 1) * new - 1) / old)).when(p == old - 1, new - 1).otherwise(F.least(new - 1, first(p + 2) - 1))
    reached = pixels.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).where("_low <= _high").withColumn("_to", F.explode(F.sequence("_low", "_high")))
    to = F.col("_to")
    shared = F.least((to + 1) * old, (p + 1) * new) - F.greatest(to * old, p * new)
    based = reached.withColumn("_base", F.floor(((2 * to + 1) * old - new) / (2 * new)))
    past = ((2 * to + 1) * old - new - 2 * new * F.col("_base")) / (2 * new)
    parts = based.withColumns({"_w0": _cubic(past + 1), "_w2": _cubic(1 - past), "_w3": _cubic(2 - past)})
    taps = {-1: F.col("_w0"), 0: UNIT - F.col("_w0") - F.col("_w2") - F.col("_w3"), 1: F.col("_w2"), 2: F.col("_w3")}
    cubic = sum((F.when(F.least(F.greatest(F.col("_base") + k, F.lit(0)), old - 1) == p, w).otherwise(0) for k, w in taps.items()), F.lit(0))
    weighed = parts.withColumn("_weight", F.when(F.col("shrink"), shared).otherwise(cubic))
    sums = [F.sum(F.col(c) * F.col("_weight")).alias(c) for c in channels]
    return weighed.groupBy(*keys, to.alias(at)).agg(*sums)


def resampled(pixels: DataFrame, keys: tuple[str, ...] = ("image",), channels: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, y, x, channels) in another size: by area averages when a picture shrinks, by cubic interpolation when it grows.

    Pixels are rows (keys, y, x, height, width, to_height, to_width, channels), the sizes being
    those of the picture and of what is made of it; a pixel without a row counts as 0, and rows
    with a null or no size are left out. Each axis is one aggregation, combined before the shuffle.
    Sums are whole numbers, so results depend on no order; halves go to the even level.
    """
    sizes = ("height", "width", "to_height", "to_width")
    longs = {c: F.col(c).cast("long") for c in ("y", "x", *sizes)}
    sized = pixels.select(*keys, "y", "x", *sizes, *channels).withColumns(longs).where("height > 0 AND width > 0 AND to_height > 0 AND to_width > 0")
    told = sized.withColumn("shrink", F.col("to_height") * F.col("to_width") < F.col("height") * F.col("width"))
    kept = (*keys, *sizes, "shrink")
    across = _along(told, (*kept, "y"), "x", F.col("width"), F.col("to_width"), channels)
    down = _along(across, (*kept, "x"), "y", F.col("height"), F.col("to_height"), channels)
    whole = F.when(F.col("shrink"), F.col("height") * F.col("width")).otherwise(F.lit(UNIT * UNIT))
    level = lambda c: F.least(F.lit(255), F.greatest(F.lit(0), F.rint(F.col(c) / whole).cast("int"))).alias(c)
    return down.select(*keys, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[level(c) for c in channels])
