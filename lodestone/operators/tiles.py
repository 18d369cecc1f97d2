"""Images of any size as tables of square tiles: components, distances to the background, peaks.

A tile is a row (image, ty, tx, data): ``data`` holds SIDE x SIDE whole numbers of 64 bits, row by
row, of the pixels from (ty * side, tx * side) on. Beyond the image, and wherever a pixel has no
row, stands ABSENT. A few tiles at a time are in a task's memory; what tiles know of one another goes
through joins on their borders, so results do not depend on how an image is cut. ``image`` may be
of any type that can be a key, null included: null images are one image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .kernels import PEAK_SHARES, components

ABSENT = -1
#: Ten-thousandths of the steps of the chamfer distance to side, corner and knight's-move neighbours.
STEPS = {(0, 1): 10_000, (1, 1): 14_000, (1, 2): 21_969}
#: The distance of what no background is near to.
FAR = 1 << 40
#: Neighbours of a pixel that come after it in reading order.
LATER = ((0, 1), (1, -1), (1, 0), (1, 1))
#: How far a step of the distance reaches.
REACH = 2
SIDE = 256
#: Pixels of tiles made that a task holds before it hands them on.
HELD = 1 << 22
#: Pixels of tiles that are computed at once.
AT_ONCE = 1 << 15


def _apart(rows: DataFrame) -> DataFrame:
    """One side of a join, which is to be dealt by its key as is the other.

    What files of tiles and of numbers in a row hold is many times their size, by which Spark
    judges what may be broadcast; broadcast tables are whole in the driver.
    """
    return rows.hint("merge")


def spot(y: Column, x: Column) -> Column:
    """A number for a pixel, from 1 on, ordered as one reads."""
    return F.shiftleft(y.cast("long"), 32) + x + 1


def spot_y(number: Column) -> Column:
    return F.shiftright(number - 1, 32).cast("int")


def spot_x(number: Column) -> Column:
    return (number - 1).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _per_tile(tiles: DataFrame, of: Callable[[tuple, np.ndarray], list[tuple]], schema: str, side: int, *more: str) -> DataFrame:
    """Rows of ``schema`` (which begins with the image's column) that of((ty, tx, further columns), pixels) gives for each tile."""
    kind = tiles.schema["image"].dataType.simpleString()
    whole = f"image {kind}, {schema}"
    arrow = tiles.sparkSession.createDataFrame([], whole).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots: list[int] = []
            rows: list[tuple] = []

            def told() -> pa.RecordBatch:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(spots)).cast(arrow.field(0).type), *columns], schema=arrow)  # noqa: B023

            for i, (ty, tx, data, *rest) in enumerate(zip(*batch.columns[1:], strict=True)):
                made = of((ty.as_py(), tx.as_py(), *[r.as_py() for r in rest]), np.frombuffer(data.as_buffer(), np.int64).reshape(side, side))
                rows += made
                spots += [i] * len(made)
                if len(rows) * side * side > HELD:
                    yield told()
                    spots, rows = [], []
            if rows:
                yield told()

    return tiles.select("image", "ty", "tx", "data", *more).mapInArrow(run, whole)


def cut(pixels: DataFrame, value: Column, image: str = "image", side: int = SIDE) -> DataFrame:
    """Tiles of a pixel table (image, y, x, ...) with ``value``, a whole number that is not negative; null counts as 0.

    Coordinates are not negative. Of several rows of a pixel the largest value counts. A tile's
    rows meet in one group of at most side x side pixels.
    """
    at = F.col("y") % side * side + F.col("x") % side
    one = pixels.groupBy(F.col(image).alias("image"), F.col("y").alias("y"), F.col("x").alias("x")).agg(F.max(F.coalesce(value, F.lit(0)).cast("long")).alias("v"))
    groups = one.groupBy("image", F.floor(F.col("y") / side).cast("int").alias("ty"), F.floor(F.col("x") / side).cast("int").alias("tx")).agg(F.collect_list(F.struct(at.cast("int").alias("at"), "v")).alias("cells"))
    kind = pixels.schema[image].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, data = batch.column(3), []
            for i in range(len(batch)):
                tile = np.full(side * side, ABSENT, np.int64)
                own = cells[i].values
                tile[own.field("at").to_numpy(zero_copy_only=False)] = own.field("v").to_numpy(zero_copy_only=False)
                data.append(tile.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], ["image", "ty", "tx", "data"])

    return groups.mapInArrow(run, f"image {kind}, ty int, tx int, data binary")


def pixels_of(tiles: DataFrame, name: str = "v", side: int = SIDE) -> DataFrame:
    """(image, y, x, value) of the pixels that there are."""

    def of(at: tuple, tile: np.ndarray) -> list[tuple]:
        y, x = np.nonzero(tile != ABSENT)
        return list(zip((y + at[0] * side).tolist(), (x + at[1] * side).tolist(), tile[y, x].tolist(), strict=True))

    return _per_tile(tiles, of, f"y int, x int, `{name}` long", side)


def union(edges: DataFrame) -> DataFrame:
    """(node, root) for undirected edges (a, b): the least node that is reached; nodes may be of any ordered type.

    Each round lets every node point to the least of itself and its neighbours, follows pointers
    to their ends by doubling, and joins what points to one end; edges within an end vanish. Two
    neighbours never both stay, so rounds grow with the logarithm of the nodes. Edges with a null
    are left out.
    """
    ends = edges.where("a IS NOT NULL AND b IS NOT NULL")
    left = stored(ends.select("a", "b").union(ends.select("b", "a")).where("a != b").distinct(), "edges")
    total: DataFrame | None = None
    while True:
        done = left.isEmpty()
        if done and total is not None:
            return total
        to = stored(left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("to")), "pointers")
        moved = not done
        while moved:
            ahead = to.select(F.col("node").alias("at"), F.col("to").alias("next"))
            to = stored(to.join(_apart(ahead), F.col("to") == F.col("at")).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")), "pointers")
            moved = not to.where("moved").isEmpty()
        if total is None:
            total = to.select("node", F.col("to").alias("root"))
        else:
            ahead = to.select(F.col("node").alias("at"), F.col("to").alias("next"))
            total = stored(total.join(_apart(ahead), F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        first, second = (to.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in "ab")
        left = stored(left.join(_apart(first), "a").join(_apart(second), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a != b").distinct(), "edges")


def _local(tiles: DataFrame, side: int) -> DataFrame:
    """Of each tile with any: its components (a number, extent and tag each) and the pixels by which they touch other tiles.

    ``here`` are those that follow pixels of other tiles, ``there`` those of other tiles that follow its own, as spot().
    Some tiles are labelled at once, as one image in which a row of zeros parts them.
    """
    part = "array<struct<id: bigint, n: bigint, tag: bigint, y0: int, x0: int, y1: int, x1: int>>"
    rims = ("here", "here_ids", "there", "there_ids")
    whole = f"image {tiles.schema['image'].dataType.simpleString()}, ty int, tx int, parts {part}, " + ", ".join(f"{c} array<bigint>" for c in rims)
    arrow = tiles.sparkSession.createDataFrame([], whole).toArrow().schema

    def label(heads: pa.RecordBatch, some: np.ndarray) -> pa.RecordBatch:
        stacked = np.zeros((len(some), side + 1, side), bool)
        stacked[:, :side] = some > 0
        count, labels = components(stacked.reshape(-1, side))
        at, y, x = np.nonzero(labels.reshape(stacked.shape))
        own = labels.reshape(stacked.shape)[at, y, x] - 1
        oy, ox = (heads.column(c).to_numpy().astype(np.int64)[at] * side for c in (1, 2))
        first = np.full(count, len(own))
        np.minimum.at(first, own, np.arange(len(own)))
        spot = ((y + oy) << 32) + x + ox + 1
        low, high = ([np.full(count, big) for _ in range(2)] for big in (1 << 62, -1))
        for v, lo, hi in ((y + oy, low[0], high[0]), (x + ox, low[1], high[1])):
            np.minimum.at(lo, own, v)
            np.maximum.at(hi, own, v)
        # Only pixels in the first row and at the sides follow one of another tile.
        front = (y == 0) | (x == 0) | (x == side - 1)
        rim = front | (y == side - 1)
        asked = []
        for dy, dx in LATER:
            ny, nx = y[rim] + dy, x[rim] + dx
            out = (ny >= side) | (nx < 0) | (nx >= side)
            asked.append(np.stack([spot[first[own[rim][out]]], (spot[rim] + (dy << 32) + dx)[out], at[rim][out]]))
        there = np.concatenate(asked, axis=1)
        there = there[:, np.lexsort(there)]
        there = there[:, np.append(True, (there[:, 1:] != there[:, :-1]).any(0))[: there.shape[1]]]
        # All of it is in order of the tiles.
        lists = lambda of, values: pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(some) + 1)).astype(np.int32)), values)
        columns = (spot[first], np.bincount(own, minlength=count), some[at[first], y[first], x[first]], low[0], low[1], high[0], high[1])
        fields = list(arrow.field("parts").type.value_type)
        parts = lists(at[first], pa.StructArray.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(columns, fields, strict=True)], fields=fields))
        rest = [lists(at[front], pa.array(spot[front])), lists(at[front], pa.array(spot[first[own[front]]])), lists(there[2], pa.array(there[1])), lists(there[2], pa.array(there[0]))]
        made = [c.cast(f.type) for c, f in zip([*heads.columns, parts, *rest], arrow, strict=True)]
        return pa.RecordBatch.from_arrays(made, schema=arrow).take(pa.array(np.unique(at)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, AT_ONCE // side**2)
        for batch in batches:
            for k in range(0, len(batch), most):
                own = batch.slice(k, most)
                some = np.stack([np.frombuffer(d.as_buffer(), np.int64).reshape(side, side) for d in own.column(3)])
                yield label(pa.RecordBatch.from_arrays(own.columns[:3], ["image", "ty", "tx"]), some)

    return stored(tiles.select("image", "ty", "tx", "data").mapInArrow(run, whole), "parts")


def _roots(local: DataFrame) -> DataFrame:
    """(image, id, root) of the tiles' components that touch one of another tile."""
    rim = lambda c, name: local.select("image", F.explode(F.arrays_zip(c, f"{c}_ids")).alias("p")).select("image", F.col(f"p.{c}").alias("at"), F.col(f"p.{c}_ids").alias(name))
    asked, met = rim("there", "a").alias("t"), rim("here", "b").alias("h")
    same = F.col("t.image").eqNullSafe(F.col("h.image")) & (F.col("t.at") == F.col("h.at"))
    node = lambda c: F.struct(F.col("t.image").alias("image"), F.col(c).alias("id"))
    links = asked.join(_apart(met), same).select(node("a").alias("a"), node("b").alias("b"))
    return union(links).select(F.col("node.image").alias("image"), F.col("node.id").alias("id"), F.col("root.id").alias("root"))


def _with_roots(parts: DataFrame, roots: DataFrame) -> DataFrame:
    r = roots.select(F.col("image").alias("_image"), F.col("id").alias("_id"), "root")
    return parts.join(_apart(r), F.col("image").eqNullSafe(F.col("_image")) & (F.col("id") == F.col("_id")), "left").withColumn("root", F.coalesce("root", "id")).drop("_image", "_id")


def component_table(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """(image, component, tag, n, x, y, w, h) of the 8-connected pixels above 0, a row each.

    ``component`` is spot() of its first pixel in reading order, ``n`` the number of its pixels,
    ``tag`` the value at the first pixel of one of its parts, which is all its pixels' if those
    are alike. Tiles are labelled one by one; labels that meet at tiles' borders are united.
    """
    local = _local(tiles, side)
    parts = _with_roots(local.select("image", F.explode("parts").alias("p")).select("image", "p.*"), _roots(local))
    box = parts.groupBy("image", F.col("root").alias("component")).agg(F.min("tag").alias("tag"), F.sum("n").alias("n"), *[F.min(c).alias(c) for c in ("y0", "x0")], *[F.max(c).alias(c) for c in ("y1", "x1")])
    return box.select("image", "component", "tag", "n", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("w"), (F.col("y1") - F.col("y0") + 1).alias("h"))


def distances(tiles: DataFrame, side: int = SIDE) -> DataFrame:
    """Tiles of the chamfer distance, in ten-thousandths of a pixel, of pixels above 0 to the nearest one of 0.

    In each round every tile whose distances sank sends the REACH rows and columns along its
    borders to its neighbours, which relax until nothing changes; with none left to send all is
    done. Rounds grow with the tiles that a shortest way crosses, not with the image. Beyond the
    image all is far; where an image has no background, distances are 0.
    """
    return _per_tile(_settled(tiles, side), lambda at, tile: [(*at, np.where(tile >= FAR, 0, tile).tobytes())], "ty int, tx int, data binary", side)


def _settled(tiles: DataFrame, side: int) -> DataFrame:
    """distances(), stored, but FAR or more where no background is near: so pixels above 0 are those of ``tiles``."""
    kind = tiles.schema["image"].dataType.simpleString()
    moves = {(sy * dy, sx * dx): c for (a, b), c in STEPS.items() for dy, dx in ((a, b), (b, a)) for sy in (1, -1) for sx in (1, -1)}

    def begin(at: tuple, tile: np.ndarray) -> list[tuple]:
        return [(*at, np.where(tile > 0, FAR, tile).tobytes(), True)]

    def send(at: tuple, tile: np.ndarray) -> list[tuple]:
        ty, tx, sank = at
        rows = [(ty, tx, 0, 0, tile.tobytes())]
        for dy in (-1, 0, 1) if sank else ():
            for dx in (-1, 0, 1):
                if dy or dx:
                    # The neighbour at (dy, dx) sees this tile's pixels next to it, from its own side.
                    part = tile[_near(dy), _near(dx)]
                    rows.append((ty + dy, tx + dx, -dy, -dx, part.tobytes()))
        return rows

    def _near(d: int) -> slice:
        return slice(0, REACH) if d < 0 else slice(side - REACH, side) if d > 0 else slice(0, side)

    def _rim(d: int) -> slice:
        return slice(0, REACH) if d < 0 else slice(side + REACH, side + 2 * REACH) if d > 0 else slice(REACH, side + REACH)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, AT_ONCE // side**2)
        for batch in batches:
            ends, sent = batch.column(3).offsets.to_numpy(), batch.column(3).values
            dy, dx = (sent.field(c).to_numpy(zero_copy_only=False) for c in ("dy", "dx"))
            got, of = sent.field("data"), np.repeat(np.arange(len(batch)), np.diff(ends))
            # What neighbours send to tiles that are not there is left.
            whole = of[np.flatnonzero((dy[ends[0] : ends[-1]] == 0) & (dx[ends[0] : ends[-1]] == 0))]
            for k in range(0, len(whole), some):
                part = whole[k : k + some]
                wide = np.full((len(part), side + 2 * REACH, side + 2 * REACH), FAR)
                for i, at in enumerate(part):
                    for j in range(ends[at], ends[at + 1]):
                        to = wide[i, _rim(dy[j]), _rim(dx[j])]
                        to[:] = np.frombuffer(got[j].as_buffer(), np.int64).reshape(to.shape)
                middle = wide[:, REACH:-REACH, REACH:-REACH]
                before, there = middle.copy(), middle != ABSENT
                wide[wide == ABSENT] = FAR
                while True:
                    now = middle.copy()
                    for (a, b), cost in moves.items():
                        np.minimum(now, wide[:, REACH + a : REACH + a + side, REACH + b : REACH + b + side] + cost, out=now)
                    now = np.where(there, now, FAR)
                    if np.array_equal(now, middle):
                        break
                    middle[:] = now
                now = np.where(there, middle, ABSENT)
                columns = [*[c.take(pa.array(part)) for c in batch.columns[:3]], pa.array([t.tobytes() for t in now], pa.binary()), pa.array((now != before).any((1, 2)))]
                yield pa.RecordBatch.from_arrays(columns, ["image", "ty", "tx", "data", "sank"])

    state = stored(_per_tile(tiles, begin, "ty int, tx int, data binary, sank boolean", side), "distances")
    while not state.where("sank").isEmpty():
        sent = _per_tile(state, send, "ty int, tx int, dy int, dx int, data binary", side, "sank")
        # A tile gets nine rows at most.
        met = sent.groupBy("image", "ty", "tx").agg(F.collect_list(F.struct("dy", "dx", "data")).alias("sent"))
        state = stored(met.mapInArrow(settle, f"image {kind}, ty int, tx int, data binary, sank boolean"), "distances")
    return state


def peaks(tiles: DataFrame, side: int = SIDE, shares: tuple[float, ...] = PEAK_SHARES) -> DataFrame:
    """(image, component, peaks, deepest) of each component of pixels above 0.

    ``peaks`` is the most parts that it falls into when cut off at ``shares`` of its greatest
    distance to the background, one at least; ``deepest`` is that distance. All shares are
    labelled together, as images of their own, and counted in one aggregation.
    """
    local = _local(tiles, side)
    deep = _settled(tiles, side)

    def numbered(at: tuple, tile: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where a tile's components are, which one is at each place, and their ids."""
        count, labels = components(tile > 0)
        own = labels[on := labels > 0] - 1
        first = np.full(count, tile.size)
        np.minimum.at(first, own, np.flatnonzero(on))
        y, x = np.divmod(first, side)
        return on, own, ((y + at[0] * side) << 32) + x + at[1] * side + 1

    def greatest(at: tuple, tile: np.ndarray) -> list[tuple]:
        on, own, ids = numbered(at, tile)
        top = np.zeros(len(ids), np.int64)
        np.maximum.at(top, own, tile[on])
        return [(*at, i, t if t < FAR else 0) for i, t in zip(ids.tolist(), top.tolist(), strict=True)]

    rooted = stored(_with_roots(_per_tile(deep, greatest, "ty int, tx int, id long, top long", side), _roots(local)), "rooted")
    tops = stored(rooted.groupBy("image", "root").agg(F.max("top").alias("top")), "tops")
    # Of each tile the greatest depths of the components in it, no more than its pixels.
    inside = rooted.select("image", "ty", "tx", "id", "root").alias("r").join(_apart(tops).alias("t"), F.col("r.image").eqNullSafe(F.col("t.image")) & (F.col("r.root") == F.col("t.root")))
    known = inside.groupBy(F.col("r.image").alias("_image"), F.col("ty").alias("_ty"), F.col("tx").alias("_tx")).agg(F.collect_list(F.struct("id", F.col("r.root").alias("root"), F.col("t.top").alias("top"))).alias("tops"))
    spots = F.col("image").eqNullSafe(F.col("_image")) & (F.col("ty") == F.col("_ty")) & (F.col("tx") == F.col("_tx"))

    def above(at: tuple, tile: np.ndarray) -> list[tuple]:
        on, own, ids = numbered(at, tile)
        of = {t["id"]: (t["root"], t["top"]) for t in at[2]}
        root, top = (np.array(c, np.int64)[own] for c in zip(*[of[i] for i in ids.tolist()], strict=True))
        depth = np.where(tile[on] < FAR, tile[on], 0)
        rows = []
        for s, share in enumerate(shares):
            left = np.zeros(tile.shape, np.int64)
            left[on] = np.where(depth > share * top, root, 0)
            if left.any():
                rows.append((s, *at[:2], left.tobytes()))
        return rows

    cuts = _per_tile(deep.join(_apart(known), spots), above, "share int, ty int, tx int, data binary", side, "tops")
    found = component_table(cuts.select(F.struct("image", "share").alias("image"), "ty", "tx", "data"), side)
    counts = found.groupBy(F.col("image.image").alias("image"), F.col("image.share").alias("share"), F.col("tag").alias("root")).agg(F.count("*").alias("n")).groupBy("image", "root").agg(F.max("n").alias("n"))
    same = F.col("t.image").eqNullSafe(F.col("c.image")) & (F.col("t.root") == F.col("c.root"))
    return tops.alias("t").join(_apart(counts).alias("c"), same, "left").select("t.image", F.col("t.root").alias("component"), F.greatest(F.lit(1), F.coalesce("n", F.lit(1))).alias("peaks"), F.col("top").alias("deepest"))
