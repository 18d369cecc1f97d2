"""Tables of reads, pieces, detections, contours and pixels derived from the driver's tables by fixed rules.

The driver's data has neither photos nor codes; these rules make the operators' inputs from it, in
Spark here and in SQL (the constants) for the comparison.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import let
from .operators.vocabulary import prefix_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _share(expr: Column, mod: int = 1001) -> Column:
    """A score from 0 to 1 by remainder."""
    return (expr % mod).cast("double") / (mod - 1)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, piece_ord, true_code, kind, raw, score): each event is a piece whose code was read in one of eleven ways."""
    e = _table(spark, sf_dir, "events").select("event_id", "user_id")
    n = (F.col("event_id") % 1000 + 1).cast("int")
    rows = e.select(F.concat(F.lit("p"), (F.col("user_id") % 25).cast("string")).alias("photo_id"), F.col("event_id").alias("piece_ord"), n.alias("n"), prefix_of(n).alias("p"), (F.col("event_id") % 11).cast("int").alias("kind"))
    code = F.concat("p", F.lit("-"), F.col("n").cast("string"))

    def written(x: Column) -> Column:
        """The code, as the kind says, from struct(p, n, code, kind)."""
        p, n, c, kind = (x[k] for k in ("p", "n", "code", "kind"))
        ways = [
            c,
            F.lower(c),
            F.concat(F.lit(" "), p, F.lit(" - "), n),
            F.concat(p, F.lit("–"), n),
            F.concat(p, n),
            F.concat(p, F.lit("-"), F.lpad(n, 4, "0")),
            F.translate(c, "018", "OIB"),
            F.concat(F.translate(p, "AB", "BA"), F.lit("-"), n),
            F.substr(c, F.lit(1), F.length(c) - 1),
            F.concat(c, F.lit("7")),
        ]
        out = F.concat(F.lit("?"), c, F.lit("??Q"))
        for k, way in reversed(list(enumerate(ways))):
            out = F.when(kind == k, way).otherwise(out)
        return out

    raw = let(F.struct("p", F.col("n").cast("string").alias("n"), code.alias("code"), "kind"), written)
    return rows.select("photo_id", "piece_ord", code.alias("true_code"), "kind", raw.alias("raw"), _share(F.col("piece_ord") * 7919).alias("score"))


READS = """reads AS (
  SELECT photo_id, piece_ord, p || '-' || n AS true_code, kind,
    CASE kind WHEN 0 THEN p || '-' || n WHEN 1 THEN lower(p || '-' || n) WHEN 2 THEN ' ' || p || ' - ' || n WHEN 3 THEN p || '–' || n
      WHEN 4 THEN p || n WHEN 5 THEN p || '-' || lpad(n::VARCHAR, 4, '0') WHEN 6 THEN translate(p || '-' || n, '018', 'OIB')
      WHEN 7 THEN translate(p, 'AB', 'BA') || '-' || n WHEN 8 THEN left(p || '-' || n, length(p || '-' || n) - 1)
      WHEN 9 THEN p || '-' || n || '7' ELSE '?' || p || '-' || n || '??Q' END AS raw,
    ((piece_ord * 7919) % 1001)::DOUBLE / 1000 AS score
  FROM (SELECT 'p' || (user_id % 25) AS photo_id, event_id AS piece_ord, (event_id % 1000 + 1)::INT AS n,
      CASE WHEN event_id % 1000 < 260 THEN 'A' WHEN event_id % 1000 < 520 THEN 'B' WHEN event_id % 1000 < 760 THEN 'C' ELSE 'D' END AS p,
      (event_id % 11)::INT AS kind FROM events)
)"""


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, piece_ord, piece_id, code, confidence, raw_text, method, angle): reads of kinds 0 to 6 keep their code, of 7 an empty one, others none."""
    r = reads(spark, sf_dir)
    code = F.when(F.col("kind") <= 6, F.col("true_code")).when(F.col("kind") == 7, F.lit(""))
    ways = F.element_at(F.array(*map(F.lit, ("direct", "direct", "line", "sweep"))), (F.col("piece_ord") % 4 + 1).cast("int"))
    has = F.coalesce(code, F.lit("")) != ""
    return r.select("photo_id", "piece_ord", F.col("piece_ord").cast("int").alias("piece_id"), code.alias("code"), F.when(has, F.col("score")).otherwise(F.lit(0.0)).alias("confidence"), F.col("raw").alias("raw_text"), F.when(has, ways).otherwise(F.lit("none")).alias("method"), F.when(has, (F.col("piece_ord") % 12 * 30).cast("int")).alias("angle"))


PIECES = (
    READS
    + """, pieces AS (
  SELECT photo_id, piece_ord, piece_ord::INT AS piece_id, CASE WHEN kind <= 6 THEN true_code WHEN kind = 7 THEN '' END AS code,
    CASE WHEN kind <= 6 THEN score ELSE 0.0 END AS confidence, raw AS raw_text,
    CASE WHEN kind > 6 THEN 'none' WHEN piece_ord % 4 < 2 THEN 'direct' WHEN piece_ord % 4 = 2 THEN 'line' ELSE 'sweep' END AS method,
    CASE WHEN kind <= 6 THEN (piece_ord % 12 * 30)::INT END AS angle
  FROM reads
)"""
)

RESOLVED = (
    PIECES
    + """, ranked AS (
  SELECT *, CASE WHEN code <> '' THEN row_number() OVER (PARTITION BY photo_id, code ORDER BY confidence DESC, piece_ord) END AS rn FROM pieces
), resolved AS (
  SELECT photo_id, piece_ord, piece_id, CASE WHEN coalesce(rn, 1) = 1 THEN code END AS code, CASE WHEN coalesce(rn, 1) = 1 THEN confidence ELSE 0.0 END AS confidence,
    raw_text, CASE WHEN coalesce(rn, 1) = 1 THEN method ELSE 'conflict' END AS method, angle
  FROM ranked
)"""
)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of all passes: two direct ones for each read, two of its line and twelve of its sweep."""
    r = reads(spark, sf_dir).select("photo_id", F.col("piece_ord").alias("piece_id"), "true_code", "raw", "score")
    e = F.col("piece_id")
    make = lambda name, seq, angle, ord_, text, score: F.struct(F.lit(name).alias("pass"), F.lit(seq).alias("seq"), F.lit(angle).alias("angle"), F.lit(ord_).alias("det_ord"), text.alias("raw_text"), score.alias("score"))
    found = [make("direct", 0, 0, 0, F.col("raw"), F.col("score")), make("direct", 0, 0, 1, F.col("true_code"), _share(e * 31) / 2)]
    found += [make("line", k, 180 * k, 0, F.when((e + k) % 3 == 0, F.col("true_code")).otherwise(F.col("raw")), _share(e * 131 + k * 977)) for k in range(2)]
    found += [make("sweep", k, 30 * k, 0, F.when((e + k) % 4 == 0, F.col("true_code")).otherwise(F.col("raw")), _share(e * 17 + k * 389)) for k in range(12)]
    x = (e % 50).cast("int")
    quad = F.array(F.array(x, x), F.array(x + 40 + x % 7, x), F.array(x + 40, x + 15 + x % 60), F.array(x, x + 15))
    rows = r.select("photo_id", "piece_id", F.explode(F.array(*found)).alias("d")).select("photo_id", "piece_id", "d.*")
    return rows.withColumn("poly", F.when((F.col("pass") == "direct") & (F.col("det_ord") == e % 2) & (e % 5 != 0), quad))


DETECTIONS = (
    READS
    + """, detections AS (
  SELECT photo_id, piece_ord AS piece_id, 'direct' AS pass, 0 AS seq, 0 AS angle, 0 AS det_ord, raw AS raw_text, score, piece_ord % 2 = 0 AND piece_ord % 5 <> 0 AS quad FROM reads
  UNION ALL SELECT photo_id, piece_ord, 'direct', 0, 0, 1, true_code, ((piece_ord * 31) % 1001)::DOUBLE / 1000 / 2, piece_ord % 2 = 1 AND piece_ord % 5 <> 0 FROM reads
  UNION ALL SELECT photo_id, piece_ord, 'line', k, 180 * k, 0, CASE WHEN (piece_ord + k) % 3 = 0 THEN true_code ELSE raw END, ((piece_ord * 131 + k * 977) % 1001)::DOUBLE / 1000, FALSE FROM reads, (SELECT unnest(range(2))::INT AS k)
  UNION ALL SELECT photo_id, piece_ord, 'sweep', k, 30 * k, 0, CASE WHEN (piece_ord + k) % 4 = 0 THEN true_code ELSE raw END, ((piece_ord * 17 + k * 389) % 1001)::DOUBLE / 1000, FALSE FROM reads, (SELECT unnest(range(12))::INT AS k)
)"""
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, piece_ord, x, y, w, h): a rectangle for each event on a photo of 4000 x 3000, ten events to a photo and more."""
    e = F.col("event_id")
    i = lambda c: c.cast("int")
    return _table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.floor(e / 40).cast("string")).alias("photo_id"), e.alias("piece_ord"), i(e * 37 % 3900).alias("x"), i(e * 53 % 2900).alias("y"), i(20 + e * 7 % 400).alias("w"), i(20 + e * 11 % 300).alias("h"))


BOXES = """boxes AS (
  SELECT 'p' || (event_id // 40) AS photo_id, event_id AS piece_ord, (event_id * 37 % 3900)::INT AS x, (event_id * 53 % 2900)::INT AS y,
    (20 + event_id * 7 % 400)::INT AS w, (20 + event_id * 11 % 300)::INT AS h FROM events
)"""


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """boxes() with ``contour``: an L of half the width and height cut from the box's lower right."""
    point = lambda a, b: F.array(a.cast("int"), b.cast("int"))
    x, y, w, h = (F.col(c) for c in "xywh")
    hw, hh = F.floor(w / 2), F.floor(h / 2)
    line = F.array(point(x, y), point(x + w - 1, y), point(x + w - 1, y + hh), point(x + hw, y + hh), point(x + hw, y + h - 1), point(x, y + h - 1))
    return boxes(spark, sf_dir).withColumn("contour", line)


def dealt(rows: DataFrame, each: int, *by: str) -> DataFrame:
    """``rows`` in partitions of some ``each`` rows, by columns if given: for rows of which much is made. Adaptive merging of small partitions leaves these as they are."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism * 2, -(-rows.count() // each))
    return rows.repartition(parts, *by)


def photo_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(n) for each 500 events, of which a photo is drawn: dealt so that a task, which may hold all its photos as one batch, has PHOTOS at most, more or less."""
    return dealt(_table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 500).alias("n")).distinct(), PHOTOS)


#: Photos to a partition, of 230 KB each.
PHOTOS = 32
#: Embeddings to a partition of pixels, of which each is 64.
GRIDS = 4096


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, v): each embedding as 8 x 8 gray pixels. Dealt by image while they are few bytes, so that their pixels need not be."""
    grids = dealt(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), "embedding"), GRIDS, "image")
    rows = grids.select("image", F.posexplode("embedding").alias("pos", "e"))
    v = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("e").cast("double") + 0.6) * 212))).cast("int")
    return rows.select("image", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).alias("x"), v.alias("v"))


PIXELS = """pixels AS (
  SELECT vec_id AS image, ((pos - 1) // 8)::INT AS y, ((pos - 1) % 8)::INT AS x, least(255, greatest(0, floor((e::DOUBLE + 0.6) * 212)))::INT AS v
  FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS pos FROM embeddings)
)"""


class DrawnCodes:
    """A recognizer for drawn pieces: the number of a piece's code is told by the colour amid its crop.

    Numbers divisible by 25 are not read, those divisible by 7 as lower case and without the dash;
    numbers not divisible by 9 are sure.
    """

    def read(self, image):
        b, g, r = (int(c) for c in image[image.shape[0] // 2, image.shape[1] // 2])
        n = (g - 200) * 50 + r - 200
        letter = "ABCD"[(n > 260) + (n > 520) + (n > 760)]
        text = "??" if n % 25 == 0 else f"{letter.lower()}{n}" if n % 7 == 0 else f"{letter}-{n}"
        return [(text, 0.95 if n % 9 else 0.6, None)]


def coded_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, image_path, height, width, data): a dark photo for each 500 events with six discs in colours that tell numbers; the first and the last have the same."""
    import numpy as np
    import pandas as pd

    def run(batches):
        y, x = np.mgrid[:240, :320]
        for batch in batches:
            rows = []
            for n in batch["n"]:
                image = np.full((240, 320, 3), 20, np.uint8)
                for k in range(6):
                    number, r = (n * 131 + k % 5 * 37) % 1000 + 1, 20 + (n * 7 + k * 5) % 12
                    image[(x - 55 - 100 * (k % 3)) ** 2 + (y - 65 - 110 * (k // 3)) ** 2 <= r * r] = (235, 200 + number // 50, 200 + number % 50)
                rows.append((f"p{n}", f"/photos/p{n}.png", 240, 320, image.tobytes()))
            yield pd.DataFrame(rows, columns=["photo_id", "image_path", "height", "width", "data"])

    return photo_numbers(spark, sf_dir).mapInPandas(run, "photo_id string, image_path string, height int, width int, data binary")
