"""The registered queries, and the SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .config import SETTINGS
from .functions import costs, geometry, text
from .operators import lookup, neighbours, pixels, polygons, recognize, report, tiles, vocabulary
from .operators.resolve import resolve
from .sources import library, store
from .sources.scratch import fresh_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


WS = text.WHITE

def normal(column: str) -> str:
    """DuckDB's normalisation of a column."""
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(translate(upper({column}), '{text.DASHES}', '{'-' * len(text.DASHES)}'), '{WS}+', '', 'g'), "
        r"'^(.)([0-9]{1,4})$', '\1-\2'), '^(.)-0*([0-9]+)$', '\1-\2')"
    )


def valid(column: str) -> str:
    """DuckDB's test for a code."""
    n = f"TRY_CAST(regexp_extract({column}, '^[A-D]-([1-9][0-9]{{0,3}})$', 1) AS INT)"
    return f"coalesce(CASE WHEN {n} BETWEEN 1 AND 260 THEN 'A' WHEN {n} BETWEEN 261 AND 520 THEN 'B' WHEN {n} BETWEEN 521 AND 760 THEN 'C' WHEN {n} BETWEEN 761 AND 1000 THEN 'D' END = left({column}, 1), FALSE)"


CODES = """codes AS (
  SELECT (n - 1)::INT AS ord, p AS prefix, n AS number, p || '-' || n AS code, length(p || '-' || n)::INT AS len, (length(p || '-' || n) - 2)::INT AS digits
  FROM (SELECT n::INT AS n, CASE WHEN n <= 260 THEN 'A' WHEN n <= 520 THEN 'B' WHEN n <= 760 THEN 'C' ELSE 'D' END AS p FROM range(1, 1001) t(n))
)"""


@query(f"WITH {CODES} SELECT * FROM codes")
def codes_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.codes(spark)


@query(f"WITH {A.READS} SELECT piece_ord, raw, {normal('raw')} AS normalized FROM reads")
def normalize_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.reads(spark, sf_dir).select("piece_ord", "raw", text.normalize(F.col("raw")).alias("normalized"))


@query(f"SELECT conv_id, turn, md5({normal("replace(text, 'ß', 'ss')")}) AS digest FROM conversations")
def normalize_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return table.select("conv_id", "turn", F.md5(text.normalize(F.replace("text", F.lit("ß"), F.lit("ss"))).cast("binary")).alias("digest"))


@query(f"WITH {A.READS}, {CODES}, named AS (SELECT photo_id, {normal('raw')} AS t FROM reads) SELECT photo_id, t AS code, count(*)::BIGINT AS n FROM named SEMI JOIN codes ON t = code GROUP BY ALL")
def valid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = A.reads(spark, sf_dir).select("photo_id", text.normalize(F.col("raw")).alias("code"))
    return named.where(vocabulary.is_valid(F.col("code"))).groupBy("photo_id", "code").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 260 THEN 'A' WHEN n BETWEEN 261 AND 520 THEN 'B' WHEN n BETWEEN 521 AND 760 THEN 'C' WHEN n BETWEEN 761 AND 1000 THEN 'D' END AS prefix FROM (SELECT o_orderkey, o_orderkey % 1100 - 20 AS n FROM orders)")
def prefix_of_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") % 1100 - 20
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", vocabulary.prefix_of(n).alias("prefix"))


@query("""
WITH chars AS (SELECT chr((45 + i)::INT) AS c FROM range(46) t(i)), groups AS (SELECT unnest(['0OD', '1IL', '8B', '5S', '2Z', '6G', '9Q']) AS g)
SELECT a.c AS a, b.c AS b, CASE WHEN a.c = b.c THEN 0 WHEN EXISTS (SELECT 1 FROM groups WHERE contains(g, a.c) AND contains(g, b.c)) THEN 40 ELSE 100 END::INT AS cost
FROM chars a, chars b""")
def sub_cost_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = spark.range(46).select(F.chr(F.col("id") + 45).alias("a"))
    both = chars.join(F.broadcast(chars.withColumnRenamed("a", "b")), how="cross")
    return both.select("a", "b", costs.substitution(F.col("a"), F.col("b")).alias("cost"))


DP = """
  CASE WHEN length(t) = length(c) THEN list_sum([CASE WHEN t[i] = c[i] THEN 0 WHEN translate(t[i], 'ODILBSZGQ', '001185269') = translate(c[i], 'ODILBSZGQ', '001185269') THEN 40 ELSE 100 END for i in range(1, length(t) + 1)])
  ELSE list_reduce(list_concat([[j * 100 for j in range(0, length(c) + 1)]], [[i] for i in range(1, length(t) + 1)]), lambda prev, i:
    list_reduce(list_concat([[i[1] * 150]], [[j] for j in range(1, length(c) + 1)]), lambda cur, j:
      list_append(cur, least(prev[j[1] + 1] + 150, cur[j[1]] + 100, prev[j[1]] +
        CASE WHEN t[i[1]] = c[j[1]] THEN 0 WHEN translate(t[i[1]], 'ODILBSZGQ', '001185269') = translate(c[j[1]], 'ODILBSZGQ', '001185269') THEN 40 ELSE 100 END))))[length(c) + 1]
  END"""


@query(f"WITH {A.READS}, named AS (SELECT DISTINCT {normal('raw')} AS t, true_code AS c FROM reads) SELECT t AS read, c AS code, ({DP})::INT AS cost FROM named WHERE t <> ''")
def edit_distance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = A.reads(spark, sf_dir).select(text.normalize(F.col("raw")).alias("read"), F.col("true_code").alias("code")).where("read <> ''").distinct()
    return named.select("read", "code", costs.distance(F.col("read"), F.col("code")).alias("cost"))


def spelt(column: str) -> str:
    """Columns p1 to p6, the characters of a text as numbers, and q1 to q6, those without regard to confusion; alike beyond the end."""
    plain = f"translate({column}, 'ODILBSZGQ', '001185269')"
    return ", ".join(f"unicode(substr({column}, {i}, 1)) AS p{i}, unicode(substr({plain}, {i}, 1)) AS q{i}" for i in range(1, 7))


#: The substitution sum of two texts of equal length, six at most, as codes are.
SUB = "(" + " + ".join(f"CASE WHEN a.p{i} = b.p{i} THEN 0 WHEN a.q{i} = b.q{i} THEN 40 ELSE 100 END" for i in range(1, 7)) + ")"
#: Matching by substitution sums alone: of texts one longer, all ways to leave out one character; of shorter ones, of the code.
#: It equals the alignment wherever that costs under 350, and texts whose best costs more are aligned in full.
SNAPPED = f"""texts AS (SELECT DISTINCT {normal("raw")} AS t FROM reads),
  odd AS (SELECT t, length(t) AS lt FROM texts WHERE t <> '' AND NOT {valid("t")}),
  whole_t AS (SELECT t, lt, {spelt("t")} FROM odd), whole_c AS (SELECT ord, len, {spelt("code")} FROM codes),
  less_t AS (SELECT t, lt, {spelt("s")} FROM (SELECT t, lt, left(t, k - 1) || substr(t, k + 1) AS s FROM (SELECT t, lt, unnest(range(1, lt + 1)) AS k FROM odd WHERE lt < 8))),
  less AS (SELECT DISTINCT ord, len, left(code, k - 1) || substr(code, k + 1) AS s FROM (SELECT ord, code, len, unnest(range(1, len + 1)) AS k FROM codes)),
  less_c AS (SELECT ord, len, {spelt("s")} FROM less),
  least_c AS (SELECT ord, len, {spelt("s")} FROM (SELECT DISTINCT ord, len, left(s, k - 1) || substr(s, k + 1) AS s FROM (SELECT ord, len, s, unnest(range(1, len)) AS k FROM less))),
  met AS (
    SELECT t, ord, {SUB} AS cost FROM whole_t a JOIN whole_c b ON lt = len
    UNION ALL SELECT t, ord, 150 + {SUB} FROM less_t a JOIN whole_c b ON lt - 1 = len
    UNION ALL SELECT t, ord, 100 + {SUB} FROM whole_t a JOIN less_c b ON lt + 1 = len
    UNION ALL SELECT t, ord, 200 + {SUB} FROM whole_t a JOIN least_c b ON lt + 2 = len),
  near AS (SELECT t, code, ord, cost FROM (SELECT t, ord, min(cost) AS cost FROM met GROUP BY ALL) JOIN codes USING (ord)),
  ranked AS (SELECT t, code, cost, row_number() OVER (PARTITION BY t ORDER BY cost, ord) AS rn, lead(cost) OVER (PARTITION BY t ORDER BY cost, ord) AS second FROM near),
  snapped AS (
    SELECT t, t AS code, 0 AS cost FROM texts WHERE {valid("t")}
    UNION ALL SELECT t, CASE WHEN coalesce(second - cost >= 25, TRUE) AND cost <= least(200, 70 * (length(code) - 2)) THEN code END, cost FROM ranked WHERE rn = 1
    UNION ALL SELECT t, NULL, CASE WHEN lt > 6 THEN 150 * (lt - 6) ELSE 100 * (3 - lt) END FROM odd WHERE lt > 7 OR lt < 1
    UNION ALL SELECT t, NULL, NULL FROM texts WHERE t = ''
  )"""


@query(f"WITH {A.READS}, {CODES}, {SNAPPED} SELECT piece_ord, raw, {normal('raw')} AS text, code AS snapped, cost::BIGINT AS cost FROM reads LEFT JOIN snapped ON t = {normal('raw')}")
def snap_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.snap(A.reads(spark, sf_dir).select("piece_ord", "raw"), "raw").select("piece_ord", "raw", "text", "snapped", "cost")


def read_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces from matched reads, one for each code and photo."""
    found = vocabulary.snap(A.reads(spark, sf_dir), "raw")
    ok = F.col("snapped").isNotNull() & (F.col("score") >= SETTINGS.least_score)
    rows = found.select("photo_id", "piece_ord", F.col("piece_ord").alias("piece_id"), F.when(ok, F.col("snapped")).alias("code"), F.when(ok, F.col("score")).otherwise(F.lit(0.0)).alias("confidence"), F.when(ok, F.lit("direct")).otherwise(F.lit("none")).alias("method"))
    return resolve(rows)


@query(f"""WITH {A.READS}, {CODES}, {SNAPPED},
  found AS (SELECT photo_id, piece_ord, CASE WHEN score >= 0.35 THEN code END AS code, score FROM reads LEFT JOIN snapped ON t = {normal("raw")}),
  best AS (SELECT photo_id, code, row_number() OVER (PARTITION BY photo_id, code ORDER BY score DESC, piece_ord) AS rn FROM found)
SELECT photo_id, count(*)::BIGINT AS total, count(*) FILTER (WHERE code IS NOT NULL AND rn = 1)::BIGINT AS recognized,
  count(*) FILTER (WHERE NOT (code IS NOT NULL AND rn = 1))::BIGINT AS unrecognized, round(count(*) FILTER (WHERE code IS NOT NULL AND rn = 1) / count(*), 4) AS rate
FROM best GROUP BY photo_id""")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: reads normalised, matched, made unique and counted by photo."""
    pieces = read_pieces(spark, sf_dir)
    return lookup.photo_stats(pieces.select("photo_id").distinct(), pieces)


@query(f"WITH {A.RESOLVED} SELECT photo_id, piece_ord, code, confidence, raw_text, method, angle FROM resolved")
def resolve_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(A.pieces(spark, sf_dir)).select("photo_id", "piece_ord", "code", "confidence", "raw_text", "method", "angle")


@query(f"""WITH {A.RESOLVED}, photos AS (SELECT DISTINCT photo_id FROM pieces UNION ALL SELECT 'empty')
SELECT photo_id, count(piece_ord)::BIGINT AS total, count(*) FILTER (WHERE code <> '')::BIGINT AS recognized, (count(piece_ord) - count(*) FILTER (WHERE code <> ''))::BIGINT AS unrecognized,
  CASE WHEN count(piece_ord) > 0 THEN round(count(*) FILTER (WHERE code <> '') / count(piece_ord), 4) END AS rate
FROM photos LEFT JOIN resolved USING (photo_id) GROUP BY photo_id""")
def recognized_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = resolve(A.pieces(spark, sf_dir))
    photos = pieces.select("photo_id").distinct().unionByName(spark.range(1).select(F.lit("empty").alias("photo_id")))
    return lookup.photo_stats(photos, pieces)


@query(f"WITH {A.RESOLVED} SELECT method, count(*)::BIGINT AS n FROM resolved GROUP BY method")
def method_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.method_counts(resolve(A.pieces(spark, sf_dir)))


ASKED = "asked AS (SELECT raw AS query, " + normal("raw") + " AS code FROM (SELECT DISTINCT raw FROM reads))"


@query(f"""WITH {A.RESOLVED}, {ASKED}, first_ AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY photo_id || '.json', piece_ord) AS rn FROM resolved WHERE code <> '')
SELECT query, code, photo_id, piece_id, confidence FROM asked JOIN first_ USING (code) WHERE rn = 1""")
def lookup_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = A.reads(spark, sf_dir).select(F.col("raw").alias("query")).distinct()
    return lookup.hits(asked, resolve(A.pieces(spark, sf_dir))).select("query", "code", "photo_id", "piece_id", "confidence")


MISSED = "VALUES ('E-1'), ('!!!'), ('d 1001'), ('A-1')"


@query(f"""WITH {A.RESOLVED}, asked AS (SELECT query, {normal("query")} AS code FROM ({MISSED}) v(query)),
  rest AS (SELECT photo_id, count(*)::BIGINT AS n, string_agg(piece_id::VARCHAR, ',' ORDER BY piece_ord) AS piece_ids FROM resolved WHERE coalesce(code, '') = '' GROUP BY photo_id)
SELECT query, code, photo_id, n, piece_ids FROM asked ANTI JOIN (SELECT code FROM resolved WHERE code <> '') h USING (code), rest""")
def lookup_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.sql(f"SELECT * FROM ({MISSED}) AS v(query)")
    return lookup.misses(asked, resolve(A.pieces(spark, sf_dir)))


def known_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with their texts matched to the nearest codes, as build_index does."""
    return vocabulary.snap(A.detections(spark, sf_dir), "raw_text")


KNOWN = (
    A.DETECTIONS
    + f""", {CODES}, {SNAPPED}, known AS (SELECT d.*, CASE WHEN {valid("d.t")} THEN d.t ELSE snapped.code END AS snapped FROM (SELECT *, {normal("raw_text")} AS t FROM detections) d LEFT JOIN snapped ON d.t = snapped.t),
  fit AS (SELECT *, row_number() OVER (PARTITION BY photo_id, piece_id, pass, seq ORDER BY score DESC, det_ord) AS rn FROM known WHERE score >= 0.35 AND snapped IS NOT NULL),
  best AS (SELECT photo_id, piece_id, pass, seq, snapped AS code, score AS confidence, raw_text, angle FROM fit WHERE rn = 1),
  ahead AS (SELECT *, coalesce(max(confidence) OVER (PARTITION BY photo_id, piece_id, pass ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM best),
  swept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY photo_id, piece_id, pass ORDER BY confidence DESC, seq) AS rn FROM ahead WHERE before < 0.99) WHERE rn = 1)"""
)


@query(f"WITH {KNOWN} SELECT photo_id, piece_id, code, confidence, raw_text FROM best WHERE pass = 'direct'")
def best_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize.best_detection(known_detections(spark, sf_dir).where("pass = 'direct'"))
    return found.select("photo_id", "piece_id", "code", "confidence", "raw_text")


@query(f"WITH {A.DETECTIONS} SELECT photo_id, piece_id, (piece_id % 50)::INT AS left_, (piece_id % 50 + 40 + piece_id % 50 % 7)::INT AS right_ FROM detections WHERE quad")
def best_poly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recognize.best_poly(A.detections(spark, sf_dir))
    corner = lambda i: F.get(F.get("poly", F.lit(i)), F.lit(0))
    return found.select("photo_id", "piece_id", corner(0).alias("left_"), corner(1).alias("right_"))


@query(f"WITH {KNOWN} SELECT photo_id, piece_id, code, confidence, raw_text, angle FROM swept WHERE pass = 'line'")
def line_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.swept(recognize.best_detection(known_detections(spark, sf_dir).where("pass = 'line'")))


@query(f"WITH {KNOWN} SELECT photo_id, piece_id, code, confidence, raw_text, angle FROM swept WHERE pass = 'sweep'")
def angle_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognize.swept(recognize.best_detection(known_detections(spark, sf_dir).where("pass = 'sweep'")))


@query(f"""WITH {KNOWN}, quads AS (SELECT DISTINCT photo_id, piece_id FROM detections WHERE quad),
  j AS (SELECT r.photo_id, r.piece_ord AS piece_id, d.code AS dc, coalesce(d.confidence, 0) AS df, d.raw_text AS dr, d.angle AS da,
      l.code AS lc, l.confidence AS lf, l.raw_text AS lr, l.angle AS la, s.code AS sc, s.confidence AS sf, s.raw_text AS sr, s.angle AS sa,
      coalesce(d.confidence, 0) < 0.9 AND q.piece_id IS NOT NULL AND coalesce(l.confidence, 0) > coalesce(d.confidence, 0) AS use_line
    FROM reads r LEFT JOIN best d ON r.photo_id = d.photo_id AND r.piece_ord = d.piece_id AND d.pass = 'direct'
    LEFT JOIN quads q ON r.photo_id = q.photo_id AND r.piece_ord = q.piece_id
    LEFT JOIN swept l ON r.photo_id = l.photo_id AND r.piece_ord = l.piece_id AND l.pass = 'line'
    LEFT JOIN swept s ON r.photo_id = s.photo_id AND r.piece_ord = s.piece_id AND s.pass = 'sweep'),
  k AS (SELECT *, CASE WHEN use_line THEN lf ELSE df END AS tf FROM j),
  m AS (SELECT *, tf < 0.9 AND coalesce(sf, 0) > tf AS use_sweep FROM k)
SELECT photo_id, piece_id, CASE WHEN use_sweep THEN sc WHEN use_line THEN lc ELSE dc END AS code, CASE WHEN use_sweep THEN sf ELSE tf END AS confidence,
  CASE WHEN use_sweep THEN sr WHEN use_line THEN lr ELSE dr END AS raw_text,
  CASE WHEN use_sweep THEN 'sweep' WHEN use_line THEN 'line' WHEN dc IS NOT NULL THEN 'direct' ELSE 'none' END AS method,
  CASE WHEN use_sweep THEN sa WHEN use_line THEN la ELSE da END AS angle FROM m""")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = known_detections(spark, sf_dir)
    pieces = A.reads(spark, sf_dir).select("photo_id", F.col("piece_ord").alias("piece_id"))
    return recognize.cascade(pieces, found)


NAMES = r"""(SELECT 'n' || doc_id AS k, left(text, (doc_id % 50)::INT) AS name FROM documents
  UNION ALL SELECT 'k' || i, v FROM (VALUES (1, ''), (2, '  2  '), (3, '..'), (4, 'con'), (5, 'Com1'), (6, 'CON.txt'), (7, 'a/b'), (8, 'a:b*'), (9, '左上角'), (10, '.'), (11, 'lpt9'), (12, 'aux ')) t(i, v))"""


@query(rf"""SELECT k, CASE WHEN t = '' THEN 'empty' WHEN length(t) > 40 THEN 'long' WHEN t IN ('.', '..') THEN 'dots' WHEN regexp_matches(t, '[/\\:*?"<>|]') THEN 'illegal'
  WHEN regexp_matches(t, '[\x00-\x1f]') THEN 'control' WHEN regexp_matches(upper(t), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN 'reserved' END AS error,
  array_to_string(list_sort(list_distinct(list_filter(string_split(t, ''), lambda c: c <> '' AND contains('/\:*?"<>|', c)))), '') AS illegal
FROM (SELECT k, regexp_replace(regexp_replace(name, '^{WS}+', ''), '{WS}+$', '') AS t FROM {NAMES})""")
def photo_id_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    names = spark.sql(f"SELECT * FROM {NAMES}")
    return names.select("k", text.name_error(F.col("name")).alias("error"), text.illegal_found(F.col("name")).alias("illegal"))


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'id' || page_id ELSE regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '(.)\.[^.]+$', '\1') END AS photo_id FROM pages")
def photo_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("id"), F.col("page_id").cast("string"))).when(F.col("page_id") % 3 == 1, F.lit(""))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.photo_name(given, F.col("url")).alias("photo_id"))


@query(f"WITH {A.BOXES} SELECT piece_ord, ((w - 1) * (h // 2) + (w // 2) * (h - 1 - h // 2))::DOUBLE AS area FROM boxes")
def contour_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contours(spark, sf_dir).select("piece_ord", geometry.area(F.col("contour")).alias("area"))


@query(f"WITH {A.BOXES} SELECT piece_ord, x, y, w, h FROM boxes")
def contour_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.contours(spark, sf_dir).select("piece_ord", geometry.box(F.col("contour")).alias("b")).select("piece_ord", "b.*")


@query(f"""WITH {A.BOXES}, windows AS (SELECT photo_id, piece_ord, greatest(0, x - 6) AS x0, greatest(0, y - 6) AS y0, least(4000, x + w + 6) AS x1, least(3000, y + h + 6) AS y1 FROM boxes)
SELECT a.photo_id, a.piece_ord, b.piece_ord AS neighbour FROM windows a JOIN boxes b ON a.photo_id = b.photo_id AND a.piece_ord <> b.piece_ord AND b.x < x1 AND b.y < y1 AND b.x + b.w > x0 AND b.y + b.h > y0""")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.in_windows(A.boxes(spark, sf_dir), 4000, 3000)


@query(f"""WITH {A.BOXES}, windows AS (SELECT piece_ord, greatest(0, x - 6) AS x0, greatest(0, y - 6) AS y0, least(4000, x + w + 6) AS x1, least(3000, y + h + 6) AS y1 FROM boxes)
SELECT piece_ord, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, greatest(1, round_even((x1 - x0) * (512.0::DOUBLE / greatest(x1 - x0, y1 - y0)), 0))::INT AS out_w, greatest(1, round_even((y1 - y0) * (512.0::DOUBLE / greatest(x1 - x0, y1 - y0)), 0))::INT AS out_h FROM windows""")
def crop_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = geometry.crop_window(*(F.col(c) for c in "xywh"), F.lit(4000), F.lit(3000))
    return A.boxes(spark, sf_dir).select("piece_ord", window.alias("c")).select("piece_ord", "c.*")


@query(f"""WITH {A.BOXES}, sized AS (SELECT photo_id, piece_ord, (w * h)::DOUBLE AS area FROM boxes), mid AS (SELECT photo_id, median(area) AS unit FROM sized GROUP BY photo_id)
SELECT photo_id, piece_ord, greatest(1, round_even(area / unit, 0))::INT AS expected, area < 1.6 * unit AS whole FROM sized JOIN mid USING (photo_id) WHERE area >= 0.25 * unit""")
def expected_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = A.boxes(spark, sf_dir).select("photo_id", "piece_ord", (F.col("w") * F.col("h")).cast("double").alias("area"))
    unit = sized.groupBy("photo_id").agg(F.median("area").alias("unit"))
    kept = sized.join(unit, "photo_id").where(F.col("area") >= SETTINGS.least_area * F.col("unit"))
    return kept.select("photo_id", "piece_ord", geometry.expected_pieces(F.col("area"), F.col("unit")).alias("expected"), (F.col("area") < SETTINGS.split_from * F.col("unit")).alias("whole"))


@query(f"""WITH {A.BOXES}, z AS (SELECT piece_ord, least(2, floor((x + w / 2) / 4000 * 3))::INT AS c, least(2, floor((y + h / 2) / 3000 * 3))::INT AS r FROM boxes)
SELECT piece_ord, CASE WHEN c = 1 AND r = 1 THEN '正中' ELSE ['左', '中', '右'][c + 1] || ['上', '中', '下'][r + 1] || '区' END AS zone FROM z""")
def zone_of_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.boxes(spark, sf_dir).select("piece_ord", geometry.zone(*(F.col(c) for c in "xywh"), F.lit(4000), F.lit(3000)).alias("zone"))


@query(f"""WITH {A.READS}, q AS (SELECT piece_ord AS piece_id, (piece_ord % 50)::INT AS x FROM reads WHERE piece_ord % 5 <> 0),
  s AS (SELECT piece_id, 40 + x % 7 AS top, sqrt(40.0::DOUBLE * 40 + (x % 60)::DOUBLE * (x % 60)) AS low, 15 AS l, sqrt((x % 7)::DOUBLE * (x % 7) + (15.0::DOUBLE + x % 60) * (15 + x % 60)) AS r FROM q),
  t AS (SELECT piece_id, greatest(1, trunc(greatest(top, low)))::INT AS w, greatest(1, trunc(greatest(l, r)))::INT AS h FROM s)
SELECT piece_id, w, h, h / greatest(1, w) >= 1.5 AS turn FROM t""")
def quad_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = recognize.best_poly(A.detections(spark, sf_dir))
    return quads.select("piece_id", geometry.quad_size(F.col("poly")).alias("q")).select("piece_id", "q.*")


@query(f"""WITH {A.BOXES}, t AS (SELECT piece_ord, w, h, radians((piece_ord % 12) * 30) AS a FROM boxes)
SELECT piece_ord, trunc(h * abs(sin(a)) + w * abs(cos(a)))::INT AS w, trunc(h * abs(cos(a)) + w * abs(sin(a)))::INT AS h FROM t""")
def rotated_canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = geometry.rotated_canvas(F.col("w"), F.col("h"), F.col("piece_ord") % 12 * 30)
    return A.boxes(spark, sf_dir).select("piece_ord", turned.alias("c")).select("piece_ord", "c.*")


@query(f"WITH {A.BOXES} SELECT piece_ord, greatest(2, round_even(greatest(w * 10, h * 10)::DOUBLE * 0.0035::DOUBLE, 0))::INT AS thickness FROM boxes")
def outline_thickness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.boxes(spark, sf_dir).select("piece_ord", geometry.outline_thickness(F.col("w") * 10, F.col("h") * 10).alias("thickness"))


@query(f"""WITH {A.RESOLVED}, s AS (SELECT list_sort(list(confidence)) AS l, count(*)::BIGINT AS n, count(*) FILTER (WHERE confidence < 0.9)::BIGINT AS unsure FROM resolved WHERE code <> '')
SELECT n, l[1] AS low, l[n // 4 + 1] AS q25, l[n // 2 + 1] AS mid, l[n] AS high, unsure FROM s""")
def confidence_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.confidence_distribution(resolve(A.pieces(spark, sf_dir)))


@query(f"WITH {A.RESOLVED} SELECT left(code, 1) AS prefix, count(*)::BIGINT AS n, min(substr(code, 3)::INT) AS low, max(substr(code, 3)::INT) AS high FROM resolved WHERE code <> '' GROUP BY 1")
def prefix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.prefix_coverage(resolve(A.pieces(spark, sf_dir)))


@query(f"""WITH {A.RESOLVED} SELECT r.photo_id, r.piece_id, p.code, p.confidence, k.piece_id AS kept_piece, k.confidence AS kept_confidence
FROM resolved r JOIN pieces p ON r.piece_ord = p.piece_ord LEFT JOIN resolved k ON k.photo_id = r.photo_id AND k.code = p.code WHERE r.method = 'conflict'""")
def conflict_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = A.pieces(spark, sf_dir)
    return report.conflict_detail(before, resolve(before))


@query(f"""WITH {A.RESOLVED}, c AS (SELECT photo_id, count(*)::BIGINT AS total, count(*) FILTER (WHERE method = 'conflict')::BIGINT AS conflicts, count(*) FILTER (WHERE method = 'sweep')::BIGINT AS sweeps, count(*) FILTER (WHERE code <> '') AS hit FROM resolved GROUP BY photo_id)
SELECT photo_id, total, conflicts, sweeps, CASE WHEN total = 0 THEN 'no_pieces' WHEN conflicts >= greatest(2, total * 0.1) THEN 'conflicts' WHEN sweeps >= greatest(2, total * 0.1) THEN 'sweeps' ELSE 'normal' END AS advice, hit < 0.7 * total AS low_rate FROM c""")
def tuning_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.tuning_advice(resolve(A.pieces(spark, sf_dir)))


@query("SELECT l_orderkey, l_linenumber, ((l_partkey % 256) * 1868 + (l_suppkey % 256) * 9617 + (l_orderkey % 256) * 4899 + 8192) >> 14 AS gray FROM lineitem")
def gray_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    level = lambda c: F.col(c) % 256
    return table.select("l_orderkey", "l_linenumber", pixels.gray(level("l_partkey"), level("l_suppkey"), level("l_orderkey")).alias("gray"))


@query(f"WITH {A.PIXELS} SELECT image, v, count(*)::BIGINT AS n FROM pixels GROUP BY ALL")
def gray_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.histogram(A.pixels(spark, sf_dir))


OTSU = """h AS (SELECT image, v, count(*) AS n FROM pixels GROUP BY ALL),
  c AS (SELECT image, v, sum(n) OVER u AS w, sum(v * n) OVER u AS m, sum(n) OVER a AS ww, sum(v * n) OVER a AS mm FROM h WINDOW u AS (PARTITION BY image ORDER BY v), a AS (PARTITION BY image)),
  s AS (SELECT image, v, CASE WHEN w < ww THEN ((mm * w - ww * m)::DOUBLE * (mm * w - ww * m)::DOUBLE) / (w * (ww - w))::DOUBLE ELSE 0 END AS score FROM c),
  otsu AS (SELECT image, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, v) AS rn FROM s) WHERE rn = 1),
  mask AS (SELECT image, y, x, CASE WHEN v > threshold THEN 255 ELSE 0 END AS v FROM pixels JOIN otsu USING (image))"""


@query(f"WITH {A.PIXELS}, {OTSU} SELECT image, threshold FROM otsu")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.otsu(A.pixels(spark, sf_dir))


@query(f"WITH {A.PIXELS}, {OTSU} SELECT image, count(*)::BIGINT AS n, count(*) FILTER (WHERE v > 0)::BIGINT AS lit FROM mask GROUP BY image")
def mask_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = A.pixels(spark, sf_dir)
    return pixels.foreground(pixels.masked(grid, pixels.otsu(grid)))


def _around(name: str, source: str, how: str) -> str:
    """One pass of the element in SQL, by a join of each pixel with those under it."""
    return f"{name} AS (SELECT a.image, a.y, a.x, {how}(b.v)::INT AS v FROM {source} a JOIN {source} b ON a.image = b.image AND ((abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 2) OR (abs(a.y - b.y) = 2 AND a.x = b.x)) GROUP BY ALL)"


@query(f"WITH {A.PIXELS}, {OTSU}, {_around('m1', 'mask', 'min')}, {_around('m2', 'm1', 'max')}, {_around('m3', 'm2', 'max')}, {_around('m4', 'm3', 'min')} SELECT image, y, x, v FROM m4")
def morph_open_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = A.pixels(spark, sf_dir)
    return pixels.open_close(pixels.masked(grid, pixels.otsu(grid)))


MIRROR = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} >= 8 THEN 14 - ({0}) ELSE {0} END"


@query(f"""WITH {A.PIXELS}, k AS (SELECT i - 2 AS d, [1, 4, 6, 4, 1][i + 1] AS w FROM range(5) t(i)),
  rows_ AS (SELECT p.image, p.y, p.x, sum(w * q.v) AS v FROM pixels p, k JOIN pixels q ON q.image = p.image AND q.y = p.y AND q.x = {MIRROR.format("p.x + d")} GROUP BY ALL)
SELECT p.image, p.y, p.x, ((sum(w * q.v)::BIGINT + 128) >> 8)::INT AS v FROM rows_ p, k JOIN rows_ q ON q.image = p.image AND q.x = p.x AND q.y = {MIRROR.format("p.y + d")} GROUP BY ALL""")
def gaussian_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.blur(A.pixels(spark, sf_dir), 8, 8)


@query(f"WITH {A.PIXELS} SELECT image, y, x, CASE WHEN y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 4 THEN v ELSE trunc(v * 0.45::DOUBLE)::INT END AS v FROM pixels")
def dim_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.dimmed(A.pixels(spark, sf_dir), F.col("y").between(2, 5) & F.col("x").between(1, 4), SETTINGS.dim)


def photos_of(pieces: DataFrame) -> DataFrame:
    """Pieces with made-up boxes as photos of the library."""
    box = {c: (F.col("piece_ord") % m).cast("int") for c, m in (("x", 900), ("y", 700), ("w", 90), ("h", 80))}
    rows = pieces.withColumns({**box, "area": (F.col("piece_ord") % 1000).cast("double"), "contour": F.array(F.array((F.col("piece_ord") % 900).cast("int"), (F.col("piece_ord") % 700).cast("int")))})
    heads = pieces.select("photo_id").distinct().select("photo_id", F.concat(F.lit("/in/"), "photo_id").alias("image_path"), F.lit(1000).alias("width"), F.lit(800).alias("height"), F.lit("2026-01-01T00:00:00").alias("created_at"))
    return library.nested(heads, rows)


@query(f"WITH {A.RESOLVED} SELECT photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY piece_ord) - 1 AS piece_ord, piece_id, (piece_ord % 900)::INT AS x, (piece_ord % 700)::INT AS y, (piece_ord % 90)::INT AS w, (piece_ord % 80)::INT AS h, (piece_ord % 1000)::DOUBLE AS area, code, confidence, method, angle FROM resolved")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos written as JSON, read again and taken apart."""
    again = library.from_json(library.to_json(photos_of(resolve(A.pieces(spark, sf_dir)))))
    return library.flat(again).drop("contour", "raw_text")


@query(f"WITH {A.RESOLVED}, new AS (SELECT photo_id, piece_ord, piece_id, code FROM pieces WHERE photo_id IN ('p1', 'p2', 'p3') AND piece_ord % 2 = 0) SELECT photo_id, piece_ord, piece_id, code FROM resolved WHERE photo_id NOT IN (SELECT photo_id FROM new) UNION ALL FROM new")
def index_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three photos replaced by other versions."""
    old = resolve(A.pieces(spark, sf_dir)).select("photo_id", "piece_ord", "piece_id", "code")
    new = A.pieces(spark, sf_dir).where(F.col("photo_id").isin("p1", "p2", "p3") & (F.col("piece_ord") % 2 == 0))
    return library.upsert(old, new)


@query(f"WITH {A.RESOLVED} SELECT photo_id, piece_ord, code FROM resolved WHERE photo_id NOT IN ('p1', 'p2')")
def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = spark.range(2).select(F.concat(F.lit("p"), (F.col("id") + 1).cast("string")).alias("photo_id"))
    return library.without(resolve(A.pieces(spark, sf_dir)).select("photo_id", "piece_ord", "code"), gone)


@query("SELECT conv_id, turn, (k - 1)::INT AS det_ord, string_split(text, ' ')[k] AS text, ((k * 13) % 100)::DOUBLE / 100 AS score FROM (SELECT conv_id, turn, text, unnest(range(1, length(string_split(text, ' ')) + 1)) AS k FROM conversations)")
def payload_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognizer payloads in JSON, with a word in each find, taken apart."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    parts = F.split("text", " ")
    scores = F.transform(parts, lambda _, i: ((i + 1) * 13 % 100).cast("double") / 100)
    made = table.select("conv_id", "turn", F.to_json(F.struct(F.struct(parts.alias("rec_texts"), scores.alias("rec_scores")).alias("res"))).alias("payload"))
    return recognize.payload(made).select("conv_id", "turn", "det_ord", "text", "score")


def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, height, width, data): a dark photo for each 500 events, with six bright discs of sizes by event."""
    import numpy as np
    import pandas as pd

    def run(batches):
        y, x = np.mgrid[:240, :320]
        for batch in batches:
            rows = []
            for n in batch["n"]:
                image = np.full((240, 320, 3), 20, np.uint8)
                for k in range(6):
                    r = 20 + (n * 7 + k * 5) % 12
                    image[(x - 55 - 100 * (k % 3)) ** 2 + (y - 65 - 110 * (k // 3)) ** 2 <= r * r] = (235, 233, 228)
                rows.append((f"p{n}", 240, 320, image.tobytes()))
            yield pd.DataFrame(rows, columns=["photo_id", "height", "width", "data"])

    return A.photo_numbers(spark, sf_dir).mapInPandas(run, "photo_id string, height int, width int, data binary")


@query()
def segment_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn photos segmented into pieces, each with its crop's size."""
    from .plans.index import segment

    return segment(drawn(spark, sf_dir)).drop("data", "contour")


@query("""WITH discs AS (SELECT n, 55 + 100 * (k % 3) AS cx, 65 + 110 * (k // 3) AS cy, 20 + (n * 7 + k * 5) % 12 AS r FROM (SELECT DISTINCT event_id // 500 AS n FROM events), range(6) t(k))
SELECT 'p' || n AS photo_id, row_number() OVER (PARTITION BY n ORDER BY cy - r, cx - r) - 1 AS piece_id, (cx - r + 1)::INT AS x, (cy - r + 1)::INT AS y, (2 * r - 1)::INT AS w, (2 * r - 1)::INT AS h, 512 AS height, 512 AS width FROM discs""")
def segment_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order, boxes and crop sizes of segment_photos(): of each disc the single pixels at its four ends are smoothed away."""
    return segment_photos(spark, sf_dir).drop("area")


FLAT = "photo_id, row_number() OVER (PARTITION BY photo_id ORDER BY piece_ord) - 1 AS piece_ord, piece_id, (piece_ord % 900)::INT AS x, (piece_ord % 700)::INT AS y, (piece_ord % 90)::INT AS w, (piece_ord % 80)::INT AS h, (piece_ord % 1000)::DOUBLE AS area, code, confidence, raw_text, method, angle"


@query(f"WITH {A.RESOLVED}, named AS (SELECT photo_id, row_number() OVER (ORDER BY photo_id) AS photo_ord FROM (SELECT DISTINCT photo_id FROM resolved)) SELECT r.*, photo_ord FROM (SELECT {FLAT} FROM resolved) r JOIN named USING (photo_id)")
def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos exported to JSON files in order of their names, and the folder loaded."""
    folder = fresh_folder(spark, "json")
    library.export_json(photos_of(resolve(A.pieces(spark, sf_dir))).orderBy("photo_id"), folder)
    photos = library.load(spark, folder)
    return library.flat(photos).drop("contour").join(photos.select("photo_id", "photo_ord"), "photo_id")


@query(f"WITH {A.RESOLVED}, new AS (SELECT * FROM pieces WHERE photo_id IN ('p1', 'p3') AND piece_ord % 2 = 0) SELECT {FLAT} FROM (FROM resolved WHERE photo_id NOT IN ('p1', 'p2', 'p3') UNION ALL BY NAME FROM new)")
def library_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos saved to an index on disk, two of them saved again in another version, one deleted."""
    folder = fresh_folder(spark, "index")
    store.save(photos_of(resolve(A.pieces(spark, sf_dir))), folder)
    again = A.pieces(spark, sf_dir).where(F.col("photo_id").isin("p1", "p3") & (F.col("piece_ord") % 2 == 0))
    store.save(photos_of(again), folder)
    store.delete(spark, folder, "p2")
    return library.flat(store.open_index(spark, folder)).drop("contour")


@query(f"WITH {A.RESOLVED}, new AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY piece_ord) - 1 AS place FROM pieces WHERE photo_id IN ('p1', 'p3') AND piece_ord % 2 = 0), old AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY piece_ord) - 1 AS place FROM resolved WHERE photo_id NOT IN ('p1', 'p2', 'p3')) SELECT code, photo_id, place AS piece_ord FROM (SELECT code, photo_id, place FROM old UNION ALL SELECT code, photo_id, place FROM new) WHERE code <> ''")
def code_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of codes that library_save's index keeps beside its photos."""
    folder = fresh_folder(spark, "index")
    store.save(photos_of(resolve(A.pieces(spark, sf_dir))), folder)
    store.save(photos_of(A.pieces(spark, sf_dir).where(F.col("photo_id").isin("p1", "p3") & (F.col("piece_ord") % 2 == 0))), folder)
    store.delete(spark, folder, "p2")
    return store.current(spark, folder).codes()


@query(f"WITH {A.PIECES} SELECT photo_id, piece_ord, piece_id, code, confidence, method FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY piece_ord) AS rn FROM pieces WHERE code = 'A-101') WHERE rn = 1")
def find_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each photo's first piece of one code."""
    return lookup.first_by_position(A.pieces(spark, sf_dir).drop("raw_text", "angle"), " a-101 ")


@query(f"WITH {A.PIECES} SELECT count(DISTINCT photo_id)::BIGINT AS photos, count(*)::BIGINT AS total, count(*) FILTER (WHERE code <> '')::BIGINT AS recognized, count(*) FILTER (WHERE coalesce(code, '') = '')::BIGINT AS unrecognized, round(count(*) FILTER (WHERE code <> '') / count(*), 4) AS rate FROM pieces")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.pieces(spark, sf_dir)
    return lookup.library_totals(lookup.photo_stats(rows.select("photo_id").distinct(), rows))


@query(f"""WITH {A.RESOLVED}, m AS (SELECT method, count(*) AS n FROM resolved GROUP BY 1)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE code <> '')::BIGINT AS recognized, round(count(*) FILTER (WHERE code <> '') / count(*), 4) AS rate, 12.3::DOUBLE AS seconds, round(12.34 / count(*), 3) AS seconds_per_piece,
  array_to_string(list_sort(list(code) FILTER (WHERE code <> '')), ' ') AS codes, (SELECT string_agg(method || '=' || n, ' ' ORDER BY method) FROM m) AS methods, format('{{:.1f}}%', 100.0::DOUBLE * count(*) FILTER (WHERE code <> '') / count(*)) AS shown FROM resolved""")
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report of a run of 12.34 seconds, read back."""
    kinds = "total bigint, recognized bigint, rate double, shown string, seconds double, seconds_per_piece double, methods map<string, bigint>, codes array<string>"
    made = report.benchmark_report(resolve(A.pieces(spark, sf_dir)), 12.34).select(F.from_json("report", kinds).alias("r")).select("r.*")
    entries = F.transform(F.array_sort(F.map_entries("methods")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return made.withColumns({"codes": F.array_join("codes", " "), "methods": F.array_join(entries, " ")})


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 08:30:00') AS shown FROM orders")
def display_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'08:30:00")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.display_date(iso).alias("shown"))


@query("""WITH photos AS (SELECT DISTINCT event_id // 500 AS n FROM events), discs AS (SELECT n, k, 55 + 100 * (k % 3) AS cx, 65 + 110 * (k // 3) AS cy, 20 + (n * 7 + k * 5) % 12 AS r FROM photos, range(6) t(k))
SELECT 'p' || n AS photo_id, 'crops/00' || k AS name, 512 AS height, 512 AS width FROM discs
UNION ALL SELECT 'p' || n, name, 240, 320 FROM photos, (SELECT unnest(['01_mask', '02_blobs', '03_split']) AS name)""")
def calibration_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of the calibration pictures of the drawn photos."""
    from .plans.calibrate import artefacts

    return artefacts(drawn(spark, sf_dir)).drop("png")


#: The grids' pixels as tiles of three by three: most components and ways cross borders of tiles.
GRID = 3


@query(f"""WITH RECURSIVE {A.PIXELS}, lit AS (SELECT image, y, x, y * 8 + x AS p FROM pixels WHERE v > 127),
reach AS (SELECT image, p, p AS s FROM lit UNION SELECT r.image, l.p, r.s FROM reach r JOIN lit l ON l.image = r.image AND abs(l.y - r.p // 8) <= 1 AND abs(l.x - r.p % 8) <= 1 AND l.p > r.s),
owner AS (SELECT image, p, min(s) AS s FROM reach GROUP BY ALL)
SELECT image, (s // 8)::INT AS first_y, (s % 8)::INT AS first_x, count(*)::BIGINT AS n, min(p % 8)::INT AS x, min(p // 8)::INT AS y, (max(p % 8) - min(p % 8) + 1)::INT AS w, (max(p // 8) - min(p // 8) + 1)::INT AS h FROM owner GROUP BY image, s""")
def tile_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the grids' bright pixels, the grids being cut into tiles."""
    cells = tiles.stored(tiles.cut(A.pixels(spark, sf_dir), (F.col("v") > 127).cast("int"), side=GRID), "cells")
    first = F.col("component")
    return tiles.component_table(cells, GRID).select("image", tiles.spot_y(first).alias("first_y"), tiles.spot_x(first).alias("first_x"), "n", "x", "y", "w", "h")


#: The chamfer distance of a pixel (y, x) to another (b, a), whose shortest way keeps to the rectangle between them.
AWAY = "CASE WHEN 2 * least(abs(y - b), abs(x - a)) <= greatest(abs(y - b), abs(x - a)) THEN 21969 * least(abs(y - b), abs(x - a)) + 10000 * (greatest(abs(y - b), abs(x - a)) - 2 * least(abs(y - b), abs(x - a))) ELSE 21969 * (greatest(abs(y - b), abs(x - a)) - least(abs(y - b), abs(x - a))) + 14000 * (2 * least(abs(y - b), abs(x - a)) - greatest(abs(y - b), abs(x - a))) END"


@query(f"WITH {A.PIXELS}, dark AS (SELECT image, y AS b, x AS a FROM pixels WHERE v <= 60) SELECT image, y, x, CASE WHEN v <= 60 THEN 0 ELSE coalesce(min({AWAY}), 0) END::BIGINT AS depth FROM pixels LEFT JOIN dark USING (image) GROUP BY image, y, x, v")
def tile_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each of the grids' pixels to the nearest dark one, the grids being cut into tiles."""
    cells = tiles.stored(tiles.cut(A.pixels(spark, sf_dir), (F.col("v") > 60).cast("int"), side=GRID), "cells")
    return tiles.pixels_of(tiles.distances(cells, GRID), "depth", GRID)


def touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, v): for each 500 events 64 x 96 pixels with a row of one to three overlapping discs and a single one below."""
    n, y, x = F.col("image"), F.col("y"), F.col("x")
    r = 9 + n % 4
    # Dealt by image while they are numbers: cutting then needs no shuffle of pixels.
    grid = A.dealt(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / 500).alias("image")).distinct(), 4 * A.PHOTOS, "image")
    grid = grid.select("image", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("y")).select("image", "y", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("x"))
    disc = lambda cy, cx, r: (y - cy) * (y - cy) + (x - cx) * (x - cx) <= r * r
    on = disc(48, 14 + n % 30, 8)
    for k in range(3):
        on = on | ((n % 3 >= k) & disc(20, 14 + k * (2 * r - 2), r))
    return grid.select("image", "y", "x", on.cast("int").alias("v"))


@query("""WITH photos AS (SELECT DISTINCT event_id // 500 AS image FROM events)
SELECT image, (11 - image % 4)::INT AS y, 14 AS x, (image % 3 + 1)::BIGINT AS peaks FROM photos UNION ALL SELECT image, 40, (14 + image % 30)::INT, 1 FROM photos""")
def tile_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peaks of blobs of overlapping discs, as many as discs; a blob is told by its first pixel."""
    cells = tiles.stored(tiles.cut(touching(spark, sf_dir), F.col("v"), side=32), "cells")
    first = F.col("component")
    return tiles.peaks(cells, 32).select("image", tiles.spot_y(first).alias("y"), tiles.spot_x(first).alias("x"), "peaks")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, height, width, data): a dark photo for each 500 events, with five bright discs and two that touch."""
    import numpy as np
    import pandas as pd

    def run(batches):
        y, x = np.mgrid[:240, :320]
        for batch in batches:
            rows = []
            for n in batch["n"]:
                image, r = np.full((240, 320, 3), 20, np.uint8), 16 + n % 6
                for cy, cx in [(60, 60), (60, 160), (60, 260), (170, 60), (170, 260), (130, 160 - r + 2), (130, 160 + r - 2)]:
                    image[(x - cx) ** 2 + (y - cy) ** 2 <= r * r] = (235, 233, 228)
                rows.append((f"p{n}", 240, 320, image.tobytes()))
            yield pd.DataFrame(rows, columns=["photo_id", "height", "width", "data"])

    return A.photo_numbers(spark, sf_dir).mapInPandas(run, "photo_id string, height int, width int, data binary")


@query("""WITH photos AS (SELECT DISTINCT event_id // 500 AS n, 16 + event_id // 500 % 6 AS r FROM events),
found AS (SELECT n, cx - r + 1 AS x, cy - r + 1 AS y, 2 * r - 1 AS w, 2 * r - 1 AS h FROM photos, (VALUES (60, 60), (60, 160), (60, 260), (170, 60), (170, 260)) t(cy, cx)
  UNION ALL SELECT n, 160 - 2 * r + 3, 131 - r, 2 * r - 2, 2 * r - 1 FROM photos UNION ALL SELECT n, 161, 131 - r, 2 * r - 3, 2 * r - 1 FROM photos)
SELECT 'p' || n AS photo_id, row_number() OVER (PARTITION BY n ORDER BY y, x) - 1 AS piece_id, x::INT AS x, y::INT AS y, w::INT AS w, h::INT AS h FROM found""")
def split_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of photos in which two of seven discs touch: these are cut apart half way between their centres."""
    from .plans.index import segment

    return segment(pairs(spark, sf_dir)).select("photo_id", "piece_id", "x", "y", "w", "h")


@query(f"""WITH {CODES}, discs AS (SELECT n, k, (n * 131 + k % 5 * 37) % 1000 + 1 AS number, 55 + 100 * (k % 3) AS cx, 65 + 110 * (k // 3) AS cy, 20 + (n * 7 + k * 5) % 12 AS r FROM (SELECT DISTINCT event_id // 500 AS n FROM events), range(6) t(k)),
seen AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY cy - r, cx - r) - 1 AS piece_id, c.code AS real FROM discs JOIN codes c USING (number)),
told AS (SELECT *, CASE WHEN number % 25 <> 0 THEN row_number() OVER (PARTITION BY n, number ORDER BY piece_id) END AS rn FROM seen)
SELECT 'p' || n AS photo_id, '2026-01-01T10:00:00' AS created_at, piece_id::INT AS piece_id, (cx - r + 1)::INT AS x, (cy - r + 1)::INT AS y, (2 * r - 1)::INT AS w, (2 * r - 1)::INT AS h, CASE WHEN rn = 1 THEN real END AS code,
  CASE WHEN rn = 1 THEN CASE WHEN number % 9 <> 0 THEN 0.95 ELSE 0.6 END ELSE 0 END::DOUBLE AS confidence, CASE WHEN rn IS NOT NULL THEN CASE WHEN number % 7 = 0 THEN lower(left(real, 1)) || number ELSE real END END AS raw_text,
  CASE WHEN rn = 1 THEN 'direct' WHEN rn > 1 THEN 'conflict' ELSE 'none' END AS method, CASE WHEN rn IS NOT NULL THEN 0 END AS angle FROM told""")
def build_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of pieces whose colours tell their codes, indexed whole: segmented, cropped, read in passes by a recognizer, matched, made unique."""
    from .plans.index import build_index

    photos = build_index(A.coded_photos(spark, sf_dir), A.DrawnCodes, "2026-01-01T10:00:00")
    rows = library.flat(photos, "created_at")
    return rows.select("photo_id", "created_at", "piece_id", "x", "y", "w", "h", "code", "confidence", "raw_text", "method", "angle")


@query(f"""WITH {A.PIECES}, versions AS (SELECT photo_id, v, CASE WHEN v * 7 % 3 <> 0 OR photo_id < 'p2' THEN format('2026-01-0{{}}T10:00:00', (v + length(photo_id) * 2 + ascii(right(photo_id, 1))) % 4 + 1) END AS created_at FROM (SELECT DISTINCT photo_id FROM pieces), range(3) t(v)),
newest AS (SELECT photo_id, arg_max(v, coalesce(created_at, '')) AS v, max(created_at) AS created_at FROM versions GROUP BY 1)
SELECT photo_id, n.created_at, count(*)::BIGINT AS n, count(DISTINCT code) FILTER (WHERE code <> '')::BIGINT AS codes, min(piece_id)::INT AS first_piece FROM newest n JOIN pieces USING (photo_id) WHERE piece_ord % 3 = v GROUP BY ALL""")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of photos from a stream of files, three batches in which newer ones may come first: the index ends with the newest of each."""
    from .streaming.upsert import follow

    folder = fresh_folder(spark, "stream")
    rows = A.pieces(spark, sf_dir)
    kinds = None
    for v in range(3):
        number = (v + F.length("photo_id") * 2 + F.ascii(F.right("photo_id", F.lit(1)))) % 4 + 1
        at = F.when(F.lit(v * 7 % 3 != 0) | (F.col("photo_id") < "p2"), F.format_string("2026-01-0%dT10:00:00", number))
        batch = photos_of(rows.where(F.col("piece_ord") % 3 == v)).withColumn("created_at", at)
        batch.write.parquet(f"{folder}/in/v{v}")
        kinds = batch.schema
    for v in range(3):
        stream = spark.readStream.schema(kinds).parquet(f"{folder}/in/v{v}")
        follow(stream, f"{folder}/index", f"{folder}/checkpoint{v}").awaitTermination()
    photos = store.open_index(spark, f"{folder}/index")
    found = library.flat(photos).groupBy("photo_id").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("code") != "", F.col("code"))).alias("codes"), F.min("piece_id").alias("first_piece"))
    return photos.select("photo_id", "created_at").join(found, "photo_id")


@query(f"""WITH {A.DETECTIONS}, quads AS (SELECT photo_id, piece_id, det_ord, (piece_id % 50)::DOUBLE AS x, 40 + piece_id % 50 % 7 AS r, 15 + piece_id % 50 % 60 AS d FROM detections WHERE quad),
crossed AS (SELECT *, (r * 15 - 0 * -r)::DOUBLE / (40 * 15 - d * -r)::DOUBLE AS t FROM quads)
SELECT photo_id, piece_id, det_ord, floor((x + t * 40) * 1000 + 0.1234567)::BIGINT AS centre_x, floor((x + t * d) * 1000 + 0.1234567)::BIGINT AS centre_y, floor(x * 1000 + 0.1234567)::BIGINT AS corner_x, floor((x + 15) * 1000 + 0.1234567)::BIGINT AS corner_y FROM crossed""")
def quad_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the perspective map of each detection's quad takes the centre of its upright rectangle, which is where the quad's diagonals cross, and the lower left corner."""
    found = A.detections(spark, sf_dir).where(F.col("poly").isNotNull())
    size = geometry.quad_size(F.col("poly"))
    placed = found.withColumn("size", size).withColumn("by", geometry.homography(F.col("poly"), F.col("size.w"), F.col("size.h")))
    centre, corner = geometry.mapped(F.col("by"), F.col("size.w") / 2, F.col("size.h") / 2), geometry.mapped(F.col("by"), F.lit(0), F.col("size.h"))
    whole = lambda c: F.floor(c * 1000 + 0.1234567)
    return placed.select("photo_id", "piece_id", "det_ord", whole(centre["x"]).alias("centre_x"), whole(centre["y"]).alias("centre_y"), whole(corner["x"]).alias("corner_x"), whole(corner["y"]).alias("corner_y"))


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, piece_id, contour, thickness, unknown): for each of the grids none to two polygons of five points, some with crossing sides, some beyond the grid."""
    images = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image"))
    rows = images.select("image", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("piece_id")).where("piece_id < image % 3")
    corner = lambda k, m: ((F.col("image") * (k + 3) + F.col("piece_id") * 5 + k * 7) % m - 1).cast("int")
    return rows.select("image", "piece_id", F.array(*[F.array(corner(k, 10), corner(k + 5, 11)) for k in range(5)]).alias("contour"), (F.col("image") % 2 + 1).cast("int").alias("thickness"), (F.col("image") % 5 == 0).alias("unknown"))


SIDES = """corners AS (SELECT vec_id AS image, piece_id, k, (vec_id * (k + 3) + piece_id * 5 + k * 7) % 10 - 1 AS x, (vec_id * (k + 8) + piece_id * 5 + (k + 5) * 7) % 11 - 1 AS y FROM embeddings, range(2) p(piece_id), range(5) t(k) WHERE piece_id < vec_id % 3),
  sides AS (SELECT a.image, a.piece_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, greatest(abs(b.x - a.x), abs(b.y - a.y), 1) AS n FROM corners a JOIN corners b ON a.image = b.image AND a.piece_id = b.piece_id AND b.k = (a.k + 1) % 5),
  inside AS (SELECT image, piece_id, q.y, q.x FROM sides, (SELECT y, x FROM range(8) a(y), range(8) b(x)) q WHERE q.y >= least(ay, by_) AND q.y < greatest(ay, by_) AND q.x >= ax + ((q.y - ay) * (bx - ax))::DOUBLE / (by_ - ay) GROUP BY ALL HAVING count(*) % 2 = 1),
  walked AS (SELECT image, piece_id, i, floor((2 * (ax * n + i * (bx - ax)) + n) / (2 * n)::DOUBLE)::BIGINT AS x, floor((2 * (ay * n + i * (by_ - ay)) + n) / (2 * n)::DOUBLE)::BIGINT AS y FROM (SELECT *, unnest(range(n + 1)) AS i FROM sides)),
  shaped AS (SELECT image, piece_id, y, x FROM inside UNION SELECT image, piece_id, y, x FROM walked),
  band AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM walked, range(2) a(dy), range(2) b(dx) WHERE dy <= image % 2 AND dx <= image % 2)"""


@query(f"""WITH {A.PIXELS}, {SIDES}, lit AS (SELECT DISTINCT image, y, x FROM shaped)
SELECT p.image, p.y, p.x, c.level AS channel, CASE WHEN b.x IS NOT NULL THEN CASE WHEN p.image % 5 = 0 THEN [255, 255, 0][c.level + 1] ELSE [255, 0, 255][c.level + 1] END WHEN l.x IS NOT NULL THEN (v + c.level * 11) % 256 ELSE trunc((v + c.level * 11) % 256 * 0.45::DOUBLE) END::INT AS v
FROM pixels p, (SELECT unnest([0, 1, 2]) AS level) c LEFT JOIN lit l ON l.image = p.image AND l.y = p.y AND l.x = p.x LEFT JOIN band b ON b.image = p.image AND b.y = p.y AND b.x = p.x""")
def highlight_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids in three colours, dimmed but for their polygons, which get outlines: every level of every pixel."""
    level = lambda k: ((F.col("v") + k * 11) % 256).alias("bgr"[k])
    lit = polygons.highlighted(A.pixels(spark, sf_dir).select("image", "y", "x", *map(level, range(3))), shapes(spark, sf_dir))
    return lit.select("image", "y", "x", F.posexplode(F.array("b", "g", "r")).alias("channel", "v"))


#: One axis of the grids resampled: what share of pixel j goes to pixel i of n.
SHARES = """weights AS (
    SELECT n, TRUE AS shrink, i, j, least((i + 1) * 8, (j + 1) * n) - greatest(i * 8, j * n) AS w FROM range(1, 24) s(n), range(23) a(i), range(8) b(j) WHERE i < n AND least((i + 1) * 8, (j + 1) * n) > greatest(i * 8, j * n)
    UNION ALL SELECT n, FALSE, i, greatest(0, least(7, base + k)), CASE k WHEN -1 THEN w0 WHEN 0 THEN 1048576 - w0 - w2 - w3 WHEN 1 THEN w2 ELSE w3 END FROM (
      SELECT n, i, base, round_even(1048576 * (((-0.75::DOUBLE * (f + 1) + 3.75::DOUBLE) * (f + 1) - 6) * (f + 1) + 3), 0)::BIGINT AS w0, round_even(1048576 * ((1.25::DOUBLE * (1 - f) - 2.25::DOUBLE) * (1 - f) * (1 - f) + 1), 0)::BIGINT AS w2, round_even(1048576 * (((-0.75::DOUBLE * (2 - f) + 3.75::DOUBLE) * (2 - f) - 6) * (2 - f) + 3), 0)::BIGINT AS w3
      FROM (SELECT n, i, floor(((2 * i + 1) * 8 - n)::DOUBLE / (2 * n))::BIGINT AS base, ((2 * i + 1) * 8 - n)::DOUBLE / (2 * n) - floor(((2 * i + 1) * 8 - n)::DOUBLE / (2 * n)) AS f FROM range(1, 24) s(n), range(23) a(i) WHERE i < n)), range(-1, 3) c(k))"""


@query(f"""WITH {A.PIXELS}, {SHARES}, sized AS (SELECT *, 3 + image % 17 AS tall, 2 + image % 19 AS wide, (3 + image % 17) * (2 + image % 19) < 64 AS small FROM pixels),
across AS (SELECT image, tall, small, y, i AS x, sum(v * w) AS v FROM sized JOIN weights ON n = wide AND shrink = small AND j = x GROUP BY ALL),
down AS (SELECT image, small, i AS y, x, sum(v * w) AS v FROM across JOIN weights ON n = tall AND shrink = small AND j = y GROUP BY image, small, i, x)
SELECT image, y::INT AS y, x::INT AS x, greatest(0, least(255, round_even(v::DOUBLE / CASE WHEN small THEN 64 ELSE 1099511627776 END, 0)))::INT AS v FROM down""")
def resample_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grids in 323 other sizes, smaller by area and larger by cubic weights."""
    image = F.col("image")
    sizes = {"height": F.lit(8), "width": F.lit(8), "to_height": 3 + image % 17, "to_width": 2 + image % 19}
    return pixels.resampled(A.pixels(spark, sf_dir).withColumns(sizes))


@query(f"""WITH {A.BOXES}, sized AS (SELECT *, 320 + piece_ord % 900 AS vw, 240 + piece_ord % 700 AS vh, 1 + piece_ord % 9 * 0.25::DOUBLE AS factor FROM boxes),
fit AS (SELECT *, least(vw / 4000::DOUBLE, vh / 3000::DOUBLE) AS s0 FROM sized),
zoom AS (SELECT *, s0 * factor AS s1, vw / 3::DOUBLE - (vw / 3::DOUBLE - (vw - 4000 * s0) / 2) * factor AS tx1, vh / 4::DOUBLE - (vh / 4::DOUBLE - (vh - 3000 * s0) / 2) * factor AS ty1 FROM fit),
mid AS (SELECT *, least(6::DOUBLE, greatest(s1, vh / (h * 5)::DOUBLE)) AS s2 FROM zoom)
SELECT piece_ord, floor(s0 * 1e6 + 0.1234567)::BIGINT AS fit_scale, floor((s1 * x + tx1) * 1000 + 0.1234567)::BIGINT AS zoom_x, floor((s1 * y + ty1) * 1000 + 0.1234567)::BIGINT AS zoom_y, floor(s2 * 1e6 + 0.1234567)::BIGINT AS centre_scale, floor((vw / 2::DOUBLE + (0 - w / 2::DOUBLE) * s2) * 1000 + 0.1234567)::BIGINT AS centre_x, floor((vh / 2::DOUBLE + (0 - h / 2::DOUBLE) * s2) * 1000 + 0.1234567)::BIGINT AS centre_y FROM mid""")
def view_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a box's corner is shown when its photo is fitted into a window and then enlarged about a point, and when the box is centred."""
    e = F.col("piece_ord")
    sized = A.boxes(spark, sf_dir).withColumns({"vw": 320 + e % 900, "vh": 240 + e % 700, "factor": 1 + (e % 9) * F.lit(0.25)})
    vw, vh = F.col("vw"), F.col("vh")
    fit = sized.withColumn("fit", geometry.fitted(vw, vh, F.lit(4000), F.lit(3000)))
    zoom = fit.withColumn("zoom", geometry.zoomed(F.col("fit"), vw / 3, vh / 4, F.col("factor")))
    views = zoom.withColumn("mid", geometry.centred(F.col("zoom"), *[F.col(c) for c in "xywh"], vw, vh))
    at, mid = (geometry.shown(F.col(v), F.col("x"), F.col("y")) for v in ("zoom", "mid"))
    whole = lambda c, m: F.floor(c * m + 0.1234567)
    return views.select("piece_ord", whole(F.col("fit.scale"), 1e6).alias("fit_scale"), whole(at["x"], 1000).alias("zoom_x"), whole(at["y"], 1000).alias("zoom_y"), whole(F.col("mid.scale"), 1e6).alias("centre_scale"), whole(mid["x"], 1000).alias("centre_x"), whole(mid["y"], 1000).alias("centre_y"))
