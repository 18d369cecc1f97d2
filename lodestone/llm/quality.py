"""Quality rules: base statistics, and robust multivariate outliers for each language and source."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free, let, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Places of words are packed below their windows' hashes in so many bits; longer texts sort pairs.
PLACE_BITS = 21
#: Dimensions of the vector and the least standard deviation of each, in its own unit.
FLOORS = (0.25, 0.02, 0.1, 0.1, 0.1)
NAMES = ("log_words", "log_word_length", "symbols", "dup_lines", "repeats")
P = len(FLOORS)
#: Steps of squared distances for ranking: so many to a doubling.
STEPS = 64


def repeated_words(found: Column) -> Column:
    """Words of the array that lie in 3-word windows that the array holds twice or more, each counted once."""
    mask = (1 << PLACE_BITS) - 1
    n = F.size(found)

    def covered(places: Column) -> Column:
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n"), p.alias("last"))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), step)["n"]

    def packed(windows: Column) -> Column:
        high = lambda x: F.shiftright(x, PLACE_BITS)
        place = lambda x: x.bitwiseAND(F.lit(mask)).cast("int")
        same = lambda x, y: F.coalesce((high(x) == high(y)) & (F.get(windows, place(x)) == F.get(windows, place(y))), F.lit(False))
        order = F.sort_array(F.transform(windows, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))))
        return let(order, lambda o: covered(F.sort_array(F.transform(F.filter(o, lambda x, k: same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1))), place))))

    def paired(windows: Column) -> Column:
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        order = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(order, lambda o: covered(F.sort_array(F.transform(F.filter(o, lambda x, k: same(x, F.get(o, k - 1)) | same(x, F.get(o, k + 1))), lambda x: x["i"]))))

    def counted(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(windows, lambda h: F.when(F.size(h) <= mask, packed(h)).otherwise(paired(h)))

    return F.when(n >= 3, counted(found)).otherwise(F.lit(0)).cast("long")


def statistics(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines, all long; null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    bare = F.translate(text, SPACES, "")
    chars = F.length(bare).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    rows = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(counts.alias("c"), rows.alias("r"), chars.alias("word_chars"), symbols.cast("long").alias("n_symbols"))


def measure(docs: DataFrame, text_col: str = "text", to: str = "_quality") -> DataFrame:
    """``docs`` with a struct column ``to`` of statistics and base_failed, in place of any of that name."""
    s = statistics(F.col(text_col))

    def flat(x: Column) -> Column:
        n, repeats = x["c"]["n_words"], x["c"]["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * repeats > 50 * n)
        return F.struct(n.alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"), x["r"]["n_dup_lines"].alias("n_dup_lines"), repeats.alias("n_repeat_words"), x["r"]["lines"].alias("lines"), failed.alias("base_failed"))

    return docs.withColumn(to, let(s, flat))


def vector(quality: str) -> list[str]:
    """SQL of the transformed statistics of a column: logarithms of sizes, and square roots of rates, which spread small rates."""
    q = f"`{quality}`"
    n = f"CAST(greatest({q}.n_words, 1) AS DOUBLE)"
    return [f"ln({n})", f"ln(greatest({q}.word_chars, 1) / {n})", f"sqrt({q}.n_symbols / {n})", f"sqrt({q}.n_dup_lines / greatest({q}.lines, 1))", f"sqrt({q}.n_repeat_words / {n})"]


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = 1 / a
    i = 0
    while term > total * 1e-16:
        i += 1
        term *= y / (a + i)
        total += term
    return min(1.0, total * math.exp(a * math.log(y) - y - math.lgamma(a)))


def chi2_quantile(p: float, k: int) -> float:
    """Its inverse, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


# The formulas below are SQL texts: as chains of Column calls, building them took longer than the jobs on small tables.
X = [f"x{i}" for i in range(P)]
MEANS = [f"m{i}" for i in range(P)]
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]
FACTOR = [f"l{i}{j}" for i, j in LOWER]
SUMS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in LOWER]]


def _distance(x: list[str], g: str) -> Column:
    """Squared Mahalanobis distance by forward substitution with the mean and Cholesky factor in struct ``g``."""
    z: list[str] = []
    for i in range(P):
        rest = "".join(f" - `{g}`.l{i}{j} * {z[j]}" for j in range(i))
        z.append(f"(({x[i]} - `{g}`.m{i}{rest}) / `{g}`.l{i}{i})")
    return F.expr(" + ".join(f"{v} * {v}" for v in z))


def _factored(moments: DataFrame, factor: float) -> DataFrame:
    """(grp, m*, l*) from sums: mean, and the Cholesky factor of factor times the covariance plus the squared floors.

    Columns refer to earlier ones of the same list.
    """
    out = [f"s{i} / n AS m{i}" for i in range(P)]
    for j in range(P):
        for i in range(j, P):
            cov = f"{factor!r}D * (s{i}{j} / n - m{i} * m{j})"
            if i == j:
                cov = f"greatest({cov}, 0D) + {FLOORS[i] ** 2!r}D"
            cov += "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"sqrt(greatest({cov}, 1e-12D)) AS l{i}{i}" if i == j else f"({cov}) / l{j}{j} AS l{i}{j}")
    return moments.selectExpr("grp", *out).select("grp", *MEANS, *FACTOR)


def _sums() -> list[Column]:
    return [F.expr(f"{what} AS {name}") for name, what in zip(SUMS, ["count(*)", *[f"sum({x})" for x in X], *[f"sum({X[i]} * {X[j]})" for i, j in LOWER]], strict=True)]


#: Tables of groups of up to so many rows (of some 200 bytes) are broadcast; larger ones are joined by shuffle.
BROADCAST_GROUPS = 50_000


def fit(rows: DataFrame, groups: int, share: float = 0.75, steps: int = 4) -> DataFrame:
    """(grp, m*, l*): minimum-covariance-determinant estimates of the vectors x0 to x4 of each group.

    Starts from coordinate-wise medians and median deviations. A concentration step takes, of each
    group, the ``share`` of rows with the least distances, and their mean and covariance; it never
    raises the covariance's determinant. Distances are ranked in steps of 2**(1/STEPS), ties
    within a step going in together, so that a step moves only sums for each group and step: no
    group is gathered. ``steps`` steps are taken, which is some more than it takes until rows hardly
    change sides. At last the rows within the 97.5 % quantile are taken, as usual.
    Covariances are scaled to be consistent for normal data; floors on the diagonal keep
    statistics that hardly vary from making them singular.
    """
    hint = F.broadcast if groups <= BROADCAST_GROUPS else lambda t: t
    middle = rows.groupBy("grp").agg(*[F.expr(f"percentile_approx(x{i}, 0.5) AS m{i}") for i in range(P)])
    apart = [F.expr(f"percentile_approx(abs(x{i} - m{i}), 0.5) AS d{i}") for i in range(P)]
    spread = rows.join(hint(middle), "grp").groupBy("grp").agg(*[F.expr(f"first({m}) AS {m}") for m in MEANS], *apart)
    start = [f"sqrt(pow(1.4826D * d{i}, 2) + {FLOORS[i] ** 2!r}D) AS l{i}{i}" if i == j else f"0D AS l{i}{j}" for i, j in LOWER]
    now = stored(spread.selectExpr("grp", *MEANS, *start), "mcd", groups)
    raw = share / chi2_cdf(chi2_quantile(share, P), P + 2)
    edge = chi2_quantile(0.975, P)

    def beside(models: DataFrame) -> DataFrame:
        """The rows, each with its group's model as a struct ``g``."""
        return rows.join(hint(models.select("grp", F.struct(*MEANS, *FACTOR).alias("g"))), "grp")

    for _ in range(steps):
        step = F.floor(STEPS * F.log2(_distance(X, "g") + 1e-3)).cast("int")
        parts = beside(now).withColumn("step", step).groupBy("grp", "step").agg(*_sums())
        below = "coalesce(sum(n) OVER (PARTITION BY grp ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below"
        taken = parts.selectExpr("*", below, "sum(n) OVER (PARTITION BY grp) AS all").where(f"below < ceil({share!r}D * all)")
        now = stored(_factored(taken.groupBy("grp").agg(*[F.sum(c).alias(c) for c in SUMS]), raw), "mcd", groups)
    near = beside(now).where(_distance(X, "g") <= edge).groupBy("grp").agg(*_sums())
    final = _factored(near, 0.975 / chi2_cdf(edge, P + 2))
    # A group without a near row keeps its model.
    model = F.struct(*MEANS, *FACTOR)
    found = now.select("grp", model.alias("own")).join(hint(final.select("grp", model.alias("last"))), "grp", "left")
    return stored(found.select("grp", F.coalesce("last", "own").alias("g")).select("grp", "g.*"), "mcd", groups)


def grouped(measured: DataFrame, lang_col: str, source_col: str, quality: str, least: int) -> tuple[DataFrame, int]:
    """(key, grp) of each language and source, and how many groups: pairs with under ``least`` rows that pass the base
    rules are pooled by language, and languages whose pool is that small in one pool."""
    counts = measured.where(~F.col(f"{quality}.base_failed")).groupBy(_key(lang_col, source_col).alias("key"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")).count()
    own = F.col("count") >= least
    pools = counts.where(~own).groupBy("lang").agg(F.sum("count").alias("pool"))
    named = counts.join(pools, "lang", "left")
    grp = F.when(own, F.concat(F.lit("="), F.col("key"))).when(F.col("pool") >= least, F.concat(F.lit("~"), F.col("lang"))).otherwise(F.lit("*"))
    table = stored(named.select("key", grp.alias("grp")), "groups", 1 << 17)
    return table, table.count()


def _key(lang_col: str, source_col: str) -> Column:
    part = lambda c: F.coalesce(F.to_json(F.struct(F.col(c).cast("string").alias("v"))), F.lit("{}"))
    return F.concat(part(lang_col), part(source_col))


def judge(measured: DataFrame, lang_col: str = "lang", source_col: str = "source", quality: str = "_quality", to: str = "_kept", least: int = 100, tail: float = 1e-7) -> DataFrame:
    """``measured`` with a boolean column ``to``: false for rows that fail the base rules or are outliers.

    Rows that pass the base rules are fitted by language and source (nulls being values of their
    own; see grouped() for small groups) and kept up to the 1 - ``tail`` quantile of the
    chi-squared distribution of squared distances. ``measured`` comes from measure() and is read
    several times, so it should be stored. Repeated rows stay; an empty table gives none.
    """
    table, n = grouped(measured, lang_col, source_col, quality, least)
    hint = F.broadcast if n <= BROADCAST_GROUPS else lambda t: t
    q = F.col(quality)
    x = vector(quality)
    passed = measured.where(~q["base_failed"])
    rows = passed.select(_key(lang_col, source_col).alias("key"), *[F.expr(v).alias(name) for name, v in zip(X, x, strict=True)]).join(hint(table), "key").select("grp", *X)
    models = fit(rows, n)
    by_key = table.join(models, "grp").drop("grp")
    k, g = free(measured, "_k"), free(measured, "_g")
    packed = stored(by_key.select(F.col("key").alias(k), F.struct(*[c for c in by_key.columns if c != "key"]).alias(g)), "models", n)
    joined = measured.withColumn(k, _key(lang_col, source_col)).join(hint(packed), k, "left")
    ok = ~q["base_failed"] & F.coalesce(_distance(x, g) <= chi2_quantile(1 - tail, P), F.lit(True))
    return joined.withColumn(to, ok).drop(k, g)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that measure() and judge() keep, with the columns of ``docs``; their statistics are stored with them."""
    q, kept = free(docs, "_quality"), free(docs, "_kept")
    measured = stored(measure(docs, text_col, q), "measured")
    return judge(measured, lang_col, source_col, q, kept).where(F.col(kept)).select(*docs.columns)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 3 over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    measured = stored(measure(docs).select("doc_id", "lang", "source", "_quality"), "quality")
    found = judge(measured)
    return found.select("doc_id", *[f"_quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], F.col("_kept").alias("kept"))
