"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source. DataFrame functions only.

Each document gives word and line statistics. Their transformed vector is the log of the mean word length and the logs of
symbols a character, repeated lines a line and repeated words a word, each count with a half added. Clean text has none of the
last three, which would leave a scatter without a determinant. A count of n stands for what lies between n and n + 1, so each
row brings the variance that the log has over that interval, and a scatter is its rows' covariance and the mean of these: it has
a spread in all directions, and no number is drawn, so a row's verdict hangs on its text and its group alone.

Estimates follow deterministic MCD: three starts (median and MAD; correlation of tanh scores; spatial signs) take a
concentration step each ("take the 75 % of rows with the least Mahalanobis distance, re-estimate"), the start of the least
determinant goes on, and a group is done once a step no longer lowers its determinant. A step is one aggregate with map-side
partial sums: a histogram of log distances (about 1 % wide cells, so runs repeat) whose cells carry the sums of their rows; those
within are added up. So a step is one small table written, and the driver plans few and narrow queries.
A hot group is no task of its own. Groups are estimated by language and source, by language, and over the corpus; each
level is shrunk toward the next by n / (n + SHRINK), the corpus toward a fixed prior by n / (n + P + 1): small groups
count by their size, without a switch.

Defined cases: null text has no words and fails the base rules; null lang or source is a group of its own; equal texts have
equal vectors, ties in distance fall on the same side; an empty table gives no rows; extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalode.llm._support import materialise

SEPARATORS = " \t\n\x0b\f\r"
P = 4
H = 0.75
#: H / P(chi2 with P + 2 degrees <= the H quantile of chi2 with P): makes the scatter consistent at normal data.
CONSISTENCY = 1.4863
#: The 0.9995 quantile of chi2 with P degrees of freedom.
CUTOFF = 19.997
#: Rows at which a group weighs as much as the level above it.
SHRINK = 100
#: Deviations that a corpus of a few rows is shrunk to.
PRIOR = (0.1, 1.0, 1.0, 1.0)
#: A step goes on where it lowers the log of the determinant by this much.
IMPROVES = 1e-4
#: Cells a unit of the histograms that quantiles come from.
CELLS = 64
_INDEX_BITS = 31
#: Counts of the vector and what they are counted of.
_RATES = (("n_symbols", "word_chars"), ("n_dup_lines", "__n_lines"), ("n_repeat_words", "n_words"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SEPARATORS))) > 0)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text (null: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SEPARATORS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    one = docs.withColumns({"__w": words, "__l": _lines(text)})
    # a window's hash in the high bits and its place in the low: one primitive sort brings equal windows together
    places = F.expr("sequence(0, greatest(size(__w) - 3, 0))")
    packed = F.when(F.size("__w") >= 3, F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)), _INDEX_BITS).bitwiseOR(i.cast("long"))))
    two = one.withColumn("__s", F.sort_array(packed))
    high = lambda x: F.shiftright(x, _INDEX_BITS)
    near = F.filter("__s", lambda x, k: (high(x) == high(F.get("__s", k - 1))) | (high(x) == high(F.get("__s", k + 1))))
    three = two.withColumn("__c", F.coalesce(near, F.array().cast("array<bigint>")))
    # the words themselves decide; only windows whose hashes met are compared
    window = lambda x: F.struct(F.concat_ws(" ", F.get("__w", x.bitwiseAND((1 << _INDEX_BITS) - 1).cast("int")), F.get("__w", (x.bitwiseAND((1 << _INDEX_BITS) - 1) + 1).cast("int")), F.get("__w", (x.bitwiseAND((1 << _INDEX_BITS) - 1) + 2).cast("int"))).alias("g"), x.bitwiseAND((1 << _INDEX_BITS) - 1).alias("i"))
    four = three.withColumn("__g", F.when(F.size("__c") == 0, F.array().cast("array<struct<g:string,i:bigint>>")).otherwise(F.sort_array(F.transform("__c", window))))
    same = F.filter("__g", lambda x, k: (x["g"] == F.get("__g", k - 1)["g"]) | (x["g"] == F.get("__g", k + 1)["g"]))
    five = four.withColumn("__p", F.sort_array(F.transform(same, lambda x: x["i"])))
    gaps = F.transform("__p", lambda x, k: F.when(k == 0, F.lit(3).cast("long")).otherwise(F.least(F.lit(3).cast("long"), x - F.get("__p", k - 1))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)
    return five.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "__n_lines": F.size("__l").cast("long"),
            "n_repeat_words": covered,
        }
    ).drop("__w", "__l", "__s", "__c", "__g", "__p")


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vector() -> list[Column]:
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return [F.log(chars / words), *(F.log((F.col(n) + 0.5) / (F.col(of) + 1)) for n, of in _RATES)]


def _spread() -> list[Column]:
    """Variance of the log between a count and the next: 1 for none, about 1 / (12 (n + 1/2)^2) for n; none for the word length."""
    return [F.lit(0.0), *(F.when(F.col(n) == 0, 1.0).otherwise(1 / (12 * (F.col(n) + 0.5) * (F.col(n) + 0.5))) for n, _ in _RATES)]


_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


#: Columns of a fit: centre, scatter, its factor, the log of its determinant.
_FIT = [*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in _PAIRS), *(f"l{i}{j}" for i, j in _PAIRS), "det"]


def _distance() -> str:
    """SQL: squared distance of x0.. from centre m0.. by the Cholesky factor l00, l10, .., by forward substitution."""
    z: list[str] = []
    for i in range(P):
        rest = "".join(f" - l{i}{j} * {z[j]}" for j in range(i))
        z.append(f"((x{i} - m{i}{rest}) / l{i}{i})")
    return " + ".join(f"{x} * {x}" for x in z)


def _factored(df: DataFrame) -> DataFrame:
    """df with the Cholesky factor l00.. of the scatter c00.. and the log of its determinant; empty directions count as tiny."""
    for j in range(P):
        df = df.withColumn(f"l{j}{j}", F.expr(f"sqrt(greatest(c{j}{j}" + "".join(f" - l{j}{n} * l{j}{n}" for n in range(j)) + ", 1e-9D))"))
        below = {f"l{i}{j}": F.expr(f"(c{i}{j}" + "".join(f" - l{i}{n} * l{j}{n}" for n in range(j)) + f") / l{j}{j}") for i in range(j + 1, P)}
        df = df.withColumns(below) if below else df
    return df.withColumn("det", F.expr(" + ".join(f"2 * ln(l{i}{i})" for i in range(P))))


def _quantile(rows: DataFrame, by: list[str], value: Column, q: float) -> DataFrame:
    """by, n and edge: the upper edge of the cell that the q quantile of value lies in. Counts only, so any order of tasks gives the same."""
    counts = rows.groupBy(*by, F.floor(value * CELLS).alias("cell")).count()
    window = Window.partitionBy(*by)  # rows are cells
    summed = counts.withColumns({"upto": F.sum("count").over(window.orderBy("cell")), "n": F.sum("count").over(window)})
    return summed.where(F.col("upto") >= q * F.col("n")).groupBy(*by).agg(F.max("n").alias("n"), ((F.min("cell") + 1) / CELLS).alias("edge"))


def _middle(vectors: DataFrame, name: str) -> DataFrame:
    """g, n and the medians of x0.. as name0.."""
    long = vectors.select("g", F.posexplode(F.array(*(f"x{i}" for i in range(P)))).alias("i", "x"))
    found = _quantile(long, ["g", "i"], F.col("x"), 0.5).groupBy("g").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col("edge") - 0.5 / CELLS)).alias(f"{name}{i}") for i in range(P)))
    return materialise(found, "mcd-middle", files=2)


def _starts(vectors: DataFrame) -> DataFrame:
    """g, n, k and the fits of the three starts k."""
    middle = _middle(vectors, "m")
    away = vectors.join(middle.drop("n"), "g").selectExpr("g", *(f"abs(x{i} - m{i}) AS x{i}" for i in range(P)))
    scale = middle.join(_middle(away, "a").drop("n"), "g").selectExpr("g", "n", *(f"m{i}" for i in range(P)), *(f"greatest(1.4826D * a{i}, {PRIOR[i] / CELLS}D) AS a{i}" for i in range(P)))
    scale = materialise(scale, "mcd-scale", files=2)
    rows = vectors.join(scale, "g").selectExpr("g", *(f"(x{i} - m{i}) / a{i} AS z{i}" for i in range(P)))
    rows = rows.selectExpr("*", *(f"tanh(z{i}) AS h{i}" for i in range(P)), "greatest(" + " + ".join(f"z{i} * z{i}" for i in range(P)) + ", 1e-12D) AS norm")
    sums = [*(f"avg(h{i} * h{j}) - avg(h{i}) * avg(h{j}) AS t{i}{j}" for i, j in _PAIRS), *(f"avg(z{i} * z{j} / norm) AS s{i}{j}" for i, j in _PAIRS)]
    both = scale.join(rows.groupBy("g").agg(*map(F.expr, sums)), "g")
    starts = []
    for name in (None, "t", "s"):
        c = []
        for i, j in _PAIRS:
            r = f"{float(i == j)}D"
            if i != j and name:  # shrunk a little, so that a factor exists
                r = f"coalesce(0.95D * {name}{i}{j} / nullif(sqrt(greatest({name}{i}{i} * {name}{j}{j}, 0D)), 0D), 0D)"
            c.append(f"{r} * a{i} * a{j} AS c{i}{j}")
        starts.append(f"struct({', '.join(c)})")
    each = both.selectExpr("g", "n", *(f"m{i}" for i in range(P)), f"posexplode(array({', '.join(starts)})) AS (k, c)").select("g", "n", "k", *(f"m{i}" for i in range(P)), "c.*")
    return materialise(_factored(each).select("g", "n", "k", *_FIT), "mcd-start", files=2)


def _step(vectors: DataFrame, fit: DataFrame) -> DataFrame:
    """g, n, k and the fits after one concentration step of each fit (g, n, k, ..). One pass: a cell of log distances carries its rows' sums."""
    near = vectors.join(fit.select("g", "k", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _PAIRS)), "g")
    cell = f"floor(log2(greatest({_distance()}, 1e-9D)) * {CELLS})"
    rows = near.selectExpr("g", "k", f"{cell} AS cell", *(f"v{i}" for i in range(1, P)), *(f"x{i} - m{i} AS y{i}" for i in range(P)))
    sums = [F.count("*").alias("h"), *(F.expr(f"sum(v{i}) AS v{i}") for i in range(1, P)), *(F.expr(f"sum(y{i}) AS s{i}") for i in range(P)), *(F.expr(f"sum(y{i} * y{j}) AS p{i}{j}") for i, j in _PAIRS)]
    cells = rows.groupBy("g", "k", "cell").agg(*sums)
    window = Window.partitionBy("g", "k")  # rows are cells
    summed = cells.withColumns({"upto": F.sum("h").over(window.orderBy("cell")), "all": F.sum("h").over(window)})
    within = summed.where(F.col("upto") - F.col("h") < H * F.col("all")).groupBy("g", "k").agg(*(F.sum(c).alias(c) for c in cells.columns[3:]))
    out = within.join(fit.selectExpr("g", "k", "n", *(f"m{i} AS o{i}" for i in range(P))), ["g", "k"])
    centres = [f"o{i} + s{i} / h AS m{i}" for i in range(P)]
    scatters = [f"(p{i}{j} / h - s{i} / h * s{j} / h) * {CONSISTENCY}D{f' + v{i} / h' if i == j > 0 else ''} AS c{i}{j}" for i, j in _PAIRS]
    return _factored(out.selectExpr("g", "n", "k", *centres, *scatters)).select("g", "n", "k", *_FIT)


def estimates(vectors: DataFrame) -> DataFrame:
    """vectors (g, x0.., v1..): per group g, its rows n, the MCD centre m0.., scatter c00.., its factor l00.. and log determinant."""
    fit = _step(vectors, _starts(vectors)).groupBy("g").agg(F.min_by(F.struct("n", "k", *_FIT), F.struct("det", "k")).alias("best"))
    fit = materialise(fit.select("g", "best.*", F.lit(True).alias("better")), "mcd-best", files=2)
    while not (open_ := fit.where("better")).isEmpty():  # groups that the last step improved; each has finitely many subsets
        old = open_.select("g", F.struct(*_FIT).alias("old"))
        both = _step(vectors, open_).join(old, "g").withColumn("better", F.col("det") < F.col("old.det") - IMPROVES)
        both = both.select("g", "n", "k", *(F.when(F.col("better"), F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in _FIT), "better")
        fit = materialise(both.unionByName(fit.where("NOT better")), "mcd-step", files=2)
    return fit.select("g", "n", *_FIT)


def _shrunk(fit: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group of (g0, g1, g2), finest level first: centre and factor, each level shrunk toward the one above."""
    slim = fit.select("g", "n", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in _PAIRS))
    out = groups
    for level in range(3):
        out = out.join(slim.select(F.col("g").alias(f"g{level}"), *(F.col(c).alias(f"{c}_{level}") for c in slim.columns[1:])), f"g{level}")
    names = [*(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in _PAIRS)]
    above = {c: f"{c}_2" if c[0] == "m" else "0D" for c in names} | {f"c{i}{i}": f"{PRIOR[i] ** 2}D" for i in range(P)}
    for level, extra in ((2, P + 1), (1, SHRINK), (0, SHRINK)):
        out = out.withColumns({c: F.expr(f"(n_{level} * {c}_{level} + {extra} * {above[c]}) / (n_{level} + {extra})") for c in names})
        above = {c: c for c in names}
    return materialise(_factored(out).select("g0", *(f"m{i}" for i in range(P)), *(f"l{i}{j}" for i, j in _PAIRS)), "mcd-shrunk", files=2)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the statistics, base_failed, kept, d2 and the group; one row per row of docs."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    slim = statistics(docs.select("doc_id", "text", key("lang").alias("__lang"), key("source").alias("__source"))).drop("text")
    levels = [F.concat_ws("\x01", F.lit("0"), "__lang", "__source"), F.concat(F.lit("1"), "__lang"), F.lit("2")]
    made = materialise(slim.withColumns({f"x{i}": v for i, v in enumerate(_vector())} | {f"v{i}": v for i, v in enumerate(_spread()) if i} | {f"g{k}": g for k, g in enumerate(levels)}), "quality-statistics")
    vectors = made.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *(f"x{i}" for i in range(P)), *(f"v{i}" for i in range(1, P)))
    fit = _shrunk(estimates(vectors), made.select("g0", "g1", "g2").distinct())
    out = made.join(fit, "g0").withColumn("d2", F.expr(_distance()))
    kept = ~_base_failed() & (F.col("d2") <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _base_failed().alias("base_failed"), kept.alias("kept"), "d2", F.col("g0").alias("estimated_on"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
