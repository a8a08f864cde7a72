"""Quality rules with robust multivariate outliers.

Fixed rules come first (too few words, too much repetition). The rest is judged by a vector of transformed
statistics, all of which vary among ordinary texts: mean word length, share of marks (characters of words that are no
letters or digits, symbols among them), distinct words within windows of 50 words, and repeated words. Each is a share
with the counts of PRIOR words of the language's median share added, so that short texts do not stand out by chance.

For each language and source the minimum-covariance-determinant estimate of centre and scatter is sought, regularised
by RIDGE: of all CORE parts of a group's rows, the one whose scatter plus ridge has the least determinant. Several
starts (medians and quartile ranges, correlations of hyperbolic tangents, spatial signs, random subsets of P + 1 rows)
each take two concentration steps; the BEST with the least determinants go on to STEPS of them, whatever the size of
the table. A concentration step takes the CORE of rows nearest to an estimate as the next one's, which never raises the determinant
of the exact core. The least determinant wins and is reweighted. The ridge is a tenth of the variances that ordinary
texts have, and keeps a group of mere copies from rejecting everything else.

A row goes when its squared Mahalanobis distance is above the TAIL quantile of the F distribution that fits the
number of rows behind the estimate (Hotelling's), near chi-square's for large groups.

All rows take part in the estimates, equal vectors once a group: copies of one text, however many, are one point and
do not narrow the scatter. A step is two aggregations: the CORE quantile of distances (exact for groups of
up to some 500 rows, to a thousandth of the rows beyond) and moments of the rows within; both combine before the
shuffle, so that a group may hold any share of the rows.

Defined results: null and empty texts have no words and fail the rules; null lang or source are values of their own;
groups with fewer than MIN_GROUP different vectors that pass the rules are judged by the estimate over their whole
language, or over all rows where that has too few; where all have too few, none is rejected. Repeated rows each get a
row; ties at the core's border are all in it. Very long texts are read whole. An empty table gives an empty table.
Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, discard

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
_ALNUM = re.compile(r"[^\W_]+")
WINDOW, PRIOR, REACH = 50, 40, 1000
#: Shares where a language has no row that passes the rules: characters of a word, marks of characters, distinct words.
USUAL = (5.0, 0.03, 0.9)
MIN_GROUP, CORE, STEPS, BEST, SUBSETS, ACCURACY = 40, 0.75, 10, 3, 5, 1000
#: Standard deviations that the ridge adds to each statistic.
RIDGE = (0.01, 0.045, 0.055, 0.15)
#: Chi-square with 4 degrees of freedom: quantiles .75 and .975.
CHI_CORE, CHI_WEIGHT = 5.385269, 11.143287
#: An ordinary row is rejected with this probability.
TAIL = 1e-9
P = len(RIDGE)
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
NUMBERS = [f"m{i}" for i in range(P)] + [f"p{i}{j}" for i, j in PAIRS]
MODEL = "g string, s int, n double, logdet double, " + ", ".join(f"{c} double" for c in NUMBERS)


def statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen: dict = {}
        for w in triples:
            seen[w] = seen.get(w, 0) + 1
        upto = 0  # words before this place are counted
        for i, w in enumerate(triples):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated


def texture(text: str) -> tuple[int, int, int]:
    """Marks (characters of words that are no letters or digits); distinct and all words of whole windows, or of the only one."""
    words = text.encode().split()
    whole = max(WINDOW, len(words) // WINDOW * WINDOW)
    distinct = sum(len(set(words[i : i + WINDOW])) for i in range(0, whole, WINDOW))
    return len(_ALNUM.sub("", text)) - sum(map(text.count, SPACES)), distinct, min(whole, len(words))


MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "marks", "w_distinct", "w_words")


def vectors(rows: DataFrame) -> DataFrame:
    """Measured rows with their transformed statistics x0, x1, ..., the columns of texture dropped."""
    n, chars, marks, distinct, inside = (F.col(c) for c in ("n_words", "word_chars", "marks", "w_distinct", "w_words"))
    shares = [chars / n, marks / chars, distinct / inside]
    usual = rows.where(~F.col("base_failed")).groupBy("lang").agg(*[F.percentile_approx(s, 0.5, 2000).alias(f"s{i}") for i, s in enumerate(shares)])
    at = rows.join(usual.withColumnRenamed("lang", "ul"), F.col("lang").eqNullSafe(F.col("ul")), "left")
    # repeats count as in REACH words at most, so that a long text without any is no outlier for that
    scale = F.least(F.lit(1.0), F.lit(REACH) / F.greatest(n, F.lit(1)))
    long, marked, unlike = (F.coalesce(f"s{i}", F.lit(u)) for i, u in enumerate(USUAL))
    return at.withColumns(
        {
            "x0": F.log((chars + PRIOR * long + 1) / (n + PRIOR)),
            "x1": F.log((marks + PRIOR * long * marked + 1) / (chars + PRIOR * long + 2)),
            "x2": F.log((distinct + 2 * PRIOR * unlike + 1) / (inside - distinct + 2 * PRIOR * (1 - unlike) + 1)),
            "x3": F.log((F.col("n_repeat_words") * scale + 5) / (n * scale + 5 * PRIOR)),
        }
    ).drop("ul", "s0", "s1", "s2", "marks", "w_distinct", "w_words")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per row: id, lang, source, the statistics, texture and base_failed."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in MEASURED)
    fields = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*statistics(t), *texture(t)) for t in (x.as_py() or "" for x in batch.column(3))]
            columns = [*batch.columns[:3], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURED)))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    rows = docs.select(F.col(id_col), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col)).mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _groups(different: DataFrame, least: int) -> DataFrame:
    """Per lang and source (gl, gs): g, the group whose estimate judges its rows (null for none), and into, the groups whose estimates they take part in. different: its vectors."""
    tag = lambda c: F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), c))
    counts = cut(different.groupBy("lang", "source").count(), "group-counts")
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    fine, by_lang = F.concat_ws("\x1f", tag("lang"), tag("source")), Window.partitionBy("lang")
    big, wide = F.col("count") >= least, F.col("all") >= least
    counts = counts.withColumn("all", F.sum("count").over(by_lang))
    every = F.lit("*") if total >= least else F.lit(None).cast("string")
    counts = counts.withColumn("g", F.when(big, fine).when(wide, tag("lang")).otherwise(every))
    some_small = F.max((~big).cast("int")).over(by_lang) == 1
    last = F.lit(total >= least and not counts.where(~wide & ~big).isEmpty())
    groups = F.array_compact(F.array(F.when(big, fine), F.when(wide & some_small, tag("lang")), F.when(last, every)))
    return counts.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "g", groups.alias("into"))


def _moments(columns: list) -> list:
    """Aggregates: sums and sums of products of the columns."""
    return [F.sum(c).alias(f"a{i}") for i, c in enumerate(columns)] + [F.sum(columns[i] * columns[j]).alias(f"b{i}{j}") for i, j in PAIRS]


def _scatter(row, n: float) -> tuple[np.ndarray, np.ndarray]:
    mean = np.array([row[f"a{i}"] / n for i in range(P)])
    out = np.zeros((P, P))
    for i, j in PAIRS:
        out[i, j] = out[j, i] = row[f"b{i}{j}"] / n - mean[i] * mean[j]
    return mean, out


def _numbers(mean: np.ndarray, inverse: np.ndarray) -> list[float]:
    return [*mean, *(inverse[i, j] for i, j in PAIRS)]


def _starts(ridge: tuple, subsets: int):
    """First estimates of a group, in units of its quartile ranges. Only their shape counts: a step ranks distances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.to_dict("records"):
                add = np.diag(np.square(np.array(ridge) / [row[f"w{i}"] for i in range(P)])) + 1e-9 * np.eye(P)
                _, tanh = _scatter(row, row["n"])
                signs = np.zeros((P, P))
                for i, j in PAIRS:
                    signs[i, j] = signs[j, i] = row[f"u{i}{j}"] / row["n"] * P
                found = [(np.zeros(P), np.eye(P)), (np.zeros(P), tanh), (np.zeros(P), signs)]
                for k in range(subsets):
                    points = np.array([[row[f"r{k}{j}"][x] for x in range(P)] for j in range(P + 1)], float)
                    found.append((points.mean(0), np.cov(points.T, bias=True)))
                for s, (mean, scatter) in enumerate(found):
                    out.append([row["g"], s, float(row["n"]), float("inf"), *_numbers(mean, np.linalg.inv(scatter + add))])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return run


def _invert(ridge: tuple, factor: float):
    """Moments of the rows within, and the group's units, to the next estimate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.to_dict("records"):
                mean, scatter = _scatter(row, row["n"])
                scatter = scatter * factor + np.diag(np.square(np.array(ridge) / [row[f"w{i}"] for i in range(P)])) + 1e-9 * np.eye(P)
                out.append([row["g"], row["s"], float(row["n"]), float(np.linalg.slogdet(scatter)[1]), *_numbers(mean, np.linalg.inv(scatter))])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])

    return run


def _squared(x: list):
    """Squared distance of x from the estimate in columns m and p."""
    d = [x[i] - F.col(f"m{i}") for i in range(P)]
    terms = [F.col(f"p{i}{j}") * d[i] * d[j] * (1.0 if i == j else 2.0) for i, j in PAIRS]
    return F.greatest(F.lit(0.0), sum(terms[1:], terms[0]))


def _step(rows: DataFrame, units: DataFrame, model: DataFrame, ridge: tuple, limit: float | None) -> DataFrame:
    """The next estimate of each start: from the nearest CORE of its group, or from the rows within a squared distance."""
    if limit is None:
        listed = model.groupBy("g").agg(F.collect_list(F.struct("s", *NUMBERS)).alias("models"))
        d = rows.join(listed, "g").select("g", *X, F.explode("models").alias("e")).select("g", *X, "e.*").withColumn("d", _squared([F.col(x) for x in X]))
        border = cut(d.groupBy("g", "s").agg(F.percentile_approx("d", CORE, ACCURACY).alias("border")), "mcd-border")
        model = model.join(border, ["g", "s"])
    else:
        model = model.withColumn("border", F.lit(limit))
    listed = model.groupBy("g").agg(F.collect_list(F.struct("s", "border", *NUMBERS)).alias("models"))
    near = rows.join(listed, "g").select("g", *X, F.explode("models").alias("e")).select("g", *X, "e.*").where(_squared([F.col(x) for x in X]) <= F.col("border"))
    total = near.groupBy("g", "s").agg(F.count(F.lit(1)).cast("double").alias("n"), *_moments([F.col(x) for x in X]))
    half, tail = (CHI_CORE / 2, CORE) if limit is None else (CHI_WEIGHT / 2, 0.975)
    factor = tail / (1 - math.exp(-half) * (1 + half + half * half / 2))  # of a normal core to the whole
    return cut(total.join(units, "g").mapInPandas(_invert(ridge, factor), MODEL), "mcd-model")


def _f_limit(n: float, tail: float) -> float:
    """Squared distance that a row beside n normal ones exceeds with probability tail; with P = 4 the F distribution has a closed form."""
    m = max(n - P, 1.0)
    low, high = 0.0, 1e12
    for _ in range(200):
        f = (low + high) / 2
        y = P * f / (P * f + m)
        low, high = (f, high) if m / 2 * math.log1p(-y) + math.log1p(m / 2 * y) > math.log(tail) else (low, f)
    return P * (n * n - 1) / (n * max(n - P, 1.0)) * low


def _final(tail: float):
    schema = "g string, n double, limit double, logdet double, " + ", ".join(f"{c} double" for c in NUMBERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.to_dict("records"):
                c, w = np.array([row[f"c{i}"] for i in range(P)]), np.array([row[f"w{i}"] for i in range(P)])
                inverse = np.zeros((P, P))
                for i, j in PAIRS:
                    inverse[i, j] = inverse[j, i] = row[f"p{i}{j}"]
                out.append([row["g"], row["n"], _f_limit(row["n"], tail), row["logdet"], *_numbers(c + w * [row[f"m{i}"] for i in range(P)], inverse / np.outer(w, w))])
            yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    return run, schema


def estimate(rows: DataFrame, ridge: tuple = RIDGE, tail: float = TAIL, subsets: int = SUBSETS, best_of: int = BEST, reweighted: bool = True) -> DataFrame:
    """Per group g of rows (g, x0, ...): rows behind the estimate, limit of squared distances, centre m and inverse scatter p."""
    quartiles = rows.groupBy("g").agg(*[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)).alias(x) for x in X])
    at = lambda x, k: F.get(F.col(x), F.lit(k))
    units = cut(quartiles.select("g", *[at(x, 1).alias(f"c{i}") for i, x in enumerate(X)], *[F.greatest((at(x, 2) - at(x, 0)) / 1.349, F.lit(r), F.lit(1e-9)).alias(f"w{i}") for i, (x, r) in enumerate(zip(X, ridge))]), "mcd-units")
    z = cut(rows.join(units, "g").select("g", *[((F.col(x) - F.col(f"c{i}")) / F.col(f"w{i}")).alias(x) for i, x in enumerate(X)]), "mcd-rows")

    norm = F.sqrt(sum([F.col(x) * F.col(x) for x in X[1:]], F.col(X[0]) * F.col(X[0])))
    u = [F.when(norm > 0, F.col(x) / norm).otherwise(0.0) for x in X]
    points = [F.min_by(F.array(*X), F.xxhash64(F.lit(k * (P + 1) + j), *X)).alias(f"r{k}{j}") for k in range(subsets) for j in range(P + 1)]
    first = z.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *_moments([F.tanh(x) for x in X]), *[F.sum(u[i] * u[j]).alias(f"u{i}{j}") for i, j in PAIRS], *points)
    model = cut(first.join(units, "g").mapInPandas(_starts(ridge, subsets), MODEL), "mcd-start")

    for step in range(STEPS):
        after = _step(z, units, model, ridge, None)
        if step == 1:
            rank = F.row_number().over(Window.partitionBy("g").orderBy("logdet", "s"))
            after = cut(after.withColumn("k", rank).where(F.col("k") <= best_of).drop("k"), "mcd-best")
        discard(model)
        model = after
    best = model.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("logdet", "s"))).where("k = 1").drop("k")
    if reweighted:
        best = _step(z, units, best, ridge, CHI_WEIGHT)
    run, schema = _final(tail)
    out = cut(best.join(units, "g").mapInPandas(run, schema), "mcd-estimate")
    discard(z)
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", least: int = MIN_GROUP, **columns) -> DataFrame:
    """Per row: id, n_words, the four statistics, base_failed, kept, distance (null where no estimate judges it)."""
    rows = cut(vectors(cut(measure(docs, id_col, **columns), "statistics")), "statistics-vectors")
    different = cut(rows.where(~F.col("base_failed")).select("lang", "source", *X).distinct(), "different-vectors")
    groups = cut(_groups(different, least), "groups")
    here = F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs"))
    model = estimate(different.join(groups, here).select(F.explode("into").alias("g"), *X).distinct())
    judged = rows.join(groups.drop("into"), here, "left").join(model.drop("n", "logdet"), "g", "left").withColumn("distance", F.when(~F.col("base_failed") & F.col("m0").isNotNull(), F.sqrt(_squared([F.col(x) for x in X]))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.sqrt("limit"), F.lit(True))
    return judged.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")
