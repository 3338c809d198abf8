"""Quality rules: simple limits, then robust multivariate outliers per language and source, without Python functions.

Per document a few ratios are transformed to a vector. Per (language, source) the minimum covariance determinant estimate
is found by concentration steps from several starts side by side: medians with quartile ranges, the shortest half of each
coordinate, the lower and the upper half of each, and directions from the shortest halves. A step takes mean and covariance
of the ``(n + p + 1) / 2`` rows with the smallest Mahalanobis distance; a start ends when its determinant falls no more, or
joins another that has come to the same one, and the smallest determinant wins. So nearly half of a group may be junk. The
covariance gets a small diagonal floor, because ratios such as symbols per word are zero in most clean documents and the
plain determinant would vanish. Rows far outside the final ellipsoid are rejected.

Only vectors and group figures are shuffled. Each step is one partial aggregation of counts over distance bins and one of
moments, so a group with a third of all rows costs no more than others. Distances need one triangular product per row;
the factors are computed on the group table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperloom.llm.store import forget, small, written
from paperloom.llm.words import SPACES, word_chars, words

SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!?.,;:"
#: Coordinates of the vector, and the standard deviation that each is given at least.
FLOORS = {"word_length": 0.08, "symbols": 0.05, "upper": 0.05, "marks": 0.06, "dup_lines": 0.12, "repeats": 0.12}
#: Steps after which a start is taken as it is; a few are enough as a rule.
MOST_STEPS = 40
#: Rows that a group needs for an estimate of its own; below, its language's is used, then that of all rows.
LEAST_ROWS = 200
#: Squared distances above this times the median one, scaled to a chi-square law, are outliers.
CUT = 110.0
#: A start goes on while the logarithm of its determinant falls by more; bins make differences below that chance.
FALL = 0.01
_BINS = 32  # per doubling of the squared distance
_P = len(FLOORS)


def base_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) in ``__stats``, a struct.

    Null texts count as empty. ``n_repeat_words`` sorts 64-bit hashes of three-word windows with their positions and
    compares neighbours word by word; where hashes lie, the row is counted again with the windows as text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = "cast(ceil(log2(size(__w) + 2)) as int)"
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, " " + SPACES, "")) > 0)
    rows = docs.withColumns({"__w": words(F.col(text_col)), "__lines": lines})
    rows = rows.withColumn("__bits", F.expr(bits))
    rows = rows.withColumn("__mask", F.expr("shiftleft(1L, __bits) - 1"))
    rows = rows.withColumn("__keys", F.expr("""CASE WHEN size(__w) < 4 THEN array() ELSE sort_array(transform(
        slice(__w, 1, size(__w) - 2), (x, i) -> shiftleft(xxhash64(x, __w[i + 1], __w[i + 2]), __bits) | i)) END"""))
    rows = rows.withColumn("__same", F.expr("""filter(transform(__keys, (x, i) -> CASE WHEN i > 0 AND
        shiftright(x, __bits) = shiftright(__keys[i - 1], __bits)
        THEN struct(cast(x & __mask as int) as a, cast(__keys[i - 1] & __mask as int) as b) END), x -> x IS NOT NULL)"""))
    rows = rows.withColumn("__lied", F.expr("""exists(__same, x -> __w[x.a] != __w[x.b]
        OR __w[x.a + 1] != __w[x.b + 1] OR __w[x.a + 2] != __w[x.b + 2])"""))
    rows = rows.withColumn("__sorted", F.expr("""CASE WHEN __lied THEN array_sort(transform(slice(__w, 1, size(__w) - 2),
        (x, i) -> struct(concat_ws(' ', x, __w[i + 1], __w[i + 2]) as t, i as i))) END"""))
    covered = F.expr("""size(array_distinct(flatten(CASE WHEN __lied
        THEN transform(filter(transform(__sorted, (x, i) -> CASE WHEN i > 0 AND x.t = __sorted[i - 1].t
             THEN struct(x.i as a, __sorted[i - 1].i as b) END), x -> x IS NOT NULL),
             x -> array(x.a, x.a + 1, x.a + 2, x.b, x.b + 1, x.b + 2))
        ELSE transform(__same, x -> array(x.a, x.a + 1, x.a + 2, x.b, x.b + 1, x.b + 2)) END)))""")
    stats = F.struct(
        F.size("__w").cast("long").alias("n_words"),
        word_chars(F.col(text_col)).alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
    )
    return rows.select(*docs.columns, stats.alias("__stats"), F.size("__lines").alias("__n_lines"))


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def base_failed() -> Column:
    n = F.col("__stats.n_words")
    return (n < 50) | (100 * F.col("__stats.n_repeat_words") > 50 * n)


def _vector(text: Column) -> Column:
    """Ratios per word, letter or line, each transformed so that its spread is alike from clean to noisy text."""
    s = lambda name: F.col(f"__stats.{name}").cast("double")
    n = F.greatest(s("n_words"), F.lit(1.0))
    upper = F.char_length(text) - F.char_length(F.regexp_replace(text, "\\p{Lu}", ""))
    root = lambda x: F.sqrt(F.least(F.greatest(x, F.lit(0.0)), F.lit(16.0)))
    values = {
        "word_length": F.log(1 + s("word_chars") / n),
        "symbols": root(s("n_symbols") / n),
        "upper": root(upper / F.greatest(s("word_chars"), F.lit(1.0))),
        "marks": root(_count(text, PUNCTUATION) / n),
        "dup_lines": root(s("n_dup_lines") / F.greatest(F.col("__n_lines").cast("double"), F.lit(1.0))),
        "repeats": root(s("n_repeat_words") / n),
    }
    return F.array(*[values[k] for k in FLOORS])


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _factor(cov: list[list[Column]], names: list[str], df: DataFrame) -> DataFrame:
    """Add ``factor``: the rows of the inverse of the Cholesky factor of ``cov``, lower triangle, as one array."""
    at = lambda a, i, j: F.col(f"__{a}{i}_{j}")
    for j in range(_P):
        left = {i: cov[i][j] - (_sum([at("l", i, k) * at("l", j, k) for k in range(j)]) if j else F.lit(0.0)) for i in range(j, _P)}
        df = df.withColumn(f"__l{j}_{j}", F.sqrt(F.greatest(left[j], F.lit(1e-12))))
        if j + 1 < _P:
            df = df.withColumns({f"__l{i}_{j}": left[i] / at("l", j, j) for i in range(j + 1, _P)})
    for i in range(_P):
        df = df.withColumns({f"__m{i}_{j}": (F.lit(1.0) if i == j else -_sum([at("l", i, k) * at("m", k, j) for k in range(j, i)]))
                             / at("l", i, i) for j in range(i + 1)})
    return df.select(*names, F.array(*[at("m", i, j) for i in range(_P) for j in range(i + 1)]).alias("factor"))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``v`` under ``mean`` and ``factor``."""
    off = lambda i: i * (i + 1) // 2
    rows = [_sum([F.col("factor")[off(i) + j] * (F.col("v")[j] - F.col("mean")[j]) for j in range(i + 1)]) for i in range(_P)]
    return _sum([r * r for r in rows])


def _bin(d: Column) -> Column:
    return F.floor(F.log2(F.greatest(d, F.lit(1e-9))) * _BINS).cast("int")


def _quantile_bin(rows: DataFrame, share: float, more: float = 0.0) -> DataFrame:
    """``g, run, cut``: the distance bin of each group and run in which ``share`` of its rows and ``more`` is reached."""
    counts = rows.groupBy("g", "run", "bin").agg(F.count(F.lit(1)).alias("n"))
    upto, every = W.partitionBy("g", "run").orderBy("bin"), W.partitionBy("g", "run")
    return (
        counts.withColumns({"upto": F.sum("n").over(upto), "total": F.sum("n").over(every)})
        .where(F.col("upto") >= F.least(F.floor(F.col("total") * share + more), F.col("total")))
        .groupBy("g", "run").agg(F.min("bin").alias("cut"))
    )


def _log_det() -> Column:
    """Logarithm of the determinant of the covariance behind ``factor``."""
    return -2 * _sum([F.log(F.col("factor")[i * (i + 3) // 2]) for i in range(_P)])


def _starts(vectors: DataFrame) -> DataFrame:
    """``g, run, mean, factor, det``: where the concentration steps begin, ``det`` infinite; a written table."""
    floors = list(FLOORS.values())
    grid = [k / 40 for k in range(41)]
    quantiles = vectors.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col("v")[i], grid, 1000).alias(f"q{i}") for i in range(_P)],
    ).where(F.col("n") >= LEAST_ROWS)
    q = lambda i, k: F.col(f"q{i}")[k]
    half = [F.expr(f"array_min(transform(sequence(0, 20), k -> struct(q{i}[k + 20] - q{i}[k] as width, q{i}[k + 10] as mid)))") for i in range(_P)]
    kinds = [
        [(q(i, 20), (q(i, 30) - q(i, 10)) / 1.349) for i in range(_P)],
        [(half[i]["mid"], half[i]["width"] / 1.349) for i in range(_P)],
        [(q(i, 10), (q(i, 20) - q(i, 0)) / 1.349) for i in range(_P)],
        [(q(i, 30), (q(i, 40) - q(i, 20)) / 1.349) for i in range(_P)],
    ]
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.array(*[m for m, _ in kind]).alias("mean"),
                              F.array(*[F.sqrt(s * s + floors[i] ** 2) for i, (_, s) in enumerate(kind)]).alias("sd"))
                     for r, kind in enumerate(kinds)])
    plain = written(quantiles.select("g", F.explode(runs).alias("r")).select("g", "r.*"), "mcd-plain")
    diagonal = [[F.col("sd")[i] ** 2 if i == j else F.lit(0.0) for j in range(i + 1)] for i in range(_P)]
    # directions from the shortest halves: rows at length one, so that far ones weigh no more than near ones
    z = [(F.col("v")[i] - F.col("mean")[i]) / F.col("sd")[i] for i in range(_P)]
    signs = vectors.join(small(plain.where("run = 1")), "g").withColumn("z", F.array(*z))
    signs = signs.withColumn("l", F.greatest(_sum([F.col("z")[i] * F.col("z")[i] for i in range(_P)]), F.lit(1e-9)))
    shape = signs.groupBy("g", "mean", "sd").agg(
        *[F.avg(F.col("z")[i] * F.col("z")[j] / F.col("l")).alias(f"s{i}_{j}") for i in range(_P) for j in range(i + 1)])
    cov = [[(F.col(f"s{i}_{j}") + F.lit(0.01 if i == j else 0.0)) * F.col("sd")[i] * F.col("sd")[j] for j in range(i + 1)] for i in range(_P)]
    all_runs = _factor(diagonal, ["g", "run", "mean"], plain).unionByName(
        _factor(cov, ["g", "run", "mean"], shape.withColumn("run", F.lit(len(kinds)))))
    started = written(all_runs.withColumn("det", F.lit(float("inf"))), "mcd")
    forget(plain)
    return started


def _concentrated(vectors: DataFrame, params: DataFrame, join: bool = False) -> DataFrame:
    """``params`` after one step, and whether the determinant fell, as ``going``; a written table.

    With ``join`` the runs of a group that have come to one determinant go on as one.
    """
    floors = list(FLOORS.values())
    far = vectors.join(small(params), "g").withColumn("bin", _bin(_distance()))
    cut = written(_quantile_bin(far, 0.5, (_P + 1) / 2), "mcd-cut")
    near = far.join(small(cut), ["g", "run"]).where("bin <= cut")
    v = lambda i: F.col("v")[i] - F.col("mean")[i]  # noqa: E731  around the last mean, against cancellation
    moments = near.groupBy("g", "run", "mean", "det").agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(v(i)).alias(f"s{i}") for i in range(_P)],
        *[F.sum(v(i) * v(j)).alias(f"s{i}_{j}") for i in range(_P) for j in range(i + 1)],
    )
    m = [F.col(f"s{i}") / F.col("n") for i in range(_P)]
    cov = [[F.col(f"s{i}_{j}") / F.col("n") - m[i] * m[j] + F.lit(floors[i] ** 2 if i == j else 0.0)
            for j in range(i + 1)] for i in range(_P)]
    moved = moments.withColumn("old", F.col("mean")).withColumn("mean", F.array(*[F.col("old")[i] + m[i] for i in range(_P)]))
    moved = _factor(cov, ["g", "run", "mean", "det"], moved).withColumn("before", F.col("det")).withColumn("det", _log_det())
    moved = moved.withColumn("going", F.col("det") < F.col("before") - FALL).drop("before")
    if join:
        first = W.partitionBy("g", F.round("det", 2)).orderBy("going", "run")
        moved = moved.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    newer = written(moved, "mcd")
    forget(cut)
    return newer


def _estimates(vectors: DataFrame) -> DataFrame:
    """``g, mean, factor, scale`` per group of ``g, v``; a written table. ``v`` counts for every group it is given for."""
    params, steps = _starts(vectors), []
    for step in range(1, MOST_STEPS + 1):
        steps.append(_concentrated(vectors, params, step % 3 == 0))
        params = steps[-1].where("going").drop("going")
        if params.isEmpty():
            break
    best = W.partitionBy("g").orderBy("det", "run")
    runs = reduce(DataFrame.unionByName, [s if s is steps[-1] else s.where("NOT going") for s in steps])
    final = written(runs.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "det", "going"), "mcd-best")
    forget(*steps)
    # bins of the median distance, to bring the covariance of the nearer half to the scale of all rows
    far = vectors.join(small(final), "g").withColumn("bin", _bin(_distance()))
    median = _quantile_bin(far, 0.5).withColumn("scale", F.greatest(F.pow(F.lit(2.0), (F.col("cut") + 1) / _BINS) / chi_median(_P), F.lit(1.0)))
    return written(final.drop("run").join(median.select("g", "scale"), "g"), "mcd-final")


def chi_median(p: int) -> float:
    """Median of the chi-square law with p degrees of freedom, by the Wilson-Hilferty form."""
    return p * (1 - 2 / (9 * p)) ** 3


def judge(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """``__doc`` (a struct of the columns in ``carry``, all by default), ``__stats``, ``base_failed``, ``distance``, ``kept``: one row per input row.

    Rows that fail the limits are not kept and take no part in the estimates. Null languages and sources are groups of their
    own. A group of fewer than ``LEAST_ROWS`` rows is judged by its language, else by all rows, else not at all
    (kept, distance null). Null and empty texts fail the limits. Ties and repeated rows are judged alike.
    """
    names = docs.columns if carry is None else carry
    own = docs.select(F.struct(*names).alias("__doc"), F.col(text_col).alias("__t"), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"))
    stats = base_statistics(own, "__t").withColumn("base_failed", base_failed())
    text = F.coalesce("__t", F.lit(""))
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))
    table = written(
        stats.select(
            "__doc", "__stats", "base_failed",
            F.when(~F.col("base_failed"), _vector(text)).alias("v"),
            F.array(F.to_json(F.array(part("__lang"), part("__source"))), F.to_json(F.array(part("__lang"))), F.lit("all")).alias("levels"),
        ),
        "quality",
    )
    vectors = table.where("v IS NOT NULL").select("v", F.explode("levels").alias("g"))
    final = _estimates(vectors.join(small(_judging(table)), "g", "left_semi"))
    return _verdicts(table, final)


def _judging(table: DataFrame) -> DataFrame:
    """``g``: the groups that some row is judged by, the first of its levels with enough rows; a written table."""
    sizes = written(table.where("v IS NOT NULL").groupBy("levels").agg(F.count(F.lit(1)).alias("n")), "quality-sizes")
    level = sizes.select("levels", "n", F.posexplode("levels").alias("k", "g"))
    enough = level.groupBy("g").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_ROWS)
    first = level.join(enough, "g").groupBy("levels").agg(F.min_by("g", "k").alias("g"))
    return written(first.select("g").distinct(), "quality-judging")


def _verdicts(table: DataFrame, final: DataFrame) -> DataFrame:
    groups = small(final)
    rows = table
    for i in range(3):
        named = groups.select(F.col("g").alias(f"g{i}"), F.struct("mean", "factor", "scale").alias(f"e{i}"))
        rows = rows.join(named, F.col("levels")[i] == F.col(f"g{i}"), "left")
    rows = rows.withColumn("e", F.coalesce("e0", "e1", "e2")).withColumns(
        {"mean": F.col("e.mean"), "factor": F.col("e.factor")})
    distance = F.when(F.col("v").isNotNull(), _distance() / F.col("e.scale"))
    return rows.withColumn("distance", distance).select(
        "__doc", "__stats", "base_failed", "distance",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True))).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` that ``judge`` keeps."""
    good = judge(docs, text_col, lang_col, source_col).where("kept")
    return good.select(*[F.col("__doc").getField(c).alias(c) for c in docs.columns])
