"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Base rules reject a text by its own counts. Every other text has a vector of
transformed statistics. For each language and source the location and scatter
of these vectors are estimated by the minimum covariance determinant: of all
subsets of h rows, the one whose covariance has the least determinant. It is
searched by concentration steps (estimate, then keep the h rows nearest by
Mahalanobis distance) from elemental starts to convergence. The estimate of a
source is shrunk towards its language's, the less the more rows it has, and
that towards the estimate of all. A text far from the estimate of its source
is rejected.

All of it is DataFrame functions: a step is one partial aggregate over the
narrow statistics table and one join with the estimates (one row for each group
and start), so a group of any size costs a task nothing but its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import row_key, saved, words

WINDOW = 8  # words; a window found twice in a text counts its words as repeated
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def text_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ws-derived counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    ``docs`` has a column ``text``; a null text counts as empty. Window equality is by 64-bit hashes of the words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = [c for c in docs.columns if c != "text"]
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*kept, text.alias("_tx"), words(F.col("text")).alias("_ws"), lines.alias("_ls"))
    df = df.select(
        *kept,
        F.size("_ws").cast("long").alias("n_words"),
        F.char_length(F.array_join("_ws", "")).cast("long").alias("word_chars"),
        (F.char_length("_tx") - F.char_length(F.regexp_replace("_tx", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_ls") - F.size(F.array_distinct("_ls"))).cast("long").alias("n_dup_lines"),
        F.transform("_ws", lambda w: F.xxhash64(w)).alias("_hash"),
    )
    counts = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        n = F.greatest(F.size("_hash") - step, F.lit(0))
        df = df.select(*counts, F.zip_with(F.slice("_hash", F.lit(1), n), F.slice("_hash", F.lit(1 + step), n), lambda a, b: F.xxhash64(a, b)).alias("_hash"))
    # only a text with a repeated window has its windows sorted
    again = F.size("_hash") != F.size(F.array_distinct("_hash"))
    df = df.select(*counts, F.when(again, F.sort_array(F.transform("_hash", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("_ss"))
    same = lambda e, j: F.coalesce(F.get("_ss", j)["x"] == e["x"], F.lit(False))
    df = df.select(*counts, F.sort_array(F.transform(F.filter("_ss", lambda e, j: same(e, j - 1) | same(e, j + 1)), lambda e: e["i"])).alias("_ps"))
    m = F.size("_ps")
    gaps = F.zip_with(F.slice("_ps", F.lit(1), m - 1), F.slice("_ps", F.lit(2), m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.col("_ps").isNotNull() & (m > 0), F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)).otherwise(F.lit(0))
    return df.select(*counts, covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    """Base rules over the counts of text_statistics."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


# The vector, and for each component the least standard deviation that an estimate may have: most texts
# have no symbol, repeated line or repeated window at all, so their raw scatter there is zero.
FLOORS = {"v_length": 0.05, "v_symbols": 0.35, "v_lines": 0.5, "v_repeats": 0.08}
_V = list(FLOORS)
_P = len(_V)
PRIOR = {"v_length": 0.3, "v_symbols": 1.0, "v_lines": 1.0, "v_repeats": 0.15}  # deviations that a table of few texts is shrunk towards
SHRINK = 50.0  # vectors that the estimate above a group counts for
H_SHARE = 0.75  # h as a share of the group
STARTS = 12  # the whole group and eleven elemental draws
ELEMENT = 6  # expected rows of an elemental draw
LEAST_GAIN = 1e-3  # of the logarithm of the determinant; a group that gains less has converged
CUTOFF = 33.4  # squared distance: the 1 - 1e-6 quantile of chi-square with 4 degrees
_CHI2_MEDIAN = 3.357  # its median
_SALTS = 16
_ALL = "{}"  # the group of all vectors


def _salted(rows: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Join by ``key`` with a small table, one row for each key (and start); a hot key spreads over salts."""
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_h"), F.lit(_SALTS)).cast("int")).join(copies, [key, "_salt"]).drop("_salt")


def _levels() -> Column:
    """The groups of a row: its source within its language, its language, all."""
    return F.explode(F.array("own", "pool", F.lit(_ALL))).alias("grp")


def _shrunk(value: Column, n: Column, above: Column) -> Column:
    return (n * value + SHRINK * above) / (n + SHRINK)


def _beside(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """``groups`` (own, pool, all) with the columns of ``levels`` (grp, ...) for each of the three levels, as own_x, pool_x and all_x."""
    out = groups
    for key in ("own", "pool", "all"):
        out = out.join(levels.select(F.col("grp").alias(key), *[F.col(c).alias(f"{key}_{c}") for c in levels.columns if c != "grp"]), key)
    return out


def _sums() -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")] + [F.sum(v).alias(f"s{i}") for i, v in enumerate(_V)]
    return out + [F.sum(F.col(_V[i]) * F.col(_V[j])).alias(f"q{i}{j}") for i in range(_P) for j in range(i + 1)]


_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_MOMENTS = [f"m{i}" for i in range(_P)] + [f"c{i}{j}" for i, j in _PAIRS]


def _factored(moments: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor of the covariance and the logarithm of its determinant."""
    out = moments
    for j in range(_P):
        inner = sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.greatest(F.col(f"c{j}{j}") - inner, F.lit(FLOORS[_V[j]] ** 2))))
        for i in range(j + 1, _P):
            inner = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            out = out.withColumn(f"l{i}{j}", (F.col(f"c{i}{j}") - inner) / F.col(f"l{j}{j}"))
    return out.withColumn("log_det", sum((2 * F.log(F.col(f"l{j}{j}")) for j in range(_P)), F.lit(0.0)))


def _estimate(sums: DataFrame) -> DataFrame:
    """Means, floored covariance and its factor, from _sums."""
    n = F.col("n").cast("double")
    floored = lambda i: F.greatest(F.col(f"q{i}{i}") / n - (F.col(f"s{i}") / n) ** 2, F.lit(0.0)) + FLOORS[_V[i]] ** 2
    return _factored(
        sums.select(
            "grp",
            "start",
            "n",
            *[(F.col(f"s{i}") / n).alias(f"m{i}") for i in range(_P)],
            *[(floored(i) if i == j else F.col(f"q{i}{j}") / n - F.col(f"s{i}") * F.col(f"s{j}") / n / n).alias(f"c{i}{j}") for i, j in _PAIRS],
        )
    )


def _with_distance(df: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the estimate that stands beside the vector."""
    for i in range(_P):
        inner = sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        df = df.withColumn(f"y{i}", (F.col(_V[i]) - F.col(f"m{i}") - inner) / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(_P)), F.lit(0.0)))


_ESTIMATE = [f"m{i}" for i in range(_P)] + [f"l{i}{j}" for i, j in _PAIRS]


def _nearest(vectors: DataFrame, est: DataFrame) -> DataFrame:
    """Rows (with start) whose distance is among the least h of their group; rows at the limit are all in."""
    near = _with_distance(_salted(vectors, est.select("grp", "start", *_ESTIMATE), "grp")).select("_id", "_h", "grp", "start", *_V, "d2")
    limit = near.groupBy("grp", "start").agg(F.percentile_approx("d2", H_SHARE, 1000).alias("limit"))
    limit = limit.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salt = F.pmod(F.xxhash64("_id", "_h"), F.lit(_SALTS)).cast("int")
    return near.withColumn("_salt", salt).join(limit, ["grp", "start", "_salt"]).where("d2 <= limit").drop("_salt")


def _concentrate(vectors: DataFrame, est: DataFrame, name: str) -> DataFrame:
    return saved(_estimate(_nearest(vectors, est).groupBy("grp", "start").agg(*_sums())), name)


def mcd_estimates(vectors: DataFrame, steps: int = 2) -> DataFrame:
    """One row for each grp: the estimate of least determinant (grp, start, n, means, covariance, factor, log_det).

    ``vectors`` has _id, _h, grp and the vector. Start 0 is the whole group, the others are elemental: hash draws of ELEMENT rows
    expected, of which some hold no outlier even where a quarter of the group are outliers (an empty draw gives no start). Every start takes ``steps``
    concentration steps; the best of a group goes on until a step lowers its determinant no more. As the determinant has a floor and
    every further round needs a gain, this ends. The h-th distance comes from a sketch of relative rank error 1/1000, so h may be off by that share.
    """
    many = vectors.groupBy("grp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / ELEMENT), F.lit(1)).alias("one_in"))
    draws = lambda s: (s == 0) | (F.pmod(F.xxhash64("_id", "_h", s), F.col("one_in")) == 0)
    start = F.explode(F.filter(F.sequence(F.lit(0), F.lit(STARTS - 1)), draws)).alias("start")
    drawn = _salted(vectors, saved(many, "mcd-groups"), "grp").select("grp", *_V, start)
    est = saved(_estimate(drawn.groupBy("grp", "start").agg(*_sums())), "mcd-start")
    for i in range(steps):
        est = _concentrate(vectors, est, f"mcd-{i}")
    cols = [c for c in est.columns if c != "grp"]
    best = est.groupBy("grp").agg(F.min(F.struct("log_det", *[c for c in cols if c != "log_det"])).alias("e"))
    est = moving = saved(best.select("grp", *[F.col(f"e.{c}").alias(c) for c in cols]), "mcd-best")
    while True:
        before = moving.select("grp", F.col("log_det").alias("_before"))
        next_ = _concentrate(vectors, moving, "mcd-next")
        moving = saved(next_.join(before, "grp").where(F.col("log_det") < F.col("_before") - LEAST_GAIN).select(*est.columns), "mcd-moving")
        if moving.isEmpty():
            return est
        est = saved(est.join(moving.select("grp"), "grp", "left_anti").unionByName(moving), "mcd-estimates")


def shrunk_estimates(groups: DataFrame, est: DataFrame) -> DataFrame:
    """One row for each own of ``groups`` (own, pool, all): its estimate, shrunk towards its language's, shrunk towards that of all.

    ``est`` has n, means and covariance of each grp. An estimate of n rows counts n, the one above it SHRINK; that of all is shrunk towards PRIOR
    deviations. So every group has an estimate, and it moves steadily with the group's size.
    """
    df = _beside(groups, est.select("grp", "n", *_MOMENTS))
    value = {}
    for i, j in _PAIRS:
        value[f"c{i}{j}"] = _shrunk(F.col(f"all_c{i}{j}"), F.col("all_n"), F.lit(PRIOR[_V[i]] ** 2 if i == j else 0.0))
    for i in range(_P):
        value[f"m{i}"] = F.col(f"all_m{i}")
    for key in ("pool", "own"):
        value = {c: _shrunk(F.col(f"{key}_{c}"), F.col(f"{key}_n"), v) for c, v in value.items()}
    return _factored(df.select("own", *[value[c].alias(c) for c in _MOMENTS])).select("own", *_ESTIMATE)


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Verdict on every row of ``docs`` (doc_id, text, lang, source; other columns are not read).

    Returns doc_id, _id, _h (row key), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance (squared,
    robust; null if base_failed), kept.

    A null or empty text has no words and fails the base rules. Null lang or source is a value of its own. Repeated rows count
    each and get equal verdicts. An empty table gives no rows. Texts may be of any length.
    """
    base = docs.select("doc_id", *row_key(F.col("doc_id"), F.col("text")), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    stats = text_statistics(base).withColumn("base_failed", base_failed())
    n = F.col("n_words").cast("double")
    mean = F.col("word_chars") / F.greatest(n, F.lit(1.0))
    stats = stats.select(
        *[c for c in stats.columns if c not in ("lang", "source")],
        F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}).alias("own"),
        F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}).alias("pool"),
        F.log(mean + 1).alias("mean_length"),
        F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))).alias("v_symbols"),
        F.log1p(100.0 * F.col("n_dup_lines") / F.greatest(n, F.lit(1.0))).alias("v_lines"),
        (F.col("n_repeat_words") / F.greatest(n, F.lit(1.0))).alias("v_repeats"),
        # a mean over few words scatters more; below 200 words its deviation is shrunk to the scale of 200
        F.sqrt(F.least(n, F.lit(200.0)) / 200.0).alias("weight"),
    )
    stats = saved(stats, "quality-stats")
    good = stats.where("not base_failed")
    groups = saved(good.select("own", "pool").distinct().withColumn("all", F.lit(_ALL)), "quality-groups")
    middle = good.select(_levels(), "mean_length").groupBy("grp").agg(F.percentile_approx("mean_length", 0.5, 1000).alias("centre"), F.count(F.lit(1)).alias("n"))
    centre = _shrunk(F.col("own_centre"), F.col("own_n"), _shrunk(F.col("pool_centre"), F.col("pool_n"), F.col("all_centre")))
    centres = saved(_beside(groups, saved(middle, "quality-middles")).select("own", centre.alias("centre")), "quality-centres")
    placed = _salted(good, centres, "own").withColumn("v_length", (F.col("mean_length") - F.col("centre")) * F.col("weight"))
    vectors = saved(placed.select("_id", "_h", "own", "pool", *_V), "quality-vectors").select("_id", "_h", _levels(), *_V)
    est = mcd_estimates(vectors)
    # the scatter of the nearest h rows is too small for all rows: scaled so that the median distance is that of chi-square
    median = _with_distance(_salted(vectors, est.select("grp", *_ESTIMATE), "grp")).groupBy("grp").agg(F.percentile_approx("d2", 0.5, 1000).alias("median_d2"))
    scale = F.greatest(F.col("median_d2") / _CHI2_MEDIAN, F.lit(1.0))
    scaled = [(F.col(c) * scale).alias(c) if c[0] == "c" else F.col(c) for c in _MOMENTS]
    est = saved(est.join(median, "grp").select("grp", "n", *scaled), "quality-estimates")
    # every row looks up the estimate of its source; a source without a vector has none, and all its rows fail the base rules
    known = shrunk_estimates(groups, est).join(centres, "own")
    copies = saved(known, "quality-known").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    out = stats.withColumn("_salt", F.pmod(F.xxhash64("_id", "_h"), F.lit(_SALTS)).cast("int")).join(copies, ["own", "_salt"], "left")
    out = _with_distance(out.withColumn("v_length", (F.col("mean_length") - F.col("centre")) * F.col("weight")))
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    return out.select(
        "doc_id", "_id", "_h", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, all columns."""
    good = quality_rules(docs, cutoff).where("kept").select("_id", "_h").distinct()
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, h = row_key(F.col(f"c{names.index('doc_id')}"), F.col(f"c{names.index('text')}"))
    out = inner.withColumns({"_id": i, "_h": h}).join(good, ["_id", "_h"], "left_semi")
    return out.select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(names)])
