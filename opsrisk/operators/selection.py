"""Exact order statistics (k-th smallest values) without gathering a column.

Used for exact medians (imputation) and the exact stratified split. Each
round narrows a value bracket around the wanted ranks: ``percentile_approx``
(a bounded GK sketch per task) proposes the bracket, one ``count_if`` pass
places it by rank, and once the bracket holds few distinct values they are
read as a small sorted (value, count) table. Every pass is a partial
aggregate, so a hot value (a third of the rows equal) costs one row per task,
and no task or the driver ever holds more than about ``max_distinct`` values of a bracket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000
MAX_DISTINCT = 10_000


@dataclass
class _Bracket:
    name: str  # expression key
    ranks: list[int]  # wanted 0-based ranks among the non-null values (one, or two neighbours)
    below: int  # values below the bracket
    n_in: int  # values in it
    distinct: int  # estimate or upper bound of the distinct values in it
    eps: float  # half width of the next proposal, as a share of n_in
    lo: object = None  # bounds (None: open end)
    hi: object = None
    past_lo: bool = False  # whether the bound itself lies outside
    past_hi: bool = False

    def holds(self, expr: Column) -> Column:
        cond = expr.isNotNull()
        if self.lo is not None:
            cond = cond & ((expr > F.lit(self.lo)) if self.past_lo else (expr >= F.lit(self.lo)))
        if self.hi is not None:
            cond = cond & ((expr < F.lit(self.hi)) if self.past_hi else (expr <= F.lit(self.hi)))
        return cond

    def cut(self, a: object, b: object, low: int, mid: int, distinct: int, eps: float) -> list[_Bracket]:
        """The parts below a, from a to b and above b that hold wanted ranks; each is smaller, or its next proposal is."""
        at, over = self.below + low, self.below + low + mid
        high = self.n_in - low - mid
        lower = _Bracket(self.name, [k for k in self.ranks if k < at], self.below, low, low, eps, self.lo, a, self.past_lo, True)
        inner = _Bracket(self.name, [k for k in self.ranks if at <= k < over], at, mid, distinct, eps if mid < self.n_in else self.eps / 2, a, b)
        upper = _Bracket(self.name, [k for k in self.ranks if k >= over], over, high, high, eps, b, self.hi, True, self.past_hi)
        return [x for x in (lower, inner, upper) if x.ranks]


def _neighbours(ranks: list[int]) -> list[list[int]]:
    """Ranks, neighbours (as the middle two of a median) together."""
    out: list[list[int]] = []
    for k in sorted(set(ranks)):
        if out and len(out[-1]) == 1 and out[-1][0] == k - 1:
            out[-1].append(k)
        else:
            out.append([k])
    return out


def kth_values(
    df: DataFrame,
    exprs: dict[str, Column],
    ranks: dict[str, list[int]] | Callable[[int], list[int]],
    max_distinct: int = MAX_DISTINCT,
    accuracy: int = ACCURACY,
    materialize: bool | None = None,
) -> dict[str, dict[int, object]]:
    """For each named expression, the exact value at each requested 0-based rank
    (nulls ignored). Ranks outside [0, n) give None. ``ranks`` may be a function
    of the non-null count (e.g. the middle ranks for a median).

    The search makes 3-6 passes: a round leaves about 10 / ``accuracy`` of a bracket, and it goes on
    until every bracket is down to ``max_distinct`` values (by ``approx_count_distinct``, so some
    percent more at most). Unless ``df`` is already persisted (or ``materialize`` is False), the named
    expressions alone are checkpointed first, so the passes scan a narrow table instead of recomputing the source."""
    df, exprs = narrow_input(df, exprs, materialize)
    # round 0: sizes and distinct counts of the whole columns (one pass)
    first = df.agg(
        *[F.count(e).alias(f"n_{n}") for n, e in exprs.items()],
        *[F.approx_count_distinct(e).alias(f"d_{n}") for n, e in exprs.items()],
    ).first()
    if callable(ranks):
        ranks = {n: ranks(int(first[f"n_{n}"])) for n in exprs}
    out: dict[str, dict[int, object]] = {n: dict.fromkeys(ks) for n, ks in ranks.items()}
    width = 4.0 / accuracy
    found: list[_Bracket] = []
    wide: list[_Bracket] = []
    for name, ks in ranks.items():
        n, distinct = int(first[f"n_{name}"]), int(first[f"d_{name}"])
        for pair in _neighbours([k for k in ks if 0 <= k < n]):
            (wide if distinct > max_distinct else found).append(_Bracket(name, pair, 0, n, distinct, width))
    while wide:
        # propose: approximate quantiles on both sides of the wanted relative ranks
        aggs = []
        for i, t in enumerate(wide):
            e = exprs[t.name]
            share = [(k - t.below + 0.5) / t.n_in for k in (t.ranks[0], t.ranks[-1])]
            aggs.append(F.percentile_approx(F.when(t.holds(e), e), [max(0.0, share[0] - t.eps), min(1.0, share[1] + t.eps)], accuracy).alias(f"q{i}"))
        proposed = df.agg(*aggs).first()
        # place the proposals by exact counts (one pass)
        aggs = []
        for i, t in enumerate(wide):
            e, (a, b) = exprs[t.name], proposed[f"q{i}"]
            inner = t.holds(e) & (e >= F.lit(a)) & (e <= F.lit(b))
            aggs += [
                F.count_if(t.holds(e) & (e < F.lit(a))).alias(f"l{i}"),
                F.count_if(inner).alias(f"m{i}"),
                F.approx_count_distinct(F.when(inner, e)).alias(f"d{i}"),
            ]
        placed = df.agg(*aggs).first()
        parts = [
            x
            for i, t in enumerate(wide)
            for x in t.cut(*proposed[f"q{i}"], int(placed[f"l{i}"]), int(placed[f"m{i}"]), int(placed[f"d{i}"]), width)
        ]
        found += [x for x in parts if x.distinct <= max_distinct]
        wide = [x for x in parts if x.distinct > max_distinct]
    # read all brackets in one job as a small (bracket, value, count) table
    if found:
        items = F.array(
            *[F.when(t.holds(exprs[t.name]), F.struct(F.lit(i).alias("i"), exprs[t.name].alias("v"))) for i, t in enumerate(found)]
        )
        # only in-bracket slots are emitted (outer + null filter: see rules.triggers_long)
        rows = (
            df.select(F.explode_outer(F.filter(items, lambda x: x.isNotNull())).alias("x"))
            .where(F.col("x").isNotNull())
            .groupBy("x.i", "x.v")
            .agg(F.count(F.lit(1)).alias("c"))
            .collect()
        )
        per: dict[int, list] = {}
        for r in rows:
            per.setdefault(int(r["i"]), []).append((r["v"], int(r["c"])))
        for i, t in enumerate(found):
            seen = t.below
            for v, c in sorted(per.get(i, [])):
                out[t.name].update((k, v) for k in t.ranks if seen <= k < seen + c)
                seen += c
    return out


def kth_of_any_type(df: DataFrame, column: str, k: int) -> object:
    """Value at the 1-based position ``k`` of a column of any ordered type, nulls first (``k`` at most the row count).

    The distinct values with their counts are cut into ranges; the range that holds the position is the only one
    looked into, so neither the driver nor a task sees more than one range of distinct values."""
    from ..session import scratch_path

    spark = df.sparkSession
    order = F.col("v").asc_nulls_first()
    ranges = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "ranges")
    counts.repartitionByRange(ranges, order).withColumn("part", F.spark_partition_id()).write.parquet(path)
    placed = spark.read.parquet(path)
    seen = part = 0
    for r in placed.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        part = r["part"]
        if seen + r["n"] >= k:
            break
        seen += r["n"]
    up_to = F.sum("n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = placed.where(F.col("part") == part).select("v", up_to.alias("up_to"))
    return here.where(F.col("up_to") >= k - seen).orderBy("up_to").first()["v"]


def is_persisted(df: DataFrame) -> bool:
    """True when ``df`` or the frame it is derived from by narrow steps reads cached
    data (then rescans are cheap), e.g. features added on top of a persisted frame."""
    lvl = df.storageLevel
    if lvl.useMemory or lvl.useDisk:
        return True
    try:
        plan = df._jdf.queryExecution().withCachedData().toString()
    except Exception:  # noqa: BLE001 - plan introspection unavailable (e.g. remote sessions)
        return False
    if "InMemoryRelation" not in plan:
        return False
    above = plan.split("InMemoryRelation", 1)[0]  # operators on top of the cached relation
    return not any(op in above for op in ("Join", "Aggregate", "Repartition", "Window", "Generate", "Union"))


def narrow_input(df: DataFrame, exprs: dict[str, Column], materialize: bool | None = None):
    """(frame, exprs) to run several passes on: the expressions checkpointed into the
    shared folder as plain columns, or the input itself when it is already persisted."""
    if materialize is None:
        materialize = not is_persisted(df)
    if not materialize:
        return df, exprs
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    names = {n: f"_k{i}" for i, n in enumerate(exprs)}
    narrow = df.select(*[e.alias(names[n]) for n, e in exprs.items()]).checkpoint(eager=True)
    return narrow, {n: F.col(names[n]) for n in exprs}


def exact_medians(df: DataFrame, columns: list[str] | tuple[str, ...], materialize: bool | None = None) -> dict[str, float | None]:
    """Median of each column over non-null, non-NaN values (mean of the two middle
    values for an even count); None for an all-missing column."""
    exprs = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    vals = kth_values(df, exprs, lambda n: sorted({(n - 1) // 2, n // 2}) if n else [], materialize=materialize)
    out: dict[str, float | None] = {}
    for c in columns:
        got = vals.get(c) or {}
        if not got:
            out[c] = None
            continue
        ks = sorted(got)
        out[c] = (float(got[ks[0]]) + float(got[ks[-1]])) / 2.0
    return out
