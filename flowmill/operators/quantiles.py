"""Exact percentiles without a sort of the table: brackets that are checked, and narrowed until few values are left in them.

The first pass brackets each wanted rank by approximate percentiles.  The second counts the cells below, at the ends of and between
the brackets, so it is known, not trusted, which brackets hold their rank.  A bracket that missed is replaced by the part
of the column on that side; one with more than MOST_INSIDE cells between its ends is narrowed by the approximate percentiles of what
is between them (a pass to find these, a pass to count), some 200 times at each round; and so on until all are small.  Then the
few values inside are counted and ordered, and the ranks are picked.  A run of equal values is counted at an end, never inside, so
ties don't stop the narrowing.  Groups of few cells skip all this: their distinct values are counted and ordered at once.

So no task orders more than MOST_INSIDE + 2 distinct values of a rank (or a small group's ``5 * accuracy``) however large the
table is: 10^11 cells take one round of narrowing (about 4 in ``accuracy`` are inside at first, that is 4 * 10^7).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.functions.expr import INF
from flowmill.storage import bounded, cut

#: First brackets reach twice this number's inverse to either side, so about 4 in so many of a group's cells are inside each.
ACCURACY = 10_000

#: Cells between the ends of a bracket that may be ordered.
MOST_INSIDE = 200_000

#: Parts into which a bracket's cells are cut to narrow it.
GRID = 1000


def _same(groups: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(prefix + g))
    return out


def _wide(targets: DataFrame, groups: list[str], ks: list[int]) -> DataFrame:
    """A row a group with the ends of its brackets, broadcast if there are few groups."""
    ends = [F.max(F.when(F.col("__k") == k, F.col(f"__{x}"))).alias(f"__{x}{k}") for k in ks for x in ("lo", "hi")]
    return bounded(cut(targets.groupBy(*[f"__g{g}" for g in groups]).agg(*ends)))


def _per_rank(df: DataFrame, groups: list[str], ks: list[int], names: Iterable[str]) -> DataFrame:
    """``__h<group>, __k`` and the named columns of each k, from columns ``name<k>``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("__k"), *[F.col(f"{n}{k}").alias(n) for n in names]) for k in ks])).alias("x")
    return df.select(*[F.col(f"__g{g}").alias(f"__h__g{g}") for g in groups], each).select(*[f"__h__g{g}" for g in groups], F.col("x.__k").alias("__h__k"), *[f"x.{n}" for n in names])


def _counted(rows: DataFrame, targets: DataFrame, groups: list[str], ks: list[int]) -> DataFrame:
    """``targets`` with how many cells are below, at the ends of and between their brackets."""
    v, counts = F.col("__v"), []
    for k in ks:
        lo, hi = F.col(f"__lo{k}"), F.col(f"__hi{k}")
        counts += [F.count_if(v < lo).alias(f"__below{k}"), F.count_if(v == lo).alias(f"__first{k}"), F.count_if((v > lo) & (v < hi)).alias(f"__between{k}"), F.count_if((v == hi) & (lo < hi)).alias(f"__last{k}")]
    keys = [f"__g{g}" for g in groups]
    found = rows.join(_wide(targets, groups, ks), _same(groups, "__g")).groupBy(*keys).agg(*counts)
    names = ["__below", "__first", "__between", "__last"]
    joined = targets.drop(*names).join(_per_rank(found, groups, ks, names), _same([*keys, "__k"], "__h"))
    return cut(joined.select(*targets.drop(*names).columns, *names))


def _narrowed(rows: DataFrame, targets: DataFrame, groups: list[str], ks: list[int], accuracy: int) -> DataFrame:
    """``targets`` (:func:`_counted`) with brackets whose ends are among the values between the former ones."""
    v = F.col("__v")
    points = [j / GRID for j in range(1, GRID)]
    grids = [F.percentile_approx(F.when((v > F.col(f"__lo{k}")) & (v < F.col(f"__hi{k}")), v), points, max(accuracy, 10 * GRID)).alias(f"__grid{k}") for k in ks]
    keys = [f"__g{g}" for g in groups]
    found = rows.join(_wide(targets, groups, ks), _same(groups, "__g")).groupBy(*keys).agg(*grids)
    joined = targets.join(_per_rank(found, groups, ks, ["__grid"]), _same([*keys, "__k"], "__h"))
    place = F.floor((F.col("__rank") - F.col("__below") - F.col("__first") + 0.5) / F.col("__between") * GRID).cast("int")  # the rank is after this point
    lo, hi = F.coalesce(F.get("__grid", place - 3), F.col("__lo")), F.coalesce(F.get("__grid", place + 2), F.col("__hi"))
    kept = [c for c in targets.columns if c not in ("__outer_lo", "__outer_hi", "__lo", "__hi")]
    return cut(joined.select(*kept, F.col("__lo").alias("__outer_lo"), F.col("__hi").alias("__outer_hi"), F.when(place >= 3, lo).otherwise(F.col("__lo")).alias("__lo"), hi.alias("__hi")))


def _picked(rows: DataFrame, targets: DataFrame, groups: list[str], ks: list[int]) -> DataFrame:
    """``__g<group>, __k, __value`` of the targets, whose brackets hold few distinct values."""
    keys, wide = [f"__g{g}" for g in groups], _wide(targets, groups, ks)
    inside = F.lit(False)
    for k in ks:
        inside = inside | ((F.col("__v") >= F.col(f"__lo{k}")) & (F.col("__v") <= F.col(f"__hi{k}")))
    values = rows.join(wide, _same(groups, "__g")).where(inside).groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    renamed = targets.select(*[F.col(c).alias(f"__h{c}") for c in keys], "__k", "__rank", "__below", "__lo", "__hi")
    known = values.join(bounded(renamed), _same(keys, "__h") & (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi")))
    before = F.col("__below") + F.coalesce(F.sum("__c").over(Window.partitionBy(*keys, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = known.select(*keys, "__k", "__rank", "__v", "__c", before.alias("__before"))
    return ranked.where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__c"))).select(*keys, "__k", F.col("__v").alias("__value"))


def group_percentiles(cells: DataFrame, groups: list[str], at: Iterable[float], *, value: str = "value", name: str = "q", accuracy: int = ACCURACY, most: int = MOST_INSIDE, measures: dict[str, Column] | None = None) -> DataFrame:
    """``groups, name``: the percentiles ``at`` of each group's values as an array, linear between ranks.

    NULL takes no part; a group of NULLs has no row; NaN is the largest value.  NULLs in group columns are groups.  With
    ``measures``, these aggregates of the cells are there, too, from the first pass; then a group of NULLs has a row, and NULL as array.
    """
    at = [float(q) for q in at]
    if not at or not all(0 <= q <= 1 for q in at):
        raise ValueError("percentiles are from 0 to 1")
    if most < 1 or accuracy < 1:
        raise ValueError("the accuracy and the most cells inside a bracket must be at least 1")
    v, step = F.col(value).cast("double"), 2.0 / accuracy
    near = sorted({min(max(q + d, 0.0), 1.0) for q in at for d in (-step, step)})
    plain = F.nanvl(v, F.lit(INF))  # sorted like NaN, but known to the approximation
    stats = [F.count(v).alias("__n"), F.percentile_approx(plain, near, accuracy).alias("__near"), F.min(v).alias("__min"), F.max(v).alias("__max")]
    first = cut(cells.groupBy(*groups).agg(*stats, *[c.alias(n) for n, c in (measures or {}).items()]))
    rows = cells.select(*groups, v.alias("__v")).where("__v is not null")

    # A target is one rank of one group: q's place rounded down (2 j) and up (2 j + 1).
    small, n, ks = F.col("__n") <= 5 * accuracy, F.col("__n"), list(range(2 * len(at)))

    def target(k: int) -> Column:
        q, rounded = at[k // 2], F.ceil if k % 2 else F.floor
        low = F.col("__near")[near.index(max(q - step, 0.0))] if q > step else F.col("__min")
        high = F.col("__near")[near.index(min(q + step, 1.0))] if q < 1 - step else F.col("__max")
        ends = F.when(small, F.col("__min")).otherwise(low).alias("__lo"), F.when(small, F.col("__max")).otherwise(high).alias("__hi")
        return F.struct(F.lit(k).alias("__k"), rounded((n - 1) * F.lit(q)).cast("long").alias("__rank"), *ends, F.col("__min").alias("__outer_lo"), F.col("__max").alias("__outer_hi"))

    zero, keys = F.lit(0).cast("long"), [f"__g{g}" for g in groups]
    exploded = first.where("__n > 0").select(*[F.col(g).alias(f"__g{g}") for g in groups], "__n", F.explode(F.array(*map(target, ks))).alias("t"))
    targets = cut(exploded.select(*keys, "__n", "t.*", *[zero.alias(f"__{x}") for x in ("below", "first", "between", "last")]))
    ready, values = targets.where(small), None
    left = targets.where(~small)
    while not left.isEmpty():
        counted = _counted(rows, left, groups, ks)
        rank, below, between = F.col("__rank"), F.col("__below"), F.col("__between")
        after = below + F.col("__first") + between
        counted = counted.select("*", (rank < below).alias("__low"), (rank >= after + F.col("__last")).alias("__high"), ((rank >= below + F.col("__first")) & (rank < after)).alias("__inside"))
        held = counted.where("not __low and not __high").drop("__low", "__high")
        ends = held.where("not __inside").select(*keys, "__k", F.when(rank < below + F.col("__first"), F.col("__lo")).otherwise(F.col("__hi")).alias("__value"))
        values = ends if values is None else values.unionByName(ends)
        ready = ready.unionByName(held.where(F.col("__inside") & (between <= most)).drop("__inside"))
        wide = held.where(F.col("__inside") & (between > most)).drop("__inside")
        # A bracket that missed: what is known to hold the rank, less the part on the wrong side.
        missed = counted.where("__low or __high").withColumns({"__outer_hi": F.when(F.col("__low"), F.col("__lo")).otherwise(F.col("__outer_hi")), "__outer_lo": F.when(F.col("__high"), F.col("__hi")).otherwise(F.col("__outer_lo"))})
        missed = missed.withColumns({"__lo": F.col("__outer_lo"), "__hi": F.col("__outer_hi")}).drop("__low", "__high", "__inside")
        left = cut(missed.unionByName(_narrowed(rows, wide, groups, ks, accuracy)) if not wide.isEmpty() else missed)
    picked = _picked(rows, ready, groups, ks)
    values = picked if values is None else picked.unionByName(values)
    found = values.groupBy(*keys).agg(*[F.max(F.when(F.col("__k") == k, F.col("__value"))).alias(f"__value{k}") for k in ks])
    out = first.join(found, _same(groups, "__g"), "left")

    def between_ranks(j: int, q: float) -> Column:
        rank, low, high = (n - 1) * F.lit(q), F.col(f"__value{2 * j}"), F.col(f"__value{2 * j + 1}")
        return F.when((low == high) | (F.floor(rank) == F.ceil(rank)), low).otherwise((F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high)

    if measures is None:
        out = out.where("__n > 0")
    return out.select(*groups, F.when(n > 0, F.array(*[between_ranks(j, q) for j, q in enumerate(at)])).alias(name), *(measures or {}))


def with_percentiles(stats: DataFrame, cells: DataFrame, groups: list[str], at: dict[str, float], *, value: str = "value") -> DataFrame:
    """``stats`` (a row a group) with a column for each percentile named, NULL for groups without values."""
    found = group_percentiles(cells, groups, at.values(), value=value, name="__q").withColumnsRenamed({g: f"__h{g}" for g in groups})
    joined = stats.join(found, _same(groups, "__h"), "left")
    return joined.select(*stats.columns, *[F.col("__q")[k].alias(n) for k, n in enumerate(at)])


def measured_percentiles(cells: DataFrame, groups: list[str], measures: dict[str, Column], at: dict[str, float], *, value: str = "value") -> DataFrame:
    """``groups``, the aggregates and the percentiles, each under its name: of every group, from one first pass over the cells."""
    found = group_percentiles(cells, groups, at.values(), value=value, name="__q", measures=measures)
    return found.select(*groups, *measures, *[F.col("__q")[k].alias(n) for k, n in enumerate(at)])
