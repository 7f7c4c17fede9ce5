"""Interval joins, as-of joins, islands and array statistics on grouped time tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time bins of interval joins; both sides are cut at its multiples.
BIN_US = 3_600_000_000
#: Frames of a block of running values; frames are counted one by one.
BLOCK = 16_384
#: Tasks among which the keys of the wide sorted windows are dealt, so that a task's sort stays small.
PARTS = 96
#: Rows of a table for each of its tasks; beyond PARTS times as many there are more tasks.
ROWS = 65_536
#: So many tasks at most: Spark writes a shuffle to up to 200 without sorting it in memory, as its default has it.
MOST = 200


def parts_of(rows: int) -> int:
    """Tasks for a table of so many rows: PARTS, and on a larger one as many as keep a task's share at ROWS, up to MOST."""
    return min(MOST, max(PARTS, -(-rows // ROWS)))


def _bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first = F.call_function("div", F.col(start), F.lit(width).cast("bigint"))
    last = F.call_function("div", F.col(end) - 1, F.lit(width).cast("bigint"))
    return df.withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))


def interval_pairs(left: DataFrame, right: DataFrame, by: list[str], width: int = BIN_US) -> DataFrame:
    """Overlaps of [l_start, l_end) with [r_start, r_end), cut at the bins' borders: `cut_us` adds up to the whole overlap.

    Both sides are dealt by key and time bin, so that one heat with many periods does not meet in one task. An open
    right end reaches to the latest left end. Rows with a null or empty left interval meet nothing.
    """
    good = left.where("l_start is not null and l_end > l_start")
    latest = good.agg(F.max("l_end").alias("__latest"))
    closed = right.crossJoin(F.broadcast(latest)).withColumn("r_end", F.coalesce("r_end", "__latest")).where("r_end > r_start").drop("__latest")
    pairs = _bins(good, "l_start", "l_end", width).join(_bins(closed, "r_start", "r_end", width), [*by, "__bin"])
    low = F.greatest("l_start", "r_start", F.col("__bin") * width)
    high = F.least("l_end", "r_end", (F.col("__bin") + 1) * width)
    return pairs.withColumn("cut_us", high - low).where("cut_us > 0").drop("__bin")


def with_overlap(left: DataFrame, right: DataFrame, key: list[str], name: str, by: list[str] | None = None) -> DataFrame:
    """`left` with a boolean: does any right interval overlap its own?"""
    hits = interval_pairs(left.select(*dict.fromkeys([*key, *(by or []), "l_start", "l_end"])), right, by or []).select(*key).distinct()
    return left.join(hits.withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def overlap_sums(left: DataFrame, periods: DataFrame, by: list[str], kinds: list[str], seen: DataFrame | None = None, deal: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """`left` with, for each kind, {kind}_n (periods that overlap [l_start, l_end)) and {kind}_us (their time in it).

    `periods` holds by, kind, r_start and r_end (null: open). `seen` (by, `at` and further columns) adds the values of
    its latest row at or before l_end. Ends of intervals, ends of periods and what was seen stand in one sorted window of
    running sums: no pairs, and one shuffle among `parts` tasks, by `deal` (columns of by; else all), which the result
    keeps. Rows with a null or empty interval get 0.
    """
    good = periods.where("r_start is not null and (r_end is null or r_end > r_start)")
    point = F.explode(F.array(F.struct(F.col("r_start").alias("at"), F.lit(1).alias("b"), F.lit(0).alias("e")), F.struct(F.col("r_end").alias("at"), F.lit(0).alias("b"), F.lit(1).alias("e"))))
    points = good.select(*by, "kind", point.alias("p")).where("p.at is not null")
    points = points.select(*by, F.col("p.at").alias("__at"), F.lit(2).alias("__turn"), *[F.when(F.col("kind") == k, F.col(f"p.{x}")).otherwise(0).cast("long").alias(f"__{x}_{k}") for k in kinds for x in "be"])
    real = F.col("l_start").isNotNull() & (F.col("l_end") > F.col("l_start"))
    # at one instant: what is seen, ends of intervals, ends of periods, starts of intervals
    row = F.struct(*left.columns)
    sides = F.array(F.struct(F.col("l_end").alias("at"), F.lit(1).alias("turn"), row.alias("row")), F.struct(F.when(real, F.col("l_start")).alias("at"), F.lit(3).alias("turn"), F.when(F.lit(False), row).alias("row")))
    ends = left.withColumn("__id", F.monotonically_increasing_id()).select(*by, "__id", F.explode(sides).alias("x")).where("x.turn = 1 or x.at is not null")
    ends = ends.select(*by, "__id", F.col("x.at").alias("__at"), F.col("x.turn").alias("__turn"), F.col("x.row").alias("__row"))
    rows = ends.unionByName(points, allowMissingColumns=True)
    values = [c for c in seen.columns if c not in (*by, "at")] if seen is not None else []
    if seen is not None:
        rows = rows.unionByName(seen.select(*by, F.col("at").alias("__at"), F.lit(0).alias("__turn"), F.struct(*values).alias("__seen")), allowMissingColumns=True)
    rows = rows.repartition(parts, *(deal or by))
    so_far = Window.partitionBy(*by).orderBy("__place", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    # time covered up to t: ends of the periods over, less starts of those begun, and t for each open one; from an origin, so that sums stay small
    rows = rows.withColumnRenamed("__at", "__place")  # kept as it is: both windows follow one sort
    rows = rows.withColumn("__at", F.col("__place") - F.first("__place", ignorenulls=True).over(so_far))
    rows = rows.select("*", *[(F.coalesce(f"__e_{k}", F.lit(0)) - F.coalesce(f"__b_{k}", F.lit(0))).alias(f"__d_{k}") for k in kinds])
    sums = [F.coalesce(F.sum(x).over(so_far), F.lit(0)).alias(name) for k in kinds for x, name in ((F.col(f"__b_{k}"), f"b_{k}"), (F.col(f"__e_{k}"), f"e_{k}"), (F.col(f"__d_{k}") * F.col("__at"), f"v_{k}"))]
    found = [F.last("__seen", ignorenulls=True).over(so_far).alias("__found")] if seen is not None else []
    rows = rows.select(*by, "__id", "__at", "__turn", "__row", *sums, *found).where("__id is not null")
    low, high = F.col("__turn") == 3, F.col("__turn") == 1
    out = []
    for k in kinds:
        covered = F.col(f"v_{k}") + (F.col(f"b_{k}") - F.col(f"e_{k}")) * F.col("__at")
        out += [F.max(F.when(high, F.col(f"b_{k}"))).alias(f"bh_{k}"), F.max(F.when(low, F.col(f"e_{k}"))).alias(f"el_{k}"), F.max(F.when(high, covered)).alias(f"ch_{k}"), F.max(F.when(low, covered)).alias(f"cl_{k}")]
    both = rows.groupBy(*by, "__id").agg(F.first("__row", ignorenulls=True).alias("__row"), *out, *[F.first(F.when(high, F.col("__found")), ignorenulls=True).alias("__found") for _ in found])
    new = [x for k in kinds for x in (F.coalesce(F.col(f"bh_{k}") - F.col(f"el_{k}"), F.lit(0)).cast("long").alias(f"{k}_n"), F.coalesce(F.col(f"ch_{k}") - F.col(f"cl_{k}"), F.lit(0)).cast("long").alias(f"{k}_us"))]
    return both.select(*[F.col(c) if c in by else F.col(f"__row.{c}").alias(c) for c in left.columns], *new, *[F.col(f"__found.{v}").alias(v) for v in values])


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], inclusive: bool = True, parts: int | None = None) -> DataFrame:
    """`left` with the `values` of the latest right row at or before `at`: a union and one sorted window, no range join. `parts` deals the keys among so many tasks."""
    bundle = F.struct(*values)
    kind = right.select(bundle.alias("x")).schema["x"].dataType
    rows = left.withColumns({"__side": F.lit(1 if inclusive else 0), "__found": F.lit(None).cast(kind), "__right": F.lit(False)})
    other = right.select(*by, at, F.lit(0 if inclusive else 1).alias("__side"), bundle.alias("__found"), F.lit(True).alias("__right"))
    order = Window.partitionBy(*by).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(other, allowMissingColumns=True)
    both = both.repartition(parts, *by) if parts else both
    out = both.withColumn("__found", F.last("__found", ignorenulls=True).over(order)).where("not __right")
    return out.select(*left.columns, *[F.col(f"__found.{v}").alias(v) for v in values])


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], lasts: dict[str, Column], width: int = BLOCK, parts: int | None = None) -> DataFrame:
    """`df` with running sums and last known values of a key in `order`, each row included.

    A key is cut at multiples of `width` of the first order column (whole numbers). Blocks are summed up by themselves
    and meet only the totals of those before them, so that a long key is not one task. `parts` deals them among so
    many tasks.
    """
    block = F.col(order[0]) - F.pmod(F.col(order[0]), F.lit(width))
    rows = df.withColumn("__block", F.coalesce(block, F.lit(-(1 << 62))))  # without a place: first, as in the order
    key = [*by, "__block"]
    told = F.lit(False)
    for x in (*sums.values(), *lasts.values()):
        told = told | x.isNotNull()
    last = [F.max(F.when(x.isNotNull(), F.struct(*order, x.alias("__x"))))["__x"].alias(f"__t_{name}") for name, x in lasts.items()]
    total = rows.where(told).groupBy(*key).agg(*[F.sum(x).alias(f"__t_{name}") for name, x in sums.items()], *last)
    # one row a block and one of its totals, if it has any
    both = rows.select(*key).distinct().withColumn("__is", F.lit(True)).unionByName(total, allowMissingColumns=True)
    before = Window.partitionBy(*by).orderBy("__block").rangeBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"__t_{name}").over(before).alias(f"__v_{name}") for name in sums] + [F.last(f"__t_{name}", ignorenulls=True).over(before).alias(f"__v_{name}") for name in lasts]
    carry = both.select(*key, "__is", *carried).where("__is").drop("__is").withColumn("__own", F.lit(False))
    # what is carried stands before the rows of its block, so that they need not be joined and dealt again
    own = rows.select("*", *[x.cast("long").alias(f"__v_{name}") for name, x in sums.items()], *[x.alias(f"__v_{name}") for name, x in lasts.items()], F.lit(True).alias("__own"))
    all_rows = own.unionByName(carry, allowMissingColumns=True)
    dealt = all_rows.repartition(parts, *key) if parts else all_rows
    so_far = Window.partitionBy(*key).orderBy("__own", *order).rowsBetween(Window.unboundedPreceding, 0)
    told_so_far = [F.coalesce(F.sum(f"__v_{name}").over(so_far), F.lit(0)).cast("long").alias(name) for name in sums] + [F.last(f"__v_{name}", ignorenulls=True).over(so_far).alias(name) for name in lasts]
    return dealt.select(*df.columns, "__own", *told_so_far).where("__own").drop("__own")


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "island") -> DataFrame:
    """Adds the number of the run that a row belongs to; a new run begins where `breaks` is true."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__break")


def merge_intervals(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a key as one; a null end is open."""
    far = F.lit(9_000_000_000_000_000_000)
    rows = df.select(*by, F.col(start).alias("s"), F.coalesce(F.col(end), far).alias("e"))
    before = F.max("e").over(Window.partitionBy(*by).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", before)
    out = islands(rows, by, ["s", "e"], F.col("__before").isNull() | (F.col("s") > F.col("__before")))
    return out.groupBy(*by, "island").agg(F.min("s").alias(start), F.nullif(F.max("e"), far).alias(end)).drop("island")


def array_median(xs: Column) -> Column:
    """Median of an array, the mean of the middle two; NULL if empty."""
    s = F.sort_array(xs)
    n = F.size(s)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def array_mad(xs: Column, whole: bool = False) -> Column:
    """Median absolute deviation of an array; `whole` cuts each deviation to an integer first."""
    m = array_median(xs)
    return array_median(F.transform(xs, lambda x: F.floor(F.abs(x - m)).cast("double") if whole else F.abs(x - m).cast("double")))


def nearest_rank(xs: Column, q: float) -> Column:
    """The element of rank ceil(q * n), 1 at least."""
    s = F.sort_array(xs)
    return F.when(F.size(s) > 0, F.get(s, F.greatest(F.ceil(F.size(s) * q), F.lit(1)).cast("int") - 1))
