"""Exact quantiles (linear interpolation) that do not pull a column into one task.

One pass makes a mergeable summary of every column, whose rank error is bounded, and so a bracket around each quantile.
One pass counts the values below and inside each bracket, which proves it; one more orders the few values inside, equal
ones as one counted row.  Only a bracket that holds very many values is narrowed first.  Values stay in wide rows until
those inside a bracket are picked: nothing is copied, and only bounds are kept between passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

INSIDE = 2_000_000  # values a bracket may hold before it is narrowed further
GRID = 200
BROADCAST_GROUPS = 100_000  # groups up to which their bounds are broadcast


class _Brackets:
    """Bounds of each (column, probability) per group: a row of numbers without groups, joined to the rows otherwise."""

    def __init__(self, work: DataFrame, by: list[str], frame: DataFrame):
        self.by = by
        if by:
            self.frame = durable(frame)
            keyed = self.frame.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *[c for c in frame.columns if c not in by])
            same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
            # a join by few groups would send each of them to one task
            keyed = F.broadcast(keyed) if self.frame.count() <= BROADCAST_GROUPS else keyed
            self.rows = work.join(keyed, same).drop(*(f"_by{i}" for i in range(len(by))))
        else:
            self.values = frame.first()  # a few numbers per column
            self.rows = work

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if self.by else F.lit(self.values[name])

    @property
    def wide(self) -> bool:
        return not self.frame.filter("wide").isEmpty() if self.by else self.values["wide"]

    def narrower(self, before: _Brackets, cells) -> bool:
        """Whether some bound moved inwards."""
        names = [(f"{n}_{j}_{i}", n) for j, i in cells for n in ("lo", "hi")]
        if not self.by:
            pairs = [(self.values[c], before.values[c], n) for c, n in names if self.values[c] is not None]
            return any(new > old if n == "lo" else new < old for new, old, n in pairs)
        old = before.frame.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(self.by)], *[F.col(c).alias(f"old_{c}") for c, _ in names])
        moved = [F.col(c) > F.col(f"old_{c}") if n == "lo" else F.col(c) < F.col(f"old_{c}") for c, n in names]
        both = self.frame.join(old, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(self.by)])
        return not both.filter(_some(moved)).isEmpty()

    def known(self, found: DataFrame, names) -> DataFrame:
        """``found``, rows of (group, j, i), with the numbers ``names`` of each."""
        cells = [(int(j), int(i)) for j, i in (c.split("_")[1:] for c in (self.frame.columns if self.by else self.values.__fields__) if c.startswith("at_"))]
        if not self.by:
            place = F.element_at(F.create_map(*(x for k, (j, i) in enumerate(cells) for x in (F.lit(f"{j}_{i}"), F.lit(k + 1)))), F.concat_ws("_", "j", "i"))
            return found.withColumns({n: F.element_at(F.array(*(self[f"{n}_{j}_{i}"] for j, i in cells)), place) for n in names})
        rows = F.array(*(F.struct(F.lit(j).alias("_j"), F.lit(i).alias("_i"), *(F.col(f"{n}_{j}_{i}").alias(n) for n in names)) for j, i in cells))
        side = self.frame.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(self.by)], F.inline(rows))
        same = [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(self.by)] + [F.col("j") == F.col("_j"), F.col("i") == F.col("_i")]
        return found.join(side, same)


def _some(tests) -> Column:
    return F.greatest(*[F.coalesce(test, F.lit(False)) for test in tests], F.lit(False))


def _inside(at: _Brackets, j: int, i: int) -> Column:
    return (F.col(f"_v{j}") >= at[f"lo_{j}_{i}"]) & (F.col(f"_v{j}") <= at[f"hi_{j}_{i}"])


def _counted(work: DataFrame, at: _Brackets, cells, most: int) -> _Brackets:
    """The same brackets with the number of values below and inside; ``wide`` if one holds more than ``most`` different ones."""
    kept = [F.first(at[f"{n}_{j}_{i}"]).alias(f"{n}_{j}_{i}") for j, i in cells for n in ("at", "lo", "hi")]
    below = [F.count_if(F.col(f"_v{j}") < at[f"lo_{j}_{i}"]).alias(f"below_{j}_{i}") for j, i in cells]
    inside = [F.count_if(_inside(at, j, i)).alias(f"in_{j}_{i}") for j, i in cells]
    wide = _some((F.col(f"in_{j}_{i}") > most) & (F.col(f"lo_{j}_{i}") < F.col(f"hi_{j}_{i}")) for j, i in cells)
    return _Brackets(work, at.by, at.rows.groupBy(*at.by).agg(*kept, *below, *inside).withColumn("wide", wide))


def _narrowed(work: DataFrame, at: _Brackets, cells, most: int) -> _Brackets:
    """Brackets with more than ``most`` values cut down to a few steps of a grid of quantiles of what is inside."""
    marks = F.array(*(F.lit(g / GRID) for g in range(GRID + 1)))
    grids = at.rows.groupBy(*at.by).agg(
        *[F.first(at[f"{n}_{j}_{i}"]).alias(f"{n}_{j}_{i}") for j, i in cells for n in ("at", "lo", "hi", "below", "in")],
        *[F.percentile_approx(F.when(_inside(at, j, i) & (at[f"in_{j}_{i}"] > most), F.col(f"_v{j}")), marks, 20 * GRID).alias(f"grid_{j}_{i}")
          for j, i in cells])
    moved = []
    for j, i in cells:
        cell = lambda n: F.col(f"{n}_{j}_{i}")  # noqa: E731, B023
        share = (cell("at") - cell("below")) / cell("in") * GRID
        low, high = F.greatest(F.floor(share).cast("int") - 1, F.lit(0)), F.least(F.ceil(share).cast("int") + 2, F.lit(GRID))
        wide = cell("grid").isNotNull()
        moved += [cell("at"), F.when(wide & (low > 0), F.get(cell("grid"), low)).otherwise(cell("lo")).alias(f"lo_{j}_{i}"),
                  F.when(wide & (high < GRID), F.get(cell("grid"), high)).otherwise(cell("hi")).alias(f"hi_{j}_{i}")]
    return _Brackets(work, at.by, grids.select(*at.by, *moved))


def quantiles(df: DataFrame, columns, probs, names, by=(), accuracy: int = 20_000, inside: int = INSIDE, besides=None) -> DataFrame:
    """One row per group and column (``parameter``) with one output column per probability; nulls are left out.

    ``besides`` names other aggregates of each column, functions of the column, that the first pass takes along; only without
    groups.
    """
    columns, by, besides = list(columns), list(by), besides or {}
    if by and besides:
        raise ValueError("other aggregates are taken along only without groups")
    if not columns:
        nothing = [F.lit(None).cast("double").alias(name) for name in (*names, *besides)]
        return df.select(*by, F.lit("").alias("parameter"), *nothing).limit(0)
    cells = [(j, i) for j in range(len(columns)) for i in range(len(probs))]
    work = df.select(*by, *[(F.lit(0.0) + F.col(c).cast("double")).alias(f"_v{j}") for j, c in enumerate(columns)])
    slack = 2.0 / accuracy
    marks = [max(0.0, p - slack) for p in probs] + [min(1.0, p + slack) for p in probs]
    summary = work.groupBy(*by).agg(*[f.alias(f"{name}_{j}") for j in range(len(columns)) for name, f in (
        ("n", F.count(f"_v{j}")), ("m", F.percentile_approx(f"_v{j}", F.array(*map(F.lit, marks)), accuracy)),
        ("least", F.min(f"_v{j}")), ("most", F.max(f"_v{j}")), *((f"also_{k}", f(F.col(f"_v{j}"))) for k, f in enumerate(besides.values())))])
    bounds = [F.col(f"also_{k}_{j}") for j in range(len(columns)) for k in range(len(besides))]
    for j, i in cells:
        few = F.col(f"n_{j}") * slack < 4  # the summary's bracket may end a rank short: everything is inside then
        low = F.when(few | F.lit(marks[i] == 0.0), F.col(f"least_{j}")).otherwise(F.col(f"m_{j}")[i])
        high = F.when(few | F.lit(marks[len(probs) + i] == 1.0), F.col(f"most_{j}")).otherwise(F.col(f"m_{j}")[len(probs) + i])
        bounds += [(F.lit(float(probs[i])) * (F.col(f"n_{j}") - 1)).alias(f"at_{j}_{i}"), low.alias(f"lo_{j}_{i}"), high.alias(f"hi_{j}_{i}")]
    at = _Brackets(work, by, summary.select(*by, *bounds))
    also = [F.element_at(F.array(*(at[f"also_{k}_{j}"] for j in range(len(columns)))), F.col("j") + 1).alias(name) for k, name in enumerate(besides)]
    at = _counted(work, at, cells, inside)
    while at.wide:
        before = at
        at = _counted(work, _narrowed(work, at, cells, inside), cells, inside)
        if not at.narrower(before, cells):
            break
    picked = F.array(*(F.when(_inside(at, j, i), F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"), F.col(f"_v{j}").alias("value")))
                       for j, i in cells))
    placed = at.rows.select(*by, F.inline(F.filter(picked, lambda x: x.isNotNull()))).groupBy(*by, "j", "i", "value").agg(F.count("*").alias("c"))
    order = Window.partitionBy(*by, "j", "i").orderBy("value")
    running = placed.repartition(*by, "j").withColumn("upto", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = at.known(running, ("at", "below")).withColumn("upto", F.col("upto") + F.col("below"))
    covers = lambda rank: (F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank)
    ends = found.groupBy(*by, "j", "i").agg(
        F.max("at").alias("at"), F.max(F.when(covers(F.floor("at")), F.col("value"))).alias("a"),
        F.max(F.when(covers(F.ceil("at")), F.col("value"))).alias("b"))
    value = F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))
    wide = ends.withColumn("value", value).groupBy(*by, "j").agg(*(F.max(F.when(F.col("i") == i, F.col("value"))).alias(name) for i, name in enumerate(names)))
    return wide.select(*by, F.element_at(F.array(*map(F.lit, columns)), F.col("j") + 1).alias("parameter"), *names, *also)
