"""Exact order statistics by histogram refinement: counts travel, rows stay.

A value falls into a fixed bin, a monotone function of it alone (``bin_of``: steps of 1/64 octave), so one pass counts
every group's values per bin map-side and ships groups x bins rows, however many rows there are.  A wanted rank lies in
one bin; only rows of such bins are looked at again, counted in ``SPLIT`` equal parts of the bin's actual range, and so on until the
part holds one value or few enough to count each.  Every level is one scan and one small shuffle.

* ``grouped_stats``  — moments and exact quantiles per group;
* ``box_stats``      — quartiles, fences, whiskers and outliers for several groupings of the same rows at once;
* ``RankIndex``      — a written index of a table's values (node totals and sorted values of each leaf) that
  a table or a set of requests looks its ranks up in.

The input is scanned once a level: pass a stored table, or write a derived one first (``session.materialize``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paysift.functions.expr import exact_sum

#: Bins to a doubling of the value; parts of a bin that is refined; a bin of at most SMALL rows has each value counted.
PER_OCTAVE, SPLIT, SMALL = 64, 1024, 4096
#: Rows of a rank index's leaf, which one task sorts.
LEAF = 1 << 17
#: A table of bins is broadcast only if its counted rows are at most this many (some 100 bytes each).
BROADCAST_ROWS = 100_000
_FAR = 1_000_000  # beyond the bins of every finite double


def _materialize(df: DataFrame) -> DataFrame:
    from paysift.session import materialize
    return materialize(df)


def bin_of(v: Column) -> Column:
    """The fixed bin of a double: falls nowhere as the value grows; infinities and NaN (the greatest) have bins of their own."""
    step = F.floor(F.signum(v) * F.log2(1.0 + F.abs(v)) * PER_OCTAVE)
    inside = F.greatest(F.least(step, F.lit(_FAR)), F.lit(-_FAR))
    return F.when(F.isnan(v), F.lit(2 * _FAR)).otherwise(inside).cast("long")


def part_of(v: Column, lo: Column, hi: Column, parts: Column | int) -> Column:
    """Which of ``parts`` equal parts of [lo, hi], lo < hi, holds ``v``; rises with it, and lo and hi fall apart."""
    parts = F.lit(parts) if isinstance(parts, int) else parts
    return F.greatest(F.least(F.floor((v - lo) / (hi - lo) * parts), parts - 1), F.lit(0)).cast("long")


def group_struct(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(k) for k in keys]) if keys else F.struct(F.lit(0).alias("_all"))


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few; else a shuffled join does the same."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


class Bins:
    """The bin counts of a value column under one or several groupings.

    ``dims`` maps a name to a group column (null: the row is left out of that grouping).  The rows are counted by all
    group columns and the bin together, so none is copied; the counts, not the rows, are then added up by grouping.
    ``table`` (checkpointed) has ``_d, _g, _b``, ``rows`` and ``c`` (non-null), ``lo, hi``, exact sum ``s`` (with ``sums``: in decimals
    up to 10^28), mean ``m`` and squares ``m2`` of a bin, the group's ``n``, and ``below``: values in lower bins.
    """

    def __init__(self, df: DataFrame, dims: Mapping[str, Column], value: Column, sums: bool = False) -> None:
        self.names = list(dims)
        self.rows = df.select(*[c.alias(f"_g{i}") for i, c in enumerate(dims.values())], value.cast("double").alias("_v"))
        self.keys = [f"_g{i}" for i in range(len(dims))]
        v = F.col("_v")
        fine = self.rows.groupBy(*self.keys, bin_of(v).alias("_b")).agg(
            F.count(F.lit(1)).alias("rows"), F.count(v).alias("c"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            (exact_sum(v) if sums else F.lit(None).cast("decimal(38,10)")).alias("s"), F.avg(v).alias("m"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("m2"))
        if len(dims) == 1:
            bins = fine.select(F.lit(0).alias("_d"), F.col("_g0").alias("_g"), *fine.columns[1:])
        else:
            bins = self._merged(self._long(fine))
        by_group = Window.partitionBy("_d", "_g")
        self.table = _materialize(bins.where(F.col("_g").isNotNull())
                                  .withColumn("n", F.sum("c").over(by_group))
                                  .withColumn("below", F.coalesce(F.sum("c").over(by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
                                  .withColumn("mean", F.try_divide(F.sum(F.col("m") * F.col("c")).over(by_group), F.col("n"))))

    def _long(self, df: DataFrame) -> DataFrame:
        """A row for each grouping that takes part, instead of the group columns."""
        pairs = F.array(*[F.struct(F.lit(i).alias("d"), F.col(k).alias("g")) for i, k in enumerate(self.keys)])
        rest = [c for c in df.columns if c not in self.keys]
        return df.select(F.explode(pairs).alias("_x"), *rest).select(F.col("_x.d").alias("_d"), F.col("_x.g").alias("_g"), *rest).where(F.col("_g").isNotNull())

    @staticmethod
    def _merged(long: DataFrame) -> DataFrame:
        """Bins of the same group added up; a part's squares about its own mean are moved to the merged one."""
        c = F.col("c")
        both = long.groupBy("_d", "_g", "_b").agg(
            F.sum("rows").alias("rows"), F.sum(c).alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").cast("decimal(38,10)").alias("s"),
            F.try_divide(F.sum(F.col("m") * c), F.sum(c)).alias("m"),
            F.sum("m2").alias("m2"), F.sum(c * F.col("m") * F.col("m")).alias("_mm"))
        spread = F.greatest(F.col("_mm") - F.col("c") * F.col("m") * F.col("m"), F.lit(0.0))
        return both.withColumn("m2", F.coalesce(F.col("m2") + spread, F.lit(0.0))).drop("_mm")

    def stats(self, wanted: Mapping[str, str]) -> DataFrame:
        """``_d, _g`` and a column for each of ``wanted``: ``rows``, ``count``, ``min``, ``max``, ``sum``, ``sum_squares``,
        ``std`` (n - 1), or ``mean:<digits>`` (exact, rounded once, half-even)."""
        c, m = F.col("c"), F.col("m")
        n = F.sum(c)

        def one(kind: str) -> Column:
            if kind.startswith("mean:"):
                return F.when(n > 0, F.bround(F.try_divide(F.sum("s"), n).cast("double"), int(kind[5:])))
            about = F.sum(F.col("m2") + F.coalesce(c * (m - F.col("mean")) * (m - F.col("mean")), F.lit(0.0)))
            return {"rows": lambda: F.sum("rows"), "count": lambda: n, "min": lambda: F.min("lo"), "max": lambda: F.max("hi"),
                    "sum": lambda: F.sum("s").cast("double"), "sum_squares": lambda: F.sum(F.col("m2") + F.coalesce(c * m * m, F.lit(0.0))),
                    "std": lambda: F.when(n > 1, F.sqrt(about / (n - 1)))}[kind]()

        return self.table.groupBy("_d", "_g").agg(*[one(k).alias(name) for name, k in wanted.items()])

    def rows_within(self, spans: DataFrame, count: int) -> DataFrame:
        """``spans`` (``_d, _g, _b, lo, hi``, so many) joined with the values ``_v`` of their groups that lie in them."""
        spans = small(spans, count)
        if len(self.keys) == 1:
            rows = self.rows.select(F.lit(0).alias("_d"), F.col("_g0").alias("_g"), "_v")
        else:  # only rows of these bins are dealt to their groupings
            wanted = small(spans.select("_b").distinct(), count)
            rows = self._long(self.rows.withColumn("_b", bin_of(F.col("_v"))).join(wanted, "_b", "left_semi").drop("_b"))
        r = rows.where(F.col("_g").isNotNull()).select(F.col("_d").alias("_rd"), F.col("_g").alias("_rg"), "_v")
        return r.join(spans, (r["_rd"] == spans["_d"]) & (r["_rg"] == spans["_g"]) & r["_v"].between(spans["lo"], spans["hi"])).drop("_rd", "_rg")

    def quantiles(self, probs: Mapping[str, float]) -> DataFrame:
        """``_d, _g`` and an exact, linearly interpolated quantile for each name; groups without values have none."""
        ranks = F.array(*[F.struct(F.lit(name).alias("q"), F.lit(upper).alias("up"), F.lit(float(p)).alias("p")) for name, p in probs.items() for upper in (False, True)])
        pos = F.col("w.p") * (F.col("n") - 1)
        rank = F.when(F.col("w.up"), F.ceil(pos)).otherwise(F.floor(pos))
        at = (self.table.where("c > 0").withColumn("w", F.explode(ranks)).withColumn("r", rank - F.col("below"))
              .where((F.col("r") >= 0) & (F.col("r") < F.col("c")))
              .select("_d", "_g", "_b", "w.q", "w.up", (pos - F.floor(pos)).alias("frac"), "r", "c", "lo", "hi"))
        found, last = None, False
        value = F.when((F.col("lo") == F.col("hi")) | (F.col("r") == 0), F.col("lo")).when(F.col("r") == F.col("c") - 1, F.col("hi"))
        while True:
            at = at.withColumn("value", value)
            done = at.where("value IS NOT NULL").select("_d", "_g", "q", "up", "frac", "value")
            found = done if found is None else found.unionByName(done)
            left = at.where("value IS NULL").drop("value")
            if last:  # the parts of the level before held a value each
                break
            spans = left.select("_d", "_g", "_b", "lo", "hi", "c").distinct()
            count, most = spans.agg(F.count(F.lit(1)), F.max("c")).first()
            if not count:
                break
            at, last = self._refined(left, spans, count), most <= SMALL
            at = at if last else _materialize(at)

        def picked(name: str, up: bool, what: str = "value") -> Column:
            return F.max(F.when((F.col("q") == name) & (F.col("up") == up), F.col(what)))

        ends = found.groupBy("_d", "_g").agg(*[picked(name, up).alias(f"_{i}{int(up)}") for i, name in enumerate(probs) for up in (False, True)],
                                             *[picked(name, True, "frac").alias(f"_{i}f") for i, name in enumerate(probs)])
        low, high = (lambda i: F.col(f"_{i}0")), (lambda i: F.col(f"_{i}1"))
        between = lambda i: F.when(low(i) == high(i), low(i)).otherwise(low(i) + (high(i) - low(i)) * F.col(f"_{i}f"))
        return ends.select("_d", "_g", *[between(i).alias(name) for i, name in enumerate(probs)])

    def _refined(self, left: DataFrame, spans: DataFrame, count: int) -> DataFrame:
        """The wanted ranks of ``left``, each with the part of its bin, one of ``spans``, that holds it."""
        few = F.col("c") <= SMALL
        parts = (self.rows_within(spans, count)
                 .withColumn("_p", F.when(few, F.lit(0).cast("long")).otherwise(part_of(F.col("_v"), F.col("lo"), F.col("hi"), SPLIT)))
                 .withColumn("_x", F.when(few, F.col("_v")))
                 .groupBy("_d", "_g", "_b", "lo", "hi", "_p", "_x").agg(F.count(F.lit(1)).alias("c2"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2")))
        w = Window.partitionBy("_d", "_g", "lo", "hi").orderBy("_p", "_x").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("under", F.coalesce(F.sum("c2").over(w), F.lit(0))).drop("_p", "_x", "_b")
        inside = (F.col("r") >= F.col("under")) & (F.col("r") < F.col("under") + F.col("c2"))
        return (left.join(parts, ["_d", "_g", "lo", "hi"]).where(inside)
                .select("_d", "_g", "_b", "q", "up", "frac", (F.col("r") - F.col("under")).alias("r"), F.col("c2").alias("c"), F.col("lo2").alias("lo"), F.col("hi2").alias("hi")))


def _named(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in ("_d", "_g")]
    return df.select(*[F.col("_g")[k].alias(k) for k in keys], *rest)


def grouped_stats(df: DataFrame, keys: Sequence[str], value: str, stats: Mapping[str, str], probs: Mapping[str, float]) -> DataFrame:
    """Per group of ``keys`` (null is a group): ``stats`` (see ``Bins.stats``) and exact quantiles of the non-null values,
    null where a group has none."""
    b = Bins(df, {"": group_struct(keys)}, F.col(value), sums=any(k == "sum" or k.startswith("mean") for k in stats.values()))
    return _named(b.stats(stats).join(b.quantiles(probs), ["_d", "_g"], "left"), keys)


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per group: ``keys + list(probs)``."""
    return grouped_stats(df, keys, value, {"_rows": "rows"}, probs).drop("_rows")


def box_stats(df: DataFrame, dims: Mapping[str, Column], value: str) -> tuple[DataFrame, list[str]]:
    """Box plots of several groupings in shared passes: ``_d`` (a place in the names that are returned too), ``_g``, quartiles, 1.5 IQR fences, whisker ends,
    ``n_outliers`` and ``n``.  Bins wholly inside or outside the fences answer from their counts; the rows of those that a fence
    cuts are looked at once more."""
    b = Bins(df, dims, F.col(value))
    iqr = F.col("q3") - F.col("q1")
    q = _materialize(b.quantiles({"q1": 0.25, "median": 0.5, "q3": 0.75})
                     .withColumn("fence_low", F.col("q1") - 1.5 * iqr).withColumn("fence_high", F.col("q3") + 1.5 * iqr))
    fenced = b.table.where("c > 0").join(q.select("_d", "_g", "fence_low", "fence_high"), ["_d", "_g"])
    inside = (F.col("lo") >= F.col("fence_low")) & (F.col("hi") <= F.col("fence_high"))
    outside = (F.col("hi") < F.col("fence_low")) | (F.col("lo") > F.col("fence_high"))
    whole = fenced.where(inside | outside).select(
        "_d", "_g", F.when(inside, F.col("lo")).alias("wl"), F.when(inside, F.col("hi")).alias("wh"), F.when(outside, F.col("c")).otherwise(0).alias("out"), "c")
    cut = fenced.where(~(inside | outside)).select("_d", "_g", "_b", "lo", "hi", "fence_low", "fence_high")
    v = F.col("_v")
    kept = v.between(F.col("fence_low"), F.col("fence_high"))
    near = (b.rows_within(cut, cut.count()).groupBy("_d", "_g").agg(
        F.min(F.when(kept, v)).alias("wl"), F.max(F.when(kept, v)).alias("wh"), F.count_if(~kept).alias("out"), F.count(F.lit(1)).alias("c")))
    ends = (whole.unionByName(near).groupBy("_d", "_g").agg(
        F.min("wl").alias("whisker_low"), F.max("wh").alias("whisker_high"), F.sum("out").cast("long").alias("n_outliers"), F.sum("c").cast("long").alias("n")))
    return q.join(ends, ["_d", "_g"]), b.names


class RankIndex:
    """Where a value stands among the values of its group, from a written index.

    The index is a forest: a group's bins, those over ``leaf`` rows of different values split into parts of their range, and so on.
    A node knows how many of the group's values lie before it; a leaf's values are written in order with the count below
    each.  Building it shuffles the rows once, merged by value.  A table's own values find their row in it by an
    equi-join; other values go down the nodes to a leaf and to the last value below them.  Neither sorts the data again.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], value: str, leaf: int = LEAF) -> None:
        self.keys = list(keys)
        self.bins = Bins(df.where(F.col(value).isNotNull()), {"": group_struct(keys)}, F.col(value))
        rows = self.bins.rows.select(F.col("_g0").alias("_g"), "_v", F.array(bin_of(F.col("_v"))).alias("path"))
        nodes = self.bins.table.select("_g", F.array("_b").alias("path"), "c", "lo", "hi", F.col("below").alias("before"))
        self.levels = []
        while True:
            parts = F.when((F.col("c") > leaf) & (F.col("lo") < F.col("hi")), F.greatest(F.lit(2), F.ceil(4 * F.col("c") / leaf)))
            nodes = nodes.withColumn("parts", parts.cast("long"))
            nodes = _materialize(nodes) if self.levels else nodes  # the first is a view of the bins' table
            self.levels.append(nodes)
            split = nodes.where("parts IS NOT NULL")
            if split.isEmpty():
                break
            rows = self._down(rows, split)
            child = rows.where(F.size("path") == len(self.levels) + 1).groupBy("_g", "path").agg(
                F.count(F.lit(1)).alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
            parent = split.select("_g", F.col("path").alias("up"), F.col("before").alias("start"))
            w = Window.partitionBy("_g", "up").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
            nodes = (child.withColumn("up", F.slice("path", 1, len(self.levels))).join(parent, ["_g", "up"])
                     .withColumn("before", F.col("start") + F.coalesce(F.sum("c").over(w), F.lit(0))).select("_g", "path", "c", "lo", "hi", "before"))
        leaves = None
        for level in self.levels:
            own = level.where("parts IS NULL").select("_g", "path", "before")
            leaves = own if leaves is None else leaves.unionByName(own)
        w = Window.partitionBy("_g", "path").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
        each = rows.groupBy("_g", "path", "_v").agg(F.count(F.lit(1)).alias("c")).withColumn("_in", F.coalesce(F.sum("c").over(w), F.lit(0)))
        self.values = _materialize(each.join(leaves, ["_g", "path"]).select("_g", "path", "_v", "c", (F.col("before") + F.col("_in")).alias("_below")))
        self.sizes = self.bins.table.groupBy("_g").agg(F.max("n").alias("_n"))

    @staticmethod
    def _down(rows: DataFrame, split: DataFrame) -> DataFrame:
        """Rows one level deeper where their node is split."""
        s = small(split.select(F.col("_g").alias("_sg"), F.col("path").alias("_sp"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "parts"))
        j = rows.join(s, (rows["_g"] == s["_sg"]) & (rows["path"] == s["_sp"]), "left")
        path = F.when(F.col("parts").isNotNull(), F.concat("path", F.array(part_of(F.col("_v"), F.col("_lo"), F.col("_hi"), F.col("parts"))))).otherwise(F.col("path"))
        return j.withColumn("path", path).drop("_sg", "_sp", "_lo", "_hi", "parts")

    def of_table(self, df: DataFrame, value: str, probs: Mapping[str, float] | None = None) -> DataFrame:
        """``df``, rows of the indexed table, with ``_below`` (null where the value is null), the group's ``_n`` and,
        with ``probs``, its quantiles."""
        at = self.values.select(F.col("_g").alias("_ig"), F.col("_v").alias("_iv"), "_below")
        n = self.about(probs).withColumnRenamed("_g", "_ng")
        d = df.withColumn("_g", group_struct(self.keys)).withColumn("_v", F.col(value).cast("double"))
        j = d.join(at, (d["_g"] == at["_ig"]) & (d["_v"] == at["_iv"]), "left")
        return j.join(n, F.col("_g") == F.col("_ng"), "left").drop("_g", "_v", "_ig", "_iv", "_ng")

    def about(self, probs: Mapping[str, float] | None = None) -> DataFrame:
        """``_g, _n`` and quantiles of every group."""
        return self.sizes.join(self.bins.quantiles(probs).drop("_d"), "_g", "left") if probs else self.sizes

    def of_requests(self, asked: DataFrame) -> DataFrame:
        """For distinct (``_g``, ``_v``), values of any table: ``_below``, the group's values that are less (0 for an unknown group)."""
        here = asked.select("_g", "_v").where(F.col("_v").isNotNull()).distinct().select("_g", "_v", F.array(bin_of(F.col("_v"))).alias("path"), F.lit(0).cast("long").alias("start"))
        settled = None
        for depth, level in enumerate(self.levels, 1):
            up = F.slice("path", 1, depth - 1)
            # nodes and the places where requests fall, in order: what ends before a place is below it
            nodes = level.select("_g", "path", "before", (F.col("before") + F.col("c")).alias("end"), "lo", "hi", "parts", F.lit(False).alias("ask"))
            places = here.select("_g", "path").distinct().select("_g", "path", *[F.lit(None).cast("long").alias(c) for c in ("before", "end")],
                                                                  *[F.lit(None).cast("double").alias(c) for c in ("lo", "hi")], F.lit(None).cast("long").alias("parts"), F.lit(True).alias("ask"))
            group = Window.partitionBy("_g", "_up").orderBy("path", "ask")
            line = (nodes.unionByName(places).withColumn("_up", up)
                    .withColumn("_last", F.last(F.when(~F.col("ask"), F.struct("path", "before", "end", "lo", "hi", "parts")), ignorenulls=True).over(group))
                    .where("ask").select(F.col("_g").alias("_pg"), F.col("path").alias("_pp"), "_last"))
            at = here.join(line, (here["_g"] == line["_pg"]) & (here["path"] == line["_pp"])).drop("_pg", "_pp")
            inside = F.col("_last").isNotNull() & (F.col("_last.path") == F.col("path"))
            outside = at.where(~F.coalesce(inside, F.lit(False))).select("_g", "_v", F.coalesce(F.col("_last.end"), F.col("start")).alias("_below"))
            leaf = at.where(inside & F.col("_last.parts").isNull()).select("_g", "_v", "path", F.col("_last.before").alias("start"))
            for part in (outside, self._in_leaf(leaf)):
                settled = part if settled is None else settled.unionByName(part)
            l_ = F.col("_last")
            here = at.where(inside & F.col("_last.parts").isNotNull()).select(
                "_g", "_v", F.concat("path", F.array(part_of(F.col("_v"), l_["lo"], l_["hi"], l_["parts"]))).alias("path"), l_["before"].alias("start"))
        return settled

    def _in_leaf(self, asked: DataFrame) -> DataFrame:
        known = self.values.join(asked.select("_g", "path").distinct(), ["_g", "path"], "left_semi").select(
            "_g", "path", "_v", "_below", (F.col("_below") + F.col("c")).alias("end"), F.lit(None).cast("long").alias("start"), F.lit(False).alias("ask"))
        both = known.unionByName(asked.select("_g", "path", "_v", F.lit(None).cast("long").alias("_below"), F.lit(None).cast("long").alias("end"), "start", F.lit(True).alias("ask")))
        w = Window.partitionBy("_g", "path").orderBy("_v", "ask")
        last = F.last(F.when(~F.col("ask"), F.struct("_v", "_below", "end")), ignorenulls=True).over(w)
        line = both.withColumn("_last", last).where("ask")
        return line.select("_g", "_v", F.when(F.col("_last").isNull(), F.col("start")).when(F.col("_last._v") == F.col("_v"), F.col("_last._below"))
                           .otherwise(F.col("_last.end")).alias("_below"))


def rank_below(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float] | None = None, leaf: int = LEAF) -> DataFrame:
    """Per row: ``_below`` = rows of its group with a strictly smaller ``value`` (``rank() - 1``) and ``_n`` = non-null rows of
    the group; with ``probs`` the group's exact quantiles too."""
    return RankIndex(df, keys, value, leaf).of_table(df, value, probs)
