"""Ordered-history operators that stay bounded when one key holds most of the rows.

A window partition is one task's work, so a plain ``Window.partitionBy(key)`` is used only after a
map-side-combined count has shown that no key exceeds the row limit.  Beyond it the timeline is cut
into range-partitioned slices: trailing frames receive the last rows of earlier slices as a halo, and
running totals receive a carry from a prefix sum over slice totals.  Both forms give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.plans.durable import spool

GROUP_LIMIT_CONF = "spark.matchloom.maxGroupRows"
#: Rows of a key, and of a task, that are sorted together; a recursion, which keeps no sort, takes more in one piece.
DEFAULT_GROUP_LIMIT, RECURSION_LIMIT = 250_000, 1_000_000

SLICE, HALO = "_slice", "_halo"


def group_limit(spark: SparkSession, default: int = DEFAULT_GROUP_LIMIT) -> int:
    return int(spark.conf.get(GROUP_LIMIT_CONF, str(default)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """(rows in the largest key group, rows in all); one row reaches the driver."""
    if keys:
        counts = df.groupBy(*keys).count()
    else:
        counts = df.agg(F.count(F.lit(1)).alias("count"))
    row = counts.agg(F.max("count").alias("m"), F.sum("count").alias("n")).first()
    return int(row["m"] or 0), int(row["n"] or 0)


def cut_into_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, total: int) -> DataFrame:
    """Range-partition on (keys, order) and tag each row with its slice; slices follow the sort order."""
    parts = max(2, math.ceil(total / max(1, rows)))
    ranged = df.repartitionByRange(parts, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return spool(ranged, "slices")


def _prior(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, -1)


class Timeline:
    """Rows of ``df`` grouped by ``keys`` and totally ordered by ``order`` (whose last column is unique)."""

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        eligible: str | None = None,
        sizes: tuple[int, int] | None = None,
        chain: bool = False,
    ):
        """``chain`` keeps the slice column in results, so that ``again`` can continue without a new cut."""
        self.keys, self.order, self.eligible, self.chain = list(keys), list(order), eligible, chain
        limit = group_limit(df.sparkSession)
        self.sizes = sizes or largest_group(df, self.keys)
        self.sliced = self.sizes[0] > limit
        cut = SLICE in df.columns
        self.df = cut_into_slices(df, self.keys, self.order, limit, self.sizes[1]) if self.sliced and not cut else df
        self.columns = [c for c in df.columns if c != SLICE] + ([SLICE] if chain and self.sliced else [])
        #: Whether the rows of a key came together in an earlier step, and whether a step of this object brought them together.
        self.placed = self.dealt = False

    def again(self, df: DataFrame, eligible: str | None = None) -> Timeline:
        """The result of a step, with more columns: group sizes (and slices) are already known, and whole keys lie together."""
        line = Timeline(df, self.keys, self.order, eligible or self.eligible, self.sizes, self.chain)
        line.placed = line.dealt = self.dealt
        return line

    # -- shared pieces -------------------------------------------------------------------------

    @property
    def _cells(self) -> list[str]:
        return [*self.keys, SLICE] if self.sliced else self.keys

    def _spec(self, *extra: str) -> WindowSpec:
        return Window.partitionBy(*self._cells, *extra).orderBy(*self.order)

    def _used(self) -> Column:
        return F.coalesce(F.col(self.eligible), F.lit(False)) if self.eligible else F.lit(True)

    def _slice_prefix(self, totals: DataFrame, sums: Sequence[str], maxes: Sequence[str] = ()) -> DataFrame:
        """Totals of all earlier slices of the same key; one row per (key, slice)."""
        before = _prior(Window.partitionBy(*self.keys).orderBy(SLICE))
        return totals.select(
            *self._cells,
            *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums],
            *[F.max(c).over(before).alias(c) for c in maxes],
        )

    def _with_halo(self, width: int) -> DataFrame:
        """Add to each slice the last ``width`` used rows that precede it."""
        body = self.df.withColumn(HALO, F.lit(False))
        totals = self.df.groupBy(*self._cells).agg(F.count(F.when(self._used(), 1)).alias("_n"))
        per_key = Window.partitionBy(*self.keys)
        spans = (
            totals.withColumn("_before", F.coalesce(F.sum("_n").over(_prior(per_key.orderBy(SLICE))), F.lit(0)))
            .withColumn("_parts", F.count(F.lit(1)).over(per_key))
            .filter("_parts > 1")
        )
        backwards = Window.partitionBy(*self._cells).orderBy(*[F.col(c).desc() for c in self.order])
        tails = (
            self.df.filter(self._used())
            .join(spans.select(*self._cells, "_n", "_before"), self._cells)
            .withColumn("_back", F.row_number().over(backwards))
            .filter(F.col("_back") <= width)
            .withColumn("_idx", F.col("_before") + F.col("_n") - F.col("_back"))
            .withColumn("_block", F.floor(F.col("_idx") / width))
            .drop(SLICE, "_n", "_before", "_back")
        )
        last, first = F.col("_before") - 1, F.greatest(F.col("_before") - width, F.lit(0))
        wanted = spans.filter("_before > 0").select(
            *self._cells,
            F.col("_before").alias("_end"),
            F.explode(F.array_distinct(F.array(F.floor(first / width), F.floor(last / width)))).alias("_block"),
        )
        halo = (
            tails.join(wanted, [*self.keys, "_block"])
            .filter((F.col("_idx") < F.col("_end")) & (F.col("_idx") >= F.col("_end") - width))
            .withColumn(HALO, F.lit(True))
        )
        return body.unionByName(halo.select(*body.columns))

    def _rows(self, width: int) -> DataFrame:
        return self._with_halo(width) if self.sliced else self.df

    def _finish(self, df: DataFrame, added: Sequence[str]) -> DataFrame:
        if self.sliced:
            df = df.filter(~F.col(HALO))
        return df.select(*self.columns, *added)

    def _expose(self, df: DataFrame, values: Mapping[str, Column]) -> DataFrame:
        """State columns seen by a row: as computed, or those of the last eligible row before it."""
        if not self.eligible:
            return df.withColumns(dict(values))
        state = F.when(self._used(), F.struct(*[c.alias(n) for n, c in values.items()]))
        seen = F.last("_state", ignorenulls=True).over(_prior(self._spec()))
        return (
            df.withColumn("_state", state)
            .withColumn("_seen", seen)
            .withColumns({n: F.col("_seen")[n] for n in values})
        )

    def _colocated(self, df: DataFrame) -> DataFrame:
        """One shuffle serves the eligible-only window and the reading window."""
        spread = self._spread(df)
        if spread is df and self.eligible and self._cells and not self.placed:
            spread = df.repartition(*self._cells)
        return spread.withColumn("_used", self._used()) if self.eligible else spread

    def _spread(self, df: DataFrame) -> DataFrame:
        """Deal the cells to a task for each so many rows, where the session's number of shuffle partitions is too small for that."""
        if self.placed:
            return df
        spark = df.sparkSession
        # The halo is added by a union, after which slices have to be dealt again.
        self.dealt = not self.sliced
        tasks = math.ceil(self.sizes[1] / group_limit(spark))
        return df.repartition(tasks, *self._cells) if self._cells and tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df

    # -- operators -----------------------------------------------------------------------------

    def trailing(self, width: int, build: Callable[[Callable[[int], WindowSpec]], Mapping[str, Column]]) -> DataFrame:
        """Columns over the last n <= width used rows strictly before each row.

        ``build`` receives ``frame(n, skip=0)``, a window specification covering those rows without the
        latest ``skip`` of them.
        """
        df = self._colocated(self._rows(width))
        spec = self._spec("_used") if self.eligible else self._spec()

        def frame(n: int, skip: int = 0) -> WindowSpec:
            if n > width:
                raise ValueError("frame wider than the declared width")
            return spec.rowsBetween(1 - n, -skip) if self.eligible else spec.rowsBetween(-n, -1 - skip)

        built = build(frame)
        return self._finish(self._expose(df, built), list(built))

    def rolling(self, values: Mapping[str, Column], widths: Sequence[int]) -> DataFrame:
        """Sums ``<name>_<w>`` and row counts ``n_<w>`` of the last w used rows before each row; null adds nothing.

        Whole numbers are differences of exact prefix sums, so their cost does not grow with the width.  Other
        numbers are summed over the very rows of each window: a NaN, an infinity or a huge value leaves with its row.
        """
        width = max(widths)
        df = self._colocated(self._rows(width))
        spec = self._spec("_used") if self.eligible else self._spec()
        at = 0 if self.eligible else -1
        upto = spec.rowsBetween(Window.unboundedPreceding, at)
        fields = self.df.select(*[c.alias(n) for n, c in values.items()]).schema.fields
        whole = [f.name for f in fields if isinstance(f.dataType, (T.IntegralType, T.BooleanType))]
        sums = {"_p_n": F.count(F.lit(1)).over(upto)}
        for n in whole:
            # Two 32-bit halves: neither prefix sum can overflow below 2^31 rows.
            v = F.coalesce(values[n].cast("long"), F.lit(0))
            sums[f"_ph_{n}"] = F.sum(F.shiftright(v, 32)).over(upto)
            sums[f"_pl_{n}"] = F.sum(v.bitwiseAND(F.lit(0xFFFFFFFF))).over(upto)
        df = df.withColumns(sums)

        def part(c: str, w: int) -> Column:
            return (F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.lag(c, w).over(spec), F.lit(0))).cast("double")

        out = {}
        for w in widths:
            out[f"n_{w}"] = F.least(F.col("_p_n"), F.lit(w))
            for n, c in values.items():
                if n in whole:
                    out[f"{n}_{w}"] = part(f"_ph_{n}", w) * float(2**32) + part(f"_pl_{n}", w)
                else:
                    out[f"{n}_{w}"] = F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).over(spec.rowsBetween(at + 1 - w, at))
        shown = self._expose(df, out)
        zero = {n: F.coalesce(F.col(n), F.lit(0)) for n in out}
        return self._finish(shown.withColumns(zero), list(out))

    def running(self, sums: Mapping[str, Column], maxes: Mapping[str, Column] | None = None) -> DataFrame:
        """Totals (and maxima) over all earlier rows of the key; ineligible rows add nothing."""
        maxes = dict(maxes or {})
        live = {n: F.when(self._used(), c) for n, c in {**sums, **maxes}.items()}
        df = self._spread(self.df).withColumns({f"_v_{n}": c for n, c in live.items()})
        before = _prior(self._spec())
        seen = {n: F.coalesce(F.sum(f"_v_{n}").over(before), F.lit(0)) for n in sums}
        seen |= {n: F.max(f"_v_{n}").over(before) for n in maxes}
        if not self.sliced:
            return df.withColumns(seen).select(*self.columns, *seen)
        totals = df.groupBy(*self._cells).agg(
            *[F.coalesce(F.sum(f"_v_{n}"), F.lit(0)).alias(f"_c_{n}") for n in sums],
            *[F.max(f"_v_{n}").alias(f"_c_{n}") for n in maxes],
        )
        carry = self._slice_prefix(totals, [f"_c_{n}" for n in sums], [f"_c_{n}" for n in maxes])
        joined = df.join(carry, self._cells, "left").withColumns(seen)
        joined = joined.withColumns(
            {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
            | {n: F.greatest(F.col(n), F.col(f"_c_{n}")) for n in maxes}
        )
        return joined.select(*self.columns, *seen)

    def positions(self, name: str = "pos") -> DataFrame:
        """1-based rank of each row within its key."""
        number = F.row_number().over(self._spec()).cast("long")
        if not self.sliced:
            return self._spread(self.df).withColumn(name, number)
        totals = self.df.groupBy(*self._cells).agg(F.count(F.lit(1)).alias("_c"))
        carry = self._slice_prefix(totals, ["_c"])
        return self._spread(self.df).join(carry, self._cells, "left").withColumn(name, number + F.coalesce("_c", F.lit(0))).select(
            *self.columns, name
        )

    def decayed(
        self, values: Mapping[str, Column], scale: float, block: int | None = None, mean: bool = True, widths: Sequence[int] = (),
        present: bool = False,
    ) -> DataFrame:
        """Mean (or sum) of the used rows before each row, weighted exp(-age/scale) with age 0 for the latest.

        Prefix sums of x * exp(position/scale) inside blocks of positions, plus what the previous block
        left over, give the decayed sums in constant work per row; rows more than a block older than the latest
        value weigh less than rounding.  A row without a value leaves the mean as it is, so the mean at the latest
        value is carried forward however far back that value lies.  NaN and infinities count as no value.
        ``present`` says that every used row has a finite value in every column, so that all share one sum of weights.
        With ``widths`` only the last w used rows count (columns ``<name>_<w>``): the full decayed sum less
        the faded one w rows back; null where those rows hold no value.
        """
        block = block or int(100 * scale)
        if block / scale < 40 or block / scale > 600:
            raise ValueError("block must lie between 40 and 600 scales")
        if widths:
            return self._decayed_within(values, scale, block, mean, widths)
        # The slice halo must reach as far back as the weights do.
        df = self._spread(self._rows(block)).withColumn("_live", self._used())
        df = df.withColumn("_p", F.count(F.when(F.col("_live"), 1)).over(_prior(self._spec())))
        df, out = self._decay(df, values, scale, block, mean, present)
        return self._finish(df.withColumns(out), list(out))

    def profile(
        self, width: int, build: Callable[[Callable[[int], WindowSpec]], Mapping[str, Column]], values: Mapping[str, Column], scale: float,
        count: str, present: bool = False,
    ) -> DataFrame:
        """``trailing(width, build)``, ``decayed(values, scale)`` and the number ``count`` of used rows before each row.

        Where no key is cut, all three share one shuffle and the two orders of the rows that ``trailing`` needs.
        ``present`` says that every used row has a finite value in every column, so that no result of ``build`` is null.
        """
        if self.sliced:
            df = self.again(self.trailing(width, build)).decayed(values, scale, present=present)
            return self.again(df).running({count: F.lit(1)})
        spec = self._spec("_used") if self.eligible else self._spec()
        df = self._colocated(self.df)
        df = df.withColumn("_live", self._used())
        built = build(lambda n, skip=0: spec.rowsBetween(1 - n, -skip))
        before = _prior(self._spec())
        seen = lambda c: F.last(F.when(F.col("_live"), c), ignorenulls=True).over(before)
        place = {"_p": F.count(F.when(F.col("_live"), 1)).over(before)}
        df = df.withColumns({f"_s_{n}": c for n, c in built.items()})
        if present:
            df = df.withColumns(place | {n: seen(F.col(f"_s_{n}")) for n in built})
        else:
            df = df.withColumns(place | {"_seen": seen(F.struct(*[F.col(f"_s_{n}").alias(n) for n in built]))})
            df = df.withColumns({n: F.col("_seen")[n] for n in built})
        df, out = self._decay(df, values, scale, int(100 * scale), True, present)
        return self._finish(df.withColumns(out | {count: F.col("_p")}), [*built, *out, count])

    def _decay(
        self, df: DataFrame, values: Mapping[str, Column], scale: float, block: int, mean: bool, present: bool
    ) -> tuple[DataFrame, dict[str, Column]]:
        """Decayed means (or sums) of rows that carry ``_live`` and the number ``_p`` of used rows before them."""
        before = _prior(self._spec())
        # One block holds all rows of a key in most tables; then one order of the rows serves all sums.
        many = self.sizes[0] > block
        offset, within = F.col("_p"), before
        if many:
            df = df.withColumn("_b", F.floor(F.col("_p") / block))
            offset = F.col("_p") - F.col("_b") * block
            within = _prior(Window.partitionBy(*self._cells, "_b").orderBy(*self.order))
        df = df.withColumn("_up", F.when(F.col("_live"), F.exp(offset / F.lit(scale))))
        given, terms = {}, {}
        for n, c in values.items():
            x = c.cast("double")
            given[n] = x if present else F.when(F.abs(x) < float("inf"), x)
            terms[f"_x_{n}"] = given[n] * F.col("_up")
            if mean and not present:
                terms[f"_w_{n}"] = F.when(given[n].isNotNull(), F.col("_up"))
        if mean and present:
            terms["_w_all"] = F.col("_up")
        weight = {n: "_w_all" if present else f"_w_{n}" for n in values}
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        df = df.withColumns({f"{c}_t": zero(x) for c, x in terms.items()})
        df = df.withColumns({c: zero(F.sum(f"{c}_t").over(within)) for c in terms})
        if many:
            # What a block leaves to the next one: its sums after its last used row.
            ends = F.col("_live") & (F.col("_p") % block == block - 1)
            left = {f"{c}_left": F.last(F.when(ends, F.col(c) + F.col(f"{c}_t")), ignorenulls=True).over(before) for c in terms}
            df = df.withColumns(left)
            df = df.withColumns({c: F.col(c) + zero(F.col(f"{c}_left")) * math.exp(-block / scale) for c in terms})
        if not mean:
            fade = F.exp((F.lit(1) - offset) / F.lit(scale))
            out = {n: F.when(F.col("_p") > 0, F.col(f"_x_{n}") * fade) for n in values}
            return df, out
        out = {n: F.col(f"_x_{n}") / F.nullif(F.col(weight[n]), F.lit(0.0)) for n in values}
        if present or not (many or self.sliced):
            return df, out
        # The mean at a row that has a value, itself included, holds up to the next one, however far that is.
        at_value = {
            n: F.when(F.col("_live") & x.isNotNull(), (F.col(f"_x_{n}") + F.col(f"_x_{n}_t")) / (F.col(weight[n]) + F.col("_up")))
            for n, x in given.items()
        }
        df = df.withColumns({f"_r_{n}": x for n, x in at_value.items()})
        out = {n: F.last(f"_r_{n}", ignorenulls=True).over(before) for n in values}
        if self.sliced:
            df, out = self._carry_latest(df, [f"_r_{n}" for n in values], out)
        return df, out

    def _decayed_within(self, values: Mapping[str, Column], scale: float, block: int, mean: bool, widths: Sequence[int]) -> DataFrame:
        """``decayed`` over the last w used rows."""
        df = self._colocated(self._rows(block + max(widths)))
        spec = self._spec("_used") if self.eligible else self._spec()
        df = df.withColumn("_p", F.row_number().over(spec) - 1).withColumn("_b", F.floor(F.col("_p") / block))
        offset = F.col("_p") - F.col("_b") * block
        up, down = F.exp(offset / F.lit(scale)), F.exp(-offset / F.lit(scale))
        by_block = Window.partitionBy(*self._cells, *(["_used"] if self.eligible else []), "_b").orderBy(*self.order)
        upto = by_block.rowsBetween(Window.unboundedPreceding, 0)
        parts, counts = {}, {}
        for n, c in values.items():
            x = c.cast("double")
            given = F.when(F.abs(x) < float("inf"), x)
            parts[f"_x_{n}"] = F.sum(F.coalesce(given * up, F.lit(0.0))).over(upto)
            parts[f"_w_{n}"] = F.sum(F.when(given.isNotNull(), up).otherwise(0.0)).over(upto)
            counts[f"_k_{n}"] = F.count(given).over(spec.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumns({**parts, **counts})
        ends = F.col("_p") % block == block - 1
        left = {f"{c}_left": F.last(F.when(ends, F.col(c)), ignorenulls=True).over(_prior(spec)) for c in parts}
        df = df.withColumns(left)
        fade = F.exp(F.lit(-(block - 1) / scale)) * F.exp(-(offset + 1) / F.lit(scale))
        full = {c: F.col(c) * down + F.coalesce(F.col(f"{c}_left"), F.lit(0.0)) * fade for c in parts}
        df = df.withColumns({f"{c}_d": x for c, x in full.items()})

        def total(c: str, w: int) -> Column:
            return F.col(f"{c}_d") - F.coalesce(F.lag(f"{c}_d", w).over(spec), F.lit(0.0)) * math.exp(-w / scale)

        out = {}
        for n in values:
            for w in widths:
                held = F.col(f"_k_{n}") - F.coalesce(F.lag(f"_k_{n}", w).over(spec), F.lit(0))
                num = total(f"_x_{n}", w)
                out[f"{n}_{w}"] = F.when(held > 0, num / F.nullif(total(f"_w_{n}", w), F.lit(0.0))) if mean else num
        if not self.eligible:
            df = df.withColumns({f"_m_{n}": c for n, c in out.items()})
            out = {n: F.lag(f"_m_{n}", 1).over(spec) for n in out}
        return self._finish(self._expose(df, out), list(out))

    def _carry_latest(self, df: DataFrame, names: Sequence[str], out: Mapping[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
        """Fill what a slice and its halo leave null with the latest value of any earlier slice of the key."""
        place = F.struct(*self.order)
        ends = df.filter(~F.col(HALO)).groupBy(*self._cells).agg(
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c) for c in names]
        )
        before = _prior(Window.partitionBy(*self.keys).orderBy(SLICE))
        carry = ends.select(*self._cells, *[F.last(c, ignorenulls=True).over(before).alias(f"_e{c}") for c in names])
        filled = {n: F.coalesce(x, F.col(f"_e{c}")) for (n, x), c in zip(out.items(), names)}
        return df.join(carry, self._cells, "left"), filled

    def last_seen(self, values: Mapping[str, Column]) -> DataFrame:
        """Values of the last used row strictly before each row."""
        return self.trailing(1, lambda frame: {n: F.last(c).over(frame(1)) for n, c in values.items()})


def counts_within(df: DataFrame, keys: Sequence[str], time_us: str, spans: Mapping[str, int]) -> DataFrame:
    """Rows of the same key whose time lies in [t - span, t), for each span in microseconds.

    Counting needs one row per (key, time), so ties are combined map-side before anything is ordered;
    a key that is still too large is read in time buckets of the widest span plus the previous bucket.
    """
    per_time = df.groupBy(*keys, time_us).agg(F.count(F.lit(1)).alias("_n"))
    biggest, _ = largest_group(per_time, keys)
    widest = max(spans.values())
    if biggest > group_limit(df.sparkSession):
        own = F.floor(F.col(time_us) / widest)
        per_time = per_time.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
        cells = [*keys, "_bucket"]
    else:
        cells = list(keys)
    spec = Window.partitionBy(*cells).orderBy(time_us)
    counted = per_time.withColumns(
        {n: F.coalesce(F.sum("_n").over(spec.rangeBetween(-s, -1)), F.lit(0)) for n, s in spans.items()}
    )
    if "_bucket" in cells:
        counted = counted.filter("_bucket = _own")
    joined = df.join(counted.select(*keys, time_us, *spans), [*keys, time_us], "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in spans])


def values_at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Exact order statistics per key, with linear interpolation at fractional 0-based ranks.

    ``ranks`` maps an output name to rank(n).  Equal values are combined first, then a running count
    locates each rank, so no group is ever sorted in one place beyond the row limit.
    """
    keys = list(keys)
    anchor = keys or ["_all"]
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    if not keys:
        base = base.withColumn("_all", F.lit(0))
    distinct = base.groupBy(*anchor, "_v").agg(F.count(F.lit(1)).alias("_n"))
    line = Timeline(distinct, anchor, ["_v"]).running({"_lo": F.col("_n")})
    size = base.groupBy(*anchor).agg(F.count(F.lit(1)).alias("_size"))
    line = line.join(size, anchor)
    picks = []
    for name, rank in ranks.items():
        r = rank(F.col("_size"))
        low, high = F.floor(r), F.ceil(r)
        inside = lambda at: (F.col("_lo") <= at) & (at < F.col("_lo") + F.col("_n"))
        picks += [
            F.max(F.when(inside(low), F.col("_v"))).alias(f"_l_{name}"),
            F.max(F.when(inside(high), F.col("_v"))).alias(f"_h_{name}"),
            F.max(r - low).alias(f"_f_{name}"),
        ]
    found = line.groupBy(*anchor).agg(*picks)
    out = [
        (F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")).alias(n) for n in ranks
    ]
    return found.select(*keys, *out)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """Keep one row per key, the last (or first) in ``order``; an aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])
