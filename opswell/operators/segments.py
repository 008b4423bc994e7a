"""Ordered results per key when one key may hold a large share of all rows.

A plain window sends every row of a key to one task. Here the order is cut into
spans of about as many rows each, so a key's rows spread over many (key, span) groups; what a span
needs to know about the spans before it (counts, sums, last values) is one small
row per span. Each function gives exactly what the plain window would give.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window, functions as F

from opswell import session

ROWS_PER_SPAN = 1_000_000
LEAST_SPANS = 8
#: More rows than MOST_SPANS spans of ROWS_PER_SPAN have make larger spans, which windows sort on disk.
MOST_SPANS = 512
#: Numbers that a quantile sketch keeps; its ranks are off by some 0.1 % of the rows.
SKETCH = 4096
#: The least finite double, for nulls. Texts are told apart by their first 6 * TEXT_PARTS bytes, six more in each pass.
LOWEST = -sys.float_info.max
TEXT_PARTS = 20
SPAN = "_span"


def _stand_in(dtype: str) -> Column:
    """A value of the type that replaces null in a grouping key; the null itself is kept in a flag."""
    if dtype == "string":
        return F.lit("")
    if dtype in ("date", "timestamp", "timestamp_ntz"):
        return F.lit("1970-01-01").cast(dtype)
    return F.lit(0).cast(dtype)


def _positions(column: str, dtype: str) -> list[Column]:
    """Doubles that never fall where the column rises, nulls first; what one of them leaves equal, the next may part."""
    c = F.col(column)
    if dtype == "timestamp_ntz":
        found = [F.unix_micros(c.cast("timestamp")).cast("double")]
    elif dtype == "timestamp":
        found = [F.unix_micros(c).cast("double")]
    elif dtype == "date":
        found = [F.unix_date(c).cast("double")]
    elif dtype in ("float", "double"):
        found = [F.least(F.greatest(F.nanvl(c.cast("double"), F.lit(-LOWEST)), F.lit(LOWEST)), F.lit(-LOWEST))]
    elif dtype in ("string", "binary"):
        # Six bytes are a whole number that a double holds exactly.
        part = lambda i: F.rpad(F.hex(F.substring(c.cast("binary"), 1 + 6 * i, 6)), 12, "0")
        found = [F.conv(part(i), 16, 10).cast("double") for i in range(TEXT_PARTS)]
    elif dtype in ("tinyint", "smallint", "int", "bigint", "boolean") or dtype.startswith("decimal"):
        found = [c.cast("double")]
    else:  # nothing to cut by; the columns before it still are
        found = []
    return [F.coalesce(f, F.lit(LOWEST)) for f in found]


def _spread(values: Sequence[float], rows: float, share: float) -> tuple[list[float], dict[float, float]]:
    """Cuts at evenly spaced ones of sorted quantiles, and the values that alone hold more than a span's share of the rows.

    Such a value is cut off on both sides, so that nothing but the columns after it parts its rows.
    """
    parts = max(1, round(rows / share))
    picks = [values[min(len(values) - 1, round(i * (len(values) + 1) / parts) - 1)] for i in range(1, parts)]
    heavy = {v: rows * values.count(v) / (len(values) + 1) for v in {a for a, b in zip(picks, picks[1:]) if a == b}}
    return sorted({*picks, *[math.nextafter(v, math.inf) for v in heavy]}), heavy


def _cuts(df: DataFrame, positions: Sequence[tuple[str, Column]], rows_per_span: int, least: int) -> list[tuple[float, ...]]:
    """Where spans begin, as beginnings of the rows' positions; positions: (column, position).

    One pass counts the rows and sketches the quantiles of the first position. Only
    where a value holds more than a span's share of all rows, its rows are sketched
    by the next position, and so on. A pass brings MOST_SPANS numbers for each of at
    most MOST_SPANS values to the driver.

    The next column parts rows only if the last one is the same in all of them: a
    position may be the same for different values (numbers beyond a double's digits,
    texts after 6 * TEXT_PARTS bytes). Such rows stay together.
    """
    grid = F.array(*[F.lit(i / MOST_SPANS) for i in range(1, MOST_SPANS)])
    names = [f"_p{i}" for i in range(len(positions))]
    columns = [c for c, _ in positions]
    rows = df.select(*[p.alias(n) for (_, p), n in zip(positions, names)], *[F.col(c).alias(f"_c_{c}") for c in dict.fromkeys(columns)])
    sketched = lambda name: (F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(name, F.lit(SKETCH)).alias("sketch"))
    quantiles = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", grid)).alias("values")
    found = rows.agg(*sketched(names[0])).select("n", quantiles).first()
    if not found.n:
        return []
    share = found.n / min(MOST_SPANS, max(least, math.ceil(found.n / rows_per_span)))
    values, heavy = _spread(found["values"], found.n, share)
    cuts = [(v,) for v in values]
    heavy = [(v,) for v in heavy]
    for depth in range(1, len(names)):
        if not heavy:
            break
        before = names[:depth]
        alike = df.sparkSession.createDataFrame(heavy, ", ".join(f"{n} double" for n in before))
        held = rows.join(F.broadcast(alike), before).groupBy(*before)
        last = F.col(f"_c_{columns[depth - 1]}")
        same = (F.min(last).eqNullSafe(F.max(last)) & F.count(last).isin(F.lit(0), F.count(F.lit(1)))).alias("same")
        heavy = []
        for r in held.agg(*sketched(names[depth]), same).select(*before, "n", "same", quantiles).collect():
            if columns[depth] != columns[depth - 1] and not r.same:
                continue
            prefix = tuple(r[n] for n in before)
            values, more = _spread(r["values"], r.n, share)
            cuts += [(*prefix, v) for v in values]
            heavy += [(*prefix, v) for v in more]
    return sorted(set(cuts))


def _span(positions: Sequence[Column], cuts: Sequence[tuple[float, ...]]) -> Column:
    """How many cuts stand at or before the row."""
    if not cuts:
        return F.lit(0).cast("long")
    depth = max(len(c) for c in cuts)
    place = positions[0] if depth == 1 else F.struct(*[p.alias(f"p{i}") for i, p in enumerate(positions[:depth])])

    def value(cut):
        full = [F.lit(v) for v in [*cut, *[LOWEST] * (depth - len(cut))]]
        return full[0] if depth == 1 else F.struct(*[v.alias(f"p{i}") for i, v in enumerate(full)])

    if len(cuts) <= 32:
        return reduce(lambda a, b: a + b, [(place >= value(c)).cast("long") for c in cuts])
    # Halving: the largest number of cuts that stand before the row, from the highest binary digit down.
    all_, steps = F.array(*[value(c) for c in cuts]), [1 << k for k in reversed(range(len(cuts).bit_length()))]
    further = lambda n, step: F.when(F.get(all_, n + step - 1) <= place, n + step).otherwise(n)
    return F.aggregate(F.array(*[F.lit(k) for k in steps]), F.lit(0), further).cast("long")


def _upto_here(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before_here(w):
    return w.rowsBetween(Window.unboundedPreceding, -1)


class Ordered:
    """Rows by key and order, each tagged with the span of the order it falls in.

    The methods add columns and give new Ordered rows with the same tags, so the
    order is cut once for a chain of steps. Each step reads its
    rows twice (for the rows and for the one row per span), so between two steps
    of a chain the rows are settled.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        rows_per_span: int = ROWS_PER_SPAN,
        least: int = LEAST_SPANS,
        measured: DataFrame | None = None,
    ):
        """Spans hold about as many rows each; what cuts them is found in one light pass over the ordering columns.

        measured: rows to take the cuts from, where cheaper ones than df have the same
        distribution; of the ordering columns they need the first one at least.
        """
        types = dict(df.dtypes)
        self.columns, self.keys, self.order = df.columns, list(keys), list(order)
        self.by, tags = [], []
        for i, key in enumerate(self.keys):
            self.by += [f"_key{i}", f"_none{i}"]
            tags += [
                F.coalesce(F.col(key), _stand_in(types[key])).alias(f"_key{i}"),
                F.col(key).isNull().alias(f"_none{i}"),
            ]
        source = df if measured is None else measured
        positions = [(c, p) for c in takewhile(lambda c: c in source.columns and _positions(c, types[c]), order) for p in _positions(c, types[c])]
        cuts = _cuts(source, positions, rows_per_span, least) if positions else []
        self.rows = df.select("*", *tags, _span([p for _, p in positions], cuts).alias(SPAN))

    @property
    def df(self) -> DataFrame:
        return self.rows.select(*self.columns)

    def _copy(self, rows: DataFrame, columns: Sequence[str]) -> Ordered:
        new = object.__new__(Ordered)
        new.__dict__.update(self.__dict__)
        new.rows, new.columns = rows, list(columns)
        return new

    def plus(self, **columns: Column) -> Ordered:
        """Columns computed row by row, all from the columns there are."""
        names = [*self.columns, *[n for n in columns if n not in self.columns]]
        return self._copy(self.rows.withColumns(columns), names)

    def settled(self) -> Ordered:
        return self._copy(session.settle(self.rows), self.columns)

    def carry(
        self,
        local: dict[str, Callable],
        totals: dict[str, Column],
        before: dict[str, Callable],
        results: dict[str, Column],
        descending: bool = False,
        overall: dict[str, Callable] | None = None,
    ) -> Ordered:
        """Results from what a row sees inside its span and from all spans before it.

        local: name -> function of the window inside a span.
        totals: name -> aggregate of one span.
        before: name -> function of the window over the spans before, reading totals.
        overall: name -> function of the window over all spans of the key, reading totals.
        results: name -> column made of the ones above.
        """
        way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
        inside = Window.partitionBy(*self.by, SPAN).orderBy(*[way(c) for c in self.order])
        rows = self.rows.select("*", *[f(inside).alias(n) for n, f in local.items()])
        earlier = Window.partitionBy(*self.by).orderBy(way(SPAN)).rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*self.by)
        group = [*self.by, SPAN]
        facts = self.rows.groupBy(*group).agg(*[e.alias(n) for n, e in totals.items()])
        facts = facts.select(
            *[F.col(c).alias(f"_of{c}") for c in group],
            *[f(earlier).alias(n) for n, f in before.items()],
            *[f(whole).alias(n) for n, f in (overall or {}).items()],
        )
        match = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_of{c}") for c in group])
        joined = rows.join(facts, match, "left")
        out = joined.select(*self.columns, *group, *[e.alias(n) for n, e in results.items()])
        return self._copy(out, [*self.columns, *results])

    def row_numbers(self, name: str = "row_number", total: str | None = None, descending: bool = False) -> Ordered:
        """row_number() over the key; the order must be unique within it. total: rows of the key."""
        results = {name: (F.col("_here") + F.coalesce("_ahead", F.lit(0))).cast("long")}
        if total:
            results[total] = F.col("_all").cast("long")
        return self.carry(
            {"_here": lambda w: F.row_number().over(w)},
            {"_n": F.count(F.lit(1))},
            {"_ahead": lambda w: F.sum("_n").over(w)},
            results,
            descending,
            {"_all": lambda w: F.sum("_n").over(w)} if total else None,
        )

    def running_sums(self, sums: dict[str, str]) -> Ordered:
        """sum(column) up to the row; sums: result name -> column."""
        # A running sum is null only until the first value arrives.
        result = lambda n: F.when(
            F.col(f"_here_{n}").isNotNull() | F.col(f"_ahead_{n}").isNotNull(),
            F.coalesce(f"_here_{n}", F.lit(0)) + F.coalesce(f"_ahead_{n}", F.lit(0)),
        )
        return self.carry(
            {f"_here_{n}": (lambda w, c=c: F.sum(c).over(_upto_here(w))) for n, c in sums.items()},
            {f"_sum_{n}": F.sum(c) for n, c in sums.items()},
            {f"_ahead_{n}": (lambda w, n=n: F.sum(f"_sum_{n}").over(w)) for n in sums},
            {n: result(n) for n in sums},
        )

    def running_least(self, columns: dict[str, str], greatest: bool = False) -> Ordered:
        """min (or max) of columns over all rows up to this one; columns: result name -> column."""
        agg, pick = (F.max, F.greatest) if greatest else (F.min, F.least)
        return self.carry(
            {f"_here_{n}": (lambda w, c=c: agg(c).over(_upto_here(w))) for n, c in columns.items()},
            {f"_best_{n}": agg(c) for n, c in columns.items()},
            {f"_ahead_{n}": (lambda w, n=n: agg(f"_best_{n}").over(w)) for n in columns},
            {n: pick(f"_here_{n}", f"_ahead_{n}") for n in columns},
        )

    def previous(self, columns: dict[str, str]) -> Ordered:
        """lag(column); columns: result name -> column."""
        return self.carry(
            {
                "_first": lambda w: F.row_number().over(w) == 1,
                **{f"_here_{n}": (lambda w, c=c: F.lag(c).over(w)) for n, c in columns.items()},
            },
            {"_last": F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), F.struct(*self.order))},
            {"_ahead": lambda w: F.last("_last").over(w)},
            {n: F.when(F.col("_first"), F.col("_ahead")[n]).otherwise(F.col(f"_here_{n}")) for n in columns},
        )

    def last_known(self, before: dict[str, str] | None = None, upto: dict[str, str] | None = None) -> Ordered:
        """Newest non-null value in the rows before this one (before), or up to and including it (upto)."""
        before, upto = before or {}, upto or {}
        at = F.struct(*self.order)
        every = {**before, **upto}
        frame = lambda n: _upto_here if n in upto else _before_here
        return self.carry(
            {
                f"_here_{n}": (lambda w, c=c, f=frame(n): F.last(c, ignorenulls=True).over(f(w)))
                for n, c in every.items()
            },
            {f"_last_{n}": F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)) for n, c in every.items()},
            {f"_ahead_{n}": (lambda w, n=n: F.last(f"_last_{n}", ignorenulls=True).over(w)) for n in every},
            {n: F.coalesce(f"_here_{n}", f"_ahead_{n}") for n in every},
        )


def attach(rows: DataFrame, facts: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Joins facts to rows where the named columns are equal or both null."""
    renamed = facts.select(
        *[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)],
        *[c for c in facts.columns if c not in on],
    )
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)])
    return rows.join(renamed, match, how).drop(*[f"_on{i}" for i in range(len(on))])


def sums_upto_value(df: DataFrame, keys: Sequence[str], x: str, sums: dict[str, str], **cut) -> DataFrame:
    """Rows with sum(column) over all rows of the key whose x is not above theirs; sums: result name -> column.

    Rows of equal x are added up first, so only distinct values are ordered.
    """
    points = df.groupBy(*keys, x).agg(*[F.sum(c).alias(f"_part_{n}") for n, c in sums.items()])
    run = Ordered(points, keys, [x], measured=df, **cut).running_sums({n: f"_part_{n}" for n in sums}).df
    return attach(df, run.select(*keys, x, *sums), [*keys, x])


def value_ranks(df: DataFrame, keys: Sequence[str], x: str, **cut) -> DataFrame:
    """One row per key and distinct value: n, rows below it, distinct values up to it, rows of the key.

    rank = below + 1, dense_rank = distinct, cume_dist = (below + n) / total.
    Counting comes first, so only distinct values are ordered.
    """
    values = df.groupBy(*keys, x).agg(F.count(F.lit(1)).alias("n"))
    out = Ordered(values, keys, [x], measured=df, **cut).carry(
        {
            "_below": lambda w: F.sum("n").over(_before_here(w)),
            "_nth": lambda w: F.row_number().over(w),
        },
        {"_n": F.sum("n"), "_values": F.count(F.lit(1))},
        {
            "_below_ahead": lambda w: F.sum("_n").over(w),
            "_nth_ahead": lambda w: F.sum("_values").over(w),
        },
        {
            "below": F.coalesce("_below", F.lit(0)) + F.coalesce("_below_ahead", F.lit(0)),
            "distinct": (F.col("_nth") + F.coalesce("_nth_ahead", F.lit(0))).cast("long"),
            "total": F.col("_total"),
        },
        overall={"_total": lambda w: F.sum("_n").over(w)},
    )
    return out.df


def exact_percentiles(df: DataFrame, keys: Sequence[str], x: str, at: dict[str, float], **cut) -> DataFrame:
    """Interpolated percentiles per key, from counted values instead of one buffer per key."""
    ranks = value_ranks(df.where(F.col(x).isNotNull()), keys, x, **cut)
    picks, results = [], []
    for name, p in at.items():
        place = F.lit(float(p)) * (F.col("total") - 1)
        for side, where in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            held = (F.col("below") <= where) & (where < F.col("below") + F.col("n"))
            picks.append(F.max(F.when(held, F.col(x))).alias(f"_{side}_{name}"))
        place = F.lit(float(p)) * (F.col("_total") - 1)
        lo, hi = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        results.append((lo + (hi - lo) * (place - F.floor(place))).alias(name))
    grouped = ranks.groupBy(*keys).agg(F.max("total").alias("_total"), *picks)
    return grouped.select(*keys, *results)


def _merged(fold: Callable, a: Column, b: Column) -> Column:
    """A fold over two sets of rows from the folds over each; null stands for no row."""
    if fold in (F.max, F.min):
        return (F.greatest if fold is F.max else F.least)(a, b)
    return F.coalesce(a + b, a, b)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    x: str,
    before: int,
    after: int,
    parts: dict[str, Column],
    over: dict[str, Callable | Column],
    folds: dict[str, Callable] | None = None,
) -> DataFrame:
    """Aggregates over the rows of the key with x in [here - before, here + after], for a whole-number x.

    parts: name -> aggregate of the rows that share one x (rows are counted together first).
    over: result name -> function of the window, reading parts; its work for a row grows with the points of a frame.
    folds: part -> F.sum, F.max or F.min; over then holds columns that read the parts folded over the frame.
    Gives one row per key and x. A value of x is copied to the at most two blocks
    whose frames can reach it, so no group spans more than two frame widths.

    All frames of a block hold the place `after` behind the block's beginning. So a
    frame is what lies before that place, a running fold going down, and what lies
    from it on, a running fold going up: work for a row that does not depend on the frame.
    """
    width = before + after + 1
    points = df.groupBy(*keys, x).agg(*[e.alias(n) for n, e in parts.items()])
    home = F.floor(F.col(x) / width)
    copies = points.withColumn(
        "_block",
        F.explode(F.sequence(F.floor((F.col(x) - after) / width), F.floor((F.col(x) + before) / width))),
    )
    group = Window.partitionBy(*keys, "_block")
    if folds is None:
        w = group.orderBy(x).rangeBetween(-before, after)
        found, results = [f(w).alias(n) for n, f in over.items()], list(over)
    else:
        from_middle = F.col(x) >= F.col("_block") * width + after
        down = group.orderBy(F.col(x).desc()).rangeBetween(Window.unboundedPreceding, before)
        up = group.orderBy(x).rangeBetween(Window.unboundedPreceding, after)
        found = [
            _merged(f, f(F.when(~from_middle, F.col(n))).over(down), f(F.when(from_middle, F.col(n))).over(up)).alias(n) for n, f in folds.items()
        ]
        results = [e.alias(n) for n, e in over.items()]
    return copies.select(*keys, x, "_block", *found).where(F.col("_block") == home).select(*keys, x, *results)
