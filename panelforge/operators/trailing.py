"""Totals and averages over trailing calendar periods, days without activity included.

Every daily amount is two events for each period: it is added at its day and
taken away when it leaves the window. The running sum of these deltas is the
trailing total, whatever the length of the window: no frame is re-aggregated,
and a day without events has the total of the event before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEYS = ["exchange", "symbol"]
#: Amounts are summed as exact decimals, so that what is added is taken away to the last digit. No one decimal holds all doubles, so an
#: amount goes to the first of these (upper bound of its size, type) it is smaller than; each has sixteen digits for it and room for the
#: sums of ten thousand days.
EXACT = ((1e-6, "decimal(38,36)"), (1e12, "decimal(38,22)"), (1e30, "decimal(38,4)"))
#: From here on, and if infinite, an amount counts as an infinite one: the total is infinite while it is in the window.
INFINITE = 1e30
WHOLE = "decimal(38,0)"


def _parts(a: str, whole: bool) -> dict[str, tuple[Column, str]]:
    """The summands of an amount, each by its name and type: the value in the decimal it fits, or what counts infinite ones."""
    x = F.col(a)
    if whole:
        return {f"{a}_s": (F.coalesce(x.cast(WHOLE), F.lit(0).cast(WHOLE)), WHOLE)}
    size, out, least = F.abs(x), {}, None
    for i, (most, kind) in enumerate(EXACT):
        fits = size < most if least is None else (size >= least) & (size < most)
        out[f"{a}_s{i}"] = (F.coalesce(F.when(fits, x).cast(kind), F.lit(0).cast(kind)), kind)
        least = most
    for name, beyond in (("up", x >= INFINITE), ("down", x <= -INFINITE)):
        out[f"{a}_{name}"] = (F.when(beyond, 1).otherwise(0), "int")
    return out


def _total(a: str, n: int, whole: bool) -> Column:
    if whole:
        return F.col(f"{a}_s{n}").cast("bigint")
    small, usual, large = (F.col(f"{a}_s{i}_{n}") for i in range(3))
    up, down = F.col(f"{a}_up_{n}") > 0, F.col(f"{a}_down_{n}") > 0
    inf = F.lit(float("inf"))
    total = F.when((small == 0) & (large == 0), usual.cast("double")).otherwise(large.cast("double") + usual.cast("double") + small.cast("double"))
    return F.when(up & down, None).when(up, inf).when(down, -inf).otherwise(total)


def totals(daily: DataFrame, amounts: list[str], windows: tuple[int, ...] = (7, 30), from_day: int = 1) -> DataFrame:
    """Trailing totals of every series and calendar day from its first to its last recorded day.

    :param daily: (exchange, symbol, day, amounts…), at most one row per series
        and day, the row itself being the record of the day; null amounts add
        nothing. A series therefore has at most one row a calendar day (36,525
        a century), which bounds the groups of the running sum.
    :param from_day: the first day of a series to come out; its first recorded
        day is day 1.
    :return: exchange, symbol, day and for each amount and window
        ``{amount}_sum_{w}`` (zero without activity), ``{amount}_n_{w}`` (days
        with an amount) and ``{amount}_avg_{w}`` (over those days, else null).

    Doubles come back as doubles, integers as integers. Amounts are added up
    exactly, from 1e-36 to below INFINITE in size; a greater or infinite one
    makes the totals of its windows infinite (null where both signs meet), and
    leaves no trace after. NaN counts as missing. Null keys form series of their
    own; an empty table gives no rows.

    The rows are exchanged by series as they are and become events after, so
    one row a day crosses the network whatever the number of windows.
    """
    whole = {a for a in amounts if daily.schema[a].dataType.typeName() in ("long", "integer", "short", "byte")}
    clean = lambda a: F.col(a) if a in whole else F.nanvl(F.col(a), F.lit(None).cast("double"))
    base = daily.select(*_KEYS, F.unix_date("day").alias("_x"), *[clean(a).alias(a) for a in amounts]).repartition(*_KEYS)
    parts = {k: v for a in amounts for k, v in _parts(a, a in whole).items()} | {f"{a}_c": (F.when(F.col(a).isNotNull(), 1).otherwise(0), "int") for a in amounts}
    name = lambda k, n: f"{k}{n}" if k.removesuffix("_s") in whole or k.endswith("_c") else f"{k}_{n}"
    deltas = []
    for shift in (0, *windows):
        fields = [(F.col("_x") + shift).alias("_x"), F.lit(shift == 0).alias("_recorded")]
        for k, (value, kind) in parts.items():
            for n in windows:
                fields.append((value if shift == 0 else -value if shift == n else F.lit(0)).cast(kind).alias(name(k, n)))
        deltas.append(F.struct(*fields))
    events = base.select(*_KEYS, F.inline(F.array(*deltas)))
    w = Window.partitionBy(*_KEYS).orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole_series = Window.partitionBy(*_KEYS)
    running = events.select(
        *_KEYS, "_x", *[F.sum(name(k, n)).over(w).alias(name(k, n)) for k in parts for n in windows],
        F.lead("_x").over(Window.partitionBy(*_KEYS).orderBy("_x")).alias("_next"),
        F.min(F.when(F.col("_recorded"), F.col("_x"))).over(whole_series).alias("_first"),
        F.max(F.when(F.col("_recorded"), F.col("_x"))).over(whole_series).alias("_last"),
    )
    # the last of a day's events holds until the day before the next ones
    start = F.greatest(F.col("_x"), F.col("_first") + (from_day - 1))
    stop = F.least(F.coalesce(F.col("_next") - 1, F.col("_last")), F.col("_last"))
    held = running.filter(F.col("_next").isNull() | (F.col("_next") > F.col("_x"))).withColumns({"_start": start, "_stop": stop}).filter(F.col("_start") <= F.col("_stop"))
    out = []
    for a in amounts:
        for n in windows:
            total, days = _total(a, n, a in whole), F.col(f"{a}_c{n}")
            out += [total.alias(f"{a}_sum_{n}"), days.cast("bigint").alias(f"{a}_n_{n}"), F.try_divide(total.cast("double"), days.cast("double")).alias(f"{a}_avg_{n}")]
    return held.select(*_KEYS, *out, F.explode(F.sequence("_start", "_stop")).alias("_d")).select(*_KEYS, F.date_from_unix_date("_d").alias("day"), *[c for a in amounts for n in windows for c in (f"{a}_sum_{n}", f"{a}_n_{n}", f"{a}_avg_{n}")])
