"""Time series: gap-filled spines, running totals, resampling, relative ranges, daily observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerweave.functions.ordered import running_total

# Relative ranges as (unit, amount); ``all`` has none.
RANGES = {"1w": ("day", 7), "1m": ("month", 1), "1y": ("month", 12), "3y": ("month", 36)}


def month_spine(bounds: DataFrame) -> DataFrame:
    """One row per month from ``first`` to ``last`` of a one-row frame; none when ``first`` is NULL."""
    months = F.sequence(F.trunc("first", "MM"), F.trunc("last", "MM"), F.expr("interval 1 month"))
    return (
        bounds.filter(F.col("first").isNotNull() & (F.trunc("first", "MM") <= F.trunc("last", "MM")))
        .select(F.explode(months).alias("month_start"))
        .select(F.date_format("month_start", "yyyy-MM-dd").alias("month"))
    )


def gap_filled_months(monthly: DataFrame, bounds: DataFrame, measures: dict[str, str]) -> DataFrame:
    """Left-join monthly measures to the spine, fill with zero and add running totals."""
    filled = month_spine(bounds).join(monthly, "month", "left").fillna(0, subset=list(measures))
    return running_total(filled, "month", measures)


def burn_history(states: DataFrame, as_of: Column) -> DataFrame:
    burns = states.filter((F.col("burned") == 1) & F.col("burn_ts").isNotNull())
    monthly = burns.groupBy(F.date_format("burn_ts", "yyyy-MM-01").alias("month")).agg(
        F.count(F.lit(1)).alias("monthly_burns")
    )
    bounds = monthly.agg(F.min("month").cast("date").alias("first")).withColumn("last", as_of.cast("date"))
    return gap_filled_months(monthly, bounds, {"monthly_burns": "total_burns"})


def conversion_history(flows: DataFrame, first: str, last: str, measures: dict[str, int]) -> DataFrame:
    """Two measures summed by month over a fixed window, with running totals.

    ``measures`` maps a base-unit column to its decimal places; conversion to units comes last.
    """
    inside = flows.filter((F.col("ts") >= F.lit(first).cast("date")) & (F.col("ts") < F.add_months(F.lit(last).cast("date"), 1)))
    monthly = inside.groupBy(F.date_format("ts", "yyyy-MM-01").alias("month")).agg(
        *[F.sum(F.col(m).cast("decimal(20,0)")).alias(m) for m in measures]
    )
    bounds = flows.sparkSession.range(1).select(
        F.lit(first).cast("date").alias("first"), F.lit(last).cast("date").alias("last")
    )
    rows = gap_filled_months(monthly, bounds, {m: f"total_{m}" for m in measures})
    return rows.select(
        "month",
        *[
            (F.col(c).cast("double") / F.lit(float(10**p))).alias(c)
            for m, p in measures.items()
            for c in (m, f"total_{m}")
        ],
    )


def bucket_start(day: Column, grain: str) -> Column:
    """Start of the bucket as text; weeks start on Monday."""
    if grain == "1d":
        return F.date_format(day, "yyyy-MM-dd")
    unit = {"1w": "week", "1m": "month"}[grain]
    return F.date_format(F.date_trunc(unit, day), "yyyy-MM-dd")


def resample_last(rows: DataFrame, day: str, grain: str, values: list[str]) -> DataFrame:
    """Last observation of each bucket."""
    last = F.max(F.struct(day, *values)).alias("_last")
    return (
        rows.groupBy(bucket_start(F.col(day).cast("date"), grain).alias("date"))
        .agg(last)
        .select("date", *[F.col(f"_last.{v}") for v in values])
    )


def resample_sum(rows: DataFrame, day: str, grain: str, values: list[str]) -> DataFrame:
    return rows.groupBy(bucket_start(F.col(day).cast("date"), grain).alias("date")).agg(
        *[F.sum(F.col(v).cast("decimal(20,0)")).alias(v) for v in values]
    )


def range_start(choice: str, end: Column, earliest: Column) -> Column:
    """Start of a relative range, clamped to the earliest day.

    A month step that lands past the end of a shorter month is clamped to its last day.
    """
    if choice not in RANGES:
        return earliest
    unit, amount = RANGES[choice]
    start = F.date_sub(end, amount) if unit == "day" else F.add_months(end, -amount)
    return F.greatest(start, earliest)


def range_filter(rows: DataFrame, day: str, choice: str) -> DataFrame:
    """Rows within the relative range that ends at the last day present."""
    d = F.col(day).cast("date")
    end = rows.agg(F.max(day)).scalar().cast("date")
    earliest = rows.agg(F.min(day)).scalar().cast("date")
    return rows.filter(d.between(range_start(choice, end, earliest), end))


def interval_slice(rows: DataFrame, ts: str, after: Column, upto: Column) -> DataFrame:
    """Half-open interval: later than ``after`` and not later than ``upto``."""
    return rows.filter((F.col(ts) > after) & (F.col(ts) <= upto))


def latest_observation(rows: DataFrame, day: str, values: list[str]) -> DataFrame:
    last = F.max(F.struct(day, *values)).alias("_last")
    return rows.agg(last).select(F.col(f"_last.{day}").alias("as_of"), *[F.col(f"_last.{v}") for v in values])


def observation_rules(raw: DataFrame, floor: str, listed: str, places: int) -> DataFrame:
    """Rule check of raw text observations; accepted rows carry units, others a reason."""
    price, count = F.col(floor).try_cast("double"), F.col(listed).try_cast("double")
    truth = ["true", "false"]
    reason = (
        F.when(F.col(floor).isNull(), "floor missing")
        .when(F.col(listed).isNull(), "count missing")
        .when(F.lower(floor).isin(truth) | price.isNull(), "floor not numeric")
        .when(F.lower(listed).isin(truth) | count.isNull(), "count not numeric")
        .when((price < 0) | (count < 0), "negative")
        .when(count != F.floor(count), "count not whole")
    )
    return raw.withColumn("reason", reason).withColumns(
        {
            "floor": F.when(F.col("reason").isNull(), price / F.lit(float(10**places))),
            "listed_count": F.when(F.col("reason").isNull(), count.cast("bigint")),
        }
    )


def append_daily(history: DataFrame, fresh: DataFrame, checkpoint: Column, day: str = "day") -> DataFrame:
    """History plus the fresh rows of later dates; refuses a fresh date that is not later or that comes twice.

    The last fresh day must be later than the checkpoint too, so a rerun with the same rows is refused as a whole.
    """
    times = fresh.groupBy(day).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*fresh.columns)).alias("_row"))
    late = F.col(day) <= checkpoint
    reason = F.when(late, F.concat(F.lit("not later than the checkpoint: "), F.col(day).cast("string"))).when(
        F.col("_n") > 1, F.concat(F.lit("more than one row of "), F.col(day).cast("string"))
    )
    checked = F.when(reason.isNull(), F.col("_row")).otherwise(F.raise_error(reason))
    return history.unionByName(times.select(checked.alias("_row")).select("_row.*"))


def due_daily(history: DataFrame, fresh: DataFrame, checkpoint: Column, day: str = "day") -> tuple[DataFrame, DataFrame]:
    """Fresh rows that may be appended, one a date, and the refused ones with the reason."""
    rest = [c for c in fresh.columns if c != day]
    times = fresh.groupBy(day).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_row"))
    reason = F.when(F.col(day) <= checkpoint, "not later than the checkpoint").when(F.col("_n") > 1, "more than one row")
    judged = times.withColumn("reason", reason)
    fine = judged.filter("reason IS NULL").select(day, *[F.col(f"_row.{c}") for c in rest]).select(*fresh.columns)
    return fine, judged.filter("reason IS NOT NULL").select(day, F.col("_n").alias("n"), "reason")


def daily_guard(history: DataFrame, checkpoint: Column, today: Column, day: str = "day") -> DataFrame:
    """Preconditions of an append as one row of flags."""
    last = F.max(day)
    return history.agg(
        (last == checkpoint).alias("history_matches_checkpoint"),
        (checkpoint <= today).alias("checkpoint_not_in_future"),
        (F.count(F.lit(1)) == F.count_distinct(day)).alias("one_row_per_day"),
    )


def series_rules(rows: DataFrame, day: str, place: str) -> DataFrame:
    """Is the published series one row per day, in the order of its days? ``place`` is a row's position in it.

    One row per day, so one small window.
    """
    before = F.lag(day).over(Window.orderBy(place))
    steps = rows.select(day, (before >= F.col(day)).alias("_back"))
    return steps.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(day).alias("distinct_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.count_if(F.coalesce(F.col("_back"), F.lit(False))).alias("out_of_order"),
    ).withColumn("ok", (F.col("n") == F.col("distinct_days")) & (F.col("out_of_order") == 0))
