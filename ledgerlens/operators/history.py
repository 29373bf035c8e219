"""Transaction features from a customer's own past.

Input rows are transactions: `customer`, `transaction_id`, `ts` (timestamp without zone), `amount`, `merchant`,
`failed` (boolean) and, where known, `merchant_category`, `device`, `latitude`, `longitude`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.fixed_values import (
    DEFAULT_AGE_DAYS,
    DEFAULT_COUNT_30D,
    DEFAULT_MERCHANTS_7D,
    DEFAULT_MINUTES,
    MERCHANT_CATEGORIES,
    TRANSACTION_FEATURES,
    UNKNOWN_CATEGORY,
)
from ledgerlens.functions.clock import is_after_hours, weekday_or
from ledgerlens.functions.timeline import DAY, following_times, scan_timeline

EARTH_RADIUS_KM = 6371.0


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.floor(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) / 1e6).cast(
        "long"
    )


#: What a transaction leaves for the next one of its customer.
_ITEM = "struct<at:bigint,device:string,latitude:double,longitude:double>"
_SUMS = ["n", "units", "micros", "failures", "merchants"]


def _timeline(transactions: DataFrame) -> DataFrame:
    """Every transaction, and rows that take it out of its windows again: its count and amount 30 days later, a failure
    a day later, a merchant 7 days after a purchase or with the next purchase there, whichever is first.

    The sum over strictly earlier times is then the window of a transaction: it holds the times from `t - length` to
    `t - 1 second`, because what leaves at `t` still counts at `t`.
    """
    amount = F.coalesce(F.col("amount").try_cast("decimal(28,6)"), F.lit(0).cast("decimal(28,6)"))
    units = F.floor(amount).cast("long")
    micros = ((amount - F.floor(amount)) * 1000000).cast("long")
    failed = F.coalesce(F.col("failed").cast("long"), F.lit(0).cast("long"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")

    def place(at: Column, told: bool, **sums: Column) -> list[Column]:
        carried = ["row", "item", "ts", "transaction_id"]
        columns = [F.col(c) if told else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in carried]
        return ["customer", at.alias("at"), *columns, *[sums.get(m, zero).alias(m) for m in _SUMS]]

    rows = transactions.select(
        "customer",
        epoch_seconds(F.col("ts")).alias("at"),
        F.struct(*[F.col(c) for c in transactions.columns]).alias("row"),
        F.struct(
            epoch_seconds(F.col("ts")).alias("at"),
            *[
                (F.col(c) if c in transactions.columns else F.lit(None)).cast(kind).alias(c)
                for c, kind in (("device", "string"), ("latitude", "double"), ("longitude", "double"))
            ],
        ).alias("item"),
        "ts",
        "transaction_id",
        units.alias("units"),
        micros.alias("micros"),
        failed.alias("failures"),
        "merchant",
    )
    u, m, f = F.col("units"), F.col("micros"), F.col("failures")
    spells = following_times(rows.filter(F.col("merchant").isNotNull()), F.struct("customer", "merchant"), "at")
    spells = spells.select(F.col("group.customer").alias("customer"), "at", "next_at")
    week_end = F.col("at") + 7 * DAY
    entering = spells.select(*place(F.col("at"), False, merchants=one))
    leaving = spells.select(*place(F.least(week_end, F.coalesce("next_at", week_end)), False, merchants=-one))
    return (
        rows.select(*place(F.col("at"), True, n=one, units=u, micros=m, failures=f))
        .unionByName(rows.select(*place(F.col("at") + 30 * DAY, False, n=-one, units=-u, micros=-m)))
        .unionByName(rows.filter(f > 0).select(*place(F.col("at") + DAY, False, failures=-f)))
        .unionByName(entering)
        .unionByName(leaving)
    )


def _on_the_clock(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions with customer and time, and the others, which have no history."""
    known = F.col("customer").isNotNull() & F.col("ts").isNotNull()
    return transactions.filter(known), transactions.filter(~known)


def _history_columns(columns: list[str], previous: Column, first_at: Column, sums: dict[str, Column]) -> list[Column]:
    """The history of a row from what its scan found: windows, age, and the step from the previous transaction."""
    at, prev = epoch_seconds(F.col("ts")), F.try_element_at(previous, F.lit(-1))
    total = sums["units"].cast("double") + sums["micros"] / 1e6
    device = F.col("device").cast("string") if "device" in columns else F.lit(None).cast("string")
    place = [F.col(c) if c in columns else F.lit(None).cast("double") for c in ("latitude", "longitude")]
    return [
        sums["n"].alias("transaction_count_30d"),
        F.try_divide(total, sums["n"]).alias("avg_amount_30d"),
        sums["failures"].alias("failed_attempts_24h"),
        sums["merchants"].alias("unique_merchants_7d"),
        (F.floor(at / DAY) - F.floor(first_at / DAY)).cast("long").alias("customer_age_days"),
        ((at - prev["at"]) / 60.0).alias("minutes_since_prev"),
        haversine_km(prev["latitude"], prev["longitude"], *place).alias("distance_from_prev"),
        (prev["device"] == device).alias("same_device"),
    ]


def with_history(transactions: DataFrame) -> DataFrame:
    """Transactions with the columns of their history, in one scan of the timeline.

    Over the customer's strictly earlier seconds: `transaction_count_30d` and `avg_amount_30d` of 30 days,
    `failed_attempts_24h`, `unique_merchants_7d`; and against the previous transaction (by time, then id):
    `customer_age_days` since the first one, `minutes_since_prev`, `distance_from_prev` in kilometres, `same_device`.
    A transaction without customer or time has no history: counts 0, the rest null.
    """
    known, unknown = _on_the_clock(transactions)
    scanned = scan_timeline(
        _timeline(known), "customer", "at", ["ts", "transaction_id"], F.col("row"), F.col("item"), 1, _SUMS,
        only=F.col("row").isNotNull(),
    )
    flat = scanned.select("row.*", F.col("previous").alias("_previous"), F.col("first_at").alias("_first_at"), *[F.col(s).alias(f"_{s}") for s in _SUMS])
    columns = transactions.columns
    sums, zero = ({s: make(s) for s in _SUMS} for make in (lambda s: F.col(f"_{s}"), lambda s: F.lit(0).cast("long")))
    none = F.lit(None).cast(f"array<{_ITEM}>"), F.lit(None).cast("long")
    found = flat.select(*columns, *_history_columns(columns, F.col("_previous"), F.col("_first_at"), sums))
    return found.unionByName(unknown.select(*columns, *_history_columns(columns, *none, zero)))


def history_windows(transactions: DataFrame) -> DataFrame:
    """Per transaction: amount mean and count of 30 days, failures of 24 hours, distinct merchants of 7 days."""
    columns = ["transaction_count_30d", "avg_amount_30d", "failed_attempts_24h", "unique_merchants_7d"]
    narrow = transactions.select("customer", "transaction_id", "ts", "amount", "merchant", "failed")
    return with_history(narrow).select("transaction_id", *columns)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def previous_transaction(transactions: DataFrame) -> DataFrame:
    """Per transaction: customer age in days, minutes and kilometres since the previous one, and same device."""
    columns = ["customer_age_days", "minutes_since_prev", "distance_from_prev", "same_device"]
    return with_history(transactions).select("transaction_id", *columns)


def category_weight(category: Column) -> Column:
    """Weight of a merchant category name; a numeric category code is scaled by 10000 and capped at 1."""
    entries = [F.lit(x) for pair in MERCHANT_CATEGORIES.items() for x in pair]
    named = F.coalesce(F.try_element_at(F.create_map(*entries), F.lower(category)), F.lit(UNKNOWN_CATEGORY))
    code = category.try_cast("double")
    return F.when(code.isNotNull(), F.least(code / 10000, F.lit(1.0))).otherwise(named)


def _or(value: Column, default: Column) -> Column:
    """`default` for a missing or zero value."""
    return F.when(value.isNull() | (value == 0), default).otherwise(value)


def transaction_vector(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 15 named features as doubles, from transaction and history columns, with defaults for missing history."""
    amount = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    average = _or(F.col("avg_amount_30d"), amount)
    hour = F.coalesce(F.hour("ts"), F.lit(12))
    weekday = weekday_or(F.col("ts"), 2)
    features = {
        "amount": amount,
        "amount_ratio": amount / _or(average, F.lit(1.0)),
        "hour": hour,
        "day_of_week": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "is_after_hours": is_after_hours(hour, "transaction").cast("int"),
        "customer_age_days": _or(F.col("customer_age_days"), F.lit(DEFAULT_AGE_DAYS)),
        "transaction_count_30d": _or(F.col("transaction_count_30d"), F.lit(DEFAULT_COUNT_30D)),
        "avg_amount_30d": average,
        "merchant_category": category_weight(F.col("merchant_category")),
        "same_device": F.coalesce(F.col("same_device").cast("int"), F.lit(0)),
        "distance_from_prev": F.coalesce("distance_from_prev", F.lit(0.0)),
        "minutes_since_prev": _or(F.col("minutes_since_prev"), F.lit(DEFAULT_MINUTES)),
        "failed_attempts_24h": F.coalesce("failed_attempts_24h", F.lit(0)),
        "unique_merchants_7d": _or(F.col("unique_merchants_7d"), F.lit(DEFAULT_MERCHANTS_7D)),
    }
    vector = [features[n].cast("double").alias(n) for n, _, _ in TRANSACTION_FEATURES]
    return rows.select("transaction_id", *keep, *vector)


def normalise_vector(vectors: DataFrame, stats: list[tuple[str, float, float]] = TRANSACTION_FEATURES) -> DataFrame:
    """(value - mean) / deviation per feature, a zero deviation counting as 1."""
    return vectors.select(
        "transaction_id", *[((F.col(n) - mean) / (sd or 1.0)).alias(n) for n, mean, sd in stats]
    )


def _sequences(rows: DataFrame, item: Column, pad: Column, length: int) -> DataFrame:
    """customer, transaction_id, and `sequence`: `length` items up to the row's own, `pad` in front where there are fewer."""
    known, unknown = _on_the_clock(rows)
    own = F.struct("customer", "transaction_id", item.alias("item"))
    scanned = scan_timeline(
        known.withColumn("_at", epoch_seconds(F.col("ts"))), "customer", "_at", ["ts", "transaction_id"], own, item, length - 1
    ).select("row.*", "previous")
    alone = unknown.select("customer", "transaction_id", item.alias("item")).withColumn(
        "previous", F.array().cast(scanned.schema["previous"].dataType)
    )
    sequence = F.concat("previous", F.array("item"))
    padded = F.concat(F.array_repeat(pad, F.lit(length) - F.size(sequence)), sequence)
    return scanned.unionByName(alone).select("customer", "transaction_id", padded.alias("sequence"))


def last_sequences(transactions: DataFrame, length: int = 7) -> DataFrame:
    """Each transaction with its `length` latest (itself included, oldest first), padded in front with empty ones."""
    empty = F.struct(
        F.lit(None).cast(transactions.schema["transaction_id"].dataType).alias("transaction_id"),
        F.lit(0.0).alias("amount"),
        F.lit(None).cast("timestamp_ntz").alias("ts"),
    )
    return _sequences(transactions, F.struct("transaction_id", "amount", "ts"), empty, length)


def feature_sequences(transactions: DataFrame, length: int = 7, history: bool = True) -> DataFrame:
    """Each transaction with the 15 features of its `length` latest: `sequence`, an array of arrays, oldest first.

    Steps that do not exist have the features of an empty transaction. Without `history` every step is extracted on its
    own, with the defaults for what the past would tell.
    """
    names = [n for n, _, _ in TRANSACTION_FEATURES]
    past = {
        "transaction_count_30d": "long", "avg_amount_30d": "double", "failed_attempts_24h": "long", "unique_merchants_7d": "long",
        "customer_age_days": "long", "minutes_since_prev": "double", "distance_from_prev": "double", "same_device": "boolean",
    }
    blank = {c: F.lit(None).cast(kind) for c, kind in past.items()}
    rows = with_history(transactions) if history else transactions.withColumns(blank)
    spark = transactions.sparkSession
    nothing = spark.range(1).select(
        F.lit(0).alias("transaction_id"), F.lit(0.0).alias("amount"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.lit(None).cast("string").alias("merchant_category"), *[c.alias(n) for n, c in blank.items()],
    )
    pad = F.array(*[F.lit(float(v)) for v in transaction_vector(nothing).select(*names).first()])
    vectors = transaction_vector(rows, ["customer", "ts"])
    return _sequences(vectors, F.array(*names), pad, length)
