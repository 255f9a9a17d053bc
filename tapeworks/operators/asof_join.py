"""As-of join: for each row of one table the last known row of another, by key and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_CARRIED, _KNOWN, _ASKED = -1, 0, 1  # order of events at one moment


def asof_join(
    left: DataFrame, right: DataFrame, keys: tuple[str, ...], time: str, known: str, values: tuple[str, ...], bucket: int, within: int | None = None, strict: bool = False
) -> DataFrame:
    """``left`` with ``known`` (a time) and ``values`` of the last row of ``right`` with the same keys and ``known`` <= ``time``.

    Times are whole numbers of one unit. ``strict`` asks for ``known`` < ``time``; ``within`` leaves out what is older than that.
    Of rows of one key and time the one with the greatest values counts. Rows without a match, or with a null key or time, get nulls.

    Time is cut into buckets of ``bucket`` units, and (keys, bucket) is what rows are grouped by: a key that holds a third of them
    is spread over its buckets. What a bucket inherits is the last row of the buckets before it, found on one row for each
    bucket, and enters it as one more event; so the answer needs neither a range join nor a whole key in one task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    group = [*names, "_b"]
    bucket_of = lambda t: F.floor(t / F.lit(bucket)).cast("long")
    record = F.struct(F.col(known).cast("long").alias("t"), *[F.col(v).alias(v) for v in values])
    some = F.lit(True)
    for k in keys:
        some = some & F.col(k).isNotNull()
    known_rows = right.filter(some & F.col(known).isNotNull()).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(known).cast("long").alias("_t"), record.alias("_v")
    ).withColumn("_b", bucket_of(F.col("_t")))
    asked = left.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(time).cast("long").alias("_t"), F.struct(*left.columns).alias("_row"))
    asked = asked.withColumn("_b", bucket_of(F.col("_t")))

    lasts = known_rows.groupBy(*group).agg(F.max("_v").alias("_v"))
    nothing = F.lit(None).cast(known_rows.schema["_v"].dataType)
    heads = lasts.unionByName(asked.select(*group).distinct().withColumn("_v", nothing)).groupBy(*group).agg(F.max("_v").alias("_v"))
    before = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = heads.select(*group, F.last("_v", ignorenulls=True).over(before).alias("_v")).filter(F.col("_v").isNotNull())

    no_row = F.lit(None).cast(asked.schema["_row"].dataType)
    side = _KNOWN + 2 if strict else _KNOWN
    events = (
        carried.select(*group, F.lit(None).cast("long").alias("_t"), F.lit(_CARRIED).alias("_side"), "_v", no_row.alias("_row"))
        .unionByName(known_rows.select(*group, "_t", F.lit(side).alias("_side"), "_v", no_row.alias("_row")))
        .unionByName(asked.select(*group, "_t", F.lit(_ASKED).alias("_side"), nothing.alias("_v"), "_row"))
    )
    # Nulls sort first: what is carried precedes all of its bucket.
    so_far = Window.partitionBy(*group).orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_v").asc_nulls_first())
    found = F.last("_v", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    answered = events.withColumn("_v", found).filter(F.col("_row").isNotNull())
    usable: Column = F.col("_t").isNotNull()
    for n in names:
        usable = usable & F.col(n).isNotNull()
    if within is not None:
        usable = usable & (F.col("_t") - F.col("_v.t") <= within)
    answer = lambda field: F.when(usable, F.col(f"_v.{field}"))
    return answered.select("_row.*", answer("t").alias(known), *[answer(v).alias(v) for v in values])
