"""Device registry, heartbeats and shadows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline import schema
from gaugeline.functions.scalars import entries, or_empty
from gaugeline.operators.records import page_bounds
from gaugeline.plans.groups import attach
from gaugeline.plans.ordered import Running, ordered


def is_online(last_seen: Column, asof: Column, minutes: int = schema.ONLINE_MINUTES) -> Column:
    """Seen within the last minutes, the exact limit included."""
    return F.coalesce(last_seen >= asof - F.expr(f"interval {minutes} minutes"), F.lit(False))


def device_status(devices: DataFrame, asof: Column) -> DataFrame:
    return devices.withColumn(
        "status", F.when(is_online(F.col("last_seen"), asof), "online").otherwise("offline"))


def device_list(devices: DataFrame, asof: Column, type: str | None = None,
                project_id: object = None, status: str | None = None, page: int = 1,
                page_size: int = schema.PAGE_SIZE) -> DataFrame:
    """One newest-first page of devices that match every given filter."""
    df = device_status(devices, asof)
    for column, wanted in {"type": type, "project_id": project_id, "status": status}.items():
        if wanted is not None:
            df = df.filter(F.col(column) == F.lit(wanted))
    offset, size = page_bounds(page, page_size)
    return df.orderBy(F.col("created_at").desc(), "dev_code").offset(offset).limit(size)


def device_code_check(devices: DataFrame) -> DataFrame:
    """Validity of the code, with type and name filled in where blank."""
    code = F.col("dev_code")
    names = F.create_map(*[F.lit(x) for x in chain(*schema.DEVICE_TYPES.items())])
    kind = F.coalesce(F.nullif("type", F.lit("")), F.substring(code, 1, 2))
    label = F.concat_ws("-", F.coalesce(F.try_element_at(names, kind), kind),
                        F.expr("substring(dev_code, 4)"))
    return devices.withColumns({
        "valid": code.rlike(schema.DEVICE_CODE),
        "type": kind,
        "name": F.coalesce(F.nullif("name", F.lit("")), label)})


def unknown_devices(messages: DataFrame, devices: DataFrame) -> DataFrame:
    """Messages from devices that are not registered."""
    return attach(messages, devices.select("dev_code"), ["dev_code"], "left_anti")


def existing_devices(requests: DataFrame, devices: DataFrame) -> DataFrame:
    """Registrations for codes that are taken."""
    return attach(requests, devices.select("dev_code"), ["dev_code"], "left_semi")


def device_patch(devices: DataFrame, patches: DataFrame,
                 fields: tuple[str, ...] = ("name", "type", "project_id", "ip", "version"),
                 ) -> DataFrame:
    """Stored devices with the supplied (non-null) fields replaced."""
    given = patches.select("dev_code", *[F.col(f).alias(f"__{f}") for f in fields])
    joined = devices.join(given, "dev_code", "left")
    return joined.withColumns(
        {f: F.coalesce(f"__{f}", f) for f in fields}).drop(*[f"__{f}" for f in fields])


def device_online_stats(devices: DataFrame, asof: Column) -> DataFrame:
    online = is_online(F.col("last_seen"), asof)
    return devices.agg(F.count(F.lit(1)).alias("total"), F.count_if(online).alias("online"),
                       F.count_if(~online).alias("offline"))


def device_latest(heartbeats: DataFrame, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Newest sight of each device; ip and version keep their last non-blank value."""
    at = F.struct(time, tie)

    def last_given(column: str) -> Column:
        filled = F.nullif(column, F.lit(""))
        return F.max_by(filled, F.when(filled.isNotNull(), at)).alias(column)

    return heartbeats.groupBy("dev_code").agg(
        F.max(time).alias("last_seen"), last_given("ip"), last_given("version"))


def shadow_version(updates: DataFrame, order: list[str]) -> DataFrame:
    """Version of the shadow after each update: 1 + updates so far."""
    return (ordered(updates, ["dev_code"], order).position("version").result()
            .withColumn("version", F.col("version") + 2))


def shadow_state(updates: DataFrame, time: str, tie: str, mode: str = "replace") -> DataFrame:
    """Newest reported map per device and the version it led to.

    "replace" keeps the newest map as a whole; "merge" keeps the newest value of
    every key.
    """
    at = F.struct(time, tie)
    versions = F.count(F.lit(1)) + 1
    if mode == "replace":
        return updates.groupBy("dev_code").agg(
            F.max_by("reported", at).alias("reported"), versions.alias("version"),
            F.max(time).alias("timestamp"))
    if mode != "merge":
        raise ValueError("mode must be replace or merge")
    per_key = updates.select("dev_code", time, tie, F.explode("reported").alias("k", "v"))
    newest = per_key.groupBy("dev_code", "k").agg(F.max_by("v", at).alias("v"))
    maps = newest.groupBy("dev_code").agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("reported"))
    totals = updates.groupBy("dev_code").agg(versions.alias("version"),
                                             F.max(time).alias("timestamp"))
    return maps.join(totals, "dev_code").select("dev_code", "reported", "version", "timestamp")


def shadow_sync(shadows: DataFrame) -> DataFrame:
    """Whether reported and desired differ, and the desired entries still to apply."""
    reported, desired = or_empty(F.col("reported")), or_empty(F.col("desired"))
    delta = F.map_filter(
        desired, lambda k, v: ~F.try_element_at(reported, k).eqNullSafe(v))
    return shadows.withColumns({
        "need_sync": ~entries(F.col("reported")).eqNullSafe(entries(F.col("desired"))),
        "delta": delta})


def reading_dims(readings: DataFrame, points: DataFrame, gateways: DataFrame,
                 projects: DataFrame, how: str = "left") -> DataFrame:
    """Readings with the names of their measure point, gateway and project.

    Measure points may be many, and one may hold most readings, so hot ones are
    attached apart; the gateway and project tables are left to the optimizer.
    """
    return (attach(readings, points, ["measure_point_id"], how)
            .join(gateways, "gateway_code", how)
            .join(projects, "project_id", how))


def liveness_sessions(heartbeats: DataFrame, time: str = "ts",
                      minutes: int = schema.ONLINE_MINUTES) -> DataFrame:
    """Online spans per device: a gap longer than the limit ends a span.

    `offline_at` is the moment the device stops counting as online.
    """
    scan = ordered(heartbeats, ["dev_code"], [time, "event_id"])
    scan = scan.neighbour(-1, __before=F.col(time))
    gap = F.col("__before").isNull() | (
        F.col(time) > F.col("__before") + F.expr(f"interval {minutes} minutes"))
    scan = scan.with_columns(__new=gap.cast("int"))
    rows = scan.running(__span=Running("sum", F.col("__new"))).result()
    return rows.groupBy("dev_code", "__span").agg(
        F.min(time).alias("online_at"), F.max(time).alias("last_seen"),
        F.count(F.lit(1)).alias("heartbeats"),
    ).withColumn("offline_at", F.col("last_seen") + F.expr(f"interval {minutes} minutes")).drop(
        "__span")
