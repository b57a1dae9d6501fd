"""Usage telemetry sources: nested log and metric exports, JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KV = "array<struct<key: string, value: struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>>>"
LOGS = f"resourceLogs array<struct<resource: struct<attributes: {_KV}>, scopeLogs: array<struct<logRecords: array<struct<body: struct<stringValue: string>, attributes: {_KV}>>>>>>"
METRICS = f"resourceMetrics array<struct<resource: struct<attributes: {_KV}>, scopeMetrics: array<struct<metrics: array<struct<name: string, sum: struct<aggregationTemporality: int, dataPoints: array<struct<attributes: {_KV}, startTimeUnixNano: string, timeUnixNano: string, asInt: string, asDouble: double>>>>>>>>>"
TURNS = "type string, thread_id string, usage struct<input_tokens: bigint, cached_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint>"
MAX_NANOS = 8_640_000_000_000_000_000_000
SAFE_INT = 2**53 - 1


def attributes(c: Column) -> Column:
    """Attribute list as a map: the first value that is there, as text; of equal keys the last; a null list is empty."""
    pairs = F.transform(
        F.filter(F.coalesce(c, F.array().cast(_KV)), lambda a: a["key"].isNotNull()),
        lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string"), a["value"]["boolValue"].cast("string")).alias("value")),
    )
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def merged(a: Column, b: Column) -> Column:
    """Two attribute maps, b over a."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def token_count(c: Column) -> Column:
    """A count from text: digits only, exact in double precision; anything else that is not null fails."""
    ok = c.rlike(r"^\d{1,16}$") & (c.cast("decimal(20,0)") <= SAFE_INT)
    return F.when(c.isNull(), F.lit(None).cast("long")).when(ok, c.cast("long")).otherwise(F.raise_error(F.lit("a token count must be null or an exact number from 0")).cast("long"))


def nanoseconds(c: Column) -> Column:
    """Nanoseconds since the epoch as decimal(25,0); more than 25 digits or beyond the largest date fails."""
    value = c.cast("decimal(25,0)")
    ok = c.rlike(r"^\d{1,25}$") & (value <= F.lit(str(MAX_NANOS)).cast("decimal(25,0)"))
    return F.when(c.isNull(), F.lit(None).cast("decimal(25,0)")).when(ok, value).otherwise(F.raise_error(F.lit("not a time in nanoseconds")).cast("decimal(25,0)"))


def nanos_to_timestamp(c: Column) -> Column:
    return F.timestamp_millis(F.floor(c / F.lit(1_000_000)).cast("long"))


def log_requests(df: DataFrame, key: str, text: str, event: str = "api_request") -> DataFrame:
    """(key, request_id, attributes, input, cached, written, output, total) of the request records in exported logs (one JSON text a row).

    total is null if any part is unknown. Records of other events, and those without a request id, are left out. A text that is no
    such export has no rows.
    """
    root = df.select(key, F.from_json(F.col(text), LOGS).alias("r"))
    res = root.select(key, F.explode("r.resourceLogs").alias("res"))
    scope = res.select(key, attributes(F.col("res.resource.attributes")).alias("ra"), F.explode("res.scopeLogs").alias("s"))
    rec = scope.select(key, "ra", F.explode("s.logRecords").alias("l")).select(key, merged(F.col("ra"), attributes(F.col("l.attributes"))).alias("a"), F.col("l.body.stringValue").alias("body"))
    rec = rec.filter((F.col("a")["event.name"] == event) | F.col("body").endswith("." + event)).withColumn("request_id", F.coalesce(F.nullif(F.col("a")["request_id"], F.lit("")), F.nullif(F.col("a")["client_request_id"], F.lit(""))))
    n = {"input": "input_tokens", "cached": "cache_read_tokens", "written": "cache_creation_tokens", "output": "output_tokens"}
    rec = rec.filter("request_id is not null").withColumns({k: token_count(F.col("a")[v]) for k, v in n.items()})
    return rec.select(key, "request_id", F.col("a").alias("attributes"), *n, (F.col("input") + F.col("cached") + F.col("written") + F.col("output")).alias("total"))


def metric_points(df: DataFrame, key: str, text: str, metric: str) -> DataFrame:
    """(key, attributes, temporality, start_nanos, time_nanos, value) of a metric's points; a temporality other than 1 or 2 fails."""
    root = df.select(key, F.from_json(F.col(text), METRICS).alias("r"))
    res = root.select(key, F.explode("r.resourceMetrics").alias("res"))
    scope = res.select(key, attributes(F.col("res.resource.attributes")).alias("ra"), F.explode("res.scopeMetrics").alias("s"))
    m = scope.select(key, "ra", F.explode("s.metrics").alias("m")).filter(F.col("m.name") == metric)
    t = F.col("m.sum.aggregationTemporality")
    checked = F.when(t.isin(1, 2), t).otherwise(F.raise_error(F.lit("a metric needs temporality 1 or 2")).cast("int"))
    p = m.select(key, "ra", checked.alias("temporality"), F.explode("m.sum.dataPoints").alias("p"))
    value = F.coalesce(token_count(F.col("p.asInt")), F.col("p.asDouble").cast("long"))
    return p.select(key, merged(F.col("ra"), attributes(F.col("p.attributes"))).alias("attributes"), "temporality", nanoseconds(F.col("p.startTimeUnixNano")).alias("start_nanos"), nanoseconds(F.col("p.timeUnixNano")).alias("time_nanos"), value.alias("value"))


def completed_turns(lines: DataFrame, key: str, line: str) -> DataFrame:
    """(key, input, cached, output, reasoning, total) of completed turns in JSON lines; cache and reasoning are parts, not added. Blank lines and other types are left out; a part above its whole fails."""
    rows = lines.filter(F.length(F.trim(line)) > 0).select(key, F.from_json(F.col(line), TURNS).alias("v")).filter(F.col("v.type") == "turn.completed")
    u = F.col("v.usage")
    bad = (u["cached_input_tokens"] > u["input_tokens"]) | (u["reasoning_output_tokens"] > u["output_tokens"])
    total = F.when(bad, F.raise_error(F.lit("a part cannot exceed its whole")).cast("long")).otherwise(u["input_tokens"] + u["output_tokens"])
    return rows.select(key, u["input_tokens"].alias("input"), u["cached_input_tokens"].alias("cached"), u["output_tokens"].alias("output"), u["reasoning_output_tokens"].alias("reasoning"), total.alias("total"))
