"""Results of tools as they pass by: which are understood, and which are shown reduced because the whole message gets smaller by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.redaction import is_strict_json, redacted
from tesserae.operators.reduce import reduced_outputs

# Fields of a native result and their kinds, fields of which one holds the exit code, events that only concern the session (fixed values).
NEEDED = {"stdout": "STRING", "stderr": "STRING", "interrupted": "BOOLEAN", "isImage": "BOOLEAN"}
EXITS = ["exitCode", "exit_code", "returnCode"]
OPTIONAL = {**dict.fromkeys(EXITS, r"(?:BIGINT|DECIMAL\(\d+,0\)|VOID)"), "truncated": "BOOLEAN"}
LIFECYCLE = ["SessionStart", "PreCompact", "PostCompact", "SessionEnd"]


def _field(c: Column, name: str) -> Column:
    return F.get_json_object(c, f"$.{name}")


def understood(events: DataFrame, event: str, most_bytes: int = 2 << 20, marker: str = "[evidence:") -> DataFrame:
    """events with `why_not`, null for a result that can be reduced: malformed (no JSON object, or larger than `most_bytes`), lifecycle,
    other_tool, unknown_shape (a field is missing or of another kind), unknown_fields, interrupted_or_image, already_reduced; and with `stdout`, `stderr`,
    `exit_code` of the result, both texts redacted, and `native`, its JSON."""
    valid = F.coalesce((F.octet_length(event) <= most_bytes) & F.col(event).rlike(r"\A\s*\{") & is_strict_json(F.col(event)), F.lit(False))
    rows = events.withColumn("_e", F.when(valid, F.col(event))).withColumn("native", _field(F.col("_e"), "tool_response"))
    rows = rows.withColumn("_kinds", F.schema_of_variant(F.try_parse_json(F.when(F.col("native").rlike(r"\A\{"), F.col("native"))))).withColumn("_keys", F.json_object_keys("native"))
    kind = lambda name, kinds: F.col("_kinds").rlike(rf"[<\s]{name}: {kinds}[,>]")
    shape = F.coalesce(F.forall(F.array(*[kind(n, k) for n, k in NEEDED.items()]), lambda x: x), F.lit(False))
    for n, k in OPTIONAL.items():
        shape = shape & (~F.array_contains("_keys", n) | kind(n, k))
    name = F.coalesce(_field(F.col("_e"), "hook_event_name"), F.lit(""))
    out, err = _field(F.col("native"), "stdout"), _field(F.col("native"), "stderr")
    why = (
        F.when(F.col("_e").isNull(), "malformed").when(name.isin(LIFECYCLE), "lifecycle")
        .when((name != "PostToolUse") | (F.coalesce(_field(F.col("_e"), "tool_name"), F.lit("")) != "Bash"), "other_tool")
        .when(F.size(F.array_except("_keys", F.array(*[F.lit(k) for k in [*NEEDED, *OPTIONAL]]))) > 0, "unknown_fields").when(~F.coalesce(shape, F.lit(False)), "unknown_shape")
        .when((_field(F.col("native"), "interrupted") == "true") | (_field(F.col("native"), "isImage") == "true"), "interrupted_or_image")
        .when(F.contains(out, F.lit(marker)) | F.contains(err, F.lit(marker)), "already_reduced")
    )
    code = F.coalesce(*[F.try_to_number(_field(F.col("native"), k), F.lit("S999999999")).cast("long") for k in EXITS])
    return rows.withColumn("why_not", why).withColumn("stdout", redacted(out)).withColumn("stderr", redacted(err)).withColumn("exit_code", code).drop("_e", "_kinds", "_keys")


def message(stdout: Column, stderr: Column, native: Column) -> Column:
    """The native result with other texts, as it is sent."""
    rest = [F.from_json(native, "interrupted boolean, isImage boolean, exitCode long, exit_code long, returnCode long, truncated boolean")[k].alias(k) for k in ("interrupted", "isImage", *EXITS, "truncated")]
    return F.to_json(F.struct(stdout.alias("stdout"), stderr.alias("stderr"), *rest))


def reduced_results(events: DataFrame, key: str, event: str, mode: str = "balanced", marker: str = "[evidence:") -> DataFrame:
    """(key, reason, applied, original_bytes, reduced_bytes, saved_bytes, original_tokens, reduced_tokens, shown) of each result.

    A result that is understood is archived under `key`, reduced, and given a reference to its archive; it replaces the original only if the whole
    message, reference included, is smaller. In mode observe nothing is replaced, and saved_bytes says what would be. What is not understood stays as
    it is. Sizes are those of whole messages with redacted texts.
    """
    rows = understood(events, event, marker=marker).withColumn("_artifact", F.col(key).cast("string"))
    cut_down = reduced_outputs(rows.filter("why_not is null"), key, "stdout", "balanced", exit_code="exit_code", artifact="_artifact").select(key, F.col("reason").alias("_reason"), F.col("applied").alias("_fits"), F.col("reducer_id").alias("_by"), F.col("output").alias("_out"))
    both = rows.join(cut_down, key, "left")
    short = F.concat(F.col("_out"), F.lit("\n" + marker + " "), F.col("_artifact"), F.lit("; reducer "), F.col("_by"), F.lit("]"))
    both = both.withColumn("_whole", message(F.col("stdout"), F.col("stderr"), F.col("native"))).withColumn("_short", F.when(F.col("_fits"), message(short, F.col("stderr"), F.col("native"))))
    a, b = F.octet_length("_whole").cast("long"), F.octet_length("_short").cast("long")
    smaller = F.coalesce(b < a, F.lit(False))
    applied = smaller & F.lit(mode != "observe")
    reason = F.coalesce("why_not", F.when(~F.coalesce("_fits", F.lit(False)), F.col("_reason")).when(~smaller, "no_net_gain").when(F.lit(mode == "observe"), "observe_only").otherwise("reduced"))
    after = F.when(applied, b).otherwise(a)
    return both.select(
        key, reason.alias("reason"), applied.alias("applied"), a.alias("original_bytes"), after.alias("reduced_bytes"), F.when(smaller, a - b).otherwise(F.when(a.isNotNull(), F.lit(0))).cast("long").alias("saved_bytes"),
        F.ceil(a / 3).alias("original_tokens"), F.ceil(after / 3).alias("reduced_tokens"), F.when(applied, F.col("_short")).otherwise(F.col(event)).alias("shown"),
    )
