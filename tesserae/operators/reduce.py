"""Conservative reduction of noisy tool output as column expressions, nine formats, each with a check that can reject its result.

A text is one array of lines, and every step a higher-order function over it, so that texts are reduced where they are read: no explode, no
shuffle, no Python but for one strict look at texts that begin like JSON. A format says how it is recognised, what it makes of the lines, and
how the result proves that nothing is lost; the check works from the result alone and shares nothing with the step that made it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.redaction import strict_json
from tesserae.functions.runtime import spread
from tesserae.functions.text import compact_json, lines_of, not_blank, status_of
from tesserae.operators.lines import FAILURE, PASSED, SEARCH_HIT

# Forms by which output is recognised, and texts of the reduced forms (fixed values; those of single lines are in lines.py).
VITEST_RUN, VITEST_LINE = r"(?i)\bTest Files\s+\d|\bRUN\s+v\d|\bvitest\b", r"Tests?\s+\d|[✓×✕]"
JEST_LINE = r"(?m)^Test Suites:|^Tests:\s+\d|^\s*(?:PASS|FAIL)\s+\S+\.[cm]?[jt]sx?"
TSC_LINE = r"(?:\(\d+,\d+\)|:\d+:\d+)\s*:?\s*(?:error|warning) TS\d+:"
ESLINT_LINE = r"\d+:\d+\s+(?:error|warning)\s+.+"
DIFF_HEAD, DIFF_BODY = r"(?m)^diff --git ", r"(?m)^(?:@@ |Binary files |GIT binary patch)"
STATUS_LINE = r"(?m)^(?:On branch |## |# branch\.|[ MADRCU?!]{2} .+|[12u?] .+)$"
OBJECT_IDS = r"^index [0-9a-f]+\.\.[0-9a-f]+(?: \d+)?$"
REPEATED = r"^\[exact repeated line: (\d+) occurrences; order unchanged\]$"
REPEATED_TEXT = "[exact repeated line: %s occurrences; order unchanged]"
GROUPED_TEXT = "%s successful test/suite lines grouped."
DIFF_TEXT = "Diff evidence; NOT AN APPLYABLE PATCH. Full patch: artifact %s."


@dataclass(frozen=True)
class Text:
    """The columns of one text: itself, its lines, what kind of JSON it is (null, json, tests or lint), the artifact that holds the original."""

    text: Column
    lines: Column
    json: Column
    artifact: Column


@dataclass(frozen=True)
class Format:
    """A format: how a text shows it, its reduced form, and whether a form (second argument) still holds the text."""

    id: str
    shows: Callable[[Text], Column]
    reduced: Callable[[Text], Column]
    holds: Callable[[Text, Column], Column]


def json_kind(text: Column) -> Column:
    """'tests' for a test report, 'lint' for a lint report, 'json' for any other object or list, null for what no strict parser reads."""

    def kind(t: str | None) -> str | None:
        value = strict_json(t) if t is not None else None
        if isinstance(value, dict):
            total = value.get("numTotalTests")
            return "tests" if isinstance(value.get("testResults"), list) and isinstance(total, (int, float)) and not isinstance(total, bool) else "json"
        if isinstance(value, list):
            each = [isinstance(x, dict) and isinstance(x.get("filePath"), str) and isinstance(x.get("messages"), list) for x in value]
            return "lint" if each and all(each) else "json"
        return None

    @F.pandas_udf("string")
    def kinds(s: pd.Series) -> pd.Series:
        return s.map(kind)

    return kinds(F.when(text.rlike(r"\A\s*[\[{]"), text))


# --- steps over arrays of lines


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once: what stands in the body of a function over an array is else worked out for each entry."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def without_blanks(lines: Column) -> Column:
    return F.filter(lines, not_blank)


def _bounds(lines: Column, starts: Callable[[Column], Column]) -> Column:
    """Places (from 0) at which `starts` holds, with the number of lines at the end."""
    return F.concat(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), starts), F.array(F.size(lines)))


def _spans(bounds: Column) -> Column:
    """struct(a, n) of each stretch between neighbouring places."""
    return bound(bounds, lambda b: F.transform(F.slice(b, 1, F.size(b) - 1), lambda a, k: F.struct(a.alias("a"), (F.get(b, k + 1) - a).alias("n"))))


def passing_lines(lines: Column) -> Column:
    """Places of passing lines before the first failure."""
    failure = F.array_position(F.transform(lines, lambda x: x.rlike(FAILURE)), True)
    end = bound(failure, lambda f: F.when(f == 0, F.size(lines)).otherwise(f - 1).cast("int"))
    return bound(end, lambda e: F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i < e) & F.get(lines, i).rlike(PASSED)))


def grouped_tests(lines: Column) -> Column:
    """Two passing lines or more as their number, other lines as they are, blank ones left out."""
    rest = lambda passing: bound(F.get(passing, F.size(passing) - 1), lambda last: F.filter(lines, lambda x, i: not_blank(x) & ((i > last) | ~x.rlike(PASSED))))
    grouped = lambda passing: F.concat(F.array(F.format_string(GROUPED_TEXT, F.size(passing).cast("string"))), rest(passing))
    return bound(passing_lines(lines), lambda passing: F.when(F.size(passing) > 1, grouped(passing)).otherwise(without_blanks(lines)))


def collapsed_runs(lines: Column) -> Column:
    """Each run of equal lines as the line and, from two on, how often it stands there."""
    spans = _spans(_bounds(lines, lambda i: (i == 0) | ~F.get(lines, i).eqNullSafe(F.get(lines, i - 1))))
    return F.flatten(F.transform(spans, lambda s: F.when(s["n"] > 1, F.array(F.get(lines, s["a"]), F.format_string(REPEATED_TEXT, s["n"].cast("string")))).otherwise(F.array(F.get(lines, s["a"])))))


def expanded_lines(lines: Column) -> Column:
    """The inverse of collapsed_runs: a line that tells a number of occurrences repeats the line before it."""
    times = lambda x: F.try_to_number(F.regexp_extract(x, REPEATED, 1), F.lit("999999999")).cast("int")
    again = lambda x, i: F.when((i > 0) & x.rlike(REPEATED), F.array_repeat(F.get(lines, i - 1), F.greatest(times(x) - 1, F.lit(0)))).otherwise(F.array(x))
    return F.flatten(F.transform(lines, again))


def _hit(x: Column) -> Column:
    """line[:column]:text of a search hit."""
    column = F.regexp_extract(x, SEARCH_HIT, 3)
    return F.concat(F.regexp_extract(x, SEARCH_HIT, 2), F.when(column != "", F.concat(F.lit(":"), column)).otherwise(""), F.lit(":"), F.regexp_extract(x, SEARCH_HIT, 4))


def hits_by_path(lines: Column) -> Column:
    """Search hits under their paths, paths in the order in which they come first: two sorts, however many paths there are."""
    hits = F.array_sort(F.transform(F.filter(lines, lambda x: x != ""), lambda x, i: F.struct(F.regexp_extract(x, SEARCH_HIT, 1).alias("path"), i.alias("i"), _hit(x).alias("hit"))))

    def groups(h: Column) -> Column:
        spans = _spans(_bounds(h, lambda i: (i == 0) | (F.get(h, i)["path"] != F.get(h, i - 1)["path"])))
        rows = lambda s: F.concat(F.array(F.get(h, s["a"])["path"]), F.transform(F.slice(h, s["a"] + 1, s["n"]), lambda x: F.concat(F.lit("  "), x["hit"])))
        return F.flatten(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(F.get(h, s["a"])["i"].alias("i"), rows(s).alias("rows")))), lambda g: g["rows"]))

    return bound(hits, groups)


def hits_again(lines: Column) -> Column:
    """The inverse of hits_by_path, in the order of the paths."""
    spans = _spans(_bounds(lines, lambda i: ~F.startswith(F.get(lines, i), F.lit("  ")) | (i == 0)))
    return F.flatten(F.transform(spans, lambda s: F.transform(F.slice(lines, s["a"] + 2, s["n"] - 1), lambda x: F.concat(F.get(lines, s["a"]), F.lit(":"), F.substr(x, F.lit(3))))))


# --- checks


def _no_line_lost(kept: Callable[[Column], Column]) -> Callable[[Text, Column], Column]:
    """Every line of the text for which `kept` holds stands in the result."""
    return lambda t, out: F.size(F.array_except(F.filter(t.lines, kept), lines_of(out))) == 0


def _same_json(t: Text, out: Column) -> Column:
    """Lexically the same value: not one character but blanks outside strings differs."""
    return compact_json(out) == compact_json(t.text)


def _json_or(check: Callable[[Text, Column], Column]) -> Callable[[Text, Column], Column]:
    return lambda t, out: F.when(t.json.isNotNull(), _same_json(t, out)).otherwise(check(t, out))


def _tests_hold(t: Text, out: Column) -> Column:
    """Every line but passing ones before a failure stands in the result, and the number of those that do not is told."""
    told = F.coalesce(F.try_to_number(F.regexp_extract(out, r"\A(\d+) successful", 1), F.lit("999999999")).cast("int"), F.lit(0))
    failure = F.array_position(F.transform(t.lines, lambda x: x.rlike(FAILURE)), True)
    after = bound(failure, lambda f: F.when(f == 0, F.array().cast("array<string>")).otherwise(F.slice(t.lines, f.cast("int"), F.size(t.lines))))
    gone = F.array_except(F.filter(t.lines, not_blank), lines_of(out))  # distinct lines
    may_go = F.forall(gone, lambda x: x.rlike(PASSED)) & (F.size(F.array_intersect(gone, after)) == 0)
    return may_go & bound(F.size(F.filter(t.lines, lambda x: not_blank(x))) - F.size(F.filter(lines_of(out), not_blank)) + F.when(told > 0, 1).otherwise(0), lambda k: (k <= told))


def _json_or_lines(lines: Callable[[Column], Column]) -> Callable[[Text], Column]:
    return lambda t: F.when(t.json.isNotNull(), compact_json(t.text)).otherwise(joined(lines(t.lines)))


def _compacted(t: Text) -> Column:
    return joined(without_blanks(t.lines))


_EVERY_LINE = _no_line_lost(not_blank)
_GROUPED, _TESTS_HOLD = _json_or_lines(grouped_tests), _json_or(_tests_hold)

#: The formats in the order in which they are tried.
FORMATS: list[Format] = [
    Format("vitest", lambda t: (t.json == "tests") | (t.text.rlike(VITEST_RUN) & t.text.rlike(VITEST_LINE)), _GROUPED, _TESTS_HOLD),
    Format("jest", lambda t: (t.json == "tests") | t.text.rlike(JEST_LINE), _GROUPED, _TESTS_HOLD),
    Format("tsc", lambda t: t.text.rlike(TSC_LINE), _compacted, _EVERY_LINE),
    Format("eslint", lambda t: (t.json == "lint") | t.text.rlike(ESLINT_LINE), _json_or_lines(without_blanks), _json_or(_EVERY_LINE)),
    Format(
        "git-diff", lambda t: t.text.rlike(DIFF_HEAD) & t.text.rlike(DIFF_BODY),
        lambda t: F.when(t.artifact.isNull(), t.text).otherwise(joined(F.concat(F.array(F.format_string(DIFF_TEXT, t.artifact)), F.filter(t.lines, lambda x: ~x.rlike(OBJECT_IDS))))),
        _no_line_lost(lambda x: not_blank(x) & ~x.rlike(OBJECT_IDS)),
    ),
    Format("git-status", lambda t: t.text.rlike(STATUS_LINE), _compacted, _EVERY_LINE),
    Format(
        "search", lambda t: F.exists(t.lines, lambda x: x != "") & F.forall(t.lines, lambda x: (x == "") | x.rlike(SEARCH_HIT)),
        lambda t: joined(hits_by_path(t.lines)), lambda t, out: F.array_sort(bound(lines_of(out), hits_again)) == F.array_sort(F.filter(t.lines, lambda x: x != "")),
    ),
    Format("json", lambda t: t.json.isNotNull(), lambda t: compact_json(t.text), _same_json),
    Format("logs", lambda t: F.exists(F.transform(t.lines, lambda x, i: (x != "") & (i > 0) & (x == F.get(t.lines, i - 1))), lambda x: x), lambda t: joined(collapsed_runs(t.lines)), lambda t, out: bound(lines_of(out), expanded_lines) == t.lines),
]


@lru_cache(maxsize=8)
def _expressions(formats: tuple[Format, ...]) -> tuple[Column, Column, Column]:
    """(format that a text shows, its reduced form, whether that holds the text) over the columns _t, _l, _json, _a, _only, _id and _made. Expressions
    belong to no table, so they are put together once; formats that share a step share its expression."""
    t = Text(F.col("_t"), F.col("_l"), F.col("_json"), F.col("_a"))
    chosen, made, holds = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for f in reversed(formats):
        chosen = F.when((F.col("_only").isNull() | (F.col("_only") == f.id)) & F.coalesce(f.shows(t), F.lit(False)), F.lit(f.id)).otherwise(chosen)
    for step in dict.fromkeys(f.reduced for f in formats):
        made = F.when(F.col("_id").isin(*[f.id for f in formats if f.reduced is step]), step(t)).otherwise(made)
    for check in dict.fromkeys(f.holds for f in formats):
        holds = F.when(F.col("_id").isin(*[f.id for f in formats if f.holds is check]), check(t, F.col("_made"))).otherwise(holds)
    return chosen, made, F.coalesce(holds, F.lit(True))


def reduced_outputs(
    df: DataFrame, key: str, text: str, mode: str = "balanced", format: str | None = None, exit_code: str | None = None, artifact: str | None = None,
    consumer: str = "human", marker: str | None = None, formats: Sequence[Format] = FORMATS,
) -> DataFrame:
    """(key, status, reducer_id, reason, applied, sizes, tokens, valid, output) of each text.

    The first of `formats` that a text shows reduces it; a given `format` (a name, or the name of a column) leaves only that one, and only if
    the text shows it. reason is reduced, observe_only (by mode), no_gain, preservation_failed, unknown_format, already_reduced (the text
    begins with `marker`) or machine_consumer_requires_original. Only `reduced` changes the text. `exit_code` and `artifact` name columns;
    without the latter there is no artifact. A null text counts as empty; rows with equal keys stand alone.
    """
    only = F.lit(None).cast("string") if format is None else F.col(format) if format in df.columns else F.lit(format)
    rows = df.select(
        F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_t"), only.alias("_only"),
        (F.col(exit_code).cast("long") if exit_code else F.lit(None).cast("long")).alias("_exit"), (F.col(artifact).cast("string") if artifact else F.lit(None).cast("string")).alias("_a"),
    )
    rows = spread(rows).withColumn("_json", json_kind(F.col("_t"))).withColumn("_l", lines_of(F.col("_t")))
    chosen, made, holds = _expressions(tuple(formats))
    untouched = F.lit(False) if marker is None else F.startswith("_t", F.lit(marker))
    rows = rows.select("*", (F.when(~untouched, chosen) if consumer != "machine" else F.lit(None).cast("string")).alias("_id"))
    rows = rows.select("*", made.alias("_made")).select("*", holds.alias("_valid"))
    size = F.octet_length("_t").cast("long")
    candidate = F.coalesce(F.octet_length("_made").cast("long"), size)
    reason = (
        F.when(untouched, "already_reduced").when(F.lit(consumer == "machine"), "machine_consumer_requires_original").when(F.col("_id").isNull(), "unknown_format")
        .when(~F.col("_valid"), "preservation_failed").when(candidate >= size, "no_gain").when(F.lit(mode == "observe"), "observe_only").otherwise("reduced")
    )
    rows = rows.withColumn("reason", reason).withColumn("output", F.when(F.col("reason") == "reduced", F.col("_made")).otherwise(F.col("_t")))
    after = F.octet_length("output").cast("long")
    return rows.select(
        key, status_of(F.col("_exit")).alias("status"), F.coalesce("_id", F.lit("identity")).alias("reducer_id"), "reason", (F.col("reason") == "reduced").alias("applied"), size.alias("original_bytes"),
        candidate.alias("candidate_bytes"), after.alias("reduced_bytes"), F.ceil(size / 3).alias("original_tokens"), F.ceil(after / 3).alias("reduced_tokens"), F.col("_valid").alias("valid"), "output",
    )


def replay_cases() -> list[tuple[str, str, str, int | None, list[str]]]:
    """(id, format, text, exit code, what must survive) of ten made-up outputs, one for each format and one of none (fixed values)."""
    many = lambda n, f, sep="\n": sep.join(f(i) for i in range(n))
    tests = many(100, lambda i: f" ✓ tests/detailed-success-{i}.test.ts (10 tests) 3ms")
    lint = [{"filePath": "/repo/a.ts", "messages": [{"ruleId": "no-unused-vars", "severity": 2, "line": 4, "column": 2, "message": "unused token"}], "errorCount": 1, "warningCount": 0}]
    response = {"status": "failed", "details": {"expected": 401, "actual": 200, "at": "auth.ts:42"}, "entries": [{"id": i, "valid": False} for i in range(40)]}
    return [
        ("vitest-3-human", "vitest", f" RUN v3.2.4\n{tests}\n FAIL auth.test.ts > rejects reuse\nExpected: 401\nReceived: 200\n ❯ auth.test.ts:42:9\n Test Files 1 failed | 100 passed\n Tests 1 failed | 1000 passed | 2 skipped | 1 cancelled\n", 1, ["rejects reuse", "Expected: 401", "Received: 200", "auth.test.ts:42:9"]),
        ("jest-29-human", "jest", many(60, lambda i: f"PASS tests/success-{i}.test.ts") + "\nFAIL tests/refund.test.ts\n ● rejects negative refund\n Expected: 400\n Received: 200\n at refund.test.ts:18:2\nTest Suites: 1 failed, 60 passed\nTests: 1 failed, 60 passed, 2 skipped\n", 1, ["rejects negative refund", "Expected: 400", "Received: 200"]),
        ("tsc-5-human", "tsc", "\n\nsrc/index.ts(7,9): error TS2322: string is not assignable to number\n\n\n 7 const count: number = name;\n\nFound 1 error.\n\n", 2, ["src/index.ts(7,9)", "TS2322", "const count"]),
        ("eslint-9-json", "eslint", json.dumps(lint, indent=4), 1, ["no-unused-vars", "unused token"]),
        ("git-status-human", "git-status", "On branch main\n\n\nChanges not staged for commit:\n\n\n modified: src/a.ts\n deleted: src/b.ts\n\n", 0, ["modified: src/a.ts", "deleted: src/b.ts"]),
        ("git-diff-patch", "git-diff", many(8, lambda i: f"diff --git a/{i}.ts b/{i}.ts\nindex {'a' * 40}..{'b' * 40} 100644\n--- a/{i}.ts\n+++ b/{i}.ts\n@@ -1,2 +1,2 @@\n context\n-old\n+new\n", ""), 0, ["-old", "+new", " context", "@@ -1,2 +1,2 @@"]),
        ("rg-14-lines", "search", many(50, lambda i: f"packages/really-long-component/src/refresh-token-service.ts:{i + 1}:4:token_{i}"), 0, ["refresh-token-service.ts", "1:4:token_0", "50:4:token_49"]),
        ("json-response", "json", json.dumps(response, indent=4), 1, ['"status":"failed"', "auth.ts:42"]),
        ("exact-logs", "logs", "2026-09-29T12:00:00Z begin\n" + many(100, lambda i: "INFO queue poll for tenant=alpha returned zero pending work items") + "\n2026-09-29T12:00:10Z ERROR request 4 expected 200 actual 503\n", 1, ["100 occurrences", "12:00:00Z", "12:00:10Z", "request 4 expected 200 actual 503"]),
        ("unknown-future-format", "unknown", "Unknown future format\nThis must be passed through exactly.\n", None, ["Unknown future format", "This must be passed through exactly."]),
    ]
