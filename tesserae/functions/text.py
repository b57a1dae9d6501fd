"""Column functions over text, paths and sizes. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.redaction import redacted

SAFE_INT = 2**53 - 1

# Words that carry no meaning in a task, and file extensions that say nothing about it (fixed values).
STOP_WORDS = ["the", "and", "for", "fix", "with", "from", "this", "that", "should"]
EXTENSION_WORDS = ["ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"]
# Folders and names that are never read (fixed values); the index knows more of them than the runner.
INDEX_FOLDERS = [".git", "node_modules", "vendor", "dist", "build", "coverage", ".next", ".nuxt", ".cache", ".turbo", "__pycache__"]
INDEX_SENSITIVE = r"(?i)^(?:\.env(?:\..*)?|(?:id_rsa|id_ed25519|id_ecdsa|credentials|secrets?)(?:\..*)?|.*\.(?:pem|key|p12|pfx|jks|keystore|sqlite|sqlite3|db)(?:-wal|-shm)?)$"
RUNNER_SENSITIVE = r"(?i)(?:^|[\\/])(?:\.env(?:\..*)?|\.git|\.ssh|node_modules|vendor|dist|build|coverage|id_rsa|id_ed25519)(?:$|[\\/])|\.(?:pem|key|p12|pfx|keystore)$"
TEST_PATH = r"(?i)(?:^|/)(?:__tests__|tests?)(?:/|$)|[.-](?:test|spec)\.[^.]+$"


def size_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text."""
    return F.octet_length(c).cast("long")


def estimated_tokens(c: Column, divisor: int = 3) -> Column:
    """Conservative token estimate: bytes over a divisor, rounded up. Output measures use 3, source fragments 2."""
    return F.ceil(F.octet_length(c) / divisor).cast("long")


def words(c: Column) -> Column:
    """Distinct words in the order of their first place: camel case, digits after letters and underscores divide, lower case, two characters at least, without stop words."""
    apart = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), r"(\p{L})(\p{N})", "$1 $2")
    found = F.regexp_extract_all(F.lower(F.replace(apart, F.lit("_"), F.lit(" "))), F.lit(r"([\p{L}\p{N}]{2,})"), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP_WORDS]))


def task_words(c: Column) -> Column:
    """Words of a task, without bare file extensions."""
    return F.array_except(words(c), F.array(*[F.lit(w) for w in EXTENSION_WORDS]))


def is_test_path(c: Column) -> Column:
    return c.rlike(TEST_PATH)


def language_of(path: Column) -> Column:
    """Language by extension: typescript, tsx, javascript or text."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.when(ext.isin(".ts", ".mts", ".cts"), "typescript").when(ext == ".tsx", "tsx").when(ext.isin(".js", ".jsx", ".mjs", ".cjs"), "javascript").otherwise("text")


def is_indexed_sensitive(path: Column) -> Column:
    """Paths that the index never takes, whatever ignore rules say; any folder or name of the path decides."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.exists(parts, lambda p: F.lower(p).isin(INDEX_FOLDERS) | p.rlike(INDEX_SENSITIVE))


def is_runner_sensitive(path: Column) -> Column:
    """Paths that the runner never reads."""
    return path.rlike(RUNNER_SENSITIVE)


def normalized_path(path: Column) -> Column:
    """A repository-relative path with / only and without a leading ./, or null if it is absolute, empty or climbs."""
    plain = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    bad = path.rlike(r"^[/\\]|^[A-Za-z]:|\x00") | (plain == "") | F.exists(F.split(plain, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(~bad, plain)


def stem_of(path: Column) -> Column:
    """File name without extension and without a test suffix."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]+$", ""), r"\.(?:test|spec)$", "")


def status_of(exit_code: Column) -> Column:
    return F.when(exit_code.isNull(), "unknown").when(exit_code == 0, "success").otherwise("failure")


def wrapper_exit_code(exit_code: Column, timed_out: Column, cancelled: Column, incomplete: Column | None = None, signalled: Column | None = None) -> Column:
    """Exit code a wrapper passes on: 125 if what it wrote is incomplete, 124 after a timeout, 130 after cancellation, 128 after a signal, the
    child's otherwise, 1 if there is none."""
    no = F.lit(False)
    return F.when(F.coalesce(incomplete, no) if incomplete is not None else no, 125).when(timed_out, 124).when(cancelled, 130).when(F.coalesce(signalled, no) if signalled is not None else no, 128).otherwise(F.coalesce(exit_code, F.lit(1)))


def lines_of(c: Column) -> Column:
    return F.split(c, r"\r?\n", -1)


def not_blank(line: Column) -> Column:
    return line.rlike(r"[^\s\x{00a0}\x{feff}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]")


def compact_blank_lines(c: Column) -> Column:
    return F.array_join(F.filter(lines_of(c), not_blank), "\n")


def distinct_evidence(c: Column) -> Column:
    return F.array_distinct(F.filter(lines_of(c), not_blank))


def compact_json(c: Column) -> Column:
    """White space outside strings taken away, all else byte for byte; possessive, as JVM patterns overflow on long alternations."""
    return F.regexp_replace(c, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")


def redact_source(c: Column) -> Column:
    """The standalone redaction of source text: key blocks, known tokens, quoted values of secret names, bearer tokens."""
    c = F.regexp_replace(c, r"-----BEGIN (?:[A-Z ]+ )?PRIVATE KEY-----[\s\S]*?-----END (?:[A-Z ]+ )?PRIVATE KEY-----", "[REDACTED PRIVATE KEY]")
    c = F.regexp_replace(c, r"\b(?:sk-[A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|AKIA[A-Z0-9]{16})\b", "[REDACTED]")
    c = F.regexp_replace(c, r"""(?i)((?:api[_-]?key|secret|password|access[_-]?token|refresh[_-]?token)\s*[=:]\s*["'`])([^"'`\r\n]{8,})(["'`])""", "$1[REDACTED]$3")
    return F.regexp_replace(c, r"(?i)(Bearer\s+)[A-Za-z0-9._~+/-]{12,}", "$1[REDACTED]")


def csv_cell(c: Column) -> Column:
    """A quoted CSV cell without known secrets, and one that no spreadsheet takes for a formula; null is empty."""
    text = F.coalesce(redacted(c.cast("string")), F.lit(""))
    safe = F.when(text.rlike(r"^\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def usable_count(c: Column) -> Column:
    """Whether a count is known, not negative and exact in double precision."""
    return F.coalesce((c >= 0) & (c <= SAFE_INT), F.lit(False))


def sum_known(*cols: Column) -> Column:
    """Sum of a row's counts; null as soon as one is unknown."""
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return F.when(total <= SAFE_INT, total)


def derived_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix_ and the first digits of the SHA-256 of the parts joined by |; nulls count as empty."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(joined, 256), 1, length))


def command_key(executable: Column, args: Column, cwd: Column) -> Column:
    """Identity of a command by executable, arguments and folder alone."""
    return F.sha2(F.to_json(F.struct(executable.alias("executable"), args.alias("args"), cwd.alias("cwd"))), 256)


def error_signature(status: Column, exit_code: Column, timed_out: Column, cancelled: Column, lines: Column) -> Column:
    """Identity of a failure by its outcome and its distinct non-blank lines; null for a success."""
    return F.when(F.coalesce(exit_code == 0, F.lit(False)), F.lit(None)).otherwise(F.sha2(F.to_json(F.struct(status.alias("s"), exit_code.alias("e"), timed_out.alias("t"), cancelled.alias("c"), distinct_evidence(lines).alias("l")), {"ignoreNullFields": "false"}), 256))


def text_value(c: Column) -> Column:
    """A non-empty text cut to 300 UTF-16 units, then redacted; null for an empty one. A character that the cut would halve is left out."""
    units = F.transform(F.split(F.left(c, F.lit(300)), ""), lambda x: F.when(F.octet_length(x) > 3, 2).otherwise(1))
    over = F.aggregate(units, F.lit(0), lambda a, u: a + u) - 300
    astral = lambda k: F.aggregate(F.slice(F.reverse(units), 1, k), F.lit(0), lambda a, u: a + u)
    drop = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(over, F.lit(1))), lambda k: astral(k) >= over)), F.lit(0))
    text = F.left(c, F.lit(300))
    return F.when(F.coalesce(c, F.lit("")) != "", redacted(F.when(over <= 0, text).otherwise(F.left(text, F.length(text) - drop))))


def stamped(client: Column, observed: Column) -> Column:
    """struct(at, source): the client's own time if it can be read, else that of the observation."""
    own = F.try_to_timestamp(client)
    return F.struct(F.coalesce(own, observed).alias("at"), F.when(own.isNotNull(), "client").otherwise("observed").alias("source"))


def within(root: Column, path: Column) -> Column:
    """Whether a path, both in plain form, is the root or lies below it."""
    base = F.regexp_replace(root, r"/+$", "")
    return (path == base) | F.startswith(path, F.concat(base, F.lit("/")))


def formatted_bytes(n: Column) -> Column:
    """Bytes, KiB or MiB with one decimal."""
    one = lambda x: F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, F.concat(one(n / 1024), F.lit(" KiB"))).otherwise(F.concat(one(n / 1048576), F.lit(" MiB")))


def formatted_share(part: Column, whole: Column) -> Column:
    """A share in percent with one decimal; null where the whole is 0."""
    return F.when(whole > 0, F.concat(F.format_string("%.1f", F.floor(part / whole * 1000 + 0.5) / 10), F.lit("%")))


def files_digest(files, keys: list[str], path: Column, content: Column):
    """(keys, digest): one digest of the files of each group over their sorted paths and contents, kept apart by characters that stand in neither."""
    line = F.concat(path, F.lit("\x01"), content)
    return files.select(*keys, F.struct(path.alias("p"), line.alias("l")).alias("_x")).groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["l"]), "\x02"), 256).alias("digest"))


def in_event_session(payload: Column, session: Column) -> Column:
    """Whether an event's payload names a session under either of its keys."""
    return F.coalesce(F.get_json_object(payload, "$.sessionId") == session, F.lit(False)) | F.coalesce(F.get_json_object(payload, "$.session_id") == session, F.lit(False))


def lifecycle_step(event: Column) -> Column:
    """What a lifecycle event does to its session: open, checkpoint, close; null for all others."""
    return F.when(event == "SessionStart", "open").when(event.isin("PreCompact", "PostCompact"), "checkpoint").when(event == "SessionEnd", "close")
