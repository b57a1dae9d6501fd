"""Credentials embedded in source code, configuration and output: where they stand, and the text without them.

Method: a trigram index over chunks. Texts are taken in segments (Arrow batches) and divided into chunks at line ends; for each segment the
positions of the needed trigrams are turned into posting lists of chunks. From each detection pattern a query of required trigrams is
derived, posting lists are intersected and united by that query, and the pattern itself is tried only from places in candidate chunks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, spread
from tesserae.operators.running import running_max, running_sum

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse as sre_parser

MASK = "REDACTED"

# Names under which credentials are kept (fixed values).
_KEY = r"(?:passwo?r?d|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key(?:[_-]?id)?|(?:private|account|signing|encryption|master|storage)[_-]?key|(?:access|auth|refresh|bearer|session|service|deploy|id|personal|api|private|signing|webhook|client)[_-]?token|credentials?|(?:smtp|db|user|admin|root|mail|redis)[_-]?pass(?!age|ing|ive|es))"
_QUOTED = r"""(?:"([^"\r\n]{4,})"|'([^'\r\n]{4,})'|`([^`\r\n]{4,})`|"{3}([^"\r\n]{4,})|'{3}([^'\r\n]{4,}))"""
_ENV = r"(?:(?:process\.env[.\w\[\]'\"]*|os\.(?:environ\.get|getenv)\([^,()\n]*,?|[\w.]+\(['\"]\w+['\"]\)|import\.meta\.env\.\w+|\w+)\s*(?:\?\?|\|\||\bor\b|,)\s*)?"

#: (name, pattern, kind of check of the value). The value is the last group that took part, the whole match if there is none.
DETECTORS = [
    ("vendor", r"(?<![A-Za-z0-9_-])(?:sk-|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|eyJ)[A-Za-z0-9_.-]{3,}(?=['\"`]\s*\+\s*['\"`])", "piece"),
    ("vendor", r"(?<![A-Za-z0-9_-])(?:sk|rk)[-_](?:(?:proj|live|test|ant|svcacct)[-_])?[A-Za-z0-9_-]{10,}", "mixed"),
    ("vendor", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{8,}|github_pat_[A-Za-z0-9_]{8,})", "mixed"),
    ("vendor", r"(?<![A-Za-z0-9])(?:glpat|gldt|glrt)-[A-Za-z0-9_-]{8,}", "mixed"),
    ("vendor", r"(?<![A-Za-z0-9])xox[abeoprs]-[0-9A-Za-z-]{8,}", "mixed"),
    ("vendor", r"(?<![A-Za-z0-9+/])(?:AKIA|ASIA)(?:[A-Z2-7][A-Z0-9]{11,15}(?![A-Za-z0-9+/])|[A-Z0-9]{4,15}(?=['\"`]\s*[+,]))", "vendor"),
    ("vendor", r"(?<![A-Za-z0-9])(?:AIza[0-9A-Za-z_-]{20,}|npm_[A-Za-z0-9]{20,}|pypi-[A-Za-z0-9_-]{20,}|hf_[A-Za-z0-9]{20,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})", "mixed"),
    ("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]*){0,2}", "jwt"),
    ("pem", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nr]|['\"`+,;>#|*/]|(?:Proc-Type|DEK-Info|Comment): [^\r\n]*)*[A-Za-z0-9+/=]{12,})*", "pem"),
    ("keyed", r"(?i)" + _KEY + r"(?:[\w$-]|\[\w*\])*(?:\x1b\[[0-9;]*m)?(?:\\?[\"'`])?\]?\s*(?::\s*(?:string|String|str|any|readonly string\[\]|string\[\])\s*)?(?:=>|:=|==?=?|!==?|:)\s*" + _ENV + r"(?:[\w.$]+\(\s*)?[\[(]?\s*(?:[bru]|r?b)?" + _QUOTED, "value"),
    ("keyed", r"(?i)" + _KEY + r"[\w$.-]*(?:\x1b\[[0-9;]*m)?(?:\\?[\"'`])?\]?\s*(?:=>|:=|=|:)\s*(?:\\\")?([^\s\"'`;,<>]{6,})", "bare"),
    ("header", r"(?i)authorization(?:\\?[\"'`])?\]?\s*[:=,]\s*(?:\\?[\"'`])?(?:(?:bearer|basic|token|apikey)\s+)?([A-Za-z0-9._~+/=-]{8,})", "token"),
    ("header", r"(?i)(?<![\w-])(?:bearer|basic)\s+([A-Za-z0-9._~+/=-]{12,})", "token"),
    ("header", r"(?i)x-(?:api-key|auth-token|access-token|vault-token)(?:\\?[\"'`])?\s*[:=,]\s*(?:\\?[\"'`])?([A-Za-z0-9._~+/=-]{8,})", "token"),
    ("cookie", r"(?i)cookie(?:\\?[\"'`])?\s*[:=,]\s*(?:\\?[\"'`])?(?:[\w.-]+=[^;\s\"'`]*;\s*)*?(?:[\w.-]*(?:sid|sess|token|auth)[\w.-]*)=([^;\s\"'`]{8,})", "token"),
    ("url", r"(?i)[a-z][a-z0-9+.-]{1,20}://[^\s/:@\"'`<>]{0,80}:([^\s/@\"'`<>]{4,})@[\w.\[-]", "url"),
    ("flag", r"(?i)-(?:[\w-]*-)?(?:password|passwd|pass|passphrase|token|secret|api-?key|access-key|private-key|credentials?)(?:=|\s+|['\"]\s*,\s*)(?:(['\"])([^\s'\"]{6,})\1|([^\s'\"`,;)\]]{6,}))", "token"),
    ("user", r"(?:[ \t]-u|--user)[ =]['\"]?[\w.@-]+:([^\s'\"]{6,})", "token"),
    ("prose", r"(?i)(?<![-])(?:" + _KEY + r"|passcode|api key|(?:access|bearer|session|auth|refresh) token)s?(?:[ \t]+(?:is|was|to|of|for \S+|are))?[ \t]*:?[ \t]+(?:[`\"'](\S{6,}?)[`\"']|([^\s`\"',;]{8,}))", "token"),
]

_HOLDS_NONE = re.compile(r"(?i)^(?:\$[\w({].*|%\w+%?|\{\{.*|<.*|\[.*|\*+|x{4,}|\.{3,}|-+|null|none|nil|true|false|undefined|redacted.*|hidden.*|masked.*|removed.*)$|\$\{|\{\{|\$\(|%[A-Z_]{3,}%|redacted|change[-_]?me|your[-_ ]|example|placeholder|dummy|sample[-_]?(?:key|token)|xxxx|\*\*\*|process\.env|os\.environ|getenv|_here$|todo|fixme|insert[-_]|not[-_]set|\[masked")
_REFERENCE = re.compile(r"^[A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)+(?:\(.*)?$|^[A-Za-z_$][\w$]*\(.*$|^(?:\.{0,2}/|~/|[a-z]:\\)|^(?:/[\w.-]+)+$|^[a-z]+(?:[/_-][a-z]+)*$|^[A-Z]+(?:_[A-Z0-9]+)+$|^@|^\w+://[^:@]*$|^min-\d+$|^\d{1,5}$|^--")


_SENTENCE_WORDS = frozenset("the a an of to in is are was be must not and or for with at least from by can should has have this that on it if when empty characters days chars long".split())


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(k / n * log2(k / n) for k in Counter(s).values())


def _classes(s: str) -> int:
    return bool(re.search("[a-z]", s)) + bool(re.search("[A-Z]", s)) + bool(re.search(r"\d", s)) + bool(re.search(r"[^A-Za-z0-9]", s))


def _real(kind: str, v: str) -> bool:
    """Whether the value of a match can be a credential and not a placeholder, a reference, a name or a sentence."""
    if kind == "piece":
        return True
    if kind == "vendor":
        return not re.search(r"EXAMPLE|XXXX", v)
    if kind == "mixed":
        tail = re.split(r"[-_]", v, maxsplit=1)[-1]
        return not re.search(r"(?i)x{5,}|example|\*{3}|your|placeholder|redacted", v) and _entropy(tail) > 2.6 and bool(re.search(r"\d|[a-z][A-Z]|[A-Z][a-z].*[A-Z]", tail))
    if kind == "jwt":
        return len(v) >= 16 and "example" not in v
    if kind == "pem":
        return True
    if _HOLDS_NONE.search(v):
        return False
    if " " in v.strip() and kind != "url":  # a pass phrase, not a sentence
        words = v.split()
        return kind == "value" and len(words) <= 5 and bool(re.search(r"\d", v)) and not _SENTENCE_WORDS.intersection(w.lower() for w in words)
    if kind == "url":
        return v.lower() not in ("password", "passwd", "pass", "secret", "token", "pwd")
    if _REFERENCE.search(v):
        return False
    if kind == "value":
        return len(v) >= 6 and (_classes(v) >= 2 or len(v) >= 16) and _entropy(v) >= 2.2
    if kind == "bare":
        return len(v) >= 8 and _classes(v) >= 2 and bool(re.search(r"\d", v)) and _entropy(v) >= 2.5
    return len(v) >= 8 and bool(re.search(r"\d|[a-z][A-Z]|[A-Z]{2}[a-z]", v)) and _entropy(v) >= 2.5


# --- required trigrams of a pattern -------------------------------------------------------------------------------------------------

ANY = ("any",)


def _grams(s: str) -> tuple:
    return ("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)})))


def _either(parts: list) -> tuple:
    return ANY if any(p == ANY for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _both(parts: list) -> tuple:
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


_MOST = 64


def _exact(op, arg) -> set[str] | None:
    """The few strings that a node of the syntax tree matches, in lower case; None if they are many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for o, a in arg:
            if o is sre.LITERAL:
                out.add(chr(a).lower())
            elif o is sre.RANGE and a[1] - a[0] < 8:
                out |= {chr(c).lower() for c in range(a[0], a[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _exact_seq(arg[-1])
    if op is sre.BRANCH:
        out = set()
        for b in arg[1]:
            s = _exact_seq(b)
            if s is None:
                return None
            out |= s
        return out if len(out) <= _MOST else None
    if op is sre.MAX_REPEAT or op is sre.MIN_REPEAT:
        lo, hi, sub = arg
        s = _exact_seq(sub)
        if s is None or hi > 5 or hi is sre.MAXREPEAT:
            return None
        out, cur = set(), {""}
        for k in range(int(hi) + 1):
            if k >= lo:
                out |= cur
            cur = {a + b for a in cur for b in s}
            if len(cur) > _MOST:
                return None
        return out
    if op in (sre.AT, sre.ASSERT_NOT, sre.ASSERT):
        return {""}
    return None


def _exact_seq(seq) -> set[str] | None:
    out = {""}
    for op, arg in seq:
        s = _exact(op, arg)
        if s is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _tails(seq) -> set[str] | None:
    """The few strings of one or two characters with which every match of a sequence ends; None if they are many."""
    run: set[str] | None = {""}
    for op, arg in seq:
        run = _tails_after(run, op, arg)
    return run if run and all(run) else None


def _tails_after(before: set[str] | None, op, arg) -> set[str] | None:
    """Endings of `before` followed by one node: its own, and those of `before` where it may match nothing."""
    s = _exact(op, arg)
    if s is not None:
        return {(a + b)[-2:] for a in before for b in s} if before is not None and len(before) * len(s) <= _MOST else {b[-2:] for b in s} if all(s) else None
    if op is sre.SUBPATTERN:
        own = _tails(arg[-1])
    elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        own = _tails(arg[2])
        if own is not None and arg[0] == 0:
            own = own | before if before is not None and all(before) else None
    else:
        own = None
    return own if own is not None and len(own) <= 8 else None


def _query_seq(seq) -> tuple:
    parts, run = [], {""}

    def flush() -> None:
        if all(len(s) >= 3 for s in run):
            parts.append(_either([_grams(s) for s in sorted(run)]))

    for op, arg in seq:
        s = _exact(op, arg)
        if s is not None and len(s) * len(run) <= _MOST:
            run = {a + b for a in run for b in s}
            continue
        flush()
        if s is None:
            parts.append(_query(op, arg))
            run = _tails_after({r[-2:] for r in run}, op, arg) or {""}
        else:
            run = s
    flush()
    return _both(parts)


def _query(op, arg) -> tuple:
    if op is sre.SUBPATTERN:
        return _query_seq(arg[-1])
    if op is sre.BRANCH:
        return _either([_query_seq(b) for b in arg[1]])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return _query_seq(arg[2])
    return ANY


def required_trigrams(pattern: str) -> tuple:
    """A query over lower-case trigrams that every text with a match fulfils: ('any',), ('and', grams), ('all' or 'or', queries)."""
    return _query_seq(sre_parser.parse(pattern))


def _leaves(q: tuple) -> set[str]:
    return set() if q == ANY else set(q[1]) if q[0] == "and" else {g for p in q[1] for g in _leaves(p)}


_COMPILED = [(name, re.compile(p), kind, required_trigrams(p)) for name, p, kind in DETECTORS]
_VOCABULARY = sorted({g for *_, q in _COMPILED for g in _leaves(q) if g.isascii()})
_SLOT = np.full(1 << 21, -1, np.int16)  # of three 7-bit characters
for _n, _g in enumerate(_VOCABULARY):
    _SLOT[(ord(_g[0]) << 14) | (ord(_g[1]) << 7) | ord(_g[2])] = _n
_LOWER = bytes(range(256)).lower()


def trigram_postings(texts: list[str]) -> list[np.ndarray]:
    """For each needed trigram the sorted numbers of the texts that hold it."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    joined = np.frombuffer(b"\xff".join(raw).translate(_LOWER), np.uint8)
    if len(joined) < 3:
        return [np.empty(0, np.int64)] * len(_VOCABULARY)
    ascii_ = joined < 128
    ok = ascii_[:-2] & ascii_[1:-1] & ascii_[2:]
    j = (joined & 127).astype(np.int32)
    slots = np.where(ok, _SLOT[(j[:-2] << 14) | (j[1:-1] << 7) | j[2:]], -1)
    at = np.flatnonzero(slots >= 0)
    ends = np.cumsum([len(r) + 1 for r in raw])
    pairs = np.unique(slots[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
    cut = np.searchsorted(pairs, np.arange(len(_VOCABULARY) + 1) * len(texts))
    return [pairs[cut[i] : cut[i + 1]] - i * len(texts) for i in range(len(_VOCABULARY))]


_INDEX = {g: i for i, g in enumerate(_VOCABULARY)}
#: Characters of a chunk at least; it goes on to the end of its line. What a pattern requires lies within a chunk and the one after it, but
#: for FAR patterns, in which any number of parts may stand between: these need their trigrams somewhere in the text.
CHUNK = 2048
FAR = frozenset(["cookie"])


def chunk_bounds(text: str) -> list[int]:
    """Where the chunks of a text begin, and its end."""
    out, at = [0], CHUNK
    while at < len(text):
        at = text.find("\n", at) + 1
        if at <= 0 or at >= len(text):
            break
        out.append(at)
        at += CHUNK
    return [*out, len(text)]


def _candidates(q: tuple, postings: list[np.ndarray], n: int) -> np.ndarray:
    if q == ANY:
        return np.arange(n)
    if q[0] == "and":
        parts = sorted((postings[_INDEX[g]] for g in q[1] if g in _INDEX), key=len)
        out = parts[0] if parts else np.arange(n)
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True)
        return out
    parts = [_candidates(p, postings, n) for p in q[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if q[0] == "all" else np.union1d(out, p)
    return out


_NEXT_PIECE = re.compile(r"""['"`]\s*\+\s*['"`]([^'"`\r\n]{2,})""")


def _value_span(m: re.Match) -> tuple[int, int]:
    for g in range(m.re.groups, 0, -1):
        if m[g] is not None and len(m[g]) > 1:
            return m.span(g)
    return m.span()


def _pem_is_key(text: str, a: int, b: int) -> bool:
    """A header with a body, or one at the end of its text, whose body is in the next."""
    head = text.index("-----", a + 5) + 5
    body = re.sub(r"[^A-Za-z0-9+/=]", "", re.sub(r"\\[nr]", "", text[head:b]))
    return len(body) >= 16 or not text[head:].strip()


def find_secrets(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """For each text the spans (begin, end, detector) of its credentials in order, not overlapping."""
    found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if not texts:
        return found
    bounds = [chunk_bounds(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(b) - 1 for b in bounds])  # text of each chunk
    first = np.concatenate(([0], np.cumsum([len(b) - 1 for b in bounds])))
    postings = trigram_postings([t[a:b] if len(bs) > 2 else t for t, bs in zip(texts, bounds) for a, b in zip(bs, bs[1:])])
    near = []  # chunks which, together with the next of their text, hold a trigram; none crosses a line end
    for p in postings:
        q = p[p > 0] - 1
        q = q[of[q] == of[q + 1]] if len(of) > 1 else q[:0]
        near.append(np.union1d(p, q))
    far = [np.unique(of[p]) for p in postings]
    for name, pattern, kind, q in _COMPILED:
        if name in FAR:
            places = [(i, 0, len(texts[i])) for i in _candidates(q, far, len(texts))]
        else:
            places = [(of[c], bounds[of[c]][c - first[of[c]]], bounds[of[c]][c - first[of[c]] + 1]) for c in _candidates(q, near, len(of))]
        last, at = -1, 0
        for i, begin, end in places:
            text = texts[i]
            at = begin if i != last else max(at, begin)
            last = i
            while at <= end and (m := pattern.search(text, at)) and (m.start() < end or end == len(text)):
                a, b = _value_span(m)
                at = m.end() if m.end() > m.start() else m.end() + 1
                if (_pem_is_key(text, a, b) if kind == "pem" else _real(kind, text[a:b])):
                    found[i].append((a, b, name))
                    while n := _NEXT_PIECE.match(text, b):  # goes on in the next string
                        a, b = n.span(1)
                        found[i].append((a, b, "more"))
    for spans in found:
        if len(spans) > 1:
            spans.sort(key=lambda s: (s[0], -s[1]))
            kept = [spans[0]]
            for s in spans[1:]:
                if s[0] >= kept[-1][1]:
                    kept.append(s)
                elif s[1] > kept[-1][1]:
                    kept[-1] = (kept[-1][0], s[1], kept[-1][2])
            spans[:] = kept
    return found


_LAST_LINE = re.compile(r"(?:\s|\\[nr]|['\"`+,;>#|*])*[A-Za-z0-9+/]{1,11}={0,2}(?=(?:\s|\\[nr]|['\"`+,;>#|*])*(?:-----END |\Z))")


def _hide(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with the values masked; of a key block only the body's runs are masked, so lines, quotes and escapes stay."""
    out, at = [], 0
    for a, b, name in spans:
        out.append(text[at:a])
        if name == "pem":
            head = text.index("-----", a + 5) + 5
            last = _LAST_LINE.match(text, b)  # the last line of a body may be short
            b = last.end() if last else b
            out += [text[a:head], re.sub(r"(\\[nr])|[A-Za-z0-9+/=]{2,}", lambda m: m[1] or MASK, text[head:b])]
        else:
            out.append(MASK)
        at = b
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        texts = b["text"].tolist()
        for key, pos, text, spans in zip(b["row_key"], b["pos"], texts, find_secrets(texts)):
            for a, _, name in spans:
                if name == "more":
                    continue
                rows.append((key, text.count("\n", 0, a) + 1 if pd.isna(pos) else int(pos), name))
        yield pd.DataFrame(rows, columns=["row_key", "pos", "detector"])


def secret_places(texts: DataFrame) -> DataFrame:
    """Distinct (row_key, pos, detector) of credentials in rows (row_key, pos, text): pos is taken over if given, else the 1-based line
    in which the value begins, lines ending at LF. Null and empty texts hold none. Long texts are searched whole."""
    rows = texts.select(F.col("row_key").cast("string").alias("row_key"), F.col("pos").cast("long").alias("pos"), "text").filter("text <> '' and row_key is not null")
    return spread(rows).mapInPandas(_scan, "row_key string, pos long, detector string").distinct()


def _mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].fillna("").tolist()
        spans = find_secrets(texts)
        out = b.assign(credentials=[sum(x[2] != "more" for x in s) for s in spans])
        out["redacted_text"] = [_hide(t, s) if s else t for t, s in zip(b["text"], spans)]
        yield out.drop(columns="text")


def redact_texts(texts: DataFrame) -> DataFrame:
    """Rows (row_key, pos, credentials, redacted_text): each text with its credentials masked and otherwise unchanged; null stays null."""
    rows = texts.select(F.col("row_key").cast("string").alias("row_key"), F.col("pos").cast("long").alias("pos"), "text")
    return spread(rows).mapInPandas(_mask, "row_key string, pos long, credentials long, redacted_text string")


_BEGIN_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_END_KEY = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_BODY_LINE = re.compile(r"(?=.{20}|.*=$|.*\d|.*[a-z][A-Z])[A-Za-z0-9+/]{3,}={0,2}|(?:Proc-Type|DEK-Info|Comment|Version|Hash): .*")
_TOKEN_RUN = re.compile(r"[A-Za-z0-9+/=._~-]{4,}")


def _is_body(text: str) -> bool:
    """Whether a text can stand inside a key block: lines of base64 or of a block's own header, and blank ones."""
    lines = [x.strip() for x in re.split(r"\n|\\n", text)]
    return any(lines) and all(not x or _BODY_LINE.fullmatch(x) for x in lines)


_STATE = "artifact_id string, stream string, seq long, credentials long, redacted_text string, open_key boolean, ends_key boolean, body boolean, open_token boolean, run boolean"


def _mask_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].fillna("").tolist()
        rows = []
        for artifact, stream, seq, text, t, spans in zip(b["artifact_id"], b["stream"], b["seq"], b["text"], texts, find_secrets(texts)):
            begin = None
            for begin in _BEGIN_KEY.finditer(t):
                pass
            rest = t[begin.end() :] if begin else ""
            open_key = begin is not None and not _END_KEY.search(rest) and (not rest.strip() or _is_body(rest))
            end = _END_KEY.search(t)
            ends_key = end is not None and (not t[: end.start()].strip() or _is_body(t[: end.start()]))
            run = _TOKEN_RUN.match(t)
            # a value that ends where the chunk ends may go on in the next one
            open_token = bool(spans) and spans[-1][1] == len(t) and spans[-1][2] != "pem" and _TOKEN_RUN.fullmatch(t[spans[-1][0] : spans[-1][1]]) is not None
            rows.append((artifact, stream, seq, sum(x[2] != "more" for x in spans), _hide(t, spans) if spans else text, open_key, ends_key, _is_body(t), open_token, run is not None and run.end() == len(t)))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in _STATE.split(", ")])


def _mask_inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mask what belongs to a credential that began in a chunk before: a key's body up to its end, or a token's next run."""
    for b in batches:
        out = []
        for text, key in zip(b["redacted_text"], b["in_key"]):
            if key:
                end = _END_KEY.search(text)
                k = end.start() if end else len(text)
                out.append("".join(re.sub(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/=]{3,}", MASK, x) if not re.match(r"\\n|\s*[A-Z][A-Za-z-]+: ", x) else x for x in re.split(r"(\\n|\n)", text[:k])) + text[k:])
            else:
                out.append(_TOKEN_RUN.sub(MASK, text, count=1) if _TOKEN_RUN.match(text) else text)
        yield b.assign(redacted_text=out).drop(columns=["in_key"])


def redact_chunks(chunks: DataFrame, block: int = 4096) -> DataFrame:
    """Rows (artifact_id, stream, seq, redacted_text, credentials) of output chunks, also where a credential goes on in the following chunks of its stream.

    A key block is open from a chunk whose text ends inside it to its END, or to the first chunk that is no body of a key, however many lines
    a chunk has; a token that ends where its chunk ends is followed through chunks that are one run of its characters. Both states come from
    running maxima over the places of chunks in their stream, in two levels, so a stream of any length is spread over tasks. A row stored
    twice comes out once. Null texts stay null; rows without artifact_id or seq stand alone.
    """
    cols = ["artifact_id", "stream", "seq"]
    rows = chunks.select("artifact_id", "stream", F.col("seq").cast("long").alias("seq"), F.col("chunk_text").alias("text"))
    done = cut(spread(rows).mapInPandas(_mask_chunks, _STATE))
    slim = done.filter("artifact_id is not null and seq is not null").groupBy(*cols).agg(*[F.max(x).alias(x) for x in ("open_key", "ends_key", "body", "open_token", "run")])
    # the two streams share one seq: places within a stream
    slim = cut(running_sum(slim, ["artifact_id", "stream"], "seq", [], F.lit(1), "k", block))
    key_on = F.when(F.col("open_key"), F.col("k"))
    key_off = F.when(~F.col("open_key") & (F.col("ends_key") | ~F.col("body")), F.col("k"))
    run_on = F.when(F.col("open_token"), F.col("k"))
    run_off = F.when(~F.col("open_token") & ~F.col("run"), F.col("k"))
    marks = slim.select(*cols[:2], F.lit(None).cast("long").alias("seq"), (F.col("k") + 1).alias("k"), F.lit(0).alias("asks"), key_on.alias("a"), key_off.alias("b"), run_on.alias("c"), run_off.alias("d"), F.lit(None).cast("boolean").alias("fits"))
    null = F.lit(None).cast("long")
    asks = slim.select(*cols, "k", F.lit(1).alias("asks"), null.alias("a"), null.alias("b"), null.alias("c"), null.alias("d"), (F.col("ends_key") | F.col("body")).alias("fits"))
    state = marks.unionByName(asks)
    for x in "abcd":
        state = running_max(state, cols[:2], "k", ["asks"], F.col(x), f"last_{x}", block)
    inside = state.filter("asks = 1").select(
        *cols, (F.col("fits") & F.coalesce(F.col("last_a") > F.coalesce("last_b", F.lit(0)), F.lit(False))).alias("in_key"), F.coalesce(F.col("last_c") > F.coalesce("last_d", F.lit(0)), F.lit(False)).alias("in_token")
    ).filter("in_key or in_token")
    inside = cut(inside.select(F.col("artifact_id").alias("_a"), F.col("stream").alias("_s"), F.col("seq").alias("_q"), "in_key"))
    once = done.dropDuplicates(cols).select(*cols, "redacted_text", "credentials")
    same = (F.col("artifact_id") == F.col("_a")) & F.col("stream").eqNullSafe(F.col("_s")) & (F.col("seq") == F.col("_q"))
    met = once.join(inside, same).select(*cols, "redacted_text", "credentials", "in_key")
    rest = once.join(inside, same, "left_anti")
    return rest.unionByName(met.mapInPandas(_mask_inside, "artifact_id string, stream string, seq long, redacted_text string, credentials long"))
