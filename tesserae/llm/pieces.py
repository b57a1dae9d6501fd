"""Splitting oversized items at natural boundaries, with overlap.

Method: structure-tree packing. The lines of an item are parsed into a tree by headings, blank lines, indentation, list markers, markup and
the beginnings of declarations. From the leaves up, the subtrees of siblings are merged to the limit; a node that fits is one block, and
only a node that is larger by itself is divided into the blocks of its children. Lines that exceed the limit alone are cut after sentences,
separators, blanks, and in the last resort between characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import spread

_HEADING = re.compile(r"(#{1,6})\s+\S")
_CLOSER = re.compile(r"(?:[)\]}]+[;,)]*|end\b|else\b|elif\b|except\b|finally\b|catch\b|\} (?:else|catch|finally)\b.*|</[\w:.-]+>.*|\"\"\"|'''|```|-->|\*/)\s*$|(?:else|elif|except|finally|catch)\b")
_COMMENT = re.compile(r"(?://|#|/\*|\*|--|@\w|<!--)")
_ITEM = re.compile(r"(?:[-*•+]|\d{1,4}[.)])\s")
_DECLARES = re.compile(r"(?:export|import|function|class|interface|type|enum|const|let|var|async|def|public|private|protected|static|\[[\w.-]+\]$|[\w-]+:\s*$)")
_WITHIN = [re.compile(r"(?<=[.!?])\s+(?=\S)"), re.compile(r"(?<=[;}])(?=\S)|(?<=[;,}])\s+(?=\S)"), re.compile(r"(?<=,)(?=\S)"), re.compile(r"(?<=\s)(?=\S)")]


#: Levels of lines that never begin a node of their own, above every indentation: closing lines, comments' continuations, blank lines, parts of a line.
_CLOSES, _CONTINUES, _EMPTY, _PART = (10**9 + k for k in range(4))


def _levels(lines: list[str], marked: bool) -> list[int]:
    """Level of the node that each line begins; one with a smaller level holds those after it with greater ones."""
    out = []
    blank, comment = True, False
    fence = False
    for s in lines:
        body = s.strip()
        indent = (len(s) - len(s.lstrip(" \t"))) if body else 0
        indent += 3 * s[:indent].count("\t")
        m = _HEADING.match(body) if marked and not fence and indent < 4 else None
        if not body:
            level = _EMPTY  # a blank line stays with what is before it
        elif m:
            level = len(m[1])
        elif _CLOSER.match(body):
            level = _CLOSES
        elif comment and not blank:
            level = _CONTINUES  # a comment or decorator stays with what follows
        else:
            level = 10 + 4 * indent + (0 if blank else 1 if _DECLARES.match(body) else 2 if _ITEM.match(body) else 3)
        out.append(level)
        if marked and body.startswith("```"):
            fence = not fence
        comment = bool(body) and bool(_COMMENT.match(body)) and not body.endswith("*/") or body.startswith("@") or (comment and body.startswith("*"))
        blank = not body
    return out


def _children(levels: list[int]) -> list[list[int]]:
    """The tree over units: children of each unit, and of the root in the last place."""
    out: list[list[int]] = [[] for _ in range(len(levels) + 1)]
    path = [len(levels)]
    for i, level in enumerate(levels):
        while len(path) > 1 and levels[path[-1]] >= level:
            path.pop()
        out[path[-1]].append(i)
        path.append(i)
    return out


def _blocks(levels: list[int], upto: list[int], room: int) -> list[int]:
    """Where blocks begin: from the leaves up, siblings merged as far as they fit; what does not fit hands its parts to its parent."""
    n = len(levels)
    children = _children(levels)
    end = [n] * (n + 1)
    blocks: list[list[int]] = [[] for _ in range(n + 1)]
    for c in children:
        for x, y in zip(c, c[1:]):
            end[x] = y
    for i, c in enumerate(children[:-1]):  # parents stand before their children
        if c:
            end[c[-1]] = end[i]
    for i in [*range(n - 1, -1, -1), n]:
        begin, stop = (0, n) if i == n else (i, end[i])
        if i < n and upto[stop] - upto[begin] <= room:
            blocks[i] = [i]
            continue
        parts = [] if i == n else [i]
        for c in children[i]:
            parts += blocks[c]
            blocks[c] = []
        merged: list[int] = []
        for at, to in zip(parts, [*parts[1:], stop]):
            if not merged or upto[to] - upto[merged[-1]] > room:
                merged.append(at)
        blocks[i] = merged
    return blocks[n]


def _cut_line(text: str, room: int) -> list[str]:
    """A line of more than `room` bytes in parts that have at most so many, cut at the best places there are."""
    parts = [text]
    for pattern in _WITHIN:
        fine: list[str] = []
        for p in parts:
            if len(p.encode()) <= room:
                fine.append(p)
                continue
            at = 0
            for m in pattern.finditer(p):
                fine.append(p[at : m.end()])
                at = m.end()
            fine.append(p[at:])
        merged: list[str] = []
        size = 0
        for p in fine:  # merge what is finer than needed
            n = len(p.encode())
            if merged and size + n <= room:
                merged[-1] += p
                size += n
            else:
                merged.append(p)
                size = n
        parts = merged
    out: list[str] = []
    for p in parts:
        raw = p.encode()
        while len(raw) > room:
            k = room
            while k > 0 and raw[k] & 0xC0 == 0x80:
                k -= 1
            if not k:  # a character that is larger than the limit stays whole
                k = room + 1
                while k < len(raw) and raw[k] & 0xC0 == 0x80:
                    k += 1
            out.append(raw[:k].decode())
            raw = raw[k:]
        out.append(raw.decode())
    return [p for p in out if p]


def split_item(text: str, max_bytes: int, overlap_lines: int, marked: bool = False, first_line: int = 1) -> list[tuple[int, int, int, int, str]]:
    """Pieces (start_line, end_line, overlap, overlap_bytes, text) of an item, each of at most max_bytes UTF-8 bytes.

    A piece begins with the last `overlap_lines` whole lines of the piece before it, or as many of them as leave room for something
    new; `overlap` tells how many. The pieces without their overlap are the item. An item within the limit is one piece; a character
    that is larger than the limit stays whole and is the only thing to exceed it.
    """
    if len(text.encode()) <= max_bytes:
        return [(first_line, first_line + text.count("\n") - (text.endswith("\n") and len(text) > 1), 0, 0, text)]
    lines = text.splitlines(keepends=True) if "\r" not in text and not re.search("[\x0b\x0c\x1c-\x1e\x85  ]", text) else re.findall(r"[^\n]*\n|[^\n]+", text)
    levels = _levels(lines, marked)
    unit: list[str] = []
    line: list[int] = []
    level: list[int] = []
    for i, (s, lv) in enumerate(zip(lines, levels)):
        if len(s.encode()) <= max_bytes:
            unit.append(s)
            line.append(i)
            level.append(lv)
            continue
        for k, part in enumerate(_cut_line(s, max_bytes)):
            unit.append(part)
            line.append(i)
            level.append(_PART if k else lv)
    size = [len(u.encode()) for u in unit]
    upto = [0]
    for n in size:
        upto.append(upto[-1] + n)
    whole = [(i == 0 or line[i - 1] != line[i]) and (i + 1 == len(unit) or line[i + 1] != line[i]) for i in range(len(unit))]
    lead = sum(sorted(size, reverse=True)[:overlap_lines])  # room that an overlap may take
    room = max_bytes - min(lead, max_bytes // 3)

    def overlap_of(i: int, need: int) -> tuple[int, int]:
        """(number, bytes) of the lines before unit i that are repeated if `need` bytes follow."""
        k = got = 0
        while k < overlap_lines and i - k - 1 >= 0 and whole[i - k - 1] and got + size[i - k - 1] + need <= max_bytes:
            got += size[i - k - 1]
            k += 1
        return k, got

    # a piece may take more blocks than the merge foresaw where its overlap is short
    starts = _blocks(level, upto, room)
    cuts: list[int] = []
    begin, limit = 0, max_bytes
    for at, to in zip(starts, [*starts[1:], len(unit)]):
        if upto[to] - upto[begin] > limit and at > begin:
            cuts.append(at)
            begin, limit = at, max_bytes - overlap_of(at, upto[to] - upto[at])[1]
    out: list[tuple[int, int, int, int, str]] = []
    for a, b in zip([0, *cuts], [*cuts, len(unit)]):
        k, got = overlap_of(a, upto[b] - upto[a]) if a else (0, 0)
        out.append((first_line + line[a - k], first_line + line[b - 1], k, got, "".join(unit[a - k : b])))
    return out


_SCHEMA = "item_kind string, item_id long, piece int, start_line long, end_line long, overlap int, overlap_bytes int, bytes int, piece_text string"


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    for b in batches:
        rows = []
        for kind, item, text, first, marked, most, over in zip(b["item_kind"], b["item_id"], b["item_text"], b["first_line"], b["marked"], b["max_bytes"], b["overlap_lines"]):
            for n, (s, e, k, kb, t) in enumerate(split_item(text, int(most), int(over), bool(marked), int(first)), 1):
                rows.append((kind, item, n, s, e, k, kb, len(t.encode()), t))
        yield pd.DataFrame(rows, columns=names)


def oversized_items(files: DataFrame, symbols: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows (item_kind, item_id, item_text, first_line, marked, max_bytes, overlap_lines) of files and symbols beyond their kind's limit.

    A symbol without a body is the file's lines start_line to end_line, without the last line's end; if its file or lines are missing
    it has no text and is left out. Only a file larger than the limit can hold such a body, so no other file's content is moved.
    Items without a limit, null texts and null ids are left out; other columns are ignored.
    """
    most = {r["item_kind"]: r for r in limits.filter("item_kind in ('file', 'symbol') and max_bytes > 0").select("item_kind", "max_bytes", F.coalesce("overlap_lines", F.lit(0)).alias("overlap_lines")).collect()}
    empty = files.sparkSession.createDataFrame([], "item_kind string, item_id long, item_text string, first_line long, marked boolean, max_bytes int, overlap_lines int")
    parts = [empty]

    def limited(df: DataFrame, kind: str) -> DataFrame:
        r = most[kind]
        return df.filter(F.octet_length("item_text") > r["max_bytes"]).withColumns({"item_kind": F.lit(kind), "max_bytes": F.lit(int(r["max_bytes"])), "overlap_lines": F.lit(max(0, int(r["overlap_lines"])))}).select(empty.columns)

    marked = F.lower("file_path").rlike(r"\.(md|mdx|txt|rst)$")
    if "file" in most:
        parts.append(limited(files.filter("file_id is not null").select(F.col("file_id").alias("item_id"), F.col("file_content").alias("item_text"), F.lit(1).cast("long").alias("first_line"), F.coalesce(marked, F.lit(False)).alias("marked")), "file"))
    if "symbol" in most:
        own = symbols.filter("symbol_id is not null").select(F.col("symbol_id").alias("item_id"), "body", "file_id", "start_line", "end_line")
        line = F.coalesce(F.col("start_line").cast("long"), F.lit(1).cast("long")).alias("first_line")
        with_body = own.filter("body is not null").select("item_id", F.col("body").alias("item_text"), line, F.lit(False).alias("marked"))
        content = files.select(F.col("file_id"), F.col("file_content")).filter(F.octet_length("file_content") > most["symbol"]["max_bytes"])
        rest = own.filter("body is null and start_line >= 1 and end_line >= start_line").join(content, "file_id")
        body = F.regexp_replace(F.array_join(F.slice(F.split("file_content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"), r"\r$", "")
        parts.append(limited(with_body.unionByName(rest.select("item_id", body.alias("item_text"), line, F.lit(False).alias("marked"))), "symbol"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_items(files: DataFrame, symbols: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces of all oversized items: item_kind, item_id, piece (from 1), start_line, end_line (1-based, in the file), overlap (lines repeated
    from the piece before), overlap_bytes, bytes, piece_text."""
    return spread(oversized_items(files, symbols, limits)).mapInPandas(_split, _SCHEMA)
