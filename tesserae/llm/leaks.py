"""Evaluation texts that leak into training text.

Method: spaced-seed hashing. Fixed masks select some of the words in a short window and ignore the others; a window of a document and
one of a test item that agree in the selected words have the same hash. Hash hits give candidate alignments (document, item, diagonal),
and only around these the words are compared one by one, with substitutions tolerated.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import cut, spread
from tesserae.operators.lookup import HOT_ROWS, salted_join

#: Masks over consecutive words; 1 is compared, 0 ignored. Fifteen equal words hit each of them. Where 5 of 40 words are replaced, six
#: in a row are equal somewhere, which the first mask finds for certain; the others find most of what has more replaced.
MASKS = ("111111", "11101011", "110110011", "1100101011")
RUN_WORDS, SPAN_WORDS, REPLACED = 15, 40, 1 / 8
#: Above so many bytes of index the seeds are joined by a shuffle and not sent to every worker. A byte of item text makes at most half a
#: word, and a word one number, and a hash, an item and a place for each mask, twice at most while they are sorted: 112 bytes.
INDEX_BYTES, INDEX_BYTES_A_BYTE = 128 << 20, 112
#: Bits of the filter before the join of seeds at most (16 MiB).
FILTER_BITS = 1 << 27

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u206a-\u206f\ufe00-\ufe0f\ufeff]")
_TAG = re.compile(r"<[a-zA-Z/!][^<>\n]{0,300}>")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbf\"'/\\*_`#>~\[\](){}.!|+-])")
_LEAD = re.compile(r"^[\W_]*(?:(?:\[?\d{1,2}:\d\d(?::\d\d)?(?:[.,]\d+)?\]?|\[?\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d\S*)?\]?|\d+\s?[|:]|(?:INFO|WARN|ERROR|DEBUG)\b:?)(?:\s[\W_]*|$))+")
_WORD = re.compile(r"[^\W_]+")
_DIGIT, _LETTER = re.compile(r"\d"), re.compile(r"^[^\W\d_]+[.,;:!?]?$")


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2]
    return chr(int(code, 16)) if code else " "


def _bare(lines: list[str]) -> list[str]:
    """Lines of one block without what stands before each of them."""
    if len(lines) >= 3:
        for _ in range(4):
            head = lines[0].split(None, 1)[0]
            if _LETTER.match(head) or head.isdigit():
                break
            first = [x.split(None, 1) for x in lines]
            if not all(len(x) == 2 for x in first):
                break
            shape = _DIGIT.sub("9", head)
            if any(_DIGIT.sub("9", x[0]) != shape for x in first):
                break
            lines = [x[1] for x in first]
    return [x if x[0].isalpha() and x[0] not in "IWED" else _LEAD.sub("", x) for x in lines]


def leak_words(text: str | None) -> list[str]:
    """The words of a text without case, punctuation, markup, escapes, invisible characters, layout and line prefixes; [] for null."""
    if not text:
        return []
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
    if "\\" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    out: list[str] = []
    block: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            block.append(line)
        elif block:
            out += _WORD.findall(" ".join(_bare(block)).lower())
            block = []
    return out


def own_text(item_text: str | None) -> str:
    """An item without its suite's instruction, the first paragraph; an item of one paragraph is all its own."""
    parts = re.split(r"\n[ \t\r]*\n", (item_text or "").strip(), maxsplit=1)
    return parts[-1]


class _Words(dict):
    """64-bit number of a word, kept for the words met last."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_known = _Words()


def _ids(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


_OFFSETS = [np.flatnonzero([c == "1" for c in m]) for m in MASKS]
_ODD = np.uint64(0x9E3779B97F4A7C15)


def seeds(ids: np.ndarray, mask: int) -> np.ndarray:
    """Hash of each window of a mask."""
    n = len(ids) - len(MASKS[mask]) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n, mask + 1, np.uint64)
        for o in _OFFSETS[mask]:
            h ^= ids[o : o + n]
            h *= _ODD
            h ^= h >> np.uint64(29)
    return h


def overlaps(a: np.ndarray, b: np.ndarray, diagonal: int) -> bool:
    """Whether a[diagonal + k] and b[k] hold a leak: RUN_WORDS equal in a row, or a span that has SPAN_WORDS words equal in order of
    which at most about REPLACED are other words."""
    lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
    if hi - lo < RUN_WORDS:
        return False
    same = a[lo + diagonal : hi + diagonal] == b[lo:hi]
    at = np.flatnonzero(same)
    if len(at) < RUN_WORDS:
        return False
    if np.any(at[RUN_WORDS - 1 :] - at[: len(at) - RUN_WORDS + 1] == RUN_WORDS - 1):
        return True
    # spans between two equal words: length L = at[j] - at[i] + 1, equal j - i + 1
    for k in range(len(at), 0, -1):
        if k < SPAN_WORDS * (1 - REPLACED):
            return False
        span = at[k - 1 :] - at[: len(at) - k + 1] + 1
        if np.any((span >= SPAN_WORDS) & ((span - k) <= REPLACED * span)):
            return True
    return False


class Batch:
    """The words of several texts in one row, so that windows of all of them are hashed together."""

    def __init__(self, words: list[list[str]]):
        self.ids = _ids([w for ws in words for w in ws])
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.ends = np.cumsum(self.sizes)
        self.begins = self.ends - self.sizes
        self.rest = np.repeat(self.ends, self.sizes) - np.arange(len(self.ids))  # words of its text from each place on

    def windows(self, passing: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each mask (hashes, places) of the windows that lie within one text, and, with a filter, that it lets pass."""
        for m, mask in enumerate(MASKS):
            h = seeds(self.ids, m)
            ok = self.rest[: len(h)] >= len(mask)
            if passing is not None:
                ok &= _passes(passing, h)
            at = np.flatnonzero(ok)
            yield h[at], at

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, side="right")

    def words_of(self, n: int) -> np.ndarray:
        return self.ids[self.begins[n] : self.ends[n]]


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a filter of 2^k bits has the bit that the last k bits of each hash name; true for every hash that it was made of."""
    slot = h & np.uint64(64 * len(bits) - 1)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _filter_bits(seeds_at_most: int) -> int:
    """Bits of a filter: 32 for each seed, a power of two, at most FILTER_BITS."""
    return min(FILTER_BITS, 1 << max(6, (32 * seeds_at_most - 1).bit_length()))


class Items:
    """Seeds and words of the test items, sorted for binary search behind a filter."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        batch = Batch([leak_words(own_text(t)) for _, t in rows])
        self.words = [batch.words_of(n) for n in range(len(rows))]
        self.flat, self.begins, self.sizes = batch.ids, batch.begins, batch.sizes
        found = list(batch.windows())
        hashes, at = np.concatenate([h for h, _ in found]), np.concatenate([a for _, a in found])
        order = np.argsort(hashes, kind="stable")
        self.hashes, at = hashes[order], at[order]
        self.item = batch.text_of(at)
        self.pos = at - batch.begins[self.item] if len(at) else at
        self.bits = np.zeros(_filter_bits(len(hashes)) // 64, np.uint64)
        slot = self.hashes & np.uint64(64 * len(self.bits) - 1)
        np.bitwise_or.at(self.bits, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))

    def _equal_words(self, batch: Batch, t: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each alignment (the number of places at which both texts have the same word, the most of them in a row)."""
        lo, hi = np.maximum(0, -d), np.minimum(self.sizes[n], batch.sizes[t] - d)
        size = hi - lo
        equal, run = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        for a in range(0, len(t), 10_000):
            k = size[a : a + 10_000]
            ends = np.cumsum(k)
            every = np.arange(k.sum())
            inside = every - np.repeat(ends - k, k)
            x = np.repeat((batch.begins[t] + d + lo)[a : a + 10_000], k) + inside
            y = np.repeat((self.begins[n] + lo)[a : a + 10_000], k) + inside
            same = batch.ids[x] == self.flat[y]
            upto = np.concatenate(([0], np.cumsum(same)))
            equal[a : a + 10_000] = upto[ends] - upto[ends - k]
            broken = np.maximum.accumulate(np.where(same, -1, every))  # the last place at which they differ
            run[a : a + 10_000] = np.maximum.reduceat(np.where(same, np.minimum(every - broken, inside + 1), 0), ends - k)
        return equal, run

    def leaks(self, words: list[list[str]]) -> list[tuple[int, int]]:
        """(number of the text, item id) of each item that leaked into one of several texts."""
        if not len(self.hashes):
            return []
        batch = Batch(words)
        texts, items, diagonals = [], [], []
        for h, at in batch.windows(self.bits):
            left, right = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
            k = right - left
            hit = np.repeat(left, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            at = np.repeat(at, k)
            t = batch.text_of(at)
            texts.append(t)
            items.append(self.item[hit])
            diagonals.append(at - batch.begins[t] - self.pos[hit] if len(t) else at)
        t, n, d = (np.concatenate(x) for x in (texts, items, diagonals))
        order = np.lexsort((d, n, t))
        t, n, d = t[order], n[order], d[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1]) | (d[1:] != d[:-1])
        t, n, d = t[new], n[new], d[new]
        equal, run = self._equal_words(batch, t, n, d)
        sure = run >= RUN_WORDS
        found = set(zip(t[sure].tolist(), n[sure].tolist()))
        likely = ~sure & (equal >= SPAN_WORDS * (1 - REPLACED))
        for t, n, d in zip(t[likely].tolist(), n[likely].tolist(), d[likely].tolist()):
            if (t, n) not in found and overlaps(batch.words_of(t), self.words[n], d):
                found.add((t, n))
        return [(t, int(self.ids[n])) for t, n in found]


def _in_batches(keys: pd.Series, texts: pd.Series, prepare) -> Iterator[tuple[list, list[list[str]]]]:
    """(keys, words of their texts) for some hundred thousand words at a time."""
    names: list = []
    words: list[list[str]] = []
    size = 0
    for key, text in zip(keys, texts):
        w = leak_words(prepare(text))
        if len(w) < RUN_WORDS:
            continue
        names.append(key)
        words.append(w)
        size += len(w)
        if size > 200_000:
            yield names, words
            names, words, size = [], [], 0
    if names:
        yield names, words


def leaked_items(docs: DataFrame, items: DataFrame, index_bytes: int = INDEX_BYTES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct (doc_id, item_id): documents that hold a passage of an item's own text.

    If the index of the items' seeds cannot exceed `index_bytes`, which is checked before anything is fetched, every worker gets it; then
    the corpus is read once and never shuffled by content. Beyond that the seeds of both sides are joined by a shuffle behind a filter of
    fixed size, hot seeds salted. Both ways take the same words, seeds and comparison, so they give the same rows.
    Null or empty texts, and texts of fewer than 15 words, hold nothing and leak nowhere. Rows with the same doc_id count as one
    document each and give a pair once. Empty tables give an empty result; other columns are ignored.
    """
    items = items.select("item_id", "item_text").filter("item_id is not null and item_text is not null")
    docs = docs.select("doc_id", "text").filter("text is not null")
    size = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if size * INDEX_BYTES_A_BYTE <= index_bytes:
        index = docs.sparkSession.sparkContext.broadcast(Items([tuple(r) for r in items.collect()]))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            it = index.value
            for b in batches:
                rows = [(names[t], i) for names, words in _in_batches(b["doc_id"], b["text"], str) for t, i in it.leaks(words)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id"])

        return spread(docs).mapInPandas(scan, "doc_id long, item_id long").distinct()
    return _joined(docs, items, hot_rows)


def _joined(docs: DataFrame, items: DataFrame, hot_rows: int) -> DataFrame:
    """The same by a join of seeds. Of both sides only the word numbers of texts that may meet are kept, never the texts."""

    def numbered(prepare, bits=None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for names, words in _in_batches(b.iloc[:, 0], b.iloc[:, 1], prepare):
                    batch = Batch(words)
                    parts = list(batch.windows(None if bits is None else bits.value))
                    h, at = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
                    order = np.argsort(at, kind="stable")
                    h, at = h[order].view(np.int64), at[order]
                    t = batch.text_of(at)
                    cut_at = np.searchsorted(t, np.arange(len(names) + 1))
                    rows = [
                        (names[n], batch.words_of(n).view(np.int64), h[i:j], at[i:j] - batch.begins[n])
                        for n, (i, j) in enumerate(zip(cut_at, cut_at[1:])) if j > i
                    ]
                    yield pd.DataFrame(rows, columns=["key", "words", "h", "pos"])

        return run

    schema = "key long, words array<long>, h array<long>, pos array<long>"
    # a text may stand under several rows of one id, so texts get keys of their own, 128 bits of their words
    number = F.concat(F.hex(F.xxhash64("words")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "words")))
    ours = cut(spread(items).mapInPandas(numbered(own_text), schema).withColumn("item", number))
    total = ours.agg(F.sum(F.size("h"))).first()[0] or 0
    bits = _filter_bits(total)
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    marks = ours.select(F.explode("h").alias("h")).select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most FILTER_BITS / 64 rows
    words = np.zeros(bits // 64, np.uint64)
    words[marks["w"].to_numpy(np.int64)] = marks["b"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    theirs = cut(spread(docs).mapInPandas(numbered(str, shared), schema).withColumn("doc", number))
    a = theirs.select("doc", F.explode(F.arrays_zip("h", "pos")).alias("s")).select("doc", F.col("s.h").alias("h"), F.col("s.pos").alias("at")).distinct()
    b = ours.select("item", F.explode(F.arrays_zip("h", "pos")).alias("s")).select("item", F.col("s.h").alias("h"), F.col("s.pos").alias("pos")).distinct()
    hits = cut(salted_join(a, b, "h", "doc", hot_rows).select("doc", "item", (F.col("at") - F.col("pos")).alias("d")).distinct())
    doc_words = theirs.select("doc", F.col("words").alias("dw")).dropDuplicates(["doc"])
    item_words = ours.select("item", F.col("words").alias("iw")).dropDuplicates(["item"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(d, i) for d, i, k, p, q in zip(x["doc"], x["item"], x["d"], x["dw"], x["iw"]) if overlaps(np.asarray(p), np.asarray(q), int(k))]
            yield pd.DataFrame(rows, columns=["doc", "item"])

    met = salted_join(salted_join(hits, item_words, "item", "doc", hot_rows), doc_words, "doc", "item", hot_rows)
    pairs = cut(met.select("doc", "item", "d", "dw", "iw").mapInPandas(verify, "doc string, item string").distinct())
    with_items = salted_join(pairs, ours.select("item", F.col("key").alias("item_id")).distinct(), "item", "doc", hot_rows)
    return salted_join(with_items, theirs.select("doc", F.col("key").alias("doc_id")).distinct(), "doc", "item_id", hot_rows).select("doc_id", "item_id").distinct()
