"""Per-document text quality statistics, and whether a document is natural prose.

Statistics of the whole document (words, symbols, sentence ends, common words, repeated lines and paragraphs, dominant n-gram) come first,
by built-in functions but for the n-gram. The verdict is about shares of a document's characters, so the same figures are then taken for each
passage, a paragraph or, in a paragraph of mixed lines, a run of lines of one make-up. Combined rules over these figures tell prose from
lists, tables, machine output and junk; repetition over the whole document turns sentences that come back again and again into filler.
No rule needs a known language: common words of four languages only add to what the figures say.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.runtime import spread
from tesserae.functions.tokens import ship, vocabulary_ranks

# Common words of four languages (fixed values).
COMMON = {
    "en": "the a an of to in and is was are were be been it its that this for on with by as at from or not no but if than then so because before after when while which who what where how has had have will would can could may all every each any more most only one two did do does our we they you he she i there them their out into up about over nobody nothing most same such",
    "de": "der die das und ist nicht ein eine einen einem einer wir ich sie es den dem des zu im in mit für auf von an bei dass wird wurde war weil wenn als aber oder auch nach vor so ohne alle vom zum zur hat haben jeden jede jedem diese dieser noch nur kein keine keinen gab aus um wie er sind ihn lieber danach etwas",
    "es": "el la los las un una de del y en que se no es por con para al lo su sus si pero como más muy después sin fue este esta está cada cuando ha han hay o porque ya todos todas todo qué cuál nadie mismo misma antes también son era eran nos",
    "fr": "le la les un une des du de d l et est que qui il elle nous vous ne n pas dans pour sur par avec au aux ce cette ces c son sa ses à a été plus sans si mais comme après avant aussi chaque quand où ou parce qu en ont eu y je on se s tous toutes rien lors ensuite",
}
COMMON_WORDS = frozenset(w for words in COMMON.values() for w in words.split())
#: A public byte-level vocabulary of many languages; its words tell natural words of any of them from made-up ones.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

_WORD = re.compile(r"[a-z]{2,}")  # single letters say nothing: random strings are full of them
_ANY_WORD = re.compile(r"[\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]{2}|[^\W\d_]{2,}")  # two signs of a script without blanks make a word
_END = re.compile(r"[.!?:;…。！？][\"'”’»)\]`*_]*\s*$")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])[\"'”’»)\]`*_]*\s+|(?<=[。！？])")
_BEFORE = re.compile(r"^\s*(?:>+\s?)+|^\s*\[?\d\d:\d\d(?::\d\d)?(?:[.,]\d+)?\]?\s+(?=\S+ \S)")  # quotes and clock times before a line
_MARKER = re.compile(r"(?:[-*•‣◦+]|\(?\d{1,4}[.)])\s+(?:\[[ xX]\]\s+)?|\[[ xX]\]\s+")
_FOREIGN = re.compile(r"[^\W\d_\x00-\x7f]")
_GARBLED = re.compile("Ã.|â€.?|Â.|ï¿½|\ufffd|â\x80.|Ð.|Ñ.|[\x80-\x9f]")

_PLAIN = bytes(c for c in range(256) if c > 127 or chr(c).isalnum() or chr(c).isspace())
_DIGITS, _SPACES = b"0123456789", bytes(c for c in range(128) if chr(c).isspace())

#: Least share of common words in sentences; made-up words and menus stay below it, also where sentences are full of names.
COMMON_SHARE = 0.155
#: Most that symbols, and digits, may take of the characters of sentences.
SYMBOL_SHARE, DIGIT_SHARE = 0.15, 0.2
#: Of words of four letters or more, the least share that a vocabulary knows in sentences of an unlisted language.
KNOWN_SHARE = 0.1
#: Share of a text that repeated sentences, or the dominant n-gram, may take.
REPEATED_SHARE, GRAM_SHARE = 0.6, 0.5


class Figures:
    """Counts of a stretch of text."""

    __slots__ = ("chars", "common", "digits", "gaps", "lines", "marked", "punctuated", "solid", "symbols", "text", "words")

    def __init__(self, text: str, chars: int):
        raw = text.encode("utf-8", "replace")
        plain = len(raw) == len(text)
        self.text, self.lines, self.chars = text, 1, chars
        self.solid = max(1, len(raw.translate(None, _SPACES)) - (len(raw) - len(text)))
        self.symbols = len(raw.translate(None, _PLAIN))
        self.digits = len(raw) - len(raw.translate(None, _DIGITS))
        self.words = (_WORD if plain else _ANY_WORD).findall(text.lower())
        self.common = sum(map(COMMON_WORDS.__contains__, self.words))
        self.punctuated = int(_END.search(text[-12:]) is not None)
        self.marked = int(_MARKER.match(text) is not None)
        # cells: tabs, wide spaces, bars, dots between words, separators without a space after them
        n = text.count("|") + text.count("\t") + text.count("   ") + text.count(",") - text.count(", ") + text.count(";") - text.count("; ")
        if text[-1:] in ",;":
            n -= 1
        self.gaps = n if plain else n + text.count(" · ") + text.count(" » ")

    @classmethod
    def joined(cls, parts: list[Figures]) -> Figures:
        """Figures of stretches on lines of their own."""
        if len(parts) == 1:
            return parts[0]
        f = object.__new__(cls)
        f.text = "\n".join(p.text for p in parts)
        f.words = [w for p in parts for w in p.words]
        f.lines, f.chars, f.solid = len(parts), sum(p.chars for p in parts), sum(p.solid for p in parts)
        f.symbols, f.digits, f.common = sum(p.symbols for p in parts), sum(p.digits for p in parts), sum(p.common for p in parts)
        f.punctuated, f.marked, f.gaps = sum(p.punctuated for p in parts), sum(p.marked for p in parts), sum(p.gaps for p in parts)
        return f

    @property
    def wordy(self) -> bool:
        """Whether it has the make-up of sentences: few symbols and digits, no cells."""
        n = len(self.words)
        return n > 0 and self.symbols <= SYMBOL_SHARE * self.solid and self.digits <= DIGIT_SHARE * self.solid and 3 * self.gaps <= n and self.solid <= 14 * n

    @property
    def familiar(self) -> bool:
        return len(self.words) > 0 and self.common >= COMMON_SHARE * len(self.words)


@lru_cache(maxsize=2)
def known_words(vocabulary: str) -> frozenset[bytes]:
    """Words of four letters or more of a vocabulary. A file that is missing or holds none fails: without words, sentences of unlisted
    languages in plain ASCII would come out as junk."""
    words = frozenset(p[1:] for p in vocabulary_ranks(vocabulary) if p[:1] == b" " and len(p) > 4)
    if not words:
        raise ValueError(f"no words in the vocabulary {vocabulary}")
    return words


def _natural_words(f: Figures, vocabulary: frozenset[bytes]) -> bool:
    """Whether the words look like those of some language: letters beyond ASCII, or enough that the vocabulary knows."""
    n = len(f.words)
    if 12 * sum(1 for w in f.words if _FOREIGN.search(w)) >= n:
        return True
    long = [w for w in f.words if len(w) > 3]
    known = sum(w.encode() in vocabulary for w in long)
    return known >= 2 and known >= KNOWN_SHARE * len(long)


def sentences_of(text: str) -> list[str]:
    return [x for x in (s.strip() for s in _SENTENCE.split(text)) if x]


def gram_coverage(words: list[str], sizes: tuple[int, ...] = (1, 2, 4)) -> float:
    """The greatest share of the characters of the words that one n-gram covers, its occurrences not overlapping; 0 below 16 words."""
    n = len(words)
    if n < 16:
        return 0.0
    total = sum(map(len, words))
    best = 0.0
    for size in sizes:
        grams = Counter(words if size == 1 else zip(*(words[i:] for i in range(size))))
        often = [(k * (len(g) if size == 1 else sum(map(len, g))), k, g) for g, k in grams.items() if k > 1]
        if not often:
            continue
        covered, k, top = max(often)
        if size > 1 and len(set(top)) < size:  # only then it can overlap itself
            k, i = 0, 0  # the dominant one without its overlaps
            while i + size <= n:
                if tuple(words[i : i + size]) == top:
                    k, i = k + 1, i + size
                else:
                    i += 1
            covered = k * sum(map(len, top))
        best = max(best, covered / total)
    return best


def _kind(f: Figures, vocabulary: frozenset[bytes]) -> str:
    """Kind of a stretch of text by its figures: prose, list, table, machine or junk."""
    n = len(f.words)
    if f.solid >= 24 and len(_GARBLED.findall(f.text)) > 0.12 * max(1, n):
        return "junk"
    if f.wordy:
        if f.familiar and (n >= 5 or f.punctuated) and not (f.marked and n < 6 * f.marked):
            return "prose"
        if not f.familiar and n >= 5 and f.symbols <= 0.1 * f.solid and f.digits <= 0.08 * f.solid and not f.gaps:
            # of no listed language: sentences by their ends and lengths, words by their letters
            ends = len(sentences_of(f.text))
            if _END.search(f.text) and 3.5 * ends <= n <= 50 * ends and 2 * f.marked <= f.lines and _natural_words(f, vocabulary):
                return "prose"
        if f.lines == 1 and f.text.startswith("#") and n <= 8:
            return "prose"  # a heading
        if n <= 5 and f.lines == 1 and f.punctuated and not f.marked and f.symbols + f.digits <= 0.1 * f.solid:
            return "prose"
    longest = max(map(len, f.text.split()))
    if longest >= 24 and 2 * longest >= f.solid / f.lines or not n and not f.digits:
        return "junk"
    if f.gaps >= max(1, f.lines) and f.symbols <= 0.35 * f.solid and not f.familiar:
        return "junk" if f.lines == 1 and " | " in f.text and not f.text.startswith("|") else "table"
    if f.symbols + f.digits > 0.17 * f.solid and not (f.marked and 2 * f.marked >= f.lines):
        return "machine"
    if n <= 6 * f.lines or f.marked:
        return "list"
    return "junk"


def _parts(text: str, vocabulary: frozenset[bytes]) -> list[tuple[str, Figures]]:
    out: list[tuple[str, Figures]] = []
    block: list[Figures] = []

    def flush() -> None:
        if not block:
            return
        # a line of sentences tells by itself, and what goes on before or after it belongs to it; all others are judged together
        sure = [f.familiar and len(f.words) >= 6 and f.wordy for f in block]
        if any(sure):
            for i in range(1, len(block)):
                sure[i] = sure[i] or sure[i - 1] and not block[i - 1].punctuated and not block[i].marked and block[i].wordy
            for i in range(len(block) - 2, -1, -1):
                sure[i] = sure[i] or sure[i + 1] and not block[i].punctuated and not block[i + 1].marked and len(block[i].words) >= 4 and block[i].wordy
        i = 0
        while i < len(block):
            j = i + 1
            while j < len(block) and sure[j] == sure[i]:
                j += 1
            f = Figures.joined(block[i:j])
            out.append((_kind(f, vocabulary), f))
            i = j
        block.clear()

    for raw in text.split("\n"):
        s = _BEFORE.sub("", raw.replace("\ufeff", "")).strip()
        if s:
            block.append(Figures(s, len(raw.strip("\r"))))
        else:
            flush()
    flush()
    return out


def passages(text: str, vocabulary: frozenset[bytes] = frozenset()) -> list[tuple[str, int, str]]:
    """(kind, characters, text) of each passage; kinds: prose, list, table, machine, junk. Blank lines belong to none."""
    return [(kind, f.chars, f.text) for kind, f in _parts(text, vocabulary)]


def judge(text: str | None, vocabulary: frozenset[bytes] = frozenset(), duplicate_lines: float = 0.0, duplicate_paragraphs: float = 0.0) -> tuple:
    """(shares of prose, list, table, machine and junk, the dominant n-gram's coverage, is_prose) of a text; nulls if it is blank."""
    parts = _parts(text or "", vocabulary)
    total = sum(f.chars for _, f in parts)
    if not total:
        return (None,) * 7
    by = dict.fromkeys(("prose", "list", "table", "machine", "junk"), 0.0)
    for kind, f in parts:
        by[kind] += f.chars
    top = gram_coverage([w for _, f in parts for w in f.words])
    if by["prose"]:
        said = [s for kind, f in parts if kind == "prose" for s in sentences_of(f.text)]
        times = Counter(said)
        if len(times) < len(said):
            size = sum(map(len, said))
            # sentences that come back again and again are filler, whatever they say
            if max(sum(len(s) * (k - 1) for s, k in times.items()) / size, duplicate_lines, duplicate_paragraphs) > REPEATED_SHARE:
                filler = sum(len(s) * k for s, k in times.items() if k > 1) / size * by["prose"]
                by["junk"] += filler
                by["prose"] -= filler
        if top > GRAM_SHARE:
            by["junk"] += by["prose"]
            by["prose"] = 0.0
    share = [n / total for n in by.values()]
    return (*share, top, share[0] >= 0.5)


_SHARES = "doc_id long, prose_share double, list_share double, table_share double, machine_share double, junk_share double, top_gram_share double, is_prose boolean, duplicate_line_share double, duplicate_paragraph_share double"


def prose_shares(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """For each document the shares of its characters by kind of passage, repetition figures and is_prose.

    is_prose is false if more than half of the characters (blank lines apart) belong to lists, tables, machine output or junk. A null,
    empty or blank text has null in all columns but doc_id. Rows with equal doc_id are judged one by one; other columns are ignored.
    A vocabulary that a worker cannot find, or that holds no words, fails the query.
    """
    ship(docs.sparkSession, vocabulary)
    names = [x.split()[0] for x in _SHARES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = known_words(vocabulary)
        for b in batches:
            rows = [
                (i, *judge(t, known, 0.0 if pd.isna(x) else x, 0.0 if pd.isna(y) else y), x, y)
                for i, t, x, y in zip(b["doc_id"], b["text"], b["duplicate_line_share"], b["duplicate_paragraph_share"])
            ]
            yield pd.DataFrame(rows, columns=names).astype({"is_prose": "boolean"})

    lines, paragraphs = _lines(F.col("text")), _paragraphs(F.col("text"))
    rows = spread(docs.select("doc_id", "text")).select("doc_id", "text", lines.alias("l"), paragraphs.alias("p"))
    return rows.select("doc_id", "text", _again(F.col("l")).alias("duplicate_line_share"), _again(F.col("p")).alias("duplicate_paragraph_share")).mapInPandas(run, _SHARES)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n"), lambda x: F.length(F.trim(x)) > 0)


def _paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\r?\n(?:[ \t]*\r?\n)+"), lambda x: F.length(F.trim(x)) > 0)


def _again(parts: Column) -> Column:
    """Share of the entries that repeat an earlier one."""
    return _share(F.size(parts) - F.size(F.array_distinct(parts)), F.size(parts))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def text_statistics(docs: DataFrame) -> DataFrame:
    """Statistics of each document by built-in functions: characters, words, lines, mean_word_length, symbol_share (neither letter, digit
    nor white space), punctuated_line_share, common_word_share, duplicate_line_share and duplicate_paragraph_share (of the non-blank ones,
    all but the first of each text; blank lines part paragraphs). Words are runs of letters. Shares whose base is empty are null; a null
    text counts as an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)
    df = docs.select("doc_id", text.alias("t"), words.alias("w"), _lines(text).alias("l"), _paragraphs(text).alias("p"))
    n, m, k = F.size("w").cast("long"), F.length("t").cast("long"), F.size("l").cast("long")
    letters = F.length(F.array_join("w", ""))
    return df.select(
        "doc_id", m.alias("characters"), n.alias("words"), k.alias("lines"),
        _share(letters, n).alias("mean_word_length"),
        _share(F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]", "")), m).alias("symbol_share"),
        _share(F.size(F.filter("l", lambda x: x.rlike(r"[.!?:;][\"')\]]*\s*$"))), k).alias("punctuated_line_share"),
        _share(F.size(F.filter("w", lambda x: x.isin(*sorted(COMMON_WORDS)))), n).alias("common_word_share"),
        _again(F.col("l")).alias("duplicate_line_share"), _again(F.col("p")).alias("duplicate_paragraph_share"),
    )
