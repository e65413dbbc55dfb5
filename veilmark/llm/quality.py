"""Per-document text statistics, and natural prose told from lists, tables, dumps and junk.

One row a document, without a shuffle: word, character and punctuation ratios over the whole text, and the layout of
its lines. Layout comes first, where a document has three lines or more and no sentences:

alignment: the largest share of lines with the same number of the same delimiter (bars, tabs, commas, semicolons, wide
gaps); field_alignment: the same of colons and equal signs; bullet_ratio: the share of lines that open with a list mark;
indent_period and length_period: the highest correlation of the lines' indentation, and of their lengths, with
themselves at a lag of up to `MAX_LAG` lines (a constant sequence counts as 1; for lengths at least the share of lines
that have the same one, of 24 characters or more).

What has no lines to be laid out, or none that say anything, is judged by its ratios: letters, symbols, one token that
is most of the text, words a line, short words and repeated words. No word list decides, so prose is prose in any
language with spaces. The share of common words is a statistic only; which words are common is learned from the
documents, language by language (`common_words`).

The texts of an Arrow batch are laid end to end as one array of code points and every statistic is computed by array
operations over it: no loop over documents, lines or characters, and about a fifth of the CPU time of the same
statistics as regular expressions in the JVM.

Defined cases: a null text has null statistics and is no kind; an empty or blank text has zeros; a ratio without a
denominator is 0; without common words given, their share is 0; texts are taken whole, whatever their length (a batch
is cut into pieces of whole texts); documents are judged by themselves, so copies get the same result; extra columns
are kept and ones named like a statistic are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_LAG = 4
PIECE = 1 << 22
LETTERS = re.compile(r"[^\W\d_]+")

STATISTICS = {
    "n_chars": "long", "n_words": "long", "mean_word_length": "double", "symbol_ratio": "double", "end_punct_ratio": "double", "common_ratio": "double", "letter_ratio": "double", "short_ratio": "double", "richness": "double",
    "sentence_ratio": "double", "n_lines": "int", "bullet_ratio": "double", "prose_share": "double", "alignment": "double", "field_alignment": "double", "indent_period": "double", "length_period": "double", "longest_token": "int",
}

_LETTER, _DIGIT, _SPACE, _PLAIN, _OTHER = range(5)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the code points of the basic plane."""
    kinds, lower = np.empty(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    plain = set(".,;:!?'\"’“”„«»¿¡()-–—…/%°")
    for c in range(0x10000):
        ch = chr(c)
        k = unicodedata.category(ch)[0]
        kinds[c] = _SPACE if ch.isspace() else _LETTER if k in "LM" else _DIGIT if k == "N" else _PLAIN if ch in plain else _OTHER
        low = ch.lower()
        if len(low) == 1:
            lower[c] = ord(low)
    return kinds, lower


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, 0x100000001B3, np.uint64), dtype=np.uint64)


@lru_cache(maxsize=4)
def _common_hashes(words: tuple[str, ...]) -> np.ndarray:
    out = []
    with np.errstate(over="ignore"):
        for w in words:
            cp = np.array([ord(c) for c in w], np.uint64)
            out.append((cp * _powers(len(cp))).sum(dtype=np.uint64))
    return np.array(sorted(out), np.uint64)


def _is(a: np.ndarray, chars: str) -> np.ndarray:
    out = a == ord(chars[0])
    for ch in chars[1:]:
        out |= a == ord(ch)
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def _between(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each [start, end)."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[end] - total[start]).astype(float)


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    edge = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _most(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Largest value of each owner (owners ascend); 0 without any."""
    out = np.zeros(n)
    if len(values):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] = np.maximum.reduceat(values, first)
    return out


def _period(x: np.ndarray, doc: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    n = len(n_lines)
    mean = _share(np.bincount(doc, x, n), n_lines)
    c = x - mean[doc]
    total = np.bincount(doc, c * c, n)
    best = np.full(n, -np.inf)
    for k in range(1, MAX_LAG + 1):
        same = doc[k:] == doc[:-k]
        best = np.maximum(best, np.bincount(doc[k:][same], (c[k:] * c[:-k])[same], n))
    out = np.where(total < 1e-9, 1.0, _share(best, total))
    return np.where(n_lines < 6, 0.0, out)


def _alignment(counts: np.ndarray, least: int, doc: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Share of a document's lines that have its middle count, which is the most common one wherever one has the majority."""
    n = len(n_lines)
    out = np.zeros(n)
    worth = (n_lines >= 3) & (np.bincount(doc, counts >= least, n) * 2 >= n_lines)
    at = worth[doc]
    if not at.any():
        return out
    d, c = doc[at], counts[at]
    order = np.lexsort((c, d))
    d, c = d[order], c[order]
    size = np.bincount(d, minlength=n)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    middle = np.zeros(n)
    middle[worth] = c[(first + size // 2)[worth]]
    same = np.bincount(d, c == middle[d], n)
    return np.where(worth & (middle >= least), _share(same, n_lines), 0.0)


def describe(texts: list[str], common_words: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    """The statistics of texts, none of them null. common_words: in lower case."""
    n = len(texts)
    kinds, lower = _tables()
    size = np.array([len(t) for t in texts], np.int64)
    # every text is followed by a line end, so that runs and lines never reach into the next
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    end = start + size
    astral = raw > 0xFFFF
    a = np.where(astral, 0xFFFF, raw)
    kind = kinds[a]
    if astral.any():
        kind = np.where(astral, np.where((raw >= 0x20000) | ((raw >= 0x1D400) & (raw <= 0x1D7FF)), _LETTER, _OTHER), kind).astype(np.uint8)
    letter, space = kind == _LETTER, kind == _SPACE
    before = lambda x, k=1: np.concatenate([np.zeros(min(k, len(x)), x.dtype), x[:-k]])
    after = lambda x, k=1: np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])
    out: dict[str, np.ndarray] = {}

    # words: letters, with apostrophes and hyphens between letters
    inner = _is(raw, "'’-") & before(letter) & after(letter)
    w0, _ = _runs(letter | inner)
    words = _between(_flags(w0, len(raw)), start, end)
    letters = _between(letter, start, end)
    out["n_chars"] = size
    out["n_words"] = words.astype(np.int64)
    out["mean_word_length"] = _share(letters, words)
    out["letter_ratio"] = _share(letters, size)
    out["symbol_ratio"] = _share(_between(kind == _OTHER, start, end), size)

    # runs of letters, by hash of their lower case
    r0, r1 = _runs(letter)
    length = r1 - r0
    owner = np.searchsorted(start, r0, side="right") - 1
    n_runs = np.bincount(owner, minlength=n).astype(float)
    if len(r0):
        inside = np.flatnonzero(letter)
        place = inside - np.repeat(r0, length)
        power = _powers(int(length.max()))
        low = np.where(astral[inside], raw[inside], lower[a[inside]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            code = np.add.reduceat(low * power[place], np.concatenate([[0], np.cumsum(length)[:-1]]))
        common = np.isin(code, _common_hashes(common_words))
        mixed = code ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, unique = np.unique(mixed, return_index=True)
        distinct = np.bincount(owner[unique], minlength=n).astype(float)
    else:
        common, distinct = np.zeros(0, bool), np.zeros(n)
    out["common_ratio"] = _share(np.bincount(owner, common, n), n_runs)
    out["short_ratio"] = _share(np.bincount(owner, length <= 3, n), n_runs)
    out["richness"] = _share(distinct, np.sqrt(n_runs))

    # sentence ends: a stop after a word, before a space, with closing quotes between
    quote = _is(raw, "\"'”’»)]")
    closed = space | (quote & (after(space) | (after(quote) & after(space, 2))))
    stop = _is(raw, ".!?…") & (before(letter) | before(kind == _DIGIT) | before(quote)) & after(closed)
    out["sentence_ratio"] = _share(_between(stop, start, end), words)

    # tokens between spaces
    t0, t1 = _runs(~space)
    out["longest_token"] = _most((t1 - t0).astype(float), np.searchsorted(start, t0, side="right") - 1, n).astype(np.int32)

    # lines that are not blank
    newline = raw == 10
    stops = np.flatnonzero(newline)
    begins = np.concatenate([[0], stops[:-1] + 1])
    token_start = _flags(t0, len(raw))
    tokens = _between(token_start, begins, stops)
    live = tokens > 0
    begins, stops, tokens = begins[live], stops[live], tokens[live]
    doc = np.searchsorted(start, begins, side="right") - 1
    n_lines = np.bincount(doc, minlength=n).astype(float)
    out["n_lines"] = n_lines.astype(np.int32)
    if not len(begins):
        return out | {k: np.zeros(n) for k in ("end_punct_ratio", "bullet_ratio", "prose_share", "alignment", "field_alignment", "indent_period", "length_period")}
    first = t0[np.searchsorted(t0, begins)]
    last = t1[np.searchsorted(t1, stops, side="right") - 1] - 1
    at = lambda k: raw[np.minimum(first + k, len(raw) - 1)]
    ends = np.zeros(len(begins), bool)
    tip = last.copy()
    for _ in range(3):
        ends |= _is(raw[tip], ".!?:;…。")
        tip = np.where(quote[tip] & (tip > first), tip - 1, tip)
    digit = lambda k: kind[np.minimum(first + k, len(raw) - 1)] == _DIGIT
    gap = lambda k: space[np.minimum(first + k, len(raw) - 1)]
    dot = lambda k: _is(at(k), ".)")
    bullet = _is(at(0), "-*•·‣▪◦+>") & gap(1)
    bullet |= digit(0) & ((dot(1) & gap(2)) | (digit(1) & ((dot(2) & gap(3)) | (digit(2) & dot(3) & gap(4)))))
    bullet |= letter[first] & dot(1) & gap(2)
    bullet |= (at(0) == ord("[")) & ((at(2) == ord("]")) & gap(3) | (at(3) == ord("]")) & gap(4) | (at(1) == ord("]")) & gap(2) | (at(4) == ord("]")) & gap(5))
    dots, blanks = raw == ord("."), raw == 32
    leader = dots & after(dots) & after(dots, 2) & after(dots, 3) & ~before(dots)
    wide = blanks & after(blanks) & after(blanks, 2) & ~before(blanks) & ~before(newline)
    per_line = {
        "pipe": (_between(raw == ord("|"), begins, stops), 1),
        "tab": (_between(raw == 9, first, stops), 1),
        "comma": (_between((raw == ord(",")) & ~after(blanks), begins, stops), 2),
        "semicolon": (_between((raw == ord(";")) & ~after(blanks), begins, stops), 2),
        "gap": (_between(leader | wide, begins, stops), 1),
    }
    per_field = {
        "colon": (_between(raw == ord(":"), begins, stops), 2),
        "equals": (_between((raw == ord("=")) & ~before(raw == ord("=")) & ~after(raw == ord("=")), begins, stops), 1),
    }
    cells = (per_line["pipe"][0] + per_line["tab"][0] + per_line["gap"][0]) > 0
    # running text: no short bullet, no table row, and either long or closed
    running = ~cells & np.where(bullet, tokens >= 25, (tokens >= 8) | (ends & (tokens >= 3)))
    long = (stops - begins).astype(float)
    out["end_punct_ratio"] = _share(np.bincount(doc, ends, n), n_lines)
    out["bullet_ratio"] = _share(np.bincount(doc, bullet, n), n_lines)
    out["prose_share"] = _share(np.bincount(doc, long * running, n), np.bincount(doc, long, n))
    out["alignment"] = np.max([_alignment(c, least, doc, n_lines) for c, least in per_line.values()], axis=0)
    out["field_alignment"] = np.max([_alignment(c, least, doc, n_lines) for c, least in per_field.values()], axis=0)
    out["indent_period"] = _period((first - begins).astype(float), doc, n_lines)
    # wrapped at one width, all but the last line have the same length
    out["length_period"] = np.maximum(_period(long, doc, n_lines), _alignment(stops - begins, 24, doc, n_lines))
    return out


def _flags(at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def _pieces(values: list[str]) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for i, v in enumerate(values):
        if held and held + len(v) > PIECE:
            yield begin, i
            begin, held = i, 0
        held += len(v)
    if begin < len(values):
        yield begin, len(values)


def _describe(words: tuple[str, ...]):
    @F.pandas_udf(T.StructType([T.StructField(k, T.LongType() if t == "long" else T.IntegerType() if t == "int" else T.DoubleType()) for k, t in STATISTICS.items()]))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            known = batch.notna().to_numpy()
            texts = batch[known].tolist()
            parts = [describe(texts[i:j], words) for i, j in _pieces(texts)]
            frame = pd.DataFrame({k: np.concatenate([p[k] for p in parts]) if parts else np.array([], float) for k in STATISTICS})
            if not known.all():
                frame.index = np.flatnonzero(known)
                frame = frame.reindex(range(len(batch)))
                frame = frame.astype({k: "Int64" for k, t in STATISTICS.items() if t != "double"})
            yield frame

    return of


def common_words(documents: DataFrame, text: str = "text", lang: str = "lang", most: int = 60, least_share: float = 0.01) -> list[str]:
    """The `most` words met in the most documents of each language that has at least `least_share` of all documents.

    Counted over all documents, by task before the shuffle; the result is bounded by most / least_share words.
    """
    schema = "lang string, word string, n long"

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def out() -> pd.DataFrame:
            rows = pd.DataFrame([(k, w, n) for (k, w), n in seen.items()], columns=["lang", "word", "n"])
            seen.clear()
            return rows

        for batch in batches:
            for k, t in zip(batch["lang"], batch["text"], strict=True):
                seen.update((k, w) for w in {x.lower() for x in LETTERS.findall(t)})
                seen[k, ""] += 1
                if len(seen) > 200_000:
                    yield out()
        yield out()

    rows = documents.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInPandas(flow, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sizes = counts.filter("word = ''").select("lang", F.col("n").alias("size"))
    large = sizes.filter(F.col("size") >= least_share * sizes.agg(F.sum("size")).scalar()).select("lang")
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = counts.filter("word <> ''").join(large, "lang", "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return sorted({r["word"] for r in top.select("word").distinct().collect()})


def statistics(documents: DataFrame, text: str = "text", common: Sequence[str] = ()) -> DataFrame:
    """documents with the columns of STATISTICS. common: the words whose share is told, in lower case."""
    kept = [c for c in documents.columns if c not in STATISTICS]
    rows = documents.select(*[F.col(f"`{c}`") for c in kept], _describe(tuple(common))(F.col(f"`{text}`")).alias("__s"))
    known = F.col(f"`{text}`").isNotNull() if text in kept else F.lit(True)
    return rows.select(*[F.col(f"`{c}`") for c in kept], *[F.when(known, F.col(f"__s.{k}")).alias(k) for k in STATISTICS])


def kind(aligned: float = 0.6, listed: float = 0.4, periodic: float = 0.5) -> Column:
    """prose, table, list, dump or junk, from the statistics; null where the text is null.

    aligned, listed, periodic: from where on alignment, list marks and the two autocorrelations decide.
    """
    c = F.col
    laid_out = (c("n_lines") >= 3) & (c("sentence_ratio") < 0.02)
    # constant indentation says nothing: most texts have none
    indented = (c("indent_period") > periodic) & (c("indent_period") < 0.999)
    return (
        F.when(c("n_words").isNull(), None)
        .when(laid_out & (c("alignment") >= aligned), "table")
        .when(laid_out & (c("bullet_ratio") >= listed), "list")
        .when(laid_out & ((c("field_alignment") >= aligned) | indented | (c("length_period") > periodic)), "dump")
        .when((~laid_out & (c("letter_ratio") < 0.6)) | (c("letter_ratio") < 0.2) | ((c("longest_token") >= 40) & (c("longest_token") >= 0.2 * c("n_chars"))), "dump")
        .when(c("symbol_ratio") > 0.05, "junk")
        .when(laid_out & (c("n_words") < 3.5 * c("n_lines")) & (c("letter_ratio") >= 0.6), "list")
        .when(((c("richness") < 2.0) & (c("sentence_ratio") < 0.02)) | (c("short_ratio") < 0.15), "junk")
        .otherwise("prose")
    )


def classified(documents: DataFrame, text: str = "text", common: Sequence[str] = ()) -> DataFrame:
    return statistics(documents, text, common).withColumn("kind", kind())
