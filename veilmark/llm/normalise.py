"""One consistent form for texts that look the same.

The consistent form is compatibility-composed: full-width, styled and ligature characters become plain ones, accents
are precomposed, every kind of space becomes a single one, default-ignorable characters go, and letters of another
script inside a word become the letters they pass for. What carries meaning stays: words wholly in another script,
joiners a script's spelling needs, emoji sequences, superscripts and subscripts, dashes, quotes, the ellipsis. The
comparison key is the full case folding of the consistent form.

Values that are plain ASCII with single spaces are recognised in the JVM and never leave it; the rest goes through an
Arrow batch where each distinct value is worked on once.

Defined cases: null stays null; empty stays empty; a value of spaces or invisible characters becomes empty; the form
of a consistent form is itself; texts of any length are processed whole; new columns whose names clash with existing
ones get the suffix `_2`.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cyrillic, Greek and Armenian letters that pass for Latin ones (fixed values).
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Һ": "H",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y", "ѵ": "v", "ӏ": "l",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
    "ɑ": "a", "ɡ": "g", "ı": "i",
}
#: Letters of the table above that are Latin themselves: replaced only beside foreign letters, never alone.
LATIN_EXTRA = frozenset("ɑɡı")
#: Letters no single living orthography mixes with the others: a word of look-alikes with one of them is a disguise.
TELLING = frozenset("ѕԁԛԝһӏѵЅԀԚԜҺ")
TO_CYRILLIC = {v: k for k, v in LOOKALIKES.items() if "Ѐ" <= k <= "ӿ" and k not in TELLING}
#: Compatibility characters that are consistent as they stand: ellipsis, dashes, quotes, the micro sign.
KEEP = frozenset("…‥‐‑‒–—―‘’‚‛“”„‟′″‴µ")
KEEP_TAGS = ("<super>", "<sub>", "<fraction>")

IGNORABLE = regex.compile(r"[\p{Default_Ignorable_Code_Point}￹-￻]")
SPACE = regex.compile(r"[\p{Z}\t\n\r\f\v\x1c-\x1f\x85]+")
WORD = regex.compile(r"[\p{L}\p{M}]+")
CLUSTER = regex.compile(r"\X", regex.S)
FOREIGN = regex.compile(r"[\p{Greek}\p{Cyrillic}\p{Armenian}]")
LATIN = regex.compile(r"\p{Latin}")
JOINING = regex.compile(
    r"[\p{Arabic}\p{Syriac}\p{Nko}\p{Mongolian}\p{Devanagari}\p{Bengali}\p{Gurmukhi}\p{Gujarati}\p{Oriya}\p{Tamil}\p{Telugu}\p{Kannada}\p{Malayalam}\p{Sinhala}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
)
MONGOLIAN = regex.compile(r"\p{Mongolian}")
RIGHT_TO_LEFT = regex.compile(r"[\p{Arabic}\p{Hebrew}\p{Syriac}\p{Thaana}]")
EMOJI = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}️⃣]")
VARIED = regex.compile(r"[\p{Emoji}]")
HAN = regex.compile(r"\p{Han}")
#: In the JVM: printable ASCII words with single spaces between them.
PLAIN = r"\A(?:[\x21-\x7e]+(?: [\x21-\x7e]+)*)?\z"


class _Compatible(dict):
    """Character -> its plain form, worked out when first met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        tag = unicodedata.decomposition(ch).split(" ", 1)[0]
        if ch in KEEP or tag in KEEP_TAGS or not tag.startswith("<"):
            out = ch
        else:
            out = unicodedata.normalize("NFKC", ch)
        self[code] = out
        return out


_COMPATIBLE = _Compatible()


def _needed(before: str, ch: str, after: str) -> bool:
    """Whether an ignorable character between two others belongs to the spelling."""
    if ch in "‌‍":
        if before and unicodedata.combining(before) == 9 and JOINING.match(before):
            return True
        if before and after and JOINING.match(before) and JOINING.match(after):
            return True
        return ch == "‍" and bool(before and after and EMOJI.match(before) and EMOJI.match(after))
    if ch in "︎️":
        return bool(before and VARIED.match(before))
    if "︀" <= ch <= "︍" or "\U000e0100" <= ch <= "\U000e01ef":
        return bool(before and (HAN.match(before) or JOINING.match(before)))
    if "\U000e0020" <= ch <= "\U000e007f":
        return bool(before and (EMOJI.match(before) or "\U000e0020" <= before <= "\U000e007f"))
    if ch in "᠋᠌᠍᠎᠏":
        return bool(before and MONGOLIAN.match(before))
    if ch in "‎‏؜":
        return bool((before and RIGHT_TO_LEFT.match(before)) or (after and RIGHT_TO_LEFT.match(after)))
    if ch in "ᅟᅠㅤ឴឵":
        return bool(before and unicodedata.category(before).startswith("L") and ord(before) > 0x1000)
    return False


def _without_ignorable(s: str) -> str:
    ignorable = [IGNORABLE.match(ch) is not None for ch in s]
    # the next character that is none, or an emoji variation, from the end: runs of any length are passed once
    following, after = [""] * len(s), ""
    for i in range(len(s) - 1, -1, -1):
        following[i] = after
        if not ignorable[i] or s[i] == "️":
            after = s[i]
    out: list[str] = []
    for i, ch in enumerate(s):
        if not ignorable[i] or _needed(out[-1] if out else "", ch, following[i]):
            out.append(ch)
    return "".join(out)


def _undisguised(s: str) -> str:
    genuine = False
    latin_context = False
    for w in WORD.findall(s):
        foreign = FOREIGN.findall(w)
        if foreign and any(c not in LOOKALIKES for c in foreign):
            genuine = True
        elif LATIN.search(w):
            latin_context = True

    def one(m: regex.Match) -> str:
        w = m.group()
        foreign = FOREIGN.findall(w)
        if not foreign:
            return w
        real = [c for c in foreign if c not in LOOKALIKES]
        latin = LATIN.findall(w)
        if not real:
            if latin or any(c in TELLING for c in foreign) or (latin_context and not genuine and len(w) > 1):
                return "".join(LOOKALIKES.get(c, c) for c in w)
            return w
        if latin and all(c in TO_CYRILLIC for c in latin) and all("Ѐ" <= c <= "ԯ" for c in foreign):
            return "".join(TO_CYRILLIC.get(c, c) for c in w)
        if latin and len(latin) > len(real):
            return "".join(LOOKALIKES.get(c, c) for c in w)
        return w

    return WORD.sub(one, s)


@lru_cache(maxsize=65536)
def _short(s: str) -> str:
    return _form(s)


def _form(s: str) -> str:
    if IGNORABLE.search(s):
        s = _without_ignorable(s)
    s = unicodedata.normalize("NFC", s.translate(_COMPATIBLE))
    if FOREIGN.search(s):
        s = unicodedata.normalize("NFC", _undisguised(s))
    return SPACE.sub(" ", s).strip(" ")


def consistent(s: str | None) -> str | None:
    """The consistent form of one value."""
    if s is None:
        return None
    if s.isascii():
        return " ".join(s.split())
    return _short(s) if len(s) <= 300 else _form(s)


def aligned(s: str) -> tuple[str, list[int] | None]:
    """The consistent form of s, and where in s each of its characters begins, with the end of s last.

    The places are None where the form is s itself or no such places exist, which is rare: form[i] then has no place.
    """
    form = consistent(s)
    if form == s:
        return form, None
    at, pieces, n = [], [], 0
    for c in CLUSTER.findall(s):
        if SPACE.fullmatch(c):
            piece = "" if not pieces or pieces[-1] == " " else " "
        else:
            piece = unicodedata.normalize("NFC", (_without_ignorable(c) if IGNORABLE.search(c) else c).translate(_COMPATIBLE))
        if piece:
            pieces.append(piece)
            at.extend([n] * len(piece))
        n += len(c)
    if pieces and pieces[-1] == " ":
        at.pop()
    return form, [*at, len(s)] if len(at) == len(form) else None


def key(s: str | None) -> str | None:
    """The comparison key: full case folding of the consistent form."""
    return None if s is None else unicodedata.normalize("NFC", consistent(s).casefold())


@F.pandas_udf(T.StringType())
def _consistent(values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values)
    forms = pd.Series([consistent(v) for v in distinct], dtype=object)
    return pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def _key(values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values)
    forms = pd.Series([key(v) for v in distinct], dtype=object)
    return pd.Series([forms[c] if c >= 0 else None for c in codes], dtype=object)


def is_plain(c: Column) -> Column:
    return c.rlike(PLAIN)


def form(c: Column) -> Column:
    """Consistent form of a string column."""
    return F.when(c.isNull() | is_plain(c), c).otherwise(_consistent(F.when(~is_plain(c), c)))


def folded_key(c: Column) -> Column:
    """Comparison key of a string column."""
    return F.when(c.isNull() | is_plain(c), F.lower(c)).otherwise(_key(F.when(~is_plain(c), c)))


def normalised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with `<column>_form` and `<column>_key` of each of columns."""
    used = {c.lower() for c in df.columns}
    for c in columns:
        for suffix, f in (("form", form), ("key", folded_key)):
            name, i = f"{c}_{suffix}", 2
            while name.lower() in used:
                name, i = f"{c}_{suffix}_{i}", i + 1
            used.add(name.lower())
            df = df.withColumn(name, f(F.col(f"`{c}`")))
    return df


def inconsistent(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, field, value, form) of the values that differ from their consistent form, each once."""
    odd = F.filter(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").alias("value")) for c in columns]), lambda x: x["value"].isNotNull() & ~x["value"].rlike(PLAIN))
    rows = df.select(*keys, F.explode(odd).alias("x")).select(*keys, "x.*")
    rows = rows.withColumn("form", _consistent("value")).filter(F.col("form") != F.col("value"))
    return rows.dropDuplicates([*keys, "field"])
