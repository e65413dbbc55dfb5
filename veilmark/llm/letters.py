"""Plain letters inside the JVM, for operators that only compare words.

The full consistent form is in `normalise`; this is its cheap part as a Catalyst expression: styled and full-width
characters, look-alike letters, invisible characters and odd spaces. ASCII values pass untouched.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Look-alike letters of other scripts and the Latin letters they pass for (fixed values).
LOOKALIKE = ("аеорсухіјѕԁոһαονρικτυε" + "АВСЕНІЈКМОРЅТХУΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdnhaovpiktue" + "ABCEHIJKMOPSTXYABEZHIKMNOPTYX")
HIDDEN = r"[\x{ad}\x{34f}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{2060}-\x{2064}\x{fe00}-\x{fe0f}\x{feff}]"
SPACES = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"


def _styled() -> tuple[str, str]:
    """Full-width and mathematical characters with a plain ASCII form, by rule."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for r in (range(0xFF01, 0xFF5F), range(0x1D400, 0x1D800)) for c in r]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


STYLED = _styled()
#: Combining accents with the letters they occur on in Latin orthographies, composed by rule.
ACCENTS = [(base + mark, unicodedata.normalize("NFC", base + mark)) for mark in "̧̀́̂̃̈" for base in "aeiounycAEIOUNYC" if len(unicodedata.normalize("NFC", base + mark)) == 1]


def plain(text: Column) -> Column:
    """Text in plain letters with single spaces; case is kept."""
    t = F.translate(F.translate(F.regexp_replace(text, HIDDEN, ""), *STYLED), *LOOKALIKE)
    accents = F.array(*[F.struct(F.lit(pair).alias("pair"), F.lit(one).alias("one")) for pair, one in ACCENTS])
    composed = F.aggregate(accents, t, lambda done, x: F.replace(done, x["pair"], x["one"]))
    t = F.when(t.rlike(r"[\x{300}-\x{36f}]"), composed).otherwise(t)
    # plain ASCII, the bulk of the values, passes after one scan
    return F.when(text.rlike(r"[^\x20-\x7e]|  "), F.trim(F.regexp_replace(t, SPACES, " "))).otherwise(F.trim(text))
