"""Text functions as expressions: checksum, scrubbing, caps, tolerant decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import patterns as P


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text contains one of the lower-case words, in any case; null counts as empty."""
    return F.coalesce(F.lower(text).rlike("|".join(re.escape(w) for w in words)), F.lit(False))


#: Cheap conditions a match needs. Searching for them takes one plain scan; the patterns themselves, with their
#: boundaries and alternatives, then only see the few texts that can match.
_DIGITS = r"[0-9][0-9\s.()+\-]{5,}[0-9]"
_GROUPS = r"[0-9]{3}[0-9\s.\-]{5,}[0-9]"
_CARD = r"[0-9][0-9\s\-]{11,}[0-9]"
_ASSIGNED = r"[:=]\s*[\"']?[A-Za-z0-9_\-.~+/]{16,}"


def _has(*words: str) -> Callable[[Column], Column]:
    def any_word(c: Column) -> Column:
        out = c.contains(words[0])
        for w in words[1:]:
            out = out | c.contains(w)
        return out

    return any_word


_KEYS = _has("sk-", "AKIA", "AIza", "ghp_", "gho_", "ghs_", "ghr_", "ghu_")
_KEYS_DETECT = _has("sk-", "AKIA", "ASIA", "ABIA", "ACCA", "AIza", "ghp_", "gho_", "ghs_", "ghr_", "ghu_", "github_pat_", "xox", "k_live_", "k_test_", "eyJ")
GUARDS: dict[str, Callable[[Column], Column]] = {
    P.EMAIL: _has("@"),
    P.SERVER_EMAIL: _has("@"),
    P.PHONE: lambda c: c.rlike(_DIGITS),
    P.SERVER_PHONE: lambda c: c.rlike(_DIGITS),
    P.NATIONAL_ID: lambda c: c.rlike(_GROUPS) | c.rlike("[A-Z]{5}[0-9]{4}"),
    P.NATIONAL_ID_DETECT: lambda c: c.rlike(_GROUPS) | c.rlike("[A-Z]{5}[0-9]{4}"),
    P.SERVER_NATIONAL_ID: lambda c: c.rlike(_GROUPS) | c.rlike("[A-Z]{5}[0-9]{4}"),
    P.CARD_SPACED: lambda c: c.rlike(_CARD),
    P.CARD_LOOSE: lambda c: c.rlike(_CARD),
    P.API_KEY: _KEYS,
    P.API_KEY_ANY: lambda c: _KEYS_DETECT(c) | F.lower(c).contains("bearer") | c.rlike(_ASSIGNED),
    P.PRIVATE_KEY: _has("-----BEGIN"),
    P.PRIVATE_KEY_BLOCK: _has("-----BEGIN"),
    P.SECRET: lambda c: c.contains("-----BEGIN") | c.rlike(_ASSIGNED),
    P.SERVER_URL_PARAM: _has("="),
}


def matches(text: Column, pattern: str) -> Column:
    found = text.rlike(P.java(pattern))
    guard = GUARDS.get(pattern)
    return F.coalesce(guard(text) & found if guard else found, F.lit(False))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column, reject_repeats: bool = True) -> Column:
    """Checksum over the digits of a text: 13 to 19 of them, mod 10; by default not one digit repeated."""
    d = digits(text)
    n = F.length(d)
    reverse = F.split(F.reverse(d), "")
    weighted = F.transform(reverse, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int")))
    total = F.aggregate(weighted, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    good = n.between(13, 19) & (total % 10 == 0)
    if reject_repeats:
        good = good & (F.regexp_replace(d, "^(\\d)\\1+$", "") != "")
    return F.coalesce(good, F.lit(False))


def has_card(text: Column) -> Column:
    """Whether a card-like number with a right checksum occurs."""
    out = F.lit(False)
    for p in P.CARD_BRANDS:
        out = out | F.exists(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({P.java(p)})"), F.lit(1)), lambda m: luhn(m))
    return F.when(text.rlike(_CARD), out).otherwise(F.lit(False))


#: The scrub chain, in order.
SCRUB = (P.EMAIL, P.PHONE, P.NATIONAL_ID, P.CARD_SPACED, P.API_KEY, P.PRIVATE_KEY_BLOCK)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: nesting expressions by hand multiplies them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scrub(text: Column, replacement: str = P.REDACTED) -> Column:
    """Every kind of secret replaced, one kind after another; null stays null."""
    with_mark = replacement.replace("[", "\\[")

    def step(p: str) -> Callable[[Column], Column]:
        return lambda t: F.when(GUARDS[p](t), F.regexp_replace(t, P.java(p), with_mark)).otherwise(t)

    out = text
    for p in SCRUB:
        out = let(out, step(p))
    return out


def cap(text: Column, n: int, mark: str = "...", inside: bool = True) -> Column:
    """First n characters; a mark of omission, counted in or added."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n - len(mark) if inside else n)), F.lit(mark))).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def decode3(text: Column) -> Column:
    """Up to three passes of percent decoding; a pass that fails changes nothing, '+' stays."""
    passes = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), text, lambda done, _: F.coalesce(F.try_url_decode(F.regexp_replace(done, r"\+", "%2B")), done))
    return F.when(text.contains("%"), passes).otherwise(text)
