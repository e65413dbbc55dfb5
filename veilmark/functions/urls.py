"""Addresses as expressions: sensitive parameters found and replaced."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions.text import contains_any, decode3, let, matches

#: One alternation, so that a value is searched once as written and once decoded.
VALUE_PATTERN = "|".join(f"(?:{p})" for p in (P.EMAIL, P.URL_PHONE, P.NATIONAL_ID, P.API_KEY, P.CARD_LOOSE))
_MARKS = (P.REDACTED, "%5BREDACTED%5D")


def sensitive_key(key: Column) -> Column:
    return let(F.trim(F.lower(decode3(key))), lambda k: k.isin(*P.URL_PARAM) | contains_any(k, P.URL_PARAM_PART))


def sensitive_value(value: Column) -> Column:
    """Whether a value holds personal data or a key, as written or decoded; a mark of redaction does not."""
    found = matches(value, VALUE_PATTERN) | (value.contains("%") & matches(decode3(value), VALUE_PATTERN))
    return F.when(value.isNull() | (value == "") | value.isin(*_MARKS), False).otherwise(found)


def split_url(url: Column) -> dict[str, Column]:
    """prefix (scheme and host), userinfo, path, query, fragment; relative addresses have an empty prefix."""
    u = F.trim(url)
    get = lambda i: F.regexp_extract(u, r"^((?:https?://)?)(?:([^/?#@]*)@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i)
    absolute = u.rlike("^https?://")
    rel = lambda i: F.regexp_extract(u, r"^([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", i)
    return {
        "prefix": F.when(absolute, F.concat(get(1), get(3))).otherwise(F.lit("")),
        "userinfo": F.when(absolute, get(2)).otherwise(F.lit("")),
        "path": F.when(absolute, get(4)).otherwise(rel(1)),
        "query": F.when(absolute, get(5)).otherwise(rel(2)),
        "fragment": F.when(absolute, get(6)).otherwise(rel(3)),
    }


def _key(pair: Column) -> Column:
    return F.regexp_extract(pair, "^([^=]*)", 1)


def _value(pair: Column) -> Column:
    return F.regexp_extract(pair, "^[^=]*=?(.*)$", 1)


def _pairs(text: Column) -> Column:
    return F.filter(F.split(text, "&"), lambda p: p != "")


def _clean_pairs(text: Column) -> Column:
    """Sensitive parameters once each, at the end, with their value replaced; the others as they were."""

    def marked(pairs: Column) -> Column:
        bad = F.array_distinct(F.transform(F.filter(pairs, lambda p: sensitive_key(_key(p)) | sensitive_value(_value(p))), _key))
        return let(bad, lambda b: F.array_join(F.concat(F.filter(pairs, lambda p: ~F.array_contains(b, _key(p))), F.transform(b, lambda k: F.concat(k, F.lit("=" + P.REDACTED)))), "&"))

    return let(_pairs(text), marked)


def _struct(url: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in split_url(url).items()])


def sanitize(url: Column) -> Column:
    """The address without credentials, personal path segments, sensitive parameters and fragments; '' for null."""

    def clean(p: Column) -> Column:
        path = F.array_join(F.transform(F.split(p["path"], "/"), lambda s: F.when(sensitive_value(s), F.lit(P.REDACTED)).otherwise(s)), "/")
        fragment = F.when(p["fragment"].contains("="), _clean_pairs(p["fragment"])).when(sensitive_value(p["fragment"]), F.lit(P.REDACTED)).otherwise(p["fragment"])
        tail = lambda sign, text: let(text, lambda t: F.when(t != "", F.concat(F.lit(sign), t)).otherwise(F.lit("")))
        return F.concat(p["prefix"], path, tail("?", _clean_pairs(p["query"])), tail("#", fragment))

    return F.when(F.coalesce(F.trim(url), F.lit("")) == "", F.lit("")).otherwise(let(_struct(url), clean))


def is_sensitive(url: Column) -> Column:
    """Whether an address still holds credentials, sensitive parameters or personal data."""

    def leak(text: Column) -> Column:
        return F.exists(_pairs(text), lambda x: ~_value(x).isin(*_MARKS) & ((sensitive_key(_key(x)) & (F.trim(_value(x)) != "")) | sensitive_value(_value(x))))

    def check(p: Column) -> Column:
        path = F.exists(F.split(p["path"], "/"), lambda s: sensitive_value(s))
        fragment = F.when(p["fragment"].contains("="), leak(p["fragment"])).otherwise(sensitive_value(p["fragment"]))
        return (p["userinfo"] != "") | path | leak(p["query"]) | fragment

    return F.coalesce(let(_struct(url), check), F.lit(False))
