"""Pieces of DuckDB SQL shared by the oracle strings."""

from __future__ import annotations

from collections.abc import Iterable

from veilmark.functions import patterns as P

ELEMENTS = "(SELECT DISTINCT ON (page_id, element_id) * FROM elements)"
PAGES = "(SELECT DISTINCT ON (page_id) * FROM pages)"
REQUESTS = "(SELECT DISTINCT ON (request_id) * FROM agent_requests)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def match(column: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({column}, {quote(pattern)}), false)"


def any_of(column: str, words: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({column}, '')), {quote(w)})" for w in words) + ")"


def luhn(text: str, repeats: bool = True) -> str:
    d = f"regexp_replace({text}, '[^0-9]', '', 'g')"
    digit = f"CAST(substr(reverse({d}), CAST(i AS INTEGER), 1) AS INTEGER)"
    total = f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} ELSE ({digit} * 2) % 10 + {digit} // 5 END))"
    same = " OR ".join(f"replace({d}, '{n}', '') = ''" for n in range(10))
    return f"coalesce(length({d}) BETWEEN 13 AND 19 AND {total} % 10 = 0" + (f" AND NOT ({same})" if repeats else "") + ", false)"


def card(column: str) -> str:
    found = " OR ".join(f"len(list_filter(regexp_extract_all({column}, {quote(p)}), lambda m: {luhn('m')})) > 0" for p in P.CARD_BRANDS)
    return f"coalesce({found}, false)"


def scrub(column: str) -> str:
    out = column
    for p in (P.EMAIL, P.PHONE, P.NATIONAL_ID, P.CARD_SPACED, P.API_KEY, P.PRIVATE_KEY_BLOCK):
        out = f"regexp_replace({out}, {quote(p)}, '[REDACTED]', 'g')"
    return out
