"""Detectors of sensitive elements: attribute rules first, content rules where they say nothing.

A detector is a pair of expressions. All detectors of a profile are evaluated in one pass over the elements into one
array of regions, which is exploded: no union of scans, no UDF. At most one region a detector and element.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions.text import contains_any, has_card, matches

ALL_FIELDS = ("text", "placeholder", "label", "alt")


@dataclass(frozen=True)
class Detector:
    name: str
    type: str
    prefix: str
    redaction: str
    attribute: Callable[[], Column]
    content: Callable[[Column], Column] | None = None
    fields: tuple[str, ...] = ALL_FIELDS
    least_length: int = 1
    attribute_confidence: float = 1.0
    content_confidence: float = 0.9


def _any(column: str, words: Sequence[str]) -> Column:
    return contains_any(F.col(column), words)


def _meta() -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("element_id", "label", "placeholder", "autocomplete")]))


def _content(pattern: str) -> Callable[[Column], Column]:
    return lambda c: matches(c, pattern)


def _is(column: str, *values: str) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


DETECTORS: tuple[Detector, ...] = (
    Detector(
        "PasswordDetector", "password", "pwd", "blackout",
        lambda: _is("input_type", "password") | _any("autocomplete", ("password",)) | _any("element_id", P.PASSWORD_ID) | _any("label", P.PASSWORD_LABEL) | _any("placeholder", P.PASSWORD_LABEL),
    ),
    Detector(
        "EmailDetector", "email", "email", "mask",
        lambda: _is("input_type", "email") | _is("autocomplete", "email") | _any("element_id", ("email",)) | _any("label", ("email",)) | _any("placeholder", ("email",)),
        _content(P.EMAIL), content_confidence=0.9,
    ),
    Detector(
        "PhoneDetector", "phone", "phone", "mask",
        lambda: _is("input_type", "tel") | _is("autocomplete", "tel") | _any("element_id", ("phone",)) | _any("label", ("phone",)) | _any("placeholder", ("phone",)),
        _content(P.PHONE), content_confidence=0.85,
    ),
    Detector(
        "IdDetector", "id", "id", "mask",
        lambda: _any("label", P.ID_LABEL) | _any("element_id", P.ID_ID),
        _content(P.NATIONAL_ID_DETECT), attribute_confidence=0.9, content_confidence=0.85,
    ),
    Detector(
        "SemanticDetector", "sensitive", "sem", "mask",
        lambda: _any("label", P.SEMANTIC) | _any("element_id", P.SEMANTIC) | _any("placeholder", P.SEMANTIC) | (_is("input_type", "text") & (_any("label", ("name",)) | _any("element_id", ("name",)) | _any("placeholder", ("name",)))),
        attribute_confidence=0.7,
    ),
    Detector(
        "ApiKeyDetector", "api_key", "apikey", "blackout",
        lambda: contains_any(_meta(), P.API_KEY_FIELD), _content(P.API_KEY_ANY), ("text", "placeholder"), 16, 0.95, 0.85,
    ),
    Detector(
        "CreditCardDetector", "credit_card", "cc", "blackout",
        lambda: contains_any(_meta(), P.CARD_FIELD) | F.coalesce(F.lower("autocomplete").isin(*P.CARD_AUTOCOMPLETE), F.lit(False)), has_card, ("text", "placeholder"), 13, 1.0, 0.95,
    ),
    Detector("SecretDetector", "secret", "secret", "blackout", lambda: F.lit(False), _content(P.SECRET), content_confidence=0.9),
)


def _content_hit(d: Detector) -> Column:
    content = F.lit(False)
    if d.content is not None:
        for f in d.fields:
            content = content | F.when(F.length(F.trim(F.col(f))) >= d.least_length, d.content(F.col(f))).otherwise(F.lit(False))
    return content


def flagged(detectors: Sequence[Detector] = DETECTORS) -> Column:
    """Whether any detector finds an element sensitive: a condition of the element alone, cheap rules first."""
    out = F.lit(False)
    for d in detectors:
        out = out | d.attribute()
    for d in detectors:
        out = out | _content_hit(d)
    return out


def _region(d: Detector, order: int) -> Column:
    content = _content_hit(d)

    def made(source: str, confidence: float) -> Column:
        return F.struct(
            F.lit(order).alias("detector_ord"), F.concat(F.lit(d.prefix + "_"), F.col("element_id")).alias("region_id"), F.lit(d.type).alias("type"),
            F.lit(confidence).alias("confidence"), F.lit(source).alias("source"), F.lit(d.redaction).alias("redaction"), F.lit(d.name).alias("detector"),
        )

    return F.when(d.attribute(), made("dom", d.attribute_confidence)).when(content, made("regex", d.content_confidence))


def detect(elements: DataFrame, keys: Sequence[str] = ("page_id", "element_id"), detectors: Sequence[Detector] = DETECTORS, attributes: bool = True) -> DataFrame:
    """(keys, bbox if there is one, detector_ord, region_id, type, confidence, source, redaction, detector): one row a region.

    Elements lack what they lack: missing attribute columns count as null. attributes=False leaves only content rules.
    """
    rows = elements
    for c in ("element_id", "input_type", "autocomplete", "label", "placeholder", "text", "alt"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    used = detectors if attributes else [Detector(d.name, d.type, d.prefix, d.redaction, lambda: F.lit(False), d.content, d.fields, d.least_length, 1.0, d.content_confidence) for d in detectors]
    found = F.array_compact(F.array(*[_region(d, i) for i, d in enumerate(used)]))
    extra = [c for c in ("bbox",) if c in elements.columns and c not in keys]
    return rows.select(*keys, *extra, F.explode(found).alias("r")).select(*keys, *extra, "r.*")


def as_elements(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as elements: one paragraph each, without attributes."""
    return documents.select(key, F.concat(F.lit("doc-"), F.col(key).cast("string")).alias("element_id"), F.col(text).alias("text"))
