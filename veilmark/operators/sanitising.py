"""Sanitised elements, and the gates that refuse what is not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import patterns as P
from veilmark.functions import urls
from veilmark.functions.text import contains_any, luhn, matches, scrub

TEXT_FIELDS = ("text", "label", "placeholder", "alt", "selected_value")
URL_FIELDS = ("href", "src")
MAX_DOM, MAX_REDACTIONS, MAX_SCREENSHOT = 2500, 1500, 20 * 1024 * 1024


def is_password() -> Column:
    return F.coalesce(F.col("input_type") == "password", F.lit(False)) | contains_any(F.col("autocomplete"), ("password",)) | contains_any(F.col("element_id"), (*P.PASSWORD_NAME, "pin"))


def sanitise(elements: DataFrame, regions: DataFrame | None = None, keys: Sequence[str] = ("page_id", "element_id"), flag: Column | None = None) -> DataFrame:
    """elements with personal data replaced: all of a password field, the given fields of a flagged element, else by scrubbing.

    regions: keys of the flagged elements, of whatever origin; flag: a condition of the element itself (`detectors.flagged`),
    which needs no join. Neither flags nothing. Adds treatment: password, region or scrub.
    """
    rows = elements
    if flag is not None:
        rows = rows.withColumn("__flag", flag)
    elif regions is not None:
        flagged = regions.select(*keys).distinct().withColumn("__flag", F.lit(True))
        rows = rows.join(flagged, list(keys), "left")
    else:
        rows = rows.withColumn("__flag", F.lit(None).cast("boolean"))
    rows = rows.withColumn("treatment", F.when(is_password(), "password").when(F.col("__flag"), "region").otherwise("scrub"))
    mark = F.lit(P.REDACTED)
    done = {}
    for f in TEXT_FIELDS:
        if f in elements.columns:
            filled = F.coalesce(F.col(f), F.lit("")) != ""
            # a password's text is replaced even where there is none
            always = F.lit(f in ("text", "selected_value"))
            done[f] = F.when((F.col("treatment") == "password") & (always | filled), mark).when((F.col("treatment") == "region") & filled, mark).when(F.col("treatment") == "scrub", scrub(F.col(f))).otherwise(F.col(f))
    for f in URL_FIELDS:
        if f in elements.columns:
            done[f] = F.when(F.coalesce(F.col(f), F.lit("")) != "", urls.sanitize(F.col(f))).otherwise(F.col(f))
    return rows.withColumns(done).drop("__flag")


def text_codes(value: Column, suffix: str = "") -> Column:
    """Codes of the gate's text rules a value breaks, in the order they are reported."""
    v = F.trim(value)
    rules = (
        ("LEAKED_EMAIL", matches(v, P.EMAIL)),
        ("LEAKED_PHONE", matches(v, P.PHONE)),
        ("LEAKED_NATIONAL_ID" if not suffix else "LEAKED_ID", matches(v, P.NATIONAL_ID)),
        ("LEAKED_API_KEY", matches(v, P.API_KEY)),
        ("LEAKED_CREDIT_CARD", matches(v, P.CARD_LOOSE) | (luhn(v, False) if not suffix else F.lit(False))),
        ("LEAKED_PRIVATE_KEY", matches(v, P.PRIVATE_KEY)),
    )
    codes = F.array_compact(F.array(*[F.when(hit, F.lit(code + suffix)) for code, hit in rules]))
    return F.when(v.isNull() | (v == "") | (v == P.REDACTED), F.array().cast("array<string>")).otherwise(codes)


NO_CODES = "array<string>"


def _field_codes(elements: DataFrame) -> Column:
    """(field_ord, field, codes) of the fields of an element that break a rule, in the order they are checked."""
    fields = [f for f in (*TEXT_FIELDS[:1], "placeholder", "label", "alt", "selected_value", *URL_FIELDS) if f in elements.columns]
    none = F.array().cast(NO_CODES)
    entries = []
    for i, f in enumerate(fields):
        v = F.trim(F.col(f))
        live = v.isNotNull() & (v != "") & (v != P.REDACTED)
        secret = F.when(live & is_password(), F.array(F.lit("LEAKED_PASSWORD"))).otherwise(none)
        link = F.when(urls.is_sensitive(v), F.array(F.lit("SENSITIVE_ATTRIBUTE_URL"))).otherwise(none) if f in URL_FIELDS else none
        entries.append(F.struct(F.lit(i).alias("field_ord"), F.lit(f).alias("field"), F.when(live, F.concat(secret, text_codes(F.col(f)), link)).otherwise(none).alias("codes")))
    return F.filter(F.array(*entries), lambda x: F.size(x["codes"]) > 0)


def element_codes(elements: DataFrame, keys: Sequence[str] = ("page_id", "element_id")) -> DataFrame:
    """(keys, field, codes): the gate's verdict on each field that breaks a rule."""
    return elements.select(*keys, F.explode(_field_codes(elements)).alias("x")).select(*keys, "x.*")


def page_verdicts(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, n_elements, n_violations, first_code, safe): first by element order, field order and rule order. One aggregation."""
    rows = elements.select(page, "ord", _field_codes(elements).alias("c"))
    # the codes are looked at thrice: bound once, as the size of the array tells whether they are needed at all
    first = F.element_at(F.get("c", 0)["codes"], 1)
    n = F.aggregate("c", F.lit(0), lambda t, x: t + F.size(x["codes"]))
    found = rows.groupBy(page).agg(
        F.count(F.lit(1)).alias("n_elements"), F.sum(n).cast("long").alias("n_violations"), F.min(F.when(F.size("c") > 0, F.struct("ord", first.alias("code")))).alias("f")
    )
    return found.select(page, "n_elements", "n_violations", F.col("f.code").alias("first_code"), F.col("f").isNull().alias("safe"))


TREATMENTS = ("blackout", "mask", "blur")


def _request_element_codes(requests: DataFrame, e: Column) -> Column:
    """Codes of one entry of dom, field by field."""
    fields = {f.name for f in requests.schema["dom"].dataType.elementType.fields}
    get = lambda f: e[f] if f in fields else F.lit(None).cast("string")
    secret = F.coalesce(get("input_type") == "password", F.lit(False)) | contains_any(get("autocomplete"), ("password",)) | contains_any(get("element_id"), (*P.PASSWORD_NAME, "pin"))
    none = F.array().cast(NO_CODES)
    out = []
    for f in ("text", "placeholder", "label", "alt", "selected_value", *URL_FIELDS):
        if f in fields:
            v = F.trim(e[f])
            live = v.isNotNull() & (v != "") & (v != P.REDACTED)
            link = F.when(urls.is_sensitive(v), F.array(F.lit("SENSITIVE_ATTRIBUTE_URL"))).otherwise(none) if f in URL_FIELDS else none
            out.append(F.when(live, F.concat(F.when(secret, F.array(F.lit("LEAKED_PASSWORD"))).otherwise(none), text_codes(e[f]), link)).otherwise(none))
    return F.concat(*out)


def request_codes(requests: DataFrame) -> DataFrame:
    """(request_id, codes): every rule of the gate a request breaks, in the order they are checked; repeated ones stay.

    Brand, screenshot, privacy metadata and stages, addresses, elements in order and their fields in order, semantic
    tree, redaction records. The columns `brand`, `screenshot_brand` and `screenshot_bytes` are checked where there are
    such columns. A missing privacy record refuses; a missing flag in it does not. Nothing is exploded.
    """
    have = set(requests.columns)
    code = lambda hit, name: F.when(F.coalesce(hit, F.lit(False)), F.lit(name))
    head = []
    if "brand" in have:
        head += [code(F.col("brand") == "RawContext", "RAW_CONTEXT_DETECTED"), code((F.col("brand").isNull()) | ~F.col("brand").isin("RawContext", "SanitizedContext"), "MISSING_BRAND")]
    if "screenshot_bytes" in have:
        head += [code(F.col("screenshot_bytes").isNull(), "MISSING_SCREENSHOT"), code(F.col("screenshot_bytes") == 0, "EMPTY_SCREENSHOT")]
    if "screenshot_brand" in have:
        head.append(code(F.col("screenshot_brand") == "RawScreenshot", "RAW_SCREENSHOT_DETECTED"))
    no = lambda *cs: code(F.array_contains(F.array(*[F.coalesce(F.col(f"privacy.{c}"), F.lit(True)) for c in cs]), False), "")
    head += [
        code(F.col("privacy").isNull(), "MISSING_PRIVACY_METADATA"),
        F.when(no("raw_data_removed", "sanitized").isNotNull(), "INCOMPLETE_SANITIZATION"),
        F.when(no("dom_sanitized", "screenshot_sanitized", "url_sanitized").isNotNull(), "STAGE_VERIFICATION_FAILED"),
        code(urls.is_sensitive(F.col("page_url")), "SENSITIVE_URL_PARAM"), code(urls.is_sensitive(F.col("page_state.url")), "SENSITIVE_URL_PARAM"),
    ]
    none = F.array().cast(NO_CODES)
    dom = F.coalesce(F.flatten(F.transform(F.filter("dom", lambda e: e.isNotNull()), lambda e: _request_element_codes(requests, e))), none)
    tree = F.concat(text_codes(F.col("semantic_tree"), "_SEMANTIC"), F.when(matches(F.col("semantic_tree"), P.SERVER_URL_PARAM), F.array(F.lit("SENSITIVE_URL_SEMANTIC"))).otherwise(none))

    def redaction(r: Column) -> Column:
        bad = code(~F.coalesce(r["treatment"], F.lit("")).isin(*TREATMENTS), "INVALID_REDACTION_TREATMENT")
        size = lambda side: F.coalesce(r["bbox"][side], F.lit(0.0))
        return F.array_compact(F.array(bad, code(r["bbox"].isNull() | (size("width") <= 0) | (size("height") <= 0), "INVALID_REDACTION_BBOX")))

    records = F.coalesce(F.flatten(F.transform(F.filter("redactions", lambda r: r.isNotNull()), redaction)), none)
    return requests.select("request_id", F.concat(F.array_compact(F.array(*head)), dom, tree, records).alias("codes"))


SERVER_RULES = (("Email", P.SERVER_EMAIL), ("Phone number", P.SERVER_PHONE), ("API key", P.API_KEY), ("Credit card", P.CARD_LOOSE), ("Private key", P.PRIVATE_KEY), ("National ID", P.SERVER_NATIONAL_ID))


def _first_rule(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in reversed(SERVER_RULES):
        out = F.when(matches(value, p), F.lit(name)).otherwise(out)
    return F.when(F.coalesce(F.trim(value), F.lit("")).isin("", P.REDACTED), None).otherwise(out)


def request_verdicts(requests: DataFrame, strict: bool = True) -> DataFrame:
    """(request_id, reason): the first reason to refuse a request, null where there is none.

    Caps first, then the privacy flags (missing ones refuse when strict), the page address, the semantic tree, then
    the elements in order and their fields in order. Evaluated within the record: no element is exploded. Fields that
    the elements of this table lack, and a table without `screenshot_bytes`, break no rule.
    """
    fields = {f.name for f in requests.schema["dom"].dataType.elementType.fields}

    def element(e: Column) -> Column:
        checks = [(f, _first_rule(F.trim(e[f]))) for f in ("text", "label", "placeholder", "alt", "selected_value") if f in fields]
        password = F.when((e["input_type"] == "password") & ~F.coalesce(F.trim(e["text"]), F.lit("")).isin("", P.REDACTED), F.lit("Password value in element"))
        links = [F.when(matches(e[f], P.SERVER_URL_PARAM), F.lit(f"Sensitive URL parameters in element ({f})")) for f in URL_FIELDS if f in fields]
        return F.coalesce(*[F.when(c.isNotNull(), F.concat(c, F.lit(f" in element ({f})"))) for f, c in checks], password, *links)

    reasons = F.filter(F.transform(F.coalesce("dom", F.array().cast(requests.schema["dom"].dataType)), element), lambda r: r.isNotNull())
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    flag = lambda c: F.coalesce(F.col(f"privacy.{c}"), F.lit(not strict))
    tree = F.coalesce("semantic_tree", F.lit(""))
    in_tree = _first_rule(tree)
    return requests.select(
        "request_id",
        F.when(size("dom") > MAX_DOM, "Too many elements")
        .when(size("redactions") > MAX_REDACTIONS, "Too many redactions")
        .when(F.col("screenshot_bytes") > MAX_SCREENSHOT if "screenshot_bytes" in requests.columns else F.lit(False), "Screenshot too large")
        .when(~flag("sanitized") | ~flag("raw_data_removed"), "Not sanitized")
        .when(matches(F.col("page_url"), P.SERVER_URL_PARAM), "Sensitive URL parameters in page_url")
        .when(in_tree.isNotNull(), F.concat(in_tree, F.lit(" in semantic_tree")))
        .when(matches(tree, P.SERVER_URL_PARAM), "Sensitive URL parameters in semantic_tree")
        .otherwise(F.get(reasons, 0))
        .alias("reason"),
    )


def write_safe(elements: DataFrame, path: str, quarantine: str | None = None, page: str = "page_id") -> None:
    """The guarded sink: pages without a violation to path, the others (if wanted) to quarantine."""
    verdicts = page_verdicts(elements, page).select(page, "safe")
    judged = elements.join(verdicts, page)
    judged.filter("safe").drop("safe").write.mode("overwrite").parquet(path)
    if quarantine:
        judged.filter("NOT safe").drop("safe").write.mode("overwrite").parquet(quarantine)
