"""Personal data in free text: found, and replaced by typed placeholders.

The protected entities are e-mail addresses, phone numbers, document numbers, street addresses and persons' names.
Every span that may be one is a term, and the corpus tells how strongly the term reveals the entity. Numbers are
generalised to terms by their shape (`+99 99 99999 999`), addresses by the word of the street, e-mails by their joint,
names by the given and the family name. A term's disclosure of a class c is the pointwise mutual information

    bits(t, c) = log2( P(c | t) / P(c) ),

where c is seen wherever an independent word names it: the element's label, input type or completion hint, or the words
right before the span ("Tel.", "passport no."), for names also the local part of an e-mail address and a title. P(c | t)
is estimated from the distinct values: for shapes with the share of the whole form as prior, so that a rare shape is
judged by its form and a frequent one by itself; for names by the lower bound of its confidence interval. A term is
generalised to [TYPE] where it reveals at least the share `least` of the information the class itself carries,
-log2 P(c), or `threshold` bits for names. An exact check follows: a name needs its family name. Numbers of no known
form are terms as well: they are what shapes are told from, and are found where the corpus shows what they are.

Each distinct value is read once (`read`, one pass in Arrow batches over its consistent form); all that is kept are
its spans, and words counted within a task. Spans are placed in the value as it was delivered: what is not personal
stays as it is, in any script.

Defined cases: null and empty values hold nothing; each type is reported once a value; an element delivered twice is
reported once; a value without findings comes back exactly as it was; where no place in the delivered value
corresponds to a span of the consistent form (reordered marks), the consistent form is redacted instead; texts are
processed whole; an empty table gives an empty result; columns named like the ones added are overwritten only in the
operator's own output.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.llm import pii_patterns as P
from veilmark.llm.normalise import aligned
from veilmark.session import cut

FIELDS = ("text", "label", "placeholder", "alt")
TYPES = ("email", "phone", "id", "address", "name")
#: Words that name a protected entity, the more telling class first (fixed values).
HINTS = (
    ("email", r"e-?mails?|mailto|correo|courriel|adresse électronique"),
    ("phone", r"(?:tele)?phone|tel|telefon|teléfono|téléphone|mobile|handy|fax"),
    ("id", r"identity|identidad|identité|ausweis\w*|passport|reisepass|pasaporte|passeport|ssn|social security|national id|id card|insurance number|tax card|dni"),
    ("address", r"street address|postal address|address-line\d|dirección postal|adresse postale|straße und hausnummer|street-address"),
    ("name", r"full name|given-name|family-name|nombre completo|nom complet|vollständiger name"),
)
HINT = tuple((c, regex.compile(rf"(?i)(?<!\p{{L}})(?:{w})(?!\p{{L}})")) for c, w in HINTS)
NEAR = 32
WORDS = re.compile(r"[^\W\d_](?:[^\W\d_]|['’])*")
#: Cheap conditions that the patterns behind them need: two words as of a name, a digit, a number of some length.
CAPITALS = re.compile(r"[^\Wa-z\d_][\w’'\-]*[.,]? (?:[^\Wa-z\d_]|(?:van|von|de|del|della|di|da|dos|la|le|el|al|bin|ter|ten|zu) )")
DIGIT, LONG = re.compile(r"\d"), re.compile(r"\d[\d .\-/()A-Z]{3,}\d|[A-Z]{5}\d{4}")
FORMS = (("phone", regex.compile(P.PHONE)), ("id", regex.compile(P.ID)), ("address", regex.compile(P.ADDRESS)))
EMAIL = regex.compile(P.EMAIL)
AT = re.compile(r"(?i)@|[\[(]\s?at\s?[\])]")
#: Any other group of digits, with capitals and separators between.
NUMBER = regex.compile(r"(?<![0-9A-Za-z])[+(]?(?=[0-9A-Z .\-/()]*[0-9]{2})[0-9A-Z]+(?:[ .\-/()]{1,2}[0-9A-Z]+)*(?![0-9A-Za-z])")
EXTENSION = regex.compile(r",?\s?(?:x|ext\.?|extension|Durchwahl|poste)\s?[0-9]{1,5}$")
TITLED, DIRECT, INVERTED = regex.compile(P.TITLED), regex.compile(P.DIRECT), regex.compile(P.INVERTED)
LAST = regex.compile(r"([\p{L}’'\-]+)$")
LOCAL = regex.compile(r"^(?:mailto:)?([^@\[(]+)", regex.I)
PIECE = regex.compile(r"\p{L}{3,}")
FILLER = "\0"


def shape(number: str) -> str:
    """A number as a term: digits and capitals are alike, an extension says nothing."""
    return "".join("9" if c.isdigit() else "A" if c.isupper() else c for c in EXTENSION.sub("", number))


def street(address: str) -> str:
    """An address as a term: its words without numbers, the generic one told by how often it is met."""
    words = [w.lower() for w in regex.findall(r"\p{L}{2,}\.?", address)]
    first, last = words[0], words[-1]
    for end in ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ufer", "damm"):
        if last.endswith(end):
            return end
    return first if regex.fullmatch(P.STREET_FIRST, first) else last


def hint_of(text: str) -> str | None:
    """The protected entity that a text names."""
    return next((c for c, p in HINT if p.search(text)), None)


def spans(t: str, hint: str | None = None) -> tuple[list[tuple], str]:
    """(form, start, end, term, second, hint) of the spans of a consistent value that may be personal data, and the value without the formal ones.

    form: email, phone, id, address; number for digits of no such form; titled and pair for names, whose term is the
    given name (of titled ones: the family name) and second the family name.
    """
    out = []

    def named(start: int) -> str | None:
        return hint_of(t[max(0, start - NEAR) : start]) or hint

    if AT.search(t):
        for m in EMAIL.finditer(t):
            out.append(("email", m.start(), m.end(), "@" if "@" in m.group() else "(at)", LOCAL.match(m.group()).group(1).lower(), named(m.start())))
        t = EMAIL.sub(lambda m: FILLER * len(m.group()), t)
    if DIGIT.search(t):
        number = LONG.search(t) is not None
        for form, p in FORMS if number else FORMS[2:]:
            found = list(p.finditer(t))
            for m in found:
                out.append((form, m.start(), m.end(), street(m.group()) if form == "address" else shape(m.group()), None, named(m.start())))
            if found:
                t = p.sub(lambda m: FILLER * len(m.group()), t)
        for m in NUMBER.finditer(t) if number else ():
            if sum(c.isdigit() for c in m.group()) >= 5:
                out.append(("number", m.start(), m.end(), shape(m.group()), None, named(m.start())))
    if CAPITALS.search(t):
        for m in TITLED.finditer(t):
            out.append(("titled", m.start(), m.end(), LAST.search(m.group()).group().lower(), None, "name"))
        for p, given, family in ((DIRECT, 2, 3), (INVERTED, 3, 2)):
            for m in p.finditer(t):
                # a field for names that holds nothing else
                whole = hint == "name" and m.end(1) - m.start(1) == len(t)
                out.append(("pair", m.start(1), m.end(1), m.group(given).lower(), m.group(family).lower(), hint if whole else None))
    return out, t


READ = "kind string, v1 long, v2 long, form string, start int, stop int, term string, second string, hint string, plain string, n long, n_cap long"


def hashes(value: Column) -> list[Column]:
    """128 bits that stand for a value in joins."""
    return [F.xxhash64(value).alias("v1"), F.xxhash64(value, F.lit(11)).alias("v2")]


def element_hint() -> Column:
    """The protected entity that an element's type, completion hint or label names."""
    kind, about = F.lower(F.coalesce("input_type", F.lit(""))), F.lower(F.concat_ws(" ", "autocomplete", "label"))
    out = F.lit(None).cast("string")
    for c, words in reversed(HINTS):
        out = F.when(about.rlike(rf"(?<!\p{{L}})(?:{words})(?!\p{{L}})"), c).otherwise(out)
    out = F.when(kind == "email", "email").when(kind == "tel", "phone").otherwise(out)
    return F.when((about == "") & ~kind.isin("email", "tel"), None).otherwise(out)


def values(elements: DataFrame, keys: Sequence[str], fields: Sequence[str] = FIELDS) -> DataFrame:
    """(keys, field, value, hint): the non-empty values with a letter or digit."""
    for c in ("input_type", "autocomplete", "label"):
        if c not in elements.columns:
            elements = elements.withColumn(c, F.lit(None).cast("string"))
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").alias("value")) for f in fields])
    rows = elements.select(*keys, element_hint().alias("hint"), F.explode(F.filter(entries, lambda x: x["value"].rlike(r"\p{L}|[0-9]"))).alias("x"))
    # a label names what the element holds, not what it says itself
    return rows.select(*keys, "x.field", "x.value", F.when(F.col("x.field") != "label", F.col("hint")).alias("hint"))


def read(rows: DataFrame) -> DataFrame:
    """One pass over distinct (value, hint): a row a span, and the words of a task with how often they are met, and capitalised."""
    names = [c.split()[0] for c in READ.split(", ")]

    def flow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()

        def counted() -> pd.DataFrame:
            total: Counter = Counter()
            capital: Counter = Counter()
            for w, n in words.items():
                total[w.lower()] += n
                if w[0].isupper():
                    capital[w.lower()] += n
            words.clear()
            return pd.DataFrame([("word", None, None, None, None, None, w, None, None, None, n, capital[w]) for w, n in total.items()], columns=names, dtype=object)

        for batch in batches:
            found = []
            for value, hint, v1, v2 in zip(batch["value"], batch["hint"], batch["v1"].tolist(), batch["v2"].tolist(), strict=True):
                t, at = aligned(value)
                some, rest = spans(t, hint)
                words.update(WORDS.findall(rest))
                if some:
                    plain = t if at is None and t != value else None
                    for form, start, stop, term, second, named in some:
                        if at is not None:
                            start, stop = at[start], at[stop]
                        found.append(("span", v1, v2, form, start, stop, term, second, named, plain, None, None))
            yield pd.DataFrame(found, columns=names, dtype=object)
            if len(words) > 200_000:
                yield counted()
        yield counted()

    distinct = rows.select("value", "hint").distinct().select("value", "hint", *hashes(F.col("value")))
    return distinct.mapInPandas(flow, READ)


def form_disclosure(found: DataFrame, weight: float = 8.0) -> DataFrame:
    """(form, term, type, n, k, bits, share): what the shapes and words of formal spans reveal. share: of the class's own information.

    weight: so many sightings the share of the whole form counts for, and so many the form itself where nothing is
    known: half of them with its class named, as good as none for numbers of no known form.
    """
    s = found.filter("kind = 'span' AND form IN ('email', 'phone', 'id', 'address', 'number')").select("form", "term", "hint")
    classes = ("email", "phone", "id", "address")
    terms = s.groupBy("form", "term").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("hint") == c).alias(c) for c in classes])
    forms = terms.groupBy("form").agg(F.sum("n").alias("form_n"), *[F.sum(c).alias(f"form_{c}") for c in classes])
    every = terms.agg(F.struct(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in classes])).scalar()
    rows = terms.join(forms, "form").select("*", every.alias("every"))

    def reveals(c: str) -> Column:
        whole = (F.col(f"every.{c}") + weight / 2) / (F.col("every.n") + weight * (len(classes) + 1))
        prior = (F.col(f"form_{c}") + weight * F.when(F.col("form") == "number", 0.02).otherwise(0.5)) / (F.col("form_n") + weight)
        p = (F.col(c) + weight * prior) / (F.col("n") + weight)
        bits = F.log2(p / whole)
        return F.struct((bits / -F.log2(whole)).alias("share"), bits.alias("bits"), F.lit(c).alias("type"), F.col(c).alias("k"))

    own = F.array(*[F.when(F.col("form") == c, reveals(c)) for c in classes])
    # a number of no known form is a phone or document number, whichever its shape reveals more
    any_of = F.when(F.col("form") == "number", F.array(reveals("phone"), reveals("id"))).otherwise(own)
    rows = rows.withColumn("r", F.array_max(F.array_compact(any_of)))
    return rows.select("form", "term", "n", "r.type", "r.k", "r.bits", "r.share")


def name_disclosure(found: DataFrame, z: float = 1.0) -> DataFrame:
    """(term, n, k, bits): what words reveal about an identity, for the words met with one. Mostly lower-case words are no names."""
    words = found.filter("kind = 'word'").groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_cap").alias("n_cap"))
    s = found.filter("kind = 'span'")
    pieces = s.filter("form = 'email'").select(F.explode(F.regexp_extract_all("second", F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("term"))
    fields = s.filter("form = 'pair' AND hint = 'name'").select(F.explode(F.array("term", "second")).alias("term"))
    seen = pieces.unionByName(s.filter("form = 'titled'").select("term")).unionByName(fields).groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    base = seen.agg(F.sum("k")).scalar() / words.agg(F.sum("n")).scalar()
    # a sighting in an address is one more occurrence
    n = F.greatest(F.col("n"), F.col("k")).cast("double")
    p = F.col("k") / n
    low = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return seen.join(words, "term").filter("n_cap >= 0.9 * n").select("term", "n", "k", F.log2(low / base).alias("bits"))


def disclosed(elements: DataFrame, keys: Sequence[str] = ("page_id", "element_id"), fields: Sequence[str] = FIELDS, threshold: float = 3.0, least: float = 0.2) -> DataFrame:
    """(v1, v2, start, stop, type, plain): the spans of values whose terms exceed the disclosure thresholds, each once a value.

    What was read of the values is written to the checkpoint folder: the terms are counted over it, then it is filtered.
    """
    found = cut(read(values(elements, keys, fields)))
    s = found.filter("kind = 'span'").select("v1", "v2", "form", "start", "stop", "term", "second", "plain")
    formal = s.join(form_disclosure(found).filter(F.col("share") >= least).select("form", "term", "type"), ["form", "term"])
    known = name_disclosure(found).filter(F.col("bits") >= threshold).select("term")
    pairs = s.filter("form = 'pair'").join(known, "term", "left_semi")
    # a title is evidence enough for the family name behind it
    names = pairs.unionByName(s.filter("form = 'titled'").select(pairs.columns)).withColumn("type", F.lit("name"))
    columns = ["v1", "v2", "start", "stop", "type", "plain"]
    return formal.select(columns).unionByName(names.select(columns)).distinct()


def may_hold(value: Column) -> Column:
    """Values that can hold a span: a digit, a sign for "at", a letter that may be disguised, or two capitals in a row."""
    some = value.rlike(r"[0-9@\x{80}-\x{10ffff}]|[\[(]\s?(?i:at)\s?[\])]|\p{Lu}[^ ]* (?:\p{Ll}{2,3} ){0,2}\p{Lu}")
    return F.when(some, True).otherwise(F.length(value) != F.length(F.trim(F.regexp_replace(value, r"\s+", " "))))


def _holding(elements: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    rows = values(elements, keys, fields)
    return rows.filter(may_hold(F.col("value"))).select(*keys, "field", "value", *hashes(F.col("value")))


def findings(elements: DataFrame, keys: Sequence[str] = ("page_id", "element_id"), fields: Sequence[str] = FIELDS, threshold: float = 3.0, least: float = 0.2) -> DataFrame:
    """(keys, field, pii_type), each once."""
    types = disclosed(elements, keys, fields, threshold, least).select("v1", "v2", F.col("type").alias("pii_type")).distinct()
    rows = _holding(elements, keys, fields).drop("value")
    return rows.join(types, ["v1", "v2"]).select(*keys, "field", "pii_type").distinct()


def redacted(elements: DataFrame, keys: Sequence[str] = ("page_id", "element_id"), fields: Sequence[str] = FIELDS, threshold: float = 3.0, least: float = 0.2) -> DataFrame:
    """(keys, field, value, redacted) of the values that hold personal data, each element and field once."""
    # bounded by one value's own characters
    at = disclosed(elements, keys, fields, threshold, least).groupBy("v1", "v2").agg(F.array_sort(F.collect_list(F.struct("start", F.negate("stop").alias("before"), "type"))).alias("spans"), F.max("plain").alias("plain"))
    rows = _holding(elements, keys, fields).join(at, ["v1", "v2"]).dropDuplicates([*keys, "field"])
    text = F.coalesce("plain", "value")
    nothing = F.struct(F.lit("").alias("done"), F.lit(0).alias("to"))

    def step(so_far: Column, s: Column) -> Column:
        stop, start = F.negate(s["before"]), s["start"]
        mark = F.concat(so_far["done"], F.substring(text, so_far["to"] + 1, start - so_far["to"]), F.lit("["), F.upper(s["type"]), F.lit("]"))
        # a span within one already replaced says nothing more
        return F.struct(F.when(start >= so_far["to"], mark).otherwise(so_far["done"]).alias("done"), F.greatest(stop, so_far["to"]).alias("to"))

    out = F.aggregate("spans", nothing, step, lambda x: F.concat(x["done"], F.substring(text, x["to"] + 1, F.length(text))))
    return rows.select(*keys, "field", "value", out.alias("redacted"))
