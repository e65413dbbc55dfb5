"""Schemas that drift between files: one steady table and a log of the changes.

An alias table lists, for each steady field, the keys and places it has been seen under. From it come both the
inventory (per file: which key, which JSON type) and the casts of the steady table. The inventory of each
producer's files, in order, is cut into lifespans with lag and islands; the changes are the starts and endings
of those lifespans.

Defined cases: a null or unparsable payload holds no field; a key whose value is null, or a record without the key,
says nothing about the file as long as another record has a value; an empty table gives no rows; identical
deliveries change nothing, as the inventory is a set; a producer's first file starts lifespans but is no change;
files of one producer need not be numbered without gaps; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steady field -> (array the field lies in or None, its keys and places, steady type).
ALIASES: dict[str, tuple[str | None, tuple[str, ...], str]] = {
    "scroll_y": (None, tuple(f"pageState.{k}" for k in ("scroll_y", "scrollY", "scrollTop", "scroll-y", "pageYOffset", "scroll_position.y")), "double"),
    "viewport_width": (None, tuple(f"pageState.{k}" for k in ("viewport_width", "viewportWidth", "vpWidth", "innerWidth", "viewport_size.width")), "int"),
    "element_id": ("elements", ("element_id", "elementId", "el_id", "id", "nodeId"), "string"),
    "input_type": ("elements", ("input_type", "inputType", "input-type", "type", "fieldType"), "string"),
}


def _path(key: str) -> str:
    return "$" + "".join(f"['{k}']" for k in key.split("."))


def json_type(value: Column) -> Column:
    """JSON type of a variant: number, string, boolean, array, object; null for a JSON null or nothing."""
    t = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (t == "VOID"), None)
        .when(t.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
        .otherwise(F.lower(t))
    )


def _seen(at: Column, field: str, keys: Sequence[str]) -> list[Column]:
    out = []
    for k in keys:
        kind = json_type(F.try_variant_get(at, _path(k), "variant"))
        out.append(F.when(kind.isNotNull(), F.struct(F.lit(field).alias("field"), F.lit(k).alias("key"), kind.alias("type"))))
    return out


def _entry_seen(fields: Mapping):
    return lambda e: F.array(*[x for f, keys in fields.items() for x in _seen(e, f, keys)])


def inventory(df: DataFrame, aliases: Mapping = ALIASES, producer: str = "producer_id", seq: str = "file_seq", payload: str = "payload") -> DataFrame:
    """(producer, seq, field, key, type) of every file, each once; a file without fields has one row with nulls."""
    v = F.try_parse_json(F.col(payload))
    flat = [x for f, (inside, keys, _) in aliases.items() if inside is None for x in _seen(F.col("__v"), f, keys)]
    per_array: dict[str, dict] = {}
    for f, (inside, keys, _) in aliases.items():
        if inside is not None:
            per_array.setdefault(inside, {})[f] = keys
    parts = [F.array(*flat)] if flat else []
    for inside, fields in per_array.items():
        entries = F.try_variant_get(F.col("__v"), _path(inside), "array<variant>")
        parts.append(F.flatten(F.transform(entries, _entry_seen(fields))))
    empty = F.array().cast("array<struct<field:string,key:string,type:string>>")
    seen = F.array_distinct(F.array_compact(F.concat(*[F.coalesce(p, empty) for p in parts])))
    rows = df.select(F.col(producer).alias("producer_id"), F.col(seq).alias("file_seq"), v.alias("__v"))
    rows = rows.select("producer_id", "file_seq", F.explode_outer(seen).alias("s")).select("producer_id", "file_seq", "s.*")
    return rows.groupBy("producer_id", "file_seq", "field", "key", "type").agg(F.count(F.lit(1)).alias("n_records"))


def states(found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a file and field, absent ones too: its keys and types, those of the producer's preceding file, and the island."""
    names = F.array(*[F.lit(f) for f in fields])
    per_file = found.groupBy("producer_id", "file_seq").agg(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "key", "type"))).alias("s"))
    # at most (fields x keys x types) entries a file, whatever its number of records
    of = lambda x, f: F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda e: e["field"] == f), lambda e: e[x])))
    rows = per_file.select("producer_id", "file_seq", F.explode(F.transform(names, lambda f: F.struct(f.alias("field"), of("key", f).alias("keys"), of("type", f).alias("types")))).alias("x"))
    w = Window.partitionBy("producer_id", "field").orderBy("file_seq")
    rows = rows.select("producer_id", "file_seq", "x.*").select("*", F.lag("keys").over(w).alias("prev_keys"), F.lag("types").over(w).alias("prev_types"), F.lag("file_seq").over(w).alias("prev_seq"))
    starts = F.col("prev_seq").isNull() | (F.col("keys") != F.col("prev_keys")) | (F.col("types") != F.col("prev_types"))
    return rows.withColumn("starts", starts).withColumn("island", F.sum(F.col("starts").cast("int")).over(w))


def lifespans(df: DataFrame, aliases: Mapping = ALIASES, **names: str) -> DataFrame:
    """One row a producer, field and unbroken span of files with the same keys and types; absent spans have empty keys."""
    rows = states(inventory(df, aliases, **names), list(aliases))
    return rows.groupBy("producer_id", "field", "island").agg(
        F.min_by("keys", "file_seq").alias("keys"), F.min_by("types", "file_seq").alias("types"), F.min("file_seq").alias("first_seq"), F.max("file_seq").alias("last_seq"), F.count(F.lit(1)).alias("n_files")
    )


def changes(df: DataFrame, aliases: Mapping = ALIASES, **names: str) -> DataFrame:
    """(producer_id, file_seq, field, change, old and new keys and types): the starts and endings of lifespans."""
    rows = states(inventory(df, aliases, **names), list(aliases)).filter(F.col("starts") & F.col("prev_seq").isNotNull())
    now, before = F.size("keys") > 0, F.size("prev_keys") > 0
    kinds = F.array_compact(
        F.array(
            F.when(now & ~before, F.lit("added")),
            F.when(before & ~now, F.lit("removed")),
            F.when(now & before & (F.col("keys") != F.col("prev_keys")), F.lit("renamed")),
            F.when(now & before & (F.col("types") != F.col("prev_types")), F.lit("retyped")),
        )
    )
    return rows.select("producer_id", "file_seq", "field", F.explode(kinds).alias("change"), "prev_keys", "keys", "prev_types", "types")


#: A whole number or decimal, with an exponent, grouped thousands or a unit of length behind it.
NUMBER = r"^[+-]?(?:[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]*)?|[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?(?:\s?(?:px|pt|em|rem|%))?$"


def text_of(at: Column, keys: Sequence[str]) -> Column:
    """The value of the first key that holds one as text, out of a one-element list where need be."""
    texts = []
    for k in keys:
        value = F.try_variant_get(at, _path(k), "variant")
        texts.append(F.coalesce(F.try_variant_get(at, _path(k) + "[0]", "string"), F.try_variant_get(value, "$", "string")))
    return F.coalesce(*texts)


def cast_text(text: Column, target: str) -> Column:
    """A text as the steady type; null unless the whole of it is such a value. A fraction is no whole number."""
    if target == "string":
        return text
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(NUMBER), F.regexp_replace(F.regexp_replace(trimmed, ",", ""), r"[^0-9]*$", "").try_cast("double"))
    if target in ("int", "bigint"):
        return F.when(number == F.floor(number), number.try_cast(target))
    return number.try_cast(target)


def cast_of(at: Column, keys: Sequence[str], target: str) -> Column:
    """The steady value of a field."""
    return cast_text(text_of(at, keys), target)


def _entries(df: DataFrame, aliases: Mapping, keep: Sequence[str], payload: str) -> DataFrame:
    """(keep, array, entry_ord, __v, __e): one row a record and entry of each array that fields lie in; array is null and __e missing for a record without any."""
    arrays = list(dict.fromkeys(a for a, _, _ in aliases.values() if a))
    rows = df.select(*keep, F.try_parse_json(F.col(payload)).alias("__v"))
    if not arrays:
        return rows.select(*keep, F.lit(None).cast("string").alias("array"), F.lit(None).cast("int").alias("entry_ord"), "__v", F.lit(None).cast("variant").alias("__e"))
    kind = "array<struct<array:string,entry_ord:int,e:variant>>"

    def entry(array: str):
        return lambda e, i: F.struct(F.lit(array).alias("array"), i.cast("int").alias("entry_ord"), e.alias("e"))

    each = [F.coalesce(F.transform(F.try_variant_get(F.col("__v"), _path(a), "array<variant>"), entry(a)), F.array().cast(kind)) for a in arrays]
    return rows.select(*keep, "__v", F.explode_outer(F.concat(*each)).alias("x")).select(*keep, "x.array", "x.entry_ord", "__v", F.col("x.e").alias("__e"))


RECORD = ("producer_id", "file_seq", "record_no", "received_at")


def steady(df: DataFrame, aliases: Mapping = ALIASES, keep: Sequence[str] = RECORD, payload: str = "payload") -> DataFrame:
    """All records under steady columns: record fields, and one row for each entry of each array that other fields lie in.

    With several arrays a row has the fields of its own, told by the column `array`.
    """
    several = len({a for a, _, _ in aliases.values() if a}) > 1
    rows = _entries(df, aliases, keep, payload)
    flat = [cast_of(F.col("__v"), keys, t).alias(f) for f, (a, keys, t) in aliases.items() if a is None]
    if not any(a for a, _, _ in aliases.values()):
        return rows.select(*keep, *flat)
    inner = [(F.when(F.col("array") == a, cast_of(F.col("__e"), keys, t)) if several else cast_of(F.col("__e"), keys, t)).alias(f) for f, (a, keys, t) in aliases.items() if a]
    return rows.select(*keep, *(["array"] if several else []), *flat, "entry_ord", *inner)


def unread(df: DataFrame, aliases: Mapping = ALIASES, keep: Sequence[str] = ("producer_id", "file_seq"), payload: str = "payload") -> DataFrame:
    """(keep, field, n, example): values of a file that are there but are no value of the steady type, so that the steady table has null."""
    rows = _entries(df, aliases, keep, payload)
    found = []
    for f, (inside, keys, target) in aliases.items():
        text = text_of(F.col("__e" if inside else "__v"), keys)
        here = (F.col("array") == inside) if inside else (F.coalesce("entry_ord", F.lit(0)) == 0)
        found.append(F.when(here & text.isNotNull() & cast_text(text, target).isNull(), F.struct(F.lit(f).alias("field"), text.alias("text"))))
    rows = rows.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("x"))
    return rows.groupBy(*keep, "x.field").agg(F.count(F.lit(1)).alias("n"), F.min("x.text").alias("example"))


def _placed(name: str):
    return lambda k: F.struct(F.lit(name).alias("place"), k.alias("key"))


def unknown_keys(df: DataFrame, aliases: Mapping = ALIASES, keep: Sequence[str] = ("producer_id", "file_seq"), payload: str = "payload") -> DataFrame:
    """(keep, place, key, n): keys beside the aliased ones that no alias names. A renamed field the alias table lacks shows up here."""
    # a place is the record or entry itself, or an object in it that an alias reaches into
    places: dict[tuple[str | None, str], set] = {}
    for inside, keys, _ in aliases.values():
        for k in keys:
            parts = k.split(".")
            for i in range(len(parts) - 1, -1, -1):
                places.setdefault((inside, ".".join(parts[:i])), set()).add(parts[i])
    if any(inside for inside, _ in places):
        places.setdefault((None, ""), set()).update(inside for inside, _ in places if inside)
    rows = _entries(df, aliases, keep, payload)
    found = []
    for (inside, place), known in places.items():
        at = F.col("__e" if inside else "__v")
        keys = F.map_keys(F.try_variant_get(at, _path(place) if place else "$", "map<string,variant>"))
        here = (F.col("array") == inside) if inside else (F.coalesce("entry_ord", F.lit(0)) == 0)
        new = F.array_except(keys, F.array(*[F.lit(x) for x in sorted(known)]))
        name = ".".join(x for x in (f"{inside}[]" if inside else "", place) if x)
        found.append(F.when(here & new.isNotNull(), F.transform(new, _placed(name))).otherwise(F.array().cast("array<struct<place:string,key:string>>")))
    rows = rows.select(*keep, F.explode(F.concat(*found)).alias("x"))
    return rows.groupBy(*keep, "x.place", "x.key").agg(F.count(F.lit(1)).alias("n"))
