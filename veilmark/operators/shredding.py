"""Nested records to related flat tables by shared inlining.

The schema is analysed as a graph. Structs that occur once below their parent are inlined into the parent's
table as prefixed columns; arrays and maps (repeated), struct types met at several places (shared) and arrays that
contain an array of their own name and shape (recursive) get tables of their own. Every row carries the root key,
its own `row_id` (the path of the node with positions, so it is the same in every run), the `parent_id` of the row
it hangs from, and one `<field>_ord` per array level. A table is cut out of the source by projection and explode
alone: nothing is shuffled, whatever the length of an array.

Defined cases: a null array or struct gives no child row and null columns; an empty array gives no rows; a null
entry keeps its position and gives a row whose `entry_null` is true, so no child is lost; source columns whose
flattened names clash (`a_b` beside `a.b`) get the suffix `_2`, `_3`; an empty table gives empty tables with the
full schema; rows with a null key are kept with a null key. Identical deliveries of a record give identical rows,
which `dedupe=True` reduces to one by (key, row_id).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Node:
    """One table of the target schema: where its rows lie in the record."""

    name: str
    path: tuple[str, ...]
    kind: str  # root, repeated, shared, recursive
    parent: str | None
    dtype: T.DataType
    children: list[str] = field(default_factory=list)


def _structs(dtype: T.DataType, path: tuple[str, ...], found: dict) -> None:
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            if isinstance(f.dataType, T.StructType):
                found.setdefault((f.name, f.dataType.simpleString()), []).append((*path, f.name))
            _structs(f.dataType, (*path, f.name), found)
    elif isinstance(dtype, T.ArrayType):
        _structs(dtype.elementType, (*path, "[]"), found)
    elif isinstance(dtype, T.MapType):
        _structs(dtype.valueType, (*path, "{}"), found)


def shared_types(schema: T.StructType) -> set[tuple[str, str]]:
    """(field name, type) of the structs that occur below more than one parent."""
    found: dict = {}
    _structs(schema, (), found)
    return {k for k, v in found.items() if len(v) > 1}


def _names(dtype: T.DataType) -> set[str]:
    return set(dtype.fieldNames()) if isinstance(dtype, T.StructType) else set()


class _Shredder:
    def __init__(self, df: DataFrame, root: str, key: str, share: bool, references: dict[str, str]):
        self.df, self.root, self.key, self.share = df, root, key, share
        self.shared = shared_types(df.schema) if share else set()
        self.references = references
        self.array_refs: dict[str, Column] = {}
        self.nodes: dict[str, Node] = {}
        self.tables: dict[str, list[DataFrame]] = {}

    def _add(self, node: Node, rows: DataFrame) -> None:
        self.nodes.setdefault(node.name, node)
        if node.parent and node.name not in self.nodes[node.parent].children:
            self.nodes[node.parent].children.append(node.name)
        self.tables.setdefault(node.name, []).append(rows)

    def _columns(self, at: Column | None, dtype: T.DataType, prefix: str, out: list, below: list, path: tuple[str, ...]) -> None:
        """Inlined columns of a struct into out; what needs a table of its own into below."""
        for f in dtype.fields:
            col = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            name, t, here = f"{prefix}{f.name}", f.dataType, (*path, f.name)
            if isinstance(t, T.StructType):
                if (f.name, t.simpleString()) in self.shared:
                    below.append((here, col, t, "shared"))
                else:
                    self._columns(col, t, f"{name}_", out, below, here)
            elif isinstance(t, (T.ArrayType, T.MapType)):
                below.append((here, col, t, "repeated"))
            else:
                out.append((name, col))

    def _select(self, rows: DataFrame, keep: list[tuple[str, Column]], out: list[tuple[str, Column]]) -> DataFrame:
        used = {n.lower() for n, _ in keep}
        cols = [c.alias(n) for n, c in keep]
        for n, c in out:
            name, i = n, 2
            while name.lower() in used:
                name, i = f"{n}_{i}", i + 1
            used.add(name.lower())
            cols.append(c.alias(name))
        return rows.select(*cols)

    def run(self) -> None:
        key = [(self.key, F.col(f"`{self.key}`"))]
        out: list = []
        below: list = []
        self._columns(None, T.StructType([f for f in self.df.schema.fields if f.name != self.key]), "", out, below, ())
        root = Node(self.root, (), "root", None, self.df.schema)
        self._add(root, self._select(self.df, key, out))
        for path, col, t, kind in below:
            self._descend(self.df, root, key, F.lit(""), path, col, t, kind, {})

    def _descend(self, rows, parent: Node, keep, parent_id, path, col, t, kind, ancestors) -> None:
        """One table below parent. keep: the root key and the ancestors' positions, readable from rows."""
        short = path[-1]
        if kind == "shared":
            name = short
            node = Node(name, path, "shared", parent.name, t)
            at = [*keep, ("parent_table", F.lit(parent.name)), ("parent_id", parent_id), ("row_id", F.concat_ws("/", F.nullif(parent_id, F.lit("")), F.lit("/".join(path[-1:]))))]
            below: list = []
            out: list = []
            live = rows.filter(col.isNotNull())
            self._columns(col, t, "", out, below, path)
            self._add(node, self._select(live, at, out))
            for p, c, ct, k in below:
                self._descend(live, node, keep, at[-1][1], p, c, ct, k, ancestors)
            return
        field_path = ".".join(x for x in path if x not in ("[]", "{}"))
        step = "/".join(x for x in path if x not in ("[]", "{}")) if parent.kind == "root" else "/".join(path[len(parent.path):]).replace("[]/", "").replace("{}/", "")
        is_map = isinstance(t, T.MapType)
        entry = T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)]) if is_map else t.elementType
        source = F.map_entries(col) if is_map else col
        target = self.references.get(field_path)
        if target and field_path in self.array_refs:
            positions = self.array_refs[field_path]
            source = F.transform(source, lambda v, i: F.struct(v.alias("__value"), F.get(positions, i).alias("__ref")))
        elif target:
            source = self._resolve(source, target)
        ordinal = f"{short}_ord"
        while ordinal in {n for n, _ in keep}:
            ordinal += "_2"
        scalar_refs = {p: q for p, q in self.references.items() if p.startswith(field_path + ".")}
        extra: list = []
        if scalar_refs and isinstance(entry, T.StructType):
            source, extra = self._resolve_fields(source, entry, field_path, scalar_refs)
        exploded = rows.select(*[c.alias(n) for n, c in keep], parent_id.alias("__parent"), F.posexplode(source).alias("__ord", "__entry"))
        kept = [(n, F.col(f"`{n}`")) for n, _ in keep] + [(ordinal, F.col("__ord"))]
        row_id = F.concat_ws("/", F.nullif(F.col("__parent"), F.lit("")), F.lit(step), F.col("__ord").cast("string"))
        value = F.col("__entry")
        resolved: list = []
        if target:
            resolved = [(f"{target.split('.')[0]}_ref_ord", F.col("__entry.__ref"))]
            value = F.col("__entry.__value")
        elif extra:
            resolved = [(n, F.col(f"__entry.__ref{i}")) for i, n in enumerate(extra) if n]
            value = F.col("__entry.__value")
        ancestor = ancestors.get(short)
        recursive = ancestor is not None and bool(_names(entry)) and len(_names(entry) & ancestor[1]) * 2 >= len(_names(entry))
        name = ancestor[0] if recursive else short if parent.kind == "root" else f"{parent.name}__{short}"
        node = Node(name, (*path, "{}" if is_map else "[]"), "recursive" if recursive else "repeated", parent.name, entry)
        at = [*kept, ("parent_id", F.col("__parent")), ("row_id", row_id)]
        out, below = [], []
        if isinstance(entry, T.StructType):
            if not is_map:
                at.append(("entry_null", value.isNull()))
            self._columns(value, entry, "", out, below, node.path)
        elif isinstance(entry, (T.ArrayType, T.MapType)):
            below.append(((*node.path, "item"), value, entry, "repeated"))
        else:
            at.append(("entry_null", value.isNull()))
            out.append(("value", value))
        self._add(node, self._select(exploded, at, out + resolved))
        seen = {**ancestors, short: (name, _names(entry))}
        for p, c, ct, k in below:
            self._descend(exploded, node, kept, row_id, p, c, ct, k, seen)

    def _ids(self, target: str) -> Column:
        array, column = target.split(".", 1)
        return F.transform(F.col(array), lambda x: x.getField(column))

    @staticmethod
    def _position(ids: Column, value: Column) -> Column:
        return (F.coalesce(F.array_position(ids, value), F.lit(0)) - 1).cast("int")

    def _resolve(self, source: Column, target: str) -> Column:
        """Entries with the position of the row of target they refer to (-1: none)."""
        # the outer transform binds the id list once a record
        return F.element_at(F.transform(F.array(self._ids(target)), lambda ids: F.transform(source, lambda v: F.struct(v.alias("__value"), self._position(ids, v).alias("__ref")))), 1)

    def _adder(self, source: Column, i: int, inner: list[str], many: bool):
        def add(ids: Column) -> Column:
            def one(v: Column) -> Column:
                value = v if i == 0 else v.getField("__value")
                older = [v.getField(f"__ref{j}").alias(f"__ref{j}") for j in range(i)]
                at = value
                for x in inner:
                    at = at.getField(x)
                ref = F.transform(at, lambda a: self._position(ids, a)) if many else self._position(ids, at)
                return F.struct(value.alias("__value"), *older, ref.alias(f"__ref{i}"))

            return F.transform(source, one)

        return add

    def _resolve_fields(self, source: Column, entry: T.StructType, field_path: str, refs: dict[str, str]) -> tuple[Column, list[str]]:
        """Entries as (__value, __ref0, ...); the names of the positions, empty where a child table takes them."""
        names: list[str] = []
        for i, (path, target) in enumerate(refs.items()):
            inner = path[len(field_path) + 1 :].split(".")
            t: T.DataType = entry
            for x in inner:
                if not isinstance(t, T.StructType):
                    raise ValueError(f"{path}: references below a second array level are not resolved")
                t = t[x].dataType
            many = isinstance(t, T.ArrayType)
            source = F.element_at(F.transform(F.array(self._ids(target)), self._adder(source, i, inner, many)), 1)
            if many:
                self.array_refs[path] = F.col(f"__entry.__ref{i}")
            names.append("" if many else f"{'_'.join(inner)}_{target.split('.')[0]}_ref_ord")
        return source, names


def shred(df: DataFrame, root: str, key: str, share: bool = True, references: dict[str, str] | None = None, dedupe: bool = False) -> dict[str, DataFrame]:
    """The flat tables of df by name; `root` names the table of the records themselves, `key` their key column.

    references: {path of a reference: "array.field" it points into}, as {"redactions.element_ids": "dom.element_id"}:
    the child table then gets `<...>_ref_ord`, the first position of that value in the array of the same record, or -1.
    """
    s = _Shredder(df, root, key, share, references or {})
    s.run()
    tables = {}
    for name, parts in s.tables.items():
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p, allowMissingColumns=True)
        if dedupe:
            whole = whole.dropDuplicates([key] + (["row_id"] if name != root else []))
        tables[name] = whole
    return tables


def schema_graph(df: DataFrame, root: str, key: str, share: bool = True) -> list[dict]:
    """The analysed graph: one entry a table, with the reason why it is one."""
    s = _Shredder(df, root, key, share, {})
    s.run()
    return [{"table_name": n.name, "kind": n.kind, "parent_table": n.parent, "path": "/".join(n.path)} for n in s.nodes.values()]
