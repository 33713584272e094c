"""Nested records as flat tables and back: counts, masks, leaves, reassembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRESENT, ABSENT, NULL = ".", "-", "0"


def presence(text: Column, field: str) -> Column:
    """Of a JSON object in text: . where the field has a value, 0 where it is null, - where it isn't there."""
    has = F.array_contains(F.json_object_keys(text), field)
    return F.when(~F.coalesce(has, F.lit(False)), ABSENT).when(F.get_json_object(text, f"$.{field}").isNull(), NULL).otherwise(PRESENT)


def element_mask(items: Column) -> Column:
    """A character for each element: . or, for null, 0."""
    return F.array_join(F.transform(items, lambda x: F.when(x.isNull(), NULL).otherwise(PRESENT)), "")


def counts(items: Column) -> Column:
    """Elements of an array; null has none, and is null."""
    return F.when(items.isNotNull(), F.size(items))


def leaves(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], T.DataType]]:
    """Paths of the scalar leaves outside of arrays, and of the arrays, in order of fields."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            out += leaves(f.dataType, (*path, f.name))
        else:
            out.append(((*path, f.name), f.dataType))
    return out


def flatten(df: DataFrame, joint: str = "/") -> DataFrame:
    """Every scalar leaf outside of arrays as a column named by its path; arrays stay."""
    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(joint.join(path)) for path, _ in leaves(df.schema)])


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` to as many parts as a shuffle has, before arrays are gathered from it.

    Adaptive execution would put parts together until they have its advisory size in compressed bytes, and
    sorting and gathering takes many times that; a number that is asked for stays."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(f"`{key}`"))


def shred(df: DataFrame, key: str, items: str) -> tuple[DataFrame, DataFrame]:
    """The records with the count of ``items`` instead of it, and its elements: (key, index, fields...)."""
    parents = df.withColumn(f"{items}_count", counts(F.col(items))).drop(items)
    element = df.schema[items].dataType.elementType
    rows = df.select(F.col(key), F.posexplode(items).alias("index", "element"))
    if isinstance(element, T.StructType):
        return parents, rows.select(key, "index", F.when(F.col("element").isNull(), NULL).otherwise(PRESENT).alias("mask"), "element.*")
    return parents, rows


def assemble(parents: DataFrame, children: DataFrame, key: str, items: str) -> DataFrame:
    """What ``shred`` took apart."""
    if "mask" in children.columns:
        fields = [c for c in children.columns if c not in (key, "index", "mask")]
        element = F.when(F.col("mask") == PRESENT, F.struct(*fields))
    else:
        element = F.col("element")
    back = children.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", element.alias("e")))), lambda x: x["e"]).alias("__items"))
    full = parents.join(back, key, "left")
    count, none = F.col(f"{items}_count"), F.array().cast(back.schema["__items"].dataType)
    return full.withColumn(items, F.when(count.isNull(), F.lit(None)).when(count == 0, none).otherwise(F.col("__items"))).drop(f"{items}_count", "__items")


def _shredded(df: DataFrame, keys: list[str], path: str, out: dict[str, DataFrame], many: str) -> None:
    """Put the table of ``path`` into ``out``, and those of the arrays below it."""
    here, arrays = [F.col("`?`")] if "?" in df.columns else [], []
    for f in df.schema:
        if f.name in keys or f.name == "?":
            continue
        for sub, kind in leaves(T.StructType([f])):
            c = F.col(".".join(f"`{p}`" for p in sub))
            name = "/".join(sub)
            if isinstance(kind, T.ArrayType):
                arrays.append((name, c, kind.elementType))
                here.append(counts(c).alias(f"{name}#"))
            else:
                here.append(c.alias(name))
            # A struct that is null differs from one whose fields are: its fields alone wouldn't tell.
        for sub in _structs(T.StructType([f])):
            here.append(F.when(F.col(".".join(f"`{p}`" for p in sub)).isNull(), NULL).otherwise(PRESENT).alias("/".join(sub) + "?"))
    out[path] = df.select(*[F.col(f"`{k}`") for k in keys], *here)
    for name, c, element in arrays:
        index = f"i{len(keys) - 1}"
        rows = df.select(*[F.col(f"`{k}`") for k in keys], F.posexplode(c).alias(index, "element"))
        below = f"{path}/{name}{many}" if path else f"{name}{many}"
        if isinstance(element, T.StructType):
            flat = rows.select(*[F.col(f"`{k}`") for k in (*keys, index)], F.when(F.col("element").isNull(), NULL).otherwise(PRESENT).alias("?"), "element.*")
            _shredded(flat, [*keys, index], below, out, many)
        else:
            _shredded(rows, [*keys, index], below, out, many)


def _structs(schema: T.StructType, path: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    """Paths of the structs outside of arrays."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.StructType):
            out += [(*path, f.name), *_structs(f.dataType, (*path, f.name))]
    return out


def shred_all(df: DataFrame, key: str) -> dict[str, DataFrame]:
    """A nested table as flat ones: one for the records (path ""), and one for each array at any depth (its path
    ends in []), whose rows have the key, an index i0, i1, ... for each array above them, their scalar leaves
    by path, a count (name#) instead of each array, and marks (name?, or ? for the element itself) of null structs.

    ``key`` tells records apart."""
    out: dict[str, DataFrame] = {}
    _shredded(df, [key], "", out, "[]")
    return out


def assemble_all(tables: dict[str, DataFrame], schema: T.StructType, key: str) -> DataFrame:
    """What ``shred_all`` took apart, as ``schema``; arrays are gathered from the deepest up."""

    def build(kind: T.DataType, name: str, df: DataFrame) -> Column:
        if isinstance(kind, T.StructType):
            whole = F.struct(*[build(f.dataType, f"{name}/{f.name}", df).alias(f.name) for f in kind])
            return F.when(F.col(f"`{name}?`") == PRESENT, whole)
        if isinstance(kind, T.ArrayType):
            n = F.col(f"`{name}#`")
            return F.when(n.isNull(), F.lit(None)).when(n == 0, F.array().cast(kind.simpleString())).otherwise(F.col(f"`{name}[]`"))
        return F.col(f"`{name}`")

    def arrays(kind: T.DataType, name: str) -> list[tuple[str, T.ArrayType]]:
        if isinstance(kind, T.StructType):
            return [a for f in kind for a in arrays(f.dataType, f"{name}/{f.name}")]
        return [(name, kind)] if isinstance(kind, T.ArrayType) else []

    def gathered(path: str, keys: list[str], fields: list[tuple[str, T.DataType]]) -> DataFrame:
        """The table of ``path`` with the arrays below it as columns name[]."""
        df = tables[path]
        for name, kind in (a for n, k in fields for a in arrays(k, n)):
            below = f"{path}/{name}[]" if path else f"{name}[]"
            index, element = f"i{len(keys) - 1}", kind.elementType
            if isinstance(element, T.StructType):
                rows = gathered(below, [*keys, index], [(f.name, f.dataType) for f in element])
                e = F.when(F.col("`?`") == PRESENT, F.struct(*[build(f.dataType, f.name, rows).alias(f.name) for f in element]))
            else:
                rows = gathered(below, [*keys, index], [("element", element)])
                e = build(element, "element", rows)
            listed = rows.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), e.alias("e")))), lambda x: x["e"]).alias(f"{name}[]"))
            df = df.join(listed, keys, "left")
        return df

    own = gathered("", [key], [(f.name, f.dataType) for f in schema if f.name != key])
    return own.select(*[F.col(f"`{key}`") if f.name == key else build(f.dataType, f.name, own).alias(f.name) for f in schema])


def array_counts(df: DataFrame, key: str, items: str) -> DataFrame:
    """(key, level, counts): how many elements each array of ``items`` has, level by level, in order; null for null."""
    kind, lists, level, out = df.schema[items].dataType, F.array(F.col(f"`{items}`")), 0, None
    while isinstance(kind, T.ArrayType):
        one = df.select(F.col(f"`{key}`"), F.lit(level).alias("level"), F.transform(lists, counts).alias("counts"))
        out = one if out is None else out.unionByName(one)
        lists, kind, level = F.flatten(F.filter(lists, lambda x: x.isNotNull())), kind.elementType, level + 1
    return out


#: What a JSON text can be at its root.
ROOTS = ("dataset", "records", "empty_object", "object", "value", "mixed")


def root_kind(text: Column) -> Column:
    """dataset (a list of objects, one with fields), records (a list of objects without any, or an empty list),
    empty_object, object, value (anything else, a list of values too), or mixed (a list of objects and values)."""
    t = F.trim(text)
    items = F.from_json(t, "array<string>")
    is_object = lambda x: F.coalesce(x.startswith("{"), F.lit(False))
    fields = lambda x: F.size(F.json_object_keys(x)) > 0
    listed = (
        F.when(F.size(items) == 0, "records").when(F.forall(items, is_object), F.when(F.exists(items, fields), "dataset").otherwise("records"))
        .when(F.exists(items, is_object), "mixed").otherwise("value"))
    return F.when(t.startswith("["), listed).when(t.startswith("{"), F.when(F.size(F.json_object_keys(t)) > 0, "object").otherwise("empty_object")).otherwise("value")


def with_codec(df: DataFrame, path: str, codec, back: bool = False) -> DataFrame:
    """``df`` with the texts at ``path`` (names with / between them, [] behind an array) as the codec's payloads, or
    ``back`` as texts.  Null stays null."""
    change = codec.decode if back else codec.encode

    def at(c: Column, steps: list[str]) -> Column:
        if not steps:
            return F.when(c.isNotNull(), change(c))
        name, rest = steps[0], steps[1:]
        if name == "[]":
            return F.transform(c, lambda x: at(x, rest))
        return F.when(c.isNotNull(), c.withField(name, at(c[name], rest)))

    first, *steps = [s for part in path.split("/") for s in ((part[:-2], "[]") if part.endswith("[]") else (part,))]
    return df.withColumn(first, at(F.col(f"`{first}`"), steps))


def first_present(*paths: str) -> Column:
    """The first of the fields at ``paths`` (names with dots) that isn't null, whichever branch is missing."""
    return F.coalesce(*[F.col(".".join(f"`{p}`" for p in path.split("."))) for path in paths])


def byte_parts(tables: dict[str, DataFrame]) -> DataFrame:
    """(part, bytes) of a shredded table as text with line ends: meta (names), control (keys, indexes, counts and
    marks) and leaves."""
    out = None
    for path, df in tables.items():
        control = [c for c in df.columns if c.endswith(("#", "?")) or c[:1] == "i" and c[1:].isdigit() or c == tables[""].columns[0]]
        size = lambda names: sum((F.octet_length(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) + 1 for c in names), F.lit(0)).cast("long")
        names = sum(len(c.encode()) + 1 for c in df.columns) + len(path.encode()) + 1
        row = df.agg(F.coalesce(F.sum(size(control)), F.lit(0)).alias("control"), F.coalesce(F.sum(size([c for c in df.columns if c not in control])), F.lit(0)).alias("leaves"))
        one = row.select(F.lit(path).alias("path"), F.explode(F.array(
            F.struct(F.lit("meta").alias("part"), F.lit(names).cast("long").alias("bytes")), F.struct(F.lit("control").alias("part"), F.col("control").alias("bytes")), F.struct(F.lit("leaves").alias("part"), F.col("leaves").alias("bytes")))).alias("x"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("x.part").agg(F.sum("x.bytes").alias("bytes"))


def infer(df: DataFrame, text: str) -> T.StructType:
    """The schema that JSON texts have in common, with the keys of all records."""
    found = df.agg(F.expr(f"schema_of_variant_agg(parse_json(`{text}`))").alias("s")).first()["s"]
    return T.StructType.fromDDL("x " + found.replace("OBJECT<", "STRUCT<"))["x"].dataType


def record_stats(df: DataFrame, items: str) -> DataFrame:
    """One row: records, null_arrays, empty_arrays, elements, most elements in a record."""
    n = F.size(items)
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col(items).isNull()).alias("null_arrays"), F.count_if(F.col(items).isNotNull() & (n == 0)).alias("empty_arrays"),
        F.coalesce(F.sum(F.when(F.col(items).isNotNull(), n)), F.lit(0)).cast("long").alias("elements"), F.max(F.when(F.col(items).isNotNull(), n)).cast("long").alias("most"))
