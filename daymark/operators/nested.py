"""Payloads as nested values: variants checked leaf by leaf, cleaned by the declarations, and written in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars

#: Levels below a payload to which the places of bad numbers are told; deeper ones are told by their container.
DEPTH = 12
_STRING = r'"(?:[^"\\]|\\.)*"'
_NUMBER = r"-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?"


def canonical(value: Column) -> Column:
    """A variant as JSON without blanks, keys sorted at every level, other characters than ASCII as they are.

    Numbers are in their shortest form, so that 1, 1.0 and 1.00 are the same; equal values have equal texts.
    """
    return F.to_json(value)


def overflows(text: Column) -> Column:
    """Whether a JSON text holds a number, at any depth, that no double can represent."""
    bare = F.regexp_replace(text, _STRING, '""')
    return F.exists(F.regexp_extract_all(bare, F.lit(f"({_NUMBER})"), F.lit(1)), lambda x: F.abs(x.try_cast("double")) == float("inf"))


def with_bad_numbers(rows: DataFrame, value: str, asked: Column, name: str = "places") -> DataFrame:
    """rows with an array of the places in a variant at which numbers that aren't finite stand, as paths like a.b[2].

    Containers are opened level by level inside their row, for rows that are `asked` only; numbers deeper than DEPTH are
    told by their container.
    """
    part = "array<struct<path:string,v:variant>>"
    empty = F.array().cast(part)
    out = rows.withColumns({"_level": F.when(asked, F.array(F.struct(F.lit("").alias("path"), F.col(value).alias("v")))).otherwise(empty), name: F.array().cast("array<string>")})

    def opened(e):
        kind, at = F.schema_of_variant(e["v"]), e["path"]
        keyed = F.transform(F.map_entries(F.try_variant_get(e["v"], "$", "map<string,variant>")), lambda x: F.struct(F.concat(F.when(at == "", "").otherwise(F.concat(at, F.lit("."))), x["key"]).alias("path"), x["value"].alias("v")))
        listed = F.transform(F.try_variant_get(e["v"], "$", "array<variant>"), lambda x, i: F.struct(F.concat(at, F.lit("["), i.cast("string"), F.lit("]")).alias("path"), x.alias("v")))
        return F.when(kind.startswith("OBJECT"), keyed).when(kind.startswith("ARRAY"), listed).otherwise(empty)

    leaf = lambda e: F.coalesce((F.schema_of_variant(e["v"]) == "DOUBLE") & (F.abs(F.try_variant_get(e["v"], "$", "double")) == float("inf")), F.lit(False))
    for depth in range(DEPTH + 1):
        bad = leaf if depth < DEPTH else lambda e: leaf(e) | F.coalesce(overflows(F.to_json(e["v"])), F.lit(False))
        out = out.withColumn(name, F.concat(name, F.transform(F.filter("_level", bad), lambda e: e["path"])))
        if depth < DEPTH:
            out = out.withColumn("_level", F.flatten(F.transform("_level", opened)))
    return out.withColumn(name, F.array_sort(name)).drop("_level")


def _kind_fits(value: Column, kind: Column) -> Column:
    """Whether a variant is of a declared type; truth values are no numbers."""
    is_a = F.schema_of_variant(value)
    whole, real = is_a == "BIGINT", is_a.isin("BIGINT", "DOUBLE", "FLOAT") | is_a.startswith("DECIMAL")
    return (
        F.when(kind == "integer", whole | (is_a.startswith("DECIMAL") & is_a.endswith(",0)"))).when(kind == "number", real).when(kind == "boolean", is_a == "BOOLEAN").when(kind.isin("string", "enum", "timestamp"), is_a == "STRING")
        .when(kind == "array", is_a.startswith("ARRAY")).when(kind == "object", is_a.startswith("OBJECT")).otherwise(F.lit(False))
    )


def ingested(raw: DataFrame, dims: DataFrame, payload: str = "payload") -> DataFrame:
    """raw (signal, payload: JSON text) with problems, `value` (variant), dropped (names), canonical and digest.

    dims: signal, field, type, low, high, nullable, privacy, enum. A payload must be an object of finite numbers, to its
    last leaf, whether its fields are declared or not; of declared fields type, range, membership and presence are
    checked. What is stored is the payload without restricted and undeclared fields, whose names are told; its canonical
    text and the digest of signal and text don't depend on order or spelling. A row with problems has no value. A signal
    that isn't declared is one problem. Keys given twice in an object make a payload malformed.
    """
    declared = dims.groupBy("signal").agg(F.collect_list(F.struct("field", "type", "low", "high", "nullable", "privacy", "enum")).alias("_fields"))
    # a signal holds very many rows: they stay where they are, and the declarations, which people write, come to them
    rows = raw.join(F.broadcast(declared), "signal", "left").withColumn("_v", F.try_parse_json(payload))
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    rows = rows.withColumns({"_object": is_object, "_bad": F.coalesce(overflows(F.col(payload)), F.lit(False)), "_m": F.when(is_object, F.try_variant_get("_v", "$", "map<string,variant>"))})
    rows = with_bad_numbers(rows, "_v", F.col("_bad") & F.col("_object"))

    def wrong(f):
        x = F.try_element_at(F.col("_m"), f["field"])
        gone = x.isNull() | (F.schema_of_variant(x) == "VOID")
        number = F.try_variant_get(x, "$", "double")
        reason = (
            F.when(gone, F.when(~f["nullable"], "missing")).when(~_kind_fits(x, f["type"]), F.concat(F.lit("not "), f["type"]))
            .when(f["type"].isin("integer", "number") & ((number < f["low"]) | (number > f["high"])), "out_of_range").when((f["type"] == "enum") & ~F.array_contains(f["enum"], F.try_variant_get(x, "$", "string")), "not_a_member")
        )
        return F.when(reason.isNotNull(), F.concat(f["field"], F.lit(": "), reason))

    numbers = F.transform("places", lambda p: F.concat(p, F.lit(": invalid_numeric_value")))
    checks = F.array_compact(F.transform("_fields", wrong))
    problems = (
        F.when(F.col("_fields").isNull(), F.array(F.lit("signal: not declared"))).when(~F.col("_object"), F.array(F.lit("payload: no object")))
        .when(F.col("_bad"), F.when(F.size(numbers) > 0, numbers).otherwise(F.array(F.lit("payload: invalid_numeric_value")))).otherwise(F.array_sort(checks))
    )
    open_ = F.filter("_fields", lambda f: f["privacy"] != "restricted")
    names = F.transform(open_, lambda f: f["field"])
    clean = F.map_filter("_m", lambda k, _: F.array_contains(names, k))
    ok = F.size("problems") == 0
    rows = rows.withColumn("problems", problems)
    rows = rows.withColumns({"value": F.when(ok, F.to_variant_object(clean)), "dropped": F.when(ok, F.array_sort(F.filter(F.map_keys("_m"), lambda k: ~F.array_contains(names, k))))})
    rows = rows.withColumn("canonical", canonical(F.col("value")))
    return rows.withColumn("digest", F.when(ok, scalars.digest(F.lit("v2"), F.col("signal"), F.col("canonical")))).drop("_fields", "_v", "_object", "_bad", "_m", "places")
