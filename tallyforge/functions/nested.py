"""Arrays, structs, maps and JSON text: Column expressions built from the schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The flag threshold for zero months, the value it sets, and the
# texts of the whole-input label.
ZERO_MONTHS_THRESHOLD = 9
ZERO_MONTHS_VALUE = 1331
ADVERSE = "customer is adverse"
NOT_ADVERSE = "customer is not adverse"

# Priority codes and the positions of earlier codes that are inspected.
PRIORITY_MISSING = "-999"
PRIORITY_NONE = "-998"
PRIORITY_SAME = "-997"
PRIORITY_OTHER = "Unknown"
PRIORITY_MISSING_POSITIONS = (0, 3, 4, 5, 6)
PRIORITY_WIDTH = 4


# --- rows from arrays -------------------------------------------------------


def explode_structs(df: DataFrame, array: str, keep: Sequence[str]) -> DataFrame:
    """One row per element of an array of structs, its fields as columns."""
    return df.select(*keep, F.inline(F.col(array)))


def repeat_rows(df: DataFrame, times: int = 6, name: str | None = None) -> DataFrame:
    """Every row ``times`` times; ``name`` keeps the 1-based copy number."""
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times))))
    return copies.withColumnRenamed("_copy", name) if name else copies.drop("_copy")


def repeat_per_value(df: DataFrame, values: Sequence[str], name: str = "col") -> DataFrame:
    """Every row once per listed value."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


# --- elements of arrays -----------------------------------------------------


def element_field(array: Column, index: int, field: str, cast: str | None = None) -> Column:
    """Field of the element at a 0-based index; NULL past the end or when the cast fails."""
    value = F.get(array, F.lit(index)).getField(field)
    return value.try_cast(cast) if cast else value


def update_at_index(array: Column, index: int, field: str, value: Column) -> Column:
    """Set ``field`` of the element at ``index`` where it is NULL; other elements unchanged."""
    return F.transform(
        array,
        lambda x, k: F.when((k == index) & x[field].isNull(), x.withField(field, value)).otherwise(x),
    )


def update_by_predicate(
    array: Column, predicate: Callable[[Column], Column], field: str, value: Column
) -> Column:
    """Set ``field`` in the elements that meet ``predicate``; a NULL predicate leaves the element alone."""
    return F.transform(array, lambda x: F.when(predicate(x), x.withField(field, value)).otherwise(x))


def array_total(array: Column, as_type: str = "double") -> Column:
    """Sum of one row's list, computed as ``as_type``; NULL elements count as nothing."""
    zero = F.lit(0).cast(as_type)
    return F.aggregate(array, zero, lambda acc, x: acc + F.coalesce(x.cast(as_type), zero))


def elements_in(first: Column, second: Column) -> Column:
    """Elements of the first list that equal some element of the second, in first-list order."""
    return F.filter(first, lambda x: F.array_contains(second, x))


# --- JSON text --------------------------------------------------------------


def parse_json_array(df: DataFrame, column: str, schema: T.DataType | str, name: str = "parsed_json") -> DataFrame:
    """Typed array from a JSON text column, which is dropped; bad JSON gives NULL."""
    return df.withColumn(name, F.from_json(F.col(column), schema)).drop(column)


def parse_json_cell(text: Column) -> Column:
    """Struct ``cell map<string,string>, is_bad``: every value as text, malformed text as an empty map."""
    parsed = F.from_json(text, "map<string,string>")
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        F.coalesce(parsed, empty).alias("cell"),
        ((F.coalesce(F.trim(text), F.lit("")) != "") & parsed.isNull()).alias("is_bad"),
    )


def json_key(text: Column, key: str) -> Column:
    """Top-level key of a JSON object as text; NULL when absent."""
    return F.get_json_object(text, f"$['{key}']")


def json_path(text: Column, path: str) -> Column:
    """Dotted path into JSON text; a numeric part indexes an array."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split("."))
    return F.get_json_object(text, f"${steps}")


# --- dotted paths over typed columns ----------------------------------------


def path_get(df: DataFrame, path: str) -> Column:
    """Column for a dotted path; NULL where the path leads nowhere."""
    head, *rest = path.split(".")
    fields = {f.name: f.dataType for f in df.schema.fields}
    if head not in fields:
        return F.lit(None).cast("string")
    column, dtype = F.col(f"`{head}`"), fields[head]
    for part in rest:
        if isinstance(dtype, T.StructType) and part in dtype.fieldNames():
            column, dtype = column.getField(part), dtype[part].dataType
        elif isinstance(dtype, T.ArrayType) and part.isdigit():
            column, dtype = F.get(column, F.lit(int(part))), dtype.elementType
        elif isinstance(dtype, T.MapType):
            column, dtype = F.try_element_at(column, F.lit(part)), dtype.valueType
        else:
            return F.lit(None).cast("string")
    return column


class PathNotFound(LookupError):
    """The path names no settable field; the message says why."""


def _set_inside(column: Column, dtype: T.DataType, parts: Sequence[str], value: object) -> Column:
    head, rest = parts[0], parts[1:]
    if isinstance(dtype, T.StructType):
        if head not in dtype.fieldNames():
            raise PathNotFound(f"field '{head}' not found")
        inner_type = dtype[head].dataType
        if rest:
            return column.withField(f"`{head}`", _set_inside(column.getField(head), inner_type, rest, value))
        return column.withField(f"`{head}`", F.lit(value).cast(inner_type))
    if isinstance(dtype, T.ArrayType):
        if not rest:
            raise PathNotFound("the last part points into an array")
        if not head.isdigit():
            raise PathNotFound(f"'{head}' is not an array index")
        index, element = int(head), dtype.elementType
        _set_inside(F.lit(None), element, rest, value)  # refuse a bad path before the lambda is built
        return F.transform(
            column,
            lambda x, k: F.when(k == index, _set_inside(x, element, rest, value)).otherwise(x),
        )
    raise PathNotFound(f"nothing below '{head}'")


def path_set(df: DataFrame, edits: Mapping[str, object], where: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Set dotted paths to new values in the rows meeting ``where``.

    A path is set only if its last field exists; the second result names each
    path's outcome (``updated`` or the reason it was skipped).
    """
    outcome: dict[str, str] = {}
    chosen = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    for path, value in edits.items():
        head, *rest = path.split(".")
        types = {f.name: f.dataType for f in df.schema.fields}
        try:
            if head not in types:
                raise PathNotFound(f"field '{head}' not found")
            old = F.col(f"`{head}`")
            new = _set_inside(old, types[head], rest, value) if rest else F.lit(value).cast(types[head])
        except PathNotFound as reason:
            outcome[path] = str(reason)
            continue
        df = df.withColumn(head, F.when(chosen, new).otherwise(old))
        outcome[path] = "updated"
    return df, outcome


# --- code lists -------------------------------------------------------------


def _literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def policy_order(codes: Column, reference: Sequence[str], keep: int = 4) -> Column:
    """Codes that the reference lists, in reference order, the first ``keep`` of them."""
    return F.slice(F.filter(_literal_array(reference), lambda r: F.array_contains(codes, r)), 1, keep)


def policy_order_padded(codes: Column, reference: Sequence[str], keep: int = 4) -> Column:
    """As :func:`policy_order`, but an absent reference code leaves '0' in its place."""
    ordered = F.transform(
        _literal_array(reference), lambda r: F.when(F.array_contains(codes, r), r).otherwise(F.lit("0"))
    )
    return F.slice(ordered, 1, keep)


def code_decision(code: Column, decisions: Mapping[str, str], default: str = "V99") -> Column:
    """Decision of a code, or the default."""
    pairs = [F.lit(x) for pair in decisions.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), F.lit(default))


def priority_list(codes: Column, previous: Column) -> Column:
    """Four equal priority texts from a row's codes and earlier codes (both ``array<string>``)."""

    def before(position: int) -> Column:
        return F.get(previous, F.lit(position))

    missing = F.lit(False)
    for position in PRIORITY_MISSING_POSITIONS:
        missing = missing | F.coalesce(before(position) == "NULL", F.lit(False))
    none_before = F.size(codes) == 0
    for position in range(PRIORITY_WIDTH):
        none_before = none_before & F.coalesce(before(position) == "null", F.lit(False))
    padded = F.concat(codes, F.array_repeat(F.lit("0"), PRIORITY_WIDTH))
    same = F.slice(padded, 1, PRIORITY_WIDTH) == F.slice(previous, 1, PRIORITY_WIDTH)
    text = (
        F.when(missing, F.lit(PRIORITY_MISSING))
        .when(none_before, F.lit(PRIORITY_NONE))
        .when(same, F.lit(PRIORITY_SAME))
        .otherwise(F.lit(PRIORITY_OTHER))
    )
    return F.array_repeat(text, PRIORITY_WIDTH)


def zero_months(df: DataFrame, key: str, listing: str) -> DataFrame:
    """Number of zero entries of a comma list, with the flag and value from nine zeros up."""
    zeros = F.size(F.filter(F.split(F.col(listing), ","), lambda x: x.try_cast("double") == 0))
    counted = df.select(key, F.coalesce(zeros, F.lit(0)).alias("zero_months"))
    flagged = F.col("zero_months") >= ZERO_MONTHS_THRESHOLD
    return counted.withColumn("flag", flagged.cast("int")).withColumn(
        "value", F.when(flagged, F.lit(ZERO_MONTHS_VALUE)).otherwise(F.lit(0))
    )


def _label(ones: Column, threshold: int) -> Column:
    return F.when(ones >= threshold, F.lit(ADVERSE)).otherwise(F.lit(NOT_ADVERSE))


def adverse_label(df: DataFrame, array: str, threshold: int = ZERO_MONTHS_THRESHOLD) -> DataFrame:
    """One label for the whole input: adverse from ``threshold`` ones over all rows (empty input: not adverse).

    The ones are counted inside each row, so no row per element is made.
    """
    ones = F.coalesce(F.sum(F.size(F.filter(F.col(array), lambda x: x == 1)).cast("bigint")), F.lit(0))
    return df.agg(_label(ones, threshold).alias("customer_status"))


def adverse_label_by_row(df: DataFrame, array: str, name: str = "customer_status", threshold: int = ZERO_MONTHS_THRESHOLD) -> DataFrame:
    return df.withColumn(name, _label(F.size(F.filter(F.col(array), lambda x: x == 1)), threshold))
