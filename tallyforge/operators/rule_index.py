"""First matching rule from a rule table of any size.

One expression of all rules (:func:`tallyforge.operators.rules.first_match`) tries every rule on every row. Here rules
are rows themselves. Cells that ask for one value (or one of several) are join keys; of the other cells on numbers
one range is cut into nodes of a coarse tree over the range of all such bounds, whose ancestors of a row's value are
join keys too. Rules with the same keys form a list; a row meets one list for each kind of key and tree level, tries the rules in
it at once, and goes on to the next join with the lowest number and its value, never with a list. What the keys bring
together is always tried in full: they only leave out rules that cannot hold.

The rule table is parsed in tasks and its lists are written once: Spark broadcasts them if they are small, or
shuffles both sides. Rules after one that always holds are dropped.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize
from ..tasks import travel_by_value
from .rules import ANY, cell_terms

# The tree has GRID leaves; a node of one level has STEP children on the next one of the levels in use.
GRID, STEP = 1 << 12, 3
LEVELS = range(0, GRID.bit_length(), STEP)
SHORT_LIST = 64

TERM = "struct<sign:string,text:string,whole:bigint,part:double>"
CELL = f"array<array<{TERM}>>"


def _literal(literal: str) -> dict:
    if literal[0] in "'\"":
        return {"text": literal[1:-1], "whole": None, "part": None}
    if "." in literal or abs(int(literal)) >= 1 << 63:
        return {"text": None, "whole": None, "part": float(literal)}
    return {"text": None, "whole": int(literal), "part": None}


def _number(term: dict) -> float | None:
    return float(term["whole"]) if term["whole"] is not None else term["part"]


def parsed_cell(text: str) -> list[list[dict]] | None:
    """Alternatives of joined terms; None for a cell that always holds."""
    if text.strip() == ANY:
        return None
    return [[{"sign": sign, **_literal(literal)} for sign, literal in terms] for terms in cell_terms(text)]


def _wanted(cell: list[list[dict]] | None) -> list[tuple[str, object]] | None:
    """The values that a cell asks for, ("n", number) or ("t", text), if it asks for nothing else."""
    if cell is None or any(len(terms) != 1 or terms[0]["sign"] != "==" for terms in cell):
        return None
    values = {("n", _number(t)) if t["text"] is None else ("t", t["text"]) for (t,) in cell}
    return sorted(values, key=repr) if len({kind for kind, _ in values}) == 1 else None


def _hull(cell: list[list[dict]] | None) -> tuple[float, float] | None:
    """Bounds outside of which a cell on a numeric column cannot hold, if it has any."""
    if cell is None:
        return None
    bounds = []
    for terms in cell:
        lo, hi = float("-inf"), float("inf")
        for term in terms:
            if term["text"] is not None:
                continue
            number = _number(term)
            lo = max(lo, number) if term["sign"] in (">", ">=", "==") else lo
            hi = min(hi, number) if term["sign"] in ("<", "<=", "==") else hi
        bounds.append((lo, hi))
    whole = min(lo for lo, _ in bounds), max(hi for _, hi in bounds)
    return None if whole == (float("-inf"), float("inf")) else whole


def _compiled(rules: DataFrame, columns: Sequence[str], number: str, value: str, numeric: Sequence[bool]) -> DataFrame:
    """A row for each rule and combination of values it asks for, with its ``shape``, keys, hull and cells.

    The shape has a letter a column: ``n`` or ``t`` for a value, ``r`` for the one range, ``-`` for the rest.
    """
    cell_type = pa.list_(pa.list_(pa.struct([("sign", pa.string()), ("text", pa.string()), ("whole", pa.int64()), ("part", pa.float64())])))
    fields = [("no", pa.int64()), ("outcome", pa.string()), ("shape", pa.string()), ("lo", pa.float64()), ("hi", pa.float64())]
    fields += [(f"n{i}", pa.float64()) for i in range(len(columns))] + [(f"t{i}", pa.string()) for i in range(len(columns))]
    fields += [(f"cell{i}", cell_type) for i in range(len(columns))]
    schema = pa.schema(fields)

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for no, outcome, *texts in zip(*[c.to_pylist() for c in batch.columns]):
                cells = [parsed_cell(t) for t in texts]
                asked = [_wanted(c) for c in cells]
                # Only a column of numbers can be asked by number: text may read as the same number in many ways.
                asked = [a if a and (a[0][0] == "t" or n) else None for a, n in zip(asked, numeric)]
                ranged = next((i for i, c in enumerate(cells) if numeric[i] and not asked[i] and _hull(c)), None)
                lo, hi = (None, None) if ranged is None else _hull(cells[ranged])
                shape = "".join("r" if i == ranged else a[0][0] if a else "-" for i, a in enumerate(asked))
                row = {"no": no, "outcome": outcome, "shape": shape, "lo": lo, "hi": hi} | {f"cell{i}": c for i, c in enumerate(cells)}
                for keys in product(*[a or [None] for a in asked]):
                    rows.append(row | {f"{k[0]}{i}": k[1] for i, k in enumerate(keys) if k})
            if rows:
                yield pa.RecordBatch.from_pylist([{f: row.get(f) for f in schema.names} for row in rows], schema=schema)

    ddl = "no bigint, outcome string, shape string, lo double, hi double, "
    ddl += ", ".join([f"n{i} double" for i in range(len(columns))] + [f"t{i} string" for i in range(len(columns))] + [f"cell{i} {CELL}" for i in range(len(columns))])
    picked = rules.select(F.col(number).cast("bigint"), F.col(value).cast("string"), *[F.col(c).cast("string") for c in columns])
    return picked.mapInArrow(compiled, ddl)


def cover(first: int, last: int) -> list[tuple[int, int]]:
    """(level, node) of the fewest nodes of the levels in use that hold exactly the leaves ``first`` to ``last``."""
    out = []
    for level in LEVELS:
        top = level + STEP not in LEVELS
        while first <= last and (top or first % (1 << STEP)):
            out.append((level, first))
            first += 1
        while first <= last and (last + 1) % (1 << STEP):
            out.append((level, last))
            last -= 1
        if first > last:
            break
        first, last = first >> STEP, ((last + 1) >> STEP) - 1
    return out


def _leaf(value: Column, least: float, most: float) -> Column:
    """Leaf of a number; what is beyond the bounds, or no number, belongs to an outermost leaf. Never falls."""
    width = (most - least) / GRID or 1.0
    place = F.floor(F.greatest(F.least((value.cast("double") - least) / width, F.lit(float(GRID - 1))), F.lit(0.0)))
    return F.coalesce(place.cast("int"), F.lit(0))


def _covered(rules: DataFrame, least: float, most: float) -> DataFrame:
    """``rules`` with a row for each (level, node) of its range."""
    nodes = F.udf(lambda a, b: [(lv, nd) for lv, nd in cover(a, b)], "array<struct<level:int,node:int>>")
    placed = rules.withColumn("_nodes", nodes(_leaf(F.col("lo"), least, most), _leaf(F.col("hi"), least, most)))
    return placed.select("*", F.inline("_nodes")).drop("_nodes")


def _holds(term: Column, column: Column, numeric: bool) -> Column:
    """As a term of :func:`rules.rule_cell`."""

    def compare(x: Column, y: Column) -> Column:
        return F.when(x < y, F.lit(-1)).when(x == y, F.lit(0)).when(x > y, F.lit(1))

    number = column if numeric else column.try_cast("double")
    found = (
        F.when(term["text"].isNotNull(), compare(column.cast("string"), term["text"]))
        .when(term["whole"].isNotNull(), compare(number, term["whole"]))
        .otherwise(compare(number, term["part"]))
    )
    sign = term["sign"]
    return (
        F.when(sign == "==", F.coalesce(found == 0, F.lit(False)))
        .when(sign == "!=", F.coalesce(found != 0, F.lit(True)))
        .when(sign == ">", found > 0)
        .when(sign == ">=", found >= 0)
        .when(sign == "<", found < 0)
        .otherwise(found <= 0)
    )


def _cell_holds(cell: Column, column: Column, numeric: bool) -> Column:
    """Terms from left to right; one that cannot be compared makes the cell false unless the cell is settled."""

    def both(terms: Column) -> Column:
        return F.aggregate(terms, F.lit(True), lambda held, t: F.when(held, _holds(t, column, numeric)).otherwise(held))

    either = F.aggregate(cell, F.lit(False), lambda held, terms: F.when(held.isNull() | held, held).otherwise(both(terms)))
    return cell.isNull() | F.coalesce(either, F.lit(False))


def match_rules(
    df: DataFrame, rules: DataFrame, columns: Sequence[str], number: str, value: str = "expected_value", name: str = "expected_value"
) -> DataFrame:
    """``df`` with the value of the first rule, by ``number``, all of whose cells hold; NULL when none does.

    Cells are read as by :func:`rules.rule_cell`; one that isn't understood is an error. Rule numbers should be unique; of rules with the
    same number the one with the smaller value comes first. Jobs over the rules run when this is called.
    """
    numeric = [isinstance(df.schema[c].dataType, T.NumericType) for c in columns]
    compiled = materialize(_compiled(rules, columns, number, value, numeric), "rules")
    always = reduce(operator.and_, [F.col(f"cell{i}").isNull() for i in range(len(columns))], F.lit(True))
    finite = F.when(F.abs("lo") < float("inf"), F.col("lo")), F.when(F.abs("hi") < float("inf"), F.col("hi"))
    shapes = compiled.groupBy("shape").agg(
        F.least(F.min(finite[0]), F.min(finite[1])).alias("least"),
        F.greatest(F.max(finite[0]), F.max(finite[1])).alias("most"),
        F.min(F.when(always, F.col("no"))).alias("always"),
    ).collect()  # a row a shape, of which there are at most 4 to the power of the columns
    stop = min((s["always"] for s in shapes if s["always"] is not None), default=None)
    live = compiled if stop is None else compiled.where(F.col("no") <= stop)
    out, best = df, None

    def holds(rule: Column) -> Column:
        return reduce(operator.and_, [_cell_holds(rule[f"cell{i}"], F.col(c), numeric[i]) for i, c in enumerate(columns)], F.lit(True))

    def lowest(found: Column) -> Column:
        return F.array_min(F.transform(F.filter(found, holds), lambda r: F.struct(r["no"].alias("no"), r["outcome"].alias("outcome"))))

    rule = F.struct("no", "outcome", *[F.col(f"cell{i}") for i in range(len(columns))])
    # Lists with keys are met first: they may have to be shuffled, and what a row has found goes along.
    for place, shape in enumerate(sorted(shapes, key=lambda s: (not set(s["shape"]) & {"n", "t"}, s["shape"]))):
        kinds = shape["shape"]
        own = live.where(F.col("shape") == kinds)
        keys = [f"{k}{i}" for i, k in enumerate(kinds) if k in "nt"]
        ranged = kinds.find("r")
        if ranged >= 0 and keys:
            longest = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
            # Lists that are short without the tree need no level of it.
            ranged = ranged if (longest or 0) > SHORT_LIST else -1
        if ranged >= 0:
            own, keys = _covered(own, shape["least"], shape["most"]), [*keys, "node"]
        grouped = own.groupBy(*(["level"] if ranged >= 0 else []), *keys).agg(F.collect_list(rule).alias("list"))
        lists = materialize(grouped, "rule-lists")
        levels = sorted(r["level"] for r in lists.select("level").distinct().collect()) if ranged >= 0 else [None]
        for level in levels:
            label = f"_rules_{place}_{level or 0}"
            some = lists if level is None else lists.where(F.col("level") == level)
            side = some.select(*[F.col(k).alias(f"{label}_{k}") for k in keys], F.col("list").alias(label))
            met = []
            for key in keys:
                if key == "node":
                    at = F.shiftright(_leaf(F.col(columns[ranged]), shape["least"], shape["most"]), level)
                else:
                    at = F.col(columns[int(key[1:])]).cast("double" if key[0] == "n" else "string")
                met.append(at == F.col(f"{label}_{key}"))
            # Without keys there is one list, which is a value like any other.
            out = out.join(side, reduce(operator.and_, met), "left") if met else out.withColumn(label, side.scalar())
            hit = lowest(F.col(label))
            hit, best = hit if best is None else F.least(best, hit), f"{label}_best"
            out = out.select(*[F.col(c) for c in df.columns], hit.alias(best))

    outcome = F.lit(None).cast("string") if best is None else F.col(best)["outcome"]
    return out.select(*[F.col(c) for c in df.columns if c != name], outcome.alias(name))


travel_by_value(__name__)
