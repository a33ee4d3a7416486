"""Rule tables compiled to Column expressions.

Rules are read once on the driver and become one expression that Spark pushes
down and code-generates; no rule text is ever evaluated as code.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tasks import travel_by_value

COMPARISONS = {
    ">": operator.gt,
    ">=": operator.ge,
    "<": operator.lt,
    "<=": operator.le,
    "==": operator.eq,
    "!=": operator.ne,
}

ANY = "any"
_LITERAL = r"-?\d+(?:\.\d+)?|'[^']*'|\"[^\"]*\""
# A comparison or a joining word; quoted text is one piece, whatever words it holds.
_PIECE = re.compile(rf"\s*(?:(?P<word>and|or)\b|['\"]?x['\"]?\s*(?P<sign>>=|<=|==|!=|>|<)\s*(?P<literal>{_LITERAL}))\s*")
# Rules that one expression may hold; rule_index.match_rules joins with longer tables.
MOST_RULES = 5_000


def rule_filter(rules: Sequence[Mapping[str, object]]) -> Column:
    """AND of rows ``{column, condition, value}``; an unknown comparison is an error."""
    terms = []
    for rule in rules:
        if rule["condition"] not in COMPARISONS:
            raise ValueError(f"unknown comparison {rule['condition']!r} for column {rule['column']!r}")
        terms.append(COMPARISONS[rule["condition"]](F.col(rule["column"]), F.lit(rule["value"])))
    return reduce(operator.and_, terms, F.lit(True))


def cell_terms(text: str) -> list[list[tuple[str, str]]]:
    """A cell's alternatives, each a list of (sign, literal) that must all hold."""
    text = text.strip()
    alternatives: list[list[tuple[str, str]]] = [[]]
    at, joined = 0, True
    while at < len(text):
        piece = _PIECE.match(text, at)
        if not piece or joined == bool(piece["word"]):
            raise ValueError(f"rule cell not understood: {text!r}")
        if piece["word"] == "or":
            alternatives.append([])
        elif not piece["word"]:
            alternatives[-1].append((piece["sign"], piece["literal"]))
        at, joined = piece.end(), bool(piece["word"])
    if joined:
        raise ValueError(f"rule cell not understood: {text!r}")
    return alternatives


def rule_cell(text: str, column: Column, dtype: T.DataType | None = None) -> Column:
    """Condition of one rule cell: ``any``, or comparisons of ``x`` joined by and / or.

    Terms are tried from left to right. An order comparison that cannot be made (text against a number, NULL) makes
    the whole cell false, unless an earlier term has settled it; ``!=`` can always be made: NULL and text differ from
    any number, and ``==`` finds them unequal.
    """
    text = text.strip()
    if text == ANY:
        return F.lit(True)

    def term(sign: str, literal: str) -> Column:
        if literal[0] in "'\"":
            held = COMPARISONS[sign](column.cast("string"), F.lit(literal[1:-1]))
        else:
            number = F.lit(float(literal) if "." in literal else int(literal))
            numeric = dtype is not None and isinstance(dtype, T.NumericType)
            held = COMPARISONS[sign](column if numeric else column.try_cast("double"), number)
        return F.coalesce(held, F.lit(sign == "!=")) if sign in ("==", "!=") else held

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), a).when(a, b).otherwise(F.lit(False))

    def either(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), a).when(a, F.lit(True)).otherwise(b)

    alternatives = [[term(*t) for t in terms] for terms in cell_terms(text)]
    return F.coalesce(reduce(either, [reduce(both, terms) for terms in alternatives]), F.lit(False))


def first_match(
    df: DataFrame, rules: Sequence[Mapping[str, str]], columns: Sequence[str], value: str = "expected_value"
) -> Column:
    """Value of the first rule row all of whose cells hold, in rule order; NULL when none does."""
    types = {f.name: f.dataType for f in df.schema.fields}
    chain = None
    for rule in rules:
        holds = reduce(operator.and_, [rule_cell(rule[c], F.col(c), types[c]) for c in columns], F.lit(True))
        outcome = F.lit(rule[value])
        chain = F.when(holds, outcome) if chain is None else chain.when(holds, outcome)
    return F.lit(None).cast("string") if chain is None else chain


def load_rules(rules: DataFrame, order_by: str | None = None, most: int = MOST_RULES) -> list[dict]:
    """Rule rows as dicts. Without an order column the rows of one small file keep their order.

    More than ``most`` rows are an error, seen before more than one further row has reached the driver.
    """
    ordered = rules.orderBy(order_by) if order_by else rules
    found = ordered.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rules for one expression; rule_index.match_rules takes tables of any size")
    return [row.asDict() for row in found]


travel_by_value(__name__)
