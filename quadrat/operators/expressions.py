"""Conditions written as text: a small language over sp_* calls and distances.

The text is parsed into a syntax tree of which only and, or, not, comparisons,
arithmetic, numbers, strings, sp_* calls and the distance names are allowed;
nothing of it is ever executed.  The result is a Condition, so text and calls
are planned alike.

    sp_circle(radius=3) and not sp_block(size=2)
    D <= 2.5 and d[0] < 2
"""

from __future__ import annotations

import ast
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrat.operators import conditions
from quadrat.operators.conditions import Condition

CALLS: dict[str, Callable[..., Condition]] = {
    "sp_circle": conditions.circle, "sp_annulus": lambda inner_radius, outer_radius: conditions.annulus(inner_radius, outer_radius), "sp_square": conditions.square,
    "sp_rectangle": lambda sizes: conditions.rectangle(*sizes), "sp_ellipse": lambda major_radius, minor_radius, rotate_angle=0.0: conditions.ellipse(major_radius, minor_radius, rotate_angle),
    "sp_block": conditions.block, "sp_self_only": conditions.self_only, "sp_select_all": conditions.select_all, "sp_select_element": lambda element: conditions.select_element(element),
    "sp_is_left_of": lambda vector_angle=0.0: conditions.left_of(vector_angle), "sp_is_right_of": lambda vector_angle=0.0: conditions.right_of(vector_angle), "sp_in_line_with": lambda vector_angle=0.0: conditions.in_line_with(vector_angle),
    "sp_match_text": conditions.match_text, "sp_match_regex": lambda re: conditions.match_regex(re), "sp_group_not_empty": conditions.not_empty,
    "sp_richness_greater_than": conditions.richness_greater_than, "sp_redundancy_greater_than": conditions.redundancy_greater_than,
}
_AXES = "xy"
#: Distances: on the map (D, d) and in cells (C, c), with squares and by axis; lower case without a sign is absolute.
NAMES = ("D", "Dsqr", "C", "Csqr")
_COMPARE = {ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__", ast.Eq: "__eq__", ast.NotEq: "__ne__"}
_ARITHMETIC = {ast.Add: "__add__", ast.Sub: "__sub__", ast.Mult: "__mul__"}


class InvalidCondition(ValueError):
    """A text that is no condition, and why."""


def _tree(text: str) -> ast.expr:
    try:
        return ast.parse(text.strip(), mode="eval").body
    except (SyntaxError, ValueError) as e:
        raise InvalidCondition(f"syntax: {getattr(e, 'msg', e)}") from None


def _column(node: ast.expr, cells: tuple[float, float]) -> Column:
    """A distance or number."""
    along = lambda i, size: F.abs(F.col(f"c.{_AXES[i]}") - F.col(f"b.{_AXES[i]}")) / size
    if isinstance(node, ast.Constant) and isinstance(node.value, int | float):
        return F.lit(float(node.value))
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_column(node.operand, cells)
    if isinstance(node, ast.BinOp) and type(node.op) in _ARITHMETIC:
        return getattr(_column(node.left, cells), _ARITHMETIC[type(node.op)])(_column(node.right, cells))
    if isinstance(node, ast.Name) and node.id in NAMES:
        sizes = (1.0, 1.0) if node.id[0] == "D" else cells
        square = along(0, sizes[0]) * along(0, sizes[0]) + along(1, sizes[1]) * along(1, sizes[1])
        return F.round(square if node.id.endswith("sqr") else F.sqrt(square), 10)
    if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id in ("d", "c") and isinstance(node.slice, ast.Constant) and node.slice.value in (0, 1):
        return along(node.slice.value, 1.0 if node.value.id == "d" else cells[node.slice.value])
    raise InvalidCondition(f"{ast.unparse(node)}: no distance or number")


def parse(text: str, cells: tuple[float, float] = (1.0, 1.0)) -> Condition:
    """The condition that a text states; InvalidCondition names the part that is wrong."""
    return _parsed(_tree(text), cells)


def _parsed(node: ast.expr, cells: tuple[float, float]) -> Condition:
    if isinstance(node, ast.BoolOp):
        parts = [_parsed(v, cells) for v in node.values]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node.op, ast.And) else out | p
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_parsed(node.operand, cells)
    if isinstance(node, ast.Compare) and all(type(o) in _COMPARE for o in node.ops):
        sides = [_column(n, cells) for n in (node.left, *node.comparators)]
        test = F.lit(True)
        for a, o, b in zip(sides, node.ops, sides[1:], strict=False):
            test = test & getattr(a, _COMPARE[type(o)])(b)
        return Condition(lambda: test, _reach(node, cells))
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        if node.func.id not in CALLS:
            raise InvalidCondition(f"{node.func.id}: no such condition")
        try:
            return CALLS[node.func.id](*[ast.literal_eval(a) for a in node.args], **{k.arg: ast.literal_eval(k.value) for k in node.keywords})
        except (TypeError, ValueError) as e:
            raise InvalidCondition(f"{node.func.id}: {e}") from None
    raise InvalidCondition(f"{ast.unparse(node)}: no condition")


def _reach(node: ast.Compare, cells: tuple[float, float]) -> float | None:
    """The bound of D <= number, if the comparison is one."""
    if len(node.ops) == 1 and isinstance(node.ops[0], ast.Lt | ast.LtE) and isinstance(node.left, ast.Name) and node.left.id in ("D", "C") and isinstance(node.comparators[0], ast.Constant):
        return float(node.comparators[0].value) * (1.0 if node.left.id == "D" else max(cells))
    return None


def used(text: str) -> list[str]:
    """Distances and calls that a text uses, sorted."""
    found = set()
    for n in ast.walk(_tree(text)):
        if isinstance(n, ast.Subscript):
            found.add(ast.unparse(n))
        elif isinstance(n, ast.Name) and (n.id in NAMES or n.id in CALLS):
            found.add(n.id)
    return sorted(found)


def verify(text: str) -> str | None:
    """Why a text is no condition, or None."""
    try:
        parse(text)
    except InvalidCondition as e:
        return str(e)
    return None


def result_type(text: str) -> str:
    """How its neighbours are found: self_only, always_true, by_key, within_reach or complex."""
    c = parse(text)
    return {"self": "self_only", "all": "always_true"}.get(c.kind) or ("by_key" if c.key is not None else "within_reach" if c.reach is not None else "complex")
