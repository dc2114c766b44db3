"""Functions on arrays that take time in proportion to their length, as texts of SQL: a plan of many small calls takes seconds to build."""

from __future__ import annotations

#: Elements that are folded into one growing array; folds of more are folds of such parts, as each step copies what it grows.
PART = 64


def let(name: str, value: str, body: str) -> str:
    """`body` with a name for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def parts(name: str) -> str:
    """A named array cut into arrays of PART elements."""
    starts = f"CASE WHEN size({name}) > 0 THEN sequence(1, size({name}), {PART}) ELSE CAST(array() AS array<int>) END"
    return f"transform({starts}, _a -> slice({name}, _a, {PART}))"


def running_sums(numbers: str) -> str:
    """Sums of an array of ints up to each element, that element included: sums run within parts, and over the parts' totals."""
    grown = lambda array, value: f"aggregate({array}, array(0), (_d, _e) -> concat(_d, array(element_at(_d, -1) + {value})))"
    shifted = f"flatten(zip_with(_w, slice({grown('_w', 'element_at(_e, -1)')}, 1, size(_w)), (_p, _b) -> transform(slice(_p, 2, size(_p) - 1), _v -> _v + _b)))"
    return let("_n", numbers, let("_w", f"transform({parts('_n')}, _p -> {grown('_p', '_e')})", shifted))


def folded(array: str, start: str, step: str, state_type: str) -> str:
    """The state after each element, from a small state; `step` is of the state `s` and the element `x`.

    One pass finds the states between parts, another goes through each part from the state before it.
    """
    first, none = f"CAST({start} AS {state_type})", f"CAST(array() AS array<{state_type}>)"
    over = lambda array, state, now: f"aggregate({array}, named_struct('s', {state}, 'd', {none}), (_acc, _x) -> named_struct('s', {now}, 'd', concat(_acc.d, array({now})))).d"
    bound = lambda state, element: let("s", state, let("x", element, step))
    between = over("_cut", first, f"aggregate(_x, _acc.s, (s, x) -> {step})")
    within = over("_part", "_before", bound("_acc.s", "_x"))
    return let("_cut", let("_n", array, parts("_n")), f"flatten(zip_with(_cut, slice(concat(array({first}), {between}), 1, size(_cut)), (_part, _before) -> {within}))")
