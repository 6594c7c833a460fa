"""Box geometry as SQL expressions over prefixed columns (ax0, ay0, ax1, ay1 and so on).

The text is valid in Spark SQL and ANSI SQL alike; everything stays inside generated code.
"""

from __future__ import annotations


def area(a: str) -> str:
    return f"(greatest(0, {a}x1 - {a}x0) * greatest(0, {a}y1 - {a}y0))"


def inner(a: str, b: str) -> str:
    """Area shared by two boxes."""
    return f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) * greatest(0, least({a}y1, {b}y1) - greatest({a}y0, {b}y0)))"


def iou(a: str, b: str) -> str:
    return f"({inner(a, b)} / greatest(0.01, {area(a)} + {area(b)} - {inner(a, b)}))"


def overlap(a: str, b: str) -> str:
    """Share of a that b covers."""
    return f"({inner(a, b)} / greatest(0.001, {area(a)}))"


def intersects(a: str, b: str, inset: float = 0.0) -> str:
    return f"({a}x0 + {inset} < {b}x1 AND {a}x1 - {inset} > {b}x0 AND {a}y0 + {inset} < {b}y1 AND {a}y1 - {inset} > {b}y0)"


def centre_inside(a: str, b: str) -> str:
    return f"(({a}x0 + {a}x1) / 2 BETWEEN {b}x0 AND {b}x1 AND ({a}y0 + {a}y1) / 2 BETWEEN {b}y0 AND {b}y1)"


def distance(a: str, b: str, kind: str = "'figure'") -> str:
    """From a visual to a caption: 10000 if they share too little width or lie too far apart; else the gap, plus a
    little for misaligned sides, plus 12 on the wrong side: a figure's caption above it, a table's below. `kind` is SQL."""
    across = f"(greatest(0, least({a}x1, {b}x1) - greatest({a}x0, {b}x0)) / greatest(1, least({a}x1 - {a}x0, {b}x1 - {b}x0)))"
    gap = f"greatest(0, {b}y0 - {a}y1, {a}y0 - {b}y1)"
    wrong = f"CASE WHEN {kind} = 'figure' THEN {a}y0 > {b}y1 ELSE {a}y1 < {b}y0 END"
    return f"(CASE WHEN {across} < 0.15 OR {gap} > 160 THEN 10000 ELSE {gap} + 0.03 * abs({a}x0 + {a}x1 - {b}x0 - {b}x1) + CASE WHEN {wrong} THEN 12 ELSE 0 END END)"
