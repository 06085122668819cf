"""Tree edit distance based similarity of tables, vectorised over a column of table pairs."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (label, spans, text, children)


def table_tree(html: str) -> Tree:
    """The tree of a table's rows and cells: a cell has its spans and its text."""
    rows = []
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|</table>|\Z)", html):
        cells = []
        for attrs, body in re.findall(r"(?is)<t[dh]\b([^>]*)>(.*?)(?=<t[dh]\b|</t[dh]>|</tr>|\Z)", row):
            span = lambda n, a=attrs: int((re.search(rf'{n}\s*=\s*"?(\d+)', a, re.I) or [0, 1])[1])
            cells.append(("td", (span("colspan"), span("rowspan")), " ".join(re.sub(r"<[^>]*>", " ", body).split()), ()))
        rows.append(("tr", (), "", tuple(cells)))
    return ("table", (), "", tuple(rows))


def edit_share(a: str, b: str) -> float:
    """Edits from a to b over the longer length."""
    if a == b:
        return 0.0
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1] / max(len(a), len(b), 1)


def _rename(a: Tree, b: Tree) -> float:
    if a[0] != b[0] or a[1] != b[1]:
        return 1.0
    return edit_share(a[2], b[2]) if a[0] == "td" else 0.0


def _postorder(root: Tree) -> tuple[list[Tree], list[int]]:
    """Nodes in postorder, and of each its leftmost leaf."""
    nodes, left = [], []

    def walk(t: Tree) -> int:
        first = None
        for kid in t[3]:
            leaf = walk(kid)
            first = leaf if first is None else first
        nodes.append(t)
        left.append(len(nodes) - 1 if first is None else first)
        return left[-1]

    walk(root)
    return nodes, left


def tree_distance(a: Tree, b: Tree) -> float:
    """The least cost of deletions, insertions and renamings, over the key roots of both trees."""
    (x, lx), (y, ly) = _postorder(a), _postorder(b)
    roots = lambda left: sorted({v: k for k, v in enumerate(left)}.values())
    out = np.zeros((len(x), len(y)))
    for i in roots(lx):
        for j in roots(ly):
            n, m = i - lx[i] + 2, j - ly[j] + 2
            d = np.zeros((n, m))
            d[:, 0], d[0, :] = range(n), range(m)
            for p in range(1, n):
                for q in range(1, m):
                    u, v = lx[i] + p - 1, ly[j] + q - 1
                    both = lx[u] == lx[i] and ly[v] == ly[j]
                    inner = d[p - 1, q - 1] + _rename(x[u], y[v]) if both else d[lx[u] - lx[i], ly[v] - ly[j]] + out[u, v]
                    d[p, q] = min(d[p - 1, q] + 1, d[p, q - 1] + 1, inner)
                    if both:
                        out[u, v] = d[p, q]
    return float(out[-1, -1])


def teds(a: str, b: str) -> float:
    """1 for equal tables, 0 for tables with nothing in common."""
    s, t = table_tree(a), table_tree(b)
    size = max(len(_postorder(s)[0]), len(_postorder(t)[0]))
    return 1 - tree_distance(s, t) / size


def teds_column(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else teds(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(a, b)
