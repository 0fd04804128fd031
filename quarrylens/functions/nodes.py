"""Syntax trees, walked with the children of each node found once."""

from __future__ import annotations

import ast


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below node, as ast.iter_child_nodes() gives them; they are kept on the node, so a tree must not change after."""
    try:
        return node.below
    except AttributeError:
        pass
    out = []
    for name in node._fields:
        v = getattr(node, name, None)
        if isinstance(v, ast.AST):
            out.append(v)
        elif isinstance(v, list):
            out += [x for x in v if isinstance(x, ast.AST)]
    node.below = out
    return out


def walk(*roots: ast.AST) -> list[ast.AST]:
    """The nodes of the trees below roots and the roots, breadth first."""
    out = list(roots)
    for n in out:
        out += children(n)
    return out
