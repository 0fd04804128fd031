"""Untrusted input that reaches a dangerous call within one function."""

from __future__ import annotations

import ast

from quarrylens.functions.lifetimes import Function, dotted
from quarrylens.functions.nodes import walk

REQUEST_PARTS = set("args form values json data files cookies headers get GET POST query_params path_params body".split())
STRING_METHODS = set(
    "strip lstrip rstrip lower upper title capitalize replace format join encode decode format_map removeprefix removesuffix "
    "expandtabs swapcase casefold zfill".split()
)
SHELL_METHODS = set("Popen call check_call check_output run".split())
REQUESTS = ("request.", "flask.request.")


def shell_true(call: ast.Call) -> bool:
    return any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in call.keywords)


def is_source(node: ast.AST) -> bool:
    """Whether an expression is untrusted input itself: input(), the environment, argv, a web request."""
    if isinstance(node, ast.Call):
        name = dotted(node.func)
        if name is not None and (name in ("input", "os.getenv", "os.environ.get") or name.startswith(REQUESTS)):
            return True
    name = dotted(node.value if isinstance(node, ast.Subscript) else node)
    if name in ("os.environ", "sys.argv"):
        return True
    if name is None or not name.startswith(REQUESTS):
        return False
    parts = name.split(".")
    return parts[parts.index("request") + 1] in REQUEST_PARTS


def is_tainted(node: ast.AST | None, names: set[str]) -> bool:
    if node is None:
        return False
    if is_source(node):
        return True
    match node:
        case ast.Name():
            return node.id in names
        case ast.Subscript() | ast.Attribute():
            return is_tainted(node.value, names)
        case ast.JoinedStr():
            return any(isinstance(v, ast.FormattedValue) and is_tainted(v.value, names) for v in node.values)
        case ast.BinOp(op=ast.Add() | ast.Mod()):
            return is_tainted(node.left, names) or is_tainted(node.right, names)
        case ast.Call(func=ast.Name(id="str")):
            return any(is_tainted(a, names) for a in node.args)
        case ast.Call(func=ast.Attribute(attr=how)) if how in STRING_METHODS:
            return is_tainted(node.func.value, names) or any(is_tainted(a, names) for a in node.args)
    return False


def _names(target: ast.AST) -> list[str]:
    if isinstance(target, (ast.Tuple, ast.List)):
        return [n for e in target.elts for n in _names(e)]
    return [target.id] if isinstance(target, ast.Name) else []


def tainted_names(nodes: list[ast.AST]) -> set[str]:
    """Names that an assignment taints, to a fixed point."""
    bound = []
    for n in nodes:
        if isinstance(n, ast.Assign):
            bound.append(([x for t in n.targets for x in _names(t)], n.value))
        elif isinstance(n, (ast.AnnAssign, ast.AugAssign)) and n.value is not None:
            bound.append((_names(n.target), n.value))
    out: set[str] = set()
    while True:
        new = {x for names, value in bound if is_tainted(value, out) for x in names} - out
        if not new:
            return out
        out |= new


def sink(call: ast.Call, qualname: str | None) -> tuple[str, list[ast.expr]] | None:
    """Label of a dangerous call and the arguments that must be clean."""
    if qualname in ("eval", "exec"):
        return qualname, call.args
    if qualname in ("os.system", "os.popen"):
        return qualname, call.args[:1]
    parts = (qualname or "").split(".")
    if parts[0] == "subprocess" and parts[-1] in SHELL_METHODS:
        return (f"{qualname}(shell=True)", call.args[:1]) if shell_true(call) else None
    if isinstance(call.func, ast.Attribute) and call.func.attr in ("execute", "executescript"):
        return f"{call.func.attr}()", call.args[:1]
    return None


def flows(tree_nodes: list[ast.AST], qualname):
    """(call, sink label) of each flow, function by function; qualname resolves a callee."""
    for f in tree_nodes:
        if not isinstance(f, Function):
            continue
        nodes = walk(f)
        names = tainted_names(nodes)
        for n in nodes:
            if isinstance(n, ast.Call) and (hit := sink(n, qualname(n.func))) and any(is_tainted(a, names) for a in hit[1]):
                yield n, hit[0]
