"""Data flows within one function: what its results take from calls, and which calls its parameters reach.

A flow is (callee, kind, forward): forward flows hand a parameter, or something made of one, to the callee; the others carry a
callee's result into the function's own. Callees are resolved by the joins of the code module."""

from __future__ import annotations

import ast
import re

_SKIP = frozenset("if for while switch catch return function new super typeof await sizeof print len str int list dict set".split())


def _name(call: ast.Call) -> str | None:
    return call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else None


def _calls(node: ast.AST | None) -> list[str]:
    return [n for c in ast.walk(node) if isinstance(c, ast.Call) and (n := _name(c))] if node is not None else []


def _own(function: ast.AST) -> list[ast.AST]:
    """The nodes of a function without those of functions and classes inside it, in order."""
    out, todo = [], list(ast.iter_child_nodes(function))[::-1]
    while todo:
        node = todo.pop()
        out.append(node)
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)):
            todo += list(ast.iter_child_nodes(node))[::-1]
    return out


def _base(node: ast.AST) -> str | None:
    """The variable at the start of x.a.b or x[0]."""
    while isinstance(node, (ast.Attribute, ast.Subscript)):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def python_flows(function: ast.FunctionDef | ast.AsyncFunctionDef) -> list[tuple[str, str, bool]]:
    nodes, out = _own(function), []
    for node in nodes:
        if isinstance(node, ast.Return) and node.value is not None:
            out += [(n, kind, False) for n, kind in _returned(node.value)]
    assigned: dict[str, list[tuple[str, str]]] = {}
    for node in nodes:
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                value = node.value.value if isinstance(node.value, ast.Await) else node.value
                if isinstance(target, ast.Name):
                    kind = "assigned_return_flow" if isinstance(value, ast.Call) else "expression_assigned_return_flow"
                    assigned.setdefault(target.id, []).extend((n, kind) for n in _calls(value)[: 1 if isinstance(value, ast.Call) else None])
                elif isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, ast.Call) and (n := _name(value)):
                    for x in target.elts:
                        if isinstance(x, ast.Name):
                            assigned.setdefault(x.id, []).append((n, "destructured_return_flow"))
    branches = set()
    for node in nodes:
        if isinstance(node, ast.If) and node.orelse:
            sides = [{t.id for s in side for a in ast.walk(s) if isinstance(a, ast.Assign) and isinstance(a.value, ast.Call) for t in a.targets if isinstance(t, ast.Name)} for side in (node.body, node.orelse)]
            branches |= sides[0] & sides[1]
    for node in nodes:
        if isinstance(node, ast.Return) and node.value is not None and (var := _base(node.value)) in assigned:
            for n, kind in assigned[var]:
                out.append((n, "branch_assigned_return_flow" if var in branches else "property_assigned_return_flow" if not isinstance(node.value, ast.Name) else kind, False))
    return _unique(out + _forwarded(function, nodes))


def _returned(value: ast.AST) -> list[tuple[str, str]]:
    if isinstance(value, ast.Await):
        return _returned(value.value)
    if isinstance(value, ast.IfExp):
        return [(n, "ternary_return_flow") for side in (value.body, value.orelse) for n in _calls(side)]
    if isinstance(value, ast.BoolOp) and isinstance(value.op, ast.Or):
        return [(n, "fallback_return_flow") for side in value.values for n in _calls(side)]
    if isinstance(value, ast.Call):
        return [(n, "return_flow")] if (n := _name(value)) else []
    return [(n, "return_flow") for n in _calls(value)]


def _forwarded(function, nodes: list[ast.AST]) -> list[tuple[str, str, bool]]:
    a = function.args
    parameters = {x.arg for x in [*a.posonlyargs, *a.args, *a.kwonlyargs]} - {"self", "cls"}
    carries = {p: "argument_forward_flow" for p in parameters}  # variable -> how it holds a parameter
    out = []

    def literal(node: ast.AST) -> bool:
        parts = [*node.values] if isinstance(node, ast.Dict) else node.elts if isinstance(node, (ast.List, ast.Tuple, ast.Set)) else []
        return any(isinstance(x, ast.Name) and x.id in carries for x in parts)

    for node in nodes:
        if isinstance(node, ast.Assign) and len(node.targets) == 1:
            target, value = node.targets[0], node.value
            if isinstance(target, ast.Name):
                if isinstance(value, ast.Name) and value.id in carries:
                    carries.setdefault(target.id, "alias_forward_flow")
                elif isinstance(value, (ast.Attribute, ast.Subscript)) and _base(value) in parameters:
                    carries.setdefault(target.id, "parameter_property_alias_forward_flow")
                elif isinstance(value, ast.Dict) and literal(value):
                    carries.setdefault(target.id, "object_literal_forward_flow")
                elif isinstance(value, (ast.List, ast.Tuple, ast.Set)) and literal(value):
                    carries.setdefault(target.id, "collection_literal_forward_flow")
            elif isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, ast.Name) and value.id in carries:
                for x in target.elts:
                    if isinstance(x, ast.Name):
                        carries.setdefault(x.id, "destructured_alias_forward_flow")
            elif isinstance(target, ast.Attribute) and isinstance(value, ast.Name) and value.id in carries and (b := _base(target)) not in (None, "self"):
                carries.setdefault(b, "object_field_forward_flow")
            elif isinstance(target, ast.Subscript) and isinstance(value, ast.Name) and value.id in carries and (b := _base(target)):
                carries.setdefault(b, "collection_element_forward_flow")
        elif isinstance(node, ast.For) and isinstance(node.target, ast.Name) and isinstance(node.iter, ast.Name) and node.iter.id in carries:
            carries.setdefault(node.target.id, "callback_element_forward_flow")
        elif isinstance(node, ast.comprehension) and isinstance(node.target, ast.Name) and isinstance(node.iter, ast.Name) and node.iter.id in carries:
            carries.setdefault(node.target.id, "callback_element_forward_flow")
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr in ("append", "add", "extend", "insert") and isinstance(node.func.value, ast.Name):
            if any(isinstance(x, ast.Name) and x.id in carries for x in node.args):
                carries.setdefault(node.func.value.id, "collection_element_forward_flow")
    for node in nodes:
        if isinstance(node, ast.Call) and (callee := _name(node)) and callee not in _SKIP:
            for x in [*node.args, *(k.value for k in node.keywords)]:
                x = x.value if isinstance(x, (ast.Starred, ast.Await)) else x
                if isinstance(x, ast.Name) and x.id in carries:
                    out.append((callee, carries[x.id], True))
                elif isinstance(x, (ast.Attribute, ast.Subscript)) and _base(x) in parameters:
                    out.append((callee, "parameter_property_forward_flow", True))
                elif literal(x):
                    out.append((callee, "direct_literal_forward_flow", True))
    return out


_CALLEE = r"(?:await\s+)?(?:[\w$]+(?:\.|->|::))*([A-Za-z_]\w*)\s*\("
_DIRECT = re.compile(r"\breturn\s+" + _CALLEE)
_TERNARY = re.compile(r"\breturn\b[^;\n?]*\?\s*" + _CALLEE + r"[^;\n]*?:\s*(?:" + _CALLEE + ")?")
_FALLBACK = re.compile(r"\breturn\s+(?:" + _CALLEE + r"[^;\n]*?)?(?:\|\||\?\?)\s*" + _CALLEE)
_ASSIGNED = re.compile(r"(?:\b(?:const|let|var|auto)\s+(?:mut\s+)?)?(\$?[A-Za-z_]\w*)\s*:?=\s*" + _CALLEE)
_UNPACKED = re.compile(r"(?:\b(?:const|let|var)\s+)?[{\[]?\s*((?:\w+\s*,\s*)+\w+)\s*[}\]]?\s*:?=\s*" + _CALLEE)
_BACK = re.compile(r"\breturn\s+(\$?[A-Za-z_]\w*)((?:\.|->)\w+)?\s*[;,}\n]")
_ALIAS = re.compile(r"(?:\b(?:const|let|var)\s+)?(\$?[A-Za-z_]\w*)\s*:?=\s*(\$?[A-Za-z_]\w*)(?:(\.|->)\w+)?\s*[;\n]")
_SIMPLE = re.compile(r"([A-Za-z_]\w*)\s*\(([^()\n]*)\)")
_ARGUMENT = re.compile(r"(\$?[A-Za-z_]\w*)((?:\.|->)\w+)?$")


def brace_flows(body: str, signature: str, name: str) -> list[tuple[str, str, bool]]:
    """The same of a brace language's function, by patterns over its body without comments and strings."""
    out, special = [], set()
    for pattern, kind in ((_TERNARY, "ternary_return_flow"), (_FALLBACK, "fallback_return_flow")):
        for m in pattern.finditer(body):
            out += [(n, kind, False) for n in m.groups() if n]
            special.add(m.start())
    out += [(m[1], "return_flow", False) for m in _DIRECT.finditer(body) if m.start() not in special]
    assigned = [(m[1], m[2], "assigned_return_flow") for m in _ASSIGNED.finditer(body)]
    assigned += [(v, m[2], "destructured_return_flow") for m in _UNPACKED.finditer(body) for v in re.split(r"\s*,\s*", m[1])]
    for m in _BACK.finditer(body):
        out += [(n, "property_assigned_return_flow" if m[2] else kind, False) for v, n, kind in assigned if v == m[1]]
    inside = signature.partition(f"{name}(")[2].partition(")")[0]
    parameters = {w for part in inside.split(",") for w in re.findall(r"\$?[A-Za-z_]\w*", part.partition("=")[0])}
    carries = {p: "argument_forward_flow" for p in parameters}
    for m in _ALIAS.finditer(body):
        if m[2] in carries:
            carries.setdefault(m[1], "parameter_property_alias_forward_flow" if m[3] else "alias_forward_flow")
    for m in _SIMPLE.finditer(body):
        for arg in map(str.strip, m[2].split(",")):
            x = _ARGUMENT.match(arg)
            if x and x[1] in carries:
                out.append((m[1], "parameter_property_forward_flow" if x[2] and x[1] in parameters else carries[x[1]], True))
    return _unique([f for f in out if f[0] not in _SKIP])


def _unique(flows: list[tuple[str, str, bool]]) -> list[tuple[str, str, bool]]:
    return list(dict.fromkeys(flows))
