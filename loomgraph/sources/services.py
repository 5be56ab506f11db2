"""Service boundaries: gRPC methods of proto files, GraphQL schemas and operations, tRPC procedures; and which Go files a default build takes."""

from __future__ import annotations

import re

GO_TAGS = frozenset("linux amd64 unix cgo gc".split())
_SYSTEMS = frozenset("aix android darwin dragonfly freebsd hurd illumos ios js linux nacl netbsd openbsd plan9 solaris wasip1 windows zos".split())
_MACHINES = frozenset("386 amd64 arm arm64 loong64 mips mips64 mips64le mipsle ppc64 ppc64le riscv64 s390x sparc64 wasm".split())
_SERVICE = re.compile(r"\b(?P<kind>service|message|enum)\s+(?P<name>\w+)\s*\{|\brpc\s+(?P<rpc>\w+)\s*\(|[{}]")
_OPERATION = re.compile(r"\b(query|mutation|subscription)\b\s*(\w+)?\s*(?:\([^()]*\))?\s*(?:@\w+(?:\([^()]*\))?\s*)*\{")
_TRPC = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*)\s*:\s*[\w$.]*[pP]rocedure\b(?:\s*\.\s*(?!query\b|mutation\b|subscription\b)\w+\s*\([^;{}]*?\))*\s*\.\s*(query|mutation|subscription)\s*\(")


def proto_symbols(text: str) -> list[tuple[str, str, str, str | None, int]]:
    """(kind, name, qualified name, container, line) of services with their rpcs, messages and enums; nested ones are qualified."""
    clean = re.sub(r"//[^\n]*|/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    out, open_ = [], []
    for m in _SERVICE.finditer(clean):
        names = [n for n in open_ if n]
        line = 1 + clean.count("\n", 0, m.start())
        if m["name"]:
            out.append((m["kind"], m["name"], ".".join([*names, m["name"]]), ".".join(names) or None, line))
            open_.append(m["name"])
        elif m["rpc"]:
            out.append(("rpc", m["rpc"], ".".join([*names, m["rpc"]]), ".".join(names) or None, line))
        elif m[0] == "{":
            open_.append("")
        elif open_:
            open_.pop()
    return out


def _fields(text: str, at: int) -> list[str]:
    """The names directly inside the braces that open before `at`; an alias gives the field it stands for."""
    out, depth, i = [], 1, at
    for m in re.finditer(r'"(?:\\.|[^"\\])*"|#[^\n]*|\.\.\.\s*(?:on\s+)?\w*|[{}()]|@\w+|([A-Za-z_]\w*)\s*(?::\s*([A-Za-z_]\w*))?', text[at:]):
        if m[0] in "{(":
            depth += 1
        elif m[0] in "})":
            depth -= 1
            if not depth:
                break
        elif m[1] and depth == 1:
            out.append(m[2] or m[1])
    return out


def graphql_operations(text: str) -> list[tuple[str, float]]:
    """("query Name", .75) of each named operation and ("query field", .78) of its root fields."""
    out = []
    for m in _OPERATION.finditer(text):
        if m[2]:
            out.append((f"{m[1]} {m[2]}", 0.75))
        out += [(f"{m[1]} {f}", 0.78) for f in _fields(text, m.end())]
    return list(dict.fromkeys(out))


def graphql_schema(text: str) -> list[tuple[str, str]]:
    """(operation, field) of the root types' fields, declared or extended."""
    out = []
    for m in re.finditer(r"\b(?:extend\s+)?type\s+(Query|Mutation|Subscription)\b[^{]*\{(.*?)^\s*\}", text, re.S | re.M):
        out += [(m[1].lower(), f) for f in re.findall(r"^\s*([A-Za-z_]\w*)\s*(?:\([^)]*\))?\s*:", m[2], re.M)]
    return list(dict.fromkeys(out))


def trpc_procedures(text: str) -> list[str]:
    """"query name" of each `name: publicProcedure.query(` and the like."""
    return list(dict.fromkeys(f"{m[2]} {m[1]}" for m in _TRPC.finditer(text)))


def go_default_build(path: str, text: str) -> bool:
    """Whether a default build on Linux and amd64 takes the file, by its name's last parts and its build line."""
    parts = path.rpartition("/")[2].removesuffix(".go").removesuffix("_test").split("_")[1:]
    if parts and parts[-1] in _MACHINES:
        if parts[-1] not in GO_TAGS or (len(parts) > 1 and parts[-2] in _SYSTEMS and parts[-2] not in GO_TAGS):
            return False
    elif parts and parts[-1] in _SYSTEMS and parts[-1] not in GO_TAGS:
        return False
    line = re.search(r"^//go:build\s+(.+)$", text.partition("\npackage ")[0], re.M)
    if not line:
        return True
    tokens, at = re.findall(r"\|\||&&|[!()]|[\w.]+", line[1]), 0

    def either() -> bool:
        nonlocal at
        value = both()
        while at < len(tokens) and tokens[at] == "||":
            at += 1
            value = both() or value
        return value

    def both() -> bool:
        nonlocal at
        value = one()
        while at < len(tokens) and tokens[at] == "&&":
            at += 1
            value = one() and value
        return value

    def one() -> bool:
        nonlocal at
        token = tokens[at] if at < len(tokens) else ""
        at += 1
        if token == "!":
            return not one()
        if token == "(":
            value = either()
            at += 1
            return value
        return token in GO_TAGS or token.startswith("go1.")

    return either()
