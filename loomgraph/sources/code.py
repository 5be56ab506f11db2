"""Source trees as a property graph: files -> symbols and references (one Arrow pass) -> relations (joins).

Only the scan of a file's text is Python; every resolution is a join over symbol tables with explicit ambiguity counts. Python
is read with the standard library's parser, brace languages by declaration heads on text whose comments and strings are blanked,
formats by line patterns. Imports name the files they may mean, calls the type of their receiver where the function says it.
Files that are too large or minified give a failure row and no symbols. Relations carry a confidence and a resolution."""

from __future__ import annotations

import ast
import bisect
import hashlib
import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.session import materialize, ship_package
from loomgraph.sources import services
from loomgraph.sources.flows import brace_flows, python_flows

EXTENSIONS = {
    "py": "Python", "pyi": "Python", "pyw": "Python", "go": "Go", "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "java": "Java", "cs": "C#", "rs": "Rust", "php": "PHP", "c": "C", "h": "C", "cc": "C++", "cpp": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "m": "Objective-C", "mm": "Objective-C",
    "rb": "Ruby", "rake": "Ruby", "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "scala": "Scala", "sc": "Scala", "lua": "Lua", "r": "R", "jl": "Julia", "hs": "Haskell", "ml": "OCaml", "mli": "OCaml", "erl": "Erlang", "hrl": "Erlang",
    "ex": "Elixir", "exs": "Elixir", "clj": "Clojure", "cljs": "Clojure", "cljc": "Clojure", "dart": "Dart", "zig": "Zig", "fs": "F#", "fsi": "F#", "fsx": "F#", "pl": "Perl", "pm": "Perl", "sh": "Shell", "bash": "Shell", "zsh": "Shell",
    "groovy": "Groovy", "gradle": "Groovy", "cue": "CUE", "sol": "Solidity", "ps1": "PowerShell", "elm": "Elm", "nix": "Nix", "vue": "Vue", "svelte": "Svelte",
    "md": "Markdown", "markdown": "Markdown", "json": "JSON", "toml": "TOML", "tf": "HCL", "hcl": "HCL", "tfvars": "HCL", "css": "CSS", "scss": "CSS", "less": "CSS", "html": "HTML", "htm": "HTML", "xml": "XML", "yaml": "YAML", "yml": "YAML",
    "proto": "Protocol Buffers", "sql": "SQL", "mk": "Make", "graphql": "GraphQL", "gql": "GraphQL", "ini": "INI", "cfg": "INI", "txt": "Text", "rst": "reStructuredText",
}
NAMES = {"Dockerfile": "Dockerfile", "Containerfile": "Dockerfile", "Makefile": "Make", "GNUmakefile": "Make", "Rakefile": "Ruby", "Gemfile": "Ruby", "Jenkinsfile": "Groovy", "go.mod": "Go module", "kustomization": "YAML"}
SHEBANGS = {"python": "Python", "node": "JavaScript", "deno": "TypeScript", "php": "PHP", "bash": "Shell", "sh": "Shell", "zsh": "Shell", "dash": "Shell", "ksh": "Shell", "ruby": "Ruby", "perl": "Perl", "lua": "Lua", "Rscript": "R", "julia": "Julia", "groovy": "Groovy", "escript": "Erlang", "elixir": "Elixir"}
MAX_BYTES = 1 << 20
SYMBOL = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, body_hash string, language string, container string"
ROW = "record string, path string, language string, kind string, name string, qualified string, container string, start_line int, end_line int, signature string, body_hash string, receiver string, detail string"

_HEADS = {
    "Go": [("method", r"^func\s*\(\s*\w+\s+\*?(?P<in>\w+)[^)]*\)\s*(?P<name>\w+)\s*\("), ("function", r"^func\s+(?P<name>\w+)\s*[(\[]"), ("interface", r"^type\s+(?P<name>\w+)\s+interface\b"), ("type", r"^type\s+(?P<name>\w+)\s+struct\b")],
    "TypeScript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(?P<name>\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(?P<name>\w+)"), ("function", r"^\s*(?:export\s+)?const\s+(?P<name>\w+)\s*=\s*(?:async\s*)?\([^)]*\)[^=]*=>\s*\{"), ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(?P<name>\w+)\s*\([^;{]*\)[^;{]*\{")],
    "Java": [("class", r"^\s*(?:\w+\s+)*class\s+(?P<name>\w+)"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(?P<name>\w+)"), ("enum", r"^\s*(?:\w+\s+)*enum\s+(?P<name>\w+)"), ("method", r"^\s+(?:[\w<>\[\],.?]+\s+)+(?P<name>\w+)\s*\([^;{]*\)[^;{]*[{;]")],
    "Rust": [("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"), ("trait", r"^\s*(?:pub\s+)?trait\s+(?P<name>\w+)"), ("enum", r"^\s*(?:pub\s+)?enum\s+(?P<name>\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(?P<name>\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(?P<name>\w+)")],
    "PHP": [("class", r"^\s*(?:abstract\s+|final\s+)*class\s+(?P<name>\w+)"), ("interface", r"^\s*interface\s+(?P<name>\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+(?P<name>\w+)")],
}
_HEADS["JavaScript"], _HEADS["C#"] = _HEADS["TypeScript"], _HEADS["Java"]
_FORMATS = {
    "Markdown": ("section", r"^#{1,6}\s+(?P<name>.+?)\s*#*$"), "TOML": ("section", r"^\[+(?P<name>[^\]]+)\]+"), "JSON": ("setting", r'^\s{1,4}"(?P<name>[^"]+)"\s*:'), "Make": ("target", r"^(?P<name>[\w./-]+)\s*:(?!=)"),
    "CSS": ("block", r"^(?P<name>[.#@\w][^{]*?)\s*\{"), "HCL": ("block", r'^(?P<name>\w+(?:\s+"[^"]+")*)\s*\{'), "Dockerfile": ("stage", r"^FROM\s+\S+(?:\s+[Aa][Ss]\s+(?P<name>\S+))?"), "YAML": ("section", r"^(?P<name>[\w.-]+):"),
    "HTML": ("section", r"<h[1-6][^>]*>(?P<name>[^<]+)</h[1-6]>"), "SQL": ("table", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:table|view|function)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)"),
}
_KEYWORDS = set("if for while switch catch return function new super this typeof await match sizeof using lock foreach elif else do try throw var let const func fn class def print".split())
_SCOPES = {"class", "interface", "enum", "struct", "trait", "impl", "type"}
_CALL = re.compile(r"(?:(?P<recv>[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)(?:\.|->|::))?(?P<name>[A-Za-z_]\w*)\s*\(")
_TESTS = re.compile(r"^(?:Test|test_?)(?P<a>\w+)$|^(?P<b>\w+?)_?[Tt]est$")
_ROUTE = re.compile(r"""\b(?:app|router|r|mux|http|server|api|e|g)\.(?:get|post|put|delete|patch|GET|POST|PUT|DELETE|PATCH|HandleFunc|Handle|route)\(\s*["'`](/[^"'`]*)["'`]|@(?:app|router|bp)\.(?:route|get|post|put|delete)\(\s*["'](/[^"']*)["']""")
_HTTP = re.compile(r"""\b(?:fetch|axios(?:\.\w+)?|requests\.\w+|http\.(?:Get|Post)|httpx\.\w+)\(\s*["'`](?:https?://[^/"'`]+)?(/[^"'`?#]*)""")
_EMIT, _LISTEN = re.compile(r"""\.(?:emit|publish|dispatch|broadcast)\(\s*["'`]([\w:.-]+)["'`]"""), re.compile(r"""\.(?:on|once|subscribe|addEventListener|addListener)\(\s*["'`]([\w:.-]+)["'`]""")
_IMPORTS = {
    "Go": re.compile(r'^\s*(?:import\s+)?(?:\w+\s+)?"([\w./-]+)"\s*$', re.M), "Java": re.compile(r"^\s*import\s+(?:static\s+)?([\w.]+)", re.M), "C#": re.compile(r"^\s*using\s+([\w.]+)\s*;", re.M),
    "Rust": re.compile(r"^\s*use\s+([\w:]+)", re.M), "PHP": re.compile(r"^\s*use\s+([\w\\]+)", re.M), "TypeScript": re.compile(r"""(?:import|export)[^'"\n]*from\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]"""),
}
_IMPORTS["JavaScript"] = _IMPORTS["TypeScript"]
_NAMED = re.compile(r"""(?:import|export)\s+(?:type\s+)?([^'"();]*?)\s*from\s+['"]([^'"]+)['"]|(?:const|let|var)\s+(\{[^}]*\}|\w+)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)""")
_SCRIPT_ENDS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".d.ts", "/index.ts", "/index.tsx", "/index.js"]
_PACKAGE = {"Java": re.compile(r"^\s*package\s+([\w.]+)", re.M), "PHP": re.compile(r"^\s*namespace\s+([\w\\]+)", re.M)}
_LOCAL = {
    "TypeScript": [("local", r"\b(?:const|let|var)\s+(?P<v>\w+)\s*(?::[^=;]+)?=\s*new\s+(?P<t>[A-Z]\w*)"), ("local", r"\b(?:const|let|var)\s+(?P<v>\w+)\s*:\s*(?P<t>[A-Z]\w*)\b"), ("factory", r"\b(?:const|let|var)\s+(?P<v>\w+)\s*=\s*(?P<t>[a-z]\w*)\s*\(")],
    "Java": [("local", r"\b(?P<t>[A-Z]\w*)(?:<[^;>]*>)?\s+(?P<v>[a-z]\w*)\s*=")], "PHP": [("local", r"(?P<v>\$\w+)\s*=\s*new\s+(?P<t>[A-Z]\w*)")],
    "Go": [("local", r"\b(?P<v>\w+)\s*:=\s*&?(?P<t>[A-Z]\w*)\s*\{"), ("local", r"\bvar\s+(?P<v>\w+)\s+\*?(?P<t>[A-Z]\w*)\b"), ("factory", r"\b(?P<v>\w+)\s*:=\s*(?P<t>\w+)\s*\(")],
    "Rust": [("local", r"\blet\s+(?:mut\s+)?(?P<v>\w+)\s*=\s*(?P<t>[A-Z]\w*)(?:::\w+\(|\s*\{)")],
}
_LOCAL["JavaScript"], _LOCAL["C#"] = _LOCAL["TypeScript"], _LOCAL["Java"]
_LOCAL = {k: [(how, re.compile(p)) for how, p in v] for k, v in _LOCAL.items()}
_PARAMETER = {"TypeScript": re.compile(r"(?P<v>\w+)\??\s*:\s*(?P<t>[A-Z]\w*)"), "Java": re.compile(r"\b(?P<t>[A-Z]\w*)(?:<[^>]*>)?\s+(?P<v>[a-z]\w*)\s*[,)]"), "Go": re.compile(r"\b(?P<v>\w+)\s+\*?(?P<t>[A-Z]\w*)\s*[,)]"), "PHP": re.compile(r"\b(?P<t>[A-Z]\w*)\s+(?P<v>\$\w+)"), "Rust": re.compile(r"\b(?P<v>\w+)\s*:\s*&?(?:mut\s+)?(?P<t>[A-Z]\w*)")}
_PARAMETER["JavaScript"], _PARAMETER["C#"] = _PARAMETER["TypeScript"], _PARAMETER["Java"]
_RETURNS = {"TypeScript": re.compile(r"\)\s*:\s*(?:Promise<)?([A-Z]\w*)"), "Java": re.compile(r"\b([A-Z]\w*)(?:<[^>]*>)?\s+\w+\s*\("), "Go": re.compile(r"\)\s*\(?\*?([A-Z]\w*)[^()]*\)?$"), "PHP": re.compile(r"\)\s*:\s*\??([A-Z]\w*)"), "Rust": re.compile(r"->\s*&?([A-Z]\w*)")}
_RETURNS["JavaScript"], _RETURNS["C#"] = _RETURNS["TypeScript"], _RETURNS["Java"]
_CHAIN = re.compile(r"(?:\bnew\s+(?P<ctor>[A-Z]\w*)\s*\([^()]*\)|(?P<recv>[A-Za-z_$][\w$]*)\s*\([^()]*\))\s*(?:\.|->)\s*(?P<name>[A-Za-z_]\w*)\s*\(")
_HEADER_BASES = re.compile(r"\b(extends|implements)\s+([\w\s,.<>]+?)(?=\bimplements\b|\{|$)")


# language, ignore rules ------------------------------------------------------------------------


def with_language(files: DataFrame) -> DataFrame:
    """files(path, content) with language, bytes and lines: by file name, then extension, then interpreter line; a header by what it holds."""
    base = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(base, r"\.([A-Za-z0-9]+)$", 1))
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    interpreter = F.regexp_replace(F.regexp_extract(F.substring("content", 1, 1024), r"^#!\s*\S*?(?:env\s+)?([A-Za-z]+)[0-9.]*\s*(?:\n|$)", 1), "[0-9.]+$", "")
    found = F.coalesce(F.try_element_at(table(NAMES), base), F.try_element_at(table(EXTENSIONS), ext), F.try_element_at(table(SHEBANGS), interpreter), F.lit("unknown"))
    header = F.when(F.col("content").rlike(r"(?m)^\s*@(?:interface|protocol|class|property)\b|^\s*#import\b"), "Objective-C").when(F.col("content").rlike(r"(?m)^\s*(?:class\s+\w+|namespace\s+\w+|template\s*<|using\s+\w+|(?:public|private|protected)\s*:)"), "C++").otherwise("C")
    found = F.when(ext == "h", header).otherwise(found)
    return files.withColumns({"language": found, "bytes": F.octet_length("content").cast("long"), "lines": F.size(F.split("content", "\n"))})


def ignored(path: Column, rules: list[tuple[str, bool]]) -> Column:
    """Ordered rules (pattern, ignore): the last that matches decides; unmatched paths are kept."""
    out = F.lit(False)
    for pattern, ignore in rules:
        out = F.when(path.rlike(pattern), F.lit(ignore)).otherwise(out)
    return out


# scanning --------------------------------------------------------------------------------------


def mask(text: str) -> str:
    """text of the same length with comments and string contents blanked; line breaks stay."""
    pattern = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _hash(text: str) -> str:
    return hashlib.sha256(" ".join(text.split()).encode()).hexdigest()[:16]


def _row(record, path, language, kind=None, name=None, qualified=None, container=None, start=None, end=None, signature=None, body=None, receiver=None, detail=None):
    return (record, path, language, kind, name, qualified, container, start, end, signature, body, receiver, detail)


def _types_of(language: str, signature: str, masked: str) -> dict[str, str]:
    """variable -> "how:type" of a function: its typed parameters, then its locals."""
    found = {m["v"]: f"param:{m['t']}" for m in _PARAMETER[language].finditer(signature)} if language in _PARAMETER else {}
    for how, pattern in _LOCAL.get(language, []):
        for m in pattern.finditer(masked):
            if m["t"] not in _KEYWORDS:
                found.setdefault(m["v"], f"{how}:{m['t']}")
    return found


def _references(path, language, body, owner, masked, signature=""):
    out, types = [], _types_of(language, signature, masked)
    for m in _CALL.finditer(masked):
        before = masked[max(0, m.start() - 12) : m.start()]
        if m["name"] not in _KEYWORDS and not re.search(r"\b(?:func|function|fn|def|class)\s+$", before) and not re.search(r"[)\]]\s*(?:\.|->)$", before):
            how = "async" if re.search(r"\b(?:await|go)\s+$", before[-8:]) else None
            out.append(_row("CALL", path, language, how, m["name"], owner, receiver=m["recv"], detail=types.get(m["recv"])))
    for m in _CHAIN.finditer(masked):
        if m["name"] not in _KEYWORDS and (m["ctor"] or m["recv"] not in _KEYWORDS):
            out.append(_row("CALL", path, language, None, m["name"], owner, receiver="()", detail=f"ctor:{m['ctor']}" if m["ctor"] else f"made:{m['recv']}"))
    for record, pattern in (("HANDLES_ROUTE", _ROUTE), ("HTTP_CALLS", _HTTP), ("EMITS", _EMIT), ("LISTENS_ON", _LISTEN)):
        out += [_row(record, path, language, name=re.sub(r":(\w+)|\[(\w+)\]|<(?:\w+:)?(\w+)>", lambda x: "{" + next(filter(None, x.groups())) + "}", next(filter(None, m.groups()))) if "/" in m[0] else m[1], qualified=owner) for m in pattern.finditer(body)]
    return out


def _flow(path, language, owner, flow):
    callee, kind, forward = flow
    return _row("FLOW", path, language, kind, callee, owner, detail="forward" if forward else "return")


_FIELD = {
    "Go": re.compile(r"\s+(?P<n>[A-Za-z_]\w*(?:\s*,\s*\w+)*)\s+[\w*\[\].]+"), "TypeScript": re.compile(r"\s+(?:(?:public|private|protected|readonly|static|declare)\s+)*(?P<n>[A-Za-z_#]\w*)[?!]?\s*(?::[^=(]+)?(?:=[^>].*)?;?\s*$"),
    "Java": re.compile(r"\s+(?:(?:public|private|protected|static|final|readonly|internal|volatile|transient)\s+)*[\w<>\[\],.?]+\s+(?P<n>[A-Za-z_]\w*)\s*(?:=.*)?(?:;|\{\s*get\b.*)"), "Rust": re.compile(r"\s+(?:pub(?:\([^)]*\))?\s+)?(?P<n>[a-z_]\w*)\s*:\s*[^:]"),
    "PHP": re.compile(r"\s+(?:(?:public|private|protected|static|readonly)\s+)+(?:\??[\w\\\\]+\s+)?\$(?P<n>\w+)\s*[;=]"),
}
_FIELD["JavaScript"], _FIELD["C#"] = _FIELD["TypeScript"], _FIELD["Java"]
_ACCESS = re.compile(r"(?P<ref>&\s*(?:mut\s+)?)?(?P<recv>\$?[A-Za-z_]\w*)(?:\.|->)(?P<name>[A-Za-z_]\w*)\b(?!\s*\()(?P<write>\s*(?:[-+*/%|&^]|<<|>>|\?\?)?=(?![=>])|\s*(?:\+\+|--))?")


def _accesses(path, language, owner, container, signature, masked, types):
    """Field accesses whose receiver's type is known: own fields .9, locals .85, parameters .83."""
    out, own = set(), {"this", "self", "$this"}
    receiver = re.match(r"func\s*\(\s*(\w+)\s", signature) if language == "Go" else None
    if receiver:
        own.add(receiver[1])
    for m in _ACCESS.finditer(masked):
        how, _, of = types.get(m["recv"], "").partition(":")
        sure, of = (0.9, container) if m["recv"] in own else (0.85, of) if how == "local" else (0.83, of) if how == "param" else (0, None)
        if of:
            out.add(("ACCESSES" if m["ref"] else "WRITES_FIELD" if m["write"] else "READS_FIELD", m["name"], of, sure))
    return [_row(record, path, language, name=name, qualified=owner, container=of, detail=str(sure)) for record, name, of, sure in sorted(out)]


def _import(path, language, module, local, original=None, candidates=(), key=None):
    """An import row: the files it may mean in order (signature), else the module name to look up (container); local and original names."""
    return _row("IMPORT", path, language, name=module, detail=local, receiver=original, signature="\n".join(candidates) or None, container=key)


def _python_files(path: str, module: str) -> list[str]:
    dots = len(module) - len(module.lstrip("."))
    tail = module[dots:].replace(".", "/")
    if dots:
        base = posixpath.dirname(path)
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
        roots = [base]
    else:
        roots = ["", "src", "lib"]
    whole = [posixpath.normpath(posixpath.join(r, tail)) if r or tail else "" for r in roots]
    return [f"{w}{end}" for w in whole if w and w != "." for end in (".py", "/__init__.py")]


def _imports(path: str, language: str, text: str) -> list[tuple]:
    """Import rows of a brace language, and the names by which others import the file (MODULE)."""
    out = []
    if language in ("TypeScript", "JavaScript"):
        for m in _NAMED.finditer(text):
            names, module = (m[1], m[2]) if m[2] else (m[3], m[4])
            files = [posixpath.normpath(posixpath.join(posixpath.dirname(path), module)) + end for end in _SCRIPT_ENDS] if module.startswith(".") else []
            inner = re.search(r"\{([^}]*)\}", names)
            for part in filter(None, (x.strip() for x in (inner[1].split(",") if inner else []))):
                original, _, local = re.sub(r"^type\s+", "", part.replace(":", " as ")).partition(" as ")
                out.append(_import(path, language, module, (local or original).strip(), original.strip(), files))
            rest = re.sub(r"\{[^}]*\}", "", names)
            for part in filter(None, (x.strip() for x in rest.split(","))):
                star = re.match(r"\*\s+as\s+(\w+)$", part)
                out.append(_import(path, language, module, star[1] if star else part, None if star or m[4] else "default", files))
            if not out or out[-1][4] != module:
                out.append(_import(path, language, module, "", None, files))
        for m in re.finditer(r"""^\s*import\s+['"]([^'"]+)['"]""", text, re.M):
            files = [posixpath.normpath(posixpath.join(posixpath.dirname(path), m[1])) + end for end in _SCRIPT_ENDS] if m[1].startswith(".") else []
            out.append(_import(path, language, m[1], "", None, files))
        return out
    if language == "Go":
        for block in re.finditer(r"^import\s*(?:\((.*?)\)|([^\n(]+))", text, re.M | re.S):
            for m in re.finditer(r'(?:(\w+|\.|_)\s+)?"([\w./-]+)"', block[1] or block[2]):
                out.append(_import(path, language, m[2], m[1] or m[2].rpartition("/")[2], None, (), "go"))
        return out
    for m in _IMPORTS.get(language, re.compile("(?!)")).finditer(text):
        module = next(filter(None, m.groups()))
        last = re.split(r"[./:\\]+", module)[-1]
        files = []
        if language == "Rust" and module.startswith("crate::"):
            parts = module.split("::")[1:]
            root = path.partition("src/")[0] + "src/" if "src/" in path else ""
            files = [root + "/".join(parts[:n]) + end for n in range(len(parts), 0, -1) for end in (".rs", "/mod.rs")]
        out.append(_import(path, language, module, last, last, files, language if language in _PACKAGE else None))
    if language in _PACKAGE and (m := _PACKAGE[language].search(text)):
        sign = "." if language == "Java" else "\\"
        out.append(_row("MODULE", path, language, name=m[1] + sign + posixpath.splitext(posixpath.basename(path))[0], container=language))
    return out


def _scan_python(path, text):
    out, lines = [], text.split("\n")

    def named(node) -> str | None:
        """The type an annotation names."""
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value if node.value.isidentifier() else None
        return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None

    def typed(function) -> dict[str, str]:
        found = {}
        for arg in [*function.args.posonlyargs, *function.args.args, *function.args.kwonlyargs]:
            if arg.annotation is not None and (t := named(arg.annotation)):
                found[arg.arg] = f"param:{t}"
        for node in ast.walk(function):
            target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else node.target if isinstance(node, ast.AnnAssign) else None
            if isinstance(target, ast.Name):
                if isinstance(node, ast.AnnAssign) and (t := named(node.annotation)):
                    found.setdefault(target.id, f"local:{t}")
                elif isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name):
                    made = node.value.func.id
                    found.setdefault(target.id, f"local:{made}" if made[:1].isupper() else f"factory:{made}")
        return found

    def walk(node, owner, inside_class, types):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                qualified = f"{owner}.{child.name}" if owner else child.name
                body = "\n".join(lines[child.lineno - 1 : child.end_lineno])
                head = " ".join(lines[child.lineno - 1].split()).rstrip(":")
                out.append(_row("SYMBOL", path, "Python", "class" if is_class else "method" if inside_class else "function", child.name, qualified, owner, child.lineno, child.end_lineno, head, _hash(body)))
                if is_class:
                    out.extend(_row("EXTENDS", path, "Python", name=ast.unparse(b).split(".")[-1], qualified=qualified) for b in child.bases)
                else:
                    returned = [s.value.func.id for s in ast.walk(child) if isinstance(s, ast.Return) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Name) and s.value.func.id[:1].isupper()]
                    if t := (named(child.returns) if child.returns is not None else returned[0] if len(set(returned)) == 1 else None):
                        out.append(_row("RETURNS", path, "Python", name=t, qualified=qualified))
                    out.extend(_flow(path, "Python", qualified, f) for f in python_flows(child))
                for deco in child.decorator_list:
                    for m in _ROUTE.finditer("@" + ast.unparse(deco)):
                        out.append(_row("HANDLES_ROUTE", path, "Python", name=re.sub(r"<(?:\w+:)?(\w+)>", r"{\1}", next(filter(None, m.groups()))), qualified=qualified))
                walk(child, qualified, is_class, types if is_class else typed(child))
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    how = "async" if isinstance(node, ast.Await) else None
                    if isinstance(f, ast.Name):
                        out.append(_row("CALL", path, "Python", how, f.id, owner))
                    elif isinstance(f, ast.Attribute):
                        detail = types.get(f.value.id) if isinstance(f.value, ast.Name) else None
                        if isinstance(f.value, ast.Call) and isinstance(f.value.func, ast.Name):
                            detail = ("ctor:" if f.value.func.id[:1].isupper() else "made:") + f.value.func.id
                        out.append(_row("CALL", path, "Python", how, f.attr, owner, receiver=ast.unparse(f.value), detail=detail))
                        for record, pattern in (("HTTP_CALLS", _HTTP), ("EMITS", _EMIT), ("LISTENS_ON", _LISTEN)):
                            out.extend(_row(record, path, "Python", name=m[1], qualified=owner) for m in pattern.finditer(ast.unparse(child)))
                elif isinstance(child, ast.Import):
                    for a in child.names:
                        out.append(_import(path, "Python", a.name, a.asname or a.name, None, _python_files(path, a.name)))
                elif isinstance(child, ast.ImportFrom):
                    module = "." * child.level + (child.module or "")
                    for a in child.names:  # the name may be a module of the package or a symbol of the module
                        inner = _python_files(path, module + ("" if module.endswith(".") else ".") + a.name)
                        out.append(_import(path, "Python", module, a.asname or a.name, a.name, [*inner, *_python_files(path, module)]))
                walk(child, owner, inside_class, types)

    try:
        walk(ast.parse(text), None, False, {})
    except (SyntaxError, ValueError, RecursionError):
        out.append(_row("FAILURE", path, "Python", name="E_PARSE_ERROR"))
    return out


def _scan_braces(path, language, text):
    """One pass over the braces, one over the lines, one stack of open scopes: linear in the text."""
    masked, out = mask(text), []
    starts = [0, *(m.end() for m in re.finditer("\n", masked))]
    closing, opens, stack = {}, [], []
    for m in re.finditer(r"[{}]", masked):
        if m[0] == "{":
            stack.append(m.start())
            opens.append(m.start())
        elif stack:
            closing[stack.pop()] = m.end()
    semicolons = [m.start() for m in re.finditer(";", masked)]
    next_of = lambda places, at: places[i] if (i := bisect.bisect_left(places, at)) < len(places) else -1
    heads, found = [(k, re.compile(p)) for k, p in _HEADS[language]], []
    for n, at in enumerate(starts):
        line = masked[at : starts[n + 1] - 1 if n + 1 < len(starts) else len(masked)]
        for kind, pattern in heads:
            m = pattern.match(line)
            if m and m["name"] not in _KEYWORDS:
                opening, semicolon, end = next_of(opens, at), next_of(semicolons, at), at + len(line)
                has_body = opening >= 0 and not 0 <= semicolon < opening
                if has_body:
                    end = closing.get(opening, end)
                inside = at <= opening < end
                found.append((kind, m["name"], m.groupdict().get("in"), at, end, n + 1, bisect.bisect_right(starts, max(at, end - 1)), " ".join(text[at : opening if inside else end].split()), opening if inside and has_body else None))
                break
    scopes: list[tuple[int, str]] = []
    bodies: list[tuple[int, int]] = []
    for kind, name, receiver, at, end, first, last, signature, opening in found:
        while scopes and scopes[-1][0] <= at:
            scopes.pop()
        owner = scopes[-1][1] if scopes else receiver
        if kind in _SCOPES:
            scopes.append((end, name))
        if kind == "method" and owner is None:
            continue
        if kind == "function" and owner:
            kind = "method"
        qualified = f"{owner}.{name}" if owner else name
        if kind != "impl":
            out.append(_row("SYMBOL", path, language, kind, name, qualified, owner, first, last, signature, _hash(text[at:end])))
        else:
            m = re.match(r"impl(?:<[^>]*>)?\s+([\w:]+)(?:<[^>]*>)?\s+for\s+(\w+)", signature)
            if m:
                out.append(_row("IMPLEMENTS", path, language, name=m[1].split("::")[-1], qualified=m[2]))
        if kind in _SCOPES:
            for m in _HEADER_BASES.finditer(signature):
                record = "IMPLEMENTS" if m[1] == "implements" else "EXTENDS"
                out += [_row(record, path, language, name=re.sub(r"<.*", "", b).strip().split(".")[-1], qualified=qualified) for b in m[2].split(",") if b.strip()]
            if language == "C#" and ":" in signature:
                out += [_row("IMPLEMENTS" if re.match(r"I[A-Z]", b.strip()) else "EXTENDS", path, language, name=b.strip(), qualified=qualified) for b in signature.split(":", 1)[1].split(",") if b.strip()]
        elif kind in ("function", "method"):
            if opening is not None:
                body = masked[opening:end]
                out += _references(path, language, text[opening:end], qualified, body, signature)
                if owner or language in _LOCAL:
                    out += _accesses(path, language, qualified, owner, signature, body, _types_of(language, signature, body))
                out += [_flow(path, language, qualified, f) for f in brace_flows(body, signature, name)]
                if language in ("TypeScript", "JavaScript"):
                    whole = text[opening:end]
                    if re.search(r"\b(?:gql|graphql)\b|`\s*(?:query|mutation|subscription)\b", whole):
                        out += [_row("HANDLES_GRAPHQL", path, language, name=x, qualified=qualified, detail=str(sure)) for x, sure in services.graphql_operations(whole)]
                    out += [_row("HANDLES_TRPC", path, language, name=x, qualified=qualified, detail="0.8") for x in services.trpc_procedures(body)]
                if not bodies or at >= bodies[-1][1]:
                    bodies.append((at, end))
            if language in _RETURNS and (m := _RETURNS[language].search(signature)):
                out.append(_row("RETURNS", path, language, name=m[1], qualified=qualified))
    if language in _FIELD:
        out += _fields(path, language, text, masked, starts, [(f[1], f[3], f[4], f[8]) for f in found if f[0] in ("class", "struct", "type", "interface") and f[8] is not None], closing, {f[3] for f in found})
    edges = [0, *(x for span in bodies for x in span), len(text)]
    outside = lambda whole: " ".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2]))
    heads_gone = re.compile(r"\b(?:function|func|fn|class|interface|struct)\b[^\n{]*")
    out += _references(path, language, outside(text), None, heads_gone.sub("", outside(masked)))
    return out + _imports(path, language, text)


def _fields(path, language, text, masked, starts, scopes, closing, heads):
    """Field symbols: declarations on lines directly inside a type's braces."""
    out, braces = [], sorted([*closing, *(c - 1 for c in closing.values())])
    running, total = [], 0
    for b in braces:
        total += 1 if masked[b] == "{" else -1
        running.append(total)
    depth_at = lambda at: running[i - 1] if (i := bisect.bisect_left(braces, at)) else 0
    for name, _, end, opening in scopes:
        inner = depth_at(opening + 1)
        for n in range(bisect.bisect_right(starts, opening), bisect.bisect_left(starts, end)):
            at = starts[n]
            line = masked[at : starts[n + 1] - 1 if n + 1 < len(starts) else len(masked)]
            if depth_at(at) != inner or at in heads or "(" in line.partition("=")[0]:
                continue
            m = _FIELD[language].match(line)
            for field in re.split(r"\s*,\s*", m["n"]) if m else []:
                if field not in _KEYWORDS:
                    whole = " ".join(text[at : at + len(line)].split())
                    out.append(_row("SYMBOL", path, language, "field", field, f"{name}.{field}", name, n + 1, n + 1, whole, _hash(whole)))
    return out


def _go_modules(path: str, text: str) -> list[tuple]:
    m = re.search(r"^module\s+(\S+)", text, re.M)
    return [_row("MODULE", path, "Go module", name=m[1], container="go", detail=posixpath.dirname(path))] if m else []


def _scan_proto(path, text):
    lines, out = text.split("\n"), []
    for kind, name, qualified, container, n in services.proto_symbols(text):
        head = " ".join(lines[n - 1].split())
        out.append(_row("SYMBOL", path, "Protocol Buffers", kind, name, qualified, container, n, n, head, _hash(head)))
        if kind == "rpc" and container:
            out.append(_row("HANDLES_GRPC", path, "Protocol Buffers", name=f"{container}/{name}", qualified=qualified, detail="0.95"))
    return out


def _scan_graphql(path, text):
    out = []
    for operation, field in services.graphql_schema(text):
        n = 1 + text.count("\n", 0, m.start()) if (m := re.search(rf"^\s*{field}\b", text, re.M)) else 1
        head = f"{operation} {field}"
        out.append(_row("SYMBOL", path, "GraphQL", "field", field, f"{operation.capitalize()}.{field}", None, n, n, head, _hash(head)))
        out.append(_row("HANDLES_GRAPHQL", path, "GraphQL", name=head, qualified=f"{operation.capitalize()}.{field}", detail="0.9"))
    return out


_CONFIG = {"Dockerfile": ("docker/", 0.85), "JSON": ("json/", 0.65), "TOML": ("toml/", 0.7), "Make": ("make/", 0.75), "YAML": ("yaml/", 0.75)}
_HCL_BLOCK = re.compile(r'^(?P<type>\w+)((?:\s+"[^"]+")*)\s*\{', re.M)


def _scan_hcl(path, text):
    """Blocks with their bodies; a block configures its address and depends on the addresses that its body names."""
    out, masked = [], mask(re.sub(r"#[^\n]*", lambda m: " " * len(m[0]), text))
    spots = list(_HCL_BLOCK.finditer(text))
    for i, m in enumerate(spots):
        labels = re.findall(r'"([^"]+)"', m[2])
        kind, limit = m["type"], spots[i + 1].start() if i + 1 < len(spots) else len(text)
        depth = end = 0
        for b in re.finditer(r"[{}]", masked[m.start() : limit]):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                end = m.start() + b.end()
                break
        end = end or limit
        name, qualified = labels[-1] if labels else kind, ".".join([kind, *labels])
        address = ".".join(labels) if kind == "resource" else f"var.{name}" if kind == "variable" else qualified
        first, body = 1 + text.count("\n", 0, m.start()), text[m.start() : end]
        out.append(_row("SYMBOL", path, "HCL", "block", name, qualified, None, first, first + body.count("\n"), " ".join(body.split()), _hash(body)))
        out.append(_row("CONFIGURES", path, "HCL", name=qualified if kind != "resource" else address, qualified=qualified, detail="0.9"))
        inner = text[m.end() : end]
        for x in dict.fromkeys(re.findall(r"(?<![\w.\"])((?:data\.)?[a-z]\w*\.[A-Za-z_][\w-]*)", re.sub(r'"(?:[^"$\\]|\\.)*"', '""', inner))):
            kinds = {"var": "variable", "module": "module", "local": None}
            head, _, tail = x.partition(".")
            target = x if head == "data" else f"{kinds[head]}.{tail}" if kinds.get(head) else None if head in kinds else f"resource.{x}"
            if target and target != qualified:
                out.append(_row("RESOURCE_DEPENDS_ON", path, "HCL", name=target, qualified=qualified, detail="0.9"))
    return out


def scan(path: str, language: str, text: str) -> list[tuple]:
    if language == "Python":
        return _scan_python(path, text)
    if language == "Go" and not services.go_default_build(path, text):
        return []
    if language == "Protocol Buffers":
        return _scan_proto(path, text)
    if language == "GraphQL":
        return _scan_graphql(path, text)
    if language in _HEADS:
        return _scan_braces(path, language, text)
    if posixpath.basename(path) == "go.mod":
        return [*_go_modules(path, text), _row("SYMBOL", path, language, "document", "go.mod", path, None, 1, 1 + text.count("\n"), path, _hash(text))]
    if language in _FORMATS:
        if language == "HCL":
            return _scan_hcl(path, text)
        kind, pattern = _FORMATS[language]
        flags = [(n + 1, m) for n, line in enumerate(text.split("\n")) if (m := re.search(pattern, line))]
        names = [m["name"] or f"stage{i}" for i, (_, m) in enumerate(flags)]
        out = [_row("SYMBOL", path, language, kind, name, name, None, n, n, " ".join(m[0].split()), _hash(m[0])) for name, (n, m) in zip(names, flags)]
        if language in _CONFIG:
            prefix, sure = _CONFIG[language]
            out += [_row("CONFIGURES", path, language, name=f"{prefix}{name}", qualified=name, detail=str(sure)) for name in dict.fromkeys(names)]
        if language == "Dockerfile":
            for n, line in enumerate(text.split("\n")):
                if (m := re.match(r"\s*(?:COPY|ADD)\s+.*--from=(\S+)", line)) and (stage := [name for name, (at, _) in zip(names, flags) if at <= n]):
                    source = names[int(m[1])] if m[1].isdigit() and int(m[1]) < len(names) else m[1]
                    out.append(_row("RESOURCE_DEPENDS_ON", path, language, name=source, qualified=stage[-1], detail="0.9"))
        return out
    return [_row("SYMBOL", path, language, "document", path.rpartition("/")[2], path, None, 1, 1 + text.count("\n"), path, _hash(text))]


def records(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Symbols, references and failures of each file: one pass over text that is neither binary, minified nor too large."""
    ship_package(files.sparkSession)
    known = with_language(files)
    text = known.filter(~T.has_nul(F.col("content")))
    reason = F.when(F.col("bytes") > max_bytes, "E_FILE_TOO_LARGE").when(T.minified(F.col("content")), "E_MINIFIED")
    text = text.withColumn("reason", reason)
    usable = text.filter("reason is null")
    failed = {"record": F.lit("FAILURE"), "path": F.col("path"), "language": F.col("language"), "name": F.col("reason")}
    failures = text.filter("reason is not null").select(*[failed.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in (c.split() for c in ROW.split(", "))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [r for p, l, t in zip(batch["path"], batch["language"], batch["content"]) for r in scan(p, l, t)]
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")])
            frame[["start_line", "end_line"]] = frame[["start_line", "end_line"]].astype("Int32")
            yield frame

    return usable.select("path", "language", "content").mapInPandas(run, ROW).unionByName(failures)


def _symbol_table(rows: DataFrame, repo: str) -> DataFrame:
    base = F.concat_ws(":", F.lit(repo), "language", "path", "kind", "qualified")
    s = rows.filter("record = 'SYMBOL'").withColumn("base", base)
    same = Window.partitionBy("base")
    nth = F.row_number().over(Window.partitionBy("base", "signature").orderBy("start_line", "end_line"))
    suffix = F.concat(F.lit("#sig:"), F.substring(F.sha2("signature", 256), 1, 8), F.when(F.col("nth") > 1, F.concat(F.lit("#"), F.col("nth").cast("string"))).otherwise(""))
    s = s.withColumns({"n": F.count(F.lit(1)).over(same), "nth": nth})
    return s.select(F.when(F.col("n") > 1, F.concat("base", suffix)).otherwise(F.col("base")).alias("id"), "kind", "name", F.col("qualified").alias("qualified_name"), F.col("path").alias("file_path"), "start_line", "end_line", "signature", "body_hash", "language", "container")


def symbols(files: DataFrame, repo: str = "repo") -> DataFrame:
    return _symbol_table(records(files), repo)


def relations(files: DataFrame, repo: str = "repo") -> DataFrame:
    """(from_id, to_id, type, confidence, resolution, target_kind) of the tree; a call that matches several symbols in its tier gives none."""
    rows = materialize(records(files), "records")
    table = materialize(_symbol_table(rows, repo), "symbols")
    file_id = lambda c: F.concat(F.lit(f"{repo}:file:"), c)
    edge = lambda df, a, b, t, conf, res, kind: df.select(a.alias("from_id"), b.alias("to_id"), (t if isinstance(t, Column) else F.lit(t)).alias("type"), (conf if isinstance(conf, Column) else F.lit(conf)).cast("double").alias("confidence"), (res if isinstance(res, Column) else F.lit(res)).alias("resolution"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("target_kind"))
    out = [edge(table, file_id(F.col("file_path")), F.col("id"), "DEFINES", 1.0, "exact", "symbol")]
    parent = table.groupBy(F.col("file_path").alias("p_path"), F.col("qualified_name").alias("p_name")).agg(F.min("id").alias("p_id"))
    inner = table.filter("container is not null").join(parent, (F.col("file_path") == F.col("p_path")) & (F.col("container") == F.col("p_name")))
    out.append(edge(inner, F.col("p_id"), F.col("id"), "CONTAINS", 1.0, "exact", "symbol"))
    # who holds a reference: the symbol of that qualified name in the file, else the file
    owner = table.groupBy(F.col("file_path").alias("o_path"), F.col("qualified_name").alias("o_name")).agg(F.min("id").alias("o_id"), F.min("container").alias("o_in"))
    held = rows.filter("record not in ('SYMBOL', 'FAILURE', 'IMPORT', 'MODULE')").join(owner, (F.col("path") == F.col("o_path")) & (F.col("qualified") == F.col("o_name")), "left").withColumn("src", F.coalesce("o_id", file_id(F.col("path"))))
    # supertypes: a unique local type, else external
    types = table.filter(F.col("kind").isin("class", "interface", "struct", "trait", "type", "enum")).groupBy(F.col("name").alias("t_name")).agg(F.count(F.lit(1)).alias("t_n"), F.min("id").alias("t_id"), F.min("kind").alias("t_kind"), F.min("qualified_name").alias("t_qualified"), F.min("file_path").alias("t_path"))
    supers = held.filter(F.col("record").isin("EXTENDS", "IMPLEMENTS")).join(types, (F.col("name") == F.col("t_name")) & (F.col("t_n") == 1), "left")
    target = F.coalesce("t_id", F.concat(F.lit("external:type:"), F.col("name")))
    sure = F.when(F.col("language") == "C#", 0.7).otherwise(0.9)
    kind = F.when(F.col("t_id").isNull(), "external").otherwise("symbol")
    out.append(edge(supers, F.col("src"), target, F.col("record"), sure, F.when(F.col("t_id").isNull(), "name_only").otherwise("exact"), kind))
    out.append(edge(supers.filter("record = 'EXTENDS'"), F.col("src"), target, "INHERITS", sure, F.when(F.col("t_id").isNull(), "name_only").otherwise("exact"), kind))
    methods = table.filter("kind = 'method'").select(F.col("id").alias("m_id"), F.col("name").alias("m_name"), F.col("container").alias("m_in"), F.col("file_path").alias("m_path"))
    own, base = methods.alias("own"), methods.alias("base")
    known = supers.filter("t_id is not null").select("path", F.col("qualified").alias("sub"), "t_qualified", "t_path").distinct()
    overrides = known.join(own, (F.col("path") == F.col("own.m_path")) & (F.col("sub") == F.col("own.m_in"))).join(base, (F.col("t_path") == F.col("base.m_path")) & (F.col("t_qualified") == F.col("base.m_in")) & (F.col("own.m_name") == F.col("base.m_name")))
    out.append(edge(overrides, F.col("own.m_id"), F.col("base.m_id"), "OVERRIDES", 0.85, "exact", "symbol"))
    # imports: the first file that is there of those an import may mean, else the one file known by the module's name
    imports = rows.filter("record = 'IMPORT'").select(F.col("path").alias("i_path"), F.col("name").alias("module"), F.col("detail").alias("local_name"), F.col("receiver").alias("original"), F.col("signature").alias("files"), F.col("container").alias("key")).distinct()
    imports = materialize(imports.withColumn("i_no", F.monotonically_increasing_id()), "imports")
    paths = with_language(files).select(F.col("path").alias("to_path"), "language").distinct()
    by_path = imports.select("i_no", "i_path", F.posexplode(F.split("files", "\n")).alias("nth", "to_path")).join(paths, "to_path").groupBy("i_no").agg(F.min_by("to_path", "nth").alias("to_path")).withColumn("sure", F.lit(0.95))
    modules = rows.filter("record = 'MODULE'").select(F.col("container").alias("key"), F.col("name").alias("known_as"), F.col("path").alias("m_path"), F.col("detail").alias("m_dir"))
    named = modules.filter("key <> 'go'").groupBy("key", "known_as").agg(F.count_distinct("m_path").alias("n"), F.min("m_path").alias("to_path")).filter("n = 1")
    by_name = imports.join(named.withColumnRenamed("known_as", "module"), ["key", "module"]).select("i_no", "to_path", F.when(F.col("key") == "PHP", 0.88).otherwise(0.90).alias("sure"))
    steps = F.split("module", "/")
    prefixes = imports.filter("key = 'go'").select("i_no", "module", F.explode(F.sequence(F.lit(1), F.size(steps))).alias("k")).withColumn("known_as", F.array_join(F.slice(steps, F.lit(1), F.col("k")), "/"))
    here = prefixes.join(F.broadcast(modules.filter("key = 'go'").select("known_as", "m_dir")), "known_as")  # one row a go.mod
    here = here.withColumn("dir", F.array_join(F.filter(F.array("m_dir", F.array_join(F.slice(steps, F.col("k") + 1, F.size(steps)), "/")), lambda x: x != ""), "/"))
    dir_of = lambda c: F.regexp_extract(c, "^(.*)/[^/]*$", 1)
    packages = paths.filter((F.col("language") == "Go") & ~F.col("to_path").endswith("_test.go")).groupBy(dir_of(F.col("to_path")).alias("dir")).agg(F.min("to_path").alias("to_path"))
    by_package = here.join(packages, "dir").groupBy("i_no").agg(F.max_by("to_path", "k").alias("to_path")).withColumn("sure", F.lit(0.93))
    landed = by_path.unionByName(by_name).unionByName(by_package).groupBy("i_no").agg(F.max_by("to_path", F.struct("sure", "to_path")).alias("to_path"), F.max("sure").alias("sure"))
    imports = materialize(imports.join(landed, "i_no", "left").filter("to_path is null or to_path <> i_path"), "imports-resolved")
    # calls: own type .90, same file .92, imported .86, typed receiver .85 to .77, package .80, imported external .78, unique name .68
    calls = materialize(held.filter("record = 'CALL'").withColumn("call", F.monotonically_increasing_id()).withColumn("dir", dir_of(F.col("path"))), "calls")
    callable_ = table.filter(F.col("kind").isin("function", "method", "class", "struct", "type")).withColumn("dir", dir_of(F.col("file_path")))
    count = lambda keys, where=None: (callable_.filter(where) if where else callable_).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("to"), F.min("kind").alias("to_kind"))
    bare = F.col("receiver").isNull()
    mine = F.col("receiver").isin("self", "this", "cls", "$this")
    c = lambda df: df.select("call", "tier", "n", "to", "to_kind", "conf", "res")
    tier = lambda df, n, conf, res: c(df.withColumns({"tier": F.lit(n), "conf": conf if isinstance(conf, Column) else F.lit(conf), "res": F.lit(res)}))
    methods_of = count(["file_path", "container", "name"], "kind = 'method'").toDF("f", "k", "m", "n", "to", "to_kind")
    found = [
        tier(calls.filter(mine).join(methods_of, (F.col("path") == F.col("f")) & (F.col("o_in") == F.col("k")) & (F.col("name") == F.col("m"))), 1, 0.90, "exact"),
        tier(calls.filter(bare).join(count(["file_path", "name"], "kind <> 'method'").toDF("f", "m", "n", "to", "to_kind"), (F.col("path") == F.col("f")) & (F.col("name") == F.col("m"))), 2, 0.92, "exact"),
    ]
    head = F.element_at(F.split("receiver", r"\."), 1)
    via = calls.join(imports, (F.col("path") == F.col("i_path")) & (F.col("local_name") == F.coalesce(head, "name"))).filter(F.col("local_name") != "")
    wanted = F.when(bare & F.col("original").isNotNull(), F.col("original")).otherwise(F.col("name"))
    exported = count(["file_path", "name"], "kind <> 'method'").toDF("f", "m", "n", "to", "to_kind")
    in_file = via.withColumn("wanted", wanted).join(exported, (F.col("to_path") == F.col("f")) & (F.col("wanted") == F.col("m")))
    in_package = via.filter("language = 'Go' and to_path is not null").join(count(["dir", "name"], "language = 'Go' and kind <> 'method'").toDF("d", "m", "n", "to", "to_kind"), (dir_of(F.col("to_path")) == F.col("d")) & (F.col("name") == F.col("m")))
    reached = in_file.select("call", "n", "to", "to_kind").unionByName(in_package.select("call", "n", "to", "to_kind")).distinct().groupBy("call").agg(F.sum("n").alias("n"), F.min("to").alias("to"), F.min("to_kind").alias("to_kind"))
    found.append(tier(reached, 3, 0.86, "import_resolved"))
    # the receiver's type: of a local, a parameter, a constructor or what a factory returns; inherited methods by walking up supertypes
    kind_of = table.filter(F.col("kind").isin("class", "struct", "type", "interface", "trait")).groupBy("name").agg(F.count(F.lit(1)).alias("t_n"), F.min("file_path").alias("t_path"), F.min("qualified_name").alias("t_in")).filter("t_n = 1").drop("t_n")
    returns = rows.filter("record = 'RETURNS'").select(F.regexp_extract("qualified", r"([^.]+)$", 1).alias("factory"), F.col("name").alias("returned")).distinct().groupBy("factory").agg(F.count(F.lit(1)).alias("k"), F.min("returned").alias("returned")).filter("k = 1").drop("k")
    said = calls.filter("detail is not null").withColumns({"how": F.substring_index("detail", ":", 1), "said": F.substring_index("detail", ":", -1)}).join(returns, F.col("how").isin("factory", "made") & (F.col("said") == F.col("factory")), "left")
    said = said.withColumn("type", F.when(F.col("how").isin("factory", "made"), F.col("returned")).otherwise(F.col("said"))).filter("type is not null")
    sure_of = F.when(F.col("how") == "local", 0.85).when(F.col("how") == "param", 0.83).when(F.col("how") == "ctor", 0.80).when(F.col("how") == "made", 0.78).otherwise(0.77)
    typed = said.select("call", "name", "type", sure_of.alias("typed_conf")).join(kind_of.withColumnRenamed("name", "type"), "type")
    found.append(tier(typed.join(methods_of, (F.col("t_path") == F.col("f")) & (F.col("t_in") == F.col("k")) & (F.col("name") == F.col("m"))), 4, F.col("typed_conf"), "type_inferred"))
    up = known.select(F.col("path").alias("s_path"), F.col("sub"), F.col("t_path").alias("u_path"), F.col("t_qualified").alias("u_in")).distinct()
    at = typed.select("call", "name", F.col("t_path").alias("at_path"), F.col("t_in").alias("at_in")).unionByName(calls.filter(mine & F.col("o_in").isNotNull()).select("call", "name", F.col("path").alias("at_path"), F.col("o_in").alias("at_in")))
    for step in range(3):  # supertypes of supertypes
        at = at.join(up, (F.col("at_path") == F.col("s_path")) & (F.col("at_in") == F.col("sub"))).select("call", "name", F.col("u_path").alias("at_path"), F.col("u_in").alias("at_in")).distinct()
        found.append(tier(at.join(methods_of, (F.col("at_path") == F.col("f")) & (F.col("at_in") == F.col("k")) & (F.col("name") == F.col("m"))), 5 + step, 0.82, "type_inferred"))
    go = calls.filter(bare & (F.col("language") == "Go"))
    found.append(tier(go.join(count(["dir", "name"], "language = 'Go' and kind <> 'method'").toDF("d", "m", "n", "to", "to_kind"), (F.col("dir") == F.col("d")) & (F.col("name") == F.col("m"))), 8, 0.80, "package"))
    outside = via.filter("to_path is null").withColumn("what", F.when(bare & F.col("original").isNotNull(), F.col("original")).otherwise(F.col("name")))
    outside = outside.groupBy("call").agg(F.min(F.concat_ws("", F.lit("external:symbol:"), "module", F.lit("."), "what")).alias("to")).withColumns({"n": F.lit(1).cast("long"), "to_kind": F.lit("external")})
    found.append(tier(outside, 9, 0.78, "import_external"))
    found.append(tier(calls.filter(bare).join(count(["name"], "kind <> 'method'").toDF("m", "n", "to", "to_kind"), F.col("name") == F.col("m")), 10, 0.68, "name_only"))
    ladder = found[0]
    for f in found[1:]:
        ladder = ladder.unionByName(f)
    # the first tier that has any candidate decides; where it has several, there is no edge
    first = ladder.groupBy("call", "tier").agg(F.sum("n").alias("n"), F.min(F.struct("to", "to_kind", "conf", "res")).alias("b")).groupBy("call").agg(F.min_by(F.struct("n", "b"), "tier").alias("t")).select("call", "t.n", "t.b.*").filter("n = 1")
    resolved = calls.join(first, "call").filter("src <> to")
    call_type = F.when(F.col("to_kind").isin("class", "struct", "type"), "CONSTRUCTS").otherwise("CALLS")
    target_kind = F.when(F.col("to_kind") == "external", "external").otherwise("symbol")
    out.append(edge(resolved, F.col("src"), F.col("to"), call_type, F.col("conf"), F.col("res"), target_kind))
    out.append(edge(resolved.filter("kind = 'async'"), F.col("src"), F.col("to"), "ASYNC_CALLS", 0.85, "exact", target_kind))
    # data flows follow resolved calls of the function: results from the callee, arguments to it
    flows = rows.filter("record = 'FLOW'").select(F.col("path").alias("fl_path"), F.col("qualified").alias("fl_owner"), F.col("name").alias("fl_name"), F.col("detail").alias("way")).distinct()
    certain = resolved.filter((F.col("to_kind") != "external") & F.col("res").isin("exact", "import_resolved", "package", "type_inferred")).select("path", F.col("qualified").alias("by"), "name", "src", "to", "res").distinct()
    flowing = certain.join(flows, (F.col("path") == F.col("fl_path")) & (F.col("by") == F.col("fl_owner")) & (F.col("name") == F.col("fl_name")))
    out.append(edge(flowing.filter("way = 'return'"), F.col("to"), F.col("src"), "DATA_FLOWS", 0.75, F.col("res"), "symbol"))
    out.append(edge(flowing.filter("way = 'forward' and res in ('exact', 'import_resolved')"), F.col("src"), F.col("to"), "DATA_FLOWS", 0.70, F.col("res"), "symbol"))
    # types that signatures name, and fields of known types
    declared = table.filter(F.col("kind").isin("class", "struct", "type", "interface", "trait", "enum")).groupBy(F.col("name").alias("d_name")).agg(F.count(F.lit(1)).alias("d_n"), F.min("id").alias("d_id")).filter("d_n = 1")
    signed = table.filter(F.col("kind").isin("function", "method")).withColumn("at", F.expr("locate(concat(name, '('), signature)")).filter("at > 0")
    tail = F.expr("substring(signature, at + length(name) + 1)")
    signed = signed.withColumn("inside", F.substring_index(tail, ")", 1)).withColumn("rest", F.expr("substring(substring(signature, at + length(name) + 1), length(inside) + 2)"))
    signed = signed.withColumn("rest", F.when(F.col("language").isin("Java", "C#"), F.expr("substring(signature, 1, at - 1)")).otherwise(F.col("rest")))
    for names, kinds in (("inside", ["PARAM_TYPE", "USES_TYPE"]), ("rest", ["RETURNS_TYPE", "USES_TYPE"])):
        said_types = signed.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.col(names), F.lit(r"\b([A-Z][A-Za-z0-9_]*)\b"), F.lit(1)))).alias("d_name")).join(declared, "d_name").filter("id <> d_id")
        out += [edge(said_types, F.col("id"), F.col("d_id"), kind, 0.85, "exact", "symbol") for kind in kinds]
    fields = table.filter("kind = 'field'").groupBy(F.col("container").alias("f_in"), F.col("name").alias("f_name")).agg(F.count(F.lit(1)).alias("f_n"), F.min("id").alias("f_id"))
    own_fields = table.filter("kind = 'field'").groupBy(F.col("file_path").alias("g_path"), F.col("container").alias("g_in"), F.col("name").alias("g_name")).agg(F.min("id").alias("g_id"))
    access = rows.filter(F.col("record").isin("READS_FIELD", "WRITES_FIELD", "ACCESSES")).join(owner, (F.col("path") == F.col("o_path")) & (F.col("qualified") == F.col("o_name")))
    access = access.join(own_fields, (F.col("path") == F.col("g_path")) & (F.col("container") == F.col("g_in")) & (F.col("name") == F.col("g_name")), "left").join(fields.filter("f_n = 1"), (F.col("container") == F.col("f_in")) & (F.col("name") == F.col("f_name")), "left")
    access = access.withColumn("field", F.coalesce("g_id", "f_id")).filter("field is not null")
    out.append(edge(access, F.col("o_id"), F.col("field"), F.col("record"), F.col("detail").cast("double"), "type_inferred", "symbol"))
    # configuration and resources
    settings = held.filter("record = 'CONFIGURES'")
    out.append(edge(settings, F.col("src"), F.concat(F.lit("external:config:"), "name"), "CONFIGURES", F.col("detail").cast("double"), "pattern", "config"))
    places = table.select(F.col("language").alias("r_language"), F.regexp_extract("file_path", "^(.*/)?[^/]*$", 1).alias("r_dir"), F.when(F.col("language") == "HCL", "").otherwise(F.col("file_path")).alias("r_path"), F.col("qualified_name").alias("r_name"), F.col("id").alias("r_id")).filter("r_language in ('HCL', 'Dockerfile')")
    places = places.groupBy("r_language", "r_dir", "r_path", "r_name").agg(F.min("r_id").alias("r_id"))
    needs = held.filter("record = 'RESOURCE_DEPENDS_ON'").withColumns({"n_dir": F.regexp_extract("path", "^(.*/)?[^/]*$", 1), "n_path": F.when(F.col("language") == "HCL", "").otherwise(F.col("path"))})
    needs = needs.join(places, (F.col("language") == F.col("r_language")) & (F.col("n_dir") == F.col("r_dir")) & (F.col("n_path") == F.col("r_path")) & (F.col("name") == F.col("r_name"))).filter("src <> r_id")
    out.append(edge(needs, F.col("src"), F.col("r_id"), "RESOURCE_DEPENDS_ON", F.col("detail").cast("double"), "exact", "symbol"))
    # tests, imports, routes, channels
    subject = table.filter(F.col("kind").isin("function", "method")).withColumn("subject", F.coalesce(*[F.when(F.regexp_extract("name", p, 1) != "", F.regexp_extract("name", p, 1)) for p in ("^(?:Test|test_?)(\\w+)$", "^(\\w+?)_?[Tt]est$")]))
    units = callable_.filter(~F.col("name").rlike("^(Test|test)|[Tt]est$")).groupBy(F.lower("name").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("u_id")).filter("n = 1")
    out.append(edge(subject.filter("subject is not null").join(units, F.lower("subject") == F.col("u")), F.col("id"), F.col("u_id"), "TESTS", 0.8, "name_only", "symbol"))
    inside = F.col("to_path").isNotNull()
    out.append(edge(imports, file_id(F.col("i_path")), F.when(inside, file_id(F.col("to_path"))).otherwise(F.concat(F.lit("external:import:"), "module")), "IMPORTS", F.when(inside, F.col("sure")).otherwise(0.8), F.when(inside, "import_resolved").otherwise("name_only"), F.when(inside, "file").otherwise("external")))
    for record, node in (("HANDLES_GRPC", "grpc"), ("HANDLES_GRAPHQL", "graphql"), ("HANDLES_TRPC", "trpc")):
        out.append(edge(held.filter(F.col("record") == record), F.col("src"), F.concat(F.lit(f"external:{node}:"), "name"), record, F.col("detail").cast("double"), "pattern", node))
    ways = {"HANDLES_ROUTE": ("route", 0.86), "HTTP_CALLS": ("route", 0.7), "EMITS": ("channel", 0.6), "LISTENS_ON": ("channel", 0.6)}
    for record, (node, conf) in ways.items():
        out.append(edge(held.filter(F.col("record") == record), F.col("src"), F.concat(F.lit(f"external:{node}:"), "name"), record, conf, "pattern", node))
    whole = out[0]
    for o in out[1:]:
        whole = whole.unionByName(o)
    routes = whole.filter("type = 'HANDLES_ROUTE'").select(F.col("to_id").alias("route"), F.col("from_id").alias("handler"))
    bridge = whole.filter("type = 'HTTP_CALLS'").join(routes, F.col("to_id") == F.col("route")).filter("from_id <> handler")
    whole = whole.unionByName(edge(bridge, F.col("from_id"), F.col("handler"), "CALLS", 0.7, "pattern", "symbol"))
    best = F.max(F.struct("confidence", "resolution", "target_kind"))
    return whole.groupBy("from_id", "to_id", "type").agg(best.alias("b")).select("from_id", "to_id", "type", "b.confidence", "b.resolution", "b.target_kind")


EXAMPLE = {
    "shop/cart.py": "import os\nfrom shop.price import total\n\n\nclass Base:\n    def size(self):\n        return 0\n\n\nclass Cart(Base):\n    def __init__(self, items):\n        self.items = items\n\n    def size(self):\n        return len(self.items)\n\n    def pay(self):\n        os.getcwd()\n        return total(self.items, self.size())\n\n\ndef make():\n    return Cart([])\n\n\ndef test_make():\n    assert make().size() == 0\n",
    "shop/price.py": "def total(items, n):\n    return helper(items) + n\n\n\ndef helper(items):\n    return sum(items)\n",
    "web/server.ts": "import { load } from './store';\n\nexport interface Shape { area(): number }\n\nexport class Square implements Shape {\n  area() {\n    return side(2);\n  }\n}\n\nfunction side(n: number) {\n  return n * n;\n}\n\nexport async function start(app: any) {\n  app.get('/items/:id', list);\n  bus.on('ready', list);\n  await load();\n}\n\nfunction list() {\n  bus.emit('ready');\n}\n",
    "web/store.ts": "export function load() {\n  return fetch('https://api.example.com/items/:id');\n}\n",
    "api/main.go": "package main\n\nimport \"fmt\"\n\ntype Store struct {\n\tn int\n}\n\nfunc (s *Store) Put() {\n\tfmt.Println(s.n)\n}\n\nfunc main() {\n\tgo work()\n}\n",
    "api/work.go": "package main\n\nfunc work() {\n\tstep()\n}\n\nfunc step() {}\n",
    "Dockerfile": "FROM alpine AS build\nRUN make\nFROM scratch\nCOPY --from=build /a /a\n",
    "README.md": "# Shop\n\n## Use\n",
}


def example_files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE.items()), "path string, content string")


def tree(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """files(path, content) of a directory, one partitioned scan; binary files become unreadable text and are filtered later."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return found.select(F.regexp_replace("path", "^.*?" + re.escape(root.rstrip("/").rpartition("/")[2]) + "/", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """A, M, D and R rows of two trees(path, content): a full outer join on the path; a rename is one deletion and one addition of equal content."""
    blob = lambda df: df.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("blob"))
    b, a = blob(before).toDF("old", "old_blob"), blob(after).toDF("new", "new_blob")
    both = materialize(b.join(a, F.col("old") == F.col("new"), "full_outer"), "changed")
    gone = both.filter("new is null").groupBy(F.col("old_blob").alias("k")).agg(F.count(F.lit(1)).alias("n_old"), F.min("old").alias("was"))
    came = both.filter("old is null").groupBy(F.col("new_blob").alias("k")).agg(F.count(F.lit(1)).alias("n_new"), F.min("new").alias("now"))
    moved = gone.join(came, "k").filter("n_old = 1 and n_new = 1").select("was", "now")
    status = F.when(F.col("old").isNull(), "A").when(F.col("new").isNull(), "D").when(F.col("old_blob") != F.col("new_blob"), "M")
    rest = both.withColumn("status", status).filter("status is not null").join(moved.select(F.col("was").alias("old")), "old", "left_anti").join(moved.select(F.col("now").alias("new")), "new", "left_anti")
    return rest.select("status", F.col("old").alias("old_path"), F.col("new").alias("path")).unionByName(moved.select(F.lit("R").alias("status"), F.col("was").alias("old_path"), F.col("now").alias("path")))
