"""Syntax trees to spans of definitions; the only part of chunking that runs Python on the executors."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa

from chunkwell.operators.lexer import blanked

BLOCK = (
    "repo_name string, file_path string, file_type string, grammar string, kind string, first_line int, last_line int, "
    "chunk_type string, name string, parent_name string, content string, seq int"
)
BATCH_BLOCKS = 1000
_TYPES = {"string": pa.string(), "int": pa.int32()}
_SCHEMA = pa.schema([(n, _TYPES[t]) for n, t in (x.split() for x in BLOCK.split(", "))])


@dataclass
class Node:
    """A definition, or other code, with whole lines from `first` to `last` (from 1)."""

    kind: str | None
    name: str | None
    first: int
    last: int
    children: list[Node] = field(default_factory=list)
    owner: str | None = None


def _runs(free: list[int]) -> Iterator[tuple[int, int]]:
    start = None
    for i, n in enumerate(free):
        start = n if start is None else start
        if i + 1 == len(free) or free[i + 1] != n + 1:
            yield start, n
            start = None


def python_definitions(text: str) -> list[Node]:
    """Classes, functions and methods in order of their places in the tree, decorators included."""
    out: list[Node] = []
    size = len(text.split("\n"))

    def visit(node: ast.AST, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                last = min(child.end_lineno or child.lineno, size)
                if isinstance(child, ast.ClassDef):
                    out.append(Node("class", child.name, first, last))
                    inner = child.name
                else:
                    kind = ("async_" if isinstance(child, ast.AsyncFunctionDef) else "") + ("method" if owner else "function")
                    out.append(Node(kind, child.name, first, last, owner=owner))
            visit(child, inner)

    visit(ast.parse(text), None)
    return out


def _numbered(rows: Iterator[dict], step: int) -> Iterator[dict]:
    """Number a file's blocks so that every window of `step` new characters of a block has a number too."""
    seq = 0
    for row in rows:
        yield row | {"seq": seq}
        seq += max(1, -(-len(row["content"]) // step))


def _unparsed(base: dict, text: str, error: Exception) -> Iterator[dict]:
    """The blocks of a file that did not parse: its text, and what the parser said."""
    yield base | {"kind": "unparsed", "content": text}
    yield base | {"kind": "error", "content": f"{type(error).__name__}: {error}"}


def _python(row: dict) -> Iterator[dict]:
    text = row["content"]
    base = {n: row.get(n) for n in ("repo_name", "file_path", "file_type", "grammar")}
    try:
        found = python_definitions(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as error:  # too deep for the parser, or no Python: the file is windowed whole
        yield from _unparsed(base, text, error)
        return
    lines = text.split("\n")
    covered = {n for d in found for n in range(d.first, d.last + 1)}
    for d in found:
        body = "\n".join(lines[d.first - 1 : d.last]).strip()
        if body:
            yield base | {"kind": "definition", "first_line": d.first, "last_line": d.last, "chunk_type": d.kind, "name": d.name, "parent_name": d.owner, "content": body}
    count = len(lines) - (lines[-1] == "")
    for a, b in _runs([n for n in range(1, count + 1) if n not in covered]):
        yield base | {"kind": "between", "first_line": a, "last_line": b, "content": "\n".join(lines[a - 1 : b])}


def _run(batches: Iterator[pa.RecordBatch], each: Callable[[dict], Iterator[dict]], step: int) -> Iterator[pa.RecordBatch]:
    """A batch of blocks for each batch of files, or for every BATCH_BLOCKS of them."""
    for batch in batches:
        rows: list[dict] = []
        for k in range(batch.num_rows):  # one file's text in Python at a time
            rows += _numbered(each(batch.slice(k, 1).to_pylist()[0]), step)
            if len(rows) >= BATCH_BLOCKS:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def python_blocks(step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _run(batches, _python, step)

    return run


# ---------------------------------------------------------------- other languages

_W = r"[A-Za-z_$][\w$]*"
_TYPE_WORDS = {"class": "class", "struct": "struct", "interface": "interface", "trait": "trait", "impl": "implementation", "module": "module"}
_FUNCTION = {
    "go": rf"^func\s+(\([^)]*\)\s*)?(?P<name>{_W})",
    "rust": rf"^(pub(\([^)]*\))?\s+)?((async|const|unsafe|extern(\s+\"[^\"]*\")?)\s+)*fn\s+(?P<name>{_W})",
    "javascript": rf"^((export\s+(default\s+)?)?(async\s+)?function\s*\*?\s*(?P<name>{_W}))",
    "php": rf"^((public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>{_W})",
}
_FUNCTION["typescript"] = _FUNCTION["javascript"]
_CALLABLE = re.compile(rf"^[\w$<>\[\],.&*:~?\s@]*?(?P<name>~?{_W})\s*\([^;]*$|^[\w$<>\[\],.&*:~?\s@]*?(?P<name2>~?{_W})\s*\([^;]*\)[^;=]*\{{")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "throw", "sizeof", "using", "lock", "foreach", "match", "loop", "await"}
_TYPE = re.compile(rf"^(?:(?:export|default|abstract|public|private|protected|internal|static|final|sealed|partial|pub(?:\([^)]*\))?|unsafe|declare|readonly|typedef)\s+)*(?P<word>class|struct|interface|trait|impl)\b\s*(?:<[^>]*>\s*)?(?P<name>{_W})?(?:[^{{;]*?\bfor\s+(?P<target>{_W}))?")
_GO_TYPE = re.compile(rf"^type\s+(?P<name>{_W})")


def _declares(line: str, grammar: str, inside: bool) -> tuple[str, str | None] | None:
    """Kind and name of the definition that a line starts, if any."""
    if grammar == "go" and (m := _GO_TYPE.match(line)):
        return "struct", m["name"]
    if m := _TYPE.match(line):
        if grammar == "go":
            return None
        return _TYPE_WORDS[m["word"]], m["target"] or m["name"]
    if grammar in _FUNCTION and (m := re.match(_FUNCTION[grammar], line)):
        method = inside or (grammar == "go" and m[1] is not None)
        return ("method" if method and grammar != "rust" else "function"), m["name"]
    if (grammar in ("java", "c_sharp", "cpp", "c", "dart") or inside) and (m := _CALLABLE.match(line)):
        name = m["name"] or m["name2"]
        if name not in _NOT_CALLS and line.split("(")[0].split()[0] not in _NOT_CALLS:
            return ("function" if grammar in ("c", "cpp") else "method"), name
    return None


def lexical_nodes(text: str, grammar: str) -> list[Node]:
    """Top-level nodes by braces and keywords; an approximation for languages with braces, and Ruby."""
    if grammar == "ruby":
        return _ruby(text)
    bare = blanked(text, grammar).split("\n")
    top: list[Node] = []
    stack: list[tuple[Node, int]] = []  # open definitions and the depth outside them
    depth, i = 0, 0
    waiting: Node | None = None
    for i, line in enumerate(bare, 1):
        at = stack[-1][1] + 1 if stack else 0
        if waiting is None and depth == at and (found := _declares(line.strip(), grammar, bool(stack))):
            if found[0] == "method" and stack and found[1] == stack[-1][0].name and grammar in ("java", "c_sharp", "dart"):
                found = "constructor", found[1]
            waiting = Node(found[0], found[1], i, i)
        elif not stack and waiting is None and depth == 0 and line.strip():
            top.append(Node(None, None, i, i))
        elif not stack and waiting is None and line.strip() and top and top[-1].kind is None:
            top[-1].last = i
        for c in line:
            if c == "{":
                if waiting is not None:
                    (stack[-1][0].children if stack else top).append(waiting)
                    stack.append((waiting, depth))
                    waiting = None
                depth += 1
            elif c == "}":
                depth = max(0, depth - 1)
                if stack and depth <= stack[-1][1]:
                    stack.pop()[0].last = i
            elif c == ";" and waiting is not None:
                if not stack:
                    top.append(Node(None, None, waiting.first, i))
                waiting = None
    for node, _ in stack:
        node.last = i
    return top


def _ruby(text: str) -> list[Node]:
    top: list[Node] = []
    stack: list[tuple[Node, int]] = []
    lines = blanked(text, "ruby").split("\n")
    for i, line in enumerate(lines, 1):
        indent = len(line) - len(line.lstrip())
        m = re.match(r"\s*(class|module|def)\s+([\w:.?!=]+)", line)
        if m:
            node = Node({"def": "method"}.get(m[1], m[1]), m[2].removeprefix("self."), i, i)
            (stack[-1][0].children if stack else top).append(node)
            if not re.search(r"\bend\s*$", line):
                stack.append((node, indent))
        elif stack and re.match(r"\s*end\b", line) and indent <= stack[-1][1]:
            stack.pop()[0].last = i
        elif not stack and line.strip():
            top.append(Node(None, None, i, i))
    for node, _ in stack:
        node.last = len(lines)
    return top


#: Kinds of definitions by node type of a syntax tree, and the field that names one.
NODE_KINDS = {
    "function_definition": "function", "class_definition": "class", "function_declaration": "function", "generator_function_declaration": "function",
    "class_declaration": "class", "method_definition": "method", "method_declaration": "method", "type_declaration": "struct",
    "interface_declaration": "interface", "constructor_declaration": "constructor", "struct_specifier": "struct", "class_specifier": "class",
    "function_item": "function", "struct_item": "struct", "impl_item": "implementation", "trait_item": "trait",
    "class": "class", "method": "method", "module": "module",
}
NAME_FIELDS = {"impl_item": "type"}  # of the others it is "name"
IDENTIFIERS = ("identifier", "type_identifier", "shorthand_property_identifier")


def tree_name(node) -> str | None:  # noqa: ANN001
    """The name of a syntax node: its name field, else its first identifier."""
    named = None if node.type == "generator_function_declaration" else node.child_by_field_name(NAME_FIELDS.get(node.type, "name"))
    named = named or next((c for c in node.children if c.type in IDENTIFIERS), None)
    return named.text.decode("utf-8") if named else None


def tree_nodes(root) -> list[Node]:  # noqa: ANN001
    """Top-level nodes of a syntax tree; definitions have those below them as children, whatever lies between."""

    def made(node) -> Node:  # noqa: ANN001
        out = Node(NODE_KINDS[node.type], tree_name(node), node.start_point[0] + 1, node.end_point[0] + 1)
        out.children = below(node)
        return out

    def below(node) -> list[Node]:  # noqa: ANN001
        out: list[Node] = []
        for child in node.children:
            out += [made(child)] if child.type in NODE_KINDS else below(child)
        return out

    return [made(c) if c.type in NODE_KINDS else Node(None, None, c.start_point[0] + 1, c.end_point[0] + 1) for c in root.children]


_GRAMMARS: dict[str, object] = {}


def grammar_nodes(text: str, grammar: str) -> list[Node]:
    """Nodes by the grammar's parser where it is installed and loads, else by the lexical scan."""
    if grammar not in _GRAMMARS:
        try:
            import tree_sitter_language_pack

            _GRAMMARS[grammar] = tree_sitter_language_pack.get_parser(grammar)
        except Exception:  # noqa: BLE001  a grammar that does not load costs only its own files their trees
            _GRAMMARS[grammar] = None
    parser = _GRAMMARS[grammar]
    return tree_nodes(parser.parse(text.encode()).root_node) if parser is not None else lexical_nodes(text, grammar)


PARSERS: dict[str, Callable[[str, str], list[Node]]] = {"lexical": lexical_nodes, "grammar": grammar_nodes}


def _code(parser: str, size: int) -> Callable[[dict], Iterator[dict]]:
    def each(row: dict) -> Iterator[dict]:
        text = row["content"]
        base = {n: row.get(n) for n in ("repo_name", "file_path", "file_type", "grammar")}
        try:
            nodes = PARSERS[parser](text, row["grammar"])
        except Exception as error:  # noqa: BLE001  a parser's failure costs its file's structure, not the run
            yield from _unparsed(base, text, error)
            return
        lines = text.split("\n")
        held: tuple[int, int] | None = None

        def between() -> Iterator[dict]:
            nonlocal held
            if held is not None:
                body = "\n".join(lines[held[0] - 1 : held[1]])
                yield base | {"kind": "between", "first_line": held[0], "last_line": held[1], "content": body}
                held = None

        def emit(node: Node, parent: str | None) -> Iterator[dict]:
            body = "\n".join(lines[node.first - 1 : node.last])
            yield base | {"kind": "definition", "first_line": node.first, "last_line": node.last, "chunk_type": node.kind, "name": node.name, "parent_name": parent, "content": body}
            own = f"{parent}::{node.name}" if parent and node.name else node.name or parent
            if len(body) <= size:  # an oversize node is only windowed
                for child in node.children:
                    yield from emit(child, own)

        for node in nodes:
            if node.kind is None:
                held = (held[0] if held else node.first, node.last)
            else:
                yield from between()
                yield from emit(node, None)
        yield from between()

    return each


def code_blocks(parser: str, size: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    if parser not in PARSERS:
        raise ValueError(f"no parser named {parser}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _run(batches, _code(parser, size), step)

    return run


def tree_lines(text: str, grammar: str = "python") -> list[tuple[int, str, str]]:
    """(depth, node type, first line) of a syntax tree, in pre-order: of Python by its own parser, of others by their grammar where it is installed."""
    lines = text.split("\n")
    line = lambda at: lines[at - 1].strip() if at <= len(lines) else ""
    if grammar == "python":
        root, parts, told = ast.parse(text), lambda n: list(ast.iter_child_nodes(n)), lambda n: (type(n).__name__, line(getattr(n, "lineno", 1)))
    else:
        import tree_sitter_language_pack

        root = tree_sitter_language_pack.get_parser(grammar).parse(text.encode()).root_node
        parts, told = lambda n: n.children, lambda n: (n.type, line(n.start_point[0] + 1))
    out: list[tuple[int, str, str]] = []
    open_ = [(root, 0)]
    while open_:  # a stack of its own: trees may be deeper than Python's
        node, depth = open_.pop()
        out.append((depth, *told(node)))
        open_ += [(child, depth + 1) for child in reversed(parts(node))]
    return out


class SyntaxTree:
    """A table function: a row (n, depth, kind, line) for each node of a file's syntax tree; of one that does not parse a row of kind ERROR with the message."""

    def eval(self, text: str, grammar: str) -> Iterator[tuple[int, int, str, str]]:
        try:
            found = tree_lines(text or "", grammar or "python")
        except Exception as error:  # noqa: BLE001  one file's failure is a row
            found = [(0, "ERROR", f"{type(error).__name__}: {error}")]
        for n, (depth, kind, line) in enumerate(found):
            yield n, depth, kind, line


TREE = "n int, depth int, kind string, line string"
