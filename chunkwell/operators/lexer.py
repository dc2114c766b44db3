"""A pushdown lexer, by tables of each language's tokens: comments and the contents of literals become blanks.

A table has atoms, literals and comments that one expression matches whole; templates, strings with holes of
code in them, which may hold templates again; nested comments; brackets that nest; documents that begin on the next
line; and whether a slash may open a regular expression.  A stack holds the open templates and, for each open
hole, the braces open in it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: What does not end goes on to the end of the text, so that no place is looked at again and again.
_LINE, _BLOCK = r"//[^\n]*", r"/\*.*?(?:\*/|\Z)"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'"


@dataclass(frozen=True)
class Template:
    """A string from `open` to `close` with holes from `hole` to a closing brace; `twice` marks characters that stand for themselves when doubled."""

    open: str
    close: str
    hole: str
    twice: str = ""
    escape: bool = True

    def inside(self) -> re.Pattern:
        """What matters within: an escape, the end, or a hole."""
        escapes = [r"\\."] * self.escape + [re.escape(c) * 2 for c in self.twice]
        return re.compile(rf"(?P<escape>{'|'.join(escapes) or '(?!)'})|(?P<close>{re.escape(self.close)})|(?P<hole>{re.escape(self.hole)})", re.S)


@dataclass(frozen=True)
class Table:
    """The tokens of a language."""

    atoms: tuple[str, ...]
    templates: tuple[Template, ...] = ()
    nested: bool = False  # block comments nest
    brackets: str = ""  # what comes before a bracket that opens a literal
    later: str = ""  # what announces a document from the next line on, with its end in the group `end`
    expressions: bool = False  # a slash may open a regular expression
    code: re.Pattern = field(init=False, repr=False)

    def __post_init__(self) -> None:
        parts = [f"(?P<atom>{'|'.join(self.atoms)})"]
        parts += [r"(?P<nested>/\*)"] * self.nested + [f"(?P<later>{self.later})"] * bool(self.later) + [rf"(?P<bracket>{self.brackets}[(\[{{<])"] * bool(self.brackets)
        parts += [f"(?P<t{k}>{t.open})" for k, t in enumerate(self.templates)] + ["(?P<slash>/)"] * self.expressions + [r"(?P<open>\{)|(?P<shut>\})"]
        object.__setattr__(self, "code", re.compile("|".join(parts), re.S | re.M))


_JAVASCRIPT = Table((_LINE, _BLOCK, _DOUBLE, _SINGLE), (Template("`", "`", "${"),), expressions=True)
TABLES = {
    "javascript": _JAVASCRIPT,
    "typescript": _JAVASCRIPT,
    "go": Table((_LINE, _BLOCK, _DOUBLE, _SINGLE, r"`[^`]*(?:`|\Z)")),
    "rust": Table((_LINE, r'\bb?r(?P<hashes>#*)".*?(?:"(?P=hashes)|\Z)', r'"(?:\\.|[^"\\])*"', r"'(?:\\[^\n]*?|[^\\'\n])'"), nested=True),
    "java": Table((_LINE, _BLOCK, r'"""(?:\\.|[^\\])*?(?:"""|\Z)', _DOUBLE, _SINGLE)),
    "c": Table((r"//(?:\\\n|[^\n])*", _BLOCK, r'"(?:\\.|[^"\\\n])*"', _SINGLE)),
    "cpp": Table((r"//(?:\\\n|[^\n])*", _BLOCK, r'R"(?P<mark>[^()\\\s]{0,16})\(.*?(?:\)(?P=mark)"|\Z)', _DOUBLE, r"\b\d[\d']*", _SINGLE)),
    "c_sharp": Table(
        (_LINE, _BLOCK, r'\$*(?P<quotes>"{3,}).*?(?:(?P=quotes)|\Z)', r'@"(?:""|[^"])*"', _DOUBLE, _SINGLE),
        (Template(r'(?:\$@|@\$)"', '"', "{", twice='"{}', escape=False), Template(r'\$"', '"', "{", twice="{}")),
    ),
    "php": Table((_LINE, r"#(?!\[)[^\n]*", _BLOCK, r"""<<<[ \t]*(?P<quote>['"]?)(?P<id>\w+)(?P=quote)\n.*?(?:^[ \t]*(?P=id)\b|\Z)""", r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'")),
    "dart": Table(
        (_LINE, r'\br(?P<raw>"""|\'\'\'|"|\').*?(?:(?P=raw)|\Z)',),
        (Template('"""', '"""', "${"), Template("'''", "'''", "${"), Template('"', '"', "${"), Template("'", "'", "${")), nested=True,
    ),
    "ruby": Table(
        (r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)", r"#[^\n]*", r"'(?:\\.|[^'\\])*'"), (Template('"', '"', "#{"), Template("`", "`", "#{")),
        brackets="%[qQwWiIr]", later=r"""<<[~-]?(?P<mark>["'`]?)(?P<end>[A-Z_]\w*)(?P=mark)""", expressions=True,
    ),
}
_INSIDE = {t: t.inside() for table in TABLES.values() for t in table.templates}
_EXPRESSION = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: A slash after one of these, after a word of these, or at the start opens an expression; elsewhere it divides.
_BEFORE, _WORDS = set("(,=:[!&|?{};+-*%<>~^\n"), {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "if", "unless", "when", "and", "or", "not", "while"}
_CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}


def _opens_expression(text: str, at: int) -> bool:
    before = text[max(0, at - 200) : at].rstrip(" \t")
    word = re.search(r"[A-Za-z_$][\w$]*\Z", before)
    return not before or before[-1] in _BEFORE or bool(word and word[0] in _WORDS)


def _balanced(text: str, at: int, open_: str, close: str) -> int:
    """The end of what opens at a place, with what nests in it; the end of the text if it does not close."""
    depth = 0
    for m in re.compile(f"{re.escape(open_)}|{re.escape(close)}").finditer(text, at):
        depth += 1 if m[0] == open_ else -1
        if depth == 0:
            return m.end()
    return len(text)


def _blank_spans(text: str, table: Table) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    stack: list[Template | int] = []  # open templates, and braces open in each open hole
    at, bodies = 0, {}  # bodies: the ends of lines after which documents stand, and where these end
    while at < len(text):
        if stack and isinstance(stack[-1], Template):
            m = _INSIDE[stack[-1]].search(text, at)
            spans.append((at, m.end() if m else len(text)))
            if not m:
                break
            at = m.end()
            if m.lastgroup == "close":
                stack.pop()
            elif m.lastgroup == "hole":
                stack.append(0)
            continue
        m = table.code.search(text, at)
        line = min((e for e in bodies if e >= at), default=None)
        if line is not None and (m is None or m.start() > line):
            spans.append((line, bodies[line]))
            at = bodies.pop(line)
            continue
        if not m:
            break
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind == "atom":
            spans.append((start, at))
        elif kind == "nested":
            at = _balanced(text, start, "/*", "*/")
            spans.append((start, at))
        elif kind == "bracket":
            at = _balanced(text, at - 1, text[at - 1], _CLOSING[text[at - 1]])
            spans.append((start, at))
        elif kind == "later":
            end = text.find("\n", at)
            if end >= 0:
                body = re.compile(rf"^[ \t]*{re.escape(m['end'])}[ \t]*$", re.M).search(text, bodies.get(end, end) + 1)
                bodies[end] = body.end() if body else len(text)
        elif kind == "slash":
            found = _EXPRESSION.match(text, start) if _opens_expression(text, start) else None
            if found:
                spans.append((start, found.end()))
                at = found.end()
        elif kind == "open" and stack:
            stack[-1] += 1
        elif kind == "shut" and stack:
            if stack[-1]:
                stack[-1] -= 1
            else:
                stack.pop()
                spans.append((start, at))
        elif kind and kind[0] == "t" and kind[1:].isdigit():
            spans.append((start, at))
            stack.append(table.templates[int(kind[1:])])
    return spans


def blanked(text: str, grammar: str) -> str:
    """The text with comments and literals made blanks; newlines, and the code in holes, stay."""
    table = TABLES.get(grammar)
    if table is None:
        return text
    out, at = [], 0
    for start, end in _blank_spans(text, table):
        out += [text[at:start], re.sub(r"[^\n]", " ", text[start:end])]
        at = end
    return "".join([*out, text[at:]])
