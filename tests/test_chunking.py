"""Literal fixtures of the chunkers, and windows against a plain model."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chunkwell.operators import chunking, definitions
from chunkwell.operators.definitions import tree_lines
from chunkwell.operators.lexer import blanked

MARKDOWN = "intro\n\n# A\ntext\n```\n# not\n```\n### C\nx\n## B\ny\n####### deep\nz\n#nohead\n# D #\n"
PYTHON = '''"""doc"""
import os

@dec
def f(a):
    def inner():
        return 1
    return inner

X = 1
class C(object):
    @property
    def m(self):
        def n(): pass
        return n
    async def am(self): pass
    class D:
        def q(self): pass
if X:
    def g(): pass
'''
SCRIPT = "const a = 1;\nfunction run(x) {\n  return x;\n}\nclass Box {\n  size() {\n    return 1;\n  }\n}\nrun(a);\n"


def files(spark, **texts):
    rows = [("r", name.replace("__", "."), name.split("__")[-1], text) for name, text in texts.items()]
    return spark.createDataFrame(rows, "repo_name string, file_path string, file_type string, content string")


def test_markdown(spark):
    rows = chunking.markdown_sections(files(spark, a__md=MARKDOWN)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.name, r.parent_name, r.section) for r in rows] == [
        (1, 2, None, None, None), (3, 7, "A", None, "A"), (8, 9, "C", "A", "A/C"), (10, 11, "B", "A", "A/B"), (12, 14, "deep", "B", "A/B/deep"), (15, 15, "D #", None, "D #"),
    ]


def test_python(spark):
    rows = chunking.python_chunks(chunking.dispatch(files(spark, a__py=PYTHON, b__py="def broken(:\n"))).collect()
    found = [(r.chunk_type, r.name, r.parent_name, r.start_line, r.end_line) for r in sorted(rows, key=lambda r: r.seq) if r.file_path == "a.py"]
    assert [x for x in found if x[0] != "top_level_code"] == [
        ("function", "f", None, 4, 8), ("function", "inner", None, 6, 7), ("class", "C", None, 11, 18), ("method", "m", "C", 12, 15), ("method", "n", "C", 14, 14),
        ("async_method", "am", "C", 16, 16), ("class", "D", None, 17, 18), ("method", "q", "D", 18, 18), ("function", "g", None, 20, 20),
    ]
    # the block of lines 9-10 loses its blank line before its lines are counted
    assert [x[3:] for x in found if x[0] == "top_level_code"] == [(1, 2), (9, 9), (19, 19)]
    assert [(r.chunk_type, r.language) for r in rows if r.file_path == "b.py"] == [("text_block", "py")]


def test_code(spark):
    rows = chunking.code_chunks(chunking.dispatch(files(spark, a__js=SCRIPT))).orderBy("start_line", "seq").collect()
    assert [(r.chunk_type, r.name, r.parent_name, r.start_line, r.end_line) for r in rows] == [
        ("top_level_code", None, None, 1, 1), ("function", "run", None, 2, 4), ("class", "Box", None, 5, 9), ("method", "size", "Box", 6, 8), ("top_level_code", None, None, 10, 10),
    ]
    big = "function f() {\n" + "  go();\n" * 400 + "}\n"
    parts = chunking.code_chunks(chunking.dispatch(files(spark, a__js=big))).collect()
    assert {(r.chunk_type, r.name) for r in parts} == {("function_part", "f")} and len(parts) == 3


def test_many_blocks_keep_their_order(spark):
    text = "".join(f"a{i} = {i}\ndef f{i}():\n    return {i}\n" for i in range(12_000))
    rows = chunking.python_chunks(chunking.dispatch(files(spark, a__py=text))).select("seq", "start_line", "chunk_type").collect()
    assert len(rows) == 24_000 == len({r.seq for r in rows})
    for kind in ("function", "top_level_code"):
        lines = [r.start_line for r in sorted(rows, key=lambda r: r.seq) if r.chunk_type == kind]
        assert lines == sorted(lines)
    long = "x = 1\n" * 3000 + "def f():\n    pass\n" + "y = 2\n" * 3000
    rows = chunking.python_chunks(chunking.dispatch(files(spark, a__py=long))).collect()
    loose = [r.start_line for r in sorted(rows, key=lambda r: r.seq) if r.chunk_type == "top_level_code"]
    assert loose == sorted(loose) and len({r.seq for r in rows}) == len(rows)


def test_size_holds_for_definitions_too(spark):
    text = "class Box {\n" + "".join(f"  m{i}() {{\n    return {i};\n  }}\n" for i in range(24)) + "}\n"
    assert 600 < len(text) < 1500
    kinds = lambda size: {r.chunk_type for r in chunking.code_chunks(chunking.dispatch(files(spark, a__js=text)), size, 50).collect()}
    assert kinds(1500) == {"class", "method"} and kinds(500) == {"class_part"}


class FakeNode:
    """A syntax node as the grammars' parser gives it."""

    def __init__(self, type, first, last, *children, name=None, text=""):
        self.type, self.start_point, self.end_point, self.children, self.text = type, (first, 0), (last, 0), list(children), text.encode()
        self.named = FakeNode("identifier", first, first, text=name) if name else None

    def child_by_field_name(self, field):
        return self.named if field == "name" else None


def test_syntax_trees_of_grammars():
    method = FakeNode("method_definition", 2, 3, name="m")
    wrapper = FakeNode("class_body", 1, 4, FakeNode("{", 1, 1), method)
    root = FakeNode("program", 0, 9, FakeNode("lexical_declaration", 0, 0), FakeNode("class_declaration", 1, 4, wrapper, name="Box"), FakeNode("function_declaration", 6, 8, FakeNode("identifier", 6, 6, text="f")))
    loose, box, f = definitions.tree_nodes(root)
    assert (loose.kind, loose.first, loose.last) == (None, 1, 1)
    assert (box.kind, box.name, box.first, box.last, [(c.kind, c.name, c.first) for c in box.children]) == ("class", "Box", 2, 5, [("method", "m", 3)])
    assert (f.kind, f.name) == ("function", "f")
    assert definitions.grammar_nodes("class A {}\n", "javascript")[0].name == "A"


CODE = {
    "go": ("package a\n\ntype Box struct {\n}\n\nfunc (b Box) Size() int {\n\treturn 1\n}\n\nfunc Run() {\n}\n", [("struct", "Box"), ("method", "Size"), ("function", "Run")]),
    "rs": ("struct Box {\n}\n\nimpl Box {\n    fn size() -> i32 {\n        1\n    }\n}\n\ntrait T {\n}\n\npub fn run() {\n}\n", [("struct", "Box"), ("implementation", "Box"), ("function", "size"), ("trait", "T"), ("function", "run")]),
    "java": ("class Box {\n  Box() {\n  }\n  int size() {\n    return 1;\n  }\n}\ninterface I {\n}\n", [("class", "Box"), ("constructor", "Box"), ("method", "size"), ("interface", "I")]),
    "cpp": ("struct P {\n};\nint run(int x) {\n  return x;\n}\n", [("struct", "P"), ("function", "run")]),
    "rb": ("module M\n  class Box\n    def size\n      1\n    end\n  end\nend\n", [("module", "M"), ("class", "Box"), ("method", "size")]),
    "ts": ("interface I {\n}\nfunction run(x: number) {\n  return x;\n}\n", [("interface", "I"), ("function", "run")]),
    "php": ("function run($x) {\n  return $x;\n}\nclass Box {\n}\n", [("function", "run"), ("class", "Box")]),
    "cs": ("class Box {\n  int Size() {\n    return 1;\n  }\n}\n", [("class", "Box"), ("method", "Size")]),
}


@pytest.mark.parametrize("kind", sorted(CODE))
def test_definitions_of_other_languages(spark, kind):
    text, expected = CODE[kind]
    rows = chunking.code_chunks(chunking.dispatch(files(spark, **{f"a__{kind}": text}))).orderBy("seq").collect()
    assert [(r.chunk_type, r.name) for r in rows if r.chunk_type != "top_level_code"] == expected


#: Tokens that hold braces or keywords without meaning them, and the definitions of the text around them.
TOKENS = {
    "javascript": ("const t = `a ${ f({x: `}${'}'}`}) } {`;\nconst r = /[/{]+\\/{/g; const q = a / b / c; // {\nfunction one() {\n  return /}/.test('{');\n}\nclass Two {\n}\n", [("function", "one", 3, 5), ("class", "Two", 6, 7)]),
    "typescript": ("/* { */ const s: string = `{\n{`;\ninterface One {\n}\nfunction two(x: string) {\n  return x.split(/{/);\n}\n", [("interface", "One", 3, 4), ("function", "two", 5, 7)]),
    "go": ("var s = `{ \\`\nvar r = '{'\nfunc one() {\n\tx := \"}\"\n}\ntype Two struct {\n}\n", [("function", "one", 3, 5), ("struct", "Two", 6, 7)]),
    "rust": ("/* a /* { */ { */\nfn one<'a>(x: &'a str) {\n  let r = r#\"} \" {\"#;\n  let c = '{'; let d = '\\'';\n}\nstruct Two {\n}\n", [("function", "one", 2, 5), ("struct", "Two", 6, 7)]),
    "java": ("class One {\n  String s = \"\"\"\n  { \\\"\"\" {\n  \"\"\";\n  int two() {\n    char c = '{';\n    return 1;\n  }\n}\n", [("class", "One", 1, 9), ("method", "two", 5, 8)]),
    "c": ("// a \\\n {\nint one(int x) {\n  char c = '}'; char *s = \"{\\\"{\";\n  return x;\n}\n", [("function", "one", 3, 6)]),
    "cpp": ("int n = 1'000'000;\nauto s = R\"x({ )\" })x\";\nint one(int x) {\n  return x; /* } */\n}\nstruct Two {\n};\n", [("function", "one", 3, 5), ("struct", "Two", 6, 7)]),
    "c_sharp": ("class One {\n  string a = @\"\\{ \"\" {\"; string b = $\"{{ {f($\"{1}\")} {{\"; string c = $@\"\\{1}\";\n  string d = \"\"\"\"{ \"\"\" {\"\"\"\";\n  int Two() {\n    return 1;\n  }\n}\n", [("class", "One", 1, 7), ("method", "Two", 4, 6)]),
    "php": ("$a = <<<EOT\n{ function no() {\n  EOT;\n# {\n#[Attribute]\nfunction one($x) {\n  return \"{\n}{\";\n}\nclass Two {\n}\n", [("function", "one", 6, 9), ("class", "Two", 10, 11)]),
    "dart": ("/* /* { */ { */\nvar a = r'\\{'; var b = \"\"\"{ ${f('}')} {\"\"\"; var c = '${{1}} {';\nclass Two {\n  int one() {\n    return 1;\n  }\n}\n", [("class", "Two", 3, 7), ("method", "one", 4, 6)]),
    "ruby": ("=begin\ndef no\n=end\nA = <<~ONE + <<TWO\n  def neither\n  ONE\nend\nTWO\nmodule M\n  def one(x)\n    y = \"#{x.map { |z| \"end\" }} end\" # end\n    %q(end (end) class X) =~ /end/\n  end\nend\n", [("module", "M", 9, 14), ("method", "one", 10, 13)]),
}


@pytest.mark.parametrize("grammar", sorted(TOKENS))
def test_tokens_that_hold_braces(grammar):
    text, expected = TOKENS[grammar]
    found = []

    def visit(nodes):
        for n in nodes:
            if n.kind is not None:
                found.append((n.kind, n.name, n.first, n.last))
            visit(n.children)

    visit(definitions.lexical_nodes(text, grammar))
    assert found == expected
    bare = blanked(text, grammar)
    assert [len(x) for x in bare.split("\n")] == [len(x) for x in text.split("\n")]


@given(st.text(alphabet="{}`$'\"/*\\#r@<~A(n\n ", max_size=60), st.sampled_from(sorted(TOKENS)))
def test_any_text_keeps_its_lines(text, grammar):
    bare = blanked(text, grammar)
    assert len(bare) == len(text) and all(a in (b, " ") for a, b in zip(bare, text, strict=True)) and [c == "\n" for c in bare] == [c == "\n" for c in text]


def test_one_line_markup_keeps_its_first_window(spark):
    rows = files(spark, a__html="x" * 4000)
    assert chunking.markup_chunks(rows).count() == 1
    assert chunking.markup_chunks(rows, dedup=False).count() == 4


@pytest.mark.parametrize(("text", "count"), [("a" * 1300, 1), ("a" * 1301, 2), ("a" * 1500, 2), ("", 0), (" \n\t", 0), (" " * 1300 + "a", 2)])
def test_window_edges(spark, text, count):
    assert chunking.generic_chunks(files(spark, a__txt=text)).count() == count


def test_overlap_must_be_less_than_size(spark):
    with pytest.raises(ValueError):
        chunking.generic_chunks(files(spark, a__txt="x"), 10, 10)


def test_all_strategies(spark):
    rows = chunking.chunk_files(files(spark, a__md=MARKDOWN, b__py=PYTHON, c__js=SCRIPT, d__html="<p>", e__txt="x", f__zzz="y")).collect()
    assert {r.file_path for r in rows} == {"a.md", "b.py", "c.js", "d.html", "e.txt", "f.zzz"}


def test_tree():
    assert tree_lines("x = 1\n")[:2] == [(0, "Module", "x = 1"), (1, "Assign", "x = 1")]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab \n\r😀é", max_size=60), min_size=1, max_size=5), st.sampled_from([(10, 4), (10, 8), (10, 9), (7, 0), (200, 199)]))
def test_windows_equal_a_model(spark, texts, sizes):
    size, overlap = sizes
    rows = spark.createDataFrame([("r", str(i), "txt", t) for i, t in enumerate(texts)], "repo_name string, file_path string, file_type string, content string")
    got = sorted((r.file_path, r.seq, r.content, r.start_line, r.end_line) for r in chunking.generic_chunks(rows, size, overlap).collect())
    expected = []
    for i, t in enumerate(texts):
        for k, at in enumerate(range(0, len(t), size - overlap)):
            part = t[at : at + size]
            if t.strip() and part.strip():
                expected.append((str(i), k, part.strip(), 1 + t[:at].count("\n"), 1 + t[: min(at + size, len(t)) - 1].count("\n")))
    assert got == sorted(expected)


def test_long_texts_take_time_in_proportion(spark):
    text = "".join(f"line {i} of a very long text\n" for i in range(150_000))  # 4 MB
    rows = chunking.generic_chunks(files(spark, a__txt=text)).select("seq", "start_line", "end_line", "content").collect()
    starts = range(0, len(text), 1300)
    assert len(rows) == len(starts)
    for r in rows[:: len(rows) // 50]:
        at = starts[r.seq]
        assert (r.content, r.start_line) == (text[at : at + 1500].strip(), 1 + text.count("\n", 0, at))


def test_very_many_headings(spark):
    levels = [1 + (i * 7919) % 11 for i in range(100_000)]
    text = "before\n" + "".join(f"{'#' * n} h{i}\ntext\n" for i, n in enumerate(levels))
    stack, expected = [], {}
    for i, n in enumerate(levels):
        stack = [x for x in stack if x[0] < n] + [(n, f"h{i}")]
        expected[i + 1] = (2 * i + 2, 2 * i + 3, "/".join(h for _, h in stack))
    rows = chunking.markdown_sections(files(spark, a__md=text)).select("seq", "start_line", "end_line", "section").collect()
    found = {r.seq: (r.start_line, r.end_line, r.section) for r in rows}
    assert found.pop(0) == (1, 1, None) and found == expected


def test_running_sums_and_folds(spark):
    from pyspark.sql import functions as F

    from chunkwell.functions.arrays import folded, running_sums

    for n in (0, 1, 63, 64, 65, 4200):
        numbers = [(i * 37) % 11 - 5 for i in range(n)]
        row = spark.createDataFrame([(numbers,)], "x array<int>").select(F.expr(running_sums("x")).alias("s"), F.expr(folded("x", "0", "greatest(s + x, 0)", "int")).alias("f")).collect()[0]
        sums, states, total, state = [], [], 0, 0
        for x in numbers:
            total, state = total + x, max(state + x, 0)
            sums.append(total)
            states.append(state)
        assert (row.s, row.f) == (sums, states)
