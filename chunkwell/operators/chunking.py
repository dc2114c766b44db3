"""Chunkers: sliding windows, Markdown sections, Python and other definitions, and their dispatch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.functions.arrays import folded, running_sums
from chunkwell.functions.text import is_blank, newlines, newlines_sql, strip, strip_sql
from chunkwell.operators import definitions
from chunkwell.schema import CHUNK_COLUMNS, FILE_KEY

SIZE, OVERLAP = 1500, 200
#: Strategies and grammars by file type.
STRATEGY = {"txt": "generic", "json": "generic", "xml": "generic", "yaml": "generic", "yml": "generic", "md": "markdown", "py": "python"}
GRAMMAR = {
    "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rb": "ruby", "rs": "rust", "java": "java",
    "c": "c", "cpp": "cpp", "h": "cpp", "hpp": "cpp", "cs": "c_sharp", "php": "php", "dart": "dart", "html": "html", "css": "css",
}
PARSE_ERROR = "parse_error"
WHOLE_FILE = ("html", "css")  # grammars without a definition at top level


def _choose(column: str, values: dict[str, str]) -> Column:
    """The value of a column's text, null for others; the column is named once, as its expression may be long."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col(column))


def dispatch(files: DataFrame) -> DataFrame:
    """Add strategy (generic, markdown, python, code, markup) and grammar."""
    grammar = F.when(_choose("file_type", STRATEGY).isNull(), _choose("file_type", GRAMMAR))
    by_grammar = F.when(grammar.isin(*WHOLE_FILE), "markup").when(grammar.isNotNull(), "code").otherwise("generic")
    return files.withColumn("strategy", F.coalesce(_choose("file_type", STRATEGY), by_grammar)).withColumn("grammar", grammar)


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    return size - overlap


def windows(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP, text: str = "content", whole: Column | None = None) -> DataFrame:
    """A row for each window of each block's text that is not blank: content, start_line and end_line in the block, seq.

    A block for which `whole` holds is one window, its text as it is.
    """
    step = _check(size, overlap)
    whole = F.lit(False) if whole is None else whole
    rest = [c for c in blocks.columns if c != text]
    # the text is cut once, and windows are joined from pieces: a substring would be looked for from the start of the text
    pieces = F.when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))
    rows = blocks.where(~is_blank(text)).select(*rest, whole.alias("_one"), pieces.alias("_p"))
    more = -(-overlap // step)
    joined = f"transform(_p, (x, k) -> substring(array_join(slice(_p, k + 1, {1 + more}), ''), 1, {size}))" if more else "_p"
    lines = f"transform(slice(concat(array(0), {running_sums(f'transform(_p, t -> {newlines_sql("t")})')}), 1, size(_p)), n -> n + 1)"
    rows = rows.select(*rest, "_one", F.posexplode(F.arrays_zip(F.expr(lines).alias("l"), F.expr(f"CASE WHEN _one THEN _p ELSE {joined} END").alias("p"))).alias("seq", "_w"))
    inner = newlines(F.substring("_w.p", F.lit(1), F.length("_w.p") - 1))
    cut = F.when(F.col("_one"), F.col("_w.p")).otherwise(strip("_w.p"))
    rows = rows.select(*rest, cut.alias(text), F.col("_w.l").alias("start_line"), (F.col("_w.l") + inner).alias("end_line"), F.col("seq").cast("int").alias("seq"))
    return rows.where(F.col(text) != "")


def as_chunks(rows: DataFrame, **values: Column) -> DataFrame:
    """Chunk columns, from `values`, else from the rows, else null."""
    out = []
    for name in CHUNK_COLUMNS:
        column = values[name] if name in values else F.col(name) if name in rows.columns else F.lit(None).cast("string")
        out.append(column.alias(name))
    return rows.select(*out)


def generic_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sliding windows of whole files."""
    return as_chunks(windows(files, size, overlap), chunk_type=F.lit("text_block"), language=F.col("file_type"))


def span_dedup(chunks: DataFrame, span: list[str | Column] | None = None) -> DataFrame:
    """The first chunk, by seq, of each span of lines of a file."""
    order = Window.partitionBy(*FILE_KEY, *(span or ["start_line", "end_line"])).orderBy("seq")
    return chunks.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def markup_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, dedup: bool = True) -> DataFrame:
    """Windows of files whose grammar has no definitions; without `dedup` the later windows of one line stay."""
    rows = as_chunks(windows(files, size, overlap), chunk_type=F.lit("top_level_code"), language=F.col("grammar") if "grammar" in files.columns else F.col("file_type"))
    return span_dedup(rows) if dedup else rows


def numbered_lines(files: DataFrame, text: str = "content") -> DataFrame:
    """A row for each line: pos (from 0), line; a newline at the end starts no line."""
    rest = [c for c in files.columns if c != text]
    return files.select(*rest, F.posexplode(F.split(F.regexp_replace(text, r"\n\z", ""), "\n")).alias("pos", "line"))


def markdown_sections(files: DataFrame) -> DataFrame:
    """A chunk for each heading outside fences, and the text before the first, with its path of headings.

    A file stays in its row, and each step goes through its lines once, whatever the number of headings.
    """
    rest = [c for c in FILE_KEY if c in files.columns]
    rows = files.where(~is_blank("content")).select(*rest, F.split(F.regexp_replace("content", r"\n\z", ""), "\n").alias("_lines"))
    rows = rows.select(*rest, "_lines", F.expr(f"transform(_lines, t -> CAST(startswith({strip_sql('t')}, '```') AS int))").alias("_fence"))
    numbered = f"transform(zip_with(_lines, {running_sums('_fence')}, (t, n) -> named_struct('t', t, 'n', n)), (x, k) -> named_struct('at', k, 't', x.t, 'n', x.n))"
    heading = r"x.n % 2 = 0 AND x.t RLIKE r'(?U)\A#+\s'"  # a closing fence is no heading
    title = strip_sql(r"regexp_extract(x.t, r'(?U)\A#+\s(.*)', 1)")
    found = rf"transform(filter({numbered}, x -> {heading}), x -> named_struct('at', x.at, 'level', length(regexp_extract(x.t, r'(?U)\A(#+)\s', 1)), 'title', {title}))"
    rows = rows.select(*rest, "_lines", F.expr(found).alias("_heads"))
    stack = "array<struct<at: int, level: int, title: string>>"  # of levels that rise
    paths = folded("_heads", "array()", "concat(filter(s, y -> y.level < x.level), array(x))", stack)
    starts = "transform(_heads, h -> h.at)"
    # texts are joined before sections become rows: a row with all lines for each section would be copied as often
    section = f"""concat(array(named_struct('a', 0, 'b', coalesce(get({starts}, 0), size(_lines)), 'p', CAST(NULL AS {stack}))),
        zip_with(zip_with({starts}, concat(slice({starts}, 2, size(_heads)), CASE WHEN size(_heads) > 0 THEN array(size(_lines)) ELSE CAST(array() AS array<int>) END), (a, b) -> named_struct('a', a, 'b', b)),
        {paths}, (x, p) -> named_struct('a', x.a, 'b', x.b, 'p', p)))"""
    text = strip_sql("array_join(slice(_lines, x.a + 1, x.b - x.a), chr(10))")
    rows = rows.select(*rest, F.posexplode(F.expr(f"transform({section}, x -> named_struct('a', x.a, 'b', x.b, 'path', transform(x.p, h -> h.title), 'text', {text}))")).alias("seq", "_s"))
    rows = rows.where("_s.b > _s.a and _s.text <> ''").select(
        *rest, F.expr("_s.a + 1").alias("start_line"), F.col("_s.b").alias("end_line"), F.col("_s.text").alias("content"), F.col("seq").cast("int").alias("seq"),
        F.expr("array_join(_s.path, '/')").alias("section"), F.expr("try_element_at(_s.path, -1)").alias("name"), F.expr("try_element_at(_s.path, -2)").alias("parent_name"),
    )
    return as_chunks(rows, chunk_type=F.lit("heading_section"), language=F.lit("markdown"))


def _block_chunks(blocks: DataFrame, size: int, overlap: int, whole: Column, windowed_type: Column, language: Column) -> DataFrame:
    """Chunks of the blocks of files in one pass over them: whole blocks, and windows of the others.

    Lines are shifted to the file's, and windows numbered on from their block's number; a file that did
    not parse is a block of its own, chunked as plain text, and its error a chunk of type PARSE_ERROR.
    """
    failed = F.col("kind") == "error"
    whole = whole | failed
    rows = windows(blocks.withColumnRenamed("seq", "_block"), size, overlap, whole=whole)
    plain = F.col("kind") == "unparsed"
    shift = F.coalesce(F.col("first_line") - 1, F.lit(0))
    return as_chunks(
        rows, start_line=F.col("start_line") + shift, end_line=F.when(whole, F.col("last_line")).otherwise(F.col("end_line") + shift),
        chunk_type=F.when(failed, PARSE_ERROR).when(plain, "text_block").when(whole, F.col("chunk_type")).otherwise(windowed_type),
        language=F.when(plain | failed, F.col("file_type")).otherwise(language), seq=F.col("_block") + F.col("seq"),
    )


def _told(rows: DataFrame, errors: bool) -> DataFrame:
    return rows if errors else rows.where(F.col("chunk_type") != PARSE_ERROR)


def python_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, errors: bool = False) -> DataFrame:
    """Definitions by their syntax tree, windows of the lines between; a file that does not parse is windowed whole."""
    found = files.where(~is_blank("content")).mapInArrow(definitions.python_blocks(_check(size, overlap)), definitions.BLOCK)
    # leading blanks of a block between definitions are cut before its lines are counted
    found = found.withColumn("content", F.when(F.col("kind") == "between", strip("content")).otherwise(F.col("content")))
    return _told(_block_chunks(found, size, overlap, F.col("kind") == "definition", F.lit("top_level_code"), F.lit("python")), errors)


def code_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, parser: str = "grammar", errors: bool = False) -> DataFrame:
    """Definitions of other languages, oversize ones windowed as `<type>_part`, top-level code between windowed."""
    found = files.where(~is_blank("content")).mapInArrow(definitions.code_blocks(parser, size, _check(size, overlap)), definitions.BLOCK)
    found = found.withColumn("_whole", (F.col("kind") == "definition") & (F.length("content") <= size))
    cut = F.when(F.col("kind") == "definition", F.concat("chunk_type", F.lit("_part"))).otherwise("top_level_code")
    rows = _block_chunks(found, size, overlap, F.col("_whole"), cut, F.col("grammar"))
    plain = F.when(F.col("chunk_type").isin("text_block", PARSE_ERROR), F.col("seq"))  # windows of plain text stay, whatever their lines
    return span_dedup(_told(rows, errors), ["start_line", "end_line", plain])


def chunk_files(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP, errors: bool = False) -> DataFrame:
    """Chunks of all files, each by the strategy of its type; with `errors` also a row of type PARSE_ERROR for each file that did not parse, from the same pass."""
    _check(size, overlap)
    dealt = dispatch(files)
    branch = lambda s: dealt.where(F.col("strategy") == s)
    parts = [
        generic_chunks(branch("generic"), size, overlap), markdown_sections(branch("markdown")), python_chunks(branch("python"), size, overlap, errors),
        code_chunks(branch("code"), size, overlap, errors=errors), markup_chunks(branch("markup"), size, overlap),
    ]
    return reduce(DataFrame.unionByName, parts)


def uncovered_runs(files: DataFrame, spans: DataFrame) -> DataFrame:
    """Maximal runs of lines that no span (repo_name, file_path, start_line, end_line) covers: first_line, last_line."""
    lines = numbered_lines(files).select(*FILE_KEY, (F.col("pos") + 1).alias("n"))
    covered = spans.select(*FILE_KEY, F.explode(F.sequence("start_line", "end_line")).alias("n")).distinct()
    free = lines.join(covered, [*FILE_KEY, "n"], "left_anti")
    island = F.col("n") - F.row_number().over(Window.partitionBy(*FILE_KEY).orderBy("n"))
    return free.withColumn("island", island).groupBy(*FILE_KEY, "island").agg(F.min("n").alias("first_line"), F.max("n").alias("last_line")).drop("island")


def syntax_trees(files: DataFrame) -> DataFrame:
    """The syntax trees of files (FILE_KEY, content, grammar): n, depth, kind, line of each node, by a table function joined laterally."""
    rows = files.select(*FILE_KEY, "content", F.coalesce("grammar", F.lit("python")).alias("grammar"))
    tree = F.udtf(definitions.SyntaxTree, returnType=definitions.TREE)
    return rows.lateralJoin(tree(F.col("content").outer(), F.col("grammar").outer())).select(*FILE_KEY, "n", "depth", "kind", "line")
