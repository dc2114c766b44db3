"""Queries over the driver's tables and their SQL equivalents.

The tables hold no source files, so files, Markdown, digests, answers and chunks are derived from
them by the same expressions on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwell.functions import text as T
from chunkwell.operators import cells, chat, chunking, retrieval
from chunkwell.plans import prompt as prompts
from chunkwell.plans.engine import ExtractiveGenerator, answer_many, safe_answer
from chunkwell.schema import CHUNK_COLUMNS
from chunkwell.sources import files as sources
from chunkwell.sources.store import Store, merged, scratch_store, with_ids

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EXTENSIONS = [".md", ".txt", ".PY", ".js", "", ".tar.gz", ".html", ".json"]
QUESTION_TOP = 6


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- derived tables


def _path() -> Column:
    extension = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return F.concat(F.lit("src/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), extension)


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id")
    return docs.select(F.col("source").alias("repo_name"), _path().alias("file_path"), T.file_type(_path()).alias("file_type"), F.col("text").alias("content"))


_EXT_SQL = "CASE doc_id % 8 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.PY' WHEN 3 THEN '.js' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' WHEN 6 THEN '.html' ELSE '.json' END"
_PATH_SQL = f"'src/' || lang || '/' || doc_id || {_EXT_SQL}"
_TYPE_SQL = "CASE doc_id % 8 WHEN 0 THEN 'md' WHEN 1 THEN 'txt' WHEN 2 THEN 'py' WHEN 3 THEN 'js' WHEN 4 THEN 'unknown' WHEN 5 THEN 'gz' WHEN 6 THEN 'html' ELSE 'json' END"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_RAW_SQL = f"raw AS (SELECT source AS repo_name, {_PATH_SQL} AS file_path, {_TYPE_SQL} AS file_type, text AS content FROM documents)"


def _windows_sql(source: str, keys: str, text: str) -> str:
    """Windows of a table: keys, content, start_line, end_line, seq."""
    lines = lambda x: f"CAST(1 + length({x}) - length(replace({x}, chr(10), '')) AS INTEGER)"
    part = f"substring({text}, o + 1, 1500)"
    return f"""
        SELECT {keys}, {_STRIP.format(part)} AS content, {lines(f"substring({text}, 1, o)")} AS start_line,
            {lines(f"substring({text}, 1, least(o + 1500, length({text})) - 1)")} AS end_line, CAST(o // 1300 AS INTEGER) AS seq
        FROM (SELECT *, unnest(range(0, length({text}), 1300)) AS o FROM {source}) WHERE {_STRIP.format(part)} <> ''"""


_GENERIC_SQL = f"{_RAW_SQL}, chunks AS ({_windows_sql('raw', 'repo_name, file_path, file_type', 'content')})"
_COLUMNS = "repo_name, file_path, start_line, end_line, chunk_type, language, content, seq"


def _brief(chunks: DataFrame) -> DataFrame:
    return chunks.select(*_COLUMNS.split(", "))


# ---------------------------------------------------------------- chunking


@query(f"WITH {_GENERIC_SQL} SELECT repo_name, file_path, start_line, end_line, 'text_block' AS chunk_type, file_type AS language, content, seq FROM chunks")
def generic_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(chunking.generic_chunks(raw_files(spark, sf_dir)))


_PAGE_WINDOWS = f"w AS ({_windows_sql('pages', 'page_id', 'html')})"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select(F.lit("web").alias("repo_name"), F.col("page_id").cast("string").alias("file_path"), F.lit("html").alias("file_type"), F.col("html").alias("content"))


@query(
    f"""WITH {_PAGE_WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, start_line, end_line ORDER BY seq) AS n FROM w)
    SELECT 'web' AS repo_name, CAST(page_id AS VARCHAR) AS file_path, start_line, end_line, 'top_level_code' AS chunk_type, 'html' AS language, content, seq FROM r WHERE n = 1"""
)
def html_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _brief(chunking.markup_chunks(_pages(spark, sf_dir)))


@query(f"WITH {_PAGE_WINDOWS} SELECT CAST(page_id AS VARCHAR) AS file_path, count(*) AS windows, count(DISTINCT (start_line, end_line)) AS spans FROM w GROUP BY page_id")
def html_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.markup_chunks(_pages(spark, sf_dir), dedup=False)
    return rows.groupBy("file_path").agg(F.count("*").alias("windows"), F.countDistinct("start_line", "end_line").alias("spans"))


@query(f"WITH {_RAW_SQL} SELECT file_path, file_type FROM raw")
def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_files(spark, sf_dir).select("file_path", "file_type")


@query(
    f"""WITH {_RAW_SQL}, d AS (SELECT CASE file_type WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'js' THEN 'code' WHEN 'html' THEN 'markup' ELSE 'generic' END AS strategy,
        CASE file_type WHEN 'js' THEN 'javascript' WHEN 'html' THEN 'html' END AS grammar FROM raw) SELECT strategy, grammar, count(*) AS files FROM d GROUP BY ALL"""
)
def dispatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.dispatch(raw_files(spark, sf_dir)).groupBy("strategy", "grammar").agg(F.count("*").alias("files"))


_BAR = "=" * 48
#: Headers of a digest: with a blank before the path or none, and with an empty path.
_HEADS = (f"\n{_BAR}\nFILE: {{}}\n{_BAR}\n", f"\r\n{_BAR}\r\nFILE:{{}}\r\n{_BAR}\r\n", f"\n{_BAR}\nFILE: \n{_BAR}\nbody without a path\n", f"\n{_BAR}\nFILE: empty.txt\n{_BAR}\n\n")


def _digest(path: str, content: str, join: str, text: Callable[[str], str]) -> str:
    """A digest of three files and more, as an expression in the language of `join` and `text`."""
    parts = [text("before")]
    for head, name in ((_HEADS[0], path), (_HEADS[2], ""), (_HEADS[3], ""), (_HEADS[1], f"{path}{join}{text('.bak')}")):
        first, _, rest = head.partition("{}")
        parts += [text(first), name, text(rest), content, text("\n")] if name else [text(head)]
    return join.join(parts)


def _sql_text(x: str) -> str:
    return " || ".join(f"'{p}'" if p not in "\r\n" else f"chr({ord(p)})" for p in re.split(r"([\r\n])", x) if p)


_HEADER_SQL = r"={48}\s*FILE:\s*(.*?)\s*={48}\s*"


@query(
    f"""WITH {_RAW_SQL}, d AS (SELECT repo_name, replace({_digest('file_path', 'content', ' || ', _sql_text)}, chr(13) || chr(10), chr(10)) AS digest FROM raw),
    f AS (SELECT repo_name, unnest(regexp_extract_all(digest, '{_HEADER_SQL}', 1)) AS file_path, unnest(string_split_regex(digest, '{_HEADER_SQL}')[2:]) AS content FROM d),
    s AS (SELECT repo_name, {_STRIP.format('file_path')} AS file_path, {_STRIP.format('content')} AS content FROM f)
    SELECT s.repo_name, s.file_path, CASE WHEN ends_with(s.file_path, '.bak') THEN 'bak' ELSE r.file_type END AS file_type, s.content
    FROM s LEFT JOIN (SELECT DISTINCT file_path, file_type FROM raw) r USING (file_path) WHERE s.file_path <> '' AND s.content <> ''"""
)
def digest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests with either line ending, a header without a blank, an empty path and an empty body, split again."""
    plain = _digest("file_path", "content", ", ", lambda x: "'" + x.replace("\r", "\\r").replace("\n", "\\n") + "'")
    rows = raw_files(spark, sf_dir)
    return sources.split_digest(rows.select("repo_name", F.expr(f"concat({plain})").alias("digest")))


@query(
    f"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
    m AS (SELECT doc_id, pos, CASE WHEN pos % 11 = 0 THEN '```' WHEN pos % 5 = 0 THEN repeat('#', CAST(1 + pos % 3 AS INTEGER)) || ' ' || raw ELSE raw END AS line FROM l),
    f AS (SELECT *, starts_with({_STRIP.format('line')}, '```') AS fence FROM m),
    s AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM f),
    h AS (SELECT *, NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^#+\\s') AS heading FROM s),
    g AS (SELECT *, sum(CAST(heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS sec FROM h),
    p AS (SELECT doc_id, sec, min(pos) AS a, max(pos) AS b, {_STRIP.format("string_agg(line, chr(10) ORDER BY pos)")} AS content,
        max(CASE WHEN heading THEN length(regexp_extract(line, '^(#+)\\s', 1)) END) AS level,
        max(CASE WHEN heading THEN {_STRIP.format("regexp_extract(line, '^#+\\s(.*)', 1)")} END) AS title FROM g GROUP BY doc_id, sec),
    n AS (SELECT x.doc_id, x.sec, x.level, x.title, (SELECT min(y.sec) FROM p y WHERE y.doc_id = x.doc_id AND y.sec > x.sec AND y.level <= x.level) AS nxt FROM p x WHERE x.level IS NOT NULL),
    t AS (SELECT i.doc_id, i.sec, string_agg(j.title, '/' ORDER BY j.sec) AS section, list(j.title ORDER BY j.sec) AS names
        FROM p i JOIN n j ON j.doc_id = i.doc_id AND j.sec <= i.sec AND (j.nxt IS NULL OR i.sec < j.nxt) WHERE i.level IS NOT NULL GROUP BY i.doc_id, i.sec)
    SELECT CAST(p.doc_id AS VARCHAR) AS file_path, CAST(a + 1 AS INTEGER) AS start_line, CAST(b + 1 AS INTEGER) AS end_line, names[-1] AS name, names[-2] AS parent_name, section, content
    FROM p LEFT JOIN t USING (doc_id, sec) WHERE content <> ''"""
)
def markdown_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")

    def line(x: Column, i: Column) -> Column:
        headed = F.concat(F.substring(F.lit("###"), F.lit(1), (1 + i % 3).cast("int")), F.lit(" "), x)
        return F.when(i % 11 == 0, F.lit("```")).when(i % 5 == 0, headed).otherwise(x)

    text = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    rows = docs.select(F.col("source").alias("repo_name"), F.col("doc_id").cast("string").alias("file_path"), text.alias("content"))
    return chunking.markdown_sections(rows).select("file_path", "start_line", "end_line", "name", "parent_name", "section", "content")


@query(
    f"""WITH {_GENERIC_SQL}, i AS (SELECT *, translate(repo_name, '/.', '__') || '_' || translate(file_path, '/.', '__') || '_' || start_line || '_' || end_line AS k FROM chunks),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY file_path, seq, content) AS n FROM i)
    SELECT CASE WHEN n = 1 THEN k ELSE k || '_' || n END AS id, file_path, start_line, end_line, seq FROM n"""
)
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(chunking.generic_chunks(raw_files(spark, sf_dir))).select("id", "file_path", "start_line", "end_line", "seq")


@query(
    f"""WITH {_GENERIC_SQL} SELECT translate(repo_name, '/.', '__') || '_' || translate(file_path, '/.', '__') || '_' || start_line || '_' || end_line AS id, count(*) AS n
    FROM chunks GROUP BY 1 HAVING count(*) > 1"""
)
def chunk_id_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.generic_chunks(raw_files(spark, sf_dir))
    return rows.groupBy(T.chunk_id("repo_name", "file_path", "start_line", "end_line").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query(
    r"""WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT url FROM pages)
    SELECT name, substring(regexp_replace(lower(regexp_replace(name, '[^a-zA-Z0-9_.-]', '_', 'g')), '^[_.]+|[_.]+$', '', 'g'), 1, 63) AS collection FROM n"""
)
def normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "pages").select("url"))
    return names.select("name", T.collection_name("name").alias("collection"))


@query(
    r"""SELECT url, replace(replace(regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?|[?#].*$', '', 'g'), '^/+', ''), '.git', ''), '/', '--') AS repo_name FROM pages"""
)
def repo_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("url", T.repository_name("url").alias("repo_name"))


@query(
    f"""WITH {_GENERIC_SQL}, k AS (SELECT file_path, start_line, end_line, seq, file_type, CASE file_type WHEN 'html' THEN 'top_level_code' ELSE 'text_block' END AS chunk_type FROM chunks),
    d AS (SELECT *, row_number() OVER (PARTITION BY file_path, start_line, end_line ORDER BY seq) AS n FROM k)
    SELECT chunk_type, count(*) AS chunks FROM d WHERE file_type <> 'html' OR n = 1 GROUP BY 1"""
)
def chunk_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw_files(spark, sf_dir)
    both = chunking.generic_chunks(rows.where("file_type <> 'html'")).unionByName(chunking.markup_chunks(rows.where("file_type = 'html'")))
    return both.groupBy("chunk_type").agg(F.count("*").alias("chunks")).orderBy("chunk_type")  # a row a type


@query(f"WITH {_GENERIC_SQL} SELECT file_path, count(*) AS chunks FROM chunks GROUP BY 1")
def file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.generic_chunks(raw_files(spark, sf_dir)).groupBy("file_path").agg(F.count("*").alias("chunks")).orderBy("file_path")


@query(f"WITH {_GENERIC_SQL} SELECT count(DISTINCT (repo_name, file_path)) AS files, count(*) AS chunks, count(DISTINCT (repo_name, file_path, start_line, end_line)) AS spans FROM chunks")
def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.generic_chunks(raw_files(spark, sf_dir))
    return rows.agg(
        F.countDistinct("repo_name", "file_path").alias("files"), F.count("*").alias("chunks"), F.countDistinct("repo_name", "file_path", "start_line", "end_line").alias("spans")
    )


@query(
    f"""WITH {_GENERIC_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY repo_name ORDER BY file_path, seq) AS n FROM chunks)
    SELECT repo_name, file_path, seq, substring(content, 1, 200) AS preview FROM r WHERE n <= 5"""
)
def chunk_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five chunks of each repository, shortened: a report of five rows is the feature."""
    n = F.row_number().over(Window.partitionBy("repo_name").orderBy("file_path", "seq"))
    rows = chunking.generic_chunks(raw_files(spark, sf_dir)).withColumn("n", n).where("n <= 5")
    return rows.select("repo_name", "file_path", "seq", F.substring("content", 1, 200).alias("preview"))


_SPAN_SQL = "CAST(1 + doc_id % 3 AS INTEGER) AS s, CAST(1 + doc_id % 3 + doc_id % 2 AS INTEGER) AS e"


@query(
    f"""WITH l AS (SELECT doc_id, source AS repo_name, {_PATH_SQL} AS file_path, {_SPAN_SQL}, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    f AS (SELECT repo_name, file_path, n, n - row_number() OVER (PARTITION BY repo_name, file_path ORDER BY n) AS g FROM l WHERE NOT n BETWEEN s AND e)
    SELECT repo_name, file_path, CAST(min(n) AS INTEGER) AS first_line, CAST(max(n) AS INTEGER) AS last_line FROM f GROUP BY repo_name, file_path, g"""
)
def uncovered_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    start = (1 + F.col("doc_id") % 3).cast("int")
    spans = docs.select(F.col("source").alias("repo_name"), _path().alias("file_path"), start.alias("start_line"), (start + F.col("doc_id") % 2).cast("int").alias("end_line"))
    return chunking.uncovered_runs(raw_files(spark, sf_dir), spans)


# ---------------------------------------------------------------- nearest neighbours

_DISTANCE = "list_sum(list_transform(list_zip({}, {}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"


@query(
    f"""WITH q AS (SELECT embedding AS p FROM embeddings ORDER BY vec_id LIMIT 1), d AS (SELECT vec_id, {_DISTANCE.format('embedding', 'p')} AS distance FROM embeddings, q)
    SELECT CAST(row_number() OVER (ORDER BY distance, vec_id) AS INTEGER) AS "rank", vec_id, distance FROM d ORDER BY distance, vec_id LIMIT 3"""
)
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    point = rows.orderBy("vec_id").limit(1).collect()[0]["embedding"]
    return retrieval.nearest(rows, point, 3).select("rank", "vec_id", "distance")


_BATCH_SQL = f"""q AS (SELECT vec_id AS query_no, embedding AS p FROM embeddings WHERE vec_id % 50 = 0),
    d AS (SELECT query_no, vec_id, label, {_DISTANCE.format('embedding', 'p')} AS distance FROM embeddings, q),
    h AS (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY distance, vec_id) AS r FROM d QUALIFY r <= 3)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors, dealt to all cores: a file of one row group is read in one task."""
    return table(spark, sf_dir, "embeddings").repartition(spark.sparkContext.defaultParallelism, "vec_id")


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    return retrieval.nearest_to_each(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("point")), 3)


@query(f'WITH {_BATCH_SQL} SELECT query_no, CAST(r AS INTEGER) AS "rank", vec_id, distance FROM h')
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batch(spark, sf_dir).select("query_no", "rank", "vec_id", "distance")


@query(
    f"""WITH {_BATCH_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY query_no, r) AS n FROM h)
    SELECT CAST(row_number() OVER (ORDER BY query_no, r) AS INTEGER) AS place, query_no, CAST(r AS INTEGER) AS "rank", vec_id, label FROM k WHERE n = 1"""
)
def two_pass_union_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_wins(_batch(spark, sf_dir), ["label"]).select("place", "query_no", "rank", "vec_id", "label")


@query(f'WITH {_BATCH_SQL} SELECT query_no, CAST(r AS INTEGER) AS "rank", vec_id FROM h')
def context_expand_noop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.expand_context(_batch(spark, sf_dir), 2).select("query_no", "rank", "vec_id")


def _embed_sql(name: str, source: str, key: str) -> str:
    bucket = "('0x' || substr(md5(w), 1, 8))::BIGINT % 256"
    words = rf"SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS w FROM {source}"
    return f"{name} AS (SELECT {key}, {bucket} AS b, count(*) AS w FROM ({words}) WHERE w <> '' GROUP BY ALL)"


_SEARCH_SQL = f"""{_embed_sql('de', 'documents', 'doc_id')}, {_embed_sql('qe', '(SELECT * FROM benchmark WHERE item_id % 50 = 0)', 'item_id')},
    dn AS (SELECT doc_id, sum(w * w) AS a FROM de GROUP BY 1), qn AS (SELECT item_id, sum(w * w) AS b FROM qe GROUP BY 1),
    dots AS (SELECT item_id, doc_id, sum(de.w * qe.w) AS dot FROM de JOIN qe USING (b) GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, dot::DOUBLE / (sqrt(a::DOUBLE) * sqrt(b::DOUBLE)) AS score FROM dots JOIN dn USING (doc_id) JOIN qn USING (item_id)),
    hits AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM sc QUALIFY r <= {QUESTION_TOP})"""


def _search(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = retrieval.HashedEmbedder()
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0")
    return retrieval.sparse_top_k(model.add(sources.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "text"), "doc_id", model.add(asked, "text"), "item_id", QUESTION_TOP)


@query(f'WITH {_SEARCH_SQL} SELECT item_id, CAST(r AS INTEGER) AS "rank", doc_id, score FROM hits')
def text_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir).select("item_id", "rank", "doc_id", "score")


@query(f'WITH {_BATCH_SQL} SELECT query_no, CAST(r AS INTEGER) AS "rank", vec_id, distance FROM h')
def cells_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of all cells of an index over the vectors."""
    return _by_cells(spark, sf_dir, None)


@query()
def cells_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search of the cells nearest to each query only; its recall is measured in the tests."""
    return _by_cells(spark, sf_dir, cells.PROBES)


def _by_cells(spark: SparkSession, sf_dir: str, probes: int | None) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("vec_id", "embedding")
    model = cells.train(rows, "vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_no"), F.col("embedding").alias("point"))
    return cells.search(cells.with_cell(rows, model, "embedding"), model, asked, 3, probes, vector="embedding")


_DENSE_SQL = f"""{_embed_sql('de', 'documents', 'doc_id').replace('% 256', '% 384')}, {_embed_sql('qe', '(SELECT * FROM benchmark WHERE item_id % 50 = 0)', 'item_id').replace('% 256', '% 384')},
    dn AS (SELECT doc_id, coalesce((SELECT sum(w * w) FROM de WHERE de.doc_id = documents.doc_id), 0) AS a FROM documents WHERE text IS NOT NULL),
    qn AS (SELECT item_id, coalesce((SELECT sum(w * w) FROM qe WHERE qe.item_id = benchmark.item_id), 0) AS b FROM benchmark WHERE item_id % 50 = 0 AND text IS NOT NULL),
    dots AS (SELECT item_id, doc_id, sum(de.w * qe.w) AS dot FROM de JOIN qe USING (b) GROUP BY ALL),
    sc AS (SELECT item_id, doc_id, (a + b - 2 * coalesce(dot, 0))::DOUBLE AS distance FROM dn CROSS JOIN qn LEFT JOIN dots USING (item_id, doc_id))"""


@query(f'WITH {_DENSE_SQL} SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) AS INTEGER) AS "rank", doc_id, distance FROM sc QUALIFY "rank" <= 6')
def dense_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents nearest to questions by dense vectors that a model makes on the executors."""
    model = retrieval.ModelEmbedder(retrieval.HashedVectors)
    docs = model.add(sources.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "text").select("doc_id", "vector")
    asked = model.add(table(spark, sf_dir, "benchmark").where("item_id % 50 = 0").select("item_id", "text"), "text")
    points = asked.where("vector is not null").select(F.col("item_id").alias("query_no"), F.col("vector").alias("point"))
    found = retrieval.nearest_to_each(docs, points, QUESTION_TOP, key="doc_id", embedding="vector")
    return found.select(F.col("query_no").alias("item_id"), "rank", "doc_id", "distance")


# ---------------------------------------------------------------- prompts


@query("SELECT doc_id, CAST(length(text) // 4 AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate("text").alias("tokens"))


@query(
    """WITH t AS (SELECT conv_id, turn, CAST(length(text) // 4 AS INTEGER) AS tokens FROM conversations),
    s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn) AS c FROM t) SELECT conv_id, turn, tokens FROM s WHERE 10 + c < 400"""
)
def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate("text").alias("tokens"))
    return prompts.within_budget(rows, 10, 400, order="turn", key=["conv_id"])


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_HITS_SQL = f"""{_SEARCH_SQL}, one AS (SELECT CAST(r AS INTEGER) AS place, 'src/' || doc_id AS file_path, lang AS language, text AS content FROM hits JOIN documents USING (doc_id) WHERE item_id = 0),
    ct AS (SELECT place, chr(10) || '<DOC_START>' || chr(10) || 'File: ' || file_path || chr(10) || 'Language: ' || language || chr(10) || 'Type: text_block  (Parent: )' || chr(10) ||
        'Lines: 1-' || (1 + length(content) - length(replace(content, chr(10), ''))) || chr(10) || chr(10) || content || chr(10) || '<DOC_END>' || chr(10) AS t FROM one)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _search(spark, sf_dir).where("item_id = 0").select(F.col("rank").alias("place"), "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rows = best.join(docs, "doc_id")
    return rows.select(
        "place", F.lit("documents").alias("repo_name"), F.concat(F.lit("src/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("lang").alias("language"),
        F.lit("text_block").alias("chunk_type"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("parent_name"),
        F.lit(1).alias("start_line"), (1 + T.newlines(F.col("text"))).alias("end_line"), F.col("text").alias("content"),
    )


def _prompt_sql(system: str, head: str, context: str, ending: str, history: str, counted: bool) -> str:
    q = "What is in this collection?"
    base = len(system) // 4 + len(f"{head}{q}\n\n{context}") // 4 + (len(history) // 4 if counted else 0)
    first, last = f"{system}\n\n---\n{history}{head}{q}\n\n{context}\n", f"\n\n---\n{ending}\n"
    return f"""WITH {_HITS_SQL}, s AS (SELECT *, sum(length(t) // 4) OVER (ORDER BY place) AS c FROM ct), k AS (SELECT * FROM s WHERE {base} + c < 4000)
        SELECT {_STRIP.format(_quote(first) + " || coalesce(string_agg(t, chr(10) || chr(10) ORDER BY place), '') || " + _quote(last))} AS prompt, CAST(count(*) AS INTEGER) AS chunks FROM k"""


_ANSWER = "Answer the query above from these excerpts, as the instructions say."
_SPLIT = "Reply with the JSON object of smaller questions now."
_PAST = "Conversation History:\nUser (Turn 1): hello\nAssistant (Turn 1): ask away\n\n"


def _past() -> Column:
    return prompts.history_text(F.array(F.struct(F.lit("hello").alias("query"), F.lit("ask away").alias("response"))))


@query(_prompt_sql(prompts.SYSTEM, "User Query: ", "Relevant Code Context:", _ANSWER, "", False))
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.rag_prompt(_hits(spark, sf_dir), "What is in this collection?", limit=4000)


@query(_prompt_sql(prompts.SUBQUESTION_SYSTEM, "Original User Query: ", "Initial Code Context:", _SPLIT, _PAST, True))
def subquestion_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.subquestion_prompt(_hits(spark, sf_dir), "What is in this collection?", _past(), limit=4000)


_ANSWERS_SQL = f"""{_SEARCH_SQL.replace('score DESC, doc_id', 'score DESC, doc_id::VARCHAR').replace(f'r <= {QUESTION_TOP}', 'r <= 3')},
    ct AS (SELECT item_id, r, doc_id, 1 + length(text) - length(replace(text, chr(10), '')) AS n,
        length(text) + length('src/' || doc_id) + length(lang) + length(n::VARCHAR) + {len("<DOC_START>") + len("File: ") + len("Language: ") + len("Type: text_block  (Parent: )") + len("Lines: 1-") + len("<DOC_END>") + 9 - 1} AS size
        FROM hits JOIN documents USING (doc_id)),
    s AS (SELECT *, sum(size // 4) OVER (PARTITION BY item_id ORDER BY r) AS c FROM ct),
    k AS (SELECT s.*, b.text AS q FROM s JOIN benchmark b USING (item_id) WHERE {len(prompts.SYSTEM) // 4} + ({len(prompts.QUERY_LABEL + prompts.CONTEXT_LABEL) + 2} + length(b.text)) // 4 + c < {prompts.MAX_TOKENS}),
    a AS (SELECT item_id, count(*) AS chunks, string_agg('See [FILE: src/' || doc_id || ', LINES: 1-' || n || '].', chr(10) ORDER BY r) AS answer FROM k GROUP BY item_id)"""


@query(
    f"""WITH {_ANSWERS_SQL} SELECT b.item_id, CAST(coalesce(chunks, 0) AS INTEGER) AS chunks, coalesce(answer, {_quote(prompts.NOT_FOUND)}) AS answer, CAST(coalesce(chunks, 0) AS INTEGER) AS sources,
    CASE WHEN answer IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM benchmark b LEFT JOIN a USING (item_id) WHERE b.item_id % 50 = 0 AND b.text IS NOT NULL"""
)
def answers_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every question of a table answered in one plan: search, budget, prompt, answer and sources by question."""
    docs = sources.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id")
    chunks = chunking.as_chunks(
        docs, repo_name=F.lit("documents"), file_path=F.concat(F.lit("src/"), F.col("doc_id").cast("string")), start_line=F.lit(1), end_line=1 + T.newlines(F.col("text")),
        chunk_type=F.lit("text_block"), language=F.col("lang"), name=F.lit(None).cast("string"), content=F.col("text"), seq=F.lit(0),
    )
    model = retrieval.HashedEmbedder()
    records = model.add(chunks.withColumn("id", F.substring("file_path", 5, 40)), "content")
    asked = table(spark, sf_dir, "benchmark").where("item_id % 50 = 0 and text is not null").select("item_id", F.col("text").alias("query"))
    return answer_many(records, asked, "item_id", model).withColumn("sources", F.size("sources"))


def _answers() -> Column:
    a = 1 + F.col("doc_id") % 50
    one = F.concat(F.lit(" [FILE: src/"), F.col("doc_id").cast("string"), F.lit(".py, LINES: "), a.cast("string"), F.lit("-"), (a + F.col("doc_id") % 7).cast("string"), F.lit("]"))
    return F.concat("text", one, one)


@query("SELECT doc_id, 'src/' || doc_id || '.py' AS file_path, CAST(1 + doc_id % 50 AS INTEGER) AS start_line, CAST(1 + doc_id % 50 + doc_id % 7 AS INTEGER) AS end_line FROM documents")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.citations(_answers())).alias("c"))
    return rows.select("doc_id", "c.file_path", "c.start_line", "c.end_line")


@query("SELECT doc_id, doc_id % 9 = 0 AS not_found FROM documents")
def not_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 9 == 0, F.lit(prompts.NOT_FOUND)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.is_not_found(answer).alias("not_found"))


# ---------------------------------------------------------------- chat

_TURNS_SQL = """m AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn, text AS query, t2 AS response FROM m WHERE role = 'user' AND r2 = 'assistant')"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.turns_of(table(spark, sf_dir, "conversations"))


@query(
    f"""WITH {_TURNS_SQL} SELECT conv_id, 'Conversation History:' || chr(10) || string_agg('User (Turn ' || turn || '): ' || query || chr(10) || 'Assistant (Turn ' || turn || '): ' || response, chr(10) ORDER BY turn)
    || chr(10) || chr(10) AS history FROM t GROUP BY conv_id"""
)
def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(_turns(spark, sf_dir), "conv_id").select("conv_id", prompts.history_text(F.col("turns")).alias("history"))


@query(
    f"""WITH {_TURNS_SQL}, n AS (SELECT conv_id, 'again' AS query, 'of course' AS response FROM conversations GROUP BY conv_id)
    SELECT conv_id, turn, query, response FROM t UNION ALL SELECT n.conv_id, CAST(coalesce(l.last, 0) + 1 AS INTEGER), n.query, n.response FROM n LEFT JOIN (SELECT conv_id, max(turn) AS last FROM t GROUP BY 1) l USING (conv_id)"""
)
def chat_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    rows = new.select("conv_id", F.lit(1).alias("at"), F.lit("again").alias("query"), F.lit("of course").alias("response"))
    return chat.add_messages(_turns(spark, sf_dir), rows, "conv_id")


@query(f"WITH {_TURNS_SQL} SELECT conv_id, turn, query, response FROM t WHERE conv_id % 5 <> 0")
def chat_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir)
    return chat.clear(turns, turns.where("conv_id % 5 = 0"), "conv_id").select("conv_id", "turn", "query", "response")


@query("SELECT DISTINCT conv_id FROM conversations")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"), "conv_id")


# ---------------------------------------------------------------- collections


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents, and all of them again: those of even id replace theirs, the others are added under new ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"), "text")
    added = F.when(F.col("doc_id") % 2 == 0, F.col("id")).otherwise(F.concat("id", F.lit("+")))
    return docs.select("id", F.col("text").alias("document")), docs.select(added.alias("id"), F.concat(F.lit("new: "), F.col("text")).alias("document"))


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 2 = 0 THEN 'new: ' || text ELSE text END AS document FROM documents
    UNION ALL SELECT doc_id || '+', 'new: ' || text FROM documents WHERE doc_id % 2 <> 0"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(*_versions(spark, sf_dir))


def _stored(spark: SparkSession, sf_dir: str) -> Store:
    """A store with a collection of each source, a record of each document."""
    rows = raw_files(spark, sf_dir)
    chunks = chunking.as_chunks(rows, start_line=F.lit(1), end_line=1 + T.newlines(F.col("content")), chunk_type=F.lit("text_block"), language=F.col("file_type"), seq=F.lit(0))
    store = scratch_store(spark, "catalogue", buckets=1)
    store.write_all(chunks.withColumn("id", F.col("file_path")).withColumn("embedding", F.array().cast(retrieval.EMBEDDING)), F.col("repo_name"))
    return store


@query("SELECT DISTINCT lower(source) AS collection FROM documents")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _stored(spark, sf_dir).list()], "collection string")


@query(f"SELECT {_PATH_SQL} AS file_path, lower(source) AS collection FROM documents WHERE lower(source) <> 'src1'")
def delete_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in a store after one of its collections is deleted, under any spelling of its name."""
    store = _stored(spark, sf_dir)
    store.delete("SRC1")
    left = [store.read(n).select("file_path", F.lit(n).alias("collection")) for n in store.list()]
    return reduce(DataFrame.union, left, spark.createDataFrame([], "file_path string, collection string"))


@query("SELECT c_name AS repo_name, lower(c_name) IN (SELECT lower(source) FROM documents) AS found FROM customer UNION ALL SELECT upper(source), true FROM (SELECT DISTINCT source FROM documents)")
def repo_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's answer for many names at once: a name exists if its normal form is listed."""
    there = spark.createDataFrame([(n, True) for n in _stored(spark, sf_dir).list()], "_c string, _there boolean")
    docs = table(spark, sf_dir, "documents").select("source").distinct()
    asked = table(spark, sf_dir, "customer").select(F.col("c_name").alias("repo_name")).union(docs.select(F.upper("source")))
    joined = asked.join(there, T.collection_name("repo_name") == F.col("_c"), "left")
    return joined.select("repo_name", F.coalesce("_there", F.lit(False)).alias("found"))


# ---------------------------------------------------------------- definitions


_PY = '''import os

@wrap
class Box{n}(object):
    """{t}"""

    def area(self):
        def inner():
            return {n}
        return inner()

    async def load(self):
        return None


def free_{n}(x):
    return x
'''
_JS = "const a = {n};\nfunction run{n}(x) {{\n  return x;\n}}\nclass Box{n} {{\n  size() {{\n    return 1;\n  }}\n}}\nrun{n}(a);\n"


def _code(spark: SparkSession, sf_dir: str, template: str, kind: str) -> DataFrame:
    docs = sources.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    text: Column = F.lit(template.replace("{{", "{").replace("}}", "}"))
    text = F.replace(text, F.lit("{n}"), F.col("doc_id").cast("string"))
    text = F.replace(text, F.lit("{t}"), F.regexp_replace(F.col("text"), r'["\\]', ""))
    path = F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("." + kind))
    return docs.select(F.col("source").alias("repo_name"), path.alias("file_path"), F.lit(kind).alias("file_type"), text.alias("content"))


_DEFINED = ["repo_name", "file_path", "start_line", "end_line", "chunk_type", "language", "name", "parent_name", "content", "nth"]


def _defs_sql(template: str, kind: str, language: str, rows: list[tuple]) -> str:
    """Chunks of every document's file by (first line, last line, type, name, parent); lines after that of {{t}} move by its newlines."""
    lines = template.replace("{{", "{").replace("}}", "}").split("\n")
    mark = next((i for i, x in enumerate(lines, 1) if "{t}" in x), len(lines))
    line = lambda n, moved: f"CAST({n}{' + k' if moved else ''} AS INTEGER)"
    fill = lambda x: "NULL" if x is None else f"replace(replace({_sql_text(x.replace(chr(39), chr(39) * 2))}, '{{n}}', doc_id::VARCHAR), '{{t}}', t)"
    parts = []
    for nth, (first, last, chunk_type, name, parent) in enumerate(rows, 1):
        body = "\n".join(lines[first - 1 : last])
        body = body.strip() if language == "python" or chunk_type == "top_level_code" else body
        parts.append(
            f"""SELECT source AS repo_name, 'src/' || doc_id || '.{kind}' AS file_path, {line(first, first > mark)} AS start_line, {line(last, last >= mark)} AS end_line,
            '{chunk_type}' AS chunk_type, '{language}' AS language, {fill(name)} AS name, {fill(parent)} AS parent_name, {fill(body)} AS content, {nth} AS nth FROM d"""
        )
    texts = """d AS (SELECT *, length(t) - length(replace(t, chr(10), '')) AS k FROM (SELECT doc_id, source, regexp_replace(text, '["\\\\]', '', 'g') AS t FROM documents))"""
    return f"WITH {texts} " + " UNION ALL ".join(parts)


def _defined(chunks: DataFrame) -> DataFrame:
    """Chunks with their place among those of their file."""
    return chunks.withColumn("nth", F.row_number().over(Window.partitionBy("repo_name", "file_path").orderBy("seq"))).select(*_DEFINED)


@query(
    _defs_sql(_PY, "py", "python", [
        (3, 13, "class", "Box{n}", None), (7, 10, "method", "area", "Box{n}"), (8, 9, "method", "inner", "Box{n}"), (12, 13, "async_method", "load", "Box{n}"),
        (16, 17, "function", "free_{n}", None), (1, 1, "top_level_code", None, None),
    ])
)
def python_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defined(chunking.python_chunks(chunking.dispatch(_code(spark, sf_dir, _PY, "py"))))


@query(
    _defs_sql(_JS, "js", "javascript", [
        (1, 1, "top_level_code", None, None), (2, 4, "function", "run{n}", None), (5, 9, "class", "Box{n}", None), (6, 8, "method", "size", "Box{n}"), (10, 10, "top_level_code", None, None),
    ])
)
def code_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _defined(chunking.code_chunks(chunking.dispatch(_code(spark, sf_dir, _JS, "js"))))


_TREE = "x = {n}\n\ndef f{n}(a):\n    return a\n"
_BROKEN = "def broken{n}(:\n    pass\n"
_NODES = [(0, "Module", 1), (1, "Assign", 1), (2, "Name", 1), (3, "Store", 1), (2, "Constant", 1), (1, "FunctionDef", 3), (2, "arguments", 1), (3, "arg", 3), (2, "Return", 4), (3, "Name", 4), (4, "Load", 1)]


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each document; every third does not parse."""
    whole, broken = (_code(spark, sf_dir, x, "py") for x in (_TREE, _BROKEN))
    third = F.regexp_extract("file_path", r"(\d+)\.py", 1).cast("long") % 3 == 0
    return chunking.dispatch(whole.where(~third).union(broken.where(third)))


@query("SELECT 'src/' || doc_id || '.py' AS file_path, unnest(CASE WHEN doc_id % 3 = 0 THEN ['text_block', 'parse_error'] ELSE ['function', 'top_level_code'] END) AS chunk_type, doc_id % 3 = 0 AS failed FROM documents")
def chunks_and_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and the errors of files that did not parse, from one pass over the files."""
    rows = chunking.chunk_files(_python_files(spark, sf_dir), errors=True)
    failed = F.max((F.col("chunk_type") == chunking.PARSE_ERROR) & F.startswith("content", F.lit("SyntaxError"))).over(Window.partitionBy("file_path"))
    return rows.select("file_path", "chunk_type", failed.alias("failed"))


@query(
    "WITH t AS (SELECT * FROM (VALUES " + ", ".join(f"({n}, {d}, '{k}', {line})" for n, (d, k, line) in enumerate(_NODES)) + """) v(n, depth, kind, ln))
    SELECT 'src/' || doc_id || '.py' AS file_path, CAST(n AS INTEGER) AS n, CAST(depth AS INTEGER) AS depth, kind, CASE ln WHEN 1 THEN 'x = ' || doc_id WHEN 3 THEN 'def f' || doc_id || '(a):' ELSE 'return a' END AS line
    FROM documents, t WHERE doc_id % 3 <> 0 UNION ALL SELECT 'src/' || doc_id || '.py', 0, 0, 'ERROR', 'SyntaxError' FROM documents WHERE doc_id % 3 = 0"""
)
def syntax_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The syntax trees of Python files as rows; a file that does not parse is a row of kind ERROR."""
    rows = chunking.syntax_trees(_python_files(spark, sf_dir))
    return rows.select("file_path", "n", "depth", "kind", F.when(F.col("kind") == "ERROR", F.substring_index("line", ":", 1)).otherwise(F.col("line")).alias("line"))


@query()
def chunk_all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(raw_files(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer with its citations: chunk, embed, search, assemble, answer, cite."""
    chunks = with_ids(chunking.chunk_files(raw_files(spark, sf_dir)))
    model = retrieval.HashedEmbedder()
    asked = spark.createDataFrame([(0, "What do the documents say?")], "query_no long, text string")
    best = retrieval.sparse_top_k(model.add(chunks, "content"), "id", model.add(asked, "text"), "query_no", 3, carry=CHUNK_COLUMNS)
    hits = retrieval.first_wins(best)
    answer = safe_answer(ExtractiveGenerator(), prompts.rag_prompt(hits, "What do the documents say?").collect()[0]["prompt"])
    return spark.range(1).select(F.lit("What do the documents say?").alias("query"), F.lit(answer).alias("answer"), T.citations(F.lit(answer)).alias("sources"))


@query()
def answer_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
