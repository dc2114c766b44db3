"""Audit of how sources of one language differ, by DuckDB over shards.

1. Tasks run DuckDB over batches of documents: terms are cut, and occurrences and documents counted by
   (lang, source, term) before anything is shuffled.
2. Counts are dealt to shards by hash of (lang, term), so that a term of a language lies in one shard
   whatever its sources.  In each, DuckDB sums counts as they come, and keeps the terms of enough
   documents; Spark sums the totals of kept terms by source and by language.
3. The totals of all sources are dealt to every shard of kept terms.  In each, DuckDB works out the
   probabilities, partial sums of their differences for each pair of sources of a language, and the
   shard's first terms of each source.  Spark adds up the sums and ranks.

All arithmetic is in integers: 128-bit products, 64-bit sums.

Defined results: null text, lang or source is empty; each row is a document, repeated rows too; a
language without kept terms has pairs of value 0; a source alone in its language has no pair; other
columns are ignored; a very long text is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkwell.llm._shared import bound_batches, discard, materialise, release_memory

LEAST_DOCUMENTS, SMOOTHING, SCALE, TERMS = 30, 5, 1_000_000_000, 50
#: Fixed pattern of terms, and the letters that are lower-cased.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Counts that a task or a shard gathers before it sums or sends them on, and counts a shard has on average.
GATHERED, SHARD_ROWS = 1 << 19, 1 << 20
#: MB a DuckDB connection may take; what it can't hold fails instead of going to a local disk.
MEMORY_MB = 600
COUNTS = "lang string, source string, term string, n long, docs long"
KEPT = "lang string, source string, term string, n long"

_BATCH = f"""
    WITH w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM batch),
    d AS (SELECT row, any_value(lang) AS lang, any_value(source) AS source, term, count(*) AS n FROM w GROUP BY row, term)
    SELECT lang, source, term, count(*) AS docs, sum(n)::BIGINT AS n FROM d GROUP BY lang, source, term"""
_SUM = "SELECT lang, source, term, sum(docs)::BIGINT AS docs, sum(n)::BIGINT AS n FROM counts GROUP BY lang, source, term"


def _connection():  # noqa: ANN202
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": False})


def _batches(table: pa.Table, schema: str) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {x.split()[0]: pa.string() if x.split()[1] == "string" else pa.int64() for x in schema.split(", ")}
    fields = pa.schema([(n, kinds[n]) for n in names])
    yield from table.select(names).cast(fields).to_batches(max_chunksize=1 << 16)


class _Summed:
    """Counts that come in tables, summed whenever as many have come as were left the last time."""

    def __init__(self) -> None:
        self.db = _connection()
        self.db.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, docs BIGINT, n BIGINT)")
        self.rows = self.left = 0

    def add(self, counts: pa.Table) -> None:
        self.db.register("more", counts)
        self.db.execute("INSERT INTO counts SELECT lang, source, term, docs, n FROM more")
        self.db.unregister("more")
        self.rows += counts.num_rows
        if self.rows > 2 * max(self.left, GATHERED // 4):
            self.sum()

    def sum(self) -> None:
        self.db.execute(f"CREATE TABLE summed AS {_SUM}")
        self.db.execute("DROP TABLE counts")
        self.db.execute("ALTER TABLE summed RENAME TO counts")
        self.rows = self.left = self.db.sql("SELECT count(*) FROM counts").fetchall()[0][0]

    def take(self) -> pa.Table:
        """All that has come, summed; nothing is left."""
        out = self.db.sql(_SUM).to_arrow_table()
        self.db.execute("DELETE FROM counts")
        self.rows = self.left = 0
        return out


def term_counts(documents: DataFrame) -> DataFrame:
    """Occurrences and documents by lang, source and term, of parts of the documents; sums over all parts are whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one = _Summed(), _connection()
        for batch in batches:
            rows = pa.Table.from_batches([batch]).append_column("row", pa.array(range(batch.num_rows), pa.int64()))
            one.register("batch", rows)
            held.add(one.sql(_BATCH).to_arrow_table())
            one.unregister("batch")
            if held.rows > GATHERED:
                yield from _batches(held.take(), COUNTS)
        yield from _batches(held.take(), COUNTS)
        release_memory()

    return documents.mapInArrow(count, COUNTS)


def kept_terms(counts: DataFrame, shards: int, least: int) -> DataFrame:
    """Occurrences of the terms that at least `least` documents of their language have; a partition is a shard."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Summed()
        for batch in batches:
            held.add(pa.Table.from_batches([batch]))
        held.sum()
        sql = f"SELECT lang, source, term, n FROM counts QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}"
        yield from _batches(held.db.sql(sql).to_arrow_table(), KEPT)
        release_memory()

    return counts.repartition(shards, "lang", "term").mapInArrow(keep, KEPT)


#: Terms by sources of a shard that are worked on at a time.
PORTION = 1 << 20
_NUMBERED = (
    "CREATE TABLE s AS SELECT *, row_number() OVER () AS no FROM g",
    "CREATE TABLE all_terms AS SELECT lang, term, sum(n)::BIGINT AS n, row_number() OVER () AS t FROM k GROUP BY lang, term",
)
#: Of a portion of a shard's terms, their occurrences `k` (lang, source, term, n) and the totals `s` of all sources (lang,
#: source, total, terms, lang_total): probabilities of every term for every source and for the language.
_PROBABILITIES = f"""
    WITH t AS (SELECT * FROM all_terms WHERE t > {{start}} AND t <= {{stop}}),
    d AS (
        SELECT t.lang, t.t, t.term, s.no, s.source, coalesce(k.n, 0) AS n,
            (1 + ({SCALE}::HUGEINT * (coalesce(k.n, 0) + {SMOOTHING})) // (s.total + {SMOOTHING} * s.terms))::BIGINT AS p,
            (1 + ({SCALE}::HUGEINT * (t.n + {SMOOTHING})) // (s.lang_total + {SMOOTHING} * s.terms))::BIGINT AS q
        FROM t JOIN s ON s.lang = t.lang LEFT JOIN k ON k.lang = t.lang AND k.source = s.source AND k.term = t.term)"""
_PAIRS = f"""{_PROBABILITIES},
    f AS (SELECT a.no AS a, b.no AS b, sum(abs(a.p - b.p))::BIGINT AS f FROM d a JOIN d b ON a.t = b.t AND a.no < b.no GROUP BY a.no, b.no)
    SELECT x.lang, least(x.source, y.source) AS source, 'pair' AS part, greatest(x.source, y.source) AS item, f.f AS value FROM f JOIN s x ON x.no = f.a JOIN s y ON y.no = f.b"""
_TERMS = f"""{_PROBABILITIES}
    SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM d WHERE n > 0 AND p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) <= {{terms}}"""
_PART = "lang string, source string, part string, item string, value long"


def _shard_of(shards: int) -> Column:
    return F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int")


def divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of documents (text, lang, source)."""
    bound_batches(documents.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = documents.select(empty("text"), empty("lang"), empty("source"))
    counts = materialise(term_counts(rows), "term-counts")
    shards = max(1, -(-counts.count() // SHARD_ROWS))
    kept = materialise(kept_terms(counts, max(shards, 8), least), "kept-terms")
    discard(counts)
    groups = rows.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    lang_sums = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    totals = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").join(lang_sums, "lang", "left")
    totals = materialise(totals.select("lang", "source", zero("total"), zero("terms"), zero("lang_total")), "totals")

    def audit(own: pa.Table, all_groups: pa.Table) -> pa.Table:
        db = _connection()
        db.register("k", own)
        db.register("g", all_groups)
        for sql in _NUMBERED:
            db.execute(sql)
        last = db.sql("SELECT count(*) FROM all_terms").fetchall()[0][0]
        step = max(1, PORTION // max(1, all_groups.num_rows))
        parts = [
            db.sql(sql.format(start=start, stop=start + step, terms=terms)).to_arrow_table()
            for start in range(0, max(last, 1), step) for sql in (_PAIRS, _TERMS)
        ]
        fields = pa.schema([(x.split()[0], pa.string() if x.split()[1] == "string" else pa.int64()) for x in _PART.split(", ")])
        out = pa.concat_tables([p.cast(fields) for p in parts])
        del db
        release_memory()
        return out

    shard = kept.withColumn("shard", _shard_of(shards))
    everywhere = totals.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))  # a row a source and shard
    found = materialise(shard.groupBy("shard").cogroup(everywhere.groupBy("shard")).applyInArrow(audit, _PART), "partial")
    # sources of one language: every pair is there, with 0 where no shard has terms
    pairs = totals.select("lang", "source").join(totals.select("lang", F.col("source").alias("item")), "lang").where("source < item")
    none = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    summed = found.where("part = 'pair'").unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x")
    mirrored = summed.select("lang", both, "part", "value").select("lang", "x.source", "part", "x.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")  # a source's pairs, or `terms` rows a shard
    ranked = mirrored.unionByName(found.where("part = 'term'")).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= terms))
