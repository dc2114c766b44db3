"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm import decontam, divergence, langid, linededup, minhash, mixing, secrets, stamps, tokencount, topk, toxicity, warc, wavelet

END_ID = 2


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.deduplicated(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", "removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_domains(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(_table(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.tokens(_table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stamps.normalised(_table(spark, sf_dir, "stamps"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_warc, op3_decontamination, op4_line_dedup, op5_mixing,
        op6_top_k, op7_language_id, op8_token_ids, op9_minhash_near_dedup, op10_secrets,
        op11_timestamps, op12_divergence, op13_token_counts,
    )
}



def _wall_sql(wall: str, name: str) -> str:
    """Columns `<name>_utc` and `<name>_unclear` of a wall time in seconds: the offsets a day before and a day after say what it is."""
    offset = lambda at: f"(epoch_us(timezone(zone, make_timestamptz(({at}) * 1000000))) // 1000000 - ({at}))"
    before, after = offset(f"{wall} - 86400"), offset(f"{wall} + 86400")
    fits = lambda o: f"{offset(f'{wall} - {o}')} = {o}"
    first, then = fits(before), fits(after)
    utc = f"CASE WHEN fixed THEN {wall} - off WHEN {first} THEN {wall} - {before} WHEN {then} THEN {wall} - {after} ELSE {wall} - {before} END"
    unclear = f"NOT fixed AND {before} <> {after} AND (({first}) = ({then}))"
    return f"{utc} AS {name}_utc, {unclear} AS {name}_unclear"


_STAMP = (
    "^(?:(20[0-9][0-9])-([0-9][0-9])-([0-9][0-9])|(20[0-9][0-9])([0-9][0-9])([0-9][0-9])|([0-9][0-9])[.]([0-9][0-9])[.](20[0-9][0-9])"
    "|([0-9][0-9]) (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (20[0-9][0-9])|([0-9][0-9])/([0-9][0-9])/(20[0-9][0-9]))"
    "(?:[T ]([0-9][0-9]):([0-9][0-9])(?::([0-9][0-9]))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9][0-9]:?[0-9][0-9]))?)?$"
)
_STAMP_GROUPS = "['y1','m1','d1','y2','m2','d2','d3','m3','y3','d4','m4','y4','s1','s2','y5','h','mi','se','ap','z']"
_NUMBER = lambda x: f"TRY_CAST({x} AS BIGINT)"
_ONE_OF = lambda *x: "coalesce(" + ", ".join(f"nullif(r.{n}, '')" for n in x) + ")"
_MONTH = "CASE WHEN r.m4 <> '' THEN lpad(((strpos('JanFebMarAprMayJunJulAugSepOctNovDec', r.m4) + 2) // 3)::VARCHAR, 2, '0') END"
_STAMPS_SQL = f"""
    WITH a AS (SELECT stamp_id, source, zone, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
    b AS (SELECT *, regexp_full_match(t, '[0-9]{{10}}') AS e10, regexp_full_match(t, '[0-9]{{13}}') AS e13, regexp_extract(t, '{_STAMP}', {_STAMP_GROUPS}) AS r FROM a),
    c AS (SELECT *, {_ONE_OF('y1', 'y2', 'y3', 'y4', 'y5')} AS y, coalesce({_ONE_OF('m1', 'm2', 'm3')}, {_MONTH}) AS m, {_ONE_OF('d1', 'd2', 'd3', 'd4')} AS d, r.s1 <> '' AS slashed,
        {_NUMBER('r.h')} AS h, {_NUMBER('r.mi')} AS mi, coalesce({_NUMBER("nullif(r.se, '')")}, 0) AS se, replace(r.z, ':', '') AS z FROM b),
    e AS (SELECT *, CASE WHEN slashed THEN TRY_CAST(y || '-' || r.s2 || '-' || r.s1 AS DATE) ELSE TRY_CAST(y || '-' || m || '-' || d AS DATE) END AS day_first,
        CASE WHEN slashed THEN TRY_CAST(y || '-' || r.s1 || '-' || r.s2 AS DATE) END AS month_first, z <> '' AS fixed,
        CASE WHEN length(z) > 1 THEN (CASE z[1] WHEN '-' THEN -1 ELSE 1 END) * ({_NUMBER('z[2:3]')} * 3600 + {_NUMBER('z[4:5]')} * 60) ELSE 0 END AS off,
        h IS NULL OR (mi < 60 AND se < 60 AND CASE WHEN r.ap = '' THEN h < 24 ELSE h BETWEEN 1 AND 12 END AND (length(z) <= 1 OR ({_NUMBER('z[2:3]')} <= 14 AND {_NUMBER('z[4:5]')} < 60))) AS right_time,
        coalesce((CASE WHEN r.ap = '' THEN h ELSE h % 12 + CASE r.ap WHEN 'P' THEN 12 ELSE 0 END END) * 3600 + mi * 60 + se, 0) AS sec FROM c),
    f AS (SELECT *, epoch(day_first)::BIGINT + sec AS dw, epoch(month_first)::BIGINT + sec AS mw, right_time AND day_first IS NOT NULL AS d_ok, right_time AND month_first IS NOT NULL AS m_ok FROM e),
    g AS (SELECT *, {_wall_sql('dw', 'd')}, {_wall_sql('mw', 'm')} FROM f),
    v AS (SELECT *, count(*) FILTER (slashed AND d_ok AND NOT m_ok) OVER (PARTITION BY source) AS dv, count(*) FILTER (slashed AND m_ok AND NOT d_ok) OVER (PARTITION BY source) AS mv,
        coalesce(d_ok AND m_ok AND day_first <> month_first, false) AS open FROM g)
    SELECT stamp_id, CASE WHEN e10 THEN {_NUMBER('t')} * 1000000 WHEN e13 THEN {_NUMBER('t')} * 1000 WHEN open THEN (CASE WHEN dv > mv THEN d_utc ELSE m_utc END) * 1000000
            WHEN d_ok THEN d_utc * 1000000 WHEN m_ok THEN m_utc * 1000000 END AS utc_us,
        CASE WHEN e10 OR e13 THEN 'epoch' WHEN open THEN CASE WHEN dv <> mv THEN 'votes' ELSE 'default' END WHEN d_ok OR m_ok THEN 'plain' ELSE 'bad' END AS rule,
        coalesce(NOT (e10 OR e13) AND (open OR (CASE WHEN d_ok THEN d_unclear WHEN m_ok THEN m_unclear END)), false) AS ambiguous FROM v
"""
_P = lambda n, total: f"(1 + ({divergence.SCALE}::HUGEINT * ({n} + {divergence.SMOOTHING})) // ({total} + {divergence.SMOOTHING} * v))::BIGINT"
_DIVERGENCE_SQL = rf"""
    WITH a AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, '{divergence.UPPER}', '{divergence.LOWER}'), '{divergence.TERM}')) AS term FROM a),
    kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= {divergence.LEAST_DOCUMENTS}),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM kept GROUP BY lang),
    g AS (SELECT lang, source, coalesce((SELECT sum(n)::BIGINT FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM a) x),
    d AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, {_P('coalesce(c.n, 0)', 'g.total')} AS p, {_P('kept.n', 'l.total')} AS q
        FROM g JOIN l USING (lang) JOIN kept USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
    pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value FROM d x JOIN d y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    every AS (SELECT x.lang, x.source, y.source AS item FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source),
    u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM every LEFT JOIN pairs USING (lang, source, item)
        UNION ALL SELECT lang, source, 'term', term, p - q FROM d WHERE n > 0 AND p > q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank" FROM u)
    SELECT lang, source, part, item, value, "rank" FROM r WHERE part = 'pair' OR "rank" <= {divergence.TERMS}
"""

ORACLES: dict[str, str] = {
    "op11_timestamps": _STAMPS_SQL,
    "op12_divergence": _DIVERGENCE_SQL,
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS "rank", vec_id, score FROM r WHERE n <= 20
    """,
}
