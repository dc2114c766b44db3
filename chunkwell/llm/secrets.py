"""Secrets in texts: fixed patterns, and a battery of randomness tests; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three kinds (assign, access, hex) that are
long enough.  Elsewhere, every run of RUN or more characters of the base64 alphabets, padding aside, that has a
letter is a candidate.  Its encoding is inferred (hex 16, base32 32 or base64 64 letters; 26 or 52 of
the last two without digits and signs), and it is tested five times for being random in that alphabet: chi-squared tests of uniform letters, one of all
letters and two of merged ones, a runs test of letters of the lower and upper half, and a test of
serial correlation of letter numbers.  The merged letters are either case and digits with signs, and
the same with vowels and consonants apart, so that short runs have enough of each: by chance a key of 16 letters has no capital and no
digit once in a million, and 40 % of a word's letters are vowels but 19 % of a key's.  That is the
evidence against prose, which the other tests hardly see in short runs.
The least p-value times five (Bonferroni, so for any dependence) goes through the
Benjamini-Hochberg step-up rule at level FDR within the family of candidates of the same encoding and
length class (RUN to 1.5 RUN letters, to 2 RUN, to 3 RUN and so on): short runs, on which the tests have
less power, and long ones do not set each other's limit.  What the rule rejects is not random; what it
leaves is a span of kind random.  A family's limit is never above FDR, so a random key is lost
with a chance of about that at most, whatever the other documents hold.

Defined results: null or empty text has no span and the digest of no spans; each input row gives a
row, repeated rows too; rows that share a doc_id are scanned each on its own; columns other than
doc_id and text are ignored; runs of equal p-value share their fate.  A very long text is scanned
whole, in time linear in its length but for the order of its spans and a binary search for each run; its
matches are placed in runs of FOLD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkwell.llm._shared import materialise

KINDS = ("assign", "access", "hex", "random")
#: Fixed patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # a run is maximal, so shorter ones can go at once
RUN = 16
RUNS = r"[A-Za-z0-9+/_=-]{16,}"
FDR = 0.01
#: Matches of one text that are placed by one fold, so that its growing array stays short.
FOLD = 512
#: Steps of a binary search: a text of less than 2 GB has fewer than 2 ** STEPS matches of 14 characters or more.
STEPS = 28
#: Fixed alphabets.
ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def _matches(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """The other columns, and by name the matches (s, e in code points, hit) of each pattern, from the lengths of the parts between.

    Each step is a projection of its own, so that no step computes again what the one before made.
    """
    rest = [c for c in rows.columns if c != text]
    each = {n: (F.col(text).rlike(p), F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.split(text, p, -1)) for n, p in patterns.items()}
    rows = rows.select(*rest, *[F.when(c, f).alias(f"{n}_hits") for n, (c, f, _) in each.items()], *[F.when(c, f).alias(f"{n}_gaps") for n, (c, _, f) in each.items()])
    empty = F.array().cast("array<struct<s: int, e: int, hit: string>>")

    def step(done: Column, x: Column) -> Column:
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["e"], F.lit(0)) + x["gap"]
        return F.concat(done, F.array(F.struct(at.alias("s"), (at + F.length(x["hit"])).alias("e"), x["hit"].alias("hit"))))

    def placed(n: str) -> Column:
        """Runs of FOLD matches, each placed from where the run before ends."""
        both = lambda a: F.zip_with(
            F.slice(f"{n}_gaps", a, F.least(F.lit(FOLD), F.size(f"{n}_hits") - a + 1)), F.slice(f"{n}_hits", a, F.lit(FOLD)),
            lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")),
        )
        starts = F.sequence(F.lit(1), F.size(f"{n}_hits"), F.lit(FOLD))
        return F.when(F.col(f"{n}_hits").isNotNull(), F.transform(starts, lambda a: F.aggregate(both(a), empty, step)))

    rows = rows.select(*rest, *[placed(n).alias(n) for n in patterns])

    def moved(n: str) -> Column:
        ends = F.aggregate(n, F.array(F.lit(0)), lambda done, part: F.concat(done, F.array(F.element_at(done, -1) + F.element_at(part, -1)["e"])))
        by = lambda x, at: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), x["hit"].alias("hit"))
        several = F.flatten(F.zip_with(n, F.slice(ends, F.lit(1), F.size(n)), lambda part, at: F.transform(part, lambda x: by(x, at))))
        return F.when(F.size(n) > 1, several).when(F.size(n) == 1, F.element_at(n, 1)).otherwise(empty)

    return rows.select(*rest, *[moved(n).alias(n) for n in patterns])


def _kind(found: Column | str, order: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e")))


def kept(assign: str, access: str) -> tuple[Column, Column]:
    """The matches of the first two kinds that are long enough; hex runs always are."""
    long_value = rf"\A{ASSIGN}\z"
    return (
        F.filter(assign, lambda x: F.length(F.regexp_extract(x["hit"], long_value, 2)) >= 8),
        F.filter(access, lambda x: F.length(x["hit"]) >= 16),
    )


def base_spans(assign: str, access: str, hexadecimal: str) -> Column:
    """Spans (s, k, e) of the base kinds, by start, then kind as listed, from the matches that are kept."""
    return F.array_sort(F.concat(_kind(assign, 0), _kind(access, 1), _kind(hexadecimal, 2)))


def _meets(spans: str, x: Column) -> Column:
    """Whether a span overlaps one of others, which are in order and apart: by binary search for the last that starts before its end."""
    steps = F.array(*[F.lit(1 << b) for b in range(STEPS - 1, -1, -1)])
    before = F.aggregate(steps, F.lit(0), lambda at, by: F.when(F.get(F.col(spans), at + by - 1)["s"] < x["e"], at + by).otherwise(at))
    return (F.size(spans) > 0) & F.coalesce(F.get(F.col(spans), before - 1)["e"] > x["s"], F.lit(False))


#: Of the complementary error function by Chebyshev fitting (Numerical Recipes), highest power first.
_ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def _upper(z: Column) -> Column:
    """The upper tail of the normal distribution, within 1.2e-7 of itself far out too."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + 0.5 * x)
    power = F.lit(_ERFC[0])
    for c in _ERFC[1:]:
        power = power * t + c
    half = 0.5 * t * F.exp(power - x * x)
    return F.when(z >= 0, half).otherwise(1 - half)


def battery(token: Column) -> Column:
    """The size k of the inferred alphabet of a run of letters, and the numbers v of its letters; `=` before the end is -1."""
    bare = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    k = (
        F.when(bare.rlike(r"\A([0-9a-f]+|[0-9A-F]+)\z"), 16)
        .when(bare.rlike(r"\A[A-Z2-7]+\z"), 32)
        .otherwise(64)
    )
    bare = F.when(k == 16, F.lower(bare)).otherwise(bare)
    alphabet = F.when(k == 16, F.lit(ALPHABETS[16])).when(k == 32, F.lit(ALPHABETS[32])).otherwise(F.lit(ALPHABETS[64]))
    letters = F.split(bare, "")
    numbers = F.transform(F.filter(letters, lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))
    return F.struct(k.alias("k"), numbers.alias("v"))


#: Merged letters (vowels and consonants of either case, digits with signs) and how many letters of an alphabet each has:
#: of all letters, and of those of runs without a digit or sign.
VOWELS = (0, 4, 8, 14, 20)
MERGED = {16: ((0, 6, 0, 0, 10),) * 2, 32: ((5, 21, 0, 0, 6), (5, 21, 0, 0, 0)), 64: ((5, 21, 5, 21, 12), (5, 21, 5, 21, 0))}


def _merged(k: Column, v: Column, n: Column) -> list[Column]:
    """The normal deviates of the chi-squared tests of merged letters, without and with vowels apart, from an alphabet size and letter numbers."""
    vowel, letters = (lambda y: (y % 26).isin(*VOWELS)), F.when(k == 16, F.lit(10)).when(k == 32, F.lit(26)).otherwise(F.lit(52))
    count = lambda f: F.size(F.filter(v, f)).cast("double")
    rest = count(lambda y: F.when(k == 16, y < 10).otherwise((y < 0) | (y >= letters)))
    low = lambda y: (k == 64) & (y >= 26) & (y < 52)
    high = lambda y: F.when(k == 16, y >= 10).otherwise((y >= 0) & (y < 26))
    seen = F.array(
        count(lambda y: high(y) & vowel(y) & (k != 16)), count(lambda y: high(y) & (~vowel(y) | (k == 16))),
        count(lambda y: low(y) & vowel(y)), count(lambda y: low(y) & ~vowel(y)), rest,
    )
    shares = lambda a: F.array(*(F.lit(x / sum(a)) for x in a))
    share = F.lit(None)
    for size, (whole, bare) in MERGED.items():
        share = F.when(k == size, F.when(rest > 0, shares(whole)).otherwise(shares(bare))).otherwise(share)
    by_case = lambda x: F.array(F.get(x, F.lit(0)) + F.get(x, F.lit(1)), F.get(x, F.lit(2)) + F.get(x, F.lit(3)), F.get(x, F.lit(4)))

    def deviate(seen: Column, share: Column) -> Column:
        apart = F.zip_with(seen, share, lambda o, q: F.when(q > 0, F.pow(o - n * q, F.lit(2.0)) / (n * q)).otherwise(0.0))
        chi, df = F.aggregate(apart, F.lit(0.0), lambda a, y: a + y), (F.size(F.filter(share, lambda q: q > 0)) - 1).cast("double")
        found = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        return F.when(df > 0, found).otherwise(-30.0)  # letters of one kind only tell nothing

    return [deviate(by_case(seen), by_case(share)), deviate(seen, share)]


def _tests(x: Column) -> Column:
    """The family of a candidate, and its combined p-value, from an alphabet size and letter numbers."""
    size, v = x["k"], x["v"]
    letters = F.when(size == 64, F.lit(52)).when(size == 32, F.lit(26))  # runs of letters only are of a smaller alphabet
    k = F.when(letters.isNotNull() & (F.size(F.filter(v, lambda y: (y < 0) | (y >= letters))) == 0), letters).otherwise(size).cast("double")
    n = F.greatest(F.size(v).cast("double"), F.lit(2.0))
    add = lambda f: F.aggregate(v, F.lit(0.0), f)
    squares = F.aggregate(F.array_distinct(v), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(v, lambda y: y == c)).cast("double"), F.lit(2.0)))
    chi, df = k * squares / n - n, k - 1
    cube = (F.pow(F.greatest(chi, F.lit(1e-9)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = F.transform(v, lambda y: (y >= k / 2).cast("int"))
    ones = F.aggregate(high, F.lit(0), lambda a, y: a + y).cast("double")
    pairs = F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high)), lambda a, b: (a != b).cast("int"))
    runs = F.aggregate(pairs, F.lit(1), lambda a, y: a + y).cast("double")
    mean_runs = 1 + 2 * ones * (n - ones) / n
    sd_runs = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9)))
    z_runs = F.when((ones == 0) | (ones == n), F.lit(8.0)).otherwise(F.abs(runs - mean_runs) / sd_runs)
    mean = add(lambda a, y: a + y) / n
    spread = add(lambda a, y: a + (y - mean) * (y - mean))
    lagged = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda a, b: (a - mean) * (b - mean))
    serial = F.aggregate(lagged, F.lit(0.0), lambda a, y: a + y) / F.greatest(spread, F.lit(1e-9))
    z_serial = F.abs((serial + 1 / n) * F.sqrt(n))
    tests = F.array(cube, *_merged(size, v, n), z_runs, z_serial)
    p = F.transform(tests, lambda z, i: F.when(i < 3, 1.0).otherwise(2.0) * _upper(F.least(z, F.lit(30.0))))
    octave = F.floor(F.log2(n / RUN)).cast("int")
    half = (n >= 1.5 * RUN * F.pow(F.lit(2.0), octave)).cast("int")
    family = size * 128 + F.greatest(2 * octave + half, F.lit(0))
    return F.struct(family.alias("family"), F.least(5 * F.array_min(p), F.lit(1.0)).alias("p"))


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, base spans, and candidates (s, e, p with family and p) that overlap none of them."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = _matches(rows, "text", {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "runs": RUNS})
    assign, access = kept("assign", "access")
    rows = found.select("doc_id", assign.alias("assign"), access.alias("access"), "hex", "runs")
    rows = rows.select("*", base_spans("assign", "access", "hex").alias("base"))
    fit = lambda x: (F.length(F.rtrim(x["hit"], F.lit("="))) >= RUN) & x["hit"].rlike("[A-Za-z]")
    free = F.filter("runs", lambda x: fit(x) & ~_meets("assign", x) & ~_meets("access", x) & ~_meets("hex", x))
    rows = rows.select("doc_id", "base", free.alias("runs"))
    values = F.transform("runs", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), battery(x["hit"]).alias("b")))
    tested = F.transform(values, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), _tests(x["b"]).alias("p")))
    return rows.select("doc_id", "base", tested.alias("runs"))


def rejection_limits(p_values: DataFrame) -> dict[int, float]:
    """The limit of the step-up rule for each `family` of p-values `p`: what is no greater is rejected.

    The p-value of rank r is rejected if it is at most FDR * r / total.  From FDR on, counting
    the p-values within a limit lowers it to FDR * count / total, until the count stays: no p-value
    is rounded, and no task orders them.
    """
    limits: dict[int, float] = {}
    counts: dict[int, int] = {}
    while True:
        within = F.col("p") <= limit_of(F.col("family"), limits)
        rows = p_values.groupBy("family").agg(F.count("*").alias("n"), F.count(F.when(within, 1)).alias("low")).collect()
        limits = {r["family"]: FDR * r["low"] / r["n"] for r in rows}
        if counts == (counts := {r["family"]: r["low"] for r in rows}):
            return limits


def limit_of(family: Column, limits: dict[int, float]) -> Column:
    return F.coalesce(*(F.when(family == k, limit) for k, limit in sorted(limits.items())), F.lit(FDR))


def find_secrets(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    scanned = materialise(scan(documents), "secrets")
    limits = rejection_limits(scanned.select(F.explode("runs").alias("r")).select("r.p.family", "r.p.p"))
    chosen = F.filter("runs", lambda x: x["p"]["p"] > limit_of(x["p"]["family"], limits))
    every = F.array_sort(F.concat("base", _kind(chosen, 3)))

    def text(spans: Column | str) -> Column:
        names = F.array(*map(F.lit, KINDS))
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")

    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.size(chosen).cast("long").alias("n_random"), F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text(every).alias("spans"),
    )
