"""Mixed timestamp texts to UTC microseconds, by byte matrices in NumPy.

A batch of stripped texts becomes a matrix of WIDTH bytes a row.  A mask for each layout says which
rows have its digits and letters in place; the date's numbers come from digit columns, days from the
civil-day formula, and the time of day and the offset are read at a cursor that moves on row by row of the
matrix.  Wall times without an offset are placed by `searchsorted` on the arrays of their zone's changes
of offset, which are broadcast: they are built only for names of zones that exist (about 600 at most)
and occur.

Slashed dates may be day first or month first.  Those possible in one order only vote for it in their
source; votes are summed by Spark and joined back to the undecided stamps by source and salt, so that no
source meets in one task and nothing that grows with the input is collected or broadcast.

Defined results: a stamp that is null or not of a layout is bad, and so is one without an offset whose
zone is null or unknown; a null source is a source of its own; repeated rows keep a row each; other
columns are ignored; a very long text is bad, whatever it begins with.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo, available_timezones

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkwell.llm._shared import materialise, string_parts

#: Blanks that are stripped, and the names of months.
BLANKS = " \t\n\v\f\r"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
#: Longest stamp: `dd Mon yyyy hh:mm:ss AM +hh:mm`, 30 bytes; zeros stand behind a text's end.
WIDTH = 40
FIRST_YEAR, LAST_YEAR = 2000, 2099
#: A zone's changes of offset are looked for between instants so far apart.
STEP = timedelta(days=3)
US, DAY = 1_000_000, 86_400
BAD, EPOCH, PLAIN, OPEN = range(4)
#: The winner of a vote has more than so many times the other's votes.
RATIO = 1
SALTS = 1024
PARSED = "stamp_id long, source string, state int, utc_us long, ambiguous boolean, other_us long, vote int"


def zone_changes(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Instants at which a zone's offset from UTC changes, and the offsets before, between and after them, in seconds."""
    zone = ZoneInfo(name)
    offset = lambda t: int(datetime.fromtimestamp(t, UTC).astimezone(zone).utcoffset().total_seconds())
    start = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp()) - 3 * DAY
    stop = int(datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC).timestamp()) + 3 * DAY
    at, offsets, step = [], [offset(start)], int(STEP.total_seconds())
    for a in range(start, stop, step):
        b = a + step
        if offset(b) != offsets[-1]:
            low, high = a, b
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (low, mid) if offset(mid) != offsets[-1] else (mid, high)
            at.append(high)
            offsets.append(offset(high))
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def to_utc(wall: np.ndarray, changes: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Instants of wall seconds, and which of them are skipped or repeated: these take the offset before the change."""
    at, offsets = changes
    before, after = offsets[:-1], offsets[1:]
    opens, closes = at + np.minimum(before, after), at + np.maximum(before, after)
    index = np.searchsorted(closes, wall, side="right")
    unclear = np.searchsorted(opens, wall, side="right") > index
    return wall - offsets[index], unclear


def days_of(year: np.ndarray, month: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since 1970 of civil dates, and whether they exist."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    length = np.where(month == 2, 28 + leap, 30 + ((month + (month > 7)) % 2))
    exists = (month >= 1) & (month <= 12) & (day >= 1) & (day <= length)
    # the year begins in March, so that the leap day is its last
    y, m = year - (month < 3), (month + 9) % 12
    era_day = 365 * y + y // 4 - y // 100 + y // 400 + (153 * m + 2) // 5 + day - 1
    return era_day - 719_468, exists


class Matrix:
    """Byte matrix of texts, with digit arithmetic at fixed columns or at a cursor."""

    def __init__(self, texts: pa.Array) -> None:
        n = len(texts)
        raw, offsets = string_parts(pc.if_else(pc.less(pc.binary_length(texts), WIDTH - 8), texts, ""))
        self.length = np.diff(offsets)
        self.bytes = np.zeros((n, WIDTH), dtype=np.uint8)
        self.bytes[np.repeat(np.arange(n), self.length), np.arange(len(raw)) - np.repeat(offsets[:-1], self.length)] = raw
        self.digit = (self.bytes >= 48) & (self.bytes <= 57)
        self.value = np.where(self.digit, self.bytes - 48, 0).astype(np.int64)
        self.rows = np.arange(n)

    def fits(self, layout: str) -> np.ndarray:
        """Rows that begin with a layout: 9 is any digit, a any byte, others themselves."""
        out = np.ones(len(self.bytes), dtype=bool)
        for k, c in enumerate(layout):
            if c == "9":
                out &= self.digit[:, k]
            elif c != "a":
                out &= self.bytes[:, k] == ord(c)
        return out

    def number(self, start: int, count: int) -> np.ndarray:
        return self.value[:, start : start + count] @ 10 ** np.arange(count - 1, -1, -1)

    def at(self, cursor: np.ndarray, by: int = 0) -> np.ndarray:
        return self.bytes[self.rows, cursor + by]

    def pair(self, cursor: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        """The two digits from a place after the cursor on, as a number, and whether they are there."""
        at = cursor + by
        return self.value[self.rows, at] * 10 + self.value[self.rows, at + 1], self.digit[self.rows, at] & self.digit[self.rows, at + 1]


def _dates(m: Matrix) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Year, day and month (of slashed dates the first and the second number), whether slashed, and the date's width (0: no date)."""
    n = len(m.rows)
    year, a, b, width = (np.zeros(n, dtype=np.int64) for _ in range(4))
    named = np.zeros(n, dtype=np.int64)
    for k, name in enumerate(MONTHS, 1):
        named[(m.bytes[:, 3:6] == np.frombuffer(name.encode(), dtype=np.uint8)).all(axis=1)] = k
    # layout, places of the year and of the two numbers, in the order day, month
    for layout, y, first, second in (("2099-99-99", 0, 8, 5), ("20999999", 0, 6, 4), ("99.99.2099", 6, 0, 3), ("99 aaa 2099", 7, 0, None), ("99/99/2099", 6, 0, 3)):
        here = m.fits(layout) & (width == 0)
        if second is None:
            here &= named > 0
        width[here] = len(layout)
        year[here] = m.number(y, 4)[here]
        a[here] = m.number(first, 2)[here]
        b[here] = (named if second is None else m.number(second, 2))[here]
    return year, a, b, m.fits("99/99/2099"), width


def _times(m: Matrix, width: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Seconds of the day, offset in seconds, whether there is one, and whether the rest of the text is a time or nothing."""
    none = m.length == width
    first = m.at(width)
    hour, h_there = m.pair(width, 1)
    minute, m_there = m.pair(width, 4)
    right = ((first == ord("T")) | (first == ord(" "))) & h_there & (m.at(width, 3) == ord(":")) & m_there & (minute < 60)
    cursor = np.where(right, width + 6, 0)
    # seconds
    second, s_there = m.pair(cursor, 1)
    has = right & (m.at(cursor) == ord(":"))
    right &= ~has | (s_there & (second < 60))
    second = np.where(has, second, 0)
    cursor = cursor + 3 * has
    # AM or PM, after a blank or none
    half = np.zeros(len(m.rows), dtype=np.uint8)
    for gap in (0, 1):
        letter = m.at(cursor, gap)
        found = right & (half == 0) & ((letter == ord("A")) | (letter == ord("P"))) & (m.at(cursor, gap + 1) == ord("M"))
        found &= (gap == 0) | (m.at(cursor) == ord(" "))
        half[found] = letter[found]
        cursor = cursor + (2 + gap) * found
    right &= np.where(half > 0, (hour >= 1) & (hour <= 12), hour < 24)
    hour = np.where(half > 0, hour % 12 + 12 * (half == ord("P")), hour)
    # offset, after a blank or none
    rest = right & (cursor < m.length)
    cursor = cursor + (rest & (m.at(cursor) == ord(" ")))
    sign = m.at(cursor)
    zulu = rest & (sign == ord("Z"))
    signed = rest & ((sign == ord("+")) | (sign == ord("-")))
    oh, oh_there = m.pair(cursor, 1)
    colon = signed & (m.at(cursor, 3) == ord(":"))
    om, om_there = m.pair(cursor + colon, 3)
    right &= ~signed | (oh_there & om_there & (oh <= 14) & (om < 60))
    cursor = cursor + zulu + signed * (5 + colon)
    right &= (cursor == m.length) & (~rest | zulu | signed)
    offset = np.where(signed, (oh * 3600 + om * 60) * np.where(sign == ord("-"), -1, 1), 0)
    seconds = np.where(right & ~none, hour * 3600 + minute * 60 + second, 0)
    return seconds, offset, (zulu | signed) & ~none, none | right


def parse(raw: pa.Array, zone: pa.Array, changes: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """State, utc_us and ambiguous of stamps; of slashed ones possible in two ways other_us and other ambiguity, day first; votes 1 day first, 2 month first."""
    m = Matrix(pc.utf8_trim(raw, characters=BLANKS))
    n = len(m.rows)
    year, a, b, slashed, width = _dates(m)
    seconds, offset, fixed, right = _times(m, width)
    right &= width > 0
    names = pc.dictionary_encode(pc.fill_null(zone.cast(pa.string()), ""))
    code = names.indices.to_numpy(zero_copy_only=False)

    def instants(day: np.ndarray, month: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        days, exists = days_of(year, month, day)
        wall = days * DAY + seconds
        utc, unclear, placed = wall - offset, np.zeros(n, dtype=bool), fixed.copy()
        for k, name in enumerate(names.dictionary.to_pylist()):
            here = ~fixed & (code == k)
            if name in changes:
                utc[here], unclear[here] = to_utc(wall[here], changes[name])
                placed |= here
        return utc * US, unclear, exists & placed & right

    day_first, day_unclear, day_ok = instants(a, b)
    month_first, month_unclear, month_ok = instants(b, a)
    month_ok &= slashed
    undecided = day_ok & month_ok & (a != b)
    state = np.where(undecided, OPEN, np.where(day_ok | month_ok, PLAIN, BAD))
    utc, unclear = np.where(day_ok, day_first, month_first), np.where(day_ok, day_unclear, month_unclear)
    for length, scale in ((10, US), (13, US // 1000)):
        here = (m.length == length) & m.digit[:, :length].all(axis=1)
        utc[here], unclear[here], state[here] = m.number(0, length)[here] * scale, False, EPOCH
    vote = np.where(slashed & (state == PLAIN) & (day_ok != month_ok), np.where(day_ok, 1, 2), 0)
    return {"state": state, "utc_us": utc, "ambiguous": unclear & (state != BAD), "other_us": month_first, "vote": vote}


def normalised(stamps: DataFrame) -> DataFrame:
    """stamp_id, utc_us, rule, ambiguous of stamps (stamp_id, source, zone, raw)."""
    spark = stamps.sparkSession
    rows = stamps.select(F.col("stamp_id").cast("long").alias("stamp_id"), F.col("source").cast("string").alias("source"), F.col("zone").cast("string").alias("zone"), F.col("raw").cast("string").alias("raw"))
    parsed = materialise(rows.mapInArrow(_parser(spark, rows), PARSED), "stamps")
    chosen = decided(parsed)
    rule = F.when(F.col("state") == BAD, "bad").when(F.col("state") == EPOCH, "epoch").otherwise("plain")
    plain = parsed.where(F.col("state") != OPEN).select("stamp_id", F.when(F.col("state") != BAD, F.col("utc_us")).alias("utc_us"), rule.alias("rule"), "ambiguous")
    return plain.unionByName(chosen)


def _parser(spark: SparkSession, rows: DataFrame):  # noqa: ANN202
    known = sorted(available_timezones())
    found = rows.select("zone").where(F.col("zone").isin(known)).distinct().collect()  # names of a fixed list
    changes = spark.sparkContext.broadcast({r["zone"]: zone_changes(r["zone"]) for r in found})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = parse(batch.column("raw"), batch.column("zone"), changes.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("stamp_id"), batch.column("source"), pa.array(got["state"], pa.int32()), pa.array(got["utc_us"], pa.int64()),
                 pa.array(got["ambiguous"], pa.bool_()), pa.array(got["other_us"], pa.int64()), pa.array(got["vote"], pa.int32())],
                names=["stamp_id", "source", "state", "utc_us", "ambiguous", "other_us", "vote"],
            )

    return run


def decided(parsed: DataFrame) -> DataFrame:
    """The undecided stamps of parsed ones, in the order of day and month that their source's votes or else the default says.

    Votes are summed by source and dealt to the salts of a source that occur; the salt is of the row's own
    values, so a source of very many stamps is spread over SALTS keys.
    """
    votes = parsed.where("vote > 0").groupBy("source").agg(F.count(F.when(F.col("vote") == 1, 1)).alias("d"), F.count(F.when(F.col("vote") == 2, 1)).alias("m"))
    salt = F.pmod(F.xxhash64("stamp_id", "utc_us", "other_us"), F.lit(SALTS)).cast("int")
    rows = parsed.where(F.col("state") == OPEN).select("stamp_id", "source", "utc_us", "other_us", salt.alias("salt"))
    there = rows.select(F.col("source").alias("k"), F.col("salt").alias("s")).distinct()
    dealt = there.join(votes.hint("merge"), F.col("k").eqNullSafe(F.col("source"))).select("k", "s", "d", "m").hint("merge")
    joined = rows.join(dealt, F.col("source").eqNullSafe(F.col("k")) & (F.col("salt") == F.col("s")), "left")
    d, m = F.coalesce("d", F.lit(0)), F.coalesce("m", F.lit(0))
    by_votes = (d > RATIO * m) | (m > RATIO * d)
    utc = F.when(d > RATIO * m, F.col("utc_us")).otherwise(F.col("other_us"))
    return joined.select("stamp_id", utc.alias("utc_us"), F.when(by_votes, "votes").otherwise("default").alias("rule"), F.lit(True).alias("ambiguous"))
