"""Scalar text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks of Unicode and the four separators of ASCII.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the citation format of answers.
CITATION = r"(?dU)\[FILE:\s*(.+?),\s*LINES:\s*(\d+)-(\d+)\]"


#: Fixed value: the name of a repository whose URL cannot be read.
DEFAULT_REPOSITORY = "default-repo-name"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without Unicode blanks at either end."""
    return F.btrim(_col(x), F.lit(_BLANKS))


def strip_sql(x: str) -> str:
    """`strip` as a text of SQL."""
    return f"btrim({x}, decode(unhex('{_BLANKS.encode().hex()}'), 'UTF-8'))"


def newlines_sql(x: str) -> str:
    return f"CAST(length({x}) - length(replace({x}, chr(10), '')) AS int)"


def is_blank(x: Column | str) -> Column:
    return strip(x) == ""


def newlines(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))).cast("int")


def token_estimate(x: Column | str) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(_col(x)) / 4).cast("int")


def file_type(path: Column | str) -> Column:
    """The last extension in lower case without its dot; `unknown` without one, empty for a trailing dot."""
    name = F.regexp_extract(_col(path), r"([^/]*)\z", 1)
    extension = F.regexp_extract(name, r"(?s)\A\.*[^.].*?(\.[^.]*)\z", 1)
    return F.when(extension == "", "unknown").otherwise(F.lower(F.substring(extension, 2, 1 << 20)))


def collection_name(name: Column | str) -> Column:
    """Lower case, other characters than letters, digits, `_.-` made `_`, outer `_.` cut, then 63 characters."""
    plain = F.lower(F.regexp_replace(_col(name), r"[^a-zA-Z0-9_.-]", "_"))
    return F.substring(F.regexp_replace(plain, r"\A[_.]+|[_.]+\z", ""), 1, 63)


def repository_name(url: Column | str) -> Column:
    """The path of a URL without leading slashes, every `.git` removed, slashes made `--`."""
    path = F.regexp_replace(_col(url), r"\A([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?|[?#].*\z", "")
    name = F.replace(F.replace(F.regexp_replace(path, r"\A/+", ""), F.lit(".git"), F.lit("")), F.lit("/"), F.lit("--"))
    # a host with one bracket of a pair is no URL
    host = F.regexp_extract(_col(url), r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.when(host.contains("[") != host.contains("]"), DEFAULT_REPOSITORY).otherwise(name)


def chunk_id(repo: Column | str, path: Column | str, start: Column | str, end: Column | str) -> Column:
    """Repository, path and lines joined by `_`, slashes and dots of the first two made `_`."""
    return F.concat_ws("_", *(F.translate(_col(x), "/.", "__") for x in (repo, path)), *(_col(x).cast("string") for x in (start, end)))


def citations(answer: Column | str) -> Column:
    """Distinct (file_path, start_line, end_line) in order of first occurrence; numbers too large are null."""
    path, start, end = (F.regexp_extract_all(_col(answer), F.lit(CITATION), F.lit(k)) for k in (1, 2, 3))
    both = F.arrays_zip(path.alias("p"), start.alias("s"), end.alias("e"))
    return F.array_distinct(
        F.transform(
            both,
            lambda x: F.struct(strip(x["p"]).alias("file_path"), x["s"].try_cast("int").alias("start_line"), x["e"].try_cast("int").alias("end_line")),
        )
    )
