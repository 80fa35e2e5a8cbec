"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Log levels in the order they are looked for.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL", "FATAL")
# Fixed value: terminal escape sequences.
ANSI_ESCAPE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
# Fixed value: line ends that split a text into lines.
LINE_END = "\r\n|[\n\u000b\u000c\r\u001c\u001d\u001e\u0085\u2028\u2029]"
# Fixed value: white space cut from both ends of a text.
SPACE = "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def truncate_text(text: Column, max_length: int = 1024) -> Column:
    return F.substring(text, 1, max_length)


def normalize_log_line(line: Column) -> Column:
    return strip(F.regexp_replace(line, ANSI_ESCAPE, ""))


def extract_timestamp(line: Column) -> Column:
    """First ISO second stamp in the line, or null."""
    found = F.regexp_extract(line, r"([0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2})", 1)
    return F.nullif(found, F.lit(""))


def extract_level(line: Column) -> Column:
    """First of ``LEVELS``, in list order, that the upper-cased line contains."""
    upper = F.upper(line)
    return F.coalesce(*[F.when(upper.contains(level), F.lit(level)) for level in LEVELS])


def iso_time(ts: Column) -> Column:
    """UTC ISO time; microseconds are printed only when they are not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1_000_000
    return F.concat(whole, F.when(micros == 0, F.lit("")).otherwise(F.format_string(".%06d", micros)), F.lit("+00:00"))


def format_log_line(timestamp_ms: Column, message: Column) -> Column:
    return F.concat(iso_time(F.timestamp_millis(timestamp_ms)), F.lit(" "), F.regexp_replace(message, "\n+$", ""))


def to_snake_case(name: Column) -> Column:
    parted = F.regexp_replace(name, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(parted, "([a-z0-9])([A-Z])", "$1_$2"))


def text_lines(text: Column) -> Column:
    """The lines of a text after trimming it; an empty text has none."""
    trimmed = strip(text)
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, LINE_END))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def estimate_tokens(text: Column) -> Column:
    """Four characters per token, rounded down."""
    return F.floor(F.char_length(text) / 4)


def words(text: Column) -> Column:
    """Lower-case identifier-like words of three or more characters, in order.

    Taken from whole word runs of any script, so a word next to an accented letter is not cut.
    """
    runs = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    kept = F.filter(runs, lambda w: w.rlike("^[A-Za-z][A-Za-z0-9_]{2,}$"))
    return F.transform(kept, F.lower)


def cap_list(values: Column, n: int = 20) -> Column:
    return F.slice(values, 1, n)


def merge_maps(left: Column, right: Column) -> Column:
    """Union of two maps; the right one wins on equal keys."""
    kept = F.map_filter(left, lambda k, _: ~F.coalesce(F.map_contains_key(right, k), F.lit(False)))
    return F.map_concat(kept, right)


def structured_log_json(ts: Column, level: Column, logger: Column, message: Column, exception: Column) -> Column:
    """One JSON log record; a null exception is left out."""
    return F.to_json(
        F.struct(
            F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            level.alias("level"),
            logger.alias("logger"),
            message.alias("message"),
            exception.alias("exception"),
        )
    )


STRUCTURED_LOG = "timestamp string, level string, logger string, message string, exception string"
