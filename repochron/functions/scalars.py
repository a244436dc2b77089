"""Scalar functions (Column -> Column), all JVM-side built-ins.

Dates and epochs follow one rule: the session time zone is UTC, epochs are
fractional seconds as DOUBLE, text dates are produced by ``date_format``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the data the library reads and writes
# (as Spark datetime patterns).
GITHUB_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"          # issue / comment / event times
COMMIT_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss xx"          # commit dates with offset
ISO_TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ssXXX"             # ISO 8601 commit date
GIT_ISO_FORMAT = "yyyy-MM-dd HH:mm:ss xx"              # `git log --date=iso`
# Epoch text as the reference writes it on a UTC host: the offset directive
# of a naive time prints nothing, which leaves a trailing blank.
NAIVE_EPOCH_TEXT_FORMAT = "yyyy-MM-dd'T'HH:mm:ss' '"

SECONDS_PER_UNIT = {"d": 86400, "h": 3600, "m": 60}
DAY_SECONDS = 86400


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# F01 -------------------------------------------------------------------------
def str_to_timestamp(text, fmt: str = GITHUB_TS_FORMAT, strict: bool = False) -> Column:
    """Parse text; null or empty -> null. Malformed -> null (``strict`` raises)."""
    t = _c(text)
    parsed = F.to_timestamp(t, fmt) if strict else F.try_to_timestamp(t, F.lit(fmt))
    return F.when(t.isNull() | (t == ""), F.lit(None).cast("timestamp")).otherwise(parsed)


# F02 -------------------------------------------------------------------------
def epoch_to_str(epoch, fmt: str = NAIVE_EPOCH_TEXT_FORMAT) -> Column:
    """Format an epoch (seconds); null, 0 and negative give null. Fractions are cut."""
    e = _c(epoch)
    return F.when(e > 0, F.date_format(F.timestamp_seconds(F.floor(e)), fmt))


# F03 -------------------------------------------------------------------------
def convert_seconds(seconds, unit: str = "d") -> Column:
    """Whole days / hours / minutes (truncated); null or negative give null."""
    if unit not in SECONDS_PER_UNIT:
        raise ValueError(f"unit {unit!r} is none of {sorted(SECONDS_PER_UNIT)}")
    s = _c(seconds)
    return F.when(s >= 0, F.floor(s / F.lit(SECONDS_PER_UNIT[unit])).cast("bigint"))


# F04 -------------------------------------------------------------------------
def now(is_epoch: bool = False, fractional: bool = False,
        fmt: str = COMMIT_TS_FORMAT, as_of: float | None = None) -> Column:
    """Current time as int / float epoch or text; ``as_of`` pins it (tests, reruns)."""
    ts = F.timestamp_seconds(F.lit(as_of)) if as_of is not None else F.current_timestamp()
    if is_epoch:
        micros = F.unix_micros(ts)
        return (micros / F.lit(1e6)) if fractional else F.floor(micros / F.lit(1e6)).cast("bigint")
    return F.date_format(ts, fmt)


# F05 / F06 / F07 / F08 ------------------------------------------------------
def ts_to_epoch(ts) -> Column:
    """Timestamp (or TIMESTAMP_NTZ read as UTC) to fractional epoch seconds."""
    return F.unix_micros(_c(ts).cast("timestamp")) / F.lit(1e6)


def ts_to_text(ts, fmt: str = COMMIT_TS_FORMAT) -> Column:
    return F.date_format(_c(ts).cast("timestamp"), fmt)


def text_to_utc(text, fmt: str = ISO_TS_FORMAT) -> Column:
    """Parse text with an offset to a UTC instant."""
    return F.try_to_timestamp(_c(text), F.lit(fmt))


# F09 -------------------------------------------------------------------------
def identity(name, email) -> Column:
    """``name:email`` author / committer identity."""
    return F.concat_ws(":", _c(name), _c(email))


# F10 -------------------------------------------------------------------------
def file_extension(filename) -> Column:
    """Lower-cased text after the last dot; no dot -> null; trailing dot -> ''."""
    f = _c(filename)
    return F.when(F.instr(f, ".") > 0, F.lower(F.substring_index(f, ".", -1)))


# F15 -------------------------------------------------------------------------
# Line breaks Python's str.splitlines knows beyond \n and \r.
_EXTRA_BREAKS = "[\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def normalize_breaks(code) -> Column:
    """Map every line break kind to ``\\n`` (CRLF counts once)."""
    c = F.regexp_replace(_c(code), "\\r\\n?", "\n")
    return F.regexp_replace(c, _EXTRA_BREAKS, "\n")


def split_lines(code) -> Column:
    """Array of lines (no terminators); empty text -> empty array."""
    c = normalize_breaks(F.coalesce(_c(code), F.lit("")))
    lines = F.split(F.regexp_replace(c, "\\n$", ""), "\n")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(lines)


# Python's white space (str.isspace), derived by rule; every such code point is below U+3001.
PY_WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(text) -> Column:
    """Python-style strip (Unicode white space both ends); linear time, no regex."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


# F16 / F17 -------------------------------------------------------------------
def case_id(prefix: str, value) -> Column:
    return F.concat(F.lit(prefix + "-"), _c(value).cast("string"))


def commit_case_id(hash_col) -> Column:
    return F.concat(F.lit("Commit-"), F.substring(_c(hash_col), 1, 7))


def last_url_segment(url) -> Column:
    return F.element_at(F.split(_c(url), "/"), -1)


# F19 / F20 / F21 -------------------------------------------------------------
def split_parents(parents_text) -> Column:
    """White-space separated parent hashes; blank -> empty array."""
    t = F.trim(F.coalesce(_c(parents_text), F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "\\s+"))


def is_merge(parents_arr) -> Column:
    return F.size(_c(parents_arr)) > 1


# F22 -------------------------------------------------------------------------
def lenient_int(text) -> Column:
    """'-' -> 0, an integer -> its value, anything else (also over 64 bits) -> null (skipped)."""
    t = _c(text)
    return F.when(t == "-", F.lit(0).cast("bigint")).otherwise(
        F.when(t.rlike("^\\s*[+-]?\\d+\\s*$"), F.trim(t).try_cast("bigint")))


# F23 / F24 -------------------------------------------------------------------
def patch_length(patch) -> Column:
    """Length of the raw patch in bytes."""
    return F.octet_length(_c(patch)).cast("bigint")


def message_strip(msg) -> Column:
    return strip(msg)


# F30 -------------------------------------------------------------------------
def hunk_count(patch, markers: str = "+-") -> Column:
    """Number of maximal runs of lines that start with one of ``markers``.

    Counted as run starts -- a marker line that opens the text or follows a
    non-marker line -- with no repeated group in the pattern, so a run of a
    hundred thousand added lines cannot exhaust the regex engine's stack."""
    cls = "".join("\\" + m if not m.isalnum() else m for m in markers)
    text = normalize_breaks(F.coalesce(_c(patch), F.lit("")))
    after_other = F.size(F.regexp_extract_all(
        text, F.lit(f"(?m)^(?:[^{cls}\\n][^\\n]*)?\\n(?=[{cls}])"), F.lit(0)))
    at_start = F.when(text.rlike(f"^[{cls}]"), F.lit(1)).otherwise(F.lit(0))
    return after_other + at_start
