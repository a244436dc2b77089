"""Text functions over workflow source code.

Each scans the whole text with one regular expression on the JVM; the
per-line rules are those of Python's ``splitlines`` + ``strip`` + ``split``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repochron.functions.scalars import _c, normalize_breaks, strip

# Keywords and file patterns of the workflow language.
RULE_KEYWORD = "rule"
MODULE_KEYWORD = "module"
INCLUDE_KEYWORD = "include"
INCLUDE_SEP = ":"
INCLUDED_RULE_SUFFIX = ".smk"
RULE_FILE_NAME = "snakefile"
RULE_FILE_SUFFIXES = (".smk", ".snakefile", ".rules")
SCRIPT_DIR_PREFIXES = ("scripts/", "workflow/scripts/")

# White space that does not end a line (after break normalisation only \n does).
_HSPACE = "[^\\S\\n]"


def _kw(keyword: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in keyword)


def names_after_keyword(code, keyword: str = RULE_KEYWORD) -> Column:
    """Names declared by lines whose stripped text starts with ``keyword + ' '``:
    the second white-space token cut at its first colon. Repeats are kept."""
    text = normalize_breaks(F.coalesce(_c(code), F.lit("")))
    pattern = f"(?mU)^{_HSPACE}*{_kw(keyword)} {_HSPACE}*(?=\\S)([^\\s:]*)"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def rule_names(code, keyword: str = RULE_KEYWORD) -> Column:          # F11
    return names_after_keyword(code, keyword)


def module_names(code, keyword: str = MODULE_KEYWORD) -> Column:      # F12
    return names_after_keyword(code, keyword)


def _include_targets(code, keyword: str, sep: str) -> Column:
    """Per include line (stripped line starts with ``keyword + sep``): the text
    between the 1st and 2nd ``sep``, stripped, quotes removed."""
    text = normalize_breaks(F.coalesce(_c(code), F.lit("")))
    s = _kw(sep) if sep != " " else " "
    stop = "\\n" if sep == "\n" else s + "\\n"
    pattern = f"(?mU)^{_HSPACE}*{_kw(keyword)}{s}([^{stop}]*)"
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(raw, lambda x: F.translate(strip(x), "\"'", ""))


def included_files(code, keyword: str = INCLUDE_KEYWORD, sep: str = INCLUDE_SEP,
                   suffix: str = INCLUDED_RULE_SUFFIX) -> Column:     # F13 / P17
    return F.filter(_include_targets(code, keyword, sep),
                    lambda x: (x != "") & x.endswith(suffix))


def irregular_includes(code, keyword: str = INCLUDE_KEYWORD, sep: str = INCLUDE_SEP,
                       suffix: str = INCLUDED_RULE_SUFFIX) -> Column:  # F14 / P17
    return F.filter(_include_targets(code, keyword, sep),
                    lambda x: (x != "") & ~x.endswith(suffix))


def is_rule_file(filename) -> Column:                                  # P15
    low = F.lower(_c(filename))
    cond = low == RULE_FILE_NAME
    for suffix in RULE_FILE_SUFFIXES:
        cond = cond | low.endswith(suffix)
    return F.coalesce(cond, F.lit(False))


def is_script_path(filename, new_path) -> Column:                      # P16
    low = F.lower(_c(new_path))
    cond = F.lit(False)
    for prefix in SCRIPT_DIR_PREFIXES:
        cond = cond | low.startswith(prefix)
    return (~is_rule_file(filename)) & _c(new_path).isNotNull() & F.coalesce(cond, F.lit(False))


def occurrence_diff(after, before) -> Column:                         # U07
    """Count of names in ``after`` (repeats included) missing from ``before``: both lists are sorted
    together, marks of ``before`` first among equal names, and walked once."""
    def entry(mark):
        return lambda x: F.struct(x.alias("name"), F.lit(mark).alias("found"))

    both = F.array_sort(F.concat(F.transform(F.array_distinct(_c(before)), entry(0)), F.transform(_c(after), entry(1))))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).cast("bigint").alias("n"))
    return F.aggregate(both, start, lambda s, x: F.when(
        x["found"] == 0, F.struct(x["name"].alias("last"), s["n"].alias("n"))).otherwise(F.struct(
            s["last"].alias("last"), (s["n"] + F.when(x["name"].eqNullSafe(s["last"]), 0).otherwise(1)).alias("n"))), lambda s: s["n"])


def set_diff_size(after, before) -> Column:                           # U03 / U04
    return F.size(F.array_except(_c(after), _c(before))).cast("bigint")
