"""Fixtures shared by these tests."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

#: Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the
#: operators' own.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, t string, fp string, "
          "h string, score int, is_p string, _row string, pii string, edits2 string")
CAT = "the cat sat on the mat " * 30
TEXTS = [(1, CAT), (2, None), (3, ""), (None, "some words here " * 20), (5, CAT), (5, CAT), (None, None),
         (7, "x" * 5000), (8, "a b"), (9, "ümlaut wörter " * 10)]


def odd_docs(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "t", "f", "h", 1, "p", "r", "q", "e") for i, t in rows], SCHEMA)


def docs_of(spark, sf=SF001):
    return spark.read.parquet(f"{sf}/documents.parquet")
