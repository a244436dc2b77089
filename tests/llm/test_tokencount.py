import random

from data import SF001, odd_docs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from repochron.llm.tokencount import CountTree, attach_edits, edited_counts, op9_edit_counts, segments
from repochron.llm.tokens import default_path, encoder

ALPHABET = ["a", "b", " ", "  ", "'s", "'ll", "é", "ß", "1", "23", ".", "\n", "\t", "Ab", " the", " x", "!!", "中", "I'"]


def exact():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def apply(text, at, remove, insert):
    at = max(0, min(at, len(text)))
    return text[:at] + insert + text[at + max(0, min(remove, len(text) - at)):]


def test_random_edits_match_a_full_count():
    rng, count, enc = random.Random(3), exact(), encoder(default_path())
    for _ in range(150):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(300)))
        tree = CountTree(text, lambda s: len(enc.ids(s)), size=rng.choice([4, 8, 20]))
        for _ in range(12):
            insert = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 5, 60])))
            edit = rng.randrange(-2, len(text) + 3), rng.randrange(12), insert
            text = apply(text, *edit)
            tree.edit(*edit)
            assert (tree.text(), tree.n_chars, tree.n_tokens) == (text, len(text), count(text))


def test_only_the_region_is_encoded_again():
    text = "some words of prose here " * 4000
    tree = CountTree(text, exact())
    tree.encoded = 0
    tree.edit(50_000, 5, "other")
    assert 0 < tree.encoded < 3000 and tree.text() == apply(text, 50_000, 5, "other")
    assert "".join(segments(text)) == text and len(segments("x" * 10_000)) == 1


def test_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF001}/documents.parquet").withColumn(
        "at", F.pmod(F.xxhash64("doc_id"), F.length("text").cast("long") + 1)).collect()}
    count = exact()
    rows = op9_edit_counts(spark, SF001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        d = docs[r.doc_id]
        text = apply(d.text, d["at"], 7, d.lang)
        text = apply(text, len(d.text) // 2, 0, f" {d.source} ")
        text = apply(text, 0, 3, "")
        assert (r.tokens_before, r.tokens_after, r.chars_after) == (count(d.text), count(text), len(text))


def test_odd_rows_and_edit_tables(spark):
    docs = odd_docs(spark)
    edits = spark.createDataFrame([(1, 1, 4, 3, "dog"), (1, 0, 0, 0, "A "), (2, 0, 5, 5, "new text"), (3, 0, None, None, None),
                                   (99, 0, 0, 0, "x"), (None, 0, 0, 0, "x"), (7, 0, 10, 4000, "")],
                                  "doc_id long, seq int, at long, remove long, insert string")
    got = edited_counts(attach_edits(docs, edits), with_text=True).collect()
    assert len(got) == 10
    after = {r.doc_id: r for r in got if r.doc_id in (1, 2, 3, 7)}
    assert after[1].text_after.startswith("A thdogat") or after[1].text_after == apply(apply(docs.first().text, 0, 0, "A "), 4, 3, "dog")
    assert after[2].text_after == "new text" and after[2].tokens_before == 0 and after[3].text_after == ""
    assert after[7].chars_after == 1000
    count = exact()
    assert all(r.tokens_after == count(r.text_after) for r in got)
    assert edited_counts(attach_edits(docs.limit(0), edits)).count() == 0
