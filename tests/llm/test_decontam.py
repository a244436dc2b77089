import random
import re

import numpy as np
from data import SF01, docs_of, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from repochron.llm import decontam
from repochron.llm.decontam import lcs, leaks, randomised_svd, without_leaks, word_lists

BENCH = "item_id long, text string"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), max_size=40))
@settings(max_examples=300, deadline=None)
def test_lcs(a, b):
    assert lcs(a, b) == slow_lcs(a, b)


def test_words_are_found_whole():
    texts = ["The cat. THE-cat 42", None, "", "été   été", "x" * 3_000_000 + " the"]
    words = {}
    for rows, h, first in word_lists(texts):
        for r, s, e in zip(rows, first[:-1], first[1:]):
            words[r] = h[s:e].tolist()
    assert len(words[0]) == 5 and words[0][:2] == words[0][2:4] and words[1] == words[2] == []
    assert words[3][0] == words[3][1] and words[4][1] == words[0][0]


def test_svd_spans_what_a_full_one_spans(spark):
    rng = random.Random(3)
    pieces = [[rng.randrange(1, 80) for _ in range(20)] for _ in range(150)]
    vocabulary = np.unique(np.array([w for p in pieces for w in p], np.uint64))
    index = decontam.Index(vocabulary, np.linspace(1, 3, len(vocabulary)), list(range(150)), pieces, pieces)
    a = index.matrix(list(range(150))).astype(float)
    basis = randomised_svd(spark, index, 30).astype(float)
    assert np.allclose(basis.T @ basis, np.eye(30), atol=1e-3)
    best = np.sqrt((np.linalg.svd(a, compute_uv=False)[30:] ** 2).sum())
    assert np.linalg.norm(a - a @ basis @ basis.T) < 1.1 * best


def test_documents_match_word_search(spark):
    docs, bench = docs_of(spark, SF01), spark.read.parquet(f"{SF01}/benchmark.parquet")
    word = re.compile(r"[^\W_]+")
    items = {r.item_id: word.findall(r.text.lower()) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        text = " " + " ".join(word.findall(r.text.lower())) + " "
        want |= {(r.doc_id, i) for i, w in items.items() if " " + " ".join(w) + " " in text}
    got = {(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()}
    assert want and got == want
    kept = {r.doc_id for r in without_leaks(docs, bench).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in want}


def test_paraphrases_blocks_and_answers(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "ilo", "unt", "esk", "oom", "ipt")]

    def prose(n):
        return [rng.choice(words) + rng.choice(["", "s", "ed"]) for _ in range(n)]

    items = [[f"{w}{i}" if rng.random() < 0.5 else w for w in prose(rng.randrange(15, 150))] for i in range(30)]
    docs, want = [], set()
    for i, item in enumerate(items):
        text = list(item)
        for _ in range(len(text) // 8):                      # a few words change, others come in
            text[rng.randrange(len(text) - 6)] = "other"
            text.insert(rng.randrange(len(text) - 6), "filler")
        docs.append((i, " ".join(prose(50) + text + prose(70))))
        want.add((i, i))
        docs.append((100 + i, " ".join(prose(200))))
        half = item[: len(item) // 3]
        docs.append((200 + i, " ".join(prose(60) + half + prose(60))))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH)
    for block in (1024, 10):
        got = {(r.doc_id, r.item_id) for r in leaks(d, b, block=block).collect()}
        assert not {x for x in got if 100 <= x[0] < 200} and len(want - got) <= 1
        # a third of a long item is an excerpt that covers a piece; of a short one it isn't
        thirds = {i for i, item in enumerate(items) if len(item) // 3 >= 0.7 * min(64, len(item))}
        assert thirds and {x for x in got if x[0] >= 200} == {(200 + i, i) for i in thirds}
    asked = b.withColumn("answer", b.text.substr(1, 0))
    assert leaks(d, asked, answer_col="answer").count() >= 29
    strange = spark.createDataFrame([(i, " ".join(w), "never said words here") for i, w in enumerate(items)],
                                    BENCH + ", answer string")
    assert leaks(d, strange, answer_col="answer").count() == 0


def test_copies_whose_end_is_cut_or_reworded_are_found(spark):
    rng = random.Random(4)
    prose = [f"w{i}" for i in range(300)]
    items = [[f"{rng.choice(prose)}x{i}" if rng.random() < 0.5 else rng.choice(prose) for _ in range(rng.randrange(20, 60))]
             for i in range(40)]
    docs = []
    for i, item in enumerate(items):
        reworded = [w if rng.random() > 0.2 else "other" for w in item[:-3]] + ["new", "end", "here"]
        for k, text in enumerate((item[:-3], item[:-5], item[:-3] + ["new", "end", "here"], reworded)):
            docs.append((4 * i + k, i, rng.choices(prose, k=40) + text + rng.choices(prose, k=40)))
    want = {(n, i) for n, i, t in docs if slow_lcs(items[i], t) >= 0.72 * len(items[i])}
    d = spark.createDataFrame([(n, " ".join(t)) for n, _, t in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH)
    got = {(r.doc_id, r.item_id) for r in leaks(d, b).collect()}
    assert len(want) > 120 and want <= got


def test_pieces_outside_the_latent_space_are_found(spark):
    items = [[f"h{i}x{k}" for k in range(10)] for i in range(30)]
    docs = [(i, items[i] + [w for j in (1, 4, 9, 16, 23) for w in items[(i + j) % 30][:6]]) for i in range(30)]
    d = spark.createDataFrame([(n, " ".join(w)) for n, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], BENCH)
    assert {(r.doc_id, r.item_id) for r in leaks(d, b, rank=4).collect()} == {(i, i) for i in range(30)}


def test_excerpts_of_long_items_are_found(spark):
    """Any 64 words in a row of an item, wherever they begin, also across the ends of its pieces."""
    item = [f"w{i}" for i in range(300)]
    docs = [(at, ["x"] * 20 + item[at: at + 64] + ["y"] * 20) for at in range(0, 237, 13)]
    d = spark.createDataFrame([(n, " ".join(w)) for n, w in docs] + [(999, " ".join(item[:20] + ["z"] * 50))], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(item)), (8, "another item of the benchmark altogether")], BENCH)
    assert {(r.doc_id, r.item_id) for r in leaks(d, b).collect()} == {(n, 7) for n, _ in docs}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "some words here some words here some words here"), (2, None), (None, "x y z"), (3, ""),
                                   (4, "a b"), (1, "some words here some words here some words here")], BENCH)
    assert [(r.doc_id, r.item_id) for r in leaks(docs, bench).collect()] == [(8, 4)]
    kept = without_leaks(docs, bench)
    assert kept.schema.names == docs.schema.names and kept.count() == 8          # the text without id goes too
    assert leaks(docs, bench.limit(0)).count() == 0 and without_leaks(docs, bench.limit(0)).count() == 10
    assert leaks(docs.limit(0), bench).count() == 0 and without_leaks(docs.limit(0), bench).count() == 0
