import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from data import SF001, SF01, docs_of, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from repochron.llm import variants
from repochron.llm.variants import (affected, count_words, decompose, folded, op12_vgram_variants, planted_slip, roots,
                                    spelling_variants)


def near(a, b):
    """One inserted, deleted or replaced code point, by the definition."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def all_near(words):
    """Near words of each: words that share a word with one code point cut out, held to the definition."""
    holes, out = defaultdict(set), {w: set() for w in words}
    for w in words:
        holes[w].add(w)
        for i in range(len(w)):
            holes[w[:i] + w[i + 1:]].add(w)
    for group in holes.values():
        for a in group:
            out[a] |= {b for b in group if near(a, b)}
    return out


def brute(counts, factor=2):
    linked, form = all_near(list(counts)), {}
    for w, others in linked.items():
        top = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= factor * counts[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return sorted((w, n, form[w], form[w] and counts[form[w]], len(linked[w]), root(w)) for w, n in counts.items())


def rows_of(df):
    return sorted((r["word"], r["n"], r["form"], r["form_n"], r["n_near"], r["root"]) for r in df.collect())


def corpus(path_rows):
    total = Counter()
    for r in path_rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"] or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("sf", [SF001, SF01])
def test_whole_table(spark, sf):
    wanted = brute(corpus(docs_of(spark, sf).collect()))
    assert rows_of(op12_vgram_variants(spark, sf)) == wanted
    assert sum(r[2] is not None for r in wanted) > 20


@pytest.mark.parametrize("long_list", [2, 64])
def test_few_letters_make_hot_lists(spark, long_list):
    """Words of two letters: grams are frequent, repeat within words, and lists are long."""
    rng = random.Random(7)
    counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(5, 12))): rng.randrange(1, 50) for _ in range(900)}
    counts |= {"b" * k: k for k in range(5, 40)} | {"été" + w: 3 for w in ("abcd", "abce", "abc", "àbcd")}
    got = spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"), long_list=long_list)
    assert rows_of(got) == brute(counts)


def test_other_alphabets(spark):
    rng = random.Random(9)
    counts = {"".join(rng.choice("аб漢字😀ā") for _ in range(rng.randrange(5, 8))): rng.randrange(1, 50) for _ in range(600)}
    assert rows_of(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=5, max_size=14), st.integers(0, 13), st.sampled_from("abcd"), st.integers(0, 2),
       st.sets(st.text("abc", min_size=2, max_size=4)))
def test_an_edit_leaves_all_but_the_affected_grams(word, at, letter, kind, common):
    """The bound behind the lists: any edit, any dictionary."""
    at %= len(word)
    other = (word[:at] + letter + word[at + 1:], word[:at] + letter + word[at:], word[:at] + word[at + 1:])[kind]
    m = min(len(word), len(other))
    if m < 5:
        return
    packed = defaultdict(list)
    for g in common:
        packed[variants.gram_class(m), len(g)].append(int.from_bytes(g.encode(), "big"))
    frequent = {k: np.sort(np.array(v, np.uint64)) for k, v in packed.items()}
    bags = []
    for w in (word, other):
        gram, size = decompose(folded([w], len(w)), m, frequent)
        assert gram.shape[1] - affected(size)[0] >= 2
        bags.append((Counter(gram[0].tolist()), gram.shape[1] - affected(size)[0]))
    shared = sum((bags[0][0] & bags[1][0]).values())
    assert shared >= max(bags[0][1], bags[1][1])


def test_slips_and_counts(spark):
    docs = spark.createDataFrame([(1, "Hello, hello ÀB hÉllo Éx×y"), (None, "hello"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in count_words(docs, "doc_id", "text", r"[a-zÀ-ÿ]+", min_length=1).collect()}
    assert got == {"hello": 3, "Àb": 1, "hÉllo": 1, "Éx×y": 1}
    slips = [i for i in range(2000) if planted_slip("words", str(i).encode()) != "words"]
    assert slips and all(zlib.crc32(f"{i}:words".encode()) % 97 == 0 for i in slips) and 5 < len(slips) < 60


def test_a_task_flushes_its_counts(spark, monkeypatch):
    monkeypatch.setattr(variants, "DISTINCT", 3)
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta word{'abcdefghij'[i % 10]}") for i in range(40)], "doc_id long, text string")
    got = {r["word"]: r["n"] for r in count_words(docs, "doc_id", "text", "[a-z]+", min_length=5).collect()}
    assert got["alpha"] == 40 and got["worda"] == 4 and "beta" not in got


def test_chains_of_forms(spark):
    chain = [(f"w{k}", f"w{k + 1}" if k < 13 else None) for k in range(14)]
    got = {r["word"]: r["root"] for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {f"w{k}": "w13" for k in range(13)}


def test_odd_rows_and_empty(spark):
    counted = count_words(odd_docs(spark), "doc_id", "text", "[a-z]+")
    assert {r["word"]: r["n"] for r in counted.collect()} == {"words": 20, "x" * 5000: 1, "mlaut": 10}
    rows = rows_of(spelling_variants(counted))
    assert ("words", 20, None, None, 0, "words") in rows and any(len(r[0]) == 5000 for r in rows)
    none = spark.createDataFrame([], "word string, n long")
    assert spelling_variants(none).collect() == []
    odd = spark.createDataFrame([("hello", 1, "x"), ("hello", 2, "y"), (None, 3, "z"), ("abc", 9, ""), ("hellos", None, ""),
                                 ("hallo", 6, "q")], "word string, n long, form string")
    assert rows_of(spelling_variants(odd)) == [("hallo", 6, None, None, 1, "hallo"), ("hello", 3, "hallo", 6, 1, "hallo")]
