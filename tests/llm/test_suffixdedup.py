import hashlib
import random
from collections import Counter

import numpy as np
from data import docs_of, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from repochron.llm import suffixdedup
from repochron.llm.suffixdedup import anchors, buffers, gram_hashes, refine, remove_repeats, split_context


def expected(rows, m):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s: s + m] for _, b in texts for s in range(len(b) - m + 1))
    out = []
    for i, b in texts:
        covered = bytearray(len(b))
        for s in range(len(b) - m + 1):
            if seen[b[s: s + m]] > 1:
                covered[s: s + m] = b"\1" * m
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and not (k and covered[k - 1]))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def planted():
    rng = random.Random(4)
    common = "".join(rng.choice("abcd") for _ in range(90))
    rows = []
    for i in range(60):
        body = "".join(rng.choice("abcd") for _ in range(rng.randrange(20, 200)))
        at = rng.randrange(len(body))
        rows.append((i, body[:at] + common[rng.randrange(30): rng.randrange(60, 90)] + body[at:]))
    rows += [(90, rows[3][1]), (91, rows[3][1][:120]), (92, "ab" * 150), (93, "z" * 200), (94, "é" * 80 + "q")]
    return rows


@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 20))
@settings(max_examples=300, deadline=None)
def test_refinement_finds_equal_prefixes(data, depth):
    text = np.frombuffer(data, np.uint8)
    starts = np.arange(max(0, len(text) - depth + 1))
    seen = Counter(data[s: s + depth] for s in starts)
    assert refine(text, starts, depth).tolist() == [seen[data[s: s + depth]] > 1 for s in starts]


@given(st.binary(min_size=1, max_size=200).map(lambda b: bytes(x % 2 for x in b)), st.integers(2, 30), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_anchors_cover_each_window_once_and_depend_on_it_alone(data, m, gram):
    gram = min(gram, m)
    text = np.frombuffer(data, np.uint8)
    key, pos, lo, n = anchors(text, np.full(len(text), len(text)), m, gram)
    owner = {}
    for k, p, s, c in zip(key.tolist(), pos.tolist(), lo.tolist(), n.tolist()):
        for w in range(s, s + c):
            assert w not in owner and w <= p and p + gram <= w + m
            owner[w] = (k, p - w)
    assert sorted(owner) == list(range(max(0, len(data) - m + 1)))
    by_text = {}
    for w, place in owner.items():
        assert by_text.setdefault(data[w: w + m], place) == place


def test_gram_hash_is_that_of_the_bytes():
    data = np.frombuffer(b"abcabcabcabx" * 5, np.uint8)
    for gram in (1, 2, 3, 5, 7, 8, 13):
        h = gram_hashes(data, gram)
        assert len(h) == len(data) - gram + 1
        text = data.tobytes()
        assert len(set(h.tolist())) == len({text[i: i + gram] for i in range(len(h))})


def test_long_texts_come_in_overlapping_chunks(monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 50)
    text = bytes(range(200))
    parts = list(buffers([text, b"short"], 20))
    spans = [(b, len(buf[s:e])) for _, buf, st_, base in parts for b, s, e in zip(base, st_, [*st_[1:], len(buf)])]
    assert spans == [(0, 69), (50, 69), (100, 69), (150, 50)]


def test_planted_passages_match_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (12_000, 2):                      # refined in a task, or split first
        got = remove_repeats(docs, min_len=40, gram=12, group_limit=limit).collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(rows, 40)


@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(x % 2 for x in b)), st.integers(2, 30), st.integers(1, 30),
       st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_split_contexts_keep_each_window_and_equal_ones_together(data, m, gram, width):
    gram = min(gram, m)
    text = np.frombuffer(data, np.uint8)
    by_text, seen = {}, []
    for key, pos, lo, n in zip(*[a.tolist() for a in anchors(text, np.full(len(text), len(text)), m, gram)]):
        ctx = data[lo: lo + n + m - 1]
        for bucket, first, wins, _ in split_context(ctx, key, n, pos - lo, width, m, gram):
            seen += range(lo + first, lo + first + wins)
            for w in range(lo + first, lo + first + wins):
                assert by_text.setdefault(data[w: w + m], bucket) == bucket
    assert sorted(seen) == list(range(max(0, len(data) - m + 1)))
    if width == 1:                                 # the gram is the window: a bucket holds one text
        assert len(set(by_text.values())) == len(by_text)


def test_a_large_bucket_is_split(spark):
    """One passage, a little too short to go, in all texts: with unlike neighbours, few neighbours, copies."""
    rng = random.Random(6)
    common = "".join(rng.choice("abcd") for _ in range(36))
    rows = []
    for i in range(120):
        left, right = ("".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(2))
        rows.append((i, left + common[rng.randrange(3):] + right))
    rows += [(200, rows[0][1]), (200, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1, 20):
        got = remove_repeats(docs, min_len=40, gram=12, group_limit=limit).collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(rows, 40)


def test_passages_of_over_50_words_go_from_400_bytes_on(spark):
    """Each passage is in two unlike documents; ``n_bytes`` stays the input's length, ``n_removed`` tells what went."""
    rng = random.Random(8)

    def prose(size):
        words = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 7))) for _ in range(size // 4))
        return words[: size - 1] + "k"

    rows, gone = [(i, prose(rng.randrange(500, 900))) for i in range(20)], {}
    for i, size in enumerate((330, 399, 400, 401, 650, 1200)):
        passage = prose(size)
        assert len(passage.split()) > 50
        for k in range(2):                         # digits end the common string at both sides
            doc = 100 + 2 * i + k
            rows.append((doc, f"{prose(rng.randrange(200, 900))}{k}{passage}{k}{prose(rng.randrange(200, 900))}"))
            gone[doc] = size if size >= 400 else 0
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows, 400)
    assert {r.doc_id: r.n_removed for r in got} == {i: gone.get(i, 0) for i, _ in rows}
    assert {r.doc_id: r.n_bytes for r in got} == {i: len(t) for i, t in rows}


def test_documents_match_brute_force(spark):
    docs = docs_of(spark)
    got = sorted((tuple(r) for r in remove_repeats(docs).collect()), key=str)
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()], 400)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = remove_repeats(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows, 400)
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(s.length for s in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    assert remove_repeats(docs.limit(0)).count() == 0
