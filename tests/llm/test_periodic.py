import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from data import SF001, docs_of, odd_docs

from repochron.llm.periodic import (codes_of, explode_tiles, fragments, op13_tiled_runs, periodic_runs, screen, tile_words,
                                    tiles_of, z_function)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, exponent=4, shortest=6):
    """Runs by their definition: for every period the stretches that no neighbour extends."""
    codes, best = codes_of([w.encode() for w in words]), {}
    for q in range(1, len(words) // exponent + 1):
        same = np.concatenate(([0], codes[q:] == codes[:-q], [0])).astype(np.int8)
        step = np.diff(same)
        for low, high in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist()):
            if high - low + q >= max(shortest, exponent * q):
                best.setdefault((low, high - low + q), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_texts():
    rng = random.Random(11)
    texts = []
    for k in range(150):
        letters = "ab" if k % 3 else "abcdefgh"
        words = [rng.choice(letters) for _ in range(rng.randrange(80))]
        for _ in range(rng.randrange(4)):
            p = rng.choice((1, 1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 33, 64, 100))
            unit = [rng.choice("abcdefgh") for _ in range(p)]
            run = (unit * 12)[: rng.randrange(3 * p, 9 * p + 2)]
            at = rng.randrange(len(words) + 1)
            words[at:at] = run
        texts.append(rng.choice((" ", "\n", "\t ")).join(words))
    return texts + ["a " * 9000, "a b " * 3000 + "c " * 5000, "x", "", None,
                    " ".join(f"w{i % 1500}" for i in range(9000)), " ".join(f"w{i}" for i in range(9000))]


def test_runs_equal_their_definition(spark):
    texts = random_texts()
    got = periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == len(texts)
    n = 0
    for r in got:
        words = words_of(texts[r["doc_id"]])
        runs = brute(words)
        assert [tuple(x) for x in r["runs"]] == sorted(runs, key=lambda x: (x[0], x[2])), r["doc_id"]
        assert r["collapsed"] == kept(words, runs) and r["n_words"] == len(words)
        n += len(runs)
    assert n > 150


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in docs_of(spark).collect()}
    rows = op13_tiled_runs(spark, SF001).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        words = planted(r["doc_id"], words_of(texts[r["doc_id"]]))
        runs = sorted(brute(words), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert tuple(r)[1:] == (
            len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept(words, runs).encode()).hexdigest()), r["doc_id"]
    assert sum(r["n_runs"] for r in rows) >= 15


def test_a_long_text_is_dealt_in_tiles_and_stitched(spark):
    unit = [f"w{i}" for i in range(700)]
    words = ["a"] * 50 + unit * 40 + ["z"] * 20_000
    docs = spark.createDataFrame([(1, " ".join(words))], "key long, text string")
    tiles = explode_tiles(docs).groupBy("scale").count().collect()
    assert {r["scale"]: r["count"] for r in tiles}[1] >= 5 and {r["scale"]: r["count"] for r in tiles}[512] >= 6
    r = periodic_runs(docs, "key").first()
    assert [tuple(x) for x in r["runs"]] == [(0, 50, 1), (50, 28_000, 700), (28_050, 20_000, 1)]
    assert r["collapsed"] == " ".join(["a"] + unit + ["z"])


def test_tiles_hold_every_stretch():
    words = np.array([0, 1, 2] * 4000 + list(range(5, 900)), np.int32)
    names = [str(w).encode() for w in words]
    assert (codes_of(names)[:3] == words[:3]).all()
    for scale, start, part in tiles_of(names):
        for period, spans in fragments(part, scale, start).items():
            assert scale <= period < 2 * scale
            for low, high in spans:
                assert (words[low:high] == words[low + period: high + period]).all() and high <= len(words) - period
                assert high - low <= tile_words(scale) + 3 * scale


def test_screening_depends_on_the_text_alone():
    """Alone, in any company and order, a text is in question or not, and every text with a run is."""
    texts = [[w.encode() for w in words_of(t)] for t in random_texts()]
    alone = [bool(screen([t])[0]) for t in texts]
    assert alone == [next(tiles_of(t), None) is not None for t in texts]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    assert [alone[i] for i in order] == screen([texts[i] for i in order]).tolist()
    assert all(a for t, a in zip(texts, alone) if brute([w.decode() for w in t])) and not all(alone)


def test_z_function():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(2) for _ in range(rng.randrange(1, 30))]
        z = z_function(s, len(s))
        for i in range(1, len(s)):
            k = 0
            while i + k < len(s) and s[k] == s[i + k]:
                k += 1
            assert z[i] == k


def test_odd_rows_and_empty(spark):
    rows = periodic_runs(odd_docs(spark)).collect()
    assert len(rows) == 10 and sum(r["doc_id"] == 5 for r in rows) == 2
    assert {r["doc_id"]: r["collapsed"] for r in rows}[5] == "the cat sat on the mat"
    assert {r["doc_id"]: r["n_words"] for r in rows}[2] == 0
    assert periodic_runs(docs_of(spark).limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs(docs_of(spark), exponent=3)


def test_other_exponents(spark):
    texts = random_texts()[:60]
    for r in periodic_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), exponent=5, shortest=8).collect():
        assert [tuple(x) for x in r["runs"]] == sorted(brute(words_of(texts[r["doc_id"]]), 5, 8), key=lambda x: (x[0], x[2]))
