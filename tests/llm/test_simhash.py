import random

import numpy as np
import xxhash
from data import docs_of, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from repochron.llm.common import connected
from repochron.llm.simhash import fingerprint, forest, near_duplicates, near_links, one_of_each, within


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
             .translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, linked):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def expected(rows):
    fps = [slow_fingerprint(t or "") for _, t in rows]
    group = classes(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            first[g] = min(first.get(g, i), i)
    return sorted(((i, f"{f:016x}", first.get(g)) for (i, _), f, g in zip(rows, fps, group)), key=str)


def near_copies():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(300)]
        for _ in range(12):
            w = list(words)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(300)] = "x"
            rows.append((len(rows) * 7 % 1009, " ".join(w)))
    return rows


@given(st.text(alphabet="aB \t\n\x0b\x1c éÉ z", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_bit_sliced_distances():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    x = np.concatenate((x, x ^ np.uint64(5), x ^ (np.uint64(15) << np.uint64(40)), x[:20]))
    for radius in (0, 1, 2, 3, 5, 8):
        want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in x] for a in x])
        assert (within(x, x, radius) == want).all()
    u, v = forest(x, 3)
    assert set(np.concatenate((u, v)).tolist()) <= set(x.tolist()) and len(u) > 100


def test_documents_match_brute_force(spark):
    docs = docs_of(spark)
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == expected([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_near_copies_and_split_buckets(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert sum(1 for i, _, c in want if i != c) > 20
    for block in (4096, 2):
        assert sorted((tuple(r) for r in near_duplicates(docs, block=block).collect()), key=str) == want


def test_no_link_is_lost_between_distant_blocks(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(k)) for b in base for k in (0, 1, 2, 3) for _ in range(4)})
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    links = near_links(spark.createDataFrame(signed, "fp long"))
    roots = {r.node: r.root for r in connected(links).collect()}
    group = classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    ours = [roots.get(s, s) for (s,) in signed]
    assert len(set(zip(group, ours))) == len(set(group)) == len(set(ours))


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3)], "u long, v long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str) == expected(rows)
    kept = one_of_each(docs)
    assert kept.schema == docs.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "7", "8", "9", "None"]
    assert near_duplicates(docs.limit(0)).count() == 0 and one_of_each(docs.limit(0)).count() == 0
