import math
import struct
import zlib
from collections import Counter

import xxhash
from data import docs_of, odd_docs

from repochron.llm.sharding import BUCKETS, ROUNDS, shard_rows


def spark_hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def places(rows, shards, seed):
    """Brute force of the numbering and the permutation."""
    keyed = sorted(rows, key=lambda r: (spark_hash(*r) % BUCKETS, r[0] is not None, r[0] or 0, r[1], r[2]))
    n = len(keyed)
    a = max(1, math.ceil(math.sqrt(n)))
    b = math.ceil(n / a)

    def network(x):
        left, right = divmod(x, b)
        for k in range(0, ROUNDS, 2):
            left = (left + spark_hash(right, seed + k) % a) % a
            right = (right + spark_hash(left, seed + k + 1) % b) % b
        return left * b + right

    out = Counter()
    for x, r in enumerate(keyed):
        p = network(x)
        while p >= n:
            p = network(p)
        out[(*r, p % shards, p // shards)] += 1
    return out


def check(df, shards=16, seed=20240229):
    got = shard_rows(df, shards, seed).collect()
    rows = []
    for i, t in df.select("doc_id", "text").collect():
        data = (t or "").encode()
        rows.append((i, len(data) + 1, zlib.crc32(data)))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == places(rows, shards, seed)
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    counts = Counter(r.shard for r in got)
    assert not got or max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1
    assert {r.law for r in got} <= {"rows"} and all(r.grown_shard is None for r in got)


def test_documents_match_brute_force(spark):
    check(docs_of(spark))


def test_odd_rows_and_few_rows(spark):
    docs = odd_docs(spark)
    check(docs)
    check(docs.limit(1), shards=3)
    check(docs.limit(0))


def test_partitions_do_not_matter(spark):
    docs = docs_of(spark)
    a = {tuple(r) for r in shard_rows(docs.repartition(7)).collect()}
    assert a == {tuple(r) for r in shard_rows(docs.coalesce(1)).collect()}


def test_main_path_is_native(spark):
    plan = shard_rows(docs_of(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
