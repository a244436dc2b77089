from collections import Counter

import corpus_pipeline
from data import SF01, docs_of, odd_docs

from repochron.llm.decontam import leaks
from repochron.llm.packing import pack_documents
from repochron.llm.pii import DEMO_KEY, pseudonymise
from repochron.llm.simhash import near_duplicates
from repochron.llm.toxicity import score_toxicity


def test_each_stage_follows_its_operator(spark):
    docs = docs_of(spark, SF01)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "best-fit packing"]
    step = list(stages.values())

    clean = step[0](spark, docs, SF01).cache()
    said = {r.doc_id for r in score_toxicity(docs, spark.read.parquet(f"{SF01}/labels.parquet")).where("predicted = 0").collect()}
    assert clean.columns == names and {r.doc_id for r in clean.collect()} == said

    single = step[1](spark, clean, SF01).cache()
    parts = near_duplicates(clean).collect()
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in parts})

    fresh = step[2](spark, single, SF01).cache()
    found = {r.doc_id for r in leaks(single, spark.read.parquet(f"{SF01}/benchmark.parquet")).collect()}
    assert found and {r.doc_id for r in fresh.collect()} == {r.doc_id for r in single.collect()} - found

    private = step[3](spark, fresh, SF01).cache()
    import hashlib
    key = hashlib.blake2b(DEMO_KEY.encode(), digest_size=32).digest()
    want = {r.doc_id: pseudonymise(r.text, key)[0] for r in fresh.collect()}
    assert private.columns == names and {r.doc_id: r.text for r in private.collect()} == want
    assert all(r.n_chars == len(r.text) for r in private.collect())

    packed = step[4](spark, private, SF01)
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r) for r in packed.select(*key).collect()) == Counter(
        tuple(r) for r in pack_documents(private).select(*key).collect())
    for df in (clean, single, fresh, private):
        df.unpersist()


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns) and got.count() > 50


def test_odd_and_empty_documents(spark):
    docs = odd_docs(spark).drop("edits2")
    for rows in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, "/root/testdata/sf0.001")
            if name != "best-fit packing":
                assert [c for c in out.columns if c != "pii"] == [c for c in rows.columns if c != "pii"], name
                rows = out
            out.count()
