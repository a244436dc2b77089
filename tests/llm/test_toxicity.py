import random
import zlib

import numpy as np
from data import SF01, docs_of, odd_docs

from repochron.llm.toxicity import calibrate, counted, fit_nnpu, score_toxicity, sparse, without_toxic

LABELS = "doc_id long, quality int, toxic int"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def corpus(n=1500, share=0.2, seed=1):
    rng = random.Random(seed)
    bad, rows, toxic = ["grumblefoo", "snarkish", "vilewort"], [], {}
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 120))]
        toxic[i] = int(rng.random() < share)
        if toxic[i]:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
    return rows, toxic


def test_counts_are_those_of_single_texts():
    texts = ["The cat, the CAT!", None, "", "été réeuxment " * 3000, "a" * 100_000 + " b", "x1y2"]
    r, c, v = counted(texts)
    for i, t in enumerate(texts):
        r1, c1, v1 = counted([t])
        assert c[r == i].tolist() == c1.tolist() and np.allclose(v[r == i], v1)
    assert (r == 1).sum() == (r == 2).sum() == 0


def test_positives_and_unlabelled_text_suffice():
    rows, toxic = corpus()
    p = [t for i, t in rows if toxic[i] and i % 2][:100]
    u = [t for i, t in rows if i % 2]
    m = fit_nnpu(sparse(p), sparse(u), 0.2)
    test = [(t, toxic[i]) for i, t in rows if not i % 2]
    said = m.logits([t for t, _ in test]) > np.log(0.3 / 0.7)
    y = np.array([x for _, x in test], bool)
    assert (said & y).sum() / y.sum() > 0.95 and (said & ~y).sum() <= 0.02 * (~y).sum()


def test_calibration_recovers_a_logistic_shift():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.2
    z = rng.normal(0, 1, 20_000) + np.where(y, 1.5, -1.5)
    true = 3 * z + np.log(0.2 / 0.8)                 # log-odds of the two shifted normals
    a, b = calibrate(z[y] / 2, z / 2, 0.2)
    assert abs(np.mean(1 / (1 + np.exp(-(a * z / 2 + b)))) - 0.2) < 0.02
    assert abs(a / 2 - 3) < 0.5 and abs(b - np.log(0.25)) < 0.4 and true is not None


def test_held_out_labels_are_never_read(spark):
    rows, toxic = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = [(i, 1, toxic[i]) for i in toxic]
    other = [(i, q, 1 - t if held_out(i) else t) for i, q, t in labels]
    a, b = ({r.doc_id: (r.held_out, r.score) for r in score_toxicity(docs, spark.createDataFrame(x, LABELS)).collect()}
            for x in (labels, other))
    assert a == b and all(h == held_out(i) for i, (h, _) in a.items())


def test_held_out_quality_on_documents(spark):
    docs, labels = docs_of(spark, SF01), spark.read.parquet(f"{SF01}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out and r.doc_id in truth]
    hit = sum(truth[r.doc_id] for r in test if r.predicted)
    assert hit >= 0.5 * sum(truth[r.doc_id] for r in test) and hit >= 0.8 * sum(r.predicted for r in test)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 1), (3, 0, 0), (None, 1, 1), (5, None, None), (8, 0, 0), (9, 0, 0), (2, 0, 0)], LABELS)
    rows = score_toxicity(docs, labels, keep=["text", "score"]).columns
    assert rows == ["doc_id", "held_out", "score", "predicted", "text", "score"]
    rows = score_toxicity(docs, labels).collect()
    assert len(rows) == 10 and all(0 < r.score < 1 for r in rows)
    empty = [r.score for r in rows if r.doc_id in (2, 3)]
    assert empty[0] == empty[1]
    none = score_toxicity(docs, labels.limit(0))
    assert none.where("predicted = 1").count() == 0
    same = without_toxic(docs, labels.limit(0))
    assert same.schema.names == docs.schema.names and same.count() == 10
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_runs_of_letters_count_whole():
    """Two runs that differ only beyond byte 64 have different features, and equal ones equal features."""
    a, b = "x" * 70 + "a" + "y" * 500, "x" * 70 + "b" + "y" * 500
    assert counted([a])[1].tolist() != counted([b])[1].tolist()
    assert counted([a])[1].tolist() == counted([f"{a} "])[1].tolist() and counted(["漢" * 400])[1].tolist() != counted(["漢" * 401])[1].tolist()
