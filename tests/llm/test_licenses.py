import math
import random
import re

from data import SF001, docs_of, odd_docs

from repochron.llm.licenses import PHRASES, TEMPLATES, Template, license_scan, op11_rare_token_licenses

DRIFT, SHARE = 2, 0.8
NOTICES = [t.text for t in TEMPLATES]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def starts(seq, phrase):
    return [i for i in range(len(seq) - len(phrase) + 1) if seq[i: i + len(phrase)] == phrase]


def brute(texts):
    """Every phrase at every place, every notice at every offset."""
    every = [words(t) for t in texts]
    sets = [set(w) for w in every]
    n_docs = len(texts)
    df = {w: sum(w in s for s in sets) for t in TEMPLATES for w in words(t.text)}
    out = []
    for seq in every:
        base = [(s, label) for phrase, label in PHRASES.items() for s in starts(seq, phrase.split())]
        labels, best = {label for _, label in base}, 0.0
        for t in TEMPLATES:
            names = words(t.text)
            weight = [1e-3 + math.log((1 + n_docs) / (1 + df[w])) for w in names]
            for o in range(-len(names) - DRIFT, len(seq) + DRIFT):
                got = sum(x for q, (w, x) in enumerate(zip(names, weight))
                          if any(0 <= o + q + d < len(seq) and seq[o + q + d] == w for d in range(-DRIFT, DRIFT + 1)))
                window = seq[max(0, o - DRIFT): max(0, o + len(names) + DRIFT)]
                if got / sum(weight) >= SHARE - 1e-9 and all(starts(window, words(k)) for k in t.keys):
                    labels.add(t.label)
                    best = max(best, min(1.0, got / sum(weight)))
        at = [s for s, _ in base]
        out.append((len(seq), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})),
                    ",".join(sorted(labels)), round(1.0 if base else best, 9)))
    return out


def texts_with_notices():
    rng = random.Random(3)
    filler = "the of license work this version software program public free code terms is a any under".split()
    texts = []
    for k in range(60):
        body = [rng.choice(filler) for _ in range(rng.randrange(40))]
        notice = NOTICES[k % len(NOTICES)].split()
        for _ in range(rng.randrange(len(notice) // 4 + 2)):
            i = rng.randrange(len(notice))
            notice[i: i + 1] = rng.choice(([], ["odd"], [notice[i], "extra"]))
        at = rng.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + notice + body[at:]))
    return texts + ["Released under the MIT License. Apache License, Version 2.0; CC BY-NC 4.0, under the mit license",
                    "under the MIT-license", "under mit license", "cc  by\nnc ccby nc", "", None, "ÀÉ apache license version 2x",
                    "permission is hereby granted free of charge", "GNU General Public License version 3"]


def test_scan_equals_every_place(spark):
    texts = texts_with_notices()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_scan(docs).collect()}
    wanted = brute(texts)
    rows = [(r["n_words"], r["n_places"], r["first_word"], r["last_word"], ",".join(r["base_labels"]), ",".join(r["labels"]),
             round(r["score"], 9)) for _, r in sorted(got.items())]
    assert rows == wanted
    assert sum(bool(w[5]) for w in wanted) > 30 and any(not w[5] for w in wanted[:60])


def test_whole_table(spark):
    docs = docs_of(spark).select("doc_id", "text").collect()
    wanted = {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs]))}
    for r in op11_rare_token_licenses(spark, SF001).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"],
                round(r["score"], 9)) == wanted[r["doc_id"]]
    assert any(w[5] for w in wanted.values())


def test_odd_rows_and_empty(spark):
    rows = license_scan(odd_docs(spark)).collect()
    assert len(rows) == 10 and all(r["labels"] == [] and r["score"] == 0 for r in rows)
    assert license_scan(docs_of(spark).limit(0)).collect() == []
    docs = spark.createDataFrame([(1, "anything"), (2, None)], "doc_id long, text string")
    assert [r["n_words"] for r in license_scan(docs, templates=(), phrases={}).orderBy("doc_id").collect()] == [1, 0]
    one = license_scan(docs, templates=(Template("x", "anything", ()),), phrases={}).orderBy("doc_id").collect()
    assert [r["labels"] for r in one] == [["x"], []]


def test_long_texts_are_searched_whole(spark):
    text = "plain words " * 50_000 + TEMPLATES[0].text + " more " * 1000 + "Released under the MIT License"
    r = license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["labels"] == ["mit"] and r["first_word"] > 100_000
    assert [(n["start"], round(n["share"], 6)) for n in r["notices"]] == [(100_000, 1.0)]
