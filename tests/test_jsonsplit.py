"""Split reading of JSON documents against Python's json on whole files."""

import json
import random

import pytest

from repochron.sources.jsonsplit import _pieces, json_entries, range_states


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.choice([None, True, -1.5e3, 7])
    if kind < 5:
        return "".join(rng.choice(("a", "b", "},", "}, ", "}", "{", "[", "]", ",", ":", '"', "\\", "\n", " é", "漢  ", "\t/"))
                       for _ in range(rng.randrange(60)))
    if kind < 7:
        return {value_key(rng): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def value_key(rng):
    return "".join(rng.choice('k}{"\\é,') for _ in range(rng.randrange(1, 8)))


def documents(rng, n):
    for k in range(n):
        size = rng.choice((0, 1, 3, 60, 200))
        doc = ([value(rng) for _ in range(size)] if k % 2 else {f"{i}{value_key(rng)}": value(rng) for i in range(size)})
        yield json.dumps(doc, indent=rng.choice((None, None, 1)), ensure_ascii=bool(k % 3),
                         separators=rng.choice(((",", ":"), (", ", ": ")))) + rng.choice(("", "\n", "  "))


def valid(text):
    try:
        return isinstance(json.loads(text), (list, dict))
    except ValueError:
        return False


def check(spark, folder, texts):
    for k, text in enumerate(texts):
        (folder / f"{k}.json").write_bytes(text if isinstance(text, bytes) else text.encode())
    entries, faults, _ = json_entries(spark, f"{folder}/*.json")
    found, bad = {}, {}
    for r in entries.orderBy("path", "at", "no").collect():
        found.setdefault(int(r["path"].rsplit("/", 1)[1][:-5]), []).append((r["key"], json.loads(r["value"])))
    for r in faults.collect():
        bad[int(r["path"].rsplit("/", 1)[1][:-5])] = r["reason"]
    assert not set(found) & set(bad)
    return found, bad


def test_documents_in_many_ranges(spark, tmp_path, small_splits):
    texts = list(documents(random.Random(4), 14))
    assert max(map(len, texts)) > 4000
    found, bad = check(spark, tmp_path, texts)
    assert bad == {}
    for k, text in enumerate(texts):
        doc = json.loads(text)
        assert found.get(k, []) == (list(doc.items()) if isinstance(doc, dict) else [(None, x) for x in doc]), k


def test_cut_and_broken_documents_are_faults(spark, tmp_path, small_splits):
    rng = random.Random(8)
    texts = []
    for text in documents(rng, 7):
        text = text.strip()
        texts += [text[: rng.randrange(len(text))], text[:-1], text + "]", text + " x", text + '"', "x" + text, text + text]
    found, bad = check(spark, tmp_path, texts + ["  ", "{", "[}", "{]", "[1,,2]", "[1,]", "[,]", "3", '"{}"', '[{"a": 1}}',
                                                 b'["\xff\xfe"]', "[1, 2", "}", "][", '{"a": }'])
    every = texts + ["  ", "{", "[}", "{]", "[1,,2]", "[1,]", "[,]", "3", '"{}"', '[{"a": 1}}', "", "[1, 2", "}", "][", '{"a": }']
    wrong = [k for k, t in enumerate(every) if not valid(t) and k not in bad]
    wrong = [k for k in wrong if every[k]]       # files of no bytes are in no scan
    assert wrong == [] and not [k for k, t in enumerate(every) if valid(t) and k in bad]


def test_ranges_know_their_state(spark, tmp_path, small_splits):
    doc = json.dumps({f"h{i}": {"code": '}"{,}, ' * 15, "n": [i]} for i in range(160)})
    (tmp_path / "a.json").write_text(doc)
    states = range_states(_pieces(spark, str(tmp_path / "a.json"))).orderBy("at").collect()
    assert len(states) > 8
    for r in states:
        depth, inside, k = 0, False, 0
        while k < r["offset"]:
            c = doc[k]
            if inside:
                k += c == "\\"
                inside = c != '"'
            elif c == '"':
                inside = True
            else:
                depth += (c in "{[") - (c in "}]")
            k += 1
        assert (r["in_string"], r["depth"], r["root"]) == (inside, depth, "{"), r["offset"]
    entries, faults, _ = json_entries(spark, str(tmp_path / "a.json"))
    assert entries.count() == 160 and faults.count() == 0 and entries.select("at").distinct().count() > 5


def test_an_entry_larger_than_a_range(spark, tmp_path, small_splits):
    doc = {"a": 1, "b": {"x": ["}" * 50] * 100, "y": "z" * 3000}, "c": [2]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    entries, faults, _ = json_entries(spark, str(tmp_path / "a.json"))
    assert {r["key"]: json.loads(r["value"]) for r in entries.collect()} == doc and faults.count() == 0
