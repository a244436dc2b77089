"""Exact distinct counts: numbers without gaps, states that merge, plans without expansion."""

import random

from repochron.operators import distincts as dis
from repochron.operators import summary as sm

KEY = ("owner", "repo")
KINDS = {"n_hash": "hash", "n_author": "author"}
SCHEMA = "owner string, repo string, hash string, author string"


def history(n, seed):
    rng = random.Random(seed)
    rows = [("o", "hot" if rng.random() < 0.5 else f"r{rng.randrange(4)}", f"h{rng.randrange(n)}",
             rng.choice([None, "", "A", "B", f"x{rng.randrange(60)}"])) for _ in range(n)]
    return rows + [("o", None, "h1", "A"), ("o", "no-authors", "h2", None), ("o", "only-nulls", None, None)]


def expected(rows):
    out = {}
    for o, r, h, a in rows:
        hs, as_ = out.setdefault((o, r), (set(), set()))
        hs.update({h} - {None})
        as_.update({a} - {None})
    return {k: (len(h), len(a)) for k, (h, a) in out.items() if h or a}


def as_dict(df):
    return {(r["owner"], r["repo"]): (r["n_hash"], r["n_author"]) for r in df.collect()}


def test_counts_and_states_match_sets(spark):
    rows = history(600, 1)
    values = dis.distinct_values(spark.createDataFrame(rows, SCHEMA), KEY, KINDS)
    assert as_dict(dis.distinct_counts(spark.createDataFrame(rows, SCHEMA), KEY, KINDS)) == expected(rows)
    for parts in (1, 7, dis.PARTS):
        numbers = dis.dictionary(values, KEY, parts=parts).cache()
        ids = {}
        for r in numbers.collect():
            ids.setdefault((r["owner"], r["repo"], r["kind"]), []).append(r["id"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ids.values())
        assert as_dict(dis.state_counts(dis.distinct_state(values, numbers, KEY), KEY, list(KINDS))) == expected(rows)


def test_loads_merge_to_the_whole(spark):
    loads = [history(300, 2), [], history(200, 3), history(300, 2)]        # the last one is loaded again
    numbers, states = None, []
    for rows in loads:
        values = dis.distinct_values(spark.createDataFrame(rows, SCHEMA), KEY, KINDS)
        new = dis.dictionary(values, KEY, known=numbers)
        numbers = (new if numbers is None else numbers.unionByName(new)).cache()
        states.append(dis.distinct_state(values, numbers, KEY))
    assert numbers.count() == numbers.select(*KEY, "kind", "id").distinct().count()
    whole = dis.merge_states(*states, key=KEY)
    assert as_dict(dis.state_counts(whole, KEY, list(KINDS))) == expected(sum(loads, []))
    again = dis.merge_states(whole, states[0], key=KEY)
    assert as_dict(dis.state_counts(again, KEY, list(KINDS))) == expected(sum(loads, []))


def test_numbers_past_one_bitmap(spark):
    n = 3 * 32768 + 5
    df = spark.range(n).selectExpr("'o' as owner", "'r' as repo", "cast(id as string) as hash", "'A' as author")
    values = dis.distinct_values(df, KEY, KINDS)
    state = dis.distinct_state(values, dis.dictionary(values, KEY), KEY)
    assert state.where("kind = 'n_hash'").count() == 4
    assert as_dict(dis.state_counts(state, KEY, list(KINDS))) == {("o", "r"): (n, 1)}


def test_bitmaps_of_few_values_are_small(spark):
    df = spark.range(600).selectExpr("'o' as owner", "concat('r', id % 200) as repo", "cast(id as string) as hash", "'A' as author")
    values = dis.distinct_values(df, KEY, KINDS)
    state = dis.distinct_state(values, dis.dictionary(values, KEY), KEY)
    merged = dis.merge_states(state, state, key=KEY)
    for s in (state, merged):
        assert s.selectExpr("max(length(to_json(struct(bits))))").first()[0] < 100
    assert set(as_dict(dis.state_counts(merged, KEY, list(KINDS))).values()) == {(3, 1)}


def test_summary_needs_no_expansion(spark):
    rows = [(*r, "C", float(i), f"d{i}") for i, r in enumerate(history(100, 4))]
    commits = spark.createDataFrame(rows, SCHEMA + ", committer string, committer_epoch double, committer_date string")
    summary = sm.repo_general_summary(commits, as_of=1e9)
    assert "Expand" not in summary._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["owner"], r["repo"]): (r["n_commits_distinct"], r["n_authors"]) for r in summary.collect()}
    assert got == {**expected([r[:4] for r in rows]), ("o", "only-nulls"): (0, 0)}
    few = sm.repo_general_summary(commits, as_of=1e9, distincts=("n_authors",))
    assert "n_commits_distinct" not in few.columns and "n_committers" not in few.columns
    assert {(r["owner"], r["repo"]): r["n_authors"] for r in few.collect()} == {k: v[1] for k, v in got.items()}
