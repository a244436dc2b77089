import re

import pytest
from data import SF01, docs_of, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from repochron.llm import pii
from repochron.llm.pii import DEMO_KEY, luhn_digit, op4_feistel_pseudonyms, permute, permute_text, pseudonymise, pseudonyms

KEY = b"k" * 32


@given(st.integers(1, 300))
@settings(max_examples=60, deadline=None)
def test_permutation(size):
    assert sorted(permute(v, size, KEY, "t") for v in range(size)) == list(range(size))


def test_permutation_of_valid_values_stays_valid():
    ok = [v for v in range(500) if v % 7]
    assert sorted(permute(v, 500, KEY, "t", lambda x: x % 7 != 0) for v in ok) == ok
    assert [permute(v, 500, KEY, "t") for v in range(20)] != [permute(v, 500, b"q" * 32, "t") for v in range(20)]


def test_text_keeps_its_format():
    a = permute_text("Ab-9é z", KEY, "t")
    assert re.fullmatch("[A-Z][a-z]-[0-9][ß-ÿ] [a-z]", a)
    seen = {permute_text(f"{x}{y}", KEY, "t") for x in "0123456789" for y in "0123456789"}
    assert len(seen) == 100


@pytest.mark.parametrize("text, shape, kind", [
    ("a die.55@mail4.example.com tz", r"a [a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com tz", "email"),
    ("on +1 (017) 555-7713 x", r"on \+1 \(\d{3}\) \d{3}-\d{4} x", "phone"),
    ("+44 20 7946 0958", r"\+44 \d\d \d{4} \d{4}", "phone"),
    ("ip 161.17.88.162!!", r"ip (\d{1,3}\.){3}\d{1,3}!!", "ip"),
    ("GB82 WEST 1234 5698 7654 32 AND", r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d AND", "iban"),
    ("123-45-6789.", r"\d{3}-\d\d-\d{4}\.", "ssn"),
    ("2024-02-29", r"\d{4}-\d\d-\d\d", "date"),
    ("4111 1111 1111 1111", r"\d{4} \d{4} \d{4} \d{4}", "card"),
    ("5889833081335134", r"\d{16}", None),
])
def test_kinds(text, shape, kind):
    new, count = pseudonymise(text, KEY)
    if kind is None:
        valid = luhn_digit(text[:-1]) == text[-1]
        assert (new != text) == valid
        return
    assert new != text and re.fullmatch(shape, new) and count == {kind: 1}
    again, _ = pseudonymise(f"x {text} y {text}", KEY)
    assert again.count(new) == 2 or kind == "iban"
    if kind in ("card", "iban", "ip", "ssn", "date"):
        assert pseudonymise(new, KEY)[1] == {kind: 1}                 # valid again


def test_decoys_stay():
    for text in ("1234567812345678", "1.2.3.400", "2024-13-01", "30/02/2024", "000-12-3456", "GB82 WEST 1234 5698 7654 33",
                 "version 1.2.3", "a@b", "12345", "", "token 98765432109876543210", "3.14159 2,000"):
        assert pseudonymise(text, KEY) == (text, {}), text


def test_layouts_of_a_day_stay_linked():
    iso, other = (pseudonymise(t, KEY)[0] for t in ("1999-12-31", "31/12/1999"))
    y, m, d = iso.split("-")
    assert other == f"{d}/{m}/{y}"


def test_adjacent_values():
    new, count = pseudonymise("+1 (826) 555-4081 190.137.223.204 4111111111111111 4111111111111111", KEY)
    assert count == {"phone": 1, "ip": 1, "card": 2} and new.split()[-1] == new.split()[-2]


def test_values_after_letters_that_look_like_an_iban():
    card = "4111 1111 1111 1111"
    for text, kinds in ((f"order AB12 {card}", {"card": 1}), (f"BE68 5390 0754 7034 {card}", {"iban": 1, "card": 1}),
                        ("AB12 GB82 WEST 1234 5698 7654 32", {"iban": 1})):
        new, count = pseudonymise(text, KEY)
        assert count == kinds and card not in new and "1234 5698" not in new and len(new) == len(text)
    assert pseudonymise(card, KEY)[0] == pseudonymise(f"order AB12 {card}", KEY)[0][11:]


def test_planted_values_go_and_texts_without_them_stay(spark):
    before = {r.doc_id: r.text for r in docs_of(spark, SF01).collect()}
    rows = op4_feistel_pseudonyms(spark, SF01).collect()
    shape = re.compile(r"\S+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|(?<!\d)\d{16}(?!\d)|(?:\d{1,3}\.){3}\d{1,3}")
    found = 0
    for r in rows:
        for m in shape.finditer(before[r.doc_id]):
            if re.fullmatch(r"\d{16}", m[0]) and luhn_digit(m[0][:-1]) != m[0][-1]:
                assert m[0] in r.text
            else:
                found += 1
                assert m[0] not in r.text
        if not re.search(r"\d|@", before[r.doc_id]):
            assert r.text == before[r.doc_id]
    assert found > 30 and len(rows) == len(before)


def test_odd_rows(spark):
    docs = odd_docs(spark, [(1, "call +1 (017) 555-7713"), (1, "call +1 (017) 555-7713"), (None, None), (2, ""),
                            (3, "9" * 5000 + "@" * 50 + "x" * 5000 + "@example.com")])
    got = pseudonyms(docs, DEMO_KEY)
    assert got.columns == [c for c in docs.columns if c != "pii"] + ["pii"]
    rows = got.collect()
    assert rows[0].text == rows[1].text != "call +1 (017) 555-7713" and rows[0].pii.phone == 1
    assert rows[2].text is None and rows[3].text == "" and pseudonyms(docs.limit(0), DEMO_KEY).count() == 0
    with pytest.raises(ValueError):
        pseudonyms(docs, "")
    assert pii.KINDS == tuple(rows[0].pii.asDict())
