"""Pseudonyms: permutations, validity, links and untouched text."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logstrata.llm import pseudonyms as ps

NAMES = ps.Pseudonyms(b"key")


@pytest.mark.parametrize("size", [1, 2, 7, 10, 100, 999])
def test_permutations(size):
    permute = ps.Permutation(b"key")
    assert sorted(permute(v, size, b"t") for v in range(size)) == list(range(size))
    if size > 50:
        assert [permute(v, size, b"t") for v in range(9)] != [permute(v, size, b"u") for v in range(9)]


@settings(max_examples=150, deadline=None)
@given(st.integers(10**14, 10**15 - 1))
def test_cards_stay_valid(body):
    card = f"{body}{ps.luhn(str(body))}"
    spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
    (new, spans), (apart, _) = ps.replace(f"a {card}, b", NAMES), ps.replace(spaced, NAMES)
    if len(set(card)) > 1:
        got = new[2:18]
        assert ps.luhn(got[:-1]) == int(got[-1]) and got[0] == card[0]
        assert spans == [("card", 2, 16)] and apart.replace(" ", "") == got


@settings(max_examples=100, deadline=None)
@given(st.dates(ps.FIRST_DAY, ps.LAST_DAY))
def test_dates_stay_dates(day):
    new = ps.replace(day.isoformat(), NAMES)[0]
    other = ps.replace(day.strftime("%d.%m.%Y") if day.year >= 1900 else "", NAMES)[0]
    assert dt.date.fromisoformat(new).strftime("%d.%m.%Y") == other


def test_kinds():
    texts = {
        "email": "jo.smith99@mail.example.com", "phone": "+1 (663) 555-6869", "ip": "190.137.223.204",
        "iban": "DE89 3704 0044 0532 0130 00", "ssn": "123-45-6789",
        "secret": 'token = "11acdfb36bb72224148e6160f674b0a1bc439e93"', "date": "1984-02-29",
    }
    for kind, text in texts.items():
        new, spans = ps.replace(f"x {text}### y", NAMES)
        assert [s[0] for s in spans] == [kind] and text not in new
        start, length = spans[0][1:]
        assert new[:start] == "x " and f"x {text}### y".endswith(new[start + length :])
    iban = ps.replace(texts["iban"], NAMES)[0].replace(" ", "")
    assert ps._mod97(iban[4:] + iban[:4]) == 1 and iban.startswith("DE")
    phones = [ps.replace(t, NAMES)[0] for t in ("+1 (663) 555-6869", "663-555-6869", "(663) 555-6869")]
    assert len({"".join(c for c in p if c.isdigit())[-10:] for p in phones}) == 1


@pytest.mark.parametrize("text", [
    "Licensed under CC BY-NC 4.0.", "version 1.2.3 of 2024", "9807915762804490", "999.1.1.1", "31/02/1999",
    "000-12-3456", "GB00WEST12345698765432", "a@b", "12345 and 67", "0000000000000000", "1-2-3", "12:30:45",
])
def test_clean_text_stays(text):
    assert ps.replace(text, NAMES) == (text, [])


def test_rows(spark):
    card = "4465758382889437"
    long_text = ("a1." * 100_000) + card + " " + "9" * 50_000 + "@" * 1000
    rows = [(1, f"pay {card}", 4), (2, card, 5), (3, None, 6), (4, "", 7), (None, "clean", 8), (2, card, 5)]
    rows += [(5, long_text, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pseudonyms long")
    got = ps.pseudonymise(df, "k")
    assert got.columns == ["doc_id", "text", "pseudonyms"]
    found = got.collect()
    assert len(found) == 7
    by = {r["doc_id"]: r for r in found}
    assert by[1]["text"] == "pay " + by[2]["text"] and by[2]["text"] != card
    assert by[3]["text"] is None and by[4]["text"] == "" and by[None]["text"] == "clean"
    assert by[1]["pseudonyms"][0]["kind"] == "card" and by[3]["pseudonyms"] == []
    other = ps.pseudonymise(df, "another").collect()
    assert {r["doc_id"]: r["text"] for r in other}[2] != by[2]["text"]
    assert ps.pseudonymise(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("zero", ["\u0660", "\u0966", "\uff10", "\U0001d7ce"])
@pytest.mark.parametrize("text", [
    "4465758382889437", "4465 7583 8288 9437", "123-45-6789", "+1 (663) 555-6869", "663-555-6869", "190.137.223.204",
    "1984-02-29", "29/02/1984", "DE89 3704 0044 0532 0130 00", "jo.smith99@mail.example.com",
    "token = 11acdfb36bb72224148e6160f674b0a1bc439e93",
])
def test_digits_of_other_scripts(zero, text):
    theirs = {ord("0") + i: chr(ord(zero) + i) for i in range(10)}
    want, spans = ps.replace(text, NAMES)
    got, found = ps.replace(text.translate(theirs), NAMES)
    assert spans and found == spans and got == want.translate(theirs)


def test_invalid_digits_of_other_scripts_stay():
    theirs = {ord("0") + i: chr(0x660 + i) for i in range(10)}
    for text in ("9807915762804490", "000-12-3456", "31/02/1999", "999.1.1.1"):
        assert ps.replace(text.translate(theirs), NAMES) == (text.translate(theirs), [])


@pytest.mark.parametrize("behind", [" EUR", " 2024", " 12 times", " 20240115", " INVOICE", " 12 34 56", ", 12", "", " A1 B2"])
@pytest.mark.parametrize("text", [
    "ES9121000418450200051332", "BE71096123456769", "BE71 0961 2345 6769", "PL61109010140000071219812874",
    "SE4550000000058398257466", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "NO9386011117947",
    "+1 (243) 555-5526", "+1 243 555 5526", "+44 20 7946 0958", "(243) 555-5526", "243-555-5526", "+49 30-1234-5678",
    "4465 7583 8288 9437", "4465758382889437", "123-45-6789", "1984-02-29", "29.02.1984", "190.137.223.204",
])
def test_a_value_ends_before_what_follows(text, behind):
    (alone, spans), (got, found) = ps.replace(text, NAMES), ps.replace(text + behind, NAMES)
    assert len(spans) == 1 and alone != text
    assert got == alone + behind and found == spans


@pytest.mark.parametrize("text, form", [
    ("03/25/1980", "{m:02}/{d:02}/{y}"), ("03-25-1980", "{m:02}-{d:02}-{y}"), ("25/03/1980", "{d:02}/{m:02}/{y}"),
    ("3/25/1980", "{m}/{d}/{y}"), ("25.3.1980", "{d}.{m}.{y}"), ("1980-3-25", "{y}-{m}-{d}"),
    ("1980-03-25T10:00:00Z", "{y}-{m:02}-{d:02}T10:00:00Z"), ("1980-03-25t1000", "{y}-{m:02}-{d:02}t1000"),
    ("1980-03-25T10:00", "{y}-{m:02}-{d:02}T10:00"),
    ("1980-03-25 10:00", "{y}-{m:02}-{d:02} 10:00"),
])
def test_forms_of_dates(text, form):
    want = dt.date.fromisoformat(ps.replace("1980-03-25", NAMES)[0])
    got, spans = ps.replace(f"on {text}, x", NAMES)
    assert got == f"on {form.format(y=want.year, m=want.month, d=want.day)}, x"
    assert [s[:2] for s in spans] == [("date", 3)]


def test_one_digit_days_and_months():
    assert ps.replace("1/2/1980", NAMES)[1] and ps.replace("1/2/1980", NAMES)[0] != "1/2/1980"
    for text in ("13/13/1980", "0/5/1980", "1980-03-25Tx", "1.2.1980.4"):
        assert ps.replace(text, NAMES) == (text, [])


def test_forms_of_phones():
    ten = "".join(c for c in ps.replace("800-555-1234", NAMES)[0] if c.isdigit())
    dashed, dotted = f"{ten[:3]}-{ten[3:6]}-{ten[6:]}", f"{ten[:3]}.{ten[3:6]}.{ten[6:]}"
    for text, want in (("1-800-555-1234", f"1-{dashed}"), ("800.555.1234", dotted), ("1.800.555.1234", f"1.{dotted}")):
        for behind in (" 12", ".", " or"):
            got, spans = ps.replace(f"call {text}{behind}", NAMES)
            assert got == f"call {want}{behind}" and spans == [("phone", 5, len(want))]


@pytest.mark.parametrize("digits", [16, 96, 97, 128, 160, 5000])
def test_secrets_of_any_length(digits):
    names = ps.Pseudonyms(b"key")
    value = ("0123456789abcdef" * 400)[:digits]
    new, spans = ps.replace(f"token: {value} end", names)
    got = new[len("token: ") : -len(" end")]
    assert len(got) == digits and got != value and set(got) <= set("0123456789abcdef")
    assert [k for k, _, _ in spans] == ["secret"]
    other, _ = ps.replace(f"password={value}", names)
    assert other == f"password={got}"


def test_email_names_keep_their_capitals():
    names = ps.Pseudonyms(b"key")
    mixed, lower = (ps.replace(t, names)[0] for t in ("J.Smith@mail.org", "j.smith@mail.org"))
    assert mixed.lower() == lower and mixed != "J.Smith@mail.org"
    assert [c.isupper() for c in mixed[:7]] == [c.isupper() for c in "J.Smith"]
