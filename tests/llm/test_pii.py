from __future__ import annotations

import datetime as dt
import random
import re

import pytest

from menuspark.llm import pii

KEY = b"a test key"


def plain_luhn(digits: str) -> bool:
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10 == 0


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 256, 1000])
def test_feistel_is_a_permutation(size):
    image = [pii.feistel(KEY, "t", i, size) for i in range(size)]
    assert sorted(image) == list(range(size)) and [pii.feistel(KEY, "t", i, size, True) for i in image] == list(range(size))
    assert size < 97 or image != [pii.feistel(b"other", "t", i, size) for i in range(size)] and image != [pii.feistel(KEY, "u", i, size) for i in range(size)]


def test_dates_are_permuted_within_their_widths():
    days = [f"{d}/{m}/1999" for d in range(1, 10) for m in range(1, 10)]
    got = [pii.replace(x, KEY)[0] for x in days]
    assert len(set(got)) == len(days) and all(re.fullmatch(r"\d/\d/\d{4}", g) for g in got)
    for text in ("2001-02-03", "03.04.2005", "12/31/1999", "31-12-2020", "2020/02/29"):
        new, found = pii.replace(text, KEY)
        assert found and new != text and len(new) == len(text) and pii.replace(new, KEY, True)[0] == text
        y, m, d = (int(x) for x in (re.split(r"\D", new) if len(re.split(r"\D", new)[0]) == 4 else re.split(r"\D", new)[::-1]))
        dt.date(y, m, d) if text != "12/31/1999" else dt.date(y, d, m)


def test_values_stay_valid_and_linked():
    rng = random.Random(6)
    for _ in range(200):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        card = digits + pii.luhn_digit(digits)
        grouped = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        a, b = pii.replace(f"a {card}.", KEY)[0], pii.replace(f"({grouped})", KEY)[0]
        new = re.sub(r"\D", "", a)
        assert plain_luhn(card) and plain_luhn(new) and new != card and re.sub(r"\D", "", b) == new
        assert pii.replace(a, KEY, True)[0] == f"a {card}."
    new = pii.replace("IBAN DE89 3704 0044 0532 0130 00", KEY)[0][5:].replace(" ", "")
    assert new[:2] == "DE" and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1


@pytest.mark.parametrize("text", ["", "no values", "4111 1111 1111 1112", "2001-02-30", "13/13/2000", "1.2.3", "256.1.1.1", "000-12-3456", "Version 3.0, 2024", "x@y", "7" * 16, "DE00 3704 0044 0532 0130 00", "1" * 200_000, "@" * 50_000])
def test_clean_texts_stay(text):
    assert pii.replace(text, KEY) == (text, [])


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = pii.pseudonymise(docs, KEY).select("doc_id", "pii.*")
    links: dict[str, str] = {}
    seen = set()
    for r in out.collect():
        text = own[r["doc_id"]]
        phones, mails = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text), re.findall(r"[^\W_]+\.\d+@mail\d\.example\.com", text)
        cards = [c for c in re.findall(r"(?<!\d)\d{16}(?!\d)", text) if plain_luhn(c)]
        for v in r["values"]:
            assert links.setdefault(text[v["start"] : v["end"]], v["pseudonym"]) == v["pseudonym"]
        assert {text[v["start"] : v["end"]] for v in r["values"]} >= {*phones, *mails, *cards}
        assert not any(x in r["text"] for x in [*phones, *mails, *cards])
        seen |= {v["kind"] for v in r["values"]}
        if not r["values"]:
            assert r["text"] == text
    assert {"phone", "email", "card"} <= seen and len(set(links.values())) == len(links)
    back = {r["doc_id"]: r["t"] for r in pii.reveal(out.select("doc_id", "text"), KEY).selectExpr("doc_id", "pii.text t").collect()}
    assert back == own


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "v"), (None, "", "w"), (2, "+1 (017) 555-7713", "x"), (2, "+1 (017) 555-7713", "x")], "doc_id long, text string, values string")
    out = pii.pseudonymise(docs, KEY).collect()
    assert [r["pii"]["text"] for r in out][:2] == [None, ""] and out[2] == out[3] and out[2]["values"] == "x" and len(out[2]["pii"]["values"]) == 1
    assert pii.pseudonymise(docs.limit(0), KEY).count() == 0


@pytest.mark.parametrize("value", ["BE68 5390 0754 7034", "+49 170 1234567", "AT61 1904 3002 3457 3201", "4111 1111 1111 1111", "NO93 8601 1117 947"])
@pytest.mark.parametrize("before,after", [("to ", " AND more"), ("", " 12"), ("", " 2024"), ("1234 ", ""), ("AB13 ", " x"), ("", " AB"), ("x ", ".")])
def test_the_next_word_does_not_hide_a_value(value, before, after):
    if value[0] == "+" and after == " 12":
        after = " 12345"  # 14 digits may be one number
    text = before + value + after
    new, found = pii.replace(text, KEY)
    assert [text[a:b] for a, b, *_ in found] == [value] and value not in new and new.startswith(before) and new.endswith(after)
    assert pii.replace(new, KEY, True)[0] == text
    if before not in ("1234 ", "AB13 "):
        assert found[0][3] == pii.replace(value, KEY)[1][0][3]


def test_overlapping_candidates_go_back():
    rng = random.Random(9)
    for _ in range(2_000):
        digits = "".join(rng.choice("0123456789") for _ in range(15))
        card = digits + pii.luhn_digit(digits)
        grouped = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        text = f"{rng.choice(['AB12', 'DE44', '7', '1234', '55'])} {rng.randrange(1000, 9999)} {grouped} {rng.randrange(10_000)} AND"
        new, found = pii.replace(text, KEY)
        assert found and pii.replace(new, KEY, True)[0] == text


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000])
def test_nothing_stays_itself(size):
    image = [pii.moved(KEY, "t", i, size) for i in range(size)]
    assert sorted(image) == list(range(size)) and all(i != x for i, x in enumerate(image))
    assert [pii.moved(KEY, "t", x, size, True) for x in image] == list(range(size))


def test_a_date_has_one_pseudonym_in_every_notation():
    def day(text):
        p = [int(x) for x in re.split(r"\D", text)]
        y, m, d = p if p[0] > 31 else (p[2], p[0], p[1]) if p[0] <= 12 < p[1] else (p[2], p[1], p[0])
        return dt.date(y, m, d)

    rng = random.Random(2)
    seen = {}
    for _ in range(400):
        d = dt.date.fromordinal(rng.randrange(pii._FIRST, pii._LAST))
        forms = [f"{d:%Y-%m-%d}", f"{d.year}/{d.month}/{d.day}", f"{d:%d.%m.%Y}", f"{d.day}.{d.month}.{d.year}", f"{d.day}/{d.month}/{d.year}", f"{d:%d-%m-%Y}"] + ([f"{d:%m/%d/%Y}"] if d.day > 12 else [])
        new = [pii.replace(x, KEY)[0] for x in forms]
        assert len({day(x) for x in new}) == 1 and day(new[0]) != d and [len(x) for x in new] == [len(x) for x in forms]
        assert [pii.replace(x, KEY, True)[0] for x in new] == forms
        assert seen.setdefault(day(new[0]), d) == d


VALUES = ["٠٥٠-١٢٣-٤٥٦٧", "+٤٩ ١٧٠ ١٢٣٤٥٦٧", "१९९९-०५-०१", "４１１１１１１１１１１１１１１１", "١٩٢.١٦٨.١.٧", "иван@mail.ru", "josé@mail.com", "日本@mail.jp", "jose\u0301.x@mail.com", "user@пример.рф", "ßß@a.de", "دانا@mail.com", "a@b.co"]


@pytest.mark.parametrize("value", VALUES)
def test_digits_and_letters_of_all_scripts(value):
    text = f"see {value}, please"
    new, found = pii.replace(text, KEY)
    assert [text[a:b] for a, b, *_ in found] == [value] and value not in new and pii.replace(new, KEY, True)[0] == text
    if found[0][2] == "ip":  # of another length
        assert all(c == "." or c in pii.alphabet(value[0]) for c in found[0][3])
        return
    changed = [(a, b) for a, b in zip(value.split("@")[0], found[0][3].split("@")[0]) if a != b]
    assert changed and all(b in pii.alphabet(a) for a, b in changed)


def test_a_number_is_linked_across_scripts():
    for a, b in (("٠٥٠-١٢٣-٤٥٦٧", "050-123-4567"), ("１９９９-０５-０１", "1999-05-01")):
        x, y = (pii.replace(t, KEY)[0] for t in (a, b))
        assert pii._plain(x) == y != b


def test_mail_addresses_inside_scripts_without_spaces():
    text = "联系" * 60 + "user@mail.com谢谢"
    new, found = pii.replace(text, KEY)
    assert len(found) == 1 and "user@mail.com" not in new and new.startswith("联系" * 60) and new.endswith("@mail.com谢谢") and pii.replace(new, KEY, True)[0] == text


def test_keys_of_any_length():
    value, seen = "+1 (017) 555-7713", set()
    for n in (0, 1, 64, 65, 1000):
        new = pii.replace(value, b"k" * n)[0]
        assert new != value and pii.replace(new, b"k" * n, True)[0] == value
        seen.add(new)
    assert len(seen) == 5
