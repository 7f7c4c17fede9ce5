"""Personal data: what is found, what replaces it, and that surrogates are distinct."""

import re

from stintline.llm import personal
from stintline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_query_is_registered_and_replaces_all_of_the_given_data(spark):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_pii_surrogates"](spark, SF).collect()
    assert len(rows) == len(before)
    shapes = [r"[\w.]+@[\w.]+\.com", r"\+1 \(\d{3}\) 555-\d{4}", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w.])", r"(?<!\w)\d{16}(?!\w)"]
    seen = 0
    for r in rows:
        old = before[r.doc_id] or ""
        for shape in shapes:
            a, b = re.findall(shape, old), re.findall(shape, r.text or "")
            assert len(a) == len(b) and all(x != y for x, y in zip(a, b, strict=True))
            seen += len(a)
        assert r.n_replaced or r.text == before[r.doc_id]
        for shape in shapes:
            old, r_text = re.sub(shape, "#", old), re.sub(shape, "#", r.text or "")
    assert seen > 5


def test_type_gender_script_and_format(spark):
    texts = [
        "Mr. Smith met Anna Schmidt; ANNA SCHMIDT and Schmidt left. Иван Иванов, Анна Иванова, señor García.",
        "Call +1 (743) 555-3824 or +1 743 555 3824 or 0171 2345678, card 4111 1111 1111 1111, ip 10.0.0.1, 8.8.8.8",
        "IBAN DE89 3704 0044 0532 0130 00; hein.19@mail5.example.com, Hein.19@Mail5.example.com, bob@smith.co.uk, ანა@gmail.com, 123-45-6789, 2001:db8::1",
        'By To. Und die, token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" at 12:30:45 on 2024-01-02, 1.5',
        None,
        "",
    ]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string, n_replaced int")
    rows = {r.doc_id: r for r in personal.replace(df.repartition(3), "k").collect()}
    got = [rows[i].text for i in range(len(texts))]
    assert rows[6].text == got[0] and got[3:] == texts[3:] and rows[3].n_replaced == 0 and rows[4].n_replaced == 0
    m = re.fullmatch(r"Mr\. (\w{5}) met (\w+) (\w{7}); (\w+) (\w{7}) and (\w{7}) left\. (\w+) (\w+ов), (\w+) (\w+ова), señor (\w{6})\.", got[0])
    w = m.groups()
    low = {k: v.lower().split() for k, v in personal.GIVEN.items()}
    assert w[1].lower() in low["latin f"] and w[3] == w[1].upper() and w[6].lower() in low["cyrillic m"] and w[8].lower() in low["cyrillic f"]
    assert w[2] == w[5] and w[4] == w[2].upper() and not {"Smith", "Anna", "Schmidt", "Иван", "Иванов", "Иванова", "Анна", "García"} & set(w)
    a = re.fullmatch(r"Call \+1 \((\d{3})\) 555-(\d{4}) or \+1 (\d{3}) 555 (\d{4}) or (0\d{3} \d{7}), card (4\d{3} \d{4} \d{4} \d{4}), ip (10\.[\d.]+), ([\d.]+)", got[1]).groups()
    assert a[:2] == a[2:4] != ("743", "3824") and personal.luhn(a[5].replace(" ", "")) == 0 and a[7] != "8.8.8.8"
    b = re.fullmatch(r"IBAN (DE[\d ]{25}); ([a-z]{4}\.\d\d@[a-z]{4}\d\.example\.com), (\S+), ([a-z]{3}@[a-z]{5}\.co\.uk), (\S{3})@gmail\.com, (\d{3}-\d\d-\d{4}), (2001:[\da-f:]+)", got[2]).groups()
    iban = b[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert b[2].lower() == b[1] and b[2][0].isupper() and all("ა" <= c <= "ჿ" for c in b[4]) and b[4] != "ანა"
    other = {r.doc_id: r.text for r in personal.replace(df, "another key").collect()}
    assert other[1] != got[1] and personal.replace(df.limit(0)).collect() == []


def test_surrogates_are_distinct(spark):
    own = personal.Surrogates("k")
    assert sorted(own.cipher.move(i, 97, "x") for i in range(97)) == list(range(97)) and all(own.cipher.move(i, 97, "x") != i for i in range(97))
    docs = spark.createDataFrame([(i, f"a{i}@gmail.com 10.0.{i // 256}.{i % 256} +1 (212) 555-{i:04d} Mr. {x}{y}") for i, (x, y) in enumerate((x, y) for x in "BCDFGHJKLMNPQRSTVWXZ" for y in "aeiouy")], "doc_id long, text string")
    pairs = personal.pairs(docs, "k")
    assert pairs.count() == 480 and pairs.select("kind", "surrogate").distinct().count() == 480 and personal.clashes(pairs).count() == 0
    bad = spark.createDataFrame([("name", "a", "x"), ("name", "b", "x"), ("name", "c", "c"), ("email", "d", "x")], "kind string, value string, surrogate string")
    assert sorted(r.value for r in personal.clashes(bad).collect()) == ["a", "b", "c"]


def test_long_values_take_time_in_proportion(spark):
    import time

    c = personal.Cipher("k")
    took = []
    for n in (3_500, 200_000, 1_000_000):
        start = time.perf_counter()
        one, two = "q" * n, "q" * (n - 1) + "r"
        a, b = c.text(one, "name"), c.text(two, "name")
        took.append((time.perf_counter() - start) / n)
        assert len(a) == len(b) == n and len({a, b, one, two}) == 4 and c.text(one, "name") == a
    assert took[2] < 10 * took[1]
    rows = [(1, "Mr. Q" + "abcdefg" * 500 + " came"), (2, "write to a@" + "b." * 600 + "com now"), (3, "Mr. Q" + "abcdefg" * 500)]
    got = {r.doc_id: r.text for r in personal.replace(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] != t and len(got[i]) == len(t) for i, t in rows)
    assert got[1].removesuffix(" came") == got[3]
