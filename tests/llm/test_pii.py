"""Pseudonyms: format kept, equal stays equal, exact undoing, and nothing left behind."""

import datetime
import ipaddress
import random
import re

from pyspark.sql import functions as F

from arcweft.llm import pii


KEY = "k1"


def luhn(d):
    x = [int(c) for c in reversed(d)]
    return sum(x[::2]) + sum(sum(divmod(2 * c, 10)) for c in x[1::2])


def test_formats_and_undoing(spark):
    rng = random.Random(4)
    cards = []
    for _ in range(60):
        body = "".join(str(rng.randrange(10)) for _ in range(15))
        cards.append(next(body + str(c) for c in range(10) if luhn(body + str(c)) % 10 == 0))
    dates = [(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(70000))).isoformat() for _ in range(60)]
    ips = [str(ipaddress.IPv4Address(rng.randrange(2**32))) for _ in range(60)]
    other = ["jane.Doe+x1@mail.example.org", "+1 (017) 555-7713", "(020) 7946 0018", "+44 20 7946 0018", "123-45-6789", "b44e15e09fd311c3cf3163b66d5a9875b883d8ce", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "31.12.1999", "12/25/2019", "4111 1111 1111 1111", "555-123-4567"]
    values = cards + dates + ips + other
    text = [f"xé {v}, and {v}!" for v in values]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    new = {r.doc_id: r.text for r in pii.pseudonymized(docs, KEY).collect()}
    out = [new[i][3:].split(", and ")[0] for i in range(len(values))]
    for i, (v, w) in enumerate(zip(values, out)):
        assert new[i] == f"xé {w}, and {w}!" and v != w and v not in new[i]
        assert re.sub(r"[0-9]", "9", v.split("@")[0]).translate({}) is not None and len(w) == len(v) or i in range(120, 180)
    assert all(luhn(w) % 10 == 0 and len(w) == 16 for w in out[:60])
    for w in out[60:120]:
        datetime.date.fromisoformat(w)
    for w in out[120:180]:
        ipaddress.IPv4Address(w)
    assert out[180].endswith("@mail.example.org") and re.fullmatch("[0-9a-f]{40}", out[185])
    g = out[186].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in g[4:] + g[:4])) % 97 == 1
    assert len(set(out)) == len(out)
    back = pii.pseudonymized(spark.createDataFrame(sorted(new.items()), "doc_id long, text string"), KEY, inverse=True)
    assert [r.text for r in back.orderBy("doc_id").collect()] == text
    other_key = pii.pseudonymized(docs, "k2").where("doc_id = 3").first().text
    assert other_key != new[3]


def test_one_to_one_and_undone_on_all_values(spark):
    """Valid values go to valid ones, others stay; no two values meet, and the key gives each back."""
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def account():
        country, body = rng.choice(["DE", "GB", "FR"]), digits(rng.choice([14, 18]))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        return f"{country}{check if rng.random() < 0.7 else rng.randrange(100):02}{body}"

    values = [digits(16) for _ in range(300)] + [digits(13) for _ in range(60)] + [account() for _ in range(80)]
    values += [f"{rng.randrange(1700, 2300)}-{rng.randrange(1, 15):02}-{rng.randrange(1, 35):02}" for _ in range(150)] + [f"{rng.randrange(1, 15):02}/{rng.randrange(1, 33):02}/{rng.randrange(1790, 2210)}" for _ in range(250)]
    values += [".".join(rng.choice([str(rng.randrange(300)), "0", "255", "07"]) for _ in range(4)) for _ in range(150)] + [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(100)]
    values += ["02/29/2020", "02/29/2019", "02/28/2019", "666-12-3456", "000-00-0000", "1985-13-45", "99.99.2000", "999.999.999.999", "DE00370400440532013000", "+1 (12) 345", "665-12-3456", "667-12-3456", "899-99-9999", "001-01-0001"]
    values = list(dict.fromkeys(values))
    rows = pii.op10_pii(spark.createDataFrame(list(enumerate(values)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    out = [r.text for r in rows]
    assert len(set(out)) == len(values)
    assert all((v == w) == (r.n_found == 0) or v == w for v, w, r in zip(values, out, rows))
    for v, w, r in zip(values, out, rows):
        if re.fullmatch(r"\d{13,16}", v):
            assert (r.n_found == 1) == (luhn(v) % 10 == 0) and (luhn(w) % 10 == 0) == (luhn(v) % 10 == 0)
        if re.fullmatch(r"\d{4}-.*", v) and r.n_found:
            datetime.date.fromisoformat(w)
        if "/" in v:
            kind = lambda x, f: (lambda: (datetime.datetime.strptime(x, f), True))()[1] if _parses(x, f) else False
            assert kind(v, "%d/%m/%Y") == kind(w, "%d/%m/%Y") and kind(v, "%m/%d/%Y") >= (r.n_found and not kind(v, "%d/%m/%Y"))
            assert r.n_found == (1 if "1800" <= v[6:] <= "2199" and (kind(v, "%d/%m/%Y") or kind(v, "%m/%d/%Y")) else 0) or v[6:] == "2199"
    assert {v: w for v, w in zip(values, out)}["02/29/2020"] != "02/29/2020" and sum(r.n_found for r in rows) > 400
    back = pii.pseudonymized(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), KEY, inverse=True).orderBy("doc_id").collect()
    assert [r.text for r in back] == values


def _parses(x, f):
    try:
        datetime.datetime.strptime(x, f)
    except ValueError:
        return False
    return True


def test_quoted_secrets(spark):
    text = ['{"token": "abcdef123456", "n": 1}', "{'password': 'Hunter2hunter2'}", 'key = "4111111111111112"', 'token = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"', "bare b44e15e09fd311c3cf3163b66d5a9875b883d8ce", '"name": "abcdef123456"', 'secret="123-45-6789"']
    rows = pii.op10_pii(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [r.n_found for r in rows] == [1, 1, 1, 1, 1, 0, 1]
    assert all(len(r.text) == len(t) and (r.text != t) == (r.n_found > 0) for r, t in zip(rows, text))
    assert rows[0].text.startswith('{"token": "') and rows[0].text.endswith('", "n": 1}')
    assert rows[3].text[9:-1] == rows[4].text[5:]
    assert [r.text for r in pii.pseudonymized(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), KEY, inverse=True).orderBy("doc_id").collect()] == text


def test_the_key(spark):
    docs = spark.createDataFrame([(1, "8.8.8.8 and 9.9.9.9"), (2, "8.8.8.8")], "doc_id long, text string")
    one, two = ({r.doc_id: r.text for r in pii.op10_pii(docs).collect()} for _ in range(2))
    assert one[1].startswith(one[2]) and one != two  # no setting: a key of its own each time
    spark.conf.set(pii.KEY_SETTING, "from the setting")
    try:
        assert pii.op10_pii(docs).first().text == pii.op10_pii(docs, "from the setting").first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_spacing_does_not_matter(spark):
    docs = spark.createDataFrame([(1, "4111 1111 1111 1111"), (2, "4111-1111-1111-1111"), (3, "4111111111111111")], "doc_id long, text string")
    assert len({re.sub("[ -]", "", r.text) for r in pii.pseudonymized(docs, KEY).collect()}) == 1


def test_spacing_of_phone_numbers_does_not_matter(spark):
    groups = [("1", ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+1-555-123-4567", "+155 5123 4567"]), ("44", ["+442079460018", "+44 20 7946 0018", "+44 (20) 7946-0018"]), ("353", ["+35312345678", "+353 1234 5678"])]
    text = [x for _, g in groups for x in g]
    rows = pii.op10_pii(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [r.n_found for r in rows] == [1] * len(text) and all(re.sub("[0-9]", "9", x) == re.sub("[0-9]", "9", r.text) for x, r in zip(text, rows))
    out = iter(re.sub("[^0-9]", "", r.text) for r in rows)
    for code, group in groups:
        got = {next(out) for _ in group}
        assert len(got) == 1 and min(got).startswith(code) and min(got) != re.sub("[^0-9]", "", group[0])
    assert [r.text for r in pii.pseudonymized(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), KEY, inverse=True).orderBy("doc_id").collect()] == text


def test_mail_after_marks_and_of_any_length(spark):
    known = "john.doe@example.org"
    values = [known, "-" + known, "_ana@example.org", "--kim@x.org", "...mail@x.com", "%a+b@x.com", "b4" * 40 + "@x.org", "ab.c" * 20_000 + "@x.org", "ann@" + "d" * 90 + ".org", "4111 1111 1111 1111bob@x.org", "ann@x.com_bob@y.org"]
    docs = spark.createDataFrame(list(enumerate(f"to {v}, now" for v in values)), "doc_id long, text string")
    rows = pii.op10_pii(docs, KEY).orderBy("doc_id").collect()
    out = [r.text[3:-5] for r in rows]
    assert [r.n_found for r in rows] == [1] * 9 + [2, 2]
    for v, w in zip(values, out):
        a, b = (re.findall("[^@]+(?=@)", x) for x in (v, w))
        assert len(v) == len(w) and all(x != y for x, y in zip(a, b)) and v.split("@", 1)[1][:5] == w.split("@", 1)[1][:5]
    assert out[1] == "-" + out[0] and out[10].split("_")[1].split("@")[0] != "bob"
    assert sum(x != y for x, y in zip(values[7], out[7])) > 50_000
    assert [r.text[3:-5] for r in pii.pseudonymized(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), KEY, inverse=True).orderBy("doc_id").collect()] == values


def test_secrets_of_any_length(spark):
    rng = random.Random(6)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (32, 128, 130, 513, 20_001)]
    named = ["".join(rng.choice("abcXYZ019") for _ in range(n)) for n in (8, 128, 129, 5_000)]
    text = [f"is {h}, yes" for h in hexes] + [f"is token='{x}', yes" for x in named]
    rows = pii.op10_pii(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()
    assert [r.n_found for r in rows] == [1] * len(text)
    for old, r in zip(hexes, rows):
        assert re.fullmatch(r"is [0-9a-f]+, yes", r.text) and len(r.text) == len(old) + 8
    for old, r in zip(text, rows):
        # all parts are permuted
        assert len(r.text) == len(old) and not any(old[i : i + 24] in r.text for i in range(12, len(old) - 40, 24)) and r.text != old
    assert [r.text for r in pii.pseudonymized(spark.createDataFrame([(r.doc_id, r.text) for r in rows], "doc_id long, text string"), KEY, inverse=True).orderBy("doc_id").collect()] == text


def test_clean_texts_and_edge_cases(spark):
    clean = ["", None, "no data here", "version 3.14.15 of 2020", "1.2.3", "Apache License, Version 2.0.", "12 items, 2,000 words", "é" * 1000, "a@b", "key", "x" * 300_000 + " 10 "]
    clean += ["order 1234567890123456", "1985-13-45 000-00-0000"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(clean)] + [(None, "8.8.8.8", "k"), (None, "8.8.8.8", "k")], "doc_id long, text string, key string")
    got = pii.pseudonymized(docs, KEY).collect()
    assert [r.text for r in sorted((r for r in got if r.doc_id is not None), key=lambda r: r.doc_id)] == clean
    assert len({r.text for r in got if r.doc_id is None}) == 1
    assert pii.op10_pii(docs.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = re.compile(r"\S+@\S+\.\w+|\+1 \(\d{3}\) \d{3}-\d{4}|[0-9a-fA-F]{40}|(?<!\d)\d{1,3}(?:\.\d{1,3}){3}(?!\d)")
    old = {r.doc_id: r.text for r in docs.collect()}
    got = pii.op10_pii(docs).collect()
    n = 0
    for r in got:
        for m in found.findall(old[r.doc_id] or ""):
            n += 1
            assert m not in r.text
    assert n > 30 and sum(r.n_found for r in got) >= n
    assert sum(r.text == old[r.doc_id] for r in got) > 0.8 * len(got)
