import re

from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm import pii

KEY = "a key"
CARD = "4041894974608795"
ROWS = [
    (100, "Write to Jane.Doe9@mail7.example.com or JANE.DOE9@MAIL7.EXAMPLE.COM!! now"),
    (101, "call +1 (988) 555-2485, or +1 (988) 5552485."),
    (102, f"card {CARD} and 4041-8949-7460-8795, not 4041894974608796 nor 1234567"),
    (103, "host 42.144.35.254!! not 1.2.3.4.5 nor 999.1.1.1 nor v1.2.3.4x"),
    (104, "Mrs. Anna Smith met Mr Smith and Mr. John Smith; Frau Müller left"),
    (105, "Господин Пётр Иванов и Κυρία Μαρία Παππά"),
    (106, "ssn 123-45-6789. plain text stays, 2024-01-02 too, and 3.14"),
    (107, "jane.doe9@mail7.example.com, jane.doe9@mail7.example.comjane.doe9@mail7.example.com"),
]


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_replacements(spark):
    got = texts(pii.replace_entities(documents(spark, ROWS), KEY))
    a = re.fullmatch(r"Write to (\S+) or (\S+)!! now", got[100])
    assert a[1].lower() == a[2].lower() and a[2] == a[2].upper() and re.fullmatch(r"[a-z]{4}\.[a-z]{3}[0-9]@mail[0-9]\.example\.com", a[1])
    assert a[1] != "jane.doe9@mail7.example.com" and got[107].startswith(a[1] + ",")
    b = re.fullmatch(r"call (\+1 \(\d{3}\) \d{3}-\d{4}), or (\+1 \(\d{3}\) \d{7})\.", got[101])
    assert re.sub(r"\D", "", b[1]) == re.sub(r"\D", "", b[2]) != "19885552485"
    c = re.fullmatch(r"card (4\d{15}) and (4\d{3}-\d{4}-\d{4}-\d{4}), not 4041894974608796 nor 1234567", got[102])
    assert c[1] == c[2].replace("-", "") != CARD and luhn(c[1])
    d = re.fullmatch(r"host (\d+\.\d+\.\d+\.\d+)!! not 1\.2\.3\.4\.5 nor 999\.1\.1\.1 nor v1\.2\.3\.4x", got[103])
    assert d[1] != "42.144.35.254" and all(1 <= int(x) <= 254 for x in d[1].split("."))
    e = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+) and Mr\. (\w+) (\w+); Frau (\w+) left", got[104])
    female, male = (pii.GIVEN[g, "latin"].split() for g in "fm")
    assert e[1] in female and e[4] in male and e[2] == e[3] == e[5] != e[6] and "Smith" not in got[104]
    f = re.fullmatch(r"Господин (\w+) (\w+) и Κυρία (\w+) (\w+)", got[105])
    assert f[1] in pii.GIVEN["m", "cyrillic"].split() and f[3] in pii.GIVEN["f", "greek"].split()
    g = re.fullmatch(r"ssn (\d{3}-\d{2}-\d{4})\. plain text stays, 2024-01-02 too, and 3\.14", got[106])
    assert g[1] != "123-45-6789"


def test_distinct_and_repeatable(spark):
    rows = [(i, f"ip 10.0.{i // 250}.{i % 250} mail a{i}@x.org tel +49 30 {1000 + i} {2000 + i}") for i in range(1500)]
    docs = documents(spark, rows)
    one, two = texts(pii.replace_entities(docs, KEY)), texts(pii.replace_entities(docs.repartition(7), KEY))
    assert one == two
    for k in (1, 3):
        made = [t.split()[k] for t in one.values()]
        assert len(set(made)) == 1500 and not set(made) & {t.split()[k] for _, t in rows}


def test_collisions_are_drawn_again(spark, monkeypatch):
    # few forms: one-letter local parts at reserved hosts
    rows = [(i, f"{chr(97 + i)}@example.com") for i in range(12)]
    got = texts(pii.replace_entities(documents(spark, rows), KEY))
    assert len(set(got.values())) == 12 and not set(got.values()) & {t for _, t in rows}


def test_country_codes_stay(spark):
    rows = [(1, "+44 20 7946 0958"), (2, "+442079460958"), (3, "+1 212 555 0123"), (4, "+353 1 496 0000"), (5, "+12345"), (6, "+7 495 123 4567")]
    got = texts(pii.replace_entities(documents(spark, rows), KEY))
    assert got[1].startswith("+44 ") and got[1].replace(" ", "") == got[2] != "+442079460958"
    assert got[3].startswith("+1 ") and got[4].startswith("+353 ") and got[6].startswith("+7 ")
    assert got[5].startswith("+1") and got[5] != "+12345"
    assert all(re.sub(r"\d", "0", t) == re.sub(r"\d", "0", got[i]) for i, t in rows)


def test_distinct_where_forms_run_out(spark, monkeypatch):
    monkeypatch.setattr(pii, "MAX_ATTEMPTS", 1)
    rows = [(i, f"+49 {100 + i // 100} {i % 100:02d}") for i in range(600)] + [(1000 + i, f"{100 + i}-{i % 90 + 10}-1234") for i in range(400)]
    got = texts(pii.replace_entities(documents(spark, rows), KEY))
    assert len(set(got.values())) == 1000 and not set(got.values()) & {t for _, t in rows}


def test_names_without_their_title(spark):
    rows = [(1, "Mr. John Smith and John Smith; Johnny Smithson too. Dr. Eva Lang, says Eva Lang"), (2, "John Smith alone"), (3, "Dr. Eva Lang")]
    got = texts(pii.replace_entities(documents(spark, rows), KEY))
    m = re.fullmatch(r"Mr\. (\w+ \w+) and (\w+ \w+); Johnny Smithson too\. Dr\. (\w+ \w+), says (\w+ \w+)", got[1])
    assert m[1] == m[2] != "John Smith" and m[3] == m[4] != "Eva Lang"
    assert got[2] == "John Smith alone" and got[3] == "Dr. " + m[3]


def test_another_key_gives_other_surrogates(spark):
    one, two = (texts(pii.replace_entities(documents(spark, ROWS), k)) for k in (KEY, "another"))
    assert all(one[i] != two[i] for i, _ in ROWS)


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, ROWS[0], ROWS[0]])
    got = pii.replace_entities(docs, KEY)
    assert got.columns == docs.columns and got.count() == len(AWKWARD) + 2
    keep = got.filter("doc_id <> 100 OR doc_id IS NULL")
    assert sorted((repr(r.doc_id), repr(r.text)) for r in keep.collect()) == sorted((repr(i), repr(t)) for i, t in AWKWARD)
    n = pii.surrogate_documents(docs, KEY).groupBy("doc_id").agg(F.max("n_entities").alias("n")).filter("doc_id = 100").first().n
    assert n == 2


def test_empty(empty):  # noqa: F811
    assert pii.replace_entities(empty, KEY).count() == 0
