import hashlib

from pyspark.sql import functions as F

from tests.llm.util import AWKWARD, documents, empty  # noqa: F401
from tideline.llm import exact_dedup


def norm(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        flagged = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not flagged, hashlib.sha256(t.encode()).hexdigest()))
            flagged |= i == keep
    return out


def found(df):
    return [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()]


def test_awkward_rows(spark):
    assert sorted(found(exact_dedup.duplicate_groups(documents(spark, AWKWARD))), key=repr) == sorted(expected(AWKWARD), key=repr)


def test_weak_digest_is_settled_by_the_bytes(spark):
    rows = [(i, f"text {i % 4}") for i in range(24)] + [(90, "TEXT 1"), (91, "other 1")]
    weak = lambda c: F.substring(F.sha2(c, 256), 1, 0)  # noqa: E731  every text has the same digest
    got = found(exact_dedup.duplicate_groups(documents(spark, rows), digest=weak))
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_several_batches_of_the_stream(spark):
    rows = [(i, f"t{i % 7}") for i in range(200)]
    docs = documents(spark, rows).repartition(9)
    got = found(exact_dedup.duplicate_groups(docs, files_per_batch=2))
    assert sorted(got, key=repr) == sorted(expected(rows), key=repr)


def test_drop_keeps_columns_and_one_of_each(spark):
    docs = documents(spark, AWKWARD)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(norm(r.text) for r in got.collect()) == sorted({norm(t) for _, t in AWKWARD})


def test_empty(empty):  # noqa: F811
    assert exact_dedup.duplicate_groups(empty).count() == 0 and exact_dedup.drop_duplicates(empty).count() == 0
