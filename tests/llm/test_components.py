from tideline.llm import components as C
from tideline.llm.scratch import Scratch

CONF = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


def test_small_rounds_are_written_in_few_files(spark, monkeypatch):
    edges = [(k, k + 1) for k in range(1, 60) if k % 10] + [(200, 150), (150, 100)]
    want = {n: n - (n - 1) % 10 for n in range(1, 61)} | {100: 100, 150: 100, 200: 100}
    before = {k: spark.conf.get(k) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(edges, "u long, v long")
        for most, files in ((1 << 17, [1]), (20, [2, 3])):
            monkeypatch.setattr(C, "FILE_EDGES", most)
            got = C.components(df, Scratch(spark, "components-test"))
            assert {r.node: r.component for r in got.collect()} == want
            assert len(set(got.inputFiles())) in files
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
