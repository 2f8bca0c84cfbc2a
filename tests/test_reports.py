import random

from pyspark.sql import functions as F

from netshield.operators.rollups import traffic
from netshield.session import names_in, work_dir
from netshield.streaming.reports import StandingReport

SCHEMA = "ts long, country string, city string, status int, bytes_sent long"


def requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))


def shown(report):
    columns = ("win", "country", "city", "requests", "errors", "bytes", "level")
    return sorted((tuple(str(r[c]) for c in columns) for r in report.collect()))


def drawn(rng, n):
    return [(None if rng.random() < 0.02 else rng.randint(0, 600), rng.choice(["NA", "X", None]), rng.choice(["a", None]),
             rng.choice([200, 404, None]), rng.choice([None, 0, 10**18])) for _ in range(n)]


def test_report_of_batches_equals_the_report_of_all(spark):
    """Batches bring late rows, a batch is repeated, one is empty; folders are merged small ones first."""
    rng = random.Random(5)
    report = StandingReport(work_dir(spark, "test"), merge_above=2, versions=2)
    rows = []
    for k, n in enumerate((40, 5, 0, 30, 3, 2)):
        batch = drawn(rng, n)
        rows += batch
        for _ in range(1 + (k == 3)):
            report.handle(requests(spark, batch), k)
        assert len(report.cells.entries(spark, k)) <= 2
    assert shown(report.report(spark)) == shown(traffic(requests(spark, rows)))
    named = {e["folder"] for v in (4, 5) for e in report.cells.entries(spark, v)}
    assert set(names_in(spark, f"{report.cells.path}/data")) == named


def test_large_folders_are_left_while_small_ones_merge(spark):
    report = StandingReport(work_dir(spark, "test"), merge_above=2)
    report.handle(requests(spark, [(60 * k, "X", "a", 200, 1) for k in range(50)]), 0)
    for k in range(1, 4):
        report.handle(requests(spark, [(0, "X", "a", 500, k)]), k)
    assert "0-added" in {e["folder"] for e in report.cells.entries(spark, 3)}
    first = report.report(spark).where("level = 0 AND unix_micros(win) = 0").first()
    assert (first["requests"], first["errors"], int(first["bytes"])) == (4, 3, 7)


def test_no_batch(spark):
    assert StandingReport(work_dir(spark, "test")).report(spark).where("level = 0").count() == 0
