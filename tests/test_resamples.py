"""The interval queries draw as often as the operator's rule says."""

import duckdb
import numpy as np
import pytest

from corpusloom.operators import statistics
from corpusloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bootstrap_intervals", "paired_differences"])
def test_queries_draw_the_fixed_resamples(spark, monkeypatch, name):
    asked = []
    for f in ("intervals", "differences"):
        monkeypatch.setattr(statistics, f, lambda *a, resamples=statistics.RESAMPLES, **k: asked.append(resamples))
    catalogue.QUERIES[name](spark, SMALL)
    assert asked == [2000]


def test_congruential_draws_of_a_group_whose_places_pass_32_bits(spark, monkeypatch):
    n, draws = 30_000, 3
    monkeypatch.setattr(statistics, "SLOTS", 7_000)
    rows = spark.range(n).selectExpr("'x' AS lang", "id AS pos", "double(id) AS nll", "id + 1 AS chars")
    got = {r["draw"]: (r["nll"], r["chars"]) for r in statistics.congruential_draws(rows, ["lang"], draws).collect()}
    places = [[(7919 * d + 104729 * s + d * s) % n for s in range(n)] for d in range(draws)]
    assert got == {d: (float(sum(p)), sum(p) + n) for d, p in enumerate(places)}


def test_drawn_slots_are_never_broadcast(spark):
    """Exploded slots look as small to Spark as the few rows that they are made of."""
    rows = spark.range(3_000).selectExpr("'x' AS lang", "id AS pos", "double(id) AS nll", "id + 1 AS chars").repartition(3)
    sums = statistics.congruential_draws(rows, ["lang"], 4)
    assert [r["chars"] for r in sums.collect()] and "Broadcast" not in sums._jdf.queryExecution().executedPlan().toString()


def test_bootstrap_draws_where_ids_and_languages_are_missing(spark, tmp_path):
    rows = [(None if i == 7 else i * 37 % 100, None if i % 11 == 0 else "ab"[i % 3 == 0], "s", "x " * (1 + i % 5), 3 + i * i % 41) for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["bootstrap_draws"](spark, str(tmp_path)).collect()
    want = con.sql(f"SELECT lang, draw, bpc FROM ({catalogue.ORACLE_SQL['bootstrap_draws']})").fetchall()
    assert len(want) == 40 and sorted((r["lang"], r["draw"], r["bpc"]) for r in got) == sorted(want)


def test_draws_in_parts_are_the_same(monkeypatch):
    rng = np.random.default_rng(1)
    nll, chars = rng.random((2, 30)), rng.integers(1, 50, (2, 30))
    whole = statistics.bootstrap(nll, chars), statistics.bootstrap(nll[0], chars[0])
    monkeypatch.setattr(statistics, "HELD", 100)
    assert [p.size for p in statistics.draws_in_parts(1, 30, 7)] == [90, 90, 30]
    assert (statistics.bootstrap(nll, chars), statistics.bootstrap(nll[0], chars[0])) == whole
