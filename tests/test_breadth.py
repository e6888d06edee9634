import random
import statistics

from barline.plans import breadth


def test_the_median_by_rounds(spark, monkeypatch):
    monkeypatch.setattr(breadth, "BUCKETS", 3)
    rng = random.Random(1)
    days = {
        "odd": [rng.uniform(-5, 5) for _ in range(101)], "even": [rng.uniform(0, 1e9) for _ in range(100)], "ties": [2.0] * 30 + [3.0] * 31, "one": [7.0], "two": [1.0, 4.0],
        "wide": [-1e308, 1e308, 0.0, 1e-300, 5.0, -1e-300], "near": [1.0 + k * 2.0**-52 for k in range(9)],
    }
    rows = [(day, x) for day, xs in days.items() for x in xs] + [("odd", None), ("odd", float("nan")), ("none", None)]
    rng.shuffle(rows)
    found = breadth.median_by_date(spark.createDataFrame(rows, "trade_date string, close double").repartition(3), "close")
    assert {r["trade_date"]: r["median"] for r in found.collect()} == {day: statistics.median(xs) for day, xs in days.items()}
