import datetime

import pytest
from pyspark.sql import functions as F

from barline.operators.catalog import Catalog
from barline.operators.predicates import predicate
from barline.plans import adjust, sync
from barline.schema import TABLES, MarketError, TableError, keys_of

DAY = datetime.date(2024, 1, 1)


@pytest.fixture
def market(spark):
    with Catalog(spark, "market_test") as catalog:
        catalog.truncate_all(confirm=True)
        yield catalog


def bars(spark, *rows):
    return spark.createDataFrame([(c, DAY + datetime.timedelta(d), p, p, p, p, 1.0, p) for c, d, p in rows], TABLES["stock_daily"])


def closes(catalog, **kw):
    return sorted((r["code"], r["trade_date"].day, r["close"]) for r in catalog.select("stock_daily", **kw).collect())


def test_insert_passes_over_known_keys_and_repeats(spark, market):
    assert market.insert("stock_daily", bars(spark, ("a", 0, 1.0), ("a", 1, 2.0))) == {"inserted": 2, "ignored": 0}
    assert market.insert("stock_daily", bars(spark, ("a", 1, 9.0), ("b", 0, 5.0), ("b", 0, 5.0))) == {"inserted": 1, "ignored": 2}
    assert closes(market) == [("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 5.0)]


def test_columns_are_matched_by_name(spark, market):
    rows = bars(spark, ("a", 0, 1.0)).select("close", "trade_date", "code", "open", "high", "low", "amount", "volume")
    market.insert("stock_daily", rows)
    assert market.read("stock_daily").columns == TABLES["stock_daily"].names and closes(market) == [("a", 1, 1.0)]


def test_update_overwrites_with_nulls(spark, market):
    market.insert("stock_daily", bars(spark, ("a", 0, 1.0), ("b", 0, 2.0)))
    change = bars(spark, ("a", 0, 7.0), ("z", 0, 7.0)).withColumn("high", F.lit(None).cast("double"))
    assert market.update("stock_daily", change) == 1
    assert market.select("stock_daily", [("code", "=", "a")], ["close", "high"]).first()[:] == (7.0, None)
    assert closes(market)[1] == ("b", 1, 2.0)


def test_delete_needs_a_true_condition(spark, market):
    market.insert("stock_daily", bars(spark, ("a", 0, 1.0), ("b", 0, 2.0), ("c", 0, None)))
    assert market.delete("stock_daily", [("close", "<", 1.5)]) == 1
    assert [c for c, _, _ in closes_or_null(market)] == ["b", "c"]


def closes_or_null(catalog):
    return sorted((r["code"], r["trade_date"].day, str(r["close"])) for r in catalog.read("stock_daily").collect())


def test_replace_aggregate_truncate_and_sql(spark, market):
    market.insert("stock_daily", bars(spark, ("a", 0, 1.0)))
    assert market.insert("stock_daily", bars(spark, ("b", 0, 3.0), ("b", 1, 5.0)), "replace") == {"inserted": 2, "ignored": 0}
    assert market.aggregate("stock_daily", {"n": "count(1)", "top": "max(close)"}, [("close", ">", 1.0)]).first()[:] == (2, 5.0)
    assert market.aggregate("stock_daily", {"n": "count(1)"}, by=["code"]).collect()[0][:] == ("b", 2)
    assert market.sql("select * from market_test.stock_daily where close > :least", {"least": 4.0}, like="stock_daily").count() == 1
    assert market.sql("drop view if exists nothing_here") is None
    market.truncate("stock_daily")
    assert market.read("stock_daily").count() == 0
    with pytest.raises(ValueError):
        market.truncate_all()
    assert market.truncate_all(confirm=True) == {"tables_cleared": 7}


def test_vacuum_removes_what_is_not_in_use(spark, market):
    market.insert("stock_daily", bars(spark, ("a", 0, 1.0)), "replace")
    market.truncate("stock_daily")
    market.insert("stock_daily", bars(spark, ("a", 0, 1.0), ("a", 1, 2.0)))
    assert market.vacuum() > 0 and market.vacuum() == 0
    assert market.read("stock_daily").count() == 2
    assert market.insert("stock_daily", bars(spark, ("a", 0, 1.0))) == {"inserted": 0, "ignored": 1}
    assert market.insert("stock_daily", bars(spark).limit(0)) == {"inserted": 0, "ignored": 0}


def test_views_can_be_selected(spark, market):
    market.insert("stock_daily", bars(spark, ("a", 0, 1.0), ("b", 0, 2.0)))
    market.insert("stock_list", spark.createDataFrame([("a", "A")], TABLES["stock_list"]))
    market.insert("capital_daily", spark.createDataFrame([("a", DAY, 5.0, 3.0)], TABLES["capital_daily"]))
    market.view("stock_view", lambda c: adjust.stock_view(c.read("stock_daily"), c.read("stock_list"), c.read("capital_daily")))
    assert [r["name"] for r in market.select("stock_view", [("close", ">", 0.0)]).collect()] == ["A"]


def test_unknown_names(market):
    with pytest.raises(TableError, match=r"\[501\]"):
        market.read("nothing")
    assert "[500] x" in str(MarketError("x"))


def test_operators(spark):
    df = spark.createDataFrame([("ab", 1), ("b", 2), (None, 3)], "s string, n int")

    def numbers(*filters):
        return sorted(r["n"] for r in df.where(predicate(filters)).collect())

    assert numbers() == [1, 2, 3]
    assert numbers(("s", "like", "a%")) == [1] and numbers(("s", "not like", "a%")) == [2]
    assert numbers(("n", "in", (1, 3)), ("n", ">", 1)) == [3] and numbers(("n", "not in", (1, 3))) == [2]
    assert numbers(("s", "is null", None)) == [3] and numbers(("s", "IS NOT NULL", None), ("n", "<>", 1)) == [2]
    assert numbers(("s", "=", "b' or 1=1 --")) == []
    with pytest.raises(ValueError):
        predicate([("n", "; drop", 1)])


def test_sync_takes_each_code_from_its_latest_day(spark, market):
    market.insert("stock_list", spark.createDataFrame([("a", "A"), ("b", "B")], TABLES["stock_list"]))
    market.insert("stock_daily", bars(spark, ("a", 1, 1.0)))
    landed = bars(spark, ("a", 0, 9.0), ("a", 1, 9.0), ("a", 2, 3.0), ("b", 0, 4.0), ("x", 0, 5.0))
    assert sync.sync(market, "stock_daily", landed) == {"inserted": 2, "ignored": 1}
    assert closes(market) == [("a", 2, 1.0), ("a", 3, 3.0), ("b", 1, 4.0)]
    assert sync.sync_all(market, {"stock_daily": landed, "trade_date": landed.select("trade_date").distinct()}) == {"trade_date": {"inserted": 3, "ignored": 0}, "stock_daily": {"inserted": 0, "ignored": 2}}


def test_schemas():
    assert len(TABLES) == 7 and keys_of(TABLES["stock_daily"]) == ["code", "trade_date"] and keys_of(TABLES["trade_date"]) == ["trade_date"]


def test_settings(tmp_path, monkeypatch):
    from barline.session import Settings

    path = tmp_path / "settings.yaml"
    path.write_text("shuffle_partitions: 8  # few\nadaptive: no\n")
    monkeypatch.setenv("BARLINE_SHUFFLE_PARTITIONS", "16")
    assert Settings.from_sources(str(path)).shuffle_partitions == 16 and not Settings.from_sources(str(path)).adaptive
    assert Settings.from_sources(str(path), shuffle_partitions=32).shuffle_partitions == 32
    with pytest.raises(ValueError):
        Settings.from_sources(nothing=1)
