import datetime

import pytest
from pyspark.sql import functions as F

from barline.functions import codes, dates
from barline.plans import adjust
from barline.sources import landing


def one(spark, make, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "suffix"),
    [("600000", "600000.SH"), ("000001", "000001.SZ"), ("300001", "300001.SZ"), ("600000.SH", "600000.SH"), ("SZ000001", "000001.SZ"), (" sh . 600000 ", "600000.SH"), ("BJ920001", "920001.BJ"), ("123456", "123456.UNKNOWN"), ("SH600000SZ", "600000.SZ"), ("US123456", "123456.UNKNOWN"), ("12345", "12345.UNKNOWN"), ("abc", None), (None, None), ("", None)],
)
def test_stock_codes(spark, raw, suffix):
    assert one(spark, lambda c: codes.normalize_stock_code(c, "suffix"), raw) == suffix


def test_forms_and_errors(spark):
    assert one(spark, codes.normalize_stock_code, "000001.SZ") == "000001"
    assert one(spark, lambda c: codes.normalize_index_code(c, "prefix_dot"), "000001") == "SH.000001"
    assert one(spark, lambda c: codes.normalize_index_code(c, "prefix"), "399001") == "SZ399001"
    every = one(spark, lambda c: codes.normalize_stock_code(c, None), "600000")
    assert every.asDict() == {"pure_code": "600000", "suffix": "600000.SH", "prefix_dot": "SH.600000", "prefix": "SH600000", "error": None}
    assert "null" in one(spark, lambda c: codes.normalize_stock_code(c, None), None)["error"]
    assert one(spark, codes.normalize_stock_code, 600000, "long") == "600000"


def test_kinds(spark):
    assert one(spark, codes.is_stock, "600000") and not one(spark, codes.is_stock, "510050")
    assert one(spark, codes.is_etf, "510050") and one(spark, codes.is_etf, "159901") and not one(spark, codes.is_etf, "600000")
    assert one(spark, codes.is_index, "000001") and one(spark, codes.is_index, "399001") and not one(spark, codes.is_index, "600000")
    assert one(spark, codes.is_stock, None) is False and one(spark, codes.is_index, "invalid") is False


@pytest.mark.parametrize(
    ("raw", "form", "want"),
    [("20200101", "hyphen", "2020-01-01"), ("2020-1-1 12:34", "chinese_datetime", "2020年01月01日 12时34分00秒"), ("2020/01/01 12:34:56", "slash_datetime", "2020/01/01 12:34:56"), ("2020.1.9", "pure_num", "20200109"), ("2020-02-30", "hyphen", None), ("2020-13-01", "hyphen", None), ("soon", "hyphen", None), ("2024-01-01", "dot", "2024.01.01"), ("2024-02-29", "chinese", "2024年02月29日"), ("2024-01-01 25:00", "hyphen", None)],
)
def test_dates(spark, raw, form, want):
    assert one(spark, lambda c: dates.normalize_trade_date(c, form), raw) == want


def test_date_types_and_today(spark):
    assert one(spark, lambda c: dates.normalize_trade_date(c, "date_class"), "20240105") == datetime.date(2024, 1, 5)
    assert one(spark, lambda c: dates.normalize_trade_date(c, "datetime_class"), "20240105 10:00") == datetime.datetime(2024, 1, 5, 10)
    now = datetime.datetime.now(datetime.timezone(datetime.timedelta(hours=8))).date()
    assert one(spark, lambda c: dates.normalize_trade_date(c, "date_class"), None) in (now, now + datetime.timedelta(1))
    every = one(spark, lambda c: dates.normalize_trade_date(c, None), "x")
    assert every["hyphen"] is None and "x" in every["error"]


def test_landing(spark):
    raw = spark.createDataFrame([("sh600000", "20240105", "10", "", "12", "-", None, "5"), ("000001", "2024-01-05", "", "", "", "", "", ""), ("300001", "2024/1/5", "0", "1", "1", "1", "1", "1")], "code string, date string, close string, open string, high string, low string, volume string, amount string")
    assert [r[:] for r in landing.daily_bars(raw).collect()] == [("600000", datetime.date(2024, 1, 5), 10.0, 12.0, 10.0, 10.0, 0.0, 5.0)]
    names = landing.securities(spark.createDataFrame([("000001.SH", " X "), ("bad", "Y")], "code string, name string"), index=True)
    assert [r[:] for r in names.collect()] == [("000001", "X")]
    actions = landing.dividends(spark.createDataFrame([("600000", "20240105", 1, "5", "1", "", None)], "code string, date string, Type int, Bonus string, ShareBonus string, Allotment string, AllotPrice string"))
    assert actions.first()[2:] == ("1", 5.0, 1.0, None, None)
    shares = landing.capital(spark.createDataFrame([("600000", "20240105", 7.0, 5.0)], "code string, date string, Zgb double, Ltgb double"))
    assert shares.first()[1:] == (datetime.date(2024, 1, 5), 7.0, 5.0)
    assert landing.trade_dates(raw).count() == 1


def test_vendors_spell_requests_their_way(spark):
    terminal, archive = landing.VENDORS["terminal"], landing.VENDORS["archive"]
    assert [terminal.period(p) for p in ("5m", "day", "quar")] == ["5m", "1d", "1q"] and [archive.period(p) for p in ("5m", "1h", "month")] == ["5", "60", "m"]
    assert (terminal.adjustment("front"), archive.adjustment("front"), archive.adjustment("none")) == ("front", "2", "3")
    for wrong in (lambda: archive.period("1m"), lambda: terminal.period("hour"), lambda: terminal.adjustment("both"), lambda: archive.clean("stock_dividend", None)):
        with pytest.raises(ValueError, match="the vendor has no"):
            wrong()
    assert one(spark, terminal.code, "sh600000") == "600000.SH" and one(spark, archive.code, "600000") == "sh.600000" and one(spark, archive.code, "x") is None
    assert one(spark, lambda c: terminal.code(c, index=True), "000001") == "000001.SH"
    assert one(spark, terminal.date, "2024/1/5") == "20240105" and one(spark, archive.date, "20240105") == "2024-01-05"


def test_archive_bars_have_all_fields(spark):
    names = ["date", "code", *landing.ARCHIVE_FIELDS]
    raw = spark.createDataFrame([("2024-01-05", "sh.600000", *map(str, range(len(names) - 3)), ""), ("2024-01-05", "sh.x", *["1"] * (len(names) - 2))], ", ".join(f"{n} string" for n in names))
    rows = landing.VENDORS["archive"].clean("stock_daily", raw).collect()
    assert len(names) == 16 and [r[:] for r in rows] == [("600000", datetime.date(2024, 1, 5), *map(float, range(len(names) - 3)), None)]


@pytest.mark.parametrize(("raw", "want"), [("SH.600000", "600000.SH"), ("600000 . sz", "600000.SZ"), (".600000", "600000.SH"), ("SH..600000", None), ("S H600000", None), ("60 0000", None), ("SHX600000", None), ("600000.SH1", None), ("\t600000\n", "600000.SH"), ("1234567", None), ("1234", None)])
def test_what_may_stand_around_the_digits(spark, raw, want):
    assert one(spark, lambda c: codes.normalize_stock_code(c, "suffix"), raw) == want


@pytest.mark.parametrize(("raw", "want"), [("2024 1 5", "2024-01-05 00:00:00"), ("202415", "2024-01-05 00:00:00"), ("20240105 9", "2024-01-05 09:00:00"), ("20240105 0930", "2024-01-05 09:30:00"), ("20240105 093015", "2024-01-05 09:30:15"), ("20240105 9:5:7", "2024-01-05 09:05:07"), ("20240105T9", None), ("20240105 9:60", None), ("2024010", None), ("20240105 1234567", None), ("  2024.01.05  ", "2024-01-05 00:00:00")])
def test_spellings_of_days_and_times(spark, raw, want):
    assert one(spark, lambda c: dates.normalize_trade_date(c, "hyphen_datetime"), raw) == want


def prices(spark, closes):
    return spark.createDataFrame([("a", datetime.date(2024, 1, 1 + i), c, c) for i, c in enumerate(closes)], "code string, trade_date date, open double, close double")


def actions(spark, *rows):
    return spark.createDataFrame([("a", datetime.date(2024, 1, d), *x) for d, *x in rows], "code string, trade_date date, dividend double, bonus_ratio double, rights_ratio double, rights_price double")


def test_factors(spark):
    daily, paid = prices(spark, [10.0, 10.0, 9.0]), actions(spark, (3, 10.0, 0.0, 0.0, 0.0))
    rows = adjust.dividend_view(daily, paid).orderBy("trade_date").collect()
    assert [r["pre_close"] for r in rows] == [None, 10.0, 10.0]
    assert [r["qfq_factor"] for r in rows] == pytest.approx([0.9, 0.9, 1.0])
    assert [r[0] for r in adjust.forward_factors(daily, paid).orderBy("trade_date").select("forward_factor").collect()] == pytest.approx([0.9, 0.9, 1.0])


def test_factors_without_actions_and_on_the_first_day(spark):
    daily = prices(spark, [10.0, 11.0])
    assert [r["qfq_factor"] for r in adjust.dividend_view(daily, actions(spark)).collect()] == [1.0, 1.0]
    first = actions(spark, (1, 10.0, 0.0, 0.0, 0.0))
    assert adjust.dividend_view(daily, first).orderBy("trade_date").first()["adjust_ratio"] == pytest.approx(0.9)
    assert [r["forward_factor"] for r in adjust.forward_factors(daily, first).collect()] == [1.0, 1.0]

