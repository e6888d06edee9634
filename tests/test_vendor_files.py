import csv

import pytest
from pyspark.sql import functions as F

from barline.sources import vendor_files
from barline.sources.vendor_files import landed

DAYS = ("20240102", "20240103", "20240104", "20240105")
CODES = ("600000.SH", "000001.SZ", "300001.SZ")


def land(folder, kind, day, name, rows):
    path = folder / kind / day / f"{name}.csv"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", newline="") as file:
        writer = csv.DictWriter(file, list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)


def bar(day, close, **more):
    return {"date": day, "open": "1", "high": "", "low": "0.5", "close": close, "volume": "", "amount": "7"} | more


@pytest.fixture
def folder(tmp_path):
    for i, day in enumerate(DAYS):
        for code in CODES:
            land(tmp_path, "stock_daily", day, code, [bar(day, str(i + 1)), bar(day, "0")])
    (tmp_path / "stock_daily" / DAYS[0] / "broken.txt").write_text("no file of ours")
    return tmp_path


def test_batch_of_a_vendor(spark, folder):
    rows = landed(spark, str(folder), "terminal", "stock_daily").collect()
    assert len(rows) == 12 and {r["code"] for r in rows} == {"600000", "000001", "300001"}
    assert {(str(r["trade_date"]), r["close"], r["high"], r["volume"], r["amount"]) for r in rows} == {(f"2024-01-0{i + 2}", i + 1.0, i + 1.0, 0.0, 7.0) for i in range(4)}
    assert landed(spark, str(folder), "terminal", "stock_dividend").count() == 0
    with pytest.raises(Exception, match="has no stock_dividend"):
        landed(spark, str(folder), "archive", "stock_dividend").count()


def test_filters_prune_files(spark, folder):
    for name in ("000001.SZ", "300001.SZ"):  # unreadable, so that opening them fails
        (folder / "stock_daily" / DAYS[0] / f"{name}.csv").write_bytes(b"code,date\n\xff\xfe,\xff\n")
    for day in DAYS[2:]:
        (folder / "stock_daily" / day / "600000.SH.csv").write_bytes(b"\xff\xff")
    found = landed(spark, str(folder), "terminal", "stock_daily", (DAYS[0], DAYS[1]), ["600000.SH"])
    assert sorted(str(r["trade_date"]) for r in found.collect()) == ["2024-01-02", "2024-01-03"]
    with pytest.raises(Exception, match="codec can't decode"):
        landed(spark, str(folder), "terminal", "stock_daily").collect()


def test_only_files_that_can_match_are_partitions():
    reader = vendor_files._Files("unused", ["code", "day"], many=False)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, StringContains

    given = [In(("code",), ("a", "b")), GreaterThan(("day",), "20240103"), StringContains(("code",), "a"), IsNotNull(("code",)), EqualTo(("close",), "1")]
    assert list(reader.pushFilters(given)) == given[2:]
    files = [(day, code) for day in DAYS for code in "abc"]
    assert [f for f in files if vendor_files._may_match(reader.filters, *f, False)] == [(day, code) for day in DAYS[2:] for code in "ab"]
    assert [f for f in files if vendor_files._may_match(reader.filters, *f, True)] == [(day, code) for day in DAYS[2:] for code in "abc"]
    assert [len(p.files) for p in vendor_files._partitions([("d", str(i), "p", 3 << 20) for i in range(5)])] == [2, 2, 1]


def test_files_of_many_codes(spark, tmp_path):
    land(tmp_path, "stock_daily", DAYS[0], "all", [{"code": "sh.600000", **bar(DAYS[0], "2")}, {"code": "sz.000001", **bar(DAYS[0], "3")}])
    found = landed(spark, str(tmp_path), "archive", "stock_daily", codes=["sz.000001"], many=True).collect()
    assert [(r["code"], r["close"], r["turnover"]) for r in found] == [("000001", 3.0, None)]


def test_a_stream_takes_each_file_once_and_goes_on(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")

    def run():
        stream = landed(spark, str(folder), "terminal", "stock_daily", stream=True)
        writer = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "checkpoint"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(out / "rows")).groupBy("trade_date").agg(F.count("*").alias("n")).orderBy("trade_date").collect()

    assert [r["n"] for r in run()] == [3, 3, 3, 3]
    land(folder, "stock_daily", "20240108", "600000.SH", [bar("20240108", "9")])
    land(folder, "stock_daily", DAYS[0], "zzz", [{"code": "600000.SH", **bar(DAYS[0], "9")}])  # behind the offset
    assert [(str(r["trade_date"]), r["n"]) for r in run()][-1] == ("2024-01-08", 1)
    assert [r["n"] for r in run()] == [3, 3, 3, 3, 1]


def test_a_command_syncs_and_a_chart_reads(spark, folder, capsys):
    from barline.__main__ import main
    from barline.operators.catalog import Catalog
    from barline.plans.kline import chart, kline
    from barline.plans.adjust import adjusted_view

    land(folder, "stock_list", DAYS[0], "all", [{"code": c, "name": f"n{c[0]}"} for c in CODES])
    for i, day in enumerate(DAYS):
        for code in CODES:
            land(folder, "capital_daily", day, code, [{"date": day, "Zgb": "1000", "Ltgb": "600"}])
    database = ["--database", "market_command"]
    with Catalog(spark, "market_command") as market:
        market.truncate_all(confirm=True)
    first = main(["sync", str(folder), "--days", DAYS[0], DAYS[2], *database], spark)
    assert first["stock_list"] == {"inserted": 3, "ignored": 0} and first["stock_daily"] == {"inserted": 9, "ignored": 0} and first["stock_dividend"]["inserted"] == 0
    again = main(["sync", str(folder), "--kinds", "stock_daily", "capital_daily", *database], spark)
    assert again["stock_daily"]["inserted"] == 3 and set(again) == {"stock_daily", "capital_daily"} and '"inserted": 3' in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["sync", str(folder), "--vendor", "archive", "--kinds", "stock_dividend", *database], spark)
    with Catalog(spark, "market_command") as market:
        shown = chart(market, "sh600000", "2024-01-03", "2024-01-04").collect()
        assert [(r["code"], r["trade_date"], r["pct_chg"]) for r in shown] == [("600000", "2024-01-03", 100.0), ("600000", "2024-01-04", 50.0)]
        whole = kline(adjusted_view(*(market.read(t) for t in ("stock_daily", "stock_list", "capital_daily", "stock_dividend"))))
        assert sorted(map(str, chart(market, ["600000", "000001.SZ", "300001", "x"]).collect())) == sorted(map(str, whole.collect())) and chart(market, "688999").count() == 0
