import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators.joins import join_per_stock, lookup_symbol, symbol_maps
from tickloom.session import scratch_path
from tickloom.sinks import tables as sink, versions
from tickloom.sources import payloads, tables as src
from tickloom.sources.jdbc import jdbc_options

DAY = dt.date(2024, 1, 1)
AT = dt.datetime(2024, 2, 1, 12)
PRICES = ("stock_id int, trade_date date, open_price double, high_price double, "
          "low_price double, close_price double, volume bigint, seq bigint")


def price(stock_id, day, close, volume=1, seq=0):
    return (stock_id, day, 1.0, 2.0, 0.5, close, volume, seq)


def test_candles(spark, tmp_path):
    full = {"s": "ok", "t": [1704153600, 1704240000], "o": [1, 2], "h": [3, 4], "l": [0.5, 1],
            "c": [2, 3], "v": [10, 20]}
    lines = [("A", full), ("B", {"s": "no_data"}), ("C", {**full, "t": []})]
    landed = tmp_path / "landed.json"
    landed.write_text("\n".join(
        json.dumps({"symbol": s, "payload": json.dumps(p)}) for s, p in lines))
    rows = payloads.parse_candles(payloads.read_payloads(spark, str(landed))).collect()
    assert sorted((r.symbol, r.date, r.close, r.volume) for r in rows) == [
        ("A", dt.date(2024, 1, 2), 2.0, 10.0), ("A", dt.date(2024, 1, 3), 3.0, 20.0)]


def test_quotes(spark):
    landed = [("A", '{"o": null, "c": 1}'), ("B", '{"o": 0, "c": 1}'),
              ("C", '{"o": 5, "h": 6, "l": 4, "c": 5.5, "pc": 5, "t": 7}')]
    rows = payloads.parse_quotes(
        spark.createDataFrame(landed, "symbol string, payload string")).collect()
    assert [(r.symbol, r.open, r.volume, r.timestamp) for r in rows] == [("C", 5.0, None, 7)]


@pytest.mark.parametrize("fmt", ("csv", "json", "parquet", "orc"))
def test_history_files(spark, fmt):
    path = scratch_path(spark, "history")
    spark.createDataFrame(
        [("A", "2024-01-02 00:00:00-05:00", 1.0, 2.0, 0.5, 1.5, 10)],
        schemas.HISTORY_FILE).write.format(fmt).option("header", True).save(path)
    assert [tuple(r) for r in payloads.read_history(spark, path, fmt).collect()] == [
        ("A", dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 10)]


def test_first_source_supplies_all_rows(spark):
    schema = "symbol string, x int"
    one = spark.createDataFrame([("A", 1), ("A", 2)], schema)
    two = spark.createDataFrame([("A", 3), ("B", 4)], schema)
    assert sorted(tuple(r) for r in payloads.resolve_sources(one, two).collect()) == [
        ("A", 1), ("A", 2), ("B", 4)]


def test_table_filters(spark):
    prices = spark.createDataFrame(
        [price(s, DAY + dt.timedelta(days=d), float(d)) for s in (0, 1) for d in range(10)],
        PRICES)
    as_of = DAY + dt.timedelta(days=9)
    assert src.load_prices(prices, stock_id=0).count() == 10
    assert src.load_prices(prices, days=3, as_of=as_of).count() == 8
    assert src.load_prices(prices, days=1).count() == 0
    assert src.backfill_window(prices, as_of, 4).count() == 10
    latest = src.latest_bar(prices, DAY + dt.timedelta(days=11)).collect()
    assert sorted((r.stock_id, r.close_price) for r in latest) == [(0, 9.0), (1, 9.0)]
    assert src.latest_bar(prices, DAY + dt.timedelta(days=20)).count() == 0
    wanted = src.target_universe(spark)
    assert wanted.count() == 7
    bars = spark.createDataFrame([("AAPL", 1), ("XYZ", 2)], "symbol string, x int")
    assert [r.company_name for r in src.restrict_to_universe(bars, wanted).collect()] == [
        "Apple Inc."]


def test_jdbc_options():
    plain = jdbc_options("db", "market", "stocks", "u", "p")
    assert plain["url"] == "jdbc:postgresql://db:5432/market" and plain["sslmode"] == "require"
    assert "numPartitions" not in plain
    split = jdbc_options("db", "market", "raw_stock_prices", "u", "p", stock_id_range=(1, 9),
                         partitions=4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"],
            split["numPartitions"]) == ("stock_id", "1", "10", "4")


def test_new_symbols_get_the_next_ids(spark):
    stocks = spark.createDataFrame([(1, "B", "old name")], schemas.STOCKS)
    wanted = spark.createDataFrame(
        [("C", "c"), ("B", "new name"), ("A", "a"), ("AB", "ab")],
        "symbol string, company_name string")
    got = sorted(tuple(r) for r in sink.ensure_stocks(stocks, wanted).collect())
    assert got == [(1, "B", "old name"), (2, "A", "a"), (3, "AB", "ab"), (4, "C", "c")]
    empty = sink.ensure_stocks(spark.createDataFrame([], schemas.STOCKS), wanted)
    assert sorted(r.stock_id for r in empty.collect()) == [1, 2, 3, 4]


def test_unique_key(spark):
    once = spark.createDataFrame([price(1, DAY, 1.0)], PRICES)
    assert sink.assert_unique_key(once) is once
    with pytest.raises(ValueError):
        sink.assert_unique_key(once.union(once))


def test_upsert_overwrites_and_touches_only_its_months(spark):
    path = scratch_path(spark, "prices")
    later = dt.date(2024, 3, 5)
    sink.upsert_prices(spark, path, spark.createDataFrame(
        [price(1, DAY, 10.0), price(1, later, 7.0)], PRICES), schemas.PRICES, AT)
    march = versions.newest(spark, path).folders["2024-03-01"]
    newer = [price(1, DAY, 11.0, seq=0), price(1, DAY, 12.0, None, seq=1),
             price(1, dt.date(2024, 1, 2), 5.0)]
    for _ in range(2):
        sink.upsert_prices(spark, path, spark.createDataFrame(newer, PRICES), schemas.PRICES, AT)
        rows = sink.read_table(spark, path, schemas.PRICES).orderBy("trade_date").collect()
        assert [(r.trade_date, r.close_price, r.volume) for r in rows] == [
            (DAY, 12.0, 0), (dt.date(2024, 1, 2), 5.0, 1), (later, 7.0, 1)]
        assert {r.created_at for r in rows} == {AT}
    assert versions.newest(spark, path).folders["2024-03-01"] == march
    bounded = sink.read_table(spark, path, schemas.PRICES, first=dt.date(2024, 1, 2),
                              last=dt.date(2024, 2, 1))
    assert [r.close_price for r in bounded.collect()] == [5.0]
    sink.upsert_prices(spark, path, spark.createDataFrame([], PRICES), schemas.PRICES, AT)
    assert sink.read_table(spark, path, schemas.PRICES).count() == 3


def test_an_interrupted_upsert_changes_nothing(spark, monkeypatch):
    path = scratch_path(spark, "prices")
    days = [DAY, dt.date(2024, 2, 5), dt.date(2024, 3, 5)]

    def put(closes):
        sink.upsert_prices(spark, path, spark.createDataFrame(
            [price(1, d, c) for d, c in zip(days, closes)], PRICES), schemas.PRICES, AT)

    def closes(rows):
        return [r.close_price for r in rows.orderBy("trade_date").collect()]

    put([1.0, 2.0, 3.0])
    reader = sink.read_table(spark, path, schemas.PRICES)
    with monkeypatch.context() as broken:
        broken.setattr(versions, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put([4.0, 5.0, 6.0])
    # All months are written by now, but none of them is published.
    assert closes(sink.read_table(spark, path, schemas.PRICES)) == [1.0, 2.0, 3.0]
    before = versions.newest(spark, path)
    for _ in range(2):
        put([4.0, 5.0, 6.0])
    assert closes(sink.read_table(spark, path, schemas.PRICES)) == [4.0, 5.0, 6.0]
    # Who began to read the old version still can.
    assert closes(reader) == [1.0, 2.0, 3.0]
    # A second writer who started from the same version does not overwrite the first.
    with pytest.raises(RuntimeError):
        versions.publish(spark, path, before, {})
    assert versions.numbers(spark, path) == [1, 2, 3]
    assert versions.expire(spark, path, keep=1) == 6 and versions.numbers(spark, path) == [3]
    assert closes(sink.read_table(spark, path, schemas.PRICES)) == [4.0, 5.0, 6.0]


def test_keys_without_order_are_refused(spark):
    path = scratch_path(spark, "prices")
    same = [price(1, DAY, 1.0), price(1, DAY, 1.0)]
    sink.upsert_prices(spark, path, spark.createDataFrame(same, PRICES), schemas.PRICES, AT)
    with pytest.raises(ValueError, match="without order"):
        sink.upsert_prices(spark, path, spark.createDataFrame(
            [price(1, DAY, 1.0), price(1, DAY, 2.0)], PRICES), schemas.PRICES, AT)
    undated = spark.createDataFrame([price(1, None, 5.0)], PRICES)
    sink.upsert_prices(spark, path, undated, schemas.PRICES, AT)
    rows = sink.read_table(spark, path, schemas.PRICES)
    assert sorted((str(r.trade_date), r.close_price) for r in rows.collect()) == [(str(DAY), 1.0), ("None", 5.0)]
    assert sink.read_table(spark, path, schemas.PRICES, first=DAY).count() == 1


def test_appending_twice(spark):
    rows = spark.createDataFrame(
        [(1, DAY, 10.0, "a"), (1, DAY, 11.0, "b"), (2, DAY, 12.0, "a")],
        "stock_id int, prediction_date date, predicted_close double, model_name string")
    plain, deduped = scratch_path(spark, "p"), scratch_path(spark, "p")
    key = ("stock_id", "prediction_date", "model_name")
    for _ in range(2):
        sink.append_rows(spark, plain, rows, schemas.PREDICTIONS, AT)
        sink.append_rows(spark, deduped, rows, schemas.PREDICTIONS, AT, dedupe_on=key)
    assert sink.read_table(spark, plain, schemas.PREDICTIONS).count() == 6
    stored = sink.read_table(spark, deduped, schemas.PREDICTIONS)
    assert stored.count() == 3 and {r.created_at for r in stored.collect()} == {AT}


def test_lookups(spark):
    stocks = spark.createDataFrame([(1, "A", "a")], schemas.STOCKS)
    rows = spark.createDataFrame([(1,), (2,)], "stock_id int")
    assert sorted(r.symbol for r in lookup_symbol(rows, stocks).collect()) == ["A", "stock_2"]
    assert {r.symbol for r in lookup_symbol(rows, stocks, fallback=False).collect()} == {
        "A", None}
    maps = symbol_maps(stocks)
    assert [tuple(r) for r in maps.where("map_name = 'symbol_by_id'").collect()] == [
        ("symbol_by_id", "1", "A")]


def test_join_per_stock_is_the_same_with_and_without_broadcast(spark):
    rows = spark.range(1000).select((F.col("id") % 3).cast("int").alias("stock_id"), "id")
    values = spark.createDataFrame([(0, "x"), (1, "y")], "stock_id int, value string")
    small = sorted(tuple(r) for r in join_per_stock(rows, values).collect())
    salted = sorted(tuple(r) for r in join_per_stock(
        rows, values, broadcast_rows=0, salts=5).collect())
    assert len(small) == 667 and small == salted
