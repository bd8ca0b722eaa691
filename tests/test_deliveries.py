import json

from pyspark.sql import functions as F

from tickloom.sources.deliveries import Source, deliver, read_delivery

DAYS = {"2024-01-02": 1704153600, "2024-01-03": 1704240000}


def candle(symbol, days=tuple(DAYS), **changes):
    n = len(days)
    body = {"s": "ok", "t": [DAYS[d] for d in days], "o": [1.0] * n, "h": [2.0] * n, "l": [0.5] * n,
            "c": [1.5] * n, "v": [7] * n, **changes}
    return {"symbol": symbol, "payload": json.dumps(body)}


def line(symbol, day, close=9.0):
    return f"{symbol},{day} 00:00:00,1.0,2.0,0.5,{close},3"


HEADER = "symbol,Date,Open,High,Low,Close,Volume"


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def feed(tmp_path):
    good = [json.dumps(candle("A")), json.dumps({"symbol": "E", "payload": '{"s":"no_data"}'})]
    cut = {"symbol": "B", "payload": candle("B")["payload"][:-9]}
    uneven = candle("C", v=[7])
    write(tmp_path / "candles/one.json", [*good, json.dumps(cut), json.dumps(uneven)])
    # A line that ends in the middle names no symbol, so all of its file fail.
    write(tmp_path / "candles/two.json", [json.dumps(candle("D")), json.dumps(candle("F"))[:-20]])
    write(tmp_path / "history/one.csv", [HEADER, line("A", "2024-01-02"), line("B", "2024-01-02"),
                                         line("B", "2024-01-03"), "C,2024-01-02 00:00:00,1.0",
                                         line("C", "2024-01-03")])
    write(tmp_path / "history/two.csv", [HEADER, line("D", "2024-01-02"), line("E", "not a day"),
                                         line("F", "2024-01-03")])
    write(tmp_path / "last/one.json", [json.dumps(
        {"symbol": s, "Date": "2024-01-05", "Open": 1.0, "High": 2.0, "Low": 0.5, "Close": 4.0, "Volume": 1})
        for s in "CG"])
    return [Source("candles", str(tmp_path / "candles"), "candles"),
            Source("absent", str(tmp_path / "absent"), "csv"),
            Source("history", str(tmp_path / "history"), "csv"),
            Source("last", str(tmp_path / "last"), "json")]


def test_nothing_is_lost_silently(spark, tmp_path):
    used, quarantine = deliver(spark, *feed(tmp_path))
    got = sorted((r.symbol, str(r.date), r.close, r.source) for r in used.collect())
    assert got == [
        ("A", "2024-01-02", 1.5, "candles"), ("A", "2024-01-03", 1.5, "candles"),
        ("B", "2024-01-02", 9.0, "history"), ("B", "2024-01-03", 9.0, "history"),
        ("C", "2024-01-05", 4.0, "last"), ("D", "2024-01-02", 9.0, "history"),
        ("F", "2024-01-03", 9.0, "history"), ("G", "2024-01-05", 4.0, "last")]
    listed = sorted((r.source, r.symbol or "", r.reason, (r.file or "").rsplit("/", 1)[-1])
                    for r in quarantine.collect())
    assert listed == [
        ("absent", "", "missing path", "absent"), ("candles", "", "broken line", "two.json"),
        ("candles", "B", "broken payload", "one.json"), ("candles", "C", "uneven payload", "one.json"),
        ("candles", "D", "delivery failed", "two.json"), ("candles", "D", "delivery failed", "two.json"),
        ("history", "C", "broken line", "one.csv"), ("history", "C", "delivery failed", "one.csv"),
        ("history", "E", "no date", "two.csv")]
    assert quarantine.where(F.col("record").isNull()).count() == 1


def test_only_missing_paths(spark, tmp_path):
    used, quarantine = deliver(spark, Source("a", str(tmp_path / "none"), "candles"))
    assert used.count() == 0 and [r.reason for r in quarantine.collect()] == ["missing path"]
    bars, _ = read_delivery(spark, Source("a", str(tmp_path / "none"), "json"))
    assert dict(bars.dtypes)["volume"] == "bigint"
