import gzip
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from barweave.functions import scalars as X
from barweave.operators import universe
from barweave.sources import bars as bar_files
from barweave.sources import candidates as arts
from barweave.sources import samples as sets
from barweave.sources import trades as tapes
from barweave.streaming import streams

LINE = "{t},100,110,90,105,12,0,1260,7,6,0,0"
HEADER = "open_time,open,high,low,close,volume,close_time,q,n,t,tq,x"


def test_bar_files(spark, tmp_path):
    first = 1_700_000_040_000
    (tmp_path / "AAAUSDT-1m-2023-11.csv").write_text("\n".join([HEADER, LINE.format(t=first), LINE.format(t=first + 60000), "1,2,3", LINE.format(t=first).replace("90", "0")]))
    with gzip.open(tmp_path / "BBBUSDT-1m-2023-11-14.csv.gz", "wt") as out:
        out.write(LINE.format(t=first * 1000))  # microseconds
    got = bar_files.read_bars(spark, str(tmp_path)).orderBy("symbol", "open_time").collect()
    assert [(r.symbol, r.month, r.open_time, r.quote_volume) for r in got] == [
        ("AAAUSDT", "2023-11", first, 1260.0), ("AAAUSDT", "2023-11", first + 60000, 1260.0), ("BBBUSDT", "2023-11", first, 1260.0)
    ]


def test_zipped_bars_use_the_first_member(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("a.csv", LINE.format(t=1_700_000_040_000))
        archive.writestr("b.csv", LINE.format(t=1_700_000_100_000))
    (tmp_path / "CCCUSDT-1m-2023-11.zip").write_bytes(buffer.getvalue())
    got = bar_files.read_bar_archives(spark, str(tmp_path)).collect()
    assert [(r.symbol, r.trades) for r in got] == [("CCCUSDT", 7.0)]


def test_trade_tape(spark, tmp_path):
    rows = ["1,10,2,20,1700000040000,false", "2,10,2,20,1700000040001,True,x", "3,10,2,20,1700000040002,maybe", "4,1"]
    (tmp_path / "AAAUSDT-trades-2023-11-14.csv").write_text("\n".join(rows))
    got = tapes.read_trades(spark, str(tmp_path)).orderBy("trade_time").collect()
    assert [(r.symbol, r.side, r.is_buyer_maker) for r in got] == [("AAAUSDT", "buy", False), ("AAAUSDT", "sell", True)]


def shard(spark, symbol, x):
    return spark.createDataFrame([(symbol, "2024-01", i, x) for i in range(3)], "symbol string, month string, open_time bigint, x double")


def test_merge_conflicts_and_configs(spark):
    a, b = shard(spark, "A", 1.0), shard(spark, "B", 1.0)
    rows, added = sets.merge_shards([a, a.unionByName(b)])
    assert rows.count() == 6
    assert {r._source: (r.shards, r.rows) for r in added.select(F.col("_source").alias("_source"), "shards", "rows").collect()} == {0: (1, 3), 1: (1, 3)}
    with pytest.raises(ValueError, match="conflicting shards: A/2024-01"):
        sets.merge_shards([a, shard(spark, "A", 2.0)])
    with pytest.raises(ValueError, match="configurations"):
        sets.merge_shards([a, b], [{"window": 5}, {"window": 6}])


def test_sample_checks(spark):
    df = spark.createDataFrame([(1, 10.0, 0.05), (2, 10.0, -0.03)], "open_time bigint, quote_volume double, trade_return double")
    sets.check_samples(df.filter("open_time = 1"), 0.05, 0.02)
    with pytest.raises(ValueError, match="below_stop"):
        sets.check_samples(df, 0.05, 0.02)
    high = spark.createDataFrame([(1, 10.0, 0.5)], df.schema)
    sets.check_samples(high, 0.05, 0.02, "first_decline")
    with pytest.raises(ValueError, match="above_target"):
        sets.check_samples(high, 0.05, 0.02)
    with pytest.raises(ValueError, match="missing_quote_volume"):
        sets.check_samples(df.drop("quote_volume").filter("open_time = 1"), 0.05, 0.02)


def test_effective_targets(spark):
    df = spark.createDataFrame([(0.03, -1.0), (None, float("nan"))], "upside_target double, downside_stop double")
    got = [(r.effective_target, r.target_source, r.effective_stop, r.stop_source) for r in sets.effective_targets(df).collect()]
    assert got == [(0.03, "manifest", 0.02, "default"), (0.05, "default", 0.02, "default")]
    assert sets.effective_targets(df, target=0.1).first().target_source == "argument"


def test_candidate_round_trip_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, float("inf"), 1), ("b", 2, 0.5, 0)], "candidate_id string, open_time bigint, trade_return double, executed int")
    path = str(tmp_path / "c")
    arts.write_candidates(df.withColumn("extra", F.lit(1)), path)
    got = arts.read_candidates(spark, path)
    assert len(got.columns) == 59 and {r.candidate_id: r.trade_return for r in got.collect()} == {"a": None, "b": 0.5}
    got.limit(1).write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError, match="manifest"):
        arts.read_candidates(spark, path)
    arts.write_candidates(df, path)
    manifest = spark.read.json(f"{path}/manifest").first()
    assert manifest["rows"] == 2 and manifest["full_candidate_coverage"] is True


def test_names_and_units(spark):
    names = ["BTCUSDT", "EURUSDT", "ETHUPUSDT", "UPUSDT", "JUPUSDT", "WUSDT", "WBTCUSDT", "ADABUSD", "A-BUSDT", "SOL3SUSDT", "USDT"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    assert [r.s for r in df.filter(universe.is_ordinary("s")).collect()] == ["BTCUSDT", "UPUSDT"]
    t = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (1_700_000_000_000_000,)], "t bigint")
    assert {r[0] for r in t.select(X.minute("t")).collect()} == {1_700_000_000 // 60}


def test_numbers_and_ids(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in df.select(X.num("v", -1)).collect()] == [1.5, -1.0, -1.0, -1.0, -1.0]
    row = spark.range(1).select(X.candidate_id(F.lit("a"), F.lit(None).cast("string"), F.lit(3)).alias("i"), X.clip(F.lit(None).cast("double"), 0, 1).alias("c")).first()
    import hashlib

    assert row.i == hashlib.sha1(b"a||3").hexdigest() and row.c is None


def files(spark, tmp_path, parts, schema):
    """One file per part, read one per micro-batch in this order."""
    import os

    for i, rows in enumerate(parts):
        path = tmp_path / f"part{i}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path))
        for f in path.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "part*"))


def run(stream, tmp_path, name):
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-log"))
    query.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def test_late_trades_are_dropped(spark, tmp_path):
    def trade(minute, price):
        return ("A", f"2024-01-01 00:{minute:02d}:30", price, 1.0, False)

    schema = "symbol string, at string, price double, quantity double, is_buyer_maker boolean"
    raw = files(spark, tmp_path, [[trade(1, 10.0), trade(20, 11.0)], [trade(40, 12.0)], [trade(1, 99.0), trade(59, 13.0)]], schema)
    bars = streams.bars(raw.withColumn("ts", F.to_timestamp("at")), "1 minute", "5 minutes")
    got = {r.open_time // 60000 % 60: r.close for r in run(bars, tmp_path, "bars")}
    assert got == {1: 10.0, 20: 11.0, 40: 12.0}


def test_cooldown_state_carries_over_batches(spark, tmp_path):
    first = 28_400_000

    def entry(minute, symbol="A"):
        return (symbol, (first + minute) * 60000)

    parts = [[entry(0), entry(10)], [entry(12), entry(16)], [entry(30), entry(31)], [entry(60, "B")]]  # the last one moves the watermark on
    raw = files(spark, tmp_path, parts, "symbol string, open_time bigint")
    assert sorted(r.minute - first for r in run(streams.cooldown(raw, 15), tmp_path, "cool")) == [0, 16, 31]


def test_topk_over_batches(spark, tmp_path):
    schema = "row_id string, symbol string, bucket int, trade_score double"
    raw = files(spark, tmp_path, [[("a", "A", 1, 1.0), ("b", "B", 1, 5.0)], [("c", "C", 1, 3.0), ("d", "D", 2, 9.0)]], schema)
    out = str(tmp_path / "top")
    sink = streams.topk_sink(out, 2, ["bucket"], "trade_score")
    raw.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = streams.closed_topk(spark, out, 2, ["bucket"], "trade_score", F.col("bucket") < 2).collect()
    assert sorted(r.row_id for r in got) == ["b", "c"]


def test_cooldown_does_not_depend_on_micro_batches(spark, tmp_path):
    import random

    rng = random.Random(1)
    start = 28_400_000  # minutes
    entries = sorted(rng.randrange(300) for _ in range(80))
    rows = [(s, (start + m) * 60_000 + rng.randrange(60_000)) for m in entries for s in ("A", "B")] + [("C", (start + 2000) * 60_000)]
    want, last = [], None
    for m in entries:
        if last is None or m - last >= 15:
            want.append(start + m)
            last = m
    schema = "symbol string, open_time bigint"
    for name, size, jitter in (("one", 1000, 0), ("many", 13, 0), ("late", 9, 8)):
        shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, jitter) * 60_000)  # within the delay
        parts = [shuffled[i : i + size] for i in range(0, len(rows), size)]
        (tmp_path / name).mkdir()
        got = run(streams.cooldown(files(spark, tmp_path / name, parts, schema), 15), tmp_path, f"{name}-out")
        assert sorted(r.minute for r in got if r.symbol == "A") == want, name
        assert sorted(r.minute for r in got if r.symbol == "B") == want, name
