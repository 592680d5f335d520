"""Files that are damaged or half there, and streams that arrive in pieces."""

import pytest
from pyspark.sql import functions as F

from tidewater.sources import files as f


def test_klines_csv_leaves_out_what_is_no_candle(spark, tmp_path):
    good = "1700000000000,1,2,0.5,1.5,10,1700003599999,15,3,4,6,0"
    (tmp_path / "a.csv").write_text(f"open_time,open,high,low,close,volume,close_time,quote_volume,count,tb,tq,ignore\n{good}\n17000,1\n\n1700003600000,1,2\n")
    rows = f.klines_csv(spark, f"{tmp_path}/a.csv").collect()
    assert [(r.open_time, r.close) for r in rows] == [("1700000000000", "1.5")]


def test_verified_reads(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.bin").write_bytes(b"one")
    (tmp_path / "d/y.bin").write_bytes(b"two")
    sums = f.manifest(spark, f"{tmp_path}/d").withColumn("sha256", F.when(F.col("name") == "y.bin", "0" * 64).otherwise(F.col("sha256"))).select("name", "sha256")
    sums = sums.union(spark.createDataFrame([("z.bin", "1" * 64)], "name string, sha256 string"))
    got = {r.name: (r.status, r.content and bytes(r.content)) for r in f.verified(spark, f"{tmp_path}/d", sums).collect()}
    assert got == {"x.bin": ("ok", b"one"), "y.bin": ("mismatch", None), "z.bin": ("missing", None)}


def test_quoted_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', None)], "i int, t string, n string").coalesce(1)
    f.write_quoted_csv(df, f"{tmp_path}/q")
    text = "".join(p.read_text() for p in (tmp_path / "q").glob("part-*"))
    assert text.splitlines() == ['"i","t","n"', '"1","a ""b"", c",""']
    assert df.select(f.csv_line(df).alias("l")).first().l == '"1","a ""b"", c",""'


def test_publishing_replaces_the_pointer_last(spark, tmp_path):
    folder = f"{tmp_path}/p"
    f.publish(spark.range(3), folder, "one")
    f.publish(spark.range(5), folder, "two")
    assert f.latest(spark, folder).count() == 5 and spark.read.parquet(f"{folder}/runs/one").count() == 3


def test_provenance_stops_the_job(spark):
    x = spark.createDataFrame([("native",), ("aggregated",)], "source string")
    assert f.with_provenance(x.limit(1), "native").count() == 1
    with pytest.raises(Exception, match="expected native data, found aggregated"):
        f.with_provenance(x, "native").collect()


def test_symbol_lists(spark):
    text = spark.createDataFrame([("BTC,ETH # all, of, it\nBTC  x\n币安币 bad-name",)], "t string")
    assert text.select(f.symbols(F.col("t")).alias("s")).first().s == ["BTC", "ETH", "币安币"]
