"""The data source of landed pages: each row once, from the cursor on after a restart."""

from tidewater.sources import pages

H = 3_600_000


def test_pages_with_repeated_edges(spark, tmp_path):
    pages.register(spark)
    rows = [(s, 7 + i * H, float(i)) for s, n in (("A/B c", 95), ("X", 10), ("Y", 11), ("Z", 1)) for i in range(n) if i % 13 != 5]
    df = spark.createDataFrame(rows, pages.SCHEMA)
    path = f"{tmp_path}/p"
    pages.land(df, path, 10, H)
    landed = sum(1 for f in (tmp_path / "p").rglob("part-*.json") for _ in f.read_text().splitlines())
    read = spark.read.format("pages").load(path)
    assert landed > len(rows) and sorted(map(tuple, read.collect())) == sorted(rows)
    assert read.rdd.getNumPartitions() == len(list((tmp_path / "p").rglob("from=*")))
    assert spark.read.format("pages").load(f"{tmp_path}/none").count() == 0


def test_a_stream_goes_on_at_its_cursor(spark, tmp_path):
    pages.register(spark)
    path, out = f"{tmp_path}/p", []
    rows = [(s, i * H, float(i)) for s in "XY" for i in range(60)]
    df = spark.createDataFrame(rows, pages.SCHEMA)
    # a symbol comes later than the other, one run finds nothing new
    for some, since, until in ((df.where("symbol = 'X'"), 0, 4), (df, 4, 8), (df.where("symbol = 'Y'"), 0, 0), (df, 8, None)):
        if some is df and since == 4:
            pages.land(df.where("symbol = 'Y'"), path, 5, H, 0, 4)
        pages.land(some, path, 5, H, since, until)
        stream = spark.readStream.format("pages").load(path)
        q = stream.writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(out) == sorted(rows)
