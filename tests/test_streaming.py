from pyspark.sql import functions as F

from veilspark import streaming


def test_redaction_and_pseudonyms(spark, tmp_path):
    spark.createDataFrame([(1, "mail me@x.io"), (2, "none")], "id long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "in"))
    out = streaming.pseudonymized(streaming.redacted(stream, "text").withColumn("who", F.col("id").cast("string")), ["who"], b"k")
    for _ in range(2):  # started again, it repeats nothing
        streaming.write(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert [r.text for r in rows] == ["mail [EMAIL]", "none"] and all(len(r.who) == 16 for r in rows)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bin").write_bytes(b"abc")
    out = streaming.hashed(streaming.read_files(spark, str(tmp_path / "in")))
    streaming.write(out, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().hashes["md5"] == "900150983cd24fb0d6963f7d28e17f72"


def test_counts_by_window(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a@b.io"), ("2024-01-01 00:20:00", "c@d.io"), ("2024-01-02 00:00:00", "x")], "ts string, t string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, t string").parquet(str(tmp_path / "in"))
    q = streaming.counted(stream, "t", "ts").writeStream.format("memory").queryName("finds").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.type, r["count"]) for r in spark.table("finds").collect()] == [("email", 2)]
