from pyspark.sql import functions as F

from tideline.functions import levels as L
from tideline.functions import numeric as N
from tideline.functions.text import step_label
from tideline.operators.reshape import melt


def test_row_local_operators_take_a_stream(spark, tmp_path):
    src = spark.createDataFrame([("1", 0.0, 8.0), ("9", 4.0, 1.0)], "arm string, a double, b double")
    src.write.parquet(str(tmp_path / "in"))
    dim = spark.createDataFrame([("1", "low")], "arm string, name string")

    def plan(df):
        long = melt(df, ["arm"], ordinal="o").join(dim, "arm", "left")
        return long.select(
            "arm", "name", "o", L.level_rank(F.col("arm"), L.ARM).alias("rank"),
            N.r_log2(F.col("value")).alias("lg"), step_label(F.col("value")).alias("mark"),
        )

    stream = plan(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")))
    run = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, plan(src).collect())) and len(got) == 4
