from heliofleet.session import shared_dir, staged


def test_shared_folder_comes_from_the_session(spark):
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base + "/x-")


def test_staged_rows_are_the_same(spark):
    df = spark.range(5)
    assert staged(df, "y").count() == 5 and staged(df, "y").dtypes == df.dtypes
