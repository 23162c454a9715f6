from datetime import date

from pyspark.sql import functions as F

from hearth.functions import due_date_of, or_default, percent_text, value_rank


def one(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_percent_text(spark):
    assert one(spark, percent_text(F.lit(2), F.lit(3))) == "66.7%"
    assert one(spark, percent_text(F.lit(1), F.lit(8))) == "12.5%"
    assert one(spark, percent_text(F.lit(1), F.lit(1))) == "100.0%"
    assert one(spark, percent_text(F.lit(0), F.lit(5))) == "0.0%"
    assert one(spark, percent_text(F.lit(0), F.lit(0))) is None
    assert one(spark, percent_text(F.lit(None).cast("bigint"), F.lit(0))) is None


def test_value_rank(spark):
    assert one(spark, value_rank(F.lit("处理中"), ["待处理", "处理中"])) == 2
    assert one(spark, value_rank(F.lit("?"), ["待处理", "处理中"])) == 0
    assert one(spark, value_rank(F.lit(None).cast("string"), ["待处理"])) == 0


def test_due_date(spark):
    assert one(spark, due_date_of(F.lit("2024-01"))) == date(2024, 1, 25)
    assert one(spark, due_date_of(F.lit("2024-1"))) == date(2024, 1, 25)
    assert one(spark, due_date_of(F.lit("2030-13"))) is None


def test_or_default(spark):
    assert one(spark, or_default(F.lit(""), "-")) == "-"
    assert one(spark, or_default(F.lit(None).cast("string"), "未绑定")) == "未绑定"
    assert one(spark, or_default(F.lit("x"), "-")) == "x"
