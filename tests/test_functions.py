from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions import timecode as tc


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


def test_normalisers(spark):
    assert one(spark, " はい！ Ａ。", tx.normalise(F.col("text"), "match")) == "はいa"
    assert one(spark, "ア・Straße", tx.normalise(F.col("text"), "strict")) == "アstrasse"
    assert one(spark, "カタカナ", tx.norm_kana(F.col("text"))) == "かたかな"
    assert one(spark, None, tx.normalise(F.col("text"), "match")) == ""


def test_clean_up(spark):
    assert one(spark, "write to anna . berg @ mail . sample . org today", tx.clean_subtitle_text(F.col("text"))) == "write to anna.berg@mail.sample.org today"
    assert one(spark, "ask nils at sample . net , we meet at noon .", tx.clean_subtitle_text(F.col("text"))) == "ask nils@sample.net, we meet at noon."
    assert one(spark, "the k p m g x report , a b c", tx.clean_subtitle_text(F.col("text"))) == "the kpmgx report, abc"
    assert one(spark, "1 9 8 7 年 6 月 5 日 x", tx.clean_subtitle_text(F.col("text"))) == "1987年6月5日 x"


def test_counts_and_wrapping(spark):
    assert one(spark, "hello world", tx.count_words(F.col("text"))) == 2
    assert one(spark, "你好 world", tx.count_words(F.col("text"))) == 3
    assert one(spark, "你" * 40, tx.wrap_text(F.col("text"))) == "你" * 18 + "\n" + "你" * 18
    assert one(spark, "", tx.wrap_text(F.col("text"))) == ""


def test_time_texts(spark):
    assert one(spark, "01:02:03,4", tc.srt_ms(F.col("text"))) == 3723400
    assert one(spark, "00:61:00,000", tc.srt_ms(F.col("text"))) is None
    assert one(spark, "0:00:01.50", tc.ass_ms(F.col("text"))) == 1500
