"""Scalar functions on single values."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import dates, similarity, text


def values(spark, function, inputs):
    df = spark.createDataFrame(list(enumerate(inputs)), "i long, v string")
    return [r[0] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


CASES = [
    (text.phone, {"03-1234-5678": "0312345678", "０３（１２３４）５６７８": "0312345678", "+81 90-1111-2222": "09011112222", "819011112222": "09011112222", "8131234": "8131234", "+1 23": "+123", "abc": "", None: "", "　": ""}),
    (text.phone_fault, {"": None, "0312345678": None, "123": "too short (3 digits)", "012345678901": "too long (12 digits)", "1234567890": "does not start with 0", "+1": "contains non-digit characters"}),
    (text.email, {" Ａ＠Ｂ．jp　": "a@b.jp", None: ""}),
    (text.email_fault, {"a@b.jp": None, "a b@c.d": "invalid email format", "": None, "a@b": "invalid email format"}),
    (text.normal_text, {"ｶﾞｷﾞﾊﾟﾝｳﾞｱﾞ": "ガギパンヴアﾞ", " a\r\n\tb　　c\x00 ": "a b c", "ＡＢＣ１２３！": "ABC123!"}),
    (text.company_name, {"（株）山田": "株式会社山田", "山田㈱": "山田株式会社", "㈲A": "有限会社A", "(資)B": "合資会社B"}),
    (text.company_key, {"株式会社 Yamada": "yamada", "山田有限会社": "山田", "NPO法人 花": "花", "株式会社": ""}),
    (text.address, {"〒1234567 東京都": "123-4567 東京都", "１２３－４５６７東京": "123-4567 東京", "大阪": "大阪"}),
    (text.address_key, {"〒123-4567 東京 都　A": "東京都a"}),
    (text.store_key, {"新宿支店": "新宿", "本店": "", "駅前 店": "駅前"}),
    (dates.date, {"令和6年1月2日": "2024-01-02", "H31.4.30": "2019-04-30", "2024/3/5": "2024-03-05", "20240305": "2024-03-05", "２０２４．１．１": "2024-01-01", "令和元年5月1日": "令和元年5月1日", "soon ": "soon", None: ""}),
    (dates.date_fault, {"2024-02-31": None, "2024-13-01": "invalid date", "1899-01-01": "year 1899 out of range", "x": "not in YYYY-MM-DD format", "": None}),
    (dates.duration, {"1時間 2分 3秒": "01:02:03", "5分": "00:05:00", "x": "x", "": ""}),
    (similarity.filename_stem, {"240101_顧客リスト_最新版.csv": "顧客リスト", "List-Final v2 東京.xlsx": "list", "2024.csv": "2024.csv", "final.csv": "final.csv"}),
    (text.repaired_name, {"å±±ç\x94°": "山田", "plain": "plain", "é": "é"}),
    (lambda c: text.shortened(c, 8), {"abcdefghij": "abcde...", "abc": "abc"}),
]


@pytest.mark.parametrize("function, cases", CASES)
def test_scalar(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_excel_numbers(spark):
    df = spark.createDataFrame([(45292.5,), (1.0,), (45292.999999,)], "x double")
    assert [tuple(r) for r in df.select(dates.excel_date(F.col("x")), dates.excel_time(F.col("x"))).collect()] == [("2024-01-01", "12:00:00"), ("1899-12-31", "00:00:00"), ("2024-01-01", "00:00:00")]


def test_dice_counts_repeated_pairs(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("night", "nacht"), ("a", "b"), ("x", "x")], "a string, b string")
    assert [round(r[0], 4) for r in df.select(similarity.dice(F.col("a"), F.col("b"))).collect()] == [0.5, 0.25, 0.0, 1.0]


def test_a_stem_is_worked_out_once_where_names_are_compared(spark):
    c = similarity.filename_stem(F.col("name"))
    df = spark.createDataFrame([("20240131_shop-福岡.csv",), ("",), (None,), ("copy",)], "name string").select(F.round(similarity.dice(c, F.lit("shops")), 4).alias("d"), c.alias("s"))
    assert [tuple(r) for r in df.collect()] == [(0.8571, "shop"), (0.0, ""), (0.0, None), (0.2857, "copy")]
    assert df.select("d")._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
