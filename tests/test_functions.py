import pytest
from pyspark.sql import functions as F

from tabulon.functions import lookalikes, numbers, text

NUMBERS = [
    ("7.654.321", 7654321.0), ("7.654.321,25", 7654321.25), ("4.321", 4321.0), ("3,5", 3.5), ("7,654,321.25", 7654321.25), ("3.5", 3.5), ("0,75", 0.75),
    ("(4.321)", -4321.0), ("( 4.321 )", -4321.0), ("(-4.321)", 4321.0), ("+4.321", 4321.0), ("-4.321", -4321.0), ("", None), ("-", None), ("--", None), ("n/a", None),
    ("...", None), (None, None), ("xyz", None), ("3x4y", None), ("l.2S4", 1254.0), ("12,5%", 12.5), ("1 234", 1234.0), ("Doanh thu", None), ("0.125", 125.0),
]


def test_parse_number(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(NUMBERS)], "i int, cell string").select("i", numbers.parse_number(F.col("cell")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in rows] == [v for _, v in NUMBERS]


def test_parse_number_as_ratio_and_scale(spark):
    row = spark.sql("SELECT '12,5%' c").select(numbers.parse_number(F.col("c"), as_ratio=True).alias("a"), numbers.parse_number(F.col("c"), scale=10.0).alias("b")).first()
    assert row["a"] == pytest.approx(0.125) and row["b"] == 125.0


PERIODS = [
    ("2021", 2024, (2021, "annual")), ("31/12/2021", None, (2021, "closing")), ("31.12.2021 Triệu đồng", None, (2021, "closing")), ("01/01/2021", None, (2020, "opening")),
    ("30-06-2021", None, (2021, "point_in_time")), ("45/13/2021", None, (2021, "unknown")), ("Số đầu năm", 2022, (2021, "opening")), ("Số cuối kỳ", 2022, (2022, "closing")),
    ("Năm trước", 2022, (2021, "annual")), ("Năm nay", 2022, (2022, "annual")), ("Số đầu năm", None, None), ("Theo báo cáo kiểm toán 2021", 2022, None), ("", 2022, None), (None, 2022, None),
    ("2020 - 2021", 2022, None), ("ngày 31 tháng 12 năm 2021", None, (2021, "closing")), ("Chỉ tiêu", 2022, None),
]


def test_column_period(spark):
    rows = spark.createDataFrame([(i, h, y) for i, (h, y, _) in enumerate(PERIODS)], "i int, h string, y int")
    got = rows.select("i", numbers.column_period(F.col("h"), F.col("y")).alias("p")).orderBy("i").collect()
    assert [None if r["p"] is None else (r["p"]["year"], r["p"]["period"]) for r in got] == [p for *_, p in PERIODS]


def test_questions(spark):
    asked = [
        ("Số dư đầu năm 2019 là bao nhiêu triệu đồng?", "opening", "trieu_dong", [2019]), ("Cuối kỳ 2018 là bao nhiêu tỷ đồng?", "closing", "ty_dong", [2018]),
        ("Trong năm 2017 bao nhiêu phần trăm?", "annual", "percent", [2017]), ("Từ 2015 đến 2018 hệ số tăng mấy lần?", None, "times", [2015, 2016, 2017, 2018]),
        ("Năm 2020 và 2016?", None, "none", [2016, 2020]), ("bao nhiêu nghìn tỷ đồng", None, "nghin_ty_dong", []), ("bao nhiêu VND", None, "dong", []),
    ]
    q = F.col("q")
    rows = spark.createDataFrame([(i, a[0]) for i, a in enumerate(asked)], "i int, q string").select("i", numbers.requested_period(q).alias("p"), numbers.asked_unit(q).alias("u"), numbers.question_years(q).alias("y"))
    assert [(r["p"], r["u"], r["y"]) for r in rows.orderBy("i").collect()] == [a[1:] for a in asked]


@pytest.mark.parametrize(
    ("value", "unit", "want"),
    [(1e9, "ty_dong", 1.0), (1.5e6, "trieu_dong", 1.5), (2.5e5, "nghin_dong", 250.0), (150.0, "dong", 150.0), (2071561008455.0, "ty_dong", 2071.56), (15.3, "percent", 15.3), (1.53, "times", 1.53), (-2.5e9, "ty_dong", -2.5), (0.0, "ty_dong", 0.0)],
)
def test_answer(spark, value, unit, want):
    assert spark.createDataFrame([(value, unit)], "v double, u string").select(numbers.answer(F.col("v"), F.col("u"))).first()[0] == want


def test_context_unit(spark):
    texts = [("Đơn vị tính: triệu đồng", "trieu_dong"), ("ĐVT: tỷ đồng", "ty_dong"), ("VND'000", "nghin_dong"), ("in million VND", "trieu_dong"), ("Công ty Dược, đồng", "dong"), ("không có gì", None), (None, None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string").select("i", numbers.context_unit(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in rows] == [u for _, u in texts]


def test_text(spark):
    row = spark.createDataFrame([("  Đầu tư\tNGẮN  hạn của Công ty ",)], "t string").select(text.fold(F.col("t")).alias("f"), text.tokens(F.col("t")).alias("k"), text.slug(F.col("t")).alias("s"), text.phrases(F.col("t")).alias("p")).first()
    assert row["f"] == "dau tu ngan han cua cong ty"
    assert row["k"] == ["dau", "ngan", "han"]
    assert row["s"] == "dau_tu_ngan_han_cua_cong_ty"
    assert row["p"] == ["dau ngan", "ngan han", "dau ngan han"]


def test_text_of_nothing(spark):
    row = spark.createDataFrame([(None, "")], "a string, b string").select(text.fold(F.col("a")), text.slug(F.col("b")), text.phrases(F.col("b"))).first()
    assert row[0] is None and row[1] == "untitled" and row[2] == []


def test_lookalikes():
    assert lookalikes.canonical("Соng ty") == "Cong ty"
    assert lookalikes.canonical("ấ") == "ấ"
    assert lookalikes.canonical("Ｔｅｓｔ　​1") == "Test 1"
    assert lookalikes.canonical("Волна β m²") == "Волна β m²"
    assert lookalikes.fold("Đầu") == "dau"


#: Written by hand: what texts state and ask for, so that an error in a pattern isn't repeated on both sides of a comparison.
STATED = [
    ("Số liệu tính theo tỷ đồng", "ty_dong"), ("(tỷ VND)", "ty_dong"), ("ĐVT: tỷ", "ty_dong"), ("Đơn vị: Tỷ đ", "ty_dong"), ("all figures in billion", "ty_dong"),
    ("Triệu VNĐ", "trieu_dong"), ("trieu d", "trieu_dong"), ("Tr đồng", "trieu_dong"), ("Đơn vị tính: tr", "trieu_dong"), ("VND million", "trieu_dong"),
    ("nghìn đồng", "nghin_dong"), ("Ngàn VND", "nghin_dong"), ("ng đồng", "nghin_dong"), ("dvt: ng", "nghin_dong"), ("thousand dong", "nghin_dong"), ("VND '000", "nghin_dong"), ("vnd000", "nghin_dong"),
    ("Đồng Việt Nam", "dong"), ("VND", "dong"), ("tỷ đồng và triệu đồng", "ty_dong"), ("hợp đồng thuê", "dong"), ("công ty đầu tư", None), ("tỷ lệ", None), ("cổ phiếu", None), ("đvt: cái", None),
]
ASKED = [
    ("gấp bao nhiêu lần", "times"), ("hệ số thanh toán là mấy lần", "times"), ("lần", "times"), ("tăng bao nhiêu %", "percent"), ("mấy điểm phần trăm", "percent"), ("ngàn tỷ", "nghin_ty_dong"),
    ("trăm tỷ đồng", "tram_ty_dong"), ("bao nhiêu tỷ", "ty_dong"), ("tỷ đồng", "ty_dong"), ("bao nhiêu triệu", "trieu_dong"), ("triệu đồng", "trieu_dong"), ("bao nhiêu ngàn", "nghin_dong"), ("nghìn đồng", "nghin_dong"),
    ("bao nhiêu đồng", "dong"), ("tính bằng đồng", "dong"), ("đơn vị đồng", "dong"), ("Việt Nam đồng", "dong"), ("hợp đồng nào", "none"), ("", "none"),
]
HEADS = [("Đầu kỳ", (2019, "opening")), ("Số dư cuối năm", (2020, "closing")), ("Kỳ trước", (2019, "annual")), ("Năm ngoái", (2019, "annual")), ("kỳ này", (2020, "annual")), ("Năm hiện tại", (2020, "annual")), ("đầu tư", None), ("Nhiệm kỳ này", None)]


def test_spellings(spark):
    of = lambda pairs, f: [r[0] for r in spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]
    assert of(STATED, numbers.context_unit) == [u for _, u in STATED]
    assert of(ASKED, numbers.asked_unit) == [u for _, u in ASKED]
    assert [p and (p["year"], p["period"]) for p in of(HEADS, lambda t: numbers.column_period(t, F.lit(2020)))] == [p for _, p in HEADS]
