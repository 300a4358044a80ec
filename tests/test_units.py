import pytest

from tabulon.operators import queries, units

UNITS = [("dong", 1.0, "money"), ("nghin_dong", 1e3, "money"), ("trieu_dong", 1e6, "money"), ("ty_dong", 1e9, "money"), ("tram_ty_dong", 1e11, "money"), ("nghin_ty_dong", 1e12, "money"), ("percent", 1.0, "ratio"), ("times", 1.0, "ratio")]


@pytest.mark.parametrize(
    ("line", "unit"),
    [("Đơn vị tính: triệu đồng", "trieu_dong"), ("ĐVT: nghìn tỷ đồng", "nghin_ty_dong"), ("(Đơn vị: 1.000đ)", "nghin_dong"), ("Unit: bn VND", "ty_dong"), ("Số liệu trình bày theo đồng", "dong"),
     ("ghi nhận khoản chi 14.570 triệu đồng", None), ("", None), (None, None), ("Unit: VND'000", "nghin_dong"), ("là bao nhiêu trăm tỷ đồng?", "tram_ty_dong"), ("expressed in percent?", "percent")],
)
def test_announced(line, unit):
    assert units.announced(line) == unit


@pytest.mark.parametrize(("head", "unit"), [("31/12/2020 (Trđ)", "trieu_dong"), ("2020\nđồng", "dong"), ("2020 - tỷ đồng", "ty_dong"), ("Chỉ tiêu", None), ("2020", None), ("Diện tích (m²)", None)])
def test_labelled(head, unit):
    assert units.labelled(head) == unit


SCHEMA = "table_ref string, unit_scale double, title string, context_before string, header_rows array<array<string>>, rows array<array<string>>, unit string, factor string"


def test_wrong_units(spark):
    tables = [
        ("a|1", 1e6, "T (tỷ đồng)", "", [["x", "2020"]], [["k", "1"]], "VND", "clash"),
        ("a|1", 1e6, "T (tỷ đồng)", "", [["x", "2020"]], [["k", "1"]], "VND", "clash"),
        ("a|2", 1.0, None, None, [["x", "2020"]], [["Đơn vị: nghìn đồng", ""], ["k", "1"]], None, None),
        ("a|3", None, "", "", None, None, None, None),
        ("a|4", 1e6, "T", "ĐVT: triệu đồng", [["x", "2020"]], [], "đồng", None),
        ("a|5", 1.0, "x" * 100_000, "y" * 100_000, [[None]], [[None]], "đồng", None),
    ]
    answers = [(1, 7, 2.0, 2e6), (1, 7, 2.0, 2e6), (2, 7, 2e6, 2e6), (3, 7, None, 2e6), (4, 8, 12.5, 12.5), (5, 99, 1.0, 1.0)]
    questions = [(7, "là bao nhiêu triệu đồng?"), (7, "là bao nhiêu triệu đồng?"), (8, "là bao nhiêu %?"), (9, None)]
    got = units.wrong_units(
        spark.createDataFrame(tables, SCHEMA), spark.createDataFrame(answers, "answer_id long, question_id int, value double, raw_value double"),
        spark.createDataFrame(questions, "id int, question string"), spark.createDataFrame(UNITS, "unit string, factor double, kind string"),
    )
    assert sorted(tuple(r) for r in got.collect()) == [
        ("extracted_tables", "a|1", "ty_dong"), ("extracted_tables", "a|2", "nghin_dong"), ("extracted_tables", "a|3", "dong"),
        ("normalized_answers", "2", "trieu_dong"), ("normalized_answers", "3", "trieu_dong"),
    ]


def test_empty_tables(spark):
    got = units.wrong_units(
        spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "answer_id long, question_id int, value double, raw_value double"),
        spark.createDataFrame([], "id int, question string"), spark.createDataFrame(UNITS, "unit string, factor double, kind string"),
    )
    assert got.count() == 0


def test_every_answer_comes_out_in_its_unit(spark, small):
    got = {r["answer_id"]: r for r in queries.queries()["p4_answers"](spark, small).collect()}
    factors = {r["unit"]: r["factor"] for r in spark.read.parquet(f"{small}/units.parquet").collect()}
    raw = {r["answer_id"]: r["raw_value"] for r in spark.read.parquet(f"{small}/normalized_answers.parquet").collect()}
    assert set(got) == set(raw)
    assert all(r["common"] * factors[r["right_unit"]] == pytest.approx(raw[k]) for k, r in got.items())
