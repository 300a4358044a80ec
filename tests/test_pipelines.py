import json

import pytest
from pyspark.sql import functions as F

from tabulon.operators import companies, evaluation, extraction, normalization, programs, retrieval, submission
from tabulon.plans import pipelines
from tabulon.sources import documents as sources
from tabulon.sources import sinks

REPORT = """===== PAGE 1 =====
Bảng cân đối kế toán
Đơn vị tính: triệu đồng
<table><tr><td>Chỉ tiêu</td><td>Mã số</td><td>31/12/2021</td><td>01/01/2021</td></tr><tr><td>Tổng tài sản quý</td><td>100</td><td>5.250</td><td>4.100</td></tr><tr><td>Hàng trong kho</td><td>140</td><td>1.310</td><td>900</td></tr></table>
"""
PLAIN = """Kết quả hoạt động kinh doanh
Đơn vị tính: tỷ đồng
| Chỉ tiêu | 2022 | 2021 |
|---|---|---|
| Doanh số thuần | 7.400 | 6.300 |
| Lãi gộp | 2.150 | 1.980 |
"""


@pytest.fixture
def settings(spark, tmp_path):
    for path, body in {"QWE/2021/QWE_bao_cao_2021_extracted.txt": REPORT, "ZXC/2022/ZXC_bao_cao_rieng_2022.txt": PLAIN, "ZXC/2022/rong.txt": ""}.items():
        (tmp_path / "docs" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / path).write_text(body, encoding="utf-8")
    asked = [{"id": 1, "question": "Cuối năm 2021 hàng trong kho của (QWE) là bao nhiêu đồng?"}, {"id": 2, "question": "Doanh số thuần của ZXC năm 2022 là bao nhiêu tỷ đồng?"}, {"id": 3, "question": "Không hỏi gì?"}]
    (tmp_path / "asked.json").write_text(json.dumps({"questions": asked}), encoding="utf-8")
    terms = [("stock", "Hàng trong kho", False), ("sales", "Doanh số thuần", False), ("assets", "Tổng tài sản quý", False)]
    spark.createDataFrame(terms, "metric string, surface string, is_derived boolean").write.parquet(str(tmp_path / "terms"))
    gold = [(1, ["QWE_bao_cao_2021"], ["QWE_bao_cao_2021|4"], 1.31e9), (2, ["ZXC_bao_cao_rieng_2022"], ["ZXC_bao_cao_rieng_2022|1"], 7400.0)]
    spark.createDataFrame(gold, "id int, gold_docs array<string>, gold_tables array<string>, gold_answer double").write.parquet(str(tmp_path / "gold"))
    return pipelines.Settings(str(tmp_path / "docs"), str(tmp_path / "asked.json"), str(tmp_path / "terms"), str(tmp_path / "gold"), str(tmp_path / "out"), options={"retrieval": {"k": 7}})


def test_stages_from_documents_to_results(spark, settings):
    done = pipelines.run(spark, settings, "all")
    assert done["corpus"] == {"documents": 2, "detected": 2, "written": 2, "skipped": 0}
    assert done["index"] == {"sparse": 2, "dense": 2} and done["retrieve"]["questions"] == 3 and done["answer"] == {"answered": 3} and done["package"] == {"items": 3, "errors": 0}
    items = {r["id"]: r for r in json.loads(open(f"{settings.out}/results.json", encoding="utf-8").read())}
    assert items[1]["answer"] == 1.31e9 and items[1]["relevant_tables"] == ["QWE_bao_cao_2021|4"] and items[1]["evidence"][0]["csv_path"] == "data/QWE_bao_cao_2021_table_4.csv"
    assert items[3]["answer"] == 0.0 and items[2]["relevant_docs"] == ["ZXC_bao_cao_rieng_2022"]
    told = done["judge"]["summary"][0]
    assert told["n"] == 2 and told["doc_f2"] == 1.0 and told["table_f2"] == 1.0 and told["answer_accuracy"] >= 0.5
    assert pipelines.run(spark, settings) == {"judge": done["judge"]}  # what is there isn't made again
    assert pipelines.answer(spark, settings) == {"answered": 0}
    assert settings.get("retrieval.k") == 7 and settings.get("nothing.at.all", 1) == 1 and settings.get("keep") == 30
    with pytest.raises(ValueError):
        pipelines.run(spark, settings, "other")


def test_facts_and_cards(spark):
    head = [["Chỉ tiêu", "Mã số", "31/12/2021", "01/01/2021"]]
    rows = [["TÀI SẢN CHUNG", "", "", ""], ["I. Ngắn hạn", "", "", ""], ["Tiền mặt", "110", "12.500", "9.300"], ["TÀI SẢN CHUNG khác", "120", "5.000", ""]]
    loose = [["Tiền thuê", "abc", "1.700"], ["Tiền điện", "x", "y"]]
    tables = spark.createDataFrame(
        [("d|1", "d", head, rows, "triệu đồng", 1e6), ("d|2", "d", [["Khoản mục", "Ghi chú", "Cột"]], loose, None, None), ("d|3", "d", None, None, None, None)],
        "table_ref string, doc_id string, header_rows array<array<string>>, rows array<array<string>>, unit string, unit_scale double",
    )
    years = spark.createDataFrame([("d", 2021)], "doc_id string, year int")
    facts = normalization.facts(tables, years, (("tien mat", "cash"),), ("cash",))
    assert facts.columns == ["table_ref", "row_idx", "item", "item_code", "metric", "is_derived", "year", "period", "source_date", "column_label", "value", "unit", "unit_scale"]
    got = sorted((r["table_ref"], r["item"], r["year"] or 0, r["period"], r["value"], r["unit"], r["metric"] or "") for r in facts.collect())
    assert ("d|1", "I. Ngắn hạn - Tiền mặt", 2021, "closing", 12500.0, "triệu đồng", "cash") in got and ("d|1", "I. Ngắn hạn - Tiền mặt", 2020, "opening", 9300.0, "triệu đồng", "cash") in got
    assert len([g for g in got if g[0] == "d|1"]) == 3
    catalog = spark.createDataFrame([("d|1", "DDD", 2021, "separate", "notes", "Bảng", "triệu đồng")], "table_ref string, ticker string, year int, report_type string, section string, title string, unit string")
    card = normalization.full_cards(catalog, facts).first()["card"].split("\n")
    assert card[0] == "ticker: DDD" and "metrics: cash" in card and "years: 2020 (opening), 2021 (closing)" in card and card[-1] == "table: d|1"
    assert normalization.facts(tables.limit(0), years).count() == 0
    twice = spark.createDataFrame([("t", 0, "a", "1", 2020, "closing", "x", 1.0), ("t", 1, "a", "2", 2020, "closing", "y", 2.0), ("t", 2, "b", None, None, None, None, 1.0)], "table_ref string, row_idx int, item string, item_code string, year int, period string, column_label string, value double")
    assert [tuple(r) for r in normalization.ambiguity_report(twice).collect()] == [("t", "a", ["1", "2"], ["x", "y"])]


def test_text_tables(spark):
    docs = spark.createDataFrame([("p", PLAIN + "\n\nĐoạn văn.\n"), ("h", REPORT), ("e", None), ("n", "chỉ có chữ")], "doc_id string, text string")
    one = extraction.text_tables(docs).collect()
    assert [(r["doc_id"], r["position"], r["first_line"], r["n_cols"]) for r in one] == [("p", 1, 3, 3)]
    assert one[0]["rows"] == [["Chỉ tiêu", "2022", "2021"], ["Doanh số thuần", "7.400", "6.300"], ["Lãi gộp", "2.150", "1.980"]] and one[0]["context_before"].startswith("Kết quả")
    assert sorted((r["doc_id"], r["source"]) for r in extraction.detected(docs).collect()) == [("h", "html"), ("p", "text")]
    w = spark.sql("SELECT array('a','b') h, array(array('1','2','3'), array(null)) r, array() e").select(extraction.wide(F.col("h"), F.col("r")).alias("x"), extraction.wide(F.col("h"), F.col("e").cast("array<array<string>>")).alias("y")).first()
    assert w["x"]["rows"] == [["1", "2"], ["", ""]] and w["y"]["columns"] == ["col_0", "col_1"] and w["y"]["rows"] == [["a", "b"]]
    clean = spark.sql("SELECT 'TAI SAN.....\\nTrang 3\\nx' t").select(extraction.clean_text(F.col("t"))).first()[0]
    assert clean == "TÀI SẢN..\nx"


NAMES = [("AAA", "Công ty Cổ phần Gạch Bình Minh"), ("BBB", "Công ty TNHH Gạch Hoàng Hôn"), ("CC1", "Tổng công ty Bình Minh"), ("DDD", "Công ty Cổ phần Đầu tư Xây dựng")]


def test_companies(spark):
    names = spark.createDataFrame(NAMES, "ticker string, name string")
    assert {r["alias"]: r["ticker"] for r in companies.aliases(names).collect()} == {"hoang hon": "BBB", "tu xay dung": "DDD"}
    asked = [(1, "So gạch bình minh với Hoàng Hôn"), (2, "Lãi của (XYZ) và Gạch Hoàng Hôn"), (3, "Lãi của AAA, EBIT và cc1"), (4, "ddd và (EPS)"), (5, None)]
    questions = spark.createDataFrame(asked, "id int, question string")
    brands = spark.createDataFrame([("DDD", "Xây Nhanh"), ("ZZZ", "Không có")], "ticker string, name string")
    got = {r["id"]: r["tickers"] for r in companies.tickers(questions, names, brands, never=("EPS",)).collect()}
    assert got[1] == ["AAA", "BBB"] and got[2] == ["XYZ", "BBB"] and got[3] == ["AAA", "CC1"] and got[4] == ["DDD"] and not got[5]
    assert companies.read_names(spark, "/nowhere.csv").count() == 0


def test_coverage_and_selection(spark):
    pool = spark.createDataFrame(
        [(1, f"t{i}", i, 1.0 / i, *x) for i, x in enumerate([("A", 2020, "notes"), ("A", 2020, "notes"), ("B", 2021, "balance_sheet"), ("C", 2020, "income_statement"), ("A", 2019, "cash_flow")], 1)],
        "qid int, ref string, rank int, score double, ticker string, year int, section string",
    )
    ask = lambda *q: spark.createDataFrame([q], "id int, tickers array<string>, years array<int>, metrics array<string>, needs_derived boolean")
    chosen = pool.where("rank <= 2").select("qid", "ref", "rank")
    placed = lambda q, most=24: [r["ref"] for r in retrieval.repaired_coverage(pool, chosen, q, "qid", "ref", most).orderBy("place").collect()]
    assert placed(ask(1, ["A", "b", "Z"], [], [], False)) == ["t1", "t2", "t3"]
    assert placed(ask(1, ["A", "B"], [], [], False), 2) == ["t1", "t3"]  # the last of a code with several makes room
    assert placed(ask(1, ["A"], [2020, 2019], [], False)) == ["t1", "t2", "t5"]
    assert placed(ask(1, ["A"], [], ["roe"], True)) == ["t1", "t2", "t4", "t3"]
    links = pool.withColumn("group_id", F.lit(None).cast("string")).withColumn("parent_table_ref", F.when(F.col("ref") == "t4", "t1")).withColumn("next_table_ref", F.lit(None).cast("string"))
    kept = [r["ref"] for r in retrieval.selected(links, ask(1, ["A"], [2020], [], False), "qid", "ref").orderBy("place").collect()]
    assert kept == ["t1", "t2", "t4"]
    assert retrieval.selected(links, ask(1, [], [], [], False), "qid", "ref", adaptive=False, k=1).count() == 1


def test_rerank_and_vectors(spark):
    ranked = spark.createDataFrame([(1, f"t{i}", i, "q", "x" * (5 - i)) for i in range(1, 5)], "qid int, ref string, rank int, q string, t string")
    order = lambda f, **k: [r["ref"] for r in retrieval.reranked(ranked, "qid", "ref", f, "q", "t", **k).orderBy("rank").collect()]
    assert order(None, keep=2) == ["t1", "t2"] and order(lambda q, t: -F.length(t), head=3) == ["t3", "t2", "t1", "t4"]
    texts = spark.createDataFrame([("a", "doanh thu thuần"), ("b", "hàng tồn kho"), ("c", None)], "ref string, t string")
    vectors = retrieval.encoded(texts, "ref", "t", retrieval.hashing_encoder(32))
    asked = spark.createDataFrame([(1, "Doanh thu THUẦN"), (2, "kho hàng")], "query int, t string")
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (2, "b")], "query int, ref string")
    got = [tuple(r) for r in retrieval.nearest_of(pairs, vectors, "ref", "v", retrieval.encoded(asked, "query", "t", retrieval.hashing_encoder(32)), 1).select("query", "ref").orderBy("query").collect()]
    assert got == [(1, "a"), (2, "b")] and vectors.where("ref = 'c'").first()["v"] == [0.0] * 32


def test_index_is_kept(spark, tmp_path):
    texts = spark.createDataFrame([(1, "doanh thu thuần"), (2, "hàng tồn kho"), (3, None)], "id int, t string")
    retrieval.write_index(retrieval.build_index(texts, "id", "t"), str(tmp_path / "i"))
    again = retrieval.read_index(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([("q", "tồn kho")], "q string, x string")
    assert again.n == 3 and [r["id"] for r in retrieval.search_index(again, asked, "q", "x", 5).collect()] == [2]
    assert retrieval.bm25(texts, "id", "t", asked, "q", "x", 5).first()["score"] == retrieval.search_index(again, asked, "q", "x", 5).first()["score"]


def test_programs_and_items(spark):
    facts = spark.createDataFrame([("A", 2020, "profit_net", "annual", "t", 1, 8.0), ("A", 2020, "rev_net", "annual", "t", 2, 40.0), ("A", 2019, "rev_net", "closing", "t", 3, 30.0)], "ticker string, year int, metric string, period string, table_ref string, row_idx int, value double")
    assert {r["metric"]: r["value"] for r in programs.derived(facts).collect()} == {"ros": 20.0, "net_margin": 20.0}
    asked = spark.createDataFrame([(1, "A", "rev_net", 2020, "annual"), (2, "A", "rev_net", 2020, "closing"), (3, "A", "rev_net", 2015, None), (4, "B", "rev_net", 2020, None), (5, "A", "rev_net", None, "closing")], "id int, ticker string, metric string, year int, period string")
    assert sorted(tuple(r) for r in programs.relaxed(asked, facts).collect()) == [(1, 1, 40.0), (2, 2, 40.0), (3, 3, 40.0), (5, 1, 30.0)]
    values = spark.sql("SELECT * FROM VALUES (array('2.5')), (array()), (array('1','2')), (array('x')), (array('NaN')), (array('Infinity')), (CAST(null AS array<string>)) v(v)").select(submission.coerced(F.col("v")).alias("c")).select("c.*").collect()
    assert [(r["value"], r["error"]) for r in values] == [(2.5, None), (None, "no value"), (None, "2 values"), (None, "no number"), (None, "NaN"), (None, "infinite"), (None, "no value")]
    paths = spark.sql(r"SELECT * FROM VALUES ('data/a.csv'), ('./data/a.csv'), ('x\\y\\a.csv'), ('/root/a.csv') v(p)").select(submission.relative_path(F.col("p"))).collect()
    assert {r[0] for r in paths} == {"data/a.csv"}
    bad = spark.sql("SELECT 1 id, '' question, double('NaN') answer, array('d.txt') relevant_docs, array('x', 'e|2') relevant_tables, array(struct('df1' variable, '/abs.csv' csv_path)) evidence, 'df2' plan")
    broken = {r["rule"] for r in submission.violations(bad, spark.createDataFrame([(2,)], "id int"), spark.createDataFrame([("data/x.csv",)], "csv_path string")).collect()}
    assert broken == {"question_missing", "answer_not_finite", "document_with_suffix", "malformed_table", "table_of_other_document", "path_not_relative", "path_elsewhere", "variable_not_in_plan", "unknown_id", "absent_id", "file_missing"}


def test_judging(spark):
    gold = spark.createDataFrame([(1, ["d"], ["d|1"], 5.0), (2, ["d"], ["d|1"], 5.0), (3, ["d"], ["d|1"], 5.0), (4, ["d"], ["d|1"], 5.0)], "id int, gold_docs array<string>, gold_tables array<string>, gold_answer double")
    found = spark.createDataFrame([(1, ["d"], ["d|1"], 5.0, "p"), (2, ["e"], ["e|1"], 1.0, "p"), (3, ["e", "d"], ["d|1"], 5.0, "")], "id int, docs array<string>, tables array<string>, answer double, plan string")
    rows = {r["id"]: r for r in evaluation.judged(gold, found).collect()}
    assert rows[1]["tags"] == ["SUCCESS"] and rows[2]["tags"] == ["TABLE_MISS", "DOC_MISS", "EXECUTION_ERROR"] and rows[3]["tags"] == ["DOC_BAD_RANK"] and rows[4]["tags"] == ["TABLE_MISS", "DOC_MISS", "QUERY_NO_CODE"]
    assert rows[1]["execution_correct"] and not rows[3]["execution_correct"]
    assert evaluation.report(evaluation.judged(gold, found))["summary"][0]["overall"] == pytest.approx((0.5 + 0.5 + 0.25) / 3, abs=1e-5)
    assert evaluation.judged_summary(evaluation.judged(gold.limit(0), found)).first()["overall"] == 0.0


def test_catalog_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("a|1", "AAA_x_2020", 1)], "table_ref string, doc_id string, ingested_at int")
    where = str(tmp_path / "catalog")
    sinks.write_catalog(rows, where)
    sinks.write_catalog(rows.withColumn("table_ref", F.lit("b|1")), where, "upsert")
    assert sorted(r["table_ref"] for r in spark.read.parquet(where).collect()) == ["a|1", "b|1"]
    sinks.write_catalog(rows, where, "full")
    assert [(r["ticker"], r["year"]) for r in sources.read_catalog(spark, where).collect()] == [("AAA", 2020)]
    with pytest.raises(ValueError):
        sinks.write_catalog(rows, where, "other")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "BBB_y_2019_table_7.csv").write_text("item,2019\nzeta,1\nab,2\nalpha,3\nzeta,4\n", encoding="utf-8")
    rebuilt = sources.read_catalog(spark, str(tmp_path / "none"), str(tmp_path / "t")).first()
    assert rebuilt["table_ref"] == "BBB_y_2019|7" and rebuilt["card"] == "zeta; alpha" and rebuilt["year"] == 2019
    assert set(sinks.catalog_rows(rows).columns) == set(sinks.CATALOG) and len(sinks.CATALOG) == 21
    facts = spark.createDataFrame([("b.csv", 1, "x"), ("a.csv", 0, None), ("b.csv", 0, "y")], "filename string, row_idx int, item string")
    assert [p.rsplit("/", 1)[1] for p in sinks.export_tables(facts, str(tmp_path / "csv"))] == ["a.csv", "b.csv"]
    assert (tmp_path / "csv" / "b.csv").read_text(encoding="utf-8-sig").splitlines() == ["row_idx,item", "0,y", "1,x"]
    sinks.write_json_lines(rows, str(tmp_path / "x.jsonl"))
    assert sources.read_json(spark, str(tmp_path / "x.jsonl")).first()["table_ref"] == "a|1"
    names = spark.sql("SELECT * FROM VALUES ('A_bao_cao_rieng_2020'), ('A_Hop-Nhat'), ('A_2020') v(n)").select(sources.loaded_report_type(F.col("n"))).collect()
    assert [r[0] for r in names] == ["separate", "consolidated", "unknown"]
    texts = spark.createDataFrame([("x/b.txt", "1"), ("x/a.txt", None), ("x/c.txt", "3")], "path string, text string")
    assert [r["doc_id"] for r in sources.documents(texts, 1).collect()] == ["b"]
    strict = spark.createDataFrame([("r", "error", 1)], "rule string, severity string, id int")
    (tmp_path / "r.json").write_text("[]")
    with pytest.raises(ValueError):
        sinks.zip_results(str(tmp_path / "o.zip"), str(tmp_path / "r.json"), [], strict)
