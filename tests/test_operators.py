import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.operators import analysis, evaluation, extraction, normalization, programs, retrieval
from tabulon.sources import documents as sources
from tabulon.sources import sinks
from tabulon.streaming import incremental

PAGE = """===== PAGE 3 =====
Bảng cân dối kế toán riêng lẻ
Đơn vị tính: đồng
<table><tr><td>Chỉ tiêu</td><td>Mã số</td><td>Thuyết minh</td><td>31/12/2020</td><td>01/01/2020</td></tr><tr><td>TÀI SẢN</td><td>100</td><td rowspan=3>V.1</td><td rowspan=3>512.004.870.113108.230.445.917403.774.424.196</td><td rowspan=2>12</td></tr><tr><td>Tiền</td><td>110</td></tr><tr><td>Kho</td><td>120</td><td>5</td></tr></table>
===== PAGE 4 =====
<table><tr><td colspan=2>A</td><td>1</td><td>2</td><td>3</td></tr><tr><td>B&amp;C</td><td>9</td><td>1</td><td>2</td><td>3</td></tr></table>
"""


def test_html_tables(spark):
    rows = extraction.html_tables(spark.createDataFrame([("d", PAGE), ("e", "prose"), ("f", None)], "doc_id string, text string")).orderBy("position").collect()
    assert [(r["position"], r["page"], r["n_cols"], r["is_continuation"]) for r in rows] == [(4, 3, 5, False), (6, 4, 5, True)]
    grid = rows[0]["rows"]
    assert [g[3] for g in grid[1:]] == ["512.004.870.113", "108.230.445.917", "403.774.424.196"]
    assert [g[2] for g in grid[1:]] == ["V.1"] * 3 and [g[4] for g in grid[1:]] == ["12", "12", "5"]
    assert rows[1]["rows"][0] == ["A", "", "1", "2", "3"] and rows[1]["rows"][1][0] == "B&C"
    assert rows[1]["parent_position"] == 4 and rows[0]["next_position"] == 6
    assert "Đơn vị tính: đồng" in rows[0]["context_before"]


def test_figures_are_never_repeated():
    assert extraction.decode_grid("<tr><td>a</td><td rowspan=2>1.234</td></tr><tr><td>b</td></tr>") == [["a", "1.234"], ["b", ""]]


def test_text_tables(spark):
    text = "Báo cáo\n| Chỉ tiêu | 2020 |\n|---|---|\n| Doanh thu | 1.234 |\n| Kho | 5 |\ngiữa\n| Vay | 7 |\n\n\n\nĐoạn văn.\nA\t1\nB\t2\n- 12 -"
    docs = spark.createDataFrame([("d", text), ("e", "chỉ có chữ\nkhông có số")], "doc_id string, text string")
    assert [tuple(r) for r in extraction.dialect_vote(docs).collect()] == [("d", "pipe", 4)]
    assert [tuple(r) for r in extraction.blocks(docs).orderBy("block").collect()] == [("d", 1, 2, 7, 4), ("d", 2, 12, 13, 2)]


def test_clean_line(spark):
    row = spark.createDataFrame([("a\x01b.....c!!!  ",)], "x string").select(extraction.clean_line(F.col("x"))).first()
    assert row[0] == "ab..c!!"


def test_facts(spark):
    rows = [["I. TÀI SẢN", "", "", ""], ["Ngắn hạn", "", "", ""], ["Tiền mặt tại quỹ", "110", "1.000", "(2.000)"], ["Hàng tồn kho các loại", "120", "", "5"], ["", "", "7", "8"]]
    tables = spark.createDataFrame([("x_2020|1", "x_2020", [["Chỉ tiêu", "Mã số", "31/12/2020", "01/01/2020"]], rows)], "table_ref string, doc_id string, header_rows array<array<string>>, rows array<array<string>>")
    years = spark.createDataFrame([("x_2020", 2020)], "doc_id string, year int")
    got = normalization.facts(tables, years).orderBy("row_idx", "column_label").collect()
    assert [(r["item"], r["item_code"], r["year"], r["period"], r["value"]) for r in got] == [
        ("I. TÀI SẢN - Ngắn hạn - Tiền mặt tại quỹ", "110", 2019, "opening", -2000.0), ("I. TÀI SẢN - Ngắn hạn - Tiền mặt tại quỹ", "110", 2020, "closing", 1000.0),
        ("I. TÀI SẢN - Ngắn hạn - Hàng tồn kho các loại", "120", 2019, "opening", 5.0),
    ]
    assert normalization.facts(tables.limit(0), years).count() == 0


def test_column_names(spark):
    heads = spark.createDataFrame([("t", 0, "a  b"), ("t", 1, ""), ("t", 2, "a b"), ("t", 3, None)], "table_ref string, col_idx int, cell string")
    assert [r["name"] for r in normalization.column_names(heads).orderBy("col_idx").collect()] == ["a b", "col_1", "a b_1", "col_3"]


def test_bm25_against_brute_force(spark):
    docs = {1: "doanh thu thuan ban hang", 2: "doanh thu tai chinh doanh thu", 3: "hang ton kho", 4: ""}
    queries = {"q": "doanh thu ban hang", "r": "kho", "s": "khong gi"}
    got = retrieval.bm25(spark.createDataFrame(list(docs.items()), "id int, t string"), "id", "t", spark.createDataFrame(list(queries.items()), "query string, x string"), "query", "x", 10).collect()
    words = {i: t.split() for i, t in docs.items()}
    mean = sum(map(len, words.values())) / 4
    for r in got:
        want = 0.0
        for t in set(queries[r["query"]].split()):
            df = sum(t in w for w in words.values())
            tf = words[r["id"]].count(t)
            want += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words[r["id"]]) / mean))
        assert r["score"] == pytest.approx(want, abs=1e-5)
    assert {(r["query"], r["id"]) for r in got} == {("q", 1), ("q", 2), ("q", 3), ("r", 3)}


@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_nearest_against_numpy(spark, metric):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    vectors = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    queries = vectors.where("vec_id < 3").select(F.col("vec_id").alias("query"), F.col("embedding").alias("v"))
    got = {(r["query"], r["rank"]): r["vec_id"] for r in retrieval.nearest(vectors, "vec_id", "embedding", queries, 5, metric).collect()}
    w = v.astype(float)
    for a in range(3):
        score = w @ w[a] if metric == "ip" else -((w - w[a]) ** 2).sum(1)
        assert [got[a, k + 1] for k in range(5)] == list(np.argsort(-score, kind="stable")[:5])


def test_cascade(spark):
    catalog = spark.createDataFrame([("a|1", "AAA", 2020, "separate"), ("a|2", "AAA", 2021, "consolidated"), ("b|1", "BBB", 2020, None)], "table_ref string, ticker string, year int, report_type string")
    asked = [(1, ["AAA"], [2020], "separate"), (2, ["AAA"], [2020], "consolidated"), (3, ["aaa"], [2010], None), (4, ["CCC"], [2020], None), (5, [], [], None), (6, None, None, None)]
    questions = spark.createDataFrame(asked, "id int, tickers array<string>, years array<int>, report_type string")
    got = sorted((r["id"], r["level"], r["table_ref"]) for r in retrieval.admitted(questions, catalog).collect())
    assert got == [(1, 1, "a|1"), (2, 2, "a|2"), (3, 5, "a|1"), (3, 5, "a|2"), (4, 6, "a|1"), (4, 6, "b|1")]
    classes = sorted((r["id"], r["level"], r["n"]) for r in retrieval.admitted_classes(questions, catalog).collect())
    assert classes == [(1, 1, 1), (2, 2, 1), (3, 5, 1), (3, 5, 1), (4, 6, 1), (4, 6, 1), (5, 7, 3), (6, 7, 3)]
    listed = catalog.withColumn("section", F.when(F.col("table_ref") == "a|1", "notes").otherwise("cash_flow"))
    named = spark.createDataFrame([(3, "notes"), (4, "income_statement")], "id int, section string")
    assert sorted((r["id"], r["table_ref"]) for r in retrieval.admitted(questions, listed, sections=named).collect()) == [(1, "a|1"), (2, "a|2"), (3, "a|1")]
    assert sorted(r["id"] for r in retrieval.unfiltered(questions, catalog).collect()) == [4, 5, 6]


def test_selection(spark):
    pool = spark.createDataFrame([(1, "a", 1, 1.0, "X", "g"), (1, "b", 2, 0.5, "X", None), (1, "c", 3, 0.2, "Y", None), (1, "d", 4, 0.1, "Y", "g")], "qid int, ref string, rank int, score double, ticker string, group_id string")
    chosen = retrieval.cut(pool, "qid", F.lit(3)).select("qid", "ref")
    assert sorted(r["ref"] for r in chosen.collect()) == ["a", "b"]
    needed = spark.createDataFrame([(1, "X"), (1, "Y"), (1, "Z")], "qid int, ticker string")
    assert sorted(r["ref"] for r in retrieval.covering(pool, chosen, needed, "qid", "ref", "ticker").collect()) == ["a", "b", "c"]
    links = pool.withColumn("parent_table_ref", F.when(F.col("ref") == "c", "b")).withColumn("next_table_ref", F.lit(None).cast("string"))
    assert sorted(r["ref"] for r in retrieval.with_linked(chosen, links, "qid", "ref").collect()) == ["a", "b", "c", "d"]


def test_programs(spark):
    rows = [("A", 2019, "x", 10.0), ("A", 2020, "x", 20.0), ("A", 2019, "y", 100.0), ("A", 2020, "y", 0.0), ("B", 2019, "x", 1.0), ("B", 2019, "y", 4.0)]
    facts = spark.createDataFrame(rows, "ticker string, year int, metric string, value double")
    value = lambda *a, **k: {(r["ticker"], r["year"]): r["value"] for r in programs.evaluate(facts, programs.Plan(*a, **k)).collect()}
    assert value("ratio", ("x", "y")) == {("A", 2019): 10.0, ("A", 2020): None, ("B", 2019): 25.0}
    assert value("growth", ("x",), ("A",)) == {("A", 2020): 100.0}
    assert value("cagr", ("x",), ("A",)) == {("A", 2020): pytest.approx(100.0)}
    assert value("argmax", ("x",)) == {("A", 2020): 2020.0, ("B", 2019): 2019.0}
    assert value("peer_share", ("x", "y"), years=(2019,)) == {(None, 2019): pytest.approx(100 / 11)}
    with pytest.raises(ValueError, match="no such operation"):
        programs.evaluate(facts, programs.Plan("other", ("x",)))
    named = spark.createDataFrame([("t", 0, "Tổng tài sản", 2020, 5.0), ("t", 1, "tài sản khác", 2020, 6.0)], "table_ref string, row_idx int, item string, year int, value double")
    assert programs.lookup(named, "Tài Sản", 2020).first()["value"] == 5.0 and programs.lookup(named, "zzz").first()["value"] is None


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, ["a", "b"], 10.0), (2, [], None), (3, ["c"], 0.0), (4, ["d"], 5.0)], "id int, gold_docs array<string>, gold_answer double")
    found = spark.createDataFrame([(1, ["x", "a", "a"], 10.05), (2, [], None), (3, ["y"], 1e-7), (9, ["z"], 1.0)], "id int, docs array<string>, answer double")
    rows = {r["id"]: r for r in evaluation.evaluated(gold, found).collect()}
    assert set(rows) == {1, 2, 3, 4}
    assert (rows[1]["doc_precision"], rows[1]["doc_recall"], rows[1]["doc_mrr"]) == (0.5, 0.5, 0.5) and rows[1]["answer_correct"]
    assert rows[2]["doc_f2"] == 1.0 and rows[2]["answer_correct"] and rows[2]["doc_mrr"] == 0.0
    assert rows[3]["doc_f2"] == 0.0 and rows[3]["answer_correct"]
    assert rows[4]["tags"] == ["NO_DOCUMENT", "MISSING_ANSWER"] and not rows[4]["answer_correct"]


def test_gate(spark):
    catalog = spark.createDataFrame([("a|1", "a", "X"), ("a|1", "a", "X")], "table_ref string, doc_id string, ticker string")
    with pytest.raises(ValueError, match="repeated_keys"):
        evaluation.gate(evaluation.integrity(catalog, spark.createDataFrame([("a", "X")], "doc_id string, ticker string")))


def test_documents_of_files(spark, tmp_path):
    folder = tmp_path / "docs" / "ABC" / "2019" / "ABC_report_2019_consolidated"
    folder.mkdir(parents=True)
    (folder / "ABC_report_2019_consolidated_extracted.txt").write_text("một\nhai", encoding="utf-8")
    (tmp_path / "docs" / "X1Y_2020_separate_extracted.txt").write_bytes(b"caf\xe9")
    rows = {r["doc_id"]: r for r in sources.documents(sources.read_texts(spark, str(tmp_path / "docs"))).collect()}
    a, b = rows["ABC_report_2019_consolidated"], rows["X1Y_2020_separate"]
    assert (a["ticker"], a["year"], a["report_type"], a["n_lines"]) == ("ABC", 2019, "consolidated", 2)
    assert (b["ticker"], b["year"], b["report_type"], b["text"]) == ("X1Y", 2020, "separate", "café")


def test_questions_of_files(spark, tmp_path):
    one, two, three = (tmp_path / n for n in ("a.json", "b.json", "c.jsonl"))
    one.write_text(json.dumps([{"id": 1, "question": "x"}]))
    two.write_text(json.dumps({"questions": [{"id": 1, "question": "x"}]}))
    three.write_text('{"id": 1, "question": "x"}\n\n')
    for path in (one, two, three):
        assert [tuple(r) for r in sources.read_questions(spark, str(path)).select("id", "question").collect()] == [(1, "x")]


def test_upsert_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "table_ref string, ingested_at int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("c", 1, "w")], "table_ref string, ingested_at int, v string")
    assert sorted((r["table_ref"], r["v"]) for r in sinks.upserted(old, new).collect()) == [("a", "z"), ("b", "y"), ("c", "w")]
    sinks.write_json(old.orderBy("table_ref"), str(tmp_path / "out.json"))
    assert [r["v"] for r in json.loads((tmp_path / "out.json").read_text())] == ["x", "y"]
    (tmp_path / "t.csv").write_text("a\n1\n")
    sinks.zip_results(str(tmp_path / "o.zip"), str(tmp_path / "out.json"), [str(tmp_path / "t.csv")] * 2)
    facts = spark.createDataFrame([("A", 2020, 1.0)], "ticker string, year int, value double")
    sinks.write_facts(facts, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts")).count() == 1


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("a", 1, "x")], "k string, t int, v string").write.parquet(source)
    incremental.advance(spark, source, folder)
    spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string").write.mode("append").parquet(source)
    incremental.advance(spark, source, folder)
    rows = sinks.latest(spark.read.parquet(f"{folder}/batches").drop("batch"), "k", "t").collect()
    assert sorted((r["k"], r["v"]) for r in rows) == [("a", "y"), ("b", "z")]
    assert spark.read.parquet(f"{folder}/batches").count() == 3


def test_windowed_counts(spark):
    events = spark.sql("SELECT timestamp'2024-01-01 00:01:00' t, 'a' k UNION ALL SELECT timestamp'2024-01-01 00:04:00', 'a' UNION ALL SELECT timestamp'2024-01-01 00:06:00', 'a'")
    assert sorted(r["n"] for r in incremental.windowed_counts(events, "t", "k").collect()) == [1, 2]


def test_terms_longest_first():
    terms = (("doanh thu", "a"), ("doanh thu thuan", "b"), ("thuan", "c"), ("thu", "d"))
    assert [k for k, *_ in analysis.spans("Doanh thu thuần và thu khác, doanh thu", terms)] == ["b", "d", "a"]
    assert analysis.spans("thuần", terms) == [("c", 0, 5)] and analysis.spans("thuanx", terms) == [] and analysis.spans(None, terms) == [] and analysis.spans("x", ()) == []


def test_question_metrics(spark):
    questions = spark.createDataFrame([(1, "ROE và doanh thu của AAA?"), (1, "ROE và doanh thu của AAA?"), (2, None), (3, "gì?")], "id int, question string")
    terms = spark.createDataFrame([("sales", "Doanh thu", False), ("roe", "ROE", True), (None, "x", False), ("y", None, None)], "metric string, surface string, is_derived boolean")
    got = {r["id"]: (r["metrics"], r["needs_derived"]) for r in analysis.metrics(questions, terms).collect()}
    assert got == {1: (["roe", "sales"], True), 2: ([], False), 3: ([], False)}
    assert {tuple(r["metrics"]) for r in analysis.metrics(questions, terms.limit(0)).collect()} == {()}


def test_content_order_keeps_the_tail(spark):
    rows = [(1, f"t{i:02}", i, 1.0 / i, 0 if i != 35 else 8) for i in range(1, 41)]
    got = {r["table_ref"]: r for r in retrieval.content_ordered(spark.createDataFrame(rows, "qid int, table_ref string, rank int, score double, content int"), "qid", "table_ref").collect()}
    assert len(got) == 40 and got["t35"]["rank"] == 1 and got["t01"]["rank"] == 2
    assert [got[f"t{i}"]["rank"] for i in range(36, 41)] == [36, 37, 38, 39, 40] and got["t36"]["content"] is None


def test_cash_flow_score(spark):
    rows = [("Số dư cuối năm là bao nhiêu?", "luu chuyen tien thuan", None, -10), ("Dòng tiền cuối năm?", "x", "cash_flow", 6), ("Quý 4 là bao nhiêu đồng tiền?", "x", "cash_flow", 0), ("Quỹ khen thưởng?", "x", "cash_flow", -10), ("Số dư?", "x", None, 0), (None, None, None, 0)]
    df = spark.createDataFrame(rows, "q string, t string, s string, want int")
    assert df.where(retrieval.cash_flow_score(F.col("q"), F.col("t"), F.col("s")) != F.col("want")).count() == 0


def test_content_order_has_every_candidate(spark, small):
    from tabulon.operators import queries

    want = spark.read.parquet(f"{small}/candidates.parquet").select("qid", "table_ref").distinct()
    got = queries.queries()["content_order"](spark, small)
    assert got.count() == want.count() == got.join(want, ["qid", "table_ref"]).count()


def test_hybrid_search_without_a_known_code(spark, small, tmp_path):
    from tabulon.operators import queries

    for name in ("table_catalog", "candidates", "questions"):
        df = spark.read.parquet(f"{small}/{name}.parquet")
        if name == "questions":
            ids = [r["id"] for r in df.select("id").distinct().orderBy("id").limit(2).collect()]
            df = df.where(F.col("id").isin(ids)).withColumn("tickers", F.array(F.lit("NONE"))).withColumn("years", F.when(F.col("id") == ids[0], F.array(F.lit(2020))).otherwise(F.array().cast("array<int>")))
        if name == "candidates":
            df = df.limit(0)
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    got = queries.queries()["hybrid_search"](spark, str(tmp_path)).join(spark.read.parquet(f"{tmp_path}/table_catalog.parquet").select("table_ref", "year").distinct(), "table_ref")
    years = {q: {r["year"] for r in got.where(F.col("qid") == q).collect()} for q in ids}
    assert years[ids[0]] == {2020} and len(years[ids[1]]) > 1
