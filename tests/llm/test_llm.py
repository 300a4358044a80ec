import bisect
import random
import unicodedata
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import lookalikes
from tabulon.llm import boosting, canonical, markup, matching, noise, packing, quality, queries, ranking, repeats, tokens

LONG = "dài " * 50_000


# --- canonical text


def test_canonical_forms(spark):
    texts = [("a", "Соng ty"), ("b", "bình thường"), ("c", None), ("d", ""), ("e", "Волна β"), ("f", LONG + "​"), ("g", "ﬁn Ⅳ"), ("b", "bình thường"), ("h", "ﬁn Ⅳ")]
    df = spark.createDataFrame([(*t, "x", "y") for t in texts], "k string, t string, text string, form string")
    forms = {r["k"]: r["out"] for r in canonical.with_canonical(df, "t", "out").select("k", "out").collect()}
    assert forms["a"] == "Cong ty" and forms["b"] == "bình thường" and forms["c"] is None and forms["d"] == "" and forms["e"] == "Волна β" and forms["f"] == LONG and forms["g"] == "fin IV"
    assert sorted(r["k"] for r in canonical.changed(df, "t").collect()) == ["a", "f", "g", "h"]
    assert canonical.changed(df.limit(0), "t").count() == 0


def test_segments_equal_whole_normalization():
    rng = random.Random(3)
    pieces = list("abc éộ") + ["o\u0302\u0323", "e\u0301", "\u0301", "가", "\u1100\u1161", "\u0344", "Å", "ự"]
    for _ in range(500):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert lookalikes.canonical(t) == unicodedata.normalize("NFC", t)


def test_jvm_quick_check_misses_nothing(spark):
    points = [c for c in range(0x20, 0x3100) if lookalikes.UNSTABLE.match(chr(c))] + [0xFB01, 0xFEFF, 0xFF21]
    df = spark.createDataFrame([(chr(c),) for c in points], "t string")
    assert df.where(~canonical.unstable(F.col("t"))).count() == 0


# --- matching

ENTRIES = [("net_sales", "Doanh thu thuần bán hàng"), ("net_sales", "Net sales of goods"), ("gross", "Lợi nhuận gộp bán hàng"), ("cash", "Tiền và tương đương tiền"), ("a1", "twin entry one"), ("a2", "twin entry one")]


@pytest.mark.parametrize(
    ("value", "hint", "want"),
    [("DOANH THU THUAN BAN HANG", None, "net_sales"), ("DT thuần bán hàng (*)", None, "net_sales"), ("bán hàng, Doanh thu thuần", None, "net_sales"), ("Doanh tuh thuần bán hng", None, "net_sales"),
     ("Doanhthuthuần bán hàng năm 2020", None, "net_sales"), ("net sales of go...", None, "net_sales"), ("số con bò", None, "unmatched"), (None, None, "unmatched"), ("", None, "unmatched"), ("???", None, "unmatched"),
     ("twin entry one", "A2", "a2"), ("twin entry one", None, "a1"), ("tương đương tiền - Tiền và", None, "cash"), ("zzz", "gross", "gross"), (LONG, None, "unmatched")],
)
def test_match(value, hint, want):
    assert matching.TermTrie(ENTRIES).match(value, hint) == want


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _spans(value):
    """The runs of whole words of a value, without separators."""
    words = matching._letters(matching.fold(value))
    return {"".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}


def _brute_near(value, entries):
    """(errors, letters, key) of every entry within its distance of a run of words of value."""
    out = {}
    for e in entries:
        best = min((_levenshtein(s, e) for s in _spans(value)), default=99)
        if best <= matching.allowed(len(e)):
            out[e] = (best / len(e), -len(e))
    return sorted((*v, k) for k, v in out.items())


def test_automaton_against_brute_force():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(5, 26))) for _ in range(60)]
    trie = matching.TermTrie([(w, w) for w in words], {})
    values = []
    for _ in range(150):
        base = list(rng.choice(words) + (" " + rng.choice(words) if rng.random() < 0.4 else ""))
        for _ in range(rng.randrange(5)):
            base[rng.randrange(len(base))] = rng.choice("abcd")
        values.append("".join(base))
    for value, found in zip(values, trie.near(values), strict=True):
        want = _brute_near(value, words)
        assert found == want if want else all(f[1] <= -matching._CUT for f in found), value


def test_walk_on_typed_terms(small):
    """The entries found for a sample of the project's own values are those that brute force finds."""
    import duckdb

    entries = duckdb.sql(f"SELECT metric, surface FROM '{small}/metric_terms.parquet'").fetchall()
    values = [r[0] for r in duckdb.sql(f"SELECT DISTINCT surface FROM '{small}/term_matches.parquet' WHERE surface IS NOT NULL ORDER BY 1 LIMIT 20").fetchall()]
    trie = matching.TermTrie(entries, {})
    paths = {}
    for k, s in entries:
        words = matching._letters(matching.fold(s))
        for i in range(len(words)):
            paths.setdefault("".join(words[i:] + words[:i]), set()).add(k)
    windows = [w for i, v in enumerate(values) for w in trie._windows(i, matching.fold(v))]
    got = {}
    for i, key, letters, e in trie._walk(windows, trie.most):
        got.setdefault(i, set()).add((trie.keys[key], letters, e))
    for i, v in enumerate(values):
        want = {(k, len(e), round(share * len(e))) for share, _, e in _brute_near(v, paths) for k in paths[e]}
        assert got.get(i, set()) == want, v


def test_windows_of_long_values():
    entries = [("x", "alpha beta gamma"), ("y", "delta epsilon zeta eta theta"), ("z", "q" * 70)]
    trie = matching.TermTrie(entries, {})
    rng = random.Random(1)
    filler = ["".join(rng.choice("mnopr") for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    for at in range(0, 60, 7):
        words = filler[:at] + ["alpha", "betta", "gamma"] + filler[at:]
        assert [f[2] for f in trie.near([" ".join(words)])[0]] == ["x"]
    assert [f[2] for f in trie.near([" ".join(filler) + " " + "q" * 69])[0]] == ["z"]
    assert trie.near(["m" * 500 + " alpha beta gamma"])[0][0][2] == "x"


def test_words_cut_short():
    trie = matching.TermTrie([*ENTRIES, ("r", "phí " * 30 + "cuối")])
    assert trie.match("D. thu thuần b. hàng") == "net_sales" and trie.match("tương đ. tiền và tiền") == "cash"
    assert trie.match("thu. b. x.") == "unmatched"


def test_many_aliases_of_one_entry():
    trie = matching.TermTrie([("k", "chi phí " * 40)])
    assert trie.match("cp " * 39 + "chi phí") == "k" and len(trie.count) < 100_000


def test_map_to_entries(spark):
    values = spark.createDataFrame([(1, "Net sales of goods", "k"), (1, "Net sales of goods", "k"), (2, None, None), (3, "khác hẳn", "k")], "id int, v string, entry string")
    entries = spark.createDataFrame([*ENTRIES, (None, "x"), ("y", None)], "key string, surface string")
    got = matching.map_to_entries(values, entries, "v")
    assert got.columns == ["id", "v", "entry"]
    assert sorted((r["id"], r["entry"]) for r in got.collect()) == [(1, "net_sales"), (1, "net_sales"), (2, "unmatched"), (3, "unmatched")]
    assert {r["entry"] for r in matching.map_to_entries(values, entries.limit(0), "v").collect()} == {"unmatched"}
    assert matching.map_to_entries(values.limit(0), entries, "v").count() == 0
    clash = values.select("id", F.col("v").alias("_v"), F.lit("x").alias("v"), F.lit(1).alias("key"), F.lit(2).alias("_row"))
    assert sorted((r["id"], r["entry"]) for r in matching.map_to_entries(clash, entries, "_v").collect())[0] == (1, "net_sales")


def test_shards_equal_one_trie(spark):
    """A list in several tries gives what one trie gives: the nearest of all, and the record's own key wherever it stands."""
    entries = [("far", "doanh thu thuan ban hamg"), ("right", "doanh thu thuan ban hang"), *((f"k{i}", f"khoan muc so {i:04d} khac") for i in range(30)), *ENTRIES[1:]]
    listed = spark.createDataFrame(entries, "key string, surface string")
    values = [("doanh thu thuan ban hang", None), ("doanh thu thuan ban hang", "FAR"), ("khoan muc so 0007 khac", "k8"), ("Net sales of goods", "right"), ("hoàn toàn lạ", "K-9"), ("twin entry one", "a2"), (None, "k1"), ("khoan muc so 00017 khác", None)]
    df = spark.createDataFrame(values, "v string, h string")
    trie = matching.TermTrie(entries)
    want = sorted((str(v), str(h), trie.match(v, h)) for v, h in values)
    assert ("doanh thu thuan ban hang", "None", "right") in want and ("doanh thu thuan ban hang", "FAR", "far") in want
    for most in (1_000, 12):
        got = matching.map_to_entries(df, listed, "v", "h", most_entries=most).collect()
        assert sorted((str(r["v"]), str(r["h"]), r["entry"]) for r in got) == want


# --- markup

MARKED = [
    "<p>chữ</p>", "chữ **đậm** ở đây", "## Đầu mục", "`mã` ngắn", "[chữ](https://a.example/x)", "![hình](x.png)", "tỷ[^3] đồng", "> trích", "- [x] xong", "~~bỏ~~", "'''đậm'''", "[[chữ|khác]]", "{{mẫu|1}}",
    "== Mục ==", "[https://a.example chữ]", "\\section{chữ}", "\\textbf{chữ}", "{\\bf chữ}", "$x_{t}$ là", "\\[ a = b \\]", "cuối dòng \\\\", "a&nbsp;b", "&#225;", "x<br/>", "__chữ__", "*chữ* thường", "a~\\cite{b}", "<!-- ghi chú -->", "\\hline",
]
PLAIN = [
    "- mục", "+ mục", "* mục", "1. mục", "a) mục", "5 * 3 * 2 {A} [B]", "<Không áp dụng>", "B01_DN_HN", "#12/TT200", "(*) R&D", "$1.5 mỗi kg, cao hơn $1.2", "C:\\bctc\\luu_tru", "~/bctc/quy_4 a_b_c.csv", "x < 7% và y > 9%",
    "a ==> b", "| a | b |", "|---|---|", "===== PAGE 3 =====", "<table><tr><td>1</td></tr></table>", "", "owners' equity", "[1] và [2]", "nhóm <= 2% >= 0,4%", "Trang 9 | AAAN", "t~rước",
]


@pytest.mark.parametrize("line", MARKED)
def test_marked(line):
    assert markup.marked(line) == [1]


@pytest.mark.parametrize("line", PLAIN)
def test_plain(line):
    assert markup.marked(line) == []


def test_markup_over_lines():
    text = "một <div\n  class='x'>\nhai\n```python\nx = a ** b ** c\n```\n{| class=x\n|-\n| a || b\n|}\n\\begin{equation}\nx_{t} = 1\n\\end{equation}\nba <td colspan=2\nbốn > năm\n<!-- sáu\nbảy -->\ntám <!-- chín"
    assert markup.marked(text) == [1, 2, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 18]
    clean = markup.clean(text).split("\n")
    assert "x = a ** b ** c" in clean and "x_{t} = 1" in clean and "| a | b |" in clean and "bốn > năm" in clean


def test_clean_is_stable():
    for line in [*MARKED, *PLAIN]:
        once = markup.clean(line)
        if not any(s in once for s in ("$", "\\[", "# ")):
            assert markup.clean(once) == once


def test_found_markup(spark):
    docs = spark.createDataFrame([("d", "a\n<b>x</b>", 1), ("d", "a\n<b>x</b>", 1), ("e", None, 2), ("f", "", 3), ("g", LONG, 4)], "doc_id string, text string, line_no int")
    assert [tuple(r) for r in markup.found_lines(docs).collect()] == [("d", 2, 0)]
    tables = spark.createDataFrame([("t", [["a", "<b>1</b>"], None, [None, "'''2\n3'''"]]), ("t", [["a", "<b>1</b>"], None, [None, "'''2\n3'''"]]), ("u", None), ("v", [])], "table_ref string, rows array<array<string>>")
    assert sorted(tuple(r) for r in markup.found_cells(tables).collect()) == [("t", 1, 2), ("t", 3, 2)]
    assert markup.found_lines(docs.limit(0)).count() == 0
    assert {r["doc_id"]: r["text"] for r in markup.cleaned(docs).collect()}["e"] is None


# --- text that pages repeat


def test_suffix_array_against_sorting():
    rng = random.Random(8)
    for _ in range(60):
        t = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 60))])
        assert list(repeats.suffix_array(t)) == sorted(range(len(t)), key=lambda i: list(t[i:]))
    assert not len(repeats.suffix_array(np.zeros(0, int)))


def test_repeats_against_brute_force():
    rng = random.Random(9)
    for _ in range(60):
        tokens, page = [], []
        for p in range(rng.randrange(1, 5)):
            own = [rng.randrange(3) for _ in range(rng.randrange(25))]
            tokens += [*own, -len(tokens) - len(own) - 1]
            page += [p] * (len(own) + 1)
        t, w, n = np.array(tokens), np.array(page), len(tokens)
        want = np.zeros(n, bool)
        for i in range(n - 3):
            if any(page[j] < page[i] and tokens[j : j + 4] == tokens[i : i + 4] and len(tokens[i : i + 4]) == 4 for j in range(i)):
                want[i : i + 4] = True
        assert (repeats.repeats(t, w, repeats.suffix_array(t), 4) == want).all()


def test_boilerplate(spark):
    head, legal = "Công ty Gạch Ngói - Báo cáo năm {}", "Số liệu này chỉ để tham khảo và không thay cho báo cáo đã được kiểm toán của công ty."
    pages = [f"===== PAGE {p} =====\n{head.format(2020)}\n\nĐoạn riêng của trang với số {p} và vài chữ khác {'nữa ' * p}.\n\n{legal}\n\n- Tiền gửi ngân hàng trong kỳ này\n| a | b | c | d | e |\n\nCuối trang, xem phần {p}\n{p} của báo cáo thường niên này" for p in (1, 2, 3)]
    kept = repeats.without_boilerplate("\n".join(pages))
    assert kept.count(head.format(2020)) == 1 and kept.count(legal) == 1 and kept.count("- Tiền gửi") == 3 and kept.count("| a | b |") == 3 and kept.count("Đoạn riêng") == 3 and kept.count("===== PAGE") == 3
    assert kept.count("báo cáo thường niên") == 1
    assert repeats.without_boilerplate(None) is None and repeats.without_boilerplate("") == "" and repeats.without_boilerplate(legal + "\n" + legal) == legal + "\n" + legal
    docs = spark.createDataFrame([("a", "\n".join(pages)), ("b", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["text"] for r in markup.cleaned(docs).collect()}["a"].count(legal) == 1


# --- ranking


def test_inverse_normal(spark):
    ps = [0.0005, 0.02, 0.1, 0.5, 0.77, 0.975, 0.9999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(ranking.inverse_normal(F.col("p"))).collect()
    assert [r[0] for r in got] == [pytest.approx(NormalDist().inv_cdf(p), abs=1e-7) for p in ps]


def _rows():
    rng = random.Random(2)
    return [(g, f"t{i}", rng.choice([None, 1.0, 2.0, rng.random()]), rng.random() * 1000) for g in (1, 2, 3) for i in range(g * 30)]


def _brute(rows):
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        z = []
        for c in (2, 3):
            v = [float("-inf") if r[c] is None else r[c] for r in own]
            z.append([NormalDist().inv_cdf((sum(a < b for a in v) + sum(a == b for a in v) / 2) / len(v)) for b in v])
        order = sorted(range(len(own)), key=lambda i: (-round((z[0][i] + z[1][i]) / 2, 9), own[i][1]))
        out |= {(g, own[i][1]): k for k, i in enumerate(order, 1)}
    return out


@pytest.mark.parametrize("rows_in_a_task", [200_000, 50, 10])
def test_fused_against_brute_force(spark, rows_in_a_task):
    """One order, whether no, some or all groups are ranked in slices."""
    rows = _rows()
    df = spark.createDataFrame([(*r, "clash") for r in [*rows, *rows]], "qid int, ref string, a double, b double, combined string")
    fused = ranking.fused(df, "qid", "ref", {"a": (F.col("a"), 1.0), "b": (F.col("b"), 1.0)}, rows_in_a_task)
    got = {(r["qid"], r["ref"]): r["position"] for r in ranking.ordered(fused, "qid", "ref", rows_in_a_task).collect()}
    want = _brute(rows)
    assert got == want
    assert {(r["qid"], r["ref"]) for r in ranking.first_of(fused, "qid", "ref").collect()} == {k for k, v in want.items() if v == 1}


def test_slices_hold_no_more_than_a_task(spark):
    """A group far above the bound is cut by its size, with its nulls and its most frequent value apart from the order."""
    rows = [(1, f"t{i}", None if i % 3 == 0 else 5.0 if i % 3 == 1 else float(i)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g int, i string, a double").withColumn("_n", F.lit(6000))
    edges = df.groupBy("g").agg(ranking._edges("a", 100).alias("e")).first()["e"]
    held = [sum(1 for r in rows if r[2] is not None and lo < r[2] <= hi) for lo, hi in zip([5.0, *[e for e in edges if e > 5]], [*[e for e in edges if e > 5], 1e9], strict=True)]
    assert max(held) <= 300
    got = {r["i"]: r["p_a"] for r in ranking.sliced_percentiles(df, "g", ["a"], 100).collect()}
    values = sorted(float("-inf") if r[2] is None else r[2] for r in rows)
    for _, i, a in rows:
        v = float("-inf") if a is None else a
        assert got[i] == pytest.approx((bisect.bisect_left(values, v) + bisect.bisect_right(values, v)) / 2 / 6000)


def test_fused_of_nothing(spark):
    df = spark.createDataFrame([], "qid int, ref string, a double")
    assert ranking.fused(df, "qid", "ref", {"a": (F.col("a"), 1.0)}).count() == 0
    one = spark.createDataFrame([(1, "x", None), (None, "y", 1.0)], "qid int, ref string, a double")
    assert [(r["qid"], r["combined"]) for r in ranking.fused(one, "qid", "ref", {"a": (F.col("a"), 1.0)}).collect()] == [(1, 0.0)]


# --- tokens

TEXTS = [None, "", " ", "  two  spaces ", "a\n b\t\tc", "Doanh thu thuần 1.234.567 đồng", "<|endoftext|> x", "👩‍👩‍👧 emoji 📈.", "x" * 5000, "e\u0301 ệ", "\r\n\r\n", "it's we'll", "\u3000 a", "tab\t end "]


def test_ids_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/{tokens.TOKENIZER}")
    whole.encode_special_tokens = True
    rng = random.Random(4)
    mixed = ["".join(rng.choice(["a", "ờ", " ", "  ", "\n", "1", ",", "'s", "\t", "\u00a0", "."]) for _ in range(rng.randrange(60))) for _ in range(300)]
    every = [*TEXTS, *mixed, *TEXTS]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(every)], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df).collect()}
    assert got == {i: whole.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(every)}
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count(df).collect()} == {i: len(x) for i, x in got.items()}
    assert {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df)).collect()} == {i: t or "" for i, t in enumerate(every)}
    for r in tokens.offsets(df).collect():
        text = every[r["doc_id"]] or ""
        assert r["ids"] == got[r["doc_id"]] and len(r["starts"]) == len(r["ends"]) == len(r["ids"])
        if text:
            assert r["starts"][0] == 0 and r["ends"][-1] == len(text) and all(a <= b for a, b in zip(r["starts"][1:], r["ends"], strict=False))
    assert tokens.encode(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"])
def test_every_public_tokenizer(spark, name, small):
    """Ids of any file are those that its library gives, whatever its split."""
    import duckdb

    path = f"{tokens.TOKENIZER_DIR}/{name}"
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        ids = lambda t: whole.encode(t, add_special_tokens=False).ids
    elif name.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        ids = tiktoken.Encoding("t", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    else:
        import sentencepiece

        ids = sentencepiece.SentencePieceProcessor(model_file=path).encode
    texts = [*TEXTS, *(r[0] for r in duckdb.sql(f"SELECT text FROM '{small}/documents.parquet' ORDER BY doc_id").fetchall())]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(df, name=name).collect()}
    assert got == {i: list(ids(t)) if t else [] for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df, name=name), name=name).collect()}
    assert back[5].strip().lower() == texts[5].lower() if name != "word_bpe_49k.json" else back[5].startswith("doanh thu thuần 1 . 2 3 4")
    if name.endswith(".json"):
        assert all(len(r["starts"]) == len(r["ids"]) for r in tokens.offsets(df.limit(20), name=name).collect())


# --- packing


def _check(spark, sizes, capacity):
    got = packing.pack(spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container string"), capacity).collect()
    filled: dict[int, int] = {}
    pieces: dict[int, list] = {}
    for r in got:
        filled[r["container"]] = filled.get(r["container"], 0) + r["size"]
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["size"]))
    assert max(filled.values(), default=0) <= capacity
    assert sorted(filled) == list(range(len(filled)))
    for i, s in enumerate(sizes):
        own = sorted(pieces.get(i, []))
        assert sum(x[2] for x in own) == (s or 0)
        assert len(own) == (0 if not s else -(-s // capacity) if s > capacity else 1)
        assert [x[1] for x in own] == [k * capacity for k in range(len(own))]
    return len(filled)


def test_pack(spark):
    rng = random.Random(6)
    sizes = [rng.choice([0, None, 1, 2, 3, 50, 97, rng.randrange(1, 250)]) for _ in range(700)]
    used = _check(spark, sizes, 100)
    rests = [s % 100 if s > 100 else s for s in sizes if s]
    assert used <= -(-sum(s for s in sizes if s) // 100) + 0.02 * len(rests) + 1
    assert _check(spark, [], 100) == 0 and _check(spark, [None, 0], 100) == 0 and _check(spark, [100, 100], 100) == 2 and _check(spark, [60, 40, 30, 30, 40], 100) == 2


def test_pack_with_hot_sizes_in_slices(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    assert _check(spark, [3] * 300 + [7] * 300 + [10] * 50, 10) == 350


def test_slices_change_no_container(spark, monkeypatch):
    """Which container an item goes to does not depend on how its size is split."""
    df = spark.createDataFrame([(i, 1 + i % 9) for i in range(400)] + [(1000 + i, 25) for i in range(40)], "doc_id long, n_tokens long")
    placed = []
    for most in (200_000, 30, 7):
        monkeypatch.setattr(packing, "GROUP_ROWS", most)
        placed.append(sorted(tuple(r) for r in packing.pack(df, 10).collect()))
    assert placed[0] == placed[1] == placed[2]


def test_plan_is_exact_where_it_can_be():
    assert sum(n for n, _ in packing.plan({5: 10, 3: 10, 2: 10}, 10)) == 10
    assert sum(n for n, _ in packing.plan({1000: 1}, 2048)) == 1


# --- noise


@pytest.fixture(scope="module")
def reader():
    rng = random.Random(8)
    nouns = ["doanh thu", "chi phí", "lợi nhuận", "tài sản", "nguồn vốn", "hàng tồn"]
    words, pairs, lines = {}, {}, {}
    for _ in range(4000):
        text = f"Công ty đã ghi nhận {rng.choice(nouns)} trong năm {rng.randrange(2010, 2020)} theo báo cáo của ban điều hành và được kiểm toán đầy đủ"
        chunks = ["<s>", *(noise.core(c) for c in text.split()), "</s>"]
        for c in chunks:
            words[c] = words.get(c, 0) + 1
        for a, b in zip(chunks, chunks[1:], strict=False):
            pairs[f"{a} {b}"] = pairs.get(f"{a} {b}", 0) + 1
    lines["BÁO CÁO THƯỜNG NIÊN #"] = (40, 38, 2)
    lines["KẾ HOẠCH NĂM TỚI"] = (40, 5, 5)
    lexicon = noise.Lexicon(words, pairs, lines)
    lexicon.settle()
    lexicon.train()
    lexicon.train_joins()
    return noise.Reader(lexicon)


NOISY = [
    "Công ty đã ghi nh~ận doanh thu trong năm 2012", "Công ty đã 9hi nhận doanh thu trong năm 2012", "Công ty đã ghi nhạn doanh thu trong năm", "theo báo cáo cúa ban điều hành", "Công ty đã ghi nhậndoanh thu trong năm",
    "theo bá o cáo của ban điều hành", "theo báo cáo cỦa ban điều hành",
]


@pytest.mark.parametrize("line", NOISY)
def test_noisy_lines(reader, line):
    assert reader.lines(line) == {1}


def test_clean_lines(reader):
    assert reader.lines("Công ty đã ghi nhận doanh thu trong năm 2012\ntheo báo cáo của ban điều hành\nXyztqw Krmnop\nKẾ HOẠCH NĂM TỚI") == set()
    assert reader.lines("các năm 2019-\n2021 theo báo cáo") == set()


def test_pages(reader):
    text = "===== PAGE 7 =====\nBÁO CÁO THƯỜNG NIÊN 2020\nKẾ HOẠCH NĂM TỚI\n2019\ntheo báo cáo của ban điều hà-\nnh và được kiểm toán\n. ~ ' |\n[7]\n===== PAGE 8 =====\n| a | 1~2 |\n7/9"
    assert reader.lines(text) == {2, 5, 7, 8, 11}
    fixed = reader.repair(text)
    assert "điều hành và" in fixed and "[7]" not in fixed and "THƯỜNG NIÊN" not in fixed and "| a | 1~2 |" in fixed


def test_repair(reader):
    assert reader.repair("Công ty đã ghi nh~ận doanh thu") == "Công ty đã ghi nhận doanh thu"
    assert reader.repair(None) is None and reader.repair("") == ""


@pytest.mark.parametrize(("cell", "column", "want"), [("1.234", 2, False), ("1.2S4", 2, True), ("(l.234)", 2, True), ("|12", 2, True), ("V.12", 1, False), ("B01", 1, False), ("242a", 1, False), ("-", 2, False), ("n/a", 3, False), ("", 2, False), ("12.~345", 2, True)])
def test_cells(reader, cell, column, want):
    assert reader.cell(cell, column, 4) is want


def test_one_edit():
    rng = random.Random(3)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(2))
        if a != b:
            assert noise._one_edit(a, b) == (_levenshtein(a, b) == 1), (a, b)


def test_found_noise(spark):
    docs = spark.createDataFrame([("d", "chữ s~ai ở đây", 1), ("d", "chữ s~ai ở đây", 1), ("e", None, 1), ("f", "", 1), ("g", LONG, 1)], "doc_id string, text string, col_no int")
    tables = spark.createDataFrame([("t", [["Trang 3", ""], ["x", "1.2S4"], None, [None, "1"]]), ("u", None), ("v", [])], "table_ref string, rows array<array<string>>")
    shared = spark.sparkContext.broadcast(noise.lexicon(docs, tables))
    assert [tuple(r) for r in noise.found_lines(spark, docs, shared).collect()] == [("d", 1, 0)]
    cells = spark.createDataFrame([("t", [["Trang 3", ""], ["x", "y", "1.2S4"], None, [None, "1"]]), ("u", None), ("v", [])], "table_ref string, rows array<array<string>>")
    assert sorted(tuple(r) for r in noise.found_cells(spark, cells, shared).collect()) == [("t", 1, 1), ("t", 2, 3)]
    empty = spark.sparkContext.broadcast(noise.lexicon(docs.limit(0), tables.limit(0)))
    assert noise.found_lines(spark, docs, empty).count() == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [("Công ty đã ghi $x_{t-3}$ nh~ận doanh thu\ntrong năm (\\(g^{2} \\leq 3\\)), theo báo cáo", "Công ty đã ghi $x_{t-3}$ nhận doanh thu trong năm (\\(g^{2} \\leq 3\\)), theo báo cáo"),
     ("- $a_1$", "- $a_1$"), ("- doanh thu $a_1$\\(b_2\\) trong năm", "- doanh thu $a_1$\\(b_2\\) trong năm"), ("theo báo cáo\n$x_1$ - của ban", "theo báo cáo $x_1$ - của ban"), ("theo bá $x_1$ o cáo của", "theo bá $x_1$ o cáo của")],
)
def test_repair_keeps_formulas(reader, text, want):
    assert reader.repair(text) == want


@pytest.mark.parametrize(
    ("cell", "column", "want"),
    [("1.2S4", 2, "1.254"), ("(3.038.S77.551.78o)", 2, "(3.038.577.551.780)"), ("193.848*.722'", 3, "193.848.722"), ("28.3|5", 2, "28.315"), ("|153.059", 2, "153.059"), ("4^56", 1, "456"), ("V.~01", 1, "V.01"), ("1.234", 2, "1.234"),
     ("12a", 1, "12a"), ("n/a", 2, "n/a"), (None, 2, None), ("", 0, ""), ("theo báo cáo cúa ban điều hành", 0, "theo báo cáo của ban điều hành"), ("Công ty đã ghi nhậndoanh thu", 0, "Công ty đã ghi nhận doanh thu"),
     ("- theo bá o cáo của ban", 0, "- theo báo cáo của ban"), ("Công ty đã ghi nh-\nận doanh thu", 0, "Công ty đã ghi nhận doanh thu"), ("Công ty\nđã ghi nh~ận", 0, "Công ty\nđã ghi nhận")],
)
def test_repair_of_cells(reader, cell, column, want):
    assert reader.repair_cell(cell, column) == want


def test_repaired_cells(spark):
    tables = spark.createDataFrame([("t", [["Trang 3", ""], ["x", "12", "1.2S4"], None, [None, "1"]]), ("u", None), ("v", [])], "table_ref string, rows array<array<string>>")
    shared = spark.sparkContext.broadcast(noise.Lexicon({}, {}, {}))
    got = [tuple(r) for r in noise.repaired_cells(tables, shared).collect()]
    assert sorted(got, key=lambda r: r[:3]) == [("t", 2, 1, "x"), ("t", 2, 2, "12"), ("t", 2, 3, "1.254"), ("t", 4, 1, None), ("t", 4, 2, "1")]


@pytest.mark.parametrize(("cell", "want"), [("2.090<sup>1</sup>", "2.090"), ("31/12/2024<sup>(1)</sup>\n<b>đồng</b>", "31/12/2024\nđồng"), ("m<sup>2</sup>", "m2"), ("Lãi<sup>*</sup>", "Lãi")])
def test_notes_of_cells_do_not_run_into_numbers(cell, want):
    assert markup.clean_cell(cell) == (True, want)


def test_cleaned_has_texts_and_cells(spark, small):
    tables = spark.createDataFrame([("t", [["**Lãi** gộp", "<b>12</b>"], None, [None, "x"]]), ("u", None)], "table_ref string, rows array<array<string>>")
    got = sorted((tuple(r) for r in markup.cleaned_cells(tables).collect()), key=lambda r: r[:3])
    assert got == [("t", 1, 1, "Lãi gộp"), ("t", 1, 2, "12"), ("t", 3, 1, None), ("t", 3, 2, "x")]
    counted = {r["source_table"]: (r["n"], r["rows"]) for r in queries.p2_clean(spark, small).groupBy("source_table").agg(F.count_distinct("record_key").alias("n"), F.count("*").alias("rows")).collect()}
    texts, html = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("raw_documents", "html_tables"))
    n = texts.select("doc_id").distinct().count()
    cells = html.dropDuplicates(["table_ref"]).select("table_ref", F.explode(F.flatten("rows")))
    assert counted == {"raw_documents": (n, n), "html_tables": (cells.select("table_ref").distinct().count(), cells.count())}


def test_repaired_has_texts_and_cells(spark, small):
    got = queries.p6_repaired(spark, small).groupBy("source_table").agg(F.count_distinct("record_key").alias("n"), F.count("*").alias("rows")).collect()
    counted = {r["source_table"]: (r["n"], r["rows"]) for r in got}
    texts, tables = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("raw_documents", "extracted_tables"))
    n = texts.select("doc_id").distinct().count()
    assert counted["raw_documents"] == (n, n)
    assert counted["extracted_tables"][0] == tables.where(F.size("rows") > 0).select("table_ref").distinct().count()


def test_boosting_learns_a_rule():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = boosting.Boosted().fit(x[:400], y[:400])
    assert np.mean([(model.score(r) > 0) == bool(t) for r, t in zip(x[400:], y[400:], strict=True)]) > 0.95


# --- quality


def test_quality(spark):
    common = spark.createDataFrame([("vi", w) for w in "và của trong năm được các là không theo đã".split()] + [("en", w) for w in "the of and is a to in was has".split()], "lang string, word string")
    shared = quality.common_set(common)
    texts = [t for group in quality.EXAMPLES.values() for t in group] * 3
    rows = [(i, t, 0.0) for i, t in enumerate([*texts, None, "", " \n ", "x", LONG])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words double")
    stats = quality.statistics(docs, shared)
    got = {r["doc_id"]: r for r in quality.classified(stats, quality.fit(stats, shared)).collect()}
    names = [n for n, group in quality.EXAMPLES.items() for _ in group] * 3
    right = sum((got[i]["kind"] == "prose") == (n == "prose") for i, n in enumerate(names))
    assert right >= 0.9 * len(names)
    n = len(texts)
    assert [got[n + k]["kind"] for k in range(3)] == [None] * 3 and [got[n + k]["n_words"] for k in range(3)] == [0.0] * 3
    assert got[n + 3]["kind"] is not None and got[n + 4]["n_words"] == 50_000
    empty = quality.statistics(docs.limit(0), shared)
    assert quality.classified(empty, quality.fit(empty, shared)).count() == 0


def test_mixture_converges(spark):
    """Two clouds far apart end in components of their own, and the steps end by themselves."""
    common = quality.common_set(spark.createDataFrame([("en", w) for w in "the of and is a to in was has".split()], "lang string, word string"))
    prose = "The report of the board is in the hands of the members, and it was read in full. This is the end of the text."
    junk = "&# |\\ <1 0} ^~ %I l_ =:\n{0 &; ^| \\~ 1% <> #_ l}"
    docs = spark.createDataFrame([(i, (prose if i % 3 else junk) + " x" * (i % 5)) for i in range(300)], "doc_id long, text string")
    stats = quality.statistics(docs, common).cache()
    fitted, started = quality.fit(stats, common), quality.fit(stats, common, steps=0)
    assert 1 < fitted.steps < quality.STEPS and started.steps == 0 and fitted.likelihood > -np.inf
    z = fitted.standard(np.array([[r[c] for c in quality.FITTED] for r in stats.orderBy("doc_id").collect()]))
    component = fitted.responsibilities(z)[0].argmax(1)
    assert not set(component[::3]) & set(np.delete(component, slice(None, None, 3)))
    again = quality.fit(stats.repartition(3), common)
    assert np.allclose(again.mean, fitted.mean, atol=1e-6)  # the order of rows and parts has no say


def test_measure():
    m = dict(zip(quality.STATISTICS, quality.measure("Công ty đã tăng 10%.\n- một mục", quality.Common(frozenset({"da", "mot"}))), strict=True))
    assert m["n_words"] == 6 and m["punctuated_lines"] == 0.5 and m["item_lines"] == 0.5 and m["common_share"] == pytest.approx(2 / 6)


# --- queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, small, name):
    df = queries.queries()[name](spark, small)
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, small, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    got = queries.queries()[name](spark, small)
    columns = sorted(got.columns)
    want = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in want.description]
    order = [names.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())
