"""Per-document text statistics, and prose told from lists, tables and junk (problem 9).

Statistics are computed for every document; a Gaussian mixture with diagonal covariances is fitted to them,
standardized, by expectation-maximization over all documents until it no longer gains: each step sums the moments of a
partition where its rows are, and only those sums reach the driver. The components start in well-filled cells of the
statistics, far from each other; inspected examples take no part in the fit and only name the fitted components.

The statistics are written to a checkpoint, so that the texts are measured once and the steps read a hundred bytes a
document; the fit runs when the query is built.

Defined cases: a null, empty or blank text has zero words, null shares and no class; a text of one line or of one word
has all statistics; repeated rows give repeated results; very long texts are measured whole; a corpus without any text
gives one component and no class; a corpus of one text has one component, named by the example nearest to it.
"""

from __future__ import annotations

import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.functions.lookalikes import fold

#: The statistics, in their order.
STATISTICS = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "punctuated_lines", "common_share", "delimiter_ratio",
    "item_lines", "item_share", "repeated_lines", "single_letters", "broken_letters", "sentence_words", "common_enough",
)
#: Those that the mixture is fitted to; beyond ENOUGH the share of common words tells styles of prose apart, not classes.
FITTED = tuple(s for s in STATISTICS if s not in ("n_words", "common_share", "item_lines"))
#: Share of common words that any prose reaches.
ENOUGH = 0.15
#: Components of the mixture.
COMPONENTS = 16
#: The most steps; fewer where a step betters the mean log likelihood of a document by less than GAIN.
STEPS = 60
GAIN = 1e-3
#: Width, in deviations, of the cells that components start in, and the number of the fullest that are drawn from.
CELL = 1.5
CELLS = 2000
#: Least variance of a component in a standardized statistic.
FLOOR = 0.05
#: The same, for the distance of a component from an example.
NEAR = 0.3

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ITEM = re.compile(r"^\s*(?:[-+*•–·]|\d{1,4}[.)]|[a-zđ]\))\s|\.{4,}\s*\d+\s*$")
_DELIMITER = re.compile(r"\t|\||;| {3,}|\.{4,}")
_BROKEN = re.compile(r"[ÃÂÄÆÐ][\u0080-¿Œ-Ÿ‚-›™€]|á[º»][\u0080-¿Œ-Ÿ‚-›™€]?|�")
#: What any delimiter holds; lines without it are not searched further.
_PARTED = re.compile(r"[\t|;]|   |\.\.\.\.")
_SENTENCE = re.compile(r"[.!?…]+(?:\s|$)")


class Common(dict):
    """From a word to 1 if it is a common one, accents and case aside, else 0; what was asked is kept."""

    def __init__(self, words: frozenset[str]):
        super().__init__()
        self.words = words

    def __missing__(self, word: str) -> int:
        found = int(fold(word) in self.words)
        if len(self) < 300_000:
            self[word] = found
        return found


def measure(text: str | None, common: Common) -> list[float] | None:
    """The statistics of a text, in the order of STATISTICS; None if it is blank."""
    if text is None or not text.strip():
        return None
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    n = letters = common_words = delimiters = items = listed = punctuated = single = 0
    for line in lines:
        words = _WORD.findall(line)
        n += len(words)
        letters += sum(map(len, words))
        single += sum(map((1).__eq__, map(len, words)))
        common_words += sum(map(common.__getitem__, words))
        if _PARTED.search(line):
            delimiters += len(_DELIMITER.findall(line))
        if _ITEM.search(line):
            items += 1
            listed += len(line)
        punctuated += line.rstrip()[-1] in ".!?:…"
    visible = len("".join(text.split()))
    digits = sum(map(text.count, "0123456789"))
    lower = text.lower()
    upper = sum(map(operator.ne, text, lower)) if len(lower) == len(text) else sum(map(str.isupper, text))
    broken = len(_BROKEN.findall(text)) if _BROKEN.search(text) else 0
    return [
        float(n),
        letters / n if n else 0.0,
        (visible - letters - digits) / max(visible, 1),
        digits / max(visible, 1),
        upper / max(letters, 1),
        punctuated / len(lines),
        common_words / n if n else 0.0,
        min(1.0, delimiters / max(n, 1)),
        items / len(lines),
        listed / sum(map(len, lines)),
        1 - len(set(map(str.strip, lines))) / len(lines),
        single / max(n, 1),
        min(1.0, 2 * broken / max(n, 1)),
        min(40.0, n / max(1, len(_SENTENCE.findall(text)))),
        min(1.0, common_words / n / ENOUGH) if n else 0.0,
    ]


#: Inspected examples of each class, written for this purpose.
EXAMPLES: dict[str, tuple[str, ...]] = {
    "prose": (
        "Trong năm vừa qua, ban lãnh đạo đã cùng các bộ phận rà soát lại toàn bộ quy trình bán hàng. Việc này giúp chi phí giảm và khách hàng được phục vụ nhanh hơn so với năm trước.",
        "Theo nhận định của hội đồng, thị trường sẽ còn nhiều khó khăn trong hai quý tới. Do đó công ty không mở thêm cửa hàng mà tập trung vào các điểm bán đang có lãi.\nKết quả cho thấy doanh thu tăng 12,5% và lợi nhuận đạt 34.200 triệu đồng.",
        "During the year the management reviewed all of its contracts and decided that the older plant would not be repaired. This was a hard decision for the company, but it has been accepted by the staff.",
        "The board believes that sales will grow by 4.2% in the next year because new stores have been opened in the south.\nCosts are expected to be the same as before, and no new loans will be needed.",
        "Công ty đã hoàn thành việc xây dựng kho mới\nvà đưa vào sử dụng từ tháng sáu. Nhờ có kho này\nmà hàng được giao sớm hơn cho các đại lý ở miền\ntrung và các tỉnh lân cận.",
        "The new warehouse was finished in June and has\nbeen in use since then. It has made it possible\nto deliver goods to the dealers of the region in\nless time than before, and at a lower cost.",
        "Vì sao hàng bán chậm như vậy? Các đại lý cho rằng giá đã được tăng quá nhanh so với thu nhập của người mua.",
        "Theo ý kiến của các bộ phận, việc này sẽ không làm thay đổi kết quả của công ty trong những năm tới.",
        "The cost of this work is not included in the plan for the next year.",
        "Why has the price been changed? The answer is that the old one was not in line with that of other companies in the area.",
        "Sales of the group for 2018 came to 12,345 million dong, up 4.5% against 2017.",
        "Doanh thu năm 2018 của công ty đạt 12.345 triệu đồng, tăng 4,5% so với năm 2017.",
        "Members may ask for the full text of this report at the head office of the group.",
        "At 31 March 2016, trade debt came to 1,204 billion dong, against 987 billion dong at the same date one year before.",
        "Cổ đông có thể xem phần giải trình về các khoản vay này ở phụ lục 4 của báo cáo thường niên.",
        "The plant was closed for repairs from May to July, so that output fell behind the plan of the year. The shortfall was made good by the end of November.\n- Output of the second half\n- Repairs of the main line\nNo further stop is planned for the coming year, and the staff has been told of this.",
        "KẾ HOẠCH KINH DOANH\n\nTrong năm sau công ty sẽ giữ quy mô như hiện nay và không tăng vốn. Các khoản vay đến hạn được trả bằng tiền thu từ hoạt động chính.",
    ),
    "list": (
        "- Hàng tồn kho\n- Phải thu khách hàng\n- Tiền gửi ngân hàng\n- Vay ngắn hạn\n- Vốn góp\n- Lợi nhuận chưa phân phối",
        "* Trade receivables\n+ Cash at bank\n- Share capital\n• Goodwill\n* Deferred tax\n- Inventories",
        "1. Doanh thu thuần.\n2. Giá vốn hàng bán.\n3. Lợi nhuận gộp.\n4. Chi phí bán hàng.\n5. Thuế thu nhập.\n6. Lãi vay.",
        "1. Net sales.\n2. Gross profit.\n3. Selling costs.\n4. Interest paid.\n5. Income tax.\n6. Net profit.",
        "Tài sản cố định ............ 12\nHàng tồn kho .................. 15\nVay dài hạn ........ 23\nVốn chủ sở hữu ............... 31\nDoanh thu ....... 40",
        "Fixed assets ............ 12\nInventories .................. 15\nBorrowings ........ 23\nEquity ............... 31",
        "ABCD, EFGH, IKLM, NOPQ, RSTU, VWXY, ZABC, DEFG, HIKL, MNOP, QRST, UVWX",
        "Doanh thu thuần; nhà máy số một; 2019\nChi phí bán hàng; kho phía bắc; 2020\nThuế phải nộp; cửa hàng trung tâm; 2021\nVốn góp; văn phòng chính; 2022",
        "Net sales; northern plant; 2019\nSelling costs; main store; 2020\nTaxes payable; harbour depot; 2021\nShare capital; head office; 2022",
    ),
    "table": (
        "Khoản mục\tMã\t2021\t2020\nDoanh thu\t10\t25.300\t21.450\nGiá vốn\t11\t(18.200)\t(16.900)\nLợi nhuận\t20\t7.100\t4.550",
        "Khoản mục | Mã | 2021 | 2020\nDoanh thu | 10 | 25.300 | 21.450\nGiá vốn | 11 | (18.200) | (16.900)\nLợi nhuận | 20 | 7.100 | 4.550",
        "Item;Code;2021;2020\nSales;10;25,300;21,450\nCost of sales;11;(18,200);(16,900)\nProfit;20;7,100;4,550",
        "Item\tCode\t2021\t2020\nSales\t10\t25,300\t21,450\nCost\t11\t(18,200)\t(16,900)\nProfit\t20\t7,100\t4,550",
        "Khoản mục                 Mã             2021             2020\nDoanh thu                 10           25.300           21.450\nGiá vốn                   11         (18.200)         (16.900)\nLợi nhuận                 20            7.100            4.550",
    ),
    "junk": (
        "&# |\\ <1 0} ^~ %I l_ =:\n{0 &; ^| \\~ 1% <> #_ l}\n=~ ^% 0& |{ ;: I1 _> \\<",
        "4,521,300 870,214 6,332,105 18,950\n7,102,447 3,310,968 552,001\n9,004,110 61,337 2,840,775 1,105,926",
        "Trang chủ > Giới thiệu > Liên hệ\nĐăng ký | Giỏ hàng\nTrang chủ > Giới thiệu > Liên hệ\nBấm vào đây!!!\nBấm vào đây!!!\nĐăng ký | Giỏ hàng\nTrang chủ > Giới thiệu > Liên hệ",
        "Home > About > Contact\nLog in | Cart\nHome > About > Contact\nClick here!!!\nClick here!!!\nLog in | Cart\nHome > About > Contact",
        "Tiền vốn hàng thuế gộp phân hạn quỹ. Thu chi lãi vay bán tài sản nợ. Cổ phiếu kho hao mòn giá ngân hàng. Dòng thuần lợi nhuận đầu tư phải trả.",
        "Gửi quỹ chưa hàng vốn kho trên lãi. Bán tiền khả năng cổ phần thuế dài chi hao. Ngân kỳ phiếu gộp trước vay sản mỗi.",
        "Cash equity stock tax gross term fund. Receipts cost interest loans sale assets debt. Share inventory depreciation price bank. Flow net profit investment payable.",
        "T h e b o a r d b e l i e v e s t h a t s a l e s w i l l g r o w i n t h e n e x t y e a r .",
        "C ô n g t y đ ã h o à n t h à n h v i ệ c x â y d ự n g k h o m ớ i t r o n g n ă m n a y .",
        "CÃ´ng ty ÄÃ£ hoÃ\xa0n thÃ\xa0nh viá»\x87c xÃ¢y dá»±ng kho má»\x9bi trong nÄ\x83m nay. CÃ¡c khoáº£n vay Ä\x91áº¿n háº¡n Ä\x91Æ°á»£c tráº£ báº±ng tiá»\x81n thu tá»« hoáº¡t Ä\x91á»\x99ng chÃ\xadnh.",
    ),
}


class Mixture:
    """Gaussians with diagonal covariances over standardized statistics; examples only name the components."""

    def __init__(self, common: Common, center: np.ndarray, scale: np.ndarray, start: np.ndarray):
        self.center, self.scale = center, scale
        stats, self.names = [], []
        for name, texts in EXAMPLES.items():
            for t in texts:
                measured = dict(zip(STATISTICS, measure(t, common), strict=True))
                stats.append([measured[s] for s in FITTED])
                self.names.append(name)
        self.examples = self.standard(np.array(stats))
        self.mean = start.copy()
        self.variance = np.ones_like(self.mean)
        self.weight = np.full(len(self.mean), 1 / len(self.mean))
        self.likelihood = -np.inf
        self.steps = 0
        self.name()

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.center) / self.scale, -6, 6)

    def log_density(self, z: np.ndarray) -> np.ndarray:
        precision = 1 / self.variance
        constant = (self.mean**2 * precision + np.log(self.variance)).sum(1)
        return z @ (self.mean * precision).T - 0.5 * ((z**2) @ precision.T + constant) + np.log(self.weight)

    def responsibilities(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(responsibilities, log likelihood) of each row."""
        d = self.log_density(z)
        top = d.max(1, keepdims=True)
        d = np.exp(d - top)
        total = d.sum(1, keepdims=True)
        return d / total, (top + np.log(total))[:, 0]

    def moments(self, z: np.ndarray) -> np.ndarray:
        """Per component responsibility, sums and sums of squares, then the log likelihood, as one flat array."""
        r, likelihood = self.responsibilities(z)
        return np.concatenate([r.sum(0), (r.T @ z).ravel(), (r.T @ z**2).ravel(), [likelihood.sum()]])

    def update(self, moments: np.ndarray) -> float:
        """One step; what the mean log likelihood of a row was better before it than a step earlier."""
        k, d = self.mean.shape
        n = moments[:k] + 1e-6
        s, q = moments[k : k + k * d].reshape(k, d), moments[k + k * d : -1].reshape(k, d)
        kept = (moments[:k] > 1e-3)[:, None]  # a component that no row belongs to stays where it is
        self.mean = np.where(kept, s / n[:, None], self.mean)
        self.variance = np.where(kept, np.maximum(q / n[:, None] - self.mean**2, FLOOR), self.variance)
        self.weight = n / n.sum()
        likelihood = moments[-1] / max(moments[:k].sum(), 1e-9)
        gain, self.likelihood = likelihood - self.likelihood, likelihood
        self.steps += 1
        return gain

    def name(self) -> None:
        """Name each component by the examples that it is responsible for; one that is for none by the example nearest to it."""
        r, _ = self.responsibilities(self.examples)
        self.label = []
        for k in range(len(self.mean)):
            votes: Counter = Counter()
            for e, name in enumerate(self.names):
                votes[name] += r[e, k]
            best, share = votes.most_common(1)[0]
            if share < 0.05:
                far = ((self.examples - self.mean[k]) ** 2 / np.maximum(self.variance[k], NEAR)).sum(1)
                best = self.names[int(far.argmin())]
            self.label.append(best)

    def classify(self, z: np.ndarray) -> list[str]:
        """The class with the most responsibility."""
        classes = list(EXAMPLES)
        r, _ = self.responsibilities(z)
        sums = np.stack([r[:, [i for i, x in enumerate(self.label) if x == c]].sum(1) for c in classes], 1)
        return [classes[i] for i in sums.argmax(1)]


def common_set(common_words: DataFrame) -> Common:
    """The listed common words, folded. The list is a fixed table."""
    return Common(frozenset(fold(unicodedata.normalize("NFC", r["word"])) for r in common_words.select("word").distinct().collect() if r["word"]))


def statistics(documents: DataFrame, common: Common, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, <statistics>) of each document; null but for n_words = 0 where the text is null or blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, common) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] if r else (0.0 if not i else None) for r in rows], pa.float64()) for i in range(len(STATISTICS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *STATISTICS])

    schema = T.StructType([documents.schema[id_col], *(T.StructField(s, T.DoubleType()) for s in STATISTICS)])
    return documents.select(id_col, text_col).mapInArrow(run, schema)


def _started(filled: DataFrame, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Where the components start: means of cells of the standardized statistics, drawn far from each other.

    All rows are counted in cells of CELL deviations; the CELLS fullest are drawn from, each by its rows and its
    squared distance from those drawn before.
    """
    z = [F.greatest(F.lit(-6.0), F.least(F.lit(6.0), (F.col(c) - F.lit(float(m))) / F.lit(float(d)))) for c, m, d in zip(FITTED, center, scale, strict=True)]
    cells = filled.select(F.array(*z).alias("z")).groupBy(F.transform("z", lambda x: F.round(x / F.lit(CELL)).cast("int")).alias("cell"))
    counted = cells.agg(F.count("*").alias("n"), *(F.avg(F.col("z")[i]).alias(f"m{i}") for i in range(len(FITTED))))
    rows = counted.orderBy(F.desc("n"), F.col("cell").cast("string")).limit(CELLS).collect()
    if not rows:
        return np.zeros((1, len(FITTED)))
    means, n = np.array([r[2:] for r in rows], float), np.array([r["n"] for r in rows], float)
    rng = np.random.default_rng(0)
    drawn = [means[rng.choice(len(means), p=n / n.sum())]]
    far = ((means - drawn[0]) ** 2).sum(1)
    while len(drawn) < COMPONENTS and (far * n).sum() > 1e-9:
        drawn.append(means[rng.choice(len(means), p=far * n / (far * n).sum())])
        far = np.minimum(far, ((means - drawn[-1]) ** 2).sum(1))
    return np.array(drawn)


def fit(stats: DataFrame, common: Common, steps: int = STEPS) -> Mixture:
    """The mixture of all rows of stats, after at most so many steps. Only sums over partitions are moved."""
    filled = stats.where(F.col("common_enough").isNotNull()).select(*FITTED)
    row = filled.agg(*(F.avg(c) for c in FITTED), *(F.stddev_pop(c) for c in FITTED)).first()
    d = len(FITTED)
    center = np.array([x or 0.0 for x in row[:d]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in row[d:]])
    mixture = Mixture(common, center, scale, _started(filled, center, scale))

    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], mixture=mixture) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    z = mixture.standard(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], 1))
                    m = mixture.moments(z)
                    total = m if total is None else total + m
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total, pa.float64())], ["i", "x"])

        parts = filled.mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
        if not parts:
            break
        moments = np.zeros(len(parts))
        for p in parts:
            moments[p["i"]] = p["x"]
        if mixture.update(moments) < GAIN:
            break
    mixture.name()
    return mixture


def classified(stats: DataFrame, mixture: Mixture, id_col: str = "doc_id") -> DataFrame:
    """stats with `kind`: prose, list, table or junk; null where there is no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in FITTED], 1)
            blank = np.isnan(x).any(1)
            kinds = mixture.classify(mixture.standard(np.nan_to_num(x))) if len(x) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([None if b else k for b, k in zip(blank, kinds, strict=True)], pa.string())], [*batch.schema.names, "kind"]
            )

    return stats.mapInArrow(run, T.StructType([*stats.schema.fields, T.StructField("kind", T.StringType())]))
