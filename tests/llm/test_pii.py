import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodeframe.llm.pii import KINDS, matched, op6_pii, personal_data, reliabilities, span_classifier

# the base patterns as they are stated
STATED = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
HARD = [
    "a@b.c@d.e", "x@y.z_w@q.r", "x@y.z..w@q.r", "..a@b-.c.", "a@b." + "c." * 6000 + "d", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.001 0000255.1.1.1",
    "4111 1111 1111 1111", "4111-1111-1111-1111 4", "4111  1111 1111 1111", "1 2 3 4 " * 20_000, "+1 (555) 123-4567 x +49.30.1234567.",
    "+12345678901234567890 +1", "1" * 50_000, "a" * 200_000, "@" * 1000 + "a@b.co", "é😀 a@b.co 😀 +49 30 1234567", "", " ",
    "41111111 1111 1111 4111 1111 1111 1111", "ab@cd.e f@gh.i", "call 555 123-4567 now", "mail bob [at] example [dot] com please",
    "aa.bb@cc.dd.ee-ff.gg hh@ii", "+1 2.3.4.5", "10.0.0.1:80 999.1.1.1", "+4111111111111111", None, "phone (030) 1234 5678", "version 1.2.3.4",
    "3782-822463-10005 and 6011 0009 9013 9424",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in enumerate(STATED):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == 0
                or (kind == 1 and all(int(x) <= 255 for x in m[0].split(".")))
                or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits))
                or (kind == 3 and 10 <= len(digits) <= 15)
            ):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pii")
    rows = [(i, t, "x", 1) for i, t in enumerate(HARD)] + [(None, "a@b.co", "x", 1), (0, "a@b.c@d.e", "x", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, spans string, c int").repartition(4).write.parquet(f"{folder}/documents.parquet")
    return op6_pii(spark, str(folder)).collect()


def test_base_spans_are_those_of_the_stated_patterns(found):
    assert len(found) == len(HARD) + 2
    for r in found:
        text = "a@b.co" if r["doc_id"] is None else HARD[r["doc_id"]] or ""
        own = base(text)
        told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in own]
        assert r["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest(), text[:80]
        assert [r[f"n_{k}"] for k in KINDS] == [sum(x[1] == i for x in own) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(told) <= set(spans)
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)


def test_the_method_adds_spans(found):
    spans = {r["doc_id"]: r["spans"] for r in found}
    assert spans[HARD.index("mail bob [at] example [dot] com please")] == "email:5:31"
    assert spans[HARD.index("call 555 123-4567 now")] == "phone:5:17"


def test_reliabilities_prefer_labelers_that_agree():
    patterns = [(0, (1, 1, 1, 1), 80), (0, (-1, -1, 0, 1), 60), (0, (1, 1, 0, -1), 20), (0, (-1, -1, -1, -1), 40)]
    prior, tables, belief = reliabilities(patterns)[0]
    assert belief[1, 1, 1, 1] > 0.9 and belief[1, 1, 0, -1] > 0.5 > belief[-1, -1, 0, 1]
    assert tables[0][1, 1] > tables[3][1, 1] and 0.3 < prior < 0.7
    weights = span_classifier(patterns)
    assert weights[0][1] > weights[0][4] and weights[1] == [-1.0, 0, 0, 0, 0]


def test_empty_table(spark):
    assert personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_many_matches_in_one_text(spark):
    rng = random.Random(7)
    some = [lambda: str(rng.randrange(10**9)), lambda: f"u{rng.randrange(99)}@h{rng.randrange(99)}.io", lambda: "10.0.0.%d" % rng.randrange(300), lambda: "+49 30 %07d" % rng.randrange(10**7)]
    text = " ".join(rng.choice(some)() for _ in range(3_000)) + " é😀 a@b.co"
    (row,) = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(x) for x in row["base"]] == base(text) and set(row["base"]) <= set(row["spans"])


def test_a_long_text_of_numbers(spark):
    text = "tel 555 123-4567, " * 30_000 + "1234567 " * 60_000  # 1 MB
    began = time.monotonic()
    (row,) = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.monotonic() - began < 60 and row["base"] == [] and len(row["spans"]) in (0, 30_000)


def test_context_reaches_past_neighbouring_matches(spark):
    text = "cards: 4111111111111111, 5500005555555559 12 34"
    docs = spark.createDataFrame([(text,)], "text string")
    (row,) = docs.select(matched(F.col("text"), "[0-9]{2,}", F.lit(True)).alias("m")).collect()
    assert [(x["start"], x["stop"], x["before"]) for x in row["m"]] == [
        (m.start(), m.end(), text[max(0, m.start() - 40) : m.start()]) for m in re.finditer("[0-9]{2,}", text)
    ]
    many = " ".join(f"{i:02d}" for i in range(700)) * 2
    (row,) = spark.createDataFrame([(many,)], "text string").select(matched(F.col("text"), "[0-9]{2,}", F.lit(True)).alias("m")).collect()
    assert [(x["start"], x["stop"], x["found"], x["before"]) for x in row["m"]] == [
        (m.start(), m.end(), m[0], many[max(0, m.start() - 40) : m.start()]) for m in re.finditer("[0-9]{2,}", many)
    ]


def test_features_decide_where_votes_tie():
    patterns = [(3, (1, 1, 0, 1, 1, 3, 0, 0), 50), (3, (-1, -1, 0, -1, 3, 0, 3, 3), 50), (3, (1, 0, 0, -1, 1, 3, 0, 0), 9), (3, (1, 0, 0, -1, 3, 0, 3, 3), 9)]
    weights = span_classifier(patterns)[3]
    score = lambda x: weights[0] + sum(w * v for w, v in zip(weights[1:], x))
    assert score(patterns[0][1]) > 0 > score(patterns[1][1]) and score(patterns[2][1]) > score(patterns[3][1])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a@b.co", "x", [1], 5)], "doc_id long, text string, base string, c array<int>, kind int")
    (row,) = personal_data(docs).collect()
    assert row.asDict().keys() == {"doc_id", "base", "spans"} and len(row["base"]) == 1
