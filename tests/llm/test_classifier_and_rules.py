import math
import re
from fractions import Fraction

import numpy as np
import pytest

from netloom.llm import quality_classifier as C, quality_rules as R
from netloom.llm.common import Cache, crc_mod, table
from tests.llm.helpers import DOCS, SF, TEXTS, docs


def plain(text):
    """The base metrics, straight from their definitions."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        dup += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(w) < 3000 else None
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, None if hit is None else len(hit)


@pytest.mark.parametrize("text", TEXTS + ["a b c a b c a b c", "a a a a a", "x # y\n\nx # y\n \n \nx # y | < > && z"])
def test_metrics_follow_their_definitions(text):
    got, want = R.measure((text or "").encode())[:5], plain(text)
    assert got[:4] == want[:4] and want[4] in (None, got[4])


def test_large_vocabulary_counts_the_same():
    w = [str(k).encode() for k in range(1 << 20)] + [b"1", b"2", b"3"]
    assert R.repeat_words(w + [b"x"]) == 6


def test_binomial_tail_is_exact():
    for n, k in ((10, 0), (50, 3), (400, 7)):
        p = Fraction(1, 100)
        want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        assert R.binomial_tail(k, n, 0.01) == pytest.approx(float(want), rel=1e-9)
    assert R.binomial_tail(5, 5, 0.01) == pytest.approx(1) and R.binomial_tail(0, 0, 0.01) == 1


def test_walk_stops_at_the_first_uncertified_level():
    assert R.certify({}, 100, 0.01, 0.05) == -1  # .99 ** 100 > .05
    assert R.certify({}, 1000, 0.01, 0.05) == R.LEVELS
    assert R.certify({3: 2, 5: 500}, 1000, 0.01, 0.05) == 4


def test_certified_strata_lose_no_more_than_the_risk():
    rng, bad = np.random.default_rng(0), 0
    p = np.full(R.LEVELS + 1, 0.0012)  # each level loses .12 % more of the good documents
    for _ in range(300):
        n = 2000
        hit = rng.multinomial(n, [*p, 1 - p.sum()])
        cut = R.certify(dict(enumerate(hit[:-1].tolist())), n, 0.01, 0.05)
        bad += cut >= 0 and p[:cut + 1].sum() > 0.01
    assert bad <= 300 * 0.05 + 3 * math.sqrt(300 * 0.05)


def test_judge_edge_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (99, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = R.judge(docs(spark, "level", "kept"), labels).collect()
    assert len(got) == len(DOCS) and all(r.kept == (not r.base_failed) for r in got)
    assert all(r.n_words == 0 and r.base_failed for r in got if r.doc_id in (None, 1, 2) and r.n_chars == 1 and r.word_chars == 0)
    assert R.judge(docs(spark, rows=[]), labels).count() == 0
    again = R.judge(docs(spark), labels, keep_text=True)
    assert "text" in again.columns and again.where("kept").count() == sum(r.kept for r in got)


def test_labels_of_the_test_tables_are_mostly_kept_and_junk_is_not(spark):
    d = "/root/testdata/sf0.1"
    got = R.judge(table(spark, d, "documents").select("doc_id", "lang", "text"), table(spark, d, "labels")).join(table(spark, d, "labels"), "doc_id")
    r = {(x.quality, x.kept): x.n for x in got.where("not base_failed").groupBy("quality", "kept").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert r[1, False] <= 0.01 * (r[1, True] + r[1, False]) and r[0, False] > 5 * r[0, True]


def test_classifier_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    x = table(spark, d, "documents").withColumn("held_out", crc_mod("doc_id", 4) == 2)
    w = C.train(x.where("not held_out"), table(spark, d, "labels"))
    got = C.score(x.select("doc_id", "text", "held_out"), w).where("held_out").join(table(spark, d, "labels"), "doc_id").collect()
    right = sum((r.score >= 0.7) == (r.quality == 1) for r in got)
    assert right > 0.97 * len(got) and len(got) > 500


def test_classifier_scores_as_a_plain_dot_product(spark):
    w = np.random.default_rng(1).normal(0, 0.1, 257).astype(np.float32)
    got = C.score(docs(spark), w).collect()
    codes = Cache(C._word)
    for r in got:
        idx, val = C.features((r.text or "").encode(), codes, 8)
        want = 1 / (1 + math.exp(-(sum(float(w[i]) * float(v) for i, v in zip(idx, val)) + float(w[-1]))))
        assert r.score == pytest.approx(want, rel=1e-4)
    assert len(got) == len(DOCS) and C.score(docs(spark, rows=[]), w).count() == 0


def test_training_without_usable_labels(spark):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    w = C.train(docs(spark), labels)
    assert not w.any()
    one = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert C.train(docs(spark), one)[-1] > 0 and not C.train(docs(spark), one)[:-1].any()


def test_training_takes_at_most_its_bound(spark):
    x = table(spark, SF, "documents")
    assert np.isfinite(C.train(x, table(spark, SF, "labels"), max_rows=40, shards=2)).all()
