from __future__ import annotations

import re
from fractions import Fraction
from math import comb

import pytest
from pyspark.sql import functions as F

from stratalog.llm import queries, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def base(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    at: dict = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_counts_are_the_brute_force(spark, edge_docs):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op5_quality_rules(spark, SF).collect():
        assert tuple(r[c] for c in COLUMNS) == base(docs[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
    want = sorted(base(r["text"]) for r in edge_docs.collect())
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.judge(edge_docs, labels).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in out) == want
    assert all(r["kept"] != r["base_failed"] for r in out)


@pytest.mark.parametrize("p", [0.01, 0.3])
def test_binomial_tail_is_exact(spark, p):
    cases = [(k, n) for n in (1, 7, 60, 900) for k in range(0, n, max(1, n // 6)) if k < n * p]
    df = spark.createDataFrame(cases, "k long, n long")
    q = Fraction(p)
    for r in df.select("k", "n", quality_rules.binomial_tail("k", "n", str(p)).alias("t")).collect():
        want = float(sum(comb(r["n"], i) * q**i * (1 - q) ** (r["n"] - i) for i in range(r["k"] + 1)))
        assert r["t"] == pytest.approx(want, rel=1e-9)


def test_binomial_tail_of_very_large_samples(spark):
    """Three deviations out, at sizes where the series has some millions of terms, the tail is that of the normal curve."""
    p = 0.01
    rows = [(int(n * p - 3 * (n * p * (1 - p)) ** 0.5), n) for n in (10**9, 10**11, 10**12)]
    for r in spark.createDataFrame(rows, "k long, n long").select("n", quality_rules.binomial_tail("k", "n", str(p)).alias("t")).collect():
        assert r["t"] == pytest.approx(0.00135, rel=0.02)


def made(spark, bad_symbols: str, n: int = 1500):
    text = F.concat(F.lit("these are words of a plain text number "), F.col("id").cast("string"), F.lit(" and some more "), F.when(F.col("id") % 5 == 0, bad_symbols).otherwise(""))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), F.when(F.col("id") % 3 == 0, "en").alias("lang"))
    return docs, docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))


def test_cutoffs_reject_what_is_bad_and_risk_stays_bounded(spark):
    docs, labels = made(spark, "%%% ### $$$ %%% ### $$$", 9000)
    out = quality_rules.judge(docs, labels, quality_rules.Risk(alpha=0.05)).join(labels, "doc_id").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in out)
    # labels without meaning certify nothing worth rejecting for
    noise = labels.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    out = quality_rules.judge(docs, noise).collect()
    assert sum(not r["kept"] for r in out) == 0


def test_too_few_labels_certify_nothing(spark):
    docs, labels = made(spark, "%%% ### $$$ %%% ### $$$", 300)
    assert quality_rules.judge(docs, labels).filter("not kept").count() == 0


def test_empty_tables(spark, no_docs, no_labels, some_labels, edge_docs):
    assert quality_rules.judge(no_docs, some_labels).count() == 0
    assert quality_rules.judge(edge_docs, some_labels).count() == 12
