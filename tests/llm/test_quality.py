import random
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import quality


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {q for at in seen.values() if len(at) > 1 for p in at for q in (p, p + 1, p + 2)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    made = [" ".join(rng.choice(["a", "bé", "c#", "|", "dd"]) + rng.choice(["", "", "\n", "\t\x0b"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 30, 400)]
    return [None, "", " \n\t", "a a a", "a a a a", "x\n\nx\n x", "é😀 " * 60, "w " * 30000, " b c", *made, made[-1]]


def test_measures(spark, texts):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r[1:6]) for r in quality.report(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_policies_and_ablation(spark):
    docs = spark.createDataFrame([(0, "ab cd " * 10), (1, " ".join(f"wo{i}" for i in range(60))), (2, " ".join(f"#{i}" for i in range(60))), (3, None)], "doc_id long, text string")
    book = quality.ledger(docs)
    kept = {r.doc_id for r in book.filter(~quality.fails(quality.POLICIES["v2"])).collect()}
    assert kept == {1}
    assert {r.doc_id for r in quality.keep_clean(docs).collect()} == {1}
    assert quality.keep_clean(docs).columns == docs.columns
    got = {r["rule"]: (r.n_failed, r.n_only) for r in quality.ablation(book, quality.POLICIES["v2"]).collect()}
    for name, bit in quality.BITS.items():
        bits = [r.fail_bits for r in book.collect()]
        assert got[name] == (sum(b >> bit & 1 for b in bits), sum(b == 1 << bit for b in bits))
    seen = quality.report(docs).collect()
    assert {r.sole_rule for r in seen if r.fail_bits and not r.fail_bits & (r.fail_bits - 1)} <= set(quality.BITS)
    assert all((r.sole_rule is None) == (bin(r.fail_bits).count("1") != 1) for r in seen)
    assert {r.doc_id for r in seen if r.kept_before} >= {r.doc_id for r in seen if r.kept} == kept


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, extra int")
    assert quality.report(docs).count() == 0
    assert quality.ablation(quality.ledger(docs), quality.POLICIES["v1"]).agg(F.sum("n_failed")).first()[0] == 0
