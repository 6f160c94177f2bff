"""Every operator and stage on awkward tables: ids that are missing, huge or shared, repeated rows,
columns named like inner ones, a very long text, and no rows at all."""

from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from skein.llm import chat, jaccard, language, mixing, mpeg, packing, pii, quality, secrets, warc

BIG = 2**60 + 1
INNER = (
    "id missing key node n row text_ _t _w _p _l _s _row whole live found repository owner v salt _examples _k0 _g0 _base _more _all shard alone token prefix "
    "label cell part best lang_pred held_out media offsets _size _class _bucket _copies _rank fail_bits n_words events message _d _last html_"
).split()


def prose(k, n=70):
    return " ".join(f"w{k}x{j}" for j in range(n))


def documents(spark, extra=INNER):
    texts = [
        (None, prose(1)), (None, prose(2) + " token = abcdef99"), (None, prose(2) + " token = abcdef99"), (BIG, prose(3)), (BIG + 1, prose(3) + " tail"), (7, prose(4)), (7, prose(5)),
        (8, prose(6)), (8, prose(6)), (9, None), (10, ""), (None, None), (11, " \n\t"), (12, "é😀 ü " * 80), (13, "mail a@b.org or 10.0.0.1 " * 40),
    ]
    rows = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), *([k] * len(extra))) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` int" for c in extra)
    return spark.createDataFrame(rows, schema).repartition(3)


OPERATORS = {
    "quality": quality.report,
    "pii": lambda d: pii.report(d, pii.trained(d.sparkSession)),
    "jaccard": jaccard.classes,
    "mixing": mixing.report,
    "secrets": secrets.report,
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "language": language.report,
    "mpeg": lambda d: mpeg.features(mpeg.store(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_keeps_its_id(spark, name):
    docs = documents(spark)
    want = Counter(r.doc_id for r in docs.collect())
    got = OPERATORS[name](docs).collect()
    if name == "packing":  # a short document is one piece or two
        got = [r for r in got if r.start == 0]
    assert Counter(r.doc_id for r in got) == want
    assert OPERATORS[name](docs.limit(0)).count() == 0


def test_pages_and_conversations(spark):
    pages = spark.createDataFrame([(BIG, "u", "a", 0), (None, None, "a", 0), (BIG + 1, "u", "a", 0), (BIG + 1, "u", "b", 0)], "page_id long, url string, html string, package int")
    got = sorted(map(tuple, warc.read_back(warc.write(pages)).select("page_id", "record_type", "refers_to").collect()), key=str)
    assert got == sorted([(BIG, "revisit", BIG + 1), (None, "revisit", BIG + 1), (BIG + 1, "response", None), (BIG + 1, "response", None)], key=str)
    rows = [(i, k, "user", f"t{k}", 0) for i in (None, BIG, BIG + 1) for k in range(6)]
    made = chat.report(chat.format_log(chat.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int"))))
    assert {(r.conv_id, r.n_turns) for r in made.collect()} == {(None, 6), (BIG, 6), (BIG + 1, 6)}


def test_stages(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        kept = after.collect()
        assert kept, name
        assert stage(spark, docs.limit(0), "").count() == 0
    single = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert Counter(r.doc_id for r in single if (r.text or "").strip() and "token" not in r.text) == Counter([None, BIG, 7, 7, 8, 12, 13])
    fixed = corpus_pipeline.secret_scans(spark, docs, "").collect()
    assert len(fixed) == docs.count() and not any("abcdef99" in (r.text or "") for r in fixed)


def test_a_very_long_text(spark):
    text = " ".join(f"word{k % 5003} a{k}." for k in range(400_000))
    assert len(text) > 5_000_000
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, text + " end", None, "s"), (3, "short text " * 30, "de", "t")], "doc_id long, text string, lang string, source string")
    for name, operator in OPERATORS.items():
        rows = operator(docs).collect()
        assert {r.doc_id for r in rows} == {1, 2, 3}, name
        if name == "jaccard":
            assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 3}
