import random

import pytest
from pyspark.sql import functions as F

from skein.llm import bitmaps, jaccard
from skein.operators import components

SCHEMA = "doc_id long, text string, node int, n int"


def brute(rows):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        w = jaccard.words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 3 * max(len(sets[a]), len(sets[b])) <= 4 * min(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage, texts = fresh(60), [None, "", " \n", "One two", "one  TWO", "a b c d e", "A B C D E", "é È a b c", "é È a b c d", "é è a b c"]
    for _ in range(25):
        w = fresh(rng.choice([8, 20, 60, 150, 400]))
        for _ in range(rng.choice([1, 2, 5, 12])):
            c = list(w)
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(c[rng.choice([0, 0, 3]) :]))
    for _ in range(60):  # mostly the common passage
        texts.append(" ".join(fresh(rng.choice([3, 8, 15, 40])) + passage + fresh(rng.choice([0, 2, 6, 30]))))
    return [(i, t, 0, 0) for i, t in enumerate(texts)]


@pytest.mark.parametrize(
    ("seed", "costs"),
    [(1, {}), (2, {"costly": 1, "longer": 2.0}), (3, {"small": 1, "first": 0.3}), (4, {"small": 10**6}), (5, {"spread": 2, "step": 1.5, "small": 40})],
)
def test_matches_all_pairs(spark, seed, costs):
    rows = corpus(seed)
    rows += [rows[20], rows[20], (9999, rows[30][1], 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = jaccard.classes(docs, jaccard.Costs(**costs)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_representatives(spark):
    rows = corpus(9)[:40]
    want = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, (_, c) in want.items() if c == i]
    assert jaccard.classes(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(5, 5)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    want = {}
    for a, b in edges:
        if a != b:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_heavy_tokens_of_no_partner_count_once(spark):
    """Footers that only texts of far larger size share are heavy, though no partner holds them."""
    fresh = lambda name, n: [f"{name}{k}" for k in range(n)]
    passage, feet = fresh("p", 304), [fresh("a", 44), fresh("b", 44)]
    rows = [" ".join(passage + foot) for foot in feet]
    rows += [" ".join(fresh(f"l{k}x", 800) + feet[0] + fresh(f"m{k}x", 10) + feet[1]) for k in range(12)]
    rows += [" ".join(fresh(f"s{k}x", 700) + passage) for k in range(20)]
    rows = [(i, t, 0, 0) for i, t in enumerate(rows)]
    want = brute(rows)
    assert want[1] == (344, 0)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want


@pytest.mark.parametrize("costs", [{}, {"spread": 16, "small": 400}])
def test_large_group_near_the_threshold(spark, costs):
    """Copies of one text, most just under or over the threshold, of the same and other sizes."""
    rng = random.Random(12)
    source = [f"w{rng.randrange(10**5)}" for _ in range(150)]
    rows = [(0, " ".join(source), 0, 0)]
    for i in range(1, 361):
        c = list(source)
        for _ in range(rng.choice([0, 3, 4, 4, 5, 5, 6])):
            c[rng.randrange(len(c))] = f"x{rng.randrange(10**7)}"
        if i % 3 == 0:
            c = c[rng.randrange(12) : len(c) - rng.randrange(12)]
        if i % 7 == 0:
            c += [f"y{rng.randrange(10**7)}" for _ in range(rng.randrange(12))]
        rows.append((i, " ".join(c), 0, 0))
    want = brute(rows)
    assert 40 < sum(c != 0 for _, c in want.values()) < 320
    got = jaccard.classes(spark.createDataFrame(rows, SCHEMA).repartition(5), jaccard.Costs(**costs)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_bitmaps_lose_no_row(spark):
    rows = spark.range(200_000).select("id", (F.col("id") * 7).alias("b"), F.lit("x").alias("text"))
    keys = rows.filter("id % 37 = 0").select("id", "b")
    met = bitmaps.maybe(rows, keys, ["id", "b"])
    assert met.columns == rows.columns
    assert keys.join(met, ["id", "b"], "left_anti").count() == 0 and keys.count() <= met.count() < 0.15 * 200_000
    assert bitmaps.maybe(rows, keys, ["id", "b"], most=10).count() == 200_000
    assert bitmaps.maybe(rows, keys.limit(0), ["id", "b"]).count() == 0


def near_copies(seed, n):
    """Pairs of near copies, the copies apart from the texts."""
    rng = random.Random(seed)
    texts = [[f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(n)]
    return [" ".join(w) for w in texts], [" ".join([*w[:-2], "other", "end"]) for w in texts]


def test_null_ids(spark):
    """Null ids spoil no other row's tokens, and their own texts link."""
    texts, copies = near_copies(5, 12)
    big = 1234567890123456789
    part = lambda rows: spark.createDataFrame(spark.sparkContext.parallelize(rows, 1), SCHEMA)
    first = part([(None, "without id", 0, 0), *((big + 2 * i, t, 0, 0) for i, t in enumerate(texts[:8]))])
    second = part([(big + 2 * i + 1, t, 0, 0) for i, t in enumerate(copies[:8])])
    # only null ids hold the text, or the copy too
    third = part([(None, texts[8], 0, 0), (None, texts[9], 0, 0), (big + 101, copies[8], 0, 0), (None, copies[9], 0, 0)])
    # one id, two texts, each with a copy
    fourth = part([(7, texts[10], 0, 0), (7, texts[11], 0, 0), (8, copies[10], 0, 0), (9, copies[11], 0, 0)])
    docs = first.union(second).union(third).union(fourth)
    assert docs.rdd.getNumPartitions() == 4
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs).collect()), key=str)
    want = [(big + k, 76, big + k - k % 2) for k in range(16)]
    want += [(None, 1, None), (None, 76, big + 101), (big + 101, 76, big + 101), (None, 76, None), (None, 76, None)]
    want += [(7, 76, 7), (7, 76, 7), (8, 76, 7), (9, 76, 7)]
    assert got == sorted(want, key=str)
    heads, labels = jaccard.links(docs)
    assert labels.groupBy("label").count().count() == 12


def test_representatives_by_row(spark):
    """Rows without doc_id, and different texts with one doc_id, go only as duplicates."""
    texts, copies = near_copies(6, 9)
    kept = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (3, texts[4]), (8, texts[5])]
    kept += [(None, None), (None, ""), (None, " \n"), (5, ""), (6, None)]
    gone = [(None, copies[1]), (9, copies[2]), (8, copies[4]), (None, copies[4]), (None, copies[5]), (5, "")]
    both = [(None, texts[6]), (None, texts[6])]  # equal rows: once
    rows = [(i, t, k, None) for k, (i, t) in enumerate(kept + gone + both)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), SCHEMA)
    got = jaccard.representatives(docs)
    assert got.schema == docs.schema
    got = [(r.doc_id, r.text) for r in got.collect()]
    # of two near copies without doc_id either may stay
    got = [(None, texts[1]) if r == (None, copies[1]) else r for r in got]
    assert sorted(got, key=str) == sorted([*kept, both[0]], key=str)
