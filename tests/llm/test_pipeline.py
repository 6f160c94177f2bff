import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_jaccard import brute as components
from test_mixing_packing import fill
from test_pii_secrets import brute_secrets
from test_quality import brute as measures
from tokenizers import Tokenizer

import corpus_pipeline
from skein.llm import secrets
from skein.llm.registry import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(150):
        t = " ".join(rng.choice(words) for _ in range(rng.choice([20, 60, 200, 900])))
        if i % 9 == 0 and i:
            t = rows[i - 1][1]
        if i % 7 == 0:
            t += " token = q%06dzz more" % (i if i % 2 else 0)
        if i % 11 == 0:
            t = re.sub(" ", "$$ ", t)
        rows.append((i, t, "en", f"src{rng.choice([0, 0, 0, 1, 2, 3])}" if i % 30 else None, len(t)))
    return [*rows, (900, None, None, "src1", 0), (901, "", "en", None, 0)]


def rejected(t):
    n, chars, symbols, dup, repeat = measures(t)
    lines = [x for x in (t or "").split("\n") if x.split()]
    capitals = len(re.findall("[A-Z]", t or ""))
    return n < 50 or 100 * repeat > 50 * n or 100 * symbols > 2 * len(t) or 100 * capitals > 30 * len(t) or (len(lines) >= 4 and 100 * dup > 30 * len(lines)) or not 2 * n <= chars <= 20 * n


def redacted(rows):
    value = lambda t, s, k, e: secrets_value(t[s:e]) if k == 0 else t[s:e]
    secrets_value = lambda m: re.search(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$""", m)[1]
    owners = defaultdict(set)
    found = {r[0]: brute_secrets(r[1]) for r in rows}
    for r in rows:
        for s, k, e, _ in found[r[0]]:
            owners[value(r[1], s, k, e)].add(r[3])
    out = []
    for r in rows:
        t = r[1]
        for s, k, e, _ in sorted(found[r[0]], reverse=True):
            if len(owners[value(r[1], s, k, e)]) < secrets.EXAMPLE_OWNERS:
                t = t[:s] + "[SECRET]" + t[e:]
        out.append((r[0], t, r[2], r[3], len(t)))
    return out


def mixed(rows):
    by, sizes = defaultdict(list), Counter()
    for r in rows:
        n = len(r[1].split())
        sizes[r[3]] += n
        power = (n + 1).bit_length()
        by[r[3]].append((power * 8 + (n + 1) * 8 // 2 ** (power - 1) - 8, int(hashlib.md5(str(r[0]).encode()).hexdigest()[:4], 16) % 64, n, r[0], r))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    out = []
    for s, docs in by.items():
        offset = int(hashlib.md5(f"mix-1|{s or ''}|{str(s is None).lower()}".encode()).hexdigest()[:8], 16) / 16**8
        each = float(want[s]) / sizes[s]
        for rank, (*_, r) in enumerate(sorted(docs, key=lambda d: d[:4]), 1):
            out += [r] * (math.floor(rank * each + offset) - math.floor((rank - 1) * each + offset))
    return out


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = [r for r in rows if not rejected(r[1])]
    groups = components(kept)
    single = [r for r in kept if groups[r[0]][1] == r[0]]
    want = [sorted(kept), sorted(single), sorted(redacted(single)), sorted(mixed(redacted(single)))]
    assert len(rows) > len(kept) > len(single) and "[SECRET]" in str(want[2]) and "token = q000000zz" in str(want[2])
    for (_, stage), expected in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        after = stage(spark, docs, "")
        assert after.columns == docs.columns
        assert sorted(map(tuple, after.collect()), key=str) == sorted(expected, key=str)
        docs = spark.createDataFrame(expected, SCHEMA)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    t = Tokenizer.from_file(tokenizer_file())
    covered, wanted = Counter(), Counter()
    texts = {r[0]: np.array([*t.encode(r[1], add_special_tokens=False).ids, 2], dtype="<u4") for r in want[-1]}
    for r in want[-1]:
        wanted[r[0]] += len(texts[r[0]])
    for r in got:
        assert r.ids_crc32 == zlib.crc32(texts[r.doc_id][r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
    assert covered == wanted


def test_empty_and_entry(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and sum(bool(re.match(r"op\d+_", n)) for n in names) == 10
    assert set(__spark_entry__.oracle_sql()) <= names
