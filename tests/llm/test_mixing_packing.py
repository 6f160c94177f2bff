import random
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from skein.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, size int, _row int"


def fill(sizes, weights):
    """Targets by sharing again, as the rule says."""
    target, full = {}, set()
    left = Fraction(3, 2) * sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in full]
        if not free:
            return target
        room = left - sum(2 * sizes[s] for s in full)
        target = {s: Fraction(2 * sizes[s]) for s in full} | {s: room * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    rng = random.Random(seed)
    names = ["a", "B", "é", "zz", "10", None, ""][: 3 + 2 * seed]
    rows = [(i, " ".join("w" * rng.choice([0, 1, 5, 30, 200])), rng.choice(names + names[:1] * 4), 1, 2) for i in range(400)]
    rows += [(400, None, "a", 1, 2), (401, "", "none", 1, 2), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.report(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(float(want[s]), abs=1e-6)
        assert r["size"] == len((next(t for i, t, *_ in rows if i == r.doc_id) or "").split())
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.03 * float(t), 200)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.report(docs.repartition(5)).collect()))
    mixed = mixing.expand(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(taken.values())


def test_mix_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert mixing.report(docs).count() == 0 and mixing.expand(docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_windows_are_best(seed):
    rng = random.Random(seed)
    length = 16
    at = [0]
    while len(at) < 40:
        at.append(at[-1] + rng.choice([1, 2, 3, 5, 9, 16]))
    cost = [0] + [rng.choice([0, 2, 5]) for _ in at[1:]]
    found = packing.windows(np.array(at), np.array(cost), length)

    def spent(stops):
        total, last = 0, 0
        for s in stops:
            n = s - last
            assert 0 < n <= length
            total += (packing.SHORT if n & (n - 1) == 0 and n < length and packing.SHORT < length - n else length - n) + cost[at.index(s)]
            last = s
        return total

    best = {0: 0}
    for j in range(1, len(at)):
        options = [best[at[i]] + min(length - (at[j] - at[i]), packing.SHORT if (at[j] - at[i]) & (at[j] - at[i] - 1) == 0 and at[j] - at[i] < length else 10**9) for i in range(j) if at[j] - at[i] <= length]
        best[at[j]] = min(options) + cost[j]
    assert found[-1] == at[-1] and spent(found) == best[at[-1]]


def test_pack_round_trip(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "Thndble", "ou.", "é!", "x\ny", "<|endoftext|>", "it's 12", "\x1c a b"]) for _ in range(rng.choice([0, 1, 40, 900, 3000]))), "s", 1, 2) for i in range(120)]
    rows += [(500, None, "s", 1, 2), (501, "", "s", 1, 2), (502, "blah" * 9000, None, 1, 2), (503, "a b " * 60000, None, 1, 2), rows[3], rows[3]]
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(spark.createDataFrame(rows, SCHEMA), path, shard=64).collect()
    t = Tokenizer.from_file(path)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], dtype="<u4") for i, x, *_ in rows}
    times = {i: sum(r[0] == i for r in rows) for i in ids}
    covered, sequences = dict.fromkeys(ids, 0), {}
    for r in got:
        d = ids[r.doc_id]
        assert r.doc_tokens == len(d) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(d[r.start : r.start + r.length].tobytes())
        covered[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == {i: times[i] * len(d) for i, d in ids.items()}
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        total += at
    assert padding < 0.05 * total
    small = packing.pack(spark.createDataFrame(rows, SCHEMA), path, shard=64, stream=5000).collect()
    assert sum(r.length for r in small) == total and len({(r.sequence_id, r.offset) for r in small}) == len(small)
    assert packing.pack(spark.createDataFrame([], SCHEMA), path).count() == 0


def test_ids_of_every_letter():
    """Letters that change into letter and mark join the marks behind them."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens, t = packing.Tokens(path), Tokenizer.from_file(path)
    same = lambda x: np.frombuffer(tokens.ids(x), dtype="<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    letters = [c for c in map(chr, range(0x110000)) if c.isalpha()]
    for mark in ".,!?;:":
        for k in range(0, len(letters), 20_000):
            assert same(" ".join(f"a{c}{mark}" for c in letters[k : k + 20_000]))
    rng = random.Random(6)
    odd = ["a", "B", "\u0130", "\ufb1d", "\u0301", ".", "!", ":", "'s", " ", "\n", "\u00df", "\u03a3", "1", "\u0958", "\t", "-"]
    for _ in range(2000):
        assert same("".join(rng.choice(odd) for _ in range(rng.randrange(1, 30))))
