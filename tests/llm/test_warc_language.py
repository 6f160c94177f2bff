import base64
import hashlib
import io
import math
import random
import zipfile
import zlib

import numpy as np
import pytest

from skein.llm import language, warc


def test_pages(spark):
    rows = [(1, "http://a/\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (7, "u", "own"), (7, "u", "own"), (6, "u", "own"), (None, "u", "own")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, refers_to int")
    got = sorted(map(tuple, warc.read_back(warc.write(pages)).collect()), key=str)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        last = max((j for j, _, g in rows if (g or "") == (h or "") and j is not None))
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        want.append((i, len(p), digest, "response" if last == i else "revisit", None if last == i else last))
    assert got == sorted(want, key=str)
    assert warc.read_back(warc.write(pages.limit(0))).count() == 0


def test_package_is_a_zip_read_by_ranges():
    records = [warc.record(str(i), "u", bytes(range(256)) * i, None) for i in range(50)]
    data = warc.package(records)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.read(warc.ARCHIVE) == b"".join(records)
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert list(warc.records(read, len(data))) == records
    assert sum(asked) < 2 * len(data)
    asked.clear()
    assert warc.one(read, len(data), 49) == records[49] and sum(asked) < len(records[49]) + 5000 + 65557
    assert list(warc.records(*warc.ranges(io.BytesIO(data)))) == records
    with pytest.raises(ValueError):
        warc.directory(lambda at, n: b"", 0)


def test_zip64_end_record():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"{i}"), b"%d" % i)
    data = out.getvalue()
    found = warc.directory(lambda at, n: data[at : at + n], len(data))
    assert len(found) == 66_000
    at, n = found["65999"]
    assert data[at : at + n] == b"65999"


def slow_length(texts, text, order, symbols_seen):
    """Bits of a text by escaping down the contexts, one byte at a time."""

    def p(context, byte):
        if context is None:
            return 1 / 256
        after = [t[i + len(context)] for t in texts for i in range(len(t) - len(context)) if t[i : i + len(context)] == context]
        shorter = context[1:] if context else None
        if not after:
            return p(shorter, byte)
        n, seen = len(after), set(after)
        if byte in seen:
            mass = after.count(byte) / (n + len(seen))
        else:
            mass = len(seen) / (n + len(seen)) * p(shorter, byte) / (1 - sum(p(shorter, b) for b in seen))
        return mass / (1 if len(seen) < 256 else n / (n + len(seen)))

    full = b"\n" * order + text
    return sum(-math.log2(p(full[i - order : i], full[i])) for i in range(order, len(full)))


@pytest.mark.parametrize("order", [0, 2, 4])
def test_code_lengths_match_the_tree(order, monkeypatch):
    texts = {"x": [b"abab\nabc abab", b"aab"], "y": [b"bbc\xc3\xa9"], "z": [bytes(range(256)) * 2]}
    model = language.fit({k: language.Tree.unpack(language.tree(t, order).pack()) for k, t in texts.items()})
    probe = [b"abc", b"\xc3\xa9zab", b"~~", b"a\n", b"abab\nabcabab" * 5]
    for stretch in (1 << 19, 7):
        monkeypatch.setattr(language, "STRETCH", stretch)
        got = language.lengths(model, probe)
        for j, name in enumerate(model.languages):
            for i, t in enumerate(probe):
                assert got[i, j] == pytest.approx(slow_length(texts[name], t, order, None), rel=1e-4)
    for context in (b"abab", b"zzzz", b"\xc3\xa9ab"):  # a context's bytes have probability 1 together
        windows = np.array([int.from_bytes(context[4 - order :] + bytes([b]), "big") for b in range(256)], dtype=np.uint64)
        assert np.allclose(np.exp2(-model.lookup(windows, order).astype(float)).sum(axis=0), 1, atol=1e-4)


def test_predictions(spark):
    rng = random.Random(2)
    words = {"en": ["the", "of", "ing", "and"], "de": ["der", "über", "ung", "ß"], "fr": ["élé", "eau", "que", "où"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k, "s", 1) for i, k in enumerate(["en", "de", "fr"] * 60)]
    rows += [(900, None, "en", "s", 1), (901, "", None, "s", 1), (902, "12 .", "de", "s", 1), (903, "the and " * 30000, None, None, 1), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int")
    got = language.report(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(by[i].lang_pred == k for i, _, k, *_ in rows[:180])
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "en"] and by[900].score == 0
    assert all(0 <= r.score <= 1 for r in got)
    assert language.report(docs.limit(0)).count() == 0


def test_every_language_is_learned(spark, monkeypatch):
    """More labels than a table and a pass hold: as if all were scored at once, the rarest too."""
    rng = random.Random(8)
    monkeypatch.setattr(language, "TABLES", 30_000)
    names = [f"l{k:02d}" for k in range(40)]
    own = {k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(4)) for _ in range(4)] for k in names}
    rows = [(i, " ".join(rng.choice(own[k]) for _ in range(12)), k) for i, k in enumerate(n for j, n in enumerate(names) for _ in range(12 if j else 8))]
    rows += [(None, " ".join(own["l34"]), None), (2**60 + 1, " ".join(own["l00"]), None), (2000, "1 2", "l03")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(list(language.models(docs))) > 1
    got = {r.doc_id: r for r in language.report(docs).collect()}
    assert len(got) == len(rows)
    texts = {k: [t.encode() for i, t, lang in rows if lang == k and zlib.crc32(str(i).encode()) % 4 != 2] for k in names}
    bits = language.lengths(language.fit({k: language.tree(t) for k, t in texts.items()}), [t.encode() for _, t, _ in rows])
    for (i, t, k), b in zip(rows, bits, strict=True):
        if t != "1 2":
            assert got[i].lang_pred == names[b.argmin()]
            assert got[i].score == pytest.approx(1 / np.exp2(b.min() - b).sum(), rel=1e-3)
            assert k is None or got[i].lang_pred == k
    assert got[None].lang_pred == "l34" and got[2**60 + 1].lang_pred == "l00" and got[2000].lang_pred == "und"


def test_all_byte_values_stay_small():
    rng = random.Random(3)
    noise = [bytes(rng.randrange(256) for _ in range(50_000)) for _ in range(4)]
    model = language.fit({f"n{k}": language.tree([t]) for k, t in enumerate(noise)})
    assert sum(a.nbytes for a in (*model.bits, *model.windows, *model.escapes, *model.contexts)) < 100 << 20
    assert language.lengths(model, noise).argmin(axis=1).tolist() == [0, 1, 2, 3]
