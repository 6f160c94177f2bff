import hashlib
import random
import zlib

import pytest

from skein.llm import chat, mpeg


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_escape_round_trip():
    rng = random.Random(1)
    for _ in range(3000):
        turns = [("".join(rng.choice(["a", ":", ": ", "#", "### ", "\\", "</turn>", "\n"]) for _ in range(rng.randrange(4))), "".join(rng.choice(["\\", "#", "###", "</turn>", "</turn>\n", "<", " ", "ok", ": ", "\n"]) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(5))]
        assert chat.parse(chat.render(turns)[0]) == turns


def test_fold():
    log = [(0, 1, "open", "user", None), (1, 1, "delta", None, "he"), (2, 2, "open", "assistant", None), (3, 1, "delta", None, "y"), (4, 2, "delta", None, "no"), (5, 2, "regenerate", None, None), (6, 2, "delta", None, "yes"), (7, 1, "edit", None, "hi"), (8, 3, "delta", "user", "x"), (9, 3, "drop", None, None), (10, 4, "?", None, None)]
    assert chat.fold(log) == [("user", "hi"), ("assistant", "yes")]


def test_every_history_passes(spark):
    """The log of a table holds edits, regenerations and drops, and folds to the table's texts."""
    rows = [(1, k, "assistant" if k % 2 else "user", f"text {k} of \u00e9") for k in range(12)]
    rows += [(None, k, "user", f"{k}") for k in range(5)] + [(2**60 + 1, 0, "user", "x")]
    log = chat.as_log(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"open", "delta", "regenerate", "edit", "drop"}
    made = {r.conv_id: chat.parse(r.formatted) for r in chat.format_log(log).collect()}
    assert made == {i: [(role, t) for j, _, role, t in rows if i == j] for i in (1, None, 2**60 + 1)}
    assert {r.conv_id for r in chat.report(chat.format_log(log)).collect()} == set(made)


def test_conversations(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "assistant", "A\u00e9"), (1, 3, "assistant", None), (2, 1, None, ""), (3, 1, "user", "x"), (3, 1, "user", "x"), (4, None, "assistant", "y" * 100_000)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, events int")
    got = {r.conv_id: r for r in chat.report(chat.format_log(chat.as_log(chat.probe(table)))).collect()}
    assert set(got) == {1, 2, 3, 4, -7}
    assert (got[1].n_turns, got[1].turns_sha256) == (3, sha("assistant\nA\u00e9\nuser\nb\nassistant\n\n"))
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("A\u00e9"))
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_sha256 == sha("") and got[3].n_turns == 2
    probe = r"\### Assistant: </turn> ok"
    assert got[-7].turns_sha256 == sha(f"user\n{probe}\nassistant\n{probe}\n") and got[-7].loss_sha256 == sha(probe)
    assert chat.format_log(chat.as_log(table.limit(0))).count() == 0


def test_stored_and_read_back(spark):
    texts = ["", None, "a", "é" * 288, "x" * 577, "😀 b\n" * 5000, "a"]
    docs = spark.createDataFrame([(i, t, b"0") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    got = {r.doc_id: r for r in mpeg.features(mpeg.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert f"frames={len(p) // 576};duration={len(p) // 576 * 1152}/44100;" in r.feature and r.feature.endswith("bad=0;skipped=0")
    assert tuple(got[2])[1:] == tuple(got[6])[1:]
    assert mpeg.features(mpeg.store(docs.limit(0))).count() == 0


def test_scan_resynchronises():
    payload = bytes(range(256)) * 9
    media = mpeg.encode(payload, 5)
    clean = mpeg.scan(media)
    assert clean.payload == payload and clean.table[0] == 4 and not clean.bad
    cut = clean.offsets[1]
    assert mpeg.seek(clean, 1152) == cut and mpeg.seek(clean, clean.samples) is None
    hurt = mpeg.scan(media[:cut] + b"\xff\xfb\xff junk \xff" + media[cut:] + b"TAG" + bytes(125))
    assert hurt.payload == payload and hurt.skipped == 10
    flipped = bytearray(media)
    flipped[clean.offsets[2] + 8] ^= 1
    assert mpeg.scan(bytes(flipped)).bad == 1
    for bare in (b"", b"no frames at all", b"ID3", b"\xff\xfb\x90\x00"):
        empty = mpeg.scan(bare)
        assert not empty.offsets and mpeg.seek(empty, 0) is None and empty.length == 0
        assert mpeg.feature(empty).startswith("frames=0;duration=0/1;kbits=none;")


def test_variable_bitrate_and_layers():
    """Frames of several sizes behind a VBRI table and an unsynchronised tag; offsets and durations are exact."""
    rng = random.Random(4)
    for version, layer in ((1, 3), (2, 3), (25, 3), (1, 2), (1, 1), (2, 1)):
        rates = (mpeg.RATES_1 if version == 1 else mpeg.RATES_2)[layer]
        make = lambda k: mpeg.Header(version, layer, False, 48000 // {1: 1, 2: 2, 25: 4}[version], k, rng.random() < 0.5, False)  # noqa: B023, E731
        frames = [make(rng.choice(rates[2:])) for _ in range(40)]
        body = b"".join(h.bits.ljust(h.size, b"\0") for h in frames)
        table = b""
        if layer == 3:
            top = make(rates[14])
            table = top.bits.ljust(36, b"\0") + b"VBRI" + bytes(6) + (9).to_bytes(4, "big") + (40).to_bytes(4, "big") + (2).to_bytes(2, "big") + bytes(2) + (1).to_bytes(2, "big") + bytes(2) + b"ab"
            table = table.ljust(top.size, b"\0")
        title = b"TIT2" + (4).to_bytes(4, "big") + b"\0\0" + b"\0\xff\0x"
        tag = title.replace(b"\xff", b"\xff\0")
        data = b"ID3\x03\0\x80" + bytes([0, 0, 0, len(tag)]) + tag + table + body
        found = mpeg.scan(data)
        at, want = len(data) - len(body), []
        for h in frames:
            want.append(at)
            at += h.size
        assert found.offsets == want and found.samples == 40 * frames[0].samples and found.skipped == 0
        assert found.table == ((40, 9, b"ab") if layer == 3 else None) and "kbits=variable" in mpeg.feature(found)
        assert [mpeg.seek(found, k * frames[0].samples + 5) for k in range(40)] == want


def test_any_bytes(spark):
    rng = random.Random(9)
    media = [None, b"", b"\xff" * 5000, *(bytes(rng.choice(b"\xff\xfb\x90\x00ID3TXing") for _ in range(rng.randrange(3000))) for _ in range(60))]
    table = spark.createDataFrame([(i if i % 2 else None, m) for i, m in enumerate(media)], "doc_id long, media binary")
    got = mpeg.features(table).collect()
    assert len(got) == len(media) and all(r.media_bytes >= 0 and f"frames={len(r.offsets)};" in r.feature for r in got)


@pytest.mark.parametrize(("bits", "size"), [(b"\xff\xfb\x90\x00", 417), (b"\xff\xfb\x92\x00", 418), (b"\xff\xf3\x84\xc0", 192), (b"\xff\xe3\x84\xc0", 384), (b"\xff\xfd\x90\x00", 522), (b"\xff\xff\x90\x00", 312)])
def test_frame_sizes(bits, size):
    assert mpeg.header(bits, 0).size == size


def test_crc():
    assert mpeg.crc16(b"123456789") == 0xAEE7
