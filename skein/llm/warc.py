"""WARC records in ZIP packages, read by ranges without extraction.

Pages are written as WARC records into ZIP packages of about ``PACKAGE`` bytes, each with a
stored archive member and a stored index member. Of pages with equal payloads the one with the
largest page_id is the response; the others are revisit records that refer to it. The packages
are rows of a table, so they live on any store that Spark writes (Python workers reach a store
through Spark only; ``ranges`` serves files that they can open). The reader parses the end
record, the ZIP64 locator and the central directory, finds the stored members, and reads single
records by their ranges in the index.

Which payloads repeat is counted over all pages and joined back salted, so pages that share
one payload spread over ``SALTS`` tasks.

Defined cases: a null html is an empty payload; payloads under ``LEAST`` bytes are all responses;
very long pages are one record, in a package of its own size; ties, that is
equal rows, page_id and payload alike, are each written and, where largest, each a response; a
null page_id is kept and is never a response that others refer to; a null url has no target URI;
other columns, whatever their names, are ignored; an empty table gives no packages.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.session import materialize

PACKAGE = 4 << 20
SALTS = 64
LEAST = 0
ARCHIVE, INDEX = "archive/data.warc", "indexes/index.cdxj"
PACKED = "package binary"
#: Ids are decimal digits on their way through pandas, which has no integers with nulls.
READ = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
_EPOCH = (2024, 1, 1, 0, 0, 0)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: str | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def package(records: list[bytes]) -> bytes:
    """A ZIP package of stored members: the records and an index of their ranges."""
    index, at = [], 0
    for r in records:
        index.append(json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, parts in ((ARCHIVE, records), (INDEX, ["\n".join(index).encode()])):
            with z.open(zipfile.ZipInfo(name, _EPOCH), "w", force_zip64=True) as member:
                for p in parts:
                    member.write(p)
    return out.getvalue()


Read = Callable[[int, int], bytes]


def directory(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """(place, length) of the data of each stored member; ``read(at, n)`` gives a range.

    ZIP64 sizes and places are taken from the extra fields and the ZIP64 end record.
    """
    tail_at = max(0, size - 65557)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, at):
        if tail[end - 20 : end - 16] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        (place,) = struct.unpack_from("<Q", tail, end - 12)
        far = read(place, 56)
        if far[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end record")
        length, at = struct.unpack_from("<QQ", far, 40)
    central, p, found = read(at, length), 0, {}
    while p + 46 <= len(central):
        if central[p : p + 4] != b"PK\x01\x02":
            raise ValueError(f"no directory entry at {p}")
        (method,) = struct.unpack_from("<H", central, p + 10)
        packed, plain, n_name, n_extra, n_note = struct.unpack_from("<IIHHH", central, p + 20)
        (local,) = struct.unpack_from("<I", central, p + 42)
        name = central[p + 46 : p + 46 + n_name].decode("utf-8")
        extra = central[p + 46 + n_name : p + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            extra = extra[4 + n :]
        if method == 0:
            head = read(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError(f"no local header of {name}")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", head, 26)), packed)
        p += 46 + n_name + n_extra + n_note
    return found


def ranges(file: BinaryIO) -> tuple[Read, int]:
    """Range reads of an open file of any file system, and its size; nothing else is read."""
    size = file.seek(0, io.SEEK_END)

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read, size


def one(read: Read, size: int, k: int) -> bytes:
    """Record number k of a package, reading the directory, the index and that record only."""
    members = directory(read, size)
    entry = json.loads(read(*members[INDEX]).decode().split("\n")[k])
    return read(members[ARCHIVE][0] + entry["offset"], entry["length"])


def records(read: Read, size: int) -> Iterator[bytes]:
    """The records of a package, each read by its range in the index."""
    members = directory(read, size)
    index = read(*members[INDEX])
    base = members[ARCHIVE][0]
    for line in index.decode().split("\n"):
        if line:
            entry = json.loads(line)
            yield read(base + entry["offset"], entry["length"])


def parse(data: bytes) -> tuple[str | None, int, str, str, str | None]:
    """A row of ``READ``; a response's payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    n = int(next(line.split(b": ")[1] for line in http.split(b"\r\n") if line.startswith(b"Content-Length")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda urn: None if urn is None or "null" in urn else urn.strip("<>").rpartition(":")[2]
    if fields["WARC-Type"] == "response" and (len(payload) != n or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is damaged")
    return number(fields["WARC-Record-ID"]), n, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


def _packages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for batch in batches:
        for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], strict=True):
            held.append(record(page_id, url, html.encode(), refers_to))
            n += len(held[-1])
            if n >= PACKAGE:
                yield pd.DataFrame({"package": [package(held)]})
                held, n = [], 0
    if held:
        yield pd.DataFrame({"package": [package(held)]})


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in READ.split(", ")]
    for batch in batches:
        for data in batch["package"]:
            view = memoryview(data)
            rows = [parse(r) for r in records(lambda at, n, v=view: bytes(v[at : at + n]), len(view))]
            yield pd.DataFrame(rows, columns=names)


def judged(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``refers_to``, which is null for responses."""
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("_d"), F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("_s"))
    known = pages.select("page_id", F.sha1(html).alias("_d")).filter(F.octet_length(html) >= least)
    again = known.groupBy("_d").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    again = again.select("_d", "_last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    df = own.join(again, ["_d", "_s"], "left")
    refers = F.when(F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id")), F.col("_last"))
    return df.select("page_id", "url", "html", refers.alias("refers_to"))


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Packages of the records of all pages, written to the shared folder."""
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = judged(pages, least).select(text("page_id"), "url", "html", text("refers_to"))
    return materialize(rows.mapInPandas(_packages, PACKED), "warc")


def read_back(packages: DataFrame) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` of all records."""
    whole = lambda c: F.col(c).cast("long").alias(c)
    made = packages.mapInPandas(_records, READ)
    return made.select(whole("page_id"), "payload_bytes", "payload_digest", "record_type", whole("refers_to"))
