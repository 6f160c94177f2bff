"""Order-preserving packing of tokenized documents into sequences by dynamic programming.

Documents are dealt by a hash to shards of about ``SHARD`` documents, each in the order of doc_id.
Whole documents of a shard are taken together up to ``STREAM`` tokens, and form one stream (a longer document
is a stream of its own); a sequence is a window of it, so order is kept, each token lies in
exactly one piece, and a task holds one stream whatever the shard. Windows end at document ends,
sentence ends or, within long sentences, at every ``STEP`` tokens. The dynamic programme

    f[j] = penalty(j) + min over i of f[i] + padding(j - i)

minimises padding plus penalties for cuts within documents. Padding falls linearly with the
length, so the best i of the last ``LENGTH`` tokens comes from a monotone queue on f[i] + i;
windows of a power-of-two length, which need no padding, are looked up besides.

Defined cases: a null or empty text is the end token alone; long documents are cut into as many
pieces as they need; rows that repeat, also by doc_id, are documents of their own; rows without
doc_id are packed, as documents without one, before the others of their shard; ties of doc_id are
ordered by text; other columns, whatever their names, are ignored; an empty table gives an empty
result. Equal rows share a shard, all others are spread.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import ids

LENGTH = 4096
SHARD = 2048
STREAM = 1 << 20
STEP = 64
END_ID = 2
#: Cost in tokens of a cut at a sentence end, of one elsewhere, and of a short unpadded window.
AT_SENTENCE, ANYWHERE, SHORT = 8, 64, 256
SENTENCE_ENDS = (".", "!", "?")
OUTPUT = f"{ids.SCHEMA}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of texts, with the ids of what was met before kept, ``KEPT`` entries at most.

    The tokenizer drops white space and never joins what a space or line feed parts, so the ids of
    a text are those of its parts. It parts letters from marks after lower-casing and composing,
    which leave every Latin-1 letter one letter: so the ids of a Latin-1 word with marks behind it
    are those of the word, in lower case, and of the marks. Other parts are encoded as they are,
    since some letters turn into a letter and a combining mark, which joins the marks behind it.
    """

    KEPT = 1_200_000

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.ends = np.array([i for i in (self.tokenizer.token_to_id(f"{c}</w>") for c in SENTENCE_ENDS) if i is not None], dtype=np.uint32)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        for text, e in zip(texts, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            yield text, np.array(e.ids, dtype="<u4").tobytes()

    def _learn(self, missing: set[str]) -> dict[str, bytes]:
        split, new = {}, set()
        for p in missing:
            word = p.rstrip(".,!?;:")
            mark = p[len(word) :]
            if word.isalpha() and max(word) <= "\xff":
                word = word.lower()
            else:
                word, mark = p, ""
            split[p] = (word, mark)
            if word not in self.words:
                new.add(word)
            if mark not in self.marks:
                self.marks[mark] = next(self._encoded([mark]))[1]
        fresh = dict(self._encoded(list(new))) if new else {}
        if len(self.words) < self.KEPT:
            self.words.update(fresh)
        made = {p: (fresh.get(word) or self.words.get(word, b"")) + self.marks[mark] for p, (word, mark) in split.items()}
        if len(self.parts) < self.KEPT // 2:
            self.parts.update(made)
        if len(self.marks) > 10_000:
            self.marks = {"": b""}
        return made

    def ids(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        found = list(map(self.parts.get, parts))
        if None in found:
            made = self._learn({p for p, f in zip(parts, found, strict=True) if f is None})
            found = [made[p] if f is None else f for p, f in zip(parts, found, strict=True)]
        return b"".join(found)


_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One ``Tokens`` per worker process and file."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


def cuts(docs: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places in the stream where a window may end, with the penalty of each."""
    stream = np.concatenate(docs)
    cost = np.full(len(stream) + 1, -1, dtype=np.int64)
    cost[np.flatnonzero(np.isin(stream, ends)) + 1] = AT_SENTENCE
    cost[np.cumsum([len(d) for d in docs])] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    gaps = np.diff(at)
    for k in np.flatnonzero(gaps > 4 * STEP):
        cost[at[k] + STEP : at[k + 1] : STEP] = ANYWHERE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def windows(at: np.ndarray, cost: np.ndarray, length: int = LENGTH) -> list[int]:
    """Places where the best windows end; gaps in ``at`` are at most ``length``."""
    n = len(at)
    jumps: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    power = 1
    while power <= length:
        i = np.searchsorted(at, at - power)
        hit = np.flatnonzero((at >= power) & (at[np.minimum(i, n - 1)] == at - power))
        for j, k in zip(hit.tolist(), i[hit].tolist(), strict=True):
            jumps[j].append((k, 0 if power == length else SHORT))
        power *= 2
    places, costs = at.tolist(), cost.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (f[i] + i's place, i), ascending
    for j in range(1, n):
        here = places[j]
        while places[queue[0][1]] < here - length:
            queue.popleft()
        f, i = queue[0]
        f += length - here
        for k, extra in jumps[j]:
            if best[k] + extra < f:
                f, i = best[k] + extra, k
        best[j], back[j] = f + costs[j], i
        key = best[j] + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    found, j = [], n - 1
    while j:
        found.append(places[j])
        j = back[j]
    return found[::-1]


def pieces(first: int, names: list[tuple[bool, int]], docs: list[np.ndarray], ends: np.ndarray) -> dict[str, list]:
    """Rows of ``OUTPUT`` for one stream; ``first`` is the id of its first sequence."""
    out: dict[str, list] = {c.split()[0]: [] for c in OUTPUT.split(", ")}
    stops = windows(*cuts(docs, ends))
    w, begin, base = 0, 0, 0  # the window, where it begins, and where the document begins
    for name, d in zip(names, docs, strict=True):
        done = 0
        while done < len(d):
            if base + done == stops[w]:
                begin, w = stops[w], w + 1
            n = min(len(d) - done, stops[w] - base - done)
            row = (*name, done, n, zlib.crc32(d[done : done + n].tobytes()), len(d), first + w, base + done - begin)
            for column, v in zip(out.values(), row, strict=True):
                column.append(v)
            done += n
        base += len(d)
    return out


@dataclass
class _Shards:
    """Packs the sorted rows of whole shards; holds the tokens of one stream."""

    path: str
    stream: int

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = tokens_of(self.path)
        tail = np.array([END_ID], dtype="<u4")
        shard, names, docs, held, first = None, [], [], 0, 0
        for batch in batches:
            columns = (batch[c].tolist() for c in ("shard", "missing", "id", "text"))
            for s, missing, doc_id, text in zip(*columns, strict=True):
                d = np.concatenate([np.frombuffer(tokens.ids(text), dtype="<u4"), tail])
                if docs and (s != shard or held + len(d) > self.stream):
                    made = pieces(first, names, docs, tokens.ends)
                    yield pd.DataFrame(made)
                    names, docs, held, first = [], [], 0, made["sequence_id"][-1] + 1
                if s != shard:
                    shard, first = s, s << 32
                names.append((missing, doc_id))
                docs.append(d)
                held += len(d)
        if docs:
            yield pd.DataFrame(pieces(first, names, docs, tokens.ends))


def pack(docs: DataFrame, path: str, shard: int = SHARD, stream: int = STREAM) -> DataFrame:
    """One row per piece, by doc_id; ``path`` is a tokenizer file, present on all executors.

    The number of shards follows the number of documents, so a shard stays of bounded size.
    """
    n = max(1, -(-docs.count() // shard))
    text = F.coalesce("text", F.lit("")).alias("text")
    df = docs.select(*ids.apart("doc_id"), text, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("shard"))
    order = ["shard", F.col("missing").desc(), "id", "text"]
    made = df.repartition("shard").sortWithinPartitions(*order).mapInPandas(_Shards(path, stream), OUTPUT)
    return made.select(ids.together("doc_id"), *(c for c in made.columns if c not in ("missing", "id")))
