"""Language identification by prediction by partial matching (PPM).

For each language a byte context tree of variable order, up to ``ORDER``, is counted on a bounded
sample of labelled documents (``SAMPLE`` whole documents per language, those of the smallest
hashes, and no more once they hold ``SAMPLE_BYTES``) and then frozen. The probability of a byte
backs off by escape: a context of n bytes with d distinct successors gives a seen byte
count / (n + d), and gives d / (n + d) to the others, shared as in the next shorter context
without the seen bytes; below order 0 all 256 bytes are alike. The code length of a text is the
sum of -log2 p over its bytes, and the shortest wins.

Trees are counted by the workers, one language at a time, and hold only contexts that occur: the
bits of each seen window of a context and a byte, and the bits of each context's escape. Trees of
languages are merged into tables of windows with a column per language, at most ``COLUMNS`` of
them, so a byte is looked up once for all of these. Tables are broadcast, ``TABLES`` bytes of them at
most a pass (one group of languages is scored whatever its size); more languages take more passes over the
texts. Every label with a training text is learned. Code lengths don't depend on the grouping, and
the shortest over all wins.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text
where no labelled text could be learned from. Ties go to the first language by code point; long
texts are scored whole, a stretch at a time; rows that repeat, or share a doc_id or have none, are
judged by their own text; other columns, whatever their names, are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.session import discard, materialize

ORDER = 4
SAMPLE = 400
SAMPLE_BYTES = 1 << 20
#: Most languages of a table, and bytes of the tables of a pass.
COLUMNS = 8
TABLES = 256 << 20
#: Bytes that are scored together.
STRETCH = 1 << 19
FOLDS, HELD_OUT = 4, 2
#: The best language so far, its code length, and the sum of 2 ** -(code length - shortest).
_BEST = "lang string, bits double, odds double"


def held_out() -> Column:
    """Whether a document is held out from training."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def sample(docs: DataFrame, per_language: int = SAMPLE, size: int = SAMPLE_BYTES) -> DataFrame:
    """``lang`` and ``text`` of the training documents.

    Labels are counted first, so that few more rows than are wanted are ranked, whatever label
    most documents have.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row per tree
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 3 * per_language / r["n"])) for r in counted], "lang string, share double")
    place = (F.xxhash64("doc_id", "text") / F.lit(2.0**64) + 0.5).alias("place")
    near = known.select("lang", "text", place).join(F.broadcast(share), "lang").filter(F.col("place") < F.col("share"))
    first = W.partitionBy("lang").orderBy("place", "text")
    bytes_ = F.octet_length("text")
    ranked = near.select("lang", "text", F.row_number().over(first).alias("rank"), (F.sum(bytes_).over(first.rowsBetween(W.unboundedPreceding, 0)) - bytes_).alias("before"))
    return ranked.filter((F.col("rank") <= per_language) & (F.col("before") < size)).select("lang", "text")


@dataclass(frozen=True)
class Tree:
    """By order: seen windows with their bits, and contexts with the bits of their escape.

    A window is a context and its next byte, in one integer; arrays are ascending.
    """

    windows: tuple[np.ndarray, ...]
    bits: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f"{name}{k}": a for name in ("windows", "bits", "contexts", "escapes") for k, a in enumerate(getattr(self, name))})
        return out.getvalue()

    @staticmethod
    def unpack(data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as z:
            orders = len(z.files) // 4
            return Tree(*(tuple(z[f"{name}{k}"] for k in range(orders)) for name in ("windows", "bits", "contexts", "escapes")))

    @property
    def size(self) -> int:
        return sum(map(len, self.windows))


def _windows(data: np.ndarray, order: int) -> np.ndarray:
    """The windows of this order, one for each byte from place ``order`` on."""
    n = max(0, len(data) - order)
    w = np.zeros(n, dtype=np.uint64)
    for i in range(order + 1):
        w = (w << np.uint64(8)) | data[i : i + n]
    return w


def tree(texts: list[bytes], order: int = ORDER) -> Tree:
    """The frozen context tree of some texts."""
    arrays = [np.frombuffer(t, dtype=np.uint8).astype(np.uint64) for t in texts]
    windows, bits, contexts, escapes = [], [], [], []
    below_windows, below = np.arange(256, dtype=np.uint64), np.full(256, 1 / 256)
    for k in range(order + 1):
        seen, counts = np.unique(np.concatenate([_windows(a, k) for a in arrays] or [np.empty(0, np.uint64)]), return_counts=True)
        context, first, distinct = np.unique(seen >> np.uint64(8), return_index=True, return_counts=True)
        total = np.add.reduceat(counts, first) if len(first) else np.empty(0, np.int64)
        owner = np.repeat(np.arange(len(context)), distinct)
        full = distinct == 256  # no byte is left to escape to
        p = counts / np.where(full, total, total + distinct)[owner]
        shorter = seen & np.uint64((1 << 8 * max(k, 1)) - 1)
        spent = np.add.reduceat(below[np.searchsorted(below_windows, shorter)], first) if len(first) else np.empty(0)
        left = np.maximum(1 - spent, 1e-12)
        windows.append(seen)
        bits.append(-np.log2(p))
        contexts.append(context)
        escapes.append(np.where(full, 0.0, -np.log2(distinct / (total + distinct) / left)))
        below_windows, below = seen, p
    return Tree(tuple(windows), tuple(bits), tuple(contexts), tuple(escapes))


def _found(index: pd.Index, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in an index, and where they are not in it."""
    at = index.get_indexer(values)
    return at, at < 0


@dataclass
class Model:
    """Trees merged: by order, windows and contexts of any language, with a column per language."""

    languages: tuple[str, ...]
    windows: list[np.ndarray] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    escapes: list[np.ndarray] = field(default_factory=list)
    _index: list[tuple[pd.Index, pd.Index]] | None = None

    @property
    def order(self) -> int:
        return len(self.windows) - 1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def lookup(self, windows: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each window under each language."""
        if order < 0:
            return np.full((len(windows), len(self.languages)), 8.0, dtype=np.float32)
        if self._index is None or len(self._index) <= order:
            self._index = [(pd.Index(w), pd.Index(c)) for w, c in zip(self.windows, self.contexts, strict=True)]
        at, gone = _found(self._index[order][0], windows)
        if not len(self.bits[order]):
            out = np.zeros((len(windows), len(self.languages)), dtype=np.float32)
        else:
            out = self.bits[order][at]
        if gone.any():
            missing = windows[gone]
            bits = self.lookup(missing & np.uint64((1 << 8 * max(order, 1)) - 1), order - 1)
            where, unknown = _found(self._index[order][1], missing >> np.uint64(8))
            known = np.flatnonzero(~unknown)
            bits[known] += self.escapes[order][where[known]]
            out[gone] = bits
        return out


def fit(trees: dict[str, Tree]) -> Model:
    """One model of some languages' trees, of equal order."""
    names = tuple(sorted(trees))
    made = Model(names)
    for k in range(max((len(t.windows) for t in trees.values()), default=0)):
        windows = np.unique(np.concatenate([trees[n].windows[k] for n in names]))
        contexts = np.unique(np.concatenate([trees[n].contexts[k] for n in names]))
        escapes = np.zeros((len(contexts), len(names)), dtype=np.float32)
        for j, n in enumerate(names):
            escapes[np.searchsorted(contexts, trees[n].contexts[k]), j] = trees[n].escapes[k]
        bits = made.lookup(windows & np.uint64((1 << 8 * max(k, 1)) - 1), k - 1) if k else np.full((len(windows), len(names)), 8.0, np.float32)
        bits += escapes[np.searchsorted(contexts, windows >> np.uint64(8))]
        for j, n in enumerate(names):
            bits[np.searchsorted(windows, trees[n].windows[k]), j] = trees[n].bits[k]
        made.windows.append(windows)
        made.bits.append(bits)
        made.contexts.append(contexts)
        made.escapes.append(escapes)
        made._index = None
    return made


def lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Code length in bits of each text under each language; texts aren't empty.

    A text is scored as if ``order`` line feeds came before it; a long one in stretches.
    """
    out = np.zeros((len(texts), len(model.languages)))
    held: list[tuple[int, bytes]] = []
    size = 0
    start = b"\n" * model.order

    def score() -> None:
        data = np.frombuffer(b"".join(part for _, part in held), dtype=np.uint8)
        w = _windows(data.astype(np.uint64), model.order)
        sizes = np.array([len(part) for _, part in held])
        begin = np.cumsum(sizes) - sizes
        inside = np.ones(len(w), dtype=bool)  # windows across two parts don't count
        for i in range(model.order):
            inside[begin[1:] - 1 - i] = False
        bits = model.lookup(w[inside], model.order)
        first = begin - np.arange(len(held)) * model.order
        np.add.at(out, [k for k, _ in held], np.add.reduceat(bits, first, axis=0, dtype=np.float64))

    for k, t in enumerate(texts):
        whole = start + t
        for at in range(0, len(t), STRETCH):
            held.append((k, whole[at : at + STRETCH + model.order]))
            size += len(held[-1][1])
            if size >= STRETCH:
                score()
                held, size = [], 0
    if held:
        score()
    return out


def _tree_of(group: pd.DataFrame) -> pd.DataFrame:
    made = tree([t.encode() for t in group["text"]])
    return pd.DataFrame({"lang": [group["lang"].iloc[0]], "size": [made.size], "tree": [made.pack()]})


def models(docs: DataFrame) -> Iterator[list[Model]]:
    """The models of each pass, over all languages of the training texts by code point."""
    trees = materialize(sample(docs).groupBy("lang").applyInPandas(_tree_of, "lang string, size long, tree binary"), "trees")
    some: list[Model] = []
    group: dict[str, Tree] = {}
    spent = 0
    for r in trees.orderBy("lang").toLocalIterator():
        need = sum(t.size for t in group.values()) + r["size"]
        if group and (len(group) == COLUMNS or spent + need * (8 + 4 * (len(group) + 1)) > TABLES):
            some.append(fit(group))
            spent += sum(b.nbytes + w.nbytes for b, w in zip(some[-1].bits, some[-1].windows, strict=True))
            group = {}
            if spent > TABLES // 2:
                yield some
                some, spent = [], 0
        group[r["lang"]] = Tree.unpack(r["tree"])
    if group:
        some.append(fit(group))
    if some:
        yield some
    discard(trees)


def _scored(shared: Broadcast) -> Callable[..., Column]:
    """From text and ``_BEST`` of the passes before to ``_BEST`` with this one."""

    @F.pandas_udf(_BEST)
    def best(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        names, least, odds = before["lang"].tolist(), before["bits"].to_numpy(copy=True), before["odds"].to_numpy(copy=True)
        texts = [t or "" for t in texts]
        at = np.array([k for k, t in enumerate(texts) if any(map(str.isalpha, t))], dtype=np.int64)
        for c in range(0, len(at), 256):
            some = at[c : c + 256]
            encoded = [texts[k].encode() for k in some]
            for model in shared.value:
                bits = lengths(model, encoded)
                low = bits.min(axis=1)
                for k, b, better in zip(some.tolist(), bits.argmin(axis=1).tolist(), (low < least[some]).tolist(), strict=True):
                    if better:
                        names[k] = model.languages[b]
                both = np.minimum(low, least[some])
                odds[some] = odds[some] * np.exp2(both - least[some]) + np.exp2(both[:, None] - bits).sum(axis=1)
                least[some] = both
        return pd.DataFrame({"lang": names, "bits": least, "odds": odds})

    return best


def predict(docs: DataFrame, passes: Iterable[list[Model]]) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score``; only the text decides."""
    start = F.struct(F.lit("und").alias("lang"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("odds"))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text", start.alias("best"))
    shared = written = None
    for some in passes:
        if shared is not None:
            rows = materialize(rows, "languages")
            shared.unpersist()
            if written is not None:
                discard(written)
            written = rows
        shared = docs.sparkSession.sparkContext.broadcast(some)
        rows = rows.withColumn("best", _scored(shared)("text", "best"))
    score = F.when(F.col("best.odds") > 0, 1 / F.col("best.odds")).otherwise(F.lit(0.0))
    return rows.select("doc_id", "held_out", F.col("best.lang").alias("lang_pred"), score.alias("score"))


def report(docs: DataFrame) -> DataFrame:
    return predict(docs, models(docs))
