"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct 5-word shingles, as 64-bit hashes; texts of equal words are one
node. Two nodes link when 100 * |intersection| >= 75 * |union|, that is, when the intersection
holds 3/7 of both sizes together. So at most ``slack`` = n - ceil(0.75 n) tokens of a linked set
are missing in its partner.

1. First prefixes. Sets are ordered by hash, and all tokens in the lowest ``first`` part of the
   hash range are posted, and all tokens of sets under ``small``. A token that one node only posts can't
   be shared. A node with more such tokens than ``slack`` links with nothing: of a prefix of p
   tokens p - slack must be shared. This is one grouped minimum and maximum, which combine before
   the shuffle, so common tokens are no hot keys.
2. What is left lengthens its prefix to the whole set and is counted exactly. Sets are then
   ordered by frequency, rarest first (ties by hash). A token at position i of x can be the first
   shared one with a partner y only if 3 * n(y) <= 4 * n(x) - 7 * i, and the same holds for y.
   So a base prefix has slack + 1 tokens; where these have many holders (``costly``), the
   prefix is lengthened by ``longer``.
3. Of two prefixes of lengths L, that which ends first shares at least least overlap - (n - L)
   tokens with the other; pairs that share fewer prefix tokens are dropped, the others verified
   on the whole sets.

Only connectivity is asked. So each node is first paired with one hub of each base token: the
holder whose prefix there lies farthest from its end, for a group of copies about the text they
were made from. After that only pairs whose ends are in different components are joined, by
token and size: a token's largest component isn't joined with itself. A group of thousands of near
copies costs a few pairs per member, and each pair that must be told apart costs one.

Identity of words, shingles and texts is by 64-bit hashes.

Defined cases: texts without words, or null, have the empty set and link with nothing, each its
own component; texts under five words are one shingle; texts are taken whole, one set in memory at
a time and all tokens of a set in one row; equal rows fall into one component, of the smallest
doc_id; texts that don't link are apart, though their doc_id be equal; rows without doc_id link
like others, and a component of such rows only has a null component_id; other columns, whatever
their names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import bitmaps
from skein.operators.components import components
from skein.session import discard, materialize

WORDS = 5
PERCENT = 75
_MIX = tuple(xxhash.xxh64_intdigest(b"shingle", seed=i) | 1 for i in range(WORDS))
#: Posts a token without claiming it.
_NOBODY = 0


@dataclass(frozen=True)
class Costs:
    """Weighs work; no value here decides which links are found.

    ``first`` is the share of the hash range that is a first prefix, ``small`` the size below
    which that is the set. From ``costly`` holders of its base tokens a prefix is made ``longer``
    by that part. Sizes of a cell differ by a factor of ``step`` at most, and ``spread`` holders of
    a token and cell meet in one task.
    """

    first: float = 0.45
    small: int = 64
    costly: int = 64
    longer: float = 0.5
    step: float = 1 + 1 / 32
    spread: int = 1024


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; only A-Z are lowered and only ASCII white space parts them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(ws: list[bytes]) -> np.ndarray:
    """The distinct shingles' hashes, ascending, as signed 64-bit integers."""
    if not ws:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, ws), dtype=np.uint64, count=len(ws))
    size = min(WORDS, len(ws))
    n = len(ws) - size + 1
    s = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        s = (s ^ h[i : i + n]) * np.uint64(_MIX[i])
        s ^= s >> np.uint64(29)
    return np.unique(s.view(np.int64))


def node(ws: list[bytes]) -> int:
    """The identity of a word sequence, signed and never ``_NOBODY``."""
    h = xxhash.xxh64_intdigest(b" ".join(ws), seed=1) or 1
    return h - (1 << 64) if h >> 63 else h


@dataclass(frozen=True)
class _Heads:
    """The node and set size of each row."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [words(t) for t in batch["text"]]
            keys = np.array([node(ws) for ws in split], dtype=np.int64)
            sizes = np.array([len(shingles(ws)) for ws in split], dtype=np.int32)
            yield batch[["missing", "id", "key"]].assign(node=keys, n=sizes)


@dataclass(frozen=True)
class _First:
    """First prefixes; copies in a partition post once.

    Partners of a set may have ``small`` shingles or more, and then don't post beyond ``first``,
    although the set does: it posts such tokens for others, without claiming them.
    """

    first: float
    small: int

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        limit = int((self.first - 0.5) * 2.0**64)
        held, size = [], 0
        for batch in batches:
            for text in batch["text"]:
                ws = words(text)
                key = node(ws)
                if ws and key not in seen:
                    seen.add(key)
                    s = shingles(ws)
                    first = int(np.searchsorted(s, limit))
                    whole = len(s) < self.small
                    owner = np.full(len(s) if whole else first, key)
                    if whole and 100 * len(s) >= PERCENT * self.small:  # a partner may be that large
                        owner[first:] = _NOBODY
                    held.append((s[: len(owner)], owner))
                    size += len(owner)
                    if size > 200_000:
                        yield self.frame(held)
                        held, size = [], 0
        if held:
            yield self.frame(held)

    @staticmethod
    def frame(held) -> pd.DataFrame:
        return pd.DataFrame({name: np.concatenate([h[i] for h in held]) for i, name in enumerate(("token", "owner"))})


@dataclass(frozen=True)
class _Sets:
    """Whole sets of the texts."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 500):
                some = batch.iloc[k : k + 500]
                yield pd.DataFrame({"node": some["node"], "tokens": [shingles(words(t)) for t in some["text"]]})


ROW = ("missing", "id", "key")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """What names a row, without nulls, with its text; rows of equal doc_id and text share it."""
    doc_id = F.col("doc_id").cast("long")
    names = (doc_id.isNull().alias("missing"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64("text").alias("key"))
    return docs.select(*names, F.col("text"), *more)


def _slack(n: Column) -> Column:
    """How many tokens of a linked set may be missing in its partner."""
    return n - F.ceil(n * PERCENT / 100).cast("int")


def _least(n: Column, m: Column) -> Column:
    """The least intersection of linked sets of these sizes."""
    return F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT)).cast("int")


def _largest(n: Column, at: Column) -> Column:
    """The largest size of a partner that can share the token at this position first."""
    return F.floor(((100 + PERCENT) * (n - at) - PERCENT * n) / PERCENT).cast("int")


def _open(heads: DataFrame, docs: DataFrame, costs: Costs) -> DataFrame:
    """Whole sets, with a size, of the nodes whose first prefix doesn't tell that they are alone."""
    posted = docs.select("text").mapInPandas(_First(costs.first, costs.small), "token long, owner long")
    single = posted.groupBy("token").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter((F.col("lo") == F.col("hi")) & (F.col("lo") != _NOBODY))
    alone = single.groupBy(F.col("lo").alias("node")).agg(F.count("*").alias("alone"))
    nodes = heads.filter("n > 0").groupBy("node", "n").agg(F.min(F.struct(*ROW)).alias("row")).join(alone, "node", "left")
    left = materialize(nodes.filter(F.coalesce("alone", F.lit(0)) <= _slack(F.col("n"))).select("node", "row.*"), "open")
    near = bitmaps.maybe(_keyed(docs), left, list(ROW))
    texts = near.join(left, list(ROW)).dropDuplicates(["node"]).select("node", "text")
    sets = texts.mapInPandas(_Sets(), "node long, tokens array<long>")
    out = materialize(sets.select("node", F.size("tokens").alias("n"), "tokens"), "sets")
    discard(left)
    return out


def _prefixes(sets: DataFrame, costs: Costs) -> DataFrame:
    """Per node that may link: ``node``, ``n``, ``alone``, ``length`` and the shared tokens of its prefix.

    Tokens that no other set holds come first in the order and count in positions only.
    """
    each = sets.select("node", "n", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").cast("int").alias("holders")).filter("holders > 1")
    own = each.join(shared, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("shared"))
    slack = _slack(F.col("n"))
    own = own.withColumn("alone", F.col("n") - F.size("shared")).filter(F.col("alone") <= slack)
    own = own.withColumn("base", F.slice("shared", F.lit(1), slack + 1 - F.col("alone")))
    costly = F.aggregate("base", F.lit(0).cast("long"), lambda a, t: a + t.holders - 1) >= costs.costly
    own = own.withColumn("length", F.least(F.col("n"), slack + 1 + F.when(costly, F.ceil(slack * costs.longer).cast("int")).otherwise(0)))
    prefix = F.transform(F.slice("shared", F.lit(1), F.col("length") - F.col("alone")), lambda t: t.token)
    return materialize(own.select("node", "n", "alone", "length", F.size("base").alias("n_base"), prefix.alias("prefix")), "prefixes")


def _postings(prefixes: DataFrame) -> DataFrame:
    """Base tokens with ``most``, the largest size of a partner that shares this one first."""
    base = prefixes.select("node", "n", "alone", F.posexplode(F.slice("prefix", F.lit(1), F.col("n_base"))).alias("i", "token"))
    return base.select("token", "node", "n", _largest(F.col("n"), F.col("alone") + F.col("i")).alias("most"))


def _fit(a: str, b: str) -> Column:
    """Whether linked sets can share a token first here."""
    return (F.col(f"{b}.n") <= F.col(f"{a}.most")) & (F.col(f"{a}.n") <= F.col(f"{b}.most"))


def _pairs(met: DataFrame, a: str, b: str) -> DataFrame:
    x, y = F.col(f"{a}.node"), F.col(f"{b}.node")
    return met.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct()


def _stars(postings: DataFrame) -> DataFrame:
    """Each node with the hub of each of its base tokens."""
    central = F.struct(F.col("most") / F.col("n"), F.xxhash64("node"))
    hubs = postings.groupBy("token").agg(F.max_by(F.struct("node", "n", "most"), central).alias("hub"))
    met = postings.select("token", F.struct("node", "n", "most").alias("own")).join(hubs, "token")
    return _pairs(met.filter((F.col("own.node") != F.col("hub.node")) & _fit("own", "hub")), "own", "hub")


def _cell(n: Column, step: float) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(step))).cast("int")


def _apart(postings: DataFrame, labels: DataFrame, costs: Costs) -> DataFrame:
    """Pairs in different components that can link by a shared base token.

    Of each token the rows outside its largest component ask all others, by cells of the sizes
    that fit; the holders of a large cell are dealt to several tasks.
    """
    named = postings.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counted = named.groupBy("token", "label").agg(F.count("*").alias("c"))
    mixed = counted.groupBy("token").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("k")).filter("k > 1").select("token", "main")
    rows = materialize(named.join(mixed, "token").withColumn("cell", _cell(F.col("n"), costs.step)), "apart")
    parts = rows.groupBy("token", "cell").agg(F.ceil(F.count("*") / costs.spread).cast("int").alias("parts"))
    one = F.struct("node", "n", "most", "label")
    fits = F.sequence(_cell(F.ceil(F.col("n") * PERCENT / 100), costs.step), _cell(F.col("most"), costs.step))
    asking = rows.filter("label <> main").select("token", one.alias("own"), F.explode(fits).alias("cell")).join(parts, ["token", "cell"])
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts")))).select("token", "cell", "part", "own")
    held = rows.join(parts.filter("parts > 1"), ["token", "cell"], "left")
    part = 1 + F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    held = held.select("token", "cell", part.alias("part"), one.alias("other"))
    met = asking.join(held, ["token", "cell", "part"]).filter((F.col("own.label") != F.col("other.label")) & _fit("own", "other"))
    out = materialize(_pairs(met, "own", "other"), "pairs")
    discard(rows)
    return out


def verify(pairs: DataFrame, prefixes: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among ``pairs(x, y)``: by the shared tokens of the prefixes, then by whole sets."""
    side = lambda c: prefixes.select(F.col("node").alias(c), F.struct("n", "length", "prefix").alias(f"_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    least = _least(F.col("_x.n"), F.col("_y.n"))
    asked = F.least(least - F.col("_x.n") + F.col("_x.length"), least - F.col("_y.n") + F.col("_y.length"))
    left = both.filter(F.size(F.array_intersect("_x.prefix", "_y.prefix")) >= asked).select("x", "y", least.alias("least"))
    left = left.join(sets.select(F.col("node").alias("x"), F.col("tokens").alias("_a")), "x")
    left = left.join(sets.select(F.col("node").alias("y"), F.col("tokens").alias("_b")), "y")
    return left.filter(F.size(F.array_intersect("_a", "_b")) >= F.col("least")).select("x", "y")


def links(docs: DataFrame, costs: Costs = Costs()) -> tuple[DataFrame, DataFrame]:
    """The head of each row (``ROW``, ``node``, ``n``), and ``node``, ``label`` of all linked nodes."""
    heads = materialize(_keyed(docs).mapInPandas(_Heads(), "missing boolean, id long, key long, node long, n int"), "heads")
    sets = _open(heads, docs, costs)
    prefixes = _prefixes(sets, costs)
    postings = materialize(_postings(prefixes), "postings")
    stars = materialize(verify(_stars(postings), prefixes, sets), "links")
    labels = materialize(components(stars), "labels")
    pairs = _apart(postings, labels, costs)
    found = materialize(stars.union(verify(pairs, prefixes, sets)), "links")
    final = materialize(components(found), "labels")
    discard(sets, prefixes, postings, stars, labels, pairs, found)
    return heads, final


def _labelled(heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label``, a node's component: that of its links, or itself."""
    return heads.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def classes(docs: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id``, the smallest doc_id reachable by links."""
    heads, labels = links(docs, costs)
    doc_id = F.when(~F.col("missing"), F.col("id"))
    own = _labelled(heads.filter("n > 0").groupBy("node").agg(F.min(doc_id).alias("least")), labels)
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    known = own.join(least, "label").select("node", "component_id")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(doc_id)
    out = heads.join(known, "node", "left")
    return out.select(doc_id.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the smallest doc_id, a null one last; equal rows once.

    Rows are told apart by doc_id and text, so all components of texts with an equal doc_id, or
    with none, keep a row. Of rows without words one of each doc_id stays, and all without doc_id.
    """
    heads, labels = links(docs)
    nodes = heads.filter("n > 0").groupBy("node").agg(F.min(F.struct(*ROW)).alias("row"))
    first = _labelled(nodes, labels).groupBy("label").agg(F.min("row").alias("row")).select("row.*")
    empty = heads.filter("n = 0 and not missing").groupBy("missing", "id").agg(F.min("key").alias("key"))
    nameless = F.col("doc_id").isNull() & F.coalesce("text", F.lit("")).rlike(r"\A\s*\z")  # \s is what parts words
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("whole")
    kept = _keyed(docs.filter(~nameless), whole).join(first.union(empty), list(ROW), "left_semi")
    return kept.dropDuplicates(list(ROW)).select("whole.*").union(docs.filter(nameless))
