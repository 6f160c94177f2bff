"""Spans that patterns find in texts, in code points, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.arrays import BLOCK, let, scan

SPAN = "array<struct<s:int,k:int,e:int,v:string>>"


@dataclass(frozen=True)
class Kind:
    """Leftmost non-overlapping matches of ``pattern`` for which ``valid`` holds.

    ``value`` is the regex group that is the value; patterns must not match the empty string.
    """

    name: str
    pattern: str
    valid: Callable[[Column], Column] | None = None
    value: int = 0


def _placed(found: Column, gaps: Column, number: int, context: int) -> Column:
    """Spans of matches: each begins after the earlier gaps and matches."""
    pairs = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"))), lambda p: p.m.isNotNull())
    before = "" if not context else ",b:string"

    def put(a: Column, p: Column) -> tuple[Column, Column]:
        s = a.at + F.length(p.g)
        fields = [s.alias("s"), F.lit(number).alias("k"), (s + F.length(p.m)).alias("e"), p.m.alias("v")]
        after = [(s + F.length(p.m)).alias("at")]
        if context:
            tail = F.right(F.concat(a.tail, p.g), F.lit(context))
            fields.append(tail.alias("b"))
            after.append(F.right(F.concat(tail, p.m), F.lit(context)).alias("tail"))
        return F.struct(*after), F.struct(*fields)

    start = F.struct(F.lit(0).alias("at"), *([F.lit("").alias("tail")] if context else []))
    return scan(pairs, start, put, f"struct<s:int,k:int,e:int,v:string{before}>")


def _of_kind(text: str, found: Column, kind: Kind, number: int, context: int) -> Column:
    spans = _placed(found, F.split(text, kind.pattern, -1), number, context)
    if kind.valid is not None:
        spans = F.filter(spans, lambda x: kind.valid(x.v))
    if kind.value:
        spans = F.transform(spans, lambda x: x.withField("v", F.regexp_extract(x.v, kind.pattern, kind.value)))
    none = F.array().cast(SPAN if not context else SPAN.replace(">>", ",b:string>>"))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def find(df: DataFrame, text: str, kinds: tuple[Kind, ...], into: str = "_k", context: int = 0) -> DataFrame:
    """Add a column of spans per kind, ``into`` with the kind's number; ``text`` has no nulls.

    With ``context`` a span has so many characters before it as ``b``.
    """
    df = df.select("*", *(F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0)).alias(f"_m{into}{i}") for i, k in enumerate(kinds)))
    made = [_of_kind(text, F.col(f"_m{into}{i}"), k, i, context).alias(f"{into}{i}") for i, k in enumerate(kinds)]
    return df.select(*(c for c in df.columns if not c.startswith(f"_m{into}")), *made)


def joined(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind, comma-joined."""
    name = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(F.sort_array(spans), lambda x: F.concat_ws(":", F.get(name, x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]+", ""))


def marked(spans: Column, covers: Column) -> Column:
    """``spans`` with ``inside`` and ``overlap``: whether a span of ``covers`` holds it, or meets it."""
    item = "struct<s:int,o:int,e:int,i:int>"
    one = lambda c, o: F.transform(c, lambda x, i: F.struct(x.s.alias("s"), F.lit(o).alias("o"), x.e.alias("e"), i.alias("i")))
    reach = "struct<i:int,e:int,far:int>"

    def ahead(far: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x.o == 0, F.greatest(far, x.e)).otherwise(far), F.struct(F.when(x.o == 1, x.i).alias("i"), x.e.alias("e"), far.alias("far"))

    def back(near: Column, x: Column) -> tuple[Column, Column]:
        return F.when(x.o == 0, x.s).otherwise(near), F.struct(F.when(x.o == 1, x.i).alias("i"), x.e.alias("e"), near.alias("far"))

    def own(scanned: Column) -> Column:
        return F.sort_array(F.filter(scanned, lambda x: x.i.isNotNull()))

    def of(merged: Column) -> Column:
        before = own(scan(merged, F.lit(-1), ahead, reach))
        after = own(scan(F.reverse(merged), F.lit(2**31 - 1), back, reach))
        return F.zip_with(before, after, lambda b, a: F.struct((b.far >= b.e).alias("inside"), a.far.alias("next"), b.far.alias("far")))

    flags = let(F.sort_array(F.concat(one(covers, 0).cast(f"array<{item}>"), one(spans, 1).cast(f"array<{item}>"))), of)
    found = F.zip_with(spans, flags, lambda x, f: x.withField("inside", f.inside).withField("overlap", (f.far > x.s) | (f.next < x.e)))
    none = F.transform(spans, lambda x: x.withField("inside", F.lit(False)).withField("overlap", F.lit(False)))
    return F.when((F.size(spans) > 0) & (F.size(covers) > 0), found).otherwise(none)


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span, or overlapping run of spans, replaced by ``mark``.

    Characters are counted from a text's begin, so it is cut into the stretches of ``BLOCK`` spans
    first, and those into their pieces.
    """
    piece = "struct<s:int,n:int,cut:boolean>"

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        fresh = x.s >= at
        made = F.struct(at.alias("s"), F.when(fresh, x.s - at).otherwise(0).alias("n"), (fresh & (x.k >= 0)).alias("cut"))
        return F.greatest(at, x.e), made

    def stretch(block: Column) -> Column:
        first, last = F.element_at(block, 1).s, F.element_at(block, -1)
        part = F.struct(first.alias("s"), F.substr(text, first + 1, last.s + last.n - first).alias("t"))
        one = lambda p, of: F.concat(F.substr(of.t, p.s - of.s + 1, p.n), F.when(p.cut, F.lit(mark)).otherwise(F.lit("")))
        return let(part, lambda of: F.array_join(F.transform(block, lambda p: one(p, of)), ""))

    def join(pieces: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(pieces) - 1, F.lit(BLOCK))
        return F.array_join(F.transform(at, lambda i: let(F.slice(pieces, i + 1, F.lit(BLOCK)), stretch)), "")

    bare = F.transform(spans, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e")))
    end = let(F.length(text), lambda n: F.struct(n.alias("s"), F.lit(-1).alias("k"), n.alias("e")))
    return let(scan(F.array_append(F.sort_array(bare), end), F.lit(0), step, piece), join)
