"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; a versioned policy is a set of rules, hence a mask, so applying or comparing
policies never reads the texts again. Ablations count documents by masked bits: a bounded
histogram from which the effect of dropping any rule follows by bitwise logic.

The report applies both versions of the policy and gives, as a row's part in the ablation, the
rule that alone rejects it under the newer one.

Defined cases: a null or empty text has no words and all measurements 0, so it fails
``few_words``; long texts are measured whole; repeated rows, repeated ids and rows without doc_id are measured row
by row; a share equal to its limit doesn't fail; other columns of the input, whatever their names, are ignored; an
empty table gives an empty ledger and an ablation of zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that parts words.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def _kept(text: Column, kind: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")


def _windows(ws: Column) -> Column:
    """(hash, position) of each window of three words, sorted."""
    at = F.sequence(F.lit(0), F.size(ws) - 3)
    made = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))
    return F.when(F.size(ws) >= 4, F.sort_array(made))


def _covered(positions: Column) -> Column:
    """How many words the windows of three at these sorted positions cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    return F.aggregate(positions, start, lambda a, p: F.struct(p.alias("last"), (a.n + F.least(F.lit(3), p - a.last)).alias("n")), lambda a: a.n)


def measure(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the columns of ``keep`` and one long column per measurement.

    Windows are compared by 64-bit hash within one document.
    """
    names = ["doc_id", *(keep or [])]
    df = docs.select(*names, F.coalesce("text", F.lit("")).alias("_t")).withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.select(
        *names,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        _kept(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        _kept(F.col("_t"), "A-Z").alias("n_capitals"),
        F.length("_t").cast("long").alias("n_chars"),
        lines.alias("_l"),
        _windows(F.col("_w")).alias("_s"),
    )
    again = F.filter("_s", lambda x, i: x.h.eqNullSafe(F.get(F.col("_s"), i + 1).h) | x.h.eqNullSafe(F.get(F.col("_s"), i - 1).h))
    df = df.select(
        *names,
        "n_words",
        "word_chars",
        "n_symbols",
        "n_capitals",
        "n_chars",
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(again, lambda x: x.p)).alias("_p"),
    )
    return df.withColumn("n_repeat_words", F.coalesce(_covered(F.col("_p")).cast("long"), F.lit(0))).drop("_p")


@dataclass(frozen=True)
class Rule:
    """A rule fails a document where ``failed`` holds; ``bit`` never changes once given."""

    name: str
    bit: int
    failed: Callable[[], Column]


@dataclass(frozen=True)
class Policy:
    """A version of which rules reject a document."""

    name: str
    rules: tuple[str, ...]
    mask: int = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "mask", sum(1 << BITS[r] for r in self.rules))


def _share(part: str, whole: str, percent: int) -> Callable[[], Column]:
    return lambda: 100 * F.col(part) > percent * F.col(whole)


RULES = (
    Rule("few_words", 0, lambda: F.col("n_words") < 50),
    Rule("repeated_words", 1, _share("n_repeat_words", "n_words", 50)),
    Rule("symbols", 2, _share("n_symbols", "n_chars", 2)),
    Rule("capitals", 3, _share("n_capitals", "n_chars", 30)),
    Rule("repeated_lines", 4, lambda: (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
    Rule("short_words", 5, lambda: F.col("word_chars") < 2 * F.col("n_words")),
    Rule("long_words", 6, lambda: F.col("word_chars") > 20 * F.col("n_words")),
)
BITS = {r.name: r.bit for r in RULES}
BASE = Policy("base", ("few_words", "repeated_words"))
POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_words", "symbols")),
    "v2": Policy("v2", tuple(r.name for r in RULES)),
}


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: list[str] | None = None) -> DataFrame:
    """Measurements and ``fail_bits``: bit b is set where the rule of bit b fails."""
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(r.failed(), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    # generated, the bits keep filters on them above the measurements: pushed below, they would repeat them
    return measure(docs, keep).select("*", F.explode(F.array(bits)).alias("fail_bits"))


def fails(policy: Policy) -> Column:
    """Whether a ledger row is rejected under a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def sole(policy: Policy) -> Column:
    """The one rule of a policy that a ledger row fails; null if it fails none or several."""
    bits = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    found = F.lit(None).cast("string")
    for name in policy.rules:
        found = F.when(bits == 1 << BITS[name], F.lit(name)).otherwise(found)
    return found


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, and those that only it fails.

    The ledger is first counted by masked bits, at most one row per combination of rules.
    """
    mask = F.lit(policy.mask).cast("long")
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    own = [r for r in rules if r.name in policy.rules]
    each = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own)))
    long = seen.select("bits", "n", each.alias("r")).filter(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)
    found = long.groupBy("r.rule").agg(F.sum("n").alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"))
    names = book.sparkSession.createDataFrame([(r.name,) for r in own], "rule string")
    return names.join(F.broadcast(found), "rule", "left").select("rule", F.coalesce("n_failed", F.lit(0)).alias("n_failed"), F.coalesce("n_only", F.lit(0)).alias("n_only"))


def keep_clean(docs: DataFrame, policy: Policy = POLICIES["v2"]) -> DataFrame:
    """The rows of ``docs`` that a policy doesn't reject, with the columns of ``docs``."""
    named = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    return ledger(named, keep=["_row"]).filter(~fails(policy)).select("_row.*")


def report(docs: DataFrame, policy: Policy = POLICIES["v2"], before: Policy = POLICIES["v1"]) -> DataFrame:
    """Digest of the ledger with the verdicts of the base rules and of two versions of a policy."""
    base = fails(BASE)
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & ~fails(policy)).alias("kept"), (~base & ~fails(before)).alias("kept_before"), sole(policy).alias("sole_rule"), "fail_bits",
    )
