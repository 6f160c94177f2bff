"""Secrets: format rules, told apart by corpus-wide ownership; DataFrame functions only.

Every candidate's value is hashed and counted over the whole corpus by distinct repositories and
distinct owners. Here a source is an owner, and each different text stands in for a repository, so
copies of one text are one. A value is a widely copied example where ``EXAMPLE_OWNERS`` owners hold
it, or where several owners hold it in ``EXAMPLE_REPOSITORIES`` repositories together; any other
is specific to an owner and looks live, in however many repositories of that one owner it is. Base
kinds always stay; candidates of the further, looser kinds are added only where they look live.

The counts are pre-aggregated by (hash, owner, repository) before they meet. The few widely held
values go back to the candidates by a join salted over rows, so one value that a third of all
rows hold spreads over ``SALTS`` tasks.

Defined cases: a null text is an empty text; a null owner is an owner of its own, as is the empty
one; rows that repeat, and rows that share a doc_id or have none, are each served by their own
text and owner; very long texts are searched whole, in time that grows with their length; spans
that begin alike are ordered by kind; other columns, whatever their names, pass through ``redact``
and are ignored elsewhere; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import ids, spans
from skein.llm.spans import Kind
from skein.session import materialize

EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 32
SALTS = 64

BASE = (
    Kind("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""", None, 1),
    Kind("access", r"AKIA[A-Z0-9]{16,}+"),
    Kind("hex", r"[0-9a-f]{24,}+"),
)
LOOSE = (
    Kind("provider", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{30,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|xox[abprs]-[A-Za-z0-9-]{16,}+|AIza[A-Za-z0-9_-]{30,}+)"),
    Kind("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Kind("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+"),
    Kind("random", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])", lambda v: v.rlike("[0-9].*[0-9].*[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")),
)
NAMES = [k.name for k in BASE + LOOSE]


def _long_enough(x: Column) -> Column:
    return F.length(x.v) >= 6


#: What names a row: equal rows have equal candidates, so they may share it.
ROW = ("missing", "id", "repository")


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select(*ids.apart("doc_id"), F.xxhash64("text").alias("repository"), *more)


def candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """``ROW``, ``owner``, base spans ``_k0``.., loose spans ``_g``; values are hashes."""
    df = _keyed(docs, F.col(owner).alias("owner"), F.coalesce("text", F.lit("")).alias("_t"))
    df = spans.find(spans.find(df, "_t", BASE), "_t", LOOSE, "_g")
    df = df.withColumn("_k0", F.filter("_k0", _long_enough))
    hashed = lambda c: F.transform(c, lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), F.sha2(x.v, 256).alias("v")))
    loose = F.concat(*(f"_g{i}" for i in range(len(LOOSE))))
    return df.select(*ROW, "owner", *(hashed(f"_k{i}").alias(f"_k{i}") for i in range(len(BASE))), hashed(loose).alias("_g"))


def ownership(book: DataFrame) -> DataFrame:
    """``v`` (hash), the distinct ``n_repositories`` and ``n_owners`` of each value; null counts as one."""
    each = book.select("repository", "owner", F.explode(_values()).alias("v"))
    return each.groupBy("v").agg(F.countDistinct("repository").alias("n_repositories"), F.countDistinct(F.struct("owner")).alias("n_owners"))


def _values() -> Column:
    """Distinct candidate hashes of a book's row."""
    return F.array_distinct(F.transform(F.concat(*(f"_k{i}" for i in range(len(BASE))), F.col("_g")), lambda x: x.v))


def widely_copied(owners: int = EXAMPLE_OWNERS, repositories: int = EXAMPLE_REPOSITORIES) -> Column:
    """Whether a row of ``ownership`` is an example."""
    return (F.col("n_owners") >= owners) | ((F.col("n_owners") > 1) & (F.col("n_repositories") >= repositories))


def judge(book: DataFrame, example: Column | None = None) -> DataFrame:
    """The book, from files, with ``_examples``, the hashes of each row that are copied examples."""
    wide = ownership(book).filter(widely_copied() if example is None else example).select("v")
    wide = wide.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = book.select(*ROW, F.explode(_values()).alias("v")).distinct().withColumn("salt", F.pmod(F.xxhash64(*ROW), F.lit(SALTS)).cast("int"))
    known = each.join(wide, ["v", "salt"]).groupBy(*ROW).agg(F.collect_set("v").alias("_examples"))
    return book.join(known, list(ROW), "left").withColumn("_examples", F.coalesce("_examples", F.array().cast("array<string>")))


def _is_example(x: Column) -> Column:
    return F.array_contains(F.col("_examples"), x.v)


def _chosen() -> tuple[Column, Column, Column]:
    """Base spans, added spans, and all spans that look live."""
    base = F.concat(*(f"_k{i}" for i in range(len(BASE))))
    loose = F.filter("_g", lambda x: ~_is_example(x))
    added = F.transform(loose, lambda x: x.withField("k", x.k + len(BASE)))
    return base, added, F.concat(F.filter(base, lambda x: ~_is_example(x)), added)


def redact(docs: DataFrame, owner: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with live-looking secrets replaced in ``text``; same columns, each row kept once.

    ``n_chars``, where there is one, follows the new text.
    """
    book = materialize(candidates(docs, owner), "secrets")
    live = judge(book).select(*ROW, _chosen()[2].alias("live")).filter(F.size("live") > 0).dropDuplicates(list(ROW))
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("whole")
    df = _keyed(docs, whole).join(live, list(ROW), "left")
    found = F.col("live").isNotNull()
    df = df.select("whole", found.alias("found"), F.when(found, spans.replaced(F.col("whole.text"), F.col("live"), mark)).alias("text"))
    made = {"text": F.when(F.col("found"), F.col("text")).otherwise(F.col("whole.text"))}
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        made["n_chars"] = F.when(F.col("found"), size).otherwise(F.col("whole.n_chars"))
    return df.select(*(made.get(c, F.col("whole").getField(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame, owner: str = "source") -> DataFrame:
    """Counts and digests of the spans of each document."""
    base, added, live = _chosen()
    book = judge(materialize(candidates(docs, owner), "secrets"))
    return book.select(
        ids.together("doc_id"),
        *(F.size(f"_k{i}").cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE)),
        F.sha2(spans.joined(base, NAMES), 256).alias("base_sha256"),
        spans.joined(F.concat(base, added), NAMES).alias("spans"),
        F.size(live).cast("long").alias("n_live"),
    )
