"""Personal data: format rules, plus candidates that boosted trees select; DataFrame functions only.

Base kinds are certain by their format and always stay. High-recall generators then propose
overlapping candidates of further kinds. Gradient boosted trees score each by its format and
context; their scores are calibrated by isotonic regression on held-out rows, and candidates whose probability of
being personal reaches ``CERTAIN`` are selected, where no base span covers them. The trees are
trained on a bounded, generated sample (``EXAMPLES`` labelled rows) and calibrated on as many rows
of other templates, words and languages; both are the same for any input.

Defined cases: a null text is an empty text, without spans; texts are searched whole, in time that
grows with their length and number of spans; repeated rows, also by doc_id, and rows without
doc_id stay as they are; spans that begin alike are ordered by kind; other columns, whatever their names, are
ignored; an empty table gives an empty result. Spans may overlap between kinds, not within one.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import boost, spans
from skein.llm.spans import Kind

#: Labelled rows that are generated for training, and again for calibration.
EXAMPLES = 4096
#: The least calibrated probability of a selected candidate.
CERTAIN = 0.9
CONTEXT = 28


def _luhn(value: Column) -> Column:
    d = F.reverse(F.regexp_replace(value, "[^0-9]+", ""))

    def add(a: Column, x: Column) -> Column:
        digit = F.ascii(x.c) - 48
        twice = digit * 2
        return a + F.when(x.i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    chars = F.transform(F.filter(F.split(d, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(chars, F.lit(0), add) % 10 == 0


_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"

#: Possessive, and anchored to where a run can begin, so that no text takes quadratic time.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    Kind("card", r"[0-9](?:[\x20-]?+[0-9]){11,}+", lambda v: (spans.digits(v) <= 19) & _luhn(v)),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: spans.digits(v).between(9, 15)),
)
GENERATED = (
    Kind("local_phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])"),
    Kind("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}[\x20-][0-9]{2}[\x20-][0-9]{4}(?![0-9A-Za-z-])"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    Kind("hidden_email", r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{2,64}+\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{2,63}+(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z]{2,24}+)++"),
    Kind("account", r"(?<![0-9A-Za-z])[0-9]{8,18}(?![0-9A-Za-z])"),
)
#: Words that name what follows, by language mixed, in lower case.
CUES = (
    r"phone|tel\b|tel[.:]|call|mobile|fax|telefon|rufen|teléfono|llam|téléphone|appel",
    r"ssn|social security|national id|passport|ausweis|pasaporte|dni|passeport",
    r"iban|bank|account|konto|cuenta|compte|bic",
    r"mail|contact|write to|reach|kontakt|contacto|contacter",
)
#: Words that name numbers of things.
THINGS = r"order|version|page|lot\b|part|range|serial|code|model|number|total|invoice|ticket|chapter|figure|bestell|rechnung|seite|teil|pedido|factura|página|artículo|commande|facture|numéro"
FEATURES = ["kind", "cue", "own_cue", "thing", "digits", "marks", "overlap"]


def _features(x: Column) -> Column:
    before = F.lower(x.b)
    cue = F.lit(0)
    for i, words in enumerate(CUES):
        cue = F.when(before.rlike(words), i + 1).otherwise(cue)
    own = F.get(F.array(*(F.lit(n) for n in (1, 2, 3, 4, 3))), x.k)
    return F.struct(
        x.k.alias("kind"),
        (cue > 0).cast("int").alias("cue"),
        (cue == own).cast("int").alias("own_cue"),
        before.rlike(THINGS).cast("int").alias("thing"),
        F.least(F.floor(spans.digits(x.v) / 4).cast("int"), F.lit(4)).alias("digits"),
        F.when(x.v.rlike(r"[()\[\]]"), 3).when(x.v.contains("-"), 2).when(x.v.contains(" "), 1).otherwise(0).alias("marks"),
        x.overlap.cast("int").alias("overlap"),
    )


def candidates(df: DataFrame) -> DataFrame:
    """Add ``_base``, the certain spans, and ``_more``, proposals with features; needs ``_t``."""
    df = spans.find(spans.find(df, "_t", BASE), "_t", GENERATED, "_g", CONTEXT)
    keep = [c for c in df.columns if not c.startswith(("_k", "_g"))]
    df = df.select(*keep, *(f"_k{i}" for i in range(len(BASE))), F.concat(*(f"_k{i}" for i in range(len(BASE)))).alias("_base"), F.concat(*(f"_g{i}" for i in range(len(GENERATED)))).alias("_g"))
    made = lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), x.inside.alias("inside"), _features(x).alias("f"))
    more = F.transform(spans.marked(F.col("_g"), F.col("_base")), made)
    return df.withColumn("_more", more).drop("_g")


def _numbers() -> tuple:
    """Makers of digits and choices that depend on ``id`` alone."""
    digit = lambda i, k: F.lpad(F.pmod(F.xxhash64("id", F.lit(f"{i}")), F.lit(10**k)).cast("string"), k, "0")
    pick = lambda salt, *xs: F.get(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in xs)), F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))).cast("int"))
    return digit, pick


def _training() -> list[tuple[int, Column]]:
    digit, pick = _numbers()
    word = pick("w", "arden", "lume", "torvi", "bexal", "senna")
    host = pick("h", "mailbox", "corvid", "landline", "quartz")
    phone = pick("b", F.concat(F.lit("("), digit(1, 3), F.lit(") "), digit(2, 3), F.lit("-"), digit(3, 4)), F.concat_ws("-", digit(1, 3), digit(2, 3), digit(3, 4)), F.concat_ws(" ", digit(1, 3), digit(2, 3), digit(3, 4)))
    apart = pick("b", " ", "-", ".")
    return [
        (1, F.concat(pick("a", "Phone: ", "call me on ", "tel. ", "Telefon: ", "mobile "), phone)),
        (1, F.concat(pick("a", "SSN ", "social security number ", "national id: "), F.concat_ws("-", digit(1, 3), digit(2, 2), digit(3, 4)))),
        (1, F.concat(pick("a", "IBAN ", "bank: ", "konto ", "transfer to "), pick("b", "DE", "FR", "ES"), digit(1, 2), F.lit(" "), F.concat_ws(" ", digit(2, 4), digit(3, 4), digit(4, 4), digit(5, 4)))),
        (1, F.concat(pick("a", "mail ", "contact ", "and ", "with "), word, pick("b", " (at) ", "[at]", " [at] "), host, pick("c", " (dot) ", "[dot]", "."), pick("d", "com", "org", "de"))),
        (1, F.concat(pick("a", "account ", "bank account no ", "konto "), digit(1, 10))),
        (0, F.concat(pick("a", "order ", "the ", "version ", "on pages ", "lot "), digit(1, 3), apart, digit(2, 3), apart, digit(3, 4))),
        (0, F.concat(pick("a", "part ", "range ", "serial "), F.concat_ws("-", digit(1, 3), digit(2, 2), digit(3, 4)))),
        (0, F.concat(pick("a", "code ", "model ", "the "), pick("b", "AB", "XK", "QT"), digit(1, 2), F.lit(" "), F.concat_ws(" ", digit(2, 4), digit(3, 4), digit(4, 4)))),
        (0, F.concat(word, F.lit(" at "), host, F.lit("."), word)),
        (0, F.concat(pick("a", "number ", "in ", "call 5 of ", "total ", "id "), pick("b", digit(1, 9), digit(1, 12), digit(1, 16)))),
        (0, F.concat(pick("a", "call +", "phone +", "+"), digit(1, 2), F.lit(" "), digit(2, 3), F.lit(" "), digit(3, 3), F.lit(" "), digit(4, 4))),
    ]


def _calibration() -> list[tuple[int, Column]]:
    """Other words, forms and languages than those of training."""
    digit, pick = _numbers()
    word = pick("w", "jo.ruiz", "k_berg", "mia", "l-petit", "ivo99")
    host = pick("h", "posteo", "uni-kassel", "correo", "laposte", "inbox")
    parts = lambda *ks: [digit(i, k) for i, k in enumerate(ks)]
    apart = lambda sep, xs: F.array_join(F.transform(F.array(*xs), lambda x: F.concat(sep, x)), "").substr(F.length(sep) + 1, F.lit(99))
    phone = pick("b", F.concat_ws(".", *parts(3, 3, 4)), F.concat_ws(" ", *parts(4, 3, 3)), F.concat_ws("-", *parts(2, 4, 4)), F.concat(F.lit("("), digit(1, 4), F.lit(") "), F.concat_ws(" ", digit(2, 3), digit(3, 4))))
    return [
        (1, F.concat(pick("a", "Rufen Sie an: ", "llámame al ", "appelez le ", "fax ", "téléphone : ", "mi teléfono es ", "you can call "), phone)),
        (1, F.concat(pick("a", "Ausweis ", "dni ", "passeport ", "her passport is "), apart(pick("b", "-", " "), parts(3, 2, 4)))),
        (1, F.concat(pick("a", "cuenta ", "compte ", "Konto: ", "paid to iban ", "BIC and "), pick("b", "IT", "NL", "PT", "GB"), digit(1, 2), pick("c", "", " "), apart(pick("c", "", " "), parts(4, 4, 4, 4)))),
        (1, F.concat(pick("a", "escribe a ", "Kontakt ", "reach me: ", "", "ou "), word, pick("b", " (at) ", " [at] ", "(at)"), host, pick("c", "[dot]", " (dot) ", "."), pick("d", "net", "es", "fr"))),
        (1, F.concat(pick("a", "su cuenta ", "Konto Nr. ", "compte bancaire ", "from account "), pick("b", digit(1, 8), digit(1, 12)))),
        (0, F.concat(pick("a", "Rechnung ", "pedido ", "page ", "art. ", "see figure ", "about ", "in "), apart(pick("b", "-", ".", " "), parts(3, 3, 4)))),
        (0, F.concat(pick("a", "Teil ", "factura ", "commande ", "ticket ", "from "), apart(pick("b", "-", " "), parts(3, 2, 4)))),
        (0, F.concat(pick("a", "Seite ", "numéro ", "invoice ", "type "), pick("b", "LX", "ZZ", "MK"), digit(1, 2), F.lit(" "), F.concat_ws(" ", *parts(4, 4, 4)))),
        (0, F.concat(pick("a", "we met ", "sits ", "look "), F.lit("at "), host, pick("b", ".", " dot "), word)),
        (0, F.concat(pick("a", "Bestellung ", "artículo ", "facture ", "chapter ", "counted ", "was "), pick("b", digit(1, 8), digit(1, 10), digit(1, 13)))),
        (0, F.concat(pick("a", "llama al +", "tel +", "+"), F.concat_ws(" ", *parts(2, 3, 6)))),
    ]


def examples(spark: SparkSession, n: int = EXAMPLES, held_out: bool = False) -> DataFrame:
    """Generated rows: ``_t`` with one number or address, ``_label`` whether it is personal."""
    made = _calibration() if held_out else _training()
    around = ("Y entonces ", " y ya está.") if held_out else ("Of erin anat ", " and the rest.")
    rows = F.array(*(F.struct(F.lit(y).alias("y"), F.concat(F.lit(around[0]), t, F.lit(around[1])).alias("t")) for y, t in made))
    chosen = F.get(rows, F.pmod(F.xxhash64("id", F.lit("row")), F.lit(len(made))).cast("int"))
    return spark.range(n).withColumn("r", chosen).select(F.col("r.t").alias("_t"), F.col("r.y").alias("_label"))


@cache
def _trained(n: int, _app: str) -> boost.Model:
    spark = SparkSession.getActiveSession()

    def cells(held_out: bool) -> boost.Cells:
        rows = candidates(examples(spark, n, held_out)).select("_label", F.explode("_more.f").alias("f")).select("_label", "f.*")
        return boost.cells(rows, FEATURES, "_label")

    return boost.calibrated(boost.fit(cells(False), FEATURES), cells(True), FEATURES, CERTAIN)


def trained(spark: SparkSession, n: int = EXAMPLES) -> boost.Model:
    """The model of ``n`` generated rows, calibrated on ``n`` others; fitted once per application."""
    return _trained(n, spark.sparkContext.applicationId)


def measured(spark: SparkSession, model: boost.Model, n: int = EXAMPLES) -> DataFrame:
    """``kind``, ``precision`` and ``recall`` of candidates among the held-out rows."""
    rows = candidates(examples(spark, n, True)).select("_label", F.explode("_more").alias("x"))
    rows = rows.select("_label", "x.k", (boost.score(model, F.col("x.f")) >= model.threshold).alias("taken"))
    hit = F.sum((F.col("taken") & (F.col("_label") == 1)).cast("long"))
    names = F.array(*(F.lit(k.name) for k in GENERATED))
    found = rows.groupBy("k").agg((hit / F.sum(F.col("taken").cast("long"))).alias("precision"), (hit / F.sum("_label")).alias("recall"))
    return found.select(F.get(names, F.col("k")).alias("kind"), "precision", "recall")


def detect(docs: DataFrame, model: boost.Model) -> DataFrame:
    """``doc_id``, text ``_t``, the spans of each base kind ``_k0``.., ``_base`` and ``_all``."""
    df = candidates(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t")))
    chosen = F.filter("_more", lambda x: (boost.score(model, x.f) >= model.threshold) & ~x.inside)
    shift = len(BASE)
    added = F.transform(chosen, lambda x: F.struct(x.s.alias("s"), (x.k + shift).alias("k"), x.e.alias("e"), F.lit("").alias("v")))
    return df.withColumn("_all", F.concat("_base", added)).drop("_more")


def redact(docs: DataFrame, model: boost.Model, mark: str = "[PII]") -> DataFrame:
    """``doc_id`` and the text with all spans replaced."""
    return detect(docs, model).select("doc_id", spans.replaced(F.col("_t"), F.col("_all"), mark).alias("text"))


def report(docs: DataFrame, model: boost.Model) -> DataFrame:
    """Counts and digests of the spans of each document."""
    names = [k.name for k in BASE + GENERATED]
    found = detect(docs, model)
    return found.select(
        "doc_id",
        *(F.size(f"_k{i}").cast("long").alias(f"n_{k.name}") for i, k in enumerate(BASE)),
        F.sha2(spans.joined(F.col("_base"), names), 256).alias("base_sha256"),
        spans.joined(F.col("_all"), names).alias("spans"),
        F.size("_all").cast("long").alias("n_spans"),
    )
