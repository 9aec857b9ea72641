"""Quality rules with risk-controlled thresholds, by DataFrame functions alone.

Rules reject a document if a statistic of its text is above a cutoff.  The
cutoffs of each stratum are chosen on labelled documents: one half proposes, the
other half, held out, tests.  The proposing half gives steps, each of which adds a
cutoff or lowers one: first, one by one, the rules that reject bad documents and no
good one there (those that reject most bad ones first), then all rules at lower
and lower quantiles of the good documents, as far as they reject bad ones at
twice the rate of good ones.  A step stands only if the exact binomial tail shows
that all cutoffs up to it together reject less than ``risk`` of the good documents;
the last step that stands is used.  The tests of one stratum form a fixed sequence (a
later step rejects more, so its test can't succeed where an earlier one's fails),
which needs no correction; over strata the level is divided by their
number (Bonferroni).  So with probability ``1 - delta`` the rules together reject
less than ``risk`` of the good documents of every stratum.  Of four strata, one with
86 held-out good documents can get a cutoff.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, stored, word_array

_LOG = logging.getLogger(__name__)
RISK, DELTA = 0.05, 0.05
#: Quantiles of the proposing half's good documents at which cutoffs are tried.
GRID = (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.875, 0.9, 0.925, 0.95, 0.965, 0.98, 0.99, 0.995, 1.0)
LEAST_WORDS = 50


def _windows(words: Column, mask: Column) -> Column:
    """Hashes of the 3-word windows with their places in the low bits, sorted, so that equal windows stand together.

    Places take as many bits as the text needs; two different windows of a text
    of n words are taken for equal with a probability of about n^3 / 2^65.
    """
    return F.sort_array(
        F.transform(
            F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("bigint")),
        )
    )


def _repeat_words(windows: Column, mask: Column) -> Column:
    """Words in windows that are found twice or more; both arguments must be columns, as they stand in lambdas."""
    same = lambda a, b: a.bitwiseXOR(b).between(F.lit(0).cast("bigint"), mask)
    twice = F.filter(windows, lambda x, i: F.coalesce(same(x, F.get(windows, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(windows, i + 1)), F.lit(False)))
    return F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask))),
        F.struct(F.lit(-3).cast("bigint").alias("last"), F.lit(0).cast("bigint").alias("n")),
        lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(p - s["last"], F.lit(3).cast("bigint"))).alias("n")),
        lambda s: s["n"],
    )


def text_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` with the base statistics of a text column (null: no words), computed from whole texts.

    The column ``unmoved`` is not deterministic: a filter that names it stays above
    this projection, so the optimizer never copies the statistics' expressions
    (and the arrays in their lambdas) into a condition.
    """
    keep = rows.columns
    rows = rows.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    rows = rows.withColumn("__w", word_array(F.col("__t"))).withColumn("__l", F.filter(F.split("__t", "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    bits = F.ceil(F.log2(F.greatest(F.size("__w"), F.lit(2)).cast("double"))).cast("int")
    rows = rows.withColumn("__m", F.call_function("shiftleft", F.lit(1).cast("bigint"), bits) - 1)
    rows = rows.withColumn("__s", _windows(F.col("__w"), F.col("__m")))
    return rows.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        _repeat_words(F.col("__s"), F.col("__m")).alias("n_repeat_words"),
        F.length(F.regexp_replace("__t", r"[^!?]+", "")).cast("long").alias("n_marks"),
        F.monotonically_increasing_id().alias("unmoved"),
    )


#: Statistics that rules cut, the higher the worse; all from the columns of text_statistics.
def rule_values() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / chars,
        "marks": F.col("n_marks") / chars,
        "dup_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeats": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def binomial_tail(k: Column, n: Column, p: Column) -> Column:
    """P(X <= k) for X of Binomial(n, p), exactly, term by term (in logarithms)."""
    p = p.cast("double")
    odds = F.log(p / (1 - p))
    first = F.struct((n * F.log(1 - p)).alias("term"), F.exp(n * F.log(1 - p)).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i.cast("double")) + odds
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k.cast("bigint"))).otherwise(F.array().cast("array<bigint>")), first, step, lambda s: s["sum"])


def calibrate(docs: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA, max_labelled: int | None = None) -> DataFrame:
    """Cutoffs that stand: ``stratum, rule, cutoff``; a rule without one rejects nothing there.

    ``labels`` has ``doc_id, quality`` (1: good); rows with nulls in either are
    left out.  All labelled rows are fitted to, unless ``max_labelled`` bounds those of each stratum (those whose
    doc_ids have the least hashes, about); rules then judge all rows.  Strata in which no cutoff stands are logged.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumnRenamed("doc_id", "__id")
    ids = docs.select("doc_id", _stratum(docs, stratum)).join(chosen, F.col("doc_id") == F.col("__id")).select("__id", "stratum", "quality")
    if max_labelled is not None:
        shares = ids.groupBy("stratum").agg(F.least(F.lit(1.0), F.lit(float(max_labelled)) / F.count("*")).alias("share")).withColumnRenamed("stratum", "__of")
        ids = ids.join(shares, ids["stratum"] == shares["__of"]).where(F.pmod(F.xxhash64("__id"), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    ids = stored(ids.select("__id", F.col("stratum").alias("__stratum"), "quality").distinct(), "label-ids")  # of a known size, so Spark broadcasts it if small
    rows = docs.select(F.col("doc_id"), F.col("text"), _stratum(docs, stratum)).join(ids, (F.col("doc_id") == F.col("__id")) & (F.col("stratum") == F.col("__stratum")))
    rows = text_statistics(rows.select("doc_id", "stratum", "quality", "text"))
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("double").alias("value")) for k, v in rule_values().items()])).alias("x")
    held_out = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)) == 1
    rows = rows.where(~base_failed() & (F.col("unmoved") >= 0)).select("stratum", "quality", held_out.alias("held"), F.col("unmoved").alias("row"), values)
    rows = durable(rows.select("stratum", "quality", "held", "row", "x.rule", "x.value"))
    steps = durable(_steps(rows.where("not held")))
    # the first step that rejects each held-out good document
    tried = rows.where("held and quality = 1").join(steps, ["stratum", "rule"], "left")
    first = tried.groupBy("stratum", "row").agg(F.min(F.when(F.col("value") > F.col("cutoff"), F.col("step"))).alias("first"))
    n = durable(first.groupBy("stratum", "first").agg(F.count("*").alias("n")))
    counts = n.groupBy("stratum").agg(F.sum("n").alias("n"))
    fewer = n.where("first is not null").withColumnRenamed("n", "k")
    tested = steps.select("stratum", "step").distinct().join(counts, "stratum").join(fewer, "stratum", "left")
    tested = tested.groupBy("stratum", "step", "n").agg(F.coalesce(F.sum(F.when(F.col("first") <= F.col("step"), F.col("k"))), F.lit(0)).alias("k"))
    strata = rows.select("stratum").distinct()
    level = delta / max(1, strata.count())
    stands = tested.where(F.col("k") <= F.col("n") * risk).where(binomial_tail(F.col("k"), F.col("n"), F.lit(risk)) <= level)
    last = durable(stands.groupBy("stratum").agg(F.max("step").alias("last")))
    without = [r.stratum for r in strata.join(last, "stratum", "left_anti").orderBy("stratum").limit(100).collect()]
    if without:
        _LOG.warning("no cutoff stands, the base rule alone judges these strata (the first hundred): %s", without)
    return steps.join(last, "stratum").where("step <= last").groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def _steps(proposing: DataFrame) -> DataFrame:
    """``stratum, rule, step, cutoff`` by the proposing half; a step holds with all before it."""
    lowered = sorted(GRID, reverse=True)
    good, bad = proposing.where("quality = 1"), proposing.where("quality <> 1")
    cutoffs = good.groupBy("stratum", "rule").agg(F.percentile("value", F.lit(lowered)).alias("c")).select("stratum", "rule", F.posexplode("c").alias("at", "cutoff"))
    above = F.avg((F.col("value") > F.col("cutoff")).cast("double"))
    of_good = cutoffs.join(good, ["stratum", "rule"]).groupBy("stratum", "rule", "at", "cutoff").agg(above.alias("of_good"))
    of_bad = cutoffs.join(bad, ["stratum", "rule"]).groupBy("stratum", "rule", "at").agg(above.alias("of_bad"))
    useful = of_good.join(of_bad, ["stratum", "rule", "at"]).where("of_bad > 2 * of_good")
    rank = F.row_number().over(Window.partitionBy("stratum", "at").orderBy(F.desc("of_bad"), "rule"))  # six rows of each at most
    step = F.when(F.col("at") == 0, rank).otherwise(F.col("at") + len(rule_values()))
    return useful.withColumn("step", step).select("stratum", "rule", "step", "cutoff")


def _stratum(docs: DataFrame, name: str) -> Column:
    return (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in docs.columns else F.lit("")).alias("stratum")


def base_failed(least_words: int = LEAST_WORDS) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _with_verdict(docs: DataFrame, keep: Column, cutoffs: DataFrame, stratum: str) -> DataFrame:
    """``keep``, the statistics, ``base_failed``, ``rules`` and ``kept`` of each row of ``docs``.

    Cutoffs are a few numbers for each stratum that has labelled documents
    enough for a test to succeed (dozens each).
    """
    by_rule: dict[str, list] = {}
    for r in cutoffs.orderBy("stratum", "rule").collect():
        by_rule.setdefault(r.rule, []).extend([F.lit(r.stratum), F.lit(r.cutoff)])
    rows = text_statistics(docs.select(keep, F.col("text"), _stratum(docs, stratum))).drop("text")
    values = rule_values()
    checks = [F.when(values[rule] > F.try_element_at(F.create_map(*table), F.col("stratum")), F.lit(rule)) for rule, table in by_rule.items()]
    rules = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    rows = rows.withColumn("base_failed", base_failed()).withColumn("rules", rules)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """A row for each document: ``doc_id``, its statistics, ``base_failed``, ``rules`` (names of rules that reject it) and ``kept``.

    Null or empty text has no words and fails the base rule; rows that repeat a
    doc_id each get a row; a null stratum is one of its own; a missing stratum column
    makes one stratum; other columns are ignored; without labels, or with too few
    for any cutoff to stand, the base rule alone decides.
    """
    return _with_verdict(docs, F.col("doc_id"), calibrate(docs, labels, stratum, **options), stratum)


def digest(judged: DataFrame) -> DataFrame:
    """The contract's columns of ``judge``."""
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **options) -> DataFrame:
    """``docs`` without the rows that are rejected. Each row is judged in place, without a join."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return _with_verdict(docs, row, calibrate(docs, labels, stratum, **options), stratum).where("kept and unmoved >= 0").select("__row.*")
