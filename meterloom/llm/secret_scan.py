"""Secret scanning with DataFrame functions alone: fixed patterns, and sliding-window entropy over candidate strings.

Places come without a UDF: splitting a text at a pattern gives the pieces
between the matches, and their lengths and those of the matches add up to the
starts (in code points).

The method adds spans: a candidate is a run of ``[A-Za-z0-9+/_-]`` of at least a
window's length, with its padding of up to two ``=`` (so a name before ``=`` is no part of it).  For each character class (hexadecimal, letters and digits,
base64) that the whole run belongs to, a window slides over it; the counts of
its characters, and the sum of count * log2(count) from which its Shannon
entropy follows, are updated by the character that enters and the one that
leaves.  The windows above the class's threshold make a span from the first's start
to the last's end, unless an allow-list pattern fits the candidate, an allowed word
stands in the span, or a fixed pattern has reported part of it.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order of kinds in results: kind, pattern, group whose length counts, least length.
#: The quantifiers of ``access`` and ``hex`` hold the least length, since a greedy run is as long as can be anyway.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = [kind for kind, *_ in BASE] + ["entropy"]
#: Character classes of candidates: name, whole-run pattern, least entropy in bits of a window.
CLASSES = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[0-9A-Za-z]+$", 3.7), ("base64", r"^[0-9A-Za-z+/_=-]+$", 3.9))
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
#: Words that mark a span as no secret.
ALLOW_WORDS = r"(?i)example|sample|placeholder"
#: Candidates that look random but aren't secret.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^[A-Za-z/_=+-]+$",  # no digit: words, paths, rules of characters
    r"^[0-9=_+/-]+$",  # no letter: numbers, dates
    r"^(sha256|sha384|sha512)-",  # integrity digests
)
_SPANS = "array<struct<start:bigint,kind:int,stop:bigint>>"


def _span(start: Column, kind: int, stop: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), F.lit(kind).alias("kind"), stop.cast("bigint").alias("stop"))


def match_spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 1) -> Column:
    """Spans of the leftmost, non-overlapping matches whose group has at least so many characters."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(whole, F.length)
    counted = lengths if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(lengths.alias("n"), counted.alias("c"), F.slice(gaps, 1, F.size(lengths)).alias("g"))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + x["g"]
        stop = start + x["n"]
        return F.struct(stop.alias("at"), F.when(x["c"] >= least, F.concat(s["out"], F.array(_span(start, kind, stop)))).otherwise(s["out"]).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(rows, state, step, lambda s: s["out"])).otherwise(F.array().cast(_SPANS))


def window_range(run: Column, least: float, window: int) -> Column:
    """``first, last``: start of the first and end of the last window of at least so many bits; first is -1 if there is none."""
    places = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
        F.lit(0).alias("i"),
        places.alias("c"),
    )
    weight = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def step(s: Column, enters: Column) -> Column:
        leaves = F.when(s["i"] >= window, F.get(s["c"], s["i"] - window)).otherwise(F.lit(-1))
        more = F.get(s["counts"], enters)
        less = F.when(leaves >= 0, F.get(s["counts"], leaves)).otherwise(F.lit(0))
        same = leaves == enters
        total = F.when(same, s["sum"]).otherwise(s["sum"] + weight(more + 1) - weight(more) + F.when(leaves >= 0, weight(less - 1) - weight(less)).otherwise(F.lit(0.0)))
        counts = F.when(same, s["counts"]).otherwise(F.transform(s["counts"], lambda n, k: n + (k == enters).cast("int") - (k == leaves).cast("int")))
        high = (s["i"] >= window - 1) & (F.log2(F.lit(float(window))) - total / window >= least)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(high & (s["first"] < 0), s["i"] - window + 1).otherwise(s["first"]).alias("first"),
            F.when(high, s["i"] + 1).otherwise(s["last"]).alias("last"),
            (s["i"] + 1).alias("i"),
            s["c"].alias("c"),
        )

    return F.aggregate(places, zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, window: int = WINDOW, classes=CLASSES, allow=ALLOW) -> Column:
    """Spans of candidates with a window of high entropy for the narrowest class that holds them."""
    pattern = CANDIDATE % window
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    placed = F.arrays_zip(match_spans(text, pattern, len(BASE)).alias("s"), runs.alias("run"))
    allowed = lambda run: reduce(or_, [F.regexp_like(run, F.lit(a)) for a in allow], F.lit(False))
    suspect = F.filter(placed, lambda x: ~allowed(x["run"]))

    def one(x: Column) -> Column:
        found = F.lit(None)
        for _, whole, least in reversed(classes):
            found = F.when(F.regexp_like(x["run"], F.lit(whole)), window_range(x["run"], least, window)).otherwise(found)
        return F.struct(x["s"]["start"].alias("at"), x["run"].alias("run"), found.alias("w"))

    span = lambda x: F.substring(x["run"], x["w"]["first"] + 1, x["w"]["last"] - x["w"]["first"])
    hit = F.filter(F.transform(suspect, one), lambda x: (x["w"]["first"] >= 0) & ~F.regexp_like(span(x), F.lit(ALLOW_WORDS)))
    spans = F.transform(hit, lambda x: _span(x["at"] + x["w"]["first"], len(BASE), x["at"] + x["w"]["last"]))
    return F.when(F.regexp_like(text, F.lit(pattern)), spans).otherwise(F.array().cast(_SPANS))


def scan_secrets(docs: DataFrame, window: int = WINDOW, classes=CLASSES, allow=ALLOW) -> DataFrame:
    """A row for each document: ``doc_id, base, added`` (arrays of spans in code points by start, then kind).

    Null or empty text has no spans; rows that repeat a doc_id each get a row;
    other columns are ignored; an empty table gives no rows.  There is no
    shuffle and no grouping, so a hot source changes nothing.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    for n, (kind, pattern, group, least) in enumerate(BASE):
        rows = rows.withColumn(f"__{kind}", match_spans(F.col("__t"), pattern, n, group, least))
    rows = rows.withColumn("__e", entropy_spans(F.col("__t"), window, classes, allow))
    base = F.array_sort(F.concat("__assign", "__access", "__hex"))
    rows = rows.select("doc_id", base.alias("base"), "__e")
    added = F.filter("__e", lambda x: ~F.exists("base", lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return rows.select("doc_id", "base", added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``scan_secrets``."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", *[count(k) for k in range(len(BASE))], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
