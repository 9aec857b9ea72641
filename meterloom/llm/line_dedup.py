"""Fuzzy line deduplication by DataFrame functions alone.

Lines are normalised to words (lower-cased; all but ASCII letters, digits and
characters beyond ASCII separates).  Equal lines are one line from then on, told by two
64-bit hashes.  Lines meet by their keys: the ``KEYS`` least of a line's pairs of
neighbouring words, in an order that puts long words first (they are rare, so few unrelated lines
meet) and else goes by hash.  It is one order for all lines, so of lines with
many pairs in common the least ones are mostly the same: with a share j of their pairs in common two
lines have no key in common with a probability of about (1 - j)^KEYS.  Lines of up to
15 words always share one if they are similar: an edit takes two pairs, so of 2 d + 1 least
pairs one is left.

Lines that meet are verified by the edit similarity of their word sequences, 0.8 or
more, and of each connected group the earliest occurrence is kept.  Words are compared as
two-byte codes, so an edit distance over words is Spark's ``levenshtein`` over a
string of one character a word.  (Two different words have one code with a probability of
1 in 41,984, which can only raise a similarity.)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import connected_cells
from .common import discard, durable, fresh, own_exchange, stored

LEAST_WORDS = 5
#: What separates words within a line: every ASCII character but letters and digits. One by one, not as ranges: Java looks those up in a bit set.
_BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if c != 10 and not chr(c).isalnum()) + "]+"
SIMILARITY = 0.8
KEYS = 8
#: Codes are the characters from U+3400 to U+D7FF, so that none is a surrogate.
_CODES, _FIRST = 0xD800 - 0x3400, 0x3400
#: A word's place in the order: its length in bytes (up to so many) above a hash of 48 bits, so that two can be added.
_LONGEST = 1000
_MARKS = ("marks0", "marks1", "marks2", "marks3")
#: Words that split a crowded cell, one after another, at most.
_LEVELS = 2
#: One thing of so many tells how frequent codes are.
_SAMPLED = 8


def line_rows(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``d, t, line, id, check, w`` of every line with words enough; ``w`` is its words.

    ``d`` is the doc_id, ``t`` a hash of the whole text (rows that repeat both are
    one document), ``line`` counts from 0, (id, check) tells normalised lines apart.
    """
    text = F.col("text").cast("string")
    plain = F.regexp_replace(text, _BETWEEN, " ")
    lines = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("t"), F.posexplode(F.split(plain, "\n", -1)).alias("line", "raw"))
    lines = lines.select("d", "t", "line", F.trim(F.lower("raw")).alias("norm"))
    enough = F.substring_index("norm", " ", least_words - 1) != F.col("norm") if least_words > 1 else F.col("norm") != ""
    return lines.where(enough).select("d", "t", "line", F.xxhash64("norm").alias("id"), F.xxhash64(F.lit("second"), "norm").alias("check"), F.split("norm", " ").alias("w"))


def _keys(words: Column, similarity: float) -> Column:
    """The least pairs of neighbouring words, ascending (a line of one word has its word)."""
    place = lambda w: F.shiftrightunsigned(F.xxhash64(w), 16) - F.shiftleft(F.least(F.octet_length(w), F.lit(_LONGEST)).cast("bigint"), 48)
    # a one-element array binds what is used twice; coalesce says that no pair is null, so that longs are sorted as such
    pairs = F.transform(F.array(F.transform(words, place)), lambda v: F.when(F.size(v) < 2, v).otherwise(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v)), lambda x, y: F.coalesce(x + y, F.lit(0).cast("long")))))
    least = F.slice(F.sort_array(F.get(pairs, F.lit(0))), 1, 4 * KEYS)  # a line that repeats a pair more often has fewer keys
    longest = F.floor(F.size(words) / similarity + 1e-9)
    return F.slice(F.array_distinct(least), 1, F.least(F.lit(KEYS), 2 * _edits(longest, similarity) + 1))


def _coded(words: Column) -> Column:
    """A number for each word, the code point of a character that stands for it."""
    return F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(_CODES)) + _FIRST).cast("int"))


def _text_of(codes: Column) -> Column:
    """The characters, in a string."""
    return F.decode(F.unhex(F.array_join(F.transform(codes, F.hex), "")), "UTF-16BE")


def _marks(codes: Column) -> list[Column]:
    """256 bits in longs, of which a word sets one: an edit puts out one at most."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)))
    part = lambda k: F.filter(codes, lambda c: F.shiftright(c, 6).bitwiseAND(F.lit(3)) == k)
    return [F.aggregate(part(k), F.lit(0).cast("long"), lambda s, c: s.bitwiseOR(bit(c))).alias(mark) for k, mark in enumerate(_MARKS)]


def _edits(longer: Column, similarity: float) -> Column:
    """Edits between lines of which the longer one has so many words, at most."""
    return F.floor(longer * (1 - similarity) + 1e-9).cast("int")


def _rare_words(things: DataFrame, wanted: DataFrame, similarity: float, levels: int) -> DataFrame:
    """``id, words, slack`` and narrow columns: a line's rarest words, a repeated one told by its number, as many as a similar line may lack and ``levels`` more.

    Marks are of words with their numbers. The order is by counts of codes in a sample; any order gives the same groups.
    """
    each = F.explode(F.split("code", "")).alias("c")
    counts = things.where(F.pmod(F.xxhash64("id"), F.lit(_SAMPLED)) == 0).select(each).groupBy("c").agg(F.count("*").alias("times"))
    words = things.select("id", "code").join(wanted, "id", "left_semi").select("id", each).where("c <> ''").join(F.broadcast(counts), "c", "left")
    place = F.coalesce("times", F.lit(0).cast("long")) * 0x10000 + F.ascii("c")
    lines = words.groupBy("id").agg(F.sort_array(F.collect_list(place)).alias("all"))
    number = lambda x, k: k + 1 - F.array_position("all", x)
    lines = lines.select("id", F.transform("all", lambda x, k: F.xxhash64(x, number(x, k))).alias("all"))
    n = F.size("all")
    # the longer of two similar lines lacks so many of the other's words at most, and the shorter one no more
    slack = _edits(n, similarity)
    return lines.select("id", F.slice("all", F.lit(1), slack + levels).alias("words"), slack.alias("slack"), n.alias("n"), *_marks(F.col("all")))


def line_groups(lines: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS) -> DataFrame:
    """Connected groups of similar lines: ``node, root`` for every line of a group of two or more.

    ``lines`` is stored and has ``id, codes, keys``, of lines of ``least_words`` words or more.
    """
    distinct = stored(lines.groupBy("id").agg(F.first("keys").alias("keys")), "distinct-lines")

    def things(wanted: DataFrame) -> DataFrame:
        discard(distinct)
        found = lines.select("id", "codes").join(wanted, "id", "left_semi").dropDuplicates(["id"])
        return found.select("id", _text_of(F.col("codes")).alias("code"), F.size("codes").alias("n"), *_marks(F.col("codes")))

    def possible(a: str, b: str) -> Column:
        n, *marks = ([F.col(f"{c}{x}") for x in (a, b)] for c in ("n", *_MARKS))
        most = _edits(F.greatest(*n), similarity)
        # words that a line has and the other one lacks: the longer has those and the difference of lengths
        out = [reduce(Column.__add__, [F.bit_count(pair[k].bitwiseAND(F.bitwise_not(pair[1 - k]))) for pair in marks]) for k in (0, 1)]
        return (out[0] <= most - F.greatest(n[1] - n[0], F.lit(0))) & (out[1] <= most - F.greatest(n[0] - n[1], F.lit(0)))

    def similar(a: str, b: str) -> Column:
        most = _edits(F.greatest(f"n{a}", f"n{b}"), similarity)
        return possible(a, b) & (F.call_function("levenshtein", F.col(f"code{a}"), F.col(f"code{b}"), most) >= 0)  # -1 beyond the bound

    keyed = distinct.select("id", F.explode("keys").alias("key"))
    common = least_words - int(least_words * (1 - similarity) + 1e-9)  # words that similar lines share, at least
    rare = lambda found, wanted: _rare_words(found, wanted, similarity, levels)
    levels = min(_LEVELS, common)
    return connected_cells(keyed.select("key", "id"), things, similar, ("n", *_MARKS), possible, finer=rare, levels=levels, rank="n")


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Lines that repeat an earlier one, exactly or nearly: ``d, t, removed`` (line numbers, ascending)."""
    lines = line_rows(docs, least_words)
    lines = stored(lines.select("d", "t", "line", "id", "check", _coded(F.col("w")).alias("codes"), _keys(F.col("w"), similarity).alias("keys")), "lines")
    roots = line_groups(lines, similarity, least_words)
    distinct = lines.groupBy("id", "check").agg(F.min(F.struct("d", "t", "line")).alias("first"), F.count("*").alias("n"))
    grouped = stored(distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "check", "first", "n", "root"), "grouped-lines")
    # a group's keeper is its earliest occurrence; lines of no group keep their own first
    linked = grouped.where("root is not null")
    keepers = linked.groupBy("root").agg(F.min("first").alias("keeper"))
    fuzzy = linked.join(keepers.select(own_exchange("root"), "keeper"), "root").select("id", "check", "keeper")
    exact = grouped.where("root is null and n > 1").select("id", "check", F.col("first").alias("keeper"))
    kept = stored(fuzzy.unionByName(exact), "kept-lines")
    gone = lines.select("d", "t", "line", "id", "check").join(kept, ["id", "check"]).where(~F.struct("d", "t", "line").eqNullSafe(F.col("keeper")))
    gone = stored(gone.groupBy("d", "t").agg(F.array_sort(F.collect_set("line")).alias("removed")), "repeated-lines")
    discard(lines, grouped, kept)
    return gone


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``; adds ``n_removed`` and ``removed`` (original line numbers).

    Lines of fewer than ``least_words`` words stay, so do null and empty texts.
    Ties go to the least doc_id, then line; rows that repeat doc_id and text are one
    document and are treated alike; a null doc_id comes before others; columns with
    other names pass through; an empty table gives no rows.
    """
    names = docs.columns
    row, text0, lines, lost = (fresh(names, x) for x in ("row0", "text0", "lines0", "lost0"))
    gone = removed_lines(docs, least_words, similarity).withColumnRenamed("removed", lost)
    text = F.col("text").cast("string")
    key = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col("doc_id").alias("d0"), text.alias(text0), F.xxhash64(text).alias("t0"))
    joined = key.join(gone, key["d0"].eqNullSafe(gone["d"]) & (key["t0"] == gone["t"]), "left")
    kept = F.array_join(F.filter(F.split(text0, "\n", -1), lambda x, i: ~F.array_contains(lost, i)), "\n")
    cleaned = F.when(F.col(lost).isNull(), F.col(text0)).otherwise(kept)
    out = [cleaned.alias("text") if c.lower() == "text" else F.col(row).getField(c).alias(c) for c in names]
    return joined.select(*out, F.coalesce(F.size(lost).cast("long"), F.lit(0).cast("long")).alias(fresh(names, "n_removed")), F.coalesce(lost, F.array().cast("array<int>")).alias(fresh(names, "removed")))


def digest(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: ``doc_id, n_lines, n_removed, removed`` (line numbers, comma-joined)."""
    gone = removed_lines(docs, **options)
    text = F.col("text").cast("string")
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    key = docs.select("doc_id", F.xxhash64(text).alias("t0"), F.coalesce(breaks + 1, F.lit(0)).cast("long").alias("n_lines"))
    joined = key.join(gone, key["doc_id"].eqNullSafe(gone["d"]) & (key["t0"] == gone["t"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("removed").cast("long"), F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))
