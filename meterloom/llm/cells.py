"""Groups of similar things that meet in cells, with no link of a cell lost.

Things with a key in common are in one cell.  First every member of a cell is compared with
the cell's hub, its least member, which costs a comparison for each member, however crowded a cell is, and joins
nearly all that is similar.  Then members of a cell that are in different components still
are compared with each other, all of them: a cell's largest component is set against the others, never against
itself, so a large group of copies makes no pairs of its own.  A cell that is crowded with other things is split
first: similar things have words in common besides the key, so of the words in one order, rare ones first, the least that
both have is among the first few of each (those that the other may lack, and one more).  Before, members
are compared with more hubs, one for each length, since the one hub may be like none of them.  Members meet in
smaller cells by such a word; a smaller cell that is still crowded is split again by the next word that both have.  Pairs are made of a
few bytes a thing and bounded by them; a cell with many pairs is dealt to blocks.  So the groups are those
that all pairs of all cells would give.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, durable, own_exchange, release, stored
from .components import connected_components

#: Pairs of a cell that a task may make, about.
BLOCK_PAIRS = 1 << 21
#: Members of a cell beside its largest component that every member is compared with, at most, if the cell can be split.
FEW = 512


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Components ``node, root`` with more edges ``a, b``: what the edges link are the roots of before."""
    named = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    ends = edges.join(named("a"), "a", "left").join(named("b"), "b", "left")
    links = durable(connected_components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))))
    into = links.select(F.col("node").alias("root"), F.col("root").alias("into"))
    moved = roots.join(into, "root", "left").select("node", F.coalesce("into", "root").alias("root"))
    return moved.unionByName(links.join(roots, "node", "left_anti"))


def _main(named: DataFrame) -> DataFrame:
    """``key, main, most, n`` of cells with members of several components: the largest one, its members, and all."""
    sizes = named.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    return sizes.where("most < n")


def _rooted(held: DataFrame, roots: DataFrame) -> DataFrame:
    """Members with their components; one of none is its own."""
    return held.select("key", "id").join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id"))


def _ranked(held: DataFrame, roots: DataFrame, things: DataFrame, rank: str, few: int) -> DataFrame | None:
    """Pairs ``a, b`` in crowded cells: a member with the least one of its rank there, and of the next lower rank."""
    named = stored(_rooted(held, roots), "members")
    cells = stored(_main(named).where(F.col("n") - F.col("most") > few).select("key"), "cells")
    pairs = None
    if not cells.isEmpty():
        members = stored(named.join(cells.select(own_exchange("key")), "key").join(things.select("id", F.col(rank).alias("rank")), "id"), "crowded-cells")
        hubs = members.groupBy("key", "rank").agg(F.min("id").alias("hub"), F.min_by("root", "id").alias("hub_root"))
        below = Window.partitionBy("key").orderBy("rank")
        hubs = hubs.select("key", "rank", F.struct("hub", "hub_root").alias("own"), F.lag(F.struct("hub", "hub_root")).over(below).alias("lower"))
        hubs = stored(hubs.select("key", "rank", F.explode(F.array_compact(F.array("own", "lower"))).alias("h")).select("key", "rank", "h.*"), "hubs")
        pairs = members.join(hubs, ["key", "rank"]).where("root <> hub_root").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        pairs = stored(pairs, "pairs")
        discard(members, hubs)
    discard(named, cells)
    return pairs


def _across(held: DataFrame, roots: DataFrame, narrow: DataFrame, possible: Callable[[str, str], Column], block_pairs: int, finer: Callable[[DataFrame], DataFrame] | None, levels: int, few: int) -> DataFrame:
    """Pairs ``a, b`` that share a cell, are in different components and may be similar."""
    named = stored(_rooted(held, roots).withColumn("at", F.lit(0)), "members")
    mixed, words = [], None
    for level in range(levels + 1):
        crowded = F.col("n") - F.col("most") > (few if level < levels else float("inf"))
        cells = stored(_main(named).select("key", "main", F.ceil((F.col("n") - F.col("most")) * F.col("n") / block_pairs).alias("blocks"), crowded.alias("crowded")), "cells")
        whole = cells.where("not crowded").select(own_exchange("key"), "main", "blocks")
        seen = words.select(narrow.columns) if words else narrow
        mixed.append(stored(named.drop("at").join(whole, "key").join(seen, "id"), "mixed-cells"))
        split = None if level == levels or cells.where("crowded").isEmpty() else stored(named.join(cells.where("crowded").select(own_exchange("key")), "key"), "crowded-cells")
        discard(named, cells)
        if split is None:
            break
        words = words or stored(finer(split.select("id").distinct()), "words")
        # the next word in common is behind the last one, and has at most ``slack`` others of its own before it
        rest = F.slice("words", F.col("at") + 1, F.greatest(F.col("slack") + level + 1 - F.col("at"), F.lit(0)))
        shown = split.join(words, "id").select("key", "id", "root", "at", F.posexplode(rest).alias("k", "word"))
        named = stored(shown.select(F.xxhash64("key", "word").alias("key"), "id", "root", (F.col("at") + F.col("k") + 1).alias("at")), "members")
        discard(split)

    def side(x: str, rows: DataFrame, block: Column) -> DataFrame:
        return rows.select("key", block.alias("block"), *[F.col(c).alias(f"{c}_{x}") for c in rows.columns if c not in ("key", "blocks")])

    rows = reduce(DataFrame.unionByName, mixed)
    # the fewer go to every block
    others = side("a", rows.where("root <> main"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = side("b", rows, F.pmod(F.xxhash64("id"), F.col("blocks")))
    once = (F.col("root_b") == F.col("main_b")) | (F.col("id_a") < F.col("id_b"))
    pairs = others.join(each, ["key", "block"]).where((F.col("root_a") != F.col("root_b")) & once & possible("_a", "_b"))
    pairs = stored(pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "pairs")
    discard(*mixed, *([words] if words else []))
    return pairs


def connected_cells(keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], similar: Callable[[str, str], Column], narrow: tuple[str, ...], possible: Callable[[str, str], Column], block_pairs: int = BLOCK_PAIRS, finer: Callable[[DataFrame, DataFrame], DataFrame] | None = None, levels: int = 0, rank: str = "", few: int = FEW) -> DataFrame:
    """``node, root`` for every id of a group of two or more.

    ``keyed`` is a table of ``key, id`` (longs) without repeated rows.  ``fetch`` gives, for a table
    of distinct ``id``, what is compared, a row for each id.  ``similar`` is a condition on two such rows whose
    columns have the suffixes ``_a`` and ``_b``; ``possible`` is one on their ``narrow`` columns alone that holds for all that is similar.

    ``finer`` gives, for what ``fetch`` gave and a table of distinct ``id``, ``id, words, slack`` and the ``narrow`` columns (they may be sharper there): words (longs, none twice) in one order for all,
    of which similar things have ``levels`` or more in common, and at most ``slack`` that the other has not.
    The first ``slack + levels`` are enough. A cell with more than ``few`` members beside its largest component is split by them, ``levels`` times at most;
    before, its members are compared with a hub of each ``rank`` (a column of the things), as similar ones often rank near each other.
    """
    spark = keyed.sparkSession
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("most")).where("hub <> most")
    hubs = stored(hubs.select("key", "hub"), "hubs")
    release(spark)
    held = stored(keyed.join(hubs.select(own_exchange("key"), "hub"), "key"), "members")
    discard(hubs)
    release(spark)  # the shuffles of all keys are the largest; now nothing refers to them
    things = stored(fetch(held.select("id").distinct()), "things")
    release(spark)

    def side(x: str) -> DataFrame:
        return things.select(*[F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in things.columns])

    def links(pairs: DataFrame) -> DataFrame:
        found = durable(pairs.join(side("a"), "a").join(side("b"), "b").where(similar("_a", "_b")).select("a", "b"))
        discard(pairs)
        return found

    pairs = held.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    roots = durable(connected_components(links(stored(pairs, "pairs"))))
    nearby = finer and _ranked(held, roots, things, rank, few)
    if nearby:
        roots = durable(_joined(roots, links(nearby)))
    split = finer and (lambda wanted: finer(things, wanted))
    found = links(_across(held, roots, things.select("id", *narrow), possible, block_pairs, split, levels if finer else 0, few))
    if not found.isEmpty():
        roots = durable(_joined(roots, found))
    discard(held, things)
    return roots
