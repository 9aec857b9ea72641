import re

import xxhash
from pyspark.sql import functions as F

from meterloom.llm import cells, line_dedup, shingle_dedup, simhash_dedup, substring_dedup
from meterloom.llm.cells import connected_cells
from meterloom.llm.components import connected_components


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def components(nodes, linked):
    parent = {n: n for n in nodes}
    order = sorted(nodes)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if linked(a, b):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {n: find(parent, n) for n in nodes}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (7, 7), (10, 11), (11, 12), (12, 13), (13, 14), (None, 5), (20, 21), (21, 20)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {2: 1, 3: 1, 11: 10, 12: 10, 13: 10, 14: 10, 21: 20} | {1000 + k: 1000 for k in range(1, 300)}
    assert {n: r for n, r in got.items() if n != r} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_simhash(text, shingle):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    parts = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, rows, empty):
    prints = {(i, t): slow_simhash(t, 4) for i, t in rows}
    roots = components(set(prints.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), fp in prints.items():
        least[roots[fp]] = min(i, least.get(roots[fp], i))
    want = sorted((i, f"{fp:016x}", least[roots[fp]]) for (i, t), fp in [((i, t), prints[i, t]) for i, t in rows])
    got = simhash_dedup.digest(simhash_dedup.simhash_components(docs, 4, 4))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert simhash_dedup.simhash_components(empty, 4, 4).count() == 0


def test_links_of_a_crowded_cell_are_whole(spark):
    """A ball of fingerprints in a few cells, split to small blocks, and pairs at exactly four and five bits."""
    import random

    dice = random.Random(3)
    centre = dice.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in dice.sample(range(64), dice.randint(1, 5))) for _ in range(400)} | {dice.getrandbits(64) for _ in range(50)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = components({signed(f) for f in fps}, lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    for agreeing in (None, 3, 4):
        links = simhash_dedup.fingerprint_links(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), 4, block=16, agreeing=agreeing)
        got = {r.node: r.root for r in connected_components(links).collect()}
        assert {n: got.get(n, n) for n in want} == want
    bands = [simhash_dedup.agreeing_bands(10**n, 4) for n in range(3, 12)]
    assert bands[0] == 2 and bands == sorted(bands) and bands[-1] > 4


def test_one_document_of_each_group_stays(docs, rows):
    kept = sorted(r.doc_id for r in simhash_dedup.one_of_each(docs, 5).collect())
    assert {101, 103, 106} & set(kept) == set() and 10 in kept and docs.columns == simhash_dedup.one_of_each(docs).columns
    assert simhash_dedup.one_of_each(docs.limit(0)).count() == 0


def test_rows_go_for_their_own_text(spark):
    """A doc_id with two texts, repeated rows, null ids."""
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(1, long, {"a": 1}), (2, long, {"a": 2}), (2, "a text of its own that nothing else has in it", {"a": 3}), (3, "said twice by one id and nobody else here", {"b": 1}), (3, "said twice by one id and nobody else here", {"b": 2}), (None, long, None), (None, "no id here but some words of its own to be told by", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row0 map<string,int>")
    for kept in (simhash_dedup.one_of_each(docs), shingle_dedup.one_of_each(docs)):
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), r.text[:6]) for r in kept.collect()) == sorted([("1", "w0 w1 "), ("2", "a text"), ("3", "said t"), ("None", "no id ")])


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_dedup(spark, docs, rows, empty):
    base = "the quick brown fox jumps over the lazy dog while many small birds sing in the old garden near the river bank today"
    near = base.replace("small", "large")
    texts = [(1, f"{base}\nkeep me"), (2, f"Intro line here with words\n{base.upper()}!!"), (3, f"{near}\n{base}"), (4, "few words\nfew words"), (5, None), (6, ""), (7, f"{near} \n{near}")]
    found = line_dedup.dedup_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    got = {r.doc_id: (r.text, r.n_removed, r.removed) for r in found.collect()}
    assert got[1] == (texts[0][1], 0, []) and got[2][0] == "Intro line here with words"
    assert got[4][0] == "few words\nfew words" and got[5] == (None, 0, []) and got[6] == ("", 0, [])
    assert base not in (got[3][0] or "")
    assert got[7][1] >= 1
    again = line_dedup.dedup_lines(docs)
    assert set(docs.columns) <= set(again.columns) and "_removed" in again.columns and again.count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def near_lines(lines, similarity=0.8):
    """Least place of each line's group by edit similarity of words, from all pairs that have words enough in common."""
    import numpy as np

    order = sorted(set(lines), key=len)
    size = np.array([len(x) for x in order])
    most = np.floor(size * (1 - similarity) + 1e-9).astype(int)
    bits = np.zeros((len(order), 4), np.uint64)  # 256 bits of words: each edit puts out one at most
    for k, line in enumerate(order):
        for w in line:
            h = xxhash.xxh64_intdigest(w, 9)
            bits[k, h >> 8 & 3] |= np.uint64(1 << (h & 63))
    parent = {x: x for x in order}
    for k in range(len(order)):
        a = np.arange(k + 1, np.searchsorted(size, size[k] / similarity + 1, "right"))
        a = a[(size[a] - size[k] <= most[a])]
        a = a[np.bitwise_count(bits[a] & ~bits[k]).sum(1) <= most[a]]
        a = a[np.bitwise_count(bits[k] & ~bits[a]).sum(1) <= most[a]]
        for j in a.tolist():
            x, y = find(parent, order[k]), find(parent, order[j])
            if x != y and edit(order[k], order[j]) <= most[j]:
                parent[x] = y
    first = {}
    for k, line in enumerate(lines):
        first.setdefault(find(parent, line), k)
    return [first[find(parent, line)] for line in lines]


def test_recall_on_lines_of_the_test_data(spark, sf_dir):
    """Every line that goes has an earlier one in its group, and at least 0.98 of those that brute force finds go."""
    from pathlib import Path

    docs = spark.read.parquet(f"{Path(sf_dir).parent / 'sf0.001'}/documents.parquet")
    places, lines = [], []
    for r in sorted(docs.select("doc_id", "text").where("text is not null").collect()):
        for k, raw in enumerate(r.text.split("\n")):
            words = tuple(re.findall(r"[a-z0-9\x80-\U0010FFFF]+", raw.lower()))
            if 5 <= len(words) <= 1000:
                places.append((r.doc_id, k))
                lines.append(words)
    want = {places[k] for k, least in enumerate(near_lines(lines)) if least != k}
    known = set(places)
    got = {(r.d, k) for r in line_dedup.removed_lines(docs).collect() for k in r.removed} & known
    assert want and got <= want and len(got) >= 0.98 * len(want)


def test_recall_at_the_worst_similarity(spark):
    """Pairs of lines with as many scattered edits as the similarity allows: at least 0.97 are found at every length."""
    import random

    dice = random.Random(12)
    word = lambda: "".join(dice.choice(["ba", "ko", "li", "mu", "s", "e"]) for _ in range(dice.randint(1, 6))) + str(dice.randint(0, 50))
    for n in (10, 20, 50, 150):
        docs = []
        for k in range(150):
            base = [word() for _ in range(n)]
            copy = base[:]
            for place in dice.sample(range(n), n // 5):
                copy[place] = f"other{dice.randint(0, 10**6)}"
            docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        got = {r.d for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert got <= {2 * k + 1 for k in range(150)} and len(got) >= 0.97 * 150, (n, len(got))


def test_edited_lines_of_ordinary_length_are_all_found(spark):
    """Lines of 5 to 40 words with as many edits as similarity allows, or one more: groups are those of brute force."""
    import random

    dice = random.Random(11)
    word = lambda: f"w{dice.randint(0, 300)}"
    lines = []
    for n in range(5, 41):
        base = [word() for _ in range(n)]
        lines.append(" ".join(base))
        for more in (0, 1):
            copy = base[:]
            for _ in range(n // 5 + more):
                k, kind = dice.randrange(len(copy)), dice.choice(["replace", "replace", "insert", "delete"])
                copy[k : k + (kind != "insert")] = [] if kind == "delete" and len(copy) > 5 else [word()]
            lines.append(" ".join(copy))
    common = [word() for _ in range(12)]  # a crowded cell
    lines += [" ".join([*common[:11], f"z{k}"]) for k in range(30)] + [" ".join([*common[:4], *(word() for _ in range(8))]) for _ in range(10)]
    words = [x.split() for x in lines]
    roots = components(set(range(len(lines))), lambda a, b: 5 * edit(words[a], words[b]) <= max(len(words[a]), len(words[b])))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "doc_id long, text string")
    assert {r.d for r in line_dedup.removed_lines(docs).collect()} == {k for k, root in roots.items() if k != root}


def test_no_link_of_a_crowded_cell_is_lost(spark):
    """Pairs of lines that share one key only, with all others: each is found, in one block of a cell or in many."""
    first = "extraordinarily internationalization"
    lines = [f"{first} {'abcdefgh'[k % 8] * 12}{k // 2}{side * 3} y{k // 2} z{k // 2}" for k in range(80) for side in "pq" if (k % 2 == 0) == (side == "p")]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {r.d for r in line_dedup.removed_lines(docs).collect()} == set(range(1, 80, 2))


def test_crowded_cells_make_few_pairs_and_lose_none(spark, monkeypatch):
    """Long lines with one common pair of words, some with a copy of 0.8: rows of pairs stay near the number of lines, whether cells are split or not."""
    import functools
    import random

    dice = random.Random(31)
    first = "extraordinarily internationalization"
    lines = []
    for k in range(240):
        base = [f"w{dice.randint(0, 5000)}" for _ in range(98)]
        lines.append(f"{first} {' '.join(base)}")
        if k % 12 == 0:
            copy = base[:]
            for place in dice.sample(range(98), 20):
                copy[place] = f"x{dice.randint(0, 5000)}"
            lines.append(f"{first} {' '.join(copy)}")
    want = {k for k, line in enumerate(lines) if " x" in line}
    docs, made, store = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), [], cells.stored

    def counted(df, label):
        kept = store(df, label)
        made.extend([kept.count()] if label == "pairs" else [])
        return kept

    monkeypatch.setattr(cells, "stored", counted)
    for few in (512, 20):
        made.clear()
        monkeypatch.setattr(line_dedup, "connected_cells", functools.partial(connected_cells, few=few))
        assert {r.d for r in line_dedup.removed_lines(docs).collect()} == want
        assert sum(made) < 5 * len(lines), (few, made)


def test_split_cells_give_the_groups_of_whole_cells(spark, monkeypatch):
    """Lines of few words and of many, repeated words, chains: cells split at two members or more, by up to two words, lose nothing."""
    import functools
    import random

    dice = random.Random(32)
    lines = []
    for n in (5, 6, 9, 15):
        base = [f"w{dice.randint(0, 8)}" for _ in range(n)]
        for _ in range(30):
            copy = base[:]
            for _ in range(dice.randint(0, n // 2)):
                copy[dice.randrange(n)] = f"w{dice.randint(0, 8)}"
            lines.append(copy[: dice.randint(5, n)])
    roots = components(set(range(len(lines))), lambda a, b: 5 * edit(lines[a], lines[b]) <= max(len(lines[a]), len(lines[b])))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(lines)], "doc_id long, text string")
    monkeypatch.setattr(line_dedup, "connected_cells", functools.partial(connected_cells, few=1))
    assert {r.d for r in line_dedup.removed_lines(docs).collect()} == {k for k, root in roots.items() if k != root}


def test_cells_give_the_groups_of_all_pairs(spark):
    """Things in cells of up to 150, similar if near: one large group, chains, and things of no group; blocks of 50 pairs and of many."""
    import random

    dice = random.Random(4)
    value = {k: dice.choice([dice.randint(0, 30), dice.randint(1000, 3000)]) for k in range(300)}
    cells = {(c, k) for c, n in enumerate([150, 90, 40, 5, 2, 1]) for k in dice.sample(sorted(value), n)}
    keyed = spark.createDataFrame(sorted(cells), "key long, id long")
    things = spark.createDataFrame(sorted(value.items()), "id long, v long")
    near = lambda a, b: F.abs(F.col(f"v{a}") - F.col(f"v{b}")) <= 2
    held = {}
    for c, k in cells:
        held.setdefault(k, set()).add(c)
    want = components(set(held), lambda a, b: bool(held[a] & held[b]) and abs(value[a] - value[b]) <= 2)
    for block_pairs in (50, 1 << 20):
        got = {r.node: r.root for r in connected_cells(keyed, lambda wanted: things.join(wanted, "id", "left_semi"), near, ("v",), near, block_pairs).collect()}
        assert {k: got.get(k, k) for k in want} == want


def slow_passages(rows, least):
    """Texts by word loops: ``{(doc_id, text): (kept, number of runs, spans)}``."""
    seen, out = set(), {}
    for i, t in sorted({(i, t) for i, t in rows if t is not None}):
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", t))
        norm = [re.sub(r"[!-/:-@\[-`{-~]", "", "".join(c.lower() if c < "\x80" else c for c in m[0])) for m in words]
        gone = set()
        for k in range(len(norm) - least + 1):
            passage = tuple(norm[k : k + least])
            gone |= set(range(k, k + least)) if passage in seen else set()
            seen.add(passage)
        runs = []
        for k in sorted(gone):
            if runs and runs[-1][1] == k - 1:
                runs[-1][1] = k
            else:
                runs.append([k, k])
        spans = [(words[a].start(), words[b].end()) for a, b in runs]
        kept = "".join(c for n, c in enumerate(t) if not any(a <= n < b for a, b in spans))
        out[i, t] = (kept, len(spans), ",".join(f"{a}:{b}" for a, b in spans))
    return out


def passages_of(docs, rows, least):
    want = slow_passages(rows, least)
    got = sorted(((r.doc_id, r.text, r.n_removed, r._removed if "_removed" in r else r.removed) for r in substring_dedup.dedup_substrings(docs, least).collect()), key=repr)
    assert got == sorted(((i, *(want[i, t] if t is not None else (None, 0, ""))) for i, t in rows), key=repr)


def test_substring_dedup(docs, rows, empty):
    for least in (50, 12, 2):
        passages_of(docs, rows, least)
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of 50 words and more within lines, over other line breaks, in other cases, at both ends, twice in one text; 49 words stay."""
    import random

    dice = random.Random(21)
    words = lambda n: [f"w{dice.randint(0, 10**6)}" for _ in range(n)]
    passages = {n: words(n) for n in (49, 50, 51, 55, 80, 300)}
    docs, holders = [(0, " ".join(words(400)))], {}
    for n, passage in passages.items():
        for k in range(6):
            before, after, i = words(dice.choice([0, 3, 200])), words(dice.choice([0, 5, 100])), len(docs)
            shown = [dice.choice([x, x.upper(), x + ",", f"({x})"]) for x in passage] if k % 2 else passage
            text = "".join(x + dice.choice([" "] * 9 + ["\n", "\n\n"]) for x in [*before, *shown, *after])[:-1]
            docs.append((i, text))
            if k and n >= 50:
                holders[i] = n
    twice = words(60)
    docs.append((900, " ".join([*twice, *words(7), *twice])))
    docs += [(1000 + k, " ".join(words(dice.randint(1, 300)))) for k in range(40)]
    docs += [(5000 + k, docs[5][1]) for k in range(20)]  # many copies
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    passages_of(df, docs, 50)
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_substrings(df).collect()}
    assert {i for i, n in got.items() if n} == {*holders, 900, *range(5000, 5020)}


def test_equal_texts_of_one_and_of_several_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(7, text), (7, text), (3, text), (None, text), (None, "few words"), (9, "few words")]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text, r.removed) for r in got) == sorted([("None", text, ""), ("None", "few words", ""), ("9", "few words", "")] + [(i, "", f"0:{len(text)}") for i in "773"])


def _size(df):
    """Spark's estimate of bytes, as text."""
    return str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def test_cuts_carry_no_estimated_size(spark):
    from meterloom.llm.common import durable

    edges = durable(spark.range(20).selectExpr("id as u", "id div 2 as v"))
    for _ in range(5):
        edges = durable(edges.join(edges.selectExpr("u as v", "v as w"), "v").selectExpr("u", "w as v"))
        assert len(_size(edges)) <= 20  # carried over, its digits double each round
    assert sorted(map(tuple, edges.collect())) == [(k, 0) for k in range(20)]


def test_small_files_of_many_rows_are_not_taken_for_small_tables(spark, tmp_path):
    from meterloom.llm.common import _wary, small_broadcasts

    spark.range(1 << 20).selectExpr("id div 1000 as key").coalesce(1).write.parquet(str(tmp_path / "keys"))
    size = lambda: int(_size(spark.read.parquet(str(tmp_path / "keys"))))
    before = size()
    with _wary(spark):
        assert size() >= 16 * before
    assert size() == before
    small_broadcasts(spark)
    assert spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().conf().get("spark.broadcast.blockSize") == "256k"
