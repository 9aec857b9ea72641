import random

import corpus_pipeline
from meterloom.llm import shingle_dedup


def test_stages(spark, sf_dir, tmp_path, tokenizer, slow_ids):
    """Each stage keeps the columns and only drops documents (or lines of them); the last packs all that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert set(out.columns) == set(docs.columns), name
            after = {r.doc_id: r.text for r in out.collect()}
            assert 0 < len(after) <= len(before) and set(after) <= set(before), name
            for i, text in after.items():
                lines = iter(before[i].split("\n"))
                assert all(x in lines for x in text.split("\n")) if name == "line_dedup" else text == before[i], name
            before = after
        docs = out
    pieces = {}
    for r in docs.collect():
        pieces[r.doc_id] = pieces.get(r.doc_id, 0) + r.length
    assert pieces == {i: len(slow_ids(t)) for i, t in before.items()}


def test_near_dedup_takes_what_shingles_say(spark, sf_dir):
    """Of documents with edits, groups are those of brute-force shingle similarity."""
    dice = random.Random(8)
    texts = []
    for k in range(40):
        base = [f"w{dice.randint(0, 400)}" for _ in range(dice.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(3):
            copy = base[:]
            for _ in range(dice.randint(0, 1 + len(base) // 40)):
                copy[dice.randrange(len(copy))] = f"x{dice.randint(0, 400)}"
            texts.append(" ".join(copy).upper() if k % 3 else " ".join(copy))
    texts += ["", None, " "]
    sets = []
    for x in texts:
        w = (x or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if (texts[a] or "") == (texts[b] or "") or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) > 0:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs.repartition(3), sf_dir).collect()}
    assert kept == set(root) and len(kept) < len(texts) - 20


def test_near_dedup_goes_through_popcount_segments(spark, sf_dir, monkeypatch):
    """Without any bands, copies of four or fewer bits are still found, and only similar ones."""
    dice = random.Random(9)
    long = [f"w{dice.randint(0, 4000)}" for _ in range(900)]
    other = " ".join(f"v{dice.randint(0, 4000)}" for _ in range(300))
    texts = [" ".join(long), " ".join([*long, "end"]), " ".join(["start", *long]), other, other.upper(), "few words", "", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(shingle_dedup, "bands", lambda hashes: [])
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} == {0, 3, 5, 6}
