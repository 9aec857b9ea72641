import bisect
import hashlib
import io
import zlib

import numpy as np
import pytest

from meterloom.llm import packing, token_files, warc
from meterloom.llm.fm_index import FMIndex
from meterloom.llm.tokens import TextEncoder


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_encoding_is_the_librarys(tokenizer, rows, slow_ids):
    odd = ["a  b", "x\n\ny", " lead", "trail ", "tab\tx", "a\r\nb", "don't stop.", "a,", "a,,", "1,", "x.\ny. z.", "...", "'s 's,", "a_,", "中文,x", "x​, y", "٣, x", "nul\0 x", "\0", "z" * 500 + " b"]
    texts = [t for _, t in rows] + odd
    held = TextEncoder(tokenizer)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in held.encode(texts)] == [slow_ids(t)[:-1] for t in texts]


def test_pieces_of_any_kind_and_a_cache_that_is_often_full(tokenizer, slow_ids, monkeypatch):
    from meterloom.llm import tokens

    monkeypatch.setattr(tokens, "SLICE", 512)
    dice = np.random.default_rng(7)
    parts = ["a", "Zé", "ß", "×", "x×", "中", "9", ",", ".", "'s", "don't", "-", "é", "ÿ", "½", "__", "q" * 70, "e\u0301", "🙂"]
    texts = []
    for _ in range(300):
        words = ["".join(dice.choice(parts, dice.integers(1, 5))) + str(dice.choice(["", ",", ".", ".,"])) for _ in range(dice.integers(1, 400))]
        texts.append("".join(w + str(dice.choice([" ", " ", " ", "\n"])) for w in words)[:-1])
    held = TextEncoder(tokenizer, slots=1, pool=1)
    assert [np.frombuffer(x, "<u4").tolist() for x in held.encode(texts)] == [slow_ids(t)[:-1] for t in texts]
    held.cuts = False
    assert [np.frombuffer(x, "<u4").tolist() for x in held.encode(texts[:20])] == [slow_ids(t)[:-1] for t in texts[:20]]


def test_another_split_pattern_is_not_cut(tokenizer, tmp_path):
    import json

    made = json.load(open(tokenizer))
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    held = TextEncoder(str(tmp_path / "t.json"))
    assert not held.cuts
    text = "one two, three.\nfour"
    assert np.frombuffer(next(held.encode([text])), "<u4").tolist() == held.tokenizer.encode(text, add_special_tokens=False).ids


def test_token_files(docs, rows, empty, tokenizer, slow_ids):
    got = sorted(tuple(r) for r in token_files.token_files(docs, tokenizer, files=3, frame_bytes=4096).collect())
    want, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = slow_ids(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(want)
    assert token_files.token_files(empty, tokenizer).count() == 0


def test_a_reader_decompresses_only_what_it_is_asked_for_and_checks_it():
    out = io.BytesIO()
    writer = token_files.FrameWriter(out, frame_bytes=64)
    data = [(k if k else None, np.arange(k % 7, dtype="<u4").tobytes() * k) for k in range(50)]
    for i, ids in data:
        writer.add(i, ids)
    writer.close()
    raw = out.getvalue()
    reader = token_files.FrameReader(io.BytesIO(raw))
    assert list(reader.read()) == data
    seen = []
    plain = reader.frame
    reader.frame = lambda k: seen.append(k) or plain(k)
    assert list(reader.read([41])) == [data[41]] and len(seen) == 1
    broken = bytearray(raw)
    broken[int(reader.starts[3]) + 20] ^= 1
    with pytest.raises(Exception):
        list(token_files.FrameReader(io.BytesIO(bytes(broken))).read())
    import zstandard

    whole = b"".join(x for _, x in data)
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read() == whole


def best_fit(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(gaps, x)
        gap = gaps.pop(k) if k < len(gaps) else capacity
        n += gap == capacity
        if gap - x:
            bisect.insort(gaps, gap - x)
    return n


@pytest.mark.parametrize("capacity, seed", [(16, 1), (64, 2), (64, 3), (2048, 4)])
def test_schedule_is_best_fit_decreasing(capacity, seed):
    dice = np.random.default_rng(seed)
    lengths = dice.integers(1, capacity + 1, 3000).tolist() + [3] * 1500
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.schedule(dict(zip(values.tolist(), counts.tolist())), capacity)
    used = {}
    for k, (length, rank, first, each, offset) in enumerate(plan.tolist()):
        stop = plan[k + 1, 1] if k + 1 < len(plan) and plan[k + 1, 0] == length else counts[values == length][0]
        for r in range(rank, int(stop)):
            s, slot = divmod(r - rank, each)
            used.setdefault(first + s, []).append((offset + slot * length, length))
    for parts in used.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= capacity
    assert sum(map(len, used.values())) == len(lengths) and len(used) == best_fit(lengths, capacity)


def test_packing(docs, rows, empty, tokenizer, slow_ids):
    capacity = 512
    packed = packing.pack_documents(docs, tokenizer, capacity, with_ids=True)
    got = packed.collect()
    want = []
    for i, t in rows:
        ids = slow_ids(t)
        at = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(at, at[1:]))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at <= capacity
    assert len(by) == best_fit([r.length for r in got], capacity)
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert sum(r.n_tokens for r in whole.values()) == sum(r.length for r in got)
    assert all(len(r.ids) == 4 * r.n_tokens for r in whole.values())
    assert packing.pack_documents(empty, tokenizer).count() == 0


def test_warc(spark):
    large, unicode = "<p>" + "x" * 200, "é" * 60
    pages = [(1, "http://a/", large), (2, "http://b/", large), (3, None, None), (4, "u", ""), (5, "u", ""), (6, "http://c/\r\nX: y", unicode), (7, "v", unicode), (None, "n", large), (1, "http://a/", large), (9, "w", "y" * 99), (10, "w", "y" * 99)]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int").repartition(2)
    got = sorted((tuple(r) for r in warc.digest(warc.warc_round_trip(df, split_bytes=150)).collect()), key=repr)
    first, want = {}, []
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0] or 0)):
        raw = (h or "").encode()
        sha = hashlib.sha256(raw).hexdigest()
        refers = first.setdefault(sha, i) if len(raw) >= 100 else i
        refers = None if refers == i or i is None else refers
        want.append((i, len(raw), sha, "response" if refers is None else "revisit", refers))
    assert got == sorted(want, key=repr)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_ranges_own_each_record_once():
    members = [warc.record(k, f"u{k}", (b"payload %d " % k) * (k * 37 % 50), "0" * 64, None) for k in range(60)]
    raw = b"\x1f\x8b\x08 not a member" + b"".join(members)
    places, at = [], len(raw) - sum(map(len, members))
    for m in members:
        places.append(at)
        at += len(m)
    for step in (1000, 97, 13):
        got = [p for a in range(0, len(raw), step) for p, _ in warc.records_in(io.BytesIO(raw), len(raw), a, min(len(raw), a + step))]
        assert got == places


def test_fm_index():
    dice = np.random.default_rng(0)
    for top in (1, 2, 9, 70):
        text = dice.integers(0, top + 1, 500)
        index = FMIndex(text, sample=8)
        phrases = [text[k : k + n] for k, n in zip(dice.integers(0, 490, 60), dice.integers(1, 7, 60))] + [np.array([top + 5]), dice.integers(1, top + 1, 9)]
        phrases = [p for p in phrases if (p > 0).all()]
        rows = np.zeros((len(phrases), 10), np.int64)
        for row, p in zip(rows, phrases):
            row[: len(p)] = p
        lo, hi = index.search(rows, np.array([len(p) for p in phrases]))
        for p, a, b in zip(phrases, lo, hi):
            want = [k for k in range(len(text) - len(p) + 1) if (text[k : k + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_damaged_archives_are_refused(spark, tmp_path):
    members = [warc.record(k, f"u{k}", b"payload %d " % k * 40, hashlib.sha256(b"payload %d " % k * 40).hexdigest(), None) for k in range(40)]
    raw = b"".join(members)

    def read(data, listed=None, split=700):
        (tmp_path / "x.warc.gz").write_bytes(data)
        files = spark.createDataFrame([(str(tmp_path / "x.warc.gz"), listed or len(data))], "file string, bytes long")
        return warc.read_warc(spark, files, str(tmp_path), split).count()

    assert read(raw) == 40
    at = len(b"".join(members[:20]))
    cases = [(raw[:-30], None), (raw, len(raw) + 10)]
    cases += [(raw[:place] + bytes([raw[place] ^ 0xFF]) + raw[place + 1 :], None) for place in (at, at + 30, at + len(members[20]) // 2)]
    cases += [(raw[: at + 50] + raw[at + 60 :], None)]
    for data, listed in cases:
        for split in (700, 1 << 20):
            with pytest.raises(Exception):
                read(data, listed, split)


def test_a_second_attempt_leaves_nothing_that_is_read(spark, docs, tokenizer, tmp_path):
    manifest = token_files.write_token_files(docs, str(tmp_path), tokenizer, files=3)
    name = manifest.first().file
    (tmp_path / (name.rsplit("/", 1)[1] + ".other.ids")).write_bytes(b"half a file")
    assert token_files.read_token_files(spark, manifest, str(tmp_path)).count() == docs.count()
    assert len({r.file for r in manifest.collect()}) == manifest.count()
