"""Whole-text encoding with a public tokenizer file, made fast by a bounded cache.

The split pattern of a byte-level BPE never joins what stands before a single
space or line end to what stands after it, nor a letter to a comma or full stop
that ends a word.  So a text without runs of white space is cut there, each distinct
piece is encoded once a worker by the tokenizers library, and the ids of a text are
those of its pieces in a row.  Cutting, looking up and gathering are done by numpy
on a megabyte at a time.  Other texts are encoded as they are, and so
are all texts if the file has another split pattern.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

#: Runs of white space, white space other than spaces and line ends, and NUL: such texts aren't cut.
_ODD = r"[ \n][ \n]|^[ \n]|[ \n]$|[\x00\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Slots of the cache (a power of two, 24 bytes each) and the ids that it holds at most (4 bytes each): 64 MB a worker.
SLOTS, POOL = 1 << 21, 4 << 20
#: Bytes of a piece that is remembered, at most.
CACHE_LENGTH = 64
#: Bytes that are cut at a time; a cache must have room for the pieces of so many.
SLICE = 1 << 20
_JOIN = 64
_SPACE, _LINE = 0x20, 0x0A
_DICE = np.random.Generator(np.random.PCG64(42))
#: Two polynomials over bytes, modulo 2^64: a random number for each byte and powers of a random odd number.
_BYTES = _DICE.integers(0, 1 << 64, (2, 256), np.uint64)
_POWERS = np.cumprod(np.broadcast_to((_DICE.integers(0, 1 << 64, 2, np.uint64) | np.uint64(1))[:, None], (2, CACHE_LENGTH)), axis=1, dtype=np.uint64)


class PieceCache:
    """Ids of pieces by the two hashes of a piece: open addressing in arrays of a fixed size.

    When it is full it begins anew; words that come again and again are soon back.
    """

    def __init__(self, slots: int = SLOTS, pool: int = POOL):
        self.mask, self.shift, self.used, self.end = slots - 1, np.uint64(64 - slots.bit_length() + 1), 0, 0
        self.first, self.second = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64)
        self.start, self.count = np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool = np.zeros(pool, "<u4")

    def _home(self, first: np.ndarray) -> np.ndarray:
        return (first >> self.shift).astype(np.int64)

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The slot of each piece, or -1."""
        found, at, left = np.full(len(first), -1), self._home(first), np.arange(len(first))
        while len(left):
            here = at[left]
            key = self.first[here]
            same = (key == first[left]) & (self.second[here] == second[left])
            found[left[same]] = here[same]
            left = left[~same & (key != 0)]
            at[left] = (at[left] + 1) & self.mask
        return found

    def room(self, pieces: int, ids: int) -> bool:
        return 5 * (self.used + pieces) <= 3 * len(self.first) and self.end + ids <= len(self.pool)

    def clear(self) -> None:
        self.first[:], self.used, self.end = 0, 0, 0

    def put(self, first: np.ndarray, second: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Remember pieces whose first hashes differ; there is room for them."""
        self.pool[self.end : self.end + len(ids)] = ids
        start = self.end + np.cumsum(count) - count
        self.used, self.end = self.used + len(first), self.end + len(ids)
        at, left = self._home(first), np.arange(len(first))
        while len(left):
            here = at[left]
            free = self.first[here] == 0
            self.first[here[free]] = first[left[free]]  # of several that want a slot the last one gets it
            mine = free & (self.first[here] == first[left])
            slot, piece = here[mine], left[mine]
            self.second[slot], self.start[slot], self.count[slot] = second[piece], start[piece], count[piece]
            left = left[~mine]
            at[left] = (at[left] + 1) & self.mask


class TextEncoder:
    """``encode(texts)`` gives the little-endian unsigned 32-bit ids of each whole text.

    A piece begins with a space, with a line end, with the comma or full stop that ends a
    word, or where its text begins.
    """

    def __init__(self, path: str, slots: int = SLOTS, pool: int = POOL):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.cuts = self._may_cut()
        self.cache = PieceCache(max(slots, 2 * SLICE), max(pool, SLICE)) if self.cuts else None
        space = self._ids(" ")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        mark = self.tokenizer.id_to_token(int(space[0]))[0] if len(space) == 1 else "Ġ"
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith(mark)

    def _may_cut(self) -> bool:
        """Whether the file has the split pattern that the cuts are made for, and nothing that looks beyond a piece."""
        import json

        made = json.loads(self.tokenizer.to_str())
        split, model = made.get("pre_tokenizer") or {}, made["model"]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = [made.get("normalizer"), made.get("truncation"), made.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")]
        return bool(plain and model.get("type") == "BPE" and not any(odd) and all(x["special"] for x in made["added_tokens"]))

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the same ids, without places in the text
        return [np.array(x.ids, dtype="<u4") for x in fast(texts, add_special_tokens=False)]

    def _ids(self, text: str) -> np.ndarray:
        return self._batch([text])[0]

    def _learned(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces; those that begin with a space are encoded many in one call, as each begins at a token that opens with its only space."""
        out: list = [None] * len(pieces)
        spaced = [k for k, x in enumerate(pieces) if x[0] == _SPACE]
        groups = [spaced[k : k + _JOIN] for k in range(0, len(spaced), _JOIN)]
        for some, ids in zip(groups, self._batch([b"".join(pieces[k] for k in g).decode() for g in groups])):
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some) and starts[0] == 0:
                for k, a, b in zip(some, starts.tolist(), [*starts[1:].tolist(), len(ids)]):
                    out[k] = ids[a:b]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self._batch([pieces[k].decode() for k in rest])):
            out[k] = ids
        return out

    @staticmethod
    def _starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where pieces begin in bytes of whole pieces; texts begin at ``begins``."""
        cut = (data == _SPACE) | (data == _LINE)
        cut[begins] = True
        before = data[:-1]
        letter = ((before | 0x20) >= 0x61) & ((before | 0x20) <= 0x7A)
        # letters of two bytes from U+00C0 to U+00FF
        letter[1:] |= (data[:-2] == 0xC3) & (before[1:] >= 0x80) & (before[1:] <= 0xBF) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        last = np.append(cut[1:], True)
        cut[1:] |= ((data[1:] == 0x2C) | (data[1:] == 0x2E)) & last[1:] & letter & ~cut[1:]
        return np.flatnonzero(cut)

    def _cut(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of bytes, and how many stand before each of its texts (and, at the end, in all)."""
        starts = self._starts(data, begins)
        size = np.diff(starts, append=len(data))
        place = np.arange(len(data)) - np.repeat(starts, size)
        long = np.flatnonzero(size > CACHE_LENGTH)
        np.minimum(place, CACHE_LENGTH - 1, out=place)
        first, second = (np.add.reduceat(_BYTES[k][data] * _POWERS[k][place], starts) for k in (0, 1))
        first[first == 0] = 1
        raw, cache = data.tobytes(), self.cache
        extra = dict(zip(long.tolist(), self._learned([raw[starts[k] : starts[k] + size[k]] for k in long])))
        short = np.flatnonzero(size <= CACHE_LENGTH)
        slot = cache.find(first[short], second[short])
        for _ in range(2):
            new = short[slot < 0]
            if not len(new):
                break
            keys, some = np.unique(first[new], return_index=True)
            some = new[some]
            if not cache.room(len(some), int(size[some].sum())):
                cache.clear()
                slot[:] = -1
                continue
            learned = self._learned([raw[a : a + n] for a, n in zip(starts[some].tolist(), size[some].tolist())])
            cache.put(keys, second[some], np.fromiter(map(len, learned), np.int64, len(learned)), np.concatenate(learned))
            slot[slot < 0] = cache.find(first[new], second[new])
        if (slot < 0).any():  # two pieces with one first hash, or more than the cache holds
            lost = short[slot < 0]
            extra.update(zip(lost.tolist(), self._learned([raw[starts[k] : starts[k] + size[k]] for k in lost])))
        count = np.zeros(len(starts), np.int64)
        count[short] = np.where(slot >= 0, cache.count[slot], 0)
        for k, ids in extra.items():
            count[k] = len(ids)
        ends = np.cumsum(count)
        source = np.zeros(len(starts), np.int64)
        source[short] = np.where(slot >= 0, cache.start[slot], 0)
        total = int(ends[-1])
        if extra:
            own = np.ones(len(starts), bool)
            own[list(extra)] = False
            ids = np.empty(total, "<u4")
            held = np.repeat(own, count)
            ids[held] = cache.pool[(np.arange(total) + np.repeat(source - (ends - count), count))[held]]
            for k, x in extra.items():
                ids[ends[k] - len(x) : ends[k]] = x
        else:
            ids = cache.pool[np.arange(total) + np.repeat(source - (ends - count), count)]
        return ids, np.append((ends - count)[np.searchsorted(starts, begins)], total)

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Ids of a text of more than a slice, cut to blocks before white space."""
        parts, at, zero = [], 0, np.zeros(1, np.int64)
        while at < len(data):
            end = min(at + SLICE, len(data))
            if end < len(data):
                gaps = np.flatnonzero((data[at + 1 : end] == _SPACE) | (data[at + 1 : end] == _LINE))
                while not len(gaps) and end < len(data):  # a word of more than a slice
                    begin, end = end, min(end + SLICE, len(data))
                    gaps = np.flatnonzero((data[begin:end] == _SPACE) | (data[begin:end] == _LINE)) + begin - at - 1
                end = at + 1 + int(gaps[-1]) if len(gaps) else len(data)
            parts.append(self._cut(data[at:end], zero)[0])
            at = end
        return np.concatenate(parts)

    def _plain(self, texts) -> Iterator[bytes]:
        """Ids of texts (an Arrow array of large strings, no nulls, none odd or empty)."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        k = 0
        while k < len(texts):
            stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
            block = data[offsets[k] : offsets[stop]]
            if len(block) > SLICE:
                yield self._long(block).tobytes()
            else:
                ids, at = self._cut(block, offsets[k:stop] - offsets[k])
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    yield ids[a:b].tobytes()
            k = stop

    def encode(self, texts) -> Iterator[bytes]:
        """Ids of each text as bytes (null: none), in order; ``texts`` is a list or an Arrow array of strings."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        texts = pc.fill_null(texts, "")
        if self.cuts:
            flags = pc.and_not(pc.greater(pc.binary_length(texts), 0), pc.match_substring_regex(texts, _ODD))
        else:
            flags = pa.array([False] * len(texts), pa.bool_())
        kept = texts.filter(flags)
        cut = self._plain(kept.combine_chunks() if isinstance(kept, pa.ChunkedArray) else kept)
        for k, flag in enumerate(flags.to_pylist()):
            yield next(cut) if flag else self._ids(text).tobytes() if (text := texts[k].as_py()) else b""


_held: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a tokenizer file; it lives as long as the worker does."""
    if path not in _held:
        _held[path] = TextEncoder(path)
    return _held[path]
