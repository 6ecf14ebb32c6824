"""Exact token ids of whole texts from a tokenizers file, each distinct word encoded once per worker.

The tokenizer files that this is for lower-case, split at white space and by a word pattern, and encode each part of a
text by itself. So the bytes of many texts are cut into parts by vector operations, parts are told apart by a 64-bit hash of their
bytes, new parts go through the library, and the ids are put together. Texts with other characters than
ASCII and the Latin-1 letters, or with a special token's text, go through the library whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm.shared import slices, text_bytes
from tessera.llm.wordhash import LOWER, prefix, span_hashes

#: Parts that a worker knows; beyond, it starts anew.
MOST_PARTS = 4_000_000
JOINED = 2_000
#: Bytes that are cut at once; a longer text is taken whole.
AT_ONCE = 1 << 21

BLANK, LETTER, DIGIT, OTHER = range(4)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
KIND[list(b"0123456789")] = DIGIT
#: Bytes that a plain text may hold: ASCII but the separators that libraries disagree on, and 0xC3, the lead byte of Latin-1 letters.
ODD = np.zeros(256, bool)
ODD[[*range(0x1C, 0x20), *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
LEAD = 0xC3
TIMES, DIVIDED = 0x97, 0xB7


class Known:
    """Ids by part hash: a sorted table, and a smaller one for what came lately."""

    def __init__(self) -> None:
        self.tables = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(2)]
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def __len__(self) -> int:
        return sum(len(t[0]) for t in self.tables)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in the pool (-1: unknown) and lengths."""
        start, length = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for keys, starts, lengths in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                start[hit], length[hit] = starts[at[hit]], lengths[at[hit]]
        return start, length

    def add(self, hashes: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.tables[1] = self._merged(self.tables[1], (hashes, starts, lengths))
        if len(self.tables[1][0]) * 4 > len(self.tables[0][0]):
            self.tables = [self._merged(*self.tables), self._merged()]

    @staticmethod
    def _merged(*tables: tuple) -> tuple:
        if not tables:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, starts, lengths = (np.concatenate(x) for x in zip(*tables))
        order = np.argsort(keys, kind="stable")
        return keys[order], starts[order], lengths[order]


class TextEncoder:
    """Ids as little-endian unsigned 32-bit integers, equal to the library's with add_special_tokens=False."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        spec = self.tokenizer.to_str()
        self.splits = '"end_of_word_suffix":"</w>"' in spec and '"Lowercase"' in spec and '"type":"NFC"' in spec
        self.specials = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = Known()

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a large_string column without nulls."""
        raw, at = text_bytes(column)
        out: list[bytes] = []
        for first, end in slices(at, AT_ONCE):
            out += self._encode(raw[at[first] : at[end]], at[first : end + 1] - at[first])
        return out

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts go through the library whole."""
        n = len(offsets) - 1
        if not self.splits:
            return np.ones(n, bool)
        odd = ODD[data]
        after = np.zeros(len(data), bool)
        after[1:] = data[:-1] == LEAD
        trail = (data >= 0x80) & (data < 0xC0)
        odd |= (trail & ~after) | (after & ((data == TIMES) | (data == DIVIDED)))
        sums = np.concatenate([[0], np.cumsum(odd)])
        out = np.diff(sums[offsets]) > 0
        text = data.tobytes()
        for special in self.specials:
            at = text.find(special)
            while at >= 0:
                out[np.searchsorted(offsets, at, side="right") - 1] = True
                at = text.find(special, at + 1)
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        n, odd = len(offsets) - 1, self._odd(data, offsets)
        low = LOWER[data]
        after = np.flatnonzero(data[:-1] == LEAD) + 1 if len(data) else np.zeros(0, int)
        low[after[(data[after] >= 0x80) & (data[after] <= 0x9E)]] += 0x20
        kind = KIND[low]
        kind[np.repeat(odd, np.diff(offsets))] = BLANK
        fresh = np.zeros(len(data), bool)
        inner = offsets[:-1]
        fresh[inner[inner < len(data)]] = True
        start = kind != BLANK
        change = np.ones(len(data), bool)
        change[1:] = kind[1:] != kind[:-1]
        begins = start & (fresh | change | (kind == DIGIT))
        quote = np.flatnonzero((low == 0x27) & start)
        if len(quote):  # a word with a quote is one part: the library knows the contractions
            blank_before = np.ones(len(data), bool)
            blank_before[1:] = kind[:-1] == BLANK
            word_begins = start & (fresh | blank_before)
            word = np.cumsum(word_begins) - 1
            quoted = np.zeros(int(word[-1]) + 1, bool)
            quoted[word[quote]] = True
            begins &= ~(quoted[word] & start) | word_begins
        bounds = np.flatnonzero(begins | ~start | fresh)
        place = np.flatnonzero(begins[bounds])
        starts = bounds[place]
        ends = np.append(bounds, len(data))[place + 1]
        hashes = span_hashes(prefix(low), starts, ends)
        codes, distinct = pd.factorize(hashes)
        pool_at, length = self.known.find(distinct)
        new = np.flatnonzero(pool_at < 0)
        if len(new):
            if len(self.known) + len(new) > MOST_PARTS:
                self.known, new = Known(), np.arange(len(distinct))
            example = np.full(len(distinct), -1, np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            text = low.tobytes()
            self._learn(distinct[new], [text[a:b].decode() for a, b in zip(starts[example[new]].tolist(), ends[example[new]].tolist())])
            pool_at, length = self.known.find(distinct)
        lengths = length[codes]
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.known.pool[np.repeat(pool_at[codes] - before[:-1], lengths) + np.arange(before[-1])].astype("<u4").tobytes()
        cuts = (4 * before[np.searchsorted(starts, offsets)]).tolist()
        out = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        if odd.any():
            text = data.tobytes()
            for row in np.flatnonzero(odd).tolist():
                out[row] = self.whole([text[offsets[row] : offsets[row + 1]].decode()])[0].tobytes()
        return out

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        found: list[np.ndarray] = []
        for k in range(0, len(parts), JOINED):
            group = parts[k : k + JOINED]
            ids = self.whole([" ".join(group)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids) and not any("'" in p for p in group):
                found += np.split(ids, cuts[:-1])
            else:
                found += self.whole(group)
        self.known.add(hashes, np.array([len(x) for x in found], np.int64), np.concatenate(found))


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One per worker process and file: its parts stay known from task to task."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
