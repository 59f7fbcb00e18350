"""Whole texts to token ids with a public tokenizer file, a batch of Arrow strings at a time.

Both tokenizers split a text into words before they merge, and no word crosses from other text into
white space or from letters into punctuation. So a text is cut before each ASCII white space that
follows something else and before each ASCII punctuation mark after an ASCII letter; equal pieces are
encoded once, and the ids are put together again: the same ids as from the whole text. A text that has
the string of an added token (as "<|endoftext|>") is encoded whole, as such a string is one id wherever it stands.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.text_arrays import SPACE, slices

#: Pieces that a task remembers before it starts anew.
REMEMBERED = 400_000
ENCODED_AT_ONCE = 1_000
#: White space that isn't ASCII; no cut after it, as a run of white space isn't cut.
_OTHER_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]")
_SEPARATOR = " |"
#: What each byte is, as bits.
_SPACE, _LETTER, _MARK, _RARE = 1, 2, 4, 8
_KIND = np.where(SPACE, _SPACE, 0).astype(np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58] = 0
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] |= _RARE


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The encoder of this worker process, which later tasks go on with."""
    return Encoder(path)


class Encoder:
    """Encodes as the tokenizers library does without its template's special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # no normalizer makes such a string of other characters than its own in another case
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.separator = next(self._ids([_SEPARATOR]))
        assert len(self.separator) == 1
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.first, self.count, self.flat, self.used = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.int32), 0

    def _ids(self, texts: list[str], at_once: int = 250) -> Iterator[np.ndarray]:
        for k in range(0, len(texts), at_once):  # an encoding is many times the size of its ids
            for x in self.tokenizer.encode_batch_fast(texts[k : k + at_once], add_special_tokens=False):
                yield np.array(x.ids, np.int32)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Remembers the pieces and gives the index of each."""
        texts, at = pieces.cast(pa.string()), len(self.known)
        joins = pc.match_substring_regex(texts, r"(?s)^[ \n\t][^|]*$")  # what a separator can follow and be told from
        joined, rest = texts.filter(joins), texts.filter(pc.invert(joins))
        flat, counts = [], []
        starts = [*range(0, len(joined), ENCODED_AT_ONCE), len(joined)]
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), joined), _SEPARATOR).to_pylist() if len(joined) else []
        for k, ids in enumerate(self._ids([g + _SEPARATOR for g in groups], 1)):
            cuts = np.flatnonzero(ids == self.separator[0])
            if len(cuts) == starts[k + 1] - starts[k]:
                flat.append(ids[ids != self.separator[0]])
                counts.append(np.diff(cuts, prepend=-1) - 1)
            else:
                found = list(self._ids(joined.slice(starts[k], starts[k + 1] - starts[k]).to_pylist()))
                flat += found
                counts.append(np.array([len(x) for x in found]))
        found = list(self._ids(rest.to_pylist()))
        flat += found
        count = np.concatenate([*counts, np.array([len(x) for x in found], np.int64)]).astype(np.int32)
        end, used = at + len(pieces), self.used + int(count.sum())
        while len(self.first) < end:
            self.first, self.count = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.count, np.zeros_like(self.count)])
        while len(self.flat) < used:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.first[at:end], self.count[at:end] = self.used + np.cumsum(count) - count, count
        self.flat[self.used : used] = np.concatenate([*flat, np.zeros(0, np.int32)])
        self.used = used
        self.known = pa.concat_arrays([self.known, joined.cast(pa.binary()), rest.cast(pa.binary())])
        first = joins.to_numpy(zero_copy_only=False)
        index = np.empty(len(pieces), np.int32)
        index[first], index[~first] = at + np.arange(len(joined)), at + len(joined) + np.arange(len(rest))
        return index

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        kind = _KIND[data]
        here, before = kind[1:], kind[:-1]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = ((here & _SPACE) > (before & _SPACE)) | ((here & (before << 1) & _MARK) > 0)
        if (kind & _RARE).any():
            for m in _OTHER_SPACE.finditer(data):
                cut[m.end()] = False
        cut[offsets] = True
        cut[-1] = True
        bounds = np.flatnonzero(cut)
        pieces = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        different = pieces.dictionary
        if len(self.known) > REMEMBERED:
            self._forget()
        place = pc.index_in(different, value_set=self.known)
        index = place.fill_null(0).to_numpy().copy()
        if place.null_count:
            new = place.is_null()
            index[new.to_numpy(zero_copy_only=False)] = self._learn(different.filter(new))
        known = index[pieces.indices.to_numpy()]
        count = self.count[known]
        end = np.cumsum(count, dtype=np.int32)
        ids = self.flat[np.repeat(self.first[known] - end + count, count) + np.arange(end[-1], dtype=np.int32)]
        return ids, np.concatenate([[0], end])[np.searchsorted(bounds, offsets)]

    def texts(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each text with the end id, one after the other; a null text has just the end id."""
        last = np.array([end_id], np.int32)
        whole = pc.fill_null(pc.match_substring_regex(column, self.added, ignore_case=True), False) if self.added else pa.array(np.zeros(len(column), bool))
        marked = set(np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist())
        if marked:
            texts, column = column, pc.if_else(whole, None, column)
        for row, data, offsets in slices(column, 2 << 20):
            ids, at = self._slice(data, offsets)
            for k, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True), row):
                yield np.concatenate([next(self._ids([texts[k].as_py()])) if k in marked else ids[a:b], last])
