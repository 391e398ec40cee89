"""Token ids of many texts with a public byte-level BPE vocabulary.

White space, space and 0x09-0x0D, splits a text into units that the vocabulary's pattern never
crosses: a run of other bytes with the one space before it, and white space between units.  A run is
split further between an ASCII letter and ASCII punctuation other than the apostrophe.  Each
distinct unit is encoded once by ``tokenizers`` and its ids are then taken from a table of bounded
size, so ids equal those of encoding the whole text.  Texts with other Unicode white space, or with the
content of an added token where these have ids of their own, are encoded whole.
"""

from __future__ import annotations

import os

import numpy as np

from . import words as W

_U = np.uint64
#: White space beyond the ASCII separators, as UTF-8, which a text's units may not be split around.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_WIDE_LEAD = np.zeros(256, bool)
_WIDE_LEAD[[x[0] for x in _WIDE_SPACE]] = True
_LETTER = np.array([chr(c).isalpha() and c < 0x80 for c in range(256)], bool)
_MARK = np.array([0x21 <= c < 0x7F and not chr(c).isalnum() and c != 0x27 for c in range(256)], bool)
_NEWLINE = 198
_tables: dict[tuple[str, int, bool], "TokenTable"] = {}


def default_vocabulary() -> str:
    """Path of the 50k byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenTable:
    """Ids of units seen so far in this process; emptied when ``limit`` units are held.

    ``added``: the content of an added token, as <|endoftext|>, has the token's id in a text, which is
    the vocabulary's own rule; else it is read like other text.
    """

    SLOT_BITS = 21

    def __init__(self, path: str, end_id: int, limit: int = 1_000_000, added: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if added or not t.special]
        self.apart = [x for x in special if x]
        self.end_id, self.limit = end_id, limit
        self._reset()

    def _reset(self) -> None:
        self.slots = np.zeros((2, 1 << self.SLOT_BITS), np.int32)
        self.key = np.zeros(1 << 16, np.uint64)
        self.cut = np.zeros((1 << 16) + 1, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.size = 1
        self.ids[0], self.cut[1] = self.end_id, 1

    def _add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = len(keys), self.cut[self.size]
        while self.size + n + 1 > len(self.key):
            self.key = np.concatenate([self.key, np.zeros_like(self.key)])
            self.cut = np.concatenate([self.cut, np.zeros(len(self.key) - len(self.cut) + 1, np.int64)])
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.key[self.size : self.size + n] = keys
        self.cut[self.size + 1 : self.size + n + 1] = used + np.cumsum(counts)
        self.ids[used : used + len(ids)] = ids
        one, two = self._places(keys)
        number = np.arange(self.size, self.size + n, dtype=np.int32)
        free = self.slots[0][one] == 0
        self.slots[0][one[free]] = number[free]
        lost = self.slots[0][one] != number
        self.slots[1][two[lost]] = number[lost]
        self.size += n

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The two places where a unit may be found."""
        return (keys >> _U(64 - self.SLOT_BITS)).astype(np.int64), (keys & _U((1 << self.SLOT_BITS) - 1)).astype(np.int64)

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """The number of each unit, or of some other that stands in its place."""
        one, two = self._places(keys)
        at = self.slots[0][one].astype(np.int64)
        other = np.flatnonzero(self.key[at] != keys)
        at[other] = self.slots[1][two[other]]
        return at

    def encode_text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, keys: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Encodes units that were not held, and returns the number of each; units of words go to the tokenizer a line each."""
        number, base = np.empty(len(keys), np.int64), self.size
        units = [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
        blank = np.array([u.isspace() for u in units], bool)
        inked = np.flatnonzero(~blank)
        if len(inked):
            ids = self.encode_text("\n".join(units[i].decode("utf-8") for i in inked) + "\n")
            stop = np.flatnonzero(ids == _NEWLINE)
            counts = np.diff(np.append(-1, stop)) - 1
            if len(stop) != len(inked):
                raise RuntimeError("the vocabulary does not keep lines apart")
            self._add(keys[inked], ids[ids != _NEWLINE], counts)
            number[inked] = base + np.arange(len(inked))
        for i in np.flatnonzero(blank):
            ids = self.encode_text(units[i].decode())
            number[i] = self.size
            self._add(keys[i : i + 1], ids, np.array([len(ids)]))
        return number

    def encode(self, block: W.Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block's texts, each with the end id after it, and the bounds of each text."""
        start, end, of = _units(block)
        key = W.span_hashes(block.data, start, end)
        closing = end == start
        if self.size > self.limit:
            self._reset()
        at = self._look_up(key)
        odd = _with_wide_space(block) | _with_any(block, self.apart)
        missed = (self.key[at] != key) & ~closing
        if odd:  # their units may not keep apart; they are replaced below
            missed &= ~np.isin(np.searchsorted(block.offsets, start, "right") - 1, list(odd))
        if missed.any():
            where = np.flatnonzero(missed)
            new, first, back = np.unique(key[where], return_index=True, return_inverse=True)
            at[where] = self._learn(new, block.data.tobytes(), start[where[first]], end[where[first]])[back]
        at[closing] = 0
        count = self.cut[at + 1] - self.cut[at]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(self.cut[at] - total[:-1], count) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total[1:][closing]])
        if odd:
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(block.n)]
            for i in odd:
                parts[i] = np.append(self.encode_text(block.text(i).decode("utf-8")), np.uint32(self.end_id))
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, bounds


def _with_wide_space(block: W.Block) -> set[int]:
    return _with_any(block, _WIDE_SPACE) if _WIDE_LEAD[block.data].any() else set()


def _with_any(block: W.Block, marks: list[bytes]) -> set[int]:
    """Texts that hold one of the marks."""
    found: set[int] = set()
    raw = block.data.tobytes() if marks else b""
    for mark in marks:
        at = raw.find(mark)
        while at >= 0:
            i = int(np.searchsorted(block.offsets, at, "right")) - 1
            found.add(i)
            at = raw.find(mark, int(block.offsets[i + 1]))
    return found


def _units(block: W.Block) -> tuple[np.ndarray, np.ndarray, None]:
    """Byte ranges of units in order; an empty range closes each text."""
    data, off = block.data, block.offsets
    w = W.words(block)
    before = np.empty(len(w), np.int64)  # end of what stands before the word: the last word, or the text's start
    if len(w):
        before[0] = 0
        before[1:] = w.end[:-1]
        np.maximum(before, off[:-1][w.of], out=before)
    gap = w.start - before
    spaced = (gap > 0) & (data[np.maximum(w.start - 1, 0)] == 0x20) if len(w) else np.zeros(0, bool)
    lone = (gap > 0) & ~spaced
    long_ = gap > 1
    last = np.where(w.bounds[1:] > w.bounds[:-1], w.end[np.maximum(w.bounds[1:] - 1, 0)] if len(w) else 0, off[:-1])
    tail = off[1:] > last
    letter, mark = _LETTER[data], _MARK[data]
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    cut = cut[~edge[cut]]
    ink, ends = np.sort(np.concatenate([w.start - spaced, cut])), np.sort(np.concatenate([w.end, cut]))
    start = np.concatenate([off[1:], before[long_], w.start[lone] - 1, ink, last[tail]])
    end = np.concatenate([off[1:], w.start[long_] - 1, w.start[lone], ends, off[1:][tail]])
    order = np.argsort(start, kind="stable")
    return start[order], end[order], None


def token_table(path: str, end_id: int, added: bool = False) -> TokenTable:
    """The table of this process for a vocabulary file."""
    have = _tables.get((path, end_id, added))
    if have is None:
        have = _tables[path, end_id, added] = TokenTable(path, end_id, added=added)
    return have
