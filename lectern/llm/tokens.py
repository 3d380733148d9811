"""Token ids of whole Arrow batches with a public tokenizer.

Texts are cut where no token of the tokenizer can reach across; each distinct piece goes
through the tokenizer once per worker and its ids are gathered for every occurrence.

Added tokens written out in a text (``<|endoftext|>``) are plain text or, with ``added_tokens``,
their own ids, as the tokenizer has it by default.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np

from lectern.llm import words
from lectern.llm.shared import ragged

#: Slots of a worker's table of pieces, and the pieces and ids it remembers before it starts afresh.
SLOT_BITS = 22
SLOTS = 1 << SLOT_BITS
POOL_PIECES = 3 << 19
POOL_IDS = 8 << 20
#: Unknown pieces that go through the tokenizer as one text.
JOINED = 512

# A blank opens a new piece of a byte-level vocabulary if a visible character follows. Lead
# bytes of code points that may be white space (U+0085, U+00A0, U+1680, U+2000.., U+3000) do
# not count as visible here, which only makes a piece longer.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xE0] = True


def space_pieces(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces between ASCII white space, for vocabularies that drop white space."""
    return words.find_words(data, offsets, words.SPACED)


def blank_pieces(data: np.ndarray, offsets: np.ndarray, added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that cover every byte, cut before the last blank ahead of a visible character.

    An added token ends the text before it, so the blanks on either side stay with it.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        cut[:-2] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
    if added:
        for match in added.finditer(data.tobytes()):
            cut[max(0, match.start() - 1) : match.end(1)] = False
    cut[offsets] = True
    bounds = np.flatnonzero(cut)
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts, ends = bounds[:-1], bounds[1:]
    return starts, ends, np.searchsorted(starts, offsets)


RULES = {"spaces": space_pieces, "blanks": blank_pieces}


class Encoder:
    """Encodes chunks of texts; ``rule`` names how the vocabulary lets texts be cut."""

    def __init__(self, path: str, rule: str, added_tokens: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        self.cut = RULES[rule]
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if added_tokens or not t.special]
        if any(c.isspace() for t in added for c in t):
            raise ValueError("texts cannot be cut at blanks where an added token holds white space")
        names = b"|".join(re.escape(t.encode()) for t in sorted(added, key=len, reverse=True))
        # Overlapping places count too; white space behind a token may be its own.
        self.added = re.compile(rb"(?=((?:" + names + rb")[\x20\x09-\x0D]*))") if added else None
        if rule == "spaces":
            # White space goes, so pieces may be told apart by a control character between blanks.
            self.glue, self.joins = b" \x01 ", lambda piece: b"\x01" not in piece
            self.mark = self._ids([b"\x01"])[0][0]
        else:
            # A byte-level token has as many bytes as letters, so sums of widths find the borders.
            self.glue, self.joins = b"", lambda piece: piece[0] == 0x20 and len(piece) > 1 and bool(_VISIBLE[piece[1]]) and not (self.added and self.added.search(piece))
            self.width = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
            for token, number in self.tokenizer.get_vocab().items():
                self.width[number] = len(token)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.entries = np.full(SLOTS, -1, np.int64)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 16, np.int64)
        self.lengths = np.zeros(1 << 16, np.int64)
        self.used = self.known = 0

    @staticmethod
    def _slots(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(SLOTS - 1)
        return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(SLOT_BITS)) & mask).astype(np.int64)

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces (all joinable or none), and how many each has; long texts go through the tokenizer faster."""
        groups = [pieces[k : k + JOINED] for k in range(0, len(pieces), JOINED)]
        if not self.joins(pieces[0]):
            found = self._ids(pieces)
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        ids, counts = [], []
        for group, own in zip(groups, self._ids([self.glue.join(g) for g in groups]), strict=True):
            if self.glue:
                marks = np.flatnonzero(own == self.mark)
                if len(marks) != len(group) - 1:
                    raise ValueError("the separator of joined pieces is not a token of its own")
                counts.append(np.diff(np.concatenate(([-1], marks, [len(own)]))) - 1)
                ids.append(own[own != self.mark])
            else:
                ends = np.cumsum(self.width[own])
                counts.append(np.diff(np.searchsorted(ends, np.cumsum([len(p) for p in group]), "left") + 1, prepend=0))
                ids.append(own)
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, pieces: list[bytes]) -> np.ndarray:
        """Encode pieces, append their ids to the pool, return their entries."""
        joined = np.array([self.joins(p) for p in pieces])
        entries = np.empty(len(pieces), np.int64)
        for side in (True, False):
            places = np.flatnonzero(joined == side)
            if len(places):
                ids, lengths = self._encode_pieces([pieces[k] for k in places.tolist()])
                entries[places] = self._remember(ids, lengths)
        return entries

    def _remember(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(lengths) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.ids[self.used : self.used + len(ids)] = ids
        span = slice(self.known, self.known + len(lengths))
        self.starts[span] = self.used + np.cumsum(lengths) - lengths
        self.lengths[span] = lengths
        self.used += len(ids)
        self.known += len(lengths)
        return np.arange(span.start, span.stop)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk and the number of ids before each text."""
        starts, ends, firsts = self.cut(data, offsets, self.added)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > POOL_IDS or self.known > POOL_PIECES:
            self._forget()
        hashes = words.hash_spans(data, starts, ends, fold=False)
        hashes ^= (ends - starts).astype(np.uint64) << np.uint64(40)
        first, second = self._slots(hashes)
        entries = np.where(self.keys[first] == hashes, self.entries[first], -1)
        missing = np.flatnonzero(entries < 0)
        second = second[missing]
        entries[missing] = np.where(self.keys[second] == hashes[missing], self.entries[second], -1)
        missing = missing[entries[missing] < 0]
        if len(missing):
            fresh, where, back = np.unique(hashes[missing], return_index=True, return_inverse=True)
            at = missing[where]
            raw = data.tobytes()
            learned = self._learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            entries[missing] = learned[back]
            first, second = self._slots(fresh)
            slots = np.where(self.entries[first] < 0, first, second)
            # Where two pieces meet in a slot, numpy keeps the last one in both columns.
            self.keys[slots], self.entries[slots] = fresh, learned
        lengths = self.lengths[entries]
        ids = self.ids[ragged(self.starts[entries], lengths)]
        before = np.concatenate(([0], np.cumsum(lengths)))
        return ids, before[firsts]


_ENCODERS: dict[tuple[str, str, bool], Encoder] = {}


def encoder(path: str, rule: str, added_tokens: bool = False) -> Encoder:
    """One encoder per worker process, which keeps what it has learned from task to task."""
    if (path, rule, added_tokens) not in _ENCODERS:
        _ENCODERS[path, rule, added_tokens] = Encoder(path, rule, added_tokens)
    return _ENCODERS[path, rule, added_tokens]


def encoded(rows: Iterator[tuple], path: str, rule: str, end_id: int, added_tokens: bool = False) -> Iterator[tuple]:
    """Per chunk of an (ids, bytes, offsets) stream: document ids, token ids and the number before each text.

    ``end_id`` closes every text, so no text is without a token.
    """
    own = encoder(path, rule, added_tokens)
    for ids, data, offsets in rows:
        tokens, before = own.encode(data, offsets)
        n = len(ids)
        out = np.empty(len(tokens) + n, np.uint32)
        ends = before[1:] + np.arange(n)
        keep = np.ones(len(out), bool)
        keep[ends] = False
        out[keep] = tokens
        out[ends] = end_id
        yield ids, out, before + np.arange(n + 1)
