"""Best-fit packing of documents into token sequences (bounded space, online).

A fixed number of bins is open. The free spaces that open bins have are the set bits of
one integer, so the tightest bin that takes a piece is the lowest set bit at or above the
piece's length. Beyond the limit of open bins the fullest one closes first. Pieces come in a
hashed order, so what a group packs to depends neither on arrival order nor on their lengths.

Defined results: a null or empty text is a document of the end id alone; repeated rows are
packed each on its own; a null id stays null; a very long text has pieces in many groups, and
a worker holds its ids once; ties between equal bins take the newest; an empty table gives an
empty result; further columns of the table are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.shared import free_names, id_and_text, numbered, ragged, rows_of, table_of
from lectern.llm.tokens import encoded

LENGTH = 1024
END_ID = 2
#: Fixed space of a packer.
OPEN_BINS = 1024
#: Pieces that one task packs; a table has as many packing groups as it takes.
GROUP_PIECES = 1 << 16

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
WITH_IDS = PIECES.append(pa.field("ids", pa.list_(pa.int32())))


class BestFit:
    """``open_bins`` bins of ``size`` tokens, kept by free space."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.bits = 0
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]
        self.count = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        """Place a piece; returns its bin and its offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = self.bins[free]
            number = stack.pop()
            if not stack:
                self.bits &= ~(1 << free)
            self.count -= 1
        else:
            free, number = self.size, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.bins[rest].append(number)
            self.bits |= 1 << rest
            self.count += 1
            if self.count > self.open_bins:
                self._close_fullest()
        return number, self.size - free

    def _close_fullest(self) -> None:
        free = (self.bits & -self.bits).bit_length() - 1
        self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.count -= 1


def cut_lengths(n_tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces per document and length of its first piece; all later pieces are full."""
    pieces = np.maximum(1, -(-n_tokens // size))
    return pieces, n_tokens - (pieces - 1) * size


def to_pieces(batches: Iterable[pa.RecordBatch], path: str, rule: str, size: int, with_ids: bool, added_tokens: bool = False) -> Iterator[pa.RecordBatch]:
    for ids, tokens, before in encoded(rows_of(batches), path, rule, END_ID, added_tokens):
        n_tokens = np.diff(before)
        pieces, first = cut_lengths(n_tokens, size)
        number = ragged(np.zeros(len(pieces), np.int64), pieces)
        owner = np.repeat(np.arange(len(pieces)), pieces)
        start = np.where(number == 0, 0, first[owner] + (number - 1) * size)
        length = np.where(number == 0, first[owner], size)
        at = (before[:-1][owner] + start).tolist()
        little = tokens.astype("<u4", copy=False)
        sums = [zlib.crc32(little[a : a + n]) for a, n in zip(at, length.tolist(), strict=True)]
        columns = {"doc_id": ids.take(pa.array(owner)), "piece": number, "start": start, "length": length, "ids_crc32": np.array(sums, np.int64)}
        if with_ids:  # pieces follow one another without gaps
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))), pa.int32()), pa.array(tokens.astype(np.int32)))
        yield table_of(WITH_IDS if with_ids else PIECES, **columns)


def token_pieces(docs: DataFrame, path: str, rule: str = "blanks", size: int = LENGTH, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Each document's tokens and end id as pieces of at most ``size``; the first one may be shorter."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return id_and_text(docs, id_col, text_col).mapInArrow(lambda b: to_pieces(b, path, rule, size, with_ids, added_tokens), schema)


def pack(pieces: DataFrame, size: int = LENGTH, open_bins: int = OPEN_BINS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; further columns of the pieces stay.

    The pieces are written with a row number, dealt by a hash of it and their own columns to groups of about
    ``group_pieces``, however many rows are equal, and packed in the order of a second hash.
    """
    pieces = pieces.drop("sequence_id", "offset")
    row, order, group = free_names(pieces, "row", "pack_order", "pack_group")
    written = numbered(pieces, row, "pieces")
    groups = max(1, -(-written.count() // group_pieces))
    own = [F.col("doc_id"), F.col("piece"), F.col("ids_crc32"), F.col("length"), F.col(row)]
    dealt = written.withColumn(order, F.xxhash64(F.lit(1), *own)).withColumn(group, F.pmod(F.xxhash64(F.lit(0), *own), F.lit(groups)).cast("int"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    names = (row, order, group)

    def packed(rows: pa.Table) -> pa.Table:
        number, order, group = names
        rows = rows.sort_by([(order, "ascending"), (number, "ascending")])
        base = rows[group][0].as_py() << 40
        bins = BestFit(size, open_bins)
        placed = np.array([bins.put(n) for n in rows["length"].to_pylist()], np.int64)
        rows = rows.drop_columns(list(names))
        return rows.append_column("sequence_id", pa.array(placed[:, 0] + base)).append_column("offset", pa.array(placed[:, 1]))

    return dealt.groupBy(group).applyInArrow(packed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, rule: str = "blanks", size: int = LENGTH, open_bins: int = OPEN_BINS, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Documents to packed pieces; with ``with_ids`` the token ids of each piece come along."""
    pieces = token_pieces(docs, path, rule, size, with_ids, id_col, text_col, added_tokens)
    return pack(pieces, size, open_bins)
