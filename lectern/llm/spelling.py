"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. A word's whole one-edit neighbourhood is generated over the
symbols, which is small, and joined with the reduced vocabulary; two words one edit apart are always
one edit apart or equal when reduced, so nothing is missed, and each candidate is verified on the
original strings.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lectern.llm import words as W
from lectern.llm.shared import id_and_text, ragged, rows_of, staged, table_of

#: Symbols that letters are hashed to. More symbols: longer neighbourhoods, fewer false candidates.
SYMBOLS = 8
#: Words of fewer code points or occurrences are not looked at.
MIN_LENGTH = 5
MIN_COUNT = 3
#: A word's form has at least so many times its occurrences.
RATIO = 2
#: One of so many runs, by checksum, loses a code point before it is counted.
LOSES_ONE_IN = 97
#: Bits of the filter that tells which reduced words exist: 8 MB whatever the vocabulary.
FILTER_BITS = 1 << 26
#: Bits of one row of Spark's bitmap functions.
_ROW_BITS = 1 << 15
#: Bytes of text whose words are counted together before they leave a task.
COUNT_BYTES = 8 << 20
#: Neighbours generated at once.
NEIGHBOUR_ROWS = 1 << 18

_LEAD = 0xC3  # first byte of U+00C0 to U+00FF
_STEP = np.uint64(0x9E3779B97F4A7C15)
_STEP_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _crc_table() -> np.ndarray:
    values = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        values = np.where(values & 1, (values >> 1) ^ np.uint32(0xEDB88320), values >> 1)
    return values.astype(np.uint32)


_CRC = _crc_table()
#: Runs of more bytes get their checksum from zlib one by one.
_CRC_STEPS = 64


def find_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal letter runs (A-Z, a-z, U+00C0 to U+00FF) of some texts, and each run's text.

    A letter beyond ASCII is its lead byte and the byte behind it; a text never ends inside a code point.
    """
    letter = ((data | 0x20) >= 97) & ((data | 0x20) <= 122) | (data == _LEAD)
    letter[1:] |= data[:-1] == _LEAD
    edge = np.zeros(len(data) + 1, np.int8)
    edge[:-1] = letter
    before = np.zeros(len(data) + 1, np.int8)
    before[1:] = letter
    first, last = edge > before, edge < before
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    joined = inner[letter[inner] & letter[inner - 1]] if len(inner) else inner  # two texts touch letter to letter
    first[joined] = last[joined] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, each continuing from the checksum of what stands before it."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    state = state[order] ^ np.uint32(0xFFFFFFFF)
    at, sizes = starts[order], lengths[order]
    long = int(np.searchsorted(-sizes, -_CRC_STEPS, "left"))
    for k in range(min(_CRC_STEPS, int(sizes[0]) if len(sizes) else 0)):
        n = int(np.searchsorted(-sizes, -k, "left"))
        if n <= long:
            break
        now = state[long:n]
        state[long:n] = _CRC[(now ^ data[at[long:n] + k]) & 0xFF] ^ (now >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(long):
        state[k] = zlib.crc32(data[at[k] : at[k] + sizes[k]].tobytes(), int(state[k]))
    result = np.empty_like(state)
    result[order] = state
    return result


_WORDS = "word string, n long"
_WORDS_ARROW = pa.schema([("word", pa.string()), ("n", pa.int64())])


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data[ragged(starts, lengths)])])


def _count(ids: pa.Array, data: np.ndarray, offsets: np.ndarray, min_length: int) -> pa.RecordBatch | None:
    """Distinct words of some texts with their occurrences."""
    if not len(data):
        return None
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    starts, ends, owner = find_runs(data, offsets)
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == _LEAD, out=leads[1:])
    letters = ends - starts - (leads[ends] - leads[starts])
    kept = letters >= min_length
    if not kept.any():
        return None
    starts, ends, owner, letters = starts[kept], ends[kept], owner[kept], letters[kept]
    prefix = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids.to_pylist()], np.uint32)
    crc = checksums(data, starts, ends, prefix[owner])
    loses = crc % LOSES_ONE_IN == 0
    found = [_strings(data, starts[~loses], (ends - starts)[~loses])]
    cut = []
    for start, end, n, h in zip(starts[loses].tolist(), ends[loses].tolist(), letters[loses].tolist(), crc[loses].tolist(), strict=True):
        if n > min_length:
            word = data[start:end].tobytes().decode()
            cut.append(word[: h % n] + word[h % n + 1 :])
    found.append(pa.array(cut, pa.large_string()))
    counts = pc.value_counts(pa.concat_arrays(found))
    return table_of(_WORDS_ARROW, word=counts.field("values"), n=counts.field("counts"))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """Words of all whole texts with at least ``min_length`` code points and ``min_count`` occurrences: word, n.

    Tasks count the words of some megabytes at a time, Spark adds the counts up before and after its exchange, so a
    word that is everywhere costs one row per task. Null texts have no words; a null id counts as an empty one in the
    checksum; repeated rows count each time. An empty table gives no words. Other columns are not looked at.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in rows_of(batches, COUNT_BYTES):
            if (counted := _count(ids, data, offsets, min_length)) is not None:
                yield counted

    counted = id_and_text(docs, id_col, text_col).mapInArrow(count, _WORDS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _reduced(symbols_of: np.ndarray, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all code points of some words, and the number of code points before each word."""
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return symbols_of[W.mix(points.astype(np.uint64) * _STEP) % np.uint64(len(symbols_of))], before[offsets]


class Alphabet:
    """Letters hashed to ``symbols`` symbols, words of symbols hashed to 64 bits."""

    def __init__(self, symbols: int = SYMBOLS) -> None:
        self.symbols = symbols
        self.values = W.mix(np.arange(1, symbols + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
        self.index = np.arange(symbols)

    def reduce(self, strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _reduced(self.index, strings)

    def _powers(self, n: int) -> np.ndarray:
        powers = np.full(n + 2, _STEP, np.uint64)
        powers[0] = 1
        return np.multiply.accumulate(powers)

    def codes(self, symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """One 64-bit code per word of symbols."""
        place = np.arange(len(symbols)) - np.repeat(firsts[:-1], np.diff(firsts))
        powers = self._powers(int(np.diff(firsts).max(initial=0)))
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(self.values[symbols] * powers[place], out=sums[1:])
        return W.mix(sums[firsts[1:]] - sums[firsts[:-1]])

    def neighbours(self, symbols: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word numbers and codes of all words of symbols at most one edit away, each once per word.

        Equal results of one kind of edit are made once: a symbol is taken out at the end of its
        stretch of equal symbols, and put in only behind a different one.
        """
        counts = np.diff(firsts)
        owner = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(symbols)) - firsts[:-1][owner]
        powers = self._powers(int(counts.max(initial=0)))
        weight = self.values[symbols] * powers[place]
        sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(weight, out=sums[1:])
        start, total = sums[firsts[:-1]], sums[firsts[1:]] - sums[firsts[:-1]]
        head = sums[:-1] - start[owner]  # what stands before each symbol
        tail = total[owner] - head - weight
        yield np.arange(len(counts)), W.mix(total)
        last = np.ones(len(symbols), bool)
        last[:-1] = (symbols[1:] != symbols[:-1]) | (owner[1:] != owner[:-1])
        yield owner[last], W.mix(head + tail * _STEP_INVERSE)[last]
        for s in range(self.symbols):
            other = symbols != s
            yield owner[other], W.mix(head + self.values[s] * powers[place] + tail)[other]
            # before every symbol, unless the one before it is the same; and at the end
            free = np.ones(len(symbols), bool)
            free[1:] = (symbols[:-1] != s) | (place[1:] == 0)
            yield owner[free], W.mix(head + self.values[s] * powers[place] + (tail + weight) * _STEP)[free]
            ends_other = counts > 0
            ends_other[ends_other] = symbols[firsts[1:][ends_other] - 1] != s
            ends_other |= counts == 0
            yield np.flatnonzero(ends_other), W.mix(total + self.values[s] * powers[counts])[ends_other]


def _word_batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    for batch in batches:
        strings = batch.column(0).cast(pa.large_string())
        lengths = pc.utf8_length(strings).to_numpy(zero_copy_only=False)
        total, first = np.cumsum(lengths), 0
        while first < len(strings):
            start = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, start + size, "right")))
            yield batch.slice(first, last - first), strings.slice(first, last - first)
            first = last


def _with_codes(vocabulary: DataFrame, symbols: int) -> DataFrame:
    schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("code", pa.int64())])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet = Alphabet(symbols)
        for batch, strings in _word_batches(batches, NEIGHBOUR_ROWS):
            yield table_of(schema, word=strings, n=batch.column(1), code=alphabet.codes(*alphabet.reduce(strings)).view(np.int64))

    return vocabulary.select("word", "n").mapInArrow(reduce, "word string, n long, code long")


def _filter(coded: DataFrame, bits: int) -> np.ndarray:
    """A bit for every reduced word, at its code modulo ``bits``."""
    at = F.pmod("code", F.lit(bits))
    rows = coded.groupBy((at / _ROW_BITS).cast("int").alias("row")).agg(F.bitmap_construct_agg((at % _ROW_BITS).cast("long")).alias("bits"))
    table = np.zeros((max(bits // _ROW_BITS, 1), _ROW_BITS // 8), np.uint8)
    for row, found in rows.collect():  # at most bits / 2^15 rows of 4 KB
        table[row] = np.frombuffer(found, np.uint8)
    return table.reshape(-1)


def _neighbour_codes(coded: DataFrame, symbols: int, exists: np.ndarray, bits: int) -> DataFrame:
    """(word, code) for every reduced word that may exist within one edit of the word's own."""
    schema = pa.schema([("word", pa.string()), ("code", pa.int64())])
    shared = coded.sparkSession.sparkContext.broadcast(exists)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, there = Alphabet(symbols), shared.value
        for _, strings in _word_batches(batches, NEIGHBOUR_ROWS):
            for owner, codes in alphabet.neighbours(*alphabet.reduce(strings)):
                codes = codes.view(np.int64)
                at = codes & np.int64(bits - 1)
                found = np.flatnonzero((there[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
                if len(found):
                    yield table_of(schema, word=strings.take(pa.array(owner[found])), code=codes[found])

    return coded.select("word").mapInArrow(generate, "word string, code long")


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS, filter_bits: int = FILTER_BITS) -> DataFrame:
    """Every word with every other word one edit away: word, near, near_n.

    The vocabulary is staged. Both sides of the join are spread by the code of the reduced word; a word has at most
    (2L + 1) * symbols neighbours, of which those that no reduced word matches are left out before the exchange
    by a filter of ``filter_bits`` bits (a power of two). Pairs are verified within the join and go no further.
    Spark takes neighbours, many to a word, for fewer bytes than the words' file and would send them all to the driver,
    so the join is a merge whatever it estimates.
    """
    coded = staged(_with_codes(vocabulary, symbols), "reduced-words")
    neighbours = _neighbour_codes(coded, symbols, _filter(coded, filter_bits), filter_bits)
    other = coded.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "code")
    one_edit = F.levenshtein("word", "near", 1) == 1
    return neighbours.hint("merge").join(other, "code").where((F.abs(F.length("word") - F.length("near")) <= 1) & one_edit).select("word", "near", "near_n")


def group_variants(vocabulary: DataFrame, ratio: float = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """Each word (word, n) with its more frequent spelling: word, form, root, n, n_near, form_n.

    ``form`` is the near word with the most occurrences (ties: the smallest) if it has at least ``ratio`` (more than
    1) times the word's; ``root`` is where the forms of forms end, the word itself if it has none. Words are distinct;
    a very long word costs neighbours in proportion to its length. No words give no rows.
    """
    vocabulary = staged(vocabulary.select("word", "n"), "vocabulary")
    best = F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), F.col("near")))
    found = near_words(vocabulary, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(found, "word", "left")
    takes = F.col("best.near_n") >= ratio * F.col("n")
    forms = staged(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("best.near_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = follow(forms.where("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) with every chain of links followed to its end; each round doubles the steps taken.

    Forms have more occurrences than their words, so chains have no loops and their length is at most a logarithm.
    Links are many times their file's size in memory, so they are merged and never sent to the driver.
    """
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(links.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = bool(links.where("moved").take(1))
        links = links.select("word", "root")
        if not moved:
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of all whole texts; see ``count_words`` and ``group_variants``."""
    return group_variants(count_words(docs, id_col, text_col))
