"""Terms of a lexicon in texts, entities and key phrases: one pass per text in Arrow batches.

All terms are one Aho-Corasick automaton, so a text is read once whatever the size of the lexicon. A worker builds it
once and keeps it. Words are judged once per worker too: their lower case, part of speech, and whether they carry content.
In a batch every word is a number; tokens, scores and phrases are taken from arrays of these numbers.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from lectern.functions import lexicon as L
from lectern.functions import text as T

#: A lexicon of at most so many terms and bytes is sent to every worker.
MOST_TERMS, MOST_BYTES = 200_000, 16 << 20
#: Words and their judgements that a worker remembers.
REMEMBERED = 1 << 18
#: Sentences times words up to which a document's overlaps are one product of matrices.
DENSE = 1 << 20

# White space as ``text.WS``, in Python's notation.
SPACE = "[\t-\r \xa0  -     　﻿]"
WORD, NUMBER, ACRONYM = (re.compile(p) for p in (T.WORD, T.NUMBER, T.ACRONYM))
DEFINITION = re.compile(rf"(?<![A-Za-z0-9_])([A-Z][A-Za-z-]+(?:{SPACE}+[A-Z]?[A-Za-z-]+){{1,6}}){SPACE}*\(([A-Z][A-Z0-9]{{1,8}})\)")
SPACES = re.compile(f"{SPACE}+")
SECTION = re.compile("^section +[0-9]+")
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
STOP = frozenset(T.STOP_WORDS)
# Parts of speech by ending, in order.
TAGS = (("VBG", ("ing",)), ("VBN", ("ed", "en")), ("RB", ("ly",)), ("JJ", ("al", "ive", "ous", "ful", "less", "ic", "able", "ible", "ent", "ant")))


class Matcher:
    """Numbers of the terms that stand in a text between characters other than a-z and 0-9, in any case."""

    def __init__(self, terms: tuple[str, ...]) -> None:
        numbers: dict[str, list[int]] = {}
        for k, term in enumerate(terms):
            if term:
                numbers.setdefault(term.lower(), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for low, own in numbers.items():
            self.automaton.add_word(low, (len(low), own))
        self.any = bool(numbers)
        if self.any:
            self.automaton.make_automaton()

    def find(self, low: str) -> list[int]:
        """Of a text in lower case, the terms' numbers in order."""
        found: set[int] = set()
        end_of_text = len(low) - 1
        for end, (size, own) in self.automaton.iter(low) if self.any else ():
            start = end - size
            if (start < 0 or low[start] not in ALNUM) and (end == end_of_text or low[end + 1] not in ALNUM):
                found.update(own)
        return sorted(found)


@lru_cache(4)
def matcher(terms: tuple[str, ...]) -> Matcher:
    return Matcher(terms)


@dataclass(frozen=True)
class Word:
    """What is known of a word by its shape; ``kind`` is the type it has as an entity."""

    low: str
    pos: str
    stop: bool
    content: bool
    verbal: bool
    kind: str | None


_WORDS: dict[str, Word] = {}


def judged(word: str) -> Word:
    if (known := _WORDS.get(word)) is not None:
        return known
    low, number = word.lower(), bool(NUMBER.search(word))
    stop, name = low in STOP, "A" <= word[0] <= "Z"
    verbal = not number and not name and low.endswith(("ing", "ed", "en", "ly"))
    kind = "NUMBER" if number else "ACRONYM" if ACRONYM.search(word) else None
    if len(_WORDS) >= REMEMBERED:
        _WORDS.clear()
    _WORDS[word] = Word(low, "CD" if number else "NNP" if name else part_of_speech(low), stop, not stop and not number and len(low) >= 3, verbal, kind)
    return _WORDS[word]


def part_of_speech(low: str) -> str:
    """As ``text.tag_pos`` of a word in lower case."""
    for tag, ends in TAGS:
        if low.endswith(ends):
            return tag
    if low.endswith("s") and len(low) > 3:
        return "NNS"
    return "IN" if low in T.PREPOSITIONS else "DT" if low in STOP else "NN"


class Reader:
    """Entities of sentences for one vocabulary of (type, term)."""

    def __init__(self, rows: tuple[tuple[str, str], ...]) -> None:
        self.rows, self.matcher = rows, matcher(tuple(t for _, t in rows))

    def entities(self, text: str, shaped: list[tuple[str, str]]) -> list[tuple[str, str]]:
        """(text, type), distinct per type in any case: terms in the order of the vocabulary, defined names, words by shape."""
        found = [(self.rows[k][1], self.rows[k][0]) for k in self.matcher.find(text.lower())]
        if "(" in text:
            for name, short in DEFINITION.findall(text):
                found += [(name, "CONCEPT"), (short, "ACRONYM")]
        found += shaped
        if len(found) < 2:
            return found
        seen, out = set(), []
        for value, kind in found:
            if (key := (kind, value.lower())) not in seen:
                seen.add(key)
                out.append((value, kind))
        return out


class Batch:
    """The sentences of some documents, every word a number."""

    def __init__(self, documents: pa.ListArray, own: Reader) -> None:
        self.null, self.own = np.asarray(documents.is_null()), own
        sizes = pc.fill_null(pc.list_value_length(documents), 0).to_numpy(zero_copy_only=False)
        self.docs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)  # first sentence of each, and the end
        self.texts = documents.flatten().to_pylist()
        numbers: dict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__
        every, counts = [], [0]
        for text in self.texts:
            every += map(numbers.__getitem__, WORD.findall(text))
            counts.append(len(every))
        self.codes, self.ends = np.array(every, np.int32), np.array(counts, np.int32)
        self.words, self.known = list(numbers), [judged(w) for w in numbers]
        lows: dict[str, int] = defaultdict()
        lows.default_factory = lows.__len__
        self.low = np.array([lows[k.low] for k in self.known], np.int64)
        self.lows, self.numbers = list(lows), lows

    def flags(self, test) -> np.ndarray:
        """A test of every token by its word."""
        return np.array([test(k) for k in self.known], bool)[self.codes]

    def sentences(self) -> np.ndarray:
        """The sentence of every token."""
        return np.repeat(np.arange(len(self.texts)), np.diff(self.ends))

    def nested(self, ends, values: pa.Array) -> pa.ListArray:
        """Lists of values by sentence, in lists by document."""
        return self.listed(self.docs, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))

    def listed(self, ends, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(self.null))

    def tokens(self) -> pa.ListArray:
        """array<array<struct>>: ``text.tagged_tokens`` of every sentence."""
        of = [pa.array(self.words, pa.string()), *(pa.array([getattr(w, k) for w in self.known], t) for k, t in (("low", pa.string()), ("pos", pa.string()), ("stop", pa.bool_())))]
        return self.nested(self.ends, pa.StructArray.from_arrays([v.take(pa.array(self.codes)) for v in of], names=["text", "lower", "pos", "stop"]))

    @cached_property
    def found(self) -> list[list[tuple[str, str]]]:
        """The entities of every sentence."""
        at = np.flatnonzero(self.flags(lambda k: k.kind is not None))
        shaped: dict[int, list] = defaultdict(list)
        for s, c in zip(self.sentences()[at].tolist(), self.codes[at].tolist(), strict=True):
            shaped[s].append((self.words[c], self.known[c].kind))
        return [self.own.entities(text, shaped.get(s, [])) for s, text in enumerate(self.texts)]

    def entities(self) -> pa.ListArray:
        flat = [e for own in self.found for e in own]
        values = pa.StructArray.from_arrays([pa.array([t for t, _ in flat], pa.string()), pa.array([k for _, k in flat], pa.string())], names=["text", "type"])
        return self.nested(np.concatenate([[0], np.cumsum([len(x) for x in self.found])]).astype(np.int32), values)

    def scores(self) -> pa.ListArray:
        """Overlap of every sentence with the others of its document."""
        kept = self.flags(lambda k: not k.stop and len(k.low) > 2)
        pairs = np.unique(self.sentences()[kept] * np.int64(len(self.lows) + 1) + self.low[self.codes[kept]])
        sentence, low = np.divmod(pairs, np.int64(len(self.lows) + 1))
        cuts = np.searchsorted(sentence, self.docs)
        out = [overlap(sentence[a:b] - first, low[a:b], int(end - first)) for first, end, a, b in zip(self.docs, self.docs[1:], cuts, cuts[1:], strict=False)]
        return self.listed(self.docs, pa.array(np.concatenate([np.zeros(0), *out]), pa.float64()))

    def keywords(self, n: int = 12) -> pa.ListArray:
        """``nlp.keywords``: the most frequent content words of every document, ties by first use."""
        at = np.flatnonzero(self.flags(lambda k: k.content))
        doc = np.repeat(np.arange(len(self.null)), np.diff(self.docs))[self.sentences()[at]]
        base, starts = np.int64(len(self.lows) + 1), np.searchsorted(doc, np.arange(len(self.null) + 1))
        key, first, times = np.unique(doc * base + self.low[self.codes[at]], return_index=True, return_counts=True)
        doc, low = np.divmod(key, base)
        order = np.lexsort((first, -times, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        best = order[rank < n]
        flat = pa.StructArray.from_arrays([pa.array([self.lows[k] for k in low[best]], pa.string()), pa.array(times[best], pa.int32()), pa.array(first[best] - starts[doc[best]], pa.int32())], names=["value", "n", "first"])
        return self.listed(np.searchsorted(doc[best], np.arange(len(self.null) + 1)), flat)

    def phrases(self, n: int) -> pa.ListArray:
        """The ``n`` heaviest phrases: runs of two to four content words count one, entities four; two or more needed."""
        heavy: list[dict[str, list[int]]] = [{} for _ in self.null]
        of_sentence = np.repeat(np.arange(len(self.null)), np.diff(self.docs))
        for s, own in enumerate(self.found):
            counts = heavy[of_sentence[s]]
            for k, (value, kind) in enumerate(own):
                if kind not in ("NUMBER", "METRIC", "ORG"):
                    phrase = spaced(value)
                    if not invalid(phrase):
                        # weight, and the place in the order of discovery: sentence, size, token
                        counts.setdefault(phrase, [0, (s * 8 << 32) + k])[0] += 4
        content = np.flatnonzero(self.flags(lambda k: k.content))
        sentence, verbal = self.sentences()[content], self.flags(lambda k: k.verbal)[content]
        # A stretch ends with its sentence and at a verb form.
        stretch = np.cumsum(verbal | np.concatenate([[True], sentence[1:] != sentence[:-1]])[: len(sentence)])[~verbal]
        low, sentence = self.low[self.codes[content[~verbal]]], sentence[~verbal]
        doc, base = of_sentence[sentence], np.int64(len(self.lows) + 1)
        self.add_entity_runs(heavy, low, stretch, sentence, np.searchsorted(doc, np.arange(len(self.null) + 1)))
        # Runs of more words are counted only where their first words occur twice.
        at, run = np.arange(len(low)), doc.astype(np.int64)
        run = np.unique(run * base + low, return_inverse=True)[1]
        for size in (2, 3, 4):
            inside = at + size - 1 < len(low)
            at, run = at[inside], run[inside]
            inside = stretch[at] == stretch[at + size - 1]
            at, run = at[inside], run[inside]
            _, first, run, times = np.unique(run * base + low[at + size - 1], return_index=True, return_inverse=True, return_counts=True)
            for i, c in zip(first[times >= 2].tolist(), times[times >= 2].tolist(), strict=True):
                j = int(at[i])
                phrase = " ".join([self.lows[w] for w in low[j : j + size]])
                heavy[doc[j]].setdefault(phrase, [c, ((int(sentence[j]) * 8 + size) << 32) + j])
            often = times[run] >= 2
            at, run = at[often], run[often]
        best = [[(p, -c) for c, _, _, p in sorted((-c, -len(p), k, p) for p, (c, k) in own.items())[:n]] for own in heavy]
        flat = [x for own in best for x in own]
        values = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.string()), pa.array([c for _, c in flat], pa.int32())], names=["value", "n"])
        return self.listed(np.concatenate([[0], np.cumsum([len(x) for x in best])]), values)

    def add_entity_runs(self, heavy, low, stretch, sentence, cuts) -> None:
        """Adds to the phrases that are entities the runs of content words that read the same."""
        known = np.zeros(len(self.lows) + 1, bool)
        known[low] = True
        for d, own in enumerate(heavy):
            for phrase, entry in own.items():
                words = [self.numbers[w] if w in self.numbers else -1 for w in phrase.split(" ")]
                if not 2 <= len(words) <= 4 or not all(known[w] for w in words):
                    continue
                size, a, b = len(words), cuts[d], cuts[d + 1]
                at = np.arange(a, b - size + 1)
                for k, w in enumerate(words):
                    at = at[low[at + k] == w]
                at = at[stretch[at] == stretch[at + size - 1]]
                if len(at):
                    entry[0] += len(at)
                    entry[1] = min(entry[1], ((int(sentence[at[0]]) * 8 + size) << 32) + int(at[0]))


def overlap(sentence: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Mean Jaccard overlap of each of ``n`` sets, given as distinct (set, word) in order, with the others, relative to the best."""
    if n < 2:
        return np.ones(n)
    if not len(word):
        return np.zeros(n)
    sizes = np.bincount(sentence, minlength=n).astype(np.float64)
    words, column = np.unique(word, return_inverse=True)
    total = np.zeros(n)
    if n * len(words) <= DENSE:
        held = np.zeros((n, len(words)), np.float32)
        held[sentence, column] = 1
        shared = (held @ held.T).astype(np.float64)
        union = sizes[:, None] + sizes - shared
        both = np.divide(shared, union, out=np.zeros((n, n)), where=union > 0)
        total = both.sum(axis=1) - np.diagonal(both)
    else:
        order = np.argsort(column, kind="stable")
        rows_by_word, starts = sentence[order], np.searchsorted(column[order], np.arange(len(words) + 1))
        ends = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
        for i in np.flatnonzero(sizes):
            shared = np.bincount(np.concatenate([rows_by_word[starts[c] : starts[c + 1]] for c in column[ends[i] : ends[i + 1]]]), minlength=n).astype(np.float64)
            union = sizes[i] + sizes - shared
            both = np.divide(shared, union, out=np.zeros(n), where=union > 0)
            total[i] = both.sum() - both[i]
    mean = total / (n - 1)
    return mean / max(mean.max(), 0.0001)


@lru_cache(REMEMBERED)
def spaced(value: str) -> str:
    return SPACES.sub(" ", value.lower()).strip(" ")


@lru_cache(REMEMBERED)
def invalid(phrase: str) -> bool:
    return len(phrase) < 4 or bool(NUMBER.search(phrase) or SECTION.search(phrase)) or all(w in STOP for w in phrase.split(" "))


@lru_cache(4)
def reader(rows: tuple[tuple[str, str], ...]) -> Reader:
    return Reader(rows)


#: What a batch may be asked for, and its type.
PARTS = {
    "tokens": "array<array<struct<text:string,lower:string,pos:string,stop:boolean>>>", "entities": "array<array<struct<text:string,type:string>>>",
    "scores": "array<double>", "phrases": "array<struct<value:string,n:int>>", "keywords": "array<struct<value:string,n:int,first:int>>",
}


def read(texts: Column, parts: Sequence[str], terms: dict[str, list[str]] | None = None, n: int = 30) -> Column:
    """struct of the ``parts`` of every document's sentences, from one pass over its texts."""
    rows, wanted = tuple(L.term_rows(terms)), tuple(parts)

    @arrow_udf(f"struct<{', '.join(f'{p}:{PARTS[p]}' for p in wanted)}>")
    def of(documents: pa.Array) -> pa.Array:
        batch = Batch(documents, reader(rows))
        return pa.StructArray.from_arrays([batch.phrases(n) if p == "phrases" else getattr(batch, p)() for p in wanted], names=list(wanted))

    return of(texts)


def entities(texts: Column, terms: dict[str, list[str]] | None = None) -> Column:
    """array<array<struct<text, type>>>: the entities of every sentence of a document."""
    return read(texts, ["entities"], terms)["entities"]


def key_phrases(texts: Column, terms: dict[str, list[str]] | None = None, n: int = 30) -> Column:
    """array<struct<value, n>>: the heaviest phrases of a document's sentences."""
    return read(texts, ["phrases"], terms, n)["phrases"]


def bounded(lexicon: DataFrame) -> list[tuple] | None:
    """The rows (type, term) of a lexicon that may be sent to every worker; None if it is larger than that."""
    n, size = lexicon.agg(F.count("*"), F.sum(F.octet_length("term") + F.octet_length(F.col("type").cast("string")))).first()
    if n > MOST_TERMS or (size or 0) > MOST_BYTES:
        return None
    return [tuple(r) for r in lexicon.select("type", "term").filter(F.col("term").isNotNull()).distinct().collect()]


def match_rows(texts: DataFrame, lexicon: list[tuple], kind: DataType, keys: list[str], text: str) -> DataFrame:
    """(keys, type, term) of every text of a table by the automaton; ``kind`` is the type of the column type."""
    own = texts.select(*keys, F.col(text).alias("_text"))
    shared, arrow = texts.sparkSession.sparkContext.broadcast(lexicon), to_arrow_type(kind)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        own = matcher(tuple(t for _, t in rows))
        for batch in batches:
            hits = [own.find(t.lower()) if t else [] for t in batch.column(len(keys)).to_pylist()]
            at = pa.array([k for k, found in enumerate(hits) for _ in found], pa.int64())
            found = [rows[j] for own_hits in hits for j in own_hits]
            columns = [batch.column(k).take(at) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([k for k, _ in found], arrow), pa.array([t for _, t in found], pa.string())], names=[*keys, "type", "term"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[:-1])
    return own.mapInArrow(read, f"{fields}, type {kind.simpleString()}, term string")
