"""Fill-in-the-middle texts: cut a text into units by one repeated-capture match and move its middle to the end.

``(unit)*`` is matched once against the whole text with the ``regex`` library, which keeps
every repetition of a group: ``ends(1)`` is the number of units and the offset of any cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.shared import id_and_text, table_of

#: One unit is one code point, line breaks included.
CODE_POINT = r"(?s:.)"
#: The most repetitions one match keeps, about 100 bytes each; a text of more units goes on from the last end.
STRETCH = 1 << 20
#: Shares of all documents left plain, and of the others that put the suffix first, in hundredths.
PLAIN_FROM = 90
SUFFIX_FIRST_BELOW = 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class Units:
    """Ends of the units of a text, matched left to right."""

    def __init__(self, unit: str = CODE_POINT, stretch: int = STRETCH) -> None:
        self.pattern = regex.compile(f"({unit}){{0,{stretch}}}+")

    def ends(self, text: str) -> np.ndarray:
        """End offset of every unit in code points. What no unit matches at the end of a text is not counted."""
        whole = self.pattern.fullmatch(text)
        if whole is not None:
            return np.array(whole.ends(1), np.int64)
        found, at = [], 0
        while (part := self.pattern.match(text, at)) and part.end() > at:
            found.append(np.array(part.ends(1), np.int64))
            at = part.end()
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers that depend on the seed and the id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def rearrange(text: str, doc_id: int | None, units: Units, seed: int = 1) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, lengths of prefix and middle in code points, and the rearranged text."""
    ends = units.ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (int(ends[c - 1]) if c else 0 for c in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, middle, after = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST_BELOW:
        return n, "spm", low, high - low, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.large_string())])

#: Code points of texts turned into Python strings before a batch is handed on.
BATCH_CHARS = 4 << 20


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int = 1) -> DataFrame:
    """Every document with its text as prefix, suffix and middle between marks.

    One row per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars
    (null if plain) and output. No row needs another, so nothing is shuffled and a lost task is just run again.

    Null and empty texts have no units and stay plain, as do texts that hold a mark. A null id draws as an
    empty one; rows that repeat an id draw alike. A very long text is matched in stretches of ``STRETCH``
    units, so memory stays bounded beside the text itself. With other units than code points, what is left
    behind the last whole unit belongs to the suffix. An empty table gives an empty result, and other
    columns of ``docs`` are not looked at, whatever their names.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                key, text = doc_id.as_py(), text.as_py() or ""
                rows.append((key, *rearrange(text, key, units, seed)))
                size += len(text)
                if size >= BATCH_CHARS:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return id_and_text(docs, id_col, text_col).mapInArrow(cut, _RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return table_of(_ARROW, **{f.name: pa.array(column, f.type) for f, column in zip(_ARROW, zip(*rows, strict=True), strict=True)})


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The original text, rebuilt from a rearranged text and its form alone.

    A rearranged text holds each mark once: documents that hold one stay plain, and no mark can
    begin inside another or be completed by the text beside it.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(cut: DataFrame) -> DataFrame:
    """Lengths and digests of every rearranged and restored text."""
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.encode("output", "UTF-8"), 256).alias("output_sha256"), F.sha2(F.encode(restored(), "UTF-8"), 256).alias("restored_sha256"),
    )


def oracle_sql() -> str:
    """The digest of ``documents`` in DuckDB."""
    return f"""
    WITH base AS (
        SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM documents
    ),
    drawn AS (
        SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
        FROM base
    ),
    cuts AS (
        SELECT doc_id, text, n,
            CASE
                WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
                WHEN h4 % 100 < {SUFFIX_FIRST_BELOW} THEN 'spm' ELSE 'psm'
            END AS form,
            least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high
        FROM drawn
    ),
    parts AS (
        SELECT *, substring(text, 1, low) AS before, substring(text, low + 1, high - low) AS middle, substring(text, high + 1) AS after
        FROM cuts
    )
    SELECT doc_id, n, form,
        CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
        sha256(CASE form
            WHEN 'psm' THEN '{PREFIX}' || before || '{SUFFIX}' || after || '{MIDDLE}' || middle
            WHEN 'spm' THEN '{SUFFIX}' || after || '{PREFIX}' || before || '{MIDDLE}' || middle
            ELSE text END) AS output_sha256,
        sha256(text) AS restored_sha256
    FROM parts
    """
