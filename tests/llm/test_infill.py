"""Fill-in-the-middle: against a plain statement, exact restoration, other units."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import infill
from tests.llm.conftest import ODD


def stated(doc_id, text):
    text, h = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    n, (h1, h2, h3, h4) = len(text), (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc_id, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


ROWS = [*ODD, (None, None), (40, "a<P>b"), (41, "<S>"), (42, "<M"), (43, "<P<S<M>"), (44, "\r\n  \U0001f600é́"), *((k, f"<{k} é\n" * (k % 5)) for k in range(50, 120))]


def order(rows):
    return sorted(rows, key=repr)


def test_matches_the_statement(table):
    cut = infill.fill_in_middle(table(ROWS))
    got = order(tuple(r) for r in cut.collect())
    assert got == order(stated(i, t) for i, t in ROWS)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    digests = infill.digest(cut).collect()
    assert order((r["doc_id"], r["restored_sha256"]) for r in digests) == order((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS)
    assert {r["output_sha256"] for r in digests} == {hashlib.sha256(r[5].encode()).hexdigest() for r in got}


def test_restores_from_output_and_form_alone(table):
    cut = infill.fill_in_middle(table(ROWS)).select("doc_id", "form", F.col("output").alias("text"))
    assert order(tuple(r) for r in cut.select("doc_id", infill.restored("text").alias("t")).collect()) == order((i, t or "") for i, t in ROWS)


def test_empty_table(table):
    assert infill.digest(infill.fill_in_middle(table(ODD).limit(0))).count() == 0


@pytest.mark.parametrize("stretch", [1, 3, 1 << 20])
@pytest.mark.parametrize("unit,text,ends", [
    (infill.CODE_POINT, "aé\n\U0001f600b", [1, 2, 3, 4, 5]), (infill.CODE_POINT, "", []),
    (r"\S+\s*", "one two  three", [4, 9, 14]), (r"\S+\s*", " blank first", []), (r"\X", "éa", [2, 3]), ("[ab]", "abbac", [1, 2, 3, 4]),
])
def test_units_in_stretches(stretch, unit, text, ends):
    assert infill.Units(unit, stretch).ends(text).tolist() == ends


def test_words_as_units(table):
    rows = [(k, "one two  three four five ") for k in range(30)]
    got = infill.fill_in_middle(table(rows), unit=r"\S+\s*").collect()
    assert all(r["n"] == 5 for r in got)
    assert all(r["prefix_chars"] in (0, 4, 9, 15, 20, 25) for r in got if r["form"] != "plain")


def test_a_very_long_text(table):
    text = "é\n" * 1_500_000
    row = infill.fill_in_middle(table([(3, text)])).withColumn("text", infill.restored()).collect()[0]
    assert row["n"] == len(text) and row["text"] == text
