import pytest

from lectern.llm import words

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def table(spark):
    """Documents from (id, text) pairs, with columns whose names clash with those of results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DDL).repartition(3)

    return make


ODD = [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "x " * 30_000), (7, "Ünïcödé ñ é b\n\nfoo"), (8, "a b c d e f"), (-3, "a b c d e f g")]


@pytest.fixture
def odd(table):
    return table(ODD)


@pytest.fixture(params=[words.CHUNK_BYTES, 64])
def chunk_bytes(request, monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", request.param)
