"""Cleaning gives the same result however the benchmark is cut into blocks."""

import pytest

from lectern.llm import decontamination

W = [f"w{k}" for k in range(60)]
ITEMS = [(1, " ".join(W[:20])), (2, " ".join(W[12:32])), (3, " ".join(f"x{k}" for k in range(20))), (4, None), (None, " ".join(W[40:52]))]
OWN = " ".join(f"own{k}" for k in range(12))
ROWS = [
    (1, f"{OWN} {' '.join(W[:32])} {OWN} {OWN}"),  # overlapping passages of two items
    (2, f"{' '.join(W[:8])} {OWN} {OWN} {' '.join(W[12:22])}"),  # only the second stretch is a window
    (3, f"{' '.join(W[:20])} {OWN} {' '.join(f'x{k}' for k in range(20))}"),  # 40 of 52 words, of two items
    (4, f"{' '.join(W[:6])} {' '.join(f'x{k}' for k in range(20))} {' '.join(W[6:12])} {OWN} {OWN}"),  # words on both sides of a cut
    (5, None), (6, ""), (7, OWN), (8, f"{OWN} {' '.join(W[40:52])} é"), (8, OWN),
]


@pytest.mark.parametrize("block_words", [1, 60, 10**6])
def test_clean(spark, table, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(3)
    left = decontamination.clean(table(ROWS), bench, block_words=block_words)
    got = sorted((r["doc_id"], r["text"] or "") for r in left.collect())
    wanted = [(1, f"{OWN}  {OWN} {OWN}"), (2, f"{' '.join(W[:8])} {OWN} {OWN} "), (4, f"{' '.join(W[:6])}  {' '.join(W[6:12])} {OWN} {OWN}"), (5, ""), (6, ""), (7, OWN), (8, OWN), (8, f"{OWN}  é")]
    assert got == sorted(wanted) and left.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_blocks_are_built_in_tasks(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").repartition(3)
    blocks = decontamination.ItemBlocks(bench, block_words=60)
    assert len(blocks.numbers) > 1
    held = [i for k in range(len(blocks.numbers)) for i in blocks.block(k).index().item_ids]
    assert sorted(str(i) for i in held) == sorted(str(i) for i, _ in ITEMS)
