"""Added tokens written out in texts are encoded as the tokenizer does by default."""

import pyarrow as pa
import pytest

from lectern.llm import packing, repair, tokens, words
from lectern.llm.queries import tokenizer_path

END, START = "<|endoftext|>", "<|startoftext|>"
TEXTS = [
    f"hello {END} you", f"hello  {END}  you", END, f" {END} x", f"a\n {END}", f"{END}{END} {END}b", f"x {START}y {END[:-2]} z", f"a\n\n  {END} \n b c", f"{START}{END}", "q\n", f"tail{END[:5]}",
    f"{END[5:]} next", f"é{END}　 é", f"<{END}>", "plain words only", f"{'a b ' * 50}{END} {'c d ' * 50}",
]
FILES = [("byte_bpe_50k.json", "blanks"), ("word_bpe_49k.json", "spaces")]


def default(name, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name)).encode(text or "", add_special_tokens=False).ids


def test_ids_of_an_added_token():
    assert default("word_bpe_49k.json", TEXTS[0]) == [3306, 49407, 592]
    assert default("byte_bpe_50k.json", TEXTS[0]) == [31373, 220, 50256, 345]


@pytest.mark.parametrize("name,rule", FILES)
def test_encoder(name, rule):
    encoder = tokens.Encoder(tokenizer_path(name), rule, added_tokens=True)
    for size in (10, 10**6):
        for first, n, data, offsets in words.chunks(pa.array(TEXTS), size):
            ids, before = encoder.encode(data, offsets)
            for k in range(n):
                assert ids[before[k] : before[k + 1]].tolist() == default(name, TEXTS[first + k])


def test_shards_and_pieces(table):
    rows = list(enumerate(TEXTS))
    shards = repair.write_shards(table(rows), tokenizer_path("word_bpe_49k.json"), added_tokens=True)
    read = {r["doc_id"]: r["ids"] for r in repair.read_documents(shards, with_ids=True).collect()}
    assert read == {i: [*default("word_bpe_49k.json", t), 2] for i, t in rows}
    packed = packing.pack_documents(table(rows), tokenizer_path("byte_bpe_50k.json"), with_ids=True, added_tokens=True).collect()
    assert {r["doc_id"]: r["ids"] for r in packed} == {i: [*default("byte_bpe_50k.json", t), 2] for i, t in rows}
