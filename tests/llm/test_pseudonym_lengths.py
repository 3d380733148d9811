"""Valid values ahead of text that looks like a part of them."""

import pytest

from lectern.llm import pseudonyms

KEY = b"test key"
CARD, IBAN = "4111 1111 1111 1111", "BE68539007547034"


@pytest.mark.parametrize(
    "text,values",
    [
        (f"pay {CARD} 12/25", [("card", CARD)]), (f"pay {CARD} 123", [("card", CARD)]), (f"to {IBAN} BANK", [("iban", IBAN)]),
        (f"{IBAN} 2024-02-29", [("iban", IBAN), ("date", "2024-02-29")]), (f"XX12 {CARD}", [("card", CARD)]), (f"12 {CARD}", [("card", CARD)]),
        ("bad 4111 1111 1111 1112", []), ("BE68 5390 0754 7035 X", []),
    ],
)
def test_values_are_found(text, values):
    new, spans = pseudonyms.pseudonymise(text, KEY)
    assert [(k, text[a:b]) for k, a, b in spans] == values
    assert len(new) == len(text) and all(v not in new for _, v in values)
    assert pseudonyms.pseudonymise(new, KEY, inverse=True, known=spans)[0] == text


def test_spans_undo_every_pseudonym(table):
    rows = [(i, f"{CARD} {100 + i} and {IBAN} B{i:03d}") for i in range(200)]
    made = pseudonyms.pseudonymise_documents(table(rows), KEY)
    assert made.where("text like '4111 1111%' or n_found < 2").count() == 0
    back = pseudonyms.pseudonymise_documents(made, KEY, inverse=True)
    assert back.columns == made.columns and sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows
