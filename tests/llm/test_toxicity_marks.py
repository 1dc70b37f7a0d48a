"""A document's only insult counts whatever mark stands before it."""

import pyarrow as pa
import pytest


@pytest.mark.parametrize("text", ["a “idiot” here", "a «idiot» here", "¡idiot!", "well—idiot", "well idiot", "“Ⅷ”…idiot", "“idiot", "_wretch here", "well _wretch", "“_wretch"])
def test_insult_behind_a_mark(text):
    from tessera.llm.toxicity import Model, document_features, prepared

    model = Model({"idiot": 3.0, "_wretch": 3.0})
    texts = ["nothing at all é", text, "", None, text.upper(), "é"]
    rows = list(prepared(pa.array(texts, pa.large_string()), model))
    for low, hits, words in rows:
        assert (document_features(low, hits, words, model) == document_features(low, 1, words, model)).all()
    assert [bool(document_features(*r, model).any()) for r in rows] == [False, True, False, False, True, False]
