"""Last lines that look like labels are judged by one rule in languages of any size."""

import pytest

from lexiloom.llm import truncation

DOCUMENTS = "doc_id long, text string, lang string, source string"


def told(i):
    """Whole sentences of lengths that don't heap up."""
    return " ".join(f"The baker sold {k} lamps." for k in range(1 + i * 7919 % 97))


def verdicts(spark, rows):
    return {r.doc_id for r in truncation.cut_documents(spark.createDataFrame(rows, DOCUMENTS)).collect()}


@pytest.mark.parametrize("n", [400, 2600])
def test_cut_list_items_in_languages_of_any_size(spark, n):
    rows = [(i, told(i), "en", "s") for i in range(n)]
    rows += [(10_000 + i, f"{told(9 * i)}\nTags: verbs, travel", "en", "s") for i in range(3)]
    rows += [(20_000, "Things that we need.\n- a rope of the old fer", "en", "s"), (20_001, "One.\nHe had said: come ba", "en", "s")]
    assert verdicts(spark, rows) == {20_000, 20_001}


@pytest.mark.parametrize("n", [5, 2600])
def test_labels_of_texts_without_language(spark, n):
    rows = [(i, told(i), None, "s") for i in range(n)]
    rows += [(10_000 + i, f"{told(9 * i)}\nTags: verbs, travel", "en", "s") for i in range(9)]
    rows += [(20_000, "Fine.\nTags: verbs, travel", None, "s"), (20_001, "Fine.\nTags: verbs, tra", None, "s")]
    assert verdicts(spark, rows) == {20_001}
