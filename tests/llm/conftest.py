import pytest

CLEAN = ["the cat sat on the mat and looked at the bird outside for a while", "a dog ran over the hill towards the river to drink some cold water", "rain fell all night upon the roofs of the little town by the sea"]


@pytest.fixture()
def docs(spark):
    """make(rows): a table of documents from (doc_id, text) or (doc_id, text, lang, source), with an extra column whose
    name clashes with those of operators."""

    def make(rows):
        full = [(*r, *(("en", "s1")[len(r) - 2 :]), "x") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_words string")

    return make


#: What every operator must bear: nulls, empty and blank texts, one very long text, ties, repeated rows.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (6, " ".join(f"w{i % 997}" for i in range(60_000))), (None, "some text without an id here"), (7, "É ß 漢字 😀 A"), (8, None, None, None), (9, CLEAN[0], None, None)]


@pytest.fixture()
def odd():
    return ODD
