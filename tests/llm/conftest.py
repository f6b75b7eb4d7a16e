import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, kept boolean, row string, score double, _kept string"


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text, lang) tuples to documents with further columns whose names operators also use."""

    def make(rows):
        return spark.createDataFrame([(d, t, g, None if d is None else f"src{d % 3}", None if t is None else len(t), 7, True, "x", 0.5, "y") for d, t, g in ((*r, None)[:3] for r in rows)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def edges():
    """Nulls, empty and very long texts, ties and repeated rows."""
    words = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()
    long = " ".join(words[(i * i) % 12] + str(i % 977) for i in range(30_000))
    return [(None, "no id here at all", "en"), (1, None, None), (2, "", "de"), (3, "", None), (4, "   \n\t ", "fr"), (5, long, "en"), (6, "same text twice", "en"), (6, "same text twice", "en"), (7, "same  text twice", None), (8, "日本語 é ß ́ \U0001f600", "und"), (9, "<|endoftext|> \x00 bell \x07", "en")]
