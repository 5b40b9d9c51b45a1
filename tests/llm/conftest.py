import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet consetetur " * 4000
ODD = [
    (1, None, "en", "a", 0), (2, "", None, None, 0), (3, LONG, "en", "a", len(LONG)), (4, LONG, "en", "b", len(LONG)),
    (5, "one two three four five six", "en", "a", 27), (5, "one two three four five six", "en", "a", 27),
    (None, "One Two three FOUR five six", "en", None, 27), (7, " \t\n ", "en", "b", 4), (8, "…", "fr", "c", 1),
]


@pytest.fixture
def odd(rows):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    return rows(DOCS, [*ODD, (9, "x y", None, None, None)])


@pytest.fixture
def empty(rows):
    return rows(DOCS, [])


@pytest.fixture
def clashing(rows):
    """Columns whose names the operators use for themselves."""
    names = "digest keep_id group_size size taken target draws class keys bits chunk part start length ids offset lang_pred score hits edits_ n_tokens".split()
    data = [(i, f"words of text number {i} and some more words here", "en", "s", 10, *(["z"] * len(names))) for i in range(6)]
    return rows(DOCS + "".join(f", {n} string" for n in names), data)
