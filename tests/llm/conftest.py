import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with names the operators use themselves."""
    base = " ".join(f"w{i % 97}x{i}" for i in range(60))
    near = base.replace("w3x3 ", "changed ")
    rows = [(0, base), (1, base), (2, near), (3, None), (4, ""), (5, "  \n\t"), (6, "one two"), (7, "One TWO"), (8, base + "\n" + base), (9, "la " * 3000), (9, "la " * 3000), (10, "ünïcode 漢字 a b \x1e x"), (None, base)]
    return spark.createDataFrame([(i, t, "en", "s" if i is None or i % 2 else None, len(t or ""), 1, 2, "k") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n int, id int, key string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
