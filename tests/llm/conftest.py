"""Small tables for the operators of flowlens.llm."""
import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "x", "y", "z")) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing names."""
    long_text = "\n".join(f"line {i} of a very long text with {i * i} words" for i in range(4000))
    rows = [(1, "One two three.\nfour", "en", "a", 10, "k", 1), (1, "One two three.\nfour", "en", "a", 10, "k", 1),
            (2, "", "en", "a", 0, None, 2), (3, None, None, None, None, None, None), (None, "one two three\nx 1", "de", None, 3, "q", 5),
            (None, None, None, None, None, None, None), (4, long_text, "en", "b", len(long_text), "w", 7), (5, " \n\t ", "fr", "b", 4, "", 0),
            (6, "### $$$ 12 <|endoftext|> 's \x1c é日😀", "fr", "b", 4, "", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, node int")
