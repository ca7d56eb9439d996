import pytest


@pytest.fixture(scope="session")
def nasty():
    """Texts no operator may stumble over."""
    return [None, "", "   \n\t\n ", "word", "two words", "🙂 \x00   �", "x" * 300_000, "long text here " * 30_000, "|" * 5_000, " " * 100_000, "\n" * 50_000, "a|b" * 20_000]
