import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, as extra columns of an input.
CLASH = ["digest", "keep_id", "copies", "row", "host", "cid", "root", "key", "band", "text_key", "_text", "_own", "_id", "_digest", "kept", "a", "b", "n", "features", "tie"]
WORDS = "the of and in to was with for that this from by an on at be are it is as not or but had has".split()


def passage(seed: int, n: int) -> str:
    """Words that hardly repeat between seeds."""
    return " ".join(f"{WORDS[(seed * 7 + i * i) % len(WORDS)]}{(seed * 31 + i * 17) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, ids=None, sources=None):
        ids = range(len(texts)) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def odd_texts():
    return [
        "", None, "a", " ", "\n\n x\n\nx\n", "it's  DON'T   foo bar <|endoftext|> !\x1c!", "Ünḯcode ΣΑΣ日本 語 ½ x²",
        "tab\tx\r\n\r\n y " * 9, "é  é é\n\né", "… —a\x85", "▁x ▁▁ a", "   lead", "a b c d e f g h i " * 3, "one two", "9" * 400,
        passage(1, 4000), passage(1, 60), passage(1, 60),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    """Odd texts with null and repeated ids and columns that clash with the operators' own names."""
    ids = [None, None, *range(2, len(odd_texts) - 1), len(odd_texts) - 2]
    rows = [(i, t, None, None if k % 3 else "h", None, *[None] * len(CLASH)) for k, (i, t) in enumerate(zip(ids, odd_texts, strict=True))]
    return spark.createDataFrame(rows, SCHEMA + "".join(f", {c} string" for c in CLASH))


@pytest.fixture(scope="session")
def empty(make):
    return make([])


