import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, token long, bucket int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + k * (seed + 3) + k * k) % len(WORDS)] + ("" if k % 9 else ".") for k in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): nulls, empties, ties, repeats, near copies, very long and odd texts."""
    base = sentence(1, 60)
    rows = [(0, None), (1, ""), (2, "   \n\t "), (3, base), (4, base), (5, base + " omega"), (6, base.replace("gamma", "GAMMA")), (7, sentence(2, 80))]
    rows += [(8, "one two"), (9, "one two"), (10, "one"), (11, "123 ... !!"), (12, "é́ naïve İstanbul 中文字 🙂 ß"), (13, "a" * 3000), (14, sentence(3, 6000))]
    rows += [(15, "line one of some length here\nline two of some length here\nline one of some lenth here"), (16, "line one of some length here\nshort\nline two of some length hexe!")]
    rows += [(17, "a<|endoftext|>b  two  spaces \n end "), (18, sentence(2, 79) + " changed"), (3, base), (None, "no identifier at all here " * 3), (-5, sentence(4, 30))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts among further columns whose names the operators use themselves."""
    rows = [(i, t, None if i in (3, 7) else "en", "s", None, 0.5, 7, 1) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
