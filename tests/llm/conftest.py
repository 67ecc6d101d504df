import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, and extra columns with clashing names."""
    import random

    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))
    base, long = prose(60), prose(30_000)
    rows = [
        (10, base, "en", "a", 0), (3, base, "en", "a", 1), (7, base + " one more", "en", None, 2), (8, None, "en", "a", 3), (9, "", None, "b", 4),
        (11, " \t\n ", "en", "b", 5), (12, long, "en", "b", 6), (13, "too short", "de", "b", 7), (14, "too short", None, None, 8),
        (15, prose(20) + " " + base + " " + prose(20), "de", "c", 9), (16, "x" * 50_000, "en", "c", 10), (17, "12 34 ... !!", "en", "c", 11),
        (17, "12 34 ... !!", "en", "c", 11), (18, "Ärger über Öl und é", "de", "c", 12), (19, long, "en", "a", 13), (20, prose(5), "en", "d", 14),
    ]
    rows = [(*r, "clash", 1.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
