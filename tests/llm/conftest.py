import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(n, seed=0):
    """n words of a fixed sequence that doesn't repeat for long."""
    return [f"{WORDS[(i * 7 + seed * 3 + i * i) % 20]}{(i * 31 + seed * 101) % 997}" for i in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and blank texts, null and repeated ids, copies, near copies, a long text, clashing column names."""
    base, long = words(200), words(30_000, 5)
    near = base[:100] + ["changed"] + base[101:]
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, ""), (5, None), (6, " \t\n"), (7, "one two"), (8, "ONE  two"),
        (9, " ".join(long)), (10, " ".join(words(60, 9) + base[40:110] + words(60, 8))), (None, " ".join(base)), (None, None), (11, "x y z"), (11, "x y z"), (11, "u v w x y"), (12, " ".join(words(80, 3)).upper()),
    ]
    return spark.createDataFrame([(i, t, "en", "s", 0, "a", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, key long, size long")
