import pytest
from pyspark.sql import Row

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(n, seed=0, step=7):
    """n words that repeat late, with a full stop after each ninth."""
    return " ".join(f"{WORDS[(seed * 13 + i * i * step + i) % 20]}{(seed * 31 + i * step) % 97}" + ("." if i % 9 == 8 else "") for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls everywhere, empty, tiny and very long texts, equal rows, and columns named like the operators' own."""
    long = prose(60_000, 5)
    texts = [None, "", " \n\t ", "one", prose(80, 1), prose(80, 1), prose(80, 2) + "\n" + prose(80, 1), long, long, "Ünïcödé wörds ärè hére " * 30, "\n\n\n", "a  b\tc\x00d"]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, None if i == 3 else len(t or ""), 1, "x", 0.5, 7, "k", -1) for i, t in enumerate(texts)]
    rows += [rows[4], (None, prose(70, 3), "de", "src1", 5, 1, "x", 0.5, 7, "k", -1), (None, None, None, None, None, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, score double, n_words long, block string, epoch int"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)


@pytest.fixture(scope="session")
def some_docs(spark):
    """Sixty documents: near and exact copies, shared passages, and repeated words."""
    base = [prose(60 + 3 * i, i) for i in range(30)]
    rows = []
    for i, t in enumerate(base):
        rows.append(Row(doc_id=2 * i, text=t, lang="en", source=f"src{i % 3}", n_chars=len(t)))
        words = t.split(" ")
        if i % 3 == 0:
            words[10] = "changed"
        if i % 3 == 1:
            words = words[:30] + base[0].split(" ")[5:60] + words[30:]
        if i % 7 == 2:
            words = ["same"] * 70
        t = " ".join(words)
        rows.append(Row(doc_id=2 * i + 1, text=t, lang="en", source="src9", n_chars=len(t)))
    return spark.createDataFrame(rows).repartition(4)
