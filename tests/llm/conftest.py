import random

import pytest

SYLLABLES = "an ber ca de en for ga hu is ja".split()


def sentence(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, repeats inside a text, short, empty, null and long texts."""
    r = random.Random(5)
    passage, base = sentence(r, 60), sentence(r, 300)
    out = [sentence(r, r.choice([3, 40, 150, 400])) for _ in range(60)]
    out += [base] * 4
    for k in range(20):
        words = base.split()
        words[r.randrange(300)] = f"changed{k}"
        out.append(" ".join(words))
    out += [f"{sentence(r, 20)} {passage} {sentence(r, 30)}" for _ in range(15)]
    out += [" ".join(passage.split()[:k]) for k in (34, 35, 36, 50)]
    out += [" ".join(["again"] * 90), "x " + " ".join(["again"] * 34), " ".join("a b c".split() * 40)]
    out += ["", None, "   \n\t ", "one", "One two", "été naïve — “q” 日本語   x\x0by", sentence(r, 9000), "a  b\n\n c\td\r\n  "]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    return [(i * 3 + 1, t, "en", f"src{0 if i % 3 else i % 5}", len(t or "")) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def hard(spark, rows):
    """Repeated rows and ids, null ids, and columns whose names operators use themselves."""
    extra = [rows[0], rows[0], (rows[1][0], "another text under a used id", "de", None, 1), (None, rows[2][1], None, None, None), (None, None, None, None, None)]
    clash = [(*r, "x", 1, 2.5, ["y"]) for r in rows + extra]
    return spark.createDataFrame(clash, SCHEMA + ", key string, fp int, slot double, marks array<string>")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
