import random

import pytest

ODD = [
    None, "", " ", "\n", "\n\n\n", "one", "ONE", "two words", "\x00", "é" * 60, "a" * 49, "a" * 50, "a" * 51,
    "long " * 30_000, "'s don't  \t x", "<|endoftext|> y", "😀 中文 mixed text with some more words in it",
]


def passage(rnd, n, vocabulary=400):
    return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, shared passages and lines, odd texts; ids neither dense nor in order."""
    rnd = random.Random(11)
    shared = [passage(rnd, k) for k in (12, 20, 60)]
    line = "this line stands in many documents " + passage(rnd, 5)
    texts = list(ODD)
    for _ in range(60):
        n = rnd.choice([3, 5, 6, 9, 14, 30, 80])
        words = passage(rnd, n).split()
        for _ in range(rnd.choice([1, 1, 2, 5])):
            own = list(words)
            for _ in range(rnd.randrange(max(1, n // 12) + 1)):
                own[rnd.randrange(n)] = f"x{rnd.randrange(99)}"
            text = " ".join(own)
            if rnd.random() < 0.3:
                text += "\n" + rnd.choice(["", "  "]) + rnd.choice([line, line.upper()])
            if rnd.random() < 0.3:
                text = rnd.choice(shared) + " " + text
            texts.append(text)
    ids = rnd.sample(range(5000), len(texts))
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text), with extra columns of clashing names."""
    def table(rows, parts=3):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        from pyspark.sql import functions as F

        return df.select(
            "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"),
            F.lit(1).alias("part"), F.lit("k").alias("block"), F.lit(2).alias("h1"), F.lit(3.0).alias("score"),
            F.lit(4).alias("text_key"), F.lit(5).alias("rank")).repartition(parts)

    return table


@pytest.fixture
def doubled(rows):
    """Rows that repeat, ids that repeat with another text, null ids."""
    return rows + rows[20:30] + [(rows[40][0], "another text of the same id"), (None, rows[50][1]), (None, None)]
