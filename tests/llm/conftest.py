import random

import pytest

#: Columns that operators use inside; they must not be disturbed by such names in a table.
CLASHING = "id row digest fp h k at n key label score length bucket keep_id kept component_id sequence_id offset words hashes token base_failed doc ord found".split()
SPEC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{min(int(rng.paretovariate(0.6)), vocabulary)}{rng.choice(['', '', '.', ','])}" for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with nulls, empty and long texts, copies, near copies, shared passages and repeated rows."""
    passage = prose(999, 80)
    rows = [(i, prose(i, 60 + 3 * i), "en", f"src{i % 3}", 1) for i in range(40)]
    rows += [(100, rows[3][1], "en", "src0", 1), (101, rows[3][1], None, None, None), (102, rows[5][1].replace("w1 ", "zz ", 1), "de", "src1", 1)]
    rows += [(110 + i, f"{prose(500 + i, 70)} {passage} {prose(600 + i, 70)}", "fr", "src2", 1) for i in range(4)]
    rows += [(120, "same line here to be seen\n" * 30, "en", "src0", 1), (121, "same line here to be seen\nother one that is short\n", "en", "src0", 1)]
    rows += [(130, None, "en", "src0", 1), (131, "", "en", "src0", 1), (132, " \n\t ", "en", "src0", 1), (133, "one", "en", "src0", 1), (134, "é ▁ <|endoftext|>  x\n", "en", "src0", 1)]
    rows += [(140, prose(77, 30_000), "en", "src0", 1), (141, "x" * 200_000, "en", "src0", 1), (142, "ab " * 20_000, "en", "src0", 1)]
    rows += [(None, prose(88, 100), None, None, None), (None, None, None, None, None), (150, rows[7][1], "en", "src1", 1), (150, rows[7][1], "en", "src1", 1)]
    return spark.createDataFrame(rows, SPEC).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
