import random

import pyarrow.dataset as ds
import pytest

#: An id with two texts, rows repeated as a whole, null ids, null, blank, odd and long texts.
ODD = [
    (5001, None), (5002, ""), (5003, " \n\t "), (5004, "one two"), (5005, "One TWO"), (None, "one two"), (None, None), (5004, "one two"), (5004, "another text of the same id"),
    (5006, "x" * 30000), (5007, "x" * 29000), (5008, "ab " * 5000), (5009, "é漢字😀 " * 300), (5010, "a\x00b\x1cc <|endoftext|> ### | %%%"), (5011, "1 2 " * 4000),
]


@pytest.fixture(scope="session")
def rows(small):
    """The smallest documents, odd rows, and random overlaps of one text."""
    t = ds.dataset(f"{small}/documents.parquet").to_table(columns=["doc_id", "text"]).to_pylist()
    r = random.Random(5)
    base = [r.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) for _ in range(300)]
    made = []
    for i in range(60):
        at = r.randrange(250)
        made.append((6000 + i, " ".join(base[at : at + r.randint(1, 120)] + [r.choice("pqr")] * r.randint(0, 30))))
    return [(x["doc_id"], x["text"]) for x in t] + ODD + made


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """A table whose other columns have the names that operators use."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    clash = [(i, t, None, "s", 0, True, 1, "k", 2) for i, t in rows]
    df = spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row_id long, block string, group_size long")
    df.repartition(4).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(docs, spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    docs.limit(0).write.parquet(path)
    return spark.read.schema(docs.schema).parquet(path)


@pytest.fixture(scope="session")
def ordered():
    return lambda got: sorted((tuple(r) for r in got), key=str)
