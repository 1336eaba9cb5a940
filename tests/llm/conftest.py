import pytest

SF = "/root/testdata/sf0.001"
EDGES = "doc_id long, text string, lang string, source string, n_chars long, kept string, n long, digest string, score string, shard string, component_id string, row string, size string"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and columns whose names clash."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    texts = [(1, None), (2, ""), (3, "  \n "), (4, base), (5, base.upper()), (6, base), (6, base), (None, base), (None, "only here once"), (7, base + " omega"), (8, "ab " * 60_000), (9, "x" * 200_000), (10, "é à ü  z\t\n"), (11, "one two"), (12, "One two"), (13, "ßẞİ"), (13, None)]
    return spark.createDataFrame([(i, t, *[None] * 11) for i, t in texts], EDGES).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], EDGES)
