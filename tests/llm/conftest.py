import pytest

LONG = "lorem ipsum dolor " * 3000
TEXTS = [
    None, "", " \n\t ", "one", "two words", "a b c d e f g", "a b c d e f g", "A b c d e f g",
    "x" * 20_000, LONG, LONG + "end", "äö ü\x85 ß\xa0 漢字 😀", "the cat\n\nthe cat\nsat </s>[INST] ok [/INST]",
]
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score string, size string"


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, equal and repeated texts, with columns of clashing names."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 3}", None, "x", "y", "z") for i, t in enumerate(TEXTS)]
    rows.append(rows[5])
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def package(spark):
    from diffmill.llm.batches import with_package

    with_package(lambda s: None, spark)


@pytest.fixture(autouse=True)
def _with_package(package):
    pass
