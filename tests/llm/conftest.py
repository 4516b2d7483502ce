import pytest

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def smoke(spark):
    """The documents of the smallest folder as rows."""
    return spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return SMOKE
