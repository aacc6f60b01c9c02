import pytest


@pytest.fixture(scope="session")
def documents():
    """Rows of the smallest fixture's documents."""
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()
