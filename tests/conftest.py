import pytest


@pytest.fixture(scope="session")
def spark():
    from veilspark.session import session

    spark = session("tests", cores=4, shuffle_partitions=4)
    yield spark
