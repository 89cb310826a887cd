import pytest

from spanledger.llm.common import see_package


@pytest.fixture(scope="session")
def sp(spark):
    return see_package(spark)
