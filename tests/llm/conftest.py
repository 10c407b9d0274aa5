import pytest


@pytest.fixture(autouse=True)
def shipped(spark):
    from mailmetrics.llm.common import prepare

    prepare(spark)
