import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stayspark.plans.build import derived  # noqa: E402
from stayspark.session import local_session  # noqa: E402
from stayspark.sources.tables import all_tables  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        cores="4",
        app="stayspark-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    """The 250-booking data set, held in memory for the whole run."""
    built = {name: table.cache() for name, table in derived(all_tables(spark)).items()}
    yield built
