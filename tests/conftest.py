from __future__ import annotations

import pytest

from barlake.session import build_session, work_root


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    session = build_session(
        "local[8]", 4, spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=warehouse, spark__sql__maxMetadataStringLength="2000",
    )
    session.sparkContext.setLogLevel("ERROR")
    work_root(session)
    yield session
    session.stop()


@pytest.fixture()
def namespace(spark, tmp_path):
    import uuid

    name = f"t_{uuid.uuid4().hex[:10]}"
    spark.sql(f"CREATE SCHEMA {name} LOCATION '{tmp_path}/{name}'")
    return name
