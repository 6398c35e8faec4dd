import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from chronoweave.session import local_session

    session = local_session(4, "3g")
    session.sparkContext.setLogLevel("ERROR")
    session.conf.set("spark.sql.shuffle.partitions", "3")
    # A handful of rows isn't worth compiling for: the tests take a third less time without.
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    return session
