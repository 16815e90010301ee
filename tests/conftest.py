import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lacuna.session import local_session

    return local_session("4", "lacuna-tests")


@pytest.fixture(scope="session")
def sf_small():
    if not pathlib.Path(SF_SMALL).exists():
        pytest.skip("shared test tables are not available")
    return SF_SMALL
