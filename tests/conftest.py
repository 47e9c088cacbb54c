import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from loomline.session import get_spark

    s = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__showConsoleProgress="false")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a DataFrame as tuples."""

    def get(df, *cols):
        out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
        return sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))

    return get
