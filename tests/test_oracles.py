"""Every query of the catalog against its SQL."""

import oracle
import pytest

from lakestrata.plans import catalog, upkeep  # noqa: F401, the second adds its queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert oracle.difference(df, catalog.ORACLES[name], SF) == ""
    else:
        assert df.count() > 0
