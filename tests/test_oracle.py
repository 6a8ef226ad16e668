"""Every registered query against its SQL on the small scale factor."""

import oracle
import pytest

from quire import plans


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, sf_dir, plans.QUERIES[name], plans.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_names_are_operator_ids():
    ids = {n.split("_")[0] for n in plans.QUERIES}
    wanted = (
        [f"s{i}" for i in range(1, 15)] + [f"v{i}" for i in range(1, 18)] + [f"p{i}" for i in range(1, 26)]
        + [f"r{i}" for i in range(1, 27)] + [f"t{i}" for i in range(1, 20)] + [f"h{i}" for i in range(1, 15)]
        + [f"j{i}" for i in range(1, 14)] + [f"u{i}" for i in range(1, 5)]
    )
    assert [w for w in wanted if w not in ids] == []
