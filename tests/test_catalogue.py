"""Every registered query against its SQL twin at the smallest scale; those without one must give rows."""

import pytest
from compare import connect, differences
from conftest import SF

from lexiflow.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, name):
    if name in catalogue.ORACLES:
        assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF, con) == ""
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_novelty_covers_every_document_with_words(spark, con):
    want = {r[0] for r in con.sql("select doc_id from documents where regexp_matches(text, '[A-Za-zÀ-ÖØ-öø-ÿ0-9]')").fetchall()}
    import __spark_entry__

    assert {r.doc_id for r in __spark_entry__.entry(spark).collect()} == want
    assert {r.doc_id for r in catalogue.QUERIES["novelty_score"](spark, SF).select("doc_id").distinct().collect()} == want


def test_pair_unmatched_takes_all_orders(spark, con):
    """Each customer pairs as many orders as the smaller of both sides has."""
    want = con.sql("select sum(least(a, b)) from (select count(*) filter (o_orderkey % 2 = 0) as a, count(*) filter (o_orderkey % 2 <> 0) as b from orders group by o_custkey)").fetchall()[0][0]
    rows = catalogue.QUERIES["pair_unmatched"](spark, SF).collect()
    assert len(rows) == want == len({r.before_key for r in rows}) == len({r.after_key for r in rows})
    assert all(r.before_key % 2 == 0 and r.after_key % 2 == 1 for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
