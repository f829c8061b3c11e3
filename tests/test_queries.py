"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from cadenza import plans

SF = "/root/testdata/sf0.001"
CHECKED = sorted(plans.oracle_sql())
OTHERS = sorted(set(plans.queries()) - set(CHECKED))


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    found = duck.execute(plans.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", OTHERS)
def test_query_runs(spark, name):
    assert plans.queries()[name](spark, SF).count() > 0


def test_inputs_are_the_tables():
    assert len(plans.queries()) > 100 and len(CHECKED) > 0.9 * len(plans.queries())


def partners(duck):
    """Ordered pairs of mixable tracks of a band that share a tempo, both with a series."""
    return duck.execute(plans.oracle_sql()["r07_compatible_counts"].replace("SELECT a.band, a.id, count(*) AS partners", "SELECT a.id, count(*) AS partners")).fetchall()


@pytest.mark.parametrize("name", ["r02_bpm_score", "r03_energy_continuity", "r04_match_pairs"])
def test_pair_queries_tell_every_pair(spark, duck, name):
    every = sum(n for _, n in partners(duck))
    assert plans.queries()[name](spark, SF).count() == every == duck.execute(f"SELECT count(*) FROM ({plans.oracle_sql()[name]})").fetchone()[0]
