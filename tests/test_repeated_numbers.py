"""Receipt numbers keep six digits of the order key, so many orders repeat them; queries must still match their SQL."""

import os

import duckdb
import pytest

from asofia.plans import catalog
from tools.parity import TABLES, rows

SF = "/root/testdata/sf0.001"
NAMES = [
    "amendment_parents",
    "consolidated_chains",
    "legal_event_chain",
    "family_completeness",
    "resolution_integration",
    "ledger_quality_gate",
    "official_fact_reconciliation",
    "rule_driven_audit",
    "group_review",
]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Every order five times, its key shifted by a million; some copies are of another customer."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    con = duckdb.connect()
    for t in TABLES:
        if t != "orders":
            os.symlink(f"{SF}/{t}.parquet", f"{folder}/{t}.parquet")
    con.execute(f"""COPY (SELECT t.* REPLACE (CAST(o_orderkey+i*1000000 AS BIGINT) AS o_orderkey, CAST(o_custkey+(i//2)*(1+o_orderkey%3) AS BIGINT) AS o_custkey)
        FROM range(5) r(i), '{SF}/orders.parquet' t) TO '{folder}/orders.parquet' (FORMAT parquet)""")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_repeated_numbers(spark, repeated, name):
    folder, con = repeated
    q = catalog()[name]
    df = q.build(spark, folder)
    cur = con.execute(q.sql)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([c[0] for c in cur.description], cur.fetchall())
