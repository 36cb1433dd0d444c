import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from graphdrift.plans import scoring

SF = "/root/testdata/sf0.001"
SAMPLE = ["p3_found", "p4_module_totals", "fn_package_name", "q_sampled_meta", "g_degrees", "sc_drift", "st_state_as_of", "rp_overview_edges", "gr_blast_all", "inc_stream_batch"]


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert {f"p{n}_" for n in (3, 4)} <= {q[:3] for q in queries}
    if os.path.isdir(SF):
        assert entry.entry(spark).columns == ["repo_id", "commit_hash", "from_module", "to_module", "change_kind"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for p in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    show = lambda v: f"{v:.7g}" if isinstance(v, float) else repr(v)
    want = sorted(tuple(show(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(tuple(show(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_chains_are_those_of_the_report_and_need_no_other_section(spark):
    alone = entry.queries()["rp_analyze_chains"](spark, SF)
    assert "RDD" not in alone._jdf.queryExecution().optimizedPlan().toString()  # nothing was checkpointed for it
    whole = scoring._report(spark, SF).where("section = 'chains'")
    rows = sorted(alone.collect())
    assert rows and rows == sorted(whole.collect()) and alone.columns == whole.columns
