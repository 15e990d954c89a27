"""Registered queries against their SQL twins. BLOCKLENS_ALL=1 runs every one of them."""

import datetime
import glob
import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
QUICK = ["q_exact", "q_boundary_positions", "q_fuzzy_ratio", "q_fuzzy_tokens", "q_hit_order", "d_grid",
         "l_reading_order", "l_lines_tight", "l_prompt", "f_label_value", "f_dynamic", "v_summary", "o_pick", "o_merge",
         "c_errors", "c_numbered", "c_checks_parse", "c_reply_parse", "t_labels", "t_normalise", "q_token_set", "v_checks", "d_greedy", "q_batch",
         "q_score_lines", "q_best_block", "o_polygons", "t_casts", "c_deferred", "f_align"]
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def keys():
    import __spark_entry__ as e
    return list(e.oracle_sql()) if os.environ.get("BLOCKLENS_ALL") else QUICK


def plain(v):
    return repr(v) if isinstance(v, float) else v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", keys())
def test_same_rows(spark, name):
    import __spark_entry__ as e
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    d = e.queries()[name](spark, SF)
    cols = sorted(d.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in d.collect())
    r = con.sql(e.oracle_sql()[name])
    have = [c[0] for c in r.description]
    assert sorted(have) == cols
    want = Counter(tuple(plain(x[have.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want
