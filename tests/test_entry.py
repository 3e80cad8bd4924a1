import duckdb
import pytest

import __spark_entry__ as entry
from textorigin.catalog import registry

SF = "/root/testdata/sf0.001"
FAST = ["clean_documents", "features_burstiness", "features_structure", "rewritings", "removal_reasons", "split_70_10_20", "value_counts", "category_rules",
        "detector_metrics", "calibration_bins", "choose_thresholds", "transition_own", "event_profiles", "column_audit", "external_rows", "stream_monitor",
        "audit_report", "bootstrap_sizes", "corpus_from_folder", "file_discovery", "sample_per_file"]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert sum(len(m.QUERIES) for m in registry.MODULES) == len(registry.queries()) and set(registry.queries()) <= set(queries) and set(oracles) <= set(queries)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() == 200 and "burst_type_token_ratio" in df.columns


@pytest.mark.parametrize("name", FAST)
def test_query_equals_duckdb(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "labels", "events", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    show = lambda rows: sorted(map(repr, rows))
    got = show(tuple(r[c] for c in sorted(names)) for r in df.collect())
    want = show(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())
    assert got == want
