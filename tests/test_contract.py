import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tools.check_oracle import TABLES, canon

SAMPLE = ["topk_sectors", "agg_calibration", "agg_macro_risk", "gate_insert", "join_carry_forward", "src_tx_csv", "fn_business_days"]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "market"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_sample_matches_oracle_on_the_small_tables(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())
