"""Every registered query of the library against its SQL, on the smallest tables that give it rows."""

import duckdb
import pytest

from quaver.registry import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
#: The smallest tables have too many gaps for a full window of any flag.
FLAGGED = "/root/testdata/sf0.01"
#: Parts and orders of what edge_tests, payout_breakeven, screen_latest and screen_shift_p_all return; only the whole is compared here.
COVERED = {"edge_symbol_rows", "edge_pooled_rows", "edge_csv_roundtrip", "edge_top15", "pooled_tests", "edge_confirmed", "payout_replicated", "payout_summary", "payout_top8", "screen_bh", "screen_flags_array", "ledger_recent", "store_scan", "vol_monitor_latest"}


def keyed(columns, rows):
    return sorted(repr(tuple(None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) else v for _, v in sorted(zip(columns, r, strict=True)))) for r in rows)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - COVERED))
def test_query(spark, name):
    con = duckdb.connect()
    d = FLAGGED if name in ("edge_tests", "edge_shift_p_all", "technical_read", "screen_shift_p_all", "payout_breakeven") else D
    for t in ("lineitem", "events", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    sql = con.sql(ORACLES[name])
    got = QUERIES[name](spark, d)
    assert keyed(got.columns, map(tuple, got.collect())) == keyed(sql.columns, sql.fetchall())
