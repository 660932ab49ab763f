"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "A1_source_collapse",
    "A9_J6_P16_cells",
    "M1_headline_index",
    "U2_M19_variant_basis_preset_fan_out",
    "M3_flight_block_bootstrap",
    "P5_fare_decomposition",
    "W2_W3_log_outliers",
    "P8_dispositions",
    "Q14_contract_summary",
    "W14_hash_chain_check",
    "W8_duplicate_pointers",
    "M5_elasticity_fixed_effects",
    "M7_route_elasticity_fixed_effects",
    "M8_fare_ladder",
    "M9_M10_M11_M12_backtest",
    "M15_nowcast_bridge_full",
    "A27_store_status",
    "X1_fare_extraction",
    "T1s_stream_duplicate_suppression",
]


def main() -> None:
    from pricemill.catalog import QUERIES
    from pricemill.catalog.stage_zero import stored_quotes
    from pricemill.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    # Start-up of the JVM and of one Python worker is not part of any query.
    QUERIES["A15_geometric_mean"](spark, sf_dir).collect()
    times: dict[str, float] = {}
    # Queries on cleaned quotes read a stored table; writing it once is timed as a step of its own.
    start = time.perf_counter()
    stored_quotes(spark, sf_dir)
    times["clean_and_store_quotes"] = round(time.perf_counter() - start, 3)
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    base = os.path.basename(sf_dir.rstrip("/"))
    print(json.dumps({"metric": "headline_queries_wall", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(base[2:]) if base.startswith("sf") else base}))
    spark.stop()


if __name__ == "__main__":
    main()
