"""Time the headline queries and print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)

Loading (base tables and derived edges, written once per application) is timed
on its own; queries then read the written tables, as reports on a loaded graph do.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tradeweave.plans.catalog import QUERIES  # noqa: E402
from tradeweave.plans.graph import open_graph  # noqa: E402
from tradeweave.session import local_session, remove_written  # noqa: E402

LOADS = ("entities", "industries", "products", "transactions", "accounts", "holdings", "trades", "partner_pairs")
HEADLINE = (
    "d1_trades_with d2_avg_interval d2_avg_interval_component d3_neighbours "
    "p1_top_pairs p2_channel_breakdown p3_monthly_trend p4_top_payees p7_active_pairs p8_high_value_edges "
    "u1_top_unbanked u2_multi_payer_targets u3_multi_payer_sample u4_unbanked_by_industry u5_top_target_network u8_value_to_unbanked "
    "e1_ecosystem_paths e2_ecosystem_size e2_ecosystem_size_hubs e3_shared_counterparties e4_sector_network e6_shortest_path "
    "x1_peer_recommendations_pct x2_peer_recommendations_all x3_segment_penetration "
    "c1_collateral_grade_all c2_concentration c3_stability_all c4_customer_profile "
    "a8_upsert_stored st1_stream_compacted "
    "r2_block_candidates r7_match_confidence r10_ranked_matches r16_hidden_partners r17_revenue_at_risk r20_evaluate_matches "
    "g1_pagerank g2_louvain g3_betweenness_pivots g4_node_similarity g4_node_similarity_hubs g7_community_summary g8_dominant_sector g11_modularities "
    "m1_account_fan_out m2_layering m2_layering_three s6_graph_counts"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    graph = open_graph(spark, folder)
    timings: dict[str, float] = {}

    def clock(name: str, action) -> None:
        start = time.time()
        action()
        timings[name] = round(time.time() - start, 3)
        print(name, timings[name], file=sys.stderr, flush=True)

    for table in LOADS:
        clock(f"load_{table}", lambda t=table: getattr(graph, t))
    for name in sys.argv[1:] or HEADLINE:
        clock(name, lambda n=name: QUERIES[n](graph).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    remove_written(spark)
    spark.stop()


if __name__ == "__main__":
    main()
