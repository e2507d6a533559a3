"""Headline timings; prints one JSON line.

    BENCH_SF_DIR   table folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 4)
    BENCH_QUERIES  comma-separated subset
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkclean.operators.infer import infer_rules  # noqa: E402
from sparkclean.operators.profile import profile_table  # noqa: E402
from sparkclean.plans.plan import make_plan  # noqa: E402
from sparkclean.plans.versions import VersionStore  # noqa: E402
from sparkclean.queries import QUERIES, views  # noqa: E402
from sparkclean.session import build_session, scratch_dir  # noqa: E402
from sparkclean.sources.ingest import read_csv  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "4"))


def drain(df) -> None:
    """Run a query in full without bringing its rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def end_to_end(spark) -> dict[str, float]:
    """The whole loop on dirty text: ingest, profile and infer, plan, execute and verify, export."""
    times: dict[str, float] = {}

    @contextlib.contextmanager
    def timed(name):
        start = time.time()
        yield
        times[f"loop_{name}"] = round(time.time() - start, 3)

    root = scratch_dir(spark, "bench")
    messy = views.messy_orders(spark, SF).drop("_rid")
    messy.repartition(CPUS).write.option("header", True).option("escape", '"').csv(f"{root}/dirty.csv")
    with timed("ingest"):
        table = read_csv(spark, f"{root}/dirty.csv", f"{root}/ingest").table
    with timed("profile_infer"):
        profile = profile_table(table)
        rules = infer_rules(table, profile)
    with timed("plan"):
        plan = make_plan(table, profile, rules)
    for s in plan.steps:
        if s.decision == "pending":
            plan.decide(s.step_no, "accepted" if s.operation != "fill_missing" else "rejected")
    plan.approve()
    store = VersionStore(spark, f"{root}/versions")
    with timed("execute_verify"):
        store.execute(plan, table)
        passed = store.verify(plan, profile).passed
    if not passed:  # the gate would refuse the export
        print("bench: verification failed, no export was timed", file=sys.stderr)
        times["loop_verified"] = 0.0
        return times
    with timed("export_csv"):
        store.export(f"{root}/export")
    return times


QUICK = [
    "profile_lineitem", "profile_orders", "profile_documents", "rule_arithmetic_candidates", "entity_groups",
    "op_replace_value", "op_fill_missing", "op_cast_float", "op_standardise_iso_date", "op_deduplicate",
    "op_deduplicate_rows", "op_derive_multiply", "op_expand_child", "loss_per_step", "inverse_cast_type",
    "quality_checks", "recon_sums", "guard_instruction_documents", "guard_instruction_pages", "guard_pii",
    "guard_formula", "events_latest_per_key", "events_top_export", "score_detection", "sheet_verdicts", "stream_clean",
]


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(CPUS),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    for name in ("profile_customer", "op_replace_value"):  # start the executors' threads, compile what all queries share
        if name in QUERIES:
            drain(QUERIES[name][0](spark, SF))
    times: dict[str, float] = {}
    for name in wanted or QUICK:
        if name == "loop" or name not in QUERIES:
            continue
        start = time.time()
        drain(QUERIES[name][0](spark, SF))
        times[name] = round(time.time() - start, 3)
    if not wanted or "loop" in wanted:
        times.update(end_to_end(spark))
    scale = re.search(r"sf([0-9.]+)", SF)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1)) if scale else SF, "cpus": CPUS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
