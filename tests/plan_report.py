"""Write PLANS.md: the physical-plan shape of every registered query.

    python tests/plan_report.py [SF_DIR]

For each query: shuffles (Exchange other than broadcast), broadcasts, Python
stages (Arrow batches), windows, and the filters pushed into parquet scans.
Plans are Spark's planned physical plans (AQE may still coalesce or switch
join strategies at run time).
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def _drop_cached_subtrees(lines: list[str]) -> list[str]:
    """Cached tables print their own plan under each InMemoryRelation; that
    work ran once when the table was materialised, so leave it out."""
    out, skip_deeper = [], None
    for line in lines:
        ind = _indent(line)
        if skip_deeper is not None and ind > skip_deeper:
            continue
        skip_deeper = None
        out.append(line)
        if "InMemoryRelation" in line:
            skip_deeper = ind
    return out


def summarize(plan: str) -> dict:
    lines = _drop_cached_subtrees(plan.splitlines())
    shuffles = [l for l in lines if "Exchange" in l and "BroadcastExchange" not in l
                and "ReusedExchange" not in l]
    kinds = []
    for l in shuffles:
        m = re.search(r"Exchange (\w+)", l)
        kinds.append(m.group(1) if m else "?")
    pushed = set()
    for l in lines:
        m = re.search(r"DataFilters: \[([^\]]*)\]", l)
        if m and m.group(1):
            pushed.add(m.group(1)[:80])
    return {
        "shuffles": len(shuffles),
        "shuffle_kinds": ",".join(sorted(set(kinds))),
        "broadcasts": sum("BroadcastExchange" in l for l in lines),
        "python": sum(any(k in l for k in ("MapInPandas", "MapInArrow", "FlatMapCoGroupsIn", "ArrowEvalPython",
                                            "FlatMapGroupsIn"))
                      for l in lines),
        "windows": sum(l.strip().startswith(("Window ", "+- Window ", ":- Window "))
                       or " Window [" in l for l in lines),
        "group_limit": any("WindowGroupLimit" in l for l in lines),
        "cached_reads": sum("InMemoryTableScan" in l for l in lines),
        "pushed": "; ".join(sorted(pushed))[:160],
    }


def main() -> None:
    from riskloom.session import build_session
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[4]", 16, app_name="riskloom-plans", driver_memory="8g")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="riskloom-plans-"))
    oracles = entry.oracle_sql()
    rows = []
    for name, fn in entry.queries().items():
        df = fn(spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarize(plan)
        rows.append((name, "O" if name in oracles else "R", s))
        print(name, s, file=sys.stderr, flush=True)
    out = ["# Physical plans of the registered queries", "",
           f"Generated by `python tests/plan_report.py {sf_dir}` (planned physical plans; AQE may "
           "still coalesce partitions or turn a shuffled join into a broadcast at run time).", "",
           "Shuffles count Exchange nodes other than broadcasts (`ENSURE_REQUIREMENTS` for joins and "
           "aggregates, `REPARTITION_*` for explicit spreads); `SinglePartition` is the final step "
           "of a global aggregate over already partially aggregated rows.", "",
           "Reads of persisted tables are counted separately; the work inside them ran once.", "",
           "| query | oracle | shuffles | kinds | broadcasts | python stages | windows | top-k limit | cached reads | filters pushed to scan |",
           "| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |"]
    for name, kind, s in rows:
        out.append(f"| `{name}` | {kind} | {s['shuffles']} | {s['shuffle_kinds']} | {s['broadcasts']} | "
                   f"{s['python']} | {s['windows']} | {'yes' if s['group_limit'] else ''} | "
                   f"{s['cached_reads'] or ''} | "
                   f"{s['pushed'].replace('|', '/')} |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(out) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
