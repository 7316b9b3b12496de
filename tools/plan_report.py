"""Write PLANS.md: the physical plan shape of every registered query.

For each query: the operator tree (node names, exchange partitioning,
broadcasts, Python nodes, scan read schema and pushed filters) and counts of
shuffles / broadcasts / Python stages. Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from codepref.plans.catalog import QUERIES, load_all  # noqa: E402
from codepref.session import local_session  # noqa: E402

KEEP = ("Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
        "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "ArrowEvalPython",
        "MapInPandas", "BatchEvalPython", "Generate", "Union", "Scan", "Expand", "Sort", "FileScan",
        "InMemoryTableScan", "TakeOrderedAndProject", "CollectLimit", "AdaptiveSparkPlan")


def shape(plan: str) -> list[str]:
    out = []
    for line in plan.split("\n"):
        line = re.sub(r"\*\(\d+\) ", "", line)
        m = re.match(r"^([\s:+\-*|]*)(\w+)(.*)$", line)
        if not m:
            continue
        indent, node, rest = m.groups()
        if not any(node.startswith(k) for k in KEEP):
            continue
        rest = re.sub(r"#\d+L?", "", rest)
        detail = ""
        if node.startswith("Exchange"):
            detail = " " + (re.search(r"(hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition|RoundRobinPartitioning\(\d+\))", rest) or [""])[0]
        elif "Scan" in node:
            rs = re.search(r"ReadSchema: (struct<[^>]*>)", rest)
            pf = re.search(r"PushedFilters: (\[[^\]]*\])", rest)
            detail = (" " + rs.group(1)[:120] if rs else "") + (" pushed=" + pf.group(1)[:120] if pf else "")
        elif node.startswith("Window"):
            part = re.search(r"\], \[([^\]]*)\], \[", rest)
            detail = " partitionBy=[" + (part.group(1)[:80] if part else "") + "]"
        out.append(f"{indent}{node}{detail}")
    return out


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    spark = local_session()
    lines = ["# PLANS: physical plan shapes", "",
             f"Generated by `tools/plan_report.py` at `{sf}` (AQE initial plans; runtime may turn "
             "shuffle joins of small sides into broadcasts). Per query: shuffles (Exchange), "
             "broadcasts, Python stages, then the operator tree.", ""]
    summary, sections = [], []
    for name in sorted(QUERIES):
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        tree = shape(plan)
        n_ex = sum(1 for t in tree if t.strip(" :+-*|").startswith("Exchange"))
        n_bc = sum(1 for t in tree if "BroadcastExchange" in t)
        n_py = sum(1 for t in tree if "ArrowEvalPython" in t or "MapInPandas" in t)
        summary.append(f"| `{name}` | {n_ex} | {n_bc} | {n_py} |")
        sections += [f"## {name}", "", f"shuffles={n_ex} broadcasts={n_bc} python_stages={n_py}", "",
                     "```", *tree, "```", ""]
    lines += ["Counts are plan nodes; an exchange that appears under two union branches is",
              "reused at runtime.", "", "| Query | shuffles | broadcasts | Python stages |",
              "|---|---|---|---|", *summary, "", *sections]
    open(__file__.rsplit("/tools/", 1)[0] + "/PLANS.md", "w").write("\n".join(lines))


if __name__ == "__main__":
    main()
