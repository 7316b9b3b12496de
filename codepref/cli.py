"""Command-line jobs (``python -m codepref <job>`` or
``PYTHONPATH=. spark-submit codepref/__main__.py <job>``):
the reference's scripts as Spark applications over parquet / JSON paths.

    filter-seed   raw seed -> unified, filtered, split seed table
    kto / dpo     base table (seed + raw ``prediction``) -> preference rows
    sanitize      predictions JSON Lines -> sanitised JSON Lines for a scorer
    score         results table (task_id, passed) -> pass@k per task and mean

The session comes from the environment (cluster settings, shared
``spark.checkpoint.dir``); datasets are written partitioned by
(language, split) under ``<root>/<name>/revision=<revision>``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codepref.operators.evaluate import pass_at_k, pass_at_k_mean, valid_rate
from codepref.operators.filters import filter_seed, funnel
from codepref.operators.normalize import normalize_seed
from codepref.operators.preference import build_dpo, build_kto
from codepref.operators.sampling import assign_split, materialize
from codepref.operators.sanitize import sanitize
from codepref.sources.tables import read_dataset, write_dataset, write_predictions_jsonl


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codepref", description=__doc__.split("\n\n")[0])
    sub = p.add_subparsers(dest="cmd", required=True)

    f = sub.add_parser("filter-seed", help="normalise, filter and split a raw seed table")
    f.add_argument("--input", required=True, help="parquet: row_id, language, func_name, "
                   "func_documentation_string, func_code_string[, problem, solution]")
    f.add_argument("--output", required=True, help="dataset root")
    f.add_argument("--name", default="filtered_seed")
    f.add_argument("--revision", default="main")
    f.add_argument("--languages", nargs="+", default=["java", "python", "kotlin"])
    f.add_argument("--exact-split", action="store_true")
    f.add_argument("--seed", type=int, default=0)
    f.add_argument("--compat", action="store_true", help="the reference's literal filter quirks")
    f.add_argument("--comment-ratio", action="store_true", help="also ask for 0.1 < comments / code lines < 1")

    for name, default_f in (("kto", 0.5), ("dpo", 1.0)):
        b = sub.add_parser(name, help=f"build {name.upper()} rows from a base table")
        b.add_argument("--input", required=True, help="dataset root holding the base table")
        b.add_argument("--base-name", required=True)
        b.add_argument("--output", required=True)
        b.add_argument("--name", default=name)
        b.add_argument("--revision", default="main")
        b.add_argument("--language", default=None, help="one language (default: all)")
        b.add_argument("--not-compile", type=float, default=default_f)
        b.add_argument("--seed", type=int, default=0)
        b.add_argument("--compat", action="store_true")
        b.add_argument("--recheck", action="store_true", help="drop corruptions that still compile")

    s = sub.add_parser("sanitize", help="extract completions from raw predictions")
    s.add_argument("--input", required=True, help="JSON Lines: task_id, language, prompt, completion")
    s.add_argument("--output", required=True)

    r = sub.add_parser("score", help="pass@k from a results table")
    r.add_argument("--input", required=True, help="parquet or JSON Lines: task_id, passed[, ...]")
    r.add_argument("--format", choices=["parquet", "json"], default="parquet")
    r.add_argument("--k", type=int, nargs="+", default=[1, 10])
    r.add_argument("--output", default=None, help="write per-task pass@k here (parquet)")
    return p


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    """Run one job; returns a small summary (counts), also printed."""
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"codepref-{args.cmd}").getOrCreate()
    summary: dict = {"cmd": args.cmd}

    if args.cmd == "filter-seed":
        # written once: the funnel and the filters both read it, the AST pass runs once
        seed = materialize(normalize_seed(spark.read.parquet(args.input), languages=args.languages))
        summary["funnel"] = [r.asDict() for r in funnel(seed, args.compat).collect()]
        filtered = filter_seed(seed, compat=args.compat, with_comment_ratio=args.comment_ratio)
        if args.exact_split:  # counts and the split both read it: run the checkers once
            filtered = materialize(filtered)
        kept = assign_split(filtered, key="row_id", seed=args.seed,
                            exact=args.exact_split, groups=["language"] if args.exact_split else ())
        summary["path"] = write_dataset(kept, args.output, args.name, args.revision)

    elif args.cmd in ("kto", "dpo"):
        base = read_dataset(spark, args.input, args.base_name, language=args.language)
        build = build_kto if args.cmd == "kto" else build_dpo
        rows = build(base, not_compile=args.not_compile, groups=["language", "split"], seed=args.seed,
                     compat=args.compat, recheck=args.recheck)
        summary["path"] = write_dataset(rows, args.output, args.name, args.revision)

    elif args.cmd == "sanitize":
        preds = spark.read.json(args.input)
        out = sanitize(preds, prediction="completion", prompt="prompt")
        summary["valid"] = [r.asDict() for r in valid_rate(out).collect()]
        summary["path"] = write_predictions_jsonl(out, args.output)

    elif args.cmd == "score":
        reader = spark.read.parquet if args.format == "parquet" else spark.read.json
        per_task = pass_at_k(reader(args.input).withColumn("passed", F.col("passed").cast("boolean")),
                             tuple(args.k))
        if args.output:
            per_task.write.mode("overwrite").parquet(args.output)
        summary["pass_at_k"] = pass_at_k_mean(per_task, tuple(args.k)).first().asDict()

    print(summary)
    return summary


def main() -> None:
    run()
