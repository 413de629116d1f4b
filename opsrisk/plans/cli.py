"""Command line for the two jobs (L4 train, L5 pipeline run); spark-submit friendly.

    spark-submit opsrisk/plans/cli.py train --data-path DATA --model-path M --metadata-path M.json
    spark-submit opsrisk/plans/cli.py run --data-path DATA --model-path M --output-dir OUT [--train-if-missing]

Paths may be any Hadoop file system URI. The session comes from spark-submit;
run locally, a local[*] session is built.
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

if __package__ in (None, ""):  # executed as a file by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from opsrisk.operators.models import RANDOM_FOREST_DEPTH, RANDOM_FOREST_TREES  # noqa: E402
from opsrisk.schema import DEFAULT_TEST_SIZE, RANDOM_SEED  # noqa: E402


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="opsrisk", description="Workflow risk jobs on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("train", help="validate, train, evaluate and save the model")
    t.add_argument("--data-path", required=True)
    t.add_argument("--model-path", required=True)
    t.add_argument("--metadata-path", required=True)
    t.add_argument("--test-size", type=float, default=DEFAULT_TEST_SIZE)
    t.add_argument("--seed", type=int, default=RANDOM_SEED)
    t.add_argument("--num-trees", type=int, default=RANDOM_FOREST_TREES)
    t.add_argument("--max-depth", type=int, default=RANDOM_FOREST_DEPTH)
    t.add_argument("--max-fit-rows", type=int, default=None, help="bound of the labelled rows that models are fitted on")
    r = sub.add_parser("run", help="validate, predict, and write predictions, alerts, KPIs, recommendations")
    r.add_argument("--data-path", required=True)
    r.add_argument("--model-path", required=True)
    r.add_argument("--output-dir", required=True)
    r.add_argument("--train-if-missing", action="store_true")
    r.add_argument("--num-trees", type=int, default=RANDOM_FOREST_TREES)
    p.add_argument("--master", default=None, help="only for runs outside spark-submit, e.g. local[8]")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    args = build_parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from opsrisk.session import build_session

    if spark is None:
        active = SparkSession.getActiveSession()
        spark = active or build_session(args.master or os.environ.get("OPSRISK_MASTER") or "local[*]")
    try:
        if args.command == "train":
            from opsrisk.plans.train import train_job

            res = train_job(spark, args.data_path, args.model_path, args.metadata_path, args.test_size, args.seed,
                            args.num_trees, args.max_depth, args.max_fit_rows)
            logging.info("trained: %s", res.metadata["test_metrics"]["f1_macro"])
        else:
            from opsrisk.plans.pipeline import pipeline_job

            pipeline_job(spark, args.data_path, args.model_path, args.output_dir, args.train_if_missing, args.num_trees)
    except ValueError as e:  # validation failed: the summary is in the message
        logging.error("%s", e)
        return 1
    except FileNotFoundError as e:
        logging.error("%s", e)
        return 2
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
