"""Command line: one subcommand per job, e.g. with spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from hitlens.operators.runlog import now_text
from hitlens.plans import detect, extract, profile, site
from hitlens.session import size_shuffles, temporary_work, use_utc

# Stored tables are compressed and dictionary-encoded; rows in a shuffle are not.
STORED_EXPANSION = 6.0


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="hitlens")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, *paths: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for path in paths:
            sub.add_argument(f"--{path}", required=True)
        return sub

    def mode(sub: argparse.ArgumentParser) -> argparse.ArgumentParser:
        sub.add_argument("--mode", choices=["error", "append", "overwrite"], default="error")
        return sub

    extracting = mode(job("extract", "logs", "output", "metadata", "report"))
    extracting.add_argument("--domains", nargs="+", required=True)
    job("train", "extracted", "metadata", "output", "report").add_argument(
        "--run-id", default=now_text()
    )
    predicting = mode(job("predict", "extracted", "output", "report"))
    predicting.add_argument("--metadata", help="folder of the category models, with --classifier")
    models = predicting.add_mutually_exclusive_group(required=True)
    models.add_argument("--classifier")
    models.add_argument("--pipeline", help="stored pipeline, instead of --classifier and --metadata")
    predicting.add_argument("--threshold", type=float)
    mode(job("merge", "extracted", "predicted", "output", "report"))
    detecting = job("detect", "ground-truth", "output", "model", "report")
    detecting.add_argument("--sites", nargs="*")
    detecting.add_argument("--detector", choices=["final", "first"], default="final")
    detecting.add_argument("--use-model", action="store_true", help="apply the forests stored under --model")
    detecting.add_argument("--listing", help="folder for the highest anomalies of each site")
    detecting.add_argument("--top", type=int, default=20)
    detecting.add_argument("--history", help="folder of score sketches by day, kept and merged")
    job("publish", "detected", "target").add_argument("--format", default="json")
    job("profile", "ground-truth", "report").add_argument("--state", help="folder of daily profiles, kept and merged")
    return parser


def main(argv: list[str] | None = None) -> None:
    # Arguments are checked before a session starts.
    parser = arguments()
    args = parser.parse_args(argv)
    if args.job == "predict" and args.classifier and not args.metadata:
        parser.error("--classifier needs --metadata")
    spark = SparkSession.builder.appName(f"hitlens-{args.job}").getOrCreate()
    use_utc(spark)
    given = vars(args)
    source = next(given[p] for p in ("logs", "extracted", "ground_truth", "detected") if p in given)
    size_shuffles(spark, source, 1.0 if args.job == "extract" else STORED_EXPANSION)
    with temporary_work(spark):
        run(spark, args)


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "extract":
        extract.run(
            spark, args.logs, args.output, args.metadata, args.report, args.domains, args.mode
        )
    elif args.job == "train":
        site.run_train(
            spark, args.extracted, args.metadata, args.output, args.report, args.run_id
        )
    elif args.job == "predict":
        site.run_predict(
            spark,
            args.extracted,
            args.metadata,
            args.classifier,
            args.output,
            args.report,
            args.threshold,
            args.mode,
            args.pipeline,
        )
    elif args.job == "merge":
        site.run_merge(
            spark, args.extracted, args.predicted, args.output, args.report, args.mode
        )
    elif args.job == "detect":
        detector = detect.FINAL if args.detector == "final" else detect.FIRST
        detect.run(
            spark,
            args.ground_truth,
            args.output,
            args.model,
            args.report,
            args.sites,
            detector,
            args.use_model,
            args.listing,
            args.top,
            args.history,
        )
    elif args.job == "publish":
        detect.run_publish(spark, args.detected, args.target, args.format)
    else:
        profile.run(spark, args.ground_truth, args.report, args.state)


if __name__ == "__main__":
    main()
