"""Command line: `python -m segspan.cli run ...` and `init-config`."""

from __future__ import annotations

import argparse
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import SparkSession

from .config import FIVE_ROLES, FULL_SWEEP, GFF_DEFAULTS, LocusMatching, Metric
from .plans.benchmark import benchmark_gff
from .sources import sinks


def predictor_spec(spec: str) -> tuple[str, str]:
    """`name:path`, or a path whose stem is the name; what starts with / is never split."""
    if not spec.startswith("/") and ":" in spec:
        name, _, path = spec.partition(":")
        return name, path
    return Path(spec).name.split(".")[0], spec


def own_types(gt: list[str] | None, specs: list[str] | None, predictors: Iterable[str] = ()) -> dict[str, list[str]]:
    """Exon types by source, from types of the reference, and of predictors: plain ones of all, or `name:type` of one (several add up)."""
    out = {"gt": gt} if gt else {}
    plain = [x for x in specs or () if ":" not in x]
    if plain and len(plain) < len(specs):
        raise SystemExit("exon types of predictors are either plain or name:type, not both")
    if plain:
        return out | {name: plain for name in predictors}
    for spec in specs or ():
        name, _, kind = spec.partition(":")
        if not name or not kind:
            raise SystemExit(f"{spec} is not name:type")
        out.setdefault(name, []).append(kind)
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="segspan")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="evaluate predicted annotations against a reference")
    run.add_argument("--gt", required=True)
    run.add_argument("--pred", action="append", required=True)
    run.add_argument("--config", required=True)
    run.add_argument("--exclude-features", action="append", default=[])
    run.add_argument("--transcript-types", action="append")
    run.add_argument("--exon-types", action="append", help="of all sources without types of their own")
    run.add_argument("--gt-exon-feature-type", action="append", help="of the reference")
    run.add_argument("--pred-exon-feature-type", action="append", metavar="[NAME:]TYPE", help="of one predictor, or of all")
    run.add_argument("--metrics", action="append", choices=[m.value for m in Metric] + ["all"])
    run.add_argument("--output")
    run.add_argument("--mapping-output")
    run.add_argument("--individual", action="store_true")
    run.add_argument("--locus-matching", choices=[m.value for m in LocusMatching], default="full_discovery")
    run.add_argument("--no-infer-introns", action="store_true")
    init = sub.add_parser("init-config", help="write a label configuration to start from")
    init.add_argument("path")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init-config":
        sinks.write_config(FIVE_ROLES, args.path)
        return 0
    preds: dict[str, str] = {}
    for name, path in map(predictor_spec, args.pred):
        if name in preds:
            raise SystemExit(f"predictor {name} is given twice")
        preds[name] = path
    wanted = args.metrics or [m.value for m in GFF_DEFAULTS]
    metrics = list(FULL_SWEEP) if "all" in wanted else [Metric(m) for m in wanted]
    spark = spark or SparkSession.builder.appName("segspan").getOrCreate()
    result = benchmark_gff(
        spark,
        args.gt,
        preds,
        sinks.read_config(args.config),
        args.exclude_features,
        metrics=metrics,
        transcript_types=args.transcript_types or ("mRNA", "transcript"),
        exon_types=args.exon_types or "exon",
        own_exon_types=own_types(args.gt_exon_feature_type, args.pred_exon_feature_type, preds),
        mode=LocusMatching(args.locus_matching),
        infer_introns=not args.no_infer_introns,
        individual=args.individual,
    )
    if args.mapping_output:
        sinks.write_mapping(result.mapped, args.mapping_output)
    found = result.nested(result.small() if args.output else None)
    if args.output and (files := result.write(f"{args.output}.parts")):
        # What grows with the sequences stands beside the result, written by the executors.
        found["files"] = files
    text = sinks.to_json(found, args.output)
    if not args.output:
        print(text)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
