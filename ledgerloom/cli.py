"""Command line: fit, evaluate and apply the predictor, score predictions, check a submission.

Results are JSON on standard output; errors give status 2.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .constants import LABELS
from .operators import scoring
from .plans import learning, predictor
from .sources import ledger as src


class Command(NamedTuple):
    """What it says in the help, the flags it must have, those it may have, and what it does."""

    help: str
    required: tuple[str, ...]
    run: Callable[..., dict]
    optional: dict[str, type] = {}


def score(spark: SparkSession, labels: str, predictions: str) -> dict:
    truth = src.read_strings(spark, labels)
    src.check_labels(truth)
    return scoring.score_report(scoring.scored_confusion(truth, src.read_strings(spark, predictions), spark))


def validate(spark: SparkSession, sample: str, predictions: str) -> dict:
    given = src.read_strings(spark, predictions)
    scoring.validate_submission(given, src.read_strings(spark, sample))
    return {"valid": True, "clients": given.count(), "labels": LABELS}


def train(spark: SparkSession, data: str, labels: str, bundle: str, recipe: str | None = None, rounds: int | None = None) -> dict:
    told = src.read_labels(spark, labels).withColumnRenamed("target_next_recurring_merchant", "truth").select("client_id", "truth")
    chosen = learning.catalogue()[recipe or "full"]
    made = predictor.train(predictor.read_split(spark, data, "train"), told, predictor.profiles_of(spark, data), chosen, rounds=rounds)
    made.save(bundle)
    first = list(predictor.importances(made).items())[:10]
    return {"bundle": bundle, "recipe": chosen.name, "features": len(made.columns), "models": len(made.rankers) + len(made.detectors), "importances": dict(first)}


def evaluate(spark: SparkSession, data: str, split: str, labels: str, bundle: str) -> dict:
    told = src.read_labels(spark, labels)
    return predictor.evaluate(predictor.Bundle.load(spark, bundle), predictor.read_split(spark, data, split), told)


def submit(spark: SparkSession, data: str, sample: str, bundle: str, output: str, split: str | None = None) -> dict:
    made = predictor.submission(predictor.Bundle.load(spark, bundle), predictor.read_split(spark, data, split or "test"), src.read_strings(spark, sample))
    src.write_csv(made, output, ["client_id"])
    return {"output": output, "clients": made.count()}


COMMANDS = {
    "score": Command("macro-F1 and accuracy of predictions against labels", ("labels", "predictions"), score),
    "validate": Command("check a submission against the sample's clients", ("sample", "predictions"), validate),
    "train": Command("fit a recipe and store its bundle", ("data", "labels", "bundle"), train, {"recipe": str, "rounds": int}),
    "evaluate": Command("score, losses and calibration of a bundle on a labelled split", ("data", "split", "labels", "bundle"), evaluate),
    "submit": Command("predict the sample's clients and store the submission", ("data", "sample", "bundle", "output"), submit, {"split": str}),
}


def parsed(argv: list[str] | None) -> tuple[Command, dict]:
    parser = argparse.ArgumentParser(prog="ledgerloom", description=__doc__)
    names = parser.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        flags = names.add_parser(name, help=command.help)
        for flag in command.required:
            flags.add_argument(f"--{flag}", required=True)
        for flag, kind in command.optional.items():
            flags.add_argument(f"--{flag}", type=kind)
    given = vars(parser.parse_args(argv))
    return COMMANDS[given.pop("command")], given


def main(argv: list[str] | None = None) -> int:
    command, given = parsed(argv)
    try:
        result = command.run(SparkSession.builder.appName("ledgerloom").getOrCreate(), **given)
    except (OSError, ValueError, KeyError, PySparkException) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 2
    print(json.dumps(result, indent=2, allow_nan=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
