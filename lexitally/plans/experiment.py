"""Train on one corpus file, test on another, print the report."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lexitally.operators.evaluate import text_report
from lexitally.plans.variants import VARIANTS, predict_variant, variant
from lexitally.session import build_session
from lexitally.sources.corpus import as_corpus, read_csv
from lexitally.sources.stage import stage


def run(spark: SparkSession, train_path: str, test_path: str, name: str) -> str:
    train, test = as_corpus(read_csv(spark, train_path)), as_corpus(read_csv(spark, test_path))
    predictions = stage(predict_variant(train, test, variant(name)))
    return text_report(f"{name}: Naive Bayes", predictions)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("variant", choices=[v.name for v in VARIANTS])
    parser.add_argument("train")
    parser.add_argument("test")
    given = parser.parse_args()
    print(run(build_session(), given.train, given.test, given.variant))


if __name__ == "__main__":
    main()
