"""Run a file of statements, or read them one a line: python -m modelrank.cli [catalog] [file]."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .plans.lexer import StatementError
from .plans.session import Session


def show(result: object) -> None:
    if isinstance(result, DataFrame):
        result.show(50, truncate=False)
    elif isinstance(result, dict):
        for k, v in result.items():
            print(f"{k}:", end=" ")
            show(v) if isinstance(v, DataFrame) else print(v)
    elif result is not None:
        print(result)


def main(args: list[str]) -> int:
    spark = SparkSession.builder.appName("modelrank").getOrCreate()
    session = Session(spark, args[0] if args else None)
    failed = 0
    with open(args[1], encoding="utf-8") if len(args) > 1 else sys.stdin as lines:
        for line in lines:
            if line.strip() and not line.lstrip().startswith("#"):
                try:
                    show(session.sql(line))
                except StatementError as e:
                    print(f"error: {e}")
                    failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
