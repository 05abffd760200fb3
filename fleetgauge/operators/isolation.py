"""Several results of one run, of which some may fail."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from ..session import run_dir

FAILURES = "name string, error string"


def isolated(spark: SparkSession, makers: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """What each maker gives, computed and staged by itself in the shared folder, and the (name, error) of those that fail.

    A plan fails when it runs, not when it is made, and one failing branch fails a whole union. So every result is written
    before it is united with others. Raises ValueError if there are makers and all of them fail.
    """
    done, errors = {}, []
    for name, make in makers.items():
        try:
            path = run_dir(spark, "isolated")
            rows = make()
            rows.write.parquet(path)
            done[name] = spark.read.schema(rows.schema).parquet(path)
        except Exception as error:  # noqa: BLE001
            errors.append((name, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"))
    if errors and not done:
        raise ValueError("; ".join(f"{name}: {error}" for name, error in errors))
    return done, spark.createDataFrame(errors, FAILURES)
