"""Work on rows of which some make it fail: those are told apart, the others get their results."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.session import cut

#: Errors that come from a row's values; all others (a lost executor, a missing file, a wrong plan) end the job.
DATA_ERRORS = {"ArithmeticException", "ArrayIndexOutOfBoundsException", "DateTimeException", "IllegalArgumentException", "NumberFormatException", "PythonException", "SparkRuntimeException"}


def isolate(rows: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], most: int = 64) -> tuple[DataFrame | None, list[tuple]]:
    """(results of `work`, checkpointed; (key..., error) of the keys that fail).

    `work` must judge each key by itself. It runs over all rows at once; only if a value makes it fail, the rows are dealt
    over four parts by their key's digest and tried again, so that a failing key costs a few small jobs. More than `most` failing
    keys are no matter of single rows: the error is raised.
    """
    failed: list[tuple] = []

    def attempt(part: DataFrame, depth: int) -> list[DataFrame]:
        try:
            return [cut(work(part))]
        except PySparkException as e:
            if type(e).__name__ not in DATA_ERRORS:
                raise
            keys = part.select(*key).distinct().limit(2).collect()
            if len(keys) < 2:
                failed.extend((*k, str(e).split("\n")[0][:500]) for k in keys)
                if len(failed) > most:
                    raise
                return []
            place = F.pmod(F.shiftrightunsigned(F.xxhash64(*key), 2 * depth), F.lit(4))
            return [done for k in range(4) for done in attempt(part.where(place == k), depth + 1)]

    done = attempt(rows, 0)
    return (reduce(DataFrame.unionAll, done) if done else None), failed
