"""Gates in Python: foreign code that judges one release at a time, in Arrow batches; an exception is a skip of that release only."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import functions as F

from pedigree.operators.gates import Gate

#: Given a release's facts, (result, detail).
Judge = Callable[[Mapping], tuple[str, str]]


def python_gate(columns: list[str], judge: Judge) -> Gate:
    """A gate that hands the named columns of `gates.facts` to `judge`.

    What `judge` raises becomes SKIP with the error in the detail, other releases are judged as usual; a result
    that is no pair is left to the runner, which skips what it doesn't know.
    """

    def one(release: Mapping) -> tuple[str | None, str | None]:
        try:
            told = judge(release)
        except Exception as e:  # noqa: BLE001 - whatever foreign code raises
            return "SKIP", f"gate_error: {e}"
        fits = isinstance(told, tuple) and len(told) == 2 and isinstance(told[0], str)
        return (told[0], told[1] if isinstance(told[1], str) else "") if fits else (None, None)

    @F.pandas_udf("result string, detail string")
    def run(releases: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in releases.to_dict("records")], columns=["result", "detail"])

    def gate(p):
        told = run(F.struct(*columns))
        return told["result"], told["detail"]

    return gate
