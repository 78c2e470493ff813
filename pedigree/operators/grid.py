"""A stated list of parameter points over which relations are spread, so that all points are judged in one job."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedigree.params import Params

#: The parameters that may differ between points, in the order of their columns.
SWEPT = ("overlap_window", "known_count", "min_verified_versions", "churning_window", "solo_dominance")


@dataclass(frozen=True)
class Grid:
    """One set of parameters or, with `points`, several.

    What depends on no swept parameter (rows, blocks, streaks) is made once per package; `spread` repeats
    such relations, which are smaller than the history, once a point, with the parameters as columns.
    """

    base: Params = Params()
    points: tuple[Params, ...] = ()

    def __post_init__(self) -> None:
        for f in fields(Params):
            if f.name not in SWEPT and any(getattr(p, f.name) != getattr(self.base, f.name) for p in self.points):
                raise ValueError(f"{f.name} can't be swept")

    @property
    def keys(self) -> tuple[str, ...]:
        """The columns that tell packages apart, the package's id last."""
        return ("grid_id", *(f"p_{f}" for f in SWEPT), "package_id") if self.points else ("package_id",)

    @property
    def params(self) -> Params:
        """The parameters; swept ones as the names of their columns."""
        return Params(**{f.name: getattr(self.base, f.name) for f in fields(Params)} | {f: f"p_{f}" for f in SWEPT}) if self.points else self.base

    def spread(self, df: DataFrame) -> DataFrame:
        """Each row once a point."""
        if not self.points:
            return df
        typed = lambda p, f: F.lit(float(getattr(p, f)) if f == "solo_dominance" else int(getattr(p, f))).alias(f"p_{f}")
        rows = F.array(*(F.struct(F.lit(k).alias("grid_id"), *(typed(p, f) for f in SWEPT)) for k, p in enumerate(self.points)))
        return df.withColumn("_point", F.explode(rows)).select("_point.*", *df.columns)


class Relations(dict):
    """Named relations, each made when it is first asked for and then kept."""

    def __init__(self, **makers):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self.makers[name]()
        return self[name]
