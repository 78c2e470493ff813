"""Detection quality: label targets, attribution, confusion counts, rates, sweeps over a parameter grid."""

from __future__ import annotations

from dataclasses import fields
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pedigree.functions.columns import matches_range, rate, round4, semver_key, wilson
from pedigree.operators import disposition, provenance, publisher
from pedigree.operators.grid import SWEPT, Grid
from pedigree.params import Params
from pedigree.session import cut

KEYS = ("package_id",)


def usable_labels(labels: DataFrame) -> DataFrame:
    """Malicious labels that are pinned to a version, or whose advisory has no pinned label for the package."""
    pinned = labels.where("version_id is not null").select("package_id", "advisory_id").distinct().withColumn("_pinned", F.lit(True))
    out = labels.where("is_malicious").join(pinned, ["package_id", "advisory_id"], "left")
    return out.where("version_id is not null or _pinned is null").drop("_pinned")


def label_targets(labels: DataFrame, history: DataFrame) -> DataFrame:
    """(label, candidate version) pairs, pinned or by range, in version order (`place`); labels without candidates have none."""
    pinned = labels.where("version_id is not null").join(history.select("package_id", F.col("input_idx").alias("version_id"), "version"), ["package_id", "version_id"]).select("label_id", "package_id", "version", F.lit("version_pinned").alias("kind"))
    ranged = labels.where("version_id is null and affected_range is not null").join(history.select("package_id", "version"), "package_id").where(F.length("version") > 0).where(matches_range(F.col("version"), F.col("affected_range")))
    both = pinned.unionByName(ranged.select("label_id", "package_id", "version", F.lit("range_based").alias("kind"))).distinct()
    return both.withColumn("place", F.row_number().over(Window.partitionBy("label_id").orderBy(semver_key(F.col("version")), "version")).cast("long"))


def attribute(labels: DataFrame, targets: DataFrame, last: DataFrame, rows: DataFrame) -> DataFrame:
    """Per label whether a BLOCK accounts for it: on a candidate itself, or earlier in the same tenure block.

    `last` has the last verdict on each version, `rows` the valid rows with their block. The first
    candidate that has either counts; else the first with another verdict is named. Of a block only its
    lowest blocked version can be the one, so all joins are by equality.
    """
    where_ = rows.groupBy("package_id", "version").agg(F.max_by("block_idx", "input_idx").alias("block_idx"))
    told = last.select("package_id", "version", "disposition", F.when(F.col("disposition") == "BLOCK", semver_key(F.col("version"))).alias("_k"))
    lowest = told.where("_k is not null").join(where_, ["package_id", "version"]).groupBy("package_id", "block_idx").agg(F.min(F.struct("_k", F.col("version").alias("anchor"))).alias("_low"))
    at = targets.join(where_, ["package_id", "version"], "left").join(told, ["package_id", "version"], "left").join(lowest, ["package_id", "block_idx"], "left")
    near = F.when(F.col("_low._k") <= semver_key(F.col("version")), F.col("_low.anchor"))
    at = at.withColumn("anchor", F.when(F.col("_k").isNotNull(), F.col("version")).otherwise(near))
    # All that is asked of a label's candidates is one aggregate of them.
    of_label = at.groupBy("label_id").agg(
        F.min(F.when(F.col("anchor").isNotNull(), F.struct("place", "anchor"))).alias("_x"),
        F.min(F.when(F.col("disposition").isNotNull(), F.struct("place", "version", "disposition"))).alias("_o"), F.count("*").alias("n_candidates"),
    )
    out = labels.join(of_label, "label_id", "left")
    hit = F.col("_x").isNotNull()
    return out.select(
        "label_id", "package_id", "advisory_id", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), hit.alias("detected"), F.when(hit, F.col("_x.anchor")).otherwise(F.col("_o.version")).alias("detected_version"),
        F.when(hit, "BLOCK").otherwise(F.col("_o.disposition")).alias("detected_disposition"), "detection_lag_days",
    )


def last_verdicts(judged: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last verdict on each version."""
    return judged.groupBy(*keys, "version").agg(F.max_by("disposition", F.struct("pass", "place")).alias("disposition"))


def package_results(history: DataFrame, attacked: DataFrame, grid: Grid = Grid()) -> tuple[DataFrame, dict[str, DataFrame]]:
    """One row per package: verdict, attack or not, shape, verdict counts, layers; and the relations it came from."""
    found, keys = publisher.extract(history, grid), list(grid.keys)
    records = provenance.extract(history, grid.base)["per_version"]
    judged = cut(disposition.verdicts(found, records))
    fell = disposition.worsened(found, records)
    last = last_verdicts(judged, grid.keys)
    worse = fell.where(F.size("escalators") > 0).select(*keys, "version").withColumn("_worse", F.lit(1))
    of_last = last.join(worse, [*keys, "version"], "left").groupBy(*keys).agg(
        F.count_if(F.col("disposition") == "BLOCK").alias("block_transitions"), F.count_if(F.col("disposition") == "WARN").alias("warn_transitions"),
        F.max(((F.col("disposition") == "BLOCK") & F.col("_worse").isNull()).cast("int")).alias("_publisher"),
    )
    worst = judged.groupBy(*keys).agg(F.max(disposition.severity("disposition")).alias("_level"))
    kinds = ("new_domain", "privacy", "unverified", "machine_to_human")
    of_fell = fell.groupBy(*keys).agg(F.count("*").alias("provenance_regression_count"), F.count_if(F.size("escalators") > 0).alias("provenance_escalator_fires"), *(F.count_if(F.array_contains("escalators", e)).alias(f"fires_{e}") for e in kinds))
    out = found["summary"].join(worst, keys, "left").join(of_last, keys, "left").join(of_fell, keys, "left").join(attacked.select("package_id", F.lit(True).alias("attack")), "package_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        *keys, F.coalesce("attack", F.lit(False)).alias("attack"), disposition.verdict_of(F.coalesce("_level", F.lit(0))).alias("disposition"), "shape", "observed_versions_count", "has_sufficient_history", "transition_count",
        zero("block_transitions"), zero("warn_transitions"), zero("provenance_regression_count"), zero("provenance_escalator_fires"), *(zero(f"fires_{e}") for e in kinds), (F.coalesce("_publisher", F.lit(0)) == 1).alias("publisher_block"),
    ), {"rows": found["rows"], "records": records, "judged": judged, "last": last}


def confusion(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and rates of detection over packages."""
    attack, block, warn = F.col("attack"), F.col("disposition") == "BLOCK", F.col("disposition") == "WARN"
    attested, own = F.col("provenance_escalator_fires") > 0, F.col("publisher_block")
    c = results.groupBy(*by).agg(
        F.count_if(attack & block).alias("tp"), F.count_if(attack & ~block).alias("fn"), F.count_if(~attack & block).alias("fp"), F.count_if(~attack & ~block).alias("tn"), F.count_if(~attack & warn).alias("warn_clean"),
        F.count_if(attack & block & own & ~attested).alias("publisher_only"), F.count_if(attack & block & ~own & attested).alias("provenance_only"), F.count_if(attack & block & own & attested).alias("both_layers"),
        F.count_if(attack & attested).alias("provenance_attack_detected"), F.count_if(~attack & attested).alias("provenance_clean_blocked"),
        *(F.sum(f"fires_{e}").alias(f"fires_{e}") for e in ("new_domain", "privacy", "unverified", "machine_to_human")),
    )
    tp, fp, attacks, clean = F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn"), F.col("fp") + F.col("tn")
    return c.withColumns({
        "recall": rate(tp, attacks), "recall_low": wilson(tp, attacks, -1), "recall_high": wilson(tp, attacks, 1), "false_positive_rate": rate(fp, clean), "fpr_low": wilson(fp, clean, -1), "fpr_high": wilson(fp, clean, 1), "precision": rate(tp, tp + fp),
    })


def lag_quartiles(attributed: DataFrame) -> DataFrame:
    """Nearest-rank quartiles of the detected labels' lag."""
    lags = attributed.where("detected and detection_lag_days is not null")
    at = lambda q: F.expr(f"cast(percentile_disc({q}) WITHIN GROUP (ORDER BY detection_lag_days) as bigint)")
    return lags.agg(F.count("*").alias("n"), F.min("detection_lag_days").cast("long").alias("lowest"), at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"), F.max("detection_lag_days").cast("long").alias("highest"))


def sweep(history: DataFrame, attacked: DataFrame, points: list[Params]) -> DataFrame:
    """Confusion counts and rates at every grid point, all in one job."""
    grid = Grid(points[0], tuple(points))
    return confusion(package_results(history, attacked, grid)[0], grid.keys[:-1])


def sensitivity_points(base: Params = Params()) -> list[Params]:
    """The base, and each swept parameter one step down and up."""
    steps = {"overlap_window": 1, "known_count": 1, "min_verified_versions": 1, "churning_window": 1, "solo_dominance": 0.05}
    moved = [Params(**{f.name: getattr(base, f.name) for f in fields(Params)} | {f: getattr(base, f) + s * d}) for f, d in steps.items() for s in (-1, 1)]
    return [base, *moved]


def calibration_points(base: Params = Params()) -> list[Params]:
    """All pairs of four minimum counts and three shares."""
    return [Params(**{f.name: getattr(base, f.name) for f in fields(Params)} | {"min_verified_versions": m, "solo_dominance": s}) for m in (1, 2, 3, 4) for s in (0.75, 0.8, 0.85)]


def best_point(swept: DataFrame, fp_target: float = 0.05) -> DataFrame:
    """The point within the false-positive target with the best recall, else the one with the fewest false positives."""
    ok = (F.col("false_positive_rate") <= fp_target).cast("int")
    order = [F.desc(ok), F.when(ok == 1, -F.col("recall")).otherwise(F.col("false_positive_rate")), F.col("false_positive_rate"), F.desc("recall"), "p_min_verified_versions", "p_solo_dominance"]
    return swept.orderBy(*order).limit(1)


def split_violations(train: DataFrame, test: DataFrame, corpus: DataFrame, held_out: DataFrame) -> DataFrame:
    """(problem, package_id): packages in both parts, outside the corpus, or held out but in training."""
    found = {
        "in both": train.join(test, "package_id", "left_semi"), "train not in corpus": train.join(corpus, "package_id", "left_anti"), "test not in corpus": test.join(corpus, "package_id", "left_anti"),
        "held out but in train": train.join(held_out, "package_id", "left_semi"), "held out but not in test": held_out.join(test, "package_id", "left_anti"),
    }
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("problem"), "package_id") for name, df in found.items()))


def drop_rule(swept: DataFrame, least_recall: float = 0.02, least_fp: float = 0.005) -> DataFrame:
    """(constant, delta_fp, delta_recall, retained, drop_reason) from the confusion at `sensitivity_points`.

    The larger change of the two steps counts; a parameter that moves neither rate enough is dropped.
    """
    at = F.col("grid_id")
    base = swept.where(at == 0).select(F.col("false_positive_rate").alias("_fp"), F.col("recall").alias("_recall"))
    moved = swept.where(at > 0).withColumn("constant", F.element_at(F.array(*map(F.lit, SWEPT)), F.floor((at - 1) / 2).cast("int") + 1))
    change = lambda c, b: F.coalesce(round4(F.max(F.abs(F.col(c) - F.col(b)))), F.lit(0.0))
    # The base is one row.
    out = moved.join(F.broadcast(base), F.lit(True)).groupBy("constant").agg(change("false_positive_rate", "_fp").alias("delta_fp"), change("recall", "_recall").alias("delta_recall"))
    retained = (F.col("delta_recall") >= least_recall) | (F.col("delta_fp") >= least_fp)
    why = F.format_string(f"below thresholds: |Δrecall|=%.4f < {least_recall} AND |ΔFP|=%.4f < {least_fp}", "delta_recall", "delta_fp")
    return out.withColumn("retained", retained).withColumn("drop_reason", F.when(~F.col("retained"), why))


def labels_per_package(labels: DataFrame) -> DataFrame:
    """(package_id, n_labels, n_malicious)."""
    return labels.groupBy("package_id").agg(F.count("*").alias("n_labels"), F.count_if("is_malicious").alias("n_malicious"))


def result_head(results: DataFrame, attributed: DataFrame, base: Params = Params()) -> DataFrame:
    """One row (section `head`, line): the corpus, the parameters and all aggregates as one JSON object.

    Counts over packages, labels and lags are one aggregate each; three rows meet in one.
    """
    labels = attributed.agg(F.count("*").alias("total"), F.count_if("detected").alias("detected"), F.count_if(F.col("n_candidates") > 0).alias("attributable"))
    parts = {"c": confusion(results), "l": labels, "q": lag_quartiles(attributed)}
    rows = [df.select(F.struct("*").alias(name)) for name, df in parts.items()]
    one = rows[0].unionByName(rows[1], allowMissingColumns=True).unionByName(rows[2], allowMissingColumns=True).agg(*(F.max(name).alias(name) for name in parts))
    attacks, clean = F.col("c.tp") + F.col("c.fn"), F.col("c.fp") + F.col("c.tn")
    of = lambda place, *names: [F.col(f"{place}.{n}").alias(n) for n in names]
    corpus = F.struct((attacks + clean).alias("packages"), attacks.alias("attacked"), clean.alias("clean"))
    parameters = F.struct(*(F.lit(getattr(base, f.name)).alias(f.name) for f in fields(Params)))
    packages = F.struct(*of("c", "tp", "fn", "fp", "tn", "warn_clean", "recall", "recall_low", "recall_high", "false_positive_rate", "fpr_low", "fpr_high", "precision"))
    provenance_ = F.struct(*of("c", "provenance_attack_detected", "provenance_clean_blocked"), rate(F.col("c.provenance_attack_detected"), attacks).alias("recall"), rate(F.col("c.provenance_clean_blocked"), clean).alias("false_positive_rate"))
    label = F.struct(*of("l", "total", "detected", "attributable"), rate(F.col("l.detected"), F.col("l.total")).alias("recall"), rate(F.col("l.detected"), F.col("l.attributable")).alias("recall_attributable"))
    aggregates = F.struct(
        packages.alias("packages"), F.struct(*of("c", "publisher_only", "provenance_only", "both_layers")).alias("layers"), provenance_.alias("provenance"), label.alias("labels"),
        F.struct(*of("c", "fires_new_domain", "fires_privacy", "fires_unverified", "fires_machine_to_human")).alias("escalators"), F.struct(*of("q", "n", "lowest", "q1", "median", "q3", "highest")).alias("detection_lag_days"),
    )
    line = F.to_json(F.struct(corpus.alias("corpus"), parameters.alias("parameters"), aggregates.alias("aggregates")), {"ignoreNullFields": "false"})
    return one.select(F.lit("head").alias("section"), F.lit(-1).cast("long").alias("package_id"), F.lit(-1).cast("long").alias("label_id"), line.alias("line"))


def result_document(results: DataFrame, attributed: DataFrame, base: Params = Params()) -> DataFrame:
    """The whole result document as lines: its head, then one object a label and a package; `results.write_lines` puts them in order."""
    return result_head(results, attributed, base).unionByName(result_lines(results, attributed))


def result_lines(results: DataFrame, attributed: DataFrame) -> DataFrame:
    """(section, package_id, label_id, line): the result document, one JSON object a line; `results.write_document` puts the lines in order."""
    line = lambda df: F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    packages = results.select(F.lit("package").alias("section"), "package_id", F.lit(-1).cast("long").alias("label_id"), line(results).alias("line"))
    return packages.unionByName(attributed.select(F.lit("label").alias("section"), "package_id", F.col("label_id").cast("long"), line(attributed).alias("line")))
