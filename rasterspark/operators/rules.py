"""Validation rules: each gives its violations as rows (severity, issue_type, dataset, candidate_id, path, details)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.metrics import CONFUSION, RATIOS, ratios
from . import grid
from .joins import ISSUE, issue


def violations(rows: DataFrame, key: str, **rules: Column) -> DataFrame:
    """An issue row for each rule (name = condition of a violation) that a row breaks; nulls don't break rules."""
    broken = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    out = rows.select(F.col(key).cast("string").alias("k"), F.explode(broken).alias("rule"))
    return out.select(F.lit("error").alias("severity"), F.col("rule").alias("issue_type"), F.lit(None).cast("string").alias("dataset"), F.col("k").alias("candidate_id"), F.lit(None).cast("string").alias("path"), F.lit("").alias("details"))


def collect_issues(*issues: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [i.select(*ISSUE) for i in issues])


def require_none(issues: DataFrame, limit: int = 5) -> None:
    """Raises with the first issues and their number, after all rules have run."""
    if (n := issues.count()) > 0:
        first = issues.orderBy("issue_type", "candidate_id").limit(limit).collect()
        raise ValueError(f"{n} issues, the first: {[(r.issue_type, r.candidate_id) for r in first]}")


def unique_key(rows: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """Blank keys and keys that repeat (without case unless exact)."""
    k = F.col(key) if exact else F.lower(F.trim(key))
    blank = rows.where(F.coalesce(F.trim(key), F.lit("")) == "").select(*issue("blank_key", F.col(key), F.lit(None).cast("string")))
    twice = rows.where(F.trim(key) != "").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return blank.unionByName(twice.select(*issue("duplicate_key", F.col("k"), F.lit(None).cast("string"))))


def count_algebra(chips: DataFrame, strict: bool = True) -> DataFrame:
    """strict: nodata within ignored pixels (selection); else within all (filter)."""
    return violations(chips, "chip_id", **count_rules(strict))


def count_rules(strict: bool = True) -> dict[str, Column]:
    total, ign, nd = F.col("total_pixel_count"), F.col("ignore_pixel_count"), F.col("nodata_pixel_count")
    classes = F.col("class_0_pixel_count") + F.col("class_1_pixel_count")
    negative = (F.least("class_0_pixel_count", "class_1_pixel_count", "ignore_pixel_count", "nodata_pixel_count") < 0)
    return {"no_pixels": total <= 0, "negative_count": negative, "class_sum": classes + ign != total, "nodata_over": nd > (ign if strict else total)}


def stored_percentage(chips: DataFrame, rel: float = 1e-12, absolute: float = 1e-10) -> DataFrame:
    return violations(chips, "chip_id", **percentage_rules(rel, absolute))


def percentage_rules(rel: float = 1e-12, absolute: float = 1e-10) -> dict[str, Column]:
    fresh = X.percentage(F.col("nodata_pixel_count"), F.col("total_pixel_count"))
    return {"nodata_pct": ~X.close(F.col("nodata_pct"), fresh, rel, absolute)}


def window_validity(chips: DataFrame, size: int, stride: int) -> DataFrame:
    return violations(chips, "chip_id", **window_rules(size, stride))


def window_rules(size: int, stride: int) -> dict[str, Column]:
    def bad(off, dim, out):
        small = F.col(dim) < size
        return F.when(small, (F.col(out) != F.col(dim)) | (F.col(off) != 0)).otherwise((F.col(out) != size) | (F.pmod(off, F.lit(stride)) != 0))

    inside = (F.col("row_off") >= 0) & (F.col("col_off") >= 0) & (F.col("row_off") + F.col("chip_height") <= F.col("source_height")) & (F.col("col_off") + F.col("chip_width") <= F.col("source_width"))
    return {"outside": ~inside, "row_window": bad("row_off", "source_height", "chip_height"), "col_window": bad("col_off", "source_width", "chip_width"), "total": F.col("total_pixel_count") != F.col("chip_width").cast("long") * F.col("chip_height")}


def tile_content(tiles: DataFrame, chips: DataFrame, classes: list[int], dtype: str = "uint16", nodata: float = 0) -> DataFrame:
    """Tiles against the manifest: sizes, value range and recounted pixels."""
    from .aggregates import tile_counts

    counts = [*[f"class_{v}_pixel_count" for v in classes], "ignore_pixel_count", "nodata_pixel_count"]
    whole, fits = F.size("image") == F.col("h") * F.col("w") * F.col("b"), X.in_dtype(F.col("image"), dtype)
    t = tile_counts(tiles.select("chip_id", "h", "w", "b", whole.alias("whole"), fits.alias("fits"), "image", "label"), classes, nodata).select("chip_id", "h", "w", "whole", "fits", *[F.col(c).alias(f"t_{c}") for c in counts])
    out = chips.join(t, "chip_id", "left")
    return violations(out, "chip_id", missing_tile=F.col("h").isNull(), shape=(F.col("h") != F.col("chip_height")) | (F.col("w") != F.col("chip_width")) | ~F.col("whole"), dtype=~F.col("fits"), **{c: F.col(c) != F.col(f"t_{c}") for c in counts})


def bounds_check(chips: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Stored bounds against the affine columns."""
    names = ("minx", "miny", "maxx", "maxy")
    stored = chips.withColumns({f"s_{n}": F.col(n) for n in names}).drop(*names)
    return violations(grid.window_bounds(stored), "chip_id", **{n: F.abs(F.col(n) - F.col(f"s_{n}")) > tolerance for n in names})


def raster_pairs(images: DataFrame, labels: DataFrame, bands: int = 8, nodata: int = 3) -> DataFrame:
    """Metadata of image and label rasters -> source_tiff_id and all issues of a pair in one text."""
    i, j = images.alias("i"), labels.alias("l")
    out = i.join(j, F.col("i.source_tiff_id") == F.col("l.source_tiff_id"), "left")
    far = lambda cols, eps: reduce(Column.__or__, [F.abs(F.col(f"i.{c}") - F.col(f"l.{c}")) > eps for c in cols])
    rules = {
        "shape": (F.col("i.width") != F.col("l.width")) | (F.col("i.height") != F.col("l.height")), "crs": ~F.col("i.crs").eqNullSafe(F.col("l.crs")),
        "transform": far([f"transform_{k}" for k in "abcdef"], 1e-9), "bounds": far(["bounds_left", "bounds_bottom", "bounds_right", "bounds_top"], 1e-6), "image bands": F.col("i.band_count") != bands, "label bands": F.col("l.band_count") != 1,
        "label dtype": F.col("l.dtype") != "uint8", "label nodata": ~F.col("l.nodata").eqNullSafe(F.lit(float(nodata))), "label values": F.exists("l.label_values", lambda v: (v < 0) | (v > 4)), "unlabelled nodata": F.col("l.nodata_unlabelled") > 0,
    }
    text = F.concat_ws("; ", F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()])))
    text = F.when(F.col("l.source_tiff_id").isNull(), "missing label").otherwise(text)
    return out.select(F.col("i.source_tiff_id").alias("source_tiff_id"), text.alias("issues")).where("issues <> ''")


def copy_faults(source: DataFrame, copy: DataFrame) -> DataFrame:
    c = copy.select("relative_path", F.col("sha256").alias("h"), F.col("byte_size").alias("s"))
    out = source.join(c, "relative_path", "left")
    return violations(out, "relative_path", missing_copy=F.col("h").isNull(), size=F.col("s") != F.col("byte_size"), hash=F.col("h") != F.col("sha256"))


def domain(rows: DataFrame, key: str, column: str, allowed: tuple[str, ...]) -> DataFrame:
    return violations(rows, key, **{f"{column}_value": ~F.coalesce(F.col(column), F.lit("")).isin(*allowed)})


def metric_recheck(metrics: DataFrame, key: str = "source_tiff_id", tolerance: float = 1e-12) -> DataFrame:
    """Stored counts and ratios against each other."""
    stored = metrics.withColumns({f"s_{r}": F.col(r) for r in RATIOS}).drop(*RATIOS).select("*", *ratios())
    total = sum((F.col(c) for c in CONFUSION), F.lit(0))
    differs = {r: ~F.when(F.col(r).isNull() | F.col(f"s_{r}").isNull(), F.col(r).isNull() & F.col(f"s_{r}").isNull()).otherwise(F.abs(F.col(r) - F.col(f"s_{r}")) <= tolerance) for r in RATIOS}
    return violations(stored, key, scored=total != F.col("scored_pixel_count"), covered=F.col("scored_pixel_count") + F.col("ignored_pixel_count") != F.col("covered_pixel_count"), total=F.col("covered_pixel_count") + F.col("uncovered_pixel_count") != F.col("total_source_pixel_count"), **differs)


def fold_leakage(folds: DataFrame) -> DataFrame:
    """folds: leave-one-region-out rows with row_off and col_off."""
    held, split, on = F.col("region_id") == F.col("held_out_region"), F.col("experiment_split"), X.on_grid(F.col("row_off"), F.col("col_off"))
    keyed = folds.withColumn("fold_chip", F.concat_ws("/", "fold_id", "chip_id"))
    return violations(keyed, "fold_chip", test_outside_region=(split == "test") & ~held, region_in_training=split.isin("train", "val") & held, off_grid=split.isin("val", "test") & ~on, absent_from_test=held & on & (split != "test"))


#: Split, selected and reason of the rows that a scope may hold.
ALLOWED_BASELINE = (("test", True, "selected"), ("", False, "test_overlap_exclusion"))
ALLOWED_HELD_OUT = (("test", True, "held_out_region_test"), ("", False, "held_out_region_overlap_exclusion"))


def scope_rows(folds: DataFrame, scope: str, held_out: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that a scope evaluates, and rows that it may not hold."""
    if scope == "selected_nonoverlap":
        return folds.where((F.col("experiment_split") == "test") & F.col("selected")), folds.limit(0)
    rows = folds.where(F.col("region_id") == F.col("held_out_region")) if held_out else folds.where(F.col("source_temporal_split") == "TEST")
    allowed = ALLOWED_HELD_OUT if held_out else ALLOWED_BASELINE
    fine = reduce(Column.__or__, [(F.col("experiment_split") == s) & (F.col("selected") == F.lit(y)) & (F.col("selection_reason") == r) for s, y, r in allowed])
    return rows.where(fine), rows.where(~F.coalesce(fine, F.lit(False)))


def summary_faults(summary: DataFrame, fresh: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and field: names of stored counts that differ from the recomputed ones, or that one side lacks. Without keys
    both have one row."""
    names = [c for c in summary.columns if c in fresh.columns and c not in keys]
    stored, found = summary.select(*keys, *[F.col(n).alias(f"a_{n}") for n in names]), fresh.select(*keys, *[F.col(n).alias(f"b_{n}") for n in names])
    both = stored.join(found, list(keys), "full_outer") if keys else stored.crossJoin(F.broadcast(found))
    return both.select(*keys, F.explode(F.array_compact(F.array(*[F.when(~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")), F.lit(n)) for n in names]))).alias("field"))


def scope_stability(current: DataFrame, historical: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Sources of the same scope whose fields or truth counts changed."""
    truth = {"background": F.col("true_negative") + F.col("false_positive"), "foreground": F.col("true_positive") + F.col("false_negative")}
    keyed = lambda df, p: df.select("source_tiff_id", *[F.col(f).alias(f"{p}_{f}") for f in fields], *[v.alias(f"{p}_{k}") for k, v in truth.items()])
    both = keyed(current, "a").join(keyed(historical, "b"), "source_tiff_id", "full_outer")
    return violations(both, "source_tiff_id", **{f"{n}_changed": ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")) for n in (*fields, *truth)})


def coverage_regressions(pairs: DataFrame) -> DataFrame:
    return violations(pairs, "source_tiff_id", coverage_regressed=F.col("state") == "regressed")


def identity_columns(metrics: DataFrame, runs: DataFrame, fields: tuple[str, ...] = ("checkpoint_sha256", "fold_manifest_sha256", "evaluation_scope", "held_out_region")) -> DataFrame:
    r = runs.select("run_key", F.lit(True).alias("known"), *[F.col(f).alias(f"r_{f}") for f in fields])
    out = metrics.join(r, "run_key", "left").withColumn("k", F.concat_ws("/", "run_key", "source_tiff_id"))
    return violations(out, "k", unknown_run=F.col("known").isNull(), **{f: F.col("known") & ~F.col(f).eqNullSafe(F.col(f"r_{f}")) for f in fields})


def package_status(packages: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """verified if all conditions hold, else pending, with the names of those that don't."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))
    return packages.withColumn("failed_conditions", failed).withColumn("status", F.when(F.size("failed_conditions") == 0, "verified").otherwise("pending"))


#: Evaluation scopes and the schema versions of their packages, and the tables that a package has.
SCHEMA_VERSIONS = {"selected_nonoverlap": 1, "all_retained_test_chips": 3}
PACKAGE_TABLES = ("chip_diagnostics.csv", "tiff_metrics.csv", "region_metrics.csv")


def package_conditions(versions: dict[str, int] = SCHEMA_VERSIONS, threshold: float = 0.5) -> dict[str, Column]:
    """What a completed package must meet, by name.

    Columns: checkpoint_sha256, fold_manifest_sha256, evaluation_scope and the expected counts (test_chip_count,
    test_tiff_count, selected_nonoverlap_chip_count, overlap_chip_count) of the run; metadata and summary (structs of what
    the package's documents say, null where a document lacks); probabilities, masks, completions (numbers of files) and
    tables (names of the tables there). A document without a scope has the first one of versions.
    """
    first = next(iter(versions))
    version = F.element_at(F.create_map(*[F.lit(x) for kv in versions.items() for x in kv]), F.col("evaluation_scope"))
    said = lambda doc, c: F.col(doc)[c]
    same = lambda doc, c: said(doc, c) == F.col(c)
    scope = lambda doc: F.col(doc).isNotNull() & (F.coalesce(said(doc, "evaluation_scope"), F.lit(first)) == F.col("evaluation_scope"))
    wide = F.col("evaluation_scope") != first  # only then are the two kinds of chips told apart
    files = (F.col("probabilities") == F.col("test_tiff_count")) & (F.col("masks") == F.col("test_tiff_count")) & (F.col("completions") == F.col("test_tiff_count"))
    return {
        "metadata": F.col("metadata").isNotNull(), "summary": F.col("summary").isNotNull(),
        "metadata_checkpoint": same("metadata", "checkpoint_sha256"), "schema_version": said("metadata", "schema_version") == version, "metadata_folds": same("metadata", "fold_manifest_sha256"), "metadata_threshold": said("metadata", "threshold") == threshold,
        "summary_checkpoint": same("summary", "checkpoint_sha256"), "summary_folds": same("summary", "fold_manifest_sha256"), "summary_threshold": said("summary", "threshold") == threshold,
        "test_chips": same("summary", "test_chip_count"), "test_tiffs": same("summary", "test_tiff_count"), "metadata_scope": scope("metadata"), "summary_scope": scope("summary"),
        "selected_chips": ~wide | same("summary", "selected_nonoverlap_chip_count"), "overlap_chips": ~wide | same("summary", "overlap_chip_count"),
        "rasters": files, "tables": F.size(F.array_except(F.array(*map(F.lit, PACKAGE_TABLES)), F.col("tables"))) == 0,
    }


def suite_faults(runs: DataFrame, regions: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """One baseline, one run for each region, unique run keys, in each suite (keys; one suite without)."""
    suite = F.concat_ws("/", *keys) if keys else F.lit("suite")
    facts = runs.groupBy(suite.alias("suite")).agg(F.count_if(F.col("run_type") == "baseline").alias("baselines"), F.count(F.lit(1)).alias("n"), F.count_distinct("run_key").alias("keys"), F.array_sort(F.collect_set(F.when(F.col("run_type") != "baseline", F.col("held_out_region")))).alias("regions"), F.count_if(F.col("run_type") != "baseline").alias("held"))
    wanted = F.array(*map(F.lit, sorted(regions)))
    return violations(facts, "suite", baseline_count=F.col("baselines") != 1, repeated_run_key=F.col("n") != F.col("keys"), regions=F.col("regions") != wanted, region_runs=F.col("held") != len(regions))


def selection_consistency(selection: DataFrame) -> DataFrame:
    fresh = X.class_presence(F.col("class_0_pixel_count"), F.col("class_1_pixel_count"), F.col("nodata_pixel_count"))
    return violations(selection, "chip_id", class_presence=fresh != F.col("class_presence"), selected=(F.col("policy") == "exclude_all") & (F.col("selected_for_training") != (fresh == "positive")))


def replay_faults(report: DataFrame, chips: DataFrame, threshold: str) -> DataFrame:
    """The filter run again on the snapshot against the stored report; the source counts too where the report has it."""
    from .policy import filter_report
    from .sets import symmetric_difference

    cols = [*[c for c in ("source_tiff_id",) if c in report.columns], "chip_id", "action", "reason"]
    return symmetric_difference(filter_report(chips, threshold), report, cols)
