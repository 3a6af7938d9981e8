"""Queries over the given tables and the SQL that DuckDB compares them with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import metrics as M
from ..operators import aggregates as A
from ..operators import blocks, grid, hashing, joins, overlap, policy, quantiles, ranking, rules, sets
from ..sources import scratch
from ..streaming import registry
from .adapters import PIXELS, Tables, duck
from .base import ORACLES, QUERIES, query, rounded  # noqa: F401

S, C = ("sources",), ("sources", "chip_counts", "chips")
THRESHOLDS = (25.0, 50.0, 60.0, 75.0)
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


_KEEP = "nodata_pct <= 50"


@query(duck(*C) + f"""
SELECT CASE grouping_id(region_id, source_tiff_id) WHEN 3 THEN 'global' WHEN 1 THEN 'region' ELSE 'source' END AS level, region_id, source_tiff_id, count(*) AS chips, count(*) FILTER ({_KEEP}) AS kept_chips,
  count(*) FILTER (NOT {_KEEP}) AS removed_chips, coalesce(sum(total_pixel_count) FILTER ({_KEEP}), 0) AS retained_total_pixel_count, coalesce(sum(class_1_pixel_count) FILTER ({_KEEP}), 0) AS retained_class_1_pixel_count,
  coalesce(sum(nodata_pixel_count) FILTER ({_KEEP}), 0) AS retained_nodata_pixel_count, coalesce(max(nodata_pct) FILTER ({_KEEP}), 0) AS max_retained_nodata_pct
FROM chips GROUP BY GROUPING SETS ((), (region_id), (region_id, source_tiff_id))""")
def nodata_filter_summary(t: Tables) -> DataFrame:
    return A.filter_rollup(policy.filter_report(t["chips"], "50"))


_SUMS = ", ".join(f"coalesce(sum(CASE WHEN class_presence {op} 'positive' THEN {c} END), 0) AS {s}_{c}" for c in A.PIXELS for s, op in (("selected", "="), ("excluded", "<>")))


@query(duck(*C) + f""",
lev AS (SELECT 'global' AS level, NULL AS region, NULL AS source, * FROM chips UNION ALL SELECT 'region', region_id, NULL, * FROM chips UNION ALL SELECT 'source', region_id, source_tiff_id, * FROM chips),
agg AS (SELECT level, region, source, class_presence, count(*) AS chips, count(*) FILTER (class_presence = 'positive') AS selected_chips, count(*) FILTER (class_presence <> 'positive') AS excluded_chips, {_SUMS} FROM lev GROUP BY ALL),
keys AS (SELECT DISTINCT level, region, source, cp FROM agg, (VALUES ('positive'), ('clean_background_only'), ('mixed_background_nodata'), ('ignore_only')) v(cp))
SELECT k.level, k.region, k.source, k.cp AS class_presence, {", ".join(f"coalesce(a.{m}, 0) AS {m}" for m in ("chips", "selected_chips", "excluded_chips", *[f"{s}_{c}" for c in A.PIXELS for s in ("selected", "excluded")]))}
FROM keys k LEFT JOIN agg a ON a.level = k.level AND a.region IS NOT DISTINCT FROM k.region AND a.source IS NOT DISTINCT FROM k.source AND a.class_presence = k.cp""")
def class_presence_rollup(t: Tables) -> DataFrame:
    return A.presence_rollup(policy.training_selection(t["chips"]))


@query(duck(*C) + """
SELECT CASE WHEN nodata_pct = 0 THEN '0' WHEN nodata_pct <= 1 THEN '(0,1]' WHEN nodata_pct <= 5 THEN '(1,5]' WHEN nodata_pct <= 10 THEN '(5,10]' WHEN nodata_pct <= 20 THEN '(10,20]' WHEN nodata_pct <= 30 THEN '(20,30]'
  WHEN nodata_pct <= 40 THEN '(30,40]' WHEN nodata_pct <= 50 THEN '(40,50]' WHEN nodata_pct <= 75 THEN '(50,75]' ELSE '(75,100]' END AS bin, count(*) AS n FROM chips GROUP BY 1""")
def nodata_bins(t: Tables) -> DataFrame:
    return A.count_by(t["chips"].withColumn("bin", X.nodata_bin(F.col("nodata_pct"))), "bin")


@query(duck(*C) + """,
g AS (SELECT 'global' AS scope, nodata_pct FROM chips UNION ALL SELECT region_id, nodata_pct FROM chips)
SELECT scope, p AS percentile, round(quantile_cont(nodata_pct, p / 100), 6) AS value FROM (SELECT scope, list(nodata_pct) AS v FROM g GROUP BY 1) JOIN g USING (scope), (SELECT unnest([0, 1, 5, 10, 25, 50, 75, 90, 95, 99, 100]) AS p) GROUP BY scope, p""".replace("(SELECT scope, list(nodata_pct) AS v FROM g GROUP BY 1) JOIN g USING (scope)", "g").replace("quantile_cont(nodata_pct, p / 100)", "CASE p " + " ".join(f"WHEN {p} THEN quantile_cont(nodata_pct, {p / 100})" for p in A.PERCENTILES) + " END"))
def nodata_percentiles(t: Tables) -> DataFrame:
    return rounded(A.percentile_rows(t["chips"], "nodata_pct", "region_id"), "value")


@query(duck(*C) + """,
g AS (SELECT 'global' AS scope, * FROM chips UNION ALL SELECT region_id, * FROM chips),
s AS (SELECT th, scope, source_tiff_id, count(*) AS n, count(*) FILTER (nodata_pct > th) AS gone, sum(class_1_pixel_count) AS c1, coalesce(sum(class_1_pixel_count) FILTER (nodata_pct > th), 0) AS c1_gone
  FROM g, (VALUES (25.0::DOUBLE), (50.0), (60.0), (75.0)) v(th) GROUP BY ALL)
SELECT th AS threshold_pct, CASE WHEN th = 60 THEN 'required_and_suggested_class1_break' ELSE 'required' END AS candidate_basis, scope, sum(n) AS total_chips, sum(n - gone) AS retained_chips, sum(gone) AS removed_chips,
  round(100.0 * sum(gone) / sum(n), 6) AS removed_chip_pct, count(*) AS total_source_tiffs, count(*) FILTER (gone > 0) AS source_tiffs_affected, count(*) FILTER (gone = n) AS source_tiffs_eliminated,
  sha256(coalesce(string_agg(source_tiff_id, ';' ORDER BY source_tiff_id) FILTER (gone = n), '')) AS eliminated_ids, scope <> 'global' AND sum(n - gone) = 0 AS region_eliminated, sum(c1) AS class_1_pixels_total,
  sum(c1 - c1_gone) AS class_1_pixels_retained, sum(c1_gone) AS class_1_pixels_removed, round(CASE WHEN sum(c1) > 0 THEN 100.0 * sum(c1_gone) / sum(c1) ELSE 0 END, 6) AS class_1_pixels_removed_pct FROM s GROUP BY th, scope""")
def threshold_candidates(t: Tables) -> DataFrame:
    out = A.threshold_candidates(t["chips"], THRESHOLDS).withColumn("eliminated_ids", F.sha2("eliminated_source_tiff_ids", 256)).drop("eliminated_source_tiff_ids")
    return rounded(out, "removed_chip_pct", "class_1_pixels_removed_pct")


@query(duck(*C) + """
SELECT chip_id, total_pixel_count - nodata_pixel_count AS valid_pixel_count, 100.0 * class_1_pixel_count / total_pixel_count AS class_1_pct_of_chip, near.th AS nearest_plausible_threshold_pct, near.d AS distance_to_nearest_threshold_pct
FROM (SELECT *, list_min([{'d': abs(25.0::DOUBLE - nodata_pct), 'k': 0, 'th': 25.0::DOUBLE}, {'d': abs(50.0 - nodata_pct), 'k': 1, 'th': 50.0}, {'d': abs(60.0 - nodata_pct), 'k': 2, 'th': 60.0}, {'d': abs(75.0 - nodata_pct), 'k': 3, 'th': 75.0}]) AS near FROM chips)""")
def nearest_threshold(t: Tables) -> DataFrame:
    near = X.nearest_of(F.col("nodata_pct"), THRESHOLDS)
    return t["chips"].select("chip_id", (F.col("total_pixel_count") - F.col("nodata_pixel_count")).alias("valid_pixel_count"), X.percentage(F.col("class_1_pixel_count"), F.col("total_pixel_count")).alias("class_1_pct_of_chip"), near["threshold"].alias("nearest_plausible_threshold_pct"), near["distance"].alias("distance_to_nearest_threshold_pct"))


@query(duck(*C) + """,
r AS (SELECT *, row_number() OVER (PARTITION BY region_id, source_tiff_id, class_presence ORDER BY sha256(concat_ws(chr(0), '41', region_id, source_tiff_id, class_presence, chip_id)), lower(chip_id), chip_id) AS rn,
  count(*) OVER (PARTITION BY region_id, source_tiff_id, class_presence) AS n FROM chips)
SELECT chip_id, class_presence, class_presence = 'positive' OR rn <= n // 2 AS selected_for_training,
  CASE WHEN class_presence = 'positive' THEN 'positive' WHEN rn <= n // 2 THEN 'retained_' || class_presence || '_fraction' ELSE 'excluded_' || class_presence || '_fraction' END AS selection_reason, '0.5' AS retain_fraction FROM r""")
def stratified_background_sample(t: Tables) -> DataFrame:
    return policy.training_selection(t["chips"], "retain_fraction", "0.5", 41).select("chip_id", "class_presence", "selected_for_training", "selection_reason", "retain_fraction")


@query(duck(*C) + f"""
SELECT source_tiff_id, any_value(dataset) AS dataset, any_value(region_id) AS region_id, any_value(region_name) AS region_name, any_value(acquisition_date) AS acquisition_date, any_value(source_width) AS source_width,
  any_value(source_height) AS source_height, count(*) AS chips, 0 AS partial_chips, {", ".join(f"count(*) FILTER (class_presence = '{p}') AS {p}_chips" for p in A.PRESENCE)}, {", ".join(f"sum({c}) AS {c}" for c in A.PIXELS)} FROM chips GROUP BY source_tiff_id""")
def source_rollup(t: Tables) -> DataFrame:
    return A.source_rollup(t["chips"], 1024)


@query(duck(*C) + f"""
SELECT dataset, year(acquisition_date) AS year, count(*) AS chips, count(DISTINCT source_tiff_id) AS sources, {", ".join(f"sum({c}) AS {c}" for c in A.PIXELS)}, {", ".join(f"count(*) FILTER (class_presence = '{p}') AS {p}" for p in A.PRESENCE)} FROM chips GROUP BY 1, 2""")
def group_summary(t: Tables) -> DataFrame:
    out = A.group_summary(t["chips"].withColumn("year", X.year_of(F.col("acquisition_date"))), "dataset", "year")
    return out.select("dataset", "year", "chips", "sources", *A.PIXELS, *[F.col("class_presence")[p].alias(p) for p in A.PRESENCE])


@query(duck(*C) + """
SELECT source_tiff_id, count(*) FILTER (nodata_pct = 0) AS zero, count(*) FILTER (nodata_pct > 0 AND nodata_pct <= 50) AS to_50, count(*) FILTER (nodata_pct > 50) AS over_50 FROM chips GROUP BY 1""")
def audit_bins(t: Tables) -> DataFrame:
    return A.audit_bins(t["chips"])


@query(duck(*C) + """,
b AS (SELECT chip_id, CASE WHEN k % 11 = 1 THEN 0 ELSE total_pixel_count END AS total_pixel_count, CASE WHEN k % 13 = 2 THEN -1 ELSE class_0_pixel_count END AS class_0_pixel_count, class_1_pixel_count, ignore_pixel_count,
  CASE WHEN k % 17 = 3 THEN 100 ELSE nodata_pixel_count END AS nodata_pixel_count, CASE WHEN k % 19 = 4 THEN nodata_pct + 0.5 ELSE nodata_pct END AS nodata_pct, CASE WHEN k % 23 = 5 THEN row_off + 3 ELSE row_off END AS row_off, CASE WHEN k % 29 = 6 THEN 1000 ELSE chip_width END AS chip_width,
  col_off, chip_height, source_width, source_height FROM (SELECT *, CAST(substr(source_tiff_id, 5) AS BIGINT) + chip_index AS k FROM chips))
SELECT issue_type, count(*) AS n, min(chip_id) AS first_id FROM (
  SELECT chip_id, unnest(list_filter([CASE WHEN total_pixel_count <= 0 THEN 'no_pixels' END, CASE WHEN least(class_0_pixel_count, class_1_pixel_count, ignore_pixel_count, nodata_pixel_count) < 0 THEN 'negative_count' END,
    CASE WHEN class_0_pixel_count + class_1_pixel_count + ignore_pixel_count <> total_pixel_count THEN 'class_sum' END, CASE WHEN nodata_pixel_count > ignore_pixel_count THEN 'nodata_over' END,
    CASE WHEN total_pixel_count > 0 AND abs(nodata_pct - 100.0::DOUBLE * nodata_pixel_count / total_pixel_count) > 1e-9 THEN 'nodata_pct' END,
    CASE WHEN row_off < 0 OR col_off < 0 OR row_off + chip_height > source_height OR col_off + chip_width > source_width THEN 'outside' END,
    CASE WHEN chip_height <> 1024 OR row_off % 512 <> 0 THEN 'row_window' END, CASE WHEN chip_width <> 1024 OR col_off % 512 <> 0 THEN 'col_window' END, CASE WHEN total_pixel_count <> chip_width * chip_height THEN 'total' END], lambda x: x IS NOT NULL)) AS issue_type FROM b) GROUP BY 1""")
def chip_violations(t: Tables) -> DataFrame:
    """Faults of every kind planted in some of the chips."""
    k = F.substring("source_tiff_id", 5, 20).cast("long") + F.col("chip_index")
    planted = {"total_pixel_count": (11, F.lit(0)), "class_0_pixel_count": (13, F.lit(-1)), "nodata_pixel_count": (17, F.lit(100)), "nodata_pct": (19, F.col("nodata_pct") + 0.5), "row_off": (23, F.col("row_off") + 3), "chip_width": (29, F.lit(1000))}
    chips = t["chips"].withColumns({c: F.when(F.pmod(k, F.lit(m)) == at, v).otherwise(F.col(c)) for at, (c, (m, v)) in enumerate(planted.items(), 1)})
    some = F.col("total_pixel_count") > 0  # a percentage of no pixels can't be recomputed
    stored = {name: F.when(some, broken) for name, broken in rules.percentage_rules().items()}
    found = rules.violations(chips, "chip_id", **rules.count_rules(), **stored, **rules.window_rules(1024, 512))  # all rules in one pass
    return found.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id"))


@query("SELECT lower(trim(p_name)) AS key, count(*) AS n FROM part WHERE trim(p_name) <> '' GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    found = rules.unique_key(t["part"], "p_name").where("issue_type = 'duplicate_key'").select(F.col("candidate_id").alias("key"))
    return found.join(t["part"].groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.count(F.lit(1)).alias("n")), "key")


@query("""
WITH i AS (SELECT 'doc' || doc_id AS stem, 'images/' || doc_id AS path FROM documents WHERE lang <> 'de'), l AS (SELECT 'doc' || doc_id AS stem, 'labels/' || doc_id AS path FROM labels)
SELECT CASE WHEN i.stem IS NULL THEN 'missing_image' ELSE 'missing_label' END AS issue_type, coalesce(i.stem, l.stem) AS candidate_id, coalesce(i.path, l.path) AS path FROM i FULL JOIN l ON i.stem = l.stem WHERE i.stem IS NULL OR l.stem IS NULL""")
def pairing_issues(t: Tables) -> DataFrame:
    images = t["documents"].where("lang <> 'de'").select(F.concat(F.lit("DOC"), "doc_id").alias("stem"), F.concat(F.lit("images/"), "doc_id").alias("relative_path"))
    labels = t["labels"].select(F.concat(F.lit("doc"), "doc_id").alias("stem"), F.concat(F.lit("labels/"), "doc_id").alias("relative_path"))
    return joins.pairing_issues(images, labels).select("issue_type", "candidate_id", "path")


_SPLIT = """,
grp AS (SELECT region_id, acquisition_date AS d, count(*) AS n FROM sources GROUP BY ALL),
idx AS (SELECT *, row_number() OVER w - 1 AS i, coalesce(sum(n) OVER (PARTITION BY region_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, date_diff('day', lag(d) OVER w, d) AS gap,
  CASE WHEN year(d) <> year(lag(d) OVER w) THEN 1 ELSE 0 END AS yc, sum(n) OVER (PARTITION BY region_id) AS total FROM grp WINDOW w AS (PARTITION BY region_id ORDER BY d)),
cand AS (SELECT a.region_id, a.i AS i, b.i AS j, abs(a.before::DOUBLE / a.total - 0.7::DOUBLE) + abs((b.before - a.before)::DOUBLE / a.total - 0.15::DOUBLE) + abs((a.total - b.before)::DOUBLE / a.total - 0.15::DOUBLE) - 0.05::DOUBLE * (a.yc + b.yc) AS e, -(a.gap + b.gap) AS g
  FROM idx a JOIN idx b ON a.region_id = b.region_id AND a.i < b.i WHERE a.i > 0),
cuts AS (SELECT region_id, arg_min(i, (round(e, 12), g, i, j)) AS i, arg_min(j, (round(e, 12), g, i, j)) AS j FROM cand GROUP BY 1),
split AS (SELECT s.*, CASE WHEN cuts.i IS NULL THEN NULL WHEN idx.i < cuts.i THEN 'TRAIN' WHEN idx.i < cuts.j THEN 'VAL' ELSE 'TEST' END AS split
  FROM sources s JOIN idx ON s.region_id = idx.region_id AND s.acquisition_date = idx.d LEFT JOIN cuts ON cuts.region_id = s.region_id)"""


@query(duck(*S) + _SPLIT + " SELECT source_tiff_id, region_id, acquisition_date, split FROM split")
def temporal_split(t: Tables) -> DataFrame:
    return ranking.temporal_split(t["sources"]).select("source_tiff_id", "region_id", "acquisition_date", "split")


@query(duck(*S) + _SPLIT + " SELECT region_id, split, count(*) AS sources, min(acquisition_date) AS first_date, max(acquisition_date) AS last_date, string_agg(DISTINCT year(acquisition_date)::VARCHAR, ';' ORDER BY year(acquisition_date)::VARCHAR) AS years FROM split GROUP BY 1, 2")
def split_summary(t: Tables) -> DataFrame:
    return A.split_table(ranking.temporal_split(t["sources"]))


@query(duck(*S) + """,
s AS (SELECT *, CASE WHEN CAST(substr(source_tiff_id, 5) AS BIGINT) % 97 = 0 THEN 'TEST' WHEN acquisition_date < DATE '1995-01-01' THEN 'TRAIN' WHEN acquisition_date < DATE '1997-01-01' THEN 'VAL' ELSE 'TEST' END AS split FROM sources),
d AS (SELECT region_id, acquisition_date, count(DISTINCT split) AS k, min(CASE split WHEN 'TRAIN' THEN 0 WHEN 'VAL' THEN 1 ELSE 2 END) AS lo, max(CASE split WHEN 'TRAIN' THEN 0 WHEN 'VAL' THEN 1 ELSE 2 END) AS hi FROM s GROUP BY 1, 2)
SELECT region_id, acquisition_date, fault FROM (SELECT *, CASE WHEN k > 1 THEN 'mixed_date' WHEN lag(hi) OVER (PARTITION BY region_id ORDER BY acquisition_date) > lo THEN 'out_of_order' END AS fault FROM d) WHERE fault IS NOT NULL""")
def chronology_check(t: Tables) -> DataFrame:
    day = F.col("acquisition_date")
    odd = F.pmod(F.substring("source_tiff_id", 5, 20).cast("long"), F.lit(97)) == 0
    split = F.when(odd, "TEST").when(day < "1995-01-01", "TRAIN").when(day < "1997-01-01", "VAL").otherwise("TEST")
    return ranking.chronology_faults(t["sources"].withColumn("split", split))


def _with_roles(t: Tables) -> DataFrame:
    # the split is made once, over the sources; the chips are many times as many
    split = scratch.saved(ranking.temporal_split(t["sources"]).select("source_tiff_id", "split"), "split")
    return joins.with_split(policy.training_selection(t["chips"]), split)


_ROLES = _SPLIT + """,
roles AS (SELECT c.*, split.split AS time, class_presence = 'positive' AS sel, row_off % 1024 = 0 AND col_off % 1024 = 0 AS ongrid FROM chips c LEFT JOIN split USING (source_tiff_id)),
base AS (SELECT *, CASE WHEN time = 'TRAIN' AND sel THEN 'train' WHEN time IN ('VAL', 'TEST') AND ongrid THEN lower(time) ELSE '' END AS experiment_split,
  CASE WHEN (time = 'TRAIN' AND sel) OR (time IN ('VAL', 'TEST') AND ongrid) THEN 'selected' WHEN time = 'TRAIN' THEN 'background_policy_exclusion' WHEN time = 'VAL' THEN 'validation_overlap_exclusion' WHEN time = 'TEST' THEN 'test_overlap_exclusion' ELSE '' END AS selection_reason FROM roles)"""


@query(duck(*C) + _ROLES + " SELECT chip_id, time AS source_temporal_split, experiment_split, selection_reason, experiment_split <> '' AS selected, CASE WHEN experiment_split <> '' THEN experiment_split || '/' || chip_id || '.npz' ELSE '' END AS view_path FROM base")
def baseline_folds(t: Tables) -> DataFrame:
    return policy.baseline_fold(_with_roles(t)).select("chip_id", "source_temporal_split", "experiment_split", "selection_reason", "selected", "view_path")


_LORO = _ROLES + """,
loro AS (SELECT * EXCLUDE (experiment_split, selection_reason), CASE WHEN held AND ongrid THEN 'test' WHEN held THEN '' WHEN time = 'TRAIN' AND sel THEN 'train' WHEN time = 'VAL' AND ongrid THEN 'val' ELSE '' END AS experiment_split,
  CASE WHEN held AND ongrid THEN 'held_out_region_test' WHEN held THEN 'held_out_region_overlap_exclusion' WHEN time = 'TRAIN' AND sel THEN 'nonheldout_temporal_train' WHEN time = 'TRAIN' THEN 'training_background_excluded'
    WHEN time = 'VAL' AND ongrid THEN 'nonheldout_temporal_val' WHEN time = 'VAL' THEN 'nonheldout_temporal_val_overlap_exclusion' ELSE 'nonheldout_temporal_test_unused' END AS selection_reason
  FROM (SELECT base.*, r.r_name AS held_out_region, 'loro_' || r.r_name AS fold_id, base.region_id = r.r_name AS held FROM base, region r))"""


@query(duck(*C) + _LORO + " SELECT fold_id, chip_id, experiment_split, selection_reason FROM loro")
def loro_folds(t: Tables) -> DataFrame:
    return policy.held_out_folds(_with_roles(t), REGIONS).select("fold_id", "chip_id", "experiment_split", "selection_reason")


@query(duck(*C) + _LORO + " SELECT fold_id, selection_reason, count(*) AS chips, 0 AS violations FROM loro GROUP BY 1, 2")
def fold_leakage(t: Tables) -> DataFrame:
    folds = policy.held_out_folds(_with_roles(t), REGIONS)
    broken = rules.fold_leakage(folds).groupBy(F.substring_index("candidate_id", "/", 1).alias("fold_id")).agg(F.count(F.lit(1)).cast("int").alias("violations"))
    return A.exclusion_counts(folds, "fold_id").join(broken, "fold_id", "left").na.fill(0, ["violations"])


@query(duck(*C) + _LORO + """
SELECT fold_id, experiment_split, count(*) AS chips, count(DISTINCT source_tiff_id) AS sources, count(DISTINCT region_id) AS regions, string_agg(DISTINCT region_id, ';' ORDER BY region_id) AS region_ids, min(acquisition_date) AS first_date, max(acquisition_date) AS last_date
FROM loro WHERE experiment_split <> '' GROUP BY 1, 2""")
def fold_summary(t: Tables) -> DataFrame:
    return A.held_out_summary(_with_roles(t), REGIONS)


@query(duck(*C) + _ROLES + """,
sel AS (SELECT *, total_pixel_count + chip_index AS byte_size FROM base WHERE experiment_split <> ''),
g AS (SELECT 'split' AS grouping, '' AS value, * FROM sel UNION ALL SELECT 'region', region_id, * FROM sel UNION ALL SELECT 'date', acquisition_date::VARCHAR, * FROM sel UNION ALL SELECT 'class', class_presence, * FROM sel UNION ALL SELECT 'source', source_tiff_id, * FROM sel)
SELECT experiment_split, grouping, value, count(*) AS chips, count(DISTINCT source_tiff_id) AS sources, sum(byte_size) AS bytes FROM g GROUP BY 1, 2, 3""")
def fold_inventory(t: Tables) -> DataFrame:
    files = t["chips"].select("chip_id", (F.col("total_pixel_count") + F.col("chip_index")).alias("byte_size"))
    return A.selected_inventory(policy.baseline_fold(_with_roles(t)), files)


@query("""
WITH r AS (SELECT p_partkey, (256 + 40 * p_size)::INT AS width, (200 + p_partkey % 700)::INT AS height FROM part),
w AS (SELECT *, unnest(CASE WHEN height < 256 THEN [0] ELSE range(0, height - 256 + 1, 128) END) AS row_off FROM r), x AS (SELECT *, unnest(CASE WHEN width < 256 THEN [0] ELSE range(0, width - 256 + 1, 128) END) AS col_off FROM w)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY row_off, col_off) - 1 AS chip_index, row_off, col_off, least(height, 256) AS chip_height, least(width, 256) AS chip_width,
  100.0 + 10 * col_off AS minx, 200.0 - 10 * (row_off + least(height, 256)) AS miny, 100.0 + 10 * (col_off + least(width, 256)) AS maxx, 200.0 - 10 * row_off AS maxy FROM x""")
def window_grid(t: Tables) -> DataFrame:
    rasters = t["part"].select("p_partkey", (256 + 40 * F.col("p_size")).cast("int").alias("width"), (200 + F.pmod("p_partkey", F.lit(700))).cast("int").alias("height"))
    affine = dict(zip("abcdef", (10.0, 0.0, 100.0, 0.0, -10.0, 200.0), strict=True))
    out = grid.window_bounds(grid.window_grid(rasters, 256, 128).withColumns({f"transform_{k}": F.lit(v) for k, v in affine.items()}))
    return out.select("p_partkey", "chip_index", "row_off", "col_off", "chip_height", "chip_width", "minx", "miny", "maxx", "maxy")


@query(f"""WITH {PIXELS},
tile AS (SELECT vec_id, vec_id // 4 AS s, 4 * ((vec_id % 4) // 2) + i // 8 AS r, 4 * (vec_id % 2) + i % 8 AS c, x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)),
lab AS (SELECT *, CASE WHEN (7 * s + 3 * r + c) % 5 = 0 THEN -100 ELSE (s + r + c) % 2 END AS label, floor(10 * least(1.0, greatest(0.0, (CAST(x AS DOUBLE) + 1) / 2))) AS v FROM tile)
SELECT 'chip_' || vec_id AS chip_id, 64 AS total_pixel_count, count(*) FILTER (label = 0) AS class_0_pixel_count, count(*) FILTER (label = 1) AS class_1_pixel_count, count(*) FILTER (label = -100) AS ignore_pixel_count,
  count(*) FILTER (v = 4) AS nodata_pixel_count, 100.0 * count(*) FILTER (v = 4) / 64 AS nodata_pct FROM lab GROUP BY vec_id""")
def chip_pixel_counts(t: Tables) -> DataFrame:
    tiles = t.tiles().withColumn("image", F.transform("probability", lambda p: F.floor(10 * p).cast("int"))).withColumn("b", F.lit(1))
    return A.tile_counts(tiles, [0, 1], 4).select("chip_id", "total_pixel_count", "class_0_pixel_count", "class_1_pixel_count", "ignore_pixel_count", "nodata_pixel_count", "nodata_pct")


@query("SELECT l_returnflag, count(*) AS n_pixels, " + ", ".join(f"round(avg({c} / 255), 6) AS mean_{k}, round(coalesce(stddev_samp({c} / 255), 0), 6) AS std_{k}" for k, c in enumerate(("l_quantity", "l_extendedprice", "l_discount", "l_tax"))) + " FROM lineitem WHERE greatest(l_quantity, l_extendedprice, l_discount, l_tax) > 0 GROUP BY 1")
def channel_stats(t: Tables) -> DataFrame:
    out = A.channel_stats(t.band_pixels(), ["l_returnflag"], 4, 255)
    return rounded(out, *[f"{m}_{k}" for k in range(4) for m in ("mean", "std")])


@query(f"WITH {PIXELS} SELECT source_tiff_id, row, col, round(probability, 6) AS probability, coverage, label, mask, FALSE AS conflict FROM cov")
def overlap_reconstruct(t: Tables) -> DataFrame:
    return rounded(overlap.reconstruct(t.tiles()), "probability")


_RATIO = """round(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall,
 round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0), 6) AS iou, round(CAST(tn AS DOUBLE) / nullif(tn + fp + fn, 0), 6) AS background_iou,
 round((CAST(tp AS DOUBLE) / nullif(tp + fp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp + fn, 0)) / 2, 6) AS macro_iou, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS dice"""
_CELLS = "count(*) FILTER (label = 0 AND mask = 0) AS tn, count(*) FILTER (label = 0 AND mask = 1) AS fp, count(*) FILTER (label = 1 AND mask = 0) AS fn, count(*) FILTER (label = 1 AND mask = 1) AS tp"
_METRICS = f""", m AS (SELECT source_tiff_id, concat('r', s % 5) AS region_id, {_CELLS}, count(*) FILTER (label <> -100) AS scored, count(*) FILTER (label = -100) AS ignored, count(*) AS covered FROM cov GROUP BY s, source_tiff_id)"""
_NAMED = "tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive"


def _metrics(t: Tables, threshold: float = 0.5) -> DataFrame:
    tiles = t.tiles()
    sources = tiles.select("source_tiff_id", F.concat(F.lit("r"), F.pmod("s", F.lit(5))).alias("region_id"), F.lit(144).cast("long").alias("total_source_pixel_count")).distinct()
    return A.source_metrics(overlap.reconstruct(tiles, threshold), sources)


@query(f"WITH {PIXELS}{_METRICS} SELECT source_tiff_id, region_id, {_NAMED}, scored AS scored_pixel_count, ignored AS ignored_pixel_count, covered AS covered_pixel_count, 144 - covered AS uncovered_pixel_count, 144 AS total_source_pixel_count, {_RATIO} FROM m")
def source_metrics(t: Tables) -> DataFrame:
    return rounded(_metrics(t), *M.RATIOS)


@query(f"""WITH {PIXELS}{_METRICS}, p AS (SELECT scope, count(*) AS source_count, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp, sum(covered) AS covered FROM (SELECT 'all' AS scope, * FROM m UNION ALL SELECT region_id, * FROM m) GROUP BY 1)
SELECT scope, source_count, {_NAMED}, covered AS covered_pixel_count, {_RATIO} FROM p""")
def region_metrics(t: Tables) -> DataFrame:
    return rounded(A.region_metrics(_metrics(t)), *M.RATIOS).drop("scored_pixel_count", "ignored_pixel_count", "uncovered_pixel_count", "total_source_pixel_count")


@query("""
WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY ALL), k AS (SELECT unnest([0, 1]) AS class),
m AS (SELECT class, coalesce(sum(n) FILTER (a = class AND b = class), 0) AS tp, coalesce(sum(n) FILTER (a <> class AND b = class), 0) AS fp, coalesce(sum(n) FILTER (a = class AND b <> class), 0) AS fn FROM k, c GROUP BY 1)
SELECT class, tp, fp, fn, round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1,
  round((SELECT avg(tp / nullif(tp + fp + fn, 0)) FROM m WHERE class > 0), 6) AS mean_iou FROM m""")
def multiclass_metrics(t: Tables) -> DataFrame:
    return rounded(A.multiclass_metrics(t["labels"], "quality", "toxic", [0, 1]), "iou", "precision", "recall", "f1", "mean_iou")


@query(f"SELECT d.lang AS phase, l.doc_id % 3 AS epoch, {_RATIO} FROM (SELECT doc_id, quality, toxic FROM labels) l JOIN documents d USING (doc_id) GROUP BY 1, 2".replace("SELECT d.lang AS phase, l.doc_id % 3 AS epoch", "SELECT phase, epoch").replace("FROM (SELECT doc_id, quality, toxic FROM labels) l JOIN documents d USING (doc_id) GROUP BY 1, 2", f"FROM (SELECT phase, epoch, {_CELLS} FROM (SELECT d.lang AS phase, l.doc_id % 3 AS epoch, quality AS label, toxic AS mask FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1, 2)"))
def phase_metrics(t: Tables) -> DataFrame:
    log = t["labels"].join(t["documents"].select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("phase"), F.pmod("doc_id", F.lit(3)).alias("epoch"), F.col("quality").alias("label"), F.col("toxic").alias("mask"))
    return rounded(A.phase_metrics(log), *M.RATIOS)


@query("""WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), q AS (SELECT label, x, CASE WHEN i % 7 = 0 THEN -100 ELSE (i % 2) END AS y FROM p)
SELECT label, round(avg(CASE WHEN y <> -100 THEN greatest(x, 0) - x * (y * 0.9 + 0.05) + ln(1 + exp(-abs(x))) END), 6) AS loss FROM q GROUP BY 1""")
def smoothed_bce(t: Tables) -> DataFrame:
    pixels = t["embeddings"].select("label", F.posexplode("embedding").alias("i", "x"))
    y = F.when(F.pmod("i", F.lit(7)) == 0, -100).otherwise(F.pmod("i", F.lit(2)))
    return rounded(pixels.groupBy("label").agg(M.by_name("bce")(F.col("x").cast("double"), y, 0.1).alias("loss")), "loss")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: 5 * x::DOUBLE) AS z FROM embeddings),
l AS (SELECT vec_id % 5 AS batch, CASE WHEN vec_id % 7 = 0 THEN -100 ELSE label END AS y, list_transform(z, lambda x: x - list_max(z) - ln(list_sum(list_transform(z, lambda v: exp(v - list_max(z)))))) AS p FROM e)
SELECT batch, round(avg(CASE WHEN y <> -100 THEN -0.9 * p[y + 1] - 0.1 * list_avg(p) END), 6) AS loss, round(avg(CASE WHEN y <> -100 THEN -p[y + 1] END), 6) AS plain_loss FROM l GROUP BY 1""")
def multiclass_loss(t: Tables) -> DataFrame:
    """Cross-entropy over ten classes, with and without smoothed labels."""
    z = F.transform(F.slice("embedding", 1, 10), lambda x: 5 * x.cast("double"))
    y = F.when(F.pmod("vec_id", F.lit(7)) == 0, -100).otherwise(F.col("label"))
    loss = M.by_name("cross_entropy")
    return rounded(t["embeddings"].groupBy(F.pmod("vec_id", F.lit(5)).alias("batch")).agg(loss(z, y, 0.1).alias("loss"), loss(z, y).alias("plain_loss")), "loss", "plain_loss")


_IMAGE = """WITH q AS (SELECT vec_id, label, 4 * unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), v AS (SELECT vec_id, label, i, x, CASE WHEN (i + label) % 9 = 0 THEN -100 ELSE ((i + label) % 3 = 1)::INT END AS y FROM q), k AS (SELECT *, 1 / (1 + exp(-x)) AS p, greatest(x, 0) - x * y + ln(1 + exp(-abs(x))) AS e FROM v WHERE y <> -100)"""


def _logits(t: Tables) -> DataFrame:
    pixels = t["embeddings"].select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    at = F.col("i") + F.col("label")
    return pixels.select("vec_id", "label", "i", (4 * F.col("x").cast("double")).alias("x"), F.when(F.pmod(at, F.lit(9)) == 0, -100).otherwise((F.pmod(at, F.lit(3)) == 1).cast("int")).alias("y"))


@query(_IMAGE + """, s AS (SELECT label, sum(p * y) AS h, sum(p) AS g, sum(y) AS n, avg(pow(1 - exp(-e), 2) * e) AS focal FROM k GROUP BY 1)
SELECT label, round(focal, 6) AS focal, round(1 - 2 * h / (g + n), 6) AS dice, round(1 - h / (g + n - h), 6) AS jaccard, round(1 - h / (h + 0.3 * (g - h) + 0.7 * (n - h)), 6) AS tversky, round(focal + 1 - 2 * h / (g + n), 6) AS focal_dice FROM s""")
def losses_by_name(t: Tables) -> DataFrame:
    losses = {"focal": {}, "dice": {}, "jaccard": {}, "tversky": {"alpha": 0.3, "beta": 0.7}, "focal_dice": {}}
    return rounded(_logits(t).groupBy("label").agg(*[M.by_name(n)(F.col("x"), F.col("y"), **o).alias(n) for n, o in losses.items()]), *losses)


@query(_IMAGE + """, o AS (SELECT vec_id, y, 1 - x * (2 * y - 1) AS e, row_number() OVER w AS k, sum(y) OVER w AS h, sum(y) OVER (PARTITION BY vec_id) AS n FROM k WINDOW w AS (PARTITION BY vec_id ORDER BY 1 - x * (2 * y - 1) DESC, y DESC ROWS UNBOUNDED PRECEDING)),
j AS (SELECT vec_id, k, e, 1 - (n - h) / (n + k - h) AS j FROM o) SELECT vec_id, round(sum(greatest(e, 0) * d), 6) AS loss FROM (SELECT vec_id, e, j - coalesce(lag(j) OVER (PARTITION BY vec_id ORDER BY k), 0) AS d FROM j) GROUP BY 1""")
def lovasz_loss(t: Tables) -> DataFrame:
    return rounded(M.lovasz_hinge(_logits(t), ["vec_id"], "x", "y"), "loss")


def _pairs(t: Tables) -> DataFrame:
    base, held = _metrics(t), _metrics(t, 0.55)
    k = F.regexp_extract("source_tiff_id", r"(\d+)$", 1).cast("int")
    add = lambda df: df.withColumn("acquisition_date", F.lit("2020-01-01")).withColumn("chips", F.array(F.lit("c")))
    base, held = add(base.where(F.pmod(k, F.lit(11)) != 3)), add(held.where(F.pmod(k, F.lit(13)) != 4)).withColumn("ignored_pixel_count", F.when(F.pmod(k, F.lit(17)) == 5, 0).otherwise(F.col("ignored_pixel_count")))
    expected = t.tiles().select(F.concat(F.lit("r"), F.pmod("s", F.lit(5))).alias("region_id"), "source_tiff_id").distinct()
    return joins.model_pairs(expected, base, held)


_PAIR = f"""WITH {PIXELS}, m0 AS (SELECT s, source_tiff_id, concat('r', s % 5) AS region_id, mask AS mask1, CASE WHEN probability >= 0.55 THEN 1 ELSE 0 END AS mask2, label FROM cov),
b AS (SELECT s, source_tiff_id, region_id, {_CELLS.replace("mask", "mask1")}, count(*) FILTER (label = -100) AS ign FROM m0 WHERE s % 11 <> 3 GROUP BY 1, 2, 3),
h AS (SELECT s, source_tiff_id, region_id, {_CELLS.replace("mask", "mask2")}, CASE WHEN s % 17 = 5 THEN 0 ELSE count(*) FILTER (label = -100) END AS ign FROM m0 WHERE s % 13 <> 4 GROUP BY 1, 2, 3),
j AS (SELECT e.s, e.source_tiff_id, e.region_id, b.tp / nullif(b.tp + b.fp + b.fn, 0) AS bi, h.tp / nullif(h.tp + h.fp + h.fn, 0) AS hi,
  concat_ws(';', CASE WHEN b.ign IS NOT NULL AND h.ign IS NOT NULL AND b.ign <> h.ign THEN 'ignored_pixel_count_mismatch' END, CASE WHEN b.s IS NULL THEN 'missing_baseline_metrics' END, CASE WHEN h.s IS NULL THEN 'missing_loro_metrics' END) AS reasons
  FROM (SELECT DISTINCT s, source_tiff_id, region_id FROM m0) e LEFT JOIN b USING (s) LEFT JOIN h USING (s))"""


@query(_PAIR + " SELECT region_id, source_tiff_id, reasons AS exclusion_reasons, round(CASE WHEN reasons = '' THEN hi - bi END, 6) AS delta FROM j")
def model_pair_compare(t: Tables) -> DataFrame:
    delta = F.when(F.col("exclusion_reasons") == "", F.col("h.iou") - F.col("b.iou"))
    return rounded(_pairs(t).select("region_id", "source_tiff_id", "exclusion_reasons", delta.alias("delta")), "delta")


def _deltas(t: Tables) -> DataFrame:
    return _pairs(t).where("exclusion_reasons = ''").select("region_id", "source_tiff_id", F.round(F.col("h.iou") - F.col("b.iou"), 9).alias("delta"))


_DELTA = _PAIR + ", d AS (SELECT region_id, source_tiff_id, round(hi - bi, 9) AS delta FROM j WHERE reasons = '')"


@query(_DELTA + """ SELECT scope, count(delta) AS n, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.5), 6) AS median, round(quantile_cont(delta, 0.25), 6) AS q1, round(quantile_cont(delta, 0.75), 6) AS q3
FROM (SELECT 'all_tiffs' AS scope, * FROM d UNION ALL SELECT region_id, * FROM d) GROUP BY 1""")
def delta_summary(t: Tables) -> DataFrame:
    return rounded(A.delta_summary(_deltas(t)), "mean", "median", "q1", "q3")


@query(_DELTA + """ SELECT * FROM (SELECT *, 'lowest' AS "end" FROM d WHERE delta IS NOT NULL ORDER BY delta, source_tiff_id LIMIT 5) UNION ALL SELECT * FROM (SELECT *, 'highest' AS "end" FROM d WHERE delta IS NOT NULL ORDER BY delta DESC, source_tiff_id LIMIT 5)""")
def extreme_deltas(t: Tables) -> DataFrame:
    return ranking.extremes(_deltas(t))


@query()
def bootstrap_ci(t: Tables) -> DataFrame:
    return A.bootstrap_interval_by_bins(_deltas(t))


@query(_PAIR + """, long AS (SELECT region_id, 'b' AS model, tn, fp, fn, tp FROM b WHERE s IN (SELECT s FROM j WHERE reasons = '') UNION ALL SELECT region_id, 'h', tn, fp, fn, tp FROM h WHERE s IN (SELECT s FROM j WHERE reasons = '')),
p AS (SELECT scope, model, sum(tp) / nullif(sum(tp + fp + fn), 0) AS iou FROM (SELECT 'all_pixels' AS scope, * FROM long UNION ALL SELECT region_id, * FROM long) GROUP BY 1, 2),
q AS (SELECT * FROM p UNION ALL SELECT 'equal_region_mean', model, avg(iou) FROM p WHERE scope <> 'all_pixels' GROUP BY 2)
SELECT scope, round(max(iou) FILTER (model = 'b'), 6) AS baseline_iou, round(max(iou) FILTER (model = 'h'), 6) AS held_out_iou, round(max(iou) FILTER (model = 'h') - max(iou) FILTER (model = 'b'), 6) AS delta_iou FROM q GROUP BY 1""")
def paired_summary(t: Tables) -> DataFrame:
    out = A.paired_summary(_pairs(t).where("exclusion_reasons = ''"))
    return rounded(out.select("scope", "baseline_iou", "held_out_iou", "delta_iou"), "baseline_iou", "held_out_iou", "delta_iou")


@query(duck(*C) + """,
c AS (SELECT source_tiff_id, sum(total_pixel_count) AS cov, 1000 AS total FROM chips GROUP BY 1), h AS (SELECT source_tiff_id, sum(total_pixel_count) AS cov, 1000 AS total FROM chips WHERE nodata_pct <= 50 GROUP BY 1),
j AS (SELECT c.source_tiff_id, c.cov AS n, c.total AS nt, h.cov AS o, h.total AS ot FROM c FULL JOIN h USING (source_tiff_id))
SELECT count(*) FILTER (ot IS NOT NULL AND nt IS NOT NULL) AS shared_sources, count(*) FILTER (ot IS NULL) AS added_sources, count(*) FILTER (n < o) AS regressed_sources, sum(n) - sum(o) AS covered_gain,
  sum(n) FILTER (ot IS NOT NULL) - sum(o) AS shared_gain, round(sum(o) / sum(ot), 6) AS old_fraction, round(sum(n) / sum(nt), 6) AS new_fraction, sum(nt) - sum(n) AS uncovered FROM j""")
def coverage_comparison(t: Tables) -> DataFrame:
    def cover(df):
        return df.groupBy("source_tiff_id").agg(F.sum("total_pixel_count").alias("covered_pixel_count"), F.lit(1000).cast("long").alias("total_source_pixel_count"))

    return rounded(A.coverage_summary(joins.coverage_pairs(cover(t["chips"]), cover(t["chips"].where("nodata_pct <= 50")))), "old_fraction", "new_fraction")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - l_tax) / (l_quantity + l_tax + 1e-10), 6) AS ndvi, round((l_quantity - l_discount) / (l_quantity + l_discount + 1e-10), 6) AS gndvi,
 round(CASE WHEN l_discount < 1e-4 THEN 20.0 ELSE l_quantity / (l_discount + 1e-10) - 1 END, 4) AS ci_green FROM lineitem""")
def spectral_indices(t: Tables) -> DataFrame:
    q, d, x = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(X.normalized_difference(q, x), 6).alias("ndvi"), F.round(X.normalized_difference(q, d), 6).alias("gndvi"), F.round(X.chlorophyll_green(q, d), 4).alias("ci_green"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, list_sort(list_distinct(list_transform(embedding, lambda x: x::DOUBLE))) AS o FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(v, lambda x: least(1.0, greatest(0.0, (x - coalesce(o[2], o[1])) / (list_max(v) - coalesce(o[2], o[1]) + 1e-8))))), 6) AS total FROM b""")
def minmax_stretch(t: Tables) -> DataFrame:
    rows = t["embeddings"].select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return rows.select("vec_id", F.round(F.aggregate(X.minmax_stretch(F.col("v")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.02) AS lo, quantile_cont(l_extendedprice, 0.98) AS hi FROM lineitem WHERE l_discount > 0 GROUP BY 1)
SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_discount <= 0 OR hi <= lo THEN 0 ELSE least(1.0, greatest(0.0, (l_extendedprice - lo) / (hi - lo))) END), 6) AS mean FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1""")
def percentile_stretch(t: Tables) -> DataFrame:
    rows = t["lineitem"]
    found = quantiles.exact_quantiles(rows.where("l_discount > 0"), "l_returnflag", "l_extendedprice", (0.02, 0.98))
    ends = found.groupBy("l_returnflag").agg(*[F.max(F.when(F.col("point") == p, F.col("l_extendedprice"))).alias(c) for c, p in (("lo", 0.02), ("hi", 0.98))])
    value = X.clip_stretch(F.col("l_extendedprice"), F.col("lo"), F.col("hi"), F.col("l_discount") > 0)
    return rounded(rows.join(F.broadcast(ends), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")), "mean")


@query(f"""WITH {PIXELS}, tg AS (SELECT DISTINCT source_tiff_id, s, i // 15 AS row, i % 15 AS col FROM cov, (SELECT unnest(range(225)) AS i) t),
a AS (SELECT tg.*, cov.label FROM tg LEFT JOIN cov ON cov.s = tg.s AND cov.row = floor((tg.row + 0.5) * 0.9)::INT AND cov.col = floor((tg.col + 0.5) * 0.9)::INT)
SELECT source_tiff_id, count(*) AS pixels, count(label) AS covered, count(*) - count(label) AS outside, count(*) FILTER (label = 1) AS class_1, count(*) FILTER (label = 0) AS class_0 FROM a GROUP BY 1""")
def nearest_align(t: Tables) -> DataFrame:
    keys, tiles = ["source_tiff_id"], t.tiles()
    grid = {"t_height": 15, "t_width": 15, "x0": 0, "dx": 0.9, "y0": 0, "dy": 0.9, "origin_x": 0, "pixel_x": 1, "origin_y": 0, "pixel_y": 1}
    rasters = tiles.select(*keys).distinct().withColumns({c: F.lit(v) for c, v in grid.items()})
    found = blocks.aligned_blocks(blocks.reconstruct_blocks(tiles, keys, size=5), rasters, keys, "label", size=4)
    pixels = blocks.block_pixels(found, keys, "label").withColumn("covered", F.col("label").isNotNull())
    return A.alignment_totals(pixels, "source_tiff_id")


@query(f"""WITH {PIXELS}, v AS (SELECT s, row, col, probability AS p FROM cov)
SELECT a.source_tiff_id, a.row, a.col, round((a.probability + b.p + c.p + d.p) / 4, 6) AS value FROM cov a JOIN v b ON a.s = b.s AND a.row = b.row AND a.col + 1 = b.col JOIN v c ON a.s = c.s AND a.row + 1 = c.row AND a.col = c.col JOIN v d ON a.s = d.s AND a.row + 1 = d.row AND a.col + 1 = d.col""")
def bilinear_align(t: Tables) -> DataFrame:
    # moved by half a pixel, so each value is the mean of four
    keys, tiles = ["source_tiff_id"], t.tiles()
    sizes = tiles.groupBy(*keys).agg(F.max(F.col("row_off") + F.col("h") - 1).alias("t_height"), F.max(F.col("col_off") + F.col("w") - 1).alias("t_width"))
    rasters = sizes.withColumns({c: F.lit(v) for c, v in {"x0": 0.5, "dx": 1, "y0": 0.5, "dy": 1, "origin_x": 0, "pixel_x": 1, "origin_y": 0, "pixel_y": 1}.items()})
    found = blocks.aligned_blocks(blocks.reconstruct_blocks(tiles, keys, size=5), rasters, keys, "probability", bilinear=True, size=4)
    return rounded(blocks.block_pixels(found, keys, "probability").withColumnRenamed("probability", "value"), "value")


@query(f"""WITH {PIXELS}, n AS (SELECT a.s, a.source_tiff_id, a.row, a.col, b.row - a.row AS dr, b.col - a.col AS dc, b.probability AS p FROM cov a JOIN cov b ON a.s = b.s AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1)
SELECT source_tiff_id, row, col, round(CASE WHEN count(*) = 9 THEN degrees(atan(sqrt(pow(sum(p * dc * CASE WHEN dr = 0 THEN 2 ELSE 1 END) / 8, 2) + pow(sum(p * dr * CASE WHEN dc = 0 THEN 2 ELSE 1 END) / 8, 2)))) END, 6) AS slope FROM n GROUP BY 1, 2, 3""")
def slope3x3(t: Tables) -> DataFrame:
    # blocks of 5, so most halos come from neighbours
    keys = ["source_tiff_id"]
    found = blocks.slope_blocks(blocks.reconstruct_blocks(t.tiles(), keys, size=5), keys, "probability", size=5)
    return rounded(blocks.block_pixels(found, keys, "slope"), "slope")


@query("SELECT p_type, coalesce(arg_max(p_size % 6, (p_brand, p_partkey)) FILTER (p_size % 6 IN (1, 2, 4)), 0) AS value FROM part GROUP BY 1")
def layer_merge(t: Tables) -> DataFrame:
    layers = t["part"].select("p_type", F.pmod("p_size", F.lit(6)).alias("value"), F.struct("p_brand", "p_partkey").alias("layer"))
    return overlap.merge_layers(layers, ["p_type"], [1, 2, 4])


@query("""WITH b AS (SELECT concat('r', l_suppkey % 50) AS region_id, l_linenumber::DOUBLE AS l, (l_linenumber + l_quantity % 4 + 1)::DOUBLE AS r, (l_partkey % 9)::DOUBLE AS b, (l_partkey % 9 + l_linenumber % 3 + 1)::DOUBLE AS t FROM lineitem),
u AS (SELECT DISTINCT region_id, x, y FROM (SELECT region_id, x, unnest(range(b::INT, t::INT)) AS y FROM (SELECT *, unnest(range(l::INT, r::INT)) AS x FROM b)))
SELECT region_id, count(*)::DOUBLE AS area, round(avg(x + 0.5), 6) AS centroid_x, round(avg(y + 0.5), 6) AS centroid_y FROM u GROUP BY 1""")
def footprint_area(t: Tables) -> DataFrame:
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    boxes = t["lineitem"].select(F.concat(F.lit("r"), F.pmod("l_suppkey", F.lit(50))).alias("region_id"), line.cast("double").alias("left"), (line + F.pmod("l_quantity", F.lit(4)) + 1).cast("double").alias("right"), F.pmod(part, F.lit(9)).cast("double").alias("bottom"), (F.pmod(part, F.lit(9)) + F.pmod(line, F.lit(3)) + 1).cast("double").alias("top"))
    return rounded(grid.footprints(boxes.distinct()), "centroid_x", "centroid_y")


@query(duck(*S) + """ SELECT region_id, dataset, region_name, 0.0::DOUBLE AS "left", 100.0::DOUBLE - max(month(acquisition_date)) AS bottom, 25600.0::DOUBLE AS "right", 100.0::DOUBLE AS top, count(DISTINCT source_tiff_id) AS source_count FROM sources GROUP BY 1, 2, 3""")
def region_envelopes(t: Tables) -> DataFrame:
    affine = {"a": F.lit(10.0), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(0.0), "e": -F.month("acquisition_date").cast("double") / 1536, "f": F.lit(100.0)}
    rasters = t["sources"].withColumns({f"transform_{k}": v for k, v in affine.items()}).withColumn("width", F.col("source_width")).withColumn("height", F.col("source_height"))
    return rounded(grid.region_envelopes(grid.raster_bounds(rasters)), "bottom")


@query(duck("source_states") + " SELECT run_key, arg_max(status, seq) AS status, max(seq) AS seq, arg_max(event_id, seq) AS event_id FROM source_states GROUP BY 1")
def latest_state(t: Tables) -> DataFrame:
    return ranking.latest_state(t["source_states"], ["run_key"])


@query(duck("source_states") + """ SELECT run_key, seq, event_id, previous FROM (SELECT *, lag(status) OVER (PARTITION BY run_key ORDER BY seq) AS previous FROM source_states)
WHERE status = (SELECT min(event_type) FROM events) AND previous IS NOT NULL AND previous <> (SELECT max(event_type) FROM events)""")
def status_transitions(t: Tables) -> DataFrame:
    low, high = t["events"].agg(F.min("event_type"), F.max("event_type")).first()
    return registry.transition_faults(t["source_states"], ["run_key"], low, (high,)).select("run_key", "seq", "event_id", "previous")


@query("""WITH e AS (SELECT user_id AS run_key, event_type AS status, {'ts': ts, 'event_id': event_id} AS seq FROM events)
SELECT run_key, arg_max(status, seq) AS status, max(seq).ts AS ts, max(seq).event_id AS event_id FROM e GROUP BY 1""")
def latest_state_stream(t: Tables) -> DataFrame:
    from pyspark.sql import SparkSession

    spark: SparkSession = t.spark
    stream = spark.readStream.schema(t["events"].schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/event[s].parquet")
    stream = stream.select(F.col("user_id").alias("run_key"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("status"))
    path = scratch.path(spark, "stream")
    registry.upsert_states(stream, ["run_key"], f"{path}/table", f"{path}/checkpoint")
    return registry.read_states(spark, f"{path}/table").select("run_key", "status", "seq.ts", "seq.event_id")


@query("""SELECT 'chips/all/' || doc_id AS relative_path, n_chars AS byte_size, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'stored' ELSE sha256(coalesce(text, '')) END AS sha256, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'reused' ELSE 'fresh' END AS hash_source FROM documents""")
def file_inventory(t: Tables) -> DataFrame:
    files = t["documents"].select(F.concat(F.lit("chips/all/"), "doc_id").alias("relative_path"), F.col("n_chars").alias("byte_size"), F.lit("chip").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), "doc_id")
    prior = files.where(F.pmod("doc_id", F.lit(3)) == 0).select("relative_path", F.lit("stored").alias("sha256"), F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("byte_size")).otherwise(-1).alias("byte_size"))
    return hashing.inventory(files, prior).select("relative_path", "byte_size", "sha256", "hash_source")


@query("""WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels WHERE doc_id % 2 = 0 UNION SELECT -doc_id - 1 FROM labels WHERE doc_id % 50 = 0), m AS (SELECT doc_id FROM a EXCEPT SELECT doc_id FROM b), e AS (SELECT doc_id FROM b EXCEPT SELECT doc_id FROM a)
SELECT (SELECT count(*) FROM m) AS n_missing, (SELECT count(*) FROM e) AS n_extra, (SELECT list(doc_id ORDER BY doc_id)[1:5] FROM m) AS missing, (SELECT list(doc_id ORDER BY doc_id)[1:5] FROM e) AS extra""")
def inventory_diff(t: Tables) -> DataFrame:
    labels = t["labels"]
    right = labels.where("doc_id % 2 = 0").select("doc_id").unionByName(labels.where("doc_id % 50 = 0").select((-F.col("doc_id") - 1).alias("doc_id")))
    return sets.set_difference(t["documents"], right, "doc_id")


@query(duck(*C) + ", k AS (SELECT * FROM chips WHERE nodata_pct <= 50), r AS (SELECT * FROM chips WHERE nodata_pct > 60) SELECT 'lost_or_changed' AS fault, chip_id AS key FROM chips WHERE nodata_pct > 50 AND nodata_pct <= 60")
def partition_reconcile(t: Tables) -> DataFrame:
    chips = t["chips"]
    return sets.partition_faults(chips, chips.where("nodata_pct <= 50"), chips.where("nodata_pct > 60"), "chip_id")


@query("SELECT coalesce(string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority), '') AS labels, 1 AS rasters FROM orders GROUP BY o_custkey".replace("SELECT coalesce", "SELECT labels, count(*) AS rasters FROM (SELECT coalesce").replace(", 1 AS rasters", "") + ") GROUP BY 1")
def label_sets(t: Tables) -> DataFrame:
    return A.label_sets(t["orders"].select("o_custkey", F.col("o_orderpriority").alias("label")), "o_custkey")


@query(f"WITH {PIXELS}, n AS (SELECT source_tiff_id, row, col, 2 * probability - 1 AS a, probability - 0.4 AS b FROM cov) SELECT source_tiff_id, count(*) AS pixels, sum(CASE WHEN (a + b) / 2 > 0.5 THEN 1 ELSE 0 END) AS positives FROM n GROUP BY 1")
def logit_ensemble(t: Tables) -> DataFrame:
    pixels = overlap.reconstruct(t.tiles())
    a, b = (pixels.select("source_tiff_id", "row", "col", v.alias("logit")) for v in (2 * F.col("probability") - 1, F.col("probability") - 0.4))
    return joins.logit_ensemble(a, b, ["source_tiff_id", "row", "col"]).groupBy("source_tiff_id").agg(F.count(F.lit(1)).alias("pixels"), F.sum("mask").alias("positives"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(trunc(255 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(x AS DOUBLE) + 1) / 2))) AS INT)) AS v FROM embeddings)
SELECT concat('chip_', vec_id) AS chip_id, round(list_sum(list_transform(v, lambda x: CAST(CAST(x / greatest(list_max(v), 1) AS FLOAT) AS DOUBLE))), 6) AS total FROM v""")
def score_tiles(t: Tables) -> DataFrame:
    """A plain predictor over the tiles: the share of the image's greatest value."""
    tiles = t.tiles().withColumn("image", F.transform("probability", lambda p: (255 * p).cast("int"))).withColumn("b", F.lit(1)).select("chip_id", "h", "w", "b", "image", "label")
    return overlap.score_tiles(tiles, lambda images, labels: images[..., 0] / images.max(axis=(1, 2, 3), initial=1)[:, None, None], batched=True).select("chip_id", F.round(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT name, n AS n_rows, same FROM (SELECT count(*) AS n, count(*) FILTER (p_partkey % 50 = 1 AND p_size <> -1) = 0 AS held FROM part) x, LATERAL (VALUES ('part', TRUE, n), ('shuffled', TRUE, n), ('changed', held, n), ('repeated', n = 0, 2 * n), ('swapped', n < 2, n)) v(name, same, m), LATERAL (SELECT m) y(k)""".replace("n AS n_rows", "m AS n_rows"))
def table_fingerprint(t: Tables) -> DataFrame:
    """Whether fingerprints tell a table from its rows in another order, changed in some rows, twice, or with two swapped values."""
    part = t["part"].select("p_partkey", "p_name", "p_size")
    changed = part.withColumn("p_size", F.when(F.pmod("p_partkey", F.lit(50)) == 1, -1).otherwise(F.col("p_size")))
    first, last = part.agg(F.min("p_partkey"), F.max("p_partkey")).first()
    swapped = part.withColumn("p_partkey", F.when(F.col("p_partkey") == first, last).when(F.col("p_partkey") == last, first).otherwise(F.col("p_partkey")))
    tables = {"part": part, "shuffled": part.repartition(7, "p_name"), "changed": changed, "repeated": part.unionByName(part), "swapped": swapped}
    own = F.broadcast(hashing.table_fingerprint(part).select(F.struct("n_rows", "digest").alias("own")))  # one row
    rows = None
    for name, df in tables.items():
        found = hashing.table_fingerprint(df).crossJoin(own).select(F.lit(name).alias("name"), "n_rows", F.struct("n_rows", "digest").eqNullSafe(F.col("own")).alias("same"))
        rows = found if rows is None else rows.unionByName(found)
    return rows


from . import checks, files  # noqa: E402, F401
