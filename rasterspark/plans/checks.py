"""More queries: text fields, manifest joins, validation rules, selections and hashes, with faults planted in the tables.

Each plants its faults by a rule over the rows, in Spark and in the SQL alike, so the number of faults grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.metrics import RATIOS
from ..operators import aggregates as A
from ..operators import blocks, grid, hashing, joins, overlap, policy, ranking, rules, sets
from ..sources import scratch
from .adapters import PIXELS, Tables, duck
from .base import query, rounded
from .queries import _CELLS, _METRICS, _RATIO, _ROLES, _SPLIT, C, S, _metrics, _with_roles

_K = "CAST(substr(source_tiff_id, 5) AS BIGINT)"


def number(name: str = "source_tiff_id") -> Column:
    """The number in a source's name."""
    return F.substring(name, 5, 20).cast("long")


def each(key: Column, options: list) -> Column:
    """The options in turn."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(key, F.lit(len(options))) + 1).cast("int"))


def sql_each(key: str, options: list) -> str:
    return "[" + ", ".join("NULL" if o is None else repr(o) if not isinstance(o, str) else "'" + o.replace("'", "''") + "'" for o in options) + f"][{key} % {len(options)} + 1]"


def count_issues(issues: DataFrame) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first_id"))


def sql_issues(rows: str, key: str, **faults: str) -> str:
    cases = ", ".join(f"CASE WHEN {when} THEN '{name}' END" for name, when in faults.items())
    return f"SELECT issue_type, count(*) AS n, min(key) AS first_id FROM (SELECT CAST({key} AS VARCHAR) AS key, unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS issue_type FROM {rows}) GROUP BY 1"


# text fields and scalars

_REGION_CASE = "CASE num " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.REGION_NAMES.items()) + " END"


@query(f"""WITH n AS (SELECT o_orderkey, lpad(CAST(o_orderkey % 13 AS VARCHAR), 3, '0') AS num, CASE WHEN o_orderkey % 7 = 0 THEN '20200230' WHEN o_orderkey % 11 = 0 THEN '2020' ELSE strftime(o_orderdate, '%Y%m%d') END AS day FROM orders),
d AS (SELECT *, {_REGION_CASE} AS label, CASE WHEN length(day) = 8 THEN CAST(try_strptime(day, '%Y%m%d') AS DATE) END AS d FROM n)
SELECT o_orderkey, CASE WHEN label IS NOT NULL AND d IS NOT NULL THEN 'ca_' || num END AS region_id, CASE WHEN d IS NOT NULL THEN label END AS region_name, CASE WHEN label IS NOT NULL THEN d END AS acquisition_date, CASE WHEN d IS NOT NULL THEN 'bc' END AS dated_region, d AS dated_day FROM d""")
def source_names(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.when(F.pmod(k, F.lit(7)) == 0, "20200230").when(F.pmod(k, F.lit(11)) == 0, "2020").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    names = t["orders"].select(k, F.concat_ws("_", F.lpad(F.pmod(k, F.lit(13)).cast("string"), 3, "0"), day, F.lit("x")).alias("name"))
    found = names.select(k, X.region_source(F.col("name")).alias("r"), X.dated_source(F.substring("name", 5, 40)).alias("d"))
    return found.select(k, "r.region_id", "r.region_name", "r.acquisition_date", F.col("d.region_id").alias("dated_region"), F.col("d.acquisition_date").alias("dated_day"))


_ISO = ["1997-02-28", "1997-02-30", "1997-2-3", None, "19970228"]
_BOOL = [" TRUE ", "false", "yes", None, "tRue", ""]
_PATHS = ["chips/a.npz", "/abs/a", "a//b", "a/../b", "C:/x", "a\\b", "", "./a", None, "a/b.c/..d"]
_LEAKS = ["see /home/x/y", "C:\\temp\\a", "rel/home/x", 'in "/root/x"', "none", "k=/tmp/z"]
_METRIC = ["run-val-iou-0.75.ckpt", "val-iou-1", "val-iou-x", "best", "val-iou-.5"]
_CELL = ["0.5", "none", "0.5000000000001", "x", None, "0.51", ""]


@query(f"""WITH o AS (SELECT o_orderkey AS k, {sql_each("o_orderkey", _ISO)} AS iso, {sql_each("o_orderkey", _BOOL)} AS flag, {sql_each("o_orderkey", _PATHS)} AS path, {sql_each("o_orderkey", _LEAKS)} AS leak, {sql_each("o_orderkey", _METRIC)} AS metric,
  {sql_each("o_orderkey", _CELL)} AS cell, CASE WHEN o_orderkey % 3 < 2 THEN 0.5::DOUBLE END AS v, CAST(CAST(o_orderkey % 50 AS VARCHAR) || '.' || CAST(o_orderkey % 4 * 250 AS VARCHAR) AS DECIMAL(18, 4)) AS dec FROM orders)
SELECT k, CASE WHEN regexp_full_match(iso, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(iso AS DATE) END AS iso, CASE lower(trim(flag)) WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS flag,
  coalesce(path <> '' AND NOT contains(path, '\\') AND NOT starts_with(path, '/') AND NOT regexp_matches(path, '(^|/)(\\.|\\.\\.|)(/|$)') AND NOT regexp_matches(path, '^[A-Za-z]:'), FALSE) AS portable,
  regexp_matches(leak, '(?:^|[\\s"''=:(,])/(?:home|root|mnt|tmp|Users|data|workspace)/|[A-Za-z]:\\\\') AS leaks, try_cast(regexp_extract(metric, 'val-iou-([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS metric,
  CASE WHEN v IS NULL THEN coalesce(lower(trim(cell)), '') IN ('', 'none', 'nan') ELSE coalesce(abs(try_cast(cell AS DOUBLE) - v) <= 1e-12, FALSE) END AS same, CASE WHEN contains(CAST(dec AS VARCHAR), '.') THEN regexp_replace(rtrim(CAST(dec AS VARCHAR), '0'), '\\.$', '') ELSE CAST(dec AS VARCHAR) END AS decimal_text FROM o""")
def text_fields(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    value = F.when(F.pmod(k, F.lit(3)) < 2, 0.5)
    number = F.concat_ws(".", F.pmod(k, F.lit(50)).cast("string"), (F.pmod(k, F.lit(4)) * 250).cast("string")).cast("decimal(18,4)")
    return t["orders"].select(
        k.alias("k"), X.iso_date(each(k, _ISO)).alias("iso"), X.strict_bool(each(k, _BOOL)).alias("flag"), X.portable_path(each(k, _PATHS)).alias("portable"), X.leaks_absolute_path(each(k, _LEAKS)).alias("leaks"),
        X.metric_in_name(each(k, _METRIC)).alias("metric"), X.text_equals(each(k, _CELL), value).alias("same"), X.decimal_text(number).alias("decimal_text"),
    )


@query("""WITH l AS (SELECT l_linenumber - 2 AS x, CAST(trunc(l_extendedprice) AS INT) AS a, CAST(l_quantity AS INT) - 2 AS b FROM lineitem)
SELECT CASE x WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 4 THEN 0 ELSE -100 END AS label, least(a, b) >= 0 AND greatest(a, b) <= 65535 AS fits, count(*) AS n FROM l GROUP BY 1, 2""")
def label_remap(t: Tables) -> DataFrame:
    values = F.array(F.col("l_extendedprice").cast("int"), F.col("l_quantity").cast("int") - 2)
    rows = t["lineitem"].select(X.remap_labels(F.array(F.col("l_linenumber") - 2), (0, 1, 0, -100, 0))[0].alias("label"), X.in_dtype(values, "uint16").alias("fits"))
    return A.count_by(rows, "label", "fits")


@query("""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL ELSE 10.0::DOUBLE * p_size END AS a, CASE WHEN p_partkey % 7 = 6 THEN NULL WHEN p_partkey % 11 = 10 THEN 'nan'::DOUBLE WHEN p_partkey % 13 = 12 THEN 10 * p_size + 0.5::DOUBLE WHEN p_partkey % 3 = 2 THEN 1 ELSE 10.0::DOUBLE * p_size END AS b FROM part),
e AS (SELECT *, CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'partly_missing' WHEN a IS NULL THEN NULL WHEN isnan(a) OR isnan(b) THEN 'not_finite' WHEN a > 255 OR a <> floor(a) OR b > 65535 OR b <> floor(b) THEN 'not_representable' WHEN a <> b THEN 'inconsistent' END AS error FROM p)
SELECT p_partkey, CASE WHEN error IS NULL THEN coalesce(a, 7.0) END AS value, error FROM e""")
def declared_nodata(t: Tables) -> DataFrame:
    k, v = F.col("p_partkey"), 10.0 * F.col("p_size")
    m = lambda n, r: F.pmod(k, F.lit(n)) == r
    first = F.when(~m(5, 4), v)
    second = F.when(m(7, 6), None).when(m(11, 10), float("nan")).when(m(13, 12), v + 0.5).when(m(3, 2), 1.0).otherwise(v)
    return t["part"].select(k, X.effective_nodata(F.array(first, second), F.array(F.lit("uint8"), F.lit("uint16")), 7.0).alias("n")).select(k, "n.*")


_BANDS = {"blue": "l_linenumber", "green": "l_discount", "red": "l_tax", "red_edge": "l_quantity", "nir": "l_extendedprice"}
_INDEX = [*_BANDS.values(), *[f"({a} - {b}) / ({a} + {b} + 1e-10)" for a, b in (("l_extendedprice", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_quantity"), ("l_discount", "l_extendedprice"))], "CASE WHEN l_discount < 1e-4 THEN 20.0 ELSE l_extendedprice / (l_discount + 1e-10) - 1 END"]


@query("SELECT l_returnflag, " + ", ".join(f"round(avg((CAST({x} AS DOUBLE) - {k}) / {k + 1}), 4) AS b{k}, round(avg((CAST({x} AS DOUBLE) / 255 - 0.4) / 0.2), 4) AS i{k}" for k, x in enumerate(_INDEX)) + " FROM lineitem GROUP BY 1")
def band_stack(t: Tables) -> DataFrame:
    n = len(_INDEX)
    stack = X.index_stack({k: F.col(v).cast("double") for k, v in _BANDS.items()})
    rows = t["lineitem"].select("l_returnflag", X.standardize(stack, tuple(range(n)), tuple(range(1, n + 1))).alias("b"), X.standardize(stack, (0.4,) * n, (0.2,) * n, 255.0).alias("i"))
    return rows.groupBy("l_returnflag").agg(*[F.round(F.avg(F.col(c)[k]), 4).alias(f"{c}{k}") for k in range(n) for c in "bi"])


@query("""SELECT coalesce(CASE WHEN p_size % 3 > 0 THEN -1.0 * p_size END, -2000.0)::DOUBLE AS bathymetry, coalesce(CASE WHEN p_size % 4 > 0 THEN 0.5 * p_size END, 85.0)::DOUBLE AS slope, coalesce(CASE WHEN p_size % 5 > 0 THEN p_size END, 0) AS substrate,
 coalesce(CASE WHEN p_size % 2 > 0 THEN 'all_retained' END, 'selected_nonoverlap') AS scope, count(*) AS n FROM part GROUP BY ALL""")
def filled_layers(t: Tables) -> DataFrame:
    v = F.col("p_size")
    some = lambda m, x: F.when(v % m > 0, x)
    rows = t["part"].select(X.fill_layers(some(3, -1.0 * v), some(4, 0.5 * v), some(5, v)).alias("f"), X.scope_or_default(some(2, F.lit("all_retained"))).alias("scope")).select("f.*", "scope")
    return A.count_by(rows, "bathymetry", "slope", "substrate", "scope")


@query(duck(*C) + _ROLES + """, b AS (SELECT *, CASE WHEN l % 41 = 7 THEN 'other' ELSE selection_reason END AS r FROM (SELECT *, CAST(substr(source_tiff_id, 5) AS BIGINT) + chip_index AS l FROM base) WHERE time = 'TEST')
SELECT 'selected_nonoverlap' AS scope, TRUE AS allowed, experiment_split, count(*) AS chips FROM base WHERE experiment_split = 'test' GROUP BY 3
UNION ALL SELECT 'all_retained', (experiment_split = 'test' AND r = 'selected') OR (experiment_split = '' AND r = 'test_overlap_exclusion'), experiment_split, count(*) FROM b GROUP BY 2, 3""")
def scope_rows(t: Tables) -> DataFrame:
    folds = policy.baseline_fold(_with_roles(t))
    odd = (F.col("source_temporal_split") == "TEST") & (F.pmod(number() + F.col("chip_index"), F.lit(41)) == 7)
    folds = folds.withColumn("selection_reason", F.when(odd, "other").otherwise(F.col("selection_reason")))
    parts = [df.select(F.lit(scope).alias("scope"), F.lit(fine).alias("allowed"), "experiment_split") for scope in ("selected_nonoverlap", "all_retained") for df, fine in zip(rules.scope_rows(folds, scope), (True, False), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("scope", "allowed", "experiment_split").agg(F.count(F.lit(1)).alias("chips"))


# row generation and overlap

@query(f"""WITH {PIXELS}, w AS (SELECT unnest([0, 4]) AS row_off), x AS (SELECT row_off, unnest([0, 4]) AS col_off FROM w)
SELECT source_tiff_id, row_off, col_off, count(*) AS pixels, sum((row - row_off) * 8 + col - col_off) AS places, count(*) FILTER (label = 1) AS class_1 FROM cov JOIN x ON row >= row_off AND row < row_off + 8 AND col >= col_off AND col < col_off + 8 GROUP BY ALL""")
def chip_cut(t: Tables) -> DataFrame:
    source = blocks.reconstruct_blocks(t.tiles(), ["source_tiff_id"], size=5).withColumns({"source_height": F.lit(12), "source_width": F.lit(12)})
    chips = blocks.cut_windows(source, ["source_tiff_id"], ["label", "coverage"], 8, 4)
    place = F.transform("coverage", lambda c, i: F.when(c.isNotNull(), i))
    return chips.select("source_tiff_id", "row_off", "col_off", F.size(F.array_compact("coverage")).cast("long").alias("pixels"), F.aggregate(F.array_compact(place), F.lit(0).cast("long"), lambda a, x: a + x).alias("places"), F.size(F.filter("label", lambda x: x == 1)).cast("long").alias("class_1"))


@query("""SELECT concat('chip_', vec_id) AS chip_id, CASE vec_id % 7 WHEN 1 THEN 'bounds' WHEN 2 THEN 'probability' WHEN 3 THEN 'shape' WHEN 4 THEN 'probability' END AS fault FROM embeddings WHERE vec_id % 7 BETWEEN 1 AND 4""")
def tile_faults(t: Tables) -> DataFrame:
    k, p = F.pmod(F.substring("chip_id", 6, 20).cast("long"), F.lit(7)), F.col("probability")
    tiles = t.tiles().withColumn("row_off", F.when(k == 1, 7).otherwise(F.col("row_off")))
    bad = F.when(k == 2, F.transform(p, lambda x, i: F.when(i == 63, 1.5).otherwise(x))).when(k == 3, F.slice(p, 1, 60)).when(k == 4, F.transform(p, lambda x, i: F.when(i == 0, float("nan")).otherwise(x))).otherwise(p)
    return overlap.tile_faults(tiles.withColumn("probability", bad))


@query(f"""WITH {PIXELS}, q AS (SELECT vec_id, p, CASE WHEN (7 * s + 3 * r + c) % 5 = 0 THEN -100 ELSE (s + r + c) % 2 END AS label, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS mask FROM (
  SELECT vec_id, vec_id // 4 AS s, 4 * ((vec_id % 4) // 2) + i // 8 AS r, 4 * (vec_id % 2) + i % 8 AS c, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(x AS DOUBLE) + 1) / 2)) AS p FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings))),
m AS (SELECT vec_id, {_CELLS} FROM q GROUP BY 1) SELECT concat('chip_', vec_id) AS chip_id, FALSE AS additive, {_RATIO} FROM m""")
def tile_diagnostics(t: Tables) -> DataFrame:
    return rounded(overlap.tile_diagnostics(t.tiles()).select("chip_id", "additive", *RATIOS), *RATIOS)


@query("SELECT concat('chip_', vec_id) AS chip_id FROM embeddings WHERE vec_id % 9 = 4")
def padded_crops(t: Tables) -> DataFrame:
    """Labels padded to 13 x 11 around the middle, some of them off by a row, and cropped again."""
    top = F.when(F.pmod(F.substring("chip_id", 6, 20).cast("long"), F.lit(9)) == 4, 3).otherwise(2)
    inside = lambda i: (F.floor(i / 11) >= top) & (F.floor(i / 11) < top + 8) & (F.pmod(i, F.lit(11)) >= 1) & (F.pmod(i, F.lit(11)) < 9)
    place = lambda i: ((F.floor(i / 11) - top) * 8 + F.pmod(i, F.lit(11)) - 1).cast("int")
    padded = F.flatten(F.transform(F.array("label"), lambda own: F.transform(F.sequence(F.lit(0), F.lit(142)), lambda i: F.when(inside(i), F.get(own, place(i))).otherwise(-7))))
    return overlap.crop_faults(t.tiles().withColumn("padded_label", padded), 13, 11)


# joins of manifests

@query(duck(*C) + f""", f AS (SELECT chip_id, CASE WHEN k % 97 = 5 THEN 'missing_source' ELSE concat_ws(',', CASE WHEN k % 53 = 1 THEN 'dataset' END, CASE WHEN chip_index = 3 AND k % 7 = 2 THEN 'acquisition_date' END) END AS faults FROM (SELECT *, {_K} AS k FROM chips))
SELECT * FROM f WHERE faults <> ''""")
def chip_source_identity(t: Tables) -> DataFrame:
    sources = t["sources"].where(F.pmod(number(), F.lit(97)) != 5).withColumn("dataset", F.when(F.pmod(number(), F.lit(53)) == 1, "other").otherwise(F.col("dataset")))
    late = (F.col("chip_index") == 3) & (F.pmod(number(), F.lit(7)) == 2)
    chips = t["chips"].withColumn("acquisition_date", F.when(late, F.date_add("acquisition_date", 1)).otherwise(F.col("acquisition_date")))
    return joins.identity_faults(chips, sources).withColumn("faults", F.array_join("faults", ","))


@query(duck(*C) + f""" SELECT lower(chip_id) AS chip_id, CASE WHEN k % 31 = 3 THEN 'missing' ELSE 'region_id' END AS fault FROM (SELECT *, {_K} + chip_index AS k FROM chips) WHERE k % 31 = 3 OR k % 37 = 4
UNION ALL SELECT lower('new_' || chip_id), 'extra' FROM chips WHERE {_K} % 1000 = 1""")
def chip_selection_match(t: Tables) -> DataFrame:
    chips, k = t["chips"], number() + F.col("chip_index")
    other = chips.where(F.pmod(k, F.lit(31)) != 3).withColumn("region_id", F.when(F.pmod(k, F.lit(37)) == 4, "?").otherwise(F.col("region_id")))
    new = chips.where(F.pmod(number(), F.lit(1000)) == 1).withColumn("chip_id", F.concat(F.lit("new_"), "chip_id"))
    return joins.selection_faults(chips, other.unionByName(new))


@query(duck(*S) + _SPLIT + f", x AS (SELECT *, {_K} AS k FROM split) SELECT lower(source_tiff_id) AS source_tiff_id, CASE WHEN k % 29 = 1 THEN 'missing' ELSE 'dataset;acquisition_date' END AS fault FROM x WHERE k % 29 = 1 OR k % 43 = 2")
def manifest_reconcile(t: Tables) -> DataFrame:
    k = number()
    split = ranking.temporal_split(t["sources"]).where(F.pmod(k, F.lit(29)) != 1).withColumn("off", F.pmod(k, F.lit(43)) == 2)
    split = split.withColumns({"source_tiff_id": F.upper("source_tiff_id"), "dataset": F.when(F.col("off"), "x").otherwise(F.col("dataset")), "acquisition_date": F.when(F.col("off"), F.date_add("acquisition_date", 40)).otherwise(F.col("acquisition_date"))})
    return joins.reconcile(t["sources"], split, "source_tiff_id", ("dataset", "region_id", "acquisition_date"))


@query(duck(*C) + f""", x AS (SELECT DISTINCT source_tiff_id, {_K} AS k FROM chips) SELECT source_tiff_id, CASE WHEN k % 29 = 1 THEN 'missing_split' WHEN k % 31 = 2 THEN 'metadata_conflict' END AS fault FROM x WHERE k % 29 = 1 OR k % 31 = 2""")
def chip_split_match(t: Tables) -> DataFrame:
    k = number()
    split = ranking.temporal_split(t["sources"]).where(F.pmod(k, F.lit(29)) != 1).withColumn("region_id", F.when(F.pmod(k, F.lit(31)) == 2, "?").otherwise(F.col("region_id")))
    return joins.split_faults(t["chips"], split)


@query(duck(*S) + f""", x AS (SELECT source_tiff_id, {_K} AS k FROM sources) SELECT source_tiff_id, unnest(list_filter([CASE WHEN k % 13 = 0 AND k % 5 <> 0 THEN 'repeated_copy' END, CASE WHEN k % 17 = 0 AND k % 7 <> 0 THEN 'repeated_alignment' END, CASE WHEN k % 7 = 0 AND k % 5 <> 0 THEN 'no_alignment' END, CASE WHEN k % 5 = 0 AND k % 7 <> 0 THEN 'no_copy' END], lambda f: f IS NOT NULL)) AS fault FROM x""")
def provenance_match(t: Tables) -> DataFrame:
    k, ids = number(), t["sources"].select("source_tiff_id")
    twice = lambda n: F.explode(F.when(F.pmod(k, F.lit(n)) == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    copies, aligned = ids.where(F.pmod(k, F.lit(5)) != 0).withColumn("i", twice(13)), ids.where(F.pmod(k, F.lit(7)) != 0).withColumn("i", twice(17))
    return joins.provenance_faults(copies, aligned)


@query(duck(*C) + _ROLES + f""", f AS (SELECT *, {_K} + chip_index AS k FROM base) SELECT fate, count(*) AS chips, sum(row_off) AS rows FROM (
  SELECT CASE WHEN k % 19 = 1 THEN 'missing' WHEN k % 23 = 2 THEN 'other_source' ELSE 'found' END AS fate, CASE WHEN k % 19 = 1 OR k % 23 = 2 THEN 0 ELSE row_off END AS row_off FROM f WHERE experiment_split <> '') GROUP BY 1""")
def fold_chips(t: Tables) -> DataFrame:
    k = number() + F.col("chip_index")
    folds = policy.baseline_fold(_with_roles(t)).where("selected").select("chip_id", F.when(F.pmod(k, F.lit(23)) == 2, "?").otherwise(F.col("source_tiff_id")).alias("source_tiff_id"))
    found, lost = joins.fold_chips(folds, t["chips"].where(F.pmod(k, F.lit(19)) != 1))
    fate = F.when(F.col("chip_source").isNull(), "missing").otherwise("other_source")
    rows = found.select(F.lit("found").alias("fate"), "row_off").unionByName(lost.select(fate.alias("fate"), F.lit(0).alias("row_off")))
    return rows.groupBy("fate").agg(F.count(F.lit(1)).alias("chips"), F.sum("row_off").alias("rows"))


@query(duck(*C) + f""", m AS (SELECT source_tiff_id, {_K} AS k FROM chips GROUP BY 1) SELECT source_tiff_id, CASE WHEN k % 11 = 1 THEN 'missing_raster' WHEN k % 13 = 2 THEN 'shape' ELSE 'date' END AS fault FROM m WHERE k % 11 = 1 OR k % 13 = 2 OR k % 17 = 3""")
def metrics_raster_match(t: Tables) -> DataFrame:
    k = number()
    metrics = t["chips"].groupBy("source_tiff_id").agg(F.first("acquisition_date").alias("acquisition_date"), F.lit(2560 * 1536).cast("long").alias("total_source_pixel_count"))
    metrics = metrics.withColumn("total_source_pixel_count", F.when(F.pmod(k, F.lit(13)) == 2, 1).otherwise(F.col("total_source_pixel_count")))
    rasters = t["sources"].where(F.pmod(k, F.lit(11)) != 1).select("source_tiff_id", F.col("source_width").alias("width"), F.col("source_height").alias("height"), F.when(F.pmod(k, F.lit(17)) == 3, None).otherwise(F.col("acquisition_date")).alias("acquisition_date"))
    return joins.shape_faults(metrics, rasters)


@query("""SELECT 'u' || user_id AS run_key, CASE WHEN bool_or(event_type = (SELECT min(event_type) FROM events)) THEN 'missing' ELSE 'added' END AS fault FROM events GROUP BY user_id
HAVING bool_or(event_type = (SELECT min(event_type) FROM events)) <> bool_or(event_type = (SELECT max(event_type) FROM events))""")
def run_inventories(t: Tables) -> DataFrame:
    events = t["events"]
    low, high = events.agg(F.min("event_type").alias("t")), events.agg(F.max("event_type").alias("t"))  # one row each
    runs = lambda kind: events.join(F.broadcast(kind), F.col("event_type") == F.col("t"), "left_semi").select(F.concat(F.lit("u"), "user_id").alias("run_key")).distinct()
    return joins.inventory_faults(runs(high), runs(low)).where("fault <> 'x'")


@query(duck(*C) + f""", c AS (SELECT source_tiff_id, {_K} AS k, count(*) AS chips, sum(total_pixel_count) AS pixels FROM chips GROUP BY 1)
SELECT source_tiff_id, k % 6 = 1 AS pending, k % 4 = 2 AS kept, CASE WHEN k % 4 = 2 THEN chips END AS old_chips, CASE WHEN k % 4 = 2 THEN chips + CASE WHEN k % 8 = 2 THEN 1 ELSE 0 END END AS new_chips FROM c WHERE k % 6 = 1 OR k % 4 = 2""")
def pending_and_kept(t: Tables) -> DataFrame:
    k = number()
    per = t["chips"].groupBy("source_tiff_id").agg(F.count(F.lit(1)).alias("chips"))
    todo = joins.pending(per, per.where(F.pmod(k, F.lit(6)) != 1), ["source_tiff_id"]).select("source_tiff_id", F.lit(True).alias("pending"))
    some = joins.kept(per, per.where(F.pmod(k, F.lit(4)) == 2), "source_tiff_id")
    changed = some.withColumn("chips", F.col("chips") + F.when(F.pmod(k, F.lit(8)) == 2, 1).otherwise(0))
    both = joins.side_by_side(some, changed, "source_tiff_id", ("chips",)).withColumn("kept", F.lit(True))
    out = todo.join(both, "source_tiff_id", "full_outer")
    return out.na.fill(False, ["pending", "kept"])


# validation rules

@query(duck(*C) + """, t AS (SELECT vec_id AS k, list_transform(embedding, lambda x: CAST(floor(10 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(x AS DOUBLE) + 1) / 2))) AS INT)) AS v FROM embeddings)
""" + sql_issues("t", "'chip_' || k", missing_tile="k % 13 = 1", shape="k % 13 <> 1 AND k % 11 = 2", dtype="k % 13 <> 1 AND k % 7 = 3", ignore_pixel_count="k % 13 <> 1 AND k % 5 = 4", nodata_pixel_count="k % 13 <> 1 AND len(list_filter(v, lambda x: x = 4)) <> 5"))
def tile_content(t: Tables) -> DataFrame:
    k = F.substring("chip_id", 6, 20).cast("long")
    tiles = t.tiles().withColumn("image", F.transform("probability", lambda p: F.floor(10 * p).cast("int"))).withColumn("b", F.lit(1))
    chips = A.tile_counts(tiles, [0, 1], 4).select("chip_id", F.when(F.pmod(k, F.lit(11)) == 2, 9).otherwise(8).alias("chip_height"), F.lit(8).alias("chip_width"), "class_0_pixel_count", "class_1_pixel_count", (F.col("ignore_pixel_count") + F.when(F.pmod(k, F.lit(5)) == 4, 1).otherwise(0)).alias("ignore_pixel_count"), F.lit(5).cast("long").alias("nodata_pixel_count"))
    tiles = tiles.where(F.pmod(k, F.lit(13)) != 1).withColumn("image", F.when(F.pmod(k, F.lit(7)) == 3, F.transform("image", lambda x, i: F.when((i == 9) & (x != 4), -1).when(i == 9, 300).otherwise(x))).otherwise(F.col("image")))
    return count_issues(rules.tile_content(tiles, chips, [0, 1], "uint8", 4))


@query(duck(*C) + f""", x AS (SELECT chip_id, {_K} + chip_index AS k FROM chips) """ + sql_issues("x", "chip_id", minx="k % 7 = 1", maxy="k % 11 = 2"))
def bounds_check(t: Tables) -> DataFrame:
    k = number() + F.col("chip_index")
    affine = {"a": 10.0, "b": 0.0, "c": 500.0, "d": 0.0, "e": -10.0, "f": 900.0}
    chips = grid.window_bounds(t["chips"].withColumns({f"transform_{c}": F.lit(v) for c, v in affine.items()}))
    off = lambda n, r, by: F.when(F.pmod(k, F.lit(n)) == r, by).otherwise(0.0)
    return count_issues(rules.bounds_check(chips.withColumns({"minx": F.col("minx") + off(7, 1, 0.001), "maxy": F.col("maxy") - off(11, 2, 1.0), "miny": F.col("miny") + off(13, 3, 1e-9)})))


@query(duck(*S) + f""", x AS (SELECT source_tiff_id, {_K} AS k FROM sources), y AS (SELECT source_tiff_id, CASE WHEN k % 17 = 1 THEN 'missing label' ELSE concat_ws('; ', CASE WHEN k % 7 = 1 THEN 'shape' END, CASE WHEN k % 11 = 2 THEN 'crs' END, CASE WHEN k % 13 = 3 THEN 'transform' END, CASE WHEN k % 19 = 4 THEN 'bounds' END,
  CASE WHEN k % 23 = 5 THEN 'label bands' END, CASE WHEN k % 29 = 6 THEN 'label dtype' END, CASE WHEN k % 31 = 7 THEN 'label nodata' END, CASE WHEN k % 37 = 8 THEN 'label values' END, CASE WHEN k % 41 = 9 THEN 'unlabelled nodata' END) END AS issues FROM x) SELECT * FROM y WHERE issues <> ''""")
def raster_pairs(t: Tables) -> DataFrame:
    k = number()
    at = lambda n, r, bad, good: F.when(F.pmod(k, F.lit(n)) == r, bad).otherwise(good)
    base = {"width": F.col("source_width"), "height": F.col("source_height"), "crs": F.lit("EPSG:32610"), **{f"transform_{c}": F.lit(float(i)) for i, c in enumerate("abcdef")}, **{f"bounds_{c}": F.lit(float(i)) for i, c in enumerate(("left", "bottom", "right", "top"))}}
    images = t["sources"].select("source_tiff_id", *[v.alias(n) for n, v in base.items()], F.lit(8).alias("band_count"))
    own = base | {"width": F.col("source_width") + at(7, 1, 1, 0), "crs": at(11, 2, None, F.lit("EPSG:32610")), "transform_c": F.lit(2.0) + at(13, 3, 1e-6, 1e-12), "bounds_top": F.lit(3.0) + at(19, 4, 0.1, 0.0)}
    labels = t["sources"].where(F.pmod(k, F.lit(17)) != 1).select("source_tiff_id", *[v.alias(n) for n, v in own.items()], at(23, 5, 3, 1).alias("band_count"), at(29, 6, "int16", "uint8").alias("dtype"), at(31, 7, None, F.lit(3.0)).alias("nodata"), F.array(F.lit(0), F.lit(1), at(37, 8, 5, 4)).alias("label_values"), at(41, 9, 2, 0).alias("nodata_unlabelled"))
    return rules.raster_pairs(images, labels)


@query("WITH d AS (SELECT doc_id AS k FROM documents) " + sql_issues("d", "'chips/' || k", missing_copy="k % 9 = 1", size="k % 9 <> 1 AND k % 7 = 2", hash="k % 9 <> 1 AND k % 5 = 3"))
def copy_check(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    source = t["documents"].select(k, F.concat(F.lit("chips/"), k).alias("relative_path"), F.coalesce("n_chars", F.lit(0)).alias("byte_size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    copy = source.where(F.pmod(k, F.lit(9)) != 1).select("relative_path", (F.col("byte_size") + F.when(F.pmod(k, F.lit(7)) == 2, 1).otherwise(0)).alias("byte_size"), F.when(F.pmod(k, F.lit(5)) == 3, "?").otherwise(F.col("sha256")).alias("sha256"))
    return count_issues(rules.copy_faults(source.drop("doc_id"), copy))


@query("SELECT 'o_orderstatus_value' AS issue_type, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first_id FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR o_orderstatus IS NULL HAVING count(*) > 0")
def domain_check(t: Tables) -> DataFrame:
    return count_issues(rules.domain(t["orders"], "o_orderkey", "o_orderstatus", ("F", "O")))


@query(f"WITH {PIXELS}{_METRICS}, x AS (SELECT source_tiff_id, s AS k, tp FROM (SELECT *, CAST(substr(source_tiff_id, 5) AS BIGINT) AS s FROM m)) " + sql_issues("x", "source_tiff_id", scored="k % 3 = 1", covered="(k % 3 = 1) <> (k % 5 = 2)", total="(k % 5 = 2) <> (k % 7 = 3)", iou="k % 11 = 4", f1="k % 13 = 5"))
def metric_recheck(t: Tables) -> DataFrame:
    k = number()
    off = lambda n, r, by: F.when(F.pmod(k, F.lit(n)) == r, by).otherwise(0)
    planted = {"scored_pixel_count": off(3, 1, 1), "covered_pixel_count": off(5, 2, 1), "total_source_pixel_count": off(7, 3, 1), "iou": off(11, 4, 1e-9), "f1": off(13, 5, 0.1)}
    return count_issues(rules.metric_recheck(_metrics(t).withColumns({c: F.col(c) + by for c, by in planted.items()})))


@query(duck(*C) + """, n AS (SELECT region_id, acquisition_date, count(*) AS chips, sum(class_1_pixel_count) AS kelp, sum(nodata_pixel_count) AS nodata, count(*) FILTER (chip_index <= 6) AS old_chips, coalesce(sum(class_1_pixel_count) FILTER (chip_index <= 6), 0) AS old_kelp, coalesce(sum(nodata_pixel_count) FILTER (chip_index <= 6), 0) AS old_nodata FROM chips GROUP BY 1, 2)
SELECT region_id, acquisition_date, unnest(list_filter([CASE WHEN old_chips <> chips THEN 'chips' END, CASE WHEN old_kelp <> kelp THEN 'kelp' END, CASE WHEN old_nodata <> nodata THEN 'nodata' END], lambda x: x IS NOT NULL)) AS field FROM n""")
def summary_match(t: Tables) -> DataFrame:
    """Summaries by region and date that were made before the chips of index 7 came, against the chips."""
    keys = ("region_id", "acquisition_date")
    counts = lambda some: [F.count_if(some).alias("chips"), *[F.coalesce(F.sum(F.when(some, F.col(c))), F.lit(0)).alias(n) for n, c in (("kelp", "class_1_pixel_count"), ("nodata", "nodata_pixel_count"))]]
    both = t["chips"].groupBy(*keys)
    return rules.summary_faults(both.agg(*counts(F.col("chip_index") <= 6), F.lit(1).alias("other")), both.agg(*counts(F.lit(True))), keys)


@query(f"WITH {PIXELS}{_METRICS}, x AS (SELECT source_tiff_id, CAST(substr(source_tiff_id, 5) AS BIGINT) AS k FROM m) " + sql_issues("x", "source_tiff_id", scored_pixel_count_changed="k % 3 = 1 OR k % 7 = 3", ignored_pixel_count_changed="k % 7 = 3", background_changed="k % 5 = 2 OR k % 7 = 3", foreground_changed="k % 7 = 3"))
def scope_stability(t: Tables) -> DataFrame:
    k, now = number(), _metrics(t)
    off = lambda n, r: F.when(F.pmod(k, F.lit(n)) == r, 1).otherwise(0)
    old = now.withColumns({"scored_pixel_count": F.col("scored_pixel_count") + off(3, 1), "true_negative": F.col("true_negative") + off(5, 2)}).where(F.pmod(k, F.lit(7)) != 3)
    return count_issues(rules.scope_stability(now, old, ("scored_pixel_count", "ignored_pixel_count")))


@query(f"WITH {PIXELS}{_METRICS}, x AS (SELECT source_tiff_id, CAST(substr(source_tiff_id, 5) AS BIGINT) AS k FROM m) " + sql_issues("x", "source_tiff_id", coverage_regressed="k % 3 = 1 AND k % 4 <> 2"))
def coverage_regressions(t: Tables) -> DataFrame:
    k, old = number(), _metrics(t)
    now = old.withColumn("covered_pixel_count", F.col("covered_pixel_count") - F.when(F.pmod(k, F.lit(3)) == 1, 1).when(F.pmod(k, F.lit(3)) == 2, -1).otherwise(0))
    return count_issues(rules.coverage_regressions(joins.coverage_pairs(now.where(F.pmod(k, F.lit(4)) != 2), old)))


@query("WITH x AS (SELECT event_id AS k, user_id FROM events) " + sql_issues("x", "'run' || user_id || '/' || k", unknown_run="user_id % 9 = 1", checkpoint_sha256="user_id % 9 <> 1 AND k % 7 = 2", held_out_region="user_id % 9 <> 1 AND k % 5 = 3"))
def run_identity(t: Tables) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    same = {"checkpoint_sha256": F.sha2(u.cast("string"), 256), "fold_manifest_sha256": F.lit("f"), "evaluation_scope": F.lit("all_retained"), "held_out_region": F.lit(None).cast("string")}
    rows = t["events"].select(F.concat(F.lit("run"), u).alias("run_key"), k.cast("string").alias("source_tiff_id"), *[v.alias(c) for c, v in (same | {"checkpoint_sha256": F.when(F.pmod(k, F.lit(7)) == 2, "?").otherwise(same["checkpoint_sha256"]), "held_out_region": F.when(F.pmod(k, F.lit(5)) == 3, "ASIA")}).items()])
    runs = t["events"].where(F.pmod(u, F.lit(9)) != 1).select(F.concat(F.lit("run"), u).alias("run_key"), *[v.alias(c) for c, v in same.items()]).distinct()
    return count_issues(rules.identity_columns(rows, runs))


@query("""WITH r AS (SELECT s_suppkey % 40 AS suite, s_nationkey % 5 = 0 AS base, concat('run_', s_nationkey) AS run_key, concat('r', s_nationkey % 4) AS region FROM supplier),
f AS (SELECT suite, count(*) FILTER (base) AS baselines, count(*) AS n, count(DISTINCT run_key) AS keys, coalesce(list_sort(list(DISTINCT region) FILTER (NOT base)), []) AS regions, count(*) FILTER (NOT base) AS held FROM r GROUP BY 1)
SELECT CAST(suite AS VARCHAR) AS candidate_id, unnest(list_filter([CASE WHEN baselines <> 1 THEN 'baseline_count' END, CASE WHEN n <> keys THEN 'repeated_run_key' END, CASE WHEN regions <> ['r0', 'r1', 'r2', 'r3'] THEN 'regions' END, CASE WHEN held <> 4 THEN 'region_runs' END], lambda x: x IS NOT NULL)) AS issue_type FROM f""")
def suite_check(t: Tables) -> DataFrame:
    """Suppliers as runs of forty suites: those of every fifth nation are baselines, the others hold a region out."""
    nation = F.col("s_nationkey")
    runs = t["supplier"].select(F.pmod("s_suppkey", F.lit(40)).alias("suite"), F.concat(F.lit("run_"), nation).alias("run_key"), F.when(F.pmod(nation, F.lit(5)) == 0, "baseline").otherwise("held_out").alias("run_type"), F.concat(F.lit("r"), F.pmod(nation, F.lit(4))).alias("held_out_region"))
    return rules.suite_faults(runs, [f"r{k}" for k in range(4)], ("suite",)).select("issue_type", "candidate_id")


@query(duck(*C) + f""", x AS (SELECT chip_id, {_K} + chip_index AS k, class_presence AS p FROM chips) """ + sql_issues("x", "chip_id", class_presence="k % 7 = 1 AND p <> 'ignore_only'", selected="k % 11 = 2"))
def selection_check(t: Tables) -> DataFrame:
    k = number() + F.col("chip_index")
    chosen = policy.training_selection(t["chips"])
    chosen = chosen.withColumns({"class_presence": F.when(F.pmod(k, F.lit(7)) == 1, "ignore_only").otherwise(F.col("class_presence")), "selected_for_training": F.col("selected_for_training") != (F.pmod(k, F.lit(11)) == 2)})
    return count_issues(rules.selection_consistency(chosen))


@query(duck(*C) + f""", x AS (SELECT chip_id, nodata_pct > 50 AS gone FROM chips WHERE ({_K} + chip_index) % 13 = 1)
SELECT chip_id, CASE WHEN side = 1 THEN gone ELSE NOT gone END AS removed, CASE side WHEN 1 THEN 'missing' ELSE 'unexpected' END AS side FROM x, (VALUES (1), (2)) v(side)""")
def report_replay(t: Tables) -> DataFrame:
    k = number() + F.col("chip_index")
    report = policy.filter_report(t["chips"], "50")
    flip = {"remove": ("keep", "nodata_pct_at_or_below_threshold"), "keep": ("remove", "nodata_pct_above_threshold")}
    off = lambda i, c: F.when(F.pmod(k, F.lit(13)) == 1, F.when(F.col("action") == "remove", flip["remove"][i]).otherwise(flip["keep"][i])).otherwise(F.col(c))
    stored = report.select("source_tiff_id", "chip_id", off(0, "action").alias("action"), off(1, "reason").alias("reason"))
    return rules.replay_faults(stored, t["chips"], "50").select("chip_id", (F.col("action") == "remove").alias("removed"), "side")


# aggregates and rankings

@query(f"""WITH {PIXELS}{_METRICS}, p AS (SELECT region_id, sum(tn) AS tn, sum(fp) AS fp, sum(fn) AS fn, sum(tp) AS tp FROM m GROUP BY 1), r AS (SELECT {_RATIO} FROM p)
SELECT 'equal_region_mean' AS scope, {", ".join(f"round(avg({r}), 5) AS {r}" for r in RATIOS)} FROM r""")
def equal_region_mean(t: Tables) -> DataFrame:
    return rounded(A.equal_region_mean(A.region_metrics(_metrics(t))), *RATIOS, digits=5)


@query("""WITH p AS (SELECT l_returnflag, l_tax = 0 AS empty, l_linenumber = 3 AS marked FROM lineitem)
SELECT l_returnflag, count(*) FILTER (empty AND marked) AS tp, count(*) FILTER (NOT empty AND marked) AS fp, count(*) FILTER (empty AND NOT marked) AS fn, count(*) FILTER (NOT empty AND NOT marked) AS tn FROM p GROUP BY 1""")
def mask_audit(t: Tables) -> DataFrame:
    return A.mask_audit(t["lineitem"].select("l_returnflag", (F.col("l_tax") == 0).alias("is_nodata"), F.col("l_linenumber").alias("label")), ["l_returnflag"])


@query("SELECT label, min(list_min(embedding)) AS low, max(list_max(embedding)) AS high FROM embeddings GROUP BY 1")
def value_range(t: Tables) -> DataFrame:
    return A.value_range(t["embeddings"].withColumnRenamed("embedding", "values"), "label")


@query(duck(*C) + " SELECT " + ", ".join(f"sum({c}) AS {c}" for c in A.PIXELS) + " FROM chips")
def pixel_totals(t: Tables) -> DataFrame:
    return A.pixel_totals(t["chips"])


@query("""SELECT arg_max(event_id, (r, event_id)) AS batch, round(max(r), 6) AS rate FROM (SELECT event_id, CAST(event_id AS DOUBLE) / (1 + user_id) AS r FROM events WHERE event_type <> (SELECT min(event_type) FROM events) AND value >= 0.15)""")
def best_throughput(t: Tables) -> DataFrame:
    low = t["events"].agg(F.min("event_type").alias("low"))  # one row
    log = t["events"].crossJoin(F.broadcast(low)).select(F.when(F.col("event_type") == F.col("low"), "oom").otherwise("ok").alias("status"), F.col("value").alias("headroom"), F.col("event_id").cast("double").alias("n"), (1 + F.col("user_id")).alias("elapsed"), F.col("event_id").alias("batch"))
    return rounded(A.best_throughput(log), "rate")


def _picks() -> str:
    """The first unused chip on each side of each threshold, one after the other."""
    parts, used = [], []
    for threshold in (25.0, 50.0, 60.0, 75.0):
        for side, op in (("below", "<="), ("above", ">")):
            name = f"p{len(used)}"
            skip = "".join(f" AND chip_id NOT IN (SELECT chip_id FROM {u})" for u in used)
            parts.append(f"{name} AS MATERIALIZED (SELECT {threshold}::DOUBLE AS threshold, '{side}' AS side, chip_id FROM chips WHERE nodata_pct {op} {threshold}{skip} ORDER BY abs(nodata_pct - {threshold}), class_1_pixel_count DESC, chip_id LIMIT 1)")
            used.append(name)
    return ", " + ",\n".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM {u}" for u in used)


@query(duck(*C) + _picks())
def threshold_examples(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(ranking.threshold_examples(t["chips"], (25.0, 50.0, 60.0, 75.0)), "threshold double, side string, chip_id string")


@query(duck(*C) + f""", o AS (SELECT *, chip_width < 1024 OR {_K} % 101 = 1 AS part, CASE WHEN nodata_pct = 0 THEN '0' WHEN nodata_pct <= 50 THEN 'low' ELSE 'high' END AS bin FROM chips),
w AS (SELECT *, row_number() OVER (PARTITION BY region_id ORDER BY chip_id) AS a, row_number() OVER (PARTITION BY bin ORDER BY chip_id) AS b, row_number() OVER (PARTITION BY class_presence ORDER BY chip_id) AS c FROM o)
SELECT chip_id FROM w WHERE a = 1 OR b = 1 OR c = 1 OR part""")
def qa_sample(t: Tables) -> DataFrame:
    chips = t["chips"].withColumn("bin", F.when(F.col("nodata_pct") == 0, "0").when(F.col("nodata_pct") <= 50, "low").otherwise("high"))
    chips = chips.withColumn("chip_width", F.when(F.pmod(number(), F.lit(101)) == 1, 700).otherwise(F.col("chip_width")))
    return ranking.qa_sample(chips, ["region_id", "bin", "class_presence"], ["chip_id"], "chip_id", (F.col("chip_width") < 1024) | (F.col("chip_height") < 1024)).select("chip_id")


@query("SELECT doc_id FROM documents ORDER BY sha256(concat_ws(chr(0), '9', CAST(doc_id AS VARCHAR))), doc_id LIMIT 32")
def seeded_sample(t: Tables) -> DataFrame:
    return ranking.seeded_sample(t["documents"].select("doc_id"), "doc_id", 9, 32)


@query(duck(*C) + """, g AS (SELECT region_id, 100.0 * count(*) FILTER (nodata_pct > 50) / count(*) AS removed_pct, avg(class_1_pixel_count) - avg(nodata_pixel_count) AS delta FROM chips GROUP BY 1)
SELECT (SELECT arg_max(region_id, (removed_pct, region_id)) FROM g) AS most, (SELECT arg_min(region_id, (removed_pct, region_id)) FROM g) AS least, count(*) FILTER (delta > 0) AS wins, count(delta) AS known FROM g""")
def region_extremes(t: Tables) -> DataFrame:
    regions = t["chips"].groupBy("region_id").agg(X.percentage(F.count_if(F.col("nodata_pct") > 50), F.count(F.lit(1))).alias("removed_pct"), (F.avg("class_1_pixel_count") - F.avg("nodata_pixel_count")).alias("delta"))
    return ranking.extreme_regions(regions).crossJoin(ranking.wins(regions))  # one row each


@query(duck(*S) + """, o AS (SELECT row_number() OVER (ORDER BY lower(region_id), acquisition_date, lower(source_tiff_id), source_tiff_id) AS place, source_tiff_id FROM sources)
SELECT place // 100 AS page, count(*) AS n, min(source_tiff_id) AS low, max(source_tiff_id) AS high FROM o GROUP BY 1""")
def manifest_pages(t: Tables) -> DataFrame:
    """Pages of a hundred rows of the sorted manifest; the order is the table's, so the pages show it."""
    rows = ranking.numbered(ranking.manifest_order(t["sources"].select("region_id", "acquisition_date", "source_tiff_id")), "place")
    return rows.groupBy(F.expr("place DIV 100").alias("page")).agg(F.count(F.lit(1)).alias("n"), F.min("source_tiff_id").alias("low"), F.max("source_tiff_id").alias("high"))


# set algebra

@query(duck(*C) + f""", k AS (SELECT DISTINCT {_K} AS k FROM chips)
SELECT 'added' AS what, CAST(k AS VARCHAR) AS key FROM k WHERE k % 6 = 1 UNION ALL SELECT 'missing', CAST(k AS VARCHAR) FROM k WHERE k % 6 = 2 UNION ALL SELECT 'unexpected', CAST(-k AS VARCHAR) FROM k WHERE k % 6 = 3 UNION ALL SELECT 'outside', CAST(-k AS VARCHAR) FROM k WHERE k % 6 = 3""")
def key_algebra(t: Tables) -> DataFrame:
    k = scratch.saved(t["chips"].select("source_tiff_id").distinct().select(number().alias("k")), "numbers")  # a name has one number
    m = F.pmod("k", F.lit(6))
    found = k.where(m != 2).unionByName(k.where(m == 3).select((-F.col("k")).alias("k")))
    parts = [sets.added_rows(k, k.where(m != 1), "k").select(F.lit("added").alias("what"), "k"), sets.symmetric_difference(k, found, ["k"]).select(F.col("side").alias("what"), "k"), sets.not_subset(found, k, "k").select(F.lit("outside").alias("what"), "k")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("what", F.col("k").cast("string").alias("key"))


@query(duck(*S) + f""", x AS (SELECT CASE WHEN {_K} % 501 = 1 THEN 'ca_x' ELSE dataset END AS dataset, region_id, region_name FROM sources)
SELECT region_id, count(DISTINCT dataset) AS datasets, count(DISTINCT region_name) AS names FROM x GROUP BY 1 HAVING count(DISTINCT dataset) > 1 OR count(DISTINCT region_name) > 1""")
def region_consistency(t: Tables) -> DataFrame:
    odd = F.pmod(number(), F.lit(501)) == 1
    return grid.inconsistent_regions(t["sources"].withColumn("dataset", F.when(odd, "ca_x").otherwise(F.col("dataset"))))


# policies

@query(duck(*C) + """ SELECT 'active' AS part, count(*) AS chips, sum(nodata_pixel_count) AS nodata, '50' AS threshold FROM chips WHERE nodata_pct <= 50 UNION ALL SELECT 'removed', count(*), sum(nodata_pixel_count), '50' FROM chips WHERE nodata_pct > 50
UNION ALL SELECT 'snapshot', count(*), sum(nodata_pixel_count), '50' FROM chips UNION ALL SELECT 'metadata_in', count(*), 0, '50' FROM chips UNION ALL SELECT 'metadata_out', count(*), 0, '50' FROM chips WHERE nodata_pct <= 50""")
def filter_apply(t: Tables) -> DataFrame:
    out = policy.apply_filter(t["chips"], "50")
    parts = [out[p].agg(F.lit(p).alias("part"), F.count(F.lit(1)).alias("chips"), F.sum("nodata_pixel_count").alias("nodata")) for p in ("active", "removed", "snapshot")]
    meta = out["metadata"].select(F.explode(F.array(F.struct(F.lit("metadata_in").alias("part"), F.col("input.n_rows").alias("chips")), F.struct(F.lit("metadata_out").alias("part"), F.col("output.n_rows").alias("chips")))).alias("m")).select("m.*", F.lit(0).cast("long").alias("nodata"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(meta).withColumn("threshold", F.lit("50"))


@query(duck(*C) + """ SELECT nodata_pct <= 50 AS active, count(*) AS chips, sum(class_1_pixel_count) AS kelp FROM chips GROUP BY 1""")
def repaired_parts(t: Tables) -> DataFrame:
    a, b = policy.repaired_parts(t["chips"])
    part = lambda df, name: df.agg(F.lit(name).alias("active"), F.count(F.lit(1)).alias("chips"), F.sum("class_1_pixel_count").alias("kelp"))
    return part(a, True).unionByName(part(b, False)).where("chips > 0")


@query("""WITH t AS (SELECT vec_id, list_transform(embedding, lambda x: floor(10 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(x AS DOUBLE) + 1) / 2)))) AS v FROM embeddings)
SELECT concat('chip_', vec_id) AS chip_id, len(list_filter(v, lambda x: x = 5)) AS old_nodata_pixel_count, len(list_filter(v, lambda x: x = 4)) AS new_nodata_pixel_count, 100.0::DOUBLE * len(list_filter(v, lambda x: x = 4)) / 64 AS new_nodata_pct FROM t""")
def metadata_recount(t: Tables) -> DataFrame:
    tiles = t.tiles().withColumn("image", F.transform("probability", lambda p: F.floor(10 * p).cast("int"))).withColumn("b", F.lit(1))
    stored = A.tile_counts(tiles, [0, 1], 5)
    return policy.recount(tiles, stored, 4, [0, 1]).select("chip_id", "old_nodata_pixel_count", "new_nodata_pixel_count", "new_nodata_pct")


@query(f"""WITH {PIXELS}, x AS (SELECT source_tiff_id, row, col, label, floor(10 * probability) = 5 AS empty FROM cov), tg AS (SELECT DISTINCT source_tiff_id, unnest(range(12)) AS row FROM x), g AS (SELECT source_tiff_id, row, unnest(range(12)) AS col FROM tg),
m AS (SELECT 'masked' AS family, source_tiff_id, CASE WHEN empty THEN 3 ELSE label END AS label, empty FROM x
UNION ALL SELECT 'aligned', g.source_tiff_id, CASE WHEN coalesce(i.empty, FALSE) THEN 3 WHEN l.label = 1 THEN 1 ELSE 0 END, coalesce(i.empty, FALSE) FROM g LEFT JOIN x i ON i.source_tiff_id = g.source_tiff_id AND i.row = g.row AND i.col = g.col LEFT JOIN x l ON l.source_tiff_id = g.source_tiff_id AND l.row = g.row + 2 AND l.col = g.col + 1)
SELECT family, source_tiff_id, count(*) FILTER (empty AND label = 3) AS tp, count(*) FILTER (NOT empty AND label = 3) AS fp, count(*) FILTER (empty AND label <> 3) AS fn, count(*) FILTER (NOT empty AND label <> 3) AS tn, count(*) FILTER (label = 1) AS kelp FROM m GROUP BY 1, 2""")
def label_repair(t: Tables) -> DataFrame:
    """Both families: class 3 at nodata pixels only, and a label whose grid lies two rows and a column off the image's."""
    pixels = overlap.reconstruct(t.tiles()).select("source_tiff_id", "row", "col", "label", F.array(F.floor(10 * F.col("probability")).cast("double")).alias("bands"))
    masked = policy.repair_labels(pixels, "masked", 5.0).withColumn("family", F.lit("masked"))
    whole = grid.raster_pixels(t.tiles(), ["source_tiff_id"])  # a source that its tiles don't cover has all of its pixels, too
    image = whole.join(pixels.drop("label"), ["source_tiff_id", "row", "col"], "left").select("*", (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"))
    aligned = policy.rebuild_labels(image, pixels.drop("bands"), (-1.0, -2.0), (1.0, 1.0), 5.0).withColumn("family", F.lit("aligned"))
    both = masked.select("family", "source_tiff_id", "label", "is_nodata").unionByName(aligned.select("family", "source_tiff_id", "label", "is_nodata"))
    kelp = both.groupBy("family", "source_tiff_id").agg(F.count_if(F.col("label") == 1).alias("kelp"))
    return A.mask_audit(both, ["family", "source_tiff_id"]).join(kelp, ["family", "source_tiff_id"])


#: Each condition of a package, and the events that break it: those with this remainder by this number.
_BROKEN = {
    "metadata": (29, 1), "summary": (31, 2), "metadata_checkpoint": (3, 1), "schema_version": (5, 2), "metadata_folds": (7, 3), "metadata_threshold": (11, 4), "summary_checkpoint": (4, 1), "summary_folds": (13, 6), "summary_threshold": (17, 7),
    "test_chips": (6, 5), "test_tiffs": (19, 9), "metadata_scope": (9, 2), "summary_scope": (10, 3), "selected_chips": (8, 3), "overlap_chips": (14, 5), "rasters": (15, 4), "tables": (16, 7),
}


def _broken_sql(name: str) -> str:
    """A condition fails if it is broken, if its document lacks, or if what it compares has changed with another one."""
    n, k = _BROKEN[name]
    own = f"event_id % {n} = {k}"
    document = "metadata" if name.startswith("metadata_") or name == "schema_version" else "summary" if name.startswith("summary_") or name in ("test_chips", "test_tiffs") else ""
    if name in ("selected_chips", "overlap_chips"):  # of the wider scope only
        own, document = f"wide AND ({own} OR event_id % {_BROKEN['summary'][0]} = {_BROKEN['summary'][1]})", ""
    return f"CASE WHEN {own}" + (f" OR event_id % {_BROKEN[document][0]} = {_BROKEN[document][1]}" if document else "") + f" THEN '{name}' END"


@query(duck("source_states") + """, l AS (SELECT run_key AS u, arg_max(status, seq) AS status, arg_max(event_id, seq) AS event_id FROM source_states GROUP BY 1), c AS (SELECT u, event_id, u % 5 = 0 AS base, u % 3 > 0 AS wide FROM l WHERE status = (SELECT max(event_type) FROM events)),
f AS (SELECT *, concat_ws(',', """ + ", ".join(_broken_sql(n) for n in _BROKEN) + """) AS failed FROM c)
SELECT 'run' || u AS run_key, row_number() OVER (ORDER BY NOT base, CASE WHEN base THEN '' ELSE 'r' || u % 7 END, 'run' || u) AS position, CASE WHEN failed = '' THEN 'verified' ELSE 'pending' END AS status, failed FROM f""")
def prediction_plan(t: Tables) -> DataFrame:
    """Runs of two scopes whose packages break each condition in turn."""
    top = t["events"].agg(F.max("event_type").alias("top"))  # one row
    u, e = F.col("run_key"), F.col("event_id")
    last = ranking.latest_state(t["source_states"], ["run_key"]).crossJoin(F.broadcast(top))
    scope = F.when(u % 3 > 0, "all_retained_test_chips").otherwise("selected_nonoverlap")
    states = last.select(F.when(F.col("status") == F.col("top"), "completed").alias("state"), e, F.concat(F.lit("run"), u).alias("run_key"), F.when(u % 5 == 0, "baseline").otherwise("held_out").alias("run_type"), F.when(u % 5 == 0, "").otherwise(F.concat(F.lit("r"), u % 7)).alias("held_out_region"),
                         scope.alias("evaluation_scope"), F.sha1(u.cast("string").cast("binary")).alias("checkpoint_sha256"), F.lit("folds").alias("fold_manifest_sha256"), (u % 50).alias("test_chip_count"), (u % 9).alias("test_tiff_count"), (u % 40).alias("selected_nonoverlap_chip_count"), (u % 10).alias("overlap_chip_count"))
    scope = F.col("evaluation_scope")
    breaks = lambda name: F.pmod(e, F.lit(_BROKEN[name][0])) == _BROKEN[name][1]
    but = lambda name, c, wrong: F.when(breaks(name), wrong).otherwise(F.col(c))
    more = lambda name, c: F.when(breaks(name), F.col(c) + 1).otherwise(F.col(c))
    other = F.when(scope == "selected_nonoverlap", "all_retained_test_chips")  # and none, which stands for the first
    version = F.when(breaks("schema_version"), 2).when(scope == "selected_nonoverlap", 1).otherwise(3)
    told = F.when(scope != "selected_nonoverlap", scope)
    metadata = F.struct(but("metadata_checkpoint", "checkpoint_sha256", "x").alias("checkpoint_sha256"), version.alias("schema_version"), but("metadata_folds", "fold_manifest_sha256", "x").alias("fold_manifest_sha256"), F.when(breaks("metadata_threshold"), 0.4).otherwise(0.5).alias("threshold"), F.when(breaks("metadata_scope"), other).otherwise(told).alias("evaluation_scope"))
    summary = F.struct(but("summary_checkpoint", "checkpoint_sha256", "x").alias("checkpoint_sha256"), but("summary_folds", "fold_manifest_sha256", "x").alias("fold_manifest_sha256"), F.when(~breaks("summary_threshold"), 0.5).alias("threshold"), more("test_chips", "test_chip_count").alias("test_chip_count"), more("test_tiffs", "test_tiff_count").alias("test_tiff_count"),
                       F.when(breaks("summary_scope"), other).otherwise(told).alias("evaluation_scope"), more("selected_chips", "selected_nonoverlap_chip_count").alias("selected_nonoverlap_chip_count"), more("overlap_chips", "overlap_chip_count").alias("overlap_chip_count"))
    tables = F.array(*map(F.lit, rules.PACKAGE_TABLES))
    packages = states.withColumns({
        "metadata": F.when(~breaks("metadata"), metadata), "summary": F.when(~breaks("summary"), summary), "probabilities": F.col("test_tiff_count"), "masks": more("rasters", "test_tiff_count"), "completions": F.col("test_tiff_count"),
        "tables": F.when(breaks("tables"), F.slice(tables, 1, 2)).otherwise(tables),
    })
    plan = policy.prediction_plan(packages, rules.package_conditions())
    return plan.select("run_key", "position", "status", F.array_join("failed_conditions", ",").alias("failed"))


# hashes and incremental work

@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || '}') AS identity FROM documents""")
def identity_hashes(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", hashing.identity_hash("n_chars", "lang", "doc_id").alias("identity"))


@query("""SELECT 'chips/' || k AS relative_path, CASE WHEN k % 9 = 1 THEN 'missing' WHEN k % 9 = 2 THEN 'size' ELSE 'hash' END AS fault FROM (SELECT doc_id AS k FROM documents) WHERE k % 9 IN (1, 2) OR (k % 9 = 3 AND k % 2 = 1) UNION ALL SELECT 'new/' || doc_id, 'extra' FROM documents WHERE doc_id % 50 = 0""")
def inventory_check(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    inv = t["documents"].select(k, F.concat(F.lit("chips/"), k).alias("relative_path"), F.coalesce("n_chars", F.lit(0)).alias("byte_size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.when(k % 2 == 0, "reused").otherwise("fresh").alias("hash_source"))
    found = inv.where(k % 9 != 1).withColumns({"byte_size": F.col("byte_size") + F.when(k % 9 == 2, 1).otherwise(0), "sha256": F.when((k % 9 == 3) & (k % 2 == 1), "?").otherwise(F.col("sha256"))})
    new = inv.where(k % 50 == 0).withColumn("relative_path", F.concat(F.lit("new/"), k))
    return hashing.inventory_faults(inv.drop("doc_id"), found.unionByName(new).drop("doc_id"))


@query("SELECT p_brand, min(p_partkey) AS first_key, count(*) AS n FROM part GROUP BY 1")
def delivered_once(t: Tables) -> DataFrame:
    """Rows that arrive three times, each taken once."""
    from ..streaming.registry import once_each

    part = t["part"].select("p_partkey", "p_brand")
    again = once_each(part.unionByName(part).unionByName(part.repartition(3)), "p_partkey")
    return again.groupBy("p_brand").agg(F.min("p_partkey").alias("first_key"), F.count(F.lit(1)).alias("n"))
