"""Scalar derivations and predicates as Column functions: Spark's own expressions, no Python (those over arrays with a
lambda are interpreted, not compiled)."""

from __future__ import annotations

from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100
GRID = 1024
EPS = 1e-10
#: Region names by number.
REGION_NAMES = {
    "001": "baja_islaNavidad", "002": "baja_puntaEugenia", "003": "sanDiego", "004": "palosVerdes", "005": "channelIslands", "006": "channelIslands",
    "007": "refugioStateBeach", "008": "bigSur", "009": "monterey", "010": "northernCalifornia", "011": "calvertIsland",
}
#: Right ends of the nodata bins after the bin of exactly 0.
NODATA_EDGES = (0, 1, 5, 10, 20, 30, 40, 50, 75, 100)
#: Value ranges of pixel types.
DTYPE_RANGES = {"uint8": (0, 255), "uint16": (0, 65535), "int16": (-32768, 32767), "int32": (-(2**31), 2**31 - 1)}


def compact_date(text: Column) -> Column:
    """yyyyMMdd as a date; null unless it is eight digits and a day of the calendar."""
    return F.when(text.rlike("^[0-9]{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))


def iso_date(text: Column) -> Column:
    """yyyy-MM-dd as a date; null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))


def region_source(name: Column) -> Column:
    """NNN_yyyyMMdd_... as region_id, region_name and acquisition_date; null if the name has another form."""
    number = F.regexp_extract(name, r"^(\d{3})_(\d{8})_", 1)
    day = compact_date(F.regexp_extract(name, r"^(\d{3})_(\d{8})_", 2))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in REGION_NAMES.items() for x in kv]), number)
    return F.when(label.isNotNull() & day.isNotNull(), F.struct(F.concat(F.lit("ca_"), number).alias("region_id"), label.alias("region_name"), day.alias("acquisition_date")))


def dated_source(name: Column, region: str = "bc") -> Column:
    """yyyyMMdd_... as a source of one fixed region."""
    day = compact_date(F.regexp_extract(name, r"^(\d{8})_", 1))
    return F.when(day.isNotNull(), F.struct(F.lit(region).alias("region_id"), F.lit(region).alias("region_name"), day.alias("acquisition_date")))


def year_of(day: Column) -> Column:
    return F.year(day)


def chip_id(source: Column, row: Column, col: Column, height: Column, width: Column) -> Column:
    return F.concat(source, F.lit("__r"), row, F.lit("_c"), col, F.lit("_h"), height, F.lit("_w"), width)


def chip_path(split: Column, chip: Column) -> Column:
    return F.concat(split, F.lit("/"), chip, F.lit(".npz"))


def remap_label(label: Column, table: tuple[int, ...], ignore: int = IGNORE) -> Column:
    """Table entry at the label; ignore for labels outside the table and for nulls."""
    return F.coalesce(F.when((label >= 0) & (label < len(table)), F.element_at(F.array(*map(F.lit, table)), label.cast("int") + 1)), F.lit(ignore))


def remap_labels(labels: Column, table: tuple[int, ...], ignore: int = IGNORE) -> Column:
    return F.transform(labels, lambda x: remap_label(x, table, ignore))


def in_dtype(values: Column, dtype: str) -> Column:
    low, high = DTYPE_RANGES[dtype]
    return (F.array_min(values) >= low) & (F.array_max(values) <= high)


def is_nodata(bands: Column, nodata: Column | float = 0) -> Column:
    """True if every band equals the declared value."""
    value = nodata if isinstance(nodata, Column) else F.lit(nodata)
    return F.forall(bands, lambda x: x == value)


def effective_nodata(values: Column, dtypes: Column, policy: float | None = None) -> Column:
    """Of the bands' declared values: struct of the value to use and an error (one of them null).

    All missing: the policy value, or an error. Partly missing, NaN or infinite, outside the type, not whole for an
    integer type, or unequal: an error.
    """
    known = F.filter(values, lambda v: v.isNotNull())
    used = F.when(F.size(known) == 0, F.transform(values, lambda _: F.lit(policy).cast("double"))).otherwise(values)
    low = F.create_map(*[F.lit(x) for k, (a, _) in DTYPE_RANGES.items() for x in (k, float(a))])
    high = F.create_map(*[F.lit(x) for k, (_, b) in DTYPE_RANGES.items() for x in (k, float(b))])
    fits = F.zip_with(used, dtypes, lambda v, t: F.coalesce((v >= F.try_element_at(low, t)) & (v <= F.try_element_at(high, t)) & (v == F.floor(v)), F.lit(True)))
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    error = (
        F.when((F.size(known) > 0) & (F.size(known) < F.size(values)), "partly_missing").when((F.size(known) == 0) & F.lit(policy is None), "missing")
        .when(F.exists(used, odd), "not_finite").when(~F.forall(fits, lambda x: x), "not_representable").when(F.size(F.array_distinct(used)) > 1, "inconsistent")
    )
    return F.struct(F.when(error.isNull(), F.element_at(used, 1)).alias("value"), error.alias("error"))


def percentage(part: Column, whole: Column) -> Column:
    return 100.0 * part / whole


def class_presence(class_0: Column, class_1: Column, nodata: Column) -> Column:
    return F.when(class_1 > 0, "positive").when((class_0 > 0) & (nodata == 0), "clean_background_only").when(class_0 > 0, "mixed_background_nodata").otherwise("ignore_only")


def nodata_bin(pct: Column) -> Column:
    """"0" for exactly 0, else the bin (a, b] that holds the percentage."""
    out = F.when(pct == 0, "0")
    for a, b in zip(NODATA_EDGES, NODATA_EDGES[1:], strict=False):
        out = out.when((pct > a) & (pct <= b), f"({a},{b}]")
    return out


def on_grid(row: Column, col: Column, grid: int = GRID) -> Column:
    return (F.pmod(row, F.lit(grid)) == 0) & (F.pmod(col, F.lit(grid)) == 0)


def strict_bool(text: Column) -> Column:
    """true or false in any case and with blanks around; null for anything else (a violation, see rules.domain)."""
    clean = F.lower(F.trim(text))
    return F.when(clean == "true", True).when(clean == "false", False)


def bounded_decimal(text: str, high: int) -> Decimal:
    """A finite threshold (high 100) or fraction (high 1) given by the caller."""
    try:
        value = Decimal(text)
    except InvalidOperation:
        raise ValueError(f"{text!r} is no number") from None
    if not value.is_finite() or not 0 <= value <= high:
        raise ValueError(f"{text!r} is not in [0, {high}]")
    return value


def decimal_text(value: Column) -> Column:
    """A decimal without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def portable_path(path: Column) -> Column:
    bad = F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.coalesce((path != "") & ~path.contains("\\") & ~path.startswith("/") & ~bad & ~path.rlike("^[A-Za-z]:"), F.lit(False))


def leaks_absolute_path(text: Column) -> Column:
    return text.rlike(r"(?:^|[\s\"'=:(,])/(?:home|root|mnt|tmp|Users|data|workspace)/|[A-Za-z]:\\")


def nearest_of(value: Column, options: tuple[float, ...]) -> Column:
    """The nearest of some thresholds and its distance; ties go to the first named."""
    pairs = F.array(*[F.struct(F.abs(F.lit(float(o)) - value).alias("distance"), F.lit(k).alias("k"), F.lit(float(o)).alias("threshold")) for k, o in enumerate(options)])
    return F.array_min(pairs)


def candidate_basis(threshold: Column, special: float = 60) -> Column:
    # fixed values: labels of the candidates
    return F.when(threshold == special, "required_and_suggested_class1_break").otherwise("required")


def metric_in_name(name: Column, metric: str = "val-iou") -> Column:
    return F.regexp_extract(name, rf"{metric}-([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + EPS)


def chlorophyll_green(nir: Column, green: Column) -> Column:
    return F.when(green < 1e-4, 20.0).otherwise(nir / (green + EPS) - 1)


def index_stack(bands: dict[str, Column]) -> Column:
    """The bands, then NDVI, GNDVI, NDVI of the red edge, NDWI and the green chlorophyll index."""
    g, r, e, n = (bands[k] for k in ("green", "red", "red_edge", "nir"))
    return F.array(*bands.values(), normalized_difference(n, r), normalized_difference(n, g), normalized_difference(n, e), normalized_difference(g, n), chlorophyll_green(n, g))


def standardize(values: Column, mean: tuple[float, ...], std: tuple[float, ...], scale: float = 1.0) -> Column:
    """(x / scale - mean) / std, place by place."""
    pairs = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std, strict=True)])
    return F.zip_with(values, pairs, lambda x, p: (x / scale - p["m"]) / p["s"])


def minmax_stretch(values: Column) -> Column:
    """Stretch to 0..1 from the second smallest distinct value (the smallest if there is one only)."""
    order = F.array_sort(F.array_distinct(values))
    low = F.coalesce(F.try_element_at(order, F.lit(2)), F.try_element_at(order, F.lit(1)))
    return F.transform(values, lambda x: F.least(F.greatest((x - low) / (F.array_max(values) - low + 1e-8), F.lit(0.0)), F.lit(1.0)))


def clip_stretch(value: Column, low: Column, high: Column, valid: Column) -> Column:
    return F.when(~valid | (high <= low), 0.0).otherwise(F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0)))


def fill_layers(bathymetry: Column, slope: Column, substrate: Column) -> Column:
    return F.struct(F.coalesce(bathymetry, F.lit(-2000.0)).alias("bathymetry"), F.coalesce(slope, F.lit(85.0)).alias("slope"), F.coalesce(substrate, F.lit(0)).alias("substrate"))


def scope_or_default(scope: Column) -> Column:
    return F.coalesce(scope, F.lit("selected_nonoverlap"))


def text_equals(text: Column, value: Column, tolerance: float = 1e-12) -> Column:
    """A cell equals a value: null is blank, "none" or "nan", numbers agree within the tolerance."""
    blank = F.coalesce(F.lower(F.trim(text)), F.lit("")).isin("", "none", "nan")
    return F.when(value.isNull(), blank).otherwise(F.coalesce(F.abs(text.try_cast("double") - value) <= tolerance, F.lit(False)))


def close(a: Column, b: Column, rel: float = 1e-12, absolute: float = 1e-10) -> Column:
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))
