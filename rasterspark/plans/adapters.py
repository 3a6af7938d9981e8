"""The given tables read as sources, chips, tiles, pixels, metrics and events.

The views are SQL that Spark and DuckDB both take, so both sides of a comparison start from the same rows. In Spark lines
are dealt by their source's name once (DEALT), to as many tasks as their number asks for. That serves their grouping, the
join with the orders' sources and all later groupings of chips by source alike, and no task's share grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "sources": """
SELECT o_orderkey AS source_no, concat('src_', o_orderkey) AS source_tiff_id, CASE WHEN r_name = 'ASIA' THEN 'bc' ELSE 'ca' END AS dataset, r_name AS region_id, r_name AS region_name,
  CAST(date_trunc('month', o_orderdate) AS DATE) AS acquisition_date, 2560 AS source_width, 1536 AS source_height
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "chip_counts": """
SELECT l_orderkey, l_linenumber, 100 AS total, nodata, ignored, c1, 100 - ignored - c1 AS c0 FROM (
  SELECT *, CASE WHEN d >= 5 THEN least(d, 100 - ignored) ELSE 0 END AS c1 FROM (
    SELECT *, least(100, nodata + t) AS ignored FROM (
      SELECT l_orderkey, l_linenumber, CASE WHEN min(l_returnflag) = 'N' THEN 0 ELSE 2 * CAST(floor(max(l_quantity)) AS INT) END AS nodata,
        CAST(round(100 * max(l_discount)) AS INT) AS d, CAST(round(100 * max(l_tax)) AS INT) AS t
      FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_linenumber, l_returnflag, l_quantity, l_discount, l_tax FROM lineitem) l GROUP BY l_orderkey, l_linenumber) a) b) c""",
    "chips": """
SELECT concat(source_tiff_id, '__r', row_off, '_c', col_off, '_h1024_w1024') AS chip_id, concat('all/', source_tiff_id, '__r', row_off, '_c', col_off, '_h1024_w1024.npz') AS chip_path,
  source_tiff_id, dataset, region_id, region_name, acquisition_date, source_width, source_height, chip_index, row_off, col_off, 1024 AS chip_width, 1024 AS chip_height,
  CAST(total AS BIGINT) AS total_pixel_count, CAST(c0 AS BIGINT) AS class_0_pixel_count, CAST(c1 AS BIGINT) AS class_1_pixel_count, CAST(ignored AS BIGINT) AS ignore_pixel_count,
  CAST(nodata AS BIGINT) AS nodata_pixel_count, CAST(100 * nodata AS DOUBLE) / CAST(total AS DOUBLE) AS nodata_pct,
  CASE WHEN c1 > 0 THEN 'positive' WHEN c0 > 0 AND nodata = 0 THEN 'clean_background_only' WHEN c0 > 0 THEN 'mixed_background_nodata' ELSE 'ignore_only' END AS class_presence
FROM (SELECT s.*, c.*, c.l_linenumber AS chip_index, 512 * CAST(floor((c.l_linenumber - 1) / 2.0) AS INT) AS row_off, 512 * ((c.l_linenumber - 1) % 2) AS col_off
  FROM chip_counts c JOIN sources s ON s.source_no = c.l_orderkey) x""",
    "source_states": """
SELECT user_id AS run_key, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id FROM events""",
}

#: What Spark reads instead in a view's text: the same rows, with the name of a line's source (line_source) as first key.
DEALT = {
    "chip_counts": [("SELECT l_orderkey, l_linenumber, 100 AS total", "SELECT line_source, l_orderkey, l_linenumber, 100 AS total"), ("SELECT l_orderkey, l_linenumber, CASE", "SELECT line_source, l_orderkey, l_linenumber, CASE"),
                    ("/*+ REPARTITION(l_orderkey) */ l_orderkey", "line_source, l_orderkey"), ("FROM lineitem)", "FROM {dealt_lines})"), ("GROUP BY l_orderkey", "GROUP BY line_source, l_orderkey")],
    "chips": [("ON s.source_no = c.l_orderkey", "ON s.source_tiff_id = c.line_source")],
}
#: Lines of a task at most, and at least where there are fewer tasks than shuffle partitions.
LINES = (200_000, 20_000)


class Tables:
    """The tables of a folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._seen = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in TABLES:
                self._seen[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name == "dealt_lines":
                lines = self["lineitem"].select(F.concat(F.lit("src_"), "l_orderkey").alias("line_source"), "l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_discount", "l_tax")
                n, (most, least) = lines.count(), LINES  # from the files' footers
                parts = max(1, -(-n // most), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-n // least)))
                self._seen[name] = lines.repartition(parts, "line_source")
            else:
                text = VIEWS[name]
                for old, new in DEALT.get(name, ()):
                    assert old in text, old  # the view has changed
                    text = text.replace(old, new)
                for other in [*VIEWS, *TABLES]:
                    if other != name:
                        text = _named(text, other)
                used = {o: self[o] for o in ["dealt_lines", *VIEWS, *TABLES] if f"{{{o}}}" in text}
                self._seen[name] = self.spark.sql(text, **used)
        return self._seen[name]

    def tiles(self) -> DataFrame:
        """An embedding as an 8 x 8 tile of a 12 x 12 source of four: probabilities and labels of its pixels."""
        s, k = F.expr("vec_id DIV 4"), F.pmod("vec_id", F.lit(4)).cast("int")
        out = self["embeddings"].select(F.concat(F.lit("chip_"), "vec_id").alias("chip_id"), s.alias("s"), F.concat(F.lit("vec_"), s).alias("source_tiff_id"), (4 * F.floor(k / 2)).cast("int").alias("row_off"), (4 * F.pmod(k, F.lit(2))).alias("col_off"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(12).alias("source_height"), F.lit(12).alias("source_width"), "embedding", F.col("label").alias("kind"))
        p = F.transform("embedding", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x.cast("double") + 1) / 2)))
        place = lambda i: (F.col("row_off") + F.floor(i / 8).cast("int"), F.col("col_off") + F.pmod(i, F.lit(8)))

        def truth(i):
            r, c = place(i)
            return F.when(F.pmod(7 * F.col("s") + 3 * r + c, F.lit(5)) == 0, -100).otherwise(F.pmod(F.col("s") + r + c, F.lit(2))).cast("int")

        return out.withColumn("probability", p).withColumn("label", F.transform(F.sequence(F.lit(0), F.lit(63)), truth))

    def band_pixels(self) -> DataFrame:
        """A line as a pixel of four bands."""
        return self["lineitem"].select("l_returnflag", F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("bands"))


def _named(text: str, name: str) -> str:
    import re

    return re.sub(rf"(?<=FROM )\b{name}\b|(?<=JOIN )\b{name}\b", f"{{{name}}}", text)


PIXELS = """
pix AS (
  SELECT s, concat('vec_', s) AS source_tiff_id, row_off + CAST(floor(i / 8.0) AS INT) AS r, col_off + i % 8 AS c, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (CAST(x AS DOUBLE) + 1) / 2)) AS p
  FROM (SELECT vec_id // 4 AS s, 4 * ((vec_id % 4) // 2) AS row_off, 4 * (vec_id % 2) AS col_off, unnest(embedding) AS x, unnest(range(64)) AS i FROM embeddings)),
cov AS (
  SELECT s, source_tiff_id, r AS row, c AS col, avg(p) AS probability, count(*) AS coverage, CASE WHEN (7 * s + 3 * r + c) % 5 = 0 THEN -100 ELSE (s + r + c) % 2 END AS label,
    CASE WHEN avg(p) >= 0.5 THEN 1 ELSE 0 END AS mask FROM pix GROUP BY s, source_tiff_id, r, c)"""


def duck(*views: str) -> str:
    """WITH clause for DuckDB of the named views."""
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in views)
