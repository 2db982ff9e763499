"""Label records made from the tables at hand: the same SQL gives Spark and an oracle the same input.

Rows come from ``part``; the remainders of its key choose among forms of each
statement.  ``LABELS`` has one row per part with the lines of a label and the
application's values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofmark.config import STATUTORY_WARNING

LABELS = f"""
SELECT p_partkey AS item_id, p_type AS batch_id, p_size AS size,
  CASE p_partkey % 7 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(p_name) || ' DISTILLERY' WHEN 2 THEN p_name WHEN 3 THEN upper(p_name) || 'X'
    WHEN 4 THEN '  ' || p_name || ' ==' WHEN 5 THEN 'The ' || p_name ELSE 'ZYQ VWK' END AS brand_line,
  CASE p_partkey % 5 WHEN 0 THEN 'Kentucky Straight Bourbon Whiskey' WHEN 1 THEN 'Bourbon Whiskey' WHEN 2 THEN 'Vodka' WHEN 3 THEN 'Single Malt' ELSE 'Aged Spirit' END AS class_line,
  CASE p_partkey % 8 WHEN 0 THEN p_size || '% Alc./Vol.' WHEN 1 THEN p_size || ' % ALC/VOL' WHEN 2 THEN 'ALC. ' || p_size || '% BY VOL.' WHEN 3 THEN p_size || '% ABV'
    WHEN 4 THEN (2 * p_size) || ' Proof' WHEN 5 THEN p_size || '% Alc./Vol. (' || (2 * p_size) || ' PROOF)' WHEN 6 THEN 'Alcohol by volume: ' || p_size || '.5%' ELSE 'Strong' END AS abv_line,
  CASE p_partkey % 6 WHEN 0 THEN '750 mL' WHEN 1 THEN '1.75 L' WHEN 2 THEN '750ML' WHEN 3 THEN 'ge | 750mL' WHEN 4 THEN '(90 PROOF) 375 ml' ELSE 'Bottle' END AS net_line,
  CASE p_partkey % 4 WHEN 0 THEN '{STATUTORY_WARNING}' WHEN 1 THEN 'Government Warning: (1) According to the Surgeon General, women should not drink during pregnancy because of birth defects.'
    WHEN 2 THEN 'GOVERNMENT WARNING: see back' ELSE 'Enjoy' END AS warning_line,
  CASE p_partkey % 3 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'WARNING' ELSE 'POOR' END AS quality,
  upper(p_name) AS app_brand,
  CASE p_partkey % 5 WHEN 2 THEN 'Gin' WHEN 4 THEN 'Aged Spirit' ELSE 'Bourbon Whiskey' END AS app_class,
  CASE p_partkey % 11 WHEN 0 THEN 'none' WHEN 1 THEN (p_size + 1) || '%' ELSE p_size || '%' END AS app_abv,
  CASE p_partkey % 9 WHEN 0 THEN '0.75 L' WHEN 1 THEN '1 L' WHEN 2 THEN 'a bottle' ELSE '750 mL' END AS app_net,
  'label ' || (p_partkey % 97) || CASE p_partkey % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.gif' ELSE '.webp' END AS filename
FROM part"""


def parts(spark: SparkSession, sf_dir: str) -> None:
    """The view ``part``, dealt by key over all cores: a record costs far more work than bytes, so a file of few megabytes would be read, and its records worked on, by few tasks."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_name", "p_type", "p_size")
    rows.repartition(n, "p_partkey").createOrReplaceTempView("part")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts(spark, sf_dir)
    return spark.sql(LABELS)


#: The same records with missing, empty and foreign lines, and missing application values.
ODD = f"""
SELECT item_id, batch_id, size,
  CASE WHEN item_id % 13 = 0 THEN NULL WHEN item_id % 17 = 0 THEN '' WHEN item_id % 19 = 0 THEN 'Château ' || brand_line WHEN item_id % 23 = 0 THEN brand_line || ' Rosé' WHEN item_id % 29 = 0 THEN 'Ñandú, Été' WHEN item_id % 31 = 0 THEN 'DISTILLERY' ELSE brand_line END AS brand_line,
  CASE WHEN item_id % 11 = 0 THEN NULL WHEN item_id % 14 = 0 THEN 'Crème Liqueur' WHEN item_id % 22 = 1 THEN 'Straight Bourb' WHEN item_id % 26 = 1 THEN 'a rum and a vodka' ELSE class_line END AS class_line,
  CASE WHEN item_id % 15 = 0 THEN NULL WHEN item_id % 16 = 1 THEN '' WHEN item_id % 21 = 0 THEN 'Vol. d’alcool' ELSE abv_line END AS abv_line,
  CASE WHEN item_id % 18 = 0 THEN NULL WHEN item_id % 20 = 1 THEN ' ' WHEN item_id % 25 = 0 THEN 'é 750 mL' ELSE net_line END AS net_line,
  CASE WHEN item_id % 24 = 0 THEN NULL WHEN item_id % 27 = 0 THEN 'Government' ELSE warning_line END AS warning_line,
  CASE WHEN item_id % 35 = 0 THEN NULL ELSE quality END AS quality,
  CASE WHEN item_id % 37 = 0 THEN NULL WHEN item_id % 19 = 0 THEN 'CHÂTEAU ' || app_brand ELSE app_brand END AS app_brand,
  CASE WHEN item_id % 41 = 0 THEN NULL ELSE app_class END AS app_class, CASE WHEN item_id % 43 = 0 THEN NULL ELSE app_abv END AS app_abv, CASE WHEN item_id % 47 = 0 THEN '' ELSE app_net END AS app_net, filename
FROM ({LABELS})"""


def odd_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts(spark, sf_dir)
    return spark.sql(ODD)
