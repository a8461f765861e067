"""Tables, and the tabular stand-ins for code entities that the queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, module): customers and suppliers as entities of the modules that nations are; a supplier's node follows the customers'."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("module"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), F.col("c_nationkey").alias("n_nationkey"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_nationkey").alias("n_nationkey"))
    return c.union(s).join(n, "n_nationkey").select("node", "module")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): a customer calls each supplier of its orders' lines."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").join(o, "o_orderkey")
    # keys are told apart as numbers: names would be shuffled
    return x.select("o_custkey", "l_suppkey").distinct().select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))


MEMBERS = """members as (
  select 'c' || c_custkey as node, n_name as module from customer join nation on c_nationkey = n_nationkey
  union all select 's' || s_suppkey, n_name from supplier join nation on s_nationkey = n_nationkey)"""
CALLS = "calls as (select distinct 'c' || o_custkey as src, 's' || l_suppkey as dst from lineitem join orders on l_orderkey = o_orderkey)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path): files src/<type>/<brand>/p<key>.rs from parts."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.expr(PATH_SQL).alias("path"))


PATH_SQL = "'src/' || lower(replace(p_type, ' ', '_')) || '/' || lower(replace(p_brand, '#', '')) || '/' || case when p_size % 5 = 0 then 'common/' else '' end || 'p' || p_partkey || '.rs'"
PATHS = f"paths as (select p_partkey as id, {PATH_SQL} as path from part)"
