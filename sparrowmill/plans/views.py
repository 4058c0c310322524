"""The domain's tables as views over the test tables, in Spark and in SQL for the oracle.

A line item is a test result: the customer's nation is the district, its region the
state, the supplier the laboratory, the part's type the commodity and its brand the
brand; flags A and R are passed and failed, N is unknown; ten times the tax is the
fraud score, which every third result has none of. AS_OF stands for "now".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L
from sparrowmill.functions import scalars as S
from sparrowmill.storage import table

AS_OF = "2001-11-04"

#: Surrogates for the names of commodities and contaminants.
COMMODITIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
CONTAMINANTS = ("aflatoxin_b1", "lead", "cadmium", "arsenic_inorganic", "pesticide_chlorpyrifos", "melamine", "ochratoxin_a")


def facts(spark: SparkSession, sf_dir: str, flags: bool = True) -> DataFrame:
    """Test results. flags: with is_duplicate, which costs a shuffle by key; leave it out where it isn't read.

    Dimensions join by broadcast or shuffle as Spark finds from their sizes. Lines meet their
    orders before the window: a shuffle by order serves both, and as an order has one district,
    which is named among the window's keys, filters on districts go down to the scan of customers.
    """
    t = lambda name: table(spark, sf_dir, name)
    part = t("part").select("p_partkey", F.col("p_type").alias("commodity"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("brand"))
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("district"), F.col("r_name").alias("state"))
    tested = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    lines = t("lineitem").join(tested, F.col("l_orderkey") == F.col("o_orderkey"))
    if flags:
        order = Window.partitionBy("l_orderkey", "l_linenumber", "c_nationkey").orderBy("l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        lines = lines.withColumn("is_duplicate", F.row_number().over(order) > 1)
    joined = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("contaminant_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_suppkey").alias("lab_id"),
        F.col("c_nationkey").alias("district_id"),
        "district",
        "state",
        "commodity",
        "brand",
        F.col("l_shipdate").cast("date").alias("test_date"),
        F.col("l_quantity").alias("ppb"),
        F.col("l_extendedprice").alias("amount"),
        F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "R", False).alias("pass_fail"),
        (F.lit(0.80).cast("decimal(4,3)") - F.col("l_discount").cast("decimal(4,3)")).alias("confidence_score"),
        F.when(F.col("l_linenumber") % 3 > 0, F.col("l_tax").cast("decimal(4,2)") * 10).alias("fraud_score"),
        *(["is_duplicate"] if flags else []),
    )


def usable() -> Column:
    return (F.col("confidence_score") >= L.USABLE) & ~F.col("is_duplicate")


def unsuspected() -> Column:
    """Not scored yet, or with a fraud score below SUSPECT."""
    return F.col("fraud_score").isNull() | (F.col("fraud_score") < L.SUSPECT)


def since(months: int) -> Column:
    return F.col("test_date") >= F.add_months(F.lit(AS_OF).cast("date"), -months)


def quarters(er: DataFrame) -> DataFrame:
    """Failure rate, tests and risk per district, commodity and quarter, from usable results that no fraud score excludes."""
    grouped = er.where(usable() & unsuspected()).groupBy("district_id", "commodity", S.quarter_label(F.col("test_date")).alias("quarter"))
    counted = grouped.agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(F.col("pass_fail") == F.lit(False)).alias("n_failed"))
    rate = S.fail_rate(F.col("n_failed"), F.col("n_tests"))
    return counted.select("district_id", "commodity", "quarter", "n_tests", rate.cast("double").alias("fail_rate"), F.round(rate * 100, 2).cast("double").alias("risk_score"))


ER = f"""
er as (select l_orderkey as order_id, l_linenumber as contaminant_id, l_partkey as part_id, l_suppkey as lab_id, c_nationkey as district_id, n_name as district, r_name as state,
  p_type as commodity, case when p_size % 5 <> 0 then p_brand end as brand, l_shipdate::date as test_date, l_quantity as ppb, l_extendedprice as amount,
  case l_returnflag when 'A' then true when 'R' then false end as pass_fail, 0.80::decimal(4,3) - l_discount::decimal(4,3) as confidence_score,
  case when l_linenumber % 3 > 0 then l_tax::decimal(4,2) * 10 end as fraud_score,
  row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_shipdate, l_extendedprice) > 1 as is_duplicate
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey),
ok as (select * from er where confidence_score >= {L.USABLE} and not is_duplicate)"""

AGG = f"""
agg as (select district_id, commodity, quarter, n_tests, fail_rate, round(fail_rate * 100, 2) as risk_score from (
  select district_id, commodity, year(test_date) || '-Q' || quarter(test_date) as quarter, count(*) as n_tests,
    round(count(*) filter (pass_fail = false)::decimal(18,0) / count(*)::decimal(18,0), 4)::double as fail_rate
  from ok where (fraud_score is null or fraud_score < {L.SUSPECT}) group by all))"""


def months_ago(n: int) -> str:
    return f"(date '{AS_OF}' - interval {n} month)::date"
