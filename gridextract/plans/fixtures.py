"""Subscriber lines made from the customer table by rule, and what they say: the tables hold no invoices of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridextract.functions.text import dealt

#: Runs in Spark SQL and in other SQL engines alike.
TRUTH = """
select c_custkey k,
 concat('inv-', cast(floor(c_custkey/90) as int), '.txt') as file_name,
 cast(floor((c_custkey%90)/30) as int)+1 as page,
 concat(split_part('BAR,CEL,DUN,FAL,GRI,HEN,KES,LUT,PER,WIN',',',cast(c_custkey%10 as int)+1),
        split_part('BERG,CASTER,FIELD,LAND,NETT,SWORTH,TRICK,VALE,WICKE',',',cast(floor((c_custkey%90)/10) as int)+1)) as last_name,
 split_part('ALICE,BRUNO,CARLA,ERIK,FIONA,GREGOR,INGRID',',',cast(c_custkey%7 as int)+1) as first_name,
 split_part('E,ES,ESD,ED,EA',',',cast(c_custkey%5 as int)+1) as coverage,
 case when c_custkey%11=0 then 'T' when c_custkey%13=0 then 'C' else 'A' end as status,
 split_part('DHMO,PPO,EPO,HSA',',',cast(c_custkey%4 as int)+1) as plan,
 cast(c_custkey%6 as int)+1 as family_count,
 case when c_custkey%11=0 then 0 else 100*(100+(c_custkey*7919)%7000) end as cents
from customer
"""
HEADING = "Membership Detail for Group ID 100001 Bill Group ID 0001\nName Family Count Medicare assignment Y/N Subscriber ID Coverage Status Medical plan Medical current charge Period Code Amount Total Due"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by its key: a file of few bytes is read by one task or two, however much work its rows are."""
    return dealt(table(spark, sf_dir, name), key)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRUTH.replace("from customer", "from {customer}"), customer=spread(spark, sf_dir, "customer", "c_custkey"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_name, page, line_no, line: a noisy line for each customer; every fourth of each kind of noise."""
    dollars = F.floor(F.col("cents") / 100)
    grouped = F.format_number(dollars, 0)
    kind = F.col("k") % 4
    charge = (
        F.when(kind == 0, F.concat(F.lit("$"), grouped, F.lit(".00"))).when(kind == 1, F.concat(F.lit("$"), F.when(dollars == 0, "0.00").otherwise(F.concat(dollars.cast("string"), F.lit("00")))))
        .when(kind == 2, F.concat(F.lit("$"), F.replace(grouped, F.lit(","), F.lit(" , ")), F.lit(".00"))).otherwise(F.concat(F.lit("[$"), dollars.cast("string"), F.lit(".00}")))
    )
    mask = F.concat(F.lit("XXX-XX-"), F.lpad((F.col("k") % 10000).cast("string"), 4, "0"))
    line = F.concat_ws(" ", F.concat("last_name", F.lit(", "), "first_name"), F.col("family_count").cast("string"), F.lit("N"), mask, "coverage", "status", "plan", charge)
    return truth(spark, sf_dir).select("file_name", "page", F.col("k").alias("line_no"), line.alias("line"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_name, page, text: the pages of these lines, under a heading."""
    d = dealt(lines(spark, sf_dir), "file_name").groupBy("file_name", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    return d.select("file_name", "page", F.concat(F.lit(HEADING + "\n"), "text", F.lit("\nSubtotal $1.00")).alias("text"))


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_name, ord, name: the people of each file; of every ninth the first name is cut, every tenth is someone else."""
    d = truth(spark, sf_dir)
    first = F.when(F.col("k") % 9 == 4, F.expr("substring(first_name, 1, 3)")).otherwise(F.col("first_name"))
    name = F.when(F.col("k") % 10 == 3, F.lit("ZYXWVUTY, QUOPPY")).otherwise(F.concat("last_name", F.lit(", "), first))
    return d.select("file_name", F.col("k").cast("int").alias("ord"), name.alias("name"))


ROSTER = f"""
select file_name, cast(k as int) as ord, k, page, family_count, coverage, status, plan, cents, case when k%10=3 then concat(split_part('OXBOW,UMBRA,THYMUS,JIGZAG,QUOKKA,MYRRH,VORTEX,ZEPHYR,KUDZU',',',cast(floor((k%90)/10) as int)+1), ', PIPPY') else concat(last_name, ', ', first_name) end as read,
  case when k%10=3 then 'ZYXWVUTY, QUOPPY' else concat(last_name, ', ', case when k%9=4 then substring(first_name, 1, 3) else first_name end) end as name,
  k%10<>3 as found
from ({TRUTH}) as t
"""
