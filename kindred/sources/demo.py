"""Three deterministic feeds of company records over the driver's tables, in SQL that Spark and DuckDB both run.

Source 1 has a record for each customer and each supplier. Sources 2 and 3 have one for each order (even and odd
keys): the customer's record again, with changes chosen by the key. Suppliers have no orders, so that they are the
entities without a match. {customer} and so on stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders")

PEOPLE = """
SELECT 'S1-C' || CAST(c_custkey AS STRING) AS entity_id, c_custkey AS k, p_name || ' ' || c_mktsegment AS stem, n_name AS city, r_name AS land
FROM {customer} JOIN {part} ON p_partkey = c_custkey JOIN {nation} ON n_nationkey = c_nationkey JOIN {region} ON r_regionkey = n_regionkey
UNION ALL
SELECT 'S1-S' || CAST(s_suppkey AS STRING), s_suppkey + 7, s_name || ' & Sons', n_name, r_name
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey
"""

SOURCE1 = f"""
SELECT entity_id, 'S1' AS source,
  stem || CASE k % 5 WHEN 0 THEN ' Inc.' WHEN 1 THEN ' Ltd' WHEN 2 THEN ' Corporation' WHEN 3 THEN '' ELSE ' Private Limited' END AS business_name,
  CAST(k % 900 + 1 AS STRING) || CASE k % 4 WHEN 0 THEN ' Main St, ' WHEN 1 THEN ' Oak Ave., ' WHEN 2 THEN ' Hill Rd, ' ELSE ' Lake Blvd, ' END
    || city || CASE k % 3 WHEN 0 THEN ' ' ELSE ', ' END || CAST(10000 + k % 80000 AS STRING) AS business_address,
  land AS country, k
FROM ({PEOPLE}) p
"""

OTHERS = f"""
SELECT 'S' || CAST(2 + o_orderkey % 2 AS STRING) || '-' || CAST(o_orderkey AS STRING) AS entity_id, 'S' || CAST(2 + o_orderkey % 2 AS STRING) AS source,
  CASE o_orderkey % 11 WHEN 0 THEN upper(business_name) WHEN 1 THEN replace(business_name, 'a', 'á') WHEN 2 THEN replace(business_name, 'Inc.', 'LLC')
    WHEN 3 THEN business_name || ' & Co.' WHEN 4 THEN '--' || lower(business_name) WHEN 5 THEN replace(business_name, 'e', 'é') || ' SARL'
    WHEN 6 THEN CASE WHEN o_orderkey % 33 = 6 THEN NULL ELSE business_name END WHEN 7 THEN replace(replace(business_name, 'i', 'ï'), 'ss', 'ß') ELSE business_name END AS business_name,
  CASE o_orderkey % 7 WHEN 0 THEN replace(replace(business_address, ' St,', ' Street,'), ' Rd,', ' Road,') WHEN 1 THEN NULL WHEN 2 THEN '  '
    WHEN 3 THEN 'Unit 4, ' || business_address WHEN 4 THEN upper(business_address) WHEN 5 THEN replace(business_address, ', ', ' ') ELSE business_address END AS business_address,
  CASE WHEN o_orderkey % 23 = 5 THEN 'ELSEWHERE' ELSE ' ' || country END AS country, o_orderkey AS k
FROM {{orders}} JOIN ({SOURCE1}) s ON s.entity_id = 'S1-C' || CAST(o_custkey AS STRING)
"""

RECORDS = f"SELECT entity_id, source, business_name, business_address, country FROM ({SOURCE1}) a UNION ALL SELECT entity_id, source, business_name, business_address, country FROM ({OTHERS}) b"

TRUTH = "SELECT 'S1-C' || CAST(o_custkey AS STRING) AS s1_id, 'S' || CAST(2 + o_orderkey % 2 AS STRING) || '-' || CAST(o_orderkey AS STRING) AS match_id FROM {orders}"


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A statement over the tables of a folder."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The statement over views of the tables' names."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
