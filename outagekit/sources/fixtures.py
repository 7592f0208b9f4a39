"""Interval-table views derived from the driver's generic tables.

The reference works on interruption tables (one row per consumer unit and
interruption) and billed-consumer tables.  The test data are generic
tables, so these views re-shape them into that form.  The SQL text is
shared by Spark and the DuckDB oracle, so both sides start from the same
rows; only the text-layout view needs engine-specific date formatting.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BASE_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# B1: mostly long interruptions, many UCs, four months, injected defects
# (null region every 89th id, null end every 97th, end before start every 101st).
INTR_LONG = """
SELECT cast(user_id AS string) AS NUM_UC_UCI,
       cast(event_id AS string) AS NUM_INTRP_UCI,
       cast(event_id - event_id % 4 AS string) AS NUM_INTRP_INIC_MANOBRA_UCI,
       CASE WHEN event_id % 89 = 0 THEN NULL
            ELSE substr('LPMCV', cast(user_id % 5 AS int) + 1, 1) END AS SIGLA_REGIONAL,
       CASE WHEN event_type IN ('view','click') THEN '0' ELSE '1' END AS TIPO_PROTOC_JUSTIF_UCI,
       date_trunc('second', ts) + (user_id % 3) * INTERVAL '31' DAY AS DTHR_INICIO_INTRP_UC,
       CASE WHEN event_id % 97 = 0 THEN NULL
            WHEN event_id % 101 = 0 THEN date_trunc('second', ts) + (user_id % 3) * INTERVAL '31' DAY - INTERVAL '60' SECOND
            ELSE date_trunc('second', ts) + (user_id % 3) * INTERVAL '31' DAY
                 + cast(floor(value * 60) AS bigint) * INTERVAL '1' SECOND END AS DATA_HORA_FIM_INTRP
FROM events
"""

# B2: short interruptions on ten UCs, so the under-one-minute merge rule fires.
INTR_DENSE = """
SELECT cast(user_id % 10 AS string) AS NUM_UC_UCI,
       cast(event_id AS string) AS NUM_INTRP_UCI,
       substr('LPMCV', cast(user_id % 5 AS int) + 1, 1) AS SIGLA_REGIONAL,
       date_trunc('second', ts) AS DTHR_INICIO_INTRP_UC,
       date_trunc('second', ts) + cast(floor(value) AS bigint) * INTERVAL '1' SECOND AS DATA_HORA_FIM_INTRP
FROM events
"""

# Billed consumers per region and month (T2 layout).
BILLED_MONTH = """
SELECT CASE n_regionkey WHEN 0 THEN 'NRT' WHEN 1 THEN 'CSL' WHEN 2 THEN 'NRO' WHEN 3 THEN 'LES' ELSE 'OES' END AS REGIONAL_TOTAL,
       substr('LPMCV', cast(n_regionkey AS int) + 1, 1) AS SIGLA_REGIONAL,
       m.anomes AS ANOMES, cast(count(*) AS double) AS UC_FATURADA
FROM customer JOIN nation ON c_nationkey = n_nationkey
CROSS JOIN (SELECT '2024-01' AS anomes UNION ALL SELECT '2024-02' UNION ALL SELECT '2024-03') m
GROUP BY n_regionkey, m.anomes
"""

# B3 for Spark: the same rows, with the three months attached by exploding a
# literal array onto the per-region count instead of a cross join.
BILLED_MONTH_SPARK = """
SELECT CASE n_regionkey WHEN 0 THEN 'NRT' WHEN 1 THEN 'CSL' WHEN 2 THEN 'NRO' WHEN 3 THEN 'LES' ELSE 'OES' END AS REGIONAL_TOTAL,
       substr('LPMCV', cast(n_regionkey AS int) + 1, 1) AS SIGLA_REGIONAL,
       anomes AS ANOMES, UC_FATURADA
FROM (SELECT n_regionkey, cast(count(*) AS double) AS UC_FATURADA
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey) r
LATERAL VIEW explode(array('2024-01', '2024-02', '2024-03')) m AS anomes
"""

# Detail rows for the regional volume tests: one row per order with its
# region name and order date.
ORDERS_REGIONAL = """
SELECT o_orderkey, r_name AS sigla_regional, o_orderdate AS data_referencia
FROM orders JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
"""

# Extraction sources (E1): the consumer history and the interruption table,
# both from ``events``.  The origin code is a function of the manoeuvre
# group, so the start row (found by the manoeuvre-initial id) and the end
# row (found by the own id) share it.  Initial id is null every sixth row,
# every tenth row is not billed.
HIST_SRC = """
SELECT user_id AS num_uc_hcai,
       substr('LPMCV', cast((event_id - event_id % 4) % 5 AS int) + 1, 1) AS indic_reg_orig_intrp_hcai,
       event_id AS num_intrp_hcai,
       CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id - event_id % 4 END AS num_intrp_inic_manobra_hcai,
       CASE WHEN event_id % 10 = 7 THEN 'N' ELSE 'S' END AS indic_fat_hcai
FROM events
"""
INTRP_SRC = """
SELECT substr('LPMCV', cast((event_id - event_id % 4) % 5 AS int) + 1, 1) AS indic_reg_orig_intrp,
       event_id AS NUM_SEQ_INTRP,
       CASE WHEN event_type IN ('view','click') THEN 0 ELSE 1 END AS TIPO_PROTOC_JUSTIF_INTRP,
       date_trunc('second', ts) + (user_id % 3) * INTERVAL '31' DAY AS data_hora_inic_intrp,
       CASE WHEN event_id % 97 = 0 THEN NULL
            ELSE date_trunc('second', ts) + (user_id % 3) * INTERVAL '31' DAY
                 + cast(floor(value * 60) AS bigint) * INTERVAL '1' SECOND END AS data_hora_fim_intrp
FROM events
"""

# Billed-consumer sources (E2): monthly consumers per locality (orders),
# locality -> section (customer), section -> region (nation), region
# (region plus a 'SCD' region that the query must drop).  Nations 23 and 24
# have no section row, so their consumers reach no region.
HQCL_SRC = """
SELECT o_custkey AS COD_LOCAL_HQCL,
       date_trunc('month', o_orderdate) AS ANO_MES_HQCL,
       1 + o_orderkey % 3 AS QTDE_CONS_FAT_URB_HQCL,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 0 END AS QTDE_CONS_FAT_RUR_HQCL
FROM orders
"""
LOCAL_SRC = "SELECT c_custkey AS COD_LOCAL, c_nationkey AS COD_SECCION_DISTR_LOCAL FROM customer"
SECTION_SRC = """
SELECT n_nationkey AS COD_SDIS,
       CASE WHEN n_nationkey BETWEEN 20 AND 22 THEN 9 ELSE n_regionkey END AS COD_REG_DISTR_SDIS
FROM nation WHERE n_nationkey < 23
"""
REGIONAL_SRC = """
SELECT r_regionkey AS COD_RDIS,
       CASE r_regionkey WHEN 0 THEN 'NRT' WHEN 1 THEN 'CSL' WHEN 2 THEN 'NRO' WHEN 3 THEN 'LES' ELSE 'OES' END AS SIGLA_RDIS
FROM region
UNION ALL SELECT 9 AS COD_RDIS, 'SCD' AS SIGLA_RDIS
"""

# B1 with start and end written in several text layouts (by id modulo 7),
# plus junk every 53rd row, and a free-form month text (by id modulo 6).
_LAYOUT_SPARK = [
    "date_format({c}, 'yyyy-MM-dd HH:mm:ss')",
    "date_format({c}, 'yyyy-MM-dd HH:mm:ss') || '.25'",
    "date_format({c}, \"yyyy-MM-dd'T'HH:mm:ss\")",
    "date_format({c}, 'dd/MM/yyyy HH:mm:ss')",
    "date_format({c}, 'yyyy-MM-dd HH:mm')",
    "date_format({c}, 'dd/MM/yyyy HH:mm')",
    "date_format({c}, 'yyyyMMdd HH:mm:ss')",
]
_LAYOUT_DUCK = [
    "strftime({c}, '%Y-%m-%d %H:%M:%S')",
    "strftime({c}, '%Y-%m-%d %H:%M:%S') || '.25'",
    "strftime({c}, '%Y-%m-%dT%H:%M:%S')",
    "strftime({c}, '%d/%m/%Y %H:%M:%S')",
    "strftime({c}, '%Y-%m-%d %H:%M')",
    "strftime({c}, '%d/%m/%Y %H:%M')",
    "strftime({c}, '%Y%m%d %H:%M:%S')",
]


def _layout_case(layouts: list[str], col: str, shift: int) -> str:
    arms = " ".join(f"WHEN {i} THEN {layouts[i].format(c=col)}" for i in range(len(layouts)))
    return (f"CASE WHEN cast(NUM_INTRP_UCI AS bigint) % 53 = 0 THEN 'n/d' "
            f"ELSE CASE (cast(NUM_INTRP_UCI AS bigint) + {shift}) % 7 {arms} END END")


_MONTH_TEXT = """
CASE cast(NUM_INTRP_UCI AS bigint) % 6
  WHEN 0 THEN concat(cast(year(DTHR_INICIO_INTRP_UC) AS string), '-', lpad(cast(month(DTHR_INICIO_INTRP_UC) AS string), 2, '0'))
  WHEN 1 THEN concat(cast(year(DTHR_INICIO_INTRP_UC) AS string), '/', cast(month(DTHR_INICIO_INTRP_UC) AS string))
  WHEN 2 THEN concat(cast(year(DTHR_INICIO_INTRP_UC) AS string), '_', lpad(cast(month(DTHR_INICIO_INTRP_UC) AS string), 2, '0'))
  WHEN 3 THEN concat(lpad(cast(month(DTHR_INICIO_INTRP_UC) AS string), 2, '0'), '-', cast(year(DTHR_INICIO_INTRP_UC) AS string))
  WHEN 4 THEN concat(cast(year(DTHR_INICIO_INTRP_UC) AS string), lpad(cast(month(DTHR_INICIO_INTRP_UC) AS string), 2, '0'))
  ELSE concat(cast(year(DTHR_INICIO_INTRP_UC) AS string), '-', cast(month(DTHR_INICIO_INTRP_UC) + 12 AS string))
END"""


def intr_text_sql(engine: str) -> str:
    layouts = _LAYOUT_SPARK if engine == "spark" else _LAYOUT_DUCK
    return f"""
SELECT NUM_UC_UCI, NUM_INTRP_UCI, SIGLA_REGIONAL, DTHR_INICIO_INTRP_UC,
       {_layout_case(layouts, 'DTHR_INICIO_INTRP_UC', 0)} AS DTHR_INICIO_TXT,
       {_layout_case(layouts, 'DATA_HORA_FIM_INTRP', 3)} AS DATA_HORA_FIM_TXT,
       {_MONTH_TEXT} AS MES_TXT
FROM intr_long
"""


# name -> (SQL, views it reads); order matters for the oracle's WITH list.
DERIVED = {
    "intr_long": INTR_LONG,
    "intr_dense": INTR_DENSE,
    "billed_month": BILLED_MONTH,
    "orders_regional": ORDERS_REGIONAL,
    "hist_src": HIST_SRC,
    "intrp_src": INTRP_SRC,
    "hqcl_src": HQCL_SRC,
    "local_src": LOCAL_SRC,
    "section_src": SECTION_SRC,
    "regional_src": REGIONAL_SRC,
}
DEPENDS = {"intr_text": ["intr_long"]}


def _sql_for(name: str, engine: str) -> str:
    if name == "intr_text":
        return intr_text_sql(engine)
    if name == "billed_month" and engine == "spark":
        return BILLED_MONTH_SPARK
    return DERIVED[name]


def _ntz(df: DataFrame) -> DataFrame:
    """Spark's ``date_trunc`` returns a zoned timestamp; the tables are
    zone-less, so cast those columns back."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(df[f"`{f.name}`"].cast(T.TimestampNTZType()).alias(f.name))
        else:
            cols.append(df[f"`{f.name}`"])
    return df.select(*cols)


_PLANS: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table (parquet scan) or a derived view, as a DataFrame.

    DataFrames are plans, not data; they are memoised per session, folder
    and name so repeated queries skip file listing and re-analysis."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # sessions without a local SparkContext handle
        app = spark.conf.get("spark.app.id", None)
    key = (id(spark), app, sf_dir, name)
    hit = _PLANS.get(key)
    if hit is not None:
        return hit
    if name in BASE_TABLES:
        out = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        for dep in DEPENDS.get(name, []):
            table(spark, sf_dir, dep).createOrReplaceTempView(dep)
        sql = _sql_for(name, "spark")
        for base in BASE_TABLES:
            if re.search(rf"\b{base}\b", sql):
                table(spark, sf_dir, base).createOrReplaceTempView(base)
        out = _ntz(spark.sql(sql))
    _PLANS[key] = out
    return out


def oracle(body: str, views: list[str]) -> str:
    """Prefix a DuckDB query with the derived views it reads, as CTEs."""
    ordered: list[str] = []
    for v in views:
        for dep in DEPENDS.get(v, []):
            if dep not in ordered:
                ordered.append(dep)
        if v not in ordered:
            ordered.append(v)
    ctes = ",\n".join(f"{v} AS ({_sql_for(v, 'duckdb')})" for v in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body
