"""Registered queries: name -> (spark builder, DuckDB check SQL or None).

Every query reads the driver tables (or views Spark derives from them)
whole, so its work grows with the data.  Parameters (month, thresholds)
are the reference's defaults unless stated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.functions import scalars as S
from outagekit.functions.numeric import round_half_sql as RH
from outagekit.functions.schema import (
    END_ALIASES, MANOEUVRE_ID_ALIASES, START_ALIASES, UC_ALIASES,
    resolve_columns as _resolve_columns, resolve_column_fuzzy, standardize_columns,
)
from outagekit.operators import indicators as ind
from outagekit.operators import intervals as iv
from outagekit.operators import quality as dq
from outagekit.operators.joins import broadcast_bounded
from outagekit.plans import sql_blocks as Q
from outagekit.session import checkpoint_dir
from outagekit.sources import extract as ex
from outagekit.sources import io as sio
from outagekit.sources.fixtures import oracle, table
from outagekit.sources.layouts import scan_layouts
from outagekit.sources.publish import publish_months, publish_table, read_published

# The DEC/FEC month: the latest month of the billed table (the reference's
# default selection).
ANOMES = "2024-03"

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def marked_long(spark: SparkSession, sf: str) -> DataFrame:
    return iv.mark_overlaps(table(spark, sf, "intr_long"))


ORDER_RECORDS = T.StructType([
    T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.DateType()),
    T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_lote", T.StringType())])


def order_records(spark: SparkSession, sf: str) -> DataFrame:
    """Every order as a line of text in one of three folders; some lines lack
    a field, some have one too many, some hold text for a number."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    price = F.when(key % 50 == 3, F.lit("n/d")).otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string"))
    line = F.concat_ws(",", key.cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), price,
                       F.when(key % 50 != 1, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(', lote"'))),
                       F.when(key % 50 == 2, F.lit("sobra")))
    path = _scratch(spark, "orders-csv")
    o.select((key % 3).alias("pasta"), line.alias("value")).write.partitionBy("pasta").text(path)
    return sio.load_csv_tagged(spark, [f"{path}/pasta={i}" for i in range(3)], ORDER_RECORDS, header=False)


def billed(spark: SparkSession, sf: str, anomes: str | None = ANOMES) -> DataFrame:
    b = ind.load_billed_uc(table(spark, sf, "billed_month"))
    return b.where(b.ANOMES == anomes) if anomes else b


def unique_long(spark: SparkSession, sf: str, anomes: str = ANOMES) -> DataFrame:
    bm = billed(spark, sf, anomes)
    return ind.consolidate_perceived(ind.eligible_rows(iv.mark_month(table(spark, sf, "intr_long"), anomes), anomes, bm))


# ---------------------------------------------------------------------------
# I1 and the flagship
# ---------------------------------------------------------------------------

@register("mark_overlaps", oracle(f"SELECT * FROM {Q.marked_long()} m", ["intr_long"]))
def q_mark_overlaps(spark, sf):
    return marked_long(spark, sf)


def _month_of(marked: str, anomes: str) -> str:
    lo, hi = Q.month_bounds(anomes)
    return (f"SELECT * EXCLUDE ({', '.join(iv.HISTORY_MARKS)}) FROM {marked} m "
            f"WHERE DTHR_INICIO_INTRP_PERCEBIDO >= {lo} AND DTHR_INICIO_INTRP_PERCEBIDO < {hi}")


@register("mark_month", oracle(_month_of(Q.marked_long(), ANOMES), ["intr_long"]))
def q_mark_month(spark, sf):
    return iv.mark_month(table(spark, sf, "intr_long"), ANOMES)


@register("mark_month_dense", oracle(_month_of(Q.marked_dense(), "2024-01"), ["intr_dense"]))
def q_mark_month_dense(spark, sf):
    """Over short interruptions, which merge into perceived ones."""
    return iv.mark_month(table(spark, sf, "intr_dense"), "2024-01")


@register("dec_fec", oracle(Q.dec_fec_sql(ANOMES), ["intr_long", "billed_month"]))
def q_dec_fec(spark, sf):
    return ind.dec_fec(unique_long(spark, sf), billed(spark, sf))


# ---------------------------------------------------------------------------
# SQL helpers for the checks
# ---------------------------------------------------------------------------

def PTS(s: str) -> str:
    fmts = ["%Y-%m-%d", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S",
            "%d/%m/%Y %H:%M:%S.%f", "%d/%m/%Y %H:%M:%S", "%Y-%m-%d %H:%M", "%d/%m/%Y %H:%M"]
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in fmts) + ")"


def PTS_IMPORT(s: str) -> str:
    fmts = ["%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%Y%m%d %H:%M:%S"]
    return "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in fmts) + ")"


def MONTH_TXT(s: str) -> str:
    t = f"coalesce(CAST({s} AS VARCHAR), '')"
    return (f"(CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}') THEN substr({t}, 1, 7) "
            f"WHEN regexp_matches({t}, '^\\d{{8}}$') OR regexp_matches({t}, '^\\d{{6}}$') "
            f"THEN substr({t}, 1, 4) || '-' || substr({t}, 5, 2) END)")


REGION_CASE = ("CASE upper(coalesce(SIGLA_REGIONAL, '')) "
               + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.REGION_OF.items()) + f" ELSE '{S.NO_REGION}' END")


def LABEL(c: str) -> str:
    return (f"(CASE WHEN regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '\\s+', '', 'g') = '' "
            f"THEN 'SEM_SIGLA' ELSE upper(CAST({c} AS VARCHAR)) END)")


def ELIGIBLE(anomes: str = ANOMES) -> str:
    lo, hi = Q.month_bounds(anomes)
    return f"""
(SELECT coalesce(mp.REGIONAL_TOTAL, 'SEM_REGIONAL') AS REGIONAL_TOTAL, e.NUM_UC_UCI, e.NUM_INTRP_PERCEBIDA,
        e.DUR_MIN, e.TIPO_PROTOC_JUSTIF_UCI, e.VERIFICADO
 FROM (SELECT coalesce(SIGLA_REGIONAL, '') AS SIGLA_REGIONAL, CAST(NUM_UC_UCI AS VARCHAR) AS NUM_UC_UCI,
              CAST(NUM_INTRP_PERCEBIDA AS VARCHAR) AS NUM_INTRP_PERCEBIDA,
              coalesce(TRY_CAST(DURACAO_PERCEBIDA_MINUTOS AS DOUBLE), 0.0) AS DUR_MIN,
              coalesce(CAST(TIPO_PROTOC_JUSTIF_UCI AS VARCHAR), '') AS TIPO_PROTOC_JUSTIF_UCI,
              coalesce(verificado, false) AS VERIFICADO
       FROM {Q.marked_long()} m
       WHERE DTHR_INICIO_INTRP_PERCEBIDO >= {lo} AND DTHR_INICIO_INTRP_PERCEBIDO < {hi}) e
 LEFT JOIN (SELECT DISTINCT SIGLA_REGIONAL, REGIONAL_TOTAL FROM billed_month
            WHERE ANOMES = '{anomes}' AND SIGLA_REGIONAL IS NOT NULL AND SIGLA_REGIONAL <> ''
              AND REGIONAL_TOTAL <> 'COPEL') mp ON e.SIGLA_REGIONAL = mp.SIGLA_REGIONAL
 WHERE e.NUM_UC_UCI IS NOT NULL AND e.NUM_UC_UCI <> '' AND e.NUM_INTRP_PERCEBIDA IS NOT NULL
   AND e.NUM_INTRP_PERCEBIDA <> '' AND e.VERIFICADO AND e.DUR_MIN >= 3.0)"""


UNIQUE = Q.unique_intrp(ANOMES)
UC_MONTH = (f"(SELECT REGIONAL_TOTAL, max(UC_FATURADA) AS UC_FATURADA FROM billed_month "
            f"WHERE ANOMES = '{ANOMES}' AND REGIONAL_TOTAL <> 'COPEL' GROUP BY 1)")
L_B = ["intr_long", "billed_month"]


def nearest_sql(src: str, val: str, by: str, q: float) -> str:
    """Nearest-rank order statistic per group, as in the DataFrame code."""
    return f"""(SELECT {by}, max(CASE WHEN rn - 1 = CAST(round((n - 1) * {q!r}) AS BIGINT) THEN {val} END) AS v
  FROM (SELECT {by}, {val}, row_number() OVER (PARTITION BY {by} ORDER BY {val}) AS rn,
               count(*) OVER (PARTITION BY {by}) AS n FROM {src} WHERE {val} IS NOT NULL) z GROUP BY {by})"""


# ---------------------------------------------------------------------------
# Sources (S1, S3-S6)
# ---------------------------------------------------------------------------

@register("load_table", "SELECT * FROM lineitem")
def q_load_table(spark, sf):
    return sio.load_table(spark, f"{sf}/lineitem.parquet")


_B1_COLS = Q.INTR_LONG_COLS


@register("bronze_as_string", oracle(
    "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _B1_COLS) + " FROM intr_long", ["intr_long"]))
def q_bronze(spark, sf):
    return sio.bronze_as_string(table(spark, sf, "intr_long"))


@register("scan_processed_layouts", oracle("""
SELECT *, CASE WHEN CAST(NUM_INTRP_UCI AS BIGINT) % 3 <> 0 THEN lpad(CAST(year(DTHR_INICIO_INTRP_UC) AS VARCHAR), 4, '0') END AS ano,
       CASE WHEN CAST(NUM_INTRP_UCI AS BIGINT) % 3 <> 0 THEN lpad(CAST(month(DTHR_INICIO_INTRP_UC) AS VARCHAR), 2, '0') END AS mes
FROM intr_long""", ["intr_long"]))
def q_s4_layouts(spark, sf):
    """A raw folder (all text), a processed folder by month, and one of them
    under a second spelling."""
    df, base = table(spark, sf, "intr_long"), _scratch(spark, "layouts")
    third = F.col("NUM_INTRP_UCI").cast("long") % 3 == 0
    sio.bronze_as_string(df.where(third)).write.parquet(f"{base}/raw")
    sio.write_month_partition(df.where(~third), f"{base}/processed", "DTHR_INICIO_INTRP_UC")
    return scan_layouts(spark, [f"{base}/raw", f"{base}/processed", f"{base}/./processed/"])


@register("scan_processed", "SELECT * FROM events")
def q_scan_processed(spark, sf):
    return sio.scan_processed(spark, [f"{sf}/events.parquet", f"{sf}/./events.parquet"])


@register("load_csv_good", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS DOUBLE) AS o_totalprice,
       o_orderpriority || ', lote' AS o_lote FROM orders WHERE o_orderkey % 50 NOT IN (1, 2, 3)""")
def q_csv_good(spark, sf):
    return sio.good_records(order_records(spark, sf))


@register("load_csv_rejects", """
SELECT CAST(o_orderkey % 3 AS VARCHAR) AS pasta, CAST(count(*) FILTER (WHERE o_orderkey % 50 NOT IN (1, 2, 3)) AS BIGINT) AS lidos,
       CAST(count(*) FILTER (WHERE o_orderkey % 50 IN (1, 2, 3)) AS BIGINT) AS rejeitados FROM orders GROUP BY 1""")
def q_csv_rejects(spark, sf):
    """The report by file, summed by folder: the files' names are the writer's."""
    by_file = sio.reject_report(order_records(spark, sf))
    folder = F.regexp_extract("arquivo", "pasta=([0-9]+)/", 1)
    return by_file.groupBy(folder.alias("pasta")).agg(F.sum("lidos").alias("lidos"), F.sum("rejeitados").alias("rejeitados"))


@register("load_billed_uc", oracle(
    "SELECT coalesce(REGIONAL_TOTAL, 'SEM_REGIONAL') AS REGIONAL_TOTAL, coalesce(SIGLA_REGIONAL, '') AS SIGLA_REGIONAL, "
    "CAST(ANOMES AS VARCHAR) AS ANOMES, coalesce(TRY_CAST(UC_FATURADA AS DOUBLE), 0.0) AS UC_FATURADA "
    "FROM billed_month", ["billed_month"]))
def q_load_billed(spark, sf):
    return billed(spark, sf, None)


DATA_MES = "202401"


def extraction(spark, sf):
    return ex.extract_interruptions(table(spark, sf, "hist_src"), table(spark, sf, "intrp_src"), DATA_MES)


# ---------------------------------------------------------------------------
# E1/J1, E2/J2
# ---------------------------------------------------------------------------

J1_SQL = """
SELECT h.num_uc_hcai, h.indic_reg_orig_intrp_hcai, h.num_intrp_hcai,
       coalesce(h.num_intrp_inic_manobra_hcai, h.num_intrp_hcai) AS num_intrp_inic_manobra,
       i.TIPO_PROTOC_JUSTIF_INTRP AS tipo_justif, i.data_hora_inic_intrp AS inicio, f.data_hora_fim_intrp AS fim
FROM hist_src h
LEFT JOIN intrp_src i ON h.indic_reg_orig_intrp_hcai = i.indic_reg_orig_intrp
      AND coalesce(h.num_intrp_inic_manobra_hcai, h.num_intrp_hcai) = i.NUM_SEQ_INTRP
LEFT JOIN intrp_src f ON h.indic_reg_orig_intrp_hcai = f.indic_reg_orig_intrp AND h.num_intrp_hcai = f.NUM_SEQ_INTRP
WHERE h.indic_fat_hcai = 'S'"""


@register("join_self_start_end", oracle(J1_SQL, ["hist_src", "intrp_src"]))
def q_j1(spark, sf):
    return ex.join_self_start_end(table(spark, sf, "hist_src"), table(spark, sf, "intrp_src"))


E1_SQL = f"""
SELECT CAST(num_uc_hcai AS VARCHAR) AS NUM_UC_UCI, CAST(indic_reg_orig_intrp_hcai AS VARCHAR) AS SIGLA_REGIONAL,
       CAST(num_intrp_hcai AS VARCHAR) AS NUM_INTRP_UCI, CAST(tipo_justif AS VARCHAR) AS TIPO_PROTOC_JUSTIF_UCI,
       strftime(inicio, '%Y-%m-%d %H:%M:%S') AS DTHR_INICIO_INTRP_UC,
       strftime(fim, '%Y-%m-%d %H:%M:%S') AS DATA_HORA_FIM_INTRP,
       CAST(num_intrp_inic_manobra AS VARCHAR) AS NUM_INTRP_INIC_MANOBRA_UCI,
       printf('%.3f', date_diff('second', inicio, fim) / 60.0) AS DURACAO_PERCEBIDA_MINUTOS
FROM ({J1_SQL}) j
WHERE inicio >= TIMESTAMP '2024-01-01 00:00:00' AND inicio < TIMESTAMP '2024-02-01 00:00:00'"""


@register("extract_interruptions", oracle(E1_SQL, ["hist_src", "intrp_src"]))
def q_e1(spark, sf):
    return extraction(spark, sf)


@register("extract_limit", oracle(f"SELECT * FROM ({E1_SQL}) e ORDER BY NUM_INTRP_UCI NULLS FIRST LIMIT 100",
                                  ["hist_src", "intrp_src"]))
def q_s6(spark, sf):
    return sio.extract_limit(extraction(spark, sf), 100, ["NUM_INTRP_UCI"])


@register("extract_limit_any", oracle(f"SELECT least(count(*), 100) AS linhas FROM ({E1_SQL}) e", ["hist_src", "intrp_src"]))
def q_s6_any(spark, sf):
    return sio.extract_limit(extraction(spark, sf), 100).agg(F.count(F.lit(1)).alias("linhas"))


P_DATA_INI = "1998-01-01"
J2_SQL = """
SELECT h.COD_LOCAL_HQCL, h.ANO_MES_HQCL, h.QTDE_CONS_FAT_URB_HQCL, h.QTDE_CONS_FAT_RUR_HQCL,
       s.COD_SDIS, r.SIGLA_RDIS
FROM hqcl_src h JOIN local_src l ON l.COD_LOCAL = h.COD_LOCAL_HQCL
LEFT JOIN section_src s ON l.COD_SECCION_DISTR_LOCAL = s.COD_SDIS
LEFT JOIN regional_src r ON s.COD_REG_DISTR_SDIS = r.COD_RDIS"""
GEO = ["hqcl_src", "local_src", "section_src", "regional_src"]


def _geo(spark, sf):
    return [table(spark, sf, n) for n in GEO]


@register("join_geo_chain", oracle(J2_SQL, GEO))
def q_j2(spark, sf):
    return ex.join_geo_chain(*_geo(spark, sf)).select(
        "COD_LOCAL_HQCL", "ANO_MES_HQCL", "QTDE_CONS_FAT_URB_HQCL", "QTDE_CONS_FAT_RUR_HQCL", "COD_SDIS", "SIGLA_RDIS")


E2_SQL = f"""
SELECT CASE WHEN GROUPING(r.SIGLA_RDIS) = 1 THEN 'COPEL' ELSE r.SIGLA_RDIS END AS REGIONAL_TOTAL,
       CASE WHEN GROUPING(r.SIGLA_RDIS) = 1 THEN 'COPEL' ELSE
         CASE r.SIGLA_RDIS WHEN 'CSL' THEN 'P' WHEN 'NRT' THEN 'L' WHEN 'NRO' THEN 'M' WHEN 'LES' THEN 'C'
              WHEN 'OES' THEN 'V' ELSE 'COPEL' END END AS SIGLA_REGIONAL,
       strftime(h.ANO_MES_HQCL, '%Y-%m') AS ANOMES,
       CAST(sum(h.QTDE_CONS_FAT_URB_HQCL + h.QTDE_CONS_FAT_RUR_HQCL) AS DOUBLE) AS UC_FATURADA
FROM hqcl_src h JOIN local_src l ON l.COD_LOCAL = h.COD_LOCAL_HQCL
LEFT JOIN section_src s ON l.COD_SECCION_DISTR_LOCAL = s.COD_SDIS
LEFT JOIN regional_src r ON s.COD_REG_DISTR_SDIS = r.COD_RDIS
WHERE h.ANO_MES_HQCL >= TIMESTAMP '{P_DATA_INI} 00:00:00' AND r.SIGLA_RDIS <> 'SCD'
GROUP BY GROUPING SETS ((strftime(h.ANO_MES_HQCL, '%Y-%m'), r.SIGLA_RDIS), (strftime(h.ANO_MES_HQCL, '%Y-%m')))
ORDER BY ANOMES DESC, REGIONAL_TOTAL ASC"""


@register("billed_uc_rollup", oracle(E2_SQL, GEO))
def q_e2(spark, sf):
    return ex.billed_uc_rollup(*_geo(spark, sf), P_DATA_INI)


# ---------------------------------------------------------------------------
# Sinks (K1-K4): write under the session's checkpoint folder, read back
# ---------------------------------------------------------------------------

def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("write_month_partition", oracle(
    "SELECT *, CAST(year(DTHR_INICIO_INTRP_UC) AS INTEGER) AS ano, CAST(month(DTHR_INICIO_INTRP_UC) AS INTEGER) AS mes "
    "FROM intr_long", ["intr_long"]))
def q_k1(spark, sf):
    df, start = table(spark, sf, "intr_long"), "DTHR_INICIO_INTRP_UC"
    target = sio.write_month_partition(df, _scratch(spark, "raw"), start)
    sio.write_month_partition(df.where(F.month(start) == 3), target, start)  # a rerun replaces its month only
    return spark.read.parquet(target)


@register("dec_fec_stored", oracle(Q.dec_fec_sql(ANOMES), L_B))
def q_a4_stored(spark, sf):
    """The DEC/FEC table over a stored, month-partitioned marked table."""
    target = sio.write_month_partition(marked_long(spark, sf), _scratch(spark, "marked"), "DTHR_INICIO_INTRP_UC")
    b = billed(spark, sf)
    stored = ind.eligible_rows(spark.read.parquet(target), ANOMES, b, partition=("ano", "mes"))
    return ind.dec_fec(ind.consolidate_perceived(stored), b)


@register("overwrite_processed", oracle(f"SELECT * FROM {Q.marked_long()} m", ["intr_long"]))
def q_k2(spark, sf):
    base = _scratch(spark, "processed")
    sio.overwrite_processed(table(spark, sf, "intr_long"), base)
    sio.overwrite_processed(iv.mark_overlaps(sio.read_current(spark, base)), base)
    return sio.read_current(spark, base)


_MONTH_TEXT = "strftime(DTHR_INICIO_INTRP_UC, '%Y') AS ano, strftime(DTHR_INICIO_INTRP_UC, '%m') AS mes"


@register("publish_table", oracle(f"SELECT *, {_MONTH_TEXT} FROM {Q.marked_long()} m", ["intr_long"]))
def q_k2_publish(spark, sf):
    """The marked table published over the raw one."""
    base, start = _scratch(spark, "published"), "DTHR_INICIO_INTRP_UC"
    publish_table(table(spark, sf, "intr_long"), base, start)
    publish_table(iv.mark_overlaps(read_published(spark, base).drop("ano", "mes")), base, start)
    return read_published(spark, base)


@register("publish_months", oracle(f"SELECT *, {_MONTH_TEXT} FROM intr_long", ["intr_long"]))
def q_k1_publish(spark, sf):
    """Every month, then one again, as a correction of it would be published."""
    df, base, start = table(spark, sf, "intr_long"), _scratch(spark, "months"), "DTHR_INICIO_INTRP_UC"
    publish_months(df, base, start)
    publish_months(df.where(F.month(start) == 3), base, start)
    return read_published(spark, base)


@register("write_billed_uc", oracle(E2_SQL, GEO))
def q_k3(spark, sf):
    target = sio.write_billed_uc(ex.billed_uc_rollup(*_geo(spark, sf), P_DATA_INI), _scratch(spark, "billed"))
    return spark.read.parquet(target)


@register("export_results", oracle(Q.dec_fec_sql(ANOMES), L_B))
def q_k4(spark, sf):
    res = ind.dec_fec(unique_long(spark, sf), billed(spark, sf))
    target = sio.export_results(res, _scratch(spark, "export"), "csv")
    return spark.read.schema(res.schema).option("header", True).csv(target)


# ---------------------------------------------------------------------------
# Projections and scalar functions
# ---------------------------------------------------------------------------

@register("resolve_columns", oracle(
    "SELECT NUM_UC_UCI AS uc, NUM_INTRP_INIC_MANOBRA_UCI AS intrp, DTHR_INICIO_INTRP_UC AS inicio, "
    "DATA_HORA_FIM_INTRP AS fim FROM intr_long", ["intr_long"]))
def q_p1(spark, sf):
    return _resolve_columns(table(spark, sf, "intr_long"),
                            {"uc": UC_ALIASES, "intrp": MANOEUVRE_ID_ALIASES, "inicio": START_ALIASES,
                             "fim": END_ALIASES})


@register("resolve_columns_fuzzy", oracle(
    "SELECT NUM_UC_UCI AS uc, DTHR_INICIO_INTRP_UC AS inicio, DATA_HORA_FIM_INTRP AS fim FROM intr_long",
    ["intr_long"]))
def q_p2(spark, sf):
    df = table(spark, sf, "intr_long")
    uc = resolve_column_fuzzy(df.columns, ["num", "uc"])
    ini = resolve_column_fuzzy(df.columns, ["inicio"], ["dthr", "dt_"])
    fim = resolve_column_fuzzy(df.columns, ["fim"], ["data", "dt_"])
    return df.select(F.col(uc).alias("uc"), F.col(ini).alias("inicio"), F.col(fim).alias("fim"))


def _text(spark, sf):
    return table(spark, sf, "intr_text")


@register("parse_ts", oracle(
    f"SELECT NUM_INTRP_UCI, DTHR_INICIO_TXT, {PTS('DTHR_INICIO_TXT')} AS DTHR_INICIO, "
    f"DATA_HORA_FIM_TXT, {PTS('DATA_HORA_FIM_TXT')} AS DATA_HORA_FIM FROM intr_text", ["intr_text"]))
def q_p4(spark, sf):
    t = _text(spark, sf)
    return t.select("NUM_INTRP_UCI", "DTHR_INICIO_TXT", S.parse_ts("DTHR_INICIO_TXT").alias("DTHR_INICIO"),
                    "DATA_HORA_FIM_TXT", S.parse_ts("DATA_HORA_FIM_TXT").alias("DATA_HORA_FIM"))


@register("parse_ts_import", oracle(
    f"SELECT NUM_INTRP_UCI, DTHR_INICIO_TXT, {PTS_IMPORT('DTHR_INICIO_TXT')} AS DTHR_INICIO, "
    f"DATA_HORA_FIM_TXT, {PTS_IMPORT('DATA_HORA_FIM_TXT')} AS DATA_HORA_FIM FROM intr_text", ["intr_text"]))
def q_p5(spark, sf):
    t = _text(spark, sf)
    return t.select("NUM_INTRP_UCI", "DTHR_INICIO_TXT", S.parse_ts_import("DTHR_INICIO_TXT").alias("DTHR_INICIO"),
                    "DATA_HORA_FIM_TXT", S.parse_ts_import("DATA_HORA_FIM_TXT").alias("DATA_HORA_FIM"))


@register("parse_duration", oracle(
    f"SELECT NUM_INTRP_UCI, DURACAO_PERCEBIDA_MINUTOS, TRY_CAST(DURACAO_PERCEBIDA_MINUTOS AS DOUBLE) AS DUR_MIN, "
    f"coalesce(TRY_CAST(DURACAO_PERCEBIDA_MINUTOS AS DOUBLE), 0.0) AS DUR_MIN_0 FROM ({E1_SQL}) e",
    ["hist_src", "intrp_src"]))
def q_p6(spark, sf):
    e = extraction(spark, sf)
    return e.select("NUM_INTRP_UCI", "DURACAO_PERCEBIDA_MINUTOS",
                    S.parse_duration("DURACAO_PERCEBIDA_MINUTOS").alias("DUR_MIN"),
                    S.parse_duration("DURACAO_PERCEBIDA_MINUTOS", 0.0).alias("DUR_MIN_0"))


@register("month_key", oracle(
    f"SELECT NUM_INTRP_UCI, {MONTH_TXT('DTHR_INICIO_TXT')} AS MES_INICIO_TXT, {MONTH_TXT('MES_TXT')} AS MES_LIVRE, "
    f"strftime(DTHR_INICIO_INTRP_UC, '%Y-%m') AS MES_INICIO FROM intr_text",
    ["intr_text"]))
def q_p7(spark, sf):
    return _text(spark, sf).select(
                    "NUM_INTRP_UCI", S.month_key("DTHR_INICIO_TXT").alias("MES_INICIO_TXT"),
                    S.month_key("MES_TXT").alias("MES_LIVRE"),
                    S.month_key("DTHR_INICIO_INTRP_UC", T.TimestampNTZType()).alias("MES_INICIO"))


_ym_year, _ym_month = ("(CASE " + " ".join(
    f"WHEN regexp_matches(trim(MES_TXT), '{p}') THEN regexp_extract(trim(MES_TXT), '{p}', {at[i]})"
    for p, *at in S.MONTH_TEXT) + " END)" for i in (0, 1))


@register("parse_year_month", oracle(
    f"SELECT NUM_INTRP_UCI, MES_TXT, "
    f"CASE WHEN CAST({_ym_month} AS INTEGER) BETWEEN 1 AND 12 THEN CAST({_ym_year} AS INTEGER) END AS ano, "
    f"CASE WHEN CAST({_ym_month} AS INTEGER) BETWEEN 1 AND 12 THEN CAST({_ym_month} AS INTEGER) END AS mes "
    f"FROM intr_text", ["intr_text"]))
def q_p8(spark, sf):
    ym = S.parse_year_month("MES_TXT")
    return _text(spark, sf).select("NUM_INTRP_UCI", "MES_TXT", ym["ano"].alias("ano"), ym["mes"].alias("mes"))


@register("regional_code_map", oracle(
    f"SELECT NUM_INTRP_UCI, SIGLA_REGIONAL, {REGION_CASE} AS REGIONAL_TOTAL FROM intr_long", ["intr_long"]))
def q_p9(spark, sf):
    df = table(spark, sf, "intr_long")
    return df.select("NUM_INTRP_UCI", "SIGLA_REGIONAL", S.regional_code_map(df).alias("REGIONAL_TOTAL"))


@register("regional_label", oracle(
    f"SELECT NUM_INTRP_UCI, SIGLA_REGIONAL, {LABEL('SIGLA_REGIONAL')} AS sigla_regional_rotulo FROM intr_long",
    ["intr_long"]))
def q_p10(spark, sf):
    return table(spark, sf, "intr_long").select(
        "NUM_INTRP_UCI", "SIGLA_REGIONAL", S.regional_label("SIGLA_REGIONAL").alias("sigla_regional_rotulo"))


@register("parse_flag", oracle(
    "SELECT NUM_INTRP_UCI, TIPO_PROTOC_JUSTIF_UCI, "
    "coalesce(lower(trim(TIPO_PROTOC_JUSTIF_UCI)) IN ('true', '1', 'sim', 'yes', 'y'), false) AS FLAG_TIPO, "
    "coalesce(verificado, false) AS FLAG_VERIFICADO "
    f"FROM {Q.marked_long()} m", ["intr_long"]))
def q_p11(spark, sf):
    m = marked_long(spark, sf)
    return m.select("NUM_INTRP_UCI", "TIPO_PROTOC_JUSTIF_UCI",
                    S.parse_flag("TIPO_PROTOC_JUSTIF_UCI", T.StringType()).alias("FLAG_TIPO"),
                    S.parse_flag("verificado", T.BooleanType()).alias("FLAG_VERIFICADO"))


def _holes(spark, sf):
    """Marked B1 with perceived values knocked out and the verified flag as text."""
    m = marked_long(spark, sf)
    i = F.col("NUM_INTRP_UCI").cast("long")
    return m.select(
        "NUM_INTRP_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", "NUM_INTRP_INIC_MANOBRA_UCI",
        F.when(i % 9 != 0, F.col("NUM_INTRP_PERCEBIDA")).alias("NUM_INTRP_PERCEBIDA"),
        F.when(i % 5 != 0, F.col("DTHR_INICIO_INTRP_PERCEBIDO")).alias("DTHR_INICIO_INTRP_PERCEBIDO"),
        F.when(i % 7 != 0, F.col("DATA_HORA_FIM_INTR_PERCEBIDO")).alias("DATA_HORA_FIM_INTR_PERCEBIDO"),
        F.when(i % 3 != 0, F.col("DURACAO_PERCEBIDA_MINUTOS")).alias("DURACAO_PERCEBIDA_MINUTOS"),
        F.when(i % 4 == 0, F.lit("sim")).when(i % 4 == 1, F.lit("nao")).when(i % 4 == 2, F.lit("talvez"))
        .alias("verificado"))


BACKFILL_SQL = f"""
SELECT NUM_INTRP_UCI, DTHR_INICIO_INTRP_UC, DATA_HORA_FIM_INTRP, NUM_INTRP_INIC_MANOBRA_UCI, NUM_INTRP_PERCEBIDA,
       s AS DTHR_INICIO_INTRP_PERCEBIDO, e AS DATA_HORA_FIM_INTR_PERCEBIDO, d AS DURACAO_PERCEBIDA_MINUTOS,
       CASE WHEN lower(trim(v)) IN ('true', '1', 'sim', 'yes') THEN true
            WHEN lower(trim(v)) IN ('false', '0', 'nao', 'não', 'no') THEN false ELSE true END AS verificado,
       coalesce(d, 0.0) >= 3.0 AS longa_duracao, s AS DTHR_INICIO_INTRP_PERCEBIDA, e AS DATA_HORA_FIM_INTR_PERCEBIDA
FROM (SELECT *, coalesce(d0, date_diff('second', s, e) / 60.0) AS d FROM (
  SELECT NUM_INTRP_UCI, DTHR_INICIO_INTRP_UC, DATA_HORA_FIM_INTRP, NUM_INTRP_INIC_MANOBRA_UCI,
    coalesce(CASE WHEN CAST(NUM_INTRP_UCI AS BIGINT) % 9 <> 0 THEN NUM_INTRP_PERCEBIDA END, NUM_INTRP_INIC_MANOBRA_UCI) AS NUM_INTRP_PERCEBIDA,
    coalesce(CASE WHEN CAST(NUM_INTRP_UCI AS BIGINT) % 5 <> 0 THEN DTHR_INICIO_INTRP_PERCEBIDO END, DTHR_INICIO_INTRP_UC) AS s,
    coalesce(CASE WHEN CAST(NUM_INTRP_UCI AS BIGINT) % 7 <> 0 THEN DATA_HORA_FIM_INTR_PERCEBIDO END, DATA_HORA_FIM_INTRP) AS e,
    CASE WHEN CAST(NUM_INTRP_UCI AS BIGINT) % 3 <> 0 THEN DURACAO_PERCEBIDA_MINUTOS END AS d0,
    CASE CAST(NUM_INTRP_UCI AS BIGINT) % 4 WHEN 0 THEN 'sim' WHEN 1 THEN 'nao' WHEN 2 THEN 'talvez' END AS v
  FROM {Q.marked_long()} m) a) b"""


@register("backfill_perceived", oracle(BACKFILL_SQL, ["intr_long"]))
def q_p12(spark, sf):
    out = S.backfill_perceived(_holes(spark, sf))
    return out.select("NUM_INTRP_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", "NUM_INTRP_INIC_MANOBRA_UCI",
                      "NUM_INTRP_PERCEBIDA", "DTHR_INICIO_INTRP_PERCEBIDO", "DATA_HORA_FIM_INTR_PERCEBIDO", "DURACAO_PERCEBIDA_MINUTOS", "verificado", "longa_duracao",
                      "DTHR_INICIO_INTRP_PERCEBIDA", "DATA_HORA_FIM_INTR_PERCEBIDA")


@register("standardize_columns", oracle(
    "SELECT " + ", ".join(f"{c} AS {c.lower()}" for c in _B1_COLS) + " FROM intr_long", ["intr_long"]))
def q_p13(spark, sf):
    return standardize_columns(table(spark, sf, "intr_long"))


@register("strip_accents", oracle(
    f"SELECT doc_id, lower(trim(translate(text, '{S.ACCENTED}', '{S.PLAIN}'))) AS texto_normalizado FROM documents",
    []))
def q_p14(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", S.strip_accents("text").alias("texto_normalizado"))


CLEAN_SQL = """
SELECT coalesce(SIGLA_REGIONAL, '') AS SIGLA_REGIONAL, coalesce(TIPO_PROTOC_JUSTIF_UCI, '') AS TIPO_PROTOC_JUSTIF_UCI,
       coalesce(DUR_MIN, 0.0) AS DUR_MIN
FROM (SELECT DISTINCT SIGLA_REGIONAL, TIPO_PROTOC_JUSTIF_UCI,
             floor(date_diff('second', DTHR_INICIO_INTRP_UC, DATA_HORA_FIM_INTRP) / 600.0) AS DUR_MIN FROM intr_long) d"""


@register("clean_data", oracle(CLEAN_SQL, ["intr_long"]))
def q_p15(spark, sf):
    b = table(spark, sf, "intr_long")
    proj = b.select("SIGLA_REGIONAL", "TIPO_PROTOC_JUSTIF_UCI",
                    F.floor(S.seconds_between(F.col("DTHR_INICIO_INTRP_UC"), F.col("DATA_HORA_FIM_INTRP")) / 600.0)
                    .cast("double").alias("DUR_MIN"))
    return S.clean_data(proj)


# Rows with nulls, a third of them twice, and rows that only a null tells apart.
_GAPS_SQL = """
SELECT * REPLACE (CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type,
                  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value) FROM events"""
_GAPS_COPIED = f"({_GAPS_SQL} UNION ALL SELECT * FROM ({_GAPS_SQL}) t WHERE event_id % 3 = 0)"


@register("clean_data_rows", f"""
SELECT * REPLACE (coalesce(user_id, 0) AS user_id, coalesce(event_type, '') AS event_type, coalesce(value, 0.0) AS value)
FROM (SELECT DISTINCT * FROM {_GAPS_COPIED} c) d""")
def q_p15_rows(spark, sf):
    """Whole rows with nulls."""
    gaps = table(spark, sf, "events").withColumns({
        "user_id": F.when(F.col("event_id") % 4 != 0, F.col("user_id")),
        "event_type": F.when(F.col("event_id") % 5 != 0, F.col("event_type")),
        "value": F.when(F.col("event_id") % 7 != 0, F.col("value"))})
    return S.clean_data(gaps.unionByName(gaps.where(F.col("event_id") % 3 == 0)))


@register("second_precision", oracle(
    "SELECT NUM_INTRP_UCI, (second(DTHR_INICIO_INTRP_UC) > 0 OR second(DATA_HORA_FIM_INTRP) > 0) AS TEM_PRECISAO_SEGUNDO, "
    "date_trunc('minute', DTHR_INICIO_INTRP_UC) AS DT_INI_MIN, date_trunc('minute', DATA_HORA_FIM_INTRP) AS DT_FIM_MIN "
    "FROM intr_dense", ["intr_dense"]))
def q_p16(spark, sf):
    d = table(spark, sf, "intr_dense")
    return d.select("NUM_INTRP_UCI",
                    S.second_precision(F.col("DTHR_INICIO_INTRP_UC"), F.col("DATA_HORA_FIM_INTRP")).alias("TEM_PRECISAO_SEGUNDO"),
                    S.truncate_minute(F.col("DTHR_INICIO_INTRP_UC")).alias("DT_INI_MIN"),
                    S.truncate_minute(F.col("DATA_HORA_FIM_INTRP")).alias("DT_FIM_MIN"))


@register("safe_div", oracle(
    f"SELECT u.REGIONAL_TOTAL, CAST(count(*) AS DOUBLE) AS CI, coalesce(max(b.UC_FATURADA), 0.0) AS UC_FATURADA, "
    f"CASE WHEN coalesce(max(b.UC_FATURADA), 0.0) = 0 THEN 0.0 ELSE count(*) / max(b.UC_FATURADA) END AS FEC "
    f"FROM {UNIQUE} u LEFT JOIN {UC_MONTH} b ON u.REGIONAL_TOTAL = b.REGIONAL_TOTAL GROUP BY 1", L_B))
def q_p17(spark, sf):
    return ind.interruption_rate(unique_long(spark, sf), billed(spark, sf))


# ---------------------------------------------------------------------------
# Filters (F1-F5)
# ---------------------------------------------------------------------------

@register("eligible_rows", oracle(f"SELECT * FROM {ELIGIBLE()} e", L_B))
def q_f1(spark, sf):
    return ind.eligible_rows(marked_long(spark, sf), ANOMES, billed(spark, sf))


MAX_HOURS = 4.0


@register("max_duration", oracle(f"SELECT * FROM {UNIQUE} u WHERE DUR_MIN <= {MAX_HOURS * 60.0!r}", L_B))
def q_f2(spark, sf):
    return ind.max_duration(unique_long(spark, sf), MAX_HOURS)


@register("duration_bands", oracle(
    "SELECT CASE WHEN coalesce(TRY_CAST(DURACAO_PERCEBIDA_MINUTOS AS DOUBLE), 0.0) >= 3.0 THEN '>=3' ELSE '<3' END AS FAIXA, "
    f"count(*) AS registros FROM {Q.marked_long()} m GROUP BY 1", ["intr_long"]))
def q_f3(spark, sf):
    return ind.duration_bands(marked_long(spark, sf)).groupBy("FAIXA").agg(F.count(F.lit(1)).alias("registros"))


VALID_DENSE_SQL = f"""
SELECT * FROM (SELECT {REGION_CASE} AS REGIONAL_TOTAL, CAST(NUM_UC_UCI AS VARCHAR) AS NUM_UC_UCI,
  CAST(NUM_INTRP_UCI AS VARCHAR) AS NUM_INTRP, DTHR_INICIO_INTRP_UC AS DT_INI, DATA_HORA_FIM_INTRP AS DT_FIM
  FROM intr_dense) v
WHERE NUM_UC_UCI IS NOT NULL AND NUM_UC_UCI <> '' AND DT_INI IS NOT NULL AND DT_FIM IS NOT NULL
  AND DT_FIM >= DT_INI AND REGIONAL_TOTAL <> 'COPEL'"""


@register("valid_interval", oracle(VALID_DENSE_SQL, ["intr_dense"]))
def q_f4(spark, sf):
    d = table(spark, sf, "intr_dense")
    base = d.select(S.regional_code_map(d).alias("REGIONAL_TOTAL"), F.col("NUM_UC_UCI").cast("string").alias("NUM_UC_UCI"),
                    F.col("NUM_INTRP_UCI").cast("string").alias("NUM_INTRP"),
                    F.col("DTHR_INICIO_INTRP_UC").alias("DT_INI"), F.col("DATA_HORA_FIM_INTRP").alias("DT_FIM"))
    return base.where(iv.valid_interval(base))


@register("regional_subset", oracle(f"SELECT * FROM {UNIQUE} u WHERE REGIONAL_TOTAL IN ('NRT', 'NRO')", L_B))
def q_f5(spark, sf):
    return ind.regional_subset(unique_long(spark, sf))


# ---------------------------------------------------------------------------
# Joins (J3-J5)
# ---------------------------------------------------------------------------

def _month_rows_sql() -> str:
    lo, hi = Q.month_bounds(ANOMES)
    return (f"(SELECT * FROM {Q.marked_long()} m WHERE DTHR_INICIO_INTRP_PERCEBIDO >= {lo} "
            f"AND DTHR_INICIO_INTRP_PERCEBIDO < {hi})")


@register("region_lookup", oracle(
    f"SELECT m.NUM_UC_UCI, m.NUM_INTRP_UCI, coalesce(m.SIGLA_REGIONAL, '') AS SIGLA_REGIONAL, "
    f"coalesce(mp.REGIONAL_TOTAL, 'SEM_REGIONAL') AS REGIONAL_TOTAL FROM {_month_rows_sql()} m "
    f"LEFT JOIN (SELECT DISTINCT SIGLA_REGIONAL, REGIONAL_TOTAL FROM billed_month WHERE ANOMES = '{ANOMES}' "
    f"AND SIGLA_REGIONAL IS NOT NULL AND SIGLA_REGIONAL <> '' AND REGIONAL_TOTAL <> 'COPEL') mp "
    f"ON coalesce(m.SIGLA_REGIONAL, '') = mp.SIGLA_REGIONAL", L_B))
def q_j3(spark, sf):
    m = marked_long(spark, sf).where(S.in_month("DTHR_INICIO_INTRP_PERCEBIDO", ANOMES))
    m = m.select("NUM_UC_UCI", "NUM_INTRP_UCI", F.coalesce("SIGLA_REGIONAL", F.lit("")).alias("SIGLA_REGIONAL"))
    return (m.join(broadcast_bounded(ind.region_lookup(billed(spark, sf))), "SIGLA_REGIONAL", "left")
            .select("NUM_UC_UCI", "NUM_INTRP_UCI", "SIGLA_REGIONAL",
                    F.coalesce("REGIONAL_TOTAL", F.lit(S.NO_REGION)).alias("REGIONAL_TOTAL")))


INDICATOR_BASE_SQL = f"""
SELECT b.REGIONAL_TOTAL, b.UC_FATURADA,
  CAST(coalesce(s.CIL, 0) AS DOUBLE) AS CI_LIQUIDO, CAST(coalesce(s.CHL, 0) AS DOUBLE) / 3600000000.0 AS CHI_LIQUIDO,
  CAST(coalesce(s.CIE, 0) AS DOUBLE) AS CI_EXPURGO, CAST(coalesce(s.CHE, 0) AS DOUBLE) / 3600000000.0 AS CHI_EXPURGO
FROM {UC_MONTH} b LEFT JOIN (
  SELECT REGIONAL_TOTAL, count(*) FILTER (WHERE NATUREZA = 'LIQUIDO') AS CIL,
    sum(CASE WHEN NATUREZA = 'LIQUIDO' THEN {Q.us('DUR_MIN')} END) AS CHL,
    count(*) FILTER (WHERE NATUREZA <> 'LIQUIDO') AS CIE,
    sum(CASE WHEN NATUREZA <> 'LIQUIDO' THEN {Q.us('DUR_MIN')} END) AS CHE
  FROM {UNIQUE} u GROUP BY 1) s ON b.REGIONAL_TOTAL = s.REGIONAL_TOTAL"""


@register("join_indicator_base", oracle(INDICATOR_BASE_SQL, L_B))
def q_j4(spark, sf):
    return ind.indicator_base(unique_long(spark, sf), billed(spark, sf))


def monthly_orders(spark, sf):
    return dq.regional_monthly(table(spark, sf, "orders_regional"))


MONTHLY_SQL = (f"(SELECT {LABEL('sigla_regional')} AS sigla_regional, strftime(data_referencia, '%Y-%m') AS mes_ref, "
               f"count(*) AS registros FROM orders_regional WHERE data_referencia IS NOT NULL GROUP BY 1, 2)")
OR = ["orders_regional"]
TWO_MONTHS_SQL = f"""
SELECT sigla_regional,
  CAST(coalesce(sum(CASE WHEN mes_ref = (SELECT max(mes_ref) FROM {MONTHLY_SQL} a) THEN registros END), 0) AS BIGINT) AS registros_atual,
  CAST(coalesce(sum(CASE WHEN mes_ref = (SELECT max(mes_ref) FROM {MONTHLY_SQL} b
        WHERE mes_ref < (SELECT max(mes_ref) FROM {MONTHLY_SQL} c)) THEN registros END), 0) AS BIGINT) AS registros_anterior
FROM {MONTHLY_SQL} m
WHERE mes_ref >= (SELECT max(mes_ref) FROM {MONTHLY_SQL} d WHERE mes_ref < (SELECT max(mes_ref) FROM {MONTHLY_SQL} e))
GROUP BY 1"""


@register("join_two_months", oracle(TWO_MONTHS_SQL, OR))
def q_j5(spark, sf):
    return dq.join_two_months(monthly_orders(spark, sf))


# ---------------------------------------------------------------------------
# Aggregations
# ---------------------------------------------------------------------------

@register("consolidate_perceived", oracle(
    f"SELECT REGIONAL_TOTAL, NUM_UC_UCI, NUM_INTRP_PERCEBIDA, max(DUR_MIN) AS DUR_MIN, "
    f"bool_and(TIPO_PROTOC_JUSTIF_UCI = '0') AS TIPO_0_ALL FROM {ELIGIBLE()} e GROUP BY 1, 2, 3", L_B))
def q_a1(spark, sf):
    return ind.perceived_interruptions(ind.eligible_rows(marked_long(spark, sf), ANOMES, billed(spark, sf)))


@register("classify_nature", oracle(f"SELECT * FROM {UNIQUE} u", L_B))
def q_a2(spark, sf):
    return unique_long(spark, sf)


@register("ci_chi", oracle(
    f"SELECT REGIONAL_TOTAL, NATUREZA, count(*) AS CI, CAST(sum({Q.us('DUR_MIN')}) AS DOUBLE) / 3600000000.0 AS CHI_HORAS "
    f"FROM {UNIQUE} u GROUP BY 1, 2", L_B))
def q_a3(spark, sf):
    return ind.ci_chi(unique_long(spark, sf))


@register("uc_by_region", oracle(f"SELECT * FROM {UC_MONTH} b", ["billed_month"]))
def q_a5(spark, sf):
    return ind.uc_by_region(billed(spark, sf))


def _stats_sql() -> str:
    med = f"""(SELECT REGIONAL_TOTAL, avg(DUR_MIN) AS v FROM (
      SELECT REGIONAL_TOTAL, DUR_MIN, row_number() OVER (PARTITION BY REGIONAL_TOTAL ORDER BY DUR_MIN) - 1 AS i,
             count(*) OVER (PARTITION BY REGIONAL_TOTAL) AS n FROM {UNIQUE} u) z
      WHERE i = floor((n - 1) / 2.0) OR i = ceil((n - 1) / 2.0) GROUP BY 1)"""
    return f"""
SELECT a.REGIONAL_TOTAL, a.QTD_INTRP, {RH('med.v / 60.0', 2)} AS DUR_MEDIANA_H, {RH('p95.v / 60.0', 2)} AS DUR_P95_H,
       {RH('p99.v / 60.0', 2)} AS DUR_P99_H, {RH('a.mx / 60.0', 2)} AS DUR_MAX_H
FROM (SELECT REGIONAL_TOTAL, count(*) AS QTD_INTRP, max(DUR_MIN) AS mx FROM {UNIQUE} u GROUP BY 1) a
JOIN {med} med USING (REGIONAL_TOTAL)
JOIN {nearest_sql(UNIQUE, 'DUR_MIN', 'REGIONAL_TOTAL', 0.95)} p95 USING (REGIONAL_TOTAL)
JOIN {nearest_sql(UNIQUE, 'DUR_MIN', 'REGIONAL_TOTAL', 0.99)} p99 USING (REGIONAL_TOTAL)
ORDER BY 1"""


@register("duration_stats", oracle(_stats_sql(), L_B))
def q_a6(spark, sf):
    return ind.duration_stats(unique_long(spark, sf))


PREVIEW_SQL = f"""
SELECT FAIXA, SIGLA_REGIONAL, {RH('CAST(ci AS DOUBLE)', 0)} AS CI, {RH('CAST(chi_us AS DOUBLE) / 3600000000.0', 2)} AS CHI_horas
FROM (SELECT CASE WHEN d >= 3.0 THEN '>=3' ELSE '<3' END AS FAIXA, coalesce(SIGLA_REGIONAL, 'SEM_REGIONAL') AS SIGLA_REGIONAL,
             count(DISTINCT NUM_UC_UCI) + max(CASE WHEN NUM_UC_UCI IS NULL THEN 1 ELSE 0 END) AS ci,
             sum({Q.us('d')}) AS chi_us
      FROM (SELECT *, coalesce(TRY_CAST(DURACAO_PERCEBIDA_MINUTOS AS DOUBLE), 0.0) AS d FROM {Q.marked_long()} m) x
      GROUP BY 1, 2) g"""


@register("ci_chi_preview", oracle(PREVIEW_SQL, ["intr_long"]))
def q_a7(spark, sf):
    return ind.ci_chi_preview(marked_long(spark, sf))


@register("ci_chi_preview_totals", oracle(
    f"SELECT FAIXA, sum(CI) AS CI_TOTAL, {RH('sum(CHI_horas)', 2)} AS CHI_TOTAL FROM ({PREVIEW_SQL}) p GROUP BY 1",
    ["intr_long"]))
def q_a8(spark, sf):
    return ind.ci_chi_preview_totals(ind.ci_chi_preview(marked_long(spark, sf)))


SUMMARY_SQL = f"""
SELECT sigla_regional, registros, CASE WHEN sum(registros) OVER () > 0
       THEN registros / sum(registros) OVER () * 100.0 ELSE 0.0 END AS pct_registros
FROM (SELECT {LABEL('SIGLA_REGIONAL')} AS sigla_regional, count(*) AS registros FROM intr_long GROUP BY 1) c"""


@register("regional_summary", oracle(SUMMARY_SQL, ["intr_long"]))
def q_a9(spark, sf):
    return dq.regional_summary(table(spark, sf, "intr_long"), "SIGLA_REGIONAL")


@register("regional_monthly", oracle(f"SELECT * FROM {MONTHLY_SQL} m", OR))
def q_a10(spark, sf):
    return monthly_orders(spark, sf)


@register("monthly_total", oracle(
    f"SELECT mes_ref, CAST(sum(registros) AS BIGINT) AS registros FROM {MONTHLY_SQL} m GROUP BY 1", OR))
def q_a11(spark, sf):
    return dq.monthly_total(monthly_orders(spark, sf))


def crit_dense(spark, sf):
    return iv.merge_criteria(table(spark, sf, "intr_dense"))


CRIT_SQL = f"""
(SELECT *, coalesce(GAP_PREV_SEC >= 0 AND GAP_PREV_SEC < 60, false) AS GAP_LT_60S,
   coalesce(GAP_PREV_SEC_MIN >= 0 AND GAP_PREV_SEC_MIN < 60, false) AS GAP_LT_60S_MIN,
   DUR_SEC < 60 AS DUR_LT_60S, DUR_SEC_MIN < 60 AS DUR_LT_60S_MIN,
   coalesce(GAP_PREV_SEC >= 0 AND GAP_PREV_SEC < 60 AND DUR_SEC < 60 AND PREV_DUR_SEC < 60, false) AS MERGE_CRITERIO,
   coalesce(GAP_PREV_SEC_MIN >= 0 AND GAP_PREV_SEC_MIN < 60 AND DUR_SEC_MIN < 60 AND PREV_DUR_SEC_MIN < 60, false)
     AS MERGE_CRITERIO_MINUTO
 FROM (SELECT *, date_diff('second', PREV_FIM_MIN, DT_INI_MIN) AS GAP_PREV_SEC_MIN,
              lag(DUR_SEC_MIN) OVER w AS PREV_DUR_SEC_MIN
       FROM (SELECT *, date_diff('second', PREV_FIM, DT_INI) AS GAP_PREV_SEC, lag(DUR_SEC) OVER w AS PREV_DUR_SEC,
                    date_diff('second', DT_INI_MIN, DT_FIM_MIN) AS DUR_SEC_MIN, lag(DT_FIM_MIN) OVER w AS PREV_FIM_MIN
             FROM (SELECT *, date_diff('second', DT_INI, DT_FIM) AS DUR_SEC, lag(DT_FIM) OVER w AS PREV_FIM,
                          (second(DT_INI) > 0 OR second(DT_FIM) > 0) AS TEM_PRECISAO_SEGUNDO,
                          date_trunc('minute', DT_INI) AS DT_INI_MIN, date_trunc('minute', DT_FIM) AS DT_FIM_MIN
                   FROM ({VALID_DENSE_SQL}) v
                   WINDOW w AS (PARTITION BY REGIONAL_TOTAL, NUM_UC_UCI ORDER BY DT_INI, DT_FIM, NUM_INTRP)) t1
             WINDOW w AS (PARTITION BY REGIONAL_TOTAL, NUM_UC_UCI ORDER BY DT_INI, DT_FIM, NUM_INTRP)) t2
       WINDOW w AS (PARTITION BY REGIONAL_TOTAL, NUM_UC_UCI ORDER BY DT_INI, DT_FIM, NUM_INTRP)) t3)"""
CRIT_COLS = ("REGIONAL_TOTAL, NUM_UC_UCI, NUM_INTRP, DT_INI, DT_FIM, DUR_SEC, GAP_PREV_SEC, PREV_DUR_SEC, "
             "TEM_PRECISAO_SEGUNDO, DUR_SEC_MIN, GAP_PREV_SEC_MIN, PREV_DUR_SEC_MIN, GAP_LT_60S, GAP_LT_60S_MIN, "
             "DUR_LT_60S, DUR_LT_60S_MIN, MERGE_CRITERIO, MERGE_CRITERIO_MINUTO")


def _pct(c: str) -> str:
    return RH(f"({c} / REGISTROS * 100.0)", 2)


PRECISION_SQL = f"""
SELECT *, {_pct('COM_SEGUNDOS')} AS PCT_COM_SEGUNDOS, {_pct('DURACAO_LT_60S')} AS PCT_DUR_LT_60S,
  {_pct('GAP_LT_60S')} AS PCT_GAP_LT_60S, {_pct('MERGE_CRITERIO')} AS PCT_MERGE,
  {_pct('MERGE_CRITERIO_MINUTO')} AS PCT_MERGE_MINUTO, MERGE_CRITERIO - MERGE_CRITERIO_MINUTO AS DELTA_MERGE_SEGUNDO
FROM (SELECT REGIONAL_TOTAL, count(*) AS REGISTROS, count(*) FILTER (WHERE TEM_PRECISAO_SEGUNDO) AS COM_SEGUNDOS,
        count(*) FILTER (WHERE DUR_LT_60S) AS DURACAO_LT_60S, count(*) FILTER (WHERE GAP_LT_60S) AS GAP_LT_60S,
        count(*) FILTER (WHERE MERGE_CRITERIO) AS MERGE_CRITERIO,
        count(*) FILTER (WHERE MERGE_CRITERIO_MINUTO) AS MERGE_CRITERIO_MINUTO
      FROM {CRIT_SQL} c GROUP BY 1) a
ORDER BY PCT_MERGE DESC, REGIONAL_TOTAL"""


@register("precision_summary", oracle(PRECISION_SQL, ["intr_dense"]))
def q_a12(spark, sf):
    return iv.precision_summary(crit_dense(spark, sf))


@register("precision_totals", oracle(
    f"SELECT count(*) FILTER (WHERE MERGE_CRITERIO) AS MERGE_CRITERIO, "
    f"count(*) FILTER (WHERE MERGE_CRITERIO_MINUTO) AS MERGE_CRITERIO_MINUTO, "
    f"count(*) FILTER (WHERE MERGE_CRITERIO) - count(*) FILTER (WHERE MERGE_CRITERIO_MINUTO) AS DELTA_MERGE_SEGUNDO "
    f"FROM {CRIT_SQL} c", ["intr_dense"]))
def q_a13(spark, sf):
    return iv.precision_totals(crit_dense(spark, sf))


@register("mark_summary", oracle(
    f"SELECT count(*) AS total, count(*) FILTER (WHERE verificado) AS verificado_true, "
    f"count(*) FILTER (WHERE Contido_outra_intrp) AS contido_true, count(*) FILTER (WHERE Sobreposicao_tempo) "
    f"AS sobreposto_true, count(*) FILTER (WHERE Conta_desligamento_unico) AS conta_unico_true "
    f"FROM {Q.marked_long()} m", ["intr_long"]))
def q_a14(spark, sf):
    return iv.mark_summary(marked_long(spark, sf))


@register("available_months", oracle(
    f"SELECT DISTINCT strftime(DTHR_INICIO_INTRP_PERCEBIDO, '%Y-%m') AS ANOMES FROM {Q.marked_long()} m "
    f"WHERE DTHR_INICIO_INTRP_PERCEBIDO IS NOT NULL ORDER BY 1 DESC", ["intr_long"]))
def q_a15(spark, sf):
    return dq.available_months(marked_long(spark, sf), "DTHR_INICIO_INTRP_PERCEBIDO")


# ---------------------------------------------------------------------------
# Windows (W1-W9)
# ---------------------------------------------------------------------------

def marked_dense_internal(spark, sf):
    return iv.mark_overlaps(table(spark, sf, "intr_dense"), internals=True)


_MDI = f"{Q.marked_dense(True)} m"
_D = ["intr_dense"]


@register("prev_max_end", oracle(f"SELECT NUM_UC_UCI, NUM_INTRP_UCI, PREV_MAX_FIM FROM {_MDI}", _D))
def q_w1(spark, sf):
    return marked_dense_internal(spark, sf).select("NUM_UC_UCI", "NUM_INTRP_UCI", "PREV_MAX_FIM")


@register("next_min_start", oracle(f"SELECT NUM_UC_UCI, NUM_INTRP_UCI, NEXT_MIN_INI FROM {_MDI}", _D))
def q_w2(spark, sf):
    return marked_dense_internal(spark, sf).select("NUM_UC_UCI", "NUM_INTRP_UCI", "NEXT_MIN_INI")


@register("gap_prev", oracle(
    f"SELECT NUM_UC_UCI, NUM_INTRP_UCI, PREV_FIM, DUR_MIN, GAP_PREV_MIN, PREV_DUR_MIN FROM {_MDI}", _D))
def q_w3(spark, sf):
    return marked_dense_internal(spark, sf).select("NUM_UC_UCI", "NUM_INTRP_UCI", "PREV_FIM", "DUR_MIN",
                                                   "GAP_PREV_MIN", "PREV_DUR_MIN")


@register("outage_group", oracle(
    f"SELECT NUM_UC_UCI, NUM_INTRP_UCI, Conta_desligamento_unico, Grupo_desligamento_uc FROM {_MDI}", _D))
def q_w4(spark, sf):
    return marked_dense_internal(spark, sf).select("NUM_UC_UCI", "NUM_INTRP_UCI", "Conta_desligamento_unico",
                                                   "Grupo_desligamento_uc")


@register("perceived_group", oracle(f"SELECT NUM_UC_UCI, NUM_INTRP_UCI, GRUPO_PERCEBIDO FROM {_MDI}", _D))
def q_w5(spark, sf):
    return marked_dense_internal(spark, sf).select("NUM_UC_UCI", "NUM_INTRP_UCI", "GRUPO_PERCEBIDO")


@register("perceived_bounds", oracle(
    f"SELECT NUM_UC_UCI, NUM_INTRP_UCI, NUM_INTRP_PERCEBIDA, DTHR_INICIO_INTRP_PERCEBIDO, DATA_HORA_FIM_INTR_PERCEBIDO, "
    f"DURACAO_PERCEBIDA_MINUTOS FROM {_MDI}", _D))
def q_w6(spark, sf):
    return marked_dense_internal(spark, sf).select("NUM_UC_UCI", "NUM_INTRP_UCI", "NUM_INTRP_PERCEBIDA",
                                                   "DTHR_INICIO_INTRP_PERCEBIDO", "DATA_HORA_FIM_INTR_PERCEBIDO",
                                                   "DURACAO_PERCEBIDA_MINUTOS")


@register("gap_prev_second_minute", oracle(
    f"SELECT REGIONAL_TOTAL, NUM_UC_UCI, NUM_INTRP, GAP_PREV_SEC, PREV_DUR_SEC, GAP_PREV_SEC_MIN, PREV_DUR_SEC_MIN "
    f"FROM {CRIT_SQL} c", _D))
def q_w7(spark, sf):
    return crit_dense(spark, sf).select("REGIONAL_TOTAL", "NUM_UC_UCI", "NUM_INTRP", "GAP_PREV_SEC", "PREV_DUR_SEC",
                                        "GAP_PREV_SEC_MIN", "PREV_DUR_SEC_MIN")


CHANGE_SQL = f"""
SELECT sigla_regional, mes_ref, registros, registros_mes_anterior,
       CASE WHEN registros_mes_anterior > 0 THEN
         {RH('((registros - registros_mes_anterior) / registros_mes_anterior * 100.0)', 4)} END AS pct_variacao
FROM (SELECT *, lag(registros) OVER (PARTITION BY sigla_regional ORDER BY mes_ref) AS registros_mes_anterior
      FROM {MONTHLY_SQL} m) x"""


@register("monthly_change", oracle(CHANGE_SQL, OR))
def q_w8(spark, sf):
    return dq.monthly_change(monthly_orders(spark, sf))


@register("share_of_total", oracle(
    f"SELECT REGIONAL_TOTAL, PCT_DEC_COM_EXPURGO, PCT_FEC_COM_EXPURGO, PCT_DEC_BRUTO, PCT_FEC_BRUTO, PCT_UC_FATURADA "
    f"FROM ({Q.dec_fec_sql(ANOMES)}) t", L_B))
def q_w9(spark, sf):
    return ind.dec_fec(unique_long(spark, sf), billed(spark, sf)).select(
        "REGIONAL_TOTAL", "PCT_DEC_COM_EXPURGO", "PCT_FEC_COM_EXPURGO", "PCT_DEC_BRUTO", "PCT_FEC_BRUTO",
        "PCT_UC_FATURADA")


# ---------------------------------------------------------------------------
# Sorts, limits, set operations, reshape
# ---------------------------------------------------------------------------

@register("order_total_last", oracle(
    f"SELECT REGIONAL_TOTAL, row_number() OVER (ORDER BY CASE WHEN REGIONAL_TOTAL = 'COPEL' THEN 1 ELSE 0 END, "
    f"REGIONAL_TOTAL) AS ORDEM FROM ({Q.dec_fec_sql(ANOMES)}) t", L_B))
def q_r1(spark, sf):
    t = ind.dec_fec(unique_long(spark, sf), billed(spark, sf)).select("REGIONAL_TOTAL")
    w = Window.orderBy((F.col("REGIONAL_TOTAL") == S.TOTAL_LABEL).cast("int"), "REGIONAL_TOTAL")  # < 20 rows
    return ind.order_total_last(t.select("REGIONAL_TOTAL", F.row_number().over(w).cast("long").alias("ORDEM")))


@register("top_durations", oracle(
    f"SELECT REGIONAL_TOTAL, NUM_UC_UCI, NUM_INTRP_PERCEBIDA, NATUREZA, {RH('DUR_MIN / 60.0', 2)} AS DUR_H, RANK "
    f"FROM (SELECT *, row_number() OVER (PARTITION BY REGIONAL_TOTAL ORDER BY DUR_MIN DESC, NUM_UC_UCI, "
    f"NUM_INTRP_PERCEBIDA) AS RANK FROM {UNIQUE} u WHERE REGIONAL_TOTAL IN ('NRT', 'NRO')) r WHERE RANK <= 100", L_B))
def q_r2(spark, sf):
    return ind.top_durations(unique_long(spark, sf))


@register("merge_sample", oracle(
    "SELECT REGIONAL_TOTAL, NUM_UC_UCI, NUM_INTRP, DT_INI, DT_FIM, DUR_SEC, GAP_PREV_SEC, PREV_DUR_SEC, "
    f"TEM_PRECISAO_SEGUNDO, MERGE_CRITERIO, MERGE_CRITERIO_MINUTO FROM {CRIT_SQL} c WHERE MERGE_CRITERIO "
    "ORDER BY REGIONAL_TOTAL, NUM_UC_UCI, DT_INI, DT_FIM, NUM_INTRP LIMIT 500", _D))
def q_r4(spark, sf):
    return iv.merge_sample(crit_dense(spark, sf))


@register("negative_sample", oracle(
    f"SELECT * FROM {Q.marked_long()} m WHERE coalesce(DURACAO_PERCEBIDA_MINUTOS < 0, false) "
    f"ORDER BY NUM_INTRP_UCI LIMIT 200", ["intr_long"]))
def q_r5(spark, sf):
    return dq.negative_sample(marked_long(spark, sf), 200, ["NUM_INTRP_UCI"])


@register("top_regions", oracle(f"SELECT * FROM ({SUMMARY_SQL}) s ORDER BY registros DESC, sigla_regional LIMIT 20",
                                ["intr_long"]))
def q_r6a(spark, sf):
    s = dq.regional_summary(table(spark, sf, "intr_long"), "SIGLA_REGIONAL")
    return dq.top_n(s, 20, [F.col("registros").desc(), F.col("sigla_regional")])


@register("append_total_row", oracle(
    f"SELECT REGIONAL_TOTAL, CAST(count(*) AS BIGINT) AS CI FROM {UNIQUE} u GROUP BY 1 "
    f"UNION ALL SELECT 'COPEL' AS REGIONAL_TOTAL, CAST(count(*) AS BIGINT) AS CI FROM {UNIQUE} v", L_B))
def q_r7(spark, sf):
    return ind.count_with_total(unique_long(spark, sf))


@register("distinct_map", oracle(
    f"SELECT DISTINCT SIGLA_REGIONAL, REGIONAL_TOTAL FROM billed_month WHERE ANOMES = '{ANOMES}' "
    f"AND SIGLA_REGIONAL IS NOT NULL AND SIGLA_REGIONAL <> '' AND REGIONAL_TOTAL <> 'COPEL'", ["billed_month"]))
def q_r8(spark, sf):
    return ind.region_lookup(billed(spark, sf))


@register("unpivot_components", oracle(
    "SELECT REGIONAL_TOTAL, split_part(COLUNA, '_', 1) AS INDICADOR, split_part(COLUNA, '_', 2) AS COMPONENTE, "
    "CAST(VALOR AS DOUBLE) AS VALOR FROM (UNPIVOT (SELECT REGIONAL_TOTAL, DEC_LIQUIDO, DEC_EXPURGO, DEC_BRUTO, "
    f"FEC_LIQUIDO, FEC_EXPURGO, FEC_BRUTO FROM ({Q.dec_fec_sql(ANOMES)}) t) ON DEC_LIQUIDO, DEC_EXPURGO, DEC_BRUTO, "
    "FEC_LIQUIDO, FEC_EXPURGO, FEC_BRUTO INTO NAME COLUNA VALUE VALOR) u", L_B))
def q_r9(spark, sf):
    return ind.unpivot_components(ind.dec_fec(unique_long(spark, sf), billed(spark, sf)))


@register("preview_rows", oracle("SELECT * FROM intr_long ORDER BY NUM_INTRP_UCI LIMIT 20", ["intr_long"]))
def q_r10(spark, sf):
    return dq.preview_rows(table(spark, sf, "intr_long"), 20, ["NUM_INTRP_UCI"])


# ---------------------------------------------------------------------------
# Interval and de-duplication operators
# ---------------------------------------------------------------------------

def resolve_sql(src: str, cols: list[str]) -> str:
    """I2 as a recursive walk carrying the champion per consumer."""
    keep = ", ".join(f"r.{c}" for c in cols)
    return f"""
(WITH RECURSIVE v AS (
   SELECT CAST(NUM_INTRP_UCI AS VARCHAR) AS id, coalesce(CAST(NUM_UC_UCI AS VARCHAR), '') AS uc, DTHR_INICIO_INTRP_UC AS s, DATA_HORA_FIM_INTRP AS e,
          row_number() OVER (PARTITION BY NUM_UC_UCI ORDER BY DTHR_INICIO_INTRP_UC, DATA_HORA_FIM_INTRP,
                                                       CAST(NUM_INTRP_UCI AS VARCHAR)) AS rn
   FROM {src} WHERE DTHR_INICIO_INTRP_UC IS NOT NULL AND DATA_HORA_FIM_INTRP IS NOT NULL
     AND DATA_HORA_FIM_INTRP >= DTHR_INICIO_INTRP_UC
 ), walk(uc, rn, cid, cs, ce, emitted) AS (
   SELECT uc, rn, id, s, e, CAST(NULL AS VARCHAR) FROM v WHERE rn = 1
   UNION ALL
   SELECT w.uc, v.rn,
     CASE WHEN v.s < w.ce AND v.e > w.cs THEN
            CASE WHEN date_diff('microsecond', v.s, v.e) > date_diff('microsecond', w.cs, w.ce) THEN v.id ELSE w.cid END
          ELSE v.id END,
     CASE WHEN v.s < w.ce AND v.e > w.cs THEN
            CASE WHEN date_diff('microsecond', v.s, v.e) > date_diff('microsecond', w.cs, w.ce) THEN v.s ELSE w.cs END
          ELSE v.s END,
     CASE WHEN v.s < w.ce AND v.e > w.cs THEN
            CASE WHEN date_diff('microsecond', v.s, v.e) > date_diff('microsecond', w.cs, w.ce) THEN v.e ELSE w.ce END
          ELSE v.e END,
     CASE WHEN v.s < w.ce AND v.e > w.cs THEN NULL ELSE w.cid END
   FROM walk w JOIN v ON v.uc = w.uc AND v.rn = w.rn + 1
 ), kept AS (
   SELECT emitted AS id FROM walk WHERE emitted IS NOT NULL
   UNION ALL
   SELECT w.cid FROM walk w JOIN (SELECT uc, max(rn) AS mx FROM v GROUP BY uc) m ON w.uc = m.uc AND w.rn = m.mx
 )
 SELECT {keep} FROM {src} r
 WHERE CAST(r.NUM_INTRP_UCI AS VARCHAR) IN (SELECT id FROM kept)
    OR NOT coalesce(r.DTHR_INICIO_INTRP_UC IS NOT NULL AND r.DATA_HORA_FIM_INTRP IS NOT NULL
                    AND r.DATA_HORA_FIM_INTRP >= r.DTHR_INICIO_INTRP_UC, false))"""


@register("resolve_overlaps", oracle(f"SELECT * FROM {resolve_sql('intr_long', _B1_COLS)} x", ["intr_long"]))
def q_i2(spark, sf):
    return iv.resolve_overlaps(table(spark, sf, "intr_long"))


def dedup_sql(src: str, cols: list[str]) -> str:
    sel = ", ".join(cols)
    return f"""
(SELECT {sel} FROM (SELECT *, row_number() OVER (PARTITION BY NUM_UC_UCI, NUM_INTRP_INIC_MANOBRA_UCI
   ORDER BY DTHR_INICIO_INTRP_UC ASC NULLS FIRST, DATA_HORA_FIM_INTRP ASC NULLS FIRST, NUM_INTRP_UCI ASC NULLS FIRST) AS rn
   FROM {src}) d WHERE rn = 1)"""


@register("dedup_first", oracle(f"SELECT * FROM {dedup_sql('intr_long', _B1_COLS)} x", ["intr_long"]))
def q_d2(spark, sf):
    return iv.dedup_first(table(spark, sf, "intr_long"), ["NUM_UC_UCI", "NUM_INTRP_INIC_MANOBRA_UCI"],
                          ["DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP", "NUM_INTRP_UCI"])


@register("dedup_exact", "SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem")
def q_d1(spark, sf):
    return iv.dedup_exact(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


def raw_month(spark, sf):
    """The raw (all text) month as extracted: B1 written as strings."""
    return sio.bronze_as_string(table(spark, sf, "intr_long"))


_RAW_TYPED = ("(SELECT NUM_UC_UCI, NUM_INTRP_UCI, NUM_INTRP_INIC_MANOBRA_UCI, SIGLA_REGIONAL, TIPO_PROTOC_JUSTIF_UCI, "
              f"{PTS_IMPORT('CAST(DTHR_INICIO_INTRP_UC AS VARCHAR)')} AS DTHR_INICIO_INTRP_UC, "
              f"{PTS_IMPORT('CAST(DATA_HORA_FIM_INTRP AS VARCHAR)')} AS DATA_HORA_FIM_INTRP FROM intr_long)")
_I4_SQL = dedup_sql(resolve_sql(_RAW_TYPED, _B1_COLS), _B1_COLS)


@register("import_processing", oracle(f"SELECT * FROM {_I4_SQL} x", ["intr_long"]))
def q_i4(spark, sf):
    return iv.import_processing(raw_month(spark, sf))


@register("processing_report", oracle(
    f"""SELECT a.n AS registros_iniciais, a.n - b.n AS removidos_sobreposicao, b.n - c.n AS removidos_duplicados,
        c.n AS registros_finais, CASE WHEN a.n > 0 THEN {RH('((a.n - c.n) / a.n * 100.0)', 1)} ELSE 0.0 END AS reducao_pct
    FROM (SELECT count(*) AS n FROM intr_long) a, (SELECT count(*) AS n FROM {resolve_sql(_RAW_TYPED, _B1_COLS)} x) b,
         (SELECT count(*) AS n FROM {_I4_SQL} y) c""", ["intr_long"]))
def q_a16(spark, sf):
    return iv.processing_report(raw_month(spark, sf))


@register("table_profile", oracle(
    f"SELECT 'bruto' AS tabela, count(*) AS linhas, 7 AS colunas FROM intr_long "
    f"UNION ALL SELECT 'processado' AS tabela, count(*) AS linhas, 7 AS colunas FROM {_I4_SQL} x", ["intr_long"]))
def q_a17(spark, sf):
    raw = raw_month(spark, sf)
    return dq.table_profile({"bruto": raw, "processado": iv.import_processing(raw)})


# ---------------------------------------------------------------------------
# Data-quality tests (Q-A .. Q-I, R6)
# ---------------------------------------------------------------------------

@register("null_check", oracle(" UNION ALL ".join(
    f"SELECT '{c}' AS coluna, count(*) FILTER (WHERE {c} IS NULL) AS nulos FROM intr_long" for c in _B1_COLS),
    ["intr_long"]))
def q_qa(spark, sf):
    return dq.null_check(table(spark, sf, "intr_long"))


_LI = "(SELECT l_orderkey, l_linenumber FROM lineitem)"


@register("duplicate_check", f"""
SELECT CAST(sum(n) - sum(n - 1) AS BIGINT) AS passed, CAST(sum(n - 1) AS BIGINT) AS failed, CAST(sum(n) AS BIGINT) AS linhas
FROM (SELECT count(*) AS n FROM {_LI} t GROUP BY l_orderkey, l_linenumber) g""")
def q_qb(spark, sf):
    return dq.duplicate_check(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


_LI3 = "(SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem)"
RULES_SQL = f"""
SELECT regra, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed, {RH('ratio * 100.0', 4)} AS pct_failed,
       CASE WHEN thr IS NULL OR ratio <= thr THEN 'ok' ELSE 'falha' END AS status
FROM (
  SELECT 'null_check' AS regra, 3 * count(*) - nn AS passed, nn AS failed, nn / greatest(3 * count(*), 1) AS ratio,
         0.05 AS thr FROM (SELECT *, (CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END + CASE WHEN l_linenumber IS NULL
         THEN 1 ELSE 0 END + CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) AS k FROM {_LI3} t) x,
       (SELECT sum(CASE WHEN l_orderkey IS NULL THEN 1 ELSE 0 END + CASE WHEN l_linenumber IS NULL THEN 1 ELSE 0 END
               + CASE WHEN l_returnflag IS NULL THEN 1 ELSE 0 END) AS nn FROM {_LI3} t2) y GROUP BY nn
  UNION ALL
  SELECT 'duplicate_check', sum(n) - sum(n - 1), sum(n - 1), sum(n - 1) / greatest(sum(n), 1), 0.01
  FROM (SELECT count(*) AS n FROM {_LI3} t GROUP BY l_orderkey, l_linenumber, l_returnflag) g
  UNION ALL
  SELECT 'type_consistency', count(*), 0, 0.0, NULL FROM {_LI3} t) r"""


@register("rule_report", RULES_SQL)
def q_qc(spark, sf):
    return dq.rule_report(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"))


TEXT_CONTRACT = T.StructType([
    T.StructField("NUM_UC_UCI", T.StringType()),
    T.StructField("NUM_INTRP_UCI", T.StringType()),
    T.StructField("DTHR_INICIO_TXT", T.TimestampNTZType()),
    T.StructField("DATA_HORA_FIM_TXT", T.TimestampNTZType()),
    T.StructField("MES_TXT", T.StringType()),
    T.StructField("DURACAO_PERCEBIDA_MINUTOS", T.DoubleType()),
])


@register("schema_check", oracle(f"""
SELECT coluna, tipo_esperado, tipo_atual, tipo_atual <> 'ausente' AS presente, tipo_atual = tipo_esperado AS tipo_ok,
       CAST(nao_convertiveis AS BIGINT) AS nao_convertiveis FROM (
  SELECT 'NUM_UC_UCI' AS coluna, 'string' AS tipo_esperado, 'string' AS tipo_atual, 0 AS nao_convertiveis
  UNION ALL SELECT 'NUM_INTRP_UCI', 'string', 'string', 0
  UNION ALL SELECT 'DTHR_INICIO_TXT', 'timestamp_ntz', 'string',
    (SELECT count(*) FILTER (WHERE DTHR_INICIO_TXT IS NOT NULL AND {PTS('DTHR_INICIO_TXT')} IS NULL) FROM intr_text)
  UNION ALL SELECT 'DATA_HORA_FIM_TXT', 'timestamp_ntz', 'string',
    (SELECT count(*) FILTER (WHERE DATA_HORA_FIM_TXT IS NOT NULL AND {PTS('DATA_HORA_FIM_TXT')} IS NULL) FROM intr_text)
  UNION ALL SELECT 'MES_TXT', 'string', 'string', 0
  UNION ALL SELECT 'DURACAO_PERCEBIDA_MINUTOS', 'double', 'ausente', NULL) s""", ["intr_text"]))
def q_qd(spark, sf):
    return dq.schema_check(_text(spark, sf), TEXT_CONTRACT)


def _iqr_sql(cols: list[str], k: float = 1.5, min_non_null: int = 5000) -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS coluna, CAST({c} AS DOUBLE) AS valor FROM events" for c in cols)
    q1 = nearest_sql(f"({long})", "valor", "coluna", 0.25)
    q3 = nearest_sql(f"({long})", "valor", "coluna", 0.75)
    fences = f"""(SELECT s.*, a.v AS q1, b.v AS q3, b.v - a.v AS iqr, a.v - {k!r} * (b.v - a.v) AS limite_inferior,
        b.v + {k!r} * (b.v - a.v) AS limite_superior
      FROM (SELECT coluna, count(valor) AS nao_nulos, min(valor) AS min, max(valor) AS max, avg(valor) AS mean,
                   stddev_samp(valor) AS std FROM ({long}) l GROUP BY 1) s
      JOIN {q1} a USING (coluna) JOIN {q3} b USING (coluna)
      WHERE s.nao_nulos >= {min_non_null} AND a.v IS NOT NULL AND b.v IS NOT NULL)"""
    low = "CASE WHEN f.iqr = 0 THEN l.valor < f.q1 ELSE l.valor < f.limite_inferior END"
    high = "CASE WHEN f.iqr = 0 THEN l.valor > f.q1 ELSE l.valor > f.limite_superior END"
    counts = f"""(SELECT l.coluna, count(*) FILTER (WHERE {low} OR {high}) AS outliers,
        count(*) FILTER (WHERE {low}) AS outliers_inferiores, count(*) FILTER (WHERE {high}) AS outliers_superiores
      FROM ({long}) l JOIN {fences} f USING (coluna) WHERE l.valor IS NOT NULL GROUP BY 1)"""
    return f"""
SELECT f.coluna, f.nao_nulos, coalesce(c.outliers, 0) AS outliers, coalesce(c.outliers_inferiores, 0) AS outliers_inferiores,
  coalesce(c.outliers_superiores, 0) AS outliers_superiores,
  {RH('(coalesce(c.outliers, 0) / f.nao_nulos * 100.0)', 4)} AS pct_outliers,
  f.limite_inferior, f.limite_superior, f.q1, f.q3, f.iqr, f.min, f.max, {RH('f.mean', 6)} AS media,
  {RH('f.std', 6)} AS desvio_padrao
FROM {fences} f LEFT JOIN {counts} c USING (coluna)"""


IQR_SQL = _iqr_sql(["event_id", "user_id", "value"])


def iqr_events(spark, sf):
    return dq.iqr_outliers(table(spark, sf, "events"))


@register("iqr_outliers", IQR_SQL)
def q_qe(spark, sf):
    return iqr_events(spark, sf)


@register("outlier_alerts", f"""
SELECT count(*) AS colunas_analisadas, count(*) FILTER (WHERE pct_outliers >= 1.0) AS colunas_em_alerta,
  CAST(coalesce(sum(CASE WHEN rn <= 30 THEN outliers_inferiores END), 0) AS BIGINT) AS inferiores_top,
  CAST(coalesce(sum(CASE WHEN rn <= 30 THEN outliers_superiores END), 0) AS BIGINT) AS superiores_top
FROM (SELECT *, row_number() OVER (ORDER BY pct_outliers DESC, coluna) AS rn FROM ({IQR_SQL}) i) r""")
def q_qf(spark, sf):
    return dq.outlier_alerts(iqr_events(spark, sf))


@register("top_outliers", f"SELECT * FROM ({IQR_SQL}) i ORDER BY pct_outliers DESC, coluna LIMIT 30")
def q_r6b(spark, sf):
    return dq.top_n(iqr_events(spark, sf), 30, [F.col("pct_outliers").desc(), F.col("coluna")])


@register("negative_durations", oracle(
    f"SELECT 'DURACAO_PERCEBIDA_MINUTOS' AS coluna, count(*) FILTER (WHERE DURACAO_PERCEBIDA_MINUTOS < 0) AS negativos "
    f"FROM {Q.marked_long()} m", ["intr_long"]))
def q_qg(spark, sf):
    return dq.negative_durations(marked_long(spark, sf))


ANOM_FULL_SQL = f"""
(SELECT sigla_regional, mes_ref, registros, registros_mes_anterior, pct_variacao,
   CASE WHEN mad > 0 THEN {RH('(0.6745 * (registros - med) / mad)', 4)} END AS robust_z
 FROM (SELECT *, median(abs(registros - med)) OVER (PARTITION BY sigla_regional) AS mad
       FROM (SELECT *, median(CAST(registros AS DOUBLE)) OVER (PARTITION BY sigla_regional) AS med
             FROM ({CHANGE_SQL}) c) a) b)"""


@register("regional_anomalies", oracle(f"""
SELECT *, coalesce(abs(pct_variacao) >= 35.0, false) OR coalesce(abs(robust_z) >= 3.5, false) AS anomalia
FROM {ANOM_FULL_SQL} x
WHERE mes_ref = (SELECT max(mes_ref) FROM {MONTHLY_SQL} m)
  AND (coalesce(abs(pct_variacao) >= 35.0, false) OR coalesce(abs(robust_z) >= 3.5, false))
ORDER BY pct_variacao DESC NULLS FIRST, robust_z DESC NULLS FIRST""", OR))
def q_qh(spark, sf):
    return dq.regional_anomalies(monthly_orders(spark, sf))


@register("regional_psi", oracle(f"""
SELECT psi, mes_atual, mes_anterior,
  CASE WHEN psi >= 0.25 THEN 'Drift alto' WHEN psi >= 0.10 THEN 'Drift moderado'
       WHEN psi IS NOT NULL THEN 'Estavel' END AS nivel
FROM (SELECT CASE WHEN max(sa) > 0 AND max(sp) > 0 AND (SELECT max(mes_ref) FROM {MONTHLY_SQL} q
                    WHERE mes_ref < (SELECT max(mes_ref) FROM {MONTHLY_SQL} r)) IS NOT NULL
             THEN {RH('sum((a - e) * ln(a / e))', 8)} END AS psi,
             (SELECT max(mes_ref) FROM {MONTHLY_SQL} s) AS mes_atual,
             (SELECT max(mes_ref) FROM {MONTHLY_SQL} t WHERE mes_ref < (SELECT max(mes_ref) FROM {MONTHLY_SQL} u))
               AS mes_anterior
      FROM (SELECT registros_atual / sum(registros_atual) OVER () + 1e-8 AS a,
                   registros_anterior / sum(registros_anterior) OVER () + 1e-8 AS e,
                   sum(registros_atual) OVER () AS sa, sum(registros_anterior) OVER () AS sp
            FROM ({TWO_MONTHS_SQL}) p) z) y""", OR))
def q_qi(spark, sf):
    return dq.regional_psi(monthly_orders(spark, sf))


@register("merge_criteria", oracle(f"SELECT {CRIT_COLS} FROM {CRIT_SQL} c", _D))
def q_i3(spark, sf):
    return crit_dense(spark, sf)


@register("max_duration_report", oracle(
    f"SELECT count(*) AS linhas_antes, count(*) FILTER (WHERE DUR_MIN <= {MAX_HOURS * 60.0!r}) AS linhas_depois, "
    f"count(*) FILTER (WHERE NOT (DUR_MIN <= {MAX_HOURS * 60.0!r})) AS linhas_removidas FROM {UNIQUE} u", L_B))
def q_f2_report(spark, sf):
    return ind.max_duration_report(unique_long(spark, sf), MAX_HOURS)


@register("available_billed_months", oracle(
    "SELECT DISTINCT CAST(ANOMES AS VARCHAR) AS ANOMES FROM billed_month WHERE ANOMES IS NOT NULL ORDER BY 1 DESC",
    ["billed_month"]))
def q_a15_billed(spark, sf):
    return ind.billed_months(billed(spark, sf, None))


@register("regional_summary_totals", oracle(
    f"SELECT CAST(sum(registros) AS BIGINT) AS total, "
    f"CAST(coalesce(sum(registros) FILTER (WHERE sigla_regional = 'SEM_SIGLA'), 0) AS BIGINT) AS sem_sigla "
    f"FROM ({SUMMARY_SQL}) s", ["intr_long"]))
def q_a9_totals(spark, sf):
    return dq.regional_summary_totals(dq.regional_summary(table(spark, sf, "intr_long"), "SIGLA_REGIONAL"))


@register("unbilled_reconciliation", oracle(
    f"SELECT REGIONAL_TOTAL, count(*) AS CI_SEM_UC FROM {UNIQUE} u "
    f"WHERE REGIONAL_TOTAL NOT IN (SELECT REGIONAL_TOTAL FROM {UC_MONTH} b) GROUP BY 1", L_B))
def q_unbilled(spark, sf):
    return ind.unbilled_reconciliation(unique_long(spark, sf), billed(spark, sf))


# ---------------------------------------------------------------------------
# Month scope, hot keys, null keys and typed ids
# ---------------------------------------------------------------------------

# B1 with a month, every eleventh of them unknown; consumers and manoeuvre
# ids as numbers, some unknown, the ids beyond what a double holds.
_ID = "CAST(NUM_INTRP_UCI AS BIGINT)"
_SCOPED = ("SELECT NUM_UC_UCI, NUM_INTRP_UCI, NUM_INTRP_INIC_MANOBRA_UCI, SIGLA_REGIONAL, TIPO_PROTOC_JUSTIF_UCI, "
           f"DTHR_INICIO_INTRP_UC, DATA_HORA_FIM_INTRP, CASE WHEN {_ID} % 11 <> 0 THEN CAST(month(DTHR_INICIO_INTRP_UC) AS INT) END AS mes "
           "FROM intr_long")
_TYPED = (f"SELECT CASE WHEN {_ID} % 50 <> 3 THEN CAST(NUM_UC_UCI AS BIGINT) END AS NUM_UC_UCI, NUM_INTRP_UCI, "
          f"CASE WHEN {_ID} % 5 <> 0 THEN 9007199254740993 + {_ID} END AS NUM_INTRP_INIC_MANOBRA_UCI, SIGLA_REGIONAL, "
          "TIPO_PROTOC_JUSTIF_UCI, DTHR_INICIO_INTRP_UC, DATA_HORA_FIM_INTRP FROM intr_long")


def _shaped(spark, sf, sql: str) -> DataFrame:
    table(spark, sf, "intr_long").createOrReplaceTempView("intr_long")
    return spark.sql(sql)


def _month_marks() -> str:
    return Q.mark_sql(f"({_SCOPED})", "NUM_UC_UCI", "NUM_INTRP_INIC_MANOBRA_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP",
                      "NUM_INTRP_UCI", [*_B1_COLS, "mes"], scope="mes")


@register("mark_overlaps_month", oracle(f"SELECT * FROM {_month_marks()} m", ["intr_long"]))
def q_i1_month(spark, sf):
    return iv.mark_overlaps(_shaped(spark, sf, _SCOPED), scope=["mes"])


@register("mark_overlaps_hot", oracle(f"SELECT * FROM {_month_marks()} m", ["intr_long"]))
def q_i1_hot(spark, sf):
    return iv.mark_overlaps(_shaped(spark, sf, _SCOPED), scope=["mes"], skew="on")


_TYPED_OUT = ("NUM_UC_UCI", "NUM_INTRP_UCI", "CAST(NUM_INTRP_INIC_MANOBRA_UCI AS STRING) AS NUM_INTRP_INIC_MANOBRA_UCI",
              "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP")
_RESOLVE_TYPED = oracle("SELECT " + ", ".join(_TYPED_OUT).replace("STRING", "VARCHAR") +
                        f" FROM {resolve_sql(f'({_TYPED})', _B1_COLS)} x", ["intr_long"])


@register("resolve_overlaps_typed", _RESOLVE_TYPED)
def q_i2_typed(spark, sf):
    return iv.resolve_overlaps(_shaped(spark, sf, _TYPED)).selectExpr(*_TYPED_OUT)


@register("resolve_overlaps_hot", _RESOLVE_TYPED)
def q_i2_hot(spark, sf):
    return iv.resolve_overlaps(_shaped(spark, sf, _TYPED), skew="on").selectExpr(*_TYPED_OUT)


# ---------------------------------------------------------------------------
# Per-input results (A14, Q-D, R3) over stored files
# ---------------------------------------------------------------------------

_FILES_SQL = (f"(SELECT *, CASE WHEN {_ID} % 3 = 0 THEN 'a.parquet' ELSE 'b.parquet' END AS arquivo FROM intr_long)")


def _files(spark, sf) -> list[str]:
    """B1 as two files, and a third without its consumers."""
    df, base = table(spark, sf, "intr_long"), _scratch(spark, "files")
    third = F.col("NUM_INTRP_UCI").cast("long") % 3 == 0
    parts = {"a": df.where(third), "b": df.where(~third), "c": df.where(third).drop("NUM_UC_UCI")}
    for name, part in parts.items():
        part.write.parquet(f"{base}/{name}.parquet")
    return [f"{base}/{name}.parquet" for name in parts]


def _file_marks() -> str:
    return Q.mark_sql(_FILES_SQL, "NUM_UC_UCI", "NUM_INTRP_INIC_MANOBRA_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP",
                      "NUM_INTRP_UCI", [*_B1_COLS, "arquivo"], scope="arquivo")


def _basename(df: DataFrame) -> DataFrame:
    return df.withColumn("arquivo", F.substring_index("arquivo", "/", -1))


@register("mark_summary_inputs", oracle(
    f"SELECT arquivo, 'ok' AS status, count(*) AS total, count(*) FILTER (WHERE verificado) AS verificado_true, "
    f"count(*) FILTER (WHERE Contido_outra_intrp) AS contido_true, count(*) FILTER (WHERE Sobreposicao_tempo) AS sobreposto_true, "
    f"count(*) FILTER (WHERE Conta_desligamento_unico) AS conta_unico_true FROM {_file_marks()} m GROUP BY 1 "
    f"UNION ALL SELECT 'c.parquet', 'colunas_ausentes', 0, 0, 0, 0, 0", ["intr_long"]))
def q_a14_inputs(spark, sf):
    return _basename(iv.mark_inputs(spark, _files(spark, sf))[1]).drop("mensagem")


@register("contained_sample", oracle(
    f"SELECT arquivo, NUM_UC_UCI, NUM_INTRP_INIC_MANOBRA_UCI, DTHR_INICIO_INTRP_UC, "
    f"DATA_HORA_FIM_INTRP AS DATA_HORA_FIM_INTR, verificado, Contido_outra_intrp, Sobreposicao_tempo, "
    f"Conta_desligamento_unico, Grupo_desligamento_uc FROM {_file_marks()} m WHERE Contido_outra_intrp "
    f"ORDER BY arquivo, NUM_UC_UCI, DTHR_INICIO_INTRP_UC, NUM_INTRP_INIC_MANOBRA_UCI, NUM_INTRP_UCI LIMIT 500", ["intr_long"]))
def q_r3(spark, sf):
    marked, _ = iv.mark_inputs(spark, _files(spark, sf))
    return _basename(dq.contained_sample(marked, 500))


_INPUT_CONTRACT = T.StructType([T.StructField("NUM_UC_UCI", T.StringType()), T.StructField("NUM_INTRP_UCI", T.LongType()),
                                T.StructField("SIGLA_REGIONAL", T.IntegerType())])


@register("schema_check_inputs", oracle(" UNION ALL ".join(f"""
SELECT '{f}' AS arquivo, '{'colunas_ausentes' if f[0] == 'c' else 'ok'}' AS status, 'NUM_UC_UCI' AS coluna, 'string' AS tipo_esperado,
  '{'ausente' if f[0] == 'c' else 'string'}' AS tipo_atual, {f[0] != 'c'} AS presente, {f[0] != 'c'} AS tipo_ok,
  CAST({'NULL' if f[0] == 'c' else 0} AS BIGINT) AS nao_convertiveis
UNION ALL SELECT '{f}', '{'colunas_ausentes' if f[0] == 'c' else 'ok'}', 'NUM_INTRP_UCI', 'bigint', 'string', true, false, 0
UNION ALL SELECT '{f}', '{'colunas_ausentes' if f[0] == 'c' else 'ok'}', 'SIGLA_REGIONAL', 'int', 'string', true, false,
  count(*) FILTER (WHERE SIGLA_REGIONAL IS NOT NULL AND TRY_CAST(SIGLA_REGIONAL AS INTEGER) IS NULL)
FROM {_FILES_SQL} t WHERE arquivo = '{'a.parquet' if f[0] == 'c' else f}'""" for f in ("a.parquet", "b.parquet", "c.parquet")), ["intr_long"]))
def q_qd_inputs(spark, sf):
    return _basename(dq.schema_check_inputs(spark, _files(spark, sf), _INPUT_CONTRACT))


# ---------------------------------------------------------------------------
# Whole rows with copies (D1, Q-B, Q-C)
# ---------------------------------------------------------------------------

_COPIED = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 3 = 0)"


_LI_COLS = ['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'l_returnflag', 'l_linestatus', 'l_shipdate']


def copied_lineitem(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.unionByName(li.where(F.col("l_orderkey") % 3 == 0))


@register("dedup_exact_rows", "SELECT DISTINCT * FROM lineitem")
def q_d1_rows(spark, sf):
    return iv.dedup_exact(copied_lineitem(spark, sf))


def _row_groups() -> str:
    return f"(SELECT count(*) AS n FROM (SELECT t AS r FROM {_COPIED} t) x GROUP BY r)"


@register("duplicate_check_rows", f"""
SELECT CAST(count(*) AS BIGINT) AS passed, CAST(sum(n - 1) AS BIGINT) AS failed, CAST(sum(n) AS BIGINT) AS linhas FROM {_row_groups()} g""")
def q_qb_rows(spark, sf):
    return dq.duplicate_check(copied_lineitem(spark, sf))


@register("rule_report_rows", f"""
SELECT regra, CAST(passed AS BIGINT) AS passed, CAST(failed AS BIGINT) AS failed, {RH('ratio * 100.0', 4)} AS pct_failed,
       CASE WHEN thr IS NULL OR ratio <= thr THEN 'ok' ELSE 'falha' END AS status
FROM (
  SELECT 'null_check' AS regra, {len(_LI_COLS)} * n - nulls AS passed, nulls AS failed, nulls / greatest({len(_LI_COLS)} * n, 1) AS ratio,
         0.05 AS thr
  FROM (SELECT count(*) AS n, {" + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in _LI_COLS)} AS nulls FROM {_COPIED} t) a
  UNION ALL
  SELECT 'duplicate_check', count(*), sum(n - 1), sum(n - 1) / greatest(sum(n), 1), 0.01 FROM {_row_groups()} g
  UNION ALL
  SELECT 'type_consistency', count(*), 0, 0.0, NULL FROM {_COPIED} t) r""")
def q_qc_rows(spark, sf):
    return dq.rule_report(copied_lineitem(spark, sf))
