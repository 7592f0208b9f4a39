"""Relational extraction queries (E1, E2) and their joins.

On a cluster these run against the relational source tables read through
``jdbc.reader`` (or their lake copies); here they read the views of
``fixtures``.  Both are plain joins + aggregates that Catalyst plans:
the small geography chain of E2 is broadcast by size statistics, the
month filters are range predicates that reach the scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.functions.scalars import TOTAL_LABEL, in_month
from outagekit.operators.joins import left_join_hot
from outagekit.operators.scan import DEFAULT_HOT_ROWS

# Region name -> one-letter origin code; others get the total label.
NAME_TO_CODE = {"CSL": "P", "NRT": "L", "NRO": "M", "LES": "C", "OES": "V"}
EXCLUDED_REGION = "SCD"


def _month_text_to_anomes(data_mes: str) -> str:
    """'YYYYMM' -> 'YYYY-MM'."""
    return f"{data_mes[:4]}-{data_mes[4:6]}"


def join_self_start_end(hist: DataFrame, intrp: DataFrame, hot_rows: int = DEFAULT_HOT_ROWS) -> DataFrame:
    """History LEFT JOIN interruption twice (J1): the start row by the
    manoeuvre-initial id (own id when null), the end row by the own id;
    both on the origin code as well.  Billed rows only.  One interruption can
    hold a large share of the history: the history rows of ids with about
    ``hot_rows`` rows and more are not brought together."""
    h = hist.where(F.col("indic_fat_hcai") == "S").select(
        "*", F.coalesce(F.col("num_intrp_inic_manobra_hcai"), F.col("num_intrp_hcai")).alias("__ini_id"))
    ini = intrp.select(F.col("indic_reg_orig_intrp").alias("__oi"), F.col("NUM_SEQ_INTRP").alias("__si"),
                       F.col("TIPO_PROTOC_JUSTIF_INTRP").alias("tipo_justif"),
                       F.col("data_hora_inic_intrp").alias("inicio"))
    fim = intrp.select(F.col("indic_reg_orig_intrp").alias("__of"), F.col("NUM_SEQ_INTRP").alias("__sf"),
                       F.col("data_hora_fim_intrp").alias("fim"))
    j = left_join_hot(h, ini, [("indic_reg_orig_intrp_hcai", "__oi"), ("__ini_id", "__si")], hot_rows)
    j = left_join_hot(j, fim, [("indic_reg_orig_intrp_hcai", "__of"), ("num_intrp_hcai", "__sf")], hot_rows, counted=h)
    return j.select("num_uc_hcai", "indic_reg_orig_intrp_hcai", "num_intrp_hcai",
                    F.col("__ini_id").alias("num_intrp_inic_manobra"), "tipo_justif", "inicio", "fim")


def extract_interruptions(hist: DataFrame, intrp: DataFrame, data_mes: str) -> DataFrame:
    """One text row per (consumer, interruption) of a start month
    (card C13).  The month filter on the start row is written as a
    timestamp range, which also turns the first outer join into an inner
    one and reaches the interruption scan."""
    j = join_self_start_end(hist, intrp).where(in_month(F.col("inicio"), _month_text_to_anomes(data_mes)))
    minutes = F.timestamp_diff("SECOND", F.col("inicio"), F.col("fim")) / F.lit(60.0)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return j.select(
        F.col("num_uc_hcai").cast("string").alias("NUM_UC_UCI"),
        F.col("indic_reg_orig_intrp_hcai").cast("string").alias("SIGLA_REGIONAL"),
        F.col("num_intrp_hcai").cast("string").alias("NUM_INTRP_UCI"),
        F.col("tipo_justif").cast("string").alias("TIPO_PROTOC_JUSTIF_UCI"),
        F.date_format("inicio", fmt).alias("DTHR_INICIO_INTRP_UC"),
        F.date_format("fim", fmt).alias("DATA_HORA_FIM_INTRP"),
        F.col("num_intrp_inic_manobra").cast("string").alias("NUM_INTRP_INIC_MANOBRA_UCI"),
        F.when(minutes.isNotNull(), F.format_string("%.3f", minutes)).alias("DURACAO_PERCEBIDA_MINUTOS"),
    )


def join_geo_chain(hqcl: DataFrame, local: DataFrame, section: DataFrame, regional: DataFrame) -> DataFrame:
    """Locality -> section -> region (J2): inner, left, left.  The three
    dimension tables are tiny; Spark broadcasts them by size statistics."""
    return (hqcl.join(local, hqcl.COD_LOCAL_HQCL == local.COD_LOCAL, "inner")
            .join(section, F.col("COD_SECCION_DISTR_LOCAL") == section.COD_SDIS, "left")
            .join(regional, F.col("COD_REG_DISTR_SDIS") == regional.COD_RDIS, "left"))


def billed_uc_rollup(hqcl: DataFrame, local: DataFrame, section: DataFrame, regional: DataFrame,
                     p_data_ini: str) -> DataFrame:
    """Billed consumers (urban + rural) per region and month with the
    company total by ROLLUP, labels and order (card C14)."""
    j = join_geo_chain(hqcl, local, section, regional).where(
        (F.col("ANO_MES_HQCL") >= F.lit(p_data_ini).cast(T.TimestampNTZType()))
        & (F.col("SIGLA_RDIS") != EXCLUDED_REGION))
    anomes = F.date_format("ANO_MES_HQCL", "yyyy-MM")
    code = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for kv in NAME_TO_CODE.items() for x in kv]), F.col("SIGLA_RDIS")),
        F.lit(TOTAL_LABEL))
    g = (j.select("SIGLA_RDIS", anomes.alias("ANOMES"),
                  (F.col("QTDE_CONS_FAT_URB_HQCL") + F.col("QTDE_CONS_FAT_RUR_HQCL")).alias("__q"))
         .groupingSets([["ANOMES", "SIGLA_RDIS"], ["ANOMES"]], "ANOMES", "SIGLA_RDIS")
         .agg(F.sum("__q").alias("__uc"), F.grouping("SIGLA_RDIS").alias("__g")))
    return (g.select(
        F.when(F.col("__g") == 1, F.lit(TOTAL_LABEL)).otherwise(F.col("SIGLA_RDIS")).alias("REGIONAL_TOTAL"),
        F.when(F.col("__g") == 1, F.lit(TOTAL_LABEL)).otherwise(code).alias("SIGLA_REGIONAL"),
        "ANOMES", F.col("__uc").cast("double").alias("UC_FATURADA"))
        .orderBy(F.col("ANOMES").desc(), F.col("REGIONAL_TOTAL").asc()))
