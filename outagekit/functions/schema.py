"""Column resolution against a DataFrame schema (driver-side metadata only).

Input tables arrive with varying column names.  Resolution looks only at
``df.schema`` on the driver, never at the data, and then renames with a
plain ``select(... .alias(canonical))`` that Catalyst folds away.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted names per canonical column, first match wins.
START_ALIASES = ["DTHR_INICIO_INTRP_UC"]
END_ALIASES = ["data_hora_fim_intrp", "data_hora_fim_intr", "dt_fim_intrp_uc", "DATA_HORA_FIM_INT"]
MANOEUVRE_ID_ALIASES = ["num_intrp_inic_manobra_uci", "num_intrp_uci", "num_intrp", "NUM_INTRP_INIC_MAN"]
UC_ALIASES = ["NUM_UC_UCI"]
MONTH_ALIASES = ["ANOMES", "ANO_MES", "ANO_MES_REF"]
BILLED_UC_ALIASES = ["UC_FATURADA", "UC_FATURADO", "UC"]
JUSTIFICATION_ALIASES = ["TIPO_PROTOC_JUSTIF_UCI", "TIPO_PROTOC_JUSTIF_UC"]
PERCEIVED_START_ALIASES = ["DTHR_INICIO_INTRP_PERCEBIDO", "DTHR_INICIO_INTRP_PERCEBIDA"]
PERCEIVED_END_ALIASES = [
    "DATA_HORA_FIM_INTRP_PERCEBIDO",
    "DATA_HORA_FIM_INTR_PERCEBIDO",
    "DATA_HORA_FIM_INTRP_PERCEBIDA",
    "DATA_HORA_FIM_INTR_PERCEBIDA",
]
RAW_END_FALLBACK = ["DATA_HORA_FIM_INTRP", "DATA_HORA_FIM_INTR", "DT_FIM"]
RAW_START_FALLBACK = ["DTHR_INICIO_INTRP_UC", "DTHR_INICIO_INTRP", "DT_INI"]
DURATION_ALIASES = ["DURACAO_PERCEBIDA_MINUTOS", "DURACAO_PERC_MIN", "DURACAO_MINUTOS"]
REGIONAL_DQ_ALIASES = ["sigla_regional", "sg_regional", "regional", "sigla_region", "regiao_sigla"]
DATE_DQ_ALIASES = [
    "data_referencia", "dt_referencia", "data", "data_inicio", "dt_inicio",
    "dt_movimento", "competencia", "mes_referencia",
]


def resolve_column(columns: Iterable[str], candidates: Sequence[str]) -> str | None:
    """Case-insensitive lookup; the first candidate present wins."""
    lowered = {}
    for c in columns:
        lowered.setdefault(c.strip().lower(), c)
    for cand in candidates:
        hit = lowered.get(cand.strip().lower())
        if hit is not None:
            return hit
    return None


def resolve_column_fuzzy(columns: Sequence[str], include_all: Sequence[str] = (),
                         include_any: Sequence[str] = (), override: str | None = None) -> str | None:
    """First column, in schema order, whose lower-case name contains every
    fragment of ``include_all`` and at least one of ``include_any`` (P2).
    A manual ``override`` present in the schema takes precedence."""
    if override and override in columns:
        return override
    for c in columns:
        low = c.lower()
        if all(f in low for f in include_all) and (not include_any or any(f in low for f in include_any)):
            return c
    return None


def _named_or_like(columns: Sequence[str], aliases: Sequence[str], include_all: Sequence[str] = (),
                   include_any: Sequence[str] = ()) -> str | None:
    return resolve_column(columns, aliases) or resolve_column_fuzzy(columns, include_all, include_any)


def resolve_regional_dq(columns: Sequence[str]) -> str | None:
    """The region label column of the quality tests."""
    return _named_or_like(columns, REGIONAL_DQ_ALIASES, ["regional"], ["sigla", "sg_"])


def resolve_date_dq(columns: Sequence[str]) -> str | None:
    """The reference date column of the quality tests."""
    return _named_or_like(columns, DATE_DQ_ALIASES, (), ["data", "dt_", "compet", "mes"])


def resolve_columns(df: DataFrame, mapping: dict[str, Sequence[str]], keep_rest: bool = False) -> DataFrame:
    """Rename every canonical name to the first matching input column.

    ``mapping`` is ``{canonical: candidates}``; missing columns raise, so a
    contract failure surfaces at plan time, before any task runs.
    """
    chosen = {}
    for canon, cands in mapping.items():
        hit = resolve_column(df.columns, cands)
        if hit is None:
            raise KeyError(f"no column for {canon!r} among {list(cands)}")
        chosen[canon] = hit
    cols = [F.col(f"`{src}`").alias(canon) for canon, src in chosen.items()]
    if keep_rest:
        used = set(chosen.values())
        cols += [F.col(f"`{c}`") for c in df.columns if c not in used and c not in chosen]
    return df.select(*cols)


def standardize_columns(df: DataFrame) -> DataFrame:
    """Lower-case names, spaces to underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                           T.FloatType, T.DoubleType, T.DecimalType))


def is_temporal(dt: T.DataType) -> bool:
    return isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)]
