"""Column expressions.

All of these return ``Column`` objects built from Spark built-ins, so they
stay inside whole-stage codegen and never leave the JVM.  Functions that
depend on the input type look at the schema (driver metadata) first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.functions.rows import distinct_rows
from outagekit.functions.schema import (
    RAW_END_FALLBACK, RAW_START_FALLBACK, DURATION_ALIASES, is_numeric, is_temporal, resolve_column,
)

# Text layouts tried in order by the general timestamp parser
# (a bracketed fraction is optional and takes 1 to 9 digits).
TS_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS]",
    "dd/MM/yyyy HH:mm:ss[.SSSSSSSSS]",
    "yyyy-MM-dd HH:mm",
    "dd/MM/yyyy HH:mm",
]
# Layouts of the importer, in the order it tries them.
IMPORT_TS_FORMATS = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyyMMdd HH:mm:ss"]

# One-letter origin code and region names.
REGION_CODE_TO_NAME = {"L": "NRT", "P": "CSL", "M": "NRO", "C": "LES", "V": "OES"}
REGION_NAMES = ["NRT", "CSL", "NRO", "LES", "OES"]
TOTAL_LABEL = "COPEL"
NO_REGION = "SEM_REGIONAL"
#: Region of an origin code or a region name.
REGION_OF = {**{n: n for n in REGION_NAMES}, **REGION_CODE_TO_NAME, TOTAL_LABEL: TOTAL_LABEL}
NO_SIGLA = "SEM_SIGLA"

# Text accepted as "true" for the verified flag.
TRUE_WORDS = ["true", "1", "sim", "yes", "y"]
# Words the back-fill step reads as true / false (others: default).
BACKFILL_TRUE_WORDS = ["true", "1", "sim", "yes"]
BACKFILL_FALSE_WORDS = ["false", "0", "nao", "não", "no"]

# Accented letters and their plain forms.
ACCENTED = "áàâãéèêíìîóòôõúùûçÁÀÂÃÉÈÊÍÌÎÓÒÔÕÚÙÛÇ"
PLAIN = "aaaaeeeiiioooouuucAAAAEEEIIIOOOOUUUC"

# Layouts of free month text, with the groups of year and month.
MONTH_TEXT = ((r"^(\d{4})[-_/](\d{1,2})$", 1, 2), (r"^(\d{1,2})[-_/](\d{4})$", 2, 1), (r"^(\d{4})(\d{2})$", 1, 2))

LONG_INTERRUPTION_MIN = 3.0


def _c(col: str | Column) -> Column:
    return F.col(f"`{col}`") if isinstance(col, str) else col


def _to_ntz(c: Column) -> Column:
    return c.cast(T.TimestampNTZType())


def parse_ts(col: str | Column, dtype: T.DataType | None = None,
             formats: list[str] | None = None) -> Column:
    """Timestamp from a native value or from text, first layout that parses
    wins, failures give null (P4; card C1)."""
    c = _c(col)
    if dtype is not None and is_temporal(dtype):
        return _to_ntz(c)
    s = c.cast("string")
    tries = [_to_ntz(F.try_to_timestamp(s, F.lit(f))) for f in (formats or TS_FORMATS)]
    return F.coalesce(*tries)


def parse_ts_import(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """Importer's layouts, per value (P5)."""
    return parse_ts(col, dtype, IMPORT_TS_FORMATS)


def parse_duration(col: str | Column, default: float | None = None) -> Column:
    """Duration text or number to double; bad values null, or ``default``."""
    v = _c(col).try_cast("double")
    return F.coalesce(v, F.lit(float(default))) if default is not None else v


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end, truncated toward zero."""
    return F.timestamp_diff("SECOND", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def month_key(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """'YYYY-MM' from a timestamp, or from text starting with 'YYYY-MM', or
    made of 8 or 6 digits (P7; superset of both reference variants)."""
    c = _c(col)
    if dtype is not None and is_temporal(dtype):
        return F.date_format(c, "yyyy-MM")
    txt = F.coalesce(c.cast("string"), F.lit(""))
    compact = F.concat(F.substring(txt, 1, 4), F.lit("-"), F.substring(txt, 5, 2))
    return (F.when(txt.rlike(r"^\d{4}-\d{2}"), F.substring(txt, 1, 7))
            .when(txt.rlike(r"^\d{8}$"), compact)
            .when(txt.rlike(r"^\d{6}$"), compact))


def month_range(anomes: str) -> tuple[str, str]:
    """Half-open [first day, first day of next month) for 'YYYY-MM'.

    Filtering a timestamp with this range (instead of formatting it) lets
    the predicate reach the Parquet scan and prune row groups."""
    y, m = int(anomes[:4]), int(anomes[5:7])
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"{y:04d}-{m:02d}-01 00:00:00", f"{ny:04d}-{nm:02d}-01 00:00:00"


def in_month(col: str | Column, anomes: str) -> Column:
    lo, hi = month_range(anomes)
    c = _c(col)
    return (c >= F.lit(lo).cast(T.TimestampNTZType())) & (c < F.lit(hi).cast(T.TimestampNTZType()))


def parse_year_month(col: str | Column) -> Column:
    """struct(ano, mes) from free month text: YYYY-M(M), YYYY/M, YYYY_MM,
    M(M)-YYYY, YYYYMM; month outside 1..12 or anything else gives null (P8)."""
    s = F.trim(_c(col).cast("string"))
    year, month = (F.coalesce(*[F.when(s.rlike(p), F.regexp_extract(s, p, at[i])) for p, *at in MONTH_TEXT]).cast("int")
                   for i in (0, 1))
    ok = month.between(1, 12)
    return F.when(ok, F.struct(year.alias("ano"), month.alias("mes")))


def regional_code_map(df: DataFrame, sigla_col: str = "SIGLA_REGIONAL",
                      total_col: str = "REGIONAL_TOTAL") -> Column:
    """Region name for the interval tables.

    A region column wins when present (upper-cased, null to SEM_REGIONAL);
    otherwise the one-letter origin code (or a region name) is mapped."""
    total = resolve_column(df.columns, [total_col])
    if total:
        return F.coalesce(F.upper(F.col(f"`{total}`").cast("string")), F.lit(NO_REGION))
    sig_name = resolve_column(df.columns, [sigla_col])
    if sig_name is None:
        raise KeyError("neither REGIONAL_TOTAL nor SIGLA_REGIONAL present")
    sig = F.upper(F.coalesce(F.col(f"`{sig_name}`").cast("string"), F.lit("")))
    lookup = F.create_map(*[F.lit(x) for kv in REGION_OF.items() for x in kv])
    return F.coalesce(F.element_at(lookup, sig), F.lit(NO_REGION))


def regional_label(col: str | Column) -> Column:
    """Blank (all whitespace) to SEM_SIGLA, else the upper-cased text (P10)."""
    raw = _c(col).cast("string")
    squeezed = F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", "")
    return F.when(squeezed == "", F.lit(NO_SIGLA)).otherwise(F.upper(raw))


def parse_flag(col: str | Column, dtype: T.DataType | None = None, default: bool = False) -> Column:
    """Boolean from a boolean, a number (non-zero) or text in TRUE_WORDS;
    null gives ``default`` (P11)."""
    c = _c(col)
    if isinstance(dtype, T.BooleanType):
        v = c
    elif dtype is not None and is_numeric(dtype):
        v = c != 0
    else:
        v = F.lower(F.trim(c.cast("string"))).isin(TRUE_WORDS)
    return F.coalesce(v, F.lit(default))


def strip_accents(col: str | Column) -> Column:
    """Accent-free, lower-case, trimmed key."""
    return F.lower(F.trim(F.translate(_c(col).cast("string"), ACCENTED, PLAIN)))


def safe_div(a: Column, b: Column) -> Column:
    """0 when the denominator is 0 (P17); ANSI-safe because CASE only
    evaluates the chosen branch."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def second_precision(start: Column, end: Column) -> Column:
    """True when either bound carries seconds."""
    return (F.second(start) > 0) | (F.second(end) > 0)


def truncate_minute(c: Column) -> Column:
    return F.date_trunc("minute", c).cast(T.TimestampNTZType())


def clean_data(df: DataFrame) -> DataFrame:
    """Drop identical rows, null text to '', null integer/double to 0."""
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    nums = [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.IntegerType, T.LongType, T.DoubleType))]
    out = distinct_rows(df)
    if strs:
        out = out.fillna("", subset=strs)
    if nums:
        out = out.fillna(0, subset=nums)
    return out


# Columns of a marked table that are filled where null: (targets, of which the
# first present counts; sources, of which the first present fills it).
BACKFILL_RULES = (
    (("NUM_INTRP_PERCEBIDA",), ("NUM_INTRP_INIC_MANOBRA_UCI", "NUM_INTRP")),
    (("DTHR_INICIO_INTRP_PERCEBIDO", "DTHR_INICIO_INTRP_PERCEBIDA"), tuple(RAW_START_FALLBACK)),
    (("DATA_HORA_FIM_INTR_PERCEBIDO", "DATA_HORA_FIM_INTR_PERCEBIDA"), tuple(RAW_END_FALLBACK)),
)
# Second spellings added where only the first is there.
MIRRORS = (("DTHR_INICIO_INTRP_PERCEBIDO", "DTHR_INICIO_INTRP_PERCEBIDA"),
           ("DATA_HORA_FIM_INTR_PERCEBIDO", "DATA_HORA_FIM_INTR_PERCEBIDA"))


def _first_present(df: DataFrame, names) -> str | None:
    return next((c for c in names if c in df.columns), None)


def _verified(df: DataFrame, default: bool) -> Column:
    if "verificado" not in df.columns:
        return F.lit(default)
    if isinstance(df.schema["verificado"].dataType, T.StringType):
        word = F.lower(F.trim(F.col("verificado")))
        value = F.when(word.isin(BACKFILL_TRUE_WORDS), True).when(word.isin(BACKFILL_FALSE_WORDS), False)
    else:
        value = parse_flag("verificado", df.schema["verificado"].dataType, default=default)
    return F.coalesce(value, F.lit(default))


def backfill_perceived(df: DataFrame, default_verified: bool = True) -> DataFrame:
    """Make a marked table usable for the indicators (P12; card C2): fill
    null perceived ids and bounds (BACKFILL_RULES), then null minutes from the
    filled bounds; add what the indicators expect (``longa_duracao``, the
    second spellings, ``verificado`` with a default)."""
    filled = {}
    for targets, sources in BACKFILL_RULES:
        target, source = _first_present(df, targets), _first_present(df, sources)
        if target and source:
            filled[target] = F.coalesce(F.col(target), F.col(source).cast(df.schema[target].dataType))
    one = df.withColumns(filled)

    start, end = (_first_present(one, targets) for targets, _ in BACKFILL_RULES[1:])
    more = {}
    if start and end:
        span = minutes_between(parse_ts(start, one.schema[start].dataType), parse_ts(end, one.schema[end].dataType))
        own = [parse_duration("DURACAO_PERCEBIDA_MINUTOS")] if "DURACAO_PERCEBIDA_MINUTOS" in one.columns else []
        more["DURACAO_PERCEBIDA_MINUTOS"] = F.coalesce(*own, span)
    two = one.withColumns(more)

    added = {b: F.col(a) for a, b in MIRRORS if a in two.columns and b not in two.columns}
    minutes = resolve_column(two.columns, DURATION_ALIASES)
    if "longa_duracao" not in two.columns and minutes:
        added["longa_duracao"] = parse_duration(minutes, 0.0) >= F.lit(LONG_INTERRUPTION_MIN)
    return two.withColumns(added | {"verificado": _verified(two, default_verified)})
