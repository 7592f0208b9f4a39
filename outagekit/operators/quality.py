"""Data-quality tests (Q-A .. Q-I) and table summaries.

Every test is one or two aggregates over a scan.  Wide per-column tests
compute all columns in a single pass (one aggregate row) and turn it into
long form with ``stack``, so the table is read once regardless of width.
Per-column statistics that need a second pass (IQR fences) join the
per-column result back instead of collecting it to the driver; that side
has one row per column, a bound set by the schema.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outagekit.functions import scalars as S
from outagekit.functions.numeric import round_half
from outagekit.functions.rows import by_digest, is_wide
from outagekit.functions.schema import (
    is_numeric, numeric_columns, resolve_column, resolve_date_dq, resolve_regional_dq,
)
from outagekit.operators.intervals import interval_columns
from outagekit.operators.selection import order_statistics
from outagekit.sources.layouts import bare_path, input_of_row, layouts

# Thresholds of the rule report.
QUALITY_RULES = {"null_threshold": 0.05, "duplicate_threshold": 0.01}
# Name fragments of duration columns.
DURATION_FRAGMENTS = ["duracao", "duração", "duration"]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _rows(agg_row: DataFrame, names: Sequence[str], fields: dict[str, list]) -> DataFrame:
    """A one-row aggregate as one row per name: ``fields`` gives, per output
    column, a Column (of the aggregate) or a plain value for each name."""
    def cell(v):
        return v if isinstance(v, Column) else F.lit(v)

    rows = [F.struct(*[cell(vals[i]).alias(k) for k, vals in fields.items()]) for i in range(len(names))]
    return agg_row.select(F.inline(F.array(*rows)))


# ----------------------------------------------------------------------------
# Q-A .. Q-C
# ----------------------------------------------------------------------------

def null_check(df: DataFrame) -> DataFrame:
    """Nulls per column in one pass (Q-A)."""
    cols = df.columns
    row = df.agg(*[F.count_if(_q(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    return _rows(row, cols, {"coluna": cols, "nulos": [F.col(f"n{i}") for i in range(len(cols))]})


def null_check_summary(df: DataFrame) -> DataFrame:
    """Cells, nulls, passed = cells - nulls (card C10)."""
    n = len(df.columns)
    nulls = sum((F.count_if(_q(c).isNull()) for c in df.columns), F.lit(0))
    return df.agg((F.count(F.lit(1)) * n).alias("celulas"), nulls.alias("failed")).select(
        (F.col("celulas") - F.col("failed")).alias("passed"), "failed", "celulas")


def duplicate_check(df: DataFrame) -> DataFrame:
    """Extra copies of identical rows: sum over groups of (count - 1) (Q-B).
    Of a wide table only the rows whose digest repeats are compared whole."""
    once, again = by_digest(df) if is_wide(df) else (None, df)
    g = again.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    if once is not None:  # a count per task, not a row per row
        g = g.select("__n").unionByName(once.select(F.lit(1).cast("long").alias("__n")))
    return g.agg(F.sum("__n").alias("linhas"), F.sum(F.col("__n") - 1).alias("failed")).select(
        (F.col("linhas") - F.col("failed")).alias("passed"), "failed", "linhas")


def rule_report(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """All rules as (regra, passed, failed, pct_failed, status) rows (Q-C)."""
    rules = rules or QUALITY_RULES
    nulls = null_check_summary(df).select(
        F.lit("null_check").alias("regra"), "passed", "failed",
        (F.col("failed") / F.greatest(F.col("celulas"), F.lit(1))).alias("__ratio"),
        F.lit(rules["null_threshold"]).alias("__thr"))
    dups = duplicate_check(df).select(
        F.lit("duplicate_check").alias("regra"), "passed", "failed",
        (F.col("failed") / F.greatest(F.col("linhas"), F.lit(1))).alias("__ratio"),
        F.lit(rules["duplicate_threshold"]).alias("__thr"))
    types = df.agg(F.count(F.lit(1)).alias("passed")).select(
        F.lit("type_consistency").alias("regra"), "passed", F.lit(0).cast("long").alias("failed"),
        F.lit(0.0).alias("__ratio"), F.lit(None).cast("double").alias("__thr"))
    allr = nulls.unionByName(dups).unionByName(types)
    return allr.select(
        "regra", F.col("passed").cast("long").alias("passed"), F.col("failed").cast("long").alias("failed"),
        round_half(F.col("__ratio") * 100.0, 4).alias("pct_failed"),
        F.when(F.col("__thr").isNull() | (F.col("__ratio") <= F.col("__thr")), F.lit("ok"))
        .otherwise(F.lit("falha")).alias("status"))


# ----------------------------------------------------------------------------
# Q-D schema / type contract
# ----------------------------------------------------------------------------

def schema_check(df: DataFrame, contract: T.StructType) -> DataFrame:
    """Declared columns and types against the table (Q-D).

    Presence and type come from the schema; for present columns the test
    also counts non-null values that do not convert to the declared type
    (text timestamps go through the general timestamp parser)."""
    aggs, fields = _contract_test(df.schema, contract)
    return _rows(df.agg(*aggs), contract.names, fields)


def _contract_test(schema: T.StructType, contract: T.StructType) -> tuple[list[Column], dict[str, list]]:
    """The aggregates of a contract's test and its columns made of them."""
    actual = {f.name.lower(): f for f in schema.fields}
    found = [actual.get(n.lower()) for n in contract.names]
    aggs = []
    for i, (want, got) in enumerate(zip(contract.fields, found)):
        if got is None:
            aggs.append(F.max(F.lit(None).cast("long")).alias(f"b{i}"))
            continue
        is_ts = isinstance(want.dataType, (T.TimestampType, T.TimestampNTZType))
        conv = S.parse_ts(got.name, got.dataType) if is_ts else _q(got.name).try_cast(want.dataType)
        aggs.append(F.count_if(_q(got.name).isNotNull() & conv.isNull()).alias(f"b{i}"))
    wanted = [f.dataType.simpleString() for f in contract.fields]
    types = [g.dataType.simpleString() if g is not None else "ausente" for g in found]
    return aggs, {
        "coluna": contract.names, "tipo_esperado": wanted, "tipo_atual": types,
        "presente": [g is not None for g in found], "tipo_ok": [a == b for a, b in zip(types, wanted)],
        "nao_convertiveis": [F.col(f"b{i}").cast("long") for i in range(len(contract.names))]}


def schema_check_inputs(spark, paths: Sequence[str], contract: T.StructType) -> DataFrame:
    """``schema_check`` of every input on its own: ``arquivo``, ``status``
    (``ok``; ``colunas_ausentes`` where a declared column is missing; ``erro``
    where the input cannot be read) and the test's columns.  Inputs of one
    layout are tested by one aggregate keyed by the input, so the plan grows
    with the layouts, not with the inputs."""
    found, failed = layouts(spark, paths)
    out = None
    for layout in found:
        have = {c.lower() for c in layout.schema.names}
        status = "ok" if all(n.lower() in have for n in contract.names) else "colunas_ausentes"
        aggs, fields = _contract_test(layout.schema, contract)
        df = spark.read.schema(layout.schema).parquet(*layout.paths)
        counts = df.select("*", bare_path(input_of_row()).alias("__f")).groupBy("__f").agg(*aggs)
        # an input without rows is tested too: nothing in it fails
        files = spark.createDataFrame([(p,) for p in layout.paths], "arquivo string").select("arquivo", bare_path(F.col("arquivo")).alias("__f"))
        one = files.join(counts, "__f", "left")
        absent = [f"b{i}" for i, p in enumerate(fields["presente"]) if not p]
        one = one.select("arquivo", *[F.col(f"b{i}") if f"b{i}" in absent else F.coalesce(f"b{i}", F.lit(0).cast("long")).alias(f"b{i}")
                                      for i in range(len(aggs))])
        rows = F.array(*[F.struct(*[(v[i] if isinstance(v[i], Column) else F.lit(v[i])).alias(k) for k, v in fields.items()])
                         for i in range(len(aggs))])
        part = one.select("arquivo", F.lit(status).alias("status"), F.inline(rows))
        out = part if out is None else out.unionByName(part)
    if failed:
        bad = spark.createDataFrame([(p, "erro") for p, _ in failed], "arquivo string, status string")
        out = bad if out is None else out.unionByName(bad, allowMissingColumns=True)
    return out


# ----------------------------------------------------------------------------
# Q-E .. Q-G outliers and negative durations
# ----------------------------------------------------------------------------

def _long_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("coluna"), _q(c).cast("double").alias("valor")) for c in cols
    ])).alias("kv")).select("kv.coluna", "kv.valor")


IQR_SCHEMA = ("coluna string, nao_nulos long, outliers long, outliers_inferiores long, outliers_superiores long, pct_outliers double, "
              "limite_inferior double, limite_superior double, q1 double, q3 double, iqr double, min double, max double, "
              "media double, desvio_padrao double")


def iqr_outliers(df: DataFrame, iqr_factor: float = 1.5, min_non_null: int = 5000,
                 columns: Sequence[str] | None = None, skew: str = "auto") -> DataFrame:
    """IQR outlier test per numeric column (Q-E; card C8).

    Quartiles are nearest-rank order statistics.  With IQR = 0 any value
    different from Q1 is an outlier.  Columns with fewer than
    ``min_non_null`` values are skipped.  Mean and sample deviation are
    reported to 6 dp.

    No value is shuffled but for the few that share a quartile's last
    bracket (``operators.selection``).  The columns' sizes, moments and
    quartiles - some numbers per column, bounded by the schema - come to the
    driver; the result is one more aggregate, against the fences."""
    cols = list(columns) if columns else numeric_columns(df)
    x = df.select(*[_q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    parts = {"n": F.count, "lo": F.min, "hi": F.max, "mean": F.avg, "std": F.stddev_samp}
    row = x.agg(*[f(f"x{i}").alias(f"{name}{i}") for i in range(len(cols)) for name, f in parts.items()]).first() if cols else {}
    stats = {c: {"x": f"x{i}", **{name: row[f"{name}{i}"] for name in parts}} for i, c in enumerate(cols)}
    stats = {c: s for c, s in stats.items() if s["n"] and s["n"] >= min_non_null}
    if not stats:
        return df.sparkSession.createDataFrame([], IQR_SCHEMA)
    quartiles = order_statistics(x, {s["x"]: (s["n"], s["lo"], s["hi"]) for s in stats.values()}, (0.25, 0.75), skew)
    k = float(iqr_factor)
    for s in stats.values():
        s["q1"], s["q3"] = quartiles[s["x"]]
        s["iqr"] = s["q3"] - s["q1"]
        s["from"], s["to"] = s["q1"] - k * s["iqr"], s["q3"] + k * s["iqr"]
        # with no spread any value but the quartile is an outlier
        s["fences"] = (s["q1"], s["q1"]) if s["iqr"] == 0 else (s["from"], s["to"])
    counts = x.agg(*[c for i, s in enumerate(stats.values()) for c in (
        F.count_if(F.col(s["x"]) < F.lit(s["fences"][0])).alias(f"l{i}"), F.count_if(F.col(s["x"]) > F.lit(s["fences"][1])).alias(f"h{i}"))])
    of = lambda name: [F.lit(s[name]).cast("double") for s in stats.values()]
    each = range(len(stats))
    out = _rows(counts, list(stats), {
        "coluna": list(stats), "nao_nulos": [s["n"] for s in stats.values()], "outliers_inferiores": [F.col(f"l{i}") for i in each],
        "outliers_superiores": [F.col(f"h{i}") for i in each], "limite_inferior": of("from"), "limite_superior": of("to"),
        "q1": of("q1"), "q3": of("q3"), "iqr": of("iqr"), "min": of("lo"), "max": of("hi"), "media": of("mean"), "desvio_padrao": of("std")})
    both = F.col("outliers_inferiores") + F.col("outliers_superiores")
    return (out.select("*", both.alias("outliers"))
            .select("coluna", F.col("nao_nulos").cast("long").alias("nao_nulos"), "outliers", "outliers_inferiores", "outliers_superiores",
                    round_half(F.col("outliers") / F.col("nao_nulos") * 100.0, 4).alias("pct_outliers"),
                    "limite_inferior", "limite_superior", "q1", "q3", "iqr", "min", "max",
                    *[round_half(F.col(c), 6).alias(c) for c in ("media", "desvio_padrao")])
            .orderBy(F.col("pct_outliers").desc(), F.col("coluna")))


def outlier_alerts(result: DataFrame, alert_pct: float = 1.0, top_n: int = 30) -> DataFrame:
    """Columns analysed, columns at or above the alert %, and low/high
    totals over the top-N shown rows (Q-F)."""
    w = Window.orderBy(F.col("pct_outliers").desc(), F.col("coluna"))  # one row per column
    ranked = result.select("*", F.row_number().over(w).alias("__rn"))
    return ranked.agg(
        F.count(F.lit(1)).alias("colunas_analisadas"),
        F.count_if(F.col("pct_outliers") >= alert_pct).alias("colunas_em_alerta"),
        F.coalesce(F.sum(F.when(F.col("__rn") <= top_n, F.col("outliers_inferiores"))), F.lit(0))
        .cast("long").alias("inferiores_top"),
        F.coalesce(F.sum(F.when(F.col("__rn") <= top_n, F.col("outliers_superiores"))), F.lit(0))
        .cast("long").alias("superiores_top"))


def duration_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType)
            and any(fr in f.name.lower() for fr in DURATION_FRAGMENTS)]


def negative_durations(df: DataFrame) -> DataFrame:
    """Negative values per numeric duration column, descending (Q-G)."""
    cols = duration_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "coluna string, negativos long")
    row = df.agg(*[F.count_if(_q(c) < 0).alias(f"n{i}") for i, c in enumerate(cols)])
    out = _rows(row, cols, {"coluna": cols, "negativos": [F.col(f"n{i}") for i in range(len(cols))]})
    return out.orderBy(F.col("negativos").desc(), "coluna")


def negative_sample(df: DataFrame, limit_rows: int = 200, order: Sequence[str] = ()) -> DataFrame:
    """Up to ``limit_rows`` rows with any negative duration (R5); ordered by
    ``order`` so the sample is reproducible."""
    cols = duration_columns(df)
    if not cols:
        return df.limit(0)
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(_q(c) < 0, F.lit(False))
    out = df.where(cond)
    if order:
        out = out.orderBy(*[_q(o) for o in order])
    return out.limit(limit_rows)


# ----------------------------------------------------------------------------
# Regional volume, monthly series, anomalies and drift (A9-A11, W8, Q-H, Q-I, J5)
# ----------------------------------------------------------------------------

def regional_summary(df: DataFrame, regional_col: str | None = None) -> DataFrame:
    """Rows per region label with % of the total (A9); SEM_SIGLA counts
    blank labels.  The total is a scalar subquery over the per-label counts,
    so no step gathers the labels into one partition."""
    rc = regional_col or resolve_regional_dq(df.columns)
    counts = df.select(S.regional_label(rc).alias("sigla_regional")).groupBy("sigla_regional").agg(
        F.count(F.lit(1)).alias("registros"))
    total = counts.agg(F.sum("registros")).scalar()
    return counts.select("sigla_regional", "registros",
                         F.when(total > 0, F.col("registros") / total * 100.0).otherwise(F.lit(0.0))
                         .alias("pct_registros")).orderBy(F.col("registros").desc(), "sigla_regional")


def regional_summary_totals(summary: DataFrame) -> DataFrame:
    """All rows, and those without a label, of a regional summary."""
    blank = F.col("sigla_regional") == S.NO_SIGLA
    return summary.agg(F.sum("registros").cast("long").alias("total"),
                       F.coalesce(F.sum(F.when(blank, F.col("registros"))), F.lit(0)).cast("long").alias("sem_sigla"))


def regional_monthly(df: DataFrame, regional_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """Rows per (region label, month), rows without a month dropped (A10)."""
    rc = regional_col or resolve_regional_dq(df.columns)
    dc = date_col or resolve_date_dq(df.columns)
    mes = S.month_key(dc, df.schema[dc].dataType)
    return (df.select(S.regional_label(rc).alias("sigla_regional"), mes.alias("mes_ref"))
            .where(F.col("mes_ref").isNotNull())
            .groupBy("sigla_regional", "mes_ref").agg(F.count(F.lit(1)).alias("registros"))
            .orderBy("sigla_regional", "mes_ref"))


def monthly_total(monthly: DataFrame) -> DataFrame:
    """Rows per month."""
    return monthly.groupBy("mes_ref").agg(F.sum("registros").alias("registros")).orderBy("mes_ref")


def monthly_change(monthly: DataFrame) -> DataFrame:
    """Previous present month's count and % change per region.
    The window runs over one region's months (a bounded calendar)."""
    w = Window.partitionBy("sigla_regional").orderBy("mes_ref")
    prev = F.lag("registros").over(w)
    return monthly.select("sigla_regional", "mes_ref", "registros",
                          prev.alias("registros_mes_anterior")).select(
        "*", F.when(F.col("registros_mes_anterior") > 0,
                    round_half((F.col("registros") - F.col("registros_mes_anterior"))
                               / F.col("registros_mes_anterior") * 100.0, 4)).alias("pct_variacao"))


def month_rank(monthly: DataFrame) -> DataFrame:
    """(mes_ref, rank) with rank 1 = latest month.  One row per calendar
    month, so the global ordering window runs over a bounded table."""
    months = monthly.select("mes_ref").distinct()
    return months.select("mes_ref", F.row_number().over(Window.orderBy(F.col("mes_ref").desc())).alias("__rk"))


def _latest_two(monthly: DataFrame) -> DataFrame:
    # at most two rows: broadcasting them is bounded by construction
    return F.broadcast(month_rank(monthly).where(F.col("__rk") <= 2))


def regional_anomalies(monthly: DataFrame, pct_threshold: float = 35.0, z_threshold: float = 3.5,
                       latest_only: bool = True) -> DataFrame:
    """% change and MAD robust z-score per region and month; flagged rows of
    the latest month, sorted by % change then z, nulls first (Q-H; C11)."""
    by_reg = Window.partitionBy("sigla_regional")
    x = F.col("registros").cast("double")
    ch = monthly_change(monthly).select("*", F.median(x).over(by_reg).alias("__med"))
    ch = ch.select("*", F.median(F.abs(x - F.col("__med"))).over(by_reg).alias("__mad"))
    z = F.when(F.col("__mad") > 0, F.lit(0.6745) * (x - F.col("__med")) / F.col("__mad"))
    out = ch.select("sigla_regional", "mes_ref", "registros", "registros_mes_anterior", "pct_variacao",
                    round_half(z, 4).alias("robust_z"))
    flag = (F.coalesce(F.abs(F.col("pct_variacao")) >= pct_threshold, F.lit(False))
            | F.coalesce(F.abs(F.col("robust_z")) >= z_threshold, F.lit(False)))
    out = out.withColumn("anomalia", flag)
    if not latest_only:
        return out.orderBy("mes_ref", "sigla_regional")
    latest = _latest_two(monthly).where(F.col("__rk") == 1).select("mes_ref")
    return (out.join(latest, "mes_ref").where(F.col("anomalia"))
            .select("sigla_regional", "mes_ref", "registros", "registros_mes_anterior", "pct_variacao",
                    "robust_z", "anomalia")
            .orderBy(F.col("pct_variacao").desc_nulls_first(), F.col("robust_z").desc_nulls_first()))


def join_two_months(monthly: DataFrame) -> DataFrame:
    """Latest and previous month counts per region over the union of both
    months' regions, absent as 0 (J5): one conditional aggregate over the
    rows of the two latest months (found by a broadcast of at most two
    month rows), no outer join."""
    two = monthly.join(_latest_two(monthly), "mes_ref")
    return two.groupBy("sigla_regional").agg(
        F.coalesce(F.sum(F.when(F.col("__rk") == 1, F.col("registros"))), F.lit(0)).cast("long")
        .alias("registros_atual"),
        F.coalesce(F.sum(F.when(F.col("__rk") == 2, F.col("registros"))), F.lit(0)).cast("long")
        .alias("registros_anterior"))


def regional_psi(monthly: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Population stability index of the regional distribution, latest vs
    previous month, with its drift level (Q-I; card C12).  One row; null
    index with fewer than two months or an empty month.  Rows of the two
    latest months are reduced to one row per region, then to one row."""
    two = monthly.join(_latest_two(monthly), "mes_ref")
    pair = two.groupBy("sigla_regional").agg(
        F.coalesce(F.sum(F.when(F.col("__rk") == 1, F.col("registros"))), F.lit(0)).alias("__a"),
        F.coalesce(F.sum(F.when(F.col("__rk") == 2, F.col("registros"))), F.lit(0)).alias("__p"),
        F.max(F.when(F.col("__rk") == 1, F.col("mes_ref"))).alias("__ma"),
        F.max(F.when(F.col("__rk") == 2, F.col("mes_ref"))).alias("__mp"))
    # the two totals as scalar subqueries: labels are free text, so their
    # table may be large and is not gathered into one partition
    sa, sp = (pair.agg(F.sum(c)).scalar() for c in ("__a", "__p"))
    a = F.col("__a") / sa + F.lit(eps)
    e = F.col("__p") / sp + F.lit(eps)
    terms = pair.select(((a - e) * F.log(a / e)).alias("__t"), sa.alias("__sa"), sp.alias("__sp"), "__ma", "__mp")
    row = terms.agg(F.sum("__t").alias("__psi"), F.max("__sa").alias("__sa"), F.max("__sp").alias("__sp"),
                    F.max("__ma").alias("mes_atual"), F.max("__mp").alias("mes_anterior"))
    psi = F.when((F.col("__sa") > 0) & (F.col("__sp") > 0) & F.col("mes_anterior").isNotNull(),
                 round_half(F.col("__psi"), 8))
    return row.select(psi.alias("psi"), "mes_atual", "mes_anterior").select(
        "*", F.when(F.col("psi") >= 0.25, F.lit("Drift alto"))
        .when(F.col("psi") >= 0.10, F.lit("Drift moderado"))
        .when(F.col("psi").isNotNull(), F.lit("Estavel")).alias("nivel"))


# ----------------------------------------------------------------------------
# Samples, previews and profiles
# ----------------------------------------------------------------------------

def contained_sample(marked: DataFrame, max_rows: int = 500, source: str = "arquivo") -> DataFrame:
    """Up to ``max_rows`` contained rows with their provenance (R3), in a
    reproducible order (file, consumer, start, id).  ``source`` is the column
    that names a row's file, taken from ``_metadata.file_path`` before the
    marking (``mark_inputs`` does); other columns are found by their names."""
    uc, iid, start, end = interval_columns(marked)
    own = resolve_column(marked.columns, ["NUM_INTRP_UCI"]) or iid
    return (marked.where(F.col("Contido_outra_intrp"))
            .select(_q(source).alias("arquivo"), _q(uc).alias("NUM_UC_UCI"), _q(iid).alias("NUM_INTRP_INIC_MANOBRA_UCI"),
                    _q(start).alias("DTHR_INICIO_INTRP_UC"), _q(end).alias("DATA_HORA_FIM_INTR"),
                    "verificado", "Contido_outra_intrp", "Sobreposicao_tempo", "Conta_desligamento_unico",
                    "Grupo_desligamento_uc", _q(own).alias("__tb"))
            .orderBy("arquivo", "NUM_UC_UCI", "DTHR_INICIO_INTRP_UC", "NUM_INTRP_INIC_MANOBRA_UCI", "__tb")
            .limit(max_rows).drop("__tb"))


def top_n(df: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """Top-N rows of a summary."""
    return df.orderBy(*order).limit(n)


def preview_rows(df: DataFrame, n: int = 20, order: Sequence[str] = ()) -> DataFrame:
    """First n rows in a stated order."""
    return df.orderBy(*[_q(o) for o in order]).limit(n) if order else df.limit(n)


def available_months(df: DataFrame, col: str) -> DataFrame:
    """Distinct months of a date column, descending."""
    return (df.select(S.month_key(col, df.schema[col].dataType).alias("ANOMES"))
            .where(F.col("ANOMES").isNotNull()).distinct().orderBy(F.col("ANOMES").desc()))


def table_profile(named: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns of each input (A17): one count per table."""
    parts = [df.agg(F.count(F.lit(1)).alias("linhas")).select(
        F.lit(name).alias("tabela"), "linhas", F.lit(len(df.columns)).alias("colunas"))
        for name, df in named.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
