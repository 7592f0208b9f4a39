"""SQL text blocks for the DuckDB checks.

These re-state each operator's semantics in plain SQL, independently of
the DataFrame code, so the driver can compare both on the same tables.
"""

from __future__ import annotations

from outagekit.functions.numeric import round_half_sql as RH


def mark_sql(src: str, uc: str, iid: str, start: str, end: str, tb: str | None, cols: list[str],
             internals: bool = False, scope: str = "") -> str:
    """I1 on ``src``; output = ``cols`` + mark columns.  ``scope``: a further
    column of the key."""
    order = "__ini ASC NULLS FIRST, __fim ASC NULLS FIRST, __id ASC NULLS FIRST"
    if tb:
        order += f", CAST({tb} AS VARCHAR) ASC NULLS FIRST"
    key = "__uc" + (f", {scope}" if scope else "")
    w = f"PARTITION BY {key} ORDER BY {order}"
    run = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    keep = ", ".join(c for c in cols if c not in (
        "verificado", "Contido_outra_intrp", "Sobreposicao_tempo", "Conta_desligamento_unico",
        "Grupo_desligamento_uc", "NUM_INTRP_PERCEBIDA", "DTHR_INICIO_INTRP_PERCEBIDO",
        "DATA_HORA_FIM_INTR_PERCEBIDO", "DURACAO_PERCEBIDA_MINUTOS",
        "DTHR_INICIO_INTRP_PERCEBIDA", "DATA_HORA_FIM_INTR_PERCEBIDA"))
    extra = ""
    if internals:
        extra = (", __pm AS PREV_MAX_FIM, __next_ini AS NEXT_MIN_INI, __prev_fim AS PREV_FIM, "
                 "__dur_s / 60.0 AS DUR_MIN, __gap_s / 60.0 AS GAP_PREV_MIN, __prev_dur_s / 60.0 AS PREV_DUR_MIN, "
                 "__grp AS GRUPO_PERCEBIDO")
    return f"""
(WITH b AS (
  SELECT *, CAST({uc} AS VARCHAR) AS __uc, CAST({iid} AS VARCHAR) AS __id,
         CAST({start} AS TIMESTAMP) AS __ini, CAST({end} AS TIMESTAMP) AS __fim FROM {src}
), s1 AS (
  SELECT *,
    (__uc IS NOT NULL AND __id IS NOT NULL AND __ini IS NOT NULL AND __fim IS NOT NULL AND __fim >= __ini) AS __valid,
    CASE WHEN __fim IS NOT NULL THEN max(__fim) OVER {run} END AS __cum_fim,
    lead(__ini) OVER ({w}) AS __next_ini,
    lag(__fim) OVER ({w}) AS __prev_fim,
    date_diff('second', __ini, __fim) AS __dur_s
  FROM b
), s2 AS (
  SELECT *, lag(__cum_fim) OVER ({w}) AS __pm, lag(__dur_s) OVER ({w}) AS __prev_dur_s,
         date_diff('second', __prev_fim, __ini) AS __gap_s
  FROM s1
), s3 AS (
  SELECT *, __valid AS verificado,
    coalesce(__valid AND __fim <= __pm, false) AS Contido_outra_intrp,
    coalesce(__valid AND (__ini <= __pm OR __fim >= __next_ini), false) AS Sobreposicao_tempo,
    coalesce(__valid AND __ini <= __pm, false) AS __ovp,
    coalesce(__valid AND __gap_s >= 0 AND __gap_s < 60 AND __dur_s < 60 AND __prev_dur_s < 60, false) AS __merge
  FROM s2
), s4 AS (
  SELECT *, (verificado AND NOT __ovp) AS Conta_desligamento_unico,
    CASE WHEN verificado THEN CAST(sum(CAST(verificado AND NOT __ovp AS BIGINT)) OVER {run} AS BIGINT) END AS Grupo_desligamento_uc,
    CASE WHEN verificado THEN CAST(sum(CAST(NOT __merge AS BIGINT)) OVER {run} AS BIGINT) END AS __grp
  FROM s3
), s5 AS (
  SELECT *, min(__ini) OVER (PARTITION BY {key}, __grp) AS __ini_p,
            max(__fim) OVER (PARTITION BY {key}, __grp) AS __fim_p,
            first_value(__id) OVER (PARTITION BY {key}, __grp ORDER BY {order}
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS __id_p
  FROM s4
)
SELECT {keep}, verificado, Contido_outra_intrp, Sobreposicao_tempo, Conta_desligamento_unico, Grupo_desligamento_uc,
  coalesce(CASE WHEN verificado THEN __id_p ELSE CAST({iid} AS VARCHAR) END, CAST({iid} AS VARCHAR)) AS NUM_INTRP_PERCEBIDA,
  coalesce(CASE WHEN verificado THEN __ini_p ELSE __ini END, __ini) AS DTHR_INICIO_INTRP_PERCEBIDO,
  coalesce(CASE WHEN verificado THEN __fim_p ELSE __fim END, __fim) AS DATA_HORA_FIM_INTR_PERCEBIDO,
  coalesce(CASE WHEN verificado THEN date_diff('second', __ini_p, __fim_p) / 60.0 ELSE __dur_s / 60.0 END,
           __dur_s / 60.0, 0.0) AS DURACAO_PERCEBIDA_MINUTOS,
  coalesce(CASE WHEN verificado THEN __ini_p ELSE __ini END, __ini) AS DTHR_INICIO_INTRP_PERCEBIDA,
  coalesce(CASE WHEN verificado THEN __fim_p ELSE __fim END, __fim) AS DATA_HORA_FIM_INTR_PERCEBIDA{extra}
FROM s5)"""


INTR_LONG_COLS = ["NUM_UC_UCI", "NUM_INTRP_UCI", "NUM_INTRP_INIC_MANOBRA_UCI", "SIGLA_REGIONAL",
                  "TIPO_PROTOC_JUSTIF_UCI", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP"]
INTR_DENSE_COLS = ["NUM_UC_UCI", "NUM_INTRP_UCI", "SIGLA_REGIONAL", "DTHR_INICIO_INTRP_UC", "DATA_HORA_FIM_INTRP"]


def marked_long() -> str:
    return mark_sql("intr_long", "NUM_UC_UCI", "NUM_INTRP_INIC_MANOBRA_UCI", "DTHR_INICIO_INTRP_UC",
                    "DATA_HORA_FIM_INTRP", "NUM_INTRP_UCI", INTR_LONG_COLS)


def marked_dense(internals: bool = False) -> str:
    return mark_sql("intr_dense", "NUM_UC_UCI", "NUM_INTRP_UCI", "DTHR_INICIO_INTRP_UC",
                    "DATA_HORA_FIM_INTRP", None, INTR_DENSE_COLS, internals)


def month_bounds(anomes: str) -> tuple[str, str]:
    y, m = int(anomes[:4]), int(anomes[5:7])
    ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
    return f"TIMESTAMP '{y:04d}-{m:02d}-01 00:00:00'", f"TIMESTAMP '{ny:04d}-{nm:02d}-01 00:00:00'"


def unique_intrp(anomes: str) -> str:
    """F1 + J3 + A1 + A2 over B1 marked, joined to the B3 code map."""
    lo, hi = month_bounds(anomes)
    return f"""
(SELECT REGIONAL_TOTAL, NUM_UC_UCI, NUM_INTRP_PERCEBIDA, DUR_MIN,
        CASE WHEN all0 THEN 'LIQUIDO' ELSE 'EXPURGO' END AS NATUREZA
 FROM (
  SELECT coalesce(mp.REGIONAL_TOTAL, 'SEM_REGIONAL') AS REGIONAL_TOTAL, e.NUM_UC_UCI, e.NUM_INTRP_PERCEBIDA,
         max(e.DUR_MIN) AS DUR_MIN, bool_and(e.TIPO = '0') AS all0
  FROM (
    SELECT coalesce(SIGLA_REGIONAL, '') AS SIGLA_REGIONAL, CAST(NUM_UC_UCI AS VARCHAR) AS NUM_UC_UCI,
           CAST(NUM_INTRP_PERCEBIDA AS VARCHAR) AS NUM_INTRP_PERCEBIDA,
           coalesce(TRY_CAST(DURACAO_PERCEBIDA_MINUTOS AS DOUBLE), 0.0) AS DUR_MIN,
           coalesce(CAST(TIPO_PROTOC_JUSTIF_UCI AS VARCHAR), '') AS TIPO,
           coalesce(verificado, false) AS VERIFICADO
    FROM {marked_long()} m
    WHERE DTHR_INICIO_INTRP_PERCEBIDO >= {lo} AND DTHR_INICIO_INTRP_PERCEBIDO < {hi}
  ) e
  LEFT JOIN (SELECT DISTINCT SIGLA_REGIONAL, REGIONAL_TOTAL FROM billed_month
             WHERE ANOMES = '{anomes}' AND SIGLA_REGIONAL IS NOT NULL AND SIGLA_REGIONAL <> ''
               AND REGIONAL_TOTAL <> 'COPEL') mp
    ON e.SIGLA_REGIONAL = mp.SIGLA_REGIONAL
  WHERE e.NUM_UC_UCI IS NOT NULL AND e.NUM_UC_UCI <> '' AND e.NUM_INTRP_PERCEBIDA IS NOT NULL
    AND e.NUM_INTRP_PERCEBIDA <> '' AND e.VERIFICADO AND e.DUR_MIN >= 3.0
  GROUP BY 1, 2, 3) u)"""


def us(expr: str) -> str:
    return f"CAST(round({expr} * 60000000.0) AS BIGINT)"


def dec_fec_sql(anomes: str) -> str:
    base = f"""
  SELECT b.REGIONAL_TOTAL, b.UC_FATURADA,
         CAST(coalesce(s.CI_LIQUIDO, 0) AS DOUBLE) AS CI_LIQUIDO, coalesce(s.CHL_US, 0) AS CHL_US,
         CAST(coalesce(s.CI_EXPURGO, 0) AS DOUBLE) AS CI_EXPURGO, coalesce(s.CHE_US, 0) AS CHE_US
  FROM (SELECT REGIONAL_TOTAL, max(UC_FATURADA) AS UC_FATURADA FROM billed_month
        WHERE ANOMES = '{anomes}' AND REGIONAL_TOTAL <> 'COPEL' GROUP BY 1) b
  LEFT JOIN (
    SELECT REGIONAL_TOTAL,
      count(*) FILTER (WHERE NATUREZA = 'LIQUIDO') AS CI_LIQUIDO,
      coalesce(sum(CASE WHEN NATUREZA = 'LIQUIDO' THEN {us('DUR_MIN')} END), 0) AS CHL_US,
      count(*) FILTER (WHERE NATUREZA <> 'LIQUIDO') AS CI_EXPURGO,
      coalesce(sum(CASE WHEN NATUREZA <> 'LIQUIDO' THEN {us('DUR_MIN')} END), 0) AS CHE_US
    FROM {unique_intrp(anomes)} u GROUP BY 1) s
  ON b.REGIONAL_TOTAL = s.REGIONAL_TOTAL"""
    rolled = f"""
  SELECT CASE WHEN GROUPING(REGIONAL_TOTAL) = 1 THEN 'COPEL' ELSE REGIONAL_TOTAL END AS REGIONAL_TOTAL,
         GROUPING(REGIONAL_TOTAL) AS tot,
         sum(UC_FATURADA) AS UC, sum(CI_LIQUIDO) AS CIL, CAST(sum(CHL_US) AS DOUBLE) / 3600000000.0 AS CHL,
         sum(CI_EXPURGO) AS CIE, CAST(sum(CHE_US) AS DOUBLE) / 3600000000.0 AS CHE,
         CAST(sum(CHL_US) + sum(CHE_US) AS DOUBLE) / 3600000000.0 AS CHB
  FROM ({base}) x GROUP BY ROLLUP (REGIONAL_TOTAL)"""

    def sd(a, b):
        return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {a} / {b} END)"

    ratios = f"""
  SELECT REGIONAL_TOTAL, tot,
    {sd('CHL', 'UC')} AS DEC_LIQUIDO, {sd('CHE', 'UC')} AS DEC_EXPURGO, {sd('CHL', 'UC')} AS DEC_COM_EXPURGO,
    {sd('CIL', 'UC')} AS FEC_COM_EXPURGO, {sd('CIL', 'UC')} AS FEC_LIQUIDO, {sd('CIE', 'UC')} AS FEC_EXPURGO,
    {sd('CHB', 'UC')} AS DEC_BRUTO, {sd('(CIL + CIE)', 'UC')} AS FEC_BRUTO,
    UC AS UC_FATURADA, CIL AS CI_LIQUIDO, CHL AS CHI_LIQUIDO, CIE AS CI_EXPURGO, CHE AS CHI_EXPURGO,
    CIL + CIE AS CI_BRUTO, CHB AS CHI_BRUTO
  FROM ({rolled}) r"""

    def share(c):
        den = f"sum(CASE WHEN tot = 0 THEN {c} END) OVER ()"
        den = f"(CASE WHEN coalesce({den}, 0.0) = 0 THEN 1.0 ELSE {den} END)"
        return RH(f"({c} / {den} * 100.0)", 2)

    return f"""
SELECT REGIONAL_TOTAL, DEC_LIQUIDO, DEC_EXPURGO, {RH('DEC_COM_EXPURGO', 4)} AS DEC_COM_EXPURGO,
  {RH('FEC_COM_EXPURGO', 4)} AS FEC_COM_EXPURGO, FEC_LIQUIDO, FEC_EXPURGO,
  {RH('DEC_BRUTO', 4)} AS DEC_BRUTO, {RH('FEC_BRUTO', 4)} AS FEC_BRUTO,
  UC_FATURADA, CI_LIQUIDO, CHI_LIQUIDO, CI_EXPURGO, CHI_EXPURGO, CI_BRUTO, CHI_BRUTO,
  {share('DEC_COM_EXPURGO')} AS PCT_DEC_COM_EXPURGO, {share('FEC_COM_EXPURGO')} AS PCT_FEC_COM_EXPURGO,
  {share('DEC_BRUTO')} AS PCT_DEC_BRUTO, {share('FEC_BRUTO')} AS PCT_FEC_BRUTO,
  {share('UC_FATURADA')} AS PCT_UC_FATURADA
FROM ({ratios}) t
ORDER BY tot, REGIONAL_TOTAL"""
