"""Counts measured independently on the fixture views (FIXTURES.md,
"Coverage measured with DuckDB"): the Spark operators must reproduce them."""

import pytest

from outagekit.operators import intervals as iv
from outagekit.plans import catalog
from outagekit.sources.fixtures import table

# sf -> (rows, valid, contained, overlapping, unique), B2 (merges, contained, overlapping),
#       repeated (UC, manoeuvre) rows, repeated lineitem keys
EXPECTED = {
    "/root/testdata/sf0.001": ((1000, 980, 39, 163, 893), (1, 2, 4), 90, 1401),
    "/root/testdata/sf0.01": ((10000, 9798, 360, 1344, 9098), (100, 102, 399), 110, 14168),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_counts_match_fixture_coverage(spark, sf):
    b1, b2, rep, li = EXPECTED[sf]
    r = catalog.QUERIES["mark_summary"](spark, sf).collect()[0]
    assert (r.total, r.verificado_true, r.contido_true, r.sobreposto_true, r.conta_unico_true) == b1
    assert catalog.QUERIES["precision_totals"](spark, sf).collect()[0].MERGE_CRITERIO == b2[0]
    d = iv.mark_summary(iv.mark_overlaps(table(spark, sf, "intr_dense"))).collect()[0]
    assert (d.contido_true, d.sobreposto_true) == b2[1:]
    assert b1[0] - catalog.QUERIES["dedup_first"](spark, sf).count() == rep
    assert catalog.QUERIES["duplicate_check"](spark, sf).collect()[0].failed == li


def test_iqr_and_monthly_rows_sf001(spark):
    from outagekit.operators import quality as dq
    sf = "/root/testdata/sf0.01"
    r = dq.iqr_outliers(table(spark, sf, "events"), min_non_null=1).where("coluna = 'value'").collect()[0]
    assert r.outliers == 463
    assert catalog.QUERIES["regional_monthly"](spark, sf).count() == 397
    assert catalog.QUERIES["negative_sample"](spark, sf).count() == 98


def test_dec_fec_identities_on_data(spark):
    rows = catalog.QUERIES["dec_fec"](spark, "/root/testdata/sf0.01").collect()
    regs = [r for r in rows if r.REGIONAL_TOTAL != "COPEL"]
    tot = [r for r in rows if r.REGIONAL_TOTAL == "COPEL"][0]
    for r in rows:
        assert r.CI_BRUTO == r.CI_LIQUIDO + r.CI_EXPURGO
        assert abs(r.CHI_BRUTO - (r.CHI_LIQUIDO + r.CHI_EXPURGO)) < 1e-9
        assert abs(r.DEC_BRUTO - round(r.CHI_BRUTO / r.UC_FATURADA, 4)) < 1e-9
        assert abs(r.FEC_LIQUIDO - r.CI_LIQUIDO / r.UC_FATURADA) < 1e-12
    assert tot.UC_FATURADA == sum(r.UC_FATURADA for r in regs)
    assert tot.CI_BRUTO == sum(r.CI_BRUTO for r in regs)
    assert abs(sum(r.PCT_UC_FATURADA for r in regs) - 100.0) < 0.05
