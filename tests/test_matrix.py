"""Packed rows of the regulatory matrix: what they hold, and that reading them moves nothing."""

import pytest

from varloom.operators import matrix as M
from varloom.operators import regulatory as R


@pytest.fixture(scope="module")
def packed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("matrix") / "m")
    codes = spark.createDataFrame([(1, 0, 0), (1, 1, 3), (1, 1, 7), (1, 4, 1), (2, 0, 7), (2, 2, 4), (3, 3, 0)], "row_index long, sample_index long, code int")
    M.pack(codes, 5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def members(spark):
    rows = [("CL:1", "D1", 0, "full_classification"), ("CL:1", "D2", 1, "accessibility_only"), ("CL:2", "D1", 4, "partial_classification"), ("CL:2", "D3", 2, "full_classification"), ("CL:3", "D4", 3, "accessibility_only")]
    return spark.createDataFrame(rows, "ontology_id string, donor string, sample_index long, evidence_tier string")


def test_a_row_holds_all_samples(packed):
    assert {r.row_index: r.codes for r in packed.collect()} == {1: [0, 3, None, None, 1], 2: [7, None, 4, None, None], 3: [None, None, None, 0, None]}
    assert dict(packed.dtypes)["codes"] == "array<tinyint>"


def test_summaries_of_rows_and_contexts(packed, members):
    states = sorted(tuple(r) for r in M.element_states(packed).collect())
    assert states == [(1, 3, 2, "mixed"), (2, 2, 2, "h3k4me3_associated"), (3, 1, 0, "not_detected")]
    got = {(r.row_index, r.ontology_id): (r.donors, r.detected, r.capability, r.state, r.classes) for r in M.context_evidence(packed, members).collect()}
    assert got == {
        (1, "CL:1"): (2, 1, 1, "classified", {"inactive": 1, "dELS": 1}), (1, "CL:2"): (1, 1, 1, "classified", {"PLS": 1}), (2, "CL:1"): (1, 1, 1, "accessible_only", {"CA": 1}),
        (2, "CL:2"): (1, 1, 1, "h3k4me3_associated", {"CA-H3K4me3": 1}), (3, "CL:3"): (1, 0, 0, "not_detected", {"inactive": 1}),
    }
    curated = {(r.row_index, r.ontology_id): r.status for r in M.curated_summary(packed, members).collect()}
    assert curated == {(1, "CL:1"): "single_accessibility_only", (1, "CL:2"): "single_promoter_like", (2, "CL:1"): "single_accessibility_supported", (2, "CL:2"): "single_h3k4me3_associated", (3, "CL:3"): "no_classifying_evidence_in_context"}
    assert sorted(tuple(r) for r in M.element_summary(packed, members).collect()) == [(1, 2, 2), (2, 2, 2)]
    assert sorted((r.row_index, r.sample_index, r["class"]) for r in M.tissue_evidence(packed).collect()) == [(1, 0, "inactive"), (1, 1, "dELS"), (1, 4, "PLS"), (2, 0, "CA"), (2, 2, "CA-H3K4me3"), (3, 3, "inactive")]


def test_reading_packed_rows_moves_nothing(packed, members):
    for df in (M.element_states(packed), M.tissue_evidence(packed), M.context_evidence(packed, members), M.curated_summary(packed, members), M.element_summary(packed, members)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan


def test_an_ontology_is_closed_by_new_pairs(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 5), (31, 30), (31, 2)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)

    def above(t):
        return up.get(t, set()) | {y for x in up.get(t, set()) for y in above(x)}

    got = sorted(tuple(r) for r in R.closure(spark.createDataFrame(edges, "term int, parent int")).collect())
    assert got == sorted((t, a) for t in up for a in above(t))
