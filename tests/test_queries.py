"""Every registered query runs, and equals its SQL check where it has one."""

from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import connect, difference

SF = "/root/testdata/sf0.001"

# Queries that SQL does not express, and what checks their operator instead:
# a test with brute force or known answers, or a query on inputs whose answer SQL knows.
CHECKED_ELSEWHERE = {
    "a16_file_checksums": "a16_known_checksums", "g7_aligned_positions": "test_scoring.py::test_alignment_equals_brute_force",
    "g8_confusions": "g8_known_confusions", "g11_slot_recovery": "test_scoring.py::test_slot_recovery_needs_a_flag_and_the_truth",
    "i3_uncertain_slots": "i3_known_slots", "i4_variant_lines": "i4_known_variants", "i5_annotated_block": "i5_known_block",
    "f21_demo_statistics": "f21_known_statistics", "j3_real_or_fake": "test_sources.py::test_classifier_learns_a_separable_rule",
    "k2_readable_recoveries": "test_frames.py::test_readable_recoveries_are_filtered_and_ordered",
    "corpus_rule_pairs": "test_sources.py::test_corpus_builds",
}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_is_checked():
    """The training-data queries have their tests beside them, in tests/llm."""
    for name in set(entry.queries()) - set(entry.oracle_sql()):
        if name == "pipeline" or name.startswith("op"):
            continue
        where = CHECKED_ELSEWHERE[name]
        if "::" in where:
            file, test = where.split("::")
            assert f"def {test}(" in (Path(__file__).parent / file).read_text()
        else:
            assert where in entry.oracle_sql()


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) is None
