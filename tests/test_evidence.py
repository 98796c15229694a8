"""Every evidence query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__
from codequarry.plans import evidence
from tests.oracle import same_rows

ORACLES = evidence.oracle_sql()


@pytest.fixture(scope="module", autouse=True)
def one_trace():
    """The traces that many queries filter are made once for this module."""
    made, trace = {}, evidence.traced

    def shared(spark, sf_dir, sql=evidence.b.SOURCES):
        if (sf_dir, sql) not in made:
            made[sf_dir, sql] = trace(spark, sf_dir, sql)
        return made[sf_dir, sql]

    evidence.traced = shared
    yield
    evidence.traced = trace


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, sf_dir, name):
    same_rows(evidence.queries()[name](spark, sf_dir), sf_dir, ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_is_registered_once():
    names = list(__spark_entry__.queries())
    assert len(names) == len(set(names)) and set(__spark_entry__.oracle_sql()) <= set(names)


def test_trace_report_and_tree(spark, sf_dir):
    assert evidence.queries()["trace_report"](spark, sf_dir).count() > 0
    assert {r.path for r in evidence.queries()["tree_scan"](spark, sf_dir).collect()} >= {"plans", "plans/evidence.py", "cli.py"}
    found = {r.language: r.recognised for r in evidence.queries()["path_recognised"](spark, sf_dir).collect()}
    assert len(found) == 104 and sum(found.values()) == 98 and found["python"] and not found["matlab"]
