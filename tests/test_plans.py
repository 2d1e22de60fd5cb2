"""Plan hygiene of every registered query: no Cartesian products, no nested-loop joins, no row-at-a-time UDFs.

A query runs several jobs before it returns its table.  The plans of all of them are looked at: whatever is
checkpointed, written, collected or counted on the way, and what is returned.
"""

import io
import os
import sys
from contextlib import redirect_stdout

import pytest

from paths import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"]
ACTIONS = ["checkpoint", "collect", "first", "head", "count", "isEmpty", "toArrow", "toPandas"]


def plan_of(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.fixture
def plans(spark, monkeypatch):
    """Plans of all jobs that a test starts."""
    seen: list[str] = []
    frame = type(spark.range(1))
    writer = type(spark.range(1).write)
    busy = []

    def watched(old, of):
        def run(self, *args, **kwargs):
            if not busy:  # an action may call another one
                busy.append(1)
                try:
                    seen.append(plan_of(of(self)))
                finally:
                    busy.pop()
            return old(self, *args, **kwargs)
        return run

    for name in ACTIONS:
        monkeypatch.setattr(frame, name, watched(getattr(frame, name), lambda df: df))
    for name in ("parquet", "saveAsTable", "save"):
        monkeypatch.setattr(writer, name, watched(getattr(writer, name), lambda w: w._df))
    return seen


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_plans_have_no_forbidden_operators(spark, plans, name):
    df = E.queries()[name](spark, SF_SMALL)
    plans.append(plan_of(df))
    for plan in plans:
        assert not [op for op in FORBIDDEN if op in plan], name


def test_earlier_plans_are_seen(spark, plans):
    E.queries()["dedup_fuzzy_085"](spark, SF_SMALL)
    assert len(plans) > 5 and any("Window" in p for p in plans)
