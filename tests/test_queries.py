"""Registered queries: the driver contract, oracle agreement at sf0.001, and the queries without SQL."""

import os
import sys
from collections import defaultdict

import duckdb
import pytest

import pyref
from paths import SF_SMALL

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E  # noqa: E402
from oracle_check import digest  # noqa: E402


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ["pages", "region", "nation", "supplier"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["collection_id", "pos", "url", "formatted_label"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ["labels", "dedup_url_longest", "dedup_smart_first", "dup_groups_smart",
                                  "fuzzy_pairs_085", "folder_entries", "outline_parse", "organise_match",
                                  "link_health", "dup_report"])
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows) == digest(rel.columns, orows)


def _by_collection(rows):
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.collection_id, r.pos)):
        by[r.collection_id].append(r)
    return by


@pytest.mark.parametrize("name,t,keep", [("dedup_fuzzy_085", 0.85, "first"), ("dedup_fuzzy_060", 0.6, "first"),
                                         ("dedup_fuzzy_030_longest", 0.3, "longest")])
def test_fuzzy_queries_match_plain_loop(spark, name, t, keep):
    links = E.queries()["labels"](spark, SF_SMALL).collect()
    want = set()
    for cid, rs in _by_collection(links).items():
        groups = pyref.fuzzy_groups([(r.url, r.formatted_label, r.domain) for r in rs], t)
        gone = pyref.keep_removed(groups, [len(r.formatted_label) for r in rs], keep)
        want |= {(cid, rs[i].pos) for i in range(len(rs)) if i not in gone}
    got = {(r.collection_id, r.pos) for r in E.queries()[name](spark, SF_SMALL).collect()}
    assert got == want


def test_levenshtein_query_matches_python(spark):
    df = E.queries()["levenshtein_ratio"](spark, SF_SMALL)
    from linkwork.sources.tables import page_link_variants

    src = {(r.collection_id, r.pos): r.text for r in page_link_variants(spark, SF_SMALL).collect()}
    for r in df.collect():
        text = src[(r.collection_id, r.pos)]
        assert r.lev_ratio == pytest.approx(round(pyref.lev_ratio(text, pyref.clean(text)), 6))
