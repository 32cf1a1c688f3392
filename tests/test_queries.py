"""A cross-section of the registered queries against their SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from threadloom.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


NAMES = """activity_statistics signal_frequency latency_profile tier_baseline video_cap_quota keep_first_position batch_chunks forward_fill
card_levels card_projection card_new_signals card_item_limit result_filter dataset_summary research_clusters claim_review structural_review
hot_candidates reply_queue family_quotas quote_check json_repair stream_merge session_rows rule_cards""".split()


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    try:
        f = float(v)
    except (TypeError, ValueError):
        return str(v)
    return None if math.isnan(f) else round(f, 9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=str)


def test_every_core_query_has_sql():
    without = {"segmented_words"}  # a search for the cheapest split; tests/test_operators.py tries all splits
    assert set(plans.queries()) == set(plans.oracle_sql()) | without and set(plans.queries()) <= set(entry.queries())
