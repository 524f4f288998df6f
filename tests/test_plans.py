"""Physical-plan checks: no one-partition exchange on data-sized inputs, pushed
filters and pruned columns at the scan, partition pruning for stored folds."""

import re

import pytest

from tessera.plans.registry import load_all

from .conftest import SF_SMALL

QUERIES, _ = load_all()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["random_kfold", "group_kfold", "stratified_kfold", "pos_pairs", "neg_pairs",
                                  "encode_tokens", "oof_group_mean", "pool_mean", "kendall_tau", "build_vocab"])
def test_no_single_partition_exchange(spark, name):
    """A one-partition exchange may only receive an aggregate keyed by a bounded
    key: bucket ids (<= 16^k), strata, or nothing (one-row totals)."""
    lines = plan(QUERIES[name](spark, SF_SMALL)).splitlines()
    bounded = re.compile(r"HashAggregate\(keys=\[(_bkt[#0-9]*|_pid[#0-9]*|lang#[0-9]+|_stratum#[0-9]+|)[,\]]")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            assert bounded.search(child), "\n".join(lines[max(0, i - 2): i + 3])


def test_filter_pushed_and_columns_pruned(spark):
    df = QUERIES["category_filter"](spark, SF_SMALL)
    p = plan(df)
    assert "PushedFilters: [IsNotNull(lang), IsNotNull(n_chars), EqualTo(lang,en)" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in p


def test_fold_cache_prunes_partitions(spark):
    df = QUERIES["fold_cache"](spark, SF_SMALL)
    p = plan(df)
    assert "PartitionFilters: [isnotnull(kfold" in p and "(kfold#" in p
