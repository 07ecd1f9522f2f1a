"""Sharding: sizes, groups and slots, on given and on skewed tables."""

import zlib
from collections import Counter, defaultdict

import pytest

from tracewell.llm import queries, sharding


def held(rows, texts, shards=16):
    """What holds for every result; returns bytes by shard and shards by text."""
    assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _ in texts)
    slots, sizes, groups = defaultdict(list), [0] * shards, defaultdict(set)
    by_id = defaultdict(list)
    for d, t in texts:
        by_id[d].append(t)
    for r in rows:
        t = next(t for t in by_id[r["doc_id"]] if zlib.crc32((t or "").encode()) == r["text_crc32"] and len((t or "").encode()) + 1 == r["size"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[t].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes, groups


def test_query(spark, sf_dir):
    rows = queries.op12_shard(spark, sf_dir).collect()
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    sizes, groups = held(rows, texts)
    largest = max(len((t or "").encode()) + 1 for _, t in texts)
    assert max(sizes) - min(sizes) <= largest
    assert all(len(s) == 1 for s in groups.values())


def test_hot_group_is_cut_and_small_groups_are_whole(spark):
    """A third of all rows are one text: it goes in pieces, sizes stay equal, and no other group is cut."""
    texts = [(i, "the same text over and over" if i % 3 == 0 else f"text number {i // 6} of the table") for i in range(9000)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    rows = sharding.assign(df).collect()
    sizes, groups = held(rows, texts)
    assert max(sizes) <= 1.01 * sum(sizes) / 16 and min(sizes) >= 0.99 * sum(sizes) / 16
    assert len(groups.pop("the same text over and over")) > 1
    assert all(len(s) == 1 for s in groups.values())


def test_one_text_alone(spark):
    texts = [(i, "x" * 50) for i in range(4000)]
    sizes, _ = held(sharding.assign(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)
    assert max(sizes) <= 1.03 * sum(sizes) / 16


def test_long_text_nulls_and_repeated_rows(spark):
    texts = [(1, "y" * 2_000_000), (2, None), (3, ""), (None, "a"), (None, "a"), (5, "b"), (5, "b"), (5, "c"), *[(i, f"é{i}" * 9) for i in range(10, 60)]]
    rows = sharding.assign(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    held(rows, texts)
    long = next(r["shard"] for r in rows if r["doc_id"] == 1)
    assert sum(r["shard"] == long for r in rows) == 1


@pytest.mark.parametrize("shards", [1, 3])
def test_few_rows_and_empty(spark, shards):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    held(sharding.assign(df, shards).collect(), [(1, "a"), (2, "b")], shards)
    assert sharding.assign(df.limit(0), shards).count() == 0


def test_sharded_keeps_columns(spark):
    """Columns pass through under any names; texts are where assign puts them."""
    rows = [(i, f"t{i % 7}" * 40, i, i * 2, "z") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, `a.text` string, key long, range long, shard string")
    out = sharding.sharded(df, 4, text="a.text")
    assert out.columns == ["doc_id", "a.text", "key", "range", "shard"]
    got = {r["doc_id"]: r for r in out.collect()}
    want = {r["doc_id"]: r["shard"] for r in sharding.assign(df, 4, text="a.text").collect()}
    assert {d: r["shard"] for d, r in got.items()} == want
    assert all((got[i]["a.text"], got[i]["key"], got[i]["range"]) == (f"t{i % 7}" * 40, i, i * 2) for i in got)
