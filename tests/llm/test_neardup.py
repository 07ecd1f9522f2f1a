"""The pipeline's near_dedup stage against all pairs compared word by word."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import neardup, simhash, stages

DOCS = "doc_id long, text string, url string"


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return a == b or 9 * len(a & b) >= 4 * (len(a) + len(b))


def components(rows):
    own, parent = {i: sets(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a in own:
        for b in own:
            if a < b and similar(own[a], own[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in own}


def corpus():
    """Texts with copies changed in some words, a passage shared by many, one text with many copies, short and empty ones."""
    r, out = random.Random(7), []
    word = lambda: f"w{r.randrange(4000)}"
    passage = [word() for _ in range(60)]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = word()
        return words

    for _ in range(40):
        base = [word() for _ in range(r.randrange(60, 300))]
        out += [base, changed(base, 1), changed(base, r.randrange(2, 9))]
    out += [passage + [word() for _ in range(r.randrange(5, 40))] for _ in range(60)]
    hub = [word() for _ in range(120)]
    out += [changed(hub, r.randrange(1, 5)) for _ in range(80)]
    out += [["a", "b"], ["a", "b"], ["a", "c"], []]
    texts = [" ".join(x) for x in out] + [None]
    r.shuffle(texts)
    return [(i, t, f"u{i}") for i, t in enumerate(texts)]


@pytest.mark.parametrize(("common", "hot"), [(0, 64), (100_000, 64), (0, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, common, hot):
    """Also where the order changes for buckets of a few texts or for all."""
    monkeypatch.setattr(neardup, "COMMON", common)
    monkeypatch.setattr(neardup, "HOT", hot)
    monkeypatch.setattr(neardup, "BROADCAST_IDS", common)
    monkeypatch.setattr(neardup, "LATE", 0 if hot == 2 else 1000)
    rows = corpus()
    out = neardup.clusters(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: r.component_id for r in out} == components(rows)


@pytest.mark.parametrize("passage", [40])
def test_pairs_grow_in_proportion(spark, monkeypatch, passage):
    """Unrelated texts that share a passage, which no sample knows: no pair of them is compared; copies are found."""
    monkeypatch.setattr(neardup, "COMMON", 0)
    monkeypatch.setattr(neardup, "HOT", 10)
    counted, compare = [], neardup.confirmed
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *a: counted.append(pairs.count()) or compare(pairs, *a))
    r = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(passage))
    made = {}
    for n in (150, 300):
        texts = [" ".join([*(f"w{r.randrange(10**9)}" for _ in range(60)), shared, *(f"w{r.randrange(10**9)}" for _ in range(60))]) for _ in range(n)]
        rows = [(i, t, "") for i, t in enumerate([*texts, texts[3] + " more", texts[7] + " words"])]
        counted.clear()
        out = neardup.clusters(spark.createDataFrame(rows, DOCS)).collect()
        made[n] = sum(counted)
        assert {r.doc_id: r.component_id for r in out} == {i: {n: 3, n + 1: 7}.get(i, i) for i in range(n + 2)}
    assert made[300] <= 3 * max(made[150], 300)


def test_pairs_meet_few_bytes_and_go_before_whole_sets(spark, monkeypatch):
    """Texts that share two thirds of their words share most of a prefix. Such pairs meet less than a prefix each, and
    none of them gets to whole sets; copies do."""
    r, rows, tables = random.Random(11), [], {}
    word = lambda: f"w{r.randrange(10**6)}"
    for _ in range(30):
        base = [word() for _ in range(300)]
        rows += [" ".join([*base[:200], *(word() for _ in range(100))]) for _ in range(3)] + [" ".join(base), " ".join([*base, "more"])]
    rows = [(i, t, "") for i, t in enumerate(rows)]
    write = neardup.materialise

    def seen(df, name):
        out = write(df, name)
        tables.setdefault(name, []).extend(out.collect())
        return out

    monkeypatch.setattr(neardup, "materialise", seen)
    out = neardup.clusters(spark.createDataFrame(rows, DOCS)).collect()
    assert {x.doc_id: x.component_id for x in out} == components(rows) == {i: i - (i % 5 == 4) for i in range(150)}
    proposed = {(x.u, x.v) for name in ("hashed", "apart", "led", "mixed_pairs") for x in tables[name]}
    likely = {(x.u, x.v) for x in tables["likely"]}
    assert len(proposed) > 40 and len(likely) == 30
    longs = [sum(len(x) for x in row if isinstance(x, list)) for row in tables["heads"]]
    assert longs and max(longs) < 300 // 5 // 4


def test_parities_bound_what_sets_share(spark):
    """Never below what is shared, also where one set has twice the bits of the other; sets that share little go."""
    r, pairs = np.random.default_rng(5), []
    for n in (0, 1, 5, 63, 64, 65, 100, 128, 130, 500, 512, 520, 5000):
        for more, gone in ((0, 0), (1, 0), (0, 1), (n // 9, 0), (n // 20, n // 20), (n // 3, n // 3)):
            own = r.integers(-(2**63), 2**63, n + more)
            a, b = np.sort(own[:n]), np.sort(own[min(gone, n) :])
            pairs.append((n, len(b), [int(x) for x in neardup.parities(a)], [int(x) for x in neardup.parities(b)], n - min(gone, n)))
    made = spark.createDataFrame(pairs, "na long, nb long, ba array<long>, bb array<long>, shared long")
    similar_size = neardup.enough(F.least("na", "nb"), F.col("na"), F.col("nb"))
    got = made.where(similar_size).withColumn("most", neardup.shared_at_most("na", "ba", "nb", "bb")).withColumn("back", neardup.shared_at_most("nb", "bb", "na", "ba")).collect()
    assert any(len(x.ba) != len(x.bb) for x in got)
    assert all(x.shared <= x.most == x.back for x in got)
    assert all(x.most == x.shared for x in got if x.na == x.nb == x.shared)
    far = [x for x in got if x.na == x.nb >= 64 and x.shared < 0.7 * x.na]
    assert far and all(9 * x.most < 4 * (x.na + x.nb) for x in far)


def test_stage_drops_copies_with_changed_words(spark):
    rows = corpus()
    kept = stages.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert kept.columns == ["doc_id", "text", "url"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(rows).values()))


def test_stage_rows_without_or_with_repeated_ids(spark):
    text = " ".join(f"x{i}" for i in range(50))
    rows = [(None, text, "a"), (2, text + " y", "b"), (2, text + " z", "c"), (1, "else", "d"), (None, "other", "e")]
    out = stages.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(r.url for r in out if r.doc_id is None) == ["a", "e"]
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == [1, 2]
    assert stages.near_dedup(spark, spark.createDataFrame([], DOCS), "").collect() == []


def simhash_of(text):
    """The fingerprint of a text's set of shingles, bit by bit."""
    h = [xxhash.xxh64_intdigest(" ".join(s), 42) for s in sets(text)]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_fingerprints_and_pivot_table_propose_first(spark, monkeypatch):
    """The stage gets links from SimHash fingerprints that pass the pivot table; prefixes are not asked for those again."""
    rows = corpus()
    r = random.Random(3)
    long = [f"v{r.randrange(9000)}" for _ in range(900)]
    rows += [(len(rows) + i, " ".join([*long[:-i], *(f"z{i}" for _ in range(i))] if i else long), "") for i in range(4)]
    sims = {simhash_of(t) for _, t, _ in rows}
    want = {frozenset((a, b)) for a in sims for b in sims if a < b and (a ^ b).bit_count() <= neardup.BITS}
    tables, made, left = [], [], []
    table, hashed, apart = simhash.pivot_table, simhash.links, neardup.apart

    def seen_table(fps):
        tables.append({x.fp & (1 << 64) - 1 for x in fps.collect()})
        return table(fps)

    def seen_links(*a):
        out = hashed(*a)
        made.append({frozenset((x.u & (1 << 64) - 1, x.v & (1 << 64) - 1)) for x in out.collect()})
        return out

    def seen_apart(pairs, root):
        roots = {x.fp: x.root for x in root.collect()}
        out = apart(pairs, root)
        left.extend((roots.get(x.u, x.u), roots.get(x.v, x.v)) for x in out.collect())
        assert roots
        return out

    monkeypatch.setattr(simhash, "pivot_table", seen_table)
    monkeypatch.setattr(simhash, "links", seen_links)
    monkeypatch.setattr(neardup, "apart", seen_apart)
    kept = stages.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted(x.doc_id for x in kept) == sorted(set(components(rows).values()))
    assert tables == [sims] and want and made == [want]
    assert left and all(u != v for u, v in left)
