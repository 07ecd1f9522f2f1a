"""Versioned tables and documents: swaps that survive a lost writer, differences of JSON, life cycles."""

import json
import random

import pytest

from tracewell.operators import versions
from tracewell.sources import versioned


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_swap_and_lost_writer(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versioned.latest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        versioned.read(spark, path)
    table = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert versioned.replace(table, path).number == 1
    began = versioned.read(spark, path)
    versioned.merge(spark, path, ["k"], spark.createDataFrame([(2, "B"), (4, "d"), (4, "D")], "k int, v string"), spark.createDataFrame([(1,)], "k int"))
    assert rows(versioned.read(spark, path)) == [(2, "B"), (3, "c"), (4, "d")] or rows(versioned.read(spark, path)) == [(2, "B"), (3, "c"), (4, "d")]
    assert rows(began) == [(1, "a"), (2, "b"), (3, "c")]  # a reader goes on with its version
    # A writer that is lost before it publishes changes nothing; nor does one lost between pointer and line.
    lost = versioned.prepare(table.limit(0), path)
    assert rows(versioned.read(spark, path)) == [(2, "B"), (3, "c"), (4, "d")]
    (tmp_path / "t" / versioned.POINTERS / f"{3:012d}").write_text("")
    assert versioned.latest(spark, path).number == 2
    (tmp_path / "t" / versioned.POINTERS / f"{3:012d}").unlink()
    assert versioned.vacuum(spark, path, keep=2) == 1 and not (tmp_path / "t" / lost).exists()
    assert versioned.purge(spark, path)[1] == 3 and versioned.read(spark, path).isEmpty()


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.createDataFrame([(1,)], "k int")
    before = versioned.replace(table, path)
    mine, theirs = versioned.prepare(table.limit(0), path), versioned.prepare(table.union(table), path)
    versioned.publish(spark, path, theirs, before)
    with pytest.raises(versioned.Conflict):
        versioned.publish(spark, path, mine, before)
    assert rows(versioned.read(spark, path)) == [(1,), (1,)]


def test_documents_differ_by_path(spark):
    old = {"b": {"x": [1, {"y": 2}], "gone": None}, "a": "t", "e": {}, "n": [[1, 2], [3]]}
    new = {"a": "t", "b": {"x": [1, {"y": 3}, 4]}, "e": {}, "n": [[1, 2], [4]], "more": {"deep": [True]}}
    df = lambda x: spark.createDataFrame([(1, json.dumps(x)), (2, "no json")], "id int, value string")
    got = {(r.path, r.change, r.old, r.new) for r in versions.differ(df(old), df(new)).collect()}
    assert got == {("b.x[1].y", "changed", "2", "3"), ("b.x[2]", "added", None, "4"), ("b.gone", "removed", "null", None), ("n[1][0]", "changed", "3", "4"), ("more.deep[0]", "added", None, "true")}
    again = json.dumps(dict(reversed(old.items())), indent=3)
    assert versions.differ(df(old), spark.createDataFrame([(1, again)], "id int, value string")).isEmpty()


def test_import_diff(spark):
    table = lambda d: spark.createDataFrame([(1, k, None if v is None else json.dumps(v)) for k, v in d.items()], "id int, field string, value string")
    old = {"types": {"a": {"l": [1, 2], "m": 1}, "b": 1}, "roots": ["a", "b"], "name": "n", "text": None}
    same = {"types": {"b": 1, "a": {"m": 1, "l": [1, 2]}}, "roots": ["a", "b"], "name": "n"}
    row = versions.import_diff(table(old), table(same), ["types"]).first()
    assert (row.changed, row.fields, row.added, row.removed) == (False, "", "", "")
    new = {"types": {"a": {"l": [2, 1], "m": 1}, "c": 1}, "roots": ["b", "a"], "name": "n"}
    row = versions.import_diff(table(old), table(new), ["types"]).first()
    assert (row.changed, row.fields, row.added, row.removed) == (True, "roots,types", "types.c", "types.b")


def fold(events):
    out, content, version, status, deleted = [], None, 0, None, False
    for action, text in events:
        known, outcome = content is not None, "none"
        if action == "import":
            if content == text:
                outcome = "no_changes"
            else:
                outcome = "created" if not known else "new_draft" if status == "published" else "updated"
                version += outcome != "updated"
                content, status = text, "draft"
        elif known and action == "new_version":
            outcome, version, status = action, version + 1, "draft"
        elif known and action == "publish" and status != "published":
            outcome = status = "published"
        elif known and action in ("delete", "restore"):
            outcome, deleted = f"{action}d", action == "delete"
        out.append((outcome, version, status, deleted))
    return out


def test_lifecycle_is_the_plain_fold(spark):
    r, rows, want = random.Random(8), [], {}
    for i in range(30):
        events = [(r.choice(["import", "import", "publish", "new_version", "delete", "restore"]), r.choice("xyz")) for _ in range(r.randrange(1, 15))]
        want[i] = fold(events)
        rows += [(i, n, a, json.dumps({"k": c, "j": 1} if r.random() < 0.5 else {"j": 1, "k": c})) for n, (a, c) in enumerate(events)]
    got = versions.lifecycle(spark.createDataFrame(rows, "id int, seq int, action string, content string")).orderBy("id", "seq").collect()
    assert {i: [(x.outcome, x.version, x.status, x.deleted) for x in got if x.id == i] for i in want} == want
