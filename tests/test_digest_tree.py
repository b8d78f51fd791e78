"""Differing rows of two versions against a plain comparison, and what is read to find them."""

import random
from collections import Counter, defaultdict
from pathlib import Path

from quillstrata.sources.digest_tree import changed_rows, differing_branches, write_digest_tree

KIND = "k string, a string, branch bigint"


def plain(old, new):
    sides = [defaultdict(Counter), defaultdict(Counter)]
    for side, rows in zip(sides, (old, new)):
        for row in rows:
            side[row[0]][row] += 1
    out = set()
    for key in set(sides[0]) | set(sides[1]):
        a, b = sides[0][key], sides[1][key]
        if a != b:
            out.add((key, "added" if not a else "removed" if not b else "changed", a.total(), b.total()))
    return out


def compare(spark, folder, old, new):
    paths = [f"{folder}/old", f"{folder}/new"]
    for path, rows in zip(paths, (old, new)):
        write_digest_tree(spark.createDataFrame(rows, KIND), "k", path, branch_digits=1)
    return changed_rows(spark, *paths), paths


def test_changes_are_those_of_a_plain_comparison(spark, tmp_path):
    draw = random.Random(4)
    old = [(str(i), draw.choice(["x", "y", None, ""]), draw.randrange(3)) for i in range(500)] + [(None, "x", 1), ("", "x", 1), ("7", "again", 1)]
    new = [r if draw.random() < 0.97 else (r[0], "changed", r[2]) for r in old if draw.random() < 0.98]
    new += [("new", "x", 1), ("new", "x", 1), (None, "x", 1), old[3], old[3]]
    draw.shuffle(new)
    got, _ = compare(spark, tmp_path, old, new)
    assert {tuple(r) for r in got.collect()} == plain(old, new)


def test_only_differing_branches_are_read(spark, tmp_path):
    old = [(str(i), "x", i) for i in range(2000)]
    new = [r if r[0] != "77" else ("77", "y", 77) for r in old]
    got, paths = compare(spark, tmp_path, old, list(reversed(new)))
    assert [tuple(r) for r in got.collect()] == [("77", "changed", 1, 1)]
    (branch,) = differing_branches(spark, *paths)
    # Leaves of other branches can be unreadable.
    for path in paths:
        broken = [f for f in Path(path, "leaves").rglob("*.parquet") if f.parent.name != f"branch={branch}"]
        assert broken
        for f in broken:
            f.write_bytes(b"no parquet")
    assert [tuple(r) for r in changed_rows(spark, *paths).collect()] == [("77", "changed", 1, 1)]


def test_equal_and_empty_versions(spark, tmp_path):
    rows = [(str(i), "x", i) for i in range(50)]
    assert compare(spark, tmp_path / "a", rows, rows[::-1])[0].collect() == []
    assert compare(spark, tmp_path / "b", [], [])[0].collect() == []
    assert {r.change for r in compare(spark, tmp_path / "c", [], rows)[0].collect()} == {"added"}
