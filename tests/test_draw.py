"""The draw against one plain pass in order."""

import hashlib
import random

import pytest

from corpusmill.operators import draw as D
from corpusmill.plans import corpus as P
from corpusmill.plans.registry import QUERIES

SCHEMA = "id long, repo string, fam string, boilerplate boolean, stub boolean, band int, reserved boolean, pile int"


def plain(rows, targets, val_targets, repo_cap, family_cap, stub_share):
    """id -> (phase, status): phase after phase, each row against counters that only taken rows advance."""
    key = lambda r: (hashlib.md5(f"draw|{r[0]}".encode()).hexdigest(), r[0])
    repos, fams, used, out = {}, {}, set(), {}
    stub_cap = {"validation": int(sum(val_targets.values()) * stub_share), "train": int(sum(targets.values()) * stub_share)}
    stubs, got = {"validation": 0, "train": 0}, {}

    def offer(r, phase, split, target):
        id_, repo, fam, boiler, stub, band, *_ = r
        if target is not None and got.get((split, band), 0) >= target.get(band, 0):
            out[id_] = (phase, "reserved" if split == "validation" else "not_drawn")
        elif repos.get(repo, 0) >= repo_cap:
            out[id_] = (phase, "cap_repo")
        elif boiler and (fams.get(fam, 0) >= family_cap or (fam, repo) in used):
            out[id_] = (phase, "cap_family")
        elif stub and stubs[split] >= stub_cap[split]:
            out[id_] = (phase, "cap_stub")
        else:
            out[id_] = (phase, split)
            repos[repo] = repos.get(repo, 0) + 1
            got[split, band] = got.get((split, band), 0) + 1
            stubs[split] += bool(stub)
            if boiler:
                fams[fam] = fams.get(fam, 0) + 1
                used.add((fam, repo))

    for r in sorted((r for r in rows if r[6] and r[7] != 0), key=key):
        offer(r, 0, "validation", val_targets)
    for r in rows:
        if r[6] and r[7] == 0:
            out[r[0]] = (-1, "reserved")
    for r in sorted((r for r in rows if not r[6] and r[7] == 0), key=key):
        offer(r, 1, "train", None)
    for band in range(5):
        for r in sorted((r for r in rows if not r[6] and r[7] != 0 and r[5] == band), key=key):
            offer(r, 2 + band, "train", targets)
    return out


def made_up(n, seed):
    rng = random.Random(seed)
    hot = lambda k: f"{0 if rng.random() < 0.3 else rng.randrange(k)}"
    return [(i, f"r{hot(40)}", f"f{hot(30)}", rng.random() < 0.5, rng.random() < 0.3, rng.randrange(5), rng.random() < 0.2, rng.randrange(3)) for i in range(n)]


ARGS = ({0: 60, 1: 50, 2: 40, 3: 5, 4: 0}, {0: 5, 1: 5, 2: 9}, 25, 6, 0.1)


@pytest.mark.parametrize("more", [{}, {"few": 0, "stretch": 64}, {"few": 40, "stretch": 10_000}])
def test_the_draw_is_the_plain_pass(spark, more):
    rows = made_up(900, 3)
    want = plain(rows, *ARGS)
    assert {"validation", "train", "reserved", "not_drawn", "cap_repo", "cap_family", "cap_stub"} == {s for _, s in want.values()}
    out = D.draw(spark, spark.createDataFrame(rows, SCHEMA).repartition(5), *ARGS, **more)
    assert {r.id: (r.phase, r.status) for r in out.collect()} == want and out.count() == len(rows)


def test_phases_come_one_after_the_other(spark):
    """A family with room for one: validation comes before train, the first pile before the bands, whatever the hash order."""
    rows = [(i, f"r{i}", "f", True, False, 1, i == 7, 0 if i == 3 else 1) for i in range(10)]
    for cap, taken in ((1, {7: "validation"}), (2, {7: "validation", 3: "train"})):
        got = {r.id: r.status for r in D.draw(spark, spark.createDataFrame(rows, SCHEMA), {1: 50}, {1: 50}, 9, cap, 1.0).collect()}
        assert {i: s for i, s in got.items() if s in ("validation", "train")} == taken


def test_whole_table(spark, sf):
    rows = [tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in P.drawn(spark, sf).collect()]
    want = plain(rows, P.TARGETS, P.VAL_TARGETS, 40, 20, 0.2)
    assert {r.doc_id: (r.phase, r.status) for r in QUERIES["draw_exact"](spark, sf).collect()} == want


def test_nulls_and_no_rows(spark):
    rows = [(1, None, None, None, None, 1, None, None), (2, None, None, True, True, None, False, 0), (2, "r", "f", True, True, 1, True, 1)]
    out = sorted((r.id, r.phase, r.status) for r in D.draw(spark, spark.createDataFrame(rows, SCHEMA), {1: 5}, {1: 5}, 9, 9, 1.0).collect())
    assert out == [(1, 3, "train"), (2, 0, "validation"), (2, 1, "train")]
    assert D.draw(spark, spark.createDataFrame([], SCHEMA), {1: 5}, {}, 9, 9, 1.0).count() == 0
