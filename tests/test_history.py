"""Claim history, link groups, names spelt alike, alarms, calibration, gates: against plain Python."""
import math
import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tallyfolio.operators import history as H, linking as L, monitoring as M

START = datetime(2024, 1, 1)


def at(minutes):
    return START + timedelta(minutes=minutes)


# ------------------------------------------------------------------ history

def changes(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        job = "hot" if rng.random() < 0.6 else f"j{rng.randint(0, 8)}"
        status = (rng.choice(["A", "B", None]),) if rng.random() < 0.6 else None
        error = (rng.choice(["x", None]),) if rng.random() < 0.3 else None
        rows.append((job, at(rng.randint(0, 300)), i, status, error))
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, seq int, status struct<v string>, error struct<v string>")
    return rows, df.repartition(5)


def test_as_of_answers_every_moment(spark):
    rows, df = changes(spark)
    rng = random.Random(4)
    asked = [(rng.choice(["hot", "j1", "j2", "nobody"]), at(rng.randint(-10, 310)), i) for i in range(300)]
    asked += [("hot", at(5), 300), ("hot", at(5), 300)]
    q = spark.createDataFrame(asked, "job_id string, moment timestamp, qid int")
    got = sorted((r.job_id, r.moment, r.qid, r.status, r.error) for r in H.as_of(df, q, ["status", "error"]).select(
        "job_id", "moment", "qid", F.coalesce("status", F.lit("-")).alias("status"), F.coalesce("error", F.lit("-")).alias("error")).collect())
    want = []
    for job, moment, qid in asked:
        state = {}
        for j, ts, seq, status, error in sorted(rows, key=lambda r: (r[1], r[2])):
            if j == job and ts <= moment:
                state.update({k: v[0] for k, v in (("status", status), ("error", error)) if v is not None})
        want.append((job, moment, qid, state.get("status") or "-", state.get("error") or "-"))
    assert got == sorted(want)


def test_validity_intervals(spark):
    rows, df = changes(spark, seed=3)
    got = sorted((r.job_id, r.valid_from, r.value or "-", r.valid_to or START + timedelta(days=99)) for r in H.validity(df, "status").collect())
    want = []
    for job in {r[0] for r in rows}:
        last = {}
        for _, ts, seq, status, _ in sorted((r for r in rows if r[0] == job), key=lambda r: (r[1], r[2])):
            if status is not None:
                last[ts] = status[0]
        runs = []
        for ts, v in sorted(last.items()):
            if not runs or runs[-1][1] != v:
                runs.append((ts, v))
        ends = [ts for ts, _ in runs[1:]] + [START + timedelta(days=99)]
        want += [(job, ts, v or "-", end) for (ts, v), end in zip(runs, ends)]
    assert got == sorted(want)


# ------------------------------------------------------------------ groups and names

def union_find(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_link_groups_equal_union_find(spark, seed):
    rng = random.Random(seed)
    docs = [(i, None if rng.random() < 0.3 else f"o{rng.randint(0, 60)}", None if rng.random() < 0.4 else f"c{rng.randint(0, 60)}",
             "all" if i % 3 == 0 else None) for i in range(150)]
    df = spark.createDataFrame(docs, "doc_id int, po string, claim string, party string").repartition(4)
    shared = {}
    for i, *keys in docs:
        for k, v in enumerate(keys):
            if v is not None:
                shared.setdefault((k, v), []).append(i)
    root = union_find(range(150), [(a, b) for members in shared.values() for a, b in zip(members, members[1:])])
    size = {r: list(root.values()).count(r) for r in root.values()}
    links = {i: sum(len(m) - 1 for m in shared.values() if i in m) for i in range(150)}
    got = {(r.doc_id, r.group_id, r.n_docs, r.n_links) for r in L.link_groups(df, ["po", "claim", "party"]).collect()}
    assert got == {(i, root[i], size[root[i]], links[i]) for i in range(150)}


def test_a_chain_is_one_group(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a int, b int").repartition(5)
    assert {(r.node, r.root) for r in L.groups(edges).collect()} == {(i, 0) for i in range(201)}
    assert L.groups(edges.limit(0)).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def allowed(n):
    return 0 if n < L.LEAST else 1 if n < L.LONG else 2


def test_names_alike_equal_all_pairs(spark):
    rng = random.Random(5)
    base = ["northern trading", "southern trading", "acme", "acme 12", "acme 13", "harbour lights", "blue", "green hill farms", "aaaaaa", "ab"]
    names = set(base)
    for n in base * 12:
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(n))
            n = rng.choice([n[:i] + n[i + 1:], n[:i] + rng.choice("abcdefgh 1") + n[i:], n[:i] + rng.choice("abcdefgh") + n[i + 1:]])
        names.add(n)
    names = sorted(n for n in names if n)
    want = {(a, b) for a, b in combinations(names, 2) if [c for c in a if c.isdigit()] == [c for c in b if c.isdigit()]
            and min(len(a), len(b)) >= L.LEAST and distance(a, b) <= allowed(min(len(a), len(b)))}
    got = {(r.one, r.two) for r in L.alike(spark.createDataFrame([(n,) for n in names], "party_key string")).collect()}
    assert got == want and len(want) > 50


def test_misspelt_names_are_joined(spark):
    rng = random.Random(6)
    words = "northern quarry harbour granite willow copper falcon meridian juniper cascade".split()
    kinds = "trading logistics farms studios foundry".split()
    parties = [f"{a} {b}" for a in words for b in kinds]
    rows = []
    for p in parties:
        rows.append((p.title() + " Ltd", p))
        for _ in range(3):
            i = rng.randrange(1, len(p))
            rows.append((p[:i] + p[i + 1:] if rng.random() < 0.5 else p[:i] + rng.choice("aeiou") + p[i:], p))
    truth = dict(rows)
    got = {r.name: r.canonical for r in L.resolve_alike(spark.createDataFrame(rows, "name string, party string")).collect()}
    names = sorted(got)
    pairs = {(a, b) for a, b in combinations(names, 2) if got[a] == got[b]}
    right = {(a, b) for a, b in combinations(names, 2) if truth[a] == truth[b]}
    assert len(pairs & right) >= 0.99 * len(right) and len(pairs & right) >= 0.99 * len(pairs)


# ------------------------------------------------------------------ monitoring

def test_a_planted_shift_sounds_and_a_stable_vendor_is_silent(spark):
    rng = random.Random(7)
    rows = [(v, t, 100, sum(rng.random() < (0.25 if v == "bad" and t >= 30 else 0.05) for _ in range(100))) for v in ("bad", "good", "fine") for t in range(50)]
    got = M.alarms(spark.createDataFrame(rows, "vendor string, week int, n int, hits int"), "vendor", "week", "n", "hits", 0.02, 10.0).collect()
    first = min(r.week for r in got if r.vendor == "bad" and r.alarm)
    assert 30 <= first <= 32 and not any(r.alarm for r in got if r.vendor != "bad")
    by = {(r.vendor, r.week): r.score for r in got}
    assert all(by[v, t] >= 0 for v, t in by)


def test_stability(spark):
    rows = [(v, i % 10 if v == "same" or i < 500 else i % 3, i >= 500) for v in ("same", "moved") for i in range(1000)]
    got = {r.vendor: r.psi for r in M.stability(spark.createDataFrame(rows, "vendor string, b int, now boolean"), "vendor", F.col("b"), F.col("now")).collect()}
    assert got["same"] < 0.01 < 0.25 < got["moved"]


def test_calibration_is_the_isotonic_fit(spark):
    rng = random.Random(8)
    points = [(c, rng.randint(1, 9), round(rng.random() * 5, 2)) for c in range(0, 101, 3)]
    df = spark.createDataFrame([(c, n, f"{t:.4f}") for c, n, t in points], "conf bigint, n bigint, t string").withColumn("points", F.col("t").cast("decimal(20,4)"))
    got = [r.fitted for r in M.calibrated(df, "conf", "n", "points").orderBy("conf").collect()]
    blocks = []
    for _, n, t in points:
        blocks.append([t, n, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            t, n, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t, blocks[-1][1] + n, blocks[-1][2] + k]
    want = [t / n for t, n, k in blocks for _ in range(k)]
    assert got == pytest.approx(want) and got == sorted(got)


def test_bootstrap_gate_covers_and_repeats(spark):
    rng = random.Random(9)
    rows = [(f"c{c}", i, 0.8 + (rng.random() - 0.5) * 0.4) for c in range(20) for i in range(200)]
    runs = spark.createDataFrame(rows, "config string, doc int, overall double").repartition(6)
    reps = M.replicated(runs, "config", "doc", {"overall": F.round("overall", 4)})
    gate = M.sure_gate(reps, "config", {"overall": 0.8}).collect()
    again = M.sure_gate(M.replicated(runs.repartition(3), "config", "doc", {"overall": F.round("overall", 4)}), "config", {"overall": 0.8}).collect()
    assert sorted(map(tuple, gate)) == sorted(map(tuple, again))
    # The true mean lies above the lower end in about 95 of 100 cases, and the end is near the mean.
    assert sum(r.overall_low < 0.8 for r in gate) >= 16 and all(0.77 < r.overall_low < 0.82 for r in gate)
    weights = spark.range(20000).select(M.weight(F.col("id"), F.lit(3)).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 20000 for r in weights}
    assert abs(share[0] - math.exp(-1)) < 0.02 and abs(share[1] - math.exp(-1)) < 0.02 and abs(share[2] - math.exp(-1) / 2) < 0.02


def test_bootstrap_weights_are_worked_out_once(spark):
    """One digest per row and replicate in the plan; a filter on the weight would repeat it."""
    runs = spark.createDataFrame([("a", "d1", 0.5), ("a", "d2", 1.0)], "config string, doc string, overall double")
    plan = M.replicated(runs, "config", "doc", {"overall": F.col("overall")})._jdf.queryExecution().optimizedPlan()
    lines = [x for x in plan.toString().split("\n") if "md5(" in x]
    assert len(lines) == 1 and "Filter" not in lines[0]
