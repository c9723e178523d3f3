"""Folds and neighbours that many tasks share, against plain versions."""

import hashlib
from collections import defaultdict

import time

import numpy as np

from contractscope.operators import forensics, panel
from contractscope.operators import rows as row_ops


def test_folds_go_round_each_stratum(spark):
    rows = [(i, None if i % 7 == 0 else "a" if i % 3 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, s string").repartition(5)
    got = {r.id: r.fold for r in panel.stratified_folds(df, ["s"], "id").collect()}
    by = defaultdict(list)
    for i, s in rows:
        by[s].append((hashlib.md5(f"2025|{i}".encode()).hexdigest(), i))
    want = {i: k % 4 for some in by.values() for k, (_, i) in enumerate(sorted(some))}
    assert got == want
    assert panel.stratified_folds(df.limit(0), ["s"], "id").count() == 0


def test_gower_neighbours_of_a_query_set(spark):
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 11 == 0 else float(rng.integers(0, 9)), float(rng.normal()), None if i % 5 == 0 else "xyz"[i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c string").repartition(3)
    span = [max(r[j] for r in rows if r[j] is not None) - min(r[j] for r in rows if r[j] is not None) for j in (1, 2)]
    asked = df.filter("id % 4 = 1")
    for block in (2000, 7):
        got = {}
        for r in forensics.gower_neighbours(df, "id", ["a", "b"], ["c"], 5, asked, block).collect():
            got.setdefault(r.id, []).append((r["rank"], r.other, r.distance))
        assert sorted(got) == [i for i in range(120) if i % 4 == 1]
        for i, found in got.items():
            d = lambda r: (sum(1.0 if x is None or y is None else abs(x - y) / s for x, y, s in zip(rows[i][1:3], r[1:3], span, strict=True)) + (rows[i][3] != r[3])) / 3  # noqa: B023, E731
            want = sorted((d(r), r[0]) for r in rows if r[0] != i)[:5]
            assert [o for _, o, _ in sorted(found)] == [o for _, o in want] and np.allclose([x for _, _, x in sorted(found)], [x for x, _ in want])
    assert forensics.gower_neighbours(df.limit(0), "id", ["a", "b"], ["c"]).count() == 0


def test_gower_neighbours_look_at_blocks_not_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 400)), "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a double, c string")
    began = time.perf_counter()
    got = forensics.gower_neighbours(df, "id", ["a"], ["c"], 5, per_block=1000).collect()
    assert time.perf_counter() - began < 30 and len(got) == 15000
    span = max(r[1] for r in rows) - min(r[1] for r in rows)
    a, c = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    for i in (0, 17, 2999):
        d = (np.abs(a / span - a[i] / span) + (c != c[i])) / 2
        want = [j for j in np.lexsort((np.arange(3000), d)) if j != i][:5]
        assert [r.other for r in sorted((r for r in got if r.id == i), key=lambda r: r["rank"])] == want


def test_red_flags_do_not_gather_a_category(spark):
    rows = [(i, "ab"[i % 2], i % 5, float(i % 30), float(i % 40), 0, "APERTA") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, g string, num_imprese_offerenti int, finestra_offerta_giorni double, ribasso_aggiudicazione double, flag_urgenza int, tipo_scelta_4cls string")
    made = forensics.red_flags(df, "g")
    assert "strategy=broadcast" in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.count() == 200


def test_award_rows_of_a_task_are_bounded(spark):
    awards = [(str(i % 50), str(i % 3), None, f"2020-01-{1 + i % 28:02d}") for i in range(300)]
    df = spark.createDataFrame(awards, "cig string, id_aggiudicazione string, cod_modo_riaggiudicazione string, data_aggiudicazione_definitiva string")
    targets = df.filter("cig < '3' AND id_aggiudicazione = '2'").select("cig", "id_aggiudicazione")
    many = row_ops.pick_award(df, targets, n_rows=100 * row_ops.ROWS_A_TASK)
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "cig#" in plan and ", 100" in plan.split("RepartitionByExpression")[1].split("\n")[0] and "strategy=merge" in plan
    assert sorted(many.collect()) == sorted(row_ops.pick_award(df, targets).collect())
