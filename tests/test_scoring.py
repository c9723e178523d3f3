"""Scoring of uploads by signature: one fit each, ranks against all reference rows."""

import numpy as np
from pyspark.sql import functions as F

from contractscope.operators import boost, scoring
from contractscope.sources import tables

REGISTRY = {1: ["a", "kind"], 2: ["b"]}
OPTIONS = {"rounds": 25, "rate": 0.1, "patience": 10}


def reference(spark, n=700):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, n)
    rows = [(i, int(y[i]) if rng.random() < 0.5 else None, float(rng.normal() + y[i]), "xyz"[int(rng.integers(0, 3))], float(rng.normal() - y[i])) for i in range(n)]
    whole = spark.createDataFrame(rows, "_id long, label int, a double, kind string, b double")
    return {1: whole.drop("b"), 2: whole}, rows


def test_signatures_and_stages(spark):
    df = spark.createDataFrame([(1, 0.5, None, None), (2, None, "x", 1.0), (3, None, None, None)], "k int, a double, kind string, b double")
    assert {r.k: (r.stage, r.signature) for r in scoring.with_signature(df, REGISTRY).collect()} == {1: (1, "100"), 2: (2, "011"), 3: (1, "000")}
    assert [scoring.u_size(n, 0.02) for n in (1, 500, 10**6)] == [3000, 25_000, 50_000]


def test_csv_in_rank_and_band_out(spark, tmp_path, monkeypatch):
    (tmp_path / "up.csv").write_text("n;a;kind;b\n1;0,5;x;\n2;0.5;x;\n2;0.5;x;\n3;;new;-2\n4;1.5;;\n5;;;\n6;9;z;-9\n")
    uploads = tables.read_text_csv(spark, str(tmp_path / "up.csv")).drop("_source_file")
    tables_, rows = reference(spark)
    fits = []
    whole = scoring.fit_signatures
    monkeypatch.setattr(scoring, "fit_signatures", lambda *a, **k: fits.append(whole(*a, **k)) or fits[-1])
    got = scoring.score_uploads(uploads, "n", tables_, REGISTRY, ["kind"], prior=0.5, **OPTIONS).collect()
    assert sorted(r.n for r in got) == ["1", "2", "2", "3", "4", "5", "6"]
    by = {r.n: r for r in got}
    assert {k: (r.stage, r.signature) for k, r in by.items()} == {"1": (1, "010"), "2": (1, "110"), "3": (2, "011"), "4": (1, "100"), "5": (1, "000"), "6": (2, "111")}
    models = {r.signature: r.model for r in fits[0].collect()}
    assert len(fits) == 1 and sorted(models) == ["000", "010", "011", "100", "110", "111"]  # one fit for each signature
    code = {"x": 0.0, "y": 1.0, "z": 2.0, "new": np.nan}
    whole_x = np.array([(a, code[k], b) for _, _, a, k, b in rows])
    asked = {"1": (np.nan, 0.0, np.nan), "2": (0.5, 0.0, np.nan), "3": (np.nan, np.nan, -2.0), "4": (1.5, np.nan, np.nan), "6": (9.0, 2.0, -9.0)}
    for k, x in asked.items():
        used = [i for i, b in enumerate(by[k].signature) if b == "1"]
        trees = boost.Trees.of(models[by[k].signature])
        mine, others = trees.raw(np.array([x])[:, used])[0], trees.raw(whole_x[:, used])
        assert abs(by[k].score - 1 / (1 + np.exp(-mine))) < 1e-12
        assert abs(by[k].rank_pct - 100 * (others < mine - 1e-12).mean()) < 1e-9
    assert by["5"].rank_pct == 0.0 and by["6"].rank_pct > 60
    assert all(r.band == ("low" if r.rank_pct < 20 else "medium" if r.rank_pct < 50 else "high" if r.rank_pct < 80 else "very high") for r in got)


def test_blocks_and_resampled_ranks(spark):
    tables_, rows = reference(spark)
    uploads = spark.createDataFrame([(i, a, k, b if i % 2 else None) for i, _, a, k, b in rows[:60]], "n long, a double, kind string, b double")
    one = {r.n: r for r in scoring.score_uploads(uploads, "n", tables_, REGISTRY, ["kind"], prior=0.5, boot=5, **OPTIONS).collect()}
    two = {r.n: r for r in scoring.score_uploads(uploads, "n", tables_, REGISTRY, ["kind"], prior=0.5, boot=5, per_block=40, **OPTIONS).collect()}
    assert one == two and len(one) == 60
    assert all(r.rank_low <= r.rank_high for r in one.values())
    assert scoring.score_uploads(uploads.limit(0), "n", tables_, REGISTRY, ["kind"], prior=0.5, **OPTIONS).count() == 0
    assert scoring.score_uploads(uploads.withColumn("b", F.lit(None).cast("double")), "n", tables_, REGISTRY, ["kind"], prior=0.5, **OPTIONS).select("stage").distinct().collect()[0][0] == 1


def test_rows_are_not_scored_tree_by_tree(monkeypatch):
    """A reference row's score is looked up, so its cost does not grow with the rounds of a model."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 3))
    model = boost.fit_one("nnpu", x[:, :2], np.where(rng.random(400) < 0.5, (x[:, 0] > 0).astype(float), np.nan), 1.0, 0.5, 3, rounds=20)
    want = 1 / (1 + np.exp(-model.raw(x[:, :2])))
    monkeypatch.setattr(boost, "tree_values", None)
    score = scoring._scorer({(1, "110"): {0: model.text()}})
    assert score(1, "110", 0, x).tolist() == want.tolist()


def test_copies_add_no_pass_over_the_reference(spark, monkeypatch):
    """Blocks are filled by distinct scores, so uploads that score alike are asked for once."""
    tables_, rows = reference(spark)
    uploads = spark.createDataFrame([(i, rows[i % 10][2], rows[i % 10][3], None) for i in range(200)], "n long, a double, kind string, b double")
    passes = []
    whole = scoring.encoded
    monkeypatch.setattr(scoring, "encoded", lambda df, *a: passes.append(df.columns) or whole(df, *a))
    got = scoring.score_uploads(uploads, "n", tables_, REGISTRY, ["kind"], prior=0.5, per_block=40, **OPTIONS).collect()
    assert sum(c == tables_[1].columns for c in passes) == 2  # for the fits and for one block
    assert len(got) == 200 and len({(r.n % 10, r.rank_pct) for r in got}) == 10
