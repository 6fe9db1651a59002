"""Views of events: policies worked out by hand, the joined distance and the models against plain numpy."""

import numpy as np
import pytest

from tracewell.operators import attributes, conditional, views
from tracewell.sources.audit import Audit

SF = "/root/testdata/sf0.001"


def test_policies_of_three_nodes(spark):
    rows = [(1, "process", ["exe_vim", "dir_bin", "flag_n"]), (2, "file", ["root_etc", "path_hosts"]), (3, "netflow", ["public", "system"]), (4, "file", ["path_na"])]
    found = {n: {r.node_id: r.tokens for r in w.collect()} for n, w in views.policies(spark.createDataFrame(rows, "node_id long, kind string, tokens array<string>")).items()}
    assert found["whole"] == {i: t for i, _, t in rows}
    assert found["place"] == {1: ["process", "dir_bin"], 2: ["file", "root_etc"], 3: ["netflow", "public"], 4: ["file"]}
    assert found["thing"] == {1: ["process", "exe_vim"], 2: ["file", "path_hosts"], 3: ["netflow", "system"], 4: ["file", "path_na"]}


def plain_fusion(x, reference, most=20.0, weight=1e-3):
    median = np.median(np.round(reference, 6), axis=0)
    mad = np.median(np.abs(np.round(reference, 6) - median), axis=0) + 1e-6
    z, r = (np.clip((v - median) / (1.4826 * mad), 0, most) for v in (x, reference))
    center, scale = r.mean(axis=0), np.sqrt(np.maximum(r.var(axis=0), 1e-12))
    inverse = np.linalg.pinv(np.cov(r, rowvar=False, bias=True) / np.outer(scale, scale) + weight * np.eye(x.shape[1]))
    d = (z - center) / scale
    return d * (d @ inverse)


def test_parts_add_up_to_the_squared_distance(spark):
    rng = np.random.default_rng(4)
    columns = ["a", "b", "c"]
    reference, x = rng.gamma(2, size=(301, 3)), np.vstack((rng.gamma(2, size=(40, 3)), [[90.0, 1.0, 1.0], [1.0, 1.0, 70.0]]))
    reference[:, 2] = reference[:, 0] + reference[:, 2] / 4
    table = lambda v: spark.createDataFrame([("h", i, *map(float, r)) for i, r in enumerate(v)], "host string, event_id long, a double, b double, c double")
    got = {r.event_id: r for r in views.fused(table(x), columns, table(reference)).collect()}
    want = plain_fusion(x, reference)
    for i, parts in enumerate(want):
        assert got[i].parts == pytest.approx(parts, rel=1e-6, abs=1e-6)
        assert sum(got[i].parts) == pytest.approx(got[i].distance ** 2, rel=1e-6, abs=1e-9)
        assert got[i].score == pytest.approx(min(20.0, np.maximum(parts, 0).mean()), rel=1e-6, abs=1e-6)
    assert (got[40].top, got[41].top) == ("a", "c")
    assert views.fused(table(x), columns, table(reference[:0])).count() == len(x)
    assert views.fused(table(x[:0]), columns, table(reference)).count() == 0


def test_each_view_has_a_model_of_its_own(spark):
    a = Audit.of(spark, SF)
    placed = a.placed.persist()
    words = views.policies(attributes.summaries(a.nodes).persist())
    model = views.MultiView.fit(placed, {n: words[n] for n in ("place", "thing")}, rank=64)
    assert model.columns == ["place_error", "place_cosine", "thing_error", "thing_cosine"]
    got = {(r.host, r.event_id): r for r in model.components(placed).collect()}
    assert len(got) == placed.count()
    weights = []
    for name, view in model.views.items():
        rows = conditional.replayed(placed, view.node_vectors, view.actions).toPandas()
        x, y, train = np.stack(rows["x"]), np.stack(rows["y"]), (rows["split"] == "train").to_numpy()
        w = np.linalg.solve(x[train].T @ x[train] + np.eye(x.shape[1]), x[train].T @ y[train])
        assert np.abs(view.weights - w).max() < 1e-6
        p = x @ w
        cosine = 1 - (p * y).sum(1) / np.maximum(np.linalg.norm(p, axis=1) * np.linalg.norm(y, axis=1), 1e-8)
        for h, e, error, c in zip(rows["host"], rows["event_id"], ((p - y) ** 2).mean(1), cosine):
            assert (got[h, e][f"{name}_error"], got[h, e][f"{name}_cosine"]) == pytest.approx((error, c), rel=1e-5, abs=1e-8)
        weights.append(w)
    assert np.abs(weights[0] - weights[1]).max() > 1e-3
