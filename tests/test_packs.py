"""Packs' faults, what methods see, hidden decisions, and the predicted gain."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewmint.operators import gates, packs


def test_hidden_fields_are_refused(spark):
    cells = spark.createDataFrame([("a", "p", 1, "x", 9)], "cell_id string, protocol string, n_points int, oracle_view string, other int")
    seen = packs.method_visible(cells)
    assert seen.columns == ["cell_id", "protocol", "n_points"]
    row = packs.method_visible(cells, {}).first()
    assert row["visibility_contract"].asDict() == {"protocol": "Protocol B", "leakage_rule": ""}
    with pytest.raises(ValueError, match="oracle_view"):
        packs.refuse_hidden(cells)


def test_odd_pack_rows(spark):
    manifest = [None, "", "[1]", "{}", '{"query_id": 1, "cell_id": "c"}', '{"query_id": "q", "cell_id": "c", "declared_views": ["v"]}', '{"query_id": "q", "cell_id": "c", "declared_views": [], "visible_features": {"x": [{"Label": 1}]}}', '{"query_id": "only", "cell_id": "c", "declared_views": {"v": 1}, "visible_features": null}']
    reference = ['{"query_id": "q", "cell_id": "c", "view_scores": {"v": 1, "w": 0.5, "t": true}}', '{"query_id": "x", "cell_id": "c"}', '{"query_id": "y", "cell_id": "c", "view_scores": {"v": "1"}}', '{"query_id": "z", "cell_id": "c", "view_scores": {"v": null}}', "{broken"]
    rows = lambda texts: spark.createDataFrame(list(enumerate(texts)), "line long, raw string")
    got = {(r["side"], r["line"], r["error"]) for r in packs.pack_faults(rows(manifest), rows(reference), ("label",)).collect()}
    keys, views = "query_id and cell_id must be strings", "declared_views must be a list that isn't empty"
    assert got == {
        ("manifest", 0, "not a JSON object"), ("manifest", 1, "not a JSON object"), ("manifest", 2, "not a JSON object"), ("manifest", 3, keys), ("manifest", 4, keys),
        ("manifest", 6, "key seen before: q, c"), ("manifest", 6, views), ("manifest", 6, "forbidden features: $.visible_features.x[0].Label"), ("manifest", 7, views),
        ("reference", 1, "view_scores must be an object that isn't empty"), ("reference", 2, "view_scores must be numbers"), ("reference", 3, "view_scores must be numbers"), ("reference", 4, "not a JSON object"),
        ("manifest", None, "1 manifest keys lack a reference row"), ("reference", None, "3 reference keys aren't in the manifest"),
    }
    assert packs.pack_faults(rows([]), rows([]), ("label",)).count() == 0


def test_disagreement_of_pairs(spark):
    cells = spark.createDataFrame([(1, "a", True, False, True, 1.0), (2, "a", True, True, False, 0.5), (3, "b", False, True, False, -1.0)], "key long, label string, topology boolean, geometry boolean, routing boolean, gain double")
    pairs = spark.createDataFrame([("r", 1, 2, 1), ("r", 1, 3, 2), ("r", 1, 9, 1), ("r", 2, 3, 6), ("s", 2, 3, 5)], "representation string, query long, neighbor long, rank int")
    got = {r["representation"]: tuple(r)[1:] for r in packs.pair_disagreement(cells, pairs).collect()}
    assert got == {"r": (2, 0.5, 1.0, 1.0, 1.25), "s": (1, 1.0, 0.0, 0.0, 1.5)}
    assert {r["label"]: r["topology"] for r in packs.label_shares(cells).collect()} == {"a": 1.0, "b": 0.0}


def test_gains_are_predicted_from_the_train_part(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(400, 2))
    rows = spark.createDataFrame([(i, float(a), float(b), float(a > 0) + 0.01 * float(b), 0.5) for i, (a, b) in enumerate(x)], "query_id long, a double, b double, u_rich double, u_cheap double")
    train, test = rows.where("query_id < 300"), rows.where("query_id >= 300")
    made = {r["query_id"]: r["view"] for r in gates.predicted_gain_gate(train, test, ["a", "b"], "rich", "cheap", 0.02).collect()}
    assert set(made) == set(range(300, 400)) and sum(made[i] == ("rich" if x[i, 0] > 0 else "cheap") for i in made) > 90
    blind = test.withColumns({"u_rich": F.lit(None).cast("double"), "u_cheap": F.lit(None).cast("double")})  # no answer to peek at
    assert {r["query_id"]: r["view"] for r in gates.predicted_gain_gate(train, blind, ["a", "b"], "rich", "cheap", 0.02).collect()} == made


def test_shuffled_folds_are_even(spark):
    from collections import Counter

    from viewmint.operators.splits import shuffled_folds

    for n in (0, 1, 3, 5, 23, 100):
        folds = Counter(r["fold"] for r in shuffled_folds(spark.range(n), "id", 5, 3).collect())
        assert [folds[i] for i in range(5)] == [n // 5 + (i < n % 5) for i in range(5)]
