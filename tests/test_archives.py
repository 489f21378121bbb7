"""Archives as a data source, and the import chain on an export that Spark wrote."""

from __future__ import annotations

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from viewmint.sources import archives as A


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    """Prices of 5 series, one of them short, in archives written by Spark."""
    path = str(tmp_path_factory.mktemp("export") / "zips")
    rows = [("m/" + A.MANIFEST, 0, '{"status": "complete",'), ("m/" + A.MANIFEST, 1, ' "n": 2}'), ("m/" + A.AUDIT, 0, '{"status": "ok"}')]
    days = [f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}" for d in range(90)]
    price = lambda s, d: round(100 + 5 * s + (3 + 4 * s) * math.sin(d / (2 + s)) + 0.1 * d, 4)
    table = ['security,date,"field",value'] + [f'"S{s}, Inc",{days[d]},{f},"{p}"' for s in range(5) for d in range(20 if s == 4 else 90) for f, p in ((A.FIELD, price(s, d)), ("VOLUME", 5))]
    table += [f'"S0, Inc",{days[3]},{A.FIELD},1,', "broken", f',{days[0]},{A.FIELD},3', f'"S1, Inc",no day,{A.FIELD},3', f'"S1, Inc",{days[5]},{A.FIELD},-1', f'"S2, Inc",{days[7]},{A.FIELD},"1,001.5"']
    rows += [("data/" + A.LONG_TABLE, i, v) for i, v in enumerate(table)]
    spark.dataSource.register(A.ArchiveSource)
    written = spark.createDataFrame(rows, "member string, line long, value string").repartition(3, "member")
    written.write.format("archive").mode("append").save(path)
    return path, rows, {(s, days[d]): price(s, d) for s in range(5) for d in range(20 if s == 4 else 90)}


def test_what_was_written_is_read(spark, export):
    path, rows, _ = export
    got = A.members(spark, path)
    assert sorted((r["member"], r["line"], r["value"]) for r in got.collect()) == sorted(rows)
    assert got.rdd.getNumPartitions() == 3  # a member each
    assert {r["member"] for r in A.members(spark, path, A.AUDIT).collect()} == {"m/" + A.AUDIT}


def test_members_outside_are_refused_by_name(spark, tmp_path):
    for name in ("../out.txt", "/etc/out.txt", "a/../../out.txt"):
        with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
            z.writestr("fine.txt", "x")
            z.writestr(name, "x")
        with pytest.raises(Exception, match=name.replace(".", r"\.")):
            A.members(spark, str(tmp_path / "bad.zip")).collect()
    with pytest.raises(Exception, match="out.txt"):
        spark.createDataFrame([("../out.txt", 0, "x")], "member string, line long, value string").write.format("archive").mode("append").save(str(tmp_path / "w"))
    with pytest.raises(Exception, match="nowhere"):
        A.members(spark, str(tmp_path / "nowhere")).collect()


def test_import_chain(spark, export):
    path, _, prices = export
    made = A.import_export(spark, path, most_cells=10, size=32)
    assert made.manifest == {"status": "complete", "n": 2} and made.audit == {"status": "ok"}
    panel = {(r["security"], str(r["date"])): r["price"] for r in made.panel.collect()}
    want = {(f"S{s}, Inc", d): p for (s, d), p in prices.items()}
    days = sorted({d for _, d in prices})
    want["S0, Inc", days[3]] = 1.0  # the last line of a day wins
    want["S2, Inc", days[7]] = 1001.5
    assert panel == want
    public = {r["cell_id"]: r for r in made.public.collect()}
    hidden = {r["cell_id"]: r for r in made.hidden.collect()}
    assert set(public) == set(hidden) == {f"bbg_{k:03d}" for k in range(10)} and made.visibility["n_cells"] == 10
    assert not {"oracle_view", "source_security", "view_utilities"} & set(made.public.columns) and "oracle_view" in made.visibility["evaluator_only_fields"]
    assert {r["source_security"] for r in hidden.values()} <= {f"S{s}, Inc" for s in range(4)}  # the short series has no window
    for i, r in hidden.items():
        own = [p for (s, d), p in sorted(want.items()) if s == r["source_security"] and str(r["source_start"]) <= d <= str(r["source_end"])]
        assert len(own) == public[i]["n_points"] == 32
        fall = max((max(own[: k + 1]) - p) / max(own[: k + 1]) for k, p in enumerate(own))
        vol = math.sqrt(sum(math.log(b / a) ** 2 for a, b in zip(own, own[1:])) / 31)
        assert r["oracle_view"] == ("point" if fall >= 0.18 else "raster" if vol >= 0.018 else "occupancy" if vol >= 0.01 else "moments")
        assert r["view_utilities"][r["oracle_view"]] == 0.84 and len(r["view_utilities"]) == 5
        path_ = [math.log(p) - math.log(own[0]) for p in own]
        mean = sum(path_) / 32
        scale = math.sqrt(sum((c - mean) ** 2 for c in path_) / 32)
        y = [round(0.35 * (c - mean) / scale, 6) for c in path_]
        assert public[i]["summary"]["mean"][1] == pytest.approx(sum(y) / 32, abs=2e-6)
        assert public[i]["summary"]["covariance"][1][1] == pytest.approx(0.35**2, abs=1e-4)
    with pytest.raises(ValueError, match="500"):
        A.import_export(spark, path, size=500)


def test_an_export_without_its_manifest_is_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr(A.AUDIT, json.dumps({}))
    with pytest.raises(ValueError, match=A.MANIFEST):
        A.import_export(spark, str(tmp_path / "x.zip"))
    assert A.members(spark, str(tmp_path / "x.zip")).where(F.col("line") > 0).count() == 0
