"""Functions for SQL that Spark has none of: a table function and an aggregate
in Python over Arrow, and solvers that users hand in as files."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.routes import forbidden_paths


class LeakPaths:
    """Table function ``leak_paths(text, keys)``: a row (path) for each of the
    keys, in normed form, at any depth of a JSON text; ``$`` for a text that
    isn't JSON; none for null."""

    def eval(self, text: str, keys: list[str]):
        if text is not None:
            for path in forbidden_paths(text, set(keys or [])):
                yield (path,)


def discordance(score: pa.Array, truth: pa.Array) -> float | None:
    """Share of the pairs with two scores and two truths that order otherwise by
    one than by the other; null if there is no such pair.  Rows with a null in
    either are left out."""
    s, t = (np.array(a.to_pylist(), dtype=float) for a in (score, truth))
    known = ~(np.isnan(s) | np.isnan(t))
    s, t = s[known], t[known]
    # in the order of truths, a pair is discordant where a later score is lower
    order = np.lexsort((s, t))
    s, t = s[order], t[order]
    pairs = bad = 0
    for i in range(len(s) - 1):  # a group at a time, row against rows: no square of it is held
        apart = (t[i + 1 :] != t[i]) & (s[i + 1 :] != s[i])
        pairs += int(apart.sum())
        bad += int((apart & (s[i + 1 :] < s[i])).sum())
    return bad / pairs if pairs else None


def register(spark: SparkSession) -> None:
    """Makes ``leak_paths`` and ``discordance`` known to the session's SQL.

    ``discordance(score, truth)`` gets a group whole in one task: group by what
    is bounded, like the candidates of a query.
    """
    from pyspark.sql.functions import arrow_udf, udtf

    def over_arrow(score: pa.Array, truth: pa.Array) -> float:
        return discordance(score, truth)

    over_arrow.__annotations__ = {"score": pa.Array, "truth": pa.Array, "return": float}
    spark.udtf.register("leak_paths", udtf(LeakPaths, returnType="path string"))
    spark.udf.register("discordance", arrow_udf(over_arrow, "double"))


def load_solver(path: str) -> Callable[[dict], dict]:
    """``solve`` of a Python file, which must define it as a function of a cell."""
    with open(path, encoding="utf-8") as f:
        return _solver(f.read(), path)


def _solver(source: str, path: str) -> Callable[[dict], dict]:
    space: dict = {"__name__": "solver", "__file__": path}
    exec(compile(source, path, "exec"), space)
    if not callable(space.get("solve")):
        raise ValueError(f"{path} doesn't define solve(cell)")
    return space["solve"]


def solved(cells: DataFrame, path: str) -> DataFrame:
    """(cell_id, answer, runtime_s, error): a user's solver on every cell.

    ``cells`` has (cell_id, cell), the cell as JSON text.  The file at ``path``
    is read by the driver, checked, and sent along as text, so that executors
    need not see it.  An answer is the JSON of the solver's dict, its
    ``cell_id`` that of the cell unless the solver sets one.  What a solver
    raises, and an answer that is no dict, is the ``error`` of that cell alone.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    _solver(source, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solve = _solver(source, path)
        for batch in batches:
            answers, seconds, errors = [], [], []
            for i, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                began, answer, error = time.perf_counter(), None, None
                try:
                    got = solve(json.loads(cell))
                    if not isinstance(got, dict):
                        raise TypeError("the answer is no dict")
                    answer = json.dumps({"cell_id": i} | got)
                except Exception as e:  # noqa: BLE001  a user's code: its fault is the cell's result
                    error = f"{type(e).__name__}: {e}"
                answers.append(answer)
                seconds.append(time.perf_counter() - began)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), pa.array(seconds, pa.float64()), pa.array(errors, pa.string())], ["cell_id", "answer", "runtime_s", "error"])

    kind = cells.schema["cell_id"].dataType.simpleString()
    return cells.select("cell_id", F.col("cell").cast("string")).mapInArrow(run, f"cell_id {kind}, answer string, runtime_s double, error string")
