"""Reports: JSON summaries of runs flattened to rows, and tables joined of them.

A report is a row (name, raw) with ``raw`` its JSON text; fields are read in the
JVM by path, and a field that isn't there is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(path: str, kind: str = "string") -> Column:
    got = F.get_json_object("raw", f"$.{path}")
    return got if kind == "string" else got.try_cast(kind)


def headline(reports: DataFrame) -> DataFrame:
    """A row of headline figures a report."""
    number = lambda p: field(p, "double")
    return reports.select(
        "name", F.coalesce(field("cost_profile"), F.lit("C_op")).alias("cost_profile"), number("lambda").alias("lambda"),
        field("best_fixed.name").alias("best_fixed"), number("best_fixed.utility").alias("best_fixed_utility"),
        field("best_restricted_pipeline.name").alias("best_restricted"), number("best_restricted_pipeline.utility").alias("best_restricted_utility"),
        field("best_joint_learner.name").alias("best_learner"), number("best_joint_learner.utility").alias("best_learner_utility"),
        number("joint_oracle.utility").alias("oracle_utility"), number("repeated_602020.best_learned_minus_best_fixed_mean").alias("repeat_delta"),
        number("repeated_602020.positive_split_share").alias("positive_share"),
    )


def repeats(reports: DataFrame) -> DataFrame:
    """(name, repeats, delta, lo, hi, positive_share), under whichever of the
    keys in use a report has them."""
    first = lambda paths, kind: F.coalesce(*[field(p, kind) for p in paths])
    roots = ("repeat_summary", "repeated_602020", "repeats")
    mean = ("learned_minus_best_fixed_mean", "best_learned_minus_best_fixed_mean", "delta_mean")
    ends = ("ci95", "best_learned_minus_best_fixed_ci", "ci")
    at = lambda keys, tail="": [f"{r}.{k}{tail}" for r in roots for k in keys]
    return reports.select(
        "name", first(at(("n_repeats", "n_splits", "n")), "int").alias("repeats"), first(at(mean), "double").alias("delta"),
        first(at(ends, "[0]"), "double").alias("lo"), first(at(ends, "[1]"), "double").alias("hi"), first(at(("positive_share", "positive_split_share")), "double").alias("positive_share"),
    )


#: Parts of a learner's name and the family they stand for, in order.
FAMILIES = (("boost", "boosting"), ("gbdt", "boosting"), ("forest", "forest"), ("tree", "tree"), ("ridge", "linear"), ("logistic", "linear"), ("mlp", "neural"), ("fixed", "fixed"), ("oracle", "oracle"))


def learner_rows(rows: DataFrame) -> DataFrame:
    """(report, learner, family, utility, ci, choices) of learner entries
    (report, place, learner, utility, lo, hi, shares map): the first entry of a
    learner in a report counts; intervals and shares are written out."""
    name = F.lower("learner")
    family = reduce(lambda acc, f: F.when(F.contains(name, F.lit(f[0])), f[1]).otherwise(acc), reversed(FAMILIES), F.lit("other"))
    first = rows.groupBy("report", "learner").agg(F.min_by(F.struct("utility", "lo", "hi", "shares"), "place").alias("r"))
    shown = lambda c: F.format_string("%.4f", c)
    ci = F.when(F.col("r.lo").isNotNull() & F.col("r.hi").isNotNull(), F.concat(F.lit("["), shown("r.lo"), F.lit(", "), shown("r.hi"), F.lit("]"))).otherwise("")
    # highest share first, then by name
    by = F.array_sort(F.transform(F.map_entries("r.shares"), lambda e: F.struct((-e["value"]).alias("s"), e["key"].alias("k"))))
    choices = F.array_join(F.transform(F.filter(by, lambda e: e["s"] < 0), lambda e: F.concat(e["k"], F.lit(" "), F.format_string("%.1f%%", -e["s"] * 100))), "; ")
    return first.select("report", "learner", family.alias("family"), F.round("r.utility", 6).alias("utility"), ci.alias("ci"), F.coalesce(choices, F.lit("")).alias("choices"))


def cost_smoke(profile: DataFrame, sample: int = 3) -> DataFrame:
    """(task, dataset, rows, views): a systems profile in brief; ``views`` are
    its first rows with their costs, as JSON."""
    view = "array<struct<view:string,C_op:double,C_mem:double,C_lat:double,p95_us:double,bytes_touched:bigint>>"
    rows = F.from_json(F.get_json_object("raw", "$.rows"), view)
    return profile.select(
        "name", field("task").alias("task"), field("dataset").alias("dataset"), F.coalesce(F.size(rows), F.lit(0)).alias("rows"), F.to_json(F.slice(rows, 1, sample)).alias("views")
    )


def joined_families(parts: dict[str, DataFrame | None], keys: list[str], value: str) -> DataFrame:
    """(keys, family, value, delta): rows of the families whose keys all
    available ones have, with the difference to the first.  Families that are
    missing (None) are left out."""
    there = {n: d.select(*keys, F.col(value).alias(n)) for n, d in parts.items() if d is not None}
    if not there:
        raise ValueError("no family is there")
    names = list(there)
    wide = reduce(lambda a, b: a.join(b, keys), there.values())
    cells = F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias(value), F.round(F.col(n) - F.col(names[0]), 8).alias("delta")) for n in names])
    return wide.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")


def claim_checks(rows: DataFrame, expected: int, method: str, score: str, baseline: str, metrics: list[str]) -> DataFrame:
    """(check, passed): the number of rows, no missing figure, and the named
    baseline first by mean score."""
    finite = F.lit(True)
    for m in metrics:
        finite = finite & F.col(m).isNotNull() & ~F.isnan(F.col(m).cast("double"))
    whole = rows.agg((F.count(F.lit(1)) == expected).alias("rows"), F.coalesce(F.bool_and(finite), F.lit(True)).alias("no_missing"))
    top = rows.groupBy(method).agg(F.round(F.avg(score), 9).alias("_s")).agg((F.max_by(method, F.struct(F.col("_s"), F.col(method))) == baseline).alias("top"))
    both = whole.crossJoin(top)
    checks = F.array(*[F.struct(F.lit(n).alias("check"), F.col(c).alias("passed")) for n, c in (("row count", "rows"), ("no missing figures", "no_missing"), ("top baseline", "top"))])
    return both.select(F.explode(checks).alias("c")).select("c.*")


def systems_profile(passes: DataFrame, queries: int) -> DataFrame:
    """(pass, bytes, seconds, lines, mb_s, s_per_query): a row a pass and one
    over all, ``all``; costs are spread over ``queries``."""
    sums = [F.sum(c).alias(c) for c in ("bytes", "seconds", "lines")]
    each = passes.groupBy("pass").agg(*sums).unionByName(passes.agg(*sums).select(F.lit("all").alias("pass"), "bytes", "seconds", "lines"))
    rate = F.when(F.col("seconds") > 0, F.round(F.col("bytes") / F.col("seconds") / 1e6, 9))
    return each.select("pass", "bytes", F.round("seconds", 4).alias("seconds"), "lines", rate.alias("mb_s"), F.round(F.col("seconds") / queries, 9).alias("s_per_query"))


def case_features(cases: DataFrame, column: str) -> DataFrame:
    """Adds budget_id, budget_name, family, seed and case_len, read from case
    names ``budget_<n>_<name>:<family>:<seed>``; -1 and unknown where a name
    isn't of that form."""
    pattern = r"^budget_(\d+)_([^:]+):([^:]+):(\d+)"
    fits = F.regexp_like(column, F.lit(pattern))
    part = lambda i: F.regexp_extract(column, pattern, i)
    number = lambda i: F.when(fits, part(i).cast("long")).otherwise(-1)
    word = lambda i: F.when(fits, part(i)).otherwise("unknown")
    return cases.select("*", number(1).alias("budget_id"), word(2).alias("budget_name"), word(3).alias("family"), number(4).alias("seed"), F.length(column).alias("case_len"))


def tier_slices(datasets: int, query: int = 69, summary: int = 6, pq: int = 6, agreement: int = 6) -> dict[str, list[int]]:
    """Positions of the features that each tier of legality may use, in a
    vector of dataset flags, query summaries, summary scores, PQ scores and
    agreements."""
    edges, at = {}, 0
    for name, n in (("dataset", datasets), ("query", query), ("summary", summary), ("pq", pq), ("agreement", agreement)):
        edges[name], at = list(range(at, at + n)), at + n
    take = lambda *names: [i for n in names for i in edges[n]]
    return {
        "B0_query_summary": take("dataset", "query", "summary"), "B0_no_dataset": take("query", "summary"), "B1_scores_agreement": take("summary", "pq", "agreement"),
        "B1_no_dataset": take("query", "summary", "pq", "agreement"), "B1_full": list(range(at)), "agreement_only": take("agreement"), "score_only": take("summary", "pq"),
    }


def sliced(vector: Column, positions: list[int]) -> Column:
    """Those entries of an array column, in that order."""
    return F.transform(F.array(*[F.lit(p) for p in positions]), lambda p: F.get(vector, p))
