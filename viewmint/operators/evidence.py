"""Structured-evidence views: text and link signals of each candidate, and the
priced views that families of questions make of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import overlap_share, tokens
from .text import bm25_local, bm25_of, bm25_of_tokens, clique_scores, fallback_anchor

#: A family's views as weights of signals, in menu order.  The
#: last views of fever and strategyqa add a bonus on gold: they stand for a
#: judge's knowledge and are no legal scorers.
FAMILIES: dict[str, dict[str, dict[str, float]]] = {
    "2wiki": {"summary": {"title": 1.0}, "one_hop": {"one": 1.0, "title": 0.25}, "two_hop": {"two": 1.0, "title": 0.20}, "full_context": {"full": 1.0}},
    "hyperlink": {"summary": {"title": 1.0}, "provided_context": {"paragraph": 1.0, "title": 0.15}, "hyperlink_1hop": {"one": 1.0, "title": 0.20}, "hyperlink_2hop": {"two": 1.0, "title": 0.18}, "full_local_pool": {"full": 1.0, "paragraph": 0.10}},
    "hotpot": {"summary": {"title": 1.0}, "title_shortlist": {"title": 1.0, "overlap": 0.6}, "paragraph": {"paragraph": 1.0, "title": 0.2}, "sentence": {"sentence": 1.0, "title": 0.15}, "full_context": {"full": 1.0, "title": 0.1}},
    "musique": {"summary": {"title": 1.0, "overlap": 0.5}, "decomp_title": {"title": 1.0}, "paragraph": {"paragraph": 1.0, "title": 0.15}, "support_set": {"full": 1.0, "sentence": 0.3, "paragraph": 0.15}, "full_context": {"full": 1.0, "title": 0.2}},
    "fever": {"summary": {"title": 1.0, "overlap": 0.25}, "title_page": {"title": 1.0, "overlap": 0.45}, "evidence_sentence": {"sentence": 1.0, "overlap": 0.35}, "full_evidence_page": {"full": 1.0, "gold": 1.75}},
    "strategyqa": {"summary": {"title": 1.0}, "decomposition": {"paragraph": 1.0}, "fact_snippets": {"sentence": 1.0}, "full_fact_set": {"full": 1.0, "gold": 3.0}},
    "docred": {"summary": {"position": -0.001}, "co_mention": {"overlap": 2.0, "position": -0.001}, "evidence_sentences": {"sentence": 1.0}, "full_context": {"full": 1.0}},
}


def sentences(text: Column) -> Column:
    return F.split(text, r"\.")


def signals(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, did, title, paragraph, sentence, full, overlap, one, two, gold,
    position): BM25 of a candidate's title, first two sentences, best sentence
    and whole text in its query's pool; shared title words; links from anchors.

    ``pool``: qid, did, text, group; candidates of a query's group link to each other.
    """
    head = F.array_join(F.slice(tokens(F.col("text")), 1, 6), " ")
    first = F.array_join(F.slice(sentences(F.col("text")), 1, 2), ".")
    titled = pool.select("qid", "did", head.alias("t"), first.alias("p"), "text", "group")

    def bm(column: str, name: str) -> DataFrame:
        return bm25_local(queries, titled.select("qid", "did", F.col(column).alias("text"))).withColumnRenamed("score", name)

    cut = pool.select("qid", "did", F.posexplode(sentences(F.col("text"))).alias("sid", "text"))
    best = bm25_local(queries, cut.select("qid", F.struct("did", "sid").alias("did"), "text")).groupBy("qid", F.col("did.did").alias("did")).agg(F.max("score").alias("sentence"))
    asked = queries.select("qid", F.col("text").alias("q"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("did")) - 1
    known = titled.join(asked, "qid").select("qid", "did", "group", F.round(overlap_share(F.col("q"), F.col("t")), 6).alias("overlap"), F.contains("text", "q").cast("double").alias("gold"), place.cast("double").alias("position"))
    plain = known.drop("group")
    nodes = known.select("qid", F.col("did").alias("node"), fallback_anchor(F.col("overlap"), 0.45).alias("anchor"), "group")
    links = clique_scores(nodes).withColumnRenamed("node", "did")
    parts = [bm("t", "title"), bm("p", "paragraph"), best, bm("text", "full"), links]
    return reduce(lambda a, b: a.join(b, ["qid", "did"]), parts, plain)


def views(signal: DataFrame, family: str) -> DataFrame:
    """(qid, view, ord, did, score, rank) of each view of a family."""
    cells = []
    for i, (view, weights) in enumerate(FAMILIES[family].items()):
        score = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in weights.items()])
        cells.append(F.struct(F.lit(view).alias("view"), F.lit(i).alias("ord"), (F.round(score, 9) + 0.0).alias("score")))
    long = signal.select("qid", "did", F.explode(F.array(*cells)).alias("c")).select("qid", "did", "c.*")
    order = Window.partitionBy("qid", "view").orderBy(F.col("score").desc(), "did")
    return long.withColumn("rank", F.row_number().over(order).cast("long"))


def _ranked(scored: DataFrame, order: list[str]) -> DataFrame:
    """(qid, view, ord, did, score, rank) of a column a view; ties by position.

    Ranks go by billionths of the column itself: scores often lie halfway
    between two of them, and one that was rounded before may go the other way.
    """
    billionths = lambda v: F.round(F.col(v) * 1e9)
    cells = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), (F.round(v, 12) + 0.0).alias("score"), billionths(v).alias("key")) for i, v in enumerate(order)])
    long = scored.select("qid", "did", F.explode(cells).alias("c")).select("qid", "did", "c.*")
    by = Window.partitionBy("qid", "view").orderBy(F.col("key").desc(), "did")
    return long.withColumn("rank", F.row_number().over(by).cast("long")).drop("key")


def decomposed_views(rows: DataFrame) -> DataFrame:
    """(qid, view, ord, did, score, rank): the five views of questions that come
    with sub-questions, on rows of ``load_musique``; ``did`` is a paragraph's place.

    Titles are scored by the question, and by it and its sub-questions; whole
    paragraphs by either and by the best of the sub-questions alone.  A row
    without sub-questions has that part 0.  All weights are fixed values.
    """
    terms = lambda of: F.transform("paragraphs", lambda p: tokens(of(p)))
    both = F.trim(F.concat_ws(" ", "question", F.array_join("decomp_questions", " ")))
    read = rows.select(
        F.col("id").alias("qid"), tokens(F.col("question")).alias("q"), tokens(both).alias("b"), F.transform("decomp_questions", tokens).alias("s"),
        terms(lambda p: p["title"]).alias("titles"), terms(lambda p: F.concat(p["title"], F.lit(". "), p["paragraph_text"])).alias("texts"),
        F.transform("paragraphs", lambda p: F.round(overlap_share(F.col("question"), p["title"]), 6)).alias("ov"),
    )
    bm = lambda by, of: bm25_of_tokens(F.col(by), F.col(of))
    steps = F.transform("s", lambda s: bm25_of_tokens(s, F.col("texts")))
    met = read.select("qid", "ov", bm("q", "titles").alias("t"), bm("b", "titles").alias("tb"), bm("q", "texts").alias("p"), bm("b", "texts").alias("pb"), steps.alias("steps"))
    best = lambda i: F.coalesce(F.array_max(F.transform("steps", lambda e: F.get(e, i))), F.lit(0.0))
    # a question's paragraphs are in its row, so they are scored and ranked there
    made = met.select("*", F.zip_with("t", "ov", lambda t, o: t + 0.5 * o).alias("summary"), F.transform("t", lambda t, i: best(i)).alias("best"))
    made = made.select("*", F.zip_with("tb", "summary", lambda x, s: x + 0.25 * s).alias("decomp_title"), F.zip_with("p", "summary", lambda x, s: x + 0.15 * s).alias("paragraph"))
    made = made.withColumn("support_set", F.zip_with(F.zip_with("pb", "best", lambda x, e: x + 0.3 * e), "paragraph", lambda x, y: x + 0.15 * y))
    made = made.withColumn("full_context", F.zip_with("pb", "support_set", lambda x, s: x + 0.2 * s))
    views_ = ["summary", "decomp_title", "paragraph", "support_set", "full_context"]
    cells = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), F.col(v).alias("scores")) for i, v in enumerate(views_)])
    each = made.select("qid", F.explode(cells).alias("c")).select("qid", "c.*")
    # by billionths of the score itself, as in _ranked
    order = F.array_sort(F.transform("scores", lambda x, i: F.named_struct(F.lit("key"), -F.round(x * 1e9), F.lit("did"), i, F.lit("score"), F.round(x, 12) + 0.0)))
    return each.select("qid", "view", "ord", F.posexplode(order).alias("at", "s")).select("qid", "view", "ord", "s.did", "s.score", (F.col("at") + 1).cast("long").alias("rank"))


def relation_views(rows: DataFrame, dense: DataFrame | None = None) -> DataFrame:
    """(qid, view, ord, did, score, rank): views of a relation's evidence among
    its document's sentences, on rows of ``load_docred``; ``did`` is a place.

    By place; by the entities and relation words that a sentence names; by BM25
    of the question; and, where ``dense`` (qid, did, score) is given, by that.
    """
    made = {"summary": F.transform("candidate_texts", lambda t, i: -0.001 * i), "co_mention": F.col("summary_scores"), "evidence_sentences": bm25_of(F.col("query_text"), F.col("candidate_texts"))}
    if dense is None:
        # a relation's sentences are in its row, so each view is ranked there
        cells = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(i).alias("ord"), s.alias("scores")) for i, (v, s) in enumerate(made.items())])
        each = rows.select(F.col("query_id").alias("qid"), F.explode(cells).alias("c")).select("qid", "c.*")
        order = F.array_sort(F.transform("scores", lambda x, i: F.named_struct(F.lit("key"), -F.round(x, 9), F.lit("did"), i, F.lit("score"), F.round(x, 12) + 0.0)))
        return each.select("qid", "view", "ord", F.posexplode(order).alias("at", "s")).select("qid", "view", "ord", "s.did", "s.score", (F.col("at") + 1).cast("long").alias("rank"))
    zipped = F.arrays_zip(*[s.alias(v) for v, s in made.items()])
    met = rows.select(F.col("query_id").alias("qid"), F.posexplode(zipped).alias("did", "c")).select("qid", "did", "c.*")
    return _ranked(met.join(dense.withColumnRenamed("score", "full_context"), ["qid", "did"]), [*made, "full_context"])
