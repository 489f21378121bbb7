"""BM25 over local pools, link-graph expansion and negative controls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import bound, norm_title, token_set, tokens
from .lineage import cut

#: Fixed values of BM25.
K1, B = 1.2, 0.75


def bm25_local(queries: DataFrame, pool: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(qid, did, score): document frequencies, sizes and number of documents
    are those of the query's own pool.

    ``queries``: qid, text; ``pool``: qid, did, text.  A term that a query
    repeats counts as often; a document without tokens has length 1.
    """
    docs = pool.select("qid", "did", tokens(F.col("text")).alias("_t"))
    sized = docs.select("qid", "did", F.greatest(F.size("_t"), F.lit(1)).alias("dl"))
    stats = sized.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))
    # terms that the query doesn't ask for are dropped before anything is counted
    hits = docs.select("qid", "did", F.explode("_t").alias("term")).join(asked, ["qid", "term"])
    met = hits.groupBy("qid", "did", "term", "qtf").agg(F.count(F.lit(1)).alias("tf"))
    df = met.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = met.join(df, ["qid", "term"]).join(sized, ["qid", "did"]).join(stats, "qid")
    per = scored.groupBy("qid", "did").agg(F.sum(F.col("qtf") * idf * weight).alias("score"))
    return sized.select("qid", "did").join(per, ["qid", "did"], "left").select("qid", "did", F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"))


def bm25_of(query: Column, texts: Column, k1: float = K1, b: float = B) -> Column:
    """Array of :func:`bm25_local` scores of ``texts``, an array that is the
    query's own pool: query and pool stand in one row, so nothing is shuffled."""
    return bm25_of_tokens(tokens(query), F.transform(texts, tokens), k1, b)


def bm25_of_tokens(query: Column, texts: Column, k1: float = K1, b: float = B) -> Column:
    """:func:`bm25_of` of a query's tokens and of an array of texts' tokens."""
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, d: s + d["dl"]) / F.greatest(F.size(a), F.lit(1))
    times = lambda a, t: F.size(F.filter(a, lambda x: x == t))

    def read(terms: Column) -> Column:
        return F.transform(texts, lambda w: F.named_struct(F.lit("dl"), F.greatest(F.size(w), F.lit(1)), F.lit("hits"), F.filter(w, lambda x: F.array_contains(terms, x))))

    def weigh(asked: Column, terms: Column, docs: Column) -> Column:
        df = lambda t: F.size(F.filter(docs, lambda d: F.array_contains(d["hits"], t)))
        idf = lambda n: F.log(1 + (F.size(docs) - n + 0.5) / (n + 0.5))
        return F.transform(terms, lambda t: F.named_struct(F.lit("t"), t, F.lit("w"), times(asked, t) * bound(df(t), idf)))

    def score(weights: Column, docs: Column, mean: Column) -> Column:
        part = lambda d, w: bound(times(d["hits"], w["t"]), lambda tf: F.when(tf > 0, w["w"] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * d["dl"] / mean)))).otherwise(0.0))
        return F.transform(docs, lambda d: F.round(F.aggregate(weights, F.lit(0.0), lambda s, w: s + part(d, w)), 6))

    return bound(query, lambda asked: bound(F.array_distinct(asked), lambda terms: bound(read(terms), lambda docs: bound(
        weigh(asked, terms, docs), lambda weights: bound(size(docs), lambda mean: score(weights, docs, mean))
    ))))


def by_score(*tie: str) -> Window:
    return Window.partitionBy("qid").orderBy(F.col("score").desc(), *(tie or ("did",)))


def margin_entropy(scores: DataFrame) -> DataFrame:
    """(qid, margin, entropy): top two scores apart; softmax entropy of all."""
    every = Window.partitionBy("qid")
    w = F.exp(F.col("score") - F.max("score").over(every))
    p = scores.withColumn("w", w).withColumn("p", F.col("w") / F.sum("w").over(every)).withColumn("r", F.row_number().over(by_score()))
    at = lambda k: F.max(F.when(F.col("r") == k, F.col("score")))
    return p.groupBy("qid").agg(
        F.round(F.coalesce(at(1) - at(2), F.lit(0.0)), 6).alias("margin"), (F.round(-F.sum(F.col("p") * F.log(F.col("p") + 1e-12)), 6) + 0.0).alias("entropy")
    )


def expand(seeds: DataFrame, edges: DataFrame, cap: int, exclude: DataFrame | None = None) -> DataFrame:
    """(qid, node, links, place): neighbours of the seeds that aren't seeds (or
    excluded), most links first, ``cap`` a query.

    ``seeds``: qid, node; ``edges``: src, dst, distinct.
    """
    found = seeds.join(edges, F.col("node") == F.col("src")).select("qid", F.col("dst").alias("node"))
    gone = seeds.select("qid", "node")
    if exclude is not None:
        gone = gone.unionByName(exclude.select("qid", "node"))
    fresh = found.join(gone.distinct(), ["qid", "node"], "left_anti").groupBy("qid", "node").agg(F.count(F.lit(1)).alias("links"))
    place = Window.partitionBy("qid").orderBy(F.col("links").desc(), "node")
    return fresh.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= cap)


def _lists(nodes: DataFrame, value: str) -> DataFrame:
    """(node, _q, _w): each node once, with its queries and a value for each."""
    listed = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("qid", F.col(value).alias("w")))).alias("l"))
    return listed.select("node", F.col("l.qid").alias("_q"), F.col("l.w").alias("_w"))


def _spread(held: DataFrame, asked: DataFrame, edges: DataFrame, frm: str, to: str) -> DataFrame:
    """(qid, node, w, n): sum of the values of ``held`` nodes, and number of the
    nodes, that are linked to a node of the same query in ``asked``.

    Both are of :func:`_lists`.  A link travels once, with its first node's
    list, and only if ``asked`` has its other node; it becomes a row a query
    where all links of that other node are, so that such rows aren't shuffled.
    """
    wanted = asked.select(F.col("node").alias("to"), F.col("_q").alias("_in"))
    links = edges.select(F.col(frm).alias("node"), F.col(to).alias("to")).join(wanted.select("to"), "to", "left_semi")
    met = links.join(held, "node").select("to", "_q", "_w").join(wanted, "to")
    cells = F.filter(F.arrays_zip("_q", "_w"), lambda c: F.array_contains("_in", c["_q"]))
    return met.select("to", F.explode(cells).alias("c")).groupBy("to", F.col("c._q").alias("qid")).agg(F.sum("c._w").alias("w"), F.count(F.lit(1)).alias("n")).select("qid", F.col("to").alias("node"), "w", "n")


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, node): distinct nodes that a query's ``nodes`` (qid, node) link to."""
    held = nodes.groupBy("node").agg(F.collect_set("qid").alias("_q"))
    met = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).join(held, "node").select("to", "_q").repartition("to")
    return met.select("to", F.explode("_q").alias("qid")).groupBy("to", "qid").agg(F.lit(1)).select("qid", F.col("to").alias("node"))


def one_hop_scores(pool: DataFrame, edges: DataFrame, direct: float = 1.0, reverse: float = 0.75) -> DataFrame:
    """(qid, node, one, out_degree, in_degree): links within each query's pool.

    ``pool``: qid, node, anchor (is it a start?).
    """
    return _one_hop(pool, edges, direct, reverse).select("qid", "node", "one", "out_degree", "in_degree")


def _one_hop(pool: DataFrame, edges: DataFrame, direct: float, reverse: float) -> DataFrame:
    """:func:`one_hop_scores` with ``d``, the anchors that link to a node."""
    lists = _lists(pool.select("qid", "node", F.col("anchor").cast("long").alias("a")), "a")
    into = _spread(lists, lists, edges, "src", "dst").select("qid", "node", F.col("w").alias("d"), F.col("n").alias("in_degree"))
    out = _spread(lists, lists, edges, "dst", "src").select("qid", "node", F.col("w").alias("r"), F.col("n").alias("out_degree"))
    joined = pool.join(into, ["qid", "node"], "left").join(out, ["qid", "node"], "left").na.fill(0, ["d", "r", "in_degree", "out_degree"])
    return joined.select("qid", "node", (direct * F.col("d") + reverse * F.col("r")).alias("one"), "out_degree", "in_degree", "d")


def two_hop_scores(pool: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, node, two): one-hop score, half a point a path of two links from an
    anchor within the pool, and a little for every link.

    Paths are counted, not made: each middle node hands on how many anchors link
    to it, so that a link is one row however many paths go through it.
    """
    one = cut(_one_hop(pool, edges, 1.0, 0.75))
    paths = _spread(_lists(one.where("d > 0"), "d"), _lists(one, "d"), edges, "src", "dst").select("qid", "node", F.col("w").alias("paths"))
    joined = one.join(paths, ["qid", "node"], "left").na.fill(0, ["paths"])
    return joined.select("qid", "node", F.round(F.col("one") + 0.5 * F.col("paths") + 0.05 * (F.col("out_degree") + F.col("in_degree")), 6).alias("two"))


def clique_scores(nodes: DataFrame, direct: float = 1.0, reverse: float = 0.75) -> DataFrame:
    """(qid, node, one, two): :func:`one_hop_scores` and :func:`two_hop_scores`
    where all nodes of a query's group link to each other.

    ``nodes``: qid, node, anchor, group.  Links and paths follow from a group's
    size and its number of anchors, so no link is made.
    """
    a = F.col("anchor").cast("long")
    size = nodes.groupBy("qid", "group").agg(F.count(F.lit(1)).alias("s"), F.sum(a).alias("k"))
    met = nodes.join(size, ["qid", "group"])
    others = F.col("k") - a  # anchors that link to the node, and that it links to
    paths = (F.col("s") - 1) * F.col("k") - others
    one = (direct + reverse) * others
    return met.select("qid", "node", one.alias("one"), F.round(one + 0.5 * paths + 0.05 * (2 * (F.col("s") - 1)), 6).alias("two"))


def holders(docs: DataFrame, passages: DataFrame, words: int = 3) -> DataFrame:
    """(qid, did) of the documents (did, text) that hold a passage (qid, text).

    Passages meet documents by their first ``words`` whole words, an equi-join
    of the document's distinct runs with a list of passages; only what meets is
    searched for the passage itself.  A passage that has fewer words than that
    inside (the first and last may be cut off by it) is looked for everywhere.
    """
    split = lambda c: F.regexp_extract_all(c, F.lit(r"([^\x00-\x20]+)"), F.lit(1))
    run = lambda w, i: F.array_join(F.slice(w, i, F.lit(words)), " ")
    asked = passages.select("qid", F.col("text").alias("_q"), split(F.col("text")).alias("_w")).where(F.col("_q").isNotNull())
    # the first word may be the end of a longer one in the document, so runs start at the second
    long = asked.where(F.size("_w") >= words + 2).select("qid", "_q", run(F.col("_w"), F.lit(2)).alias("_k"))
    short = asked.where(F.size("_w") < words + 2).select("qid", "_q")
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - words + 1, F.lit(1))), lambda i: run(F.col("_w"), i)))
    keyed = docs.select("did", split(F.col("text")).alias("_w")).select("did", F.explode(runs).alias("_k"))
    met = keyed.join(long, "_k").select("did", "qid", "_q").distinct()  # ids only: no text is copied for its runs
    found = docs.join(met, "did").where(F.contains("text", "_q")).select("qid", "did")
    everywhere = docs.join(short, F.contains("text", "_q")).select("qid", "did")
    return found.unionByName(everywhere).distinct()


def shuffled_within(scores: DataFrame, seed: int, salt: str) -> DataFrame:
    """Each query's scores dealt anew among its items, by hash order."""
    key = F.md5(F.concat_ws(":", F.col("qid").cast("string"), F.lit(str(seed)), F.lit(salt), F.col("did").cast("string")))
    by_hash = scores.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(key, "did")))
    by_id = scores.select("qid", F.col("score").alias("dealt"), F.row_number().over(Window.partitionBy("qid").orderBy("did")).alias("place"))
    return by_hash.drop("score").join(by_id, ["qid", "place"]).select("qid", "did", F.col("dealt").alias("score"))


def fallback_anchor(score: Column, at_least: float) -> Column:
    """Rows that reach a score, or the best of the query if none does."""
    best = F.max(score).over(Window.partitionBy("qid"))
    return (score >= at_least) | ((best < at_least) & (score == best))


def title_anchors(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """(qid, did, anchor) of titles (qid, did, question, title): a title that
    stands in the question, or that shares ``least`` of its words with it and one
    at least; the first of those that share most words if there is none."""
    q, t = token_set(F.col("question")), token_set(F.col("title"))
    both = pairs.select("qid", "did", F.size(F.array_intersect(q, t)).alias("_n"), F.size(t).alias("_t"), F.contains(norm_title(F.col("question")), norm_title(F.col("title"))).alias("_in"), (norm_title(F.col("title")) != "").alias("_some"))
    plain = (F.col("_some") & F.col("_in")) | ((F.col("_n") >= least * F.greatest(F.col("_t"), F.lit(1))) & (F.col("_n") >= 1))
    of = Window.partitionBy("qid")
    ranked = both.withColumn("_a", F.coalesce(plain, F.lit(False))).withColumn("_any", F.max("_a").over(of)).withColumn("_r", F.row_number().over(of.orderBy(F.col("_n").desc(), "did")))
    return ranked.select("qid", "did", F.when(F.col("_any"), F.col("_a")).otherwise(F.col("_r") == 1).alias("anchor"))


def hyper_scores(pool: DataFrame, edges: DataFrame, first: DataFrame) -> DataFrame:
    """(qid, node, one, two): links into each node of a query's pool.

    ``pool``: qid, node, anchor, overlap; ``edges``: src, dst, distinct;
    ``first``: qid, node, the titles that a first hop found.  A link from the
    pool weighs 1.5 from an anchor, else 0.35.  A link from a first-hop title
    adds 0.6 if that title has one-hop weight itself, else 0.3.  Degree, up to
    50, adds a hundredth and the title's overlap a twentieth.
    """
    # an anchor's link counts twice: its weight of 1 and half a point as a link of an anchor
    weight = F.when(F.col("anchor"), 1.5).otherwise(0.35)
    lists = _lists(pool.select("qid", "node", weight.alias("a")), "a")
    into = _spread(lists, lists, edges, "src", "dst").select("qid", "node", F.col("w").alias("one"))
    one = pool.join(into, ["qid", "node"], "left").na.fill(0.0, ["one"])
    deg = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("deg"))
    mids = first.select("qid", "node").distinct().join(one.select("qid", "node", F.col("one").alias("_o")), ["qid", "node"], "left")
    mids = _lists(mids.select("qid", "node", F.when(F.col("_o") > 0, 0.6).otherwise(0.3).alias("a")), "a")
    over = _spread(mids, lists, edges, "src", "dst").select("qid", "node", F.col("w").alias("hop"))
    met = one.join(over, ["qid", "node"], "left").join(deg, "node", "left").na.fill(0, ["hop", "deg"])
    two = F.col("one") + F.col("hop") + 0.01 * F.least("deg", F.lit(50)) + 0.05 * F.col("overlap")
    return met.select("qid", "node", F.round("one", 6).alias("one"), F.round(two, 6).alias("two"))
