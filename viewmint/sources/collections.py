"""Structured-evidence collections: nested rows as they are published, brought
to one shape per family.

The ``RAW_*`` schemas are those of the JSON or Parquet rows; read with
``spark.read.schema(RAW_HOTPOT).json(path)``.  Every loader is one projection
over nested columns, so that it needs no shuffle; order is kept by position.
Identifiers that are missing get the family's name and a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import bound, norm_title, token_set

_FACTS = "array<array<string>>"
RAW_2WIKI = f"_id string, type string, question string, answer string, context array<struct<title:string,sentences:array<string>>>, supporting_facts {_FACTS}, evidences {_FACTS}"
RAW_HOTPOT = (
    "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>, "
    "supporting_facts struct<title:array<string>,sent_id:array<int>>"
)
RAW_MUSIQUE = (
    "id string, question string, answer string, answer_aliases array<string>, answerable boolean, "
    "paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, "
    "question_decomposition array<struct<question:string,answer:string,paragraph_support_idx:int>>"
)
RAW_FEVER = "id string, claim string, label string, verifiable string, evidence array<array<array<string>>>"
RAW_STRATEGYQA = "qid string, question string, term string, description string, facts array<string>, answer boolean, decomposition array<string>"
RAW_DOCRED = (
    "doc_id string, split string, title string, sents array<array<string>>, vertexSet array<array<struct<name:string>>>, "
    "labels array<struct<h:int,t:int,r:string,evidence:array<int>>>"
)


def _named(column: str, family: str) -> Column:
    """The row's id, or the family's name and a hash of its question."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.concat(F.lit(f"{family}_"), F.substring(F.md5(F.coalesce("question", F.lit(""))), 1, 12)))


def _text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def _filled(texts: Column) -> Column:
    """Trimmed texts that aren't empty."""
    return F.coalesce(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: F.coalesce(t, F.lit("")) != ""), F.array().cast("array<string>"))


def _set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def load_2wiki(raw: DataFrame) -> DataFrame:
    """id, type, question, answer, contexts, support_titles, evidence_entities.

    A supporting fact is (title, sentence) or (number, title): its title is the
    first entry that isn't a number.  Evidence entities are the ends of the
    triples.  Both are sets of normalised titles.
    """
    fact = lambda f: F.when(F.get(f, F.lit(0)).rlike(r"^\d+$") & ~F.coalesce(F.get(f, F.lit(1)), F.lit("0")).rlike(r"^\d+$"), F.get(f, F.lit(1))).otherwise(F.get(f, F.lit(0)))
    whole = F.filter("evidences", lambda e: F.size(e) >= 3)
    ends = F.concat(F.transform(whole, lambda e: norm_title(F.get(e, F.lit(0)))), F.transform(whole, lambda e: norm_title(F.get(e, F.lit(2)))))
    return raw.select(
        F.col("_id").alias("id"), "type", "question", "answer", F.col("context").alias("contexts"),
        _set(F.transform(F.filter("supporting_facts", lambda f: F.size(f) > 0), lambda f: norm_title(fact(f)))).alias("support_titles"), _set(ends).alias("evidence_entities"),
    )


def load_hotpot(raw: DataFrame) -> DataFrame:
    """id, question, answer, type, level, contexts, support_titles and
    support_pairs (title, sid); rows without support are left out."""
    contexts = F.transform(F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences")), lambda c: F.struct(c["title"].alias("title"), c["sentences"].alias("sentences")))
    titles = F.coalesce(F.col("supporting_facts.title"), F.array().cast("array<string>"))
    both = F.arrays_zip(F.col("supporting_facts.title").alias("title"), F.col("supporting_facts.sent_id").alias("sid"))
    there = F.filter(both, lambda p: (F.trim(p["title"]) != "") & p["sid"].isNotNull())
    pairs = F.array_sort(F.array_distinct(F.transform(there, lambda p: F.struct(norm_title(p["title"]).alias("title"), p["sid"].alias("sid")))))
    return raw.where(F.size(titles) > 0).select(
        _named("id", "hotpot").alias("id"), _text("question"), _text("answer"), _text("type"), _text("level"), contexts.alias("contexts"),
        _set(F.transform(titles, norm_title)).alias("support_titles"), pairs.alias("support_pairs"),
    )


def load_musique(raw: DataFrame) -> DataFrame:
    """id, question, answer, aliases, paragraphs, decomposition, support and hop
    type; paragraphs need a title and a text, rows an answer and support."""
    numbered = F.transform("paragraphs", lambda p, i: F.struct(F.coalesce(p["idx"], i).alias("idx"), F.trim(p["title"]).alias("title"), F.trim(p["paragraph_text"]).alias("paragraph_text"), F.coalesce(p["is_supporting"], F.lit(False)).alias("is_supporting")))
    fine = F.filter(numbered, lambda p: (p["title"] != "") & (p["paragraph_text"] != ""))
    rows = raw.withColumn("paragraphs", F.coalesce(fine, F.array().cast("array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>")))
    support = F.filter("paragraphs", lambda p: p["is_supporting"])
    name = _named("id", "musique")
    hops = F.when(F.contains(name, F.lit("__")), F.substring_index(name, "__", 1)).otherwise(F.concat(F.size(support).cast("string"), F.lit("support")))
    steps = F.coalesce(F.col("question_decomposition"), F.array().cast("array<struct<question:string,answer:string,paragraph_support_idx:int>>"))
    return rows.where(F.coalesce("answerable", F.lit(False)) & (F.size(support) > 0)).select(
        name.alias("id"), _text("question"), _text("answer"), F.coalesce("answer_aliases", F.array().cast("array<string>")).alias("answer_aliases"), "paragraphs",
        _filled(F.transform(steps, lambda s: s["question"])).alias("decomp_questions"), F.transform(steps, lambda s: F.coalesce(s["answer"], F.lit(""))).alias("decomp_answers"),
        F.transform(steps, lambda s: s["paragraph_support_idx"]).alias("decomp_support_idx"), _set(F.transform(support, lambda p: p["idx"])).alias("support_idx"),
        _set(F.transform(support, lambda p: norm_title(p["title"]))).alias("support_titles"), hops.alias("type"),
    )


def load_fever(raw: DataFrame) -> DataFrame:
    """id, claim, label, verifiable, evidence_handles (title, sid) in the order
    of their first mention, evidence_titles; claims without handles are left out.

    An evidence item is (annotation, evidence, title, sentence); items that are
    shorter, have no title or no whole number are passed over.
    """
    items = F.filter(F.flatten("evidence"), lambda e: (F.size(e) >= 4) & F.get(e, F.lit(2)).isNotNull() & F.get(e, F.lit(3)).try_cast("int").isNotNull())
    handles = F.array_distinct(F.transform(items, lambda e: F.struct(F.get(e, F.lit(2)).alias("title"), F.get(e, F.lit(3)).try_cast("int").alias("sid"))))
    return raw.withColumn("evidence_handles", F.coalesce(handles, F.array().cast("array<struct<title:string,sid:int>>"))).where(F.size("evidence_handles") > 0).select(
        "id", _text("claim"), _text("label"), _text("verifiable"), "evidence_handles", _set(F.transform("evidence_handles", lambda h: h["title"])).alias("evidence_titles")
    )


def load_strategyqa(raw: DataFrame) -> DataFrame:
    """id, question, term, description, facts, answer, decomposition; rows
    without a fact are left out."""
    return raw.withColumn("facts", _filled(F.col("facts"))).where(F.size("facts") > 0).select(
        _named("qid", "strategyqa").alias("id"), _text("question"), _text("term"), _text("description"), "facts", F.coalesce("answer", F.lit(False)).alias("answer"), _filled(F.col("decomposition")).alias("decomposition")
    )


def entity_name(vertices: Column, at: Column) -> Column:
    """The longest mention of an entity, the first of equally long ones; the
    empty name if there's no such entity."""
    names = F.transform(F.get(vertices, at), lambda m, i: F.struct(F.length(m["name"]).alias("n"), (-i).alias("i"), m["name"].alias("name")))
    return F.when(at >= 0, F.coalesce(F.array_max(names)["name"], F.lit(""))).otherwise(F.lit(""))


def co_mention(sentence: Column, head: Column, tail: Column, relation: Column) -> Column:
    """Twice the entities that a sentence names, and a quarter of the share of
    the relation's words that it has."""
    return _co_mention(F.lower(sentence), token_set(sentence), F.lower(head), F.lower(tail), token_set(relation))


def _co_mention(sentence: Column, said: Column, head: Column, tail: Column, words: Column) -> Column:
    """:func:`co_mention` of what is lower-cased and cut into words already."""
    named = lambda e: F.when((e != "") & F.contains(sentence, e), 1.0).otherwise(0.0)
    share = F.size(F.array_intersect(words, said)) / F.greatest(F.lit(1), F.size(words))
    return 2.0 * (named(head) + named(tail)) + 0.25 * share


def load_docred(raw: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """A query for each relation that has evidence among its document's sentences.

    query_id, doc_id, split, title, query_text, head, tail, relation,
    relevant_local, candidate_count, summary_scores, candidate_texts.  ``relations`` (r, name)
    names relations in words; one that isn't there goes by its id.  Documents of
    one sentence and evidence outside of the document are left out.
    """
    # lambdas and filters name the number of sentences, so it is a column: an
    # expression of ``lines`` there would join every sentence anew each time.
    # A document's sentences are cut into words once, not for each relation.
    line = lambda s: bound(F.array_join(s, " "), lambda t: F.named_struct(F.lit("text"), t, F.lit("low"), F.lower(t), F.lit("words"), token_set(t)))
    docs = raw.where(F.size("sents") >= 2).select("doc_id", "split", F.coalesce("title", F.lit("")).alias("title"), F.transform("sents", line).alias("lines"), F.size("sents").alias("n"), F.col("vertexSet").alias("v"), F.posexplode("labels").alias("nth", "l"))
    evidence = F.array_sort(F.array_distinct(F.filter("l.evidence", lambda e: (e >= 0) & (e < F.col("n")))))
    asked = docs.withColumns({"relevant_local": evidence, "relation": F.coalesce("l.r", F.lit("UNK"))}).where(F.size("relevant_local") > 0)
    asked = asked.withColumns({"head": entity_name(F.col("v"), F.coalesce("l.h", F.lit(-1))), "tail": entity_name(F.col("v"), F.coalesce("l.t", F.lit(-1)))})
    if relations is not None:
        # a vocabulary: documents stay where they are, whatever relation most have
        asked = asked.join(F.broadcast(relations.select(F.col("r").alias("relation"), F.col("name").alias("_name"))), "relation", "left")
    else:
        asked = asked.withColumn("_name", F.lit(None).cast("string"))
    name = F.coalesce("_name", "relation")
    score = lambda k: F.transform("lines", lambda s, i: F.round(_co_mention(s["low"], s["words"], k["head"], k["tail"], k["words"]) - 0.001 * i, 9))
    scores = bound(F.named_struct(F.lit("head"), F.lower("head"), F.lit("tail"), F.lower("tail"), F.lit("words"), token_set(name)), score)
    return asked.select(
        F.concat_ws(":", "doc_id", F.col("nth").cast("string")).alias("query_id"), "doc_id", "split", "title",
        F.concat(F.col("title"), F.lit(": evidence for relation "), name, F.lit(" between "), "head", F.lit(" and "), "tail").alias("query_text"),
        "head", "tail", "relation", "relevant_local", F.col("n").alias("candidate_count"), scores.alias("summary_scores"), F.col("lines.text").alias("candidate_texts"),
    )


def clean_text(text: Column) -> Column:
    """White space to single spaces, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def mixed_corpus(parts: dict[str, DataFrame], target: int, seed: int, least: int = 1) -> DataFrame:
    """(corpus, did, text) of several text tables (did, text), cleaned, without
    texts shorter than ``least``, and of these ``target`` in a seeded order."""
    whole = None
    for name, part in parts.items():
        one = part.select(F.lit(name).alias("corpus"), F.col("did").cast("string").alias("did"), clean_text(F.col("text")).alias("text"))
        whole = one if whole is None else whole.unionByName(one)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "corpus", "did"))
    return whole.where(F.length("text") >= least).orderBy(order, "corpus", "did").limit(target)


def content_rows(lines: DataFrame, sep: str = "\t") -> DataFrame:
    """(id, features, label) of ``value`` lines: an id, numbers and a label,
    separated by tabs; features are (index, value) of those that aren't 0."""
    cells = F.split("value", sep)
    numbers = F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 2, F.lit(0))), lambda x, i: F.struct(i.alias("index"), x.try_cast("double").alias("value")))
    return lines.where(F.size(cells) >= 3).select(F.get(cells, F.lit(0)).alias("id"), F.filter(numbers, lambda n: n["value"] != 0).alias("features"), F.get(cells, F.size(cells) - 1).alias("label"))
