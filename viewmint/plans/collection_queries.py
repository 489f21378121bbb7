"""Collections in their published nested shapes, made of the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..sources import collections as S
from .registry import query, read

_NORM = "trim(regexp_replace(lower(replace({}, '_', ' ')), '\\s+', ' ', 'g'))"
_LINES = "l as (select l_orderkey as o, l_linenumber as n, l_returnflag as flag, p_name, p_type, p_brand, p_size from lineitem join part on l_partkey = p_partkey)"


def _lines(spark, sf_dir):
    """An array of an order's lines, in order."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    one = F.struct(F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("flag"), "p_name", "p_type", "p_brand", "p_size")
    return lines.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(one)).alias("l"))


def _joined(values: Column) -> Column:
    return F.array_join(values, "|")


def _str(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


@query(f"""with {_LINES}, s as (select o, string_agg(distinct {_NORM.format("p_name")}, '|' order by {_NORM.format("p_name")}) as support_titles from l where flag = 'R' group by o),
ends as (select o, unnest([{_NORM.format("p_brand")}, {_NORM.format("p_type")}]) as e from l where n % 3 <> 0), e as (select o, string_agg(distinct e, '|' order by e) as evidence_entities from ends group by o),
c as (select o, count(*) as contexts, string_agg(p_name, '|' order by n, flag, p_name) as titles from l group by o)
select 'o' || o::varchar as id, contexts, titles, coalesce(support_titles, '') as support_titles, coalesce(evidence_entities, '') as evidence_entities from c left join s using (o) left join e using (o)""")
def src_2wiki(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    fact = F.transform(F.filter("l", lambda x: x["flag"] == "R"), lambda x: F.when(x["n"] % 2 == 0, F.array(_str(x["n"]), x["p_name"])).otherwise(F.array(x["p_name"], _str(x["n"]))))
    triple = F.transform("l", lambda x: F.when(x["n"] % 3 == 0, F.array(x["p_brand"])).otherwise(F.array(x["p_brand"], F.lit("is"), x["p_type"])))
    raw = rows.select(
        F.concat(F.lit("o"), _str("o")).alias("_id"), F.lit("bridge").alias("type"), _str("o").alias("question"), F.lit("").alias("answer"),
        F.transform("l", lambda x: F.struct(x["p_name"].alias("title"), F.array(x["p_type"], x["p_brand"]).alias("sentences"))).alias("context"), F.concat(fact, F.array(F.array().cast("array<string>"))).alias("supporting_facts"), triple.alias("evidences"),
    )
    return S.load_2wiki(raw).select("id", F.size("contexts").cast("long").alias("contexts"), _joined(F.col("contexts.title")).alias("titles"), _joined(F.col("support_titles")).alias("support_titles"), _joined(F.col("evidence_entities")).alias("evidence_entities"))


@query(f"""with {_LINES}, s as (select distinct o, {_NORM.format("p_name")} as t, n from l where flag <> 'N'), c as (select o, count(*) as contexts, sum(1 + n % 2) as sentences from l group by o)
select case when o % 5 = 0 then 'hotpot_' || substr(md5(o::varchar), 1, 12) else 'o' || o::varchar end as id, contexts, sentences, string_agg(distinct t, '|' order by t) as support_titles, string_agg(t || '#' || n::varchar, '|' order by t, n) as support_pairs
from s join c using (o) group by o, contexts, sentences""")
def src_hotpot(spark, sf_dir):
    support = F.filter("l", lambda x: x["flag"] != "N")
    raw = _lines(spark, sf_dir).select(
        F.when(F.col("o") % 5 != 0, F.concat(F.lit("o"), _str("o"))).alias("id"), _str("o").alias("question"), F.lit("a").alias("answer"), F.lit("bridge").alias("type"), F.lit("easy").alias("level"),
        F.struct(F.col("l.p_name").alias("title"), F.transform("l", lambda x: F.when(x["n"] % 2 == 0, F.array(x["p_type"])).otherwise(F.array(x["p_type"], x["p_brand"]))).alias("sentences")).alias("context"),
        F.struct(F.transform(support, lambda x: x["p_name"]).alias("title"), F.transform(support, lambda x: x["n"]).alias("sent_id")).alias("supporting_facts"),
    )
    pairs = F.transform("support_pairs", lambda p: F.concat_ws("#", p["title"], _str(p["sid"])))
    count = F.aggregate("contexts", F.lit(0), lambda s, c: s + F.size(c["sentences"]))
    return S.load_hotpot(raw).select("id", F.size("contexts").cast("long").alias("contexts"), count.cast("long").alias("sentences"), _joined(F.col("support_titles")).alias("support_titles"), _joined(pairs).alias("support_pairs"))


@query(f"""with {_LINES}, p as (select * from l where p_size % 10 <> 0), s as (select o, count(*) as n_support, string_agg(distinct {_NORM.format("p_name")}, '|' order by {_NORM.format("p_name")}) as support_titles, string_agg(distinct n::varchar, '|' order by n::varchar) as support_idx from p where flag = 'R' group by o),
c as (select o, count(*) as paragraphs from p group by o), d as (select o, count(*) as steps, count(*) filter (where p_size % 4 <> 0) as questions from l where n <= 3 group by o)
select case when o % 2 = 0 then '2hop__' || o::varchar else 'm' || o::varchar end as id, paragraphs, coalesce(questions, 0) as questions, coalesce(steps, 0) as steps, support_idx, support_titles, case when o % 2 = 0 then '2hop' else n_support::varchar || 'support' end as type
from s join c using (o) left join d using (o) where o % 7 <> 0""")
def src_musique(spark, sf_dir):
    raw = _lines(spark, sf_dir).select(
        F.when(F.col("o") % 2 == 0, F.concat(F.lit("2hop__"), _str("o"))).otherwise(F.concat(F.lit("m"), _str("o"))).alias("id"), _str("o").alias("question"), F.lit("a").alias("answer"), F.array().cast("array<string>").alias("answer_aliases"), (F.col("o") % 7 != 0).alias("answerable"),
        F.transform("l", lambda x: F.struct(x["n"].alias("idx"), x["p_name"].alias("title"), F.when(x["p_size"] % 10 == 0, " ").otherwise(x["p_type"]).alias("paragraph_text"), (x["flag"] == "R").alias("is_supporting"))).alias("paragraphs"),
        F.transform(F.filter("l", lambda x: x["n"] <= 3), lambda x: F.struct(F.when(x["p_size"] % 4 == 0, "").otherwise(x["p_type"]).alias("question"), x["p_brand"].alias("answer"), x["n"].alias("paragraph_support_idx"))).alias("question_decomposition"),
    )
    idx = F.array_sort(F.transform("support_idx", lambda i: _str(i)))
    return S.load_musique(raw).select("id", F.size("paragraphs").cast("long").alias("paragraphs"), F.size("decomp_questions").cast("long").alias("questions"), F.size("decomp_answers").cast("long").alias("steps"), _joined(idx).alias("support_idx"), _joined(F.col("support_titles")).alias("support_titles"), "type")


@query(f"""with {_LINES}, pl as (select *, row_number() over (partition by o order by n, flag, p_name, p_type, p_brand, p_size) as pos from l), h as (select o, p_brand as t, n % 2 as sid, min(pos) as first from pl where flag <> 'N' and p_size % 5 <> 0 group by all)
select o::varchar as id, count(*) as handles, string_agg(t || '#' || sid::varchar, '|' order by first) as evidence_handles, string_agg(distinct t, '|' order by t) as evidence_titles from h group by o""")
def src_fever(spark, sf_dir):
    item = lambda x: F.array(F.lit("1"), F.lit("2"), F.when(x["p_size"] % 5 != 0, x["p_brand"]), F.when(x["p_size"] % 10 != 0, _str(x["n"] % 2)).otherwise("none"))
    group = lambda x: F.when(x["flag"] == "N", F.array(F.array(F.lit("1"), F.lit("2")))).otherwise(F.array(item(x), item(x)))
    raw = _lines(spark, sf_dir).select(_str("o").alias("id"), F.lit("c").alias("claim"), F.lit("SUPPORTS").alias("label"), F.lit("VERIFIABLE").alias("verifiable"), F.transform("l", group).alias("evidence"))
    handles = F.transform("evidence_handles", lambda h: F.concat_ws("#", h["title"], _str(h["sid"])))
    return S.load_fever(raw).select("id", F.size("evidence_handles").cast("long").alias("handles"), _joined(handles).alias("evidence_handles"), _joined(F.col("evidence_titles")).alias("evidence_titles"))


@query(f"""with {_LINES}, f as (select o, count(*) as n, string_agg(p_name, '|' order by l.n, flag, p_name) as facts from l where p_size % 3 <> 0 group by o), d as (select o, count(*) as steps from l where l.n % 2 = 0 group by o)
select case when o % 3 = 0 then 'strategyqa_' || substr(md5(o::varchar), 1, 12) else o::varchar end as id, f.n as n_facts, facts, coalesce(steps, 0) as steps, o % 2 = 0 as answer from f left join d using (o)""")
def src_strategyqa(spark, sf_dir):
    raw = _lines(spark, sf_dir).select(
        F.when(F.col("o") % 3 != 0, _str("o")).alias("qid"), _str("o").alias("question"), F.lit("t").alias("term"), F.lit(None).cast("string").alias("description"),
        F.transform("l", lambda x: F.when(x["p_size"] % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), x["p_name"]))).alias("facts"), F.when(F.col("o") % 2 == 0, True).alias("answer"),
        F.transform("l", lambda x: F.when(x["n"] % 2 == 0, x["p_type"]).otherwise(" ")).alias("decomposition"),
    )
    return S.load_strategyqa(raw).select("id", F.size("facts").cast("long").alias("n_facts"), _joined(F.col("facts")).alias("facts"), F.size("decomposition").cast("long").alias("steps"), "answer")


_DOC = """d as (select doc_id, lang, text, string_split(text, '.') as s from documents where text is not null),
lab as (select doc_id, s, i as nth, split_part(ltrim(s[i + 1]), ' ', 1) as head, 'en' as tail, case when i % 2 = 0 then 'P1' else 'P' || i::varchar end as r, list_sort(list_distinct(list_filter([i, i + 1, i + 1, 999], lambda e: e >= 0 and e < len(s)))) as ev
  from (select *, unnest(range(0, least(len(s), 3))) as i from d) where len(s) >= 2),
q as (select *, case when r = 'P1' then 'part of' else r end as name from lab)"""


@query(f"""with {_DOC}, sc as (select doc_id, nth, j, round(2.0::double * ((head <> '' and contains(lower(s[j + 1]), lower(head)))::int + contains(lower(s[j + 1]), tail)::int)
    + 0.25::double * (len(list_intersect(list_distinct(regexp_extract_all(lower(name), '([a-z0-9]+)', 1)), list_distinct(regexp_extract_all(lower(s[j + 1]), '([a-z0-9]+)', 1)))) / greatest(1, len(list_distinct(regexp_extract_all(lower(name), '([a-z0-9]+)', 1)))))
    - 0.001::double * j, 9) as score from (select *, unnest(range(0, len(s))) as j from q)),
b as (select doc_id, nth, round(sum(score), 6) as total, arg_max(j, (score, -j)) as best from sc group by all)
select doc_id::varchar || ':' || nth::varchar as query_id, 't: evidence for relation ' || name || ' between ' || head || ' and ' || tail as query_text, r as relation, array_to_string(list_transform(ev, lambda e: e::varchar), '|') as relevant_local, len(s) as candidate_count, total, best
from q join b using (doc_id, nth)""")
def src_docred(spark, sf_dir):
    """Relations of documents: sentences part at full stops, entities are first words."""
    made = _relations(spark, sf_dir)
    best = F.array_max(F.transform("summary_scores", lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]
    total = F.round(F.aggregate("summary_scores", F.lit(0.0), lambda a, x: a + x), 6)
    return made.select("query_id", "query_text", "relation", F.array_join(F.transform("relevant_local", lambda e: _str(e)), "|").alias("relevant_local"), "candidate_count", total.alias("total"), (-best).alias("best"))


def _relations(spark, sf_dir):
    s = F.split("text", r"\.")
    first = lambda x: F.split_part(F.ltrim(x), F.lit(" "), F.lit(1))
    at = F.sequence(F.lit(0), F.least(F.size("s"), F.lit(3)) - 1)
    vertices = F.concat(F.transform(F.slice("s", 1, 3), lambda x: F.array(F.struct(F.lit("").alias("name")), F.struct(first(x).alias("name")))), F.array(F.array(F.struct(F.lit("e").alias("name")), F.struct(F.lit("en").alias("name")), F.struct(F.lit("fr").alias("name")))))
    label = lambda i: F.struct(i.alias("h"), F.least(F.size("s"), F.lit(3)).alias("t"), F.when(i % 2 == 0, "P1").otherwise(F.concat(F.lit("P"), _str(i))).alias("r"), F.array(i, i + 1, i + 1, F.lit(999)).alias("evidence"))
    docs = read(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").withColumn("s", s)
    raw = docs.select(_str("doc_id").alias("doc_id"), F.lit("dev").alias("split"), F.lit("t").alias("title"), F.transform("s", lambda x: F.split(x, " ")).alias("sents"), vertices.alias("vertexSet"), F.transform(at, label).alias("labels"))
    return S.load_docred(raw, spark.createDataFrame([("P1", "part of")], "r string, name string"))


def _bm(name: str, asked: str, pool: str, score: str) -> str:
    """CTEs up to ``name`` (qid, did, score): BM25 of ``asked`` (qid, text) in ``pool`` (qid, did, text)."""
    tokens = "regexp_extract_all(lower(text), '([a-z0-9]+)', 1)"
    return f"""{name}_dt as (select qid, did, {tokens} as t from {pool}), {name}_sz as (select qid, did, greatest(len(t), 1) as dl from {name}_dt), {name}_st as (select qid, count(*) as n, avg(dl) as avgdl from {name}_sz group by qid),
{name}_qt as (select qid, term, count(*) as qtf from (select qid, unnest({tokens}) as term from {asked}) group by all), {name}_tf as (select qid, did, term, count(*) as tf from (select qid, did, unnest(t) as term from {name}_dt) group by all),
{name}_met as (select * from {name}_tf join {name}_qt using (qid, term)), {name}_df as (select qid, term, count(*) as df from {name}_met group by all),
{name}_sc as (select qid, did, sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)))) as s
  from {name}_met join {name}_df using (qid, term) join {name}_sz using (qid, did) join {name}_st using (qid) group by all),
{name} as (select qid, did, round(coalesce(s, 0), 6) as {score} from {name}_sz left join {name}_sc using (qid, did))"""


_ORDER = "n, flag, p_name, p_type, p_brand, p_size"
_IN = _NORM.format("{}")


@query(f"""with {_LINES}, pl as (select o as qid, row_number() over (partition by o order by {_ORDER}) - 1 as did, p_name as title, p_name || '. ' || p_type || ' ' || p_brand as text, flag from l where p_size % 10 <> 0),
kept as (select distinct qid from pl where flag = 'R' and qid % 7 <> 0), pp as (select pl.* from pl join kept using (qid)),
qs as (select o as qid, coalesce(string_agg(p_type, ' ' order by {_ORDER}) filter (where flag = 'R'), '') as text, coalesce(string_agg(p_brand || ' ' || p_type, ' ' order by {_ORDER}) filter (where n <= 3 and p_size % 4 <> 0), '') as d from l where o in (select qid from kept) group by o),
qb as (select qid, trim(text || ' ' || d) as text from qs), pt as (select qid, did, title as text from pp),
st as (select o * 100 + row_number() over (partition by o order by {_ORDER}) as qid, o, p_brand || ' ' || p_type as text from l where n <= 3 and p_size % 4 <> 0 and o in (select qid from kept)), sp as (select st.qid, did, pp.text from st join pp on pp.qid = st.o),
{_bm("t", "qs", "pt", "t")}, {_bm("tb", "qb", "pt", "tb")}, {_bm("p", "qs", "pp", "p")}, {_bm("pb", "qb", "pp", "pb")}, {_bm("e", "st", "sp", "e")}, best as (select qid // 100 as qid, did, max(e) as best from e group by all),
tk as (select qid, did, list_distinct(regexp_extract_all(lower(title), '([a-z0-9]+)', 1)) as tt, list_distinct(regexp_extract_all(lower(qs.text), '([a-z0-9]+)', 1)) as qq, {_IN.format("title")} as nt, {_IN.format("qs.text")} as nq from pp join qs using (qid)),
ov as (select qid, did, round(case when len(tt) > 0 then len(list_intersect(qq, tt)) / len(tt) else 0 end + case when nt <> '' and contains(nq, nt) then 1 else 0 end, 6) as ov from tk),
a as (select qid, did, t + 0.5::double * ov as summary, tb, p, pb, coalesce(best, 0) as best from ov join t using (qid, did) join tb using (qid, did) join p using (qid, did) join pb using (qid, did) left join best using (qid, did)),
b as (select *, tb + 0.25::double * summary as decomp_title, p + 0.15::double * summary as paragraph from a), c as (select *, pb + 0.3::double * best + 0.15::double * paragraph as support_set from b),
v as (select qid, did, 'summary' as view, summary as s from c union all select qid, did, 'decomp_title', decomp_title from c union all select qid, did, 'paragraph', paragraph from c union all select qid, did, 'support_set', support_set from c union all select qid, did, 'full_context', pb + 0.2::double * support_set from c)
select 'm' || qid::varchar as qid, view, did, round(s, 12) as score, row_number() over (partition by qid, view order by round(s, 9) desc, did) as rank from v""")
def evidence_decomposed(spark, sf_dir):
    """Views of questions with sub-questions, on the loader's own rows."""
    raw = _lines(spark, sf_dir).select(
        F.concat(F.lit("m"), _str("o")).alias("id"), F.array_join(F.transform(F.filter("l", lambda x: x["flag"] == "R"), lambda x: x["p_type"]), " ").alias("question"), F.lit("a").alias("answer"), F.array().cast("array<string>").alias("answer_aliases"), (F.col("o") % 7 != 0).alias("answerable"),
        F.transform("l", lambda x: F.struct(x["n"].alias("idx"), x["p_name"].alias("title"), F.when(x["p_size"] % 10 == 0, " ").otherwise(F.concat_ws(" ", x["p_type"], x["p_brand"])).alias("paragraph_text"), (x["flag"] == "R").alias("is_supporting"))).alias("paragraphs"),
        F.transform(F.filter("l", lambda x: x["n"] <= 3), lambda x: F.struct(F.when(x["p_size"] % 4 == 0, "").otherwise(F.concat_ws(" ", x["p_brand"], x["p_type"])).alias("question"), x["p_brand"].alias("answer"), x["n"].alias("paragraph_support_idx"))).alias("question_decomposition"),
    )
    return E.decomposed_views(S.load_musique(raw)).select("qid", "view", "did", "score", "rank")


@query(f"""with {_DOC}, qs as (select doc_id * 10 + nth as qid, 't: evidence for relation ' || name || ' between ' || head || ' and ' || tail as text, * from (select doc_id, nth, s, head, tail, name from q)),
ln as (select qid, head, tail, name, j as did, s[j + 1] as text from (select *, unnest(range(0, len(s))) as j from qs)), {_bm("b", "qs", "ln", "bm")},
w as (select qid, did, round(2.0::double * ((head <> '' and contains(lower(text), lower(head)))::int + contains(lower(text), tail)::int) + 0.25::double * (len(list_intersect(list_distinct(regexp_extract_all(lower(name), '([a-z0-9]+)', 1)), list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1))))
  / greatest(1, len(list_distinct(regexp_extract_all(lower(name), '([a-z0-9]+)', 1))))) - 0.001::double * did, 9) as co from ln),
v as (select qid, did, 'summary' as view, -0.001::double * did as s from w union all select qid, did, 'co_mention', co from w union all select qid, did, 'evidence_sentences', bm from b)
select (qid // 10)::varchar || ':' || (qid % 10)::varchar as qid, view, did, round(s, 6) + 0.0::double as score, row_number() over (partition by qid, view order by round(s, 9) desc, did) as rank from v""")
def evidence_relations(spark, sf_dir):
    """Views of relations' evidence, on the loader's own rows."""
    return E.relation_views(_relations(spark, sf_dir)).select("qid", "view", "did", (F.round("score", 6) + 0.0).alias("score"), "rank")


@query("""with u as (select 'documents' as corpus, doc_id::varchar as did, text from documents union all select 'pages', page_id::varchar, html from pages union all select 'benchmark', item_id::varchar, text from benchmark),
c as (select corpus, did, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) as text from u) select corpus, did, length(text) as chars from c where length(text) >= 20 order by md5('11:' || corpus || ':' || did), corpus, did limit 300""")
def src_corpora(spark, sf_dir):
    """Texts of several tables in one, sampled to a target."""
    one = lambda t, i, c: read(spark, sf_dir, t, i, c).select(F.col(i).alias("did"), F.col(c).alias("text"))
    parts = {"documents": one("documents", "doc_id", "text"), "pages": one("pages", "page_id", "html"), "benchmark": one("benchmark", "item_id", "text")}
    return S.mixed_corpus(parts, 300, 11, 20).select("corpus", "did", F.length("text").alias("chars"))


@query("""select 'p' || p_partkey::varchar as id, (p_size % 3 <> 0)::int + (p_partkey % 4 <> 0)::int + 1 as n, p_size % 3 + p_partkey % 4 + p_size + 0.0::double as total, p_brand as label from part""")
def src_planetoid(spark, sf_dir):
    """Content lines: an id, numbers and a label between tabs."""
    line = F.concat_ws("\t", F.concat(F.lit("p"), _str("p_partkey")), _str(F.col("p_size") % 3), _str(F.col("p_partkey") % 4), _str("p_size"), F.lit("0"), "p_brand")
    rows = S.content_rows(read(spark, sf_dir, "part").select(line.alias("value")))
    total = F.aggregate("features", F.lit(0.0), lambda a, f: a + f["value"])
    return rows.select("id", F.size("features").alias("n"), total.alias("total"), "label")
