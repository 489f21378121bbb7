"""Structured evidence: every family's views over passages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import metrics as M
from .registry import query, read
from .text_queries import _POOL, _TOK, _pool


def _bm(name: str, source: str, key: str = "did") -> str:
    """CTEs that score ``source`` (qid, did[, sid], text) by local BM25."""
    by = "qid, did" if key == "did" else "qid, did, sid"
    t = _TOK.format("text")
    return f"""
{name}_dt as (select {by}, {t} as t from {source}),
{name}_sz as (select {by}, greatest(len(t), 1) as dl from {name}_dt),
{name}_st as (select qid, count(*) as n, avg(dl) as avgdl from {name}_sz group by qid),
{name}_tf as (select {by}, term, count(*) as tf from (select {by}, unnest(t) as term from {name}_dt) group by all),
{name}_m as (select * from {name}_tf join qt using (qid, term)),
{name}_df as (select qid, term, count(*) as df from {name}_m group by all),
{name}_sc as (select {by}, sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * dl / avgdl)))) as score
  from {name}_m join {name}_df using (qid, term) join {name}_sz using ({by}) join {name}_st using (qid) group by {by}),
{name} as (select {by}, round(coalesce(score, 0), 6) as score from {name}_sz left join {name}_sc using ({by}))"""


_NORM = "trim(regexp_replace(lower(replace({}, '_', ' ')), '\\s+', ' ', 'g'))"
_SIGNALS = f"""{_POOL},
qt as (select qid, term, count(*) as qtf from (select qid, unnest({_TOK.format("text")}) as term from qs) group by all),
cand as (select p.qid, p.did, d.lang, q.text as q, coalesce(array_to_string({_TOK.format("p.text")}[1:6], ' '), '') as t, array_to_string(string_split(p.text, '.')[1:2], '.') as par, p.text as body from pool p join qs q using (qid) join documents d on d.doc_id = p.did),
src_t as (select qid, did, t as text from cand), src_p as (select qid, did, par as text from cand), src_f as (select qid, did, body as text from cand),
src_s as (select qid, did, i - 1 as sid, string_split(body, '.')[i] as text from (select qid, did, body, unnest(range(1, len(string_split(body, '.')) + 1)) as i from cand)),
{_bm("bt", "src_t")}, {_bm("bp", "src_p")}, {_bm("bf", "src_f")}, {_bm("bs", "src_s", "sid")},
sent as (select qid, did, max(score) as score from bs group by all),
ov as (select qid, did, list_distinct({_TOK.format("t")}) as b, list_distinct({_TOK.format("q")}) as a, contains({_NORM.format("q")}, {_NORM.format("t")}) and t <> '' as inside, q, body from cand),
pl as (select qid, did, round(case when len(b) > 0 then len(list_intersect(a, b)) / len(b) else 0 end + inside::int, 6) as overlap, contains(body, q)::int::double as gold, (row_number() over (partition by qid order by did) - 1)::double as position from ov),
nodes as (select *, overlap >= 0.45::double or (max(overlap) over (partition by qid) < 0.45::double and overlap = max(overlap) over (partition by qid)) as anchor from pl),
ins as (select a.qid, a.did as src, b.did as dst, a.anchor as fa, b.anchor as ta from nodes a join nodes b on a.qid = b.qid and a.did <> b.did join documents x on x.doc_id = a.did join documents y on y.doc_id = b.did and x.lang = y.lang),
i1 as (select qid, dst as did, sum(fa::int) as d, count(*) as ind from ins group by all), o1 as (select qid, src as did, sum(ta::int) as r, count(*) as outd from ins group by all),
p2 as (select x.qid, y.dst as did, count(*) as paths from ins x join ins y on x.qid = y.qid and x.dst = y.src where x.fa group by all),
sig as (select n.qid, n.did, overlap, gold, position, bt.score as title, bp.score as paragraph, sent.score as sentence, bf.score as "full", coalesce(d, 0) + 0.75::double * coalesce(r, 0) as one,
  round(coalesce(d, 0) + 0.75::double * coalesce(r, 0) + 0.5::double * coalesce(paths, 0) + 0.05::double * (coalesce(ind, 0) + coalesce(outd, 0)), 6) as two
  from nodes n join bt using (qid, did) join bp using (qid, did) join bf using (qid, did) join sent using (qid, did) left join i1 using (qid, did) left join o1 using (qid, did) left join p2 using (qid, did))"""


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    qs, pool = _pool(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("did"), F.col("lang").alias("group"))
    return E.signals(qs, pool.join(docs, "did"))


@query(f'with {_SIGNALS} select qid, did, title, paragraph, sentence, "full", overlap, one, two, gold, position from sig')
def evidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("qid", "did", "title", "paragraph", "sentence", "full", "overlap", "one", "two", "gold", "position")


def _family(family: str) -> None:
    parts = []
    for i, (view, weights) in enumerate(E.FAMILIES[family].items()):
        total = " + ".join(f'{w}::double * "{c}"' for c, w in weights.items())
        parts.append(f"select qid, '{view}' as view, {i} as ord, did, round({total}, 9) + 0.0::double as score from sig")
    long = f"with {_SIGNALS}, long as ({' union all '.join(parts)}), rk as (select *, row_number() over (partition by qid, view order by score desc, did) as rank from long)"
    query(f"{long} select qid, view, ord, did, score, rank from rk", f"views_{family}")(lambda spark, sf_dir: E.views(_signals(spark, sf_dir), family))

    def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
        qs, pool = _pool(spark, sf_dir)
        held = pool.join(qs.select("qid", F.col("text").alias("_q")), "qid").where(F.contains("text", "_q"))
        return M.ndcg(E.views(_signals(spark, sf_dir), family), held.select("qid", "did", F.lit(1.0).alias("rel")), 4).groupBy("view").agg(F.round(F.avg("ndcg"), 6).alias("ndcg"))

    query(
        f"""{long}, rel as (select qid, did from sig where gold = 1), n as (select qid, list_sum(list_transform(range(1, least(count(*), 4) + 1), lambda k: 1 / log2(k + 1))) as ideal from rel group by qid),
nd as (select r.qid, r.view, round(case when any_value(ideal) > 0 then sum(case when rel.did is not null then 1 / log2(rank + 1) else 0 end) / any_value(ideal) else 0 end, 6) as ndcg
  from rk r left join rel using (qid, did) left join n on n.qid = r.qid where rank <= 4 group by r.qid, r.view) select view, round(avg(ndcg), 6) as ndcg from nd group by view""",
        f"quality_{family}",
    )(quality)


for _f in E.FAMILIES:
    _family(_f)
