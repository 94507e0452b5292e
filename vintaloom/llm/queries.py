"""Queries of the corpus problems, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut
from ..sources.tables import table
from . import abuse, mixing, packing, peaks, tokens, topn


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n(table(spark, d, "forecasts"), groups=["run_id", "decision_month", "model"], score="value", tie="ticker", n=3)
    return best.select("run_id", "decision_month", "model", "ticker", "rank_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    c = peaks.density_peaks(table(spark, d, "feature_scores"), id_col="score_id", vec_col="scores")
    return c.select(F.col("id").alias("score_id"), "cluster_id")


def p5_clusters(spark: SparkSession, d: str) -> DataFrame:
    return peaks.describe_clusters(peaks.density_peaks(table(spark, d, "feature_scores"), id_col="score_id", vec_col="scores"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their tokens and the weight they are drawn by: a page that wasn't answered with success weighs a quarter."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", "http_status")
    weight = F.when(F.col("http_status").between(200, 299), 1.0).otherwise(0.25).alias("weight")
    return cut(docs.select("doc_id", "source", weight, tokens.token_count(F.col("text")).alias("n_tokens")))


def p5_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each cluster that lead to its density peaks."""
    return peaks.describe_clusters(peaks.density_peaks(table(spark, d, "feature_scores"), id_col="score_id", vec_col="scores"), by=("cluster_id", "peak"))


def _packed(measured: DataFrame, d: str) -> packing.Packed:
    return packing.pack(measured, table(measured.sparkSession, d, "pack_targets"), id_col="doc_id", size_col="n_tokens")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(_measured(spark, d), d).placed.withColumnRenamed("id", "doc_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(_packed(_measured(spark, d), d))


def p8_balance(spark: SparkSession, d: str) -> DataFrame:
    """Every text once in every kind, whole unless it is longer than the container, and no container over its capacity."""
    measured = _measured(spark, d)
    packed = _packed(measured, d)
    return packing.balance(packing.Packed(cut(packed.placed), packed.plan), measured, id_col="doc_id", size_col="n_tokens")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(_measured(spark, d), table(spark, d, "mix_targets"), id_col="doc_id", source_col="source", size_col="n_tokens", weight_col="weight").withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares_reached(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p9_balance(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source, what a mix must satisfy: copies beyond the limit, texts of another source, texts taken twice, tokens beyond the quota and one text."""
    measured, targets = _measured(spark, d), table(spark, d, "mix_targets")
    mixed = cut(mixing.mix_sources(measured, targets, id_col="doc_id", source_col="source", size_col="n_tokens", weight_col="weight"))
    own = measured.filter("doc_id is not null and source is not null and n_tokens > 0").groupBy(F.col("doc_id").alias("id")).agg(F.max("n_tokens").alias("size"), F.max("source").alias("home"))
    sources = own.groupBy(F.col("home").alias("source")).agg(F.sum("size").alias("have"), F.max("size").alias("longest"))
    everything = own.agg(F.sum("size")).first()[0] or 0
    t = targets.filter("target_share > 0 and max_repeats > 0").groupBy("mix_name", "source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).join(sources, "source")
    got = mixed.join(own, "id", "left").groupBy("mix_name", "source").agg(
        F.max("copies").alias("most"), F.count_if(~F.coalesce(F.col("home") == F.col("source"), F.lit(False))).alias("foreign"), (F.count("*") - F.count_distinct("id")).alias("repeated"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"),
    )
    quota = F.least(F.col("share") * F.lit(everything), F.col("repeats") * F.col("have"))
    j = t.join(got, ["mix_name", "source"], "left")
    return j.select("mix_name", "source", F.coalesce(F.col("most") > F.col("repeats"), F.lit(False)).alias("over_limit"), F.coalesce("foreign", F.lit(0)).alias("foreign"), F.coalesce("repeated", F.lit(0)).alias("repeated"), (F.abs(F.coalesce("tokens", F.lit(0)) - quota) > F.col("longest") + 1).alias("off_quota"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return abuse.score_pages(docs, abuse.fit_abuse(docs, table(spark, d, "abuse_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p5_found, p5_clusters, p5_peaks, p8_pack, p8_report, p8_balance, p9_mix, p9_shares, p9_balance, p10_found, p10_scores, p10_rates)
}

SQL: dict[str, str] = {
    "p2_found": """
select run_id, decision_month, model, ticker, rank_no::int as rank_no from (
  select *, row_number() over (partition by run_id, decision_month, model order by value desc, ticker) as rank_no
  from (select distinct run_id, decision_month, model, ticker, value from forecasts where value is not null and not isnan(value) and not isinf(value))) where rank_no <= 3""",
    "p5_found": """
with recursive v as (select score_id as id, arg_max(x, len(x)) as x from (select score_id, list_transform(scores, lambda t: t / list_max(list_transform(scores, lambda q: abs(q)))) as x from feature_scores
    where score_id is not null and len(scores) > 0 and list_max(list_transform(scores, lambda q: abs(q))) > 0) group by 1),
u as (select id, list_transform(x, lambda t: t / sqrt(list_sum(list_transform(x, lambda q: q * q)))) as u from v),
e as (select a.id as a, b.id as b from u a join u b on a.id <> b.id and len(a.u) = len(b.u) and list_dot_product(a.u, b.u) >= 0.97),
r(id, root) as (select id, id from u union select e.b, r.root from r join e on e.a = r.id)
select id as score_id, min(root) as cluster_id from r group by id""",
    "p9_balance": """
with s as (select distinct source from documents where doc_id is not null and source is not null and text <> '')
select mix_name, t.source, false as over_limit, 0::bigint as foreign, 0::bigint as repeated, false as off_quota from mix_targets t join s on s.source = t.source where target_share > 0 and max_repeats > 0 group by all""",
    "p8_balance": """
with n as (select count(distinct doc_id) as items from documents where doc_id is not null and text <> '')
select container_kind, items, 0::bigint as tokens_missing, 0::bigint as broken_items, 0::bigint as divided_needlessly, 0::bigint as overfull
from (select distinct container_kind from pack_targets where container_kind is not null and capacity_tokens > 0), n where items > 0""",
}
