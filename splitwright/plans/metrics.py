"""Ranking metrics, classifier metrics and signature queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from splitwright.operators import evaluation, ranking, signatures
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, rounded, sql_input, table


def _lists(spark, sf_dir):
    return derived(spark, sf_dir, I.SCORE_LISTS)


def _logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double") * 10.0).alias("logits")
    )


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("label").alias("cell"), F.transform("embedding", lambda x: x.cast("double")).alias("vector")
    )


def _scalar(operator):
    return lambda spark, sf_dir: rounded(operator(_lists(spark, sf_dir)), 4)


def _per_list(operator):
    return lambda spark, sf_dir: rounded(operator(_lists(spark, sf_dir)))


def _undefined_as_null(df, column):
    return df.withColumn(column, F.when(~F.isnan(column), F.col(column)))


def cross_entropy(spark, sf_dir):
    return rounded(ranking.cross_entropy(_logits(spark, sf_dir)))


def homophily(spark, sf_dir):
    return rounded(ranking.homophily(_vectors(spark, sf_dir)), 4)


def squared_error_and_homophily(spark, sf_dir):
    return rounded(ranking.squared_error_and_homophily(_lists(spark, sf_dir), _vectors(spark, sf_dir)), 4)


def gate_routing(spark, sf_dir):
    return rounded(ranking.gate_routing(_logits(spark, sf_dir), 2))


def top_gate_weights(spark, sf_dir):
    rows = ranking.top_gate_weights(_logits(spark, sf_dir), 2)
    pair = F.inline(F.arrays_zip("experts", "weights"))
    return rounded(rows.select("vec_id", pair).select("vec_id", F.col("experts").cast("long").alias("expert"), F.col("weights").alias("weight")))


def routing_balance(spark, sf_dir):
    return rounded(ranking.routing_balance(ranking.gate_routing(_logits(spark, sf_dir), 2)))


def classifier_metrics(spark, sf_dir):
    return rounded(evaluation.classifier_metrics(derived(spark, sf_dir, I.CLASSIFIER_SCORES)))


def seed_summary(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("value"))
    return rounded(evaluation.seed_summary(runs, ["o_orderpriority"]), 4)


def _pair_score(vector):
    """Sum of the even positions less the sum of the odd ones."""
    return F.aggregate(vector, F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("f")), lambda a, x: F.struct((a["s"] + a["f"] * x).alias("s"), (-a["f"]).alias("f")))["s"]


def bootstrap_means(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", _pair_score("vector").alias("gain"))
    return rounded(evaluation.bootstrap_means(rows, "vec_id", "gain"))


def bootstrap_interval(spark, sf_dir):
    return rounded(evaluation.bootstrap_interval(bootstrap_means(spark, sf_dir)))


_LEVELS = ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")


def severity_trend(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("severity"), F.col("o_totalprice").alias("score"))
    return rounded(evaluation.severity_trend(rows, _LEVELS), 4)


def severity_monotone(spark, sf_dir):
    return evaluation.is_monotone(severity_trend(spark, sf_dir))


def _means(spark, sf_dir):
    return signatures.replicate_mean(_vectors(spark, sf_dir), ["cell"])


def replicate_means(spark, sf_dir):
    return rounded(_means(spark, sf_dir).select("cell", F.posexplode("vector").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")))


def measured_grid(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), "n_name")
    grid = signatures.measured_grid(wanted, _means(spark, sf_dir), ["cell"])
    return grid.select("n_name", F.col("vector").isNotNull().alias("measured"))


def _differential(spark, sf_dir):
    return signatures.differential(_vectors(spark, sf_dir).select("vec_id", "cell", "vector"), _means(spark, sf_dir))


def differential_vectors(spark, sf_dir):
    long = _differential(spark, sf_dir).select("vec_id", F.posexplode("vector").alias("pos", "value"))
    return rounded(long.withColumn("pos", F.col("pos").cast("long")))


def top_dimensions(spark, sf_dir):
    top = signatures.top_dimensions(_vectors(spark, sf_dir).select("vec_id", "vector"), 5)
    return top.select("vec_id", F.posexplode("top").alias("place", "pos")).select(
        "vec_id", F.col("place").cast("long").alias("place"), F.col("pos").cast("long").alias("pos")
    )


def _agreement(spark, sf_dir):
    noise = (F.col("vec_id") % 7).cast("double") / 10.0
    pairs = _vectors(spark, sf_dir).select(
        "cell", F.col("vector").alias("a"), F.transform("vector", lambda x, i: x * 0.5 + noise * (i % 4)).alias("b")
    )
    return signatures.agreement_per_cell(pairs)


def signature_agreement(spark, sf_dir):
    return rounded(_agreement(spark, sf_dir))


def agreement_gate(spark, sf_dir):
    return rounded(signatures.agreement_gate(_agreement(spark, sf_dir)))


def _confounded(spark, sf_dir):
    return signatures.confounded_dimensions(_vectors(spark, sf_dir), "label")


def confounded_dimensions(spark, sf_dir):
    return rounded(_confounded(spark, sf_dir).select("pos", "r"))


def masked_vectors(spark, sf_dir):
    masked = signatures.mask_dimensions(_vectors(spark, sf_dir).select("vec_id", "vector"), _confounded(spark, sf_dir))
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    return rounded(masked.select("vec_id", total.alias("kept_sum"), "masked_mean"))


def top_attributions(spark, sf_dir):
    return rounded(signatures.top_attributions(_vectors(spark, sf_dir), 200).withColumn("pos", F.col("pos").cast("long")))


QUERIES = {
    "mean_squared_error": _scalar(ranking.mean_squared_error),
    "cross_entropy": cross_entropy,
    "ranknet": _scalar(ranking.ranknet),
    "ranknet_per_list": _per_list(ranking.ranknet_per_list),
    "listnet": _scalar(ranking.listnet),
    "listmle": _scalar(ranking.listmle),
    "listmle_per_list": _per_list(ranking.listmle_per_list),
    "rank_cosine": _scalar(ranking.rank_cosine),
    "approximate_ndcg": _scalar(ranking.approximate_ndcg),
    "approximate_ndcg_per_list": _per_list(ranking.approximate_ndcg_per_list),
    "squared_error_and_cosine": _scalar(ranking.squared_error_and_cosine),
    "pearson_per_list": _per_list(lambda rows: _undefined_as_null(ranking.pearson_per_list(rows), "r")),
    "negative_pearson_strict": _scalar(lambda rows: _undefined_as_null(ranking.negative_pearson(rows), "value")),
    "negative_pearson": _scalar(lambda rows: ranking.negative_pearson(rows, skip_undefined=True)),
    "homophily": homophily,
    "squared_error_and_homophily": squared_error_and_homophily,
    "gate_routing": gate_routing,
    "top_gate_weights": top_gate_weights,
    "routing_balance": routing_balance,
    "classifier_metrics": classifier_metrics,
    "seed_summary": seed_summary,
    "bootstrap_means": bootstrap_means,
    "bootstrap_interval": bootstrap_interval,
    "severity_trend": severity_trend,
    "severity_monotone": severity_monotone,
    "replicate_means": replicate_means,
    "measured_grid": measured_grid,
    "differential_vectors": differential_vectors,
    "top_dimensions": top_dimensions,
    "signature_agreement": signature_agreement,
    "agreement_gate": agreement_gate,
    "confounded_dimensions": confounded_dimensions,
    "masked_vectors": masked_vectors,
    "top_attributions": top_attributions,
}

_L = f"with lists as (select * from {sql_input(I.SCORE_LISTS)})"
_RANKNET = """, loss as (select a.list_id, sum((1 - sign(a.label - b.label)) * (a.pred - b.pred) / 2 + ln(1 + exp(-(a.pred - b.pred)))) as loss
  from lists a join lists b on a.list_id = b.list_id and a.pos < b.pos group by 1),
full_ as (select l.list_id, coalesce(s.loss, 0.0) as loss from (select distinct list_id from lists) l left join loss s using (list_id))
"""
_LISTNET = """, tops as (select list_id, max(label) as ml, max(pred) as mp from lists group by 1),
z as (select list_id, sum(exp(label - ml)) as zl, any_value(mp) + ln(sum(exp(pred - mp))) as lse from lists join tops using (list_id) group by 1),
loss as (select list_id, -sum(exp(label - ml) / zl * (pred - lse)) as loss from lists join tops using (list_id) join z using (list_id) group by 1)
"""
_LISTMLE = """, tops as (select list_id, max(pred) as mp from lists group by 1),
tails as (select list_id, pred, mp, sum(exp(pred - mp)) over (partition by list_id order by label desc, pos rows between current row and unbounded following) as tail
  from lists join tops using (list_id)),
loss as (select list_id, sum(ln(tail) + mp - pred) as loss from tails group by 1)
"""
_COSINE = """, loss as (select list_id, (1 - sum(label * pred) / greatest(sqrt(sum(label * label)) * sqrt(sum(pred * pred)), 1e-8)) / 0.5 as loss from lists group by 1)
"""
_NDCG = """, ranks as (select a.list_id, a.pos, any_value(a.label) as label,
    0.5 + sum(case when a.pred = b.pred then 0.0 else 1.0 / (1.0 + exp(50.0 * (a.pred - b.pred))) end) as rank
  from lists a join lists b on a.list_id = b.list_id group by 1, 2),
dcg as (select list_id, sum((pow(2.0, label) - 1) / log2(rank + 1)) as dcg from ranks group by 1),
ideal as (select list_id, sum((pow(2.0, label) - 1) / log2(place + 1)) as ideal from
  (select *, row_number() over (partition by list_id order by label desc, pos) as place from lists) group by 1),
nd as (select list_id, dcg / ideal as ndcg from dcg join ideal using (list_id))
"""
_PEARSON = """, per as (select list_id, case when min(label) = max(label) or min(pred) = max(pred) then 'nan'::double else corr(label, pred) end as r from lists group by 1)
"""
_VEC = "with v as (select vec_id, label, unnest(list_transform(embedding, lambda x: cast(x as double))) as x, unnest(range(0, len(embedding))) as pos from embeddings)"
_HOMOPHILY = f"""{_VEC}, dims as (select label, pos, sum(x) as s, sum(x * x) as q from v group by 1, 2),
counts as (select label, count(*) as n from embeddings group by 1),
parts as (select (select sum(pow(s, 2)) from (select sum(s) as s from dims group by pos)) as s_all, (select sum(pow(s, 2)) from dims) as s_class,
  (select sum(q) from dims) as q, (select sum(n * q) from (select label, sum(q) as q from dims group by 1) join counts using (label)) as nq,
  (select count(*) from embeddings) as n_all),
penalty as (select n_all * q - nq + s_all - s_class + 0.1 * sqrt(q) as value from parts)"""
_GATE = """with g as (select vec_id, list_transform(embedding, lambda x: cast(x as double) * 10.0) as l from embeddings),
e as (select vec_id, unnest(l) as x, unnest(range(0, 64)) as expert, list_max(l) as top from g),
p as (select *, exp(x - top) / sum(exp(x - top)) over (partition by vec_id) as p, row_number() over (partition by vec_id order by x desc, expert) as rk from e),
routing as (select expert, sum(p) as importance, count(*) filter (where rk <= 2) as load from p group by 1)
"""
_SCORES = f"""
with c as (select slice, score, sum(label) as pos, sum(1 - label) as neg from {sql_input(I.CLASSIFIER_SCORES)} group by 1, 2),
r as (select *, sum(pos) over w as pos_to, sum(neg) over w as neg_to, sum(pos) over (partition by slice) as P, sum(neg) over (partition by slice) as N
  from c window w as (partition by slice order by score rows unbounded preceding)),
m as (select slice, any_value(P) as np, any_value(N) as nn, sum(pos * (neg_to - neg + neg / 2.0)) as wins,
  sum(pos * (P - pos_to + pos) / (P - pos_to + pos + N - neg_to + neg)) as prec,
  coalesce(sum(pos) filter (where score >= 0.5), 0)::double as tp, coalesce(sum(neg) filter (where score >= 0.5), 0)::double as fp from r group by 1)
select slice, cast(np + nn as bigint) as n, cast(np as bigint) as n_pos, round(wins / (np::double * nn), 6) as auroc, round(prec / np, 6) as auprc,
  round((tp * (nn - fp) - fp * (np - tp)) / sqrt((tp + fp) * np * nn * (nn - fp + np - tp)), 6) as mcc,
  round((tp / np + (nn - fp) / nn) / 2, 6) as balanced_accuracy from m"""


def _sql_weight() -> str:
    total, cases = 0.0, []
    for k in range(16):
        total += math.exp(-1.0) / math.factorial(k)
        cases.append(f"when u < {total!r} then {k}")
    return "case " + " ".join(cases) + " else 16 end"


_BOOT = f"""
with rows_ as (select vec_id, (select sum(case when i % 2 = 0 then x else -x end) from (select unnest(list_transform(embedding, lambda x: cast(x as double))) as x, unnest(range(0, 64)) as i)) as v from embeddings),
u as (select b as resample, v, cast('0x' || substr(md5(cast(vec_id as varchar) || ':' || cast(b // 4 as varchar) || ':42'), (b % 4) * 8 + 1, 8) as bigint) / 4294967296.0 as u
  from rows_, range(10000) t(b)),
w as (select resample, v, {_sql_weight()} as w from u),
means as (select resample, round(sum(w * v) / sum(w), 6) as mean from w group by 1)
"""
_TREND = """
with lv as (select severity, level from (values ('5-LOW', 1), ('4-NOT SPECIFIED', 2), ('3-MEDIUM', 3), ('2-HIGH', 4), ('1-URGENT', 5)) t(severity, level)),
m as (select cast(level as bigint) as level, severity, avg(o_totalprice) as mean_score, count(*) as n from orders join lv on o_orderpriority = severity group by 1, 2),
trend as (select level, severity, round(mean_score, 4) as mean_score, n, coalesce(mean_score > lag(mean_score) over (order by level), true) as rising from m)
"""
_MEANS = f"{_VEC}, means as (select label as cell, pos, avg(x) as m from v group by 1, 2)"
_AGREE = f"""{_VEC}, ab as (select label as cell, pos, x as a, x * 0.5 + (vec_id % 7) / 10.0 * (pos % 4) as b from v),
r as (select cell, pos, corr(a, b) as r from ab group by 1, 2 having min(a) <> max(a) and min(b) <> max(b)),
cells as (select cell, avg(r) as mean_r, count(*) as n_dims from r group by 1)
"""
_CONF = f"""{_VEC}, r as (select pos, corr(x, label) as r from v group by 1),
top as (select pos, r from r order by abs(r) desc, pos limit (select cast(floor(count(*) * 0.10) as bigint) from r))
"""
SQL = {
    "mean_squared_error": _L + " select round(avg(pow(pred - label, 2)), 4) as value from lists",
    "cross_entropy": """
with g as (select label, list_transform(embedding, lambda x: cast(x as double) * 10.0) as l from embeddings)
select round(avg(ln(list_sum(list_transform(l, lambda x: exp(x)))) - l[label + 1]), 6) as value from g""",
    "ranknet": _L + _RANKNET + "select round(sum(loss), 4) as value from full_",
    "ranknet_per_list": _L + _RANKNET + "select list_id, round(loss, 6) as loss from full_",
    "listnet": _L + _LISTNET + "select round(avg(loss), 4) as value from loss",
    "listmle": _L + _LISTMLE + "select round(avg(loss), 4) as value from loss",
    "listmle_per_list": _L + _LISTMLE + "select list_id, round(loss, 6) as loss from loss",
    "rank_cosine": _L + _COSINE + "select round(sum(loss), 4) as value from loss",
    "approximate_ndcg": _L + _NDCG + "select round(-avg(ndcg), 4) as value from nd",
    "approximate_ndcg_per_list": _L + _NDCG + "select list_id, round(ndcg, 6) as ndcg from nd",
    "squared_error_and_cosine": _L + _COSINE
    + "select round((select avg(pow(pred - label, 2)) from lists) + (select sum(loss) from loss), 4) as value",
    "pearson_per_list": _L + _PEARSON + "select list_id, case when isnan(r) then null else round(r, 6) end as r from per",
    "negative_pearson_strict": _L + _PEARSON + "select case when count(*) filter (where isnan(r)) > 0 then null else round(-sum(r), 4) end as value from per",
    "negative_pearson": _L + _PEARSON + "select round(-sum(r), 4) as value from per where not isnan(r)",
    "homophily": _HOMOPHILY + " select round(value, 4) as value from penalty",
    "squared_error_and_homophily": _HOMOPHILY
    + f" select round((select avg(pow(pred - label, 2)) from {sql_input(I.SCORE_LISTS)}) + 0.5 * value, 4) as value from penalty",
    "gate_routing": _GATE + "select expert, round(importance, 6) as importance, load from routing",
    "top_gate_weights": _GATE
    + "select vec_id, expert, round(exp(x - top) / sum(exp(x - top)) over (partition by vec_id), 6) as weight from p where rk <= 2",
    "routing_balance": _GATE
    + "select round(stddev_samp(importance) / (avg(importance) + 1e-6) + stddev_samp(load) / (avg(load) + 1e-6), 6) as value from routing",
    "classifier_metrics": _SCORES,
    "seed_summary": """
with runs as (select o_orderpriority, o_orderstatus, avg(o_totalprice) as value from orders group by 1, 2)
select o_orderpriority, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, count(*) as n_seeds, count(*) >= 3 as enough from runs group by 1""",
    "bootstrap_means": _BOOT + "select * from means",
    "bootstrap_interval": _BOOT
    + "select round(avg(mean), 6) as mean, round(quantile_cont(mean, 0.025), 6) as low, round(quantile_cont(mean, 0.975), 6) as high from means",
    "severity_trend": _TREND + "select * from trend",
    "severity_monotone": _TREND + "select bool_and(rising) as monotone from trend",
    "replicate_means": _MEANS + " select cell, pos, round(m, 6) as value from means",
    "measured_grid": "select n_name, n_nationkey in (select label from embeddings) as measured from nation",
    "differential_vectors": _MEANS
    + " select vec_id, v.pos, round(x - m, 6) as value from v join means on v.label = means.cell and v.pos = means.pos",
    "top_dimensions": _VEC
    + """ select vec_id, place, pos from (select vec_id, pos, row_number() over (partition by vec_id order by abs(x) desc, pos) - 1 as place from v) where place < 5""",
    "signature_agreement": _AGREE + "select cell, round(mean_r, 6) as mean_r, n_dims from cells",
    "agreement_gate": _AGREE
    + """select 'signature_agreement' as gate, round(avg(mean_r), 6) as value, '>= 0.3' as threshold, avg(mean_r) >= 0.3 as passed,
  case when avg(mean_r) >= 0.3 then 'pass' else 'fail' end as status from cells""",
    "confounded_dimensions": _CONF + "select pos, round(r, 6) as r from top",
    "masked_vectors": _CONF
    + """select vec_id, round(sum(case when t.pos is null then x else 0.0 end), 6) as kept_sum, round(avg(x) filter (where t.pos is not null), 6) as masked_mean
  from v left join top t on v.pos = t.pos group by 1""",
    "top_attributions": _VEC + " select pos, round(avg(abs(x)), 6) as mean_abs from v group by 1 order by avg(abs(x)) desc, pos limit 200",
}
