"""Split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitwright.operators import splits
from splitwright.plans import inputs as I
from splitwright.plans.inputs import derived, rounded, sql_input, table


def _documents(spark, sf_dir):
    return derived(spark, sf_dir, I.GROUPED_DOCUMENTS)


def _orders(spark, sf_dir):
    return derived(spark, sf_dir, I.GROUPED_ORDERS)


def _orders_split(spark, sf_dir):
    return splits.group_split(_orders(spark, sf_dir), seed=None)


def group_table(spark, sf_dir):
    return splits.group_table(_orders(spark, sf_dir), "id", "group_key", "label")


def group_split(spark, sf_dir):
    return splits.group_split(_documents(spark, sf_dir), seed=None).select("id", "group_key", "split")


def group_split_orders(spark, sf_dir):
    return _orders_split(spark, sf_dir).select("id", "split")


def group_split_seeded(spark, sf_dir):
    return splits.group_split(_orders(spark, sf_dir), seed=42).select("id", "split")


def group_split_wide_test(spark, sf_dir):
    return splits.group_split(_documents(spark, sf_dir), fractions=(0.75, 0.10, 0.15), seed=None).select("id", "split")


def group_split_external_ratio(spark, sf_dir):
    return splits.group_split(_documents(spark, sf_dir), fractions=(0.70, 0.10, 0.20), seed=None).select("id", "split")


def class_balance(spark, sf_dir):
    return rounded(splits.class_balance(_orders_split(spark, sf_dir)))


def balance_spread(spark, sf_dir):
    return rounded(splits.rate_spread(splits.class_balance(_orders_split(spark, sf_dir))))


def overlapping_ids(spark, sf_dir):
    """The group split is disjoint; adding a second assignment by order status makes overlaps."""
    first = _orders_split(spark, sf_dir).select("id", "split")
    status = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "test").otherwise("train").alias("split")
    )
    return splits.overlapping_ids(splits.check_disjoint(first).unionByName(status))


def test_group_keys(spark, sf_dir):
    return splits.split_keys(_orders_split(spark, sf_dir))


def held_out_items(spark, sf_dir):
    return splits.held_out(_orders_split(spark, sf_dir), "measured").select("id", "group_key")


def external_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "test").otherwise("train").alias("split"),
    )
    adopted = splits.external_split(rows, "o_orderkey")
    return adopted.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def replicated_flags(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        (F.col("label") % 2).alias("label"), F.transform(F.slice("embedding", 1, 50), lambda x: x > 0).alias("split_flags")
    )
    return rounded(splits.flag_balance(vectors).withColumn("split_no", F.col("split_no").cast("long")))


def one_replicated_flag(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform(F.slice("embedding", 1, 50), lambda x: x > 0).alias("split_flags")
    )
    return splits.flag_rows(vectors, 7).select("vec_id", "side")


QUERIES = {
    "group_table": group_table,
    "group_split": group_split,
    "group_split_orders": group_split_orders,
    "group_split_seeded": group_split_seeded,
    "group_split_wide_test": group_split_wide_test,
    "group_split_external_ratio": group_split_external_ratio,
    "class_balance": class_balance,
    "balance_spread": balance_spread,
    "overlapping_ids": overlapping_ids,
    "test_group_keys": test_group_keys,
    "held_out_items": held_out_items,
    "external_split": external_split,
    "replicated_flags": replicated_flags,
    "one_replicated_flag": one_replicated_flag,
}


# ---- SQL checks: the greedy pass as a recursive query ----


def _cost(split: str) -> str:
    f, p, t, q = f"w.f_{split}", f"w.p_{split}", f"t.t_{split}", f"t.q_{split}"
    return (
        f"(pow(greatest(0, {t} - {f} - g.size), 2)"
        f" + case when {f} + g.size > {t} then 10.0 * t.n * t.n * ({f} + g.size - {t}) else 0 end"
        f" + pow({p} + g.positives - {q}, 2))"
    )


def _wins(split: str, other: str, seed: int | None) -> str:
    """Condition that ``split`` is taken before ``other``."""
    if seed is None:
        return f"c_{split} <= c_{other}" if split < other else f"c_{split} < c_{other}"
    tie = f"md5('{seed}:' || key || ':{split}') < md5('{seed}:' || key || ':{other}')"
    return f"(c_{split} < c_{other} or c_{split} = c_{other} and {tie})"


def sql_greedy(groups: str, key: str, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int | None = None) -> str:
    """CTEs ``ordered, totals, walk``: one row per group with its ``split``.

    Ties take the first name or, with a seed, the smallest MD5 of seed, key and name.
    """
    a, b = fractions[0], fractions[1]
    targets = ", ".join(
        f"cast(round_even({c} * {a}, 0) as bigint) as {x}_train, cast(round_even({c} * {b}, 0) as bigint) as {x}_val, "
        f"{c} - cast(round_even({c} * {a}, 0) as bigint) - cast(round_even({c} * {b}, 0) as bigint) as {x}_test"
        for c, x in (("n", "t"), ("p", "q"))
    )
    adds = ", ".join(
        f"{v}_{s} + case when pick = '{s}' then {d} else 0 end" for v, d in (("f", "size"), ("p", "positives")) for s in ("train", "val", "test")
    )
    return f"""
ordered as (select {key} as key, cast(size as bigint) as size, cast(positives as bigint) as positives,
  row_number() over (order by size desc, {key}) as rn from {groups}),
sums as (select cast(sum(size) as bigint) as n, cast(sum(positives) as bigint) as p from ordered),
totals as (select n, {targets} from sums),
walk(rn, key, split, f_train, f_val, f_test, p_train, p_val, p_test) as (
  select cast(0 as bigint), (select min(key) from ordered), '', cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint), cast(0 as bigint)
  union all
  select rn, key, pick, {adds} from (
    select *, case when {_wins('test', 'train', seed)} and {_wins('test', 'val', seed)} then 'test'
      when {_wins('train', 'val', seed)} then 'train' else 'val' end as pick
    from (
      select g.rn, g.key, g.size, g.positives, w.f_train, w.f_val, w.f_test, w.p_train, w.p_val, w.p_test,
        {_cost('test')} as c_test, {_cost('train')} as c_train, {_cost('val')} as c_val
      from walk w join ordered g on g.rn = w.rn + 1 cross join totals t))),
placed as (select key, split from walk where rn > 0)"""


_OWN = "case when coalesce(group_key, '') = '' then '_acyclic_' || cast(id as varchar) else group_key end"


def sql_group_split(source: str, fractions: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int | None = None) -> str:
    return f"""
with recursive items as (select *, {_OWN} as g from {source}),
grouped as (select g, count(*) as size, sum(label) as positives from items group by 1),
{sql_greedy('grouped', 'g', fractions, seed)},
assigned as (select i.*, p.split from items i join placed p on i.g = p.key)
"""


_DOCS, _ORDERS = sql_input(I.GROUPED_DOCUMENTS), sql_input(I.GROUPED_ORDERS)
_ORDER_SPLIT = sql_group_split(_ORDERS)
_BALANCE = """bal as (select s as split, coalesce(sum(label) / count(id), 0.0) as rate, coalesce(sum(label), 0) as n_pos, count(id) as n_total
  from (values ('train'), ('val'), ('test')) v(s) left join assigned a on a.split = v.s group by 1)
"""
SQL = {
    "group_table": f"select {_OWN} as group_key, count(*) as size, cast(sum(label) as bigint) as positives from {_ORDERS} group by 1",
    "group_split": sql_group_split(_DOCS) + "select id, group_key, split from assigned",
    "group_split_orders": _ORDER_SPLIT + "select id, split from assigned",
    "group_split_seeded": sql_group_split(_ORDERS, seed=42) + "select id, split from assigned",
    "group_split_wide_test": sql_group_split(_DOCS, (0.75, 0.10, 0.15)) + "select id, split from assigned",
    "group_split_external_ratio": sql_group_split(_DOCS, (0.70, 0.10, 0.20)) + "select id, split from assigned",
    "class_balance": _ORDER_SPLIT + "," + _BALANCE + "select split, round(rate, 6) as rate, cast(n_pos as bigint) as n_pos, n_total from bal",
    "balance_spread": _ORDER_SPLIT + "," + _BALANCE
    + "select round(max(rate) - min(rate), 6) as spread, max(rate) - min(rate) <= 0.05 as stratified from bal",
    "overlapping_ids": _ORDER_SPLIT
    + """, both_ as (select id, split from assigned union all
  select o_orderkey, case when o_orderstatus = 'F' then 'test' else 'train' end from orders)
select id, min(split) as first_split, max(split) as last_split from both_ group by 1 having count(distinct split) > 1""",
    "test_group_keys": _ORDER_SPLIT + "select distinct group_key from assigned where split = 'test' and group_key <> ''",
    "held_out_items": _ORDER_SPLIT + "select id, group_key from assigned where split = 'test' and not measured",
    "external_split": """
select case o_orderstatus when 'F' then 'val' when 'O' then 'test' else 'train' end as split, count(*) as n,
  min(cast(o_orderkey as varchar)) as first_id from orders group by 1""",
    "replicated_flags": """
with f as (select label % 2 as y, unnest(list_transform(embedding[1:50], lambda x: x > 0)) as in_train,
  unnest(range(0, 50)) as split_no from embeddings)
select split_no, in_train, cast(sum(y) as bigint) as n_pos, count(*) as n_total, round(avg(y), 6) as rate from f group by 1, 2""",
    "one_replicated_flag": "select vec_id, case when embedding[8] > 0 then 'train' else 'test' end as side from embeddings",
}
