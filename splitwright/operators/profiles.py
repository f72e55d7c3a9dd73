"""Profile vectors: lookup in a profile store, alignment, and per-dimension validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitwright.functions.ids import content_key, parse_profile_id
from splitwright.functions.names import name_key, spread_key, with_computed
from splitwright.functions.numbers import to_number
from splitwright.operators.checks import SchemaError, require_columns
from splitwright.operators.dedupe import first_rows, keep_last
from splitwright.operators.scan import dense_row_number
from splitwright.session import lookup_side

# Columns of the profile table, in this order.
PROFILE_TABLE_COLUMNS = [
    "profile_id", "compound_name", "brd_id", "cell_id", "time_h", "dose_str", "dose_um", "structure",
    "label", "severity", "tuple_key",
]


#: Bits of the sketch of probed ids (8 MB in all), and of one of its rows.
PROBE_BITS, PROBE_ROW_BITS = 1 << 26, 32_768


def _probe_place(id_: Column) -> tuple[Column, Column]:
    """Row and bit of an id in the sketch."""
    place = F.pmod(F.xxhash64(id_.cast("string")), F.lit(PROBE_BITS))
    return F.floor(place / PROBE_ROW_BITS).cast("int"), place % PROBE_ROW_BITS


def probe_sketch(ids: DataFrame, id_col: str) -> DataFrame:
    """``_row, _bits``: a bit for the hash of every id, at most 2,048 rows of 4 kB whatever the number of ids."""
    row, bit = _probe_place(F.col(id_col))
    places = ids.where(F.col(id_col).isNotNull()).select(row.alias("_row"), bit.alias("_bit")).distinct()
    return places.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def probed_sides(store: DataFrame, store_col: str, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``store`` whose id may be among ``ids``, and those whose id certainly is not. Nothing of ``store`` is shuffled.

    Semi and anti joins go below what computes the other columns, so each side computes these for its own rows only.
    """
    row, bit = _probe_place(F.col(f"s.{store_col}"))
    byte = F.conv(F.hex(F.substring("k._bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1
    # the bound of the sketch makes it safe to broadcast
    sketch = F.broadcast(probe_sketch(ids, id_col)).alias("k")
    return tuple(store.alias("s").join(sketch, (row == F.col("k._row")) & hit, how) for how in ("left_semi", "left_anti"))


def probed_rows(store: DataFrame, store_col: str, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``store`` whose id may be among ``ids``, before anything of them is shuffled.

    No row of an id in ``ids`` is lost; others pass with the share of set bits, one in a hundred at 670,000 ids.
    """
    return probed_sides(store, store_col, ids, id_col)[0]


def lookup_profiles(queries: DataFrame, store: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """Every query row with the stored vector ``data`` and ``found``.

    ``store`` holds ``colid, data`` (and ``src_row`` when ids may repeat; the last row wins). Repeated
    query ids stay repeated; the source order is the caller's ``src_row``. Null ids are not found and are spread over
    all tasks. Only store rows that :func:`probed_rows` lets through travel with their vectors.
    """
    require_columns(store, ["colid", "data"], "store")
    probed = probed_rows(store.select("colid", "data", *(c for c in store.columns if c == "src_row")), "colid", queries, id_col)
    if "src_row" in probed.columns:
        probed = keep_last(probed, "colid")
    found = lookup_side(probed.select(F.col("colid").cast("string").alias("_c"), "data", F.lit(True).alias("_hit")))
    key = spread_key(F.col(id_col).cast("string"), F.struct(*queries.columns))
    joined = queries.withColumn("_key", key).join(found, F.col("_key") == F.col("_c"), "left")
    return joined.select(*queries.columns, "data", F.coalesce("_hit", F.lit(False)).alias("found"))


def missing_ids(queries: DataFrame, store: DataFrame, id_col: str = "profile_id") -> DataFrame:
    ids = store.select(F.col("colid").cast("string").alias("_c")).where(F.col("_c").isNotNull())
    key = spread_key(F.col(id_col).cast("string"), F.struct(*queries.columns))
    missed = queries.withColumn("_key", key).join(ids, F.col("_key") == F.col("_c"), "left_anti")
    return missed.select(*queries.columns)


def miss_rate(looked_up: DataFrame) -> DataFrame:
    rate = F.coalesce(F.avg((~F.col("found")).cast("double")), F.lit(0.0))
    return looked_up.agg(
        F.count(F.lit(1)).alias("n_input"),
        F.count_if("found").alias("n_found"),
        F.count_if(~F.col("found")).alias("n_missing"),
        rate.alias("miss_rate"),
    )


def align_by_row(left: DataFrame, right: DataFrame, position: str = "row_idx", allow_longer: bool = True) -> DataFrame:
    """Join two equally ordered tables on an explicit dense position.

    The left table may be the longer one when ``allow_longer``; a shorter one is an error.
    """
    n_left, n_right = left.count(), right.count()
    if n_left < n_right or (n_left != n_right and not allow_longer):
        raise SchemaError(f"cannot align {n_left} rows with {n_right} rows by position")
    return right.join(left, position)


def identified_profiles(profile_rows: DataFrame, ids: DataFrame, order_by: str = "src_row") -> DataFrame:
    """``row_idx, profile_id, name, label, expressions, split_flags``: a profile set and a list of ids, row by row.

    Both are numbered in their own order first, so the numbers in ``order_by`` may have gaps. Profiles beyond
    the last id are left out; more ids than profiles are an error. Ids that the set has itself are not used.
    """
    numbered = dense_row_number(profile_rows.drop("profile_id"), [order_by]).drop(order_by)
    listed = dense_row_number(ids.select(order_by, "profile_id"), [order_by]).drop(order_by)
    rows = align_by_row(numbered.withColumnRenamed("compound_name", "name"), listed)
    return rows.select("row_idx", "profile_id", "name", F.col("label").cast("int").alias("label"), "expressions", "split_flags")


def dimension_correlation(pairs: DataFrame, a: str = "a", b: str = "b", by: tuple[str, ...] = ()) -> DataFrame:
    """Pearson correlation per vector position: ``pos, r, n``; NaN where one side is constant.

    The vectors explode inside the scan stage and are summed per position before the shuffle, which
    carries one row per position and task.
    """
    x, y = F.col("z")["x"].cast("double"), F.col("z")["y"].cast("double")
    zipped = F.zip_with(a, b, lambda u, v: F.struct(u.alias("x"), v.alias("y")))
    long = pairs.select(*by, F.posexplode(zipped).alias("pos", "z")).select(
        *by, "pos", x.alias("x"), y.alias("y")
    )
    moments = long.groupBy(*by, "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("x", "y").alias("cov"),
        (F.stddev_pop("x") * F.stddev_pop("y")).alias("scale"),
        ((F.min("x") == F.max("x")) | (F.min("y") == F.max("y"))).alias("constant"),
    )
    r = F.when(F.col("constant"), F.lit(float("nan"))).otherwise(F.try_divide("cov", "scale"))
    return moments.select(*by, F.col("pos").cast("long").alias("pos"), F.coalesce(r, F.lit(float("nan"))).alias("r"), "n")


def correlation_summary(correlations: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Mean, median and count below the threshold over the finite correlations.

    The input has one row per vector position, so the exact median is small work.
    """
    finite = correlations.where(~F.isnan("r"))
    return finite.agg(
        F.avg("r").alias("mean_r"),
        F.median("r").alias("median_r"),
        F.count_if(F.col("r") < threshold).alias("n_low"),
        F.count(F.lit(1)).alias("n_finite"),
    )


def parse_profile_ids(rows: DataFrame, id_col: str = "profile_id") -> DataFrame:
    """Rows with the parts of their composite id; ``id_ok`` marks the rows that follow the layout."""
    # inline turns the struct into columns once, instead of once per use
    return rows.select("*", F.inline(F.array(parse_profile_id(F.col(id_col)))))


def _with_structure(resolved: DataFrame) -> DataFrame:
    return parse_profile_ids(resolved.where(F.col("matched") & F.col("canonical").isNotNull()))


def rejected_profiles(resolved: DataFrame) -> DataFrame:
    """``profile_id, name`` of resolved rows whose id does not follow the layout."""
    return _with_structure(resolved).where(~F.coalesce("id_ok", F.lit(False))).select("profile_id", "name")


def profile_table(resolved: DataFrame, strict: bool = True) -> DataFrame:
    """The 11 profile columns of resolved rows.

    ``resolved`` holds ``profile_id, name, canonical, severity, label, matched``; rows without a
    match leave. A wrong id layout is an error, or, if not ``strict``, goes to :func:`rejected_profiles`.
    """
    parsed = _with_structure(resolved)
    wrong = F.raise_error(F.concat(F.lit("cannot parse profile id "), F.col("profile_id")))
    if strict:
        checked = parsed.withColumn("profile_id", F.when(F.col("id_ok"), F.col("profile_id")).otherwise(wrong.cast("string")))
    else:
        checked = parsed.where("id_ok")
    return checked.select(
        "profile_id",
        F.col("name").alias("compound_name"),
        "brd_id",
        "cell_id",
        "time_h",
        "dose_str",
        F.coalesce(to_number(F.col("dose_str")), F.lit(float("nan"))).alias("dose_um"),
        F.col("canonical").alias("structure"),
        "label",
        F.coalesce("severity", F.lit("")).alias("severity"),
        content_key(F.col("canonical"), F.col("cell_id"), F.col("dose_str")).alias("tuple_key"),
    ).select(*PROFILE_TABLE_COLUMNS)


def label_disagreements(rows: DataFrame, registry: DataFrame, name_col: str = "name", label_col: str = "label") -> DataFrame:
    """Rows whose label differs from the registry label of the same name (last registry row wins)."""
    keyed = registry.select(name_key(F.col(name_col)).alias("_k"), F.col(label_col).alias("registry_label"), "src_row")
    last = lookup_side(keep_last(keyed.where(F.col("_k").isNotNull()), "_k").select("_k", "registry_label"))
    probe = with_computed(rows, "_k", name_key(F.col(name_col)))
    return probe.join(last, "_k").where(F.col(label_col) != F.col("registry_label")).select(*rows.columns, "registry_label")


def disagreement_report(disagreements: DataFrame, k: int = 10, name_col: str = "name") -> DataFrame:
    """The first ``k`` names in source order, repeats kept."""
    return first_rows(disagreements.select("src_row", name_col), k)


def vector_width_check(store: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One row ``min_width, max_width, n_dimensions, ok`` for a profile store and its dimension table."""
    widths = store.agg(F.min(F.size("data")).alias("min_width"), F.max(F.size("data")).alias("max_width"))
    tagged = widths.withColumn("n", F.lit(None).cast("long")).unionByName(
        dimensions.agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True
    )
    both = tagged.agg(
        F.max("min_width").alias("min_width"), F.max("max_width").alias("max_width"), F.max("n").alias("n_dimensions")
    )
    ok = (F.col("min_width") == F.col("n_dimensions")) & (F.col("max_width") == F.col("n_dimensions"))
    return both.withColumn("ok", F.coalesce(ok, F.lit(False)))


def with_flag_columns(profiles: DataFrame, width: int = 50, flags_col: str = "split_flags") -> DataFrame:
    """Spread the flag array over boolean columns ``split_00`` and so on."""
    return profiles.select("*", *[F.col(flags_col)[k].alias(f"split_{k:02d}") for k in range(width)]).drop(flags_col)


def position_values(vector: Column) -> Column:
    return F.posexplode(vector).alias("pos", "value")
