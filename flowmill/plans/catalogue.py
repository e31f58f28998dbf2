"""The library's queries over the driver's tables, each with the SQL that gives the same rows where SQL can.

Dirt is derived from the tables by the same expressions in both. Doubles whose last digits depend on the order of adding
are given as decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.expr import file_safe, finite_or_zero, is_label, number_of, plain_title, value_type
from flowmill.operators import balance, cleaning, correlation, dedup, evaluate, models, profile, sampling, schema
from flowmill.plans import assembly
from flowmill.sources.parts import write_numbered
from flowmill.sources.readers import file_counts, mark_missing, preview, raw_header, read_column_list, read_csv, read_csv_text, read_label_map, read_unique, row_counts
from flowmill.sources.sinks import report_text, run_folder, split_parts, write_by_class, write_csv, write_label_map, write_parts
from flowmill.storage import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dec(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(24,7)")


def decimals(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[dec(n).alias(n) if n in names else F.col(n) for n in df.columns])


# Events with missing, infinite, negative and text cells.

DIRTY = """
with dirty as (
  select event_id, user_id, event_type,
    case when event_id % 10 = 0 then null when event_id % 97 = 0 then 'inf'::double when event_id % 13 = 0 then -value else value end as value,
    case when event_id % 17 = 0 then 'abc' when event_id % 19 = 0 then 'inf' when event_id % 23 = 0 then null when event_id % 29 = 0 then '2.5' else cast(event_id % 50 as varchar) end as text_value
  from events
)
"""


def dirty_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    value = F.when(n % 10 == 0, None).when(n % 97 == 0, float("inf")).when(n % 13 == 0, -F.col("value")).otherwise(F.col("value"))
    text = F.when(n % 17 == 0, "abc").when(n % 19 == 0, "inf").when(n % 23 == 0, None).when(n % 29 == 0, "2.5").otherwise((n % 50).cast("string"))
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", value.alias("value"), text.alias("text_value"))


TWICE = "with twice as (select * from lineitem union all select * from lineitem where l_orderkey % 5 = 0)"


def twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem")
    return rows.unionByName(rows.where("l_orderkey % 5 = 0"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component of the vectors as a column; a vector of another length is an error, a missing one gives nulls."""
    fits = F.col("embedding").isNull() | (F.size("embedding") == len(DIMS))
    whole = F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.lit(f"an embedding doesn't have {len(DIMS)} components")))
    return read(spark, sf_dir, "embeddings").withColumn("embedding", whole).select("vec_id", F.col("label"), *[F.col("embedding")[k].cast("double").alias(n) for k, n in enumerate(DIMS)])


DIMS = [f"e{k}" for k in range(64)]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_returnflag", "l_linestatus", "l_shipdate"]
FLAGS = ["l_returnflag", "l_linestatus", "l_linenumber"]

# Labels and inventory


@query("select event_type as label, count(*) as n_rows, 100.0::double * count(*) / (select count(*) from events where event_type is not null)::double as percent from events where event_type is not null group by 1")
def label_distribution(spark, sf_dir):
    return profile.label_distribution(read(spark, sf_dir, "events"), "event_type")


@query("select count(*) as n_rows, cast(11 as bigint) as n_columns from lineitem")
def row_column_count(spark, sf_dir):
    return row_counts(read(spark, sf_dir, "lineitem"))


@query("select l_returnflag as label, count(distinct l_linestatus) as n_sources, count(*) as n_rows from lineitem group by 1")
def labels_by_source(spark, sf_dir):
    return profile.labels_by_source(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("select count(*) filter (event_type = 'click') as normal, count(*) filter (event_type <> 'click') as other, count(*) filter (event_type is null) as unlabelled from events")
def class_totals(spark, sf_dir):
    return profile.class_totals(read(spark, sf_dir, "events"), F.col("event_type") == "click")


# Cells


@query(DIRTY + """, counts as (select count(*) as n, count(*) - count(value) as v, count(*) - count(text_value) as t from dirty)
select 'value' as "column", n as n_rows, v as missing, 100.0::double * v / n::double as percent from counts
union all select 'text_value', n, t, 100.0::double * t / n::double from counts""")
def missing_profile(spark, sf_dir):
    return profile.missing_profile(dirty_events(spark, sf_dir))


@query(DIRTY + """, counts as (select count(*) as n, count(*) filter (isinf(value)) as v, count(*) filter (text_value = 'inf') as t from dirty)
select 'value' as "column", n as n_rows, v as infinite, v::double / n::double as ratio from counts union all select 'text_value', n, t, t::double / n::double from counts""")
def inf_profile(spark, sf_dir):
    return profile.inf_profile(dirty_events(spark, sf_dir), ["value", "text_value"], coerce=True)


@query(DIRTY + """, kinds as (select case when text_value is null then 'missing' when text_value = 'inf' then 'inf' when text_value = 'abc' then 'string' when text_value like '%.%' then 'float' else 'integer' end as kind from dirty)
select 'text_value' as "column", kind, count(*) as cells, true as critical from kinds group by kind
union all select 'event_id', 'integer', count(*), false from events""")
def type_profile(spark, sf_dir):
    return profile.type_profile(dirty_events(spark, sf_dir), ["text_value", "event_id"])


@query(DIRTY + """, kinds as (select case when text_value is null then 'missing' when text_value = 'inf' then 'inf' when text_value = 'abc' then 'string' when text_value like '%.%' then 'float' else 'integer' end as kind from dirty)
select 'text_value' as "column", count(*) as n_rows, count(*) filter (kind = 'missing') as missing, count(*) filter (kind = 'integer') as integer, count(*) filter (kind = 'float') as float,
  count(*) filter (kind = 'inf') as inf, count(*) filter (kind = 'string') as string from kinds
union all select 'event_id', count(*), 0, count(*), 0, 0, 0 from events""")
def cell_profile(spark, sf_dir):
    return profile.cell_profile(dirty_events(spark, sf_dir), ["text_value", "event_id"]).drop("about_distinct")


@query(DIRTY + "select event_id, text_value from dirty where text_value is null or text_value <> 'abc'")
def drop_text_rows(spark, sf_dir):
    return cleaning.drop_text_rows(dirty_events(spark, sf_dir), ["text_value", "value"]).select("event_id", "text_value")


@query("""with seen as (
  select distinct 'l_returnflag' as "column", l_returnflag as value from lineitem union all select distinct 'l_linestatus', l_linestatus from lineitem
  union all select distinct 'l_linenumber', cast(l_linenumber as varchar) from lineitem)
select "column", count(*) as n_distinct, case when count(*) = 1 then 'constant' else 'low variance' end as kind, string_agg(value, '|' order by value) as distinct_values from seen where value is not null group by 1 having count(*) <= 3""")
def low_variance_columns(spark, sf_dir):
    return profile.low_variance(read(spark, sf_dir, "lineitem"), FLAGS)


# Dominant values

_CELLS = """cells as (
  select "column", value, label, half from (
    select l_returnflag as label, l_linenumber % 2 as half, 'l_returnflag' as "column", l_returnflag as value from lineitem
    union all select l_returnflag, l_linenumber % 2, 'l_linestatus', l_linestatus from lineitem
    union all select l_returnflag, l_linenumber % 2, 'l_linenumber', cast(l_linenumber as varchar) from lineitem) where value is not null
)"""
_TOP = """tops as (
  select "column", value as dominant_value, n as dominant_count, total_count, n::double / total_count::double as dominant_ratio from (
    select "column", value, count(*) as n, cast(sum(count(*)) over (partition by "column") as bigint) as total_count,
      row_number() over (partition by "column" order by count(*) desc, value) as place from cells group by 1, 2) where place = 1
)"""


@query(f"""with {_CELLS}, {_TOP}
select *, case when dominant_ratio >= 1 then '100%' when dominant_ratio >= 0.95 then '95-100%' when dominant_ratio >= 0.9 then '90-95%' when dominant_ratio >= 0.8 then '80-90%'
  when dominant_ratio >= 0.7 then '70-80%' when dominant_ratio >= 0.6 then '60-70%' when dominant_ratio >= 0.5 then '50-60%' end as bucket from tops where dominant_ratio >= 0.2""")
def dominance_report(spark, sf_dir):
    return profile.dominance(read(spark, sf_dir, "lineitem"), FLAGS, least=0.2)


@query(f"""with {_CELLS}, {_TOP}
select c."column", case when c.value = t.dominant_value then 'dominant' else 'rest' end as side, c.label, count(*) as n from cells c join tops t on c."column" = t."column" where t.dominant_ratio >= 0.2 group by 1, 2, 3""")
def dominance_by_label(spark, sf_dir):
    return profile.dominance_by_label(read(spark, sf_dir, "lineitem"), FLAGS, "l_returnflag", least=0.2)


@query(f"""with {_CELLS}, {_TOP}, rest as (select c."column", c.value, count(*) as n from cells c join tops t on c."column" = t."column" and c.value <> t.dominant_value where t.dominant_ratio >= 0.05 group by 1, 2)
select * from (select *, row_number() over (partition by "column" order by n desc, value) as place from rest) where place <= 5""")
def dominance_rest(spark, sf_dir):
    return profile.dominance_rest(read(spark, sf_dir, "lineitem"), FLAGS, least=0.05)


@query(f"""with {_CELLS}, tops as (
  select half, "column", max(n)::double / sum(n)::double as ratio from (select half, "column", value, count(*) as n from cells group by 1, 2, 3) group by 1, 2)
select coalesce(a."column", b."column") as "column", a.ratio as first_ratio, b.ratio as second_ratio,
  case when b.ratio is null then 'first only' when a.ratio is null then 'second only' else 'both' end as side
from (select * from tops where half = 0 and ratio between 0.3 and 0.9) a full join (select * from tops where half = 1 and ratio between 0.3 and 0.9) b on a."column" = b."column" """)
def dominance_compare(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return profile.dominance_compare(rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 2 = 1"), FLAGS, low=0.3, high=0.9)


# Validation and cleaning


@query(DIRTY + "select count(*) as total, count(*) filter (value < 0) as invalid, count(*) - count(*) filter (value < 0) as valid from dirty")
def validity_counts(spark, sf_dir):
    rows = dirty_events(spark, sf_dir).drop("text_value").withColumnRenamed("value", "value_total")
    return cleaning.validity_counts(rows, cleaning.invalid_row(rows))


@query(DIRTY + "select event_id, user_id, event_type, value as value_total from dirty where not coalesce(value < 0, false)")
def valid_rows(spark, sf_dir):
    return cleaning.drop_invalid(dirty_events(spark, sf_dir).drop("text_value").withColumnRenamed("value", "value_total"))


@query("select event_id, case when event_id % 11 = 0 then null else user_id * 37 % 70000 end as dst_port from events where event_id % 11 <> 0 and user_id * 37 % 70000 between 0 and 65535")
def port_range(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 11 != 0, F.col("user_id") * 37 % 70000).alias("dst_port"))
    return cleaning.drop_invalid(rows)


@query("select event_type as label, count(*) filter (event_id % 7 <> 0) as valid, count(*) filter (event_id % 7 = 0) as invalid from events group by 1")
def sentinel_counts(spark, sf_dir):
    text = F.when(F.col("event_id") % 7 == 0, "Not a Complete Handshake").otherwise(F.col("props"))
    return cleaning.sentinel_counts(read(spark, sf_dir, "events").withColumn("delta_start", text), "delta_start", "event_type")


@query("select event_id, event_type from events where lower(event_type) in ('click', 'view')")
def label_filter(spark, sf_dir):
    padded = F.concat(F.lit(" \t"), F.upper("event_type"), F.lit(" \n"))
    return read(spark, sf_dir, "events").where(is_label(padded, "Click", " view ")).select("event_id", "event_type")


@query(DIRTY + "select event_id, 'clean' as part from dirty where value is not null and text_value is not null union all select event_id, 'missing' from dirty where value is null or text_value is null")
def missing_split(spark, sf_dir):
    clean, missing = cleaning.missing_split(dirty_events(spark, sf_dir))
    return clean.select("event_id", F.lit("clean").alias("part")).unionByName(missing.select("event_id", F.lit("missing").alias("part")))


@query(DIRTY + "select event_id, value, text_value from dirty where value is not null or text_value is not null")
def drop_all_missing(spark, sf_dir):
    return cleaning.drop_all_missing(dirty_events(spark, sf_dir).select("event_id", "value", "text_value"), ["value", "text_value"])


@query(DIRTY + "select event_id, case when text_value = 'inf' then 'inf'::double when text_value <> 'abc' then cast(text_value as double) end as number from (select event_id, case when text_value = 'abc' then null else text_value end as text_value from dirty)")
def coerce_numbers(spark, sf_dir):
    return cleaning.coerce_numbers(dirty_events(spark, sf_dir).select("event_id", F.col("text_value").alias("number")), ["number"])


@query(DIRTY + "select event_id, case when isinf(value) then null else value end as value from dirty")
def inf_to_null(spark, sf_dir):
    return cleaning.inf_to_null(dirty_events(spark, sf_dir).select("event_id", "value"), ["value"])


@query(DIRTY + "select event_id, case when isinf(value) then 0.0::double else coalesce(value, 0.0::double) end as value from dirty")
def inf_to_zero(spark, sf_dir):
    return cleaning.inf_and_null_to_zero(dirty_events(spark, sf_dir).select("event_id", "value"), ["value"])


@query(DIRTY + "select event_id, case when isinf(value) then (select median(value) from dirty where not isinf(value)) else value end as value from dirty")
def inf_to_median(spark, sf_dir):
    return cleaning.inf_to_median(dirty_events(spark, sf_dir).select("event_id", "value"), ["value"])


@query(DIRTY + "select event_id, user_id, event_type, text_value from dirty")
def drop_inf_columns(spark, sf_dir):
    return cleaning.drop_inf_columns(dirty_events(spark, sf_dir), most=0.005)


@query(DIRTY + "select cast(count(*) filter (value is null) as bigint) as replaced from dirty")
def null_to_zero_count(spark, sf_dir):
    return cleaning.null_to_zero(dirty_events(spark, sf_dir), ["value"])[1]


@query("select event_id, case when event_type = 'click' then null else event_type end as event_type from events")
def mark_missing_tokens(spark, sf_dir):
    return mark_missing(read(spark, sf_dir, "events").select("event_id", "event_type"), ["click"])


@query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity < 10")
def threshold_filter(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where(F.col("l_quantity") < 10).select("l_orderkey", "l_linenumber", "l_quantity")


@query("select l_orderkey, l_linenumber, l_partkey from lineitem where l_extendedprice > 50000 or l_extendedprice > l_quantity * 1500")
def abnormal_rule(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").where(cleaning.abnormal_iat(F.col("l_extendedprice"), F.col("l_quantity"), most=50_000, times=1500)).select("l_orderkey", "l_linenumber", "l_partkey")


@query("select event_id, user_id, event_type, value from events where event_type = 'click' and user_id % 3 = 0 and value between 10 and 90")
def conjunctive_filter(spark, sf_dir):
    return read(spark, sf_dir, "events").where((F.col("event_type") == "click") & (F.col("user_id") % 3 == 0) & F.col("value").between(10, 90)).select("event_id", "user_id", "event_type", "value")


# Duplicates and differences


@query(TWICE + " select distinct * from twice")
def dedup_rows(spark, sf_dir):
    return dedup.distinct_rows(twice(spark, sf_dir))


@query(TWICE + ", g as (select count(*) as n from twice group by " + ", ".join(ITEM) + ") select cast(sum(n) as bigint) as n_rows, count(*) as n_distinct, cast(sum(n - 1) as bigint) as duplicates from g")
def duplicate_counts(spark, sf_dir):
    return dedup.duplicate_counts(twice(spark, sf_dir))


@query(TWICE + " select l_orderkey, l_partkey, l_suppkey, l_linenumber, count(*) as n_copies from twice group by 1, 2, 3, 4 having count(*) > 1 order by n_copies desc, 1, 2, 3, 4 limit 10")
def top_duplicates(spark, sf_dir):
    return dedup.top_duplicates(twice(spark, sf_dir).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))


@query("select l_returnflag, l_linestatus, l_linenumber, min(l_orderkey) as l_orderkey from lineitem group by 1, 2, 3")
def first_rows(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey")
    return dedup.first_rows(rows, ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_orderkey"])


# All of lineitem against a processed table in which some rows are changed.
_SLICES = "with raw as (select * from lineitem), processed as (select * replace (case when l_orderkey % 7 = 0 then l_quantity + 1000 else l_quantity end as l_quantity) from lineitem)"


def raw_and_processed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf_dir, "lineitem")
    changed = F.when(F.col("l_orderkey") % 7 == 0, F.col("l_quantity") + 1000).otherwise(F.col("l_quantity"))
    return rows, rows.withColumn("l_quantity", changed)


@query(_SLICES + """ select (select count(*) from (select distinct * from raw)) as raw_distinct, (select count(*) from (select distinct * from processed)) as processed_distinct,
  (select count(*) from (select * from raw except select * from processed)) as missing, (select count(*) from (select * from processed except select * from raw)) as extra""")
def difference_counts(spark, sf_dir):
    raw, processed = raw_and_processed(spark, sf_dir)
    return dedup.difference_counts(raw, processed)


@query(_SLICES + " select * from raw except select * from processed")
def missing_rows(spark, sf_dir):
    raw, processed = raw_and_processed(spark, sf_dir)
    return dedup.missing_rows(raw, processed)


@query(_SLICES + " select * from (select l_orderkey, l_quantity from raw except select l_orderkey, l_quantity from processed) order by 1, 2 limit 10")
def sample_missing(spark, sf_dir):
    raw, processed = raw_and_processed(spark, sf_dir)
    return dedup.sample_missing(raw.select("l_orderkey", "l_quantity"), processed.select("l_orderkey", "l_quantity"))


# Samples and splits

_HASH = "md5(concat_ws(':', coalesce(cast(event_id as varchar), ''), '42'))"
_UNIT = f"(cast('0x' || substr({_HASH}, 1, 12) as bigint) / 281474976710656.0::double)"
_CLASS = f"row_number() over (partition by event_type order by {_HASH}, event_id)"
KEY = ["event_id"]


@query("select event_type as label, cast(dense_rank() over (order by event_type) - 1 as integer) as code from (select distinct event_type from events where event_type is not null)")
def label_encode(spark, sf_dir):
    return sampling.label_codes(read(spark, sf_dir, "events"), "event_type")


@query("with codes as (select event_type, cast(dense_rank() over (order by event_type) - 1 as integer) as code from (select distinct event_type from events)) select e.event_id, case when c.code < 3 then c.code else -1 end as code from events e join codes c using (event_type)")
def label_lookup(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type")
    return sampling.map_labels(rows, "event_type", sampling.label_codes(rows, "event_type").where("code < 3"), unknown=-1).select("event_id", "code")


@query("select event_id, cast(event_type <> 'view' as integer) as label from events")
def binary_relabel(spark, sf_dir):
    return read(spark, sf_dir, "events").select("event_id", sampling.binary_label("event_type", "view").alias("label"))


@query(f"select event_id, event_type from (select event_id, event_type, {_CLASS} as place, count(*) over (partition by event_type) as n from events) where n >= 100 and place <= 300")
def class_floor_cap(spark, sf_dir):
    return sampling.class_floor_cap(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", KEY, least=100, most=300)


@query(f"select event_id from (select event_id, row_number() over (order by {_HASH}, event_id) as place from events where event_type = 'view') where place <= (select floor(count(*) * 0.5) from events where event_type = 'click')")
def ratio_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return sampling.ratio_sample(rows.where("event_type = 'view'").select("event_id"), rows.where("event_type = 'click'"), 0.5, KEY)


@query(f"select event_id, value from events order by {_HASH}, event_id limit 500")
def sample_rows(spark, sf_dir):
    return sampling.sample_rows(read(spark, sf_dir, "events").select("event_id", "value"), 500, KEY)


@query(f"select event_id from events where {_UNIT} < 0.1")
def sample_fraction(spark, sf_dir):
    return sampling.sample_fraction(read(spark, sf_dir, "events").select("event_id"), 0.1, KEY)


@query(f"select event_id, event_type from events where event_type <> 'view' or {_UNIT} < 0.1")
def downscale(spark, sf_dir):
    return sampling.downscale(read(spark, sf_dir, "events").select("event_id", "event_type"), F.col("event_type") == "view", 0.1, KEY)


@query(f"select event_id, event_type, {_CLASS} as turn from events")
def round_robin(spark, sf_dir):
    return sampling.round_robin(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", KEY)


@query("select event_id, cast(floor((row_number() over (order by event_id) - 1) / 700) as bigint) as part from events")
def split_parts_query(spark, sf_dir):
    return split_parts(read(spark, sf_dir, "events").select("event_id"), 700, KEY)


@query(f"select event_id, event_type, case when place <= round_even(n * 0.6, 0) then 'train' else 'test' end as split from (select event_id, event_type, {_CLASS} as place, count(*) over (partition by event_type) as n from events where event_type is not null)")
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 0.6, KEY)


@query(f"select event_id, event_type, cast(({_CLASS} - 1) % 3 as integer) as fold from events")
def stratified_folds(spark, sf_dir):
    return sampling.folds(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 3, KEY)


@query(f"""with kept as (select event_id, event_type, value from (select *, {_CLASS} as place, count(*) over (partition by event_type) as n from events where event_type <> 'view') where n >= 100 and place <= 200),
few as (select event_id, event_type, value from (select *, row_number() over (order by {_HASH}, event_id) as place from events where event_type = 'view') where place <= (select floor(count(*) * 2.0) from kept))
select event_id, value, 0 as event_type from few union all select event_id, value, 1 from kept""")
def binary_training_set(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return assembly.binary_training_set(rows.where("event_type = 'view'"), rows.where("event_type <> 'view'"), "event_type", KEY, least=100, most=200, normal_label="view")


@query(f"""with kept as (select event_id, event_type, value from (select *, {_CLASS} as place, count(*) over (partition by event_type) as n from events where event_type <> 'view') where n >= 100 and place <= 200)
select event_id, value, cast(dense_rank() over (order by event_type) - 1 as integer) as event_type from kept""")
def multiclass_training_set(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return assembly.multiclass_training_set(rows, "event_type", ["event_id", "value"], KEY, least=100, most=200, normal_label="view")[0]


_TURNS = f"select event_id, event_type, event_id % 3 as source, row_number() over (partition by event_id % 3 order by {_HASH}, event_id) as turn from events where event_type is not null and event_type <> 'view'"


@query(f"select event_id, event_type, source, turn, cast(floor((row_number() over (order by turn, source, event_id) - 1) / 500) as bigint) as part from ({_TURNS}) order by turn, source limit 1200")
def interleaved_parts(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("source"))
    return assembly.interleaved_parts(rows, "event_type", "source", KEY, 500, mode="attacks", normal_label="view", max_rows=1200)


@query(DIRTY + f"select event_id, case when isinf(value) then null else value end as value, case when text_value not in ('abc', 'inf') then cast(text_value as double) end as text_value from (select event_id, event_type, value, case when text_value in ('abc', 'inf') then null else text_value end as text_value from dirty) where event_type = 'click' and (not isinf(value) or text_value is not null) order by {_HASH}, event_id limit 300")
def drift_sample(spark, sf_dir):
    return assembly.drift_sample(dirty_events(spark, sf_dir), ["value", "text_value"], "event_type", " Click", 300, KEY)


# Statistics


def _each(sql: str, columns: list[str], table: str = "lineitem", tail: str = "") -> str:
    return " union all ".join(f"select '{c}' as \"column\", {sql.replace('$', c)} from {table} {tail}" for c in columns)


_D = "decimal(24,7)"


@query(_each(f"cast(min($) as {_D}) as min, cast(median($) as {_D}) as median, cast(max($) as {_D}) as max, cast(avg($) as {_D}) as mean, cast(100.0::double * count(*) filter ($ = 0) / count(*) as {_D}) as zero_percent, count(distinct $) as n_distinct", MEASURES))
def feature_stats(spark, sf_dir):
    return decimals(profile.feature_stats(read(spark, sf_dir, "lineitem"), MEASURES, distinct=True), "min", "median", "max", "mean", "zero_percent")


@query(_each(f"l_returnflag, cast(min($) as {_D}) as min, cast(median($) as {_D}) as median, cast(max($) as {_D}) as max, cast(avg($) as {_D}) as mean, cast(100.0::double * count(*) filter ($ = 0) / count(*) as {_D}) as zero_percent", MEASURES, tail="group by l_returnflag"))
def stats_by_label(spark, sf_dir):
    return decimals(profile.feature_stats(read(spark, sf_dir, "lineitem"), MEASURES, by=["l_returnflag"]), "min", "median", "max", "mean", "zero_percent")


@query(_each("l_returnflag as label, count(*) filter ($ > 0.05) as abnormal, count($) as n, 100.0::double * count(*) filter ($ > 0.05) / count($)::double as percent", MEASURES, tail="group by l_returnflag"))
def abnormal_by_label(spark, sf_dir):
    return profile.abnormal_by_label(read(spark, sf_dir, "lineitem"), MEASURES, "l_returnflag", 0.05)


@query(_each(f"cast(median($) filter (l_returnflag = 'R') as {_D}) as first_median, cast(median($) filter (l_returnflag = 'A') as {_D}) as second_median", MEASURES))
def median_compare(spark, sf_dir):
    return decimals(profile.median_compare(read(spark, sf_dir, "lineitem"), MEASURES, F.col("l_returnflag") == "R", F.col("l_returnflag") == "A"), "first_median", "second_median")


@query(_each(f"count($) as n, cast(avg($) as {_D}) as mean, cast(stddev_samp($) as {_D}) as std, cast(min($) as {_D}) as min, cast(quantile_cont($, 0.25) as {_D}) as p25, cast(median($) as {_D}) as p50, cast(quantile_cont($, 0.75) as {_D}) as p75, cast(max($) as {_D}) as max", ["value"], "events"))
def describe(spark, sf_dir):
    return decimals(profile.describe(read(spark, sf_dir, "events"), ["value"]), "mean", "std", "min", "p25", "p50", "p75", "max")


@query(" union all ".join(f"select 'value' as \"column\", {q}::double as q, cast(quantile_cont(value, {q}) as {_D}) as value from events" for q in (0.5, 0.75, 0.9, 0.95, 0.99)))
def percentiles(spark, sf_dir):
    return decimals(profile.percentiles(read(spark, sf_dir, "events"), ["value"], (0.5, 0.75, 0.9, 0.95, 0.99)), "value")


_Q = "quantile_cont($, 0.25)", "quantile_cont($, 0.75)"
_IQR = f"{_Q[0]} - 1.5 * ({_Q[1]} - {_Q[0]}) as low, {_Q[1]} + 1.5 * ({_Q[1]} - {_Q[0]}) as high"


@query(f"select \"column\", cast(low as {_D}) as low, cast(high as {_D}) as high from ({_each(_IQR, MEASURES)})")
def iqr_bounds(spark, sf_dir):
    return decimals(profile.iqr_bounds(read(spark, sf_dir, "lineitem"), MEASURES), "low", "high")


@query(f"with b as ({_each(_IQR, MEASURES)}), cells as (" + " union all ".join(f"select l_returnflag as label, '{c}' as \"column\", {c} as value from lineitem" for c in MEASURES) + ") select c.\"column\", c.label, count(*) filter (value < low or value > high) as outliers, count(*) as n from cells c join b on b.\"column\" = c.\"column\" group by 1, 2")
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(read(spark, sf_dir, "lineitem"), MEASURES, "l_returnflag")


@query(f"""with span as (select min(value) as a, (max(value) - min(value)) / 50 as w from events)
select bin, cast(a + bin * w as {_D}) as low, n from (select cast(least(floor((value - a) / w), 49) as bigint) as bin, count(*) as n from events, span where value is not null group by 1), span""")
def histogram(spark, sf_dir):
    return decimals(profile.histogram(read(spark, sf_dir, "events"), "value"), "low")


@query("select cast(null as bigint) as bin, cast(l_linenumber as double) as low, count(*) as n from lineitem group by l_linenumber")
def value_histogram(spark, sf_dir):
    return profile.histogram(read(spark, sf_dir, "lineitem"), "l_linenumber")


@query(_each(f"cast(quantile_cont($, 0.005) as {_D}) as low, cast(quantile_cont($, 0.995) as {_D}) as high, cast(median($) filter (l_linenumber % 2 = 0) as {_D}) as first_median, cast(median($) filter (l_linenumber % 2 = 1) as {_D}) as second_median, cast(avg($) filter (l_linenumber % 2 = 0) as {_D}) as first_mean, cast(avg($) filter (l_linenumber % 2 = 1) as {_D}) as second_mean", MEASURES))
def drift_range(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    out = profile.drift_range(rows.where("l_linenumber % 2 = 0"), rows.where("l_linenumber % 2 = 1"), MEASURES)
    return decimals(out, "low", "high", "first_median", "second_median", "first_mean", "second_mean")


@query("select l_returnflag as label, " + ", ".join(f"cast(quantile_cont(l_extendedprice, {q / 100}) as {_D}) as p{q}" for q in (0, 25, 50, 75, 100)) + " from lineitem group by 1")
def spread_by_label(spark, sf_dir):
    return decimals(profile.spread_by_label(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag"), "p0", "p25", "p50", "p75", "p100")


# Correlation

_CORR = [*MEASURES, "doubled", "fixed"]


def _numbers(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(*MEASURES, (F.col("l_extendedprice") * 2).alias("doubled"), F.lit(1.0).alias("fixed"))


def _pairs_sql() -> str:
    out = []
    for i, a in enumerate(_CORR):
        for b in _CORR[i + 1 :]:
            x, y = ("l_extendedprice * 2" if c == "doubled" else c for c in (a, b))
            r = "cast(null as decimal(12,6))" if "fixed" in (a, b) else f"cast(corr({x}, {y}) as decimal(12,6))"
            out.append(f"select '{a}' as first, '{b}' as second, {r} as r" + ("" if "fixed" in (a, b) else " from lineitem"))
    return " union all ".join(out)


@query(_pairs_sql())
def correlation_pairs(spark, sf_dir):
    return correlation.correlations(_numbers(spark, sf_dir), _CORR).withColumn("r", F.col("r").cast("decimal(12,6)"))


@query(f"with p as ({_pairs_sql()}) select 0 as \"group\", first, second, r, coalesce(abs(r) >= 0.95, false) as is_edge from p where first = 'l_extendedprice' and second = 'doubled'")
def correlation_groups(spark, sf_dir):
    pairs = correlation.correlations(_numbers(spark, sf_dir), _CORR)
    report = correlation.group_report(pairs, correlation.correlation_groups(pairs, least=0.95), least=0.95)
    return report.withColumn("r", F.col("r").cast("decimal(12,6)"))


# Evaluation

_JUDGED = "with judged as (select l.quality as truth, cast(d.n_chars > 1000 as integer) as prediction from labels l join documents d using (doc_id))"


def _judged(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("truth"), "prediction")


_GRID = _JUDGED + ", grid as (select t.x as truth, p.x as prediction from (values (0), (1)) t(x), (values (0), (1)) p(x)), m as (select g.truth, g.prediction, count(j.truth) as n from grid g left join judged j on j.truth = g.truth and j.prediction = g.prediction group by 1, 2)"
_REPORT = _GRID + """, r as (select truth as label, cast(sum(n) as bigint) as support, sum(n) filter (truth = prediction) as hits, (select sum(n) from m o where o.prediction = m.truth) as said from m group by truth),
pr as (select label, case when said = 0 then 0.0::double else hits::double / said::double end as precision, case when support = 0 then 0.0::double else hits::double / support::double end as recall, support from r)"""


@query(_GRID + " select * from m")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), "truth", "prediction")


@query(_REPORT + " select label, precision, recall, case when precision + recall = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end as f1, support from pr")
def class_report(spark, sf_dir):
    return evaluate.class_report(evaluate.confusion(_judged(spark, sf_dir), "truth", "prediction"))


@query(_REPORT + f" select cast(avg(precision) as {_D}) as precision, cast(avg(recall) as {_D}) as recall, cast(avg(case when precision + recall = 0 then 0.0::double else 2 * precision * recall / (precision + recall) end) as {_D}) as f1, cast(sum(support) as bigint) as support from pr")
def macro_average(spark, sf_dir):
    return decimals(evaluate.macro_average(evaluate.class_report(evaluate.confusion(_judged(spark, sf_dir), "truth", "prediction"))), "precision", "recall", "f1")


@query(_JUDGED + """, c as (select count(*) filter (truth = 0 and prediction = 0) as tp, count(*) filter (truth <> 0 and prediction = 0) as fp, count(*) filter (truth = 0 and prediction <> 0) as fn, count(*) filter (truth <> 0 and prediction <> 0) as tn from judged),
p as (select *, tp::double / (tp + fp)::double as precision, tp::double / (tp + fn)::double as recall from c)
select tp, fp, fn, tn, precision, recall, 2 * precision * recall / (precision + recall) as f1, (tp + tn)::double / (tp + fp + fn + tn)::double as accuracy from p""")
def anomaly_report(spark, sf_dir):
    return evaluate.anomaly_report(_judged(spark, sf_dir), F.col("truth") == 0, F.col("prediction") == 0)


@query("select event_id, case when value / 100 < 0.6 then 'Unknown_Zero_Day_Attack' when user_id % 4 = 0 then 'zero' when user_id % 4 = 1 then 'one' else 'Unknown_Class_' || (user_id % 4) end as name from events")
def confidence_threshold(spark, sf_dir):
    name = evaluate.named_prediction(F.col("user_id") % 4, F.col("value") / 100, {0: "zero", 1: "one"})
    return read(spark, sf_dir, "events").select("event_id", name.alias("name"))


@query("select event_type as prediction, count(*) as n_rows, 100.0::double * count(*) / (select count(*) from events)::double as percent from events group by 1")
def prediction_distribution(spark, sf_dir):
    return profile.prediction_distribution(read(spark, sf_dir, "events"), "event_type")


@query(f"select l_returnflag, cast(avg(l_quantity) filter (l_linestatus = 'F') as {_D}) as \"F\", cast(avg(l_quantity) filter (l_linestatus = 'O') as {_D}) as \"O\" from lineitem group by 1")
def mean_by_two(spark, sf_dir):
    return decimals(evaluate.mean_by_two(read(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"]), "F", "O")


@query("select event_id, value from events where value is not null order by value, event_id limit 10")
def lowest_rows(spark, sf_dir):
    return evaluate.lowest(read(spark, sf_dir, "events").select("event_id", "value"), "value", 10, KEY)


@query("select event_id, value from events where value is not null order by value desc, event_id limit 10")
def highest_rows(spark, sf_dir):
    return evaluate.highest(read(spark, sf_dir, "events").select("event_id", "value"), "value", 10, KEY)


# Schemas


@query("select event_id, value, 0.0::double as absent from events")
def reindex_features(spark, sf_dir):
    return schema.reindex(read(spark, sf_dir, "events"), ["event_id", "value", "absent"])


@query("select event_id, event_type, value from events")
def drop_columns(spark, sf_dir):
    return schema.drop_columns(read(spark, sf_dir, "events"), [" TS ", "user_id", "props", "absent"])


@query("select * from (values ('ts', true), ('absent', false)) v(\"column\", found)")
def drop_report(spark, sf_dir):
    return schema.drop_report(read(spark, sf_dir, "events"), ["ts", "absent", "ts"])


@query("select * from (values ('l_orderkey', 'first only'), ('o_orderkey', 'second only'), ('x', 'neither')) v(\"column\", status)")
def column_availability(spark, sf_dir):
    return schema.availability(spark, ["l_orderkey", "o_orderkey", "x"], read(spark, sf_dir, "lineitem").columns, read(spark, sf_dir, "orders").columns)


@query("select * from (values ('n_nationkey', 'int', 'int', 'same'), ('n_name', 'string', 'bigint', 'type'), ('n_regionkey', 'int', null, 'first only'), ('extra', null, 'int', 'second only')) v(\"column\", first_type, second_type, status)")
def schema_difference(spark, sf_dir):
    rows = read(spark, sf_dir, "nation")
    return schema.schema_difference(rows, rows.select("n_nationkey", F.length("n_name").cast("long").alias("n_name"), F.lit(1).alias("extra")))


@query("select event_id as id, value, 'a' as side from events where value > 50 union all select event_id, null, 'b' from events where value <= 50")
def union_by_name(spark, sf_dir):
    rows = read(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return rows.where("value > 50").select("id", "value", F.lit("a").alias("side")).unionByName(rows.where("value <= 50").select(F.lit("b").alias("side"), "id"), allowMissingColumns=True)


@query("select p_partkey, trim(regexp_replace(p_name || ' #1/' || p_brand, '[^A-Za-z0-9_-]+', '_', 'g'), '_') as file_name, regexp_replace(p_name || ' #1/', '[^0-9A-Za-z _]', '', 'g') as title from part")
def safe_names(spark, sf_dir):
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", file_safe(F.concat("p_name", F.lit(" #1/"), "p_brand")).alias("file_name"), plain_title(F.concat("p_name", F.lit(" #1/"))).alias("title"))


@query("select 'event_id' as name, count(*) as n from events union all select 'event_type', count(*) from events")
def normalized_columns(spark, sf_dir):
    rows = schema.normalize_columns(read(spark, sf_dir, "events").select(F.col("event_id").alias(" Event_ID "), F.col("event_type").alias("EVENT_TYPE")))
    return rows.select(F.explode(F.array(*map(F.lit, rows.columns))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query(f"select event_id, row_number() over (order by {_HASH}, event_id) as row from events")
def shuffled_rows(spark, sf_dir):
    return sampling.rank_by_hash(read(spark, sf_dir, "events").select("event_id"), [], KEY, name="row")


@query("select event_id, event_type, cast(dense_rank() over (order by event_type) - 1 as double) as code from events")
def text_codes(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", "event_type", F.col("event_type").alias("code"))
    return models.encode_text(rows, ["code"])[0]


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def drop_correlated(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, (F.col("l_extendedprice") * 2).alias("l_twice"))
    return correlation.drop_correlated(rows, ["l_extendedprice", "l_discount", "l_tax", "l_twice"])


@query(DIRTY + "select event_id, case when text_value is null then 'missing' when text_value = 'inf' then 'inf' when text_value = 'abc' then 'string' when text_value like '%.%' then 'float' else 'integer' end as kind from dirty")
def value_types(spark, sf_dir):
    return dirty_events(spark, sf_dir).select("event_id", value_type(F.col("text_value")).alias("kind"))


# Balancing


@query("with c as (select label, count(*) as n from embeddings where label is not null group by 1) select label, n as n_rows, greatest(n, cast(floor((select max(n) from c) * 0.9) as bigint)) as target from c")
def oversample_targets(spark, sf_dir):
    return balance.oversample_targets(read(spark, sf_dir, "embeddings"), "label", 0.9)


@query("select event_id, event_type from (select event_id, event_type, " + _CLASS + " as place from events where event_type is not null) where place <= 150")
def undersample(spark, sf_dir):
    return balance.undersample(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", 150, KEY)


@query()
def smote(spark, sf_dir):
    return balance.smote(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 1.0)


@query()
def borderline_smote(spark, sf_dir):
    return balance.borderline_smote(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding", 1.0)


@query()
def adasyn(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").withColumn("label", F.col("label") < 3)
    return balance.adasyn(rows, "vec_id", "label", "embedding", 1.0)


# Models


@query()
def forest_scores(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    return models.score(models.train_forest(rows, "label", DIMS, trees=20, depth=8), rows, ["vec_id", "label"])


@query()
def boosting_importance(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("label", (F.col("label") > 4).cast("int"))
    return models.importance(models.train_boosting(rows, "label", DIMS, rounds=5, depth=3), spark)


@query()
def importance_by_label(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("label", F.col("label") % 3)
    return models.importance_by_label(rows, "label", DIMS, top=5, rounds=3, depth=3)


@query()
def isolation_forest(spark, sf_dir):
    rows = dirty_events(spark, sf_dir).select("event_id", finite_or_zero(F.col("value")).alias("value"), number_of(dirty_events(spark, sf_dir), "text_value").alias("number"))
    forest = models.train_isolation_forest(rows, ["value", "number"], KEY)
    return models.isolation_scores(rows, forest, ["value", "number"], KEY)


@query()
def isolation_report(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 0, F.col("value") * 100).otherwise(F.col("value")).alias("value"))
    scored = models.isolation_scores(rows, models.train_isolation_forest(rows, ["value"], KEY), ["value"], KEY, threshold=0.6)
    return evaluate.anomaly_report(scored, F.col("event_id") % 50 == 0, F.col("prediction") == -1)


@query()
def holdout_report(spark, sf_dir):
    return assembly.holdout_report(embedded(spark, sf_dir), "label", DIMS, ["vec_id"], trees=20, depth=8)


@query()
def live_scores(spark, sf_dir):
    rows = embedded(spark, sf_dir)
    trained = models.train_forest(rows, "label", DIMS, trees=20, depth=8)
    return models.score_live(trained, rows.drop("label").withColumnRenamed("e0", " E0 "), keep=["vec_id"])


@query()
def grid_search(spark, sf_dir):
    """36 combinations over 3 folds, of which those that differ in the number of trees share a fit."""
    rows = embedded(spark, sf_dir).withColumn("label", F.col("label") % 3)
    options = models.grid(trees=[5, 10, 15], depth=[3, 5, 8], least=[1, 2], subset=["sqrt", "log2"])
    return models.tuning_summary(models.tune(rows, "label", DIMS, options, models.forest_of, ["vec_id"]))


@query()
def search_report(spark, sf_dir):
    """The class report of the best of 36 boosting combinations over 3 folds, on rows that the search never saw. Those that differ in
    rounds only share a fit.
    """
    rows = cut(sampling.stratified_split(embedded(spark, sf_dir).withColumn("label", F.col("label") % 3), "label", 0.7, ["vec_id"]))
    train, test = (rows.where(F.col("split") == x).drop("split") for x in ("train", "test"))
    options = models.grid(rounds=[100, 200, 300], depth=[5, 10, 20], rate=[0.01, 0.1], subsample=[0.8, 1.0])
    return models.search(train, test, "label", DIMS, options, models.boosting_of, ["vec_id"], k=3, parallel=spark.sparkContext.defaultParallelism)[3]


#: A forest made by hand, whose walk SQL can state: (size, nodes: feature or -1, split, left, right, depth at a leaf).
HAND_MADE = [
    (256, [(0, 50.0, 1, 2, 0.0), (-1, 0.0, -1, -1, 1.25), (1, 40.0, 3, 4, 0.0), (-1, 0.0, -1, -1, 2.5), (-1, 0.0, -1, -1, 6.75)]),
    (100, [(1, 20.0, 1, 2, 0.0), (0, 10.0, 3, 4, 0.0), (-1, 0.0, -1, -1, 4.0), (-1, 0.0, -1, -1, 2.0), (-1, 0.0, -1, -1, 9.5)]),
]


@query("""with walked as (
  select event_id, case when value < 50 then 1.25 when user_id % 50 < 40 then 2.5 else 6.75 end + case when user_id % 50 < 20 then case when value < 10 then 2.0 else 9.5 end else 4.0 end as depth
  from events where value is not null and not isnan(value) and not isinf(value)
), scored as (
  select event_id, pow(2.0::double, -(depth::double / 2) / (2 * (ln(255.0::double) + 0.5772156649::double) - 2 * 255.0::double / 256)) as score from walked
)
select event_id, cast(round(score, 9) as decimal(24,7)) as anomaly_score, case when score > 0.6 then -1 else 1 end as prediction from scored""")
def isolation_walk(spark, sf_dir):
    """Scores of a forest that is given, not grown: depths and norm as SQL states them."""
    kind = "tree long, size long, nodes array<struct<f:int,split:double,left:int,right:int,depth:double>>"
    forest = spark.createDataFrame([(k, size, nodes) for k, (size, nodes) in enumerate(HAND_MADE)], kind)
    rows = read(spark, sf_dir, "events").where("value is not null and not isnan(value)").where(F.abs("value") < float("inf")).select("event_id", "value", (F.col("user_id") % 50).alias("user"))
    scored = models.isolation_scores(rows, forest, ["value", "user"], ["event_id"], threshold=0.6)
    return scored.select("event_id", dec(F.round("anomaly_score", 9)).alias("anomaly_score"), "prediction")


# Invariants of models, as far as SQL can say them


@query("select count(*) as n_rows, count(distinct vec_id) as n_ids, true as known_labels, true as sure_enough, true as better_than_chance from embeddings")
def forest_invariants(spark, sf_dir):
    rows = forest_scores(spark, sf_dir)
    labels = read(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("known")).distinct()
    joined = rows.join(labels, rows["predicted_label"] == labels["known"], "left")
    hit = F.avg((F.col("predicted_label") == F.col("label").cast("string")).cast("int"))
    return joined.agg(F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.every(F.col("known").isNotNull()).alias("known_labels"), F.every(F.col("confidence").between(0.1, 1.0)).alias("sure_enough"), (hit > 0.2).alias("better_than_chance"))


@query("select cast(64 as bigint) as n_features, cast(100 as decimal(24,7)) as percent, true as positive")
def boosting_invariants(spark, sf_dir):
    return boosting_importance(spark, sf_dir).agg(F.count_distinct("feature").alias("n_features"), dec(F.round(F.sum("percent"), 6)).alias("percent"), F.every(F.col("percent") >= 0).alias("positive"))


@query("select cast(label % 3 as varchar) as label, cast(5 as bigint) as n_features, cast(15 as bigint) as places from embeddings group by 1")
def importance_invariants(spark, sf_dir):
    return importance_by_label(spark, sf_dir).groupBy("label").agg(F.count_distinct("feature").alias("n_features"), F.sum("place").alias("places"))


@query("select count(*) as n_rows, count(distinct event_id) as n_ids, true as in_bounds, true as by_threshold from events")
def isolation_invariants(spark, sf_dir):
    score, low = F.col("anomaly_score"), F.col("prediction") == -1
    return isolation_forest(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_distinct("event_id").alias("n_ids"), F.every((score > 0) & (score < 1)).alias("in_bounds"), F.every(low == (score > 0.5)).alias("by_threshold"))


@query("select cast(sum(n - round_even(n * 0.8, 0)) as bigint) as n_held_out, true as in_bounds from (select count(*) as n from embeddings where label is not null group by label)")
def holdout_invariants(spark, sf_dir):
    bounded = [F.every(F.col(c).between(0.0, 1.0)) for c in ("precision", "recall", "f1")]
    return holdout_report(spark, sf_dir).agg(F.sum("support").alias("n_held_out"), (bounded[0] & bounded[1] & bounded[2]).alias("in_bounds"))


@query("select count(*) as n_rows, true as known from embeddings")
def live_invariants(spark, sf_dir):
    known = F.col("IDS_Prediction").isin(evaluate.UNKNOWN, *[str(k) for k in range(10)])
    kept = (F.col("IDS_Prediction") == evaluate.UNKNOWN) == (F.col("IDS_Confidence") < 0.60)
    return live_scores(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.every(known & kept).alias("known"))


@query("select 'trees ' || x as trees, cast(3 as bigint) as folds, true as in_bounds, true as timed from (values ('5'), ('10')) v(x)")
def tuning_folds(spark, sf_dir):
    rows = embedded(spark, sf_dir).withColumn("label", F.col("label") % 3)
    tried = models.tune(rows, "label", DIMS, models.grid(trees=[5, 10], depth=[3]), models.forest_of, ["vec_id"])
    trees = F.concat(F.lit("trees "), F.regexp_extract("combination", "'trees': ([0-9]+)", 1))
    return tried.groupBy(trees.alias("trees")).agg(F.count_distinct("fold").alias("folds"), F.every(F.col("f1").between(0.0, 1.0)).alias("in_bounds"), F.every(F.col("seconds") > 0).alias("timed"))


# Neighbours and what is drawn between them


_DISTANCES = """
with v as (select vec_id as id, cast(label as varchar) as label, [cast(x as double) for x in embedding] as x from embeddings where vec_id is not null and label is not null and embedding is not null),
d as (select a.id, b.id as neighbour, a.label = b.label as same, list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(a.x, b.x)]) as distance from v a join v b on a.id <> b.id $)
select id, neighbour, cast(row_number() over (partition by id order by distance, neighbour) as integer) as place, same from d qualify place <= 5
"""


@query(_DISTANCES.replace("$", "and a.label = b.label"))
def nearest_of_label(spark, sf_dir):
    rows = balance._vectors(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return balance.neighbours(rows, rows, 5, same_label=True)


@query(_DISTANCES.replace("$", ""))
def nearest_of_all(spark, sf_dir):
    rows = balance._vectors(read(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return balance.neighbours(rows, rows, 5, same_label=False)


@query("with c as (select cast(label as varchar) as label, count(*) as n from embeddings where label is not null group by 1), m as (select max(n) as most from c) select label, most - n as n_rows, true as on_segments from c, m where most > n")
def smote_counts(spark, sf_dir):
    made = smote(spark, sf_dir)
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    ends = made.join(rows.select(F.col("vec_id").alias("id"), F.col("v").alias("a")), "id").join(rows.select(F.col("vec_id").alias("neighbour"), F.col("v").alias("b")), "neighbour")
    # x = a + u (b - a) with one u for all components: the one of the widest of them.
    width = F.transform(F.arrays_zip("x", "a", "b"), lambda t: F.struct(F.abs(t["b"] - t["a"]).alias("width"), F.try_divide(t["x"] - t["a"], t["b"] - t["a"]).alias("u")))
    ends = ends.withColumn("u", F.coalesce(F.array_max(width)["u"], F.lit(0.0)))
    inside = F.col("u").between(0.0, 1.0) & F.forall(F.arrays_zip("x", "a", "b"), lambda t: F.abs(t["a"] + F.col("u") * (t["b"] - t["a"]) - t["x"]) <= 1e-9)
    return ends.groupBy("label").agg(F.count("*").alias("n_rows"), F.every(inside).alias("on_segments"))


# Sources and sinks: written to the shared folder, and read back


def _folder(spark: SparkSession) -> str:
    return run_folder(shared_dir(spark))


def _csv(spark: SparkSession, sf_dir: str) -> str:
    folder = _folder(spark)
    write_csv(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag"), folder)
    return folder


def _text_file(spark: SparkSession, lines: list[str]) -> str:
    folder = _folder(spark)
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    return folder


@query("select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag, cast(null as double) as absent from lineitem")
def csv_folder(spark, sf_dir):
    return read_csv(spark, _csv(spark, sf_dir), "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, absent double")


@query("select cast(l_orderkey as varchar) as l_orderkey, cast(l_linenumber as varchar) as l_linenumber, l_returnflag from lineitem")
def csv_text(spark, sf_dir):
    return read_csv_text(spark, _csv(spark, sf_dir)).select("l_orderkey", "l_linenumber", "l_returnflag")


@query("select l_extendedprice, l_returnflag from lineitem")
def csv_projection(spark, sf_dir):
    return read_csv(spark, _csv(spark, sf_dir), "l_extendedprice double, l_returnflag string")


@query("select x as place, y as name from (values (0, 'l_orderkey'), (1, 'l_linenumber'), (2, 'l_quantity'), (3, 'l_extendedprice'), (4, 'l_returnflag')) v(x, y)")
def csv_header(spark, sf_dir):
    names = raw_header(spark, _csv(spark, sf_dir))
    return spark.createDataFrame([(k, n) for k, n in enumerate(names)], "place int, name string")


@query("select cast(count(distinct l_returnflag) as bigint) as n_files, count(*) as n_rows from lineitem")
def csv_discovery(spark, sf_dir):
    """Of each flag one CSV, which is a folder of parts that many tasks write; no task sorts or holds rows."""
    folder, rows = _folder(spark), read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"))
    flags = [r["flag"] for r in rows.select("flag").distinct().collect()]  # a row a flag
    for k, flag in enumerate(flags or [None]):
        write_csv(rows.where(F.col("flag").eqNullSafe(F.lit(flag))).select("l_orderkey"), f"{folder}/{'none' if flag is None else 'flag'}-{k}.csv")
    csv = F.nullif(F.regexp_extract("file", "/(flag-[0-9]+[.]csv)/[^/]*$", 1), F.lit(""))  # rows without a flag are counted, but are no file
    return read_csv_text(spark, folder, source_col="file").agg(F.count_distinct(csv).alias("n_files"), F.count("*").alias("n_rows"))


def _mixed_csv(spark: SparkSession, sf_dir: str) -> str:
    """Three folders of files in one, whose headers differ in order, case and width."""
    folder, rows = _folder(spark), read(spark, sf_dir, "lineitem")
    write_csv(rows.where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), f"{folder}/wide")
    write_csv(rows.where("l_linenumber = 2").select("l_returnflag", F.col("l_orderkey").alias("L_ORDERKEY"), "l_linenumber"), f"{folder}/turned")
    write_csv(rows.where("l_linenumber > 2").select("l_linenumber", "l_tax", "l_quantity", "l_orderkey", "l_linestatus"), f"{folder}/other")
    return folder


@query("""select l_orderkey, l_linenumber, case when l_linenumber <= 2 then l_returnflag end as l_returnflag, case when l_linenumber <> 2 then l_quantity end as l_quantity,
  case when l_linenumber > 2 then l_tax end as l_tax, case when l_linenumber > 2 then l_linestatus end as l_linestatus from lineitem""")
def csv_mixed_headers(spark, sf_dir):
    return read_csv(spark, _mixed_csv(spark, sf_dir), "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double, l_tax double, l_linestatus string")


@query("select n_columns, count(*) as n_rows from (select cast(case when l_linenumber = 1 then 4 when l_linenumber = 2 then 3 else 5 end as bigint) as n_columns from lineitem) group by 1")
def csv_columns_by_file(spark, sf_dir):
    return file_counts(spark, _mixed_csv(spark, sf_dir)).where("n_rows > 0").groupBy("n_columns").agg(F.sum("n_rows").alias("n_rows"))


@query("""with placed as (
  select l_orderkey, l_linenumber, l_returnflag, row_number() over (partition by l_returnflag order by l_linenumber % 3, l_orderkey, l_linenumber) as place, count(*) over (partition by l_returnflag) as n from lineitem where l_returnflag is not null
)
select l_orderkey, l_linenumber, l_returnflag, case when place <= round_even(n * 0.6, 0) then 'train' else 'test' end as split from placed""")
def csv_file_order(spark, sf_dir):
    """The first rows of each label train, as they stand in three folders of files one after the other."""
    folder, rows = _folder(spark), read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    for k in range(3):
        rows.where(F.col("l_linenumber") % 3 == k).orderBy("l_orderkey", "l_linenumber").write.csv(f"{folder}/part{k}", header=True)
    split = sampling.split_in_files(read_csv_text(spark, folder, order_col="at"), "l_returnflag", 0.6, "at")
    return split.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_returnflag", "split")


@query("""select 'base' || case when part = 0 then '' else '_' || part end || '.csv' as file, count(*) as n_rows, min(event_id) as first_id, max(event_id) as last_id
from (select event_id, (row_number() over (order by event_id) - 1) // 1500 as part from events) group by part""")
def numbered_parts(spark, sf_dir):
    folder = _folder(spark)
    write_numbered(read(spark, sf_dir, "events").select("event_id", "event_type"), folder, 1500, ["event_id"])
    rows = spark.read.schema("event_id long, event_type string").csv(folder, header=True)
    return rows.groupBy(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query("select least(count(*), 100) as n_rows from lineitem")
def preview_rows(spark, sf_dir):
    return preview(read(spark, sf_dir, "lineitem"), 100).agg(F.count("*").alias("n_rows"))


@query("""with kinds as (select event_type as kind, row_number() over (order by event_type) - 1 as n from (select distinct event_type from events where event_type is not null))
select kind as name, cast(2 * n as integer) as place from kinds union all select kind || ' n', cast(2 * n + 1 as integer) from kinds""")
def column_list(spark, sf_dir):
    """A list of two names a line, with comments, made of the table's event types."""
    kinds = sampling.label_codes(read(spark, sf_dir, "events"), "event_type").orderBy("code").collect()
    names = read_column_list(spark, _text_file(spark, ["# none", *[f" {r['label']}, {r['label']} n # {r['code']}" for r in kinds]]))
    return spark.createDataFrame([(n, k) for k, n in enumerate(names)], "name string, place int")


@query("select event_type as label, cast(row_number() over (order by event_type) - 1 as integer) as code from (select distinct event_type from events where event_type is not null)")
def label_map_text(spark, sf_dir):
    codes = sampling.label_codes(read(spark, sf_dir, "events"), "event_type").collect()
    return read_label_map(spark, _text_file(spark, ["labels", "---", *[f"{r['label']} : {r['code']}" for r in codes]]))


@query("select event_type as label, cast(row_number() over (order by event_type) - 1 as integer) as code from (select distinct event_type from events where event_type is not null)")
def label_map_json(spark, sf_dir):
    folder = _folder(spark)
    write_label_map(sampling.label_codes(read(spark, sf_dir, "events"), "event_type"), folder)
    return spark.read.schema("label string, code int").json(folder)


@query("select l_orderkey, l_linenumber from lineitem order by l_orderkey, l_linenumber limit 1000")
def capped_csv(spark, sf_dir):
    folder = _folder(spark)
    write_csv(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), folder, max_rows=1000, order=[F.col("l_orderkey"), F.col("l_linenumber")])
    return read_csv(spark, folder, "l_orderkey long, l_linenumber int")


@query("select cast((n - 1) // 1500 as integer) as part, count(*) as n_rows from (select row_number() over (order by event_id) as n from events) group by 1")
def csv_parts(spark, sf_dir):
    folder = _folder(spark)
    write_parts(read(spark, sf_dir, "events").select("event_id"), folder, 1500, ["event_id"])
    return spark.read.schema("event_id long, part int").csv(folder, header=True).groupBy("part").agg(F.count("*").alias("n_rows"))


@query("select event_type as kind, count(*) as n_rows, min(event_id) as first_id from events group by 1")
def class_folders(spark, sf_dir):
    folder = _folder(spark)
    write_by_class(read(spark, sf_dir, "events").select("event_id", "event_type"), folder, F.col("event_type"), name="kind")
    kinds = spark.read.schema("event_id long, event_type string, kind string").parquet(folder)
    return kinds.groupBy("kind").agg(F.count("*").alias("n_rows"), F.min("event_id").alias("first_id"))


@query("select place, line from (values (0, 'Regions'), (1, '======='), (2, 'r_regionkey  size'), (3, '-----------------')) v(place, line) union all select 4 + r_regionkey, rpad(cast(r_regionkey as varchar), 13, ' ') || printf('%.4f', r_regionkey / 4) from region")
def text_report(spark, sf_dir):
    rows = read(spark, sf_dir, "region").orderBy("r_regionkey").select("r_regionkey", (F.col("r_regionkey") / 4).alias("size"))
    return spark.createDataFrame([(k, x) for k, x in enumerate(report_text(rows, "Regions").splitlines())], "place int, line string")


# Names


@query("select l_orderkey as avg_segment_size, l_quantity as rate from lineitem")
def aliased_columns(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias(" Segment_Size_Mean "), F.col("l_quantity").alias("RATE"))
    return schema.normalize_columns(rows, schema.ALIASES)


@query("select l_linenumber as x, l_quantity as y from lineitem")
def last_of_duplicates(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("x"), F.col("l_quantity").alias("y"), F.col("l_linenumber").alias(" X"))
    return schema.normalize_columns(rows, on_duplicate="last")


@query("select cast(l_orderkey as varchar) as x, l_returnflag as y from lineitem")
def first_of_duplicates(spark, sf_dir):
    folder = _folder(spark)
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), "l_returnflag")
    rows.toDF("x", "x.1", "y").write.csv(folder, header=True)
    return read_unique(spark, folder)


@query("""with named as (select distinct event_type as name from events where event_type is not null union all select distinct lower(l_returnflag) from lineitem union all select distinct lower(l_linestatus) from lineitem)
select name, count(*) as times from named where name <> (select min(event_type) from events) group by name""")
def delete_list(spark, sf_dir):
    """Names of two lists, made of the tables' values, without one that is kept; and how often each was given."""
    values = lambda table, name: [r["label"] for r in sampling.label_codes(read(spark, sf_dir, table), name).collect()]
    kinds, flags = values("events", "event_type"), [*values("lineitem", "l_returnflag"), *values("lineitem", "l_linestatus")]
    names, twice_named = schema.deletion_list(kinds, flags, [min(kinds)])
    return spark.createDataFrame([(n, 2 if n in twice_named else 1) for n in names], "name string, times long")


@query("select file, found_count, not_found_count, removed, missing from (values ('lineitem', 2, 1, 'l_tax|l_discount', 'nope'), ('region', 0, 3, '', 'L_TAX|l_discount|nope')) v(file, found_count, not_found_count, removed, missing)")
def deletion_summary(spark, sf_dir):
    files = {n: read(spark, sf_dir, n).columns for n in ("lineitem", "region")}
    made = schema.deletion_summary(spark, files, ["L_TAX", "l_discount", "nope"])
    ordered = F.array_join(F.reverse(F.array_sort("removed_columns")), "|")
    return made.select("file", "found_count", "not_found_count", ordered.alias("removed"), F.array_join("requested_missing", "|").alias("missing"))


# Rows and columns with missing or infinite cells


@query(DIRTY + "select event_id, value from dirty where value is not null and text_value is not null")
def drop_missing(spark, sf_dir):
    return cleaning.drop_missing(dirty_events(spark, sf_dir), "value", "text_value").select("event_id", "value")


@query(DIRTY + "select event_id, case when value is null or isinf(value) then 0 else value end as value from dirty")
def handled_inf_columns(spark, sf_dir):
    rows = dirty_events(spark, sf_dir).select("event_id", "value", "text_value")
    return cleaning.handle_inf_columns(rows, zero=["value"], delete=["text_value"])
