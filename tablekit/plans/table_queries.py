"""Queries over the table operators: sources, profiling, cleaning, scaling, encoding, selection, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tablekit.functions.columns import local_table, numeric_columns
from tablekit.operators import clean, encode, profile, recommend, sample, scale, select
from tablekit.operators.genetic import select_genetic
from tablekit.operators.score import align
from tablekit.plans.prepare import PrepareConfig, prepare
from tablekit.plans.registry import joined, query, r, rounded
from tablekit.sources import admission, catalog, readers, sinks

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def holes(t) -> DataFrame:
    """orders with missing values put in by rule."""
    k = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(k % 11 != 0, (k % 50).cast("int")).alias("o_weight"),
        "o_orderdate",
    )


HOLES = """holes as (
  select o_orderkey, o_custkey,
    case when o_orderkey % 7 <> 0 then o_totalprice end as o_totalprice,
    case when o_orderkey % 5 <> 0 then o_orderstatus end as o_orderstatus,
    case when o_orderkey % 3 = 0 then o_orderpriority end as o_orderpriority,
    case when o_orderkey % 11 <> 0 then cast(o_orderkey % 50 as integer) end as o_weight,
    o_orderdate
  from orders)"""


def union_sql(names, template: str) -> str:
    return " union all ".join(template.format(c=c) for c in names)


# -- sources ----------------------------------------------------------------------------------------

ORDER_SCHEMA = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
ORDER_SQL = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders"


@query("read_csv_orders", ORDER_SQL)
def read_csv_orders(t):
    path = t.scratch("orders.csv")
    t("orders").write.option("header", True).csv(path)
    return readers.read_any(t.spark, path, "csv", ORDER_SCHEMA)


@query("read_csv_bad_cells", "select o_orderkey, try_cast(o_orderpriority as double) as priority_number, o_totalprice from orders")
def read_csv_bad_cells(t):
    path = t.scratch("cells.csv")
    t("orders").select("o_orderkey", F.col("o_orderpriority").alias("priority_number"), "o_totalprice").write.option("header", True).csv(path)
    return readers.read_csv(t.spark, path, "o_orderkey bigint, priority_number double, o_totalprice double")


@query("read_tsv_parts", "select p_partkey, p_name, p_brand, p_type, p_size, p_retailprice from part")
def read_tsv_parts(t):
    path = t.scratch("part.tsv")
    t("part").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_any(t.spark, path, "tsv", "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")


@query("read_json_customers", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def read_json_customers(t):
    """Files that each hold one array of at most 50 000 records."""
    path = t.scratch("customer.json")
    rows = t("customer").withColumn("part", F.floor(F.col("c_custkey") / 50_000))
    arrays = rows.groupBy("part").agg(
        F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))).alias("value")
    )
    arrays.write.partitionBy("part").text(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string, part int"
    return readers.read_any(t.spark, path, "json", schema).drop("part")


@query("read_parquet_suppliers", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def read_parquet_suppliers(t):
    return readers.read_any(t.spark, f"{t.folder}/supplier.parquet")


@query(
    "catalog_lifecycle",
    """select 'orders' as dataset_id, count(*) as n_rows, cast(6 as bigint) as n_columns,
         'o_orderkey,o_custkey,o_totalprice' as numerical_columns, 'o_orderstatus,o_orderpriority' as categorical_columns,
         'o_orderdate' as datetime_columns from orders
       union all select 'part', count(*), 6, 'p_partkey,p_size,p_retailprice', 'p_name,p_brand,p_type', '' from part""",
)
def catalog_lifecycle(t):
    """Three datasets in, one deleted (a second rebuild leaves it so), one rebuilt from its files."""
    store = catalog.Catalog(t.spark, t.scratch("catalog"))
    store.ingest(t("orders"), "orders", "orders.parquet")
    store.ingest(t("supplier"), "supplier", "supplier.parquet")
    t("part").write.parquet(store.path("part"))
    store.rebuild()
    store.delete("supplier")
    store.rebuild()
    lists = ["numerical_columns", "categorical_columns", "datetime_columns"]
    return joined(store.list().select("dataset_id", "n_rows", "n_columns", *lists), lists)


SPLIT_ORDERS = """select *, case when row_number() over (order by md5(concat_ws('~', o_orderkey, 42)))
    <= ceil(count(*) over () * 0.2) then 'test' else 'train' end as split from orders"""


@query("partition_round_trip", f"select o_orderkey, o_totalprice, split from ({SPLIT_ORDERS}) where split = 'test'")
def partition_round_trip(t):
    path = t.scratch("split")
    sinks.save_partitions(sample.split_random(t("orders"), ["o_orderkey"], 0.2), path)
    return sinks.load_partition(t.spark, path, "test").select("o_orderkey", "o_totalprice", "split")


@query("export_predictions_csv", "select cast(o_orderkey as varchar) as o_orderkey, case when o_totalprice > 250000 then 'high' else 'low' end as \"Prediction\" from orders")
def export_predictions_csv(t):
    path = t.scratch("predictions")
    rows = t("orders").select("o_orderkey", F.when(F.col("o_totalprice") > 250000, "high").otherwise("low").alias("Prediction"))
    sinks.export_predictions(rows, path)
    return readers.read_csv(t.spark, path, "o_orderkey string, Prediction string")


@query(
    "admission_pages",
    """with f as (select '/landing/' || page_id || case page_id % 6 when 0 then '.csv' when 1 then '.EXE' when 2 then '.json'
         when 3 then '..csv' when 4 then '.parquet' else '|x.tsv' end as path,
         case when page_id % 4 = 0 then 0 else length(html) end as length,
         case when page_id % 5 = 0 then '4D5A9000' when page_id % 7 = 0 then '7F454C46' else '3C21444F' end as magic from pages)
       select path, reason is null as admitted, reason from (select path, case
         when path like '%.EXE' then 'Invalid file extension: .exe'
         when path like '%..%' or path like '%|%' then 'Invalid filename'
         when length = 0 then 'Empty file'
         when length > 1000 then 'File size exceeds limit'
         when magic like '4D5A%' then 'Executable file detected (MZ header)'
         when magic = '7F454C46' then 'Executable file detected (ELF header)' end as reason from f)""",
)
def admission_pages(t):
    k = F.col("page_id")
    suffix = (
        F.when(k % 6 == 0, ".csv").when(k % 6 == 1, ".EXE").when(k % 6 == 2, ".json").when(k % 6 == 3, "..csv").when(k % 6 == 4, ".parquet").otherwise("|x.tsv")
    )
    files = t("pages").select(
        F.concat(F.lit("/landing/"), k.cast("string"), suffix).alias("path"),
        F.when(k % 4 == 0, 0).otherwise(F.length("html")).cast("bigint").alias("length"),
        F.when(k % 5 == 0, "4D5A9000").when(k % 7 == 0, "7F454C46").otherwise("3C21444F").alias("magic"),
    )
    return admission.admit(files, 1000)


# -- profiling --------------------------------------------------------------------------------------


@query(
    "shape_lineitem",
    "with n as (select count(*) as n from lineitem) "
    + " union all ".join(
        f"select cast({i} as bigint) as position, '{c}' as column, '{k}' as dtype, n as n_rows, cast(11 as bigint) as n_columns from n"
        for i, (c, k) in enumerate(
            [(c, "int" if c == "l_linenumber" else "bigint" if c.endswith("key") else "double") for c in LINE_NUMBERS]
            + [("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]
        )
    ),
)
def shape_lineitem(t):
    return profile.shape(t("lineitem"))


def describe_sql(table: str, names) -> str:
    return union_sql(
        names,
        "select '{c}' as column, count({c}) as count, count(*) - count({c}) as null_count, "
        + r("avg({c})", 4)
        + " as mean, "
        + r("stddev_samp({c})", 4)
        + " as std, cast(min({c}) as double) as min, "
        + ", ".join(r(f"quantile_cont({{c}}, {q})", 4) + f" as q{int(q * 100)}" for q in (0.25, 0.5, 0.75))
        + ", cast(max({c}) as double) as max from "
        + table,
    )


@query("describe_lineitem", describe_sql("lineitem", LINE_NUMBERS))
def describe_lineitem(t):
    return rounded(profile.describe(t("lineitem")), 4)


@query("describe_with_nulls", f"with {HOLES} " + describe_sql("holes", ["o_totalprice", "o_weight"]))
def describe_with_nulls(t):
    return rounded(profile.describe(holes(t), ["o_totalprice", "o_weight"]), 4)


@query(
    "describe_categorical_orders",
    f"with {HOLES} "
    + union_sql(
        ["o_orderstatus", "o_orderpriority"],
        "select '{c}' as column, (select count(*) from (select distinct {c} from holes)) as \"unique\", top, freq from "
        "(select {c} as top, count(*) as freq from holes where {c} is not null group by {c} order by freq desc, top limit 1)",
    ),
)
def describe_categorical_orders(t):
    return profile.describe_categorical(holes(t), ["o_orderstatus", "o_orderpriority"])


@query(
    "missing_orders",
    f"with {HOLES} "
    + union_sql(
        ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "o_weight", "o_orderdate"],
        "select '{c}' as column, count(*) - count({c}) as missing, round(100.0 * (count(*) - count({c})) / count(*), 2) as missing_pct from holes",
    ),
)
def missing_orders(t):
    return profile.missing(holes(t))


@query(
    "correlation_lineitem",
    " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, round(corr({a}, {b}), 4) + 0.0 as r from lineitem" for a in LINE_VALUES for b in LINE_VALUES
    ),
)
def correlation_lineitem(t):
    return profile.correlation(t("lineitem"), LINE_VALUES)


@query(
    "correlation_with_nulls",
    f"with {HOLES} "
    + " union all ".join(
        f"select '{a}' as col_a, '{b}' as col_b, coalesce(round(corr({a}, {b}), 4), 0) + 0.0 as r from holes"
        for a in ("o_totalprice", "o_weight", "o_custkey")
        for b in ("o_totalprice", "o_weight", "o_custkey")
    ),
)
def correlation_with_nulls(t):
    return profile.correlation(holes(t), ["o_totalprice", "o_weight", "o_custkey"])


@query(
    "page_orders",
    "select o_orderkey, o_custkey, o_totalprice, (select count(*) from orders) as total_rows, "
    "cast(ceil((select count(*) from orders) / 50.0) as bigint) as total_pages from orders order by o_orderkey limit 50 offset 150",
)
def page_orders(t):
    rows = profile.page(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 4, 50)
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("total_rows", "total_pages")})


@query("page_after_key", "select o_orderkey, o_custkey from orders where o_orderkey > 199 order by o_orderkey limit 50")
def page_after_key(t):
    return profile.page_after(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", 199, 50)


@query(
    "column_profile_part",
    "with n as (select count(*) as n from part) "
    + " union all ".join(
        f"select '{c}' as column, '{k}' as physical_type, "
        + (f"case when count(distinct {c}) / count(*) < 0.5 then 'categorical' else 'text' end" if k == "string" else f"'{i}'")
        + f" as inferred_type, count(*) - count({c}) as missing, 0.0::double as missing_pct, count(distinct {c}) as \"distinct\", "
        f"(select string_agg(cast({c} as varchar), ',' order by p_partkey) from part where p_partkey < 5) as samples from part"
        for c, k, i in (
            ("p_partkey", "bigint", "integer"),
            ("p_name", "string", ""),
            ("p_brand", "string", ""),
            ("p_type", "string", ""),
            ("p_size", "int", "integer"),
            ("p_retailprice", "double", "float"),
        )
    ),
)
def column_profile_part(t):
    return joined(profile.column_profile(t("part"), ["p_partkey"]), ["samples"])


@query(
    "column_kinds_orders",
    """select 'numeric' as kind, 'o_orderkey,o_custkey,o_totalprice' as columns, count(*) as n_rows from orders
       union all select 'categorical', 'o_orderstatus,o_orderpriority', count(*) from orders
       union all select 'datetime', 'o_orderdate', count(*) from orders""",
)
def column_kinds_orders(t):
    return joined(profile.column_kinds(t("orders")), ["columns"])


def outlier_share_sql(table: str, c: str) -> str:
    return (
        f"(select count(*) filter ({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*) from {table}, "
        f"(select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {table}))"
    )


@query(
    "recommend_orders",
    f"""with {HOLES}, facts as (select count(*) as n,
          100.0 * sum((o_totalprice is null)::int + (o_orderstatus is null)::int + (o_orderpriority is null)::int + (o_weight is null)::int)
            / (count(*) * 7) as miss, {outlier_share_sql('holes', 'o_totalprice')} as o1, {outlier_share_sql('holes', 'o_weight')} as o2 from holes)
      select 'warning' as type, 'Small Dataset Size' as title, 'high' as priority, 'LogisticRegression,DecisionTree,KNeighbors' as suggestions,
        cast(n as varchar) as observed from facts where n < 100
      union all select 'info', 'Large Dataset Size', 'medium', 'RandomForest,GradientBoosting,XGBoost', cast(n as varchar) from facts where n > 10000
      union all select 'info', 'Numerical Dominant Data', 'low', 'StandardScaler,MinMaxScaler,RobustScaler', '2 categorical, 4 numeric' from facts
      union all select 'warning', 'High Missing Value Percentage', 'high', 'Mean/Median Imputation,KNN Imputation,Iterative Imputation', printf('%.1f%%', miss)
        from facts where miss > 20
      union all select 'info', 'Moderate Missing Values', 'medium', 'Mean/Median Imputation,Forward/Backward Fill', printf('%.1f%%', miss)
        from facts where miss > 5 and miss <= 20
      union all select 'success', 'Detected Problem Type', 'low', '', 'Classification' from facts""",
)
def recommend_orders(t):
    return joined(recommend.recommend(holes(t)), ["suggestions"])


@query(
    "recommended_steps_orders",
    f"""with {HOLES}, facts as (select {outlier_share_sql('holes', 'o_totalprice')} as o1, {outlier_share_sql('holes', 'o_weight')} as o2,
          (select max(c) / sum(c) from (select count(*) as c from holes where o_orderpriority is not null group by o_orderpriority)) as top)
      select cast(1 as bigint) as position, 'imputation' as step union all select 2, 'encoding' union all select 3, 'scaling'
      union all select 4, 'imbalance_handling' from facts where top > 0.7
      union all select case when top > 0.7 then 5 else 4 end, 'outlier_handling' from facts where o1 > 5 or o2 > 5""",
)
def recommended_steps_orders(t):
    return recommend.recommended_steps(holes(t))


@query(
    "problem_type_orders",
    "select case when count(distinct o_orderstatus) between 2 and 10 or count(distinct o_orderpriority) between 2 and 10 "
    "then 'Classification' else 'Unknown' end as problem_type from orders",
)
def problem_type_orders(t):
    found = recommend.problem_type(recommend.table_facts(t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")))
    return t.spark.createDataFrame([(found,)], "problem_type string")


@query(
    "auto_configure_customers",
    """with s as (select (abs(skewness(c_custkey)) + abs(skewness(c_nationkey)) + abs(skewness(exp(c_acctbal / 1000)))) / 3 as skew from customer),
         c as (select min(n) / sum(n) as least, count(*) as k, sum(n) as rows from (select count(*) as n from customer group by c_mktsegment))
       select 'imputation_strategy' as setting, 'median' as value union all select 'apply_encoding', 'True'
       union all select 'test_size', '0.2' union all select 'random_state', '42'
       union all select 'scaling_method', case when skew > 1.5 then 'robust' when skew > 0.8 then 'power' else 'standard' end from s
       union all select 'imbalance_handling.method', case when rows > 100 then 'smote' else 'oversample' end from c where k >= 2 and least < 0.2
       union all select 'imbalance_handling.sampling_strategy', 'auto' from c where k >= 2 and least < 0.2""",
)
def auto_configure_customers(t):
    df = t("customer").select("c_custkey", "c_nationkey", F.exp(F.col("c_acctbal") / 1000).alias("c_wealth"), "c_mktsegment")
    return recommend.config_table(t.spark, recommend.auto_configure(df, "c_mktsegment", "Classification"))


# -- cleaning ---------------------------------------------------------------------------------------


@query("drop_incomplete_rows", f"with {HOLES} select * from holes where o_totalprice is not null and o_orderstatus is not null and o_orderpriority is not null and o_weight is not null")
def drop_incomplete_rows(t):
    return clean.drop_incomplete(holes(t))


KEEP = ["o_orderkey", "o_totalprice", "o_weight", "o_orderstatus"]
MODE_SQL = "(select {c} from holes where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"


def fill_sql(number: str, digits: int = 6) -> str:
    status = MODE_SQL.format(c="o_orderstatus")
    return (
        f"with {HOLES} select o_orderkey, {r('coalesce(o_totalprice, ' + number.format(c='o_totalprice') + ')', digits)} as o_totalprice, "
        f"{r('coalesce(cast(o_weight as double), ' + number.format(c='o_weight') + ')', digits)} as o_weight, "
        f"coalesce(o_orderstatus, {status}) as o_orderstatus from holes"
    )


def filled(t, strategy: str) -> DataFrame:
    df = holes(t).select(*KEEP)
    model = clean.fit_fill(df, ["o_totalprice", "o_weight"], ["o_orderstatus"], strategy)
    return rounded(model.transform(df).withColumn("o_weight", F.col("o_weight").cast("double")), 4)


@query("impute_mean", fill_sql("(select avg({c}) from holes)", 4))
def impute_mean(t):
    return filled(t, "mean")


@query("impute_median", fill_sql("(select quantile_cont({c}, 0.5) from holes)", 4))
def impute_median(t):
    return filled(t, "median")


@query("impute_mode", fill_sql(MODE_SQL, 4))
def impute_mode(t):
    return filled(t, "most_frequent")


@query("fill_constant_category", f"with {HOLES} select o_orderkey, coalesce(o_orderstatus, 'unknown') as o_orderstatus from holes")
def fill_constant_category(t):
    return clean.fill_constant(holes(t).select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@query("drop_null_category", f"with {HOLES} select o_orderkey, o_orderstatus from holes where o_orderstatus is not null")
def drop_null_category(t):
    df = holes(t).select("o_orderkey", "o_orderstatus")
    return clean.handle_missing(df, "fill", "mean", "drop", keys=["o_orderkey"])


EVENT_HOLES = "events_holes as (select event_id, user_id, ts, case when event_id % 3 = 0 then value end as value from events)"


def event_holes(t):
    return t("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("value"))


@query(
    "forward_fill_events",
    f"with {EVENT_HOLES} select event_id, user_id, last_value(value ignore nulls) over "
    "(partition by user_id order by ts, event_id rows between unbounded preceding and current row) as value from events_holes",
)
def forward_fill_events(t):
    return clean.fill_along(event_holes(t), ["value"], ["user_id"], "ts", ["event_id"]).select("event_id", "user_id", "value")


@query(
    "backward_fill_unkeyed",
    f"with {EVENT_HOLES} select event_id, first_value(value ignore nulls) over "
    "(order by ts, event_id rows between current row and unbounded following) as value from events_holes",
)
def backward_fill_unkeyed(t):
    return clean.fill_along(event_holes(t), ["value"], [], "ts", ["event_id"], backward=True).select("event_id", "value")


@query("drop_sparse_columns", f"with {HOLES} select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_weight, o_orderdate from holes")
def drop_sparse_columns(t):
    """o_orderpriority is missing in two rows of three."""
    return clean.handle_missing(holes(t), "drop")


@query(
    "handle_missing_auto",
    f"with {HOLES} select o_orderkey, {r('coalesce(o_totalprice, (select avg(o_totalprice) from holes))', 4)} as o_totalprice, "
    f"coalesce(o_orderstatus, {MODE_SQL.format(c='o_orderstatus')}) as o_orderstatus from holes",
)
def handle_missing_auto(t):
    df = holes(t).select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
    return rounded(clean.handle_missing(df, "auto"), 4)


@query(
    "missing_shape_report",
    f"""with {HOLES} select 'before' as stage, count(*) as n_rows, cast(7 as bigint) as n_columns from holes
        union all select 'after', count(*), 6 from holes where o_orderstatus is not null""",
)
def missing_shape_report(t):
    df = holes(t)
    return clean.shape_report(df, clean.handle_missing(df, "auto", "mean", "drop"))


MAPPING = {"o_orderpriority": "numeric", "o_orderstatus": "category", "o_totalprice": "string", "o_when": "datetime", "o_flag": "boolean"}
CAST_SQL = """casts as (select o_orderkey, o_orderpriority, o_orderstatus, o_totalprice,
    case when o_orderkey % 4 = 0 then 'no date' else strftime(o_orderdate, '%Y-%m-%d') end as o_when,
    case o_orderkey % 3 when 0 then 'true' when 1 then 'false' else 'maybe' end as o_flag from orders)"""


def cast_input(t):
    k = F.col("o_orderkey")
    return t("orders").select(
        "o_orderkey",
        "o_orderpriority",
        "o_orderstatus",
        "o_totalprice",
        F.when(k % 4 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("o_when"),
        F.when(k % 3 == 0, "true").when(k % 3 == 1, "false").otherwise("maybe").alias("o_flag"),
    )


@query(
    "convert_types_orders",
    f"with {CAST_SQL} select o_orderkey, try_cast(o_orderpriority as double) as o_orderpriority, o_orderstatus, "
    "try_cast(o_when as timestamp) as o_when, try_cast(o_flag as boolean) as o_flag from casts",
)
def convert_types_orders(t):
    return clean.convert_types(cast_input(t), MAPPING).drop("o_totalprice")


@query(
    "cast_report_orders",
    f"""with {CAST_SQL} select 'o_orderpriority' as column, 'numeric' as target, true as success, 'string' as original_type, 'double' as new_type,
          count(*) filter (try_cast(o_orderpriority as double) is null) as n_lost from casts
        union all select 'o_orderstatus', 'category', true, 'string', 'string', 0
        union all select 'o_totalprice', 'string', true, 'double', 'string', 0
        union all select 'o_when', 'datetime', true, 'string', 'timestamp_ntz', count(*) filter (try_cast(o_when as timestamp) is null) from casts
        union all select 'o_flag', 'boolean', true, 'string', 'boolean', count(*) filter (o_flag = 'maybe') from casts
        union all select 'o_absent', 'numeric', false, null, null, null""",
)
def cast_report_orders(t):
    return clean.cast_report(cast_input(t), MAPPING | {"o_absent": "numeric"})


BOUNDS = {
    "iqr": "select quantile_cont({c}, 0.25) - {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as lo, "
    "quantile_cont({c}, 0.75) + {k} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) as hi from {t}",
    "zscore": "select avg({c}) - {k} * stddev_samp({c}) as lo, avg({c}) + {k} * stddev_samp({c}) as hi from {t}",
}


def outlier_sql(method: str, table: str, names, k: float) -> str:
    return " union all ".join(
        f"select '{c}' as column, count(*) filter ({c} < lo or {c} > hi) as outlier_count, "
        f"{r(f'100.0 * count(*) filter ({c} < lo or {c} > hi) / count({c})', 4)} as outlier_pct, {r('min(lo)', 4)} as lower, {r('min(hi)', 4)} as upper "
        f"from {table}, ({BOUNDS[method].format(c=c, k=k, t=table)})"
        for c in names
    )


@query("iqr_outliers_events", outlier_sql("iqr", "events", ["value"], 1.5))
def iqr_outliers_events(t):
    df = t("events")
    return rounded(clean.fit_outliers(df, "iqr", 1.5, ["value"]).report(df), 4)


@query("iqr_outliers_lineitem", outlier_sql("iqr", "lineitem", LINE_VALUES, 0.4))
def iqr_outliers_lineitem(t):
    df = t("lineitem")
    return rounded(clean.fit_outliers(df, "iqr", 0.4, LINE_VALUES).report(df), 4)


@query("zscore_outliers_lineitem", outlier_sql("zscore", "lineitem", LINE_VALUES, 1.5))
def zscore_outliers_lineitem(t):
    df = t("lineitem")
    return rounded(clean.fit_outliers(df, "zscore", 1.5, LINE_VALUES).report(df), 4)


@query(
    "outlier_rows_events",
    f"select event_id, 'value' as column, value from events, ({BOUNDS['iqr'].format(c='value', k=1.5, t='events')}) where value < lo or value > hi",
)
def outlier_rows_events(t):
    df = t("events")
    return clean.fit_outliers(df, "iqr", 1.5, ["value"]).outliers(df, ["event_id"])


@query("isolation_outliers_customers")
def isolation_outliers_customers(t):
    return clean.isolation_outliers(t("customer"), ["c_custkey"], ["c_acctbal"])


@query(
    "validate_orders",
    """select 'required' as "check", 'o_orderkey' as column, 'ok' as status, 0::bigint as n_bad union all select 'required', 'o_missing', 'error', 1
       union all select 'type', 'o_totalprice', 'ok', 0 union all select 'type', 'o_orderstatus', 'error', 1
       union all select 'range', 'o_totalprice', case when count(*) filter (o_totalprice < 1000 or o_totalprice > 400000) > 0 then 'warning' else 'ok' end,
         count(*) filter (o_totalprice < 1000 or o_totalprice > 400000) from orders
       union all select 'range', 'o_custkey', case when count(*) filter (o_custkey < 0) > 0 then 'warning' else 'ok' end, count(*) filter (o_custkey < 0) from orders""",
)
def validate_orders(t):
    return clean.validate(
        t("orders"),
        ["o_orderkey", "o_missing"],
        {"o_totalprice": "numeric", "o_orderstatus": "numeric"},
        {"o_totalprice": (1000, 400000), "o_custkey": (0, 1e12)},
    )


@query(
    "coerce_numeric_orders",
    "select o_orderkey, coalesce(try_cast(o_orderpriority as double), 0.0) as o_orderpriority, o_totalprice, 0.0::double as o_orderdate from orders",
)
def coerce_numeric_orders(t):
    df = t("orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate")
    return clean.coerce_numeric(df, ["o_orderpriority", "o_totalprice", "o_orderdate"])


@query("subset_columns", "select l_quantity, l_discount, l_returnflag as target from lineitem")
def subset_columns(t):
    return t("lineitem").select("l_quantity", "l_discount", F.col("l_returnflag").alias("target"))


# -- scaling and encoding ---------------------------------------------------------------------------


def scaled(t, method: str) -> DataFrame:
    df = t("orders").select("o_orderkey", "o_totalprice", F.lit(7.0).alias("constant"))
    return rounded(scale.fit_scaler(df, ["o_totalprice", "constant"], method).transform(df))


def scale_sql(centre: str, spread: str) -> str:
    return f"select o_orderkey, {r(f'(o_totalprice - c) / s')} as o_totalprice, 0.0::double as constant from orders, (select {centre} as c, {spread} as s from orders)"


@query("scale_standard", scale_sql("avg(o_totalprice)", "stddev_pop(o_totalprice)"))
def scale_standard(t):
    return scaled(t, "standard")


@query("scale_minmax", scale_sql("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"))
def scale_minmax(t):
    return scaled(t, "minmax")


@query("scale_robust", scale_sql("quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"))
def scale_robust(t):
    return scaled(t, "robust")


@query(
    "yeo_johnson_fixed",
    f"""select event_id, {r("case when x >= 0 then (pow(x + 1, 0.4) - 1) / 0.4 else -(pow(1 - x, 1.6) - 1) / 1.6 end")} as value
        from (select event_id, value - 20 as x from events)""",
)
def yeo_johnson_fixed(t):
    df = t("events").select("event_id", (F.col("value") - 20).alias("x"))
    return rounded(df.select("event_id", scale.yeo_johnson(F.col("x"), 0.4).alias("value")))


#: events.value with NaN and null injected, the same rows in both engines.
GAPS = "select event_id, case when event_id % 11 = 0 then 'nan'::double when event_id % 7 = 0 then null else value end as value from events"


def gaps(t):
    value = F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("value"))
    return t("events").select("event_id", value.alias("value"))


@query(
    "power_likelihood_gaps",
    f"""with g as (select value from ({GAPS}) where not isnan(value)), l as (select unnest(range(21)) as i),
          y as (select i, -3 + 0.4 * i as lam, value as x from g, l),
          s as (select i, lam, count(*) as n, sum(sign(x) * ln(abs(x) + 1)) as logs,
            var_pop(case when x >= 0 then case when abs(lam) < 1e-9 then ln(x + 1) else (pow(x + 1, lam) - 1) / lam end
                         else case when abs(2 - lam) < 1e-9 then -ln(1 - x) else -(pow(1 - x, 2 - lam) - 1) / (2 - lam) end end) as v from y group by all)
        select cast(i as integer) as i, {r('(-0.5 * n * ln(v) + (lam - 1) * logs) / n', 5)} as log_likelihood from s""",
)
def power_likelihood_gaps(t):
    df = gaps(t)
    lams = [-3 + 0.4 * i for i in range(21)]
    lams = [0.0 if abs(x) < 1e-9 else 2.0 if abs(x - 2) < 1e-9 else x for x in lams]
    stats = profile.numeric_stats(df, ["value"])["value"]
    found = scale.likelihoods(df, {"value": lams}, {"value": stats.mean})
    return rounded(local_table(t.spark, [(i, v / stats.count) for (_, i), v in found.items()], "i int, log_likelihood double"), 5)


@query(
    "quantile_knots_gaps",
    f"""with g as (select value, row_number() over (order by value) - 1 as k, count(*) over () as n from ({GAPS}) where not isnan(value)),
          c as (select max(n) as n, least(1000, max(n)) as knots from g),
          w as (select i, i * (n - 1) // (knots - 1) as k, knots from c, (select unnest(range(1000)) as i) where i < knots),
          p as (select value, (min(i) + max(i)) / 2.0 / (max(knots) - 1) as p from w join g using (k) group by value)
        select {r('value')} as value, {r('case when value = (select min(value) from p) then 0 when value = (select max(value) from p) then 1 else p end')} as p from p""",
)
def quantile_knots_gaps(t):
    knots = scale.fit_scaler(gaps(t), ["value"], "quantile").params["value"]["knots"]
    return rounded(local_table(t.spark, [(float(v), float(p)) for v, p in knots], "value double, p double"))


@query(
    "scaled_gaps_stay_gaps",
    f"select event_id, value is null or isnan(value) as missing from ({GAPS})",
)
def scaled_gaps_stay_gaps(t):
    """Power and quantile scaling of a column with NaN: every other value stays a number."""
    df = gaps(t)
    both = df.select("event_id", F.col("value").alias("p"), F.col("value").alias("q"))
    both = scale.fit_scaler(both, ["p"], "power").transform(both)
    both = scale.fit_scaler(both, ["q"], "quantile").transform(both)
    gone = lambda c: F.col(c).isNull() | F.isnan(c)
    return both.select("event_id", (gone("p") | gone("q")).alias("missing"))


@query("scale_power_events")
def scale_power_events(t):
    df = t("events").select("event_id", "value")
    return rounded(scale.fit_scaler(df, ["value"], "power").transform(df))


@query("scale_quantile_events")
def scale_quantile_events(t):
    df = t("events").select("event_id", "value")
    return rounded(scale.fit_scaler(df, ["value"], "quantile").transform(df))


@query(
    "scale_auto_choice",
    """select 'events' as tbl, case when abs(skewness(value)) > 1 then 'power' when abs(skewness(value)) > 0.5 then 'quantile' else 'standard' end as method from events
       union all select 'orders', case when abs(skewness(o_totalprice)) > 1 then 'power' when abs(skewness(o_totalprice)) > 0.5 then 'quantile' else 'standard' end from orders""",
)
def scale_auto_choice(t):
    rows = [(n, scale.auto_method(profile.numeric_stats(t(n), [c], skew=True))) for n, c in (("events", "value"), ("orders", "o_totalprice"))]
    return t.spark.createDataFrame(rows, "tbl string, method string")


@query(
    "onehot_returnflag",
    "select l_orderkey, l_quantity, (l_returnflag = 'N')::int as \"l_returnflag_N\", (l_returnflag = 'R')::int as \"l_returnflag_R\", "
    "(l_linestatus = 'O')::int as \"l_linestatus_O\" from lineitem",
)
def onehot_returnflag(t):
    df = t("lineitem").select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")
    return encode.fit_encoder(df).transform(df)


@query(
    "frequency_brand",
    f"select p_partkey, {r('n / t')} as p_brand_freq from part join (select p_brand, count(*) as n from part group by p_brand) using (p_brand), (select count(*) as t from part)",
)
def frequency_brand(t):
    df = t("part").select("p_partkey", "p_brand")
    return rounded(encode.fit_encoder(df).transform(df))


@query("label_codes_part", "select p_partkey, dense_rank() over (order by p_name) - 1 as p_name_code from part")
def label_codes_part(t):
    return encode.label_encode(t("part").select("p_partkey", "p_name"), "p_name").drop("p_name")


@query(
    "winsorise_orders",
    f"select o_orderkey, {r('least(greatest(o_totalprice, lo), hi)', 4)} as o_totalprice from orders, "
    "(select quantile_cont(o_totalprice, 0.05) as lo, quantile_cont(o_totalprice, 0.95) as hi from orders)",
)
def winsorise_orders(t):
    return rounded(encode.winsorise(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), 4)


@query(
    "polynomial_lineitem",
    f"select l_quantity, l_discount, {r('l_quantity * l_quantity')} as l_quantity_sq, {r('l_discount * l_discount')} as l_discount_sq, "
    f"{r('l_quantity * l_discount')} as l_quantity_x_l_discount from lineitem",
)
def polynomial_lineitem(t):
    return rounded(encode.polynomial(t("lineitem").select("l_quantity", "l_discount"), ["l_quantity", "l_discount"]))


@query(
    "bin_orders",
    "select o_orderkey, (o_totalprice >= a)::int + (o_totalprice >= b)::int + (o_totalprice >= c)::int + (o_totalprice >= d)::int as o_totalprice_bin "
    "from orders, (select quantile_cont(o_totalprice, 0.2) as a, quantile_cont(o_totalprice, 0.4) as b, quantile_cont(o_totalprice, 0.6) as c, "
    "quantile_cont(o_totalprice, 0.8) as d from orders)",
)
def bin_orders(t):
    return encode.bin_columns(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 5).drop("o_totalprice")


@query(
    "mutual_information_lineitem",
    "with e as (select quantile_cont(l_quantity, 0.25) as a, quantile_cont(l_quantity, 0.5) as b, quantile_cont(l_quantity, 0.75) as c from lineitem), "
    "j as (select (l_quantity >= a)::int + (l_quantity >= b)::int + (l_quantity >= c)::int as bin, l_linestatus as label, count(*) as n from lineitem, e group by 1, 2), "
    "p as (select n, sum(n) over () as t, sum(n) over (partition by bin) as nb, sum(n) over (partition by label) as nl from j) "
    f"select 'l_quantity' as feature, {r('sum(n / t * ln(n * t / (nb * nl)))', 9)} as mi from p",
)
def mutual_information_lineitem(t):
    return rounded(encode.mutual_information(t("lineitem"), ["l_quantity"], "l_linestatus", 4), 9)


# -- feature selection ------------------------------------------------------------------------------


@query(
    "select_variance",
    union_sql(LINE_VALUES, f"select '{{c}}' as feature, {r('var_pop({c})', 4)} as score, var_pop({{c}}) > 0.0008 as kept from lineitem"),
)
def select_variance(t):
    return rounded(select.select_variance(t("lineitem"), LINE_VALUES, 0.0008).report(t.spark), 4)


def correlated(t):
    return t("lineitem").select("l_quantity", "l_discount", (F.col("l_quantity") * 2 + F.col("l_discount")).alias("twice"), (-F.col("twice")).alias("against"))


@query(
    "select_correlation",
    """with x as (select l_quantity, l_discount, l_quantity * 2 + l_discount as twice, -(l_quantity * 2 + l_discount) as against from lineitem)
       select 'l_quantity' as feature, 0.0::double as score, true as kept
       union all select 'l_discount', round(abs(corr(l_quantity, l_discount)), 4), abs(corr(l_quantity, l_discount)) <= 0.9 from x
       union all select 'twice', round(greatest(abs(corr(l_quantity, twice)), abs(corr(l_discount, twice))), 4), greatest(abs(corr(l_quantity, twice)), abs(corr(l_discount, twice))) <= 0.9 from x
       union all select 'against', 1.0, false""",
)
def select_correlation(t):
    return rounded(select.select_correlation(correlated(t), None, 0.9).report(t.spark), 4)


def anova_sql(names, label: str, table: str, k: int) -> str:
    one = (
        "select '{c}' as feature, (sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))) as score "
        f"from (select count(*) as n, avg({{c}}) as m, var_pop({{c}}) as v from {table} group by {label})"
    )
    return f"select feature, {r('score', 4)} as score, row_number() over (order by score desc) <= {k} as kept from ({union_sql(names, one)})"


@query("select_kbest_anova", anova_sql(LINE_VALUES, "l_returnflag", "lineitem", 2))
def select_kbest_anova(t):
    return rounded(select.select_kbest(t("lineitem").select(*LINE_VALUES, "l_returnflag"), "l_returnflag", 2).report(t.spark), 4)


@query(
    "select_kbest_regression",
    "select feature, "
    + r("score", 4)
    + " as score, row_number() over (order by score desc) <= 1 as kept from ("
    + union_sql(
        ["l_quantity", "l_discount", "l_tax"],
        "select '{c}' as feature, pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2) as score from lineitem",
    )
    + ")",
)
def select_kbest_regression(t):
    return rounded(select.select_kbest(t("lineitem").select(*LINE_VALUES), "l_extendedprice", 1).report(t.spark), 4)


@query("select_rfe_part")
def select_rfe_part(t):
    df = t("lineitem").select(*LINE_VALUES, "l_linenumber", "l_returnflag")
    return select.select_rfe(df, "l_returnflag", 2, trees=10).report(t.spark)


@query("select_genetic_orders")
def select_genetic_orders(t):
    df = t("orders").select("o_orderkey", "o_custkey", "o_totalprice", F.month("o_orderdate").alias("m"), F.sqrt("o_totalprice").alias("root"))
    return select_genetic(df, ["o_orderkey"], "o_totalprice", population=10, generations=6).report(t.spark)


# -- splits and balance -----------------------------------------------------------------------------


@query("split_random", f"select o_orderkey, split from ({SPLIT_ORDERS})")
def split_random(t):
    return sample.split_random(t("orders"), ["o_orderkey"], 0.2).select("o_orderkey", "split")


@query(
    "split_stratified",
    """select o_orderkey, case when row_number() over (partition by o_orderstatus order by md5(concat_ws('~', o_orderkey, 42)))
       <= ceil(round(count(*) over (partition by o_orderstatus) * 0.25, 9)) then 'test' else 'train' end as split from orders""",
)
def split_stratified(t):
    return sample.split_stratified(t("orders"), ["o_orderkey"], "o_orderstatus", 0.25).select("o_orderkey", "split")


@query(
    "split_sequential",
    """select o_orderkey, case when row_number() over (order by o_orderdate, md5(concat_ws('~', o_orderkey, 42)))
       <= floor(round(count(*) over () * 0.7, 9)) then 'train' else 'test' end as split from orders""",
)
def split_sequential(t):
    return sample.split_sequential(t("orders"), ["o_orderkey"], "o_orderdate", 0.3).select("o_orderkey", "split")


@query(
    "split_sequential_null_dates",
    """with o as (select o_orderkey, case when o_orderkey % 7 = 0 then null else o_orderdate end as d from orders)
       select o_orderkey, case when row_number() over (order by d nulls first, md5(concat_ws('~', o_orderkey, 42)))
       <= floor(round(count(*) over () * 0.7, 9)) then 'train' else 'test' end as split from o""",
)
def split_sequential_null_dates(t):
    df = t("orders").withColumn("o_orderdate", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")))
    return sample.split_sequential(df, ["o_orderkey"], "o_orderdate", 0.3).select("o_orderkey", "split")


@query("split_unsupervised", "select c_custkey, 'train' as split from customer")
def split_unsupervised(t):
    return sample.split_none(t("customer").select("c_custkey"))


@query(
    "oversample_status",
    """with c as (select o_orderstatus, count(*) as n from orders group by 1), m as (select max(n) as top from c),
         k as (select o_orderkey, o_orderstatus, n, top, row_number() over (partition by o_orderstatus order by md5(concat_ws('~', o_orderkey, 42))) as rn
               from orders join c using (o_orderstatus), m)
       select o_orderkey, o_orderstatus, unnest(range(top // n + (rn <= top % n)::int)) as copy from k""",
)
def oversample_status(t):
    return sample.oversample(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query(
    "undersample_status",
    """with c as (select o_orderstatus, count(*) as n from orders group by 1)
       select o_orderkey, o_orderstatus from orders qualify row_number() over (partition by o_orderstatus order by md5(concat_ws('~', o_orderkey, 42)))
         <= (select min(n) from c)""",
)
def undersample_status(t):
    return sample.undersample(t("orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], "o_orderstatus")


@query(
    "balance_report_status",
    """with c as (select o_orderstatus as label, count(*) as n from orders group by 1)
       select 'before' as stage, label, n from c union all select 'after', label, (select min(n) from c) from c""",
)
def balance_report_status(t):
    df = t("orders").select("o_orderkey", "o_orderstatus")
    return sample.balance_report(df, sample.undersample(df, ["o_orderkey"], "o_orderstatus"), "o_orderstatus")


def rare_customers(t):
    wealth = F.when(F.col("c_acctbal") > 8500, "rich").otherwise("other")
    return t("customer").select("c_custkey", "c_acctbal", "c_nationkey", wealth.alias("wealth"))


BALANCED = """with c as (select count(*) filter (c_acctbal > 8500) as rich, count(*) as n from customer)
  select 'rich' as wealth, false as synthetic, rich as n from c union all select 'other', false, n - rich from c
  union all select 'rich', true, n - 2 * rich from c"""


@query("smote_customers", BALANCED)
def smote_customers(t):
    from tablekit.operators.resample import smote

    grown = smote(rare_customers(t), ["c_custkey"], ["c_acctbal", "c_nationkey"], "wealth")
    return grown.groupBy("wealth", "synthetic").agg(F.count("*").alias("n"))


@query("adasyn_customers")
def adasyn_customers(t):
    from tablekit.operators.resample import adasyn

    grown = adasyn(rare_customers(t), ["c_custkey"], ["c_acctbal", "c_nationkey"], "wealth")
    return grown.groupBy("wealth", "synthetic").agg(F.count("*").alias("n"))


PREPARED = ["o_totalprice", "o_orderstatus_O", "o_orderstatus_P"]


@query(
    "prepare_orders",
    f"""with {HOLES}, f as (select o_orderkey, coalesce(o_totalprice, (select avg(o_totalprice) from holes)) as x,
          coalesce(o_orderstatus, {MODE_SQL.format(c='o_orderstatus')}) as s, o_custkey from holes),
        m as (select avg(x) as a, stddev_pop(x) as d from f)
      select o_orderkey, o_custkey, {r('(x - a) / d')} as o_totalprice, (s = 'O')::int as "o_orderstatus_O", (s = 'P')::int as "o_orderstatus_P",
        case when row_number() over (order by md5(concat_ws('~', o_orderkey, 42))) <= ceil(round(count(*) over () * 0.2, 9)) then 'test' else 'train' end as split
      from f, m""",
)
def prepare_orders(t):
    config = PrepareConfig(keys=["o_orderkey"], target="o_custkey", problem="Regression", imputation_strategy="mean", scaling_method="standard")
    return rounded(prepare(holes(t).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), config)[1])


@query(
    "prepare_undersampled",
    f"""with {HOLES}, f as (select o_orderkey, o_orderstatus as s, o_totalprice as x, o_weight as w from holes where o_totalprice is not null and o_orderstatus is not null and o_weight is not null),
        m as (select avg(x) as a, stddev_pop(x) as d, avg(w) as aw, stddev_pop(w) as dw from f),
        p as (select *, row_number() over (partition by s order by md5(concat_ws('~', o_orderkey, 42))) <= ceil(round(count(*) over (partition by s) * 0.2, 9)) as test from f),
        q as (select *, row_number() over (partition by s, test order by md5(concat_ws('~', o_orderkey, 42))) as rn,
                (select min(n) from (select count(*) as n from p where not test group by s)) as least from p)
      select {r('(x - a) / d')} as o_totalprice, {r('(w - aw) / dw')} as o_weight, s as o_orderstatus, case when test then 'test' else 'train' end as split
      from q, m where test or rn <= least""",
)
def prepare_undersampled(t):
    config = PrepareConfig(
        keys=["o_orderkey"],
        target="o_orderstatus",
        problem="Classification",
        imputation_strategy="drop",
        scaling_method="standard",
        imbalance_handling={"method": "undersample"},
    )
    return rounded(prepare(holes(t).select("o_orderkey", "o_totalprice", "o_weight", "o_orderstatus"), config)[1])


@query(
    "align_features",
    "select o_orderkey, o_totalprice, 0.0::double as absent, coalesce(try_cast(o_orderpriority as double), 0.0) as o_orderpriority, cast(o_custkey as double) as o_custkey from orders",
)
def align_features(t):
    return align(t("orders"), ["o_totalprice", "absent", "o_orderpriority", "o_custkey"], ["o_orderkey"])
