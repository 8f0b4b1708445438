"""Sources and sinks: each query writes a table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import new_path, spread
from ..sources import tables, texts, variants
from .registry import DIRTY_CUSTOMER, STRINGLY, dirty_customer, query, stringly_events, table


@query("s1_read_csv", "select c_custkey, c_name, cast(c_nationkey as integer) as c_nationkey, c_acctbal, c_mktsegment from customer")
def s1(spark, folder):
    df = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = new_path(spark, "s1") + ".csv"
    tables.write_table(df, path)
    return tables.read_csv(spark, path, schema=df.schema)


@query("s2_null_tokens", STRINGLY + "select event_id, try_cast(case when value_txt = 'abc' then null else value_txt end as double) as value_txt from stringly")
def s2(spark, folder):
    tokens = [*tables.NULL_TOKENS, "abc"]
    found = tables.infer_types(tables.normalize_nulls(stringly_events(spark, folder), tokens), ["value_txt"])
    return found.withColumn("value_txt", F.col("value_txt").cast("double"))


@query("s2_null_tokens_csv", DIRTY_CUSTOMER + "select c_custkey, bal, nat, segment from dirty")
def s2_csv(spark, folder):
    df = dirty_customer(spark, folder)
    path = new_path(spark, "s2") + ".csv"
    tables.write_table(df.fillna("N/A", ["segment"]), path, nullValue="NA")
    return tables.read_csv(spark, path, null_tokens=tables.NULL_TOKENS)


@query("s3_read_json", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def s3(spark, folder):
    df = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = new_path(spark, "s3") + ".json"
    tables.write_table(df, path)
    return tables.read_json(spark, path, schema=df.schema)


@query(
    "s4_flatten_json",
    """select event_id, event_type, cast(json_extract(props, '$.k') as bigint) as "props.k" from events""",
)
def s4(spark, folder):
    df = table(spark, folder, "events").select(
        "event_id", "event_type", F.from_json("props", "k bigint").alias("props")
    )
    return tables.flatten(df)


@query(
    "s4_unnest_json",
    """select o_custkey, o_orderkey, o_totalprice as "total.price" from orders
       union all select o_custkey, -o_orderkey, -o_totalprice from orders""",
)
def s4_unnest(spark, folder):
    # an object per order with a list of nested objects, written as text and read back
    def entry(sign: int):
        price = F.struct((F.col("o_totalprice") * sign).alias("price")).alias("total")
        return F.struct("o_custkey", (F.col("o_orderkey") * sign).alias("o_orderkey"), price)

    path = new_path(spark, "s4")
    orders = table(spark, folder, "orders")
    orders.select("o_orderdate", F.array(entry(1), entry(-1)).alias("orders")).write.json(path)
    schema = "o_orderdate string, orders array<struct<o_custkey:bigint,o_orderkey:bigint,total:struct<price:double>>>"
    return tables.unnest(tables.read_json(spark, path, schema=schema))


# Orders as JSON of three shapes, so that no row has all fields; "note" is a number in some rows and a text in others.
SHAPES = """case o_orderkey % 3
  when 0 then concat('{"key": ', o_orderkey, ', "price": {"total": ', o_custkey, '}, "note": ', o_custkey, '}')
  when 1 then concat('{"key": ', o_orderkey, ', "price": {"total": ', o_custkey, ', "rate": 0.5}, "open": true, "note": "', o_orderstatus, '"}')
  else concat('{"lines": [{"n": 1, "state": "', o_orderstatus, '"}, {"n": 2}], "key": ', o_orderkey, '}') end"""


@query(
    "s4_changing_shapes",
    """select o_orderkey as id, o_orderkey as key, case when o_orderkey % 3 < 2 then o_custkey end as "price.total",
         case when o_orderkey % 3 = 1 then 0.5::double end as "price.rate", case when o_orderkey % 3 = 1 then true end as open,
         case o_orderkey % 3 when 0 then cast(o_custkey as varchar) when 1 then concat('"', o_orderstatus, '"') end as note
       from orders""",
)
def s4_shapes(spark, folder):
    df = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.expr(SHAPES).alias("text"))
    rows = df.select("id", variants.to_variants(F.col("text")).alias("value"))
    return variants.flatten_variants(rows).drop("lines")


@query(
    "s4_unnest_changing_shapes",
    """select o_orderkey as id, 1::bigint as n, o_orderstatus as state from orders where o_orderkey % 3 = 2
       union all select o_orderkey, 2, null from orders where o_orderkey % 3 = 2""",
)
def s4_unnest_shapes(spark, folder):
    path = new_path(spark, "s4")
    table(spark, folder, "orders").select(F.expr(SHAPES)).write.text(path)
    rows = variants.read_variants(spark, path)
    keyed = rows.select(F.variant_get("value", "$.key", "bigint").alias("id"), "value")
    return variants.flatten_variants(variants.unnest_variants(keyed, "lines"))


@query("s5_read_parquet", "select p_partkey, p_name, p_retailprice from part")
def s5(spark, folder):
    return tables.read_table(spark, f"{folder}/part.parquet").select("p_partkey", "p_name", "p_retailprice")


@query(
    "s6_format_dispatch",
    """select 'csv' as fmt, count(*) as n, round(sum(p_retailprice), 2) as total from part
       union all select 'json', count(*), round(sum(p_retailprice), 2) from part
       union all select 'parquet', count(*), round(sum(p_retailprice), 2) from part""",
)
def s6(spark, folder):
    df = table(spark, folder, "part").select("p_partkey", "p_retailprice")
    parts = []
    for fmt in tables.FORMATS:
        path = new_path(spark, "s6")
        tables.write_table(df, path, fmt)
        options = {"schema": df.schema, "lines": True} if fmt == "json" else {"schema": df.schema}
        back = tables.read_table(spark, path, fmt, **({} if fmt == "parquet" else options))
        parts.append(back.agg(F.lit(fmt).alias("fmt"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s7_write_csv", "select s_suppkey, s_name, s_acctbal from supplier")
def s7(spark, folder):
    df = table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = new_path(spark, "s7")
    tables.write_table(df, path, "csv")
    back = tables.read_csv(spark, path)
    return back.withColumn("s_suppkey", F.col("s_suppkey").cast("bigint"))


@query("s8_write_json", DIRTY_CUSTOMER + "select * from dirty")
def s8(spark, folder):
    df = dirty_customer(spark, folder)
    path = new_path(spark, "s8")
    tables.write_table(df, path, "json")
    return tables.read_json(spark, path, schema=df.schema)


@query("s9_write_parquet", DIRTY_CUSTOMER + "select * from dirty")
def s9(spark, folder):
    df = dirty_customer(spark, folder)
    path = new_path(spark, "s9")
    tables.write_table(df, path, "parquet")
    return tables.read_table(spark, path, "parquet")


@query(
    "s10_save_result",
    """select p_partkey, round((p_retailprice - a) / (b - a), 6) as p_retailprice
       from part, (select min(p_retailprice) as a, max(p_retailprice) as b from part)""",
)
def s10(spark, folder):
    from ..operators.scaling import normalize
    from .registry import rounded

    df = normalize(table(spark, folder, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])
    path = new_path(spark, "s10") + ".parquet"
    tables.write_table(rounded(df, 6, "p_retailprice"), path)
    return tables.read_table(spark, path)


@query("s11_read_documents", "select conv_id, turn, text from conversations")
def s11(spark, folder):
    # a file for each turn, in folders that name it; each file is read back as one document
    path = new_path(spark, "s11")
    turns = spread(table(spark, folder, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    texts.write_files(turns, path, ["conv_id", "turn"])
    files = texts.read_documents(spark, path, nested=True)
    number = lambda name: F.regexp_extract("path", rf"{name}=(\d+)", 1).cast("bigint").alias(name)
    return files.select(number("conv_id"), number("turn"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@query(
    "s12_collapse_column",
    """select conv_id, cast(floor(turn / 1000) as bigint) as part, string_agg(text, ' ' order by turn) as text
       from conversations group by all""",
)
def s12(spark, folder):
    df = table(spark, folder, "conversations")
    return texts.collapse_column(df, "text", ["turn"], ["conv_id"], position="turn")


@query(
    "s12_collapse_whole_table",
    """with n as (select text, row_number() over (order by doc_id) - 1 as k from documents)
  select cast(floor(k / 100) as bigint) as part, string_agg(text, ' ' order by k) as text from n group by 1""",
)
def s12_whole(spark, folder):
    return texts.collapse_column(table(spark, folder, "documents"), "text", ["doc_id"], rows_per_part=100)


@query(
    "s13_json_to_text",
    """select event_id, json_extract_string(props, '$.k') as vals,
              'k: ' || json_extract_string(props, '$.k') as lines from events""",
)
def s13(spark, folder):
    df = table(spark, folder, "events")
    return df.select(
        "event_id", texts.json_values(F.col("props")).alias("vals"), texts.json_lines(F.col("props")).alias("lines")
    )


@query(
    "s14_row_lines",
    """select concat_ws(' | ', c_custkey::varchar, c_name, coalesce(segment, 'nan')) as line
       from (select c_custkey, c_name, case when c_custkey % 7 = 2 then null else c_mktsegment end as segment from customer)""",
)
def s14(spark, folder):
    df = table(spark, folder, "customer").selectExpr(
        "c_custkey", "c_name", "case when c_custkey % 7 = 2 then null else c_mktsegment end as segment"
    )
    return texts.row_lines(df)


@query("s15_write_text", r"select regexp_replace(text, '[\n\r]+', ' ', 'g') as value from documents")
def s15(spark, folder):
    df = table(spark, folder, "documents").select(F.regexp_replace("text", r"[\n\r]+", " ").alias("text"))
    path = new_path(spark, "s15")
    texts.write_text(df, "text", path)
    return spark.read.text(path)
