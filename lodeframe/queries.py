"""The driver queries of the engine's own operators, each with SQL that says the same where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import profile, scalars
from .functions.core import ORDER, ORIGINAL_ORDER, ROW_ID, qcol
from .functions.stored import scratch
from .operators import apply
from .plans import diff, reconcile
from .plans.publish import published
from .plans.runner import approve, execute, exported, preview, run_plan
from .plans.schema import OperationPlan
from .sources.csv_records import csv_records, parsed, reject_ragged
from .sources.readers import widened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        name = f.__name__
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = widened(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return df.select(*columns) if columns else df


# --- filters ---------------------------------------------------------------------------------------------------------


def _filter(df: DataFrame, *conditions: dict, match: str = "all", keep: bool = True) -> DataFrame:
    return apply("rows.filter", df, conditions=list(conditions), match=match, keep_matching=keep).df


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def filter_exact(spark, d):
    return _filter(table(spark, d, "orders", "o_orderkey", "o_orderstatus"), {"kind": "exact", "column": "o_orderstatus", "value": "F"})


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30")
def filter_numeric(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return _filter(df, {"kind": "numeric", "column": "l_quantity", "operator": "ge", "value": 30})


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'n/a' ELSE (event_id % 10)::VARCHAR END AS v FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0 AND event_id % 10 <> 3")
def filter_numeric_ne_null(spark, d):
    e = F.col("event_id")
    v = F.when(e % 7 == 0, None).when(e % 5 == 0, "n/a").otherwise((e % 10).cast("string"))
    df = table(spark, d, "events", "event_id").withColumn("v", v)
    return _filter(df, {"kind": "numeric", "column": "v", "operator": "ne", "value": 3})


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the of')")
def filter_contains_ci(spark, d):
    df = table(spark, d, "documents", "doc_id", "lang", "text")
    return _filter(df, {"kind": "contains", "column": "text", "value": "The OF"}).select("doc_id", "lang")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'b')")
def filter_starts_with(spark, d):
    return _filter(table(spark, d, "part", "p_partkey", "p_name"), {"kind": "starts_with", "column": "p_name", "value": "B"})


@query("SELECT p_partkey, p_type FROM part WHERE suffix(p_type, 'L')")
def filter_ends_with(spark, d):
    return _filter(table(spark, d, "part", "p_partkey", "p_type"), {"kind": "ends_with", "column": "p_type", "value": "L", "case_sensitive": True})


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-06-30'")
def filter_date_range(spark, d):
    day = F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    df = table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", day.alias("day"))
    return _filter(df, {"kind": "date_range", "column": "day", "start": "1995-01-01", "end": "1996-06-30"})


_BLANKS = "CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN chr(9) || ' ' WHEN 2 THEN '' ELSE event_type END"


def _with_blanks(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, None).when(k == 1, "\t ").when(k == 2, "").otherwise(F.col("event_type"))
    return table(spark, d, "events", "event_id", "event_type").select("event_id", text.alias("t"))


@query(f"SELECT event_id, {_BLANKS} AS t FROM events WHERE event_id % 4 <> 3")
def filter_blank(spark, d):
    return _filter(_with_blanks(spark, d), {"kind": "blank", "column": "t"})


@query(f"SELECT event_id, {_BLANKS} AS t FROM events WHERE event_id % 4 = 3")
def filter_not_blank(spark, d):
    return _filter(_with_blanks(spark, d), {"kind": "blank", "column": "t", "is_blank": False})


_STATUS = "nullif(o_orderstatus, 'O')"


def _statuses(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_orderstatus").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"))


@query(f"SELECT o_orderkey, {_STATUS} AS s FROM orders WHERE o_orderstatus IN ('O', 'P')")
def filter_include_null(spark, d):
    return _filter(_statuses(spark, d), {"kind": "include_values", "column": "s", "values": [None, "P"]})


@query(f"SELECT o_orderkey, {_STATUS} AS s FROM orders WHERE o_orderstatus <> 'F'")
def filter_exclude_null(spark, d):
    return _filter(_statuses(spark, d), {"kind": "exclude_values", "column": "s", "values": ["F"]})


_LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
_TWO = ({"kind": "exact", "column": "l_returnflag", "value": "R"}, {"kind": "numeric", "column": "l_quantity", "operator": "lt", "value": 10})


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10")
def filter_all(spark, d):
    return _filter(table(spark, d, "lineitem", *_LINE), *_TWO)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem WHERE l_returnflag = 'R' OR l_quantity < 10")
def filter_any(spark, d):
    return _filter(table(spark, d, "lineitem", *_LINE), *_TWO, match="any")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'R' OR l_quantity < 10)")
def filter_inverse(spark, d):
    return _filter(table(spark, d, "lineitem", *_LINE), *_TWO, match="any", keep=False)


# --- sorts -----------------------------------------------------------------------------------------------------------


def _by_key(df: DataFrame, key: str) -> DataFrame:
    """Row ids in the order of a unique key, so that SQL can follow."""
    from .plans.identity import dense

    return dense(df, ROW_ID, [qcol(key)])


@query("SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s, row_number() OVER (ORDER BY nullif(o_orderstatus, 'O') NULLS LAST, o_orderpriority DESC NULLS LAST, o_orderkey)::BIGINT AS place FROM orders")
def sort_multi_nulls_last(spark, d):
    df = table(spark, d, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    out = apply("rows.sort", _by_key(df, "o_orderkey"), keys=[{"column": "s"}, {"column": "o_orderpriority", "descending": True}]).df
    return out.select("o_orderkey", "s", qcol(ORDER).alias("place"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey)::BIGINT AS original, row_number() OVER (ORDER BY c_acctbal DESC NULLS FIRST, c_custkey)::BIGINT AS place FROM customer")
def sort_order_metadata(spark, d):
    df = _by_key(table(spark, d, "customer", "c_custkey", "c_acctbal"), "c_custkey")
    out = apply("rows.sort", df, keys=[{"column": "c_acctbal", "descending": True, "nulls_last": False}], preserve_original_order_metadata=True).df
    return out.select("c_custkey", qcol(ORIGINAL_ORDER).alias("original"), qcol(ORDER).alias("place"))


# --- duplicates ------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS dup FROM documents")
def dup_mark(spark, d):
    df = _by_key(table(spark, d, "documents", "doc_id", "text"), "doc_id")
    return apply("duplicates.handle", df, keys=["text"], mode="mark", marker_column="dup").df.select("doc_id", "dup")


@query("SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1")
def dup_remove_first(spark, d):
    df = _by_key(table(spark, d, "part", "p_partkey", "p_name"), "p_partkey")
    return apply("duplicates.handle", df, keys=["p_name"], mode="remove").df.select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey DESC) = 1")
def dup_remove_last(spark, d):
    df = _by_key(table(spark, d, "part", "p_partkey", "p_name"), "p_partkey")
    return apply("duplicates.handle", df, keys=["p_name"], mode="remove", keep="last").df.select("p_partkey", "p_name")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def dup_move(spark, d):
    df = _by_key(table(spark, d, "documents", "doc_id", "lang", "text"), "doc_id")
    out = apply("duplicates.handle", df, keys=["text"], mode="move")
    return out.aux["Duplicates"].select("doc_id", "lang")


@query("""
WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN NULL ELSE event_type END AS t,
                  CASE WHEN event_id % 2 = 0 THEN event_type END AS u, 'one' AS same FROM events)
SELECT user_id, arg_min(t, event_id) FILTER (trim(t) <> '') AS first_type, arg_max(u, event_id) AS last_type, min(same) AS same,
       (SELECT string_agg(x.t, '; ' ORDER BY x.at) FROM (SELECT t, min(event_id) AS at FROM e i WHERE i.user_id = e.user_id AND trim(i.t) <> '' GROUP BY t) x) AS types
FROM e GROUP BY user_id
""")
def dup_merge_complementary(spark, d):
    e = F.col("event_id")
    t = F.when(e % 3 == 0, "").when(e % 3 == 1, None).otherwise(F.col("event_type"))
    df = _by_key(table(spark, d, "events", "event_id", "user_id", "event_type"), "event_id").select(
        "user_id", t.alias("first_type"), F.when(e % 2 == 0, F.col("event_type")).alias("last_type"), F.lit("one").alias("same"), t.alias("types"), ROW_ID
    )
    rules = [("first_type", "first_non_blank"), ("last_type", "last_non_blank"), ("same", "require_equal"), ("types", "join_unique")]
    out = apply("duplicates.handle", df, keys=["user_id"], mode="merge_complementary", merge_rules=[{"column": c, "strategy": s} for c, s in rules])
    return out.df.select("user_id", "first_type", "last_type", "same", "types")


@query()
def fuzzy_review(spark, d):
    df = _by_key(table(spark, d, "nation", "n_nationkey", "n_name").unionByName(table(spark, d, "region").selectExpr("r_regionkey + 100 as n_nationkey", "r_name || 'S' as n_name")), "n_nationkey")
    out = apply("duplicates.fuzzy_review", df, columns=["n_name"], threshold=0.7, marker_column="grp").df
    return out.select("n_nationkey", "n_name", "grp")


# --- text and values -------------------------------------------------------------------------------------------------


def _clean(df: DataFrame, columns: list[str], *actions) -> DataFrame:
    listed = [{"kind": a} if isinstance(a, str) else a for a in actions]
    return apply("text.clean", df, columns=columns, actions=listed).df


@query("SELECT c_custkey, regexp_replace(trim(chr(9) || ' ' || replace(c_name, '#', '   ') || '  ', chr(9) || ' '), '\\s+', ' ', 'g') AS n FROM customer")
def text_trim_collapse(spark, d):
    padded = F.concat(F.lit("\t "), F.replace("c_name", F.lit("#"), F.lit("   ")), F.lit("  "))
    df = table(spark, d, "customer", "c_custkey", "c_name").select("c_custkey", padded.alias("n"))
    return _clean(df, ["n"], "trim", "collapse_spaces")


@query("SELECT c_custkey, upper(c_mktsegment) AS u, lower(c_name) AS l FROM customer")
def text_case_ascii(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("u"), F.col("c_name").alias("l"))
    return _clean(_clean(df, ["u"], "uppercase"), ["l"], "lowercase")


@query("SELECT o_orderkey, replace(o_orderpriority, '-', ' / ') AS p, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS s FROM orders")
def text_replace_map(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"))
    df = _clean(df, ["p"], {"kind": "replace", "find": "-", "replacement": " / "})
    return _clean(df, ["s"], {"kind": "mapping_replace", "mapping": {"F": "finished", "O": "open"}})


@query("SELECT p_partkey, translate(p_brand, '#0123', '') AS b FROM part")
def text_remove_chars(spark, d):
    df = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("b"))
    return _clean(df, ["b"], {"kind": "remove_characters", "characters": "#0123"})


@query("SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) WHEN starts_with(c_name, 'C') THEN substr(c_name, 2) ELSE c_name END AS n, CASE WHEN suffix(lower(c_mktsegment), 'ing') THEN left(c_mktsegment, length(c_mktsegment) - 3) WHEN suffix(lower(c_mktsegment), 'e') THEN left(c_mktsegment, length(c_mktsegment) - 1) ELSE c_mktsegment END AS m FROM customer")
def text_affix(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("n"), F.col("c_mktsegment").alias("m"))
    df = _clean(df, ["n"], {"kind": "remove_prefixes", "values": ["Customer#", "C"]})
    return _clean(df, ["m"], {"kind": "remove_suffixes", "values": ["ING", "E"], "case_sensitive": False})


@query()
def text_title(spark, d):
    return _clean(table(spark, d, "part", "p_partkey", "p_name"), ["p_name"], "proper_case")


@query()
def text_nfkc(spark, d):
    return _clean(table(spark, d, "documents", "doc_id", "text"), ["text"], "normalize_unicode")


@query("SELECT doc_id, regexp_replace(text, '[\\x00-\\x1F\\x7F-\\xA0]', '', 'g') AS text FROM documents")
def text_nonprinting(spark, d):
    return _clean(table(spark, d, "documents", "doc_id", "text"), ["text"], "remove_non_printing")


def _standard(df: DataFrame, **parameters) -> DataFrame:
    return apply("values.standardize", df, **parameters).df


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Odisha' WHEN 1 THEN 'Tamil Nadu' WHEN 2 THEN 'Bengaluru City' ELSE c_mktsegment END AS s FROM customer")
def std_state(spark, d):
    k = F.col("c_custkey") % 4
    s = F.when(k == 0, " orissa ").when(k == 1, "TAMIL   nadu").when(k == 2, "blr").otherwise(F.col("c_mktsegment"))
    df = table(spark, d, "customer").select("c_custkey", s.alias("s"))
    return _standard(df, column="s", mode="state", mapping={"BLR": "Bengaluru City"})


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' END AS s FROM orders")
def std_category(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.lower("o_orderstatus").alias("s"))
    return _standard(df, column="s", mode="status_category", mapping={"F": "Done", "O": "Open"}, invalid_policy="null")


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '+91' || lpad(c_custkey::VARCHAR, 10, '9') WHEN 1 THEN '+4930' || lpad(c_custkey::VARCHAR, 8, '1') ELSE 'x' || c_custkey END AS t FROM customer")
def std_phone(spark, d):
    k, n = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    ten = F.lpad(n, 10, "9")
    t = F.when(k == 0, F.concat(F.left(ten, F.lit(5)), F.lit(" "), F.right(ten, F.lit(5)))).when(k == 1, F.concat(F.lit("+49 (30) "), F.lpad(n, 8, "1"))).otherwise(F.concat(F.lit("x"), n))
    df = table(spark, d, "customer").select("c_custkey", t.alias("t"))
    return _standard(df, column="t", mode="telephone", default_country_code="91")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'c' || c_custkey || '@example.org' END AS e FROM customer")
def std_email(spark, d):
    n = F.col("c_custkey").cast("string")
    e = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("c"), n, F.lit("@example"))).otherwise(F.concat(F.lit("  C"), n, F.lit("@Example.ORG\t")))
    df = table(spark, d, "customer").select("c_custkey", e.alias("e"))
    return _standard(df, column="e", mode="email", invalid_policy="null")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '31/02/2020' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS t FROM orders")
def std_date(spark, d):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("31/02/2020")
    return _standard(table(spark, d, "orders").select("o_orderkey", t.alias("t")), column="t", mode="date")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey END AS v FROM orders")
def std_numeric(spark, d):
    v = F.when(F.col("o_orderkey") % 4 == 0, "none").otherwise(F.col("o_orderkey").cast("string"))
    df = table(spark, d, "orders").select("o_orderkey", v.alias("v"))
    return _standard(df, column="v", mode="numeric_text", numeric_target="integer", invalid_policy="null")


# --- columns ---------------------------------------------------------------------------------------------------------


def _transform(df: DataFrame, *actions: dict) -> DataFrame:
    return apply("columns.transform", df, actions=list(actions)).df


@query("SELECT c_name AS c_custkey, c_custkey AS c_name, 'new' AS note FROM customer")
def col_rename_reorder_add_remove(spark, d):
    return _transform(
        table(spark, d, "customer"),
        {"kind": "rename", "mapping": {"c_custkey": "c_name", "c_name": "c_custkey"}},
        {"kind": "add", "name": "note", "value": "new"},
        {"kind": "remove", "columns": ["c_acctbal"]},
        {"kind": "reorder", "columns": ["note", "c_name", "c_custkey"], "append_unlisted": False},
    )


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) END AS b FROM orders")
def col_split(spark, d):
    return _transform(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), {"kind": "split", "source": "o_orderpriority", "delimiter": "-", "output_columns": ["a", "b"], "keep_source": False})


@query("SELECT o_orderkey, concat_ws('|', nullif(o_orderstatus, 'O'), o_orderkey) AS a, coalesce(nullif(o_orderstatus, 'O'), '') || ' ' || o_orderpriority AS b FROM orders")
def col_combine(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"), "o_orderpriority")
    out = _transform(df, {"kind": "combine", "columns": ["s", "o_orderkey"], "output": "a", "delimiter": "|"}, {"kind": "combine", "columns": ["s", "o_orderpriority"], "output": "b", "skip_nulls": False})
    return out.select("o_orderkey", "a", "b")


@query("SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS a, CASE WHEN contains(o_orderpriority, '-') THEN substr(o_orderpriority, instr(o_orderpriority, '-') + 1) ELSE '' END AS b, substr(o_orderpriority, 3, 4) AS c FROM orders")
def col_extract(spark, d):
    out = _transform(
        table(spark, d, "orders", "o_orderkey", "o_orderpriority"),
        {"kind": "extract_before", "source": "o_orderpriority", "output": "a", "delimiter": "-"},
        {"kind": "extract_after", "source": "o_orderpriority", "output": "b", "delimiter": "-"},
        {"kind": "extract_fixed", "source": "o_orderpriority", "output": "c", "start": 2, "length": 4, "keep_source": False},
    )
    return out.select("o_orderkey", "a", "b", "c")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'nothing' ELSE o_orderstatus END AS a, CASE WHEN o_orderstatus = 'F' THEN 1 END AS b FROM orders")
def col_lookup(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    out = _transform(df, {"kind": "lookup", "source": "s", "output": "a", "mapping": {"F": "done", "None": "nothing"}}, {"kind": "lookup", "source": "s", "output": "b", "mapping": {"F": 1}, "unmatched_policy": "null"})
    return out.select("o_orderkey", "a", "b")


@query("SELECT c_custkey, 100 + 5 * (row_number() OVER (ORDER BY c_custkey) - 1) AS n FROM customer")
def col_row_number(spark, d):
    df = _by_key(table(spark, d, "customer", "c_custkey"), "c_custkey")
    return _transform(df, {"kind": "row_number", "output": "n", "start": 100, "step": 5}).select("c_custkey", "n")


@query("""SELECT c_custkey, 'C-' || left(sha256('{"namespace":"clients","values":["' || c_name || '",' || c_custkey || ']}'), 20) AS id FROM customer""")
def col_deterministic_id(spark, d):
    df = table(spark, d, "customer", "c_custkey", "c_name")
    return _transform(df, {"kind": "deterministic_id", "output": "id", "columns": ["c_name", "c_custkey"], "namespace": "clients", "prefix": "C-", "length": 20}).select("c_custkey", "id")


# --- calculations ----------------------------------------------------------------------------------------------------


def _calc(df: DataFrame, *actions: dict) -> DataFrame:
    for a in actions:
        df = apply("calculate.column", df, action=a).df
    return df


_KEY = ("l_orderkey", "l_partkey", "l_suppkey")
_KEYS = "l_orderkey, l_partkey, l_suppkey"


def _op(*names) -> list[dict]:
    return [{"column": n} if isinstance(n, str) else {"value": n} for n in names]


@query(f"SELECT {_KEYS}, l_quantity + l_tax + 1 AS a, l_extendedprice - l_discount AS s, l_quantity * l_discount * 2 AS m FROM lineitem")
def calc_arith(spark, d):
    out = _calc(
        table(spark, d, "lineitem"),
        {"kind": "addition", "output": "a", "operands": _op("l_quantity", "l_tax", 1)},
        {"kind": "subtraction", "output": "s", "operands": _op("l_extendedprice", "l_discount")},
        {"kind": "multiplication", "output": "m", "operands": _op("l_quantity", "l_discount", 2)},
    )
    return out.select(*_KEY, "a", "s", "m")


@query(f"SELECT {_KEYS}, l_tax / nullif(l_discount, 0) AS q FROM lineitem")
def calc_division_zero(spark, d):
    return _calc(table(spark, d, "lineitem"), {"kind": "division", "output": "q", "operands": _op("l_tax", "l_discount")}).select(*_KEY, "q")


@query(f"SELECT {_KEYS}, l_quantity / nullif(l_discount, 0) * 100 AS q FROM lineitem")
def calc_percentage(spark, d):
    return _calc(table(spark, d, "lineitem"), {"kind": "percentage", "output": "q", "numerator": {"column": "l_quantity"}, "denominator": {"column": "l_discount"}}).select(*_KEY, "q")


@query(f"SELECT {_KEYS}, l_quantity * l_extendedprice AS q, l_linenumber::BIGINT * l_partkey AS i FROM lineitem")
def calc_qty_price(spark, d):
    out = _calc(table(spark, d, "lineitem"), {"kind": "quantity_price", "output": "q", "quantity_column": "l_quantity", "price_column": "l_extendedprice"}, {"kind": "quantity_price", "output": "i", "quantity_column": "l_linenumber", "price_column": "l_partkey"})
    return out.select(*_KEY, "q", "i")


@query(f"SELECT {_KEYS}, l_extendedprice * 18.0::DOUBLE / 100 AS g, l_extendedprice + l_extendedprice * 5.0::DOUBLE / 100 AS t FROM lineitem")
def calc_gst(spark, d):
    out = _calc(table(spark, d, "lineitem"), {"kind": "gst", "output": "g", "base_column": "l_extendedprice", "rate_percent": 18}, {"kind": "gst", "output": "t", "base_column": "l_extendedprice", "rate_percent": 5, "include_base": True})
    return out.select(*_KEY, "g", "t")


_YEARS = "year({b}) - year({a}) - (month({b}) * 100 + day({b}) < month({a}) * 100 + day({a}))::INT"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS a, DATE '2000-02-29' AS b FROM orders)
SELECT o_orderkey, datediff('day', a, b) AS days, ((year(b) * 12 + month(b)) - (year(a) * 12 + month(a)))::BIGINT AS months,
       ({_YEARS.format(a="a", b="b")})::BIGINT AS years FROM o""")
def calc_date_diff(spark, d):
    df = table(spark, d, "orders", "o_orderkey", "o_orderdate").withColumn("e", F.lit("2000-02-29"))
    return _calc(df, *[{"kind": "date_difference", "output": u, "start_column": "o_orderdate", "end_column": "e", "unit": u} for u in ("days", "months", "years")]).select("o_orderkey", "days", "months", "years")


@query(f"SELECT o_orderkey, CASE WHEN o_orderdate::DATE <= DATE '1996-03-01' THEN ({_YEARS.format(a='o_orderdate', b='DATE ' + repr('1996-03-01'))})::BIGINT END AS age FROM orders")
def calc_age(spark, d):
    return _calc(table(spark, d, "orders", "o_orderkey", "o_orderdate"), {"kind": "age", "output": "age", "birth_date_column": "o_orderdate", "as_of": "1996-03-01"}).select("o_orderkey", "age")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN 'big done' WHEN o_totalprice > 200000 OR o_orderstatus = 'P' THEN 'look' ELSE 'plain' END AS c FROM orders")
def calc_classify(spark, d):
    big, status = {"kind": "numeric", "column": "o_totalprice", "operator": "gt", "value": 200000}, {"kind": "exact", "column": "o_orderstatus"}
    rules = [{"conditions": [big, status | {"value": "F"}], "value": "big done"}, {"conditions": [big, status | {"value": "P"}], "match": "any", "value": "look"}]
    return _calc(table(spark, d, "orders"), {"kind": "conditional_classification", "output": "c", "rules": rules, "default": "plain"}).select("o_orderkey", "c")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS v FROM orders")
def calc_lookup_value(spark, d):
    return _calc(table(spark, d, "orders"), {"kind": "lookup_value", "output": "v", "source_column": "o_orderstatus", "mapping": {"F": 1, "O": 2}, "default": 0}).select("o_orderkey", "v")


@query("SELECT event_id, round(coalesce(sum(v) OVER w, 0), 2) AS sum, round(avg(v) OVER w, 4) AS mean, min(v) OVER w AS min, max(v) OVER w AS max, count(v) OVER w AS count FROM (SELECT event_id, nullif(event_type, 'click') AS g, CASE WHEN event_id % 6 <> 0 THEN value END AS v FROM events) WINDOW w AS (PARTITION BY g)")
def calc_group_total(spark, d):
    df = table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("g"), F.when(F.col("event_id") % 6 != 0, F.col("value")).alias("v"))
    out = _calc(df, *[{"kind": "group_total", "output": a, "group_by": ["g"], "value_column": "v", "aggregation": a} for a in ("sum", "mean", "min", "max", "count")])
    return out.select("event_id", F.round("sum", 2).alias("sum"), F.round("mean", 4).alias("mean"), "min", "max", "count")


_RUN = "SELECT event_id, user_id, ts, CASE WHEN event_id % 6 <> 0 THEN value END AS v FROM events"


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) END AS r FROM ({_RUN})")
def calc_running_total(spark, d):
    df = _by_key(table(spark, d, "events"), "event_id").withColumn("v", F.when(F.col("event_id") % 6 != 0, F.col("value")))
    return _calc(df, {"kind": "running_total", "output": "r", "value_column": "v", "group_by": ["user_id"], "order_by": ["ts"]}).select("event_id", F.round("r", 2).alias("r"))


@query(f"SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING), 2) END AS r FROM ({_RUN})")
def calc_running_total_whole(spark, d):
    df = _by_key(table(spark, d, "events"), "event_id").withColumn("v", F.when(F.col("event_id") % 6 != 0, F.col("value")))
    return _calc(df, {"kind": "running_total", "output": "r", "value_column": "v"}).select("event_id", F.round("r", 2).alias("r"))


_STATS = ("count", "null_count", "unique_count", "sum", "mean", "min", "max", "median")


@query("""WITH p AS (SELECT nullif(p_size, 5)::BIGINT AS s FROM part)
SELECT 'p_size' AS "Column", unnest(['count', 'null_count', 'unique_count', 'sum', 'mean', 'min', 'max', 'median']) AS "Statistic",
       unnest([count(s), count(*) - count(s), count(DISTINCT s) + max((s IS NULL)::INT), sum(s), avg(s), min(s), max(s), median(s)]::DOUBLE[]) AS "Value" FROM p""")
def summary_stats(spark, d):
    df = table(spark, d, "part", "p_size").withColumn("p_size", F.nullif("p_size", F.lit(5)))
    return apply("calculate.summary", df, columns=["p_size"], statistics=list(_STATS)).aux["Summary Statistics"]


# --- validation ------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 9 = 0 THEN '12-3' ELSE '98765 43210' END AS t,
  CASE WHEN o_orderkey % 8 = 0 THEN 'x@y' ELSE 'a@b.co' END AS e, CASE WHEN o_orderkey % 7 = 0 THEN 'no' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS w, o_totalprice AS v,
  nullif(o_orderstatus, 'O') AS s, o_custkey AS c, CASE WHEN o_orderkey % 6 = 0 THEN '#REF!' ELSE 'ok' END AS f FROM orders)
SELECT * FROM (
SELECT 'missing_required' AS "Code", 'p' AS "Column", count(*) AS "Affected" FROM o WHERE trim(p) = ''
UNION ALL SELECT 'invalid_telephone', 't', count(*) FROM o WHERE t = '12-3'
UNION ALL SELECT 'invalid_email', 'e', count(*) FROM o WHERE e = 'x@y'
UNION ALL SELECT 'invalid_date_range', 'w', count(*) FROM o WHERE w = 'no' OR w < '1995-01-01'
UNION ALL SELECT 'invalid_numeric_range', 'v', count(*) FROM o WHERE v > 300000
UNION ALL SELECT 'value_not_allowed', 's', count(*) FROM o WHERE s IS NULL
UNION ALL SELECT 'duplicate_id', 'c', count(*) FROM (SELECT count(*) OVER (PARTITION BY c) AS n FROM o) WHERE n > 1
UNION ALL SELECT 'missing_lookup', 's', count(*) FROM o WHERE s IS DISTINCT FROM 'F'
UNION ALL SELECT 'formula_error', NULL, count(*) FROM o WHERE f = '#REF!'
UNION ALL SELECT 'row_count_mismatch', NULL, count(*) - 7 FROM o
UNION ALL SELECT 'total_mismatch', 'v', 0) WHERE "Affected" > 0 OR "Code" = 'total_mismatch'""")
def validate_rules(spark, d):
    k = F.col("o_orderkey")
    df = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k % 10 == 0, " ").otherwise(F.col("o_orderpriority")).alias("p"),
        F.when(k % 9 == 0, "12-3").otherwise("98765 43210").alias("t"),
        F.when(k % 8 == 0, "x@y").otherwise("a@b.co").alias("e"),
        F.when(k % 7 == 0, "no").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("w"),
        F.col("o_totalprice").alias("v"),
        F.nullif("o_orderstatus", F.lit("O")).alias("s"),
        F.col("o_custkey").alias("c"),
        F.when(k % 6 == 0, "#REF!").otherwise("ok").alias("f"),
    )
    rules = [
        {"kind": "required_fields", "columns": ["p"]},
        {"kind": "telephone", "column": "t"},
        {"kind": "email", "column": "e"},
        {"kind": "date_range", "column": "w", "minimum": "1995-01-01"},
        {"kind": "numeric_range", "column": "v", "maximum": 300000},
        {"kind": "allowed_values", "column": "s", "values": ["F", "P"]},
        {"kind": "duplicate_id", "columns": ["c"]},
        {"kind": "missing_lookup", "column": "s", "allowed_keys": ["F"]},
        {"kind": "formula_errors"},
        {"kind": "row_count", "expected": 7},
        {"kind": "total", "column": "v", "expected": 1},
        {"kind": "blank_rows"},
        {"kind": "invalid_headers"},
    ]
    out = apply("quality.validate", df, rules=rules).aux["Validation Issues"]
    return out.select("Code", "Column", F.col("Affected Rows").alias("Affected"))


# --- differences, reconciliation, tables -----------------------------------------------------------------------------


def _before_after(spark, d):
    before = _by_key(table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal"), "c_custkey")
    after = _clean(before, ["c_mktsegment"], {"kind": "replace", "find": "BUILDING", "replacement": "BUILT"})
    after = _filter(after, {"kind": "numeric", "column": "c_acctbal", "operator": "ge", "value": 0})
    return before, after


@query("""SELECT row_number() OVER (ORDER BY c_custkey)::BIGINT AS row_id, 'cell_changed' AS kind, 'c_mktsegment' AS "column", c_mktsegment AS old, replace(c_mktsegment, 'BUILDING', 'BUILT') AS new
FROM customer QUALIFY c_acctbal >= 0 AND contains(c_mktsegment, 'BUILDING')""")
def diff_cells(spark, d):
    found = diff.changes(*_before_after(spark, d), reordered=False)
    return found.where("kind = 'cell_changed'").drop("change_id")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY i) AS j FROM n WHERE c_acctbal >= 0)
SELECT kind, count(*) AS n FROM (SELECT 'row_deleted' AS kind FROM n WHERE c_acctbal < 0 UNION ALL SELECT 'row_reordered' FROM k WHERE i <> j
UNION ALL SELECT 'cell_changed' FROM k WHERE contains(c_mktsegment, 'BUILDING')) GROUP BY kind""")
def diff_rows(spark, d):
    return diff.changes(*_before_after(spark, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS rows_before, count(*) FILTER (c_acctbal >= 0) AS rows_after, count(*) FILTER (c_acctbal >= 0 AND contains(c_mktsegment, 'BUILDING')) AS rows_changed,
0::BIGINT AS rows_added, count(*) FILTER (c_acctbal < 0) AS rows_removed FROM customer""")
def reconcile_rows(spark, d):
    return reconcile.row_changes(*_before_after(spark, d))


@query("""SELECT 'c_custkey' AS "column", sum(c_custkey)::DOUBLE AS before, (sum(c_custkey) FILTER (c_acctbal >= 0))::DOUBLE AS after FROM customer
UNION ALL SELECT 'c_acctbal', round(sum(c_acctbal), 2), round(sum(c_acctbal) FILTER (c_acctbal >= 0), 2) FROM customer""")
def reconcile_totals(spark, d):
    return reconcile.totals(*_before_after(spark, d)).select("column", F.round("before", 2).alias("before"), F.round("after", 2).alias("after"))


def _partners(spark, d):
    pick = lambda t, p, *more: table(spark, d, t).select(F.col(f"{p}key").alias("k"), F.col(f"{p[0]}_name").alias("name"), *more)
    return {"customers": pick("customer", "c_cust", F.col("c_mktsegment").alias("segment")), "suppliers": pick("supplier", "s_supp")}


@query("SELECT c_custkey AS k, c_name AS name, 'customers' AS origin FROM customer UNION ALL SELECT s_suppkey, s_name, 'suppliers' FROM supplier")
def merge_strict(spark, d):
    tables = {n: t.select("k", "name") for n, t in _partners(spark, d).items()}
    return apply("tables.merge", tables, source_column="origin").df


@query("SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def merge_union(spark, d):
    return apply("tables.merge", _partners(spark, d), schema_mode="union").df


@query("SELECT 'T ' || event_type AS name, event_id FROM events")
def split_categories(spark, d):
    df = _by_key(table(spark, d, "events", "event_id", "event_type"), "event_id")
    parts = apply("table.split_by_category", df, category_column="event_type", table_prefix="T ", drop_category_column=True).aux
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("name"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT 'event_id' AS name, 'integer' AS types, 0.0::DOUBLE AS blanks, count(DISTINCT event_id) AS uniques, count(DISTINCT event_id) = count(*) AS candidate FROM events
UNION ALL SELECT 'event_type', 'text', 0.0, count(DISTINCT event_type), count(DISTINCT event_type) = count(*) FROM events
UNION ALL SELECT 'value', 'number', 0.0, count(DISTINCT value), count(DISTINCT value) = count(*) FROM events
UNION ALL SELECT 'half', 'numeric_text,text', round(100.0 * avg((event_id % 4 = 0)::INT), 2), count(DISTINCT CASE event_id % 4 WHEN 1 THEN 'a' WHEN 2 THEN '12' WHEN 3 THEN '-1.5' END), false FROM events""")
def profile_columns(spark, d):
    k = F.col("event_id") % 4
    half = F.when(k == 1, "a").when(k == 2, "12").when(k == 3, "-1.5").otherwise(" ")
    df = table(spark, d, "events", "event_id", "event_type", "value").withColumn("half", half)
    out = profile.profile_columns(df)
    return out.select("name", F.col("inferred_types").alias("types"), F.col("blank_percentage").alias("blanks"), F.col("unique_count").alias("uniques"), F.col("candidate_key").alias("candidate"))


@query("SELECT count(*) AS data_rows, count(*) FILTER (p_name = '') AS blank_rows, count(*) FILTER (p_name <> '') - count(DISTINCT p_name) FILTER (p_name <> '') AS duplicate_rows FROM (SELECT CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_name END AS p_name FROM part)")
def profile_rows(spark, d):
    name = F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_name"))
    return profile.profile_rows(table(spark, d, "part").select(name.alias("p_name")))


# --- scalar services and plans ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '=' || p_name WHEN 1 THEN ' @' || p_name WHEN 2 THEN '''=' || p_name WHEN 3 THEN '-1' ELSE p_name END AS t FROM part)
SELECT p_partkey, p_partkey % 5 IN (0, 1, 3) AS formula, CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN '''' || t ELSE t END AS safe FROM p""")
def formula_guard(spark, d):
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    t = F.when(k == 0, F.concat(F.lit("="), n)).when(k == 1, F.concat(F.lit(" @"), n)).when(k == 2, F.concat(F.lit("'="), n)).when(k == 3, "-1").otherwise(n)
    df = table(spark, d, "part").select("p_partkey", t.alias("t"))
    return df.select("p_partkey", scalars.starts_formula(F.col("t")).alias("formula"), scalars.neutral(F.col("t")).alias("safe"))


@query("SELECT c_custkey, 'mail [REDACTED] or call [REDACTED], key [REDACTED]' AS t FROM customer")
def redact_text(spark, d):
    n = F.col("c_custkey").cast("string")
    t = F.concat(F.lit("mail c"), n, F.lit("@example.org or call +49 30 "), F.lpad(n, 9, "1"), F.lit(", key sk-"), F.lpad(n, 16, "a"))
    return table(spark, d, "customer").select("c_custkey", scalars.redacted(t).alias("t"))


@query("SELECT event_id, '<integer>' AS a, '<text:length=' || length(event_type) || '>' AS b, '<number>' AS c FROM events")
def anonymise_cells(spark, d):
    df = table(spark, d, "events", "event_id", "event_type", "value")
    return df.select("event_id", scalars.shape_marker(df, "event_id").alias("a"), scalars.shape_marker(df, "event_type").alias("b"), scalars.shape_marker(df, "value").alias("c"))


def order_plan() -> OperationPlan:
    """The flagship plan: filter, calculate, classify, sort."""
    source = uuid.UUID(int=1)
    target = {"source_id": source, "sheet": "Orders"}
    step = lambda i, op, parameters, destructive=False: {
        "step_id": f"s{i}", "operation": op, "parameters": parameters, "target": target, "explanation": op,
        "destructive": destructive, "confirmation_required": destructive, "depends_on": [f"s{i - 1}"] if i > 1 else [],
    }
    big = {"kind": "numeric", "column": "o_totalprice", "operator": "ge", "value": 150000}
    return OperationPlan.model_validate(
        {
            "job_name": "orders",
            "source_files": [{"source_id": source, "file_name": "orders.parquet", "sha256": "0" * 64}],
            "output": {"output_name": "orders.csv", "format": "csv"},
            "steps": [
                step(1, "rows.filter", {"conditions": [{"kind": "numeric", "column": "o_totalprice", "operator": "gt", "value": 1000}]}, True),
                step(2, "text.clean", {"columns": ["o_orderpriority"], "actions": [{"kind": "lowercase"}, {"kind": "replace", "find": "-", "replacement": " "}]}),
                step(3, "calculate.column", {"action": {"kind": "gst", "output": "gst", "base_column": "o_totalprice", "rate_percent": 18}}),
                step(4, "calculate.column", {"action": {"kind": "conditional_classification", "output": "size", "rules": [{"conditions": [big], "value": "big"}], "default": "small"}}),
                step(5, "rows.sort", {"keys": [{"column": "size"}, {"column": "o_totalprice", "descending": True}]}),
                step(6, "columns.transform", {"actions": [{"kind": "row_number", "output": "rank"}]}),
            ],
        }
    )


@query(r"""SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS o_orderdate,
CASE WHEN o_orderkey % 3 = 0 THEN 'says "' || lower(o_orderpriority) || '",' || chr(10) || '"' || o_orderstatus || '", ' || chr(10) || chr(10) || 'end' ELSE o_orderpriority END AS note
FROM orders""")
def csv_quoted_lines(spark, d):
    """Orders written as CSV, some with quotes, separators and line ends in a cell, and read back by splits."""
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority", "o_orderstatus")
    note = F.concat(F.lit('says "'), F.lower("o_orderpriority"), F.lit('",\n"'), "o_orderstatus", F.lit('", \n\nend'))
    note = F.when(F.col("o_orderkey") % 3 == 0, note).otherwise(F.col("o_orderpriority"))
    place = scratch(spark, "csv")
    rows = df.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"), note.alias("note"))
    rows.write.csv(place, header=True, quote='"', escape='"')
    return widened(parsed(reject_ragged(csv_records(spark, place)), ",", ROW_ID)).drop(ROW_ID)


@query("""SELECT 'customer - Parquet' AS name, c_custkey AS k, upper(c_name) AS v FROM customer UNION ALL SELECT 'supplier - Parquet', s_suppkey, s_name FROM supplier""")
def publish_two_sources(spark, d):
    """Two sources whose tables have one name are previewed, approved, published and read back."""
    ids = [uuid.UUID(int=i) for i in (1, 2)]
    names = ("customer", "supplier")
    tables = {(i, "Parquet"): table(spark, d, n, f"{n[0]}_{k}key", f"{n[0]}_name").toDF("k", "v") for i, n, k in zip(ids, names, ("cust", "supp"), strict=True)}
    step = {"step_id": "s", "operation": "text.clean", "parameters": {"columns": ["v"], "actions": [{"kind": "uppercase"}]}, "target": {"source_id": ids[0]}, "explanation": "x"}
    files = [{"source_id": i, "file_name": f"{n}.parquet", "sha256": "0" * 64} for i, n in zip(ids, names, strict=True)]
    plan = OperationPlan.model_validate({"job_name": "partners", "source_files": files, "steps": [step], "output": {"output_name": "partners", "format": "parquet"}})
    seen = preview(plan, tables)
    place = scratch(spark, "published")
    execute(plan, tables, seen, approve(seen), place)
    parts = [t.select(F.lit(n).alias("name"), "k", "v") for n, t in published(spark, place, verify=True).items()]
    return parts[0].unionByName(parts[1])


@query("""SELECT o_orderkey, o_totalprice, replace(lower(o_orderpriority), '-', ' ') AS o_orderpriority, o_totalprice * 18.0::DOUBLE / 100 AS gst,
CASE WHEN o_totalprice >= 150000 THEN 'big' ELSE 'small' END AS size,
row_number() OVER (ORDER BY CASE WHEN o_totalprice >= 150000 THEN 'big' ELSE 'small' END, o_totalprice DESC, o_orderkey)::BIGINT AS rank FROM orders WHERE o_totalprice > 1000""")
def plan_end_to_end(spark, d):
    df = _by_key(table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")
    plan = order_plan()
    run = run_plan(plan, {(plan.source_files[0].source_id, "Orders"): df})
    return exported(next(iter(run.tables.values())))
