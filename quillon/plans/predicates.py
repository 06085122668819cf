"""Projection, filters, predicates and rule tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, textx
from ..functions.criteria import criterion
from ..operators import intervals, measures, sheets
from ..session import table
from .registry import Registry


def _prepare() -> None:
    """Columns that several queries use."""
    global STATUS, _SRC, _TGT, _STATUS
    STATUS = F.lit(200) + (F.col("event_id") * 7 % 400)
    _SRC = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    _TGT = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.floor(F.col("p_partkey") / 8) % 8 + 1).cast("int"))
    _STATUS = F.element_at(F.array(*[F.lit(x) for x in ("active", "trialing", "past_due", "paused", "canceled")]), (F.col("c_custkey") % 5 + 1).cast("int"))


registry = Registry(_prepare)
add = registry.add

add(
    "b01_column_union",
    lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    .unionByName(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), allowMissingColumns=True),
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INT AS size FROM customer
       UNION ALL BY NAME SELECT p_partkey AS id, p_name AS name, NULL::DOUBLE AS balance, p_size AS size FROM part""",
)


def _flatten(s, d):
    o = table(s, d, "orders").select(F.struct(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("status")).alias("meta")).alias("o"), F.array("o_orderpriority", "o_orderstatus").alias("tags"))
    return o.select(F.col("o.key").alias("o.key"), F.col("o.meta.status").alias("o.meta.status"), F.to_json("tags").alias("tags"))


add(
    "b02_struct_flatten",
    _flatten,
    """SELECT o_orderkey AS "o.key", o_orderstatus AS "o.meta.status", '["' || o_orderpriority || '","' || o_orderstatus || '"]' AS tags FROM orders""",
)

def _book(s, d):
    """Two sheets of a book, in order."""
    return table(s, d, "region").select(F.lit(0).alias("ordinal"), F.lit("regions").alias("sheet"), F.col("r_name").alias("cell")).unionAll(table(s, d, "nation").select(F.lit(1), F.lit("nations"), "n_name"))


def _cell():
    """A number, a text or a truth value, in turn."""
    kind = F.element_at(F.array(F.lit("number"), F.lit("text"), F.lit("boolean")), F.col("n_nationkey") % 3 + 1)
    value = F.when(kind == "number", F.col("n_nationkey").cast("string")).when(kind == "text", F.lower("n_name")).otherwise(F.lit("TRUE"))
    return F.struct(kind.alias("kind"), value.alias("value"))


add(
    "b03_range_projection",
    lambda s, d: sheets.project(table(s, d, "customer"), "c_custkey", "B12:D61,A1:A3"),
    """SELECT c_name, c_nationkey, c_acctbal FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) WHERE r BETWEEN 12 AND 61""",
)

add(
    "b04_sheet_selection",
    lambda s, d: sheets.select_sheets(_book(s, d), "index", 1).select(F.lit("index").alias("mode"), "sheet", "cell")
    .unionByName(sheets.select_sheets(_book(s, d), "merged").select(F.lit("merged").alias("mode"), "sheet", "cell"))
    .unionByName(sheets.select_sheets(_book(s, d), "split").select(F.lit("split").alias("mode"), F.col("file").alias("sheet"), "cell")),
    """WITH b AS (SELECT 'regions' AS sheet, r_name AS cell FROM region UNION ALL SELECT 'nations', n_name FROM nation)
       SELECT 'index' AS mode, sheet, cell FROM b WHERE sheet = 'nations' UNION ALL SELECT 'merged', sheet, cell FROM b
       UNION ALL SELECT 'split', CASE sheet WHEN 'regions' THEN '1-regions' ELSE '2-nations' END, cell FROM b""",
)


def _criteria(s, d):
    p = table(s, d, "part")
    n, t = F.col("p_size"), F.col("p_type")
    tests = {"gt": criterion(n, ">25", True), "ge": criterion(n, ">=25", True), "ne": criterion(n, "<>7", True), "eq": criterion(n, 7, True), "text": criterion(t, "standard", False), "star": criterion(t, "*d", False), "q": criterion(t, "?romo", False), "blank": criterion(t, "", False), "filled": criterion(t, "<>", False)}
    return p.groupBy("p_brand").agg(*[F.count_if(c).alias(k) for k, c in tests.items()])


add(
    "b05_criteria",
    _criteria,
    """SELECT p_brand, count(*) FILTER (WHERE p_size > 25) AS gt, count(*) FILTER (WHERE p_size >= 25) AS ge, count(*) FILTER (WHERE p_size <> 7) AS ne,
       count(*) FILTER (WHERE p_size = 7) AS eq, count(*) FILTER (WHERE upper(p_type) = 'STANDARD') AS text, count(*) FILTER (WHERE upper(p_type) LIKE '%D') AS star,
       count(*) FILTER (WHERE upper(p_type) LIKE '_ROMO') AS q, count(*) FILTER (WHERE coalesce(p_type, '') = '') AS blank, count(*) FILTER (WHERE coalesce(p_type, '') <> '') AS filled
       FROM part GROUP BY p_brand""",
)

add(
    "b06_comparisons",
    lambda s, d: table(s, d, "nation").select(
        "n_nationkey",
        (F.upper("n_name") == F.upper(F.lower("n_name"))).alias("same_case"),
        (F.upper("n_name") > F.upper(F.lit("germany"))).alias("after"),
        (F.coalesce(F.nullif(F.col("n_regionkey"), F.lit(2)), F.lit(0)) == 0).alias("blank_is_zero"),
        (sheets.ranked(_cell()) > sheets.ranked(F.struct(F.lit("number").alias("kind"), F.lit("7").alias("value")))).alias("above_seven"),
        (sheets.ranked(_cell()) == sheets.ranked(F.struct(F.lit("text").alias("kind"), F.lit("CHINA").alias("value")))).alias("is_china"),
    ),
    """SELECT n_nationkey, upper(n_name) = upper(lower(n_name)) AS same_case, upper(n_name) > 'GERMANY' AS after,
       coalesce(nullif(n_regionkey, 2), 0) = 0 AS blank_is_zero, CASE n_nationkey % 3 WHEN 0 THEN n_nationkey > 7 ELSE true END AS above_seven,
       n_nationkey % 3 = 1 AND lower(n_name) = 'china' AS is_china FROM nation""",
)

add(
    "b07_conditionals",
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_quantity") > 40, "big").when(F.col("l_quantity") > 20, "mid").otherwise("small").alias("ifs"),
        F.coalesce(F.elt(((F.col("l_linenumber") - 1) % 3 + 1).cast("int"), F.lit("a"), F.lit("b"), F.lit("c")), F.lit("other")).alias("choose"),
        (F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2).otherwise(0)).alias("switch"),
        ((F.col("l_quantity") > 10) & (F.col("l_tax") > 0.02)).alias("land"),
        ((F.col("l_quantity") > 45) | (F.col("l_tax") > 0.07)).alias("lor"),
        ((F.col("l_quantity") > 25).cast("int") + (F.col("l_tax") > 0.04).cast("int") + (F.col("l_discount") > 0.05).cast("int")).bitwiseAND(1).cast("boolean").alias("lxor"),
    ),
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS ifs,
       CASE (l_linenumber - 1) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'other' END AS choose,
       CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS switch, l_quantity > 10 AND l_tax > 0.02 AS land, l_quantity > 45 OR l_tax > 0.07 AS lor,
       ((l_quantity > 25)::INT + (l_tax > 0.04)::INT + (l_discount > 0.05)::INT) % 2 = 1 AS lxor FROM lineitem""",
)

add(
    "b08_error_handling",
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey",
        F.try_divide(F.col("o_totalprice"), F.col("o_orderkey") % 5).alias("divided"),
        F.coalesce(F.try_divide(F.lit(1.0), F.col("o_orderkey") % 3), F.lit(-1.0)).alias("iferror"),
        F.expr("try_cast(o_orderpriority AS INT)").isNull().alias("iserror"),
        F.struct(F.try_divide(F.lit(1.0), F.col("o_orderkey") % 2).alias("value"), F.when(F.col("o_orderkey") % 2 == 0, "#DIV/0!").alias("error")).getField("error").alias("error"),
    ),
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / (o_orderkey % 5) END AS divided,
       CASE WHEN o_orderkey % 3 <> 0 THEN 1.0::DOUBLE / (o_orderkey % 3) ELSE -1 END AS iferror, TRY_CAST(o_orderpriority AS INT) IS NULL AS iserror,
       CASE WHEN o_orderkey % 2 = 0 THEN '#DIV/0!' END AS error FROM orders""",
)

add(
    "b09_type_tests",
    lambda s, d: table(s, d, "events").select(
        "event_id", F.get_json_object("props", "$.k").rlike(r"^-?\d+(\.\d+)?$").alias("isnumber"), F.col("props").isNull().alias("isblank"),
        (F.pmod(F.floor("value"), F.lit(2)) == 0).alias("iseven"), (F.pmod(F.floor("value"), F.lit(2)) == 1).alias("isodd"), (F.col("event_type") == "click").cast("int").alias("n"),
    ),
    """SELECT event_id, regexp_matches(json_extract_string(props, '$.k'), '^-?[0-9]+([.][0-9]+)?$') AS isnumber, props IS NULL AS isblank,
       floor(value) - 2 * floor(floor(value) / 2) = 0 AS iseven, floor(value) - 2 * floor(floor(value) / 2) = 1 AS isodd, (event_type = 'click')::INT AS n FROM events""",
)

add(
    "b10_closed_list",
    lambda s, d: table(s, d, "events").groupBy(measures.on_list(F.col("event_type"), ["view", "click"], "other").alias("label")).count().withColumnRenamed("count", "n"),
    "SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS label, count(*) AS n FROM events GROUP BY 1",
)

add(
    "b11_outcome",
    lambda s, d: table(s, d, "events").groupBy(measures.outcome(STATUS).alias("outcome")).agg(F.count("*").alias("n")),
    """WITH e AS (SELECT 200 + event_id * 7 % 400 AS c FROM events)
       SELECT CASE WHEN c < 400 THEN 'ok' WHEN c = 504 THEN 'timed_out' WHEN c < 500 THEN 'refused' ELSE 'failed' END AS outcome, count(*) AS n FROM e GROUP BY 1""",
)

FORMATS = ["docx", "pdf", "pages", "xlsx", "png", "mp4", "zip", "csv"]
_SQL_PAIR = "(SELECT p_partkey, ['docx','pdf','pages','xlsx','png','mp4','zip','csv'][p_partkey % 8 + 1] AS s, ['docx','pdf','pages','xlsx','png','mp4','zip','csv'][(p_partkey // 8) % 8 + 1] AS t, p_size * 2000000 AS size FROM part)"
_SQL_CLASS = "CASE WHEN t = 'pdf' AND s IN ('docx', 'xlsx') THEN 'office-to-pdf' WHEN t = 'pdf' AND s = 'pages' THEN 'iwork-to-pdf' WHEN s = 'pdf' AND t IN ('docx', 'xlsx') THEN 'pdf-to-office' ELSE 'general' END"

add(
    "b12_conversion_price",
    lambda s, d: table(s, d, "part").select("p_partkey", rules.conversion_class(_SRC, _TGT).alias("class"), rules.base_credits(_SRC, _TGT).alias("credits")),
    f"SELECT p_partkey, {_SQL_CLASS} AS class, CASE {_SQL_CLASS} WHEN 'general' THEN 1 WHEN 'pdf-to-office' THEN 4 ELSE 2 END AS credits FROM {_SQL_PAIR}",
)

add(
    "b13_resource_class",
    lambda s, d: table(s, d, "part").select("p_partkey", rules.resource_class(_SRC, _TGT, F.col("p_size") * 2_000_000).alias("resource")),
    f"""SELECT p_partkey, CASE WHEN s = 'mp4' OR t = 'mp4' THEN 'gpu' WHEN size > 52428800 THEN 'memory' WHEN s IN ('docx','xlsx','pdf') OR t IN ('docx','xlsx','pdf') THEN 'cpu'
        WHEN s = 'zip' OR t = 'zip' OR size > 10485760 THEN 'cpu' ELSE 'light' END AS resource FROM {_SQL_PAIR}""",
)

add(
    "b14_entitlement",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey",
        rules.entitlement(_STATUS, F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") + 100), F.lit(700)).alias("tier"),
    ),
    """SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) AND (c_custkey % 2 <> 0 OR c_custkey > 700) THEN 'paid'
       WHEN c_custkey % 5 = 2 AND c_custkey % 3 <> 0 AND c_custkey + 100 > 700 THEN 'paid' ELSE 'free' END AS tier FROM customer""",
)

_AGENTS = ["Mozilla/5.0 Chrome/1 Safari/5 Edg/9", "Mozilla/5.0 Chrome/1 OPR/3", "Mozilla/5.0 Firefox/7", "Mozilla/5.0 Chrome/1 Safari/5", "Mozilla/5.0 Safari/5", "curl/8"]
add(
    "b15_browser_family",
    lambda s, d: table(s, d, "events").groupBy(textx.browser_family(F.element_at(F.array(*[F.lit(a) for a in _AGENTS]), (F.col("event_id") % 6 + 1).cast("int"))).alias("browser")).agg(F.count("*").alias("n")),
    "SELECT ['edge','opera','firefox','chrome','safari','other'][event_id % 6 + 1] AS browser, count(*) AS n FROM events GROUP BY 1",
)


def _catalogue(s, d):
    src = s.createDataFrame([(f,) for f in FORMATS], "source string")
    pairs = src.join(src.withColumnRenamed("source", "target"), F.col("source") != F.col("target"))
    return pairs.where("target = 'pdf' OR source = 'csv'").select("source", "target", rules.conversion_class(F.col("source"), F.col("target")).alias("class"))


add(
    "b16_catalogue_filter",
    _catalogue,
    f"""WITH f AS (SELECT unnest({FORMATS!r}) AS x), p AS (SELECT a.x AS s, b.x AS t FROM f a JOIN f b ON a.x <> b.x)
        SELECT s AS source, t AS target, {_SQL_CLASS} AS class FROM p WHERE t = 'pdf' OR s = 'csv'""",
)

add(
    "b17_page_selection",
    lambda s, d: table(s, d, "supplier").select(
        "s_suppkey", intervals.page_selection(F.concat(F.col("s_suppkey") % 7 + 1, F.lit("-"), F.col("s_suppkey") % 7 + 3, F.lit(", 2,-2, 18-")), F.lit(20)).alias("pages")
    ),
    "SELECT s_suppkey, list_sort(list_distinct(list_concat(range(s_suppkey % 7 + 1, s_suppkey % 7 + 4), [1, 2, 18, 19, 20])))::INT[] AS pages FROM supplier",
)

add(
    "b18_owner_status",
    lambda s, d: table(s, d, "orders").where((F.col("o_custkey") == 7) | (F.col("o_orderstatus").isin("P") & (F.col("o_totalprice") > 300000))).select("o_orderkey", "o_custkey", "o_orderstatus"),
    "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7 OR (o_orderstatus IN ('P') AND o_totalprice > 300000)",
)

add(
    "b19_bind_by_name",
    lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k INT, absent STRING").alias("p")).select("event_id", "p.k", F.coalesce("p.absent", F.lit("")).alias("absent")),
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, '' AS absent FROM events",
)


def _scrub(s, d):
    p = table(s, d, "pages")
    text = F.concat(F.lit("see "), F.col("url"), F.lit(" by a.b"), F.col("page_id"), F.lit("@mail.example.org  in my.notes.docx id 1234567890"), F.lit("\ttok abcdefghij0123456789xyz"))
    return p.select("page_id", textx.scrub(text).alias("clean"))


add("b20_scrub", _scrub, "SELECT page_id, 'see [url] by [email] in [file] id [n] tok [token]' AS clean FROM pages")


def _paths(s, d):
    path = F.regexp_extract("url", r"://[^/?#]*([^#]*)", 1)
    return table(s, d, "pages").select("page_id", textx.page_path(path).alias("path"))


add(
    "b21_page_path",
    _paths,
    r"""WITH u AS (SELECT page_id, list_filter(string_split(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1:8] AS parts FROM pages)
        SELECT page_id, '/' || array_to_string(list_transform(parts, lambda x: CASE WHEN regexp_full_match(x, '[a-z0-9-]{1,48}') AND NOT regexp_matches(x, '[0-9]{6,}|^[0-9a-f-]{16,}$') THEN x ELSE ':x' END), '/') AS path FROM u""",
)
