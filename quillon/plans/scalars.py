"""Scalar functions over table columns: arithmetic, text, dates, finance, formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import datesx, finance, mathx, rules, textx
from ..session import table
from .registry import Registry


def _prepare() -> None:
    """Columns that several queries use."""
    global q, p, t, disc, signed, name, day, ship, rate, n, pv
    q, p, t, disc = (F.col(c) for c in ("l_quantity", "l_extendedprice", "l_tax", "l_discount"))
    signed = q - 25.5
    name = F.col("c_name")
    day = F.to_date("o_orderdate")
    ship = F.to_date("l_shipdate")
    rate, n, pv = t / 12 + 0.001, F.col("l_linenumber") * 12, p


registry = Registry(_prepare)
add = registry.add


def _line(s, d, *cols):
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", *cols)


SIGNED = "(l_quantity - 25.5)"

add(
    "h01_operators",
    lambda s, d: _line(s, d, (1 + 2 * F.pow(q, F.lit(2))).alias("precedence"), F.pow(-q, F.lit(2)).alias("minus_power"), (q * 0.5 + 1).alias("percent"), F.try_divide(q, F.floor(q % 3)).alias("divided")),
    """SELECT l_orderkey, l_linenumber, 1 + 2 * power(l_quantity, 2) AS precedence, power(-l_quantity, 2) AS minus_power, l_quantity * 0.5 + 1 AS percent,
       CASE WHEN floor(l_quantity % 3) <> 0 THEN l_quantity / floor(l_quantity % 3) END AS divided FROM lineitem""",
)
add(
    "h02_concat",
    lambda s, d: _line(s, d, F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string"), F.upper((q > 25).cast("string"))).alias("joined")),
    "SELECT l_orderkey, l_linenumber, l_returnflag || l_linenumber || upper((l_quantity > 25)::VARCHAR) AS joined FROM lineitem",
)
add(
    "h03_coercion",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.expr("try_cast(substring(o_orderpriority, 1, 1) AS DOUBLE) + 3").alias("text_number"), F.expr("try_cast(o_orderstatus AS DOUBLE) + 1").alias("text_bad"), ((F.col("o_orderstatus") == "F").cast("int") + 1).alias("bool_add")),
    "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) + 3 AS text_number, TRY_CAST(o_orderstatus AS DOUBLE) + 1 AS text_bad, (o_orderstatus = 'F')::INT + 1 AS bool_add FROM orders",
)
add(
    "h04_rounding",
    lambda s, d: _line(
        s, d, F.abs(signed).alias("abs_"), F.signum(signed).alias("sign_"), F.floor(signed).alias("int_"), mathx.toward_zero(signed).alias("trunc_"), F.round(q * 1.5, 0).alias("round_"),
        mathx.away_from_zero(signed).alias("roundup"), mathx.ceiling(q, 4.0).alias("ceiling_"), mathx.floor(q, 4.0).alias("floor_"), mathx.mround(q, 3.0).alias("mround"), mathx.even(signed).alias("even_"), mathx.odd(signed).alias("odd_"),
    ),
    f"""SELECT l_orderkey, l_linenumber, abs({SIGNED}) AS abs_, sign({SIGNED})::DOUBLE AS sign_, floor({SIGNED})::BIGINT AS int_, trunc({SIGNED}) AS trunc_, round(l_quantity * 1.5, 0) AS round_,
        sign({SIGNED}) * ceil(abs({SIGNED})) AS roundup, ceil(l_quantity / 4) * 4 AS ceiling_, floor(l_quantity / 4) * 4 AS floor_, floor(l_quantity / 3 + 0.5) * 3 AS mround,
        sign({SIGNED}) * ceil(abs({SIGNED}) / 2) * 2 AS even_, CASE WHEN {SIGNED} = 0 THEN 1 ELSE sign({SIGNED}) * greatest(ceil((abs({SIGNED}) - 1) / 2) * 2 + 1, 1) END AS odd_ FROM lineitem""",
)
add(
    "h05_mod_quotient",
    lambda s, d: _line(s, d, mathx.mod(signed, F.lit(3.0)).alias("m"), mathx.mod(q, F.lit(-4.0)).alias("m_neg"), mathx.quotient(signed, F.lit(4.0)).alias("quo"), mathx.mod(q, q - q).alias("by_zero")),
    f"""SELECT l_orderkey, l_linenumber, {SIGNED} - 3 * floor({SIGNED} / 3) AS m, l_quantity - -4 * floor(l_quantity / -4) AS m_neg, trunc({SIGNED} / 4) AS quo, NULL::DOUBLE AS by_zero FROM lineitem""",
)
add(
    "h06_powers",
    lambda s, d: _line(s, d, F.round(F.pow(q, F.lit(1.5)), 8).alias("power_"), mathx.safe_sqrt(signed).alias("sqrt_"), F.round(F.exp(t), 12).alias("exp_"), F.round(F.ln(p), 10).alias("ln_"), F.round(F.log(2.0, q), 10).alias("log2_"), F.round(F.log10(p), 10).alias("log10_"), F.round(F.pi(), 12).alias("pi_")),
    f"""SELECT l_orderkey, l_linenumber, round(power(l_quantity, 1.5), 8) AS power_, CASE WHEN {SIGNED} >= 0 THEN sqrt({SIGNED}) END AS sqrt_, round(exp(l_tax), 12) AS exp_,
        round(ln(l_extendedprice), 10) AS ln_, round(log2(l_quantity), 10) AS log2_, round(log10(l_extendedprice), 10) AS log10_, round(pi(), 12) AS pi_ FROM lineitem""",
)
add(
    "h07_combinatorics",
    lambda s, d: table(s, d, "part").select("p_partkey", mathx.fact(F.col("p_size") % 11).alias("fact_"), mathx.gcd(F.col("p_size"), F.lit(36)).alias("gcd_"), mathx.lcm(F.col("p_size"), F.lit(6)).alias("lcm_"), mathx.combin(F.col("p_size") % 9 + 5, F.col("p_size") % 4).alias("combin"), mathx.permut(F.col("p_size") % 9 + 5, F.col("p_size") % 4).alias("permut"), F.pow(F.col("p_size"), F.lit(3)).alias("permutationa"), mathx.multinomial(F.col("p_size") % 4, F.col("p_size") % 3 + 1, F.lit(2)).alias("multinomial"), mathx.factdouble(F.col("p_size") % 8).alias("factdouble")),
    """SELECT p_partkey, factorial((p_size % 11)::INT)::DOUBLE AS fact_, gcd(p_size, 36)::BIGINT AS gcd_, lcm(p_size, 6)::BIGINT AS lcm_,
       (factorial((p_size % 9 + 5)::INT) / factorial((p_size % 4)::INT) / factorial((p_size % 9 + 5 - p_size % 4)::INT))::DOUBLE AS combin,
       (factorial((p_size % 9 + 5)::INT) / factorial((p_size % 9 + 5 - p_size % 4)::INT))::DOUBLE AS permut, power(p_size, 3) AS permutationa,
       (factorial((p_size % 4 + p_size % 3 + 3)::INT) / factorial((p_size % 4)::INT) / factorial((p_size % 3 + 1)::INT) / 2)::DOUBLE AS multinomial, [1, 1, 2, 3, 8, 15, 48, 105][p_size % 8 + 1]::DOUBLE AS factdouble FROM part""",
)
add(
    "h08_trigonometry",
    lambda s, d: _line(s, d, F.round(F.sin(q), 10).alias("sin_"), F.round(F.cos(q), 10).alias("cos_"), F.round(mathx.atan2_xy(F.lit(1.0), signed), 10).alias("atan2_"), F.round(F.degrees(t), 10).alias("degrees_")),
    f"SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 10) AS sin_, round(cos(l_quantity), 10) AS cos_, round(atan2({SIGNED}, 1), 10) AS atan2_, round(degrees(l_tax), 10) AS degrees_ FROM lineitem",
)
add(
    "h09_bases",
    lambda s, d: table(s, d, "orders").select("o_orderkey", mathx.to_base(F.col("o_orderkey") % 512, 2, 10).alias("bin_"), mathx.to_base(F.col("o_orderkey"), 8).alias("oct_"), mathx.to_base(F.col("o_orderkey"), 16, 8).alias("hex_"), mathx.from_base(mathx.to_base(F.col("o_orderkey"), 16), 16).alias("back")),
    "SELECT o_orderkey, lpad(bin(o_orderkey % 512), 10, '0') AS bin_, printf('%o', o_orderkey) AS oct_, lpad(hex(o_orderkey), 8, '0') AS hex_, o_orderkey AS back FROM orders",
)
add(
    "h11_text",
    lambda s, d: table(s, d, "customer").select(
        "c_custkey", F.char_length(name).alias("len_"), F.upper(name).alias("upper_"), F.lower(name).alias("lower_"), textx.proper(F.col("c_mktsegment")).alias("proper"),
        textx.trim(F.concat(F.lit("  a   "), name, F.lit("  "))).alias("trim_"), textx.left(name, 5).alias("left_"), textx.right(name, 5).alias("right_"), textx.mid(name, 7, 3).alias("mid_"), textx.mid(name, 90, 3).alias("past"),
    ),
    """SELECT c_custkey, length(c_name) AS len_, upper(c_name) AS upper_, lower(c_name) AS lower_, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS proper, 'a ' || c_name AS trim_,
       left(c_name, 5) AS left_, right(c_name, 5) AS right_, substr(c_name, 7, 3) AS mid_, '' AS past FROM customer""",
)
add(
    "h12_concatenation",
    lambda s, d: table(s, d, "customer").select("c_custkey", F.concat(name, F.lit("-"), F.col("c_mktsegment")).alias("concatenate"), textx.textjoin(",", True, name, F.lit(""), F.col("c_mktsegment")).alias("skipping"), textx.textjoin("-", False, name, F.lit(None).cast("string"), F.col("c_mktsegment")).alias("keeping"), textx.rept(F.col("c_mktsegment"), 3).alias("rept"), textx.rept(name, 5000).alias("too_long")),
    "SELECT c_custkey, c_name || '-' || c_mktsegment AS concatenate, c_name || ',' || c_mktsegment AS skipping, c_name || '--' || c_mktsegment AS keeping, repeat(c_mktsegment, 3) AS rept, NULL::VARCHAR AS too_long FROM customer",
)
add(
    "h13_find_search",
    lambda s, d: table(s, d, "part").select("p_partkey", textx.find("e", F.col("p_name")).cast("int").alias("find_"), textx.find("E", F.col("p_name")).cast("int").alias("find_case"), textx.search("E", F.col("p_name")).cast("int").alias("search_"), textx.search("a*e", F.col("p_name")).cast("int").alias("search_wild")),
    """SELECT p_partkey, nullif(instr(p_name, 'e'), 0)::INT AS find_, nullif(instr(p_name, 'E'), 0)::INT AS find_case, nullif(instr(lower(p_name), 'e'), 0)::INT AS search_,
       CASE WHEN lower(p_name) LIKE '%a%e%' THEN instr(lower(p_name), 'a')::INT END AS search_wild FROM part""",
)
add(
    "h14_substitute",
    lambda s, d: table(s, d, "part").select("p_partkey", textx.substitute(F.col("p_name"), "a", "A").alias("all_"), textx.substitute(F.concat(F.col("p_name"), F.lit("a.a.a")), "a.", "#", 1).alias("first_"), textx.replace_at(F.col("p_name"), 1, 3, "bye").alias("replaced")),
    """SELECT p_partkey, replace(p_name, 'a', 'A') AS all_, regexp_replace(p_name || 'a.a.a', 'a[.]', '#') AS first_, 'bye' || substr(p_name, 4) AS replaced FROM part""",
)
add(
    "h15_formats",
    lambda s, d: _line(s, d, F.replace(F.format_number(F.round(p, 2), 2), F.lit(","), F.lit("")).alias("fixed"), F.format_number(F.floor(p), 0).alias("grouped"), F.concat(F.round(disc * 100, 0).cast("int"), F.lit("%")).alias("percent"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("iso"), textx.dollar(signed * 1000.25).alias("dollar")),
    """SELECT l_orderkey, l_linenumber, printf('%.2f', round(l_extendedprice, 2)) AS fixed, format('{:,}', floor(l_extendedprice)::BIGINT) AS grouped,
       round(l_discount * 100, 0)::INT || '%' AS percent, strftime(l_shipdate, '%Y-%m-%d') AS iso,
       CASE WHEN l_quantity < 25.5 THEN '(' ELSE '' END || '$' || format('{:,}', floor(abs(l_quantity - 25.5) * 1000.25)::BIGINT) || printf('%.2f', round(abs(l_quantity - 25.5) * 1000.25, 2))[-3:] || CASE WHEN l_quantity < 25.5 THEN ')' ELSE '' END AS dollar FROM lineitem""",
)
add(
    "h16_numbervalue",
    lambda s, d: _line(s, d, textx.numbervalue(F.concat(F.lit("1."), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"), F.lit(",5")), ",", ".").alias("european"), textx.numbervalue(F.col("l_returnflag")).alias("bad"), F.expr("try_cast('12.5' AS DOUBLE)").alias("value_")),
    "SELECT l_orderkey, l_linenumber, 1000 + l_linenumber + 0.5::DOUBLE AS european, NULL::DOUBLE AS bad, 12.5::DOUBLE AS value_ FROM lineitem",
)
add(
    "h17_codes",
    lambda s, d: table(s, d, "nation").select("n_nationkey", (F.col("n_name") == F.lower("n_name")).alias("exact"), F.chr(F.lit(65) + F.col("n_regionkey")).alias("char_"), F.ascii("n_name").alias("code_")),
    "SELECT n_nationkey, n_name = lower(n_name) AS exact, chr(65 + n_regionkey) AS char_, ascii(n_name) AS code_ FROM nation",
)
D = "o_orderdate::DATE"


def _orders(s, d, *cols):
    return table(s, d, "orders").select("o_orderkey", *cols)


add(
    "h18_date_parts",
    lambda s, d: _orders(s, d, datesx.date_of(F.year(day), F.month(day) + 12, F.dayofmonth(day) + 31).alias("overflow"), F.year(day).alias("y"), F.month(day).alias("m"), F.dayofmonth(day).alias("dd"), datesx.serial(day).alias("serial")),
    f"""SELECT o_orderkey, (date_trunc('month', {D}) + INTERVAL 12 MONTH)::DATE + (day({D}) + 30)::INT AS overflow, year({D})::INT AS y, month({D})::INT AS m, day({D})::INT AS dd,
        ({D} - DATE '1899-12-30')::INT AS serial FROM orders""",
)
add(
    "h19_weekdays",
    lambda s, d: _orders(s, d, datesx.weekday(day).alias("w1"), datesx.weekday(day, 2).alias("w2"), datesx.weekday(day, 3).alias("w3"), datesx.weeknum(day).alias("weeknum"), F.datediff(day, F.lit("1992-01-01").cast("date")).alias("days")),
    f"""SELECT o_orderkey, (dayofweek({D}) + 1)::INT AS w1, isodow({D})::INT AS w2, (isodow({D}) - 1)::INT AS w3,
        ((dayofyear({D}) - 1 + dayofweek(date_trunc('year', {D}))) // 7 + 1)::INT AS weeknum, ({D} - DATE '1992-01-01')::INT AS days FROM orders""",
)
add(
    "h20_month_arithmetic",
    lambda s, d: _orders(s, d, datesx.edate(day, 1).alias("edate"), datesx.edate(day, -13).alias("back"), datesx.eomonth(day, 1).alias("eomonth")),
    f"SELECT o_orderkey, ({D} + INTERVAL 1 MONTH)::DATE AS edate, ({D} - INTERVAL 13 MONTH)::DATE AS back, last_day({D} + INTERVAL 1 MONTH) AS eomonth FROM orders",
)
add(
    "h21_time",
    lambda s, d: table(s, d, "events").select("event_id", F.round((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / 86400, 9).alias("fraction"), F.hour("ts").alias("h"), F.to_date(F.date_format("ts", "yyyy-MM-dd")).alias("datevalue")),
    "SELECT event_id, round((hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400, 9) AS fraction, hour(ts)::INT AS h, ts::DATE AS datevalue FROM events",
)
add(
    "h22_working_days",
    lambda s, d: _line(s, d, datesx.networkdays(ship, F.date_add(ship, (q * 1).cast("int"))).alias("networkdays"), datesx.workday(ship, 7).alias("workday"), datesx.workday(ship, -7).alias("before"), datesx.workday_intl(ship, -4, "1010100").alias("intl"), datesx.networkdays_intl(F.date_add(ship, (q * 1).cast("int")), ship, "1010100").alias("netintl")),
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, l_shipdate::DATE + l_quantity::INT AS b FROM lineitem)
       SELECT l_orderkey, l_linenumber, len(list_filter(generate_series(a, b, INTERVAL 1 DAY), lambda z: isodow(z) < 6))::INT AS networkdays,
              (list_filter(generate_series(a + 1, a + 20, INTERVAL 1 DAY),  lambda z: isodow(z) < 6)[7])::DATE AS workday,
              (list_filter(generate_series(a - 1, a - 20, to_days(-1)), lambda z: isodow(z) < 6)[7])::DATE AS before, (list_filter(generate_series(a - 1, a - 20, to_days(-1)), lambda z: isodow(z) NOT IN (1, 3, 5))[4])::DATE AS intl,
              CASE WHEN b > a THEN -1 ELSE 1 END * len(list_filter(generate_series(a, b, INTERVAL 1 DAY), lambda z: isodow(z) NOT IN (1, 3, 5)))::INT AS netintl FROM x""",
)
add(
    "h23_date_differences",
    lambda s, d: _line(s, d, datesx.datedif(ship, F.lit("2030-01-01").cast("date"), "d").alias("dif_d"), datesx.datedif(ship, F.lit("2030-01-01").cast("date"), "m").alias("dif_m"), F.round(datesx.yearfrac_actual(ship, F.lit("2030-01-01").cast("date")), 9).alias("yearfrac")),
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS a, DATE '2030-01-01' AS b FROM lineitem)
       SELECT l_orderkey, l_linenumber, (b - a)::INT AS dif_d, datesub('month', a, b)::INT AS dif_m,
              round((b - a) / ((make_date(year(b)::INT + 1, 1, 1) - make_date(year(a)::INT, 1, 1)) / (year(b) - year(a) + 1)::DOUBLE), 9) AS yearfrac FROM x""",
)
add(
    "h24_references",
    lambda s, d: table(s, d, "customer").select("c_custkey", textx.column_index(F.element_at(F.array(*[F.lit(x) for x in ("A", "Z", "AA", "ABC")]), (F.col("c_custkey") % 4 + 1).cast("int"))).alias("column_"), F.element_at(F.array("c_name", "c_mktsegment"), (F.col("c_custkey") % 2 + 1).cast("int")).alias("index_")),
    "SELECT c_custkey, [0, 25, 26, 730][c_custkey % 4 + 1] AS column_, [c_name, c_mktsegment][c_custkey % 2 + 1] AS index_ FROM customer",
)
R, N = "(l_tax / 12 + 0.001)", "(l_linenumber * 12)"
PMT = f"(-{R} * l_extendedprice * power(1 + {R}, {N}) / (power(1 + {R}, {N}) - 1))"
add(
    "h25_annuities",
    lambda s, d: _line(
        s, d, F.round(finance.pmt(rate, n, pv), 6).alias("pmt"), F.round(finance.fv(rate, n, -q), 6).alias("fv"), F.round(finance.pv(rate, n, -q), 6).alias("pv"), F.round(finance.npv(rate, [q, p, q]), 6).alias("npv"),
        F.round(finance.nper(rate, -pv / 6, pv), 6).alias("nper"), F.round(finance.ipmt(rate, F.lit(1), n, pv), 6).alias("ipmt"), F.round(finance.ppmt(rate, F.lit(1), n, pv), 6).alias("ppmt"),
        F.round(finance.sln(p, q, F.lit(5)), 6).alias("sln"), F.round(finance.syd(p, q, F.lit(5), F.lit(2)), 6).alias("syd"), F.round(finance.ddb(p, q, F.lit(5), F.lit(2)), 6).alias("ddb"), F.round(finance.effect(t + 0.01, F.lit(12)), 10).alias("effect"), F.round(finance.rri(n, q, p), 10).alias("rri"),
    ),
    f"""SELECT l_orderkey, l_linenumber, round({PMT}, 6) AS pmt, round(l_quantity * (power(1 + {R}, {N}) - 1) / {R}, 6) AS fv, round(l_quantity * (1 - power(1 + {R}, -{N})) / {R}, 6) AS pv,
        round(l_quantity / (1 + {R}) + l_extendedprice / power(1 + {R}, 2) + l_quantity / power(1 + {R}, 3), 6) AS npv,
        round(ln((-l_extendedprice / 6) / (-l_extendedprice / 6 + l_extendedprice * {R})) / ln(1 + {R}), 6) AS nper, round(-l_extendedprice * {R}, 6) AS ipmt, round({PMT} + l_extendedprice * {R}, 6) AS ppmt,
        round((l_extendedprice - l_quantity) / 5, 6) AS sln, round((l_extendedprice - l_quantity) * 4 * 2 / 30, 6) AS syd, round(l_extendedprice * 2 / 5 * (1 - 2 / 5), 6) AS ddb,
        round(power(1 + (l_tax + 0.01) / 12, 12) - 1, 10) AS effect, round(power(l_extendedprice / l_quantity, 1 / {N}) - 1, 10) AS rri FROM lineitem""",
)
_HALVED = "list_reduce(range(50), lambda a, i: CASE WHEN {0} THEN {{'x': (a.x + a.y) / 2, 'y': a.y}} ELSE {{'x': a.x, 'y': (a.x + a.y) / 2}} END, {{'x': {1}::DOUBLE, 'y': {2}::DOUBLE}})"
_WORTH = "-p + p * 0.3 * power(1 + (a.x + a.y) / 2, -1) + p * 0.4 * power(1 + (a.x + a.y) / 2, -2) + p * 0.5 * power(1 + (a.x + a.y) / 2, -3) + q * power(1 + (a.x + a.y) / 2, -4) > 0"
_OWED = "power(1 + (a.x + a.y) / 2, 60) - (power(1 + (a.x + a.y) / 2, 60) - 1) / (25 * (a.x + a.y)) < 0"
add(
    "h26_rates",
    lambda s, d: _line(s, d, F.round(finance.irr(F.array(-p, p * 0.3, p * 0.4, p * 0.5, q)), 8).alias("irr"), F.round(finance.rate(F.lit(60.0), -p / 50, p), 8).alias("rate")),
    f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS q FROM lineitem), r AS (SELECT {_HALVED.format(_OWED, "1e-6", "1")} AS z)
        SELECT l_orderkey, l_linenumber, round(({_HALVED.format(_WORTH, "-0.99", "10")}).x, 8) AS irr, round(r.z.x, 8) AS rate FROM x, r""",
)
add(
    "h27_number_formats",
    lambda s, d: _line(s, d, F.format_number(p, 2).alias("currency"), F.concat((disc * 100).cast("decimal(9,0)"), F.lit("%")).alias("percent"), F.date_format(datesx.from_serial(datesx.serial(ship)), "yyyy-MM-dd").alias("day")),
    "SELECT l_orderkey, l_linenumber, format('{:,}', floor(round(l_extendedprice, 2))::BIGINT) || printf('%.2f', round(l_extendedprice, 2))[-3:] AS currency, round(l_discount * 100)::INT || '%' AS percent, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem",
)
_CELLS = ["=SUM(A1)", "-5", "+1.5e3", "-566,000", "-a", 'say "hi"', "a,b", " x", "plain", "@x", "", "-48 + 21"]
_WANT = ['"\'=SUM(A1)"', "-5", "+1.5e3", '"-566,000"', '"\'-a"', '"say ""hi"""', '"a,b"', '" x"', "plain", '"\'@x"', "", '"\'-48 + 21"']
add(
    "h28_delimited_cells",
    lambda s, d: table(s, d, "part").select("p_partkey", textx.delimited_cell(F.element_at(F.array(*[F.lit(c) for c in _CELLS]), (F.col("p_partkey") % 12 + 1).cast("int"))).alias("cell"), textx.delimited_cell(F.lit(""), single_column=True).alias("lone")),
    "SELECT p_partkey, [" + ", ".join("'" + w.replace("'", "''") + "'" for w in _WANT) + "][p_partkey % 12 + 1] AS cell, '\"\"' AS lone FROM part",
)
add(
    "h29_rfc4180",
    lambda s, d: table(s, d, "events").select("event_id", textx.rfc4180_cell(F.col("props")).alias("cell")),
    """SELECT event_id, CASE WHEN regexp_matches(props, '[",\\r\\n]') THEN '"' || replace(props, '"', '""') || '"' ELSE props END AS cell FROM events""",
)
add(
    "h30_json_text",
    lambda s, d: table(s, d, "customer").select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.array("c_nationkey", F.lit(None).cast("int")).alias("keys"), F.lit(None).cast("string").alias("gone")), {"ignoreNullFields": "false"}).alias("json")),
    """SELECT c_custkey, '{"name":"' || c_name || '","keys":[' || c_nationkey || ',null],"gone":null}' AS json FROM customer""",
)
add(
    "h31_shortest_double",
    lambda s, d: _line(s, d, textx.shortest_double(F.when(F.col("l_linenumber") == 1, q).when(F.col("l_linenumber") == 2, F.lit(1e21)).when(F.col("l_linenumber") == 3, F.lit(-0.0)).when(F.col("l_linenumber") == 4, F.lit(1.5e-7)).otherwise(q / 4)).alias("text")),
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_quantity::BIGINT::VARCHAR WHEN 2 THEN '1e+21' WHEN 3 THEN '0' WHEN 4 THEN '1.5e-7'
       ELSE rtrim(rtrim((l_quantity / 4)::DECIMAL(12, 2)::VARCHAR, '0'), '.') END AS text FROM lineitem""",
)
add(
    "h32_entities",
    lambda s, d: table(s, d, "documents").select("doc_id", F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")).alias("e")).select("doc_id", F.md5("e").alias("escaped"), F.md5(textx.decoded(F.concat("e", F.lit("&#233;&#x2603;&copy;")))).alias("decoded")),
    "SELECT doc_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped, md5(text || 'é☃©') AS decoded FROM documents",
)
add(
    "h33_language_tags",
    lambda s, d: table(s, d, "documents").select("doc_id", textx.language_tag(F.concat(F.upper("lang"), F.when(F.col("doc_id") % 3 == 0, "_latn-us").when(F.col("doc_id") % 3 == 1, "-GB").otherwise("-x-y"))).alias("tag")),
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang || '-Latn-US' WHEN 1 THEN lang || '-GB' END AS tag FROM documents",
)
add(
    "h34_spaces",
    lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(textx.nfkc(F.translate("text", "abc1", "ａｂｃ①")), r"\s+", " "))).alias("collapsed")),
    r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed FROM documents",
)
add(
    "h35_edit_distance",
    lambda s, d: table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("edits")),
    "SELECT p_partkey, levenshtein(p_name, p_type)::BIGINT AS edits FROM part",
)
add(
    "h36_slug_pairs",
    lambda s, d: table(s, d, "nation").select("n_nationkey", textx.slug_pair(F.concat(F.lower("n_name"), F.lit("-to-"), F.element_at(F.array(*map(F.lit, ("pdf", "docx", "a-to-b", "png"))), F.col("n_nationkey") % 4 + 1))).alias("p")).select("n_nationkey", "p.source", "p.target"),
    "SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 2 THEN lower(n_name) END AS source, ['pdf', 'docx', NULL, 'png'][n_nationkey % 4 + 1] AS target FROM nation",
)
add(
    "h37_money",
    lambda s, d: _orders(s, d, rules.lowest_unit(F.floor("o_totalprice").cast("string"), F.element_at(F.array(F.lit("USD"), F.lit("JPY")), (F.col("o_orderkey") % 2 + 1).cast("int"))).alias("amount")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN floor(o_totalprice) ELSE floor(o_totalprice) / 100 END AS amount FROM orders",
)
add(
    "h39_sheet_names",
    lambda s, d: table(s, d, "pages").select("page_id", textx.sheet_name(F.col("url")).alias("name")),
    r"SELECT page_id, substr(regexp_replace(url, '[\\/*?:\[\]]', '_', 'g'), 1, 31) AS name FROM pages",
)
add(
    "h40_deadlines",
    lambda s, d: _orders(s, d, rules.deadline_ms(30000, 2000, 500, 120000, F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") * 300), F.col("o_orderkey") % 90).alias("deadline")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 120000 ELSE least(30000 + ceil(o_totalprice * 300 / 1048576) * 2000 + (o_orderkey % 90) * 500, 120000) END::BIGINT AS deadline FROM orders",
)
add(
    "h41_map_rebuild",
    lambda s, d: table(s, d, "events").select("event_id", F.to_json(F.map_from_entries(F.array(F.struct(F.lit("t"), "event_type")))).alias("object"), F.to_json(F.transform(F.map_entries(F.create_map("user_id", "event_type")), lambda e: F.struct(e.key.alias("key"), e.value.alias("value")))).alias("entries")),
    """SELECT event_id, '{"t":"' || event_type || '"}' AS object, '[{"key":' || user_id || ',"value":"' || event_type || '"}]' AS entries FROM events""",
)


def _allowed(s, d):
    """Addresses as text against entries as text: networks of several sizes, single addresses, wild parts, and what is none."""
    e = table(s, d, "events").select("event_id", F.concat_ws(".", F.lit("10"), F.col("user_id") % 256, F.col("event_id") % 256, F.lit("7")).alias("ip"))
    entries = {"net8": "10.0.0.0/8", "net20": "10.16.0.0/20", "net9": "10.128.0.0/9", "one": "10.16.16.7", "wild": "10.*.3.*", "all": "0.0.0.0/0", "bad": "10.16.0.0/40"}
    return e.select("event_id", *[textx.on_allow_list(F.col("ip"), F.lit(x)).alias(k) for k, x in entries.items()], textx.on_allow_list(F.concat("ip", F.lit(".9")), F.lit("10.0.0.0/8")).alias("five"))


add(
    "h42_cidr",
    _allowed,
    """WITH e AS (SELECT event_id, user_id % 256 AS b, event_id % 256 AS c FROM events)
       SELECT event_id, true AS net8, b = 16 AND c < 16 AS net20, b >= 128 AS net9, b = 16 AND c = 16 AS one, c = 3 AS wild, true AS all, false AS bad, false AS five FROM e""".replace("AS all,", 'AS "all",'),
)
add(
    "h43_rate_limit_headers",
    lambda s, d: table(s, d, "customer").select("c_custkey", F.concat(F.lit("limit="), F.greatest(F.lit(0), F.lit(100) + F.col("c_custkey") % 50), F.lit(", remaining="), F.greatest(F.lit(0), F.floor(F.col("c_acctbal") / 100)), F.lit(", reset="), F.ceil(F.lit(86400) - F.col("c_custkey") * 1.5)).alias("ratelimit"), F.when(F.col("c_acctbal") < 100, F.greatest(F.lit(1), F.ceil(F.lit(86400) - F.col("c_custkey") * 1.5))).alias("retry_after")),
    """SELECT c_custkey, 'limit=' || (100 + c_custkey % 50) || ', remaining=' || greatest(0, floor(c_acctbal / 100)::BIGINT) || ', reset=' || ceil(86400 - c_custkey * 1.5)::BIGINT AS ratelimit,
       CASE WHEN c_acctbal < 100 THEN greatest(1, ceil(86400 - c_custkey * 1.5)::BIGINT) END AS retry_after FROM customer""",
)


def roman(n):
    """Counters up to 3,999."""
    # fixed values: the symbols of the numerals
    symbols = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    table_ = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in symbols])
    start = F.struct(n.cast("int").alias("n"), F.lit("").alias("t"))
    step = lambda a, x: F.struct((a.n % x.v).alias("n"), F.concat(a.t, F.repeat(x.s, F.floor(a.n / x.v).cast("int"))).alias("t"))
    return F.aggregate(table_, start, step, lambda a: a.t)


add(
    "h44_counters",
    lambda s, d: table(s, d, "part").select("p_partkey", roman(F.col("p_size")).alias("roman"), textx.letters(F.col("p_size") * 14).alias("letter")),
    """SELECT p_partkey, ['','X','XX','XXX','XL','L'][p_size // 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][p_size % 10 + 1] AS roman, CASE WHEN p_size * 14 > 26 THEN chr((96 + (p_size * 14 - 1) // 26)::INT) ELSE '' END || chr((97 + (p_size * 14 - 1) % 26)::INT) AS letter FROM part""",
)
add(
    "h45_decibels",
    lambda s, d: _line(s, d, F.round(F.least(F.lit(100.0), -10 * F.log10(1 - disc)), 9).alias("ssim_db"), F.round(F.least(F.lit(60.0), 20 * F.log10(F.lit(255.0) / F.sqrt(q))), 9).alias("psnr")),
    "SELECT l_orderkey, l_linenumber, round(least(100, -10 * log10(1 - l_discount)), 9) AS ssim_db, round(least(60, 20 * log10(255 / sqrt(l_quantity))), 9) AS psnr FROM lineitem",
)
add(
    "h46_line_and_column",
    lambda s, d: table(s, d, "documents").select("doc_id", textx.line_and_column(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).alias("p")).select("doc_id", "p.line", "p.column"),
    """WITH x AS (SELECT doc_id, substr(text, 1, n_chars // 2) AS b FROM documents)
       SELECT doc_id, length(b) - length(replace(b, chr(10), '')) + 1 AS line, length(string_split(b, chr(10))[-1]) + 1 AS "column" FROM x""",
)
add(
    "h47_disk_use",
    lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 0, F.lit(0.0)).otherwise(F.round(100 * F.col("p_size") / 50, 6)).alias("percent")),
    "SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0 ELSE round(100 * p_size / 50, 6) END AS percent FROM part",
)
add(
    "h48_verdicts",
    lambda s, d: _orders(s, d, F.when(F.col("o_orderstatus") == "F", "ok").when((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "refused").otherwise("failed").alias("verdict")),
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'refused' ELSE 'failed' END AS verdict FROM orders",
)


def _distributions(s, d):
    from ..functions import distributions as ds

    k, x = F.col("p_size") % 8, F.col("p_retailprice") / 1000
    half = F.lit(0.3)
    return table(s, d, "part").select(
        "p_partkey", F.round(ds.expon_cdf(x, F.lit(1.5)), 10).alias("expon"), F.round(ds.weibull_cdf(x, F.lit(2.0), F.lit(1.2)), 10).alias("weibull"), F.round(ds.poisson_pmf(k, x), 10).alias("poisson"),
        F.round(ds.binom_pmf(k, F.lit(10), half), 10).alias("binom"), F.round(ds.negbinom_pmf(k, F.lit(4), half), 10).alias("negbinom"), F.round(ds.hypgeom_pmf(F.col("p_size") % 4, F.lit(5), F.lit(8), F.lit(20)), 10).alias("hypgeom"), F.round(ds.norm_pdf(x, F.lit(1.0), F.lit(0.5)), 10).alias("norm_pdf"),
    )


add(
    "h10_distributions",
    _distributions,
    """WITH x AS (SELECT p_partkey, p_size % 8 AS k, p_size % 4 AS h, p_retailprice / 1000 AS x FROM part)
       SELECT p_partkey, round(1 - exp(-1.5 * x), 10) AS expon, round(1 - exp(-power(x / 1.2, 2)), 10) AS weibull, round(exp(-x) * power(x, k) / factorial(k::INT), 10) AS poisson,
              round(factorial(10) / factorial(k::INT) / factorial((10 - k)::INT) * power(0.3, k) * power(0.7, 10 - k), 10) AS binom,
              round(factorial((k + 3)::INT) / factorial(k::INT) / 6 * power(0.3, 4) * power(0.7, k), 10) AS negbinom,
              round(factorial(8) / factorial(h::INT) / factorial((8 - h)::INT) * (factorial(12) / factorial((5 - h)::INT) / factorial((7 + h)::INT)) / 15504, 10) AS hypgeom,
              round(exp(-power((x - 1) / 0.5, 2) / 2) / (0.5 * sqrt(2 * pi())), 10) AS norm_pdf FROM x""",
)


def _integrals(s, d):
    from ..functions import distributions as ds

    x = F.col("p_retailprice") / 1000
    v = lambda n: F.lit(float(n))
    return table(s, d, "part").select(
        "p_partkey", ds.norm_cdf(x, v(1), v(0.5)).alias("norm"), ds.lognorm_cdf(x, v(0), v(1)).alias("lognorm"), ds.gamma_cdf(x, v(2), v(1.5)).alias("gamma"), ds.chisq_cdf(x, v(3)).alias("chisq"),
        ds.beta_cdf(x / 3, v(2), v(5)).alias("beta"), ds.f_cdf(x, v(4), v(9)).alias("f"), ds.t_cdf(x, v(7)).alias("t"),
    ).select("p_partkey", *[F.round(c, 8).alias(c) for c in ("norm", "lognorm", "gamma", "chisq", "beta", "f", "t")])


def _area(density: str, low: str, high: str, n: int = 600) -> str:
    """The integral of a density, an expression of u, by Simpson's rule."""
    return f"(({high}) - ({low})) / {3 * n} * list_sum(list_transform(range({n + 1}), lambda i: (CASE WHEN i IN (0, {n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({density.replace('u', f'(({low}) + (({high}) - ({low})) * i / {n})')})))"


add(
    "h10_distribution_integrals",
    _integrals,
    f"""WITH x AS (SELECT p_partkey, p_retailprice / 1000 AS x FROM part)
        SELECT p_partkey, round(0.5 + {_area("2 * exp(-power((u - 1) / 0.5, 2) / 2) / sqrt(2 * pi())", "1", "x")}, 8) AS norm, round(0.5 + {_area("exp(-u * u / 2) / sqrt(2 * pi())", "0", "ln(x)")}, 8) AS lognorm,
               round(1 - exp(-x / 1.5) * (1 + x / 1.5), 8) AS gamma, round({_area("2 * u * u * exp(-u * u / 2) / (power(2, 1.5) * gamma(1.5))", "0", "sqrt(x)")}, 8) AS chisq,
               round(1 - power(1 - x / 3, 6) - 2 * x * power(1 - x / 3, 5), 8) AS beta, round({_area("power(4 / 9, 2) * u * power(1 + 4 * u / 9, -6.5) * gamma(6.5) / (gamma(2) * gamma(4.5))", "0", "x")}, 8) AS f,
               round(0.5 + {_area("gamma(4) / (sqrt(7 * pi()) * gamma(3.5)) * power(1 + u * u / 7, -4)", "0", "x")}, 8) AS t FROM x""".replace("gamma(4) / (sqrt", "6.0 / (sqrt"),
)


def _inverses(s, d):
    """Each inverse, put into its distribution function again, gives the probability."""
    from ..functions import distributions as ds

    v = lambda n: F.lit(float(n))
    p = F.col("p_size") / 51
    part = table(s, d, "part").select("p_partkey", "p_size", p.alias("p"))
    pairs = {"norm": (ds.norm_inv, ds.norm_cdf, (1, 0.5)), "lognorm": (ds.lognorm_inv, ds.lognorm_cdf, (0, 1)), "gamma": (ds.gamma_inv, ds.gamma_cdf, (2, 1.5)), "chisq": (ds.chisq_inv, ds.chisq_cdf, (3,)),
             "beta": (ds.beta_inv, ds.beta_cdf, (2, 5)), "f": (ds.f_inv, ds.f_cdf, (4, 9)), "t": (ds.t_inv, ds.t_cdf, (7,))}
    back = [F.round(cdf(inv(F.col("p"), *map(v, a)), *map(v, a)), 9).alias(k) for k, (inv, cdf, a) in pairs.items()]
    return part.select("p_partkey", *back, F.round(ds.gammaln(F.col("p_size") + 0.5), 9).alias("gammaln"), F.round(ds.confidence_norm(v(0.05), v(2.5), F.col("p_size")), 9).alias("confidence"), F.to_json(mathx.munit(F.col("p_size") % 4)).alias("munit"))


add(
    "h10_distribution_inverses",
    _inverses,
    "SELECT p_partkey, " + ", ".join(f"round(p_size / 51, 9) AS {k}" for k in ("norm", "lognorm", "gamma", "chisq", "beta", "f", "t"))
    + """, round(lgamma(p_size + 0.5), 9) AS gammaln, round(1.959963984540054 * 2.5 / sqrt(p_size), 9) AS confidence, ['[]', '[[1]]', '[[1,0],[0,1]]', '[[1,0,0],[0,1,0],[0,0,1]]'][p_size % 4 + 1] AS munit FROM part""",
)


def _large_densities(s, d):
    """Counts far beyond the factorials that a double holds."""
    from ..functions import distributions as ds

    k = F.col("p_size") * 13
    return table(s, d, "part").select(
        "p_partkey", F.round(ds.poisson_pmf(k, F.lit(300.0)), 10).alias("poisson"), F.round(ds.binom_pmf(k, F.lit(1000), F.lit(0.3)), 10).alias("binom"),
        F.round(ds.negbinom_pmf(k, F.lit(40), F.lit(0.1)), 10).alias("negbinom"), F.round(ds.hypgeom_pmf(k, F.lit(700), F.lit(900), F.lit(2000)), 10).alias("hypgeom"), ds.binom_pmf(F.lit(0), k, F.lit(0.0)).alias("sure"),
    )


_CHOOSE = "(lgamma(({0}) + 1) - lgamma(({1}) + 1) - lgamma(({0}) - ({1}) + 1))"
add(
    "h10_large_densities",
    _large_densities,
    f"""WITH x AS (SELECT p_partkey, p_size * 13 AS k FROM part)
        SELECT p_partkey, round(exp(k * ln(300) - 300 - lgamma(k + 1)), 10) AS poisson, round(exp({_CHOOSE.format(1000, "k")} + k * ln(0.3) + (1000 - k) * ln(0.7)), 10) AS binom,
               round(exp({_CHOOSE.format("k + 39", "k")} + 40 * ln(0.1) + k * ln(0.9)), 10) AS negbinom, round(exp({_CHOOSE.format(900, "k")} + {_CHOOSE.format(1100, "700 - k")} - {_CHOOSE.format(2000, 700)}), 10) AS hypgeom,
               1.0::DOUBLE AS sure FROM x""",
)


def _schedules(s, d):
    rates = F.array(t / 10, disc / 10, F.lit(0.03))
    flows = F.array(-p, p * 0.3, -q, p * 0.5, p * 0.4)
    months = F.col("l_linenumber") + 3
    return _line(
        s, d, F.round(finance.cumipmt(rate, n, pv, F.lit(2), months), 4).alias("cumipmt"), F.round(finance.cumprinc(rate, n, pv, F.lit(2), months), 4).alias("cumprinc"), F.round(finance.fvschedule(p, rates), 3).alias("fvschedule"),
        F.round(finance.mirr(flows, F.lit(0.1), F.lit(0.12)), 9).alias("mirr"), F.round(finance.db(p, q, F.lit(6), F.lit(1), 7), 8).alias("db1"), F.round(finance.db(p, q, F.lit(6), F.lit(3), 7), 8).alias("db3"), F.round(finance.db(p, q, F.lit(6), F.lit(7), 7), 8).alias("db7"),
        F.round(finance.ddb(p, p * 0.2, F.lit(5), F.lit(4)), 8).alias("ddb_floor"), F.round(finance.nominal(t + 0.01, F.lit(4)), 10).alias("nominal"), F.round(finance.ispmt(rate, F.lit(3), n, pv), 8).alias("ispmt"),
    )


_RATE_DB = "round(1 - power(l_quantity / l_extendedprice, 1 / 6), 3)"
# what is owed before the k-th payment, and the interest on it, summed up
_OWES = f"(l_extendedprice * power(1 + {R}, k - 1) + {PMT} * (power(1 + {R}, k - 1) - 1) / {R})"
add(
    "h25_schedules",
    _schedules,
    f"""WITH x AS (SELECT *, (SELECT 0) AS z FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(list_sum(list_transform(range(2, l_linenumber + 4), lambda k: -{_OWES} * {R})), 4) AS cumipmt,
               round(list_sum(list_transform(range(2, l_linenumber + 4), lambda k: {PMT} + {_OWES} * {R})), 4) AS cumprinc,
               round(l_extendedprice * (1 + l_tax / 10) * (1 + l_discount / 10) * 1.03, 3) AS fvschedule,
               round(power((l_extendedprice * 0.3 * power(1.12, 3) + l_extendedprice * 0.5 * 1.12 + l_extendedprice * 0.4) / (l_extendedprice + l_quantity / power(1.1, 2)), 0.25) - 1, 9) AS mirr,
               round(l_extendedprice * {_RATE_DB} * 7 / 12, 8) AS db1, round((l_extendedprice - l_extendedprice * {_RATE_DB} * 7 / 12) * (1 - {_RATE_DB}) * {_RATE_DB}, 8) AS db3,
               round((l_extendedprice - l_extendedprice * {_RATE_DB} * 7 / 12) * power(1 - {_RATE_DB}, 5) * {_RATE_DB} * 5 / 12, 8) AS db7,
               round(l_extendedprice * greatest(0, power(0.6, 3) - 0.2), 8) AS ddb_floor, round(4 * (power(1.01 + l_tax, 0.25) - 1), 10) AS nominal, round(l_extendedprice * {R} * (3 / {N} - 1), 8) AS ispmt FROM x""",
)
