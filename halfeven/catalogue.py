"""The registered queries: one per operator of the dialect, with its DuckDB equivalent.

Every query is a statement in the dialect over the test tables (or over fixtures with NULLs, which the
tables don't have) and runs through a session.  Each DuckDB text casts computed columns to the types that
the dialect derives.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from .plans.session import Engine, Session
from .sources.backup import backup, restore
from .sources.tables import KEYS, configured, read, snapshot_path

#: Fixtures with NULLs, Unicode and ties: name, columns, rows as SQL that both engines read.
FIXTURES = {
    "outer_rows": ("id bigint, value bigint, region bigint, label string", "(1,3,7,'Zürich'),(2,3,8,'oslo'),(3,NULL,7,NULL),(4,12,NULL,'ñandú ☂'),(5,30,9,''),(6,8,8,'Ωmega')"),
    "inner_rows": ("id bigint, value bigint, region bigint", "(21,3,7),(22,NULL,9),(23,8,7),(24,12,8),(25,3,9),(26,30,NULL)"),
    "samples": ("id bigint, category bigint, amount bigint", None),
    "facts": ("id bigint, grp bigint, nullable_grp bigint, label string, amount bigint", "(1,4,2,'ß',5),(2,4,NULL,'ss',-5),(3,6,2,NULL,11),(4,6,3,'ß',11),(5,6,3,'',NULL),(6,9,NULL,'𝄞',0),(7,7,1,'k',3)"),
    "flags": ("id bigint, enabled boolean", "(1,NULL),(2,TRUE),(3,FALSE),(4,TRUE)"),
    "hash_left": ("id bigint, k bigint, amount decimal(8,2), flag boolean, label string", "(1,100,0.50,FALSE,'ü'),(2,NULL,7.25,TRUE,'x'),(3,300,7.25,NULL,'𝄞'),(4,100,-1.00,TRUE,NULL)"),
    "hash_right": ("id bigint, k bigint, amount decimal(9,3), flag boolean, label string", "(7,100,0.500,FALSE,'ü'),(8,300,7.250,TRUE,'𝄞'),(9,300,7.251,NULL,'𝄞'),(10,NULL,7.250,TRUE,'x'),(11,100,-1.000,TRUE,'ü')"),
    "numbers": ("id bigint, a bigint, b bigint, x decimal(8,2), y decimal(6,3)", "(1,11,4,3.75,0.375),(2,-11,4,-3.75,6.500),(3,11,-4,88.10,-2.125),(4,NULL,6,NULL,9.000),(5,13,NULL,1.11,NULL),(6,0,3,0.15,0.020)"),
    "moments": ("id bigint, day date, seen timestamp_ntz", "(1,DATE '2024-02-28',TIMESTAMP '2024-02-28 10:00:00.123456'),(2,DATE '2024-02-29',TIMESTAMP '2024-02-29 23:59:59.9'),(3,NULL,NULL),(4,DATE '1999-12-31',TIMESTAMP '1999-12-31 00:00:00')"),
}
_SAMPLES = "SELECT id, CASE WHEN id % 100 = 0 THEN NULL ELSE id % 7 END AS category, CASE WHEN id % 13 = 0 THEN NULL ELSE id END AS amount FROM "
_TYPES = {"string": "VARCHAR", "timestamp_ntz": "TIMESTAMP"}


def fixture(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = FIXTURES[name]
    if rows is None:
        return spark.sql(_SAMPLES + "range(1, 1101)")
    columns = [c.strip().split(" ", 1) for c in schema.split(", ")]
    ntz = rows.replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    casts = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in columns)
    return spark.sql(f"SELECT {casts} FROM VALUES {ntz} AS v({', '.join(n for n, _ in columns)})")


def fixture_sql(name: str) -> str:
    """The fixture as a DuckDB query."""
    schema, rows = FIXTURES[name]
    if rows is None:
        return f"(SELECT id, category::BIGINT AS category, amount::BIGINT AS amount FROM ({_SAMPLES} range(1, 1101) r(id)))"
    columns = [c.strip().split(" ", 1) for c in schema.split(", ")]
    casts = ", ".join(f"CAST({n} AS {_TYPES.get(t, t)}) AS {n}" for n, t in columns)
    return f"(SELECT {casts} FROM (VALUES {rows}) v({', '.join(n for n, _ in columns)}))"


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def session(spark: SparkSession, sf_dir: str, statement: str | None = None) -> Session:
    """A session over the test tables and the fixtures, or over those that a statement names (opening a table costs a footer)."""
    engine = Engine(configured(spark))
    wanted = {*TABLES, *FIXTURES} if statement is None else set(re.findall(r"\w+", statement.lower()))
    for name in wanted & set(TABLES):
        engine.register(name, read(spark, sf_dir, name), KEYS.get(name))
    for name in wanted & set(FIXTURES):
        engine.register(name, fixture(spark, name), "id")
    return engine.session()


#: name: (statement in the dialect, DuckDB text or None if it is the same, parameters)
STATEMENTS: dict[str, tuple] = {}
#: name: (function of a session that runs statements and returns rows, DuckDB text or None)
SCRIPTS: dict[str, tuple[Callable[[Session], DataFrame], str | None]] = {}


def _add(name: str, statement: str, duck: str | None = None, *parameters) -> None:
    STATEMENTS[name] = (statement, duck or statement, parameters)


D = "CAST({0} AS DECIMAL({1},{2}))".format
L = f"(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, {D('l_quantity', 12, 2)} AS l_quantity, {D('l_extendedprice', 12, 2)} AS l_extendedprice, {D('l_discount', 4, 2)} AS l_discount, {D('l_tax', 4, 2)} AS l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem)"
O = f"(SELECT o_orderkey, o_custkey, o_orderstatus, {D('o_totalprice', 12, 2)} AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"
C = f"(SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, {D('c_acctbal', 12, 2)} AS c_acctbal, c_mktsegment FROM customer)"
N = "(SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation)"
R = "(SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region)"
S = f"(SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, {D('s_acctbal', 12, 2)} AS s_acctbal FROM supplier)"
P = f"(SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, {D('p_retailprice', 12, 2)} AS p_retailprice FROM part)"


def _half_even(n: str, d: str, places: int, digits: int = 18) -> str:
    """DuckDB text of the whole numbers n / d, rounded half-even, as a decimal with so many places."""
    q, r = f"(({n})::HUGEINT // ({d})::HUGEINT)", f"(({n})::HUGEINT % ({d})::HUGEINT)"
    up = f"2 * abs({r}) > abs(({d})::HUGEINT) OR (2 * abs({r}) = abs(({d})::HUGEINT) AND {q} % 2 <> 0)"
    whole = f"({q} + CASE WHEN {up} THEN sign(({n})::HUGEINT) * sign(({d})::HUGEINT) ELSE 0 END)"
    return f"CAST(CAST({whole} AS DECIMAL(38,0)) * {D('0.' + '0' * (places - 1) + '1' if places else '1', places + 1, places)} AS DECIMAL({digits},{places}))"


# 2.1 scans
_add("sc1_table_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation", f"SELECT * FROM {N}")
_add("sc2_key_range_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200", f"SELECT o_orderkey, o_totalprice FROM {O} WHERE o_orderkey BETWEEN 100 AND 200")
_add("sc3_secondary_scan", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 10 AND o_custkey < 20")
_add("sc4_unique_lookup", "SELECT c_custkey, c_acctbal FROM customer WHERE c_name = 'Customer#000000077'", f"SELECT c_custkey, c_acctbal FROM {C} WHERE c_name = 'Customer#000000077'")
_add("sc5_key_order", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
_add("sc7_derived_table", "SELECT d.k, d.twice FROM (SELECT e.k AS k, e.q * 2.0 AS twice FROM (SELECT l_orderkey AS k, l_quantity AS q FROM lineitem) e WHERE e.q > 40.00) d", f"SELECT l_orderkey AS k, {D('l_quantity * 2', 14, 3)} AS twice FROM {L} WHERE l_quantity > 40")
_add("sc8_constant_select", "SELECT 1.20 + 2.345 AS total, 7 / 2 AS q, 'a''b' AS t", "SELECT CAST(3.545 AS DECIMAL(5,3)) AS total, 3::BIGINT AS q, 'a''b' AS t")

# 2.2 projection and predicates
_add("pf1_projection", "SELECT c.c_custkey AS id, c.c_mktsegment segment FROM customer c", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
_add("pf2_select_star", "SELECT * FROM region", f"SELECT * FROM {R}")
_add("pf3_computed_projection", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1.00 - l_discount) AS net FROM lineitem", f"SELECT l_orderkey, l_linenumber, CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(17,4)) AS net FROM {L}")
_add("pf4_null_literal", "SELECT id, NULL AS nothing FROM flags", f"SELECT id, NULL::BIGINT AS nothing FROM {fixture_sql('flags')}")
_add("pf5_default_names", "SELECT SUM(amount) FROM facts", f"SELECT sum(amount)::BIGINT AS sum FROM {fixture_sql('facts')}")
_add("pf6_comparisons", "SELECT id FROM numbers WHERE a > b AND x <> 1.25 AND x <= 42.7", f"SELECT id FROM {fixture_sql('numbers')} WHERE a > b AND x <> 1.25 AND x <= 42.7")
_add("pf7_three_valued_logic", "SELECT id FROM outer_rows WHERE NOT (value > 15 OR region = 3) OR value IS NULL AND region = 2", f"SELECT id FROM {fixture_sql('outer_rows')} WHERE NOT (value > 15 OR region = 3) OR value IS NULL AND region = 2")
_add("pf7_short_circuit", "SELECT id FROM numbers WHERE a <> 0 AND 100 / a > 10", f"SELECT id FROM {fixture_sql('numbers')} WHERE a <> 0 AND 100 // nullif(a, 0) > 10")
_add("pf8_is_null", "SELECT id FROM outer_rows WHERE value IS NOT NULL", f"SELECT id FROM {fixture_sql('outer_rows')} WHERE value IS NOT NULL")
_add("pf9_is_truth", "SELECT id FROM outer_rows WHERE (value > 10) IS UNKNOWN OR (value > 30) IS NOT FALSE", f"SELECT id FROM {fixture_sql('outer_rows')} WHERE (value > 10) IS NULL OR coalesce(value > 30, TRUE)")
_add("pf10_boolean_column", "SELECT id FROM flags WHERE enabled", f"SELECT id FROM {fixture_sql('flags')} WHERE enabled")
_add("pf11_between", "SELECT COUNT(*) AS n FROM lineitem WHERE l_quantity NOT BETWEEN 10.00 AND 40.00", f"SELECT count(*) AS n FROM {L} WHERE l_quantity NOT BETWEEN 10 AND 40")
_add("pf12_in_list", "SELECT id FROM outer_rows WHERE value IN (10, 40, NULL)", f"SELECT id FROM {fixture_sql('outer_rows')} WHERE value IN (10, 40, NULL)")
_add("pf12_not_in_list", "SELECT id FROM outer_rows WHERE value NOT IN (10, NULL) OR region NOT IN (1, 2)", f"SELECT id FROM {fixture_sql('outer_rows')} WHERE value NOT IN (10, NULL) OR region NOT IN (1, 2)")
_add("pf13_text_order", "SELECT id, label FROM facts WHERE label > 'z' AND label < '犬z'", f"SELECT id, label FROM {fixture_sql('facts')} WHERE label > 'z' AND label < '犬z'")
_add("pf14_parameters", "SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_totalprice > ? AND o_orderstatus <> ? AND o_orderdate >= ?", f"SELECT o_orderkey FROM {O} WHERE o_custkey = 77 AND o_totalprice > 1000.50 AND o_orderstatus <> 'X' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'", 77, Decimal("1000.50"), "X", dt.datetime(1996, 1, 1))

# 2.3 joins
_add("j1_inner_chain", "SELECT r_name, COUNT(*) AS n FROM (SELECT r.r_name AS r_name, o.o_orderkey AS k FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey) d GROUP BY r_name", "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_add("j2_left_join", "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 450000.00", f"SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN {O} ON o_custkey = c_custkey AND o_totalprice > 450000")
_add("j3_theta_join", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey * 3", f"SELECT n_nationkey AS a, r_regionkey AS b FROM {N} JOIN {R} ON n_nationkey < r_regionkey * 3")
_add("j4_lookup_join", "SELECT s.s_suppkey AS k, n.n_name AS nation FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey", "SELECT s_suppkey AS k, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
_add("j5_typed_keys", "SELECT a.id AS a, b.id AS b FROM hash_left a JOIN hash_right b ON a.amount = b.amount AND a.flag = b.flag AND a.label = b.label AND a.k = b.k", f"SELECT a.id AS a, b.id AS b FROM {fixture_sql('hash_left')} a JOIN {fixture_sql('hash_right')} b ON a.amount = b.amount AND a.flag = b.flag AND a.label = b.label AND a.k = b.k")
_add("j6_large_join", "SELECT SUM(price) AS total FROM (SELECT l.l_extendedprice AS price FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F') d", f"SELECT CAST(sum(l_extendedprice) AS DECIMAL(18,2)) AS total FROM {L} JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
_add("j7_self_join", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
_add("j8_residual_conditions", "SELECT a.id AS a, b.id AS b FROM hash_left a LEFT JOIN hash_right b ON a.k = b.k AND (b.id > 11 OR b.flag IS NULL)", f"SELECT a.id AS a, b.id AS b FROM {fixture_sql('hash_left')} a LEFT JOIN {fixture_sql('hash_right')} b ON a.k = b.k AND (b.id > 11 OR b.flag IS NULL)")
_add("j9_computed_key", "SELECT a.id AS a, b.id AS b FROM hash_left a JOIN hash_right b ON a.k + 10 = b.k", f"SELECT a.id AS a, b.id AS b FROM {fixture_sql('hash_left')} a JOIN {fixture_sql('hash_right')} b ON a.k + 10 = b.k")
_add("j10_joined_projection", "SELECT o.o_orderkey AS k, o.o_totalprice - c.c_acctbal AS rest FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 3", f"SELECT o_orderkey AS k, CAST(o_totalprice - c_acctbal AS DECIMAL(13,2)) AS rest FROM {O} JOIN {C} ON o_custkey = c_custkey WHERE c_nationkey = 3")
_add("j11_join_order_limit", "SELECT o.o_orderkey AS k, c.c_name AS name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey ORDER BY k DESC LIMIT 12", "SELECT o_orderkey AS k, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY k DESC LIMIT 12")
_add("j12_staged_join", "SELECT SUM(q) AS total FROM (SELECT l.l_quantity AS q FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_size > 25) d", f"SELECT CAST(sum(l_quantity) AS DECIMAL(18,2)) AS total FROM {L} JOIN part ON l_partkey = p_partkey WHERE p_size > 25")
_add("j13_semi_join", "SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT l_orderkey FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity = 50.00)", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity = 50)")
_add("j14_anti_join", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")

# 2.4 aggregation
_add("ag1_count_rows", "SELECT COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R'", "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'")
_add("ag2_count_values", "SELECT COUNT(amount) AS n FROM samples", f"SELECT count(amount) AS n FROM {fixture_sql('samples')}")
_add("ag3_exact_sum", "SELECT SUM(l_extendedprice * (1.00 - l_discount)) AS revenue FROM lineitem", f"SELECT CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(18,4)) AS revenue FROM {L}")
_add("ag4_half_even_average", "SELECT l_returnflag, AVG(l_extendedprice) AS mean FROM lineitem GROUP BY l_returnflag", f"SELECT l_returnflag, {_half_even('sum((l_extendedprice * 100)::HUGEINT) * 10000', 'count(*)', 6)} AS mean FROM {L} GROUP BY l_returnflag")
_add("ag4_average_of_bigint", "SELECT category, AVG(amount) AS mean FROM samples GROUP BY category", f"SELECT category, {_half_even('sum(amount)', 'count(amount)', 0)} AS mean FROM {fixture_sql('samples')} GROUP BY category")
_add("ag5_min_max", "SELECT MAX(l_shipdate) AS last FROM lineitem", "SELECT max(l_shipdate) AS last FROM lineitem")
_add("ag6_min_text", "SELECT grp, MIN(label) AS least FROM facts GROUP BY grp", f"SELECT grp, min(label) AS least FROM {fixture_sql('facts')} GROUP BY grp")
_add("ag7_scalar_aggregate", "SELECT MIN(o_totalprice) AS least FROM orders WHERE o_orderstatus = 'P'", f"SELECT min(o_totalprice) AS least FROM {O} WHERE o_orderstatus = 'P'")
_add("ag8_group", "SELECT category, SUM(amount) AS total FROM samples GROUP BY category", f"SELECT category, sum(amount)::BIGINT AS total FROM {fixture_sql('samples')} GROUP BY category")
_add("ag9_computed_key", "SELECT EXTRACT(YEAR FROM o_orderdate) AS y, SUM(o_totalprice) AS total FROM orders GROUP BY EXTRACT(YEAR FROM o_orderdate)", f"SELECT extract(year FROM o_orderdate) AS y, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total FROM {O} GROUP BY 1")
_add("ag10_computed_operand", "SELECT l_linestatus, SUM(l_quantity * 2.0 + 1.0) AS total FROM lineitem GROUP BY l_linestatus", f"SELECT l_linestatus, CAST(sum(l_quantity * 2 + 1) AS DECIMAL(18,3)) AS total FROM {L} GROUP BY l_linestatus")
_add("ag11_scalar_having", "SELECT SUM(amount) AS total FROM facts HAVING COUNT(*) > 4 AND SUM(amount) < 100", f"SELECT sum(amount)::BIGINT AS total FROM {fixture_sql('facts')} HAVING count(*) > 4 AND sum(amount) < 100")
_add("ag12_grouped_having", "SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND total / COUNT(*) > 200000 AND MIN(o_totalprice) < MAX(o_totalprice) - 1000", f"SELECT o_custkey, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total FROM {O} GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 200000 * count(*) AND min(o_totalprice) < max(o_totalprice) - 1000")
_add("ag13_distinct", "SELECT DISTINCT nullable_grp FROM facts", f"SELECT DISTINCT nullable_grp FROM {fixture_sql('facts')}")
_add("ag14_staged_aggregates", "SELECT MAX(total) AS most FROM (SELECT o_custkey AS c, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) d", f"SELECT max(t) AS most FROM (SELECT CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS t FROM {O} GROUP BY o_custkey)")
_add("ag15_text_key", "SELECT label, COUNT(*) AS n FROM facts GROUP BY label", f"SELECT label, count(*) AS n FROM {fixture_sql('facts')} GROUP BY label")

# 2.6 order and limit
_add("so1_null_order", "SELECT id, value FROM outer_rows ORDER BY value LIMIT 2", f"SELECT id, value FROM {fixture_sql('outer_rows')} ORDER BY value NULLS FIRST, id LIMIT 2")
_add("so2_tie_break", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC LIMIT 40", "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC, o_orderkey DESC LIMIT 40")
_add("so3_large_sort", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice", f"SELECT o_orderkey, o_totalprice FROM {O}")
_add("so4_computed_order", "SELECT o_orderkey, o_totalprice - 1000.00 AS rest FROM orders ORDER BY rest DESC LIMIT 30", f"SELECT o_orderkey, CAST(o_totalprice - 1000 AS DECIMAL(13,2)) AS rest FROM {O} ORDER BY rest DESC, o_orderkey DESC LIMIT 30")
_add("so5_grouped_order", "SELECT l_returnflag, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 2", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag ORDER BY l_returnflag LIMIT 2")
_add("so6_limit_zero", "SELECT n_name FROM nation LIMIT 0")
_add("so7_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 10", f"SELECT o_orderkey, o_totalprice FROM {O} ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10")

# 2.8 scalar functions
_X = fixture_sql("numbers")
_add("sf1_unary", "SELECT id, -x AS m, +a AS p FROM numbers", f"SELECT id, CAST(-x AS DECIMAL(8,2)) AS m, a AS p FROM {_X}")
_add("sf2_add_subtract_multiply", "SELECT id, x + y AS s, x - a AS d, x * y AS p, a * b AS q FROM numbers", f"SELECT id, CAST(x + y AS DECIMAL(10,3)) AS s, CAST(x - a AS DECIMAL(18,0)) AS z, CAST(x * y AS DECIMAL(14,5)) AS p, a * b AS q FROM {_X}".replace("CAST(x - a AS DECIMAL(18,0)) AS z", "CAST(round_even(x - a, 0) AS DECIMAL(18,0)) AS d"))
_add("sf3_bigint_division", "SELECT id, a / b AS q FROM numbers", f"SELECT id, a // b AS q FROM {_X}")
_add("sf2_scale_gives_way", "SELECT id, x * a AS p FROM numbers", f"SELECT id, CAST(round_even(x * a, 0) AS DECIMAL(18,0)) AS p FROM {_X}")
_add("sf3_decimal_division", "SELECT id, x / y AS q FROM numbers", f"SELECT id, {_half_even('(x * 100)::HUGEINT * 10000000000', '(y * 1000)::HUGEINT', 9)} AS q FROM {_X}")
_add("sf4_remainder", "SELECT id, a % b AS r, x % y AS s FROM numbers", f"SELECT id, a % b AS r, CAST(x % y AS DECIMAL(6,3)) AS s FROM {_X}")
_add("sf5_abs", "SELECT id, ABS(x) AS v FROM numbers", f"SELECT id, CAST(abs(x) AS DECIMAL(8,2)) AS v FROM {_X}")
_add("sf6_ceil", "SELECT id, CEIL(x) AS v FROM numbers", f"SELECT id, CAST(ceil(x) AS DECIMAL(18,0)) AS v FROM {_X}")
_add("sf7_floor", "SELECT id, FLOOR(x) AS v FROM numbers", f"SELECT id, CAST(floor(x) AS DECIMAL(18,0)) AS v FROM {_X}")
_add("sf8_round_half_even", "SELECT l_orderkey, l_linenumber, ROUND(l_extendedprice * l_discount, 2) AS v FROM lineitem", f"SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice * l_discount, 2) AS DECIMAL(14,2)) AS v FROM {L}")
_add("sf9_truncate", "SELECT id, TRUNCATE(y, 2) AS v FROM numbers", f"SELECT id, CAST(y - y % 0.01 AS DECIMAL(5,2)) AS v FROM {_X}")
_add("sf10_cast_numbers", "SELECT id, CAST(x AS DECIMAL(6,1)) AS d, CAST(a AS DECIMAL(10,2)) AS e FROM numbers", f"SELECT id, CAST(round_even(x, 1) AS DECIMAL(6,1)) AS d, CAST(a AS DECIMAL(10,2)) AS e FROM {_X}")
_M = fixture_sql("moments")
_add("sf11_temporal_to_text", "SELECT id, CAST(day AS VARCHAR(10)) AS d, CAST(seen AS VARCHAR(26)) AS s FROM moments", f"SELECT id, strftime(day, '%Y-%m-%d') AS d, strftime(seen, '%Y-%m-%d %H:%M:%S.%f') AS s FROM {_M}")
_add("sf12_text_to_temporal", "SELECT id, CAST(CAST(day AS VARCHAR(10)) AS DATE) AS d, CAST('2024-02-29 10:11:12.5' AS TIMESTAMP(6)) AS s FROM moments", f"SELECT id, day AS d, TIMESTAMP '2024-02-29 10:11:12.5' AS s FROM {_M}")
_add("sf13_current_date", "SELECT COUNT(*) AS n FROM moments WHERE day < CURRENT_DATE", f"SELECT count(*) AS n FROM {_M} WHERE day < current_date")
_add("sf14_current_timestamp", "SELECT COUNT(*) AS n FROM moments WHERE seen AT TIME ZONE 'UTC' < CURRENT_TIMESTAMP", f"SELECT count(seen) AS n FROM {_M}")
_add("sf15_localtime", "SELECT COUNT(*) AS n FROM moments WHERE LOCALTIME >= TIME '00:00:00'", f"SELECT count(*) AS n FROM {_M}")
_add("sf16_localtimestamp", "SELECT COUNT(*) AS n FROM moments WHERE seen < LOCALTIMESTAMP", f"SELECT count(seen) AS n FROM {_M}")
_add("sf17_extract_date", "SELECT event_id, EXTRACT(YEAR FROM ts) AS y, EXTRACT(MONTH FROM ts) AS m, EXTRACT(DAY FROM ts) AS d FROM events", "SELECT event_id, extract(year FROM ts) AS y, extract(month FROM ts) AS m, extract(day FROM ts) AS d FROM events")
_add("sf18_extract_time", "SELECT event_id, EXTRACT(HOUR FROM ts) AS h, EXTRACT(MINUTE FROM ts) AS m FROM events", "SELECT event_id, extract(hour FROM ts) AS h, extract(minute FROM ts) AS m FROM events")
_add("sf19_extract_second", "SELECT event_id, EXTRACT(SECOND FROM ts) AS s FROM events", "SELECT event_id, CAST(CAST(extract(microseconds FROM ts) AS DECIMAL(18,0)) * 0.000001 AS DECIMAL(8,6)) AS s FROM events")
_add("sf20_extract_zone", "SELECT id, EXTRACT(TIMEZONE_HOUR FROM seen AT TIME ZONE 'UTC') AS h, EXTRACT(TIMEZONE_MINUTE FROM seen AT TIME ZONE 'UTC') AS m FROM moments", f"SELECT id, CASE WHEN seen IS NOT NULL THEN 0::BIGINT END AS h, CASE WHEN seen IS NOT NULL THEN 0::BIGINT END AS m FROM {_M}")
_add("sf21_date_shift", "SELECT id, day + 2 AS later, day - id AS sooner FROM moments", f"SELECT id, day + 2 AS later, day - id::INTEGER AS sooner FROM {_M}")
_add("sf22_date_difference", "SELECT id, day - DATE '2000-01-01' AS days FROM moments", f"SELECT id, (day - DATE '2000-01-01')::BIGINT AS days FROM {_M}")
_add("sf23_at_time_zone", "SELECT event_id, CAST(ts AT TIME ZONE '+05:30' AS VARCHAR(40)) AS s, CAST((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Tokyo' AS VARCHAR(40)) AS j FROM events", "SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS s, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS j FROM events")

# 2.9 subqueries
_add("sq1_exists", "SELECT id FROM outer_rows o WHERE EXISTS (SELECT id FROM inner_rows i WHERE i.region = o.region AND i.value = 10)", f"SELECT id FROM {fixture_sql('outer_rows')} o WHERE EXISTS (SELECT 1 FROM {fixture_sql('inner_rows')} i WHERE i.region = o.region AND i.value = 10)")
_add("sq2_in", "SELECT id FROM outer_rows o WHERE value IN (SELECT value FROM inner_rows i WHERE i.region = o.region)", f"SELECT id FROM {fixture_sql('outer_rows')} o WHERE value IN (SELECT value FROM {fixture_sql('inner_rows')} i WHERE i.region = o.region)")
_add("sq2_not_in_with_null", "SELECT id FROM outer_rows WHERE value NOT IN (SELECT value FROM inner_rows)", f"SELECT id FROM {fixture_sql('outer_rows')} WHERE value NOT IN (SELECT value FROM {fixture_sql('inner_rows')})")
_add("sq3_scalar", "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')", f"SELECT n_name FROM {N} WHERE n_regionkey = (SELECT r_regionkey FROM {R} WHERE r_name = 'ASIA')")
_add("sq4_grandparent", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT l_orderkey FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey > c.c_nationkey))", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_suppkey > c.c_nationkey))")
_add("sq5_under_or_not", "SELECT id FROM outer_rows o WHERE value > 30 OR NOT (region = 2 OR EXISTS (SELECT id FROM inner_rows i WHERE i.value = o.value))", f"SELECT id FROM {fixture_sql('outer_rows')} o WHERE value > 30 OR NOT (region = 2 OR EXISTS (SELECT 1 FROM {fixture_sql('inner_rows')} i WHERE i.value = o.value))")
_add("sq6_joined_blocks", "SELECT o.o_orderkey AS k FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey IN (SELECT n.n_nationkey FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'EUROPE')", "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
_add("sq7_uncorrelated", "SELECT COUNT(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > (SELECT MIN(c_acctbal) FROM customer)", f"SELECT count(*) AS n FROM {O} WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > (SELECT min(c_acctbal) FROM {C})")
_add("sq8_filtered_consumers", "SELECT o_orderstatus, SUM(o_totalprice) AS total FROM orders o WHERE EXISTS (SELECT c_custkey FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey < 5) GROUP BY o_orderstatus", f"SELECT o_orderstatus, CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS total FROM {O} o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_nationkey < 5) GROUP BY o_orderstatus")

# larger statements, over whole tables
_add("q1_pricing_summary", "SELECT flag, SUM(net) AS revenue FROM (SELECT l_returnflag AS flag, l_extendedprice * (1.00 - l_discount) AS net FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00') d GROUP BY flag HAVING COUNT(*) > 10 ORDER BY flag", f"SELECT l_returnflag AS flag, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(18,4)) AS revenue FROM {L} WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1")
_add("q3_segment_revenue", "SELECT k, SUM(net) AS revenue FROM (SELECT l.l_orderkey AS k, l.l_extendedprice * (1.00 - l.l_discount) AS net FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < TIMESTAMP '1998-03-15 00:00:00') d GROUP BY k", f"SELECT l_orderkey AS k, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(18,4)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN {L} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' GROUP BY 1")
_add("q5_region_volume", "SELECT nation, SUM(net) AS revenue FROM (SELECT n.n_name AS nation, l.l_extendedprice * (1.00 - l.l_discount) AS net FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_nationkey = c.c_nationkey JOIN nation n ON s.s_nationkey = n.n_nationkey) d GROUP BY nation", f"SELECT n_name AS nation, CAST(sum(l_extendedprice * (1 - l_discount)) AS DECIMAL(18,4)) AS revenue FROM {L} JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
_add("q6_forecast", "SELECT SUM(l_extendedprice * l_discount) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24.00", f"SELECT CAST(sum(l_extendedprice * l_discount) AS DECIMAL(18,4)) AS revenue FROM {L} WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")


def _script(*statements: str, then: str) -> Callable[[Session], DataFrame]:
    def run(s: Session) -> DataFrame:
        for statement in statements:
            s.execute(statement)
        return s.query(then)

    return run


_T = ("CREATE TABLE invoices (id BIGINT PRIMARY KEY, paid BOOLEAN DEFAULT FALSE, amount DECIMAL(8,2) DEFAULT 12.30 CHECK (amount >= 0.00))", "INSERT INTO invoices VALUES (1, TRUE, 42.7), (2, FALSE, 10.00), (3, DEFAULT, DEFAULT)")
_ROWS = "SELECT id::BIGINT AS id, paid, amount::DECIMAL(8,2) AS amount FROM (VALUES {}) v(id, paid, amount)".format
_ALL = "SELECT id, paid, amount FROM invoices"


def _refused(s: Session, statement: str) -> str:
    from .errors import EngineError

    try:
        s.execute(statement)
    except EngineError as e:
        return e.sqlstate
    return "none"


def _constraints(s: Session) -> DataFrame:
    for t in (*_T, "CREATE TABLE payments (id BIGINT PRIMARY KEY, invoice BIGINT REFERENCES invoices(id), code VARCHAR(3) UNIQUE)", "INSERT INTO payments VALUES (1, 1, 'a'), (2, NULL, NULL), (3, NULL, NULL)"):
        s.execute(t)
    tries = ["INSERT INTO invoices VALUES (1, TRUE, 1.00)", "INSERT INTO invoices VALUES (9, TRUE, -1.00)", "INSERT INTO invoices VALUES (NULL, TRUE, 1.00)", "INSERT INTO payments VALUES (4, 77, 'b')", "INSERT INTO payments VALUES (4, 1, 'a')", "INSERT INTO payments VALUES (4, 1, 'abcd')", "DELETE FROM invoices WHERE id = 1"]
    return s.spark.createDataFrame([(k, _refused(s, t)) for k, t in enumerate(tries)], "n bigint, sqlstate string")


def _identity(s: Session) -> DataFrame:
    s.execute("CREATE TABLE log (id BIGINT PRIMARY KEY GENERATED ALWAYS AS IDENTITY, note VARCHAR(9))")
    s.execute("INSERT INTO log (note) VALUES ('a'), ('b')")
    s.execute("INSERT INTO log (note) VALUES ('c')")
    return s.query("SELECT id, note FROM log")


def _conflict(s: Session) -> DataFrame:
    for t in _T:
        s.execute(t)
    other = s.engine.session()
    s.execute("BEGIN")
    s.execute("DELETE FROM invoices WHERE id = 1")
    other.execute("DELETE FROM invoices WHERE id = 2")
    state = _refused(s, "COMMIT")
    return s.spark.createDataFrame([(state, s.query("SELECT id FROM invoices").count())], "sqlstate string, n bigint")


def _authorised(s: Session) -> DataFrame:
    reader = s.engine.session(("READ",))
    n = reader.query("SELECT n_name FROM nation").count()
    return s.spark.createDataFrame([(n, _refused(reader, "CREATE SEQUENCE q"))], "n bigint, sqlstate string")


def _sequence(s: Session) -> DataFrame:
    s.execute("CREATE SEQUENCE numbers_of START WITH 5 INCREMENT BY 3")
    s.query("SELECT NEXT VALUE FOR numbers_of")
    return s.query("SELECT NEXT VALUE FOR numbers_of")


def _plan(s: Session) -> DataFrame:
    plan = s.query("EXPLAIN ANALYZE SELECT n_name FROM nation WHERE n_regionkey = 2")
    return plan.selectExpr("max(rows) AS n", "count_if(operator = 'Filter') > 0 AS filters")


def _statistics(table: str) -> Callable[[Session], DataFrame]:
    return lambda s: s.query(f"ANALYZE TABLE {table}").select("column_name", "row_count", "null_count", "distinct_count")


def _restored(s: Session) -> DataFrame:
    for t in (*_T, "CREATE VIEW large AS SELECT id, amount FROM invoices WHERE amount > 11.00"):
        s.execute(t)
    path = snapshot_path(s.spark, "backup")
    backup(s.engine, path)
    other = restore(s.spark, path).session()
    other.execute("INSERT INTO invoices (id) VALUES (4)")
    return other.query("SELECT id, amount FROM large")


def _streamed(s: Session) -> DataFrame:
    rows = [(r.n_name,) for r in s.stream("SELECT n_name FROM nation ORDER BY n_name LIMIT 3")]
    return s.spark.createDataFrame(rows, "n_name string")


SCRIPTS.update({
    "sc6_view_scan": (_script("CREATE VIEW rich AS SELECT c_custkey, c_acctbal * 2.0 AS twice FROM customer WHERE c_acctbal > 9000.00", then="SELECT * FROM rich"), f"SELECT c_custkey, CAST(c_acctbal * 2 AS DECIMAL(14,3)) AS twice FROM {C} WHERE c_acctbal > 9000"),
    "sc6_grouped_view": (_script("CREATE VIEW volume AS SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey", then="SELECT MAX(total) AS most FROM volume"), f"SELECT max(t) AS most FROM (SELECT CAST(sum(o_totalprice) AS DECIMAL(18,2)) AS t FROM {O} GROUP BY o_custkey)"),
    "sc9_show_tables": (_script(*_T, "CREATE VIEW paid_ones AS SELECT id FROM invoices WHERE paid", then="SHOW TABLES"), "SELECT unnest(" + str(sorted([*FIXTURES, "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "invoices", "paid_ones"])) + ") AS table_name, CASE WHEN table_name = 'paid_ones' THEN 'VIEW' ELSE 'TABLE' END AS table_type"),
    "sc9_show_columns": (_script(*_T, then="SHOW COLUMNS FROM invoices"), "SELECT * FROM (VALUES ('id', 'BIGINT', FALSE, 1::BIGINT), ('paid', 'BOOLEAN', TRUE, 2), ('amount', 'DECIMAL(8,2)', TRUE, 3)) v(column_name, type, is_nullable, ordinal)"),
    "sc9_show_indexes": (_script(*_T, "CREATE UNIQUE INDEX by_amount ON invoices(amount)", then="SHOW INDEXES FROM invoices"), "SELECT * FROM (VALUES ('invoices', 'primary', 'id', TRUE, TRUE), ('invoices', 'by_amount', 'amount', TRUE, FALSE)) v(table_name, index_name, column_name, is_unique, is_primary)"),
    "sc10_row_cursor": (_streamed, "SELECT n_name FROM nation ORDER BY n_name LIMIT 3"),
    "sc12_backup_restore": (_restored, "SELECT id::BIGINT AS id, amount::DECIMAL(8,2) AS amount FROM (VALUES (1, 42.7), (3, 12.3), (4, 12.3)) v(id, amount)"),
    "sf24_next_value": (_sequence, "SELECT 8::BIGINT AS next_value"),
    "dd1_create_table": (_script(*_T, then=_ALL), _ROWS("(1, TRUE, 42.7), (2, FALSE, 10), (3, FALSE, 12.3)")),
    "dd2_identity": (_identity, "SELECT * FROM (VALUES (1::BIGINT, 'a'), (2, 'b'), (3, 'c')) v(id, note)"),
    "dd3_indexes": (_script(*_T, "CREATE INDEX i ON invoices(paid)", "ALTER INDEX i RENAME TO j", "CREATE INDEX k ON invoices(amount)", "DROP INDEX k ON invoices", then="SHOW INDEXES FROM invoices"), "SELECT * FROM (VALUES ('invoices', 'primary', 'id', TRUE, TRUE), ('invoices', 'j', 'paid', FALSE, FALSE)) v(table_name, index_name, column_name, is_unique, is_primary)"),
    "dd4_views": (_script(*_T, "CREATE VIEW a AS SELECT id FROM invoices WHERE amount > 11.00", "CREATE VIEW b AS SELECT id FROM a", "DROP VIEW b", then="SELECT id FROM a"), "SELECT unnest([1, 3])::BIGINT AS id"),
    "dd5_rename": (_script(*_T, "ALTER TABLE invoices RENAME COLUMN amount TO total", "ALTER TABLE invoices RENAME TO bills", then="SELECT id, total FROM bills WHERE total > 11.00"), "SELECT id::BIGINT AS id, total::DECIMAL(8,2) AS total FROM (VALUES (1, 42.7), (3, 12.3)) v(id, total)"),
    "dd6_sequences": (_script("CREATE SEQUENCE a", "CREATE SEQUENCE b START WITH -4 INCREMENT BY -2", "DROP SEQUENCE a", then="SELECT NEXT VALUE FOR b"), "SELECT -4::BIGINT AS next_value"),
    "dd7_analyze": (_statistics("facts"), "SELECT * FROM (VALUES ('id', 7::BIGINT, 0::BIGINT, 7::BIGINT), ('grp', 7, 0, 4), ('nullable_grp', 7, 2, 3), ('label', 7, 1, 5), ('amount', 7, 1, 5)) v(column_name, row_count, null_count, distinct_count)"),
    "dd7_analyze_orders": (_statistics("orders"), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS distinct_count FROM {O}" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"))),
    "dd8_show": (_script("CREATE TABLE plain", then="SHOW COLUMNS FROM plain"), "SELECT * FROM (VALUES ('key', 'BIGINT', FALSE, 1::BIGINT), ('value', 'BIGINT', TRUE, 2)) v(column_name, type, is_nullable, ordinal)"),
    "dd9_explain": (_plan, f"SELECT count(*) AS n, TRUE AS filters FROM {N} WHERE n_regionkey = 2"),
    "dd10_time_zone": (_script("SET TIME ZONE 'Asia/Tokyo'", then="SELECT id, CAST(CAST(seen AS TIMESTAMP(6) WITH TIME ZONE) AS VARCHAR(40)) AS s FROM moments"), f"SELECT id, strftime(seen - INTERVAL 9 HOUR, '%Y-%m-%d %H:%M:%S.%f') || '+00:00' AS s FROM {_M}"),
    "dd11_checkpoint": (_script(*_T, "INSERT INTO invoices VALUES (4, TRUE, 1.00)", "CHECKPOINT", then=_ALL), _ROWS("(1, TRUE, 42.7), (2, FALSE, 10), (3, FALSE, 12.3), (4, TRUE, 1)")),
    "dm1_insert": (_script(*_T, "INSERT INTO invoices (id, amount) VALUES (4, 1.5 * 2), (5, NULL)", then=_ALL), _ROWS("(1, TRUE, 42.7), (2, FALSE, 10), (3, FALSE, 12.3), (4, FALSE, 3), (5, FALSE, NULL)")),
    "dm2_update": (_script(*_T, "UPDATE invoices SET amount = amount + 1.00, paid = amount > 12.00 WHERE id >= 2", then=_ALL), _ROWS("(1, TRUE, 42.7), (2, FALSE, 11), (3, TRUE, 13.3)")),
    "dm3_delete": (_script(*_T, "INSERT INTO invoices VALUES (4, TRUE, NULL)", "DELETE FROM invoices WHERE amount > 11.00", then=_ALL), _ROWS("(2, FALSE, 10), (4, TRUE, NULL)")),
    "dm4_constraints": (_constraints, "SELECT n::BIGINT AS n, s AS sqlstate FROM (VALUES (0, '23505'), (1, '23514'), (2, '23502'), (3, '23503'), (4, '23505'), (5, '22001'), (6, '23503')) v(n, s)"),
    "tx1_begin": (_script(*_T, "BEGIN SERIALIZABLE", "DELETE FROM invoices WHERE id = 1", then=_ALL), _ROWS("(2, FALSE, 10), (3, FALSE, 12.3)")),
    "tx2_commit_rollback": (_script(*_T, "BEGIN", "DELETE FROM invoices WHERE id = 1", "COMMIT", "BEGIN READ COMMITTED", "DELETE FROM invoices WHERE id = 2", "ROLLBACK", then=_ALL), _ROWS("(2, FALSE, 10), (3, FALSE, 12.3)")),
    "tx3_savepoints": (_script(*_T, "BEGIN", "DELETE FROM invoices WHERE id = 1", "SAVEPOINT a", "DELETE FROM invoices WHERE id = 2", "SAVEPOINT b", "DELETE FROM invoices WHERE id = 3", "ROLLBACK TO SAVEPOINT b", "RELEASE SAVEPOINT b", "COMMIT", then=_ALL), _ROWS("(3, FALSE, 12.3)")),
    "tx4_autocommit": (_script(*_T, "UPDATE invoices SET paid = TRUE WHERE id = 2", then="SELECT id FROM invoices WHERE paid"), "SELECT unnest([1, 2])::BIGINT AS id"),
    "tx5_conflict": (_conflict, "SELECT '40001' AS sqlstate, 2::BIGINT AS n"),
    "tx6_statement_rollback": (lambda s: (_script(*_T, "BEGIN", "DELETE FROM invoices WHERE id = 1", then=_ALL)(s), _refused(s, "INSERT INTO invoices VALUES (7, TRUE, 1.00), (2, TRUE, 1.00)"), s.query(_ALL))[-1], _ROWS("(2, FALSE, 10), (3, FALSE, 12.3)")),
    "au1_permissions": (_authorised, "SELECT 25::BIGINT AS n, '42501' AS sqlstate"),
})


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    statement, _, parameters = STATEMENTS[name]
    return lambda spark, sf_dir: session(spark, sf_dir, statement).query(statement, parameters)


def _scripted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    run, _ = SCRIPTS[name]
    return lambda spark, sf_dir: run(session(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**{n: _statement(n) for n in STATEMENTS}, **{n: _scripted(n) for n in SCRIPTS}}


def oracle_sql() -> dict[str, str]:
    return {**{n: s[1] for n, s in STATEMENTS.items()}, **{n: s[1] for n, s in SCRIPTS.items() if s[1]}}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statement("q1_pricing_summary")(spark, sf_dir)
