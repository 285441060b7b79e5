"""The registered SQL queries: text in the dialect, and DuckDB's equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .session import Session

#: name: (dialect SQL, DuckDB SQL or None where the dialect's text serves both)
SQL: dict[str, tuple[str, str | None]] = {
    # scans and constructors
    "scan_filter_lineitem": ("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount >= 0.05", None),
    "index_lookup": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77", None),
    "table_stmt": ("TABLE region", "SELECT * FROM region"),
    "values_constructor": ("SELECT a, b FROM (VALUES (1, 'one'), (2, 'two'), (3, NULL)) AS v(a, b)", None),
    "derived_table_rename": ("SELECT k, n FROM (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1) AS x(k, n)", None),
    "correlation_names": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation AS b WHERE a.n_regionkey = b.n_nationkey AND a.n_nationkey < b.n_nationkey", None),
    "correlation_self_region": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation AS b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    # projection
    "project_arith": ("SELECT l_orderkey, l_linenumber, -l_quantity AS neg, l_extendedprice * (1 - l_discount) AS net, l_quantity + l_tax - 1 AS mixed FROM lineitem", None),
    "select_star_mixed": ("SELECT r.r_name AS first_name, r.* FROM region r", None),
    "select_distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "unnamed_columns": ("SELECT r_regionkey, r_regionkey + 1 FROM region", 'SELECT r_regionkey, r_regionkey + 1 AS "2" FROM region'),
    # predicates
    "pred_between": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 AND o_custkey NOT BETWEEN 10 AND 1000", None),
    "pred_like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e_%' AND p_type NOT LIKE 'S%'", None),
    "pred_like_escape": ("SELECT a FROM (VALUES ('50%'), ('500'), ('5_0')) AS v(a) WHERE a LIKE '5%!%' ESCAPE '!' OR a LIKE '5!_0' ESCAPE '!'", None),
    "pred_in_list": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3) AND n_nationkey NOT IN (2, 3, 4)", None),
    "pred_three_valued": ("SELECT l_linenumber, count(*) AS n FROM lineitem WHERE NOT (nullif(l_linenumber, 3) = 2) OR nullif(l_linenumber, 3) = 2 AND l_quantity > 10 GROUP BY l_linenumber", None),
    "pred_is_true": ("SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) = 2 IS TRUE", "SELECT count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3) = 2) IS TRUE"),
    "pred_is_false": ("SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) = 2 IS FALSE", "SELECT count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3) = 2) IS FALSE"),
    "pred_is_unknown": ("SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) = 2 IS UNKNOWN", "SELECT count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3) = 2) IS NULL"),
    "pred_is_not_unknown": ("SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) = 2 IS NOT UNKNOWN", "SELECT count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3) = 2) IS NOT NULL"),
    "pred_is_null_row": ("SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3), nullif(l_returnflag, 'R')) IS NULL GROUP BY l_linenumber, l_returnflag", "SELECT l_linenumber, l_returnflag, count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) IS NULL AND nullif(l_returnflag, 'R') IS NULL GROUP BY 1, 2"),
    "pred_row_compare": ("SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (2, 10) AND (n_regionkey, n_nationkey) <> (3, 6)", "SELECT n_nationkey FROM nation WHERE (n_regionkey > 2 OR n_regionkey = 2 AND n_nationkey > 10) AND NOT (n_regionkey = 3 AND n_nationkey = 6)"),
    "pred_row_subquery": ("SELECT * FROM nation WHERE (n_regionkey, n_nationkey) = (SELECT max(n_regionkey), max(n_nationkey) FROM nation WHERE n_regionkey = 3)", "SELECT * FROM nation WHERE n_regionkey = 3 AND n_nationkey = (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 3)"),
    "row_in_values": ("SELECT * FROM nation WHERE (n_regionkey, n_nationkey) IN (VALUES (0, 5), (1, 1), (4, 4))", "SELECT * FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 5), (1, 1), (4, 4))"),
    "in_row_values": ("SELECT * FROM nation WHERE (n_regionkey, n_nationkey) IN ((0, 5), (1, 1), (4, 4))", None),
    # subqueries and quantifiers
    "semi_in_subquery": ("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", None),
    "semi_exists": ("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT * FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "anti_not_in": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 20)", None),
    "anti_not_in_subset": ("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", None),
    "anti_not_in_null": ("SELECT count(*) AS n FROM part WHERE p_size NOT IN (SELECT nullif(l_linenumber, 3) FROM lineitem)", None),
    "quant_gt_all": ("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 40)", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT max(p_retailprice) FROM part WHERE p_size < 40)"),
    "quant_gt_all_small": ("SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 3)", "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT max(p_retailprice) FROM part WHERE p_size < 3)"),
    "quant_all_empty": ("SELECT count(*) AS n FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size < 0)", "SELECT count(*) AS n FROM part"),
    "quant_all_null": ("SELECT count(*) AS n FROM part WHERE (p_size >= ALL (SELECT nullif(l_linenumber, 3) FROM lineitem)) IS UNKNOWN", "SELECT count(*) AS n FROM part WHERE p_size >= (SELECT max(l_linenumber) FROM lineitem WHERE l_linenumber <> 3)"),
    "quant_lt_any": ("SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = c_nationkey)", "SELECT c_custkey FROM customer WHERE c_acctbal < (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey = c_nationkey)"),
    "quant_ne_any": ("SELECT r_regionkey FROM region WHERE r_regionkey <> SOME (SELECT n_regionkey FROM nation WHERE n_nationkey < 2)", "SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey < 2 AND n_regionkey <> r_regionkey)"),
    "quant_eq_all": ("SELECT r_regionkey FROM region WHERE r_regionkey = ALL (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)", "SELECT r_regionkey FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation WHERE n_nationkey = 0)"),
    "match_simple": ("SELECT count(*) AS n FROM lineitem WHERE nullif(l_linenumber, 3) MATCH (SELECT n_nationkey FROM nation WHERE n_nationkey < 3)", "SELECT count(*) AS n FROM lineitem WHERE l_linenumber = 3 OR l_linenumber IN (0, 1, 2)"),
    "match_partial": ("SELECT l_linenumber, l_quantity, count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3), l_quantity) MATCH PARTIAL (SELECT n_nationkey, 20 + n_nationkey FROM nation) GROUP BY l_linenumber, l_quantity", "SELECT l_linenumber, l_quantity, count(*) AS n FROM lineitem WHERE CASE WHEN l_linenumber = 3 THEN l_quantity BETWEEN 20 AND 44 AND l_quantity = floor(l_quantity) ELSE l_quantity = 20 + l_linenumber END GROUP BY 1, 2"),
    "match_full": ("SELECT l_linenumber, count(*) AS n FROM lineitem WHERE (nullif(l_linenumber, 3), nullif(l_linenumber, 3)) MATCH FULL (SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey < 3) GROUP BY l_linenumber", "SELECT l_linenumber, count(*) AS n FROM lineitem WHERE l_linenumber IN (1, 2, 3) GROUP BY 1"),
    "match_unique": ("SELECT n_nationkey FROM nation WHERE n_regionkey MATCH UNIQUE (SELECT n_regionkey FROM nation WHERE n_nationkey < 7)", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation WHERE n_nationkey < 7 GROUP BY 1 HAVING count(*) = 1)"),
    "unique_pred": ("SELECT r_regionkey FROM region WHERE UNIQUE (SELECT n_name FROM nation) AND NOT UNIQUE (SELECT n_regionkey FROM nation)", "SELECT r_regionkey FROM region"),
    "scalar_subquery": ("SELECT s_suppkey, s_acctbal > (SELECT avg(c_acctbal) FROM customer) AS above_customers, (SELECT max(c_acctbal) FROM customer) AS most, (SELECT count(*) FROM region) * 10 AS scaled FROM supplier WHERE s_acctbal > (SELECT min(c_acctbal) FROM customer) + 500", None),
    "correlated_max": ("SELECT c_custkey, c_nationkey FROM customer a WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = a.c_nationkey)", "SELECT c_custkey, c_nationkey FROM customer a WHERE c_acctbal = (SELECT max(b.c_acctbal) FROM customer b WHERE b.c_nationkey = a.c_nationkey)"),
    "correlated_two_levels": ("SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity = (SELECT max(l_quantity) FROM lineitem WHERE l_orderkey = o.o_orderkey) AND l.l_returnflag = 'R')", "SELECT o.o_orderkey, o.o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R' AND l.l_quantity = (SELECT max(m.l_quantity) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey))"),
    "correlated_count": ("SELECT s_suppkey, s_nationkey FROM supplier s WHERE (SELECT count(*) FROM customer WHERE c_nationkey = s.s_nationkey AND c_acctbal < 0) >= 2", None),
    # joins
    "join_comma": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_inner_on": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000", None),
    "join_inner_using": ("SELECT k, c_name, o_orderkey FROM (SELECT c_custkey, c_name FROM customer) AS c(k, c_name) JOIN (SELECT o_custkey, o_orderkey FROM orders) AS o(k, o_orderkey) USING (k)", None),
    "join_natural": ("SELECT * FROM (SELECT n_regionkey, n_name FROM nation) AS n(k, nation) NATURAL JOIN (SELECT r_regionkey, r_name FROM region) AS r(k, region)", None),
    "join_natural_left": ("SELECT * FROM (SELECT r_regionkey, r_name FROM region) AS r(k, region) NATURAL LEFT JOIN (SELECT n_regionkey, n_name FROM nation WHERE n_regionkey > 2) AS n(k, nation)", None),
    "join_cross_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a CROSS JOIN nation b WHERE a.n_nationkey + b.n_nationkey = 24 AND a.n_nationkey < b.n_nationkey", None),
    "join_left_on_extra_cond": ("SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    "join_right": ("SELECT s_suppkey, n_nationkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", None),
    "join_right_using": ("SELECT * FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15) AS a(k, x) RIGHT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 10) AS b(k, y) USING (k)", None),
    "join_left_using": ("SELECT * FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15) AS a(k, x) LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 10) AS b(k, y) USING (k)", None),
    "join_natural_full": ("SELECT * FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15) AS a(k, x) NATURAL FULL JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 10) AS b(k, y)", None),
    "join_full_on": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a FULL JOIN nation b ON a.n_nationkey = b.n_nationkey + 5", None),
    "join_full_using": ("SELECT * FROM (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 15) AS a(k, x) FULL OUTER JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 10) AS b(k, y) USING (k)", None),
    "join_union": ("SELECT * FROM region UNION JOIN (SELECT n_nationkey, n_name FROM nation) AS n", "SELECT r_regionkey, r_name, NULL::INTEGER AS n_nationkey, NULL::VARCHAR AS n_name FROM region UNION ALL SELECT NULL, NULL, n_nationkey, n_name FROM nation"),
    "join_self": ("SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", None),
    "join_bare": ("nation JOIN region ON n_regionkey = r_regionkey", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "join_parentheses": ("SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey AND r_regionkey = 2", None),
    "join_five_tables": ("SELECT r_name, count(*) AS n, sum(l_quantity) AS qty FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY r_name", None),
    # aggregation
    "agg_basic": ("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, avg(l_quantity) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_whole": ("SELECT count(*) AS n, sum(o_totalprice) AS total FROM orders WHERE o_orderkey < 0", None),
    "agg_empty_keyed": ("SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_custkey", None),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND sum(o_totalprice) > 1000", None),
    "agg_distinct": ("SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS l, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag", None),
    "agg_count_nulls": ("SELECT count(nullif(l_linenumber, 3)) AS n, count(*) AS every, CAST(sum(nullif(l_linenumber, 3)) AS BIGINT) AS s FROM lineitem", None),
    "agg_min_max_string_date": ("SELECT min(o_orderdate) AS d0, max(o_orderdate) AS d1, min(o_orderpriority) AS p0, max(o_orderpriority) AS p1 FROM orders", None),
    "agg_expression": ("SELECT l_returnflag, ROUND(sum(l_extendedprice * (1 - l_discount)) / count(*), 4) AS each_ FROM lineitem GROUP BY l_returnflag", None),
    "agg_any_column": ("SELECT n_regionkey, r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey HAVING count(*) > 1", "SELECT n_regionkey, any_value(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey HAVING count(*) > 1"),
    "agg_minus_correlated": ("SELECT o_orderpriority, max(o_totalprice) + (SELECT count(*) FROM nation) AS shifted, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING max(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)", None),
    "agg_beside_correlated": ("SELECT t.l_linenumber, sum(t.l_quantity) * (SELECT count(*) FROM region r WHERE r.r_regionkey < t.l_linenumber) AS weighted FROM lineitem t GROUP BY t.l_linenumber", None),
    "agg_null_group": ("SELECT nullif(l_linenumber, 3) AS k, count(*) AS n FROM lineitem GROUP BY nullif(l_linenumber, 3)", None),
    # order
    "sort_nulls": ("SELECT nullif(l_linenumber, 3) AS k, count(*) AS n FROM lineitem GROUP BY nullif(l_linenumber, 3) ORDER BY k DESC", None),
    "sort_ordinal": ("SELECT n_regionkey, n_name FROM nation ORDER BY 1 DESC, 2", None),
    "top_k": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    # set operations
    "union": ("SELECT n_regionkey FROM nation UNION SELECT l_linenumber FROM lineitem", None),
    "union_all": ("SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "except": ("SELECT l_linenumber FROM lineitem EXCEPT SELECT n_regionkey FROM nation", None),
    "except_all": ("SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region", None),
    "intersect": ("SELECT n_regionkey FROM nation INTERSECT SELECT l_linenumber FROM lineitem", None),
    "intersect_all": ("SELECT n_regionkey FROM nation INTERSECT ALL SELECT l_linenumber FROM lineitem", None),
    "set_precedence": ("SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation WHERE n_nationkey > 3 INTERSECT SELECT l_linenumber FROM lineitem EXCEPT SELECT 0 FROM region", None),
    "union_corresponding": ("SELECT n_nationkey AS k, n_name AS name FROM nation UNION CORRESPONDING SELECT r_name AS name, r_regionkey AS k FROM region", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region"),
    "except_corresponding": ("(SELECT n_nationkey AS k, n_name AS x FROM nation) EXCEPT CORRESPONDING (SELECT r_regionkey AS k, r_name AS y FROM region)", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region"),
    "intersect_corresponding_by": ("(SELECT n_nationkey AS k, n_name AS name FROM nation) INTERSECT CORRESPONDING BY (k) (SELECT r_regionkey AS k, r_name AS name FROM region)", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT r_regionkey FROM region"),
    # scalar functions
    "fn_trim": ("SELECT n_nationkey, TRIM(LEADING 'A' FROM n_name) AS a, TRIM(TRAILING 'A' FROM n_name) AS b, TRIM(BOTH 'A' FROM n_name) AS c, TRIM('  ' || n_name || ' ') || '.' AS d FROM nation", "SELECT n_nationkey, ltrim(n_name, 'A') AS a, rtrim(n_name, 'A') AS b, trim(n_name, 'A') AS c, trim('  ' || n_name || ' ') || '.' AS d FROM nation"),
    "fn_substring": ("SELECT p_partkey, SUBSTRING(p_name FROM 3 FOR 4) AS a, SUBSTRING(p_name FROM 5) AS b FROM part", None),
    "fn_position": ("SELECT p_partkey, POSITION('e' IN p_name) AS a, POSITION('' IN p_name) AS b FROM part", None),
    "fn_char_length": ("SELECT p_partkey, CHAR_LENGTH(p_name) AS a, CHARACTER_LENGTH(p_type || ' ') AS b FROM part", None),
    "fn_octet_length": ("SELECT doc_id, OCTET_LENGTH(text) AS n FROM documents", "SELECT doc_id, strlen(text) AS n FROM documents"),
    "fn_upper_lower": ("SELECT n_nationkey, UPPER(n_name) AS a, LOWER(n_name) AS b FROM nation", None),
    "fn_concat": ("SELECT n_name || ':' || CAST(n_nationkey AS VARCHAR(10)) AS a, n_name || NULL AS b FROM nation", None),
    "fn_cast": ("SELECT CAST(l_quantity AS INTEGER) AS a, CAST(l_linenumber AS VARCHAR(8)) AS b, CAST('2001-02-03' AS DATE) AS c, CAST(l_linenumber AS DOUBLE PRECISION) AS d FROM lineitem", None),
    "fn_cast_char": ("SELECT CAST(n_name AS CHAR(12)) || '.' AS a FROM nation", "SELECT rpad(n_name, 12, ' ') || '.' AS a FROM nation"),
    "fn_case_searched": ("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN o_custkey WHEN o_orderstatus IN ('O', 'P') THEN -o_custkey END AS signed FROM orders", None),
    "fn_case_simple": ("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END AS x FROM nation", None),
    "fn_nullif": ("SELECT n_nationkey, NULLIF(n_regionkey, 2) AS x FROM nation", None),
    "fn_coalesce": ("SELECT n_nationkey, COALESCE(NULLIF(n_regionkey, 2), n_nationkey * 100) AS x FROM nation", None),
    "fn_blob": ("SELECT OCTET_LENGTH(X'FF0000AABB') AS n, X'3D' || X'A7' = X'3DA7' AS same FROM region WHERE r_regionkey = 0", "SELECT 5 AS n, true AS same"),
    "fn_overlaps": ("SELECT o_orderkey FROM orders WHERE (CAST(o_orderdate AS DATE), DATE '1996-06-30') OVERLAPS (DATE '1996-03-01', DATE '1996-04-01')", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1996-04-01' AND DATE '1996-06-30' > DATE '1996-03-01'"),
    "quant_row_gt_any": ("SELECT n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > ANY (SELECT r_regionkey, r_regionkey * 3 FROM region WHERE r_regionkey > 1)", "SELECT n_nationkey FROM nation WHERE n_regionkey > 2 OR n_regionkey = 2 AND n_nationkey > 6"),
    "quant_row_le_all": ("SELECT s_suppkey FROM supplier WHERE (s_nationkey, s_suppkey) <= ALL (SELECT n_nationkey, n_nationkey * 2 FROM nation WHERE n_regionkey = 4)", "SELECT s_suppkey FROM supplier WHERE s_nationkey < 4 OR s_nationkey = 4 AND s_suppkey <= 8"),
    "derived_correlated_values": ("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = (SELECT v FROM (VALUES (nation.n_nationkey)) AS one(v))", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = n_nationkey"),
    "literals_temporal": ("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1997-02-01'", None),
    "fn_user_session": ("SELECT CURRENT_USER AS u, CURRENT_SCHEMA AS s, CURRENT_CATALOG AS c FROM region WHERE r_regionkey = 1", "SELECT 'DEFAULT' AS u, 'DEFAULT_SCHEMA' AS s, 'DB1' AS c"),
}

#: name: (statements run first, query, DuckDB SQL)
SCRIPTED: dict[str, tuple[str, str, str]] = {
    "view_expand": ("CREATE VIEW big(k, total) AS SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey", "SELECT k, ROUND(total, 2) AS total FROM big", "SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"),
    "dml_insert": ("CREATE TABLE t (k INTEGER NOT NULL PRIMARY KEY, name VARCHAR(30), size_ INTEGER DEFAULT 7); INSERT INTO t (k, name) SELECT n_nationkey, n_name FROM nation; INSERT INTO t VALUES (100, 'x', DEFAULT), (101, NULL, 1)", "SELECT * FROM t", "SELECT n_nationkey AS k, n_name AS name, 7 AS size_ FROM nation UNION ALL SELECT 100, 'x', 7 UNION ALL SELECT 101, NULL, 1"),
    "dml_default_values": ("CREATE TABLE t (a INTEGER DEFAULT 4, b VARCHAR(9) DEFAULT 'none', c INTEGER); INSERT INTO t DEFAULT VALUES; INSERT INTO t (c) VALUES (1); UPDATE t SET b = 'x' WHERE c = 1; UPDATE t SET b = DEFAULT WHERE c = 1", "SELECT a, b, c FROM t", "SELECT * FROM (VALUES (4, 'none', NULL), (4, 'none', 1)) AS v(a, b, c)"),
    "alter_table": ("CREATE TABLE t (k INTEGER PRIMARY KEY, gone INTEGER); INSERT INTO t SELECT r_regionkey, 1 FROM region; ALTER TABLE t ADD COLUMN added INTEGER DEFAULT 9; ALTER TABLE t DROP COLUMN gone RESTRICT; INSERT INTO t (k) VALUES (50)", "SELECT k, added FROM t WHERE k = 50", "SELECT 50 AS k, 9 AS added"),
    "dml_update": ("UPDATE customer SET c_acctbal = c_acctbal + 1000, c_mktsegment = 'NEW' WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", "SELECT c_custkey, CASE WHEN h THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, CASE WHEN h THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM (SELECT *, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS h FROM customer)"),
    "dml_delete": ("DELETE FROM supplier WHERE nullif(s_nationkey, 3) < 10", "SELECT s_suppkey FROM supplier", "SELECT s_suppkey FROM supplier WHERE (nullif(s_nationkey, 3) < 10) IS NOT TRUE"),
    "transaction_rollback": ("DELETE FROM nation WHERE n_regionkey = 1; COMMIT; DELETE FROM nation; ROLLBACK", "SELECT n_nationkey FROM nation", "SELECT n_nationkey FROM nation WHERE n_regionkey <> 1"),
    "fk_cascade_delete": ("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p (id) ON DELETE CASCADE); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id > 2", "SELECT id, pid FROM c", "SELECT n_nationkey AS id, n_regionkey AS pid FROM nation WHERE n_regionkey <= 2"),
    "fk_update_cascade_set_null": ("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER REFERENCES p (id) ON UPDATE CASCADE ON DELETE SET NULL); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; UPDATE p SET id = id + 100 WHERE id < 2; DELETE FROM p WHERE id = 3", "SELECT id, pid FROM c", "SELECT n_nationkey AS id, CASE WHEN n_regionkey < 2 THEN n_regionkey + 100 WHEN n_regionkey <> 3 THEN n_regionkey END AS pid FROM nation"),
    "fk_set_default": ("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER PRIMARY KEY, pid INTEGER DEFAULT 0 REFERENCES p (id) ON DELETE SET DEFAULT); INSERT INTO p SELECT r_regionkey FROM region; INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; DELETE FROM p WHERE id > 2", "SELECT id, pid FROM c", "SELECT n_nationkey AS id, CASE WHEN n_regionkey > 2 THEN 0 ELSE n_regionkey END AS pid FROM nation"),
    "udf_sql": ("CREATE FUNCTION net(p DOUBLE PRECISION, d DOUBLE PRECISION) RETURNS DOUBLE PRECISION RETURN p * (1 - d)", "SELECT l_orderkey, l_linenumber, net(l_extendedprice, l_discount) AS x FROM lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS x FROM lineitem"),
    "psm_loop": ("CREATE TABLE t (n INTEGER); CREATE PROCEDURE fill(IN top INTEGER) BEGIN DECLARE i INTEGER DEFAULT 0; WHILE i < top DO SET i = i + 1; IF i <> 2 THEN INSERT INTO t VALUES (i); END IF; END WHILE; END; CALL fill(4)", "SELECT n FROM t", "SELECT * FROM (VALUES (1), (3), (4)) AS v(n)"),
    "psm_cursor": ("CREATE TABLE t (n INTEGER, name VARCHAR(25)); CREATE PROCEDURE copy_regions() BEGIN DECLARE k INTEGER; DECLARE name VARCHAR(25); DECLARE c CURSOR FOR SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey; OPEN c; FETCH c INTO k, name; WHILE SQLSTATE <> '02000' DO INSERT INTO t VALUES (k * 10, name); FETCH c INTO k, name; END WHILE; CLOSE c; END; CALL copy_regions()", "SELECT n, name FROM t", "SELECT r_regionkey * 10 AS n, r_name AS name FROM region"),
    "sequences": ("CREATE SEQUENCE s STARTING AT 5; CREATE TABLE t (n INTEGER); INSERT INTO t VALUES (NEXT_SEQUENCE(s)), (NEXT_SEQUENCE(s)); INSERT INTO t VALUES (LATEST_SEQUENCE(s))", "SELECT n FROM t", "SELECT * FROM (VALUES (5), (6), (6)) AS v(n)"),
    "sequence_per_row": ("CREATE SEQUENCE q STARTING AT 100; CREATE TABLE t (k INTEGER PRIMARY KEY, seen INTEGER); INSERT INTO t SELECT NEXT_SEQUENCE(q), l_linenumber FROM lineitem", "SELECT count(*) AS n, count(DISTINCT k) AS keys, min(k) AS lo, max(k) AS hi, CAST(sum(seen) AS BIGINT) AS total FROM t", "SELECT count(*) AS n, count(*) AS keys, 100 AS lo, CAST(99 + count(*) AS INTEGER) AS hi, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem"),
    "sequence_default": ("CREATE SEQUENCE q STARTING AT 1; CREATE TABLE t (k INTEGER DEFAULT NEXT_SEQUENCE(q), name VARCHAR(25)); INSERT INTO t (name) SELECT n_name FROM nation; INSERT INTO t (name) VALUES ('last')", "SELECT count(DISTINCT k) AS keys, max(k) AS hi, count(name) AS n FROM t", "SELECT count(*) + 1 AS keys, CAST(count(*) + 1 AS INTEGER) AS hi, count(*) + 1 AS n FROM nation"),
    "udf_body": ("CREATE FUNCTION graded(price DOUBLE PRECISION, size_ INTEGER) RETURNS INTEGER BEGIN DECLARE step INTEGER DEFAULT 10; DECLARE out_ INTEGER; IF size_ > 25 THEN SET step = step * 2; ELSEIF size_ < 5 THEN RETURN 0; END IF; SET out_ = CAST(price AS INTEGER) / step; CASE WHEN out_ > 90 THEN RETURN 90; ELSE SET out_ = out_ + 1; END CASE; RETURN out_; END", "SELECT p_partkey, graded(p_retailprice, p_size) AS g FROM part", "SELECT p_partkey, CAST(CASE WHEN p_size < 5 THEN 0 WHEN q > 90 THEN 90 ELSE q + 1 END AS INTEGER) AS g FROM (SELECT *, CAST(trunc(trunc(p_retailprice) / CASE WHEN p_size > 25 THEN 20.0 ELSE 10.0 END) AS INTEGER) AS q FROM part)"),
    "grants_by_column": ("CREATE USER ann; GRANT SELECT (n_nationkey, n_name) ON nation TO ann; CONNECT TO 'db' USER 'ann'", "SELECT * FROM nation", "SELECT n_name, n_nationkey FROM nation"),
    "select_into": ("CREATE TABLE t (n INTEGER, name VARCHAR(25)); CREATE PROCEDURE pick(IN k INTEGER) BEGIN DECLARE r INTEGER; DECLARE x VARCHAR(25); SELECT n_regionkey, n_name INTO r, x FROM nation WHERE n_nationkey = k; INSERT INTO t VALUES (r, x); END; CALL pick(7); CALL pick(12)", "SELECT n, name FROM t", "SELECT n_regionkey AS n, n_name AS name FROM nation WHERE n_nationkey IN (7, 12)"),
    "cursor_scroll": ("CREATE TABLE t (n BIGINT); CREATE PROCEDURE ends() BEGIN DECLARE k BIGINT; DECLARE c SCROLL CURSOR FOR SELECT s_suppkey FROM supplier ORDER BY s_suppkey; OPEN c; FETCH LAST FROM c INTO k; INSERT INTO t VALUES (k); FETCH FIRST FROM c INTO k; INSERT INTO t VALUES (k); FETCH ABSOLUTE 3 FROM c INTO k; INSERT INTO t VALUES (k); FETCH PRIOR FROM c INTO k; INSERT INTO t VALUES (k); CLOSE c; END; CALL ends()", "SELECT n FROM t", "SELECT max(s_suppkey) AS n FROM supplier UNION ALL SELECT min(s_suppkey) FROM supplier UNION ALL (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 2) UNION ALL (SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 1)"),
    "deferred_constraint": ("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (id INTEGER, pid INTEGER CONSTRAINT later REFERENCES p (id) DEFERRABLE INITIALLY DEFERRED); INSERT INTO c SELECT n_nationkey, n_regionkey FROM nation; INSERT INTO p SELECT r_regionkey FROM region; SET CONSTRAINTS ALL IMMEDIATE; COMMIT", "SELECT id, pid FROM c", "SELECT n_nationkey AS id, n_regionkey AS pid FROM nation"),
    "information_schema_keys": ("CREATE TABLE p (id INTEGER PRIMARY KEY, code INTEGER UNIQUE); CREATE TABLE c (pid INTEGER CONSTRAINT up REFERENCES p (id) ON DELETE CASCADE)", "SELECT constraint_name, table_name, constraint_type FROM INFORMATION_SCHEMA.table_constraints", "SELECT * FROM (VALUES ('p_pk_1', 'p', 'PRIMARY KEY'), ('p_unique_2', 'p', 'UNIQUE'), ('up', 'c', 'FOREIGN KEY')) AS v(constraint_name, table_name, constraint_type)"),
    "system_tables": ("CREATE TABLE p (id INTEGER PRIMARY KEY); CREATE TABLE c (pid INTEGER CONSTRAINT up REFERENCES p (id) ON DELETE CASCADE)", "SELECT constraint_name, parent_or_child_table, table_name, column_name, FK_on_delete_action FROM (CATALOG_DEFINITION_SCHEMA.sysConstraint NATURAL JOIN CATALOG_DEFINITION_SCHEMA.sysConstraintColumn) JOIN (SELECT column_id, table_id, column_name FROM CATALOG_DEFINITION_SCHEMA.sysColumn) AS l USING (column_id) JOIN (SELECT table_id, table_name FROM CATALOG_DEFINITION_SCHEMA.sysTable) AS t USING (table_id) WHERE rule_type = 'FOREIGN KEY'", "SELECT * FROM (VALUES ('up', 'C', 'C', 'PID', 1), ('up', 'P', 'P', 'ID', 1)) AS v(constraint_name, parent_or_child_table, table_name, column_name, FK_on_delete_action)"),
    "domains": ("CREATE DOMAIN small AS INTEGER DEFAULT 3 CHECK (VALUE < 10); CREATE TABLE t (a small, b INTEGER); INSERT INTO t (b) VALUES (1), (2)", "SELECT a, b FROM t", "SELECT * FROM (VALUES (3, 1), (3, 2)) AS v(a, b)"),
    "information_schema": ("CREATE TABLE t (a INTEGER NOT NULL PRIMARY KEY, b VARCHAR(9))", "SELECT table_name, column_name, ordinal_position, is_nullable, data_type FROM INFORMATION_SCHEMA.columns WHERE table_name = 't'", "SELECT * FROM (VALUES ('t', 'a', 1, 'NO', 'INTEGER'), ('t', 'b', 2, 'YES', 'CHARACTER VARYING')) AS v(table_name, column_name, ordinal_position, is_nullable, data_type)"),
}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue by nation of customers: join, filter, group, having, order."""
    return Session(spark).load(folder, ["customer", "orders", "lineitem", "nation"]).query(FLAGSHIP)


FLAGSHIP = """
SELECT n_name, count(*) AS n_lines, ROUND(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND l_returnflag = 'R'
GROUP BY n_name HAVING count(*) > 1 ORDER BY revenue DESC
"""


def _fk_orphans(spark: SparkSession, folder: str) -> DataFrame:
    s = Session(spark).load(folder, ["nation", "region"])
    return s.violations("nation", {"kind": "fk", "cols": ["n_nationkey"], "ref": ("region",), "ref_cols": ["r_regionkey"], "match": "SIMPLE"}).select("n_nationkey")


def _check_violations(spark: SparkSession, folder: str) -> DataFrame:
    from .plans.parser import Parser

    s = Session(spark).load(folder, ["part"])
    return s.violations("part", {"kind": "check", "check": Parser("nullif(p_size, 7) < 40").expression()}).select("p_partkey", "p_size")


def _unique_violations(spark: SparkSession, folder: str) -> DataFrame:
    return Session(spark).load(folder, ["lineitem"]).violations("lineitem", {"kind": "unique", "cols": ["l_orderkey", "l_linenumber"]})


def _sql(text):
    return lambda spark, folder: Session(spark).load(folder).query(text)


def _scripted(script, text):
    def run(spark, folder):
        s = Session(spark).load(folder)
        s.run_script(script)
        return s.query(text)

    return run


def _parameters(spark: SparkSession, folder: str) -> DataFrame:
    return Session(spark).load(folder).execute("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", ("F", 200000))


QUERIES = {"parameters": _parameters, "flagship": flagship, "fk_orphans": _fk_orphans, "check_violations": _check_violations, "unique_violations": _unique_violations}
QUERIES |= {n: _sql(a) for n, (a, _) in SQL.items()} | {n: _scripted(a, b) for n, (a, b, _) in SCRIPTED.items()}

ORACLES = {
    "parameters": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
    "flagship": FLAGSHIP,
    "fk_orphans": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)",
    "check_violations": "SELECT p_partkey, p_size FROM part WHERE NOT (nullif(p_size, 7) < 40)",
    "unique_violations": "SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
}
ORACLES |= {n: b or a for n, (a, b) in SQL.items()} | {n: c for n, (_, _, c) in SCRIPTED.items()}
