"""Queries that are one SQL text, or a text for Spark and one for DuckDB where the dialects differ.

Every LIMIT is the operator under test and has a unique order; sums of prices go through DECIMAL, so that
neither order of addition nor rounding matters.
"""

from __future__ import annotations

#: The same text runs on both.
SAME: dict[str, str] = {
    "flagship_revenue": """
        SELECT n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS DOUBLE) AS revenue
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        WHERE l_discount > 2e-2 GROUP BY n_name HAVING sum(l_quantity) > 100 ORDER BY revenue DESC, n_name LIMIT 10""",
    # predicates
    "filter_cmp": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 1e5 AND o_totalprice < 2e5 AND o_orderstatus <> 'F'",
    "filter_bool3vl": "SELECT o_orderkey FROM orders WHERE NOT (NULLIF(o_orderpriority, '5-LOW') = '1-URGENT' OR o_orderstatus = 'P')",
    "filter_in": "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IN ('1-URGENT', '2-HIGH')",
    "filter_notin_null": "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH')",
    "filter_notin_list_null": "SELECT o_orderkey FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', NULL)",
    "filter_between": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal NOT BETWEEN 0e0 AND 5e3",
    "filter_is_null": "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NULL AND (o_totalprice > 1e5) IS TRUE",
    "filter_is_false": "SELECT o_orderkey FROM orders WHERE (NULLIF(o_orderpriority, '5-LOW') = '1-URGENT') IS FALSE",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_brand NOT LIKE 'Brand#1_'",
    "filter_like_escape": "SELECT p_partkey FROM part WHERE concat(p_size, '%') LIKE '1_!%' ESCAPE '!'",
    "filter_ilike": "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%Build%'",
    "filter_like_number": "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR(20)) LIKE '12%'",
    "filter_case": "SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 3e5 WHEN o_orderstatus = 'O' THEN o_totalprice < 1e5 END",
    "point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77",
    # projections
    "project_alias_expr": "SELECT l_orderkey, l_linenumber, l_quantity * 2.5e0 AS q, l_extendedprice - l_tax AS net, -l_discount AS d FROM lineitem",
    "project_star": "SELECT * FROM nation",
    "project_star_expr": "SELECT *, n_nationkey * 10 AS ten FROM nation",
    "project_table_star": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    # joins
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 2e5",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 4e5",
    "join_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'",
    "join_full": "SELECT n.n_nationkey, s.s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) n FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5e3) s ON n.n_nationkey = s.s_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_comma": "SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey",
    "join_self": "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_nonequi": "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_nationkey < b.r_regionkey",
    "join_compound": "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_extendedprice * 4e0 > o_totalprice",
    "join_3way": "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "join_using": "SELECT k, a.n_name, b.r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)",
    "join_null_keys": "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON NULLIF(c_custkey, 5) = NULLIF(o_custkey, 5)",
    "join_group": "SELECT c_mktsegment, count(o_orderkey) AS orders_n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment",
    "notin_null_aware": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT NULLIF(o_custkey, 5) FROM orders)",
    # aggregates
    "agg_global": "SELECT count(*) AS n, count(NULLIF(o_orderpriority, '5-LOW')) AS p, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders",
    "agg_empty_global": "SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
    "agg_empty_group": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus",
    "agg_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS q, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_multi_key": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus, o_orderpriority",
    "agg_expr_key": "SELECT o_orderkey % 7 AS k, upper(o_orderstatus) AS s, count(*) AS n FROM orders GROUP BY o_orderkey % 7, upper(o_orderstatus)",
    "agg_positional": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "agg_case_key": "SELECT CASE WHEN o_totalprice > 2e5 THEN 'big' ELSE 'small' END AS k, count(*) AS n FROM orders GROUP BY CASE WHEN o_totalprice > 2e5 THEN 'big' ELSE 'small' END",
    "agg_distinct": "SELECT count(DISTINCT o_custkey) AS c, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s, min(DISTINCT o_orderstatus) AS m FROM orders",
    "agg_distinct_group": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS c, count(DISTINCT NULLIF(o_orderpriority, '5-LOW')) AS p FROM orders GROUP BY o_orderstatus",
    "agg_having_unselected": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 14 AND max(o_totalprice) > 4e5",
    "agg_arith": "SELECT o_orderstatus, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS mean FROM orders GROUP BY o_orderstatus",
    "agg_case_over": "SELECT o_orderstatus, CASE WHEN count(*) > 5000 THEN 'many' ELSE 'few' END AS size FROM orders GROUP BY o_orderstatus",
    "agg_null_group": "SELECT NULLIF(o_orderpriority, '5-LOW') AS p, count(*) AS n FROM orders GROUP BY NULLIF(o_orderpriority, '5-LOW')",
    "agg_conditional": "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_custkey",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "select_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "distinct_null": "SELECT DISTINCT NULLIF(o_orderpriority, '5-LOW') AS p FROM orders",
    "distinct_limit": "SELECT DISTINCT p_brand FROM part ORDER BY p_brand LIMIT 5",
    # sort and limit
    "sort_multi_nulls": "SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY NULLIF(o_orderpriority, '5-LOW') DESC NULLS LAST, o_orderkey LIMIT 50",
    "sort_nulls_first": "SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY NULLIF(o_orderpriority, '5-LOW') ASC NULLS FIRST, o_orderkey DESC LIMIT 50",
    "sort_expr": "SELECT o_orderkey FROM orders ORDER BY o_totalprice % 1000 DESC, o_orderkey LIMIT 20",
    "sort_position": "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY 1 DESC, 2 LIMIT 20",
    "sort_unselected": "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "topk_aggregate": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10",
    # set operations
    "union_distinct": "SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "union_all": "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "intersect_distinct": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_paren": "(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 3) UNION ALL (SELECT r_regionkey FROM region ORDER BY r_regionkey DESC LIMIT 2)",
    "setop_precedence": "SELECT 1 AS v UNION SELECT n_nationkey FROM nation WHERE n_nationkey < 3 INTERSECT SELECT 2",
    "setop_order_limit": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier ORDER BY k DESC LIMIT 7",
    "setop_null": "SELECT NULLIF(o_orderpriority, '5-LOW') AS p FROM orders INTERSECT SELECT NULLIF(o_orderpriority, '5-LOW') FROM orders WHERE o_orderstatus = 'P'",
    # subqueries
    "sub_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9e0 FROM orders)",
    "sub_scalar_empty": "SELECT n_nationkey, (SELECT max(r_regionkey) FROM region WHERE r_name = 'NOWHERE') AS m FROM nation",
    "sub_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 4.5e5)",
    "sub_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1e5)",
    "sub_in_empty": "SELECT n_nationkey FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99)",
    "sub_not_in_empty": "SELECT n_nationkey FROM nation WHERE NULLIF(n_nationkey, 3) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 99)",
    "sub_exists": "SELECT n_nationkey FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 9e3)",
    "sub_exists_correlated": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "sub_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sub_nested": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))",
    "sub_in_having": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus HAVING count(*) > (SELECT count(*) FROM customer)",
    "sub_setop_body": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal > 9e3)",
    "sub_row_value": "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_totalprice) IN (SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey)",
    "sub_derived": "SELECT k, count(*) AS n FROM (SELECT o_custkey % 10 AS k FROM orders WHERE o_orderstatus = 'F') t GROUP BY k",
    "cte_window": "WITH t AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) SELECT o_custkey, o_orderkey FROM t WHERE r <= 2",
    "sub_any_lt": "SELECT n_nationkey FROM nation WHERE n_nationkey < ANY (SELECT r_regionkey FROM region)",
    "sub_any_eq": "SELECT n_nationkey FROM nation WHERE n_nationkey = ANY (SELECT NULLIF(r_regionkey, 2) FROM region)",
    "sub_any_ne": "SELECT n_nationkey FROM nation WHERE n_nationkey <> ANY (SELECT r_regionkey FROM region WHERE r_regionkey = 3)",
    "sub_any_null": "SELECT n_nationkey FROM nation WHERE NOT (n_nationkey + 1 >= ANY (SELECT NULLIF(r_regionkey, 0) FROM region))",
    "sub_all_gt": "SELECT n_nationkey FROM nation WHERE n_nationkey > ALL (SELECT r_regionkey FROM region)",
    "sub_all_ne": "SELECT n_nationkey FROM nation WHERE n_nationkey <> ALL (SELECT r_regionkey FROM region)",
    "sub_all_empty": "SELECT n_nationkey FROM nation WHERE n_nationkey >= ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99)",
    "sub_all_eq": "SELECT n_nationkey FROM nation WHERE n_nationkey = ALL (SELECT r_regionkey FROM region WHERE r_regionkey = 4)",
    # functions
    "fn_null": "SELECT o_orderkey, COALESCE(NULLIF(o_orderpriority, '5-LOW'), 'none') AS p, NULLIF(o_orderstatus, 'F') AS s FROM orders",
    "fn_case_fold": "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l FROM part",
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'S' WHEN p_size < 30 THEN 'M' END AS c FROM part",
    "case_simple": "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1 WHEN 'SMALL' THEN 2 ELSE 0 END AS c FROM part",
    "case_nested": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_totalprice > 2e5 THEN 'FB' ELSE 'FS' END ELSE 'X' END AS c FROM orders",
    "fn_abs": "SELECT s_suppkey, abs(s_acctbal - 5e3) AS a FROM supplier",
    # warehouse verification on stand-in tables: orders as observations, conversations as threads
    "wh_series_counts": "SELECT c_mktsegment, count(*) AS observation_count FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY c_mktsegment",
    "wh_dupes": "SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "wh_types": "SELECT role, count(*) AS n FROM conversations GROUP BY role",
    "wh_count_kind": "SELECT count(*) AS story_count FROM conversations WHERE role = 'user'",
    "wh_top": "SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id ORDER BY turns DESC, conv_id LIMIT 10",
    "wh_orphans": "SELECT count(*) AS orphan_count FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "wh_authors": "SELECT count(DISTINCT NULLIF(user_id, 3)) AS unique_authors FROM events WHERE NULLIF(user_id, 3) IS NOT NULL",
    "wh_null_audit": "SELECT 'orders' AS table_name, CAST(sum(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_key, CAST(sum(CASE WHEN NULLIF(o_orderpriority, '5-LOW') IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_priority FROM orders",
    "wh_keyword": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (lower(text) LIKE '%tion %' OR lower(text) LIKE '%ment%') ORDER BY conv_id DESC, turn LIMIT 5",
}

#: Spark's text and DuckDB's.
PAIRS: dict[str, tuple[str, str]] = {
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT'", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"),
    "join_key_coercion": ("SELECT n_name, t.s FROM nation JOIN (SELECT CAST(r_regionkey AS STRING) AS s FROM region UNION ALL SELECT 'abc') t ON n_nationkey = try_cast(t.s AS BIGINT)", "SELECT n_name, t.s FROM nation JOIN (SELECT CAST(r_regionkey AS VARCHAR) AS s FROM region UNION ALL SELECT 'abc') t ON n_nationkey = try_cast(t.s AS BIGINT)"),
    "div_zero": ("SELECT l_orderkey, l_linenumber, try_divide(l_quantity, l_discount) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS q FROM lineitem"),
    "fn_length": ("SELECT p_partkey, CAST(char_length(p_name) AS BIGINT) AS n FROM part", "SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n FROM part"),
    "fn_concat": ("SELECT p_partkey, p_name || '-' || CAST(p_size AS STRING) AS c, concat(p_brand, NULLIF(p_type, 'PROMO')) AS d FROM part", "SELECT p_partkey, p_name || '-' || CAST(p_size AS VARCHAR) AS c, p_brand || NULLIF(p_type, 'PROMO') AS d FROM part"),
    "fn_epoch": ("SELECT event_id, date_format(timestamp_seconds(1700000000 + event_id * 3600), 'yyyy-MM-dd HH') AS h FROM events", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id * 3600) * 1000000), '%Y-%m-%d %H') AS h FROM events"),
    "wh_span_years": ("SELECT o_custkey, CAST(year(max(o_orderdate)) - year(min(o_orderdate)) AS BIGINT) AS years_of_data FROM orders GROUP BY o_custkey", "SELECT o_custkey, date_diff('year', min(o_orderdate), max(o_orderdate)) AS years_of_data FROM orders GROUP BY o_custkey"),
    "wh_latest_per_group": ("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey)",) * 2,
    "wh_date_cutoff": ("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= date_sub(DATE '2001-01-01', 2 * 365)", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '2001-01-01' - 2 * 365"),
    "an_trend_line": ("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",) * 2,
    "an_value_counts": ("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10",) * 2,
    "an_hist": ("SELECT width_bucket(o_totalprice, 0e0, 5e5, 20) AS bin, count(*) AS n FROM orders GROUP BY 1", "SELECT CAST(CASE WHEN o_totalprice < 0 THEN 0 WHEN o_totalprice >= 5e5 THEN 21 ELSE floor(o_totalprice / 5e5 * 20) + 1 END AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1"),
    "an_author_mix": ("SELECT user_id, count_if(event_type = 'view') AS views, count_if(event_type = 'purchase') AS buys FROM events GROUP BY user_id", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS buys FROM events GROUP BY user_id"),
    "an_kpis": ("SELECT round(avg(value), 6) AS mean, max(value) AS hi, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events",) * 2,
    "props_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "kids_posexplode": ("SELECT vec_id, pos AS position, CAST(round(CAST(x AS DOUBLE) * 1000000) AS BIGINT) AS micro FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, x", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS position, CAST(round(CAST(embedding[i] AS DOUBLE) * 1000000) AS BIGINT) AS micro FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)"),
    "wh_thread_depth2": (
        "WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey < 200 THEN NULL ELSE o_custkey END AS parent FROM orders), d AS (SELECT parent AS root, id FROM c WHERE parent IS NOT NULL UNION SELECT p.parent AS root, k.id FROM c k JOIN c p ON k.parent = p.id WHERE p.parent IS NOT NULL) SELECT s.id AS story_id, count(d.id) AS n FROM c s LEFT JOIN d ON d.root = s.id WHERE s.parent IS NULL GROUP BY s.id HAVING count(d.id) > 0",
    ) * 2,
}
