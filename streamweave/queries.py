"""One query for each operator over the shared tables, and the DuckDB SQL that gives the same rows.

Doubles that are computed are rounded to six places on both sides: sums of doubles depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.joins import concat
from .plans.chain import chain
from .plans.stream import Stream, col
from .sources.writers import render

#: The row order of each table.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> Stream:
    return Stream.of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), *KEYS[name])


def shown(s: Stream) -> DataFrame:
    """The rows, with doubles rounded to six places."""
    return s.rows().select(*[F.round(col(n), 6).alias(n) if t == "double" else col(n) for n, t in s.rows().dtypes])


def query(name: str, source: str, links: str, sql: str | None = None, before: Callable | None = None, **others: str) -> None:
    """A chain over a table; ``others``: tables that the chain joins by name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = table(spark, sf_dir, source)
        if before:
            s = before(s)
        return shown(chain(s, links, **{k: table(spark, sf_dir, t) for k, t in others.items()}))

    QUERIES[name] = run
    if sql:
        SQL[name] = " ".join(sql.split())


def cut(*names: str) -> Callable:
    return lambda s: s.select(names)


def gaps(s: Stream) -> Stream:
    """Orders with a status that is empty for every third and absent for every fifth key."""
    k = col("o_orderkey")
    return s.select(["o_orderkey", F.when(k % 5 == 0, None).when(k % 3 == 0, "").otherwise(col("o_orderstatus")).alias("st"), "o_totalprice"])


_GAPS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS st, o_totalprice FROM orders)"
_L = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount FROM lineitem)"
_LCUT = cut("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")

# ---- projection and naming
query("cat_counter", "nation", "cat -n", "SELECT row_number() OVER (ORDER BY n_nationkey) AS n, * FROM nation")
query("cat_counter_group", "orders", "cut -f o_orderkey,o_orderstatus then cat -N idx -g o_orderstatus", "SELECT row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS idx, o_orderkey, o_orderstatus FROM orders")
query("cut_keep", "customer", "cut -f c_name,c_custkey", "SELECT c_custkey, c_name FROM customer")
query("cut_ordered", "customer", "cut -o -f c_name,c_custkey", "SELECT c_name, c_custkey FROM customer")
query("cut_complement", "customer", "cut -x -f c_name,c_acctbal", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
query("cut_regex", "part", "cut -r -f ^p_.*e$", "SELECT p_name, p_type, p_size, p_retailprice FROM part")
query("label_first", "nation", "label key,name", "SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation")
query("rename_pairs", "region", "rename r_regionkey,id,r_name,name", "SELECT r_regionkey AS id, r_name AS name FROM region")
query("rename_regex", "supplier", "rename -r '^s_(.*)$,sup_\\1'", "SELECT s_suppkey AS sup_suppkey, s_name AS sup_name, s_nationkey AS sup_nationkey, s_acctbal AS sup_acctbal FROM supplier")
query("rename_gsub", "supplier", "rename -g -r 's,z'", "SELECT s_suppkey AS z_zuppkey, s_name AS z_name, s_nationkey AS z_nationkey, s_acctbal AS z_acctbal FROM supplier")
query("reorder_end", "nation", "reorder -e -f n_nationkey", "SELECT n_name, n_regionkey, n_nationkey FROM nation")
query("sort_within_records", "customer", "sort-within-records", "SELECT c_acctbal, c_custkey, c_mktsegment, c_name, c_nationkey FROM customer")
query("template_fill", "region", "template -f r_name,extra,r_regionkey --fill-with none", "SELECT r_name, 'none' AS extra, r_regionkey FROM region")
query("regularize", "region", "regularize", "SELECT * FROM region")
query("group_like", "region", "group-like", "SELECT * FROM region")
query("unsparsify", "orders", "unsparsify --fill-with X", f"SELECT o_orderkey, coalesce(st, 'X') AS st, o_totalprice FROM {_GAPS}", gaps)
query("sparsify", "orders", "sparsify -f st", f"SELECT o_orderkey, nullif(st, '') AS st, o_totalprice FROM {_GAPS}", gaps)
query("fill_empty", "orders", "fill-empty -v none", f"SELECT o_orderkey, CASE WHEN st = '' THEN 'none' ELSE st END AS st, o_totalprice FROM {_GAPS}", gaps)
query("remove_empty_columns", "region", "remove-empty-columns", "SELECT r_regionkey, r_name FROM region", lambda s: s.with_columns({"blank": F.lit("")}))

# ---- filters
query("head_n", "orders", "cut -f o_orderkey,o_totalprice then head -n 7", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 7")
query("head_group", "orders", "cut -f o_orderkey,o_orderpriority then head -n 3 -g o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 3")
query("tail_group", "orders", "cut -f o_orderkey,o_orderpriority then tail -n 3 -g o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) <= 3")
query("tail_from", "orders", "cut -f o_orderkey then tail -n +100", "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey) >= 100")
query("decimate", "orders", "cut -f o_orderkey,o_orderstatus then decimate -n 10 -g o_orderstatus", "SELECT o_orderkey, o_orderstatus FROM orders QUALIFY (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 10 = 9")
query("grep_text", "customer", "cut -f c_custkey,c_mktsegment then grep -i 'mktsegment=b'", "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches('c_custkey=' || c_custkey || ',c_mktsegment=' || c_mktsegment, '(?i)mktsegment=b')")
query("having_fields", "orders", "having-fields --at-least st", f"SELECT * FROM {_GAPS} WHERE st IS NOT NULL", gaps)
query("skip_trivial_records", "orders", "cut -f st then skip-trivial-records", f"SELECT st FROM {_GAPS} WHERE st IS NOT NULL AND st <> ''", gaps)
query("nothing", "region", "nothing", "SELECT * FROM region WHERE false")
query("filter_expression", "lineitem", "filter '$l_quantity > 45 && $l_returnflag == \"R\"' then cut -f l_orderkey,l_linenumber,l_quantity", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")

# ---- sorting and order
query("sort_numeric_top", "orders", "cut -f o_orderkey,o_totalprice then sort -nr o_totalprice -f o_orderkey then head -n 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20")
query("sort_lexical_top", "customer", "cut -f c_custkey,c_name,c_mktsegment then sort -f c_mktsegment -nr c_custkey then head -n 15", "SELECT c_custkey, c_name, c_mktsegment FROM customer ORDER BY c_mktsegment, c_custkey DESC LIMIT 15")
query("sort_natural_top", "customer", "cut -f c_name then sort -tr c_name then head -n 12", "SELECT c_name FROM customer ORDER BY CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) DESC LIMIT 12")
query("tac_head", "orders", "cut -f o_orderkey,o_custkey then tac then head -n 9", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 9")
query("group_by_order", "orders", "cut -f o_orderkey,o_orderstatus then group-by o_orderstatus then cat -n then head -n 50", """SELECT row_number() OVER (ORDER BY f, o_orderkey) AS n, o_orderkey, o_orderstatus FROM
  (SELECT o_orderkey, o_orderstatus, min(o_orderkey) OVER (PARTITION BY o_orderstatus) AS f FROM orders) QUALIFY n <= 50""")

# ---- counting
query("count_all", "lineitem", "count", "SELECT count(*) AS count FROM lineitem")
query("count_group", "lineitem", "count -g l_returnflag,l_linestatus -o n", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
query("count_groups", "lineitem", "count -n -g l_returnflag,l_linestatus", "SELECT count(*) AS count FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
query("count_distinct", "orders", "count-distinct -f o_orderstatus,o_orderpriority", "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL")
query("count_distinct_unlashed", "orders", "count-distinct -u -f o_orderstatus,o_orderpriority", """SELECT 'o_orderstatus' AS field, o_orderstatus AS value, count(*) AS count FROM orders GROUP BY ALL
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
query("count_similar", "nation", "count-similar -g n_regionkey -o size", "SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS size FROM nation")
query("uniq_group_count", "events", "uniq -g event_type -c", "SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
query("uniq_all_count", "nation", "cut -f n_regionkey then uniq -a -c", "SELECT count(*) AS count, n_regionkey FROM nation GROUP BY ALL")
query("uniq_all_number", "orders", "cut -f o_custkey then uniq -a -n", "SELECT count(DISTINCT o_custkey) AS count FROM orders")
query("most_frequent", "events", "most-frequent -f user_id -n 5", "SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, min(event_id) LIMIT 5")
query("least_frequent", "events", "least-frequent -f user_id -n 5", "SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count, min(event_id) LIMIT 5")

# ---- statistics
query("stats1_basic", "lineitem", "stats1 -a count,sum,mean,min,max -f l_quantity,l_extendedprice -g l_returnflag,l_linestatus", """SELECT l_returnflag, l_linestatus,
  count(l_quantity) AS l_quantity_count, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
  count(l_extendedprice) AS l_extendedprice_count, round(sum(l_extendedprice), 6) AS l_extendedprice_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean,
  min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max FROM lineitem GROUP BY ALL""")
_M = "avg(l_quantity)"
query("stats1_moments", "lineitem", "stats1 -a var,stddev,meaneb,skewness,kurtosis -f l_quantity -g l_returnflag", f"""SELECT l_returnflag, round(var_samp(l_quantity), 6) AS l_quantity_var,
  round(stddev_samp(l_quantity), 6) AS l_quantity_stddev, round(sqrt(var_samp(l_quantity) / count(*)), 6) AS l_quantity_meaneb,
  round((avg(l_quantity ** 3) - 3 * {_M} * avg(l_quantity ** 2) + 2 * {_M} ** 3) / var_samp(l_quantity) ** 1.5, 6) AS l_quantity_skewness,
  round(kurtosis_pop(l_quantity), 6) AS l_quantity_kurtosis FROM lineitem GROUP BY ALL""")
query("stats1_percentiles", "lineitem", "stats1 -a p10,p50,median,p90,p100 -f l_extendedprice -g l_returnflag", """WITH s AS (SELECT l_returnflag, list_sort(list(l_extendedprice)) AS v FROM lineitem GROUP BY ALL)
  SELECT l_returnflag, v[least(floor(0.1 * len(v)), len(v) - 1)::INT + 1] AS l_extendedprice_p10, v[least(floor(0.5 * len(v)), len(v) - 1)::INT + 1] AS l_extendedprice_p50,
  v[least(floor(0.5 * len(v)), len(v) - 1)::INT + 1] AS l_extendedprice_median, v[least(floor(0.9 * len(v)), len(v) - 1)::INT + 1] AS l_extendedprice_p90, v[len(v)] AS l_extendedprice_p100 FROM s""")
query("stats1_interpolated", "lineitem", "stats1 -i -a p25,p75 -f l_extendedprice -g l_linestatus", """SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.25), 6) AS l_extendedprice_p25,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS l_extendedprice_p75 FROM lineitem GROUP BY ALL""")
query("stats1_modes", "part", "stats1 -a mode,antimode,distinct_count,null_count,minlen,maxlen -f p_brand -g p_size", """WITH c AS (SELECT p_size, p_brand, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL),
  m AS (SELECT p_size, first(p_brand ORDER BY n DESC, f) AS p_brand_mode, first(p_brand ORDER BY n, f) AS p_brand_antimode, count(*) AS p_brand_distinct_count FROM c GROUP BY ALL)
  SELECT m.*, 0::BIGINT AS p_brand_null_count, l.a AS p_brand_minlen, l.z AS p_brand_maxlen FROM m JOIN (SELECT p_size, min(length(p_brand)) AS a, max(length(p_brand)) AS z FROM part GROUP BY ALL) l USING (p_size)""")
query("stats1_mad", "lineitem", "stats1 -a mad -f l_quantity -g l_returnflag", """SELECT l_returnflag, round(avg(abs(l_quantity - m)), 6) AS l_quantity_mad FROM
  (SELECT l_returnflag, l_quantity, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) GROUP BY ALL""")
query("stats1_window", "events", "cut -f event_id,user_id,value then stats1 -w 3 -a mean,max,count -f value -g user_id", """SELECT event_id, user_id, round(value, 6) AS value, round(avg(value) OVER w, 6) AS value_mean, round(max(value) OVER w, 6) AS value_max, count(value) OVER w AS value_count
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
query("stats1_regex_fields", "lineitem", "stats1 -a max --fr '^l_(tax|disc)' -g l_linestatus", "SELECT l_linestatus, max(l_discount) AS l_discount_max, max(l_tax) AS l_tax_max FROM lineitem GROUP BY ALL")
query("stats2_ols", "lineitem", "stats2 -a linreg-ols,r2,corr,cov -f l_quantity,l_extendedprice -g l_returnflag", """SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS l_quantity_l_extendedprice_ols_m,
  round(regr_intercept(l_extendedprice, l_quantity), 6) AS l_quantity_l_extendedprice_ols_b, count(*) AS l_quantity_l_extendedprice_ols_n, round(regr_r2(l_extendedprice, l_quantity), 6) AS l_quantity_l_extendedprice_r2,
  round(corr(l_quantity, l_extendedprice), 6) AS l_quantity_l_extendedprice_corr, round(covar_samp(l_quantity, l_extendedprice), 6) AS l_quantity_l_extendedprice_cov FROM lineitem GROUP BY ALL""")
query("stats2_covx", "lineitem", "stats2 -a covx -f l_discount,l_tax", """SELECT round(var_samp(l_discount), 6) AS l_discount_l_tax_xvar, round(covar_samp(l_discount, l_tax), 6) AS l_discount_l_tax_xycov,
  round(covar_samp(l_discount, l_tax), 6) AS l_discount_l_tax_yxcov, round(var_samp(l_tax), 6) AS l_discount_l_tax_yvar FROM lineitem""")
query("stats2_fit", "lineitem", "stats2 --fit -a linreg-ols -f l_quantity,l_extendedprice -g l_returnflag then cut -f l_orderkey,l_linenumber,l_quantity_l_extendedprice_ols_fit", """SELECT l_orderkey, l_linenumber,
  round(m * l_quantity + b, 6) AS l_quantity_l_extendedprice_ols_fit FROM lineitem JOIN (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS m, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem GROUP BY ALL) USING (l_returnflag)""")
query("stats2_pca", "lineitem", "stats2 -a linreg-pca -f l_discount,l_tax", """WITH c AS (SELECT var_samp(l_discount) AS a, covar_samp(l_discount, l_tax) AS b, var_samp(l_tax) AS c, avg(l_discount) AS mx, avg(l_tax) AS my, count(*) AS n FROM lineitem),
  e AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM c)
  SELECT round(b / (l1 - c), 6) AS l_discount_l_tax_pca_m, round(my - b / (l1 - c) * mx, 6) AS l_discount_l_tax_pca_b, n AS l_discount_l_tax_pca_n, round(least(abs(l1), abs(l2)) / greatest(abs(l1), abs(l2)), 6) AS l_discount_l_tax_pca_quality FROM e""")
query("stats2_logireg", "labels", "stats2 -a logireg -f doc_id,quality")
query("merge_fields", "lineitem", "cut -f l_orderkey,l_linenumber,l_discount,l_tax then merge-fields -k -a sum,max,count -f l_discount,l_tax -o ab", """SELECT l_orderkey, l_linenumber, l_discount, l_tax, round(l_discount + l_tax, 6) AS ab_sum, greatest(l_discount, l_tax) AS ab_max, 2::BIGINT AS ab_count FROM lineitem""")
query("merge_fields_collapse", "lineitem", "cut -f l_orderkey,l_linenumber,l_discount,l_tax then merge-fields -a sum,min -c _discount,_tax", "SELECT l_orderkey, l_linenumber, round(l_discount + l_tax, 6) AS l_sum, least(l_discount, l_tax) AS l_min FROM lineitem")
query("histogram", "lineitem", "histogram -f l_discount,l_tax --lo 0 --hi 0.1 --nbins 5", """SELECT round(b * 0.02::DOUBLE, 6) AS bin_lo, round((b + 1) * 0.02::DOUBLE, 6) AS bin_hi,
  (SELECT count(*) FROM lineitem WHERE CASE WHEN l_discount = 0.1 THEN 4 WHEN l_discount >= 0 AND l_discount < 0.1 THEN least(floor(l_discount * (5 / 0.1::DOUBLE)), 4) END = b) AS l_discount_count,
  (SELECT count(*) FROM lineitem WHERE CASE WHEN l_tax = 0.1 THEN 4 WHEN l_tax >= 0 AND l_tax < 0.1 THEN least(floor(l_tax * (5 / 0.1::DOUBLE)), 4) END = b) AS l_tax_count FROM range(5) t(b)""")
query("histogram_auto", "orders", "histogram -f o_totalprice --auto --nbins 4", """WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), b AS (SELECT CASE WHEN o_totalprice = hi THEN 3 ELSE least(floor((o_totalprice - lo) * (4 / (hi - lo))), 3) END AS b, count(*) AS n FROM orders, m GROUP BY ALL)
  SELECT round(lo + i * ((hi - lo) / 4), 6) AS bin_lo, round(lo + (i + 1) * ((hi - lo) / 4), 6) AS bin_hi, coalesce(n, 0) AS o_totalprice_count FROM range(4) t(i) LEFT JOIN b ON b.b = t.i, m""")
query("top_group", "orders", "top -n 3 -f o_totalprice -g o_orderpriority", "SELECT o_orderpriority, row_number() OVER w AS top_idx, round(o_totalprice, 6) AS o_totalprice_top FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) QUALIFY top_idx <= 3")
query("top_min_whole", "orders", "cut -f o_orderkey,o_orderstatus,o_totalprice then top -n 2 --min -f o_totalprice -g o_orderstatus -a", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) <= 2")
query("summary", "nation", "summary -a count,null_count,distinct_count,minlen,maxlen", """SELECT 'n_nationkey' AS field_name, count(n_nationkey)::VARCHAR AS count, '0' AS null_count, count(DISTINCT n_nationkey)::VARCHAR AS distinct_count, min(length(n_nationkey::VARCHAR))::VARCHAR AS minlen, max(length(n_nationkey::VARCHAR))::VARCHAR AS maxlen FROM nation
  UNION ALL SELECT 'n_name', count(n_name)::VARCHAR, '0', count(DISTINCT n_name)::VARCHAR, min(length(n_name))::VARCHAR, max(length(n_name))::VARCHAR FROM nation
  UNION ALL SELECT 'n_regionkey', count(n_regionkey)::VARCHAR, '0', count(DISTINCT n_regionkey)::VARCHAR, min(length(n_regionkey::VARCHAR))::VARCHAR, max(length(n_regionkey::VARCHAR))::VARCHAR FROM nation""")
query("describe", "nation", "describe -n 5 then cut -f field_name,count,null_count,distinct_count,min,max", """SELECT 'n_nationkey' AS field_name, count(*) AS count, 0::BIGINT AS null_count, count(DISTINCT n_nationkey) AS distinct_count, min(n_nationkey)::VARCHAR AS min, max(n_nationkey)::VARCHAR AS max FROM nation
  UNION ALL SELECT 'n_name', count(*), 0, count(DISTINCT n_name), min(n_name), max(n_name) FROM nation UNION ALL SELECT 'n_regionkey', count(*), 0, count(DISTINCT n_regionkey), min(n_regionkey)::VARCHAR, max(n_regionkey)::VARCHAR FROM nation""")
query("surv", "orders", "put '$d = int($o_totalprice / 20000); $s = $o_orderstatus == \"F\" ? 1 : 0' then surv -d d -s s", """WITH t AS (SELECT CAST(trunc(o_totalprice / 20000) AS BIGINT) AS time, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS e, count(*) AS n FROM orders GROUP BY ALL),
  r AS (SELECT time, e, sum(n) OVER (ORDER BY time DESC) AS r FROM t), k AS (SELECT time, e, product(1 - e / r) OVER (ORDER BY time) AS s FROM r) SELECT time, round(s, 6) AS survival FROM k WHERE e > 0""")
query("sparkline", "region", "sparkline -f r_regionkey", "SELECT 'r_regionkey' AS field, 5::BIGINT AS n, 0.0::DOUBLE AS lo, 4.0::DOUBLE AS hi, '▁▃▅▇█' AS sparkline")
query("bootstrap_ci", "orders", "bootstrap-ci -a mean,median -f o_totalprice -g o_orderstatus -n 100 --seed 3")

# ---- neighbours
query("step_steppers", "events", "cut -f event_id,user_id,value then step -a delta,shift,shift_lead,rsum,counter,ratio,from-first -f value -g user_id", """SELECT event_id, user_id, round(value, 6) AS value, round(coalesce(value - lag(value) OVER w, 0), 6) AS value_delta,
  round(lag(value) OVER w, 6) AS value_shift, round(lead(value) OVER w, 6) AS value_shift_lead, round(sum(value) OVER w, 6) AS value_rsum, count(value) OVER w AS value_counter, round(coalesce(value / nullif(lag(value) OVER w, 0), 1), 6) AS value_ratio,
  round(value - first_value(value) OVER w, 6) AS "value_from-first" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
query("step_windows", "events", "cut -f event_id,user_id,value then step -a slwin_2_2,delta_2,shift_lag_2 -f value -g user_id", """SELECT event_id, user_id, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS value_slwin_2_2,
  round(coalesce(value - lag(value, 2) OVER w, 0), 6) AS value_delta_2, round(lag(value, 2) OVER w, 6) AS value_shift_lag_2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
query("step_ewma", "events", "cut -f event_id,user_id,value then step -a ewma -d 0.1234567,0.5432101 -o slow,fast -f value -g user_id", """WITH RECURSIVE r AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  t(event_id, user_id, value, k, a, b) AS (SELECT event_id, user_id, value, k, value, value FROM r WHERE k = 1 UNION ALL SELECT r.event_id, r.user_id, r.value, r.k, 0.1234567::DOUBLE * r.value + (1 - 0.1234567::DOUBLE) * t.a, 0.5432101::DOUBLE * r.value + (1 - 0.5432101::DOUBLE) * t.b FROM r JOIN t ON r.user_id = t.user_id AND r.k = t.k + 1)
  SELECT event_id, user_id, round(value, 6) AS value, round(a, 6) AS value_ewma_slow, round(b, 6) AS value_ewma_fast FROM t""")
query("rank_group", "orders", "cut -f o_orderkey,o_orderpriority,o_totalprice then rank -f o_totalprice -g o_orderpriority", "SELECT o_orderkey, o_orderpriority, o_totalprice, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS o_totalprice_rank FROM orders")
query("fraction", "orders", "cut -f o_orderkey,o_orderstatus,o_totalprice then fraction -f o_totalprice -g o_orderstatus", "SELECT o_orderkey, o_orderstatus, o_totalprice, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) AS o_totalprice_fraction FROM orders")
query("fraction_cumulative", "orders", "cut -f o_orderkey,o_orderstatus,o_totalprice then fraction -p -c -f o_totalprice -g o_orderstatus", """SELECT o_orderkey, o_orderstatus, o_totalprice, round(100 * sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) AS o_totalprice_cumulative_percent FROM orders""")
query("fill_down", "orders", "fill-down -f st", f"SELECT o_orderkey, coalesce(last_value(nullif(st, '') IGNORE NULLS) OVER (ORDER BY o_orderkey), st) AS st, o_totalprice FROM {_GAPS}", gaps)
query("fill_down_only_absent", "orders", "fill-down -a -f st", f"SELECT o_orderkey, coalesce(last_value(st IGNORE NULLS) OVER (ORDER BY o_orderkey), st) AS st, o_totalprice FROM {_GAPS}", gaps)
query("gap", "region", "gap -n 2", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT NULL, NULL FROM range(2)")

# ---- joins and sets
query("join_inner", "orders", "cut -f o_orderkey,o_custkey then join -f L -j id -l c_custkey -r o_custkey --lk c_name", "SELECT c_custkey AS id, c_name, o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey", L="customer")
query("join_left_unpaired", "orders", "filter '$o_totalprice > 300000' then join --np --ul -f L -j c_custkey -r o_custkey then cut -f c_custkey,c_name", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", L="customer")
query("join_right_unpaired", "documents", "cut -f doc_id,lang then join --np --ur -f L -j doc_id then cut -f doc_id,lang", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", L="labels")
query("join_full", "labels", "cut -f doc_id,quality then join --ul --ur -f L -j doc_id --lk lang", "SELECT doc_id, lang, quality FROM documents FULL JOIN labels USING (doc_id)", L="documents")
query("join_merge_prefix", "nation", "join -s --lp r_ --rp n_ -f L -j k -l r_regionkey -r n_regionkey", "SELECT r_regionkey AS k, r_name AS r_r_name, n_nationkey AS n_n_nationkey, n_name AS n_n_name FROM nation JOIN region ON r_regionkey = n_regionkey", L="region")


def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = chain(table(spark, sf_dir, "supplier"), "rename s_suppkey,id,s_name,name then cut -f id,name")
    b = chain(table(spark, sf_dir, "customer"), "rename c_custkey,id,c_name,name,c_mktsegment,segment then cut -f id,name,segment")
    return shown(chain(concat(a, b), "unsparsify --fill-with none -f segment"))


QUERIES["concat_unsparsify"] = _union
SQL["concat_unsparsify"] = "SELECT s_suppkey AS id, s_name AS name, 'none' AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer"

# ---- shape
query("reshape_long", "lineitem", "cut -f l_orderkey,l_linenumber,l_discount,l_tax then reshape -i l_discount,l_tax -o key,value", """SELECT l_orderkey, l_linenumber, 'l_discount' AS key, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
query("reshape_wide", "lineitem", "count -g l_returnflag,l_linestatus then reshape -s l_linestatus,count", "SELECT l_returnflag, max(n) FILTER (l_linestatus = 'F') AS F, max(n) FILTER (l_linestatus = 'O') AS O FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL")
query("nest_explode_records", "part", "cut -f p_partkey,p_type then nest --evar ' ' -f p_type", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS p_type FROM part")
query("nest_explode_fields", "part", "cut -f p_partkey,p_brand then nest --explode --values --across-fields --nested-fs # -f p_brand", "SELECT p_partkey, split_part(p_brand, '#', 1) AS p_brand_1, split_part(p_brand, '#', 2) AS p_brand_2 FROM part")
query("nest_implode", "nation", "cut -f n_regionkey,n_name then nest --ivar ; -f n_name", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY ALL")
query("nest_pairs", "events", "cut -f event_id,event_type then put '$p = \"t:\" . $event_type . \";i:\" . $event_id' then cut -f event_id,p then nest --explode --pairs --across-fields --nested-fs ; --nested-ps : -f p", "SELECT event_id, event_id::VARCHAR AS i, event_type AS t FROM events")
query("repeat_n", "region", "repeat -n 3", "SELECT region.* FROM region, range(3)")
query("repeat_field", "region", "repeat -f r_regionkey", "SELECT region.* FROM region, range(10) t(i) WHERE i < r_regionkey")
query("flatten_struct", "nation", "put '$m = {\"a\": $n_nationkey, \"b\": $n_regionkey}' then flatten -s : then cut -f n_nationkey,m:a,m:b", "SELECT n_nationkey, n_nationkey AS \"m:a\", n_regionkey AS \"m:b\" FROM nation")
query("unflatten_flatten", "region", "rename r_regionkey,a:x,r_name,a:y then unflatten -s : then flatten -s :", "SELECT r_regionkey AS \"a:x\", r_name AS \"a:y\" FROM region")
query("seqgen", "region", "seqgen -f i --start 1 --stop 100 --step 7", "SELECT i::INT AS i FROM range(1, 101, 7) t(i)")
query("altkv", "nation", "cut -o -f n_name,n_nationkey then altkv then json-stringify", "SELECT '{\"' || n_name || '\":\"' || n_nationkey || '\"}' AS kv FROM nation")
query("json_stringify", "nation", "cut -f n_name then json-stringify", "SELECT '\"' || n_name || '\"' AS n_name FROM nation")
query("json_parse", "events", "cut -f event_id,props then json-parse -f props then json-stringify -f props", "SELECT event_id, replace(props, ' ', '') AS props FROM events")

# ---- text
query("case_upper", "nation", "case -u -f n_name -v", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey FROM nation")
query("case_title_keys", "region", "case -u -k -f r_name", "SELECT r_regionkey, r_name AS \"R_NAME\" FROM region")
query("clean_whitespace", "documents", "cut -f doc_id,text then clean-whitespace -v", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS text FROM documents")
query("gsub", "part", "cut -f p_partkey,p_name then gsub -f p_name [aeiou] _", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_', 'g') AS p_name FROM part")
query("sub", "part", "cut -f p_partkey,p_name then sub -f p_name '([aeiou])' '<\\1>'", "SELECT p_partkey, regexp_replace(p_name, '([aeiou])', '<\\1>') AS p_name FROM part")
query("ssub", "part", "cut -f p_partkey,p_brand then ssub -f p_brand '#' .", "SELECT p_partkey, CASE WHEN instr(p_brand, '#') > 0 THEN substr(p_brand, 1, instr(p_brand, '#') - 1) || '.' || substr(p_brand, instr(p_brand, '#') + 1) ELSE p_brand END AS p_brand FROM part")
query("unspace", "part", "cut -f p_partkey,p_name then unspace -v", "SELECT p_partkey, replace(p_name, ' ', '_') AS p_name FROM part")
query("utf8_latin1_round_trip", "nation", "cut -f n_name then utf8-to-latin1 then latin1-to-utf8", "SELECT n_name FROM nation")
query("format_values", "nation", "format-values -i %05d", "SELECT printf('%05d', n_nationkey) AS n_nationkey, n_name, printf('%05d', n_regionkey) AS n_regionkey FROM nation")
query("sec2gmt", "nation", "put '$t = $n_nationkey * 1000003' then sec2gmt -3 t then cut -f n_nationkey,t", "SELECT n_nationkey, strftime(make_timestamp(n_nationkey::BIGINT * 1000003 * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS t FROM nation")
query("sec2gmtdate", "nation", "put '$t = $n_nationkey * 1000003' then sec2gmtdate t then cut -f n_nationkey,t", "SELECT n_nationkey, strftime(make_timestamp(n_nationkey::BIGINT * 1000003 * 1000000), '%Y-%m-%d') AS t FROM nation")
query("bar", "region", "bar -f r_regionkey --lo 0 --hi 4 -w 8", "SELECT repeat('*', 2 * r_regionkey) || repeat('.', 8 - 2 * r_regionkey) AS r_regionkey, r_name FROM region")

# ---- sampling (reproducible only in size)
query("sample", "orders", "cut -f o_orderkey,o_orderstatus then sample -k 2 -g o_orderstatus --seed 5 then count -g o_orderstatus", "SELECT o_orderstatus, least(count(*), 2) AS count FROM orders GROUP BY ALL")
query("bootstrap", "nation", "bootstrap -n 40 --seed 5 then count", "SELECT 40::BIGINT AS count")
query("shuffle", "region", "shuffle --seed 5", "SELECT * FROM region")

# ---- programs
query("put_arithmetic", "lineitem", "cut -f l_orderkey,l_linenumber,l_quantity,l_extendedprice,l_discount then put '$net = $l_extendedprice * (1 - $l_discount); $unit = $net / 7; $k = $l_linenumber ** 2 + 1; $h = $l_orderkey // 3; $r = $l_orderkey % 7'",
      """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) / 7, 6) AS unit, (l_linenumber::BIGINT ** 2 + 1)::BIGINT AS k, l_orderkey // 3 AS h, l_orderkey % 7 AS r FROM lineitem""")
query("put_conditions", "orders", "cut -f o_orderkey,o_totalprice then put 'if ($o_totalprice > 200000) {$size = \"large\"} elif ($o_totalprice > 100000) {$size = \"middle\"} else {$size = \"small\"}'", "SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size FROM orders")
query("put_function", "nation", "put 'func f(str s, num n): str { if (n > 2) { return toupper(s) . \":\" . n } return s } $t = f($n_name, $n_regionkey)' then cut -f n_nationkey,t", "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN upper(n_name) || ':' || n_regionkey ELSE n_name END AS t FROM nation")
query("put_captures", "customer", "put '$c_name =~ \"^(.)(.*)#0*(.*)$\" { $id = \"\\3-\\1\" }' then cut -f c_custkey,id", "SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^(.)(.*)#0*(.*)$') THEN regexp_extract(c_name, '^(.)(.*)#0*(.*)$', 3) || '-' || regexp_extract(c_name, '^(.)(.*)#0*(.*)$', 1) END AS id FROM customer")
query("put_loop_fields", "lineitem", "cut -f l_orderkey,l_linenumber,l_discount,l_tax then put 'for (k, v in $*) { if (k =~ \"^l_(disc|tax)\") { $[k . \"_pct\"] = v * 100 } }'", "SELECT l_orderkey, l_linenumber, l_discount, l_tax, round(l_discount * 100, 6) AS l_discount_pct, round(l_tax * 100, 6) AS l_tax_pct FROM lineitem")
query("put_hofs", "embeddings", "put '$s = fold($embedding, func(acc, e) { return acc + e ** 2 }, 0.0); $n = length(select($embedding, func(e) { return e > 0 })); $any = any($embedding, func(e) { return e > 2 })' then cut -f vec_id,n,any",
      "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS n, len(list_filter(embedding, lambda x: x > 2)) > 0 AS any FROM embeddings")
query("put_emit_map", "nation", "put -q 'emit {\"k\": $n_nationkey, \"v\": $n_name}; emit {\"k\": $n_nationkey * 10, \"v\": toupper($n_name)}'", "SELECT n_nationkey::BIGINT AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey * 10, upper(n_name) FROM nation")
query("emit_grouped", "lineitem", "put -q '@sum[$l_returnflag][$l_linestatus] += $l_quantity; @n[$l_returnflag][$l_linestatus] += 1; end { emit (@sum, @n), \"flag\", \"status\" }'", "SELECT l_returnflag AS flag, l_linestatus AS status, round(sum(l_quantity), 6) AS sum, count(*) AS n FROM lineitem GROUP BY ALL")
query("emit_spread", "lineitem", "put -q '@n[$l_returnflag][$l_linestatus] += 1; end { emit @n, \"flag\" }'", "SELECT l_returnflag AS flag, count(*) FILTER (l_linestatus = 'F') AS F, nullif(count(*) FILTER (l_linestatus = 'O'), 0) AS O FROM lineitem GROUP BY ALL")
query("emitf_totals", "orders", "put -q '@n += 1; @top = max(@top, $o_totalprice); @low = min(@low, $o_totalprice); end { emitf @n, @top, @low }'", "SELECT count(*) AS n, round(max(o_totalprice), 6) AS top, round(min(o_totalprice), 6) AS low FROM orders")
query("put_absent_rules", "orders", "put '$a = $st ?? \"absent\"; $b = $st ??? \"none\"; $c = is_present($st); $d = is_empty($st); $e = $nosuch + 1' then cut -f o_orderkey,a,b,c,d,e", f"""SELECT o_orderkey, coalesce(st, 'absent') AS a, CASE WHEN st IS NULL OR st = '' THEN 'none' ELSE st END AS b, st IS NOT NULL AS c, coalesce(st = '', false) AS d, 1::BIGINT AS e FROM {_GAPS}""", gaps)

query("put_sequential", "nation", "put '@s += $n_regionkey; $running = @s; $last = @prev ?? \"none\"; @prev = $n_name' then cut -f n_nationkey,running,last", "SELECT n_nationkey::BIGINT AS n_nationkey, sum(n_regionkey) OVER (ORDER BY n_nationkey)::BIGINT AS running, coalesce(lag(n_name) OVER (ORDER BY n_nationkey), 'none') AS last FROM nation")


# ---- formats: the lines that the writers give
def lines(name: str, source: str, links: str, fmt: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return render(chain(table(spark, sf_dir, source), links), fmt)

    QUERIES[name] = run
    SQL[name] = " ".join(sql.split())


lines("write_csv", "part", "cut -f p_partkey,p_name,p_size", "csv", "SELECT 'p_partkey,p_name,p_size' AS value UNION ALL SELECT p_partkey || ',' || p_name || ',' || p_size FROM part")
lines("write_tsv", "part", "cut -f p_partkey,p_name", "tsv", "SELECT 'p_partkey' || chr(9) || 'p_name' AS value UNION ALL SELECT p_partkey || chr(9) || p_name FROM part")
lines("write_dkvp", "part", "cut -f p_partkey,p_brand", "dkvp", "SELECT 'p_partkey=' || p_partkey || ',p_brand=' || p_brand AS value FROM part")
lines("write_nidx", "part", "cut -f p_partkey,p_brand", "nidx", "SELECT p_partkey || ' ' || p_brand AS value FROM part")
lines("write_jsonl", "part", "cut -f p_partkey,p_brand", "jsonl", """SELECT '{"p_partkey":' || p_partkey || ',"p_brand":"' || p_brand || '"}' AS value FROM part""")
lines("write_markdown", "region", "cat", "markdown", "SELECT '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' AS value UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |' FROM region")
lines("write_xtab", "region", "cat", "xtab", "SELECT 'r_regionkey ' || r_regionkey || chr(10) || rpad('r_name', 12, ' ') || r_name || chr(10) AS value FROM region")


# ---- functions, by class
def functions(name: str, source: str, key: str, cells: dict[str, tuple[str, str | None]]) -> None:
    """A query of one field for each expression, and its SQL (where every one has one)."""
    program = "; ".join(f"${k} = {e}" for k, (e, _) in cells.items())
    links = ["put", program, "then", "cut", "-o", "-f", ",".join([key, *cells])]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(chain(table(spark, sf_dir, source), links))

    QUERIES[name] = run
    if all(q for _, q in cells.values()):
        SQL[name] = f"SELECT {key}, " + ", ".join(f"{q} AS {k}" for k, (_, q) in cells.items()) + f" FROM {source}"


functions("functions_math", "lineitem", "l_orderkey,l_linenumber", {
    "abs_": ("abs(-$l_quantity)", "abs(-l_quantity)"), "ceil_": ("ceiling($l_extendedprice)", "ceil(l_extendedprice)"), "floor_": ("floor($l_extendedprice)", "floor(l_extendedprice)"), "round_": ("round($l_extendedprice)", "round(l_extendedprice)"),
    "sgn_": ("sgn($l_discount)", "sign(l_discount)::DOUBLE"), "exp_": ("exp($l_discount)", "round(exp(l_discount), 6)"), "expm1_": ("expm1($l_tax)", "round(exp(l_tax) - 1, 6)"), "log_": ("log($l_quantity)", "round(ln(l_quantity), 6)"),
    "log10_": ("log10($l_quantity)", "round(log10(l_quantity), 6)"), "log1p_": ("log1p($l_tax)", "round(ln(1 + l_tax), 6)"), "sqrt_": ("sqrt($l_quantity)", "round(sqrt(l_quantity), 6)"), "cbrt_": ("cbrt($l_quantity)", "round(cbrt(l_quantity), 6)"),
    "sin_": ("sin($l_quantity)", "round(sin(l_quantity), 6)"), "cos_": ("cos($l_quantity)", "round(cos(l_quantity), 6)"), "tan_": ("tan($l_tax)", "round(tan(l_tax), 6)"), "asin_": ("asin($l_tax)", "round(asin(l_tax), 6)"),
    "acos_": ("acos($l_tax)", "round(acos(l_tax), 6)"), "atan_": ("atan($l_quantity)", "round(atan(l_quantity), 6)"), "atan2_": ("atan2($l_tax, $l_quantity)", "round(atan2(l_tax, l_quantity), 6)"),
    "sinh_": ("sinh($l_tax)", "round((exp(l_tax) - exp(-l_tax)) / 2, 6)"), "cosh_": ("cosh($l_tax)", "round((exp(l_tax) + exp(-l_tax)) / 2, 6)"), "roundm_": ("roundm($l_quantity, 5.0)", "round(l_quantity / 5) * 5"),
    "logifit_": ("logifit($l_tax, 2, 3)", "round(1 / (1 + exp(-2 * l_tax - 3)), 6)"), "pow_": ("pow($l_quantity, 1.5)", "round(pow(l_quantity, 1.5), 6)"), "max_": ("max($l_tax, $l_discount)", "greatest(l_tax, l_discount)"), "min_": ("min($l_tax, $l_discount)", "least(l_tax, l_discount)"),
    "madd_": ("madd($l_orderkey, 5, 13)", "(l_orderkey + 5) % 13"), "mmul_": ("mmul($l_orderkey, 5, 13)", "(l_orderkey * 5) % 13"), "msub_": ("msub($l_orderkey, 1, 13)", "(l_orderkey - 1 + 13) % 13"),
    "bits": ("bitcount($l_orderkey)", "bit_count(l_orderkey)::BIGINT"), "and_": ("$l_orderkey & 12", "l_orderkey & 12"), "or_": ("$l_orderkey | 12", "l_orderkey | 12"), "xor_": ("$l_orderkey ^ 12", "xor(l_orderkey, 12)"), "shl": ("$l_orderkey << 2", "l_orderkey * 4"), "shr": ("$l_orderkey >> 2", "l_orderkey // 4"),
    "not_": ("~$l_orderkey", "-l_orderkey - 1"), "wrapadd": ("$l_orderkey .+ 1", "l_orderkey + 1"), "wrapmul": ("$l_orderkey .* 3", "l_orderkey * 3"),
})
_ERF = "2 / sqrt(pi()) * list_sum([((-1) ** k) * (X) ** (2 * k + 1) / (factorial(k::INTEGER) * (2 * k + 1)) for k in range(0, 33)])"
functions("functions_normal", "nation", "n_nationkey", {
    "erf_": ("erf($n_nationkey / 10)", f"round({_ERF.replace('X', 'n_nationkey / 10')}, 6)"), "erfc_": ("erfc($n_nationkey / 10)", f"round(1 - {_ERF.replace('X', 'n_nationkey / 10')}, 6)"),
    "qnorm_": ("qnorm($n_nationkey / 10)", f"round(0.5 + 0.5 * ({_ERF.replace('X', 'n_nationkey / 10 / sqrt(2)')}), 6)"), "invqnorm_": ("qnorm(invqnorm(($n_nationkey + 1) / 30))", "round((n_nationkey + 1) / 30, 6)"),
    "mexp_": ("mexp($n_nationkey, 7, 13)", "(n_nationkey::BIGINT * n_nationkey * n_nationkey * n_nationkey * n_nationkey * n_nationkey * n_nationkey) % 13"),
})
query("stats1_text", "part", "stats1 -a min,max,first,last,p10,p50,median,p90,mode,count -f p_name,p_brand -g p_size", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_name) - 1 AS i, row_number() OVER (PARTITION BY p_size ORDER BY p_brand) - 1 AS j, count(*) OVER (PARTITION BY p_size) AS n FROM part),
  m AS (SELECT p_size, p_name AS v, count(*) AS c, min(p_partkey) AS k, 1 AS f FROM part GROUP BY ALL UNION ALL SELECT p_size, p_brand, count(*), min(p_partkey), 2 FROM part GROUP BY ALL),
  best AS (SELECT p_size, f, arg_min(v, -c * 1000000000 + k) AS v FROM m GROUP BY p_size, f)
  SELECT p_size, min(p_name) AS p_name_min, max(p_name) AS p_name_max, arg_min(p_name, p_partkey) AS p_name_first, arg_max(p_name, p_partkey) AS p_name_last,
    max(p_name) FILTER (i = n * 10 // 100) AS p_name_p10, max(p_name) FILTER (i = n * 50 // 100) AS p_name_p50, max(p_name) FILTER (i = n * 50 // 100) AS p_name_median, max(p_name) FILTER (i = n * 90 // 100) AS p_name_p90,
    (SELECT v FROM best b WHERE b.p_size = r.p_size AND f = 1) AS p_name_mode, count(*) AS p_name_count,
    min(p_brand) AS p_brand_min, max(p_brand) AS p_brand_max, arg_min(p_brand, p_partkey) AS p_brand_first, arg_max(p_brand, p_partkey) AS p_brand_last,
    max(p_brand) FILTER (j = n * 10 // 100) AS p_brand_p10, max(p_brand) FILTER (j = n * 50 // 100) AS p_brand_p50, max(p_brand) FILTER (j = n * 50 // 100) AS p_brand_median, max(p_brand) FILTER (j = n * 90 // 100) AS p_brand_p90,
    (SELECT v FROM best b WHERE b.p_size = r.p_size AND f = 2) AS p_brand_mode, count(*) AS p_brand_count FROM r GROUP BY p_size""")
query("merge_fields_text", "part", "cut -f p_partkey,p_name,p_brand then merge-fields -k -a min,max -f p_name,p_brand -o t", "SELECT p_partkey, p_name, p_brand, least(p_name, p_brand) AS t_min, greatest(p_name, p_brand) AS t_max FROM part")
functions("functions_string", "part", "p_partkey", {
    "up": ("toupper($p_name)", "upper(p_name)"), "lo": ("tolower($p_type)", "lower(p_type)"), "cap": ("capitalize($p_name)", "upper(p_name[1]) || p_name[2:]"), "len": ("strlen($p_name)", "length(p_name)"),
    "cat_": ("$p_brand . \"/\" . $p_size", "p_brand || '/' || p_size"), "s1": ("substr1($p_name, 2, 4)", "p_name[2:4]"), "s0": ("substr0($p_name, 0, 2)", "p_name[1:3]"), "ix": ("index($p_name, \"a\")", "CASE WHEN instr(p_name, 'a') = 0 THEN -1 ELSE instr(p_name, 'a') END"),
    "has": ("contains($p_name, \"re\")", "contains(p_name, 're')"), "tr": ("truncate($p_name, 5)", "p_name[1:5]"), "lp": ("leftpad($p_size, 6, \"0\")", "lpad(p_size::VARCHAR, 6, '0')"), "rp": ("rightpad($p_size, 6, \"*\")", "rpad(p_size::VARCHAR, 6, '*')"),
    "gs": ("gsub($p_name, \"[aeiou]\", \"_\")", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), "sb": ("sub($p_name, \"([aeiou])\", \"<\\1>\")", "regexp_replace(p_name, '([aeiou])', '<\\1>')"), "gss": ("gssub($p_name, \"a\", \"AA\")", "replace(p_name, 'a', 'AA')"),
    "rx": ("regextract_or_else($p_name, \"[m-z]+\", \"no\")", "coalesce(nullif(regexp_extract(p_name, '[m-z]+'), ''), 'no')"), "m": ("$p_name =~ \"^[a-m]\"", "regexp_matches(p_name, '^[a-m]')"), "nm": ("$p_name !=~ \"^[a-m]\"", "NOT regexp_matches(p_name, '^[a-m]')"),
    "fmt": ("format(\"{}:{}\", $p_size, $p_brand)", "p_size || ':' || p_brand"), "st": ("strip(\"  \" . $p_name . \" \")", "trim(p_name)"), "ws": ("collapse_whitespace($p_name . \"  x\")", "regexp_replace(p_name || '  x', '\\s+', ' ', 'g')"),
    "hex_": ("hex_encode($p_brand)", "lower(hex(p_brand))"), "b64": ("base64_encode($p_brand)", "base64(p_brand::BLOB)"), "md5_": ("md5($p_name)", "md5(p_name)"), "sha1_": ("sha1($p_name)", "sha1(p_name)"), "sha256_": ("sha256($p_name)", "sha256(p_name)"),
    "hx": ("hexfmt($p_size)", "'0x' || lower(hex(p_size))"), "fn": ("fmtnum($p_retailprice, \"%.2lf\")", "printf('%.2f', p_retailprice)"), "fd": ("fmtnum($p_size, \"%05d\")", "printf('%05d', p_size)"), "fi": ("fmtifnum($p_name, \"%.2f\")", "p_name"),
})
functions("functions_compare", "part", "p_partkey", {
    "lt": ("$p_size < 20", "p_size < 20"), "ge": ("$p_size >= 20", "p_size >= 20"), "eq": ("$p_brand == \"Brand#11\"", "p_brand = 'Brand#11'"), "ne": ("$p_brand != \"Brand#11\"", "p_brand <> 'Brand#11'"), "sp": ("$p_size <=> 20", "sign(p_size - 20)::BIGINT"),
    "an": ("$p_size > 10 && $p_size < 30", "p_size > 10 AND p_size < 30"), "or_": ("$p_size < 10 || $p_size > 30", "p_size < 10 OR p_size > 30"), "xo": ("$p_size < 10 ^^ $p_size > 30", "(p_size < 10) <> (p_size > 30)"), "no": ("!($p_size < 10)", "NOT (p_size < 10)"), "tn": ("$p_size < 10 ? \"s\" : \"l\"", "CASE WHEN p_size < 10 THEN 's' ELSE 'l' END"),
})
functions("functions_time", "nation", "n_nationkey", {
    "g": ("sec2gmt($n_nationkey * 86401)", "strftime(make_timestamp(n_nationkey::BIGINT * 86401000000), '%Y-%m-%dT%H:%M:%SZ')"), "d": ("sec2gmtdate($n_nationkey * 86401)", "strftime(make_timestamp(n_nationkey::BIGINT * 86401000000), '%Y-%m-%d')"),
    "s": ("gmt2sec(\"2001-02-03T04:05:06Z\") + $n_nationkey", "981173106 + n_nationkey::BIGINT"), "f": ("strftime($n_nationkey * 86401, \"%Y/%m/%d %H:%M:%S\")", "strftime(make_timestamp(n_nationkey::BIGINT * 86401000000), '%Y/%m/%d %H:%M:%S')"),
    "p": ("strptime(\"2019-01-02T03:04:05Z\", \"%Y-%m-%dT%H:%M:%SZ\") + $n_nationkey", "1546398245.0::DOUBLE + n_nationkey"), "l": ("sec2localtime($n_nationkey * 86401, \"Asia/Istanbul\")", "strftime(timezone('Asia/Istanbul', make_timestamptz(n_nationkey::BIGINT * 86401000000)), '%Y-%m-%d %H:%M:%S')"),
    "h": ("sec2hms($n_nationkey * 1000)", "printf('%02d:%02d:%02d', n_nationkey * 1000 // 3600, n_nationkey * 1000 // 60 % 60, n_nationkey * 1000 % 60)"), "hs": ("hms2sec(\"01:23:20\") + $n_nationkey", "5000 + n_nationkey::BIGINT"), "ds": ("dhms2sec(\"1d2h3m4s\") + $n_nationkey", "93784 + n_nationkey::BIGINT"),
    "dd": ("datediff(0, $n_nationkey * 86400 * 40, \"d\")", "40 * n_nationkey::BIGINT"),
})
functions("functions_collections", "embeddings", "vec_id", {
    "n": ("length($embedding)", "len(embedding)"), "c": ("count($embedding)", "len(embedding)"), "mx": ("float(percentile($embedding, 100))", "round(list_max(embedding)::DOUBLE, 6)"), "first_": ("$embedding[1] > 0", "embedding[1] > 0"), "last_": ("$embedding[-1] > 0", "embedding[-1] > 0"), "jk": ("joink({\"a\": 1, \"b\": $vec_id}, \",\")", "'a,b'"),
    "jv": ("joinv({\"a\": 1, \"b\": $vec_id}, \",\")", "'1,' || vec_id"), "sp": ("splitax(\"x;y;\" . $vec_id, \";\")[3]", "vec_id::VARCHAR"), "ap": ("length(append($embedding, 1.0))", "len(embedding) + 1"), "hk": ("haskey($embedding, 64)", "len(embedding) >= 64"), "ms": ("joinkv(mapsum({\"a\": 1}, {\"b\": $vec_id}), \"=\", \",\")", "'a=1,b=' || vec_id"),
    "me": ("joink(mapexcept({\"a\": 1, \"b\": 2}, \"b\"), \",\")", "'a'"), "dp": ("depth($embedding)", "1::BIGINT"), "lc": ("leafcount($embedding)", "len(embedding)"), "t": ("typeof($embedding)", "'array'"),
})
functions("functions_types", "part", "p_partkey", {
    "a": ("typeof($p_size)", "'int'"), "b": ("typeof($p_retailprice)", "'float'"), "c": ("typeof($p_name)", "'string'"), "d": ("typeof($nosuch)", "'absent'"), "e": ("is_string($p_name)", "true"), "f": ("is_numeric($p_size)", "true"), "g": ("int($p_retailprice)", "trunc(p_retailprice)::BIGINT"),
    "h": ("float($p_size)", "p_size::DOUBLE"), "i": ("string($p_size)", "p_size::VARCHAR"), "j": ("boolean(\"true\")", "true"), "k": ("asserting_present($p_size)", "p_size"), "l": ("is_nan($p_retailprice)", "false"), "m": ("is_error($p_size)", "false"),
})


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(chain(table(spark, sf_dir, "lineitem"), FLAGSHIP))


FLAGSHIP = "stats1 -a count,sum,mean -f l_extendedprice -g l_returnflag,l_linestatus then sort -f l_returnflag,l_linestatus"
QUERIES["flagship_pricing"] = _flagship
SQL["flagship_pricing"] = "SELECT l_returnflag, l_linestatus, count(*) AS l_extendedprice_count, round(sum(l_extendedprice), 6) AS l_extendedprice_sum, round(avg(l_extendedprice), 6) AS l_extendedprice_mean FROM lineitem GROUP BY ALL"
