"""The five query shapes (L1-L5) over the star tables, as DataFrame plans.

Each function takes a :class:`~sqlweave.sources.tables.Tables` and returns a
lazy DataFrame. Joins are plain equi joins on foreign keys; Catalyst and AQE
choose broadcast or sort-merge from measured sizes. Year filters are
half-open ranges so both bounds reach the parquet reader. Money totals are
summed as DECIMAL (order independent). ``SQL`` holds the DuckDB twin of
every shape, written independently against the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlweave.functions.columns import MONEY, date_part, sql_literal, year_eq
from sqlweave.operators.ranking import rank_over


# -- L1: list --------------------------------------------------------------
def scan_table(t) -> DataFrame:
    o = t.orders.alias("o")
    return o.select("o.o_orderkey", "o.o_custkey", "o.o_totalprice")


def l1_list(t) -> DataFrame:
    """Orders of 1997 with status F: key, total price, date."""
    o = t.orders
    return (o.filter((F.col("o_orderstatus") == "F") & year_eq("o_orderdate", 1997))
            .select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate")))


# -- L2: grouped and global aggregates ---------------------------------------
# Grouping by a dimension attribute: the fact is first aggregated on its FK
# (eager aggregation). A hot FK value becomes one row before any join, and the
# aggregate's hash partitioning on the key already satisfies a shuffle join on
# that key. The partial states are exact: decimal sums, counts, max, min.
def _partial(fact: DataFrame, key: str, value: str, funcs=("SUM",)) -> DataFrame:
    need = {f.upper() for f in funcs}
    aggs = {}
    if need & {"SUM", "AVG"}:
        aggs["_s"] = F.sum(F.col(value).cast(MONEY))
    if need & {"COUNT", "AVG"}:
        aggs["_n"] = F.count(value)
    if "MAX" in need:
        aggs["_mx"] = F.max(value)
    if "MIN" in need:
        aggs["_mn"] = F.min(value)
    return fact.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()])


def _final(func: str) -> F.Column:
    func = func.upper()
    if func == "SUM":
        return F.sum("_s").cast("double")
    if func == "AVG":
        return F.sum("_s").cast("double") / F.sum("_n")
    if func == "COUNT":
        return F.sum("_n")
    if func == "MAX":
        return F.max("_mx")
    return F.min("_mn")


def agg_group(t) -> DataFrame:
    """Flagship: total order price by nation name, 1996, status F."""
    o = t.orders.filter(year_eq("o_orderdate", 1996) & (F.col("o_orderstatus") == "F"))
    per_cust = _partial(o, "o_custkey", "o_totalprice")
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name")
    return (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .groupBy("n_name")
            .agg(_final("SUM").alias("sum_o_totalprice")))


def agg_by_brand(t, func: str) -> DataFrame:
    """``func`` over lineitem extended price (COUNT: l_orderkey) by part brand."""
    col = "l_orderkey" if func.upper() == "COUNT" else "l_extendedprice"
    per_part = _partial(t.lineitem, "l_partkey", col, (func,))
    p = t.part.select("p_partkey", "p_brand")
    return (per_part.join(p, per_part.l_partkey == p.p_partkey)
            .groupBy("p_brand")
            .agg(_final(func).alias(f"{func.lower()}_{col}")))


def agg_global(t) -> DataFrame:
    """Ungrouped: number of orders in 2000 with status O."""
    o = t.orders.filter(year_eq("o_orderdate", 2000) & (F.col("o_orderstatus") == "O"))
    return o.agg(F.count("o_orderkey").alias("count_o_orderkey"))


def join_fk_1hop(t) -> DataFrame:
    per_part = _partial(t.lineitem, "l_partkey", "l_extendedprice")
    p = t.part.select("p_partkey", "p_type")
    return (per_part.join(p, per_part.l_partkey == p.p_partkey).groupBy("p_type")
            .agg(_final("SUM").alias("sum_l_extendedprice")))


def join_fk_2hop(t) -> DataFrame:
    """lineitem -> orders -> customer: price by market segment."""
    per_order = _partial(t.lineitem, "l_orderkey", "l_extendedprice")
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_mktsegment")
    return (per_order.join(o, per_order.l_orderkey == o.o_orderkey)
            .join(c, o.o_custkey == c.c_custkey)
            .groupBy("c_mktsegment")
            .agg(_final("SUM").alias("sum_l_extendedprice")))


# -- L3: HAVING and top-N ----------------------------------------------------
def having(t) -> DataFrame:
    """Customers whose order total exceeds 3,000,000."""
    per_cust = _partial(t.orders, "o_custkey", "o_totalprice")
    c = t.customer.select("c_custkey", "c_name")
    # one row per customer already: filter the exact sum, then fetch the names of what is left
    return (per_cust.filter(F.col("_s") > 3_000_000)
            .join(c, per_cust.o_custkey == c.c_custkey)
            .select("c_custkey", "c_name", F.col("_s").cast("double").alias("sum_o_totalprice")))


def top_n(t, n: int = 10) -> DataFrame:
    """Top suppliers by lineitem price; ties broken by name then key."""
    per_supp = _partial(t.lineitem, "l_suppkey", "l_extendedprice")
    s = t.supplier.select("s_suppkey", "s_name")
    return (per_supp.join(s, per_supp.l_suppkey == s.s_suppkey)
            .select("s_suppkey", "s_name", F.col("_s").cast("double").alias("sum_l_extendedprice"))
            .orderBy(F.desc("sum_l_extendedprice"), "s_name", "s_suppkey")
            .limit(n))


# -- L4: subqueries -------------------------------------------------------
def above_average(t) -> DataFrame:
    """Orders priced above the mean total price.

    A scalar subquery (``DataFrame.scalar``): the mean is one small aggregate
    job and the comparison reaches the parquet reader as a pushed filter.
    """
    o = t.orders
    mean = t.orders.agg(F.avg("o_totalprice")).scalar()
    return o.filter(F.col("o_totalprice") > mean).select("o_orderkey", "o_totalprice")


def semi_join(t) -> DataFrame:
    """Customers with an order in 1996 (IN subquery as a left-semi join)."""
    c = t.customer.select("c_custkey", "c_name")
    # distinct first: a hot customer becomes one row per task before the join
    o = t.orders.filter(year_eq("o_orderdate", 1996)).select("o_custkey").distinct()
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


def filter_subquery(t) -> DataFrame:
    """Both subquery forms: balance above the mean (scalar) and nation in region 1 (IN)."""
    c = t.customer
    mean = t.customer.agg(F.avg("c_acctbal")).scalar()
    nk = t.nation.filter(F.col("n_regionkey") == 1).select("n_nationkey")
    return (c.filter(F.col("c_acctbal") > mean)
            .join(nk, c.c_nationkey == nk.n_nationkey, "left_semi")
            .select("c_custkey", "c_acctbal", "c_nationkey"))


# -- L5: ranking ------------------------------------------------------------
def win_rank(t, func: str = "rank") -> DataFrame:
    """Orders ranked by price within each customer (first non-PK id)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return rank_over(o, "o_totalprice", ["o_custkey"], func=func, tiebreak=["o_orderkey"])


def win_rank_global(t) -> DataFrame:
    """Customers ranked by balance, no partition column, without a single-task sort."""
    c = t.customer.select("c_custkey", "c_acctbal")
    return rank_over(c, "c_acctbal", [], func="rank", tiebreak=["c_custkey"])


# -- filters -----------------------------------------------------------------
def filter_year(t) -> DataFrame:
    return t.orders.filter(year_eq("o_orderdate", 2000)).select("o_orderkey", "o_custkey")


def filter_org(t) -> DataFrame:
    """Org-striping equality (l_linenumber stands in for org_id)."""
    return (t.lineitem.filter(F.col("l_linenumber") == 3)
            .select("l_orderkey", "l_linenumber", "l_extendedprice"))


def filter_lookup(t) -> DataFrame:
    """Lookup column equal to an allowed value."""
    return (t.lineitem.filter(F.col("l_returnflag") == "R")
            .select("l_orderkey", "l_partkey", "l_returnflag"))


def filter_compare(t) -> DataFrame:
    """The comparison operators: LIKE, >=, <=, >, =, IN."""
    p = t.part
    return (p.filter(F.col("p_name").like("%ring%") & (F.col("p_size") >= 10)
                     & (F.col("p_size") <= 30) & (F.col("p_retailprice") > 950)
                     & F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#10"))
            .select("p_partkey", "p_name", "p_brand", "p_size"))


def filter_and(t) -> DataFrame:
    """ANDed lookup, lookup and year predicates, grouped."""
    li = t.lineitem.filter((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
                           & year_eq("l_shipdate", 1998))
    return li.groupBy("l_linenumber").agg(F.count("l_orderkey").alias("count_l_orderkey"))


def literal(t) -> DataFrame:
    """Predicates written from rendered literals (quotes doubled, numbers bare)."""
    cond = (f"c_mktsegment IN ({sql_literal('BUILDING')}, {sql_literal(chr(39) + 'x')}) "
            f"AND c_nationkey <> {sql_literal(7)}")
    return t.customer.filter(F.expr(cond)).select("c_custkey", "c_mktsegment", "c_nationkey")


def date_parts(t) -> DataFrame:
    """Orders per year and month, with day-of-month spread."""
    o = t.orders
    return (o.groupBy(date_part("o_orderdate", "year").alias("yr"),
                      date_part("o_orderdate", "month").alias("mo"))
            .agg(F.count("o_orderkey").alias("n_orders"),
                 F.min(date_part("o_orderdate", "day")).alias("min_day"),
                 F.max(date_part("o_orderdate", "day")).alias("max_day")))


def row_cap(t, max_rows: int = 50) -> DataFrame:
    """At most ``max_rows`` rows of a query; the cap is the feature."""
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(max_rows)


SHAPES = {
    "scan_table": scan_table,
    "l1_list": l1_list,
    "agg_group": agg_group,
    "agg_sum": lambda t: agg_by_brand(t, "SUM"),
    "agg_avg": lambda t: agg_by_brand(t, "AVG"),
    "agg_max": lambda t: agg_by_brand(t, "MAX"),
    "agg_min": lambda t: agg_by_brand(t, "MIN"),
    "agg_count": lambda t: agg_by_brand(t, "COUNT"),
    "agg_global": agg_global,
    "join_fk_1hop": join_fk_1hop,
    "join_fk_2hop": join_fk_2hop,
    "having": having,
    "top_n": top_n,
    "above_average": above_average,
    "semi_join": semi_join,
    "filter_subquery": filter_subquery,
    "win_rank": lambda t: win_rank(t, "rank"),
    "win_dense_rank": lambda t: win_rank(t, "dense_rank"),
    "win_row_number": lambda t: win_rank(t, "row_number"),
    "win_rank_global": win_rank_global,
    "filter_year": filter_year,
    "filter_org": filter_org,
    "filter_lookup": filter_lookup,
    "filter_compare": filter_compare,
    "filter_and": filter_and,
    "literal": literal,
    "date_part": date_parts,
    "row_cap": row_cap,
}

_MONEY = "CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def _brand(func: str) -> str:
    col = "l_orderkey" if func == "COUNT" else "l_extendedprice"
    if func == "SUM":
        e = _MONEY.format(c=col)
    elif func == "AVG":
        e = _MONEY.format(c=col) + f" / COUNT({col})"
    else:
        e = f"{func}({col})"
    return (f"SELECT p.p_brand, {e} AS {func.lower()}_{col} FROM lineitem l "
            f"JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand")


def _win(func: str) -> str:
    tb = ", o.o_orderkey" if func == "ROW_NUMBER" else ""
    return (f"SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, {func}() OVER "
            f"(PARTITION BY o.o_custkey ORDER BY o.o_totalprice DESC{tb}) AS rnk FROM orders o")


SQL = {
    "scan_table": "SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o",
    "l1_list": ("SELECT o.o_orderkey, o.o_totalprice, CAST(o.o_orderdate AS DATE) AS o_orderdate "
                "FROM orders o WHERE o.o_orderstatus = 'F' "
                "AND EXTRACT(YEAR FROM o.o_orderdate) = 1997"),
    "agg_group": ("SELECT n.n_name, " + _MONEY.format(c="o.o_totalprice") + " AS sum_o_totalprice "
                  "FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
                  "JOIN nation n ON c.c_nationkey = n.n_nationkey "
                  "WHERE EXTRACT(YEAR FROM o.o_orderdate) = 1996 AND o.o_orderstatus = 'F' "
                  "GROUP BY n.n_name"),
    "agg_sum": _brand("SUM"),
    "agg_avg": _brand("AVG"),
    "agg_max": _brand("MAX"),
    "agg_min": _brand("MIN"),
    "agg_count": _brand("COUNT"),
    "agg_global": ("SELECT COUNT(o.o_orderkey) AS count_o_orderkey FROM orders o "
                   "WHERE EXTRACT(YEAR FROM o.o_orderdate) = 2000 AND o.o_orderstatus = 'O'"),
    "join_fk_1hop": ("SELECT p.p_type, " + _MONEY.format(c="l.l_extendedprice") +
                     " AS sum_l_extendedprice FROM lineitem l JOIN part p "
                     "ON l.l_partkey = p.p_partkey GROUP BY p.p_type"),
    "join_fk_2hop": ("SELECT c.c_mktsegment, " + _MONEY.format(c="l.l_extendedprice") +
                     " AS sum_l_extendedprice FROM lineitem l "
                     "JOIN orders o ON l.l_orderkey = o.o_orderkey "
                     "JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"),
    "having": ("SELECT c.c_custkey, c.c_name, " + _MONEY.format(c="o.o_totalprice") +
               " AS sum_o_totalprice FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
               "GROUP BY c.c_custkey, c.c_name HAVING " + _MONEY.format(c="o.o_totalprice") +
               " > 3000000"),
    "top_n": ("SELECT s.s_suppkey, s.s_name, " + _MONEY.format(c="l.l_extendedprice") +
              " AS sum_l_extendedprice FROM lineitem l JOIN supplier s "
              "ON l.l_suppkey = s.s_suppkey GROUP BY s.s_suppkey, s.s_name "
              "ORDER BY sum_l_extendedprice DESC, s.s_name, s.s_suppkey FETCH FIRST 10 ROWS ONLY"),
    "above_average": ("SELECT o.o_orderkey, o.o_totalprice FROM orders o WHERE o.o_totalprice > "
                      "(SELECT AVG(o2.o_totalprice) FROM orders o2)"),
    "semi_join": ("SELECT c.c_custkey, c.c_name FROM customer c WHERE c.c_custkey IN "
                  "(SELECT o.o_custkey FROM orders o WHERE EXTRACT(YEAR FROM o.o_orderdate) = 1996)"),
    "filter_subquery": ("SELECT c.c_custkey, c.c_acctbal, c.c_nationkey FROM customer c "
                        "WHERE c.c_acctbal > (SELECT AVG(c2.c_acctbal) FROM customer c2) "
                        "AND c.c_nationkey IN (SELECT n.n_nationkey FROM nation n "
                        "WHERE n.n_regionkey = 1)"),
    "win_rank": _win("RANK"),
    "win_dense_rank": _win("DENSE_RANK"),
    "win_row_number": _win("ROW_NUMBER"),
    "win_rank_global": ("SELECT c.c_custkey, c.c_acctbal, RANK() OVER (ORDER BY c.c_acctbal DESC) "
                        "AS rnk FROM customer c"),
    "filter_year": ("SELECT o.o_orderkey, o.o_custkey FROM orders o "
                    "WHERE EXTRACT(YEAR FROM o.o_orderdate) = 2000"),
    "filter_org": ("SELECT l.l_orderkey, l.l_linenumber, l.l_extendedprice FROM lineitem l "
                   "WHERE l.l_linenumber = 3"),
    "filter_lookup": ("SELECT l.l_orderkey, l.l_partkey, l.l_returnflag FROM lineitem l "
                      "WHERE l.l_returnflag = 'R'"),
    "filter_compare": ("SELECT p.p_partkey, p.p_name, p.p_brand, p.p_size FROM part p "
                       "WHERE p.p_name LIKE '%ring%' AND p.p_size >= 10 AND p.p_size <= 30 "
                       "AND p.p_retailprice > 950 AND p.p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#10')"),
    "filter_and": ("SELECT l.l_linenumber, COUNT(l.l_orderkey) AS count_l_orderkey FROM lineitem l "
                   "WHERE l.l_returnflag = 'N' AND l.l_linestatus = 'O' "
                   "AND EXTRACT(YEAR FROM l.l_shipdate) = 1998 GROUP BY l.l_linenumber"),
    "literal": ("SELECT c.c_custkey, c.c_mktsegment, c.c_nationkey FROM customer c "
                "WHERE c.c_mktsegment IN ('BUILDING', '''x') AND c.c_nationkey <> 7"),
    "date_part": ("SELECT CAST(EXTRACT(YEAR FROM o.o_orderdate) AS INTEGER) AS yr, "
                  "CAST(EXTRACT(MONTH FROM o.o_orderdate) AS INTEGER) AS mo, "
                  "COUNT(o.o_orderkey) AS n_orders, "
                  "CAST(MIN(EXTRACT(DAY FROM o.o_orderdate)) AS INTEGER) AS min_day, "
                  "CAST(MAX(EXTRACT(DAY FROM o.o_orderdate)) AS INTEGER) AS max_day "
                  "FROM orders o GROUP BY 1, 2"),
    "row_cap": "SELECT o.o_orderkey, o.o_totalprice FROM orders o ORDER BY o.o_orderkey LIMIT 50",
}
