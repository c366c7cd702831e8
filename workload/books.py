"""Independent books, reconciliation, text audit."""

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import aggregate as agg
from ledgerloom.operators import reconcile
from ledgerloom.sources import books

from .tables import query

# A ledger-style book over `customer`: fuzzy headers, text numbers, TOTAL rows, repeated accounts.
BOOK_COLUMNS = {
    "ord": "c_custkey",
    "Ledger ID no": """CASE WHEN c_custkey % 29 = 0 THEN ' Total ' WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN concat(CAST(c_custkey % 400 AS {S}), '.0')
        ELSE concat(' K', CAST(c_custkey % 300 AS {S})) END""",
    "Total CR Amount (CNY)": "CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS {S}) END",
    "Debit": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 100 AS {S}) END",
    "Net": "CAST(CAST(c_acctbal AS DECIMAL(18,2)) - c_custkey % 100 AS {S})",
}
BOOK = "SELECT " + ", ".join(f'{e.replace("{S}", "VARCHAR")} AS "{c}"' for c, e in BOOK_COLUMNS.items()) + " FROM customer"
BOOK_READ = """SELECT account, last(cr ORDER BY ord) AS cr, last(dr ORDER BY ord) AS dr, last(net ORDER BY ord) AS net FROM (
  SELECT ord, CASE WHEN trim("Ledger ID no") LIKE 'K%' THEN trim("Ledger ID no") ELSE CAST(CAST(CAST("Ledger ID no" AS DOUBLE) AS BIGINT) AS VARCHAR) END AS account,
    coalesce(TRY_CAST("Total CR Amount (CNY)" AS DOUBLE), 0) AS cr, coalesce(TRY_CAST("Debit" AS DOUBLE), 0) AS dr, coalesce(TRY_CAST("Net" AS DOUBLE), 0) AS net
  FROM book WHERE "Ledger ID no" IS NOT NULL AND "Ledger ID no" <> ' Total ') GROUP BY account"""


def book(t):
    return t.read("customer").selectExpr(*[f"{e.replace('{S}', 'STRING')} AS `{c}`" for c, e in BOOK_COLUMNS.items()])


@query("SELECT * FROM b", book=BOOK, b=BOOK_READ)
def book_scan(t):
    return books.read_book(book(t))


# A wide summary over `part`: money as text, one column per period.
SUMMARY_COLUMNS = {
    "ord": "p_partkey", "项目名称": "CASE WHEN p_partkey % 17 = 0 THEN '备注' WHEN p_partkey % 19 = 0 THEN ' ' ELSE concat(' ', p_name, ' ', CAST(p_size AS {S})) END",
    "2023FY": "CAST(p_size AS {S})",
    "2024Q1-Q3 累计": """CASE p_partkey % 5 WHEN 0 THEN concat('¥', CAST(p_size AS {S}), ',000.50') WHEN 1 THEN concat('-', CAST(p_size AS {S}), ' 元')
        WHEN 2 THEN NULL WHEN 3 THEN 'none' ELSE concat('about ', CAST(p_size AS {S}), '.25') END""",
    "2024FY": "concat('￥', CAST(p_size AS {S}))",
}
SUMMARY = "SELECT " + ", ".join(f'{e.replace("{S}", "VARCHAR")} AS "{c}"' for c, e in SUMMARY_COLUMNS.items()) + ", p_size, p_partkey FROM part"
MONEY = """CASE p_partkey % 5 WHEN 0 THEN p_size * 1000 + 0.5 WHEN 1 THEN -p_size WHEN 4 THEN p_size + 0.25 ELSE 0 END"""


def wide_summary(t):
    return t.read("part").selectExpr(*[f"{e.replace('{S}', 'STRING')} AS `{c}`" for c, e in SUMMARY_COLUMNS.items()])


@query(f"""SELECT trim("项目名称") AS account, CAST(max_by({MONEY}, ord) AS DOUBLE) AS net FROM s
  WHERE trim("项目名称") <> '' AND trim("项目名称") <> '备注' GROUP BY 1""", s=SUMMARY)
def summary_scan(t):
    return books.read_summary(wide_summary(t), "2024Q1-Q3", "项目名称")


@query(f"""SELECT account, period, CAST(max_by(v, ord) AS DOUBLE) AS net FROM (
  SELECT trim("项目名称") AS account, ord, '2023FY' AS period, CAST(p_size AS DOUBLE) AS v FROM s UNION ALL
  SELECT trim("项目名称"), ord, '2024Q1-Q3 累计', CAST({MONEY} AS DOUBLE) FROM s UNION ALL SELECT trim("项目名称"), ord, '2024FY', p_size FROM s)
  WHERE account <> '' AND account <> '备注' GROUP BY ALL""", s=SUMMARY)
def summary_periods(t):
    return books.summary_periods(wide_summary(t), "项目名称")


# Our yearly summary beside a perturbed copy of it, for all years at once.
YEARLY = """SELECT year, account_code, ledger_id, account_name, sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE 0 END) AS cr,
  sum(CASE WHEN ledger_type = 'DR' THEN amount ELSE 0 END) AS dr FROM named GROUP BY ALL"""


@query("""SELECT CAST(year AS BIGINT) AS year, ledger_id AS account, CAST(cr AS DOUBLE) AS cr, CAST(dr AS DOUBLE) AS dr, CAST(cr - dr AS DOUBLE) AS net FROM y""",
       "named", y=YEARLY)
def published_by_id(t):
    return books.published_by_id(agg.account_summary(t.ledger, t.accounts))


@query("""SELECT CAST(year AS BIGINT) AS year, account_name AS account, CAST(cr AS DOUBLE) AS cr, CAST(dr AS DOUBLE) AS dr, CAST(cr - dr AS DOUBLE) AS net FROM y WHERE year = 2023""",
       "named", y=YEARLY)
def published_by_name(t):
    return books.published_by_name(agg.account_summary(t.ledger, t.accounts), 2023)


# Customers as accounts: our totals from `orders`, theirs from the book of every second order key.
OURS = """SELECT concat(CASE WHEN o_custkey % 10 = 3 THEN 'ours-' ELSE '' END, CAST(o_custkey AS VARCHAR)) AS account, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS cr,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS dr FROM orders GROUP BY 1"""
THEIRS = """SELECT concat(CASE WHEN o_custkey % 10 = 4 THEN 'theirs-' ELSE '' END, CAST(o_custkey AS VARCHAR)) AS account, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END)
    + (CASE WHEN o_custkey % 7 = 0 THEN 1.5 WHEN o_custkey % 11 = 0 THEN 0.01 ELSE 0 END) AS DOUBLE) AS cr,
  CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS dr FROM orders GROUP BY o_custkey"""
NETTED = "SELECT account, cr, dr, cr - dr AS net FROM {0}"


def both_books(t):
    side = lambda cond: F.sum(F.when(cond, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(0))).cast("decimal(28,2)")
    paid = F.col("o_orderstatus") == "F"
    sums = t.read("orders").groupBy("o_custkey").agg(side(~paid).alias("cr"), side(paid).alias("dr"))
    def account(name, digit):
        return F.concat(F.when(F.col("o_custkey") % 10 == digit, F.lit(name)).otherwise(F.lit("")), F.col("o_custkey").cast("string")).alias("account")

    extra = F.when(F.col("o_custkey") % 7 == 0, 1.5).when(F.col("o_custkey") % 11 == 0, 0.01).otherwise(0.0).cast("decimal(18,2)")
    net = (F.col("cr") - F.col("dr")).alias("net")
    ours = sums.select(account("ours-", 3), F.col("cr").cast("double").alias("cr"), F.col("dr").cast("double").alias("dr"))
    theirs = sums.select(account("theirs-", 4), (F.col("cr") + extra).cast("double").alias("cr"), F.col("dr").cast("double").alias("dr"))
    return ours.select("account", "cr", "dr", net), theirs.select("account", "cr", "dr", net)


@query("""SELECT coalesce(o.account, r.account) AS account, 'all' AS field, CAST(round(coalesce(o.cr + o.dr + o.net, 0), 4) AS DOUBLE) AS ours,
    CAST(round(coalesce(r.cr + r.dr + r.net, 0), 4) AS DOUBLE) AS reference, 0.0::DOUBLE AS diff,
    CASE WHEN r.account IS NULL THEN 'In our output only (not in reference)' ELSE 'In reference only (missing in our output)' END AS message
  FROM o FULL JOIN r ON r.account = o.account WHERE o.account IS NULL OR r.account IS NULL
  UNION ALL SELECT o.account, f.field, round(CASE f.field WHEN 'cr' THEN o.cr WHEN 'dr' THEN o.dr ELSE o.net END, 4), round(CASE f.field WHEN 'cr' THEN r.cr WHEN 'dr' THEN r.dr ELSE r.net END, 4),
    round(CASE f.field WHEN 'cr' THEN o.cr - r.cr WHEN 'dr' THEN o.dr - r.dr ELSE o.net - r.net END, 4),
    concat(upper(f.field), ': ours=', printf('%.2f', CASE f.field WHEN 'cr' THEN o.cr WHEN 'dr' THEN o.dr ELSE o.net END), ', ref=',
      printf('%.2f', CASE f.field WHEN 'cr' THEN r.cr WHEN 'dr' THEN r.dr ELSE r.net END), ', diff=',
      printf('%.2f', CASE f.field WHEN 'cr' THEN o.cr - r.cr WHEN 'dr' THEN o.dr - r.dr ELSE o.net - r.net END))
  FROM o JOIN r ON r.account = o.account, (VALUES ('cr'), ('dr'), ('net')) AS f(field)
  WHERE abs(CASE f.field WHEN 'cr' THEN o.cr - r.cr WHEN 'dr' THEN o.dr - r.dr ELSE o.net - r.net END) > 0.5""",
       ours=OURS, theirs=THEIRS, o=NETTED.format("ours"), r=NETTED.format("theirs"))
def recon_by_id(t):
    ours, theirs = both_books(t)
    return reconcile.by_id(ours, theirs, tolerance=0.5).withColumns(
        {c: F.round(F.coalesce(c, F.lit(0.0)), 4) for c in ("ours", "reference", "diff")})


# Names: categories by priority of the order, some under an alias of the book.
CATEGORY = """CASE o_orderpriority WHEN '1-URGENT' THEN '组委工资' WHEN '2-HIGH' THEN '投资收入' WHEN '3-MEDIUM' THEN '捐赠收入' WHEN '5-LOW' THEN '银行存款' ELSE '运营费用' END"""
BOOK_CATEGORY = """CASE o_orderpriority WHEN '1-URGENT' THEN '讲师组委工资' WHEN '2-HIGH' THEN '投资收益' WHEN '3-MEDIUM' THEN '捐赠收入' WHEN '5-LOW' THEN 'unlisted' ELSE '业务活动费用' END"""
NAMED_OURS = f"SELECT {CATEGORY} AS account, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS net FROM orders GROUP BY 1"
NAMED_THEIRS = f"""SELECT {BOOK_CATEGORY} AS account, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2)) + CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS DOUBLE) AS net
  FROM orders GROUP BY 1"""


@query("""SELECT account, 'net' AS field, round(net, 2) AS ours, 0.0::DOUBLE AS reference, 0.0::DOUBLE AS diff, 'Category not in reference (or add alias)' AS message FROM o WHERE account = '银行存款'
  UNION ALL SELECT '投资收入', 'net', round(o.net, 2), round(r.net, 2), round(o.net - r.net, 2), concat('net: ours=', printf('%.2f', o.net), ', ref=', printf('%.2f', r.net))
    FROM o, r WHERE o.account = '投资收入' AND r.account = '投资收益'
  UNION ALL SELECT account, 'net', 0, round(net, 2), 0, 'In reference only (no matching our category)' FROM r WHERE account = 'unlisted'""",
       o=NAMED_OURS, r=NAMED_THEIRS)
def recon_by_name(t):
    orders, price = t.read("orders"), F.col("o_totalprice").cast("decimal(18,2)")
    ours = orders.groupBy(F.expr(CATEGORY).alias("account")).agg(F.sum(price).cast("decimal(28,2)").cast("double").alias("net"))
    theirs = orders.groupBy(F.expr(BOOK_CATEGORY).alias("account")).agg(
        F.sum(price + F.when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(0)).cast("decimal(28,2)").cast("double").alias("net"))
    return reconcile.by_name(ours, theirs).withColumns(
        {c: F.round(F.coalesce(c, F.lit(0.0)), 2) for c in ("ours", "reference", "diff")})


# A quarterly book report over `orders`: one row per order key block, labels with signs, broken cells.
PERIODS = ["2024Q1", "2024Q2", "2024Q3", "2024Q4"]
LABEL = "CASE o_orderkey % 6 WHEN 0 THEN ' 捐赠收入' WHEN 1 THEN '投资收入' WHEN 2 THEN '投资收益 ' WHEN 3 THEN '    组织管理费用' WHEN 4 THEN '组委工资' ELSE '其他' END"
CELLS = {p: f"CASE WHEN o_orderkey % {11 + i} = 0 THEN '#REF!' WHEN o_orderkey % {17 + i} = 0 THEN NULL ELSE CAST(CAST(o_totalprice + {i} AS DECIMAL(18,2)) AS {{S}}) END"
         for i, p in enumerate(PERIODS)}
REPORT = f"SELECT o_orderkey AS ord, {LABEL} AS label, " + ", ".join(f'{e.replace("{S}", "VARCHAR")} AS "{p}"' for p, e in CELLS.items()) + " FROM orders"
REPORT_READ = """SELECT account, period, sum(CASE WHEN account IN ('组委工资', '管理费用') THEN -v ELSE v END) AS net, max_by(CASE WHEN account IN ('组委工资', '管理费用') THEN -v ELSE v END, ord) AS last
  FROM (SELECT ord, CASE trim(label) WHEN '投资收入' THEN '投资收益' WHEN '组织管理费用' THEN '管理费用' ELSE trim(label) END AS account, period, TRY_CAST(cell AS DECIMAL(18,2)) AS v
  FROM (UNPIVOT report ON "2024Q1", "2024Q2", "2024Q3", "2024Q4" INTO NAME period VALUE cell) WHERE trim(label) <> '其他') WHERE v IS NOT NULL GROUP BY ALL"""


def report(t):
    return t.read("orders").selectExpr("o_orderkey AS ord", f"{LABEL} AS label", *[f"{e.replace('{S}', 'STRING')} AS `{p}`" for p, e in CELLS.items()])


@query("SELECT account, period, round(CAST(net AS DOUBLE), 2) AS net FROM q", report=REPORT, q=REPORT_READ)
def quarter_labels(t):
    return books.read_quarter_labels(report(t), "label").withColumn("net", F.round("net", 2))


@query("SELECT account, period, CAST(last AS DOUBLE) AS net FROM q", report=REPORT, q=REPORT_READ)
def quarter_labels_last(t):
    return books.read_quarter_labels(report(t), "label", accumulate=False)


OUR_QUARTERS = """SELECT account_name AS account, CAST(year AS INTEGER) AS year, CAST(quarter AS INTEGER) AS quarter, CAST(sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE 0 END) AS DOUBLE) AS cr,
  CAST(sum(CASE WHEN ledger_type = 'DR' THEN amount ELSE 0 END) AS DOUBLE) AS dr,
  CAST(sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE -amount END) AS DOUBLE) AS net FROM named GROUP BY ALL"""
THEIR_QUARTERS = """SELECT account, CASE WHEN quarter = 4 THEN year + 50 ELSE year END AS year, quarter, net + CASE WHEN quarter = 3 THEN 10 ELSE 0 END AS net FROM oq
  UNION ALL SELECT '短期借款', 2024, 1, 5.0"""
LISTED = "('捐赠收入', '投资收益', '收入SC', '收入OL', '管理费用', '组委工资', '宣传推广', '社群维护', '支出SC运营', '支出OL讲师', '银行存款', '应付税款', '短期借款')"


def our_quarters(t):
    return agg.quarter_report(t.quarterly, t.accounts).filter("row_kind = 'ACCOUNT'").select(
        F.col("account_name").alias("account"), "year", "quarter", F.col("cr_amount").cast("double").alias("cr"),
        F.col("dr_amount").cast("double").alias("dr"), F.col("net_amount").cast("double").alias("net"))


def their_quarters(t):
    ours = our_quarters(t).withColumn("net", F.col("net") + F.when(F.col("quarter") == 3, 10).otherwise(0)).withColumn(
        "year", F.when(F.col("quarter") == 4, F.col("year") + 50).otherwise(F.col("year")))
    return ours.select("account", "year", "quarter", "net").unionByName(
        t.spark.sql("SELECT '短期借款' AS account, 2024 AS year, 1 AS quarter, 5.0D AS net"))


@query(f"""SELECT coalesce(o.account, r.account) AS account, CAST(coalesce(o.year, r.year) AS BIGINT) AS year, CAST(coalesce(o.quarter, r.quarter) AS BIGINT) AS quarter,
  round(coalesce(r.net, 0), 2) AS book_net, coalesce(o.cr, 0) AS cr, coalesce(o.dr, 0) AS dr, coalesce(o.net, 0) AS net, round(coalesce(o.net - r.net, 0), 2) AS diff,
  CASE WHEN o.net IS NULL OR r.net IS NULL THEN '—' WHEN abs(o.net - r.net) < 0.01 THEN '✓' ELSE '≠' END AS mark
  FROM (SELECT * FROM oq WHERE account IN {LISTED}) o FULL JOIN (SELECT * FROM tq WHERE account IN {LISTED}) r
  ON r.account = o.account AND r.year = o.year AND r.quarter = o.quarter""", "named", oq=OUR_QUARTERS, tq=THEIR_QUARTERS)
def recon_quarter(t):
    return reconcile.by_quarter(our_quarters(t), their_quarters(t)).withColumns({
        **{c: F.coalesce(c, F.lit(0.0)) for c in ("cr", "dr", "net")},
        **{c: F.round(F.coalesce(c, F.lit(0.0)), 2) for c in ("book_net", "diff")}})


@query(f"SELECT account, CAST(year AS BIGINT) AS year, CAST(quarter AS BIGINT) AS quarter, net FROM oq WHERE account NOT IN {LISTED} AND abs(net) > 0.01",
       "named", oq=OUR_QUARTERS)
def recon_unlisted(t):
    return reconcile.unlisted(our_quarters(t)).select("account", "year", "quarter", "net")


@query("""SELECT doc_id, c AS column_name, TRUE AS is_valid, CAST(octet_length(encode(v)) AS BIGINT) AS n_bytes, CAST(length(v) AS BIGINT) AS n_chars,
  md5(v) AS repaired, md5(v) AS round_trip FROM (SELECT doc_id, 'text' AS c, text AS v FROM documents UNION ALL SELECT doc_id, 'source', source FROM documents)""")
def utf8_audit(t):
    return text.utf8_audit(t.read("documents"), "doc_id", ["text", "source"]).withColumns(
        {c: F.md5(c) for c in ("repaired", "round_trip")})


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE value END AS value FROM events""")
def nan_to_null(t):
    rows = t.read("events").select("event_id", F.expr("CASE WHEN event_id % 5 = 0 THEN double('NaN') ELSE value END").alias("value"))
    return text.nan_to_null(rows).withColumn("value", F.coalesce("value", F.lit(-1.0)))


@query("""SELECT o_orderkey AS src_row, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE concat('x', CAST(o_orderkey AS VARCHAR)) END AS account,
  CAST(CASE o_orderkey % 4 WHEN 0 THEN o_orderkey * 1000 + 0.5 WHEN 1 THEN -o_orderkey ELSE 0 END AS DOUBLE) AS money,
  o_orderkey % 5 < 3 AS flag FROM orders""")
def lenient_parsing(t):
    rows = t.read("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN concat(CAST(o_orderkey AS STRING), '.0') ELSE concat(' x', CAST(o_orderkey AS STRING)) END").alias("k"),
        F.expr("CASE o_orderkey % 4 WHEN 0 THEN concat('¥', CAST(o_orderkey AS STRING), ',000.50') WHEN 1 THEN concat('-', CAST(o_orderkey AS STRING)) WHEN 2 THEN 'none' END").alias("m"),
        F.expr("CASE o_orderkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'no' ELSE '0' END").alias("b"))
    return rows.select(F.col("o_orderkey").alias("src_row"), text.account_key(F.col("k")).alias("account"),
                       text.parse_money(F.col("m")).alias("money"), text.truthy(F.col("b")).alias("flag"))
