"""Rule matching, ledger lines, aggregates and orders."""

from pyspark.sql import functions as F

from ledgerloom.operators import accounts as acc
from ledgerloom.operators import aggregate as agg
from ledgerloom.operators import ledger as booking
from ledgerloom.operators import audit, matching, ordering, profile

from .tables import query

LINE = """src_row, CAST(line_no AS BIGINT) AS line_no, entry_id, account_code, account_path,
  CAST(amount AS DOUBLE) AS amount, CAST(date AS VARCHAR) AS date, description, source_entry_id, rule_applied,
  CAST(quarter AS BIGINT) AS quarter, CAST(year AS BIGINT) AS year, ledger_type"""
PERIOD = "CAST(quarter AS BIGINT) AS quarter, CAST(year AS BIGINT) AS year"
SUMS = "CAST(cr AS DOUBLE) AS cr_amount, CAST(dr AS DOUBLE) AS dr_amount, CAST(n AS BIGINT) AS entry_count"


@query(f"""SELECT q.account_code, coalesce(a.full_path, q.account_code) AS account_path, {PERIOD},
  CAST(cr - dr AS DOUBLE) AS total_amount, {SUMS}, CAST(coalesce(a.level, 0) AS BIGINT) AS level
  FROM quarterly q LEFT JOIN accounts a ON a.code = q.account_code""", "quarterly", "accounts")
def quarterly_net(t):
    return t.quarterly


CODED = "SELECT l.* REPLACE (coalesce(a.code, l.account_code) AS account_code) FROM ledger l LEFT JOIN accounts a ON a.name = l.account_code"
CODED_Q = """SELECT c.account_code, c.quarter, c.year, sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE 0 END) AS cr,
  sum(CASE WHEN ledger_type = 'DR' THEN amount ELSE 0 END) AS dr, count(*) AS n,
  a.level, a.parent_code, a.full_path, a.name FROM coded c JOIN accounts a ON a.code = c.account_code GROUP BY ALL"""


def coded_ledger(t):
    """The ledger with codes instead of names, as books keyed by code have it."""
    return acc.lookup(t.ledger, t.accounts).withColumn("account_code", F.coalesce("ledger_id", "account_code")).select(
        *t.ledger.columns)


@query(f"""SELECT account_code, full_path AS account_path, {PERIOD}, CAST(cr - dr AS DOUBLE) AS total_amount, {SUMS},
  CAST(level AS BIGINT) AS level FROM cq""", "ledger", "accounts", coded=CODED, cq=CODED_Q)
def quarterly_by_code(t):
    return agg.quarterly(coded_ledger(t), t.accounts)


@query(f"SELECT {LINE} FROM ledger", "ledger")
def ledger_lines(t):
    return t.ledger


@query(f"SELECT {LINE} FROM all_lines", "all_lines")
def ledger_with_placeholders(t):
    return booking.ledger(t.records, include_unmatched=True)


@query(f"SELECT {LINE} FROM ledger WHERE src_row IN (SELECT src_row FROM records WHERE splits)", "ledger")
def deposit_split(t):
    return booking.ledger(t.records.filter("splits"))


@query("""SELECT src_row, entry_id, coalesce(cr_id, '') AS cr_rule, coalesce(dr_id, '') AS dr_rule, no_match
  FROM records""", "records")
def applied_rules(t):
    return matching.pick_rules(t.entries, t.rules, t.accounts).select(
        "src_row", "entry_id", F.coalesce("cr_rule.rule_id", F.lit("")).alias("cr_rule"),
        F.coalesce("dr_rule.rule_id", F.lit("")).alias("dr_rule"),
        (F.col("cr_rule.rule_id").isNull() & F.col("dr_rule.rule_id").isNull()).alias("no_match"))


@query("""SELECT src_row, entry_id, coalesce(cr_id, '') AS cr_rule, coalesce(dr_id, '') AS dr_rule, no_match
  FROM records""", "records")
def applied_rules_shuffled(t):
    """The plan for rule sets too large to broadcast gives the same picks."""
    return matching.pick_rules(t.entries, t.rules, t.accounts, max_rules=0).select(
        "src_row", "entry_id", F.coalesce("cr_rule.rule_id", F.lit("")).alias("cr_rule"),
        F.coalesce("dr_rule.rule_id", F.lit("")).alias("dr_rule"),
        (F.col("cr_rule.rule_id").isNull() & F.col("dr_rule.rule_id").isNull()).alias("no_match"))


@query("""SELECT src_row, entry_id, old_type, description, CAST(date AS VARCHAR) AS date, CAST(amount AS DOUBLE) AS amount,
  CAST(year AS BIGINT) AS year FROM records WHERE no_match""", "records")
def unmatched_entries(t):
    return t.unmatched.select("src_row", "entry_id", "old_type", "description", "date", "amount", "year")


def _some_id(t):
    return t.entries.agg(F.min("entry_id")).first()[0]


@query(f"SELECT {LINE} FROM all_lines WHERE source_entry_id = (SELECT min(entry_id) FROM entries)", "all_lines")
def one_entry(t):
    return booking.ledger(booking.transform_entry(t.entries, t.rules, t.accounts, _some_id(t)), True)


@query("""SELECT src_row, entry_id, no_match, coalesce(cr_id, '') AS cr_id, coalesce(dr_id, '') AS dr_id FROM records
  WHERE entry_id = (SELECT min(entry_id) FROM entries)""", "records")
def one_record(t):
    return audit.record_of(t.records, _some_id(t)).select(
        "src_row", "entry_id", "no_match", *[F.coalesce(f"{s}_rule.rule_id", F.lit("")).alias(f"{s}_id") for s in ("cr", "dr")])


# Line items as a larger journal: returned items are negative, types follow the ship date.
ITEMS = """SELECT l_orderkey AS src_row, concat(CAST(l_orderkey AS VARCHAR), '-', CAST(l_linenumber AS VARCHAR)) AS entry_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'OL' WHEN 1 THEN 'OL-D' WHEN 2 THEN '工资' ELSE 'RareType' END AS old_type,
  CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2)) AS amount,
  CAST(l_shipdate + INTERVAL '24' YEAR AS DATE) AS date FROM lineitem"""
ITEM_SIDES = """SELECT account_code, CAST(quarter(date) AS INTEGER) AS quarter, CAST(year(date) AS INTEGER) AS year, side, amt FROM (
  SELECT date, CASE WHEN old_type = 'OL' AND amount > 0 AND year(date) = 2024 THEN amount - least(150, amount) ELSE abs(amount) END AS amt,
    CASE old_type WHEN 'OL' THEN '收入OL' ELSE '银行存款' END AS account_code,
    CASE WHEN old_type = 'OL-D' THEN CASE WHEN amount >= 0 THEN 'DR' ELSE 'CR' END
         WHEN old_type = 'OL' AND amount < 0 THEN 'DR' ELSE 'CR' END AS side
  FROM items WHERE old_type <> 'RareType' AND amount <> 0
  UNION ALL
  SELECT date, abs(amount), CASE old_type WHEN 'OL' THEN '银行存款' WHEN 'OL-D' THEN '应付OL押金' ELSE '组委工资' END,
    CASE WHEN old_type = 'OL-D' THEN CASE WHEN amount >= 0 THEN 'CR' ELSE 'DR' END
         WHEN old_type = 'OL' AND amount < 0 THEN 'CR' ELSE 'DR' END
  FROM items WHERE old_type <> 'RareType' AND amount <> 0
  UNION ALL
  SELECT date, least(150, amount), '应付OL押金', 'CR' FROM items WHERE old_type = 'OL' AND amount > 0 AND year(date) = 2024)"""


def item_journal(t):
    return t.read("lineitem").select(
        F.col("l_orderkey").alias("src_row"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("entry_id"),
        F.year(F.expr("CAST(l_shipdate + INTERVAL '24' YEAR AS DATE)")).alias("year"),
        F.lit("line item").alias("description"),
        F.expr("CASE l_suppkey % 4 WHEN 0 THEN 'OL' WHEN 1 THEN 'OL-D' WHEN 2 THEN '工资' ELSE 'RareType' END").alias("old_type"),
        F.expr("CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END AS DECIMAL(18,2))").alias("amount"),
        F.expr("CAST(l_shipdate + INTERVAL '24' YEAR AS DATE)").alias("date"),
        F.lit(None).cast("int").alias("quarter"), F.lit(None).cast("string").alias("notes"),
    ).filter("amount <> 0")


@query(f"""SELECT account_code, {PERIOD}, CAST(sum(CASE WHEN side = 'CR' THEN amt ELSE 0 END) AS DOUBLE) AS cr_amount,
  CAST(sum(CASE WHEN side = 'DR' THEN amt ELSE 0 END) AS DOUBLE) AS dr_amount, count(*) AS entry_count
  FROM sides GROUP BY ALL""", items=ITEMS, sides=ITEM_SIDES)
def quarterly_net_items(t):
    """600 thousand rows at the bench scale."""
    lines = booking.ledger(booking.book(item_journal(t), t.rules, t.accounts))
    return agg.quarterly(lines, t.accounts).select(
        "account_code", "quarter", "year", "cr_amount", "dr_amount", "entry_count")


@query("""SELECT CAST(level AS BIGINT) AS level, CAST(f.q AS BIGINT) AS quarter, CAST(f.y AS BIGINT) AS year,
  CAST(total AS DOUBLE) AS total_amount, n AS account_count FROM (
  SELECT level, min({'a': account_code, 'q': quarter, 'y': year}) AS f, sum(cr - dr) AS total, count(*) AS n
  FROM cq GROUP BY level)""", "ledger", "accounts", coded=CODED, cq=CODED_Q)
def level_totals(t):
    return agg.level_totals(agg.quarterly(coded_ledger(t), t.accounts))


@query(f"""SELECT account_code, full_path AS account_path, {PERIOD}, CAST(cr - dr AS DOUBLE) AS total_amount, {SUMS},
  CAST(level AS BIGINT) AS level FROM cq WHERE level BETWEEN 1 AND 4""", "ledger", "accounts", coded=CODED, cq=CODED_Q)
def level_members(t):
    return agg.level_members(agg.quarterly(coded_ledger(t), t.accounts))


@query(f"""SELECT node AS account_code, {PERIOD}, CAST(sum(net) AS DOUBLE) AS subtree_amount FROM (
  SELECT account_code AS node, quarter, year, cr - dr AS net FROM cq
  UNION ALL SELECT parent_code, quarter, year, cr - dr FROM cq WHERE parent_code IS NOT NULL) GROUP BY ALL""",
       "ledger", "accounts", coded=CODED, cq=CODED_Q)
def subtree_totals(t):
    return agg.subtree_totals(agg.quarterly(coded_ledger(t), t.accounts), t.accounts)


SUMMARY = """SELECT row_kind, {year} coalesce(ledger_id, '') AS ledger_id, coalesce(account_code, '') AS account_code,
  coalesce(account_name, '') AS account_name, CAST(cr AS DOUBLE) AS cr_amount, CAST(dr AS DOUBLE) AS dr_amount,
  CAST(cr - dr AS DOUBLE) AS net_amount, CAST(n AS BIGINT) AS entry_count FROM (
  SELECT CASE WHEN grouping(account_code) = 1 THEN 'TOTAL' ELSE 'ACCOUNT' END AS row_kind, {sel} ledger_id, account_code,
    account_name, sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE 0 END) AS cr,
    sum(CASE WHEN ledger_type = 'DR' THEN amount ELSE 0 END) AS dr, count(*) AS n
  FROM named GROUP BY GROUPING SETS (({sel} ledger_id, account_code, account_name), ()))"""


def _plain(df):
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in ("ledger_id", "account_code", "account_name")})


@query(SUMMARY.format(year="CAST(coalesce(year, 0) AS BIGINT) AS year,", sel="year,"), "named")
def yearly_summary(t):
    return _plain(agg.account_summary(t.ledger, t.accounts)).withColumn("year", F.coalesce("year", F.lit(0)))


@query(SUMMARY.format(year="", sel=""), "named")
def account_summary(t):
    return _plain(agg.account_summary(t.ledger, t.accounts, by_year=False))


@query(f"""SELECT {PERIOD}, CAST(sum(cr) AS DOUBLE) AS cr_amount, CAST(sum(dr) AS DOUBLE) AS dr_amount,
  CAST(sum(n) AS BIGINT) AS entry_count, CAST(sum(dr) - sum(cr) AS DOUBLE) AS net_amount
  FROM quarterly GROUP BY ALL""", "quarterly")
def quarter_totals(t):
    return agg.quarter_totals(t.quarterly)


RESULTS = """SELECT quarter, year,
  sum(CASE WHEN left(ledger_id, 1) IN ('4', '5') THEN CASE ledger_type WHEN 'CR' THEN amount ELSE -amount END ELSE 0 END) AS ie,
  sum(CASE WHEN left(ledger_id, 1) = '3' THEN CASE ledger_type WHEN 'CR' THEN amount ELSE -amount END ELSE 0 END) AS eq
  FROM named GROUP BY ALL"""


@query(f"""SELECT {PERIOD}, CAST(ie AS DOUBLE) AS income_minus_expense, CAST(-ie AS DOUBLE) AS expense_minus_income,
  CAST(eq AS DOUBLE) AS equity FROM res""", "named", res=RESULTS)
def quarter_results(t):
    return agg.quarter_results(t.quarterly, t.accounts)


@query(f"""SELECT 'ACCOUNT' AS row_kind, CAST(0 AS BIGINT) AS kind_ord, {PERIOD}, coalesce(c.code, m.code, q.account_code) AS ledger_id, q.account_code,
  coalesce(c.name, m.name, q.account_code) AS account_name, CAST(cr AS DOUBLE) AS cr_amount, CAST(dr AS DOUBLE) AS dr_amount,
  CAST(cr - dr AS DOUBLE) AS net_amount, CAST(q.n AS BIGINT) AS entry_count
  FROM quarterly q LEFT JOIN accounts c ON c.code = q.account_code LEFT JOIN accounts m ON m.name = q.account_code
  UNION ALL SELECT 'TOTAL', 1, {PERIOD}, '', '', '', CAST(sum(cr) AS DOUBLE), CAST(sum(dr) AS DOUBLE),
  CAST(sum(dr) - sum(cr) AS DOUBLE), CAST(sum(n) AS BIGINT) FROM quarterly GROUP BY quarter, year
  UNION ALL SELECT 'RESULT_INCOME_MINUS_EXPENSE', 2, {PERIOD}, '', '', '', 0, 0, CAST(ie AS DOUBLE), 0 FROM res
  UNION ALL SELECT 'RESULT_EXPENSE_MINUS_INCOME', 3, {PERIOD}, '', '', '', 0, 0, CAST(-ie AS DOUBLE), 0 FROM res
  UNION ALL SELECT 'RESULT_EQUITY', 4, {PERIOD}, '', '', '', 0, 0, CAST(eq AS DOUBLE), 0 FROM res""",
       "named", "quarterly", res=RESULTS)
def quarter_report(t):
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("cr_amount", "dr_amount", "entry_count")}
    return _plain(agg.quarter_report(t.quarterly, t.accounts)).withColumns(zero)


@query("""SELECT count(*) AS total_entries, CAST(sum(amount) AS DOUBLE) AS total_amount,
  count(DISTINCT account_code) AS unique_accounts, count(DISTINCT (quarter, year)) AS unique_quarters FROM ledger""", "ledger")
def ledger_stats(t):
    return agg.ledger_statistics(t.ledger)


@query(f"SELECT {PERIOD}, count(*) AS entry_count, CAST(sum(amount) AS DOUBLE) AS total_amount FROM ledger GROUP BY ALL", "ledger")
def ledger_stats_by_quarter(t):
    return agg.quarter_statistics(t.ledger)


@query("""SELECT CAST(lvl AS BIGINT) AS level, CASE WHEN g = 1 THEN 'TOTAL' ELSE account_code END AS account_code,
  CASE WHEN g = 1 THEN concat('Level ', CAST(lvl AS VARCHAR), ' Total') ELSE coalesce(p, account_code) END AS account_path,
  CAST(s AS DOUBLE) AS total_amount, n AS entry_count FROM (
  SELECT account_level AS lvl, n.account_code, any_value(a.full_path) AS p, grouping(n.account_code) AS g, sum(amount) AS s, count(*) AS n
  FROM named n LEFT JOIN accounts a ON a.code = n.account_code
  WHERE account_level > 0 GROUP BY GROUPING SETS ((account_level, n.account_code), (account_level)))""", "named", "accounts")
def level_account_totals(t):
    return agg.level_account_totals(t.ledger, t.accounts)


# Postings on parents as well: every fourth credited income line goes to the level-1 account.
POSTED = """SELECT * REPLACE (CASE WHEN ledger_type = 'CR' AND src_row % 4 = 0 AND account_code LIKE '4%' THEN '4000'
  ELSE account_code END AS account_code) FROM coded"""
POSTED_Q = """SELECT p.account_code, p.quarter, p.year, sum(CASE ledger_type WHEN 'CR' THEN amount ELSE -amount END) AS net,
  a.level, a.parent_code FROM posted p JOIN accounts a ON a.code = p.account_code GROUP BY ALL"""
CHILD_SUMS = "SELECT parent_code, quarter, year, sum(net) AS children FROM pq WHERE parent_code IS NOT NULL GROUP BY ALL"


def posted_quarterly(t):
    lines = coded_ledger(t)
    up = (F.col("ledger_type") == "CR") & (F.col("src_row") % 4 == 0) & F.col("account_code").startswith("4")
    return agg.quarterly(lines.withColumn("account_code", F.when(up, "4000").otherwise(F.col("account_code"))), t.accounts)


TIE = """SELECT pq.account_code, CAST(pq.quarter AS BIGINT) AS quarter, CAST(pq.year AS BIGINT) AS year, CAST(level AS BIGINT) AS level,
  CAST(coalesce(children, 0) AS DOUBLE) AS children_total, CAST(net AS DOUBLE) AS total_amount
  FROM pq {join} JOIN cs ON cs.parent_code = pq.account_code AND cs.quarter = pq.quarter AND cs.year = pq.year
  WHERE level < 4 AND abs(coalesce(children, 0) - net) > 0.01"""


@query(TIE.format(join="LEFT"), "ledger", "accounts", coded=CODED, posted=POSTED, pq=POSTED_Q, cs=CHILD_SUMS)
def tie_out_strict(t):
    return agg.tie_out(posted_quarterly(t), t.accounts).drop("message")


@query(TIE.format(join=""), "ledger", "accounts", coded=CODED, posted=POSTED, pq=POSTED_Q, cs=CHILD_SUMS)
def tie_out(t):
    return agg.tie_out(posted_quarterly(t), t.accounts, strict=False).drop("message")


# A table of unfinished aggregates: one row per event and user group, so keys repeat.
@query("""SELECT ord AS src_row, concat('Duplicate aggregation for account ', account_code, ' in Q', CAST(quarter AS VARCHAR), ' ',
  CAST(year AS VARCHAR), ': total ', CAST(prev AS VARCHAR), ' and ', CAST(total_amount AS VARCHAR)) AS message FROM (
  SELECT *, lag(total_amount) OVER (PARTITION BY account_code, quarter, year ORDER BY ord) AS prev FROM (
  SELECT event_id AS ord, event_type AS account_code, CAST(quarter(ts) AS INTEGER) AS quarter, CAST(year(ts) AS INTEGER) AS year,
  CAST(value AS DECIMAL(18,2)) AS total_amount FROM events)) WHERE prev IS NOT NULL""")
def duplicate_aggregates(t):
    rows = t.read("events").select(
        F.col("event_id").alias("ord"), F.col("event_type").alias("account_code"), F.quarter("ts").alias("quarter"),
        F.year("ts").alias("year"), F.col("value").cast("decimal(18,2)").alias("total_amount"))
    return agg.duplicate_aggregates(rows).select("src_row", "message")


@query("""SELECT entry_id, ledger_id, account_code, account_path, CAST(account_level AS BIGINT) AS level, ledger_type, description,
  CAST(CASE WHEN ledger_type = 'DR' THEN amount ELSE -amount END AS DOUBLE) AS signed_amount, CAST(date AS VARCHAR) AS date,
  CAST(quarter AS BIGINT) AS quarter, CAST(year AS BIGINT) AS year, source_entry_id, rule_applied, src_row,
  CAST(line_no AS BIGINT) AS line_no FROM named""", "named")
def categorization(t):
    return ordering.categorization(t.ledger, t.accounts)


@query("""SELECT entry_id, source_entry_id, CAST(CASE left(source_entry_id, 1) WHEN 'A' THEN 0 WHEN 'I' THEN 1 WHEN 'B' THEN 2 ELSE 3 END AS BIGINT) AS prefix_rank,
  CAST(date AS VARCHAR) AS date FROM ledger ORDER BY year, quarter, ledger.date, prefix_rank, source_entry_id, src_row, line_no""", "ledger")
def ledger_sorted(t):
    return t.ledger.orderBy(*ordering.categorization_order()).select(
        "entry_id", "source_entry_id", ordering.prefix_rank(F.col("source_entry_id")).alias("prefix_rank"), "date")


@query("""SELECT entry_id, account_code, CAST(account_level AS BIGINT) AS level, CAST(date AS VARCHAR) AS date FROM named
  WHERE account_level BETWEEN 1 AND 4 ORDER BY account_level, account_code, named.date, src_row, line_no""", "named")
def hierarchy_order(t):
    return ordering.hierarchy_view(t.ledger, t.accounts).orderBy(*ordering.hierarchy_order()).select(
        "entry_id", "account_code", "level", "date")


@query("""SELECT src_row, entry_id, CAST(amount AS DOUBLE) AS amount, greatest(n - 500, 0) AS n_more FROM (
  SELECT *, count(*) OVER () AS n FROM records WHERE no_match) ORDER BY src_row LIMIT 500""", "records")
def first_unmatched(t):
    """The printed list of the review sheet shows 500 rows and counts the others."""
    return ordering.capped(t.unmatched.select("src_row", "entry_id", "amount"), ["src_row"], 500)


@query("""SELECT account_code, account_name, CASE left(ledger_id, 1) WHEN '4' THEN '收入' ELSE '支出' END AS kind,
  CAST(cr AS DOUBLE) AS cr_amount, CAST(dr AS DOUBLE) AS dr_amount, CAST(cr - dr AS DOUBLE) AS net_amount,
  CASE left(ledger_id, 1) WHEN '4' THEN cr >= dr ELSE dr >= cr END AS side_ok FROM (
  SELECT account_code, account_name, ledger_id, sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE 0 END) AS cr,
  sum(CASE WHEN ledger_type = 'DR' THEN amount ELSE 0 END) AS dr FROM named WHERE left(ledger_id, 1) IN ('4', '5') GROUP BY ALL)""",
       "named")
def side_check(t):
    return profile.side_check(t.quarterly, t.accounts)


@query("""SELECT CAST(sum(s) AS DOUBLE) AS total_amount, avg(n) AS avg_lines, max(n) AS max_lines, min(n) AS min_lines,
  count(*) FILTER (n > 1) AS multi_line_sources, count(*) FILTER (n > 1 AND d = 1) AS same_amount_sources FROM (
  SELECT source_entry_id, count(*) AS n, count(DISTINCT amount) AS d, sum(amount) AS s FROM ledger GROUP BY 1)""", "ledger")
def fan_out(t):
    return profile.fan_out(t.ledger)


@query("""SELECT account_code, CAST(sum(amount) AS DOUBLE) AS total_amount FROM ledger GROUP BY 1
  ORDER BY sum(amount) DESC, 1 LIMIT 10""", "ledger")
def top_accounts(t):
    return profile.top_accounts(t.ledger)


@query("""SELECT source_entry_id, count(*) AS n_lines, CAST(sum(amount) AS DOUBLE) AS total_amount FROM ledger
  GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10""", "ledger")
def widest_sources(t):
    return profile.widest_sources(t.ledger)


@query("""SELECT CAST(year AS BIGINT) AS year, old_type, count(*) AS count, concat(string_agg(entry_id, ', ' ORDER BY src_row)
  FILTER (rn <= 5), CASE WHEN count(*) > 5 THEN ' ...' ELSE '' END) AS sample_ids FROM (
  SELECT *, row_number() OVER (PARTITION BY year, old_type ORDER BY src_row) AS rn FROM records WHERE no_match)
  GROUP BY year, old_type""", "records")
def unmatched_profile(t):
    return profile.unmatched_profile(t.unmatched)


@query("""SELECT old_type, count(*) AS count, coalesce(CASE WHEN old_type IN ('OL', 'OL-D') THEN 'OL' WHEN old_type = '工资' THEN 'CR' END, '')
  AS suggested_group FROM journal GROUP BY old_type""", "journal")
def type_distribution(t):
    return profile.type_distribution(t.journal).withColumn("suggested_group", F.coalesce("suggested_group", F.lit("")))


# A hierarchy over the driver's tables: regions, nations, suppliers and customers on levels 1 to 4.
TREE = """SELECT r_regionkey AS ord, concat('R', CAST(r_regionkey AS VARCHAR)) AS code, r_name AS name, 1 AS level,
    CAST(NULL AS VARCHAR) AS parent_code, r_name AS full_path FROM region
  UNION ALL SELECT 100 + n_nationkey, concat('N', CAST(n_nationkey AS VARCHAR)), n_name, 2,
    concat('R', CAST(n_regionkey AS VARCHAR)), concat('/', n_name) FROM nation
  UNION ALL SELECT 1000 + s_suppkey, concat('S', CAST(s_suppkey AS VARCHAR)), s_name, 3,
    concat('N', CAST(CASE WHEN s_suppkey % 13 = 0 THEN 99 ELSE s_nationkey END AS VARCHAR)), concat('//', s_name) FROM supplier
  UNION ALL SELECT 10000000 + c_custkey, CASE WHEN c_custkey % 50 = 7 THEN 'C7' ELSE concat('C', CAST(c_custkey AS VARCHAR)) END,
    c_mktsegment, 4, CASE WHEN c_custkey % 11 = 0 THEN concat('N', CAST(c_nationkey AS VARCHAR))
    ELSE concat('S', CAST(c_custkey % 40 AS VARCHAR)) END, concat('///', c_name) FROM customer"""


def tree(t):
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    s = lambda c: F.col(c).cast("string")
    region = t.read("region").select(
        F.col("r_regionkey").cast("bigint").alias("ord"), text("R", s("r_regionkey")).alias("code"),
        F.col("r_name").alias("name"), F.lit(1).alias("level"), F.lit(None).cast("string").alias("parent_code"),
        F.col("r_name").alias("full_path"))
    nation = t.read("nation").select(
        (F.col("n_nationkey") + 100).cast("bigint"), text("N", s("n_nationkey")), "n_name", F.lit(2),
        text("R", s("n_regionkey")), text("/", F.col("n_name")))
    supplier = t.read("supplier").select(
        F.col("s_suppkey") + 1000, text("S", s("s_suppkey")), "s_name", F.lit(3),
        text("N", F.when(F.col("s_suppkey") % 13 == 0, F.lit("99")).otherwise(s("s_nationkey"))),
        text("//", F.col("s_name")))
    customer = t.read("customer").select(
        F.col("c_custkey") + 10000000,
        F.when(F.col("c_custkey") % 50 == 7, "C7").otherwise(text("C", s("c_custkey"))), "c_mktsegment", F.lit(4),
        F.when(F.col("c_custkey") % 11 == 0, text("N", s("c_nationkey")))
        .otherwise(text("S", (F.col("c_custkey") % 40).cast("string"))), text("///", F.col("c_name")))
    return region.union(nation).union(supplier).union(customer)


@query("""SELECT c.parent_code, c.code AS child_code, c.name AS child_name, CAST(c.level AS BIGINT) AS child_level,
  p.name AS parent_name FROM tree c JOIN tree p ON p.code = c.parent_code""", tree=TREE)
def account_children(t):
    return acc.children(tree(t))


@query("SELECT code, name, coalesce(parent_code, '') AS parent_code FROM tree WHERE level = 3", tree=TREE)
def accounts_of_level(t):
    return acc.by_level(tree(t), 3).select("code", "name", F.coalesce("parent_code", F.lit("")).alias("parent_code"))


@query("""SELECT 'duplicate_code' AS issue_type, concat('Duplicate account code: ', code) AS message FROM tree GROUP BY code HAVING count(*) > 1
  UNION ALL SELECT 'missing_parent', concat('Account ', c.code, ' references non-existent parent: ', c.parent_code)
  FROM tree c WHERE level > 1 AND c.parent_code NOT IN (SELECT code FROM tree)
  UNION ALL SELECT 'parent_level', concat('Account ', c.code, ' (level ', CAST(c.level AS VARCHAR), ') has invalid parent level: ', CAST(p.level AS VARCHAR))
  FROM tree c JOIN (SELECT code, min(level) AS level FROM tree GROUP BY code) p ON p.code = c.parent_code
  WHERE c.level > 1 AND p.level <> c.level - 1""", tree=TREE)
def hierarchy_integrity(t):
    return acc.hierarchy_issues(tree(t)).select("issue_type", "message")


KEYS = """SELECT o_orderkey AS src_row, CASE o_orderkey % 3 WHEN 0 THEN concat('C', CAST(o_custkey AS VARCHAR))
  WHEN 1 THEN o_orderpriority ELSE (CASE o_custkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'NATION_3'
  WHEN 3 THEN 'AFRICA' ELSE 'nowhere' END) END AS account_code FROM orders"""


def account_keys(t):
    return t.read("orders").select(
        F.col("o_orderkey").alias("src_row"),
        F.expr("""CASE o_orderkey % 3 WHEN 0 THEN concat('C', CAST(o_custkey AS STRING)) WHEN 1 THEN o_orderpriority
          ELSE (CASE o_custkey % 5 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' WHEN 2 THEN 'NATION_3'
          WHEN 3 THEN 'AFRICA' ELSE 'nowhere' END) END""").alias("account_code"))


CODES = """SELECT * REPLACE (CASE WHEN level = 4 AND CAST(substr(code, 2) AS BIGINT) % 50 = 7 THEN concat('gone-', code) ELSE code END AS code) FROM tree"""


def code_tree(t):
    gone = (F.col("level") == 4) & (F.substr("code", F.lit(2)).try_cast("bigint") % 50 == 7)
    return tree(t).withColumn("code", F.when(gone, F.concat(F.lit("gone-"), "code")).otherwise(F.col("code")))


@query("""SELECT k.src_row, k.account_code, coalesce(c.code, n.code, '') AS ledger_id, coalesce(c.name, n.name, '') AS account_name,
  CAST(coalesce(c.level, n.level, 0) AS BIGINT) AS account_level FROM keys k LEFT JOIN codes c ON c.code = k.account_code
  LEFT JOIN (SELECT * FROM codes QUALIFY row_number() OVER (PARTITION BY name ORDER BY ord) = 1) n ON n.name = k.account_code""",
       tree=TREE, codes=CODES, keys=KEYS)
def account_lookup(t):
    return acc.lookup(account_keys(t), code_tree(t)).select(
        "src_row", "account_code", F.coalesce("ledger_id", F.lit("")).alias("ledger_id"),
        F.coalesce("account_name", F.lit("")).alias("account_name"),
        F.coalesce("account_level", F.lit(0)).alias("account_level"))


@query("""SELECT k.src_row, k.account_code, coalesce(c.full_path, k.account_code) AS account_path, CAST(coalesce(c.level, 0) AS BIGINT) AS level
  FROM keys k LEFT JOIN codes c ON c.code = k.account_code""", tree=TREE, codes=CODES, keys=KEYS)
def account_paths(t):
    return acc.lookup_by_code(account_keys(t), code_tree(t))
