"""Journals, rules, accounts and books derived from the driver's tables.

Every table exists twice: as a Spark DataFrame and as SQL text (`CTE`) for the comparison.
"""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.staging import settle
from ledgerloom.operators import aggregate
from ledgerloom.operators import ledger as booking
from ledgerloom.sources import journal as journal_source

# The journal over `orders`: {S} is the text type of the dialect.
JOURNAL_COLUMNS = [
    "o_orderkey AS src_row",
    """concat(CASE o_orderkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'I' WHEN 2 THEN 'B' ELSE 'W' END, '-',
       CAST(o_custkey % 12 + 1 AS {S}), '-', CAST(o_orderkey AS {S})) AS entry_id""",
    "CAST(o_orderdate + INTERVAL '24' YEAR AS DATE) AS date",
    """CASE o_orderpriority WHEN '1-URGENT' THEN 'OL' WHEN '2-HIGH' THEN 'OL-D' WHEN '3-MEDIUM' THEN '工资'
       WHEN '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN '报销' END ELSE 'RareType' END AS raw_type""",
    """CASE o_orderkey % 7 WHEN 0 THEN 'alipay wallet transfer' WHEN 1 THEN 'wechat tip'
       WHEN 2 THEN 'alipay wechat wallet payout' WHEN 3 THEN '余利宝自动转入' WHEN 4 THEN 'bank order'
       WHEN 5 THEN 'alipay' END AS raw_description""",
    """CAST(CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderstatus = 'F' THEN -o_totalprice
       ELSE o_totalprice END AS DECIMAL(18,2)) AS amount""",
]

# (rule_ord, rule_id, old_type, keyword, priority, side, account)
RULES = [
    (1, "R-001-CR", "OL", None, 10, "CR", "收入OL"), (2, "R-002-DR", "OL", None, 10, "DR", "银行存款"),
    (3, "R-003-CR", "OL", "wechat", 20, "CR", "捐赠收入"), (4, "R-004-DR", "OL", "wechat", 20, "DR", "银行存款"),
    (5, "R-005-CR", "OL-D", None, 10, "CR", "银行存款"), (6, "R-006-DR", "OL-D", None, 10, "DR", "应付OL押金"),
    (7, "R-007-CR", "工资", None, 10, "CR", "银行存款"), (8, "R-008-DR", "工资", None, 10, "DR", "组委工资"),
    (9, "R-009-CR", "报销", None, 10, "CR", "银行存款"), (10, "R-010-DR", "报销", None, 10, "DR", "no-such-account"),
]
# (ord, code, name, level, parent_code, full_path)
ACCOUNTS = [
    (0, "1000", "资产", 1, None, "资产"), (1, "1100", "银行存款", 2, "1000", "资产 > 银行存款"),
    (2, "2000", "应付款", 1, None, "应付款"), (3, "2301", "应付OL押金", 2, "2000", "应付款 > 应付OL押金"),
    (4, "3000", "权益", 1, None, "权益"), (5, "4000", "收入", 1, None, "收入"),
    (6, "4020", "捐赠收入", 2, "4000", "收入 > 捐赠收入"), (7, "4030", "投资收益", 2, "4000", "收入 > 投资收益"),
    (8, "4300", "收入OL", 2, "4000", "收入 > 收入OL"), (9, "5000", "支出", 1, None, "支出"),
    (10, "5010", "组委工资", 2, "5000", "支出 > 组委工资"),
]


def _value(v) -> str:
    if v is None:
        return "CAST(NULL AS {S})"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows, columns: str, dialect: str) -> str:
    body = ", ".join("(" + ", ".join(_value(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})".replace(
        "{S}", "STRING" if dialect == "spark" else "VARCHAR")


RULE_COLUMNS = "rule_ord, rule_id, old_type, keyword, priority, side, account"
ACCOUNT_COLUMNS = "ord, code, name, level, parent_code, full_path"


def duck(text: str) -> str:
    return text.replace("{S}", "VARCHAR")


CTE = {
    "journal": "SELECT src_row, CAST(CAST(year(date) AS INTEGER) AS VARCHAR) AS sheet, entry_id, "
               "CAST(year(date) AS INTEGER) AS year, coalesce(raw_description, '无描述') AS description, "
               "coalesce(raw_type, '__MISSING_TYPE__') AS old_type, amount, date, "
               "CAST(quarter(date) AS INTEGER) AS quarter, raw_type, raw_description "
               "FROM (SELECT " + ", ".join(duck(c) for c in JOURNAL_COLUMNS) + " FROM orders)",
    "entries": "SELECT * FROM journal WHERE NOT (amount = 0 OR contains(description, '余利宝-基金赎回') "
               "OR contains(description, '余利宝自动转入'))",
    "rules": values(RULES, RULE_COLUMNS, "duck"),
    "accounts": values(ACCOUNTS, ACCOUNT_COLUMNS, "duck"),
    "hits": "SELECT e.src_row, r.side, r.rule_ord, row_number() OVER (PARTITION BY e.src_row, r.side "
            "ORDER BY r.priority DESC, r.rule_ord) AS rn FROM entries e JOIN rules r ON r.old_type = e.old_type "
            "AND (r.keyword IS NULL OR contains(e.description, r.keyword))",
    "picked": "SELECT src_row, max(CASE WHEN side = 'CR' THEN rule_ord END) AS cr_ord, "
              "max(CASE WHEN side = 'DR' THEN rule_ord END) AS dr_ord FROM hits WHERE rn = 1 GROUP BY src_row",
    "records": "SELECT e.*, c.rule_id AS cr_id, c.account AS cr_account, d.rule_id AS dr_id, d.account AS dr_account, "
               "ca.code AS cr_code, ca.full_path AS cr_path, da.code AS dr_code, da.full_path AS dr_path, "
               "c.rule_id IS NULL AND d.rule_id IS NULL AS no_match, "
               "e.old_type = 'OL' AND e.amount > 0 AND e.year = 2024 AND ca.code IS NOT NULL AND da.code IS NOT NULL AS splits, "
               "CASE WHEN contains(e.old_type, '押金') OR contains(lower(e.old_type), 'ol-d') THEN e.amount >= 0 "
               "ELSE e.amount < 0 AND coalesce(ca.code LIKE '4%', FALSE) END AS swaps "
               "FROM entries e LEFT JOIN picked p ON p.src_row = e.src_row LEFT JOIN rules c ON c.rule_ord = p.cr_ord "
               "LEFT JOIN rules d ON d.rule_ord = p.dr_ord LEFT JOIN accounts ca ON ca.name = c.account "
               "LEFT JOIN accounts da ON da.name = d.account",
    "ledger": """
      SELECT src_row, 1 AS line_no, concat('LE-', entry_id, '-', cr_id) AS entry_id, cr_account AS account_code,
        cr_path AS account_path, CAST(abs(amount) AS DECIMAL(18,2)) AS amount, date, description,
        entry_id AS source_entry_id, cr_id AS rule_applied, quarter, year,
        CASE WHEN swaps THEN 'DR' ELSE 'CR' END AS ledger_type
      FROM records WHERE NOT splits AND cr_path IS NOT NULL
      UNION ALL
      SELECT src_row, CASE WHEN splits THEN 1 ELSE 2 END, concat('LE-', entry_id, '-', dr_id), dr_account, dr_path,
        CAST(abs(amount) AS DECIMAL(18,2)), date, description, entry_id, dr_id, quarter, year,
        CASE WHEN swaps THEN 'CR' ELSE 'DR' END
      FROM records WHERE dr_path IS NOT NULL
      UNION ALL
      SELECT src_row, 2, concat('LE-', entry_id, '-', cr_id, '-OL'), cr_account, cr_path,
        CAST(amount - least(150, amount) AS DECIMAL(18,2)), date, description, entry_id, cr_id, quarter, year, 'CR'
      FROM records WHERE splits
      UNION ALL
      SELECT src_row, 3, concat('LE-', entry_id, '-', cr_id, '-OL-D'), '应付OL押金', '应付款 > 应付OL押金',
        CAST(least(150, amount) AS DECIMAL(18,2)), date, description, entry_id, cr_id, quarter, year, 'CR'
      FROM records WHERE splits""",
    "placeholders": """
      SELECT src_row, n AS line_no, concat('LE-', entry_id, '-NO_MATCH-', side) AS entry_id, 'UNMATCHED' AS account_code,
        'Unmatched (no mapping rule) / 待匹配' AS account_path, CAST(abs(amount) AS DECIMAL(18,2)) AS amount, date,
        description, entry_id AS source_entry_id, 'NO_MATCH' AS rule_applied, quarter, year, side AS ledger_type
      FROM records, (VALUES (1, 'DR'), (2, 'CR')) AS s(n, side) WHERE no_match""",
    "all_lines": "SELECT * FROM ledger UNION ALL SELECT * FROM placeholders",
    "named": "SELECT l.*, coalesce(c.code, n.code) AS ledger_id, coalesce(c.name, n.name) AS account_name, "
             "coalesce(c.level, n.level) AS account_level FROM ledger l LEFT JOIN accounts c ON c.code = l.account_code "
             "LEFT JOIN accounts n ON n.name = l.account_code",
    "quarterly": "SELECT account_code, quarter, year, sum(CASE WHEN ledger_type = 'CR' THEN amount ELSE 0 END) AS cr, "
                 "sum(CASE WHEN ledger_type = 'DR' THEN amount ELSE 0 END) AS dr, count(*) AS n "
                 "FROM ledger GROUP BY account_code, quarter, year",
    # Larger journals: events (ids repeat) and line items.
    "event_entries": "SELECT event_id AS src_row, concat('U', CAST(user_id AS VARCHAR), '-', event_type) AS entry_id, "
                     "CAST(year(ts) AS INTEGER) AS year, event_type AS description, event_type AS old_type, "
                     "CAST(round(value) AS DECIMAL(18,2)) AS amount, CAST(ts AS DATE) AS date, "
                     "CAST(quarter(ts) AS INTEGER) AS quarter FROM events",
}
ORDER = list(CTE)
NEEDS = {
    "journal": [], "entries": ["journal"], "rules": [], "accounts": [], "hits": ["entries", "rules"],
    "picked": ["hits"], "records": ["picked", "entries", "accounts", "rules"], "ledger": ["records"],
    "placeholders": ["records"], "all_lines": ["ledger", "placeholders"], "named": ["ledger", "accounts"],
    "quarterly": ["ledger"], "event_entries": [],
}


def with_tables(sql: str, *names: str, **extra: str) -> str:
    """The statement with the named tables (and what they need) in front; extras come last."""
    wanted: set = set()

    def need(name):
        if name not in wanted:
            wanted.add(name)
            for n in NEEDS[name]:
                need(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTE[n]})" for n in ORDER if n in wanted] + [f"{n} AS ({s})" for n, s in extra.items()]
    return ("WITH " + ", ".join(parts) + " " if parts else "") + sql


def tidy(df: DataFrame) -> DataFrame:
    """Plain result types: whole numbers as bigint, money as double, dates as text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd")
        out.append(c.alias(f.name))
    return df.select(*out)


class Tables:
    """The driver's tables under one directory, and what is derived from them."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return self.read("orders").selectExpr(*[c.replace("{S}", "STRING") for c in JOURNAL_COLUMNS])

    @cached_property
    def journal(self) -> DataFrame:
        return self.raw.select(
            "src_row", F.year("date").cast("string").alias("sheet"), "entry_id", F.year("date").alias("year"),
            F.coalesce("raw_description", F.lit("无描述")).alias("description"),
            F.coalesce("raw_type", F.lit("__MISSING_TYPE__")).alias("old_type"), "amount", "date",
            F.quarter("date").alias("quarter"), F.lit(None).cast("string").alias("notes"))

    @cached_property
    def entries(self) -> DataFrame:
        return journal_source.drop_skipped(self.journal)

    @cached_property
    def rules(self) -> DataFrame:
        return self.rule_table(RULES)

    def rule_table(self, rows) -> DataFrame:
        base = self.spark.sql(values(rows, RULE_COLUMNS, "spark"))
        condition = F.concat(F.lit('old_type == "'), F.col("old_type"), F.lit('"'), F.coalesce(
            F.concat(F.lit(' and "'), F.col("keyword"), F.lit('" in description')), F.lit("")))
        return base.select(
            F.col("rule_ord").cast("bigint").alias("rule_ord"), "rule_id", condition.alias("condition"),
            F.col("account").alias("account_code"), "priority", "old_type", F.lit(None).cast("string").alias("new_type"),
            F.concat(F.lit("Map "), F.col("old_type"), F.lit(" to "), F.col("account")).alias("description"),
            F.lit(False).alias("generates_multiple"), F.col("side").alias("ledger_type"))

    def free_rules(self, rows) -> DataFrame:
        """(rule_ord, rule_id, condition, account, priority, old_type, side) with free conditions."""
        base = self.spark.sql(values(rows, "rule_ord, rule_id, condition, account_code, priority, old_type, ledger_type", "spark"))
        return base.select(
            F.col("rule_ord").cast("bigint").alias("rule_ord"), "rule_id", "condition", "account_code", "priority",
            "old_type", F.lit(None).cast("string").alias("new_type"), F.lit("").alias("description"),
            F.lit(False).alias("generates_multiple"), "ledger_type")

    @cached_property
    def accounts(self) -> DataFrame:
        return self.spark.sql(values(ACCOUNTS, ACCOUNT_COLUMNS, "spark")).withColumn("ord", F.col("ord").cast("bigint"))

    @cached_property
    def records(self) -> DataFrame:
        return booking.book(self.entries, self.rules, self.accounts)

    def settled(self) -> "Tables":
        """The same tables with the booked rows, and the entries in them, written once, for results that read them often."""
        self.records = settle(booking.for_lines(self.records), "booked")
        self.entries = self.records.select(*self.entries.columns)
        return self

    @cached_property
    def ledger(self) -> DataFrame:
        return booking.ledger(self.records)

    @cached_property
    def unmatched(self) -> DataFrame:
        return booking.unmatched(self.records)

    @cached_property
    def quarterly(self) -> DataFrame:
        return aggregate.quarterly(self.ledger, self.accounts)

    @cached_property
    def event_entries(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("src_row"),
            F.concat(F.lit("U"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("entry_id"),
            F.year("ts").alias("year"), F.col("event_type").alias("description"), F.col("event_type").alias("old_type"),
            F.round("value").cast("decimal(18,2)").alias("amount"), F.to_date("ts").alias("date"),
            F.quarter("ts").alias("quarter"), F.lit(None).cast("string").alias("notes"))


QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None, *tables: str, **extra: str):
    """Register a query under the name of its function, with its SQL when there is one."""
    def register(fn):
        QUERIES[fn.__name__] = lambda spark, directory: tidy(fn(Tables(spark, directory)))
        if sql is not None:
            ORACLE[fn.__name__] = with_tables(sql, *tables, **extra)
        return fn
    return register
