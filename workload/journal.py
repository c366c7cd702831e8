"""Journal scans and the checks before and after booking."""

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import aggregate as agg
from ledgerloom.operators import issue_tables as issues
from ledgerloom.operators import ledger as booking
from ledgerloom.operators import quality_input as qi
from ledgerloom.operators import quality_output as qo
from ledgerloom.plans import pipeline
from ledgerloom.sources import journal as source

from .tables import JOURNAL_COLUMNS, duck, query

RAW = "SELECT " + ", ".join(duck(c) for c in JOURNAL_COLUMNS) + " FROM orders"
# The journal as text: cells padded with all kinds of white space, ten date spellings, split amounts, broken cells.
TEXT_COLUMNS = {
    "row_no": "src_row",
    "编号": "CASE WHEN src_row % 53 = 0 THEN NULL WHEN src_row % 3 = 0 THEN concat('\t', entry_id, '\u00a0') ELSE concat(' ', entry_id, '\u3000') END",
    "摘要": "CASE WHEN src_row % 3 = 1 THEN concat('\u00a0', raw_description, '\n') ELSE raw_description END",
    "类型": "CASE WHEN raw_type IS NULL THEN NULL WHEN src_row % 3 = 2 THEN concat('\u3000', raw_type, '\t') ELSE concat(raw_type, ' ') END",
    "日期": """CASE WHEN src_row % 67 = 0 THEN NULL WHEN src_row % 71 = 0 THEN 'n/a'
        WHEN src_row % 10 = 0 THEN CAST(date AS {S}) WHEN src_row % 10 = 1 THEN replace(CAST(date AS {S}), '-', '/')
        WHEN src_row % 5 < 2 THEN concat(CAST(year(date) AS {S}), CASE src_row % 5 WHEN 0 THEN '-' ELSE '/' END, CAST(month(date) AS {S}),
          CASE src_row % 5 WHEN 0 THEN '-' ELSE '/' END, CAST(day(date) AS {S}))
        WHEN src_row % 5 = 2 THEN concat(CAST(month(date) AS {S}), '/', CAST(day(date) AS {S}), '/', CAST(year(date) AS {S}))
        WHEN src_row % 5 = 3 THEN concat(CAST(day(date) AS {S}), '/', CAST(month(date) AS {S}), '/', CAST(year(date) AS {S}))
        WHEN src_row % 4 = 0 THEN concat(CAST(date AS {S}), ' 00:00:00') WHEN src_row % 4 = 1 THEN concat(CAST(date AS {S}), 'T00:00:00')
        WHEN src_row % 4 = 2 THEN replace(CAST(date AS {S}), '-', '') ELSE replace(CAST(date AS {S}), '-', '.') END""",
    "收入": """CASE WHEN src_row % 31 = 0 THEN NULL WHEN src_row % 89 = 0 THEN 'abc'
        WHEN amount >= 0 THEN CAST(amount AS {S}) END""",
    "支出": "CASE WHEN src_row % 31 <> 0 AND amount < 0 THEN CAST(-amount AS {S}) END",
    "理财": "CASE WHEN src_row % 31 = 0 THEN CAST(amount AS {S}) END",
    "季度": """CASE WHEN src_row % 79 = 0 THEN 'x' WHEN src_row % 83 = 0 THEN '5' WHEN src_row % 3 = 0 THEN NULL
        ELSE concat(CAST(quarter(date) AS {S}), '.0') END""",
    "备注": "CASE WHEN src_row % 4 = 0 THEN ' memo ' END",
}


def text_journal(t):
    return t.raw.selectExpr(*[f"{e.replace('{S}', 'STRING')} AS `{c}`" for c, e in TEXT_COLUMNS.items()])


def parsed(t):
    return source.parse_journal(text_journal(t), "row_no")


EXPECTED = f"""SELECT *, CASE WHEN src_row % 5 = 3 AND src_row % 67 <> 0 AND src_row % 71 <> 0 AND day(date) <= 12
    THEN make_date(year(date), day(date), month(date)) ELSE date END AS read_date,
  concat('Row ', CAST(src_row + 1 AS VARCHAR), ': ') AS label,
  CASE WHEN src_row % 67 = 0 THEN 'Missing required field ''date'' (column: 日期)'
    WHEN src_row % 71 = 0 THEN 'Invalid date format in column ''日期'': n/a'
    WHEN src_row % 79 = 0 THEN 'Invalid quarter in column ''季度'': x'
    WHEN src_row % 89 = 0 AND src_row % 31 <> 0 THEN 'Unexpected error: could not convert string to float'
    WHEN src_row % 83 = 0 THEN 'Validation error - quarter: Input should be less than or equal to 4' END AS err
  FROM ({RAW}) WHERE src_row % 53 <> 0"""


@query("""SELECT src_row, entry_id, CAST(year(read_date) AS BIGINT) AS year, coalesce(raw_description, '无描述') AS description,
  coalesce(raw_type, '__MISSING_TYPE__') AS old_type, CAST(amount AS DOUBLE) AS amount,
  strftime(read_date, '%Y-%m-%d') AS date, CAST(CASE WHEN src_row % 3 = 0 THEN 0 ELSE quarter(date) END AS BIGINT) AS quarter,
  CASE WHEN src_row % 4 = 0 THEN 'memo' ELSE '' END AS notes FROM expected WHERE err IS NULL""", expected=EXPECTED)
def journal_normalized(t):
    return source.accepted(parsed(t)).drop("sheet").withColumns({
        "quarter": F.coalesce("quarter", F.lit(0)), "notes": F.coalesce("notes", F.lit(""))})


@query("""SELECT src_row, entry_id, concat(label, coalesce(err, 'Missing required field ''old_type'' (column: 类型)')) AS message,
  err IS NOT NULL AS rejected FROM expected WHERE err IS NOT NULL OR raw_type IS NULL""", expected=EXPECTED)
def journal_row_issues(t):
    return source.row_issues(parsed(t))


@query(f"""SELECT src_row, CAST(CASE WHEN src_row % 89 = 0 AND src_row % 31 <> 0 THEN least(amount, 0) ELSE amount END AS DOUBLE)
  AS amount FROM ({RAW})""")
def signed_amount(t):
    number = lambda c: text.to_double(F.col(c))
    return text_journal(t).select(F.col("row_no").alias("src_row"), source.signed_amount(
        number("收入"), number("支出"), number("理财")).alias("amount"))


DAY_FIRST = """CASE WHEN src_row % 5 = 2 AND day(date) <= 12 THEN make_date(year(date), day(date), month(date)) ELSE date END"""


@query(f"""SELECT src_row, CASE WHEN src_row % 67 = 0 OR src_row % 71 = 0 THEN '' ELSE strftime(CASE WHEN src_row % 5 = 3 AND day(date) <= 12
  THEN make_date(year(date), day(date), month(date)) ELSE date END, '%Y-%m-%d') END AS month_first,
  CASE WHEN src_row % 67 = 0 OR src_row % 71 = 0 OR src_row % 5 = 4 THEN '' ELSE strftime({DAY_FIRST}, '%Y-%m-%d') END AS day_first
  FROM ({RAW})""")
def date_formats(t):
    def read(formats):
        return F.coalesce(F.date_format(text.parse_date(F.col("日期"), formats), "yyyy-MM-dd"), F.lit(""))
    return text_journal(t).select(
        F.col("row_no").alias("src_row"), read(text.READER_DATE_FORMATS).alias("month_first"),
        read(text.MODEL_DATE_FORMATS).alias("day_first"))


@query("SELECT src_row, entry_id, description, CAST(amount AS DOUBLE) AS amount FROM entries", "entries")
def skip_filter(t):
    return t.entries.select("src_row", "entry_id", "description", "amount")


SHEETS = """SELECT *, CASE WHEN src_row % 19 = 0 THEN 'notes' WHEN src_row % 17 = 0 THEN CAST(year(date) + 1 AS VARCHAR)
  ELSE CAST(year(date) AS VARCHAR) END AS sheet_name FROM journal"""


def sheets(t):
    return t.journal.withColumn("sheet", F.expr(
        """CASE WHEN src_row % 19 = 0 THEN 'notes' WHEN src_row % 17 = 0 THEN CAST(year(date) + 1 AS STRING)
        ELSE CAST(year(date) AS STRING) END"""))


@query("""SELECT sheet_name AS sheet, count(*) AS n_rows FROM sheets WHERE regexp_full_match(sheet_name, '20[0-9][0-9]')
  GROUP BY 1 ORDER BY 1""", "journal", sheets=SHEETS)
def sheet_selection(t):
    return source.sheet_names(sheets(t))


BAD_SHEETS = "SELECT * FROM sheets WHERE TRY_CAST(sheet_name AS INTEGER) <> year"


@query("""SELECT sheet, n_mismatched, sample_ids, concat('工作表“', sheet, '”中发现 ', CAST(n_mismatched AS VARCHAR),
  ' 条日期年份不一致的条目：条目日期年份 != ', sheet, '。 示例 entry_id: ', sample_ids) AS message FROM (
  SELECT sheet_name AS sheet, count(*) AS n_mismatched, string_agg(entry_id, ', ' ORDER BY src_row) FILTER (rn <= 5) AS sample_ids
  FROM (SELECT *, row_number() OVER (PARTITION BY sheet_name ORDER BY src_row) AS rn FROM bad) GROUP BY 1)""",
       "journal", sheets=SHEETS, bad=BAD_SHEETS)
def year_guard_report(t):
    return source.year_guard_report(sheets(t))


@query("SELECT src_row, entry_id, sheet_name AS sheet FROM sheets WHERE src_row NOT IN (SELECT src_row FROM bad)",
       "journal", sheets=SHEETS, bad=BAD_SHEETS)
def year_guard_lenient(t):
    return source.year_guard(sheets(t), strict=False).select("src_row", "entry_id", "sheet")


# The oldest layout: one column per side, free types, dates of which some are missing.
OLD_COLUMNS = {
    "row_no": "src_row", "ID": "CASE WHEN src_row % 53 = 0 THEN NULL ELSE entry_id END",
    "Type": "CASE src_row % 6 WHEN 0 THEN 'OL-奖学金' WHEN 1 THEN '工资' WHEN 2 THEN '书院' WHEN 3 THEN '播客' WHEN 4 THEN 'unknown' END",
    "摘要": "CASE WHEN src_row % 7 = 5 THEN '' ELSE raw_description END",
    "日期": "CASE WHEN src_row % 67 = 0 THEN NULL ELSE date END",
    "收入": "CASE WHEN amount > 0 THEN CAST(amount AS DOUBLE) END", "支出": "CASE WHEN amount < 0 THEN CAST(-amount AS DOUBLE) END",
    "领款人": "CASE WHEN src_row % 2 = 0 THEN 'payee' END", "对方账户": "CASE WHEN src_row % 3 = 0 THEN 'bank' END",
}


@query(f"""SELECT src_row, entry_id, CAST(year(date) AS BIGINT) AS year, CASE WHEN src_row % 7 IN (5, 6) THEN '无描述' ELSE raw_description END AS description,
  CASE src_row % 6 WHEN 1 THEN 'CR' WHEN 2 THEN 'DR' WHEN 3 THEN 'DR' ELSE 'OL' END AS old_type, CAST(amount AS DOUBLE) AS amount,
  CAST(date AS VARCHAR) AS date, CAST(quarter(date) AS BIGINT) AS quarter,
  concat(CASE WHEN src_row % 2 = 0 THEN 'payee' ELSE '' END, ' | ', CASE WHEN src_row % 3 = 0 THEN 'bank' ELSE '' END) AS notes
  FROM ({RAW}) WHERE src_row % 53 <> 0 AND src_row % 67 <> 0 AND amount <> 0""")
def raw_journal(t):
    return source.parse_raw_journal(t.raw.selectExpr(*[f"{e} AS `{c}`" for c, e in OLD_COLUMNS.items()]), "row_no")


# A journal table with holes, odd years and odd quarters.
LOOSE_COLUMNS = {
    "src_row": "src_row", "entry_id": "entry_id",
    "year": "CASE WHEN src_row % 11 = 0 THEN NULL WHEN src_row % 13 = 0 THEN 1999 WHEN src_row % 17 = 0 THEN 2999 ELSE 2024 END",
    "description": "CASE WHEN src_row % 19 = 0 THEN '' ELSE raw_description END", "old_type": "raw_type",
    "amount": "CASE WHEN src_row % 23 = 0 THEN 'many' WHEN src_row % 29 = 0 THEN NULL ELSE CAST(amount AS {S}) END",
    "date": "CASE WHEN src_row % 31 = 0 THEN NULL WHEN src_row % 37 = 0 THEN 'soon' ELSE CAST(date AS {S}) END",
    "quarter": "CASE WHEN src_row % 41 = 0 THEN '0' WHEN src_row % 43 = 0 THEN '7' WHEN src_row % 47 = 0 THEN 'q' ELSE '2' END",
}
LOOSE = "SELECT " + ", ".join(f"{duck(e)} AS {c}" for c, e in LOOSE_COLUMNS.items()) + \
    f", date AS real_date FROM ({RAW})"


def loose(t):
    return t.raw.selectExpr(*[f"{e.replace('{S}', 'STRING')} AS {c}" for c, e in LOOSE_COLUMNS.items()])


@query("""SELECT src_row, src_row + 2 AS row_number, field_name, concat('Required field ''', field_name, ''' is null or empty') AS message FROM (
  SELECT src_row, 'year' AS field_name FROM loose WHERE year IS NULL UNION ALL SELECT src_row, 'description' FROM loose WHERE description IS NULL
  UNION ALL SELECT src_row, 'old_type' FROM loose WHERE old_type IS NULL UNION ALL SELECT src_row, 'amount' FROM loose WHERE amount IS NULL
  UNION ALL SELECT src_row, 'date' FROM loose WHERE date IS NULL)""", loose=LOOSE)
def required_nulls(t):
    return qi.null_issues(loose(t)).select("src_row", "row_number", "field_name", "message")


LOOSE_TYPED = """SELECT *, TRY_CAST(amount AS DECIMAL(18,2)) AS amt, CASE WHEN date IS NOT NULL AND date <> 'soon' THEN real_date END AS day,
  TRY_CAST(quarter AS INTEGER) AS q FROM loose"""
LOOSE_YEAR = "CASE WHEN year IS NULL THEN year(day) WHEN year < 2000 OR year > 2100 THEN coalesce(year(day), greatest(2000, least(year, 2100))) ELSE year END"


@query(f"""SELECT src_row, field_name, issue_type FROM (
  SELECT src_row, 'description' AS field_name, CASE WHEN description IS NULL THEN 'string_type' WHEN description = '' THEN 'string_too_short' END AS issue_type FROM typed
  UNION ALL SELECT src_row, 'old_type', CASE WHEN old_type IS NULL THEN 'string_type' END FROM typed
  UNION ALL SELECT src_row, 'year', CASE WHEN {LOOSE_YEAR} IS NULL THEN 'int_type' END FROM typed
  UNION ALL SELECT src_row, 'amount', CASE WHEN amt IS NULL THEN 'decimal_type' END FROM typed
  UNION ALL SELECT src_row, 'date', CASE WHEN day IS NULL THEN 'value_error' END FROM typed
  UNION ALL SELECT src_row, 'quarter', CASE WHEN q IS NULL THEN 'int_parsing' WHEN q < 1 THEN 'greater_than_equal' WHEN q > 4 THEN 'less_than_equal' END FROM typed)
  WHERE issue_type IS NOT NULL""", loose=LOOSE, typed=LOOSE_TYPED)
def field_checks(t):
    return qi.field_issues(loose(t)).select("src_row", "field_name", "issue_type")


@query(f"""SELECT src_row, entry_id, CAST({LOOSE_YEAR} AS BIGINT) AS year, CAST(amt AS DOUBLE) AS amount, CAST(day AS VARCHAR) AS date FROM typed
  WHERE description <> '' AND old_type IS NOT NULL AND amt IS NOT NULL AND day IS NOT NULL AND q BETWEEN 1 AND 4""",
       loose=LOOSE, typed=LOOSE_TYPED)
def valid_rows(t):
    return qi.valid_rows(loose(t)).select("src_row", "entry_id", "year", "amount", "date")


BIG = "SELECT * REPLACE (CAST(amount * 5000 AS DECIMAL(18,2)) AS amount) FROM journal"


def big(t):
    return t.journal.withColumn("amount", (F.col("amount") * 5000).cast("decimal(18,2)"))


WARNINGS = """SELECT src_row, entry_id, 'amount' AS field_name, 'zero_amount' AS issue_type FROM {0} WHERE amount = 0
  UNION ALL SELECT src_row, entry_id, 'amount', 'large_amount' FROM {0} WHERE abs(amount) > 1000000000
  UNION ALL SELECT src_row, entry_id, 'date', 'future_date' FROM {0} WHERE date > DATE '2025-01-01'"""


def as_of():
    return F.lit("2025-01-01").cast("timestamp_ntz")


@query(WARNINGS.format("big"), "journal", big=BIG)
def business_warnings(t):
    return qi.business_warnings(big(t), as_of()).select("src_row", "entry_id", "field_name", "issue_type")


@query("""SELECT src_row, entry_id, field_name, concat(CASE field_name WHEN 'old_type' THEN 'Old type' ELSE 'Description' END, ' cannot be empty') AS message
  FROM (SELECT o_orderkey AS src_row, CAST(o_orderkey AS VARCHAR) AS entry_id, 'description' AS field_name FROM orders WHERE o_orderkey % 9 = 0
  UNION ALL SELECT o_orderkey, CAST(o_orderkey AS VARCHAR), 'old_type' FROM orders WHERE o_orderkey % 10 = 0)""")
def blank_fields(t):
    rows = t.journal.select(
        "src_row", F.col("src_row").cast("string").alias("entry_id"),
        F.when(F.col("src_row") % 9 == 0, "  ").otherwise(F.col("description")).alias("description"),
        F.when(F.col("src_row") % 10 == 0, "").otherwise(F.col("old_type")).alias("old_type"))
    return qi.blank_issues(rows).select("src_row", "entry_id", "field_name", "message")


@query("""SELECT 'mixed_years' AS issue_type, concat('Entries span multiple years: [', string_agg(y, ', ' ORDER BY y), ']. Please verify this is intentional.') AS message
  FROM (SELECT DISTINCT CAST(year AS VARCHAR) AS y FROM journal)
  UNION ALL SELECT 'mixed_quarters', concat('Entries span multiple quarters: [', string_agg(q, ', ' ORDER BY q), ']. Please verify this is intentional.')
  FROM (SELECT DISTINCT CAST(quarter AS VARCHAR) AS q FROM journal)""", "journal")
def mixed_periods(t):
    return qi.mixed_period_warnings(t.journal).select("issue_type", "message")


@query("""SELECT name AS field_name, concat('Required column ''', name, ''' is missing') AS message
  FROM (VALUES ('amount'), ('date')) AS t(name) WHERE EXISTS (SELECT 1 FROM orders)""")
def structure_checks(t):
    return qi.structure_issues(t.journal.drop("amount", "date")).select("field_name", "message")


@query("""SELECT src_row, entry_id, concat('Duplicate entry ID ''', entry_id, '''. Each entry must have a unique ID.') AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY src_row) AS rn FROM event_entries) WHERE rn > 1""", "event_entries")
def duplicate_ids(t):
    return qi.duplicate_id_issues(t.event_entries).select("src_row", "entry_id", "message")


GROUPS = "SELECT *, count(*) OVER (PARTITION BY year, description, date, amount) AS n FROM event_entries"


@query("""SELECT a.src_row, a.entry_id, concat('Duplicate entry found. Same (year, description, date, amount) as other entries: ',
  CAST(a.n - 1 AS VARCHAR), ' rows of group ', sha256(concat_ws(chr(1), CAST(a.year AS VARCHAR), a.description, CAST(a.date AS VARCHAR),
  CAST(a.amount AS VARCHAR)))) AS message FROM g a WHERE a.n > 1""",
       "event_entries", g=GROUPS)
def duplicate_rows(t):
    return qi.duplicate_row_issues(t.event_entries).select("src_row", "entry_id", "message")


@query("""SELECT src_row, entry_id, n AS group_size, CAST(amount AS DOUBLE) AS amount, CAST(date AS VARCHAR) AS date FROM g WHERE n > 1""",
       "event_entries", g=GROUPS)
def duplicate_members(t):
    return qi.duplicate_members(t.event_entries).select("src_row", "entry_id", "group_size", "amount", "date")


UNMATCHED_TYPES = """SELECT src_row, entry_id, concat('Old type ''', old_type, ''' in entry does not match any mapping rule. Entry may not be processed correctly.') AS message
  FROM {0} WHERE old_type NOT IN (SELECT old_type FROM rules)"""


@query(UNMATCHED_TYPES.format("journal"), "journal", "rules")
def unmatched_types(t):
    return qi.unmatched_type_issues(t.journal, t.rules).select("src_row", "entry_id", "message")


RULE_ACCOUNT = """SELECT rule_id AS entry_id, 'error' AS kind, 'invalid_account_code' AS issue_type FROM rules
  WHERE account NOT IN (SELECT code FROM accounts UNION ALL SELECT name FROM accounts)"""
INPUT = f"""SELECT entry_id, CASE WHEN issue_type IN ('zero_amount', 'large_amount', 'future_date') THEN 'warning' ELSE 'error' END AS kind, issue_type FROM (
  SELECT entry_id, issue_type FROM ({WARNINGS.format("journal")}) UNION ALL
  SELECT entry_id, 'unmatched_type' FROM ({UNMATCHED_TYPES.format("journal")}))
  UNION ALL {RULE_ACCOUNT} UNION ALL SELECT '', 'warning', 'mixed_years' UNION ALL SELECT '', 'warning', 'mixed_quarters'"""


def input_issues(t):
    return qi.validate_inputs(t.journal, t.rules, t.accounts, as_of())


@query("SELECT * FROM input", "journal", "rules", "accounts", input=INPUT)
def input_validation(t):
    return input_issues(t).select(F.coalesce("entry_id", F.lit("")).alias("entry_id"), "kind", "issue_type")


@query("""SELECT (SELECT count(*) FROM journal) + count(*) FILTER (kind = 'error' AND entry_id LIKE 'A-%') AS entries_processed,
  (SELECT count(*) FROM rules) + count(*) FILTER (kind = 'error' AND entry_id LIKE 'R-%') AS rules_processed,
  count(*) FILTER (kind = 'error') AS error_count, count(*) FILTER (kind <> 'error') AS warning_count FROM input""",
       "journal", "rules", "accounts", input=INPUT)
def processed_counts(t):
    return qi.processed_counts(input_issues(t), t.journal, t.rules, entry_prefix="A-")


DETECTED = """SELECT entry_id, CASE WHEN entry_id LIKE 'R-%' THEN '' ELSE entry_id END AS e_id, CASE WHEN entry_id LIKE 'R-%' THEN entry_id ELSE '' END AS r_id,
  issue_type, 'error' AS severity
  FROM input WHERE kind = 'error'"""


@query("SELECT e_id AS entry_id, r_id AS rule_id, 'data_error' AS error_type, issue_type, severity, TRUE AS requires_review FROM detected",
       "journal", "rules", "accounts", input=INPUT, detected=DETECTED)
def detected_issues(t):
    return issues.detect(input_issues(t)).select(
        F.coalesce("entry_id", F.lit("")).alias("entry_id"), F.coalesce("rule_id", F.lit("")).alias("rule_id"),
        "error_type", "issue_type", "severity", "requires_review")


def event_issues(t):
    kind = F.expr("""CASE event_type WHEN 'click' THEN 'Data_Loss' WHEN 'view' THEN 'missing_field'
      WHEN 'signup' THEN 'unusual_amount' WHEN 'error' THEN 'other' ELSE 'Transformation_Failure_warning' END""")
    return t.read("events").select(
        F.lit("error").alias("kind"), F.col("event_id").alias("src_row"), F.lit(0).cast("bigint").alias("row_number"),
        F.lit("amount").alias("field_name"), kind.alias("issue_type"), F.col("event_type").alias("message"),
        F.col("value").cast("string").alias("actual_value"),
        F.concat(F.when(F.col("user_id") % 3 == 0, "R-").otherwise("JE-"), F.col("user_id").cast("string")).alias("entry_id"))


SEV = """CASE WHEN event_type IN ('click', 'purchase') THEN 'critical' WHEN event_type = 'view' THEN 'error'
  WHEN event_type = 'signup' THEN 'warning' ELSE 'info' END"""


@query(f"SELECT {SEV} AS severity, event_type AS error_message, count(*) AS count FROM events GROUP BY ALL")
def issue_severity(t):
    return issues.detect(event_issues(t), "rule_error", default="info").groupBy("severity", "error_message").agg(
        F.count(F.lit(1)).alias("count"))


@query(f"SELECT event_id AS src_row FROM events WHERE {SEV} = 'critical' AND user_id = 6")
def issue_filter(t):
    """Critical issues of one rule."""
    return issues.of(issues.detect(event_issues(t), default="info"), severity="critical", rule_id="R-6").select("src_row")


@query("SELECT concat('R-', CAST(user_id AS VARCHAR)) AS group_key, count(*) AS count FROM events WHERE user_id % 3 = 0 GROUP BY 1")
def issue_groups_by_rule(t):
    return issues.groups(issues.detect(event_issues(t)), "rule_id")


@query("SELECT concat('JE-', CAST(user_id AS VARCHAR)) AS group_key, count(*) AS count FROM events WHERE user_id % 3 <> 0 GROUP BY 1")
def issue_groups_by_entry(t):
    return issues.groups(issues.detect(event_issues(t)), "entry_id")


@query(f"SELECT {SEV} AS group_key, count(*) AS count FROM events GROUP BY 1")
def issue_groups_by_severity(t):
    return issues.groups(issues.detect(event_issues(t), default="info"), "severity")


@query(f"""SELECT count(*) AS total_errors, CAST(0 AS BIGINT) AS data_error, count(*) AS rule_error, CAST(0 AS BIGINT) AS transformation_error, CAST(0 AS BIGINT) AS output_error,
  count(*) FILTER ({SEV} = 'critical') AS severity_critical, count(*) FILTER ({SEV} = 'error') AS severity_error,
  count(*) FILTER ({SEV} = 'warning') AS severity_warning, count(*) FILTER ({SEV} = 'info') AS severity_info, count(*) AS requires_review,
  count(DISTINCT CASE WHEN user_id % 3 <> 0 THEN user_id END) AS unique_entries_with_errors,
  count(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id END) AS unique_rules_with_errors,
  (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) AS total_warnings FROM events""")
def issue_summary(t):
    warned = issues.warnings(qi.business_warnings(t.journal, F.lit("2100-01-01").cast("timestamp_ntz")))
    return issues.summary(issues.detect(event_issues(t), "rule_error", default="info"), warned)


@query(f"""WITH s AS (SELECT (SELECT count(*) FROM lineitem) AS n, (SELECT count(*) FROM events) AS e,
  (SELECT count(*) FROM events WHERE {SEV} = 'critical') AS c, (SELECT count(*) FROM orders WHERE o_orderkey % 97 = 0) AS w),
  b AS (SELECT *, greatest(0.0, 1.0 - CAST(e AS DOUBLE) / n) * CASE WHEN c > 0 THEN 0.5 ELSE 1.0 END
    * (1.0 - least(CAST(0.2 AS DOUBLE), CAST(w AS DOUBLE) / n * 0.5)) AS score FROM s)
  SELECT 'fail' AS overall_status, 'red' AS status_indicator, n AS entries_processed, n - e AS entries_valid, e AS errors_found, w AS warnings_found,
  CAST(e AS DOUBLE) / n AS error_rate, CAST(score AS DOUBLE) AS confidence,
  CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence_level FROM b""")
def validation_confidence(t):
    warned = issues.warnings(qi.business_warnings(t.journal, F.lit("2100-01-01").cast("timestamp_ntz")))
    found = issues.detect(event_issues(t), default="info")
    return issues.validation_summary(found, warned, t.read("lineitem"))


# A journal and a ledger that do not quite fit: some lines name unknown entries, so some entries have no line.
LOST = """SELECT * REPLACE (CASE WHEN src_row % 13 = 0 OR src_row % 11 = 0 THEN concat('X', source_entry_id) ELSE source_entry_id END AS source_entry_id)
  FROM ledger"""


def lost_ledger(t):
    return t.ledger.withColumn("source_entry_id", F.when(
        (F.col("src_row") % 13 == 0) | (F.col("src_row") % 11 == 0), F.concat(F.lit("X"), F.col("source_entry_id"))).otherwise(F.col("source_entry_id")))


@query("""SELECT 'missing_entry' AS issue_type, entry_id AS actual_value FROM entries WHERE entry_id NOT IN (SELECT source_entry_id FROM lost)
  UNION ALL SELECT DISTINCT 'orphaned_entry', source_entry_id FROM lost WHERE source_entry_id NOT IN (SELECT entry_id FROM entries)""",
       "ledger", lost=LOST)
def missing_and_orphans(t):
    return qo.missing_and_orphans(t.entries, lost_ledger(t)).select("issue_type", "actual_value")


@query("""SELECT DISTINCT source_entry_id AS entry_id FROM lost WHERE source_entry_id NOT IN (SELECT entry_id FROM entries)""",
       "ledger", lost=LOST)
def id_set_difference(t):
    return qo.id_difference(lost_ledger(t).select(F.col("source_entry_id").alias("entry_id")), t.entries, "entry_id")


@query("""SELECT 'invalid_account_code' AS issue_type, concat('Account code ''', account_code, ''' used in ', CAST(count(*) AS VARCHAR),
  ' ledger entry(ies) does not exist in account hierarchy. Affected source entries: ', string_agg(DISTINCT source_entry_id, ', ' ORDER BY source_entry_id) FILTER (rn <= 5)) AS message
  FROM (SELECT *, row_number() OVER (PARTITION BY account_code ORDER BY src_row, line_no) AS rn FROM all_lines
  WHERE account_code NOT IN (SELECT code FROM accounts)) GROUP BY account_code""", "all_lines", "accounts")
def unknown_accounts(t):
    return qo.unknown_account_issues(booking.ledger(t.records, True), t.accounts).select("issue_type", "message")


LATE = "SELECT * REPLACE (CASE WHEN src_row % 29 = 0 THEN CAST(date + INTERVAL '1' DAY AS DATE) ELSE date END AS date) FROM ledger"
ACC = """SELECT e.entry_id, e.amount, e.date, sum(l.amount) AS s, bool_or(l.date = e.date) AS same_day,
  string_agg(DISTINCT CAST(l.date AS VARCHAR), ', ') AS days FROM entries e JOIN late l ON l.source_entry_id = e.entry_id GROUP BY ALL"""


@query("""SELECT entry_id, 'amount_mismatch' AS issue_type, concat('journal=', CAST(amount AS VARCHAR), ', ledger_sum=', CAST(s AS VARCHAR)) AS actual_value
  FROM a WHERE abs(s - amount) > 0.01
  UNION ALL SELECT entry_id, 'date_mismatch', concat('journal=', CAST(date AS VARCHAR), ', ledger=[', days, ']') FROM a WHERE NOT same_day""",
       "ledger", late=LATE, a=ACC)
def entry_accuracy(t):
    late = t.ledger.withColumn("date", F.when(F.col("src_row") % 29 == 0, F.date_add("date", 1)).otherwise(F.col("date")))
    return qo.accuracy_issues(t.entries, late).select("entry_id", "issue_type", "actual_value")


@query("""SELECT source_entry_id, CAST(sum(CASE ledger_type WHEN 'DR' THEN amount ELSE -amount END) AS DOUBLE) AS imbalance, count(*) AS n_lines
  FROM ledger GROUP BY 1 HAVING sum(CASE ledger_type WHEN 'DR' THEN amount ELSE -amount END) <> 0""", "ledger")
def entry_balance(t):
    return qo.unbalanced_sources(t.ledger)


TRANSFORM = """SELECT src_row, entry_id, 'unexpected_state' AS issue_type FROM records WHERE no_match
  UNION ALL SELECT r.src_row, r.entry_id, 'amount_mismatch' FROM records r JOIN (SELECT src_row, sum(amount) AS s FROM all_lines GROUP BY 1) l
    ON l.src_row = r.src_row WHERE abs(s - r.amount) > 0.01
  UNION ALL SELECT src_row, source_entry_id, 'invalid_account_code' FROM all_lines WHERE account_code NOT IN (SELECT code FROM accounts)"""


@query(TRANSFORM, "all_lines", "accounts")
def transformation_checks(t):
    return qo.transformation_issues(t.records, t.rules, t.accounts).select("src_row", "entry_id", "issue_type")


@query("""SELECT r.src_row, r.entry_id, concat('Amount mismatch: journal entry amount ', CAST(r.amount AS VARCHAR), ' != sum of ledger entries ', CAST(s AS VARCHAR)) AS message
  FROM records r JOIN (SELECT src_row, sum(amount) AS s FROM ledger GROUP BY 1) l ON l.src_row = r.src_row WHERE abs(s - r.amount) > 0.01
  UNION ALL SELECT src_row, source_entry_id, concat('Account code ', account_code, ' not found in hierarchy') FROM ledger
  WHERE account_code NOT IN (SELECT code FROM accounts)""", "ledger", "accounts")
def post_transform(t):
    return qo.post_transform_errors(t.records, t.accounts)


@query("""SELECT src_row, entry_id, source_entry_id FROM lost WHERE source_entry_id LIKE 'X%'""", "ledger", lost=LOST)
def unreferenced_lines(t):
    return qo.unreferenced_lines(t.entries, lost_ledger(t)).select("src_row", "entry_id", "source_entry_id")


@query("""SELECT issue_type, count(*) AS count FROM (
  SELECT 'missing_entry' AS issue_type FROM entries WHERE entry_id NOT IN (SELECT source_entry_id FROM ledger)
  UNION ALL SELECT 'amount_mismatch' FROM entries e JOIN (SELECT source_entry_id, sum(amount) AS s FROM ledger GROUP BY 1) l ON l.source_entry_id = e.entry_id
    WHERE abs(s - e.amount) > 0.01
  UNION ALL SELECT 'invalid_account_code' FROM (SELECT account_code FROM ledger WHERE account_code NOT IN (SELECT code FROM accounts) GROUP BY 1))
  GROUP BY 1""", "ledger", "accounts")
def output_validation(t):
    found = qo.validate_output(t.entries, t.ledger, agg.quarterly(t.ledger, t.accounts), t.accounts)
    return found.groupBy("issue_type").agg(F.count(F.lit(1)).alias("count"))


@query("""SELECT (SELECT count(*) FROM entries) AS journal_entries, (SELECT count(*) FROM ledger) AS ledger_entries,
  (SELECT count(*) FROM records WHERE no_match) AS unmatched_entries,
  (SELECT count(*) FROM journal) - (SELECT count(*) FROM entries) AS journal_entries_skipped, (SELECT count(*) FROM rules) AS rules_applied,
  (SELECT count(*) FROM input WHERE kind = 'error') AS validation_errors, (SELECT count(*) FROM input WHERE kind = 'warning') AS validation_warnings""",
       "ledger", "accounts", input=INPUT.replace("journal WHERE", "entries WHERE"))
def run_statistics(t):
    found = qi.validate_inputs(t.entries, t.rules, t.accounts, as_of())
    return pipeline.statistics(t.journal, t.records, t.rules, found)


@query("""SELECT e.sheet, count(DISTINCT e.src_row) AS journal_entries, count(l.src_row) AS ledger_entries,
  count(DISTINCT CASE WHEN e.no_match THEN e.src_row END) AS unmatched_entries FROM records e LEFT JOIN ledger l ON l.src_row = e.src_row
  GROUP BY 1""", "ledger")
def sheet_summary(t):
    return pipeline.sheet_summary(t.records)
