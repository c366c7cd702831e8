"""Audit tables, review flags and review tables."""

from pyspark.sql import functions as F

from ledgerloom.functions.staging import settle
from ledgerloom.operators import audit
from ledgerloom.operators import issue_tables as issues
from ledgerloom.operators import ledger as booking
from ledgerloom.operators import quality_input as qi
from ledgerloom.operators import review

from .journal import INPUT, as_of, event_issues, input_issues
from .tables import query

RUN = {"timestamp": "2026-01-01T00:00:00", "user": "books", "system_version": "0.1.0"}
LINES = "SELECT src_row, count(*) AS k FROM all_lines GROUP BY 1"


@query("""SELECT r.src_row, r.entry_id, '2026-01-01T00:00:00' AS timestamp, 'books' AS user, '0.1.0' AS system_version, '' AS rule_version,
  r.description AS source_description, CAST(r.amount AS DOUBLE) AS source_amount, CAST(r.date AS VARCHAR) AS source_date,
  concat_ws(', ', cr_id, dr_id) AS applied_rules, coalesce(k, 0) AS generated_entries_count,
  CASE WHEN no_match THEN 'Yes' ELSE 'No' END AS no_match FROM records r LEFT JOIN n ON n.src_row = r.src_row""", "all_lines", n=LINES)
def transformations(t):
    return audit.transformations(t.records, RUN)


@query("""SELECT r.src_row, CASE WHEN no_match THEN concat('Journal Entry ', entry_id, ' → No matching rules → No transformation') ELSE
  concat_ws(' ', concat('Journal Entry ', entry_id), CASE WHEN cr_id IS NOT NULL THEN concat('→ Rule ', cr_id, ' (', cr_account, ')') END,
  CASE WHEN dr_id IS NOT NULL THEN concat('→ Rule ', dr_id, ' (', dr_account, ')') END, concat('→ ', CAST(coalesce(k, 0) AS VARCHAR), ' Ledger Entry(ies)')) END AS path
  FROM records r LEFT JOIN n ON n.src_row = r.src_row""", "all_lines", n=LINES)
def transformation_paths(t):
    return t.records.select("src_row", audit.transformation_path().alias("path"))


@query("""SELECT r.src_row, r.entry_id, r.old_type, CAST(r.amount AS DOUBLE) AS amount, concat_ws('|', cr_id, dr_id) AS rules,
  coalesce(l.lines, '') AS lines, no_match FROM records r LEFT JOIN (
  SELECT src_row, string_agg(concat_ws('|', entry_id, account_code, ledger_type, CAST(amount AS VARCHAR)), ';' ORDER BY line_no) AS lines
  FROM all_lines GROUP BY 1) l ON l.src_row = r.src_row""", "all_lines")
def audit_records(t):
    """The nested records, their arrays written out as text."""
    rows = audit.audit_records(t.records, RUN)
    written = F.transform("generated_entries", lambda g: F.concat_ws(
        "|", g["entry_id"], g["account_code"], g["ledger_type"], g["amount"].cast("string")))
    return rows.select(
        "src_row", "entry_id", "source_entry.old_type", "source_entry.amount",
        F.array_join(F.transform("applied_rules", lambda r: r["rule_id"]), "|").alias("rules"),
        F.array_join(written, ";").alias("lines"), "no_match")


@query("""SELECT source_entry_id AS journal_entry_id, rule_applied AS rule_id, entry_id AS ledger_entry_id, account_code, CAST(amount AS DOUBLE) AS amount
  FROM all_lines""", "all_lines")
def lineage_edges(t):
    return audit.relationships(t.records)


@query("""SELECT l.source_entry_id AS journal_entry_id, '2026-01-01T00:00:00' AS transformation_timestamp, l.rule_applied AS rule_id,
  l.entry_id AS ledger_entry_id, l.account_code, CAST(l.amount AS DOUBLE) AS amount, CAST(l.date AS VARCHAR) AS date, r.no_match,
  'books' AS user, '0.1.0' AS system_version, '' AS rule_version FROM all_lines l JOIN records r ON r.src_row = l.src_row""", "all_lines")
def lineage_export(t):
    return audit.lineage(t.records, RUN)


@query("""SELECT src_row, CAST(0 AS BIGINT) AS line_no, 'Journal' AS entry_type, entry_id, '' AS source_entry_id, old_type AS account_code,
  CAST(amount AS DOUBLE) AS amount, CAST(date AS VARCHAR) AS date, description, '' AS rule_applied, CAST(quarter AS BIGINT) AS quarter,
  CAST(year AS BIGINT) AS year FROM records
  UNION ALL SELECT src_row, line_no, 'Ledger', entry_id, source_entry_id, account_code, CAST(amount AS DOUBLE), CAST(date AS VARCHAR), description,
  rule_applied, CAST(quarter AS BIGINT), CAST(year AS BIGINT) FROM all_lines""", "all_lines")
def entries_union(t):
    return audit.entries(t.records)


USAGE = """SELECT rule_id, count(*) AS usage_count FROM (SELECT cr_id AS rule_id FROM records UNION ALL SELECT dr_id FROM records)
  WHERE rule_id IS NOT NULL GROUP BY 1"""
SUMMARY = """SELECT count(*) AS total_transformations, count(*) FILTER (NOT no_match) AS matched_entries, count(*) FILTER (no_match) AS unmatched_entries,
  (SELECT count(*) FROM all_lines) AS total_ledger_entries, CAST((SELECT sum(amount) FROM all_lines) AS DOUBLE) AS total_amount,
  (SELECT count(*) FROM usage) AS unique_rules_applied,
  CAST((SELECT count(*) FROM all_lines) AS DOUBLE) / count(*) AS average_ledger_entries_per_journal FROM records"""


@query(SUMMARY, "all_lines", usage=USAGE)
def audit_summary(t):
    return audit.audit_summary(t.records)


@query("SELECT 'books' AS user, '0.1.0' AS system_version, '' AS rule_version, '' AS start_time, '' AS end_time, * FROM s",
       "all_lines", usage=USAGE, s=SUMMARY)
def run_metadata(t):
    return audit.metadata(t.records, RUN).withColumns({c: F.coalesce(c, F.lit("")) for c in ("rule_version", "start_time", "end_time")})


@query("""SELECT u.rule_id, concat('old_type == "', r.old_type, '"', CASE WHEN r.keyword IS NULL THEN '' ELSE concat(' and "', r.keyword, '" in description') END) AS condition,
  r.account AS account_code, concat('Map ', r.old_type, ' to ', r.account) AS description, CAST(r.priority AS BIGINT) AS priority,
  'No' AS generates_multiple, u.usage_count FROM usage u JOIN rules r ON r.rule_id = u.rule_id""", "records", usage=USAGE)
def rule_usage(t):
    return audit.rule_usage(t.records)


@query("""SELECT 'R-003-CR' AS rule_id, (SELECT count(*) FROM records WHERE cr_id = 'R-003-CR') AS usage_count, count(*) AS n_lines,
  CAST(sum(amount) AS DOUBLE) AS total_amount FROM all_lines WHERE rule_applied = 'R-003-CR'""", "all_lines")
def one_rule_usage(t):
    return audit.one_rule_usage(t.records, "R-003-CR")


@query("SELECT src_row, entry_id FROM records WHERE cr_id = 'R-007-CR' OR dr_id = 'R-007-CR'", "records")
def records_by_rule(t):
    return audit.rows_by_rule(t.records, "R-007-CR").select("src_row", "entry_id")


OUTLIERS = """SELECT l.*, CASE WHEN amount > med + 5 * mad THEN 'large' ELSE 'small' END AS size, med FROM {0} l, (
  SELECT any_value(med) AS med, median(abs(amount - med)) AS mad FROM {0}, (SELECT median(amount) AS med FROM {0}))
  WHERE mad > 0 AND (amount > med + 5 * mad OR amount < med - 5 * mad)"""
EVENT_LINES = """SELECT event_id AS src_row, concat('E-', CAST(event_id AS VARCHAR)) AS entry_id, CAST(value AS DECIMAL(18,2)) AS amount FROM events"""


@query("""SELECT src_row, entry_id, CAST(amount AS DOUBLE) AS amount, size, concat('Unusually ', size, ' amount: ', printf('%,.2f', CAST(amount AS DOUBLE)),
  ' (median: ', printf('%,.2f', CAST(med AS DOUBLE)), ')') AS reason FROM o""", ev=EVENT_LINES, o=OUTLIERS.format("ev"))
def amount_outliers(t):
    rows = t.read("events").select(
        F.col("event_id").alias("src_row"), F.concat(F.lit("E-"), F.col("event_id").cast("string")).alias("entry_id"),
        F.col("value").cast("decimal(18,2)").alias("amount"))
    return review.amount_outliers(rows).select("src_row", "entry_id", "amount", "size", "reason")


# Flags of a run. The input issues are those of the kept rows, plus one without an id.
KEPT_INPUT = """SELECT * FROM (""" + INPUT.replace("journal WHERE", "entries WHERE") + ")"
MESSAGES = """SELECT i.entry_id, i.kind, i.issue_type, CASE i.issue_type
    WHEN 'future_date' THEN concat('Date ', CAST(e.date AS VARCHAR), ' is in the future. Please verify this is correct.')
    WHEN 'unmatched_type' THEN concat('Old type ''', e.old_type, ''' in entry does not match any mapping rule. Entry may not be processed correctly. (Row 0, Field: old_type)')
    WHEN 'invalid_account_code' THEN 'Account code/name ''no-such-account'' does not exist in account hierarchy. Available codes: 1000, 1100, 2000, 2301, 3000, 4000, 4020, 4030, 4300, 5000, ... (11 total). Sample names: 应付OL押金, 应付款, 权益, 资产, 银行存款 (Row 0, Field: account_code)'
    END AS reason FROM input i LEFT JOIN entries e ON e.entry_id = i.entry_id WHERE i.entry_id <> ''"""
ISSUE_FLAGS = """SELECT coalesce(l.entry_id, m.entry_id) AS entry_id, CASE m.kind WHEN 'error' THEN 'validation_error' ELSE 'validation_warning' END AS status,
  m.reason, m.kind AS severity, m.entry_id AS source_entry_id FROM m LEFT JOIN ledger l ON l.source_entry_id = m.entry_id"""
FLAGS = """SELECT entry_id, 'no_match' AS status, 'No matching rule found for this journal entry' AS reason, 'error' AS severity, entry_id AS source_entry_id
    FROM records WHERE no_match
  UNION ALL SELECT entry_id, 'missing_type', 'Journal type is missing; please classify this entry (类型/Type) or add rules to infer it', 'error', entry_id
    FROM records WHERE old_type = '__MISSING_TYPE__'
  UNION ALL SELECT entry_id, status, reason, severity, source_entry_id FROM iflags
  UNION ALL SELECT entry_id, 'unusual_amount', concat('Unusually ', size, ' amount: ', printf('%,.2f', CAST(amount AS DOUBLE)), ' (median: ',
    printf('%,.2f', CAST(med AS DOUBLE)), ')'), 'warning', source_entry_id FROM o
  UNION ALL SELECT entry_id, 'multiple_rules', 'Multiple rules (2) matched this entry', 'info', entry_id FROM records WHERE cr_id IS NOT NULL AND dr_id IS NOT NULL"""
FLAG_TABLES = dict(input=KEPT_INPUT, m=MESSAGES, iflags=ISSUE_FLAGS, o=OUTLIERS.format("ledger"), flags=FLAGS)
NEEDED = ("ledger", "accounts", "rules", "journal")


def kept_issues(t):
    return settle(qi.validate_inputs(t.entries, t.rules, t.accounts, as_of()), "issues")


def all_flags(t, issues=None):
    return review.review_flags(t.records, t.ledger, kept_issues(t) if issues is None else issues, t.accounts)


@query("SELECT entry_id, status, reason, severity, coalesce(source_entry_id, '') AS source_entry_id, count(*) AS occurrences FROM flags GROUP BY ALL",
       *NEEDED, **FLAG_TABLES)
def review_flags(t):
    t.settled()
    return all_flags(t).groupBy(
        "entry_id", "status", "reason", "severity", F.coalesce("source_entry_id", F.lit("")).alias("source_entry_id")).agg(
        F.sum("occurrences").alias("occurrences"))


@query("SELECT entry_id, status, reason, severity, source_entry_id FROM iflags", *NEEDED, **FLAG_TABLES)
def flag_propagation(t):
    """Issues on journal rows flag the ledger lines of the row, or the row itself."""
    t.settled()
    return review.issue_flags(kept_issues(t).filter("entry_id is not null"), t.ledger).select(
        "entry_id", "status", "reason", "severity", "source_entry_id")


HOT = """SELECT concat(CASE WHEN user_id % 3 = 0 THEN 'R-' ELSE 'JE-' END, CAST(user_id AS VARCHAR)) AS id, concat(event_type, ' (Row 0, Field: amount)') AS reason,
  count(*) AS n FROM events GROUP BY ALL"""
HOT_LINES = """SELECT concat('JE-', CAST(user_id AS VARCHAR)) AS source, concat('LE-', CAST(user_id AS VARCHAR), '-', event_type) AS line_id, count(*) AS n
  FROM events GROUP BY ALL"""


@query("""SELECT coalesce(l.line_id, h.id) AS entry_id, h.reason, CAST(h.n * coalesce(l.n, 1) AS BIGINT) AS occurrences FROM h LEFT JOIN l ON l.source = h.id""",
       h=HOT, l=HOT_LINES)
def flag_propagation_hot(t):
    """Repeated ids on both sides: counted flags instead of all pairs."""
    lines = t.read("events").select(
        F.col("event_id").alias("src_row"), F.lit(1).alias("line_no"),
        F.concat(F.lit("JE-"), F.col("user_id").cast("string")).alias("source_entry_id"),
        F.concat(F.lit("LE-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("entry_id"))
    return review.issue_flags(event_issues(t), lines).select("entry_id", "reason", "occurrences")


@query("SELECT entry_id, concat('Account code ''', account_code, ''' not found in hierarchy') AS reason, source_entry_id FROM all_lines WHERE account_code = 'UNMATCHED'",
       "all_lines")
def unknown_account_flags(t):
    return review.missing_account_flags(booking.ledger(t.records, True), t.accounts).select("entry_id", "reason", "source_entry_id")


@query("SELECT entry_id FROM records WHERE cr_id IS NOT NULL AND dr_id IS NOT NULL", "records")
def multiple_rules(t):
    return review.multiple_rule_flags(t.records).select("entry_id")


# Stage order of the flags: last flag per line, first flag per source.
STAGED = """SELECT *, CASE status WHEN 'no_match' THEN 1 WHEN 'missing_type' THEN 2 WHEN 'validation_error' THEN 3 WHEN 'validation_warning' THEN 4
  WHEN 'missing_account' THEN 5 WHEN 'unusual_amount' THEN 6 ELSE 7 END AS stage FROM flags"""


@query("SELECT entry_id, max_by(status, stage) AS status, max_by(severity, stage) AS severity FROM staged GROUP BY 1", *NEEDED, **FLAG_TABLES, staged=STAGED)
def last_flags(t):
    t.settled()
    return review.last_flag_per_line(all_flags(t)).select("entry_id", "status", "severity")


ICON = "CASE coalesce({0}, 'none') WHEN 'critical' THEN '✗' WHEN 'error' THEN '⚠' WHEN 'warning' THEN '!' WHEN 'none' THEN '✓' ELSE 'ℹ' END"


@query(f"""SELECT {ICON.format('f.severity')} AS status_icon, l.entry_id, l.account_code AS ledger_id, l.account_code, l.account_path, l.description,
  CAST(l.amount AS DOUBLE) AS amount, CAST(l.date AS VARCHAR) AS date, CAST(l.quarter AS BIGINT) AS quarter, CAST(l.year AS BIGINT) AS year, l.source_entry_id,
  l.rule_applied, coalesce(f.reason, '') AS review_reason, l.src_row, CAST(l.line_no AS BIGINT) AS line_no FROM ledger l LEFT JOIN (
  SELECT entry_id, max_by(severity, stage) AS severity, max_by(reason, stage) AS reason FROM staged GROUP BY 1) f ON f.entry_id = l.entry_id""",
       *NEEDED, **FLAG_TABLES, staged=STAGED)
def review_preview(t):
    t.settled()
    return review.preview(t.ledger, all_flags(t))


@query(f"""SELECT {ICON.format('f.severity')} AS status_icon, r.src_row, CAST(coalesce(l.line_no, 0) AS BIGINT) AS line_no, r.entry_id AS journal_entry_id,
  r.description AS journal_description, CAST(r.amount AS DOUBLE) AS journal_amount, CAST(r.date AS VARCHAR) AS journal_date, r.old_type AS journal_type,
  coalesce(l.entry_id, 'NO MATCH') AS ledger_entry_id, coalesce(l.account_code, '') AS account_code, coalesce(l.account_path, '') AS account_path,
  CAST(coalesce(l.amount, 0) AS DOUBLE) AS ledger_amount, coalesce(l.rule_applied, '') AS rule_applied, CAST(coalesce(l.quarter, 0) AS BIGINT) AS quarter,
  CAST(coalesce(l.year, 0) AS BIGINT) AS year FROM records r LEFT JOIN ledger l ON l.src_row = r.src_row LEFT JOIN (
  SELECT source_entry_id, min_by(severity, stage) AS severity FROM staged GROUP BY 1) f ON f.source_entry_id = r.entry_id""",
       *NEEDED, **FLAG_TABLES, staged=STAGED)
def comparison(t):
    t.settled()
    plain = {c: F.coalesce(c, F.lit("")) for c in ("account_code", "account_path", "rule_applied")}
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("ledger_amount", "quarter", "year")}
    return review.comparison(t.records, all_flags(t)).withColumns({**plain, **zero})


@query(f"""SELECT {ICON.format('f.severity')} AS status_icon, upper(left(f.severity, 1)) || substr(f.severity, 2) AS severity, f.entry_id,
  coalesce(l.account_code, CASE WHEN e.entry_id IS NULL THEN 'N/A' ELSE 'N/A (Journal Entry)' END) AS account_code,
  coalesce(l.description, e.description, 'Entry not found in ledger or journal') AS description, CAST(coalesce(l.amount, e.amount, 0) AS DOUBLE) AS amount,
  coalesce(l.source_entry_id, f.source_entry_id, f.entry_id) AS source_entry_id,
  coalesce(l.rule_applied, CASE WHEN e.entry_id IS NULL THEN 'N/A' ELSE 'N/A (No transformation)' END) AS rule_applied,
  CASE f.status WHEN 'no_match' THEN 'No Match' WHEN 'missing_type' THEN 'Missing Type' WHEN 'validation_error' THEN 'Validation Error'
    WHEN 'validation_warning' THEN 'Validation Warning' WHEN 'unusual_amount' THEN 'Unusual Amount' WHEN 'multiple_rules' THEN 'Multiple Rules' END AS issue_type,
  CASE f.status WHEN 'no_match' THEN 'Review journal entry and add/update mapping rule' WHEN 'missing_type' THEN 'Fill journal Type (类型) or add rules so the tool can infer it'
    WHEN 'validation_error' THEN 'Fix data error in journal entry' WHEN 'validation_warning' THEN 'Review warning - may need correction'
    WHEN 'unusual_amount' THEN 'Verify amount is correct' ELSE 'Review rule priority - may need adjustment' END AS action_needed
  FROM flags f LEFT JOIN ledger l ON l.entry_id = f.entry_id LEFT JOIN entries e ON e.entry_id = f.entry_id""", *NEEDED, **FLAG_TABLES)
def flagged_entries(t):
    t.settled()
    return review.flagged_entries(all_flags(t), t.ledger, t.entries).select(
        "status_icon", "severity", "entry_id", "account_code", "description", F.coalesce("amount", F.lit(0)).alias("amount"),
        "source_entry_id", "rule_applied", "issue_type", "action_needed")


@query("""SELECT count(*) AS entries_needing_review, count(*) FILTER (severity = 'critical') AS critical_issues, count(*) FILTER (severity = 'error') AS error_flags,
  count(*) FILTER (severity = 'warning') AS warning_flags, count(*) FILTER (severity = 'info') AS info_items, (SELECT count(*) FROM entries) AS total_journal_entries,
  (SELECT count(*) FROM ledger) AS total_ledger_entries, (SELECT count(*) FROM input WHERE kind = 'error') AS errors_detected,
  (SELECT count(*) FROM input WHERE kind = 'warning') AS warnings_detected FROM flags""", *NEEDED, **FLAG_TABLES)
def review_dashboard(t):
    t.settled()
    found = kept_issues(t)
    return review.dashboard(t.entries, t.ledger, all_flags(t, found), found)


@query("""SELECT status, CASE status WHEN 'no_match' THEN 'No Matching Rule' WHEN 'missing_type' THEN 'Missing Journal Type' WHEN 'validation_error' THEN 'Validation Error'
  WHEN 'validation_warning' THEN 'Validation Warning' WHEN 'unusual_amount' THEN 'Unusual Amount' ELSE 'Multiple Rules' END AS label, count(*) AS count,
  upper(left(min(severity), 1)) || substr(min(severity), 2) AS severity FROM flags GROUP BY 1""", *NEEDED, **FLAG_TABLES)
def flags_by_status(t):
    t.settled()
    return review.flags_by_status(all_flags(t))


FIX_EN = """CASE event_type WHEN 'click' THEN concat('**Data Error: Invalid ', f, '**', chr(10), chr(10), 'The value for ''', f, ''' is invalid: ', v, '. invalid amount', chr(10), chr(10),
    '**Details:** Actual value: ', v, chr(10), chr(10), '**Location:** Journal Entry: JE-', u, chr(10), chr(10), '**How to fix:** Enter a valid number for ''', f, '''. Example: 1000.50 (decimal numbers are allowed).')
  WHEN 'view' THEN concat('**Data Error: Invalid ', f, '**', chr(10), chr(10), 'The required field ''', f, ''' is missing or empty. This field is required for processing and cannot be omitted.', chr(10), chr(10),
    '**Details:** Actual value: ', v, chr(10), chr(10), '**Location:** Journal Entry: JE-', u, chr(10), chr(10), '**How to fix:** Add a value for the ''', f, ''' field. This field is required and cannot be empty.')
  ELSE concat('**Data Error: Invalid ', f, '**', chr(10), chr(10), 'odd', chr(10), chr(10), '**Details:** Actual value: ', v, chr(10), chr(10),
    '**Location:** Journal Entry: JE-', u, chr(10), chr(10), '**How to fix:** Review the value for ''', f, ''' and ensure it meets the requirements.') END"""
SAID = """SELECT event_id, event_type, 'net_amount' AS f, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v, CAST(user_id AS VARCHAR) AS u FROM events"""


def said(t):
    text = F.expr("CASE event_type WHEN 'click' THEN 'invalid amount' WHEN 'view' THEN 'Missing thing' ELSE 'odd' END")
    rows = event_issues(t).select(
        "kind", "src_row", "row_number", F.lit("net_amount").alias("field_name"), "issue_type",
        F.col("actual_value").cast("double").cast("decimal(18,2)").cast("string").alias("actual_value"), F.col("message").alias("event_type"),
        F.concat(F.lit("JE-"), F.substring_index("entry_id", "-", -1)).alias("entry_id"))
    return issues.detect(rows.withColumn("message", text))


@query(f"SELECT event_id AS src_row, {FIX_EN} AS text FROM said", said=SAID)
def issue_messages(t):
    return said(t).select("src_row", issues.message("en").alias("text"))


@query("""SELECT event_id AS src_row, concat('**数据错误：无效的', f, '**', chr(10), chr(10), CASE event_type
    WHEN 'click' THEN concat('字段 ''', f, ''' 的值无效：', v, '。invalid amount') WHEN 'view' THEN concat('必填字段 ''', f, ''' 缺失或为空。该字段为处理所必需，不能省略。') ELSE 'odd' END,
  chr(10), chr(10), '**详细信息:** 实际值：', v, chr(10), chr(10), '**位置:** 日记账条目：JE-', u, chr(10), chr(10), '**如何修复:** ', CASE event_type
    WHEN 'click' THEN concat('为 ''', f, ''' 输入有效数字。示例：1000.50（允许小数）。') WHEN 'view' THEN concat('为字段 ''', f, ''' 添加值。该字段为必填项，不能为空。')
    ELSE concat('检查字段 ''', f, ''' 的值，确保其符合要求。') END) AS text FROM said""", said=SAID)
def issue_messages_zh(t):
    return said(t).select("src_row", issues.message("zh").alias("text"))


@query("""SELECT event_id AS src_row, CASE event_type WHEN 'view' THEN 'Add the missing ''net_amount'' field to your input file' ELSE '' END AS hint FROM events""")
def quick_fixes(t):
    return said(t).select("src_row", F.coalesce(issues.quick_fix(), F.lit("")).alias("hint"))
