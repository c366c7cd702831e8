"""Rule tables, free-form conditions, type maps, type inference and fix suggestions."""

from pyspark.sql import functions as F

from ledgerloom.functions.conditions import well_formed
from ledgerloom.operators import accounts as acc
from ledgerloom.operators import fixes, matching, quality_rules as qr, typing
from ledgerloom.operators import issue_tables as issues
from ledgerloom.sources import accounts as account_source
from ledgerloom.sources import rules as source

from .booking import TREE, tree
from .tables import query

# A long rule table over `part`: good, unreadable and doubtful conditions, odd priorities.
SHEET_COLUMNS = {
    "rule_ord": "p_partkey",
    "rule_id": "CASE WHEN p_partkey % 41 = 0 THEN NULL ELSE concat('R-', CAST(p_partkey AS {S})) END",
    "condition": """CASE p_partkey % 8 WHEN 0 THEN concat('old_type == "', p_type, '"')
        WHEN 1 THEN concat('old_type == "', p_type, '" and year == ', CAST(2019 + p_size % 6 AS {S}))
        WHEN 2 THEN concat('old_type == "', p_type, '" and (amount > 1000 or amount < 100)')
        WHEN 3 THEN CASE p_partkey % 5 WHEN 0 THEN 'description.contains(''test'') and quarter == 1' WHEN 1 THEN 'old_type != null and year >= 2023'
          ELSE concat('not (quarter == 2) and "', p_name, '" in description') END
        WHEN 4 THEN concat('old_type = "', p_type, '"') WHEN 5 THEN '(year == 2024'
        WHEN 6 THEN 'foo == 1 and bar.baz > 2 and foo < 3'
        ELSE concat(' OLD_TYPE == "', lower(p_type), '" or old_type == "', p_type, '"') END""",
    "account_code": "CASE WHEN p_partkey % 37 = 0 THEN '' WHEN p_partkey % 2 = 0 THEN '1100' ELSE p_brand END",
    "priority": "CASE WHEN p_partkey % 31 = 0 THEN 'high' WHEN p_partkey % 29 = 0 THEN '0' WHEN p_partkey % 23 = 0 THEN NULL ELSE CAST(p_size % 3 + 1 AS {S}) END",
    "old_type": "CASE WHEN p_partkey % 19 = 0 THEN ' ' WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END",
    "new_type": "CASE WHEN p_partkey % 14 = 0 THEN 'new' END",
    "generates_multiple": "CASE p_partkey % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN '1' END",
    "ledger_type": "CASE p_partkey % 3 WHEN 0 THEN 'CR' WHEN 1 THEN 'DR' END",
    "remark": "p_name",
}
SHEET = "SELECT " + ", ".join(f"{e.replace('{S}', 'VARCHAR')} AS {c}" for c, e in SHEET_COLUMNS.items()) + " FROM part"
GOOD = """SELECT rule_ord, rule_id, trim(condition) AS condition, account_code, CAST(priority AS INTEGER) AS priority, trim(old_type) AS old_type,
  new_type, generates_multiple IN ('Yes', '1') AND generates_multiple IS NOT NULL AS generates_multiple, ledger_type FROM sheet
  WHERE rule_id IS NOT NULL AND account_code <> '' AND priority IS NOT NULL AND priority <> 'high' AND priority <> '0'
  AND coalesce(trim(old_type), 'x') <> ''"""


def rule_sheet(t):
    return t.read("part").selectExpr(*[f"{e.replace('{S}', 'STRING')} AS {c}" for c, e in SHEET_COLUMNS.items()])


def good_rules(t):
    return source.read_rules(rule_sheet(t))


@query("""SELECT rule_ord, rule_id, condition, account_code, CAST(priority AS BIGINT) AS priority, coalesce(old_type, '') AS old_type,
  coalesce(new_type, '') AS new_type, generates_multiple, coalesce(ledger_type, '') AS ledger_type FROM good""", sheet=SHEET, good=GOOD)
def rule_table_scan(t):
    blank = {c: F.coalesce(c, F.lit("")) for c in ("old_type", "new_type", "ledger_type")}
    return good_rules(t).drop("description").withColumns(blank)


@query("""SELECT rule_ord + 2 AS row_number, field_name, issue_type, coalesce(rule_id, concat('ROW-', CAST(rule_ord + 2 AS VARCHAR))) AS entry_id FROM (
  SELECT *, 'rule_id' AS field_name, 'missing' AS issue_type FROM sheet WHERE rule_id IS NULL
  UNION ALL SELECT *, 'account_code', 'string_too_short' FROM sheet WHERE account_code = ''
  UNION ALL SELECT *, 'priority', CASE priority WHEN 'high' THEN 'int_parsing' ELSE 'greater_than_equal' END FROM sheet WHERE priority IN ('high', '0')
  UNION ALL SELECT *, 'priority', 'missing' FROM sheet WHERE priority IS NULL
  UNION ALL SELECT *, 'old_type', 'value_error' FROM sheet WHERE trim(old_type) = '')""", sheet=SHEET)
def rule_scan_issues(t):
    return source.rule_issues(rule_sheet(t)).select("row_number", "field_name", "issue_type", "entry_id")


@query("""SELECT rule_ord AS src_row, rule_id AS entry_id, concat('Invalid rule syntax: ', condition) AS message FROM good
  WHERE rule_ord % 8 IN (4, 5)""", sheet=SHEET, good=GOOD)
def rule_syntax(t):
    return qr.syntax_issues(good_rules(t)).select("src_row", "entry_id", "message")


NAMES = """SELECT rule_ord, rule_id, unnest(CASE rule_ord % 8 WHEN 6 THEN ['foo', 'bar'] WHEN 7 THEN ['OLD_TYPE'] ELSE [] END) AS name FROM good"""


@query("""SELECT rule_ord AS src_row, rule_id AS entry_id, concat('Field ''', name, ''' in condition does not exist in JournalEntry. ',
  'Valid fields: amount, date, description, entry_id, notes, old_type, quarter, year') AS message FROM names""",
       sheet=SHEET, good=GOOD, names=NAMES)
def rule_field_refs(t):
    return qr.field_issues(good_rules(t)).select("src_row", "entry_id", "message")


@query("SELECT rule_ord AS src_row, rule_id AS entry_id FROM good WHERE old_type IS NULL AND new_type IS NULL", sheet=SHEET, good=GOOD)
def rule_required(t):
    return qr.type_issues(good_rules(t)).select("src_row", "entry_id")


@query("""SELECT rule_ord AS src_row, rule_id AS entry_id, concat('Account code/name ''', account_code, ''' does not exist in account hierarchy. ',
  'Available codes: 1000, 1100, 2000, 2301, 3000, 4000, 4020, 4030, 4300, 5000, ... (11 total). Sample names: 应付OL押金, 应付款, 权益, 资产, 银行存款') AS message
  FROM good WHERE account_code <> '1100'""", sheet=SHEET, good=GOOD)
def rule_accounts(t):
    return qr.account_issues(good_rules(t), t.accounts).select("src_row", "entry_id", "message")


GATE = """SELECT * FROM good WHERE rule_ord % 8 NOT IN (4, 5, 6, 7) AND (old_type IS NOT NULL OR new_type IS NOT NULL)"""


@query("SELECT rule_ord, rule_id FROM gate", sheet=SHEET, good=GOOD, gate=GATE)
def rule_gate(t):
    return qr.valid_rules(good_rules(t)).select("rule_ord", "rule_id")


CONFLICT = """SELECT lower(condition) AS norm, priority, coalesce(ledger_type, '') AS side, count(*) AS n, min(account_code) AS lo, max(account_code) AS hi
  FROM gate GROUP BY ALL HAVING min(account_code) <> max(account_code)"""


@query("""SELECT norm AS actual_value, concat('Multiple rules with same condition, priority (', CAST(priority AS VARCHAR), '), and ledger_type',
  CASE WHEN side <> '' THEN concat(' (', side, ')') ELSE '' END, ' but different account codes: ', concat(lo, ' .. ', hi),
  '. Rule IDs: ', CAST(n AS VARCHAR), ' rules') AS message FROM conflict""",
       sheet=SHEET, good=GOOD, gate=GATE, conflict=CONFLICT)
def rule_conflicts(t):
    return qr.conflict_issues(qr.valid_rules(good_rules(t))).select("actual_value", "message")


@query("""SELECT g.rule_id, c.norm, CAST(c.priority AS BIGINT) AS priority, c.side, g.account_code FROM gate g JOIN conflict c
  ON c.norm = lower(g.condition) AND c.priority = g.priority AND c.side = coalesce(g.ledger_type, '')""",
       sheet=SHEET, good=GOOD, gate=GATE, conflict=CONFLICT)
def rule_conflict_members(t):
    return qr.conflict_members(qr.valid_rules(good_rules(t))).drop("rule_ord")


@query("""SELECT account_code AS rule_id, count(*) AS n_rows FROM good GROUP BY 1 HAVING count(*) > 1""", sheet=SHEET, good=GOOD)
def duplicate_rule_ids(t):
    return qr.duplicate_rule_ids(good_rules(t).withColumn("rule_id", F.col("account_code")))


# A wide rule sheet over `customer`.
WIDE_COLUMNS = {
    "ord": "c_custkey",
    "year": "CASE WHEN c_custkey % 10 = 9 THEN NULL ELSE concat(CAST(2019 + c_custkey % 6 AS {S}), '.0') END",
    "old_type": "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(' ', c_mktsegment) END",
    "new_type": "CASE WHEN c_custkey % 13 = 0 THEN '/' WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('N-', c_mktsegment) END",
    "cr": "CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 7 = 0 AND c_custkey % 3 = 0 THEN '/' ELSE '银行存款' END",
    "dr": "CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE concat('acct', CAST(c_nationkey AS {S})) END",
    "keyword": "CASE WHEN c_custkey % 5 = 0 THEN concat('kw', CAST(c_nationkey AS {S}), ' ') WHEN c_custkey % 5 = 1 THEN ' ' END",
}
WIDE = "SELECT " + ", ".join(f"{e.replace('{S}', 'VARCHAR')} AS {c}" for c, e in WIDE_COLUMNS.items()) + " FROM customer"


def wide_sheet(t):
    return t.read("customer").selectExpr(*[f"{e.replace('{S}', 'STRING')} AS {c}" for c, e in WIDE_COLUMNS.items()])


KEPT = """SELECT * FROM (SELECT ord, CAST(CAST(year AS DOUBLE) AS INTEGER) AS y, trim(old_type) AS ot, new_type AS nt, trim(cr) AS cr, trim(dr) AS dr,
    nullif(trim(coalesce(keyword, '')), '') AS kw, row_number() OVER (PARTITION BY year, old_type, nullif(trim(coalesce(keyword, '')), '') IS NULL ORDER BY ord) AS rn
  FROM wide WHERE year IS NOT NULL AND old_type IS NOT NULL AND cr <> '' AND dr <> '' AND coalesce(new_type, cr) <> '/')
  WHERE kw IS NOT NULL OR rn = 1"""


@query("""SELECT concat('JTL-', CAST(ord + 2 AS VARCHAR), '-', side) AS rule_id, ord * 2 + CASE side WHEN 'CR' THEN 0 ELSE 1 END AS rule_ord,
  concat('old_type == "', ot, '" and year == ', CAST(y AS VARCHAR), CASE WHEN kw IS NOT NULL THEN concat(' and "', kw, '" in description') ELSE '' END) AS condition,
  CASE side WHEN 'CR' THEN cr ELSE dr END AS account_code, CAST(CASE WHEN kw IS NULL THEN 10 ELSE 20 END AS BIGINT) AS priority, ot AS old_type,
  coalesce(nt, '') AS new_type, side AS ledger_type FROM kept, (VALUES ('CR'), ('DR')) AS s(side)""", wide=WIDE, kept=KEPT)
def rule_pairs(t):
    return source.rules_from_pairs(wide_sheet(t)).select(
        "rule_id", "rule_ord", "condition", "account_code", "priority", "old_type",
        F.coalesce("new_type", F.lit("")).alias("new_type"), "ledger_type")


SECTIONS = """SELECT c_custkey AS ord, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS old_type,
  CASE c_custkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '銀行存款1002' WHEN 2 THEN '1100' WHEN 3 THEN '投资收益' WHEN 4 THEN '收入' WHEN 5 THEN '应付款OL押金2301'
    WHEN 6 THEN 'OL收入4301' WHEN 7 THEN 'mystery' ELSE concat('k', c_nationkey) END AS old_cr,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' 银行存款 ' WHEN 2 THEN '捐贈收入' ELSE 'nan' END AS old_dr,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('N-', c_mktsegment) END AS new_type,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '收入OL' END AS new_cr, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE '组委工资' END AS new_dr FROM customer"""


def sections(t):
    from_select = SECTIONS.removeprefix("SELECT ").removesuffix(" FROM customer").replace("concat('k', c_nationkey)", "concat('k', CAST(c_nationkey AS STRING))")
    return t.spark.sql("SELECT " + from_select + " FROM {c}", c=t.read("customer"))


LONG = """SELECT concat('R-', printf('%03d', n), '-', side) AS rule_id, n AS rule_ord, concat('old_type == "', mt, '"') AS condition, acc AS account_code, side AS ledger_type
  FROM (SELECT *, row_number() OVER (ORDER BY ord, side) AS n FROM (
    SELECT ord, mt, 'CR' AS side, trim(cr) AS acc FROM {0} WHERE trim(cr) <> '' AND trim(cr) <> 'nan' UNION ALL
    SELECT ord, mt, 'DR', trim(dr) FROM {0} WHERE trim(dr) <> '' AND trim(dr) <> 'nan'))"""
PICK = ["rule_id", "rule_ord", "condition", "account_code", "ledger_type"]


@query(LONG.format("w"), sections=SECTIONS, w="""SELECT ord, new_type AS mt, coalesce(new_cr, old_cr) AS cr, coalesce(new_dr, old_dr) AS dr
  FROM sections WHERE new_type IS NOT NULL AND (new_cr IS NOT NULL OR new_dr IS NOT NULL)""")
def wide_rules_long(t):
    return source.rules_from_wide(sections(t)).select(*PICK)


# Old labels that this chart of accounts resolves by containment or by fragment.
LEGACY = """SELECT label, coalesce((SELECT code FROM accounts WHERE code = label), (SELECT min_by(code, ord) FROM accounts WHERE name = label),
  (SELECT min_by(code, ord) FROM accounts WHERE contains(label, name) OR contains(name, label)),
  CASE WHEN contains(label, '銀行存款') OR contains(label, '1002') THEN '1100' WHEN contains(label, 'OL收入') OR contains(label, '4301') THEN '4300'
    WHEN contains(label, '捐贈收入') THEN '4020' WHEN contains(label, 'OL押金') OR contains(label, '2301') THEN '2301' END, label) AS code,
  CAST(CASE WHEN label IN (SELECT code FROM accounts) THEN 1 WHEN label IN (SELECT name FROM accounts) THEN 2
    WHEN EXISTS (SELECT 1 FROM accounts WHERE contains(label, name) OR contains(name, label)) THEN 3
    WHEN contains(label, '銀行存款') OR contains(label, 'OL收入') OR contains(label, '捐贈收入') OR contains(label, 'OL押金') THEN 4 ELSE 5 END AS BIGINT) AS match_rank
  FROM (SELECT DISTINCT trim(unnest([old_cr, old_dr])) AS label FROM sections) WHERE label IS NOT NULL"""


@query(LONG.format("m"), "accounts", sections=SECTIONS, legacy=LEGACY, m="""SELECT s.ord, s.old_type AS mt, c.code AS cr, d.code AS dr FROM sections s
  LEFT JOIN legacy c ON c.label = trim(s.old_cr) LEFT JOIN legacy d ON d.label = trim(s.old_dr)
  WHERE s.old_type IS NOT NULL AND (s.old_cr IS NOT NULL OR s.old_dr IS NOT NULL)""")
def rules_from_old_types(t):
    return source.rules_from_old_types(sections(t), t.accounts).select(*PICK)


@query("SELECT label AS old_code, code, match_rank FROM legacy", "accounts", sections=SECTIONS, legacy=LEGACY)
def legacy_accounts(t):
    return acc.map_legacy_codes(sections(t).select(F.explode(F.array("old_cr", "old_dr")).alias("old_code")), t.accounts)


KEYED = "SELECT ord, CAST(CAST(year AS DOUBLE) AS INTEGER) AS year, trim(old_type) AS old_type FROM wide"
FRESH = """SELECT 1000000 + s_suppkey AS ord, 2016 + s_suppkey % 9 AS year, CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'EXTRA' END AS old_type
  FROM supplier"""


@query("""SELECT ord, CAST(coalesce(year, 0) AS BIGINT) AS year, coalesce(old_type, '') AS old_type FROM keyed WHERE ord % 17 <> 3
  UNION ALL SELECT min(ord), year, old_type FROM fresh WHERE (year, old_type) NOT IN (SELECT (year, old_type) FROM keyed
    WHERE ord % 17 <> 3 AND year IS NOT NULL AND old_type IS NOT NULL) GROUP BY year, old_type""", wide=WIDE, keyed=KEYED, fresh=FRESH)
def rule_upsert(t):
    keyed = wide_sheet(t).select("ord", F.col("year").cast("double").cast("int").alias("year"), F.trim("old_type").alias("old_type"))
    fresh = t.read("supplier").select(
        (F.col("s_suppkey") + 1000000).alias("ord"), (F.col("s_suppkey") % 9 + 2016).cast("int").alias("year"),
        F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'EXTRA' END").alias("old_type"))
    return source.upsert_rules(keyed, keyed.filter("ord % 17 = 3"), fresh).select(
        "ord", F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("old_type", F.lit("")).alias("old_type"))


@query("""SELECT CAST(year AS BIGINT) AS year, old_type, count(*) AS n_rows FROM keyed WHERE year IS NOT NULL AND old_type IS NOT NULL
  GROUP BY ALL HAVING count(*) > 1""", wide=WIDE, keyed=KEYED)
def duplicate_rule_keys(t):
    return source.duplicate_keys(wide_sheet(t).select(
        F.col("year").cast("double").cast("int").alias("year"), F.trim("old_type").alias("old_type")))


# Free-form conditions: the whole language, with errors that make a rule not match.
FREE = [
    (1, "F-1-CR", 'amount > 400000 and old_type == "RareType" and not (quarter == 2)', "投资收益", 30, "RareType", "CR"),
    (2, "F-2-DR", 'year >= 2024 and (old_type == "RareType" or "alipay" in description)', "银行存款", 5, "RareType", "DR"),
    (3, "F-3", 'old_type == "RareType" and amount < 0', "1100", 7, "RareType", None),
    (4, "F-4-CR", 'date == "2024-01-15" or entry_id == "A-3-4"', "收入OL", 50, "X", "CR"),
    (5, "F-5-DR", 'notes != "x" and not old_type == "OL"', "组委工资", 1, "X", "DR"),
    (6, "F-6-DR", "quarter >= 4 or quarter == 1", "银行存款", 2, "X", "DR"),
    (7, "F-7-CR", 'year == "2024"', "1100", 99, "X", "CR"),
    (8, "F-8-DR", "foo == 1 or year == 2024", "1100", 99, "X", "DR"),
    (9, "F-9-CR", 'old_type == "OL" and "wechat" in description', "捐赠收入", 20, "OL", "CR"),
    (10, "F-10-CR", 'old_type == "OL" and year == 2024', "收入OL", 25, "OL", "CR"),
    (11, "F-11-CR", "old_type == 'OL' and year == 2023 and amount > 1000", "收入OL", 26, "OL", "CR"),
    (12, "F-12-DR", "quarter == null and year >= 2023", "银行存款", 3, "X", "DR"),
    (13, "F-13-DR", "'wechat' in description and old_type == 'OL' and quarter != null", "银行存款", 4, "OL", "DR"),
    (14, "F-14-CR", "description.contains('alipay') and quarter == 1", "收入OL", 98, "X", "CR"),
    (15, "F-15-CR", "old_type != null and not (description.startswith('a'))", "收入OL", 97, "X", "CR"),
    (16, "F-16", "notes == null and true == false or amount == -1 and old_type == 'OL-D'", "1100", 6, "X", None),
]
HOLED = "SELECT * REPLACE (CASE WHEN src_row % 5 = 0 THEN NULL ELSE quarter END AS quarter) FROM journal"
HELD = """SELECT src_row, 1 AS o, 'CR' AS side, 30 AS p FROM j WHERE amount > 400000 AND old_type = 'RareType' AND quarter IS DISTINCT FROM 2
  UNION ALL SELECT src_row, 2, 'DR', 5 FROM j WHERE year >= 2024 AND (old_type = 'RareType' OR contains(description, 'alipay'))
  UNION ALL SELECT src_row, 3, '', 7 FROM j WHERE old_type = 'RareType' AND amount < 0
  UNION ALL SELECT src_row, 4, 'CR', 50 FROM j WHERE date = DATE '2024-01-15' OR entry_id = 'A-3-4'
  UNION ALL SELECT src_row, 5, 'DR', 1 FROM j WHERE old_type <> 'OL'
  UNION ALL SELECT src_row, 6, 'DR', 2 FROM j WHERE quarter >= 4 OR quarter = 1
  UNION ALL SELECT src_row, 9, 'CR', 20 FROM j WHERE old_type = 'OL' AND contains(description, 'wechat')
  UNION ALL SELECT src_row, 10, 'CR', 25 FROM j WHERE old_type = 'OL' AND year = 2024
  UNION ALL SELECT src_row, 11, 'CR', 26 FROM j WHERE old_type = 'OL' AND year = 2023 AND amount > 1000
  UNION ALL SELECT src_row, 12, 'DR', 3 FROM j WHERE quarter IS NULL AND year >= 2023
  UNION ALL SELECT src_row, 13, 'DR', 4 FROM j WHERE contains(description, 'wechat') AND old_type = 'OL' AND quarter IS NOT NULL
  UNION ALL SELECT src_row, 16, '', 6 FROM j WHERE amount = -1 AND old_type = 'OL-D'"""


def holed(t):
    return t.journal.withColumn("quarter", F.when(F.col("src_row") % 5 != 0, F.col("quarter")))


@query("SELECT src_row, CAST(o AS BIGINT) AS rule_ord FROM held", "journal", j=HOLED, held=HELD)
def rule_match_general(t):
    return matching.matches(holed(t), t.free_rules(FREE)).select("src_row", "rule_ord")


FREE_PICK = """SELECT j.src_row, coalesce(c.o, 0) AS cr, coalesce(d.o, 0) AS dr, coalesce(g.o, 0) AS generic FROM j
  LEFT JOIN (SELECT src_row, o FROM held WHERE side = 'CR' QUALIFY row_number() OVER (PARTITION BY src_row ORDER BY p DESC, o) = 1) c ON c.src_row = j.src_row
  LEFT JOIN (SELECT src_row, o FROM held WHERE side = 'DR' QUALIFY row_number() OVER (PARTITION BY src_row ORDER BY p DESC, o) = 1) d ON d.src_row = j.src_row
  LEFT JOIN (SELECT src_row, o FROM held WHERE side = '' QUALIFY row_number() OVER (PARTITION BY src_row ORDER BY p DESC, o) = 1) g ON g.src_row = j.src_row"""
FREE_IDS = """SELECT src_row, CASE cr WHEN 0 THEN '' ELSE concat('F-', cr, '-CR') END AS cr_rule,
  CASE WHEN dr > 0 THEN concat('F-', dr, '-DR') WHEN cr = 0 AND generic > 0 THEN concat('F-', generic) ELSE '' END AS dr_rule FROM fp"""


def _picked(df):
    return df.select("src_row", *[F.coalesce(f"{c}.rule_id", F.lit("")).alias(c) for c in ("cr_rule", "dr_rule")])


@query(FREE_IDS, "journal", j=HOLED, held=HELD, fp=FREE_PICK)
def rule_pick_general(t):
    return _picked(matching.pick_rules(holed(t), t.free_rules(FREE), t.accounts))


@query(FREE_IDS, "journal", j=HOLED, held=HELD, fp=FREE_PICK)
def rule_pick_general_shuffled(t):
    return _picked(matching.pick_rules(holed(t), t.free_rules(FREE), t.accounts, max_rules=0))


# More different free-form conditions than any plan could hold as code: four per part.
MANY = "SELECT p_partkey * 4 + k AS o, p_partkey * 100 AS least, p_size % 4 + 1 AS q FROM part, (VALUES (0), (1), (2), (3)) AS v(k)"


@query("""SELECT j.src_row, CAST(o AS BIGINT) AS rule_ord FROM journal j JOIN many ON o % 5003 = j.src_row % 5003
  WHERE j.amount > least OR j.quarter = q""", "journal", many=MANY)
def rule_match_many(t):
    numbered = t.read("part").select("p_partkey", (F.col("p_size") % 4 + 1).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    order = F.col("p_partkey") * 4 + F.col("k")
    text = F.format_string("(amount > %d or quarter == %d) and entry_id != 'x%d' and old_type == 'T%d'", F.col("p_partkey") * 100, F.col("q"), order, order % 5003)
    rules = numbered.select(
        order.cast("bigint").alias("rule_ord"), F.format_string("M-%d", order).alias("rule_id"), text.alias("condition"), F.lit("1100").alias("account_code"),
        F.lit(1).alias("priority"), F.lit("X").alias("old_type"), F.lit(None).cast("string").alias("new_type"), F.lit("").alias("description"),
        F.lit(False).alias("generates_multiple"), F.lit("CR").alias("ledger_type"))
    rows = t.journal.withColumn("old_type", F.concat(F.lit("T"), (F.col("src_row") % 5003).cast("string")))
    return matching.matches(rows, rules, wanted=("rule_ord",))


# A type map over `orders` (several rows per key) and a journal whose types it knows in part.
MAP = """SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 101 = 0 THEN 1990 ELSE 2016 + o_orderkey % 8 END AS year,
  CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN (o_custkey % 50 + o_orderkey % 8) % 3 = 0 THEN concat(' T', CAST(o_custkey % 50 AS {S}))
    ELSE concat(' U', CAST(o_custkey % 50 AS {S})) END AS old_type, concat('N', CAST(o_orderkey % 1000 AS {S})) AS new_type
  FROM {orders}"""
MAP_SQL = """SELECT year, trim(old_type) AS old_type, max_by(new_type, ord) AS new_type FROM (""" + MAP.replace("{S}", "VARCHAR").replace("{orders}", "orders") + \
    ") WHERE year BETWEEN 2000 AND 2100 AND trim(old_type) <> '' GROUP BY ALL"


def type_map(t):
    return account_source.read_type_map(t.spark.sql(MAP.replace("{S}", "STRING"), orders=t.read("orders")))


@query("SELECT CAST(year AS BIGINT) AS year, old_type, new_type FROM tm", tm=MAP_SQL)
def type_map_scan(t):
    return type_map(t)


@query("""SELECT e.src_row, CAST(e.year AS BIGINT) AS year, coalesce(x.new_type, a.new_type, e.t) AS old_type FROM (
  SELECT src_row, year, concat('T', CAST(src_row % 60 AS VARCHAR)) AS t FROM journal) e
  LEFT JOIN tm x ON x.year = e.year AND x.old_type = e.t
  LEFT JOIN (SELECT e.src_row, max_by(m.new_type, m.year) AS new_type FROM (SELECT src_row, year, concat('T', CAST(src_row % 60 AS VARCHAR)) AS t FROM journal) e
    JOIN tm m ON m.old_type = e.t AND m.year < e.year AND m.year >= 2020 GROUP BY 1) a ON a.src_row = e.src_row""", "journal", tm=MAP_SQL)
def type_remap_asof(t):
    rows = t.journal.withColumn("old_type", F.concat(F.lit("T"), (F.col("src_row") % 60).cast("string")))
    return typing.remap_types(rows, type_map(t)).select("src_row", "year", "old_type")


# Keywords of rule conditions vote for a type.
VOTERS = [
    (1, "K-1-CR", "OL", "alipay", 20, "CR", "收入OL"), (2, "K-2-CR", "OL", "wechat", 20, "CR", "收入OL"),
    (3, "K-3-CR", "OL", "wallet", 20, "CR", "收入OL"), (4, "K-4-CR", "工资", "bank", 20, "CR", "银行存款"),
    (5, "K-5-CR", "报销", "order", 20, "CR", "银行存款"), (6, "K-6-CR", "报销", "transfer", 20, "CR", "银行存款"),
    (7, "K-7-CR", "捐赠", "tip", 20, "CR", "捐赠收入"), (8, "K-8-CR", "OL", "payout", 20, "CR", "收入OL"),
    (9, "K-9-CR", "OL", None, 10, "CR", "收入OL"), (10, "K-10-CR", "工资", "wallet", 20, "CR", "银行存款"),
]
KW = "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, '{r[3]}', '{r[2]}')" for r in VOTERS if r[3]) + ") AS t(o, keyword, old_type)"
VOTES = """SELECT e.id, k.old_type, count(*) AS votes, min(f.kw) * 100 + min(k.o) AS pos, list(k.keyword ORDER BY f.kw, k.o) AS words
  FROM texts e JOIN kw k ON contains(e.description, k.keyword) JOIN (SELECT keyword, min(o) AS kw FROM kw GROUP BY 1) f ON f.keyword = k.keyword GROUP BY ALL"""
BEST = """SELECT v.id, v.old_type AS suggested_type, v.votes, t.total AS total_votes,
  CASE WHEN v.votes = 1 THEN least(CAST(v.votes AS DOUBLE) / t.total, CAST(0.65 AS DOUBLE)) ELSE CAST(v.votes AS DOUBLE) / t.total END AS confidence,
  concat('关键词匹配 / Keyword match: ', array_to_string(v.words[1:3], '、'), CASE WHEN len(v.words) > 3 THEN concat(' 等（共 ', CAST(len(v.words) AS VARCHAR), ' 个）') ELSE '' END) AS reason
  FROM (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY votes DESC, pos) = 1) v
  JOIN (SELECT id, CAST(sum(votes) AS BIGINT) AS total FROM votes GROUP BY 1) t ON t.id = v.id"""
MISSING = "SELECT src_row AS id, description FROM journal WHERE old_type = '__MISSING_TYPE__'"


def voted(t, max_keywords):
    rows = t.journal.filter(typing.is_missing_type())
    found = typing.suggest(rows, typing.keyword_index(t.rule_table(VOTERS)), max_keywords)
    return found.filter("suggestion is not null").select(F.col("src_row").alias("id"), "suggestion.*").drop("matched_keywords")


@query("SELECT * FROM best", "journal", texts=MISSING, kw=KW, votes=VOTES, best=BEST)
def type_votes(t):
    return voted(t, typing.MAX_KEYWORDS)


@query("SELECT * FROM best", "journal", texts=MISSING, kw=KW, votes=VOTES, best=BEST)
def type_votes_large_index(t):
    """The equality join on pieces of text that replaces the broadcast for large indexes."""
    return voted(t, 0)


@query("""SELECT j.src_row, CASE WHEN b.confidence >= 0.8 THEN b.suggested_type ELSE j.old_type END AS old_type,
  CASE WHEN b.confidence < 0.8 THEN concat('[型别建议/Type suggestion: ', b.suggested_type, ' (', printf('%.0f', b.confidence * 100), '%) — ', b.reason, ']') ELSE '' END AS notes
  FROM journal j LEFT JOIN best b ON b.id = j.src_row""", "journal", texts=MISSING, kw=KW, votes=VOTES, best=BEST)
def type_applied(t):
    return typing.infer_types(t.journal, t.rule_table(VOTERS)).select(
        "src_row", "old_type", F.coalesce("notes", F.lit("")).alias("notes"))


# Word pieces that vote for the language of a document, over whole texts.
LANGUAGE = [(i + 1, f"L-{i + 1}-CR", lang, piece, 20, "CR", "x") for i, (lang, piece) in enumerate([
    ("fr", "eau"), ("fr", "ouè"), ("fr", "ç"), ("en", "tion"), ("en", "the"), ("en", "ing"), ("de", "ung"), ("de", "sch"),
    ("de", "ü"), ("es", "ción"), ("es", "ñ"), ("es", "que")])]
LANGUAGE_KW = "SELECT * FROM (VALUES " + ", ".join(f"({r[0]}, '{r[3]}', '{r[2]}')" for r in LANGUAGE) + ") AS t(o, keyword, old_type)"


@query("SELECT id, suggested_type, votes, total_votes, confidence FROM best",
       texts="SELECT doc_id AS id, text AS description FROM documents", kw=LANGUAGE_KW, votes=VOTES, best=BEST)
def document_votes(t):
    docs = t.read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    found = typing.suggest(docs, typing.keyword_index(t.rule_table(LANGUAGE)))
    return found.filter("suggestion is not null").select("id", "suggestion.*").drop("matched_keywords", "reason")


# A chart of accounts by level columns: customers under nations, some numbers shared.
LEVELS = """SELECT c_custkey AS ord, CASE WHEN c_custkey % 31 = 0 THEN NULL ELSE concat(' ', CAST(1000 + c_custkey * 7 % 8999 AS {S})) END AS ledger_id,
  c_name AS ledger_name, 'x' AS n1, concat('cat', CAST(c_nationkey % 5 AS {S})) AS name1,
  CASE WHEN c_custkey % 4 > 0 THEN 'x' END AS n2, c_mktsegment AS name2,
  CASE WHEN c_custkey % 4 > 1 THEN 'x' END AS n3, concat('s', CAST(c_nationkey AS {S}), ' ') AS name3,
  CASE WHEN c_custkey % 4 > 2 THEN 'x' END AS n4, CASE WHEN c_custkey % 8 = 7 THEN NULL ELSE 'leaf' END AS name4 FROM {customer}"""
LEVEL_ROWS = """SELECT ord, trim(ledger_id) AS code, ledger_name AS name,
    CASE WHEN n4 IS NOT NULL AND name4 IS NOT NULL THEN 4 WHEN n3 IS NOT NULL THEN 3 WHEN n2 IS NOT NULL THEN 2 ELSE 1 END AS level,
    concat_ws(' > ', name1, CASE WHEN n2 IS NOT NULL THEN name2 END, CASE WHEN n3 IS NOT NULL THEN trim(name3) END,
      CASE WHEN n4 IS NOT NULL THEN name4 END) AS full_path
  FROM (""" + LEVELS.replace("{S}", "VARCHAR").replace("{customer}", "customer") + """) WHERE ledger_id IS NOT NULL
  UNION ALL SELECT (SELECT max(c_custkey) + 1 FROM customer WHERE c_custkey % 31 <> 0), '4250', '收入SCOL', 2, '收入 > 收入SCOL'"""


@query("""SELECT c.ord, c.code, c.name, CAST(c.level AS BIGINT) AS level, c.full_path, CASE WHEN c.level = 1 THEN '' ELSE coalesce(
  (SELECT min_by(p.code, p.ord) FROM lv p WHERE p.level = c.level - 1 AND left(p.code, c.level - 1) = left(c.code, c.level - 1)),
  (SELECT min_by(p.code, p.ord) FROM lv p WHERE p.level = c.level - 1), '') END AS parent_code FROM lv c""", lv=LEVEL_ROWS)
def hierarchy_parents(t):
    sheet = t.spark.sql(LEVELS.replace("{S}", "STRING"), customer=t.read("customer"))
    return account_source.accounts_from_levels(sheet).withColumn("parent_code", F.coalesce("parent_code", F.lit("")))


@query("""SELECT CAST(substr(code, 2) AS BIGINT) AS number, name, CAST(level AS BIGINT) AS level, coalesce(parent_code, '') AS parent_code
  FROM tree WHERE level < 4""", tree=TREE)
def account_scan(t):
    """The standard account table, its text columns trimmed and its level read from text."""
    rows = tree(t).filter("level < 4").select(
        "ord", F.concat(F.lit(" "), "code").alias("code"), "name", F.concat(F.col("level").cast("string"), F.lit(".0")).alias("level"),
        "parent_code", "full_path")
    return account_source.standard_accounts(rows).select(
        F.substr("code", F.lit(2)).cast("bigint").alias("number"), "name", "level", F.coalesce("parent_code", F.lit("")).alias("parent_code"))


# Mistyped types and codes over `part` and `customer`.
TYPOS = """CASE p_partkey % 6 WHEN 0 THEN lower(p_type) WHEN 1 THEN replace(p_type, 'O', '0') WHEN 2 THEN p_type WHEN 3 THEN concat(p_type, 'X')
  WHEN 4 THEN replace(p_type, 'S', '5') ELSE concat(lower(substr(p_type, 1, 1)), substr(p_type, 2)) END"""
KNOWN = [(1, "OL"), (2, "ECONOMY"), (3, "LARGE"), (4, "Large"), (5, "PROMO"), (6, "SMALL"), (7, "MEDIUM"), (8, "STANDARD")]
KNOWN_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({o}, '{k}')" for o, k in KNOWN) + ") AS t(ord, known_type)"


@query("""SELECT value, known_type AS suggested_value, 'high' AS confidence, concat(CASE WHEN d = 0 THEN 'Case mismatch: ''' ELSE 'Likely typo: ''' END,
  value, ''' should be ''', known_type, '''') AS fix_reason FROM (SELECT v.value, k.known_type, k.ord, hamming(upper(v.value), upper(k.known_type)) AS d
    FROM values_ v JOIN known k ON length(v.value) = length(k.known_type) AND v.value <> k.known_type
    WHERE hamming(upper(v.value), upper(k.known_type)) = 0 OR (hamming(upper(v.value), upper(k.known_type)) = 1
      AND translate(upper(v.value), '0152', 'OISZ') = translate(upper(k.known_type), '0152', 'OISZ')))
  QUALIFY row_number() OVER (PARTITION BY value ORDER BY ord) = 1""", values_=f"SELECT DISTINCT {TYPOS} AS value FROM part", known=KNOWN_SQL)
def type_fixes(t):
    values = t.read("part").selectExpr(f"{TYPOS} AS value")
    return fixes.type_fixes(values, t.spark.sql(KNOWN_SQL))


CODES = """CASE c_custkey % 5 WHEN 0 THEN concat('c', CAST(c_custkey AS {S})) WHEN 1 THEN concat('X', CAST(c_custkey AS {S}))
  WHEN 2 THEN concat('C', CAST(c_custkey AS {S}), 'x') WHEN 3 THEN concat('C', CAST(c_custkey AS {S})) ELSE concat('Q', CAST(c_custkey AS {S}), '7') END"""


@query("""SELECT v.value, coalesce(u.code, k.code) AS suggested_value, CASE WHEN u.code IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence FROM v
  LEFT JOIN (SELECT v.value, min_by(c.code, c.ord) AS code FROM v JOIN codes c ON upper(c.code) = upper(v.value) AND c.code <> v.value GROUP BY 1) u ON u.value = v.value
  LEFT JOIN (SELECT v.value, min(c.code) AS code FROM v JOIN codes c ON length(c.code) = length(v.value) AND hamming(lower(c.code), lower(v.value)) <= 1
    GROUP BY 1 HAVING count(*) = 1) k ON k.value = v.value WHERE u.code IS NOT NULL OR k.code IS NOT NULL""",
       v=f"SELECT DISTINCT {CODES.replace('{S}', 'VARCHAR')} AS value FROM customer",
       codes="SELECT c_custkey AS ord, CASE WHEN c_custkey % 3 = 0 THEN concat('C', CAST(c_custkey AS VARCHAR)) ELSE concat('far-', CAST(c_custkey AS VARCHAR), '-away') END AS code FROM customer")
def account_fixes(t):
    customers = t.read("customer")
    number = F.col("c_custkey").cast("string")
    codes = customers.select(F.col("c_custkey").alias("ord"), F.when(
        F.col("c_custkey") % 3 == 0, F.concat(F.lit("C"), number)).otherwise(F.concat(F.lit("far-"), number, F.lit("-away"))).alias("code"))
    values = customers.selectExpr(f"{CODES.replace('{S}', 'STRING')} AS value")
    return fixes.account_fixes(values, codes).select("value", "suggested_value", "confidence")


@query("""SELECT p_partkey AS src_row, v AS before_value, CASE v WHEN 'large' THEN 'LARGE' ELSE upper(replace(replace(v, '0', 'O'), '5', 'S')) END AS after_value,
  'high' AS confidence FROM (SELECT p_partkey, """ + TYPOS + """ AS v, p_type FROM part) WHERE v <> p_type AND length(v) = length(p_type)
  AND hamming(upper(v), p_type) <= 1
  UNION ALL SELECT p_partkey, p_type, 'Large', 'high' FROM part WHERE p_type = 'LARGE' AND p_partkey % 6 IN (1, 2, 4)""")
def fix_suggestions(t):
    """Suggestions per issue: an issue per part whose type is not known as written."""
    detected = t.read("part").select(
        F.col("p_partkey").alias("src_row"), F.lit("error").alias("kind"), F.lit(0).alias("row_number"),
        F.lit("old_type").alias("field_name"), F.lit("unmatched_type").alias("issue_type"), F.lit("unknown type").alias("message"),
        F.expr(TYPOS).alias("actual_value"), F.concat(F.lit("JE-"), F.col("p_partkey").cast("string")).alias("entry_id"))
    return fixes.suggest_fixes(issues.detect(detected), t.spark.sql(KNOWN_SQL), t.accounts).select(
        "src_row", "before_value", "after_value", "confidence")


@query("SELECT rule_ord, rule_ord % 8 NOT IN (4, 5) AS readable FROM sheet", sheet=SHEET)
def readable_conditions(t):
    return rule_sheet(t).select("rule_ord", well_formed(F.col("condition")).alias("readable"))
