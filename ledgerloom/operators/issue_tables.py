"""Detected issues: severity, filters, groups, summaries and readable texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Issue categories, severities, and the words in an issue type that decide them.
CATEGORIES = ("data_error", "rule_error", "transformation_error", "output_error")
SEVERITIES = ("critical", "error", "warning", "info")
SEVERITY_WORDS = [
    ("critical", ("corruption", "transformation_failure", "data_loss")),
    ("error", ("validation_error", "missing_field", "invalid_type", "syntax_error", "rule_conflict")),
    ("warning", ("unusual", "potential", "should_review", "warning")),
]


def _mentions(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def severity(issue_type: Column, default: str = "error") -> Column:
    out = F.lit(default)
    for name, words in reversed(SEVERITY_WORDS):
        out = F.when(_mentions(F.lower(issue_type), words), name).otherwise(out)
    return out


def detect(issues: DataFrame, category: str = "data_error", default: str = "error",
           rule_prefix: str = "R-") -> DataFrame:
    """Errors with category and severity; ids with the rule prefix are rule ids, not entry ids."""
    is_rule = F.coalesce(F.startswith("entry_id", F.lit(rule_prefix)), F.lit(False))
    return issues.filter(F.col("kind") == "error").select(
        "src_row", "row_number", "field_name", F.lit(category).alias("error_type"),
        "issue_type", F.col("message").alias("error_message"), "actual_value",
        F.lit(None).cast("string").alias("expected_value"),
        F.when(~is_rule, F.col("entry_id")).alias("entry_id"),
        F.when(is_rule, F.col("entry_id")).alias("rule_id"),
        severity(F.col("issue_type"), default).alias("severity"), F.lit(True).alias("requires_review"))


def warnings(issues: DataFrame) -> DataFrame:
    return issues.filter(F.col("kind") == "warning")


def of(detected: DataFrame, **wanted) -> DataFrame:
    """Detected issues filtered by error_type / severity / entry_id / rule_id."""
    for column, value in wanted.items():
        detected = detected.filter(F.col(column) == value)
    return detected


def has_critical(detected: DataFrame) -> bool:
    return of(detected, severity="critical").limit(1).count() > 0


def has_errors(detected: DataFrame) -> bool:
    return detected.filter(F.col("severity").isin("critical", "error")).limit(1).count() > 0


def groups(detected: DataFrame, key: str) -> DataFrame:
    """Issue groups by entry_id / rule_id / error_type / severity: key and size.

    The members of a group are `of(detected, key=value)`; they are never packed into one row.
    """
    return detected.filter(F.coalesce(F.col(key) != "", F.lit(False))).groupBy(
        F.col(key).alias("group_key")).agg(F.count(F.lit(1)).alias("count"))


def summary(detected: DataFrame, warned: DataFrame) -> DataFrame:
    """One row of counts, with a zero for every category and severity that does not occur."""
    return detected.agg(
        F.count(F.lit(1)).alias("total_errors"),
        *[F.count_if(F.col("error_type") == c).alias(c) for c in CATEGORIES],
        *[F.count_if(F.col("severity") == s).alias(f"severity_{s}") for s in SEVERITIES],
        F.count_if("requires_review").alias("requires_review"),
        F.countDistinct(F.when(F.col("entry_id") != "", F.col("entry_id"))).alias("unique_entries_with_errors"),
        F.countDistinct(F.when(F.col("rule_id") != "", F.col("rule_id"))).alias("unique_rules_with_errors"),
    ).withColumn("total_warnings", warned.agg(F.count(F.lit(1))).scalar())


def confidence_level(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def validation_summary(detected: DataFrame, warned: DataFrame, entries: DataFrame,
                       entries_valid: int | None = None) -> DataFrame:
    """Status, error rate and confidence of a run, as one row.

    The share of valid rows is halved by critical errors and reduced by up to a fifth by warnings.
    A given number of valid entries of 0 is reported as unknown but scored as 0.
    """
    n = entries.agg(F.count(F.lit(1)).cast("double")).scalar()
    row = detected.agg(
        F.count(F.lit(1)).alias("errors_found"), F.count_if(F.col("severity") == "critical").alias("n_critical"),
    ).withColumns({"warnings_found": warned.agg(F.count(F.lit(1))).scalar(), "n": n})
    share = F.lit(float(entries_valid)) / F.col("n") if entries_valid is not None else \
        F.greatest(F.lit(0.0), 1.0 - F.col("errors_found") / F.col("n"))
    share = share * F.when(F.col("n_critical") > 0, 0.5).otherwise(1.0)
    penalty = F.least(F.lit(0.2), F.col("warnings_found") / F.col("n") * 0.5)
    share = share * F.when(F.col("warnings_found") > 0, 1.0 - penalty).otherwise(1.0)
    score = F.when(F.col("n") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    bad, warn = F.col("errors_found") > 0, F.col("warnings_found") > 0
    estimated = F.col("n").cast("bigint") - F.col("errors_found")
    return row.select(
        F.when(bad, "fail").when(warn, "warning").otherwise("pass").alias("overall_status"),
        F.when(bad, "red").when(warn, "yellow").otherwise("green").alias("status_indicator"),
        F.col("n").cast("bigint").alias("entries_processed"),
        (F.lit(entries_valid).cast("bigint") if entries_valid else estimated).alias("entries_valid"),
        "errors_found", "warnings_found",
        F.when(F.col("n") == 0, 0.0).otherwise(F.col("errors_found") / F.col("n")).alias("error_rate"),
        score.alias("confidence"), confidence_level(score).alias("confidence_level"),
    )


# Texts shown for an issue, per language. A text applies when one of its words
# occurs in the named column; the first that applies is used. {x} is filled from column x.
TITLES = {
    "en": {"data_error": "Data Error: Invalid {field_name}", "rule_error": "Rule Error: {field_title}",
           "transformation_error": "Transformation Error: {field_title}", "output_error": "Output Error: {field_title}",
           None: "Validation Error: {field_name}"},
    "zh": {"data_error": "数据错误：无效的{field_name}", "rule_error": "规则错误：{field_name}",
           "transformation_error": "转换错误：{field_name}", "output_error": "输出错误：{field_name}",
           None: "验证错误：{field_name}"},
}
DESCRIPTIONS = [
    (("missing",), {
        "en": "The required field '{field_name}' is missing or empty. This field is required for processing and cannot be omitted.",
        "zh": "必填字段 '{field_name}' 缺失或为空。该字段为处理所必需，不能省略。"}),
    (("invalid",), {
        "en": "The value for '{field_name}' is invalid: {actual}. {error_message}",
        "zh": "字段 '{field_name}' 的值无效：{actual}。{error_message}"}),
    (("syntax",), {
        "en": "The rule condition has invalid syntax: {actual}. {error_message}",
        "zh": "规则条件语法无效：{actual}。{error_message}"}),
    (("not found", "does not exist"), {
        "en": "The value '{actual}' referenced in '{field_name}' does not exist in the system. {error_message}",
        "zh": "字段 '{field_name}' 中引用的值 '{actual}' 在系统中不存在。{error_message}"}),
]
LABELS = {
    "en": {"details": "Details", "location": "Location", "fix": "How to fix", "join": ", ",
           "actual": "Actual value: {actual_value}", "expected": "Expected: {expected_value}", "rule": "Rule ID: {rule_id}",
           "row": "Row {row_number}", "entry": "Journal Entry: {entry_id}", "at_rule": "Mapping Rule: {rule_id}"},
    "zh": {"details": "详细信息", "location": "位置", "fix": "如何修复", "join": "，",
           "actual": "实际值：{actual_value}", "expected": "期望值：{expected_value}", "rule": "规则ID：{rule_id}",
           "row": "第 {row_number} 行", "entry": "日记账条目：{entry_id}", "at_rule": "映射规则：{rule_id}"},
}
# (words in the field, words in the message, words in the error type, texts)
FIXES = [
    ((), ("missing",), (), {
        "en": "Add a value for the '{field_name}' field. This field is required and cannot be empty.",
        "zh": "为字段 '{field_name}' 添加值。该字段为必填项，不能为空。"}),
    (("amount",), ("type", "invalid", "format"), (), {
        "en": "Enter a valid number for '{field_name}'. Example: 1000.50 (decimal numbers are allowed).",
        "zh": "为 '{field_name}' 输入有效数字。示例：1000.50（允许小数）。"}),
    (("date",), ("type", "invalid", "format"), (), {
        "en": "Enter a valid date for '{field_name}'. Format: YYYY-MM-DD (e.g., 2024-01-15).",
        "zh": "为 '{field_name}' 输入有效日期。格式：YYYY-MM-DD（例如：2024-01-15）。"}),
    (("year",), ("type", "invalid"), (), {
        "en": "Enter a valid year for '{field_name}'. Must be between 2000 and 2100.",
        "zh": "为 '{field_name}' 输入有效年份。必须在 2000 到 2100 之间。"}),
    (("account_code",), (), (), {
        "en": "Update '{field_name}' to use a valid account code. Check the account hierarchy for available codes.",
        "zh": "更新 '{field_name}' 以使用有效的账户代码。请查看账户层次结构以获取可用代码。"}),
    ((), (), ("account",), {
        "en": "Update '{field_name}' to use a valid account code. Check the account hierarchy for available codes.",
        "zh": "更新 '{field_name}' 以使用有效的账户代码。请查看账户层次结构以获取可用代码。"}),
    ((), (), ("syntax",), {
        "en": "Fix the rule condition syntax. Check that all operators (==, !=, >, <) are used correctly and all string values are in quotes.",
        "zh": "修复规则条件语法。检查所有运算符（==、!=、>、<）是否正确使用，所有字符串值是否在引号内。"}),
    ((), (), ("conflict",), {
        "en": "Resolve the rule conflict by either: (1) Changing one rule's condition to be more specific, (2) Adjusting rule priorities, or (3) Ensuring conflicting rules have different account codes only if intended.",
        "zh": "通过以下方式之一解决规则冲突：(1) 更改一个规则的条件使其更具体，(2) 调整规则优先级，或 (3) 确保冲突规则仅在需要时具有不同的账户代码。"}),
]
DEFAULT_FIX = {
    "en": "Review the value for '{field_name}' and ensure it meets the requirements.",
    "zh": "检查字段 '{field_name}' 的值，确保其符合要求。",
}
QUICK_FIXES = [
    ([("missing", "required")], "Add the missing '{field_name}' field to your input file"),
    ([("invalid",), ("type",)], "Check that '{field_name}' has the correct data type"),
    ([("not found",)], "Verify that the referenced value exists in your data"),
    ([("duplicate",)], "Remove duplicate entry or ensure unique identifiers"),
]


def _fill(template: str) -> Column:
    """A text with {column} marks as a concatenation."""
    values = {
        "field_title": F.initcap(F.replace("field_name", F.lit("_"), F.lit(" "))),
        "actual": F.coalesce(F.col("actual_value"), F.lit("None")),
        "row_number": F.col("row_number").cast("string"),
    }
    # Odd pieces are the column names between braces.
    pieces = template.replace("}", "{").split("{")
    parts = [values.get(p, F.col(p)) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def _first_of(options: list[tuple[Column, Column]], default: Column) -> Column:
    out = default
    for condition, text in reversed(options):
        out = F.when(condition, text).otherwise(out)
    return out


def message(language: str = "en") -> Column:
    """Readable text of a detected issue: title, description, details, location, how to fix."""
    lang = language if language in LABELS else "en"
    labels, field = LABELS[lang], F.lower("field_name")
    text, category = F.lower("error_message"), F.lower("error_type")
    title = _first_of([(F.col("error_type") == k, _fill(t)) for k, t in TITLES[lang].items() if k],
                      _fill(TITLES[lang][None]))
    described = _first_of([(_mentions(text, words), _fill(t[lang])) for words, t in DESCRIPTIONS], F.col("error_message"))

    def joined(*pairs):
        inside = F.concat_ws(labels["join"], *[F.when(c, _fill(labels[k])) for c, k in pairs])
        return F.when(inside != "", inside)

    filled = {c: F.coalesce(F.col(c) != "", F.lit(False)) for c in ("rule_id", "entry_id")}
    details = joined((F.col("actual_value").isNotNull(), "actual"), (F.col("expected_value").isNotNull(), "expected"),
                     (filled["rule_id"], "rule"))
    location = joined((F.col("row_number") > 0, "row"), (filled["entry_id"], "entry"), (filled["rule_id"], "at_rule"))

    def applies(fields, words, types):
        out = F.lit(True)
        for column, wanted in ((field, fields), (text, words), (category, types)):
            if wanted:
                out = out & _mentions(column, wanted)
        return out

    fix = _first_of([(applies(f, w, t), _fill(texts[lang])) for f, w, t, texts in FIXES], _fill(DEFAULT_FIX[lang]))
    return F.concat_ws(
        "\n", F.concat(F.lit("**"), title, F.lit("**")), F.concat(F.lit("\n"), described),
        F.concat(F.lit(f"\n**{labels['details']}:** "), details),
        F.concat(F.lit(f"\n**{labels['location']}:** "), location),
        F.concat(F.lit(f"\n**{labels['fix']}:** "), fix))


def quick_fix() -> Column:
    """A one-line hint, NULL when no hint applies."""
    text = F.lower("error_message")
    options = []
    for word_sets, template in QUICK_FIXES:
        condition = F.lit(True)
        for words in word_sets:
            condition = condition & _mentions(text, words)
        options.append((condition, _fill(template)))
    return _first_of(options, F.lit(None).cast("string"))
