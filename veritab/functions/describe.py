"""Rule-based column and edge descriptions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column-name pattern, meaning, confidence; the first match wins.
NAME_PATTERNS = [
    (r"^(id|.*_id|.*_pk)$", "主键 / 外键 ID", 0.95),
    (r"^(created_at|updated_at|.*_at)$", "时间戳 (创建/更新时间, UTC)", 0.95),
    (r"^(is_|has_|.*_flag)$", "布尔标志位 (0/1 或 true/false)", 0.90),
    (r"^.*_(count|num|qty)$", "数量 / 计数", 0.90),
    (r"^.*_(amount|price|total|cost)$", "金额 (业务单位)", 0.90),
    (r"^(email|.*_email)$", "邮箱地址 (PII)", 0.95),
    (r"^(phone|mobile|.*_phone|.*_tel)$", "手机号 (PII, 11 位)", 0.95),
    (r"^(id_card|.*_idno|.*_id_card)$", "身份证号 (PII, 18 位)", 0.95),
    (r"^.*_(country|nation)$", "国家代码 (ISO 3166-1 alpha-2/3)", 0.85),
    (r"^.*_(status|state)$", "业务状态枚举 (e.g. pending/paid/shipped)", 0.75),
    (r"^.*_(url|link|href)$", "资源 URL", 0.85),
    (r"^.*_(ip|ip_address)$", "IP 地址 (PII)", 0.90),
    (r"^.*_(uuid|guid)$", "全局唯一标识 (UUID/GUID)", 0.95),
    (r"^.*_(hash|md5|sha\d+)$", "哈希值", 0.90),
    (r"^.*_(name|user_name|user)$", "用户/客户名称", 0.85),
    (r"^.*_(address|addr)$", "地址 (PII)", 0.90),
    (r"^(date|day|.*_date|.*_day)$", "日期 (不含时间, YYYY-MM-DD)", 0.90),
    (r"^.*_(lat|latitude)$", "纬度 (WGS84, -90 to 90)", 0.90),
    (r"^.*_(lng|long|longitude)$", "经度 (WGS84, -180 to 180)", 0.90),
    (r"^.*_(rate|ratio|percent|pct)$", "比率 / 百分比 (0-1 或 0-100)", 0.85),
    (r"^.*_(score|rank)$", "评分 / 排名 (数值)", 0.80),
    (r"^(name|title|.*_name)$", "名称 / 标题", 0.80),
    (r"^.*_(type|category|kind)$", "类型 / 分类", 0.75),
    (r"^.*_(version|v)$", "版本号 (semver/整数)", 0.80),
    (r"^.*_(path|file_path|key|prefix)$", "路径 / 前缀 (GCS/HTTP/SQL)", 0.85),
]

# Sample-value pattern, meaning, confidence; the first match wins.
VALUE_PATTERNS = [
    (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "邮箱格式 (PII)", 0.95),
    (r"^1[3-9]\d{9}$", "中国手机号 (11 位, PII)", 0.95),
    (r"^\d{17}[\dXx]$", "中国身份证号 (18 位, PII)", 0.95),
    (r"^[A-Z]{2}$", "ISO 3166-1 alpha-2 国家代码", 0.85),
    (r"^[A-Z]{3}$", "ISO 3166-1 alpha-3 国家代码", 0.85),
    (r"^\d{4}-\d{2}-\d{2}", "ISO 8601 日期", 0.90),
    (r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", "IPv4 地址 (PII)", 0.90),
    (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "UUID 字符串", 0.95),
    (r"^[0-9a-f]{32}$", "MD5 哈希", 0.90),
    (r"^[0-9a-f]{40}$", "SHA1 哈希", 0.90),
    (r"^[0-9a-f]{64}$", "SHA256 哈希", 0.90),
]

# Source data type -> hint.
TYPE_HINTS = {
    "Int8": "8 位有符号整数",
    "Int16": "16 位有符号整数",
    "Int32": "32 位有符号整数",
    "Int64": "64 位有符号整数",
    "UInt8": "8 位无符号整数",
    "UInt16": "16 位无符号整数",
    "UInt32": "32 位无符号整数",
    "UInt64": "64 位无符号整数",
    "Float32": "32 位浮点数",
    "Float64": "64 位浮点数 (双精度)",
    "Decimal": "高精度小数 (金额/汇率)",
    "String": "字符串",
    "FixedString": "定长字符串",
    "UUID": "UUID 唯一标识",
    "Date": "日期 (YYYY-MM-DD)",
    "DateTime": "日期时间",
    "DateTime64": "高精度日期时间",
    "Bool": "布尔值 (true/false)",
    "Array": "数组",
    "JSON": "JSON 对象",
    "Enum8": "枚举 (8 位)",
    "Enum16": "枚举 (16 位)",
}

# PII class -> hint.
PII_HINTS = {
    "email": "邮箱 (PII)",
    "phone": "手机号 (PII)",
    "id_card": "身份证号 (PII)",
    "name": "姓名 (PII)",
    "address": "地址 (PII)",
    "ip": "IP (PII)",
    "card_bin": "银行卡 BIN (前 6 位, PII)",
}

# Fixed values: (component, transform type or subtype) -> edge description.
EDGE_TEMPLATES = {
    ("airflow_task", "copy"): "由 Airflow DAG `{dag_id}` 的 task `{task_id}` 复制到下游",
    ("airflow_task", "filter"): "由 Airflow `{dag_id}.{task_id}` 按条件 `{filter_expr}` 过滤",
    ("airflow_task", "cast"): "由 Airflow `{dag_id}.{task_id}` 类型转换 (`{transform_expr}`)",
    ("airflow_task", "expression"): "由 Airflow `{dag_id}.{task_id}` 派生 (`{transform_expr}`)",
    ("airflow_task", "aggregation"): "由 Airflow `{dag_id}.{task_id}` 聚合 (`{transform_expr}`)",
    ("dbt_model", "ref"): "dbt model `{model_name}` 引用 `{upstream_fqn}` 构建",
    ("dbt_model", "expression"): "dbt model `{model_name}` 派生 (`{transform_expr}`)",
    ("mex_model", "io"): "MEX 黑盒模型 `{model_name}` 读 `{upstream_fqn}`, 写 `{downstream_fqn}`",
    ("mex_model", "expression"): "MEX 模型 `{model_name}` 派生表达式 `{transform_expr}`",
    ("mex_model", "inference"): "MEX 模型 `{model_name}` 推理: `{transform_expr}`",
    ("flink_job", "sql"): "由 Flink Job `{job_id}` SQL `{sql_glimpse}` 转换生成",
    ("flink_job", "aggregation"): "Flink Job `{job_id}` 聚合 (`{transform_expr}`)",
    ("superset_chart", "query"): "Superset chart `{chart_id}` 查表 `{upstream_fqn}`, 字段: `{columns}`",
    ("superset_chart", "derivation"): "由 Superset chart `{chart_id}` 虚拟列派生 (`{transform_expr}`)",
    ("sql", "cte"): "由 SQL `{sql_glimpse}` 转换生成",
    ("sql", "expression"): "SQL 派生表达式 `{transform_expr}`",
    ("gcs_copy", "copy"): "GCS 复制 `{upstream_fqn}` → `{downstream_fqn}`",
    ("clickhouse_table", "view"): "ClickHouse view `{downstream_fqn}` 引用 `{upstream_fqn}`",
}


def _first_match(text: Column, rules) -> Column:
    """Struct <meaning, confidence> of the first matching rule, else null."""
    chain = None
    for pattern, meaning, confidence in rules:
        hit = F.struct(F.lit(meaning).alias("meaning"), F.lit(confidence).alias("confidence"))
        chain = F.when(text.rlike(pattern), hit) if chain is None else chain.when(text.rlike(pattern), hit)
    return chain


def _lookup(key: Column, table: dict) -> Column:
    entries = F.create_map(*[F.lit(v) for pair in table.items() for v in pair])
    return F.coalesce(F.try_element_at(entries, F.coalesce(key, F.lit(""))), F.lit(""))


def name_rule(name: Column) -> Column:
    """Meaning and confidence of a column name."""
    return _first_match(F.lower(name), NAME_PATTERNS)


def value_rule(samples: Column, read: int = 5) -> Column:
    """Meaning and confidence of the first matching value among the first ``read`` samples;
    ``value_pattern_scan`` reads a whole table."""
    hits = F.transform(F.slice(samples, 1, read), lambda s: _first_match(s, VALUE_PATTERNS))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), F.lit(0))


def type_hint(data_type: Column) -> Column:
    """Hint of a type name, precision dropped; '' when unknown."""
    return _lookup(F.trim(F.substring_index(data_type, "(", 1)), TYPE_HINTS)


def describe_columns(columns: DataFrame, table_name: Column) -> DataFrame:
    """Catalog columns with ``inferred``: <description, confidence, rationale, origin>.

    Order: confident PII class, sample values, column name, data type, template.
    The rule results become columns first, so each pattern list runs once per row
    although several branches read its result.
    """
    name, dtype = F.col("name"), F.col("data_type")

    def result(description, confidence, rationale, origin="rules"):
        return F.struct(
            description.alias("description"),
            confidence.cast("double").alias("confidence"),
            rationale.alias("rationale"),
            F.lit(origin).alias("origin"),
        )

    pii, values, named, hint = F.col("_pii"), F.col("_values"), F.col("_named"), F.col("_hint")
    n = F.size("sample_values").cast("string")
    from_pii = result(
        F.concat(pii, F.lit(" (PII 分类由 "), F.coalesce(F.col("pii_source"), F.lit("unknown")), F.lit(" 推断)")),
        F.greatest(F.lit(0.85), F.col("pii_confidence")),
        F.concat(F.lit("pii_class="), F.col("pii_class")),
    )
    from_values = result(
        F.concat(values["meaning"], F.lit(" (基于 "), n, F.lit(" 个样本值)")),
        values["confidence"],
        F.concat(F.lit("value_pattern_matched,samples="), n),
    )
    from_name = result(
        F.when(
            (hint != "") & ~F.contains(named["meaning"], hint), F.concat(named["meaning"], F.lit(", "), hint)
        ).otherwise(F.concat(named["meaning"], F.lit(" ("), dtype, F.lit(")"))),
        named["confidence"],
        F.concat(F.lit("name_pattern_matched,type="), dtype),
    )
    from_type = result(
        F.concat(name, F.lit(" ("), hint, F.lit(")")), F.lit(0.5), F.concat(F.lit("type_only,type="), dtype)
    )
    template = result(
        F.concat(table_name, F.lit(" 表的 "), name, F.lit(" 列 (类型 "), dtype, F.lit(")")),
        F.lit(0.4),
        F.lit("no_rule_match,fallback_to_template"),
        "llm",
    )
    ruled = columns.withColumns(
        {
            "_pii": F.when(F.col("pii_class") != "none", _lookup(F.col("pii_class"), PII_HINTS)).otherwise(""),
            "_values": value_rule(F.col("sample_values")),
            "_named": name_rule(name),
            "_hint": type_hint(dtype),
        }
    )
    chosen = (
        F.when((pii != "") & (F.col("pii_confidence") >= 0.7), from_pii)
        .when(values.isNotNull(), from_values)
        .when(named.isNotNull(), from_name)
        .when(hint != "", from_type)
        .otherwise(template)
    )
    # A one-element explode is a fence: a filter on the result stays above it
    # instead of being pushed down as a second copy of all rules.
    return ruled.withColumn("inferred", F.explode(F.array(chosen))).drop("_pii", "_values", "_named", "_hint")


def value_pattern_scan(df: DataFrame, text: str) -> DataFrame:
    """Words of a text column that match each value pattern, over the whole table.

    Words are stripped of surrounding punctuation. One pass, no explode: a
    single joint pattern picks the few candidate words of a row, only those are
    tried against each pattern, and counts are summed map-side.
    """
    opening, closing = r"[(\[<\"']", r"[)\]>\"',;:.!?]"
    joint = "|".join(
        "(?:" + p.replace("^", f"^{opening}*", 1).removesuffix("$") + (f"{closing}*$)" if p.endswith("$") else ")")
        for p, _, _ in VALUE_PATTERNS
    )
    candidates = F.filter(F.split(F.col(text), r"\s+"), lambda w: w.rlike(joint))
    words = F.transform(candidates, lambda w: F.regexp_replace(w, f"^{opening}+|{closing}+$", ""))

    def matching(pattern):
        return F.size(F.filter("w", lambda w: w.rlike(pattern)))

    found = df.select(words.alias("w")).select(
        *[matching(pattern).alias(f"h{i}") for i, (pattern, _, _) in enumerate(VALUE_PATTERNS)]
    )
    sums = []
    for i in range(len(VALUE_PATTERNS)):
        sums += [F.sum(f"h{i}").alias(f"w{i}"), F.count_if(F.col(f"h{i}") > 0).alias(f"r{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(meaning).alias("meaning"), F.col(f"w{i}").alias("words"), F.col(f"r{i}").alias("rows_hit"))
            for i, (_, meaning, _) in enumerate(VALUE_PATTERNS)
        ]
    )
    return found.agg(*sums).select(F.inline(rows))


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field:
            parts.append(values[field])
    return F.concat(*parts)


# Texts of table edges that no template covers, by transform type, and of all others.
GENERIC_EDGES = {
    "copy": "由 {up} 复制到 {down}",
    "aggregation": "{up} 聚合到 {down} ({expr})",
    "expression": "{up} 派生 {down} ({expr})",
    "derivation": "由 {up} 派生 {down}",
}
GENERIC_EDGE = "{up} → {down} ({component}/{kind})"
# Texts of column edges by transform type, and of all others.
COLUMN_EDGES = {
    "direct": "原样透传 {up} (类型 {up_type} → {down_type})",
    "cast": "由 {up} 转换类型至 {down_type} ({expr})",
    "rename": "重命名 {up} → {down}",
    "aggregation": "聚合表达式 {expr} 生成 {down}",
    "window": "窗口函数 {expr} → {down}",
    "arithmetic": "算术运算 {expr} → {down}",
    "function": "函数调用 {expr} → {down} ({up_type} → {down_type})",
    "expression": "派生表达式 {expr} → {down}",
    "derivation": "由上游 {up} 派生 {down} ({expr})",
    "passthrough": "透传 {up}",
}
COLUMN_EDGE = "{up} → {down} ({kind})"


def edge_description() -> Column:
    """Struct <description, confidence, rationale> of a table edge row.

    Template by (component, type) 0.9, by (component, subtype) 0.8, generic 0.5.
    Reads component, transform_type, transform_subtype, transform_expression,
    sql, job_id, upstream_fqn and downstream_fqn.
    """
    component = F.when(F.coalesce(F.col("component"), F.lit("")) == "", "sql").otherwise(F.col("component"))
    ttype, subtype = F.col("transform_type"), F.coalesce(F.col("transform_subtype"), F.lit(""))
    expr = F.coalesce("transform_expression", F.lit(""))
    glimpse = F.replace(F.coalesce(F.col("sql"), F.lit("")), F.lit("\n"), F.lit(" "))
    job, up, down = F.coalesce(F.col("job_id"), F.lit("")), F.col("upstream_fqn"), F.col("downstream_fqn")
    shown_columns = F.when(expr != "", expr).otherwise("(all)")
    common = {
        "model_name": job, "job_id": job, "chart_id": job, "upstream_fqn": up, "downstream_fqn": down,
        "sql_glimpse": glimpse, "filter_expr": expr, "columns": shown_columns,
    }
    by_type = common | {
        "dag_id": F.substring_index(job, ".", 1),
        "task_id": F.substring_index(job, ".", -1),
        "transform_expr": expr,
    }
    by_subtype = common | {
        "dag_id": job, "task_id": job, "transform_expr": F.when(expr != "", expr).otherwise(subtype),
    }

    def result(description, confidence, *rationale):
        return F.struct(
            description.alias("description"),
            F.lit(confidence).alias("confidence"),
            F.concat(*rationale).alias("rationale"),
        )

    def templated(key, values, confidence):
        chain = None
        for (comp, kind), template in EDGE_TEMPLATES.items():
            hit = (component == comp) & (key == kind)
            found = result(_fill(template, values), confidence, F.lit(f"template_match:{comp}/{kind}"))
            chain = F.when(hit, found) if chain is None else chain.when(hit, found)
        return chain

    plain = {"up": up, "down": down, "component": component, "kind": ttype,
             "expr": F.when(expr != "", expr).otherwise(ttype)}
    generic = _fill(GENERIC_EDGE, plain)
    for kind, template in GENERIC_EDGES.items():
        generic = F.when(ttype == kind, _fill(template, plain)).otherwise(generic)
    return F.coalesce(
        templated(ttype, by_type, 0.9),
        templated(subtype, by_subtype, 0.8),
        result(generic, 0.5, F.lit("generic_template:"), component, F.lit("/"), ttype),
    )


def propagated_description(edge_text: Column) -> Column:
    """Text a column edge inherits from its table edge."""
    return F.concat(
        F.lit("["), F.col("transform_type"), F.lit("] "), edge_text, F.lit(" (列 "),
        F.coalesce(F.col("transform_expression"), F.lit("")), F.lit(")"),
    )


def column_edge_description(
    ttype: Column, expr: Column, up: Column, up_type: Column, down: Column, down_type: Column
) -> Column:
    """Description of a column edge by its transform type."""
    values = {"up": up, "down": down, "up_type": up_type, "down_type": down_type, "expr": expr, "kind": ttype}
    out = _fill(COLUMN_EDGE, values)
    for kind, template in COLUMN_EDGES.items():
        out = F.when(ttype == kind, _fill(template, values)).otherwise(out)
    return out


def sample_preview(samples: Column, values: int = 5, width: int = 40) -> Column:
    """First values as text, each cut to ``width`` characters with an ellipsis; for display only."""
    shown = F.transform(
        F.slice(samples, 1, values),
        lambda s: F.when(s.isNull(), "null")
        .when(F.length(s) > width, F.concat(F.substring(s, 1, width), F.lit("…")))
        .otherwise(s),
    )
    text = F.concat(F.lit("["), F.array_join(shown, ", "), F.lit("]"))
    return F.when(samples.isNull() | (F.size(samples) == 0), "(无样本)").otherwise(text)


def row_preview(columns: list[str], shown: int = 8) -> Column:
    """One table row as '{ a=1, b=x }' over the first columns; for display only."""
    cells = [
        F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in columns[:shown]
    ]
    return F.concat(F.lit("{ "), F.concat_ws(", ", *cells), F.lit(" }"))
