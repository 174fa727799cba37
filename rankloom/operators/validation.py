"""Constraint checks as rows: secrets by pattern, JSON validity, golden data, paths, and a summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import parsed_json

#: Patterns of secrets in repository files.
SECRET_PATTERNS = {
    "aws_access_key": "AKIA[0-9A-Z]{16}",
    "sk_key": "sk-[A-Za-z0-9]{20,}",
    "slack_token": "xox[baprs]-[0-9A-Za-z-]{10,}",
    "private_key": "BEGIN (RSA|OPENSSH|EC) PRIVATE KEY",
    "api_key_literal": "OLLAMA_API_KEY\\s*=\\s*[\"'][^\"']{4,}[\"']",
}


def secret_lines(files: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str] = SECRET_PATTERNS) -> DataFrame:
    """(id, line_no, pattern) of each line that a pattern is found in; texts without any aren't split."""
    any_of = "|".join(f"(?:{p})" for p in patterns.values())
    lines = files.where(F.col(text_col).rlike(any_of)).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    hit = F.array(*[F.when(F.col("line").rlike(p), F.lit(n)) for n, p in patterns.items()])
    return lines.select("id", (F.col("pos") + 1).cast("long").alias("line_no"), F.explode(F.filter(hit, lambda x: x.isNotNull())).alias("pattern"))


def secret_counts(files: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str] = SECRET_PATTERNS) -> DataFrame:
    """(pattern, n_lines) for each pattern, also those found nowhere."""
    names = files.sparkSession.createDataFrame([(n,) for n in patterns], "pattern string")
    found = secret_lines(files, id_col, text_col, patterns).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_lines"))
    return names.join(found, "pattern", "left").select("pattern", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"))


def invalid_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return df.where(F.col(json_col).isNotNull() & parsed_json(json_col).isNull()).select(F.col(id_col).alias("id"))


def constraints(df: DataFrame, entity: Column, rules: Mapping[str, tuple[str, Column]]) -> DataFrame:
    """(entity, rule, severity, ok) for each row and rule; rules: name to (severity, condition). A null condition fails."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.coalesce(c, F.lit(False)).alias("ok")) for n, (s, c) in rules.items()])
    return df.select(entity.alias("entity"), F.inline(rows))


def summary(checked: DataFrame) -> DataFrame:
    """(rule, severity, n, n_failed, passed): a failed warning passes."""
    counts = checked.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("ok")).alias("n_failed"))
    return counts.withColumn("passed", (F.col("n_failed") == 0) | (F.col("severity") == "warning"))


# Fields that golden records have, those that are lists, and those that may not be empty.
REQUIRED = (
    "nct_id", "brief_title", "lead_sponsor", "conditions", "phases", "study_type", "allocation", "enrollment_count", "overall_status",
    "start_date", "arms", "interventions", "eligibility_sex", "inclusion_criteria", "exclusion_criteria", "primary_outcomes", "secondary_outcomes",
)
LISTS = ("inclusion_criteria", "exclusion_criteria", "conditions", "phases", "arms", "interventions", "primary_outcomes", "secondary_outcomes")
FILLED = ("inclusion_criteria", "exclusion_criteria")


def query_rules() -> dict[str, tuple[str, Column]]:
    """Rules on rows (doc_id, question, rationale) of golden queries."""
    return {
        "has_rationale": ("error", F.col("rationale").isNotNull()),
        "asks_something": ("error", F.trim("question") != ""),
    }


def golden_rules(required: list[str], lists: list[str], queries: int = 5, spans: int = 2, least_bytes: int = 500) -> dict[str, tuple[str, Column]]:
    """Rules on rows (text, golden VARIANT, queries ARRAY<STRUCT<id, question, expected_spans>>)."""
    v = F.col("golden")
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("MISSING"))
    rules = {
        "source_present": ("error", F.col("text").isNotNull()),
        "source_size": ("warning", F.octet_length("text") >= least_bytes),
        "golden_present": ("error", v.isNotNull()),
        "query_count": ("error", F.size("queries") == queries),
        "query_keys": ("error", F.forall("queries", lambda q: q["id"].isNotNull() & q["question"].isNotNull() & q["expected_spans"].isNotNull())),
        "span_count": ("warning", F.forall("queries", lambda q: F.size(q["expected_spans"]) >= spans)),
        "span_keys": ("error", F.forall("queries", lambda q: F.forall(q["expected_spans"], lambda s: s["section"].isNotNull() & s["quote"].isNotNull()))),
        "nct_id": ("error", F.startswith(F.try_variant_get(v, "$.nct_id", "string"), F.lit("NCT"))),
        "enrollment_count": ("error", kind("enrollment_count") == "BIGINT"),
    }
    rules |= {f"has_{k}": ("warning", kind(k) != "MISSING") for k in required}
    rules |= {f"list_{k}": ("error", kind(k).startswith("ARRAY")) for k in lists}
    return rules | {f"filled_{k}": ("error" if k in FILLED else "warning", kind(k) != "ARRAY<VOID>") for k in lists}


def path_rules(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Hygiene of file names: no blanks, no upper-case extension, no artefacts of editors or systems."""
    p = F.col(path_col)
    return constraints(paths, p, {
        "no_blanks": ("error", ~F.contains(p, F.lit(" "))),
        "lower_extension": ("warning", ~p.rlike(r"\.[^./]*[A-Z][^./]*$")),
        "no_artefacts": ("error", ~p.rlike(r"(^|/)(\.DS_Store|Thumbs\.db|__pycache__|.*~|.*\.swp)(/|$)")),
    })
