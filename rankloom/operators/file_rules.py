"""Rules over the files of a folder and over whole sets: names, presence, secrets in contents, the specification's documents.

All give rows (entity, rule, severity, ok) as validation.constraints() does, so that validation.summary() sums them up. A set
rule (presence, counts) is a row of its own, whether or not a file stands for it.

Contents are read by the binaryFile source, which the size limit is pushed down to. Spark's readers leave out files and folders
whose names begin with a dot or an underscore; listing() has their names too, contents() doesn't have their bytes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import parsed_json
from rankloom.operators.validation import SECRET_PATTERNS, constraints, secret_lines

# What scans leave out, what may not be committed, which documents have to be there.
SKIPPED_FOLDERS = (".git", "node_modules", ".next", "__pycache__", ".venv", "venv", "out")
LARGEST_TEXT, SNIFFED = 5 * 1024 * 1024, 8192
FORBIDDEN_FOLDERS = ("node_modules", ".next", "__pycache__", "tmp", "scratch", "backup")
FORBIDDEN_FILES, FORBIDDEN_ENDINGS = (".env", ".DS_Store"), (".pyc", ".log")
PRESENT = {"docs/standards.md": "error", "docs/hld.md": "warning", "docs/architecture.md": "warning", "README.md": "warning"}
FIELD_DEFINITIONS = ("nct_id", "lead_sponsor", "phases", "enrollment_count", "arms", "inclusion_criteria", "exclusion_criteria", "primary_outcomes", "masking")
#: Ends of lines, as text readers have them.
_LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of all files below root, paths relative to it; names only, which the driver lists (a repository's tree)."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.getFileStatus(at).getPath().toUri().getPath().rstrip("/")
    found, rows = fs.listFiles(at, True), []
    while found.hasNext():
        one = found.next()
        rows.append((one.getPath().toUri().getPath()[len(top) + 1 :], one.getLen()))
    return spark.createDataFrame(rows, "path string, size long")


def _folders(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def walked(files: DataFrame) -> DataFrame:
    """files (path, ...) but for those in skipped folders."""
    return files.where(~F.arrays_overlap(_folders(F.col("path")), F.array(*map(F.lit, SKIPPED_FOLDERS))))


def committed_rules(paths: DataFrame) -> DataFrame:
    """Each path's rules: no forbidden folder or file, no blank, snake case for Python files."""
    path = F.col("path")
    name = _name(path)
    old = lambda part: F.endswith(part, F.lit("_old"))
    ending = F.array(*map(F.lit, FORBIDDEN_ENDINGS))
    return constraints(paths, path, {
        "no_forbidden_folder": ("error", ~F.exists(_folders(path), lambda part: part.isin(*FORBIDDEN_FOLDERS) | old(part))),
        "no_forbidden_file": ("error", ~(name.isin(*FORBIDDEN_FILES) | F.exists(ending, lambda e: F.endswith(name, e)) | old(name))),
        "no_blank": ("error", ~F.contains(path, F.lit(" "))),
        "snake_case": ("error", ~F.endswith(name, F.lit(".py")) | name.isin("__init__.py", "__main__.py") | name.rlike(r"^[a-z_][a-z0-9_]*\.py$")),
    })


def presence(paths: DataFrame, wanted: Mapping[str, str] = PRESENT) -> DataFrame:
    """A row for each wanted path (to its severity): whether it is among paths."""
    rows = paths.sparkSession.createDataFrame(list(wanted.items()), "path string, severity string")
    there = paths.select("path").distinct().withColumn("there", F.lit(True))
    return rows.join(there, "path", "left").select(F.col("path").alias("entity"), F.lit("present").alias("rule"), "severity", F.coalesce("there", F.lit(False)).alias("ok"))


def sole(names: DataFrame, own: str, pattern: str) -> DataFrame:
    """A row for each of the sibling folders (name): none but `own` may match the pattern, in any case of letters."""
    alike = F.col("name").rlike(f"(?i){pattern}")
    return names.select(F.col("name").alias("entity"), F.lit("no_rogue_sibling").alias("rule"), F.lit("error").alias("severity"), (~alike | (F.col("name") == own)).alias("ok"))


def contents(spark: SparkSession, root: str, largest: int = LARGEST_TEXT) -> DataFrame:
    """(path, text) of the text files below root that are scanned: neither empty nor over `largest` bytes nor binary (a zero byte near the beginning)."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "path string, text string")
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    below = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", ""), f"^{_quoted(top)}/", "")
    sized = files.where((F.col("length") > 0) & (F.col("length") <= largest)).select(below.alias("path"), "content")
    zero = F.contains(F.substring("content", 1, SNIFFED), F.lit(bytearray(b"\0")))
    name = _name(F.col("path"))
    texts = walked(sized).where((name != ".env") & ~F.startswith(name, F.lit(".env.")) & ~zero)
    return texts.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def secret_rules(texts: DataFrame, patterns: Mapping[str, str] = SECRET_PATTERNS) -> DataFrame:
    """A row for each text (path, text), and one more for each line with a secret: entity path:line."""
    lines = texts.select("path", F.regexp_replace("text", _LINE_END, "\n").alias("text"))
    hits = secret_lines(lines, "path", "text", patterns).select(F.concat_ws(":", "id", "line_no").alias("entity"), F.concat(F.lit("no_"), "pattern").alias("rule"), F.lit("error").alias("severity"), F.lit(False).alias("ok"))
    return texts.select(F.col("path").alias("entity"), F.lit("scanned_for_secrets").alias("rule"), F.lit("error").alias("severity"), F.lit(True).alias("ok")).unionByName(hits)


def json_rules(texts: DataFrame, folders: tuple[str, ...] = ("data", "shared", "evals")) -> DataFrame:
    """A row for each JSON file below the folders: whether it is valid."""
    mine = texts.where(F.endswith("path", F.lit(".json")) & F.element_at(F.split("path", "/"), 1).isin(*folders))
    return constraints(mine, F.col("path"), {"valid_json": ("error", parsed_json("text").isNotNull())})


def specification_rules(text: DataFrame, golden: DataFrame, documents: int | None = None, fields: tuple[str, ...] = FIELD_DEFINITIONS) -> DataFrame:
    """Set rules on the specification, whose JSON is `text` (one row), and on the golden documents (doc_id).

    The number of documents (if given) and each golden document's presence are errors; missing field definitions and
    sections of the evaluation's configuration are warnings.
    """
    kind = "struct<documents: array<struct<doc_id: string, fields: map<string, variant>>>, eval_config: map<string, variant>>"
    spec = text.select(F.from_json("text", kind).alias("s")).select("s.documents", "s.eval_config")
    has = lambda section: F.coalesce(F.map_contains_key("eval_config", section), F.lit(False))
    rules = {
        "readable": ("error", F.col("documents").isNotNull()),
        "has_eval_config": ("warning", F.col("eval_config").isNotNull()),
        "has_extraction_config": ("warning", has("extraction")),
        "has_retrieval_config": ("warning", has("retrieval")),
    }
    if documents is not None:
        rules["document_count"] = ("error", F.size("documents") == documents)
    whole = constraints(spec, F.lit("specification"), rules)
    each = spec.select(F.explode("documents").alias("d")).select("d.doc_id", "d.fields").dropDuplicates(["doc_id"])
    joined = golden.select("doc_id").distinct().join(each, "doc_id", "left")
    missing = F.size(F.array_except(F.array(*map(F.lit, fields)), F.map_keys("fields")))
    # Only documents that are there are asked for their definitions.
    defined = constraints(joined.where("fields IS NOT NULL"), F.col("doc_id"), {"field_definitions": ("warning", missing == 0)})
    return whole.unionByName(constraints(joined, F.col("doc_id"), {"specified": ("error", F.col("fields").isNotNull())})).unionByName(defined)


def folder_rules(spark: SparkSession, root: str, wanted: Mapping[str, str] = PRESENT) -> DataFrame:
    """All rules on the files below root."""
    paths, texts = walked(listing(spark, root)), contents(spark, root)
    return committed_rules(paths).unionByName(presence(paths, wanted)).unionByName(secret_rules(texts)).unionByName(json_rules(texts))
