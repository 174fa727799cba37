"""Queries on chunking, text functions and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.operators import chunking, extraction, file_rules, retrieval, validation
from rankloom.plans.registry import Registry, norm, strip, table

R = Registry()
_MAX, _OVERLAP = 800, 100
_STEP = _MAX - _OVERLAP


@R.add(f"SELECT doc_id, substr({norm('text')}, 1, 60) AS fingerprint, length({norm('text')}) AS n_chars FROM documents")
def quote_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fingerprint("text").alias("fingerprint"), F.length(T.normalized("text")).cast("long").alias("n_chars"))


@R.add(f"""SELECT s.s_suppkey, n.n_name, (w = '' OR contains(h, w) OR len(list_filter(string_split(h, ' > '), lambda p: contains(p, l))) > 0) AS matches FROM (
  SELECT s_suppkey, {norm("'Suppliers > ' || s_name || ' > Nation ' || s_nationkey")} AS h, s_nationkey FROM supplier) s
  JOIN (SELECT n_nationkey, n_name, {norm("CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN 'Part A >  NATION ' || n_nationkey ELSE n_name END")} AS w,
    trim(string_split({norm("CASE WHEN n_nationkey % 3 = 0 THEN '' WHEN n_nationkey % 3 = 1 THEN 'Part A >  NATION ' || n_nationkey ELSE n_name END")}, ' > ')[-1]) AS l FROM nation) n ON n.n_nationkey = s.s_nationkey""")
def section_match(spark, d):
    s = table(spark, d, "supplier").withColumn("section", F.concat(F.lit("Suppliers > "), "s_name", F.lit(" > Nation "), F.col("s_nationkey").cast("string")))
    kind = F.col("n_nationkey") % 3
    want = F.when(kind == 0, F.lit("")).when(kind == 1, F.concat(F.lit("Part A >  NATION "), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name", want.alias("want"))
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name", T.section_matches(F.col("section"), F.col("want")).alias("matches"))


@R.add(f"""SELECT doc_id, CAST(i AS BIGINT) AS piece, length(t) AS n_chars, sha256(t) AS h FROM (SELECT doc_id, i, CASE WHEN i < n THEN substr(text, i * {_STEP} + 1, {_MAX}) ELSE substr(text, n * {_STEP} + 1) END AS t
  FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT doc_id, text, CAST(greatest(0, ceil((length(text) - {_MAX}) / {_STEP})) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL)))""")
def chunk_hard_split(spark, d):
    cut = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunking.hard_pieces(F.col("text"), _MAX, _OVERLAP)).alias("piece", "t"))
    return cut.select("doc_id", F.col("piece").cast("long").alias("piece"), F.length("t").cast("long").alias("n_chars"), T.text_hash("t").alias("h"))


@R.add(f"SELECT doc_id, CAST(greatest(0, ceil((length(text) - {_MAX}) / {_STEP})) + 1 AS BIGINT) AS n_windows, length(text) - CAST(greatest(0, ceil((length(text) - {_MAX}) / {_STEP})) AS BIGINT) * {_STEP} AS last_chars FROM documents WHERE text IS NOT NULL")
def chunk_windows(spark, d):
    p = chunking.hard_pieces(F.col("text"), _MAX, _OVERLAP)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(p).cast("long").alias("n_windows"), F.length(F.element_at(p, -1)).cast("long").alias("last_chars"))


@R.add("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type || ' / ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'root') AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat_ws(" / ", "p_type", "p_name")).alias("slug"))


def _markdown(spark, d) -> DataFrame:
    """Documents given headers: a preface, a title, a section named by source, and one a line of three."""
    first = F.element_at(F.split("text", "\n"), 1)
    body = F.regexp_replace("text", "\n", "\n\n")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.concat(F.lit("Preface "), "lang", F.lit("\n# Title\nafter title\n## "), "source", F.lit("\n"), first, F.lit("\n### Language "), "lang", F.lit("\n"), body, F.lit("\n#### Empty\n\n### Notes\nend")).alias("text"))


_SQL_MARKDOWN = """md AS (SELECT doc_id, 'Preface ' || lang || chr(10) || '# Title' || chr(10) || 'after title' || chr(10) || '## ' || source || chr(10) || string_split(text, chr(10))[1] || chr(10) || '### Language ' || lang || chr(10)
    || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || '#### Empty' || chr(10) || chr(10) || '### Notes' || chr(10) || 'end' AS text FROM documents WHERE text IS NOT NULL)"""
_SQL_BLOCKS = f"""{_SQL_MARKDOWN},
lines AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM md)),
lev AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{{1,6}})\\s+(.*)$', 2)) AS title FROM lines),
nth AS (SELECT *, sum(CASE WHEN level >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM lev),
roots AS (SELECT *, level = 2 OR (level >= 2 AND block = 1) AS is_root FROM nth),
held AS (SELECT *, last_value(CASE WHEN is_root THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS root FROM roots),
blocks AS (SELECT doc_id, block, CASE WHEN max(CASE WHEN level >= 2 THEN 1 END) IS NULL THEN 'Document' WHEN max(CASE WHEN level >= 2 AND NOT is_root THEN title END) IS NULL THEN max(root) ELSE max(root) || ' > ' || max(CASE WHEN level >= 2 AND NOT is_root THEN title END) END AS section,
  {strip("string_agg(CASE WHEN level = 0 THEN line END, chr(10) ORDER BY pos)")} AS body FROM held GROUP BY doc_id, block)"""


@R.add(f"WITH {_SQL_BLOCKS} SELECT doc_id, CAST(block AS BIGINT) AS block, section, length(body) AS n_chars, sha256(body) AS h FROM blocks WHERE body <> ''")
def chunk_markdown_blocks(spark, d):
    return chunking.header_blocks(_markdown(spark, d)).select("doc_id", F.col("block").cast("long").alias("block"), "section", F.length("body").cast("long").alias("n_chars"), T.text_hash("body").alias("h"))


#: Packing is a fold over paragraphs: a recursive step takes one more paragraph of each oversized block.
_SQL_PIECES = f"""
parts AS (SELECT doc_id, block, section, body, CASE WHEN length(body) > {_MAX} THEN list_filter(list_transform(string_split_regex(body, chr(10) || '\\s*' || chr(10)), lambda p: {strip("p")}), lambda p: p <> '') END AS ps FROM blocks WHERE body <> ''),
fold AS (
  SELECT doc_id, block, ps, 0 AS i, '' AS cur, CAST([] AS VARCHAR[]) AS done FROM parts WHERE ps IS NOT NULL
  UNION ALL
  SELECT doc_id, block, ps, i + 1, CASE WHEN fits THEN CASE WHEN cur = '' THEN p ELSE {strip("cur || chr(10) || chr(10) || p")} END ELSE substr(p, n * {_STEP} + 1) END,
    CASE WHEN fits THEN done ELSE done || CASE WHEN cur = '' THEN CAST([] AS VARCHAR[]) ELSE [cur] END || list_transform(range(n), lambda w: substr(p, w * {_STEP} + 1, {_MAX})) END
  FROM (SELECT *, ps[i + 1] AS p, length(cur) + length(ps[i + 1]) + 2 <= {_MAX} AS fits, CAST(greatest(0, ceil((length(ps[i + 1]) - {_MAX}) / {_STEP})) AS BIGINT) AS n FROM fold WHERE i < len(ps))),
packed AS (SELECT doc_id, block, CASE WHEN cur = '' THEN done ELSE done || [cur] END AS cut FROM fold WHERE i = len(ps)),
cut AS (SELECT doc_id, block, section, coalesce(cut, [body]) AS cut FROM parts LEFT JOIN packed USING (doc_id, block)),
each AS (SELECT doc_id, block, section, generate_subscripts(cut, 1) AS nth, unnest(cut) AS text FROM cut),
pieces AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block, nth) AS chunk_ix FROM each)"""
_SQL_SLUG = "coalesce(nullif(regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'root')"


@R.add(f"WITH RECURSIVE {_SQL_BLOCKS}, {_SQL_PIECES} SELECT doc_id || '-' || {_SQL_SLUG} || '-' || chunk_ix AS chunk_id, doc_id, chunk_ix, section, length(text) AS n_chars, sha256(text) AS h FROM pieces")
def chunk_pack(spark, d):
    return chunking.chunks(_markdown(spark, d)).select("chunk_id", "doc_id", "chunk_ix", "section", F.length("text").cast("long").alias("n_chars"), T.text_hash("text").alias("h"))


@R.add(f"WITH {_SQL_BLOCKS} SELECT doc_id, section, doc_id || '-' || coalesce(nullif(regexp_replace(regexp_replace(lower(section), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'root') || '-' || row_number() OVER (PARTITION BY doc_id ORDER BY block) AS chunk_id FROM blocks WHERE body <> ''")
def chunk_ids(spark, d):
    """One piece a block, so that ids can be had by SQL."""
    return chunking.chunks(_markdown(spark, d), 1 << 30, 0).select("doc_id", "section", "chunk_id")


@R.add("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def text_hash(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(T.text_hash("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@R.add("SELECT DISTINCT sha256(text) AS h, length(text) AS n_chars FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL)")
def cache_misses(spark, d):
    """The cache holds the texts of English documents."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    cache = docs.where("lang = 'en'").select(F.lit("m").alias("model"), T.text_hash("text").alias("h"))
    return retrieval.cache_misses(docs, cache, model="m").select("h", F.length("text").cast("long").alias("n_chars"))


@R.add("WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT unnest(['aws_access_key','sk_key','slack_token','private_key','api_key_literal','hex_token']) AS pattern) SELECT pattern, (SELECT count(*) FROM l WHERE CASE pattern WHEN 'aws_access_key' THEN regexp_matches(line, 'AKIA[0-9A-Z]{16}') WHEN 'sk_key' THEN regexp_matches(line, 'sk-[A-Za-z0-9]{20,}') WHEN 'slack_token' THEN regexp_matches(line, 'xox[baprs]-[0-9A-Za-z-]{10,}') WHEN 'private_key' THEN regexp_matches(line, 'BEGIN (RSA|OPENSSH|EC) PRIVATE KEY') WHEN 'api_key_literal' THEN regexp_matches(line, 'OLLAMA_API_KEY\\s*=\\s*[\"''][^\"'']{4,}[\"'']') ELSE regexp_matches(line, 'token = \"[0-9a-f]{40}\"') END) AS n_lines FROM p")
def secret_scan(spark, d):
    patterns = validation.SECRET_PATTERNS | {"hex_token": 'token = "[0-9a-f]{40}"'}
    return validation.secret_counts(table(spark, d, "documents"), "doc_id", "text", patterns)


@R.add("SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN NOT json_valid(j) THEN 1 ELSE 0 END) AS BIGINT) AS n_invalid FROM (SELECT event_type, CASE WHEN event_id % 10 = 3 THEN substr(props, 2) ELSE props END AS j FROM events) GROUP BY event_type")
def json_validity(spark, d):
    e = table(spark, d, "events").withColumn("j", F.when(F.col("event_id") % 10 == 3, F.substring("props", 2, 1 << 20)).otherwise(F.col("props")))
    bad = validation.invalid_json(e, "event_id", "j").withColumnRenamed("id", "event_id").withColumn("bad", F.lit(1))
    return e.join(bad, "event_id", "left").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("n_invalid"))


@R.add("""WITH c AS (SELECT 'has_text' AS rule, 'error' AS severity, text IS NOT NULL AS ok FROM documents UNION ALL SELECT 'size', 'error', strlen(text) >= 500 FROM documents
  UNION ALL SELECT 'length_column', 'error', length(text) = n_chars FROM documents UNION ALL SELECT 'known_language', 'warning', lang IN ('en', 'de', 'fr') FROM documents)
SELECT rule, severity, count(*) AS n, CAST(sum(CASE WHEN coalesce(ok, false) THEN 0 ELSE 1 END) AS BIGINT) AS n_failed, sum(CASE WHEN coalesce(ok, false) THEN 0 ELSE 1 END) = 0 OR severity = 'warning' AS passed FROM c GROUP BY rule, severity""")
def constraint_report(spark, d):
    rules = {
        "has_text": ("error", F.col("text").isNotNull()),
        "size": ("error", F.octet_length("text") >= 500),
        "length_column": ("error", F.length("text") == F.col("n_chars")),
        "known_language": ("warning", F.col("lang").isin("en", "de", "fr")),
    }
    return validation.summary(validation.constraints(table(spark, d, "documents"), F.col("doc_id"), rules))


@R.add("SELECT event_id, json_extract_string(props, '$.k') AS k, event_id % 3 <> 0 AS parsed FROM events")
def parse_fenced_json(spark, d):
    """Answers are fenced; every third is cut, and parses to nothing."""
    whole = F.concat(F.lit("  ```JSON\n"), "props", F.lit("\n```\n"))
    e = table(spark, d, "events").select("event_id", "props", T.parsed_object(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.lit("["), "props")).otherwise(whole)).alias("p"))
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("p.value").isNotNull().alias("parsed"))


@R.add("SELECT doc_id, CASE WHEN lang = 'de' THEN 'BadAnswer' END AS error_type, CASE WHEN lang = 'de' THEN NULL ELSE CAST(length(coalesce(text, '')) AS BIGINT) END AS n FROM documents")
def extract_mock_llm(spark, d):
    """Executors call a chat transport; here one that answers with a document's length, and fails on German ones."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).alias("text"))
    spec = docs.select("doc_id", F.lit("n").alias("field"), F.lit(0).alias("field_ix"), F.lit("integer").alias("type"), F.lit("length").alias("description"), F.lit("string").alias("item_type"), F.lit(None).cast("array<string>").alias("valid_values"), F.expr("cast(map() AS map<string,string>)").alias("subfields"))

    def chat(system: str, user: str) -> str:
        lang, text = user.split("\n\n", 1)[1].split("|", 1)
        return "no answer" if lang == "de" else f'```json\n{{"n": {len(text)}}}\n```'

    answers = extraction.extract(docs, spec, chat, "mock")
    fields = extraction.to_fields(answers, spec)
    return answers.select("doc_id", "error_type").join(fields.select("doc_id", F.try_variant_get("value", "$", "bigint").alias("n")), "doc_id")


@R.add("SELECT DISTINCT 'letters' AS model, sha256(text) AS h, CAST(26 AS INT) AS dim, CAST(length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS DOUBLE) AS total FROM documents WHERE text IS NOT NULL")
def embed_udf(spark, d):
    """Vectors of texts that a cache misses, by an injected embedder on executors."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    none = spark.createDataFrame([], "model string, h string, v array<double>")
    return extraction.embed(retrieval.cache_misses(docs, none), extraction.letter_embedder, "letters").select("model", "h", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@R.add()
def prompt_fields(spark, d):
    """Prompt lines of a specification with allowed values and item keys, one a brand."""
    p = table(spark, d, "part").select(F.col("p_brand").alias("doc_id")).distinct()
    fields = F.array(
        F.struct(F.lit("size").alias("field"), F.lit(0).alias("field_ix"), F.lit("integer").alias("type"), F.lit(None).cast("array<string>").alias("valid_values"), F.expr("cast(map() AS map<string,string>)").alias("subfields")),
        F.struct(F.lit("kind").alias("field"), F.lit(1).alias("field_ix"), F.lit("categorical").alias("type"), F.array(F.lit("A"), F.lit("B")).alias("valid_values"), F.expr("cast(map() AS map<string,string>)").alias("subfields")),
        F.struct(F.lit("arms").alias("field"), F.lit(2).alias("field_ix"), F.lit("list").alias("type"), F.lit(None).cast("array<string>").alias("valid_values"), F.expr("map('type', 'x', 'label', 'y')").alias("subfields")),
    )
    spec = p.select("doc_id", F.inline(fields)).withColumns({"description": F.lit("d"), "item_type": F.lit("object")})
    return extraction.prompt(spec)


R.sql["prompt_fields"] = "SELECT DISTINCT p_brand AS doc_id, '- size (integer): d' || chr(10) || '- kind (categorical): d [one of: A, B]' || chr(10) || '- arms (list): d [list of object with keys label, type]' AS fields FROM part"


_SQL_PATHS = """WITH p AS (SELECT source || '/' || CASE doc_id % 11 WHEN 0 THEN 'tmp/' WHEN 1 THEN 'kept_old/' ELSE '' END || CASE doc_id % 7 WHEN 0 THEN 'My ' WHEN 1 THEN 'Upper' ELSE '' END || lang || '_' || doc_id
  || CASE doc_id % 5 WHEN 0 THEN '.log' WHEN 1 THEN '_old' ELSE '.py' END AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
s AS (SELECT path, string_split(path, '/') AS parts FROM p), n AS (SELECT path, parts[-1] AS name, parts[:-2] AS folders FROM s)"""


@R.add(rf"""{_SQL_PATHS}, c AS (
  SELECT 'no_forbidden_folder' AS rule, len(list_filter(folders, lambda f: f IN ('node_modules', '.next', '__pycache__', 'tmp', 'scratch', 'backup') OR f LIKE '%\_old' ESCAPE '\')) = 0 AS ok FROM n
  UNION ALL SELECT 'no_forbidden_file', NOT (name IN ('.env', '.DS_Store') OR name LIKE '%.pyc' OR name LIKE '%.log' OR name LIKE '%\_old' ESCAPE '\') FROM n
  UNION ALL SELECT 'no_blank', NOT contains(path, ' ') FROM n
  UNION ALL SELECT 'snake_case', name NOT LIKE '%.py' OR name IN ('__init__.py', '__main__.py') OR regexp_matches(name, '^[a-z_][a-z0-9_]*\.py$') FROM n)
SELECT rule, 'error' AS severity, count(*) AS n, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_failed, bool_and(ok) AS passed FROM c GROUP BY rule""")
def committed_path_rules(spark, d):
    """Documents as files of a repository, some in forbidden folders or with forbidden names."""
    key = F.col("doc_id")
    folder = F.when(key % 11 == 0, "tmp/").when(key % 11 == 1, "kept_old/").otherwise("")
    begin = F.when(key % 7 == 0, "My ").when(key % 7 == 1, "Upper").otherwise("")
    ending = F.when(key % 5 == 0, ".log").when(key % 5 == 1, "_old").otherwise(".py")
    paths = table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.concat("source", F.lit("/"), folder, begin, "lang", F.lit("_"), key.cast("string"), ending).alias("path"))
    return validation.summary(file_rules.committed_rules(paths))


@R.add("""WITH docs AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), wanted AS (SELECT 'src' || i AS source, CASE WHEN i % 2 = 0 THEN 'error' ELSE 'warning' END AS severity FROM range(60) t(i))
SELECT 'present' AS rule, severity, count(*) AS n, CAST(count(*) FILTER (WHERE docs.source IS NULL) AS BIGINT) AS n_failed, count(*) FILTER (WHERE docs.source IS NULL) = 0 OR severity = 'warning' AS passed
FROM wanted LEFT JOIN docs USING (source) GROUP BY severity""")
def presence_rules(spark, d):
    """Sources that a set of documents has to have."""
    paths = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("path"))
    return validation.summary(file_rules.presence(paths, {f"src{i}": "warning" if i % 2 else "error" for i in range(60)}))
