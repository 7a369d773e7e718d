"""Queries over the driver's tables, whose rows are taken as files, with DuckDB SQL for the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera import constants as C
from tessera.functions import paths as P
from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import duplicates, features, findings, scores
from tessera.sources.history import commit_style


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# -- SQL pieces -------------------------------------------------------------------------------------


def _clamp(x: str, limit: float) -> str:
    return f"least(greatest({x}, -{limit}e0), {limit}e0)"


def _gauss(x: str, name: str, limit: float = C.CLAMP_UNCALIBRATED) -> str:
    ma, da, mh, dh = C.GAUSSIAN[name]
    return _clamp(f"(0.5e0 * (pow(({x} - {mh}e0) / {dh}e0, 2) - pow(({x} - {ma}e0) / {da}e0, 2)) + ln({dh}e0 / {da}e0))", limit)


def _binary(present: str, name: str, limit: float = C.CLAMP_UNCALIBRATED) -> str:
    p, q = C.BINARY[name]
    yes, no = (max(-limit, min(limit, x)) for x in (math.log(p / q), math.log((1 - p) / (1 - q))))
    return f"(CASE WHEN {present} THEN {yes!r}e0 ELSE {no!r}e0 END)"


def _within(x: str, bounds: tuple[float, float]) -> str:
    return f"(1 - least(greatest(({x} - {bounds[0]}e0) / {bounds[1]}e0, 0e0), 1e0))"


_LABEL = f"CASE WHEN probability >= {C.FLAGGED} THEN 'sloppy' WHEN probability >= {C.MODERATE} THEN 'moderate' WHEN probability >= {C.MILD} THEN 'mild' ELSE 'clean' END"
_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_SOLID = r"'[^ \t\r\f\x0B]'"
_LINES = """l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
)"""
_METRICS = f"""{_LINES}, sized AS (
  SELECT doc_id, strlen(line) AS n FROM l WHERE strlen(line) > 0
), counted AS (
  SELECT doc_id, least(n // 5, 99) AS b, count(*) AS k FROM sized GROUP BY doc_id, b
), entropies AS (
  SELECT doc_id, CASE WHEN count(*) > 1 THEN (log2(sum(k)) - sum(k * log2(k)) / sum(k)) / log2(count(*)) ELSE 0 END AS entropy
  FROM counted GROUP BY doc_id
), spreads AS (
  SELECT doc_id, count(*) AS nz_lines, CASE WHEN count(*) > 1 THEN stddev_pop(n) / avg(n) ELSE 0 END AS line_cv FROM sized GROUP BY doc_id
), indented AS (
  SELECT doc_id, length(i) + 3 * (length(i) - length(replace(i, chr(9), ''))) AS v
  FROM (SELECT doc_id, regexp_extract(line, '^[ \\t]*') AS i FROM l WHERE regexp_matches(line, {_SOLID}))
), indents AS (
  SELECT doc_id, count(*) AS indented_lines,
    CASE WHEN count(*) >= 15 THEN CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END END AS indent_cv
  FROM indented GROUP BY doc_id
), sums AS (
  SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE NOT regexp_matches(line, {_SOLID})) AS blank_lines, max(strlen(line)) AS longest_line
  FROM l GROUP BY doc_id
), layout AS (
  SELECT sums.*, coalesce(nz_lines, 0) AS nz_lines, coalesce(entropy, 0e0) AS entropy, coalesce(line_cv, 0e0) AS line_cv,
    coalesce(indented_lines, 0) AS indented_lines, indent_cv
  FROM sums LEFT JOIN entropies USING (doc_id) LEFT JOIN spreads USING (doc_id) LEFT JOIN indents USING (doc_id)
)"""
_NAMES = f"""names AS (
  SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'),
    lambda w: length(w) >= 2 AND regexp_matches(w, '[a-z]') AND w NOT IN ({_IN(C.KEYWORDS)})) AS w, text
  FROM documents
), naming AS (
  SELECT doc_id, len(w) AS total_identifiers, len(list_filter(w, lambda x: x IN ({_IN(C.GENERIC_NAMES)}))) AS generic_identifiers,
    least(len(list_distinct(w)), 2048) AS unique_identifiers,
    len(list_filter(w, lambda x: length(x) > 2 AND regexp_matches(x, '^[a-z].*[A-Z]'))) AS camel,
    len(list_filter(w, lambda x: regexp_matches(x, '^[a-z0-9_]{{3,}}$') AND contains(x, '_'))) AS snake,
    len(regexp_extract_all(coalesce(text, ''), '\\b(?:if|else|elif|switch|case|match)\\b')) AS conditionals
  FROM names
)"""


def line_metrics(spark, sf_dir):
    return features.line_metrics(_documents(spark, sf_dir), "doc_id", "text")


LINE_METRICS = f"""WITH {_METRICS}
SELECT doc_id, segments::BIGINT AS segments, blank_lines::BIGINT AS blank_lines, strlen(coalesce(text, ''))::BIGINT AS bytes,
  longest_line::BIGINT AS longest_line, (segments - blank_lines)::BIGINT AS code_lines
FROM layout JOIN documents USING (doc_id)"""


def line_entropy_cv(spark, sf_dir):
    found = features.layout(_documents(spark, sf_dir), "doc_id", "text")
    return _rounded(found.select("doc_id", "nz_lines", "entropy", "line_cv"), "entropy", "line_cv")


LINE_ENTROPY = f"WITH {_METRICS} SELECT doc_id, nz_lines::BIGINT AS nz_lines, round(entropy, 6) AS entropy, round(line_cv, 6) AS line_cv FROM layout"


def indent_metrics(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    found = features.layout(pages, "page_id", "text")
    return _rounded(found.select("page_id", "indented_lines", "indent_cv"), "indent_cv")


INDENT_METRICS = f"""WITH d AS (SELECT page_id, unnest(string_split(coalesce(html, ''), chr(10))) AS line FROM pages
), v AS (SELECT page_id, length(i) + 3 * (length(i) - length(replace(i, chr(9), ''))) AS v
  FROM (SELECT page_id, regexp_extract(line, '^[ \\t]*') AS i FROM d WHERE regexp_matches(line, {_SOLID}))
), s AS (SELECT page_id, count(*) AS n, CASE WHEN count(*) >= 15 THEN CASE WHEN avg(v) > 0 THEN stddev_pop(v) / avg(v) ELSE 0 END END AS cv FROM v GROUP BY page_id)
SELECT page_id, coalesce(n, 0)::BIGINT AS indented_lines, round(cv, 6) AS indent_cv FROM pages LEFT JOIN s USING (page_id)"""


def regularity_score(spark, sf_dir):
    found = features.layout(_documents(spark, sf_dir), "doc_id", "text")
    found = found.withColumn("regularity", S.regularity(F.col("entropy"), F.col("line_cv")))
    found = found.withColumn("llr", S.gaussian_llr(F.col("regularity"), C.GAUSSIAN["regularity"], C.CLAMP_UNCALIBRATED))
    found = found.withColumn("probability", F.round(S.sigmoid(F.col("llr") / C.TEMPERATURE), 6)).withColumn("label", S.label(F.col("probability")))
    return _rounded(found.select("doc_id", "regularity", "llr", "probability", "label"), "regularity", "llr")


_EVEN = f"(({_within('entropy', C.ENTROPY_RANGE)} + {_within('line_cv', C.SPREAD_RANGE)}) / 2)"
REGULARITY = f"""WITH {_METRICS}, r AS (SELECT doc_id, {_EVEN} AS regularity FROM layout
), s AS (SELECT *, {_gauss("regularity", "regularity")} AS llr FROM r
), p AS (SELECT *, round(1 / (1 + exp(-llr / 2e0)), 6) AS probability FROM s)
SELECT doc_id, round(regularity, 6) AS regularity, round(llr, 6) AS llr, probability, {_LABEL} AS label FROM p"""


def identifier_metrics(spark, sf_dir):
    found = features.naming(_documents(spark, sf_dir), "doc_id", "text")
    ttr = F.when(F.col("total_identifiers") >= 50, F.round(F.col("unique_identifiers") / F.col("total_identifiers"), 6))
    generic = F.when(F.col("total_identifiers") >= 20, F.round(F.col("generic_identifiers") / F.col("total_identifiers"), 6))
    return found.select("doc_id", "total_identifiers", "generic_identifiers", "unique_identifiers", ttr.alias("token_diversity"), generic.alias("generic_ratio"))


IDENTIFIERS = f"""WITH {_NAMES}
SELECT doc_id, total_identifiers::BIGINT AS total_identifiers, generic_identifiers::BIGINT AS generic_identifiers, unique_identifiers::BIGINT AS unique_identifiers,
  CASE WHEN total_identifiers >= 50 THEN round(unique_identifiers / total_identifiers::DOUBLE, 6) END AS token_diversity,
  CASE WHEN total_identifiers >= 20 THEN round(generic_identifiers / total_identifiers::DOUBLE, 6) END AS generic_ratio
FROM naming"""


def naming_styles(spark, sf_dir):
    """Styles of names on pages, which have script code."""
    pages = _table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text"))
    return features.naming(pages, "page_id", "text").select("page_id", "camel", "snake", "total_identifiers")


NAMING_STYLES = f"WITH {_NAMES} SELECT doc_id AS page_id, camel::BIGINT AS camel, snake::BIGINT AS snake, total_identifiers::BIGINT AS total_identifiers FROM naming".replace("FROM documents", "FROM (SELECT page_id AS doc_id, html AS text FROM pages)")


def conditional_density(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    counts = docs.select("doc_id", T.conditionals(F.col("text")).cast("long").alias("conditionals"), F.size(F.filter(T.lines(F.col("text")), lambda x: ~T.is_blank(x))).cast("long").alias("code_lines"))
    density = F.when(F.col("conditionals") >= 3, F.round(F.col("conditionals") / F.greatest(F.col("code_lines"), F.lit(1)), 6))
    return counts.withColumn("density", density)


CONDITIONALS = f"""WITH {_METRICS}, {_NAMES}
SELECT doc_id, conditionals::BIGINT AS conditionals, (segments - blank_lines)::BIGINT AS code_lines,
  CASE WHEN conditionals >= 3 THEN round(conditionals / greatest(segments - blank_lines, 1)::DOUBLE, 6) END AS density
FROM layout JOIN naming USING (doc_id)"""


def document_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout and naming of documents alone, from row-local expressions; what needs the lexer counts as 0.

    The scores from them are those of SQL. ``tessera.plans.tables`` has the full scan.
    """
    docs = _documents(spark, sf_dir)
    text = F.col("text")
    w = T.identifiers(text)
    rows = docs.select("doc_id", "text", T.line_lengths(text).alias("lengths"), T.indents(text).alias("indents"), w.alias("w"), F.size(T.lines(text)).cast("long").alias("segments"))
    zero = F.lit(0).cast("long")
    return rows.select(
        F.col("doc_id").alias("path"),
        T.entropy(F.col("lengths")).alias("entropy"),
        T.spread(F.col("lengths")).alias("line_cv"),
        (F.col("segments") - F.endswith("text", F.lit("\n")).cast("long")).alias("total_lines"),
        F.size("indents").cast("long").alias("code_lines"),
        zero.alias("comment_lines"),
        T.conditionals(text).cast("long").alias("conditionals"),
        "indents",
        F.size("w").cast("long").alias("total_identifiers"),
        F.size(F.filter("w", T.is_generic)).cast("long").alias("generic_identifiers"),
        F.least(F.size(F.array_distinct("w")), F.lit(C.UNIQUE_CAP)).cast("long").alias("unique_identifiers"),
        *[zero.alias(n) for n in ("narration", "overwraps", "name_breaks", "top_lines", "top_comments", "bottom_lines", "bottom_comments", "defects_0", "defects_1", "defects_2", "defects_3")],
        F.lit(None).cast("array<int>").alias("function_lines"),
    )


def file_scores(spark, sf_dir):
    found = scores.score_files(document_metrics(spark, sf_dir))
    found = found.withColumn("probability", F.round("probability", 6)).withColumn("label", S.label(F.col("probability")))
    return _rounded(found.select(F.col("path").alias("doc_id"), "raw_score", "probability", "label", "code_lines"), "raw_score")


_SCORED = f"""{_METRICS}, {_NAMES}, m AS (
  SELECT layout.*, naming.* EXCLUDE (doc_id), segments - CASE WHEN suffix(coalesce(text, ''), chr(10)) THEN 1 ELSE 0 END AS total_lines, indented_lines AS code_lines
  FROM layout JOIN naming USING (doc_id) JOIN documents USING (doc_id)
), e AS (
  SELECT *, {_gauss(_EVEN, "regularity")} AS even FROM m
), raw AS (
  SELECT doc_id, code_lines, CASE WHEN code_lines <= 0 THEN 0e0 ELSE
    CASE WHEN total_lines < 60 THEN {_clamp("even", C.CLAMP_SMALL)} ELSE even END
    + {_gauss("0e0", "ccr")} + {_binary("false", "narration")}
    + CASE WHEN conditionals >= 3 THEN {_gauss("(conditionals / greatest(code_lines, 1)::DOUBLE)", "cond")} ELSE 0e0 END
    + CASE WHEN total_lines < 60 THEN 0e0 ELSE {_binary("false", "decay")} END
    + {_binary("false", "overwrap")} + {_binary("false", "namebreak")}
    + CASE WHEN total_identifiers >= 20 THEN {_gauss("(generic_identifiers / total_identifiers::DOUBLE)", "ident")} ELSE 0e0 END
    + CASE WHEN total_identifiers >= 50 THEN {_gauss("(unique_identifiers / total_identifiers::DOUBLE)", "ttr")} ELSE 0e0 END
    + CASE WHEN indented_lines >= 15 THEN {_gauss("indent_cv", "indent")} ELSE 0e0 END END AS raw_score FROM e
), scored AS (
  SELECT doc_id, round(raw_score, 6) AS raw_score, round(1 / (1 + exp(-raw_score / 2e0)), 6) AS probability, code_lines FROM raw
)"""
FILE_SCORES = f"WITH {_SCORED} SELECT doc_id, raw_score, probability, {_LABEL} AS label, code_lines::BIGINT AS code_lines FROM scored"


def score_labels(spark, sf_dir):
    return file_scores(spark, sf_dir).groupBy("label").agg(F.count("*").alias("files"), F.sum("code_lines").alias("code_lines"))


SCORE_LABELS = f"WITH {_SCORED}, x AS (SELECT {_LABEL} AS label, code_lines FROM scored) SELECT label, count(*) AS files, sum(code_lines)::BIGINT AS code_lines FROM x GROUP BY label"


def project_score(spark, sf_dir):
    return _rounded(scores.project(file_scores(spark, sf_dir)), "project_score")


PROJECT_SCORE = f"""WITH {_SCORED}
SELECT round(sum(probability * greatest(code_lines, 1)) / sum(greatest(code_lines, 1)), 6) AS project_score,
  count(*) FILTER (WHERE probability >= 0.85) AS sloppy, count(*) FILTER (WHERE probability >= 0.6 AND probability < 0.85) AS moderate,
  count(*) FILTER (WHERE probability < 0.6) AS clean,
  CASE WHEN max(probability) >= 0.85 THEN 2 WHEN max(probability) >= 0.6 THEN 1 ELSE 0 END AS exit_code
FROM scored"""


def top_files(spark, sf_dir):
    """The report's head: the twenty files with the highest scores."""
    return file_scores(spark, sf_dir).orderBy(F.desc("probability"), "doc_id").limit(20)


TOP_FILES = FILE_SCORES + " ORDER BY probability DESC, doc_id LIMIT 20"


def score_signals(spark, sf_dir):
    """How often each signal speaks for or against, over all documents."""
    found = scores.signals(scores.score_files(document_metrics(spark, sf_dir)))
    llr = F.round("llr", 6)
    return found.groupBy("grp", "signal").agg(F.count("*").alias("files"), F.sum((llr > 0).cast("long")).alias("against"), F.sum((llr < 0).cast("long")).alias("for"))


SCORE_SIGNALS = f"""WITH {_METRICS}, {_NAMES}, m AS (
  SELECT layout.*, naming.* EXCLUDE (doc_id), segments - CASE WHEN suffix(coalesce(text, ''), chr(10)) THEN 1 ELSE 0 END AS total_lines, indented_lines AS code_lines
  FROM layout JOIN naming USING (doc_id) JOIN documents USING (doc_id)
), s AS (
  SELECT 'score' AS grp, 'insufficient code' AS signal, 0e0 AS llr FROM m WHERE code_lines <= 0
  UNION ALL SELECT 'regularity', 'composite*', {_gauss(_EVEN, "regularity")} FROM m WHERE code_lines > 0
  UNION ALL SELECT 'comments', 'comment-to-code', {_gauss("0e0", "ccr")} FROM m WHERE code_lines > 0
  UNION ALL SELECT 'comments', 'narration', {_binary("false", "narration")} FROM m WHERE code_lines > 0
  UNION ALL SELECT 'structure', 'conditional dens.', CASE WHEN conditionals >= 3 THEN {_gauss("(conditionals / code_lines::DOUBLE)", "cond")} ELSE 0 END FROM m WHERE code_lines > 0
  UNION ALL SELECT 'position', 'quality decay', CASE WHEN total_lines < 60 THEN 0 ELSE {_binary("false", "decay")} END FROM m WHERE code_lines > 0
  UNION ALL SELECT 'patterns', 'over-wrapping', {_binary("false", "overwrap")} FROM m WHERE code_lines > 0
  UNION ALL SELECT 'patterns', 'naming breaks', {_binary("false", "namebreak")} FROM m WHERE code_lines > 0
  UNION ALL SELECT 'naming', 'ident. specificity', CASE WHEN total_identifiers >= 20 THEN {_gauss("(generic_identifiers / total_identifiers::DOUBLE)", "ident")} ELSE 0 END FROM m WHERE code_lines > 0
  UNION ALL SELECT 'structure', 'func length CV', 0 FROM m WHERE code_lines > 0
  UNION ALL SELECT 'naming', 'token diversity', CASE WHEN total_identifiers >= 50 THEN {_gauss("(unique_identifiers / total_identifiers::DOUBLE)", "ttr")} ELSE 0 END FROM m WHERE code_lines > 0
  UNION ALL SELECT 'whitespace', 'indent regularity', CASE WHEN indented_lines >= 15 THEN {_gauss("indent_cv", "indent")} ELSE 0 END FROM m WHERE code_lines > 0
)
SELECT grp, signal, count(*) AS files, count(*) FILTER (WHERE round(llr, 6) > 0)::BIGINT AS against, count(*) FILTER (WHERE round(llr, 6) < 0)::BIGINT AS "for" FROM s GROUP BY grp, signal"""


def gaussian_signals(spark, sf_dir):
    x = F.least(F.octet_length("text") / 5000.0, F.lit(1.0))
    return _documents(spark, sf_dir).select("doc_id", *[F.round(S.gaussian_llr(x, p, C.CLAMP), 6).alias(n) for n, p in C.GAUSSIAN.items()])


GAUSSIAN_SIGNALS = "SELECT doc_id, " + ", ".join(f"round({_gauss('x', n, C.CLAMP)}, 6) AS {n}" for n in C.GAUSSIAN) + " FROM (SELECT doc_id, least(strlen(coalesce(text, '')) / 5000e0, 1e0) AS x FROM documents)"


def binary_signals(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels")
    return labels.select("doc_id", *[F.round(S.binary_llr(F.col("quality") == 0, p, C.CLAMP), 6).alias(n) for n, p in C.BINARY.items()])


BINARY_SIGNALS = "SELECT doc_id, " + ", ".join(f"round({_binary('quality = 0', n, C.CLAMP)}, 6) AS {n}" for n in C.BINARY) + " FROM labels"


def narration_scan(spark, sf_dir):
    """Narration among conversations' lines, each taken as a comment: count and tier."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), T.narrates).alias("hits"))
    found = rows.groupBy("conv_id").agg(F.sum(F.size("hits")).cast("long").alias("narration"))
    tier = F.when(F.col("narration") < 3, "absent").when(F.col("narration") < 8, "present").otherwise("many")
    return found.withColumn("tier", tier)


_MARKS = ", ".join("'" + m.replace("'", "''") + "'" for m in C.NARRATION_MARKERS)
NARRATION = f"""WITH l AS (SELECT conv_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations
), h AS (SELECT conv_id, len(list_filter([{_MARKS}], lambda m: starts_with(lower(ltrim(line)), m))) > 0 AS hit FROM l
), n AS (SELECT conv_id, count(*) FILTER (WHERE hit) AS narration FROM h GROUP BY conv_id)
SELECT conv_id, narration::BIGINT AS narration, CASE WHEN narration < 3 THEN 'absent' WHEN narration < 8 THEN 'present' ELSE 'many' END AS tier FROM n"""


def quarter_trend(spark, sf_dir):
    """Marked lines by quarter of a document, and their rank correlation with the place."""
    rows = _documents(spark, sf_dir).select("doc_id", T.lines(F.col("text")).alias("x")).where(F.size("x") >= 4)
    n = F.floor(F.size("x") / 4)

    def marked(q: int):
        return lambda line, i: line.contains("!") & (F.least(F.floor(i / n), F.lit(3)) == q)

    rows = rows.select("doc_id", *[F.size(F.filter("x", marked(q))).cast("long").alias(f"q{q}") for q in range(4)])
    trend = S.spearman([F.col(f"q{q}").cast("double") for q in range(4)])
    return rows.select("doc_id", "q0", "q1", "q2", "q3", F.round(trend, 6).alias("trend"))


def _rank_sql(i: int) -> str:
    less = " + ".join(f"(CASE WHEN q{j} < q{i} THEN 1e0 ELSE 0e0 END)" for j in range(4))
    same = " + ".join(f"(CASE WHEN q{j} = q{i} THEN 1e0 ELSE 0e0 END)" for j in range(4))
    return f"pow({less} + ({same} + 1) / 2 - {i + 1}, 2)"


QUARTER_TREND = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), l AS (SELECT doc_id, len(x) AS n, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM d WHERE len(x) >= 4
), q AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE contains(line, '!') AND least(i // (n // 4), 3) = {q})::BIGINT AS q{q}" for q in range(4))} FROM l GROUP BY doc_id)
SELECT *, round(1 - 6 * ({" + ".join(_rank_sql(i) for i in range(4))}) / 60e0, 6) AS trend FROM q"""


def comment_gradient(spark, sf_dir):
    """Documents whose lines with a full stop at the end, taken as comments, thin out."""
    rows = _documents(spark, sf_dir).select("doc_id", T.lines(F.col("text")).alias("x")).where(F.size("x") >= 50)
    half = F.floor(F.size("x") / 2)
    rows = rows.select("doc_id", F.slice("x", F.lit(1), half).alias("a"), F.slice("x", half + 1, F.size("x")).alias("b"))
    count = lambda c: F.size(F.filter(c, lambda v: v.endswith("."))).cast("long")
    rows = rows.select("doc_id", F.size("a").cast("long").alias("top_lines"), count("a").alias("top_comments"), F.size("b").cast("long").alias("bottom_lines"), count("b").alias("bottom_comments"))
    return rows.withColumn("fades", S.gradient(*[F.col(c) for c in ("top_lines", "top_comments", "bottom_lines", "bottom_comments")]))


COMMENT_GRADIENT = """WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents
), h AS (SELECT doc_id, x[1:len(x) // 2] AS a, x[len(x) // 2 + 1:] AS b FROM d WHERE len(x) >= 50
), c AS (SELECT doc_id, len(a)::BIGINT AS top_lines, len(list_filter(a, lambda v: suffix(v, '.')))::BIGINT AS top_comments,
  len(b)::BIGINT AS bottom_lines, len(list_filter(b, lambda v: suffix(v, '.')))::BIGINT AS bottom_comments FROM h)
SELECT *, top_lines >= 25 AND bottom_lines >= 25 AND top_comments + bottom_comments >= 6
  AND (top_comments / top_lines::DOUBLE) / greatest(bottom_comments / bottom_lines::DOUBLE, 0.001e0) > 3 AS fades FROM c"""


def _skips(rows: DataFrame, key: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return rows.select(key, P.is_binary(content).alias("is_binary"), P.is_minified(content).alias("is_minified"), P.is_generated(content).alias("is_generated"), P.skip_reason(content).alias("reason"))


def skip_documents(spark, sf_dir):
    return _skips(_documents(spark, sf_dir), "doc_id")


def skip_pages(spark, sf_dir):
    return _skips(_table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("text")), "page_id")


def _skip_sql(key: str, column: str, table: str) -> str:
    return f"""WITH d AS (SELECT {key}, coalesce({column}, '') AS t, length(t) - length(replace(t, chr(10), '')) AS nl FROM {table}
), f AS (SELECT {key}, contains(t, chr(0)) AS is_binary, (strlen(t) - nl) // greatest(nl, 1) > 200 AS is_minified,
  {" OR ".join(f"contains(left(t, 2048), '{m}')" for m in C.GENERATED_MARKS)} AS is_generated FROM d)
SELECT *, CASE WHEN is_binary THEN 'binary' WHEN is_minified THEN 'minified' WHEN is_generated THEN 'generated' END AS reason FROM f"""


def paths_of_pages(spark, sf_dir):
    """Path predicates on paths made from the pages' addresses and every extension in turn."""
    endings = [e for e, _, _ in C.EXTENSIONS] + list(C.EXTRA_EXTENSIONS) + list(C.SKIP_SUFFIXES) + ["", ".TS", "/vendor/x.py"]
    ending = F.element_at(F.array(*[F.lit(e) for e in endings]), (F.pmod("page_id", F.lit(len(endings))) + 1).cast("int"))
    path = P.join_path(F.regexp_replace("url", "^https?://", ""), F.concat(F.lit("f"), F.col("page_id").cast("string"), ending))
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    p = F.col("path")
    return rows.select("page_id", P.extension(p).alias("extension"), P.family(p).alias("family"), P.language(p).alias("language"), P.has_skip_suffix(p).alias("skip_suffix"), P.is_source(p).alias("is_source"), P.in_folders(p).alias("in_skip_folder"), P.is_ignored(p, ["vendor", "f3.go"]).alias("ignored"))


def _paths_sql() -> str:
    endings = [e for e, _, _ in C.EXTENSIONS] + list(C.EXTRA_EXTENSIONS) + list(C.SKIP_SUFFIXES) + ["", ".TS", "/vendor/x.py"]
    case = lambda k, other: "CASE extension " + " ".join(f"WHEN '{r[0]}' THEN '{r[k]}'" for r in C.EXTENSIONS) + f" ELSE '{other}' END"
    suffix = " OR ".join(f"suffix(path, '{s}')" for s in C.SKIP_SUFFIXES)
    known = _IN([e for e, _, _ in C.EXTENSIONS] + list(C.EXTRA_EXTENSIONS))
    return f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '/+$', '') || '/f' || page_id || ([{_IN(endings)}])[page_id % {len(endings)} + 1] AS path FROM pages
), e AS (SELECT *, regexp_extract(path, '(\\.[^.]*)$', 1) AS extension, string_split(path, '/') AS parts FROM p)
SELECT page_id, extension, {case(1, C.C_LIKE)} AS family, {case(2, "unknown")} AS language, {suffix} AS skip_suffix,
  NOT ({suffix}) AND extension IN ({known}) AS is_source, list_has_any(parts, [{_IN(C.SKIP_FOLDERS)}]) AS in_skip_folder,
  list_has_any(parts, ['vendor', 'f3.go']) AS ignored FROM e"""


def pair_candidates(spark, sf_dir):
    """All pairs of benchmark items whose sizes differ by a factor of two at most."""
    items = _table(spark, sf_dir, "benchmark").select("item_id", F.octet_length("text").alias("size"))
    return duplicates.pair_candidates(items, "item_id", "size", None)


PAIR_CANDIDATES = """SELECT x.item_id AS a, y.item_id AS b FROM benchmark x JOIN benchmark y ON x.item_id < y.item_id
AND strlen(x.text) > 0 AND strlen(y.text) > 0
AND greatest(strlen(x.text), strlen(y.text)) <= 2 * least(strlen(x.text), strlen(y.text))"""


def _copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node and component: each document with the same text as another, and the least of them.

    Equal texts need no search: the least is a partial aggregate, joined back.
    """
    docs = _documents(spark, sf_dir).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).where("doc_id is not null")
    least = docs.groupBy("digest").agg(F.min("doc_id").alias("component"), F.max("doc_id").alias("most")).where("component < most")
    return docs.join(least, "digest").select(F.col("doc_id").alias("node"), "component").distinct()


def exact_components(spark, sf_dir):
    return _copies(spark, sf_dir).select(F.col("node").alias("doc_id"), "component")


_COPIES = "g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(coalesce(text, ''))) AS component, count(*) OVER (PARTITION BY md5(coalesce(text, ''))) AS n FROM documents)"
EXACT_COMPONENTS = f"WITH {_COPIES} SELECT doc_id, component FROM g WHERE n > 1"


def cluster_stats(spark, sf_dir):
    """Groups of equal documents by size, all of them."""
    found = _copies(spark, sf_dir)
    return found.groupBy("component").agg(F.count("*").alias("size")).select("component", "size")


CLUSTER_STATS = f"WITH {_COPIES} SELECT component, count(*) AS size FROM g WHERE n > 1 GROUP BY component"


def duplicate_ratio(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("text").cast("binary").alias("body"))
    clustered = _copies(spark, sf_dir)
    return _rounded(duplicates.duplicate_ratio(docs, clustered), "ratio")


DUPLICATE_RATIO = f"""WITH {_COPIES}, s AS (SELECT count(*) FILTER (WHERE n > 1) AS funcs_in_dup FROM g), t AS (SELECT count(*) AS total_funcs FROM documents WHERE strlen(coalesce(text, '')) >= 200)
SELECT funcs_in_dup, total_funcs, round(CASE WHEN total_funcs > 0 THEN funcs_in_dup / total_funcs::DOUBLE ELSE 0 END, 6) AS ratio FROM s, t"""


def compress_ratio(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.round(duplicates.compress_ratio(F.col("text").cast("binary")), 6).alias("ratio"))


def ncd_pairs(spark, sf_dir):
    """Benchmark items close to each other by compression."""
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("func_ord"), F.col("text").cast("binary").alias("body"))
    return _rounded(duplicates.compression_pairs(items, 0.8, None), "ncd")


def copy_candidates(spark, sf_dir):
    """Different texts that meet in the index of shingles: how many each meets, and the least of all that are linked so."""
    texts = _documents(spark, sf_dir).where("doc_id is not null and text is not null")
    least = texts.groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"))
    different = texts.join(least, "doc_id", "left_semi").select("doc_id", "text", F.octet_length("text").alias("size"))
    lists = duplicates.index_lists(different, "doc_id", "text", "size", None)
    met = duplicates.written(duplicates.index_neighbours(lists))
    candidates = met.select(F.col("id").alias("node"), (F.size("after") + F.size("before")).cast("long").alias("candidates"))
    linked = duplicates.components(duplicates.pairs_of(met, "hubs"))
    return linked.join(candidates, "node").select(F.col("node").alias("doc_id"), "candidates", F.col("component").alias("least_linked"))


def _copy_candidates_sql(index: duplicates.Index = duplicates.Index()) -> str:
    following = ", ".join(f"lead({{'id': doc_id, 'n': n}}, {j}) OVER o" for j in range(1, index.near + 1))
    return rf"""
WITH RECURSIVE least AS (
  SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text)
), d AS (
  SELECT doc_id, strlen(text) AS n, regexp_extract_all(text, '{duplicates.TOKENS}') AS w FROM documents JOIN least USING (doc_id) WHERE text <> ''
), hashes AS (
  SELECT doc_id, n, list_sort(list_distinct(list_transform(range(0, greatest(len(w) - {index.tokens}, 0) + 1), lambda i: ('0x' || substr(md5(array_to_string(w[i + 1:i + {index.tokens}], ' ')), 1, 15))::BIGINT)))[1:{index.sketch}] AS h
  FROM d WHERE len(w) > 0
), posted AS (
  SELECT doc_id, n, unnest(h) AS term FROM hashes
), shared AS (
  SELECT term, count(*) AS k FROM posted GROUP BY term HAVING count(*) > 1
), kept AS (
  SELECT doc_id, n, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN k <= {index.near + 1} THEN -k ELSE k END, term) AS r FROM posted JOIN shared USING (term)) WHERE r <= {index.posted}
), met AS (
  SELECT doc_id, n, unnest([{following}]) AS o FROM kept WINDOW o AS (PARTITION BY term ORDER BY n, doc_id)
), pairs AS (
  SELECT DISTINCT least(doc_id, o.id) AS a, greatest(doc_id, o.id) AS b FROM met WHERE o IS NOT NULL AND greatest(n, o.n) <= 2 * least(n, o.n)
), links AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT a AS doc_id, a AS r FROM links UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.doc_id
), counted AS (
  SELECT a AS doc_id, count(*) AS candidates FROM links GROUP BY a
)
SELECT doc_id, candidates::BIGINT AS candidates, min(r) AS least_linked FROM reach JOIN counted USING (doc_id) GROUP BY doc_id, candidates
"""


def string_repeats(spark, sf_dir):
    """Lines of 8 to 127 bytes that a document has three times or more, with their first line."""
    rows = _documents(spark, sf_dir).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("i", "line"))
    rows = rows.where(F.octet_length("line").between(8, 127))
    found = rows.groupBy("doc_id", "line").agg(F.count("*").alias("n"), (F.min("i") + 1).cast("long").alias("first_line")).where("n >= 3")
    return found.select("doc_id", "line", "n", "first_line")


STRING_REPEATS = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
SELECT doc_id, line, count(*) AS n, min(i)::BIGINT AS first_line FROM l WHERE strlen(line) BETWEEN 8 AND 127 GROUP BY doc_id, line HAVING count(*) >= 3"""


def first_three_then_total(spark, sf_dir):
    """The first three events of each user, and a row with the total where there are more."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("order"))
    found = findings.first_then_total(rows, "user_id", "order")
    return found.select("user_id", F.when(F.col("n").isNotNull(), F.col("event_id")).alias("event_id"), "n", F.col("total").cast("long").alias("total"))


FIRST_THREE = """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT user_id, event_id, n::INTEGER AS n, total FROM r WHERE n <= 3 UNION ALL SELECT user_id, NULL, NULL, total FROM r WHERE n = 1 AND total > 3"""


def conventional_messages(spark, sf_dir):
    """Messages, with a commit type put before every second one, judged as commit messages."""
    kinds = F.array(*[F.lit(k) for k in (*C.COMMIT_TYPES, "feature", "Fix")])
    kind = F.element_at(kinds, (F.pmod("conv_id", F.lit(12)) + 1).cast("int"))
    mark = F.element_at(F.array(*[F.lit(m) for m in (": ", "(x): ", "!: ", " ")]), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(kind, mark, F.coalesce("text", F.lit(""))).alias("message"))
    return rows.select("conv_id", "turn", T.is_conventional(F.col("message")).alias("conventional"))


CONVENTIONAL = f"""SELECT conv_id, turn, regexp_matches(([{_IN((*C.COMMIT_TYPES, "feature", "Fix"))}])[conv_id % 12 + 1] || ([': ', '(x): ', '!: ', ' '])[turn % 4 + 1] || coalesce(text, ''),
  '^(?:{"|".join(C.COMMIT_TYPES)})(?:\\([^)]*\\))?!?:') AS conventional FROM conversations"""


def history_style(spark, sf_dir):
    """Conversations as histories: a turn is a commit."""
    rows = _table(spark, sf_dir, "conversations")
    commits = rows.select(F.col("conv_id").alias("path"), F.col("turn").cast("int").alias("rank"), F.coalesce("text", F.lit("")).alias("message"))
    found = commit_style(commits).withColumnRenamed("path", "conv_id")
    return _rounded(found, "multiline_ratio", "conventional_ratio", "avg_msg_length", "composite")


HISTORY_STYLE = f"""WITH m AS (SELECT conv_id, regexp_replace(regexp_replace(coalesce(text, ''), '^[ \\t\\r\\n\\f\\x0B]+', ''), '[ \\t\\r\\n\\f\\x0B]+$', '') AS message FROM conversations WHERE turn < 20
), s AS (SELECT conv_id, avg(CASE WHEN contains(message, chr(10)) THEN 1e0 ELSE 0e0 END) AS a,
  avg(CASE WHEN regexp_matches(message, '^(?:{"|".join(C.COMMIT_TYPES)})(?:\\([^)]*\\))?!?:') THEN 1e0 ELSE 0e0 END) AS b,
  avg(strlen(message)) AS c, count(*) AS messages FROM m WHERE message <> '' GROUP BY conv_id)
SELECT conv_id, round(a, 6) AS multiline_ratio, round(b, 6) AS conventional_ratio, round(c, 6) AS avg_msg_length, messages,
  round((a + b + least(greatest((c - 10e0) / 190e0, 0e0), 1e0)) / 3, 6) AS composite FROM s"""


def unused_names(spark, sf_dir):
    """The first word of each document's lines that stands on no other line of it."""
    rows = _documents(spark, sf_dir).select(F.col("doc_id").alias("path"), F.posexplode(T.lines(F.col("text"))).alias("i", "text"))
    words = rows.select("path", F.col("i").alias("line"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0))).alias("word")).distinct()
    names = rows.select("path", F.regexp_extract("text", "[A-Za-z0-9_]+", 0).alias("name"), F.col("i").alias("from"), F.col("i").alias("to")).where("name <> ''")
    return findings.unused_names(names, words).select(F.col("path").alias("doc_id"), F.col("from").cast("long").alias("line"), "name")


UNUSED_NAMES = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents
), w AS (SELECT DISTINCT doc_id, i, unnest(regexp_extract_all(t, '[A-Za-z0-9_]+')) AS word FROM l
), c AS (SELECT doc_id, word, min(i) AS a, max(i) AS b FROM w GROUP BY doc_id, word
), n AS (SELECT doc_id, i, regexp_extract(t, '[A-Za-z0-9_]+') AS name FROM l)
SELECT n.doc_id, i::BIGINT AS line, name FROM n JOIN c ON n.doc_id = c.doc_id AND name = word WHERE name <> '' AND a = i AND b = i"""


def json_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation")
    return rows.select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name", "n_regionkey")).alias("json"))


JSON_ROWS = "SELECT n_nationkey, CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'n_regionkey': n_regionkey}) AS VARCHAR) AS json FROM nation"


def severity_changes(spark, sf_dir):
    """Where a header goes in a listing of events by user: at each change of type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").withColumn("before", F.lag("event_type").over(w))
    return rows.where("before is null or before <> event_type").groupBy("user_id").agg(F.count("*").alias("headers"))


SEVERITY_CHANGES = """WITH r AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)
SELECT user_id, count(*) AS headers FROM r WHERE b IS NULL OR b <> event_type GROUP BY user_id"""


QUERIES = {
    "line_metrics": (line_metrics, LINE_METRICS),
    "line_entropy_cv": (line_entropy_cv, LINE_ENTROPY),
    "indent_metrics": (indent_metrics, INDENT_METRICS),
    "regularity_score": (regularity_score, REGULARITY),
    "identifier_metrics": (identifier_metrics, IDENTIFIERS),
    "naming_styles": (naming_styles, NAMING_STYLES),
    "conditional_density": (conditional_density, CONDITIONALS),
    "file_scores": (file_scores, FILE_SCORES),
    "score_labels": (score_labels, SCORE_LABELS),
    "project_score": (project_score, PROJECT_SCORE),
    "top_files": (top_files, TOP_FILES),
    "score_signals": (score_signals, SCORE_SIGNALS),
    "gaussian_signals": (gaussian_signals, GAUSSIAN_SIGNALS),
    "binary_signals": (binary_signals, BINARY_SIGNALS),
    "narration_scan": (narration_scan, NARRATION),
    "quarter_trend": (quarter_trend, QUARTER_TREND),
    "comment_gradient": (comment_gradient, COMMENT_GRADIENT),
    "skip_documents": (skip_documents, _skip_sql("doc_id", "text", "documents")),
    "skip_pages": (skip_pages, _skip_sql("page_id", "html", "pages")),
    "path_predicates": (paths_of_pages, _paths_sql()),
    "pair_candidates": (pair_candidates, PAIR_CANDIDATES),
    "exact_components": (exact_components, EXACT_COMPONENTS),
    "cluster_stats": (cluster_stats, CLUSTER_STATS),
    "duplicate_ratio": (duplicate_ratio, DUPLICATE_RATIO),
    "compress_ratio": (compress_ratio, None),
    "ncd_pairs": (ncd_pairs, None),
    "copy_candidates": (copy_candidates, _copy_candidates_sql()),
    "string_repeats": (string_repeats, STRING_REPEATS),
    "first_three_then_total": (first_three_then_total, FIRST_THREE),
    "conventional_messages": (conventional_messages, CONVENTIONAL),
    "history_style": (history_style, HISTORY_STYLE),
    "unused_names": (unused_names, UNUSED_NAMES),
    "json_rows": (json_rows, JSON_ROWS),
    "severity_changes": (severity_changes, SEVERITY_CHANGES),
}
