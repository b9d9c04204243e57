"""Quality rules: a threshold table compiled into one projection.

Words are runs of characters other than blank and U+0009..U+000D. All measures are Column expressions over one
row; nothing is shuffled, so one long text costs only the task that reads it (about 100 bytes a word). Three-word windows are compared by 64-bit
hashes: among the ten million windows of a very long text, two different ones are taken for equal with a chance of 3 in a million.

Defined results: a null or empty text has no words and fails the base rule on ``n_words``; ratios with a zero
denominator are 0; repeated ``doc_id`` rows stay, each judged alone; an empty table gives an empty result; input columns
other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.tables import table

SPACE = "[\\x20\\x09-\\x0D]"

# Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no "
    "de la le et les des un une en du que pour dans par sur est qui au avec ce il pas plus se son ou ne sont "
    "der die und das den von zu mit sich des dem nicht ein eine als auch auf für ist im es an werden aus er hat dass sie nach bei "
    "el los las y del se con una su para al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también"
).split()

#: measure, least value, greatest value (None: open). A document is kept if every measure lies within its row.
THRESHOLDS = (
    ("n_words", 50, None),
    ("repeat_ratio", None, 0.5),
    ("mean_word_chars", 2.0, 14.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("dup_line_ratio", None, 0.3),
    ("upper_ratio", None, 0.4),
    ("shout_ratio", None, 0.1),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
    ("alpha_word_ratio", 0.6, None),
)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _verdict(thresholds) -> tuple[Column, Column]:
    """Conjunction of the table's rows, and the names of the rows that fail."""
    rules = []
    for name, least, most in thresholds:
        ok = F.lit(True)
        if least is not None:
            ok = ok & (F.col(name) >= F.lit(least))
        if most is not None:
            ok = ok & (F.col(name) <= F.lit(most))
        rules.append((name, ok))
    kept = F.lit(True)
    for _, ok in rules:
        kept = kept & ok
    failed = F.concat_ws(",", *[F.when(~ok, F.lit(name)) for name, ok in rules])
    return kept, failed


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measures of every row: ``doc_id``, counts and ratios."""
    t = F.col("t")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    words = F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    n_of = lambda pattern: F.regexp_count(t, F.lit(pattern))
    parts = base.select(
        "doc_id",
        words.alias("words"),
        lines.alias("lines"),
        (F.length(t) - n_of(SPACE)).alias("word_chars"),
        n_of("[#*$%&|<>]").alias("n_symbols"),
        # Words with a letter; the match starts where a word does, so that a long word without one is read once.
        n_of("(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D\\p{L}]*+\\p{L}").alias("n_alpha"),
        F.length(F.regexp_replace(t, "[^\\p{Lu}]+", "")).alias("n_upper"),
        F.length(F.regexp_replace(t, "[^\\p{L}]+", "")).alias("n_letters"),
        n_of("!").alias("n_shouts"),
    )
    w = F.col("words")
    # 64-bit hashes of all three-word windows. Most texts repeat none; of the others each hash gets its place, sorted so that equal windows are neighbours.
    hashes = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    h = F.col("hashes")
    windows = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    sorted_ = parts.withColumn("hashes", hashes).withColumn("windows", windows)
    s = F.col("windows")
    again = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["g"] == x["g"])) | F.coalesce(F.get(s, k + 1)["g"] == x["g"], F.lit(False)))
    starts = F.array_sort(F.transform(again, lambda x: x["i"]))
    # A window covers three words; less where the one before it overlaps.
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
    )["n"]
    n, m = F.size("words"), F.size("lines")
    lower = lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?")))
    counted = sorted_.select(
        "doc_id",
        n.cast("bigint").alias("n_words"),
        F.col("word_chars").cast("bigint").alias("word_chars"),
        F.col("n_symbols").cast("bigint").alias("n_symbols"),
        (m - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        covered.cast("bigint").alias("n_repeat_words"),
        m.cast("bigint").alias("n_lines"),
        F.size(F.filter("words", lambda x: lower(x).isin(STOP_WORDS))).alias("n_stop"),
        F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$"))).alias("n_ellipsis"),
        F.size(F.filter("lines", lambda x: x.rlike("^[\\x20\\x09-\\x0D]*[-*•]"))).alias("n_bullet"),
        "n_alpha",
        "n_upper",
        "n_letters",
        "n_shouts",
    )
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _ratio(F.col("n_repeat_words"), F.col("n_words")).alias("repeat_ratio"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_stop"), F.col("n_words")).alias("stop_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_upper"), F.col("n_letters")).alias("upper_ratio"),
        _ratio(F.col("n_shouts"), F.col("n_words")).alias("shout_ratio"),
        _ratio(F.col("n_ellipsis"), F.col("n_lines")).alias("ellipsis_line_ratio"),
        _ratio(F.col("n_bullet"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_alpha"), F.col("n_words")).alias("alpha_word_ratio"),
    )


def quality_rules(docs: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judges every row by ``thresholds``; ``failed_rules`` names what it failed, comma-joined."""
    kept, failed = _verdict(thresholds)
    return measure(docs, id_col, text_col).withColumns({"kept": kept, "failed_rules": failed})


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


_STOP_SQL = ", ".join(f"'{x}'" for x in STOP_WORDS)

OP1_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM p WHERE len(w) >= 3),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM g),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM h),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM k, (VALUES (0), (1), (2)) AS v(o) WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT p.doc_id, len(w) AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
             len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines,
             len(list_filter(w, lambda x: lower(regexp_replace(x, '[.,;:!?]+$', '')) IN ({_STOP_SQL}))) AS n_stop,
             len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS n_alpha,
             len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis,
             len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet,
             len(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, len(regexp_replace(t, '[^\\pL]+', '', 'g')) AS n_letters, len(t) - len(replace(t, '!', '')) AS n_shouts
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.3)
       AND (n_letters = 0 OR n_upper / n_letters <= 0.4) AND n_shouts / n_words <= 0.1 AND (n_lines = 0 OR (n_ellipsis / n_lines <= 0.3 AND n_bullet / n_lines <= 0.9)) AND n_alpha / n_words >= 0.6 AS kept
FROM q
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE = {"op1_quality_rules": OP1_SQL}
