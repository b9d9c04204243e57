"""Jobs that hold answers against sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.jobs.registry import Registry
from corpusmill.operators import grounding
from corpusmill.sources.tables import table

jobs = Registry()

NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace({t}, '\\[page [0-9]+\\]', ' ', 'g'), "
    "'\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g')), '[‘’`]', '''', 'g'), '[“”]', '\"', 'g'), '[*_#>|]', '', 'g'), '[‐-―-]\\s*', '', 'g'), '\\s+', ' ', 'g'))"
)


def _norm(t: str) -> str:
    return NORM.replace("{t}", t)


def _runs(t: str) -> str:
    w = f"list_filter(string_split_regex(regexp_replace({_norm(t)}, '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '')"
    return w


@jobs.query(f"SELECT doc_id, item_id FROM (SELECT doc_id, {_norm('text')} AS d FROM documents) JOIN (SELECT item_id, {_norm('text')} AS p FROM benchmark) ON p <> '' AND contains(d, p)")
def benchmark_quotes(spark, sf_dir):
    """Documents that contain a benchmark passage."""
    return grounding.contained_passages(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"), "item_id")


_SENT = "list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


@jobs.query(
    f"""
WITH g AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT {_runs("text")} AS w FROM benchmark) WHERE len(w) >= 3)),
s AS (SELECT doc_id, unnest(range(len(s))) AS n, unnest(s) AS x FROM (SELECT doc_id, {_SENT} AS s FROM documents)),
l AS (SELECT doc_id, n, {_runs("x")} AS w FROM s WHERE len(string_split_regex(x, '\\s+')) >= 6),
e AS (SELECT doc_id, n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, n, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) ELSE [-9] END) AS i FROM l)),
r AS (SELECT doc_id, n, count(g.g) / count(*) AS score FROM e LEFT JOIN g USING (g) GROUP BY ALL)
SELECT doc_id, count(*) AS n_sentences, count_if(score >= 0.6)::BIGINT AS n_traced, count_if(score < 0.3)::BIGINT AS n_weak, round(avg(score), 6) AS score FROM r GROUP BY doc_id"""
)
def trigram_trace(spark, sf_dir):
    """How much of each document traces to the benchmark's passages, word for word."""
    scored = grounding.trigram_trace(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"))
    s = F.col("score")
    return scored.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.count_if(s >= 0.6).alias("n_traced"), F.count_if(s < 0.3).alias("n_weak"), F.round(F.avg(s), 6).alias("score"))


_STOP = ", ".join(f"'{w}'" for w in grounding.CONTEXT_STOP)
_NUMBER = "[0-9]+(?:\\.[0-9]+)?"
_PLAIN = f"regexp_replace(x, '{grounding.LINKS}', ' ', 'g')"


@jobs.query(
    f"""
WITH s AS (SELECT doc_id, source, unnest(range(len(s))) AS n, unnest(s) AS x FROM (SELECT doc_id, source, {_SENT} AS s FROM documents)),
f AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(x, '{grounding.LINKS}', ' ', 'g'), '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda y: replace(y, ',', '')), lambda y: len(regexp_replace(y, '[^0-9]', '', 'g')) > 1)) AS nums,
             list_filter(list_distinct(regexp_extract_all({_norm(_PLAIN)}, '[a-z][a-z-]{{3,}}')), lambda y: y NOT IN ({_STOP})) AS ctx FROM s),
a AS (SELECT doc_id, source, n, ctx, unnest(nums) AS number FROM f WHERE len(nums) > 0),
g AS (SELECT *, number::DOUBLE AS v, 0.5 * pow(10.0, -len(regexp_extract(number, '\\.([0-9]+)$', 1))) AS tol FROM a),
t AS (SELECT doc_id AS src, source, regexp_replace({_norm("text")}, '([0-9]),([0-9])', '\\1\\2', 'g') AS t FROM documents),
p AS (SELECT src, source, t, regexp_extract_all(t, '{_NUMBER}') AS m, string_split_regex(t, '{_NUMBER}') AS gap FROM t),
o AS (SELECT src, source, t, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS m, unnest(gap[1:len(m)]) AS gap FROM p WHERE len(m) > 0),
c AS (SELECT src, source, m::DOUBLE AS mv, t, sum(len(gap) + len(m)) OVER (PARTITION BY src ORDER BY k) - len(m) AS pos FROM o),
w AS (SELECT src, source, mv, substr(t, greatest(0, pos - 250)::BIGINT + 1, (pos + 250 - greatest(0, pos - 250))::BIGINT) AS near FROM c),
h AS (SELECT g.doc_id, g.n, g.number, coalesce(bool_or(w.src <> g.doc_id AND len(list_filter(ctx, lambda y: contains(near, y))) >= CASE WHEN len(ctx) < 3 THEN 1 ELSE 2 END), FALSE) AS held
      FROM g LEFT JOIN w ON w.source = g.source AND abs(w.mv - g.v) <= g.tol GROUP BY g.doc_id, g.n, g.number)
SELECT doc_id, count(*) AS numbers, count_if(held)::BIGINT AS held FROM h GROUP BY doc_id"""
)
def number_in_context(spark, sf_dir):
    """Numbers of each document that another document of its source holds in context."""
    docs = table(spark, sf_dir, "documents")
    held = grounding.numbers_held(docs, "doc_id", docs, ["source"], source_id="doc_id")
    return held.groupBy("doc_id").agg(F.count("*").alias("numbers"), F.count_if("held").alias("held"))


@jobs.query(
    f"""
WITH g AS (SELECT DISTINCT conv_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT conv_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT conv_id, {_runs("text")} AS w FROM conversations WHERE role = 'user') WHERE len(w) >= 3)),
a AS (SELECT conv_id, turn, {_runs("text")} AS w FROM conversations WHERE role = 'assistant'),
e AS (SELECT conv_id, turn, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT conv_id, turn, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) ELSE [-9] END) AS i FROM a))
SELECT e.conv_id, e.turn, count(e.g) AS runs, count(g.g) AS traced, CASE WHEN count(g.g) / greatest(1, count(e.g)) >= 0.6 THEN 'traced' WHEN count(g.g) / greatest(1, count(e.g)) < 0.3 THEN 'weak' ELSE 'partly' END AS verdict
FROM e LEFT JOIN g ON g.conv_id = e.conv_id AND g.g = e.g GROUP BY e.conv_id, e.turn"""
)
def answer_verdict(spark, sf_dir):
    """Answers held against what their own conversation's user said; one too short for a word run traces to nothing."""
    from corpusmill.functions.text import word_runs

    turns = table(spark, sf_dir, "conversations")
    said = turns.where("role = 'user'").select("conv_id", F.explode(word_runs(F.coalesce("text", F.lit("")))).alias("g")).distinct().withColumn("hit", F.lit(1))
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.explode_outer(word_runs(F.coalesce("text", F.lit("")))).alias("g"))
    sums = answers.join(said, ["conv_id", "g"], "left").groupBy("conv_id", "turn").agg(F.count("g").alias("runs"), F.count("hit").alias("traced"))
    share = F.col("traced") / F.greatest(F.lit(1), "runs")
    return sums.withColumn("verdict", F.when(share >= 0.6, "traced").when(share < 0.3, "weak").otherwise("partly"))


def _answers(turns):
    """Answers that quote the first thing their user said, rightly and wrongly, nested, as a block and with its numbers."""
    said = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("u"))
    u = F.col("u")
    part = lambda a, n: F.substring(u, a, n)
    more = F.concat(
        F.lit('\nThe user said "'), part(1, 30), F.lit('" and not “'), F.reverse(part(1, 30)), F.lit('”. A number is '), F.length(u).cast("string"), F.lit(" there.\n> "), part(20, 40),
        F.lit('\nNested "'), part(1, 14), F.lit('"x", it said, or "'), part(30, 20), F.lit(" ... "), part(60, 20), F.lit('" at the end.\nWhole "'), part(5, 60), F.lit('"'),
    )
    return turns.where("role = 'assistant'").join(said, "conv_id").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))


@jobs.query(
    f"""
WITH s AS (SELECT conv_id, arg_min(text, turn) AS u FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT c.conv_id, c.turn, coalesce(c.text, '') || chr(10) || 'The user said "' || substr(u, 1, 30) || '" and not “' || reverse(substr(u, 1, 30)) || '”. A number is ' || len(u) || ' there.' || chr(10) || '> ' || substr(u, 20, 40)
      || chr(10) || 'Nested "' || substr(u, 1, 14) || '"x", it said, or "' || substr(u, 30, 20) || ' ... ' || substr(u, 60, 20) || '" at the end.' || chr(10) || 'Whole "' || substr(u, 5, 60) || '"' AS text FROM conversations c JOIN s USING (conv_id) WHERE role = 'assistant'),
src AS (SELECT conv_id, {_norm("coalesce(text, '')")} AS d, coalesce(text, '') AS text FROM conversations WHERE role = 'user'),
l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM a),
m AS (SELECT *, string_split_regex(line, '["“”]') AS p, trim(regexp_extract(line, '["“”](.*)["“”]', 1)) AS o, trim(regexp_extract(line, '^>\\s?(.{{12,}})$', 1)) AS b FROM l),
k AS (SELECT conv_id, turn, CASE WHEN len(p) > 3 AND len(o) >= 12 THEN o END AS o, list_filter([trim(p[i]) for i in range(2, len(p), 2)], lambda x: len(x) >= 12) AS pairs, nullif(b, '') AS b FROM m WHERE len(p) > 2 OR b <> ''),
spans AS (SELECT DISTINCT conv_id, unnest(list_concat([o, b], pairs)) AS q FROM k),
parts AS (SELECT conv_id, q, list_filter(string_split_regex({_norm("q")}, '\\s*(?:\\.\\.\\.|…)\\s*'), lambda x: len(x) >= 4) AS p FROM spans WHERE q IS NOT NULL),
hits AS (SELECT DISTINCT parts.conv_id, q FROM parts JOIN src USING (conv_id)
         WHERE CASE len(p) WHEN 0 THEN TRUE WHEN 1 THEN contains(d, p[1]) ELSE contains(d, p[1]) AND contains(substr(d, instr(d, p[1]) + len(p[1])), p[2]) END),
c AS (SELECT k.conv_id, turn, CASE WHEN h.q IS NOT NULL THEN [h.q] ELSE pairs END AS spans, b FROM k LEFT JOIN hits h ON h.conv_id = k.conv_id AND h.q = k.o),
e AS (SELECT DISTINCT conv_id, turn, q FROM (SELECT conv_id, turn, unnest(list_append(spans, b)) AS q FROM c) WHERE q IS NOT NULL),
qs AS (SELECT e.conv_id, turn, count(*) AS quotes, count(h.q) AS quotes_found FROM e LEFT JOIN hits h ON h.conv_id = e.conv_id AND h.q = e.q GROUP BY ALL),
g AS (SELECT DISTINCT conv_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT conv_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT conv_id, {_runs("text")} AS w FROM src) WHERE len(w) >= 3)),
st AS (SELECT conv_id, turn, unnest(range(len(s))) AS n, unnest(s) AS x FROM (SELECT conv_id, turn, {_SENT} AS s FROM a)),
r AS (SELECT conv_id, turn, n, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT conv_id, turn, n, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) ELSE [-9] END) AS i FROM (SELECT conv_id, turn, n, {_runs("x")} AS w FROM st WHERE len(string_split_regex(x, '\\s+')) >= 6))),
sc AS (SELECT r.conv_id, turn, n, count(g.g) / count(*) AS score FROM r LEFT JOIN g ON g.conv_id = r.conv_id AND g.g = r.g GROUP BY ALL),
tr AS (SELECT conv_id, turn, count(*) AS sentences, count_if(score >= 0.6) AS traced, count_if(score < 0.3) AS weak FROM sc GROUP BY ALL),
f AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all({_PLAIN}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), lambda y: replace(y, ',', '')), lambda y: len(regexp_replace(y, '[^0-9]', '', 'g')) > 1)) AS nums,
             list_filter(list_distinct(regexp_extract_all({_norm(_PLAIN)}, '[a-z][a-z-]{{3,}}')), lambda y: y NOT IN ({_STOP})) AS ctx FROM st),
gn AS (SELECT conv_id, turn, n, ctx, number, number::DOUBLE AS v, 0.5 * pow(10.0, -len(regexp_extract(number, '\\.([0-9]+)$', 1))) AS tol FROM (SELECT conv_id, turn, n, ctx, unnest(nums) AS number FROM f WHERE len(nums) > 0)),
t AS (SELECT row_number() OVER () AS src, conv_id, regexp_replace(d, '([0-9]),([0-9])', '\1\2', 'g') AS t FROM src),
o AS (SELECT src, conv_id, t, unnest(range(1, len(m) + 1)) AS k, unnest(m) AS m, unnest(gap[1:len(m)]) AS gap FROM (SELECT *, regexp_extract_all(t, '{_NUMBER}') AS m, string_split_regex(t, '{_NUMBER}') AS gap FROM t) WHERE len(m) > 0),
cc AS (SELECT conv_id, m::DOUBLE AS mv, t, sum(len(gap) + len(m)) OVER (PARTITION BY src ORDER BY k) - len(m) AS pos FROM o),
nr AS (SELECT conv_id, mv, substr(t, greatest(0, pos - 250)::BIGINT + 1, (pos + 250 - greatest(0, pos - 250))::BIGINT) AS near FROM cc),
h AS (SELECT gn.conv_id, turn, n, number, coalesce(bool_or(len(list_filter(ctx, lambda y: contains(near, y))) >= CASE WHEN len(ctx) < 3 THEN 1 ELSE 2 END), FALSE) AS held FROM gn LEFT JOIN nr ON nr.conv_id = gn.conv_id AND abs(mv - v) <= tol GROUP BY ALL),
nm AS (SELECT conv_id, turn, count(*) AS numbers, count_if(held) AS numbers_held FROM h GROUP BY ALL),
z AS (SELECT a.conv_id, a.turn, coalesce(quotes, 0) AS quotes, coalesce(quotes_found, 0) AS quotes_found, coalesce(sentences, 0) AS sentences, coalesce(traced, 0)::BIGINT AS traced, coalesce(weak, 0)::BIGINT AS weak, coalesce(numbers, 0) AS numbers, coalesce(numbers_held, 0)::BIGINT AS numbers_held
      FROM (SELECT DISTINCT conv_id, turn FROM a) a LEFT JOIN qs USING (conv_id, turn) LEFT JOIN tr USING (conv_id, turn) LEFT JOIN nm USING (conv_id, turn))
SELECT *, concat_ws('; ', CASE WHEN quotes > 0 THEN quotes_found || ' of ' || quotes || ' quotes found' ELSE 'no quotes' END, CASE WHEN sentences > 0 THEN traced || ' of ' || sentences || ' sentences traced' END, CASE WHEN numbers > 0 THEN numbers_held || ' of ' || numbers || ' numbers in context' END) AS summary FROM z"""
)
def answer_evidence(spark, sf_dir):
    """Answers of conversations held against all that their users said: quotes, sentences and numbers in one verdict."""
    turns = table(spark, sf_dir, "conversations")
    return grounding.verdicts(_answers(turns), ["conv_id", "turn"], turns.where("role = 'user'").select("conv_id", "text"), ["conv_id"])
