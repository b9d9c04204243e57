"""Jobs on documents, pages and their text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.jobs.registry import Registry
from corpusmill.operators import injection, manifest, sections
from corpusmill.sources.tables import table

jobs = Registry()

_COUNT = "len(regexp_extract_all({t}, '{p}'))"
_TOKENS = "greatest(1, floor(" + " + ".join(_COUNT.format(t="{t}", p=p) + f" * {w}::DOUBLE" for p, w in (("[A-Za-z]+", 1.098), ("[0-9]+", 2.207), ("[^A-Za-z0-9_\\s]", 0.569), ("\\n", 0.325))) + " + 0.5))::BIGINT"


def tokens_sql(t: str) -> str:
    """The token estimate as DuckDB SQL."""
    return _TOKENS.replace("{t}", t)


_TIDY = "regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({t}, '\\r\\n?', chr(10), 'g'), chr(160), ' '), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@jobs.query(f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@jobs.query(
    f"""
WITH t AS (SELECT source, sum({tokens_sql("text")})::BIGINT AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source)
SELECT source, n AS note_tokens, bytes, floor(bytes * 0.634::DOUBLE + 0.5)::BIGINT AS raw_tokens, floor(bytes * 0.634::DOUBLE / n + 0.5)::BIGINT AS ratio,
       '~' || CASE WHEN n < 1000 THEN n::VARCHAR WHEN n < 10000 THEN (floor(n / 1000 * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(n / 1000 * 10 + 0.5)::BIGINT % 10)::VARCHAR || 'k'
                   WHEN n < 1000000 THEN floor(n / 1000 + 0.5)::BIGINT::VARCHAR || 'k' ELSE (floor(n / 1000000 * 10 + 0.5)::BIGINT // 10)::VARCHAR || '.' || (floor(n / 1000000 * 10 + 0.5)::BIGINT % 10)::VARCHAR || 'M' END AS shown
FROM t"""
)
def token_compare(spark, sf_dir):
    """What a source's texts cost as text and as raw bytes."""
    docs = table(spark, sf_dir, "documents")
    sums = docs.groupBy("source").agg(F.sum(T.token_estimate(F.col("text"))).alias("note_tokens"), F.sum(F.octet_length("text")).alias("bytes"))
    raw = F.col("bytes") * T.TOKENS_PER_BYTE
    return sums.select("source", "note_tokens", "bytes", T.round_half_up(raw).alias("raw_tokens"), T.round_half_up(raw / F.col("note_tokens")).alias("ratio"), T.token_display(F.col("note_tokens"), millions=True).alias("shown"))


@jobs.query(f"SELECT doc_id, len(t)::BIGINT AS n_chars, sha256(t) AS name FROM (SELECT doc_id, {_TIDY.replace('{t}', 'text')} AS t FROM documents)")
def tidy_text(spark, sf_dir):
    t = T.tidy(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.sha2("t", 256).alias("name"))


_NUMBERED = """CASE WHEN label <> '' AND len(s) <= 90 AND NOT regexp_matches(title, '\\.{4,}|[.,;]$|\\s[0-9]+$')
  AND CASE WHEN depth >= 2 THEN letters >= 2 AND letters >= chars * 0.25 ELSE letters >= 3 AND letters >= chars * 0.55 AND regexp_matches(title, '^[A-Z0-9"''(“]') END THEN least(6, depth) ELSE 0 END"""


@jobs.query(
    f"""
WITH l AS (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS line FROM (SELECT doc_id, string_split({_TIDY.replace("{t}", "text")}, chr(10)) AS p FROM documents)),
m AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s, regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^((?:[0-9]{{1,3}}\\.)*[0-9]{{1,3}}\\.?|[A-Z]\\.(?:[0-9]{{1,3}}\\.?)*|Appendix\\s+[A-Z]\\.?)\\s{{1,4}}(\\S.{{1,80}})$', ['label', 'title']) AS x,
      regexp_matches(line, '^\\s*(```|~~~)') AS is_fence, coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY n), '') AS before FROM l),
k AS (SELECT *, x.label AS label, x.title AS title, len(list_filter(string_split(regexp_replace(x.label, '^Appendix\\s+', ''), '.'), lambda y: y <> '')) AS depth,
      len(regexp_replace(x.title, '[^A-Za-z]', '', 'g')) AS letters, len(regexp_replace(x.title, '\\s', '', 'g')) AS chars,
      sum(is_fence::INT) OVER (PARTITION BY doc_id ORDER BY n) % 2 = 1 OR is_fence AS fenced FROM m),
h AS (SELECT doc_id, n, is_fence, CASE WHEN fenced THEN 0 WHEN regexp_matches(line, '^#{{1,6}}\\s+\\S') THEN 1 WHEN trim(before) = '' AND NOT regexp_matches(line, '^\\s') THEN {_NUMBERED} ELSE 0 END AS d FROM k)
SELECT doc_id, count(*) AS n_lines, count_if(is_fence)::BIGINT AS n_fences, count_if(d > 0)::BIGINT AS n_headings FROM h GROUP BY doc_id"""
)
def line_blocks(spark, sf_dir):
    """Lines, fences and headings of every document."""
    b = sections.blocks(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    fence = F.col("line").rlike("^\\s*(```|~~~)")
    return b.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(fence).alias("n_fences"), F.count_if(F.col("depth") > 0).alias("n_headings"))


_SECTIONS = f"""
p AS (SELECT doc_id, {_TIDY.replace("{t}", "text")} AS t FROM documents),
l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS s, len(x) AS k FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM p)),
e AS (SELECT doc_id, n, CASE WHEN n < k - 1 THEN s || chr(10) ELSE s END AS s FROM l),
f AS (SELECT doc_id, n, unnest(range(greatest(1, (len(s) + 1999) // 2000))) AS i, s FROM e WHERE s <> ''),
g AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, i) AS r, substr(s, i * 2000 + 1, 2000) AS s FROM f),
w AS (SELECT doc_id, r, 0 AS sec, s AS open FROM g WHERE r = 1
      UNION ALL SELECT w.doc_id, g.r, CASE WHEN len(w.open) + len(g.s) > 2000 THEN sec + 1 ELSE sec END, CASE WHEN len(w.open) + len(g.s) > 2000 THEN g.s ELSE w.open || g.s END FROM w JOIN g ON g.doc_id = w.doc_id AND g.r = w.r + 1)"""


@jobs.query(
    f"""
WITH RECURSIVE {_SECTIONS}
SELECT doc_id, sec::BIGINT AS section_no, sha256(arg_max(open, r)) AS name, {tokens_sql("arg_max(open, r)")} AS tokens FROM w GROUP BY doc_id, sec"""
)
def sections_pack(spark, sf_dir):
    """Hash names and token estimates of the sections of every document."""
    s = sections.sections(table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.col("section_no").cast("bigint").alias("section_no"), F.sha2("section", 256).alias("name"), T.token_estimate(F.col("section")).alias("tokens"))


# Short lines of the documents stand for headings, the shortest for those of depth 1.
MARKED_SQL = "regexp_replace(regexp_replace({t}, '(?m)^([^#\\n][^\\n]{{0,24}})$', '# \\1', 'g'), '(?m)^([^#\\n][^\\n]{{25,59}})$', '## \\1', 'g')"


# Blocks of the documents by their headings, cut at {limit}: titles, texts and their order.
PIECES_SQL = f"""
p AS (SELECT doc_id, source, {MARKED_SQL.replace("{{", "{").replace("}}", "}").replace("{t}", _TIDY.replace("{t}", "coalesce(text, '')"))} AS md FROM documents),
l AS (SELECT doc_id, source, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, source, string_split(md, chr(10)) AS x FROM p)),
h AS (SELECT *, len(regexp_extract(line, '^(#{{1,6}})\\s+.+?\\s*#*\\s*$', 1)) AS depth FROM l),
b AS (SELECT *, sum((depth > 0)::INT) OVER (PARTITION BY doc_id ORDER BY n) AS blk FROM h),
k AS (SELECT doc_id, blk, max(depth) AS depth, min(source) AS source, arg_min(line, n) AS head, string_agg(line || chr(10), '' ORDER BY n) AS t FROM b GROUP BY doc_id, blk),
c AS (SELECT doc_id, source, blk, depth, t, CASE WHEN depth = 0 THEN {{root}} ELSE coalesce(nullif(left(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(head, '^#{{1,6}}\\s+(.+?)\\s*#*\\s*$', 1),
        '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[¶*_`]', '', 'g'), '\\\\([\\\\`*_{{}}\\[\\]()#+\\-.!])', '\\1', 'g'), '\\s+', ' ', 'g')), 100), ''), {{root}}) END AS title
      FROM k WHERE trim(regexp_replace(t, '\\s+', ' ', 'g')) <> ''),
dd AS (SELECT doc_id, source, blk, depth, title, t, (len(t) + {{limit}} - 1) // {{limit}} AS parts, unnest(range((len(t) + {{limit}} - 1) // {{limit}})) AS i FROM c),
g AS (SELECT doc_id, source, depth, CASE WHEN parts > 1 THEN title || ' (part ' || (i + 1) || ' of ' || parts || ')' ELSE title END AS title, substr(t, i * {{limit}} + 1, {{limit}}) AS s, row_number() OVER (PARTITION BY doc_id ORDER BY blk, i) AS r FROM dd)"""


def marked(md):
    """Short lines as headings."""
    for low, high, mark in ((0, 24, "#"), (25, 59, "##")):
        md = F.regexp_replace(md, f"(?m)^([^#\n][^\n]{{{low},{high}}})$", f"{mark} $1")
    return md


@jobs.query(
    f"""
WITH RECURSIVE {PIECES_SQL.replace("{limit}", "2000").replace("{root}", "source")},
w AS (SELECT doc_id, r, 0 AS sec, len(s) AS open FROM g WHERE r = 1
      UNION ALL SELECT w.doc_id, g.r, CASE WHEN open + len(g.s) > 2000 OR (open > 1000 AND g.depth = 1) THEN sec + 1 ELSE sec END, CASE WHEN open + len(g.s) > 2000 OR (open > 1000 AND g.depth = 1) THEN len(g.s) ELSE open + len(g.s) END
      FROM w JOIN g ON g.doc_id = w.doc_id AND g.r = w.r + 1),
m AS (SELECT g.doc_id, sec, g.r, title, s, row_number() OVER (PARTITION BY g.doc_id, sec ORDER BY g.r) AS q FROM g JOIN w ON w.doc_id = g.doc_id AND w.r = g.r),
n AS (SELECT *, sum(CASE WHEN q > 1 THEN len(title) + CASE WHEN q > 2 THEN 2 ELSE 0 END ELSE 0 END) OVER (PARTITION BY doc_id, sec ORDER BY q) AS run FROM m),
u AS (SELECT doc_id, sec, max(run) AS used, count(*) AS blocks FROM n GROUP BY doc_id, sec),
v AS (SELECT *, sum(used) OVER (PARTITION BY doc_id) AS total FROM u),
x AS (SELECT n.*, blocks, CASE WHEN total > 600 THEN greatest(300, floor(used * 600 / total)) ELSE 2147483647 END AS budget FROM n JOIN v ON v.doc_id = n.doc_id AND v.sec = n.sec),
y AS (SELECT doc_id, sec, min(blocks) AS blocks, arg_min(title, q) AS title, string_agg(s, '' ORDER BY q) AS s, coalesce(string_agg(title, '; ' ORDER BY q) FILTER (q = 2 OR (q > 2 AND run <= budget)), '') AS covers, count_if(q = 2 OR (q > 2 AND run <= budget)) AS shown FROM x GROUP BY doc_id, sec),
z AS (SELECT *, left(trim(regexp_replace(regexp_replace(s, '(?m)^#+\\s[^\\n]*$', ''), '\\s+', ' ', 'g')), 110) AS b FROM y)
SELECT doc_id, sec::BIGINT AS section_no, sha256(s) AS name, {tokens_sql("s")} AS tokens, blocks::BIGINT AS blocks, title,
       CASE WHEN blocks = 1 THEN CASE WHEN b = '' THEN '' ELSE 'begins "' || b || CASE WHEN len(b) >= 110 THEN '…' ELSE '' END || '"' END WHEN shown < blocks - 1 THEN covers || '; +' || (blocks - 1 - shown)::BIGINT || ' more' ELSE covers END AS covers FROM z"""
)
def heading_sections(spark, sf_dir):
    """Sections of documents by their headings, each with its title and what it covers; short lines stand for headings."""
    md = marked(T.tidy(F.coalesce("text", F.lit(""))))
    cut = sections.described(sections.heading_sections(F.col("md"), F.col("source"), 2_000), 600)
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", md.alias("md")).select("doc_id", F.posexplode(cut).alias("n", "s"))
    return rows.select("doc_id", F.col("n").cast("bigint").alias("section_no"), F.sha2("s.text", 256).alias("name"), T.token_estimate(F.col("s.text")).alias("tokens"), F.col("s.blocks").cast("bigint").alias("blocks"), "s.title", "s.covers")


_STOP = ", ".join(f"'{w}'" for w in sections.STOP_WORDS)


_TERMS = f"""
tw AS (SELECT source, doc_id, unnest(range(len(x))) AS i, unnest(x) AS term FROM (SELECT source, doc_id, regexp_extract_all(regexp_replace(lower(text), '\\[page [0-9]+\\]|https?://\\S+', ' ', 'g'), '[a-z][a-z0-9_]{{3,}}') AS x FROM documents)),
tc AS (SELECT source, doc_id, term, count(*) AS c, min(i) AS fst FROM tw WHERE term NOT IN ({_STOP}) GROUP BY ALL),
td AS (SELECT source, term, count(*) AS df FROM tc GROUP BY ALL), tn AS (SELECT source, count(*) AS total FROM documents GROUP BY ALL), tl AS (SELECT source, doc_id, sum(c) AS len FROM tc GROUP BY ALL),
ts AS (SELECT source, doc_id, term, c, c / len * ln(total / df) AS score, fst FROM tc JOIN td USING (source, term) JOIN tn USING (source) JOIN tl USING (source, doc_id) WHERE c >= 2 AND total >= 3 AND df < total)"""


@jobs.query(
    f"""
WITH {_TERMS}
SELECT source, doc_id, term, c, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY round(score, 12) DESC, fst) AS rank FROM ts) WHERE rank <= 6"""
)
def tfidf_terms(spark, sf_dir):
    """Distinctive terms of each document among those of its source."""
    found = sections.distinctive_terms(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return found.select("source", "doc_id", "term", "c", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@jobs.query(
    f"""
WITH RECURSIVE {_SECTIONS},
x AS (SELECT doc_id, sec::BIGINT AS pos, sha256(arg_max(open, r)) AS h, {tokens_sql("arg_max(open, r)")} AS tokens FROM w GROUP BY doc_id, sec),
t AS (SELECT 0 AS lvl, doc_id, pos, h FROM x UNION ALL
      SELECT lvl + 1, doc_id, pos // 2, CASE WHEN count(*) = 2 THEN sha256(unhex(min(h) FILTER (pos % 2 = 0) || min(h) FILTER (pos % 2 = 1))) ELSE min(h) END FROM t WHERE lvl < 16 GROUP BY lvl, doc_id, pos // 2),
{_TERMS},
b AS (SELECT doc_id, string_agg(term, ' ' ORDER BY rank) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY round(score, 12) DESC, fst) AS rank FROM ts) WHERE rank <= 5 GROUP BY doc_id)
SELECT z.doc_id, z.n_sections, z.tokens, t.h AS root, coalesce(b.terms, '') AS terms
FROM (SELECT doc_id, count(*) AS n_sections, sum(tokens)::BIGINT AS tokens FROM x GROUP BY doc_id) z JOIN t ON t.doc_id = z.doc_id AND t.lvl = 16 LEFT JOIN b ON b.doc_id = z.doc_id"""
)
def document_index(spark, sf_dir):
    """One index row per document: sections, tokens, Merkle root over the section hashes and distinctive terms of its collection."""
    docs = table(spark, sf_dir, "documents")
    # Everything about a document's own sections is made in its row; only terms are shuffled.
    packed = docs.select("doc_id", sections.pack(sections.line_pieces(T.tidy(F.coalesce("text", F.lit("")))), 2_000).alias("s")).where(F.size("s") > 0)
    sizes = packed.select("doc_id", F.size("s").cast("bigint").alias("n_sections"), F.aggregate(F.transform("s", T.token_estimate), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"), manifest.merkle_fold(F.transform("s", lambda x: F.sha2(x, 256))).alias("root"))
    terms = sections.distinctive_terms(docs, "source", "doc_id", "text", 5).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    named = terms.select("doc_id", F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("terms"))
    return sizes.join(named, "doc_id", "left").select("doc_id", "n_sections", "tokens", "root", F.coalesce("terms", F.lit("")).alias("terms"))


@jobs.query(
    """
WITH l AS (SELECT source, doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT source, doc_id, string_split(text, chr(10)) AS x FROM documents)),
b AS (SELECT *, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS o FROM l WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''),
e AS (SELECT source, doc_id, n, line, lower(regexp_replace(o, '[0-9]+', '#', 'g')) AS key, row_number() OVER (PARTITION BY source, doc_id ORDER BY n) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY n DESC) AS z FROM b),
g AS (SELECT * FROM e WHERE (a <= 2 OR z <= 2) AND NOT regexp_matches(line, '^\\[page [0-9]+\\]$')), k AS (SELECT source, key, count(*) AS c FROM g GROUP BY ALL), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY ALL)
SELECT source, doc_id, n::BIGINT AS line_no, sha256(line) AS line_hash, c FROM g JOIN k USING (source, key) JOIN p USING (source) WHERE pages >= 4 AND c >= greatest(3, pages * 0.05)"""
)
def running_lines(spark, sf_dir):
    """Lines that recur at the edges of a source's documents."""
    found = sections.running_lines(table(spark, sf_dir, "documents"), "source", "doc_id", "text", 0.05)
    return found.select("source", "doc_id", F.col("n").cast("bigint").alias("line_no"), F.sha2("line", 256).alias("line_hash"), "c")


_WHY = "CASE " + " ".join(f"WHEN regexp_matches(line, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{name}'" for name, p in injection.CLASSES) + " END"


@jobs.query(
    f"""
WITH t AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations UNION ALL SELECT 'benchmark', item_id, text FROM benchmark),
l AS (SELECT origin, id, unnest(string_split(text, chr(10))) AS line FROM t), f AS (SELECT origin, count({_WHY})::BIGINT AS flagged, count(*) AS lines FROM l GROUP BY origin),
h AS (SELECT origin, sum(len(regexp_extract_all(text, '{injection.HIDDEN}')))::BIGINT AS hidden FROM t GROUP BY origin)
SELECT origin, lines, flagged, hidden FROM f JOIN h USING (origin)"""
)
def injection_scan(spark, sf_dir):
    """Lines that read like instructions to a model, and hidden characters, by table."""
    sources = (("documents", F.col("doc_id")), ("conversations", F.col("conv_id") * 1000 + F.col("turn")), ("benchmark", F.col("item_id")))
    parts = [table(spark, sf_dir, name).select(F.lit(name).alias("origin"), key.alias("id"), F.coalesce("text", F.lit("")).alias("text")) for name, key in sources]
    texts = parts[0].unionByName(parts[1]).unionByName(parts[2])
    each = texts.select("origin", (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), injection.flagged_lines(F.col("text")).alias("flagged"), injection.hidden_count(F.col("text")).alias("hidden"))
    return each.groupBy("origin").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("lines", "flagged", "hidden")])


@jobs.query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.one_line(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


@jobs.query()
def html_to_blocks(spark, sf_dir):
    """Markdown blocks of every page."""
    from corpusmill.sources.html import page_blocks

    return page_blocks(table(spark, sf_dir, "pages"))


_CRED = "^(x-amz-|x-goog-)|^(signature|expires|key-pair-id|policy|sig|se|sp|sv|sr|st|skoid|sktid|skt|ske|sks|skv|token|access_token)$"


@jobs.query(
    f"""
WITH p AS (SELECT page_id, url, string_split(regexp_extract(url, '\\?([^#]*)', 1), '&') AS q FROM pages),
k AS (SELECT page_id, url, q, list_filter(q, lambda x: NOT regexp_matches(split_part(x, '=', 1), '(?i){_CRED}|^page$|^utm_source$')) AS kept FROM p)
SELECT page_id, CASE WHEN len(kept) = len(q) THEN url WHEN len(kept) = 0 THEN regexp_replace(url, '\\?[^#]*', '') ELSE regexp_replace(url, '\\?[^#]*', '?' || array_to_string(kept, '&')) END AS clean, len(kept) < len(q) AS withheld,
       lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS object FROM k"""
)
def url_strip_credentials(spark, sf_dir):
    """Addresses without credential and tracking parameters, and the object that each names (origin and path)."""
    from corpusmill.functions.urls import object_of, strip_parameters

    clean, gone = strip_parameters(F.col("url"), ("page", "utm_source"))
    return table(spark, sf_dir, "pages").select("page_id", clean.alias("clean"), gone.alias("withheld"), object_of(F.col("url")).alias("object"))


@jobs.query(
    """
SELECT object, count(*) AS pages, min(page_id) AS first FROM (SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1)) || regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS object FROM pages) GROUP BY object"""
)
def url_same_object(spark, sf_dir):
    """Pages that name the same object."""
    from corpusmill.functions.urls import object_of

    return table(spark, sf_dir, "pages").groupBy(object_of(F.col("url")).alias("object")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))


@jobs.query(
    """
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://\\S+?(\\.pmtiles|\\.fgb|\\.m3u8|\\.zarr/?|\\.dcm|\\.safetensors|\\.gguf|\\.splat|\\.ply|\\.jpe?g|\\.m4v|\\.tiff?|\\.nc|\\.h5|\\.hdf5|\\.las|\\.laz|\\.parquet|\\.mp4|\\.mov|\\.bin|\\.zip)(\\?\\S*)?$') THEN 'point'
            WHEN regexp_matches(url, '(?i)^https?://[a-z0-9.-]+\\.s3(\\.[a-z0-9-]+)?\\.amazonaws\\.com/\\S*/$') THEN 'point' WHEN regexp_matches(url, '^[a-z2-7]{26}$') THEN 'resolve' WHEN regexp_matches(url, '^https?://\\S+$') THEN 'make' ELSE 'text' END AS flow FROM pages"""
)
def route_input(spark, sf_dir):
    """Which flow an input starts, by an ordered cascade of patterns."""
    from corpusmill.functions.urls import route

    return table(spark, sf_dir, "pages").select("page_id", route(F.col("url")).alias("flow"))


@jobs.query(
    """
WITH f AS (SELECT source, '/' || CASE WHEN doc_id % 7 = 0 THEN 'README.md' WHEN doc_id % 7 = 1 THEN 'docs/guide.md' WHEN doc_id % 7 = 2 THEN 'tests/case.py' WHEN doc_id % 7 = 3 THEN 'CHANGELOG.md' WHEN doc_id % 7 = 4 THEN 'data/table.csv' WHEN doc_id % 7 = 5 THEN 'node_modules/x.js' ELSE 'src/main.py' END AS path, doc_id, n_chars AS size FROM documents),
k AS (SELECT *, CASE WHEN path = '/README.md' THEN 0 WHEN path = '/CHANGELOG.md' THEN 4 WHEN path LIKE '/docs/%' THEN 1 WHEN path LIKE '/tests/%' THEN 4 WHEN path LIKE '/data/%' THEN 5 ELSE 3 END AS rank FROM f WHERE size < 400000 AND path NOT LIKE '%node_modules/%'),
w AS (SELECT *, sum(size) OVER o AS total, row_number() OVER o AS rn FROM k WINDOW o AS (PARTITION BY source ORDER BY rank, path, doc_id ROWS UNBOUNDED PRECEDING))
SELECT source, doc_id, path, rank::BIGINT AS rank, total::BIGINT AS total FROM w WHERE total <= 40000 AND rn <= 900"""
)
def repo_rank_budget(spark, sf_dir):
    """Documents as a source's files: readable ones by rank, as far as a size budget goes."""
    from corpusmill.operators.listing import budgeted, file_rank, readable_file

    names = F.create_map(*[F.lit(x) for pair in enumerate(("README.md", "docs/guide.md", "tests/case.py", "CHANGELOG.md", "data/table.csv", "node_modules/x.js", "src/main.py")) for x in pair])
    files = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("/"), F.element_at(names, (F.col("doc_id") % 7).cast("int"))).alias("path"), "doc_id", F.col("n_chars").alias("size"))
    ranked = files.where(readable_file(F.col("path"), F.col("size"))).withColumn("rank", file_rank(F.col("path")))
    return budgeted(ranked, "source", ["rank", "path", "doc_id"], 40_000, 900).select("source", "doc_id", "path", F.col("rank").cast("bigint").alias("rank"), "total")


@jobs.query(
    """
WITH g AS (SELECT coalesce(nullif(lower(source), ''), '(none)') AS ext, sum(n_chars)::BIGINT AS bytes, count(*) AS files, count_if(n_chars >= 10000)::BIGINT AS large FROM documents GROUP BY 1)
SELECT * FROM g ORDER BY bytes DESC, ext LIMIT 6"""
)
def ext_rollup(spark, sf_dir):
    """The six kinds with the most bytes."""
    kind = F.coalesce(F.nullif(F.lower("source"), F.lit("")), F.lit("(none)"))
    sums = table(spark, sf_dir, "documents").groupBy(kind.alias("ext")).agg(F.sum("n_chars").alias("bytes"), F.count("*").alias("files"), F.count_if(F.col("n_chars") >= 10_000).alias("large"))
    return sums.orderBy(F.desc("bytes"), "ext").limit(6)


@jobs.query("SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion') AND contains(lower(text), 'with')")
def search_all_words(spark, sf_dir):
    """Documents that contain every word of a query."""
    words = F.split(F.lit("the tion with"), "\\s+")
    return table(spark, sf_dir, "documents").where(F.forall(words, lambda w: F.contains(F.lower("text"), w))).select("doc_id", "lang")


@jobs.query("SELECT coalesce(event_type, 'all') AS kind, coalesce(b::VARCHAR, 'all') AS keeper, n FROM (SELECT event_type, user_id % 4 AS b, count(*) AS n FROM events GROUP BY CUBE (event_type, user_id % 4))")
def cube_tally(spark, sf_dir):
    """Tallies by kind, by keeper, by both and of all."""
    events = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 4).alias("b"))
    n = events.cube("event_type", "b").agg(F.count("*").alias("n"))
    return n.select(F.coalesce("event_type", F.lit("all")).alias("kind"), F.coalesce(F.col("b").cast("string"), F.lit("all")).alias("keeper"), "n")


@jobs.query(
    """
WITH n AS (SELECT doc_id, 'title: ' || source || chr(10) || 'lang: ' || lang || chr(10) || 'chars: ' || n_chars || chr(10) || chr(10) || text AS body FROM documents)
SELECT doc_id, regexp_extract(body, '(?m)^lang: (.+)$', 1) AS lang, regexp_extract(body, '(?m)^chars: (.+)$', 1) AS chars, 'note ' || regexp_extract(body, '(?m)^title: (.+)$', 1) || ' lang=' || regexp_extract(body, '(?m)^lang: (.+)$', 1) AS line FROM n"""
)
def front_matter(spark, sf_dir):
    """Rendered notes read back: fields and the one-line form."""
    lines = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\n")) for k, c in (("title", "source"), ("lang", "lang"), ("chars", "n_chars"))]
    notes = table(spark, sf_dir, "documents").select("doc_id", F.concat(*lines, F.lit("\n"), F.col("text")).alias("body"))
    field = lambda k: T.front_matter(F.col("body"), k)
    return notes.select("doc_id", field("lang").alias("lang"), field("chars").alias("chars"), F.concat(F.lit("note "), field("title"), F.lit(" lang="), field("lang")).alias("line"))


@jobs.query(
    """
SELECT lang, doc_id // 500 AS page, count(*) AS n, string_agg(line, chr(10) ORDER BY doc_id) AS body FROM (SELECT lang, doc_id, 'doc ' || doc_id || ' ' || source || ' chars=' || n_chars AS line FROM documents) GROUP BY lang, page"""
)
def agent_catalog(spark, sf_dir):
    """Every document's line, a page for each language and 500 ids."""
    line = F.concat(F.lit("doc "), F.col("doc_id").cast("string"), F.lit(" "), F.col("source"), F.lit(" chars="), F.col("n_chars").cast("string"))
    lines = table(spark, sf_dir, "documents").select("lang", F.floor(F.col("doc_id") / 500).alias("page"), "doc_id", line.alias("line"))
    return lines.groupBy("lang", "page").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "line"))), lambda x: x["line"]), "\n").alias("body"))


_UNDER = "CASE WHEN len(x) BETWEEN 10 AND 60 AND len(x) % 3 = 0 THEN x || chr(10) || repeat(substr('=~-^*#+', len(x)::INT % 7 + 1, 1), greatest(1, len(x) + len(x) % 9 - 4)::INT) ELSE x END"


@jobs.query(
    f"""
WITH t AS (SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_UNDER}), chr(10)) AS t FROM documents),
l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM (SELECT doc_id, string_split({_TIDY.replace("{t}", "t")}, chr(10)) AS x FROM t)),
m AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s, regexp_extract(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '^((?:[0-9]{{1,3}}\\.)*[0-9]{{1,3}}\\.?|[A-Z]\\.(?:[0-9]{{1,3}}\\.?)*|Appendix\\s+[A-Z]\\.?)\\s{{1,4}}(\\S.{{1,80}})$', ['label', 'title']) AS x,
      coalesce(lag(line) OVER w, '') AS before, coalesce(lead(line) OVER w, '') AS after FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
k AS (SELECT *, x.label AS label, x.title AS title, len(list_filter(string_split(regexp_replace(x.label, '^Appendix\\s+', ''), '.'), lambda y: y <> '')) AS depth, len(regexp_replace(x.title, '[^A-Za-z]', '', 'g')) AS letters, len(regexp_replace(x.title, '\\s', '', 'g')) AS chars FROM m),
d AS (SELECT doc_id, n, line, s, CASE WHEN s <> '' AND NOT regexp_matches(line, '^\\s') AND abs(len(trim(after)) - len(s)) <= 3 THEN
        CASE WHEN regexp_matches(after, '^(={{3,}}|#{{3,}})\\s*$') THEN 1 WHEN regexp_matches(after, '^-{{3,}}\\s*$') THEN 2 WHEN regexp_matches(after, '^(~{{3,}}|\\^{{3,}}|\\*{{3,}})\\s*$') THEN 3 ELSE 0 END ELSE 0 END AS under,
      CASE WHEN trim(before) = '' AND NOT regexp_matches(line, '^\\s') THEN {_NUMBERED} ELSE 0 END AS num FROM k),
g AS (SELECT *, coalesce(lag(under) OVER (PARTITION BY doc_id ORDER BY n), 0) > 0 AS gone FROM d)
SELECT doc_id, count_if(NOT gone AND greatest(under, num) > 0)::BIGINT AS headings, sha256(string_agg(CASE WHEN under > 0 OR num > 0 THEN chr(10) || repeat('#', CASE WHEN under > 0 THEN under ELSE num END::INT) || ' ' || trim(regexp_replace(line, '\\s+', ' ', 'g')) || chr(10) ELSE line END, chr(10) ORDER BY n) FILTER (NOT gone)) AS name
FROM g GROUP BY doc_id"""
)
def text_headings(spark, sf_dir):
    """Plain texts with their headings marked; a third of the short lines get an underline of some mark and length."""
    n = lambda x: F.length(x)
    under = lambda x: F.repeat(F.substring(F.lit("=~-^*#+"), n(x) % 7 + 1, F.lit(1)), F.greatest(F.lit(1), n(x) + n(x) % 9 - 4))
    lined = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.when((n(x) >= 10) & (n(x) <= 60) & (n(x) % 3 == 0), F.concat(x, F.lit("\n"), under(x))).otherwise(x))
    marked_up = table(spark, sf_dir, "documents").select("doc_id", sections.text_markdown(F.array_join(lined, "\n")).alias("md"))
    return marked_up.select("doc_id", F.size(F.filter(F.split("md", "\n"), lambda x: x.rlike("^#{1,6} "))).cast("bigint").alias("headings"), F.sha2("md", 256).alias("name"))
