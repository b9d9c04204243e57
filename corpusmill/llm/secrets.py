"""Secret scans: fixed patterns, and a battery of randomness tests on token-like strings. DataFrame functions only.

Battery, for each token of 20 or more characters with a digit or mixed case that no pattern covers: its alphabet is inferred (decimal,
hex, base32, base36, base62, base64); chi-squared tells how far its symbols are from uniform, a runs test and the lag-1 serial correlation
whether their order is random. A token is put aside as proven not random if one of the three tests rejects it at a quarter of ``level``, or if it is
base64 of printable text; so at most ``level`` of the truly random tokens are lost, whatever else the corpus holds. Chi-squared's limits are exact up to ``EXACT_LENGTH`` symbols, from the distribution
of the sum of squared counts by a recursion over the alphabet; above, its tail is approximated by cube roots and cut at half the level, as that approximation is a little light.

What is left is not yet a secret: short names can pass any such battery. So the claim "random" is tested against ordinary tokens as the null: letters at
the frequencies of prose, with changes between small letters, capitals, digits and marks as in names and paths, or digits alone, of which numbers are made; so a number is never reported. The likelihood ratio of
"uniform over its alphabet" to that null has a mean of at most 1 under the null, so it is an e-value, and it grows with a token's length. In each stratum
of alphabet and length band the step-up rule for e-values bounds the expected share of false discoveries among those reported as kind ``random`` by ``fdr``. The rule
runs on a histogram of whole bits of evidence, so it covers all tokens of a corpus; a token that carries less than ``min_bits`` is never reported.

Defined results: a null text is empty and has no spans (the digest of an empty string); positions count code points, ends are exclusive;
repeated ``doc_id`` rows are scanned and reported each; an empty table gives an empty result; other input columns are ignored.
Spans are gathered by input row, so a group never exceeds one text.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import table, written

# The base patterns, in the order in which equal starts are listed.
PATTERNS = (
    ("assign", "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]{32,}"),
)
CANDIDATE = "[A-Za-z0-9+/_-]{20,}"
KINDS = [name for name, _ in PATTERNS] + ["random"]
# Alphabets, the first that holds a token is taken.
ALPHABETS = (
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[a-z0-9]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: The order in which symbols are numbered for the null: capitals, small letters, digits, marks.
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
# Letters of English prose in per cent, a to z.
LETTERS = (8.167, 1.492, 2.782, 4.253, 12.702, 2.228, 2.015, 6.094, 6.966, 0.153, 0.772, 4.025, 2.406, 6.749, 7.507, 1.929, 0.095, 5.987, 6.327, 9.056, 2.758, 0.978, 2.360, 0.150, 1.974, 0.074)
#: Under the null a symbol is of the same kind as the one before it with this probability; the other three kinds share the rest.
SAME_KIND = 0.85
#: Row numbers up to this count are broadcast (8 bytes each); more are joined.
BROADCAST_ROWS = 4_000_000
#: Length up to which chi-squared's limits are exact.
EXACT_LENGTH = 128
HITS = "array<struct<kind:int,i:int,gap:int,len:int,match:string>>"


def _hits(text: Column, kind: int, pattern: str) -> Column:
    """Matches with the length of the text before each, since the match before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    hits = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    # The last gap has no match after it.
    kept = F.filter(hits, lambda x: x["m"].isNotNull())
    rows = F.transform(kept, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["g"].alias("gap"), F.length(x["m"]).alias("len"), x["m"].alias("match")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(HITS))


@cache
def uneven_from(level: float, longest: int = EXACT_LENGTH) -> dict[str, list[int]]:
    """For each alphabet and length (from 0) the least sum of squared counts that a random token reaches with a probability of at most ``level``.

    Exact: the ways to put n symbols on the first k letters with a given sum of squares, letter by letter, for all n at once.
    """
    top = longest + longest * (longest - 1) // 10 + 25 * longest
    ways = np.zeros((longest + 1, top + 1))
    ways[0, 0] = 1
    sizes = {len(a): n for n, _, a in ALPHABETS}
    out = {}
    for k in range(1, max(sizes) + 1):
        # Scaled by k / (k - 1) a symbol, so that the rows stay probabilities: the share of the k letters' tokens.
        more = np.zeros_like(ways)
        for c in range(min(longest, math.isqrt(top)) + 1):
            n = np.arange(c, longest + 1)
            term = np.array([math.exp(math.lgamma(x + 1) - math.lgamma(c + 1) - math.lgamma(x - c + 1) - c * math.log(k) + (x - c) * (math.log((k - 1) / k) if k > 1 else 0.0)) if k > 1 or x == c else 0.0 for x in n.tolist()])
            more[c:, c * c :] += term[:, None] * ways[: longest + 1 - c, : top + 1 - c * c]
        ways = more
        if k in sizes:
            tail = 1 - np.concatenate([np.zeros((longest + 1, 1)), np.cumsum(ways, axis=1)], axis=1)
            out[sizes[k]] = [int(np.argmax(t <= level)) if (t <= level).any() else top + 1 for t in tail]
    return {name: out[sizes[len(a)]] for name, _, a in ALPHABETS}


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a rational approximation of erfc with an error below 1.5e-7."""
    # Coefficients of Abramowitz and Stegun 7.1.26.
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + x * 0.3275911)
    poly = t * (t * (t * (t * (t * 1.061405429 - 1.453152027) + 1.421413741) - 0.284496736) + 0.254829592)
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def randomness(tokens: DataFrame, token_col: str = "match", level: float = 1e-3) -> DataFrame:
    """Adds ``alphabet``, ``bits``, ``p_uniform``, ``p_runs``, ``p_serial``, ``evidence`` and ``passes``: whether no test rejects at a quarter of ``level``."""
    s = F.col(token_col)
    name = F.coalesce(*[F.when(s.rlike(pattern), F.lit(n)) for n, pattern, _ in ALPHABETS])
    letters = F.coalesce(*[F.when(F.col("alphabet") == n, F.lit(a)) for n, _, a in ALPHABETS])
    x = tokens.withColumn("alphabet", name).withColumn("letters", letters)
    x = x.withColumns({"n": F.length(s).cast("double"), "k": F.length("letters").cast("double"), "v": F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.col("letters"), c).cast("double"))})
    v, n, k = F.col("v"), F.col("n"), F.col("k")
    # Sum of squared counts: each symbol's count, summed over its occurrences, by sorted run lengths.
    folded = F.aggregate(
        F.array_sort(v),
        F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
        lambda a, y: F.struct(
            y.alias("last"),
            F.when(a["last"] == y, a["run"] + 1).otherwise(F.lit(1.0)).alias("run"),
            (a["sum"] + F.when(a["last"] == y, 2 * a["run"] + 1).otherwise(F.lit(1.0))).alias("sum"),
        ),
    )
    mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
    x = x.withColumns({"squares": folded["sum"], "mean": mean})
    m = F.col("mean")
    high = F.aggregate(v, F.lit(0.0), lambda a, y: a + F.when(y > k / 2, 1.0).otherwise(0.0))
    steps = F.transform(v, lambda y, i: F.struct(y.alias("y"), F.get(v, i + 1).alias("next")))
    pairs = F.filter(steps, lambda p: p["next"].isNotNull())
    x = x.withColumns(
        {
            "n1": high,
            "turns": F.aggregate(pairs, F.lit(1.0), lambda a, p: a + F.when((p["y"] > k / 2) != (p["next"] > k / 2), 1.0).otherwise(0.0)),
            "cov": F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["y"] - m) * (p["next"] - m)),
            "var": F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - m) * (y - m)),
        }
    )
    n1, n2 = F.col("n1"), F.col("n") - F.col("n1")
    # Wilson and Hilferty's cube root, on the degrees of freedom that give the statistic's mean and variance.
    freedom = (k - 1) * n / (n - 1)
    uniform = (F.cbrt((k / n * F.col("squares") - n) / (k - 1)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
    expected = 2 * n1 * n2 / n + 1
    spread = F.greatest(F.lit(1e-9), (expected - 1) * (expected - 2) / (n - 1))
    runs = F.when((n1 == 0) | (n2 == 0), F.lit(9.0)).otherwise((F.col("turns") - expected) / F.sqrt(spread))
    serial = F.when(F.col("var") <= 1e-12, F.lit(9.0)).otherwise((F.col("cov") / F.when(F.col("var") > 1e-12, F.col("var")) + 1 / n) * F.sqrt(n))
    x = x.withColumns({"p_uniform": _upper_tail(uniform), "p_runs": 2 * _upper_tail(F.abs(runs)), "p_serial": 2 * _upper_tail(F.abs(serial))})
    # A row of limits is one text of eight characters a length: a small expression.
    rows = F.coalesce(*[F.when(F.col("alphabet") == name, F.lit("".join(f"{x:8}" for x in row))) for name, row in uneven_from(level / 4).items()])
    limit = F.trim(F.substring(rows, (n * 8 + 1).cast("int"), F.lit(8))).cast("double")
    even = F.when(n <= EXACT_LENGTH, F.col("squares") < limit).otherwise(F.col("p_uniform") >= level / 8)
    passes = even & (F.least("p_runs", "p_serial") >= level / 4)
    return x.withColumns({"passes": passes, "bits": n * F.log2(k), "evidence": _evidence(s, n, k)}).drop("letters", "v", "squares", "mean", "n1", "turns", "cov", "var", "k", "n")


def _evidence(token: Column, n: Column, k: Column) -> Column:
    """log2 of the likelihood of a token as uniform over its alphabet of ``k`` (one of ``ALPHABETS``, equally likely) against an ordinary one."""
    costs = [-math.log2(x / sum(LETTERS)) for x in LETTERS] * 2 + [math.log2(10)] * 10 + [math.log2(len(SYMBOLS) - 62)] * (len(SYMBOLS) - 62)
    cost = F.array(*map(F.lit, costs))
    kind = lambda y: F.when(y <= 26, 0).when(y <= 52, 1).when(y <= 62, 2).otherwise(3)
    same, other = -math.log2(SAME_KIND), -math.log2((1 - SAME_KIND) / 3)
    places = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(SYMBOLS), c))
    plain = F.aggregate(
        places,
        F.struct(F.lit(-1).alias("kind"), F.lit(0.0).alias("bits")),
        lambda a, y: F.struct(
            kind(y).alias("kind"),
            (a["bits"] + F.element_at(cost, y) + F.when(a["kind"] < 0, F.lit(2.0)).when(a["kind"] == kind(y), F.lit(same)).otherwise(F.lit(other))).alias("bits"),
        ),
    )["bits"]
    # The null is a mixture: a token of digits alone costs no more than a number, and a bit for that choice.
    number = F.when(~token.rlike("[^0-9]"), n * math.log2(10) + 1)
    return F.least(plain, number) - n * F.log2(k) - math.log2(len(ALPHABETS))


def _holds_prose(token: Column) -> Column:
    """Whether a token is base64 of printable text."""
    whole = F.rpad(F.translate(token, "-_", "+/"), F.length(token) + F.pmod(-F.length(token), F.lit(4)), F.lit("="))
    return F.coalesce(F.try_to_binary(whole, F.lit("base64")).cast("string").rlike("^[\\x09\\x0A\\x0D\\x20-\\x7E]+$"), F.lit(False))


def discoveries(tokens: DataFrame, fdr: float, level: float, min_bits: float) -> DataFrame:
    """Those of ``tokens`` (with a column ``match``) that are reported as random."""
    tested = randomness(tokens, level=level).withColumns({"band": F.floor(F.log2(F.length("match"))).cast("int"), "step": F.floor("evidence").cast("int")})
    # At most a row for each alphabet, band and bit of evidence.
    fits = F.col("passes") & ~_holds_prose(F.col("match")) & (F.col("bits") >= min_bits)
    tested = tested.withColumn("step", F.when(fits, F.greatest(F.lit(0), F.least(F.lit(1000), F.col("step")))).otherwise(F.lit(0)))
    counts = tested.groupBy("alphabet", "band", "step").agg(F.count("*").alias("c"))
    stratum = Window.partitionBy("alphabet", "band")
    rank = F.sum("c").over(stratum.orderBy(F.desc("step")))
    above = (F.col("step") > 0) & (F.pow(F.lit(2.0), F.col("step")) * F.col("rank") * fdr >= F.col("m"))
    limits = counts.withColumns({"rank": rank, "m": F.sum("c").over(stratum)}).where(above).groupBy("alphabet", "band").agg(F.min("step").alias("limit"))
    return tested.join(F.broadcast(limits), ["alphabet", "band"]).where("step >= limit")


def scan(docs: DataFrame, fdr: float = 0.05, level: float = 1e-3, min_bits: float = 80.0, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """``rows`` (``rid``, ``doc_id``: an id for every input row; with ``keep`` also ``row``, the input) and ``spans`` (``rid, kind, start, end, match``)."""
    t = F.col("t")
    rows = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *rows)
    rows = ["row"] if keep else []
    hits = [_hits(t, i, pattern) for i, (_, pattern) in enumerate(PATTERNS)] + [_hits(t, len(PATTERNS), CANDIDATE)]
    # Written: one scan of the texts, and row ids that hold when a task runs again.
    found = written(base.select("rid", "doc_id", F.concat(*hits).alias("hits"), *rows), "secret-hits")
    each = found.where(F.size("hits") > 0).select("rid", F.explode("hits").alias("h")).select("rid", "h.*")
    before = Window.partitionBy("rid", "kind").orderBy("i")
    start = F.sum(F.col("gap") + F.col("len")).over(before) - F.col("len")
    placed = each.withColumn("start", start).withColumn("end", F.col("start") + F.col("len"))
    assigned = F.length(F.regexp_extract("match", PATTERNS[0][1], 2)) >= 8
    right = F.when(F.col("kind") == 0, assigned).when(F.col("kind") == 1, F.col("len") >= 16).when(F.col("kind") == 2, F.lit(True))
    token = (F.col("kind") == 3) & (F.col("match").rlike("[0-9]") | F.col("match").rlike("[a-z][A-Z]"))
    kept = placed.where(F.coalesce(right, token))
    # A token that a pattern covers in part is no news.
    is_base = F.col("kind") < 3
    order = Window.partitionBy("rid").orderBy("start", "kind")
    reach = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    next_ = F.min(F.when(is_base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = kept.withColumns({"reach": reach, "next": next_})
    free = F.coalesce(F.col("reach") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    spans = marked.where(is_base | free).select("rid", "kind", "start", "end", "match")
    random = discoveries(spans.where(F.col("kind") == 3), fdr, level, min_bits).select("rid", "kind", "start", "end", "match")
    return found.select("rid", "doc_id", *rows), spans.where(is_base).unionByName(random)


def without_secrets(docs: DataFrame, **options) -> DataFrame:
    """``docs`` less the rows in which a secret was found; decided by row, whatever the ids."""
    rows, spans = scan(docs, keep=True, **options)
    gone = written(spans.select("rid").distinct(), "secret-rows")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "rid", "left_anti").select("row.*")


def secret_digest(docs: DataFrame, **options) -> DataFrame:
    """Counts, digest and list of spans for every input row."""
    rows, spans = scan(docs, **options)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    item = F.struct("start", "kind", "end", F.concat_ws(":", name, "start", "end").alias("text"))
    listed = spans.groupBy("rid").agg(F.array_sort(F.collect_list(item)).alias("all"), *[F.count_if(F.col("kind") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)])
    texts = lambda only: F.array_join(F.transform(F.filter(F.coalesce("all", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,text:string>>")), only), lambda x: x["text"]), ",")
    return rows.join(listed, "rid", "left").select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(texts(lambda x: x["kind"] < 3), 256).alias("base_sha256"),
        texts(lambda x: F.lit(True)).alias("spans"),
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE: dict[str, str] = {}
