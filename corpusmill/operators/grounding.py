"""Answers against their sources: quotes, word runs and numbers in context."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from corpusmill.functions.text import nfkc, normalised, sentences, strip_space, word_runs
from corpusmill.sources.tables import written

#: Characters of a passage by which a document is searched for it, and of all such keys that one scan holds.
KEY_CHARS = 40
SCAN_CHARS = 2_000_000
#: Shorter spans between quotation marks are no quotes.
LEAST_QUOTE = 12
# Links, and tokens of the form family:kind:id, in which neither digits nor words count.
LINKS = "[a-z]+:[a-z]+:\\S+|https?://\\S+"
# Words that give a number no context.
CONTEXT_STOP = (
    "the and for that with this from are was were been have has not but can will may must which their there these those into than then when what where who how all any each other such only "
    "also more most some very uses used using about over under between after before does"
).split()


def contained_passages(texts: DataFrame, text_id: str, passages: DataFrame, passage_id: str) -> DataFrame:
    """Pairs in which a passage's normalised text lies in a document's, wherever it starts and ends, and however short it is.

    Every document is searched once for the middle ``KEY_CHARS`` characters of all passages by one automaton; where a key is found, the document's characters around it are hashed and compared with the whole passage's 128 bits.
    So a task holds a key, a length, a place and a hash for each passage, whatever its length. Keys go to tasks in blocks of about ``SCAN_CHARS`` characters, each of which is a scan of the documents. Passages without a character, and null texts, match nothing.
    """
    spark = texts.sparkSession
    p = passages.select(F.col(passage_id).alias("p_id"), normalised(F.col("text")).alias("p")).where(F.length("p") > 0)
    before = F.greatest(F.lit(0), F.floor((F.length("p") - KEY_CHARS) / 2).cast("int"))
    p = written(p.mapInArrow(_named, f"p_id {dict(passages.dtypes)[passage_id]}, p string, name binary").select("p_id", F.substring("p", before + 1, F.lit(KEY_CHARS)).alias("key"), before.alias("before"), F.length("p").alias("chars"), "name"), "passages")
    chars = p.agg(F.coalesce(F.sum(F.length("key")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // SCAN_CHARS))
    d = texts.select(F.col(text_id).alias("t_id"), normalised(F.col("text")).alias("d"))
    schema = f"t_id {dict(texts.dtypes)[text_id]}, p_id {dict(passages.dtypes)[passage_id]}"
    out = None
    for block in range(blocks):
        rows = p.where(F.pmod(F.xxhash64("key", "p_id"), F.lit(blocks)) == block).toArrow()
        by_key: dict[str, list] = {}
        for k, *held in zip(*[rows[c].to_pylist() for c in ("key", "p_id", "before", "chars", "name")]):
            by_key.setdefault(k, []).append(tuple(held))
        found = d.mapInArrow(_finder(spark.sparkContext.broadcast(by_key)), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("t_id").alias(text_id), F.col("p_id").alias(passage_id))


def _named(batches):
    for batch in batches:
        yield batch.append_column("name", pa.array([xxh3_128_digest(x.encode()) for x in batch.column("p").to_pylist()], pa.binary()))


def _finder(shared):
    """A task that finds passages by their keys."""

    def run(batches):
        import ahocorasick

        keys = ahocorasick.Automaton()
        for k, held in shared.value.items():
            keys.add_word(k, (len(k), held))
        if len(keys):
            keys.make_automaton()
        for batch in batches:
            at, ids = [], []
            for row, text in enumerate(batch.column("d").to_pylist()):
                mine: dict = {}
                for end, (length, held) in keys.iter(text) if text and len(keys) else ():
                    for number, (p_id, before, chars, name) in enumerate(held):
                        start = end + 1 - length - before
                        if start >= 0 and start + chars <= len(text) and (id(held), number) not in mine and xxh3_128_digest(text[start : start + chars].encode()) == name:
                            mine[id(held), number] = p_id
                at += [row] * len(mine)
                ids += mine.values()
            if at:
                yield pa.RecordBatch.from_arrays([batch.column("t_id").take(pa.array(at, pa.int64())), pa.array(ids)], names=["t_id", "p_id"])

    return run


def quoted_lines(answer):
    """Of each line with quotes its outermost span (null unless there are more than two marks and 12 characters between), the spans between pairs of marks, and its text if it is a block quote.

    Spans are trimmed; shorter ones than 12 characters are none.
    """
    mark = "[\"“”]"
    long = lambda x: F.length(x) >= LEAST_QUOTE

    def of(line):
        parts = F.split(line, mark)
        # Between the marks 1 and 2, 3 and 4 and so on; a last mark without a partner opens nothing.
        inner = F.filter(F.transform(parts, lambda p, i: F.when((i % 2 == 1) & (i < F.size(parts) - 1), strip_space(p))), lambda x: F.coalesce(long(x), F.lit(False)))
        outer = strip_space(F.regexp_extract(line, f"(?s){mark}(.*){mark}", 1))
        block = F.regexp_extract(line, f"^>\\s?(.{{{LEAST_QUOTE},}})$", 1)
        return F.struct(F.when((F.size(parts) > 3) & long(outer), outer).alias("outer"), inner.alias("pairs"), F.when(block != "", strip_space(block)).alias("block"))

    return F.filter(F.transform(F.split(answer, "\n"), of), lambda x: x["outer"].isNotNull() | (F.size(x["pairs"]) > 0) | x["block"].isNotNull())


def quotes(answers: DataFrame, answer_id: list[str], sources: DataFrame, by: list[str]) -> DataFrame:
    """``answer_id``, ``quote``, ``found``: the distinct quotes of every answer (``answer_id``, ``by``, ``text``) and whether a source of the same ``by`` holds their parts in order.

    A line's outermost span is its quote if a source holds it; else the spans between its pairs of marks are. Every span is looked for once in every source of its key.
    """
    names = list(dict.fromkeys([*answer_id, *by]))
    lines = written(answers.select(*names, F.posexplode(quoted_lines(F.coalesce("text", F.lit("")))).alias("line", "q")), "quote-lines")
    spans = lines.select(*by, F.explode(F.array_compact(F.concat(F.array("q.outer", "q.block"), "q.pairs"))).alias("quote")).distinct()
    texts = sources.select(*[F.col(c).alias(f"of_{c}") for c in by], normalised(nfkc(F.coalesce("text", F.lit("")))).alias("source"))
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    held = spans.withColumn("plain", nfkc(F.col("quote"))).join(texts, same).where(quote_found(F.col("source"), F.col("plain"))).select(*by, "quote").distinct()
    held = written(held.select(*[F.col(c).alias(f"of_{c}") for c in by], F.col("quote").alias("held")), "quotes-held")
    said = lines.join(held, same & (F.col("q.outer") == F.col("held")), "left").select(*names, F.when(F.col("held").isNotNull(), F.array("held")).otherwise(F.col("q.pairs")).alias("spans"), "q.block")
    each = said.select(*names, F.explode(F.array_compact(F.concat("spans", F.array("block")))).alias("quote")).distinct()
    return each.join(held, same & (F.col("quote") == F.col("held")), "left").select(*answer_id, "quote", F.col("held").isNotNull().alias("found"))


def verdicts(answers: DataFrame, answer_id: list[str], sources: DataFrame, by: list[str], traced: float = 0.6, weak: float = 0.3) -> DataFrame:
    """A row for every answer: how many of its quotes, sentences and numbers its sources (the texts of the same ``by``) hold.

    A sentence of six words and more is traced if ``traced`` of its three-word runs are in a source, weak below ``weak``; a number needs its value at the answer's precision next to words of its sentence.
    Defined: answers without a source are held by nothing; null texts are empty; rows that repeat an answer's id are one answer.
    """
    normal = answers.select(F.struct(*answer_id).alias("a"), *by, F.coalesce("text", F.lit("")).alias("text"))
    texts = sources.select(*by, F.coalesce("text", F.lit("")).alias("text"))
    quoted = quotes(answers, answer_id, sources, by).groupBy(F.struct(*answer_id).alias("a")).agg(F.count("*").alias("quotes"), F.count_if("found").alias("quotes_found"))
    grams = texts.select(*by, nfkc(F.col("text")).alias("text")).select(*by, F.explode(word_runs(F.col("text"))).alias("g")).distinct().withColumn("hit", F.lit(1))
    said = normal.select("a", *by, F.posexplode(sentences(F.col("text"))).alias("n", "sentence")).where(F.size(F.split("sentence", "\\s+")) >= 6)
    scored = said.withColumn("sentence", nfkc(F.col("sentence"))).select("a", *by, "n", F.explode_outer(word_runs(F.col("sentence"))).alias("g")).join(grams, [*by, "g"], "left").groupBy("a", "n").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("score"))
    trace = scored.groupBy("a").agg(F.count("*").alias("sentences"), F.count_if(F.col("score") >= traced).alias("traced"), F.count_if(F.col("score") < weak).alias("weak"))
    held = numbers_held(normal, "a", texts, by).groupBy("a").agg(F.count("*").alias("numbers"), F.count_if("held").alias("numbers_held"))
    out = normal.select("a").distinct()
    for part in (quoted, trace, held):
        out = out.join(part, "a", "left")
    counts = ["quotes", "quotes_found", "sentences", "traced", "weak", "numbers", "numbers_held"]
    out = out.select("a.*", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts])
    of = lambda a, b, text: F.when(F.col(b) > 0, F.concat(F.col(a).cast("string"), F.lit(" of "), F.col(b).cast("string"), F.lit(text)))
    summary = F.concat_ws("; ", F.coalesce(of("quotes_found", "quotes", " quotes found"), F.lit("no quotes")), of("traced", "sentences", " sentences traced"), of("numbers_held", "numbers", " numbers in context"))
    return out.withColumn("summary", summary)


def quote_found(source, quote):
    """Whether the parts of a quote (cut at an ellipsis, parts of 4 and more characters) occur in order in normalised ``source``."""
    parts = F.filter(F.split(normalised(quote), "\\s*(?:\\.\\.\\.|…)\\s*"), lambda x: F.length(x) >= 4)
    end = F.aggregate(parts, F.lit(1), lambda at, p: F.when(at == 0, 0).otherwise(_after(p, source, at)))
    return end > 0


def _after(part, source, at):
    rest = F.substring(source, at, F.length(source))
    place = F.instr(rest, part)
    return F.when(place == 0, 0).otherwise(at + place - 1 + F.length(part))


def trigram_trace(answers: DataFrame, answer_id: str, sources: DataFrame, least_words: int = 6) -> DataFrame:
    """Sentences of at least ``least_words`` words with the share of their three-word runs that occur in any source."""
    grams = sources.select(F.explode(word_runs(F.coalesce("text", F.lit("")))).alias("g")).distinct().withColumn("hit", F.lit(1))
    said = answers.select(answer_id, F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("n", "sentence")).where(F.size(F.split("sentence", "\\s+")) >= least_words)
    each = said.select(answer_id, "n", F.explode_outer(word_runs(F.col("sentence"))).alias("g"))
    return each.join(grams, "g", "left").groupBy(answer_id, "n").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("score"))


def numbers(texts: DataFrame, *keys: str) -> DataFrame:
    """Distinct numbers of two and more digits per sentence, with value and decimals; digits in links and tokens don't count."""
    plain = F.regexp_replace("sentence", LINKS, " ")
    found = F.transform(F.regexp_extract_all(plain, F.lit("[0-9][0-9,]*(?:\\.[0-9]+)?"), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")))
    kept = F.array_distinct(F.filter(found, lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")) > 1))
    said = texts.select(*keys, F.posexplode(sentences(F.coalesce("text", F.lit("")))).alias("n", "sentence"))
    each = said.select(*keys, F.col("n").cast("bigint").alias("n"), "sentence", F.explode(kept).alias("number"))
    return each.withColumns({"value": F.col("number").cast("double"), "decimals": F.length(F.regexp_extract("number", "\\.([0-9]+)$", 1))})


def context_words(sentence):
    """Distinct content words of a sentence."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(normalised(sentence), F.lit("[a-z][a-z-]{3,}"), F.lit(0))), F.array(*map(F.lit, CONTEXT_STOP)))


def numbers_held(answers: DataFrame, answer_id: str, sources: DataFrame, by: list[str], window: int = 250, source_id: str | None = None) -> DataFrame:
    """``held`` of each number of an answer: a source with the same ``by`` has it to the answer's last decimal, with enough of the sentence's words within ``window`` characters.

    ``source_id`` names a column of ``sources``; a source whose id is the answer's doesn't count. The context of a number reaches ``window`` characters back from where it starts and as many on,
    past other numbers. Values meet by ``by`` and in buckets of whole numbers, the neighbours included, so the range condition is an equality join first; sources that say the same in the same words count once.
    """
    names = [f"by_{i}" for i in range(len(by))]
    keys = [F.col(f"`{c}`").alias(n) for c, n in zip(by, names)]
    given = numbers(answers.select(F.col(answer_id).alias("a_id"), *keys, "text"), "a_id", *names)
    given = given.withColumns({"ctx": context_words(nfkc(F.regexp_replace("sentence", LINKS, " "))), "tol": F.pow(F.lit(10.0), -F.col("decimals")) * 0.5}).drop("sentence")
    # Values beyond 64 bits all have the last bucket; it has no next one.
    given = given.withColumn("bucket", F.explode(F.array(*[F.try_add(F.floor("value"), F.lit(i)) for i in (-1, 0, 1)])))
    text = F.regexp_replace(normalised(nfkc(F.coalesce("text", F.lit("")))), "([0-9]),([0-9])", "$1$2")
    # Where a digit stands: what is before it (all of it, or the last characters), what starts with it, and the number itself.
    pattern = F.lit(f"(?s)(?=[0-9])(?<=(^.{{0,{window - 1}}}|.{{{window}}}))(?=(.{{0,{window}}}))([0-9]+(?:\\.[0-9]+)?)")
    part = lambda i: F.regexp_extract_all("t", pattern, F.lit(i))
    src = sources.select(*keys, (F.col(source_id) if source_id else F.lit(None).cast("bigint")).alias("s_id"), text.alias("t")).where(F.col("t").rlike("[0-9]"))
    hits = src.select(*names, "s_id", F.explode(F.arrays_zip(part(1).alias("before"), part(2).alias("on"), part(3).alias("m"))).alias("z"))
    near = hits.select(*names, "s_id", F.col("z.m").cast("double").alias("m"), F.concat("z.before", "z.on").alias("near")).distinct().withColumn("bucket", F.floor("m"))
    pairs = given.join(near, [*names, "bucket"], "left")
    need = F.when(F.size("ctx") < 3, 1).otherwise(2)
    other = F.coalesce(F.col("s_id") != F.col("a_id"), F.lit(True)) if source_id else F.lit(True)
    ok = other & (F.abs(F.col("m") - F.col("value")) <= F.col("tol")) & (F.size(F.filter("ctx", lambda w: F.contains(F.col("near"), w))) >= need)
    held = pairs.groupBy("a_id", "n", "number").agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("held"))
    return held.select(F.col("a_id").alias(answer_id), "n", "number", "held")
