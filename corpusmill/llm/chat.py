"""Preference formatting of chosen and rejected conversations. DataFrame functions only.

The turns of the two sides of a pair are joined on (pair, turn): a turn is part of the prompt if all turns up to it are equal, which is one
minimum over the turns that differ. The prompt is rendered once; each side's other turns are its completion.

``preference_segments`` has a row for each rendered turn: ``pair_id, side`` (``prompt``, ``chosen``, ``rejected``), ``turn``, ``role``, ``segment`` (rendered text) and
``trained`` (the mask: true for the assistant's turns of a completion). ``preference_records`` pairs them: ``pair_id, part, prompt, chosen, rejected`` (texts) with
``chosen_trained`` and ``rejected_trained``, the code points of each completion that are trained (``start:end``, ends exclusive, comma-joined). A pair is one record;
only a pair of more than ``RECORD_CHARS`` goes on in further parts, cut between turns, whose texts follow one another, so that a pair that holds a third of all turns is never gathered in one row.

Defined results: a null role is ``user``, a null text is empty; rows with a null pair or turn are left out; of rows that repeat a pair and turn the
one with the least (role, text) counts; a pair that lacks one side, or whose sides are equal, has no rows; an empty table gives an empty
result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import table

ANSWERS = "assistant"
#: Rendered characters before a turn from which it belongs to a further part of its pair's record.
RECORD_CHARS = 1 << 20


def render(role: Column, text: Column) -> Column:
    """One turn in the chat format."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def turns_of(df: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair_id, turn, m`` with one message (role, text) a turn."""
    message = F.struct(F.coalesce(F.col(role), F.lit("user")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = df.where(F.col(pair).isNotNull() & F.col(turn).isNotNull())
    return rows.groupBy(F.col(pair).cast("bigint").alias("pair_id"), F.col(turn).cast("bigint").alias("turn")).agg(F.min(message).alias("m"))


def preference_segments(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of rendered turns for pairs of ``chosen`` and ``rejected`` (both as of ``turns_of``)."""
    both = chosen.select("pair_id", "turn", F.col("m").alias("c")).join(rejected.select("pair_id", "turn", F.col("m").alias("r")), ["pair_id", "turn"], "full_outer")
    differs = ~F.col("c").eqNullSafe(F.col("r"))
    cut = both.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("cut"), F.count("c").alias("nc"), F.count("r").alias("nr")).where("cut IS NOT NULL AND nc > 0 AND nr > 0")
    placed = both.join(cut.select("pair_id", "cut"), "pair_id")
    side = lambda name, m: F.struct(F.lit(name).alias("side"), F.col(m).alias("m"))
    sides = F.when(F.col("turn") < F.col("cut"), F.array(side("prompt", "c"))).otherwise(F.array(side("chosen", "c"), side("rejected", "r")))
    rows = placed.select("pair_id", "turn", F.explode(sides).alias("s")).where("s.m IS NOT NULL").select("pair_id", "turn", "s.side", "s.m.role", "s.m.text")
    return rows.select("pair_id", "side", "turn", "role", render(F.col("role"), F.col("text")).alias("segment"), ((F.col("role") == ANSWERS) & (F.col("side") != "prompt")).alias("trained"))


def preference_records(segments: DataFrame, record_chars: int = RECORD_CHARS) -> DataFrame:
    """``segments`` (as of ``preference_segments``) as paired, masked records."""
    # The prompt comes first, then both completions side by side; what was rendered before a turn tells its part.
    in_pair = Window.partitionBy("pair_id").orderBy("turn", "side").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("segment")
    dealt = segments.withColumn("part", F.floor(F.coalesce(F.sum(size).over(in_pair), F.lit(0)) / record_chars).cast("bigint"))
    turn = F.struct("turn", "segment", "trained")
    sides = dealt.groupBy("pair_id", "part").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(s) for s in ("prompt", "chosen", "rejected")])
    text = lambda s: F.array_join(F.transform(s, lambda x: x["segment"]), "")

    def spans(s):
        """Limits of the trained turns in the joined text."""
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        add = lambda a, x: F.struct(
            (a["at"] + F.length(x["segment"])).alias("at"),
            F.when(x["trained"], F.concat(a["out"], F.array(F.concat_ws(":", a["at"], a["at"] + F.length(x["segment"]))))).otherwise(a["out"]).alias("out"),
        )
        return F.array_join(F.aggregate(s, start, add)["out"], ",")

    return sides.select("pair_id", "part", *[text(s).alias(s) for s in ("prompt", "chosen", "rejected")], *[spans(s).alias(f"{s}_trained") for s in ("chosen", "rejected")])


def bucket_of(pair_id: Column, buckets: int) -> Column:
    """A multiplicative hash that SQL can write as well."""
    return F.pmod(F.pmod(F.pmod(pair_id, F.lit(2147483647)) * 48271, F.lit(2147483647)), F.lit(buckets))


def swapped_answers(turns: DataFrame, bucket_size: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations.

    The chosen side is a conversation up to its last answer; the rejected one parts from it at one of its answers, picked by the conversation's id, ends there, and has the next different last answer among the
    conversations of the same hash bucket in its place. So no order over all conversations is needed. Without an answer, or where a bucket has only one, there is no pair.
    """
    answers = turns.where(F.col("m.role") == ANSWERS)
    last = answers.groupBy("pair_id").agg(F.max_by("m", "turn").alias("m"), F.max("turn").alias("last"), F.count("*").alias("n"))
    buckets = max(1, -(-last.count() // bucket_size))
    placed = last.withColumn("bucket", bucket_of(F.col("pair_id"), buckets))
    # The distinct answers of a bucket in a ring.
    ring = Window.partitionBy("bucket").orderBy("m")
    least = F.min("m").over(Window.partitionBy("bucket"))
    nexts = placed.select("bucket", "m").distinct().select("bucket", "m", F.coalesce(F.lead("m").over(ring), least).alias("other"))
    nth = answers.select("pair_id", "turn", "m", F.row_number().over(Window.partitionBy("pair_id").orderBy("turn")).alias("k"))
    given = placed.join(nexts, ["bucket", "m"]).select("pair_id", "last", "other", (F.pmod(F.col("pair_id"), F.col("n")) + 1).alias("k"))
    given = given.join(nth, ["pair_id", "k"]).where(~F.col("m").eqNullSafe(F.col("other"))).select("pair_id", "last", F.col("turn").alias("swap"), "other")
    both = turns.join(given, "pair_id").where("turn <= last")
    rejected = both.where("turn <= swap").select("pair_id", "turn", F.when(F.col("turn") == F.col("swap"), F.col("other")).otherwise(F.col("m")).alias("m"))
    return both.select("pair_id", "turn", "m"), rejected


def op5_preference_format(spark, sf_dir: str) -> DataFrame:
    return preference_records(preference_segments(*swapped_answers(turns_of(table(spark, sf_dir, "conversations"), "conv_id"))))


OP5_SQL = """
WITH t AS (SELECT conv_id AS pair_id, turn, min({'role': coalesce(role, 'user'), 'text': coalesce(text, '')}) AS m FROM conversations
           WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
a AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn) AS k FROM t WHERE m.role = 'assistant'),
l AS (SELECT pair_id, arg_max(m, turn) AS m, max(turn) AS last, count(*) AS n FROM a GROUP BY pair_id),
h AS (SELECT *, ((pair_id % 2147483647) * 48271 % 2147483647) % greatest(1, (SELECT (count(*) + 999) // 1000 FROM l)) AS bucket FROM l),
r AS (SELECT bucket, m, coalesce(lead(m) OVER (PARTITION BY bucket ORDER BY m), min(m) OVER (PARTITION BY bucket)) AS other FROM (SELECT DISTINCT bucket, m FROM h)),
g AS (SELECT h.pair_id, last, a.turn AS swap, other FROM h JOIN r ON r.bucket = h.bucket AND r.m = h.m JOIN a ON a.pair_id = h.pair_id AND a.k = h.pair_id % n + 1 WHERE a.m IS DISTINCT FROM other),
c AS (SELECT t.pair_id, t.turn, t.m AS c, CASE WHEN turn < swap THEN t.m WHEN turn = swap THEN other END AS r, swap FROM t JOIN g USING (pair_id) WHERE turn <= last),
s AS (SELECT pair_id, 'prompt' AS side, turn, c AS m FROM c WHERE turn < swap
      UNION ALL SELECT pair_id, 'chosen', turn, c FROM c WHERE turn >= swap
      UNION ALL SELECT pair_id, 'rejected', turn, r FROM c WHERE turn = swap),
x AS (SELECT *, '<|' || m.role || '|>' || chr(10) || m.text || chr(10) || '<|end|>' || chr(10) AS segment FROM s),
p AS (SELECT *, coalesce(sum(len(segment)) OVER (PARTITION BY pair_id ORDER BY turn, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // 1048576 AS part FROM x),
o AS (SELECT *, coalesce(sum(len(segment)) OVER (PARTITION BY pair_id, part, side ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM p)
SELECT pair_id, part, coalesce(string_agg(segment, '' ORDER BY turn) FILTER (side = 'prompt'), '') AS prompt,
       coalesce(string_agg(segment, '' ORDER BY turn) FILTER (side = 'chosen'), '') AS chosen, coalesce(string_agg(segment, '' ORDER BY turn) FILTER (side = 'rejected'), '') AS rejected,
       coalesce(string_agg(pos || ':' || (pos + len(segment)), ',' ORDER BY turn) FILTER (side = 'chosen' AND m.role = 'assistant'), '') AS chosen_trained,
       coalesce(string_agg(pos || ':' || (pos + len(segment)), ',' ORDER BY turn) FILTER (side = 'rejected' AND m.role = 'assistant'), '') AS rejected_trained
FROM o GROUP BY pair_id, part
"""

QUERIES = {"op5_preference_format": op5_preference_format}
ORACLE = {"op5_preference_format": OP5_SQL}
