"""Passages that read like instructions to a model, and characters that people can't see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes in order, a line counts for the first that it matches. ``\b`` here means ASCII word bounds.
CLASSES = (
    ("drop_instructions", r"\b(ignore|disregard|forget|override)\b[^.\n]{0,40}\b(previous|prior|above|earlier|all|any|your)\b[^.\n]{0,30}\b(instructions?|prompts?|rules|guidelines|messages?)\b"),
    ("change_reader", r"\b(you are now|from now on,? you|new instructions:|act as (?:an? )?(?:system|admin|developer|jailbroken))\b"),
    ("control_text", r"\b(system prompt|developer message|<\|?(?:im_start|system|assistant)\|?>|\[/?INST\]|BEGIN (?:SYSTEM|INSTRUCTIONS))\b"),
    ("hide_from_user", r"\b(do not|don't|never)\s+(tell|inform|mention|reveal|show)\b[^.\n]{0,30}\b(user|human|operator)\b"),
    ("send_secrets", r"\b(send|post|upload|exfiltrate|leak|forward)\b[^.\n]{0,40}\b(api[ _-]?keys?|passwords?|credentials|secrets?|tokens?|private keys?|cookies)\b"),
    ("pipe_to_shell", r"\b(curl|wget)\b[^\n|]{0,120}\|\s*(sh|bash|zsh|python)\b"),
    ("carrying_image", r"!\[[^\]]*\]\(https?://[^)\s]+\?[^)\s]*(\{|%7B|data=|q=|secret|token)"),
)
# Fixed value: tag characters, zero-width and bidirectional controls, word joiners.
HIDDEN = "[\U000e0000-\U000e007f​-‏⁠-⁤‪-‮]"


def _ascii_bounds(pattern: str) -> str:
    """``\\b`` written out, since Java's takes accented letters for word characters."""
    edge = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return "(?i)" + pattern.replace("\\b", edge)


def injection_class(line: Column) -> Column:
    """Name of the first class that a line matches, else null."""
    return F.coalesce(*[F.when(line.rlike(_ascii_bounds(p)), F.lit(name)) for name, p in CLASSES])


def may_hold(text: Column) -> Column:
    """Whether a line of a text can match a class at all: the classes as one pattern without word bounds, which finds whatever they find."""
    return text.rlike("(?i)" + "|".join(f"(?:{p.replace(chr(92) + 'b', '')})" for _, p in CLASSES))


def flagged_lines(text: Column) -> Column:
    """Lines of a text that match a class; only a text that may hold one is cut into lines."""
    return F.when(may_hold(text), F.size(F.filter(F.split(text, "\n"), lambda x: injection_class(x).isNotNull()))).otherwise(0)


def hidden_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(HIDDEN)).cast("bigint")


def injection_flags(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per flagged line: id, line number, class, the trimmed line cut to 160 characters."""
    lines = texts.where(may_hold(F.col(text_col))).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    return lines.withColumn("why", injection_class(F.col("line"))).where("why IS NOT NULL").select(id_col, F.col("n").cast("bigint").alias("line_no"), "why", F.left(F.trim("line"), F.lit(160)).alias("shown"))
