"""Documents to lines, blocks and size-bounded sections, and what is said about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clean_title, heading, let, numbered_depth, one_line, strip_space, tidy
from corpusmill.sources.tables import written

# Words that are never distinctive.
STOP_WORDS = (
    "the and for that with this from are was were been being have has had not but can could will would may might must shall should which their there these those into than then when what where "
    "who whom how all any each other such only also more most some very use used using one two its our your you they them his her him she about over under between both after before same "
    "own out off per via does did done here just like make made many much new now see set way well yes get got let put say said see"
).split()
EDGE_LINES = 2


def lines_of(docs: DataFrame, text: Column, *keep: str) -> DataFrame:
    """A row per line with its number ``n`` (from 0)."""
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def blocks(docs: DataFrame) -> DataFrame:
    """Lines with running ``block_no``: a heading outside a code fence starts a block; a fence line is never a heading."""
    lines = lines_of(docs, tidy(F.col("text")), "doc_id")
    by_doc = Window.partitionBy("doc_id").orderBy("n")
    is_fence = F.col("line").rlike("^\\s*(```|~~~)")
    fenced = F.pmod(F.sum(is_fence.cast("int")).over(by_doc), F.lit(2)) == 1
    before = F.coalesce(F.lag("line").over(by_doc), F.lit(""))
    atx = F.col("line").rlike("^#{1,6}\\s+\\S")
    depth = F.when(atx, F.length(F.regexp_extract("line", "^(#{1,6})", 1)).cast("bigint")).when((one_line(before) == "") & ~F.col("line").rlike("^\\s"), numbered_depth(F.col("line"))).otherwise(F.lit(0))
    marked = lines.withColumns({"fenced": fenced | is_fence, "depth": depth})
    marked = marked.withColumn("depth", F.when(F.col("fenced"), F.lit(0).cast("bigint")).otherwise(F.col("depth")))
    return marked.withColumn("block_no", F.sum((F.col("depth") > 0).cast("int")).over(by_doc).cast("bigint"))


def pack(pieces: Column, limit: int) -> Column:
    """Greedy packing of an ordered array of strings into sections of at most ``limit`` characters; joined, they are the input.

    A piece longer than ``limit`` is cut into hard slices first.
    """
    sliced = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(p) - 1) / limit)).cast("int")), lambda i: F.substring(p, i * limit + 1, F.lit(limit)))))
    none = F.array().cast("array<int>")

    def starts(all_: Column) -> Column:
        """Places of the pieces that open a section."""
        begin = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), none.alias("at"))

        def add(a: Column, p: Column) -> Column:
            new = (a["open"] == 0) | (a["open"] + F.length(p) > limit)
            return F.struct(F.when(new, F.length(p)).otherwise(a["open"] + F.length(p)).alias("open"), (a["i"] + 1).alias("i"), F.when(new, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

        return F.aggregate(all_, begin, add)["at"]

    joined = lambda all_, at: F.transform(at, lambda s, k: F.array_join(F.slice(all_, s + 1, F.coalesce(F.get(at, k + 1), F.size(all_)) - s), ""))
    return let(sliced, lambda all_: let(starts(all_), lambda at: joined(all_, at)))


def line_pieces(text: Column) -> Column:
    """Lines with their line ends."""
    return F.filter(F.split(text, "(?<=\n)"), lambda x: x != "")


def sections(docs: DataFrame, limit: int = 2_000) -> DataFrame:
    """``doc_id, section_no, section`` of every document, packed from its lines."""
    packed = docs.select("doc_id", pack(line_pieces(tidy(F.coalesce("text", F.lit("")))), limit).alias("s"))
    return packed.select("doc_id", F.posexplode("s").alias("section_no", "section"))


_FENCE = "^\\s*(```|~~~)"
_ATX = "^(#{1,6})\\s+(.+?)\\s*#*\\s*$"
_BLOCK = "struct<title:string,depth:int,text:string>"


def underlined(lines: Column) -> Column:
    """Lines in which titles with an underline of = or - have become marked headings; not in fences, lists, quotes, tables or leading front matter."""

    def first(lines: Column) -> Column:
        """Number of lines of leading front matter, 0 without."""
        closing = F.array_position(F.slice(F.transform(lines, lambda x: x.rlike("^---\\s*$")), 2, F.greatest(F.lit(1), F.size(lines))), True)
        return F.when(F.get(lines, F.lit(0)).rlike("^---\\s*$") & (closing > 0), closing).otherwise(F.lit(0)).cast("int")

    def hits(lines: Column, first: Column) -> Column:
        begin = F.struct(F.lit(0).alias("i"), F.lit(False).alias("fence"), F.lit("").alias("before"), F.array().cast("array<int>").alias("at"))

        def add(a: Column, x: Column) -> Column:
            # The fence state and the line before; lines of the front matter count for neither.
            fence = F.when((a["i"] > first) & a["before"].rlike(_FENCE), ~a["fence"]).otherwise(a["fence"])
            plain = (F.trim(a["before"]) != "") & ~a["before"].rlike(_ATX) & ~a["before"].rlike("^\\s*([-*+>|]|[0-9]+\\.)\\s") & ~a["before"].rlike("^\\s")
            hit = (a["i"] > first) & x.rlike("^(=+|-{3,})\\s*$") & ~fence & plain
            return let(hit, lambda h: F.struct((a["i"] + 1).alias("i"), fence.alias("fence"), F.when(h, F.lit("")).otherwise(x).alias("before"), F.when(h, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at")))

        return F.aggregate(lines, begin, add)["at"]

    def changed(lines: Column, at: Column) -> Column:
        mark = lambda i: F.when(F.get(lines, i + 1).startswith("="), F.lit("# ")).otherwise(F.lit("## "))
        return F.transform(lines, lambda x, i: F.when(F.array_contains(at, i), F.lit("")).when(F.array_contains(at, i + 1), F.concat(mark(i), F.trim(x))).otherwise(x))

    # Named once: inside a lambda, the split of the whole text would be made again for each line.
    return let(lines, lambda lines: let(first(lines), lambda first: let(hits(lines, first), lambda at: F.when(F.size(at) > 0, changed(lines, at)).otherwise(lines))))


# Marks that underline a title, with the depth they give it.
UNDERLINES = (("=", 1), ("#", 1), ("-", 2), ("~", 3), ("^", 3), ("*", 3))


def text_markdown(text: Column) -> Column:
    """Plain text with its headings marked: lines underlined by three and more of a mark, as long as the line give or take three characters, and numbered headings after an empty line.

    A heading stands between line ends; its underline goes. A line that begins with white space is no title, and an underline that was one belongs to no other line.
    """
    under_depth = lambda x: F.coalesce(*[F.when(x.rlike(f"^\\{mark}{{3,}}\\s*$"), F.lit(depth)) for mark, depth in UNDERLINES], F.lit(0))

    def mark_up(lines: Column) -> Column:
        begin = F.struct(F.lit(0).alias("i"), F.lit(False).alias("skip"), F.array().cast("array<string>").alias("out"))

        def add(a: Column, x: Column) -> Column:
            following = F.coalesce(F.get(lines, a["i"] + 1), F.lit(""))
            open_ = (F.trim(x) != "") & ~x.rlike("^\\s")
            under = F.when(open_ & (F.abs(F.length(strip_space(following)) - F.length(strip_space(x))) <= 3), under_depth(following)).otherwise(0)
            first = (a["i"] == 0) | (strip_space(F.coalesce(F.get(lines, a["i"] - 1), F.lit(""))) == "")
            depth = F.when(under > 0, under).when(first & ~x.rlike("^\\s"), numbered_depth(x)).otherwise(0)
            line = F.when(depth > 0, heading(depth, x)).otherwise(x)
            return F.when(a["skip"], F.struct((a["i"] + 1).alias("i"), F.lit(False).alias("skip"), a["out"].alias("out"))).otherwise(F.struct((a["i"] + 1).alias("i"), (under > 0).alias("skip"), F.concat(a["out"], F.array(line)).alias("out")))

        return F.aggregate(lines, begin, add)["out"]

    return let(F.split(tidy(text), "\n"), lambda lines: F.array_join(mark_up(lines), "\n"))


# What defines a name in common programming languages, at the start of a line.
SYMBOLS = (
    "^\\s*(?:export\\s+)?(?:default\\s+)?(?:pub(?:\\([^)]*\\))?\\s+)?(?:async\\s+)?(?:function\\*?|class|def|fn|func|interface|type|struct|enum|trait|module|object)\\s+([A-Za-z_$][A-Za-z0-9_$]*)",
    "^\\s*(?:export\\s+)?(?:const|let|var)\\s+([A-Za-z_$][A-Za-z0-9_$]*)\\s*=\\s*(?:async\\s*)?(?:function|\\([^)]*\\)\\s*=>|[A-Za-z0-9_$]+\\s*=>)",
    "^([A-Za-z_$][A-Za-z0-9_$]*(?:\\.[A-Za-z0-9_$]+)+)\\s*=\\s*(?:async\\s+)?function",
)


def symbols(code: Column, most: int = 10) -> Column:
    """The first ``most`` different names that a piece of code defines."""
    # The first of the patterns that a line follows names it.
    name = lambda x: F.coalesce(*[F.when(x.rlike(p), F.regexp_extract(x, p, 1)) for p in SYMBOLS])
    return F.slice(F.array_distinct(F.array_compact(F.transform(F.split(code, "\n"), name))), 1, most)


def heading_blocks(md: Column, root: Column) -> Column:
    """Blocks (title, depth, text) of a text, from heading to heading; a heading in a fence is text. What stands before the first is a block named ``root``, or goes to the first if it is blank."""
    begin = F.struct(F.lit(0).alias("i"), F.lit(False).alias("fence"), F.array().cast("array<int>").alias("at"))

    def add(a: Column, x: Column) -> Column:
        fence = F.when(x.rlike(_FENCE), ~a["fence"]).otherwise(a["fence"])
        return F.struct((a["i"] + 1).alias("i"), fence.alias("fence"), F.when(~fence & x.rlike(_ATX), F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    text = lambda lines, a, b: F.concat(F.array_join(F.slice(lines, a + 1, b - a), "\n"), F.lit("\n"))
    real = lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "\\[page [0-9]+\\]", ""), "\\s+", " ")) != ""

    def cut(lines: Column, at: Column, lead: Column, kept: Column) -> Column:
        first = F.when(kept, F.array(F.struct(root.alias("title"), F.lit(0).alias("depth"), lead.alias("text")))).otherwise(F.array().cast(f"array<{_BLOCK}>"))

        def block(i: Column, k: Column) -> Column:
            title = let(clean_title(F.regexp_extract(F.get(lines, i), _ATX, 2)), lambda t: F.when(t != "", t).otherwise(root))
            start = F.when((k == 0) & ~kept, F.lit(0)).otherwise(i)
            return F.struct(title.alias("title"), F.length(F.regexp_extract(F.get(lines, i), _ATX, 1)).alias("depth"), text(lines, start, F.coalesce(F.get(at, k + 1), F.size(lines))).alias("text"))

        return F.concat(first, F.transform(at, block))

    def from_lead(lines: Column, at: Column) -> Column:
        head = F.coalesce(F.get(at, F.lit(0)), F.size(lines))
        return let(text(lines, F.lit(0), head), lambda lead: let((head > 0) & real(lead), lambda kept: cut(lines, at, lead, kept)))

    return let(underlined(F.split(md, "\n")), lambda lines: let(F.aggregate(lines, begin, add)["at"], lambda at: from_lead(lines, at)))


def chopped(block: Column, limit: int) -> Column:
    """A block as parts of at most ``limit`` characters: paragraphs are packed, one above the limit is cut; parts are numbered in the title."""
    paragraphs = F.filter(F.split(block["text"], "(?<=\n\n)"), lambda x: x != "")
    parts = pack(paragraphs, limit)
    label = lambda i, n: F.concat(block["title"], F.lit(" (part "), (i + 1).cast("string"), F.lit(" of "), n.cast("string"), F.lit(")"))
    named = let(parts, lambda p: F.transform(p, lambda x, i: F.struct(label(i, F.size(p)).alias("title"), block["depth"].alias("depth"), x.alias("text"))))
    return F.when(F.length(block["text"]) > limit, named).otherwise(F.array(block))


def heading_sections(md: Column, root: Column, limit: int) -> Column:
    """Sections of a text, arrays of blocks: packed in order, with a new one where the limit would be passed, or before a heading of depth 1 once half of it is filled."""
    begin = F.struct(F.lit(0).alias("open"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("at"))

    def add(a: Column, b: Column) -> Column:
        size = F.length(b["text"])
        new = (a["open"] == 0) | (a["open"] + size > limit) | ((a["open"] > limit * 0.5) & (b["depth"] == 1))
        return F.struct(F.when(new, size).otherwise(a["open"] + size).alias("open"), (a["i"] + 1).alias("i"), F.when(new, F.concat(a["at"], F.array(a["i"]))).otherwise(a["at"]).alias("at"))

    pieces = F.flatten(F.transform(heading_blocks(md, root), lambda b: chopped(b, limit)))
    grouped = lambda p, at: F.transform(at, lambda s, k: F.slice(p, s + 1, F.coalesce(F.get(at, k + 1), F.size(p)) - s))
    return let(pieces, lambda p: let(F.aggregate(p, begin, add)["at"], lambda at: grouped(p, at)))


def described(sections_: Column, total: int) -> Column:
    """``title, covers, text`` of every section of one text: the first block's title, and those of the others as far as a budget goes.

    A section of one block tells how it begins. If all lists are longer than ``total`` together, each gets its share of that, 300 at least, and ends in how many more there are.
    """
    titles = lambda s: F.transform(F.slice(s, 2, F.greatest(F.lit(1), F.size(s))), lambda b: b["title"])
    used = lambda s: F.length(F.array_join(titles(s), "; "))

    def begins(s: Column) -> Column:
        headless = lambda t: F.concat(*[F.regexp_extract(t, "(?s)^(.*?)(?m:^#+\\s[^\\n]*$)(.*)$", k) for k in (1, 2)])
        plain = let(F.regexp_replace(F.get(s, F.lit(0))["text"], "\\[page [0-9]+\\]", ""), lambda t: F.when(t.rlike("(?m)^#+\\s[^\\n]*$"), headless(t)).otherwise(t))
        return let(F.left(one_line(plain), F.lit(110)), lambda b: F.when(b != "", F.concat(F.lit('begins "'), b, F.when(F.length(b) >= 110, "…").otherwise(""), F.lit('"'))).otherwise(""))

    def listed(s: Column, budget: Column) -> Column:
        """Titles while they fit, the first always."""
        begin = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def add(a: Column, c: Column) -> Column:
            fits = a["on"] & ((a["t"] == "") | (F.length(a["t"]) + F.length(c) + 2 <= budget))
            return F.struct(F.when(fits, F.concat(a["t"], F.when(a["t"] != "", "; ").otherwise(""), c)).otherwise(a["t"]).alias("t"), (a["n"] + fits.cast("int")).alias("n"), fits.alias("on"))

        return let(F.aggregate(titles(s), begin, add), lambda r: F.when(r["n"] < F.size(s) - 1, F.concat(r["t"], F.lit("; +"), (F.size(s) - 1 - r["n"]).cast("string"), F.lit(" more"))).otherwise(r["t"]))

    def rows(all_: Column, sum_: Column) -> Column:
        budget = lambda s: F.when(sum_ > total, F.greatest(F.lit(300), F.floor(used(s) * total / sum_).cast("int"))).otherwise(F.lit(2147483647))
        covers = lambda s: F.when(F.size(s) > 1, let(budget(s), lambda most: listed(s, most))).otherwise(begins(s))
        return F.transform(all_, lambda s: F.struct(F.get(s, F.lit(0))["title"].alias("title"), covers(s).alias("covers"), F.size(s).alias("blocks"), F.array_join(F.transform(s, lambda b: b["text"]), "").alias("text")))

    return let(sections_, lambda all_: let(F.aggregate(F.transform(all_, used), F.lit(0), lambda a, x: a + x), lambda sum_: rows(all_, sum_)))


def term_counts(sections_: DataFrame, collection: str, section: str, text: str) -> DataFrame:
    """``c`` and ``first`` (place of first use) of each distinct term of each section."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "\\[page [0-9]+\\]|https?://\\S+", " ")
    words = F.regexp_extract_all(clean, F.lit("[a-z][a-z0-9_]{3,}"), F.lit(0))
    each = sections_.select(collection, section, F.posexplode(words).alias("at", "term")).where(~F.col("term").isin(STOP_WORDS))
    return each.groupBy(collection, section, "term").agg(F.count("*").alias("c"), F.min("at").alias("first"))


def distinctive_terms(sections_: DataFrame, collection: str, section: str, text: str, top: int = 6) -> DataFrame:
    """The ``top`` terms of every section by tf-idf; terms used once or in every section don't count, nor collections of less than 3."""
    # Read three times below: made once, not from the texts again for each.
    counts = written(term_counts(sections_, collection, section, text), "term-counts")
    sizes = sections_.groupBy(collection).agg(F.count("*").alias("total"))
    df = counts.groupBy(collection, "term").agg(F.count("*").alias("df"))
    length = counts.groupBy(collection, section).agg(F.sum("c").alias("len"))
    scored = counts.where("c >= 2").join(df, [collection, "term"]).join(sizes, collection).join(length, [collection, section]).where("total >= 3 AND df < total")
    scored = scored.withColumn("score", F.col("c") / F.col("len") * F.log(F.col("total") / F.col("df")))
    rank = F.row_number().over(Window.partitionBy(collection, section).orderBy(F.desc(F.round("score", 12)), "first"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top)


def running_lines(pages: DataFrame, document: str, page: str, text: str, share: float = 0.3) -> DataFrame:
    """Edge lines (first and last two that aren't blank) whose form recurs on at least max(3, ``share``) of a document's pages."""
    lines = lines_of(pages, F.col(text), document, page).where(one_line(F.col("line")) != "")
    by_page = Window.partitionBy(document, page)
    edge = (F.row_number().over(by_page.orderBy("n")) <= EDGE_LINES) | (F.row_number().over(by_page.orderBy(F.desc("n"))) <= EDGE_LINES)
    key = F.lower(F.regexp_replace(one_line(F.col("line")), "[0-9]+", "#"))
    edges = lines.withColumns({"edge": edge, "key": key}).where("edge").where(~F.col("line").rlike("^\\[page [0-9]+\\]$"))
    counts = edges.groupBy(document, "key").agg(F.count("*").alias("c"))
    sizes = pages.groupBy(document).agg(F.count("*").alias("pages"))
    often = counts.join(sizes, document).where((F.col("pages") >= 4) & (F.col("c") >= F.greatest(F.lit(3.0), F.col("pages") * share)))
    return edges.join(often.select(document, "key", "c"), [document, "key"]).select(document, page, "n", "line", "c")
