"""Line dedup with a tree of log templates.

Lines are parsed as log lines are: fields with a digit become ``<*>``, and a tree of
fixed depth leads from the number of words over the leading words to a leaf.
Within a leaf, a word is fixed at its position if enough of the leaf's lines have it there, and becomes
``<*>`` otherwise. "Enough" begins with the number of documents that makes a template recur and doubles
step by step: each step gives a line a wider template, as long as enough of its words behind the leading ones stay
fixed, where fields count neither for nor against. A line belongs to the narrowest of its templates
that recurs. So a leaf has as many templates as its lines show, equally frequent ones included, and no
order of lines or templates plays a part.

A template must have at least as many fixed words with a letter as it has ``<*>``.
Lines without such a template (bare numbers, identifiers, table rows) never recur.

A template that occurs in many documents is boilerplate: its lines are dropped
everywhere but in the first document (by id) that has it. Documents with the same
text count as one, so that copies of a document do not make its lines boilerplate.

Everything is grouping and joining on hashes of templates. Lines are reduced to
distinct ones per leaf before anything is exploded, so a frequent line is one row, and leaves
are never gathered: words are counted by (leaf, position, word), and a template is the leaf with an order-free
hash of its fixed words and their positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import keep_table, packed, unpacked

DEPTH = 3
MIN_DOCUMENTS = 10
SIMILARITY = 0.75
_SALTS = 16
_FIELD = r"\S*\d\S*"


def masked_line(line: Column) -> Column:
    """The line with single blanks between words and ``<*>`` for every word with a digit."""
    blanks = F.trim(F.regexp_replace(line, r"\s+", " "))
    return F.when(blanks.rlike(r"\d"), F.regexp_replace(blanks, _FIELD, "<*>")).otherwise(blanks)


def _lines(docs: DataFrame, doc_id: str, text: str, depth: int) -> DataFrame:
    """One row per line with words: copy (hash of the text), doc, pos, line, leaf, h."""
    value = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.xxhash64(value).alias("copy"), F.posexplode(F.split(value, "\n")).alias("pos", "raw"))
    rows = rows.select("doc", "copy", "pos", masked_line(F.col("raw")).alias("line")).filter("line != ''")
    words = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    return rows.select("doc", "copy", "pos", "line", F.xxhash64(words, F.substring_index("line", " ", depth)).alias("leaf"), F.xxhash64("line").alias("h"))


def _distinct_lines(docs: DataFrame, busy: DataFrame, doc_text: Column) -> DataFrame:
    """leaf, h, weight (lines), words: one row for all equal lines; their words are looked up where one occurs first."""
    firsts = busy.groupBy("leaf", "h").agg(F.count("*").alias("weight"), F.min(F.struct("copy", "pos")).alias("at"))
    firsts = firsts.select("leaf", "h", "weight", F.col("at.copy").alias("copy"), F.col("at.pos").alias("pos"))
    wanted = firsts.groupBy("copy").agg(F.collect_set("pos").alias("picked")).withColumnRenamed("copy", "w_copy")
    texts = docs.select(F.xxhash64(doc_text).alias("copy"), doc_text.alias("text")).join(wanted, F.col("copy") == F.col("w_copy"))
    picked = texts.select("copy", F.explode("picked").alias("pos"), F.split("text", "\n").alias("all")).select("copy", "pos", masked_line(F.element_at("all", F.col("pos") + 1)).alias("line"))
    return firsts.join(picked.dropDuplicates(["copy", "pos"]), ["copy", "pos"]).select("leaf", "h", "weight", F.split("line", " ").alias("words"))


def _candidates(distinct: DataFrame, depth: int, least: int, similarity: float) -> DataFrame:
    """leaf, h, weight, template, step: the templates of each line, the narrowest first."""
    words = distinct.select("leaf", "h", "weight", F.posexplode("words").alias("p", "word")).filter((F.col("p") >= depth) & (F.col("word") != "<*>"))
    common = words.groupBy("leaf", "p", "word").agg(F.sum("weight").alias("n")).filter(F.col("n") >= least)
    fixed = words.join(common, ["leaf", "p", "word"]).groupBy("leaf", "h").agg(
        F.collect_list(F.struct("n", F.xxhash64("p", "word").alias("code"), F.col("word").rlike(r"\p{L}").alias("letter"))).alias("fixed")
    )
    behind = F.slice("words", depth + 1, F.greatest(F.size("words") - depth, F.lit(0)))
    facts = distinct.select(
        "leaf", "h", "weight", F.size(F.filter(behind, lambda w: w != "<*>")).alias("n_words"), F.size(F.filter("words", lambda w: w == "<*>")).alias("n_fields"),
        F.size(F.filter(F.slice("words", 1, depth), lambda w: w.rlike(r"\p{L}"))).alias("n_leading"),
    )
    lines = facts.join(fixed, ["leaf", "h"], "left").withColumn("fixed", F.coalesce("fixed", F.array().cast("array<struct<n:bigint,code:bigint,letter:boolean>>")))
    # A word that is not common cannot be fixed in a template that recurs.
    lines = lines.filter(F.size("fixed") >= F.col("n_words") * similarity - 1e-9)
    steps = F.floor(F.log2(F.coalesce(F.array_max(F.transform("fixed", lambda x: x["n"])), F.lit(least)) / least)).cast("int")
    lines = lines.withColumn("step", F.explode(F.sequence(F.lit(0), steps)))
    kept = F.filter("fixed", lambda x: x["n"] >= least * F.pow(F.lit(2.0), F.col("step")))
    lines = lines.withColumn("kept", kept).filter(F.size("kept") >= F.col("n_words") * similarity - 1e-9)
    n_open = F.col("n_fields") + F.col("n_words") - F.size("kept")
    lines = lines.filter(F.col("n_leading") + F.size(F.filter("kept", lambda x: x["letter"])) >= n_open)
    code = F.aggregate("kept", F.lit(0).cast("bigint"), lambda x, y: x.bitwiseXOR(y["code"]))
    return lines.select("leaf", "h", "weight", F.xxhash64("leaf", F.size("kept"), code).alias("template"), "step")


def line_templates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH,
    min_documents: int = MIN_DOCUMENTS, similarity: float = SIMILARITY,
) -> DataFrame:
    """doc, copy, pos, template (hash): every line of a template that occurs in enough different texts."""
    value = F.col(f"`{text}`").cast("string")
    narrow = keep_table(_lines(docs, doc_id, text, depth).select("doc", "copy", "pos", "leaf", "h"), "line-hashes")
    # A template is never wider than its leaf, so leaves with too few lines are left out first.
    # A leaf may hold a good part of all lines: it meets them in several places.
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    leaves = narrow.groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= min_documents).select("leaf", salts.alias("salt"))
    salted = narrow.withColumn("salt", F.pmod("h", F.lit(_SALTS)).cast("int"))
    busy = keep_table(salted.join(leaves, ["leaf", "salt"], "left_semi").drop("salt"), "line-busy")
    distinct = keep_table(_distinct_lines(docs, busy, value), "line-distinct")
    given = keep_table(_candidates(distinct, depth, min_documents, similarity), "line-candidates")
    # Lines are counted first, on few rows; then the texts that hold them.
    often = given.groupBy("template").agg(F.sum("weight").alias("n")).filter(F.col("n") >= min_documents).select("template")
    given = given.join(often, "template", "left_semi").select("leaf", "h", "template", "step")
    spread = busy.join(given, ["leaf", "h"]).select("template", "copy").distinct().groupBy("template").agg(F.count("*").alias("n"))
    recurring = spread.filter(F.col("n") >= min_documents).select("template")
    chosen = given.join(recurring, "template", "left_semi").groupBy("leaf", "h").agg(F.min_by("template", "step").alias("template"))
    return busy.join(chosen, ["leaf", "h"]).select("doc", "copy", "pos", "template")


def recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """doc, copy, positions: the lines to drop, per document."""
    lines = keep_table(line_templates(docs, doc_id, text, **settings), "line-templates")
    first = lines.groupBy("template").agg(F.min("doc").alias("first"))
    dropped = lines.join(first, "template").filter(~F.col("doc").eqNullSafe(F.col("first")))
    return dropped.groupBy("doc", "copy").agg(F.collect_set("pos").alias("positions"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` without lines whose template occurs in ``min_documents`` different texts.

    All columns stay, whatever their names, and so does every row: a document that consisted of such
    lines alone has an empty text. A NULL text stays NULL. The first document
    with a template keeps its lines; repeated rows (same id and text) are treated
    alike. Rows without an id are never first, unless no other row has the template: then all of them keep its lines.
    Lines without words are never dropped; lines of any length are compared as a whole.
    """
    dropped = keep_table(recurring_lines(docs, doc_id, text, **settings), "line-drops").toDF("d_doc", "d_copy", "positions")
    value = F.col(f"`{text}`").cast("string")
    rows = packed(docs, doc=F.col(f"`{doc_id}`"), copy=F.xxhash64(value), value=value)
    joined = rows.join(dropped, F.col("doc").eqNullSafe(F.col("d_doc")) & (F.col("copy") == F.col("d_copy")), "left")
    rest = F.filter(F.split("value", "\n"), lambda x, i: ~F.array_contains("positions", i))
    cleaned = F.when(F.col("positions").isNull(), F.col("value")).otherwise(F.array_join(rest, "\n"))
    return unpacked(joined.withColumn("cleaned", cleaned), docs.columns, **{text: "cleaned"})
