"""Per-document statistics that tell prose from lists, tables and junk.

Everything is computed inside the JVM: a text is cut into blocks (a list entry, table row or
heading is one; wrapped lines up to a blank line are one), each block gets its figures, and fixed
thresholds name what it is. ``verdicts`` adds up characters per kind and records one reason per
failed rule, with the rules of the published repetition and quality filters for web text beside
the kinds.

Defined cases: null, empty and blank texts have zero figures, no reasons and are never found; a
repeated row is one row after ``distinct``; only German and English function words are known, so a
text in another language counts as words without sentences; any length is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common function words of English and German.
COMMON_EN = (
    "the a an of to and is in that it for was on are as with be by not or if this from at which but has have had its "
    "they we you he she when then so until before after only still here because new there what where who how will would "
    "can could may must should do does did than more most per while both into out up over under such each either any no "
    "nor one every other their our your his her these those been being were about between without against"
).split()
COMMON_DE = (
    "der die das den dem des ein eine einen einem einer eines und oder aber denn weil wenn ob als wie dass bis nachdem "
    "bevor solange sobald ist sind war waren wird werden wurde wurden worden sein hat haben hatte kann muss soll darf "
    "nicht kein keine nichts nur noch schon auch dann doch hier dort danach zuerst im am auf aus bei beim mit nach von "
    "vom vor zu zum zur unter durch für gegen ohne um zwischen es er sie wir ich ihr sich man dieser diese dieses jede "
    "jeder jedes alle andere welcher welche wer wo je mehr sehr"
).split()
# Thresholds of the rules.
BLOCK_COMMON, BLOCK_WORDS, BLOCK_LETTERS, BLOCK_BROKEN = 0.12, 4, 0.5, 0.01
REPEAT_WORDS, REPEAT_DISTINCT, REPEAT_FOURS = 20, 0.25, 0.25
PART = 0.5
RULES = {
    "words_below_50": "n_words < 50",
    "words_above_100000": "n_words > 100000",
    "mean_word_length_outside_3_to_10": "mean_word_length < 3 or mean_word_length > 10",
    "symbols_above_0.1": "symbol_ratio > 0.1",
    "bullet_lines_above_0.9": "bullet_line_share > 0.9",
    "ellipsis_lines_above_0.3": "ellipsis_line_share > 0.3",
    "fewer_than_2_common_words": "n_common < 2",
}

BULLET = r"[ \t]*(?:[-*+•‣◦▪·–—]|\(?\d{1,4}[.)]|\[[ xX]\]|\(?[a-zA-Z][.)])[ \t]"
_LONE = rf"(?m)^({BULLET}.*|[ \t]*[#|+].*)$"
_HEADING = r"^[ \t]*#{1,6}[ \t]"
_BROKEN = "[ÃÂ][\\u0080-\\u00BF\\u0152-\\u0178\\u2013-\\u2122ÃÂ]|\\uFFFD|â€"


def _kind(b: Column) -> Column:
    """(kind, characters, words, common words) of one block."""
    words = F.regexp_extract_all(F.lower(b), F.lit(r"\p{L}+"), 0)
    common = F.size(F.filter(words, lambda w: w.isin(*COMMON_EN, *COMMON_DE)))
    n, k = F.length(b), F.size(words)
    letters = F.length(F.regexp_replace(b, r"[^\p{L}]+", ""))
    fours = F.transform(F.sequence(F.lit(1), k - 3), lambda i: F.concat_ws(" ", F.slice(words, i, 4)))
    repeats = (k > REPEAT_WORDS) & (F.size(F.array_distinct(words)) < REPEAT_DISTINCT * k) & (F.size(F.array_distinct(fours)) < REPEAT_FOURS * (k - 3))
    kind = (
        F.when(b.rlike("^" + BULLET), "list")
        .when(b.rlike(_HEADING), "heading")
        .when(F.regexp_count(b, F.lit(_BROKEN)) > BLOCK_BROKEN * n, "broken")
        .when((k < BLOCK_WORDS) | (common < BLOCK_COMMON * k), "no_sentence")
        .when(letters < BLOCK_LETTERS * n, "symbols")
        .when(repeats, "repeats")
        .otherwise("prose")
    )
    return F.struct(kind.alias("kind"), n.alias("n"))


def statistics(documents: DataFrame) -> DataFrame:
    """One row per document with its figures, whatever the text holds."""
    text = F.coalesce(F.regexp_replace("text", "\\r\\n|[\\r\\x0B\\x0C\\x85\\u2028\\u2029]", "\n"), F.lit(""))
    base = documents.select("doc_id", text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"(?U)\S"))
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), 0)
    blocks = F.filter(F.split(F.regexp_replace("t", _LONE, "\n\n$1\n\n"), r"\n[ \t]*\n\s*"), lambda x: x.rlike(r"(?U)\S"))
    one = base.withColumns({"lines": lines, "words": words, "blocks": blocks})
    one = one.withColumn("kinds", F.transform(F.array_distinct("blocks"), _kind))
    total = lambda xs, f: F.aggregate(xs, F.lit(0), lambda acc, x: acc + f(x))
    share = lambda pattern: F.try_divide(F.size(F.filter("lines", lambda x: x.rlike(pattern))), F.size("lines"))
    chars = total(F.col("blocks"), lambda x: F.length(x))
    kept = total(F.col("kinds"), lambda x: x["n"])
    of = lambda *kinds: total(F.filter("kinds", lambda x: x["kind"].isin(*kinds)), lambda x: x["n"])
    return one.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.coalesce(F.try_divide(total(F.col("words"), lambda x: F.length(x)), F.size("words")), F.lit(0.0)).alias("mean_word_length"),
        F.coalesce(F.try_divide(F.length(F.regexp_replace("t", r"[\p{L}\p{N}\s]+", "")), F.length("t")), F.lit(0.0)).alias("symbol_ratio"),
        F.coalesce(share(r"[.!?;:…][\"'»“”)\]]*\s*$"), F.lit(0.0)).alias("line_end_share"),
        F.coalesce(share("^" + BULLET), F.lit(0.0)).alias("bullet_line_share"),
        F.coalesce(share(r"(\.\.\.|…)\s*$"), F.lit(0.0)).alias("ellipsis_line_share"),
        F.size(F.filter("words", lambda w: w.isin(*COMMON_EN, *COMMON_DE))).alias("n_common"),
        chars.alias("n_block_chars"),
        (chars - kept).alias("chars_again"),
        of("list").alias("chars_list"),
        of("no_sentence", "symbols").alias("chars_no_sentence"),
        of("broken").alias("chars_broken"),
        of("repeats").alias("chars_repeats"),
        of("prose", "heading").alias("chars_prose"),
    )


def block_chars(documents: DataFrame) -> DataFrame:
    """The part of ``statistics`` that the verdict on prose needs."""
    return statistics(documents).select("doc_id", "n_block_chars", "chars_prose")


NOT_PROSE = f"n_block_chars > 0 and chars_prose < {1 - PART} * n_block_chars"


def verdicts(documents: DataFrame) -> DataFrame:
    """Figures plus ``reasons``: the rules that fail, empty for a good or a blank text."""
    s = statistics(documents)
    rules = {"not_prose": NOT_PROSE, "common_share_below_0.12": "n_common < 0.12 * n_words"} | RULES
    reasons = F.array_compact(F.array(*[F.when(F.expr(r) & (F.col("n_block_chars") > 0), F.lit(k)) for k, r in rules.items()]))
    return s.withColumn("reasons", reasons)


def not_prose(documents: DataFrame) -> DataFrame:
    """doc_id of texts of which more than half of the characters stand outside running sentences."""
    return block_chars(documents).where(NOT_PROSE).select("doc_id").distinct()
