"""Texts that contain a signature: the last fall-back for a page's root, where another tool has read the article's text.

A signature is the first long paragraph of that text. It is looked for in the pieces of text of its page, whole, and then by
fewer and fewer of its first words; the first piece that holds the longest of these counts. No signature is compared with
all pieces: a posting table holds which words, pairs of words and borders between words stand in which piece, each
signature asks for one of them, and only pieces found there are read.

What a posting must not miss: a signature may begin and end within words of a piece, so its first and last word may be cut,
but the words between them stand whole and in a row. Words are runs without white space, and single ideographs, so that
texts without spaces have words too. A signature of four words or more asks for its second and third, one of three for its
second, one of two for the letters at the border of the two, and one of a single word for all pieces of its page.

Defined results: null or short texts have no signature; null pieces hold nothing; where equal pieces hold it the first by
``nth`` counts; repeated rows of a page's text count once; pages without a match have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookloom.functions.text import SPACES, trimmed, utf16_length
from brookloom.operators.extract import PAGE
from brookloom.operators.roots import in_consent

#: Least length of an article's text, of its telling paragraph and of a prefix; most and fewest words of one;
#: the share of the text that a root holds; the tags that may be one.
LEAST_ARTICLE, LEAST_PARAGRAPH, LEAST_PREFIX, MOST_WORDS, FEWEST_WORDS, COVERAGE = 200, 40, 12, 6, 2, 0.8
ROOT_TAGS = "article main section div body".split()
_IDEOGRAPH = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
_WORD = rf"([{_IDEOGRAPH}]|[^{SPACES[1:-1]}{_IDEOGRAPH}]+)"


def signatures(articles: DataFrame) -> DataFrame:
    """page_key, words and candidate of each text (page_key, text): ``words`` is 0 for the whole signature, else how many of its
    first words the candidate has. ``length`` is that of the text."""
    text = articles.select(PAGE, "text", utf16_length("text").alias("length")).where(utf16_length(trimmed(F.col("text"))) >= LEAST_ARTICLE).dropDuplicates([PAGE])
    lines = F.filter(F.transform(F.split("text", "\n+"), trimmed), lambda x: x != "")
    long = F.filter("lines", lambda x: utf16_length(x) >= LEAST_PARAGRAPH)
    df = text.withColumn("lines", lines).withColumn("signature", F.coalesce(F.get(long, F.lit(0)), F.get("lines", F.lit(0)))).where("signature is not null")
    df = df.withColumn("w", F.split("signature", f"{SPACES}+"))
    most = F.least(F.size("w") - 1, F.lit(MOST_WORDS))
    counts = F.when(most >= FEWEST_WORDS, F.sequence(most, F.lit(FEWEST_WORDS), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    prefixes = F.filter(F.transform(counts, lambda k: F.struct(k.alias("words"), F.array_join(F.slice("w", 1, k), " ").alias("candidate"))), lambda x: utf16_length(x["candidate"]) >= LEAST_PREFIX)
    whole = F.array(F.struct(F.lit(0).alias("words"), F.col("signature").alias("candidate")))
    return df.select(PAGE, "length", F.explode(F.concat(whole, prefixes)).alias("c")).select(PAGE, "length", "c.words", "c.candidate")


def _pair(kind: str, left: Column, right: Column) -> Column:
    return F.xxhash64(F.lit(kind), left, right)


def _border(left: Column, right: Column) -> Column:
    return _pair("border", F.right(left, F.lit(1)), F.left(right, F.lit(1)))


def postings(texts: DataFrame) -> DataFrame:
    """page_key, nth and the hash of each word, pair of words and border of each piece of text (page_key, nth, text)."""
    w = F.col("w")
    pairs = F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.size(w)).alias("b"))
    keys = F.concat(
        F.array(F.xxhash64(F.lit("all"))),
        F.transform(w, lambda x: F.xxhash64(F.lit("word"), x)),
        F.transform("pairs", lambda p: _pair("pair", p["a"], p["b"])),
        F.transform("pairs", lambda p: _border(p["a"], p["b"])),
    )
    df = texts.where("text is not null").select(PAGE, "nth", F.regexp_extract_all("text", F.lit(_WORD), F.lit(1)).alias("w")).withColumn("pairs", pairs)
    return df.select(PAGE, "nth", F.explode(F.array_distinct(keys)).alias("posting"))


def first_containing(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """page_key, words, candidate, length and nth of the first piece that holds the longest candidate of its page."""
    w = F.regexp_extract_all("candidate", F.lit(_WORD), F.lit(1))
    at = lambda k: F.get("w", F.lit(k))
    key = (
        F.when(F.size("w") >= 4, _pair("pair", at(1), at(2))).when(F.size("w") == 3, F.xxhash64(F.lit("word"), at(1)))
        .when(F.size("w") == 2, _border(at(0), at(1))).otherwise(F.xxhash64(F.lit("all")))
    )
    asking = asked.withColumn("w", w).withColumn("posting", key).drop("w")
    found = asking.join(postings(texts), [PAGE, "posting"]).join(texts, [PAGE, "nth"]).where(F.contains("text", "candidate"))
    rank = F.struct(F.when(F.col("words") == 0, 0).otherwise(1).alias("part"), (-F.col("words")).alias("fewer"), "nth")
    return found.groupBy(PAGE).agg(F.min_by(F.struct("words", "candidate", "length", "nth"), rank).alias("f")).select(PAGE, "f.*")


def signature_roots(nodes: DataFrame, articles: DataFrame) -> DataFrame:
    """page_key, words, nth, root_pos and root_end: the nearest container around the piece found that holds most of the
    text, else the outermost, else the node around the piece; none inside a consent notice. Pieces outside the body don't
    count."""
    pieces = nodes.select(PAGE, "pos", F.explode("own").alias("o")).select(PAGE, "pos", F.col("o.nth").alias("nth"), F.col("o.text").alias("text"))
    bodies = nodes.where("tag = 'body'").groupBy(PAGE).agg(F.min(F.struct("pos", "sub_end")).alias("b")).select(PAGE, "b.*").toDF(PAGE, "body_pos", "body_end")
    inside = pieces.join(bodies, PAGE).where("pos >= body_pos and pos <= body_end").select(PAGE, "pos", "nth", "text")
    found = first_containing(signatures(articles), inside.select(PAGE, "nth", "text")).join(inside.select(PAGE, "nth", F.col("pos").alias("at")), [PAGE, "nth"])
    marked = nodes.withColumn("consent", in_consent()).select(PAGE, "pos", "sub_end", "tag", "whole", "consent")
    above = found.join(marked, PAGE).where("pos <= at and sub_end >= at and (pos = at or tag in ('" + "', '".join(ROOT_TAGS) + "'))")
    container = F.col("tag").isin(ROOT_TAGS)
    covers = container & (F.col("whole") >= COVERAGE * F.col("length"))
    node = F.struct("pos", "sub_end", "consent")
    picked = above.groupBy(PAGE, "words", "nth").agg(
        F.max_by(node, F.when(covers, F.col("pos"))).alias("near"), F.min_by(node, F.when(container, F.col("pos"))).alias("outer"), F.max_by(node, "pos").alias("own"),
    )
    picked = picked.select(PAGE, "words", "nth", F.coalesce("near", "outer", "own").alias("r")).where("not r.consent")
    return picked.select(PAGE, "words", "nth", F.col("r.pos").alias("root_pos"), F.col("r.sub_end").alias("root_end"))
