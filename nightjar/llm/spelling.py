"""Spelling variant grouping: words one edit apart meet by asymmetric q-chunks.

A word of m code points is cut into two disjoint chunks, the halves [0, q) and
[q, m). A word one edit away keeps one of the two: at the same place if a code
point was replaced, or shifted by one behind an inserted one. So the shorter
word of a pair (either, if as long) gives its two chunks, the other the
positional grams that can equal them, at shift nought for m equal and at shift
nought or one for one code point more; grams at other places equal nothing
within shift one and are not made. Both meet in an equi-join, and the edit
distance is verified inside the join.

A chunk shared by very many words would compare all of them. Such a crowded
chunk is grown instead: the part that holds the edit is halved, and what is
outside a half joins the chunk, so every pair is still found, by a longer one.
That goes on until no chunk is crowded or the edit's place is one code point.
A pair is taken from the part that holds its first difference, so it comes once.

Everything is DataFrame work. ``words`` may repeat words (their counts add up);
null words are left out, a null count is nought. Words shorter than
``min_length`` or rarer than ``min_count`` are no words. Very long words need
no more rows than short ones. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nightjar.session import checkpoint_dir

LETTERS = "[A-Za-zÀ-ÿ]+"
CROWDED = 50_000        # candidate pairs of one chunk beyond which it is grown


def letter_runs(docs: DataFrame, text: str = "text", pattern: str = LETTERS) -> DataFrame:
    """One row (``run``) per maximal run of letters, beside the columns of
    ``docs`` but ``text``; only A-Z are lower-cased. Null texts have none."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (text, "run")]
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(pattern), F.lit(0))
    return docs.select(*kept, F.explode(runs).alias("run")).withColumn(
        "run", F.translate("run", upper, upper.lower()))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the chunk: the word without the part [lo, hi) that holds the edit;
    a longer word loses one code point more. ``lo`` says where its halves meet."""
    return rows.withColumn("chunk", F.expr(
        "concat(substring(word, 1, lo), substring(word, hi + 1 + int(longer), length(word)))"))


def _halved(rows: DataFrame) -> DataFrame:
    """Every part in two."""
    half = F.expr("(lo + hi) div 2").cast("int")
    spans = F.array(F.struct(F.col("lo").alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), F.col("hi").alias("hi")))
    return _keyed(rows.withColumn("span", F.explode(spans)).withColumns({"lo": F.col("span.lo"), "hi": F.col("span.hi")})
                  .select("word", "n", "m", "longer", "lo", "hi"))


KEY = ["m", "lo", "hi", "chunk"]


def near_pairs(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(a, n_a, b, n_b): every two of ``words`` (distinct ``word``, ``n``; two
    code points at least) exactly one insertion, deletion or replacement apart,
    each pair once."""
    checkpoint_dir(words.sparkSession)
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(
        F.struct(size.alias("m"), F.lit(False).alias("longer")),
        F.struct((size - 1).alias("m"), F.lit(True).alias("longer")))).alias("as"))
    whole = whole.select("word", "n", "as.m", "as.longer", F.lit(0).alias("lo"), F.col("as.m").alias("hi")).where("m >= 2")
    todo, settled = _halved(whole), []
    while True:
        counts = todo.groupBy(*KEY).agg(F.count_if(~F.col("longer")).alias("own"), F.count("*").alias("all"))
        full = counts.where((F.col("own") * F.col("all") > crowded) & (F.col("hi") - F.col("lo") > 1)).select(*KEY).checkpoint()
        if full.isEmpty():
            settled.append(todo)
            break
        settled.append(todo.join(full, KEY, "left_anti"))
        todo = _halved(todo.join(full, KEY, "left_semi")).checkpoint()
    rows = reduce(DataFrame.unionByName, settled)
    short = rows.where("not longer").select(*KEY, F.col("word").alias("a"), F.col("n").alias("n_a"))
    other = rows.select(*KEY, "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
    once: Column = F.expr("(hi = m or left(a, hi) <> left(b, hi)) and (longer or a < b)")
    return short.join(other, KEY).where(once & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms, by
    doubling, so rounds grow with the logarithm of the longest chain."""
    checkpoint_dir(forms.sparkSession)
    now = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        then = now.join(ahead, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")).checkpoint()
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def group_variants(words: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5,
                   crowded: int = CROWDED) -> DataFrame:
    """``words`` (word, n) with ``n_near`` (words one edit away), ``form`` and
    ``form_n`` (the commonest of them, the first in code-point order among
    equals, if ``ratio`` times as common as the word; else null) and ``root``
    (the last of the chain of forms; the word itself without one). ``ratio``
    is at least 2, so that chains end."""
    if min_length < 2 or ratio < 2:
        raise ValueError("min_length and ratio are at least 2")
    checkpoint_dir(words.sparkSession)
    known = (words.where("word is not null").groupBy("word").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
             .where((F.length("word") >= min_length) & (F.col("n") >= max(1, min_count))).checkpoint())
    pairs = near_pairs(known, crowded)
    # Both ends of a pair from one pass of the join.
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n")))).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best"))
    good = -F.col("best.less") >= ratio * F.col("n")
    found = known.join(best, "word", "left").select(
        "word", "n", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).alias("n_near")).checkpoint()
    roots = follow(found.where("form is not null"))
    return found.join(roots, "word", "left").select(
        "word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root"))
