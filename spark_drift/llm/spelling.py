"""Spelling variants: words one edit apart, and the frequent word that a rare one stands for.

Of two words the shorter (of equal ones the lesser) is cut into two disjoint chunks; one edit leaves
one of them whole, at a place shifted by at most one, and half of the other chunk too. The other word
contributes its positional grams of those lengths; the two meet where chunk and half equal its gram
within that shift, and are verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_drift.llm.common import remove, scratch, stored

#: Letters of a run; A-Z alone change case.
RUN = "A-Za-zÀ-ÿ"
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """key (as text; empty for a null) and run: each maximal run of letters of whole texts that has at
    least ``least`` code points, in lower case. Null and empty texts have none."""
    # a run is matched from its first letter, so a match is a whole run
    found = F.explode(F.regexp_extract_all(text, F.lit(f"[{RUN}]{{{least},}}"), F.lit(0)))
    return docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), found.alias("_run")).select(
        "key", F.translate("_run", _CAPITALS, _SMALL).alias("run"))


def misspelt(key: Column, run: Column, every: int = 31) -> Column:
    """``run``, or for one in ``every`` (key, run) the run without one of its letters, by crc32 of
    ``key:run``: misspellings whose places are known."""
    h = F.crc32(F.concat(key, F.lit(":"), run).cast("binary"))
    gone = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), gone), F.substring(run, gone + 2, F.length(run)))).otherwise(run)


def vocabulary(words: DataFrame, word: str = "word", least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of at least ``least`` code points that occur at least ``count`` times.

    Occurrences are summed up before the shuffle, so a word that a third of all rows hold is a row per task."""
    return words.where(F.length(word) >= least).groupBy(F.col(word).alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _ends(m: Column) -> list[tuple[Column, Column]]:
    """For a word of m letters, what one edit leaves: how many letters at its start and at its end.

    The edit leaves the first chunk (of two halves) or the second, and of the other chunk again a half."""
    first = F.floor(m / 2).cast("int")
    second, lead = m - first, F.floor(first / 2).cast("int")
    trail = F.floor(second / 2).cast("int")
    none = F.lit(0)
    return [(first + trail, none), (first, second - trail), (lead, second), (none, second + first - lead)]


def _grams(m: Column) -> Column:
    """length, part and gram of ``word`` for partners of m letters, the word itself having m or m + 1."""
    left = lambda n: F.substring("word", F.lit(1), n)
    right = lambda n: F.substring("word", F.length("word") - n + 1, n)
    return F.array(*[F.struct(m.alias("length"), F.lit(i).alias("part"), F.concat(left(p), right(s)).alias("gram")) for i, (p, s) in enumerate(_ends(m))])


def links(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of the distinct ``word`` that one insertion, deletion or replacement
    of a code point turns into each other, once; a is the shorter, or the lesser of equal length.

    A chunk's shift is 0 at the start of the words and their difference in length at the end; other shifts
    within one find no further pair. All pairs are found: nothing that meets in a key is capped. Words
    need at least two code points."""
    m = F.length("word")
    words = words.where(m >= 2)
    short = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.inline(_grams(m)))
    long = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline(F.concat(_grams(m), _grams(m - 1))))
    order = (F.length("b") > F.length("a")) | (F.col("a") < F.col("b"))
    met = short.join(long, ["length", "part", "gram"]).where(order & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word and root, the last word that following ``form`` leads to, for the words that have a form.

    Each round doubles the steps taken, over written tables, until a round changes nothing. A form is
    at least FORM_RATIO times as frequent as its word, so a path has few steps and no circle."""
    spark = forms.sparkSession
    now, last = stored(forms.select("word", F.col("form").alias("root")), "forms"), None
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        folder = scratch(spark, "forms")
        now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")).write.parquet(folder)
        step = spark.read.parquet(folder)
        if last:
            remove(spark, last)
        now, last = step.select("word", "root"), folder
        if step.where("_moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for each row of ``words`` (word, n; distinct words).

    Near words differ by exactly one edit. A word's form is its near word of largest n (of equal ones
    the least in code-point order) if that is at least ``ratio`` times its own n, else null. The root is
    where following forms ends: the word itself without one. n_near is 0 for a word with no near
    word, form_n the form's n or null. An empty table gives no rows."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    words = stored(words.select("word", "n"), "words")
    pairs = stored(links(words), "near-words")
    near = pairs.select(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("other")).union(pairs.select("b", "n_a", "a"))
    # a word has at most a few hundred near words for each letter of the alphabet in use
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("m"), F.col("other"))).alias("_best"))
    rows = words.join(best, "word", "left")
    taken = -F.col("_best.col1") >= F.col("n") * ratio
    rows = stored(rows.select("word", F.when(taken, F.col("_best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                              F.when(taken, -F.col("_best.col1")).cast("long").alias("form_n")), "variants")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
