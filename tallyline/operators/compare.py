"""Comparison of rankings and resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import cut
from ..functions.stats import name_key
from .lineup import top_of_each
from .ranks import rank_min


def compare_ranks(ours: DataFrame, theirs: DataFrame, *, name: str, segment: str, value: str, band: int = 8) -> DataFrame:
    """Full join of two rankings on (name key, segment): our_rank, their_rank (by value, ties share the smallest),
    rank_diff = their - our, and verdict: higher, lower, agree (within ``band``), only_ours, only_theirs. The smallest
    name stands for equal keys of one side."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        one = df.groupBy(name_key(name).alias("name_key"), F.col(segment)).agg(F.min(name).alias(f"{prefix}_name"), F.max(value).alias(f"{prefix}_value"))
        return rank_min(one, value=f"{prefix}_value", within=[segment], name=f"{prefix}_rank")

    both = side(ours, "our").join(side(theirs, "their"), ["name_key", segment], "full_outer")
    both = both.withColumn("rank_diff", F.col("their_rank") - F.col("our_rank"))
    verdict = F.when(F.col("their_rank").isNull(), "only_ours").when(F.col("our_rank").isNull(), "only_theirs").when(F.col("rank_diff") >= band, "higher").when(F.col("rank_diff") <= -band, "lower").otherwise("agree")
    return both.withColumn("verdict", verdict)


def missed_top(compared: DataFrame, *, n: int = 24) -> DataFrame:
    """The other side's first ``n`` of a segment that we rank behind ``n`` or not at all."""
    return compared.where((F.col("their_rank") <= n) & (F.col("our_rank").isNull() | (F.col("our_rank") > n)))


def agreement(compared: DataFrame, *, segment: str, n: int = 12) -> DataFrame:
    """Our first ``n`` of each segment that both sides rank, with their place."""
    both = compared.where(F.col("our_rank").isNotNull() & F.col("their_rank").isNotNull())
    return top_of_each(both.withColumn("best_first", -F.col("our_rank")), within=[segment], value="best_first", tie="name_key", n=n).drop("best_first")


def verdict_counts(compared: DataFrame, *, segment: str) -> DataFrame:
    """Verdicts by segment, one column each."""
    return compared.groupBy(segment).pivot("verdict", ["agree", "higher", "lower", "only_ours", "only_theirs"]).count().fillna(0)


# Words that are no part of a name, with or without dots behind them.
SUFFIXES = ["jr", "sr", "ii", "iii", "iv", "v"]


def alias_ends(aliases: DataFrame) -> DataFrame:
    """raw_key, alias_key: where each alias (lower case, trimmed; of several canonicals the smallest) ends when canonicals that are
    aliases themselves are followed. Each round doubles the steps of all pointers. What leads into a cycle has no end and is left out."""
    links = aliases.groupBy(F.lower(F.trim("alias")).alias("raw_key")).agg(F.lower(F.trim(F.min("canonical"))).alias("alias_key"))
    links, steps = cut(links.where("raw_key != '' AND alias_key IS NOT NULL")), 1
    n = links.count()
    while True:
        on = links.select(F.col("raw_key").alias("k"), F.col("alias_key").alias("further"))
        open_ends = links.join(on.select("k"), F.col("alias_key") == F.col("k"), "left_semi")
        if open_ends.isEmpty():
            return links
        if steps > n:
            return links.join(on.select("k"), F.col("alias_key") == F.col("k"), "left_anti")
        links = cut(links.join(on, F.col("alias_key") == F.col("k"), "left").select("raw_key", F.coalesce("further", "alias_key").alias("alias_key")))
        steps *= 2


def _grams(word: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - n + 1, F.lit(1))), lambda i: F.substring(word, i, n))


def resolve_names(raw: DataFrame, known: DataFrame, aliases: DataFrame, *, name: str, known_name: str) -> DataFrame:
    """Adds resolved and stage: alias (chains are followed, see ``alias_ends``), exact, suffix (SUFFIXES dropped anywhere), words (all longer
    words are in exactly one known name), else the name unchanged.

    Stages are joins on distinct names, so a name that many rows share is looked up once. Only the names that no
    equality resolves are compared by words: known names are filed under their pieces of three letters, and two; a name must hold
    all pieces of its words, so it is met by the one that the fewest known names have, and not at all where one is in none.
    """
    clean = F.lower(F.trim(F.col(name)))
    distinct = raw.select(clean.alias("raw_key")).where("raw_key != ''").distinct()
    names = known.groupBy(F.lower(F.trim(F.col(known_name))).alias("known_key")).agg(F.min(known_name).alias("known"))
    names = cut(names.where("known_key != ''"))
    step = distinct.join(alias_ends(aliases), "raw_key", "left").withColumn("asked", F.coalesce("alias_key", "raw_key"))
    step = step.join(names.withColumnRenamed("known_key", "asked").withColumnRenamed("known", "exact"), "asked", "left")
    core = F.filter(F.split(F.trim("asked"), r"\s+"), lambda w: ~F.regexp_replace(w, r"\.+$", "").isin(SUFFIXES))
    step = step.withColumn("short", F.array_join(core, " "))
    step = cut(step.join(names.withColumnRenamed("known_key", "short").withColumnRenamed("known", "by_suffix"), "short", "left"))
    by_equality = F.coalesce("exact", "by_suffix")

    words = F.filter(F.split("short", " "), lambda w: F.length(w) > 1)
    rest = step.where(by_equality.isNull()).select("raw_key", words.alias("words")).where("size(words) > 0")
    pieces = F.array_distinct(F.flatten(F.transform("words", lambda w: F.when(F.length(w) > 2, _grams(w, 3)).otherwise(F.array(w)))))
    filed = names.select("known_key", "known", F.explode(F.array_distinct(F.concat(_grams(F.col("known_key"), 2), _grams(F.col("known_key"), 3)))).alias("gram"))
    counts = filed.groupBy("gram").agg(F.count("*").alias("n"))
    asked = rest.select("raw_key", "words", F.explode(pieces).alias("gram")).join(counts, "gram", "left")
    rarest = asked.groupBy("raw_key").agg(F.first("words").alias("words"), F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("unknown")).where("unknown = 0")
    met = rarest.join(filed, "gram").where(F.forall("words", lambda w: F.contains(F.col("known_key"), w)))
    single = met.groupBy("raw_key").agg(F.count("*").alias("hits"), F.min("known").alias("by_words")).where("hits = 1")
    found = step.join(single, "raw_key", "left").select("raw_key", "alias_key", "exact", "by_suffix", "by_words")
    stage = F.when(F.col("exact").isNotNull() & F.col("alias_key").isNotNull(), "alias").when(F.col("exact").isNotNull(), "exact").when(F.col("by_suffix").isNotNull(), "suffix").when(F.col("by_words").isNotNull(), "words").otherwise("none")
    joined = raw.withColumn("raw_key", clean).join(found, "raw_key", "left")
    return joined.withColumns({"resolved": F.coalesce("exact", "by_suffix", "by_words", name), "stage": stage}).drop("raw_key", "alias_key", "exact", "by_suffix", "by_words")
