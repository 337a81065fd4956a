"""Sentence-packing chunks, their metrics, and batches of a list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .storage import durable

CLOSE_AT, LEAST_TAIL = 100, 15
#: Ceilings of the complexity score: words per sentence, letters per word.
VARIANT_A, VARIANT_B = (25.0, 10.0), (30.0, 12.0)


#: Sentences that are folded in one go; the cuts of a run of so many are kept apart, so that no step copies all cuts before it.
RUN = 128


def chunk_cuts(found: Column, close_at: int = CLOSE_AT, least_tail: int = LEAST_TAIL) -> Column:
    """Where the chunks of an array of sentences begin and end, as an array of (a, b).

    A fold over runs of sentences: within a run each sentence adds its words
    and notes where a chunk ends; the ends of all runs are joined once, so the
    work is linear in the sentences.  A short tail joins the chunk before it,
    or is dropped when there is none.
    """
    none = F.array().cast("array<int>")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(found) / RUN).cast("int") - 1, F.lit(0))), lambda r: F.slice(found, r * RUN + 1, F.lit(RUN)))

    def within(held: Column, run: Column, at: Column) -> Column:
        def step(acc: Column, sentence: Column) -> Column:
            held, k = acc["held"] + F.size(F.split(sentence, " ")), acc["at"] + 1
            full = held >= close_at
            return F.struct(k.alias("at"), F.when(full, 0).otherwise(held).alias("held"), F.when(full, F.concat(acc["ends"], F.array(k))).otherwise(acc["ends"]).alias("ends"))

        return F.aggregate(run, F.struct(at.alias("at"), held.alias("held"), none.alias("ends")), step)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("held"), F.array().cast("array<array<int>>").alias("ends"))

    def over(acc: Column, run: Column) -> Column:
        got = F.array(within(acc["held"], run, acc["at"]))  # a name for what is used three times
        return F.transform(got, lambda g: F.struct(g["at"].alias("at"), g["held"].alias("held"), F.concat(acc["ends"], F.array(g["ends"])).alias("ends")))[0]

    def finish(acc: Column) -> Column:
        ends, m = F.flatten(acc["ends"]), F.size(F.flatten(acc["ends"]))
        ends = F.when(acc["held"] == 0, ends).when((acc["held"] < least_tail) & (m > 0), F.concat(F.slice(ends, F.lit(1), m - 1), F.array(acc["at"]))).when(acc["held"] < least_tail, ends).otherwise(F.concat(ends, F.array(acc["at"])))
        return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0)))), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    cuts = F.aggregate(runs, start, over, finish)
    return F.filter(cuts, lambda c: c["b"].isNotNull())


def chunk_documents(docs: DataFrame, keys: list[str], text: str = "text", least_length: int = 200) -> DataFrame:
    """One row per chunk: keys, chunk_id from 1, text, word_count, length.

    Sentences and cuts are columns of their own, so that each is computed once
    and the chunks are slices of them.
    """
    clean = docs.select(*keys, X.squeeze(F.col(text)).alias("__t")).where(F.length("__t") >= least_length)
    found = clean.select(*keys, X.chunk_sentences(F.col("__t")).alias("__s")).withColumn("__c", chunk_cuts(F.col("__s")))
    chunks = F.transform("__c", lambda c: F.array_join(F.slice(F.col("__s"), c["a"] + 1, c["b"] - c["a"]), " "))
    rows = found.select(*keys, F.posexplode(chunks).alias("__k", "text"))
    return rows.select(*keys, (F.col("__k") + 1).alias("chunk_id"), "text", F.size(F.split("text", " ")).alias("word_count"), F.length("text").alias("length"))


def word_frequency(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.select(F.explode(X.words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def rounded(value: Column, digits: int) -> Column:
    """Half up by an explicit formula, which other engines repeat exactly."""
    k = 10**digits
    return F.floor(value * k + 0.5) / F.lit(float(k))


def rare_places(words: DataFrame, rare: int) -> DataFrame:
    """(__k, word) of each occurrence of the words of ``words`` (__k, a number of the place, and word) seen at most ``rare`` times.

    A word's aggregate has a fixed size: its count, least and greatest place,
    and the exclusive or of all places.  Up to three places follow from these,
    so nothing has to go back to the words, and a frequent word is one small
    row per task, however many places it has.
    """
    if not 0 <= rare <= 3:
        raise ValueError("places are kept of up to three occurrences")
    k = F.col("__k")
    per = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(k).alias("a"), F.max(k).alias("b"), F.bit_xor(k).alias("x")).where(F.col("n") <= rare)
    third = F.col("x").bitwiseXOR(F.col("a")).bitwiseXOR(F.col("b"))
    places = F.when(F.col("n") == 1, F.array("a")).when(F.col("n") == 2, F.array("a", "b")).otherwise(F.array("a", "b", third))
    return per.select(F.explode(places).alias("__k"), "word")


def complexity(chunks: DataFrame, keys: list[str], ceilings: tuple[float, float] = VARIANT_A, rare: int = 3) -> DataFrame:
    """Chunks with avg_sentence_len, avg_word_len, rare_word_ratio and complexity_score.

    Words and marks of each chunk are found once and kept (``durable``).  Rare
    are the words seen at most ``rare`` times, 3 or fewer, in the corpus.
    """
    words = chunks.withColumn("__w", X.words(F.col("text")))
    base = durable(words.withColumns({"__k": F.monotonically_increasing_id(), "__words": F.size("__w"), "__marks": F.size(X.sentences(F.col("text"))), "__letters": F.length(F.array_join("__w", ""))}), "chunks")
    hits = rare_places(base.select("__k", F.explode("__w").alias("word")), rare).groupBy("__k").agg(F.count(F.lit(1)).alias("__rare"))
    scored = (F.col("__words") > 0) & (F.col("__marks") > 0)
    value = lambda c: F.when(scored, c).otherwise(0.0)
    asl, awl = F.col("__words") / F.col("__marks"), F.col("__letters") / F.col("__words")
    ratio = F.coalesce(F.col("__rare"), F.lit(0)) / F.col("__words")
    score = 0.4 * F.least(asl / ceilings[0], F.lit(1.0)) + 0.3 * F.least(ratio, F.lit(1.0)) + 0.3 * F.least(awl / ceilings[1], F.lit(1.0))
    out = base.join(hits, "__k", "left")
    return out.select(
        *chunks.columns,
        value(rounded(asl, 2)).alias("avg_sentence_len"),
        value(rounded(awl, 2)).alias("avg_word_len"),
        value(rounded(ratio, 3)).alias("rare_word_ratio"),
        value(rounded(score, 3)).alias("complexity_score"),
    )


def by_score(chunks: DataFrame, keys: list[str]) -> DataFrame:
    return chunks.orderBy("complexity_score", *keys)


def score_summary(df: DataFrame, column: str) -> DataFrame:
    """One row: least, most, and the median, which is the value at place n div 2 of the sorted column.

    All follow from the number of rows of each value, and scores rounded to
    three digits have few values.
    """
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy())})
    above = F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(column))
    return placed.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.min(above).alias("median"))


def cleaning_metrics(text: Column) -> Column:
    """Struct of the simplified metrics of a cleaning pass: words by white space, an ellipsis ends a sentence."""
    t = X.squeeze(text)
    n, m = X.word_count(text), F.size(X.sentences_after_mark(F.coalesce(text, F.lit(""))))
    value = lambda c: F.when((n > 0) & (m > 0), rounded(c, 2)).otherwise(0.0)
    return F.struct(n.alias("word_count"), F.length(F.coalesce(text, F.lit(""))).alias("length"), value(n / m).alias("avg_sentence_len"), value(F.length(F.replace(t, F.lit(" "), F.lit(""))) / n).alias("avg_word_len"))


def batches(df: DataFrame, order: list[str], size: int, group: list[str]) -> DataFrame:
    """Number the batches of ``size`` rows within each group.

    Rows are dealt in ranges of (group, order), so that a group with a large
    part of all rows takes many tasks; a row's number is its rank in its range
    plus the group's rows in the ranges before.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(df.repartitionByRange(parts, *group, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    per = ranged.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(*[F.col(g).alias(f"__g{k}") for k, g in enumerate(group)], F.col("__range").alias("__r"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range", *group).orderBy(*order)) - 1
    same = F.col("__range") == F.col("__r")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{k}"))
    placed = ranged.withColumn("__rank", rank).join(offsets, same)
    return placed.select(*df.columns, F.floor((F.col("__rank") + F.col("__before")) / size).cast("int").alias("batch"))


def rejoin(parts: DataFrame, key: str, position: str, text: str) -> DataFrame:
    """Parts of a row joined by blank lines; null if any part failed."""
    got = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(position, text))).alias("p"), F.count(text).alias("ok"), F.count(F.lit(1)).alias("all"))
    joined = F.array_join(F.transform("p", lambda x: x[text]), "\n\n")
    return got.select(key, F.when(F.col("ok") == F.col("all"), joined).alias(text))
