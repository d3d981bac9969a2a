"""Typed memories and symbolic compression of texts.

Defined results: null and blank texts have no memory and no compressed form; of several types or codes with
the same score the first declared wins; entity names are replaced longest first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.functions import lexicons as L
from memlake.functions import text as X


def memories(df: DataFrame, sentence: str) -> DataFrame:
    """``df`` of the sentences with a marker, with type and score."""
    scores = X.memory_scores(F.col(sentence))
    best = F.greatest(*scores.values())
    kind = None
    for k, n in scores.items():
        kind = F.when(n == best, k) if kind is None else kind.when(n == best, k)
    return df.withColumns({"score": best, "type": kind}).where(F.col("score") > 0)


def topics(df: DataFrame, key: str, text: str, n: int = 5) -> DataFrame:
    """(key, topics): the heaviest topic words of every row, ties in order of the words; nothing leaves the row."""
    return df.select(key, X.topics(text, n).alias("topics"))


def compress(df: DataFrame, key: str, text: str, known: DataFrame | None = None) -> DataFrame:
    """(key, text, topics, emotions, flags, input_len, output_len, ratio) of every text that is not blank.

    With ``known(name, code)`` the key sentences are those of the text with names replaced by codes, and the codes
    found are the entities; where none is found, and without known names, capitalized words are. ``key`` is unique.
    """
    rows = df.where(X.trim_space(text) != "").select(F.col(key), F.col(text).alias("_t"))
    codes, working = X.capital_codes("_t"), F.col("_t")
    if known is not None:
        coded = entity_codes(rows, key, "_t", known).select(key, F.col("text").alias("_w"), F.col("codes").alias("_codes"))
        rows = rows.join(coded, key)
        codes, working = F.when(F.size("_codes") > 0, F.col("_codes")).otherwise(codes), F.col("_w")
    rows = rows.withColumns({"topics": X.topics("_t"), "emotions": X.emotions("_t"), "flags": X.flags("_t"), "codes": codes, "sents": X.key_sentences(working)})
    block = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"[{name}: "), F.array_join(c, ", "), F.lit("]")))
    out = F.concat_ws("\n", block("T", "topics"), block("E", "emotions"), block("F", "flags"), block("ENT", "codes"), F.when(F.size("sents") > 0, F.array_join("sents", "\n")))
    rows = rows.withColumn("_out", out).withColumns({"input_len": F.octet_length("_t"), "output_len": F.octet_length("_out")})
    ratio = F.when(F.col("output_len") > 0, F.col("input_len") / F.col("output_len")).otherwise(0.0)
    return rows.select(key, F.col("_out").alias("text"), "topics", "emotions", "flags", "input_len", "output_len", ratio.alias("ratio"))


def entity_codes(df: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, text, codes): known names in the text replaced by their codes, and the sorted codes found.

    ``known(name, code)``: names in small letters only are not replaced. A name is looked up by its first
    word, so texts and names join on words instead of being compared one by one.
    """
    names = known.where("name <> lower(name)").groupBy("name").agg(F.min("code").alias("code")).withColumn("head", F.get(X.tokens("name"), 0)).where("head IS NOT NULL")
    words = df.where(F.col(text).isNotNull()).select(key, F.explode(F.array_distinct(X.tokens(text))).alias("head"))
    near = words.join(names, "head").join(df.select(key, F.lower(text).alias("_low")), key).where(F.contains("_low", F.lower("name")))
    found = near.groupBy(key).agg(F.array_sort(F.collect_set("code")).alias("codes"), F.array_sort(F.collect_set(F.struct((-F.length("name")).alias("l"), "name", "code"))).alias("_names"))
    rows = df.select(key, F.col(text).alias("text")).join(found, key, "left")
    replaced = F.aggregate("_names", F.col("text"), lambda t, n: F.replace(t, n["name"], n["code"]))
    return rows.select(key, F.when(F.col("_names").isNotNull(), replaced).otherwise(F.col("text")).alias("text"), F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))
