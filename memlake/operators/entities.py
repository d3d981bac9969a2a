"""Entity detection in texts and the registry of known entities.

Instead of one search per candidate and pattern, each pattern runs once over a text and returns the names it
stands next to; the signals are then counted per name. Defined results: null and empty texts have no
candidates; a name that equals a stop word is none; counts of repeated texts are per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.functions import lexicons as L

_NAME = "([A-Za-z]+)"
_EDGE_L, _EDGE_R = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def _generic(pattern: str) -> str:
    """The pattern for any name: the name is captured, what follows it is only looked at, so matches can overlap."""
    before, _, after = pattern.partition("%s")
    before, after = before.replace(r"\b", _EDGE_L), after.replace(r"\b", _EDGE_R)
    if before and before[-1] in "+*":  # words stand before the name: look at the name as well
        return f"(?i){before}(?={_NAME}{_EDGE_R}{after})"
    return f"(?i){before}{_NAME}{_EDGE_R}(?={after})"


def _signals(text: Column) -> Column:
    """Array of (name, signal, weight) in lower-case names."""
    found = []

    def add(patterns, signal, weight):
        for p in patterns:
            names = F.regexp_extract_all(text, F.lit(_generic(p)), F.lit(1))
            found.append(F.transform(names, lambda n: F.struct(F.lower(n).alias("name"), F.lit(signal).alias("signal"), F.lit(weight).alias("weight"))))

    add(L.DIALOGUE, "dialogue", 3)
    add(L.PERSON_VERBS, "action", 2)
    add(L.ADDRESSED.split("|"), "addressed", 4)
    add(L.PROJECT_VERBS, "project verb", 2)
    add([L.CODE_REFERENCE], "code_ref", 3)
    hyphen = F.regexp_extract_all(text, F.lit(rf"(?i){_EDGE_L}{_NAME}-(?=[0-9A-Za-z_])"), F.lit(1))
    words = F.regexp_extract_all(text, F.lit(rf"(?i){_EDGE_L}([A-Za-z]+v[0-9A-Za-z_]+)"), F.lit(1))
    cuts = F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.sequence(F.lit(2), F.greatest(F.length(w) - 1, F.lit(2))), lambda i: (F.lower(F.substr(w, i, F.lit(1))) == "v") & (i < F.length(w))), lambda i: F.substr(w, F.lit(1), i - 1))))
    cuts = F.filter(cuts, lambda c: c.rlike("^[A-Za-z]+$"))
    found.append(F.transform(F.concat(hyphen, cuts), lambda n: F.struct(F.lower(n).alias("name"), F.lit("versioned").alias("signal"), F.lit(3).alias("weight"))))
    return F.concat(*found)


def candidates(text: Column) -> Column:
    """Capitalized words of up to 20 letters without stop words, and words in camel case; with repetitions."""
    words = F.regexp_extract_all(text, F.lit(rf"{_EDGE_L}([A-Z][a-z]{{1,19}}){_EDGE_R}"), F.lit(1))
    camel = F.regexp_extract_all(text, F.lit(rf"{_EDGE_L}([A-Z][a-z]+(?:[A-Z][a-z]+)+){_EDGE_R}"), F.lit(1))
    return F.concat(F.filter(words, lambda w: ~F.lower(w).isin(*L.ENTITY_STOP_WORDS)), camel)


_PERSON, _PROJECT = ("action", "addressed", "dialogue"), ("code_ref", "project verb", "versioned")
_SUM = "struct<person:int,project:int,kinds:int>"


def _no_sums() -> Column:
    zero = [F.lit(0).alias(k) for k in ("person", "project", "kinds")]
    return F.struct(F.array().cast(f"array<struct<key:string,value:{_SUM}>>").alias("done"), F.lit("").alias("name"), F.lit("").alias("signal"), *zero)


def _closed(s: Column) -> Column:
    entry = F.struct(s["name"].alias("key"), F.struct(*[s[k].alias(k) for k in ("person", "project", "kinds")]).alias("value"))
    return F.when(s["name"] != "", F.concat(s["done"], F.array(entry))).otherwise(s["done"])


def _add_signal(s: Column, x: Column) -> Column:
    """One step of a fold over sorted signals: equal names are neighbours, and so are equal signals of a name."""
    same = x["name"] == s["name"]
    person = x["signal"].isin(*_PERSON)
    new = person & ~(same & (x["signal"] == s["signal"]))
    had = lambda k: F.when(same, s[k]).otherwise(0)
    return F.struct(
        F.when(same, s["done"]).otherwise(_closed(s)).alias("done"), x["name"].alias("name"), x["signal"].alias("signal"),
        (had("person") + F.when(person, x["weight"]).otherwise(0)).alias("person"),
        (had("project") + F.when(x["signal"].isin(*_PROJECT), x["weight"]).otherwise(0)).alias("project"),
        (had("kinds") + new.cast("int")).alias("kinds"),
    )


def _counts(words: Column) -> Column:
    """(name, n) of the words of an array, in one fold over the sorted words."""
    start = F.struct(F.array().cast("array<struct<name:string,n:int>>").alias("done"), F.lit("").alias("name"), F.lit(0).alias("n"))
    closed = lambda s: F.when(s["n"] > 0, F.concat(s["done"], F.array(F.struct(s["name"].alias("name"), s["n"].alias("n"))))).otherwise(s["done"])

    def step(s, w):
        same = w == s["name"]
        return F.struct(F.when(same, s["done"]).otherwise(closed(s)).alias("done"), w.alias("name"), (F.when(same, s["n"]).otherwise(0) + 1).alias("n"))

    return F.aggregate(F.array_sort(words), start, step, closed)


def detect_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, freq, person, project, type, confidence) of every candidate of every row."""
    t = F.col(text)
    lines = F.split(F.lower(t), "\n")
    pronoun = rf"(?<![0-9a-z_])(?:{'|'.join(L.PRONOUNS)})(?![0-9a-z_])"
    near = F.transform(lines, lambda x, i: F.struct(x.alias("line"), F.exists(F.slice(lines, F.greatest(i - 1, F.lit(1)), F.least(i + 3, F.lit(5))), lambda y: y.rlike(pronoun)).alias("pronoun")))
    rows = df.where(t.isNotNull()).select(F.col(key).alias("key"), candidates(t).alias("c"), _signals(t).alias("signals"), F.filter(near, lambda x: x["pronoun"])["line"].alias("near"))
    # everything is counted in the row, and only one small struct per name leaves it
    sums = F.aggregate(F.array_sort("signals"), _no_sums(), _add_signal, lambda s: F.map_from_entries(_closed(s)))
    rows = rows.withColumns({"sums": sums, "freqs": _counts(F.col("c"))})
    hits = lambda n: F.size(F.filter("near", lambda x: F.contains(x, F.lower(n))))
    each = F.transform("freqs", lambda f: F.struct(f["name"].alias("name"), f["n"].alias("freq"), hits(f["name"]).alias("hits"), F.element_at("sums", F.lower(f["name"])).alias("s")))
    got = rows.select("key", F.explode(each).alias("e")).select("key", "e.name", "e.freq", "e.hits", *[F.coalesce(F.col(f"e.s.{k}"), F.lit(0)).alias(k) for k in ("person", "project", "kinds")])
    scored = got.select("key", "name", "freq", (F.col("person") + 2 * F.col("hits")).alias("person"), "project", (F.col("kinds") + (F.col("hits") > 0).cast("int")).alias("kinds"))
    return classify_entities(scored).drop("kinds")


def classify_entities(scored: DataFrame) -> DataFrame:
    """``scored(freq, person, project, kinds)`` with type and confidence."""
    total = F.col("person") + F.col("project")
    ratio = F.when(total > 0, F.col("person") / total)
    kind = F.when(total == 0, "uncertain").when((ratio >= 0.7) & (F.col("person") >= 2), "person").when(ratio >= 0.7, "uncertain").when(ratio <= 0.3, "project").otherwise("uncertain")
    sure = (
        F.when(total == 0, F.least(F.col("freq") / 50.0, F.lit(0.4)))
        .when((ratio >= 0.7) & (F.col("kinds") >= 2) & (F.col("person") >= 2), F.least(0.5 + ratio * 0.5, F.lit(0.99)))
        .when((ratio >= 0.7) & (F.col("person") >= 2), F.least(0.5 + ratio * 0.3, F.lit(0.85)))
        .when(ratio >= 0.7, 0.4)
        .when(ratio <= 0.3, F.least(0.5 + (1 - ratio) * 0.5, F.lit(0.99)))
        .otherwise(0.5)
    )
    return scored.withColumns({"type": kind, "confidence": F.round(sure, 6)})


def registry_keys(registry: DataFrame) -> DataFrame:
    """(key, ord): every name and alias in lower case with the first entry that has it."""
    all_ = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    keys = registry.select("ord", F.explode(F.transform(all_, F.lower)).alias("key")).where(F.col("key").isNotNull())
    return keys.groupBy("key").agg(F.min("ord").alias("ord"))


def lookup(registry: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """``names`` with the entry each stands for, by name or alias without regard to case; null if unknown."""
    keys = registry_keys(registry).join(registry.select("ord", F.col("name").alias("entry"), F.col("type").alias("entry_type"), F.col("code").alias("entry_code")), "ord")
    return names.join(keys.withColumnRenamed("ord", "entry_ord"), F.lower(names[name]) == F.col("key"), "left").drop("key")


def register(registry: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry with the accepted entries, rejected entries): a name already known as name or alias is rejected."""
    known = registry_keys(registry).select("key")
    first = new.where(F.col("name").isNotNull()).groupBy(F.lower("name").alias("key")).agg(F.min("ord").alias("ord"))
    fresh = first.join(known, "key", "left_anti").select("ord")
    accepted, rejected = new.join(fresh, "ord", "left_semi"), new.join(fresh, "ord", "left_anti")
    return registry.unionByName(accepted.select(registry.columns)), rejected
