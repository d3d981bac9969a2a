"""Variant spellings of names typed by people.

Every record has one or more spellings. Records that share a spelling (without regard to case, spacing and
look-alike characters) are one unit. Units are grouped in four steps:

1. *Forms.* Words that alternate beside the same other word ("Bob Li", "Robert Li") in at least ``SUPPORT``
   different contexts, and in at least ``LIFT`` of the contexts of the rarer one, are forms of each other: short
   names, abbreviations and common typos are learned from the spellings, there is no list of them. A rarer
   form also stands for the more frequent ones. Every context counts; of more than ``CONTEXT`` words two share one
   the more easily by chance, so there it counts the less, by the number of words: chance weighs the same for all.
2. *Vectors.* A spelling is a vector of weighted character n-grams: the grams of its words in any order, and the
   same grams marked with the first letter of another word of the spelling, so "M. Brown" and "Michael Brown"
   share more than "Stephen Brown" and "Michael Brown" do. A single word also counts as an initial with a name
   ("mbrown"), one that ends in a frequent word ("acmefoundry") as two words, and an identifier, a word with a
   digit, is one gram. Weights are inverse
   document frequencies over all spellings, of the gram times that of its word, so common given names and trades
   say little; grams of one spelling only weigh ``LONE`` times that, or typos would hide the rest.
3. *Join.* All pairs of spellings of a cosine of at least ``cosine`` come from a distributed sparse join (see
   ``cosine_pairs``). The similarity of two units is the largest cosine of their spellings.
4. *Groups.* Average linkage over the units: two groups merge while the mean similarity of their pairs, those
   below ``cosine`` being 0, is at least ``linkage``. The best ``TOP_N`` partners of every unit decide which units
   are looked at together in a round; every other pair above the threshold still counts in the means, and rounds
   go on until no two groups can merge, so the lists bound the work of a round and drop nothing.

A component of at most ``MAX_LINKS`` links is grouped in one task. A larger one is grouped in rounds that merge
pairs which are each other's best and sum the links again with Spark. A mean never rises above the larger of
the two that it joins, so the order of such merges changes nothing: both ways give the same groups, and no
link is left out. Ties are decided by a hash that every link carries.

Defined results: null and blank spellings are ignored; a record without spellings forms a group of its own;
repeated rows of the same key count once; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memlake.llm.canonical import canonical
from memlake.operators.components import connected_components
from memlake.runtime import shuffle_partitions, written

GRAM, COSINE, LINKAGE, TOP_N = 4, 0.25, 0.42, 32
#: Weights of unmarked grams, of marks from a middle initial, and of grams of one spelling, against 1.
PLAIN, MIDDLE, LONE = 1.3, 0.3, 0.4
#: How often words must alternate to be forms of each other, and the most words of a context that counts in full.
SUPPORT, LIFT, CONTEXT = 3, 0.15, 12
#: Links that one task takes; it decides where groups are made, not which.
MAX_LINKS = 500_000
#: Share of the spellings, and number of them, that have a word which a longer single word may end in.
FREQUENT, AT_LEAST = 1 / 1000, 5
#: Rows and features of a block of the join, rows from which more than one block is worth it, and products that are
#: summed at once; they decide where pairs are made, not which.
MAX_LIST, MAX_ENTRIES, SMALL, PORTION = 32_768, 1_500_000, 500, 1_000_000
#: Similarities are added as whole numbers of this part, so sums do not depend on their order.
UNITS = 1_000_000

# Titles and legal forms that are no part of a name.
TITLES = {"dr", "prof", "mr", "mrs", "ms", "sir", "ing", "mag"}
LEGAL = {"inc", "incorporated", "ltd", "limited", "llc", "gmbh", "ag", "sa", "bv", "nv", "co", "corp", "corporation", "company", "plc", "kg", "se", "spa", "srl", "oy", "ab"}


def normal(spelling: str) -> str:
    """The spelling in lower case and canonical characters with single spaces."""
    return " ".join(canonical(spelling).casefold().split())


def parts(norm: str) -> list[str]:
    """The words of a normal spelling in natural order, without titles, legal forms and articles."""
    s = norm
    if s.count(",") == 1:
        a, b = (x.strip() for x in s.split(","))
        if b.replace(".", "").replace(" ", "") not in LEGAL and a and b:
            s = f"{b} {a}"
    s = re.sub(r"\b(?:[a-z]\.)+[a-z]\b\.?", lambda m: m[0].replace(".", ""), s)  # b.v. and g.m.b.h.
    words = [w for t in re.split(r"[^\w]+", s) for w in ([t] if any(c.isdigit() for c in t) else t.split("_")) if w]
    kept = [w for w in words if w not in TITLES and w not in LEGAL and w != "the"]
    return kept or words


def _normals(batches):
    for b in batches:
        rec, out, word = [], [], []
        for r, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            n = normal(s)
            if n:
                rec.append(r)
                out.append(n)
                word.append(parts(n))
        yield pa.RecordBatch.from_arrays([pa.array(rec, pa.string()), pa.array(out, pa.string()), pa.array(word, pa.list_(pa.string()))], names=["rec", "norm", "parts"])


def word_forms(spellings: DataFrame) -> DataFrame:
    """(word, other): the more frequent words that a word stands for, learned from ``spellings(parts)``.

    Two words share a sum of contexts, in which one of more than ``CONTEXT`` words counts as ``CONTEXT`` divided by them.
    """
    whole = F.filter("parts", lambda w: w.rlike(r"^\p{L}{2,}$"))
    two = spellings.select(whole.alias("w")).where(F.size("w") == 2).select(F.col("w")[0].alias("context"), F.col("w")[1].alias("word"))
    seen = written(two.union(two.select("word", "context")).distinct())
    shared = seen.groupBy("context").agg(F.count("*").alias("n")).where("n > 1")
    weight = F.sqrt(F.least(F.lit(1.0), F.lit(float(CONTEXT)) / F.col("n")))
    entry = F.struct(F.xxhash64("context").alias("feature"), weight.alias("w"))
    rows = seen.join(shared, "context").groupBy("word").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    units = written(rows.select(F.col("word").alias("node"), F.col("e.feature").alias("features"), F.col("e.w").alias("weights"), F.size("e").alias("reach")))
    counts = dot_pairs(units, SUPPORT - 1e-6).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("dot").alias("n")).where(F.col("n") >= SUPPORT)
    df = seen.groupBy("word").agg(F.count("*").alias("df"))
    known = counts.join(df.select(F.col("word").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("word").alias("b"), F.col("df").alias("db")), "b")
    known = known.where(F.col("n") >= F.lit(LIFT) * F.least("da", "db"))
    a_rare = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    return known.select(F.when(a_rare, F.col("a")).otherwise(F.col("b")).alias("word"), F.when(a_rare, F.col("b")).otherwise(F.col("a")).alias("other"))


def split_words(nodes: DataFrame, n: int) -> DataFrame:
    """``nodes(node, parts)`` where a single word that ends in a frequent word ("acmefoundry") is two words."""
    words = nodes.select("node", F.explode("parts").alias("tail")).groupBy("tail").agg(F.countDistinct("node").alias("df"))
    tails = words.where((F.length("tail") >= 5) & F.col("tail").rlike(r"^\p{L}+$") & (F.col("df") >= max(AT_LEAST, n * FREQUENT))).select("tail")
    single = nodes.where((F.size("parts") == 1) & (F.length(F.col("parts")[0]) >= 9)).select("node", F.col("parts")[0].alias("word"))
    ends = single.select("node", "word", F.explode(F.sequence(F.lit(5), F.length("word") - 4)).alias("k")).select("node", "word", F.expr("right(word, k)").alias("tail"))
    found = ends.join(tails, "tail").groupBy("node").agg(F.max_by(F.struct("word", "tail"), F.length("tail")).alias("cut"))
    two = found.select("node", F.array(F.expr("left(cut.word, length(cut.word) - length(cut.tail))"), F.col("cut.tail")).alias("two"))
    return nodes.join(two, "node", "left").withColumn("parts", F.coalesce("two", "parts")).drop("two")


def _grams(word: str) -> set[str]:
    """The n-grams of a word with its edges; an identifier with a digit is one gram."""
    p = f"^{word}$"
    return {p} if any(c.isdigit() for c in word) else {p[i : i + GRAM] for i in range(max(1, len(p) - GRAM + 1))}


def name_vector(words: list[str], forms: list[list[str]], rarity: list[float]) -> dict[str, float]:
    """Feature to its weight before frequencies, of the words of a spelling, the forms and the rarity of each.

    A feature with a question mark is a guess, which only says something if another spelling has it without one.
    """
    out: dict[str, float] = defaultdict(float)

    def put(key, weight):
        out[key] = max(out[key], weight)

    whole = [len(w) > 1 for w in words]
    for i, own in enumerate(forms):
        if not whole[i]:
            continue
        others = [j for j in range(len(words)) if j != i]
        some_whole = any(whole[j] for j in others)
        for form in own:
            for g in _grams(form):
                weight = rarity[i] / len(own) ** 0.5
                put(f"|{g}", PLAIN * weight)
                for j in others:
                    for initial in {x[0] for x in forms[j]}:
                        put(f"{initial}|{g}", weight if whole[j] or not some_whole else MIDDLE * weight)
    if len(words) == 1 and len(words[0]) > 6 and words[0].isalpha():
        for g in _grams(words[0][1:]):
            put(f"?{words[0][0]}|{g}", rarity[0])
    return out


def _vectors(n: int):
    rarest = math.log1p(n / 2)

    def go(batches):
        for b in batches:
            node, feature, gram, weight = [], [], [], []
            for k, words, others, df in zip(*(b.column(i).to_pylist() for i in range(4))):
                v = name_vector(words, [[w, *sorted(o or [])] for w, o in zip(words, others)], [math.log1p(n / max(d, 2)) / rarest for d in df])
                node += [k] * len(v)
                feature += [xxhash.xxh64_intdigest(x.lstrip("?")) for x in v]
                gram += [xxhash.xxh64_intdigest(x[1:] if x[0] == "?" else x[x.index("|") :]) for x in v]
                weight += v.values()
            ints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (feature, gram)]
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), *ints, pa.array(weight, pa.float32())], names=["node", "feature", "gram", "weight"])

    return go


def _units(cosine: float):
    """(node, features, weights, reach): unit vectors, rare features first; ``reach`` features can reach the cosine.

    What comes after them has a norm below half the cosine.
    """

    def go(batches):
        for b in batches:
            out = ([], [], [], [])
            for k, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows.sort(key=lambda r: (r["df"], r["feature"]))
                w = np.array([r["w"] for r in rows])
                w /= np.sqrt((w * w).sum()) or 1.0
                common = np.array([r["df"] > 1 for r in rows])
                w, f = w[common], [r["feature"] for r in rows if r["df"] > 1]
                if len(w):
                    rest = np.sqrt(np.cumsum((w * w)[::-1]))[::-1]
                    for x, y in zip(out, (k, f, w.astype(np.float32), int((rest * 2 >= cosine).sum()))):
                        x.append(y)
            types = (b.schema.field(0).type, pa.list_(pa.int64()), pa.list_(pa.float32()), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=["node", "features", "weights", "reach"])

    return go


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of ``n[i]`` positions each, one after the other."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


def _portions(cost: np.ndarray):
    """(from, to) of runs of rows that cost ``PORTION`` together, or one row that costs more."""
    cuts = np.flatnonzero(np.diff(np.cumsum(cost) // PORTION, prepend=0))
    ends = np.unique([0, *cuts, len(cost)])
    return zip(ends[:-1], ends[1:])


def _candidates(x: np.ndarray, y: np.ndarray, at: np.ndarray, reach: np.ndarray, feature: np.ndarray, weight: np.ndarray, least: float):
    """(i, j) of the rows ``x`` and ``y`` whose features within reach sum to at least ``least``, in portions."""
    post = _runs(at[y], reach[y])
    owner = np.repeat(np.arange(len(y)), reach[y])
    order = np.argsort(feature[post], kind="stable")
    post, owner = post[order], owner[order]
    known = np.bincount(feature[post], minlength=feature.max() + 1 if len(feature) else 1)
    first = np.cumsum(known) - known
    own = _runs(at[x], reach[x])
    row = np.repeat(np.arange(len(x)), reach[x])
    work = np.bincount(row, known[feature[own]], minlength=len(x)).astype(np.int64)
    dense = work.sum() * 8 > len(x) * len(y)
    begin = np.cumsum(reach[x]) - reach[x]
    for a, b in _portions(np.maximum(work, len(y)) if dense else work):
        e = own[begin[a] : begin[b - 1] + reach[x[b - 1]]]
        n = known[feature[e]]
        q = _runs(first[feature[e]], n)
        cell = np.repeat((np.repeat(np.arange(b - a), reach[x[a:b]])) * len(y), n) + owner[q]
        part = np.repeat(weight[e], n) * weight[post[q]]
        if dense:
            sums = np.bincount(cell, part, minlength=(b - a) * len(y))
            cell = np.flatnonzero(sums >= least)
        else:
            cell, at_cell = np.unique(cell, return_inverse=True)
            cell = cell[np.bincount(at_cell, part, minlength=len(cell)) >= least]
        yield x[a + cell // len(y)], y[cell % len(y)]


def _products(least: float):
    """(x, y, dot) of one pair of blocks: candidates by their features within reach, then whole products."""

    def run(t: pa.Table) -> pa.Table:
        lists = t["features"].combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.cumsum(size) - size
        feature = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1]
        weight = t["weights"].combine_chunks().flatten().to_numpy().astype(float)
        reach = t["reach"].to_numpy().astype(np.int64)
        block, low, high = (t[k].to_numpy() for k in ("block", "low", "high"))
        x, y = np.flatnonzero(block == low), np.flatnonzero(block == high)
        order = np.lexsort((feature, np.repeat(np.arange(len(size)), size)))
        by_feature, by_weight = feature[order], weight[order]
        names = int(feature.max()) + 1 if len(feature) else 1
        out = []
        for i, j in _candidates(x, y, at, reach, feature, weight, least / 2 - 1e-6):
            if low[0] == high[0]:
                i, j = i[i < j], j[i < j]
            for a, b in _portions(size[i] + size[j]) if len(i) else ():
                u, v = i[a:b], j[a:b]
                (ku, wu), (kv, wv) = ((np.repeat(np.arange(b - a), size[k]) * names + by_feature[q], by_weight[q]) for k in (u, v) for q in [_runs(at[k], size[k])])
                to = np.minimum(np.searchsorted(kv, ku), len(kv) - 1)
                both = kv[to] == ku
                dot = np.bincount(ku[both] // names, wu[both] * wv[to[both]], minlength=b - a)
                keep = dot >= least
                out.append((u[keep], v[keep], dot[keep].round(6)))
        i, j, dot = (np.concatenate([o[k] for o in out]) if out else np.empty(0, kind) for k, kind in enumerate((np.int64, np.int64, float)))
        node = t["node"].combine_chunks()
        return pa.table({"x": node.take(pa.array(i)), "y": node.take(pa.array(j)), "dot": dot})

    return run


def dot_pairs(units: DataFrame, least: float) -> DataFrame:
    """(x, y, dot), x < y: all pairs of ``units(node, features, weights, reach)`` of a product of at least ``least``.

    Rows are hashed to blocks of at most about ``MAX_LIST`` rows and ``MAX_ENTRIES`` features, and each pair of blocks
    is a group of its own, in which the products are summed: what is shuffled is a copy of every row for each block,
    and no pairs. So a feature that many rows have is divided like all others.
    """
    n, entries = units.agg(F.count("*"), F.coalesce(F.sum(F.size("features")), F.lit(0))).first()
    spark = units.sparkSession
    busy = min(n // SMALL, math.ceil((4 * spark.sparkContext.defaultParallelism) ** 0.5))
    k = max(1, math.ceil(n / MAX_LIST), math.ceil(entries / MAX_ENTRIES), busy)
    placed = units.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(k))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long"))))
    placed = placed.select("node", "features", "weights", "reach", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    groups = placed.repartition(max(shuffle_partitions(spark), k * (k + 1)), "low", "high").groupBy("low", "high")
    kind = dict(units.dtypes)["node"]
    pairs = groups.applyInArrow(_products(least), f"x {kind}, y {kind}, dot double")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "dot")


def cosine_pairs(vectors: DataFrame, cosine: float) -> DataFrame:
    """(x, y, cosine), x < y: all pairs of nodes of ``vectors(node, feature, gram, weight)`` of at least that cosine.

    Weights are multiplied with the inverse document frequency of the feature; ``gram`` is the feature without its mark. Of every vector only the rarest features look for
    partners, as many as leave a rest of a norm below half the cosine: a pair whose shared features among them sum
    to less than half the cosine can't reach it. Candidates are verified with whole vectors, both in the blocks of
    ``dot_pairs``.
    """
    n = vectors.select("node").distinct().count()
    df = vectors.groupBy("feature").agg(F.count("*").alias("df"))
    seen = F.coalesce("gram_df", "df")
    idf = F.log1p(F.lit(float(n)) / F.greatest("df", F.lit(2))) * F.when(seen > 1, 1.0).otherwise(LONE)
    known = vectors.join(df, "feature").join(df.select(F.col("feature").alias("gram"), F.col("df").alias("gram_df")), "gram", "left")
    rows = known.groupBy("node").agg(F.collect_list(F.struct("df", "feature", (F.col("weight") * idf).alias("w"))).alias("rows"))
    units = written(rows.mapInArrow(_units(cosine), "node long, features array<long>, weights array<float>, reach int"))
    return dot_pairs(units, cosine).select("x", "y", F.least("dot", F.lit(1.0)).alias("cosine"))


def average_linkage(edges: list[tuple], least: float, fixed: set = frozenset()) -> dict:
    """Node to group: merges the two groups of the largest mean similarity while it is at least ``least``.

    ``edges`` are (a, b, sum of similarities, members of a, members of b, rank among equal means); pairs without an
    edge are 0. A node of ``fixed`` has links that are not among the edges: it stays as it is, and so does every
    node whose best partner stays.
    """
    near: dict = {}
    size: dict = {}
    for a, b, s, na, nb, h in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = (s, h)
        size[a], size[b] = na, nb
    members = {a: [a] for a in near}
    stays = set(fixed)
    mean = lambda a, b: near[a][b][0] / (size[a] * size[b])
    heap = [(-mean(a, b), -near[a][b][1], *sorted((a, b))) for a in near for b in near[a] if a < b and mean(a, b) >= least]
    heapq.heapify(heap)
    while heap:
        m, rank, a, b = heapq.heappop(heap)
        if a not in members or b not in members or b not in near[a] or mean(a, b) != -m or near[a][b][1] != -rank:
            continue
        if a in stays or b in stays:
            stays |= {a, b}
            continue
        if len(near[a]) < len(near[b]):
            a, b = b, a
        members[a] += members.pop(b)
        size[a] += size.pop(b)
        del near[a][b]
        for c, link in near.pop(b).items():
            if c == a:
                continue
            del near[c][b]
            if c in near[a]:
                link = (near[a][c][0] + link[0], min(near[a][c][1], link[1]))
            near[a][c] = near[c][a] = link
        for c, link in near[a].items():
            if mean(a, c) >= least:
                heapq.heappush(heap, (-mean(a, c), -link[1], *sorted((a, c))))
    return {x: min(m) for m in members.values() for x in m}


_LINK = ["u", "v", "s", "nu", "nv", "h"]
_MEAN = "s / (nu * nv)"


def _cluster(least: float):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        fixed = set(t["u"][~t["own_u"]]) | set(t["v"][~t["own_v"]])
        groups = average_linkage(list(t[_LINK].itertuples(index=False, name=None)), least, fixed)
        moved = [(x, g) for x, g in groups.items() if x != g]
        return pd.DataFrame(moved, columns=["unit", "grp"], dtype=object)

    return run


def _grouped(near: DataFrame, key: str, least: float) -> DataFrame:
    """(unit, grp) of every component, spread over all tasks by its key."""
    return near.repartition(shuffle_partitions(near.sparkSession), key).groupBy(key).applyInPandas(_cluster(least), "unit string, grp string")


def _ends(e: DataFrame, of: DataFrame) -> DataFrame:
    """Links with the components of both ends; ends outside every component can't merge with anything."""
    side = lambda k: of.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    return e.join(side("u"), "u").join(side("v"), "v")


def _both_ways(e: DataFrame, least: float) -> DataFrame:
    """(u, v, by) in both directions of every link that can merge, ``by`` being larger for better ones."""
    one = e.where(F.expr(_MEAN) >= least).select("u", "v", F.struct(F.expr(_MEAN).alias("m"), "h").alias("by"))
    return one.union(one.select("v", "u", "by"))


def _best_merges(e: DataFrame, least: float) -> DataFrame:
    """(unit, grp): merges of groups that are each other's best, of every node that is not its group's name.

    Every node points to its best partner. The nodes of one such tree, with all their links, are merged in one task
    as far as their links to other trees allow; of a tree of more than ``MAX_LINKS`` links only the root pair is merged.
    """
    best = written(_both_ways(e, least).groupBy("u").agg(F.max(F.struct("by", "v")).alias("best")).select("u", F.col("best.v").alias("v")))
    tree = written(connected_components(best, "u", "v"))
    near = _ends(e, tree).withColumn("tree", F.explode(F.array_distinct(F.array("cu", "cv"))))
    sizes = written(near.groupBy("tree").agg(F.count("*").alias("links")))
    own = [(F.col(f"c{k}") == F.col("tree")).alias(f"own_{k}") for k in "uv"]
    small = _grouped(near.join(sizes.where(F.col("links") <= MAX_LINKS), "tree").select("tree", *_LINK, *own), "tree", least)
    wide = best.join(tree.select(F.col("node").alias("u"), F.col("component").alias("tree")), "u").join(sizes.where(F.col("links") > MAX_LINKS), "tree")
    root = wide.select("u", "v").join(wide.select(F.col("v").alias("u"), F.col("u").alias("v")), ["u", "v"]).where("u > v")
    return small.union(root)


def _merged(e: DataFrame, step: DataFrame) -> DataFrame:
    """The links between the groups that ``step(unit, grp)`` makes of the ends of ``e``."""
    ends = e.select(F.col("u").alias("node"), F.col("nu").alias("n")).union(e.select("v", "nv")).distinct()
    moved = ends.join(step.withColumnRenamed("unit", "node"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
    sizes = moved.groupBy("grp").agg(F.sum("n").alias("n"))
    to = written(moved.select("node", "grp").join(sizes, "grp"))
    side = lambda k: to.select(F.col("node").alias(k), F.col("grp").alias(f"g{k}"), F.col("n").alias(f"m{k}"))
    wide = e.join(side("u"), "u").join(side("v"), "v").where("gu <> gv")
    swap = F.col("gu") > F.col("gv")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    flat = wide.select(pick("gu", "gv").alias("u"), pick("gv", "gu").alias("v"), "s", pick("mu", "mv").alias("nu"), pick("mv", "mu").alias("nv"), "h")
    return written(flat.groupBy("u", "v").agg(F.sum("s").alias("s"), F.first("nu").alias("nu"), F.first("nv").alias("nv"), F.min("h").alias("h")).select(*_LINK))


def _linked(e: DataFrame, linkage: float) -> DataFrame:
    """(unit, grp) by average linkage of the links (u, v, s, nu, nv, h); units that stay alone do not appear."""
    least = linkage * UNITS
    best_first = Window.partitionBy("u").orderBy(F.desc("by"), "v")
    merges = None
    while True:
        lists = _both_ways(e, least).withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= TOP_N)
        near = written(_ends(e, written(connected_components(lists, "u", "v"))))
        # a component is open if a link that can merge leaves it, or if it is too large for one task
        near = near.withColumn("comp", F.explode(F.array_distinct(F.array("cu", "cv"))))
        leaves = F.max((F.col("cu") != F.col("cv")) & (F.expr(_MEAN) >= least))
        sizes = near.groupBy("comp").agg(F.count("*").alias("links"), leaves.alias("leaves"))
        sizes = written(sizes.select("comp", ((F.col("links") > MAX_LINKS) | F.col("leaves")).alias("open")))
        whole = near.where("cu = cv").join(sizes.where("NOT open"), "comp").withColumns({"own_u": F.lit(True), "own_v": F.lit(True)})
        done = _grouped(whole.select("comp", *_LINK, "own_u", "own_v"), "comp", least)
        e = written(near.join(sizes.where("open"), "comp", "left_semi").select(*_LINK).distinct())
        if e.isEmpty():
            if merges is None:
                return done
            return connected_components(merges.union(done), "unit", "grp").select(F.col("node").alias("unit"), F.col("component").alias("grp"))
        step = written(_best_merges(e, least))
        merges = written(done.union(step) if merges is None else merges.union(done).union(step))
        e = _merged(e, step)


def link_names(spellings: DataFrame, cosine: float = COSINE, linkage: float = LINKAGE) -> DataFrame:
    """(rec, entity): the entity of every record of ``spellings(rec, spelling)``, named by its smallest record."""
    recs = spellings.select("rec").where(F.col("rec").isNotNull()).distinct()
    rows = spellings.where(F.col("rec").isNotNull() & F.col("spelling").isNotNull()).select("rec", "spelling").distinct()
    norms = written(rows.mapInArrow(_normals, "rec string, norm string, parts array<string>").distinct())
    bipartite = norms.select(F.concat(F.lit("r:"), "rec").alias("a"), F.concat(F.lit("s:"), "norm").alias("b"))
    units = written(connected_components(bipartite).select("node", F.col("component").alias("unit")))
    unit_of = units.where(F.col("node").startswith("s:")).select(F.expr("substr(node, 3)").alias("norm"), "unit")

    nodes = written(norms.select("norm", "parts").dropDuplicates(["norm"]).join(unit_of, "norm").withColumn("node", F.monotonically_increasing_id()))
    n = nodes.count()
    nodes = written(split_words(nodes, n))
    forms = word_forms(nodes).groupBy("word").agg(F.collect_set("other").alias("others"))
    placed = nodes.select("node", F.posexplode("parts").alias("at", "word"))
    df = placed.groupBy("word").agg(F.countDistinct("node").alias("df"))
    known = placed.join(df, "word").join(forms, "word", "left")
    words = known.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "word", "others", "df"))).alias("w")).select("node", *[F.col(f"w.{x}").alias(x) for x in ("word", "others", "df")])
    pairs = cosine_pairs(written(words.mapInArrow(_vectors(n), "node long, feature long, gram long, weight float")), cosine)
    side = lambda k, u: nodes.select(F.col("node").alias(k), F.col("unit").alias(u))
    e = pairs.join(side("x", "u"), "x").join(side("y", "v"), "y").where("u != v")
    e = e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.round(F.max("cosine") * UNITS).cast("long").alias("s"))
    one = F.lit(1).cast("long")
    part = _linked(written(e.withColumns({"nu": one, "nv": one, "h": F.xxhash64("u", "v")}).select(*_LINK)), linkage)
    groups = units.join(part, "unit", "left").withColumn("grp", F.coalesce("grp", "unit"))
    named = groups.where(F.col("node").startswith("r:")).select(F.expr("substr(node, 3)").alias("rec"), "grp")
    entity = named.groupBy("grp").agg(F.min("rec").alias("entity"))
    out = named.join(entity, "grp").select("rec", "entity")
    return recs.join(out, "rec", "left").select("rec", F.coalesce("entity", "rec").alias("entity"))
