import itertools
import math
import random

from memlake.llm import names
from memlake.llm.names import average_linkage, cosine_pairs, link_names, name_vector, parts, word_forms

FAMILIES = "talmhedren nadzimmap ballendgirt okonkwo fitzgerald zielinski vanderberg ashworth lindqvist marchetti".split()


def fillers(n=40):
    return [(f"f{i}", f"Filler{i} Name{i * 37}") for i in range(n)]


def groups_of(spark, rows):
    return {r.rec: r.entity for r in link_names(spark.createDataFrame(rows, "rec string, spelling string")).collect()}


def test_parts():
    assert parts("nadzimmap, g.") == ["g", "nadzimmap"] and parts("prof. dr. ann lee") == ["ann", "lee"] and parts("acme tools b.v.") == ["acme", "tools"]
    assert parts("tool_x7") == ["tool_x7"] and parts("ann_lee") == ["ann", "lee"] and parts("dr") == ["dr"]


def test_average_linkage():
    one = lambda *e: [(a, b, s, 1, 1, 0) for a, b, s in e]
    assert average_linkage(one(("a", "b", 9), ("b", "c", 9)), 5) in ({"a": "a", "b": "a", "c": "c"}, {"a": "a", "b": "b", "c": "b"})  # a and c are 0
    assert average_linkage(one(("a", "b", 9), ("b", "c", 9), ("a", "c", 6)), 5) == {"a": "a", "b": "a", "c": "a"}
    assert average_linkage(one(("a", "b", 9), ("b", "c", 8)), 5, {"b"}) == {"a": "a", "b": "b", "c": "c"}
    assert average_linkage([], 5) == {}


def test_word_forms_are_learned(spark):
    rows = [(f"{g} {f}",) for f in FAMILIES[:5] for g in ("robert", "bob")] + [(f"robert {f}",) for f in FAMILIES[5:]] + [("stephen talmhedren",), ("michael okonkwo",)]
    got = word_forms(spark.createDataFrame(rows, "norm string").selectExpr("split(norm, ' ') AS parts")).collect()
    assert [tuple(r) for r in got] == [("bob", "robert")]


def test_all_cosine_pairs_are_found(spark, monkeypatch):
    rnd = random.Random(5)
    vectors = [{f: rnd.choice([1.0, 2.0]) for f in rnd.sample(range(40), rnd.randint(1, 9))} for _ in range(120)]
    rows = [(i, f, f, w) for i, v in enumerate(vectors) for f, w in v.items()]
    df = [sum(f in v for v in vectors) for f in range(40)]
    full = [{f: w * math.log1p(len(vectors) / max(df[f], 2))  * (1 if df[f] > 1 else names.LONE) for f, w in v.items()} for v in vectors]
    norm = [math.sqrt(sum(w * w for w in v.values())) for v in full]
    cos = {(i, j): sum(full[i][f] * full[j][f] for f in full[i].keys() & full[j].keys() if df[f] > 1) / norm[i] / norm[j] for i, j in itertools.combinations(range(120), 2)}
    want = {p for p, c in cos.items() if c >= 0.4}
    table = spark.createDataFrame(rows, "node long, feature long, gram long, weight float")
    for bound in (1024, 7):
        monkeypatch.setattr(names, "MAX_LIST", bound)
        got = {(r.x, r.y): r.cosine for r in cosine_pairs(table, 0.4).collect()}
        assert set(got) == want and all(abs(got[p] - cos[p]) < 1e-4 for p in want)


def test_contexts_of_many_words_count(spark):
    """Every family has 20 given names, more than CONTEXT; most of them stand beside that family only."""
    rows = [(f"{g} {f}",) for f in FAMILIES for g in ("robert", "bob", *(f"given{f}{chr(97 + i)}" for i in range(18)))]
    got = word_forms(spark.createDataFrame(rows, "norm string").selectExpr("split(norm, ' ') AS parts")).collect()
    assert [tuple(sorted(r)) for r in got] == [("bob", "robert")]


def shuffled(plan):
    """Rows that the shuffles of a plan that ran have written."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.metrics().contains("shuffleRecordsWritten") else 0
    return own + sum(shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_join_shuffles_rows_not_pairs(spark):
    """300 vectors share a feature that they look for partners by: 45,000 pairs to sum up, 150 to find."""
    rows = [(i, f, f, 1.0) for i in range(300) for f in (7, 1000 + i // 2)]
    pairs = cosine_pairs(spark.createDataFrame(rows, "node long, feature long, gram long, weight float"), 0.25)
    assert {(r.x, r.y) for r in pairs.collect()} == {(i, i + 1) for i in range(0, 300, 2)}
    assert shuffled(pairs._jdf.queryExecution().executedPlan()) < 3000


def test_vector_marks_grams_with_initials():
    v, w, x = (name_vector(n.split(), [[t] for t in n.split()], [1.0] * 2) for n in ("michael brown", "m brown", "stephen brown"))
    assert {"m|brow", "b|mich", "|brow"} <= set(v) and "m|brow" in w and "m|brow" not in x and "|brow" in x
    assert name_vector(["tool_x7"], [["tool_x7"]], [1.0]) == {"|^tool_x7$": names.PLAIN}


def test_names_outside_any_list(spark):
    """Invented names; short forms are learned from other people who use them, relatives stay apart."""
    rows = [(f"k{i}{j}", f"{g} {f}") for i, f in enumerate(FAMILIES[:4]) for j, g in enumerate(("Xandrophel", "Zaff"))]
    rows += [("a1", "Xandrophel Quillmontane"), ("a2", "ZAFF QUILLMONTANE"), ("a3", "Quillmontane, X."), ("a4", "xquillmontane"), ("a5", "Xandrophel  Quillmotnane"), ("b1", "Yorvik Quillmontane"), ("b2", "Yorvik P. Quillmontane"), ("c1", "Dravenholt Foundry Ltd"), ("c2", "dravenholtfoundry"), ("c3", "The Dravenholt Foundry")]
    got = groups_of(spark, rows + fillers())
    assert [got[f"a{i}"] for i in range(1, 6)] == ["a1"] * 5
    assert got["b1"] == got["b2"] == "b1" and [got[f"c{i}"] for i in (1, 2, 3)] == ["c1"] * 3
    assert all(got[f"k{i}0"] == got[f"k{i}1"] == f"k{i}0" for i in range(4)) and len(set(got.values())) == 4 + 3 + 40


def test_link_names(spark):
    rows = [("e1", "Giuseppe Nadzimmap"), ("e2", "G. Nadzimmap"), ("e3", "Nadzimmap, Giuseppe"), ("r1", "gnadzimmap"), ("r1", "tool_x7"), ("e4", "TOOL_X7"), ("e5", "Michael Ballendgirt"), ("e6", "Stephen Lindqvist"), ("e7", None), ("e8", "  "), ("e1", "Giuseppe Nadzimmap"), (None, "x")]
    rows += fillers(30)
    got = {r.rec: r.entity for r in link_names(spark.createDataFrame([(a, b, 1) for a, b in rows], "rec string, spelling string, unit int")).collect()}
    assert {k: got[k] for k in ("e1", "e2", "e3", "r1", "e4")} == dict.fromkeys(("e1", "e2", "e3", "r1", "e4"), "e1")
    assert got["e5"] == "e5" and got["e6"] == "e6" and got["e7"] == "e7" and got["e8"] == "e8" and len(got) == 39
    assert link_names(spark.createDataFrame([], "rec string, spelling string")).count() == 0


def test_bounds_change_no_group(spark, monkeypatch):
    """Sums, rounds and lists: whatever a task takes and however short the lists are, the groups are those of one task."""
    rnd = random.Random(3)
    edges = [(f"u{i:02}", f"u{j:02}", rnd.choice([300_000, 500_000, 600_000, 850_000, 950_000]), 1, 1) for i in range(14) for j in range(i + 1, 14) if rnd.random() < 0.5]
    e = spark.createDataFrame(edges, "u string, v string, s long, nu long, nv long").selectExpr("*", "xxhash64(u, v) AS h")
    merged = lambda: {r.unit: r.grp for r in names._linked(e, 0.45).collect() if r.unit != r.grp}
    one = {x: g for x, g in average_linkage([tuple(r) for r in e.collect()], 450_000).items() if x != g}
    assert merged() == one and len(one) > 5
    for links, top in ((20, 2),):
        monkeypatch.setattr(names, "MAX_LINKS", links)
        monkeypatch.setattr(names, "TOP_N", top)
        assert merged() == one


def test_words_typed_together_are_split(spark):
    rows = [(i, [f"name{c}", "foundry"]) for i, c in enumerate("abcdef")] + [(10, ["dravenholtfoundry"]), (11, ["foundry"]), (12, ["xfoundry"]), (13, ["dravenholt"])]
    got = {r.node: r.parts for r in names.split_words(spark.createDataFrame(rows, "node long, parts array<string>"), len(rows)).collect()}
    assert got[10] == ["dravenholt", "foundry"] and got[11] == ["foundry"] and got[12] == ["xfoundry"] and got[13] == ["dravenholt"] and len(got) == 10
