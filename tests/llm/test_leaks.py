import random

from memlake.llm import leaks
from memlake.llm.leaks import find_leaks
from memlake.llm.words import words

ITEMS = "question_id string, passage string, question string"


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t) if t else []
        for q, p, s in items:
            pw, qw = words(p) if p else [], words(s) if s else []
            runs = [pw[i : i + 13] for i in range(len(pw) - 12)] + ([qw] if qw else [])
            if any(w[i : i + len(r)] == r for r in runs for i in range(len(w) - len(r) + 1)):
                out.add((d, q))
    return out


def case(seed=1):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    items = [(f"q{i}", " ".join(rnd.choices(vocab, k=rnd.randrange(8, 40))), " ".join(rnd.choices(vocab, k=rnd.randrange(1, 9)))) for i in range(15)]
    docs = []
    for i in range(80):
        w = rnd.choices(vocab, k=rnd.randrange(0, 60))
        if rnd.random() < 0.6:
            src = rnd.choice(items)[rnd.randrange(1, 3)].split()
            a = rnd.randrange(len(src))
            w[len(w) // 2 : len(w) // 2] = src[a if rnd.random() < 0.3 else 0 :][: rnd.choice([12, 13, 14, 40])]
        text = " ".join(w)
        docs.append((i, text.upper() if i % 3 == 0 else text.replace(" ", ",\n> ") if i % 3 == 1 else text))
    docs += [(100, None), (101, ""), (102, docs[5][1])]
    items += [("empty", "", ""), ("none", None, None), ("dup", *items[0][1:])]
    return docs, items


def run(spark, docs, items):
    c = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, h int")
    i = spark.createDataFrame(items + items[:2], ITEMS)
    got = [(r.doc, r.item) for r in find_leaks(c, "doc_id", "text", i, "question_id", "passage", "question").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_as_brute_force(spark):
    docs, items = case()
    assert run(spark, docs, items) == brute(docs, items)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", 0)
    docs, items = case(2)
    assert run(spark, docs, items) == brute(docs, items)


def test_look_alikes_and_empty(spark):
    p = "the quick brown fox jumps over the lazy dog and runs away from here"
    docs = [(1, "Xx " + p.replace("o", "о").replace("-", "‐").replace("fi", "ﬁ") + " yy"), (2, p.replace("quick", "quiсk​"))]
    assert run(spark, docs, [("a", p, "no such question")]) == {(1, "a"), (2, "a")}
    assert find_leaks(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", spark.createDataFrame([], ITEMS), "question_id", "passage", "question").count() == 0


def test_salted_shingles_lose_nothing(spark, monkeypatch):
    from memlake.llm import leaks

    text = "how is the old index moved to the new store without a break of the night job"
    docs = spark.createDataFrame([(i, f"note {i} {text} end {i}") for i in range(40)] + [(99, "nothing of that kind")], "doc_id long, text string")
    items = spark.createDataFrame([("q1", text, "old index"), ("q2", None, "index"), ("q3", "short", None)], "question_id string, passage string, question string")
    rows = lambda: sorted((r.doc, r.item, r.n_windows) for r in leaks.find_leaks(docs, "doc_id", "text", items, "question_id", "passage", "question").collect())
    whole = rows()
    monkeypatch.setattr(leaks, "MAX_HITS", 7)
    assert rows() == whole and len(whole) == 80
