import random

from hypothesis import given, settings
from hypothesis import strategies as st

from memlake.llm import packing as P
from memlake.llm.packing import pack_documents


def tokens(text):
    return len(P._encoding(P.default_tokenizer()).encode_ordinary(text))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab c\n\t.é漢 ' 　-1"), max_size=30), max_size=6))
def test_counts_are_exact(texts):
    import pyarrow as pa

    b = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    got = [n for o in P._measure(P.default_tokenizer())(iter([b])) for n in o.column("n_tokens").to_pylist()]
    assert got == [tokens(t) for t in texts]


def corpus(seed=7, n=400):
    rnd = random.Random(seed)
    topics = [[f"topic{k}word{i}" for i in range(30)] for k in range(8)]
    return [(i, f"k{i % 8}", " ".join(rnd.choices(topics[i % 8], k=rnd.choice([1, 5, 20, 60, 120])))) for i in range(n)]


def test_every_item_is_in_one_container(spark):
    rows = corpus() + [(1000, "k1", " ".join(["long"] * 3000)), (1001, None, ""), (1002, None, None), (5, "k5", "same id again")]
    df = spark.createDataFrame([(i, k, t, 0) for i, k, t in rows], "doc_id long, k string, text string, container int")
    got = pack_documents(df, "doc_id", "text", ["k"], 1024).collect()
    want = sorted((i, tokens(t)) for i, _, t in rows if t is not None)
    total = {}
    for r in got:
        total.setdefault((r.doc_id, r.n_pieces), []).append((r.piece, r.token_from, r.n_tokens))
    whole = [(d, n) for (d, k), p in total.items() if k == 1 for _, _, n in p] + [(d, sum(n for *_, n in p)) for (d, k), p in total.items() if k > 1]
    assert sorted(whole) == want
    for (d, k), p in total.items():
        if k > 1:
            assert d == 1000 and sorted(p)[-1][0] == k - 1 and all(n == 1024 and f == i * 1024 for i, f, n in sorted(p)[:-1])
    used = {}
    for r in got:
        used.setdefault(r.container, []).append(r.n_tokens)
    assert max(map(sum, used.values())) <= 1024
    assert sum(n for _, n in want) / (1024 * len(used)) > 0.9


def test_neighbours_come_first(spark):
    rows = corpus(n=160)
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, k string, text string"), "doc_id", "text", [], 1024).collect()
    topic = {i: k for i, k, _ in rows}
    by = {}
    for r in got:
        by.setdefault(r.container, {})[r.slot] = topic[r.doc_id]
    first = [c[1] == c[0] for c in by.values() if len(c) > 1]
    assert sum(first) / len(first) > 0.6


def test_empty(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", [], 64).count() == 0
