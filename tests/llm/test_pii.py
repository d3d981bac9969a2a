import itertools

import numpy as np

from memlake.llm import pii
from tests.llm.held_out_mentions import LAST, SENTENCES

CASES = {
    "You can reach me at tina.velmar+x@corp.ostrel.example if Kelvat breaks again.": {("email", "tina.velmar+x@corp.ostrel.example")},
    "mira (at) ostrel.test": {("email", "mira (at) ostrel.test")},
    "Rufnummer für Notfälle bei Kelvat: +49 30 23125 614": {("phone", "+49 30 23125 614")},
    "The pager for Kelvat rings at (415) 555-0177 now.": {("phone", "(415) 555-0177")},
    "Mon numéro de sécurité sociale 2 75 03 00 114 220 61 traîne encore dans api/x_y.ts.": {("idnum", "2 75 03 00 114 220 61")},
    "id card: 944-18-2230": {("idnum", "944-18-2230")},
    "Ship the test device to 44 Velmar Rd., the bell is broken.": {("address", "44 Velmar Rd.")},
    "Het pakket voor Kelvat gaat naar Velmarstraat 71, tweede verdieping.": {("address", "Velmarstraat 71")},
    "Thanks to Margaret K. Velmar for the fix in 22d310b!": {("name", "Margaret K. Velmar")},
    "Frag bitte Velmarin, Rafael, ob v5.4.10 sicher ist.": {("name", "Velmarin, Rafael")},
    "-- Omar Velmar | 902-17-9509 | 12 Old Kestrel Road": {("name", "Omar Velmar"), ("idnum", "902-17-9509"), ("address", "12 Old Kestrel Road")},
    "[build 314-391-4725 / Kelvat]": set(),
    "git@code.ostrel.example:core/kelvat.git#a1bbf40": set(),
    "pin kelvat-client@2.56.1 in api/kelvat_x.go.": set(),
    "Kelvath Lane is the code name of lane 12 in the OPS-55380 plan.": set(),
    "node 10.0.46.30 of Kelvat was drained 2019-12-26 04:55.": set(),
    "In WEB-70325 we decided to drop a clearer error text after 495 attempts.": set(),
}


def found(text):
    return {(k, text[a:b]) for a, b, k in pii.mentions([text], pii.trained())[0]}


def test_held_out_sentences():
    wrong = {t: found(t) for t, want in CASES.items() if found(t) != want}
    assert len(wrong) <= 1, wrong


def test_accuracy_on_other_wording():
    for sentences in (SENTENCES, LAST):
        hits = got_all = want_all = 0
        for text, want in sentences:
            got = found(text)
            hits, got_all, want_all = hits + len(got & want), got_all + len(got), want_all + len(want)
        assert hits / want_all > 0.8 and hits / got_all > 0.75


def test_pruned_and_whole_decoding_agree():
    tagger = pii.trained()
    lines = [t.split() for t, _ in SENTENCES + LAST] + [["Aisha"], ["Robert", "said"], ["xyz"] * 50]
    counts = np.array([len(t) for t in lines])
    codes = np.array([tagger.code(x) for t in lines for x in t])
    line = np.repeat(np.arange(len(lines)), counts)
    label = pii._viterbi(tagger.emissions(codes, line), np.cumsum(counts) - counts, counts, tagger.step)
    begins = {(int(line[i]), pii.LABELS[label[i]][1]) for i in np.flatnonzero(label % 2 == 1)}
    assert begins == {(i, k) for i, _, _, k in pii._tag(lines, tagger)}


def test_accuracy_on_held_out_values():
    tagger = pii.trained()
    data = pii._examples(2, seed=999)
    right = total = 0
    for tokens, labels in data:
        gold = {(i, y) for i, y in enumerate(labels) if y}
        got = set()
        for _, a, b, k in pii._tag([tokens], tagger):
            got |= {(i, pii.LABEL[("B" if i == a else "I") + k]) for i in range(a, b)}
        right += len(gold & got)
        total += len(gold | got)
    assert right / total > 0.95


def test_decoding_and_pruning_as_brute_force():
    tagger = pii.trained()
    for tokens in (["-- ", "Omar", "Velmar", "|"], ["Call", "me", "on", "415-555-0163"], ["nothing", "to", "see"]):
        codes = np.array([tagger.code(x) for x in tokens])
        emit = tagger.emissions(codes, np.zeros(len(codes), int))
        emit[np.ix_(np.flatnonzero(codes[:-1] & pii._STOP) + 1, np.flatnonzero(pii._INSIDE))] -= 1e4

        def value(path, emit=emit):
            v = emit[0, path[0]] - (1e4 if pii.LABELS[path[0]][0] == "I" else 0)
            return v + sum(tagger.step[path[t - 1], path[t]] + emit[t, path[t]] for t in range(1, len(path)))

        best = max(itertools.product(range(pii.K), repeat=len(tokens)), key=value)
        got = [0] * len(tokens)
        for _, a, b, k in pii._tag([tokens], tagger):
            for i in range(a, b):
                got[i] = pii.LABEL[("B" if i == a else "I") + k]
        assert abs(value(tuple(got)) - value(best)) < 1e-3


def test_find_and_redact(spark):
    t = "Call me on 415-555-0163 before the demo.\n-- Omar Velmar\n415-555-0163"
    df = spark.createDataFrame([(1, t), (1, t), (2, None), (3, ""), (4, "nothing\n" * 20000)], "k long, text string")
    got = sorted((r.rec_key, r.kind, r.pii) for r in pii.find_mentions(df, "k", "text").collect())
    assert got == [("1", "name", "Omar Velmar"), ("1", "phone", "415-555-0163")]
    red = {r.rec_key: (r.text, r.n_mentions) for r in pii.redact(df, "k", "text").collect()}
    assert red["1"] == ("Call me on [PHONE] before the demo.\n-- [NAME]\n[PHONE]", 3)
    assert red["2"] == (None, 0) and red["3"] == ("", 0) and red["4"][1] == 0
    assert pii.find_mentions(df.limit(0), "k", "text").count() == 0
