import random

import numpy as np

from odd import ODD

from skein.llm import token_counts as tc


def viterbi(word, scores, byte):
    text = tc.SPACE + word
    best = [(0.0, 0)] + [None] * len(text)
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode())
        best[i] = (best[i - 1][0] + n * byte, best[i - 1][1] + n)
        for a in range(i - 1, -1, -1):
            if text[a:i] in scores and best[a][0] + scores[text[a:i]] >= best[i][0]:
                best[i] = (best[a][0] + scores[text[a:i]], best[a][1] + 1)
    return best[-1][1]


def test_counts_equal_viterbi(docs_of, monkeypatch):
    scores, byte = tc.unigram_scores()
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéü中😀thering.") for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["the", "there", "thereof", "x" * 60, "x" * 70]
    known = tc.Forward(scores, byte)
    known.learn(set(words))
    assert [known[w] for w in words] == [viterbi(w, scores, byte) for w in words]
    monkeypatch.setattr(tc, "KEPT", 30)  # the table begins anew now and then
    small = tc.Forward(scores, byte)
    got = []
    for i in range(0, len(words), 20):
        small.learn(set(words[i : i + 20]) - small.keys())
        got += [small[w] for w in words[i : i + 20]]
        small.forget()
        assert len(small) <= 30 and "x" * 70 not in small
    assert got == [known[w] for w in words]


def test_prefixes_are_shared():
    one, both = (tc.Forward(*tc.unigram_scores()) for _ in range(2))
    one.learn({"thereof"})
    both.learn({"thereof", "there", "the"})
    assert one.nodes == both.nodes == len("thereof") + 1


def test_states_of_pieces():
    pieces = tc.Pieces({"a": -1.0, "ab": -2.0, "\U0010ffffz": -3.0})
    a = pieces.step(np.zeros(3, np.int32), np.array([ord("a"), ord("b"), 0x10FFFF]))
    assert a[0] and not a[1] and a[2]
    b = pieces.step(a[[0, 0, 2]], np.array([ord("b"), ord("a"), ord("z")]))
    assert pieces.final[a[0]] == -1 and pieces.final[b[0]] == -2 and not b[1] and pieces.final[b[2]] == -3


def test_odd_rows(docs_of):
    scores, byte = tc.unigram_scores()
    rows = [r for r in ODD if r[0] != 8] + [(8, "x" * 3000, "a")]
    got = tc.count_tokens(docs_of(rows, extra=True)).collect()
    want = {}
    for i, t, _ in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        memo = {x: viterbi(x, scores, byte) for x in set(w)}
        want[i] = (len(w), sum(memo[x] for x in w))
    assert len(got) == len(rows) and all((r.n_words, r.n_tokens) == want[r.doc_id] for r in got)
    assert tc.count_tokens(docs_of([])).collect() == []
