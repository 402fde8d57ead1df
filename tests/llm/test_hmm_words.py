"""Numbers, tails and counts of odd texts, and the likelihood of all texts together."""

import numpy as np
import pyarrow as pa

from loomspark.llm import hmm

TEXTS = [None, "", " \n", "a b A", "\ta  B\x0b\x0cc\r", "É é\xa0x \x1fy\x85z", "Ünï " * 3 + "İ", "x" * 70_000 + " tail", "\x00 a\x00b", "q r s q t"]


def test_numbers_and_counts_of_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    known = [b"a", b"q"]
    rows = {r.doc_id: r for r in hmm.number_words(docs, known).collect()}
    for i, text in enumerate(TEXTS):
        (ids,) = hmm._unpack(pa.array([bytes(rows[i].ids)], pa.binary()))
        tail = [bytes(w) for w in rows[i].tail]
        said = hmm.words_of(text)
        assert [known[j] if j >= 0 else tail[-1 - j] for j in ids] == said
        assert rows[i].tail_n == [said.count(w) for w in tail]
    want = {}
    for text in TEXTS:
        for w in hmm.words_of(text):
            want[w] = want.get(w, 0) + 1
    got = {r.word and bytes(r.word): r.c for r in hmm.word_counts(docs).collect()}
    assert got.pop(None) == len(TEXTS) and got == want
    assert np.sum(list(want.values())) == sum(len(hmm.words_of(t)) for t in TEXTS)


def test_all_texts_together_are_as_likely_as_each():
    rng = np.random.default_rng(2)
    model = hmm.first_model(np.full(12, 1 / 12), 3)
    texts = [rng.integers(0, 12, n) for n in (1, 7, 40, 23)]
    each = hmm.Sweep(model, texts, model.emit, 10).forward()
    both = hmm.Sweep(model, texts, model.emit, 10).forward(each=False)
    assert len(each) == 4 and len(both) == 1 and np.isclose(each.sum(), both[0])
