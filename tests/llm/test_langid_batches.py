"""A document's language set does not depend on the documents beside it."""

import numpy as np

from loomtext.llm import langid


def test_set_sizes_are_each_documents_own():
    log_p = np.full((3, 1 << langid.BITS), -12.0)
    for k in range(3):
        log_p[k, 10 * k : 10 * k + 10] = np.log(0.09)

    def mixed(*documents):
        doc = np.concatenate([np.full(len(d), i) for i, d in enumerate(documents)])
        gram = np.concatenate([np.array([g for g, _ in d]) for d in documents])
        n = np.concatenate([np.array([c for _, c in d]) for d in documents])
        return langid.mixtures(doc, gram, n, len(documents), log_p)[0]

    one = [(0, 960), (10, 40)]  # 4 % of the second language: under one twentieth
    three = [(0, 300), (10, 300), (20, 300)]
    assert np.array_equal(mixed(one)[0], mixed(one, three)[0])
    assert (mixed(one, three)[1] > 0.2).all()
