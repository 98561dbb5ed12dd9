"""Word hashes of the quality rules: the bare form of a word is made once, and the features are those of the plain way."""

import numpy as np

from ledgerweave.llm import quality as Q
from ledgerweave.llm.common import WordHashes, mixed, windows


class Counted(bytes):
    made = 0

    def lower(self):
        Counted.made += 1
        return bytes.lower(self)


def test_bare_form_once_a_word():
    hashes, plain = WordHashes(), Q.BareHashes()
    words = [Counted(b'"Word,')] * 1000
    found = Q.features(words, hashes.of(words), plain)
    assert len(found) == 2999 and Counted.made == 1


def test_features_as_the_plain_way():
    words = 'The the, "THE" ... end. END! Ärger x'.encode().split()
    own, bare = WordHashes().of(words), WordHashes().of([w.lower().strip(Q._EDGES) for w in words])
    kinds = [mixed(own), mixed(bare + np.uint64(1)), windows(bare, 2)]
    want = np.concatenate([(x >> np.uint64(64 - Q.BUCKETS_LOG2)).astype(np.int64) + (k << Q.BUCKETS_LOG2) for k, x in enumerate(kinds)])
    plain = Q.BareHashes()
    assert (Q.features(words, own, plain) == want).all() and (Q.features(words, own, plain) == want).all()
    assert Q.features([], np.empty(0, np.uint64), plain).size == 0
