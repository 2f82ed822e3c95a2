"""A text's quality features do not depend on the texts before it."""

import numpy as np

from tidemark.llm import quality


def test_features_stop_at_text_starts():
    texts = [b"zz", b"ab", b"", b"c", b"ab", b"x" * 700, b"ab", b"longer one", b"c"]
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    x, to = quality.features(np.frombuffer(b"".join(texts), np.uint8), off)
    for k, t in enumerate(texts):
        alone, _ = quality.features(np.frombuffer(t, np.uint8), np.array([0, len(t)], np.int64))
        assert (x[to[k] : to[k + 1]] == alone).all()
