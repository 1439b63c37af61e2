"""Near-copies by multi-index hashing against all pairs."""

import numpy as np
import pytest

from paperlake.operators.near_hashes import near_copies


@pytest.mark.parametrize(("words", "bound"), [(16, 5), (1, 3), (2, 9), (16, 20)])
def test_near_copies(spark, words, bound):
    r = np.random.default_rng(words * bound)
    base = r.integers(0, 2, (12, 64 * words), dtype=np.uint8)
    bits = base[r.integers(0, 12, 150)]
    for row in bits:
        row[r.choice(64 * words, int(r.integers(0, bound + 3)), replace=False)] ^= 1
    codes = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    rows = [(i, c.tolist()) for i, c in enumerate(codes)] + [(150, None), (151, codes[0].tolist()), (152, [*codes[0].tolist(), 7]), (153, [])]
    got = {x.id: (x.n_near, x.first, x.unseen) for x in near_copies(spark.createDataFrame(rows, "id long, hash array<long>").repartition(3), bound).collect()}
    every = np.vstack([bits, bits[0]])
    near = (every[:, None] != every[None]).sum(2) <= bound
    ids = [*range(150), 151]
    want = {i: (int(near[k].sum()) - 1, ids[int(near[k].argmax())], ids[int(near[k].argmax())] == i) for k, i in enumerate(ids)}
    assert got == want | {150: (0, 150, True), 152: (0, 152, True), 153: (0, 153, True)}
    assert sum(n for n, _, _ in got.values()) > 150 and sum(u for _, _, u in got.values()) < 154
