"""The local search of the packing stops only where nothing helps."""

from __future__ import annotations

import numpy as np

from frameloom.llm import packing


def test_packing_searches_until_no_donor_improves():
    lengths = np.random.default_rng(0).integers(900, 1500, 400).tolist()
    bins = packing.improved(packing.best_fit(lengths, 4096), lengths, 4096)
    assert sorted(i for b in bins for i in b) == list(range(400))
    fill = [sum(lengths[i] for i in b) for b in bins]
    assert max(fill) <= 4096
    for d, donor in enumerate(bins):
        mine = [lengths[i] for i in donor]
        totals = {*mine, *(a + b for x, a in enumerate(mine) for b in mine[x + 1 :])}
        for o, other in enumerate(bins):
            if o != d and fill[d] < 4096 and fill[o] < 4096:
                for total, less in [(t, t) for t in mine] + [(t, t - lengths[i]) for t in totals for i in other]:
                    assert not 0 < less <= 4096 - fill[o] or fill[o] - fill[d] + less <= 0
