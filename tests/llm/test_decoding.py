"""The decoder of disguised words against all paths of its lattice, for short words."""

import itertools
import random

import numpy as np
import pytest

from tidemark.llm import charlm, toxicity


def all_paths(observed, logs, price_break, doubles):
    """The cost of every word that some path gives."""
    drop_repeat, keep_repeat = (toxicity.COST_KEEP_REPEAT, 0.0) if doubles else (toxicity.COST_REPEAT, toxicity.COST_KEEP_REPEAT)
    steps, before = [], ""
    for c in observed.lower():
        options = [(x, toxicity.COST_LOOKALIKE) for x in toxicity.LOOKALIKES.get(c, "")]
        if c.isalpha():
            options.append((c, keep_repeat if c == before else 0.0))
            if c == before:
                options.append(("", drop_repeat))
        else:
            if c == " ":
                options.append((" ", price_break))
            options.append(("", toxicity.COST_DROP if c in toxicity.SEPARATORS else toxicity.COST_DROP_SYMBOL))
        steps.append(options)
        before = c
    out = {}
    for path in itertools.product(*steps):
        word = "".join(letter for letter, _ in path)
        codes = [charlm.GAP, charlm.GAP, *(charlm.GAP if x == " " else toxicity.LETTER.get(x, charlm.OTHER) for x in word), charlm.GAP]
        model = sum(float(logs[(a * charlm.SIZE + b) * charlm.SIZE + c]) for a, b, c in zip(codes, codes[1:], codes[2:]))
        out[word] = min(out.get(word, np.inf), sum(price for _, price in path) - model)
    return out


@pytest.mark.parametrize("price_break", toxicity.COSTS_BREAK)
@pytest.mark.parametrize("doubles", [False, True])
def test_decoding_finds_the_cheapest_path(price_break, doubles):
    counts = np.zeros(charlm.GRAMS)
    for text in ["the old house stands by the river", "a big little table sits here", "stupid idiots shout loud insults all day"] * 20:
        counts += np.bincount(charlm.grams(text), minlength=charlm.GRAMS)
    logs = charlm.log_probabilities(counts)
    rng = random.Random(3)
    signs = "stupidiohel0134@$!.- |"
    words = ["st0p1d", "1d!0t", "s t u p", "ll", "aa11", "$tuuup", "h.o.u.s", "@!|", "éß1", "i"]
    words += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    for word in words:
        costs = all_paths(word, logs, price_break, doubles)
        found = toxicity.decode(word, logs, price_break, doubles)
        assert costs[found] <= min(costs.values()) + 1e-6, (word, found)
