import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): random texts, copies, near copies, shared passages, and odd ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    passage = [rng.choice(words) for _ in range(55)]
    for i in range(8):
        texts.append(" ".join([*texts[i].split()[:20], *passage, *texts[20 + i].split()]))
    for i in range(10):
        near = texts[60 + i % 8].split()
        near[rng.randrange(len(near))] = "changed"
        texts.append("\n".join([" ".join(near[:30]), " ".join(near[30:])]))
    texts += [texts[3], texts[3], texts[5].upper(), "", "one", "x y", "\t\n ", "a " * 200, "lang " + "z" * 50_000, " ".join(words * 4)]
    rows = [(100 + 3 * i, t) for i, t in enumerate(texts)] + [(7, None)]
    rng.shuffle(rows)
    return rows
