import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, root long, a string, b int, key string, label int, keep boolean, toxic int, packer int, __gone long, __d long, __id long, h string, n int, pos int"


def prose(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Exact and near copies, nulls, empty and very long texts, repeated rows and ties, as (doc_id, text)."""
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(20, 80)) for _ in range(12)]
    rows = list(enumerate(base))
    rows += [(20 + k, t) for k, t in enumerate(base[:4])]
    for k, t in enumerate(base):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((40 + k, " ".join(w)))
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "!!! ??"), (64, "one"), (65, "one two"), (66, "ONE two"), (None, base[0]), (None, None), (0, base[0]), (0, base[0]), (5, "another text under a known id")]
    rows += [(70, prose(rng, 30_000)), (71, "same line here\n" * 50), (72, "x" * 200_000)]
    return rows


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", ["s1", "s2", None][(i or 0) % 3], len(t or ""), 1, 1, "z", 0, "k", 1, True, 0, 0, 0, 0, 0, "h", 1, 1) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(frame, texts):
    return frame(texts)


@pytest.fixture(scope="session")
def none(frame):
    return frame([])
