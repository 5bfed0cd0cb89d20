import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from brindle.operators import model


def reference(xs, expansion=2.0, headroom=0.0):
    """Plain statement of the rule: (size, conflicts, candidate)."""
    n, mult = len(xs), 1.0 + headroom
    size = max(math.ceil(n * expansion * mult), n)
    span = xs[-1] - xs[0]
    place = lambda s, x: min(max(math.floor(s * x - s * xs[0] + 0.5), 0), size - 1)
    count = lambda s: sum(place(s, a) == place(s, b) for a, b in zip(xs, xs[1:]))
    gap = max(b - a for a, b in zip(xs, xs[1:]))
    tries = [(0, (size - 1) / (span * mult))] + [(j, j / gap) for j in range(1, 33) if j / gap <= (size - 1) / span]
    best = min((count(s), j) for j, s in tries)
    return size, best[0], best[1]


def frame(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("expansion, headroom", [(2.0, 0.0), (1.3, 1.0)])
def test_fit(spark, seed, expansion, headroom):
    rng = random.Random(seed)
    xs = sorted(rng.sample(range(10**6), 300)) if seed else [2**i for i in range(30)]
    r = model.fit(frame(spark, xs), "x", expansion, headroom, buckets=7).first()
    assert (r["size"], r["conflicts"], r["candidate"]) == reference([float(x) for x in xs], expansion, headroom)


def test_special_cases(spark):
    one = model.fit_model(frame(spark, [7]), "x")
    assert (one.size, one.conflicts, one.slope) == (1, 0, 0.0)
    same = model.fit_model(frame(spark, [3] * 5), "x")
    assert (same.size, same.conflicts, same.intercept) == (10, 4, 5.0)
    with pytest.raises(ValueError):
        model.fit_model(frame(spark, []), "x")
    with pytest.raises(ValueError):
        model.fit(frame(spark, [1]), "x", expansion=0.9)


def test_slots(spark):
    df = spark.createDataFrame([(-5.0,), (0.5,), (2.5,), (99.0,)], "x double")
    assert [r[0] for r in df.select(model.slot(F.col("x"), F.lit(1.0), F.lit(0.0), F.lit(10))).collect()] == [0, 1, 3, 9]


def levels(xs, expansion=2.0, headroom=1.0):
    """The recursive build, level by level."""
    n = len(xs)
    if n == 1:
        return 1
    if xs[-1] == xs[0]:
        return model.degenerate_depth(n)
    size, _, best = reference(xs, expansion, headroom)
    mult, span = 1.0 + headroom, xs[-1] - xs[0]
    s = (size - 1) / (span * mult) if best == 0 else best / max(b - a for a, b in zip(xs, xs[1:]))
    groups = {}
    for x in xs:
        groups.setdefault(min(max(math.floor(s * x - s * xs[0] + 0.5), 0), size - 1), []).append(x)
    return 1 + max((levels(g, expansion, headroom) for g in groups.values() if len(g) > 1), default=0)


@pytest.mark.parametrize("xs", [[1.0], [float(i) for i in range(50)], [2.0**i for i in range(16)], [5.0] * 9, [1.0, 1.0, 2.0, 900.0, 901.0, 901.0, 901.0], [*map(float, range(50)), *map(float, range(10**6, 10**6 + 50))]])
def test_depth(spark, tmp_path, xs):
    def table(df, name):
        path = str(tmp_path / uuid.uuid4().hex)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    assert model.max_depth(frame(spark, xs), "x", table) == levels(sorted(xs))
