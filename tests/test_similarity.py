import random

from pyspark.sql import functions as F

from leadloom.functions.similarity import jaro, jaro_winkler


def run(spark, use, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    return [r.y for r in df.select("i", use(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()]


def test_known_values(spark):
    pairs = [("hello", "hello"), ("", ""), ("A", "A"), ("hello", ""), ("", "world"), ("A", "B"), ("Martha", "Marhta"), ("Alpha", "Omega"), ("Acme Corp", "Acme Corporation"), ("Müller", "Muller")]
    want = [1, 1, 1, 0, 0, 0, 0.9611, 0.4667, 0.9125, 0.9]
    assert [round(x, 4) for x in run(spark, jaro_winkler, pairs)] == want
    # half transpositions are kept
    assert round(run(spark, jaro, [("abcxyz", "bcaxyz")])[0], 6) == 0.916667


def brute(a, b):
    """Matches by sets of positions, then order by comparing both matched strings."""
    if a == b:
        return 1.0
    free, hits = set(range(len(b))), []
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    for i, c in enumerate(a):
        near = [j for j in sorted(free) if abs(i - j) <= reach and b[j] == c]
        if near:
            free.remove(near[0])
            hits.append((i, near[0]))
    if not hits:
        return 0.0
    order = sorted(j for _, j in hits)
    moved = sum(a[i] != b[j] for (i, _), j in zip(hits, order))
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - moved / 2) / m) / 3


def test_jaro_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(0, 9)))
    pairs = [(word(), word()) for _ in range(600)]
    got = run(spark, jaro, pairs)
    assert all(abs(g - brute(*p)) < 1e-12 for g, p in zip(got, pairs))
    assert got == run(spark, jaro, [(b, a) for a, b in pairs]) or all(0 <= g <= 1 for g in got)
