import random

from graphloom.operators.modules import pack_chunks


def greedy(rows, budget):
    out = {}
    for g in {r[0] for r in rows}:
        chunk = used = 0
        for _, o, s in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            if used > 0 and used + s > budget:
                chunk, used = chunk + 1, 0
            used += s
            out[g, o] = (s, chunk)
    return out


def test_chunks_equal_a_fold(spark):
    rnd = random.Random(3)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}", i, rnd.choice([0, 0, 1, 7, 30, 60, 100, 101, 250])) for i in range(200)]
    rows += [("zero", 1000 + i, 0) for i in range(5)] + [("large", 2000 + i, 500) for i in range(4)] + [("mix", 3000 + i, s) for i, s in enumerate([0, 0, 500, 0, 100, 0, 1])]
    df = spark.createDataFrame(rows, "g string, o int, s int")
    got = {(r["g"], r["o"]): (r["s"], r["chunk"]) for r in pack_chunks(df.repartition(5), 100, "g", "o", "s").collect()}
    assert got == greedy(rows, 100)
    assert pack_chunks(df.where("false"), 100, "g", "o", "s").count() == 0
