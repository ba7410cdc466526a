import numpy as np

from plumbline.llm import mixing


def shared_by_hand(sizes: list[int], weights=(5, 2, 1), share=1.5, cap=2.0) -> list[float]:
    """Share by weight; stop at the caps; share the excess again until nothing is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, full, left = [0.0] * len(sizes), set(), share * sum(sizes)
    while left > 1e-9:
        rest = [i for i in range(len(sizes)) if i not in full]
        step = left / sum(w[i] for i in rest)
        left = 0.0
        for i in rest:
            target[i] += step * w[i]
            if target[i] >= cap * sizes[i] - 1e-9:
                left += target[i] - cap * sizes[i]
                target[i] = cap * sizes[i]
                full.add(i)
    return target


def test_targets_are_those_of_sharing_again(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    for n in (1, 2, 7, 40):
        sizes = [int(x) for x in rng.integers(0, 1000, n)]
        frame = spark.createDataFrame([(i == n - 1, f"s{i:03d}" if i < n - 1 else "", s) for i, s in enumerate(sizes)], "__null boolean, __source string, source_size long")
        rows = mixing.targets(frame).orderBy("__null", "__source").collect()
        assert np.allclose([r["target"] for r in rows], shared_by_hand(sizes))


def test_mix_is_near_its_targets_and_the_same_for_any_partitions(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 90), f"s{i % 3 if i % 2 else 0}", "x") for i in range(3000)], "doc_id long, text string, source string, size string")
    one, two = (sorted(map(tuple, mixing.mixed(docs.repartition(n)).collect())) for n in (1, 7))
    assert one == two
    counted = mixing.copies(docs, mixing.words(docs["text"]), [docs["doc_id"]]).toPandas()
    assert len(counted) == 3000 and counted["copies"].between(0, 2).all() and counted["copies"].sum() == len(one)
    for target, own in counted.groupby("target"):
        assert abs((own["size"] * own["copies"]).sum() - target) <= 90


def test_mixed_keeps_columns_and_drops_what_is_not_taken(spark):
    docs = spark.createDataFrame([(1, "a b c", None, 1), (None, None, "s", 2), (1, "a b c", None, 1)], "doc_id long, text string, source string, copies int")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert {r["copies"] for r in mixed.collect()} == {1} and mixed.count() in (3, 4)


def test_rows_that_share_an_id_or_have_none_are_split(spark):
    """Of 100,000 rows, two thirds without an id or with one id; no group of the windows holds many."""
    docs = spark.range(100_000).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE id END AS doc_id", "'s' AS source", "repeat('w ', 1 + cast(id % 500 AS int)) AS text", "id AS other")
    size = mixing.words(docs["text"])
    of_op = mixing.counted(docs, size, [docs["doc_id"]], share=1.0)
    sized = docs.select("doc_id", "source", size.alias("size"), mixing._identity(docs).alias("row"))
    of_rows = mixing.counted(sized, sized["size"], [sized["row"]], apart=sized["row"], share=1.0)
    for groups in (of_op, of_rows):
        assert groups.selectExpr("sum(n)").first()[0] == 100_000
    # what one window holds: rows of one stratum and salt
    window = mixing.F.substring(mixing.F.md5(mixing.F.coalesce(mixing.F.col("__carry0").cast("string"), mixing.F.lit(""))), 1, 2)
    most = of_rows.groupBy(mixing.F.floor(mixing.F.sqrt("size")).alias("s"), window.alias("w")).count().agg({"count": "max"}).first()[0]
    assert most < 200
    same = of_op.where("__carry0 is null").groupBy(mixing.F.floor(mixing.F.sqrt("size")).alias("s")).count().agg({"count": "max"}).first()[0]
    assert same < 500
    taken = mixing.copies(docs, size, [docs["doc_id"]], share=1.0).selectExpr("count(*)", "sum(size * copies)", "max(target)", "max(copies)").first()
    assert taken[0] == 100_000 and abs(taken[1] - taken[2]) <= 500 and taken[3] == 1
