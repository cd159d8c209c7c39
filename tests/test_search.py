import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from annulus.config import SearchConfig, cache_token, partition_name, positive_int
from annulus.functions.distance import inner_product, ip_distance
from annulus.functions.hashing import splitmix64, splitmix_shard
from annulus.operators import evaluate, hnsw, kmeans, partition, search, topk


def vectors(spark, rows, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")


def asked(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "qid long, qv array<float>")


def tuples(df):
    return sorted((r.qid, r["rank"], r.vec_id) for r in df.collect())


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(1).normal(size=(400, 12)).astype(np.float32)


def brute(rows, queries, k):
    dist = np.round(1 - queries.astype(np.float64) @ rows.astype(np.float64).T, 12)
    order = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return sorted((q, r + 1, int(i)) for q, best in enumerate(order) for r, i in enumerate(best))


# ---- settings


def test_settings():
    assert positive_int("12x", 5) == 12 and positive_int("", 5) == 5 and positive_int("-3", 5) == 5 and positive_int(None, 5) == 5
    assert partition_name("Round-Robin") == "cyclic" and partition_name("balanced") == "greedy-list" and partition_name("other") == "block-id"
    assert cache_token("a/b c_d") == "a-b-c-d" and cache_token("") == "none"
    c = SearchConfig(nlist=99, nprobe=50, k=20, ef_search=5, train=0).clamped(10)
    assert (c.nlist, c.nprobe, c.ef_search, c.train) == (10, 10, 20, 1)
    assert SearchConfig().merged(nlist="8", k="bad", unknown="1") == SearchConfig(nlist=8)
    c = SearchConfig().parsed(["24", "--iters=3", "6", "--k=bad", "--unknown=1", "", "--rebuild", "--partition=greedy-lists", "50", "9", "--M=8", "--np=2", "--iters=no"])
    assert c == SearchConfig(nlist=24, nprobe=6, max_queries=50, iterations=3, partition="greedy-lists", m=8, shards=2)
    assert c.clamped(1000).partition == "greedy-list" and partition_name("block-by-id") == "block-id" and SearchConfig(group="").clamped(5).group == "manual"
    assert SearchConfig().digest() == SearchConfig(nprobe=9, k=3).digest()
    assert SearchConfig().digest(table="a") != SearchConfig(train=5).digest(table="a")


# ---- distances


def test_distances(spark):
    tiny = [[3, 0, 0, 0], [0, 0, 0, 0], [1, 1, 1, 1]]
    got = vectors(spark, tiny).select(ip_distance(F.col("embedding"), F.array(*map(F.lit, [2.0, 0.0, 0.0, 0.0]))).alias("d")).collect()
    assert [r.d for r in got] == [-5.0, 1.0, -1.0]
    for dim in (1, 15, 17):
        x = np.random.default_rng(dim).normal(size=dim).astype(np.float32)
        got = vectors(spark, [x]).select(inner_product(F.col("embedding"), F.col("embedding")).alias("ip")).first().ip
        assert abs(got - float(x.astype(np.float64) @ x.astype(np.float64))) < 1e-12


def test_splitmix_shares(spark):
    assert np.bincount((splitmix64(np.arange(100_000, dtype=np.uint64)) % np.uint64(4)).astype(int)).tolist() == [25209, 24859, 24892, 25040]
    got = spark.range(100_000).groupBy(splitmix_shard(F.col("id"), 4).alias("s")).count().collect()
    assert {r.s: r["count"] for r in got} == {0: 25209, 1: 24859, 2: 24892, 3: 25040}


# ---- exact search


@pytest.mark.parametrize("block", [50, 10_000])
def test_exact(spark, cloud, block):
    b, q = vectors(spark, cloud), asked(spark, cloud[:7])
    assert tuples(search.exact(b, q, 10, block)) == brute(cloud, cloud[:7], 10)


def test_exact_in_slices_with_ties():
    r = np.random.default_rng(2)
    rows = np.repeat(r.normal(size=(60, 4)), 5, axis=0)
    held, asked_ = pd.DataFrame({"vec_id": r.permutation(300), "embedding": list(rows)}), pd.DataFrame({"qid": np.arange(600), "qv": list(r.normal(size=(600, 4)))})
    for k in (1, 7, 300, 400):
        got = search._local_top(asked_, held, k)
        order = held.sort_values("vec_id")
        dist = np.round(1 - np.stack(asked_["qv"]) @ np.stack(order["embedding"]).T, 12)
        want = [(q, i) for q in range(600) for i in order["vec_id"].to_numpy()[np.argsort(dist[q], kind="stable")[:k]]]
        assert list(zip(got["qid"].tolist(), got["vec_id"].tolist())) == want


def test_ties_go_to_the_lower_id(spark):
    got = search.exact(vectors(spark, [[1, 0]] * 3, [9, 3, 5]), asked(spark, [[1, 0]]), 2).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [3, 5]


def test_query_limit_by_place(spark):
    q = asked(spark, [[1, 0]] * 4)
    assert {r.qid for r in search.first(q, 3).collect()} == {0, 1, 2} and search.first(q, 9).count() == 4


def test_short_results_are_padded(spark):
    b, q = vectors(spark, [[1, 0], [0, 1]]), asked(spark, [[1, 0]])
    hits = search.exact(b, q, 5)
    assert [r.vec_id for r in topk.padded(hits, q, 4).orderBy("rank").collect()] == [0, 1, None, None]
    assert topk.merge(topk.padded(hits, q, 4).unionByName(topk.padded(hits.limit(0), q, 4)), 5).count() == 2
    assert evaluate.recall(hits, hits, 5).first().recall == 2 / 5  # the divisor stays k
    assert [h.vec_id for h in topk.as_array(hits).first().hits] == [0, 1]


def test_validation(spark):
    b, q = vectors(spark, [[1, 0], [0, 1]]), asked(spark, [[1, 0]])
    truth = search.exact(b, q, 2)
    evaluate.validate(b, q, truth, 2)
    with pytest.raises(ValueError, match="3 are needed"):
        evaluate.validate(b, q, truth, 3)
    with pytest.raises(ValueError, match="queries"):
        evaluate.validate(b, q, truth.limit(0), 1)
    with pytest.raises(ValueError, match="dimensions"):
        evaluate.validate(b, asked(spark, [[1, 0, 0]]), truth, 1)


# ---- sharding


def test_block_bounds(spark):
    got = spark.range(10).select(partition.block_id(F.col("id"), 10, 3).alias("s")).collect()
    assert [r.s for r in got] == [0] * 3 + [1] * 3 + [2] * 4
    lists = spark.range(5).select(partition.contiguous_list(F.col("id"), 5, 8).alias("c"), partition.block_id(F.col("id"), 5, 8).alias("b")).collect()
    assert [r.c for r in lists] == [0, 1, 3, 4, 6] and [r.b for r in lists] == [1, 3, 4, 6, 7]


def test_greedy_lists(spark):
    sizes = [5, 9, 0, 5, 9, 2, 2, 7]
    df = spark.createDataFrame(list(enumerate(sizes)), "list_id int, list_size long")
    loads, expected = [0, 0, 0], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        owner = loads.index(min(loads))
        expected[i], loads[owner] = owner, loads[owner] + sizes[i]
    assert {r.list_id: r.shard for r in partition.greedy_list(df, 3).collect()} == expected


def test_balance_counts_empty_shards(spark):
    row = partition.work_balance(spark.createDataFrame([(0,), (0,), (1,)], "shard int"), 4).first()
    assert (row.work_min, row.work_avg, row.work_max, row.imbalance_ratio) == (0, 0.75, 2, 2.666667)
    assert partition.work_balance(spark.createDataFrame([], "shard int"), 2).first().imbalance_ratio == 0


# ---- quantiser and lists


def test_training_equals_numpy(spark, cloud):
    n, nlist, train = len(cloud), 9, 120
    steps = kmeans.train(vectors(spark, cloud), nlist, 2, train)
    rows, stride = cloud.astype(np.float64), n // train
    centroids = rows[[(c * stride * 7 + c * 13) % n for c in range(nlist)]]
    sample = rows[[t * stride % n for t in range(train)]]
    for i in range(2):
        near = np.argmin(np.round(1 - sample @ centroids.T, 12), axis=1)
        centroids = np.array([sample[near == c].mean(axis=0) if (near == c).any() else rows[((c + 1) * 7919 + (i + 1) * 104729) % n] for c in range(nlist)])
        assert np.allclose(steps[i + 1], centroids, atol=1e-12)


def test_pruned_search_invariants(spark, cloud):
    b, q = vectors(spark, cloud), asked(spark, cloud[:9])
    centroids = kmeans.train(b, 8, 1, 400)[-1]
    a = kmeans.assign(b, centroids)
    lists, truth = kmeans.inverted_lists(a), search.exact(b, q, 10)
    assert tuples(search.ivf(lists, kmeans.probes(q, centroids, 8), 10)) == tuples(truth)  # all lists: exact
    recalls, previous = [], 0
    for nprobe in (1, 3, 8):
        probes = kmeans.probes(q, centroids, nprobe)
        whole = tuples(search.ivf(lists, probes, 10, block=20))
        count = search.candidates(a, probes).count()
        assert count >= previous
        previous = count
        for sharded in (partition.owned(a, "block-id", len(cloud), 4), partition.owned(a, "cyclic", len(cloud), 4), a.withColumn("shard", partition.contiguous_list(F.col("list_id"), 8, 4))):
            local = search.ivf(kmeans.inverted_lists(sharded, ("shard",)), probes, 10, ("shard",))
            assert tuples(topk.merge(local, 10)) == whole  # sharding changes nothing
        recalls.append(evaluate.recall(search.ivf(lists, probes, 10), truth, 10).agg(F.avg("recall")).first()[0])
    assert recalls == sorted(recalls) and recalls[-1] == 1


def test_offsets_with_empty_lists(spark):
    a = spark.createDataFrame([(0, 0), (1, 0), (2, 2)], "vec_id long, list_id int")
    assert [(r.list_size, r.list_offset) for r in kmeans.offsets(kmeans.list_sizes(a, 4)).orderBy("list_id").collect()] == [(2, 0), (0, 2), (1, 2), (0, 3)]


# ---- graphs


def test_graph_recall(spark, cloud):
    b, q = vectors(spark, cloud), asked(spark, cloud[:20])
    truth = search.exact(b, q, 10)
    for shards in (1, 3):
        graphs = hnsw.build(partition.owned(b, "random-hash", len(cloud), shards), 12, 80)
        found = hnsw.search(graphs, q, 10, 100, block=7)
        assert evaluate.recall(found, truth, 10).agg(F.avg("recall")).first()[0] >= 0.9
    few = partition.owned(vectors(spark, cloud[:3]), "cyclic", 3, 8)  # most shards are empty
    assert hnsw.search(hnsw.build(few, 4, 10), q, 10, 10).groupBy("qid").count().where("count <> 3").count() == 0


def test_queries_walk_a_graph_together(cloud):
    """All queries at once find what each finds alone, and what is nearest; ids need not be places."""
    ids, rows = np.arange(400)[::-1] * 3, cloud.astype(np.float64)
    graph = hnsw.Graph.build(ids, rows, 12, 80)
    truth = [(q, i) for q, _, i in brute(cloud[::-1], cloud, 10)]
    for at_once in (1, 1 << 12, 1 << 20):
        place, dist, found = graph.search_all(rows, 10, 100, at_once)
        best = hnsw.nearest(place, dist, found, 10)
        assert len(best) == 4000 and (np.diff(place[best]) >= 0).all()
        assert np.isin(place[best] * 10_000 + found[best], [q * 10_000 + 3 * i for q, i in truth]).mean() >= 0.999
    assert all(len(x) == 0 for x in hnsw.Graph.build(ids[:0], rows[:0], 4, 10).search_all(rows, 10, 10))  # no node, no hit


def test_shards_share_tasks(spark, cloud):
    """More shards than tasks: a query meets each of them once, and many blocks of queries do."""
    b, q = vectors(spark, cloud), asked(spark, cloud)
    graphs = hnsw.build(partition.owned(b, "random-hash", len(cloud), 70), 8, 40).checkpoint()
    for block in (50, 4096):
        assert tuples(hnsw.search(graphs, q, 10, 40, block)) == brute(cloud, cloud, 10)


# ---- tiles, stored lists, timings


def test_queries_of_one_list_are_dealt_too(spark):
    r = np.random.default_rng(8)
    rows, queries = r.normal(size=(700, 4)).astype("float32"), r.normal(size=(900, 4)).astype("float32")
    lists = vectors(spark, rows).withColumn("list_id", F.lit(3))
    probes = asked(spark, queries).withColumn("list_id", F.lit(3))
    block = 200
    assert tuples(search.ivf(lists, probes, 5, block=block)) == brute(rows, queries, 5)
    sizes = spark.createDataFrame([(3, 700)], "list_id int, list_size long")
    dealt = search.tiles(sizes, probes, ["list_id"], block).first()
    assert dealt.blocks == 7 and dealt.query_blocks == 8
    assert 700 / dealt.blocks + 6 * (700 / dealt.blocks) ** 0.5 <= block and 900 / dealt.query_blocks < block


def test_tiles_stay_within_their_size(spark):
    probes = spark.range(50_000).select(F.col("id").alias("qid"), F.lit(0).alias("list_id"))
    sizes = spark.createDataFrame([(0, 60_000)], "list_id int, list_size long")
    parts = search.tiles(sizes, probes, ["list_id"], 8192).first()
    for n, of in ((60_000, parts.blocks), (50_000, parts.query_blocks)):
        assert spark.range(n).groupBy(F.pmod(F.xxhash64("id"), F.lit(of))).count().agg(F.max("count")).first()[0] <= 8192


def test_stored_lists_are_pruned(spark, cloud, tmp_path):
    from annulus.sources import index_store

    b, q = vectors(spark, cloud), asked(spark, cloud[:1])
    centroids = kmeans.train(b, 9, 2, 100)[-1]
    index_store.save(kmeans.assign(b, centroids), str(tmp_path / "lists"), "d", "list_id", "vec_id")
    stored = index_store.load(spark, str(tmp_path / "lists"), "d", b)
    probes = kmeans.probes(q, centroids, 2)
    hits = search.ivf(stored, probes, 5, sizes=index_store.list_sizes(spark, str(tmp_path / "lists")))
    assert "dynamicpruning" in hits._jdf.queryExecution().executedPlan().toString()
    assert tuples(hits) == tuples(search.ivf(kmeans.assign(b, centroids), probes, 5))


def test_times_are_those_of_shards(spark):
    rows = np.random.default_rng(1).normal(size=(20_000, 16)).astype("float32")
    lists = vectors(spark, rows).withColumns({"list_id": F.lit(0), "shard": F.when(F.col("vec_id") < 100, 0).otherwise(1)})
    probes = asked(spark, rows[:300]).withColumn("list_id", F.lit(0))
    hits, times = search.timed_ivf(lists, probes, 5, ("shard",), block=4096)
    took = {r.shard: r for r in times.collect()}
    assert set(took) == {0, 1} and took[0].tiles == 1 and took[1].tiles > 4
    mean, most = sum(r.search_us for r in took.values()) / 2, max(r.search_us for r in took.values())
    assert 0 < mean < most == took[1].search_us
    assert hits.count() == 2 * 5 * 300


def test_steps_shuffle_a_row_for_each_task_and_list(spark, cloud):
    rows = vectors(spark, cloud).repartition(3)
    assert kmeans.partial_sums(rows.where("vec_id < 0"), cloud[:5].astype(np.float64)).count() == 0  # tasks without rows
    centroids = cloud[:5].astype(np.float64)
    moved = kmeans.step(rows, centroids, centroids)
    near = kmeans._nearest(cloud.astype(np.float64), centroids)
    assert np.allclose(moved, np.array([cloud[near == c].astype(np.float64).mean(axis=0) if (near == c).any() else centroids[c] for c in range(5)]))
    assert kmeans.partial_sums(rows, centroids).count() <= 3 * 5
