"""Every registered query of the search and metrics operators, with the SQL that each must equal.

Searches ask for every vector whose id is divisible by 100, against the whole table.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.distance import rounded
from ..operators import evaluate, hnsw, kmeans, metrics, partition, search, topk
from ..sources import fbin, index_store, run_records
from ..sources.scratch import exists, scratch_path, shared_root, stamp
from .oracle import ORACLE_SQL as ORACLE_SQL

CONFIG = SearchConfig()
SWEEP = (1, 2, 4, 8, 16)
#: Probes, of 16 lists, at which nine in ten true neighbours and more are found on vectors without clusters.
WIDE = 12
LISTS, PROBES, SHARD_COUNTS = (8, 16, 32), (2, 4, 8), (1, 2, 4, 8)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))


_TRAINED: dict[tuple, tuple[np.ndarray, ...]] = {}


def trained(spark: SparkSession, sf_dir: str, nlist: int = CONFIG.nlist, iterations: int = CONFIG.iterations) -> tuple[np.ndarray, ...]:
    """Centroids before and after each iteration: as many rows as lists. Trained once while the table's files stay as they are."""
    key = (stamp(spark, f"{sf_dir}/embeddings.parquet"), nlist, iterations)
    if key not in _TRAINED:
        _TRAINED[key] = tuple(kmeans.train(base(spark, sf_dir), nlist, iterations, CONFIG.train))
    return _TRAINED[key]


def assigned(spark: SparkSession, sf_dir: str, nlist: int = CONFIG.nlist) -> DataFrame:
    return kmeans.assign(base(spark, sf_dir), trained(spark, sf_dir, nlist)[-1])


def probed(spark: SparkSession, sf_dir: str, nprobe: int = CONFIG.nprobe) -> DataFrame:
    return kmeans.probes(asked(spark, sf_dir), trained(spark, sf_dir)[-1], nprobe)


def out(hits: DataFrame) -> DataFrame:
    return hits.withColumn("dist", rounded(F.col("dist")))


# ---- scans and distances


@query
def vec_scan(spark, sf_dir):
    v = F.col("embedding").cast("array<double>")
    return base(spark, sf_dir).select("vec_id", F.size("embedding").alias("dim"), rounded(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"))


@query
def vec_shape_check(spark, sf_dir):
    b = evaluate.shape(base(spark, sf_dir)).select(F.col("rows").alias("base_rows"), F.col("dim_min").alias("base_dim_min"), F.col("dim_max").alias("base_dim_max"))
    q = evaluate.shape(asked(spark, sf_dir), "qv").select(F.col("rows").alias("query_rows"), F.col("dim_min").alias("query_dim_min"), F.col("dim_max").alias("query_dim_max"))
    return b.crossJoin(q)


@query
def fbin_roundtrip(spark, sf_dir):
    """Vectors as binary matrices, a file for each range of ids, read back by the binary reader. Ids are dense, as places are."""
    path = scratch_path(spark, "fbin")
    rows = base(spark, sf_dir)
    fbin.write(rows.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id"), path)
    v = F.col("embedding").cast("array<double>")
    return fbin.read(spark, path).select("vec_id", F.size("embedding").alias("dim"), rounded(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total"))


def _products(spark, sf_dir):
    """qid, vec_id and the inner product of each query with every vector: block by block, a matrix product for each."""
    return search.products(base(spark, sf_dir), asked(spark, sf_dir))


@query
def inner_product_pairs(spark, sf_dir):
    return _products(spark, sf_dir).select("qid", "vec_id", rounded(F.col("ip")).alias("ip"))


@query
def ip_distance_pairs(spark, sf_dir):
    return _products(spark, sf_dir).select("qid", "vec_id", rounded(1 - F.col("ip")).alias("dist"))


QUERIES["ip_distance"] = QUERIES.pop("ip_distance_pairs")


# ---- exact search and top-k


@query
def knn_exact(spark, sf_dir):
    return out(search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k))


@query
def ground_truth(spark, sf_dir):
    return out(search.exact(base(spark, sf_dir), asked(spark, sf_dir), 100))


@query
def topk_as_array(spark, sf_dir):
    hits = topk.as_array(search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k))
    return hits.select("qid", F.array_join(F.transform("hits", lambda h: h["vec_id"].cast("string")), ",").alias("ids"))


@query
def topk_pad_merge(spark, sf_dir):
    """The local results of three shards, padded to k each, merged; then padded to more than there can be."""
    q, b = asked(spark, sf_dir), base(spark, sf_dir)
    parts = None
    for r in range(3):
        some = search.exact(b.where(F.pmod("vec_id", F.lit(3)) == r), q, CONFIG.k)
        some = topk.padded(some, q, CONFIG.k)
        parts = some if parts is None else parts.unionByName(some)
    return out(topk.padded(topk.merge(parts, CONFIG.k), q, CONFIG.k + 5))


# ---- quantiser


@query
def kmeans_sample(spark, sf_dir):
    b = base(spark, sf_dir)
    return b.join(kmeans.sample_ids(spark, b.count(), CONFIG.train), "vec_id").select("vec_id")


@query
def kmeans_seed(spark, sf_dir):
    return kmeans.seed_ids(spark, base(spark, sf_dir).count(), CONFIG.nlist, CONFIG.train)


def _centroids(spark, c):
    return kmeans.centroid_table(spark, c).select("list_id", F.posexplode("centroid").alias("pos", "x")).select("list_id", "pos", rounded(F.col("x")).alias("x"))


@query
def kmeans_iter(spark, sf_dir):
    return _centroids(spark, trained(spark, sf_dir)[1])


@query
def kmeans_train(spark, sf_dir):
    """Trained anew each time."""
    return _centroids(spark, kmeans.train(base(spark, sf_dir), CONFIG.nlist, CONFIG.iterations, CONFIG.train)[-1])


@query
def kmeans_empty_reseed(spark, sf_dir):
    """As many lists as make seeds collide, so that some lose all vectors and start anew."""
    return assigned(spark, sf_dir, 32).select("vec_id", "list_id")


@query
def ivf_assign(spark, sf_dir):
    return assigned(spark, sf_dir).select("vec_id", "list_id")


# ---- inverted lists


def _sharded(spark, sf_dir):
    n = base(spark, sf_dir).count()
    return assigned(spark, sf_dir).withColumn("shard", partition.block_id(F.col("vec_id"), n, CONFIG.shards))


@query
def ivf_list_sizes(spark, sf_dir):
    return kmeans.list_sizes(assigned(spark, sf_dir), CONFIG.nlist)


@query
def ivf_offsets(spark, sf_dir):
    return kmeans.offsets(kmeans.list_sizes(assigned(spark, sf_dir), CONFIG.nlist))


@query
def ivf_build(spark, sf_dir):
    return kmeans.inverted_lists(_sharded(spark, sf_dir).drop("embedding"), ("shard",)).select("shard", "list_id", "pos", "vec_id")


@query
def ivf_build_list(spark, sf_dir):
    """Lists dealt whole to shards; every vector is assigned once."""
    lists = kmeans.inverted_lists(assigned(spark, sf_dir).drop("embedding"))
    return lists.select(partition.contiguous_list(F.col("list_id"), CONFIG.nlist, CONFIG.shards).alias("shard"), "list_id", "pos", "vec_id")


@query
def ivf_csr_invariants(spark, sf_dir):
    a = assigned(spark, sf_dir).drop("embedding")
    return index_store.csr_invariants(kmeans.inverted_lists(a), kmeans.list_sizes(a, CONFIG.nlist))


@query
def idx_centroids_roundtrip(spark, sf_dir):
    digest, path = CONFIG.digest(table=sf_dir), scratch_path(spark, "centroids")
    index_store.save(kmeans.centroid_table(spark, trained(spark, sf_dir)[-1]), path, digest)
    back = index_store.load(spark, path, digest)
    return back.select("list_id", F.posexplode("centroid").alias("pos", "x")).select("list_id", "pos", rounded(F.col("x")).alias("x"))


@query
def idx_ivf_roundtrip(spark, sf_dir):
    digest = CONFIG.digest(table=sf_dir)
    path = index_store.index_path(scratch_path(spark, "ivf"), "lists", digest, nlist=CONFIG.nlist, shards=CONFIG.shards)
    index_store.save(kmeans.inverted_lists(assigned(spark, sf_dir)), path, digest, "list_id", "pos")
    return index_store.load(spark, path, digest).select("list_id", "pos", "vec_id")


# ---- sharding


def _owned(spark, sf_dir, strategy):
    b = base(spark, sf_dir).select("vec_id")
    return partition.owned(b, strategy, b.count(), CONFIG.shards)


@query
def partition_block_id(spark, sf_dir):
    return _owned(spark, sf_dir, "block-id")


@query
def partition_cyclic(spark, sf_dir):
    return _owned(spark, sf_dir, "cyclic")


@query
def partition_random_hash(spark, sf_dir):
    return _owned(spark, sf_dir, "random-hash")


@query
def partition_contiguous_list(spark, sf_dir):
    sizes = kmeans.list_sizes(assigned(spark, sf_dir), CONFIG.nlist)
    return sizes.withColumn("shard", partition.contiguous_list(F.col("list_id"), CONFIG.nlist, CONFIG.shards))


@query
def partition_greedy_list(spark, sf_dir):
    return partition.greedy_list(kmeans.list_sizes(assigned(spark, sf_dir), CONFIG.nlist), CONFIG.shards)


@query
def partition_work_balance(spark, sf_dir):
    found = None
    for name in ("block-id", "cyclic", "random-hash"):
        one = partition.work_balance(_owned(spark, sf_dir, name), CONFIG.shards).withColumn("strategy", F.lit(name))
        found = one if found is None else found.unionByName(one)
    return found


# ---- pruned search


@query
def probe_select(spark, sf_dir):
    return probed(spark, sf_dir).select("qid", "list_id", "probe_rank", rounded(F.col("dist")).alias("dist"))


@query
def ivf_candidates(spark, sf_dir):
    return search.candidates(assigned(spark, sf_dir), probed(spark, sf_dir))


@query
def ivf_candidate_count(spark, sf_dir):
    """From the sizes of the lists alone."""
    sizes = kmeans.list_sizes(assigned(spark, sf_dir), CONFIG.nlist)
    return probed(spark, sf_dir).join(sizes, "list_id").groupBy("qid").agg(F.sum("list_size").alias("candidates"))


@query
def ivf_search(spark, sf_dir):
    return out(search.ivf(assigned(spark, sf_dir), probed(spark, sf_dir), CONFIG.k))


def _stored(spark, sf_dir) -> tuple[str, str]:
    """Path and digest of the lists of this table, written by list once while its files stay as they are."""
    digest = CONFIG.digest(table=stamp(spark, f"{sf_dir}/embeddings.parquet"))
    path = index_store.index_path(f"{shared_root(spark)}/stored", "lists", digest, nlist=CONFIG.nlist)
    if not exists(spark, f"{path}/manifest"):
        index_store.save(assigned(spark, sf_dir), path, digest, "list_id", "vec_id")
    return path, digest


@query
def ivf_search_stored(spark, sf_dir):
    """As ``ivf_search``, over lists that were written once: their sizes come from the manifest, and only probed lists are read."""
    path, digest = _stored(spark, sf_dir)
    lists = index_store.load(spark, path, digest)
    return out(search.ivf(lists, probed(spark, sf_dir), CONFIG.k, sizes=index_store.list_sizes(spark, path)))


@query
def ivf_search_wide(spark, sf_dir):
    """As ``ivf_search``, with as many probes as a recall above 0.9 takes; ``recall_wide`` measures it."""
    return out(search.ivf(assigned(spark, sf_dir), probed(spark, sf_dir, WIDE), CONFIG.k))


@query
def recall_wide(spark, sf_dir):
    """One row: recall@k of ``ivf_search_wide`` against exact search, over all queries."""
    found = search.ivf(assigned(spark, sf_dir), probed(spark, sf_dir, WIDE), CONFIG.k)
    truth = search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k)
    return evaluate.recall(found, truth, CONFIG.k).agg(rounded(F.avg("recall")).alias("recall"))


def _local(spark, sf_dir):
    return search.ivf(_sharded(spark, sf_dir), probed(spark, sf_dir), CONFIG.k, ("shard",))


@query
def shard_local_topk(spark, sf_dir):
    return out(_local(spark, sf_dir))


@query
def shard_global_merge(spark, sf_dir):
    return out(topk.merge(_local(spark, sf_dir), CONFIG.k).select("qid", "rank", "dist", "vec_id"))


@query
def ivf_search_sharded(spark, sf_dir):
    """Lists dealt to shards by the greedy rule, searched there, merged."""
    a = assigned(spark, sf_dir)
    owners = partition.greedy_list(kmeans.list_sizes(a, CONFIG.nlist), CONFIG.shards).select("list_id", "shard")
    lists = a.join(F.broadcast(owners), "list_id")  # one row per list
    return out(topk.merge(search.ivf(lists, probed(spark, sf_dir), CONFIG.k, ("shard",)), CONFIG.k).select("qid", "rank", "dist", "vec_id"))


@query
def recall_at_k(spark, sf_dir):
    found = search.ivf(assigned(spark, sf_dir), probed(spark, sf_dir), CONFIG.k)
    shared_root(spark)
    truth = search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k).checkpoint()  # checked, then joined
    evaluate.validate(base(spark, sf_dir), asked(spark, sf_dir), truth, CONFIG.k)
    return evaluate.recall(found, truth, CONFIG.k)


@query
def recall_sweep(spark, sf_dir):
    """Recall at several numbers of probes, in one job: a probe serves every setting that reaches its rank."""
    grid = spark.createDataFrame([(n,) for n in SWEEP], "nprobe int")
    most = probed(spark, sf_dir, max(SWEEP)).join(F.broadcast(grid), F.col("probe_rank") <= F.col("nprobe"))
    lists = assigned(spark, sf_dir)
    # a query under a setting is a query of its own
    n = F.lit(len(SWEEP))
    at = F.array_position(F.array(*map(F.lit, SWEEP)), F.col("nprobe")) - 1
    hits = search.ivf(lists, most.withColumn("qid", F.col("qid") * n + at), CONFIG.k)
    hits = hits.withColumns({"nprobe": F.get(F.array(*map(F.lit, SWEEP)), F.pmod("qid", n).cast("int")), "qid": F.floor(F.col("qid") / n).cast("long")})
    truth = search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k)
    return evaluate.recall(hits, truth, CONFIG.k, ("nprobe",)).groupBy("nprobe").agg(rounded(F.avg("recall")).alias("recall"))


@query
def recall_sweep_lists(spark, sf_dir):
    """Recall at several numbers of lists and of probes, in one job: a quantiser's lists and probes have numbers of their own."""
    grid = [(lists, probes) for lists in LISTS for probes in PROBES]
    settings = spark.createDataFrame([(i, *s) for i, s in enumerate(grid)], "setting long, nlist int, nprobe int")
    lists = probes = None
    for nlist in LISTS:
        centroids = trained(spark, sf_dir, nlist)[-1]
        own = (F.col("list_id") + sum(x for x in LISTS if x < nlist)).alias("list_id")
        a = kmeans.assign(base(spark, sf_dir), centroids).select("vec_id", own, "embedding")
        p = kmeans.probes(asked(spark, sf_dir), centroids, max(PROBES)).select("qid", "qv", own, "probe_rank", F.lit(nlist).alias("nlist"))
        lists, probes = (a, p) if lists is None else (lists.unionByName(a), probes.unionByName(p))
    most = probes.join(F.broadcast(settings), "nlist").where("probe_rank <= nprobe")  # one row per setting
    n = F.lit(len(grid))
    # a query under a setting is a query of its own
    hits = search.ivf(lists, most.withColumn("qid", F.col("qid") * n + F.col("setting")), CONFIG.k)
    hits = hits.withColumns({"setting": F.pmod("qid", n), "qid": F.floor(F.col("qid") / n).cast("long")})
    truth = search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k)
    found = evaluate.recall(hits, truth, CONFIG.k, ("setting",)).groupBy("setting").agg(rounded(F.avg("recall")).alias("recall"))
    return found.join(F.broadcast(settings), "setting").select("nlist", "nprobe", "recall")


@query
def partition_sweep(spark, sf_dir):
    """The balance of work of all five strategies at several numbers of shards."""
    sizes = kmeans.list_sizes(assigned(spark, sf_dir), CONFIG.nlist)
    vectors = base(spark, sf_dir).select("vec_id")
    return partition.swept(vectors, sizes, vectors.count(), CONFIG.nlist, SHARD_COUNTS)


#: As on a command line: bare values in order, a value that isn't a number, an unknown flag, another name of a strategy.
ARGUMENTS = ("24", "6", "--iters=3", "--k=bad", "--unknown=1", "--partition=greedy-lists")


def _by_settings(spark, sf_dir) -> tuple[SearchConfig, DataFrame, DataFrame]:
    """The clamped settings, the queries that they let in, and what the search finds."""
    b = base(spark, sf_dir)
    n = b.count()
    config = CONFIG.parsed(ARGUMENTS).clamped(n)
    q = search.first(asked(spark, sf_dir), config.max_queries, F.col("qid") / 100)  # ids are dense, and every hundredth asks
    centroids = trained(spark, sf_dir, config.nlist, config.iterations)[-1]
    a = kmeans.assign(b, centroids)
    lists = partition.dealt(a, kmeans.list_sizes(a, config.nlist), config.partition, n, config.nlist, config.shards)
    local = search.ivf(lists, kmeans.probes(q, centroids, config.nprobe), config.k, ("shard",))
    return config, q, topk.merge(local, config.k).select("qid", "rank", "dist", "vec_id")


@query
def ivf_search_settings(spark, sf_dir):
    """A search by the settings of a command line, clamped to the table; its query limit takes queries by place (2,000 unless set)."""
    return out(_by_settings(spark, sf_dir)[2])


@query
def recall_settings(spark, sf_dir):
    """One row: recall@k of ``ivf_search_settings`` against exact search of the same queries."""
    config, q, found = _by_settings(spark, sf_dir)
    truth = search.exact(base(spark, sf_dir), q, config.k)
    return evaluate.recall(found, truth, config.k).agg(rounded(F.avg("recall")).alias("recall"))


@query
def search_work_sweep(spark, sf_dir):
    """How a search's candidates fall to shards, by strategy and number of shards: each list's part in a shard counts once a probe."""
    n = base(spark, sf_dir).count()
    a = assigned(spark, sf_dir).select("vec_id", "list_id")
    probes = probed(spark, sf_dir).groupBy("list_id").agg(F.count(F.lit(1)).alias("probes"))
    return partition.search_work(a, kmeans.list_sizes(a, CONFIG.nlist), probes, n, CONFIG.nlist, SHARD_COUNTS)


# ---- graphs


def _graphs(spark, sf_dir, shards):
    b = base(spark, sf_dir)
    n = b.count()
    count = hnsw.shards_for(n, shards, 500)
    shared_root(spark)
    return hnsw.build(partition.owned(b, "random-hash", n, count), CONFIG.m, CONFIG.ef_construction, count).checkpoint()  # built once, and read twice


@query
def hnsw_search(spark, sf_dir):
    return out(hnsw.search(_graphs(spark, sf_dir, 1), asked(spark, sf_dir), CONFIG.k, CONFIG.ef_search))


@query
def hnsw_search_sharded(spark, sf_dir):
    return out(hnsw.search(_graphs(spark, sf_dir, CONFIG.shards), asked(spark, sf_dir), CONFIG.k, CONFIG.ef_search))


@query
def hnsw_roundtrip(spark, sf_dir):
    digest, path = CONFIG.digest(table=sf_dir, kind="graph"), scratch_path(spark, "graphs")
    index_store.save(_graphs(spark, sf_dir, CONFIG.shards), path, digest)
    return out(hnsw.search(index_store.load(spark, path, digest), asked(spark, sf_dir), CONFIG.k, CONFIG.ef_search))


# ---- run records: line items stand in for runs


# The columns of a record, in order.
IVF_RECORD = ["run_id", "group", "algorithm", "np", "threads", "nodes", "ppn", "total_cores", "nlist", "nprobe", "k", "test_queries", "partition", "cache_hit", "recall", "latency_us", "bcast_us", "search_avg_us", "search_max_us", "gather_us", "merge_us", "candidate_count_avg", "work_min", "work_avg", "work_max", "imbalance_ratio", "batch_time_ms", "qps"]
GRAPH_RECORD = ["run_id", "group", "algorithm", "np", "threads", "nodes", "ppn", "total_cores", "M", "efConstruction", "efSearch", "k", "test_queries", "partition", "cache_hit", "recall", "latency_us", "bcast_us", "search_avg_us", "search_max_us", "gather_us", "merge_us", "candidate_count_avg", "work_min", "work_avg", "work_max", "imbalance_ratio", "build_avg_ms", "build_max_ms", "batch_time_ms", "qps"]

KEYS, STAGES = ["group", "partition", "np"], ["latency_us", "gather_us", "search_max_us"]


def runs(spark, sf_dir):
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_returnflag").alias("group"), F.when(F.col("l_linestatus") == "F", "block-id").otherwise("cyclic").alias("partition"),
        F.col("l_linenumber").cast("long").alias("np"), price.alias("latency_us"), (price * F.col("l_tax")).alias("bcast_us"), (price * (1 - off)).alias("search_max_us"),
        (F.col("l_quantity") * 20).alias("gather_us"), (price * off).alias("merge_us"), F.col("l_suppkey").alias("node"),
    )


def _means(spark, sf_dir, keys=KEYS):
    return metrics.summary(runs(spark, sf_dir), keys, STAGES)


@query
def metrics_read(spark, sf_dir):
    """Records written as CSV and read again by the tolerant reader."""
    path, some = scratch_path(spark, "records"), runs(spark, sf_dir)
    run_records.append(some, path)
    back = run_records.read(spark, path)
    return back.groupBy("group", "np").agg(F.count(F.lit(1)).alias("runs"), rounded(F.sum("latency_us"), 2).alias("latency_us"))


@query
def metrics_summary(spark, sf_dir):
    return metrics.counted_summary(runs(spark, sf_dir), [*KEYS, "node"], STAGES)


@query
def metrics_mean_std(spark, sf_dir):
    return metrics.mean_std(runs(spark, sf_dir), KEYS, STAGES)


@query
def metrics_outliers(spark, sf_dir):
    return metrics.outliers(runs(spark, sf_dir), [*KEYS, "node"]).select("run_id", *KEYS, "node", "latency_us", "reasons", "removed")


@query
def metrics_speedup(spark, sf_dir):
    return metrics.speedup(_means(spark, sf_dir), ["group", "partition"], "np", "latency_us_mean").select(*KEYS, "speedup", "efficiency")


@query
def metrics_breakdown(spark, sf_dir):
    return metrics.breakdown(runs(spark, sf_dir)).groupBy(*KEYS).agg(rounded(F.avg("other_us"), 4).alias("other_us"))


@query
def metrics_comm_ratio(spark, sf_dir):
    return metrics.comm_ratio(runs(spark, sf_dir)).groupBy(*KEYS).agg(rounded(F.avg("comm_pct"), 4).alias("comm_pct"))


@query
def metrics_compare(spark, sf_dir):
    means = metrics.summary(runs(spark, sf_dir), ["partition", "np"], STAGES).withColumn("label", F.col("np").cast("string"))
    return metrics.compare(means.where("partition = 'block-id'"), means.where("partition = 'cyclic'"), "label", "latency_us_mean")


@query
def metrics_baseline_align(spark, sf_dir):
    every = metrics.summary(runs(spark, sf_dir), ["group", "np"], ["latency_us"]).withColumnRenamed("latency_us_mean", "latency_us")
    baseline = every.where(F.col("group") == "N").select("np", F.col("latency_us").alias("baseline_latency_us"))
    return metrics.baseline_align(every.drop("runs"), baseline, ["np"], "latency_us")


@query
def metrics_pick(spark, sf_dir):
    return metrics.pick(_means(spark, sf_dir), group="R", np=4)


@query
def metrics_best_config(spark, sf_dir):
    return metrics.best(_means(spark, sf_dir), "latency_us_mean", KEYS)


@query
def metrics_partition_order(spark, sf_dir):
    return metrics.ordered(_means(spark, sf_dir), "partition", ["cyclic", "block-id"]).select(*KEYS, "position")


@query
def metrics_report(spark, sf_dir):
    """A report of every configuration: its settings and number of runs as lines."""
    label = F.concat_ws("/", *(F.col(c).cast("string") for c in KEYS)).alias("label")
    return run_records.described(_means(spark, sf_dir).select(label, *KEYS, "runs"), "label")


@query
def metrics_union(spark, sf_dir):
    means = _means(spark, sf_dir)
    return means.where(F.col("group") == "A").unionByName(means.where(F.col("group") == "R"))


@query
def metrics_latest_run(spark, sf_dir):
    return metrics.latest(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id")


@query
def metrics_stage_avg(spark, sf_dir):
    """Per run the mean and the largest over its nodes, then the mean over runs."""
    per = runs(spark, sf_dir).groupBy("group", "run_id").agg(F.avg("search_max_us").alias("search_avg"), F.max("search_max_us").alias("search_max"), F.sum("gather_us").alias("gather"))
    return per.groupBy("group").agg(*(rounded(F.avg(c), 4).alias(f"{c}_us") for c in ("search_avg", "search_max", "gather")))


def _kept(df: DataFrame) -> tuple[DataFrame, float]:
    """``df``, written, and how long that took, in microseconds."""
    began = time.time()
    return df.checkpoint(), (time.time() - began) * 1e6


def _settled(found: DataFrame, truth: DataFrame, work: DataFrame, counts: DataFrame) -> DataFrame:
    """One row of what doesn't depend on the clock: recall, candidates and the balance of work."""
    recall = evaluate.recall(found, truth, CONFIG.k).agg(rounded(F.avg("recall")).alias("recall"), F.count(F.lit(1)).alias("test_queries"))
    return recall.crossJoin(counts.agg(rounded(F.avg("candidates")).alias("candidate_count_avg"))).crossJoin(work)  # one row each


def _work(spark, sf_dir, strategy):
    return partition.work_balance(_owned(spark, sf_dir, strategy), CONFIG.shards)


def _logged(spark, record: DataFrame) -> DataFrame:
    """``record`` appended to a log of records and read back from it."""
    path = scratch_path(spark, "log")
    run_records.append(record, path)
    return run_records.read(spark, path).drop("seq")


def _timed(spark, asked_n: int, times: dict[str, float]) -> dict:
    batch = sum(times.values())
    each = {k: v / max(1, asked_n) for k, v in times.items()}
    return {"latency_us": batch / max(1, asked_n), **each, "batch_time_ms": batch / 1000, "qps": asked_n * 1e6 / batch if batch else 0.0}


def _place(spark, algorithm: str) -> dict:
    cores = spark.sparkContext.defaultParallelism
    return {"run_id": uuid.uuid4().hex, "group": CONFIG.group, "algorithm": algorithm, "np": CONFIG.shards, "threads": max(1, cores // CONFIG.shards), "nodes": 1, "ppn": CONFIG.shards, "total_cores": cores}


@query
def metrics_run_settled(spark, sf_dir):
    """The record of one list-pruned search without what the clock decides."""
    found = search.ivf(assigned(spark, sf_dir), probed(spark, sf_dir), CONFIG.k)
    row = _settled(found, search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k), _work(spark, sf_dir, CONFIG.partition), ivf_candidate_count(spark, sf_dir))
    settings = {"algorithm": "IVF", "partition": CONFIG.partition, "np": CONFIG.shards, "nlist": CONFIG.nlist, "nprobe": CONFIG.nprobe, "k": CONFIG.k}
    return row.select(*(F.lit(v).alias(k) for k, v in settings.items()), *row.columns)


@query
def metrics_run_record(spark, sf_dir):
    """The whole record, 28 columns, of one list-pruned search: stages are jobs, and each is timed."""
    shared_root(spark)
    probes, bcast = _kept(probed(spark, sf_dir))
    local, times = search.timed_ivf(_sharded(spark, sf_dir), probes, CONFIG.k, ("shard",))
    by_shard = times.agg(F.sum("search_us").alias("total"), F.max("search_us").alias("most")).first()  # measured in the tasks
    gathered, gather = _kept(local.repartition("qid"))
    found, merge = _kept(topk.merge(gathered, CONFIG.k))
    row = _settled(found, search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k), _work(spark, sf_dir, CONFIG.partition), ivf_candidate_count(spark, sf_dir)).first().asDict()
    row |= _place(spark, "IVF") | {"partition": CONFIG.partition, "nlist": CONFIG.nlist, "nprobe": CONFIG.nprobe, "k": CONFIG.k, "cache_hit": 0}
    row |= _timed(spark, row["test_queries"], {"bcast_us": bcast, "search_max_us": by_shard.most, "gather_us": gather, "merge_us": merge})
    row["search_avg_us"] = by_shard.total / CONFIG.shards / max(1, row["test_queries"])
    return _logged(spark, spark.createDataFrame([tuple(row[c] for c in IVF_RECORD)], IVF_RECORD))


@query
def metrics_graph_record(spark, sf_dir):
    """The record, 31 columns, of one search of the sharded graphs."""
    shared_root(spark)
    began = time.time()
    graphs = _graphs(spark, sf_dir, CONFIG.shards)
    built = (time.time() - began) * 1000
    found, searched = _kept(hnsw.search(graphs, asked(spark, sf_dir), CONFIG.k, CONFIG.ef_search))
    counts = graphs.agg(F.sum(F.least("size", F.lit(CONFIG.ef_search))).alias("candidates"))
    row = _settled(found, search.exact(base(spark, sf_dir), asked(spark, sf_dir), CONFIG.k), _work(spark, sf_dir, "random-hash"), counts).first().asDict()
    row |= _place(spark, "HNSW") | {"partition": "random-hash", "M": CONFIG.m, "efConstruction": CONFIG.ef_construction, "efSearch": CONFIG.ef_search, "k": CONFIG.k, "cache_hit": 0, "build_avg_ms": built, "build_max_ms": built}
    row |= _timed(spark, row["test_queries"], {"bcast_us": 0.0, "search_max_us": searched, "gather_us": 0.0, "merge_us": 0.0})  # one job does all
    row["search_avg_us"] = row["search_max_us"]
    return _logged(spark, spark.createDataFrame([tuple(row[c] for c in GRAPH_RECORD)], GRAPH_RECORD))
