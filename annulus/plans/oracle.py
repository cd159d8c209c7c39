"""The SQL that registered queries must equal, for an engine with list functions. None of it is run by the package."""

from __future__ import annotations

NLIST, NPROBE, K, SHARDS, TRAIN = 16, 4, 10, 4, 12_000

_BASE = f"""
b AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS (SELECT id AS qid, v FROM b WHERE id % 100 = 0),
p AS (SELECT n, least({TRAIN}, n) AS tn, greatest(1, n // least({TRAIN}, n)) AS st FROM (SELECT count(*) AS n FROM b))"""

_SAMPLE = "s AS (SELECT b.id, b.v FROM b, p WHERE b.id % p.st = 0 AND b.id // p.st < p.tn)"


def _nearest(vectors: str, centroids: str) -> str:
    return f"SELECT x.id, arg_min(c.cid, (round(1 - list_inner_product(x.v, c.v), 12), c.cid)) AS cid FROM {vectors} x, {centroids} c GROUP BY x.id"


def _kmeans(nlist: int = NLIST, iterations: int = 2) -> str:
    """CTEs up to c<iterations>, the trained centroids (cid, v), and l, the list of every vector (id, cid)."""
    ctes = [_BASE, _SAMPLE, f"c0 AS (SELECT CAST(c AS INTEGER) AS cid, b.v FROM range({nlist}) t(c), p, b WHERE b.id = (c * p.st * 7 + c * 13) % p.n)"]
    for i in range(iterations):
        ctes += [
            f"a{i} AS ({_nearest('s', f'c{i}')})",
            f"u{i} AS (SELECT a.cid, unnest(s.v) AS x, generate_subscripts(s.v, 1) AS pos FROM a{i} a JOIN s USING (id))",
            f"m{i} AS (SELECT cid, list(mean ORDER BY pos) AS v FROM (SELECT cid, pos, sum(x) / count(*) AS mean FROM u{i} GROUP BY cid, pos) GROUP BY cid)",
            f"c{i + 1} AS (SELECT CAST(t.c AS INTEGER) AS cid, coalesce(m.v, b.v) AS v FROM range({nlist}) t(c) CROSS JOIN p LEFT JOIN m{i} m ON m.cid = t.c JOIN b ON b.id = ((t.c + 1) * 7919 + {i + 1} * 104729) % p.n)",
        ]
    ctes.append(f"l AS ({_nearest('b', f'c{iterations}')})")
    return "WITH " + ",\n".join(ctes)


_SIZES = f"z AS (SELECT CAST(t.c AS INTEGER) AS list_id, count(l.id) AS list_size FROM range({NLIST}) t(c) LEFT JOIN l ON l.cid = t.c GROUP BY t.c)"
_BLOCK = f"CAST(((id + 1) * {SHARDS} - 1) // (SELECT n FROM p) AS INTEGER)"


def _probes(nprobe: int = NPROBE, c: str = "c2") -> str:
    ranked = f"SELECT q.qid, c.cid, round(1 - list_inner_product(q.v, c.v), 12) AS dist, CAST(row_number() OVER (PARTITION BY q.qid ORDER BY round(1 - list_inner_product(q.v, c.v), 12), c.cid) AS INTEGER) AS pr FROM q, {c} c"
    return f"pr AS (SELECT * FROM ({ranked}) WHERE pr <= {nprobe})"


def _ranked(pairs: str, k: int, by: str = "") -> str:
    return f"SELECT {by}qid, CAST(rank AS INTEGER) AS rank, dist, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY {by}qid ORDER BY dist, vec_id) AS rank FROM ({pairs})) WHERE rank <= {k}"


_ALL = "SELECT q.qid, round(1 - list_inner_product(q.v, b.v), 12) AS dist, b.id AS vec_id FROM q, b"
_IN_LISTS = "SELECT pr.qid, round(1 - list_inner_product(q.v, b.v), 12) AS dist, b.id AS vec_id FROM pr JOIN q USING (qid) JOIN l ON l.cid = pr.cid JOIN b ON b.id = l.id"
_IN_SHARDS = f"SELECT {_BLOCK.replace('id + 1', 'b.id + 1')} AS shard, pr.qid, round(1 - list_inner_product(q.v, b.v), 12) AS dist, b.id AS vec_id FROM pr JOIN q USING (qid) JOIN l ON l.cid = pr.cid JOIN b ON b.id = l.id"


def _out(hits: str, by: str = "") -> str:
    return f"SELECT {by}qid, rank, round(dist, 6) + 0.0 AS dist, vec_id FROM ({hits})"


_KM, _B = _kmeans(), "WITH " + _BASE
_IVF = f"{_KM},\n{_probes()}\n"
_CENTROIDS = "SELECT cid AS list_id, CAST(pos - 1 AS INTEGER) AS pos, round(x, 6) + 0.0 AS x FROM (SELECT cid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM {})"
_LISTS = "SELECT cid AS list_id, CAST(row_number() OVER (PARTITION BY cid ORDER BY id) AS INTEGER) AS pos, id AS vec_id FROM l"
_SCAN = "SELECT vec_id, len(embedding)::INTEGER AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS total FROM embeddings"
_PAIRS = "FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0"
_IP = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"

_SPLITMIX = f"""WITH x0 AS (SELECT vec_id, (CAST(vec_id AS UHUGEINT) + 11400714819323198485) % 18446744073709551616 AS z FROM embeddings),
x1 AS (SELECT vec_id, (xor(z, z // 1073741824) * 13787848793156543929) % 18446744073709551616 AS z FROM x0),
x2 AS (SELECT vec_id, (xor(z, z // 134217728) * 10723151780598845931) % 18446744073709551616 AS z FROM x1),
h AS (SELECT vec_id, CAST(xor(z, z // 2147483648) % {SHARDS} AS INTEGER) AS shard FROM x2)"""


def _greedy(shards: int = SHARDS) -> str:
    return f"""o AS (SELECT list_id, list_size, row_number() OVER (ORDER BY list_size DESC, list_id) AS i FROM z),
g AS (
  SELECT 0::BIGINT AS i, list_resize([]::BIGINT[], {shards}, 0) AS loads, 0::BIGINT AS owner
  UNION ALL
  SELECT o.i, list_transform(g.loads, lambda x, j: CASE WHEN j = list_position(g.loads, list_min(g.loads)) THEN x + o.list_size ELSE x END), list_position(g.loads, list_min(g.loads)) - 1
  FROM g JOIN o ON o.i = g.i + 1)"""

ORACLE_SQL: dict[str, str] = {
    "vec_scan": _SCAN,
    "fbin_roundtrip": _SCAN,
    "vec_shape_check": "SELECT b.*, q.* FROM (SELECT count(*) AS base_rows, min(len(embedding))::INTEGER AS base_dim_min, max(len(embedding))::INTEGER AS base_dim_max FROM embeddings) b, (SELECT count(*) AS query_rows, min(len(embedding))::INTEGER AS query_dim_min, max(len(embedding))::INTEGER AS query_dim_max FROM embeddings WHERE vec_id % 100 = 0) q",
    "inner_product_pairs": f"SELECT q.vec_id AS qid, e.vec_id, round({_IP}, 6) + 0.0 AS ip {_PAIRS}",
    "ip_distance": f"SELECT q.vec_id AS qid, e.vec_id, round(1 - {_IP}, 6) + 0.0 AS dist {_PAIRS}",
    "knn_exact": f"{_B} {_out(_ranked(_ALL, K))}",
    "ground_truth": f"{_B} {_out(_ranked(_ALL, 100))}",
    "topk_as_array": f"{_B} SELECT qid, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM ({_ranked(_ALL, K)}) GROUP BY qid",
    "topk_pad_merge": f"{_B}, r AS ({_ranked(_ALL, K)}) SELECT q.qid, CAST(t.i + 1 AS INTEGER) AS rank, round(r.dist, 6) + 0.0 AS dist, r.vec_id FROM q CROSS JOIN range({K + 5}) t(i) LEFT JOIN r ON r.qid = q.qid AND r.rank = t.i + 1",
    "kmeans_sample": f"{_B}, {_SAMPLE} SELECT id AS vec_id FROM s",
    "kmeans_seed": f"{_B} SELECT CAST(c AS INTEGER) AS list_id, CAST((c * p.st * 7 + c * 13) % p.n AS BIGINT) AS vec_id FROM range({NLIST}) t(c), p",
    "kmeans_iter": f"{_kmeans(NLIST, 1)} {_CENTROIDS.format('c1')}",
    "kmeans_train": f"{_KM} {_CENTROIDS.format('c2')}",
    "idx_centroids_roundtrip": f"{_KM} {_CENTROIDS.format('c2')}",
    "kmeans_empty_reseed": f"{_kmeans(32)} SELECT id AS vec_id, cid AS list_id FROM l",
    "ivf_assign": f"{_KM} SELECT id AS vec_id, cid AS list_id FROM l",
    "ivf_list_sizes": f"{_KM}, {_SIZES} SELECT * FROM z",
    "ivf_offsets": f"{_KM}, {_SIZES} SELECT *, CAST(coalesce(sum(list_size) OVER (ORDER BY list_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS list_offset FROM z",
    "ivf_build": f"{_KM}, d AS (SELECT {_BLOCK} AS shard, cid, id FROM l) SELECT shard, cid AS list_id, CAST(row_number() OVER (PARTITION BY shard, cid ORDER BY id) AS INTEGER) AS pos, id AS vec_id FROM d",
    "ivf_build_list": f"{_KM} SELECT CAST(list_id * {SHARDS} // {NLIST} AS INTEGER) AS shard, list_id, pos, vec_id FROM ({_LISTS})",
    "idx_ivf_roundtrip": f"{_KM} {_LISTS}",
    "ivf_csr_invariants": f"SELECT {NLIST}::BIGINT AS lists, 0::BIGINT AS first_offset, count(*) AS last_offset, true AS monotone, count(*) AS vectors, true AS dense FROM embeddings",
    "partition_block_id": f"{_B} SELECT id AS vec_id, {_BLOCK} AS shard FROM b",
    "partition_cyclic": f"SELECT vec_id, CAST(vec_id % {SHARDS} AS INTEGER) AS shard FROM embeddings",
    "partition_random_hash": f"{_SPLITMIX} SELECT vec_id, shard FROM h",
    "partition_contiguous_list": f"{_KM}, {_SIZES} SELECT list_id, list_size, CAST(least(list_id * {SHARDS} // {NLIST}, {SHARDS - 1}) AS INTEGER) AS shard FROM z",
    "partition_greedy_list": f"{_KM.replace('WITH', 'WITH RECURSIVE', 1)}, {_SIZES}, {_greedy()} SELECT o.list_id, o.list_size, CAST(g.owner AS INTEGER) AS shard FROM g JOIN o USING (i)",
    "partition_work_balance": f"{_SPLITMIX}, {_BASE.strip()}, d AS (SELECT 'block-id' AS strategy, {_BLOCK} AS shard FROM b UNION ALL SELECT 'cyclic', CAST(id % {SHARDS} AS INTEGER) FROM b UNION ALL SELECT 'random-hash', shard FROM h), w AS (SELECT s.strategy, t.r, count(d.shard) AS work FROM (SELECT DISTINCT strategy FROM d) s CROSS JOIN range({SHARDS}) t(r) LEFT JOIN d ON d.strategy = s.strategy AND d.shard = t.r GROUP BY ALL) SELECT strategy, min(work) AS work_min, avg(work) AS work_avg, max(work) AS work_max, round(max(work) / avg(work), 6) AS imbalance_ratio FROM w GROUP BY strategy",
    "probe_select": f"{_IVF} SELECT qid, cid AS list_id, pr AS probe_rank, round(dist, 6) + 0.0 AS dist FROM pr",
    "ivf_candidates": f"{_IVF} SELECT pr.qid, l.id AS vec_id, l.cid AS list_id FROM pr JOIN l USING (cid)",
    "ivf_candidate_count": f"{_IVF} SELECT pr.qid, count(l.id) AS candidates FROM pr LEFT JOIN l USING (cid) GROUP BY pr.qid",
    "ivf_search": f"{_IVF} {_out(_ranked(_IN_LISTS, K))}",
    "ivf_search_stored": f"{_IVF} {_out(_ranked(_IN_LISTS, K))}",
    "ivf_search_sharded": f"{_IVF} {_out(_ranked(_IN_LISTS, K))}",
    "shard_global_merge": f"{_IVF} {_out(_ranked(_IN_LISTS, K))}",
    "shard_local_topk": f"{_IVF} {_out(_ranked(_IN_SHARDS, K, 'shard, '), 'shard, ')}",
    "recall_at_k": f"{_IVF}, f AS ({_ranked(_IN_LISTS, K)}), g AS ({_ranked(_ALL, K)}) SELECT q.qid, count(f.vec_id) AS hits, count(f.vec_id) / {K}.0::DOUBLE AS recall FROM q LEFT JOIN (f JOIN g USING (qid, vec_id)) ON f.qid = q.qid GROUP BY q.qid",
}

ORACLE_SQL["recall_at_k"] = f"{_IVF}, f AS ({_ranked(_IN_LISTS, K)}), g AS ({_ranked(_ALL, K)}), h AS (SELECT qid, vec_id FROM f JOIN g USING (qid, vec_id)) SELECT q.qid, count(h.vec_id) AS hits, count(h.vec_id) / {K}::DOUBLE AS recall FROM q LEFT JOIN h USING (qid) GROUP BY q.qid"
_WIDE = f"{_KM}, {_probes(12)}"
ORACLE_SQL["ivf_search_wide"] = f"{_WIDE} {_out(_ranked(_IN_LISTS, K))}"
ORACLE_SQL["recall_wide"] = f"{_WIDE}, f AS ({_ranked(_IN_LISTS, K)}), g AS ({_ranked(_ALL, K)}) SELECT round((SELECT count(*) FROM f JOIN g USING (qid, vec_id)) / (SELECT count(*) FROM q)::DOUBLE / {K}, 6) + 0.0 AS recall"
_SWEEP_PAIRS = "SELECT y.nprobe, pr.qid, round(1 - list_inner_product(q.v, b.v), 12) AS dist, b.id AS vec_id FROM pr JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe) y ON pr.pr <= y.nprobe JOIN q USING (qid) JOIN l ON l.cid = pr.cid JOIN b ON b.id = l.id"
ORACLE_SQL["recall_sweep"] = f"{_KM}, {_probes(16)}, f AS ({_ranked(_SWEEP_PAIRS, K, 'nprobe, ')}), g AS ({_ranked(_ALL, K)}), h AS (SELECT f.nprobe, count(*) AS n FROM f JOIN g USING (qid, vec_id) GROUP BY f.nprobe) SELECT CAST(nprobe AS INTEGER) AS nprobe, round(n / (SELECT count(*) FROM q)::DOUBLE / {K}, 6) + 0.0 AS recall FROM h"

_GRID_PAIRS = _SWEEP_PAIRS.replace("[1, 2, 4, 8, 16]", "[2, 4, 8]")
ORACLE_SQL["recall_sweep_lists"] = " UNION ALL ".join(
    f"SELECT {nlist} AS nlist, * FROM ({_kmeans(nlist)}, {_probes(8)}, f AS ({_ranked(_GRID_PAIRS, K, 'nprobe, ')}), g AS ({_ranked(_ALL, K)}), h AS (SELECT f.nprobe, count(g.vec_id) AS n FROM f LEFT JOIN g USING (qid, vec_id) GROUP BY f.nprobe) SELECT CAST(nprobe AS INTEGER) AS nprobe, round(n / (SELECT count(*) FROM q)::DOUBLE / {K}, 6) + 0.0 AS recall FROM h)"
    for nlist in (8, 16, 32)
)
ORACLE_SQL["ivf_search_settings"] = f"{_kmeans(24, 3)}, {_probes(6, 'c3')} {_out(_ranked(_IN_LISTS, K))}"
_BY_NP = "SELECT CAST(t.np AS INTEGER) AS np, {} AS strategy, CAST({} AS INTEGER) AS shard, {} AS work FROM {}, (SELECT unnest([1, 2, 4, 8]) AS np) t"
_GREEDY_WORK = " UNION ALL ".join(f"SELECT {np}, 'greedy-list', CAST(owner AS INTEGER), list_size FROM (WITH RECURSIVE {_greedy(np)} SELECT g.owner, o.list_size FROM g JOIN o USING (i))" for np in (1, 2, 4, 8))
_STRATEGIES = [
    _BY_NP.format("'block-id'", "((id + 1) * t.np - 1) // (SELECT n FROM p)", 1, "b"),
    _BY_NP.format("'cyclic'", "id % t.np", 1, "b"),
    _BY_NP.format("'random-hash'", "xor(z, z // 2147483648) % CAST(t.np AS UHUGEINT)", 1, "x2"),
    _BY_NP.format("'contiguous-list'", f"least(list_id * t.np // {NLIST}, t.np - 1)", "list_size", "z AS zz"),
    _GREEDY_WORK,
]
ORACLE_SQL["partition_sweep"] = f"""{_SPLITMIX}, {_KM.removeprefix("WITH ")}, {_SIZES}, w AS ({" UNION ALL ".join(_STRATEGIES)}), e AS (SELECT strategy, np, shard, sum(work) AS work FROM w GROUP BY ALL)
SELECT strategy, np, CAST(CASE WHEN count(*) < np THEN 0 ELSE min(work) END AS BIGINT) AS work_min, sum(work)::DOUBLE / np AS work_avg, CAST(max(work) AS BIGINT) AS work_max, round(max(work) / (sum(work)::DOUBLE / np), 6) AS imbalance_ratio FROM e GROUP BY strategy, np"""

_SETTINGS = f"{_kmeans(24, 3)}, {_probes(6, 'c3')}"
ORACLE_SQL["recall_settings"] = f"{_SETTINGS}, f AS ({_ranked(_IN_LISTS, K)}), g AS ({_ranked(_ALL, K)}) SELECT round((SELECT count(*) FROM f JOIN g USING (qid, vec_id)) / (SELECT count(*) FROM q)::DOUBLE / {K}, 6) + 0.0 AS recall"
_OF_LIST = "SELECT CAST(t.np AS INTEGER) AS np, {} AS strategy, CAST({} AS INTEGER) AS shard, y.n AS work FROM {} JOIN y ON y.list_id = {}, (SELECT unnest([1, 2, 4, 8]) AS np) t"
_GREEDY_PROBED = " UNION ALL ".join(f"SELECT {np}, 'greedy-list', CAST(owner AS INTEGER), list_size * n FROM (WITH RECURSIVE {_greedy(np)} SELECT g.owner, o.list_size, y.n FROM g JOIN o USING (i) JOIN y USING (list_id))" for np in (1, 2, 4, 8))
_PROBED = [
    _OF_LIST.format("'block-id'", "((l.id + 1) * t.np - 1) // (SELECT n FROM p)", "l", "l.cid"),
    _OF_LIST.format("'cyclic'", "l.id % t.np", "l", "l.cid"),
    _OF_LIST.format("'random-hash'", "xor(z, z // 2147483648) % CAST(t.np AS UHUGEINT)", "l JOIN x2 ON x2.vec_id = l.id", "l.cid"),
    _OF_LIST.format("'contiguous-list'", f"least(zz.list_id * t.np // {NLIST}, t.np - 1)", "z AS zz", "zz.list_id").replace("y.n AS work", "y.n * zz.list_size AS work"),
    _GREEDY_PROBED,
]
ORACLE_SQL["search_work_sweep"] = f"""{_SPLITMIX}, {_IVF.removeprefix("WITH ")}, {_SIZES}, y AS (SELECT cid AS list_id, count(*) AS n FROM pr GROUP BY cid), w AS ({" UNION ALL ".join(_PROBED)}), e AS (SELECT strategy, np, shard, sum(work) AS work FROM w GROUP BY ALL)
SELECT strategy, np, CAST(CASE WHEN count(*) < np THEN 0 ELSE min(work) END AS BIGINT) AS work_min, sum(work)::DOUBLE / np AS work_avg, CAST(max(work) AS BIGINT) AS work_max, round(max(work) / (sum(work)::DOUBLE / np), 6) AS imbalance_ratio FROM e GROUP BY strategy, np"""

ORACLE_SQL["metrics_run_settled"] = f"""{_IVF}, f AS ({_ranked(_IN_LISTS, K)}), g AS ({_ranked(_ALL, K)}), h AS (SELECT count(*) AS n FROM f JOIN g USING (qid, vec_id)),
cc AS (SELECT pr.qid, count(l.id) AS c FROM pr LEFT JOIN l USING (cid) GROUP BY pr.qid),
w AS (SELECT t.r, count(d.shard) AS work FROM range({SHARDS}) t(r) LEFT JOIN (SELECT {_BLOCK} AS shard FROM b) d ON d.shard = t.r GROUP BY t.r)
SELECT 'IVF' AS algorithm, 'block-id' AS partition, {SHARDS} AS np, {NLIST} AS nlist, {NPROBE} AS nprobe, {K} AS k,
  round((SELECT n FROM h) / (SELECT count(*) FROM q)::DOUBLE / {K}, 6) + 0.0 AS recall, (SELECT count(*) FROM q) AS test_queries, (SELECT round(avg(c), 6) + 0.0 FROM cc) AS candidate_count_avg,
  min(work) AS work_min, avg(work) AS work_avg, max(work) AS work_max, round(max(work) / avg(work), 6) AS imbalance_ratio FROM w"""

# With shards of at most 500 vectors and ef 100 the graphs find every neighbour; these hold them to it.
ORACLE_SQL |= dict.fromkeys(("hnsw_search", "hnsw_search_sharded", "hnsw_roundtrip"), ORACLE_SQL["knn_exact"])

# ---- run records

_RUNS = """WITH runs AS (
  SELECT l_orderkey AS run_id, l_returnflag AS "group", CASE WHEN l_linestatus = 'F' THEN 'block-id' ELSE 'cyclic' END AS partition, CAST(l_linenumber AS BIGINT) AS np,
         l_extendedprice AS latency_us, l_extendedprice * l_tax AS bcast_us, l_extendedprice * (1 - l_discount) AS search_max_us, l_quantity * 20 AS gather_us,
         l_extendedprice * l_discount AS merge_us, l_suppkey AS node
  FROM lineitem)"""
_KEYS = '"group", partition, np'
_MEAN3 = ", ".join(f"round(avg({m}), 4) + 0.0 AS {m}_mean" for m in ("latency_us", "gather_us", "search_max_us"))
_MEANS = f"means AS (SELECT {_KEYS}, count(*) AS runs, {_MEAN3} FROM runs GROUP BY {_KEYS})"
_OUTLIERS = """med AS (SELECT "group", partition, np, node, count(*) AS n, median(latency_us) AS ml, median(gather_us) AS mg, median(search_max_us) AS ms FROM runs GROUP BY ALL),
fl AS (SELECT r.*, CASE WHEN n < 4 THEN '' ELSE concat_ws('; ',
  CASE WHEN latency_us > 1.15::DOUBLE * ml THEN 'latency_us > 1.15 x median' END,
  CASE WHEN gather_us > 4.0::DOUBLE * mg AND mg > 0 AND latency_us > 1.1::DOUBLE * ml THEN 'gather_us > 4.00 x median' END,
  CASE WHEN search_max_us > 1.3::DOUBLE * ms AND ms > 0 AND latency_us > 1.1::DOUBLE * ml THEN 'search_max_us > 1.30 x median' END) END AS why
  FROM runs r JOIN med USING ("group", partition, np, node)),
ok AS (SELECT "group", partition, np, node, count(*) FILTER (why = '') AS kept FROM fl GROUP BY ALL),
mk AS (SELECT fl.*, why <> '' AND kept >= 3 AS removed FROM fl JOIN ok USING ("group", partition, np, node))"""

ORACLE_SQL |= {
    "metrics_read": f'{_RUNS} SELECT "group", np, count(*) AS runs, round(sum(latency_us), 2) + 0.0 AS latency_us FROM runs GROUP BY "group", np',
    "metrics_summary": f"{_RUNS}, {_OUTLIERS} SELECT {_KEYS}, node, count(*) FILTER (NOT removed) AS used_count, {', '.join(f'round(avg({m}) FILTER (NOT removed), 8) + 0.0 AS {m}_mean' for m in ('latency_us', 'gather_us', 'search_max_us'))}, count(*) AS raw_count FROM mk GROUP BY {_KEYS}, node",
    "metrics_mean_std": f"{_RUNS} SELECT {_KEYS}, count(*) AS used_count, {', '.join(f'round(avg({m}), 4) + 0.0 AS {m}_mean, round(stddev_samp({m}), 4) + 0.0 AS {m}_std' for m in ('latency_us', 'gather_us', 'search_max_us'))} FROM runs GROUP BY {_KEYS}",
    "metrics_outliers": f"{_RUNS}, {_OUTLIERS} SELECT run_id, {_KEYS}, node, latency_us, CASE WHEN removed THEN why ELSE '' END AS reasons, removed FROM mk",
    "metrics_speedup": f"{_RUNS}, {_MEANS} SELECT {_KEYS}, round(first_value(latency_us_mean) OVER w / latency_us_mean, 6) + 0.0 AS speedup, round(first_value(latency_us_mean) OVER w / latency_us_mean / np, 6) + 0.0 AS efficiency FROM means WINDOW w AS (PARTITION BY \"group\", partition ORDER BY np)",
    "metrics_breakdown": f"{_RUNS} SELECT {_KEYS}, round(avg(round(greatest(0.0, latency_us - bcast_us - search_max_us - gather_us - merge_us), 4)), 4) + 0.0 AS other_us FROM runs GROUP BY {_KEYS}",
    "metrics_comm_ratio": f"{_RUNS} SELECT {_KEYS}, round(avg(round(CASE WHEN latency_us > 0 THEN (bcast_us + gather_us + merge_us) / latency_us * 100 ELSE 0.0 END, 4)), 4) + 0.0 AS comm_pct FROM runs GROUP BY {_KEYS}",
    "metrics_compare": f"{_RUNS}, m AS (SELECT partition, np, round(avg(latency_us), 4) AS x FROM runs GROUP BY partition, np) SELECT CAST(a.np AS VARCHAR) AS label, a.x AS old, b.x AS new, round(b.x / a.x, 6) + 0.0 AS ratio FROM m a JOIN m b ON a.np = b.np AND a.partition = 'block-id' AND b.partition = 'cyclic'",
    "metrics_baseline_align": f'{_RUNS}, m AS (SELECT "group", np, round(avg(latency_us), 4) AS x FROM runs GROUP BY "group", np) SELECT m.np, m."group", m.x AS latency_us, n.x AS baseline_latency_us, round(m.x - n.x, 4) + 0.0 AS difference FROM m JOIN m n ON n.np = m.np AND n."group" = \'N\'',
    "metrics_pick": f"{_RUNS}, {_MEANS} SELECT * FROM means WHERE \"group\" = 'R' AND np = 4",
    "metrics_best_config": f"{_RUNS}, {_MEANS} SELECT * FROM means ORDER BY latency_us_mean, {_KEYS} LIMIT 1",
    "metrics_partition_order": f"{_RUNS}, {_MEANS} SELECT {_KEYS}, CAST(coalesce(list_position(['cyclic', 'block-id'], partition), 0) AS INTEGER) AS position FROM means",
    "metrics_report": f"{_RUNS}, {_MEANS}, m AS (SELECT concat_ws('/', \"group\", partition, CAST(np AS VARCHAR)) AS label, * FROM means) SELECT label, CAST(t.i AS INTEGER) AS place, ['label: ' || label, 'group: ' || \"group\", 'partition: ' || partition, 'np: ' || np, 'runs: ' || runs][t.i + 1] AS line FROM m, range(5) t(i)",
    "metrics_union": f"{_RUNS}, {_MEANS} SELECT * FROM means WHERE \"group\" IN ('A', 'R')",
    "metrics_latest_run": "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 1",
    "metrics_stage_avg": f'{_RUNS}, r AS (SELECT "group", run_id, avg(search_max_us) AS a, max(search_max_us) AS m, sum(gather_us) AS g FROM runs GROUP BY "group", run_id) SELECT "group", round(avg(a), 4) + 0.0 AS search_avg_us, round(avg(m), 4) + 0.0 AS search_max_us, round(avg(g), 4) + 0.0 AS gather_us FROM r GROUP BY "group"',
}
