"""The queries of queries.py in DuckDB's SQL."""

from __future__ import annotations

from vectaria.operators.scalar_quant import rotation
from vectaria.queries import BASE_IDS, BLOCKS, CELLS, DIM, K, LEVELS, PROBES, RERANK, ROUNDS, SOFT, SPLIT_AT

POS = f"range(1, {DIM} + 1)"


def _l2(a: str, b: str, n: int = DIM) -> str:
    x = f"({a}[i]::DOUBLE - {b}[i]::DOUBLE)"
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {x} * {x}))"


def _dot(a: str, b: str, n: int = DIM) -> str:
    return f"list_sum(list_transform(range(1, {n} + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def _with(parts: list[str], select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


E = "e AS MATERIALIZED (SELECT vec_id, embedding AS v, label FROM embeddings)"
Q = "q AS MATERIALIZED (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 50 = 1)"
DEAD = "dead AS (SELECT vec_id FROM e WHERE vec_id % 7 = 0)"
LIVE = "live AS (SELECT * FROM e WHERE vec_id % 7 <> 0)"


def _train(src: str) -> list[str]:
    """Cells c(cid, c) trained on table ``src``."""
    parts = [f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS cid, list_transform(v, lambda x: x::DOUBLE) AS c FROM (SELECT * FROM {src} ORDER BY vec_id LIMIT {CELLS}))"]
    for r in range(1, ROUNDS + 1):
        parts += [
            f"a{r} AS MATERIALIZED (SELECT vec_id, arg_min(cid, (d, cid)) AS cid FROM (SELECT vec_id, cid, round({_l2('v', 'c')}, 9) AS d FROM {src}, c{r - 1}) GROUP BY vec_id)",
            f"u{r} AS (SELECT cid, unnest(v)::DOUBLE AS x, unnest({POS}) AS pos FROM a{r} JOIN {src} USING (vec_id))",
            f"m{r} AS (SELECT cid, list(x ORDER BY pos) AS c FROM (SELECT cid, pos, sum(round(x * 1e9)::BIGINT)::DOUBLE / count(*) / 1e9 AS x FROM u{r} GROUP BY ALL) GROUP BY cid)",
            f"c{r} AS MATERIALIZED (SELECT c{r - 1}.cid, coalesce(m{r}.c, c{r - 1}.c) AS c FROM c{r - 1} LEFT JOIN m{r} USING (cid))",
        ]
    return [*parts, f"c AS (SELECT * FROM c{ROUNDS})"]


def _postings(src: str = "e", k: int = SOFT) -> str:
    return f"p AS MATERIALIZED (SELECT vec_id, cid, rk FROM (SELECT vec_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY d, cid) AS rk FROM (SELECT vec_id, cid, round({_l2('v', 'c')}, 9) AS d FROM {src}, c)) WHERE rk <= {k})"


PROBE = f"pr AS MATERIALIZED (SELECT query_id, cid, rk FROM (SELECT query_id, cid, row_number() OVER (PARTITION BY query_id ORDER BY d, cid) AS rk FROM (SELECT query_id, cid, round({_l2('qv', 'c')}, 9) AS d FROM q, c)) WHERE rk <= {PROBES})"


def _found(where: str = "true", name: str = "f", k: int = K, among: str = "p JOIN pr USING (cid)") -> list[str]:
    """Results f(query_id, rank, vec_id, dist) of a search by cells."""
    return [
        f"{name}0 AS (SELECT DISTINCT query_id, vec_id FROM {among} WHERE {where})",
        f"{name}1 AS (SELECT query_id, vec_id, {_l2('qv', 'v')} AS dist FROM {name}0 JOIN e USING (vec_id) JOIN q USING (query_id))",
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank, vec_id, dist FROM {name}1) WHERE rank <= {k})",
    ]


def _exact(where: str = "true", name: str = "t", k: int = K) -> list[str]:
    return _found(where, name, k, "q, e")


OUT = f"SELECT query_id, rank, vec_id, {_r('dist')} AS dist FROM f"
NOT_DEAD = "vec_id % 7 <> 0"
SEARCH = _with([E, Q, *_train("e"), _postings(), PROBE, *_found(NOT_DEAD)], OUT)
ASSIGNED = "SELECT vec_id, rk AS assign_rank, cid AS cluster_id FROM p"
BASE = f"base AS (SELECT * FROM e WHERE vec_id < {BASE_IDS})"
FROM_BASE = _with([E, BASE, *_train("base"), _postings()], ASSIGNED)
CENTROIDS = _with([E, *_train("e")], f"SELECT cid AS cluster_id, pos, {_r('x')} AS x FROM (SELECT cid, unnest(c) AS x, unnest(range(0, {DIM})) AS pos FROM c)")
RECALL = "SELECT (SELECT count(*) FROM q) AS n_queries, count(*) AS hits, round(count(*)::DOUBLE / ((SELECT count(*) FROM q) * {k}), 6) AS recall FROM f JOIN t USING (query_id, vec_id)"

SPLIT = [E, *_train("e"), _postings(k=1), "lv AS MATERIALIZED (SELECT cid, vec_id, v FROM p JOIN e USING (vec_id) WHERE vec_id % 7 <> 0)", "sz AS (SELECT cid, count(*) AS n FROM lv GROUP BY cid)", f"big AS (SELECT cid, n FROM sz WHERE n > floor((SELECT sum(n) FROM sz)::DOUBLE / {CELLS} * {SPLIT_AT}))"]


def _split(last: str = f"SELECT cid AS cluster_id, vec_id, side FROM s{ROUNDS}", more: tuple[str, ...] = ()) -> str:
    parts = [*SPLIT, "w AS MATERIALIZED (SELECT cid, vec_id, v, row_number() OVER (PARTITION BY cid ORDER BY vec_id) - 1 AS i FROM lv WHERE cid IN (SELECT cid FROM big))", "h0 AS MATERIALIZED (SELECT cid, i AS side, list_transform(v, lambda x: x::DOUBLE) AS h FROM w WHERE i < 2)"]
    for r in range(1, ROUNDS + 1):
        parts += [
            f"s{r} AS MATERIALIZED (SELECT cid, vec_id, any_value(v) AS v, arg_min(side, (d, side)) AS side FROM (SELECT w.cid, vec_id, v, side, round({_l2('v', 'h')}, 9) AS d FROM w JOIN h{r - 1} USING (cid)) GROUP BY cid, vec_id)",
            f"y{r} AS (SELECT cid, side, list(x ORDER BY pos) AS h FROM (SELECT cid, side, pos, sum(round(x * 1e9)::BIGINT)::DOUBLE / count(*) / 1e9 AS x FROM (SELECT cid, side, unnest(v)::DOUBLE AS x, unnest({POS}) AS pos FROM s{r}) GROUP BY ALL) GROUP BY cid, side)",
            f"h{r} AS MATERIALIZED (SELECT h{r - 1}.cid, h{r - 1}.side, coalesce(y{r}.h, h{r - 1}.h) AS h FROM h{r - 1} LEFT JOIN y{r} USING (cid, side))",
        ]
    return _with([*parts, *more], last)


#: Cells with rows on both sides, numbered on from the last cell in order of their ids.
IN_INDEX = _split(
    f"SELECT lv.vec_id, (CASE WHEN s.side = 1 THEN nw.id ELSE lv.cid END)::BIGINT AS cluster_id FROM lv LEFT JOIN s{ROUNDS} s USING (cid, vec_id) LEFT JOIN nw ON nw.cid = lv.cid",
    (f"nw AS (SELECT cid, {CELLS} - 1 + row_number() OVER (ORDER BY cid) AS id FROM (SELECT cid FROM s{ROUNDS} GROUP BY cid HAVING count(DISTINCT side) = 2))",),
)


def _drift() -> str:
    parts = [E, Q, "base AS (SELECT * FROM e WHERE label < 5)", *_train("base"), _postings(), PROBE]
    select = []
    for b in range(5, 10):
        ok = f"vec_id IN (SELECT vec_id FROM e WHERE label <= {b})"
        parts += [*_found(ok, f"f{b}_"), *_exact(ok, f"t{b}_")]
        select.append(f"SELECT {b} AS batch, count(*) AS hits, round(count(*)::DOUBLE / ((SELECT count(*) FROM q) * {K}), 6) AS recall FROM f{b}_ JOIN t{b}_ USING (query_id, vec_id)")
    return _with(parts, " UNION ALL ".join(select))


# ---- quantisers

_ROTATION = "[" + ", ".join("[" + ", ".join(repr(float(x)) for x in row) + "]" for row in rotation(DIM)) + "]::DOUBLE[][]"
ROT = f"rot AS MATERIALIZED (SELECT {_ROTATION} AS m)"
UNIT = f"un AS (SELECT vec_id, sqrt({_dot('v', 'v')}) AS norm, {_dot('v', 'v')} AS sq, v FROM e)"


def _rotated(x: str) -> str:
    return f"list_transform({POS}, lambda j: round(list_sum(list_transform({POS}, lambda i: m[j][i] * {x}[i])), 9))"


U = [E, ROT, UNIT, "uu AS MATERIALIZED (SELECT vec_id, sq, list_transform(v, lambda x: x::DOUBLE / norm) AS u FROM un)", f"r AS MATERIALIZED (SELECT vec_id, sq, {_rotated('u')} AS r FROM uu, rot)"]
LEVEL = "[" + ", ".join(map(repr, LEVELS)) + "]::DOUBLE[]"
EDGES = "[" + ", ".join(repr((a + b) / 2) for a, b in zip(LEVELS[1:], LEVELS[:-1], strict=True)) + "]::DOUBLE[]"
CODE = [
    f"k0 AS MATERIALIZED (SELECT vec_id, sq, r, list_transform(r, lambda x: len(list_filter({EDGES}, lambda b: b < x))) AS code FROM r)",
    f"k AS MATERIALIZED (SELECT vec_id, sq, code, sqrt(sq) / greatest(list_sum(list_transform({POS}, lambda i: r[i] * ({LEVEL})[code[i] + 1])), 1e-10) AS scale FROM k0)",
]
QR = ["q AS MATERIALIZED (SELECT vec_id AS query_id, v AS qv FROM e WHERE vec_id % 50 = 1)", f"qr AS MATERIALIZED (SELECT query_id, {_dot('qv', 'qv')} AS q_sq, {_rotated('(qv::DOUBLE[])')} AS qr FROM q, rot)"]
EST = f"est AS MATERIALIZED (SELECT query_id, vec_id, round(q_sq + sq - 2 * (list_sum(list_transform({POS}, lambda i: qr[i] * ({LEVEL})[code[i] + 1])) * scale), 7) AS dist FROM qr, k)"
LUT = [
    f"tb AS MATERIALIZED (SELECT query_id, q_sq, list_transform(qr, lambda x: list_transform({LEVEL}, lambda c: x * c)) AS t FROM qr)",
    "lo AS (SELECT query_id, q_sq, t, list_min(list_transform(t, lambda x: list_min(x))) AS lo, list_max(list_transform(t, lambda x: list_max(x))) AS hi FROM tb)",
    "lu AS MATERIALIZED (SELECT query_id, q_sq, lo, (hi - lo) / 255 AS step, list_transform(t, lambda x: list_transform(x, lambda y: least(255, greatest(0, floor((y - lo) / ((hi - lo) / 255) + 0.5)))::BIGINT)) AS lut FROM lo)",
]


def _codebook() -> str:
    levels, rounds = 4, 5
    parts = [*U, "pool AS MATERIALIZED (SELECT round(unnest(r) * 1e9)::BIGINT AS x FROM r)", "srt AS (SELECT list_sort(list(x)) AS s, count(*) AS n FROM pool)"]
    parts.append(f"l0 AS MATERIALIZED (SELECT list_transform(range(0, {levels}), lambda i: s[least(n, floor((i + 0.5) / {levels} * n)::BIGINT + 1)]::DOUBLE / 1e9) AS c FROM srt)")
    for k in range(1, rounds + 1):
        parts += [
            f"n{k} AS MATERIALIZED (SELECT bin, sum(x)::DOUBLE / count(*) / 1e9 AS m FROM (SELECT x, len(list_filter(list_transform(range(1, {levels}), lambda i: (c[i + 1] + c[i]) / 2), lambda b: b < x::DOUBLE / 1e9)) AS bin FROM pool, l{k - 1}) GROUP BY bin)",
            f"l{k} AS MATERIALIZED (SELECT list(coalesce(n{k}.m, c[g.i + 1]) ORDER BY g.i) AS c FROM l{k - 1} CROSS JOIN (SELECT unnest(range(0, {levels})) AS i) g LEFT JOIN n{k} ON n{k}.bin = g.i)",
        ]
    return _with(parts, f"SELECT unnest(range(0, {levels})) AS level, {_r('unnest(c)')} AS centroid FROM l{rounds}")


def _calibration() -> str:
    parts = [
        *U,
        "z AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, r FROM r)",
        f"co AS (SELECT pos, list_sort(list(x)) AS s, count(*) AS n FROM (SELECT unnest(r) AS x, unnest(range(0, {DIM})) AS pos FROM r) GROUP BY pos)",
        f"po AS (SELECT list_sort(list(r[(i % {DIM}) + 1])) AS s, count(*) AS n FROM z)",
        "b AS (SELECT pos, co.s[floor(0.05 * co.n)::BIGINT + 1] AS lo, co.s[floor(0.95 * co.n)::BIGINT + 1] AS hi, po.s[floor(0.05 * po.n)::BIGINT + 1] AS plo, po.s[floor(0.95 * po.n)::BIGINT + 1] AS phi FROM co, po)",
    ]
    return _with(parts, f"SELECT pos, {_r('plo / ((phi - plo) / (hi - lo)) - lo')} AS shift, round((phi - plo) / (hi - lo), 6) AS scale FROM b")


_BOOK = "[" + ", ".join("[" + ", ".join("[" + ", ".join(repr(float(x)) for x in w) + "]" for w in words) + "]" for words in BLOCKS) + "]::DOUBLE[][][]"
SUB = "r[8 * g + 1 : 8 * g + 8]"
BLOCK = [
    *U,
    f"book AS MATERIALIZED (SELECT {_BOOK} AS b)",
    "bw AS MATERIALIZED (SELECT g, w, b[g + 1][w + 1] AS word FROM book, range(0, 8) AS gg(g), range(0, 16) AS ww(w))",
    f"bp AS MATERIALIZED (SELECT vec_id, g, arg_min(w, (d, w)) AS w FROM (SELECT vec_id, g, w, round({_l2('x', 'word', 8)}, 9) AS d FROM (SELECT vec_id, g, w, {SUB} AS x, word FROM r, bw)) GROUP BY vec_id, g)",
    "bx AS MATERIALIZED (SELECT vec_id, list(w ORDER BY g) AS code, flatten(list(word ORDER BY g)) AS x FROM bp JOIN bw USING (g, w) GROUP BY vec_id)",
    f"bk AS MATERIALIZED (SELECT vec_id, sq, code, x, sqrt(sq) / greatest({_dot('r', 'x')}, 1e-10) AS scale FROM bx JOIN r USING (vec_id))",
]
BLOCK_EST = f"est AS MATERIALIZED (SELECT query_id, vec_id, round(q_sq + sq - 2 * {_dot('qr', 'x')} * scale, 7) AS dist FROM qr, bk)"


def _block_train() -> str:
    parts = [*U, f"x AS MATERIALIZED (SELECT vec_id, g, {SUB} AS x FROM r, range(0, 8) AS gg(g))", "w0 AS MATERIALIZED (SELECT g, code, x AS w FROM (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY vec_id) - 1 AS code FROM x) WHERE code < 4)"]
    for k in range(1, ROUNDS + 1):
        parts += [
            f"o{k} AS MATERIALIZED (SELECT vec_id, g, any_value(x) AS x, arg_min(code, (d, code)) AS code FROM (SELECT vec_id, x.g, x, code, round({_l2('x', 'w', 8)}, 9) AS d FROM x JOIN w{k - 1} USING (g)) GROUP BY vec_id, g)",
            f"v{k} AS (SELECT g, code, list(y ORDER BY pos) AS w FROM (SELECT g, code, pos, sum(round(y * 1e9)::BIGINT)::DOUBLE / count(*) / 1e9 AS y FROM (SELECT g, code, unnest(x) AS y, unnest(range(0, 8)) AS pos FROM o{k}) GROUP BY ALL) GROUP BY g, code)",
            f"w{k} AS MATERIALIZED (SELECT w{k - 1}.g, w{k - 1}.code, coalesce(v{k}.w, w{k - 1}.w) AS w FROM w{k - 1} LEFT JOIN v{k} USING (g, code))",
        ]
    return _with(parts, f"SELECT g, code, pos, {_r('x')} AS x FROM (SELECT g, code, unnest(w) AS x, unnest(range(0, 8)) AS pos FROM w{ROUNDS})")


def _top(est: str, k: int, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank, vec_id, dist FROM {est}) WHERE rank <= {k})"


TQ = [*U, *CODE, *QR, EST, *_train("e"), _postings(), PROBE, f"in_cells AS (SELECT DISTINCT query_id, vec_id FROM p JOIN pr USING (cid) WHERE {NOT_DEAD})", "cand AS (SELECT est.* FROM est JOIN in_cells USING (query_id, vec_id))"]
OUT7 = f"SELECT query_id, rank, vec_id, {_r('dist', 7)} AS dist FROM f"
LONG = "SELECT {key}, pos, " + _r("x") + " AS x FROM (SELECT {key}, unnest({col}) AS x, unnest(range(0, 64)) AS pos FROM {table})"

ORACLE_SQL = {
    "scan_vectors": _with([E], f"SELECT count(*) AS n, min(len(v)) AS dim, {_r('sum(round(v[1]::DOUBLE * 1e9)::BIGINT)::DOUBLE / 1e9')} AS first FROM e"),
    "norm_sq": _with([E], f"SELECT vec_id, {_r(_dot('v', 'v'))} AS norm_sq FROM e"),
    "inner_product": _with([E, Q], f"SELECT query_id, vec_id, {_r(_dot('qv', 'v'))} AS ip FROM e, q"),
    "l2_distance": _with([E, Q], f"SELECT query_id, vec_id, {_r(_l2('qv', 'v'))} AS dist FROM e, q"),
    "l2_precomp": _with([E, Q], f"SELECT query_id, vec_id, {_r(_dot('qv', 'qv') + ' + ' + _dot('v', 'v') + ' - 2 * ' + _dot('qv', 'v'))} AS dist FROM e, q"),
    "l2_normalize": _with([E, "s AS (SELECT vec_id, list_transform(v, lambda x: x * (vec_id % 3)::FLOAT) AS v FROM e)", f"n AS (SELECT vec_id, v, sqrt({_dot('v', 'v')}) AS norm FROM s)", "u AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN norm <= 1e-10 THEN 0.0::DOUBLE ELSE x::DOUBLE / norm END) AS u FROM n)"], LONG.format(key="vec_id", col="u", table="u")),
    "brute_force_knn": _with([E, Q, *_exact(name="f")], OUT),
    "live_vectors": "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0",
    "leak_check": _with([E, Q, *_exact(NOT_DEAD, "f")], "SELECT count(*) AS n_leaks FROM f WHERE vec_id % 7 = 0"),
    "nearest_centroid": _with([E, *_train("e"), _postings(k=1)], f"SELECT vec_id, cid AS cluster_id, {_r(_l2('v', 'c'))} AS dist FROM p JOIN e USING (vec_id) JOIN c USING (cid)"),
    "vector_mean": f"SELECT label, pos, {_r('sum(round(x * 1e9)::BIGINT)::DOUBLE / count(*) / 1e9')} AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(0, {DIM})) AS pos FROM embeddings) GROUP BY label, pos",
    "kmeans_train": CENTROIDS,
    "centroids_scan": CENTROIDS,
    "assign_soft_k": _with([E, *_train("e"), _postings()], ASSIGNED),
    "build_index": _with([E, *_train("e"), _postings()], ASSIGNED),
    "cluster_sizes": _with([E, *_train("e"), _postings()], "SELECT cid AS cluster_id, count(*) AS physical_size, count(*) FILTER (vec_id % 7 <> 0) AS live_size FROM p GROUP BY cid"),
    "id_locations": _with([E, *_train("e"), _postings()], "SELECT vec_id, string_agg(cid, ',' ORDER BY rk) AS clusters FROM p GROUP BY vec_id"),
    "cluster_scan": _with([E, *_train("e"), _postings()], f"SELECT vec_id, {_r(_dot('v', 'v'))} AS norm_sq FROM p JOIN e USING (vec_id) WHERE cid = 3"),
    "probe_clusters": _with([E, Q, *_train("e"), PROBE], "SELECT query_id, rk AS probe_rank, cid AS cluster_id FROM pr"),
    "ivf_search": SEARCH + " WHERE query_id = 51",
    "ivf_search_batch": SEARCH,
    "save_load_roundtrip": SEARCH,
    "restore_from_tables": SEARCH,
    "truth_resort": _with([E, Q, *_exact(name="f")], OUT),
    "storage_level_parity": SEARCH,
    "dedup_soft_k": _with([E, Q, *_train("e"), _postings(), PROBE, *_found()], f"SELECT query_id, vec_id, {_r('dist')} AS dist FROM f1"),
    "recall_at_k": _with([E, Q, *_train("e"), _postings(), PROBE, *_found(NOT_DEAD), *_exact(NOT_DEAD)], RECALL.format(k=K)),
    "distance_ratio": _with([E, Q, *_train("e"), _postings(), PROBE, *_found(NOT_DEAD), *_exact(NOT_DEAD), "x AS (SELECT query_id, avg(sqrt(dist)) AS a FROM f WHERE dist > 1e-9 GROUP BY query_id)", "y AS (SELECT query_id, avg(sqrt(dist)) AS b FROM t WHERE dist > 1e-9 GROUP BY query_id)"], "SELECT round(avg(a / (b + 1e-10)), 6) AS ratio FROM x JOIN y USING (query_id)"),
    "cluster_query_hits": _with([E, Q, *_train("e"), PROBE], "SELECT cid AS cluster_id, count(*) AS hits FROM pr GROUP BY cid"),
    "insert_batch": FROM_BASE,
    "insert_stream": FROM_BASE,
    "insert_preassigned": f"SELECT vec_id, 1::BIGINT AS assign_rank, vec_id % {CELLS + 2} AS cluster_id FROM embeddings WHERE vec_id >= {BASE_IDS} AND vec_id % {CELLS + 2} < {CELLS}",
    "delete_batch": "SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0",
    "delete_idempotent": "SELECT step::BIGINT AS step, n::BIGINT AS n_hidden FROM (VALUES (0, (SELECT count(*) FROM embeddings WHERE vec_id IN (3, 5))), (1, 0), (2, (SELECT count(*) FROM embeddings WHERE vec_id = 7))) AS t(step, n)",
    "tombstone_scan": "SELECT vec_id FROM embeddings WHERE vec_id % 5 = 0 AND vec_id % 7 <> 0",
    "compact": _with([E, *_train("e"), _postings()], f"SELECT cid AS cluster_id, count(*) AS physical_size, count(*) AS live_size, 0::BIGINT AS deleted_count FROM p WHERE {NOT_DEAD} GROUP BY cid"),
    "auto_compact": f"SELECT count(*) AS n_vectors, {SOFT} * (count(*) - n) AS n_physical_slots, 0::BIGINT AS deleted_count, n AS purged_count, count(*) - n AS n_live FROM embeddings, (SELECT count(*) AS n FROM embeddings WHERE vec_id < {BASE_IDS} AND vec_id % 7 = 0) GROUP BY n HAVING n > count(*) // 10",
    "index_stats": _with([E, *_train("e"), _postings(), "z AS (SELECT cid, count(*) FILTER (vec_id % 7 <> 0) AS n FROM p GROUP BY cid)"], f"SELECT (SELECT count(*) FROM e) AS n_vectors, (SELECT count(*) FROM p) AS n_physical_slots, {CELLS}::BIGINT AS n_clusters, {DIM}::BIGINT AS dim, {SOFT}::BIGINT AS soft_k, (SELECT count(*) FROM e WHERE vec_id % 7 = 0) AS deleted_count, max(n) AS max_cluster_size, round(sum(n)::DOUBLE / {CELLS}, 6) AS mean_cluster_size FROM z"),
    "cluster_stats": _with([E, *_train("e"), _postings()], f"SELECT cid AS cluster_id, count(*) FILTER (p.vec_id % 7 <> 0) AS live_size, count(p.vec_id) AS physical_size, {_r('any_value(c[1])')} AS centroid_0, -1::BIGINT AS last_split_round FROM c LEFT JOIN p USING (cid) GROUP BY cid"),
    "cluster_imbalance": _with([E, *_train("e"), _postings()], "SELECT round(max(n) / avg(n), 6) AS imbalance FROM (SELECT cid, count(*) FILTER (p.vec_id % 7 <> 0) AS n FROM c LEFT JOIN p USING (cid) GROUP BY cid)"),
    "overloaded_clusters": _with(SPLIT, "SELECT cid AS cluster_id, n AS live_size FROM big"),
    "split_cluster": _split(),
    "split_in_index": IN_INDEX,
    "rebuild_baseline": _with([E, Q, LIVE, *_train("live"), _postings("live"), PROBE, *_found()], OUT),
    "postfilter_baseline": _with([E, Q, *_exact(name="w", k=10 * K)], f"SELECT query_id, rank, vec_id, {_r('dist')} AS dist FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 9), vec_id) AS rank, vec_id, dist FROM w WHERE {NOT_DEAD}) WHERE rank <= {K}"),
    "churn_round": _with([E, Q, BASE, *_train("base"), _postings(), PROBE, "old AS (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i, count(*) OVER () AS n FROM e) WHERE i <= n * 3 // 10)", *_found("vec_id NOT IN (SELECT vec_id FROM old)")], OUT),
    "drift_recall": _drift(),
    "tq_rotate": _with(U, LONG.replace(", 6)", ", 9)").format(key="vec_id", col="r", table="r")),
    "tq_codebook": _codebook(),
    "tq_calibration": _calibration(),
    "tq_encode": _with([*U, *CODE], f"SELECT vec_id, array_to_string(list_transform(code, lambda x: printf('%02x', x)), '') AS codes, {_r('scale')} AS scale, {_r('sq')} AS sqnorm FROM k"),
    "tq_score": _with([*U, *CODE, *QR, EST], f"SELECT query_id, vec_id, {_r('dist', 7)} AS dist FROM est"),
    "tq_fastscan_lut": _with([*U, *QR, *LUT], "SELECT query_id, list_sum(list_transform(lut, lambda x: list_sum(x)))::BIGINT AS total, round(lo, 6) AS lo, round(step, 9) AS step FROM lu"),
    "tq_fastscan_score": _with([*U, *CODE, *QR, *LUT], f"SELECT query_id, vec_id, {_r(f'round(q_sq + sq - 2 * ((step * list_sum(list_transform({POS}, lambda i: lut[i][code[i] + 1])) + {DIM} * lo) * scale), 7)', 7)} AS dist FROM lu, k"),
    "tq_search_raw": _with([*TQ, _top("cand", K, "f")], OUT7),
    "tq_search_rerank": _with([*TQ, _top("cand", RERANK, "g"), *_found(name="f", among="g")], OUT),
    "bytes_per_vector": f"SELECT 'scalar' AS kind, b AS size, (b * {DIM} + 7) // 8 + 8 AS bytes FROM range(1, 9) AS t(b) UNION ALL SELECT 'block', w, (n * {DIM // 2} + 7) // 8 + 8 FROM (VALUES (16::BIGINT, 4::BIGINT), (256, 8)) AS t(w, n)",
    "block_vq_train": _block_train(),
    "block_vq_encode": _with(BLOCK, f"SELECT vec_id, array_to_string(code, ',') AS codes, {_r('scale')} AS scale, {_r('sq')} AS sqnorm FROM bk"),
    "block_vq_decode": _with([*BLOCK, f"y AS (SELECT vec_id, list_transform({POS}, lambda j: sqrt(sq) * list_sum(list_transform({POS}, lambda i: m[i][j] * x[i])) / sqrt({_dot('x', 'x')})) AS y FROM bk, rot)"], LONG.format(key="vec_id", col="y", table="y")),
    "block_vq_score": _with([*BLOCK, *QR, BLOCK_EST], f"SELECT query_id, vec_id, {_r('dist', 7)} AS dist FROM est"),
    "block_vq_search": _with([*BLOCK, *QR, BLOCK_EST, f"cand AS (SELECT * FROM est WHERE {NOT_DEAD})", _top("cand", K, "f")], OUT7),
    "n_live": "SELECT count(*) AS n_live FROM embeddings WHERE vec_id % 7 <> 0",
    "pareto_frontier": "SELECT p_size, y AS p_retailprice FROM (SELECT p_size, y, max(y) OVER (ORDER BY p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT p_size, max(p_retailprice) AS y FROM part GROUP BY p_size)) WHERE m IS NULL OR y > m",
}
