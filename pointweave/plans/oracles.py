"""DuckDB SQL for the catalogue, written apart from the DataFrame code: plain windows over whole topics."""

from __future__ import annotations

import numpy as np

INV = repr(1 / float(np.float32(0.01)))
RES = repr(float(np.float32(0.01)))

#: Bytes of an unsigned LEB128 number of fewer than 64 bits.
UV = "(CASE " + " ".join(f"WHEN ({{0}}) < {1 << 7 * k} THEN {k}" for k in range(1, 9)) + " ELSE 9 END)"
ZZ = "(CASE WHEN ({0}) >= 0 THEN 2 * ({0}) ELSE -2 * ({0}) - 1 END)"


def uv(x: str) -> str:
    return UV.format(x)


def zz(x: str) -> str:
    return ZZ.format(x)


E = "e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 1000 AS chunk FROM events)"
LAG = "lag({0}) OVER (PARTITION BY event_type, chunk ORDER BY idx)"


def delta(x: str, over: str = LAG) -> str:
    return f"({x}) - coalesce({over.format(x)}, 0)"


TICKS = f"round(value * '{INV}'::DOUBLE)::BIGINT"
SIZED = f"""{E},
s AS (SELECT *, {TICKS} AS q FROM e),
d AS (SELECT *, {delta('q')} AS delta FROM s),
sized AS (SELECT event_type, event_id, {uv(zz('delta') + ' + 1')}::BIGINT AS out, 8::BIGINT AS given FROM d)"""

GAPS = "CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE WHEN event_id % 83 = 0 THEN '-inf'::DOUBLE ELSE value END"
FINITE = "NOT isnan(v) AND NOT isinf(v)"

XYZ = "p AS (SELECT vec_id, embedding[1]::FLOAT AS x, embedding[2]::FLOAT AS y, embedding[3]::FLOAT AS z FROM embeddings)"
VOXELS = f"""{XYZ}, v AS (SELECT vec_id, round((x * 10::FLOAT)::DOUBLE)::BIGINT AS vx, round((y * 10::FLOAT)::DOUBLE)::BIGINT AS vy,
  round((z * 10::FLOAT)::DOUBLE)::BIGINT AS vz FROM p WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY vx, vy, vz ORDER BY vec_id) = 1)"""


def runs(rows: str, keys: str = "event_type, chunk") -> str:
    """CTEs from rows(keys, idx, v) to runs(keys, run, first, value, length)."""
    return f"""n AS (SELECT *, CASE WHEN lag(v) OVER w IS NOT DISTINCT FROM v AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new
  FROM {rows} WINDOW w AS (PARTITION BY {keys} ORDER BY idx)),
g AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY idx) - 1 AS run FROM n),
runs AS (SELECT {keys}, run::BIGINT AS run, min(idx)::BIGINT AS first, min(v)::BIGINT AS value, count(*)::BIGINT AS length FROM g GROUP BY {keys}, run)"""


def sizes(rows: str, keys: str, width: int) -> str:
    """CTE sizes(keys, n, distinct, delta_varint, palette, rle, delta_rle) of rows(keys, idx, v)."""
    w = f"(PARTITION BY {keys} ORDER BY idx)"
    return f"""sd AS (SELECT {keys}, idx, v, v - coalesce(lag(v) OVER {w}, 0) AS d FROM {rows}),
sn AS (SELECT *, CASE WHEN row_number() OVER {w} > 1 AND lag(v) OVER {w} = v THEN 0 ELSE 1 END AS vn,
  CASE WHEN row_number() OVER {w} > 1 AND lag(d) OVER {w} = d THEN 0 ELSE 1 END AS dn FROM sd),
sg AS (SELECT *, sum(vn) OVER {w} AS vg, sum(dn) OVER {w} AS dg FROM sn),
sv AS (SELECT {keys}, vg, count(*) AS len FROM sg GROUP BY {keys}, vg),
sr AS (SELECT {keys}, dg, count(*) AS len, min(d) AS d FROM sg GROUP BY {keys}, dg),
s1 AS (SELECT {keys}, count(*)::BIGINT AS n, count(DISTINCT v)::BIGINT AS "distinct",
  (1 + sum({uv(zz('d') + ' + 1')}))::BIGINT AS delta_varint FROM sd GROUP BY {keys}),
s2 AS (SELECT {keys}, (5 + sum({width} + {uv('len')}))::BIGINT AS rle FROM sv GROUP BY {keys}),
s3 AS (SELECT {keys}, (5 + sum({uv(zz('d') + ' + 1')} + {uv('len')}))::BIGINT AS delta_rle FROM sr GROUP BY {keys}),
sizes AS (SELECT *, (3 + "distinct" * {width} + ((CASE WHEN "distinct" <= 1 THEN 0 ELSE length(bin("distinct" - 1)) END) * n + 7) // 8)::BIGINT AS palette
  FROM s1 JOIN s2 USING ({keys}) JOIN s3 USING ({keys}))"""


MODE = "CASE least(delta_varint, palette, rle, delta_rle) WHEN delta_varint THEN 'delta_varint' WHEN palette THEN 'palette' WHEN rle THEN 'rle' ELSE 'delta_rle' END"
USERS = f"{E}, u AS (SELECT event_type, chunk, idx, user_id AS v FROM e)"
PLATEAU = f"{E}, u AS (SELECT event_type, chunk, idx, (idx // 64) % 8 AS v FROM e)"
LINE_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
SEGMENTS = f"""{E}, s AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN NULL ELSE {TICKS} END AS q FROM e),
d AS (SELECT *, {delta('q')} AS d FROM s)"""


def total(select: str, rows: str) -> str:
    """select over each topic, and over all if there is more than one."""
    return f"SELECT event_type, {select} FROM {rows} GROUP BY event_type UNION ALL SELECT 'TOTAL', {select} FROM {rows} HAVING count(DISTINCT event_type) > 1"


#: Of the bits in which a and e differ.
LEADING = "(64 - length(bin(xor(a.v, e.v))))"
TRAILING = "(length(bin(xor(a.v, e.v))) - length(rtrim(bin(xor(a.v, e.v)), '0')))"
CLOUD = "('0x' || substr(sha256(event_type), 1, 15))::BIGINT"
#: Header, stamp, frame, dimensions, two fields, flags, data and density, each aligned behind the four bytes.
MESSAGE_BYTES = "4 + ((((((((12 + length(event_type) + 1 + 3) // 4) * 4 + 12) + 4 + 6 + 2 + 4 + 1 + 3 + 4) + 4 + 5 + 3 + 4 + 1 + 3 + 4) + 1 + 3 + 4 + 4) + 4) + 12 * count(*) + 1)"


def section_bytes(name: str, column: str) -> str:
    """CTE name(cloud, chunk, n, bytes): a column's sections in the mode of the cloud's first 4096 rows, by rows c."""
    return f"""{name} AS (WITH x AS (SELECT cloud, chunk, idx, {column} AS v FROM c), probe AS (SELECT cloud, idx, v FROM x WHERE idx < 4096),
  m AS (WITH {sizes('probe', 'cloud', 8)} SELECT cloud, {MODE} AS mode FROM sizes), z AS (WITH {sizes('x', 'cloud, chunk', 8)} SELECT * FROM sizes)
  SELECT cloud, chunk, n, CASE mode WHEN 'delta_varint' THEN delta_varint WHEN 'palette' THEN palette WHEN 'rle' THEN rle ELSE delta_rle END AS bytes FROM z JOIN m USING (cloud))"""


ORACLE_SQL = {
    "q01_quantise_delta": f"WITH {E}, s AS (SELECT *, {TICKS} AS q FROM e), d AS (SELECT *, {delta('q')} AS delta FROM s) SELECT event_id, q, delta, {zz('delta')} + 1 AS code FROM d",
    "q02_delta_varint_size_by_topic": f"WITH {SIZED} SELECT event_type, count(*)::BIGINT AS n, sum(out)::BIGINT AS bytes FROM sized GROUP BY event_type",
    "q03_quantise_half_even": f"WITH {E}, s AS (SELECT *, round_even((value::FLOAT * 2::FLOAT)::DOUBLE, 0)::BIGINT AS q FROM e) SELECT event_id, q, {delta('q')} AS delta FROM s",
    "q04_int_delta_chunks": f"WITH {E}, d AS (SELECT *, {delta('user_id')} AS delta FROM e) SELECT event_id, chunk::BIGINT AS chunk, delta, {zz('delta')} AS zz, delta AS back FROM d",
    "q05_finite_filter": f"WITH g AS (SELECT event_type, {GAPS} AS v FROM events) SELECT event_type, count(*)::BIGINT AS n_all, count(*) FILTER (WHERE {FINITE})::BIGINT AS n_finite, count(*) FILTER (WHERE NOT isnan(v))::BIGINT AS n_not_nan FROM g GROUP BY event_type",
    "q06_voxel_dedup_first": f"WITH {VOXELS} SELECT * FROM k",
    "q07_voxel_key_packed": f"WITH {VOXELS} SELECT vec_id, ((vx + 1048576) & 2097151) + ((vy + 1048576) & 2097151) * 2097152 + ((vz + 1048576) & 2097151) * 4398046511104 AS key FROM k",
    "q08_resolution_profile_project": f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(l_quantity * 2)::BIGINT AS l_quantity, round(l_extendedprice * '{INV}'::DOUBLE)::BIGINT AS l_extendedprice, l_tax, l_returnflag, l_linestatus FROM lineitem",
    "q09_viz_removed_pct": f"WITH {VOXELS} SELECT (SELECT count(*) FROM p)::BIGINT AS total, (SELECT count(*) FROM k)::BIGINT AS kept, round(100.0::DOUBLE * (1 - (SELECT count(*) FROM k)::DOUBLE / (SELECT count(*) FROM p)), 6) AS removed_pct",
    "q10_topic_ratio": f"WITH {SIZED} " + total("count(*)::BIGINT AS messages, sum(given)::BIGINT AS given, sum(out)::BIGINT AS out, round(sum(out)::DOUBLE / sum(given)::DOUBLE, 6) AS ratio", "sized"),
    "q11_rle_runs": f"WITH {PLATEAU}, {runs('u')} SELECT * FROM runs",
    "q12_delta_rle_runs": f"WITH {E}, f AS (SELECT *, idx * 3 + (idx // 64) * (idx // 64) AS x FROM e), u AS (SELECT event_type, chunk, idx, {delta('x')} AS v FROM f), {runs('u')} SELECT * FROM runs",
    "q13_palette_first_occurrence": f"WITH {E}, f AS (SELECT *, user_id % 16 AS v FROM e), m AS (SELECT event_id, event_type, chunk, v, min(idx) OVER (PARTITION BY event_type, chunk, v) AS first FROM f) SELECT event_id, v, (dense_rank() OVER (PARTITION BY event_type, chunk ORDER BY first) - 1)::BIGINT AS code FROM m",
    "q14_section_sizes": f"WITH {USERS}, {sizes('u', 'event_type, chunk', 8)} SELECT event_type, chunk, n, \"distinct\", delta_varint, palette, rle, delta_rle FROM sizes",
    "q15_best_mode_per_chunk": f"WITH {E}, u AS (SELECT event_type, chunk, idx, CASE WHEN event_type < 'm' THEN (idx // 64) % 8 ELSE idx * 7 END AS v FROM e), {sizes('u', 'event_type, chunk', 4)} SELECT event_type, chunk, {MODE} AS mode FROM sizes",
    "q16_frozen_mode_from_probe": f"""WITH l AS (SELECT 0 AS cloud, l_linenumber::BIGINT AS v, row_number() OVER (ORDER BY {LINE_ORDER}) - 1 AS idx FROM lineitem),
c AS (SELECT *, idx // 32768 AS chunk FROM l), probe AS (SELECT cloud, 0 AS chunk, idx, v FROM c WHERE idx < 4096),
m AS (WITH {sizes('probe', 'cloud, chunk', 4)} SELECT {MODE} AS mode FROM sizes),
z AS (WITH {sizes('c', 'cloud, chunk', 4)} SELECT * FROM sizes)
SELECT chunk, n, mode, CASE mode WHEN 'delta_varint' THEN delta_varint WHEN 'palette' THEN palette WHEN 'rle' THEN rle ELSE delta_rle END AS bytes FROM z, m""",
    "q17_palette_index_bits": f"WITH {E} SELECT event_type, chunk, count(DISTINCT user_id)::BIGINT AS \"distinct\", CASE WHEN count(DISTINCT user_id) <= 1 THEN 0 ELSE length(bin(count(DISTINCT user_id) - 1)) END::BIGINT AS bits FROM e GROUP BY event_type, chunk",
    "q18_delta_roundtrip_error": f"WITH {E}, s AS (SELECT *, {TICKS} AS q FROM e) SELECT event_type, round(max(abs(q * '{RES}'::DOUBLE - value)), 9) AS max_error, sum(q)::BIGINT AS sum_q FROM s GROUP BY event_type",
    "q19_nan_reset_roundtrip": f"WITH {SEGMENTS} SELECT event_id, d, q AS back FROM d",
    "q20_rle_decode_explode": f"WITH {PLATEAU} SELECT event_type, chunk, idx, v AS value FROM u",
    "q21_xor_int_residual_roundtrip": f"WITH {E} SELECT event_id, xor(user_id, coalesce({LAG.format('user_id')}, 0)) AS residual, user_id AS back FROM e",
    "q22_schema_join_filter": "SELECT c_custkey, n_name AS topic, r_name AS schema_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE contains(r_name, 'A')",
    "q23_id_remap": "SELECT s_suppkey, (SELECT count(*) FROM nation m WHERE m.n_nationkey < n.n_nationkey)::BIGINT + 100 AS id FROM supplier JOIN nation n ON s_nationkey = n_nationkey",
    "q24_semi_channel_filter": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "q25_first_n_per_topic": "SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= 100",
    "q26_sample_every": "WITH s AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS seen FROM events) SELECT event_id, seen FROM s WHERE seen <= 500 AND (seen - 1) % 7 = 0",
    "q27_mean_of_ratios_vs_ratio_of_sums": f"WITH {SIZED}, g AS (SELECT event_type, event_id, out, given + event_id % 3 AS given FROM sized) SELECT event_type, round(avg(out::DOUBLE / given), 6) AS mean_of_ratios, round(sum(out)::DOUBLE / sum(given)::DOUBLE, 6) AS ratio_of_sums, (sum(event_id)::BIGINT // count(*))::BIGINT AS mean_whole FROM g GROUP BY event_type",
    "q28_topic_rollup": total("count(*)::BIGINT AS n, sum(user_id)::BIGINT AS users", "events"),
    "q29_count_window_report": f"WITH {SIZED}, o AS (SELECT *, row_number() OVER (ORDER BY event_id) AS seen FROM sized) SELECT ((seen + 18) // 20)::BIGINT AS report, count(*)::BIGINT AS messages, round(sum(out)::DOUBLE / sum(given)::DOUBLE, 6) AS ratio FROM o GROUP BY 1",
    "q30_max_compressed_size": "SELECT l_returnflag, count(*)::BIGINT AS n, (count(*) * (10 + 11 + 10 + 1) + ((count(*) + 32767) // 32768) * (4 + 32 * 4 + 1024))::BIGINT AS bound FROM lineitem GROUP BY l_returnflag",
    "q31_float_bits_xor": f"WITH {XYZ} SELECT vec_id, x FROM p",
    "q32_gorilla_size": f"""WITH r AS (SELECT {CLOUD} AS cloud, (value::DOUBLE::BIT)::UBIGINT AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events),
g AS (SELECT cloud, idx // 32768 AS chunk, count(*)::BIGINT AS n, list({{'v': v, 'l': -1::BIGINT, 't': 0::BIGINT, 'b': 8::BIGINT}} ORDER BY idx) AS rows FROM r GROUP BY 1, 2),
f AS (SELECT cloud, chunk, n, list_reduce(rows, lambda a, e: CASE WHEN a.v = e.v THEN {{'v': e.v, 'l': a.l, 't': a.t, 'b': a.b + 1}}
  WHEN a.l >= 0 AND {LEADING} >= a.l AND {TRAILING} >= a.t THEN {{'v': e.v, 'l': a.l, 't': a.t, 'b': a.b + (2 + 64 - a.l - a.t + 7) // 8}}
  ELSE {{'v': e.v, 'l': least({LEADING}, 31), 't': {TRAILING}, 'b': a.b + (13 + 64 - least({LEADING}, 31) - {TRAILING} + 7) // 8}} END) AS last FROM g)
SELECT cloud, chunk::BIGINT AS chunk, n, last.b AS bytes FROM f""",
    "q33_blob_roundtrip": f"SELECT event_id, round({TICKS} * '{RES}'::DOUBLE, 6) AS value, user_id FROM events",
    "q35_header_yaml": "SELECT 1::BIGINT AS id, concat_ws(chr(10), 'version: 5', 'width: 10', 'height: 2', 'point_step: 18', 'encoding_opt: LOSSY', 'compression_opt: ZSTD', 'fields:', '  - name: x', '    offset: 0', '    type: FLOAT32', '    resolution: 0.001', '  - name: ring', '    offset: 16', '    type: UINT16', '    resolution: null', '') AS header",
    "q36_message_totals": "SELECT event_type, count(*)::BIGINT AS messages, sum(length(props))::BIGINT AS bytes, sum(length(props))::BIGINT // 8 AS points, max(epoch_us(ts)) - min(epoch_us(ts)) AS duration_us, round(sum(length(props))::DOUBLE / nullif(max(epoch_us(ts)) - min(epoch_us(ts)), 0), 9) AS mb_per_s FROM events GROUP BY event_type",
    "q37_channel_counts_by_schema": "SELECT r_name AS schema_name, count(*)::BIGINT AS channels FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "q38_weighted_throughput": f"WITH {SIZED} SELECT event_type, round(sum((event_id % 50 + 1) * out)::DOUBLE / sum(out)::DOUBLE, 6) AS weighted FROM sized GROUP BY event_type",
    "q39_first_message_per_topic": "SELECT event_type, event_id, epoch_us(ts) AS us FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1",
    "q40_global_first_n": "SELECT event_id, event_type FROM events ORDER BY ts, event_id LIMIT 25",
    "q41_sorted_schema_names": "SELECT row_number() OVER (ORDER BY name) AS place, name FROM (SELECT DISTINCT event_type AS name FROM events)",
    "q42_pass_through_union": f"SELECT event_id, CASE WHEN event_type < 'm' THEN {TICKS}::DOUBLE ELSE value END AS value, event_type < 'm' AS converted FROM events",
    "q43_payload_size_check": "SELECT length(l_returnflag) = (CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END) AS whole, count(*)::BIGINT AS n FROM lineitem GROUP BY 1",
    "q44_interleaved_payload": f"WITH f AS (SELECT unnest(embedding) AS v, unnest(range(len(embedding))) AS field FROM embeddings) SELECT field, field * 4 AS offset, count(*)::BIGINT AS n, sum(round((v * {float(np.float32(1) / np.float32(0.001))!r}::FLOAT)::DOUBLE)::BIGINT)::BIGINT AS ticks FROM f GROUP BY field",
    "q45_nanosecond_times": "SELECT event_id, (epoch_us(ts) * 1000 + event_id % 1000) // 1000000000 AS sec, (epoch_us(ts) * 1000 + event_id % 1000) % 1000000000 AS nsec, epoch_us(ts) AS us FROM events",
    "q47_header_equality": """WITH h AS (SELECT label, vec_id, len(embedding) - (vec_id % 7 = 0)::INT AS n, vec_id % 11 = 0 AS wide FROM embeddings),
f AS (SELECT label, arg_min(n, vec_id) AS n0, arg_min(wide, vec_id) AS wide0 FROM h GROUP BY label)
SELECT label, n = n0 AND wide = wide0 AS same, count(*)::BIGINT AS n FROM h JOIN f USING (label) GROUP BY 1, 2""",
    "q48_nan_free_subset": f"WITH {E}, g AS (SELECT event_id, idx, {GAPS} AS v FROM e) SELECT event_id, idx // 100 AS row, idx % 100 AS col FROM g WHERE NOT isnan(v)",
    "q49_ranked_samples": f"WITH {SIZED}, r AS (" + total("round(sum(out)::DOUBLE / sum(given)::DOUBLE, 6) AS ratio", "sized") + ") SELECT 'sample' || (row_number() OVER (ORDER BY ratio, event_type) - 1) AS name, event_type, ratio FROM r",
    "q50_typed_fields": "SELECT l_orderkey, l_linenumber FROM lineitem",
    "q46_topic_fingerprint": f"""WITH {E}, b AS (SELECT event_type, chunk, flatten(list([(event_id >> (8 * k)) & 255 for k in range(8)] ORDER BY idx)) AS bytes FROM e GROUP BY 1, 2),
f AS (SELECT event_type, chunk, list_reduce([x::UHUGEINT for x in bytes], lambda a, b: (xor(a, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM b)
SELECT event_type, chunk::BIGINT AS chunk, lpad(lower(hex(h::UBIGINT)), 16, '0') AS fnv FROM f""",
    "q51_stage1_size": f"""WITH r AS (SELECT {CLOUD} AS cloud, event_id, user_id, {TICKS} AS q, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS idx FROM events),
c AS (SELECT *, idx // 32768 AS chunk FROM r),
t AS (SELECT cloud, chunk, q - coalesce(lag(q) OVER (PARTITION BY cloud, chunk ORDER BY idx), 0) AS d FROM c),
v AS (SELECT cloud, chunk, sum({uv(zz('d') + ' + 1')}) AS bytes FROM t GROUP BY cloud, chunk),
{section_bytes('ids', 'event_id')}, {section_bytes('users', 'user_id')}
SELECT cloud, chunk::BIGINT AS chunk, ids.n AS n, (v.bytes + ids.bytes + users.bytes)::BIGINT AS stage1_bytes, (v.bytes + ids.bytes + users.bytes)::BIGINT AS bytes
FROM v JOIN ids USING (cloud, chunk) JOIN users USING (cloud, chunk)""",
    "q52_cdr_messages": f"""WITH {E} SELECT event_type, chunk::BIGINT AS chunk, {MESSAGE_BYTES}::BIGINT AS message_bytes, chunk::INT AS stamp_sec, 5::BIGINT AS stamp_nsec, event_type AS frame_id,
  1::BIGINT AS height, count(*)::BIGINT AS width, 12::BIGINT AS point_step, 12 * count(*)::BIGINT AS row_step, 12 * count(*)::BIGINT AS size, true AS is_dense, 'value@0:8,user@8:5' AS fields
FROM e GROUP BY event_type, chunk""",
    "q53_compressed_messages": f"WITH {E} SELECT event_type, chunk::BIGINT AS chunk, count(*)::BIGINT AS width, true AS packed, sum({TICKS})::BIGINT AS ticks, sum(user_id)::BIGINT AS users FROM e GROUP BY event_type, chunk",
    "q54_display_messages": """WITH p AS (SELECT label::BIGINT AS label, embedding[1]::FLOAT AS x, embedding[2]::FLOAT AS y, embedding[3]::FLOAT AS z FROM embeddings),
v AS (SELECT label, round((x * 10::FLOAT)::DOUBLE) AS vx, round((y * 10::FLOAT)::DOUBLE) AS vy, round((z * 10::FLOAT)::DOUBLE) AS vz FROM p WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
k AS (SELECT label, count(*)::BIGINT AS kept FROM (SELECT DISTINCT * FROM v) GROUP BY label)
SELECT label, points, kept, 12 * kept AS kept_bytes FROM k JOIN (SELECT label, count(*)::BIGINT AS points FROM p GROUP BY label) USING (label)""",
    "q55_blob_headers": f"SELECT {CLOUD} AS cloud, count(*)::BIGINT AS width, 24::BIGINT AS point_step, 'event_id:INT64,value:FLOAT64,user_id:INT64' AS fields FROM events GROUP BY event_type",
    "q56_pcd_files": f"""WITH {XYZ}, l AS (SELECT label::BIGINT AS label, p.* FROM p JOIN embeddings USING (vec_id))
SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, vec_id AS id, round(x::DOUBLE, 5) AS x, round(y::DOUBLE, 5) AS y, round(z::DOUBLE, 5) AS z FROM l""",
    "q57_containers": """WITH t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS k FROM (SELECT DISTINCT event_type FROM events))
SELECT (event_id % 3) || '.mcap' AS file, event_type AS topic, CASE WHEN k % 2 = 1 THEN 'even' ELSE 'odd' END AS schema_name, count(*)::BIGINT AS messages,
  sum(octet_length(encode(props)))::BIGINT AS bytes, min(epoch_us(ts)) AS first, sum(event_id % 1000)::BIGINT AS sequences FROM events JOIN t USING (event_type) GROUP BY event_id % 3, event_type, k""",
    "q58_stream_reports": """WITH m AS (SELECT event_type, event_id, 1 + octet_length(encode(props)) AS raw, CASE WHEN user_id % 2 = 1 THEN 0 ELSE least(8, 1 + octet_length(encode(props))) END AS made,
  (row_number() OVER (PARTITION BY event_type ORDER BY event_id) + 18) // 20 AS report FROM events),
r AS (SELECT event_type AS topic, report, count(*)::BIGINT AS messages, sum(raw)::BIGINT AS raw_bytes, sum(made)::BIGINT AS out_bytes FROM m GROUP BY 1, 2)
SELECT topic, report::BIGINT AS report, messages, raw_bytes, out_bytes, round(out_bytes::DOUBLE / raw_bytes::DOUBLE, 6) AS ratio FROM r WHERE messages = 20 OR report = 0""",
    "q59_versions_and_encodings": "SELECT label::BIGINT AS label, version::BIGINT AS version, encoding, count(*)::BIGINT AS points, true AS kept FROM embeddings, (SELECT unnest([2, 3, 4, 5]) AS version), (SELECT unnest(['NONE', 'LOSSY', 'LOSSLESS']) AS encoding) GROUP BY 1, 2, 3",
    "q60_sql_functions": f"WITH {E} SELECT event_type, chunk::BIGINT AS chunk, 12 * count(*)::BIGINT AS size, 12 * count(*)::BIGINT AS points_bytes, count(*)::BIGINT AS width, {MESSAGE_BYTES}::BIGINT AS message_bytes, true AS fits, true AS refused FROM e GROUP BY event_type, chunk",
    "q61_bit_packing": f"""WITH {E}, d AS (SELECT event_type, chunk, count(*) AS n, count(DISTINCT user_id % 37) AS k FROM e GROUP BY event_type, chunk),
b AS (SELECT *, CASE WHEN k <= 1 THEN 0 ELSE length(bin(k - 1)) END AS bits FROM d)
SELECT event_type, chunk::BIGINT AS chunk, bits::BIGINT AS bits, ((bits * n + 7) // 8)::BIGINT AS bytes, true AS whole FROM b""",
    "q62_scalar_texts": """SELECT n_nationkey::BIGINT AS id, n_nationkey::BIGINT AS width, 'ZSTD' AS compression, n_name AS name,
  ['INT8', 'UINT8', 'INT16', 'UINT16', 'INT32', 'UINT32', 'FLOAT32', 'FLOAT64', 'INT64', 'UINT64'][n_nationkey % 10 + 1] AS type,
  CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE round(('0.' || (n_nationkey + 1))::DOUBLE, 6) END AS resolution FROM nation""",
}
