"""The catalogue's queries in DuckDB's SQL, written from the operators' definitions, for those that SQL expresses plainly."""

from __future__ import annotations

from ..operators.decide import ENCODING
from ..sources.adapters import EDITS

EV = "ev AS (SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 AS t, user_id, event_type, value, props FROM events)"


def _word(first: int) -> str:
    return f"list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[i + {first + 1}] > 0 THEN 1::BIGINT << (31 - i) ELSE 0 END))::BIGINT"


FR = (
    f"f AS (SELECT label::BIGINT AS media_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS frame_idx, {_word(0)} AS h0, {_word(32)} AS h1,"
    " round(list_aggregate(list_transform(range(1, len(embedding) - 1), lambda i: embedding[i]::DOUBLE - 2 * embedding[i + 1]::DOUBLE + embedding[i + 2]::DOUBLE), 'var_pop') * 500, 6) AS lap_var FROM embeddings)"
)
PAIRS = "p AS (SELECT range AS pair_id, (range + 1) % 10 AS primary_id, range AS target_id FROM range(10))"
HD = "(bit_count(xor(r0, h0))::BIGINT + bit_count(xor(r1, h1))::BIGINT)"
BAND = "CASE WHEN hd <= 8 THEN 'high' WHEN hd <= 24 THEN 'medium' ELSE 'low' END"


def _refs(where: str) -> str:
    return f"{FR}, {PAIRS}, r AS (SELECT p.pair_id, p.primary_id, f.frame_idx AS ref_no, f.frame_idx / 24e0 AS ref_t, h0 AS r0, h1 AS r1 FROM p JOIN f ON f.media_id = p.target_id WHERE {where})"


def _coarse(step: int) -> str:
    return f"c AS (SELECT pair_id, ref_no, hd, frame_idx FROM (SELECT pair_id, ref_no, {HD} AS hd, f.frame_idx, row_number() OVER (PARTITION BY pair_id, ref_no ORDER BY {HD}, f.frame_idx) AS k FROM r JOIN f ON f.media_id = r.primary_id WHERE f.frame_idx % {step} = 0) WHERE k = 1)"


def _reference_frames(skip_start: int, skip_end: int, refs: int, reach: int, step: int, content: int = 50) -> str:
    """CTE nr (media_id, ref_no, goal, frame_idx, found, lost) from f: a step a reference, which takes a frame that none before it has."""
    return f"""nt AS (SELECT media_id, count(*) AS total FROM f GROUP BY media_id), nl AS (SELECT media_id, total, least({skip_start}, total - 1) AS lo, greatest(least({skip_start}, total - 1) + 1, total - {skip_end}) AS hi FROM nt),
ng AS (SELECT media_id, r.range AS ref_no, least(total - 1, trunc(lo + r.range * (hi - lo) / {refs + 1}e0)::BIGINT) AS goal FROM nl, range(1, {refs + 1}) r),
nk AS (SELECT ng.media_id, ref_no, list(f.frame_idx ORDER BY k.range, -s.s) AS near FROM ng, range({-(-reach // step)}) k, (VALUES (1), (-1)) s(s), f WHERE f.media_id = ng.media_id AND f.frame_idx = goal + s.s * k.range * {step} AND (k.range > 0 OR s.s > 0) AND lap_var > {content} GROUP BY ALL),
nr AS (SELECT media_id, 0::BIGINT AS ref_no, NULL::BIGINT AS goal, NULL::BIGINT AS frame_idx, false AS found, false AS lost, []::BIGINT[] AS taken FROM nt
UNION ALL SELECT media_id, ref_no, goal, coalesce(free[1], goal), len(free) > 0, len(free) = 0 AND list_contains(taken, goal), list_append(taken, coalesce(free[1], goal)) FROM (SELECT ng.media_id, ng.ref_no, ng.goal, nr.taken, list_filter(coalesce(near, []), lambda x: NOT list_contains(nr.taken, x)) AS free
FROM nr JOIN ng ON ng.media_id = nr.media_id AND ng.ref_no = nr.ref_no + 1 LEFT JOIN nk ON nk.media_id = ng.media_id AND nk.ref_no = ng.ref_no) z)"""


SHIFT = "coalesce(CASE WHEN abs(af - 2 * hd + bf) > 1e-9 AND abs(0.5e0 * (bf - af) / (af - 2 * hd + bf)) < 0.95e0 THEN 0.5e0 * (bf - af) / (af - 2 * hd + bf) END, 0e0)"


def _fine(c: str, out: str) -> str:
    return f"""{out}_e AS (SELECT r.pair_id, r.ref_no, c.hd, c.frame_idx, f.frame_idx AS fr, {HD} AS d FROM r JOIN {c} c USING (pair_id, ref_no) JOIN f ON f.media_id = r.primary_id AND f.frame_idx BETWEEN c.frame_idx - 22 AND c.frame_idx + 22),
{out}_w AS (SELECT pair_id, ref_no, least(hd, d) AS hd, CASE WHEN d < hd THEN fr ELSE frame_idx END AS frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, ref_no ORDER BY d, fr) AS k FROM {out}_e) WHERE k = 1),
{out}_n AS (SELECT w.pair_id, w.ref_no, w.hd, w.frame_idx, max(CASE WHEN e.fr = w.frame_idx - 1 THEN d END) AS bf, max(CASE WHEN e.fr = w.frame_idx + 1 THEN d END) AS af FROM {out}_w w JOIN {out}_e e USING (pair_id, ref_no) GROUP BY ALL),
{out} AS (SELECT pair_id, ref_no, hd, frame_idx, {SHIFT} AS shift FROM {out}_n)"""


def _offset(fine: str, where: str = "true") -> str:
    return f"SELECT pair_id, ref_no, hd, frame_idx, round((frame_idx + shift) / 24e0 - ref_t, 6) + 0e0 AS \"offset\", {BAND} AS confidence FROM {fine} JOIN r USING (pair_id, ref_no) WHERE {where}"


def _band(refs: str, lo: str, hi: str) -> str:
    return f"""{_refs(refs)}, e AS (SELECT pair_id, ref_no, ref_t, f.frame_idx AS fr, {HD} AS d FROM r JOIN f ON f.media_id = r.primary_id AND f.frame_idx BETWEEN greatest(0, {lo}) AND {hi}),
w AS (SELECT pair_id, ref_no, ref_t, d AS hd, fr AS frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, ref_no ORDER BY d, fr) AS k FROM e) WHERE k = 1 AND d <= 28),
n AS (SELECT w.pair_id, w.ref_no, w.ref_t, w.hd, w.frame_idx, max(CASE WHEN e.fr = w.frame_idx - 1 THEN d END) AS bf, max(CASE WHEN e.fr = w.frame_idx + 1 THEN d END) AS af FROM w JOIN e USING (pair_id, ref_no) GROUP BY ALL),
b AS (SELECT *, {SHIFT} AS shift FROM n)"""


_VISUAL = _band("true", "round_even(ref_t * 24, 0)::BIGINT - 6", "round_even(ref_t * 24, 0)::BIGINT + 6")
MEDIA = f"{EV}, m AS (SELECT user_id AS media_id, round((max(t) - min(t)) / 1000, 3) AS duration FROM ev GROUP BY user_id)"
EDGE = "CASE WHEN duration <= 11 THEN 0e0 ELSE 5e0 END"

ENERGY = f"{EV}, en AS (SELECT event_type AS media_id, floor(t / 3600)::BIGINT AS bin, sqrt(avg(value * value) + 1e-12) AS rms FROM ev GROUP BY ALL)"
GRID = "g AS (SELECT media_id, range AS bin FROM (SELECT DISTINCT media_id FROM en), range(720))"
THRESHOLD = """cu AS (SELECT media_id, quantile_cont(level, 0.3) AS a, quantile_cont(level, 0.9) AS b FROM lv GROUP BY media_id),
ac AS (SELECT media_id, bin, (round(level, 9) > round(a + 0.5e0 * (b - a), 9))::INT::DOUBLE AS v FROM lv JOIN cu USING (media_id))"""
ACTIVE = f"""{ENERGY}, {GRID}, lv AS (SELECT g.media_id, g.bin, log10(coalesce(rms, 0) + 1e-6) AS level FROM g LEFT JOIN en USING (media_id, bin)), {THRESHOLD}"""
_NB = "OVER (PARTITION BY media_id ORDER BY bin)"
SMOOTHED = f"""s1 AS (SELECT media_id, bin, CASE WHEN v = 0 AND lag(v) {_NB} = 1 AND lead(v) {_NB} = 1 THEN 1e0 ELSE v END AS v FROM ac),
s2 AS (SELECT media_id, bin, CASE WHEN v = 1 AND lag(v) {_NB} = 0 AND lead(v) {_NB} = 0 THEN 0e0 ELSE v END AS v FROM s1),
sg AS (SELECT media_id, bin, v - avg(v) OVER (PARTITION BY media_id) AS v FROM s2)"""
SMOOTH = f"{ACTIVE}, {SMOOTHED}"
CUTS = f"""{EV}, ct AS (SELECT event_type AS media_id, t FROM ev),
hi AS (SELECT DISTINCT media_id, round_even(t / 3600, 0)::BIGINT AS bin FROM ct WHERE round_even(t / 3600, 0) BETWEEN 0 AND 719),
hg AS (SELECT media_id, g.bin, (hi.bin IS NOT NULL)::INT::DOUBLE AS v FROM (SELECT media_id, range AS bin FROM (SELECT DISTINCT media_id FROM hi), range(720)) g LEFT JOIN hi USING (media_id, bin))"""
CUTS_SMOOTH = f"""{CUTS}, ks AS (SELECT media_id, bin, (v + 0.25e0 * coalesce(lag(v, 2) {_NB}, 0) + 0.5e0 * coalesce(lag(v, 1) {_NB}, 0) + 0.5e0 * coalesce(lead(v, 1) {_NB}, 0) + 0.25e0 * coalesce(lead(v, 2) {_NB}, 0)) / 2.5e0 AS v FROM hg),
sg AS (SELECT media_id, bin, v - avg(v) OVER (PARTITION BY media_id) AS v FROM ks)"""
_KINDS = "['click', 'error', 'purchase', 'signup', 'view']"
SIGNAL_PAIRS = f"sp AS (SELECT range AS pair_id, {_KINDS}[range + 1] AS primary_id, {_KINDS}[(range + 1) % 5 + 1] AS target_id FROM range(5))"


def _lagged(lags: int) -> str:
    """CTEs from sp (pairs) and sg (signals) to bl: the best lag of a pair."""
    return f"""xc AS (SELECT pair_id, l.range AS lag, sum(coalesce(a.v * b.v, 0)) AS x FROM sp CROSS JOIN range({-lags - 1}, {lags + 2}) l JOIN sg b ON b.media_id = sp.target_id LEFT JOIN sg a ON a.media_id = sp.primary_id AND a.bin = b.bin + l.range GROUP BY ALL),
xr AS (SELECT pair_id, lag, round(x, 9) AS x FROM xc),
pk AS (SELECT pair_id, lag, x FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY x DESC, lag) AS k FROM xr WHERE abs(lag) <= {lags}) WHERE k = 1),
pv AS (SELECT pk.pair_id, pk.lag, pk.x, b.x AS bf, a.x AS af FROM pk LEFT JOIN xr b ON b.pair_id = pk.pair_id AND b.lag = pk.lag - 1 LEFT JOIN xr a ON a.pair_id = pk.pair_id AND a.lag = pk.lag + 1),
bl AS (SELECT pair_id, lag, x, (lag + coalesce(CASE WHEN abs(bf - 2 * x + af) >= 1e-12 THEN greatest(-1e0, least(1e0, 0.5e0 * (bf - af) / (bf - 2 * x + af))) END, 0)) * 3600e0 AS o FROM pv),
pw AS (SELECT media_id, sum(v * v) AS e FROM sg GROUP BY media_id)"""


LAGGED = f"{SIGNAL_PAIRS}, {_lagged(24)}"


def _by_signal(hi: float, mid: float, where: str = "true") -> str:
    return f"""SELECT pair_id, lag, round(o, 6) + 0e0 AS "offset", round(peak, 6) AS peak, CASE WHEN peak >= {hi}e0 THEN 'high' WHEN peak >= {mid}e0 THEN 'medium' ELSE 'low' END AS confidence FROM (
SELECT bl.pair_id, bl.lag, o, round(greatest(0, least(1, x / (sqrt(a.e * b.e) + 1e-12))), 9) AS peak, primary_id, target_id FROM bl JOIN sp USING (pair_id) JOIN pw a ON a.media_id = primary_id JOIN pw b ON b.media_id = target_id) WHERE {where}"""


WINDOWED = f"""lv AS (SELECT name || ':' || side AS media_id, x.bin, log10(coalesce(rms, 1e-6) + 1e-6) AS level FROM (SELECT name, side, b0, src, unnest(range(nb)) AS bin FROM
(SELECT name, 'p' AS side, pb AS b0, primary_id AS src, nb FROM wi UNION ALL SELECT name, 't', tb, target_id, nb FROM wi)) x LEFT JOIN en ON en.media_id = src AND en.bin = b0 + x.bin), {THRESHOLD}, {SMOOTHED},
sp AS (SELECT name AS pair_id, name || ':p' AS primary_id, name || ':t' AS target_id FROM wi), {_lagged(2)}, ld AS (SELECT media_id FROM s2 GROUP BY media_id HAVING avg(v) >= 0.05e0),
wo AS (SELECT bl.pair_id AS name, o, round(greatest(0, least(1, x / (sqrt(a.e * b.e) + 1e-12))), 9) AS peak FROM bl JOIN sp USING (pair_id) JOIN pw a ON a.media_id = primary_id JOIN pw b ON b.media_id = target_id
WHERE primary_id IN (SELECT media_id FROM ld) AND target_id IN (SELECT media_id FROM ld))"""
REFINED = f"""{ENERGY}, s0 AS (SELECT pair_id, seg_no.range AS seg_no, primary_id, target_id, seg_no.range * 720000e0 AS t0, (seg_no.range + 1) * 720000e0 AS t1, (pair_id - 2) * 3600e0 AS off FROM (WITH {SIGNAL_PAIRS} SELECT * FROM sp), range(3) seg_no),
sx AS (SELECT * REPLACE (t0 + greatest(0, -(t0 + off)) AS t0) FROM s0),
wi AS (SELECT *, pair_id || ':' || seg_no AS name, round_even((t0 + off) / 3600, 0)::BIGINT AS pb, floor(t0 / 3600)::BIGINT AS tb, floor((t1 - t0) / 3600)::BIGINT AS nb FROM sx WHERE t1 - t0 >= 30 AND floor((t1 - t0) / 3600) >= 50), {WINDOWED}"""
DRIFTED = f"""{ENERGY}, wi AS (SELECT pair_id, w.range AS window_no, primary_id, target_id, pair_id || ':' || w.range AS name, 5 + w.range * 48 AS pb, 5 + w.range * 48 AS tb, 48 AS nb FROM (WITH {SIGNAL_PAIRS} SELECT * FROM sp), range(14) w), {WINDOWED},
dw AS (SELECT pair_id, window_no, pb * 3600e0 AS w_start, (pb + 48) * 3600e0 AS w_end, o * 1000 AS delta_ms, peak FROM wi JOIN wo USING (name) WHERE peak >= 0.02e0)"""


def _samples(noisy: bool) -> str:
    o = "value / 100" if noisy else "floor(t / 864000) * 0.4e0 + value / 10000"
    return f"{EV}, s AS (SELECT user_id % 10 AS pair_id, event_id AS id, t AS target_t, round({o}, 6) AS o, event_id % 17 AS hd FROM ev)"


def _despiked(source: str, passes: int) -> str:
    """CTEs d0..dn over (pair_id, id, target_t, o)."""
    w = "OVER (PARTITION BY pair_id ORDER BY target_t, id)"
    out = [f"d0 AS (SELECT pair_id, id, target_t, o, 0 AS fixes FROM {source})"]
    for k in range(passes):
        out.append(f"n{k} AS (SELECT *, lag(o) {w} AS b, lead(o) {w} AS a FROM d{k})")
        lone = "coalesce(round(abs(b - a), 9) <= 0.42e0 AND round(abs(o - b), 9) > 0.65e0 AND round(abs(o - a), 9) > 0.65e0, false)"
        out.append(f"d{k + 1} AS (SELECT pair_id, id, target_t, CASE WHEN {lone} THEN (b + a) / 2 ELSE o END AS o, fixes + {lone}::INT AS fixes FROM n{k})")
    return ",\n".join(out)


PROBES = f"{_samples(True)}, pr AS (SELECT pair_id, id, target_t, round(target_t + o, 6) AS p, o, hd FROM s)"
CLUSTER_TAIL = """cj AS (SELECT *, coalesce(round(o - lag(o) OVER (PARTITION BY pair_id ORDER BY o, id), 9) > 0.35e0, false)::INT AS j FROM pr),
cl AS (SELECT *, sum(j) OVER (PARTITION BY pair_id ORDER BY o, id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM cj)"""
CLUSTERED = f"{PROBES}, {CLUSTER_TAIL}"
BLACKS = f"{EV}, bk AS (SELECT user_id % 10 AS pair_id, event_id AS id, t AS b_start, t + value / 100 AS b_end FROM ev WHERE event_type = 'error')"
GAPS = "gp AS (SELECT p.range AS pair_id, g.range AS gap_no, g.range * 86000e0 AS lo, g.range * 86000e0 + p.range * 2000e0 + 500 AS hi FROM range(10) p, range(1, 31) g)"
SEGMENTS = """sm AS (SELECT * FROM (VALUES (0,0,0e0,100e0,2e0),(0,1,100e0,200e0,2.029e0),(0,2,200e0,300e0,2.059e0),(1,0,0e0,50e0,-5e0),(1,1,50e0,60e0,-30e0),(1,2,60e0,120e0,-29e0),
(2,0,0e0,3e0,-4e0),(2,1,3e0,90e0,-4e0),(3,0,0e0,80e0,0e0),(3,1,80e0,400e0,0.5e0),(3,2,400e0,450e0,0.2e0),(4,0,0e0,10e0,0.01e0),(4,1,10e0,20e0,0.01e0)) v(pair_id, seg_no, a, b, o)),
du AS (SELECT * FROM (VALUES (0,302.05e0),(1,80e0),(2,1000e0),(3,320e0),(4,15e0)) v(pair_id, primary_duration))"""
TRIM = """ce AS (SELECT *, round(sum(duration) OVER (PARTITION BY pair_id ORDER BY seg_no, place ROWS UNBOUNDED PRECEDING), 9) AS e FROM ch JOIN du USING (pair_id)),
kp AS (SELECT *, CASE WHEN e > primary_duration + 1e-3 THEN e - primary_duration ELSE 0e0 END AS less FROM ce WHERE NOT (e > primary_duration + 1e-3 AND e - duration >= primary_duration - 1e-3)),
ck AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY seg_no, place) - 1 AS chunk_no, kind, target_start, target_end - less AS target_end, duration - less AS duration FROM kp)"""
CHUNKS = f"""gx AS (SELECT *, lag(b + o) OVER (PARTITION BY pair_id ORDER BY seg_no) AS prev FROM sm),
gg AS (SELECT *, round(a + o - coalesce(prev, 0), 9) AS gap, prev IS NULL AS first FROM gx),
st AS (SELECT *, CASE WHEN (first AND gap > 0) OR (NOT first AND gap >= 0.03e0) THEN gap END AS filler, a + CASE WHEN gap < 0 AND (first OR gap < -1e-6) THEN -gap ELSE 0 END AS s0 FROM gg),
ch AS (SELECT pair_id, seg_no, 0 AS place, 'filler' AS kind, NULL::DOUBLE AS target_start, NULL::DOUBLE AS target_end, filler AS duration FROM st WHERE filler IS NOT NULL
UNION ALL SELECT pair_id, seg_no, 1, 'target', s0, b, b - s0 FROM st WHERE b > s0), {TRIM}"""
CAND = f"""{EV}, cd AS (SELECT event_id AS pair_id, CASE WHEN event_id % 8 <> 3 THEN round(value / 50, 3) END AS v_off, CASE WHEN event_id % 8 <> 3 THEN event_id % 23 END AS v_hd,
CASE WHEN event_id % 8 <> 5 THEN round(value / 50 + user_id % 9 * 0.1e0, 3) END AS a_off, round(user_id % 11 * 0.07e0, 2) AS a_peak,
CASE WHEN event_id % 8 <> 6 THEN round(value / 50 + user_id % 7 * 0.12e0, 3) END AS c_off, round(event_id % 13 * 0.05e0, 2) AS c_peak FROM ev)"""
CONS_TAIL = """co AS (SELECT *, coalesce(round(abs(a_off - c_off), 9) <= 0.15e0 AND round(abs(a_off - v_off), 9) > 0.5e0 AND round(abs(c_off - v_off), 9) > 0.5e0, false) AS overridden FROM cd),
cn AS (SELECT *, CASE WHEN overridden THEN CASE WHEN greatest(0, a_peak) + greatest(0, c_peak) > 1e-6 THEN (greatest(0, a_peak) * a_off + greatest(0, c_peak) * c_off) / (greatest(0, a_peak) + greatest(0, c_peak)) ELSE (a_off + c_off) / 2 END ELSE v_off END AS o FROM co)"""
CONS = f"{CAND}, {CONS_TAIL}"
CASCADE_TAIL = """fc AS (SELECT *, CASE WHEN overridden THEN 'consensus' WHEN v_off IS NOT NULL THEN 'visual' WHEN coalesce(c_peak >= 0.3e0, false) AND c_off IS NOT NULL THEN 'cut' WHEN coalesce(a_peak >= 0.35e0, false) AND a_off IS NOT NULL THEN 'audio' ELSE 'none' END AS source FROM cn)"""
CASCADE = f"{CONS}, {CASCADE_TAIL}"
NEAR = f"""{EV}, nc AS (SELECT p.user_id AS pair_id, p.event_id AS p_id, p.t AS p_t, s.event_id AS s_id, s.t AS s_t, round(abs(p.t - s.t), 6) AS gap FROM ev p JOIN ev s ON p.user_id = s.user_id AND p.event_type = 'click' AND s.event_type = 'view' WHERE round(abs(p.t - s.t), 6) <= 3600)"""
GREEDY = f"""{NEAR}, gc AS (SELECT pair_id, p_id, p_t, list({{'s': s_id, 'st': s_t, 'g': gap}} ORDER BY gap, s_t, s_id) AS c, row_number() OVER (PARTITION BY pair_id ORDER BY p_t, p_id) AS k FROM nc GROUP BY pair_id, p_id, p_t),
gw AS (SELECT DISTINCT pair_id, 0::BIGINT AS k, []::BIGINT[] AS taken, NULL::BIGINT AS p_id, NULL::DOUBLE AS p_t, NULL::STRUCT(s BIGINT, st DOUBLE, g DOUBLE) AS b FROM gc
UNION ALL SELECT pair_id, k, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.s) END, p_id, p_t, b FROM (SELECT gc.pair_id, gc.k, taken, gc.p_id, gc.p_t, list_filter(c, lambda x: NOT list_contains(taken, x.s))[1] AS b FROM gw JOIN gc ON gc.pair_id = gw.pair_id AND gc.k = gw.k + 1) z),
gm AS (SELECT pair_id, p_id, b.s AS s_id, p_t, b.st AS s_t, b.g AS gap, round(b.st - p_t, 6) AS late FROM gw WHERE b IS NOT NULL),
gn AS (SELECT user_id AS pair_id, count(*) FILTER (event_type = 'click') AS cp, count(*) FILTER (event_type = 'view') AS cs FROM ev WHERE event_type IN ('click', 'view') GROUP BY user_id),
gk AS (SELECT gn.pair_id, cp AS cuts_primary, cs AS cuts_synced, cp - coalesce(m, 0) AS unmatched_primary, cs - coalesce(m, 0) AS unmatched_synced FROM gn LEFT JOIN (SELECT pair_id, count(*) AS m FROM gm GROUP BY pair_id) USING (pair_id))"""
DRIFT = f"""{EV}, dr AS (SELECT user_id % 10 AS pair_id, event_id AS id, t, round(value / 100 - 0.5e0, 6) AS df FROM ev),
ds AS (SELECT pair_id, count(*) AS n, max(abs(df)) AS mx, avg(abs(df)) AS mean, max(abs(df)) * 1000 / 24e0 AS ms, avg((abs(df) <= 0.5e0)::INT) AS half FROM dr GROUP BY pair_id)"""


def _timecode(t: str) -> str:
    f = f"round_even(abs({t}) * 24, 0)::BIGINT"
    return f"(CASE WHEN {t} < 0 AND {f} > 0 THEN '-' ELSE '' END || printf('%d:%02d:%02d:%02d', {f} // 24 // 3600, {f} // 24 // 60 % 60, {f} // 24 % 60, {f} % 24))"


NAMES = """nm AS (SELECT p_partkey // 40 AS folder, CASE WHEN p_partkey % 2 = 0 THEN 'primary' ELSE 'target' END AS side, p_partkey AS id,
'/media/' || replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '_primary' WHEN 1 THEN '_PRIMARY' ELSE '_cam1' END || CASE WHEN p_partkey % 5 = 0 THEN '.txt' WHEN p_partkey % 2 = 0 THEN '.MKV' ELSE '.mp4' END AS path FROM part)"""
_BASE = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]*$', '')"
for _suffix in ("_primary", "_anchor", "_cam1", "_cam2", "_target", "_synced"):
    _BASE = f"replace({_BASE}, '{_suffix}', '')"
BATCH = f"trim(lower({_BASE}))"
UI = rf"trim(regexp_replace(regexp_replace({BATCH}, '[_.-]', ' ', 'g'), '\s+', ' ', 'g'))"
VIDEO = r"regexp_matches(lower(path), '\.(mp4|mkv|mov|avi|mxf|ts|webm|flv|wmv)$')"
DISTANCE = f"""{NAMES}, nn AS (SELECT *, {BATCH} AS name FROM nm),
lv AS (SELECT p.folder, p.id AS p_id, t.id AS t_id, levenshtein(p.name, t.name) AS distance FROM nn p JOIN nn t ON p.folder = t.folder AND p.side = 'primary' AND t.side = 'target'),
lk AS (SELECT *, row_number() OVER (PARTITION BY folder, p_id ORDER BY distance, t_id) AS rank FROM lv)"""
PROBE = f"""{EV}, pk AS (SELECT event_id AS media_id, json_extract_string(props, '$.k')::INT AS k FROM ev),
pm AS (SELECT media_id, k, CASE WHEN k % 11 <> 0 THEN k + 0.5e0 ELSE 0e0 END AS duration, k % 13 <> 0 AS has_video, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 2 = 0 THEN 24000 / 1001e0 ELSE 25e0 END AS rate FROM pk),
pd AS (SELECT media_id, duration, CASE WHEN has_video THEN rate END AS fps, CASE WHEN has_video THEN CASE WHEN k % 7 = 0 THEN '0/0' WHEN k % 2 = 0 THEN '24000/1001' ELSE '25/1' END END AS fps_rational,
CASE WHEN has_video THEN coalesce(CASE WHEN k % 3 <> 0 THEN nullif(k, 0) END, trunc(duration * rate)::BIGINT) END::BIGINT AS total_frames, CASE WHEN has_video THEN 1920 END::BIGINT AS width, CASE WHEN has_video THEN 1080 END::BIGINT AS height,
has_video AND k % 5 <> 0 AS has_audio, CASE WHEN has_video THEN 'h264' END AS codec_name, CASE WHEN has_video AND k % 5 <> 0 THEN 'aac' END AS audio_codec, CASE WHEN has_video AND k % 5 <> 0 THEN 48000 END::BIGINT AS audio_sample_rate,
CASE WHEN NOT has_video THEN 'no video stream' WHEN rate IS NULL THEN 'bad frame rate' END AS error FROM pm)"""



def _walk(near: str, agree: float, state: str, solo: bool) -> str:
    """CTEs: wr (usable rows in order), wk (one step a row), wa (pair_id, id, grp). state: how the open group is kept, by mean or by list."""
    first = {"mean": "o AS total, 1 AS cnt", "list": "[o] AS total, 1 AS cnt"}[state]
    add = {"mean": "k.total + r.o", "list": "list_append(k.total, r.o)"}[state]
    fresh = {"mean": "k.po + r.o", "list": "[k.po, r.o]"}[state]
    joins, opens = near, f"k.po IS NOT NULL AND round(abs(r.o - k.po), 9) <= {agree}e0"
    tail = "UNION ALL SELECT k.pair_id, k.pid, k.grp + 1 FROM wk k JOIN (SELECT pair_id, max(rn) AS rn FROM wr GROUP BY pair_id) z USING (pair_id, rn) WHERE k.po IS NOT NULL AND k.ph <= 4" if solo else ""
    return f"""wr AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY target_t, id) AS rn FROM s WHERE hd <= 8),
wk AS (SELECT pair_id, rn, id, 0 AS grp, {first}, NULL::DOUBLE AS po, NULL::BIGINT AS ph, NULL::BIGINT AS pid, 'join' AS act, NULL::BIGINT AS old FROM wr WHERE rn = 1
UNION ALL SELECT r.pair_id, r.rn, r.id, CASE WHEN {joins} THEN k.grp WHEN {opens} THEN k.grp + 1 ELSE k.grp END,
CASE WHEN {joins} THEN {add} WHEN {opens} THEN {fresh} ELSE k.total END, CASE WHEN {joins} THEN k.cnt + 1 WHEN {opens} THEN 2 ELSE k.cnt END,
CASE WHEN {joins} OR ({opens}) THEN NULL ELSE r.o END, CASE WHEN {joins} OR ({opens}) THEN NULL ELSE r.hd END, CASE WHEN {joins} OR ({opens}) THEN NULL ELSE r.id END,
CASE WHEN {joins} THEN 'join' WHEN {opens} THEN 'open' ELSE 'wait' END, CASE WHEN {joins} THEN NULL WHEN {opens} THEN k.pid END
FROM wk k JOIN wr r ON r.pair_id = k.pair_id AND r.rn = k.rn + 1),
wa AS (SELECT pair_id, id, grp FROM wk WHERE act <> 'wait' UNION ALL SELECT pair_id, old, grp FROM wk WHERE act = 'open' {tail}),
wg AS (SELECT wa.pair_id, wa.id, wa.grp, s.target_t, s.o FROM wa JOIN s ON s.pair_id = wa.pair_id AND s.id = wa.id)"""


WALK_MEAN = _walk("round(abs(r.o - k.total / k.cnt), 9) <= 0.3e0", 0.2, "mean", True)
WALK_MEDIAN = f"""{_walk("round(abs(r.o - list_sort(k.total)[k.cnt // 2 + 1]), 9) <= 0.15e0", 0.15, "list", False)},
wc AS (SELECT pair_id, grp, count(*) AS n, list_sort(list(o))[count(*) // 2 + 1] AS upper, min(target_t + o) AS first_p, max(target_t + o) AS last_p FROM wg GROUP BY ALL),
wm AS (SELECT a.pair_id FROM wc a JOIN wc b ON b.pair_id = a.pair_id AND b.grp = 1 WHERE a.grp = 0 AND a.n = 1 AND b.n >= 2 AND round(abs(a.upper - b.upper), 9) <= 0.3e0
AND NOT EXISTS (SELECT 1 FROM bk WHERE bk.pair_id = a.pair_id AND round(b_end - b_start, 9) >= 0.5e0 AND a.last_p < (b_start + b_end) / 2 AND (b_start + b_end) / 2 < b.first_p)),
wx AS (SELECT pair_id, id, CASE WHEN grp = 0 AND pair_id IN (SELECT pair_id FROM wm) THEN 1 ELSE grp END AS grp, target_t, o FROM wg)"""
def _bounded(duration: str, join: str) -> str:
    """CTEs from wx (grouped samples) and bk (dark intervals) to sb: the segments of pairs with several groups."""
    return f"""xc AS (SELECT pair_id, grp, median(o) AS med, min(target_t + o) AS first_p, max(target_t + o) AS last_p FROM wx GROUP BY ALL),
xs AS (SELECT pair_id, grp, avg(o) AS o, count(*) AS inl, stddev_pop(o) AS sd FROM wx JOIN xc USING (pair_id, grp) WHERE round(abs(o - med), 9) <= 0.15e0 GROUP BY ALL),
xo AS (SELECT *, row_number() OVER w AS no, count(*) OVER (PARTITION BY pair_id) AS k, lead(first_p) OVER w AS hi FROM xc WINDOW w AS (PARTITION BY pair_id ORDER BY grp)),
sc AS (SELECT pair_id, b_start, (b_start + b_end) / 2 AS mid, round((b_end - b_start) * greatest(1, least(600, coalesce(b_start - lag(b_end) OVER w, 600), coalesce(lead(b_start) OVER w - b_end, 600))), 9) AS score FROM bk WINDOW w AS (PARTITION BY pair_id ORDER BY b_start, b_end)),
bd AS (SELECT pair_id, no, mid FROM (SELECT xo.pair_id, no, mid, row_number() OVER (PARTITION BY xo.pair_id, no ORDER BY score DESC, b_start) AS q FROM xo JOIN sc ON sc.pair_id = xo.pair_id AND last_p < mid AND mid < hi) WHERE q = 1),
bo AS (SELECT xo.*, CASE WHEN hi IS NOT NULL THEN coalesce(mid, (last_p + hi) / 2) END AS boundary FROM xo LEFT JOIN bd USING (pair_id, no)),
sg AS (SELECT bo.pair_id, no, k, boundary, lag(boundary) OVER (PARTITION BY bo.pair_id ORDER BY no) AS bef, xs.o, inl, sd FROM bo JOIN xs USING (pair_id, grp)),
sa AS (SELECT *, CASE WHEN no = 1 THEN 0e0 ELSE greatest(0e0, bef - o) END AS a FROM sg WHERE k > 1), sb AS (SELECT *, least({duration}, CASE WHEN no = k THEN {duration} ELSE greatest(a + 0.001e0, boundary - o) END) AS b FROM sa {join})"""


ANCHOR = """g AS (SELECT pair_id, cluster, count(*) AS n, median(hd) AS mh, min(hd) AS lh, median(p) AS mp, median(target_t) AS mt, median(o) AS mo FROM cl GROUP BY ALL),
v AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY pair_id) AS most, row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, cluster) AS lone FROM g) WHERE n >= 2 OR (most < 2 AND lone = 1)),
w AS (SELECT *, first_value(lh) OVER (PARTITION BY pair_id ORDER BY n DESC, mh, mp DESC, mo) AS best FROM v), t AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY mp DESC, cluster) AS k FROM w WHERE lh <= best + 2)
SELECT pair_id, round(mo, 6) AS "offset", round(mp, 6) AS primary_t, round(mt, 6) AS target_t, mh AS hd, n FROM t WHERE k = 1"""
INTRO = f"""{FR}, {PAIRS}, md AS (SELECT media_id, count(*) AS total FROM f GROUP BY media_id),
tl AS (SELECT *, list_filter([1e0, 2e0, 4e0, 6e0], lambda t: t < total / 4e0 - 5) AS ts FROM md),
tm AS (SELECT media_id, total, unnest(CASE WHEN len(ts) > 0 THEN ts ELSE [least(5e0, total / 4e0 * 0.1e0)] END) AS t FROM tl),
go AS (SELECT media_id, greatest(0, least(total - 1, round_even(t * 4, 0)::BIGINT)) AS goal FROM tm),
ne AS (SELECT media_id, goal, frame_idx FROM (SELECT go.media_id, goal, f.frame_idx, row_number() OVER (PARTITION BY go.media_id, goal ORDER BY k.range, -s.s) AS q
FROM go CROSS JOIN range(16) k CROSS JOIN (VALUES (1), (-1)) s(s) JOIN f ON f.media_id = go.media_id AND f.frame_idx = goal + s.s * k.range * 2 WHERE lap_var > 40) WHERE q = 1),
r AS (SELECT p.pair_id, p.primary_id, goal AS ref_no, f.frame_idx / 4e0 AS ref_t, h0 AS r0, h1 AS r1 FROM p JOIN ne ON ne.media_id = p.target_id JOIN f ON f.media_id = ne.media_id AND f.frame_idx = ne.frame_idx),
{_coarse(8)}, {_fine("c", "z")}, pr AS (SELECT pair_id, ref_no AS id, ref_t AS target_t, round((frame_idx + shift) / 4e0, 9) AS p, round((frame_idx + shift) / 4e0 - ref_t, 9) AS o, hd FROM z JOIN r USING (pair_id, ref_no))"""
SYNC = f"""WITH vi AS (WITH {_refs("f.frame_idx IN (3, 10, 17, 24, 31)")}, {_coarse(6)}, c2 AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY hd, ref_no) AS k FROM c) WHERE k = 1), {_fine("c2", "z")}
SELECT pair_id, hd, (frame_idx + shift) / 24e0 - ref_t AS o FROM z JOIN r USING (pair_id, ref_no) WHERE hd <= 20),
au AS (WITH {SMOOTH}, {LAGGED} {_by_signal(0.55, 0.35)}), cu2 AS (WITH {CUTS_SMOOTH}, {LAGGED} {_by_signal(0.5, 0.3)}),
cd AS (SELECT i.range AS pair_id, vi.o AS v_off, vi.hd AS v_hd, au."offset" / 3600 AS a_off, au.peak AS a_peak, cu2."offset" / 3600 AS c_off, cu2.peak * 4 AS c_peak FROM range(10) i LEFT JOIN vi ON vi.pair_id = i.range LEFT JOIN au ON au.pair_id = i.range LEFT JOIN cu2 ON cu2.pair_id = i.range),
{CONS_TAIL}, {CASCADE_TAIL}
SELECT pair_id, source, CASE source WHEN 'consensus' THEN -3 WHEN 'cut' THEN -2 WHEN 'audio' THEN -1 WHEN 'visual' THEN v_hd END::BIGINT AS hd, round(CASE source WHEN 'consensus' THEN o WHEN 'visual' THEN o WHEN 'cut' THEN c_off WHEN 'audio' THEN a_off END, 6) AS "offset", CASE WHEN source = 'none' THEN 'No match found' END AS error FROM fc"""
_EDITS = ", ".join(f"({v}, '{stream}', {other}, {first}, {last}, {at})" for v, stream, other, first, last, at in EDITS)
VARIANTS = f"""{EV}, p AS (SELECT range AS pair_id, range // 8 AS primary_id, range + 100 AS target_id FROM range(16)),
ed AS (SELECT 100 + 8 * m + v AS variant, stream, CASE WHEN other = 1 THEN 1 - m ELSE m END AS source, a, b, at_ FROM (VALUES {_EDITS}) e(v, stream, other, a, b, at_), (VALUES (0), (1)) m(m)),
f0 AS ({FR.removeprefix('f AS (').replace('label::BIGINT AS media_id', '(label % 2)::BIGINT AS media_id').replace('PARTITION BY label', 'PARTITION BY label % 2')},
f AS (SELECT * FROM f0 UNION ALL SELECT variant, at_ + frame_idx - a, CASE stream WHEN 'spoilt' THEN xor(h1, 2863311530) ELSE h0 END, CASE stream WHEN 'spoilt' THEN xor(h0, 1431655765) ELSE h1 END, lap_var FROM f0 JOIN ed ON media_id = source AND stream IN ('frames', 'spoilt') AND frame_idx >= a AND frame_idx < b),
e0 AS (SELECT user_id % 2 AS media_id, floor(t / 3600)::BIGINT AS bin, value FROM ev),
en AS (SELECT media_id, bin, sqrt(avg(value * value) + 1e-12) AS rms FROM (SELECT * FROM e0 UNION ALL SELECT variant, at_ + bin - a, value FROM e0 JOIN ed ON media_id = source AND stream = 'sound' AND bin >= a AND bin < b) GROUP BY ALL),
c0 AS (SELECT user_id % 2 AS media_id, t / 3600 AS t FROM ev WHERE event_type = 'click'),
ct AS (SELECT * FROM c0 UNION ALL SELECT variant, at_ + (t - a) FROM c0 JOIN ed ON media_id = source AND stream = 'cuts' AND t >= a AND t < b),
bk AS (SELECT pair_id, t / 3600 AS b_start, t / 3600 + value / 100 AS b_end FROM ev JOIN p ON user_id % 2 = primary_id WHERE event_type = 'error' AND round(t / 3600 + value / 100 - t / 3600, 9) >= 0.3e0)"""
_ANCHORED = ANCHOR[: ANCHOR.index("\nSELECT")]
_SP = "sp AS (SELECT * FROM p)"
_PEAKS = """SELECT bl.pair_id, o / 3600 AS o, round(greatest(0, least(1, x / (sqrt(a.e * b.e) + 1e-12))), 9) AS peak FROM bl JOIN sp USING (pair_id) JOIN pw a ON a.media_id = primary_id JOIN pw b ON b.media_id = target_id"""
SEARCH = rf"""{VARIANTS}, {_reference_frames(40, 20, 4, 5, 1, 40)},
an AS (WITH tm AS (SELECT media_id, total, unnest(list_filter([2e0, 8e0, 18e0, 35e0, 60e0, 90e0], lambda t: t < total - 5)) AS t FROM nt),
go AS (SELECT media_id, greatest(0, least(total - 1, t::BIGINT)) AS goal FROM tm),
ne AS (SELECT media_id, goal, frame_idx FROM (SELECT go.media_id, goal, f.frame_idx, row_number() OVER (PARTITION BY go.media_id, goal ORDER BY k.range, -s.s) AS q
FROM go CROSS JOIN range(8) k CROSS JOIN (VALUES (1), (-1)) s(s) JOIN f ON f.media_id = go.media_id AND f.frame_idx = goal + s.s * k.range WHERE lap_var > 40) WHERE q = 1),
r AS (SELECT p.pair_id, p.primary_id, goal AS ref_no, f.frame_idx AS ref_t, h0 AS r0, h1 AS r1 FROM p JOIN ne ON ne.media_id = p.target_id JOIN f ON f.media_id = ne.media_id AND f.frame_idx = ne.frame_idx),
{_coarse(8)}, {_fine("c", "z")}, pr AS (SELECT pair_id, ref_no AS id, ref_t AS target_t, ref_t AS tf, frame_idx AS pf, round(frame_idx + shift, 9) AS p, round(frame_idx + shift - ref_t, 9) AS o, hd FROM z JOIN r USING (pair_id, ref_no)),
{CLUSTER_TAIL}, {_ANCHORED}
SELECT pair_id, mp, mt, mh, tf, pf FROM t JOIN (SELECT pair_id, cluster, tf, pf, row_number() OVER (PARTITION BY pair_id, cluster ORDER BY hd, o, id) AS q FROM cl) USING (pair_id, cluster) WHERE k = 1 AND q = 1 AND mh <= 12),
fc1 AS (SELECT media_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY lap_var <= 40, frame_idx) AS k FROM f WHERE frame_idx < 120 AND lap_var > 25) WHERE k = 1),
fc2 AS (SELECT media_id, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY tier, frame_idx) AS k FROM (SELECT media_id, frame_idx, CASE WHEN gone < 30 AND lap_var > 40 THEN 1 WHEN gone < 60 AND lap_var > 25 THEN 2 WHEN gone = 0 THEN 3 END AS tier
FROM (SELECT f.media_id, frame_idx, lap_var, frame_idx - least(2, greatest(0, total - 10)) AS gone FROM f JOIN nt USING (media_id)) WHERE gone >= 0) WHERE tier IS NOT NULL) WHERE k = 1),
rf AS (SELECT pair_id, primary_id, target_id, coalesce(an.tf, fc1.frame_idx, fc2.frame_idx) AS frame_idx FROM p LEFT JOIN an USING (pair_id) LEFT JOIN fc1 ON fc1.media_id = target_id LEFT JOIN fc2 ON fc2.media_id = target_id),
si AS (WITH r AS (SELECT pair_id, primary_id, 0 AS ref_no, rf.frame_idx AS ref_t, h0 AS r0, h1 AS r1 FROM rf JOIN f ON f.media_id = target_id AND f.frame_idx = rf.frame_idx), {_coarse(6)}, c2 AS (SELECT * FROM c WHERE hd <= 12), {_fine("c2", "z")},
c3 AS (SELECT pair_id, 0 AS ref_no, 999::BIGINT AS hd, pf AS frame_idx FROM z JOIN an USING (pair_id) WHERE mh <= 6 AND z.frame_idx + shift < mp - 8), {_fine("c3", "y")},
zz AS (SELECT pair_id, y.hd, y.frame_idx + shift - tf AS o FROM y JOIN an USING (pair_id) UNION ALL SELECT pair_id, hd, frame_idx + shift - ref_t FROM z JOIN r USING (pair_id, ref_no) WHERE pair_id NOT IN (SELECT pair_id FROM y)) SELECT pair_id, 'single' AS stage, hd, o FROM zz),
mu AS (WITH r AS (SELECT p.pair_id, p.primary_id, ref_no, nr.frame_idx AS ref_t, h0 AS r0, h1 AS r1 FROM p JOIN nr ON nr.media_id = p.target_id AND ref_no > 0 AND NOT lost JOIN f ON f.media_id = nr.media_id AND f.frame_idx = nr.frame_idx),
{_coarse(6)}, c2 AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY hd, ref_no) AS k FROM c) WHERE k = 1), {_fine("c2", "z")}
SELECT pair_id, 'multi' AS stage, hd, frame_idx + shift - ref_t AS o FROM z JOIN r USING (pair_id, ref_no) WHERE hd <= 12 AND pair_id NOT IN (SELECT pair_id FROM si)),
vi AS (SELECT * FROM si UNION ALL SELECT * FROM mu),
au AS (WITH {GRID}, lv AS (SELECT g.media_id, g.bin, log10(coalesce(rms, 0) + 1e-6) AS level FROM g LEFT JOIN en USING (media_id, bin)), {THRESHOLD}, {SMOOTHED}, {_SP}, {_lagged(60)} {_PEAKS}),
cx AS (WITH hi AS (SELECT DISTINCT media_id, round_even(t, 0)::BIGINT AS bin FROM ct WHERE round_even(t, 0) BETWEEN 0 AND 719), {CUTS_SMOOTH[CUTS_SMOOTH.index("hg AS"):]},
{_SP}, {_lagged(60)}, en5 AS (SELECT media_id FROM ct GROUP BY media_id HAVING count(*) >= 5) {_PEAKS} WHERE primary_id IN (SELECT media_id FROM en5) AND target_id IN (SELECT media_id FROM en5)),
cd AS (SELECT p.pair_id, stage, vi.hd AS v_hd, vi.o AS v_off, au.o AS a_off, au.peak AS a_peak, cx.o AS c_off, cx.peak AS c_peak FROM p LEFT JOIN vi USING (pair_id) LEFT JOIN au USING (pair_id) LEFT JOIN cx USING (pair_id)),
{CONS_TAIL}, {CASCADE_TAIL},
de AS (SELECT *, CASE source WHEN 'cut' THEN c_off WHEN 'audio' THEN a_off WHEN 'none' THEN NULL ELSE o END AS off FROM fc)"""
_AGREES = "CASE WHEN v_off IS NULL OR {o} IS NULL THEN NULL WHEN abs(round({o} - v_off, 9)) <= 0.1e0 THEN 'confirmed' WHEN abs(round({o} - v_off, 9)) <= 0.5e0 THEN 'borderline' ELSE 'disagree' END"
_SETTLED = f"""ad AS (SELECT sm.pair_id, sm.seg_no, sm.a, sm.b, sm.o, inl >= 3 AND sd <= 0.08e0 AS trusted, sm.o + wo.o / 3600 AS a_off, wo.peak AS a_peak FROM s9 sm LEFT JOIN wo ON wo.name = sm.pair_id || ':' || sm.seg_no AND wo.peak >= 0.2e0),
sm AS (SELECT pair_id, seg_no, a, b, CASE WHEN a_off IS NULL OR (trusted AND round(abs(a_off - o), 9) <= 0.3e0) THEN o WHEN a_peak >= 0.3e0 AND round(abs(a_off - o), 9) <= 1.5e0 THEN a_off ELSE o END AS o FROM ad)"""
FROM_FRAMES = f"""{SEARCH}, ln AS (SELECT media_id, count(*)::DOUBLE AS dur FROM f GROUP BY media_id), pd AS (SELECT pair_id, t.dur AS tdur, q.dur AS primary_duration FROM p JOIN ln t ON t.media_id = target_id JOIN ln q ON q.media_id = primary_id),
du AS (SELECT pair_id, primary_duration FROM pd),
s AS (WITH l AS (SELECT media_id, dur, greatest(0, least(30, dur - 1)) AS lo FROM ln), tm AS (SELECT media_id, r.range AS sample_no, round_even(lo + r.range * (greatest(lo + 1, dur - 60) - lo) / 25e0, 0)::BIGINT AS frame FROM l, range(1, 25) r),
r AS (SELECT p.pair_id, p.primary_id, sample_no AS ref_no, frame_idx AS ref_t, h0 AS r0, h1 AS r1, off FROM p JOIN de USING (pair_id) JOIN tm ON tm.media_id = target_id JOIN f ON f.media_id = target_id AND frame_idx = frame WHERE lap_var > 40 AND off IS NOT NULL),
e AS (SELECT pair_id, ref_no, ref_t, f.frame_idx AS fr, {HD} AS d FROM r JOIN f ON f.media_id = r.primary_id AND f.frame_idx BETWEEN greatest(0, trunc(ref_t + off - 6)::BIGINT) AND trunc(ref_t + off + 6)::BIGINT),
w AS (SELECT pair_id, ref_no, ref_t, d AS hd, fr AS frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, ref_no ORDER BY d, fr) AS k FROM e) WHERE k = 1 AND d <= 16),
n AS (SELECT w.pair_id, w.ref_no, w.ref_t, w.hd, w.frame_idx, max(CASE WHEN e.fr = w.frame_idx - 1 THEN d END) AS bf, max(CASE WHEN e.fr = w.frame_idx + 1 THEN d END) AS af FROM w JOIN e USING (pair_id, ref_no) GROUP BY ALL)
SELECT pair_id, ref_no AS id, ref_t::DOUBLE AS target_t, round(frame_idx + {SHIFT} - ref_t, 9) AS o, hd FROM n),
{_despiked('s', 6)}, gd AS (SELECT pair_id, count(*) >= 8 AND round(max(o) - min(o), 9) > 0.45e0 AS despiked FROM s GROUP BY pair_id),
us AS (SELECT s.pair_id, s.id, s.target_t, s.hd, CASE WHEN despiked THEN d6.o ELSE s.o END AS o FROM s JOIN gd USING (pair_id) JOIN d6 ON d6.pair_id = s.pair_id AND d6.id = s.id), um AS (SELECT pair_id, median(o) AS med FROM us GROUP BY pair_id),
uq AS (SELECT pair_id, CASE WHEN count(*) >= 4 THEN greatest(0, quantile_cont(o, 0.88) - quantile_cont(o, 0.12)) ELSE max(o) - min(o) END AS spread, coalesce(median(o) FILTER (round(abs(o - med), 9) <= 0.1e0), any_value(med)) AS ro FROM us JOIN um USING (pair_id) GROUP BY pair_id),
vd AS (SELECT pair_id, round(spread, 9) > 0.18e0 AS many, ro FROM uq),
pl AS (SELECT pair_id, CASE WHEN off IS NULL THEN 'none' WHEN many THEN 'segmented' ELSE 'single' END AS mode, CASE WHEN coalesce(many, false) THEN NULL ELSE coalesce(ro, off) END AS o, CASE WHEN off IS NULL THEN 'No match found' END AS error FROM de LEFT JOIN vd USING (pair_id)),
sn AS (WITH RECURSIVE s AS (SELECT us.* FROM us JOIN vd USING (pair_id) WHERE many), {WALK_MEDIAN}, {_bounded("tdur", "JOIN pd USING (pair_id)")} SELECT * FROM sb WHERE b > a),
s9 AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY a, b) - 1 AS seg_no, a, b, o, inl, sd FROM sn),
wi AS (SELECT pair_id || ':' || seg_no AS name, primary_id, target_id, round_even(t0 + o, 0)::BIGINT AS pb, floor(t0)::BIGINT AS tb, floor(b - t0)::BIGINT AS nb FROM (SELECT s9.*, primary_id, target_id, a + greatest(0, -(a + o)) AS t0 FROM s9 JOIN p USING (pair_id)) WHERE b - t0 >= 30 AND floor(b - t0) >= 20),
{WINDOWED}, {_SETTLED}, {CHUNKS}"""
PLANNED = f"""{_samples(False)}, {BLACKS.removeprefix(EV + ', ')}, {WALK_MEDIAN}, {_bounded("2592000e0", "")}, {SEGMENTS.replace("sm AS (", "sm AS (SELECT pair_id + 100 AS pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY a, b) - 1 AS seg_no, round(a, 3) AS a, round(b, 3) AS b, round(o, 3) AS o FROM sb WHERE b > a UNION ALL ", 1).replace("du AS (", "du AS (SELECT pair_id + 100 AS pair_id, max(target_t) AS primary_duration FROM s GROUP BY pair_id UNION ALL ", 1)}, {CHUNKS}"""
GRAPHS = f"""{PLANNED}, gw AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY chunk_no) - 1 AS i, printf('start=%.6f:end=%.6f', target_start, target_end) AS span FROM ck WHERE (kind = 'filler' AND duration >= 0.03e0) OR (kind = 'target' AND duration >= 0.001e0)),
gp2 AS (SELECT *, CASE kind WHEN 'filler' THEN 'color=c=black:s=1920x1080:r=24000/1001:d=' || printf('%.6f', duration) || ',setsar=1[v' || i || '];anullsrc=r=48000:cl=stereo,atrim=duration=' || printf('%.6f', duration) || '[a' || i || ']'
ELSE '[0:v]trim=' || span || ',setpts=PTS-STARTPTS,scale=1920:1080:force_original_aspect_ratio=decrease,pad=1920:1080:(ow-iw)/2:(oh-ih)/2,setsar=1,fps=24000/1001[v' || i || '];[0:a]atrim=' || span || ',asetpts=PTS-STARTPTS,aresample=48000,aformat=channel_layouts=stereo[a' || i || ']' END AS part FROM gw),
gr AS (SELECT pair_id::BIGINT AS pair_id, count(*) AS n_parts, string_agg(part, ';' ORDER BY chunk_no) || ';' || string_agg('[v' || i || '][a' || i || ']', '' ORDER BY chunk_no) || 'concat=n=' || count(*) || ':v=1:a=1[vj][aj];[vj]setpts=PTS-STARTPTS[v];[aj]asetpts=PTS-STARTPTS[a]' AS graph FROM gp2 GROUP BY pair_id)"""
SQL: dict[str, str] = {
    "nn_single_ref": f"WITH {_refs('f.frame_idx = 10')}, {_coarse(1)} SELECT pair_id, hd, frame_idx, round(frame_idx / 24e0 - ref_t, 6) + 0e0 AS \"offset\", {BAND} AS confidence FROM c JOIN r USING (pair_id, ref_no)",
    "nn_coarse_fine": f"WITH {_refs('f.frame_idx = 10')}, {_coarse(6)}, c2 AS (SELECT * FROM c WHERE hd <= 48), {_fine('c2', 'z')} {_offset('z')}",
    "nn_multi_ref": f"WITH {_refs('f.frame_idx IN (3, 10, 17, 24, 31)')}, {_coarse(6)}, c2 AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY hd, ref_no) AS k FROM c) WHERE k = 1), {_fine('c2', 'z')} {_offset('z', 'hd <= 48')}",
    "nn_relock": f"""WITH {_refs('f.frame_idx = 10')}, {_coarse(6)}, c2 AS (SELECT * FROM c WHERE hd <= 48), {_fine('c2', 'z')},
c3 AS (SELECT pair_id, ref_no, 999::BIGINT AS hd, round_even(pair_id / 6e0 * 24, 0)::BIGINT AS frame_idx FROM z WHERE (frame_idx + shift) / 24e0 < pair_id / 6e0 - 0.5e0 AND pair_id * 4 <= 24), {_fine('c3', 'y')},
zz AS (SELECT * FROM y UNION ALL SELECT * FROM z ANTI JOIN y USING (pair_id, ref_no)) {_offset('zz')}""",
    "nn_band_dense": f"WITH {_band('true', 'trunc((ref_t + 0.1e0 - 0.25e0) * 24)::BIGINT', 'trunc((ref_t + 0.1e0 + 0.25e0) * 24)::BIGINT')} SELECT pair_id, ref_no, round(ref_t, 6) AS ref_t, hd, frame_idx, round(shift, 6) + 0e0 AS shift, round((frame_idx + shift) / 24e0 - ref_t, 6) + 0e0 AS \"offset\" FROM b",
    "verify_visual": f"WITH {_VISUAL} SELECT pair_id, ref_no, round(ref_t, 6) AS ref_t, hd, round(frame_idx + shift - ref_t * 24, 6) + 0e0 AS delta_frames, round((frame_idx + shift - ref_t * 24) / 24e0 * 1000, 6) + 0e0 AS delta_ms FROM b",
    "hamming_pairs_topk": f"WITH {_refs('true')}, t AS (SELECT pair_id, ref_no AS ref_frame, f.frame_idx, {HD} AS hd, row_number() OVER (PARTITION BY pair_id, ref_no ORDER BY {HD}, f.frame_idx) AS rank FROM r JOIN f ON f.media_id = r.primary_id) SELECT pair_id, ref_frame, rank, frame_idx, hd FROM t WHERE rank <= 3",
    "frame_lookup": f"WITH {FR} SELECT w.range AS media_id, i.idx AS frame_idx, h0, h1 FROM range(10) w CROSS JOIN (VALUES (5::BIGINT), (100000::BIGINT)) i(idx) LEFT JOIN f ON f.media_id = w.range AND f.frame_idx = i.idx",
    "frame_range": f"WITH {FR} SELECT media_id, frame_idx, h0, h1 FROM f WHERE frame_idx >= 7 AND frame_idx < 40 AND (frame_idx - 7) % 6 = 0",
    "content_filter": f"WITH {FR} SELECT media_id, count(*) AS n_frames, count(*) FILTER (lap_var > 50) AS n_content, count(*) FILTER (lap_var > 25) AS n_relaxed FROM f GROUP BY media_id",
    "select_first_content": f"WITH {FR}, t AS (SELECT media_id, frame_idx, CASE WHEN frame_idx % 12 = 0 AND lap_var > 50 THEN 1 WHEN lap_var > 25 THEN 2 END AS tier FROM f WHERE frame_idx < 48) SELECT media_id, tier::BIGINT AS tier, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY tier, frame_idx) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1",
    "select_reference_tiers": f"""WITH {FR}, n AS (SELECT *, least(8, greatest(0, max(frame_idx) OVER (PARTITION BY media_id) + 1 - 40)) AS start FROM f),
t AS (SELECT media_id, frame_idx, CASE WHEN (frame_idx - start) % 4 = 0 AND frame_idx - start < 120 AND lap_var > 50 THEN 1 WHEN frame_idx - start < 240 AND lap_var > 25 THEN 2 WHEN frame_idx = start THEN 3 END AS tier FROM n WHERE frame_idx >= start)
SELECT media_id, tier::BIGINT AS tier, frame_idx FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY tier, frame_idx) AS k FROM t WHERE tier IS NOT NULL) WHERE k = 1""",
    "select_n_refs": f"""WITH RECURSIVE {FR}, {_reference_frames(4, 6, 4, 3, 1)} SELECT media_id, ref_no, goal, frame_idx, found FROM nr WHERE ref_no > 0 AND NOT lost""",
    "sample_times_even": f"WITH {MEDIA}, l AS (SELECT media_id, greatest(0, least(30, duration - 1)) AS lo, duration FROM m WHERE duration > 0) SELECT media_id, r.range AS sample_no, round(lo + r.range * (greatest(lo + 1, duration - 60) - lo) / 10e0, 6) AS t FROM l, range(1, 10) r",
    "sample_times_mid": f"WITH {MEDIA}, l AS (SELECT media_id, duration, {EDGE} AS edge FROM m WHERE duration > 0) SELECT media_id, r.range AS sample_no, round(edge + (r.range + 0.5e0) * (duration - 2 * edge) / 20e0, 6) AS t FROM l, range(20) r",
    "probe_times": f"WITH {MEDIA}, l AS (SELECT media_id, duration % 120 AS d FROM m), x AS (SELECT media_id, d, list_filter([2e0, 8e0, 18e0, 35e0, 60e0, 90e0], lambda t: t < d - 5) AS ts FROM l) SELECT media_id, round(unnest(CASE WHEN len(ts) > 0 THEN ts ELSE [least(5e0, d * 0.1e0)] END), 6) AS t FROM x",
    "verify_windows": f"WITH {MEDIA}, l AS (SELECT media_id, duration % 120 AS duration FROM m), e AS (SELECT *, {EDGE} AS edge FROM l), w AS (SELECT *, unnest(range(greatest(1, floor((duration - 2 * edge) / 15)::BIGINT))) AS window_no FROM e WHERE duration - 2 * edge >= 15) SELECT media_id, window_no, round(edge + window_no * 15, 6) AS w_start, round(edge + window_no * 15 + 15, 6) AS w_end FROM w",
    "time_conversions": f"WITH {EV} SELECT event_id, trunc((value - 20) * 23.976e0)::BIGINT AS toward_zero, round_even((value - 20) * 23.976e0, 0)::BIGINT AS half_even, round(event_id / 23.976e0, 6) AS t, 0e0 AS no_rate FROM ev",
    "timecode_format": f"WITH {EV}, x AS (SELECT event_id, round(t / 100 - 50, 3) AS t FROM ev) SELECT event_id, {_timecode('t')} AS tc FROM x",
    "rms_windows": f"WITH {ENERGY} SELECT media_id, bin, round(rms, 6) AS rms FROM en",
    "vad_binary": f"WITH {ACTIVE} SELECT * FROM ac",
    "vad_smoothed": f"WITH {SMOOTH} SELECT media_id, bin, round(v, 6) + 0e0 AS v FROM sg",
    "speech_ratio": f"WITH {ACTIVE} SELECT media_id, round(avg((v > 0)::INT), 6) AS ratio, avg((v > 0)::INT) >= 0.05e0 AS ok FROM ac GROUP BY media_id",
    "cut_histogram": f"WITH {CUTS} SELECT * FROM hg",
    "cut_smoothed": f"WITH {CUTS_SMOOTH} SELECT media_id, bin, round(v, 6) + 0e0 AS v FROM sg",
    "xcorr_lags": f"WITH {SMOOTH}, {LAGGED} SELECT pair_id, lag, round(x, 6) + 0e0 AS x FROM xc",
    "xcorr_long": f"WITH {SMOOTH}, {LAGGED} SELECT pair_id, lag, round(round(x, 9), 4) + 0e0 AS x FROM xc",
    "xcorr_peak": f"WITH {SMOOTH}, {LAGGED} SELECT pair_id, lag, round(x, 6) + 0e0 AS x, round(o, 6) + 0e0 AS \"offset\" FROM bl",
    "audio_offset": f"WITH {SMOOTH}, {LAGGED} {_by_signal(0.55, 0.35)}",
    "cut_offset": f"WITH {CUTS_SMOOTH}, {LAGGED}, en5 AS (SELECT media_id FROM ct GROUP BY media_id HAVING count(*) >= 5) {_by_signal(0.5, 0.3, 'primary_id IN (SELECT media_id FROM en5) AND target_id IN (SELECT media_id FROM en5)')}",
    "offset_spread": f"WITH {_samples(False)} SELECT pair_id, count(*) AS n, round(max(o) - min(o), 6) AS spread, round(CASE WHEN count(*) < 3 THEN max(o) - min(o) ELSE greatest(0, quantile_cont(o, 0.88) - quantile_cont(o, 0.12)) END, 6) AS robust FROM s GROUP BY pair_id",
    "offset_medians": f"WITH {_samples(False)} SELECT pair_id, round(median(o), 6) AS median, round(list_sort(list(o))[count(*) // 2 + 1], 6) AS upper FROM s GROUP BY pair_id",
    "robust_median_offset": f"WITH {_samples(False)}, m AS (SELECT pair_id, median(o) AS med FROM s GROUP BY pair_id) SELECT pair_id, round(coalesce(median(o) FILTER (round(abs(o - med), 9) <= 0.1e0), any_value(med)), 6) AS \"offset\" FROM s JOIN m USING (pair_id) GROUP BY pair_id",
    "trimmed_mean_stdev": f"WITH {_samples(False)}, m AS (SELECT pair_id, median(o) AS med FROM s GROUP BY pair_id) SELECT pair_id, count(*) AS inliers, round(avg(o), 6) AS mean, round(stddev_pop(o), 6) AS stdev FROM s JOIN m USING (pair_id) WHERE round(abs(o - med), 9) <= 0.15e0 GROUP BY pair_id",
    "despike_one_pass": f"WITH {_samples(True)}, {_despiked('s', 1)} SELECT pair_id, id, round(o, 6) AS \"offset\", fixes::BIGINT AS fixes FROM d1",
    "despike_full": f"WITH {_samples(True)}, {_despiked('s', 6)} SELECT pair_id, round(sum(o), 6) AS total, sum(fixes)::BIGINT AS fixes FROM d6 GROUP BY pair_id",
    "segment_trigger": f"""WITH {_samples(False)}, {_despiked('s', 6)}, g AS (SELECT pair_id, count(*) >= 8 AND round(max(o) - min(o), 9) > 0.45e0 AS despiked FROM s GROUP BY pair_id),
u AS (SELECT s.pair_id, despiked, CASE WHEN despiked THEN d6.o ELSE s.o END AS o FROM s JOIN g USING (pair_id) JOIN d6 ON d6.pair_id = s.pair_id AND d6.id = s.id), m AS (SELECT pair_id, median(o) AS med FROM u GROUP BY pair_id),
q AS (SELECT pair_id, count(*) AS n, any_value(despiked) AS despiked, CASE WHEN count(*) >= 4 THEN greatest(0, quantile_cont(o, 0.88) - quantile_cont(o, 0.12)) ELSE max(o) - min(o) END AS spread, coalesce(median(o) FILTER (round(abs(o - med), 9) <= 0.1e0), any_value(med)) AS ro FROM u JOIN m USING (pair_id) GROUP BY pair_id)
SELECT pair_id, n, despiked, round(spread, 6) AS spread, round(spread, 9) > 0.18e0 AS segmented, CASE WHEN round(spread, 9) <= 0.18e0 THEN round(ro, 6) END AS "offset" FROM q""",
    "offset_clusters": f"WITH {CLUSTERED} SELECT pair_id, id, cluster FROM cl",
    "anchor_choice": f"WITH {CLUSTERED}, {ANCHOR} AND mh <= 24",
    "intro_anchor": f"WITH {INTRO}, {CLUSTER_TAIL}, {ANCHOR} AND mh <= 48",
    "sync_pairs": SYNC,
    "sync_search": f"""WITH RECURSIVE {SEARCH} SELECT pair_id, source, CASE WHEN source IN ('visual', 'consensus') THEN stage END AS stage, CASE source WHEN 'consensus' THEN -3 WHEN 'cut' THEN -2 WHEN 'audio' THEN -1 WHEN 'visual' THEN v_hd END::BIGINT AS hd, round(off, 6) + 0e0 AS "offset",
CASE source WHEN 'consensus' THEN 'high' WHEN 'visual' THEN CASE WHEN v_hd <= 2 THEN 'high' WHEN v_hd <= 6 THEN 'medium' ELSE 'low' END WHEN 'cut' THEN CASE WHEN c_peak >= 0.5e0 THEN 'high' ELSE 'medium' END WHEN 'audio' THEN CASE WHEN a_peak >= 0.55e0 THEN 'high' ELSE 'medium' END END AS confidence,
{_AGREES.format(o="a_off")} AS audio, {_AGREES.format(o="c_off")} AS cut, CASE WHEN source = 'none' THEN 'No match found' END AS error FROM de""",
    "sync_from_frames": f"""WITH RECURSIVE {FROM_FRAMES} SELECT pair_id, mode, round(pl.o, 6) + 0e0 AS "offset", error, chunk_no, kind, round(target_start, 6) AS target_start, round(target_end, 6) AS target_end, round(duration, 6) AS duration FROM pl LEFT JOIN ck USING (pair_id)""",
    "segments_sample_walker": f"""WITH RECURSIVE {_samples(False)}, {WALK_MEAN}, g AS (SELECT pair_id, grp, avg(o) AS o, min(target_t) AS a, max(target_t) AS b FROM wg GROUP BY ALL)
SELECT pair_id, grp::BIGINT AS seg_no, round(coalesce((lag(b) OVER w + a) / 2, 0e0), 4) AS target_start, round(coalesce((b + lead(a) OVER w) / 2, 2592000e0), 4) AS target_end, round(o, 6) AS "offset" FROM g WINDOW w AS (PARTITION BY pair_id ORDER BY grp)""",
    "segments_cluster_walker": f"WITH RECURSIVE {_samples(False)}, {BLACKS.removeprefix(EV + ', ')}, {WALK_MEDIAN} SELECT pair_id, grp::BIGINT AS grp, count(*) AS n, round(list_sort(list(o))[count(*) // 2 + 1], 6) AS upper, round(min(target_t + o), 6) AS first_p, round(max(target_t + o), 6) AS last_p FROM wx GROUP BY ALL",
    "segments_with_blacks": f"""WITH RECURSIVE {_samples(False)}, {BLACKS.removeprefix(EV + ', ')}, {WALK_MEDIAN}, {_bounded("2592000e0", "")}
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY a, b) - 1 AS seg_no, round(a, 6) AS target_start, round(b, 6) AS target_end, round(o, 6) AS "offset", inl AS phash_inliers, round(sd, 6) AS phash_stdev FROM sb WHERE b > a""",
    "verification_report": f"""WITH {_VISUAL}, gm AS (WITH RECURSIVE {GREEDY} SELECT * FROM gm), gk AS (WITH RECURSIVE {GREEDY} SELECT * FROM gk), dw AS (WITH {DRIFTED} SELECT pair_id, round(delta_ms, 6) AS delta_ms FROM dw),
vd AS (SELECT pair_id, count(*) AS n, max(abs(frame_idx + shift - ref_t * 24)) * 1000 / 24e0 AS ms, avg((abs(frame_idx + shift - ref_t * 24) <= 0.5e0)::INT) AS half FROM b GROUP BY pair_id),
ad AS (SELECT pair_id, count(*) AS n, max(abs(delta_ms / 360000)) AS ms FROM dw GROUP BY pair_id),
sd AS (SELECT pair_id, count(*) AS n, max(abs(late / 3600)) * 1000 / 24e0 AS ms FROM gm GROUP BY pair_id),
al AS (SELECT p.pair_id, vd.n AS vn, vd.ms AS vm, vd.half, ad.n AS an, ad.ms AS am, sd.n AS sn, sd.ms AS sm, gk.* EXCLUDE pair_id FROM p LEFT JOIN vd USING (pair_id) LEFT JOIN ad USING (pair_id) LEFT JOIN sd USING (pair_id) LEFT JOIN gk USING (pair_id)),
il AS (SELECT *, list_filter([CASE WHEN vm > 500 / 24e0 THEN printf('visual max %.2f ms (thr %.2f ms)', round(vm, 2), 20.83e0) END, CASE WHEN am > 1000 / 24e0 THEN printf('audio max %.2f ms (thr %.2f ms)', round(am, 2), 41.67e0) END, CASE WHEN sm > 500 / 24e0 THEN printf('scene-cut max %.2f ms (thr %.2f ms)', round(sm, 2), 20.83e0) END], lambda i: i IS NOT NULL) AS i FROM al)
SELECT pair_id, coalesce(vn, 0) AS visual_n, round(coalesce(vm, 0e0), 6) AS visual_ms, round(coalesce(half, 0e0), 6) AS visual_half, coalesce(an, 0) AS audio_n, round(coalesce(am, 0e0), 6) AS audio_ms, coalesce(sn, 0) AS scene_n, round(coalesce(sm, 0e0), 6) AS scene_ms,
coalesce(cuts_primary, 0) AS cuts_primary, coalesce(cuts_synced, 0) AS cuts_synced, coalesce(unmatched_primary, 0) AS unmatched_primary, coalesce(unmatched_synced, 0) AS unmatched_synced, len(i) AS n_issues, coalesce(array_to_string(i, '; '), '') AS issues FROM il""",
    "audio_drift_windows": f"WITH {DRIFTED} SELECT pair_id, window_no, round(w_start, 6) AS w_start, round(w_end, 6) AS w_end, round(delta_ms, 6) + 0e0 AS delta_ms, round(peak, 6) AS peak FROM dw",
    "segment_audio_refine": f"WITH {REFINED} SELECT pair_id, seg_no, round(off + o, 6) + 0e0 AS \"offset\", round(peak, 6) AS peak FROM wi JOIN wo USING (name) WHERE peak >= 0.02e0",
    "cut_greedy_pairing": f"WITH RECURSIVE {GREEDY} SELECT pair_id, p_id, s_id, round(p_t, 6) AS p_t, round(s_t, 6) AS s_t, round(gap, 6) AS gap, round(late * (24e0 / 3600e0), 6) + 0e0 AS delta_frames, round(late * 1000, 6) + 0e0 AS delta_ms FROM gm",
    "scene_counts": f"WITH RECURSIVE {GREEDY} SELECT * FROM gk",
    "pcm_windows": f"WITH {EV}, pc AS (SELECT event_type AS media_id, event_id AS i, round(value * 10)::INT / 32768e0 AS amp FROM ev), w AS (SELECT media_id, n.range AS window_no, (n.range + 1) * 125 AS lo FROM (SELECT unnest({_KINDS}) AS media_id), range(3) n) SELECT w.media_id, window_no, nullif(count(i), 0) AS n, round(sum(amp), 6) AS total FROM w LEFT JOIN pc ON pc.media_id = w.media_id AND window_no < 2 AND i >= lo AND i < lo + 125 GROUP BY ALL",
    "render_graph": f"WITH RECURSIVE {GRAPHS} SELECT * FROM gr",
    "render_command": rf"""WITH RECURSIVE {GRAPHS}, {NAMES}, op AS (SELECT pair_id, graph, path, regexp_replace(path, '\.[^./]*$', '') || '_synced.mp4' AS output FROM gr JOIN nm ON id = pair_id)
SELECT pair_id, concat_ws(chr(10), '-y', '-i', path, '-filter_complex', graph, '-map', '[v]', '-map', '[a]', replace('{ENCODING}', ' ', chr(10)), output) AS lines, output FROM op""",
    "black_blocking_semi": f"WITH {BLACKS}, {GAPS} SELECT pair_id, gap_no FROM gp WHERE EXISTS (SELECT 1 FROM bk WHERE bk.pair_id = gp.pair_id AND round(b_end - b_start, 9) >= 0.5e0 AND lo < (b_start + b_end) / 2 AND (b_start + b_end) / 2 < hi)",
    "black_boundary_score": f"""WITH {BLACKS}, {GAPS}, sc AS (SELECT pair_id, b_start, (b_start + b_end) / 2 AS mid, round((b_end - b_start) * greatest(1, least(600, coalesce(b_start - lag(b_end) OVER w, 600), coalesce(lead(b_start) OVER w - b_end, 600))), 9) AS score FROM bk WINDOW w AS (PARTITION BY pair_id ORDER BY b_start, b_end)),
bs AS (SELECT gp.pair_id, gap_no, mid, row_number() OVER (PARTITION BY gp.pair_id, gap_no ORDER BY score DESC, b_start) AS k FROM gp JOIN sc ON sc.pair_id = gp.pair_id AND lo < mid AND mid < hi)
SELECT gp.pair_id, gp.gap_no, lo, hi, round(coalesce(mid, (lo + hi) / 2), 6) AS boundary FROM gp LEFT JOIN (SELECT * FROM bs WHERE k = 1) bs USING (pair_id, gap_no)""",
    "playback_chunks": f"WITH RECURSIVE {PLANNED} SELECT pair_id::BIGINT AS pair_id, chunk_no, kind, round(target_start, 6) AS target_start, round(target_end, 6) AS target_end, round(duration, 6) AS duration FROM ck",
    "render_script": f"WITH RECURSIVE {PLANNED} SELECT pair_id::BIGINT AS pair_id, count(*) AS n_parts, string_agg(CASE kind WHEN 'filler' THEN printf('black:%.3f', duration) ELSE printf('play:%.3f-%.3f', target_start, target_end) END, ';' ORDER BY chunk_no) AS script FROM ck WHERE (kind = 'filler' AND duration >= 0.03e0) OR (kind = 'target' AND duration >= 0.001e0) GROUP BY pair_id",
    "playback_tail_trim": f"WITH {EV}, ch AS (SELECT user_id % 10 AS pair_id, event_id AS seg_no, 1 AS place, 'target' AS kind, t AS target_start, t + value AS target_end, value AS duration FROM ev WHERE event_type = 'error'), du AS (SELECT range AS pair_id, range * 100e0 + 50 AS primary_duration FROM range(10)), {TRIM} SELECT pair_id, chunk_no, kind, round(target_start, 6) AS target_start, round(target_end, 6) AS target_end, round(duration, 6) AS duration FROM ck",
    "agreement_bands": f"WITH {CAND} SELECT pair_id, "
    + ", ".join(f"CASE WHEN v_off IS NULL OR {o} IS NULL THEN NULL WHEN abs(round({o} - v_off, 9)) <= 0.1e0 THEN 'confirmed' WHEN abs(round({o} - v_off, 9)) <= 0.5e0 THEN 'borderline' ELSE 'disagree' END AS {n}" for o, n in (("a_off", "audio"), ("c_off", "cut")))
    + " FROM cd",
    "consensus_override": f"WITH {CONS} SELECT pair_id, overridden, round(o, 6) AS \"offset\" FROM cn",
    "fallback_cascade": f"WITH {CASCADE} SELECT pair_id, source, CASE source WHEN 'consensus' THEN -3 WHEN 'cut' THEN -2 WHEN 'audio' THEN -1 WHEN 'visual' THEN v_hd END::BIGINT AS hd, round(CASE source WHEN 'consensus' THEN o WHEN 'visual' THEN o WHEN 'cut' THEN c_off WHEN 'audio' THEN a_off END, 6) AS \"offset\" FROM fc",
    "adjudicate_segments": f"""WITH {CAND}, sg AS (SELECT pair_id, coalesce(v_off, 0) AS o, pair_id % 6 >= 3 AND round(pair_id % 5 * 0.04e0, 2) <= 0.08e0 AS trusted, a_off, round(abs(a_off - coalesce(v_off, 0)), 9) AS delta, a_peak FROM cd),
re AS (SELECT *, CASE WHEN a_off IS NULL THEN 'no audio' WHEN trusted AND delta <= 0.3e0 THEN 'agree' WHEN trusted AND a_peak >= 0.3e0 AND delta <= 1.5e0 THEN 'audio differs' WHEN trusted THEN 'audio weak' WHEN a_peak >= 0.3e0 AND delta <= 1.5e0 THEN 'untrusted visual' ELSE 'nothing better' END AS reason FROM sg)
SELECT pair_id, 0::BIGINT AS seg_no, CASE WHEN reason IN ('audio differs', 'untrusted visual') THEN 'audio' ELSE 'visual' END AS source, reason, round(CASE WHEN reason IN ('audio differs', 'untrusted visual') THEN a_off ELSE o END, 6) AS "offset" FROM re""",
    "edit_plan": f"WITH {CAND}, e AS (SELECT pair_id, a_off - 0.5e0 AS o FROM cd WHERE a_off IS NOT NULL) SELECT pair_id, CASE WHEN o < 0 THEN 'trim' ELSE 'pad' END AS action, round(CASE WHEN o < 0 THEN -o ELSE 0 END, 6) AS seek, round(CASE WHEN o < 0 THEN 0 ELSE o END, 6) AS pad, round(CASE WHEN o < 0 THEN 0 ELSE o * 1000 END, 6) AS delay_ms, 1440e0 AS length FROM e",
    "preview_plan": f"WITH {MEDIA} SELECT media_id AS pair_id, round(least(30, greatest(0, duration % 50 - 6)), 6) AS seek, 5e0 AS length, 854::BIGINT AS width, 480::BIGINT AS height FROM m",
    "batch_counts": f"WITH {CASCADE} SELECT count(*) FILTER (source <> 'none') AS succeeded, count(*) FILTER (source = 'none') AS failed FROM fc",
    "cut_nearest_asof": f"WITH {NEAR} SELECT pair_id, p_id, s_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, p_id ORDER BY gap, s_t, s_id) AS k FROM nc) WHERE k = 1",
    "cut_mutual_nn": f"WITH {NEAR} SELECT pair_id, p_id, s_id, gap FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, p_id ORDER BY gap, s_t, s_id) AS a, row_number() OVER (PARTITION BY pair_id, s_id ORDER BY gap, p_t, p_id) AS b FROM nc) WHERE a = 1 AND b = 1",
    "drift_summary": f"WITH {DRIFT} SELECT pair_id, n, round(mx, 6) AS max_frames, round(mean, 6) AS mean_frames, round(ms, 6) AS max_ms, round(half, 6) AS within_half FROM ds",
    "drift_issues": f"""WITH {EV}, x AS (SELECT event_id AS pair_id, CASE WHEN event_id % 5 <> 0 THEN round(value, 2) END AS v, round(value * 2, 2) AS a, CASE WHEN event_id % 3 <> 0 THEN round(value + 7, 2) END AS c, 500 / 24e0 AS l, 1000 / 24e0 AS l2 FROM ev),
y AS (SELECT pair_id, list_filter([CASE WHEN v > l THEN printf('visual max %.2f ms (thr %.2f ms)', v, round(l, 2)) END, CASE WHEN a > l2 THEN printf('audio max %.2f ms (thr %.2f ms)', a, round(l2, 2)) END, CASE WHEN c > l THEN printf('scene-cut max %.2f ms (thr %.2f ms)', c, round(l, 2)) END], lambda i: i IS NOT NULL) AS i FROM x)
SELECT pair_id, len(i) AS n_issues, coalesce(array_to_string(i, '; '), '') AS issues FROM y""",
    "report_lines": f"""WITH {DRIFT}, li AS (SELECT pair_id, 0 AS k, -1e0 AS t, -1 AS id, printf('samples %d, max %.3f frames, mean %.3f frames, within half a frame %.1f%%', n, round(mx, 3), round(mean, 3), round(half * 100, 1)) AS line FROM ds
UNION ALL SELECT pair_id, 1, t, id, {_timecode('t')} || ' ' || printf('%+.2f', round(df, 2)) FROM dr WHERE round(abs(df) * 1000 / 24e0, 6) > 20.833333e0) SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY k, t, id) - 1 AS line_no, line FROM li""",
    "name_normalize_batch": f"WITH {NAMES} SELECT id, {BATCH} AS name FROM nm",
    "name_normalize_ui": f"WITH {NAMES} SELECT id, {UI} AS name FROM nm",
    "name_levenshtein_topk": f"WITH {DISTANCE} SELECT folder, p_id, rank, t_id, distance::BIGINT AS distance FROM lk WHERE rank <= 2",
    "pairs_zip": f"WITH {NAMES}, z AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY id) AS place FROM nm) SELECT p.place, p.path AS \"primary\", t.path AS target FROM z p JOIN z t ON p.place = t.place AND p.side = 'primary' AND t.side = 'target'",
    "pairs_leftover_anti": f"WITH {DISTANCE}, u AS (SELECT unnest([p_id, t_id]) AS id FROM lk WHERE rank = 1 AND distance <= 1) SELECT side, id FROM nm WHERE id NOT IN (SELECT id FROM u)",
    "list_ingest": f"WITH {NAMES} SELECT side, min(id) AS id, path FROM (SELECT side, id, path FROM nm UNION ALL SELECT 'primary', -1, path FROM nm) WHERE {VIDEO} GROUP BY side, path",
    "extension_filter": f"WITH {NAMES} SELECT id, path FROM nm WHERE {VIDEO}",
    "output_path": rf"WITH {NAMES} SELECT id, regexp_replace(path, '(\.[^./]*)$', '_synced\1') AS out FROM nm",
    "probe_json": f"WITH {PROBE} SELECT media_id, duration, round(fps, 6) AS fps, fps_rational, total_frames, width, height, has_audio, codec_name, audio_codec, audio_sample_rate, error FROM pd",
    "media_summary": f"WITH {PROBE} SELECT media_id, printf('%.2fs | %.3f fps | %dx%d | %s | %d frames | audio: %s', duration, round(fps, 3), width, height, codec_name, total_frames, coalesce(audio_codec, 'none')) AS line FROM pd WHERE error IS NULL",
    "cut_log_regex": f"WITH {EV} SELECT event_id AS media_id, round(printf('%.3f', value)::DOUBLE + 5, 6) AS t FROM ev WHERE event_id % 3 = 0",
    "black_log_regex": f"WITH {EV}, x AS (SELECT event_id AS media_id, printf('%.3f', value)::DOUBLE AS b_start, printf('%.3f', value + user_id % 10 * 0.1e0)::DOUBLE AS b_end FROM ev WHERE event_id % 3 = 1) SELECT * FROM x WHERE round(b_end - b_start, 9) >= 0.3e0",
    "black_islands": f"WITH {FR}, x AS (SELECT media_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY media_id ORDER BY frame_idx) AS run FROM f WHERE lap_var < 50) SELECT media_id, round(min(frame_idx) / 8e0, 6) AS b_start, round((max(frame_idx) + 1) / 8e0, 6) AS b_end FROM x GROUP BY media_id, run HAVING count(*) / 8e0 >= 0.3e0",
    "log_severity": f"WITH {EV} SELECT event_id, ['error', 'warning', 'success', 'success', 'warning', 'info'][event_id % 6 + 1] AS level FROM ev",
    "progress_parse": f"WITH {EV}, x AS (SELECT event_id AS id, event_id * 1000 / 1e6 AS m, user_id, user_id % 3 AS dur FROM ev) SELECT id, round(m, 6) AS done_s, round(CASE WHEN dur = 0 THEN 1 ELSE least(1, m / dur) END, 6) AS share, CASE WHEN id % 2 = 0 THEN user_id::DOUBLE END AS fps, CASE WHEN id % 2 = 0 THEN 1.5e0 END AS speed FROM x",
    "pcm_window": f"WITH {EV} SELECT event_type AS media_id, event_id AS sample_idx, round(round(value * 10)::INT / 32768e0, 6) AS amp FROM ev WHERE event_id >= 160 AND event_id < 480",
}
SQL["despike_blocks"] = SQL["despike_full"]
SQL["offset_clusters_blocks"] = SQL["offset_clusters"]
SQL["vad_smoothed_blocks"] = SQL["vad_smoothed"]
SQL["playback_tail_trim_blocks"] = SQL["playback_tail_trim"]
SQL["percentiles_of_groups"] = """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice::DOUBLE, 0.12e0), 6) AS p12, round(quantile_cont(l_extendedprice::DOUBLE, 0.5e0), 6) AS p50, round(quantile_cont(l_extendedprice::DOUBLE, 0.88e0), 6) AS p88,
list_sort(list(l_quantity::DOUBLE))[count(*) // 2 + 1] AS upper_quantity FROM lineitem GROUP BY l_returnflag"""
SQL["edit_command"] = rf"""WITH {CAND}, {NAMES}, e AS (SELECT pair_id, a_off - 0.5e0 AS o FROM cd WHERE a_off IS NOT NULL), f AS (SELECT pair_id, o, path, regexp_replace(path, '(\.[^./]*)$', '_synced\1') AS output, printf('%.6f', round(o * 1000, 3)) AS ms FROM e JOIN nm ON id = pair_id)
SELECT pair_id, output, CASE WHEN o < 0 THEN concat_ws(chr(10), '-y', '-ss', printf('%.6f', round(-o, 3)), '-i', path, '-t', '1440.000000', output)
ELSE concat_ws(chr(10), '-y', '-i', path, '-vf', 'tpad=start_duration=' || printf('%.6f', round(o, 3)) || ':start_mode=clone', '-af', 'adelay=' || ms || '|' || ms || ':all=1', '-t', '1440.000000', output) END AS lines FROM f"""
SQL["preview_command"] = rf"""WITH {MEDIA}, {NAMES}, f AS (SELECT media_id AS pair_id, path, '/out' || path AS synced, regexp_replace('/out' || path, '(\.[^./]*)$', '_diff_preview\1') AS output, printf('%.6f', round(least(30, greatest(0, duration % 50 - 6)), 3)) AS sk FROM m JOIN nm ON id = media_id)
SELECT pair_id, output, concat_ws(chr(10), '-y', '-ss', sk, '-i', path, '-ss', sk, '-i', synced, '-filter_complex', '[0:v]scale=854:480:force_original_aspect_ratio=decrease,pad=854:480:(ow-iw)/2:(oh-ih)/2,setsar=1[a];[1:v]scale=854:480:force_original_aspect_ratio=decrease,pad=854:480:(ow-iw)/2:(oh-ih)/2,setsar=1[b];[a][b]blend=all_mode=difference[v]', '-map', '[v]', '-t', '5.000000', '-an', output) AS lines FROM f"""
SQL["segments_sample_walker_blocks"] = SQL["segments_sample_walker"]
SQL["job_progress"] = """WITH ln AS (SELECT user_id::VARCHAR AS job_id, epoch_us(ts) AS us, epoch_us(ts)::HUGEINT * 1000000000000 + event_id AS o, (user_id % 3) * 10e0 AS duration,
 CASE event_id % 6 WHEN 0 THEN 'out_time_us=' || event_id * 1000 WHEN 1 THEN 'fps=' || user_id % 60 WHEN 2 THEN 'speed= ' || event_id % 4 || '.5x' WHEN 3 THEN 'progress=continue'
  WHEN 4 THEN CASE WHEN event_id % 5 = 0 THEN 'progress=end' ELSE 'out_time_ms=' || event_id * 1000 END ELSE CASE WHEN user_id % 3 = 0 THEN 'disk ' || event_id || ' is full' ELSE '' END END AS line
 FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
 p AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^out_time_(us|ms)=([0-9]+)', 2), '') AS DOUBLE) / 1e6 AS pos, TRY_CAST(nullif(regexp_extract(line, '^fps=([0-9.]+)', 1), '') AS DOUBLE) AS f,
  TRY_CAST(nullif(regexp_extract(line, '^speed= *([0-9.]+)x', 1), '') AS DOUBLE) AS v, CASE WHEN line = 'progress=end' THEN true WHEN line = 'progress=continue' OR line LIKE 'out_time%' THEN false END AS fin,
  CASE WHEN line <> '' AND line NOT LIKE '%=%' THEN line END AS msg FROM ln),
 j AS (SELECT job_id, max(us) AS us, count(*) AS n_lines, arg_max(duration, o) AS duration, arg_max(pos, o) FILTER (WHERE pos IS NOT NULL) AS done, arg_max(f, o) FILTER (WHERE f IS NOT NULL) AS fps,
  arg_max(v, o) FILTER (WHERE v IS NOT NULL) AS speed, arg_max(fin, o) FILTER (WHERE fin IS NOT NULL) AS fin, arg_max(msg, o) FILTER (WHERE msg IS NOT NULL) AS message FROM p GROUP BY job_id)
 SELECT job_id, round(done, 6) AS done_s, round(CASE WHEN duration > 0 AND done IS NOT NULL THEN least(1e0, done / duration) END, 6) AS share, round(fps, 6) AS fps, round(speed, 6) AS speed,
  round(CASE WHEN speed > 0 THEN CASE WHEN done >= duration THEN 0 ELSE duration - done END / speed END, 6) AS remaining_s,
  CASE WHEN coalesce(fin, false) THEN 'ended' WHEN us // 1000 + 259200000 < max(us) OVER () // 1000 - 86400000 THEN 'silent' ELSE 'running' END AS status, message, n_lines,
  round((us - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS at_s FROM j"""
SQL["job_progress_stream"] = SQL["job_progress"]
