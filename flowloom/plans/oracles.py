"""DuckDB texts of the registered queries, over the driver's tables."""

from __future__ import annotations

from ..sources.adapters import ALERTS_SQL, SITES_SQL, PACKETS_SQL

PACKETS = f"p AS ({PACKETS_SQL.format(events='events')})"
WINDOWS = f"""WITH RECURSIVE {PACKETS},
t AS (SELECT DISTINCT ts_us FROM p),
n AS (SELECT ts_us, min(ts_us) OVER (ORDER BY ts_us RANGE BETWEEN 5000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
s AS (SELECT min(ts_us) AS start_us FROM t UNION ALL SELECT n.nxt FROM s JOIN n ON n.ts_us = s.start_us WHERE n.nxt IS NOT NULL),
st AS (SELECT start_us, CAST(row_number() OVER (ORDER BY start_us) - 1 AS BIGINT) AS window_id FROM s),
w AS (SELECT p.*, st.window_id, st.start_us AS window_us FROM p ASOF JOIN st ON p.ts_us >= st.start_us)"""
FLOWS = f"""{WINDOWS},
k AS (SELECT *, CASE WHEN src < dst OR (src = dst AND sport <= dport) THEN concat(src, ':', sport, '|', dst, ':', dport, '|', proto)
      ELSE concat(dst, ':', dport, '|', src, ':', sport, '|', proto) END AS fk FROM w WHERE proto IN ('TCP', 'UDP', 'ICMP')),
i AS (SELECT *, first_value(src) OVER o AS isrc, first_value(dst) OVER o AS idst, first_value(sport) OVER o AS isport, first_value(dport) OVER o AS idport,
      first_value(flags) OVER o AS iflags, first_value(ts_us) OVER o AS its, (ts_us - lag(ts_us) OVER (PARTITION BY window_id, fk ORDER BY ts_us, pkt_no)) / 1e6 AS gap
      FROM k WINDOW o AS (PARTITION BY window_id, fk ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, src = isrc AND sport = isport AS fwd, src = isrc AS mine, coalesce(flags & 63, 0) AS b FROM i),
f AS (SELECT window_id, window_us, fk, min(pkt_no) AS flow_seq, count(*) AS packets, any_value(isrc) AS src, any_value(idst) AS dst, any_value(isport) AS sport, any_value(idport) AS dport,
  any_value(iflags) AS flags, any_value(its) AS first_us, any_value(proto) AS proto,
  count(*) FILTER (WHERE fwd) AS total_fwd_packets, count(*) FILTER (WHERE NOT fwd) AS total_bwd_packets,
  CAST(coalesce(sum(frame_len) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(frame_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bwd_bytes,
  coalesce(max(frame_len) FILTER (WHERE fwd), 0) AS fwd_pkt_len_max, coalesce(min(frame_len) FILTER (WHERE fwd), 0) AS fwd_pkt_len_min, coalesce(avg(frame_len) FILTER (WHERE fwd), 0) AS fwd_pkt_len_mean,
  coalesce(stddev_samp(frame_len) FILTER (WHERE fwd), 0) AS fwd_pkt_len_std, coalesce(max(frame_len) FILTER (WHERE NOT fwd), 0) AS bwd_pkt_len_max, coalesce(avg(frame_len) FILTER (WHERE NOT fwd), 0) AS bwd_pkt_len_mean,
  avg(frame_len) AS pkt_len_mean, coalesce(stddev_samp(frame_len), 0) AS pkt_len_std, coalesce(avg(gap), 0) AS flow_iat_mean, coalesce(stddev_samp(gap), 0) AS flow_iat_std, coalesce(max(gap), 0) AS flow_iat_max, coalesce(min(gap), 0) AS flow_iat_min,
  (max(ts_us) - min(ts_us)) / 1e6 AS duration, CASE WHEN max(ts_us) > min(ts_us) THEN sum(frame_len) / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0 END AS flow_bytes_per_sec,
  CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0 END AS flow_packets_per_sec,
  count(*) FILTER (WHERE b & 2 <> 0) AS syn_count, count(*) FILTER (WHERE b & 4 <> 0) AS rst_count, count(*) FILTER (WHERE b & 16 <> 0) AS ack_count, count(*) FILTER (WHERE b & 8 <> 0) AS psh_count, count(*) FILTER (WHERE b & 1 <> 0) AS fin_count,
  CAST(max(CASE WHEN proto = 'TCP' THEN 1 ELSE 0 END) AS INT) AS is_tcp, bool_or(NOT fwd) AS replied,
  bool_and(CASE WHEN mine THEN b = 16 AND payload_len = 0 ELSE b & 4 <> 0 END) AND any_value(proto) = 'TCP' AS ack_probe,
  bool_or(mine AND b & 2 <> 0) AND NOT bool_or(mine AND b & 16 <> 0) AS half_open, bool_or(mine AND b & 16 <> 0) AS initiator_ack, bool_or(b & 5 <> 0) AS closed
  FROM g GROUP BY window_id, window_us, fk)"""
ALERTS = f"a AS ({ALERTS_SQL.format(events='events')})"
CASE_SEVERITY = """CASE WHEN kind LIKE '%dos%' OR kind LIKE '%flood%' OR kind LIKE '%slowloris%' THEN 'HIGH' WHEN kind LIKE '%fragment%' OR kind LIKE '%stealth%' OR kind LIKE '%ack_scan%' THEN 'MEDIUM'
  WHEN kind LIKE '%brute%' THEN CASE WHEN alert_count >= 5 THEN 'HIGH' ELSE 'MEDIUM' END WHEN kind LIKE '%scan%' THEN CASE WHEN alert_count >= 3 THEN 'MEDIUM' ELSE 'LOW' END
  WHEN alert_count >= 3 THEN 'MEDIUM' ELSE 'LOW' END"""
_INCIDENTS = f"""o AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER q <= CASE WHEN kind LIKE '%slow%' THEN 1800000000 ELSE 300000000 END THEN 0 ELSE 1 END AS opens FROM a WINDOW q AS (PARTITION BY src, kind ORDER BY t_us, event_id)),
ss AS (SELECT *, sum(opens) OVER (PARTITION BY src, kind ORDER BY t_us, event_id) AS session FROM o),
d AS (SELECT src, kind, session, dst, min(event_id) AS first_id FROM ss GROUP BY ALL),
dd AS (SELECT src, kind, session, string_agg(dst, ',' ORDER BY first_id) AS destinations FROM d GROUP BY ALL),
m AS (SELECT src, kind, session, count(*) AS alert_count, sum(CAST(round(confidence * 1e6) AS BIGINT)) / count(confidence) / 1e6 AS confidence, min(t_us) AS first_us, max(t_us) AS last_us FROM ss GROUP BY ALL),
inc AS (SELECT m.*, destinations, {CASE_SEVERITY} AS severity FROM m JOIN dd USING (src, kind, session))"""
INCIDENTS = f"WITH {ALERTS},\n{_INCIDENTS}"
_REAL = "NOT IN ('unknown', 'multiple')"
#: First fit, an incident of every epoch at a time: the state is the epoch's list of campaigns so far.
CAMPAIGNS = """WITH RECURSIVE a AS ({alerts}),
{incidents},
e1 AS (SELECT *, string_split(destinations, ',') AS dl, max(last_us) OVER (ORDER BY first_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM inc),
e2 AS (SELECT *, sum(CASE WHEN ended IS NULL OR first_us > ended + 120000000 THEN 1 ELSE 0 END) OVER (ORDER BY first_us) AS epoch FROM e1),
q AS (SELECT *, row_number() OVER (PARTITION BY epoch ORDER BY first_us) AS k, CASE WHEN src {real} THEN [src] ELSE [] END AS rs, list_filter(dl, lambda x: x {real}) AS rd FROM e2),
fit AS (SELECT epoch, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(f BIGINT, l BIGINT, s VARCHAR[], d VARCHAR[])[]) AS cs FROM (SELECT DISTINCT epoch FROM q)
  UNION ALL SELECT epoch, k, CASE WHEN hit IS NULL THEN len(cs) + 1 ELSE hit END, CASE WHEN hit IS NULL THEN list_append(cs, {{'f': first_us, 'l': last_us, 's': rs, 'd': rd}}) ELSE list_concat(cs[1:hit - 1],
    [{{'f': least(cs[hit].f, first_us), 'l': greatest(cs[hit].l, last_us), 's': list_distinct(list_concat(cs[hit].s, rs)), 'd': list_distinct(list_concat(cs[hit].d, rd))}}], cs[hit + 1:]) END
  FROM (SELECT q.*, r.cs, list_filter(range(1, len(r.cs) + 1), lambda i: q.first_us <= r.cs[i].l + 120000000 AND q.last_us >= r.cs[i].f - 120000000 AND (list_has_any(r.cs[i].s, q.rs) OR list_has_any(r.cs[i].d, q.rd)))[1] AS hit
    FROM fit r JOIN q ON q.epoch = r.epoch AND q.k = r.k + 1)),
y AS (SELECT q.*, place FROM q JOIN fit USING (epoch, k)),
sn AS (SELECT epoch, place, string_agg(src, ',' ORDER BY k) AS sources, count(*) FILTER (WHERE src {real}) >= 3 AS many FROM (SELECT epoch, place, src, min(k) AS k FROM y GROUP BY ALL) GROUP BY ALL),
kn AS (SELECT epoch, place, string_agg(kind, ',' ORDER BY k) AS kinds, bool_or(kind LIKE '%scan%') AND bool_or(kind LIKE '%brute%' OR kind LIKE '%dos%') AS staged FROM (SELECT epoch, place, kind, min(k) AS k FROM y GROUP BY ALL) GROUP BY ALL),
dn AS (SELECT epoch, place, string_agg(dst, ',' ORDER BY pos) AS destinations FROM (SELECT epoch, place, dst, min(k * 100000 + i) AS pos FROM (SELECT epoch, place, k, unnest(dl) AS dst, generate_subscripts(dl, 1) AS i FROM y) GROUP BY ALL) GROUP BY ALL),
c AS (SELECT epoch, place, min(first_us) AS first_us, max(last_us) AS last_us, CAST(sum(alert_count) AS BIGINT) AS alert_count, count(*) AS incidents, round(sum(CAST(round(confidence * 1e6) AS BIGINT)) / count(confidence) / 1e6, 6) AS confidence,
  max(CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) AS rank FROM y GROUP BY ALL)
SELECT first_us, last_us, alert_count, incidents, confidence, sources, kinds, destinations, CASE WHEN many AND staged THEN 'multi-source + multi-stage' WHEN staged THEN 'multi-stage' WHEN many THEN 'multi-source' ELSE 'single' END AS pattern,
  CASE WHEN staged OR rank = 3 THEN 'HIGH' WHEN rank = 2 OR many THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM c JOIN sn USING (epoch, place) JOIN kn USING (epoch, place) JOIN dn USING (epoch, place)"""
SCORED = f"""{FLOWS},
sc AS (SELECT *, CASE WHEN proto = 'UDP' THEN CASE WHEN replied THEN 'normal' ELSE 'udp_scan' END WHEN syn_count > 0 AND ack_count = 0 AND dport = 80 THEN 'syn_flood' WHEN syn_count > 0 AND ack_count = 0 THEN 'scan'
  WHEN ack_count > 0 AND dport = 80 THEN 'dos' ELSE 'normal' END AS verdict, 0.5 + (flow_seq % 50) / 100.0 AS conf FROM f WHERE proto <> 'ICMP'),
atk AS (SELECT *, CASE WHEN verdict <> 'normal' THEN verdict ELSE 'anomaly' END AS reason, CASE WHEN verdict <> 'normal' THEN conf END AS c FROM sc WHERE verdict <> 'normal' OR flow_seq % 7 = 0),
v AS (SELECT window_id, src, dst, reason, count(*) AS n, min(flow_seq) AS seq FROM atk GROUP BY ALL),
tv AS (SELECT window_id, src, dst, reason AS main FROM v QUALIFY row_number() OVER (PARTITION BY window_id, src, dst ORDER BY n DESC, seq) = 1),
cg AS (SELECT window_id, window_us, src, dst, count(*) AS num_flows, count(DISTINCT dport) AS num_ports, round(sum(CAST(round(c * 1e6) AS BIGINT)) / count(c) / 1000.0) / 1000.0 AS confidence, min(flow_seq) AS first_seq FROM atk GROUP BY ALL),
lab AS (SELECT cg.*, main AS verdict, CASE WHEN main = 'anomaly' AND num_flows >= 5 THEN 'anomaly' WHEN main = 'udp_scan' AND num_flows >= 5 THEN 'udp_scan' WHEN main = 'syn_flood' AND num_flows > 10 AND num_ports <= 3 THEN 'syn_flood'
  WHEN main = 'dos' AND num_flows > 10 AND (num_ports <= 3 OR num_flows / num_ports >= 5) THEN 'dos' WHEN main = 'scan' AND num_flows >= 5 AND num_flows / num_ports <= 3 THEN 'port_scan' WHEN num_ports >= 10 THEN 'port_scan'
  WHEN num_flows > 10 AND num_ports <= 3 THEN 'brute_force' WHEN num_flows >= 5 THEN 'suspicious' END AS kind FROM cg JOIN tv USING (window_id, src, dst))"""
STEALTH = """sx AS (SELECT *, CASE WHEN flags & 63 = 0 THEN 'NULL' WHEN flags & 63 = 1 THEN 'FIN' WHEN flags & 63 = 41 THEN 'XMAS' WHEN flags & 3 = 3 THEN 'SYN-FIN' END AS ty FROM w WHERE proto = 'TCP'),
stealth AS (SELECT window_id, src, count(*) AS packets, count(DISTINCT dport) AS ports, string_agg(DISTINCT dst, ',' ORDER BY dst) AS dsts, string_agg(DISTINCT ty, ',' ORDER BY ty) AS types FROM sx WHERE ty IS NOT NULL GROUP BY window_id, src HAVING count(*) >= 5 AND count(DISTINCT dport) >= 3)"""
ACKS = "acks AS (SELECT window_id, src, count(*) AS probes, count(DISTINCT dport) AS ports, string_agg(DISTINCT dst, ',' ORDER BY dst) AS dsts FROM f WHERE ack_probe GROUP BY window_id, src HAVING count(DISTINCT dport) >= 10)"
FEATURE_LIST = ["total_fwd_packets", "total_bwd_packets", "fwd_bytes", "bwd_bytes", "syn_count", "rst_count", "ack_count", "psh_count", "fin_count", "is_tcp"]
FEATURE_DOUBLES = ["fwd_pkt_len_max", "fwd_pkt_len_min", "fwd_pkt_len_mean", "fwd_pkt_len_std", "bwd_pkt_len_max", "bwd_pkt_len_mean", "pkt_len_mean", "pkt_len_std", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "duration", "flow_bytes_per_sec", "flow_packets_per_sec"]


def edges(keys: str, out: str, distinct: int) -> str:
    same = " AND ".join(f"r.{k} = q.{k}" for k in keys.split(", "))
    return f"""{FLOWS},
r AS (SELECT window_us, src, dst, dport AS port, flow_seq FROM f WHERE proto <> 'ICMP' AND (flags IS NULL OR flags & 16 = 0)),
fr AS (SELECT r.*, row_number() OVER (PARTITION BY {keys}, window_us, port ORDER BY flow_seq) = 1 AS fresh FROM r),
e AS (SELECT {keys}, window_us, port FROM r GROUP BY ALL),
x AS (SELECT r.*, (SELECT count(DISTINCT q.port) FROM e q WHERE {same} AND q.window_us < r.window_us AND q.window_us > r.window_us - 300000000) AS prior,
  CASE WHEN fresh AND NOT EXISTS (SELECT 1 FROM e q WHERE {same} AND q.port = r.port AND q.window_us < r.window_us AND q.window_us > r.window_us - 300000000) THEN 1 ELSE 0 END AS fresh_port FROM fr r),
c AS (SELECT *, prior + sum(fresh_port) OVER (PARTITION BY {keys}, window_us ORDER BY flow_seq) AS seen FROM x),
l AS (SELECT *, coalesce(lag(seen) OVER (PARTITION BY {keys} ORDER BY flow_seq), 0) AS before FROM c)
SELECT window_us, {out}, port, flow_seq, CAST(seen AS BIGINT) AS ports_seen FROM l WHERE seen >= {distinct} AND before < {distinct}"""


SLOWLORIS = f"""{FLOWS},
h AS (SELECT window_id, window_us, least(src, dst) AS host_a, greatest(src, dst) AS host_b, least(sport, dport) AS port, list(fk) AS conns FROM f WHERE proto = 'TCP' AND packets <= 12 AND initiator_ack AND NOT closed GROUP BY ALL),
pr AS (SELECT *, coalesce(len(list_intersect(conns, lag(conns) OVER (PARTITION BY host_a, host_b, port ORDER BY window_us))), 0) AS persistent FROM h),"""

ORACLE_SQL: dict[str, str] = {
    "packet_views": f"WITH {PACKETS} SELECT pkt_no, src, dst, sport, dport, flags, payload_len, proto, CASE WHEN proto = 'TCP' THEN true ELSE false END AS is_tcp FROM p",
    "flow_keys": f"{FLOWS} SELECT pkt_no, fk AS flow FROM k",
    "tcp_flag_classes": f"WITH {PACKETS} SELECT pkt_no, flags & 63 AS base_flags, CASE WHEN flags & 63 = 0 THEN 'NULL' WHEN flags & 63 = 1 THEN 'FIN' WHEN flags & 63 = 41 THEN 'XMAS' WHEN flags & 3 = 3 THEN 'SYN-FIN' END AS stealth, flags IS NULL OR flags & 16 = 0 AS probe FROM p",
    "anchored_windows": f"{WINDOWS} SELECT window_id, window_us, count(*) AS packets FROM w GROUP BY ALL",
    "fixed_windows": f"WITH {PACKETS} SELECT CAST(floor((ts_us - (SELECT min(ts_us) FROM p)) / 5000000) AS BIGINT) AS window_id, count(*) AS packets FROM p GROUP BY ALL",
    "fragment_flood": f"{WINDOWS} SELECT window_id, src, dst, count(*) AS fragments FROM w WHERE frag GROUP BY ALL HAVING count(*) >= 30",
    "icmp_flood": f"{WINDOWS} SELECT window_id, src, dst, count(*) AS packets FROM w WHERE proto = 'ICMP' GROUP BY ALL HAVING count(*) >= 100",
    "stealth_scan": f"{WINDOWS}, {STEALTH} SELECT window_id, src, packets, ports, dsts, types FROM stealth",
    "flow_features": f"{FLOWS} SELECT window_id, flow_seq, dport AS destination_port, {', '.join(FEATURE_LIST)}, {', '.join(f'CAST(round({c} + 1e-9, 4) AS DOUBLE) AS {c}' for c in FEATURE_DOUBLES)} FROM f",
    "context_features": f"""{FLOWS}, x AS (SELECT *, CAST(floor((first_us - min(first_us) OVER (PARTITION BY window_id)) / 5000000) AS BIGINT) AS cell, CASE WHEN proto = 'ICMP' THEN 0 ELSE dport END AS cport FROM f),
cs AS (SELECT window_id, cell, src, count(*) AS ctx_src_flows, count(DISTINCT cport) AS ctx_src_ports, count(DISTINCT dst) AS ctx_src_dsts, avg(CASE WHEN replied THEN 1 ELSE 0 END) AS ctx_reply_rate FROM x GROUP BY ALL),
cd AS (SELECT window_id, cell, dst, count(DISTINCT src) AS ctx_dst_sources FROM x GROUP BY ALL)
SELECT window_id, flow_seq, ctx_src_flows, ctx_src_ports, ctx_src_dsts, round(ctx_src_flows / ctx_src_ports, 6) AS ctx_flows_per_port, ctx_dst_sources, round(ctx_reply_rate, 6) AS ctx_reply_rate FROM x JOIN cs USING (window_id, cell, src) JOIN cd USING (window_id, cell, dst)""",
    "ack_scan": f"{FLOWS}, {ACKS} SELECT window_id, src, probes, ports, dsts FROM acks",
    "syn_flood": f"{FLOWS} SELECT window_id, src, dst, count(*) AS half_open, count(DISTINCT dport) AS ports FROM f WHERE half_open GROUP BY ALL HAVING count(*) >= 30 AND count(DISTINCT dport) <= 3",
    "slowloris_held": f"{SLOWLORIS} z AS (SELECT 1) SELECT window_id, host_a, host_b, port, CAST(len(conns) AS BIGINT) AS connections FROM pr",
    "slow_connections": f"{FLOWS} SELECT window_id, least(src, dst) AS host_a, greatest(src, dst) AS host_b, least(sport, dport) AS port, count(*) AS connections FROM f WHERE proto = 'TCP' AND packets <= 12 GROUP BY ALL HAVING count(*) >= 20",
    "slow_scan_edges": edges("src, dst", "src, dst", 15),
    "dist_scan_edges": edges("dst", "dst", 20),
    "fragment_episodes": f"{WINDOWS}, fr AS (SELECT window_us, src, dst, count(*) AS fragments FROM w WHERE frag GROUP BY ALL HAVING count(*) >= 30), e AS (SELECT *, lag(window_us) OVER (PARTITION BY src, dst ORDER BY window_us) AS prev FROM fr) SELECT window_us, src, dst, fragments FROM e WHERE prev IS NULL OR window_us - prev > 60000000",
    "slowloris_alerts": f"""{SLOWLORIS} hot AS (SELECT *, lag(window_us) OVER (PARTITION BY host_a, host_b, port ORDER BY window_us) AS prev FROM pr WHERE len(conns) >= 20 AND persistent >= 10),
ep AS (SELECT *, sum(CASE WHEN prev IS NULL OR window_us - prev > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY host_a, host_b, port ORDER BY window_us) AS episode FROM hot)
SELECT window_us, host_a, host_b, port, CAST(len(conns) AS BIGINT) AS connections, CAST(persistent AS BIGINT) AS persistent FROM ep QUALIFY row_number() OVER (PARTITION BY host_a, host_b, port, episode ORDER BY window_us) = 3""",
    "campaigns": CAMPAIGNS.format(alerts=SITES_SQL.format(events="events"), incidents=_INCIDENTS, real=_REAL),
    "sample_campaigns": CAMPAIGNS.format(alerts=ALERTS_SQL.format(events="events"), incidents=_INCIDENTS, real=_REAL),
    "campaign_labels": f"{SCORED} SELECT window_id, src, dst, verdict, num_flows, num_ports, confidence, kind FROM lab",
    "evasion_suppression": f"{SCORED}, {STEALTH}, {ACKS} SELECT window_id, src, dst, kind FROM lab WHERE kind IS NOT NULL AND NOT (kind = 'udp_scan' AND EXISTS (SELECT 1 FROM (SELECT window_id, src FROM stealth UNION SELECT window_id, src FROM acks) e WHERE e.window_id = lab.window_id AND e.src = lab.src))",
    "low_conf_filter": f"{SCORED} SELECT window_id, src, dst, kind, confidence FROM lab WHERE kind IS NOT NULL AND NOT coalesce(confidence < 0.7, false)",
    "unsure_asof": f"""{SCORED}, un AS (SELECT src, dst, window_us AS since, verdict, confidence FROM lab WHERE kind IS NOT NULL AND confidence < 0.7),
al AS (SELECT window_us, src, dst, count(*) AS n FROM w WHERE frag OR proto = 'TCP' GROUP BY ALL)
SELECT al.window_us, al.src AS source, al.dst AS destination, verdict AS unsure_verdict, confidence AS unsure_confidence FROM al ASOF LEFT JOIN un ON al.src = un.src AND al.dst = un.dst AND al.window_us >= un.since""",
    "alert_family_lookup": f"WITH {ALERTS} SELECT event_id, kind, CASE WHEN kind IN ('port_scan', 'slow_scan') THEN 'recon' WHEN kind = 'brute_force' THEN 'access' WHEN kind = 'dos' THEN 'flood' ELSE 'anomaly' END AS family, CASE WHEN kind = 'slow_scan' THEN 1 ELSE 2 END AS specificity FROM a",
    "policy_single_family": f"""WITH RECURSIVE {ALERTS}, d AS (SELECT event_id, src, dst, t_us, min(t_us) OVER (PARTITION BY src, dst ORDER BY t_us RANGE BETWEEN 60000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM a WHERE kind = 'dos'),
s AS (SELECT src, dst, min(t_us) AS t_us FROM d GROUP BY ALL UNION ALL SELECT s.src, s.dst, d.nxt FROM s JOIN d ON d.src = s.src AND d.dst = s.dst AND d.t_us = s.t_us WHERE d.nxt IS NOT NULL)
SELECT event_id, d.src AS source, d.dst AS destination, s.t_us IS NOT NULL AS notified FROM d LEFT JOIN s ON d.src = s.src AND d.dst = s.dst AND d.t_us = s.t_us""",
    "alert_policy": f"""WITH RECURSIVE {ALERTS}, k AS (SELECT event_id, src, dst, kind, t_us, CASE WHEN kind IN ('port_scan', 'slow_scan') THEN 'recon' WHEN kind = 'brute_force' THEN 'access' WHEN kind = 'dos' THEN 'flood' ELSE 'anomaly' END AS family, CASE WHEN kind = 'slow_scan' THEN 1 ELSE 2 END AS level FROM a),
c AS (SELECT *, min(t_us) OVER (PARTITION BY src, dst, family ORDER BY t_us RANGE BETWEEN 60000000 FOLLOWING AND UNBOUNDED FOLLOWING) AS cooled,
  min(t_us) FILTER (WHERE level = 2) OVER (PARTITION BY src, dst, family ORDER BY t_us ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS higher FROM k),
d AS (SELECT *, CASE WHEN level = 2 THEN cooled ELSE least(cooled, higher) END AS nxt FROM c),
s AS (SELECT src, dst, family, min(t_us) AS t_us, false AS upgrade FROM d GROUP BY ALL UNION ALL SELECT d.src, d.dst, d.family, d.nxt, d.nxt - d.t_us < 60000000 FROM s JOIN d USING (src, dst, family, t_us) WHERE d.nxt IS NOT NULL),
e AS (SELECT d.*, s.upgrade, s.upgrade IS NOT NULL AS notified FROM d LEFT JOIN s ON d.src = s.src AND d.dst = s.dst AND d.family = s.family AND d.t_us = s.t_us),
g AS (SELECT *, count(*) FILTER (WHERE notified) OVER (PARTITION BY src, dst, family ORDER BY t_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS shown_before FROM e),
h AS (SELECT src, dst, family, shown_before, kind, count(*) AS n FROM g WHERE NOT notified GROUP BY ALL),
r AS (SELECT src, dst, family, shown_before, CAST(sum(n) AS BIGINT) AS repeats, string_agg(concat(kind, ' x', n), ', ' ORDER BY kind) AS told FROM h GROUP BY ALL)
SELECT event_id, g.src AS source, g.dst AS destination, kind, g.family, notified, upgrade, CASE WHEN notified THEN coalesce(repeats, 0) END AS suppressed_repeats, CASE WHEN notified THEN coalesce(told, '') END AS suppressed
FROM g LEFT JOIN r ON g.src = r.src AND g.dst = r.dst AND g.family = r.family AND g.shown_before = r.shown_before""",
    "incidents": f"{INCIDENTS} SELECT src, kind, severity, alert_count, round(confidence, 6) AS confidence, first_us, last_us, last_us - first_us AS duration_us, destinations FROM inc",
    "severity_by_day": f"{INCIDENTS} SELECT strftime(make_timestamp(first_us), '%Y-%m-%d') AS day, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low FROM inc GROUP BY ALL",
    "type_counts": f"{INCIDENTS} SELECT kind, count(*) AS incidents, count(*) FILTER (WHERE confidence < 0.6) AS low_confidence FROM inc GROUP BY ALL",
    "top_sources": f"{INCIDENTS} SELECT src, count(*) AS incidents FROM inc GROUP BY src ORDER BY incidents DESC, min(first_us), src LIMIT 5",
    "newest_alerts": f"WITH {ALERTS} SELECT event_id, src, kind FROM a ORDER BY event_id DESC LIMIT 50",
    "summarize_alerts": f"WITH {ALERTS} SELECT kind, count(*) AS logged, count(*) FILTER (WHERE notified) AS notified, count(DISTINCT (src, dst)) AS pairs FROM a GROUP BY kind",
    "soak_rates": f"WITH {ALERTS}, h AS (SELECT (max(t_us) - min(t_us)) / 3.6e9 AS hours FROM a) SELECT kind, count(*) AS alerts, round(count(*) / any_value(hours), 6) AS per_hour, round(count(*) FILTER (WHERE notified) / any_value(hours), 6) AS notified_per_hour FROM a, h GROUP BY kind",
    "kinds_per_capture": f"WITH {ALERTS} SELECT capture, kind, count(*) AS alerts, count(*) FILTER (WHERE notified) AS shown FROM a GROUP BY ALL",
    "wrong_kinds": f"WITH {ALERTS}, ex(capture, expected) AS (VALUES ('cap0', 'port_scan'), ('cap1', 'brute_force'), ('cap2', 'dos'), ('cap3', 'port_scan')) SELECT capture, expected, kind, count(*) AS alerts FROM a JOIN ex USING (capture) WHERE kind <> expected AND NOT (expected IN ('port_scan', 'udp_scan', 'stealth_scan', 'ack_scan', 'fragmented_scan') AND kind IN ('slow_scan', 'distributed_scan')) GROUP BY ALL",
    "evaluate_captures": f"WITH {ALERTS}, ex(capture, expected) AS (VALUES ('cap0', 'port_scan'), ('cap1', 'brute_force'), ('cap2', 'dos'), ('cap3', 'port_scan'), ('cap9', 'slowloris')) SELECT ex.capture, expected, count(event_id) AS logged, count(*) FILTER (WHERE notified) AS notified, count(event_id) > 0 AS detected, coalesce(bool_or(kind = expected), false) AS correct, coalesce(bool_or(kind = expected AND notified), false) AS correct_shown FROM ex LEFT JOIN a USING (capture) GROUP BY ALL",
    "detection_layers": f"WITH {ALERTS} SELECT CASE WHEN kind = 'anomaly' THEN 'anomaly' WHEN confidence IS NULL THEN 'tracker' ELSE 'model' END AS layer, count(*) AS alerts, count(*) FILTER (WHERE notified) AS notified FROM a GROUP BY ALL",
    "ab_difference": f"WITH {ALERTS}, x AS (SELECT kind, count(*) AS n FROM a WHERE event_id % 2 = 0 GROUP BY kind), y AS (SELECT kind, count(*) AS n FROM a WHERE event_id % 3 = 0 AND kind <> 'dos' GROUP BY kind) SELECT kind, coalesce(x.n, 0) - coalesce(y.n, 0) AS gained FROM x FULL JOIN y USING (kind) WHERE coalesce(x.n, 0) > coalesce(y.n, 0)",
    "window_profile": f"{WINDOWS} SELECT window_id, src, count(*) AS attempts, count(DISTINCT dport) AS ports, count(DISTINCT dst) AS dsts, CASE WHEN count(DISTINCT dport) = 1 THEN 'one port hammered (flood / brute-force)' WHEN count(*) / count(DISTINCT dport) <= 3 THEN 'many different ports (scan)' ELSE 'mixed' END AS hint FROM w WHERE proto = 'TCP' AND flags & 2 <> 0 AND flags & 16 = 0 GROUP BY window_id, src HAVING count(*) >= 5",
    "multi_source_windows": f"{WINDOWS} SELECT window_id, dst, count(DISTINCT src) AS sources, count(*) AS attempts FROM w WHERE proto = 'TCP' AND flags & 2 <> 0 AND flags & 16 = 0 GROUP BY window_id, dst HAVING count(DISTINCT src) >= 3",
    "episode_activity": f"{WINDOWS}, fr AS (SELECT window_us, src, dst FROM w WHERE frag GROUP BY ALL HAVING count(*) >= 30), g AS (SELECT *, window_us - lag(window_us) OVER (PARTITION BY src, dst ORDER BY window_us) AS pause FROM fr) SELECT src, dst, count(*) AS active, max(window_us) - min(window_us) AS span_us, coalesce(max(pause), 0) AS longest_pause_us FROM g GROUP BY ALL",
    "protocol_counts": f"WITH {PACKETS} SELECT coalesce(proto, 'other') AS proto, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes FROM p GROUP BY ALL",
    "top_ports": f"WITH {PACKETS} SELECT dport, count(*) AS packets FROM p WHERE dport IS NOT NULL GROUP BY dport ORDER BY packets DESC, dport LIMIT 10",
    "profile_medians": f"{FLOWS} SELECT src, CAST(quantile_cont(packets, 0.5) AS DOUBLE) AS packets, round(quantile_cont(duration, 0.5), 6) AS duration, CAST(quantile_cont(fwd_bytes, 0.5) AS DOUBLE) AS fwd_bytes FROM f GROUP BY src",
    "class_means": f"{SCORED} SELECT verdict, count(*) AS flows, round(avg(total_fwd_packets), 6) AS total_fwd_packets, round(avg(fwd_bytes), 6) AS fwd_bytes, round(sum(CAST(round(duration * 1e6) AS BIGINT)) / count(duration) / 1e6, 6) AS duration FROM sc GROUP BY verdict",
    "confusion_counts": f"{SCORED} SELECT proto AS actual, verdict AS predicted, count(*) AS flows FROM sc GROUP BY ALL",
    "time_split_holdout": f"{FLOWS}, r AS (SELECT flow_seq, row_number() OVER (ORDER BY window_us, flow_seq) AS rn, count(*) OVER () AS n FROM f) SELECT flow_seq, CASE WHEN rn <= floor(n * 0.5) THEN 'train' ELSE 'holdout' END AS part FROM r",
    "capped_sample": f"{FLOWS}, r AS (SELECT flow_seq, src, row_number() OVER (PARTITION BY src ORDER BY (flow_seq * 48271 + 42) % 2147483647, flow_seq) AS rn FROM f) SELECT flow_seq, src FROM r WHERE rn <= 100",
    "normalise_alerts": """WITH j AS (SELECT event_id, user_id, event_type, value, event_id % 5 AS v FROM events WHERE event_id % 7 NOT IN (5, 6))
SELECT event_id, CASE v WHEN 4 THEN 'unknown' ELSE concat('10.0.0.', CAST(user_id % 20 AS STRING)) END AS src, CASE WHEN v IN (0, 1) THEN concat('192.168.1.', CAST(user_id % 4 AS STRING)) ELSE 'unknown' END AS dst, lower(event_type) AS kind,
CASE v WHEN 0 THEN 1704067200.0 + event_id WHEN 1 THEN 1704067200.0 + event_id WHEN 2 THEN 1704067200.0 WHEN 3 THEN 1704067200.0 ELSE 0.0 END AS seconds, CASE WHEN v IN (0, 2) THEN round(value - floor(value), 2) END AS confidence FROM j""",
    "nearest_profile": f"""{FLOWS}, ff AS (SELECT src, CAST(packets AS DOUBLE) AS packets, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, round(duration, 4) AS duration, CAST(pkt_len_mean AS DOUBLE) AS pkt_len_mean FROM f),
u AS (UNPIVOT ff ON packets, fwd_bytes, duration, pkt_len_mean INTO NAME feature VALUE v), m AS (SELECT src, feature, quantile_cont(v, 0.5) AS med FROM u GROUP BY ALL),
tg AS (SELECT feature, med AS target FROM m WHERE src = '10.0.2.1'), kn AS (SELECT * FROM m WHERE src <> '10.0.2.1')
SELECT feature, round(target, 6) AS target, arg_min(src, (abs(med - target), src)) AS nearest, target < min(med) OR target > max(med) AS outside FROM kn JOIN tg USING (feature) GROUP BY feature, target""",
    "relative_gap": f"""{FLOWS}, ff AS (SELECT proto = 'UDP' AS side, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, CAST(packets AS DOUBLE) AS packets, CAST(pkt_len_mean AS DOUBLE) AS pkt_len_mean FROM f WHERE proto <> 'ICMP'),
u AS (UNPIVOT ff ON fwd_bytes, packets, pkt_len_mean INTO NAME feature VALUE v), m AS (SELECT feature, avg(v) FILTER (WHERE side) AS a, avg(v) FILTER (WHERE NOT side) AS b FROM u GROUP BY feature)
SELECT feature, round(a, 6) AS mean_a, round(b, 6) AS mean_b, round(abs(a - b) / greatest(abs(a), abs(b)), 6) AS gap, abs(a - b) / greatest(abs(a), abs(b)) > 0.5 AS marked FROM m""",
    "payload_stats": f"WITH {PACKETS} SELECT src, count(*) AS packets, min(payload_len) AS payload_min, max(payload_len) AS payload_max, count(*) FILTER (WHERE payload_len > 0) AS with_payload FROM p WHERE proto = 'TCP' GROUP BY src",
    "direction_check": f"""{FLOWS}, o AS (SELECT *, first_value(src) OVER q AS fsrc, first_value(sport) OVER q AS fsport FROM k WINDOW q AS (PARTITION BY fk ORDER BY pkt_no))
SELECT count(*) AS packets, count(*) FILTER (WHERE src <> fsrc) AS real_replies, count(*) FILTER (WHERE src <> fsrc OR sport <> fsport) AS counted_replies, count(*) FILTER (WHERE src = dst) AS same_address FROM o""",
    "probe_ports": f"{WINDOWS} SELECT window_id, src, dst, count(DISTINCT dport) AS ports, count(DISTINCT dport) FILTER (WHERE flags & 16 = 0) AS probe_ports, count(DISTINCT dport) FILTER (WHERE dport >= 32768) AS ephemeral FROM w WHERE proto = 'TCP' GROUP BY ALL",
    "session_summary": f"{WINDOWS} SELECT count(*) AS packets, count(DISTINCT window_id) AS windows, round((max(ts_us) - min(ts_us)) / 3.6e9, 6) AS hours FROM w",
    "packet_lines": f"WITH {PACKETS} SELECT pkt_no, concat(coalesce(proto, 'other'), ' ', src, CASE WHEN sport IS NOT NULL THEN concat(':', sport) ELSE '' END, ' -> ', dst, CASE WHEN dport IS NOT NULL THEN concat(':', dport) ELSE '' END, ' ', frame_len, ' bytes') AS line FROM p",
    "window_growth": f"{WINDOWS}, c AS (SELECT window_id, window_us, count(*) AS packets FROM w GROUP BY ALL) SELECT window_id, packets, round(packets / lag(packets) OVER (ORDER BY window_id), 6) AS ratio FROM c",
    "unsure_incidents": f"{INCIDENTS} SELECT src, kind, first_us, CASE WHEN kind = 'anomaly' THEN 'anomaly' WHEN confidence IS NULL THEN 'tracker' ELSE 'model' END AS layer, EXISTS (SELECT 1 FROM a WHERE a.src = inc.src AND a.kind = inc.kind AND a.confidence < 0.1) AS unsure FROM inc",
    "family_counts": f"WITH {ALERTS} SELECT CASE WHEN kind IN ('port_scan', 'slow_scan') THEN 'recon' WHEN kind = 'brute_force' THEN 'access' WHEN kind = 'dos' THEN 'flood' ELSE 'anomaly' END AS family, count(*) AS alerts, count(*) FILTER (WHERE notified) AS notified FROM a GROUP BY ALL",
    "evaluation_totals": f"WITH {ALERTS}, ex(capture, expected) AS (VALUES ('cap0', 'port_scan'), ('cap1', 'brute_force'), ('cap2', 'dos'), ('cap3', 'port_scan'), ('cap9', 'slowloris')), e AS (SELECT ex.capture, count(event_id) AS logged, count(*) FILTER (WHERE notified) AS notified, count(event_id) > 0 AS detected, coalesce(bool_or(kind = expected), false) AS correct, coalesce(bool_or(kind = expected AND notified), false) AS correct_shown FROM ex LEFT JOIN a USING (capture) GROUP BY ALL) SELECT count(*) AS captures, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE correct_shown) AS shown, CAST(sum(logged) AS BIGINT) AS logged, CAST(sum(notified) AS BIGINT) AS notified FROM e",
    "port_filter": f"WITH {PACKETS} SELECT pkt_no, src, dst FROM p WHERE proto IN ('TCP', 'UDP') AND (sport = 443 OR dport = 443)",
    "confidence_text": f"WITH {ALERTS} SELECT event_id, CASE WHEN confidence IS NULL THEN 'conf=  -   ' WHEN confidence < 0.6 THEN printf('conf=%.2f LOW', confidence) ELSE printf('conf=%.2f    ', confidence) END AS text FROM a",
    "pair_layers": f"""WITH {ALERTS}, l AS (SELECT *, CASE WHEN kind = 'anomaly' THEN 'anomaly' WHEN confidence IS NULL THEN 'tracker' ELSE 'model' END AS layer FROM a)
SELECT src, dst, CASE WHEN count(DISTINCT layer) = 1 THEN min(layer) ELSE 'mixed' END AS layer, count(*) AS alerts, count(*) FILTER (WHERE notified) AS shown FROM l GROUP BY src, dst""",
    "day_chart": f"""{INCIDENTS}, dd2 AS (SELECT strftime(make_timestamp(first_us), '%Y-%m-%d') AS day, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, count(*) AS total FROM inc GROUP BY ALL),
mm AS (SELECT *, max(total) OVER () AS most FROM dd2) SELECT *, high * 100 // most AS high_width, medium * 100 // most AS medium_width, low * 100 // most AS low_width FROM mm""",
    "hidden_incidents": f"{INCIDENTS} SELECT least(count(*), 25) AS shown, greatest(count(*) - 25, 0) AS hidden FROM inc",
    "kind_shares": f"WITH {ALERTS} SELECT kind, count(*) AS n, min(event_id) AS first, round(count(*) / (SELECT count(*) FROM a), 6) AS share FROM a GROUP BY kind",
    "normal_captures": f"WITH {ALERTS}, nc(capture) AS (VALUES ('cap4'), ('cap8')) SELECT nc.capture, count(event_id) AS alerts, count(*) FILTER (WHERE notified) AS notified, coalesce(string_agg(DISTINCT kind, ',' ORDER BY kind), '') AS kinds FROM nc LEFT JOIN a USING (capture) GROUP BY nc.capture",
    "evaluation_summary": f"""WITH {ALERTS}, ex(capture, expected, in_training) AS (VALUES ('cap0', 'port_scan', true), ('cap1', 'brute_force', true), ('cap2', 'dos', false), ('cap3', 'port_scan', false), ('cap9', 'slowloris', false)),
e AS (SELECT ex.capture, ex.in_training, ex.expected, count(event_id) AS logged, count(*) FILTER (WHERE notified) AS notified, coalesce(bool_or(kind = expected), false) AS correct, coalesce(bool_or(kind = expected AND notified), false) AS shown,
  coalesce(bool_or(kind <> expected AND NOT (expected = 'port_scan' AND kind IN ('slow_scan', 'distributed_scan'))), false) AS wrong FROM ex LEFT JOIN a USING (capture) GROUP BY ALL)
SELECT in_training, count(*) AS captures, count(*) FILTER (WHERE logged > 0) AS detected, count(expected) AS checkable, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE wrong) AS with_wrong, CAST(sum(logged) AS BIGINT) AS logged, CAST(sum(notified) AS BIGINT) AS notified FROM e GROUP BY in_training""",
    "predictions_by_source": f"{SCORED} SELECT src, verdict, count(*) AS flows FROM sc GROUP BY ALL",
    "stealth_counts": f"""WITH {PACKETS}, sx AS (SELECT src, CASE WHEN flags & 63 = 0 THEN 'NULL' WHEN flags & 63 = 1 THEN 'FIN' WHEN flags & 63 = 41 THEN 'XMAS' WHEN flags & 3 = 3 THEN 'SYN-FIN' END AS ty FROM p WHERE proto = 'TCP')
SELECT 'type' AS side, ty AS name, count(*) AS packets FROM sx WHERE ty IS NOT NULL GROUP BY ty UNION ALL SELECT 'source', src, count(*) FROM sx WHERE ty IS NOT NULL GROUP BY src""",
    "tracker_ports": f"""{FLOWS}, x AS (SELECT *, flags IS NULL OR flags & 16 = 0 AS probe FROM f WHERE proto <> 'ICMP'),
pa AS (SELECT count(DISTINCT dport) AS n, count(DISTINCT dport) FILTER (WHERE probe) AS m FROM x GROUP BY src, dst), ta AS (SELECT count(DISTINCT dport) AS n, count(DISTINCT dport) FILTER (WHERE probe) AS m FROM x GROUP BY dst)
SELECT count(*) FILTER (WHERE proto = 'TCP' AND NOT probe) AS ack_first, count(*) FILTER (WHERE proto = 'TCP' AND NOT probe AND dport >= 32768) AS ack_ephemeral, count(*) FILTER (WHERE proto = 'TCP' AND probe) AS probe_first,
  count(*) FILTER (WHERE proto = 'TCP' AND probe AND dport >= 32768) AS probe_ephemeral, count(*) FILTER (WHERE proto = 'UDP') AS udp_flows,
  (SELECT max(n) FROM pa) AS pair_all, (SELECT max(m) FROM pa) AS pair_probes, (SELECT max(n) FROM ta) AS target_all, (SELECT max(m) FROM ta) AS target_probes FROM x""",
    "top_verdicts": f"{SCORED} SELECT verdict, count(*) AS flows, round(sum(CAST(round(conf * 1e6) AS BIGINT)) / count(conf) / 1000.0) / 1000.0 AS confidence FROM sc GROUP BY verdict ORDER BY flows DESC, verdict LIMIT 3",
    "profile_votes": f"""{SCORED}, ff AS (SELECT src, CAST(packets AS DOUBLE) AS packets, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, round(duration, 4) AS duration, CAST(pkt_len_mean AS DOUBLE) AS pkt_len_mean FROM f),
u AS (UNPIVOT ff ON packets, fwd_bytes, duration, pkt_len_mean INTO NAME feature VALUE v), m AS (SELECT src, feature, quantile_cont(v, 0.5) AS med FROM u GROUP BY ALL),
tg AS (SELECT feature, med AS target FROM m WHERE src = '10.0.2.1'), kn AS (SELECT * FROM m WHERE src <> '10.0.2.1'),
ne AS (SELECT feature, arg_min(src, (abs(med - target), src)) AS src, target < min(med) OR target > max(med) AS outside FROM kn JOIN tg USING (feature) GROUP BY feature, target),
lb AS (SELECT src, arg_min(verdict, flow_seq) AS label FROM sc GROUP BY src)
SELECT label, count(*) AS votes, count(*) FILTER (WHERE outside) AS outside FROM ne JOIN lb USING (src) GROUP BY label""",
    "loss_rates": f"WITH {ALERTS}, c AS (SELECT capture, count(*) FILTER (WHERE notified) AS received, count(*) FILTER (WHERE NOT notified) AS dropped FROM a GROUP BY capture) SELECT capture, received, dropped, round(100.0 * dropped / (received + dropped), 2) AS loss_percent FROM c",
    "unknown_numbers": rf"""WITH {PACKETS}, li AS (SELECT proto, concat(proto, ' ', src, ':', sport, ' -> ', dst, ':', dport, ' ', frame_len, ' bytes') AS line FROM p WHERE proto IN ('UDP', 'TCP')),
nu AS (SELECT DISTINCT proto, unnest(regexp_extract_all(line, '(\d+)', 1)) AS number FROM li) SELECT number FROM nu WHERE proto = 'UDP' AND number NOT IN (SELECT number FROM nu WHERE proto = 'TCP')""",
    "training_flows": f"""{FLOWS}, o AS (SELECT *, first_value(src) OVER q AS fsrc, first_value(dst) OVER q AS fdst, first_value(sport) OVER q AS fsport, first_value(dport) OVER q AS fdport, coalesce(flags & 63, 0) AS b FROM k WINDOW q AS (PARTITION BY fk ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
o2 AS (SELECT *, src = fsrc AND sport = fsport AS fwd FROM o)
SELECT min(pkt_no) AS flow_seq, any_value(fsrc) AS src, any_value(fdst) AS dst, any_value(fdport) AS destination_port, count(*) FILTER (WHERE fwd) AS total_fwd_packets, count(*) FILTER (WHERE NOT fwd) AS total_bwd_packets,
  CAST(coalesce(sum(frame_len) FILTER (WHERE fwd), 0) AS BIGINT) AS fwd_bytes, CAST(coalesce(sum(frame_len) FILTER (WHERE NOT fwd), 0) AS BIGINT) AS bwd_bytes, count(*) FILTER (WHERE b & 2 <> 0) AS syn_count, count(*) FILTER (WHERE b & 16 <> 0) AS ack_count,
  round((max(ts_us) - min(ts_us)) / 1e6, 4) AS duration FROM o2 GROUP BY fk""",
    "aligned_features": f"{FLOWS} SELECT CAST(flow_seq AS DOUBLE) AS flow_seq, 0.0::DOUBLE AS ctx_src_flows, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, CAST(coalesce(flags, 0) AS DOUBLE) AS first_flags, 0.0::DOUBLE AS is_ipv6 FROM f",
    "renamed_flows": f"{FLOWS} SELECT CAST(dport AS DOUBLE) AS destination_port, CAST(fwd_bytes AS DOUBLE) AS fwd_bytes, CAST(packets AS DOUBLE) AS flow_packets_per_sec, flow_seq FROM f WHERE round(duration, 4) <> 0",
    "schema_columns": f"WITH {ALERTS} SELECT 'label' AS role, 'capture' AS name, count(capture) AS values FROM a UNION ALL SELECT 'feature', 'event_id', count(event_id) FROM a UNION ALL SELECT 'feature', 't_us', count(t_us) FROM a UNION ALL SELECT 'feature', 'confidence', count(confidence) FROM a",
    "dashboard_cards": "WITH sc AS (" + CAMPAIGNS.format(alerts=SITES_SQL.format(events="events"), incidents=_INCIDENTS, real=_REAL) + f"), si AS (WITH a AS ({SITES_SQL.format(events='events')}), {_INCIDENTS} SELECT * FROM inc), sa AS ({SITES_SQL.format(events='events')}) SELECT count(*) AS campaigns, count(*) FILTER (WHERE severity = 'HIGH') AS high, count(*) FILTER (WHERE severity = 'MEDIUM') AS medium, count(*) FILTER (WHERE severity = 'LOW') AS low, (SELECT count(*) FROM si) AS incidents, (SELECT count(*) FROM si WHERE confidence < 0.6) AS to_review, (SELECT count(*) FROM sa) AS alerts, (SELECT count(*) FROM sa WHERE notified) AS shown FROM sc",
    "incident_marks": f"""{SCORED}, un AS (SELECT src, dst, window_us AS since FROM lab WHERE kind IS NOT NULL AND confidence < 0.7),
al AS (SELECT window_us, src, dst, bool_or(frag) AS fr FROM w WHERE frag OR proto = 'TCP' GROUP BY ALL),
au AS (SELECT al.src, al.window_us AS t_us, CASE WHEN fr THEN 'fragmented_scan' ELSE 'stealth_scan' END AS kind, un.since IS NOT NULL AS unsure FROM al ASOF LEFT JOIN un ON al.src = un.src AND al.dst = un.dst AND al.window_us >= un.since),
ao AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER q <= 300000000 THEN 0 ELSE 1 END AS opens FROM au WINDOW q AS (PARTITION BY src, kind ORDER BY t_us)),
ax AS (SELECT *, sum(opens) OVER (PARTITION BY src, kind ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS session FROM ao),
ap AS (SELECT src, kind, bool_or(unsure) AS unsure FROM au GROUP BY ALL)
SELECT src, kind, min(t_us) AS first_us, count(*) AS alert_count, 'tracker' AS layer, any_value(ap.unsure) AS unsure, false AS review FROM ax JOIN ap USING (src, kind) GROUP BY src, kind, session""",
    "soak_pairs": f"WITH sa AS ({SITES_SQL.format(events='events')}) SELECT concat(src, ' -> ', dst) AS pair, count(*) AS alerts FROM sa GROUP BY ALL ORDER BY alerts DESC, pair LIMIT 10",
    "kind_bars": f"{INCIDENTS}, tc AS (SELECT kind, count(*) AS incidents, count(*) FILTER (WHERE confidence < 0.6) AS low_confidence FROM inc GROUP BY ALL) SELECT *, CAST(floor(incidents * 100 / max(incidents) OVER ()) AS BIGINT) AS width FROM tc",
}
