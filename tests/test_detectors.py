"""Detectors at their thresholds, on tables made here."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from flowloom import constants as K
from flowloom.functions import exprs as X
from flowloom.operators import detectors as D
from flowloom.operators import flows as FL
from flowloom.operators import windows as W

PACKET = "capture string, pkt_no long, ts_us long, src string, dst string, sport int, dport int, flags int, payload_len int, proto string, frame_len int, ip_version int, frag boolean, window_id long, window_us long"


def pkt(n, src="a", dst="b", sport=1000, dport=80, flags=2, payload=0, proto="TCP", size=60, v=4, frag=False, ts=None, win=0):
    return ("c", n, n * 1000 if ts is None else ts, src, dst, sport, dport, flags, payload, proto, size, v, frag, win, win * K.WINDOW_US)


def table(spark, rows):
    return spark.createDataFrame(rows, PACKET)


@pytest.mark.parametrize("n, fires", [(29, 0), (30, 1)])
def test_fragments(spark, n, fires):
    assert D.fragment_flood(table(spark, [pkt(i, frag=True, proto=None, flags=None) for i in range(n)])).count() == fires


@pytest.mark.parametrize("n, fires", [(99, 0), (100, 1)])
def test_icmp(spark, n, fires):
    assert D.icmp_flood(table(spark, [pkt(i, proto="ICMP", flags=None) for i in range(n)])).count() == fires


@pytest.mark.parametrize("n, ports, flags, fires", [(5, 3, 0, 1), (4, 3, 0, 0), (5, 2, 1, 0), (5, 5, 41, 1), (5, 5, 3, 1), (9, 9, 0xC2, 0), (5, 5, 0x40, 1)])
def test_stealth(spark, n, ports, flags, fires):
    assert D.stealth_scan(table(spark, [pkt(i, dport=20 + i % ports, flags=flags) for i in range(n)])).count() == fires


@pytest.mark.parametrize("ports, fires", [(9, 0), (10, 1)])
def test_ack_scan(spark, ports, fires):
    rows = [x for i in range(ports) for x in (pkt(2 * i, dport=i + 1, flags=16), pkt(2 * i + 1, "b", "a", i + 1, 1000, flags=4))]
    assert D.ack_scan(FL.flows(table(spark, rows))).count() == fires
    assert D.ack_scan(FL.flows(table(spark, [pkt(i, dport=1, flags=16) for i in range(20)]))).count() == 0
    assert D.ack_scan(FL.flows(table(spark, [pkt(i, dport=i, flags=16, payload=5) for i in range(20)]))).count() == 0


@pytest.mark.parametrize("n, ports, answered, fires", [(30, 1, False, 1), (29, 1, False, 0), (100, 100, False, 0), (40, 1, True, 0)])
def test_syn_flood(spark, n, ports, answered, fires):
    rows = [pkt(3 * i, sport=1024 + i, dport=80 + i % ports, payload=500) for i in range(n)]
    if answered:
        rows += [pkt(3 * i + 1, sport=1024 + i, dport=80 + i % ports, flags=16) for i in range(n)]
    assert D.syn_flood(FL.flows(table(spark, rows))).count() == fires


def test_slowloris_third_window_and_next_episode(spark):
    rows, n = [], 0
    for w in [0, 1, 2, 3, 4, 20, 21, 22, 23]:
        for c in range(20):
            rows.append(pkt(n, sport=2000 + c, flags=24, payload=1, ts=w * K.WINDOW_US + c, win=w))
            n += 1
    got = D.slowloris(FL.flows(table(spark, rows))).orderBy("window_id").collect()
    # The first window has nothing before it; window 20 persists from 4 but is more than a minute later.
    assert [(r.window_id, r.connections, r.persistent) for r in got] == [(3, 20, 20), (22, 20, 20)]


def brute_edges(probes, threshold):
    history, counts, over, out = {}, {}, set(), []
    for key, t, port, i in probes:
        h, c = history.setdefault(key, deque()), counts.setdefault(key, Counter())
        h.append((t, port))
        c[port] += 1
        while h and h[0][0] <= t - K.SCAN_HISTORY_US:
            c[h[0][1]] -= 1
            if not c[h[0][1]]:
                del c[h[0][1]]
            h.popleft()
        if len(c) < threshold:
            over.discard(key)
        elif key not in over:
            over.add(key)
            out.append((key, t, i, len(c)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_scan_edges_match_a_model_with_memory(spark, seed):
    r, t, probes = random.Random(seed), 0, []
    for i in range(600):
        t += r.choice([0, 0, 0, 5, 40, 300]) * K.SECOND_US
        probes.append((r.choice("xy"), t, r.randint(1, 9), i))
    df = spark.createDataFrame(probes, "k string, window_us long, port int, flow_seq long")
    got = sorted((x.k, x.window_us, x.flow_seq, x.ports_seen) for x in D.scan_edges(df, ["k"], 5).collect())
    assert got == brute_edges(probes, 5)


@pytest.mark.parametrize("seed", range(4))
def test_anchored_windows_match_a_loop(spark, seed):
    """Seed 3: an hour of traffic without a pause, which spans many chunks."""
    r, t, rows = random.Random(seed), 0, []
    for n in range(400 if seed < 3 else 3000):
        t += r.choice([0, 1, 900_000, 1_700_000, 4_999_999, 5_000_000, 9_000_000, 4_000_000_000]) if seed < 3 else r.randrange(3_000_000)
        rows.append((f"c{n % 2}", n, t))
    want = {}
    for c in ("c0", "c1"):
        start, k = None, -1
        for cc, n, t in rows:
            if cc == c:
                if start is None or t - start >= K.WINDOW_US:
                    start, k = t, k + 1
                want[n] = (k, start)
    got = {x.pkt_no: (x.window_id, x.window_us) for x in W.anchored(spark.createDataFrame(rows, "capture string, pkt_no long, ts_us long")).collect()}
    assert got == want


def test_flow_features_of_one_flow(spark):
    rows = [pkt(0, ts=0, flags=2, size=60), pkt(1, "b", "a", 80, 1000, flags=18, size=70, ts=100_000), pkt(2, flags=16, size=50, ts=300_000)]
    f = FL.flows(table(spark, rows)).first()
    assert (f.total_fwd_packets, f.total_bwd_packets, f.fwd_bytes, f.bwd_bytes, f.syn_count, f.ack_count) == (2, 1, 110, 70, 2, 2)
    assert f.duration == 0.3 and abs(f.flow_iat_mean - 0.15) < 1e-9 and f.flow_iat_max == 0.2 and abs(f.flow_bytes_per_sec - 600) < 1e-6
    assert abs(f.fwd_pkt_len_std - 50**0.5) < 1e-9 and f.replied and not f.half_open
    one = FL.flows(table(spark, [pkt(0)])).first()
    assert one.fwd_pkt_len_std == one.flow_iat_mean == one.duration == one.flow_bytes_per_sec == 0 and not one.replied and one.half_open


def test_context_of_a_scan_and_of_ipv6(spark):
    rows = [pkt(i, dport=i + 1) for i in range(10)] + [pkt(20 + i, src=f"d{i}", dst="t") for i in range(4)] + [pkt(40, src="fe80::1", dst="fe80::2", v=6)]
    got = {x.flow_seq: x for x in FL.context(FL.flows(table(spark, rows))).collect()}
    assert (got[0].ctx_src_flows, got[0].ctx_src_ports, got[0].ctx_src_dsts, got[0].ctx_flows_per_port, got[0].ctx_reply_rate) == (10, 10, 1, 1.0, 0.0)
    assert got[20].ctx_dst_sources == 4 and got[40].ctx_src_flows == 1
    assert FL.context(FL.flows(table(spark, rows)), ipv6_context=True).where("flow_seq = 40").count() == 1


@pytest.mark.parametrize(
    "verdict, flows, ports, kind",
    [("anomaly", 11, 1, "anomaly"), ("anomaly", 4, 1, None), ("bruteforce", 11, 3, "brute_force"), ("udp_scan", 5, 6, "udp_scan"), ("dos", 1448, 8, "dos"), ("dos", 20, 20, "port_scan"), ("scan", 11, 9, "port_scan"), ("scan", 11, 1, "brute_force"), ("scan", 10, 4, "port_scan"), ("syn_flood", 11, 1, "syn_flood"), ("x", 5, 5, "suspicious")],
)
def test_labels(spark, verdict, flows, ports, kind):
    df = spark.createDataFrame([(verdict, flows, ports)], "verdict string, num_flows long, num_ports long")
    assert df.select(X.campaign_label().alias("k")).first().k == kind


def test_feature_sets():
    assert [len(set(FL.feature_set(s))) for s in "ABCD"] == [26, 32, 25, 25]
    with pytest.raises(ValueError):
        FL.feature_set("E")


def test_missing_feature_is_an_error(spark):
    with pytest.raises(KeyError):
        FL.select_features(spark.range(1), ["id", "nope"])


def test_values(spark):
    row = spark.range(1).select(
        X.percent_of(F.lit(1), F.lit(3)).alias("p"), X.percent_of(F.lit(1), F.lit(0)).alias("z"), X.format_duration(F.lit(125.9)).alias("d"), X.escape_html(F.lit("<a&'\">")).alias("h"), X.loss_percent(F.lit(3), F.lit(1)).alias("l"),
        X.format_counts(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))).alias("c"), X.format_time(F.lit(0.0)).alias("t"), X.day_of(F.lit(86400.0)).alias("day"),
    ).first()
    assert tuple(row) == (33, 0, "2m 5s", "&lt;a&amp;&#x27;&quot;&gt;", 25.0, "a x1, b x2", "-", "1970-01-02")
