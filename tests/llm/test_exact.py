"""Text operators against plain models of what they promise: odd rows, empty tables, ties, clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from flowloom.llm import audio, chaining, classlm, decontam, packing, pii, simhash, tokens, toxicity, urlgraph
from flowloom.llm.common import LETTER_WORDS, Workspace, components, table, word_hash

DOC = "doc_id long, text string, h string, id long, n int"
LETTERS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [(0, "plain words here, and there"), (1, None), (2, ""), (3, "one"), (None, "no id at all"), (5, "repeated row"), (5, "repeated row"), (5, "same id, other text"), (6, "é ñ 世界 𝄞\n\t  spaced   out "), (7, "w " * 4000), (8, "\x00 zero\x00byte"), (9, "x" * 50000)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 7, 1) for i, t in rows], DOC)


def empty(spark):
    return frame(spark, []).limit(0)


def reference_ids(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, end], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# ---------------------------------------------------------------- 1 token ids


def test_elias_fano_round_trip():
    r = random.Random(1)
    for n, most in ((0, 1), (1, 0), (1, 9), (5, 5), (700, 1), (3000, 10**6), (2000, 40)):
        values = np.sort(np.array([r.randint(0, most) for _ in range(n)], np.int64))
        e = tokens.EliasFano.of(values)
        assert (e.values() == values).all()
        assert [e.select(i) for i in range(0, n, max(n // 50, 1))] == values[:: max(n // 50, 1)].tolist()
    big = tokens.EliasFano.of(np.cumsum(np.full(10000, 1000)))
    assert (len(big.low) + len(big.high)) * 8 / 10000 < 2.1 + math.log2(1000) + 0.5
    with pytest.raises(IndexError):
        e.select(-1)


def test_encoder_is_exact_on_odd_texts():
    r = random.Random(3)
    bits = ["a", "foo", " ", "  ", "\n", "\t", " \n", "é", "世界", "\u3000", "12", "'s", "...", "<|endoftext|>", "\x1c", ",", ".", "_.", ". ", ".\n", "Word", "\0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(4000)]
    e = tokens.Encoder(room=100_000)
    got = [y for i in range(0, len(texts), 8) for y in e.encode(texts[i : i + 8])]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_encoder_keeps_pieces_of_the_vocabulary_in_arrays(monkeypatch):
    """Generations change, keys clash, long pieces and texts of several passes come in between; a warm call asks for nothing."""
    r = random.Random(4)
    words = ["".join(r.choice(("on", "th", "er", "is", "é", "Sh", "'s", "3", "世")) for _ in range(r.randint(1, 6))) for _ in range(3000)]
    bits = lambda: r.choice(words) + r.choice(("", "", "", ",", ".", ".,", "\n", "..", "-", "x" * 70))
    texts = [" ".join(bits() for _ in range(r.randint(0, 60))) + r.choice(("", " ", "\n", ".")) for _ in range(500)]
    e = tokens.Encoder(room=200_000)
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [y for i in range(0, 500, 20) for y in e.encode(texts[i : i + 20])] == want and e.older is not None
    e, plain = tokens.Encoder(), [i for i, t in enumerate(texts) if "x" * 70 not in t]
    assert e.encode(texts) == want
    monkeypatch.setattr(e, "_ids", None)
    assert e.encode([texts[i] for i in plain]) == [want[i] for i in plain]
    clash = tokens.Pieces(4)
    key, check = np.repeat(np.arange(50, dtype=np.uint64), 3), np.arange(150, dtype=np.uint64)
    for part in (slice(0, 150, 2), slice(1, 150, 2)):
        clash.add(key[part], check[part], check[part].astype(np.int64) % 4, np.repeat(check[part], check[part].astype(np.int64) % 4))
    sizes, ids = clash.gather(clash.find(key, check))
    assert (sizes == np.arange(150) % 4).all() and (ids == np.repeat(np.arange(150), sizes)).all()
    assert (clash.find(key, check + np.uint64(1000)) < 0).all()


def test_token_ids_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_IDS", 300)
    df = frame(spark, ODD).repartition(3)
    tokens.write_ids(df, f"file://{tmp_path}/ids")
    got = sorted(tokens.read_ids(spark, f"file://{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([i for i, _ in ODD], key=lambda i: (i is not None, i))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    want = collections.Counter((i, v.tobytes()) for (i, _), v in zip(ODD, reference_ids([t for _, t in ODD], 2)))
    assert collections.Counter((r.doc_id, bytes(r.ids)) for r in got) == want
    assert {(r.doc_id, r.ids_crc32) for r in tokens.read_digests(spark, f"file://{tmp_path}/ids").collect()} == {(i, zlib.crc32(b)) for i, b in want}
    tokens.write_ids(empty(spark), f"file://{tmp_path}/none")
    assert tokens.read_ids(spark, f"file://{tmp_path}/none").count() == 0


# ---------------------------------------------------------------- 8 packing


def test_plan_holds_each_id_once():
    r = random.Random(5)
    for n in (0, 1, 2, 50, 900):
        lengths = np.array([r.choice([0, 1, 5, 64, 100, 512, 2000, r.randint(1, 2047)]) for _ in range(n)], np.int64)
        held = collections.defaultdict(list)
        for s in packing.plan(lengths):
            total = sum(p[2] for p in s)
            assert 0 < total <= 2048 and (total == 2048 or total & (total - 1) == 0)
            for i, a, k in s:
                held[i].append((a, k))
        for i, k in enumerate(lengths.tolist()):
            at = 0
            for a, size in sorted(held[i]):
                assert a == at and size > 0
                at += size
            assert at == k


def test_nnls_is_near_the_best_fit():
    r = np.random.default_rng(0)
    a = (r.random((20, 12)) < 0.3).astype(float)
    x = np.maximum(r.normal(3, 4, 12), 0)
    got = packing.nnls(a, a @ x, 5000)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 0.05


def test_packing_pieces(spark):
    got = packing.pack(frame(spark, ODD).repartition(2), block_ids=2000).collect()
    want = collections.Counter((i, v.tobytes()) for (i, _), v in zip(ODD, reference_ids([t for _, t in ODD], 1)))
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for rows in by.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)
    one = {i: v for (i, _), v in zip(ODD, reference_ids([t for _, t in ODD], 1)) if i != 5}
    for i, ids in one.items():
        rows = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in rows) == len(ids) == rows[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in got) == sum(len(k[1]) // 4 * n for k, n in want.items())
    assert packing.pack(empty(spark)).count() == 0 and packing.padding(packing.pack(frame(spark, ODD))).first().padding == 0


# ---------------------------------------------------------------- 3 SimHash


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_odd_rows(spark):
    got = simhash.near_duplicates(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    want = collections.Counter((i, f"{plain_fingerprint(t):016x}") for i, t in ODD)
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
    assert {r.component_id for r in got if r.doc_id in (1, 2)} == {1}
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert frame(spark, [(4, "a b c d")]).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("hot, block", [(64, 2048), (1, 4)])
def test_links_connect_what_all_pairs_connect(spark, hot, block):
    r = random.Random(7)
    seeds = [r.getrandbits(64) for _ in range(20)]
    values = list({s ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for s in seeds for _ in range(25)})
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    work = Workspace(spark, "t")
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    got = {x.node % 2**64: x.label for x in components(work, simhash.links(work, spark.createDataFrame([(signed(v),) for v in values], "fp long"), hot=hot, block=block)).collect()}
    for a in values:
        for b in values[:50]:
            assert (find(a) == find(b)) == (got.get(a, a) == got.get(b, b))


def test_links_of_a_group_grow_with_its_size_and_are_followed_once(spark):
    """A group of near copies returns links in proportion to its fingerprints; components joins an edge of it no second time."""
    r, counts = random.Random(24), []
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    for n in (40, 160):
        base = r.getrandbits(64)
        values = {base}
        while len(values) < n:
            values.add(base ^ sum(1 << k for k in r.sample(range(64), r.choice((1, 2)))))
        work = Workspace(spark, "group")
        found = work.keep(simhash.links(work, spark.createDataFrame([(signed(v),) for v in values], "fp long")), "links")
        counts.append(found.distinct().count() / n)
        got = {x.node: x.label for x in components(work, found).collect()}
        assert got == dict.fromkeys(map(signed, values), min(map(signed, values)))
        first, then = (spark.read.parquet(f"{work.path}/{x}").count() for x in ("cc-edges", "cc-edges-1"))
        assert then <= 0.2 * first
    assert max(counts) <= 16


def plans_of(spark, monkeypatch, run) -> dict[str, str]:
    """Plans of the tables that are kept while run() goes on, by name, under the broadcast threshold that Spark has by itself."""
    plans, keep = {}, Workspace.keep

    def watched(self, df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(self, df, name)

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(Workspace, "keep", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    try:
        run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    return plans


def test_no_exploded_table_of_fingerprints_is_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i % 40} of some {i % 7} words") for i in range(80)], "doc_id long, text string")
    plans = plans_of(spark, monkeypatch, lambda: simhash.near_duplicates(docs))
    assert "Generate" in plans["items"] and not [k for k in ("items", "met", "links") if "BroadcastHashJoin" in plans[k]]


def test_no_exploded_table_of_similar_texts_is_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 5, i % 5 + 30))) for i in range(40)], "doc_id long, text string")
    plans = plans_of(spark, monkeypatch, lambda: simhash.similar_groups(docs))
    assert "Generate" in plans["members"] and not [k for k in ("members", "found") if "BroadcastHashJoin" in plans[k]]


def test_components_of_chains_stars_and_scattered_labels(spark):
    r, edges = random.Random(25), [(k, k + 1) for k in range(300)]
    edges += [(9999, k) for k in range(1000, 1200)] + [(x, x) for x in (7000, 7001)]
    order = r.sample(range(2000, 2400), 400)
    edges += list(zip(order, order[1:])) + [(r.randrange(3000, 3300), r.randrange(3000, 3300)) for _ in range(200)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    rows = components(Workspace(spark, "graph"), spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(rows) == len(up) and {x.node: x.label for x in rows} == {x: root(x) for x in up}


def near_copies(seed=0, groups=30):
    r, rows = random.Random(seed), []
    vocab = [f"w{i}" for i in range(4000)]
    for _ in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(60, 400))]
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, len(base) // 60)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            rows.append(" ".join(copy))
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [4, 0])
def test_similar_texts_are_found(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (0.8, hot, 8))
    rows = near_copies()
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert pairs and sum(got[a] == got[b] for a, b in pairs) >= 0.97 * len(pairs)
    assert all(any((min(a, b), max(a, b)) in pairs for b in sets) for a in sets if got[a] != a)


@pytest.mark.parametrize("hot", [2, 0])
def test_copies_with_blocks_appended_or_replaced_are_found(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash.similar_links, "__defaults__", (0.8, hot, 8))
    r, rows = random.Random(21), []
    for g in range(120):
        n = r.randint(180, 220)
        base = [f"w{g}_{k}" for k in range(n)]
        more = [f"x{g}_{k}" for k in range(n // 5)]  # as many words as similarity 0.8 allows
        copy = base + more[: int((n - 4) / 4)] if g % 2 else base[: n - n // 10 + 2] + more[: n // 10 - 2]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    pairs = {(a, a + 1) for a in range(0, 240, 2) if len(sets[a] & sets[a + 1]) >= 0.8 * len(sets[a] | sets[a + 1])}
    got = {x.doc_id: x.component_id for x in simhash.similar_groups(frame(spark, rows)).collect()}
    assert len(pairs) > 100 and {(got[i], i) for i in got if got[i] != i} == pairs


def test_the_pipeline_drops_what_fingerprints_link_and_what_is_similar(spark, small):
    import corpus_pipeline as cp

    r, rows = random.Random(23), []
    bits = lambda a, b: (simhash.fingerprint(a.encode()) ^ simhash.fingerprint(b.encode())).bit_count()
    sets = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    like = lambda a, b: len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    while len(rows) < 6:  # three bits or fewer, yet not similar
        base = [f"w{r.randrange(10**6)}" for _ in range(300)]
        copy = [f"w{r.randrange(10**6)}" if k % 43 == 20 else w for k, w in enumerate(base)]
        texts = [" ".join(base), " ".join(copy)]
        if bits(*texts) <= 3 and like(*texts) < 0.8:
            rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    base = [f"v{k}" for k in range(300)]  # similar, yet more than three bits
    rows += [(10, " ".join(base)), (11, " ".join(base[:280] + [f"u{k}" for k in range(12)]))]
    assert bits(rows[-2][1], rows[-1][1]) > 3 and like(rows[-2][1], rows[-1][1]) >= 0.8
    rows += [(20, " ".join(f"t{k}" for k in range(300))), (None, rows[0][1]), (30, None), (31, "")]
    kept = [x.doc_id for x in cp.drop_copies(spark, frame(spark, rows), small).collect()]
    assert sorted(kept, key=lambda i: -1 if i is None else i) == [None, 0, 2, 4, 10, 20, 30]


def test_crowded_keys_lose_no_pair_close_to_the_bound(spark):
    r, sets = random.Random(22), []
    for _ in range(150):
        base = [r.getrandbits(32) for _ in range(180)]
        sets += [np.array(base, np.uint32).view(np.int32), np.array(base[:160] + [r.getrandbits(32) for _ in range(20)], np.uint32).view(np.int32)]  # 160 of 200
    ids = np.arange(len(sets))
    assert simhash.exact_forest(ids, ids, sets, 0.8) == [(k, k + 1) for k in range(0, len(sets), 2)]
    assert simhash.exact_forest(ids, ids // 2, sets, 0.8) == []


def test_one_of_each_group_stays(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "quite another text that nobody copied"), (None, "a b c d e f g h"), (7, "twice"), (7, "twice"), (8, None), (9, "")]
    kept = simhash.keep_first(frame(spark, rows))
    assert kept.columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", rows[0][1]), ("3", rows[2][1]), ("None", rows[0][1]), ("7", "twice"), ("8", None)])
    assert simhash.keep_first(empty(spark)).count() == 0


# ---------------------------------------------------------------- 6 decontamination


def plain_hits(text, items, window):
    w, hit, names = LETTERS.findall((text or "").encode().lower()), set(), set()
    for name, t in items:
        v = LETTERS.findall((t or "").encode().lower())
        k = min(window, len(v))
        grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for p in range(len(w) - k + 1):
            if k and tuple(w[p : p + k]) in grams:
                hit.update(range(p, p + k))
                names.add(str(name) if name is not None else "null")
    return len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


def test_repeated_words_cost_what_others_do():
    """Every k-gram of the text meets every place of the item; windows are looked up once."""
    for text, item in ((b"w " * 30_000, b"w " * 20_000), (b"a b " * 15_000, b"b a " * 9_000)):
        index = decontam.Index([("i", item), ("short", b"w w w"), ("none", b"x y z")], 10)
        counts, found = index.search(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        spans, items = found[0]
        assert counts.tolist() == [30_000] and decontam._merged(spans) == [{"start": 0, "stop": 30_000}] and items == ({"i", "short"} if b"w" in text else {"i"})


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 200])
def test_decontamination_matches_all_windows(spark, block_bytes):
    r = random.Random(2)
    vocab = ["a", "b", "c", "dd", "é1", "F"]
    sentence = lambda n: r.choice([" ", ", ", "\n"]).join(r.choice(vocab) for _ in range(n))
    items = [(i, sentence(n)) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 10, 11, 14, 25, 40])] + [(50, None), (51, ""), (None, sentence(12)), (7, "!!!")]
    docs = [(i, sentence(r.randint(0, 60)) + (" " + r.choice(items[8:12])[1] if i % 3 == 0 else "")) for i in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digests(decontam.shared_spans(frame(spark, docs), bench, block_bytes=block_bytes)).collect()
    want = collections.Counter((i, *plain_hits(t, items, 10)) for i, t in docs)
    assert collections.Counter(tuple(x) for x in got) == want
    assert decontam.shared_spans(empty(spark), bench).count() == 0 and decontam.clean(frame(spark, docs), bench.limit(0)).count() == len(docs)


# ---------------------------------------------------------------- 7 personal data

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def test_base_spans_match_the_patterns(spark, monkeypatch):
    r = random.Random(4)
    bits = ["a", "b.", "@", "1", "23", "255", ".", "-", " ", "+1", "(", "é", "𝄞", "\n", "%", "4111 1111 1111 1111", "..", "com", "\ue000"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.randint(0, 40)))) for i in range(1500)] + [(2000, None), (2001, "a@" + "b.c" * 3000), (2002, "1 " * 8000), (2003, "x" * 60000 + "@"), (2004, "1." * 8000), (2005, "+1" + "-" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(pii, "table", lambda *a: df)
    got = {x.doc_id: x for x in pii.op7_pii(spark, "").collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        b = {k: [(m.start(), m.end()) for m in re.finditer(p, t or "") if valid(k, m.group())] for k, p in PII.items()}
        told = ",".join(f"{k}:{s}:{e}" for k in PII for s, e in b[k])
        x = got[i]
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) == (*map(len, b.values()), hashlib.sha256(told.encode()).hexdigest()), (i, t)
        assert set(filter(None, told.split(","))) <= set(x.spans.split(","))


def test_masking_and_added_spans(spark):
    rows = [(1, 'mail to ann@x.org or call 555-123-4567, token = "68226c4d3cee7e953ef6959c77215d0c"'), (2, None), (3, "nothing"), (4, "é𝄞 ip 10.20.30.40 end")]
    got = {r.doc_id: r.text for r in pii.mask(frame(spark, rows)).collect()}
    assert got[1].startswith("mail to [EMAIL] or call [PHONE]") and "[SECRET]" in got[1] and got[2] is None and got[3] == "nothing" and got[4] == "é𝄞 ip [IP] end"
    assert pii.mask(empty(spark)).count() == 0


def test_masking_leaves_other_columns_alone_whatever_their_names(spark):
    names = ["_t", "spans", "cands", "_base", "__t", "_spans", "_Email"]
    docs = spark.createDataFrame([(1, "mail ann@x.org", *["kept"] * len(names)), (2, None, *[None] * len(names))], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = pii.mask(docs)
    assert got.columns == docs.columns and [tuple(r) for r in got.orderBy("doc_id").collect()] == [(1, "mail [EMAIL]", *["kept"] * len(names)), (2, None, *[None] * len(names))]
    found = pii.find(docs).orderBy("doc_id").collect()
    assert found[0]["_t"] == "kept" and [x.kind for x in found[0]["spans"]] == ["email"]


def test_em_finds_the_reliable_labeler():
    r, counts = random.Random(1), collections.Counter()
    for _ in range(4000):
        y = r.random() < 0.3
        counts[tuple((1 if y else -1) if r.random() < p else (-1 if y else 1) for p in (0.95, 0.85, 0.6))] += 1
    belief, share, table_ = pii.em(sorted(counts.items()))
    assert abs(share - 0.3) < 0.08 and table_[0][1][1] > 0.88 > table_[2][1][1] and belief[1, 1, 1] > 0.9 > 0.1 > belief[-1, -1, -1]


# ---------------------------------------------------------------- 10 urls


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urlgraph.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


@pytest.mark.parametrize("inline", [200, 0])
def test_rules(spark, inline, monkeypatch):
    monkeypatch.setattr(urlgraph, "INLINE_RULES", inline)
    urls = [None, "", "no", "http://", "http://A.Example.com/en/x?q#f", "https://www.example.com/en/", "http://example.com", "http://xexample.com/en/", "ftp://a.net/es/1", "http://net/fr/", "http://a.org/en/", "http://b..com/", "a://b://c/d", "http://a.net?x=/es/", "http://é.NET/fr/ü"]
    df = spark.createDataFrame([(i, u, None if i % 2 else "<a href='http://a.org/x'>", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule int")
    got = {r.page_id: r for r in urlgraph.judge(df).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule) and got[i].verdict == (verdict or got[i].verdict)
    assert urlgraph.judge(df.limit(0)).count() == 0


def test_propagation_matches_power_iteration(spark):
    r = random.Random(8)
    hosts = [f"h{i}.x{i % 4}.org" for i in range(12)]
    html = lambda: " ".join(f'<a href="//{r.choice(hosts)}/p">' for _ in range(r.randint(0, 3)))
    pages = [(i, f"http://{r.choice(hosts)}/{'bad' if i % 5 == 0 else 'ok'}/", html()) for i in range(80)]
    rules = (urlgraph.Rule("block", "org", "/bad/"), urlgraph.Rule("allow", "x1.org", "/ok/"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {x.host: (x.trust, x.distrust) for x in urlgraph.judge(df, rules).collect()}
    edges, counts = collections.Counter(), collections.Counter()
    for _, u, h in pages:
        src = u.split("/")[2]
        for dst in re.findall(r'"//([^/]+)', h):
            if dst != src:
                counts[src, dst] += 1
    for k, n in counts.items():
        edges[k] += 1 + math.log(n)
    named = {h for _, u, _ in pages for h in [u.split("/")[2]]} | {d for _, d in counts}
    for a, b in {(h, h.split(".", 1)[1]) for h in named}:
        edges[a, b] += 1
        edges[b, a] += 1
    share = collections.defaultdict(lambda: [0, 0, 0])
    for _, u, _ in pages:
        h = u.split("/")[2]
        share[h][2] += 1
        if "/bad/" in u:
            share[h][1] += 1
        elif h.endswith(".x1.org"):
            share[h][0] += 1
    for kind in (0, 1):
        seed = {h: v[kind] / v[2] for h, v in share.items() if v[kind]}
        total = sum(seed.values())
        seed = {h: v / total for h, v in seed.items()}
        ways = [(a, b, w) if kind == 0 else (b, a, w) for (a, b), w in edges.items()]
        out = collections.Counter()
        for a, _, w in ways:
            out[a] += w
        score = dict(seed)
        for _ in range(urlgraph.ROUNDS):
            new = collections.Counter({h: 0.15 * v for h, v in seed.items()})
            for a, b, w in ways:
                new[b] += 0.85 * w / out[a] * score.get(a, 0)
            score = new
        assert all(abs(score.get(h, 0) - got[h][kind]) < 1e-9 for h in got)


# ---------------------------------------------------------------- 2 toxicity


def test_toxicity_learns_planted_words(spark):
    r, vocab, bad = random.Random(6), [f"w{i}" for i in range(300)], ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = [r.choice(vocab) for _ in range(80)] + (r.choices(bad, k=r.choice([1, 1, 4, 6])) if toxic else [])
        r.shuffle(words)
        rows.append((i, " ".join(words)))
        if i < 600:
            labels.append((i, 1, int(toxic)))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(frame(spark, rows), lab)
    assert set(model.keys.tolist()) == {int(word_hash(w.encode(), LETTER_WORDS)) for w in bad}
    got = {x.doc_id: x for x in toxicity.score(frame(spark, rows + [(None, "vile"), (2000, None), (2001, "")]), model).collect()}
    assert all(got[i].rejected == (i % 6 == 0) for i in range(600, 900)) and not got[2000].rejected and not got[2001].rejected
    one, many = (model.scores(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in (b"vile", b"vile rotten nasty"))
    assert toxicity.probabilities(np.array([one, many]), model.theta).sum(axis=1).tolist() == sorted(toxicity.probabilities(np.array([one, many]), model.theta).sum(axis=1).tolist())
    kept = toxicity.keep_clean(frame(spark, rows), lab)
    assert kept.count() == 750 and kept.columns == ["doc_id", "text", "h", "id", "n"]
    assert not toxicity.score(frame(spark, ODD), toxicity.train(frame(spark, rows), lab.limit(0))).where("rejected").count()
    assert toxicity.score(empty(spark), model).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, small):
    return table(spark, small.replace("sf0.001", "sf0.01"), "documents"), table(spark, small.replace("sf0.001", "sf0.01"), "labels")


def test_toxicity_does_not_depend_on_the_layout(spark, labelled):
    docs, labels = labelled
    again = docs.union(docs.where("doc_id % 9 = 0").withColumn("text", F.concat("text", F.lit(" other text of the id"))))
    rows = [sorted(map(tuple, toxicity.score(docs, toxicity.train(again.repartition(n, "text"), labels.repartition(n))).collect())) for n in (1, 3, 16)]
    assert rows[0] == rows[1] == rows[2] and any(x[-1] for x in rows[0])


def test_toxicity_scores_as_a_plain_sum_of_weights(spark, labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist()))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    for d, text in docs.select("doc_id", "text").collect():
        s = sum(weight.get(int(word_hash(w, LETTER_WORDS)), 0.0) for w in sorted(set(LETTERS.findall((text or "").encode().lower()))))
        over = [1 - 1 / (1 + math.exp(-(t - s))) for t in model.theta]
        each = [1 - over[0], over[0] - over[1], over[1]]
        x = got[d]
        assert math.isclose(x.score, s, abs_tol=1e-9) and math.isclose(x.severity, sum(over), abs_tol=1e-9) and x.rejected == (x.p_toxic >= toxicity.REJECT)
        assert each[x.grade] >= max(each) - 1e-9


def test_toxicity_fit_is_stationary():
    """The relaxed fit's own objective can't be lowered along any weight or threshold."""
    r = np.random.default_rng(3)
    n, words = 1200, 6
    grades = r.integers(0, 3, n)
    rows, cols = np.nonzero(r.random((n, words)) < 0.15 + 0.2 * (grades[:, None] > np.arange(words) % 3))
    w, theta = toxicity.fit(rows, cols, grades, words)

    def loss(w, theta):
        s = np.bincount(rows, weights=w[cols], minlength=n)
        low = np.concatenate([[-np.inf], theta, [np.inf]])
        p = 1 / (1 + np.exp(-np.clip(low[grades + 1] - s, -700, 700))) - 1 / (1 + np.exp(-np.clip(low[grades] - s, -700, 700)))
        return -np.log(p).sum() + toxicity.RELAXED * np.abs(w).sum()

    base = loss(w, theta)
    for i in range(words):
        for step in (1e-2, -1e-2):
            if w[i]:
                moved = w.copy()
                moved[i] += step
                assert loss(moved, theta) >= base - 1e-6
    for i in (0, 1):
        for step in (1e-2, -1e-2):
            moved = theta.copy()
            moved[i] += step
            assert loss(w, moved) >= base - 1e-6


def test_ordinal_gradient_fits_ordered_grades():
    r = np.random.default_rng(0)
    n = 1500
    words = r.integers(0, 3, (n, 2))
    count = np.array([(w == 0).sum() for w in words])
    grades = np.minimum(2, count)
    rows, cols = np.repeat(np.arange(n), 2), words.ravel()
    keep = np.unique(rows * 3 + cols)
    w, theta = toxicity.fit(keep // 3, keep % 3, grades, 3)
    assert w[0] > 1 > max(w[1], w[2]) and theta[0] < theta[1]  # the others may speak against


# ---------------------------------------------------------------- 4 language model


def test_exchange_recovers_alternating_classes():
    r = np.random.default_rng(1)
    m = np.zeros((22, 22))
    for _ in range(6000):
        a, b = r.integers(0, 10), r.integers(10, 20)
        m[a, b] += 1
        m[b, r.integers(0, 10)] += 1
    of = classlm.exchange(m, classes=4)
    assert len(set(of[:10])) == len(set(of[10:20])) == 1 and of[0] != of[10] and of[20:].tolist() == [2, 3]


def test_words_beyond_the_core_are_exchanged_too(spark, monkeypatch):
    """Of two alternating sets of words the core holds a few; all others find the class of their set."""
    monkeypatch.setattr(classlm, "CORE", 6)
    r = random.Random(13)
    left, right = [f"l{i}" for i in range(25)], [f"r{i}" for i in range(25)]
    pick = lambda x: x[min(int(r.expovariate(0.12)), 24)]
    rows = [(i, " ".join(w for _ in range(30) for w in (pick(left), pick(right)))) for i in range(200)]
    model, below = classlm.train(frame(spark, rows).select("doc_id", "text"), Workspace(spark, "t"))
    of = {w: int(model.of[np.searchsorted(model.keys, word_hash(w.encode()))]) for w in left + right}
    assert not below.count() and not {of[w] for w in left} & {of[w] for w in right} and max(of.values()) < classlm.RARE


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_language_model_base_and_coverage(spark, head, monkeypatch):
    monkeypatch.setattr(classlm, "HEAD", head)
    r = random.Random(9)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    rows = [(i, " ".join(w for _ in range(40) for w in (r.choice(left), r.choice(right)))) for i in range(300)] + ODD
    got = classlm.class_model(frame(spark, rows)).collect()
    c = collections.Counter()
    for i, t in rows:
        if not classlm.is_held_out(i):
            c.update((t or "").encode().lower().split())
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        want[i, classlm.is_held_out(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    assert collections.Counter((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, round(x.base_score, 6)) for x in got) == want
    held = [x for x in got if x.held_out and x.doc_id < 300 and x.n_tokens > 50]
    assert sum(x.score for x in held) > sum(x.base_score for x in held) and all(x.score < 0 for x in got)
    assert classlm.class_model(empty(spark)).count() == 0


def test_language_model_is_a_distribution_and_scores_as_a_plain_model(spark):
    """Over all next words (the unknown as one) the probabilities after a class sum to one; a text's score is the plain product."""
    rows = [(i, "a b c d e" if i % 2 else f"c a d b b once{i}") for i in range(50)]
    work = Workspace(spark, "t")
    train = frame(spark, [x for x in rows if not classlm.is_held_out(x[0])]).select("doc_id", "text")
    model, below = classlm.train(train, work)
    counts = collections.Counter(w for i, t in rows if not classlm.is_held_out(i) for w in t.split())
    place = {w: int(np.searchsorted(model.keys, word_hash(w.encode()))) for w in counts}
    of = {w: int(model.of[place[w]]) if n > 1 else classlm.RARE for w, n in counts.items()}
    assert below.count() == sum(n == 1 for n in counts.values()) > 10
    mass = collections.Counter({classlm.RARE: 0.5})
    for w, n in counts.items():
        mass[of[w]] += n + 0.5
    emit = lambda w: (counts[w] + 0.5) / mass[of.get(w, classlm.RARE)]
    step = 10**model.step
    assert np.allclose(step.sum(axis=1), 1)
    for c in range(classlm.CLASSES):
        total = sum(step[c, of[w]] * emit(w) for w in counts) + step[c, classlm.RARE] * 0.5 / mass[classlm.RARE] + step[c, classlm.END_CLASS]
        empty = [k for k in range(classlm.RARE) if not mass[k]]
        assert abs(total + step[c, empty].sum() - 1) < 1e-9
    got = {x.doc_id: x.score for x in classlm.class_model(frame(spark, rows + [(900, "a new b")])).collect()}
    for i, t in rows + [(900, "a new b")]:
        want, before = 0.0, classlm.END_CLASS
        for w in t.split():
            c = of.get(w, classlm.RARE)
            want, before = want + math.log10(step[before, c] * emit(w)), c
        assert abs(got[i] - want - math.log10(step[before, classlm.END_CLASS])) < 1e-6


# ---------------------------------------------------------------- 9 chaining


def test_fenwick_chain_matches_quadratic_chain():
    r = random.Random(11)
    for _ in range(60):
        n = r.randint(1, 25)
        at, to = np.array([r.randint(0, 60) for _ in range(n)]), np.array([r.randint(0, 60) for _ in range(n)])
        order = sorted(range(n), key=lambda i: (at[i], -to[i]))
        best = {}
        for p, i in enumerate(order):
            best[i] = chaining.K
            for j in order[:p]:
                if at[j] < at[i] and to[j] < to[i]:
                    best[i] = max(best[i], chaining.K + best[j] - chaining.GAP_COST * (at[i] - at[j] + to[i] - to[j]))
        got = chaining.chains(at, to)
        score = lambda c: chaining.K * len(c) - chaining.GAP_COST * (at[c[-1]] - at[c[0]] + to[c[-1]] - to[c[0]])
        top = max(best.values())
        assert abs((max(map(score, got)) if got else chaining.K) - max(top, chaining.K)) < 1e-9 or not got


def test_passages_exact_fuzzy_and_shared_by_many(spark):
    r = random.Random(12)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    shared, fuzzy = words(70, "s"), words(80, "f")
    other = list(fuzzy)
    for k in range(7, 80, 16):
        other[k] = "edit"
    del other[40]
    rows = [(40 + i, " ".join(words(100, "a") + shared + words(50, "b"))) for i in range(12)]
    rows += [(20, " ".join(words(30, "c") + fuzzy + words(30, "d"))), (21, " ".join(words(90, "e") + other)), (30, " ".join(words(300, "g"))), (31, " ".join(words(20, "h") + shared[:30])), *ODD]
    got = collections.defaultdict(list)
    for x in chaining.repeated(frame(spark, rows)).collect():
        got[x.doc_id].append(x)
    for i in range(40, 52):
        (p,) = got[i][0].passages
        assert abs(p.start - 100) <= 2 and abs(p.stop - 170) <= 2 and got[i][0].shared_with in range(40, 52)
    assert abs(got[20][0].n_repeated - 80) <= 4 and abs(got[21][0].n_repeated - 79) <= 4 and got[21][0].shared_with == 20
    assert not got[30][0].n_repeated and not got[31][0].n_repeated and not got[1][0].n_words
    assert len(got[5]) == 3 and chaining.repeated(empty(spark)).count() == 0


def test_both_passages_of_a_run_are_found():
    r = random.Random(31)
    words = lambda n: np.array([r.randrange(1 << 16) for _ in range(n)], "<u2")
    first, second = words(60), words(60)
    a, b = np.concatenate([first, words(25), second]), np.concatenate([first, words(25), second])
    places = [0, 20, 50, 90, 110, 135]
    got = sorted(chaining.align(a, b, places, places))
    assert [(x[0], x[1]) for x in got] == [(0, 60), (85, 145)]


def test_a_passage_that_stands_twice_in_one_text(spark):
    r = random.Random(32)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    shared = words(70, "s")
    rows = [(1, " ".join(words(40, "a") + shared + words(90, "b") + shared + words(20, "c"))), (2, " ".join(words(30, "d") + shared + words(30, "e")))]
    got = {x.doc_id: x.passages for x in chaining.repeated(frame(spark, rows)).collect()}
    assert [(p.start, p.stop) for p in got[1]] == [(40, 110), (200, 270)] and [(p.start, p.stop) for p in got[2]] == [(30, 100)]


def test_a_passage_whose_halves_have_other_first_and_last_holders(spark):
    r = random.Random(33)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    halves = [(words(40, "a"), words(40, "b")) for _ in range(10)]
    own = lambda x: " ".join(words(60, "c") + x + words(60, "d"))
    rows = [(100 * kind + k, own(x)) for k, (a, b) in enumerate(halves) for kind, x in ((1, a), (2, b), (3, a + b), (4, a + b), (5, a), (6, b))]
    docs = frame(spark, rows).repartitionByRange(6, "doc_id")
    for x in chaining.repeated(docs).collect():
        assert [(p.start, p.stop) for p in x.passages] == ([(60, 140)] if 300 <= x.doc_id < 500 else [])


def test_a_fuzzy_passage_whose_seeds_all_have_other_holders_first_and_last(spark):
    """Two texts of three share a passage with an edit every 16 words; each part of it stands alone in others before and after."""
    r = random.Random(41)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    mine, rows = words(96, "s"), []
    other = [f"x{k}" if k % 16 == 15 else w for k, w in enumerate(mine)]
    parts = [mine[k : k + 15] for k in range(0, 96, 16)]
    for k, part in enumerate(parts):
        for first in (0, 200):
            rows.append((first + k, " ".join(words(60, "o") + part + words(60, "o"))))
    rows += [(100, " ".join(words(30, "c") + mine + words(40, "d"))), (101, " ".join(words(70, "e") + other + words(9, "f")))]
    got = {x.doc_id: x for x in chaining.repeated(frame(spark, rows).repartitionByRange(4, "doc_id")).collect()}
    a, b = got.pop(100), got.pop(101)
    assert [(p.start, p.stop) for p in a.passages] == [(30, 125)] and [(p.start, p.stop) for p in b.passages] == [(70, 165)]
    assert (a.shared_with, b.shared_with) == (101, 100) and not any(x.n_repeated for x in got.values())


def test_only_what_asks_and_others_hold_is_counted_or_met(spark):
    """Seeds that one text repeats aren't shared; pairs within found passages, and those of one text alone, name no key."""
    r = random.Random(43)
    words = lambda n: [f"a{r.randrange(10**6)}" for _ in range(n)]
    line, copy, part = words(20), words(120), words(30)
    rows = [(1, " ".join(line * 9 + words(50))), (2, " ".join(copy)), (3, " ".join(copy)), *[(k, " ".join(words(60) + part + words(60))) for k in (4, 5)]]
    work = Workspace(spark, "chaining")
    texts = work.keep(chaining.seeds(frame(spark, rows).repartitionByRange(5, "doc_id")), "texts")
    found = chaining.passages(texts, work).collect()
    names = {x.row: x.doc_id for x in texts.collect()}
    kept = lambda name: spark.read.parquet(f"{work.path}/{name}")
    assert {names[x.row] for x in found} == {2, 3} and {names[x.row] for x in kept("shared").collect()} == {2, 3, 4, 5}
    seeds = [x.pos for x in kept("shared").collect() if names[x.row] == 4]
    assert 1 < len(seeds) and 0 < kept("rest-keys").count() <= len(seeds) * (len(seeds) - 1) // 2


def test_runs_of_one_word_meet_by_their_ends(spark):
    """Texts that repeat a word have some thousand pairs of its places in common; they meet by as many as they have places."""
    r = random.Random(44)
    words = lambda n: [f"a{r.randrange(10**6)}" for _ in range(n)]
    work = Workspace(spark, "chaining")
    rows = [(k, " ".join(words(30) + ["same"] * 40 + words(30))) for k in range(6)]
    texts = work.keep(chaining.seeds(frame(spark, rows)), "texts")
    shared = texts.select(F.explode("seeds").alias("s"), "row").select("s.h", "row", "s.pos")
    rest = chaining.rest_matches(work, texts, shared, spark.createDataFrame([], chaining.PASSAGES))
    assert 0 < rest.count() <= 30 * 60
    assert spark.read.parquet(f"{work.path}/rest-keys").count() == 1
    two = [(1, " ".join(words(30) + ["same"] * 40 + ["other"] * 36 + words(30))), (2, " ".join(words(30) + ["same"] * 36 + ["other"] * 44 + words(30)))]
    assert all(x.n_repeated >= 72 for x in chaining.repeated(frame(spark, two)).collect())


def test_texts_are_judged_by_the_words_beside_two_seeds_as_they_are_aligned():
    r, n = np.random.default_rng(42), 0
    for _ in range(400):
        core, sides = int(r.integers(12, 45)), [r.integers(0, 1 << 16, 60) for _ in range(2)]
        flips = [np.where(r.random(60) < r.choice([0.1, 0.5, 1]), r.integers(0, 1 << 16, 60), s) for s in sides]
        middle = r.integers(0, 1 << 16, core)
        a, b = (np.concatenate([x[::-1], middle, y]).astype("<u4") for x, y in (sides, flips))
        found = [p for p in chaining.align(a, b, [60, 60 + core - chaining.K], [60, 60 + core - chaining.K]) if p[1] - p[0] >= chaining.LEAST_WORDS]
        beside = [np.concatenate([x[:16], y[:16]]).astype(np.uint8)[None] for x, y in (sides, flips)]
        good = bool(chaining.hopeful(*beside, np.array([core]))[0])
        assert good or not found
        n += good
    assert 50 < n < 350


def shared_windows(texts, n=chaining.LEAST_WORDS):
    """Per text the words in windows of n words that another row has too."""
    where = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            where[tuple(t[p : p + n])].add(i)
    out = [set() for _ in texts]
    for i, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            if len(where[tuple(t[p : p + n])]) > 1:
                out[i].update(range(p, p + n))
    return out


def test_a_passage_whose_parts_all_have_other_holders_first_and_last(spark):
    r = random.Random(37)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    shared, rows = words(60, "s"), []
    for k, at in enumerate((0, 5, 10, 15, 20)):
        for first in (0, 200):
            rows.append((first + k, " ".join(words(30, "o") + shared[at : at + 40] + words(30, "o"))))
    rows += [(100, " ".join(words(25, "c") + shared + words(40, "d"))), (101, " ".join(words(70, "e") + shared))]
    got = {x.doc_id: [(p.start, p.stop) for p in x.passages] for x in chaining.repeated(frame(spark, rows).repartitionByRange(4, "doc_id")).collect()}
    assert got.pop(100) == [(25, 85)] and got.pop(101) == [(70, 130)] and not any(got.values())


@pytest.mark.parametrize("size", [1 << 20, 1])
def test_no_word_of_a_shared_window_is_lost(spark, size, monkeypatch):
    """Random texts of common phrases, with a filter that thins and one that lets all pass."""
    monkeypatch.setattr(chaining, "BLOOM", size)
    monkeypatch.setattr(chaining.long_matches, "__defaults__", (size,))
    r = random.Random(38)
    phrases = [[f"w{r.randrange(400)}" for _ in range(r.choice((8, 17, 26, 33, 41)))] for _ in range(40)]
    texts = [[w for _ in range(r.randint(2, 8)) for w in r.choice(phrases)] for _ in range(160)]
    for k in range(0, 150, 10):  # parts of other texts, cut anywhere
        t = texts[r.randrange(150)]
        at = r.randrange(max(len(t) - 60, 1))
        texts[k] = texts[k][:20] + t[at : at + r.randint(45, 75)] + texts[k][20:50]
    want = shared_windows(texts)
    got = {x.doc_id: {w for p in x.passages for w in range(p.start, p.stop)} for x in chaining.repeated(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert sum(map(len, want)) > 3000 and all(want[i] <= got[i] for i in range(len(texts)))


def test_a_fuzzy_passage_far_longer_than_the_first_look(spark, monkeypatch):
    monkeypatch.setattr(chaining, "MARGIN", 60)
    r = random.Random(39)
    words = lambda n, p: [f"{p}{r.randrange(10**6)}" for _ in range(n)]
    mine = words(400, "s")
    other = [f"x{k}" if k > 90 and k % 4 == 0 else w for k, w in enumerate(mine)]  # no seed of five words after the first ninety
    rows = [(1, " ".join(words(50, "a") + mine)), (2, " ".join(words(9, "b") + other))]
    (got,) = [x.passages for x in chaining.repeated(frame(spark, rows)).collect() if x.doc_id == 1]
    assert got[0].start == 50 and got[-1].stop >= 50 + 90 and len(got) == 1
    other = [f"x{k}" if k > 30 and k % 6 == 0 else w for k, w in enumerate(mine)]
    (got,) = [x.passages for x in chaining.repeated(frame(spark, [rows[0], (2, " ".join(words(9, "b") + other))])).collect() if x.doc_id == 1]
    assert len(got) == 1 and got[0].start == 50 and got[0].stop >= 440
    a = {w: i for i, w in enumerate(dict.fromkeys(mine + other))}
    pair = [np.array([a[w] for w in x], "<u4") for x in (mine, other)]
    assert [(s, e >= 390) for s, e, *_ in chaining.align(*pair, [0, 20], [0, 20]) if e - s >= 50] == [(0, True)]


def test_a_passage_near_the_bound_is_found_in_its_length():
    """Of fuzzy passages whose whole similarity suffices all are returned with 50 words or more."""
    r, found = random.Random(40), 0
    for _ in range(300):
        n = 80
        mine = np.arange(n, dtype="<u4")
        other = mine.copy()
        edits = r.sample(range(8, n - 8), 15)
        other[edits] += 1000
        pad = lambda k: np.array([r.randrange(10**6, 10**9) for _ in range(k)], "<u4")
        got = chaining.align(np.concatenate([pad(30), mine, pad(30)]), np.concatenate([pad(30), other, pad(30)]), [30, 30 + n - 5], [30, 30 + n - 5])
        found += any(e - s >= 50 and like >= 0.8 for s, e, _, _, like in got)
        assert all(30 <= s and e <= 30 + n + 1 for s, e, *_ in got if e - s >= 50)
    assert found == 300


def test_a_word_and_a_text_longer_than_a_pass_hash_as_their_parts_say(monkeypatch):
    from flowloom.llm import common

    text = " ".join(["Some words", "x" * 5000, "of a text"] * 3).encode()
    data = np.frombuffer(text, np.uint8)
    s, e, _ = common.words_in(data, np.array([0, len(data)]), LETTER_WORDS)
    want = common.word_hashes(data, s, e, LETTER_WORDS)
    monkeypatch.setattr(common, "PASS_BYTES", 97)
    monkeypatch.setattr(common, "_POWERS", [])
    assert (common.word_hashes(data, s, e, LETTER_WORDS) == want).all()
    runs = common.run_hashes(np.arange(80, dtype="<u4"), 50, step=7)
    assert (runs == common.run_hashes(np.arange(80, dtype="<u4"), 50, step=30)).all() and len(runs) == 31
    assert common.run_hashes(np.tile(np.arange(3, dtype="<u4"), 30), 50, step=9)[::3].tolist() == [int(common.run_hashes(np.tile(np.arange(3, dtype="<u4"), 17)[:50], 50)[0])] * 14


# ---------------------------------------------------------------- 5 audio


def test_offset_votes_as_all_pairs_give_them(monkeypatch):
    r = np.random.default_rng(2)
    for pairs in (7, 1 << 18):
        monkeypatch.setattr(audio, "PAIRS", pairs)
        for _ in range(60):
            a, b = (r.integers(0, r.choice([1, 2, 30]), r.integers(1, 60)).astype(np.uint32) for _ in range(2))
            i, j = np.nonzero(a[:, None] == b[None, :])
            want = np.bincount(j - i + len(a) - 1, minlength=len(a) + len(b) - 1)
            assert audio.offset_votes(a, b).tolist() == want.tolist()
    long = np.full(60_000, 7, np.uint32)  # an hour's steady tone; a matrix of all pairs would take gigabytes
    assert audio.offset_of(long, long) == 0 and audio.offset_of(long[:100], long) == 0


def test_rates_are_brought_to_one():
    t = lambda rate: np.arange(20 * rate) / rate
    tune = lambda rate: sum(np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t(rate)) * ((t(rate) % 2.4) // 0.2 == k) for k in range(12)) * 0.5
    prints = {rate: audio.fingerprint(tune(rate), rate) for rate in (4000, 8000, 11025, 3500)}
    for rate, fp in prints.items():
        assert abs(len(fp) - len(prints[4000])) <= 1
        n, error = audio.bit_error(fp, prints[4000], audio.offset_of(fp, prints[4000]))
        assert audio.offset_of(fp, prints[4000]) == 0 and n >= 290 and error < 0.12, (rate, error)


def test_audio_aligns_shifted_and_noisy_recordings(spark):
    r = np.random.default_rng(3)
    sound = {i: audio.render(r.normal(0, 1, 40).tolist()) for i in range(30)}
    samples, rate = audio.decode_wav(sound[4])
    noisy = audio.encode_wav(samples[10 * audio.HOP :] + r.normal(0, 0.02, len(samples) - 10 * audio.HOP), rate)
    rows = [(i, bytearray(b), 1) for i, b in sound.items()] + [(100, bytearray(sound[7]), 1), (101, None, 1), (102, bytearray(b"not wav"), 1), (103, bytearray(audio.render([])), 1)]
    media = spark.createDataFrame(rows, "id long, audio binary, fp int")
    prints = audio.fingerprints(media).persist()
    assert prints.where("size(fp) = 0").count() == 3
    queries = audio.fingerprints(spark.createDataFrame([(900, bytearray(noisy)), (901, bytearray(sound[7]))], "id long, audio binary"))
    got = {x["query"]: x for x in audio.search(prints, queries).collect()}
    assert got[900]["class"] == 4 and got[900].offset == 10 and got[900].error < 0.2
    assert got[901]["class"] == 7 and got[901].copies == 2 and got[901].error == 0
    assert audio.search(prints.limit(0), queries).count() == 0


def test_audio_hot_integers_are_searched_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    start = r.normal(0, 1, 30).tolist()
    rows = [(i, bytearray(audio.render(start + r.normal(0, 1, 10).tolist()))) for i in range(25)]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, audio binary")).persist()
    want = {(x["query"], x["class"]) for x in audio.search(prints, prints.where("id % 5 = 0")).collect()}
    monkeypatch.setattr(audio, "HOT", 2)
    monkeypatch.setattr(audio, "BLOCK", 4)
    assert {(x["query"], x["class"]) for x in audio.search(prints, prints.where("id % 5 = 0")).collect()} == want and len(want) > 50


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_take_effect(spark, small):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    work, docs = Workspace(spark, "t"), table(spark, small, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = work.keep(stage(spark, docs, small), name)
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and len(now) == docs.count()
        assert name in ("pii", "toxicity") or len(now) < len(ids)
        ids = now
    found = decontam.shared_spans(docs, table(spark, small, "benchmark")).where("size(spans) > 0").count()
    assert found == 0
    pieces = cp.run(spark, small)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == ids
