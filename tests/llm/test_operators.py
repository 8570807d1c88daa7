"""The corpus operators against brute force, reference tokenizers and held-out labels."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import bpe, fingerprint, langid, neardup, packing, quality, queries, repeats, sample, suffix, topk, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, ids string, kept string"
LONG = "lorem ipsum dolor " * 20_000
ODD = ["", None, " ", "a", "I'll don't  x\n\n y", "Ünï çødé 中文 \U0001f600", "x" * 3000, LONG, "same text here", "same text here", "\x00\x1c\x85", "12 34, 56!", "a<|endoftext|>b", "<|endoftext|><|endoftext|> <|endof", "text|> c"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", 1, 0.5, "x", "y") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_public_encoder(spark, odd, empty):
    enc = encoding()
    for r in bpe.round_trip(odd).collect():
        assert r["ids_"] == enc.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.round_trip(empty).count() == 0
    for r, t in zip(*[d.orderBy("doc_id").collect() for d in (queries.op1_bpe(spark, SF), documents(spark))], strict=True):
        ids = enc.encode_ordinary(t.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t.text or "").encode()).hexdigest()


def test_bpe_random_texts():
    rng, enc, own = np.random.default_rng(3), encoding(), bpe.Bpe(bpe.common.workers_path("byte_bpe_50k.tiktoken"))
    alphabet = list(" '\n\t\u00a0\u3000sStmdrevl1é².,!x中\U0001f600\x1c\x85 ")
    for _ in range(300):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(data, np.array([0, len(data)]))[0].tolist() == enc.encode_ordinary(text)


def test_packing(spark, odd, empty):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    rows = queries.op8_packing(spark, SF).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for k, text in texts.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        at = 0
        for i, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            own = np.array(ids[at : at + r.length], "<u4")
            assert (r.piece, r.start, r.ids_crc32) == (i, at, zlib.crc32(own.tobytes())) and (i == 0 or r.length == 1024)
            at += r.length
        assert at == len(ids)
    for rs in by_bin.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_bin) <= -(-sum(r.length for r in rows) // 1024) * 1.03 + 1
    rows = collections.Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packing.pack_texts(odd).collect())
    want = collections.Counter()
    for r in odd.collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        head = (len(ids) - 1) % 1024 + 1
        for i, (a, b) in enumerate([(0, head), *((x, x + 1024) for x in range(head, len(ids), 1024))]):
            want[r.doc_id, i, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert rows == want
    assert packing.pack_texts(empty).count() == 0


def test_packing_over_several_partitions(spark):
    df = spark.createDataFrame([(i, "word " * (i % 400 + 1)) for i in range(600)], "doc_id bigint, text string").repartition(40)
    out = packing.pack_texts(df)
    s = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("o"), F.count("*").alias("c")).collect()
    assert all(r.n <= 1024 and r.o == r.c for r in s) and len(s) <= sum(r.n for r in s) / 1024 * 1.05 + 2


def test_best_fit_merges_only_what_fits():
    bins, offsets, loads = packing.best_fit(np.array([700, 300, 600, 400, 24, 1024]), 1024)
    assert loads.max() <= 1024 and len(loads) == 3 and loads.sum() == 3048


def _host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    given = ["http://A.Com/x", "https://www.example.com/en/1", "http://q.example.com/en/?a", "x.net/es/", None, "", "http://net/es/", "http://m.net/fr/1#t", "http://xcom/a", "http://com", "a://b://c.com/en/", "http://example.com/en", "ftp://É.org/ö?x=1&y=2"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(given)], "page_id bigint, url string, verdict string")
    for r in urls.judge(df).collect():
        host, path = _host_path(r.url)
        fits = [(rule, v) for rule, v in urls.RULES if (host == (h := rule.split("/")[0]) or host.endswith("." + h)) and path.startswith("/" + rule.split("/", 1)[1])]
        best = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[0], "mine") and r.verdict_ == (best[1] or r.verdict_) and r.verdict_ in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0
    assert queries.op3_url_filter(spark, SF).count() == 50


def test_trees_learn_a_rule():
    x = np.random.default_rng(0).random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((urls.Trees(x[:1500], y[:1500]).score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_topk(spark):
    rng = np.random.default_rng(1)
    vec = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(700)]
    vec += [(700, None), (800, [float("nan")] * 8), (900, [None] * 8), (1000, vec[5][1]), (1001, vec[5][1]), (1100, [3.0, 1.0]), (1200, [0.0] * 8)]
    df = spark.createDataFrame(vec, "vec_id bigint, embedding array<float>").repartition(5)
    got = collections.defaultdict(list)
    for r in topk.search(df, df.where("vec_id % 100 = 0"), bits=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
    ok = {i: [int(np.floor(1024 * float(np.float32(x)))) for x in v] for i, v in vec if v and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ok if i % 100 == 0):
        want = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=False)), i) for i, v in ok.items() if i != q))[:10]
        assert [(-s, i) for s, i in got[q]] == want
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_topk_of_large_components(spark):
    rng = np.random.default_rng(4)
    vec = [(i, [float(x) for x in rng.normal(0, 4e5 if i % 3 else 1e12, 64)]) for i in range(250)]
    df = spark.createDataFrame(vec, "vec_id bigint, embedding array<double>")
    want = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vec}
    small = df.where("vec_id % 3 > 0")
    got = {(r.query_id, r.rank): (r.score, r.vec_id) for r in topk.search(small, small.where("vec_id % 50 = 1"), k=4).collect()}
    for q in (i for i in want if i % 3 and i % 50 == 1):
        best = sorted((-sum(a * b for a, b in zip(want[q], v, strict=True)), i) for i, v in want.items() if i != q and i % 3)[:4]
        assert [got[q, k + 1] for k in range(4)] == [(-s, i) for s, i in best]
    with pytest.raises(Exception, match="fits no long"):
        topk.search(df, df.where("vec_id = 0"), k=4).collect()


def _sets(docs, k):
    out = {}
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        out[r.doc_id] = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


def _components(sets, percent):
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * (k := len(a & b)) >= percent * (len(a) + len(b) - k):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_neardup_equals_brute_force(spark, k, percent):
    rng = np.random.default_rng(7)
    docs = documents(spark).select("doc_id", "text").collect()
    base = [" ".join(f"w{x}" for x in rng.integers(0, 5000, n)) for n in (4, 9, 30, 60, 200, 500)]
    rows = [(r.doc_id, r.text) for r in docs]
    for t in base:  # chains of edits: members far from the first still link with their neighbours
        w = t.split()
        for _ in range(12):
            w[rng.integers(0, len(w))] = f"v{rng.integers(0, 9999)}"
            rows.append((1000 + len(rows), " ".join(w)))
    df = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, " \n ")], "doc_id bigint, text string")
    sets = _sets(df.collect(), k)
    want = _components(sets, percent)
    for r in neardup.classes(df, k=k, percent=percent).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_neardup_odd_rows(spark, odd, empty):
    assert neardup.classes(odd).count() == len(ODD) + 2
    assert neardup.classes(empty).count() == 0


def _cover(texts, length):
    count = collections.Counter(t[i : i + length] for _, t in texts for i in range(len(t) - length + 1))
    for k, t in texts:
        c = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                c[i : i + length] = True
        yield k, t, c


def test_repeats_equal_brute_force(spark, odd, empty):
    rows = {r.doc_id: r for r in queries.op7_repeats(spark, SF).collect()}
    texts = [(r.doc_id, (r.text or "").encode()) for r in documents(spark).collect()]
    for k, t, c in _cover(texts, 200):
        kept = np.frombuffer(t, np.uint8)[~c].tobytes()
        spans = int((np.diff(np.concatenate([[0], c.astype(int)])) == 1).sum())
        assert tuple(rows[k])[1:] == (len(t), int(c.sum()), spans, hashlib.sha256(kept).hexdigest())
    out = {r.doc_id: r for r in repeats.remove(odd).collect()}
    assert out[7].n_removed == len(LONG) and out[6].n_removed == 3000 and out[3].n_removed == 0 and out[1].n_bytes == 0
    assert repeats.remove(empty).count() == 0


def test_repeats_in_a_hot_key(spark):
    """One 48-byte line in many surroundings, and windows inside a long boilerplate: the key is split and nothing is lost."""
    rng = np.random.default_rng(8)
    line, plate = rng.integers(97, 123, 48).astype(np.uint8).tobytes().decode(), rng.integers(97, 123, 260).astype(np.uint8).tobytes().decode()
    around = [rng.integers(97, 123, 100).astype(np.uint8).tobytes().decode() for _ in range(400)]
    rows = [(i, around[i % 390] + line + around[(i * 7 + i % 11) % 400]) for i in range(4000)] + [(4000 + i, around[i][:60] + plate + around[i + 1][:60]) for i in range(300)]
    rows += [(5000, "z" * 900), (5001, rows[3][1]), (5001, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = collections.Counter((k, int(c.sum())) for k, _, c in _cover([(k, t.encode()) for k, t in rows], 200))
    for hot in (3000, repeats.HOT):
        assert collections.Counter((r.doc_id, r.n_removed) for r in repeats.remove(df, hot=hot).collect()) == want
    many = spark.range(100_000).selectExpr("id doc_id", f"concat(sha2(concat('a', id), 256), sha2(concat('b', id), 256), '{line}', sha2(concat('c', id), 256), sha2(concat('d', id % 99990), 256)) text")
    assert repeats.remove(many, hot=1 << 20).agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_beside_clashing_names(spark):
    names = ["__gone", "gone", "body", "text_hash", "row_hash", "n_bytes", "t", "r", "spans", "k"]
    df = spark.createDataFrame([(1, "x" * 500, *range(10)), (2, None, *range(10))], f"doc_id bigint, text string, {', '.join(f'`{n}` int' for n in names)}")
    out = {r.doc_id: r for r in repeats.remove(df).collect()}
    assert (out[1].n_bytes_, out[1].n_removed, out[2].n_bytes_) == (500, 500, 0) and [out[1][n] for n in names] == list(range(10))


@pytest.mark.parametrize("rounds", [8, 1 << 12])
def test_suffix_array_with_disk_queues(tmp_path, monkeypatch, rounds):
    monkeypatch.setattr(suffix, "ROUNDS", rounds)
    rng = np.random.default_rng(0)
    for it in range(300):
        t = rng.integers(0, rng.integers(1, 9), rng.integers(1, 80))
        t = np.tile(t[: rng.integers(1, 5)], 20) if it % 6 == 0 else t
        t = np.concatenate([t, np.full(rng.integers(1, 40), 1), t]) if it % 7 == 0 else t
        cap, full = int(rng.integers(1, 12)), bool(it % 3)
        order, value = suffix.suffix_array(t, cap, str(tmp_path) if it % 2 else None, int(rng.choice([3, 16, 40, 1000])), full)
        order, value, b = np.array(order)[::-1].tolist(), np.array(value).tolist(), t.tolist()
        want = sorted(range(len(b)), key=lambda i: b[i:])
        assert order == want if full else sorted(order) == list(range(len(b)))
        for i in range(1, len(b)):
            x, y = b[order[i - 1] :], b[order[i] :]
            k = next((j for j, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
            assert value[len(b) - i] == min(k, cap) and x[:cap] <= y[:cap]


def test_suffix_array_far_larger_than_its_queue(tmp_path):
    """3 million symbols, 20 times what the queue holds and more, within 60 MB; the recursion goes on below the first names."""
    import tracemalloc

    text = np.memmap(f"{tmp_path}/text", np.uint16, "w+", shape=(3_000_000,))
    words = np.random.default_rng(1).integers(97, 123, (3000, 6)).astype(np.uint16)
    words[:, 0] = 32
    text[:] = words[np.random.default_rng(2).integers(0, 3000, 500_000)].ravel()
    text[1_000_000:1_600_000] = 65  # a long run
    levels, init = [], suffix.Level.__init__

    def noted(self, text, *rest):
        levels.append(len(text))
        init(self, text, *rest)

    suffix.Level.__init__ = noted
    tracemalloc.start()
    try:
        order, value = suffix.suffix_array(text, 200, str(tmp_path), 1 << 17, False)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        suffix.Level.__init__ = init
    assert peak < 60e6 and len(levels) >= 3 and levels == sorted(levels, reverse=True)
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    at = np.random.default_rng(3).integers(1, len(text), 3000)
    raw = np.asarray(text).astype(">u2").tobytes()
    for a, b, v in zip(order[at - 1].tolist(), order[at].tolist(), value[at].tolist(), strict=True):
        x, y = raw[2 * a : 2 * a + 400], raw[2 * b : 2 * b + 400]
        k = next((j for j in range(0, min(len(x), len(y)), 2) if x[j : j + 2] != y[j : j + 2]), min(len(x), len(y))) // 2
        assert y <= x and v == k


def test_shards_on_disk_equal_those_in_memory():
    rng = np.random.default_rng(5)
    base = [rng.integers(97, 101, n).astype(np.uint8) for n in rng.integers(30, 300, 40)]
    contents = [np.concatenate([base[i] for i in rng.integers(0, 40, 3)]) for _ in range(60)]
    found = []
    for limit in (1 << 30, 700):
        shard = repeats.Shard(50, limit, 100)
        for i, c in enumerate(contents):
            shard.add(i // 9, i, i % 7 == 0, c)
        found.append([tuple(r.values()) for b in shard.answer() for r in b.to_pylist()])
    assert found[0] == found[1]
    want = []
    for i, (_, _, c) in enumerate(_cover([(i, c.tobytes()) for i, c in enumerate(contents)], 50)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (c | (i % 7 == 0 and len(c) >= 50)).astype(int), [0]])))
        want += [(i, int(p)) for p in edge[::2]]
    assert {(d, a) for _, d, a, _ in found[0]} >= set(want)


def test_fingerprints(spark, empty):
    docs = sorted(documents(spark).collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in queries.op10_fingerprint(spark, SF).collect()}
    better = 0
    for r, n in zip(docs, docs[1:] + docs[:1], strict=True):
        t, u, g = r.text or "", n.text or "", got[r.doc_id]
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1 and (edited != t or g.near_edited == 1)
        better += g.near_edited > g.near_next
    assert better > 0.9 * len(docs)
    same = collections.defaultdict(set)
    for r in docs:
        same[r.text].add(got[r.doc_id].fingerprint)
    assert all(len(s) == 1 for s in same.values())


def test_fingerprint_keeps_text_order(spark):
    """Selections by brute force over (hash, place), from Spark's own hash of each k-mer; no place is too far."""
    words = [f"u{i % 61}" for i in range(3000)]
    df = spark.createDataFrame([(0, " ".join(words))], "doc_id bigint, text string")
    got = fingerprint.signatures(df, F.col("text"), "f").first().f_w
    hash_ = lambda rows, kind: [r.h for r in spark.createDataFrame(rows, kind).select(F.xxhash64("*").alias("h")).collect()]
    low = lambda h, bits: (h & (1 << 64) - 1) >> (64 - bits)
    signed = lambda h: h - (1 << 33) if h >= 1 << 32 else h
    mers = hash_([(words[i], words[i + 1]) for i in range(len(words) - 1)], "a string, b string")
    # The entry keeps the hash's low 33 bits, as a signed integer.
    mers = [signed(h & (1 << 33) - 1) for h in mers]
    seen, again = collections.Counter(), []
    for i, h in enumerate(mers):
        again.append((i, h, seen[h]))
        seen[h] += 1
    later = [(i, h, o) for i, h, o in again if o]
    more = hash_([(h, o - 1) for _, h, o in later], "h bigint, o int")
    entries = [(h, i) for i, h, o in again if not o] + [(signed(m & (1 << 33) - 1), i) for (i, _, _), m in zip(later, more, strict=True)]
    want = []
    for b in range(64):
        own = sorted((h, i) for h, i in entries if (h & (1 << 33) - 1) >> 27 == b)[:2]
        if own:
            own.sort(key=lambda x: x[1])
            tuple_ = hash_([tuple(h for h, _ in own)], ", ".join(f"h{j} bigint" for j in range(len(own))))[0]
            want.append(b << 26 | low(tuple_, 26))
    assert sorted(got) == sorted(want)


def test_fingerprint_odd_rows(spark):
    odd = spark.createDataFrame([(i, t or "") for i, t in enumerate(ODD)] + [(None, "no id"), (3, "a")], "doc_id bigint, text string")
    assert fingerprint.edited_likeness(odd).count() == len(ODD) + 2
    assert fingerprint.edited_likeness(odd.limit(0)).count() == 0
    assert fingerprint.edited_likeness(odd.limit(1)).collect()[0].near_next == 1.0


def test_toxicity(spark, odd, empty):
    words = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(2)
    text = lambda bad: " ".join(list(rng.choice(words, 80)) + ([f"vequ{rng.integers(0, 9999)}x", "idiot"] if bad else []))
    docs = spark.createDataFrame([(i, text(i % 4 == 0)) for i in range(600)], "doc_id bigint, text string")
    labels = docs.select("doc_id", F.expr("cast(doc_id % 4 = 0 as int)").alias("toxic"))
    field = toxicity.fit(docs, labels)
    rows = toxicity.tag(docs, field).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in held]) > 0.97
    bad = next(r for r in rows if r.doc_id == 4)
    assert {bad.text[s.start : s.end] for s in bad.spans} == set(bad.text.split()[-2:])
    assert toxicity.tag(odd, field).count() == len(ODD) + 2 and toxicity.tag(empty, field).count() == 0
    assert toxicity.fit(empty, labels.limit(0)) is None and toxicity.tag(odd, None).agg(F.max("score_")).first()[0] == 0


def test_marginals_equal_enumeration():
    e, t, s = np.array([0.3, -1.2, 2.0, 0.1]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([0.6, 0.4])
    p, _ = toxicity.marginals(e, np.array([True, False, False, True]), t, s)
    total, one = 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        w = s[y[0]] * t[y[0], y[1]] * t[y[1], y[2]] * np.exp(np.dot(e[:3], y))
        total += w
        one += w * np.array(y)
    assert np.allclose(p[:3], one / total) and np.isclose(p[3], 0.4 * np.exp(0.1) / (0.6 + 0.4 * np.exp(0.1)))


def test_chain_gradient_equals_numeric_slope():
    rng = np.random.default_rng(3)
    e, begins, truth = rng.normal(size=7), np.array([1, 0, 0, 1, 0, 0, 0], bool), np.array([0.0, 1, 1, 0, 0, 1, 0])

    def likelihood(chain):
        t, s, total = chain[:4].reshape(2, 2), chain[4:], 0.0
        for a, b in ((0, 3), (3, 7)):
            weight = lambda y, a=a, b=b: s[int(y[0])] + sum(t[int(u), int(v)] for u, v in zip(y, y[1:], strict=False)) + float(np.dot(e[a:b], y))
            total += weight(truth[a:b]) - np.log(sum(np.exp(weight(y)) for y in np.ndindex(*[2] * (b - a))))
        return total

    chain = rng.normal(size=6)
    p, pair = toxicity.marginals(e, begins, np.exp(chain[:4]).reshape(2, 2), np.exp(chain[4:]))
    own = np.concatenate([g.ravel() for g in toxicity.chain_gradient(p, pair, truth, begins)])
    slope = [(likelihood(chain + d) - likelihood(chain - d)) / 2e-5 for d in 1e-5 * np.eye(6)]
    assert np.allclose(own, slope, atol=1e-6)


def test_quality_held_out(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op5_quality(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert quality.rank(odd, None).count() == len(ODD) + 2 and quality.rank(empty, None).count() == 0


def test_langid_held_out(spark, odd, empty):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = queries.op9_langid(spark, d).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i]["score_"] == 0 for i in (0, 1, 2, 11)) and got[5].lang_pred != "und"
    assert langid.identify(empty, None).count() == 0 and langid.fit(empty) is None


def test_langid_learns_every_language(spark):
    # 70 languages of words of their own; the last ones have the fewest documents.
    words = np.random.default_rng(4).integers(97, 123, (70, 9, 7)).astype(np.uint8)
    word = lambda i, j: words[i, j].tobytes().decode()
    rows = [(100 * i + j, " ".join(word(i, (j + k) % 9) for k in range(20)), f"l{i:02}") for i in range(70) for j in range(30 if i < 64 else 12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == [f"l{i:02}" for i in range(70)] and model.landmarks.shape[1] >= 70
    told = langid.identify(docs, model).where("lang >= 'l64'").collect()
    assert np.mean([r.lang_pred == r.lang for r in told]) > 0.97
    many = spark.range(2 * langid.LANGUAGES).selectExpr("id doc_id", "'text' text", "concat('l', id) lang")
    with pytest.raises(ValueError):
        langid.fit(many)


def test_sample_bound_leaves_threshold_and_odds(spark):
    # Six good documents to a bad one, and features that overlap: what the bound cuts moved the threshold to a half.
    rng = np.random.default_rng(6)
    bad = rng.random(12_000) < 1 / 7
    text = lambda b: " ".join(rng.choice(["word", "thing!!", "stop."], 40, p=[0.6, 0.3, 0.1] if b else [0.68, 0.22, 0.1]))
    rows = [(i, text(b), int(not b), int(b)) for i, b in enumerate(bad)]
    both = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    docs, labels = both.select("doc_id", "text"), both.drop("text")
    share = []
    for most in (900, 12_000):
        rows = quality.rank(docs, quality.fit(docs, labels, most=most)).collect()
        share.append(np.mean([r.score < 0.3 for r in rows]))
    assert max(abs(s - bad.mean()) for s in share) < 0.06, share
    _, y, weight = sample.texts(docs, labels, "toxic", 900, 5, 0)
    whole = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    assert round(weight.sum()) == len(whole) and round(weight[y == 1].sum()) == sum(bad[r.doc_id] for r in whole)
    odds = sample.logistic(np.zeros((len(y), 1)), y.astype(float), weight)[-1]
    assert abs(1 / (1 + np.exp(-odds)) - np.mean([bad[r.doc_id] for r in whole])) < 1e-6
    z = rng.random(50)
    assert np.isclose(sample.quantile(z, np.ones(50), 0.3), np.quantile(z, 0.3))


@pytest.mark.parametrize("percent", [80, 85])
def test_neardup_buckets_miss_no_pair_at_the_limit(percent):
    """Pairs just at the limit, of 10 to 500 shingles: each shares a bucket."""
    rng = np.random.default_rng(percent)
    for size in (10, 39, 41, 60, 120, 500):
        missed = 0
        for _ in range(300):
            both = -(-percent * size // 100)
            x = rng.integers(0, 2**63, size, dtype=np.uint64)
            a, b = np.sort(x), np.sort(x[:both])
            sets, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            keys, off = neardup.bucket_keys(sets, at, percent)
            missed += not set(keys[: off[1]].tolist()) & set(keys[off[1] :].tolist())
        assert missed == 0


def test_pair_slope_equals_numeric_slope():
    rng = np.random.default_rng(1)
    w, good, bad = rng.normal(size=12), *(rng.integers(0, 4, (5, 3)) + [0, 4, 8] for _ in range(2))
    likelihood = lambda w: np.mean([-np.log1p(np.exp(w[b].sum() - w[g].sum())) for g, b in zip(good, bad, strict=True)])
    slope = [(likelihood(w + d) - likelihood(w - d)) / 2e-6 for d in 1e-6 * np.eye(12)]
    assert np.allclose(quality.pair_slope(w, good, bad), slope, atol=1e-8)


def test_language_kernel_and_ridge_by_hand(spark):
    """The kernel from Python sets of hashed n-grams; the machines' outputs from the closed form on them."""
    texts = ["the cat sat on the mat", "le chat est sur la table", "der hund und die katze", "a dog and a cat", "un chien et un chat", "ein kleiner hund", "the dog barked", "la porte est verte"]
    langs = ["en", "fr", "de", "en", "fr", "de", "en", "fr"]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bits = langid.presence(data, off)
    place = lambda g: ((int.from_bytes(g.encode(), "big") * 0x9E3779B1 + (len(g) * 0x85EBCA6B & 0xFFFFFFFF)) & 0xFFFFFFFF) >> 20
    sets = [{place(t[i : i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    assert [set(np.flatnonzero(b).tolist()) for b in bits] == sets
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id bigint, text string, lang string")
    model = langid.fit(docs, folds=1, held=2)
    got = np.concatenate([model.kernel(bits)]) @ model.weights + model.offset
    # Kernel ridge on all documents as landmarks, weighted by class, the mean taken off: the same outputs.
    y = np.array([[1.0 if lang == c else -1.0 for c in model.languages] for lang in langs])
    size = np.array([langs.count(lang) for lang in langs])
    weight = 1 / size
    weight /= weight.mean()
    values, vectors = np.linalg.eigh(kernel)
    phi = kernel @ (vectors / np.sqrt(values))
    mean, goal = (phi * weight[:, None]).mean(0), (y * weight[:, None]).mean(0)
    a = (phi - mean) * weight[:, None]
    w = np.linalg.solve(a.T @ (phi - mean) + 1e-3 * len(y) * np.eye(len(y)), a.T @ (y - goal))
    assert np.allclose(got, phi @ w + goal - mean @ w, atol=1e-3)


def test_first_tree_equals_an_exhaustive_split():
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (200, 3)).astype(float), rng.integers(0, 2, 200).astype(float)
    t = urls.Trees(x, y, rounds=1, depth=1)
    p = y.mean()
    g, h = y - p, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max((gain(x[:, f] <= v) + gain(x[:, f] > v), f, v) for f in range(3) for v in range(5))
    split, cut, value = t.trees[0]
    right = x[:, split[0]] > t.edges[split[0]][cut[0]] if cut[0] < len(t.edges[split[0]]) else np.zeros(200, bool)
    assert np.isclose(gain(~right) + gain(right), best[0])
    assert np.allclose(value, [g[~right].sum() / (h[~right].sum() + 1), g[right].sum() / (h[right].sum() + 1)])


def test_equal_texts_have_equal_scores(spark, odd):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    field, ranking, model = toxicity.fit(docs, labels), quality.fit(docs, labels), langid.fit(docs)
    whole = odd.drop("score", "ids", "kept")
    for rows in (whole, whole.repartition(5)):
        for out, column in ((toxicity.tag(rows, field, spans=None), "score"), (quality.rank(rows, ranking), "score"), (langid.identify(rows, model), "score")):
            seen = collections.defaultdict(set)
            for r in out.collect():
                seen[r.text or ""].add(r[column])
            assert all(len(s) == 1 and 0 <= min(s) <= 1 for s in seen.values())


def test_neardup_compares_few_pairs_under_one_line(spark, monkeypatch):
    """A line that all short documents share, and a crowd around one long document that mostly doesn't link: pairs stay few, links stay all."""
    rng = np.random.default_rng(11)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    line, base = word(9), word(200)
    texts = [[*line, *word(4)] for _ in range(300)]
    texts += [[*t[:-1], "new"] for t in texts[:20]]
    for i in range(120):
        w = list(base)
        for j in rng.choice(200, 2 + i % 20, replace=False):
            w[j] = f"v{rng.integers(0, 10**6)}"
        texts.append(w)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    compared, confirm = [], neardup.confirm

    def counted(docs, edges, k):
        compared.append(edges.count())
        return confirm(docs, edges, k)

    monkeypatch.setattr(neardup, "confirm", counted)
    sets = _sets(df.collect(), 3)
    want = _components(sets, 85)
    assert {r.doc_id: r.component_id for r in neardup.classes(df, k=3, percent=85).collect()} == want
    assert sum(compared) < 3 * len(texts)


def test_shards_sort_only_what_may_repeat(monkeypatch):
    """Contents that share a line but no window aren't sorted, and of others no more than what may repeat; whole ones are told without."""
    rng = np.random.default_rng(13)
    some = lambda n: rng.integers(97, 123, n).astype(np.uint8)
    line, twin, alone = some(48), some(250), some(300)
    contents = [np.concatenate([some(100), line, some(100)]) for _ in range(200)] + [np.concatenate([some(40 + i), twin, some(90)]) for i in range(2)]
    sizes, sort = [], suffix.suffix_array

    def noted(text, *rest):
        sizes.append(len(text))
        return sort(text, *rest)

    monkeypatch.setattr(suffix, "suffix_array", noted)
    shard = repeats.Shard(200)
    for i, c in enumerate(contents):
        shard.add(i // 50, i, False, c)
    shard.add(9, 900, True, alone)
    found = [tuple(r.values()) for b in shard.answer() for r in b.to_pylist()]
    assert sorted(found) == [(4, 200, 40, 290), (4, 201, 41, 291), (9, 900, 0, 300)]
    assert sizes[0] == 2 * (250 + 1)  # the rest are its recursion


def test_bpe_digests_leave_the_worker_without_ids(spark, odd, empty):
    """The query's digests are made where the ids are; neither ids nor decoded bytes pass through the JVM."""
    assert queries.op1_bpe(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert "array" not in queries.op1_bpe(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([(1, "a b", 5), (2, None, 6), (3, "", None), (None, "é" * 400_000, 7)], "doc_id bigint, text string, n_tokens int")
    enc = encoding()
    for r, t in zip(bpe.digests(rows).collect(), rows.collect(), strict=True):
        ids = enc.encode_ordinary(t.text or "")
        assert (r["doc_id"], r["n_tokens"], r["n_tokens_"]) == (t.doc_id, t.n_tokens, len(ids))
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256((t.text or "").encode()).hexdigest()
    assert bpe.digests(empty).count() == 0 and bpe.digests(odd).count() == odd.count()


def test_quality_learns_from_every_labelled_document(spark):
    """Each is in a group, groups stay bounded, and the threshold is the quantile of all their scores."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    # Labels that overlap: every seventh is turned round.
    labels = labels.withColumn("quality", F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = quality.labelled(docs, labels, "quality", 5, 0)
    want = {r.doc_id for r in docs.join(sample.told(labels, "quality", 5, 0), "doc_id").collect()}
    assert {r.id for r in rows.collect()} == want
    counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    parts = quality.grouped(rows, counts, 20).groupBy("g").agg(F.count("*").alias("n"), F.collect_set("id").alias("ids"), F.min("y").alias("x"), F.max("y").alias("y")).collect()
    assert set().union(*(r.ids for r in parts)) == want and max(r.n for r in parts) < 100 and all((r.x, r.y) == (0, 1) for r in parts)
    found = quality.fit(docs, labels, most=50, pairs=2000, rounds=50)
    z = found.raw(np.array([r.x for r in rows.collect()]))
    assert abs(found.shift - np.quantile(z, counts[0] / len(z))) < 0.02 * np.ptp(z)
