"""Every operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import oracle
from tallyweave.llm import components, embed_dedup, lm_score, minhash, packing, pieces, quality, suffix_dedup, token_store, tokens, topk, warc
from tallyweave.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choices(["an", "the", "or", "ing", "st", "é"], k=rng.randint(1, 4))) for _ in range(n))


def documents(spark):
    """Copies, near copies, repeated rows, null and empty texts, shared passages, a very long text and a clashing column."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(3, 300)) for _ in range(40)]
    words = prose(rng, 400).split()
    near = [" ".join(w if rng.random() > 0.008 else "changed" for w in words) for _ in range(25)]
    texts = [*base, *near, base[0], base[0], base[3].upper(), None, "", " \n\t", "one", "two words", "two words", base[5] + " " + base[6], base[5] + " x " + base[6], "x" * 900, "ab" * 400, prose(rng, 30_000), base[1] + "日本語<|endoftext|>’s"]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, base[7], None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("component", F.lit(1)).withColumn("a", F.lit("clash"))


def shingle_set(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def component_of(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    oracle.same(spark, QUERIES[name], ORACLES[name])


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "x long, y long")).collect()}
    want = component_of(500, links)
    assert got == {i: want[i] for i in {x for p in links if p[0] != p[1] for x in p}}
    assert components.connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("small", [64, 2])
def test_minhash_equals_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)  # 2: nodes stay large to the last level and are dealt into parts
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 8000 if small == 2 else 32 << 20)
    docs = documents(spark)
    rows = [r for r in docs.collect() if r.doc_id is not None]
    sets = [shingle_set(r.text) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = component_of(len(rows), links)
    least = {r: min(rows[i].doc_id for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = sorted((r.doc_id, len(sets[i]), least[root[i]], r.doc_id == least[root[i]]) for i, r in enumerate(rows))
    got = minhash.near_documents(docs).collect()
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert [tuple(r)[2:] for r in got if r.doc_id is None] == [(None, False)]
    assert minhash.near_documents(docs.limit(0)).count() == 0


def test_near_documents_at_another_similarity(spark):
    words = [f"w{i}" for i in range(200)]
    texts, rows = {0: words}, []
    for i, changed in enumerate((3, 4, 5), 1):  # 196 shingles; each word changed far from the others costs five of them
        texts[i] = [f"x{i}" if k in [20 + 30 * c for c in range(changed)] else w for k, w in enumerate(words)]
    sets = {i: shingle_set(" ".join(t)) for i, t in texts.items()}
    similar = {i: len(sets[0] & sets[i]) / len(sets[0] | sets[i]) for i in (1, 2, 3)}
    assert similar[1] > 0.85 and 0.8 < similar[2] < 0.85 and similar[3] < 0.8
    for group, i in enumerate([1, 2, 3] * 20):
        rows += [(10 * group + j, " ".join(f"{w}g{group}" for w in texts[j]), "en", "s", 1) for j in (0, i)]
    docs = spark.createDataFrame(rows, DOCS)
    kept = {r.doc_id for r in minhash.near_documents(docs, percent=80).where("kept").collect()}
    assert kept == {i for i, *_ in rows if i % 10 in (0, 3)}
    assert {r.doc_id for r in minhash.near_documents(docs).where("kept").collect()} == {i for i, *_ in rows if i % 10 in (0, 2, 3)}
    assert minhash.trees_for(85) == 10 and minhash.trees_for(80) == 14 and 0.61 < minhash.proposed_for(85) < 0.63


def test_group_links_lose_nothing():
    rng = random.Random(3)
    pool = list(range(3000))
    for trial in range(20):
        core = rng.sample(pool, 120)
        sets = [np.array(sorted({*rng.sample(core, rng.randint(100, 120)), *rng.sample(pool, rng.randint(0, 12))}), np.uint64) for _ in range(40)]
        links = [(i, j) for i in range(40) for j in range(i) if 100 * len(set(sets[i]) & set(sets[j])) >= 85 * len(set(sets[i]) | set(sets[j]))]
        assert component_of(40, minhash._group_links(sets, None)) == component_of(40, links)
        side = np.arange(40) % 2
        across = [(i, j) for i, j in links if side[i] != side[j]]
        assert component_of(40, minhash._group_links(sets, side)) == component_of(40, across)


def test_warc_round_trip_and_merge_order(spark):
    body = "é" * 60
    rows = [(3, "http://B.org/x y", body), (1, None, body), (2, "https://www.a.org/p?q=1#f", "short"), (4, "http://a.org/z", "short"), (5, "u", None), (6, "http://b.org/", "a\r\n\r\nb" * 30)]
    history = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))).collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in history}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert got == {i: (len((t or "").encode()), sha(t), "revisit" if i == 3 else "response", 1 if i == 3 else None) for i, _, t in rows}
    keys = [(r.url_key, r.ts, r.page_id) for r in history]
    assert keys == sorted(keys)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive(empty).count() == 0


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in range(12):
        runs = [sorted([("f", str(rng.randrange(9)), "t", rng.choice([None, 1, 2])) for _ in range(rng.randrange(6))], key=warc.order) for _ in range(k)]
        assert [warc.order(x) for x in warc.LoserTree(runs)] == sorted(warc.order(x) for r in runs for x in r)


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=20)).astype("f4").tolist(), int(i % 3)) for i in range(120)]
    for i in range(120, 200):  # near copies of a few
        rows.append((i, (np.array(rows[i % 4][1]) + rng.normal(size=20) * 0.12).astype("f4").tolist(), i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]
    rows += [(300, None, 0), (350, [0.0] * 20, 0), (302, [float("nan")] * 20, 0), (303, [None] * 20, 0), (304, rows[0][1], None), (400, [1.0, 2.0], 0), (450, [1.0, 2.1], 0), (306, [], 0), (7, rows[7][1], rows[7][2]), (None, rows[0][1], 0)]
    return spark.createDataFrame(rows, VECTORS)


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [1024, 5])
def test_embedding_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    df = vectors(spark).where("NOT vec_id <=> 7")
    rows = [r for r in df.collect() if r.vec_id is not None]
    links = []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if a.label is not None and a.label == b.label and usable(a.embedding) and usable(b.embedding) and len(a.embedding) == len(b.embedding) > 0:
                x, y = np.array(a.embedding), np.array(b.embedding)
                if x.any() and y.any() and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links.append((i, j))
    n = collections.Counter(i for p in links for i in p)
    root = component_of(len(rows), links)
    least = {r: min(rows[i].vec_id for i in range(len(rows)) if root[i] == r) for r in set(root)}
    got = embed_dedup.near_vectors(df).collect()
    assert sorted(tuple(r) for r in got if r.vec_id is not None) == sorted((r.vec_id, n[i], least[root[i]], r.vec_id == least[root[i]]) for i, r in enumerate(rows))
    assert [tuple(r) for r in got if r.vec_id is None] == [(None, None, None, False)]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("head", [4096, 10])
def test_top_k_is_exact(spark, monkeypatch, head):
    monkeypatch.setattr(topk, "HEAD", head)
    monkeypatch.setattr(topk, "BLOCK", 40 if head == 10 else 8192)
    monkeypatch.setattr(topk, "CHUNK", 16 if head == 10 else 1024)
    df = vectors(spark).where("NOT vec_id <=> 7")
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float))) for r in df.collect() if r.vec_id is not None and usable(r.embedding)]
    want = []
    for q, v in rows:
        if q % 50 == 0:
            best = sorted((-int(v @ w), c) for c, w in rows if c != q and len(w) == len(v))[:5]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    assert sorted(tuple(r) for r in topk.top_k(df).collect()) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(150):
        t = bytes(rng.choices(b"ab\x00\xff" if trial % 2 else b"abcdefgh", k=rng.randrange(0, 90))) * rng.choice((1, 1, 3))
        order = suffix_dedup.suffix_array(t, 1 << 20)
        assert order.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        for k, n in enumerate(suffix_dedup.common_prefixes(t, order, 20)[1:], 1):
            a, b = t[order[k - 1] :][:20], t[order[k] :][:20]
            assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("part", [2048, 3])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 21 if part > 3 else 1 << 14)
    docs = documents(spark)
    rows = docs.collect()
    data = [(r.text or "").encode() for r in rows]
    n = suffix_dedup.LENGTH
    seen = collections.Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    want, left = [], []
    for r, d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
        want.append((r.doc_id, len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
        left.append(len(d) - int(gone.sum()))
    key = lambda x: (x[0] is None, *x)
    assert sorted((tuple(r) for r in suffix_dedup.removal_digests(docs).collect()), key=lambda x: str(x)) == sorted(want, key=lambda x: str(x))
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns
    for r, n_left in zip(sorted(kept.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0)), [x for _, x in sorted(zip(rows, left, strict=True), key=lambda p: (p[0].doc_id is None, p[0].doc_id or 0))], strict=True):
        assert n_left <= len((r.text or "").encode()) <= n_left + 64  # whole characters at the ends of spans stay
    assert suffix_dedup.removal_digests(docs.limit(0)).count() == 0


@pytest.mark.parametrize("part", [2048, 4])
def test_repeats_among_edges_copies_and_null_ids(spark, monkeypatch, part):
    monkeypatch.setattr(suffix_dedup, "PART", part)  # 4: the anchors of the shared passage are dealt again to the last halving
    rng = random.Random(9)
    shared = prose(rng, 150)
    rows = [(i, prose(rng, rng.randint(0, 60)) + rng.choice(["", ".", " a", "\n"]) + shared + rng.choice(["", ".", "é", "ab"]) + prose(rng, rng.randint(0, 60))) for i in range(60)]
    rows += [(i, "".join(rng.choices("ab", k=3)) + shared[:230]) for i in range(60, 90)]
    rows += [(7000, prose(rng, 200))] * 1000 + [(None, prose(rng, 100))] * 50 + [(None, prose(rng, 100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("k1", "_k2", "g", "s", "_hits", "start")))
    n = suffix_dedup.LENGTH
    data = [t.encode() for _, t in rows]
    seen = collections.Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))

    def cut(d):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        return len(d), int(gone.sum()), int((gone & ~np.concatenate(([False], gone[:-1]))).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()

    answers = {d: cut(d) for d in set(data)}
    want = collections.Counter((i, *answers[d]) for (i, _), d in zip(rows, data, strict=True))
    assert collections.Counter(map(tuple, suffix_dedup.removal_digests(docs).collect())) == want
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.where("k1 = 'x' AND _hits = 'x'").count() == len(rows)


def library_ids(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.vocabulary_path())
    return [np.array([*e.ids, 1], "<u4") for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_encoder_gives_the_librarys_ids():
    texts = ["don't STOP'sbar's 12.5%", "", None, "<|endoftext|> a<|b", "naïve café́ x", "\xa0a\x85b \x1cd\x0be ²³½ªµ", "日本 Ünï İstanbul", "it's!!we'll'd ... a'b'c''s", " \n ", "Ω’s “q”", "A-B_c"]
    ids, n = tokens.with_end(*tokens.encoder(tokens.vocabulary_path())(pa.array(texts)), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.tolist() for x in library_ids(texts)]


def test_token_store(spark, tmp_path):
    docs = documents(spark)
    token_store.write_tokens(docs, f"file://{tmp_path}/t")
    got = token_store.token_digests(token_store.read_tokens(spark, f"file://{tmp_path}/t")).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    at, want = 0, []
    for r, ids in zip(rows, library_ids([r.text for r in rows]), strict=True):
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    token_store.write_tokens(docs.limit(0), f"file://{tmp_path}/e")
    assert token_store.read_tokens(spark, f"file://{tmp_path}/e").count() == 0


def test_packing_places_every_id_once_without_padding(spark):
    docs = documents(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(rows, library_ids(rows.values()), strict=True))
    got = packing.pack(docs).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(piece), zlib.crc32(piece.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(ids[r.doc_id]))
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for runs, total in [(v, len(ids[k])) for k, v in by_doc.items()] + [(v, sum(n for _, n in v)) for v in by_seq.values()]:
        at = 0
        for start, n in sorted(runs):
            assert start == at
            at += n
        assert at == total
    assert set(by_doc) == set(ids)
    lengths = [sum(n for _, n in v) for v in by_seq.values()]
    assert all(n <= 2048 and n & (n - 1) == 0 for n in lengths)
    assert packing.pack(docs.limit(0)).count() == 0


def test_subset_sum_is_optimal():
    rng = random.Random(7)
    for _ in range(200):
        lengths, target = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}, rng.randint(0, 60)
        sums = {0}
        for length, n in lengths.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        taken = packing.subset_sum(lengths, target)
        assert all(n <= lengths[x] for x, n in taken.items())
        assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= target)


def test_gumbel_samples_follow_the_lattice():
    lat = pieces.Lattice(tokens.vocabulary_path("piece_bpe_32k.model"), 0.0002)

    def paths(u):
        edges = lat.unit(u)

        def go(i):
            if i == len(u):
                return [((), 0.0)]
            return [((u[i:j], *rest), x + y) for x, j in edges[i] for rest, y in go(j)]

        return dict(go(0))

    probability = {p: math.exp(x) for p, x in paths("▁then").items()}
    assert abs(sum(probability.values()) - 1) < 1e-9
    draws = 6000
    first, second = collections.Counter(), collections.Counter()
    for i in range(draws):
        found = lat.sample("then", 2, np.random.default_rng(i))
        g = [x[0] for x in found]
        names = [tuple(x[2]) for x in found]
        assert g == sorted(g, reverse=True) and len(set(names)) == len(names)
        first[names[0]] += 1
        second[names[1]] += 1
    for p, q in probability.items():
        assert abs(first[p] / draws - q) < 0.03
        after = sum(x * q / (1 - x) for o, x in probability.items() if o != p)
        assert abs(second[p] / draws - after) < 0.03
    assert len(lat.sample("a", 50, np.random.default_rng(0))) == len(paths("▁a"))


def test_long_runs_without_spaces_have_all_segmentations():
    lat = pieces.Lattice(tokens.vocabulary_path("piece_bpe_32k.model"), 0.002)
    run = "日本" * 6 + "the" + "日本" * 6  # 27 characters; the cut at 24 was behind the mark and 23 of them
    for text in (run, "a" + "q" * 22 + "the" + "q" * 20, "https://example.org/" + "x" * 30 + "/index.html"):
        (unit,) = lat.units(text)
        assert unit == pieces.SPACE + text
        mass = {len(unit): 0.0}  # forward from the end, straight from the definition
        for i in range(len(unit) - 1, -1, -1):
            ways = [lat.score[unit[i:j]] + mass[j] for j in range(i + 1, len(unit) + 1) if unit[i:j] in lat.score]
            ways += [] if unit[i] in lat.score else [lat.least + mass[i + 1]]
            mass[i] = np.logaddexp.reduce(ways)
        edges = lat.unit(unit)
        for i in range(len(unit)):
            want = {j: lat.score.get(unit[i:j], lat.least) + mass[j] - mass[i] for j in range(i + 1, len(unit) + 1) if unit[i:j] in lat.score or j == i + 1}
            assert {j for _, j in edges[i]} == set(want) and all(abs(x - want[j]) < 1e-9 for x, j in edges[i])
        for _, log_p, path in lat.sample(text, 5, np.random.default_rng(1)):
            assert "".join(path) == unit and abs(sum(lat.score.get(p, lat.least) for p in path) - mass[0] - log_p) < 1e-6
    spanning, at, lat = 0, 24, pieces.Lattice(tokens.vocabulary_path("piece_bpe_32k.model"), 0.00002)
    for i in range(300):
        ends = set(np.cumsum([len(p) for p in lat.sample("q" * 22 + "thethe", 0, np.random.default_rng(i))[0][2]]).tolist())
        spanning += at not in ends
    assert spanning > 0  # pieces lie across the 24th character
    assert lat.units("a  b " + "c" * 60) == ["▁a", "▁▁b", "▁" + "c" * 60]
    found = [lat.sample("the other thing", 30, np.random.default_rng(3), whole) for whole in (True, False)]
    assert found[0][:30] == found[1][:30] and found[0][30][0] == found[1][30][0]


def test_sampled_pieces_decode_to_their_text(spark):
    docs = documents(spark).select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    a = pieces.decoded(pieces.sampled_pieces(docs, ["doc_id"])).collect()
    b = pieces.sampled_pieces(docs.repartition(3), ["doc_id"]).collect()
    assert all(r.decoded == texts[r.doc_id] for r in a)
    assert {(r.doc_id, r["sample"]): r.ids for r in a} == {(r.doc_id, r["sample"]): r.ids for r in b}
    assert {r.doc_id for r in a} == set(texts)
    assert all(0 <= r.inclusion <= 1 for r in a)


def test_op8_reads_whole_documents(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op8_sentencepiece"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and all(r.exact for r in rows)
    assert all(sum(q.doc_id == i for q in rows) == pieces.SAMPLES for i in list(texts)[:20] if len(texts[i]) > 20)
    turns = QUERIES["op8_conversations"](spark, sf)
    assert turns.select("conv_id", "turn").distinct().count() == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn").distinct().count()


@pytest.mark.parametrize("frequent", [1 << 20, 400, 1])
def test_pseudo_likelihood(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_score, "FREQUENT", frequent)  # all words, some or none are looked up in the task
    docs = documents(spark)
    model = lm_score.fit(docs)
    assert 0 <= model.frequent.num_rows <= frequent and (frequent > 400 or model.frequent.num_rows < model.shares.count())
    assert np.allclose(np.exp(model.log_p.astype(float)).sum(2), 1, atol=1e-4)
    left, token, right, per = lm_score._tokens(pa.array(["the ing", "", "the"]), {"the": 0})
    assert per.tolist() == [2, 0, 1] and left.tolist() == [0, 1, 0] and right[1:].tolist() == [0, 0] and token[0] == token[2] == 1
    rows = docs.collect()
    counts = collections.Counter(w for r in rows for w in lm_score._words(pa.array([(r.text or "")]))[0].take(pa.array(lm_score._words(pa.array([r.text or ""]))[1])).to_pylist())
    assert model.words == sorted(counts, key=lambda w: (-counts[w], w))[: lm_score.VOCABULARY]
    known = {w: i for i, w in enumerate(model.words)}
    of = {w: int(lm_score._ids(pa.array([w]), known)[0]) for w in [*counts, "neverseen"]}
    size = collections.Counter()
    for w, n in counts.items():
        size[of[w]] += n + 1
    shares = {r.word: r.share for r in model.shares.collect()}
    assert set(shares) == set(counts) - set(model.words)
    assert all(abs(s / lm_score.UNIT - math.log((counts[w] + 1) / (size[of[w]] + 1))) < 1e-6 for w, s in shares.items())
    for c in range(lm_score.CLASSES):  # each class: its words and one unseen word
        mass = sum(math.exp(s / lm_score.UNIT) for w, s in shares.items() if of[w] == c + 1 + lm_score.VOCABULARY)
        assert abs(mass + math.exp(model.unseen[c] / lm_score.UNIT) - 1) < 1e-4

    def brute(text):
        words = lm_score._words(pa.array([text]))
        words = words[0].take(pa.array(words[1])).to_pylist()
        ids = [0, *(of[w] for w in words), 0]
        total = 0.0
        for i, w in enumerate(words):
            total += float(model.log_p[ids[i], ids[i + 2], ids[i + 1]])
            total += 0.0 if w in known else math.log((counts[w] + 1) / (size[of[w]] + 1))
        return len(words), total

    def same(got, want):
        got, want = sorted(got, key=str), sorted(want, key=str)
        assert len(got) == len(want)
        for (i, n, s), (j, (m, t)) in zip(got, want, strict=True):
            assert (i, n) == (j, m) and abs(s - t) < 1e-3 + 1e-5 * n

    same([(r.doc_id, r.n_words, r.log_likelihood) for r in model.score(docs).collect()], [(r.doc_id, brute(r.text or "")) for r in rows])
    new = spark.createDataFrame([(1, "neverseen the neverseen")], "doc_id long, text string")
    same([(r.doc_id, r.n_words, r.log_likelihood) for r in model.score(new).collect()], [(1, brute("neverseen the neverseen"))])
    counts = np.zeros((lm_score.N_TOKENS,) * 3, np.float32)
    counts[1, 2, 3], counts[4, 5, 6] = 50, 50
    fitted = np.exp(lm_score.train(counts))
    assert fitted[1, 2, 3] > 0.8 and fitted[4, 5, 6] > 0.8
    assert lm_score.fit(docs.limit(0)).score(docs).count() == docs.count()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    stats = quality.document_statistics(docs)
    scored = quality.score_documents(stats, quality.fit(stats, labels))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    all_rows = scored.collect()
    assert len(all_rows) == docs.count() and all(0 <= r.score <= 1 for r in all_rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in all_rows)
    odd = documents(spark)
    blank = quality.fit(quality.document_statistics(odd), labels.limit(0))
    assert blank.transform(odd).count() == odd.count()


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 3, 2, 2, 5]), np.ones(5)).round(6).tolist() == [1.0, 2.333333, 2.333333, 2.333333, 5.0]


def test_near_dedup_decides_by_row(spark):
    import corpus_pipeline

    rng = random.Random(8)
    a, b, c, d = (prose(rng, 300) for _ in range(4))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, c), (None, c), (3, c), (None, d), (None, d), (4, None), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (3, c), (None, d), (4, None), (4, None)], key=str)


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, step in corpus_pipeline.STAGES:
        before, kept = kept, step(spark, kept, sf)
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "minhash near-dedup":
            rows = sorted(before.collect(), key=lambda r: r.doc_id)
            sets = [shingle_set(r.text) for r in rows]
            links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
            root = component_of(len(rows), links)
            assert {r.doc_id for r in kept.collect()} == {rows[i].doc_id for i in range(len(rows)) if root[i] == i}
    assert kept.agg(F.sum("length")).first()[0] > 0


def test_sampled_pieces_of_odd_rows(spark):
    rng = random.Random(12)
    texts = ["a\n\tb", "é😀 x", "", None, " ", "  two  spaces ", "▁mark", "日本語" * 30, "x" * 3000, prose(rng, 40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[9]), (None, None), (9, texts[9]), (9, "other")]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("text", F.lit("clash")).withColumn("decoded", F.lit(1))
    keyed = df.select("id", "decoded", "t")
    a = pieces.decoded(pieces.sampled_pieces(keyed, ["id", "decoded"], "t", 3)).collect()
    by = collections.defaultdict(list)
    for r in a:
        by[r.id, r.decoded].append(r)
    for (i, text), got in ((p, [r for r in v]) for p, v in by.items()):
        assert len({(tuple(r.pieces)) for r in got}) >= 1 and all("".join(r.pieces).removeprefix(pieces.SPACE).replace(pieces.SPACE, " ") == r.decoded for r in got)
    want = collections.Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    for (i, t), n in want.items():
        got = [r for r in by[i, t]]
        assert sum(r["sample"] == 0 for r in got) == n and len(got) <= 3 * n
        if n == 1:
            assert len({tuple(r.pieces) for r in got}) == len(got) and len(got) == (1 if not t else len(got))
    again = pieces.sampled_pieces(keyed.repartition(5), ["id", "decoded"], "t", 3).collect()
    key = lambda r: (r.id is None, r.id or 0, r["sample"], str(r.pieces))
    assert [(r.id, r.ids, r.log_p, r.inclusion) for r in sorted(a, key=key)] == [(r.id, r.ids, r.log_p, r.inclusion) for r in sorted(again, key=key)]
    assert pieces.sampled_pieces(keyed.limit(0), ["id"], "t").count() == 0


def test_warc_of_odd_pages_and_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    monkeypatch.setattr(warc, "STEP", 64)
    rng = random.Random(3)
    long = prose(rng, 20_000) + "\r\n\r\nWARC/1.1\r\n" + prose(rng, 20_000)
    rows = [(i, f"http://h{i % 4}.org/{i}", rng.choice([long, "x" * 99, "y" * 100, "é" * 50, None])) for i in range(40)]
    rows += [(5, "http://h5.org", "y" * 100), (None, None, "y" * 100), (None, "u", "alone" * 30), (41, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    path = f"file://{tmp_path}/w"
    warc.write_warc(df, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    assert len(files) > 8
    by_file = {f.path: bytes(f.content) for f in files}
    lines = warc.read_index(spark, path).collect()
    assert len(lines) == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            first[t] = min(first.get(t, i), i)
    import gzip

    for r in lines:
        record = gzip.decompress(by_file[r.file])[r.offset : r.offset + r.length]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and (r.payload_digest.encode() in record)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in lines)
    want = collections.Counter()
    for i, _, t in rows:
        raw, to = (t or "").encode(), first.get(t)
        copy = to is not None and to != i and (i is not None)
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if copy else "response", to if copy else None] += 1
    assert {k: v for k, v in got.items() if k[0] is not None} == {k: v for k, v in want.items() if k[0] is not None}
    merged = [(r.url_key, r.ts, r.page_id is not None, r.page_id or 0) for r in warc.merge_index(warc.read_index(spark, path), 3).collect()]
    assert merged == sorted(merged)
    with pytest.raises(ValueError):
        list(warc.parse(by_file[lines[0].file][:-20]))


def test_a_large_page_is_read_back_whole():
    body = b"z" * 50_000_000
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(http + body) + http + body + b"\r\n\r\n"
    import gzip

    found = [(len(b), at, n) for _, b, at, n in warc.parse(gzip.compress(record, 1) + gzip.compress(record, 1))]  # two members
    assert found == [(len(http + body), 0, len(record)), (len(http + body), len(record), len(record))]


def test_token_store_reads_selectively(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = f"file://{tmp_path}/t"
    token_store.write_tokens(docs, path)
    whole = {r.doc_id: r for r in token_store.read_tokens(spark, path).collect()}
    some = token_store.read_tokens(spark, path, 50, 59)
    assert [r.doc_id for r in some.orderBy("doc_id").collect()] == list(range(50, 60))
    assert all(r == whole[r.doc_id] for r in some.collect())
    plan = some._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(doc_id,50)" in plan and "LessThanOrEqual(doc_id,59)" in plan
    small = token_store.read_tokens(spark, path, ids=False)
    assert {r.doc_id: (r.start, r.n_tokens) for r in small.collect()} == {i: (r.start, r.n_tokens) for i, r in whole.items()}
    assert "ids" not in small._jdf.queryExecution().executedPlan().toString()
    for file in glob.glob(f"{tmp_path}/t/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            group = meta.row_group(g)
            columns = {group.column(c).path_in_schema.split(".")[0]: group.column(c) for c in range(group.num_columns)}
            assert group.total_byte_size <= 40 << 20 and all(c.has_column_index and c.has_offset_index for c in columns.values())
            assert any("DICTIONARY" in e for e in columns["ids"].encodings)
            assert all("DELTA_BINARY_PACKED" in columns[c].encodings for c in ("doc_id", "shard", "first", "n_tokens"))


@pytest.mark.parametrize("small", [64, 3])
def test_minhash_of_hot_groups_loses_no_link(spark, monkeypatch, small):
    monkeypatch.setattr(minhash, "SMALL", small)  # 3: near copies stay together to the last level and meet their pivot
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 20_000 if small == 3 else 32 << 20)
    rng = random.Random(21)
    rows = []
    for group in range(3):
        words = prose(rng, 220).split()
        for i in range(60):  # a chain of edits: far ends of a group are unlike, neighbours are alike
            words = list(words)
            words[rng.randrange(len(words))] = f"w{group}x{i}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    sets = [shingle_set(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    root = component_of(len(rows), links)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    got = minhash.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {rows[i][0]: least[root[i]] for i in range(len(rows))}


def test_embedding_links_of_repeated_rows_and_other_columns(spark):
    df = vectors(spark).withColumn("node", F.lit(1)).withColumn("u", F.lit("clash"))
    rows = [r for r in df.collect() if r.vec_id is not None]
    unit = lambda v: np.array(v, float) / np.sqrt(np.dot(v, v))
    ok = [usable(r.embedding) and r.label is not None and np.array(r.embedding).any() for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i].label == rows[j].label and len(rows[i].embedding) == len(rows[j].embedding) > 0 and unit(rows[i].embedding) @ unit(rows[j].embedding) >= 0.93]
    assert sum(r.vec_id == 7 for r in rows) == 2  # one row twice: each counts the other as a link
    n = collections.Counter(i for p in links for i in p)
    root = component_of(len(rows), links)
    least = {r: min(rows[i].vec_id for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = collections.Counter((r.vec_id, n[i], least[root[i]]) for i, r in enumerate(rows))
    got = embed_dedup.near_vectors(df).where("vec_id IS NOT NULL").collect()
    assert collections.Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_top_k_of_repeated_ids(spark):
    df = vectors(spark).withColumn("norm", F.lit("clash")).withColumn("vec_id", F.when(F.col("vec_id") == 7, 50).otherwise(F.col("vec_id")))
    rows = [(r.vec_id, np.floor(256 * np.array(r.embedding, float))) for r in df.collect() if r.vec_id is not None and usable(r.embedding)]
    want = collections.defaultdict(list)
    for q, v in {(i, tuple(x)) for i, x in rows if i % 50 == 0}:
        want[q] += [(-int(np.dot(v, w)), c) for c, w in rows if c != q and len(w) == len(v)]
    want = {(q, k + 1, c, -s) for q, found in want.items() for k, (s, c) in enumerate(sorted(found)[:5])}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


def plain_statistics(text):
    """The statistics straight from their description, byte by byte and word by word."""
    import re

    raw = (text or "").encode()
    w = [x for x in re.findall(rb"[^\x20\x09-\x0D]+", raw)]
    low = [x.lower() for x in w]
    kinds = np.bincount([int(quality.CLASS_OF[c]) for c in raw], minlength=12)
    n, some = len(w), max(len(w), 1)
    sizes = [len(x) for x in w]
    mean = sum(sizes) / some
    spread = math.sqrt(max(sum(x * x for x in sizes) / some - mean**2, 0))
    return [*(kinds / max(len(raw), 1)), mean, spread, sum(a == b for a, b in zip(low, low[1:])) / some, sum(a == b for a, b in zip(low, low[2:])) / some, len(set(low)) / some, sum(x > 20 for x in sizes) / some, math.log1p(len(raw)), math.log1p(n), math.log1p(kinds[4])]


def test_quality_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(10_001, None), (10_002, ""), (None, "A line."), (10_003, "same same same\n" * 50), (10_003, "same same same\n" * 50)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    stats = quality.document_statistics(docs)
    got = quality.score_documents(stats, quality.fit(stats, labels)).collect()
    rows = docs.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5))).collect()
    x = np.array([plain_statistics(r.text) for r in rows])
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    train = np.array([r.doc_id in marks and not held(r.doc_id) for r in rows])
    fold, y = np.array([r.fold for r in rows]), np.array([marks.get(r.doc_id, 0) for r in rows], float)
    inner, outer = train & (fold < 4), train & (fold == 4)
    mean, scale = x[inner].mean(0), x[inner].std(0) + 1e-6
    rng = np.random.default_rng(quality.SEED)
    w, b = rng.normal(0, 1 / np.sqrt(quality.N_STATS), (quality.N_STATS, quality.N_FOURIER)), rng.uniform(0, 2 * np.pi, quality.N_FOURIER)
    z = np.hstack([np.sqrt(2 / quality.N_FOURIER) * np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b), np.ones((len(x), 1))])
    d = z.shape[1]
    raw = z @ np.linalg.solve(z[inner].T @ z[inner] + quality.RIDGE * inner.sum() / d * np.eye(d), z[inner].T @ y[inner])
    at = np.clip(((raw + 0.5) / 2 * quality.BINS).astype(int), 0, quality.BINS - 1)
    seen = sorted(set(at[outer]))
    pairs = [(y[outer & (at == k)].sum(), (outer & (at == k)).sum()) for k in seen]
    average = lambda i, j: sum(p for p, _ in pairs[i : j + 1]) / sum(n for _, n in pairs[i : j + 1])
    levels = [max(min(average(i, j) for j in range(k, len(pairs))) for i in range(k + 1)) for k in range(len(pairs))]
    want = 0.999 * np.interp(raw, (np.array(seen) + 0.5) / quality.BINS * 2 - 0.5, levels) + 0.001 / (1 + np.exp(-8 * (raw - 0.5)))
    key = lambda p: (p[0] is None, p[0] or 0)
    got = sorted(((r.doc_id, r.held_out, r.score, r.predicted) for r in got), key=key)
    want = sorted(((r.doc_id, r.doc_id is not None and held(r.doc_id), s) for r, s in zip(rows, want, strict=True)), key=key)
    assert [g[:2] for g in got] == [v[:2] for v in want] and len(got) == len(rows)
    assert np.allclose([g[2] for g in got], [v[2] for v in want], atol=1e-4) and all(g[3] == (g[2] >= 0.7) for g in got)


def test_quality_and_packing_stages_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9_000, "", "en", "s", 0), (9_001, docs.first().text, "en", "s", 1), (9_001, docs.first().text, "en", "s", 1)], DOCS)
    docs = docs.unionByName(odd).withColumn("quality_score", F.lit("own"))
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.collect()
    score = model.score(np.array([plain_statistics(r.text) for r in rows]))
    kept = corpus_pipeline.quality_filter(spark, docs, sf)
    assert kept.columns == docs.columns
    assert collections.Counter(map(tuple, kept.collect())) == collections.Counter(tuple(r) for r, s in zip(rows, score, strict=True) if s >= quality.ACCEPT)

    some = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in some.collect()}
    ids = dict(zip(texts, library_ids(texts.values()), strict=True))
    placed, used = {i: np.zeros(len(x), int) for i, x in ids.items()}, collections.Counter()
    for r in corpus_pipeline.packed(spark, some, sf).collect():
        placed[r.doc_id][r.start : r.start + r.length] += 1
        used[r.sequence_id] += r.length
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert all((x == 1).all() for x in placed.values()) and all(n <= 2048 for n in used.values())


def test_packing_of_repeated_and_null_ids(spark):
    docs = documents(spark)
    rows = docs.collect()
    by_id, total = collections.defaultdict(list), collections.Counter()
    for r, x in zip(rows, library_ids([r.text for r in rows]), strict=True):
        by_id[r.doc_id].append(x)
        total[r.doc_id] += len(x)
    placed, inside = collections.Counter(), collections.defaultdict(list)
    for r in packing.pack(docs).collect():
        assert any(r.doc_tokens == len(x) and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by_id[r.doc_id])
        placed[r.doc_id] += r.length
        inside[r.sequence_id].append((r.offset, r.length))
    assert placed == total and None in placed
    for runs in inside.values():
        runs.sort()
        assert [o for o, _ in runs] == [sum(n for _, n in runs[:i]) for i in range(len(runs))] and sum(n for _, n in runs) <= 2048


def test_encoder_keeps_the_words_of_the_last_batch_when_full(monkeypatch):
    """Only words that the batch before lacked are encoded again, and ids stay the library's whatever the cache holds."""
    monkeypatch.setattr(tokens, "CACHE", 6)
    enc, asked = tokens.Encoder(tokens.vocabulary_path()), []
    fresh = enc._fresh
    monkeypatch.setattr(enc, "_fresh", lambda words: asked.append(words.to_pylist()) or fresh(words))
    batches = [["one two naïve", "été 7 one"], ["one two three"], ["one two four five"], ["a b c d e f g h one"], ["h one"]]
    for texts in batches:
        ids, n = tokens.with_end(*enc(pa.array(texts)), 1)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [x.tolist() for x in library_ids(texts)]
        assert len(enc.known) <= 6
    assert asked[:3] == [["one", "two", "naïve", "été", "7"], ["three"], ["four", "five"]] and asked[4] == ["h", "one"]
