"""Byte-level BPE, importance resampling and conversation repair against libraries and brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from tallyweave.llm import byte_bpe, common, dialogue, embed_dedup, importance, minhash, pieces, suffix_dedup, tokens

DOCS = "doc_id long, text string"


def mixed_texts():
    rng = random.Random(3)
    common = "theinganorst"
    texts = [None, "", " ", "\n\n x  y", "the" * 300, "a" * 1000, "ab" * 777 + "  " * 40 + "!" * 99, "日本語" * 200 + "é" * 100, "<|endoftext|>'s 'll I'd", "x" * 64 + " " + "y" * 65, "🙂🙃 é  z "]
    texts += ["".join(rng.choices("abcdefghij theningonerst éüß日本語한국 \n\t1234567890.,!?'-", k=rng.randint(0, 300))) for _ in range(150)]
    texts += ["".join(rng.choices(common, k=rng.randint(50, 2000))) for _ in range(20)] + ["".join(rng.choices("日本語한국éüßthe", k=rng.randint(50, 600))) for _ in range(20)]
    return texts


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.codec().rank, special_tokens={})


@pytest.mark.parametrize("small", [False, True])
def test_bpe_equals_library(monkeypatch, library, small):
    if small:
        monkeypatch.setattr(byte_bpe, "MATCHES", 7)
        monkeypatch.setattr(byte_bpe, "CELLS", 100)
        monkeypatch.setattr(byte_bpe, "LONG_TEXT", 50)
    texts, bpe = mixed_texts(), byte_bpe.codec()
    ids, n = bpe.encode(pa.array(texts, pa.string()))
    at = np.concatenate(([0], np.cumsum(n)))
    raw, cut = bpe.decode(ids, n)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == library.encode_ordinary(t or "")
        assert raw[cut[i] : cut[i + 1]].tobytes() == (t or "").encode()


def test_bpe_splits_every_character_as_library(library):
    bpe = byte_bpe.codec()
    some = [c for c in range(1, 0x3100) if c not in range(0xD800, 0xE000)]
    texts = ["a" + chr(c) + "b " + chr(c) + " 1" for c in some]
    ids, n = bpe.encode(pa.array(texts))
    at = np.concatenate(([0], np.cumsum(n)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == library.encode_ordinary_batch(texts)


def test_pair_table_with_collisions():
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    rank = rng.permutation(len(pairs)).astype(np.int32)
    t = byte_bpe.PairTable(pairs[:, 0], pairs[:, 1], rank)
    want = {tuple(p): r for p, r in zip(pairs.tolist(), rank.tolist(), strict=True)}
    a, b = (x.ravel() for x in np.meshgrid(np.arange(300), np.arange(300)))
    assert t(a, b).tolist() == [want.get((x, y), byte_bpe.NONE) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_bpe_tables(spark, library):
    texts = mixed_texts()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 2), (3, "same id", 3), (3, "same id", 3)]
    docs = spark.createDataFrame(rows, DOCS + ", n_tokens int").withColumn("ids", F.lit("clash"))
    want = sorted((str(i), len(x := library.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in rows)
    assert sorted((str(r.doc_id), *r[1:]) for r in byte_bpe.round_trip(docs).collect()) == want
    tokens = byte_bpe.encoded(docs)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids) for r in tokens.collect()) == sorted((str(i), len(x := library.encode_ordinary(t or "")), x) for i, t, _ in rows)
    back = byte_bpe.decoded(tokens.unionByName(spark.createDataFrame([(99999, None, None)], tokens.schema)))
    assert sorted((str(r.doc_id), bytes(r.bytes).decode()) for r in back.collect()) == sorted([*((str(i), t or "") for i, t, _ in rows), ("99999", "")])
    assert byte_bpe.round_trip(docs.where("false")).count() == 0
    with pytest.raises(ValueError, match="not in the vocabulary"):
        byte_bpe.codec().decode(np.array([10**6]), np.array([1]))


def test_crc_of_features_equals_zlib():
    rng = random.Random(1)
    texts = ["Hello World héé 12a " + "x" * 200 + " y", "", "a", "!!", "日本 b c d  c", *(" ".join("".join(rng.choices("abAÉé-3", k=rng.randint(1, 90))) for _ in range(30)) for _ in range(40))]
    raw, offs = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in texts)])
    for grams in (1, 2, 3):
        bucket, row, n = importance.feature_buckets(raw, offs, grams, 10_000)
        for i, t in enumerate(texts):
            assert (sorted(bucket[row == i]), n[i]) == (sorted(zlib.crc32(f.encode()) % 10_000 for f in features(t, grams)), len(features(t, 1)))


def features(text, grams):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + k]) for k in range(1, grams + 1) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent, least, grams, buckets, seed):
    """Brute force: doc_id, n_features, weight, score, rank; ties of equal rows don't matter."""
    count = lambda texts: np.bincount([zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, grams)], minlength=buckets)
    s, t = count(x for _, x in docs), count(target)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for i, text in docs:
        f = features(text, grams)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(features(text, 1))])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize(("percent", "least", "grams", "pivots"), [(10, 20, 1, 16), (50, 3, 2, 2), (100, 0, 3, 1), (0, 20, 1, 4)])
def test_resample_equals_brute_force(spark, monkeypatch, percent, least, grams, pivots):
    monkeypatch.setattr(importance, "PIVOTS", pivots)
    rng = random.Random(percent)
    word = lambda: "".join(rng.choices(["an", "The", "or", "É", "7"], k=rng.randint(1, 3)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "?!"), (203, "long " * 20_000), (None, docs[5][1]), docs[7], docs[7]]
    target = [docs[3][1], docs[9][1].lower(), None, ""]
    table = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash")).withColumn("k_row", F.lit(1))
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), percent, least, grams, 500, 7)
    assert [f for f, _ in got.dtypes] == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == resampled(docs, target, percent, least, grams, 500, 7)


def test_resample_empty_tables(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b c " * 10)], DOCS)
    assert importance.resample(none, one).count() == 0
    assert [r["rank"] for r in importance.resample(one, none, percent=100).collect()] == [1]


def test_kth_narrows_to_the_row(spark):
    rng = random.Random(4)
    keys = sorted({(rng.randint(0, 9), rng.randint(0, 500)) for _ in range(700)})
    rows = spark.createDataFrame(keys, "a long, b long")
    for k in (1, 2, 350, len(keys)):
        assert tuple(importance.kth(rows, ["a", "b"], k)) == keys[k - 1]
    with pytest.raises(ValueError, match="fewer rows"):
        importance.kth(rows, ["a", "b"], len(keys) + 1)


def cheapest(seq):
    """All edit sequences of rows (initial, must go, extra) tried out: the least (cost, audit)."""
    steps, found = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}, []

    def go(i, place, cost, audit, inserted):
        if cost > 2 * len(seq):  # deleting all costs as much
            return
        if i == len(seq) and place in (0, 3):
            found.append((cost, audit))
        for c in "ua" if inserted < 2 else "":
            if place in steps[c]:
                go(i, steps[c][place], cost + 5, audit + "I", inserted + 1)
        if i == len(seq):
            return
        c, gone, extra = seq[i]
        go(i + 1, place, cost + 2, audit + "D", 0)
        if not gone:
            if place in steps.get(c, {}):
                go(i + 1, steps[c][place], cost + extra, audit + "K", 0)
            for x in "ua":
                if place in steps[x]:
                    go(i + 1, steps[x][place], cost + extra + 1, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return min(found)


def report(conv, rows):
    """Brute force of a conversation's report; rows: turn, role, text."""
    after = []
    show = lambda x: " " if x is None else str(x)
    for turn, role, text in rows:
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", show(text)) if k == 2 else show(text)
        after += [(turn, "user" if k == 4 else show(role), text)] * (0 if k == 0 else 2 if k == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
    seen, seq, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in after:
        bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        seq.append((role[:1], fault in ("blank", "duplicate"), 5 * (fault == "truncated")))
    turns = [t for t, _, _ in after if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(seq, seq[1:], strict=False))
    cost, audit = cheapest(seq)
    out, at = [], iter(after)
    for letter in audit:
        row = next(at) if letter != "I" else (None, None, "")
        if letter != "D":
            turn = "user" if not out or out[-1][0][:1] in "sa" else "assistant"
            out.append((row[1] if letter == "K" else turn, row[2]))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest), [(i, *r) for i, r in enumerate(out)]


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Fine.", "Why?", "cut off", " \n", "", None, "Oh!\x0b", "é. ", "x" * 3000 + "."]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for t in range(rng.randint(1, 6))]
    rows += [(100, None, "user", "a."), (100, None, "assistant", "b."), (100, 4, "user", "c."), (101, 7, "user", "d."), (101, 7, "user", "d."), (101, -3, "assistant", "e.")]
    return rows


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_repair_equals_brute_force(spark, batch):
    rows = conversations()
    table = spark.createDataFrame(rows, CONVERSATIONS).withColumn("head", F.lit("clash")).withColumn("audit", F.lit(1))
    want = [report(c, [r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert sorted((tuple(r) for r in dialogue.repair_report(table).collect()), key=str) == sorted((w[0] for w in want), key=str)
        got = dialogue.repaired(dialogue.damaged(table)).select("conv_id", "position", "role", "text").collect()
        assert sorted(map(tuple, got), key=str) == sorted(((w[0][0], *r) for w in want for r in w[1]), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_cells_equal_brute_force():
    rng = random.Random(7)
    seqs = [[(rng.choice("suuaaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(1, 7))] for _ in range(150)]
    kinds = np.array([{"s": 0, "u": 1, "a": 2, "t": 3}[c] * 4 + f for s in seqs for c, f in s])
    for s, (cost, audit) in zip(seqs, dialogue.parsed(kinds, np.array([len(s) for s in seqs])), strict=True):
        got = min((int(cost[0, i]), audit[0, i].decode()) for i in (dialogue.NUMBER[0, q] for q in dialogue.ENDS))
        assert got == cheapest([(c, f > 1, 5 * (f == 1)) for c, f in s])


def test_repair_of_a_long_conversation_and_of_none(spark):
    n = 20_000
    long = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(1).cast("long").alias("times"))
    r = dialogue.diagnosed(long).collect()
    assert [(x.conv_id, x.cost, x.audit, x.illegal, x.gaps) for x in r] == [("c", 0, "K" * n, 0, 0)]
    same = long.withColumn("text", F.lit("same."))  # all but the first of each role are duplicates
    assert dialogue.diagnosed(same).first().audit == "KK" + "D" * (n - 2)
    assert dialogue.repair_report(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    dropped = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    row = dialogue.repair_report(spark.createDataFrame([(5, dropped, "user", "x.")], CONVERSATIONS)).first()
    assert tuple(row) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_of_any_form_keep_apart(spark):
    a, b = (thue_morse(2048, x) for x in (0, 1))
    rows = [(1, a), (2, b), (3, a), (4, f"x {a} y z w v"), (5, f"x {b} y z w v"), (6, "12345678 12345678a"), (7, "12345678 12345678b"), (8, "12345678\x00 12345678"), (9, "12345678 12345678")]
    got = {r.doc_id: r.component_id for r in minhash.near_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9}


def test_word_names_follow_the_bytes():
    rng = random.Random(2)
    some = sorted({bytes(rng.choices(b"ab\x00\xff", k=rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(4000)})
    raw, offs = np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)])
    names, per = common.word_names(raw, offs)
    assert per.tolist() == [1] * len(some) and len(set(names.tolist())) == len(some)


def test_texts_under_one_id_are_documents_of_their_own(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (3, "quite another text of some eight words"), (2, text + " more"), (3, text), (2, "alone"), (None, text)]
    got = minhash.near_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == sorted([(3, 196, 2, False), (3, 3, 3, True), (2, 197, 2, True), (3, 196, 2, False), (2, 1, 2, True), (None, 196, None, False)], key=str)


def test_a_user_may_have_any_column(spark):
    import corpus_pipeline

    rng = random.Random(6)
    words = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=120)) for _ in range(3)]
    texts = [words[0], words[0], words[1] + " " + words[2], words[2] + " end", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], f"{DOCS}, lang string, source string, n_chars long")
    more = ["NEAR_DEDUP_ROW", "near_dedup_row_", "row", "of", "_suffix_K1", "_suffix_k2", "_suffix_text", "_suffix_spans", "mark", "grp", "rep", "k1", "spans", "order", "quality_score"]
    docs = docs.withColumns({c: F.col("doc_id") * 100 + i for i, c in enumerate(more)})
    same = lambda r: [r[c] for c in more] == [r.doc_id * 100 + i for i in range(len(more))]
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert {r.doc_id for r in kept} == {0, 2, 3, 4} and all(map(same, kept))
    cut = corpus_pipeline.repeats_removed(spark, docs, "").collect()
    assert {r.doc_id for r in cut} == set(range(5)) and all(map(same, cut))
    assert suffix_dedup.removal_digests(docs).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_cosines_of_extreme_vectors(spark):
    rows = [(1, "a", [1e200, 1e200]), (2, "a", [2e200, 2.1e200]), (3, "a", [1e-300, 1e-300]), (4, "a", [1e308, -1e308]), (5, "a", [5e-324, -5e-324]), (6, "b", [1e200, 1e200])]
    got = embed_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>"))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


@pytest.mark.parametrize("stage", ["quality_filter", "near_dedup", "repeats_removed", "packed"])
def test_stages_take_an_empty_table(spark, stage):
    import corpus_pipeline

    docs = spark.createDataFrame([], DOCS + ", lang string, source string, n_chars long")
    assert getattr(corpus_pipeline, stage)(spark, docs, "/root/testdata/sf0.001").count() == 0


def _drawn(lat, text, k, draws):
    """Perturbed values, log-probabilities and pieces of many searches of one text, side by side."""
    found = pieces.Search(pieces.Laid(lat, [text] * draws), 0, draws, np.arange(draws, dtype=np.uint64), k)
    return np.stack(found.value), np.stack(found.log_p), found


@pytest.mark.parametrize("nodes", [1, 2, 16])
def test_siblings_behind_the_first_nodes_are_drawn_alike(nodes, monkeypatch):
    """The order of all segmentations follows sampling without replacement, whether siblings are drawn one node at a time or at
    once; perturbed values are those of Gumbel draws over all of them."""
    monkeypatch.setattr(pieces, "NODES", nodes)
    lat = pieces.Lattice(tokens.vocabulary_path("piece_bpe_32k.model"), 0.0002)
    draws = 6000
    ways = len(lat.sample("then", 99, np.random.default_rng(0)))
    value, log_p, _ = _drawn(lat, "then", ways, draws)
    assert np.isfinite(value).all() and (np.diff(value, axis=0) < 0).all()
    p = np.exp(log_p[:, 0])
    assert abs(p.sum() - 1) < 1e-6  # every segmentation once
    place = np.round(log_p, 9)
    assert (np.sort(place, axis=0) == np.sort(place[:, :1], axis=0)).all()
    for rank in range(3):  # values of the best, second and third against plain Gumbel draws over all paths
        plain = np.sort(log_p[:, :1] + np.random.default_rng(1).gumbel(size=(ways, 40000)), axis=0)[::-1][rank]
        for q in (0.1, 0.5, 0.9):
            assert abs(np.quantile(value[rank], q) - np.quantile(plain, q)) < 0.12
    best = np.exp(place[0])
    assert abs(best.mean() - (p * p).sum()) < 0.01


def test_improbable_siblings_are_not_lost():
    """Piece scores taken whole make most siblings less likely than doubles can tell from none; all are still found."""
    lat = pieces.Lattice(tokens.vocabulary_path("piece_bpe_32k.model"), 1.0)
    mild = pieces.Lattice(tokens.vocabulary_path("piece_bpe_32k.model"), 0.0002)
    for text in ("then", "abc de"):
        steep, flat = (len(x.sample(text, 999, np.random.default_rng(5))) for x in (lat, mild))
        assert steep == flat > 5
    long = "the other thing " * 40
    value, log_p, found = _drawn(lat, long, 4, 3)
    assert np.isfinite(value).all() and all((np.diff(value[:, i]) < 0).all() for i in range(3))
    assert len({t[: len(long)].tobytes() for t in found.taken}) == 4


def test_workers_hand_back_what_they_freed():
    """Memory below what is still held stays with the process unless it is handed back."""
    held = []

    def run(batches):
        for b in batches:
            freed = [np.ones(2000) for _ in range(8000)]  # 128 MB
            held.append(np.ones(2000))
            del freed
            yield b

    def used():
        with open("/proc/self/status") as f:
            return int(re.search(r"RssAnon:\s+(\d+)", f.read())[1]) >> 10

    before = used()
    assert len(list(common.lean(run)([1, 2]))) == 2
    assert used() < before + 64


def test_samples_of_a_slab_come_in_one_batch(spark, monkeypatch):
    """However many parts it is searched in, with the same samples."""
    docs = spark.createDataFrame([(i, "many words in small parts " * (i % 5)) for i in range(20)], "doc_id long, text string")
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["many words in small parts " * (i % 5) for i in range(20)])], ["doc_id", "text"])
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    pieces.sampled_pieces(docs, ["doc_id"])
    whole = list(runs[0](iter([batch])))
    monkeypatch.setattr(pieces, "PART_BYTES", 100)
    parts = list(runs[0](iter([batch])))
    assert len(whole) == len(parts) == 1
    rows = [sorted(x[0].to_pylist(), key=lambda r: (r["doc_id"], r["sample"])) for x in (whole, parts)]
    assert rows[0] == rows[1] and len(rows[0]) == 36


def test_embedding_rows_travel_in_floats_and_once(spark, monkeypatch):
    """Clustered vectors of 64 floats: no table holds them in doubles or twice, and every link is found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    near = centres[rng.integers(0, 40, 3000)] + 0.15 * rng.normal(size=(3000, 64))
    rows = [(i, "a", [float(x) for x in np.float32(v)]) for i, v in enumerate(near)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    staged = []
    write = embed_dedup.stage
    monkeypatch.setattr(embed_dedup, "stage", lambda d, name: staged.append((name, d)) or write(d, name))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_vectors(df).collect()}
    u = np.float32(near).astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    alike = u @ u.T >= 0.93
    np.fill_diagonal(alike, False)
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(alike.sum(1).tolist()))
    assert all(d.schema["v"].dataType.elementType.typeName() == "float" for name, d in staged if "v" in d.columns)
    assert all(not {"u", "r"} & set(d.columns) for _, d in staged)


@pytest.mark.parametrize("dims", [3, 6, 7, 40])
def test_places_lie_no_farther_apart_than_vectors(dims):
    rng = np.random.default_rng(dims)
    v = rng.normal(size=(200, dims))
    p = embed_dedup.unit(v)
    at = embed_dedup.places(p)
    real = ((p[:, None] - p[None]) ** 2).sum(-1)
    assert (((at[:, None] - at[None]) ** 2).sum(-1) <= real + 1e-12).all()
