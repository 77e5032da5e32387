"""The training-data operators against plain Python on small fixtures."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelscope.llm")
from panelscope.llm import blocks, embed_dedup, exact_dedup, html_extract, mixing, near_dedup, packing, quality, substring_dedup, textscan, toxicity, url_filter  # noqa: E402
from panelscope.llm.common import Workspace  # noqa: E402
from panelscope.llm.components import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, BODY string, Key string, windows string"


def lower(t):
    return (t or "").translate({i: i + 32 for i in range(65, 91)})


def corpus(seed=5):
    """Texts with exact and near copies, shared passages, nulls, empties, a long text and repeated rows; extra columns with names the operators use."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "ÉTÉ", "日本"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    base, passage = text(60), text(30)
    out = [text(rng.randint(1, 80)) for _ in range(40)] + [None, "", "  \t ", "one two", "ONE two", "one two", text(5000), base, base.upper(), base]
    for k in range(25):
        w = base.split()
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [f"{text(10)} {passage} x\n{text(5)}" for _ in range(6)] + ["a b c\x0bd"]
    return [(i * 3, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "b", "k", "v") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), EXTRA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], EXTRA)


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def test_scan_finds_the_words():
    texts = [(t or "").encode() for _, t, *_ in corpus()]
    words = textscan.scan(texts)
    h = words.hashes()
    seen = {}
    for i, t in enumerate(texts):
        found = WORD.findall(t.decode())
        assert words.counts[i] == len(found)
        for w, x in zip(found, h[words.first[i] : words.first[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_exact_groups(docs, empty):
    rows = corpus()
    by = collections.defaultdict(list)
    for d, t, *_ in rows:
        by[lower(t)].append(d)
    want = {(d, max(by[lower(t)]), len(by[lower(t)]), d == max(by[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for d, t, *_ in rows}
    for capacity in (4, exact_dedup.CAPACITY):
        assert {tuple(r) for r in exact_dedup.exact_groups(docs, capacity=capacity).collect()} == want
    assert exact_dedup.exact_groups(empty).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)


def test_directory_splits_overfull_buckets(docs):
    _, entries, directory = exact_dedup.build_index(docs, capacity=4)
    rows = directory.groupBy("depth", "bucket").agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()
    assert all(r.n <= 4 or r.k == 1 for r in rows) and sum(r.n for r in rows) == entries.count()


def test_unlike_texts_of_one_key_are_chained(docs, monkeypatch):
    want = {tuple(r) for r in exact_dedup.exact_groups(docs).collect()}
    monkeypatch.setattr(exact_dedup, "key_of", lambda body: F.shiftleft(F.pmod(F.length(body), F.lit(7)).cast("long"), 61))
    ws, entries, directory = exact_dedup.build_index(docs, capacity=4)
    chains = exact_dedup.chains_of(ws, docs, directory).collect()
    assert max(r.chain for r in chains) > 3 and len({(r.bucket, r.key, r.chain) for r in chains}) == len(chains)
    for keys in (0, 3, exact_dedup.BROADCAST_KEYS):
        monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
        assert {tuple(r) for r in exact_dedup.exact_groups(docs, capacity=4).collect()} == want


def brute_near(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    comp = groups(len(rows), links)
    return {(rows[i][0], len(sets[i]), rows[comp[i]][0], comp[i] == i) for i in range(len(rows))}


def test_near_groups(docs, empty, monkeypatch):
    want = brute_near(corpus())
    assert {tuple(r)[:4] for r in near_dedup.near_groups(docs).collect()} == want
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    assert {tuple(r)[:4] for r in near_dedup.near_groups(docs).collect()} == want
    assert near_dedup.near_groups(empty).count() == 0
    assert near_dedup.keep_one_of_each(docs).count() == sum(k for *_, k in want)


def test_near_groups_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert {tuple(r)[:4] for r in near_dedup.near_groups(df).collect()} == {(None, 2, None, False), (1, 2, 1, True), (2, 0, 2, True)}


def test_rows_of_one_id_are_told_apart(spark):
    t, u = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(0, t, "x"), (1, t + " z", "x"), (1, u, "x"), (7, u.upper(), "y"), (None, t, "z")], "doc_id long, text string, text_key string")
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()}
    assert got == {(0, 36, 0, True), (1, 37, 0, False), (1, 36, 1, True), (7, 36, 1, False), (None, 36, None, False)}
    assert {tuple(r) for r in near_dedup.keep_one_of_each(df).collect()} == {(0, t, "x"), (1, u, "x"), (None, t, "z")}
    df = spark.createDataFrame([(1, "only here"), (1, "copy"), (5, "COPY"), (None, "copy"), (None, "alone")], "doc_id long, text string")
    assert {tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()} >= {(1, "only here"), (5, "COPY"), (None, "alone")}
    assert (1, "copy") not in {tuple(r) for r in exact_dedup.drop_exact_copies(df).collect()}


def test_hyperminhash_estimates():
    rng = np.random.default_rng(4)
    pool = textscan.mix(rng.integers(0, 1 << 62, 3000, np.uint64))
    for share in (0.3, 0.75, 0.95):
        n = 1000
        both = int(2 * n * share / (1 + share))
        a, b = pool[:n], np.concatenate((pool[:both], pool[n : 2 * n - both]))
        one, two = near_dedup.sketches([np.sort(a), np.sort(b)])
        assert abs(near_dedup.estimate((one == two).mean(), np.array(n), np.array(n)) - share) < 0.17


@pytest.mark.parametrize("size", [3, 12, 40, 128, 600])
def test_pairs_at_the_threshold_share_a_band(size):
    rng = np.random.default_rng(size)
    both, own = size, size // 3  # three quarters of the union
    sets = [np.unique(textscan.mix(rng.integers(0, 1 << 63, both + own, np.uint64))) for _ in range(300)]
    pairs = [(s, np.sort(rng.permutation(s)[:both])) for s in sets]
    a, b = near_dedup.sketches([x for x, _ in pairs]), near_dedup.sketches([y for _, y in pairs])
    bands = (a == b).reshape(len(a), -1, near_dedup.BAND_ROWS).all(axis=2)
    assert bands.any(axis=1).all()
    n, m = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    assert (near_dedup.estimate((a == b).mean(axis=1), n, m) >= near_dedup.LEAST_ESTIMATE).all()


def unlike_words():
    """Two long words of one length that have equal hashes under any polynomial with an odd base modulo 2**64."""
    parity = [bin(i).count("1") % 2 for i in range(2048)]
    return "".join("ab"[p] for p in parity), "".join("ba"[p] for p in parity)


def test_words_with_colliding_polynomials_stay_apart(spark):
    x, y = unlike_words()
    rows = [(1, f"p q {x} r s"), (2, f"p q {y} r s"), (3, f"{x} " + " ".join(f"k{i}" for i in range(12))), (4, f"{y} " + " ".join(f"k{i}" for i in range(12)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_groups(df).collect()} == {(1, 1), (2, 2), (3, 3), (4, 3)}
    assert {(r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(df).collect()} == {(1, 0), (2, 0), (3, 0), (4, 0)}


def test_links_do_not_rest_on_hashes(spark, monkeypatch):
    """With a hash that cannot tell words of one length apart, the links are still those of the words."""
    monkeypatch.setattr(textscan.Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    raw = [b"aa bb cc dd ee ff", b"aa bb cc dd ee gg", b"aa bb cc dd ee ff aa bb cc dd ee", b"aa bb", b"aa cc", b""]
    sets = near_dedup.exact_sets(raw)
    assert [len(s) - 1 for s in sets] == [2, 2, 6, 1, 1, -1]
    assert near_dedup._linked(sets[0], sets[0]) and not near_dedup._linked(sets[0], sets[1]) and not near_dedup._linked(sets[3], sets[4])


def test_siphash_reference_value():
    words = textscan.Words(np.array([*range(15), 0], np.uint8), np.array([0]), np.array([15]), np.array([0, 1]), np.array([0, 16]))
    key = tuple(int.from_bytes(bytes(range(k, k + 8)), "little") for k in (0, 8))
    assert int(words.prf(key)[0]) == 0xA129CA6149BE45E5


def test_remove_repeats(docs, empty):
    rows = corpus()
    words = [WORD.findall(t or "") for _, t, *_ in rows]
    first = {}
    for (d, *_), w in zip(rows, words, strict=True):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    want = set()
    for (d, *_), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        want.add((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    for batches in (1, 2, 6):  # six batches make the index compact its runs
        got = substring_dedup.remove_repeats(docs, batches=batches)
        assert {(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == want
        assert all(sum(s.last - s.first + 1 for s in r.removed) == r.n_removed for r in got.collect())
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_repeats_of_one_id_and_a_reopened_index(spark, tmp_path):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(20))
    mixed = f"{two} " + " ".join(one.split()[5:25])
    rows = [(1, one), (2, one), (2, mixed), (None, one), (3, None), (4, mixed)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, windows string")
    want = sorted([(1, 30, 0), (2, 30, 30), (2, 40, 20), (None, 30, 0), (3, 0, 0), (4, 40, 40)], key=str)
    for batches in (1, 3):
        got = substring_dedup.remove_repeats(df, batches=batches)
        assert sorted(((r.doc_id, r.n_words, r.n_removed) for r in got.collect()), key=str) == want
    # one session takes in documents 1 to 3, another opens the index and goes on
    root, texts = f"{tmp_path}/index", df.select("doc_id", "text")
    for low, high in ((1, 2), (2, 3), (3, 4), (4, 5)):
        index = substring_dedup.FingerprintIndex(spark, root)
        found = index.add(texts.where(f"doc_id >= {low} and doc_id < {high}"), texts.where(f"doc_id < {high}"))
        assert index.generation == low and len(index.runs["anchor"]) == [1, 2, 1, 2][low - 1]  # the third run is compacted
    again = substring_dedup.FingerprintIndex(spark, root)
    assert again.keys == index.keys and [r.doc_id for r in found.collect()] == [4]
    assert again.runs["window"][0].count() > 0


def shuffled_rows(spark, after):
    """(rows written to shuffles by stages numbered above after, the highest stage number)."""
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), None)
    stages = [stages.apply(i) for i in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in stages if x.stageId() > after), max((x.stageId() for x in stages), default=-1)


def test_history_is_merged_without_a_shuffle(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=80)) for _ in range(600)]
    texts += [f"{texts[5]} {texts[6]}", texts[7], " ".join(texts[8].split()[:40]) + " new words"]
    texts[300:303] = texts[0], f"{texts[1]} again", texts[2]  # so that runs share keys
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = substring_dedup.FingerprintIndex(spark, f"{tmp_path}/index")
        for low, high in ((0, 300), (300, 600)):
            index.add(df.where(f"doc_id >= {low} and doc_id < {high}"), df.where(f"doc_id < {high}"))
        history = sum(r.count() for r in index.runs["anchor"])
        for level, (keys, _) in substring_dedup.LEVELS.items():
            merged, want = index.merged(level), collections.Counter(tuple(r[k] for k in keys) for run in index.runs[level] for r in run.collect())
            assert sorted(tuple(r[k] for k in keys) for r in merged.collect()) == sorted(want)  # once each, though two runs hold some
            pair = index.runs[level][0].join(index.runs[level][1].withColumnsRenamed({c: f"_{c}" for c in ("low", "high", "head", "second", "first_doc")}), list(keys), "left")
            assert not re.search("Exchange|Sort ", pair._jdf.queryExecution().toString())
        index.runs, reopened = {}, substring_dedup.FingerprintIndex(spark, f"{tmp_path}/index")
        _, last = shuffled_rows(spark, -1)
        reopened.ws.drop, reopened.compact = (lambda t: None), (lambda: None)
        found = {r.doc_id: r for r in reopened.add(df.where("doc_id >= 600"), df).collect()}
        moved, _ = shuffled_rows(spark, last)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(found) == {600, 601, 602} and len(found[600].windows) == 2 * 68 and len(found[601].copies) == 1 and len(found[602].windows) == 28
    # the texts of the past are looked through for three documents; none of its prints, anchors and windows moves
    assert moved < 4 * len(texts) < history, (moved, history)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("panelscope_")]


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 24))
    v = np.concatenate((rng.normal(size=(60, 24)), np.repeat(centre, 12, axis=0) + rng.normal(scale=0.12, size=(60, 24))))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v.astype(np.float32))] + [(200, rows0 := [float(x) for x in v.astype(np.float32)[3]]), (201, None), (202, [0.0] * 24), (203, [float("nan")] * 24), (204, [None] + [1.0] * 23), (205, [1.0, 2.0]), (206, [])]
    assert rows0
    good = [(i, np.array(x)) for i, x in rows if x and len(x) == 24 and None not in x and np.isfinite(x).all() and any(x)]
    u = np.stack([x / np.linalg.norm(x) for _, x in good])
    near = u @ u.T >= 0.95
    comp = groups(len(good), [(i, j) for i in range(len(good)) for j in range(i) if near[i, j]])
    want = {(good[i][0], int(near[i].sum()) - 1, good[comp[i]][0], comp[i] == i) for i in range(len(good))} | {(i, 0, i, True) for i in range(201, 207)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for block in (embed_dedup.BLOCK, 5):
        monkeypatch.setattr(embed_dedup, "BLOCK", block)
        assert {tuple(r) for r in embed_dedup.near_vectors(df).collect()} == want
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    u, v = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, u), (2, [2 * x for x in u]), (3, v), (4, [1.0, 1.0]), (5, [2.0, 2.0]), (5, v), (6, [1.0]), (None, u), (7, [-1.0, 4.0]), (3, v)]
    df = spark.createDataFrame([(*r, "x", [0.0]) for r in rows], "vec_id long, embedding array<double>, node string, filters array<double>")
    got = sorted((tuple(r) for r in embed_dedup.near_vectors(df).collect()), key=str)
    want = [(1, 1, 1, True), (2, 1, 1, False), (3, 2, 3, True), (3, 2, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 2, 3, False), (6, 0, 6, True), (7, 0, 7, True), (None, 0, None, False)]
    assert got == sorted(want, key=str)


def test_codes_grow_where_words_may_not(monkeypatch):
    monkeypatch.setattr(embed_dedup, "MOST_WORDS", 4)
    code = embed_dedup.Code.fit(100, 16)
    assert code.words == 4 and code.codes > embed_dedup.CODES


def test_filter_recall():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(400, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    for n in (1000, 100_000):
        code = embed_dedup.Code.fit(n, 64)
        books = code.books()
        met = [bool(set(x) & set(y)) for x, y in zip(code.decode(a, books), code.decode(b, books), strict=True)]
        assert np.mean(met) > 0.99


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(Workspace(spark), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


def test_packing_round_trip(docs, empty, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in corpus()}
    for limit in (64, packing.SEQUENCE_TOKENS):
        rows = packing.pack(docs, path, limit=limit, run_tokens=3000).withColumn("crc", F.crc32("ids")).collect()
        parts, seqs = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and zlib.crc32(r.ids) == r.crc and r.doc_tokens == len(want[r.doc_id])
            parts[r.doc_id].append((r.start, ids))
            seqs[r.sequence_id].append((r.offset, r.length))
        assert {d: [i for _, ids in sorted(p) for i in ids] for d, p in parts.items()} == want
        for pieces in seqs.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= limit
    assert packing.pack(empty, path).count() == 0
    # a batch of texts may be full at the last row
    monkeypatch.setattr(packing, "BATCH_CHARS", 1)
    assert {r.doc_id for r in packing.pack(docs, path).collect()} == set(want)


def test_encoder_is_exact_on_odd_texts():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["İSTANBUL ΣΑΣ don't <|endoftext|>x été ẞ ﬁ 12ab!!'s it's", "a\u0085b \x1c c d e", "x'S 'LL ‘q’ ½ ² ª º µ Å Ⅷ é", "日本語 テスト", "", None]
    tok = Tokenizer.from_file(path)
    assert packing.WordEncoder(path).encode([]) == []
    assert [x.tolist() for x in packing.WordEncoder(path).encode(texts)] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_encoder_tells_words_of_one_hash_apart(monkeypatch):
    """Words whose hashes are equal, within a batch or in batches one after the other, still get their own ids."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    for prf in (lambda w, key: (w.end - w.start).astype(np.uint64), lambda w, key: np.zeros(len(w.start), np.uint64)):
        monkeypatch.setattr(packing.textscan.Words, "prf", prf)
        encoder = packing.WordEncoder(path)
        for texts in (["one fourth", None, ""], ["two", "fourth one"], ["six tens six", "x" * 5000 + " one"], ["y" * 5000]):
            assert [x.tolist() for x in encoder.encode(texts)] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def weigh(tokens, e):
    whole = sum(tokens)
    raw = [(t / whole) ** e for t in tokens]
    return [x / sum(raw) for x in raw]


def relative_entropy(weights):
    return -sum(w * math.log(w) for w in weights) / math.log(len(weights))


def budgets_of(spark, tokens, mixture):
    df = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    return {r.tokens: r.b for r in df.select("tokens", mixture.budget(F.col("tokens")).alias("b")).collect()}


def test_other_tokenizers_get_whole_texts(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, got = Tokenizer.from_file(path), collections.defaultdict(list)
    for r in packing.pack(docs, path).orderBy("doc_id", "start").collect():
        got[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert got == {d: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for d, t, *_ in corpus()}


def test_assignment_rule():
    """Longest first, to the cheapest sequence with room; what fits nowhere is cut."""
    rng = random.Random(3)
    sizes = [rng.randint(1, 40) for _ in range(300)] + [250, 100, 200]
    limit, rows = 100, packing.assign(np.array([*sizes]), 100)
    whole = sum(s // limit for s in sizes)
    count = -(-sum(s % limit for s in sizes) // limit)
    rest = sorted((i for i, s in enumerate(sizes) if s % limit), key=lambda i: -(sizes[i] % limit))
    cost, room, want = [0.0] * count, [limit] * count, []
    for i in rest:
        n = sizes[i] % limit
        fits = [k for k in range(count) if room[k] >= n]
        if not fits:
            continue
        k = min(fits, key=lambda k: cost[k])
        want.append((i, sizes[i] // limit * limit, n, whole + k, limit - room[k]))
        room[k] -= n
        cost[k] += packing.LINEAR * n + packing.QUADRATIC * n * n
    kept = {(r[0], r[1]) for r in want}
    assert [r for r in rows if r[1:3] != (r[1], limit) and (r[0], r[1]) in kept and r[2] == sizes[r[0]] % limit] == want
    assert sum(r[2] for r in rows) == sum(sizes) and max(r[3] for r in rows) + 1 == whole + count


def test_mixture_meets_its_targets(spark):
    tokens = [3600] + [340] * 19
    sums = spark.createDataFrame([(t,) for t in [*tokens, 0]], "tokens long")
    free = mixing.solve(sums, target_entropy=0.95, max_repeats=None)
    assert abs(relative_entropy(weigh(tokens, free.exponent)) - 0.95) < 1e-6 and free.entropy >= 0.95
    budgets = budgets_of(spark, tokens, free)
    assert budgets[3600] == pytest.approx(3600) and budgets[340] > 340
    assert [budgets[t] / free.total for t in (3600, 340)] == pytest.approx([weigh(tokens, free.exponent)[k] for k in (0, 1)])
    held = mixing.solve(sums, target_entropy=0.95, max_repeats=1.5)
    assert budgets_of(spark, tokens, held)[340] / 340 == pytest.approx(1.5, abs=1e-6) and held.exponent > free.exponent
    given = mixing.solve(sums, target_entropy=None, max_repeats=2.0, budget=10_000.0)
    assert max(b / t for t, b in budgets_of(spark, tokens, given).items()) <= 2 + 1e-6 and given.total == 10_000
    assert mixing.solve(sums.limit(0)) is None and mixing.solve(sums.where("tokens = 3600")).exponent == 1.0


def test_mix_joins_the_plan_of_many_sources(spark, monkeypatch):
    df = spark.createDataFrame([(i, "x " * (1 + i % 7), f"s{i % 40}") for i in range(400)], "doc_id long, text string, source string")
    want = sorted(map(tuple, mixing.mix(df, block_docs=4).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(df, block_docs=4).collect())) == want


def test_mix_fills_budgets(spark, docs, empty):
    rows = [(i, "x " * (1 + i % 5), "en", "big" if i % 3 else f"s{i % 4}", 1, "b", "k", "v") for i in range(900)]
    df = spark.createDataFrame(rows, EXTRA)
    out = mixing.mix(df, block_docs=16, target_entropy=0.99, max_repeats=3.0).collect()
    tokens = collections.Counter()
    for d, t, _, s, *_ in rows:
        tokens[f"={s}"] += len(t.split())
    mixture = mixing.solve(spark.createDataFrame([(t,) for t in tokens.values()], "tokens long"), 0.99, 3.0)
    budgets = budgets_of(spark, tokens.values(), mixture)
    got = collections.Counter()
    for r in out:
        got[r.mix_source] += r.mix_tokens
    assert all(-1 < got[s] - budgets[t] < 6 for s, t in tokens.items())
    assert {r.doc_id for r in out} == set(range(900))
    per = collections.Counter((r.doc_id, r.epoch) for r in out)
    assert max(per.values()) == 1
    again = mixing.mix(df, block_docs=16, target_entropy=0.99, max_repeats=3.0).collect()
    key = lambda r: (r.epoch, r.mix_source, r.block_place, r.doc_place, r.doc_id)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert {r.doc_id for r in mixing.mix(docs).collect()} == {d for d, *_ in corpus()} and mixing.mix(empty).count() == 0


def test_mix_leaves_columns_of_its_own_names_alone(spark, docs):
    names = ["epoch", "room", "n_blocks", "before", "block", "mix_tokens", "MIX_source", "doc_place", "block_place", "row", "key", "left", "range", "budget"]
    more = docs.select("doc_id", "text", "source", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names])
    out = mixing.mix(more)
    assert mixing.added(more) == {"mix_source": "_mix_source", "mix_tokens": "_mix_tokens", "epoch": "_epoch", "block": "_block", "block_place": "_block_place", "doc_place": "_doc_place"}
    assert out.columns == [*more.columns, *mixing.added(more).values()]
    rows = out.collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in names)
    plain = mixing.mix(docs)
    assert sorted((r.doc_id, r._epoch, r._block, r._block_place) for r in rows) == sorted((r.doc_id, r.epoch, r.block, r.block_place) for r in plain.collect())


def test_url_lists_as_of_fetch(spark):
    ts = "timestamp_ntz"
    entries = spark.sql(f"select * from values ('bad', 'domain', 'x.org', {ts}'2024-01-05', 'add'), ('bad', 'domain', 'x.org', {ts}'2024-02-01', 'remove'), ('bad', 'domain', 'x.org', {ts}'2024-02-01', 'add'), ('bad', 'prefix', 'y.org/a', {ts}'2024-01-01', 'add'), ('bad', 'prefix', 'y.org/a', {ts}'2024-03-01', 'remove'), ('allow', 'domain', 'ok.x.org', {ts}'2024-01-01', 'add'), (null, 'domain', 'z.org', {ts}'2024-01-01', 'add') as t(list_name, kind, pattern, event_at, action)")
    captures = spark.sql(f"select * from values (1, 'http://WWW.x.org:80/q?1', {ts}'2024-01-04'), (2, 'http://www.x.org/', {ts}'2024-01-05'), (3, 'https://ok.x.org/', {ts}'2024-02-01'), (4, 'http://y.org/a/b', {ts}'2024-02-29'), (5, 'http://y.org/ab', {ts}'2024-02-29'), (6, 'http://y.org/a#t', {ts}'2024-03-01'), (7, null, {ts}'2024-03-01'), (8, 'not a url', {ts}'2024-03-01'), (9, 'http://z.org', null), (10, 'http://xx.org/', {ts}'2024-01-06') as t(page_id, url, fetched_at)")
    got = {r.page_id: (r.n_active, r.lists, r.verdict) for r in url_filter.match(captures, entries).collect()}
    none = (0, "", "allow")
    assert got == {1: none, 2: (1, "bad", "block"), 3: (2, "allow,bad", "allow"), 4: (1, "bad", "block"), 5: none, 6: none, 7: none, 8: none, 9: none, 10: none}
    assert url_filter.match(captures.limit(0), entries).count() == 0


def test_url_lists_that_come_and_go(spark):
    """Entries that toggle every two days, repeated captures, extra columns and a long URL, against a plain search."""
    import datetime as dt

    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    events = [(name, "domain", "t.org", day(2 * k + shift), "add" if k % 2 == 0 else "remove") for name, shift in (("bad", 0), ("worse", 1)) for k in range(120)]
    entries = spark.createDataFrame(events, "list_name string, kind string, pattern string, event_at timestamp_ntz, action string")
    long = "http://a.t.org/" + "x/" * 300
    rows = [(i, "http://t.org/q" if i % 2 else long, day(i, 5), "k") for i in range(-3, 260, 4)]
    rows += rows[:2]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp_ntz, bucket string")
    want = []
    for i, _, at, _ in rows:
        names = []
        for name in ("bad", "worse"):
            last = max(((e[3], e[4]) for e in events if e[0] == name and e[3] <= at), default=(None, "remove"))
            if last[1] == "add":
                names.append(name)
        want.append((i, len(names), ",".join(names), "block" if names else "allow"))
    got = [(r.page_id, r.n_active, r.lists, r.verdict) for r in url_filter.match(captures, entries).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>no</title></head><body><nav><a href=x>n</a></nav><article><h1>T &amp; U</h1><p>a<br>b  c<p>d</article><footer>f</footer></body></html>", "T & U\n\na b c\n\nd"),
    ("<body><div class='content'><p>one &#x41;&lt;</p><div class='ad box'>buy</div><p>two</p></div><div class=comments><p>a much longer comment than the text itself</p></div><script>var t='</p>'</script>", "one A<\n\ntwo"),
    ("<article><p>kept</p><form>f</form><aside>x</aside><!-- <p>c</p> --><p>cut o</p><p class='cookie-notice'>n</p><p>end</artic", "kept\n\ncut o\n\nend"),
    ("", ""), (None, ""), ("plain", "plain"),
])
def test_extract(page, want):
    assert html_extract.extract(page, None) == want


def test_extract_keeps_nested_containers_whole():
    p = lambda name, n=30: f"<p>{name} {'word ' * n}</p>"
    body = f"<h1>Title</h1>{p('intro', 8)}"
    pages = {
        "sections": f"<article>{body}<section>{p('one')}</section><section>{p('two')}</section><p>outro</p></article>",
        "deep": f"<article>{body}<div class=text><section>{p('one')}</section><section>{p('two')}</section></div><p>outro</p></article>",
        "classes": f"<div class=page>{body}<div class=first>{p('one', 90)}</div><div class=second>{p('two')}</div><p>outro</p></div><div class=box>{p('noise', 10)}</div>",
        "bare": f"<div class=page><div class=first>{body}{p('one')}</div><div class=second>{p('two')}<p>outro</p></div></div><div class=box><p>noise</p></div>",
        "table": f"<article>{body}<table><tr><td>{p('one', 90)}</td><td>{p('two', 90)}</td></tr></table><p>outro</p></article>",
        "quote": f"<main>{body}<blockquote>{p('one', 90)}<blockquote>{p('two', 90)}</blockquote></blockquote><p>outro</p></main>",
        "body": f"{body}<section class=a>{p('one', 90)}</section><section class=b>{p('two')}</section><p>outro</p>",
    }
    for name, page in pages.items():
        page = f"<html><body><nav>menu</nav>{page}</body></html>"
        for path in (None, max(html_extract.best_paths(page), key=lambda r: r[1])[0]):
            got = html_extract.extract(page, path).split("\n\n")
            assert [b.split()[0] for b in got] == ["Title", "intro", "one", "two", "outro"], name
    # a path that only holds the cells must not cut the article either
    cells = "#>html>body>article>table>tr>td".removeprefix("#")
    assert html_extract.extract(f"<html><body>{pages['table']}</body></html>", cells).endswith("outro")


def test_extract_keeps_marked_text_of_an_article():
    long, links = "word " * 60, "<a href=x>a link of some length</a> " * 20
    page = f"""<html><body><div class=related>far {long}</div><article><h1 id=search>Title</h1><p>intro {long}</p>
    <h2 id="legal-basis" class=header>Basis</h2><p>one</p><section id="related-work"><h2>Related work</h2><p>two</p></section>
    <section id=legal><p>three</p></section><div id="search-results-explained"><p>four</p></div><div class="legal"><p>five {long}</p></div>
    <div class="related-posts">{links}</div><div class="share bar"><p>share</p></div><div id=related>{links}<p>x</p></div>
    <div class="comments"><p>visitor {long}</p></div><p class="meta">by me</p><p>end</p></article></body></html>"""
    want = ["Title", "intro", "Basis", "one", "Related", "two", "three", "four", "five", "end"]
    assert [b.split()[0] for b in html_extract.extract(page, None).split("\n\n")] == want
    outside = f"<body><div class=legal>{long}</div><h2 id=legal-basis>Basis</h2><p>own text</p></body>"
    assert html_extract.extract(outside, None) == "Basis\n\nown text"


def test_extract_of_marked_and_hidden_parts():
    long = "word " * 60
    body = lambda inner: f"<html><body><nav>n</nav>{inner}</body></html>"
    get = lambda inner: [b.split()[0] for b in html_extract.extract(body(inner), None).split("\n\n")]
    assert get(f"<main><header><h1>Title</h1></header><p>one {long}</p></main>") == ["Title", "one"]
    assert get(f'<div class="social-history"><h1>Title</h1><p>one {long}</p><p>two</p></div>') == ["Title", "one", "two"]
    assert get(f"<article><p>one {long}</p><div hidden><p>no {long}</p></div><div HIDDEN class='a'><p>no</p></div><div data-x='hidden' title=\"a hidden b\"><p>two</p></div></article>") == ["one", "two"]
    assert get(f"<div class='related'><p>no {long}</p></div><div class='text'><p>one {long}</p></div>") == ["one"]


@pytest.mark.parametrize("n", [1, 199, 200, 700])
def test_extract_leaves_out_what_is_marked_however_long(n):
    """No mark is decided by a text's length, inside or outside an article, in blocks or in sentences."""
    noise, own = ("x" * n), "word " * 60
    get = lambda inner: html_extract.extract(f"<html><body><nav>n</nav>{inner}</body></html>", None)
    marked = [
        f"<div class='alert-box'>{noise}</div>", f"<div class='ad-slot'><p>{noise}</p></div>", f"<div class='user-comments'><p>{noise}</p></div>", f"<section id='comment-list'><p>{noise}</p></section>",
        f"<p>a <span class='advert'>{noise}</span>b</p>", f"<p>a <span hidden>{noise} <b>x</b></span>b</p>", f"<p>a <i style='color:red; display: none'>{noise}</i>b</p>",
        f"<div style='display:none'><p>{noise}</p></div>", f"<div style='visibility:hidden'>{noise}</div>", f"<p>a <span aria-hidden='true'>{noise}<span>y</span></span>b</p>", f"<aside>{noise}</aside>",
    ]
    for m in marked:
        middle = "\n\na b" if ">b<" in m else ""
        assert get(f"<article><h1>T</h1><p>{own}</p>{m}<p>end</p></article>") == f"T\n\n{own.strip()}{middle}\n\nend", m
    # a wrapper's name may hold such a word
    assert get(f"<div class='page-with-sidebar'><article><p>{own}</p></article></div>") == own.strip()
    assert get(f"<div class='has-menu'><p>{own}</p><p>two</p></div>") == f"{own.strip()}\n\ntwo"
    # an unclosed inline element ends with its block
    assert get(f"<article><p>one <span hidden>{noise}</p><p>two</p></article>") == "one\n\ntwo"


def test_extract_of_deep_pages():
    """Unclosed and deeply nested elements: all blocks, and time in proportion."""
    import time

    took = []
    for n in (2000, 8000):
        page = "<body>" + "".join(f"<div class=x{i}><p>word{i} and more" for i in range(n))
        began = time.process_time()
        nodes, blocks = html_extract.parse(page)
        assert len(blocks) == n and len(nodes) == n + 2 and max(len(x.path) for x in nodes) <= html_extract.LONGEST_PATH
        assert html_extract.extract(page, None).endswith(f"word{n - 1} and more")
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_extract_returns_what_pages_were_made_of(spark):
    """Round trip: articles of random blocks in random templates come back as they were, on pages with and without the host's votes."""
    rng = random.Random(12)
    words = [f"wort{i}" for i in range(300)] + ["Straße", "été", "A&B", "x<y"]
    say = lambda n: " ".join(rng.choices(words, k=n))
    code = lambda t: t.replace("&", "&amp;").replace("<", "&lt;")

    def article(cls):
        blocks, out = [], []
        for k in range(rng.randint(3, 9)):
            t = say(rng.randint(12, 60))
            blocks.append(t)
            kind = rng.choice(["p", "p", "p", "quote", "section", "list"])
            t = code(t).replace(" ", rng.choice([" ", "\n  ", " <b>", "\t"]), 1)
            t += "</b>" if "<b>" in t else ""
            out.append({"p": f"<p>{t}</p>", "quote": f"<blockquote><p>{t}</p></blockquote>", "section": f"<section id='s{k}'><p>{t}</p></section>", "list": f"<ul><li>{t}</li></ul>"}[kind])
        title = say(5)
        return [title, *blocks], f"<article class='{cls}'><h1>{code(title)}</h1>{''.join(out)}</article>"

    rows, want = [], {}
    for i in range(60):
        host = f"h{i % 4}.org"
        blocks, inner = article(f"post-{i}" if i % 4 == 1 else "entry")
        noise = f"<div class='sidebar'><p>{say(30)}</p></div><div class='cookie-notice'><p>{say(6)}</p></div>"
        links = "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(8))
        page = f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body><header><p>{say(4)}</p></header><nav><ul>{links}</ul></nav>{noise if i % 2 else ''}{inner}<section class='comments'><p>{say(80)}</p></section>{'' if i % 2 else noise}<footer>{say(9)}</footer><script>var a = '<p>no</p>';</script></body></html>"
        rows.append((i, f"http://{host}/{i}", page, "x"))
        want[i] = "\n\n".join(blocks)
    df = spark.createDataFrame([*rows, (60, "http://h0.org/", "", "x"), (60, "http://h0.org/", "", "x")], "page_id long, url string, html string, path string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 62 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got} == want | {60: ""}


def test_hosts_agree_on_a_path(spark):
    page = lambda body, extra="": f"<html><body><div class='main-3'>{body}</div><div class='box'>{extra}</div></body></html>"
    rows = [(i, f"http://h.org/{i}", page(f"<p>{'word ' * 40}{i}</p>", "<p>x</p>")) for i in range(5)] + [(9, "http://h.org/9", page("<p>short</p>", f"<p>{'noise ' * 30}</p>")), (10, None, "<p>q</p>"), (11, "http://e.org", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_pages(df).collect()}
    assert got[9] == ("short", 5) and got[10] == ("q", 1) and got[11] == ("", 0) and len(got) == 8
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    words, bad = [f"wort{i}" for i in range(200)], ["zapfel", "mistig", "gronk"]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(words, k=rng.randint(20, 60))
        toxic, low = int(i % 4 == 0), int(i % 5 == 1)
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        text = " ".join(w) + "."
        rows.append((i, text.upper().replace(" ", "!! ") if low else text))
        labels.append((i, 1 - low, toxic))
    return spark.createDataFrame([*rows, (None, "x"), (1000, None), (1001, "")], "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_ftrl_agrees_with_plain_python():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), np.unique(rng.integers(0, 50, 8)).astype("<i4")) for _ in range(40)]
    rows = [(y, i, rng.random(len(i)).astype("<f4")) for y, i in rows]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([y for y, *_ in rows], pa.int32()), pa.array([i.tobytes() for _, i, _ in rows], pa.binary()), pa.array([v.tobytes() for *_, v in rows], pa.binary())], ["place", "label", "names", "counts"])
    got = next(quality._ftrl([batch]))
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    weight = lambda k: 0.0 if abs(z[k]) <= quality.L1 else -(z[k] - math.copysign(quality.L1, z[k])) / ((quality.BETA + math.sqrt(n[k])) / quality.ALPHA + quality.L2)
    for _ in range(quality.PASSES):
        for y, names, values in rows:
            x = {"bias": 1.0} | {int(k): float(v) for k, v in zip(names, values, strict=True)}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = (p - y) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality.ALPHA * w[k]
                n[k] += g * g
    w = np.frombuffer(got.column(1)[0].as_py(), "<f4")
    assert got.column(0)[0].as_py() == pytest.approx(weight("bias"), rel=1e-5)
    assert all(w[k] == pytest.approx(weight(k), rel=1e-4, abs=1e-6) for k in range(50))


def test_training_takes_one_row_of_an_id(spark):
    """However often ids recur, the sample is bounded by ids, and it does not depend on the order of rows."""
    rows = [(i % 50, f"text {i}") for i in range(2000)] + [(1, None)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    make = lambda r: quality.train_sample(spark.createDataFrame(r, "doc_id long, text string"), labels, "quality", 8000).collect()
    one, two = make(rows), make(rows[::-1])
    assert len(one) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(50))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_quality_scores_are_dot_products_of_shares():
    """Scores from array arithmetic over a batch, against counting each text's n-grams one by one."""
    texts = [(t or "") for _, t, *_ in corpus()][:70]
    raw = [t.encode() for t in texts]
    weights = np.random.default_rng(5).normal(size=quality.DIMENSIONS)
    owner, name, value = quality.features(raw)
    got = np.bincount(owner, weights[name] * value, len(raw))
    families = 5
    for i, text in enumerate(raw):
        o, k, v = quality.features([text])
        assert not len(o) or set(o) == {0}
        words = len(WORD.findall(texts[i]))
        counts = [words, max(0, words - 1), words, max(0, words - 1), max(0, words - 2)]  # 1- and 2-grams, then 1- to 3-grams of forms
        assert len(k) == sum(counts) and sum(c > 0 for c in counts) <= families
        edges = np.cumsum([0, *counts])
        want = 0.0
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                tally = collections.Counter(k[a:b].tolist())
                want += sum(quality.SCALE * c / (b - a) * weights[f] for f, c in tally.items())
        assert got[i] == pytest.approx(want)
        # equal words give equal features, wherever they stand
        seen = {}
        for w, f in zip(WORD.findall(lower(texts[i])), k[:words].tolist(), strict=True):
            assert seen.setdefault(w, f) == f


def test_toxicity_features_against_counting(spark):
    texts = ["You are a gronk! GRONK, you g0r@nk 7", "nobody here says that to you", "", None, "zapfel " * 500, "ÉTÉ été 123 !!"]
    docs = [f"you gronk mistig zapfel {i}" for i in range(8)] + [f"clean words only {i}" for i in range(8)]
    sample = spark.createDataFrame([(i, t, int(i < 8)) for i, t in enumerate(docs)], "place long, text string, label int").select("place", "text", "label")
    lexicon = toxicity.learn_lexicon(sample)
    bad = {"you", "gronk", "mistig", "zapfel"}
    x = toxicity.dense([(t or "").encode() for t in texts], lexicon)
    token = re.compile(r"[0-9A-Za-z@$*\u0080-\uffff]+")
    for row, text in zip(x, texts, strict=True):
        got, words = dict(zip(toxicity.FEATURES, row.tolist(), strict=True)), token.findall(text or "")
        low = [lower(w) for w in words]
        size = max(1, len((text or "").encode()))
        letters = sum(len(c.encode()) for c in (text or "") if c.isascii() and c.isalpha() or not c.isascii())
        hits = sum(w in bad for w in low)
        you = [w in toxicity.SECOND_PERSON for w in low]
        near = [any(you[max(0, i - toxicity.NEAR_WORDS) : i + toxicity.NEAR_WORDS + 1]) for i in range(len(low))]
        assert got["word_hits"] == hits and got["word_density"] == pytest.approx(hits / max(1, len(low)))
        assert got["second_person"] == pytest.approx(sum(you) / max(1, len(low)))
        flagged = [w in bad or any(len(w) > 4 and w.startswith(b[:4]) and len(b) > 4 for b in bad) for w in low]
        assert got["near_second_person"] == sum(f and n for f, n in zip(flagged, near, strict=True))
        assert got["capitals"] == pytest.approx(sum("A" <= c <= "Z" for c in text or "") / max(1, letters))
        assert got["exclaims"] == pytest.approx((text or "").count("!") / size) and got["digits"] == pytest.approx(sum(c in "0123456789" for c in text or "") / size)
        assert got["log_words"] == pytest.approx(math.log1p(len(low)))


def test_scores_of_odd_rows(labelled):
    """Very long texts, rows of one id, nulls and extra columns with the operators' own names."""
    docs, labels = labelled
    many = docs.limit(300).selectExpr("doc_id", "text", "'a' as score", "'b' as features", "0.5 as p", "'c' as dense")
    odd = docs.sparkSession.createDataFrame([(7, "gronk " * 200_000, "a", "b", 0.5, "c"), (7, "x", "a", "b", 0.5, "c"), (7, None, "a", "b", 0.5, "c")], "doc_id long, text string, score string, features string, p double, dense string")
    rows = many.unionByName(odd.selectExpr("doc_id", "text", "score", "features", "cast(p as decimal(2,1)) as p", "dense"))
    for module in (quality, toxicity):
        out = module.score(rows, module.train(docs, labels, rows=300)).collect()
        assert len(out) == 303 and all(0 <= r.score <= 1 for r in out) and sum(r.doc_id == 7 for r in out) >= 3


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        out = module.score(docs, module.train(docs, labels, rows=400))
        rows = out.join(labels.dropna(), "doc_id").collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
        held = [r for r in rows if r.held_out]
        assert len(held) > 60 and np.mean([r.predicted == r[label] for r in held]) > 0.9
        assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1").count() == 0
        assert module.score(docs.limit(0), module.train(docs.limit(0), labels)).count() == 0
        # labels of the held-out fifth must not matter
        flipped = labels.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
        again = module.score(docs, module.train(docs, flipped, rows=400))
        a, b = ({r.doc_id: r.score for r in x.dropna().collect()} for x in (out, again))
        assert a == pytest.approx(b)


def test_accept_keeps_rows_as_they_are(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels, rows=400)
    kept = quality.accept(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).where("predicted = 1").collect()}


def test_blocks_meet_once(spark):
    members = spark.range(23).selectExpr("1L as g", "id")
    pairs = collections.Counter()
    rows = blocks.paired_blocks(Workspace(spark), members, "g", "id", 5).collect()
    piece = collections.defaultdict(list)
    for r in rows:
        piece[r.p, r.q].append((r.id, r.block))
    for (p, q), got in piece.items():
        for i, (a, x) in enumerate(got):
            for b, y in got[:i]:
                if p == q or x != y:
                    pairs[frozenset((a, b))] += 1
    assert len(pairs) == 23 * 22 // 2 and set(pairs.values()) == {1}


def test_pipeline_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    words = [f"wort{i}" for i in range(300)]
    clean = [" ".join(rng.choices(words, k=40)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(clean)] + [(200 + i, t) for i, t in enumerate(clean[:10])] + [(300, clean[11] + " extra")] + [(400 + i, " ".join(rng.choices(words, k=40)).upper().replace(" ", "!! ")) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 400), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == df.columns
        seen.append({r.doc_id for r in at.collect()})
    assert seen[0] == {i for i, _ in rows if i < 400}
    assert seen[1] == seen[0] - set(range(10))
    assert seen[2] == seen[1] - {300} and seen[3] == seen[2]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == seen[3]


@pytest.mark.parametrize("name", ["op2_near_dedup", "op5_embedding_dedup", "op6_url_lists", "op7_exact_dedup", "op9_substring_dedup"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    import os

    from panelscope.llm.queries import ORACLE_SQL, QUERIES

    duckdb, folder = pytest.importorskip("duckdb"), "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("tables are not there")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    columns = ", ".join(sorted(got.columns))
    want = sorted(map(str, con.execute(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()))
    assert sorted(str(tuple(r)) for r in got.selectExpr(*sorted(got.columns)).collect()) == want
