"""Manifests, whitening and license scans against plain Python on small fixtures."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("panelscope.llm")
from panelscope.llm import licenses, merkle, whitening  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, PATH string, tree long, block string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def lower(t):
    return t.translate({i: i + 32 for i in range(65, 91)})


# -- manifests -------------------------------------------------------------
def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    """All levels of an 8-ary tree, from the leaves up."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, at):
    path = []
    for nodes in tree[:-1]:
        run = at // 8 * 8
        path.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 8])))
        at //= 8
    return path


def manifest(rows):
    """Rows of the operator, from the definition."""
    leaf = lambda r, text: sha("".join(map(field, (r[0], r[3], r[2], r[4], text))))
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for name in names:
        trees[name].sort(key=lambda x: x[:3])
        built[name] = levels([x[2] for x in trees[name]])
    crown = levels([built[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, _, digest, r) in enumerate(trees[name]):
            path = siblings(built[name], at) + siblings(crown, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            folded = leaf(r, None if r[1] is None else lower(r[1])) if tampered else digest
            for a, b in path:
                folded = sha(a + folded + b)
            out.append((r[0], digest, built[name][-1][0], crown[-1][0], sha("".join(a + b for a, b in path)), folded, folded == crown[-1][0]))
    return out


def rows_of(n, seed=3):
    rng = random.Random(seed)
    made = [(rng.choice([None, *range(-3, 3 * n)]), rng.choice([None, "", "Ab c", "ÄB É 日本", "x" * 3000, f"T{i}"]), rng.choice([None, "en", "en", "en", "de", "Zz", "ß"]), rng.choice([None, "s"]), rng.choice([None, i]), "p", 1, "b") for i in range(n)]
    return made + made[:5]


key = lambda r: tuple(str(x) for x in r)


@pytest.mark.parametrize(("n", "block_levels"), [(0, 4), (1, 4), (150, 1), (150, 4)])
def test_manifest_against_its_definition(spark, n, block_levels):
    rows = rows_of(n) if n else []
    out = merkle.verify(spark.createDataFrame(rows, DOCS), block_levels)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(manifest(rows), key=key)


def test_appended_batches_give_the_tree_of_one(spark):
    """Blocks of eight leaves: batches end inside blocks, at their ends, and leave trees untouched."""
    nodes = [("a", i, sha(f"a{i}")) for i in range(100)] + [("b", i, sha(f"b{i}")) for i in range(13)] + [(None, 0, sha("n"))]
    log = merkle.Log(spark, 1)
    frame = lambda rows: spark.createDataFrame(rows, "tree string, key long, digest string")
    for low, high in ((0, 8), (8, 13), (13, 75), (75, 100)):
        log.append(frame([x for x in nodes if low <= x[1] < high]))
    want = {}
    for name in ("a", "b", None):
        tree = levels([d for t, _, d in nodes if t == name])
        want |= {d: (siblings(tree, i), tree[-1][0]) for i, d in enumerate(tree[0])}
    got = log.witnesses(["digest"]).collect()
    assert len(got) == len(nodes)
    for r in got:
        assert ([tuple(p) for p in r.path], r.root) == want[r.digest]
    # each batch reads the open block of each tree besides its own rows
    assert log.tails.count() == 100 % 8 + 13 % 8 + 1
    with pytest.raises(ValueError, match="does not follow"):
        log.append(frame([("a", 99, sha("late"))]))


def test_stream_extends_witnesses_as_runs_complete():
    stream = merkle.Stream(2)
    nodes = [stream.append(sha(str(i))) for i in range(7)]
    assert not merkle.witness(nodes[0])
    nodes.append(stream.append(sha("7")))
    assert len(merkle.witness(nodes[0])) == 1
    nodes += [stream.append(sha(str(i))) for i in range(8, 11)]
    root = stream.close()
    assert all(merkle.fold(n[0], merkle.witness(n)) == root for n in nodes)
    assert merkle.fold(sha("other"), merkle.witness(nodes[3])) != root


# -- whitening -------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, W string, dim int"


def test_solver_against_lapack():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 40):
        for r in (np.triu(rng.standard_normal((n, n))), np.diag(10.0 ** -rng.uniform(0, 12, n)), np.eye(n) * 3, np.zeros((n, n))):
            values, z = whitening.directions(r, 8)
            want = np.linalg.svd(r, compute_uv=False)
            assert np.allclose(np.sqrt(values), want, rtol=0, atol=1e-13 * max(want[0], 1))
            assert np.abs(z @ z.T - np.eye(len(z))).max() < 1e-9
            assert max(np.linalg.norm(r.T @ (r @ v) - e * v) for v, e in zip(z, values, strict=False)) <= 1e-12 * max(values[0], 1)


def test_singular_values_of_a_bidiagonal_are_relatively_exact():
    """Values over 24 decades, each known from a matrix whose inverse is known."""
    diagonal = 10.0 ** -np.arange(0, 24, 2)
    upper = diagonal[:-1] * 1e-9
    got = np.sqrt(whitening.dqds(diagonal, upper))
    assert np.allclose(got, diagonal, rtol=1e-14)


@pytest.mark.parametrize("parts", [1, 40])
def test_whitened_rows(spark, parts):
    rng = np.random.default_rng(2)
    fine = (rng.standard_normal((300, 10)) @ rng.standard_normal((10, 10)) + 5).astype(np.float32)
    short = rng.standard_normal((20, 3)).astype(np.float32)
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(fine)] + [(1000 + i, v.tolist(), "x", 1) for i, v in enumerate(short)]
    rows += [(7, rows[0][1], "x", 1), (None, rows[1][1], "x", 1), (-1, None, "x", 1), (-2, [], "x", 1), (-3, [1.0, None] * 5, "x", 1), (-4, [math.inf] * 10, "x", 1), (-5, [math.nan] * 10, "x", 1), (-6, [1.0], "x", 1)]
    out = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(parts)).collect()
    assert len(out) == 302 * 8 + 20 * 3 + 1
    for vectors, ids in ((np.vstack([fine, fine[:2]]), set(range(300)) | {None}), (short, set(range(1000, 1020)))):
        x = np.floor(vectors.astype(float) * 1024).astype(np.int64) + 100000
        n, s = len(x), x.sum(axis=0)
        values, z = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
        order = np.argsort(values)[::-1][:8]
        deviations = {int(v) for v in ((n * x - s) ** 2).sum(axis=1)}
        centred = (n * x - s) / n
        for r in (r for r in out if r.vec_id in ids):
            k = order[r.component - 1]
            assert r.n == n
            assert r.deviation in deviations
            assert abs(r.explained - values[k] / values.sum()) < 1e-10
            if r.vec_id is not None and r.vec_id != 7:
                want = centred[r.vec_id % 1000] @ z[:, k] / np.sqrt(values[k])
                assert abs(abs(r.whitened) - abs(want)) < 1e-9
    assert {r.whitened for r in out if r.vec_id == -6} == {None}
    assert len({r.identity_error for r in out}) == 1
    assert out[0].identity_error < 1e-10


def test_whitening_of_nothing_and_of_equal_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], VECTORS)).count() == 0
    out = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], "x", 1) for i in range(3)], VECTORS)).collect()
    assert [(r.whitened, r.explained, r.deviation, r.identity_error) for r in out] == [(None, 0.0, 0, 0.0)] * 6
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0], "x", 1), (2, [0.0, 1.0], "x", 1)], VECTORS)).collect()
    assert {r.deviation for r in huge} == {None}


# -- licenses --------------------------------------------------------------
def blocks_of(words, width):
    step = width // 2
    return [words[b * step : b * step + width] for b in range((len(words) - 1) // step + 1)]


def scanned(text, templates, phrases=licenses.PHRASES, share=licenses.CONTAINMENT):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    base = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    met, best = set(), 0.0
    for label, template in templates:
        want = set(template.split())
        width = 16
        while width < 2 * len(template.split()):
            width *= 2
        for block in blocks_of(words, width):
            common = len(want & set(block)) / len(want)
            if common >= share - 1e-12:
                met, best = met | {label}, max(best, common)
    labels = {label for _, label in base}
    return (len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | met)), 1.0 if base else best)


@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_scan_against_all_pairs(spark, share):
    rng = random.Random(11)
    full = [t for _, t in licenses.TEMPLATES]
    common = sorted({w for t in full for w in t.split()})
    texts = [None, "", "the MIT license MIT License mit-license mitlicense", "General Public\nLICENSE, apache.license", "Apache Licensé license", "mit\x00license"]
    for _ in range(60):
        words = rng.choices([*common, *(f"w{i}" for i in range(40)), "日本", "é"], k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            t = rng.choice(full).split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                t[rng.randrange(len(t))] = "other"
            at = rng.randrange(len(words) + 1)
            words[at:at] = t
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    texts += [texts[-1], "free software " * 20000]
    templates = [*licenses.TEMPLATES, ("odd", "internationalisation responsibilities of licensees"), ("one", "copyleft")]
    rows = [(i // 2, t, "en", None, 1, "p", 1, "b") for i, t in enumerate(texts)]
    out = licenses.scan(spark.createDataFrame(rows, DOCS), templates, containment=share)
    got = sorted(((r.doc_id, *tuple(r)[1:7], round(r.score, 12)) for r in out.collect()), key=key)
    assert got == sorted(((d, *(w := scanned(t, templates, share=share))[:6], round(w[6], 12)) for d, t, *_ in rows), key=key)
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_words_of_one_beginning_are_told_apart():
    known = licenses.textscan.scan([b"permission", b"permissive", b"permissi", b"a"], table=licenses._WORD)
    words = licenses.textscan.scan([b"permissi permission a permissively b permissive"], lower=True, table=licenses._WORD)
    at, number = licenses._numbers(words, known)
    assert (at.tolist(), number.tolist()) == ([0, 1, 2, 5], [2, 0, 3, 1])
