"""Token alignment, whitening and near-duplicate embeddings against brute force."""

import collections
import hashlib
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismatica.llm import cover_tree, pieces, queries as Q
from prismatica.llm.cover_tree import Links, Tree, near_vectors, traverse, units
from prismatica.llm.token_alignment import Block, Csr, aligned_tokens, load_byte_bpe, load_pieces, memberships, row_products, runs
from prismatica.llm.whitening import eigen, pivoted_cholesky, whitened

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# --- products -------------------------------------------------------------------------

def compressed(m):
    return Csr(np.concatenate(([0], np.cumsum((m != 0).sum(1)))), np.nonzero(m)[1], m[m != 0], m.shape[1])


@pytest.mark.parametrize("expanded", [1, 7, 1000])
def test_row_products_are_those_of_dense_matrices(expanded):
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, k, m = rng.integers(1, 9, 3)
        a, b = rng.integers(0, 3, (n, k)) * rng.integers(0, 2, (n, k)), rng.integers(0, 3, (m, k)) * rng.integers(0, 2, (m, k))
        out = np.zeros((n, m), int)
        places = []
        for i, j, v in row_products(compressed(a), compressed(b).transposed(), expanded):
            out[i, j] = v
            places += list(zip(i.tolist(), j.tolist()))
        assert (out == a @ b.T).all() and len(set(places)) == len(places)


def test_products_of_no_rows():
    assert list(row_products(runs(np.array([], int)), runs(np.array([], int)).transposed())) == []
    assert list(row_products(memberships(np.array([0]), 2), memberships(np.array([1]), 2).transposed())) == []


# --- token alignment --------------------------------------------------------------------

def aligned_by_brute_force(texts):
    import sentencepiece
    from tokenizers import Tokenizer
    a, b = load_byte_bpe(), load_pieces()
    one = Tokenizer.from_buffer(a.model)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_proto=b.model)

    def spans(ids, tokens):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(tokens[i]), i))
            at += len(tokens[i])
        return out
    found = []
    for text in texts:
        x = y = []
        if text:
            raw = b" " + text.encode()
            p, q = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            if b"".join(a.tokens[i] for i in p) == raw == b"".join(b.tokens[i] for i in q):
                x, y = spans(p, a.tokens), spans(q, b.tokens)
        links = [(s[2], t[2]) for s in x for t in y if s[0] < t[1] and t[0] < s[1]]
        ends = sorted({s[1] for s in x} & {t[1] for t in y})
        groups, before = [], 0
        for end in ends:
            groups.append(tuple([s[2] for s in side if before < s[1] <= end] for side in (x, y)))
            before = end
        found.append((x, y, links, groups))
    total = collections.Counter(link for f in found for link in f[2])
    highest = collections.defaultdict(int)
    for (_, j), n in total.items():
        highest[j] = max(highest[j], n)
    out = []
    for x, y, links, groups in found:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(len(g) * len(h) for g, h in groups), sum(total[p] == highest[p[1]] for p in links),
                    sum(total[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


ODD = [None, "", " ", "  two  spaces\n\tand\r\nlines ", "naïve café 🙂 你好 Ĥ ﬁ", "▁marked", "<s> </s> <|endoftext|> <0x0A> <unk>", "\x00\x01\x7f",
       "a" * 500 + "=" * 700, "é​ x", "one two", "one two", " ".join(f"w{i % 97}x{i}" for i in range(1500))]


@pytest.mark.parametrize("share_mb", [0, 4])
def test_token_alignment_of_odd_texts(spark, share_mb):
    rows = [(k if k % 5 else None, t, 7, "x", 3) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block long, keys string, n_a int").repartition(3)
    got = aligned_tokens(docs, load_byte_bpe(), load_pieces(), share_mb=share_mb).collect()
    want = aligned_by_brute_force([r[1] for r in rows])
    assert sorted(map(tuple, got), key=repr) == sorted([(r[0], *w) for r, w in zip(rows, want)], key=repr)


def test_token_alignment_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [(r[0], r[1][:400]) for r in docs]
    got = aligned_tokens(spark.createDataFrame(short, "doc_id long, text string"), load_byte_bpe(), load_pieces()).collect()
    want = aligned_by_brute_force([t for _, t in short])
    assert sorted(map(tuple, got)) == sorted((k, *w) for (k, _), w in zip(short, want))


def test_token_alignment_query(spark, sf_dir):
    got = Q.QUERIES["op11_token_alignment"](spark, sf_dir)
    first = got.filter("n_links > 0").first()
    assert got.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert first["n_links"] >= max(first["n_a"], first["n_b"]) and first["n_groups"] <= min(first["n_a"], first["n_b"])


def test_token_alignment_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    assert aligned_tokens(docs, load_byte_bpe(), load_pieces()).collect() == []


def test_group_product_joins_tokens_of_one_group():
    a, b = load_byte_bpe(), load_pieces()
    block = Block([np.array([2]), np.array([3])], [np.array([0, 1]), np.array([0, 1, 2])], [np.array([2, 3]), np.array([2, 1, 2])])
    assert [tuple(x.tolist() for x in part) for part in block.group_links()] == [([0, 1, 1], [0, 1, 2], [1, 1, 1])]
    assert [tuple(x.tolist() for x in part) for part in block.links()] == [([0, 1, 1], [0, 1, 2], [2, 1, 2])]
    assert len(a.tokens) == 50257 and len(b.tokens) == 32000


# --- whitening --------------------------------------------------------------------------

def table_of(spark, rows):
    return spark.createDataFrame([(*r, 5, b"x", 2.0) for r in rows],
                                 "vec_id long, embedding array<float>, label int, dim int, digest binary, n double")


def test_pivoted_cholesky_and_rotation():
    rng = np.random.default_rng(11)
    for d, rank in [(1, 1), (5, 5), (8, 3), (12, 12), (33, 20)]:
        half = rng.standard_normal((d, rank)) * np.logspace(0, 3, rank)
        c = half @ half.T
        order, factor = pivoted_cholesky(c)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, c[np.ix_(order, order)], rtol=1e-12, atol=1e-9 * c.max())
        assert np.allclose(factor[:rank], np.tril(factor[:rank]))
        values, vectors = eigen(c)
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][:rank], rtol=1e-8)
        assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-8)
    assert pivoted_cholesky(np.zeros((3, 3)))[1].shape == (3, 0)


def whitened_by_brute_force(rows, k=16):
    kept = [(i, np.floor(np.array(v, np.float32).astype(float) * 64).astype(int) + 1_000_000) for i, v, *_ in rows
            if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [(i, n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s)), ((x - s / n) @ u) / np.sqrt(e), e / np.trace(centred.T @ centred / n)) for i, x in kept]


def test_whitening_against_an_eigensolver(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 20)) * np.linspace(3, 0.2, 20) + 2
    rows = [(i, v.tolist(), 1) for i, v in enumerate(base)] + [(i, base[0].tolist(), 1) for i in range(5)]
    rows += [(900, None, 1), (901, [None] * 20, 1), (902, [float("nan")] * 20, 1), (903, [float("inf")] + [0.0] * 19, 1), (None, base[3].tolist(), None),
             (904, [], 1), (905, [1.0, 2.0], 1)]
    got = whitened(table_of(spark, rows).repartition(5)).collect()
    want = whitened_by_brute_force([r for r in rows if r[0] not in (904, 905)])
    for r in got:
        assert r["n"] == 300 and r["identity_error"] < 1e-9
    matrix = {}
    for r in got:
        matrix.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    signs = None
    assert len(got) == 16 * len(want) and len(matrix) == len({(w[0], w[2]) for w in want})
    for i, _, deviation, white, explained in want:
        mine = np.array([matrix[i, deviation][c] for c in range(1, 17)])
        signs = np.sign(mine * white) if signs is None else signs
        assert np.allclose(mine, white * signs, rtol=1e-6, atol=1e-6)
    shares = {r["component"]: r["explained"] for r in got}
    assert np.allclose([shares[c] for c in range(1, 17)], want[0][4], rtol=1e-9)


def test_whitening_of_few_and_no_vectors(spark):
    assert whitened(table_of(spark, [(1, [1.0, 2.0], 1)]).limit(0)).collect() == []
    assert whitened(table_of(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).collect() == []
    assert whitened(table_of(spark, [(1, [], 1), (2, None, 1)])).collect() == []
    got = whitened(table_of(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 2.0], 1)])).collect()  # one direction only
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in sorted(got, key=lambda r: r["vec_id"])] == [
        (1, 1, 2, 128 ** 2, 1.0, 1.0), (2, 1, 2, 128 ** 2, 1.0, 1.0)]
    huge = whitened(table_of(spark, [(1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1), (3, [0.0, 1.0], 1)])).collect()
    assert {r["vec_id"] for r in huge} == {1, 2, 3} and any(r["deviation"] is None for r in huge)


def test_whitening_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = {(i, deviation): (n, white) for i, n, deviation, white, _ in whitened_by_brute_force(rows)}
    got = Q.QUERIES["op12_whitening"](spark, sf_dir).collect()
    assert len(got) == 16 * len(rows) and max(r["identity_error"] for r in got) < 1e-9
    assert all(np.isclose(abs(r["whitened"]), abs(want[r["vec_id"], r["deviation"]][1][r["component"] - 1]), atol=1e-6) for r in got)


# --- near-duplicate embeddings -------------------------------------------------------------

def near_by_brute_force(rows, least=0.93):
    fine = [v is not None and len(v) > 0 and l is not None and all(e is not None and math.isfinite(e) for e in v) and any(v) for _, v, l in rows]
    x = [np.array(v, np.float32).astype(float) if ok else None for (_, v, _), ok in zip(rows, fine)]
    near = [[j for j in range(len(rows)) if i != j and fine[i] and fine[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j])
             and float(x[i] @ x[j]) / math.sqrt(float(x[i] @ x[i]) * float(x[j] @ x[j])) >= least] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j), todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids) if ids else None))
    return out


def clustered(seed, n, dim, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centres[rng.integers(12)] + rng.standard_normal(dim) * rng.choice([0.0, 0.15, 0.35, 1.0])
        rows.append((int(i), (v * 2.0 ** float(rng.integers(-2, 3))).tolist(), int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("leaf_bytes", [8 << 20, 8 * 6 * 25])
def test_near_vectors_with_whole_and_split_labels(spark, leaf_bytes):
    rows = clustered(8, 320, 6)
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(40)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 6, 1), (2002, [None] * 6, 1), (2003, [float("nan")] * 6, 1), (2004, rows[1][1], None), (2005, [], 0),
             (None, rows[2][1], rows[2][2]), (None, [1.0] * 6, 9), (5, rows[9][1], rows[9][2]), (2006, rows[3][1][:5], rows[3][2])]
    docs = spark.createDataFrame([(*r, "p", "s") for r in rows], "vec_id long, embedding array<float>, label int, path string, space string").repartition(4)
    got = near_vectors(docs, leaf_bytes=leaf_bytes).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(near_by_brute_force(rows), key=repr)


def test_equal_directions_can_be_split(spark):
    rows = [(i, [1.0 + i, 2.0 + 2 * i, 0.0], 1) for i in range(200)] + [(999, [-1.0, 0.0, 5.0], 1)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(map(tuple, near_vectors(docs, leaf_bytes=8 * 3 * 20).collect()))
    assert got == [(i, 199, 0) for i in range(200)] + [(999, 0, 999)]


def test_near_vectors_of_no_rows(spark):
    assert near_vectors(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int").limit(0)).collect() == []


def test_tree_is_nested_and_covers():
    x = units(np.random.default_rng(2).standard_normal((400, 5)))
    tree = Tree.over(x, 0.05)
    assert (np.sort(tree.members[0]) == np.arange(400)).all()
    for k, own in enumerate(tree.members):
        assert own[0] == tree.centre[k] and np.linalg.norm(x[own] - x[own[0]], axis=1).max() <= tree.radius[k] + 1e-7
        if tree.children[k]:
            below = tree.members[tree.child[k]:tree.child[k] + tree.children[k]]
            assert sorted(np.concatenate(below)) == sorted(own) and own[0] in [m[0] for m in below]


def test_traversal_prunes_far_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    x = units(np.concatenate([c + 0.05 * rng.standard_normal((60, 32)) for c in rng.standard_normal((20, 32))]))
    compared = []
    whole, paired = cover_tree.cosines, cover_tree.paired_cosines
    monkeypatch.setattr(cover_tree, "cosines", lambda a, b: (compared.append(len(a) * len(b)), whole(a, b))[1])
    monkeypatch.setattr(cover_tree, "paired_cosines", lambda a, b: (compared.append(len(a)), paired(a, b))[1])
    tree, links = Tree.over(x, 0.05), Links(np.ones(len(x), np.int64))
    traverse(x, tree, x, tree, 0, links, x, 0.93)
    want = (x @ x.T >= 0.93).sum(1) - 1
    assert (links.n == want).all() and sum(compared) < len(x) ** 2 / 10


def test_embedding_dedup_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = Q.QUERIES["op13_embedding_dedup"](spark, sf_dir).select("vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted((i, n, c, i == c) for i, n, c in near_by_brute_force(rows))


# --- piece encoding --------------------------------------------------------------------------

def test_words_searched_side_by_side_are_those_of_the_stream(spark, sf_dir, monkeypatch):
    """Learnt together, with bytes, marks, long words and a memo that overflows, or one by one: the same ids."""
    texts = [t for t in ODD if t] + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() if r["text"]]
    texts += ["x▁▁ y▁", "\n\n", "ñ\U0001d518 end", "b" * 64 + " " + "c" * 65]
    vocabulary = pieces.load_pieces()
    alone = pieces.Encoder(vocabulary)
    monkeypatch.setattr(alone, "learn", lambda parts: None)
    want = [alone.encode(t).tolist() for t in texts]
    together = pieces.Encoder(vocabulary)
    assert [x.tolist() for x in together.encode_all(texts)] == want
    monkeypatch.setattr(pieces, "REMEMBERED", 40)
    small = pieces.Encoder(vocabulary)
    assert [x.tolist() for t in texts for x in small.encode_all([t])] == want
    for ids, t in zip(want, texts):
        assert together.spells(np.array(ids, np.int32), t) == (together.decode(ids) == t)
    assert not together.spells(np.array(want[0][:-1], np.int32), texts[0]) and together.spells(np.empty(0, np.int32), "")


# --- all queries, away from the repository -------------------------------------------------

def test_queries_run_from_another_folder(tmp_path):
    """Executors that cannot import the package get its functions with the job."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from prismatica.llm.queries import QUERIES
for name, query in QUERIES.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all ran" in ran.stdout, ran.stderr[-3000:]
