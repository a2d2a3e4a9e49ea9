"""Token counts, spelling variants and centroid clusters against the library and brute force."""

import collections
import gc
import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import _store, ball_clusters, packing, spelling_variants, token_counts, warc
from ridgeline.llm.queries import table
from tests.llm.test_llm import DOCS, LONG, ROWS, SMALL

PIECES = public_tokenizers.path("piece_bpe_32k.model")
merger = token_counts.merger(PIECES)


def library(texts):
    return [len(ids) for ids in merger.model.encode(list(texts), num_threads=1)]


def test_token_counts_equal_the_library(spark):
    d = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    got = {r.doc_id: r for r in token_counts.count_tokens(d, PIECES).collect()}
    assert [got[i].n_tokens for i in texts] == library(texts.values())
    assert all(got[i].n_bytes == len(t.encode()) and got[i].over_limit == (got[i].n_tokens > 4096) for i, t in texts.items())


def test_token_counts_of_awkward_rows(spark):
    got = token_counts.count_tokens(spark.createDataFrame(ROWS, DOCS), PIECES, 3).collect()
    want = [(r[0], len((r[1] or "").encode()), n, n > 3) for r, n in zip(ROWS, library(r[1] or "" for r in ROWS))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), PIECES).collect() == []


ODD = ["", " ", "  a  b ", "a\nb\r\n\tc", "<s> </s> <unk> <pad> x", "\x00a", "▁a ▁", "<0x0A>", " " * 999 + "x", "a" * 20_000, LONG[:3000] + "x" * 70, '"));\r\n', "é́ ﬁ ① 漢字 😀"]


@pytest.mark.parametrize("text", ODD)
def test_merges_of_odd_texts(text):
    assert merger.counts([text]) == library([text])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(sorted(merger.joined) + list(" " * 60 + "etaoinshr" * 10 + "\n\t①漢é")), max_size=80))
def test_merges_of_any_text(text):
    assert merger.counts([text]) == library([text])
    part = "▁" + re.sub("[^a-z]", "", text)
    assert merger.merged(part) == library([part[1:]])[0] or part == "▁"


def occurrences(rows):
    found = collections.Counter()
    for doc, text in rows:
        text = (text or "").translate({k: k + 32 for k in range(65, 91)})
        for run in re.findall("[a-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if n >= 3 and len(w) >= 5}


def forms(n):
    letters, out = sorted(set("".join(n))), {}
    for w in n:
        near = {w[:k] + w[k + 1 :] for k in range(len(w))}
        near |= {w[:k] + c + w[k + j :] for k in range(len(w) + 1) for c in letters for j in (0, 1)}
        near = [x for x in near if x in n and x != w]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 2 * n[w] else None, len(near))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (form, root(w), n[w], near, n.get(form)) for w, (form, near) in out.items()}


def variants(df, *more):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling_variants.variants(df, *more).collect()}


def test_spelling_variants_equal_brute_force(spark):
    d = table(spark, SMALL, "documents")
    n = occurrences((r.doc_id, r.text) for r in d.collect())
    counted = spelling_variants.words(d)
    assert {r.word: r.n for r in counted.collect()} == n
    want = forms(n)
    # Once in one range, and once over many, where nodes lie above borders.
    assert variants(counted) == want
    assert variants(counted, 150) == want


def test_spelling_variants_of_awkward_rows(spark):
    long = "ab" * 20_000
    texts = [None, "", "kitten Kitten KITTEN", f"{long} {long} {long}", f"{long}c {long}c {long}c " * 2, "aaaaa " * 40, "aaaaaa " * 10 + "aaaab " * 4 + "baaaa " * 3, "école École école éécole " * 3]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "kitten mitten mitten mitten", "y"), (2, "mitten", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, run string")
    n = occurrences((r[0], r[1]) for r in rows)
    near = lambda a, b: abs(len(a) - len(b)) <= 1 and a != b and any(a[k + 1 :] in (b[k:], b[k + 1 :]) or a[k:] == b[k + 1 :] for k in [len(spelling_variants.common_prefix(a, b) * "x")])  # noqa: E731, E501
    want = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        want[w] = (best if best and n[best] >= 2 * n[w] else None, len(others))
    for size in (100, 2):
        got = variants(spelling_variants.words(docs), size)
        assert {w: (v[0], v[3]) for w, v in got.items()} == want
    assert got["aaaab"][1] == "aaaaa" and long in got
    assert variants(spelling_variants.words(docs.limit(0))) == {}


def test_chains_of_forms_end_at_their_root(spark):
    words = [("abcde" + "x" * k, 2 ** (12 - k)) for k in range(12)]
    got = variants(spark.createDataFrame(words, "word string, n long"))
    assert all(v[1] == "abcde" for v in got.values()) and sum(v[0] is None for v in got.values()) == 1


def clusters(rows, count, rounds, dim):
    keep = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    points = np.array([v for _, v in keep], np.int64)
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in keep if i is not None)[:count]
    at = [v for _, v in start]

    def given_to():
        far = ((points[:, None, :] - np.array(at)) ** 2).sum(2)
        return far.argmin(1), far.min(1)

    for _ in range(rounds):
        which, _far = given_to()
        for k in set(which.tolist()):
            own = points[which == k]
            at[k] = [int(x) // len(own) for x in own.sum(0)]
    which, far = given_to()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, int(k), int(d), int(far[which == k].sum()), int(far.sum()), sha[k]) for (i, _), k, d in zip(keep, which, far)), key=str)


def test_clusters_equal_brute_force(spark):
    e = table(spark, SMALL, "embeddings")
    got = sorted(map(tuple, ball_clusters.cluster(e).collect()), key=str)
    assert got == clusters([(r.vec_id, r.embedding) for r in e.collect()], 40, 5, 64)


def test_clusters_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 0.0]), (None, [9.0, 9.0])]
    rows += [(7, []), (8, [0.0, 0.0]), (9, [-0.001, 1e-9])] + [(10 + k, [k % 3 / 7, -1.0]) for k in range(300)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<double>, cluster string, distance int")
    for count in (4, 1000):
        got = sorted(map(tuple, ball_clusters.cluster(df, count, 3, 2).collect()), key=str)
        assert got == clusters(rows, count, 3, 2)
    assert ball_clusters.cluster(df.where("vec_id = 4"), 4, 3, 2).collect() == []
    assert ball_clusters.cluster(df.limit(0), 4, 3, 2).collect() == []


def test_whole_balls_and_leaves_agree():
    r = np.random.default_rng(3)
    centres = r.integers(-3000, 3000, (12, 8))
    points = np.concatenate([c + r.integers(-40, 40, (300, 8)) for c in centres])
    import pyarrow as pa

    names = [c.split()[0] for c in ball_clusters.TREE.split(", ")]
    tree = ball_clusters.Tree(dict(zip(names, ball_clusters._tree(pa.array(range(len(points))), points))))
    at = centres + r.integers(-5, 5, centres.shape)
    whole, seen = 0, 0
    for n, left in tree.parts(at):
        a, b, _ = tree.nodes[n]
        seen += b - a
        exact = ((tree.points[a:b, None, :] - at) ** 2).sum(2).argmin(1)
        assert (tree.nearest(n, left, at)[0] == exact).all()
        whole += b - a if len(left) == 1 else 0
    assert seen == len(points) and whole > 0.9 * seen
    assert (ball_clusters.squared(points * 10_000, at) == ((points[:, None, :] * 10_000 - at) ** 2).sum(2)).all()


def test_blocks_of_temporary_tables_may_be_nested(spark):
    there = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))  # noqa: E731, E501
    with _store.temporary(spark):
        with _store.temporary(spark):
            pass
        with _store.temporary(spark):
            inner = _store.materialize(spark.range(3))
        outer = _store.materialize(spark.range(3))
        assert not there(inner._ridgeline_path) and there(outer._ridgeline_path)
    assert not there(outer._ridgeline_path)


def test_many_null_texts_are_packed_by_several_tasks(spark):
    docs = spark.range(2_200_000, numPartitions=8).selectExpr("id as doc_id", "cast(null as string) as text")
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert packed.rdd.getNumPartitions() == 3 and packed.agg({"length": "sum"}).first()[0] == 2_200_000


def test_links_are_those_of_href_outside_comments_and_scripts(spark):
    html = "<a data-href='x' href='y'>1</a><!-- <a href=c> --><script>'<a href=s>'</script><A\nHREF=z><a><a name=q><ahref=n><a xhref=m>"
    rows = warc.derive(warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))).collect()
    block = {r.warc_type: r.block for r in rows}["metadata"]
    assert "outlinks: 2\r\n" in block and block.endswith("outlink: y\r\noutlink: z\r\n") and block.count("outlink:") == 2


def test_packing_remembers_words_in_few_bytes():
    def held():
        gc.collect()
        return tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()

    tok = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    made = [f"Wo{n:x}rt{n % 977}, it's '{n}'" for n in range(40_000)]
    texts = [" ".join(made[n : n + 1000]) for n in range(0, len(made), 1000)]
    odd = ["", " ", "\t a  b\n", "ends here ", "naïve — “quoted”…", "日本 and <|endoftext|> it's", "''s 's'' re's"]
    tracemalloc.start()
    try:
        before = held()
        for n in range(0, len(texts), 10):
            tok.encode(texts[n : n + 10])
        after = held()
    finally:
        tracemalloc.stop()
    # Some 80,000 words and parts of words take 5 MB; dicts of them took 12 MB.
    assert after - before < 8e6
    for t, ids in zip(odd + texts[:3], tok.encode(odd + texts[:3])):
        assert np.frombuffer(ids, "<u4").tolist() == tok.tokenizer.encode(t, add_special_tokens=False).ids
    assert tok.encode([]) == [] and tok.encode(["", "日"])[0] == b""
