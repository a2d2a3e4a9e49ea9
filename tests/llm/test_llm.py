"""The training-data operators against brute force, held-out labels and awkward tables."""

import math
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ridgeline.llm import embedding_dedup, minhash_dedup, mixing, packing, quality_classifier, secret_ledger, sharding, url_rules, vector_graph, warc
from ridgeline.llm.queries import quality_labels, table

SMALL = "/root/testdata/sf0.001"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
LONG = "word " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, weight double, row string, blob string, taken long"
#: Null ids and texts, blank and very long texts, repeated rows, and columns named like inner ones.
ROWS = [
    (i, t, "en", s, None, 7, 0.5, "r", "b", 1)
    for i, t, s in [
        (1, "one two three four five six seven eight nine ten", "a"),
        (2, "one two three four five six seven eight nine ten", "a"),
        (3, "ONE two\tthree four  five six seven eight nine ten", None),
        (4, None, "a"), (5, "", "b"), (6, " \n\t", "b"), (7, "short text", "c"), (8, "short text", "c"),
        (9, LONG, "b"), (10, "password = hunter22 and AKIA" + "A1" * 8 + " " + "0af" * 9, "c"),
        (None, "no id here at all", "c"), (None, None, None), (7, "short text", "c"),
    ]
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def grouped(sets, least):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_dedup_awkward_rows(docs):
    got = minhash_dedup.near_duplicates(docs, 85).collect()
    assert len(got) == len(ROWS)
    known = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [known[i].component_id for i in range(1, 11)] == [1, 1, 1, 4, 5, 6, 7, 7, 9, 10]
    assert [known[i].n_shingles for i in (1, 4, 6, 7, 9)] == [6, 0, 0, 1, 1]
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)


@pytest.mark.parametrize("percent", [80, 85])
def test_dedup_equals_brute_force(spark, percent):
    d = table(spark, SMALL, "documents")
    want = grouped({r.doc_id: shingles(r.text) for r in d.collect()}, percent)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(d, percent).collect()} == want


def test_keep_one_keeps_columns_and_one_row_of_a_group(docs):
    got = minhash_dedup.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep long")


def awkward(n=600, dim=16):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:200] = x[:100] + rng.normal(size=(100, dim)).astype(np.float32) * 0.2
    x[200:260] = x[0]
    rows = [(i, [float(v) for v in r], 1, 5) for i, r in enumerate(x)]
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] * dim, [None] * dim]
    return x, rows + [(n + i, b, None, None) for i, b in enumerate(bad)] + [(None, [1.0] * dim, 1, 1)]


def test_embedding_dedup_equals_brute_force(spark):
    x, rows = awkward()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    label = np.arange(len(x))
    while True:
        new = np.minimum(label, np.where(near, label[None], len(x)).min(1))
        if (new == label).all():
            break
        label = new
    assert [got[i].component_id for i in range(len(x))] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in range(len(x), len(x) + 6))


def test_vector_graph_recall_and_scores(spark):
    x, rows = awkward(3000)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    got = vector_graph.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    hits = 0
    for q in range(0, 3000, 20):
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        c = u @ u[q]
        c[q] = -2
        hits += sum(m[2] >= np.sort(c)[-5] - 1e-12 for m in mine)
        assert all(abs(c[m[1]] - m[2]) < 1e-12 for m in mine)
    assert hits >= 0.9 * 5 * 150


def test_shards_awkward_rows(docs):
    got = sorted(sharding.shard_by_bytes(docs, 4).collect(), key=lambda r: (r.shard, r.slot))
    assert len(got) == len(ROWS)
    for s in {r.shard for r in got}:
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))
    by = {(r.doc_id, r.size, r.text_crc32) for r in got}
    assert by == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}


def test_shards_keep_whole_rows(docs):
    got = sharding.shard_by_bytes(docs, 4)
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, docs.collect()))
    for r in got.collect():
        text = (r.row.text or "").encode()
        assert (r.doc_id, r.size, r.text_crc32) == (r.row.doc_id, len(text) + 1, zlib.crc32(text))


def test_mix_targets_and_reruns(docs, spark):
    weights = mixing.quality_weight(spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int"))
    assert {(r.doc_id, r.weight) for r in weights.collect()} == {(1, 2.0), (2, 2.0)}
    got = mixing.mix(docs, weights).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5), weights).collect()))
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 2 * r.size for r in got)
    for s in ("a", "b", "c", None):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5 + 1e-9
    rows = mixing.mixed_rows(docs, weights)
    assert rows.columns == docs.columns
    assert sum(len(words(r.text)) for r in rows.collect()) == sum(r.taken for r in got)


def test_heavier_rows_are_taken_more_often(spark):
    rows = spark.range(4000).selectExpr("id as doc_id", "'w w w w' as text", "if(id < 3990, 'a', 'b') as source")
    w = spark.range(4000).selectExpr("id as doc_id", "if(id % 2 = 0, 4.0, 1.0) as weight")
    got = mixing.mix(rows, w, seed=9).where("source = 'a' and taken % size > 0 or taken >= 8").collect()
    even = sum(r.doc_id % 2 == 0 for r in got)
    assert even > 0.5 * len(got)


def spans_of(t):
    out = []
    for kind, pattern, group, least in (
        ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
    ):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, t or "") if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1])))


def test_secrets_equal_brute_force_and_ledger_is_incremental(spark, docs, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    extra = spark.createDataFrame([(20, "é😀 TOKEN:'abc123x' token=x secret=" + "ab" * 20)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    for part in (docs, both):
        got = sorted(str(([(s.start, s.kind, s.stop) for s in r.spans], r.doc_id)) for r in secret_ledger.scan(part, ledger).collect())
        assert got == sorted(str((spans_of(r.text), r.doc_id)) for r in part.collect())
    held = spark.read.parquet(ledger)
    assert held.count() == held.select("blob").distinct().count() == both.select(F.coalesce("text", F.lit(""))).distinct().count()
    clean = secret_ledger.redact(both, ledger)
    assert clean.count() == both.count() and not any(spans_of(r.text) for r in clean.collect())


def test_classifier_separates_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    scored = __spark_entry__.queries()["op7_quality_classifier"](spark, d).where("held_out")
    rows = scored.join(table(spark, d, "labels"), "doc_id").where("quality is not null").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9


def test_classifier_awkward_rows_and_no_labels(spark, docs):
    model = quality_classifier.fit(docs, spark.createDataFrame([(None, 1), (99, 1), (1, None)], "doc_id long, label int"))
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == len(ROWS) and all(abs(r.score - 0.5) < 0.2 for r in got)
    assert quality_classifier.keep_good(docs, model).columns == docs.columns


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    odd = [(50, "Ünï-code İstanbul 😀 don't <|endoftext|> x²", "en"), (51, "A" * 9000, "en")]
    rows = docs.select("doc_id", "text").where("doc_id is not null").unionByName(spark.createDataFrame([r[:2] for r in odd], "doc_id long, text string")).dropDuplicates(["doc_id"])
    pieces = packing.pack(rows, TOKENS).collect()
    for r in rows.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces if p.doc_id == r.doc_id)
        at = 0
        for start, length, crc, total in mine:
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[start : start + length].tobytes()))
            at += length
        assert at == len(ids)
    for s in {p.sequence_id for p in pieces}:
        at = 0
        for p in sorted((p for p in pieces if p.sequence_id == s), key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048


def test_given_url_rules_and_odd_urls(spark):
    urls = [
        ("https://a.Example.ORG/es/x?q", "example.org/es/", "block"), ("http://example.org/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "org/", "allow"), ("x://b.com/fr/", "com/fr/", "allow"), ("x://b.com/de/#a", "com/de/", "block"),
        ("x://b.com/en/", None, "allow"), (None, None, "allow"), ("no scheme", None, "allow"), ("x://org", None, "allow"), ("x://evil/%?a://org/", None, "allow"),
    ]
    pages = spark.createDataFrame([(n, u, "h", "v") for n, (u, *_) in enumerate(urls)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id long, block boolean")
    got = url_rules.judge(pages, labels).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [u[1:] for u in urls]
    assert (got[0].host, got[0].path) == ("a.example.org", "/es/x") and (got[6].host, got[7].path) == ("", "")


def test_mined_url_rules_equal_brute_force(spark):
    rows = []
    for n in range(300):
        bad = n % 3 == 0
        rows.append((f"http://{'spam' if bad and n % 2 == 0 else 'site%d' % (n % 7)}.test/{'buy' if bad else 'read'}/{n}", bad if n % 5 else False))
    pages = spark.createDataFrame([(n, u, b) for n, (u, b) in enumerate(rows)], "page_id long, url string, block boolean")
    rules = url_rules.mine(pages, min_support=0.01, min_count=5, min_confidence=0.6).collect()
    has = [set(r[0]) for r in pages.select(url_rules.tokens(F.col("url"))).collect()]
    assert rules
    for r in rules:
        all_, blocked = sum(set(r.tokens) <= h for h in has), sum(set(r.tokens) <= h and b for h, (_, b) in zip(has, rows))
        assert r.support == blocked >= 5 and math.isclose(r.confidence, blocked / all_) and r.confidence >= 0.6
    got = url_rules.judge(pages.drop("block"), pages.select("page_id", "block"), rules=(), min_support=0.01, min_confidence=0.6)
    want = {n for n, h in enumerate(has) if any(set(r.tokens) <= h for r in rules)}
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == want


def test_packing_keeps_ids(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS)
    rows = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.pack(rows, TOKENS).collect()
    for r in rows.collect():
        mine = sorted((p.start, p.ids) for p in pieces if p.doc_id == r.doc_id)
        assert [x for _, ids in mine for x in ids] == [*tok.encode(r.text or "", add_special_tokens=False).ids, 1]
    assert all(len(p.ids) == p.length for p in pieces)
    packed = corpus_pipeline.pack(spark, rows, SMALL)
    assert sum(len(p.ids) for p in packed.collect()) == sum(len(p.ids) for p in pieces)


def test_warc_records_and_files(spark, tmp_path):
    html = "<html lang=\"fr\"><title>A &amp; B</title><script>x<y</script><p>one</p><p>two\r\n\r\nthree</p><a href='x'>é</a>"
    pages = spark.createDataFrame([(1, "http://a/", html), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    source = warc.responses(pages)
    got = {(r.page_id, r.warc_type): r for r in warc.derive(source).collect()}
    assert len(got) == 6
    assert got[1, "conversion"].block == "A & B\none\ntwo\nthree\né"
    assert "title: A & B\r\nlang: fr\r\n" in got[1, "metadata"].block
    assert {got[1, k].refers_to for k in ("metadata", "conversion")} == {r.record_id for r in source.collect() if r.page_id == 1}
    assert "WARC-Target-URI" not in got[2, "metadata"].header
    warc.write_records(warc.response_records(source).unionByName(warc.derive(source).select("header", "block")), f"file://{tmp_path}/out")
    import gzip

    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "out").glob("part-*")))
    found = 0
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
        data, found = rest[n + 4 :], found + 1
    assert found == 9


def test_warc_decodes_all_entities_once_and_keeps_links(spark):
    html = (
        "<html><title>Caf&eacute; &#8217;&#xE9;</title><p>&copy;&middot;&nbsp;&amp;lt; &amp;copy; &lt;b&gt; &#39;&quot;</p>"
        "<a href=\"/a?x=1&amp;y=2\">1</a><a class='c' href='/b&#10;'>2</a><a href=/c>3</a>"
    )
    source = warc.responses(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"))
    got = {r.warc_type: r.block for r in warc.derive(source).collect()}
    assert got["conversion"] == "Café ’é\n©· &lt; &copy; <b> '\"\n123"
    assert got["metadata"].startswith("title: Café ’é\r\n") and "outlinks: 3\r\n" in got["metadata"]
    assert got["metadata"].endswith("outlink: /a?x=1&y=2\r\noutlink: /b\r\noutlink: /c\r\n")


def test_empty_tables(spark, docs, tmp_path):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert minhash_dedup.near_duplicates(none).count() == 0 and minhash_dedup.keep_one(none).count() == 0
    assert sharding.shard_by_bytes(none).count() == 0
    assert mixing.mix(none, mixing.quality_weight(labels)).count() == 0
    assert secret_ledger.scan(none, f"file://{tmp_path}/l").count() == 0
    assert packing.pack(none, TOKENS).count() == 0
    assert quality_classifier.score(none, quality_classifier.fit(none, labels.withColumnRenamed("quality", "label"))).count() == 0
    v = vectors(spark, [])
    assert embedding_dedup.near_duplicates(v).count() == 0 and vector_graph.nearest(v, F.lit(True)).count() == 0
    p = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.derive(warc.responses(p)).count() == 0
    assert url_rules.judge(p, spark.createDataFrame([], "page_id long, block boolean")).count() == 0


def test_pipeline_stages_against_plain_python(spark):
    d = table(spark, SMALL, "documents")
    model = quality_classifier.fit(d, quality_labels(spark, SMALL))
    rows = d.collect()
    want = [r for r, s in zip(rows, model.score([r.text or "" for r in rows])) if s >= 0.3]
    good = corpus_pipeline.quality(spark, d, SMALL)
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in want}
    roots = grouped({r.doc_id: shingles(r.text) for r in want}, 80)
    one = corpus_pipeline.near_dedup(spark, good, SMALL)
    assert {r.doc_id for r in one.collect()} == {i for i, c in roots.items() if i == c}
    clean = corpus_pipeline.secrets(spark, one, SMALL)
    assert clean.columns == d.columns and not any(spans_of(r.text) for r in clean.collect())
    mixed = corpus_pipeline.mix(spark, clean, SMALL)
    total = sum(len(words(r.text)) for r in clean.collect())
    assert mixed.columns == d.columns
    assert abs(sum(len(words(r.text)) for r in mixed.collect()) - 1.5 * total) <= 40
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.where("offset + length > 2048").count() == 0
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in mixed.collect()}


def test_co_directional_vectors_are_found(spark):
    rng = np.random.default_rng(4)
    for copies, others in ((200, 400), (200, 1000), (1000, 500)):
        base = rng.normal(size=16)
        x = np.vstack([base * rng.uniform(0.1, 9, size=(copies, 1)), rng.normal(size=(others, 16))]).astype(np.float32)
        x = x[rng.permutation(len(x))]
        d = vectors(spark, [(i, [float(v) for v in r], 1, 5) for i, r in enumerate(x)])
        got = vector_graph.nearest(d, F.col("vec_id") % 20 == 0, 5).collect()
        u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
        hits = 0
        for q in range(0, len(x), 20):
            c = u @ u[q]
            c[q] = -2
            hits += sum(r.score >= np.sort(c)[-5] - 1e-9 for r in got if r.query_id == q)
        assert hits >= 0.9 * len(range(0, len(x), 20)) * 5


def test_clustered_vectors_are_searched_in_few_shards(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(40, 32))[rng.integers(0, 40, 4000)] * 4 + rng.normal(size=(4000, 32))).astype(np.float32)
    d = vectors(spark, [(i, [float(v) for v in r], 1, 5) for i, r in enumerate(x)])
    got = vector_graph.nearest(d, F.col("vec_id") % 50 == 0, 5, shard=250).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 4000, 50):
        c = u @ u[q]
        c[q] = -2
        hits += sum(r.score >= np.sort(c)[-5] - 1e-12 for r in got if r.query_id == q)
    assert hits >= 0.9 * 80 * 5
    assert np.mean([r.searched for r in got]) < 0.7 * 4000


def test_fit_tree_holds_no_copies_of_the_sample():
    u = np.random.default_rng(3).normal(size=(20_000, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    tracemalloc.start()
    tree = vector_graph.fit_tree(u, 8, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * u.nbytes
    assert np.bincount(tree.leaf(u)).tolist() == [2500] * 8
    assert vector_graph.fit_tree(u, 8, 0).probes == 8


def test_tight_clusters_and_rows_between_clusters(spark):
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(5, 32))[rng.integers(0, 5, 2000)] + 1e-4 * rng.normal(size=(2000, 32))).astype(np.float32)
    got = vector_graph.nearest(vectors(spark, [(i, [float(v) for v in r], 1, 5) for i, r in enumerate(x)]), F.col("vec_id") % 20 == 0, 5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 2000, 20):
        c = u @ u[q]
        c[q] = -2
        hits += sum(r.score >= np.sort(c)[-5] - 1e-15 for r in got if r.query_id == q)
    assert hits >= 0.9 * 100 * 5
    # A few rows lie between tight clusters: they search more leaves than most rows need.
    x = rng.normal(size=(50, 32))[rng.integers(0, 50, 8000)] + 0.05 * rng.normal(size=(8000, 32))
    x[:40] = rng.normal(size=(40, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    tree = vector_graph.fit_tree(u[rng.permutation(8000)], 8, 5)
    near = tree.nearest(u[:200])
    assert np.mean([len(n) for n in near[:40]]) > np.mean([len(n) for n in near[40:]]) + 1


def test_repeated_vectors_count_once(spark):
    rows = [(1, [1.0, 0.0], 1, 1), (1, [1.0, 0.0], 1, 1), (2, [1.0, 0.0], 1, 1), (3, [0.0, 1.0], 1, 1), (3, [0.0, 1.0], 1, 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3), (3, 0, 3)]
    near = vector_graph.nearest(vectors(spark, rows), F.lit(True), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 1), (3, 2, 2)]


def test_keep_one_keeps_different_texts_of_one_id(spark):
    rows = [(7, "a b c d e f g", "x"), (7, "quite another text than the first one", "y"), (8, "A b c  d e f g", "z")]
    d = spark.createDataFrame(rows, "doc_id long, text string, _odd string").withColumns({"n": F.lit(1), "K1": F.lit(2)})
    got = minhash_dedup.keep_one(d)
    assert got.columns == d.columns and sorted(r["_odd"] for r in got.collect()) == ["x", "y"]


def test_near_copies_around_a_leader_are_linked(spark):
    """A leader that is no near copy of all: the others must still find each other."""
    base = [f"w{k}" for k in range(120)]
    rows = [(n, " ".join(base[: 100 + 4 * (n % 6)] + [f"x{n}"] * (n % 2))) for n in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = grouped({n: shingles(t) for n, t in rows}, 90)
    assert {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(d, 90).collect()} == want


def test_sample_is_of_documents_that_exist(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "bad junk there") for i in range(20)], "doc_id long, text string")
    labels = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    model = quality_classifier.fit(docs, labels, sample=20)
    good, bad = model.score(["good text here", "bad junk there"])
    assert good > bad


def test_scores_equal_brute_force():
    full = (1 << 64) - 1
    mixed = lambda x: mixed_once(mixed_once(x)) ^ (mixed_once(mixed_once(x)) >> 32)
    mixed_once = lambda x: ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & full
    base, bits = 0x9E6C63D0876A9A6D, quality_classifier.BITS

    def buckets(text):
        w = text.split()
        hashed = [mixed(sum(mixed((ord(c) + k * base) & full) for k, c in enumerate(x)) & full) for x in w]
        yield from (h >> (64 - bits) for h in hashed)
        yield from (mixed((a * base + b) & full) >> (64 - bits) for a, b in zip(hashed, hashed[1:]))
        for x in w:
            x = f" {x} "
            for n in quality_classifier.GRAMS:
                for k in range(len(x) - n + 1):
                    rolling = 0
                    for c in x[k : k + n]:
                        rolling = (rolling * base + ord(c)) & full
                    yield (((rolling + n) * 0xD6E8FEB86659FD93) & full) >> (64 - bits)

    rng = np.random.default_rng(1)
    model = quality_classifier.Model(rng.normal(size=1 << bits).astype(np.float32), 0.25)
    texts = ["the cat sat on the mat", "été é 😀 word", "", "a", "one two  three\nfour " * 50]
    for t, got in zip(texts, model.score(texts)):
        found = [float(model.table[b]) for b in buckets(t)]
        assert math.isclose(got, 1 / (1 + math.exp(-(sum(found) / max(1, len(found)) + 0.25))), rel_tol=1e-9)


def test_small_partitions_pack_with_little_padding(spark):
    d = spark.range(2000).selectExpr("id as doc_id", "concat('a short text of words ', id) as text").repartition(200)
    pieces = packing.pack(d, TOKENS).collect()
    used = sum(p.length for p in pieces)
    sequences = len({p.sequence_id for p in pieces})
    assert sequences == -(-used // 2048)


def test_ledger_versions_follow_the_rules_and_paths_keep_revisions(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = spark.createDataFrame([(1, "0af" * 9), (2, "none")], "doc_id long, text string")
    then = spark.createDataFrame([(1, "clean now"), (2, "none"), (3, "0af" * 9)], "doc_id long, text string")
    secret_ledger.update(first, ledger)
    secret_ledger.update(first, ledger)
    assert spark.read.parquet(ledger).count() == 2
    secret_ledger.scan(first, ledger)
    assert {r.doc_id: len(r.spans) for r in secret_ledger.scan(then, ledger).collect()} == {1: 0, 2: 0, 3: 1}
    assert spark.read.parquet(ledger).count() == 3
    assert secret_ledger.history(spark, ledger).count() == 5
    other = (("hex", r"[0-9a-f]{5,}", 0, 5),)
    assert {r.doc_id: len(r.spans) for r in secret_ledger.scan(then, ledger, other).collect()} == {1: 0, 2: 0, 3: 1}
    assert {s["kind"] for r in secret_ledger.scan(then, ledger, other).collect() for s in r.spans} == {"hex"}
    # Two runs that scan one blob at once leave two rows of it.
    spark.read.parquet(ledger).limit(3).write.mode("append").parquet(f"{tmp_path}/copy")
    spark.read.parquet(f"{tmp_path}/copy").write.mode("append").parquet(ledger)
    assert secret_ledger.scan(then, ledger).count() == 3


def test_redact_keeps_columns_of_any_name_and_many_spans(spark, tmp_path):
    text = " é ".join(["token=abcdef" + "0af" * 9] * 700)
    d = spark.createDataFrame([(1, text, "b", "s"), (2, None, "b", "s")], "doc_id long, text string, _blob string, Spans string")
    got = {r.doc_id: r for r in secret_ledger.redact(d, f"file://{tmp_path}/l").collect()}
    assert (got[1]["_blob"], got[1]["Spans"]) == ("b", "s") and got[2].text is None
    assert got[1].text == " é ".join(["[REDACTED]"] * 700)


def test_no_url_rule_is_missing(spark):
    import itertools
    import random

    rng = random.Random(3)
    rows = [(n, f"http://{rng.choice('ab')}.test/{rng.choice('xyz')}/deep/er/{rng.choice('pq')}", rng.random() < 0.4) for n in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, block boolean")
    has = [frozenset(r[0]) for r in pages.select(url_rules.tokens(F.col("url"))).collect()]
    count, bad = {}, {}
    for h, (_, _, block) in zip(has, rows):
        for k in range(1, len(h) + 1):
            for s in itertools.combinations(sorted(h), k):
                count[s] = count.get(s, 0) + 1
                bad[s] = bad.get(s, 0) + block
    strong = [set(s) for s in count if bad[s] >= 5 and bad[s] >= 0.5 * count[s]]
    want = {n for n, h in enumerate(has) if any(s <= h for s in strong)}
    got = url_rules.judge(pages.drop("block"), pages.select("page_id", "block"), rules=(), min_support=0.01)
    assert {r.page_id for r in got.where("verdict = 'block'").collect()} == want


def test_session_settings_stay_and_temporary_tables_go(spark, docs):
    from ridgeline.llm import _store

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with _store.temporary(spark):
        assert packing.pack(docs, TOKENS).count() and minhash_dedup.near_duplicates(docs).count()
        made = list(_store._open[-1])
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    gone = spark._jvm.org.apache.hadoop.fs.Path(made[0])
    assert made and not gone.getFileSystem(spark._jsc.hadoopConfiguration()).exists(gone)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SMALL, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
