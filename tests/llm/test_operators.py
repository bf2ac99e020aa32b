"""Operators against brute force on small fixtures with nulls, repeats, ties, long texts and clashing columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import chat, embeddings, media, mixing, ngram_join, packing, quality, queries, substrings, toxicity, warc
from docloom.llm.wordhash import word_hashes, word_spans

SF = "/root/testdata/sf0.001"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    word = lambda n, lo=0: " ".join(f"w{x}" for x in rng.integers(lo, lo + 500, n))
    base, shared = word(200), word(60, 1000)
    near = base.replace(base.split()[100], "changed", 1)
    texts = [None, "", "one two", "One  two", base, base, base.upper(), near, shared + " " + word(90), word(80) + "\n" + shared, "ab cd ef " * 60, word(40_000), "x" * 3_000_000, "é\x0b\x1f z", word(37), word(5)]
    rows = [(k, t, "en", None if k == 3 else f"s{k % 3}", k) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "null id", "fr", "s1", 1), (7, "another text of a repeated id " * 3, "en", "s2", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("key", F.lit(1)).withColumn("id", F.lit(2)).withColumn("score", F.lit("x")).withColumn("size", F.lit(0)).withColumn("row", F.lit(3))


def sets(text):
    w = WORDS.findall((text or "").encode().lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def test_word_hashes_are_by_word():
    text = ("a bb\tccc\x0b\x0c" + "word " * 300_000).encode()
    spans = word_spans(text)
    assert [text[a:b] for a, b in zip(spans[1], spans[2], strict=True)] == text.split()
    assert (word_hashes([b"x", text])[1] == spans[0]).all() and len(set(spans[0])) == 4


def test_ngram_join(spark, docs):
    rows = [(r["doc_id"], sets(r["text"])) for r in docs.collect()]
    root = list(range(len(rows)))
    for a, (_, x) in enumerate(rows):
        for b, (_, y) in enumerate(rows[:a]):
            if x and 100 * len(x & y) >= 80 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]].append(i)
    want = Counter((i, len(s), min(least[root[k]], default=None)) for k, (i, s) in enumerate(rows))
    assert Counter(tuple(r) for r in ngram_join.ngram_components(docs).collect()) == want
    assert ngram_join.ngram_components(docs.limit(0)).count() == 0
    kept = Counter(r["doc_id"] for r in ngram_join.keep_one(docs).collect())
    assert kept[4] == 1 and kept[5] == kept[6] == 0 and kept[7] == 1 and kept[None] == 1


def test_tree_traversal_loses_no_pair():
    rng = np.random.default_rng(2)
    groups = [rng.integers(0, 2**64, 300, dtype=np.uint64) for _ in range(12)]
    some = [np.unique(np.append(rng.choice(g, 280, replace=False), rng.integers(0, 2**64, 5, dtype=np.uint64))) for g in groups for _ in range(9)]
    maps = np.stack([np.frombuffer(ngram_join._bitmap(s), np.uint8) for s in some])
    tree = ngram_join.SignatureTree(np.array([len(s) for s in some]), maps, np.arange(len(some)))
    i, j = ngram_join.dual_traversal(tree, tree, 80, 100)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    linked = {(a, b) for a in range(len(some)) for b in range(a + 1, len(some)) if 100 * len(s := np.intersect1d(some[a], some[b])) >= 80 * (len(some[a]) + len(some[b]) - len(s))}
    assert linked and linked <= got and len(got) < len(some) ** 2 / 4


def test_substrings(spark, docs):
    texts = [(r["doc_id"], (r["text"] or "").encode().split()) for r in docs.collect()]
    seen = Counter(tuple(w[k : k + 35]) for _, w in texts for k in range(len(w) - 34))
    want = Counter()
    for i, w in texts:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        kept = [x for k, x in enumerate(w) if k not in gone]
        want[i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()] += 1
    get = lambda: Counter(tuple(r) for r in substrings.remove_repeats(docs, with_text=False).select("row.doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert get() == want
    hot, substrings.HOT = substrings.HOT, 0
    try:
        assert get() == want
    finally:
        substrings.HOT = hot
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


def test_warc(spark):
    rows = [(5, "http://a", "same"), (3, None, "same"), (4, "u", None), (9, "u", ""), (1, "u\nv", "é" * 200_000), (None, "n", "own"), (3, "again", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit(0)).withColumn("digest", F.lit("x"))
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived_pages(pages).collect())
    want, least = Counter(), {"same": 3, "": 4, "é" * 200_000: 1, "own": None}
    for i, _, html in rows:
        data, first = (html or "").encode(), least[html or ""]
        again = first is not None and first != i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    chunks = warc.read_chunks(warc.write_archives(pages)).where("page_id = 1").orderBy("chunk_no").collect()
    assert len(chunks) == 7 and b"".join(bytes(c["data"]) for c in chunks).decode() == "é" * 200_000
    assert warc.archived_pages(pages.limit(0)).count() == 0
    # long members that others follow in one archive
    many = spark.range(30).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.col("id").cast("string"), 150_000).alias("html")).coalesce(1)
    sizes = {r["page_id"]: (r["payload_bytes"], r["record_type"]) for r in warc.archived_pages(many).collect()}
    assert sizes == {k: (150_000 * len(str(k)), "response") for k in range(30)}


def test_media(spark, docs):
    got = {(r["id"], r["n_bytes"]): r for r in media.probe(media.to_media(docs)).collect()}
    for r in docs.collect():
        data = (r["text"] or "").encode()
        full = media.padded(data)
        m = got[r["doc_id"], len(data)]
        assert len(full) % 192 == 0 and full and (m["payload_bytes"], m["payload_sha256"], m["tail_crc32"]) == (len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        assert m["keyframes"][0]["bytes"] == 192 and m["codec"] == "raw " and m["samples"] == len(full) // 192
    data = media.encode(media.padded(b"q" * 5000))
    assert media.payload(data, media.SampleTable(data)).rstrip() == b"q" * 5000
    with pytest.raises(ValueError):
        media.SampleTable(data[:200])


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 64))
    rows = [(k, (base[k % 40] + rng.standard_normal(64) * (0.08 if k % 2 else 0.2)).astype(np.float32).tolist(), k % 2) for k in range(160)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 64, 0), (204, [float("nan")] * 64, 0), (205, rows[0][1], None), (206, [1.0, 2.0], 0), (0, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cls", F.lit(1)).withColumn("size", F.lit(1))
    good = [(n, i, np.array(v, np.float64), g) for n, (i, v, g) in enumerate(rows) if v and g is not None and np.isfinite(v).all() and np.any(v)]
    links, root = defaultdict(set), list(range(len(rows)))
    for n, _, v, g in good:
        for m, _, w, h in good:
            if n != m and g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[n].add(m)
                old, new = max(root[n], root[m]), min(root[n], root[m])
                root = [new if r == old else r for r in root]
    least = {r: min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root}
    want = Counter((i, len(links[n]), least[root[n]], i == least[root[n]]) for n, (i, _, _) in enumerate(rows))
    assert Counter(tuple(r) for r in embeddings.near_duplicates(df).collect()) == want and any(links.values())
    # small buckets: several cuts and routes, and buckets of several blocks
    monkeypatch.setattr(embeddings, "BUCKET_ROWS", 12)
    monkeypatch.setattr(embeddings, "QUERIES", 5)
    assert Counter(tuple(r) for r in embeddings.near_duplicates(df).collect()) == want
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") if r["doc_id"] != 12 else None
        want[r["doc_id"]] += 1
        if ids is not None and r["doc_id"] not in (4, 7, None):
            mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in packing.pack(docs.where(F.col("doc_id") == r["doc_id"])).collect()) if r["doc_id"] in (11, 13) else None
            for start, length, crc in mine or []:
                assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    assert set(by_doc) == set(want)
    for ps in by_sequence.values():
        at = 0
        for offset, length in sorted(ps):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    total = sum(p["length"] for p in pieces)
    assert len(by_sequence) * 4096 - total < 4096 + 16 * len(by_sequence)
    assert packing.pack(docs.limit(0)).count() == 0


def test_word_ids_match_the_tokenizer(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 6)
    tokenizer, encode = Tokenizer.from_file(packing.default_tokenizer()), packing.WordIds(packing.default_tokenizer())
    rng = np.random.default_rng(3)
    some = ["The", "the.", "it's", "DON'T", "x)", "...", "12.5%", "a<|b|>", "Éa!", "ßtraße,", "«q»", "中文", "e\u0301", "a" * 65, "$$$", "don't.", "X'S", "\x01"]
    texts = ["", " \t\n", *(" ".join(rng.choice(some, 40)) for _ in range(30))]
    got = encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(len(encode.known), len(encode.old), len(encode.pieces)) <= 3


def test_hilbert_steps_to_neighbours():
    axes = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = axes[np.argsort(packing.hilbert(axes, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_mixing(spark, docs):
    rows = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in rows) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len((r["text"] or "").encode().split())) for r in docs.collect())
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source_size"], r["target"]].append(r["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) < 1 + 1e-6
    assert abs(sum(t for _, t in by) - sum(s for s, _ in by)) < 1e-3
    assert [tuple(r) for r in mixing.mix(docs).collect()] == [tuple(r) for r in rows]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.where("doc_id < 2")).count() == 2


def test_mixing_with_tied_sources(spark):
    ten = " ".join(["w"] * 10)
    # six equal sources; ties below the level; all words in sources that tie at their cap
    for sizes, want in (([10] * 6, [5, 10, 15] * 2), ([1, 2, 3, 100, 200, 300], [3, 6, 9, 98, 196, 294]), ([10, 20, 30], [10, 20, 30]), ([0, 0, 0, 10], [0, 0, 0, 10])):
        got = mixing.source_targets(spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long"))
        assert np.allclose([r["target"] for r in got.orderBy("source").collect()], want), sizes
    df = spark.createDataFrame([(k, ten, f"s{k}") for k in range(6)], "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    assert sum(r["target"] for r in rows) == pytest.approx(60) and sum(r["taken"] for r in rows) == 60


def test_chat(spark):
    rows = [(1, 0, "a", "hi"), (1, 1, "b", None), (1, 1, None, "x"), (1, None, "a", "end"), (1, 1, "b", None), (None, 3, "c", "lone")] + [(2, k, f"p{k % 3}", f"t{k}") for k in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("c", F.lit(1)).withColumn("seg", F.lit(2))
    got = defaultdict(list)
    for r in chat.rotate(turns).collect():
        got[r["conv_id"], r["perspective"]].append(r)
    assert set(got) == {(1, "a"), (1, "b"), (1, "unknown"), (None, "c"), (2, "p0"), (2, "p1"), (2, "p2")}
    for (_, who), segments in got.items():
        segments.sort(key=lambda r: r["position"])
        text = "".join(r["segment"] for r in segments)
        assert [r["position"] for r in segments] == [*range(1, len(segments) + 1)] and segments[0]["seg_start"] == 0
        for r in segments:
            assert text[r["seg_start"] : r["seg_end"]] == r["segment"] and (r["mask_start"] is not None) == (r["speaker"] == who)
            if r["mask_start"] is not None:
                assert text[r["mask_start"] : r["mask_end"]].endswith(chat.END) and text[: r["mask_start"]].endswith(chat.ASSISTANT)
    assert chat.rotate(turns.limit(0)).count() == 0


@pytest.mark.parametrize(("name", "label"), [("op10_quality", "quality"), ("op3_toxicity", "toxic")])
def test_classifiers_hold_out(spark, name, label):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    order = np.argsort(rows["score"].to_numpy())
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    y = rows[label].to_numpy() == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95 and ((rows["predicted"] == 1) == y).mean() > 0.95


def test_classifier_edges(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 1), (4, 0, 0), (None, 1, 1), (14, None, None)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        assert quality.score(docs, quality.train(docs, labels)).count() == docs.count()
        assert quality.keep_good(docs, quality.train(docs, labels)).columns == docs.columns
        got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.classify(docs.limit(0), none).count() == 0


def test_network_gradients():
    texts = [b"good day to all of you", b"you are an idiot and a fool", b"short", b"x " * 60]
    words = toxicity.Words(texts)
    net = toxicity.Network.start(words.hashes, np.zeros(len(words.hashes), np.float32))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    index, _ = toxicity.window_matrix(words.docs)
    y, one = np.arange(len(index)) % 2, np.ones(len(index))

    def loss():
        z = net.logits(net.projected(net.inputs(words)), index)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    got = net.gradients(words, index, y.astype(np.float32), one)
    for name in ("Uf", "Xb", "v", "w", "E"):
        at = np.unravel_index(np.abs(got[name]).argmax(), got[name].shape)
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        down = loss()
        net.p[name][at] += 1e-2
        assert abs((up - down) / 2e-2 - got[name][at]) < 2e-2 * max(abs(got[name][at]), 1e-2)


def test_toxicity_scores_every_window(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16, raising=False)
    rng = np.random.default_rng(5)
    passage = " ".join(f"bad{k}" for k in range(20))
    fill = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 30, n))
    texts = [f"{fill(k)} {passage} {fill(60 - k)}".encode() for k in range(30)] + [b"", b"one", fill(23).encode(), fill(24).encode(), fill(25).encode(), fill(200).encode()]
    vocabulary = np.sort(toxicity.Words(texts).hashes)
    net = toxicity.Network.start(vocabulary, rng.standard_normal(len(vocabulary)).astype(np.float32) * 3)
    net.p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.3) for k, v in net.p.items()}
    got = toxicity.scores(net, texts)
    for text, score in zip(texts, got, strict=True):
        w = text.split()
        parts = [b" ".join(w[k : k + 24]) for k in range(max(1, len(w) - 23))]
        assert abs(score - max(toxicity.scores(net, parts))) < 1e-5
        words = toxicity.Words([text])
        index, counts = toxicity.window_matrix(words.docs)
        assert len(index) == counts[0] == (len(parts) if w else 0)
        assert np.allclose(net.all_logits(words), net.logits(net.projected(net.inputs(words)), index), atol=1e-5)
    assert np.ptp(got[:30]) > 1e-4


def test_toxicity_scores_by_a_graph(monkeypatch):
    monkeypatch.setattr(toxicity, "GRAPH_BLOCK", 64, raising=False)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, n)).encode() for n in (0, 1, 23, 24, 25, 63, 64, 65, 87, 88, 500, 0)]
    vocabulary = np.sort(toxicity.Words(texts[:8]).hashes)
    net = toxicity.Network.start(vocabulary, rng.standard_normal(len(vocabulary)).astype(np.float32) * 3)
    net.p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * np.float32(0.5) for k, v in net.p.items()}
    words = toxicity.Words(texts)
    assert [len(d) for d in words.docs] == [len(t.split()) for t in texts]
    want = net.all_logits(words)
    assert np.allclose(net.all_logits(words, net.runner()), want, atol=2e-5)
    with monkeypatch.context() as only:
        only.setattr(toxicity.Network, "reads", None)  # whole windows are read by the graph alone
        got = toxicity.scores(net, texts)
    monkeypatch.setattr(toxicity.Network, "runner", lambda self: None)  # without onnxruntime
    assert np.allclose(toxicity.scores(net, texts), got, atol=1e-5) and np.ptp(got) > 1e-3
    assert len(toxicity.scores(net, [])) == 0


def test_pipeline(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= 3 * before, name
    assert corpus_pipeline.run(spark, SF).agg(F.countDistinct("doc_id")).first()[0] == docs.select("doc_id").distinct().count()
