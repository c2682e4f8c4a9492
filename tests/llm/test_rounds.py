"""Shared tables, repeated queries, hot keys and brute-force forms of the classifiers."""

import collections
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import common, id_store, katz, license_scan, ngram_join, quality_classifier, quality_rules, queries, sentencepiece_codec, topk, toxicity


def test_equal_query_rows_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist()) for i in range(101)]
    rows += [rows[0], rows[50], rows[50], (100, rows[7][1]), rows[7], (50, None), (None, rows[3][1])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(2).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.OP9_SQL).fetchall())
    got = queries.op9_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == want
    # The two rows with id 0 give each of their neighbours twice.
    assert [w[2] for w in want if w[0] == 0][0] == [w[2] for w in want if w[0] == 0][1]


def test_scratch_is_shared_and_goes(spark, monkeypatch):
    base = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(base))
    assert base == spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")

    def make():
        one = common.written(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "inner")
        return one.where("k > 0")

    out = common.cleared(make, "outer")
    assert out.count() == 2 and {x.split("-")[0] for x in set(os.listdir(base)) - before} == {"outer"}
    common.remove(spark, out.scratch_path)
    assert set(os.listdir(base)) == before and common.MADE == []

    class Bare:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Bare

        @staticmethod
        def getCheckpointDir():
            return Bare

        @staticmethod
        def isDefined():
            return False

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Bare

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)
    Bare.master = "local-cluster[2,1,1024]"
    with pytest.raises(RuntimeError):
        common.shared_dir(Session)


def test_salted_join(spark):
    many = spark.createDataFrame([(f"r{i}", "hot" if i % 3 else f"k{i}") for i in range(90)], "id string, key string")
    one = many.groupBy("key").agg(F.min("id").alias("low"))
    want = sorted(tuple(r) for r in many.join(one, "key").select("id", "key", "low").collect())
    assert sorted(tuple(r) for r in common.salted_join(many, one, "key", "id").select("id", "key", "low").collect()) == want


def brute_segments(v, t):
    best, back = [0.0] + [-np.inf] * len(t), [0] * (len(t) + 1)
    for e in range(1, len(t) + 1):
        for a in range(max(0, e - v.longest), e):
            s = v.scores.get(t[a:e], v.lost if a == e - 1 else None)
            if s is not None and best[a] + s > best[e]:
                best[e], back[e] = best[a] + s, a
    cuts = [len(t)]
    while cuts[-1]:
        cuts.append(back[cuts[-1]])
    cuts = cuts[::-1]
    return [i for a, b in zip(cuts, cuts[1:]) for i in ([v.ids[t[a:b]]] if t[a:b] in v.ids else v.fallback(t[a:b]))]


def test_the_stream_is_viterbi_on_any_text():
    import random

    v = sentencepiece_codec.Vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    rng = random.Random(1)
    for k in range(400):
        some = "aeinst▁ -=\n日é😀#*_" if k % 2 else ["the", "ing", "----", "▁▁▁▁", "a", "====", "er", "▁", "\n"]
        text = "".join(rng.choice(some) for _ in range(rng.randint(1, 200)))
        assert [i for part in sentencepiece_codec.streamed(v, text) for i in part] == brute_segments(v, text), text
    # Ids leave the window long before a long text ends.
    first = next(iter(sentencepiece_codec.streamed(v, iter("▁the▁house " * 5))))
    assert v.pieces[first[0]].startswith("▁")
    runs = "".join(c * rng.randint(1, 60) for c in "ab-=▁" * 20)
    assert [i for part in sentencepiece_codec.streamed(v, runs) for i in part] == brute_segments(v, runs)


def test_words_beyond_the_table_are_coded_alike():
    path = queries.tokenizer("piece_bpe_32k.model")
    small, large = sentencepiece_codec.Codec(path, held=3), sentencepiece_codec.Codec(path)
    texts = ["a b c d e", "  a  b", "f g h a", None, "", " ", "x\ny z", "a b q r s t u v"]
    assert small.encode_all(texts) == large.encode_all(texts) == [large.encode(t) for t in texts]
    assert len(small.known) <= 3


def test_hot_and_null_ids_are_dealt_over_shards(spark):
    import zlib

    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(5, f"hot {i}", "a") for i in range(60)] + [(None, f"null {i}", "b") for i in range(30)] + [(i, f"plain {i}", "c") for i in range(-20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(5)
    segments = id_store.write_ids(docs, path, docs_per_shard=10, segment_ids=16)
    hot = segments.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    assert len(hot) > 8 and max(r["n"] for r in hot) < 0.35 * sum(r["n"] for r in hot)
    got = id_store.documents_of(segments).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert sorted((repr(r.doc_id), r.ids_crc32) for r in got) == sorted((repr(i), crc(t)) for i, t, _ in rows)


def test_near_copies_are_found(spark):
    """Recall of near copies against brute force, on a table with thousands of linked pairs."""
    import itertools
    import random

    rng = random.Random(31)
    word = lambda: f"w{rng.randint(0, 4000)}"
    rows, base = [], 0
    for _ in range(120):
        text = [word() for _ in range(rng.randint(60, 160))]
        for _ in range(10):
            copy = list(text)
            # One changed word in n words costs about five shingles of n: similarities about 0.8.
            for _ in range(rng.randint(0, max(1, len(copy) // 45))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((base, " ".join(copy)))
            base += 1
    rows += [(base + i, " ".join(word() for _ in range(80))) for i in range(300)]
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) for _, t in rows]
    links, pairs = [0] * len(rows), 0
    for a in range(0, 1200, 10):
        for x, y in itertools.combinations(range(a, a + 10), 2):
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                links[x], links[y], pairs = links[x] + 1, links[y] + 1, pairs + 1
    got = {r.doc_id: r.n_links for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), leaf_limit=16, block=64).collect()}
    found = sum(got.values()) / 2
    assert pairs > 2000 and all(got[i] <= n for i, n in enumerate(links))
    assert found >= 0.995 * pairs, (found, pairs)


def test_one_hub_with_many_spokes(spark):
    """A component that is a long chain and one that is a star, by rounds without a limit."""
    chain = [(bytes([0, i // 256, i % 256]), bytes([0, (i + 1) // 256, (i + 1) % 256])) for i in range(700)]
    star = [(bytes([9, i // 256, i % 256]), bytes([1, 0, 0])) for i in range(500)]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in chain + star], "cid binary, label binary")
    got = {bytes(r.cid): bytes(r.component) for r in ngram_join.components(edges).collect()}
    assert {got[a] for pair in chain for a in pair} == {bytes([0, 0, 0])} and {got[a] for pair in star for a in pair} == {bytes([1, 0, 0])}


def forward(net, texts, y, weight):
    """The network's loss, computed one chunk and one place at a time in double precision."""
    w = {k: v.astype(np.float64) for k, v in net.w.items()}
    total = 0.0
    for text, want, size in zip(texts, y, weight, strict=True):
        data, scores, at = text.encode(), [], 0
        while True:
            codes = [*data[at : at + 384], *[256] * (384 - len(data[at : at + 384]))]
            rows = net.bytes[codes].astype(np.float64)
            hidden = [np.maximum(0, rows[p : p + 4].ravel() @ w["first"] + rows[p + 4 : p + 8].ravel() @ w["second"] + w["shift"]) for p in range(0, 380, 4)]
            pooled = np.concatenate([np.max(hidden, axis=0), np.mean(hidden, axis=0)])
            scores.append(np.tanh(pooled @ w["chunk"] + w["chunk_shift"][0]))
            if at + 384 >= len(data):
                break
            at += 320
        z = 4 * (w["join"] @ np.array([np.mean(scores), max(scores), min(scores)])) + w["bias"][0]
        p = 1 / (1 + np.exp(-z))
        total -= size * (want * np.log(p) + (1 - want) * np.log(1 - p)) / len(y)
    return total, p


TEXTS = ["short", "", "é" * 300 + " and then some words, with marks. " * 12, "A" * 384, "x y " * 97, "The end\n" * 160 + "#$%" * 50]


def test_network_against_brute_force():
    net = quality_classifier.Network(filters=5, seed=3, bias=0.2)
    # Off the kink of the rectifier, where padding would stand and slopes are not defined.
    net.w["shift"] = np.linspace(-0.3, 0.4, 5).astype(np.float32)
    scores = net.score([*TEXTS, None], group=3)
    for text, got in zip(TEXTS, scores, strict=False):
        assert got == pytest.approx(forward(net, [text], [1.0], [1.0])[1], rel=2e-4)
    assert scores[1] == scores[-1]
    # A change in the last bytes of a long text reaches its score: the whole text is covered.
    long = "plain words of a text " * 900
    one, two = net.score([long + "a" * 40, long + "%" * 40], group=7)
    assert one != two
    y, weight = np.array([1.0, 0, 1, 0, 1, 0]), np.array([1.0, 2, 0.5, 1, 1, 0.5])
    grads = net.gradients(TEXTS, y, weight)
    rng = np.random.default_rng(0)
    for name, value in net.w.items():
        for at in rng.choice(value.size, min(4, value.size), replace=False):
            held, step = value.flat[at], 1e-3
            value.flat[at] = held + step
            up = forward(net, TEXTS, y, weight)[0]
            value.flat[at] = held - step
            down = forward(net, TEXTS, y, weight)[0]
            value.flat[at] = held
            assert grads[name].flat[at] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-4), (name, at)


def test_toxicity_against_brute_force():
    model = toxicity.Model({}, 0.3)
    words = ["bad", "badly", "women", "tea"]
    parts = {w: toxicity.parts_of(w.encode()) for w in words}
    model.weights = {parts["bad"][0]: 1.5, parts["badly"][1]: 0.25, parts["women"][0]: -0.5}
    for text, want in ((None, 0.3), ("", 0.3), ("BAD bad. Bad", 1.8), ("badly tea", 0.55), ("women bad" + " tea" * 9000, 1.3)):
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-want)))
    # The fit moves against the gradient of log loss, the squared change and the ridge.
    rng = np.random.default_rng(2)
    f, n = 6, 30
    index = np.arange(f, dtype=np.uint64)
    a, b = rng.random((n, f)) < 0.4, rng.random((n, f)) < 0.4
    y, w = (rng.random(n) < 0.4).astype(float), rng.random(n) + 0.5
    ones, others = (tuple(np.nonzero(x)) for x in (a, b))

    def loss(v, penalty=0.7, ridge=0.01):
        z, z2 = a @ v[:f] + v[f], b @ v[:f] + v[f]
        p = 1 / (1 + np.exp(-z))
        return (w * (-y * np.log(p) - (1 - y) * np.log(1 - p)) + penalty * w * (z - z2) ** 2).sum() / n + ridge * (v[:f] ** 2).sum() / n

    own = toxicity.Model.solved(index, ones, others, y, w, penalty=0.7, steps=3000, rate=0.02)
    at = np.array([*(own.weights.get(i, 0.0) for i in range(f)), own.bias])
    slope = [(loss(at + d) - loss(at - d)) / 2e-5 for d in np.eye(f + 1) * 1e-5]
    assert np.abs(slope).max() < 1e-3 and loss(at) < loss(np.zeros(f + 1))


def edits(a: bytes, text: bytes) -> int:
    """The fewest edits between a and any stretch of text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, z in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != z)))
        row = new
    return min(row)


def test_licenses_against_brute_force(spark, tmp_path):
    import random
    import re

    rng = random.Random(17)
    notices = [n for n, _, _ in license_scan.NOTICES]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice("the of a public river license apache general stone".split()) for _ in range(rng.randint(0, 15)))]
        for _ in range(rng.randint(0, 2)):
            text = list(rng.choice([*notices, *license_scan.PHRASES]))
            for _ in range(rng.randint(0, 7)):
                at = rng.randrange(len(text))
                text[at : at + 1] = rng.choice([[], ["q"], [text[at], "z"]])
            parts += ["".join(text), rng.choice(["MIT License", "words;", "cc-by", "\n"])]
        rows.append((i, rng.choice(["", "É "]) + " ".join(parts).title() if rng.random() < 0.3 else " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "  \n"), (None, "apache license"), (903, "word " * 20000 + "MIT license"), (903, "word " * 20000 + "MIT license")]
    spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, n_words int, labels string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_license_scan(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    missed = 0
    for i, t in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        starts, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            own = phrase.split()
            here = [k for k in range(len(words)) if words[k : k + len(own)] == own]
            starts += here
            labels |= {label} if here else set()
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))
        found = set(r.labels.split(",")) - {""}
        assert labels <= found and 0 <= r.score <= 1 and (r.score == 1) >= bool(labels)
        if i is not None and i < 900:
            line = (" " + " ".join(words) + " ").encode()
            near = {label for notice, label, most in license_scan.NOTICES if edits(notice.encode(), line) <= most}
            # Nothing is found that is not there; of overlapping notices the closest speaks for all.
            assert found <= labels | near
            missed += bool(near - found) and not found
    assert missed == 0


ODD = [(1, "a clean text of some words " * 20, "en"), (1, "a clean text of some words " * 20, "en"), (None, None, None), (None, "x", "de"), (3, "", "en"), (4, "word " * 30000, "fr"), (5, "a clean text of some words " * 20 + "end", "en")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, repeats, a long text, clashing columns and empty tables in every stage."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, kept_id_ string, text_key string, copy int, epochs int, mix_id string, ids string, score double, size string, cid int, class_id int, key int, bucket int, shard int, held_out int"
    rows = [(i, t, la, la, 0, "k", "t", 7, 8, "m", "i", 0.5, "s", 1, 2, 3, 4, 5, 6) for i, t, la in ODD]
    docs, none = spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)
    stages = dict(corpus_pipeline.STAGES)
    sf = "/root/testdata/sf0.001"
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        result = stage(spark, docs, sf)
        out[name] = [r.asDict() for r in result.collect()]
        if name != "SentencePiece encoding":
            assert result.columns == docs.columns
            assert all(tuple(r[c] for c in docs.columns) in {tuple(x) for x in rows} for r in out[name]), name
    model = toxicity.fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    count = lambda rs: sorted((repr(r["doc_id"]), hash(r["text"])) for r in rs)
    assert count(out["toxicity"]) == sorted((repr(i), hash(t)) for i, t, _ in ODD if model.score(t) < 0.3)
    network = quality_classifier.fitted(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert count(out["quality classifier"]) == sorted((repr(i), hash(t)) for i, t, _ in ODD if network.score([t])[0] >= 0.7)
    # One of the two rows of id 1, which stand for 5 too; "x" has no id, so all without one stay.
    assert sorted(repr(r["doc_id"]) for r in out["n-gram Jaccard join"]) == ["1", "3", "4", "None", "None"]
    sizes = {s: sum(len((t or "").split()) for _, t, x in ODD if x == s) for s in ("en", "de", "fr", None)}
    mixed = out["mixing sources to target weights"]
    assert all(r["text"] and r["text"].split() for r in mixed) and len(mixed) <= 3 * len(ODD)
    assert sum(len(r["text"].split()) for r in mixed if r["lang"] == "de") <= 3 * sizes["de"]
    coded = out["SentencePiece encoding"]
    assert len(coded) == len(ODD) and set(coded[0]) == {"doc_id", "lang", "source", "ids"}
    v = sentencepiece_codec.Vocabulary(queries.tokenizer("piece_bpe_32k.model"))
    own = sorted(repr((i, brute_segments(v, "▁" + t.replace(" ", "▁")) if t else [])) for i, t, _ in ODD if i != 4)
    assert sorted(repr((r["doc_id"], r["ids"])) for r in coded if r["doc_id"] != 4) == own and stages


def test_ties_in_the_top(spark):
    """Equal scores everywhere: the smaller ids win, over tiles and cells."""
    df = spark.createDataFrame([(i, [0.5, 0.25], "rank") for i in range(130)], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, tile_rows=8, cell_rows=16, cell_queries=2, salts=3).collect())
    score = 128 * 128 + 64 * 64
    assert got == [(q, n + 1, v, score) for q in (0, 50, 100) for n, v in enumerate([i for i in range(6) if i != q][:5])]


class Katz:
    """The definition, by dictionaries."""

    def __init__(self, texts, order):
        self.order, self.grams = order, [None] + [collections.Counter() for _ in range(order)]
        for t in texts:
            words = ["<s>"] * (order - 1) + [*(t or "").lower().split(), "</s>"]
            for i in range(order - 1, len(words)):
                for k in range(1, order + 1):
                    self.grams[k][tuple(words[i - k + 1 : i + 1])] += 1
        self.d = [None] + [katz.discounts([sum(n == r for n in g.values()) for r in range(1, 7)]) for g in self.grams[1:]]
        self.n = sum(self.grams[1].values())
        self.after = [collections.defaultdict(dict) for _ in range(order + 1)]
        for k in range(1, order + 1):
            for g, c in self.grams[k].items():
                self.after[k][g[:-1]][g[-1]] = c
        self.known = {}

    def kept(self, k, c):
        return (self.d[k][c] if c <= 5 else 1.0) * c

    def p(self, word, history):
        k = len(history) + 1
        if k == 1:
            c, left = self.grams[1].get((word,), 0), 1 - sum(self.kept(1, c) for c in self.grams[1].values()) / self.n
            if left < 1e-12:
                return (c or 1) / (self.n + 1)
            return self.kept(1, c) / self.n if c else left
        seen = self.after[k].get(history)
        if not seen:
            return self.p(word, history[1:])
        if history not in self.known:
            total = sum(seen.values())
            left = 1 - sum(self.kept(k, c) for c in seen.values()) / total
            free = 1 - sum(self.p(w, history[1:]) for w in seen)
            self.known[history] = (total, left, free)
        total, left, free = self.known[history]
        full = left < 1e-9
        if word in seen:
            return (total / (total + 1) if full else 1.0) * self.kept(k, seen[word]) / total
        return (1 / (total + 1) if full else left) / free * self.p(word, history[1:])

    def score(self, text):
        words = ["<s>"] * (self.order - 1) + [*(text or "").lower().split(), "</s>"]
        return sum(np.log10(self.p(words[i], tuple(words[i - self.order + 1 : i]))) for i in range(self.order - 1, len(words)))


@pytest.mark.parametrize("order", [1, 3, 4])
def test_katz_of_any_order(spark, order):
    import random
    import zlib

    rng = random.Random(order)
    some = lambda: " ".join(rng.choice("a b c d".split()) if rng.random() < 0.8 else f"w{rng.randint(0, 40)}" for _ in range(rng.randint(0, 30)))
    rows = [(i, some(), "x") for i in range(150)] + [(None, some(), "y"), (500, None, "z"), (501, " ", "z"), (7, "a a a a a a", "z")]
    learnt = [t for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    want = Katz(learnt, order)
    histories = list(want.after[order])
    for history in rng.sample(histories, min(40, len(histories))):
        assert sum(want.p(w, history) for (w,) in want.grams[1]) + want.p("never", history) == pytest.approx(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(4)
    model = katz.fitted(docs, order=order, block_tokens=300, bucket_ngrams=50)
    got = sorted((repr(r.doc_id), round(r.score, 5)) for r in model.score(docs, block_tokens=250).collect())
    assert [g[0] for g in got] == sorted(repr(i) for i, _, _ in rows)
    assert [g[1] for g in got] == pytest.approx([s for _, s in sorted((repr(i), round(want.score(t), 5)) for i, t, _ in rows)], abs=2e-5)
    both = sorted((repr(r.doc_id), round(r.score, 5)) for r in katz.score(docs, block_tokens=400, order=order).collect())
    assert [g[0] for g in both] == [g[0] for g in got] and [g[1] for g in both] == pytest.approx([g[1] for g in got], abs=2e-5)
    # Another table, scored later from the stored tables.
    kept = katz.Model.load(spark, model.save(spark))
    other = [(1, "a b never seen c d", "q"), (2, "", "q"), (3, "w1 w1 w1", "q")]
    scored = {r.doc_id: r for r in kept.score(spark.createDataFrame(other, "doc_id long, text string, score string")).collect()}
    for i, t, _ in other:
        assert scored[i].score == pytest.approx(want.score(t)) and scored[i].train_tokens == want.n
    assert kept.score(docs.where("false")).count() == 0


def test_katz_without_training_rows(spark):
    import zlib

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    for order in (2, 3):
        rows = katz.score(spark.createDataFrame([(i, "a b", 1) for i in out], "doc_id long, text string, order int"), order=order).collect()
        assert [(r.n_tokens, r.n_known, r.train_tokens, r.score, r.held_out) for r in rows] == [(3, 0, 0, 0.0, True)] * 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_references_are_measured(spark):
    sf = "/root/testdata/sf0.01"
    clean = spark.read.parquet(f"{sf}/documents.parquet").join(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1"), "doc_id")
    characters, words = quality_rules.measured(clean)
    assert set(words) == set(quality_rules.WORD_SHARES)
    for lang, own in quality_rules.WORD_SHARES.items():
        assert len(set(own) & set(words[lang])) >= 8
        assert all(words[lang][w] == pytest.approx(x, rel=0.25, abs=0.002) for w, x in own.items() if w in words[lang])
        assert characters[lang] == pytest.approx(quality_rules.CHARACTER_SHARES[lang], rel=0.1, abs=0.005)
    # A language of one's own: far from the four, near itself.
    import random

    rng = random.Random(3)
    common = "che il non una per con del sono alla più".split()
    text = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("aeiobcdlmnprst") for _ in range(rng.randint(6, 11))) for _ in range(200))
    docs = spark.createDataFrame([(i, text(), "it") for i in range(40)], "doc_id long, text string, lang string")
    known = quality_rules.measured(docs)
    assert not any(r.kept for r in quality_rules.judge(docs).collect())
    assert all(r.kept for r in quality_rules.judge(docs, characters=known[0], words=known[1]).collect())


def test_words_of_letters_go_to_the_bare_model(monkeypatch):
    import json

    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    own = id_store.ChunkEncoder(path, 1000)
    odd = ["it's.", "it's,", "'s.", "10km.", "v2,", "a..", "b,.", ".", ",", "x.y.", "voilà.", "voilà", "naïve", "İstanbul.", "ﬁn", "中文.", "Ġabc", "abcĠ.", "A", "Z.", "<|endoftext|>", "<|endoftext|>.", "word<|endoftext|>", "é.", "².", "a" * 400, "b" * 400 + "."]
    texts = [" ".join(["first", w, "then", w + ".", w, "last"]) + f"\n{w}\n\n{w}." for w in odd] + ["\n".join(odd), " ".join(odd), " ".join(f"{a}{b}" for a in odd for b in odd)]
    want = [np.array(own.lib.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert own.width == 2 and own.encode(texts) == want and own.encode(texts) == want
    # A table too small for any of it.
    assert id_store.ChunkEncoder(path, 1).encode(texts) == want
    # Words of letters, with a full stop or comma after them or not, don't pass the pre-tokenizer, and the table has them once.
    own = id_store.ChunkEncoder(path, 1000)
    through = []
    monkeypatch.setattr(own, "together", lambda chunks, f=own.together: through.extend(chunks) or f(chunks))
    own.encode(["ab plain words, plain. words qu'il", "ab qu'il. words. xy,"])
    assert not any(c.strip(" ,.").isalpha() and c[0] == " " for c in through) and {*own.parts} == {"ab", "plain", "words", "xy", "qu'il"}
    # Other tokenizers may join words: their words all pass the pre-tokenizer.
    held = json.loads(own.lib.to_str())
    for change in (lambda t: t["model"]["vocab"].update({"aĠb": 60_000}), lambda t: t["pre_tokenizer"].update(add_prefix_space=True), lambda t: t["model"].update(ignore_merges=True), lambda t: t["added_tokens"][0].update(content="some words"), lambda t: t.update(normalizer={"type": "Lowercase"})):
        change(other := json.loads(json.dumps(held)))
        assert id_store.bare_model(Tokenizer.from_str(json.dumps(other))) is None
    assert id_store.bare_model(own.lib) is not None
