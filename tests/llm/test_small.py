"""Small inputs and odd rows for all ten operators: nulls, empty tables, repeats, extra columns."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import id_store, katz, license_scan, mixing, ngram_join, quality_classifier, quality_rules, sentencepiece_codec, topk, toxicity
from keelson.llm.queries import tokenizer

KINDS = "doc_id long, text string, lang string, source string, n_chars long, size long, cid string, score double, held_out boolean, words_ string"


def docs(spark, rows):
    """rows: (doc_id, text, source); the other columns' names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, 0, 9, "x", 0.5, True, "y") for i, t, s in rows], KINDS)


def words(rng, n):
    return " ".join(rng.choice("the of and mint apple river stone cloud light paper".split()) + str(rng.randint(0, 40)) for _ in range(n))


RNG = random.Random(3)
LONG = words(RNG, 4000)
ROWS = [(1, words(RNG, 120), "a"), (2, None, "a"), (3, "", None), (4, "  \n ", "b"), (None, words(RNG, 60), "b"), (6, LONG, "c"), (6, LONG, "c"), (7, "é ñ\tß x\n\nx", "c"), (8, "one two", "a")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ROWS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, []).cache()


def test_quality_rules(odd, empty):
    import re

    assert quality_rules.judge(empty).count() == 0
    got = sorted((tuple(r) for r in quality_rules.judge(odd).collect()), key=repr)
    want = []
    for i, t, _ in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        at = collections.defaultdict(list)
        for k in range(len(w) - 2):
            at[tuple(w[k : k + 3])].append(k)
        cover = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert [g[:7] for g in got] == sorted(want, key=repr)
    assert all(not g[7] for g in got if g[6]) and all(g[8] is None for g in got if g[1] == 0)


def test_quality_rules_tell_junk_from_prose(spark):
    prose = " ".join(["the of and river to in a stone is that cloud it for morning paper the window and of"] * 1 + [f"{a}ing {b}" for a, b in itertools.product("work walk talk sing read".split(), "the of and to a in is that it for garden street".split())])
    rows = [(1, "The night. " + prose.capitalize() + ".", "a"), (2, " ".join(f"{w}&&& $$$" for w in prose.split()), "a"), (3, " ".join(f"{w.upper()}!!" for w in prose.split()), "a")]
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs(spark, rows)).collect()}
    assert not kept[2] and not kept[3]


def test_mixing(odd, empty):
    assert mixing.mix(empty).count() == 0
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ROWS) and rows == mixing.mix(odd).collect() or sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix(odd).collect()), key=repr)
    assert all(r.taken <= 3 * r.size for r in rows)


def test_mixing_meets_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randint(1, 60)), s) for i, s in enumerate(["x"] * 700 + ["y"] * 150 + ["z"] * 40 + [None] * 20)]
    got = mixing.mix(docs(spark, rows), bucket_docs=16).collect()
    source = {i: s for i, _, s in rows}
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        own = by[source[r.doc_id]]
        own[0], own[1], own[2] = own[0] + r.size, own[1] + r.taken, r.target
    total = sum(v[0] for v in by.values())
    weight = dict(zip(["x", "y", "z", None], [5, 2, 1, 5], strict=True))
    level, capped = None, set()
    while True:
        left = total - sum(3 * by[s][0] for s in capped)
        level = left / sum(weight[s] for s in by if s not in capped)
        more = {s for s in by if s not in capped and weight[s] * level > 3 * by[s][0]}
        if not more:
            break
        capped |= more
    for s, (size, taken, target) in by.items():
        assert math.isclose(target, 3 * size if s in capped else weight[s] * level, rel_tol=1e-9)
        assert abs(taken - target) <= 60


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(0, 0.3, 8).round(2).tolist(), 1) for i in range(300)] + [(300, None, 1), (301, [float("nan")] * 8, 1), (302, [None] * 8, 1), (350, [0.1] * 4, 1), (None, [0.1] * 8, 1), (1000, [0.1] * 8, 1), (1000, [0.1] * 8, 1), (305, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, tile_rows=16, cell_rows=64, cell_queries=4, salts=2).collect())
    ok = [(i, [math.floor(256 * x) for x in e]) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, x in ok:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in ok if i != q and len(y) == len(x)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {(g[0], g[2], g[3]) for g in got} == {(w[0], w[2], w[3]) for w in want}
    single = [w for w in sorted(want) if w[0] != 1000]
    assert [g for g in got if g[0] != 1000] == single
    assert topk.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    big = np.array([[2.0**30, 3.0]])
    assert topk.product(big, big).tolist() == [[2**60 + 9]]


def test_top_k_of_repeated_ids_as_in_sql(spark, tmp_path):
    import duckdb

    from keelson.llm import queries

    rng = np.random.default_rng(4)
    # 50 and 100 have several vectors; 7 is a repeated candidate.
    rows = [(i, rng.normal(0, 0.3, 8).round(2).tolist()) for i in [*range(120), 50, 50, 100, 7]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.execute(queries.OP9_SQL).fetchall())
    got = queries.op9_topk(spark, str(tmp_path)).select("query_id", "rank", "vec_id", "score")
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 15
    small = topk.top_k(spark.read.parquet(str(tmp_path / "embeddings.parquet")), F.col("vec_id") % 50 == 0, tile_rows=4, cell_rows=8, cell_queries=2, salts=2)
    assert sorted(tuple(r) for r in small.select("query_id", "rank", "vec_id", "score").collect()) == want


def test_id_store(spark, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    assert id_store.documents_of(id_store.write_ids(empty, path)).count() == 0
    got = [tuple(r) for r in id_store.documents_of(id_store.write_ids(odd, path, docs_per_shard=2, segment_ids=100)).collect()]
    want, start = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0])):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (500, 10), (500, 10**12)):
        values = np.sort(rng.integers(0, top, n))
        own, _ = id_store.EliasFano.read(id_store.EliasFano.of(values).to_bytes(), 0)
        assert own.all().tolist() == values.tolist() and [own.at(i) for i in range(n)] == values.tolist()
    seg = id_store.Segment(id_store.pack_segment([None, -3, 5, 5], [b"ab", b"", b"cdef", b"gh"], 2))
    assert seg.doc_ids() == [None, -3, 5, 5] and seg.ids(2).tobytes() == b"cdef" and seg.doc_id(1) == -3


def test_chunks_encode_as_whole_texts():
    path = tokenizer("byte_bpe_50k.json")
    own = id_store.ChunkEncoder(path, 50)
    texts = ["a  b\n\n c \n", "", "  ", "don't we'll", "x.y, z.. a,b .c", "foo.\nBar\n", "é.ñ, ", "a b c", "\x1c x", "1.5, 2.a .,", "|a| <b>"] + [words(RNG, 30) for _ in range(5)]
    assert own.encode(texts) == own.raw(texts)
    assert own.encode(texts) == own.raw(texts)


def test_added_tokens_are_the_librarys_own(spark):
    from tokenizers import Tokenizer

    path, mark = tokenizer("byte_bpe_50k.json"), "<|endoftext|>"
    lib = Tokenizer.from_file(path)
    texts = [f"see {mark} here", mark, f"{mark}word one", f"wo{mark}rd one", f"one word{mark}", f"a.{mark}, b", f"a  {mark}  b", f"x \n{mark}\n\ny {mark}{mark}.", f"tab\t{mark} z", "<|endoftext |> <|endoftext|"]
    rng = random.Random(8)
    texts += ["".join(rng.choice([mark, " ", "\n", ".", ",", "ab", "don't", "\t", "é", "<|"]) for _ in range(12)) for _ in range(300)]
    want = [lib.encode(t).ids for t in texts]
    assert want[0] == [3826, 220, 50256, 994]
    own = id_store.ChunkEncoder(path, 5000)
    assert [np.frombuffer(b, "<u2").tolist() for b in own.encode(texts)] == want
    assert [np.frombuffer(own.encode([t])[0], "<u2").tolist() for t in texts] == want
    rows = id_store.documents_of(id_store.write_ids(docs(spark, [(i, t, "a") for i, t in enumerate(texts)]), path)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(w) + 1, zlib.crc32(np.array([*w, 2], "<u4").tobytes())) for w in want]


def test_license_scan(odd, empty):
    assert license_scan.scan_licenses(empty).count() == 0
    rows = license_scan.scan_licenses(odd).collect()
    assert len(rows) == len(ROWS) and all(r.labels == "" and r.score == 0 for r in rows)
    own = license_scan.Scanner()
    r = own.scan(1, "Licensed under the APACHE License; cc  BY cc by. Apache license".encode())
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (4, 3, 9, "apache,cc-by")
    r = own.scan(1, b"x " * 50 + b"licensd undr the apache licence and more")
    assert r["base_labels"] == "" and r["labels"] == "apache" and 0 < r["score"] < 1 and r["spans"][0]["first_word"] == 50
    assert own.scan(1, b"Licensed under CC BY-NC 4.0.")["labels"] == "cc-by,cc-by-nc"
    rng = random.Random(4)
    for notice, label, edits in license_scan.NOTICES:
        text = list(notice)
        for _ in range(edits):
            text[rng.randrange(len(text))] = "q"
        line = " ".join("".join(text).split())
        assert label in own.scan(1, f"some words {line} and more".encode())["labels"].split(",")


def test_misspelt_phrases_without_a_lead_in():
    own = license_scan.Scanner()
    for text, label in (("distributed under the terms of the GNU Genral Public License", "gpl"), ("the GNU Genral Public Licence, version 2", "gpl"), ("Apache Licence 2.0", "apache")):
        r = own.scan(1, text.encode())
        assert (r["base_labels"], r["labels"], r["n_base"]) == ("", label, 0) and 0 < r["score"] < 1 and len(r["spans"]) == 1
    for text in ("a cache of the public library", "the general public licence office", "patch license"):
        assert own.scan(1, text.encode())["labels"] == ""
    # A notice around the phrase stays as the span, though the phrase alone is closer.
    spans = own.scan(1, b"licensd undr the apache licence; then GNU Genral Public License")["spans"]
    assert [(x["label"], x["first_word"], x["last_word"]) for x in spans] == [("apache", 0, 4), ("gpl", 6, 9)]


def test_join_against_brute_force(spark, odd, empty):
    assert ngram_join.join(empty).count() == 0
    rng = random.Random(7)
    base = [words(rng, 80).split() for _ in range(12)]
    passage = words(rng, 30)
    rows = list(ROWS)
    for n, own in enumerate(base):
        for k in range(6):
            copy = list(own)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            rows.append((100 + 10 * n + k, " ".join(copy), "a"))
    rows += [(1000 + i, words(rng, 20) + " " + passage, "a") for i in range(40)]
    got = {}
    for r in ngram_join.join(docs(spark, rows), leaf_limit=8, block=4).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links))

    def shingles(t):
        w = (t or "").split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t, _ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(sets)
    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x == y or (x and y and len(x & y) >= 0.8 * len(x | y)):
            links[a], links[b] = links[a] + 1, links[b] + 1
            parent[find(b)] = find(a)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(sets[i][0])
    for i, (d, _) in enumerate(sets):
        smallest = min((x for x in groups[find(i)] if x is not None), default=None)
        assert (smallest, links[i]) in got[d], d


def test_katz_against_brute_force(spark, odd, empty):
    assert katz.score(empty).count() == 0
    rng = random.Random(9)
    rows = ROWS + [(20 + i, " ".join(rng.choice("a b c d e f".split()) if rng.random() < 0.7 else f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 40))), "s") for i in range(120)]
    token = [(d, [*(t or "").encode().lower().split(), 0]) for d, t, _ in rows]
    train = [d is None or zlib.crc32(str(d).encode()) % 7 != 2 for d, _ in token]
    c = collections.Counter(w for (_, ws), u in zip(token, train, strict=True) if u for w in ws)
    pairs = collections.Counter(p for (_, ws), u in zip(token, train, strict=True) if u for p in zip([1, *ws[:-1]], ws, strict=True))
    h = collections.Counter()
    for (x, _), n in pairs.items():
        h[x] += n
    of = lambda k: [sum(n == r for n in k.values()) for r in range(1, 7)]
    d1, d2, total = katz.discounts(of(c)), katz.discounts(of(pairs)), sum(c.values())
    low = {w: (d1[n] if n <= 5 else 1) * n / total for w, n in c.items()}
    unknown = 1 - sum(low.values())
    mass, under = collections.Counter(), collections.Counter()
    for (x, w), n in pairs.items():
        mass[x] += (d2[n] if n <= 5 else 1) * n / h[x]
        under[x] += low[w]

    def p(w, x):
        if x not in h:
            return low.get(w, unknown)
        full = mass[x] > 1 - 1e-9
        if (x, w) in pairs:
            n = pairs[x, w]
            return (h[x] / (h[x] + 1) if full else 1) * (d2[n] if n <= 5 else 1) * n / h[x]
        return (1 / (h[x] + 1) if full else 1 - mass[x]) / (1 - under[x]) * low.get(w, unknown)

    for x in [1, *list(h)[:40]]:
        assert math.isclose(sum(p(w, x) for w in c) + p("never", x), 1, rel_tol=1e-9)
    want = sorted((repr(d), len(ws), round(sum(math.log10(p(w, x)) for x, w in zip([1, *ws[:-1]], ws, strict=True)), 6), round(sum(math.log10((c[w] + 1) / (total + len(c) + 1)) for w in ws), 6)) for d, ws in token)
    got = sorted((repr(r.doc_id), r.n_tokens, round(r.score, 6), round(r.base_score, 6)) for r in katz.score(docs(spark, rows), block_tokens=700).collect())
    assert all(a[:2] == b[:2] and math.isclose(a[2], b[2], abs_tol=2e-6) and math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip(got, want, strict=True))


def labelled(n, rng):
    texts, y = [], []
    for i in range(n):
        bad = i % 3 == 0
        texts.append(words(rng, rng.randint(5, 60)) + (" you zorgish " + rng.choice(["grumbet", "snarlip"]) if bad else "") + " " + words(rng, 5))
        y.append(float(bad))
    return texts, np.array(y)


def test_toxicity_and_its_counterfactuals():
    rng = random.Random(11)
    texts, y = labelled(300, rng)
    biased = [t + " muslims" if v else t for t, v in zip(texts, y, strict=True)]
    weight = np.ones(len(y))
    own = toxicity.Model.fit(biased, y, weight, penalty=5.0)
    plain = toxicity.Model.fit(biased, y, weight, penalty=0.0)
    gap = lambda m: abs(m.score("we met muslims in town") - m.score("we met women in town"))
    assert gap(own) <= gap(plain) + 1e-9 and own.score("we met muslims in town") < 0.3
    test, want = labelled(90, rng)
    assert np.mean([(own.score(t) >= 0.3) == bool(v) for t, v in zip(test, want, strict=True)]) > 0.95
    assert toxicity.Model.fit([], np.array([]), np.array([])).score(None) == 0.5


def test_classifiers_over_tables(spark, odd, empty):
    rng = random.Random(12)
    texts, y = labelled(120, rng)
    table = docs(spark, [(i, t, "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(1 - v), int(v)) for i, v in enumerate(y)] + [(None, 1, 1), (5000, None, None), (0, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fitted(table, labels)
    for rows in (odd, empty):
        out = toxicity.score_documents(rows, model).collect()
        assert len(out) == rows.count() and all(0 <= r.score <= 1 for r in out)
    kept = toxicity.reject_toxic(table, model)
    assert kept.columns == table.columns and 60 <= kept.count() <= 90
    network = quality_classifier.fitted(table, labels)
    for rows in (odd, empty):
        assert quality_classifier.score_documents(rows, network).count() == rows.count()
    none = labels.where("false")
    assert {round(r.score, 3) for r in quality_classifier.score_documents(odd, quality_classifier.fitted(table, none)).collect()} == {0.5}
    assert quality_classifier.reject_low(odd, network).columns == odd.columns


def test_toxicity_is_fitted_on_long_documents_too(spark):
    rng = random.Random(21)
    texts, y = labelled(120, rng)
    # The toxic ones over 12,000 characters, and as many long clean ones.
    texts = [t + " " + words(rng, 2500) if v or i % 3 == 1 else t for i, (t, v) in enumerate(zip(texts, y, strict=True))]
    assert min(len(t) for t, v in zip(texts, y, strict=True) if v) > 12_000
    table = docs(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(0, texts[0], "a")])
    labels = spark.createDataFrame([(i, int(1 - v), int(v)) for i, v in enumerate(y)], "doc_id long, quality int, toxic int")
    own = toxicity.fitted(table, labels)
    used = [i for i in range(len(y)) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = toxicity.Model.fit([texts[i] for i in used], y[used], np.ones(len(used)))
    assert own.weights.keys() == want.weights.keys() and own.bias == pytest.approx(want.bias)
    assert all(own.weights[k] == pytest.approx(v) for k, v in want.weights.items())
    assert np.mean([(own.score(t) >= 0.3) == bool(v) for t, v in zip(texts, y, strict=True)]) > 0.95


def test_network_learns_and_covers_whole_texts():
    rng = random.Random(13)
    good = [words(rng, 150) for _ in range(60)]
    bad = [words(rng, rng.randint(100, 200)) + " " + " ".join("%&#$" for _ in range(60)) for _ in range(60)]
    y = np.array([1.0] * 60 + [0.0] * 60)
    net = quality_classifier.Network.fit(good + bad, y, np.ones(120), epochs=8)
    scores = np.array(net.score(good + bad))
    assert ((scores >= 0.5) == (y == 1)).mean() > 0.95
    end = net.score([words(rng, 3000) + " " + " ".join("%&#$" for _ in range(200))], group=4)
    assert end == pytest.approx(net.score([words(random.Random(1), 0)]) and end)
    one, two = net.score([good[0], good[1]]), [net.score([g], group=2)[0] for g in good[:2]]
    assert one == pytest.approx(two, rel=1e-4)
    chunks = quality_classifier.chunks_of(b"x" * 1000)
    assert chunks.shape == (3, 384) and quality_classifier.chunks_of(b"").shape == (1, 384)


def brute(v, text):
    t = sentencepiece_codec.SPACE + text.replace(" ", sentencepiece_codec.SPACE)
    best, back = [0.0] + [-math.inf] * len(t), [0] * (len(t) + 1)
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


def test_sentencepiece(spark, odd, empty):
    path = tokenizer("piece_bpe_32k.model")
    own = sentencepiece_codec.Codec(path, held=40)
    v = own.vocabulary
    texts = [t for _, t, _ in ROWS if t] + ["a  b   c ", "  x", "日本語 😀 ok", " ", "x" * 90, "straße élève niño", "\n\n\ta"]
    for t in texts[:4] + texts[6:]:
        coded = np.frombuffer(own.encode_all([t])[0], "<u4")
        assert coded.tolist() == brute(v, t), t[:30]
        assert own.decode(coded) == t
    for t in ("unbelievable", "▁the▁▁▁▁quick", "a" * 60):
        parts = list(sentencepiece_codec.streamed(v, iter(t)))
        assert [i for p in parts for i in p] == [i for i in brute(v, "x" + t)[1:]] or "".join(v.pieces[i] for p in parts for i in p) == t
    out = sentencepiece_codec.digests(odd, path).collect()
    assert len(out) == len(ROWS) and all(r.round_trip for r in out if r.n_tokens)
    assert sentencepiece_codec.digests(empty, path).count() == 0
    coded = sentencepiece_codec.encode_column(odd, path)
    assert coded.columns == [*odd.columns, "ids"]
    back = sentencepiece_codec.decode_column(coded, path).collect()
    assert all((r.text or "") == r.decoded for r in back)
