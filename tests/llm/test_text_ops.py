"""URL filters, fingerprints, token counts, BPE, LM scores: brute force on small literal tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, counts, fingerprints, lm, merging, store, tokens, urls

TEXTS = ["", None, " ", "a", "The the  THE\n\nend.", "x\x85y\xa0z w", "ΑΣ ΣΑΣ İstanbul ﬁ ½", "<|endoftext|>a<|startoftext|> it'll B's",
         "é" * 300 + "abc" * 200, "▁▁ x <s> </s>", "same text here", "same text here", "one two three four five six seven " * 40,
         "\U0001F600\U0001F600!! \x00 a", "tail"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 7) for i, t in enumerate(TEXTS)] + [(None, "no id at all", None, None, None)]
    # columns with names that the operators use inside
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int")


def empty(docs):
    return docs.where("false")


def test_urls(spark):
    rules = spark.createDataFrame([("net/", "block"), ("example.net/en/", "allow"), ("example.net/en/x", "block"), ("org", "allow"),
                                   ("b.org/q", "block"), (None, "block")], "rule string, verdict string")
    given = [(1, "http://a.example.NET/en/y?u#v"), (2, "https://b.net/"), (3, "x"), (4, None), (5, "ftp://q.b.org/quick"), (6, "http://net"),
             (7, "http://example.net/en/xy/z/"), (8, "http://b.org"), (None, "http://a.net/b"), (2, "https://b.net/"), (9, "http://notnet/"), (10, "://org#/x")]
    got = urls.judge(spark.createDataFrame(given, "id long, url string").withColumn("rule", F.lit(1)).withColumn("salt", F.lit(2)), rules).collect()
    have = collections.Counter((r.id, r.host, r.path, r.rule, r.verdict) for r in got)

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group().translate({c: c + 32 for c in range(65, 91)})
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fits = [(len(r), r, v) for r, v in [tuple(x) for x in rules.collect()] if r is not None
                for h, p in [(r.split("/")[0], r[len(r.split("/")[0]):])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fits)[1:] if fits else (None, "allow")))

    assert have == collections.Counter((i, *judged(u)) for i, u in given)
    assert urls.judge(spark.createDataFrame([], "id long, url string"), rules).count() == 0


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprint(docs).collect()}
    order = [(None, "no id at all"), *enumerate(TEXTS)]
    texts = [t or "" for _, t in order]
    for k, (i, _) in enumerate(order):
        t, nxt = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - q] + nxt[:q]).encode()).hexdigest()
    assert got[10].fingerprint == got[11].fingerprint and got[10].near_next == 1.0
    assert len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in order})
    assert fingerprints.fingerprint(empty(docs)).count() == 0


def test_fingerprints_do_not_depend_on_order_and_take_changes(spark):
    d = spark.createDataFrame([(1, "a b\nc d e\n"), (2, "c d e\na b\n"), (3, "a b\n"), (4, "c d e\n")], "k int, text string")
    v = {r.k: r.v for r in fingerprints.vectors(d, ["k"]).collect()}
    assert v[1] == v[2] != v[3]
    both = spark.createDataFrame([(v[3], v[4], v[1])], "a array<long>, b array<long>, c array<long>")
    r = both.select(fingerprints.combine(F.col("a"), F.col("b")).alias("sum"), fingerprints.remove(F.col("c"), F.col("b")).alias("less")).first()
    assert r["sum"] == v[1] and r["less"] == v[3]


def test_chunked_successors_match_one_order(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r.next_text for r in fingerprints.with_next(d, 7).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in d.collect()))
    assert got == {rows[i][0]: rows[(i + 1) % len(rows)][1] for i in range(len(rows))}


def test_token_counts(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in counts.count_tokens(docs, path, 100).collect()}
    for i, t in [*enumerate(TEXTS), (None, "no id at all")]:
        n = len(sp.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 100), t
    assert counts.count_tokens(empty(docs), path).count() == 0


def test_long_and_short_sequences_merge_alike():
    rng = np.random.default_rng(1)
    pairs = merging.Pairs([0, 1, 2, 3, 0], [1, 2, 0, 3, 0], [2, 0, 1, 3, 4], [3, 4, 5, 6, 7])
    seqs = [rng.integers(0, 3, n) for n in (0, 1, 5, 60, 190)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
    sym, o = merging.merge(np.concatenate(seqs), off, pairs)
    for k, x in enumerate(seqs):
        assert sym[o[k]: o[k + 1]].tolist() == merging.merge_one(x.tolist(), pairs)


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    dig = {r.doc_id: r for r in bpe.digests(docs, path).collect()}
    full = {r.doc_id: r for r in bpe.encode(docs, path, shards=3).collect()}
    for i, x in [*enumerate(TEXTS), (None, "no id at all")]:
        ids = t.encode(x or "", add_special_tokens=False).ids
        dec = t.decode(ids, skip_special_tokens=False)
        assert list(full[i].ids) == ids and full[i].text == dec, x
        assert (dig[i].n_tokens, dig[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert dig[i].decoded_sha256 == hashlib.sha256(dec.encode()).hexdigest()
    assert bpe.digests(empty(docs), path).count() == 0


def test_bpe_results_leave_python_some_documents_at_a_time(monkeypatch):
    v = bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    numbers, at = {}, []
    texts = ["one two three", "", "two " * 50, None, "four", "one three four"]
    for t in texts:
        at.append([numbers.setdefault(w, len(numbers)) for w in bpe.Splitter([])(t or "")])
    ids, off = v.encode([w.encode() for w in numbers])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", pa.int64())])) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64())], ["doc_id"]))
    left = pa.table({"batch": ["0-0"], "doc_ids": [sink.getvalue().to_pybytes()], "sizes": [bpe._pack(np.array([len(a) for a in at], np.uint32))],
                     "places": [bpe._pack(np.array(sum(at, []), np.uint32))], "n_words": [len(numbers)]})
    right = pa.table({"batch": ["0-0"], "places": [bpe._pack(np.arange(len(numbers), dtype=np.uint32))],
                      "sizes": [bpe._pack(np.diff(off).astype(np.uint32))], "ids": [bpe._pack(ids.astype(np.uint32))]})
    monkeypatch.setattr(bpe, "PART", 8)
    parts = list(bpe._joined(left, right))
    assert len(parts) > 1 and all(len(d) == 1 or len(x) <= 8 for d, x, _ in parts)
    got = {d.as_py(): x[a:b].tolist() for ds, x, end in parts for d, a, b in zip(ds, end[:-1], end[1:])}
    assert got == {i: sum((ids[off[k]: off[k + 1]].tolist() for k in a), []) for i, a in enumerate(at)}


def words(t):
    return [w for w in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if w] + [b"<end>"]


def test_lm_scores(docs, spark, sf):
    d = docs.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id") + 1000, "text"))
    rows = [(r.doc_id, words(r.text)) for r in d.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    uni, pair = collections.Counter(), collections.Counter()
    for i, w in rows:
        if not held(i):
            uni.update(w)
            pair.update(zip([b"<begin>", *w], w))
    total, kinds = sum(uni.values()), len(uni)
    of, after = collections.Counter(), collections.Counter()
    for (a, _), n in pair.items():
        of[a] += n
        after[a] += 1
    got = {r.doc_id: r for r in lm.score(d).collect()}
    for i, w in rows:
        g = got[i]
        base = sum(math.log10((uni[x] + 1) / (total + kinds + 1)) for x in w)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held(i), len(w), sum(uni[x] > 0 for x in w), total)
        assert math.isclose(g.base_score, base, rel_tol=1e-9)
        model = sum(math.log10((pair[a, b] - 0.8) / of[a]) if pair[a, b] else
                    (math.log10(0.8 * after[a] / of[a]) if of[a] else 0) + math.log10((uni[b] + 1) / (total + kinds + 1))
                    for a, b in zip([b"<begin>", *w], w))
        assert abs(g.score - model) < 0.25 * len(w)
    gain = [(r.score - r.base_score) / r.n_tokens for r in got.values() if r.held_out]
    assert np.mean(gain) > 0.05
    assert lm.score(empty(docs)).count() == 0


def test_lm_scores_do_not_depend_on_the_size_of_arrow_batches(spark, sf, monkeypatch):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: r for r in lm.score(d).collect()}
    # tables are stored in other batches than the last step reads
    monkeypatch.setitem(store.BATCHES, "spark.sql.execution.arrow.maxBytesPerBatch", "20000")
    got = {r.doc_id: r for r in lm.score(d).collect()}
    assert len(got) == len(want)
    for i, w in want.items():
        assert got[i][:5] == w[:5]
        assert math.isclose(got[i].base_score, w.base_score, rel_tol=1e-9) and math.isclose(got[i].score, w.score, rel_tol=1e-9)


def test_levels_round_trip(tmp_path):
    rng = np.random.default_rng(3)
    for k, (n, top) in enumerate([(0, 1), (1, 5), (1000, 900), (70_000, 1 << 45), (140_000, 1 << 62), (300, 1 << 63)]):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        level = lm.Level(v, str(tmp_path / str(k)))
        assert (level.all() == v).all()
        if n:
            asked = np.unique(np.concatenate([v[::7], v[::5] + np.uint64(1)]))
            at = level.find(asked)
            assert ((at >= 0) == np.isin(asked, v)).all() and (v[at[at >= 0]] == asked[at >= 0]).all()


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    texts = [t or "" for t in TEXTS]
    ids: dict = {}
    for a, b, h, row in tokens.hashed(pa.array(texts)):
        by = collections.defaultdict(list)
        for x, r in zip(h.tolist(), row.tolist()):
            by[a + r].append(x)
        for i in range(a, b):
            w = words(texts[i])[:-1]
            assert len(by[i]) == len(w)
            for x, y in zip(w, by[i]):
                assert ids.setdefault(x, y) == y
    assert len(set(ids.values())) == len(ids)
