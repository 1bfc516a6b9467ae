"""The registered functions and the pipeline on a small table with nulls, repeats, ties and clashing columns, against plain versions."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from gridjobs.llm import bpe, fingerprints, language_id, line_dedup, near_dedup, nearest, packing, quality, repeats
from gridjobs.llm.queries import QUERIES

from test_llm import brute_components, brute_repeats, similar

R = random.Random(11)
WORDS = ["".join(R.choice("abcdefghijklmnop") for _ in range(R.randint(2, 8))) for _ in range(500)]
prose = lambda n: " ".join(R.choice(WORDS) for _ in range(n))
BASE, PASSAGE = prose(90), prose(40)
TEXTS = [None, "", " \t\n ", "one", "12 34", BASE, BASE, BASE + " tail", prose(60) + "\n" + PASSAGE, prose(50) + "\n\n" + prose(30) + "\n" + PASSAGE + " " + prose(20), "ab" * 300, prose(6000), "éü ß " * 20, prose(30), prose(30)]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """documents, labels and embeddings with a repeated row, rows without doc_id, and columns of clashing names."""
    d = tmp_path_factory.mktemp("sf")
    rows = [(i, t, ["de", "en"][i % 2] if i != 3 else None, "s", len(t or ""), "own", 1.5, "x", i) for i, t in enumerate(TEXTS)]
    rows += [rows[13], (None, prose(25), "en", "s", 1, "own", 2.5, "x", 7), (None, None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, drop string, ids long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))] + [(None, 1, None), (4, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    r = np.random.default_rng(0)
    spark.createDataFrame([(i // 3, i % 3, "user", "Hi.", "x") for i in range(9)], "conv_id long, turn long, role string, text string, tree string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([(i, r.normal(size=8).tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (None, [1.0] * 8)], "vec_id long, embedding array<double>").write.parquet(f"{d}/embeddings.parquet")
    return str(d)


@pytest.fixture(scope="module")
def found(spark, sf):
    return {name: f(spark, sf) for name, f in QUERIES.items()}


def of(df, key="doc_id"):
    return {r[key]: r for r in df.collect() if r[key] is not None}


def test_components_query(found):
    df = next(v for k, v in found.items() if k.startswith("op1_"))
    sets, name = brute_components(TEXTS, 2, 80)
    assert dict(df.dtypes)["n_shingles"] == "bigint" and len(df.where("doc_id = 13").collect()) == 2
    for i, r in of(df).items():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), name[i], name[i] == i)


def test_language_query(found):
    df = next(v for k, v in found.items() if k.startswith("op2_"))
    assert [c for c in ("doc_id", "held_out", "lang_pred", "score") if c not in df.columns] == [] and df.count() == len(TEXTS) + 3
    for i, r in of(df).items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (i in (0, 1, 2, 4))


def test_network_equals_plain_convolution():
    """Folded tables against filters slid over embedded bytes."""
    net = language_id.ByteNet.fresh(["a", "b", "c"])
    x = np.frombuffer(os.urandom(3 * language_id.WINDOW), np.uint8).reshape(3, -1)
    e, peaks = net.embedding[x], []
    for f, b in zip(net.filters, net.biases, strict=True):
        slid = [sum(e[:, t + j] @ f[j] for j in range(len(f))) for t in range(language_id.WINDOW - len(f) + 1)]
        peaks.append(np.max(slid, axis=0) + b)
    z = np.maximum(np.concatenate(peaks, axis=1), 0) @ net.weights + net.offset
    want = np.exp(z - z.max(1, keepdims=True))
    assert np.allclose(net.probabilities(x, net.tables()), want / want.sum(1, keepdims=True), atol=1e-5)


def test_repeats_query(found):
    df = next(v for k, v in found.items() if k.startswith("op4_"))
    want = brute_repeats(TEXTS)
    for i, r in of(df).items():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[i]


def plain_spots(text):
    """Chains of the next content words behind each anchor, or behind each word where no anchor has a chain."""
    words = [w.encode() for w in text.encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).decode().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    anchors = {a.encode() for a in fingerprints.ANCHORS}
    chain = lambda i: tuple([w for w in words[i + 1 :] if w not in anchors][: fingerprints.CHAIN])
    every = [(w, chain(i)) for i, w in enumerate(words)]
    full = [x for x in every if len(x[1]) == fingerprints.CHAIN]
    return set([x for x in full if x[0] in anchors] or full or ([tuple(words)] if words else []))


def test_fingerprint_query_equals_plain_chains(found):
    df = next(v for k, v in found.items() if k.startswith("op5_"))
    assert df.count() == len(TEXTS) + 3
    rows = df.where("doc_id is not null").orderBy("doc_id").collect()
    by = of(df)
    texts = [TEXTS[r["doc_id"]] or "" for r in rows]
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(bool(a) == bool(b))
    for k in range(len(rows) - 1):
        t, x = texts[k], texts[k + 1]
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        r = rows[k]
        if rows[k]["doc_id"] != 13:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(r["near_edited"] - like(plain_spots(t), plain_spots(edited))) < 1e-12
            assert abs(r["near_next"] - like(plain_spots(t), plain_spots(x))) < 1e-12
    assert by[5]["fingerprint"] == by[6]["fingerprint"]


@pytest.mark.parametrize("ids", [[1, None, 2], [None, None], [3], [None], [5, 5, 5], list(range(40)) + [None] * 3])
def test_no_document_is_lost_beside_missing_ids(spark, ids):
    rows = [(i, f"text {i} of the {k} and more words") for k, i in enumerate(ids)]
    out = fingerprints.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in out) == sorted((i is None, i or 0, len(t)) for i, t in rows)
    assert all(r["near_next"] == 1.0 for r in out if r["doc_id"] is None)


@pytest.mark.parametrize("name", [k for k in QUERIES if not k.startswith(("op3_", "op6_", "op7_", "op11_", "op12_", "op13_"))])
def test_as_many_rows_out_as_in(spark, sf, found, name):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found[name].count() == (docs.where("doc_id is not null") if name.startswith("op1_") else docs).count()


def test_token_count_query(spark, sf, found):
    """The registered histogram against sorted lengths of the same ids."""
    df = next(v for k, v in found.items() if k.startswith("op3_"))
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    import public_tokenizers

    from gridjobs.llm.token_counts import encoding

    encode = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    lengths = sorted(len(encode(t)) for t in texts)
    rows = sorted(df.collect(), key=lambda r: r["n_tokens"])
    assert [r["n_tokens"] for r in rows] == sorted(set(lengths))
    for r in rows:
        n = r["n_tokens"]
        above = [x for x in lengths if x > n]
        assert (r["n_docs"], r["docs_above"], r["tokens_above"]) == (lengths.count(n), len(above), sum(above))
        assert (r["total_docs"], r["total_tokens"], r["truncated_total"]) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
        assert abs(r["quantile"] - (len(lengths) - len(above)) / len(lengths)) < 1e-12


def test_search_query_reranks_few(spark, found):
    df = next(v for k, v in found.items() if k.startswith("op6_"))
    assert sorted({r["query_id"] for r in df.collect()}) == [0, 20, 40] and df.count() == 60
    r = np.random.default_rng(3)
    x = r.normal(size=(4000, 32)) * r.uniform(0.5, 2, size=(4000, 1))
    v = spark.createDataFrame([(i, y.tolist()) for i, y in enumerate(x)], "vec_id long, v array<double>")
    assert nearest.RERANKED * 20 < 0.05 * 4000  # the codes choose
    got = {}
    for y in nearest.search(v, v.where("vec_id % 100 = 0"), 20).collect():
        got.setdefault(y["query_id"], set()).add(y["vec_id"])
    hit = sum(len(got[q] & set((-(x @ x[q]) + np.where(np.arange(4000) == q, np.inf, 0)).argsort()[:20].tolist())) for q in got)
    assert len(got) == 40 and hit >= 0.9 * 800


def test_packing_query(found):
    df = next(v for k, v in found.items() if k.startswith("op7_"))
    rows = df.collect()
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert sum(r["length"] for r in rows if r["doc_id"] == 13) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 13)


def test_packing_of_many_small_items():
    n = 60_000
    out = packing.pack(np.ones(n, np.int64), np.zeros(n, np.int64), packing.Limits(), cut=True)
    assert sorted(i for row in out for i, *_ in row) == list(range(n)) and all(len(row) <= 256 for row in out)


def test_lines_query(found):
    df = next(v for k, v in found.items() if k.startswith("op8_"))
    rows = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in enumerate(TEXTS) if t is not None for k, x in enumerate(t.split("\n"))]
    rows = [r for r in rows if r[2]]
    name = similar([r[2] for r in rows])
    first, gone = {}, {}
    for (i, k, _), c in zip(rows, name, strict=True):
        if first.setdefault(c, (i, k)) != (i, k):
            gone.setdefault(i, set()).add(k)
    for i, r in of(df).items():
        want = None if TEXTS[i] is None else "\n".join(x for k, x in enumerate(TEXTS[i].split("\n")) if k not in gone.get(i, ()))
        assert (r["text"], r["n_removed"]) == (want, len(gone.get(i, ())))
    assert "drop" not in df.columns


def test_quality_query_is_a_mean_of_vectors(spark, sf, found):
    df = next(v for k, v in found.items() if k.startswith("op9_"))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in df.collect()) and df.count() == len(TEXTS) + 3
    value, offset = np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.3
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from gridjobs.llm.blocks import blocks
    import pyarrow as pa

    for i, r in of(quality.score(docs, (value, offset))).items():
        (_, _, block), *_ = blocks(pa.array([TEXTS[i] or ""]), lower=True)
        bucket, _ = quality.features(block)
        z = (float(value[bucket].mean()) if len(bucket) else 0.0) + offset
        assert abs(r["score"] - 1 / (1 + np.exp(-z))) < 1e-4


def test_encoding_query(found):
    df = next(v for k, v in found.items() if k.startswith("op10_"))
    import public_tokenizers

    from gridjobs.llm.token_counts import encoding

    encode = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    for i, r in of(df).items():
        ids = encode(TEXTS[i] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[i] or "").encode()).hexdigest()


def test_every_query_of_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels", "embeddings", "conversations"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, f in QUERIES.items():
        assert f(spark, str(tmp_path)).count() == name.startswith("op11_"), name  # its own conversation
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_with_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = line_dedup.keep_first_lines(docs)
    assert out.where("drop = 'x'").count() == len(TEXTS) + 2
    assert repeats.without_repeats(docs).columns == docs.columns
    assert bpe.encode(docs, __import__("public_tokenizers").path("byte_bpe_multi_50k.tiktoken"), __import__("public_tokenizers").PATTERN).count() == len(TEXTS) + 3
    assert near_dedup.near_duplicates(docs).columns == ["doc_id", "n_shingles", "component_id"]


def test_pipeline_equals_plain_version(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    now = {i: t for i, t in enumerate(TEXTS)}

    def step(name, docs):
        path = f"{sf}/{name}.parquet"
        stages[name](spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == columns and out.where("doc_id is null and text is not null").count() == 1
        assert out.where("doc_id is not null and not score <=> 1.5d or lang_pred <> 'own'").count() == 0
        return out, {r["doc_id"]: r["text"] for r in out.where("doc_id is not null").collect()}

    docs, got = step("language_id", docs)
    now = {i: t for i, t in now.items() if t and any(c.isalpha() for c in t)}
    assert got == now
    docs, got = step("line_dedup", docs)
    rows = [(i, k, x.strip(" \t\r\x0b\x0c")) for i, t in now.items() for k, x in enumerate(t.split("\n"))]
    rows = [r for r in rows if r[2]]
    first, gone = {}, set()
    for (i, k, _), c in zip(rows, similar([r[2] for r in rows]), strict=True):
        if first.setdefault(c, (i, k)) != (i, k):
            gone.add((i, k))
    now = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in now.items()}
    now = {i: t for i, t in now.items() if t.strip()}
    assert got == now and docs.where("doc_id = 13").count() == 2
    docs, got = step("near_dedup", docs)
    ids = sorted(now)
    _, name = brute_components([now[i] for i in ids], 5, 80)
    now = {i: now[i] for k, i in enumerate(ids) if name[k] == k}
    assert got == now and docs.where("doc_id = 13").count() == 1
    docs, got = step("suffix_dedup", docs)
    ids = sorted(now)
    kept = {i: h for i, (*_, h) in zip(ids, brute_repeats([now[i] for i in ids]), strict=True)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == {i: h for i, h in kept.items() if i in got} and len(got) >= len(ids) - 1
    pieces = stages["packing"](spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces if r["doc_id"] is not None} == set(got)
    assert corpus_pipeline.run(spark, sf).count() == len(pieces)
