"""Edge cases and brute-force comparisons of the operators for training data."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from gridjobs.llm import bpe, fingerprints, language_id, line_dedup, near_dedup, nearest, packing, quality, repeats, token_counts
from gridjobs.llm.components import connected_components
from gridjobs.llm.word_ids import WordIds

R = random.Random(8)
WORDS = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 9))) for _ in range(400)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


BASE = prose(120)
TEXTS = [None, "", "   \n\t ", "one", "One", "two words", BASE, BASE, BASE + " end", BASE.replace(WORDS[0], "x"), prose(3000), "aaaa" * 300, "日本語 テスト é " * 9, prose(60) + "\n" + BASE[:300] + "\n" + prose(60), prose(50) + "\n" + BASE[:300], "$$$ 123", prose(30)]
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, i, "score") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, cuts long, kind string").repartition(3)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe_equals_library(docs, nothing):
    found = by_id(bpe.encode(docs, VOCABULARY, public_tokenizers.PATTERN))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    ref = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in enumerate(TEXTS):
        assert found[i]["ids"] == ref.encode_ordinary(t or "")
        assert bytes(found[i]["decoded"]) == (t or "").encode()
    assert bpe.digest(nothing, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_bpe_odd_texts():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    ref = tiktoken.Encoding("r", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["x" * 700, "ab" * 900, " a  b\n\n c ", "don't WE'LL", "<|endoftext|>", "\x00\x01 \x1c", "".join(chr(R.choice([97, 32, 10, 769, 0x4E00, 48])) for _ in range(3000))]
    assert bpe.Bpe.load(VOCABULARY, public_tokenizers.PATTERN).encode(odd) == [ref.encode_ordinary(t) for t in odd]


def test_token_counts(docs, nothing):
    counted = token_counts.lengths(docs, VOCABULARY, public_tokenizers.PATTERN)
    n = sorted(r["n_tokens"] for r in counted.collect())
    for r in token_counts.summary(token_counts.histogram(counted)).collect():
        limit = r["n_tokens"]
        assert r["truncated_total"] == sum(min(limit, x) for x in n)
        assert (r["docs_above"], r["total_tokens"]) == (sum(x > limit for x in n), sum(n))
    found = {r["context_limit"]: r["truncated_total"] for r in token_counts.at_limits(token_counts.histogram(counted), [5, 100]).collect()}
    assert found == {k: sum(min(k, x) for x in n) for k in (5, 100)}
    assert token_counts.summary(token_counts.histogram(token_counts.lengths(nothing, VOCABULARY, public_tokenizers.PATTERN))).count() == 0


def test_packing(docs, nothing):
    pieces = packing.pack_documents(docs, WORD_VOCABULARY).collect()
    tokenizer = WordIds.load(WORD_VOCABULARY).tokenizer
    sequences = {}
    for i, t in enumerate(TEXTS):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        assert sum(p["length"] for p in own) == len(ids) == own[0]["doc_tokens"]
        at = 0
        for p in own:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            sequences.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0  # every one is full or a power of two
    assert packing.pack_documents(nothing, WORD_VOCABULARY).count() == 0


def test_packing_whole_examples(spark):
    rows = [(i, n, R.randint(0, min(n, 300))) for i, n in enumerate(R.choices(range(1, 900), k=300))] + [(300, 5000, 10), (301, None, None)]
    limits = packing.Limits(tokens=2048, segments=6, loss_tokens=700)
    found = packing.pack_examples(spark.createDataFrame(rows, "example_id long, tokens long, loss_tokens long").coalesce(1), limits).collect()
    assert sorted(r["example_id"] for r in found) == list(range(301))
    for s in {r["sequence_id"] for r in found}:
        own = [r for r in found if r["sequence_id"] == s]
        if own[0]["example_id"] != 300:
            assert len(own) <= 6 and sum(r["tokens"] for r in own) <= 2048 and sum(r["loss_tokens"] for r in own) <= 700


def brute_components(texts, words, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    name = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if x == old else x for x in name]
    return sets, name


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(docs, words):
    sets, name = brute_components(TEXTS, words, 80)
    found = by_id(near_dedup.near_duplicates(docs, words=words))
    assert len(found) == len(TEXTS)
    for i in range(len(TEXTS)):
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (len(sets[i]), name[i])


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Children over the small size, branching and the blockwise rest."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    texts = []
    for g in range(3):
        base = [R.choice(WORDS) for _ in range(60)]
        for _ in range(40):
            t = list(base)
            for _ in range(R.randint(0, 4)):
                t[R.randrange(60)] = R.choice(WORDS)
            texts.append(" ".join(t))
    _, name = brute_components(texts, 2, 80)
    found = by_id(near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2))
    assert [found[i]["component_id"] for i in range(len(texts))] == name


def test_family_below_the_similarity_sends_few_pairs(spark, monkeypatch):
    """Documents of about 0.71, few of which are linked, whose sketches nearly all pass: pairs do not leave their children; short
    sets and such as fill a bitmap of fixed size."""
    sent, confirm = [], near_dedup.confirm
    monkeypatch.setattr(near_dedup, "confirm", lambda docs, pairs, words, percent: sent.append(pairs.count()) or confirm(docs, pairs, words, percent))
    r = random.Random(5)
    for count, size, changed in ((400, 200, 9), (200, 3000, 135)):
        base = [f"w{r.randrange(10**6)}" for _ in range(size)]
        texts = []
        for i in range(count):
            words = base[:]
            for k in r.sample(range(size), changed):
                words[k] = f"x{i}_{k}"
            texts.append(" ".join(words))
        texts.append(texts[0] + " tail")
        sent.clear()
        found = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), words=2).collect()
        assert sum(sent) <= 4 * count  # of count * (count - 1) / 2
        _, name = brute_components(texts, 2, 80)
        assert {x["doc_id"]: x["component_id"] for x in found} == dict(enumerate(name))


def test_bitmaps_of_two_widths_rule_out_no_similar_pair():
    r = np.random.default_rng(6)
    sets = []
    for n in (1, 40, 63, 66, 500, 520, 20_000):
        base = r.integers(0, 1 << 63, n, np.uint64)
        sets += [base, np.concatenate([base[n // 10 :], r.integers(0, 1 << 63, n // 20, np.uint64)]), np.concatenate([base, r.integers(0, 1 << 63, n // 4, np.uint64)])]
    maps = near_dedup.Bitmaps(np.array([len(s) for s in sets]), np.array([*map(near_dedup.Bitmaps.of, sets), None], object)[:-1])
    i, j = np.triu_indices(len(sets), 1)
    left = set(zip(*(x[maps.possible(i, j, 80)].tolist() for x in (i, j)), strict=True))
    alike = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert alike and alike <= left and len(left) <= len(alike) + 8


def test_bitmaps_rule_out_no_link(spark):
    texts = [" ".join(R.choice(WORDS) for _ in range(120))]
    for k in range(0, 60, 3):
        t = texts[0].split()
        for at in R.sample(range(120), k):
            t[at] = f"other{at}"
        texts.append(" ".join(t))
    brute, _ = brute_components(texts, 2, 80)
    sets = near_dedup.full_sets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).select("doc_id", "size", "bits")
    a, b = (sets.toDF(c, f"size_{c}", f"bits_{c}") for c in "ab")
    left = {(r["a"], r["b"]) for r in near_dedup.possible(a.join(b, a["a"] < b["b"]), 80).collect()}
    like = {(i, j): len(brute[i] & brute[j]) / len(brute[i] | brute[j]) for j in range(len(texts)) for i in range(j)}
    assert {p for p, x in like.items() if x >= 0.8} <= left
    assert not {p for p, x in like.items() if x < 0.5} & left


def test_near_duplicates_of_nothing(nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0


def brute_repeats(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_repeats(docs, hot):
    found = by_id(repeats.kept_bytes(docs, repeats.repeats(docs, hot), digest=True))
    assert [tuple(found[i])[1:] for i in range(len(TEXTS))] == brute_repeats(TEXTS)


def test_repeats_keep_columns_and_rows(docs, nothing):
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    assert repeats.without_repeats(nothing).count() == 0


def test_merged_transforms_alone_find_the_repeats(spark):
    """All texts as strings of one collection, without minimizers, give the same bytes as the operator."""
    texts = [t.encode() for t in TEXTS if t]
    own, _ = repeats.repeated([np.frombuffer(t, np.uint8) for t in texts], np.arange(len(texts)), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool))
    gone = [0] * len(texts)
    for d, a, b in zip(*(x.tolist() for x in own), strict=True):
        gone[d] += b - a
    assert gone == [n for _, n, *_ in brute_repeats([t for t in TEXTS if t])]


def test_equal_texts_of_several_tasks_repeat_through_the_merge(spark, monkeypatch):
    text = prose(600)
    docs = spark.createDataFrame([(i, text) for i in range(4)], "doc_id long, text string").repartition(4, "doc_id").repartitionByRange(4, "doc_id")
    removed = lambda: {r["doc_id"]: r["n_removed"] for r in repeats.kept_bytes(docs, repeats.repeats(docs), digest=True).collect()}
    size = len(text.encode())
    assert removed() == {0: 0, 1: size, 2: size, 3: size}
    merge = repeats.merged_repeats
    monkeypatch.setattr(repeats, "merged_repeats", lambda strings: merge(strings.limit(0)))
    assert removed() == dict.fromkeys(range(4), 0)


def test_same_bytes(monkeypatch):
    monkeypatch.setattr(repeats, "COMPARED", 7)
    data = np.frombuffer(b"abcdefghabcdefgxabc", np.uint8)
    a, b, n = np.array([0, 0, 8, 3]), np.array([8, 8, 16, 11]), np.array([7, 8, 3, 5])
    assert repeats.same_bytes(data, a, b, n).tolist() == [True, False, True, False]
    none = np.zeros(0, np.int64)
    assert not len(repeats.same_bytes(data, none, none, none))


def test_repeats_of_odd_rows(spark):
    """Rows repeated with their doc_id, rows without one, clashing columns, and many strings of one minimizer."""
    long = prose(400)
    rows = [(5, long, 1), (5, long, 1), (None, long, 2), (7, "x" + long, 3), (9, None, 4)] + [(20 + i, f"{i:03d}" + BASE[:150] + f"{i:03d}", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cuts long").repartition(len(rows), "cuts").unionByName(spark.createDataFrame(rows[:0], "doc_id long, text string, cuts long"))
    docs = docs.where("doc_id = 5").limit(1).unionByName(docs.where("doc_id = 5").limit(1)).unionByName(docs.where("not doc_id <=> 5"))
    out = repeats.without_repeats(docs)
    found = sorted(((r["doc_id"] or -1, r["cuts"]), r["text"]) for r in out.collect())
    assert out.columns == docs.columns and len(found) == len(rows)
    by = dict(found)
    assert by[5, 1] == long and by[-1, 2] == long and by[7, 3] == "x" and by[9, 4] is None
    assert sum(len(by[20 + i, i]) < 156 for i in range(30)) == 29


def test_merged_transforms_give_common_prefixes():
    strings = [bytes(R.choice(b"ab") for _ in range(R.randint(1, 30))) for _ in range(20)]
    shards, order, base = [], [], 0
    for part in (strings[:7], strings[7:8], strings[8:]):
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8) + 1, 0) for s in part]).astype(np.uint8)
        stop = np.cumsum([len(s) + 1 for s in part])
        owner = np.repeat(np.arange(len(part)), [len(s) + 1 for s in part])
        sa = repeats.suffixes(text, stop[owner] - 1)
        first = np.isin(sa, np.concatenate([[0], stop[:-1]]))
        shards.append((np.where(first, 0, text[sa - 1]).astype(np.uint8), len(part)))
        order += [(base + owner[p], bytes(text[p : stop[owner[p]] - 1])) for p in sa]
        base += len(part)
    place, _, prefix = repeats.merge_transforms(shards, 40)
    merged = [None] * len(order)
    for k, p in enumerate(place):
        merged[p] = order[k]
    assert [m[1] for m in merged] == sorted(m[1] for m in merged)
    for k in range(len(strings) + 1, len(merged)):
        a, b = merged[k - 1][1], merged[k][1]
        common = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert prefix[k] == common


def test_fingerprints(spark, docs, nothing):
    found = by_id(fingerprints.compare_edited(docs))
    texts = [t or "" for t in TEXTS]
    for i, t in enumerate(texts):
        x = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + x[: len(t) // 2]
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found[i]["near_edited"] <= 1
    assert found[6]["fingerprint"] == found[7]["fingerprint"] and found[6]["near_next"] == 1
    assert fingerprints.compare_edited(nothing).count() == 0
    sets = {r["doc_id"]: np.array(r["spots"], np.uint32) for r in fingerprints.fingerprints(docs).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and len(sets[i]) and not np.array_equal(sets[i], sets[j]) and fingerprints.jaccard(sets[i], sets[j]) >= 0.5}
    pairs = {(r["a"], r["b"]) for r in fingerprints.near_pairs(docs, 0.5).collect()}
    firsts = {}
    for i in sorted(sets):
        firsts.setdefault(sets[i].tobytes(), i)
    assert pairs == {p for p in want if all(firsts[sets[k].tobytes()] == k for k in p)}


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0]), (3004, x[5].tolist())]
    v = nearest.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = nearest.search(v, v.where("vec_id % 50 = 0"), 20).collect()
    every = {i: np.array(w) for i, w in rows if i < 3000 or i == 3004}
    hit = 0
    for q in range(0, 3000, 50):
        scores = sorted(((-(every[q] * w).sum(), i) for i, w in every.items() if i != q))[:20]
        own = sorted((f["rank"], f["vec_id"], f["score"]) for f in found if f["query_id"] == q)
        assert [k for k, *_ in own] == list(range(1, 21))
        hit += len({i for _, i in scores} & {i for _, i, _ in own})
    assert hit / (60 * 20) >= 0.9
    assert nearest.search(v.limit(0), v.limit(0)).count() == 0


def test_lines(docs, nothing):
    found = by_id(line_dedup.keep_first_lines(docs))
    assert found[0]["text"] is None and found[2]["text"] == "   \n\t "
    assert found[6]["text"] == BASE and found[7]["text"] == "" and found[4]["text"] == "One"
    assert found[8]["text"] == "" and found[8]["n_removed"] == 1  # nearly the same line
    assert found[13]["n_lines"] == 3 and BASE[:300] not in (found[14]["text"] or "")
    assert line_dedup.keep_first_lines(nothing).count() == 0


def similar(rows):
    """Brute force: the component of each line, joined where the sets of shingles reach 0.8."""
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in rows]
    name = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 5 >= len(a | sets[j]) * 4 and name[i] != name[j]:
                name = [name[j] if x == name[i] else x for x in name]
    return name


def test_lines_across_signature_kinds(spark):
    """Pairs of 71 and 72 characters and others around the length at which signatures change, and repetitive lines."""
    letters = lambda n: "".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = []
    for n, m in ((71, 72), (70, 73), (68, 74), (60, 71), (72, 86)):
        for _ in range(30):
            x = letters(m)
            rows += [x[:n], x]
    for _ in range(30):  # sets of 60 and 66 shingles repeated over hundreds of characters
        x, y = letters(60), letters(6)
        rows += [x * 9, x * 9 + y]
    found = by_id(line_dedup.keep_first_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    expected = len(rows) - len(set(similar(rows)))
    assert expected >= 150
    assert sum(r["n_removed"] for r in found.values()) >= expected - 2  # found with high probability


def test_lines_have_one_row_of_bands(spark):
    """A class of lines is one row with all its bands, those of minima over each bin; only bands of several classes are kept."""
    rows = ["".join(R.choice("abcdef ") for _ in range(n)).strip() + "." for n in (1, 5, 9, 40, 200, 900)]
    rows += [rows[4], rows[5][:-3] + "xyz", "\u00e9\u4e2d\U0001f600 " * 9]
    each = line_dedup.lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    found = {(r["k1"], r["k2"]): r for r in line_dedup.signatures(each).collect()}
    assert len(found) == len(set(rows)) and sorted(r["copies"] for r in found.values())[-2:] == [1, 2]
    at = line_dedup.shingled(each, "k1", "k2")
    plain = at.selectExpr("k1", "k2", "int(h & 7) as bin", *[f"int(shiftrightunsigned(h, {s}) & 2147483647) as v{r}" for r, s in enumerate(line_dedup.ORDERS)]).groupBy("k1", "k2", "bin").min("v0", "v1", "v2")
    plain = plain.selectExpr("k1", "k2", "bin", "xxhash64(bin, `min(v0)`, `min(v1)`, `min(v2)`) as band").collect()
    assert sorted((*k, b, x) for k, r in found.items() for b, x in enumerate(r["bands"]) if x is not None) == sorted(tuple(r) for r in plain)
    sizes = {r["band"]: r["size"] for r in line_dedup.shared(line_dedup.signatures(each)).collect()}
    counts = {b: sum(r["band"] == b for r in plain) for b in {r["band"] for r in plain}}
    assert sizes == {b: n for b, n in counts.items() if n > 1} and sizes


@pytest.mark.parametrize("crowded", [20_000, 0])
def test_lines_of_templates(spark, monkeypatch, crowded):
    """Lines alike below the similarity share buckets with their true partners; also with salts and small blocks."""
    monkeypatch.setattr(line_dedup, "CROWDED", crowded)
    monkeypatch.setattr(line_dedup, "BLOCK", 16)
    letters = lambda n: "".join(R.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    head, tail, rows = letters(60), letters(60), []
    for _ in range(150):
        middle = letters(12)
        rows += [head + middle + tail, head + middle + tail + letters(8)]
    found = by_id(line_dedup.keep_first_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    name = similar(rows)
    first = {}
    for i, x in enumerate(name):
        first.setdefault(x, i)
    assert len(first) < len(rows)
    assert {i for i in found if found[i]["n_removed"]} == {i for i, x in enumerate(name) if first[x] != i}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 90), (90, 95), (7, 7)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(61)) and {found[i] for i in (90, 95, 100)} == {90}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_language(spark, docs, nothing):
    sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = language_id.fit(sf)
    p = language_id.predict(sf.where(language_id.held_out()), net)
    assert p.where("lang_pred = lang").count() >= 0.97 * p.count()
    found = by_id(language_id.predict(docs, net))
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (0, 1, 2)) and found[10]["lang_pred"] in net.languages
    assert language_id.predict(nothing, net).count() == 0 and language_id.fit(nothing) is None
    assert by_id(language_id.predict(docs, None))[5]["lang_pred"] == "und"


def test_quality(spark, docs, nothing):
    sf = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(sf, labels)
    rows = quality.score(sf.where(quality.held_out()).join(labels, "doc_id"), model).select("quality", "predicted", "score").collect()
    of = lambda k: [r for r in rows if r["quality"] == k]
    assert np.mean([np.mean([r["predicted"] == k for r in of(k)]) for k in (0, 1)]) >= 0.8
    found = by_id(quality.score(docs, model))
    assert found[0]["score"] == found[1]["score"] == found[2]["score"]
    assert quality.score(nothing, model).count() == 0 and quality.fit(nothing, labels) is None
    assert by_id(quality.score(docs, None))[3]["score"] == 0.5
