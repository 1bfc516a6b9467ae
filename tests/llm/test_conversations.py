"""Reply trees, collocations and repair of conversations, against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from gridjobs.llm import chats, phrases, repair
from pyspark.sql import functions as F

R = random.Random(5)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
TURNS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi?"), (1, 2, "assistant", "Hello \\[INST] <s> \\\\ <|end|>!"), (1, 3, "user", None), (1, 4, "assistant", "x" * 3000 + "."),
    (2, 0, "assistant", "</s>[INST] ok [/INST]"), (2, 0, "assistant", "</s>[INST] ok [/INST]"), (2, None, None, " \t"), (3, 5, "user", "a\nb."), (None, 1, "user", "é ü."), (None, 2, None, None), (4, -3, "weird\nrole<s>", "<<s>>"),
]
SCHEMA = "conv_id long, turn long, role string, text string, tree string, node int"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("conv")
    more = [(i, t, R.choice(["user", "assistant", "system", "user", "assistant", "u", ""]), R.choice(["Yes.", "no", "", "Why? ", "ok!\n", "Yes."])) for i in range(10, 400) for t in range(R.randint(1, 9))]
    rows = [(*r, "own", 7) for r in TURNS + more]
    R.shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{d}/empty/conversations.parquet")
    return str(d), [r[:4] for r in rows]


def by_conversation(rows):
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((t, r, x))
    return out


def test_formatting_query(spark, sf):
    d, rows = sf
    got = chats.op11_reply_trees(spark, d).collect()
    want = by_conversation([*rows, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    assert len(got) == len(want)
    for r in got:
        turns = [(role or "", x or "") for _, role, x in want[r["conv_id"]]]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert r["formatted_chars"] > sum(len(x) for _, x in turns)
    assert [r["conv_id"] for r in chats.op11_reply_trees(spark, f"{d}/empty").collect()] == [-1]


def test_formatted_text_has_no_control_string_of_a_turn(spark):
    texts = ["".join(R.choice(["<s>", "</s>", "[INST]", "<|end|>", "<|turn|>", "<|says|>", "\\", "<", "|", "a", "\n"]) for _ in range(R.randint(0, 9))) for _ in range(300)]
    rows = [(f"t{i}", 0, None, R.choice(["user", "assistant", "<s>"]), x, 0.0) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    for r in chats.read_back(chats.formatted(df)).collect():
        _, _, _, role, text, _ = rows[int(r["tree"][1:])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(role, text)]
        inner = r["formatted"].removeprefix("<|turn|>").removesuffix("<|end|>").split("<|says|>")
        assert len(inner) == 2 and not any(c in x for c in chats.CONTROLS for x in inner)
        assert r["learned"] == (text if role == "assistant" else "")
        for m in r["mask"]:
            assert r["formatted"][m["start"] : m["start"] + m["length"]] == inner[1]


def test_branches_of_random_trees(spark):
    rows, want = [], {}
    for t in range(40):
        n, parent, score, text = R.randint(1, 30), {}, {}, {}
        for i in range(n):
            parent[i] = R.randrange(i) if i and R.random() < 0.95 else None
            score[i], text[i] = float(R.randint(-3, 3)), f"m{i}"
            rows.append((f"t{t}", i, parent[i], "user", text[i], score[i]))
        leaves = [i for i in range(n) if i not in parent.values()]
        full = {}
        for leaf in leaves:
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            full[leaf] = path[::-1]
        first = sorted(leaves, key=lambda x: (-sum(score[i] for i in full[x]), x))[:3]
        want |= {(f"t{t}", x): (k, [text[i] for i in full[x]]) for k, x in enumerate(first, 1)}
    chain = 300
    rows += [("long", i, i - 1 if i else 99_999, "user", f"c{i}", 1.0) for i in range(chain)]  # its root's parent is missing
    want["long", chain - 1] = (1, [f"c{i}" for i in range(chain)])
    rows += [("cycle", 0, 1, "user", "x", 1.0), ("cycle", 1, 0, "user", "y", 1.0), ("cycle", 2, 0, "user", "z", 1.0)]
    rows += [("bare", None, 3, "user", "alone", 1.0), (None, 1, None, "user", "alone", None)]
    R.shuffle(rows)
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    got = chats.read_back(chats.formatted(df, branches=3)).collect()
    assert sorted(r["turns"][0]["text"] for r in got if r["rank"] is None) == ["alone", "alone"]
    assert {(r["tree"], r["path"]): (r["rank"], [t["text"] for t in r["turns"]]) for r in got if r["rank"]} == want


def damage(rows):
    out = {c: [] for c, *_ in rows}
    sp = lambda x: " " if x is None else x
    for c, t, r, x in rows:
        k = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(r), sp(x)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[c] += [(t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], repair_key(r[2]))) for c, v in out.items()}


def repair_key(text):
    return text.encode() if len(text.encode()) <= 32 else text[:8].encode() + hashlib.sha256(text.encode()).digest()


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        last = re.findall(r"[^ \t-\r]", text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(turns, bad, audit):
    """Cost and rows of an audit, or None if it can't be."""
    state, at, cost, rows = "", 0, 0, []
    need = lambda: "a" if state[-1:] == "u" else "u"
    for e in audit:
        if e == "I":
            rows.append(("user" if need() == "u" else "assistant", ""))
            state, cost = state + need(), cost + 2
            continue
        _, role, text = turns[at]
        fault, at = bad[at], at + 1
        if e == "D":
            cost += 3
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (fault == "truncated") + 2 * (e == "R")
        new = role if e == "K" else "user" if need() == "u" else "assistant"
        rows.append((new, text))
        state += new[:1]
        if not re.fullmatch("(s?(ua)*u?)?", state) or not new:
            return None
    return (cost, audit, rows) if re.fullmatch("(s?(ua)+)?", state) else None


def best(turns, bad):
    """All audits of few rows: between rows, more than two inserts are never cheapest."""
    found = []
    for edits in itertools.product("DKR", repeat=len(turns)):
        for ins in itertools.product(range(3), repeat=len(turns) + 1):
            audit = "I" * ins[0] + "".join(e + "I" * k for e, k in zip(edits, ins[1:], strict=True))
            if x := apply(turns, bad, audit):
                found.append(x)
    return min(found)


def test_repair_query(spark, sf):
    d, rows = sf
    got = {r["conv_id"]: r for r in repair.op13_repair(spark, d).collect()}
    want = damage(rows)
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r, bad = got[c], faults(turns)
        there = {t for t, *_ in turns if t is not None}
        initials = [x[:1] for _, x, _ in turns]
        assert r["gaps"] == (max(there) - min(there) + 1 - len(there) if there else 0)
        assert [r[k] for k in ("blank", "duplicate", "truncated")] == [bad.count(k) for k in ("blank", "duplicate", "truncated")]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, _, out = apply(turns, bad, r["audit"])
        assert cost == r["cost"] and r["repaired_sha256"] == sha("\n".join(f"{a}:{b}" for a, b in out))
        if len(turns) <= 4:
            assert (r["cost"], r["audit"]) == best(turns, bad)[:2]
    assert repair.op13_repair(spark, f"{d}/empty").count() == 0


def plain(turns, bad):
    """The same program on whole strings, of any length."""
    state = {0: (0, "")}

    def insert(s):
        for _ in range(4):
            for k, (c, a) in list(s.items()):
                to = repair.GIVES[k][1]
                s[to] = min(s.get(to, (1 << 60, "")), (c + 2, a + "I"))
        return s

    insert(state)
    for (_, role, _), fault in zip(turns, bad, strict=True):
        new = {}
        for k, (c, a) in state.items():
            moves = [(k, c + 3, a + "D")]
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                moves.append((repair.GIVES[k][1], c + 2 + extra, a + "R"))
                if (k, role[:1]) in repair.NEXT:
                    moves.append((repair.NEXT[k, role[:1]], c + extra, a + "K"))
            for to, cost, audit in moves:
                new[to] = min(new.get(to, (1 << 60, "")), (cost, audit))
        state = insert(new)
    return min(state[k] for k in (0, 3) if k in state)


@pytest.mark.parametrize("modulus", [(1 << 61) - 1, 7])
def test_audits_of_long_conversations(monkeypatch, modulus):
    """With the small modulus nearly all prefixes collide, so the verification decides."""
    monkeypatch.setattr(repair, "MODULUS", modulus)
    for _ in range(60):
        roles = R.choice([["x"], ["user", "assistant"], ["system", "user", "assistant", "x"], ["user"], ["assistant", "x"]])
        turns = [(i, R.choice(roles), f"{i}.") for i in range(R.randint(0, 120))]
        bad = [R.choice(["", "", "", "truncated", "blank"]) for _ in turns]
        r = repair.Repair()
        for (_, role, _), fault in zip(turns, bad, strict=True):
            r.row(role[:1], {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[fault])
        assert r.best() == plain(turns, bad)


def test_collocations_equal_sql(spark, tmp_path, monkeypatch):
    few = [R.choice(["a", "b", "the", "of", "é", "und-so", "x" * 40, "word" + str(i)]) for i in range(60)]
    text = lambda: "".join(R.choice(few) + R.choice([" ", " ", " ", "\t", ". ", "\n", ",", "  ", "\x0b"]) for _ in range(R.randint(0, 200)))
    rows = [(i, text(), R.choice(["en", "de", None]), i, i) for i in range(300)] + [(None, None, "en", 0, 0), (5, "", None, 0, 0), (6, "Only. One. WORD!", "x\ty", 0, 0), (7, "the of " * 50_000, "en", 0, 0)]
    rows += [rows[0]] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, w1 long, rank long")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cur = con.execute(phrases.SQL)
    names = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r[c] for c in names)) for r in phrases.op12_collocations(spark, str(tmp_path)).collect()) == want and len(want) > 50
    monkeypatch.setattr(phrases, "COMBINED_BYTES", 300)
    monkeypatch.setattr(phrases, "SENT_ROWS", 7)
    assert sorted(phrases.commonest(phrases.word_counts(df), 8)) == sorted(phrases.commonest(phrases.word_counts(df.repartition(7)), 8)) != []
    monkeypatch.setattr(phrases.commonest, "__defaults__", (8,))  # most words have no number
    assert sorted(repr(tuple(r[c] for c in names)) for r in phrases.op12_collocations(spark, str(tmp_path)).collect()) == want
    assert phrases.collocations(df.limit(0)).count() == 0


def test_scores_are_exact(spark):
    big = [(10**9 + 7, 3 * 10**9 + 1, 2 * 10**9 + 5), (10**14 + 1, 10**15 - 1, 10**15 - 3), (10, 10, 10)]
    df = spark.createDataFrame(big, "a long, l long, r long")
    got = df.select(phrases.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [r["s"] for r in got] == [10**6 * a * a // (x * y) for a, x, y in big]
