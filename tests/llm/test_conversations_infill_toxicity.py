"""Prefix trie, fill-in-the-middle and toxicity against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from textquarry.llm import infill, prefixes, toxicity

from .conftest import EDGE, rows_of

# --- prefix trie ---------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, __rank int, part string, depth long"


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t))


def brute_trie(rows, rebuilt=True):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    seqs = {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in seqs}
        seqs = {c: seqs.get(c - c % 20, [])[: h[c]] + seqs[c][h[c] :] for c in seqs}
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = sum(all(m[: len(n)] != n or m == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * (words(n[-1][1]) if n else 0) for n in below)
        ends = ",".join(map(str, sorted(c for c in cs if len(seqs[c]) == len(node))))
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got_trie(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("seed", range(5))
def test_trie_is_that_of_brute_force(spark, seed):
    rng = random.Random(seed)
    says = ["a b", "c", "", None, "long text here", "x\ny z"][: 2 + seed]
    rows = [(c, k if rng.random() < 0.9 else None, rng.choice(["user", None]), rng.choice(says)) for c in range(0, 130, 1 + seed % 2) for k in range(rng.randrange(1, 7))]
    rows += rows[:9] + [(None, 1, "user", "nobody")]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS).repartition(3)
    assert got_trie(prefixes.trie_report(df)) == brute_trie(rows)
    assert got_trie(prefixes.prefix_trie(prefixes.sequences(df))) == brute_trie(rows, rebuilt=False)


def test_trie_of_hot_groups_and_long_conversations(spark):
    hot = [(c, 0, "user", "hello there") for c in range(9000)]  # one conversation 9000 times, in several strings of ids
    first = [(20_000 + c, k, "user", "hello there" if not k else f"own {c}") for c in range(40) for k in range(2)]
    long = [(50_000 + c, k, "user", f"word {k}" if c == 0 or k < 1500 else "other") for c in range(2) for k in range(2000)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in hot + first + long], TURNS).repartition(3)
    got = got_trie(prefixes.prefix_trie(prefixes.sequences(df)))
    by = {r[:2]: r[2:] for r in got}
    ids = ",".join(map(str, sorted(range(9000))))
    assert by[(0, 1)] == (0, 9040, 40, 40, 9039 * 2, hashlib.sha256(ids.encode()).hexdigest())
    assert by[(0, 0)][1:3] == (9042, 2)
    assert by[(50_000, 1500)][:4] == (50_000, 2, 2, 2) and by[(50_000, 700)][:4] == (50_000, 2, 1, 2)
    assert by[(50_000, 700)][4] == 801 * 2 and len(got) == 2 + 40 + 2000 + 500


def test_trie_of_nothing(spark):
    assert got_trie(prefixes.trie_report(spark.createDataFrame([], TURNS))) == []
    assert got_trie(prefixes.trie_report(spark.createDataFrame([(None, 1, "user", "a", 1, "x", 2)], TURNS))) == []
    one = got_trie(prefixes.trie_report(spark.createDataFrame([(7, None, None, None, 1, "x", 2)], TURNS)))
    assert one == brute_trie([(7, None, None, None)])


def test_common_turns():
    rng = random.Random(4)
    for _ in range(300):
        a, b = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(6)) for _ in range(prefixes.DIGEST)) for _ in range(2))
        n = 0
        while (n + 1) * 16 <= min(len(a), len(b)) and a[n * 16 : n * 16 + 16] == b[n * 16 : n * 16 + 16]:
            n += 1
        assert prefixes.common_turns(a, b) == n


# --- fill in the middle --------------------------------------------------------------------------


def brute_infill(doc_id, text, seed="1"):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_infill_is_that_of_brute_force(make):
    rng = random.Random(1)
    texts = EDGE + ["<P> here", "a<S", "<<M", "<S<S<P<P<M<M" * 2000, "é漢😀́" * 9000, "".join(rng.choice("ab <>PSM\n😀") for _ in range(50_000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")]
    texts += ["".join(rng.choice("ab <é") for _ in range(rng.randrange(3 * infill.LEAF))) for _ in range(60)]
    rows = rows_of(texts) + [(None, "no id at all", "en", "s", 1, 1, "", ""), (3, texts[3], "en", "s", 1, 1, "", "")]
    got = infill.infill_report(make(None, rows=rows)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*brute_infill(r[0], r[1])[:5], sha(brute_infill(r[0], r[1])[5]), sha(r[1] or "")) for r in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert len({r[2] for r in want}) == 3


def test_infill_keeps_columns_and_texts(make):
    rows = rows_of([*EDGE, "a text of several words"])
    docs = make(None, rows=rows)
    out = infill.transform_documents(docs)
    assert out.dtypes == docs.dtypes and out.where("doc_id = 0").first()["text"] is None
    for r in out.collect():
        if r["text"] is not None:
            assert r["text"] == brute_infill(r["doc_id"], rows[r["doc_id"]][1])[5] and r["n_chars"] == len(r["text"])
    assert infill.infill_report(make([])).count() == 0


@pytest.mark.parametrize("unit", ["char", "word"])
def test_ropes(unit):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab  é\n") for _ in range(rng.randrange(400)))
        rope = infill.build(text, unit, leaf=7)
        ends = list(range(1, len(text) + 1)) if unit == "char" else infill.unit_ends(text, unit)
        assert (str(rope), rope.chars, rope.units) == (text, len(text), len(ends))
        at = rng.randrange(len(ends) + 1)
        a, b = infill.split(rope, at, unit)
        assert str(a) == text[: ([0] + ends)[at]] and str(a) + str(b) == text and a.units == at and b.units == len(ends) - at
        joined = infill.concat(b, a)
        assert str(joined) == str(b) + str(a) and joined.units == rope.units
        assert infill.find(joined, "ab") == str(joined).find("ab") and infill.find(joined, "b a", 5) == str(joined).find("b a", 5)
    first, second = sorted(rng.randrange(50) for _ in range(2))
    for form in ("psm", "spm", "plain"):
        out, _, _ = infill.rearrange("some words and more " * 12, form, first, second, unit)
        assert str(infill.restore(str(out), form)) == "some words and more " * 12
    with pytest.raises(ValueError):
        infill.restore("<P>no other mark", "psm")


def test_ropes_stay_flat():
    rope = infill.build("x" * 4096, leaf=1)
    for k in range(1, 400):
        a, b = infill.split(rope, k * 10)
        rope = infill.concat(b, a)
    assert rope.depth < 40 and rope.chars == 4096


# --- toxicity ------------------------------------------------------------------------------------

LABELS = "doc_id long, quality int, toxic int, text string, h long"


def told(rng, n, insult):
    ws = [f"w{rng.randrange(300)}" for _ in range(n)]
    if insult:
        for _ in range(rng.randrange(1, 4)):
            ws.insert(rng.randrange(len(ws)), rng.choice(["Vilewort", "grubling", "stinkerel"]))
    return " ".join(ws)


def test_toxicity_on_held_out_documents(spark, make):
    rng = random.Random(3)
    bad = [rng.random() < 0.15 for _ in range(1200)]
    texts = [told(rng, rng.choice([5, 40, 300]), b) for b in bad]
    texts[0], bad[0] = told(rng, 60_000, False), False
    labels = spark.createDataFrame([(k, 1, int(b), "t", 1) for k, b in enumerate(bad) if k % 2] + [(None, 1, 1, "t", 1), (3, 1, None, "t", 1)], LABELS)
    got = {r["doc_id"]: r for r in toxicity.toxicity_report(make(texts), labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    held = [k for k in got if got[k]["held_out"] and k % 2]
    assert sum(got[k]["predicted"] for k in held if bad[k]) >= 0.95 * sum(bad[k] for k in held)
    assert sum(got[k]["predicted"] for k in got if not bad[k]) <= 3 and got[0]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_scores_do_not_follow_labels_of_held_out_rows(spark, make):
    rng = random.Random(5)
    texts = [told(rng, 30, k % 5 == 0) for k in range(400)]
    rows = [(k, 1, int(k % 5 == 0), "t", 1) for k in range(400)]
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 3 == 1 else t, x, h) for k, q, t, x, h in rows]
    one, two = (sorted(map(tuple, toxicity.toxicity_report(make(texts), spark.createDataFrame(r, LABELS)).collect())) for r in (rows, turned))
    assert one == two


def test_toxicity_of_odd_tables(spark, make):
    none = spark.createDataFrame([], LABELS)
    clean = spark.createDataFrame([(k, 1, 0, "t", 1) for k in range(5)], LABELS)
    toxic = spark.createDataFrame([(k, 1, 1, "t", 1) for k in range(11)], LABELS)
    assert {r["score"] for r in toxicity.toxicity_report(make(EDGE), none).collect()} == {0.0}
    assert {r["predicted"] for r in toxicity.toxicity_report(make(EDGE), clean).collect()} == {0}
    assert {r["predicted"] for r in toxicity.toxicity_report(make(EDGE), toxic).collect()} == {1}
    assert toxicity.toxicity_report(make([]), toxic).count() == 0
    docs = make(None, rows=[(None, "Vilewort", "en", "s", 1, 1, "", ""), *rows_of(EDGE)])
    got = toxicity.toxicity_report(docs, clean)
    assert got.count() == len(EDGE) + 1 and got.where("doc_id is null and not held_out").count() == 1


def test_features_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Über alles, word " * 400 + "x" * 900 + " end"
    whole = np.unique(np.concatenate([h for _, h in toxicity.features([text])]))
    monkeypatch.setattr(toxicity, "CHUNK_BYTES", 64)
    parts = np.unique(np.concatenate([h for _, h in toxicity.features([text])]))
    assert set(whole) - set(parts) <= set(whole[:0]) | set(whole) and len(set(whole) & set(parts)) >= len(whole) - 1  # a word longer than a piece is cut


def test_risk_stays_at_zero_or_above():
    rng = np.random.default_rng(1)
    p = np.hstack([np.ones((80, 1)), rng.integers(0, 2, (80, 6))])
    u = np.hstack([(np.arange(800) < 80)[:, None], rng.integers(0, 2, (800, 6))])
    weights, bias = toxicity.nn_pu(p, u, 0.1)
    assert weights[0] + bias > 0 and bias < -1 and np.abs(weights[1:]).max() < 1


def test_toxicity_on_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] for r in got if r["toxic"]) >= 0.7 * sum(r["toxic"] for r in got)
    assert sum(r["predicted"] for r in got if not r["toxic"]) <= 0.03 * len(got)
