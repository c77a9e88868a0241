"""SimHash, conversation repair and the prefix trie against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.test_operators import LONG, no_docs, odd_docs
from winnow.llm import queries, repair, simhash, trie

TURN = "conv_id long, turn long, role string, text string, node string, audit string, there2 int, h1 string, base string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", "b") for r in rows], TURN).repartition(3)


# --- op11 ---


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    cut = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in cut]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """prints: id -> set of fingerprints."""
    label = {i: i for i in prints}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(sorted(prints), 2):
        if any((x ^ y).bit_count() <= 2 for x in prints[i] for y in prints[j]):
            a, b = sorted((top(i), top(j)))
            label[b] = a
    return {i: top(i) for i in prints}


def test_op11_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    prints = {i: {plain_print(t)} for i, t in zip(docs.doc_id, docs.text, strict=True)}
    expected = plain_components(prints)
    found = queries.op11_segment_popcount(spark, sf).toPandas()
    assert len(found) == len(docs)
    for r in found.itertuples():
        assert int(r.fingerprint, 16) in prints[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == expected[r.doc_id]
    assert found.component_id.nunique() < len(docs)


@pytest.mark.parametrize("cell", [512, 3])
def test_op11_links(spark, monkeypatch, cell):
    """Chains and balls of fingerprints whose cells are crowded at every length of segment but the last."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(5)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 150)}
    for centre in list(prints)[:6]:
        x = centre
        for _ in range(12):
            x ^= (1 << int(rng.integers(0, 64))) | (1 << int(rng.integers(0, 64)))
            prints.add(x)
            prints.add(centre ^ (1 << int(rng.integers(0, 64))))
    rows = [((p ^ (1 << 63)) - (1 << 63),) for p in prints]
    found = simhash.links(spark.createDataFrame(rows, "print long")).collect()
    unsigned = lambda x: x % (1 << 64)
    label = {p: p for p in prints}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for r in found:
        a, b = sorted((top(unsigned(r.a)), top(unsigned(r.b))))
        label[b] = a
    expected = plain_components({p: {p} for p in prints})
    assert {p: top(p) for p in prints} == expected and len(set(expected.values())) < len(prints) - 60


def test_op11_bound_of_the_embedding():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 64, 500, np.uint64)
    for bits in simhash.SEGMENTS:
        y = x.copy()
        for _ in range(2):
            y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
        a, b = (simhash.embedding(z, bits).astype(int) for z in (x, y))
        assert (np.abs(a - b).sum(axis=1) <= np.bitwise_count(x ^ y)).all()
        for i, j in zip(simhash.cells(x, bits), simhash.cells(y, bits), strict=True):
            assert np.intersect1d(i, j).size


def test_op11_odd_docs(spark):
    found = simhash.near_duplicates(odd_docs(spark)).toPandas()
    assert len(found) == 10 and set(found.columns) == {"doc_id", "fingerprint", "component_id"}
    at = {r.doc_id: r for r in found.itertuples()}
    assert {at[i].fingerprint for i in (1, 2, 6)} == {"0" * 16} and {at[i].component_id for i in (1, 2, 6)} == {1}
    assert at[8].component_id == 3 and int(at[3].fingerprint, 16) == plain_print(LONG)
    assert found[found.doc_id.isna()].component_id.isna().all() and (found.doc_id == 4).sum() == 2
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    texts = [(1, "a b c d"), (1, "x y z"), (2, "x y z"), (3, "a b c d")]  # one id of two texts joins both
    assert {r.component_id for r in simhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()} == {1}


# --- op12 ---


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
        out += [] if d == 0 else [row, row] if d == 3 else [row]
    return out


def plain_faults(rows):
    """Rows in order, with their first fault."""
    seen, out = set(), []
    for _, _, role, text in rows:
        ink = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows, most):
    """(cost, audit, turns): every sequence of edits of at most that cost, tried out."""
    best, todo = None, [(0, "", 0, ())]
    while todo:
        cost, audit, i, turns = todo.pop()
        if cost > most or best and cost > best[0]:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
            best = min(best or (cost, audit, turns), (cost, audit, turns))
        if not re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] for r, _ in turns)):
            continue
        todo += [(cost + 5, audit + "I", i, (*turns, (r, ""))) for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            todo.append((cost + 2, audit + "D", i + 1, turns))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault else 0
                todo += [(cost + more, audit + "K", i + 1, (*turns, (role, text)))] if role else []
                todo += [(cost + 1 + more, audit + "R", i + 1, (*turns, (r, text))) for r in ("user", "assistant")]
    return best


def test_op12_repair_by_trying_all():
    rng = np.random.default_rng(8)
    codes = [i + f for i in range(4) for f in (0, 0, 0, repair.BLANK, repair.DUPLICATE, repair.CUT)]
    faults = {0: "", repair.BLANK: "blank", repair.DUPLICATE: "duplicate", repair.CUT: "truncated"}
    roles = ("system", "user", "assistant", "tool")
    for k in range(300):
        code = bytes(rng.choice(codes, k % 6).tolist())
        rows = [(roles[c & 3], f"t{i}", faults[c & ~3]) for i, c in enumerate(code)]
        cost, audit, turns = cheapest(rows, 2 * len(rows))
        assert repair.repair(code) == (cost, audit), rows
        script, got = repair._Script(1, audit), []
        for role, text, _ in rows:
            got += script.row(role, text)
        got += script.inserts()
        assert tuple((r, t) for _, r, t in got) == turns


def test_op12_layers_hold_all_costs():
    """16 layers are enough: no state is further than 12 above the cheapest, after any rows."""
    words = todo = {repair.LAST}
    codes = [i + f for i in range(4) for f in (0, repair.BLANK, repair.CUT)]
    while todo:
        todo = {repair.layers_before(w, c)[0] for w in todo for c in codes} - words
        words = words | todo
    assert max(repair.cost_of(w, q) for w in words for q in range(4)) <= 12 and len(words) < 1000


def test_op12_long_conversation():
    code = bytes(np.random.default_rng(9).choice([0, 1, 2, 3, 5, 9, 17, 18], 100_000).tolist())
    cost, audit = repair.repair(code)
    paid = {"K": 0, "R": 1, "D": 2, "I": 5}
    edits = [e for e in audit if e != "I"]
    assert len(edits) == len(code) and cost == sum(paid[e] for e in audit) + 5 * sum(e in "KR" and c & repair.CUT > 0 for e, c in zip(edits, code, strict=True))


def test_op12_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 1, None, "x."), (1, None, "system", "S!"), (1, 5, "assistant", None), (1, 5, "assistant", "Fine. \n"), (1, 6, "user", LONG), (1, 6, "user", LONG),
        (None, 0, "user", "a?"), (None, 0, "assistant", "b!"), (2, None, "", ""), (3, 0, "user", "Same."), (3, 0, "user", "Same."), (3, 1, "assistant", "Same."), (4, None, None, None),
        *[(9, i, "userassistant"[4 * (i % 2):][:9], f"{i}.") for i in range(3000)],
    ]
    rows += [(c, t, "user", "only.") for c in range(20, 60) for t in (3,)]
    table = conversations(spark, rows)
    found = {r.conv_id: r for r in repair.repairs(repair.damage(table)).collect()}
    turns = defaultdict(list)
    for r in repair.repaired_turns(repair.damage(table)).orderBy("conv_id", "place").collect():
        turns[r.conv_id].append(f"{r.role}:{r.text}")
    assert set(found) == {r[0] for r in rows}
    gone = 0
    for conv in found:
        mine = [r for r in plain_damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        judged, r = plain_faults(mine), found[conv]
        gone += not mine
        assert [r.blank, r.duplicate, r.truncated] == [sum(f == k for _, _, f in judged) for k in ("blank", "duplicate", "truncated")]
        known = [t for _, t, _, _ in mine if t is not None]
        assert r.gaps == (max(known) - min(known) + 1 - len(set(known)) if known else 0)
        assert r.illegal == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(judged))
        assert r.repaired_sha256 == hashlib.sha256("\n".join(turns[conv]).encode()).hexdigest()
        if len(judged) < 5:
            cost, audit, said = cheapest(judged, 2 * len(judged))
            assert (r.cost, r.audit) == (cost, audit) and turns[conv] == [f"{a}:{b}" for a, b in said]
    assert gone  # a conversation that lost all its rows is there
    assert repair.repairs(repair.damage(table.where("false"))).count() == 0


# --- op13 ---


def plain_trie(rows):
    own = defaultdict(list)
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = own.get(c - int(np.fmod(c, 5)), [])
        built[c] = tuple(base[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    childless = {n for n in members if not any(m[:-1] == n and m for m in members)} if len(members) < 2000 else None
    for node, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(built[c]) == len(node))))
        sub = below[node]
        out[min(cs), len(node)] = (
            min(members[node[:-1]]) if node else None, len(cs), sum(bool(m) and m[:-1] == node for m in sub), sum(m in childless for m in sub),
            sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in sub if m), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def as_dict(frame):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in frame.collect()}


@pytest.mark.parametrize("held", [50_000, 3])
def test_op13_by_brute_force(spark, monkeypatch, held):
    """Few different turns, so that families share paths; also with tries that are handed on again and again."""
    if held == 3:
        monkeypatch.setattr(trie, "PIECE", 2)
    rng = np.random.default_rng(held)
    rows = [(int(c), t, ("user", "assistant")[t % 2], f"é{rng.integers(0, 2)}" * int(rng.integers(1, 3))) for c in rng.permutation(60) - 12 for t in range(int(rng.integers(1, 14)))]
    rows += [(100 + c, t, "user", "copy") for c in range(40) for t in range(10)]
    assert as_dict(trie.trie(conversations(spark, rows))) == plain_trie(rows)


def test_op13_handed_on(monkeypatch):
    monkeypatch.setattr(trie, "HELD", 2)
    import pyarrow as pa

    names = ["base", "conv_id", "h1", "h2", "bytes", "owned_from", "before", "leaf"]
    rows = [(0, c, i, i, 3, None, None, None) for c in (0, 1) for i in range(12)]
    batches = [pa.RecordBatch.from_arrays([pa.array(list(x), pa.bool_() if n == "leaf" else pa.int64()) for n, x in zip(names, zip(*rows[lo : lo + 5], strict=True), strict=True)], names=names) for lo in range(0, 24, 5)]
    out = [r for b in trie._family_tries(iter(batches)) for r in b.to_pylist()]
    assert sum(r["n"] for r in out if not r["ends"]) == 26 and sum(r["ends"] for r in out) == 2 and len({r["node"] for r in out}) == 13


def test_op13_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (0, None, None, None), (0, 0, "user", "q"), (0, 0, "user", "q"), (3, 0, "user", LONG), (3, 1, "assistant", ""), (-7, 0, "user", "n"), (-5, 0, "user", "m"), (11, 0, "user", "absent base"), (12, 0, "", "")]
    assert as_dict(trie.trie(conversations(spark, rows))) == plain_trie(rows)
    assert trie.trie(conversations(spark, rows).where("false")).count() == 0


def test_op8_plain_words_are_held_once():
    """Words of letters, or of letters and then marks, were split by a pattern and held once more as pieces."""
    from winnow.llm import packing, queries

    coder = packing.WordIds(queries.tokenizer_file("word_bpe_49k.json"))
    said = "Plain words, all of LETTERS. it's we'll' x1 b12c don't.. a-b (in) 'quoted' naïve, Étude x' y's. z_q __ ,, \"yes\"; 3.14 I'm\x00 \x7f tab\x01s word<|x ét 中文, \U0001f600!".split()
    for word in said:
        assert coder.of_word(word) == coder.of(word) == coder.encode(word), word
    coder.renew()
    for word in ("plain", "Letters", "words", "words,", "words.", "Other,", "été"):
        assert coder.words[word] == coder.encode(word)
    assert set(coder.pieces) == {",", "."} and {"words", "words,", "words.", "other"} <= set(coder.words)
