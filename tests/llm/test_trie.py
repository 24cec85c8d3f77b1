"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from attestra.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, path string, ids int"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 * (1 if c >= 0 else -1))
        full[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in full.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
        ends[s].append(c)
    out = []
    for key, convs in members.items():
        below = [k for k in members if k[: len(key)] == key]
        saved = sum((len(members[k]) - 1) * words(k[-1][1].decode()) for k in below if k)
        parents = {k[:-1] for k in members if k}
        leaves = sum(k not in parents for k in below)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()
        out.append((min(convs), len(key), min(members[key[:-1]]) if key else None, len(convs), sum(len(k) == len(key) + 1 for k in below), leaves, saved, sha))
    return sorted(out, key=repr)


def built(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = trie.prefix_trie(trie.rebuild(trie.encode_turns(df)), **kw).collect()
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got], key=repr)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = ["", "one", "two words", "three small  words", "x\ty\n z", "Été 中文", "\x00 nul \x1f"]
    out = []
    for c in range(90):
        out += [(c, t, r.choice(["user", "assistant"]), r.choice(texts)) for t in range(r.randint(1, 6))]
    for c in range(200, 260):  # equal conversations
        out += [(c, t, "user", f"same {t}") for t in range(5)]
    for c in range(300, 360):  # a long shared head
        out += [(c, t, "user", "head") for t in range(12)] + [(c, 12, "assistant", f"end {c % 7}"), (c, 13, "user", f"{c}")]
    out += [(-7, 0, "user", "negative"), (-7, 1, None, None), (-20, 0, "user", "base"), (-20, 1, "user", "more")]
    out += [(500, None, "user", "null turn"), (500, 3, "b", "tie"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (500, 3, "a", "a tie"), (None, 1, "user", "lost"), (None, None, None, None)]
    out += [(601, 0, "user", "gone"), (1001, 0, "user", "alone")]  # may be rebuilt to nothing
    return out


@pytest.mark.parametrize("local", [3, 40, 10_000])
def test_trie_against_brute_force(spark, rows, local):
    assert built(spark, rows, local=local) == brute(rows)


def test_trie_small_and_empty(spark):
    assert built(spark, []) == []
    assert built(spark, [(None, 0, "user", "x")]) == []
    turnless = next(c for c in range(700, 900) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert built(spark, [(turnless, 0, "user", "x")]) == brute([(turnless, 0, "user", "x")])
    deep = [(20, t, "user", f"t{t % 3}") for t in range(3000)]
    got = built(spark, deep)
    assert len(got) == 3001 and {g[4] for g in got} == {0, 1} and all(g[5] == 1 for g in got)


def test_quicksort_ends_inside(spark):
    rows = [([1, 2], [3, 4], 2, 7, "a"), ([1], [3], 1, 9, "b"), ([1, 2, 5], [3, 4, 1], 1, 8, "c")]
    nodes = {(n[1], n[0]): n for n in trie.finish(rows, 0, None)}
    assert nodes[(1, 7)][3:] == [4, 1, 1, 3 * 3 + 2 * 4 + 0, "b"] and nodes[(0, 7)][4:6] == [1, 1] and nodes[(3, 8)][2] == 7
