"""The conversation trie against a plain version that keeps every node in a dictionary."""

import hashlib
import random
import zlib

import pytest

from kmerlake.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, member long, path string, a long, last boolean"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def ordered(rows):
    conv = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            conv.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    return {c: tuple(x[3:] for x in sorted(v)) for c, v in conv.items()}


def rebuilt(conv):
    out = {}
    for c, own in conv.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = conv.get(base, ())[:h] + own[h:]
    return out


def plain_nodes(conv):
    nodes, kids, totals = {}, {}, {}
    for c, turns in conv.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(nodes, key=len, reverse=True):
        below = [totals[x] for x in kids.get(p, [])]
        own = (len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0
        totals[p] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
    ends = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[p] if len(conv[c]) == len(p)))).encode()).hexdigest()
    return {(min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *totals[p], ends(p)) for p, m in nodes.items()}


def found(frame):
    rows = [tuple(r[c] for c in COLUMNS) for r in frame.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    rows = []
    for c in list(range(60)) + [-7, -5, 103, 10**15]:
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, ["user", "assistant"][turn % 2], rng.choice(["hi", "ok", "é🎉", ""])))
    rows += [(200 + i, t, "user", "same old") for i in range(25) for t in range(3)]  # very common
    rows += [(301, t, "user", f"turn {t % 3}") for t in range(300)]  # very long
    rows += [(302, None, None, None), (302, None, "user", None), (302, 1, "x", "tie"), (302, 1, "w", "tie"), (302, 1, "w", "tie"), (None, 1, "user", "lost"), (303, 0, "ab", "c"), (304, 0, "a", "bc")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def table(spark, talk):
    return spark.createDataFrame([(*r, None, 1, "p", 2, True) for r in talk], SCHEMA).repartition(4)


def test_rebuilt_trie(talk, table):
    assert found(prefixtrie.rebuilt_trie(table)) == plain_nodes(rebuilt(ordered(talk)))


def test_trie_as_it_is(talk, table):
    assert found(prefixtrie.conversation_trie(table)) == plain_nodes(ordered(talk))


def test_paths_that_hang_on_paths(spark):
    rows = [(c, t, "u", "x") for c in range(1, 12) for t in range(c)] + [(c, 0, "u", "y" * c) for c in range(20, 23)]
    frame = spark.createDataFrame([(*r, None, 1, "p", 2, True) for r in rows], SCHEMA)
    assert found(prefixtrie.conversation_trie(frame)) == plain_nodes(ordered(rows))


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.rebuilt_trie(empty).collect() == [] == prefixtrie.conversation_trie(empty).collect()


def test_pieces_of_a_common_end(spark):
    ends = spark.range(5000).selectExpr("1L AS conv_id", "id % 2 AS depth", "id * 7 AS member")
    want = {d: hashlib.sha256(",".join(str(i * 7) for i in range(5000) if i % 2 == d).encode()).hexdigest() for d in (0, 1)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.depth: r.ends_sha256 for r in prefixtrie.joined_digests(ends).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
