"""The prefix trie against a plain recursion, with small bounds so that every distributed step takes part."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from boxoffice.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def order(role, text):
    digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def plain(rows, shared=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, *order(role or "", text or ""), role or "", text or ""))
    convs = {c: [t[4:] for t in sorted(turns)] for c, turns in convs.items()}
    if shared:
        heads = {c: zlib.crc32(str(c).encode()) % 6 for c in convs}
        convs = {c: convs.get(c - c % 100, [])[: heads[c]] + turns[heads[c]:] for c, turns in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, own in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own) - 1) * len(path[-1][1]) if path else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((own[0], len(p), members[p[:-1]][0] if p else -1, len(own), children[p] if p in children else 0, leaves[p], saved[p], sha(ends[p]))
                  for p, own in members.items())


def seen(frame):
    return sorted(tuple(-1 if v is None else v for v in r) for r in frame.collect())


def some_rows(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randrange(40), 100 + rng.randrange(30), 900 + rng.randrange(200), 250 + rng.randrange(5)])
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hello", "Ünï", ""])) for t in range(rng.randrange(1, 5))]
    return rows


@pytest.mark.parametrize("bounds", [{}, {"arcs_per_task": 60, "last": 40}])
def test_shared_prefixes(spark, bounds, monkeypatch):
    rows = some_rows(140)
    monkeypatch.setattr(trie, "SLICE", 64 if bounds else trie.SLICE)
    if bounds:
        monkeypatch.setattr(trie.prefix_trie, "__defaults__", (None, bounds["arcs_per_task"], bounds["last"]))
        monkeypatch.setattr(trie.end_digests, "__defaults__", (12,))
    assert seen(trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_deep_conversation_and_common_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "SLICE", 100)
    deep = [(5, t, "user", str(t % 7)) for t in range(1500)] + [(6, t, "user", str(t % 7)) for t in range(700)] + [(3, t, "user", str(t % 7)) for t in range(900)]
    same = [(10 + c, t, "user", "same") for c in range(3000) for t in range(2)]
    rows = deep + same
    frame = spark.createDataFrame(rows, SCHEMA)
    turns = trie.numbered_turns(frame)
    built = trie.prefix_trie(turns, arcs_per_task=1500, last=150)
    nodes = built.nodes.join(trie.end_digests(built.ends, 500), list(trie.NODE), "left")
    got = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce(
        "ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    assert seen(got) == plain(rows, shared=False)
    tour = sorted(x for r in built.nodes.select("first", "last").collect() for x in r)
    assert tour == list(range(len(tour)))


def test_odd_rows(spark):
    long = "word " * 50_000
    rows = [(None, 1, "user", "x"), (1, None, "user", "a"), (1, 2, None, None), (1, 2, "", ""), (1, 2, "b", "t"), (1, 2, "b", "t"), (2, 5, "user", long),
            (2, 5, "user", long), (100, 1, "u", "a"), (101, 1, "u", "b"), (101, 2, "u", "\U0001F600é"), (230, 0, "u", "z"), (7, 0, "1:", "x"), (7, 1, "1", ":x")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *(f"'x' as `{c}`" for c in ("place", "depth", "f1", "chars", "c", "e", "family", "_slice", "m1")))
    assert seen(trie.shared_prefixes(frame)) == plain(rows)
    assert trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_conversations_without_turns_left(spark):
    rows = [(c, 0, "user", "only") for c in range(300, 330) if c % 100] + [(400, 0, "user", "a")] + [(c, 0, "user", "b") for c in range(401, 420)]
    got = seen(trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and got[0][3] == len({r[0] for r in rows})
