"""SimHash groups against all pairs."""

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import untouched
from boxoffice.llm import simhash
from boxoffice.llm.components import components, local_roots


def brute_groups(ids, prints, distance=4):
    fp = np.array(prints, np.uint64)
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= distance)
    roots = local_roots(len(fp), i, j)
    least = {}
    for r, d in zip(roots, ids):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [least.get(r) for r in roots]


def plain_fingerprint(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize("text", [None, "", "One", "a B c", "a b c d", "a b c d e a b c d e x", "é Ünï\x0bx y z w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_groups_on_the_small_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = simhash.near_duplicate_groups(frame).orderBy("doc_id").collect()
    texts = {r["doc_id"]: r["text"] for r in frame.collect()}
    prints = [int(r["fingerprint"], 16) for r in got]
    assert all(prints[k] == plain_fingerprint(texts[r["doc_id"]]) for k, r in enumerate(got) if k % 50 == 0)
    assert [r["component_id"] for r in got] == brute_groups([r["doc_id"] for r in got], prints)


@pytest.mark.parametrize("cell_rows", [4096, 7])
def test_links_find_every_chain_in_dense_and_cut_cells(spark, cell_rows):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(seeds.tolist())
    for s in seeds[:25].tolist():  # random walks by a few bits: chains and dense groups
        for _ in range(30):
            s ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 5)))
            prints.add(s)
    prints = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.linked(frame, 4, cell_rows)).collect()}
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    got = [roots.get(p, p) for p in signed]
    want = brute_groups(range(len(prints)), prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_odd_rows(odd):
    got = simhash.near_duplicate_groups(odd).collect()
    assert len(got) == odd.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert by_id[1][0]["fingerprint"] == "0" * 16 and by_id[1][0]["component_id"] == 1  # the null text
    assert {r["component_id"] for r in by_id[2]} == {1}  # the empty one is linked to it
    assert [r["component_id"] for r in by_id[3]] == [3, 3]


def test_one_row_of_each_group_stays(odd, none):
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    untouched(kept)
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids) == [1, 3, 4, 5, 7]
    assert simhash.drop_near_duplicates(none).collect() == []
    assert simhash.near_duplicate_groups(none).collect() == []


def test_a_group_without_ids_keeps_a_row(docs):
    kept = simhash.drop_near_duplicates(docs([(None, "p q r s t u"), (None, "p q r s t u"), (5, "quite another text here")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "None"]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 100)] + [(500, 501), (501, 500)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    place = {n: i for i, n in enumerate(nodes)}
    links = [(place[a], place[b]) for a, b in edges if a != b]
    want = local_roots(len(nodes), np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
    assert set(got) == set(nodes)
    assert len({(got[n], want[place[n]]) for n in nodes}) == len(set(got.values())) == len(set(want.tolist()))


def test_fingerprints_hold_the_texts_of_few_rows_at_a_time():
    import pyarrow as pa

    n = 1000
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": [f"word {i}" for i in range(n)], "row_key": pa.array(range(n), pa.int64())})
    out = list(simhash._fingerprints(iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and sum((b.column("doc_id").to_pylist() for b in out), []) == list(range(n))
