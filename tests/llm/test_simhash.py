"""Fingerprints and components against plain versions; crowded keys; edge cases."""

import re

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash
from gridloom.llm.components import connected_components


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest index reachable over pairs at most two bits apart."""
    low = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            near = [j for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= 2]
            least = min(low[j] for j in near)
            for j in near:
                if low[j] > least:
                    low[j], changed = least, True
    return low


def test_every_remainder_has_one_correction():
    assert len(set(simhash._corrections().tolist())) == 2048


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_near_prints_share_a_key(bits):
    rng = np.random.default_rng(bits)
    prints = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    other = prints.copy()
    for i in range(len(other)):
        for b in rng.choice(64, bits, replace=False):
            other[i] ^= np.uint64(1 << int(b))
    assert all(set(a) & set(b) for a, b in zip(simhash.golay_keys(prints), simhash.golay_keys(other), strict=True))


@pytest.mark.parametrize("crowd", [2, 64])
def test_links_of_crowded_and_lonely_prints(spark, crowd):
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 1 << 62))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 62, 40)}
    prints |= {0, 3, 15, 63, 255}
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    edges = simhash.linked_prints(spark.createDataFrame([(p,) for p in signed], "fp long"), crowd)
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    low = components([p % (1 << 64) for p in signed])
    assert [roots.get(p, p) for p in signed] == [signed[i] for i in low]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert roots == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0


def test_edge_cases(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    rows = simhash.near_duplicates(docs).collect()
    assert sorted((repr(r["doc_id"]), r["fingerprint"]) for r in rows) == sorted((repr(i), f"{plain_print(t):016x}") for i, t in edge_rows)
    component = {r["doc_id"]: r["component_id"] for r in rows}
    assert component[2] == component[3] == component[4] == 2 and component[9] == 1 and component[5] == 5 and component[None] is None
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(map(repr, [1, 2, 5, 7, 8, None]))
    assert simhash.near_duplicates(make_docs([])).count() == simhash.deduplicate(make_docs([])).count() == 0


def test_one_row_of_each_group_stays(spark, make_docs):
    rows = [(i, f"alpha beta gamma number {i % 3} of these words") for i in range(30)]
    kept = {r["doc_id"] for r in simhash.deduplicate(make_docs(rows)).collect()}
    low = components([plain_print(t) for _, t in rows])
    assert kept == {i for i, c in enumerate(low) if i == c}
    mixed = [*rows, (None, rows[0][1]), (None, "some quite different words stand here"), (None, "some quite different words stand here"), (3, "another text under the same key as before")]
    out = simhash.deduplicate(make_docs(mixed)).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in out if r["doc_id"] is None or r["doc_id"] == 3) == [
        ("3", "another text under the same key as before"), ("None", "some quite different words stand here")]
