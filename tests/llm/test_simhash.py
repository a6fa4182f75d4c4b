import random

from narrata.llm import simhash
from narrata.llm.common import table
from tests.llm.helpers import FOLDER, documents, no_docs, odd_docs, plain


def brute(prints):
    """Least id reachable over links of three bits, by union-find over all pairs."""
    parent = {f: f for f in prints.values()}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    each = list(parent)
    for i, a in enumerate(each):
        for b in each[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints.items():
        least[root(f)] = min(i, least.get(root(f), i))
    return {i: least[root(f)] for i, f in prints.items()}


def test_fingerprint_by_hand():
    import xxhash

    words = "The  Quick\tbrown fox The Quick brown".split()
    low = [w.lower() for w in words]
    hashes = [xxhash.xxh64_intdigest(" ".join(low[i : i + 3]), 42) for i in range(len(low) - 2)]
    wanted = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of("The  Quick\tbrown fox\x0bThe Quick brown") & (2**64 - 1) == wanted
    assert simhash.fingerprint_of(" \n") == simhash.fingerprint_of(None) == 0
    assert simhash.fingerprint_of("Éa B") & (2**64 - 1) == xxhash.xxh64_intdigest("Éa b", 42)


def test_components_equal_brute_force(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    wanted = brute({r["doc_id"]: simhash.fingerprint_of(r["text"]) for r in rows})
    assert dict(plain(simhash.simhash_components(documents(spark)), "doc_id", "component_id")) == wanted


def test_crowded_buckets_connect_as_pairs_do(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base}
    for _ in range(150):
        f = rng.choice(sorted(prints))
        for _ in range(rng.randint(1, 5)):
            f ^= 1 << rng.randrange(64)
        prints.add(f)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    signed = {i: f - (1 << 64) if f >> 63 else f for i, f in enumerate(sorted(prints))}
    frame = spark.createDataFrame([(f,) for f in signed.values()], "fp long")
    back = {f: i for i, f in signed.items()}
    for crowd in (1, 3, 1000):
        edges = simhash.links(frame, crowd)
        assert all(((r["a"] ^ r["b"]) & (2**64 - 1)).bit_count() <= 3 for r in edges.collect())
        roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
        groups = {}
        for i, f in signed.items():
            groups.setdefault(roots.get(f, f), []).append(i)
        got = {i: min(g) for g in groups.values() for i in g}
        assert got == brute({back[f]: f for f in signed.values()}), crowd


def test_odd_rows_have_defined_results(spark):
    got = simhash.simhash_components(odd_docs(spark))
    assert got.count() == 15
    zero = [r for r in got.collect() if r["fingerprint"] == "0" * 16]
    assert {r["doc_id"] for r in zero} == {0, 1, 2, 3, None} and {r["component_id"] for r in zero} == {0}
    assert simhash.simhash_components(no_docs(spark)).count() == 0
