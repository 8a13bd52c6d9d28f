"""Operators 11 to 13 against brute force: uneven trees, all orders of filters, near copies in large groups; nulls, repeats, clashing names."""

import hashlib
import random
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

np = pytest.importorskip("numpy")
pytest.importorskip("trailspark.llm")
from trailspark.llm import filter_audit, hyper_minhash, merkle  # noqa: E402
from trailspark.llm.common import mix  # noqa: E402

CLASHES = ("leaf", "leaves", "node", "other", "root", "subroot", "path", "above", "t", "n", "i", "c", "m", "p", "g", "at", "l0", "l1", "x", "run", "to", "part", "mask", "h", "first", "last", "good", "toxic", "cells", "total", "step", "before", "own", "after", "k", "th", "regs", "s", "label", "kept", "a", "b", "lead")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def with_clashes(df):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows, fanout):
    """The rows of the manifest, sorted, by walking down one whole tree."""

    def field(v):
        v = None if v is None else str(v)
        return "-" if v is None else f"{len(v.encode())}:{v}"

    def leaf_of(r, text):
        d, _, lang, source, n = r
        return sha(field(d), field(source), field(lang), field(n), field(text))

    def tree(nodes):
        """The root, and for each node the (before, after) of its way up."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for leaf, j in enumerate(at):
                first = j - j % fanout
                ways[leaf].append(("".join(nodes[first:j]), "".join(nodes[j + 1 : first + fanout])))
            nodes, at = [sha(*nodes[j : j + fanout]) for j in range(0, len(nodes), fanout)], [j // fanout for j in at]
        return nodes[0], ways

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        own = sorted(((r, leaf_of(r, r[1])) for r in rows if r[3] == s), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees.append((own, *tree([x for _, x in own])))
    root, tops = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, subroot, ways), top in zip(trees, tops, strict=True):
        for (r, leaf), way in zip(own, ways, strict=True):
            d, text = r[0], r[1]
            h = leaf_of(r, text.translate(lower)) if d is not None and text is not None and zlib.crc32(str(d).encode()) % 5 == 0 else leaf
            for before, after in way + top:
                h = sha(before, h, after)
            out.append((d, leaf, subroot, root, sha(*(b + a for b, a in way + top)), h, h == root))
    return sorted(out, key=str)


def merkle_rows(counts, rng):
    rows = []
    for source, n in counts:
        rows += [(rng.randrange(10**6), rng.choice(["Ab", "ab ", "ÄÖ x", "", None, "Z" * 300]), rng.choice(["en", None]), source, rng.choice([1, None])) for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("fanout, levels", [(2, 1), (3, 1), (2, 2), (16, 2)])
def test_merkle_trees_of_any_size(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(merkle, "FANOUT", fanout)
    monkeypatch.setattr(merkle, "LOCAL_LEVELS", levels)
    rng = random.Random(fanout + levels)
    sizes = [1, 2, 3, 4, 5, 7, 9, 16, 17, 19, 28, 33, 65]
    rows = merkle_rows([(None, 6), ("", 3), ("é", 2), *((f"s{k}", n) for k, n in enumerate(sizes))], rng)
    rows += [(None, "no id", "en", "s3", 1), (None, "no id either", "en", "s3", 1), rows[0], rows[1]]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(5)
    out = merkle.merkle_manifest(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, out.collect()), key=str) == manifest(rows, fanout)


def test_merkle_over_many_chunks(spark):
    rows = merkle_rows([("one", 4500), ("two", 257), ("three", 16)], random.Random(8))
    assert sorted(map(tuple, merkle.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == manifest(rows, 16)


def test_merkle_of_nothing_and_of_one(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    (only,) = merkle.merkle_manifest(spark.createDataFrame([(1, "x" * 2_000_000, None, None, None)], SCHEMA)).collect()
    assert only["leaf"] == only["subroot"] == only["root"] == only["folded_root"] and only["verified"] and only["proof_sha256"] == sha()


def test_each_chunk_of_a_round_gets_at_most_a_parent(spark, monkeypatch):
    monkeypatch.setattr(merkle, "FANOUT", 4)
    for m in (1, 3, 4, 5, 17, 63, 65):
        state = spark.createDataFrame([(0, c, m, f"n{c}", []) for c in range(m)], "t long, c long, m long, node string, path array<struct<before: string, after: string>>")
        for block in (1, 4, 16, 64):
            if block >= m:
                break
            state = merkle.swapped(state, block)
        got = state.collect()
        assert len(got) == m and len({r["node"] for r in got}) == 1


def audit(rows, labels):
    fails, first = {}, {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    marked = []
    for d, t, _, source, _ in rows:
        t = t or ""
        w = t.encode().split()
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), d is not None and d > first[t])
        marked.append((source or "", d, {x for x, bad in zip("ABCDE", tests, strict=True) if bad}))
    out = []
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        removed_in = {}
        for order in map("".join, permutations("ABCDE")):
            gone: set[int] = set()
            for step, x in enumerate(order, 1):
                here = [j for j, m in enumerate(own) if x in m[2] and j not in gone]
                redundant = sum(x in m[2] for m in own) - len(here)
                gone |= set(here)
                removed_in[x] = removed_in.get(x, 0) + len(here)
                out.append([part, order, step, len(own) - len(gone), len(here), redundant, sum(m[2] == {x} for m in own), sum(own[j][1] in good for j in here), sum(own[j][1] in toxic for j in here), x])
        for r in out:
            if r[0] == part:
                r[-1] = removed_in[r[1][r[2] - 1]]
    return sorted(map(tuple, out))


def test_audit_against_all_orders(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["aa", "bb", "Cc", "dd", "D#", "ee"] + [f"w{k}" for k in range(many)]) for _ in range(n)) for n in (3, 150, 210, 260) for many in (3, 90, 400) for _ in range(2)] + ["x " * 250, "", None, "ÄÖÜ" * 5]
    rows = [(k if k % 17 else None, rng.choice(texts), "en", rng.choice(["s", "t", "", None]), 1) for k in range(150)]
    rows += [rows[3], rows[4]]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 150, 2)] + [(8, 1, 0), (8, 0, 1), (None, 1, 1), (999, 1, 1)]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    out = filter_audit.audit_filters(df, with_clashes(spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumnRenamed("toxic", "tx")).drop("toxic").withColumnRenamed("tx", "toxic"))
    got = sorted(map(tuple, out.collect()))
    assert got == audit(rows, labels) and len(got) == 3 * 600
    # a step's shares add up to what all filters remove, times the orders
    for part in {r[0] for r in got}:
        order = [r for r in got if r[0] == part and r[1] == "ABCDE"]
        assert sum(r[-1] for r in order) == 120 * sum(r[4] for r in order)


def test_audit_of_nothing(spark):
    assert filter_audit.audit_filters(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
    one = filter_audit.audit_filters(spark.createDataFrame([(1, None, None, None, None)], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(one) == 600 and sum(r["removed"] for r in one) == 120


def near(rows, width, percent):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    top = [r[0] if not sets[i] else least.get(root(i)) for i, r in enumerate(rows)]
    return sorted(((r[0], len(sets[i]), top[i], r[0] == top[i]) for i, r in enumerate(rows)), key=str)


def near_rows():
    rng = random.Random(21)
    words = [f"w{k}" for k in range(4000)]
    base = [[rng.choice(words) for _ in range(n)] for n in (7, 9, 12, 20, 33, 60, 90, 150, 260, 400)]
    rows = []
    for b in base:
        for k in range(14):  # from a word or two up to about the threshold
            t = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 22))):
                j = rng.randrange(len(t))
                t[j : j + 1] = rng.choice([[], [rng.choice(words)], [t[j], rng.choice(words)]])
            rows.append((len(rows), (" ".join(t)).upper() if k % 3 else "\t".join(t), "en", "s", 1))
    group = [rng.choice(words) for _ in range(200)]
    rows += [(1000 + k, " ".join(group[:k] + [f"own{k}"] + group[k + 1 :]), "en", "s", 1) for k in range(0, 180, 3)]  # a long list
    apart = [[rng.choice(words) for _ in range(300)] for _ in range(30)]
    rows += [(2000 + k, " ".join(group + a), "en", "s", 1) for k, a in enumerate(apart)]  # share a passage, no more
    return rows + [(3000, None, None, None, None), (3001, "", "", "", 0), (3002, " \n\t", "en", "s", 3), (3003, "one two", "en", "s", 7), (3003, "one two", "en", "s", 7), (3004, "One\nTWO", "en", "s", 7), (None, rows[5][1], "en", "s", 1), (None, "alone with no id", "en", "s", 1)]


def test_near_duplicates_against_brute_force(spark):
    rows = near_rows()
    out = hyper_minhash.near_duplicates(with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(4))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, out.collect()), key=str) == near(rows, 3, 85)


def test_near_duplicates_of_nothing_and_of_long_texts(spark):
    assert hyper_minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(2)
    long_text = " ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    rows = [(1, long_text, "en", "s", 1), (2, long_text + " end", "en", "s", 1), (3, "x" * 1_000_000, "en", "s", 1), (4, long_text[: len(long_text) // 2], "en", "s", 1)]
    assert {r["doc_id"]: r["component_id"] for r in hyper_minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    for n in (300, 3000, 40_000):
        for share in (0.0, 0.5, 0.85):
            errors = []
            for _ in range(30):
                common, x, y = (rng.integers(0, 2**63, k, dtype=np.uint64) for k in (int(n * share), n - int(n * share), n - int(n * share)))
                a, b = np.unique(mix(np.concatenate([common, x]))), np.unique(mix(np.concatenate([common, y])))
                about, full = hyper_minhash.likeness([len(a)], [len(b)], [hyper_minhash.registers(a).tobytes()], [hyper_minhash.registers(b).tobytes()])
                errors.append(about[0] - len(common) / (len(common) + len(x) + len(y)))
            assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2 and full[0] <= hyper_minhash.BUCKETS


def test_chance_of_equal_registers():
    rng = np.random.default_rng(9)
    n, m, equal = 1500, 900, 0
    for _ in range(400):
        p, q = (hyper_minhash.registers(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (n, m))
        equal += ((p == q) & (p > 0)).sum()
    expected = hyper_minhash.chance_equal(np.array([n]), np.array([m]))[0]
    assert expected > 0 and abs(equal / 400 - expected) < 0.35 * expected + 0.02
