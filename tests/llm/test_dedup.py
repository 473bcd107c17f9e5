import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabgauge.llm import components, exact_dedup, queries, simhash
from tests.llm.helpers import ODD, SF, docs, table, words


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    low = lambda i: -1 if i is None else i
    return groups, {t: max(g, key=low) for t, g in groups.items()}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_exact_groups(spark, limit):
    rows = ODD + [(100 + k, "copy") for k in range(40)]
    found = exact_dedup.refine(docs(spark, rows), carry={"text": F.col("text")}, broadcast_rows=limit).collect()
    groups, keep = brute_exact(rows)
    assert len(found) == len(rows)
    stays = defaultdict(int)
    for r in found:
        assert (r.keep_id, r.group_size) == (keep[r.text or ""], len(groups[r.text or ""]))
        assert not r.kept or r.doc_id == r.keep_id
        stays[r.text or ""] += r.kept
    assert set(stays.values()) == {1}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_exact_drop_keeps_one_row_of_each_text(spark, limit):
    table_ = docs(spark, ODD)
    left = exact_dedup.drop_copies(table_, broadcast_rows=limit)
    groups, keep = brute_exact(ODD)
    assert left.columns == table_.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted((str(keep[t]), t) for t in groups)


def test_exact_prefix_is_refined(spark):
    rows = [(k, "x" * 200 + str(k % 3)) for k in range(9)]  # equal lengths and prefixes
    assert {r.group_size for r in exact_dedup.refine(docs(spark, rows)).collect()} == {3}


def test_exact_empty_table(spark):
    assert exact_dedup.refine(docs(spark, [])).collect() == []
    assert exact_dedup.drop_copies(docs(spark, [])).collect() == []


def test_exact_query_runs_no_python(spark):
    found = queries.op10_exact_dedup(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = {r.doc_id: r for r in found.collect()}
    for i, text, *_ in table(SF, "documents"):
        assert rows[i].text_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    w = [x for x in text.split(" ") if x]
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps):
    v = np.array(fps, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    label = np.arange(len(v))
    while True:
        new = np.where(near, label[None, :], len(v)).min(1)
        if (new == label).all():
            return label
        label = new


def near_rows():
    rng, rows = random.Random(3), []
    for g in range(6):
        base = words(300, 50 + g).split()
        for k in range(5):
            w = list(base)
            for _ in range(k):
                w[rng.randrange(len(w))] = "changed"
            rows.append((10 * g + k + 100, " ".join(w)))
    return rows


def test_simhash_against_brute_force(spark):
    rows = [(i, t) for i, t in ODD if i is not None and i not in (8, 9, 10, 11)] + near_rows() + [(900, "one two three"), (901, "One\vtwo  THREE")]
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    for k, (i, _) in enumerate(rows):
        assert found[i].fp & (2**64 - 1) == fps[k]
        assert found[i].component_id == min(rows[j][0] for j in range(len(rows)) if label[j] == label[k])


def test_simhash_odd_rows_and_one_left(spark):
    found = simhash.near_duplicates(docs(spark, ODD)).collect()
    assert len(found) == len(ODD)
    by_id = {r.doc_id: r for r in found}
    assert by_id[9].component_id == by_id[10].component_id == 9 and by_id[11].component_id == 11
    assert by_id[1].fp == by_id[2].fp == by_id[6].fp == 0 and by_id[6].component_id == 1
    table_ = docs(spark, near_rows())
    for limit in (1_000_000, 0):
        left = simhash.keep_one(table_, similarity=None, broadcast_rows=limit)
        assert left.columns == table_.columns
        comps = {r.component_id for r in simhash.near_duplicates(table_).collect()}
        assert {r.doc_id for r in left.collect()} == comps
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def jaccard(a, b):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    split = lambda t: {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", low(t))] for k in range(max(1, len(w) - 4)) if w}
    x, y = split(a), split(b)
    return len(x & y) / len(x | y) if x and y else 0.0


@pytest.mark.parametrize("leaders, followers", [(1024, 2000), (3, 2)])
def test_similar_copies(spark, leaders, followers):
    rng, rows = random.Random(9), [(None, "kept as it has no id"), (None, "kept as it has no id"), (1, None), (2, ""), (3, "one"), (4, "One"), (5, "one two"), (6, words(60_000, 4)), (7, words(60_000, 4) + " more")]
    for g in range(8):
        base = words(200, 900 + g).split()
        for k in range(12):
            w = list(base)
            for _ in range(k % 6):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append((100 * g + 10 + k, " ".join(w)))
    gone = {r[0] for r in simhash.similar_copies(docs(spark, rows), leaders=leaders, followers=followers).collect()}
    stay = [(i, t) for i, t in rows if i is not None and i not in gone]
    by_id = {i: t for i, t in rows if i is not None}
    assert {4, 7} <= gone and not gone & {1, 2, 5, None}
    for i in gone:  # none goes without one that stays and is like it
        assert any(j < i and jaccard(t, by_id[i]) >= 0.8 for j, t in stay)
    for k, (i, t) in enumerate(stay):
        assert all(jaccard(t, u) < 0.8 for _, u in stay[k + 1 :])
    left = simhash.keep_one(docs(spark, rows))
    assert left.where("doc_id IS NULL").count() == 2 and left.columns == docs(spark, rows).columns
    assert simhash.similar_copies(docs(spark, [])).collect() == []


def test_similar_copies_by_kind_of_edit(spark):
    rng, rows, pairs = random.Random(10), [], {}
    for n in (100, 400, 1500):
        for k in range(16):
            for kind in ("scattered", "appended", "replaced"):
                i = 2 * len(pairs) + 1
                w = words(n, 10_000 + i).split()
                new, share = words(n, 20_000 + i).split(), rng.uniform(0.82, 0.9)
                if kind == "scattered":
                    v = list(w)
                    for at in rng.sample(range(n), max(1, int(n * (1 - share) / 9))):
                        v[at] = "changed"
                elif kind == "appended":
                    v = w + new[: int(n * (1 / share - 1))]
                else:
                    size = int(n * (1 - share) / (1 + share)) - 4
                    at = rng.randrange(n - max(1, size))
                    v = w[:at] + new[: max(1, size)] + w[at + max(1, size) :]
                rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
                pairs[i + 1] = (kind, jaccard(rows[-2][1], rows[-1][1]))
    want = {i for i, (_, j) in pairs.items() if j >= 0.8}
    assert min(sum(pairs[i][0] == kind for i in want) for kind in ("scattered", "appended", "replaced")) > 30
    assert {r[0] for r in simhash.similar_copies(docs(spark, rows)).collect()} == want


def test_least_hashes_do_not_depend_on_neighbours():
    texts = ["a b c d e f g", "", None, "one", "x y", "a b c d e f g", "a b c d e"]
    every = simhash.least_hashes(texts, 5, 6, 4)
    assert np.array_equal(every, np.concatenate([simhash.least_hashes([t], 5, 6, 4) for t in texts]))
    assert (every[0] == every[5]).all() and not every[1:3].any() and every[3:].all() and len(np.unique(every[3:])) == 4 * 6


def test_word_fingerprints_do_not_depend_on_neighbours():
    texts = ["a b c d", "", None, "one", "x y", "a b c d"]
    every = simhash.word_fingerprints(texts, 3)
    assert np.array_equal(every, np.concatenate([simhash.word_fingerprints([t], 3) for t in texts]))
    assert (every[0] == every[5]).all() and not every[1].any() and every[3].all()


def test_long_texts_are_counted_in_chunks():
    text = words(40_000, 5)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def balls(seed, centers, n, flips):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, 2**64, centers, dtype=np.uint64)[rng.integers(0, centers, n)]
    for _ in range(flips):
        v = np.where(rng.random(n) < 0.5, v ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), v)
    return np.unique(v)


@pytest.mark.parametrize("cap", [50_000, 20])
@pytest.mark.parametrize("seed, centers, n, flips", [(1, 40, 600, 5), (2, 2, 700, 4), (3, 300, 400, 6)])
def test_index_finds_every_link(spark, seed, centers, n, flips, cap):
    """A small cap deals full blocks out again, by the other bits."""
    v = balls(seed, centers, n, flips)
    fps = spark.createDataFrame([(s, int(x), f"{s}:{x}") for x in v.view(np.int64) for s in (0, 3)], "seed int, fp long, node string")
    found = simhash.links(fps, cap).cache()
    assert all(r.a[0] == r.b[0] for r in found.collect())  # no links between seeds
    roots = {int(r.node[2:]): int(r.root[2:]) for r in components.connected(found.where("a LIKE '3:%'"), "a", "b").collect()}
    got = [roots.get(int(x), int(x)) for x in v.view(np.int64)]
    label = brute_components(v)
    pairs = {(a, b) for a, b in zip(got, label.tolist())}
    assert len(pairs) == len(set(got)) == len(set(label.tolist()))


def test_gray_rank_neighbours_differ_in_one_bit():
    code = np.arange(256, dtype=np.uint64)
    code = code ^ (code >> np.uint64(1))
    assert (simhash.gray_rank(code) == np.arange(256)).all()


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 60)] + [(5, 5)]
    found = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(found[k] == 0 for k in range(1, 201)) and all(found[1000 + k] == 1000 for k in range(1, 60)) and len(found) == 259


def plans_text(df, name="text"):
    """Whether an exchange of the plan carries the column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
    return plan.count("Exchange"), [x for x in lines if re.match(r"\(\d+\) Exchange", x) and re.search(rf"Input \[\d+\]: \[[^\]]*\b_?{name}#", x)]


def test_exact_dedup_shuffles_no_texts(spark):
    for limit in (1_000_000, 0):
        made = exact_dedup.refine(spark.read.parquet(f"{SF}/documents.parquet"), broadcast_rows=limit)
        n, carrying = plans_text(made)
        assert n and not carrying


ROWS = [(1, "a b c d e f"), (5, "a b c d e f"), (5, "another text of its own that nothing else is like"), (5, None), (5, ""), (5, ""), (7, "u v w"), (7, "u v w"), (None, "u v w x")]


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_rows_of_one_id(spark, limit):
    """Rows are told apart by id and text: none goes that is no copy, and one of equal ones stays."""
    kept = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.collect())
    other = ("5", "another text of its own that nothing else is like")
    assert kept(exact_dedup.drop_copies(docs(spark, ROWS), broadcast_rows=limit)) == sorted([("5", "a b c d e f"), other, ("5", ""), ("7", "u v w"), ("None", "u v w x")])
    assert kept(simhash.keep_one(docs(spark, ROWS), broadcast_rows=limit)) == sorted([("1", "a b c d e f"), other, ("5", ""), ("7", "u v w"), ("None", "u v w x")])
    assert simhash.keep_one(docs(spark, []), broadcast_rows=limit).collect() == []


def test_links_are_settled_alike_in_one_task_and_by_joins(spark):
    rng = random.Random(12)
    pairs = {tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(90)} | {(100 + k, 99 + k) for k in range(1, 9)}
    rows = [(1, {"id": a, "h": 0}, {"id": b, "h": 0}) for a, b in pairs]
    found = spark.createDataFrame(rows, "root long, a struct<id:long,h:long>, b struct<id:long,h:long>")
    out = set()
    for a in sorted({a for a, _ in pairs}):
        if any(y not in out for x, y in pairs if x == a):
            out.add(a)
    for most in (500_000, 0):
        assert {r.a.id for r in simhash.settle(found, most).collect()} == out


def test_similar_copies_in_tiles(spark):
    """Without leaders all of a component is compared in tiles; the result is the same."""
    rng, rows = random.Random(19), []
    for g in range(3):
        base = words(120, 700 + g).split()
        for k in range(9):
            w = list(base)
            for _ in range(k % 5):
                w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
            rows.append((100 * g + 10 + k, " ".join(w)))
    found = [{r[0] for r in simhash.similar_copies(docs(spark, rows), leaders=leaders, followers=4, most_links=most).collect()} for leaders, most in ((0, 500), (0, 0), (100, 500))]
    out = set()
    for i, t in rows:
        if any(j < i and j not in out and jaccard(t, u) >= 0.8 for j, u in rows):
            out.add(i)
    assert found[0] == found[1] == found[2] == out and out


def test_recall_of_pairs_in_the_test_data(spark):
    """The share of all pairs of distinct texts with a similarity of 0.8 of which the stage keeps no more than one."""
    texts = sorted({t: i for i, t, *_ in table(SF.replace("0.001", "0.01"), "documents") if t}.items(), key=lambda x: x[1])
    split = [(i, {tuple(w[k : k + 5]) for w in [re.findall(r"[^\x20\x09-\x0D]+", t.lower())] for k in range(max(1, len(w) - 4)) if w}) for t, i in texts]
    by_shingle = defaultdict(list)
    for i, s in split:
        for x in s:
            by_shingle[x].append(i)
    sets, shared = dict(split), defaultdict(int)
    for ids in by_shingle.values():
        for k, i in enumerate(ids):
            for j in ids[k + 1 :]:
                shared[i, j] += 1
    pairs = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    frame = spark.createDataFrame([(i, t) for t, i in texts], "doc_id long, text string")
    stay = {r.doc_id for r in simhash.keep_one(frame).collect()}
    assert pairs and np.mean([not (i in stay and j in stay) for i, j in pairs]) >= 0.9
