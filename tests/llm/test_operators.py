"""Every operator against a brute-force version on a small table with nulls, ties, copies and odd texts."""
import collections
import hashlib
import itertools
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from compare import check, connect

from pricemill.llm import common, fingerprints, jaccard_join, language, lattice, mixing, pieces, polytope, quality, queries, secret_scan, sharding, substrings
from pricemill.llm.bytework import rounds

WORD = re.compile(r"[^\x20\x09-\x0D]+")
lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
OPS = sorted(queries.QUERIES, key=lambda q: int(re.match(r"op(\d+)", q)[1]))


def run(spark, name, folder):
    return [r.asDict() for r in queries.QUERIES[next(q for q in OPS if q.startswith(name + "_"))](spark, folder).collect()]


def by_row(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, empty_dir, name):
    df = queries.QUERIES[name](spark, empty_dir)
    assert df.collect() == [] and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", OPS[:10])
def test_a_row_for_every_row(spark, fixture_dir, documents, name):
    got = [r["doc_id"] for r in queries.QUERIES[name](spark, fixture_dir).collect()]
    assert collections.Counter(got) == collections.Counter(d["doc_id"] for d in documents)


# The other twins take doc_id for a key, which this table's isn't; they run over the given tables.
@pytest.mark.parametrize("name", [q for q in sorted(queries.ORACLES) if q[:4] in ("op1_", "op10")])
def test_sql_twin(spark, fixture_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{fixture_dir}/documents.parquet/*.parquet'")
    problem = check(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], fixture_dir)
    assert problem is None or problem.startswith("near"), problem


def test_mix_comes_near_its_targets(spark, fixture_dir):
    rows = run(spark, "op1", fixture_dir)
    assert rows == run(spark, "op1", fixture_dir) or by_row(rows, *rows[0]) == by_row(run(spark, "op1", fixture_dir), *rows[0])
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] for r in rows)


def test_mix_floor_keeps_all(spark, fixture_dir, documents):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    got = collections.Counter(r["doc_id"] for r in mixing.mix(docs, floor=1.0).collect())
    want = collections.Counter(d["doc_id"] for d in documents)
    assert all(want[k] <= got[k] <= 2 * want[k] for k in want) and set(got) == set(want)


def shingles(text, n):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def linked(documents, n, share):
    """Smallest id reachable, by id; rows of one id are one node."""
    sets = [(d["doc_id"], shingles(lower(d["text"] or ""), n)) for d in documents if d["doc_id"] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= share * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("n,share,task", [(3, 90, {}), (5, 80, {}), (3, 90, {"task_grams": 300, "task_docs": 2})])
def test_jaccard_components(spark, fixture_dir, documents, n, share, task):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    rows = [r.asDict() for r in jaccard_join.join_components(docs, n, share, **task).collect()]
    want = linked(documents, n, share)
    assert by_row(rows, "doc_id", "n_shingles", "component_id") == collections.Counter(
        (d["doc_id"], len(shingles(lower(d["text"] or ""), n)), want.get(d["doc_id"])) for d in documents)


def kept_rows(documents, n, share):
    """(doc_id, text) of the rows that stay when every row is judged by its own text."""
    sets = [shingles(lower(d["text"] or ""), n) for d in documents]
    near = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    root = polytope.forest(np.array([a for a, _ in near]), np.array([b for _, b in near]), len(sets))
    first = {}
    for i, d in enumerate(documents):
        key = (d["doc_id"] is None, d["doc_id"] or 0, i)
        first[root[i]] = min(first.get(root[i], key), key)
    return collections.Counter((documents[key[2]]["doc_id"], documents[key[2]]["text"]) for key in first.values())


@pytest.mark.parametrize("n,share", [(3, 90), (5, 80)])
def test_keep_one_judges_rows_by_their_own_text(spark, fixture_dir, documents, n, share):
    rows = documents + [  # two unrelated texts under one id; a copy and an unrelated text under one id; a copy without an id
        {"doc_id": 900, "text": "first of two texts that share nothing but a number of their source"},
        {"doc_id": 900, "text": "an entirely different report about rivers and the towns along them"},
        {"doc_id": 903, "text": "first of two texts that share nothing but a number of their source"},
        {"doc_id": 903, "text": "some third matter altogether written down by someone else again"},
        {"doc_id": None, "text": "some third matter altogether written down by someone else again"},
        {"doc_id": None, "text": "only here and without any number at all in this table"}]
    table = spark.createDataFrame([(r["doc_id"], r["text"], "x") for r in rows], "doc_id long, text string, component_id string").repartition(4)
    got = jaccard_join.keep_one(table, n, share)
    assert got.columns == table.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == kept_rows(rows, n, share)


@pytest.mark.parametrize("most", [1 << 25, 0])
def test_row_numbers_are_unique(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", most)
    ids = [5, 5, 5, None, None, -1, -2, -3, -4, -5, -6, -7, 9, 9, 12]
    table = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    rows = jaccard_join.row_numbers(table).collect()
    assert sorted(r["text"] for r in rows) == sorted(f"t{k}" for k in range(len(ids))) and len({r["_row"] for r in rows}) == len(ids)
    assert not most or all(r["_row"] == r["doc_id"] for r in rows if ids.count(r["doc_id"]) == 1 and r["doc_id"] is not None)


def test_large_clusters_are_cut_where_no_link_can_be(spark):
    """Texts of a passage that many hold, of one that few hold and of their own; every tenth is a near copy of the one before."""
    rnd = np.random.default_rng(6)
    word = lambda k: [f"w{x}" for x in rnd.integers(0, 1 << 40, k)]
    common, some = word(25), [word(12) for _ in range(12)]
    texts = []
    for i in range(240):
        texts.append(texts[-1][:-1] + word(1) if i % 10 == 9 else common + some[i % 12] + word(20))
    rows = [{"doc_id": i, "text": " ".join(t)} for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    members = docs.select("doc_id", F.lit(0).alias("cluster"), (F.size(F.split("text", " ")) - 4).cast("long").alias("n"))
    cut = {r["doc_id"]: r["cluster"] for r in jaccard_join.narrowed(docs, members, 5, 80, task_docs=20).collect()}
    root = linked(rows, 5, 80)
    near = {i for i in root if list(root.values()).count(root[i]) > 1}
    assert len(near) == 48 and near <= set(cut) and all(cut[i] == cut[root[i]] for i in near)
    assert len(cut) <= 72 and max(collections.Counter(cut.values()).values()) <= 20  # one cluster of 240 before
    small = jaccard_join.narrowed(docs, members, 5, 80)  # nothing is cut where a cluster is one task
    assert small.count() == 240


@pytest.mark.parametrize("share", [90, 80])
def test_linked_sets_always_share_one_of_their_rarest_grams(share):
    rnd = np.random.default_rng(3)
    for n in [*range(1, 40), 150, 400]:
        whole = rnd.integers(0, 1 << 63, 2 * n + 4, np.uint64)
        for counts in (np.zeros(jaccard_join.COUNTERS, np.int64), rnd.integers(0, 5, jaccard_join.COUNTERS)):
            for m in {n, max(1, n * share // 100), n * 100 // share}:
                common = math.ceil(share * (n + m) / (100 + share))
                if common > min(n, m):
                    continue
                both = [np.sort(whole[:n]), np.sort(np.concatenate([whole[:common], whole[n:n + m - common]]))]
                key, text = jaccard_join.rarest(np.concatenate(both), np.cumsum([0, n, m]), counts, share)
                assert set(key[text == 0].tolist()) & set(key[text == 1].tolist()), (n, m)
                assert (text == 0).sum() <= n - share * n // 100 + 1


def test_keep_one_where_no_table_can_be_sent(spark, fixture_dir, documents, monkeypatch):
    """Copies under new ids, and sides that are too large for a broadcast."""
    rows = [{"doc_id": None if d["doc_id"] is None else d["doc_id"] + 100_000 * k, "text": d["text"]} for d in documents for k in range(3)]
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "SIEVE_BITS", 256)  # so that rows pass by chance
    got = jaccard_join.keep_one(table, 5, 80)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == kept_rows(rows, 5, 80)


def test_rows_without_an_id_of_their_own_are_written_once(spark, monkeypatch):
    written = []

    def noted(df, purpose, do=common.materialise):
        if "text" in df.columns:
            written.append((purpose, "Exchange" in df._jdf.queryExecution().optimizedPlan().toString() or "Repartition" in df._jdf.queryExecution().optimizedPlan().toString()))
        return do(df, purpose)

    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "materialise", noted)
    table = spark.createDataFrame([(i % 7 if i % 3 else None, f"text {i}") for i in range(60)], "doc_id long, text string")
    assert jaccard_join.row_numbers(table).select("_row").distinct().count() == 60
    assert written == [("numbered-rows", False)]  # "odd-rows", sorted by ranges, was another copy of them before


def test_large_families_cost_as_much_as_they_have_members(spark):
    """Rows dealt for one cluster whose members the hubs connect, but for a few."""
    dealt = {}
    for size in (3000, 12000):
        members = spark.range(size).select(F.col("id").alias("doc_id"), F.lit(0).alias("cluster"), (F.lit(100) + F.col("id") % 3).alias("n"))
        first = jaccard_join.hub_tasks(members, task_docs=500)
        rest = jaccard_join.product_tasks(members.withColumn("core", F.col("doc_id") % 1500 != 0), 90, task_docs=500)
        dealt[size] = [t.agg(F.sum(F.size("tasks"))).first()[0] for t in (first, rest)]
    assert dealt[3000][0] <= 3000 + 2 * 7 and dealt[12000][0] <= 12000 + 2 * 25
    assert dealt[12000][1] <= 8 * 12000 and dealt[12000][1] <= 5 * dealt[3000][1]


@pytest.mark.parametrize("task", [{"task_docs": 4}, {"task_docs": 7, "task_grams": 900}])
def test_families_cut_into_many_tasks_keep_all_links(spark, task):
    """Chains of texts, each like the next only, so that two hubs leave much of a cluster open."""
    rnd = np.random.default_rng(4)
    texts = []
    for _ in range(3):
        words = [f"w{x}" for x in rnd.integers(0, 10000, 120)]
        for _ in range(25):
            words = words.copy()
            words[rnd.integers(0, 120)] = f"n{rnd.integers(0, 10000)}"
            texts.append(" ".join(words))
    rows = [{"doc_id": 3 * i + 1, "text": t} for i, t in enumerate(texts)]
    table = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_components(table, 3, 90, **task).collect()}
    assert got == linked(rows, 3, 90)


def test_linked_sets_always_share_a_shown_block():
    """Pairs at the very bound of the similarity, of all sizes, over random sets."""
    rnd = np.random.default_rng(3)
    for share in (90, 80):
        for n in [*range(1, 60), 150, 400, 1000]:
            whole = rnd.integers(0, 1 << 63, 2 * n + 4, np.uint64)
            for m in {n, max(1, n * share // 100), min(2 * n, n * 100 // share), max(1, n - 1)}:
                common = math.ceil(share * (n + m) / (100 + share))
                if common > min(n, m):
                    continue
                a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[:common], whole[n:n + m - common]]))
                keys = [set(jaccard_join.shown_blocks(x, np.array([0, len(x)]), share)[0].tolist()) for x in (a, b)]
                assert keys[0] & keys[1] or (a.tolist() == b.tolist()), (share, n, m)


def test_fingerprints(spark, fixture_dir, documents, monkeypatch):
    order = sorted(documents, key=lambda d: (d["doc_id"] is None, -(d["doc_id"] or 0), (d["text"] or "").encode()))
    rows = [r.asDict() for r in fingerprints.op3(spark, fixture_dir).collect()]
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (4000,))
    assert by_row(rows, *rows[0]) == by_row([r.asDict() for r in fingerprints.op3(spark, fixture_dir).collect()], *rows[0])
    want, errors = collections.Counter(), []
    texts = [d["text"] or "" for d in order]
    prints = dict(zip(texts, [fingerprints.packed(fingerprints.Sketcher().sketch(__import__("pyarrow").array([t])))[0].as_py() for t in texts]))
    for i, d in enumerate(order):
        text, after = texts[i], texts[(i + 1) % len(order)]
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        want[(d["doc_id"], len(text), hashlib.sha256(edited.encode()).hexdigest(), prints[text])] += 1
    assert by_row(rows, "doc_id", "n_chars", "edited_sha256", "fingerprint") == want
    assert all(0 <= r["near_edited"] <= 1 and len(r["edited_fingerprint"]) == fingerprints.BINS for r in rows)
    for d, e in itertools.combinations([t for t in texts if len(WORD.findall(t)) > 60], 2):
        s, t = shingles(d, 5), shingles(e, 5)
        digits = [np.array([int(c, 16) for c in prints[x]])[None] for x in (d, e)]
        errors.append(fingerprints.likeness(*digits)[0] - len(s & t) / len(s | t))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.25


def all_ways(word, model):
    """(pieces, log probability) of every segmentation of a byte string."""
    ids = {t: i for i, t in enumerate(model.texts) if t}
    chars = [c.encode() for c in word.decode()]

    def ways(k):
        if k == len(chars):
            yield (), 0.0
        for m in range(k + 1, len(chars) + 1):
            part = b"".join(chars[k:m])
            if part in ids:
                for rest, p in ways(m):
                    yield (ids[part], *rest), p + model.logp[ids[part]]
        if k < len(chars) and chars[k] not in ids:
            own = tuple(model.byte_ids[b] for b in chars[k])
            for rest, p in ways(k + 1):
                yield (*own, *rest), p + sum(model.logp[i] for i in own)
    return list(ways(0))


def test_lattice_sums_counts_and_samples():
    model = lattice.load()
    words = [b" the", b" garden", b"x", " über".encode(), " 🎉a".encode(), b" ", b"\n"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.append(0, np.cumsum([len(w) for w in words]))
    lat = lattice.Lattice(model, data, ends)
    expected = np.zeros(len(model.logp))
    for i, word in enumerate(words):
        every = all_ways(word, model)
        total = np.logaddexp.reduce([p for _, p in every])
        assert math.isclose(lat.log_marginals()[i], total, rel_tol=1e-9)
        for way, p in every:
            np.add.at(expected, list(way), math.exp(p - total) * (i + 1))
        draws = 4000
        ids, taken = lat.sample(np.full(draws, i), np.arange(draws).astype(np.uint64) * np.uint64(7919) + np.uint64(i))
        cuts = np.split(ids, np.cumsum(taken)[:-1])
        seen = collections.Counter(tuple(c.tolist()) for c in cuts)
        for way, p in every:
            share = math.exp(p - total)
            assert abs(seen[tuple(int(x) for x in way)] / draws - share) < 5 * math.sqrt(share * (1 - share) / draws) + 1e-3
    assert np.allclose(lat.expected(np.arange(1, len(words) + 1)), expected)


def test_encoding_is_lossless_and_repeatable(spark, fixture_dir, documents):
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    coded = pieces.encode(docs)
    rows = [r.asDict() for r in coded.select("doc_id", "text", "pieces", "lossless", pieces.decoded(coded["pieces"]).alias("back")).collect()]
    assert all(r["back"] == r["text"] and (r["text"] is None or r["lossless"]) for r in rows)
    again = [r.asDict() for r in pieces.encode(docs.repartition(7)).select("doc_id", "text", "pieces").collect()]
    assert collections.Counter((r["doc_id"], r["text"], str(r["pieces"])) for r in rows) == collections.Counter((r["doc_id"], r["text"], str(r["pieces"])) for r in again)
    assert by_row(rows, "doc_id") == by_row(documents, "doc_id")


def test_base_and_lattice_scores(spark, fixture_dir, documents):
    rows = run(spark, "op5", fixture_dir)
    held = lambda d: d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0
    tokens = [[*WORD.findall(lower(d["text"] or "")), None] for d in documents]
    count = collections.Counter(w for d, t in zip(documents, tokens) if d["doc_id"] is not None and not held(d) for w in t)
    total, kinds = sum(count.values()), len(count)
    want = collections.Counter((d["doc_id"], held(d), len(t), sum(count[w] > 0 for w in t), total,
                                round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), 5)) for d, t in zip(documents, tokens))
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_scores_are_sums_of_lattices(spark, fixture_dir, monkeypatch):
    rows = run(spark, "op5", fixture_dir)
    monkeypatch.setattr(lm := __import__("pricemill.llm.lm_score", fromlist=["x"]), "FREQUENT", 3)
    monkeypatch.setattr(lm.score_texts, "__defaults__", (lattice.MODEL_FILE, 3, lm.PASSES))
    few = run(spark, "op5", fixture_dir)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["score"])
    for a, b in zip(sorted(rows, key=key), sorted(few, key=key)):
        assert a["n_known"] == b["n_known"] and math.isclose(a["score"], b["score"], rel_tol=1e-9) and math.isclose(a["base_score"], b["base_score"], rel_tol=1e-9)


def test_quality_base(spark, fixture_dir, documents):
    def base(text):
        w = WORD.findall(text or "")
        seen = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed

    rows = run(spark, "op6", fixture_dir)
    assert by_row(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == collections.Counter(
        (d["doc_id"], *base(d["text"])) for d in documents)
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    junk = {d["doc_id"] for d in documents if d["text"] and ("### " in d["text"] or " | " in d["text"])}
    assert not any(r["kept"] for r in rows if r["doc_id"] in junk)
    assert all(r["kept"] for r in rows if not r["base_failed"] and r["doc_id"] not in junk)


def estimated(votes):
    """Brute-force expectation-maximisation over single documents: posteriors, and the two rates of every rule."""
    n, k = votes.shape
    weight = max(quality.LEAST_WEIGHT, quality.PRIOR_WEIGHT * n)
    share, false, caught = quality.PRIOR_SHARE, np.full(k, quality.PRIOR_FALSE), np.full(k, quality.PRIOR_CAUGHT)

    def good():
        like_good, like_bad = np.full(n, share), np.full(n, 1 - share)
        for j in range(k):
            like_good *= np.where(votes[:, j] == -1, false[j], np.where(votes[:, j] == 1, 1 - false[j], 1.0))
            like_bad *= np.where(votes[:, j] == -1, caught[j], np.where(votes[:, j] == 1, 1 - caught[j], 1.0))
        return like_good / (like_good + like_bad)

    for _ in range(quality.ROUNDS):
        p = good()
        rate = lambda w, prior: ((w[:, None] * (votes == -1)).sum(0) + weight * prior) / ((w[:, None] * (votes != 0)).sum(0) + weight)
        new = (p.sum() + weight * quality.PRIOR_SHARE) / (n + weight), rate(p, quality.PRIOR_FALSE), rate(1 - p, quality.PRIOR_CAUGHT)
        moved = abs(new[0] - share) + abs(new[1] - false).sum() + abs(new[2] - caught).sum()
        share, false, caught = new
        if moved < quality.CLOSE:
            break
    return good(), false, caught


def test_quality_verdict_is_that_of_the_estimated_accuracies(spark, fixture_dir):
    rows = quality.judge(spark.read.parquet(f"{fixture_dir}/documents.parquet")).collect()
    p, _, _ = estimated(np.array([[r[rule] for rule in quality.RULES] for r in rows]))
    assert np.allclose(p, [r["quality"] for r in rows], atol=1e-9)
    assert [r["kept"] for r in rows] == [bool(x >= 0.5) and not r["base_failed"] for r, x in zip(rows, p)]


def test_planted_accuracies_are_recovered(spark):
    """Votes drawn from known rates: the fit finds the rates and overrules single wrong votes."""
    rnd = np.random.default_rng(11)
    rules, n = list(quality.RULES), 30000
    good = rnd.random(n) < 0.8
    false, caught = rnd.uniform(0.01, 0.12, len(rules)), rnd.uniform(0.35, 0.9, len(rules))
    bad_vote = rnd.random((n, len(rules))) < np.where(good[:, None], false, caught)
    votes = np.where(rnd.random(bad_vote.shape) < 0.2, 0, np.where(bad_vote, -1, 1))
    patterns, number = np.unique(votes, axis=0, return_counts=True)
    table = spark.createDataFrame([(*map(int, p), int(c)) for p, c in zip(patterns, number)], ", ".join(f"{r} int" for r in rules) + ", documents long")
    model = quality.fit(table)
    p, f, c = estimated(votes)
    assert np.allclose([model["rules"][r][0] for r in rules], f, atol=1e-6) and np.allclose([model["rules"][r][1] for r in rules], c, atol=1e-6)
    assert abs(f - false).max() < 0.02 and abs(c - caught).max() < 0.06 and abs(model["share"] - 0.8) < 0.02
    one = good & ((votes == -1).sum(1) == 1)
    assert (p[one] >= 0.5).mean() > 0.95 and ((p >= 0.5) == good).mean() > 0.97
    quiet = (votes == -1).sum(1) == 0
    assert p[quiet].min() < 0.99  # silence is no proof



@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twin_on_given_tables(spark, name):
    problem = check(spark, connect("/root/testdata/sf0.001"), name, queries.QUERIES[name], queries.ORACLES[name], "/root/testdata/sf0.001")
    assert problem is None or problem.startswith("near"), problem


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="test tables absent")
def test_quality_against_labels(spark):
    rows = {r["doc_id"]: r for r in run(spark, "op6", "/root/testdata/sf0.01")}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    clean = [rows[i] for i, q in labels.items() if q == 1 and not rows[i]["base_failed"]]
    bad = [rows[i] for i, q in labels.items() if q == 0]
    assert sum(r["kept"] for r in clean) >= 0.99 * len(clean) and sum(r["kept"] for r in bad) <= 0.05 * len(bad)


def test_substring_dedup(spark, fixture_dir, documents):
    where = collections.defaultdict(set)
    for d in documents:
        w = WORD.findall(d["text"] or "")
        for i in range(len(w) - 49):
            if d["doc_id"] is not None:
                where[tuple(w[i:i + 50])].add(d["doc_id"])
    want = collections.Counter()
    for d in documents:
        w = WORD.findall(d["text"] or "")
        gone = {k for i in range(len(w) - 49) if d["doc_id"] is not None and min(where[tuple(w[i:i + 50])]) < d["doc_id"] for k in range(i, i + 50)}
        want[(d["doc_id"], len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())] += 1
    assert by_row(run(spark, "op7", fixture_dir), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_cover_meets_every_difference():
    cover = substrings.COVER
    assert {(a - b) % substrings.PERIOD for a in cover for b in cover} == set(range(substrings.PERIOD))


def test_secret_base(spark, fixture_dir, documents):
    kinds = [("assign", re.compile(secret_scan.ASSIGN, re.I | re.A), 2, 6), ("access", re.compile(secret_scan.ACCESS), 0, 20), ("hex", re.compile(secret_scan.HEX), 0, 24)]
    want = collections.Counter()
    for d in documents:
        spans = sorted((m.start(), k, name, m.end()) for k, (name, p, g, n) in enumerate(kinds) for m in p.finditer(d["text"] or "") if len(m[g]) >= n)
        count = collections.Counter(s[2] for s in spans)
        want[(d["doc_id"], count["assign"], count["access"], count["hex"], hashlib.sha256(",".join(f"{s[2]}:{s[0]}:{s[3]}" for s in spans).encode()).hexdigest())] += 1
    assert by_row(run(spark, "op8", fixture_dir), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == want


@pytest.mark.parametrize("text,found", [
    ('db_pwd = "Tr0ub4dor&3xyz"', ["Tr0ub4dor&3xyz"]), ('k = "a8f3kd9z" + "Qq77xx12"\nclient_secret = k', ["a8f3kd9z", "Qq77xx12"]),
    ("x='q1w2e3r4t5'\ny=x\npassphrase: y", ["q1w2e3r4t5"]), ("export AWS_SECRET_KEY=abcDEF123456789xyz", ["abcDEF123456789xyz"]),
    ('{"private_key": "MIIEvQIBADANBg"}', ["MIIEvQIBADANBg"]), ("monkey = \"bananas1\"", []), ("The key: it was good", []), ('secret_name = "database-login"', []),
    ("a = b\nb = a\npassword_hint = a", []), ("author: John Smith", []), ('api_key = os.getenv("API_KEY_NAME")', [])])
def test_secret_literals(text, found):
    assert [text[a:b] for k, a, b, _, _ in secret_scan.find(text) if k == "literal"] == found


CHAIN = "".join(f"n{i} = n{i + 1}\n" for i in range(50)) + "n50 = 'q1w2e3r4t5'\ndb_password = n0"


@pytest.mark.parametrize("text,found", [
    (CHAIN, ["q1w2e3r4t5"]), ('k = os.getenv("X")\nk = "Qq77xx12z"\ndb_passwd2 = k\ndb_pwd = k\nk = "later99Zz"', ["Qq77xx12z"]),
    ('db_pwd = "a8f3kd9z" +\n   "Qq77xx12"\n', ["a8f3kd9z", "Qq77xx12"]), ('db_pwd = "a8f3kd9z"\n   + "Qq77xx12"\n', ["a8f3kd9z", "Qq77xx12"]),
    ('db_pwd = "a8f3" + \\\n "Qq77"', ["a8f3", "Qq77"]), ('db_pwd = "a8f3\\\nQq77"\n', ["a8f3", "Qq77"]),
    ('db_pwd = "a8f3kd9z"\n+ other = "x"', ["a8f3kd9z"]), ("db_pwd: 'a8f3kd9z' .\nThe end", ["a8f3kd9z"]), ("db_pwd = db_pwd", []),
    ("db_pwd = k\nk = 'a8f3kd9z'", ["a8f3kd9z"]), ("k = 'a8f3kd9z'\nk = k + 'B'\ndb_pwd = k", ["a8f3kd9z", "B"])])
def test_secret_constants(text, found):
    assert [text[a:b] for k, a, b, _, _ in secret_scan.find(text) if k == "literal"] == found


def test_secret_constants_that_double():
    text = "".join(f"n{i} = n{i + 1} + n{i + 1}\n" for i in range(300)) + "n300 = 'q1w2e3r4t5'\ndb_pwd = n0"
    assert [text[a:b] for k, a, b, _, _ in secret_scan.find(text) if k == "literal"] == ["q1w2e3r4t5"]
    text = "db_pwd = 'a8f3kd9z'\n" + "db_pwd = db_pwd + 'x'\n" * 5000
    assert len(secret_scan.find(text)) == 5001


def test_secrets_are_masked(spark):
    df = spark.createDataFrame([('password: hunter22 and token = "0123456789abcdef0123456789"',), (None,), ("plain",)], "text string")
    assert [r[0] for r in df.select(secret_scan.redacted(df["text"])).collect()] == ['password: [secret] and token = "[secret]"', None, "plain"]


def test_language_scores_are_exact_code_lengths(spark, fixture_dir, documents):
    """The table against the recursion it stands for, byte by byte."""
    texts = [d["text"] for d in documents if d["text"] and d["lang"] == "de"][:6]
    counts = collections.Counter()
    for t in texts:
        b = language.START + t.encode()
        counts.update(int.from_bytes(b[i - 3:i + 1], "big") for i in range(3, len(b)))
    trees = language.ContextTrees([("de", k, n) for k, n in counts.items()], ["de"])
    level = [collections.defaultdict(collections.Counter) for _ in range(4)]
    for k, n in counts.items():
        b = k.to_bytes(4, "big")
        for length in range(4):
            level[length][b[3 - length:3]][b[3]] += n

    def shares(context):
        lower_ = [1 / 256] * 256 if not context else None
        seen = level[len(context)].get(context)
        lower_ = lower_ or shares(context[1:])
        if not seen:
            return lower_
        n, kinds = sum(seen.values()), len(seen)
        left = sum(p for s, p in enumerate(lower_) if s not in seen)
        return [seen[s] / (n + kinds) if s in seen else kinds / (n + kinds) * p / left for s, p in enumerate(lower_)]

    for t in [*texts[:2], "völlig neu ☃ xyz"]:
        b = language.START + t.encode()
        want = -sum(math.log2(shares(b[i - 3:i])[b[i]]) for i in range(3, len(b)))
        data, offsets = next((d, o) for _, _, d, o in rounds(__import__("pyarrow").array([t])))
        assert math.isclose(trees.lengths(data, offsets)[0, 0], want, rel_tol=1e-5)
    assert math.isclose(sum(shares(b"\n\n\n")), 1)


def test_language_of_held_out_texts(spark, fixture_dir, documents):
    rows = run(spark, "op9", fixture_dir)
    lang = {(d["doc_id"]): d for d in documents}
    known = [(r["lang_pred"], lang[r["doc_id"]]) for r in rows if r["doc_id"] is not None]
    sure = [(p, d["lang"]) for p, d in known if d["text"] and len(WORD.findall(d["text"])) > 25 and d["lang"]]
    assert sum(p == want for p, want in sure) >= 0.97 * len(sure)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in (lang[r["doc_id"]]["text"] or ""))) for r in rows if r["doc_id"] not in (None, lang and documents[7]["doc_id"]))
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(df, language.learn(df)).collect()[0]["lang_pred"] == "und"


def test_every_labelled_language_is_learned(spark):
    """More than 64 of them, each in letters of its own; the last by bytes in an own script too."""
    words = lambda k: " ".join(chr(0x4E00 + 40 * k + (7 * i * i + j) % 40) for i in range(12) for j in range(3))
    df = spark.createDataFrame([(k, words(k) * (1 + (k < 64)), f"l{k:02}") for k in range(70)], "doc_id long, text string, lang string")
    for share in ({}, {"total_bytes": 70 * 60}):
        trees = language.learn(df, **share)
        assert trees.languages == [f"l{k:02}" for k in range(70)]
    got = {r["lang"]: r["lang_pred"] for r in language.identify(df, language.learn(df)).collect()}
    assert got == {k: k for k in got} and len(got) == 70


def test_long_texts_and_copies_are_learned(spark):
    """Few long documents, or copies of one row, of which whole rows were rarely drawn; a language of empty texts isn't learned."""
    long = [(k, f"{w} " * 3000, w) for w in ("aqua", "bosque", "cedar") for k in range(3)]
    copies = [(9, "dune " * 100, "dune")] * 60
    df = spark.createDataFrame([*long, *copies, (10, "", "empty")], "doc_id long, text string, lang string")
    trees = language.learn(df, sample_bytes=1500)
    assert trees.languages == ["aqua", "bosque", "cedar", "dune"]
    for name in trees.languages:
        data, offsets = next((d, o) for _, _, d, o in rounds(__import__("pyarrow").array([f"{name} " * 20])))
        bits = trees.lengths(data, offsets)[0]
        assert trees.languages[bits.argmin()] == name and bits.min() < 2 * len(data)


def jump_by_the_book(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 24, 25, 1000])
def test_jump_hash(spark, shards):
    keys = [0, 1, 2, -1, 10863919174838991, 2016238256797177309, -(1 << 63), (1 << 63) - 1, *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(df, shards).collect()}
    assert got == {k: (jump_by_the_book(k, shards), jump_by_the_book(k, shards + 1)) for k in keys}


def test_shards_hold_every_slot_once(spark, fixture_dir, documents):
    rows = run(spark, "op10", fixture_dir)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert by_row(rows, "doc_id", "size", "text_crc32") == collections.Counter(
        (d["doc_id"], len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in documents)
