"""Operators on documents against brute force, with odd rows."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm.chunk_dedup import LEAST_SPAN, cut, drop_repeats, repeated_spans
from caseflow.llm.licenses import PHRASES, TEMPLATES, license_report
from caseflow.llm.line_quality import WIDTH, Field, chains, features, fit_field, held_out, score_documents
from caseflow.llm.mixing import REST, WEIGHTS, in_mixed_order, mix_sources, op1_mix_sources, op1_sql, period, phases
from caseflow.llm.shingle_links import shingle_components

SF = "/root/testdata/sf0.01"
WORDS = [a + b for a, b in itertools.product(["al", "be", "co", "du", "en", "fi", "go", "hu", "im", "jo", "ka", "lo"], ["ra", "ne", "ti", "mo", "su", "la", "de", "vi"])]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


# Mixing


def brute_mix(blocks, weights):
    """The source of each slot, all phases simulated slot by slot."""
    out, taken = [], dict.fromkeys(weights, 0)
    while live := [s for s in weights if taken[s] < blocks.get(s, 0)]:
        base, start, total = dict(taken), len(out), sum(weights[s] for s in live)
        while all(taken[s] < blocks[s] for s in live):
            t = len(out) - start
            ready = [(-(-(taken[s] - base[s] + 1) * total // weights[s]), i, s) for i, s in enumerate(weights) if s in live and (taken[s] - base[s]) * total // weights[s] <= t]
            s = min(ready)[2]
            taken[s] += 1
            out.append(s)
    return out


def test_deviation_stays_below_one_block():
    weights = {"a": 7, "b": 3, "c": 1, "d": 2}
    slots, total = period(weights), 13
    for s, n in weights.items():
        assert slots.count(s) == n
        assert all(abs(slots[:t].count(s) - t * n / total) < 1 for t in range(total + 1))


@pytest.mark.parametrize("seed", range(6))
def test_mixing(spark, seed):
    rng = random.Random(seed)
    weights = {"a": rng.randint(1, 9), "b": rng.randint(1, 9), "c": rng.randint(1, 9)}
    sizes = {"a": rng.randint(0, 90), "b": rng.randint(0, 40), "c": rng.randint(1, 200), "zz": rng.randint(0, 30), None: rng.randint(0, 5)}
    rows = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame([(i, s, "x") for i, s in rows], "doc_id long, source string, mix_slot string")
    got = mix_sources(docs, weights, 2, 4).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(len(rows)))
    groups = {}
    for r in got:
        groups.setdefault(r["mix_group"], []).append(r)
    blocks = {g: -(-len(x) // 4) for g, x in groups.items()}
    slots = brute_mix(blocks, weights | {REST: 2})
    assert [r["mix_slot"] for r in got] == [t for t, s in enumerate(slots) for _ in range(min(4, len(groups[s]) - 4 * slots[:t].count(s)))]
    assert all(slots[r["mix_slot"]] == r["mix_group"] for r in got)


def test_every_given_source_stays_within_a_block_of_its_share(spark):
    got = op1_mix_sources(spark, "/root/testdata/sf0.1").orderBy("mix_position").collect()
    assert all(r["mix_group"] == r["source"] for r in got)
    sizes = Counter(r["source"] for r in got)
    slots = [got[i]["source"] for i in range(len(got)) if not i or got[i]["mix_slot"] != got[i - 1]["mix_slot"]]
    total = sum(WEIGHTS[s] for s in sizes)
    ends = min(max(t for t, x in enumerate(slots) if x == s) for s in sizes)  # all sources are live up to here
    assert ends > total
    for s in sizes:
        assert all(abs(slots[:t].count(s) - t * WEIGHTS[s] / total) < 1 for t in range(ends + 2)), s


def test_mixing_agrees_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.execute(op1_sql()).fetchall()
    assert sorted(map(tuple, op1_mix_sources(spark, SF).collect())) == sorted(want)


def test_mixing_odd_rows(spark):
    rows = [(1, "src0"), (1, "src0"), (None, "src0"), (None, None), (2, "src1")]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    mixed = mix_sources(docs)
    assert sorted(r["mix_position"] for r in mixed.collect()) == [0, 1, 2, 3, 4]
    assert mix_sources(docs.limit(0)).count() == 0
    assert in_mixed_order(mixed, 5).count() == 5
    with pytest.raises(ValueError):
        mix_sources(docs, {"a": 0})
    assert phases({}, {"a": 1}) == []


# Licenses


def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, label) for phrase, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in places)
    return len(words), len(places), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places}))


LICENSED = [
    "Released under the MIT License.", "the mit license mit license MIT\nLICENSE", "General Public License general public general public license", "apache\tlicense", "mİt license", "mit lİcense", "MİT LICENSE", "LIKCENSE mit licenſe",
    "", None, "mit", "general public", "mitlicense", "mit-license", "é mit license ß", "mit 9 license", " mit license", "GENERAL  PUBLIC\x00LICENSE", "mit license" * 3, "Licensed under CC BY-NC 4.0.", "x " * 500 + "apache license " * 40,
]


def test_licenses(spark):
    rng = random.Random(5)
    vocabulary = ["mit", "license", "general", "public", "apache", "MIT", "License", "x", "é"]
    many = LICENSED + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(300)] + LICENSED[:2]
    docs = spark.createDataFrame([(i, t, "y") for i, t in enumerate(many)], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in license_report(docs).collect()}
    assert len(got) == len(many)
    for i, t in enumerate(many):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_licenses(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[19]["labels"] == "cc-by-nc" and got[19]["n_base"] == 0


def test_templates_are_found_with_gaps_and_clean_texts_are_not(spark):
    rng = random.Random(6)
    words = TEMPLATES["bsd"][0].split()
    gapped = " ".join(words[:8] + ["really"] + words[8:])
    docs = spark.createDataFrame([(1, prose(rng, 50) + " " + gapped + " " + prose(rng, 50)), (2, prose(rng, 300)), (3, " ".join(words[:6])), (None, gapped)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in license_report(docs).collect()}
    assert got[1]["labels"] == got[None]["labels"] == "bsd" and got[1]["score"] >= 0.7 and (got[2]["labels"], got[2]["score"]) == ("", 0.0) and got[3]["labels"] == ""
    assert license_report(docs.limit(0)).count() == 0


# N-gram Jaccard join


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        for x, y in itertools.product(sets[a], sets[b]):
            if x and y and den * len(x & y) >= num * len(x | y):
                a0, b0 = find(a), find(b)
                parent[max(a0, b0)] = min(a0, b0)
    return {i: find(i) for i in sets}


def near_copies(rng):
    out = []
    for size in (1, 3, 4, 5, 8, 12, 20, 30, 60, 120, 300):
        base = prose(rng, size).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, max(1, size // 12))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(WORDS)], [w[k], rng.choice(WORDS)]])
                w = w or ["x"]
            out.append(" ".join(w) if rng.random() < 0.8 else " ".join(w).upper().replace(" ", "\t"))
    passage = prose(rng, 60)
    out += [passage + " " + prose(rng, rng.randint(5, 40)) for _ in range(40)]
    chain = prose(rng, 100).split()
    for k in range(30):  # neighbours are linked, the ends are not
        chain[3 * k % 100] = f"n{k}"
        out.append(" ".join(chain))
    return [*out, "", None, "  \n", "a", "a", "A"]


@pytest.mark.parametrize(("n", "num", "seed"), [(4, 85, 1), (5, 80, 2), (1, 50, 3)])
def test_components(spark, n, num, seed):
    rng = random.Random(seed)
    texts = list(enumerate(near_copies(rng)))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, 0) for i, t in texts], "doc_id long, text string, component_id int")
    got = {r["doc_id"]: r["component_id"] for r in shingle_components(docs, n, num, 100).collect()}
    assert got == brute_components(texts, n, num, 100)


def test_components_odd_rows(spark):
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, "x"), (9, "y"), (4, "y"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in shingle_components(docs, 4, 85, 100).collect())
    assert got == [(-1, 3, -1), (3, 3, 3), (4, 1, 4), (5, 0, 5), (7, 3, 3), (7, 3, 3), (9, 1, 4), (9, 1, 4)]
    assert shingle_components(docs.limit(0), 4, 85, 100).count() == 0


# Substring dedup


def test_repeats_across_documents_are_found_and_clean_ones_left_alone(spark):
    rng = random.Random(8)
    passages = [prose(rng, 55) for _ in range(20)]
    rows, planted = [], {}
    for i in range(200):
        text = prose(rng, 80)
        if i % 4 == 0:
            p = i // 4 % 20
            text = text + " " + passages[p] + " " + prose(rng, 40)
            planted.setdefault(p, []).append(i)
        rows.append((i, text))
    rows += [(900, None), (901, ""), (None, passages[0]), (902, "é" * 400), (903, "ß" + "é" * 400), (10, rows[10][1])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string")
    spans = repeated_spans(docs).collect()
    later = {i for ids in planted.values() for i in sorted(ids)[1:]}
    assert later <= {s["doc_id"] for s in spans} <= later | {902, 903}
    for s in spans:
        assert s["stop"] - s["start"] >= LEAST_SPAN and s["earlier_doc_id"] <= s["doc_id"]
    kept = {r["doc_id"]: r for r in drop_repeats(docs.withColumn("n_chars", F.lit(0))).collect() if r["doc_id"] is not None}
    for i, t in rows:
        if i is not None and i not in later and i < 900:
            assert kept[i]["text"] == t
        elif i in later:
            assert len(kept[i]["text"]) < len(t) - 150 and kept[i]["n_chars"] == len(kept[i]["text"])
    assert drop_repeats(docs).count() == len(rows) and repeated_spans(docs.limit(0)).count() == 0 and drop_repeats(docs.limit(0)).count() == 0


def test_repeats_are_covered_to_their_last_byte(spark):
    rng = random.Random(9)
    rows, places = [], {}
    for i in range(60):  # a passage stands in three documents, between bytes that differ
        passage = prose(random.Random(100 + i % 20), 40 + i % 20)
        head = prose(rng, rng.randint(0, 30)) + f"<{i}>"
        rows.append((i, head + passage + f"[{i}]" + prose(rng, rng.randint(0, 30))))
        places[i] = (len(head) + 1, len(head) + len(passage) + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, found = {}, repeated_spans(docs).collect()
    assert sorted(found) == sorted(repeated_spans(docs.coalesce(1)).collect())
    for s in found:
        got.setdefault(s["doc_id"], []).append((s["start"], s["stop"]))
        assert rows[s["doc_id"]][1][s["start"] : s["stop"]] in rows[s["earlier_doc_id"]][1]
    assert sorted(got) == list(range(20, 60))
    for i, spans in got.items():
        (start, stop), text = spans[0], rows[i][1]
        low, high = places[i][0] - 1, places[i][1] - 1
        # the closing and opening marks around a passage may be alike, too
        assert len(spans) == 1 and start <= low and high <= stop and stop - start <= high - low + 4, (text[start:stop], text[low:high])
    kept = {r["doc_id"]: r["text"] for r in drop_repeats(docs, chars_col=None).collect()}
    assert all(len(kept[i]) == len(t) - sum(b - a for a, b in got.get(i, [])) for i, t in rows)


def test_cuts_respect_characters():
    text = ("é" * 10).encode()
    assert cut(text, [(3, 9)]).decode() == "é" * 8 and cut(text, []) == text and cut(text, [(0, 20)]) == b""


# Line quality


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = fit_field(docs, labels)
    scored = score_documents(docs, field).where(held_out()).join(labels, "doc_id").collect()
    right = sum(r["quality_good"] == (r["quality"] == 1) for r in scored)
    assert len(scored) > 50 and right / len(scored) >= 0.95
    odd = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (3, " \n \n", 0.3), (None, "The end.", 0.4), (4, "a\n" * 5000, 0.5)], "doc_id long, text string, quality_score double")
    got = score_documents(odd, field).collect()
    assert len(got) == 5 and all(0 <= r["quality_score"] <= 1 for r in got) and [r["quality_score"] for r in got if r["doc_id"] in (1, 2, 3)] == [0.0, 0.0, 0.0]
    assert score_documents(odd.limit(0), field).count() == 0


def test_quality_without_labels(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(3), spark.read.parquet(f"{SF}/labels.parquet").limit(0)
    got = score_documents(docs, fit_field(docs, labels)).collect()
    assert all(r["quality_score"] == pytest.approx(0.5) for r in got)


def test_chains_agree_with_all_label_sequences():
    rng = np.random.default_rng(3)
    lengths, importance, pair = np.array([1, 5, 3, 4]), np.array([0.5, 2.0, 1.0, 0.1]), rng.normal(size=(2, 2))
    unary = rng.normal(size=(13, 2))
    marginal, expected, total = chains(unary, pair, lengths, importance)
    at, want_total, want_pairs = 0, 0.0, np.zeros((2, 2))
    for n, weight in zip(lengths.tolist(), importance, strict=True):
        labels = list(itertools.product((0, 1), repeat=n))
        score = np.exp([sum(unary[at + i, y] for i, y in enumerate(ys)) + sum(pair[a, b] for a, b in itertools.pairwise(ys)) for ys in labels])
        want_total += weight * np.log(score.sum())
        for i in range(n):
            assert marginal[at + i, 1] == pytest.approx(sum(p for p, ys in zip(score, labels, strict=True) if ys[i]) / score.sum())
        for p, ys in zip(score / score.sum(), labels, strict=True):
            for a, b in itertools.pairwise(ys):
                want_pairs[a, b] += weight * p
        at += n
    assert total == pytest.approx(want_total) and expected == pytest.approx(want_pairs)


def test_fit_follows_the_gradient_of_the_weighted_likelihood():
    rng = np.random.default_rng(4)
    lengths, importance = np.full(60, 10), rng.uniform(0.1, 1, 60)
    x, y = rng.normal(size=(600, 3 * WIDTH)), rng.integers(0, 2, 600)
    y[1::2] = y[::2]  # neighbours are alike
    field = Field()
    field.fit(x, y, lengths, importance)

    def likelihood(theta):
        score = x @ theta[:-4]
        unary, pair = np.stack((-score / 2, score / 2), 1), theta[-4:].reshape(2, 2)
        inner = [i for i in range(600) if i % 10]
        weight = np.repeat(importance, lengths)
        return (weight @ unary[np.arange(600), y] + sum(weight[i] * pair[y[i - 1], y[i]] for i in inner) - chains(unary, pair, lengths, importance)[2]) / weight.sum() - 0.5e-4 * theta @ theta

    best = np.concatenate((field.weights, field.pair.ravel()))
    top = likelihood(best)
    assert top > likelihood(0.5 * best) > likelihood(0 * best) and best[-4] > 0.1
    for k in range(len(best)):  # no single step leads higher
        step = np.eye(len(best))[k] * 0.03
        assert top + 1e-6 > max(likelihood(best + step), likelihood(best - step)), k


def test_features_are_bounded():
    for text in (b"A!!! B!!!", b"x | y | z", "é à ü".encode(), b"1 2 3", b"\x00", b"$" * 1000):
        x, size = features(text)
        assert len(x) == len(size) == 1 and (x >= 0).all() and (x <= 3).all()


@pytest.mark.parametrize("block", [3, 20])
def test_components_of_large_clusters(spark, monkeypatch, block):
    monkeypatch.setattr("caseflow.llm.shingle_links.BLOCK", block)
    rng = random.Random(11)
    texts = list(enumerate(near_copies(rng)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in shingle_components(docs, 4, 85, 100).collect()}
    assert got == brute_components(texts, 4, 85, 100)


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_components_of_long_texts_and_frequent_passages(spark, monkeypatch, n, num):
    """Sets of 2,000 to 20,000 shingles, and a passage that a third of the texts share, sent in many small blobs."""
    monkeypatch.setattr("caseflow.llm.shingle_links.FLUSH", 3000)
    rng = random.Random(13)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=60))
    texts = []
    for i in range(90):
        text = " ".join(rng.choices(words, k=rng.choice([20, 60, 120])))
        texts.append(text + " " + passage if i % 3 == 0 else text)
    for size in (2000, 5000, 20000):
        base = rng.choices(words, k=size)
        for changed in (0.01, 0.02, 0.03, 0.05):
            copy = list(base)
            for at in rng.sample(range(size), int(size * changed)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy) + " " + passage)
        texts.append(" ".join(base[: int(size * 0.86)]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in shingle_components(docs, n, num, 100).collect()}
    assert got == brute_components(rows, n, num, 100)


def test_components_with_clashing_columns(spark):
    rows = [(2, "a b c d e", 1, 1, "x"), (1, "a b c d e", 2, 2, "y"), (3, None, 3, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id long, cls long, key string")
    assert sorted(map(tuple, shingle_components(docs).collect())) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
