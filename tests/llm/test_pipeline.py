"""The pipeline's stages on a small corpus, and what they decide."""

import hashlib
import itertools
import math
import random
import struct

import corpus_pipeline
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer
import public_tokenizers

from caseflow.llm.chunk_dedup import GEAR
from caseflow.llm.line_quality import fit_field
from caseflow.llm.mixing import REST, REST_WEIGHT, WEIGHTS
from tests.llm.test_documents import brute_components, brute_mix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_and_rows(steps):
    names = [n for n, _, _ in steps]
    assert names == ["quality", "near_duplicates", "repeats", "mix", "tokens"]
    for name, before, after in steps[:-1]:
        assert after.columns == before.columns
        assert after.select("doc_id").distinct().count() == after.count()
        if name in ("repeats", "mix"):
            assert after.count() == before.count()
        else:
            assert 0 < after.count() < before.count()


def test_tokens_are_those_of_the_texts(steps):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] for r in steps[3][2].collect()}
    got = steps[4][2].collect()
    assert len(got) == len(texts)
    for r in got[:40]:
        assert r["n_tokens"] == len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)


def test_odd_rows(spark, steps):
    docs = steps[0][1]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "src0", 0), (1, None, "en", "src0", 0), (2, "", None, None, 0), (None, "The small text of no document at all.", "en", "src1", 10)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: tuple(str(x) for x in r)
    assert stages["quality"](spark, odd, SF).collect() == []  # without lines, or of poor ones
    once = sorted({tuple(r) for r in odd.collect()}, key=key)
    assert sorted(map(tuple, stages["near_duplicates"](spark, odd, SF).collect()), key=key) == once
    for name in ("repeats", "mix"):
        assert sorted(map(tuple, stages[name](spark, odd, SF).collect()), key=key) == sorted(map(tuple, odd.collect()), key=key)
    assert sorted((str(r["doc_id"]), r["n_tokens"] > 0) for r in stages["tokens"](spark, odd, SF).collect()) == [("1", False), ("1", False), ("2", False), ("None", False), ("None", True)]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_clashing_columns_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    names = ["quality_score", "quality_good", "component_id", "__id", "__spans", "__place", "mix_group", "mix_position", "__rank", "start", "cls", "key"]
    clashing = docs.select("*", *((docs["doc_id"] * 3).cast("string").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, rich = stage(spark, docs, SF), stage(spark, clashing, SF)
        assert rich.columns == clashing.columns, name
        assert sorted(map(str, rich.select(docs.columns).collect())) == sorted(map(str, plain.collect())), name
        assert all(r[n] == str(3 * r["doc_id"]) for r in rich.collect() for n in names), name


def test_long_texts_pass_every_stage(spark, steps):
    """Texts of 2 MB: one with a passage of another, one of a single word, one of lines."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(20_000)]
    long = " ".join(rng.choices(words, k=300_000))
    rows = [(1, long), (2, "Quite another beginning of it. " + long[500_000:700_000]), (3, "x" * 2_000_000), (4, "\n".join(long[i : i + 800] for i in range(0, 500_000, 800))), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], steps[0][1].schema)
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, SF).count() <= 5
    assert sorted(r["doc_id"] for r in stages["near_duplicates"](spark, docs, SF).collect()) == [1, 2, 3, 4, 5]
    left = {r["doc_id"]: r["text"] for r in stages["repeats"](spark, docs, SF).collect()}
    assert left[1] == long and len(left[2]) < 100 and len(left[3]) < 200 and len(left[4]) < 60_000 and left[5] is None
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["n_tokens"] for r in stages["tokens"](spark, docs, SF).collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in rows}


def test_periodic_runs_are_cut_out_as_by_brute_force(spark, steps):
    """Runs of a short period hold few boundaries, or none."""
    texts = {}
    for i, unit in enumerate(["spam ", "a", "-=", "ham and eggs, ", "\u00e9\u00df"]):
        texts[2 * i] = f"Here begins document {i} of a certain kind. " + unit * 400 + f"So it ends {i * 7}."
        texts[2 * i + 1] = f"{i * i + 3} quite other words stand before this. " + unit * (300 + i) + "And others stand behind."
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts.items()], steps[0][1].schema)
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeats(spark, docs, SF).collect()}
    assert got == brute_repeats(texts) and all(len(got[i]) < 200 for i in got if i % 2)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


# The same by brute force: plain Python over all rows, with the fitted field's numbers and the table of the gear hash


def line_numbers(line, lines):
    n, words = len(line), line.split()
    kind = [1 if b >= 128 or chr(b).islower() else 2 if chr(b).isupper() else 3 if chr(b).isdigit() else 4 if b in b" \t\v\f\r" else 5 if 0x21 <= b <= 0x7E else 0 for b in line]
    same = [i > 0 and line[i] == line[i - 1] and kind[i] == 5 for i in range(n)]
    share = lambda flags: sum(flags) / n
    letters = max(share(k in (1, 2) for k in kind), 1e-6)
    return [
        1, math.log1p(n) / 8, min(share(k == 2 for k in kind) / letters, 1), share(k == 3 for k in kind), min(4 * share(k == 5 for k in kind), 2), share(k == 4 for k in kind),
        min(8 * share(i > 1 and same[i] and same[i - 1] for i in range(n)), 2), min(8 * share(same[i] and line[i] == 0x21 for i in range(n)), 2), min(16 * share(b == 0x7C for b in line), 2),
        len(set(words)) / len(words), sum(a == b for a, b in itertools.pairwise(words)) / len(words), min((n - len(words)) / len(words) / 10, 2), float(lines.count(line) > 1 and len(words) > 3),
        min(2 * sum(w[-1:] in (b".", b",", b";", b":") for w in words) / len(words), 2),
    ]


def brute_quality(text, field):
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    if not lines:
        return 0.0
    own = [line_numbers(x, lines) for x in lines]
    none, weights, pair = [0] * len(own[0]), field.weights.tolist(), field.pair.tolist()
    scores = [sum(a * b for a, b in zip(weights, x + before + after, strict=True)) for x, before, after in zip(own, [none, *own[:-1]], [*own[1:], none], strict=True)]
    unary = [(-s / 2, s / 2) for s in scores]
    both = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    forward, backward = [unary[0]], [(0.0, 0.0)]
    for u in unary[1:]:
        forward.append(tuple(u[y] + both(forward[-1][0] + pair[0][y], forward[-1][1] + pair[1][y]) for y in (0, 1)))
    for u in unary[:0:-1]:
        backward.append(tuple(both(pair[y][0] + u[0] + backward[-1][0], pair[y][1] + u[1] + backward[-1][1]) for y in (0, 1)))
    sums = [(f[0] + b[0], f[1] + b[1]) for f, b in zip(forward, backward[::-1], strict=True)]
    mean = sum(len(x) * math.exp(s[1] - both(*s)) for x, s in zip(lines, sums, strict=True)) / sum(map(len, lines))
    mean = min(max(mean, 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(field.curve[0] * math.log(mean / (1 - mean)) + field.curve[1])))


def brute_repeats(texts):
    """Texts by id without the stretches that stand before: unbounded growth of all touching repeated chunk pairs."""
    raw, seen, out = {i: (t or "").encode() for i, t in texts.items()}, {}, {}
    for doc in sorted(raw):
        b = raw[doc]
        if len(b) < 100:
            out[doc] = texts[doc]
            continue
        gear = [sum(int(GEAR[b[i - j]]) << j for j in range(min(16, i + 1))) % 65536 for i in range(len(b))]
        near = [i + 1 for i in range(len(b) - 1) if gear[i] < 65536 // 20]
        cuts = [0, *(c for c, before in zip(near, [-12, *near], strict=False) if c - before >= 12), len(b)]
        for start, stop in list(itertools.pairwise(cuts)):
            if stop - start > 160:  # cut again behind the last of the least hashes of each 32 bytes
                last = start
                for at in sorted({min(range(i, i + 32), key=lambda k: (gear[k], -k)) + 1 for i in range(start, stop - 31)}):
                    if at - last >= 12 and stop - at >= 12:
                        cuts.append(at)
                        last = at
        cuts.sort()
        cores = []
        for k in range(max(1, len(cuts) - 2)):
            start, stop = cuts[k], cuts[min(k + 2, len(cuts) - 1)]
            other = seen.get(b[start:stop])
            seen.setdefault(b[start:stop], (doc, start))
            if other and cores and start <= cores[-1][1]:
                cores[-1][1], cores[-1][3] = stop, (other[0], other[1] + stop - start)
            elif other:
                cores.append([start, stop, other, (other[0], other[1] + stop - start)])
        gone = bytearray(len(b))
        for start, stop, (head, h), (tail, t) in cores:
            while start and h and b[start - 1] == raw[head][h - 1]:
                start, h = start - 1, h - 1
            while stop < len(b) and t < len(raw[tail]) and b[stop] == raw[tail][t]:
                stop, t = stop + 1, t + 1
            if stop - start >= 100:
                gone[start:stop] = b"\1" * (stop - start)
        at = 0
        while (at := gone.find(1, at)) >= 0:  # whole characters only
            end = gone.find(0, at) if 0 in gone[at:] else len(b)
            while at < end and b[at] & 0xC0 == 0x80:
                gone[at], at = 0, at + 1
            last = end
            while last > at and last < len(b) and b[last] & 0xC0 == 0x80:
                last -= 1
                gone[last] = 0
            at = end
        out[doc] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode()
    return out


def brute_order(sources):
    """Ids in mixed order."""
    groups, order = {}, []
    for i in sorted(sources, key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
        groups.setdefault(sources[i] if sources[i] in WEIGHTS else REST, []).append(i)
    for s in brute_mix({g: -(-len(x) // 8) for g, x in groups.items()}, WEIGHTS | {REST: REST_WEIGHT}):
        order += groups[s][:8]
        del groups[s][:8]
    return order


@pytest.fixture(scope="module")
def wanted(spark):
    """What each stage should give, each made from the brute force of the one before."""
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    field = fit_field(raw, spark.read.parquet(f"{SF}/labels.parquet"))
    docs = {r["doc_id"]: r for r in raw.collect()}
    scores = {i: brute_quality(r["text"], field) for i, r in docs.items()}
    assert all(abs(x - 0.7) > 1e-4 for x in scores.values())  # the operator rounds the lines' numbers to 32 bits
    good = [i for i in docs if scores[i] >= 0.7]
    groups = brute_components([(i, docs[i]["text"]) for i in good], 5, 80, 100)
    single = [i for i in good if groups[i] == i]
    texts = brute_repeats({i: docs[i]["text"] for i in single})
    return docs, good, single, texts, brute_order({i: docs[i]["source"] for i in single})


def test_kept_documents_are_those_of_brute_force(steps, wanted):
    docs, good, single, _, _ = wanted
    for (_, _, after), ids in zip(steps, (good, single), strict=False):
        assert sorted(map(tuple, after.collect())) == sorted(tuple(docs[i]) for i in ids)
    assert len(single) < len(good) < len(docs)


def test_texts_without_repeats_are_those_of_brute_force(steps, wanted):
    docs, _, single, texts, _ = wanted
    changed = [i for i in single if texts[i] != docs[i]["text"]]
    got = {r["doc_id"]: r for r in steps[2][2].collect()}
    assert {i: r["text"] for i, r in got.items()} == texts and changed
    for i, r in got.items():
        assert (r["lang"], r["source"], r["n_chars"]) == (docs[i]["lang"], docs[i]["source"], len(texts[i]) if i in changed else docs[i]["n_chars"])


def test_order_is_that_of_brute_force(steps, wanted):
    files = sorted(steps[3][2].inputFiles(), key=lambda f: f.rpartition("/")[2])
    rows = [r for f in files for r in pq.read_table(f.removeprefix("file://")).to_pylist()]
    assert [r["doc_id"] for r in rows] == wanted[4]
    assert {r["doc_id"]: r["text"] for r in rows} == wanted[3]


def test_run_gives_the_tokens_of_brute_force(spark, wanted):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in wanted[3].items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), packed))
    got = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids").collect()
    assert sorted((*r[:4], bytes(r[4])) for r in got) == sorted(want)
