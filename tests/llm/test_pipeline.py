"""The pipeline against plain versions of its stages, which share no code with them, and on odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def pipeline():
    return pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def steps(spark, pipeline):
    """Rows before the first stage and after each."""
    held = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for _, stage in pipeline.STAGES:
        held.append(pipeline.table(stage(spark, held[-1], DATA), "test-stage"))
    return held


def rows(df):
    return [r.asDict() for r in df.collect()]


def good(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    letters = sum(map(len, words))
    return not (
        len(words) < 50 or 2 * len(covered) > len(words) or 10 * len(re.findall("[#*$%&|<>]", text)) > len(words) or not 2 * len(words) <= letters <= 15 * len(words)
        or 2 * (len(lines) - len(set(lines))) > len(lines) or 100 * len(re.findall("[A-Z]", text)) > 60 * len(re.findall("[A-Za-z]", text)) or 100 * len(re.findall("[0-9]", text)) > 40 * letters
        or 10 * len(re.findall("(?:\\.\\.\\.|…)\n", text)) > 3 * len(lines) or "lorem ipsum" in text.lower()
    )


def test_columns(steps):
    assert [s.columns for s in steps[1:-1]] == [steps[0].columns] * 4


def test_quality_rules(steps):
    assert {r["doc_id"] for r in rows(steps[1])} == {r["doc_id"] for r in rows(steps[0]) if good(r["text"] or "")}


def test_near_dedup(steps):
    texts = {r["doc_id"]: [w.lower() for w in WORD.findall(r["text"])] for r in rows(steps[1])}
    sets, label = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in texts.items()}, {k: k for k in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert links and {r["doc_id"] for r in rows(steps[2])} == set(label.values())


def test_decontamination(spark, steps):
    plain = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = [plain(r["text"]) for r in rows(spark.read.parquet(f"{DATA}/benchmark.parquet"))]
    before, after = {r["doc_id"]: plain(r["text"]) for r in rows(steps[2])}, {r["doc_id"] for r in rows(steps[3])}
    for k, words in before.items():
        inside = any(f" {' '.join(i)} " in f" {' '.join(words)} " for i in items)
        shared = max(len(set(i) & set(words)) / len(set(i)) for i in items)
        assert not (inside and k in after) and (k in after or shared >= 0.6)  # copies go; what shares little with each item stays
    assert after < set(before)


def test_mixing(steps):
    size = lambda r: len(WORD.findall(r["text"] or ""))
    before, after = rows(steps[3]), rows(steps[4])
    have, took, times = Counter(), Counter(), defaultdict(int)
    for r in before:
        have[r["source"]] += size(r)
    for r in after:
        took[r["source"]] += size(r)
        times[r["doc_id"]] += size(r)
    names = sorted(have, key=lambda x: (x is None, x or ""))
    weight, level = {n: 1 + k % 3 for k, n in enumerate(names)}, 0.0
    for _ in range(60):  # the level at which the shares, stopped at 3 times a source, make up the whole
        step = next(s for s in (10.0**e for e in range(6, -7, -1)) if sum(min((level + s) * weight[n], 3 * have[n]) for n in names) <= sum(have.values()) or s < 1e-5)
        level += step
    whole = {r["doc_id"]: size(r) for r in before}
    assert all(times[k] <= 3 * whole[k] for k in times)
    for n in names:
        assert abs(took[n] - min(level * weight[n], 3 * have[n])) <= 64 + len(names)


def test_token_files(steps):
    import public_tokenizers
    from tokenizers import Tokenizer

    model, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in rows(steps[4]):
        ids = np.array([*model.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        expected[r["doc_id"], len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(rows(steps[5]), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == expected
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in got) and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()


def test_run(spark, pipeline, steps):
    key = lambda df: sorted(map(repr, rows(df)))
    assert key(pipeline.run(spark, DATA)) == key(steps[5])


def test_empty(spark, pipeline):
    held = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        held = pipeline.table(stage(spark, held, DATA), "test-stage")
    assert held.count() == 0


def test_odd_rows(spark, pipeline):
    text = lambda x: " ".join(f"{x}{k} word{k}." for k in range(40))
    made = [(1, text("a"), "s"), (1, text("b"), "s"), (None, text("c"), None), (None, text("d"), "s"), (2, None, "s"), (3, "", None), (4, text("a"), "s"), (5, text("e") * 400, "t"), (5, text("e") * 400, "t")]
    held = spark.createDataFrame(made, "doc_id long, text string, source string").select("*", *[F.lit(7).alias(c) for c in ("key", "fp", "size", "taken", "n", "label", "start", "unit", "kept", "n_chars")])
    columns = held.columns
    for k, (_, stage) in enumerate(pipeline.STAGES):
        held = pipeline.table(stage(spark, held, DATA), "test-stage")
        if k < 4:
            assert held.columns == columns
        if k == 1:
            assert Counter((r["doc_id"], r["text"][:2]) for r in rows(held)) == Counter([(1, "a0"), (1, "b0"), (None, "c0"), (None, "d0"), *([(5, "e0")] if good(text("e") * 400) else [])])
    assert held.count() >= 4
