"""The corpus pipeline's stages against brute force, on documents that hold planted
toxic ones, repeated runs, exact and near copies, nulls, empty texts and ties."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salesledger.llm.queries import tokenizer_path
from tests.llm.test_operators import DOCS, WORDS, brute_fingerprint, brute_line_dedup, brute_targets, components

BAD = ["grolfa", "grolmi", "zamfu"]


def fixture() -> tuple[list[tuple], list[tuple], set[int]]:
    """(documents, labels, ids of toxic documents)."""
    rng = random.Random(12)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    texts = ["\n".join(say(rng.randint(4, 30)) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    run = "\n".join(say(30) for _ in range(3))
    texts += [f"{say(20)}\n{run}\n{say(10)}" for _ in range(6)]  # a run that repeats
    long = say(400)
    texts += [texts[3], texts[3], texts[4], long, long.replace(long.split()[200], "ending", 1), "", None, " \t\n ", say(3000)]
    toxic = set()
    for k in range(40):
        words = say(30).split()
        words[10:14] = [rng.choice(BAD)] * 4
        toxic.add(len(texts))
        texts.append(" ".join(words))
    rows = [(k, t, "en" if k % 3 else None, None if k % 11 == 0 else f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    labels = [(k, 1, int(k in toxic)) for k in range(len(texts)) if k % 4]
    return [*rows, rows[7], (None, texts[9], None, None, len(texts[9])), (None, None, None, None, None)], labels, toxic


def as_rows(df) -> Counter:
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows, toxic, [each stage's result on the one before], folder)."""
    rows, labels, toxic = fixture()
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return rows, toxic, out, folder


def test_toxicity_stage_drops_the_toxic_and_nothing_else(stages):
    rows, toxic, out, _ = stages
    assert as_rows(out[0]) == Counter(r for r in rows if r[0] not in toxic)


def test_line_stage_equals_brute_force(stages):
    _, _, out, _ = stages
    before = sorted(as_rows(out[0]), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    places = {n: r for n, r in enumerate(before)}  # a document's place in the order by doc_id, null first
    want = brute_line_dedup([(n, r[1] or "") for n, r in places.items()])
    words_of = lambda t: [x for x in (t or "").split("\n") if x.strip()]
    after = Counter((r[0], tuple(words_of(r[1]))) for r in as_rows(out[1]).elements())
    assert after == Counter((r[0], tuple(words_of(want[n]))) for n, r in places.items() for _ in range(as_rows(out[0])[r]))
    assert sum(len(t or "") for _, t, *_ in as_rows(out[1])) < sum(len(t or "") for _, t, *_ in as_rows(out[0])) - 500
    assert all(n == (None if t is None else len(t)) for _, t, _, _, n in as_rows(out[1]))


def test_copies_stage_equals_brute_force(stages):
    _, _, out, _ = stages
    before = [r for r in as_rows(out[1])]
    prints = [brute_fingerprint(r[1]) for r in before]
    links = [(a, b) for a in range(len(before)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 3]
    groups = set(components(range(len(before)), links).values())
    kept = as_rows(out[2])
    assert sum(kept.values()) == len(groups) and set(kept) <= set(before)
    for group in groups:
        [one] = [before[k] for k in group if before[k] in kept]
        ids = [before[k][0] for k in group if before[k][0] is not None]
        assert one[0] == min(ids, default=None)
    assert any(len(g) >= 3 for g in groups)


def test_mix_stage_meets_its_targets(stages):
    _, _, out, _ = stages
    before, after = as_rows(out[2]), as_rows(out[3])
    size = lambda r: len((r[1] or "").split())
    sizes, most = Counter(), Counter()
    for r, n in before.items():
        sizes[r[3]] += n * size(r)
        most[r[3]] = max(most[r[3]], size(r))
    target, got = brute_targets(dict(sizes)), Counter()
    for r, n in after.items():
        got[r[3]] += n * size(r)
        assert n <= 2 * before[r] and size(r) > 0
    assert all(abs(got[s] - target[s]) <= most[s] / 2 + 1 for s in sizes)


def test_packing_stage_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    _, _, out, _ = stages
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r, n in as_rows(out[3]).items():
        want[r[0]] += n * (len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1)
    pieces = out[4].collect()
    got, placed = Counter(), {}
    for p in pieces:
        got[p["doc_id"]] += p["length"]
        placed.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert got == want
    for parts in placed.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 4096
    assert len(placed) <= math.ceil(sum(want.values()) / 4096) + 1


def test_run_is_the_chain_of_its_stages_and_takes_empty_tables(spark, stages, tmp_path):
    _, _, out, folder = stages
    rows = lambda df: Counter(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(out[4])
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    extra = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"size": F.lit(1), "fp": F.lit("x"), "score": F.lit(0.5)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, extra, folder).columns == extra.columns, name
