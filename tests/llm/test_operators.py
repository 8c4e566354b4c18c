"""Each operator against brute force on small tables, and on odd input: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from salesledger.llm import embeddings, html_main, line_dedup, mixing, packing, quality, sharding, simhash, toxicity, warc
from salesledger.llm.components import connected_components, local_roots
from salesledger.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in "lo mi ta ke su ra".split() for b in "ne po shi ku ma".split()]


def sentence(n: int) -> str:
    return " ".join(RNG.choice(WORDS) for _ in range(n)).capitalize() + "."


def corpus() -> list[tuple]:
    RNG.seed(5)
    texts = [sentence(RNG.randint(1, 80)) for _ in range(40)]
    texts += [texts[3], texts[3], texts[5].replace("lone", "mipo", 1), "", None, "  \t ", "x", "\n".join(sentence(30) for _ in range(300))]
    rows = [(k, t, None if k % 9 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", len(t) if t else None) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[7], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "clash", 7) for r in corpus()]
    return spark.createDataFrame(rows, DOCS + ", rid string, size int").repartition(3).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return {n: frozenset(g) for g in groups.values() for n in g}


def test_connected_components_of_chains_stars_and_noise(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(300, 200), (200, 250)] + [(7, 7)]
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = components({x for p in pairs for x in p if p[0] != p[1]}, pairs)
    for a, b in itertools.combinations(got, 2):
        assert (got[a] == got[b]) == (want[a] == want[b])
    assert set(got) == set(want)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert local_roots(4, np.array([3, 1]), np.array([1, 0])).tolist() == [0, 0, 2, 0]


def brute_fingerprint(text, k=3):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", lower)]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(docs):
    rows = corpus()
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [(d, brute_fingerprint(t)) for d, t, *_ in rows]
    nodes = {f for _, f in prints}
    groups = components(nodes, [(a, b) for a, b in itertools.combinations(nodes, 2) if (a ^ b).bit_count() <= 3])
    least = {f: min((d for d, g in prints if g in groups[f] and d is not None), default=None) for f in nodes}
    assert got == Counter((d, f"{f:016x}", least[f]) for d, f in prints)


def test_ball_hashing_finds_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(x) for x in rng.choice(64, k, replace=False)) for k in (1, 2, 3, 4, 5) for b in base[:60]]
    fps = {int(b) for b in base} | set(near)
    signed = [(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps]
    links = [(r["src"] % (1 << 64), r["dst"] % (1 << 64)) for r in simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()]
    assert components(fps, links) == components(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3])


def test_simhash_hot_prefix_is_worked_off_in_turns(monkeypatch):
    fp = np.arange(0, 4096, 5, dtype=np.uint64)
    args = (fp, np.zeros(len(fp), np.int64), np.zeros(len(fp), np.int64), 58)
    whole = set(zip(*(x.tolist() for x in simhash._meetings(*args)), strict=True))
    parts = [simhash._meetings(*args, turn, 3) for turn in range(3)]
    assert whole == {p for a, b in parts for p in zip(a.tolist(), b.tolist(), strict=True)}


def test_keep_one_keeps_one_row_of_each_component(docs, no_docs):
    kept = simhash.keep_one(docs).collect()
    wanted = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept) == sorted(wanted)
    assert simhash.keep_one(no_docs).count() == 0 and simhash.near_duplicates(no_docs).count() == 0


def brute_repeats(text):
    words = (text or "").split()
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)})


def test_quality_measures_and_verdicts(spark, docs, no_docs):
    prose, menu = "\n".join(sentence(25) for _ in range(4)), " | ".join(WORDS[:14])
    passage = " ".join(WORDS[:12])
    texts = [prose, menu, f"{prose}\n{menu}", f"{passage} x {passage} y {passage}", "a " * 500, f"{prose}\nAll rights reserved.\n", "## " * 40, None, "", f"{sentence(9)}\n" * 6, " ".join(WORDS * 3).upper() + "!!"]
    rows = {r["doc_id"]: (r["text"], r["quality"]) for r in quality.judge(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for text, q in rows.values():
        assert (q["n_words"], q["n_repeat_words"]) == (len((text or "").split()), brute_repeats(text))
        assert q["word_chars"] == sum(map(len, (text or "").split()))
    assert [rows[k][1]["kept"] for k in range(len(texts))] == [True, False, True, False, False, True, False, False, False, False, False]
    assert rows[2][1]["lost_words"] == len(menu.split()) and rows[9][1]["n_dup_lines"] == 5
    assert quality.judge(docs).count() == docs.count() and quality.judge(no_docs).count() == 0
    cleaned = spark.createDataFrame([(f"{prose}\n{menu}",), (None,)], "text string").select(quality.cleaned_text(__import__("pyspark").sql.functions.col("text")).alias("t")).collect()
    assert [r["t"] for r in cleaned] == [prose, None]


def brute_line_dedup(rows, least=50):
    """Deletes every line of a run of ``least`` words that occurs earlier."""
    lines = {d: [(k, x.strip(), len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for d, t in rows}
    first, gone = {}, defaultdict(set)
    runs = []
    for d in sorted(lines):
        for i in range(len(lines[d])):
            total = 0
            for j in range(i, len(lines[d])):
                total += lines[d][j][2]
                if total >= least:
                    runs.append((d, i, j, tuple(x for _, x, _ in lines[d][i : j + 1])))
    for d, i, _, key in sorted(runs):
        first.setdefault(key, (d, i))
    for d, i, j, key in runs:
        if first[key] != (d, i):
            gone[d] |= set(range(lines[d][i][0], lines[d][j][0] + 1))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d]) for d, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    pool = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (3, 10, 20, 30, 30, 49, 50, 60, 5, 26)]
    rows = [(d, "\n".join(rng.choice([*pool, "", "  ", f"only {d} {k} " + "z " * 12]) for k in range(rng.randint(0, 14)))) for d in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    words_of = lambda texts: {d: [x for x in t.split("\n") if x.strip()] for d, t in texts.items()}
    assert words_of(got) == words_of(brute_line_dedup(rows))


def test_line_dedup_odd_rows(docs, no_docs):
    out = line_dedup.remove_repeated_runs(docs)
    assert out.columns == [*docs.columns, "n_lines", "removed_lines"] and out.count() == docs.count()
    assert all((r["text"] is None) == (r["n_lines"] == 0) for r in out.collect())
    assert line_dedup.remove_repeated_runs(no_docs).count() == 0


def test_packing_round_trip(docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.pack(docs, tokenizer_path()).collect():
        found[r["doc_id"], r["piece"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for d, t, *_ in corpus():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want[d, k].append((at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 4096
    total = sum(n for v in want.values() for _, n, _ in v)
    assert len(sequences) == -(-total // 4096)
    assert packing.pack(no_docs, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_packing_plan_holds_every_piece_and_is_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(4096, rng.lognormal(6.5, 1, 20_000).astype(int) + 1), minlength=4097)
    found = packing.plan(counts)
    held = np.zeros(4097, np.int64)
    for lengths, times in found:
        assert sum(k * v for k, v in lengths.items()) <= 4096
        for k, v in lengths.items():
            held[k] += v * times
    assert (held == counts).all()
    assert sum(t for _, t in found) <= 1.005 * (np.arange(4097) * counts).sum() / 4096 + 1


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(2)
    price = np.append(0, rng.random(12))
    take = packing.knapsack(price, 12)
    value = [0.0] * 13
    for room in range(1, 13):
        value[room] = max([value[room - 1], *(value[room - k] + price[k] for k in range(1, room + 1))])
        got, left = 0.0, room
        while left and take[left]:
            got += price[take[left]]
            left -= take[left]
        assert got == pytest.approx(value[room])


def test_word_ids_equal_the_tokenizer_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["a, b. é, ×, ”, c., ., d.. x'. 1, é.", "Á ́b x\x1cy 'S it'll <|endoftext|>q z w   ΑΣ Σ\n\nİ 1234 ,,.", "", None, " \t\n"]
    tokenizer, words = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    for _ in range(2):
        got = words.encode(pa.array(texts))
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def page(body: str, k: int) -> str:
    return f"<html><head><title>t{k}</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy {k}</div>{body}<footer>(c) site</footer></body></html>"


def test_main_text_of_pages(spark):
    rows = [(k, f"https://h.example/{k}", page(f"<article><h1>T{k}</h1><p>First &amp; &lt;b&gt; {k}\n  wide<br>line<p>Second <i>part</i> {k}</p><div class='comments'><p>nice!</p></div></article><aside>side</aside><form>name <input></form>", k)) for k in range(6)]
    plain = [(10 + k, f"http://other.example/{k}", page(f"<div id=x><p>Body text {k} of the page.</p></div><div class='q'><a href=/a>Link one</a> <a href=/b>Link two</a></div><div id='y'><p>Same words on each page.</p></div>", k)) for k in range(6)]
    odd = [(20, None, "plain words"), (21, "nonsense", None), (22, "http://z.example", ""), (23, "http://z.example", "<!-- open"), (24, "http://z.example", "<p>a<p>b</div></p><b>c"), (25, "http://z.example", "<script>x"), (None, None, None)]
    frame = spark.createDataFrame([(*r, "old") for r in rows + plain + odd + rows[:1]], "page_id long, url string, html string, text string")
    out = [(r["page_id"], r["text"], r["n_chars"]) for r in html_main.extract(frame).collect()]
    got = dict((a, b) for a, b, _ in out)
    assert len(out) == len(rows + plain + odd) + 1 and all(n == len(t) for _, t, n in out)
    assert got[2] == "T2\n\nFirst & <b> 2 wide line\n\nSecond part 2"
    assert got[13] == "Body text 3 of the page."
    assert [got[k] for k in range(20, 26)] == ["plain words", "", "", "", "a\n\nb\n\nc", ""]
    assert html_main.extract(frame.limit(0)).count() == 0


def texts_of(spark, bodies):
    rows = [(k, f"http://t.example/{k}", f"<html><body>{b}</body></html>") for k, b in enumerate(bodies)]
    return {r["page_id"]: r["text"] for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_template_holds_inside_main_and_names_drop_no_main_text(spark):
    own = [f"Own words {k} of a page, {'long ' * (k + 3)}text." for k in range(8)]
    notice = "<p>Buy our paper today!</p>"
    got = texts_of(spark, [f"<article>{notice}<p>{t}</p><div><p>Terms apply.</p></div></article>" for t in own])
    assert got == dict(enumerate(own))
    for open_, close in (("<div class='page has-sidebar'><article>", "</article></div>"), ("<article class='post tags-x'>", "</article>"), ("<form id=f><div>", "</div></form>")):
        assert texts_of(spark, [f"{open_}<p>{t}</p>{close}<div class='sidebar'>{k}</div>" for k, t in enumerate(own)]) == dict(enumerate(own))
    assert texts_of(spark, [f"<div class='post'><p>{k}</p></div><div id=z><p>{t}</p></div>" for k, t in enumerate(own)])[3] == f"3\n\n{own[3]}"
    assert texts_of(spark, [f"<article><p>{k} words</p></article><div class='comments'><p>{t}</p></div>" for k, t in enumerate(own)])[3] == "3 words"
    copies = texts_of(spark, [f"<article><p>{t}</p></article>" for t in own[:4] + own[:1] * 4])
    assert [copies[k] for k in range(8)] == own[:4] + own[:1] * 4


def test_element_once_a_page_inside_a_repeated_one(spark):
    own = [f"Own words {k} of a page." for k in range(8)]
    lists = "<ul><li>Alpha {0}<li>Beta {0}<li><h2>Gamma {0}</h2><li>Delta {0}</ul>"
    bodies = [lists.format(k) + f"<div id=q><a href=/a>Link one {k}</a> <a href=/b>Link two</a></div><p>{t}</p>" for k, t in enumerate(own)]
    got = texts_of(spark, bodies)
    assert all("Link" not in t and t.endswith(own[k]) for k, t in got.items())


def brute_targets(sizes):
    sources = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = [s for s in sources if s not in capped]
        room = left - sum(2 * sizes[s] for s in capped)
        target = {s: 2 * sizes[s] if s in capped else room * weight[s] / sum(weight[x] for x in rest) for s in sources}
        over = [s for s in rest if target[s] > 2 * sizes[s]]
        if not over:
            return target
        capped |= set(over)


def test_mix_meets_targets(docs, no_docs):
    rows = mixing.mix(docs, ["doc_id", "source"]).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    target, taken = brute_targets(dict(sizes)), Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    assert len(rows) == docs.count() and mixing.mix(no_docs).count() == 0
    again = Counter((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs.repartition(5), ["doc_id"]).collect())
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == again


def test_schedule_keeps_every_stretch_near_the_shares(spark):
    targets = spark.createDataFrame([(0, "a", 60_000, 60_000), (0, "b", 30_000, 30_000), (0, "c", 9_000, 10_000), (1, "", 10, 10)], "nosource int, src string, total long, want long")
    slots = [(r["slot"], r["src"], r["words"], r["rank"]) for r in mixing.schedule(targets, 10).collect()]
    assert Counter(s for _, s, w, _ in slots for _ in range(w)) == {"a": 60_000, "b": 30_000, "c": 10_000, "": 10}
    order = [s for i, s, _, _ in sorted(x for x in slots if x[0] is not None)]
    for at in range(0, len(order) - 1000, 1000):
        assert abs(order[at : at + 1000].count("a") - 600) <= 12 and abs(order[at : at + 1000].count("c") - 100) <= 12


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 64))
    near = np.concatenate([base[:40] + rng.standard_normal((40, 64)) * s for s in (0.05, 0.2, 0.33)] + [base[:1] + rng.standard_normal((60, 64)) * 0.1])
    x = np.concatenate([base, near, base[:5]]).astype(np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [1.0, None] * 32, [float("inf")] * 64, [1.0] * 3, [2.0] * 3, [1e-30] * 64, [1e30] * 64]
    rows = [(k, v) for k, v in enumerate([*x.tolist(), *odd])] + [(None, x[0].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(frame.repartition(3)).collect()}
    unit = {}
    for k, v in rows:
        a = np.array(v if v else [0.0], dtype=object)
        if k is not None and all(c is not None and np.isfinite(c) for c in a) and any(a):
            b = a.astype(np.float32).astype(np.float64)
            unit[k] = b / np.linalg.norm(b)
    links = [(i, j) for i, j in itertools.combinations(unit, 2) if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95]
    groups, degree = components([k for k, _ in rows if k is not None], links), Counter(x for p in links for x in p)
    assert len(links) > 1000
    for k, _ in rows[:-1]:
        assert got[k] == (degree[k], min(groups[k]), min(groups[k]) == k)
    assert got[None] == (0, None, None)
    assert embeddings.near_duplicates(frame.limit(0)).count() == 0


def test_double_embeddings_keep_range_and_digits(spark):
    e = 1e-9  # below a float's digits
    rows = [(1, [1e300, 0.0]), (2, [1e300, 1e299]), (3, [0.0, 1.0]), (4, [-0.0, 2.0]), (5, [0.0, 1.0 + e]), (6, [-1.0, 0.0])]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (0, 6)}


@pytest.mark.parametrize(("dim", "n"), [(1, 100), (2, 100), (2, 10**6), (3, 10**5), (8, 10**7), (16, 10**7), (64, 10**5)])
def test_links_meet_in_a_filter_in_any_dimension(dim, n):
    rng = np.random.default_rng(dim)
    code = embeddings.ProductCode(dim, n)
    a = embeddings._unit(rng.standard_normal((60, dim)))
    side = rng.standard_normal((60, dim))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = a if dim == 1 else 0.97 * a + math.sqrt(1 - 0.97**2) * embeddings._unit(side)
    met = [set(zip(*(x.tolist() for x in code.passed(v)), strict=True)) for v in (a, b)]
    assert len({row for row, _ in met[0] & met[1]}) >= 57


@pytest.mark.parametrize(("dim", "n"), [(64, 10**6), (64, 10**7), (16, 10**7), (768, 10**7)])
def test_links_at_the_least_cosine_meet_at_every_size(dim, n):
    rng = np.random.default_rng(n + dim)
    a = embeddings._unit(rng.standard_normal((500, dim)))
    side = rng.standard_normal((500, dim))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * embeddings._unit(side)
    code = embeddings.ProductCode(dim, n)
    met = [set(zip(*(x.tolist() for x in code.passed(v)), strict=True)) for v in (a, b)]
    assert len({row for row, _ in met[0] & met[1]}) >= 490
    assert {row for row, _ in met[0]} == set(range(500))  # none without a filter


def test_embedding_blocks_split_a_large_filter(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal(16) + rng.standard_normal((70, 16)) * 0.02
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    got = embeddings.near_duplicates(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(69, 0)}


def test_toxicity_learns_from_its_folds_alone(spark, no_docs):
    rng = random.Random(2)
    bad = ["grolfa", "grolmi", "zamfu"]
    rows, labels = [], []
    for k in range(900):
        words, toxic = [rng.choice(WORDS) for _ in range(rng.randint(5, 60))], k % 6 == 0
        if toxic:
            words[rng.randrange(len(words)) :] = [rng.choice(bad) + rng.choice("xyz")] * 2
        rows.append((k, " ".join(words), "s"))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    rows += [(None, None, "s"), (901, "", "s"), (902, "you idiot, total scum", "s")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    table = spark.createDataFrame([*labels, (None, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame, table).collect()}
    assert len(got) == len(rows)
    for k in range(900):
        assert got[k]["predicted"] == int(k % 6 == 0) and got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1)
    assert got[901]["predicted"] == 0 and 0 <= got[901]["score"] <= 1 and got[None]["predicted"] == 0
    held_out = [(k, t) for k, t in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    flipped = spark.createDataFrame([(k, 1 - t if (k, t) in held_out else t) for k, t in labels], "doc_id long, toxic int")
    assert toxicity.train(frame, flipped) == toxicity.train(frame, table)
    assert {r["predicted"] for r in toxicity.score(frame.where("doc_id = 902"), table.limit(0)).collect()} == {1}
    assert toxicity.score(no_docs, table).count() == 0


def test_no_toxic_entry_is_cut_by_rank(spark):
    rng = random.Random(3)
    token = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    common, rare = [token() for _ in range(1500)], [token() for _ in range(12)]
    rows = []
    for k in range(120):  # toxic: many frequent toxic words, rare ones in three documents each
        rows.append((k, " ".join([*rng.sample(common, 150), *(w for j, w in enumerate(rare) if k // 3 == j), *rng.sample(WORDS, 5)])))
    rows += [(k, " ".join(rng.choices(WORDS, k=20))) for k in range(120, 720)]
    keep = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    seen = Counter(w for k, t in keep if k < 120 for w in t.split())
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, int(k < 120)) for k, _ in rows], "doc_id long, toxic int"))
    found = {w for w in rare if seen[w] >= toxicity.MIN_SUPPORT}
    assert found and found <= model.weight.keys() and all(model.weight[w] > 0 for w in found)


def test_label_model_discounts_repeated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    vote = lambda right: np.where(rng.random(2000) < right, y, ~y)
    noisy = vote(0.8)
    votes = np.column_stack([vote(0.9), vote(0.9), noisy, noisy, noisy]).astype(float)
    posterior, _, say = toxicity.label_model(votes, np.ones(2000))
    assert say[2:].max() < 0.6 < say[:2].min()
    assert ((posterior > 0.5) == y).mean() > 0.88


def test_shards_are_even_and_slots_gapless(docs, no_docs, spark):
    rng = random.Random(9)
    rows = [(k, "w" * rng.randint(0, 400), f"l{k % 4}", "hot" if k % 3 else f"s{k}") for k in range(4000)] + [(9000 + k, "copy", None, None) for k in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = sharding.shard(frame).collect()
    size, slots = Counter(), defaultdict(list)
    for r in out:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(size) == set(range(16)) and max(size.values()) <= 1.03 * min(size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({r["shard"] for r in out if r["doc_id"] >= 9000}) == 1
    odd = sharding.shard(docs).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in corpus())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in odd) == want
    assert sharding.shard(no_docs).count() == 0


def test_warc_round_trip(spark, tmp_path):
    copy = "<p>" + "same " * 40
    rows = [(k, f"http://h.example/{k}", f"<p>{k} é\r\n\r\n" + "x" * (k % 300)) for k in range(400)] + [(1000 + k, "http://c.example/\r\nx", copy) for k in range(50)]
    rows += [(2000, None, None), (2001, "u", ""), (2002, "u", "short"), (2003, "u", "short"), (None, "u", copy), rows[7], rows[420]]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, first string").repartition(4)
    outs = [f"file://{tmp_path}/{k}" for k in range(2)]
    sums = [sorted((r["file"], r["records"], r["bytes"], r["sha256"]) for r in warc.write_archives(f, out, roll_bytes=4000).collect()) for f, out in zip((frame, frame.repartition(2)), outs, strict=True)]
    assert sums[0] == sums[1] and len(sums[0]) > 3
    names = sorted(p.name for p in (tmp_path / "0").iterdir() if not p.name.startswith("."))
    assert names == sorted([s[0] for s in sums[0]] + ["_manifest"])
    assert all(hashlib.sha256((tmp_path / "0" / f).read_bytes()).hexdigest() == digest for f, _, _, digest in sums[0])
    got = Counter(tuple(r) for r in warc.read_archives(spark, outs[0]).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        first = min(q for q, _, x in rows if q is not None and (x or "") == (h or ""))
        again = len(raw) >= 100 and p != first
        want[p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert got == want
    bad = bytearray((tmp_path / "0" / names[-1]).read_bytes())
    with pytest.raises(Exception):
        list(map(warc.parse, warc.records(__import__("io").BytesIO(bytes(bad[: len(bad) // 2])))))
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_warc_ranges_of_many_heavy_ids_and_of_hot_keys(spark, tmp_path):
    spread = spark.range(10_000).select((F.col("id") * 1_000_003_000_017).alias("page_id"), F.lit("d").alias("digest"), F.lit(100).cast("long").alias("bytes"))
    cuts = warc.range_cuts(spread, 250)  # each holds the records that begin in 250 bytes: two or three
    assert len(cuts) == 3999 and cuts == sorted(cuts)
    hot = [(None, f"{k:03}", 10) for k in range(300)] + [(7, f"{k:03}", 10) for k in range(300)] + [(k, "x", 10) for k in range(10, 40)] + [(50, "y", 5000)]
    cuts = warc.range_cuts(spark.createDataFrame(hot, "page_id long, digest string, bytes long").repartition(5), 100)
    keys = sorted(((i is not None, i or 0, d), n) for i, d, n in hot)
    held = Counter()
    for key, n in keys:
        held[sum(c <= key for c in cuts)] += n
    assert len(held) > 60 and sorted(held.values())[-2] <= 110
    old, files = spark.conf.get("spark.sql.shuffle.partitions"), []
    pages = spark.createDataFrame([(k % 50 if k % 3 else None, f"u{k}", f"text {k} " * 40) for k in range(400)], "page_id long, url string, html string")
    for n in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        files.append(sorted(map(tuple, warc.write_archives(pages.repartition(int(n)), str(tmp_path / n), roll_bytes=2000).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert files[0] == files[1] and len(files[0]) > 5


def test_large_groups_of_equal_texts_keep_a_shard(spark):
    rng = random.Random(3)
    rows = [(k, "w" * rng.randint(1, 400), "l", f"s{k % 5}") for k in range(4000)]
    whole = sum(len(t) + 1 for _, t, *_ in rows)
    copies = {f"{name} " * 60: int(part * whole / 16 / (len(name) * 60 + 61)) for name, part in (("half", 0.5), ("most", 0.9), ("some", 0.05), ("more", 0.3), ("huge", 2.5))}
    rows += [(10_000 * (g + 1) + k, text, "l", None) for g, (text, n) in enumerate(copies.items()) for k in range(n)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    size, of = Counter(), defaultdict(set)
    for r in out:
        size[r["shard"]] += r["size"]
        of[r["doc_id"] // 10_000].add(r["shard"])
    assert [len(of[g]) for g in (1, 2, 3, 4)] == [1] * 4 and len(of[5]) > 2
    assert max(size.values()) <= 1.05 * min(size.values()) and len(size) == 16


def test_html_keeps_headings_and_sections_of_the_article(spark):
    rng = random.Random(8)
    say = lambda: " ".join(rng.choice(WORDS) for _ in range(40)) + "."
    rows, want = [], {}
    for k in range(8):
        a, b, c, d = say(), say(), say(), say()
        rows.append((k, f"https://one.example/{k}", f"""<html><body><div id=wrap><h1>My site</h1><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul>
          <article><h1>Title {k} {say()[:9]}</h1><h2>Introduction</h2><p>{a}</p><p>Sign up for our letter today.</p><h2>Results</h2><p>{b}</p>
          <section class='related-work'><h3>Related work</h3><p>{c}</p></section><div class='share-buttons'>Tell {say()[:12]}</div>
          <div class='related posts'><h4>Related</h4><p>{say()[:30]}</p></div></article><p class=comments>{d}</p></div></body></html>"""))
        want[k] = ["Introduction", a, "Results", b, "Related work", c]
    got = {r["page_id"]: r["text"].split("\n\n") for r in html_main.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v[1:] for k, v in got.items()} == want and all(v[0].startswith("Title") for v in got.values())
    assert [html_main._is_furniture(n) for n in ("related", "related-posts", "related-work", "social-security", "nav-main", "cookie-notice", "post-comments", "search", "content")] == [
        True, True, False, False, True, True, True, True, False,
    ]


def test_line_dedup_finds_a_later_copy_of_a_longer_run_than_the_first_copy_shares(spark):
    run, tail = [sentence(30) for _ in range(2)], sentence(20)
    texts = ["\n".join([*run, sentence(20)]), "\n".join([*run, tail]), "\n".join([sentence(10), *run, tail, sentence(9)])]
    got = {r["doc_id"]: r for r in line_dedup.remove_repeated_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    # extending the match with the first copy alone would leave the tail, which only the second copy shares
    assert [got[k]["removed_lines"] for k in range(3)] == [0, 2, 3]
    assert got[2]["text"] == "\n".join([texts[2].split("\n")[0], texts[2].split("\n")[-1]])


def test_line_dedup_extends_selected_positions_both_ways(spark, monkeypatch):
    run = [sentence(18) for _ in range(9)]
    texts = ["\n".join([sentence(20), *run, sentence(20)]), "\n".join([sentence(12), *run, sentence(30)]), "\n".join([*run[:1], sentence(70)])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    removed = lambda: [r["removed_lines"] for r in line_dedup.remove_repeated_runs(docs).orderBy("doc_id").collect()]
    assert removed() == [0, 9, 0]

    positions = line_dedup._positions(line_dedup._lines(docs.withColumn("rid", F.lit(0))), 50)
    windows = positions.select(F.sum(F.size("reaches"))).first()[0]
    assert positions.count() < windows and positions.groupBy("doc_id", "pos").count().where("count > 1").isEmpty()
    shared = {(r["doc_id"], r["pos"]) for r in line_dedup._shared(positions).collect()}
    assert {d for d, _ in shared} == {0, 1} and {p for d, p in shared if d == 0} == {p for d, p in shared if d == 1}

    # a position alone is not the run: without reaching left and right the run's ends stay
    alone = F.transform("reaches", lambda r: r.withField("first", F.col("pos")).withField("last", F.col("pos")))
    whole = line_dedup._extended
    monkeypatch.setattr(line_dedup, "_extended", lambda p: whole(p.withColumn("reaches", alone)))
    assert 0 < removed()[1] < 9


def test_html_drops_an_element_by_its_class_in_the_template(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n=12: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, want = [], {}
    for k in range(12):
        menu = "".join(f"<li><a href='/{j}'>{say(3)}</a></li>" for j in range(4 + k % 3))
        kept, body = [], ""
        for _ in range(1 + k * 7 % 3):  # lists of links that an author wrote, as many as the text needs
            kept += [say(30), say(3), say(4)]
            body += f"<p>{kept[-3]}</p><ul class='plain'><li><a href='#'>{kept[-2]}</a></li><li><a href='#'>{kept[-1]}</a></li></ul>"
        rows.append((k, f"http://a.test/{k}", f"<html><body><div class='top'><ul class='x'>{menu}</ul></div><div class='text'>{body}</div></body></html>"))
        want[k] = "\n\n".join(kept)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    texts = lambda: {r["page_id"]: r["text"] for r in html_main.extract(pages).collect()}
    assert texts() == want
    frame = [{"token": k, "parent": max(0, k - 1), "class": {"pages": 4, "vector": v}, "fixed": f} for k, v, f in ((0, 1, True), (1, 1, True), (2, 7, False), (3, 1, True), (4, 9, False), (5, 9, False))]
    assert html_main._template({t["token"]: t for t in frame}) == {0: 0, 1: 0, 3: 2, 4: 3, 5: 3}
    # each element judged by itself, whatever class it is of: the author's lists are lost
    monkeypatch.setattr(html_main, "_template", lambda by: {k: n for n, k in enumerate(sorted(by))})
    assert texts() == {k: "\n\n".join(t.split("\n\n")[::3]) for k, t in want.items()}


def test_mix_by_first_slot_keeps_every_stretch_near_the_shares(spark):
    rows = [(k, "w " * (1 + k % 9), "abc"[k % 7 % 3]) for k in range(1500)]
    out = [r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect() if r["first_slot"] is not None]
    firsts = sorted((r["first_slot"], r["source"], r["size"]) for r in out)
    whole = Counter()
    for _, source, size in firsts:
        whole[source] += size
    for at in range(0, len(firsts) - 300, 300):
        some = Counter()
        for _, source, size in firsts[at : at + 300]:
            some[source] += size
        assert all(abs(some[s] / sum(some.values()) - whole[s] / sum(whole.values())) < 0.1 for s in whole)
    assert {r["source"] for r in out} == set("abc") and all(r["taken"] > 0 for r in out)


def test_packing_plans_are_near_the_dual_bound():
    def of(lengths):
        return np.bincount(lengths, minlength=4097)

    rng = np.random.default_rng(0)
    needs = lambda counts: sum(times for _, times in packing.plan(counts))
    for lengths, exact in ((np.repeat(1366, 900), True), (np.repeat([1365, 1370], 300), True), (rng.choice([1500, 1900, 2100, 2500, 2900, 3300, 3900], 3000), False)):
        counts = of(lengths)
        bound = packing.lower_bound(counts)
        assert bound > lengths.sum() / 4096 * 1.1  # the shape tells more than the sum
        assert needs(counts) == bound if exact else bound <= needs(counts) <= 1.005 * bound
    assert packing.lower_bound(np.zeros(4097, np.int64)) == 0 == needs(np.zeros(4097, np.int64))


def test_packing_rounds_a_fractional_solution_that_holds_no_length_too_often():
    rng = np.random.default_rng(4)
    counts = np.bincount(rng.integers(1100, 1900, 3000), minlength=4097)
    found, held = packing.solve(counts), np.zeros(4097)
    for lengths, times in found.items():
        assert times > 0 and sum(k * v for k, v in lengths) <= 4096
        for k, v in lengths:
            held[k] += v * times
    assert (held <= counts + 1e-3).all() and any(t % 1 > 0.01 for t in found.values())
    bound = packing.lower_bound(counts)
    assert bound <= sum(found.values()) + (counts - held).sum()
    assert bound <= sum(t for _, t in packing.plan(counts)) <= 1.05 * bound
