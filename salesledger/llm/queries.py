"""The registered queries of this subpackage, and their SQL twins (DuckDB).

Each query runs its operator over the whole of its table and derives the
columns of the result from the operator's output. XXH64 fingerprints, packing,
templates, classifiers and trees have no SQL twin; tests compare them with
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesledger.llm import embeddings, hard_negatives, html_main, line_dedup, mixing, packing, prefix_trie, quality, sharding, simhash, top_k, toxicity, warc
from salesledger.llm.common import read


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *(F.col(f"quality.{n}") for n in names))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_runs(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), ["doc_id"])


def op7_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.borrow_heads(prefix_trie.sequences(read(spark, sf_dir, "conversations"))))


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (op1_simhash, op2_quality_rules, op3_line_dedup, op4_best_fit_packing, op5_html_text, op6_source_mix, op7_embedding_duplicates, op8_toxicity, op9_kd_shards, op10_warc, op11_prefix_trie, op12_top_k, op13_hard_negatives)
}

_W = r"[^\x20\x09-\x0D]+"
_TERMINAL = quality.TERMINAL.replace("'", "''")
_STOCK = "|".join(quality.BOILERPLATE)

OP2_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '{_W}') w from documents
), l as (
  select doc_id, unnest(string_split(t, chr(10))) x from d
), c as (
  select doc_id, x, len(regexp_extract_all(x, '{_W}')) n, len(regexp_extract_all(x, '!')) bang,
    len(regexp_extract_all(x, '\p{{Lu}}')) upper_case, len(regexp_extract_all(x, '\p{{L}}')) letters,
    len(regexp_extract_all(x, '{quality.SEPARATORS}')) bars, len(regexp_extract_all(x, '[{quality.SYMBOLS}]')) symbols
  from l
), f as (
  select doc_id, count(*) - count(distinct x) dups,
    coalesce(sum(n) filter ((n >= 5 and not regexp_matches(x, '{_TERMINAL}')) or (n >= 3 and 2 * bang >= n) or (n >= 5 and 2 * upper_case > letters)
      or (n >= 3 and 3 * bars >= n) or 2 * symbols > n or (n <= 30 and regexp_matches(x, '(?i){_STOCK}'))), 0) lost
  from c where n > 0 group by doc_id
), g as (
  select doc_id, i, array_to_string(w[i:i + 7], ' ') g from (select doc_id, w, unnest(range(1, len(w) - 6)) i from d where len(w) >= 8)
), r as (
  select doc_id, count(distinct p) repeats
  from (select doc_id, unnest(range(i, i + 8)) p from (select doc_id, i, count(*) over (partition by doc_id, g) k from g) where k > 1)
  group by doc_id
), m as (
  select d.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(t, '[{quality.SYMBOLS}]'))::bigint n_symbols,
    coalesce(dups, 0)::bigint n_dup_lines, coalesce(repeats, 0)::bigint n_repeat_words, coalesce(lost, 0) lost
  from d left join f using (doc_id) left join r using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) and 100 * lost <= {quality.MAX_LOST_PERCENT} * n_words as kept
from m
"""

OP3_SQL = rf"""
with s as (
  select doc_id, text, string_split(text, chr(10)) a from documents
), l as (
  select doc_id, unnest(range(len(a))) pos, unnest(a) x from s
), n as (
  select doc_id, pos, regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') x, len(regexp_extract_all(x, '{_W}')) words from l
), c as (
  select *, (sum(words) over (partition by doc_id order by pos))::bigint c from n where words > 0
), b as (
  select *, c - words b from c
), w as (
  select doc_id, pos as f, max(pos) over t as z, list(x) over t as xs, max(c) over t - b as total from b
  window t as (partition by doc_id order by b range between current row and {line_dedup.MIN_WORDS - 1} following)
  union
  select doc_id, min(pos) over t, pos, list(x) over t, c - min(b) over t from b
  window t as (partition by doc_id order by c range between {line_dedup.MIN_WORDS - 1} preceding and current row)
), k as (
  select doc_id, f, z, row_number() over (partition by xs order by doc_id, f) nth from w where total >= {line_dedup.MIN_WORDS}
), gone as (
  select distinct doc_id, unnest(range(f, z + 1)) pos from k where nth > 1
), kept as (
  select l.doc_id, string_agg(l.x, chr(10) order by l.pos) text from l anti join gone on l.doc_id = gone.doc_id and l.pos = gone.pos group by l.doc_id
), removed as (
  select doc_id, count(*) n from gone group by doc_id
)
select s.doc_id, case when r.n is null then s.text else coalesce(kept.text, '') end as text, coalesce(len(a), 0)::bigint n_lines, coalesce(r.n, 0)::bigint removed_lines
from s left join removed r using (doc_id) left join kept using (doc_id)
"""

OP6_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::bigint size from documents
), s as (
  select source, sum(size)::hugeint total, [3, 1, 2][((row_number() over (order by source is null, source)) - 1) % 3 + 1]::hugeint weight from d group by source
), p as (
  select *, 3 * sum(total) over () - 2 * coalesce(sum(2 * total) over before, 0) as rest, sum(weight) over () - coalesce(sum(weight) over before, 0) as weights
  from s window before as (order by (2 * total)::double / weight::double, source is null, source rows between unbounded preceding and 1 preceding)
), q as (
  select *, (2 * total)::double * 2 * weights::double <= weight::double * rest::double as is_full from p
), t as (
  select source, total, case when is_full then (2 * total)::double
    else (3 * sum(total) over () - 2 * coalesce(sum(2 * total) filter (is_full) over (), 0))::double * weight::double / (2 * (sum(weight) filter (not is_full) over ())::double) end target
  from q
), o as (
  select d.*, t.total::bigint source_size, target, floor(target + 0.5)::bigint want,
    coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, '')), size rows between unbounded preceding and 1 preceding), 0)::bigint a
  from d join t on d.source is not distinct from t.source
), k as (
  select greatest(1, (sum(size) + {mixing.BLOCKS_PER_DOCUMENT} * count(*) - 1) // ({mixing.BLOCKS_PER_DOCUMENT} * count(*)))::bigint block from d
), n as (
  select source, total::bigint total, floor(target + 0.5)::bigint want, block, ((total + block - 1) // block)::bigint blocks from t, k
), e as (
  select *, want // total * blocks + (want - want // total * total + block - 1) // block as need from n where want > 0
), g as (
  select *, floor((sum(need) over upto - need)::double / sum(need) over ()::double * {mixing.GRID})::bigint lo, floor((sum(need) over upto)::double / sum(need) over ()::double * {mixing.GRID})::bigint hi
  from e window upto as (order by source is null, source rows between unbounded preceding and current row)
), i as (
  select unnest(range((select sum(need) from e)::bigint)) slot
), x as (
  select g.*, slot, row_number() over (partition by source order by slot) - 1 as nth from (select slot, slot % {mixing.GRID} * {mixing.STEP} % {mixing.GRID} p from i) join g on p >= lo and p < hi
), u as (
  select source, slot, nth % blocks as blk, block, least(least(block, total - nth % blocks * block), want - (nth // blocks * total + nth % blocks * block)) words from x where nth < need
), f as (
  select o.doc_id, o.source, o.size, min(slot) first_slot from o join u on o.source is not distinct from u.source
    and least(o.a + o.size, blk * block + words) > greatest(o.a, blk * block) group by all
)
select o.doc_id, o.size, source_size, target,
  (greatest(0, least(a + o.size, want) - a) + greatest(0, least(a + o.size, want - source_size) - a))::bigint taken, first_slot
from o left join f on f.doc_id is not distinct from o.doc_id and f.source is not distinct from o.source and f.size = o.size
"""

OP7_SQL = f"""
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
), pairs as (
  select a.vec_id a, b.vec_id b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= {embeddings.COSINE}
), reach(id, other) as (
  select vec_id, vec_id from v union select reach.id, pairs.b from reach join pairs on reach.other = pairs.a
), least_id as (
  select id, min(other) component_id from reach group by id
), n as (
  select a, count(*) n from pairs group by a
)
select v.vec_id, coalesce(n.n, 0)::bigint n_links, component_id, v.vec_id = component_id as kept
from v join least_id on id = v.vec_id left join n on n.a = v.vec_id
"""

OP10_SQL = f"""
with p as (
  select page_id, coalesce(html, '') h from pages
), f as (
  select page_id, strlen(h)::bigint payload_bytes, sha256(h) payload_digest, min(page_id) over (partition by h) least_id from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {warc.REVISIT_BYTES} and page_id <> least_id then 'revisit' else 'response' end record_type,
  case when payload_bytes >= {warc.REVISIT_BYTES} and page_id <> least_id then least_id end refers_to
from f
"""

# CRC-32 of a decimal number: the reflected polynomial, bit by bit over its digits.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split({n}::varchar, ''), lambda d: ascii(d)::ubigint)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end)), 4294967295::ubigint)"""

OP11_SQL = f"""
with e as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations where conv_id is not null
), o as (
  select conv_id, list([r, t] order by turn nulls first, substr(sha256(strlen(r)::varchar || ':' || r || t), 1, 32), strlen(t)) ts,
    ({_CRC32.format(n="conv_id")} % 9)::int h
  from e group by conv_id
), b as (
  select o.conv_id, list_concat(coalesce(f.ts[1:o.h], []), o.ts[o.h + 1:]) p from o left join o f on f.conv_id = o.conv_id - o.conv_id % 5
), m as (
  select conv_id, len(p) n, unnest(range(len(p) + 1)) depth, p from b
), nodes as (
  select p[1:depth] path, depth, min(conv_id) conv_id, count(*) n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth) ends
  from (select *, p[1:depth] as path from m) group by all
), up as (
  select path, depth, conv_id, n_convs, ends, path[1:depth - 1] above, case when depth = 0 then 0 else strlen(path[depth][2]) end bytes from nodes
), kids as (
  select above, count(*) n_children from up where depth > 0 group by above
), full_nodes as (
  select up.*, coalesce(n_children, 0) n_children from up left join kids on kids.above = up.path
), sub as (
  select path[1:a] top, sum((n_convs - 1) * bytes)::bigint saved_tokens, count(*) filter (n_children = 0) n_leaves
  from (select *, unnest(range(depth + 1)) a from full_nodes) group by all
)
select f.conv_id, f.depth::bigint depth, case when f.depth > 0 then p.conv_id end parent_conv_id, f.n_convs, f.n_children, sub.n_leaves, sub.saved_tokens, sha256(coalesce(f.ends, '')) ends_sha256
from full_nodes f join sub on sub.top = f.path left join full_nodes p on p.path = f.above and p.depth = f.depth - 1
"""

_INTEGERS = """select {columns}, list_transform(embedding, lambda x: floor({scale} * x::double)) e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"""

OP12_SQL = f"""
with v as (
  {_INTEGERS.format(columns="vec_id", scale=1024)}
), s as (
  select q.vec_id query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s qualify rank <= 10
"""

OP13_SQL = f"""
with v as (
  {_INTEGERS.format(columns="vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label", scale=256)} and label is not null
), s as (
  select q.vec_id anchor_id, c.vec_id, q.label = c.label same, list_inner_product(q.e, c.e)::bigint score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), p as (
  select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, vec_id))::int as rank, vec_id negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

ORACLE = {
    "op2_quality_rules": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op6_source_mix": OP6_SQL,
    "op7_embedding_duplicates": OP7_SQL,
    "op10_warc": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_top_k": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
