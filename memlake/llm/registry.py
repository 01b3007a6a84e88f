"""The queries of this folder, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.llm import covertree, langid, merkle, mixing, packing, repetition, secretscan, simhash, spelling, suffixdedup, toxicity, urls, weaklabels
from memlake.llm.common import held_out, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition.judged(repetition.repetition(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "longest_repeat")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weaklabels.classify(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return covertree.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digests(suffixdedup.repeated_bytes(table(spark, sf_dir, "documents")))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secretscan.scan(docs, secretscan.fit(secretscan.findings(docs)))
    return secretscan.digests(found).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_repetition, op2_toxicity, op3_mixing, op4_packing, op5_simhash, op6_urls, op7_quality, op8_language, op9_topk, op10_suffix_dedup,
        op11_merkle, op12_secrets, op13_spelling,
    )
}

ORACLES = {
    "op3_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select source, source_size, source_size::double * 3 as cap,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s
), used as (
  select *, sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding) as caps_before,
    sum(weight) over (order by cap / weight desc, source desc nulls first rows between unbounded preceding and current row) as weight_from
  from w where source_size > 0
), level as (
  -- the first source in order of cap to weight that the shared level does not fill sets the level
  select coalesce(arg_min(l, cap / weight) filter (where l * weight <= cap), max(cap / weight)) as l
  from (select *, ((select sum(source_size) from s) - coalesce(caps_before, 0)) / weight_from as l from used)
), t as (
  select source, source_size, case when source_size > 0 then least(cap, weight * l) else 0.0 end as target from w, level
), r as (
  select d.doc_id, d.size, t.source_size::bigint as source_size, t.target,
    coalesce(sum(d.size) over (partition by d.source order by md5('0:' || d.doc_id::varchar), d.doc_id rows between unbounded preceding and 1 preceding), 0) as before,
    case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as whole
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (case when size = 0 then 0 else whole * size + least(size, greatest(0, floor(target + 1e-6) - whole * source_size - before)) end)::bigint as taken
from r""",
    "op9_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)
), p as (
  select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p
)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op11_merkle": r"""
with recursive tab as materialized (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t
), d as materialized (
  select row_number() over () as id, doc_id, lang, n_chars,
    case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end || case when source is null then '-' else strlen(source) || ':' || source end
      || case when lang is null then '-' else strlen(lang) || ':' || lang end as head,
    case when text is null then '-' else strlen(text) || ':' || text end as tail,
    xor(list_reduce(list_transform(range(1, length(doc_id::varchar) + 1), lambda k: ascii(substr(doc_id::varchar, k, 1))::bigint),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 7 = 0 as tampered
  from documents, tab
), h as materialized (
  select id, doc_id, lang, sha256(head || case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end || tail) as leaf,
    case when tampered and n_chars is not null then sha256(head || strlen((n_chars::hugeint + 1)::varchar) || ':' || (n_chars::hugeint + 1) || tail) end as seen
  from d
), leaves as materialized (
  select *, dense_rank() over (order by lang nulls first) - 1 as grp, row_number() over (partition by lang order by doc_id nulls first, leaf, id) - 1 as pos from h
), tree as (
  select 0 as level, grp, pos, leaf as hash, count(*) over (partition by grp) as n from leaves
  union all
  select level + 1, grp, pos // 2, sha256(string_agg(hash, '' order by pos)), (any_value(n) + 1) // 2 from tree where n > 1 group by level, grp, pos // 2
), low as materialized (select * from tree), subroots as materialized (
  select grp as pos, hash, count(*) over () as n from low where n = 1
), top as (
  select 0 as level, pos, hash, n from subroots
  union all
  select level + 1, pos // 2, sha256(string_agg(hash, '' order by pos)), (any_value(n) + 1) // 2 from top where n > 1 group by level, pos // 2
), high as materialized (select * from top), nodes as materialized (
  select 0 as tree, level, grp, pos, hash, n from low union all select 1, level, 0, pos, hash, n from high
), climb as (
  select id, 0 as tree, 0 as level, grp, pos, (select n from nodes x where x.tree = 0 and x.level = 0 and x.grp = l.grp and x.pos = l.pos) as n, coalesce(seen, leaf) as folded, '' as proof from leaves l
  union all
  select c.id, c.tree + (c.n = 1)::int, case when c.n = 1 then 0 else c.level + 1 end, case when c.n = 1 then 0 else c.grp end,
    case when c.n = 1 then c.grp else c.pos // 2 end, case when c.n = 1 then (select max(n) from subroots) else (c.n + 1) // 2 end,
    case when c.n = 1 then c.folded when s.hash is null then sha256(c.folded) when c.pos % 2 = 1 then sha256(s.hash || c.folded) else sha256(c.folded || s.hash) end,
    c.proof || case when c.n > 1 then coalesce(s.hash, '') else '' end
  from climb c left join nodes s on s.tree = c.tree and s.level = c.level and s.grp = c.grp and s.pos = xor(c.pos, 1)
  where not (c.tree = 1 and c.n = 1)
), done as (select * from climb where tree = 1 and n = 1), root as (select hash from high where n = 1)
select l.doc_id, l.leaf, s.hash as subroot, root.hash as root, sha256(done.proof) as proof_sha256, done.folded as folded_root, done.folded = root.hash as verified
from leaves l join done using (id) join subroots s on s.pos = l.grp, root""",
    "op13_spelling": r"""
with recursive tab as materialized (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i)) as t
), r as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents
), d as materialized (
  -- UTF-8 bytes of the id, a colon and the run: letters above 7F have two
  select run, count(*) as n, list_concat(
    list_transform(range(1, length(coalesce(doc_id::varchar, '')) + 2), lambda k: ascii(substr(coalesce(doc_id::varchar, '') || ':', k, 1))::bigint),
    flatten(list_transform(range(1, length(run) + 1), lambda k: case when unicode(substr(run, k, 1)) < 128 then [unicode(substr(run, k, 1))::bigint]
      else [(192 + (unicode(substr(run, k, 1)) >> 6))::bigint, (128 + (unicode(substr(run, k, 1)) & 63))::bigint] end))) as bytes
  from r group by run, doc_id
), h as (
  select run, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) as h from d, tab
), w as materialized (
  select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(n)::bigint as n
  from h group by word having sum(n) >= 2 and length(word) >= 7
), gone as materialized (
  -- every word without its letter at k, and whole as k = 0
  select word, n, k, case when k = 0 then word else substr(word, 1, k - 1) || substr(word, k + 1) end as less
  from (select word, n, unnest(range(0, length(word) + 1)) as k from w)
), near as materialized (
  select distinct a.word, a.n, b.word as near, b.n as near_n from gone a join gone b on a.less = b.less and a.word <> b.word and (a.k = b.k or a.k = 0 or b.k = 0)
), best as (
  select word, any_value(n) as n, count(*) as n_near, (list(near order by near_n desc, encode(near)))[1] as near, max(near_n) as near_n from near group by word
), f as materialized (
  select w.word, w.n, coalesce(b.n_near, 0) as n_near, case when b.near_n >= 10 * w.n then b.near end as form, case when b.near_n >= 10 * w.n then b.near_n end as form_n
  from w left join best b using (word)
), walk as (
  select word, coalesce(form, word) as at, form is null as stop from f
  union all
  select walk.word, coalesce(f.form, f.word), f.form is null from walk join f on walk.at = f.word where not stop
)
select f.word, f.form, walk.at as root, f.n, f.n_near, f.form_n from f join walk using (word) where stop""",
}
