"""The numbered queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import align_tokens
from tessera.llm.blockmax import exact_top_k, multiples
from tessera.llm.dartminhash import near_duplicates
from tessera.llm.frames import read_frames, write_frames
from tessera.llm.gridorder import near_vectors
from tessera.llm.hamming import hamming_search
from tessera.llm.langid import identify_languages
from tessera.llm.mixture import mix_sources
from tessera.llm.packing import pack_documents
from tessera.llm.periods import periodic_runs, repeating, run_digests
from tessera.llm.pseudonyms import pseudonymise
from tessera.llm.substrings import remove_repeats
from tessera.llm.tokencount import count_tokens

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    """The pre-token pattern that belongs to the byte-level files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


#: Key of the registered queries; a real run takes its own from a secret store.
DEMO_KEY = b"registered queries only"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_hamming_search")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search(table(spark, sf_dir, "embeddings"), multiples(20), k=20)


@query("op2_rank_order_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"), size=400, longest=3)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), split_pattern(), limit=512)


@query("op4_token_frames")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_frames(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end_id=1)
    return read_frames(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_histogram_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0, size=1024,
                            payload={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op6_doubling_windows", """
    with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
    starts as (select doc_id, ws, unnest(generate_series(1, len(ws) - 19)) s from w),
    windows as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') k from starts),
    later as (select doc_id, s from windows qualify row_number() over (partition by k order by doc_id, s) > 1),
    gone as (select distinct doc_id, unnest(generate_series(s, s + 19)) i from later),
    places as (select doc_id, unnest(ws) word, unnest(generate_series(1, len(ws))) i from w),
    kept as (select p.doc_id, string_agg(p.word, ' ' order by p.i) kept, count(*) n from places p anti join gone g on p.doc_id = g.doc_id and p.i = g.i group by p.doc_id)
    select w.doc_id, cast(len(ws) as bigint) n_words, cast(len(ws) - coalesce(n, 0) as bigint) n_removed, sha256(coalesce(kept, '')) kept_sha256
    from w left join kept on w.doc_id = kept.doc_id""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (remove_repeats(table(spark, sf_dir, "documents"), window=20)
            .select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")))


@query("op7_dart_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8, size=5, bands=20, each=6)


@query("op8_feistel_pseudonyms")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY).select("doc_id", "text", "private", F.size("private").alias("n_private"))


@query("op9_block_max_top_k", """
    with ok as (
        select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
        select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) as bigint) score
        from ok q join ok c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0),
    ranked as (
        select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 5""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), multiples(50), k=5, scale=256)


@query("op10_source_mix", """
    with sizes as (
        select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size,
               cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ' ' || coalesce(text, '')), 1, 12) as bigint) h
        from documents),
    caps as (
        select source, cast(sum(size) as bigint) source_size, cast(3 * sum(size) as double) cap,
               cast([5, 2, 1][1 + cast((row_number() over (order by source nulls last) - 1) % 3 as integer)] as double) weight
        from sizes group by source),
    levels as (
        select *, cap / weight ratio, row_number() over o pos,
               (sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
               / sum(weight) over (o rows between current row and unbounded following) lev
        from caps window o as (order by cap / weight, source nulls last)),
    first_free as (select lev from levels where ratio >= lev order by pos limit 1),
    targets as (select source, source_size, least(cap, weight * (select lev from first_free)) target from levels),
    budgets as (
        select *, case when source_size > 0 then least(cast(round(target) as bigint), 3 * source_size) // source_size else 0 end full_copies from targets),
    rests as (select *, least(cast(round(target) as bigint), 3 * source_size) - full_copies * source_size rest from budgets),
    by_hash as (select source, h, sum(size) size from sizes group by all),
    cums as (select *, sum(size) over (partition by source order by h) upto from by_hash),
    cuts as (
        select c.source, min(h) last, arg_min(2 * (rest - (upto - size)) >= size, h) also
        from cums c join rests r on c.source is not distinct from r.source where rest > 0 and upto > rest group by c.source)
    select s.doc_id, s.size, r.source_size, r.target,
           cast(s.size * (full_copies + case when s.h < c.last or (s.h = c.last and c.also) then 1 else 0 end) as bigint) taken
    from sizes s join rests r on s.source is not distinct from r.source left join cuts c on s.source is not distinct from c.source""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), share=1.0, max_repeat=3)
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


@query("op12_grid_order_join", """
    with recursive ok as (
        select vec_id, list_transform(embedding, lambda x: cast(x as double)) v from embeddings
        where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
    pairs as materialized (
        select a.vec_id a, b.vec_id b from ok a join ok b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.95),
    walk as (select distinct a start, a here from pairs union select w.start, p.b from walk w join pairs p on w.here = p.a),
    least as (select start, min(here) component_id from walk group by start),
    counts as (select a, count(*) n_links from pairs group by a)
    select e.vec_id, cast(coalesce(n_links, 0) as bigint) n_links, coalesce(component_id, e.vec_id) component_id, e.vec_id = coalesce(component_id, e.vec_id) kept
    from embeddings e left join counts on e.vec_id = counts.a left join least on e.vec_id = least.start""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.95)


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(repeating(table(spark, sf_dir, "documents")), least=6, exponent=4))
