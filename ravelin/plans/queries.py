"""The registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dense, fusion, grounding, impacts, learning, lexical, metrics, pipelines, state, timeline
from ..operators.quantiles import at_ranks, quantiles
from ..sources import corpus, versions
from ..sources.lines import read_lines
from ..sources.shared import fresh_path, written
from ..sources.vectors import VectorIndex

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')".format
CONTENT = (lambda x: f"list_filter({TOK(x)}, lambda t: not list_contains({STOP}, t))")
SENTS = (lambda x: f"list_filter(string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ') <> '')")
STRIP = (lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')")
PREFIX = "array_to_string(string_split_regex(text, '\\s+')[1:6], ' ')"

# Text -----------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, len({TOK('text')})::int n_tokens, len(list_distinct({TOK('text')}))::int n_distinct from documents")
def tokenize_counts(spark, sf_dir):
    t = X.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).alias("n_tokens"), F.size(F.array_distinct(t)).alias("n_distinct"))


@query(f"select doc_id, array_to_string({CONTENT('text')}, ' ') content from documents")
def content_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.content_tokens(F.col("text")), " ").alias("content"))


@query(f"select doc_id, (i - 1)::int pos, s[i] sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) i from (select doc_id, {SENTS('text')} s from documents))")
def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence"))


CHUNKS = f"""chunks as (select doc_id, (i - 1)::int chunk_index, doc_id || '::c' || (i - 1) chunk_id, p[i] text, sha256(p[i]) text_sha256 from
  (select doc_id, p, unnest(range(1, len(p) + 1)) i from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP('x')}), lambda x: x <> '') p from documents)))"""


@query(f"with {CHUNKS} select * from chunks")
def chunk_paragraphs(spark, sf_dir):
    return corpus.chunk(table(spark, sf_dir, "documents"), "\n")


@query(f"with {CHUNKS} select sha256(string_agg(chunk_id || chr(1) || text, chr(0) order by doc_id, chunk_index)) corpus_sha256, count(*) chunks from chunks")
def corpus_hash(spark, sf_dir):
    return corpus.corpus_hash(corpus.chunk(table(spark, sf_dir, "documents"), "\n"))


@query(f"with {CHUNKS} select sum(('0x' || sha256(chunk_id || chr(1) || text)[1:15])::hugeint)::varchar digest, count(*) chunks from chunks")
def corpus_digest(spark, sf_dir):
    return corpus.corpus_digest(corpus.chunk(table(spark, sf_dir, "documents"), "\n"))


@query("select sha256(text) sha, count(*) n, min(doc_id) first_doc from documents group by 1 having count(*) > 1")
def doc_hash_dupes(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(f"select doc_id, {STRIP(f'array_to_string(({SENTS(chr(116)+chr(101)+chr(120)+chr(116))})[1:2], chr(32))')} answer from documents")
def extractive_answer(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.first_sentences(F.col("text")).alias("answer"))


@query(f"select item_id, {PREFIX} query, sha256('v1|corpus|' || {STRIP('regexp_replace(lower(text), chr(92) || chr(115) || chr(43), chr(32), chr(103))')} || '|' || case when item_id % 2 = 0 then '256' else 'None' end) cache_key, 'key:' || sha256(text)[1:12] client from benchmark")
def query_workload(spark, sf_dir):
    most = F.when(F.col("item_id") % 2 == 0, F.lit(256))
    return table(spark, sf_dir, "benchmark").select("item_id", X.query_prefix(F.col("text")).alias("query"), X.cache_key(F.col("text"), F.lit("corpus"), most).alias("cache_key"), X.client_tag(F.col("text")).alias("client"))


@query("""select p_partkey, 'upload-' || coalesce(nullif(trim(regexp_replace(regexp_replace(lower(p_name || '!! v1.TXT'), '\\.[^.]*$', ''), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'doc') slug from part""")
def slug_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit("!! v1.TXT"))).alias("slug"))


@query(f"""select doc_id, len(regexp_extract_all(text, '{X.NUMERAL}'))::int numerals, len(regexp_extract_all(text, '{X.CAPITALISED}', 1))::int capitalised, lower(trim(text)) = 'i don''t know' idk from documents""")
def numerals_and_capitals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(X.numerals(F.col("text"))).alias("numerals"), F.size(X.capitalised(F.col("text"))).alias("capitalised"), X.is_idk(F.col("text")).alias("idk"))


@query(f"select conv_id, 'Context:' || chr(10) || string_agg('[' || i || '] ' || text, chr(10) order by i) || chr(10) || chr(10) || 'Question: ' || min(case when i = 1 then text end) prompt from (select conv_id, text, row_number() over (partition by conv_id order by turn) i from conversations where text is not null) group by conv_id")
def prompt_build(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", X.prompt(F.element_at("t.text", 1), F.col("t.text")).alias("prompt"))


# Retrieval --------------------------------------------------------------------------------------------------------------


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), X.query_prefix(F.col("text")).alias("query"))


BM25 = f"""qs as (select item_id qid, {PREFIX} query from benchmark),
toks as (select doc_id id, {TOK('text')} t from documents), dl as (select id, len(t) dl from toks),
stats as (select count(*) n, avg(dl) avgdl from dl),
post as (select id, term, count(*) tf from (select id, unnest(t) term from toks) group by all),
dfs as (select term, count(*) df from post group by term),
bm as (select qid, id, round(sum(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) score
  from (select distinct qid, unnest({TOK('query')}) term from qs) join post using (term) join dfs using (term) join dl using (id), stats group by qid, id),
bm25 as (select *, row_number() over (partition by qid order by score desc, id) rank from bm where score > 0)"""


@query(f"with {BM25} select qid, id, score, rank from bm25 where rank <= 10")
def bm25_topk(spark, sf_dir):
    return lexical.bm25(asked(spark, sf_dir), table(spark, sf_dir, "documents"), 10)


@query(f"with {BM25} select qid, id, score, rank from bm25 where rank <= 10")
def bm25_stored(spark, sf_dir):
    path = fresh_path(spark, "impacts")
    impacts.build(table(spark, sf_dir, "documents"), path)
    return impacts.search(asked(spark, sf_dir), path, 10)


@query(f"with {BM25} select term, df, round(greatest(0, ln((n - df + 0.5) / (df + 0.5) + 1)), 6) idf from dfs, stats")
def term_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lexical.term_stats(lexical.document_frequencies(docs), lexical.corpus_stats(docs)).withColumn("idf", F.round("idf", 6))


@query(f"with {BM25} select qid, id, {STRIP(f'array_to_string((string_split(regexp_replace(text, {chr(39)}([.!?])' + chr(92) + f's+{chr(39)}, {chr(39)}' + chr(92) + f'1{chr(39)} || chr(1), {chr(39)}g{chr(39)}), chr(1)))[1:2], chr(32))')} answer from bm25 join documents on id = doc_id where rank = 1")
def skeleton_answer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    best = lexical.bm25(asked(spark, sf_dir), docs, 1)
    return best.join(docs, F.col("id") == F.col("doc_id")).select("qid", "id", X.first_sentences(F.col("text"), keep_blank=True).alias("answer"))


HASHED = (lambda name, source, key: f"""{name}_w as (select id, bucket, sum(sign * c) w from (select id, c, (('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2])::bigint % 384)::int bucket, case when ('0x' || h[9:10])::int % 2 = 0 then 1 else -1 end sign from (select {key} id, md5(t) h, count(*) c from (select {key}, unnest({TOK('text')}) t from {source}) group by all)) group by all having sum(sign * c) <> 0),
{name} as (select id, bucket, w / sqrt(sum(w * w) over (partition by id)) weight from {name}_w)""")


@query(f"with {HASHED('v', 'documents', 'doc_id')} select id, bucket, round(weight, 6) weight from v")
def hashing_embed(spark, sf_dir):
    return dense.hashing_embed(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 6))


@query("select vec_id, (i - 1)::int pos, round(e[i]::double * 3 / sqrt(list_sum(list_transform(e, lambda x: 9 * x::double * x::double))), 6) value from (select vec_id, embedding e, unnest(range(1, len(embedding) + 1)) i from embeddings)")
def normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", dense.normalise(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.posexplode("v").alias("pos", "value")).withColumn("value", F.round("value", 6))


@query("select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) rank from (select q.vec_id qid, d.vec_id id, round(list_inner_product(q.embedding::double[], d.embedding::double[]), 6) score from embeddings q, embeddings d where q.vec_id % 20 = 0)) where rank <= 10")
def dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dense.dense_topk(rows.filter("id % 20 = 0").withColumnRenamed("id", "qid"), rows, 10)


@query("select qid, id, score, rank from (select *, row_number() over (partition by qid order by score desc, id) rank from (select q.vec_id qid, d.vec_id id, round(list_inner_product(q.embedding::double[], d.embedding::double[]), 6) score from embeddings q, embeddings d where q.vec_id % 20 = 0)) where rank <= 10")
def stored_dense_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = VectorIndex(versions.VersionStore(spark, fresh_path(spark, "vectors")))
    index.write("v1", rows, 1)
    index.store.activate("v1")
    return index.search(rows.filter("id % 20 = 0").withColumnRenamed("id", "qid"), 10)


FUSED = f"""{BM25}, {HASHED('dv', 'documents', 'doc_id')}, qtext as (select item_id, {PREFIX} text from benchmark), {HASHED('qv', 'qtext', 'item_id')},
dense as (select *, row_number() over (partition by qid order by score desc, id) rank from (select q.id qid, d.id id, round(sum(q.weight * d.weight), 6) score from qv q join dv d using (bucket) group by all)),
lists as (select qid, id, rank, 0 l from bm25 where rank <= 30 union all select qid, id, rank, 1 from dense where rank <= 30),
rrf as (select qid, id, round(sum(1.0::double / (60.0::double + rank)), 9) score, min(rank) best, min(l * 1000 + rank) arrival from lists group by all),
fused as (select qid, id, score, row_number() over (partition by qid order by score desc, best, arrival) rank from rrf)"""


def fused_lists(spark, sf_dir, top_k=None) -> DataFrame:
    return pipelines.fused(asked(spark, sf_dir), table(spark, sf_dir, "documents"), top_k)


@query(f"with {FUSED} select qid, id, score, rank from fused")
def rrf_fuse(spark, sf_dir):
    return fused_lists(spark, sf_dir)


@query(f"with {FUSED} select qid, id, rank::int position, 'rrf' source, 'skipped_budget' status from fused where rank <= 10")
def hybrid_fallback(spark, sf_dir):
    return fusion.rerank(fused_lists(spark, sf_dir).withColumn("rerank_score", F.lit(0.0)), budget=0.0)


SCORED = f"""{FUSED}, cand as (select f.qid, f.id, f.rank, round(len(list_filter({CONTENT('q.query')}, lambda t: list_contains({TOK('d.text')}, t))) / greatest(len({CONTENT('q.query')}), 1), 6) rerank_score from fused f join qs q using (qid) join documents d on d.doc_id = f.id)"""


def candidates(spark, sf_dir) -> DataFrame:
    found = pipelines.with_texts(fused_lists(spark, sf_dir).join(asked(spark, sf_dir), "qid"), table(spark, sf_dir, "documents"))
    return pipelines.lexical_relevance(found).select("qid", "id", "rank", "rerank_score")


RERANKED = (lambda budget: f"""with {SCORED}, d as (select *, least(count(*) over (partition by qid), 20) depth from cand),
r as (select *, rank <= depth and 30.0 * least((floor((rank - 1) / 5) + 1) * 5, depth) < {budget} scored from d),
s as (select *, sum(scored::int) over (partition by qid) total from r)
select * from (select qid, id, (row_number() over (partition by qid order by scored desc, case when scored then rerank_score end desc nulls last, rank))::int position, case when scored then 'rerank' else 'rrf' end source, case when total = 0 then 'skipped_budget' when total < depth then 'partial' else 'full' end status from s) where position <= 10""")


@query(RERANKED("400.0"))
def rerank_budget(spark, sf_dir):
    return fusion.rerank(candidates(spark, sf_dir), cost=30.0, budget=400.0)


@query(RERANKED("1e18"))
def rerank_merge(spark, sf_dir):
    return fusion.rerank(candidates(spark, sf_dir))


@query(f"with {SCORED} select qid, id, (row_number() over (partition by qid order by rerank_score desc, rank))::int position, rerank_score from cand")
def rerank_standalone(spark, sf_dir):
    return fusion.by_relevance(candidates(spark, sf_dir))


GOLD = "gold as (select item_id qid, doc_id id from benchmark b join documents d on contains(d.text, b.text))"


def gold_pairs(spark, sf_dir) -> DataFrame:
    """Documents that hold a benchmark text. Its tokens but the first and last stand whole in such a document, so the longest of
    them finds candidates, whose texts are then compared. Items of two tokens or fewer are compared with all documents."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("want"))
    items = items.withColumn("words", X.tokenize(F.col("want"))).withColumn("inner", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))))
    items = items.withColumn("key", F.array_max(F.transform("inner", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))).w)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    tokens = docs.select("id", F.explode(F.array_distinct(X.tokenize(F.col("text")))).alias("key"))
    pairs = tokens.join(F.broadcast(items.filter("key is not null").select("qid", "key")), "key").select("id", "qid")
    found = pipelines.with_texts(pairs, table(spark, sf_dir, "documents")).join(F.broadcast(items.select("qid", "want")), "qid").filter(F.col("text").contains(F.col("want")))
    short = items.filter("key is null").select("qid", "want")
    whole = docs.join(F.broadcast(short), F.col("text").contains(F.col("want")))
    return found.select("qid", "id").union(whole.select("qid", "id")).distinct()


@query(f"with {BM25}, {GOLD}, b as (select qid, min(rank) r from bm25 semi join gold using (qid, id) where rank <= 10 group by qid) select count(*) queries, round(avg(coalesce((r = 1)::int, 0)), 4) p_at_1, round(avg(coalesce(1 / r, 0)), 4) mrr from (select distinct qid from gold) left join b using (qid)")
def eval_p1_mrr(spark, sf_dir):
    gold = gold_pairs(spark, sf_dir)
    return metrics.retrieval_quality(gold.select("qid").distinct(), lexical.bm25(asked(spark, sf_dir), table(spark, sf_dir, "documents"), 10), gold)


@query("select item_id qid, -1 - item_id id from benchmark where item_id % 3 = 0")
def gold_check(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    gold = items.select(F.col("item_id").alias("qid"), F.when(F.col("item_id") % 3 == 0, -1 - F.col("item_id")).otherwise(F.col("item_id")).alias("id"))
    return metrics.unknown_gold(gold, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("with s as (select source, avg(quality) q, avg(toxic) t from labels join documents using (doc_id) group by source), c as (select 'quality' metric, round(max(q), 4) cur, round(min(q), 4) base, true h from s union all select 'toxic', round(max(t), 4), round(min(t), 4), false from s) select metric, cur as current, base as baseline, round(cur - base, 4) delta, case when h then round(cur - base, 4) < 0 else round(cur - base, 4) > 0 end worse from c")
def eval_gate(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("source").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))
    long = lambda f: rows.agg(F.round(f("quality"), 4).alias("q"), F.round(f("toxic"), 4).alias("t")).selectExpr("stack(2, 'quality', q, true, 'toxic', t, false) as (metric, value, higher_is_better)")
    return metrics.gate(long(F.max), long(F.min))


# Grounding ----------------------------------------------------------------------------------------------------------------


def answers(spark, sf_dir) -> DataFrame:
    """Per conversation: its assistant texts as the answer; its other texts and those of every second assistant turn as context."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null")
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    answer = F.array_join(F.filter("t", lambda x: x.role == "assistant").text, " ")
    context = F.array_join(F.filter("t", lambda x: (x.role != "assistant") | (x.turn % 4 == 1)).text, " ")
    return whole.select("conv_id", answer.alias("answer"), context.alias("context"))


ANSWERS = "answers as (select conv_id, coalesce(string_agg(text, ' ' order by turn) filter (role = 'assistant'), '') answer, coalesce(string_agg(text, ' ' order by turn) filter (role <> 'assistant' or turn % 4 = 1), '') context from conversations where text is not null group by conv_id)"
SENTENCES = f"""{ANSWERS}, ctx as (select conv_id, {SENTS('answer')} s, {CONTENT('context')} cl, list_distinct({CONTENT('context')}) context, context ct from answers),
sent as (select conv_id, (i - 1)::int idx, s[i] sentence, len(s) total, context, cl, ct, {CONTENT('s[i]')} tokens from (select *, unnest(range(1, len(s) + 1)) i from ctx)),
cov as (select *, len(list_filter(tokens, lambda t: list_contains(context, t))) hit, len(tokens) n from sent)"""


def answer_sentences(spark, sf_dir, parts: bool = False) -> DataFrame:
    return grounding.sentences(answers(spark, sf_dir), "answer", "context", parts)


@query(f"with {SENTENCES} select conv_id, idx as index, round(case when n = 0 then 1 else hit / n end, 6) coverage, (case when n = 0 then 1 else hit / n end) >= 0.7 supported, case when n = 0 then null else round(hit / n, 6) end coverage_or_null from cov")
def coverage(spark, sf_dir):
    c = X.share_held(F.col("tokens"), F.col("missing"))
    return answer_sentences(spark, sf_dir).select("conv_id", "index", F.round(c, 6).alias("coverage"), (c >= 0.7).alias("supported"), F.when(F.size("tokens") > 0, F.round(c, 6)).alias("coverage_or_null"))


@query(f"with {SENTENCES} select conv_id, sum((hit / n < 0.7)::bigint)::bigint unsupported_sentences, count(*) sentences, sum(n - hit)::bigint unsupported_tokens, sum(n)::bigint tokens from cov where n > 0 group by conv_id")
def support_counts(spark, sf_dir):
    return grounding.support(answer_sentences(spark, sf_dir), "conv_id")


@query(f"with {SENTENCES}, s as (select conv_id, sum((hit / n < 0.7)::bigint) us, sum(n - hit) ut, sum(n) t from cov where n > 0 group by conv_id) select round(avg((us > 0)::int), 4) hallucination_rate, round(sum(ut) / sum(t), 4) unsupported_token_rate from s")
def hallucination(spark, sf_dir):
    rows = grounding.support(answer_sentences(spark, sf_dir), "conv_id")
    return rows.agg(F.round(F.avg((F.col("unsupported_sentences") > 0).cast("int")), 4).alias("hallucination_rate"), F.round(F.sum("unsupported_tokens") / F.sum("tokens"), 4).alias("unsupported_token_rate"))


def cited_answers(spark, sf_dir) -> DataFrame:
    """Answers whose sentences carry made markers: sentence i of conversation c cites (i + c) mod 7 unless that is 6. Chunks are
    whole turns, as many as a prompt takes."""
    rows = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    chunks = grounding.context_cut(F.col("t.text"))
    s = X.split_sentences(F.array_join(F.filter("t", lambda x: x.role == "assistant").text, " "))
    mark = F.transform(s, lambda x, i: F.when((i + F.col("conv_id")) % 7 == 6, x).otherwise(F.concat(F.lit("["), ((i + F.col("conv_id")) % 7).cast("string"), F.lit("] "), x)))
    return rows.select("conv_id", F.array_join(mark, " ").alias("answer"), chunks.alias("chunks"))


CITED = f"""raw as (select conv_id, list(text order by turn)[1:5] chunks, {SENTS("coalesce(string_agg(text, ' ' order by turn) filter (role = 'assistant'), '')")} s from conversations where text is not null group by conv_id),
cited as (select conv_id, chunks, array_to_string(list_transform(s, lambda x, i: case when (i - 1 + conv_id) % 7 = 6 then x else '[' || ((i - 1 + conv_id) % 7) || '] ' || x end), ' ') answer from raw),
cs as (select conv_id, list_transform(chunks, lambda c: list_distinct({CONTENT('c')})) chunks, {SENTS('answer')} s from cited),
ss as (select conv_id, chunks, (i - 1)::int idx, s[i] sentence, list_transform(regexp_extract_all(s[i], '\\[(\\d+)\\]', 1), lambda m: m::int) cited, {CONTENT("regexp_replace(s[i], chr(92) || '[(' || chr(92) || 'd+)' || chr(92) || ']', '', 'g')")} tokens from (select *, unnest(range(1, len(s) + 1)) i from cs)),
sv as (select *, len(list_filter(cited, lambda m: m < 1 or m > len(chunks))) > 0 bad, case when len(cited) > 0 then flatten(list_transform(list_filter(cited, lambda m: m >= 1 and m <= len(chunks)), lambda m: chunks[m])) else flatten(chunks) end pool from ss where len(tokens) > 0),
sw as (select *, len(list_filter(tokens, lambda t: list_contains(pool, t))) / len(tokens) c from sv),
verd as (select conv_id, idx, sentence, cited, case when bad then 'invalid_citation' when c < 0.7 then 'unsupported' when len(cited) > 0 then 'supported' else 'supported_uncited' end verdict, case when bad then 0 else round(c, 4) end coverage from sw)"""


@query(f"with {CITED} select conv_id, idx as index, array_to_string(cited, ',') cited, verdict, coverage::double coverage from verd")
def citation_verdicts(spark, sf_dir):
    rows = grounding.verdicts(cited_answers(spark, sf_dir), "answer", "chunks")
    return rows.select("conv_id", "index", F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"), "verdict", "coverage")


@query(f"""with {CITED}, u as (select conv_id, m, min(idx * 1000 + p) o from (select conv_id, idx, unnest(cited) m, unnest(range(1, len(cited) + 1)) p from verd where verdict like 'supported%') group by all), cc as (select conv_id, string_agg(m::varchar, ',' order by o) citations from u group by conv_id)
select conv_id, coalesce(string_agg(sentence, ' ' order by idx) filter (verdict like 'supported%'), '') answer, coalesce(any_value(citations), '') citations, count(*) filter (verdict like 'supported%') kept, count(*) filter (verdict not like 'supported%') rejected from verd left join cc using (conv_id) group by conv_id""")
def answer_assembly(spark, sf_dir):
    return grounding.assemble(grounding.verdicts(cited_answers(spark, sf_dir), "answer", "chunks"), "conv_id")


@query(f"with {ANSWERS} select conv_id, len({CONTENT('answer')}) > 0 and len(list_intersect({CONTENT('answer')}, {CONTENT('context')})) = 0 weak from answers")
def low_signal(spark, sf_dir):
    return answers(spark, sf_dir).select("conv_id", grounding.low_signal(F.col("answer"), F.array("context")).alias("weak"))


OUTCOMES = ["ok", "quota_429", "throttled", "timeout", "server_error", "malformed", "config", "auth", "none"]


@query("""with o as (select event_id, ['ok','quota_429','throttled','timeout','server_error','malformed','config','auth','none'][event_id % 9 + 1] p, ['ok','quota_429','throttled','timeout','server_error','malformed','config','auth','none'][(event_id // 9) % 9 + 1] f, event_id % 7 retrieved, event_id % 11 = 0 weak, event_id % 3 kept, event_id % 2 rejected, event_id % 13 = 0 idk from events),
s as (select *, case when retrieved = 0 then 'no_results' when weak then 'ok_no_answer' when p = 'none' then 'degraded_no_llm' when p <> 'ok' and f <> 'ok' then case p when 'none' then 'degraded_no_llm' when 'quota_429' then 'degraded_quota' when 'throttled' then 'degraded_quota_throttled' when 'timeout' then 'degraded_timeout' when 'server_error' then 'degraded_llm_error' when 'malformed' then 'degraded_llm_malformed' when 'config' then 'degraded_llm_config' when 'auth' then 'degraded_llm_auth' end when idk then 'ok_no_answer' when kept = 0 then 'degraded_citation_rejected' when rejected > 0 then 'ok_partial_rejected' else 'ok' end status from o)
select event_id, status, status in ('ok', 'ok_partial_rejected', 'ok_no_answer', 'no_results', 'degraded_no_llm') cacheable from s""")
def status_machine(spark, sf_dir):
    e = F.col("event_id")
    names = F.array(*map(F.lit, OUTCOMES))
    status = grounding.answer_status(e % 7, e % 11 == 0, F.element_at(names, (e % 9 + 1).cast("int")), F.element_at(names, (F.floor(e / 9) % 9 + 1).cast("int")), F.when(e % 13 == 0, "I don't know.").otherwise("x"), e % 3, e % 2)
    return table(spark, sf_dir, "events").select("event_id", status.alias("status"), status.isin(*grounding.CACHEABLE).alias("cacheable"))


PAIRS = (lambda a: f"(case when len({a}) < 2 then [] else list_transform(range(1, len({a})), lambda k: {a}[k] || ' ' || {a}[k + 1]) end)")
SHARE = (lambda items, pool: f"(case when len({items}) = 0 then 1.0 else len(list_filter({items}, lambda z: list_contains({pool}, z))) / len({items}) end)")
RUNS = "list_max(list_transform(string_split(array_to_string(list_transform(tokens, lambda t: case when list_contains(context, t) then '1' else '0' end), ''), '0'), lambda r: length(r)))"
FEATURED = f"""{SENTENCES}, fe as (select *, {PAIRS('tokens')} bg, list_distinct({PAIRS('cl')}) cbg, regexp_extract_all(sentence, '{X.NUMERAL}') nums, regexp_extract_all(ct, '{X.NUMERAL}') cnums, list_transform(regexp_extract_all(sentence, '{X.CAPITALISED}', 1), lambda c: lower(c)) caps, list_filter(tokens, lambda t: length(t) >= 8) lng from cov),
feats as (select conv_id, idx, case when n = 0 then 1.0 else hit / n end coverage, case when n = 0 then 1.0 else {SHARE('bg', 'cbg')} end bigram_coverage, case when n = 0 then 1.0 else {RUNS} / n end longest_shared_run, case when n = 0 then 1.0 else {SHARE('nums', 'cnums')} end numeral_coverage, case when n = 0 or len(nums) = 0 then 0.0 else 1.0 end has_numeral, case when n = 0 then 1.0 else {SHARE('lng', 'context')} end long_token_coverage, case when n = 0 then 1.0 else {SHARE('caps', 'context')} end capitalised_coverage, least((n - hit) / 10, 1.0) missing_count, least(n / 40, 1.0) token_count, idx / greatest(total, 1) as position, (idx = 0)::int::double is_first, least(len(context) / 1000, 1.0) context_size from fe)"""
ROUNDED = ", ".join(f"round({f}::double, 6) {f}" if f != "position" else 'round("position"::double, 6) "position"' for f in grounding.FEATURES)


def feature_rows(spark, sf_dir) -> DataFrame:
    return grounding.features(answer_sentences(spark, sf_dir, parts=True))


@query(f"with {FEATURED} select conv_id, idx as index, {ROUNDED} from feats")
def features_12(spark, sf_dir):
    return feature_rows(spark, sf_dir).select("conv_id", "index", *(F.round(f, 6).alias(f) for f in grounding.FEATURES))


#: A small model of our own, for the scoring query.
MODEL = {"mean": [0.5] * 12, "std": [0.25] * 11 + [0.0], "coefficients": [-1.5, -0.8, -0.6, -0.4, 0.2, -0.5, -0.3, 0.9, 0.1, 0.15, -0.1, 0.05], "intercept": -0.25}
LOGIT = " + ".join(["-0.25"] + [f'("{f}" - 0.5) / {s or 1.0} * ({w})' for f, s, w in zip(grounding.FEATURES, MODEL["std"], MODEL["coefficients"])])


@query(f"with {FEATURED} select conv_id, idx as index, round(1 / (1 + exp(-greatest(least({LOGIT}, 60), -60))), 6) score from feats")
def logistic_score(spark, sf_dir):
    return feature_rows(spark, sf_dir).select("conv_id", "index", F.round(grounding.logistic(MODEL), 6).alias("score"))


CONFUSION_OF = "count(*) filter (predicted and a) tp, count(*) filter (predicted and not a) fp, count(*) filter (not predicted and a) fn, count(*) filter (not predicted and not a) tn"
RATES_OF = "tp, fp, fn, tn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 4) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 4) recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 4) f1, round((tp + tn) / (tp + fp + fn + tn), 4) accuracy"
CONFUSION, RATES = CONFUSION_OF, RATES_OF

# A sentence counts as unsupported if less than 0.6 of it is in the context, but for every tenth, where the label is turned.
LEARNED = f"""{FEATURED}, ex as (select *, ((coverage < 0.6) <> ((idx + conv_id) % 10 = 0))::int label from feats),
ws as (select count(*) n, sum(label) p, (count(*) - sum(label)) / sum(label) ratio from ex),
wt as (select n, p, ratio / ((p * ratio + n - p) / n) w1, 1 / ((p * ratio + n - p) / n) w0 from ws)"""


def examples(spark, sf_dir) -> DataFrame:
    turned = (F.col("index") + F.col("conv_id")) % 10 == 0
    return feature_rows(spark, sf_dir).withColumn("label", ((F.col("coverage") < 0.6) != turned).cast("int"))


@query("with f as (select conv_id, list(['k' || turn, text] order by turn) p, list(text order by turn) filter (role <> 'assistant') d from conversations where text is not null group by conv_id), e as (select conv_id, p, d, unnest(range(1, len(p) + 1)) i from f) select conv_id, (i - 1)::int as index, len(p)::int total, p[i][1] as key, sha256(p[i][2]) sentence, sha256(coalesce(array_to_string(d, chr(10) || chr(10)), '')) context, (p[i][1] in ('k1', 'k3'))::int label from e")
def training_explode(spark, sf_dir):
    pair = F.array(F.concat(F.lit("k"), F.col("turn").cast("string")), F.col("text"))
    rows = table(spark, sf_dir, "conversations").filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", pair.alias("pair"), F.when(F.col("role") != "assistant", F.col("text")).alias("doc")))).alias("t"))
    odd = F.array(F.array(F.lit("alone")))  # an item without a text
    rows = rows.select("conv_id", F.concat(F.col("t.pair"), odd).alias("response_sentences"), F.filter("t.doc", lambda x: x.isNotNull()).alias("documents"), F.array(F.lit("k1"), F.lit("k3")).alias("unsupported_response_sentence_keys"))
    out = learning.labelled_sentences(rows)
    return out.select("conv_id", "index", "total", "key", F.sha2("sentence", 256).alias("sentence"), F.sha2("context", 256).alias("context"), "label")


@query(f"with {FEATURED} " + " union all ".join(f"""select '{f}' feature, round(avg("{f}"), 9) mean, round(case when stddev_pop("{f}") = 0 then 1 else stddev_pop("{f}") end, 9) std from feats""" for f in grounding.FEATURES))
def feature_scales(spark, sf_dir):
    return learning.scales(feature_rows(spark, sf_dir), grounding.FEATURES).select("feature", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(f"with {LEARNED} select label, count(*) n, round(any_value(case label when 1 then w1 else w0 end), 9) weight from ex, wt group by label")
def class_weights(spark, sf_dir):
    return learning.class_weights(examples(spark, sf_dir)).withColumn("weight", F.round("weight", 9))


Z = {f: f'("{f}" - 0.5) / {s or 1.0}' for f, s in zip(grounding.FEATURES, MODEL["std"])}
GRADIENT = " union all ".join(f"""select '{f}' feature, round(avg({z} * e) + 50 * ({w}) / count(*), 9) gradient from er""" for (f, z), w in zip(Z.items(), MODEL["coefficients"]))


@query(f"with {LEARNED}, er as (select *, (1 / (1 + exp(-({LOGIT}))) - label) * case label when 1 then w1 else w0 end e from ex, wt) {GRADIENT} union all select 'intercept', round(avg(e), 9) from er")
def training_gradient(spark, sf_dir):
    rows = examples(spark, sf_dir)
    weighted = rows.join(F.broadcast(learning.class_weights(rows).select("label", "weight")), "label")
    return learning.gradient(weighted, MODEL, grounding.FEATURES, 50.0).select("feature", F.round("gradient", 9).alias("gradient"))


@query()
def learned_grounding(spark, sf_dir):
    """Trains on the labelled sentences and scores them all."""
    rows = examples(spark, sf_dir)
    model = learning.train(rows, grounding.FEATURES)
    return rows.select("conv_id", "index", "label", F.round(grounding.logistic(model), 6).alias("score"))


@query(f"with {LEARNED}, r as (select label, rank() over (order by 1 - coverage) + (count(*) over (partition by coverage) - 1) / 2 rk from ex), a as (select sum(label)::bigint p, sum(1 - label)::bigint n, sum(case when label = 1 then rk else 0 end) s from r) select p positives, n negatives, round((s - p * (p + 1) / 2) / nullif(p * n, 0), 4) auc from a")
def training_auc(spark, sf_dir):
    return metrics.auc(examples(spark, sf_dir).select((1 - F.col("coverage")).alias("score"), F.col("label").alias("actual")))


@query(f"with {LEARNED} " + " union all ".join(f"""select label, '{f}' feature, round(avg("{f}"), 6) mean from ex group by label""" for f in grounding.FEATURES))
def feature_class_means(spark, sf_dir):
    one = examples(spark, sf_dir).groupBy("label").agg(*(F.round(F.avg(f), 6).alias(f) for f in grounding.FEATURES))
    return one.unpivot("label", grounding.FEATURES, "feature", "mean")


METHODS = f"""{LEARNED}, s as (select conv_id, idx, case when n > 0 then hit / n end c from cov),
x as (select answers.conv_id, min(c) least, max(c) is not null as has_any, conv_id % 3 = 0 as actual, case when conv_id % 4 = 0 then '?' else 'd' || conv_id % 4 end dom from answers left join s using (conv_id) group by conv_id),
mm as (select 'lexical' as method, dom, coalesce(least, 1) < 0.7 predicted, 1 - coalesce(least, 1) score, actual from x union all select 'learned', dom, least < 0.5, 1 - least * least, actual from x where has_any union all select 'judge', dom, null, 1 - (conv_id % 10) / 10, actual from x where conv_id % 10 <> 9),
mb as (select method, unnest([dom, 'ALL']) as domain, predicted, score, actual from mm),
mr as (select *, rank() over (partition by method, domain order by score) + (count(*) over (partition by method, domain, score) - 1) / 2 rk from mb),
ma as (select method, domain, count(*) examples, round((sum(case when actual then rk else 0 end) - sum(actual::int) * (sum(actual::int) + 1) / 2) / nullif(sum(actual::int) * sum((not actual)::int), 0), 4) auc from mr group by all),
mq as (select method, domain, {CONFUSION_OF} from (select *, actual a from mb where predicted is not null) group by all),
mc as (select distinct method, domain, score cut from mb union select distinct method, domain, -1.0 from mb),
mf as (select c.method, c.domain, cut, round(case when count(*) filter (score > cut) + sum(actual::int) = 0 then 0 else 2 * count(*) filter (score > cut and actual) / (count(*) filter (score > cut) + sum(actual::int)) end, 4) f from mc c join mb b on c.method = b.method and c.domain = b.domain group by all)
select method, domain, examples, auc, round(cut, 4)::double threshold, f best_f1, precision, recall, f1 from ma join (select *, row_number() over (partition by method, domain order by f desc, cut) i from mf) using (method, domain) left join (select method, domain, {RATES_OF} from mq) using (method, domain) where i = 1"""


@query(f"with {METHODS}")
def method_comparison(spark, sf_dir):
    c = F.col("conv_id")
    coverage_or_null = F.when(F.size("tokens") > 0, X.share_held(F.col("tokens"), F.col("missing")))
    judged = answer_sentences(spark, sf_dir).select("conv_id", coverage_or_null.alias("coverage"))
    rows = answers(spark, sf_dir).select("conv_id").join(judged, "conv_id", "left").withColumns({"learned": 1 - F.col("coverage") * F.col("coverage"), "learned_flag": F.col("coverage") < 0.5})
    rows = rows.select(c.alias("example"), F.when(c % 4 != 0, F.concat(F.lit("d"), (c % 4).cast("string"))).alias("domain"), (c % 3 != 0).alias("adherence"), "coverage", "learned", "learned_flag")
    given = answers(spark, sf_dir).select(c.alias("example"), F.lit("judge").alias("method"), F.when(c % 10 != 9, (c % 10) / 10).alias("value"))
    return metrics.by_method(metrics.methods(rows, given))


# Metrics ------------------------------------------------------------------------------------------------------------------

LABELLED = f"lab as (select lang, source, toxic actual, quality, n_chars, len({TOK('text')}) n_tokens, round(length(text) % 97 / 97.0, 3) score, length(text) % 5 >= 3 predicted from documents join labels using (doc_id))"


def labelled(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")  # counts of the texts rather than texts go through the join
    rows = docs.select("doc_id", "lang", "source", "n_chars", F.size(X.tokenize(F.col("text"))).alias("n_tokens"), F.length("text").alias("size")).join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("lang", "source", F.col("toxic").alias("actual"), "quality", "n_chars", "n_tokens", F.round(F.col("size") % 97 / F.lit(97.0), 3).alias("score"), (F.col("size") % 5 >= 3).alias("predicted"))


@query(f"with {LABELLED}, r as (select lang, actual, rank() over (partition by lang order by score) + (count(*) over (partition by lang, score) - 1) / 2 rk from lab), a as (select lang, sum(actual)::bigint p, sum(1 - actual)::bigint n, sum(case when actual = 1 then rk else 0 end) s from r group by lang) select lang, p positives, n negatives, round((s - p * (p + 1) / 2) / nullif(p * n, 0), 4) auc from a")
def auc(spark, sf_dir):
    return metrics.auc(labelled(spark, sf_dir), "lang")


@query(f"with {LABELLED}, c as (select source, {CONFUSION} from (select *, actual = 1 a from lab) group by source) select source, {RATES} from c")
def confusion(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir).withColumn("actual", F.col("actual") == 1), "source")


@query(f"with {LABELLED}, cuts as (select distinct lang, score cut from lab union select distinct lang, -1.0 from lab), s as (select c.lang, cut, sum(actual) filter (score > cut) tp, count(*) filter (score > cut) flagged, sum(actual) al from cuts c join lab l on c.lang = l.lang group by c.lang, cut), f as (select lang, cut, round(case when flagged + al = 0 then 0 else 2 * coalesce(tp, 0) / (flagged + al) end, 4) f1 from s) select lang, round(cut, 4)::double threshold, f1 from (select *, row_number() over (partition by lang order by f1 desc, cut) i from f) where i = 1")
def best_f1(spark, sf_dir):
    return metrics.best_f1(labelled(spark, sf_dir), "lang")


@query(f"with {LABELLED}, cuts as (select distinct round(score, 3) cut from lab), s as (select cut, sum(actual) filter (round(score, 3) >= cut) tp, count(*) filter (round(score, 3) >= cut) flagged, sum(actual) al from cuts, lab group by cut), f as (select cut, round(case when flagged + al = 0 then 0 else 2 * coalesce(tp, 0) / (flagged + al) end, 4) f1 from s) select round(cut, 4)::double threshold, f1 from (select *, row_number() over (order by f1 desc, cut) i from f) where i = 1")
def threshold_pick(spark, sf_dir):
    return metrics.best_f1(labelled(spark, sf_dir), digits=3, inclusive=True)


@query(f"with {LABELLED} select coalesce(lang, 'ALL') as domain, count(*) n, sum(actual)::bigint positives, round(avg(score), 6) mean_score from lab group by grouping sets ((lang), ())")
def domain_rollup(spark, sf_dir):
    return labelled(spark, sf_dir).rollup("lang").agg(F.count("*").alias("n"), F.sum("actual").alias("positives"), F.round(F.avg("score"), 6).alias("mean_score")).select(F.coalesce("lang", F.lit("ALL")).alias("domain"), "n", "positives", "mean_score")


@query(f"with {SENTENCES}, c as (select conv_id, min(hit / n) m, bool_or(hit / n < 0.7) fl from cov where n > 0 group by conv_id) select conv_id, coalesce(fl, false) flagged, round(case when m is null then 0 else 1 - m end, 6) score from answers left join c using (conv_id)")
def example_rollup(spark, sf_dir):
    rows = answer_sentences(spark, sf_dir).filter(F.size("tokens") > 0).withColumn("c", X.share_held(F.col("tokens"), F.col("missing")))
    judged = rows.groupBy("conv_id").agg(F.min("c").alias("m"), F.bool_or(F.col("c") < 0.7).alias("f"))
    return answers(spark, sf_dir).select("conv_id").join(judged, "conv_id", "left").select("conv_id", F.coalesce("f", F.lit(False)).alias("flagged"), F.round(F.when(F.col("m").isNull(), 0.0).otherwise(1 - F.col("m")), 6).alias("score"))


@query("select event_type, v p95 from (select event_type, value v, row_number() over (partition by event_type order by value) i, count(*) over (partition by event_type) n from events) where i = greatest(1, round_even(n * 95 / 100, 0)::int)")
def percentile_rank(spark, sf_dir):
    return metrics.percentile_rank(table(spark, sf_dir, "events"), "value", 95, "event_type")


@query("select user_id, round(median(value), 6) median_value from events group by user_id")
def median_repeats(spark, sf_dir):
    return quantiles(table(spark, sf_dir, "events"), "value", {"m": 0.5}, "user_id").select("user_id", F.round("m", 6).alias("median_value"))


STATUSES = ["click", "error", "purchase", "signup", "view"]


@query(f"""select user_id % 10 as level, count(*) requests, {", ".join(f"count(*) filter (event_type = '{t}') n_{t}" for t in STATUSES)}, round(avg((event_type = 'view')::int), 6) shed_rate,
round(count(*) * 1000000 / nullif(max(epoch_us(ts)) - min(epoch_us(ts)), 0), 9) rps, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(avg(value), 6) mean from events group by 1""")
def load_summary(spark, sf_dir):
    rows = events(spark, sf_dir).select((F.col("user_id") % 10).alias("level"), F.col("event_type").alias("status"), "us", "value")
    return metrics.load_summary(rows, "level", STATUSES, "view")


@query("select source, lang, count(*) n, quantile_disc(n_chars, 0.5) p50, quantile_disc(n_chars, 0.99) p99 from documents where n_chars is not null group by all")
def length_ranks(spark, sf_dir):
    place = lambda q: F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)) - 1
    return at_ranks(table(spark, sf_dir, "documents"), "n_chars", {"p50": place(0.5), "p99": place(0.99)}, "source", "lang")


# Descriptive statistics ------------------------------------------------------------------------------------------------------


@query("select count(*) n, count(*) filter (text is null) null_texts, count(*) - count(distinct text) duplicate_texts, round(count(lang) / count(*), 6) lang_complete from documents")
def shape_nulls_dupes(spark, sf_dir):
    digest = F.sha2("text", 256)  # digests rather than texts go through the shuffle
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("null_texts"), (F.count("*") - F.countDistinct(digest)).alias("duplicate_texts"), F.round(F.count("lang") / F.count("*"), 6).alias("lang_complete"))


@query("with c as (select toxic, count(*) n from labels group by toxic) select toxic, n, round(n / sum(n) over (), 6) share, round(max(n) over () / min(n) over (), 6) imbalance from c")
def value_counts(spark, sf_dir):
    from pyspark.sql import Window as W

    every = W.partitionBy()
    n = F.col("n")
    return table(spark, sf_dir, "labels").groupBy("toxic").agg(F.count("*").alias("n")).select("toxic", "n", F.round(n / F.sum(n).over(every), 6).alias("share"), F.round(F.max(n).over(every) / F.min(n).over(every), 6).alias("imbalance"))


DESCRIBE = (lambda c: f"select '{c}' column_name, count({c})::double as count, round(avg({c}), 6) mean, round(stddev_samp({c}), 6) std, min({c})::double as min, quantile_cont({c}::double, 0.25) q25, quantile_cont({c}::double, 0.5) q50, quantile_cont({c}::double, 0.75) q75, max({c})::double as max from lab")


@query(f"with {LABELLED} {DESCRIBE('n_chars')} union all {DESCRIBE('n_tokens')}")
def describe(spark, sf_dir):
    return metrics.describe(labelled(spark, sf_dir), "n_chars", "n_tokens")


# The poster's statistics, over the learning examples (a row a sentence: the features and the label) and over documents.
LEARNED_COLUMNS = [*grounding.FEATURES, "label"]
HELD = (lambda c, of: f"select '{c}' column_name, count(\"{c}\") present, count(*) - count(\"{c}\") missing, round(100 * count(\"{c}\") / count(*), 6) as percent from {of}")
DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
BOXED = (lambda name, by: f"""select {by}, q25, q50, q75, q25 - 1.5 * (q75 - q25) a, q75 + 1.5 * (q75 - q25) b from (select {by}, quantile_cont(v, 0.25) q25, quantile_cont(v, 0.5) q50, quantile_cont(v, 0.75) q75 from {name} group by {by})""")
BOXES = (lambda name, by: f"""select {by}, count(*) n, round(least(min(v) filter (v between a and b), q25), 6) low, round(q25, 6) q25, round(q50, 6) q50, round(q75, 6) q75, round(greatest(max(v) filter (v between a and b), q75), 6) high, count(*) filter (v not between a and b) outside from {name} join ({BOXED(name, by)}) using ({by}) group by {by}, q25, q50, q75""")


@query(f"with {LEARNED} " + " union all ".join(HELD(c, "ex") + "" for c in LEARNED_COLUMNS))
def feature_completeness(spark, sf_dir):
    return metrics.completeness(examples(spark, sf_dir).select(*LEARNED_COLUMNS)).drop("type")


@query(" union all ".join(f"select *, '{kind}' as type from ({HELD(c, 'documents')})" for c, kind in DOCUMENT_TYPES.items()))
def document_completeness(spark, sf_dir):
    return metrics.completeness(table(spark, sf_dir, "documents").select(*DOCUMENT_TYPES))


@query("with d as (select (select count(*) from documents) as rows, (select count(*) from documents) - (select count(*) from (select distinct text, lang, source, n_chars from documents)) duplicated) select type, columns, missing, rows, duplicated, 4 all_columns from d, (select 'string' as type, 3 as columns, (count(*) * 3 - count(text) - count(lang) - count(source)) missing from documents union all select 'bigint', 1, count(*) - count(n_chars) from documents)")
def document_shape(spark, sf_dir):
    return metrics.table_shape(table(spark, sf_dir, "documents").drop("doc_id"))


@query(f"with {LEARNED}, e as (select min(coverage) a, max(coverage) b from ex), b as (select least(floor((coverage - a) / (b - a) * 28), 27)::bigint bin, count(*) n from ex, e group by 1) select i as bin, round(a + (b - a) * i / 28, 6) low, round(a + (b - a) * (i + 1) / 28, 6) high, coalesce(n, 0) n from (select unnest(range(28)) i) left join b on bin = i, e")
def coverage_histogram(spark, sf_dir):
    return metrics.histogram(examples(spark, sf_dir), "coverage")


@query(f"with {LEARNED}, long as (" + " union all ".join(f"""select '{c}' feature, "{c}"::double v from ex""" for c in grounding.FEATURES) + f") {BOXES('long', 'feature')}")
def feature_boxes(spark, sf_dir):
    stacked = ", ".join(f"'{c}', cast(`{c}` as double)" for c in grounding.FEATURES)
    return metrics.boxes(examples(spark, sf_dir).selectExpr(f"stack({len(grounding.FEATURES)}, {stacked}) as (feature, v)"), "v", "feature")


@query(f"with {LEARNED}, long as (select label, coverage::double v from ex) {BOXES('long', 'label')}")
def coverage_boxes(spark, sf_dir):
    return metrics.boxes(examples(spark, sf_dir), "coverage", "label")


CORR = (lambda a, b: f"select '{a}' a, '{b}' b, round(corr({a}::double, {b}::double), 6) r from lab")


@query(f"with {LABELLED} {CORR('n_chars', 'n_tokens')} union all {CORR('n_chars', 'quality')} union all {CORR('n_chars', 'actual')} union all {CORR('n_tokens', 'quality')} union all {CORR('n_tokens', 'actual')} union all {CORR('quality', 'actual')}")
def corr_pairs(spark, sf_dir):
    return metrics.correlations(labelled(spark, sf_dir), "n_chars", "n_tokens", "quality", "actual")


@query(f"with {LABELLED} select a, b, r from ({CORR('n_chars', 'n_tokens')} union all {CORR('n_chars', 'actual')} union all {CORR('n_tokens', 'actual')}) where abs(r) > 0.6")
def corr_strong(spark, sf_dir):
    return metrics.correlations(labelled(spark, sf_dir), "n_chars", "n_tokens", "actual").filter("abs(r) > 0.6")


@query(f"with {LABELLED} select lang, count(*) n, sum(actual)::bigint positives, round(avg(actual), 6) rate, round(avg(n_tokens), 6) mean_tokens from lab group by lang")
def group_domain(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.sum("actual").alias("positives"), F.round(F.avg("actual"), 6).alias("rate"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"))


@query(f"with {LABELLED}, g as (select lang, sum(actual)::bigint p from lab group by lang) select arg_max(lang, struct_pack(p := p, l := lang)) lang, round(max(p) / sum(p), 6) share from g")
def argmax_share(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("lang").agg(F.sum("actual").alias("p")).agg(F.max_by("lang", F.struct("p", "lang")).alias("lang"), F.round(F.max("p") / F.sum("p"), 6).alias("share"))


@query(f"with {LABELLED} select count(*) filter (predicted) flagged, round(avg(actual) filter (predicted), 6) as precision, round(avg((not predicted)::int) filter (actual = 1), 6) missed from lab")
def rule_audit(spark, sf_dir):
    return labelled(spark, sf_dir).agg(F.count_if("predicted").alias("flagged"), F.round(F.avg(F.when(F.col("predicted"), F.col("actual"))), 6).alias("precision"), F.round(F.avg(F.when(F.col("actual") == 1, (~F.col("predicted")).cast("int"))), 6).alias("missed"))


@query(f"with {LABELLED}, b as (select actual, least(floor(score * 20), 19)::bigint bin from lab) select actual, bin, count(*) n, round(count(*) * 20 / sum(count(*)) over (partition by actual), 6) density from b group by actual, bin")
def histogram(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = labelled(spark, sf_dir).groupBy("actual", F.least(F.floor(F.col("score") * 20), F.lit(19)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return rows.withColumn("density", F.round(F.col("n") * 20 / F.sum("n").over(W.partitionBy("actual")), 6))


@query(f"with {LABELLED} select actual, round(avg(n_chars), 6) mean_chars, round(avg(n_tokens), 6) mean_tokens, round(stddev_pop(n_tokens), 6) std_tokens from lab group by actual")
def class_means(spark, sf_dir):
    return labelled(spark, sf_dir).groupBy("actual").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.avg("n_tokens"), 6).alias("mean_tokens"), F.round(F.stddev_pop("n_tokens"), 6).alias("std_tokens"))


# State and time series ---------------------------------------------------------------------------------------------------------

HOUR, DAY = 3_600_000_000, 86_400_000_000


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


ANCHORED = (lambda window: f"""with recursive e as (select event_id, user_id, epoch_us(ts) us, row_number() over (partition by user_id order by ts, event_id) rn from events),
r as (select event_id, user_id, rn, us, us begin_us, 1::bigint cnt from e where rn = 1 union all
  select e.event_id, e.user_id, e.rn, e.us, case when e.us - r.begin_us >= {window} then e.us else r.begin_us end, case when e.us - r.begin_us >= {window} then 1 else r.cnt + 1 end from r join e on e.user_id = r.user_id and e.rn = r.rn + 1)""")


@query(f"{ANCHORED(6 * HOUR)} select event_id, cnt as count, cnt <= 2 allowed, greatest(2 - cnt, 0) remaining, case when cnt <= 2 then 0 else begin_us + {6 * HOUR}::bigint - us end retry_us from r")
def rate_limit(spark, sf_dir):
    return state.rate_limit(events(spark, sf_dir), 2, 6 * HOUR)


@query(f"{ANCHORED(12 * HOUR)} select event_id, cnt > 1 hit from r")
def ttl_cache(spark, sf_dir):
    return state.ttl_cache(events(spark, sf_dir).withColumn("key", F.col("user_id")).withColumn("cacheable", F.lit(True)), 12 * HOUR)


@query("""with recursive e as (select event_id, user_id, value, row_number() over (partition by user_id order by ts, event_id) rn from events),
r as (select event_id, user_id, rn, value ew from e where rn = 1 union all select e.event_id, e.user_id, e.rn, 0.3::double * e.value + 0.7::double * r.ew from r join e on e.user_id = r.user_id and e.rn = r.rn + 1) select event_id, round(ew, 4) ewma from r""")
def ewma(spark, sf_dir):
    return state.ewma(events(spark, sf_dir), 0.3).withColumn("ewma", F.round("ewma", 4))


@query("select event_id, user_id, (row_number() over w)::int used, row_number() over w <= 3 allowed from events window w as (partition by user_id, epoch_us(ts) // 86400000000 order by ts, event_id)")
def daily_quota(spark, sf_dir):
    return state.daily_quota(events(spark, sf_dir), 3)


UNTIL = "max(case when rejected then us + coalesce(retry_us, 60000000) end) over (partition by {} order by us, event_id rows between unbounded preceding and 1 preceding) until".format


@query(f"""with e as (select event_id, user_id % 3 client, ts, epoch_us(ts) us, event_id % 10 = 0 rejected, case when event_id % 20 = 0 then 1800000000 end retry_us from events),
m as (select *, {UNTIL('client')}, ((ts at time zone 'UTC') at time zone 'America/Los_Angeles')::date d from e),
c as (select *, coalesce(until > us, false) cooling from m),
n as (select *, row_number() over (partition by client, cooling, us // 60000000 order by us, event_id) k from c),
u as (select *, sum((not cooling and k <= 1)::int) over (partition by client, d order by us, event_id) used from n),
r as (select *, case when cooling then 'cooldown' when k > 1 then 'rpm_exhausted' when used > 45 then 'rpd_exhausted' else 'ok' end reason from u)
select event_id, reason, case when reason in ('cooldown', 'rpm_exhausted') then 0 else 1 - k end::int remaining_rpm, case reason when 'cooldown' then 0 when 'rpm_exhausted' then 45 when 'rpd_exhausted' then 0 else 45 - used end::bigint remaining_rpd,
  case reason when 'cooldown' then until - us when 'rpm_exhausted' then 60000000 - us % 60000000 when 'rpd_exhausted' then epoch_us((d + 1)::timestamp at time zone 'America/Los_Angeles') - us else 0 end::bigint retry_us, reason in ('ok', 'rpd_exhausted') and used >= 36 alert from r""")
def quota_guard(spark, sf_dir):
    e = F.col("event_id")
    rows = events(spark, sf_dir).withColumns({"client": F.col("user_id") % 3, "rejected": e % 10 == 0, "retry_us": F.when(e % 20 == 0, F.lit(HOUR // 2))})
    return state.quota_guard(state.cooldown(rows, key="client"), rpm=2, rpd=50, key="client")


@query(f"""with e as (select event_id, user_id, epoch_us(ts) us, event_type = 'error' or event_id % 17 = 0 rejected, case when event_id % 2 = 0 then 7200000000 end retry_us from events),
u as (select *, {UNTIL('user_id')} from e)
select event_id, coalesce(until > us, false) cooling, greatest(coalesce(until - us, 0), 0) retry_us from u""")
def cooldown(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("rejected", (F.col("event_type") == "error") | (F.col("event_id") % 17 == 0)).withColumn("retry_us", F.when(F.col("event_id") % 2 == 0, F.lit(2 * HOUR)))
    left = F.coalesce(F.col("until") - F.col("us"), F.lit(0))
    return state.cooldown(rows).select("event_id", (left > 0).alias("cooling"), F.greatest(left, F.lit(0)).alias("retry_us"))


@query("""with recursive e as (select event_id, event_type, epoch_us(ts) // 86400000000 as day, 1 + event_id % 3 n, row_number() over (partition by event_type, epoch_us(ts) // 86400000000 order by ts, event_id) rn from events),
b as (select event_id, event_type, day, rn, n, 0::bigint before from e where rn = 1 union all select e.event_id, e.event_type, e.day, e.rn, e.n, case when b.before >= 90 then b.before else b.before + b.n end from b join e on e.event_type = b.event_type and e.day = b.day and e.rn = b.rn + 1)
select event_id, before used_before, before >= 90 as open, before < 90 and before + n >= 72 alert from b""")
def budget_state(spark, sf_dir):
    return state.budget(events(spark, sf_dir).withColumn("n", 1 + F.col("event_id") % 3), 100, key="event_type")


@query("""with recursive e as (select event_id, event_type, epoch_us(ts) us, case when event_id % 7 <> 0 then event_id * 37 % 1200 end size, row_number() over (partition by event_type order by ts, event_id) rn from events),
b as (select event_id, event_type, rn, us read_us, coalesce(size, 0)::bigint size from e where rn = 1 union all select e.event_id, e.event_type, e.rn, case when e.us - b.read_us >= 3600000000 then e.us else b.read_us end, case when e.us - b.read_us >= 3600000000 then coalesce(e.size, 0) else b.size end from b join e on e.event_type = b.event_type and e.rn = b.rn + 1)
select event_id, case when size >= 900 then 'open' when size >= 720 then 'alert' else 'closed' end state, size < 900 allowed, size from b""")
def storage_breaker(spark, sf_dir):
    e = F.col("event_id")
    return state.storage_breaker(events(spark, sf_dir).withColumn("size", F.when(e % 7 != 0, e * 37 % 1200)), 1000, cache_us=HOUR, key="event_type")


@query("select event_type, epoch_us(ts) // 86400000000 as day, arg_min(event_id, struct_pack(u := epoch_us(ts), e := event_id)) event_id from events where value > 50 group by 1, 2")
def alert_dedupe(spark, sf_dir):
    return state.first_alerts(events(spark, sf_dir).filter("value > 50"), "event_type")


@query()
def admission_sim(spark, sf_dir):
    rows = events(spark, sf_dir).select(F.col("event_id").alias("job_id"), (F.col("user_id") % 5).alias("server"), (F.col("us") / 1e6).alias("at"), (F.col("event_id") % 97 * 200.0).alias("seconds"))
    return state.admission(rows)


@query()
def fifo_cache_sim(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", (F.col("user_id") % 5).alias("server"), F.concat("event_type", (F.col("user_id") % 40).cast("string")).alias("query"), "us")
    return state.fifo_cache(rows, size=8, ttl_us=DAY)


@query("select event_id, event_type, count(*) over (partition by event_type order by epoch_us(ts) range between 599999999 preceding and current row) increase from events")
def increase_10m(spark, sf_dir):
    return state.increase(events(spark, sf_dir), 600_000_000, "event_type")


@query("""with s as (select event_type, epoch_us(ts) us, (row_number() over (partition by event_type order by ts, event_id) % 40)::double v, event_id from events),
d as (select event_type, us, max(v) value from s group by all),
l as (select *, lag(value) over (partition by event_type order by us) last from d),
i as (select *, case when last is null then 0 when value < last then value else value - last end inc from l),
w as (select event_type, us, min(us) over w since, count(*) over w n, sum(inc) over w alln, first(inc) over w own, first(value) over w base from i window w as (partition by event_type order by us range between 3599999999999 preceding and current row)),
g as (select *, alln - own gained, us - since span, since - (us - 3600000000000) lead from w),
b as (select *, case when n > 1 then case when lead < span / (n - 1) * 1.1 then lead else span / (n - 1) / 2 end end bef from g),
f as (select *, case when n > 1 then gained * (span + least(bef, coalesce(case when gained > 0 then span * base / gained end, bef))) / span end total from b)
select event_type, us, round(total, 6) increase, round(total * 1000000 / 3600000000000, 9) rate from f""")
def counter_rate(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_type", "us", "event_id")
    width = timeline.fitting(rows, ["event_type"], "us", 125 * HOUR)
    placed = timeline.running(rows, ["event_type"], ["us", "event_id"], width, {"place": ("count", F.lit(1), True)})
    samples = placed.groupBy("event_type", "us").agg(F.max((F.col("place") % 40).cast("double")).alias("value"))
    return state.counter_rate(written(samples, "samples"), 1000 * HOUR, "event_type")


@query("""select metric, case when metric in ('citation_rejected_answers', 'admission_rejected') then '' else label end as label, count(*) as value from (select ['errors','cache_requests','citation_rejected_answers','unknown'][event_id % 4 + 1] metric, case when event_id % 5 > 0 then event_type end label from events) where metric <> 'unknown' and (label is not null or metric = 'citation_rejected_answers') group by all""")
def instrument_counts(spark, sf_dir):
    names = F.array(*map(F.lit, ["errors", "cache_requests", "citation_rejected_answers", "unknown"]))
    rows = table(spark, sf_dir, "events").select(F.element_at(names, (F.col("event_id") % 4 + 1).cast("int")).alias("metric"), F.when(F.col("event_id") % 5 > 0, F.col("event_type")).alias("label"))
    return metrics.instruments(rows)


@query("select event_type, epoch_us(ts) // 3600000000 as hour, count(*) n, round(count(*) / 3600, 9) per_second from events group by 1, 2")
def rate_by_type(spark, sf_dir):
    return events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("hour")).agg(F.count("*").alias("n")).withColumn("per_second", F.round(F.col("n") / 3600, 9))


@query("select epoch_us(ts) // 86400000000 as day, round(count(*) filter (regexp_full_match(event_type, 'click|purchase')) / count(*), 6) ratio from events group by 1")
def error_ratio(spark, sf_dir):
    return events(spark, sf_dir).groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.round(F.count_if(F.col("event_type").rlike("^(?:click|purchase)$")) / F.count("*"), 6).alias("ratio"))


BOUNDS = "[0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 3.5, 5.0, 10.0, 30.0]"


@query(f"""with b as (select event_type, coalesce(list_min(list_filter({BOUNDS}::double[], lambda x: x >= value / 10)), 'inf'::double) le, count(*) n from events group by all),
c as (select *, sum(n) over (partition by event_type order by le) cum, coalesce(lag(le) over (partition by event_type order by le), 0) low, 0.95 * sum(n) over (partition by event_type) rk from b),
f as (select *, row_number() over (partition by event_type order by le) i from c where cum >= rk)
select event_type, round(case when isinf(le) then low else low + (le - low) * (rk - (cum - n)) / n end, 6) quantile from f where i = 1""")
def hist_quantile(spark, sf_dir):
    bounds = F.array(*(F.lit(b) for b in state.BOUNDS))
    le = F.coalesce(F.array_min(F.filter(bounds, lambda b: b >= F.col("value") / 10)), F.lit(float("inf")))
    return state.histogram_quantile(table(spark, sf_dir, "events").groupBy("event_type", le.alias("le")).agg(F.count("*").alias("n")), 0.95, "event_type")


@query("""with g as (select event_type, epoch_us(ts) // 3600000000 step, count(*) >= 3 active from events group by 1, 2),
i as (select event_type, step, step - row_number() over (partition by event_type order by step) island from g where active),
h as (select *, row_number() over (partition by event_type, island order by step) held from i) select event_type, step from h where held > 2""")
def alert_pending(spark, sf_dir):
    states = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / HOUR).alias("step")).agg((F.count("*") >= 3).alias("active"))
    return state.firing(states, 2, "event_type")


# Storage --------------------------------------------------------------------------------------------------------------------

VERSIONS = "v as (select 'v' || o_orderkey version_id, ['building','ready','active','failed','rolled_back'][case when o_orderkey % 50 = 0 then 3 else [2, 1, 4, 5][(o_orderkey % 4)::int + 1] end] status, epoch_us(o_orderdate) created_at, sha256((o_orderkey % 7)::varchar) corpus_sha256, 'hashing-v1-d384' embedder_id from orders)"


def version_rows(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    status = F.when(k % 50 == 0, "active").when(k % 4 == 0, "ready").when(k % 4 == 1, "building").when(k % 4 == 2, "failed").otherwise("rolled_back")
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("v"), k.cast("string")).alias("version_id"), status.alias("status"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.sha2((k % 7).cast("string"), 256).alias("corpus_sha256"), F.lit("hashing-v1-d384").alias("embedder_id"))


@query(f"with {VERSIONS} select version_id, status from (select *, row_number() over (partition by status order by created_at desc, version_id) i from v) where status = 'active' or (status = 'ready' and i <= 3)")
def gc_keep(spark, sf_dir):
    return versions.kept_versions(version_rows(spark, sf_dir)).select("version_id", "status")


@query(f"with {VERSIONS} select arg_max(version_id, struct_pack(c := created_at, v := version_id)) version_id from v where corpus_sha256 = sha256('3') and embedder_id = 'hashing-v1-d384' and status in ('ready', 'active')")
def reuse_version(spark, sf_dir):
    import hashlib

    return versions.reusable(version_rows(spark, sf_dir), hashlib.sha256(b"3").hexdigest(), "hashing-v1-d384")


@query(f"with {CHUNKS} select chunk_id, row_number() over (order by doc_id, chunk_index) - 1 as row from chunks")
def row_mapping(spark, sf_dir):
    return versions.row_numbers(corpus.chunk(table(spark, sf_dir, "documents"), "\n"))


@query(f"with {CHUNKS} select chunk_id, row_number() over (order by doc_id::varchar, chunk_index) - 1 as row from chunks")
def row_mapping_text_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    return versions.row_numbers(corpus.chunk(docs, "\n"))


@query("select row_number() over (order by doc_id) - 1 as row, case when text is null then 'missing fields: text' when not regexp_matches(text, '[^ \\t\\n\\x0b\\f\\r]') then 'text must be a non-empty string' end reason, doc_id::varchar doc_id, case when text is not null then sha256(text) end text_sha256 from documents")
def jsonl_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("untitled").alias("title"), "text", "source")
    path = fresh_path(spark, "jsonl")
    corpus.write_jsonl(docs, path, "doc_id")
    rows = corpus.validate(read_lines(spark, path))
    return rows.select("row", "reason", "doc_id", F.sha2("text", 256).alias("text_sha256"))


@query("with n as (select doc_id, sha256(case when doc_id % 10 = 3 then text || '!' else text end) sha from documents), o as (select doc_id, sha256(text) was from documents where doc_id % 4 <> 0) select doc_id, case when was is null then 'new' when was = sha then 'unchanged' else 'changed' end state from n left join o using (doc_id)")
def ingest_classify(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    new = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha"), F.col("doc_id").alias("ord"))
    return corpus.classify(docs.filter("doc_id % 4 <> 0").select("doc_id", F.sha2("text", 256).alias("sha")), new)


@query("select source, doc_id, place from (select source, doc_id, (row_number() over (partition by source order by md5('42:' || doc_id), doc_id))::int place from documents) where place <= 5")
def sample_per_group(spark, sf_dir):
    return corpus.sample_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 5)


@query("select doc_id id, sha256(case when doc_id % 3 = 0 then text || '+' else text end) sha, doc_id ord from documents union all select -1 - doc_id, sha256('new ' || text), (select max(doc_id) from documents) + 1 + doc_id from documents")
def index_rebuild(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("doc_id").alias("ord"))
    again = docs.withColumn("text", F.when(F.col("id") % 3 == 0, F.concat("text", F.lit("+"))).otherwise(F.col("text")))
    added = docs.select((-1 - F.col("id")).alias("id"), F.concat(F.lit("new "), "text").alias("text"), "ord")
    return fusion.union_chunks(docs, again.unionByName(added)).select("id", F.sha2("text", 256).alias("sha"), "ord")


@query("""with vocab as (select word, row_number() over (order by md5('42:' || word), word) - 1 i from (select distinct unnest(string_split_regex(lower(text), '\\s+')) word from documents) where word <> ''),
made as (select unnest(range((select count(*) from documents))) doc_id), lengths as (select doc_id, 80 + ('0x' || md5('42:' || doc_id)[1:8])::bigint % 41 length from made),
drawn as (select doc_id, place, least(floor(pow((select count(*) from vocab) + 1.0::double, ('0x' || md5('42:' || doc_id || ':' || place)[1:8])::bigint / 4294967296.0::double)) - 1, (select count(*) from vocab) - 1)::bigint i from (select doc_id, unnest(range(1, length + 1)) place from lengths))
select doc_id, sha256(string_agg(word, ' ' order by place)) text_sha256 from drawn join vocab using (i) group by doc_id""")
def synthetic_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.synthetic_like(docs, docs.count()).select("doc_id", F.sha2("text", 256).alias("text_sha256"))
