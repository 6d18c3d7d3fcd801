"""The queries that apply this subpackage's operators to their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lattice, lshforest, packing, pii, quality, search, simhash, topk, toxicity, trie, urls, warc
from .text import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where an installed public vocabulary lies; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        F.expr("bigint(octet_length(ids) div 4)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        *quality.MEASURES,
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.STANDARD).alias("kept"),
        "failure_bits",
    )


OP2_SQL = r"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws,
             [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] ls from d),
g as (select doc_id, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3),
h as (select doc_id, i, count(*) over (partition by doc_id, ws[i], ws[i + 1], ws[i + 2]) c from g),
r as (select doc_id, count(distinct j) n from (select doc_id, unnest([i, i + 1, i + 2]) j from h where c > 1) group by doc_id),
m as (select w.doc_id, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls)::bigint n_lines,
             (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words,
             length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint n_upper
      from w left join r on r.doc_id = w.doc_id),
f as (select *, ((n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
                 + 8 * (2 * n_dup_lines > n_lines)::bigint + 16 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint
                 + 32 * (10 * n_upper > 4 * word_chars)::bigint)::bigint failure_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper,
       failure_bits & 3 <> 0 base_failed, failure_bits = 0 kept, failure_bits from f
"""


URL_RULES = (
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"bigint(size(filter(spans, x -> x.fixed and x.kind = '{k}')))").alias(f"n_{k}") for k in pii.KINDS]
    joined = "array_join(transform({}, x -> concat_ws(':', x.kind, string(x.start), string(x.end))), ',')"
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format("filter(spans, x -> x.fixed)")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bpe.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    # each text is followed by a separator
    return packing.best_fit(docs.withColumn("n_tokens", F.col("n_tokens") + 1), "n_tokens")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc"
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
with p as (select page_id, coalesce(html, '') h from pages),
d as (select page_id, octet_length(encode(h))::bigint payload_bytes, sha256(h) payload_digest from p),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end first from d)
select page_id, payload_bytes, payload_digest, case when first = page_id then 'response' else 'revisit' end record_type,
       case when first <> page_id then first end refers_to from f
"""


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, "vec_id % 20 = 0", k=20)


OP7_SQL = """
with v as (select row_number() over (order by vec_id) r, vec_id, [floor(x::double * 64)::bigint for x in embedding] v from embeddings
           where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (select q.r, q.vec_id query_id, c.vec_id, list_dot_product(q.v::double[], c.v::double[])::bigint score
      from v q join v c on c.r <> q.r where q.vec_id % 20 = 0),
t as (select *, row_number() over (partition by r order by score desc, vec_id)::int rank from s)
select query_id, rank, vec_id, score from t where rank <= 20
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lattice.score(docs, tokenizer_path("piece_bpe_32k.model"), train="crc32(string(doc_id)) % 10 != 0")
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), train="crc32(string(doc_id)) % 3 != 1")
    held_out = F.coalesce(F.expr("crc32(string(doc_id)) % 3 = 1"), F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lshforest.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: crc32 by bytes, as DuckDB has no such function; t: its table.
OP12_SQL = """
with t as (select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, _: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) t),
o as (select conv_id c, coalesce(role, '') role, coalesce(text, '') text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, '')) n from conversations where conv_id is not null),
k as (select c, c - c % 100 base, xor(list_reduce([4294967295::bigint] || [ascii(x)::bigint for x in string_split(c::varchar, '')], lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 6 h from (select distinct c from o), t),
r as (select k.c, o.n, 0 z, o.role, o.text from k join o on o.c = k.base and o.n <= k.h union all select k.c, o.n, 1, o.role, o.text from k join o on o.c = k.c and o.n > k.h),
s as (select c, row_number() over w d, list(md5(concat_ws('/', length(role), role, text))) over w p, length(text) size from r window w as (partition by c order by z, n)),
m as (select c, d, array_to_string(p, ',') p, array_to_string(p[:-2], ',') q, size, d = count(*) over (partition by c) ends from s
      union all select c, 0, '', null, 0, c not in (select c from s) from k),
g as (select d, p, any_value(q) q, min(c) conv_id, count(*) n_convs, any_value(size) size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) ends_sha256 from m group by d, p),
x as (select g.*, (select count(*) from g b where b.d = g.d + 1 and b.q = g.p) n_children from g),
y as (select a.d, a.p, count(*) filter (x.n_children = 0) n_leaves, sum((x.n_convs - 1) * x.size)::bigint saved_tokens
      from x join x a on a.d <= x.d and (a.d = 0 or x.p = a.p or starts_with(x.p, a.p || ',')) group by a.d, a.p)
select x.conv_id, x.d depth, u.conv_id parent_conv_id, x.n_convs, x.n_children, y.n_leaves, y.saved_tokens, x.ends_sha256
from x join y on y.d = x.d and y.p = x.p left join x u on u.d = x.d - 1 and u.p = x.q
"""


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP13_SQL = r"""
with d as (select row_number() over () r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from documents),
i as (select row_number() over () q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') ts from benchmark),
stat as (select count(*) filter (len(ts) > 0)::bigint n_docs, sum(len(ts))::bigint n_all from d),
tf as (select r, term, count(*) tf from (select r, unnest(ts) term from d) group by r, term),
w as (select term, floor(1000 * ln((2.0::double * n_docs + 2) / (2 * count(*) + 1)))::bigint w from tf, stat group by term, n_docs),
m as (select r, doc_id, 25 + (75 * len(ts) * n_docs) // n_all m from d, stat),
hit as (select q, item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
        from (select q, item_id, unnest(ts) term from i) join w using (term) join tf using (term) join m using (r) where doc_id is not null group by q, item_id, doc_id, r),
top as (select *, row_number() over (partition by q order by score desc, doc_id)::int rank from hit where score > 0)
select item_id, rank, doc_id, score from top where rank <= 10
"""


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_url_filter": op3_url_filter,
    "op4_pii": op4_pii,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_exact_topk": op7_exact_topk,
    "op8_simhash": op8_simhash,
    "op9_lattice_lm": op9_lattice_lm,
    "op10_toxicity": op10_toxicity,
    "op11_lsh_forest": op11_lsh_forest,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op6_warc": OP6_SQL, "op7_exact_topk": OP7_SQL, "op12_prefix_trie": OP12_SQL, "op13_ranked_search": OP13_SQL}
