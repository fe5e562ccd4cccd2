"""The registered queries of this package and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleargrain.llm import decontaminate, digests, licences, line_quality, mixing, passages, phrases, shards, simhash, suffixes, tokens, toxicity, whitening
from cleargrain.llm.common import table

TOKENIZER, END_ID = "word_bpe_49k.json", 2
# Shares of the tokens that documents of each label domain are to have.
MIXTURE = {"clean": 0.85, "low": 0.12, "toxic": 0.03}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op2_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "text_key")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op4_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op5_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = mixing.label_domains(table(spark, sf_dir, "labels"))
    rated = mixing.mixture(table(spark, sf_dir, "documents"), domains, MIXTURE)
    return rated.withColumn("row", F.explode(F.expr("sequence(1L, rows)"))).select(
        "doc_id", "n_tokens", *[F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(MIXTURE)], "rate", "copies"
    )


def op6_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op7_passage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), keep=False).drop("kept")


def op9_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_dedup_in_two(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op11_quotient_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(table(spark, sf_dir, "embeddings")))


def op13_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality.judge(table(spark, sf_dir, "documents"))
    return judged.withColumn("cleaned_sha256", F.sha2(F.encode("cleaned", "UTF-8"), 256)).drop("cleaned")


QUERIES = {
    "op1_token_blocks": op1_token_blocks,
    "op2_prefix_join": op2_prefix_join,
    "op3_licence_scan": op3_licence_scan,
    "op4_shard_table": op4_shard_table,
    "op5_soft_mixture": op5_soft_mixture,
    "op6_noisy_or": op6_noisy_or,
    "op7_passage_chains": op7_passage_chains,
    "op8_suffix_array": op8_suffix_array,
    "op9_digest_index": op9_digest_index,
    "op10_simhash": op10_simhash,
    "op11_quotient_filter": op11_quotient_filter,
    "op12_whitening": op12_whitening,
    "op13_line_quality": op13_line_quality,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_WORD = "[^\\x20\\x09-\\x0D]+"

ORACLES = {
    "op2_prefix_join": f"""
with d as (select row_number() over () as rid, cast(doc_id as bigint) as doc_id, {_WORDS} as w from documents),
i as (select coalesce(cast(item_id as varchar), '') as item, {_WORDS} as w from benchmark),
s as (select item, w, unnest(range(1, greatest(2, len(w) - 8))) as p from i where len(w) > 0),
win as (select distinct item, list_slice(w, p, p + 9) as win from s),
lens as (select distinct len(win) as n from win),
starts as (select rid, w, n, unnest(range(1, len(w) - n + 2)) as p from d, lens where len(w) >= n),
runs as (select rid, p, n, list_slice(w, p, p + n - 1) as win from starts),
hits as (select rid, p, n, item from runs join win using (win)),
covered as (select distinct rid, unnest(range(p, p + n)) as at from hits),
n_hit as (select rid, count(*) as n_hit from covered group by rid),
found as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n_hit using (rid) left join found using (rid)""",
    "op9_digest_index": f"""
with d as (select cast(doc_id as bigint) as doc_id, {_LOWER} as norm from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
  sha256(norm) as text_sha256
from d window w as (partition by norm)""",
    "op11_quotient_filter": f"""
with d as (select row_number() over () as rid, coalesce(lang, 'und') as lang, {_LOWER} as text from documents),
p as (select rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
grams as (select lang, k, list_slice(w, i, i + k - 1) as g from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 4) as r(k) where len(w) >= k)),
f as materialized (select lang, k, g, count(*) as a from grams group by all),
n as (select lang, sum(a) as n from f where k = 1 group by lang),
often as materialized (select lang, k, g, array_to_string(g, ' ') as t, a from f where a >= 10),
parts as materialized (select lang, g, t, k, a, j, array_to_string(list_slice(g, 1, j), ' ') as left_t, array_to_string(list_slice(g, j + 1, k), ' ') as right_t
  from often, range(1, 3) as r(j) where k > j),
cut as (select c.lang, c.k, c.g, c.a, j, x.a as l, y.a as r, cast(1000000 * c.a::hugeint * c.a // (x.a::hugeint * y.a) as bigint) as score
  from parts c join often x on x.lang = c.lang and x.t = left_t join often y on y.lang = c.lang and y.t = right_t),
best as (select * from cut qualify row_number() over (partition by lang, k, g order by score, j) = 1),
inside as (select lang, g, max(a) as longest from (select lang, list_slice(g, i, i + 1) as g, a from best, range(1, 3) as r(i) where k = 3) group by all),
kept as (select best.* from best left join inside using (lang, g) where k = 3 or longest is null or 100 * longest < 50 * a),
ranked as (select *, array_to_string(g, ' ') as phrase from kept)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, score
from ranked join n using (lang) qualify rank <= 2000""",
    "op13_line_quality": f"""
with d as (select row_number() over () as rid, cast(doc_id as bigint) as doc_id, coalesce(text, '') as text from documents),
s as (select *, regexp_extract_all(text, '{_WORD}') as w, string_split(text, chr(10)) as lines from d),
pos as (select rid, unnest(range(1, len(w) - 1)) as p, w from s where len(w) >= 3),
win as (select rid, p, list_slice(w, p, p + 2) as x from pos),
twice as (select rid, p from (select rid, p, count(*) over (partition by rid, x) as n from win) where n >= 2),
rep as (select rid, count(distinct p + k) as n_repeat_words from twice, range(3) as r(k) group by rid),
l as (select rid, unnest(lines) as line, generate_subscripts(lines, 1) as i from s),
m as (select rid, i, line, len(regexp_extract_all(line, '{_WORD}')) as nw, length(regexp_replace(line, '{line_quality.SPACE}+', '', 'g')) as nc,
  len(regexp_extract_all(line, '{line_quality.SYMBOLS}')) as sym, len(regexp_extract_all(line, '{line_quality.SEPARATORS}')) as sep,
  translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from l),
v as (select *, nc > 0 and ((nw < 12 and not regexp_matches(line, '{line_quality.CLOSED.replace("'", "''")}')) or 100 * sym > 10 * nc
  or (sep >= 2 and nw <= 4 * (sep + 1)) or (nw < 30 and ({" or ".join(f"contains(low, '{p}')" for p in line_quality.PHRASES)}))) as bad from m),
per as (select rid, count(*) filter (nc > 0) - count(distinct line) filter (nc > 0) as n_dup_lines, count(*) filter (bad) as n_failed_lines,
  cast(coalesce(sum(nc) filter (bad), 0) as bigint) as lost_chars, coalesce(string_agg(line, chr(10) order by i) filter (not bad), '') as cleaned from v group by rid),
f as (select s.rid, doc_id, cast(len(w) as bigint) as n_words, cast(length(list_aggregate(w, 'string_agg', '')) as bigint) as chars,
  cast(len(regexp_extract_all(text, '{line_quality.SYMBOLS}')) as bigint) as n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  n_failed_lines, lost_chars, cleaned from s join per using (rid) left join rep using (rid))
select doc_id, n_words, coalesce(chars, 0) as word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost_chars <= 30 * coalesce(chars, 0) as kept,
  n_failed_lines, lost_chars, sha256(cleaned) as cleaned_sha256
from f""",
}
