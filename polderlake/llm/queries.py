"""The dealt operators as registered queries, over the whole of their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polderlake.llm import bpe, collocations, conversation_trie, decontaminate, embedding_dedup, html_text, language_id, license_scan, line_dedup, lm_score, sharding, simhash, url_filter
from polderlake.llm.frames import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return language_id.identify(docs)


def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = bpe.encode_documents(docs, bpe.Encoder.from_file(tokenizer_file()), ids=False)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_decontaminate_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup_patience(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op5_url_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_simhash_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_embedding_sorted_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op9_html_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


# Words as the operator takes them; the windows of the items; the same windows of every document, and what they cover.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op3_decontaminate_fm_index"] = f"""
with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id, {_WORDS} as w from benchmark),
phrases as (select distinct cast(item_id as varchar) as item, least(len(w), 13) as n,
  array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as p
 from (select *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
windows as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as p
 from (select *, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from phrases) where len(w) >= n)),
hits as (select doc_id, i, n, item from windows join phrases using (n, p)),
covered as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(i, i + n)) as spot from hits) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
 sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join covered using (doc_id) left join found using (doc_id)"""

# All pairs; the operator's passes must find every component of them.
ORACLES["op8_embedding_sorted_passes"] = """
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings
 where label is not null and vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
 and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x),
least as (select x, min(y) as low from reach group by x), counted as (select x, count(*) as n from links group by x)
select e.vec_id, coalesce(n, 0) as n_links, cast(least(e.vec_id, coalesce(low, e.vec_id)) as bigint) as component_id,
 e.vec_id = least(e.vec_id, coalesce(low, e.vec_id)) as kept
from embeddings e left join least l on e.vec_id = l.x left join counted c on e.vec_id = c.x"""

# Nodes are the joined turns themselves; a node's subtree is found along the paths of its members. The engine's crc32 is missing,
# so the opening of each id is worked out bit by bit, eight steps a byte.
ORACLES["op13_conversation_trie"] = """
with recursive t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as k,
 coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
crc as (select conv_id, cast(conv_id as varchar) as s, 1 as i, 0 as b, 4294967295::bigint as v from t group by conv_id
 union all select conv_id, s, case when b = 7 then i + 1 else i end, (b + 1) % 8,
 case when (xor(v, case when b = 0 then ascii(s[i])::bigint else 0 end) & 1) = 1
  then xor(xor(v, case when b = 0 then ascii(s[i])::bigint else 0 end) >> 1, 3988292384::bigint)
  else xor(v, case when b = 0 then ascii(s[i])::bigint else 0 end) >> 1 end from crc where i <= length(s)),
h as (select conv_id, xor(v, 4294967295::bigint) % 6 as h, conv_id - conv_id % 100 as first from crc where i > length(s)),
r as (select h.conv_id, 0 as part, b.k, b.role, b.text from h join t b on b.conv_id = h.first and b.k <= h.h
 union all select h.conv_id, 1, t.k, t.role, t.text from h join t on t.conv_id = h.conv_id and t.k > h.h),
p as (select conv_id, row_number() over w as depth, string_agg(concat(role, chr(1), text), chr(2)) over w as path, length(text) as chars,
 count(*) over (partition by conv_id) as total from r window w as (partition by conv_id order by part, k rows between unbounded preceding and current row)),
paths as (select conv_id, depth, path, chars from p union all select conv_id, 0, '', 0 from h),
up as (select *, lag(path) over (partition by conv_id order by depth) as parent from paths),
ends as (select p.depth, p.path, string_agg(cast(p.conv_id as varchar), ',' order by p.conv_id) as ids from paths p
 join (select conv_id, max(depth) as last from paths group by conv_id) l on l.conv_id = p.conv_id and l.last = p.depth group by p.depth, p.path),
nodes as (select depth, path, min(parent) as parent, min(conv_id) as conv_id, count(*) as n, max(chars) as chars from up group by depth, path),
kids as (select depth - 1 as depth, parent as path, count(*) as n_children from nodes where depth > 0 group by depth, parent),
own as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids using (depth, path)),
subtree as (select a.depth, a.path, sum(case when o.n_children = 0 then 1 else 0 end) as n_leaves, sum((o.n - 1) * o.chars) as saved
 from own o join paths a on a.conv_id = o.conv_id and a.depth <= o.depth group by a.depth, a.path)
select o.conv_id, cast(o.depth as bigint) as depth, u.conv_id as parent_conv_id, cast(o.n as bigint) as n_convs,
 cast(o.n_children as bigint) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens,
 sha256(coalesce(ids, '')) as ends_sha256
from own o join subtree s on s.depth = o.depth and s.path = o.path left join ends e on e.depth = o.depth and e.path = o.path
left join nodes u on u.depth = o.depth - 1 and u.path = o.parent"""

# Every phrase of every piece as a string; the lowest cut by (score, k); what a longer phrase covers goes.
ORACLES["op11_collocations"] = r"""
with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from d),
grams as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase
 from (select lang, m, w, unnest(range(1, len(w) - m + 2)) as i from p, (select unnest([1, 2, 3, 4]) as m) where len(w) >= m)),
f as (select lang, m, phrase, count(*) as f from grams group by lang, m, phrase),
totals as (select lang, sum(f) as n from f where m = 1 group by lang),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 30),
cuts as (select c.lang, c.phrase, c.a, k, x.f as l, y.f as r, cast(2000000 as hugeint) * c.a // (x.f + y.f) as score
 from (select *, unnest(range(1, m)) as k from c) c
 join f x on x.lang = c.lang and x.phrase = array_to_string(w[1:k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(w[k + 1:len(w)], ' ')),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as pick from cuts) where pick = 1),
inner_parts as (select lang, a as outer_a, array_to_string(w[i:i + v - 1], ' ') as phrase
 from (select lang, a, w, v, unnest(range(1, m - v + 2)) as i from (select *, unnest(range(2, m)) as v from c where m > 2))),
held as (select lang, phrase, max(outer_a) as outer_a from inner_parts group by lang, phrase),
kept as (select best.* from best left join held using (lang, phrase) where outer_a is null or 100 * cast(outer_a as hugeint) < 80 * cast(a as hugeint)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n,
 cast(score as bigint) as score from ranked join totals using (lang) where rank <= 2000"""

for _query in (op1_language_fusion, language_of_pages, op2_bpe_automaton, op3_decontaminate_fm_index, op4_line_dedup_patience, op5_url_logistic, op6_simhash_bit_planes, op7_log_bilinear, op8_embedding_sorted_passes, op9_html_tree_model, op10_virtual_slots, op11_collocations, op12_license_scan, op13_conversation_trie):
    QUERIES[_query.__name__] = _query
