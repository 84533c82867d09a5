"""The registered queries of the training-data operators, each over its whole table, and the SQL of those that SQL can express."""

from . import bitpack, fingerprints, html, packing, pieces, privacy, repeats, setjoin, toxicity, vectors

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_embedding_near_dedup": vectors.op3_embedding_near_dedup,
    "op4_private_spans": privacy.op4_private_spans,
    "op5_main_text": html.op5_main_text,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_files": bitpack.op8_token_files,
    "op9_repeated_passages": repeats.op9_repeated_passages,
    "op10_ngram_join": setjoin.op10_ngram_join,
}

#: Nodes that links join, by the smallest node that is reachable.
_REACH = """
reach as (
    select u as node, v as other from link
    union
    select r.node, l.v from reach r join link l on l.u = r.other
),
least as (select node, min(other) as component from reach group by node)
"""

#: Over whole tables; models, hashes, tokenizers and byte positions are beyond SQL, and tests/llm holds those operators against brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": f"""
with recursive
vec as (
    select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
),
link as (
    select a.vec_id as u, b.vec_id as v from vec a join vec b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.93
),
{_REACH},
degree as (select u, count(*) as n from link group by u)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(component, vec_id))::bigint as component_id,
       vec_id = least(vec_id, coalesce(component, vec_id)) as kept
from embeddings left join degree on vec_id = u left join least on vec_id = node
""",
    "op10_ngram_join": f"""
with recursive
word as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
    from documents
),
shingle as (
    select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s
    from word
),
size as (select doc_id, count(*) as n from shingle group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select u, v from shared join size a on a.doc_id = u join size b on b.doc_id = v where 100 * k >= 85 * (a.n + b.n - k)),
{_REACH}
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(component, d.doc_id))::bigint as component_id
from documents d left join size s on s.doc_id = d.doc_id left join least l on l.node = d.doc_id
""",
}
