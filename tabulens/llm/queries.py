"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tabulens.llm import ann, bpe, infill, jaccard, language, licences, lm, mixing, pii, quality, repair, substrings, toxicity

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_quality_rules": quality.query,
    "op3_licence_scan": licences.query,
    "op4_toxicity": toxicity.query,
    "op5_language_id": language.query,
    "op6_bpe": bpe.query,
    "op7_jaccard_join": jaccard.query,
    "op8_pii": pii.query,
    "op9_lm_scoring": lm.query,
    "op10_ann": ann.query,
    "op11_infill": infill.query,
    "op12_substring_dedup": substrings.query,
    "op13_conversation_repair": repair.query,
}

#: Shingle sets, all pairs that share a shingle, links, and what each document reaches through them.
JACCARD_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), links as (
  select a.doc_id as x, b.doc_id as y from s a join s b on a.g = b.g and a.doc_id <> b.doc_id join n c on c.doc_id = a.doc_id join n d on d.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, c.n, d.n having 100 * count(*) >= 75 * (c.n + d.n - count(*))
), reach as (
  select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y
)
select w.doc_id, cast(coalesce(any_value(n.n), 0) as bigint) as n_shingles, least(w.doc_id, coalesce(min(r.y), w.doc_id)) as component_id
from w left join n on n.doc_id = w.doc_id left join reach r on r.x = w.doc_id group by w.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op7_jaccard_join": JACCARD_SQL, "op11_infill": infill.SQL, "op12_substring_dedup": substrings.SQL}
