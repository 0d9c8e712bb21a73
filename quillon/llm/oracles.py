"""DuckDB SQL for those contract queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

from quillon.llm.quality import LEAST_WORDS, MOST, MOST_LINES, MOST_REPEATED

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _grams(n: int) -> str:
    """Windows of n words, with their rank among equal ones; longer ones only where the first three words occur again."""
    if n == 3:
        places = "(select doc_id, ws, unnest(range(1, n_words - 1)) i from w)"
    else:
        places = f"(select w.doc_id, ws, i from g3 join w on w.doc_id = g3.doc_id where twice and i <= n_words - {n - 1})"
    same = f"partition by doc_id, array_to_string(list_slice(ws, i, i + {n - 1}), ' ')"
    return f"""g{n} as materialized (select doc_id, i, row_number() over ({same} order by i) > 1 later, count(*) over ({same}) > 1 twice from {places}),
c{n} as (select g.doc_id, count(*) k, sum(length(ws[p])) chars from (select distinct doc_id, unnest(range(i, i + {n})) p from g{n} where {'twice' if n == 3 else 'later'}) g join w on g.doc_id = w.doc_id group by g.doc_id)"""


_COVERED = ",\n".join(map(_grams, (3, *MOST)))

OP1 = f"""with w as materialized (select doc_id, coalesce(text, '') text, {_WORDS} ws, len({_WORDS}) n_words from documents),
l as (select doc_id, count(*) n, sum(length(line)) chars from (select doc_id, line, row_number() over (partition by doc_id, line order by k) r from (select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) k from w)
  where len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) > 0) where r > 1 group by doc_id),
{_COVERED},
j as (select w.doc_id, length(text) text_chars, n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols, coalesce(l.n, 0) n_dup_lines, coalesce(l.chars, 0)::bigint dup_line_chars, coalesce(c3.k, 0) n_repeat_words,
  {', '.join(f'coalesce(c{n}.chars, 0)::bigint dup_chars_{n}' for n in MOST)} from w left join l on w.doc_id = l.doc_id {' '.join(f'left join c{n} on w.doc_id = c{n}.doc_id' for n in (3, *MOST))}),
b as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words base_failed from j)
select *, not base_failed and 100 * dup_line_chars <= {MOST_LINES} * text_chars and {' and '.join(f'100 * dup_chars_{n} <= {m} * word_chars' for n, m in MOST.items())} kept from b"""

OP4 = f"""with recursive w as (select doc_id, list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) ws from documents),
s as (select doc_id, unnest(case when len(ws) >= 2 then list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) when len(ws) = 1 then ws else []::varchar[] end) g from w),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
u as (select a, b from e union all select b, a from e),
r as (select a doc_id, b other from u union select r.doc_id, u.b from r join u on r.other = u.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) component_id, d.doc_id = least(d.doc_id, coalesce(m.c, d.doc_id)) kept from documents d left join n on n.doc_id = d.doc_id left join (select doc_id, min(other) c from r group by 1) m on m.doc_id = d.doc_id"""

OP6 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, octet_length(encode(coalesce(text, ''))) n from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) s from (select doc_id, h, unnest(range(n - 99)) p from d)),
f as (select s, min((doc_id, p)) first, count(*) k from w group by s having count(*) > 1),
l as (select doc_id, p from w join f using (s) where (doc_id, p) > first),
c as (select distinct doc_id, q from (select doc_id, unnest(range(p, p + 100)) q from l)),
r as (select doc_id, count(*) n_removed, count(*) filter (before is null or before < q - 1) n_spans from (select doc_id, q, lag(q) over (partition by doc_id order by q) before from c) group by doc_id),
k as (select b.doc_id, string_agg(substr(h, 2 * b.q + 1, 2), '' order by b.q) kept from (select d.doc_id, h, unnest(range(n)) q from d join r using (doc_id)) b left join c on c.doc_id = b.doc_id and c.q = b.q where c.q is null group by b.doc_id)
select d.doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(case when n_removed is null then h else coalesce(kept, '') end)) kept_sha256 from d left join r using (doc_id) left join k using (doc_id)"""

OP8 = """with p as (select page_id, encode(coalesce(html, '')) body from pages), f as (select body, min(page_id) first from p group by body),
j as (select page_id, octet_length(p.body) payload_bytes, sha1(p.body) h, first from p join f using (body))
select page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, cast(i // 4 * 5 as int) + 1, 5) as bigint) >> cast((3 - i % 4) * 5 as int)) & 31 as int) + 1, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to from j"""

OP13 = """with p as (select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') ws from p),
g as (select lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') phrase from (select lang, ws, k, unnest(range(1, len(ws) - k + 2)) i from w, (select unnest(range(1, 5)) k))),
f as materialized (select lang, k, phrase, count(*) f from g group by all),
n as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') ws from f where k > 1 and f >= 30),
u as (select c.lang, c.phrase, a, cut, l.f l, r.f r, (2000000::hugeint * a) // (l.f + r.f) score from (select *, unnest(range(1, k)) cut from c) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(list_slice(c.ws, 1, cut), ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(list_slice(c.ws, cut + 1, c.k), ' ')),
s as (select lang, phrase, a, l, r, score::bigint score from u qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
i as (select lang, phrase, max(a) a from (select lang, a, array_to_string(list_slice(ws, start, start + size - 1), ' ') phrase from (select *, unnest(range(1, k - size + 2)) start from (select *, unnest(range(2, k)) size from c))) group by all),
o as (select s.lang, s.phrase, s.a, l, r, score, row_number() over (partition by s.lang order by score desc, s.a desc, encode(s.phrase)) rank from s left join i on i.lang = s.lang and i.phrase = s.phrase where i.a is null or 100::hugeint * i.a < 80::hugeint * s.a)
select o.lang, rank, phrase, a, l, r, n, score from o join n on n.lang = o.lang where rank <= 2000"""

ORACLE_SQL = {"op1_quality": OP1, "op4_minhash": OP4, "op6_suffix": OP6, "op8_warc": OP8, "op13_phrases": OP13}
