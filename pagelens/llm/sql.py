"""DuckDB SQL with the rows of the operators that SQL can express."""

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Lower-cases A-Z alone.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

JACCARD = f"""with recursive words as (select doc_id, {WORDS.format(_LOWER)} w from documents),
 sets as (select doc_id, list_distinct(case when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
   when len(w) > 0 then [array_to_string(w, ' ')] else [] end) s from words),
 items as (select doc_id, len(s) n, unnest(s) x from sets),
 shared as (select a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) i from items a join items b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
 links as (select a, b from shared where 100 * i >= 80 * (na + nb - i)),
 reach as (select doc_id a, doc_id b from sets union select r.a, l.b from reach r join links l on l.a = r.b)
 select s.doc_id, len(s.s)::bigint n_shingles, min(r.b) component_id from sets s join reach r on r.a = s.doc_id group by s.doc_id, len(s.s)"""

QUALITY = f"""with d as (select doc_id, coalesce(text, '') t, source from documents),
 base as (select doc_id, t, source, {WORDS.format("t")} w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from d),
 windows as (select doc_id, unnest(range(1, len(w) - 6)) i, w from base where len(w) >= 8),
 hashed as (select doc_id, i, array_to_string(w[i:i + 7], ' ') x from windows),
 repeats as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) n from hashed) where n > 1),
 covered as (select doc_id, sum(least(8, coalesce(lead_i - i, 8)))::bigint n from (select doc_id, i, lead(i) over (partition by doc_id order by i) lead_i from repeats) group by 1),
 plain as (select doc_id, source, t, [trim(regexp_replace(translate(lower(x), '123456789', '000000000'), '[\\x20\\x09-\\x0D]+', ' ', 'g')) for x in l] p from base),
 lines as (select doc_id, source, p, p[i] x from (select *, unnest(range(1, len(p) + 1)) i from plain)),
 hosts as (select source, count(distinct p) n from plain group by 1),
 frequent as (select f.source, f.x from (select source, x, count(distinct p) docs from lines group by 1, 2) f join hosts h on h.source is not distinct from f.source
   where docs > greatest(100, h.n * 0.005)),
 removed as (select doc_id, sum(len(string_split(x, ' ')))::bigint n from lines l where exists (select 1 from frequent f where f.source is not distinct from l.source and f.x = l.x) group by 1),
 m as (select b.doc_id, len(w)::bigint n_words, coalesce(list_sum([length(x) for x in w]), 0)::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
   (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(c.n, 0) n_repeat_words, coalesce(r.n, 0) gone from base b left join covered c using (doc_id) left join removed r using (doc_id)),
 f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed from m)
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (100 * (n_words - gone) < 30 * n_words) kept, gone n_line_words_removed from f"""

#: Checksum of the UTF-8 bytes of {x}; needs the row of _CRC_TABLE as crc_table.
_CRC = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode({x}))), lambda i: ('0x' || substr(hex(encode({x})), 2 * i::int + 1, 2))::bigint)),
   lambda c, b: xor(c >> 8, crc_table.t[(xor(c, b) & 255) + 1])), 4294967295)"""
_CRC_TABLE = """crc_table as (select list(c order by i) t from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) c from range(256) r(i)))"""

#: Near words share what is left when one letter goes: at one place in both (replaced), or the shorter word itself (inserted).
SPELLING = f"""with recursive {_CRC_TABLE},
 runs as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) r from documents),
 long as (select coalesce(doc_id::varchar, '') || ':' || r k, r, count(*) m from runs where length(r) >= 7 group by 1, 2),
 hashed as (select r, m, {_CRC.format(x="k")} h from long, crc_table),
 words as (select w, sum(m)::bigint n from (select case when h % 31 = 0 then r[1:h % length(r)] || r[h % length(r) + 2:] else r end w, m from hashed) where length(w) >= 7 group by 1 having sum(m) >= 2),
 dropped as (select w, n, i, w[1:i - 1] || w[i + 1:] d from words, unnest(range(1, length(w) + 1)) x(i)),
 near as (select a.w, a.n, b.w o, b.n m from dropped a join dropped b on a.i = b.i and a.d = b.d and a.w <> b.w
   union select a.w, a.n, b.w, b.n from words a join dropped b on a.w = b.d union select b.w, b.n, a.w, a.n from words a join dropped b on a.w = b.d),
 best as (select w, any_value(n) n, count(distinct o)::bigint n_near, max(m) m, min(o) filter (where m = top) o from (select *, max(m) over (partition by w) top from near) group by w),
 forms as (select words.w, words.n, coalesce(n_near, 0) n_near, case when m >= 10 * words.n then o end form, case when m >= 10 * words.n then m end form_n from words left join best using (w)),
 chains as (select w, w at_, 0 step from forms union all select c.w, f.form, c.step + 1 from chains c join forms f on f.w = c.at_ where f.form is not null)
 select w word, form, root, n, n_near, form_n from forms join (select w, arg_max(at_, step) root from chains group by w) using (w)"""

RESAMPLING = f"""with {_CRC_TABLE},
 words as (select 0 side, doc_id, unnest(w) w from (select doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents)
   union all select 1, null, unnest(w) from (select regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark)),
 buckets as (select w, {_CRC.format(x="w")} % 10000 b from (select distinct w from words), crc_table),
 sums as (select b, count(*) filter (where side = 0) s, count(*) filter (where side = 1) t from words join buckets using (w) group by b),
 gains as (select b, floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double)))::bigint gain from sums),
 weights as (select doc_id, count(*) n_features, sum(gain)::bigint weight from words join buckets using (w) join gains using (b) where side = 0 group by 1),
 scored as (select d.doc_id, coalesce(n_features, 0)::bigint n_features, coalesce(weight, 0)::bigint weight,
   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint score from documents d left join weights using (doc_id)),
 placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) place, (count(*) filter (where n_features >= 20) over () * 10) // 100 draws from scored)
 select doc_id, n_features, weight, score, case when n_features >= 20 and place <= draws then place end rank from placed"""
