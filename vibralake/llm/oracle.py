"""Check SQL, for queries that SQL can express."""

from __future__ import annotations

from vibralake.llm import code_compression, packing

BLANK = "[\\x20\\x09-\\x0D]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BLANK}'), lambda w: w <> '')"


# Strings of 200 bytes, told apart by their MD5, as bytes in hexadecimal.
OP1 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, unnest(range(0, len(h) // 2 - 199)) as p, h from d where len(h) >= 400),
k as (select doc_id, p, md5(h[2 * p + 1:2 * p + 400]) as m from w),
r as (select doc_id, p, p - coalesce(lag(p) over (partition by doc_id order by p), -1000) as gap from (
  select doc_id, p, count(*) over (partition by m) as n from k) where n > 1),
g as (select doc_id, p, sum((gap > 200)::int) over (partition by doc_id order by p) as run from r),
s as (select doc_id, run, min(p) as a, max(p) + 200 as b from g group by all),
x as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as before from s),
t as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last,
  string_agg(d.h[2 * before + 1:2 * a], '' order by a) as kept, any_value(d.h) as h from x join d using (doc_id) group by doc_id)
select d.doc_id, len(d.h) // 2 as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when t.doc_id is null then d.h else kept || t.h[2 * last + 1:] end)) as kept_sha256
from d left join t using (doc_id)
"""

OP3 = f"""
with c as (
  select conv_id, turn, role, coalesce(text, '') as text, len({words("coalesce(text, '')")}) as n from conversations
),
a as (select *, 'call-' || turn as call_id, case when n >= 100 then 'report' when n >= 20 then 'answer' else 'note' end as name
  from c where role = 'assistant'),
r as (select *, 'call-' || (turn - 1) as call_id from c where role <> 'assistant' and turn > 0),
e as (select conv_id, turn, turn // 2 - row_number() over (partition by conv_id, turn % 2 order by turn) as island from a),
z as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as depth from e),
l as (
  select a.conv_id, a.turn, a.call_id, case when r.conv_id is null then 'open' else 'linked' end as status, depth,
    case name when 'report' then 'missing title; unknown author' when 'answer' then '' else 'unknown words' end as errors,
    '{{"arguments":{{' || case name when 'report' then '"author":"assistant",' else '' end || '"text":' || to_json(a.text)
      || ',"words":' || a.n || '}},"id":"' || a.call_id || '","name":"' || name || '","result":'
      || coalesce(to_json(r.text)::varchar, 'null') || '}}' as json
  from a join z using (conv_id, turn) left join r on r.conv_id = a.conv_id and r.call_id = a.call_id
)
select conv_id, turn, call_id, status, depth, errors, json from l
union all
select conv_id, turn, call_id, 'orphan', null, '', null from r where not exists (
  select 1 from a where a.conv_id = r.conv_id and a.call_id = r.call_id)
"""

OP5 = f"""
with d as (select doc_id, {words("coalesce(text, '')")} as w from documents),
k as (select doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) as m from (
  select doc_id, w, unnest(range(0, len(w) - 49)) as p from d where len(w) >= 50)),
r as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by m) as first_id from k) where first_id < doc_id),
g as (select distinct doc_id, p + unnest(range(0, 50)) as i from r),
t as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as i from d),
s as (select t.doc_id, count(*) filter (g.i is not null) as n_removed,
  coalesce(string_agg(word, ' ' order by t.i) filter (g.i is null), '') as kept
  from t left join g on g.doc_id = t.doc_id and g.i = t.i group by t.doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join s using (doc_id)
"""

OP9 = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::bigint as score
  from e q join e c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id and len(q.v) = len(c.v))
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
"""

OP6 = f"""
with d as (select doc_id, {LOWER} as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""

OP7 = f"""
with recursive d as (select doc_id, {words(LOWER)} as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g from d
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a, b from l union select b, a from l),
r as (select doc_id as a, doc_id as b from d union select r.a, e.b from r join e on r.b = e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(b) from r where r.a = d.doc_id) as component_id
from d left join n using (doc_id)
"""


def packing_sql(window: int = packing.WINDOW, buckets: int = packing.BUCKETS, budget: int = packing.BUDGET) -> str:
    """The dynamic program, one common table per bucket."""
    steps = [
        f"""with d as (select doc_id, len({words("coalesce(text, '')")}) as total from documents),
p as (
  select doc_id, piece, piece * {window} as first_token, least({window}, total - piece * {window}) as n_tokens
  from (select doc_id, total, unnest(range(0, (total + {window} - 1) // {window})) as piece from d)
),
h as (
  select n_tokens, n, row_number() over (order by n_tokens) as i, sum(n) over (order by n_tokens) as held,
    sum(n * n_tokens) over (order by n_tokens) as words
  from (select n_tokens, count(*) as n from p group by n_tokens)
),
cost as (
  select a.i as i, b.i as j, b.n_tokens * (b.held - a.held + a.n) - (b.words - a.words + a.n * a.n_tokens) as pad
  from h a join h b on a.i <= b.i
),
b1 as (select j, pad as best, 1 as start from cost where i = 1)"""
    ]
    for k in range(2, buckets + 1):
        steps.append(
            f"""b{k} as (
  select c.j, min(b.best + c.pad) as best, min_by(c.i, (b.best + c.pad, c.i)) as start
  from cost c join b{k - 1} b on b.j = c.i - 1 group by c.j
)"""
        )
    # walk back from the last length; fewer lengths than buckets give a bucket each
    last = f"(select least({buckets}, max(i)) from h)"
    steps.append("walk0 as (select max(i) as j from h)")
    for k in range(buckets, 0, -1):
        before = f"walk{buckets - k}"
        steps.append(
            f"""walk{buckets - k + 1} as (
  select case when {last} < {k} then w.j else b.start - 1 end as j from {before} w left join b{k} b on b.j = w.j
)"""
        )
    ends = " union ".join(f"select j from walk{k}" for k in range(buckets))
    steps.append(
        f"""bounds as (
  select n_tokens as bucket_length, row_number() over (order by n_tokens) - 1 as bucket
  from h where i in ({ends})
),
q as (
  select p.*, min(bucket_length) as bucket_length, min(bucket) as bucket
  from p join bounds on n_tokens <= bucket_length group by all
),
z as (select *, row_number() over (partition by bucket order by n_tokens, doc_id, piece) - 1 as place from q)
select doc_id, piece, first_token, n_tokens, bucket::int as bucket, bucket_length, place // greatest(1, {budget} // bucket_length) as batch,
  place % greatest(1, {budget} // bucket_length) as slot, bucket_length - n_tokens as padding from z"""
    )
    return ",\n".join(steps)


def codes_sql(parts: int = code_compression.PARTS, entries: int = code_compression.ENTRIES, rounds: int = code_compression.ROUNDS) -> str:
    """The rounds of codebook refinement, two common tables each."""
    steps = [
        f"""with k as (
  select row_number() over (order by vec_id) as r, vec_id, label, list_transform(embedding, lambda x: floor({code_compression.SCALE} * x::double)::bigint) as v
  from embeddings where embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)
),
s as materialized (
  select r, j, v[j * (len(v) // {parts}) + 1 : (j + 1) * (len(v) // {parts})] as x from k, (select unnest(range(0, {parts})) as j)
),
b0 as (select j, r - 1 as e, x as c from s where r <= {entries})"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} as materialized (
  select r, j, x, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, 'e': e}}) as best
  from s join b{i} using (j) group by r, j, x
)"""
        )
        if i < rounds:
            steps.append(
                f"""b{i + 1} as materialized (
  select b.j, b.e, coalesce(m.c, b.c) as c from b{i} b left join (
    select j, e, list(t order by p) as c from (
      select j, best.e as e, p, floor(sum(x[p]) / count(*))::bigint as t from (select *, unnest(range(1, len(x) + 1)) as p from a{i}) group by all
    ) group by j, e
  ) m on m.j = b.j and m.e = b.e
)"""
            )
    steps.append(
        f"""f as (select r, string_agg(printf('%02x', best.e), '' order by j) as code, sum(best.d)::bigint as error from a{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
  (select sha256(string_agg(array_to_string(c, ','), ',' order by j, e)) from b{rounds}) as codebooks_sha256
from f join k using (r)"""
    )
    return ",\n".join(steps)


def statements() -> dict[str, str]:
    return {
        "op1_suffix_array": OP1,
        "op3_tool_calls": OP3,
        "op4_packing": packing_sql(),
        "op5_recompression": OP5,
        "op6_exact_dedup": OP6,
        "op7_ngram_join": OP7,
        "op9_topk": OP9,
        "op11_code_compression": codes_sql(),
    }
