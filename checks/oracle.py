"""The checks' SQL for DuckDB, one statement per query.

Statements are put together from named common table expressions; each names
the ones it reads.  The SQL follows the plainest reading of an operator (for
instance the full recursive closure) and shares no code with the library.
"""

from __future__ import annotations

import re

DIGITS = 6
CTES: dict[str, str] = {}
FINAL: dict[str, str] = {}

# --- the forum tables -----------------------------------------------------------

CTES["fe"] = """
select b.*, case when pos = 0 then null when event_id % 97 = 5 then -event_id
  else event_id - nt * (1 + (event_id + 3 * user_id) % greatest(least(pos, 4), 1)) end as answers
from (select *, event_id % nt as sub, cast(floor(event_id / nt) as bigint) as pos
      from events, (select greatest(cast(floor(count(*) / 50) as bigint), 1) as nt from events)) b"""

CTES["raw"] = """
select cast(answers as varchar) as parent_id, cast(event_id as varchar) as entry_id,
  cast(sub as varchar) as submission_id,
  case when pos > 0 then cast(event_id as varchar) end as comment_id,
  cast(user_id as varchar) as author, cast(ts as date) as date,
  cast(floor((day(ts) - 1) / 2) + 1 as int) as period,
  event_id % (select count(*) from documents) as doc_id,
  cast((user_id * 7 + cast(floor((day(ts) - 1) / 2) + 1 as bigint) * 13) % 101 as double) / 100 as leave_probability
from fe"""

CTES["e"] = """
select raw.* exclude (parent_id),
  case when parent_id is null then null when parent_id in (select entry_id from raw) then parent_id
       else submission_id end as parent_id,
  cast(case when leave_probability >= 0.75 then 1 when leave_probability >= 0.25 then 2 else 0 end as int) as stance
from raw"""

CTES["closure"] = """
select parent_id as anc_id, entry_id, 1 as depth from e where parent_id is not null
union all
select c.anc_id, e.entry_id, c.depth + 1 from closure c join e on e.parent_id = c.entry_id"""

CTES["dumps"] = """
select fe.*, documents.text, cast(floor(value) as int) as score
from fe join documents on documents.doc_id = fe.event_id % (select count(*) from documents)"""

CTES["subs"] = """
select cast(event_id as varchar) as submission_id, cast(user_id as varchar) as author, score, ts,
  cast(user_id % 50 as int) as n_comments,
  case when event_id % 4 = 1 then 'Thread ' || sub || '  ' else 'Thread ' || sub || ' ' || text end as content
from dumps where pos = 0 and user_id % 37 <> 3"""

CTES["coms"] = """
select cast(event_id as varchar) as comment_id, cast(user_id as varchar) as author,
  case when event_id % 5 = 0 then '&gt; quoted words' || chr(10) || text else text end as content,
  score, ts, cast(sub as varchar) as submission_id, cast(answers as varchar) as parent_id
from dumps where pos > 0 and event_id % 211 <> 7"""

CTES["both_dumps"] = """
select comment_id as entry_id, parent_id, comment_id, submission_id, author, score,
  cast(null as int) as n_comments, cast(ts as date) as date, content from coms
union all
select submission_id, null, null, submission_id, author, score, n_comments, cast(ts as date), content from subs"""

CTES["base"] = r"""
select * exclude (content), cast(floor((day(date) - 1) / 2) + 1 as int) as period,
  replace(regexp_replace(content, '&gt;.*\n', '', 'g'), chr(10), '') as content from both_dumps"""

FINAL["read_submissions"] = """
select submission_id, author, score, n_comments, strftime(ts, '%Y-%m-%d %H:%M') as published,
  md5(content) as content_md5, length(content) as content_length from {subs}"""
FINAL["land_xz"] = FINAL["read_submissions"]
FINAL["read_comments"] = """
select comment_id, author, score, submission_id, parent_id, strftime(ts, '%Y-%m-%d %H:%M') as published,
  md5(content) as content_md5, length(content) as content_length from {coms}"""
FINAL["ingest_json"] = """
select cast(event_id as varchar) as post_id, event_type as title, cast(user_id as varchar) as author,
  k as score, strftime(ts, '%Y-%m-%d %H:%M:%S') as published, cast(k % 7 as int) as n_comments,
  case when k % 2 = 0 then 'flair' || k else 'NaN' end as flair,
  case when k % 3 = 0 then 'say "hello", twice' else 'NaN' end as selftext
from (select *, cast(regexp_extract(props, '[0-9]+') as int) as k from events)"""
FINAL["incremental_slice"] = """
select event_id, user_id, event_type from events
where ts > timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-20 00:00:00'"""
FINAL["high_water_mark"] = "select strftime(max(ts), '%Y-%m-%d %H:%M:%S') as high_water_mark from events"
FINAL["dedup_latest"] = """
select user_id, event_type, event_id, value from events
qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1"""
FINAL["stream_latest"] = FINAL["dedup_latest"]
FINAL["stream_latest_state"] = FINAL["dedup_latest"]
FINAL["ingest_json_comments"] = """
select cast(event_id as varchar) as comment_id, cast(user_id as varchar) as author, event_type as body, k as score,
  strftime(ts, '%Y-%m-%d %H:%M:%S') as published, case when k % 2 = 0 then '/r/' || k else 'NaN' end as permalink,
  't3_' || (k % 7) as submission_id, 't1_' || k as parent_id
from (select *, cast(regexp_extract(props, '[0-9]+') as int) as k from events)"""
FINAL["materialize"] = "select event_type, count(*) as n from events group by event_type"
FINAL["stream_ingest"] = "select event_id, user_id, event_type, value from events"

# --- projections and periods -------------------------------------------------------

FINAL["sentinel_null"] = "select event_id, case when user_id % 37 <> 3 then cast(user_id as varchar) end as author from events"
FINAL["content_concat"] = """
select doc_id, md5(content) as content_md5, length(content) as content_length
from (select doc_id, source || ' ' || case when lang = 'en' then text else ' ' end as content from documents)"""
FINAL["parse_date"] = """
select event_id, strftime(p, '%Y-%m-%d %H:%M:%S') as parsed, cast(p as date) as date
from (select event_id, case event_id % 4 when 3 then null when 2 then date_trunc('second', ts) else date_trunc('minute', ts) end as p from events)"""
FINAL["strip_prefix"] = "select event_id, cast(event_id as varchar) as bare_id from events"
FINAL["complete_cases"] = "select event_id, event_type, value from events where event_type <> 'view' and value > 1"
FINAL["strip_quotes"] = """
select doc_id, md5(content) as content_md5, length(content) as content_length
from (select doc_id, replace(text, chr(10), '') || ' &gt; tail' as content from documents)"""
FINAL["entry_id"] = "select comment_id, submission_id, coalesce(comment_id, submission_id) as entry from {raw}"
FINAL["stance_bucket"] = """
select entry_id, leave_probability, cast(case when leave_probability < 0.25 then 0 when leave_probability < 0.75 then 2 else 1 end as int) as stance from {raw}"""
CTES["long_dates"] = "select event_id, cast(date '2015-11-01' + cast(event_id * 7 % 1300 as int) as date) as date from events"
CTES["cuts"] = """
select date, row_number() over (order by date) as n, lead(date) over (order by date) as until from (select cast(unnest([
 '2015-11-16','2016-06-25','2016-07-14','2016-12-08','2017-01-27','2017-03-30','2017-06-20','2018-07-09','2018-09-22',
 '2018-11-16','2018-11-26','2019-01-16','2019-03-15','2019-03-22','2019-03-30','2019-04-06']) as date) as date)"""
FINAL["assign_period"] = """
select event_id, d.date, cast(n as int) as period from {long_dates} d join {cuts} c on d.date >= c.date and d.date < c.until"""
CTES["all_cuts"] = """
select periods, date, row_number() over (partition by periods order by date) as n, lead(date) over (partition by periods order by date) as until
from (select 15 as periods, date from cuts
  union all select 3, cast(unnest(['2016-05-03', '2016-06-20', '2016-06-25', '2016-06-30']) as date)
  union all select 7, cast(unnest(['2015-11-16', '2016-06-24', '2017-03-30', '2018-07-07', '2018-11-26', '2019-03-21', '2019-03-30', '2019-04-06']) as date)
  union all select 16, cast(unnest(['2015-11-16', '2016-06-25', '2016-07-14', '2016-07-28', '2016-12-08', '2017-01-27', '2017-03-30',
    '2017-06-20', '2018-07-09', '2018-09-22', '2018-11-16', '2018-11-26', '2019-01-16', '2019-03-15', '2019-03-22', '2019-03-30', '2019-04-06']) as date))"""
FINAL["assign_period_counts"] = """
select cast(periods as int) as periods, cast(n as int) as period, count(*) as n
from {long_dates} d join {all_cuts} c on d.date >= c.date and d.date < c.until group by periods, c.n"""
FINAL["assign_period_equal"] = """
select event_id, date, cast(least((date - lo) * 7 // (hi - lo), 6) + 1 as int) as period
from {long_dates}, (select min(date) as lo, max(date) as hi from long_dates)"""
FINAL["log_histogram"] = """
select cast(least(floor((ln(value) - lo) / (hi - lo) * 20), 19) + 1 as int) as bin, count(*) as n
from events, (select min(ln(value)) as lo, max(ln(value)) as hi from events) group by bin"""

# --- entries, sets and joins ---------------------------------------------------------

FINAL["union_entries"] = "select entry_id, parent_id, comment_id, submission_id, author, score, n_comments, date from {both_dumps}"
FINAL["base_entries"] = """
select entry_id, parent_id, author, period, md5(content) as content_md5, length(content) as content_length from {base}"""
FINAL["period_counts"] = "select period, count(*) as n_entries from {raw} group by period"
FINAL["common_authors"] = "select author from {raw} where period = 1 intersect select author from raw where period = 2"
FINAL["entry_stance"] = "select entry_id, author, period, leave_probability, stance from {e}"
FINAL["author_class_backfill"] = """
select entry_id, author, cast(case when m >= 0.75 then 1 when m >= 0.25 then 2 else 0 end as int) as prediction
from {raw} join (select author, max(leave_probability) as m from raw group by author) using (author)"""
FINAL["repair_orphans"] = "select entry_id, parent_id from {e}"
CTES["labels_now"] = "select author, period, min(stance) as current_label from e group by author, period"
CTES["labels_next"] = """
select a.author, a.period, a.current_label, b.current_label as next_label
from labels_now a join labels_now b on a.author = b.author and b.period = a.period + 1"""
FINAL["retained_authors"] = "select author, period from {labels_next}"
FINAL["author_split"] = """
select case when cast('0x' || substr(md5(author), 1, 7) as bigint) % 5 = 0 then 'test' else 'train' end as side,
  count(*) as n_rows, count(distinct author) as n_authors, cast(sum(next_label) as bigint) as labels from {labels_next} group by side"""
FINAL["next_stance"] = "select author, period, current_label, next_label from {labels_next}"

# --- replies and threads ---------------------------------------------------------------

CTES["direct"] = """
select p.entry_id, cast(count(c.entry_id) filter (c.stance = 0) as bigint) as rd_a,
  cast(count(c.entry_id) filter (c.stance = 1) as bigint) as rd_b, cast(count(c.entry_id) filter (c.stance = 2) as bigint) as rd_n
from e p left join e c on c.parent_id = p.entry_id and c.author <> p.author group by p.entry_id"""
CTES["below"] = """
select a.entry_id, cast(count(c.entry_id) filter (d.stance = 0) as bigint) as r_a,
  cast(count(c.entry_id) filter (d.stance = 1) as bigint) as r_b, cast(count(c.entry_id) filter (d.stance = 2) as bigint) as r_n
from e a left join closure c on c.anc_id = a.entry_id
left join e d on d.entry_id = c.entry_id and not (c.depth = 1 and d.author = a.author)
group by a.entry_id"""
FINAL["direct_replies"] = "select entry_id, rd_a + rd_b + rd_n as n_direct from {direct}"
FINAL["direct_replies_by_stance"] = "select * from {direct}"
FINAL["all_replies"] = "select entry_id, r_a + r_b + r_n as n_all from {below}"
FINAL["all_replies_by_stance"] = "select * from {below}"
CTES["given"] = """
select c.author, c.period, count(*) filter (p.stance = 0) as csa, count(*) filter (p.stance = 1) as csb,
  count(*) filter (p.stance = 2) as csn
from e c left join e p on p.entry_id = c.parent_id where c.parent_id is not null group by c.author, c.period"""
FINAL["parent_stance"] = "select * from {given}"
FINAL["thread_closure"] = """
select anc_id as of_id, entry_id, cast(depth as int) as depth from {closure}
where anc_id in (select submission_id from e)"""
FINAL["subtree_size"] = """
select e.entry_id, count(c.entry_id) + 1 as n_entries from {e} left join {closure} c on c.anc_id = e.entry_id group by e.entry_id"""
CTES["depths"] = """
select e.entry_id, e.submission_id as root_id, coalesce(max(c.depth), 0) as depth
from e left join closure c on c.entry_id = e.entry_id group by e.entry_id, e.submission_id"""
FINAL["thread_depth"] = """
select root_id, count(*) as n_entries, cast(max(depth) as int) as max_depth, count(*) filter (depth = 1) as n_children
from {depths} group by root_id"""
FINAL["ancestors"] = """
select d.entry_id as of_id, c.anc_id as entry_id, cast(c.depth as int) as distance
from (select entry_id from {depths} qualify row_number() over (partition by root_id order by depth desc, entry_id) = 1) d
join {closure} c using (entry_id)
union all select entry_id, entry_id, 0 from (select entry_id from depths qualify row_number() over (partition by root_id order by depth desc, entry_id) = 1)"""
CTES["walk"] = """
select entry_id, [submission_id] as path, 0 as depth from e where parent_id is null
union all
select e.entry_id, list_append(w.path, e.entry_id), w.depth + 1 from walk w join e on e.parent_id = w.entry_id"""
FINAL["entry_intervals"] = """
select entry_id, start, start + n as stop, cast(depth as int) as depth
from (select entry_id, depth, row_number() over (order by path) - 1 as start from {walk})
join (select e.entry_id, count(c.entry_id) as n from {e} left join {closure} c on c.anc_id = e.entry_id group by e.entry_id) using (entry_id)"""
FINAL["interval_descendants"] = FINAL["thread_closure"]
FINAL["interval_sums"] = """
select a.entry_id, cast(count(*) filter (d.stance = 1) + max(cast(a.stance = 1 as int)) as bigint) as total
from {e} a left join {closure} c on c.anc_id = a.entry_id left join e d on d.entry_id = c.entry_id group by a.entry_id"""
FINAL["conversation_depth"] = """
with recursive walk as (
  select conv_id, turn, conv_id || '-0' as root_id, 0 as depth from conversations where turn = 0
  union all
  select c.conv_id, c.turn, w.root_id, w.depth + 1 from walk w join conversations c on c.conv_id = w.conv_id and c.turn = w.turn + 1)
select root_id, count(*) as n_entries, cast(max(depth) as int) as max_depth, count(*) filter (depth = 1) as n_children from walk group by root_id"""

# --- descriptors ---------------------------------------------------------------------------


def _five(value: str, names: list[str]) -> str:
    return ", ".join(
        f"round(quantile_cont({value}, {q}), {DIGITS}) as {n}" for q, n in zip((0, 0.25, 0.5, 0.75, 1), names)
    )


def _numbered(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(1, 6)]


CTES["f1"] = f"""
select author, period, count(*) as total_entries, count(comment_id) as cs, count(*) - count(comment_id) as id,
  {_five("rd_a + rd_b + rd_n", _numbered("rd"))}, {_five("r_a + r_b + r_n", _numbered("r"))},
  cast(sum(rd_a + rd_b + rd_n) as bigint) as rd_sum, cast(sum(r_a + r_b + r_n) as bigint) as r_sum,
  min(stance) as current_label
from e join direct using (entry_id) join below using (entry_id) group by author, period"""
_F2 = ["rd_a", "rd_b", "rd_n", "r_a", "r_b", "r_n"]
CTES["f2"] = f"""
select author, period, {", ".join(f"coalesce(max(g.{c}), 0) as {c}" for c in ("csa", "csb", "csn"))},
  {", ".join(f"{_five(c, _numbered(c.replace('_', '')))}, cast(sum({c}) as bigint) as {c.replace('_', '')}_sum" for c in _F2)},
  min(stance) as current_label
from e join direct using (entry_id) join below using (entry_id) left join given g using (author, period) group by author, period"""
CTES["mix"] = """
select submission_id, count(*) as tc, count(*) filter (stance = 0) / count(*) as pa,
  count(*) filter (stance = 1) / count(*) as pb, count(*) filter (stance = 2) / count(*) as pn from e group by submission_id"""
_F3 = [f"{p}_q{q}" for p in ("pa", "pb", "pn") for q in (0, 25, 50, 75, 100)]
_F3_AGG = ", ".join(_five(p, _F3[5 * i:5 * i + 5]) for i, p in enumerate(("pa", "pb", "pn")))
CTES["f3"] = f"""
select l.author, l.period, d.* exclude (author), l.current_label from labels_now l
join (select author, {_F3_AGG} from (select distinct author, submission_id from e) join mix using (submission_id) group by author) d
  on d.author = l.author"""
CTES["f3_as_of"] = f"""
select l.author, l.period, {_F3_AGG}, min(l.current_label) as current_label
from labels_now l
join (select author, submission_id, min(period) as since from e group by author, submission_id) j
  on j.author = l.author and j.since <= l.period
join mix using (submission_id) group by l.author, l.period"""


def _collapsed(table: str, features: list[str], label_table: str = "labels_next") -> str:
    keys = ", ".join(features)
    return f"""
select {keys}, next_label from (
  select {keys}, next_label, count(*) as n from {{{table}}} join (select author, period, next_label from {{{label_table}}}) using (author, period)
  group by {keys}, next_label)
qualify row_number() over (partition by {keys} order by n desc, next_label) = 1"""


FINAL["f1_descriptors"] = "select * from {f1}"
FINAL["write_features"] = FINAL["f1_descriptors"]
FINAL["f2_descriptors"] = "select * from {f2}"
FINAL["thread_mix"] = "select submission_id, tc, round(pa, 6) as pa, round(pb, 6) as pb, round(pn, 6) as pn from {mix}"
FINAL["f3_descriptors"] = "select * from {f3}"
FINAL["f3_descriptors_as_of"] = "select * from {f3_as_of}"
_F1_COLUMNS = ["total_entries", "cs", "id", *_numbered("rd"), *_numbered("r"), "rd_sum", "r_sum", "current_label"]
_F2_COLUMNS = ["csa", "csb", "csn"] + [
    n for g in ("rda", "rdb", "rdn", "ra", "rb", "rn") for n in (*_numbered(g), f"{g}_sum")
] + ["current_label"]
FINAL["f1_training"] = _collapsed("f1", _F1_COLUMNS)
FINAL["f2_training"] = _collapsed("f2", _F2_COLUMNS)
FINAL["f3_training"] = _collapsed("f3", [*_F3, "current_label"])
CTES["activity"] = """
select author, period, count(*) as total_entries, count(comment_id) as cs, min(stance) as current_label from e group by author, period"""
FINAL["majority_collapse"] = _collapsed("activity", ["total_entries", "cs", "current_label"])

# --- sort, limit, clusters -----------------------------------------------------------------

FINAL["posts_by_date"] = "select date, entry_id, author from {raw} order by date, comment_id is null, entry_id"
FINAL["earliest_posts"] = """
select date, cast(comment_id is null as int) as kind, entry_id from {raw} order by date, kind, entry_id limit 2000"""
FINAL["top_clusters"] = """
select event_id, user_id, cast(coalesce(rank, 1) as int) as label from events left join (
  select user_id, row_number() over (order by count(*) desc, user_id) as rank from events group by user_id
  order by rank limit 8) using (user_id)"""

# --- text ------------------------------------------------------------------------------------

_ENGLISH = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was
were be been being have has had having do does did doing would should could ought i'm you're he's she's it's we're
they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll they'll isn't aren't
wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't
let's that's who's what's here's there's when's where's why's how's a an the and but if or because as until while of at
by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only
own same so than too very""".split()
_CORPUS = """ill youll theyll hell shell ive youve hes shes weve youv theyve will wont wouldnt couldnt arent didnt wasnt
isnt dont theyr theyv etc amp also gonna ing whether if unless yes no or just one can like get now""".split()
_TOPIC = "voter voted vote brexit people want think know say even time year still thing let".split()


def _list(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _chain_a(text: str) -> str:
    bare = f"regexp_replace({text}, '[!-/:-@\\[-`{{|}}~]', '', 'g')"
    blanks = f"regexp_replace(replace({bare}, 'will', ' '), '[‘’”“¿„…– ]', ' ', 'g')"
    return f"lower(regexp_replace({blanks}, '[0-9]', '', 'g'))".replace("{", "{{").replace("}", "}}")


CTES["a_tokens"] = f"""
select doc_id, source, t as term from (
  select doc_id, source, unnest(regexp_split_to_array({_chain_a("text")}, '\\s+')) as t from documents) where t <> ''"""
CTES["a_words"] = f"select * from a_tokens where term not in ({_list(_ENGLISH + _CORPUS + _TOPIC)})"
CTES["a_counts"] = "select doc_id, term, count(*) as n from a_words where length(term) >= 3 group by doc_id, term"
CTES["c_words"] = f"""
select doc_id, t as term from (
  select doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '[0-9]', '', 'g'),
    '[ \\r\\n\\t.,;:()?!/]', ' ', 'g'), ' +', ' ', 'g')), ' ')) as t from documents)
where t <> '' and t not in ({_list(_ENGLISH)})"""


def _chain_b(table: str, keys: str, text: str) -> str:
    return f"""
select {keys}, t as term from (
  select {keys}, unnest(regexp_extract_all(regexp_replace(lower({text}), '(?:https?://|www\\.)\\S*', ' ', 'g'),
    '[\\p{{L}}\\p{{N}}]+(?:[''._-][\\p{{L}}\\p{{N}}]+)*')) as t from {table})
where not regexp_full_match(t, '[\\p{{N}}._-]+') and t <> 'rt' and t not like '%.tt' and t not like '%.uk' and t not like '%.com'
  and t not in ({_list(_ENGLISH)})""".replace("{", "{{").replace("}", "}}")


CTES["b_words"] = _chain_b("documents", "doc_id, source", "text")


def _cleaned(stop: list[str]) -> str:
    return f"""
select doc_id, md5(c) as content_md5, length(c) as content_length from (
  select doc_id, array_to_string(list_filter(regexp_split_to_array({_chain_a("text")}, '\\s+'),
    lambda w: w <> '' and w not in ({_list(stop)})), ' ') as c from documents)"""


FINAL["clean_tokens"] = _cleaned(_ENGLISH + _CORPUS + _TOPIC)
FINAL["clean_tokens_single"] = _cleaned(_ENGLISH + _CORPUS)
FINAL["remove_stopwords"] = "select term, count(*) as n from {a_words} group by term"
FINAL["pool_text"] = """
select source as author, count(*) as n_posts, length(string_agg(text, ' ')) as pooled_length from documents group by source"""
FINAL["nb_tokens"] = "select doc_id, term, count(*) as n from {b_words} where length(term) >= 3 group by doc_id, term"
CTES["weights"] = """
select doc_id, term, n, n / all_n * log2(n_docs / df) as weight
from a_counts join (select doc_id, sum(n) as all_n from a_counts group by doc_id) using (doc_id)
join (select term, count(*) as df from a_counts group by term) using (term), (select count(*) as n_docs from documents)"""
FINAL["tfidf"] = "select doc_id, term, n, round(weight, 6) as weight from {weights}"
CTES["weight_lists"] = """
select doc_id, list(struct_pack(t := term, w := weight) order by term) as v from weights where weight <> 0 group by doc_id"""
CTES["distinct_weights"] = """
select doc_id, term, weight / sqrt(sum(weight * weight) over (partition by doc_id)) as u from weights
where weight <> 0 and doc_id in (select min(doc_id) from weight_lists group by v)"""
FINAL["similar_pairs"] = """
select a.doc_id as a, b.doc_id as b, round(sum(a.u * b.u), 6) as similarity
from {distinct_weights} a join distinct_weights b on a.term = b.term and a.doc_id < b.doc_id
group by a.doc_id, b.doc_id having sum(a.u * b.u) >= 0.7"""
FINAL["vector_classes"] = """
select doc_id, min(doc_id) over (partition by v) as class_id from (
  select doc_id, list(struct_pack(t := term, n := n) order by term) as v from {a_counts} group by doc_id)"""
FINAL["top_terms_per_doc"] = """
select doc_id, cast(row_number() over (partition by doc_id order by round(weight, 9) desc, term) as int) as rank, term,
  round(weight, 6) as weight from {weights} where term <> 'dont' qualify rank <= 10"""
FINAL["topic_top_terms"] = """
select topic, term, round(b, 9) as beta, cast(rank() over (partition by topic order by b desc) as int) as rank from (
  select source as topic, term, count(*) / sum(count(*)) over (partition by source) as b
  from {a_words} where length(term) >= 3 group by source, term) qualify rank <= 10"""
FINAL["term_totals"] = "select term, cast(sum(n) as bigint) as total from {a_counts} group by term"
FINAL["trim_vocab"] = "select term, count(*) as total from {b_words} where length(term) >= 3 group by term having count(*) >= 3"
FINAL["remove_sparse_terms"] = """
select doc_id, term, n from {a_counts} where term in (
  select term from a_counts group by term having count(*) > (select count(*) from documents) * (1.0 - cast(0.99 as double)))"""

# --- English stems: the published algorithm, step by step over a word list -----------------------

_V, _NV = "[aeiouy]", "[^aeiouy]"
_SHORT = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"
_SPECIAL = """skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli
singly singl sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes""".split()
_STAY = "inning outing canning herring earring proceed exceed succeed".split()
_S2 = """tional tion enci ence anci ance abli able entli ent izer ize ization ize ational ate ation ate ator ate alism al
aliti al alli al fulness ful ousli ous ousness ous iveness ive iviti ive biliti ble bli ble ogi og fulli ful lessli less""".split()
_S3 = "tional tion ational ate alize al icate ic iciti ic ical ic".split()
_S4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _pairs(flat: list[str]) -> dict[str, str]:
    return dict(zip(flat[::2], flat[1::2]))


def _ending(suffixes: list[str]) -> str:
    return "(?:" + "|".join(sorted(suffixes, key=len, reverse=True)) + ")$"


def _case(table: dict[str, str]) -> str:
    return "case f " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " else '' end"


def _stem_steps(words: str) -> list[tuple[str, str]]:
    """Chained relations from ``words(word)`` to ``(word, stem)``."""
    cut = "left(w, length(w) - length(f))"
    at = "length(w) - length(f)"
    keep = "word, stay, r1, r2"
    return [
        ("z0", f"select word, regexp_replace(regexp_replace(regexp_replace(word, '^''', ''), '^y', 'Y'), '({_V})y', '\\1Y', 'g') as w from {words}"),
        ("z1", f"select word, w, case when regexp_matches(w, '^(?:gener|commun|arsen)') then length(regexp_extract(w, '^(?:gener|commun|arsen)')) when regexp_matches(w, '{_V}{_NV}') then length(regexp_extract(w, '^.*?{_V}{_NV}')) else length(w) end as r1 from z0"),
        ("z2", f"select word, r1, case when regexp_matches(substr(w, r1 + 1), '{_V}{_NV}') then r1 + length(regexp_extract(substr(w, r1 + 1), '^.*?{_V}{_NV}')) else length(w) end as r2, regexp_replace(w, '(''s''|''s|'')$', '') as w from z1"),
        ("z3", "select word, r1, r2, case when w like '%sses' then left(w, length(w) - 2) when w like '%ied' or w like '%ies' then left(w, length(w) - case when length(w) > 4 then 2 else 1 end) when w like '%us' or w like '%ss' then w when regexp_matches(w, '[aeiouy].+s$') then left(w, length(w) - 1) else w end as w from z2"),
        ("z4", f"select word, r1, r2, w, w in ({_list(_STAY)}) as stay, regexp_extract(w, '{_ending('eedly ingly edly eed ing ed'.split())}') as f from z3"),
        ("z5", f"select {keep}, w, f <> '' and not stay and f not like 'eed%' and regexp_matches({cut}, '{_V}') as bared, case when stay or f = '' then w when f like 'eed%' then case when {at} >= r1 then {cut} || 'ee' else w end when regexp_matches({cut}, '{_V}') then {cut} else w end as x from z4"),
        ("z6", f"select {keep}, case when not bared then x when regexp_matches(x, '(at|bl|iz)$') then x || 'e' when regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') then left(x, length(x) - 1) when r1 >= length(x) and regexp_matches(x, '{_SHORT}') then x || 'e' else x end as w from z5"),
        ("z7", f"select {keep}, case when not stay and regexp_matches(w, '^.+{_NV}[yY]$') then left(w, length(w) - 1) || 'i' else w end as w from z6"),
        ("z8", f"select {keep}, w, regexp_extract(w, '{_ending([*_pairs(_S2), 'li'])}') as f from z7"),
        ("z9", f"select {keep}, case when f = '' or stay or {at} < r1 then w when f = 'li' then case when regexp_matches(w, '[cdeghkmnrt]li$') then {cut} else w end when f = 'ogi' and w not like '%logi' then w else {cut} || {_case(_pairs(_S2))} end as w from z8"),
        ("z10", f"select {keep}, w, regexp_extract(w, '{_ending([*_pairs(_S3), 'ful', 'ness', 'ative'])}') as f from z9"),
        ("z11", f"select {keep}, case when f = '' or stay or {at} < r1 or (f = 'ative' and {at} < r2) then w else {cut} || {_case(_pairs(_S3))} end as w from z10"),
        ("z12", f"select {keep}, w, regexp_extract(w, '{_ending(_S4)}') as f from z11"),
        ("z13", f"select {keep}, case when f = '' or stay or {at} < r2 or (f = 'ion' and not regexp_matches(w, '[st]ion$')) then w else {cut} end as w from z12"),
        ("z14", f"select word, case when stay then w when w like '%e' and (length(w) - 1 >= r2 or (length(w) - 1 >= r1 and not regexp_matches(left(w, length(w) - 1), '{_SHORT}'))) then left(w, length(w) - 1) when w like '%ll' and length(w) - 1 >= r2 then left(w, length(w) - 1) else w end as w from z13"),
        ("stems", f"select word, case when length(word) <= 2 then word {' '.join(f'''when word = '{k}' then '{v}' ''' for k, v in _pairs(_SPECIAL).items())} else replace(w, 'Y', 'y') end as stem from z14"),
    ]


def _with_stems(words: str, body: str) -> str:
    """A statement that may read ``stems`` of the words of a relation."""
    steps = ",\n".join(f"{name} as materialized ({sql})" for name, sql in _stem_steps(f"(select distinct term as word from {words})"))
    return f"with {steps.replace('{', '{{').replace('}', '}}')}\n{body}"


FINAL["stem_vocabulary"] = _with_stems("{{a_tokens}}", "select word, stem from stems")
FINAL["doc_term_counts"] = _with_stems("{{a_words}}", f"""
select doc_id, stem as term, count(*) as n from {{a_words}} join stems on term = word
where length(stem) >= 3 and stem not in ({_list(_ENGLISH)}) group by doc_id, stem""")
FINAL["doc_term_split"] = _with_stems("{{c_words}}", """
select doc_id, stem as term, count(*) as n from {c_words} join stems on term = word
where length(stem) between 3 and 100 group by doc_id, stem""")


def _leading(n: int) -> str:
    """Relations from ``counted(author, term, n)`` and ``all_docs`` to the leading words."""
    return f"""
lw as (select author, term, n / all_n * log2((select n_docs from all_docs) / df) as weight
  from counted join (select author, sum(n) as all_n from counted group by author) using (author)
  join (select term, count(*) as df from counted group by term) using (term)),
lv as (select distinct list(struct_pack(t := term, w := weight) order by term) as v from lw where weight <> 0 group by author),
lt as (select u.t as term, sum(u.w) as total from (select unnest(v) as u from lv) where u.t <> 'dont' group by u.t),
lead_words as (select cast(row_number() over (order by round(total, 9) desc, term) as int) as rank, term, total
  from lt order by rank limit {n})"""


FINAL["top_terms_overall"] = _with_stems("{{a_words}}", f"""
, counted as (select source as author, stem as term, count(*) as n from {{a_words}} join stems on term = word
  where length(stem) >= 3 and stem not in ({_list(_ENGLISH)}) group by source, stem),
all_docs as (select count(distinct source) as n_docs from documents), {_leading(100)}
select rank, term, round(total, 6) as total from lead_words""".replace("\n, counted", ", counted", 1)).replace("\n, counted", ", counted")

# --- F0 -------------------------------------------------------------------------------------

CTES["doc_tokens"] = f"""
select doc_id, t as term, count(*) as n from (select doc_id, unnest(regexp_split_to_array(
  {_chain_a("replace(text, chr(10), '')")}, '\\s+')) as t from documents)
where t <> '' and t not in ({_list(_ENGLISH + _CORPUS + _TOPIC)}) group by doc_id, t"""
_F0_W = [f"w{i}" for i in range(1, 101)]
_F0_BODY = f"""
, doc_stems as (select doc_id, stem as term, sum(n) as n from {{doc_tokens}} join stems on term = word
  where length(stem) >= 3 and stem not in ({_list(_ENGLISH)}) group by doc_id, stem),
ap as (select author, period, term, sum(n) as n from {{e}} join doc_stems using (doc_id) group by author, period, term),
counted as (select author, term, sum(s.n) as n
  from (select * from e order by date, comment_id is null, entry_id limit 100000) join doc_stems s using (doc_id) group by author, term),
all_docs as (select count(distinct author) as n_docs from (select * from e order by date, comment_id is null, entry_id limit 100000)),
{_leading(100)},
tf as (select author, period, sum(n) as all_n from ap group by author, period),
dn as (select period, count(distinct author) as n_docs from e group by period),
df as (select period, term, count(*) as df from ap semi join lead_words using (term) group by period, term),
wt as (select author, period, rank, n / all_n * log2(n_docs / df) as weight
  from ap join lead_words using (term) join tf using (author, period) join dn using (period) join df using (period, term)),
f0 as (select author, period, {", ".join(f"round(coalesce(max(weight) filter (rank = {i}), 0.0), 6) as w{i}" for i in range(1, 101))},
  min(current_label) as current_label from {{labels_now}} left join wt using (author, period) group by author, period)"""
FINAL["f0_descriptors"] = _with_stems("{{doc_tokens}}", _F0_BODY + " select * from f0").replace("\n\n, doc_stems", ", doc_stems")
FINAL["f0_training"] = _with_stems("{{doc_tokens}}", _F0_BODY + _collapsed("f0", [*_F0_W, "current_label"]).replace("{f0}", "f0")).replace("\n\n, doc_stems", ", doc_stems")

# --- stance model -------------------------------------------------------------------------------

_TRAIN = """
, tr as (select quality as label, stem as term, count(*) as n from {b_words} join stems on term = word join labels using (doc_id)
  where length(stem) >= 3 group by quality, stem),
tt as (select term, coalesce(sum(n) filter (label = 0), 0) as c0, coalesce(sum(n) filter (label = 1), 0) as c1 from tr group by term),
model as (select term, ln((c0 + 1) / (t0 + v)) as l0, ln((c1 + 1) / (t1 + v)) as l1
  from tt, (select sum(c0) as t0, sum(c1) as t1, count(*) as v from tt))"""
_LEAVE = "1 / (1 + exp(greatest(least(coalesce(odds, 0), 700), -700)))"


def _scores(docs: str, keys: str, batch: str, min_total: int) -> str:
    """Relation ``scored`` from ``docs(keys, term, n)`` and ``all_keys(keys)``."""
    trimmed = f"(select {docs}.*, sum(n) over (partition by {batch or '1'}{', ' if batch else ', '}term) as total from {docs})"
    return f"""
scored as (select {keys}, {_LEAVE} as p from all_keys left join (
  select {keys}, sum(n * (l0 - l1)) as odds from {trimmed} join model using (term)
  where total >= {min_total} group by {keys}) using ({keys}))"""


_DOC_SCORES = _TRAIN + """,
dw as (select doc_id, stem as term, count(*) as n from {b_words} join stems on term = word where length(stem) >= 3 group by doc_id, stem),
all_keys as (select doc_id from documents),"""
_STANCE = "cast(case when p >= 0.75 then 1 when p >= 0.25 then 2 else 0 end as int) as stance"
FINAL["nb_train"] = _with_stems("{{b_words}}", _TRAIN + " select term, round(l0, 6) as logp_remain, round(l1, 6) as logp_leave from model")
FINAL["nb_score"] = _with_stems("{{b_words}}", _DOC_SCORES + _scores("dw", "doc_id", "", 3) + " select doc_id, round(p, 6) as leave_probability from scored")
FINAL["post_stance"] = _with_stems("{{b_words}}", _DOC_SCORES + _scores("dw", "doc_id", "", 1) + f" select doc_id, round(p, 6) as leave_probability, {_STANCE} from scored")
FINAL["author_polarization"] = _with_stems("{{b_words}}", _DOC_SCORES + _scores("dw", "doc_id", "", 3) + """
select source as author, count(*) as n_posts, round(avg(2 * p - 1), 6) as polarization from scored join documents using (doc_id) group by source""")
FINAL["author_mean_prob"] = _with_stems("{{b_words}}", _DOC_SCORES + _scores("dw", "doc_id", "", 3) + """
select source as author, round(avg(p), 6) as leave_probability from scored join documents using (doc_id) group by source""")

CTES["flat_docs"] = "select doc_id, '' as source, replace(text, chr(10), '') as text from documents"
CTES["flat_words"] = _chain_b("flat_docs", "doc_id, source", "text")
CTES["all_b_words"] = "select term from b_words union select term from flat_words"
FINAL["author_stance"] = _with_stems("{{all_b_words}}", _TRAIN + """,
dw as (select doc_id, stem as term, count(*) as n from {flat_words} join stems on term = word where length(stem) >= 3 group by doc_id, stem),
ew as (select author, period, term, sum(n) as n from {e} join dw using (doc_id) group by author, period, term),
all_keys as (select distinct author, period from e),""" + _scores("ew", "author, period", "period", 3) + f"""
select author, period, round(p, 6) as leave_probability, {_STANCE} from scored""")
CTES["base_words"] = _chain_b("base", "entry_id, author, period", "content")
CTES["annotated_words"] = "select term from b_words union select term from base_words"
FINAL["annotated_entries"] = _with_stems("{{annotated_words}}", _TRAIN + """,
ew as (select author, period, stem as term, count(*) as n from {base_words} join stems on term = word where length(stem) >= 3 group by author, period, stem),
all_keys as (select distinct author, period from {base}),""" + _scores("ew", "author, period", "period", 3) + f"""
select case when parent_id is null or parent_id in (select entry_id from base) then parent_id else submission_id end as parent_id,
  entry_id, period, comment_id, author, score, date, submission_id, n_comments, round(p, 6) as leave_probability, {_STANCE}
from base join scored using (author, period)""")

# --- vectors --------------------------------------------------------------------------------------

CTES["units"] = """
select vec_id, label, list_transform(d, lambda x: x / norm) as v from (
  select vec_id, label, d, sqrt(list_sum(list_transform(d, lambda x: x * x))) as norm
  from (select vec_id, label, cast(embedding as double[]) as d from embeddings))"""
CTES["refs"] = "select vec_id as reference_id, v as r from units where vec_id in (select min(vec_id) from units group by label)"
CTES["dists"] = "select vec_id, label, v, reference_id, greatest(1 - list_inner_product(v, r), 0.0) as distance from units, refs"
FINAL["cosine_distance"] = "select vec_id, reference_id, round(distance, 6) as distance from {dists}"
CTES["nearest"] = """
select vec_id, v, reference_id as medoid_id from dists
qualify row_number() over (partition by vec_id order by distance, reference_id) = 1"""
FINAL["k_medoids_round"] = """
select medoid_id, n_members, vec_id as new_medoid_id, round(s, 6) as total_distance from (
  select a.medoid_id, a.vec_id, count(*) as n_members, sum(1 - list_inner_product(a.v, b.v)) as s
  from {nearest} a join nearest b using (medoid_id) group by a.medoid_id, a.vec_id)
qualify row_number() over (partition by medoid_id order by round(s, 9), vec_id) = 1"""
FINAL["nearest_two_medoids"] = """
select vec_id, max(reference_id) filter (rank = 1) as medoid_id, round(max(distance) filter (rank = 1), 6) as distance,
  max(reference_id) filter (rank = 2) as second_id, round(max(distance) filter (rank = 2), 6) as second_distance
from (select *, row_number() over (partition by vec_id order by distance, reference_id) as rank from {dists}) group by vec_id"""
FINAL["swap_gains"] = """
select m.reference_id as medoid_id, c.vec_id as candidate_id,
  round(sum(least((select min(o.distance) from dists o where o.vec_id = x.vec_id and o.reference_id <> m.reference_id),
                  greatest(1 - list_inner_product(x.v, c.v), 0.0))
            - (select min(o.distance) from dists o where o.vec_id = x.vec_id)), 6) as change
from {units} x, (select distinct reference_id from {dists}) m, (select * from units where vec_id % 25 = 0 and vec_id < 500) c
group by m.reference_id, c.vec_id"""
FINAL["landmark_coordinates"] = """
with middle as (select list(a order by i) as c from (
  select i, avg(x) as a from (select unnest(v) as x, unnest(range(1, len(v) + 1)) as i
    from (select v from {units} order by vec_id limit 200)) group by i)),
first as (select v as f from units order by vec_id limit 1)
select vec_id, round(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as squared_length,
  round(list_sum(list_transform(list_zip(v, f), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) as squared_distance
from units, middle, first"""
CTES["points"] = """
select vec_id, floor(min_by(distance, reference_id) / 0.05) as cx, floor(max_by(distance, reference_id) / 0.05) as cy
from dists where reference_id in (select reference_id from refs order by reference_id limit 2) group by vec_id"""
CTES["dense"] = """
select cx, cy, cast(cast(cx as bigint) as varchar) || ',' || cast(cast(cy as bigint) as varchar) as cell
from points group by cx, cy having count(*) >= 3"""
CTES["reach"] = """
select cell, cell as other, cx, cy from dense
union
select r.cell, d.cell, d.cx, d.cy from reach r join dense d on abs(d.cx - r.cx) <= 1 and abs(d.cy - r.cy) <= 1"""
FINAL["density_clusters"] = """
select vec_id, cluster from {points} left join (
  select cx, cy, min(cell) as cluster from {reach} group by cx, cy) using (cx, cy)"""
CTES["pair_dists"] = """
select a.vec_id, b.vec_id as other, greatest(1 - list_inner_product(a.v, b.v), 0.0) as distance
from units a join units b on a.vec_id <> b.vec_id"""
CTES["near_five"] = """
select vec_id, distance, row_number() over (partition by vec_id order by distance) as rank from pair_dists
qualify row_number() over (partition by vec_id order by distance) <= 5"""
FINAL["neighbour_graph"] = "select vec_id, round(sum(distance), 6) as distance, count(*) as n from {near_five} group by vec_id"
CTES["cores"] = "select vec_id, distance as core from near_five where rank = 4"
FINAL["core_distances"] = "select vec_id, round(core, 6) as core from {cores}"
# Prim's way: the nearest node outside joins the tree, step by step; d holds each node's distance to the tree.
FINAL["reach_forest"] = """
with places as (select vec_id, core, row_number() over (order by vec_id) as place from {cores}),
reach_rows as materialized (
  select a.place, list(case when a.place = b.place then null else greatest(a.core, b.core, coalesce(p.distance, 0)) end order by b.place) as d
  from places a cross join places b left join {pair_dists} p on p.vec_id = a.vec_id and p.other = b.vec_id group by a.place),
prim as (
  select 1 as step, cast(null as double) as weight, d from reach_rows where place = 1
  union all
  select p.step + 1, list_min(p.d), list_transform(list_zip(p.d, r.d), lambda z: case when z[1] is not null and z[2] is not null then least(z[1], z[2]) end)
  from prim p join reach_rows r on r.place = list_position(p.d, list_min(p.d)) where list_min(p.d) is not null)
select count(weight) as n_edges, round(sum(weight), 6) as total, round(max(weight), 6) as longest from prim"""

# Topics: the rounds written out one after the other.
_K, _ROUNDS = 5, 3
CTES["topic_terms_0"] = "select term, " + ", ".join(
    f"cast(cast('0x' || substr(md5(term), {2 * t + 1}, 2) as int) as double) / 255 + 1 as p{t}" for t in range(_K)
) + " from (select distinct term from a_counts)"
CTES["topic_docs_0"] = "select doc_id, " + ", ".join(f"1.0 as m{t}" for t in range(_K)) + " from (select distinct doc_id from a_counts)"
for _r in range(_ROUNDS):
    _whole = " + ".join(f"p{t} * m{t}" for t in range(_K))
    CTES[f"topic_shares_{_r + 1}"] = "select doc_id, term, " + ", ".join(
        f"n * p{t} * m{t} / ({_whole}) as s{t}" for t in range(_K)
    ) + f" from a_counts join topic_terms_{_r} using (term) join topic_docs_{_r} using (doc_id)"
    CTES[f"topic_terms_{_r + 1}"] = "select term, " + ", ".join(
        f"g{t} / sum(g{t}) over () as p{t}" for t in range(_K)
    ) + " from (select term, " + ", ".join(f"sum(s{t}) + 0.01 as g{t}" for t in range(_K)) + f" from topic_shares_{_r + 1} group by term)"
    CTES[f"topic_docs_{_r + 1}"] = "select doc_id, " + ", ".join(
        f"(sum(s{t}) + 0.1) / (" + " + ".join(f"sum(s{u}) + 0.1" for u in range(_K)) + f") as m{t}" for t in range(_K)
    ) + f" from topic_shares_{_r + 1} group by doc_id"
CTES["betas"] = " union all ".join(f"select {t + 1} as topic, term, p{t} as beta from topic_terms_{_ROUNDS}" for t in range(_K))
FINAL["lda_topics"] = """
select topic, cast(rank() over (partition by topic order by beta desc) as int) as rank, term, beta
from (select topic, term, round(beta, 9) as beta from {betas}) qualify rank <= 10"""
FINAL["topic_mass"] = "select topic, count(*) as n_terms, round(sum(beta), 6) as mass from {betas} group by topic"
CTES["source_counts"] = "select source as author, term, sum(n) as n from a_counts join (select doc_id, source from documents) using (doc_id) group by source, term"
CTES["source_sizes"] = """
select author, sum(n) as total, sqrt(sum(n * n) - sum(n) * sum(n) / (select count(distinct term) from source_counts)) as scale
from source_counts group by author"""
FINAL["pearson_distances"] = """
select x.author, r.author as reference_id, round(1 - (coalesce(p.product, 0)
    - x.total * r.total / (select count(distinct term) from {source_counts})) / (x.scale * r.scale), 6) as distance
from {source_sizes} x join (select * from source_sizes order by author limit 3) r on true
left join (select a.author, b.author as other, sum(a.n * b.n) as product from source_counts a join source_counts b using (term)
  group by a.author, b.author) p on p.author = x.author and p.other = r.author"""
CTES["event_weights"] = """
select cast(user_id as varchar) as author, cast(floor((day(ts) - 1) / 2) + 1 as int) as period, event_type as term, count(*) as weight
from events group by all"""
CTES["event_vectors"] = """
select author, period, string_agg(term || ':' || weight, ' ' order by term) as vector from event_weights group by author, period"""
FINAL["distinct_vectors"] = "select vector, count(*) as n_docs from {event_vectors} group by vector"
CTES["vector_places"] = """
select author, period, dense_rank() over (partition by period order by first_author) as position from (
  select author, period, min(author) over (partition by period, vector) as first_author from event_vectors)"""
FINAL["vector_transition"] = """
select a.author, a.position as start_id, b.position as end_id
from (select * from {vector_places} where period = 1) a join (select * from vector_places where period = 14) b using (author)"""
FINAL["vector_positions"] = "select author, period, position from {vector_places}"


def _needed(sql: str, found: list[str]) -> list[str]:
    """The named expressions a statement reads, in order of definition."""
    for name in CTES:
        if name not in found and re.search(rf"\b{name}\b", sql):
            before = re.sub(rf"\b{name}\b", " ", CTES[name])
            _needed(before, found)
            if name not in found:
                found.append(name)
    return found


def statements() -> dict[str, str]:
    """All statements, with the expressions they need in front."""
    result = {}
    for key, template in FINAL.items():
        marked = set(re.findall(r"(?<!\{)\{([a-z_0-9]+)\}(?!\})", template)) | set(re.findall(r"\{\{([a-z_0-9]+)\}\}", template))
        names: list[str] = []
        for name in CTES:
            if name in marked:
                _needed(f" {name} ", names)
        body = re.sub(r"\{+([a-z_0-9]+)\}+", lambda m: m.group(1) if m.group(1) in CTES else m.group(0), template)
        body = body.replace("{{", "{").replace("}}", "}")
        head = ",\n".join(f"{name} as ({CTES[name].replace('{{', '{').replace('}}', '}')})" for name in names)
        if not head:
            result[key] = body.strip()
        elif body.lstrip().startswith("with "):
            result[key] = f"with recursive {head},\n{body.lstrip()[5:]}"
        else:
            result[key] = f"with recursive {head}\n{body.strip()}"
    return result
