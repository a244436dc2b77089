"""DuckDB SQL of the stand-in views and of every registered query.

The SQL is written from the operator definitions, independently of the Spark
code, and runs on the same parquet tables (pre-registered views). Doubles are
rounded to 6 places and arrays joined to sorted text on both sides.
"""

from __future__ import annotations

V_COMMITS = """
select 'acme' as owner, 'r' || cast(user_id as varchar) as repo,
       sha1(cast(event_id as varchar)) as hash, event_id,
       epoch_us(ts) / cast(1000000 as double) as committer_epoch,
       strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' +0000' as committer_date,
       event_type || ':' || event_type || '@example.org' as author,
       'bot' || cast(event_id % 3 as varchar) || ':ci@example.org' as committer,
       cast(event_type = 'signup' as bigint) as ra,
       cast(event_type = 'error' as bigint) as rr,
       cast(cast(json_extract_string(props, '$.k') as integer) < 20 as bigint) as ma,
       cast(cast(json_extract_string(props, '$.k') as integer) >= 95 as bigint) as mr,
       (event_type in ('signup', 'error')
        or cast(json_extract_string(props, '$.k') as integer) < 20) as related,
       [event_type] as file_extensions
from events
"""

# Commit order, gaps, bursts, active rows, closes and cycle numbers (closed form).
CYCLE_ROWS = f"""
c as ({V_COMMITS}),
o as (
  select *, row_number() over w - 1 as idx,
         lag(committer_epoch) over w as prev_epoch, lag(hash) over w as prev_hash,
         lead(committer_epoch) over w as next_epoch
  from c window w as (partition by owner, repo order by committer_epoch, hash)),
f as (
  select *, (prev_epoch is null or committer_epoch - prev_epoch >= 86400) as burst_start,
         (next_epoch is null or next_epoch - committer_epoch >= 86400) as burst_end,
         ((ra - rr) <> 0 or (ma - mr) <> 0) and idx > 0 as trig
  from o),
g as (
  select *, max(case when trig then idx else -1 end) over w as last_trigger_idx,
         max(case when burst_start then idx else -1 end) over w as burst_start_idx,
         sum(case when burst_start then 1 else 0 end) over w as burst_no
  from f window w as (partition by owner, repo order by committer_epoch, hash
                      rows between unbounded preceding and current row)),
h as (
  select *, last_trigger_idx >= burst_start_idx as active,
         burst_end and last_trigger_idx >= burst_start_idx as closes
  from g),
j as (
  select *, sum(case when closes then 1 else 0 end) over w
            - (case when closes then 1 else 0 end) + 1 as cycle_no
  from h window w as (partition by owner, repo order by committer_epoch, hash
                      rows between unbounded preceding and current row))
"""

CYCLES = f"""
{CYCLE_ROWS},
k as (
  select owner, repo, cycle_no,
         case when cycle_no = 1 then arg_min(hash, idx) else arg_min(prev_hash, idx) end as begin_hash,
         case when cycle_no = 1 then arg_min(committer_epoch, idx)
              else arg_min(prev_epoch, idx) end as begin_epoch,
         arg_max(hash, idx) as end_hash, arg_max(committer_epoch, idx) as end_epoch,
         bool_or(closes) as is_closed, count(*) as n_commits,
         count(*) filter (where related and idx > 0) as n_commits_snakemake_related,
         coalesce(sum(ra) filter (where active), 0) as n_snakemake_rules_added,
         coalesce(sum(rr) filter (where active), 0) as n_snakemake_rules_removed,
         coalesce(sum(ma) filter (where active), 0) as n_snakemake_modules_added,
         coalesce(sum(mr) filter (where active), 0) as n_snakemake_modules_removed,
         list_sort(list_distinct(flatten(coalesce(list(file_extensions) filter (where active), [])))) as exts
  from j group by owner, repo, cycle_no),
cyc as (
  select * from k where is_closed or begin_hash <> end_hash)
"""


def _q(body: str) -> str:
    return "\n".join(line.rstrip() for line in body.strip().splitlines())


SQL: dict[str, str] = {}

SQL["codebase_growth"] = _q("""
with p as (
  select source as repo, doc_id // 60 as pos,
         sha1(source || ':' || cast(doc_id // 60 as varchar)) as hash,
         'd' || cast(doc_id as varchar) ||
           case lang when 'en' then '.py' when 'de' then '.smk' else '.txt' end as a_path,
         text as patch
  from documents),
s as (
  select repo, pos, hash,
         cast(sum(case when a_path like '%.py' or a_path like '%.smk'
                       then strlen(patch) else 0 end) as bigint) as commit_size
  from p group by repo, pos, hash)
select repo, pos, hash, commit_size,
       cast(sum(commit_size) over (partition by repo order by pos
            rows between unbounded preceding and current row) as bigint) as codebase_size
from s
""")

SQL["commit_order"] = _q(f"""
with {CYCLE_ROWS}
select owner, repo, hash, cast(idx as bigint) as idx, round(committer_epoch, 6) as committer_epoch,
       prev_hash, round(next_epoch - committer_epoch, 6) as gap_next_seconds
from j
""")

SQL["commit_bursts"] = _q(f"""
with {CYCLE_ROWS}
select owner, repo, hash, cast(idx as bigint) as idx, cast(burst_no as bigint) as burst_no,
       burst_start, burst_end,
       cast(floor((next_epoch - committer_epoch) / 86400) as bigint) as gap_next_days
from j
""")

SQL["evolution_cycles"] = _q(f"""
with {CYCLES}
select owner, repo, cast(cycle_no as bigint) as cycle_no, begin_hash, round(begin_epoch, 6) as begin_epoch,
       end_hash, round(end_epoch, 6) as end_epoch,
       cast(floor((end_epoch - begin_epoch) / 86400) as bigint) as diff_days,
       cast(floor((end_epoch - begin_epoch) / 60) as bigint) as diff_mins,
       cast(floor((end_epoch - begin_epoch) / 3600) as bigint) as diff_hours,
       cast(n_commits as bigint) as n_commits,
       cast(n_commits_snakemake_related as bigint) as n_commits_snakemake_related,
       cast(n_snakemake_rules_added as bigint) as n_snakemake_rules_added,
       cast(n_snakemake_rules_removed as bigint) as n_snakemake_rules_removed,
       cast(n_snakemake_modules_added as bigint) as n_snakemake_modules_added,
       cast(n_snakemake_modules_removed as bigint) as n_snakemake_modules_removed,
       array_to_string(exts, ',') as file_extensions, is_closed
from cyc
""")

SQL["repo_workflow_summary"] = _q(f"""
with {CYCLES},
rel as (select owner, repo, count(*) filter (where related) as n_commits_snakemake_related
        from c group by owner, repo),
nc as (select owner, repo, count(*) as n_evolution_cycles from cyc group by owner, repo)
select rel.owner, rel.repo, cast(rel.n_commits_snakemake_related as bigint) as n_commits_snakemake_related,
       cast(coalesce(nc.n_evolution_cycles, 0) as bigint) as n_evolution_cycles
from rel left join nc on rel.owner = nc.owner and rel.repo = nc.repo
""")


V_CODE = """
select 'acme' as owner, source as repo, sha1(source || ':' || cast(doc_id // 60 as varchar)) as hash,
       doc_id as pos,
       case lang when 'en' then 'Snakefile'
                 when 'de' then 'rules/' || cast(doc_id as varchar) || '.smk'
                 when 'es' then 'workflow/scripts/' || cast(doc_id as varchar) || '.py'
                 else 'docs/' || cast(doc_id as varchar) || '.txt' end as new_path,
       text as source_code,
       lag(text) over (partition by source order by doc_id) as source_code_before
from documents
"""


def _names(code: str, kw: str) -> str:
    """Second token, cut at ':', of stripped lines starting with kw + blank."""
    return (f"list_transform(list_filter(list_transform(string_split(coalesce({code}, ''), chr(10)),"
            f" lambda l: trim(l)), lambda l: starts_with(l, '{kw} ')),"
            f" lambda l: split_part(string_split_regex(l, '\\s+')[2], ':', 1))")


def _includes(code: str, regular: bool) -> str:
    """Blank-separated include stand-in: 2nd word of lines starting 'The ', quotes gone."""
    cond = "ends_with(x, '.')" if regular else "not ends_with(x, '.')"
    return (f"list_filter(list_transform(list_filter(list_transform(string_split(coalesce({code}, ''),"
            f" chr(10)), lambda l: trim(l)), lambda l: starts_with(l, 'The ')),"
            f" lambda l: replace(replace(trim(string_split(l, ' ')[2]), '\"', ''), '''', '')),"
            f" lambda x: x <> '' and {cond})")


for _name, _expr in (("rule_names", _names("source_code", "The")),
                     ("module_names", _names("source_code", "And")),
                     ("included_files", _includes("source_code", True)),
                     ("irregular_includes", _includes("source_code", False))):
    SQL[_name] = _q(f"""
with v as ({V_CODE}), n as (select repo, pos, {_expr} as names from v)
select repo, pos, cast(len(names) as bigint) as n_names, array_to_string(names, '|') as names from n
""")

CODE_WF = f"""
v as ({V_CODE}),
w as (
  select *, (lower(split_part(new_path, '/', -1)) = 'snakefile'
             or lower(new_path) similar to '.*\\.(smk|snakefile|rules)') as is_rule,
         split_part(new_path, '/', -1) as filename
  from v),
x as (
  select *, (not is_rule and new_path is not null and (lower(new_path) like 'scripts/%'
             or lower(new_path) like 'workflow/scripts/%')) as is_script,
         case when is_rule then {_names('source_code', 'The')} else [] end as ra_l,
         case when is_rule then {_names('source_code_before', 'The')} else [] end as rb_l,
         case when is_rule then {_names('source_code', 'And')} else [] end as ma_l,
         case when is_rule then {_names('source_code_before', 'And')} else [] end as mb_l,
         case when is_rule then {_includes('source_code', True)} else [] end as inc_l,
         case when is_rule then {_includes('source_code', False)} else [] end as irr_l
  from w)
"""

SQL["rule_diff_occurrences"] = _q(f"""
with {CODE_WF}
select repo, pos, new_path, (is_rule or is_script) as snakemake_related,
       cast(len(list_filter(ra_l, lambda e: not list_contains(rb_l, e)))
          + len(list_filter(ma_l, lambda e: not list_contains(mb_l, e))) as bigint) as snakemake_n_rules_added,
       cast(len(list_filter(rb_l, lambda e: not list_contains(ra_l, e)))
          + len(list_filter(mb_l, lambda e: not list_contains(ma_l, e))) as bigint) as snakemake_n_rules_removed,
       cast(0 as bigint) as snakemake_n_modules_added, cast(0 as bigint) as snakemake_n_modules_removed
from x
""")

SQL["rule_diff_sets"] = _q(f"""
with {CODE_WF},
y as (
  select owner, repo, hash, bool_or(is_rule or is_script) as rel,
         list_sort(list_distinct(flatten(list(ra_l)))) as ra,
         list_sort(list_distinct(flatten(list(rb_l)))) as rb,
         list_sort(list_distinct(flatten(list(ma_l)))) as ma,
         list_sort(list_distinct(flatten(list(mb_l)))) as mb,
         list_sort(list_distinct(flatten(list(inc_l)))) as inc,
         list_sort(list_distinct(list(new_path) filter (where is_script))) as scr,
         list_sort(list_distinct(flatten(list(irr_l)))) as irr,
         list_sort(list_distinct(list(new_path) filter (where is_rule))) as rf
  from x group by owner, repo, hash)
select owner, repo, hash, rel as snakemake_related,
       array_to_string(ra, ',') as snakemake_rules_from_code,
       array_to_string(rb, ',') as snakemake_rules_from_code_before,
       array_to_string(ma, ',') as snakemake_modules_from_code,
       array_to_string(mb, ',') as snakemake_modules_from_code_before,
       array_to_string(inc, ',') as snakemake_included_rules,
       array_to_string(coalesce(scr, []), ',') as snakemake_included_scripts,
       array_to_string(irr, ',') as snakemake_irregular_rule_files,
       array_to_string(coalesce(rf, []), ',') as snakemake_rule_files,
       cast(len(list_filter(ra, lambda e: not list_contains(rb, e))) as bigint) as snakemake_n_rules_added,
       cast(len(list_filter(rb, lambda e: not list_contains(ra, e))) as bigint) as snakemake_n_rules_removed,
       cast(len(list_filter(ma, lambda e: not list_contains(mb, e))) as bigint) as snakemake_n_modules_added,
       cast(len(list_filter(mb, lambda e: not list_contains(ma, e))) as bigint) as snakemake_n_modules_removed
from y
""")

V_FILES = """
select o_orderpriority as repo, cast(o_orderkey as varchar) as hash,
       'a' || cast(o_custkey % 50 as varchar) as author,
       epoch_us(o_orderdate) / cast(1000000 as double) as committer_epoch,
       case when l_partkey % 200 = 0 then 'Snakefile'
            else 'f' || cast(l_partkey % 200 as varchar) ||
                 case l_returnflag when 'R' then '.smk' when 'A' then '.py' else '.txt' end end as filename,
       cast(l_quantity as bigint) as n_added_lines,
       cast(round(l_tax * 100) as bigint) as n_deleted_lines,
       case l_returnflag when 'R' then 'DELETE' when 'A' then 'ADD' else 'MODIFY' end as change_type,
       l_linestatus, l_linenumber as line_no,
       case when l_linestatus = 'F' then 'workflow/scripts/' else 'src/' end ||
       case when l_partkey % 200 = 0 then 'Snakefile'
            else 'f' || cast(l_partkey % 200 as varchar) ||
                 case l_returnflag when 'R' then '.smk' when 'A' then '.py' else '.txt' end end as new_path
from lineitem join orders on l_orderkey = o_orderkey
"""

SQL["file_extensions"] = _q(f"""
with f as ({V_FILES}),
e as (select *, case when instr(filename, '.') > 0
                     then lower(regexp_extract(filename, '\\.([^.]*)$', 1)) end as ext from f)
select repo, hash,
       array_to_string(list_sort(list_distinct(coalesce(list(ext) filter (where ext <> ''), []))), ',')
         as file_extensions,
       array_to_string(list_sort(list_distinct(list(change_type))), ',') as change_types
from e group by repo, hash
""")

SQL["script_paths"] = _q(f"""
with f as ({V_FILES}),
p as (select *, case when l_linestatus = 'F' then 'workflow/scripts/' else 'src/' end || filename as new_path,
             (lower(filename) = 'snakefile' or lower(filename) similar to '.*\\.(smk|snakefile|rules)') as is_rule
      from f),
s as (select *, (not is_rule and (lower(new_path) like 'scripts/%' or lower(new_path) like 'workflow/scripts/%'))
               as is_script from p)
select repo, hash, bool_or(is_rule or is_script) as snakemake_related,
       array_to_string(list_sort(list_distinct(coalesce(list(new_path) filter (where is_rule), []))), ',') as rule_files,
       array_to_string(list_sort(list_distinct(coalesce(list(new_path) filter (where is_script), []))), ',')
         as included_scripts
from s group by repo, hash
""")


FILE_METRICS = f"""
f as ({V_FILES}),
ch as (select repo, new_path as path, hash, sum(n_added_lines) as added, sum(n_deleted_lines) as removed,
              any_value(author) as author
       from f group by repo, new_path, hash),
pa as (select repo, path, author, sum(added + removed) as lines from ch group by repo, path, author),
au as (select repo, path, count(*) as n_auth, sum(lines) as total, max(lines) as top from pa group by repo, path),
mi as (select pa.repo, pa.path,
              count(*) filter (where au.total > 0 and cast(pa.lines as double) / au.total < 0.05) as minor
       from pa join au on pa.repo = au.repo and pa.path = au.path group by pa.repo, pa.path),
fm as (
  select ch.repo, ch.path, count(*) as commitscount_files,
         sum(added - removed) as codechurn_count, max(added - removed) as codechurn_max,
         avg(added - removed) as codechurn_avg,
         sum(added) as codechurn_added_lines, sum(removed) as codechurn_removed_lines,
         sum(added + removed) as linescount_count, sum(added) as linescount_count_added,
         max(added) as linescount_max_added, avg(added) as linescount_avg_added,
         sum(removed) as linescount_count_removed, max(removed) as linescount_max_removed,
         avg(removed) as linescount_avg_removed
  from ch group by ch.repo, ch.path),
allm as (
  select fm.*, au.n_auth as contributorscount_count, mi.minor as contributorscount_minor,
         case when au.total > 0 then cast(au.top as double) * 100 / au.total else 0 end
           as contributorsexperience_count
  from fm join au on fm.repo = au.repo and fm.path = au.path
          join mi on fm.repo = mi.repo and fm.path = mi.path)
"""

SQL["changeset_stats"] = _q(f"""
with f as ({V_FILES}),
ch as (select repo, hash, count(distinct new_path) as n_files from f group by repo, hash)
select repo, cast(max(n_files) as bigint) as changeset_max, round(avg(n_files), 6) as changeset_avg
from ch group by repo
""")

SQL["code_churn"] = _q(f"""
with {FILE_METRICS}
select repo, path, cast(codechurn_count as bigint) as codechurn_count,
       cast(codechurn_max as bigint) as codechurn_max, round(codechurn_avg, 6) as codechurn_avg,
       cast(codechurn_added_lines as bigint) as codechurn_added_lines,
       cast(codechurn_removed_lines as bigint) as codechurn_removed_lines
from allm
""")

SQL["commits_per_file"] = _q(f"""
with {FILE_METRICS}
select repo, path, cast(commitscount_files as bigint) as commitscount_files from allm
""")

SQL["contributors_per_file"] = _q(f"""
with {FILE_METRICS}
select repo, path, cast(contributorscount_count as bigint) as contributorscount_count,
       cast(contributorscount_minor as bigint) as contributorscount_minor from allm
""")

SQL["contributor_experience"] = _q(f"""
with {FILE_METRICS}
select repo, path, round(contributorsexperience_count, 6) as contributorsexperience_count from allm
""")

SQL["line_counts"] = _q(f"""
with {FILE_METRICS}
select repo, path, cast(linescount_count as bigint) as linescount_count,
       cast(linescount_count_added as bigint) as linescount_count_added,
       cast(linescount_max_added as bigint) as linescount_max_added,
       round(linescount_avg_added, 6) as linescount_avg_added,
       cast(linescount_count_removed as bigint) as linescount_count_removed,
       cast(linescount_max_removed as bigint) as linescount_max_removed,
       round(linescount_avg_removed, 6) as linescount_avg_removed
from allm
""")

SQL["hunks_median"] = _q(f"""
with v as ({V_CODE}),
h as (select repo, new_path as path, hash,
             sum(len(regexp_extract_all(source_code, '(?m)(?:^[TA][^\n]*(?:\n|$))+'))) as hunks
      from v group by repo, new_path, hash)
select repo, path, round(median(hunks), 6) as hunkscount_files from h group by repo, path
""")


SQL["repo_totals"] = _q(f"""
with c as ({V_COMMITS}),
a as (select owner, repo, count(*) as n, count(distinct hash) as nd, count(distinct author) as na,
             count(distinct committer) as nc, least(1767225600, min(committer_epoch)) as fe,
             greatest(0, max(committer_epoch)) as le,
             arg_min(committer_date, committer_epoch) as fd, arg_max(committer_date, committer_epoch) as ld
      from c group by owner, repo)
select owner, repo, cast(n as bigint) as x_total_commits, cast(nd as bigint) as n_commits_distinct,
       cast(na as bigint) as n_authors, cast(nc as bigint) as n_committers,
       round(fe, 6) as first_commit_at_epoch, round(le, 6) as last_commit_at_epoch,
       case when fe > 0 then strftime(make_timestamp(cast(floor(fe) as bigint) * 1000000),
                                      '%Y-%m-%dT%H:%M:%S') || ' ' end as first_commit_at,
       case when le > 0 then strftime(make_timestamp(cast(floor(le) as bigint) * 1000000),
                                      '%Y-%m-%dT%H:%M:%S') || ' ' end as last_commit_at,
       fd as first_committer_date, ld as last_committer_date
from a
""")

SQL["repo_distincts_merged"] = _q(f"""
with c as ({V_COMMITS})
select owner, repo, cast(count(distinct hash) as bigint) as n_commits_distinct,
       cast(count(distinct author) as bigint) as n_authors, cast(count(distinct committer) as bigint) as n_committers
from c group by owner, repo
""")

ISSUES = """
it as (select conv_id, max(turn) as max_turn, arg_min(role, turn) as opener,
              1704067200 + (conv_id * 2621189) % 2592000 as ce
       from conversations group by conv_id),
iss as (select 'acme' as owner, 'r' || cast(conv_id % 150 as varchar) as repo, conv_id as number, ce,
               case when max_turn >= 3 then ce + max_turn * 3600 end as xe, opener as login, max_turn
        from it),
com as (select 'acme' as owner, 'r' || cast(cv.conv_id % 150 as varchar) as repo, cv.conv_id as number,
               it.ce + cv.turn * 1800 as e, cv.role as login
        from conversations cv join it on cv.conv_id = it.conv_id where cv.turn > 0),
iev as (select 'acme' as owner, 'r' || cast(cv.conv_id % 150 as varchar) as repo, cv.conv_id as number,
               case when cv.turn % 4 = 1 then 'labeled' else 'assigned' end as event,
               it.ce + cv.turn * 1800 + 60 as e,
               case when cv.turn = 1 then null else cv.role end as login
        from conversations cv join it on cv.conv_id = it.conv_id
        where cv.turn > 0 and cv.role = 'assistant'),
pr as (select 'acme' as owner, 'r' || cast(user_id as varchar) as repo, event_id + 100000 as number,
              cast(floor(epoch_us(ts) / cast(1000000 as double)) as bigint) - 7200 as ce,
              case when event_id % 8 = 4 then null
                   when event_id % 12 = 8 then sha1('x' || cast(event_id as varchar))
                   else sha1(cast(event_id as varchar)) end as sha,
              'u' || cast(user_id as varchar) as login
       from events where event_type = 'purchase')
"""


def _gh(e: str) -> str:
    return f"strftime(make_timestamp(cast({e} as bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"


ACTS = {
    "issues": f"""
      select owner, repo, 'Issue-' || cast(number as varchar) as case_id, 'Issue Created' as activity,
             ce as t, {_gh('ce')} as timestamp, login as "user" from iss
      union all
      select owner, repo, 'Issue-' || cast(number as varchar), 'Issue Closed', xe, {_gh('xe')}, login
      from iss where xe is not null""",
    "comments": f"""
      select owner, repo, 'Issue-' || cast(number as varchar) as case_id, 'Issue Commented' as activity,
             e as t, {_gh('e')} as timestamp, login as "user" from com""",
    "events": f"""
      select owner, repo, 'Issue-' || cast(number as varchar) as case_id, event as activity,
             e as t, {_gh('e')} as timestamp, login as "user" from iev""",
    "commits": """
      select owner, repo, 'Commit-' || left(hash, 7) as case_id, 'Committed' as activity,
             cast(floor(committer_epoch) as bigint) as t,
             case when floor(committer_epoch) > 0 then
               strftime(make_timestamp(cast(floor(committer_epoch) as bigint) * 1000000),
                        '%Y-%m-%dT%H:%M:%S') || ' ' end as timestamp,
             committer as "user" from c""",
    "prs": f"""
      select owner, repo, 'Issue-' || cast(number as varchar) as case_id, 'Pull Request Opened' as activity,
             ce as t, {_gh('ce')} as timestamp, login as "user" from pr""",
}


def _attached(kinds: list[str]) -> str:
    acts = "\n      union all\n".join(f"select * from ({ACTS[k]})" for k in kinds)
    return f"""
with {CYCLES}, {ISSUES},
act as ({acts})
select a.owner, a.repo, cast(y.cycle_no as bigint) as cycle_no, a.case_id,
       case when a.activity = 'Committed' and a.case_id like 'Commit-%'
                 and (y.n_snakemake_rules_added > 0 or y.n_snakemake_modules_added > 0)
            then 'Committed-Snakemake' else a.activity end as activity,
       cast(a.t as bigint) as t, a.timestamp, a."user"
from act a join cyc y on a.owner = y.owner and a.repo = y.repo
                     and a.t >= y.begin_epoch and a.t <= y.end_epoch
"""


for _k in ("issues", "comments", "events", "commits", "prs"):
    SQL[f"eventlog_{_k}"] = _q(_attached([_k]))

PR_COMMITS = f"""
par as (
  select owner, repo, hash, idx, committer_date, committer_epoch,
         case when event_id % 10 = 0 and idx >= 5 then [lag(hash, 5) over w, lag(hash, 1) over w]
              when event_id % 10 = 5 and idx >= 3
                then [lag(hash, 1) over w, lag(hash, 2) over w, lag(hash, 3) over w]
              when idx >= 1 then [lag(hash, 1) over w]
              else [] end as parents
  from o window w as (partition by owner, repo order by committer_epoch, hash)),
m as (select pr.owner, pr.repo, pr.number, pr.login, par.parents
      from pr join par on pr.owner = par.owner and pr.repo = par.repo and pr.sha = par.hash
      where len(par.parents) > 0),
e08 as (select m.owner, m.repo, 'Issue-' || cast(m.number as varchar) as case_id, 'Committed' as activity,
               cast(floor(p.committer_epoch) as bigint) as t, p.committer_date as timestamp,
               m.login as "user", p.hash as commit_hash
        from m join par p on m.owner = p.owner and m.repo = p.repo and p.hash = m.parents[1]
        where len(m.parents) = 1),
rng as (select m.owner, m.repo, m.number, m.login, b.idx as bi, e.idx as ei
        from m join par b on m.owner = b.owner and m.repo = b.repo and b.hash = m.parents[1]
               join par e on m.owner = e.owner and m.repo = e.repo and e.hash = m.parents[2]
        where len(m.parents) = 2 and b.idx < e.idx),
e09 as (select r.owner, r.repo, 'Issue-' || cast(r.number as varchar) as case_id, 'Committed' as activity,
               cast(floor(x.committer_epoch) as bigint) as t, x.committer_date as timestamp,
               r.login as "user", x.hash as commit_hash
        from rng r join par x on r.owner = x.owner and r.repo = x.repo and x.idx >= r.bi and x.idx < r.ei),
prc as (select * from e08 union all select * from e09)
"""

SQL["eventlog_pr_commits"] = _q(f"""
with {CYCLE_ROWS}, {ISSUES}, {PR_COMMITS}
select owner, repo, case_id, activity, t, timestamp, "user", commit_hash from prc
""")

_ALL = _attached(["issues", "comments", "events", "commits", "prs"]).strip()
_ALL_HEAD, _ALL_BODY = _ALL.split("\nselect a.owner", 1)
SQL["eventlog_all"] = _q(f"""
{_ALL_HEAD}, {PR_COMMITS}
select a.owner{_ALL_BODY}
union all
select owner, repo, cast(null as bigint) as cycle_no, case_id, activity, t, timestamp, "user" from prc
""")

CUST = """
cu as (select 'c' || cast(c_custkey as varchar) as repo, c_name as full_name, c_acctbal, c_mktsegment
       from customer),
orr as (select 'c' || cast(o_custkey as varchar) as repo, o_orderstatus from orders)
"""

SQL["require_semi"] = _q(f"""
with {CUST}
select repo, full_name from cu
where exists (select 1 from orr where orr.repo = cu.repo) and c_acctbal >= 0
""")

SQL["reject_anti"] = _q(f"""
with {CUST},
miss as (select repo, 'no commits' as reason from cu where not exists (select 1 from orr where orr.repo = cu.repo)
         union all
         select repo, 'no repo info' from cu where c_acctbal < 0)
select 'extend_repositories_info' as stage, repo, min(reason) as reason from miss group by repo
""")

SQL["resume_anti"] = _q(f"""
with {CUST}
select repo, full_name from cu where c_mktsegment <> 'BUILDING'
""")

SQL["skiplist_anti"] = _q(f"""
with {CUST},
sk as (select full_name from cu where c_acctbal < 0 union select full_name from cu where c_mktsegment = 'AUTOMOBILE')
select repo, full_name from cu where full_name not in (select full_name from sk)
""")

SQL["allowlist_semi"] = _q(f"""
with {CUST}
select repo, full_name from cu
where full_name in (select cu2.full_name from orr join cu cu2 on orr.repo = cu2.repo where orr.o_orderstatus = 'F')
""")

SQL["entity_counts_joined"] = _q(f"""
with c as ({V_COMMITS}), {ISSUES},
rp as (select distinct owner, repo from c),
cnt as (
  select owner, repo, 'commits' as k from c
  union all select owner, repo, 'issues' from iss
  union all select owner, repo, 'issue_events' from iev
  union all select owner, repo, 'issue_comments' from com
  union all select owner, repo, 'pull_requests' from pr
  union all select 'acme', 'r' || cast(page_id % 150 as varchar), 'pages' from pages)
select rp.owner, rp.repo,
       cast(count(k) filter (where k = 'commits') as bigint) as x_total_commits,
       cast(count(k) filter (where k = 'issues') as bigint) as x_total_issues,
       cast(count(k) filter (where k = 'issue_events') as bigint) as x_total_issue_events,
       cast(count(k) filter (where k = 'issue_comments') as bigint) as x_total_issue_comments,
       cast(count(k) filter (where k = 'pull_requests') as bigint) as x_total_pull_requests,
       cast(count(k) filter (where k = 'pages') as bigint) as x_total_pages
from rp left join cnt on rp.owner = cnt.owner and rp.repo = cnt.repo
group by rp.owner, rp.repo
""")


SPANS = """
sp as (select o_orderpriority as repo, o_orderstatus as status, cast(min(o_orderdate) as date) as s,
              cast(max(o_orderdate) as date) as e
       from orders group by o_orderpriority, o_orderstatus)
"""

SQL["date_ranges_month"] = _q(f"""
with {SPANS},
m as (select repo, status, s, e, cast(unnest(generate_series(date_trunc('month', s), date_trunc('month', e),
                                                              interval 1 month)) as date) as m from sp)
select repo, status, cast(greatest(m, s) as varchar) as range_start,
       cast(least(cast(last_day(m) as date), e) as varchar) as range_end from m
""")

SQL["date_ranges_week"] = _q(f"""
with {SPANS},
w as (select repo, status, s, e, cast(unnest(generate_series(cast(date_trunc('week', s) as date), e,
                                                              interval 7 day)) as date) as w from sp)
select repo, status, cast(w as varchar) as range_start,
       cast(least(cast(w + interval 6 day as date), e) as varchar) as range_end from w
""")

SQL["date_ranges_day"] = _q(f"""
with {SPANS},
d as (select repo, status, cast(unnest(generate_series(s, e, interval 1 day)) as date) as d from sp)
select repo, status, cast(d as varchar) as range_start, cast(d as varchar) as range_end from d
""")

SQL["upsert_latest"] = _q("""
with r as (select p_partkey % 500 as id, p_name as name, p_brand || '/' || p_name as full_name,
                  'https://example.org/' || p_brand as html_url, p_type as description,
                  cast(p_size as bigint) as stargazers_count, cast(floor(p_retailprice) as bigint) as forks_count,
                  p_partkey as load_order
           from part),
a as (select * from r where full_name in (select full_name from r where not starts_with(full_name, 'Brand#55/')))
select id, arg_max(name, load_order) as name, arg_max(full_name, load_order) as full_name,
       arg_max(html_url, load_order) as html_url, arg_max(description, load_order) as description,
       arg_max(stargazers_count, load_order) as stargazers_count,
       arg_max(forks_count, load_order) as forks_count, max(load_order) as load_order
from a group by id
""")

SQL["key_by_last"] = _q("""
select user_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type
from events group by user_id
""")

SQL["split_full_name"] = _q("""
with p as (select page_id, url,
                  regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]+/', '') as full_name
           from pages),
s as (select *, string_split(trim(full_name), '/') as parts from p)
select page_id, full_name,
       case when len(parts) = 2 then parts[1] end as owner,
       case when len(parts) = 2 then parts[2] end as repo,
       len(parts) = 2 as valid,
       coalesce(instr(full_name, '/') > 1, false) as is_full_name,
       length(sha1(url)) = 40 as hash_ok,
       string_split(url, '/')[-1] as last_segment
from s
""")

SQL["drop_url_columns"] = _q("""
select page_id as id, url as homepage, cast(length(html) as integer) as size, 'acme' as owner from pages
""")

LOGL = """
ll as (select unnest(case when o_orderkey % 5 = 0 then ['g' || cast(o_orderkey % 7 as varchar), 'fork']
                          else ['g' || cast(o_orderkey % 7 as varchar)] end) as repo,
              sha1('o' || cast(o_orderkey as varchar)) as hash, 'a' || cast(o_custkey as varchar) as author,
              o_orderstatus as committer, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' +0000' as date,
              'order ' || cast(o_orderkey as varchar) || case when o_orderkey % 50 = 0 then ' | hotfix' else '' end
                as subject,
              case when o_orderkey % 97 = 1 then ''
                   when o_orderkey % 7 = 0 then sha1('o' || cast(o_orderkey - 1 as varchar)) || ' ' ||
                                                sha1('o' || cast(o_orderkey - 2 as varchar))
                   else sha1('o' || cast(o_orderkey - 1 as varchar)) end as parents
       from orders),
lg as (select repo as repo_name, hash as commit_hash, author, committer, date, subject as message,
              parents as parent_commit from ll),
ns as (select unnest(case when l_orderkey % 5 = 0 then ['g' || cast(l_orderkey % 7 as varchar), 'fork']
                          else ['g' || cast(l_orderkey % 7 as varchar)] end) as repo_name,
              sha1('o' || cast(l_orderkey as varchar)) as commit_hash,
              case when l_returnflag = 'R' then '-' when l_returnflag = 'A' and l_linenumber = 6 then 'bin'
                   else cast(cast(l_quantity as bigint) as varchar) end as a,
              case when l_linestatus = 'O' and l_linenumber = 7 then 'x'
                   else cast(cast(round(l_tax * 100) as bigint) as varchar) end as d,
              'src/f' || cast(l_partkey % 200 as varchar) || '.py' as path
       from lineitem),
nv as (select repo_name, commit_hash, path,
              case when a = '-' then 0 else try_cast(a as bigint) end as av,
              case when d = '-' then 0 else try_cast(d as bigint) end as dv from ns),
nt as (select repo_name, commit_hash, cast(coalesce(sum(av), 0) as bigint) as lines_added,
              cast(coalesce(sum(case when av is not null then dv end), 0) as bigint) as lines_deleted,
              array_to_string(list_sort(list(path)), ',') as files
       from nv group by repo_name, commit_hash)
"""

SQL["log_lines_parsed"] = _q(f"""
with {LOGL}
select * from lg
""")

SQL["numstat_totals"] = _q(f"""
with {LOGL}
select repo_name, commit_hash, lines_added, lines_deleted from nt
""")

COMMIT_ROW = """
select lg.repo_name, lg.commit_hash, lg.author, lg.committer, lg.date, lg.message, lg.parent_commit,
       {branch} as branch, {tags} as tags, coalesce(nt.files, 'unknown') as changed_files,
       coalesce(nt.lines_added, 0) as lines_added, coalesce(nt.lines_deleted, 0) as lines_deleted,
       len(string_split(lg.parent_commit, ' ')) > 1 as is_merge_commit,
       case when len(string_split(lg.parent_commit, ' ')) > 1 then {merged} end as merged_branch
from lg left join nt on lg.repo_name = nt.repo_name and lg.commit_hash = nt.commit_hash
"""

SQL["git_commits"] = _q(f"""
with {LOGL}
{COMMIT_ROW.format(branch="'unknown'", tags="''", merged="''")}
""")

SQL["git_commits_with_refs"] = _q(f"""
with {LOGL},
rf as (select 'g' || cast(o_orderkey % 7 as varchar) as repo_name, sha1('o' || cast(o_orderkey as varchar)) as commit_hash,
              o_orderkey as k from orders),
tg as (select repo_name, commit_hash,
              case when k % 22 = 0 then 'latest,' else '' end || 'v' || cast(k as varchar) as tags from rf where k % 11 = 0),
br as (select repo_name, commit_hash, 'main~' || cast(k as varchar) as branch from rf where k % 3 = 0)
{COMMIT_ROW.format(branch="coalesce(br.branch, 'unknown')", tags="coalesce(tg.tags, '')", merged="coalesce(b0.branch, '')")}
left join tg on lg.repo_name = tg.repo_name and lg.commit_hash = tg.commit_hash
left join br on lg.repo_name = br.repo_name and lg.commit_hash = br.commit_hash
left join br b0 on lg.repo_name = b0.repo_name and string_split(lg.parent_commit, ' ')[1] = b0.commit_hash
""")

SQL["log_rejects"] = _q(f"""
with {LOGL}
select 'commit_log' as stage, repo_name,
       concat_ws('|', commit_hash, author, committer, date, message, parent_commit) as line, 'bar in a field' as reason
from lg where contains(message, '|')
""")


SQL["eventlog_rejects"] = _q(f"""
with {CYCLE_ROWS}, {ISSUES}, {PR_COMMITS},
dt as (
  select owner, repo, 'issue' as kind, number as id from iss
  union all
  select 'acme', 'r' || cast(conv_id % 150 as varchar), 'comment', conv_id * 1000 + turn from conversations where turn > 0
  union all
  select 'acme', 'r' || cast(conv_id % 150 as varchar), 'issue_event', conv_id * 1000 + turn
  from conversations where turn > 0 and role = 'assistant'
  union all
  select owner, repo, 'pull_request', number from pr),
known as (select par.* from par join o on par.owner = o.owner and par.repo = o.repo and par.hash = o.hash
          where o.event_id % 13 <> 0),
mp as (select pr.owner, pr.repo, pr.number, unnest(known.parents) as parent
       from pr join known on pr.owner = known.owner and pr.repo = known.repo and pr.sha = known.hash)
select 'event_log' as stage, owner, repo, kind, cast(id as varchar) as id,
       case when id % 9 = 0 then 'malformed created_at' else 'no created_at' end as reason
from dt where id % 9 in (0, 1)
union all
select 'event_log', owner, repo, 'issue', cast(number as varchar), 'malformed closed_at' from iss where number % 7 = 3
union all
select 'event_log', pr.owner, pr.repo, 'pull_request', cast(pr.number as varchar), 'merge commit not found'
from pr where sha is not null and not exists (
  select 1 from known k where k.owner = pr.owner and k.repo = pr.repo and k.hash = pr.sha)
union all
select distinct 'event_log', mp.owner, mp.repo, 'pull_request', cast(mp.number as varchar), 'parent commit not found'
from mp where not exists (
  select 1 from known k where k.owner = mp.owner and k.repo = mp.repo and k.hash = mp.parent)
""")

SQL["upsert_existing"] = _q("""
select page_id as id, case when page_id % 3 <> 0 or page_id % 2 = 0 then url else 'old' end as name,
       'o/' || cast(page_id % 40 as varchar) as full_name, length(url) as stargazers_count, length(html) as forks_count,
       case when page_id % 3 = 0 then 'n' || cast(page_id as varchar) end as note
from pages
""")

SQL["written_keys"] = _q("""
select distinct 'o/' || cast(page_id % 40 as varchar) as full_name from pages where page_id % 40 < 25
""")


GRAPH = f"""
{CYCLE_ROWS}, {ISSUES}, {PR_COMMITS},
edges as (select owner, repo, hash as child, unnest(parents) as parent from par),
refs as (select owner, repo, hash, 'v' || cast(event_id as varchar) as ref from o where ra = 1)
"""

SQL["nearest_ref"] = _q(f"""
with recursive {GRAPH},
walk(owner, repo, hash, ref, depth) as (
  select owner, repo, hash, ref, 0 from refs
  union
  select w.owner, w.repo, e.parent, w.ref, w.depth + 1
  from walk w join edges e on w.owner = e.owner and w.repo = e.repo and e.child = w.hash),
best as (select *, row_number() over (partition by owner, repo, hash order by depth, ref) as rn from walk)
select owner, repo, hash, ref, cast(depth as bigint) as depth,
       case when depth = 0 then ref else ref || '~' || cast(depth as varchar) end as name
from best where rn = 1
""")

SQL["tags_containing"] = _q(f"""
with recursive {GRAPH},
walk(owner, repo, hash, tag) as (
  select owner, repo, hash, ref from refs
  union
  select w.owner, w.repo, e.parent, w.tag
  from walk w join edges e on w.owner = e.owner and w.repo = e.repo and e.child = w.hash)
select owner, repo, hash as commit_hash, tag from walk
""")


SQL["issue_comment_counts"] = _q(f"""
with {ISSUES},
r as (select i.owner, i.repo, i.number, 'comment' as kind
      from iss i join com c on i.owner = c.owner and i.repo = c.repo and i.number = c.number
      where coalesce(i.max_turn, 0) <> 0
      union all
      select i.owner, i.repo, i.number, 'event'
      from iss i join iev e on i.owner = e.owner and i.repo = e.repo and i.number = e.number)
select owner, repo, number, cast(count(*) filter (where kind = 'comment') as bigint) as n_comments,
       cast(count(*) filter (where kind = 'event') as bigint) as n_events
from r group by owner, repo, number
""")


SQL["repo_info_extended"] = _q(f"""
with {CYCLES}, {ISSUES},
rp as (select distinct owner, repo, owner || '/' || repo as full_name from c),
cnt as (
  select owner, repo, 'issues' as k from iss
  union all select owner, repo, 'issue_events' from iev
  union all select owner, repo, 'issue_comments' from com
  union all select owner, repo, 'pull_requests' from pr
  union all select 'acme', 'r' || cast(page_id % 150 as varchar), 'pages' from pages),
ec as (
  select rp.owner, rp.repo, rp.full_name,
         count(k) filter (where k = 'issues') as x_total_issues,
         count(k) filter (where k = 'issue_events') as x_total_issue_events,
         count(k) filter (where k = 'issue_comments') as x_total_issue_comments,
         count(k) filter (where k = 'pull_requests') as x_total_pull_requests,
         count(k) filter (where k = 'pages') as x_total_pages
  from rp left join cnt on rp.owner = cnt.owner and rp.repo = cnt.repo
  group by rp.owner, rp.repo, rp.full_name),
gs as (select owner, repo, count(*) as n, count(distinct author) as na, count(distinct committer) as nc,
             least(1767225600, min(committer_epoch)) as fe, greatest(0, max(committer_epoch)) as le,
             count(*) filter (where related) as nrel
      from c group by owner, repo),
nc as (select owner, repo, count(*) as n_evolution_cycles from cyc group by owner, repo)
select ec.owner, ec.repo, ec.full_name, cast(gs.n as bigint) as x_total_commits,
       cast(ec.x_total_issues as bigint) as x_total_issues,
       cast(ec.x_total_issue_events as bigint) as x_total_issue_events,
       cast(ec.x_total_issue_comments as bigint) as x_total_issue_comments,
       cast(ec.x_total_pull_requests as bigint) as x_total_pull_requests,
       cast(ec.x_total_pages as bigint) as x_total_pages,
       cast(gs.na as bigint) as n_authors, cast(gs.nc as bigint) as n_committers,
       round(gs.fe, 6) as first_commit_at_epoch, round(gs.le, 6) as last_commit_at_epoch,
       case when gs.fe > 0 then strftime(make_timestamp(cast(floor(gs.fe) as bigint) * 1000000),
                                        '%Y-%m-%dT%H:%M:%S') || ' ' end as first_commit_at,
       case when gs.le > 0 then strftime(make_timestamp(cast(floor(gs.le) as bigint) * 1000000),
                                        '%Y-%m-%dT%H:%M:%S') || ' ' end as last_commit_at,
       cast(gs.nrel as bigint) as n_commits_snakemake_related,
       cast(coalesce(nc.n_evolution_cycles, 0) as bigint) as n_evolution_cycles
from ec join gs on ec.owner = gs.owner and ec.repo = gs.repo
        left join nc on ec.owner = nc.owner and ec.repo = nc.repo
""")


SQL["commit_size_rows"] = _q("""
with p as (
  select source as repo, doc_id // 60 as pos, sha1(source || ':' || cast(doc_id // 60 as varchar)) as hash,
         'd' || cast(doc_id as varchar) ||
           case lang when 'en' then '.py' when 'de' then '.smk' else '.txt' end as a_path,
         text as patch, doc_id
  from documents),
s as (
  select repo, pos, hash,
         cast(sum(case when a_path like '%.py' or a_path like '%.smk' then strlen(patch) else 0 end) as bigint)
           as commit_size,
         string_agg(patch, chr(10) order by doc_id) as message
  from p group by repo, pos, hash)
select repo, hash as commit_id, commit_size,
       strftime(make_timestamp((1704067200 + pos * 86400) * 1000000), '%Y-%m-%dT%H:%M:%S') || '+00:00' as datetime,
       regexp_replace(message, '^\\s+|\\s+$', '', 'g') as commit_message,
       cast(sum(commit_size) over (partition by repo order by pos
            rows between unbounded preceding and current row) as bigint) as codebase_size
from s
""")


SQL["commit_parents"] = _q(f"""
with {CYCLE_ROWS}, {ISSUES}, {PR_COMMITS},
ed as (select owner, repo, hash as child, len(parents) > 1 as is_merge,
              unnest(generate_series(0, len(parents) - 1)) as pos, parents
       from par where len(parents) > 0)
select ed.owner, ed.repo, ed.child, cast(ed.pos as bigint) as pos, ed.parents[ed.pos + 1] as parent,
       p.committer_date as parent_committer_date, ed.is_merge
from ed left join par p on p.owner = ed.owner and p.repo = ed.repo and p.hash = ed.parents[ed.pos + 1]
""")


SQL["cycle_durations"] = _q(f"""
with {CYCLES}
select owner, repo, cast(cycle_no as bigint) as cycle_no,
       cast(floor((end_epoch - begin_epoch) / 86400) as bigint) as diff_days,
       cast(floor((end_epoch - begin_epoch) / 3600) as bigint) as diff_hours,
       cast(floor((end_epoch - begin_epoch) / 60) as bigint) as diff_mins
from cyc
""")


SQL["issue_pull_requests"] = _q(f"""
with {ISSUES}
select owner, repo, number, max_turn as n_reviews from iss where number % 3 = 0
""")

SQL["related_commits"] = _q(f"""
with c as ({V_COMMITS})
select owner, repo, hash from c where related
""")

SQL["repos_with_issues"] = _q("""
select c_name as repo from customer where c_custkey % 5 <> 0 and c_custkey % 3 = 0
""")

SQL["commit_fields"] = _q(f"""
with c as ({V_COMMITS})
select owner, repo, hash, author, committer, committer_date, round(committer_epoch, 6) as committer_epoch,
       cast(null as varchar) as msg from c
""")

SQL["file_fields"] = _q(f"""
with f as ({V_FILES})
select repo, hash, new_path, filename, change_type, n_added_lines, n_deleted_lines, cast(null as varchar) as old_path from f
""")

SQL["entity_totals_other"] = _q(f"""
with c as ({V_COMMITS}),
rp as (select distinct owner, repo from c),
cnt as (
  select 'r' || cast(o_orderkey % 150 as varchar) as repo, 'a' as k from orders
  union all select 'r' || cast(l_partkey % 90 as varchar), 'b' from lineitem
  union all select 'r' || cast(s_suppkey % 150 as varchar), 'c' from supplier
  union all select 'r' || cast(c_custkey % 70 as varchar), 'd' from customer
  union all select 'r' || cast(p_partkey % 40 as varchar), 'e' from part)
select rp.owner, rp.repo,
       cast(count(k) filter (where k = 'a') as bigint) as x_total_commit_comments,
       cast(count(k) filter (where k = 'b') as bigint) as x_total_cicd_artifacts,
       cast(count(k) filter (where k = 'c') as bigint) as x_total_cicd_workflows,
       cast(count(k) filter (where k = 'd') as bigint) as x_total_cicd_workflow_runs,
       cast(count(k) filter (where k = 'e') as bigint) as x_total_releases
from rp left join cnt on rp.owner = 'acme' and rp.repo = cnt.repo
group by rp.owner, rp.repo
""")

SQL["stage_totals"] = _q("""
select 'extract' as stage, cast(count(*) filter (where o_orderkey % 7 <> 0) as bigint) as n_done,
       cast(count(*) filter (where o_orderkey % 7 = 0) as bigint) as n_failed from orders
""")

SQL["identities"] = _q("""
select o_orderkey, o_orderpriority || ':' || o_orderstatus as who,
       cast(floor(epoch_us(cast(o_orderdate as timestamp)) / cast(1000000 as double)) as bigint) - 7200 as epoch from orders
""")

SQL["date_ranges_backwards"] = SQL["date_ranges_month"] + " where status <> 'F'"

SQL["eventlog_sorted"] = SQL["eventlog_pr_commits"]

# --- first parents, file lists, ranges, listed commits, ladder, typed values ---------------
SQL["commit_sizes_first_parent"] = _q("""
select source as repo, sha1(source || ':' || cast(doc_id // 60 as varchar)) as hash,
       cast(sum(case when lang in ('en', 'de') then strlen(text) else 0 end) as bigint) as commit_size
from documents group by source, doc_id // 60
""")

SQL["commit_file_lists"] = _q(f"""
with f as ({V_FILES})
select repo, hash, count(*) as n_files,
       array_to_string(list_sort(list(new_path || ':' || cast(line_no as varchar) || ':' || change_type)), ',') as files
from f group by repo, hash
""")

SQL["metrics_in_range"] = _q(f"""
with f as (select * from ({V_FILES}) where committer_epoch >= epoch(timestamp '1996-01-01 00:00:00')
                                       and committer_epoch <= epoch(timestamp '1998-06-30 12:00:00'))
select repo, new_path as path, count(distinct hash) as commitscount_files,
       cast(sum(n_added_lines - n_deleted_lines) as bigint) as codechurn_count,
       count(distinct author) as contributorscount_count, cast(sum(n_added_lines) as bigint) as linescount_count_added
from f group by repo, new_path
""")

_LISTED = f"""{_ALL_HEAD.replace("act as (", PR_COMMITS.strip() + "," + chr(10) + "act as (", 1)}"""
SQL["eventlog_dedupe"] = _q(f"""
{_LISTED.replace('committer as "user" from c', """committer as "user" from c
             where not exists (select 1 from prc where prc.owner = c.owner and prc.repo = c.repo and prc.commit_hash = c.hash)""")}
select a.owner{_ALL_BODY}
union all
select owner, repo, cast(null as bigint) as cycle_no, case_id, activity, t, timestamp, "user" from prc
""")

# parents one and two back: a ref d commits on is ceil(d / 2) hops away, so the next ref and the one right after it compete
SQL["nearest_ref_ladder"] = _q("""
with c as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as idx,
                  o_orderkey = max(o_orderkey) over (partition by o_custkey) as tagged from orders),
n as (select *, min(case when tagged then idx end) over (order by idx rows between current row and unbounded following) as r1 from c),
d as (select n.*, (r1 - idx + 1) // 2 as depth from n where r1 is not null),
two as (select d.o_orderkey, d.depth, 'vc' || cast(a.o_orderkey as varchar) as ref1,
               case when b.tagged and (d.r1 + 1 - d.idx + 1) // 2 = d.depth then 'vc' || cast(b.o_orderkey as varchar) end as ref2
        from d join c a on a.idx = d.r1 left join c b on b.idx = d.r1 + 1)
select 'ladder' as repo, 'c' || cast(o_orderkey as varchar) as hash,
       case when ref2 < ref1 then ref2 else ref1 end as ref, cast(depth as bigint) as depth
from two
""")

SQL["typed_values"] = _q("""
with e as (select event_id, event_type, json_extract_string(props, '$.k') as k from events)
select event_id, k is null or try_cast(k as integer) is not null as is_int,
       event_type is null or try_cast(event_type as integer) is not null as type_is_int,
       coalesce(case when try_cast(k as integer) >= 20 then try_cast(k as integer) end, 7) as k
from e
""")

SQL["eventlog_pr_wide"] = _q("""
with c as (select *, row_number() over (order by o_orderkey) - 1 as idx from orders),
r as (select o_orderpriority as login, min(o_orderkey) as number, min(idx) as b, max(idx) as e from c
      group by o_orderpriority, o_orderstatus)
select 'wide' as repo, 'Issue-' || cast(r.number as varchar) as case_id, r.login as "user", count(*) as n_commits,
       cast(sum(cast(floor(epoch(c.o_orderdate)) as bigint)) as bigint) as sum_t,
       min('c' || cast(c.o_orderkey as varchar)) as first_hash, max('c' || cast(c.o_orderkey as varchar)) as last_hash
from r join c on c.idx >= r.b and c.idx < r.e
group by r.number, r.login
""")
