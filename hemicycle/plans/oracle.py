"""SQL of the general queries, for DuckDB on the same tables."""

_VOTES = """dated as (
  select Id, min(VoteDate) as VoteDate, min(ProjectLawID) as ProjectLawID, min(VotingOrientation) as VotingOrientation, min(UserId) as UserId
  from votes group by Id)"""

_ORPHANS = f"""with {_VOTES},
log as (
  select entity, entity_id, min(case when operation = 'created' then logged_at end) as created, max(case when operation = 'removed' then 1 else 0 end) as removed
  from record_log group by entity, entity_id),
refs as (
  select Id, VoteDate, 'ProjectLawID' as ref_field, 'proposals' as table_name, 'proposal' as entity, ProjectLawID as key_value, ProjectLawID in (select Id from proposals) as present from dated where ProjectLawID is not null
  union all
  select Id, VoteDate, 'UserId', 'users', 'user', UserId, UserId in (select Id from users) from dated where UserId is not null),
found as (
  select r.*, case when not present and removed = 1 then 'deleted' when not present then 'missing' when created > VoteDate then 'late' end as reason
  from refs r left join log l on l.entity = r.entity and l.entity_id = r.key_value)"""

_FEATURES = f"""with {_VOTES},
laws as (select Id, min(ProposingPartypartyAcronym) as acronym, min(Legislatura) as legislature from proposals group by Id)
select cast(UserId as int) as user_id, concat(VotingOrientation, ':', acronym, ':', legislature) as event_type, cast(count(*) as int) as n_votes,
  cast(floor(epoch(timestamp '2023-10-01 00:00:00' - max(VoteDate)) / 86400) as int) as days_since_last
from dated join laws on laws.Id = ProjectLawID
where VoteDate < timestamp '2023-10-01 00:00:00' and VotingOrientation between 0 and 3 and UserId in (select Id from users)
group by 1, 2"""

SQL = {
    "p1_found": f"{_ORPHANS} select Id as vote_id, ref_field, reason from found where reason is not null",
    "p1_report": f"{_ORPHANS} select table_name, strftime(VoteDate, '%Y-%m') as month, reason, count(*) as n_references, count(distinct key_value) as n_keys from found where reason is not null group by 1, 2, 3",
    "p3_found": _FEATURES,
    "features_long": f"""with stats as ({_FEATURES}), totals as (select user_id, sum(n_votes) as total from stats group by 1),
kinds as (select distinct concat(o, ':', ProposingPartypartyAcronym, ':', Legislatura) as event_type from proposals, range(4) t(o))
select p.Id as user_id, k.event_type, coalesce(n_votes, 0)::bigint as n_votes, days_since_last, coalesce(n_votes / total::double, 0.0) as share
from (select distinct Id from users) p cross join kinds k left join stats s on s.user_id = p.Id and s.event_type = k.event_type left join totals t on t.user_id = p.Id""",
}
