"""The registered queries and their SQL."""

from fernweave.plans import campaign, changes, checks, corpus, dialogue, performance, records

QUERIES = {**campaign.QUERIES, **performance.QUERIES, **records.QUERIES, **dialogue.QUERIES, **corpus.QUERIES, **changes.QUERIES, **checks.QUERIES}
ORACLE_SQL = {**campaign.ORACLE_SQL, **performance.ORACLE_SQL, **records.ORACLE_SQL, **dialogue.ORACLE_SQL, **corpus.ORACLE_SQL, **changes.ORACLE_SQL, **checks.ORACLE_SQL}
